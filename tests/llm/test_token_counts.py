from tests.llm.helpers import awkward, clashing, empty

from graphloom.llm import token_counts as t


def expected(docs):
    e = t.encoding(t.VOCABULARY)
    return sorted(((r.doc_id, len(e.encode_ordinary(r.text or ""))) for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r))


def got(df):
    return sorted(((r.doc_id, r.n_tokens) for r in df.collect()), key=lambda r: (r[0] is not None, r))


def test_awkward_documents(spark):
    odd = spark.createDataFrame([(20, "I'm  you're\n\n don't 'tis 12,5 \t\r\n x  "), (21, "  nb　sp   é😀 ²"), (22, "1"), (23, "a1b2 c_d-e")], "doc_id bigint, text string")
    docs = awkward(spark).select("doc_id", "text").unionByName(odd)
    for hot in (1_000_000, 20, 0):
        assert got(t.token_counts(clashing(docs), hot=hot)) == expected(docs)


def test_whole_table_and_another_vocabulary(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(t.token_counts(docs)) == expected(docs)
    other = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    e = t.encoding(other)
    few = docs.filter("doc_id < 20")
    assert got(t.token_counts(few, other)) == sorted((r.doc_id, len(e.encode_ordinary(r.text))) for r in few.collect())


def test_hot_part_is_bounded(spark):
    vocab = spark.range(1, 400).selectExpr("concat('p', id) AS piece", "id AS n", "1 AS pieces")
    for hot in (0, 1, 10, 100, 1000):
        assert t.hot_part(vocab, hot).count() <= hot
    assert t.hot_part(vocab, 1000).count() == 399


def test_empty(spark):
    assert t.token_counts(empty(spark)).count() == 0
