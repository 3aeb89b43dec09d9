import corpus_pipeline as c
from tests.llm.helpers import awkward, clashing, empty

from graphloom.llm.common import table
from graphloom.storage import materialise

SF = "/root/testdata/sf0.001"


def _after(spark, docs):
    for _, stage in c.STAGES:
        before, docs = docs, materialise(stage(spark, docs, SF), "test-stage")
        yield before, docs


def test_stages_return_documents(spark):
    docs = table(spark, SF, "documents")
    *most, (_, last) = _after(spark, docs)
    assert len(most) == 4
    for before, after in most:
        assert after.dtypes == before.dtypes and 0 < after.count()
    assert {"doc_id", "bin_id"} <= set(last.columns)
    got = c.run(spark, SF)
    assert sorted(map(str, got.collect())) == sorted(map(str, last.collect()))


def test_clean_documents_stay(spark):
    docs = table(spark, SF, "documents")
    good = {r.doc_id for r in table(spark, SF, "labels").filter("quality = 1").collect()}
    bad = {r.doc_id for r in table(spark, SF, "labels").filter("quality = 0").collect()}
    kept = {r.doc_id for r in c.STAGES[0][1](spark, docs, SF).collect()}
    assert len(good - kept) <= 0.01 * len(good) + 1 and not bad & kept


def test_awkward_documents(spark):
    """Ties, repeated rows, NULLs and long texts, and what each stage makes of them."""
    docs = clashing(awkward(spark))
    *most, (_, last) = _after(spark, docs)
    for before, after in most:
        assert after.dtypes == before.dtypes
    ids = lambda df: [r.doc_id for r in df.select("doc_id").collect()]
    good, cut, single, mixed = (after for _, after in most)
    assert not {4, 5, 6} & set(ids(good)) and ids(good).count(2) == 2 and None in ids(good), "documents without words go, repeated rows stay"
    assert {1, 7, 8, 9, 11} <= set(ids(cut)) and None in ids(cut)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.text for r in cut.collect()}[7] == text[7], "a very long text is worked on whole"
    assert 1 in ids(single) and not {2, 3} & set(ids(single)), "of copies the smallest id stays"
    assert set(ids(mixed)) <= set(ids(single))
    packed = {}
    for r in last.collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    assert packed[7] % len(text[7].split()) == 0 if 7 in packed else True


def test_near_copies_do_not_survive_as_fragments(spark):
    """What near-dedup would take out of the good documents is not there after line dedup and near-dedup."""
    from graphloom.llm import minhash

    d = "/root/testdata/sf0.01"
    good = materialise(c.STAGES[0][1](spark, table(spark, d, "documents"), d), "good")
    gone = {r.id for r in minhash.near_groups(good).collect()}
    cut = materialise(c.STAGES[1][1](spark, good, d), "cut")
    left = {r.doc_id for r in c.STAGES[2][1](spark, cut, d).collect()}
    assert len(gone) > 50 and len(gone & left) <= 0.1 * len(gone), len(gone & left) / len(gone)


def test_empty(spark):
    for _, after in _after(spark, empty(spark)):
        assert after.count() == 0
