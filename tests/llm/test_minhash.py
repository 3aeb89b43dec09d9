import random

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.helpers import awkward, clashing, empty, sentence

from graphloom.llm import minhash, tokens


def brute_pairs(pdf, limit=minhash.MAX_DISTANCE):
    ids, sigs = [], []
    for s in tokens.slices(pa.array(pdf["text"], pa.string())):
        has, sig = minhash.signatures(s)
        ids += [pdf["doc_id"].iloc[k + s.first] for k in has]
        sigs.append(sig)
    x = np.concatenate(sigs)
    found = set()
    for i in range(len(x)):
        for j in np.flatnonzero((x[i + 1 :] != x[i]).sum(1) <= limit) + i + 1:
            a, b = sorted((int(ids[i]), int(ids[j])))
            if a != b:
                found.add((a, b))
    return found


def groups(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {(find(x), x) for x in root if find(x) != x}


def corpus(seed, n=120):
    """Chains of copies: each differs from one before it, so that groups hold pairs beyond the threshold."""
    rng = random.Random(seed)
    docs = [sentence(rng, rng.randint(5, 120)) for _ in range(n // 4)]
    while len(docs) < n:
        words = rng.choice(docs).split()
        for _ in range(rng.randint(0, 1 + len(words) // 12)):
            words[rng.randrange(len(words))] = sentence(rng, 1)
        docs.append(" ".join(words))
    rng.shuffle(docs)
    return docs


def test_keys_keep_the_guarantee():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**16, (300, minhash.POSITIONS)).astype(np.uint16)
    b = a.copy()
    for k in range(len(a)):
        at = rng.choice(minhash.POSITIONS, minhash.MAX_DISTANCE, replace=False)
        b[k, at] ^= 1
    # the worst case: every chunk but one has two errors
    b[0] = a[0]
    for c in range(minhash.CHUNKS):
        b[0, c * 5 : c * 5 + (1 if c == 3 else 2)] ^= 1
    assert (a[0] != b[0]).sum() == minhash.MAX_DISTANCE
    assert (minhash.chunk_keys(a) == minhash.chunk_keys(b)).any(axis=1).all()


def test_all_pairs_and_their_groups(spark):
    for seed in (1, 2):
        docs = spark.createDataFrame(list(enumerate(corpus(seed))), "doc_id bigint, text string")
        wanted = brute_pairs(docs.toPandas())
        assert {(r.doc_id_a, r.doc_id_b) for r in minhash.hamming_pairs(docs).collect()} == wanted
        assert {(r.doc_id_a, r.doc_id_b) for r in minhash.near_pairs(docs).collect()} == groups(wanted)


@pytest.mark.parametrize(("small", "block"), [(32, 1024), (2, 3)])
def test_links_are_those_of_all_pairs(spark, monkeypatch, small, block):
    """Also with limits so low that groups meet in several blocks."""
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = corpus(3, 80)
    docs = spark.createDataFrame([*enumerate(texts), *((100 + k, t) for k, t in enumerate(texts[:20])), (0, texts[0])], "doc_id bigint, text string")
    pairs = brute_pairs(docs.toPandas())
    degree = {}
    for a, b in pairs:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    got = {(r.doc_id_a, r.doc_id_b): (r.links_a, r.links_b) for r in minhash.near_links(docs).collect()}
    assert set(got) == groups(pairs)
    assert all(n == (degree[a], degree[b]) for (a, b), n in got.items())


def test_the_query_gives_the_groups_of_all_pairs(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    pairs = brute_pairs(docs.toPandas())
    got = {(r.doc_id_a, r.doc_id_b) for r in minhash.op4_multi_index_minhash(spark, data).collect()}
    assert got == groups(pairs) and got


def test_a_threshold_that_would_lose_pairs_is_refused(spark):
    with pytest.raises(ValueError):
        minhash.near_groups(empty(spark), limit=60)
    with pytest.raises(ValueError):
        minhash.hamming_pairs(empty(spark), limit=32)


def test_text_ids_and_own_names(spark):
    docs = spark.createDataFrame([("b1", "one two three four five", 1, 2), ("a1", "one two three four five", 3, 4)], "doc_id string, text string, _near_id int, root int")
    assert [tuple(r) for r in minhash.near_links(docs).collect()] == [("a1", "b1", 1, 1)]
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and [(r.doc_id, r["_near_id"]) for r in kept.collect()] == [("a1", 3)]


def test_recall_of_near_copies(spark):
    rng = random.Random(9)
    docs = []
    for k in range(60):
        words = sentence(rng, 200).split()
        docs.append((2 * k, " ".join(words)))
        for at in rng.sample(range(200), 8):
            words[at] = sentence(rng, 1)
        docs.append((2 * k + 1, " ".join(words)))
    found = {(r.doc_id_a, r.doc_id_b) for r in minhash.near_pairs(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    true = {(2 * k, 2 * k + 1) for k in range(60)}
    assert len(found & true) >= 0.95 * len(true) and found <= true


def test_awkward_documents(spark):
    docs = clashing(awkward(spark))
    kept = minhash.keep_one(docs)
    assert kept.dtypes == docs.dtypes
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids
    assert {4, 5, 6, 7, 8, 9, 11} <= set(ids) and None in ids and ids.count(10) == 2


def test_a_large_group_of_equal_documents(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'the same few words in every one of them' AS text")
    found = minhash.near_pairs(docs).collect()
    assert {r.doc_id_a for r in found} == {0} and len(found) == 2999
    assert [r.doc_id for r in minhash.keep_one(docs).collect()] == [0]


def test_empty(spark):
    assert minhash.near_pairs(empty(spark)).count() == 0
    assert minhash.near_links(empty(spark)).count() == 0
    assert minhash.hamming_pairs(empty(spark)).count() == 0
    assert minhash.keep_one(empty(spark)).count() == 0


def test_keys_are_not_broadcast_however_small_spark_takes_them_to_be(spark):
    # 80 keys a signature: the estimate of the exploded table is a fraction of the file's size
    sigs = minhash.signed(spark.createDataFrame([(k, f"some words of a document {k}") for k in range(50)], "doc_id bigint, text string"))
    keys = minhash.postings(sigs)
    shared = keys.groupBy("key").agg({"id": "min"})
    assert "BroadcastHashJoin" not in keys.join(shared, "key")._jdf.queryExecution().executedPlan().toString()
