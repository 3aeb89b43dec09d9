import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.llm.helpers import awkward, clashing, empty

from graphloom.llm import packing


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.lists(st.integers(1, 40), max_size=80))
def test_plan_is_document_by_document_best_fit(capacity, lengths):
    lengths = [min(x, capacity) for x in lengths]
    runs = packing.plan(Counter(lengths), capacity)
    bins = {}
    for length, rank, items, first, each, _ in runs:
        for j in range(items):
            bins[(length, rank + j)] = first + j // each
    seen = Counter()
    ours = []
    for x in lengths:
        ours.append(bins[(x, seen[x])])
        seen[x] += 1
    brute = packing.brute_force(lengths, capacity)
    content = lambda b: Counter(tuple(sorted(x for x, y in zip(lengths, b, strict=True) if y == k)) for k in set(b))
    assert content(ours) == content(brute)


def test_room_tree():
    rng = random.Random(1)
    for capacity in (1, 2, 7, 8, 31, 100):
        tree, have = packing.RoomTree(capacity), set()
        for _ in range(200):
            x = rng.randint(0, capacity)
            tree.set(x, x not in have)
            have ^= {x}
            for need in range(capacity + 1):
                assert tree.tightest(need) == min((h for h in have if h >= need), default=-1)


def _check(found, capacity):
    at = defaultdict(list)
    for r in found:
        if r.length:
            at[r.bin_id].append((r.bin_offset, r.length))
        else:
            assert r.bin_id is None and r.bin_offset is None
    for spans in at.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][0] + spans[-1][1] <= capacity
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    assert not at or set(at) == set(range(len(at)))


def test_awkward_documents(spark):
    docs = clashing(awkward(spark))
    found = packing.pack(docs, capacity=50).collect()
    _check(found, 50)
    total = sum(len((r.text or "").split()) for r in docs.collect())
    assert sum(r.length for r in found) == total
    assert sorted((r.piece for r in found if r.doc_id == 7)) == list(range(1200))
    assert sum(r.doc_id == 2 and r.piece == 0 for r in found) == 2
    assert {r.doc_id for r in found if r.length == 0} == {4, 5, 6}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = packing.pack(docs).collect()
    _check(found, packing.CAPACITY)
    lengths = [r.length for r in found if r.length]
    assert len({r.bin_id for r in found if r.length}) == len(set(packing.brute_force(lengths, packing.CAPACITY)))


def test_empty_and_other_lengths(spark):
    assert packing.pack(empty(spark)).count() == 0
    docs = spark.range(5).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    assert {r.bin_id for r in packing.pack(docs, 10, F.lit(4)).collect()} == {0, 1, 2}
