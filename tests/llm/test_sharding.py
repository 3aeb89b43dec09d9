from collections import Counter

from tests.llm.helpers import awkward, clashing, empty

from graphloom.llm import sharding as s
from graphloom.storage import fresh_path


def test_awkward_documents(spark):
    docs = clashing(awkward(spark))
    sizes = {r.slot: r.bytes for r in s.slot_bytes(docs, 64).collect()}
    assert len(sizes) == 64 and sum(sizes.values()) == sum(len((r.text or "").encode()) for r in docs.collect())
    first = s.initial_map(s.slot_bytes(docs, 64), 64, 4)
    at = s.assign(docs, first, 64).collect()
    assert len(at) == docs.count() and len({r.slot for r in at if r.doc_id == 2}) == 1
    assert all(r.shard == r.slot // 16 for r in at)


def test_empty(spark):
    m = s.initial_map(s.slot_bytes(empty(spark), 8), 8, 2)
    assert sorted((r.slot, r.shard, r.bytes) for r in m.collect()) == [(k, k // 4, 0) for k in range(8)]
    assert s.assign(empty(spark), m, 8).count() == 0
    assert s.rebalance(m, 3).count() == 8


def brute(rows, n):
    """rows: slot, shard, bytes."""
    fair = -(-sum(b for *_, b in rows) // n)
    to, loose, held = {}, [], Counter()
    for shard in {x[1] for x in rows}:
        run = 0
        for slot, _, b in sorted((x for x in rows if x[1] == shard), key=lambda x: (-x[2], x[0])):
            run += b
            if shard < n and run <= fair:
                to[slot], held[shard] = shard, run
            else:
                loose.append((slot, b))
    ends, end = [], 0
    for k in range(n):
        end += fair - held[k]
        ends.append(end)
    at = 0
    for k, (slot, b) in enumerate(sorted(loose, key=lambda x: (-x[1], x[0]))):
        to[slot] = next((i for i, e in enumerate(ends) if at < e), k % n)
        at += b
    return to


def test_rebalance(spark):
    rows = [(k, k // 16, (k * 7919) % 1000 + (5000 if k < 4 else 0)) for k in range(64)]
    m = spark.createDataFrame([(1, *r) for r in rows], "version bigint, slot bigint, shard bigint, bytes bigint")
    for n in (3, 4, 6):
        new = s.rebalance(m, n)
        got = {r.slot: r.shard for r in new.collect()}
        assert got == brute(rows, n) and set(got.values()) <= set(range(n)) and {r.version for r in new.collect()} == {2}
    load = Counter()
    for slot, shard in got.items():
        load[shard] += rows[slot][2]
    # a shard goes beyond its fair share by less than the slot that it was given last
    assert max(load.values()) < -(-sum(load.values()) // 6) + max(b for *_, b in rows)


def test_versions_are_kept(spark):
    path = fresh_path(spark, "map")
    m = s.initial_map(s.slot_bytes(awkward(spark), 16), 16, 2)
    s.store_version(m, path, 1)
    s.store_version(s.rebalance(s.load_version(spark, path, 1), 3), path, 2)
    one, two = ({r.slot: r.shard for r in s.load_version(spark, path, v).collect()} for v in (1, 2))
    assert set(one.values()) == {0, 1} and set(two.values()) <= {0, 1, 2} and one != two
