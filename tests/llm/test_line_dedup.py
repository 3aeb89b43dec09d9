import random

import numpy as np
from tests.llm.helpers import awkward, clashing, empty, sentence

from graphloom.llm import line_dedup as d


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs, least):
    """docs: (id, text) in order of id."""
    lines = [(i, k, line.split()) for i, t in docs for k, line in enumerate((t or "").split("\n"))]
    long = [x for x in lines if len(x[2]) >= least]
    gone = {y[:2] for n, y in enumerate(long) if any(distance(x[2], y[2]) <= 1 for x in long[:n])}
    gone |= {y[:2] for n, y in enumerate(lines) if y[2] and any(x[2] == y[2] for x in lines[:n])}
    out = {}
    for i, t in docs:
        kept = [line for k, line in enumerate((t or "").split("\n")) if (i, k) not in gone]
        if any((i, k) in gone for k in range(len((t or "").split("\n")))):
            t = "\n".join(kept)
            if not t.strip():
                continue
        out[i] = t
    return out


def mutate(rng, words):
    words, k = list(words), rng.randrange(4)
    for _ in range(rng.choice([1, 1, 2])):
        at = rng.randrange(len(words))
        if k == 0:
            words[at] = sentence(rng, 1)
        elif k == 1:
            del words[at]
        elif k == 2:
            words.insert(at, rng.choice(words))
    return words


def test_against_brute_force(spark):
    for seed in range(4):
        rng = random.Random(seed)
        pool = [sentence(rng, rng.randint(3, 14)).split() for _ in range(30)]
        while len(pool) < 90:
            pool.append(mutate(rng, rng.choice(pool)))
        docs = [(k, "\n".join(" ".join(rng.choice(pool)) for _ in range(rng.randint(0, 6)))) for k in range(40)]
        df = spark.createDataFrame(docs, "doc_id bigint, text string")
        assert {r.doc_id: r.text for r in d.without_repeats(df, min_words=4).collect()} == brute(docs, 4)


def test_shared_halves_are_joined_where_they_are_too_many_for_a_bitmap(spark, monkeypatch):
    rng = random.Random(7)
    pool = [sentence(rng, rng.randint(3, 14)).split() for _ in range(30)]
    while len(pool) < 90:
        pool.append(mutate(rng, rng.choice(pool)))
    docs = [(k, "\n".join(" ".join(rng.choice(pool)) for _ in range(rng.randint(0, 6)))) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    monkeypatch.setattr(d, "MOST_SHARED", 1)
    assert {r.doc_id: r.text for r in d.without_repeats(df, min_words=4).collect()} == brute(docs, 4)


def _flat(lines):
    return np.array([w for x in lines for w in x], np.uint64), np.cumsum([0] + [len(x) for x in lines])


def test_one_edit():
    rng = random.Random(2)
    pairs = [([rng.randrange(3) for _ in range(rng.randint(0, 6))], [rng.randrange(3) for _ in range(rng.randint(0, 6))]) for _ in range(3000)]
    got = d.within_one(*_flat([a for a, _ in pairs]), *_flat([b for _, b in pairs]))
    assert got.tolist() == [distance(a, b) <= 1 for a, b in pairs]


def test_variants_meet_if_and_only_if_a_deletion_makes_them_equal():
    rng = random.Random(3)
    lines = [[rng.randrange(3) for _ in range(rng.randint(2, 5))] for _ in range(150)]
    keys, roles, of = d.variants(*_flat(lines))
    have = [{(k, r) for k, r in zip(keys[of == x].tolist(), roles[of == x].tolist(), strict=True)} for x in range(len(lines))]
    without = lambda x: {tuple(x[:i] + x[i + 1 :]) for i in range(len(x))}
    for a, x in enumerate(lines):
        for b, y in enumerate(lines[:a]):
            replaced = len(x) == len(y) and any(x[:i] + x[i + 1 :] == y[:i] + y[i + 1 :] for i in range(len(x)))
            assert bool({k for k in have[a] & have[b] if k[1] == 0}) == replaced
            assert bool({k for k, r in have[a] if r == 1} & {k for k, r in have[b] if r == 2}) == (tuple(y) in without(x))


def test_near_copies_are_left_whole_for_near_dedup(spark):
    lines = [sentence(random.Random(k), 12) for k in range(10)]
    copy = [*lines[:9], sentence(random.Random(90), 12)]
    excerpt = [sentence(random.Random(100 + k), 12) for k in range(20)] + lines[:3]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join([*copy, copy[0]])), (3, "\n".join(excerpt))], "doc_id bigint, text string")
    got = {r.doc_id: r.text.split("\n") for r in d.without_repeats(docs, spare_copies=True).collect()}
    assert got == {1: lines, 2: [*copy, copy[0]], 3: excerpt[:20]}
    assert {r.doc_id: r.text.split("\n") for r in d.without_repeats(docs).collect()}[2] == copy[9:]
    twice = spark.createDataFrame([(5, "a b\na b\nc d")], "doc_id bigint, text string")
    assert [r.text for r in d.without_repeats(twice, spare_copies=True).collect()] == ["a b\nc d"]


def test_text_ids_and_own_names(spark):
    docs = spark.createDataFrame([("b", "x y z", 1, 2), ("a", "x y z\nw", 3, 4)], "doc_id string, text string, _line_key int, _key int")
    out = d.without_repeats(docs)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [("a", "x y z\nw", 3, 4)]


def test_awkward_documents(spark):
    docs = clashing(awkward(spark))
    out = d.without_repeats(docs)
    assert out.dtypes == docs.dtypes
    got = {(r.doc_id, r.text): r for r in out.collect()}
    ids = [i for i, _ in got]
    assert {4, 5, 6, 8, 9, 11} <= set(ids) and None in ids and ids.count(10) == 2
    assert 1 in ids and 2 not in ids and 3 not in ids, "they lose their only line"
    before = {r.doc_id: r for r in docs.collect()}
    assert got[(7, before[7].text)].n_chars == before[7].n_chars
    assert got[(4, None)].n_chars is None


def test_same_id(spark):
    line = "a line of quite a few words that comes again"
    docs = spark.createDataFrame([(1, line), (1, line), (1, line + "\nx"), (None, line), (0, "y\n" + line)], "doc_id bigint, text string")
    left = sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in d.without_repeats(docs).collect())
    assert left == [(False, 0, line), (True, 0, "y"), (True, 1, "x")]


def test_a_very_long_line_and_one_like_it(spark):
    words = [f"w{k}" for k in range(70_000)]
    other = list(words)
    other[66_000] = "changed"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "head\n" + " ".join(other))], "doc_id bigint, text string")
    assert {r.doc_id: len(r.text) for r in d.without_repeats(docs).collect()} == {1: len(" ".join(words)), 2: 4}


def test_empty(spark):
    assert d.without_repeats(empty(spark)).count() == 0
