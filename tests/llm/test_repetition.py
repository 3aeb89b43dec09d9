import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.helpers import awkward, clashing, empty

from graphloom.llm import repetition, tokens


def brute(words, least):
    n = len(words)
    covered, longest = set(), 0
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while i + k < n and j + k < n and words[i + k] == words[j + k]:
                    k += 1
                if k >= least:
                    longest = max(longest, k)
                    covered |= set(range(i, i + k))
    return n, len(covered), longest


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab \n", max_size=40)), min_size=1, max_size=6), st.integers(1, 4))
def test_measure_is_brute_force(docs, least):
    for s in tokens.slices(pa.array(docs, pa.string()), 40):
        got = repetition.measure(s, least)
        for k in range(s.docs):
            assert tuple(got[k]) == brute((docs[s.first + k] or "").split(), least)


def test_many_documents_at_once():
    rng = random.Random(5)
    docs = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    for s in tokens.slices(pa.array(docs)):
        got = repetition.measure(s, 3)
        for k in range(s.docs):
            assert tuple(got[k]) == brute(docs[s.first + k].split(), 3)


def test_awkward_documents(spark):
    rows = {r.doc_id: r for r in repetition.judged(clashing(awkward(spark)), min_repeat=3).collect()}
    assert all(rows[i].keep and rows[i].n_tokens == 0 and rows[i].covered_fraction == 0 for i in (4, 5, 6))
    assert rows[8].n_tokens == 1 and rows[7].n_tokens == 60_000 and None in rows
    assert rows[11].covered_fraction == 1 and not rows[11].keep
    assert repetition.judged(awkward(spark)).count() == awkward(spark).count()
    assert repetition.judged(empty(spark)).count() == 0


def test_rules(spark):
    # the twelve words come twice: 24 of the tokens are covered, and 100 or 10 more are not
    docs = spark.createDataFrame([(1, " ".join(f"w{i % 12}" for i in range(24)) + " " + " ".join(f"x{i}" for i in range(10))), (2, " ".join(f"w{i % 12}" for i in range(24)) + " " + " ".join(f"x{i}" for i in range(100)))], "doc_id bigint, text string")
    assert [(r.doc_id, r.keep, r.longest_repeat) for r in repetition.judged(docs).orderBy("doc_id").collect()] == [(1, False, 12), (2, True, 12)]
    assert [r.keep for r in repetition.judged(docs, max_longest=11).orderBy("doc_id").collect()] == [False, False]
