import random

import corpus_pipeline
from tests.llm.helpers import SCHEMA, sentence
from tests.llm.test_line_dedup import distance, mutate

from graphloom.llm import line_dedup as d


def brute(docs, least, equal):
    """docs: (id, text) in order of id. Long lines go for an earlier long one within one edit, any of ``equal`` words on for an equal one."""
    lines = [(i, k, line.split()) for i, t in docs for k, line in enumerate(t.split("\n"))]
    gone = set()
    for n, (i, k, y) in enumerate(lines):
        if any(len(y) >= equal and x == y or min(len(x), len(y)) >= least and distance(x, y) <= 1 for *_, x in lines[:n]):
            gone.add((i, k))
    out = {}
    for i, t in docs:
        kept = [line for k, line in enumerate(t.split("\n")) if (i, k) not in gone]
        text = "\n".join(kept)
        if len(kept) == len(t.split("\n")) or text.strip():
            out[i] = text
    return out


def test_short_equal_lines_against_brute_force(spark):
    for seed in range(2):
        rng = random.Random(seed)
        pool = [sentence(rng, rng.randint(1, 12)).split() for _ in range(30)]
        while len(pool) < 70:
            pool.append(mutate(rng, rng.choice([p for p in pool if len(p) > 2])))
        docs = [(k, "\n".join(" ".join(rng.choice(pool)) for _ in range(rng.randint(0, 6)))) for k in range(40)]
        df = spark.createDataFrame(docs, "doc_id bigint, text string")
        for equal in (1, 3):
            assert {r.doc_id: r.text for r in d.without_repeats(df, min_words=6, equal_words=equal).collect()} == brute(docs, 6, equal)


def test_the_pipeline_takes_out_short_repeats(spark):
    notice, one = "Released under the MIT License.", "a b c d"
    rows = [(1, f"x\n{notice}\n\nfirst of all", "en", "a", 1), (2, f"{notice}\n\nsecond", "en", "a", 1), (3, f"{one}\n{one}", "en", "a", 1), (4, "a b c e", "en", "a", 1)]
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_lines(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert got == {1: f"x\n{notice}\n\nfirst of all", 2: "\nsecond", 3: one, 4: "a b c e"}
