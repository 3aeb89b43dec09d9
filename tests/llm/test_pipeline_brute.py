"""The whole pipeline against plain Python loops over the whole table of documents."""

import math
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
from tests.llm.test_minhash import brute_pairs, groups
from tests.llm.test_quality import brute_fit

from graphloom.llm import line_dedup, minhash, mixing, packing, quality
from graphloom.llm.common import table
from graphloom.llm.tokens import slices


def brute_quality(docs, labels):
    x = np.concatenate([quality.features(s) for s in slices(pa.array(docs["text"], pa.string()))])
    at = {i: k for k, i in enumerate(docs["doc_id"])}
    good, bad = ([at[i] for i, q in zip(labels["doc_id"], labels["quality"], strict=True) if (q > 0) == want and i in at] for want in (True, False))
    mean, scale, w = brute_fit(x[good], x[bad])
    score = ((x - mean) / scale) @ w
    least = sorted(score[good])[max(0, math.ceil(quality.QUANTILE * len(good)) - 1)]
    return docs[score >= least - 1e-9].reset_index(drop=True)


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :]
    return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k:]


def brute_lines(docs):
    """docs: (id, text) in order of id. Gives the texts that are left."""
    lines = [(i, k, tuple(line.split())) for i, t in docs for k, line in enumerate(t.split("\n")) if line.split()]
    first, heads, found = {}, defaultdict(list), {}
    for i, k, w in lines:
        if w in first:
            found[i, k] = (first[w][0], len(w))
            continue
        first[w] = (i, k)
        if len(w) < line_dedup.MIN_WORDS:
            continue
        # two lines of eight words or more that are one edit apart have the first two or the last two words in common
        near = [(p, v) for key in ((0, w[:2]), (1, w[-2:])) for p, v in heads[key] if one_edit(w, v)]
        if near:
            found[i, k] = (min(near)[0][0], len(w))
        for key in ((0, w[:2]), (1, w[-2:])):
            heads[key].append(((i, k), w))
    size, shared = Counter(), Counter()
    for i, _, w in lines:
        size[i] += len(w)
    for (i, _), (j, n) in found.items():
        if i != j:
            shared[i, j] += n
    sig = {}
    for s in slices(pa.array([t for _, t in docs])):
        has, x = minhash.signatures(s)
        sig |= {docs[k + s.first][0]: row for k, row in zip(has.tolist(), x, strict=True)}
    alike = lambda i, j, n: n >= line_dedup.COPY_SHARE * (size[i] + size[j] - n) and 2 * min(size[i], size[j]) >= max(size[i], size[j])
    whole = {i for (i, j), n in shared.items() if alike(i, j, n) and (sig[i] != sig[j]).sum() <= minhash.MAX_DISTANCE}
    out = {}
    for i, t in docs:
        gone = {k for (d, k), (j, _) in found.items() if d == i and (j == i or i not in whole)}
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        if not gone or left.strip():
            out[i] = left if gone else t
    return out


def brute_mix(docs):
    """docs: (id, source, words). Ids of the documents as often as they are trained on."""
    sources = defaultdict(list)
    for i, s, n in docs:
        sources[s].append(((i % 2147483648 * 2654435761) % 4294967296, i, n))
    tokens = {s: sum(n for *_, n in x) for s, x in sources.items()}
    total = sum(tokens.values())
    weight = [{s: v**p / sum(u**p for u in tokens.values()) for s, v in tokens.items()} for _, p in mixing.SCHEDULE]
    times = [t for t, _ in mixing.SCHEDULE]
    out = []
    for s, rows in sources.items():
        demand = total * sum((times[k + 1] - times[k]) * (weight[k][s] + weight[k + 1][s]) / 2 for k in range(len(times) - 1))
        at, epoch = 0, 0
        while epoch * tokens[s] < demand:
            at = epoch * tokens[s]
            for _, i, n in sorted(rows):
                if at < demand:
                    out.append(i)
                at += n
            epoch += 1
    return out


def test_the_pipeline_is_what_plain_loops_give(spark, data):
    docs, labels = table(spark, data, "documents").toPandas(), table(spark, data, "labels").toPandas()
    good = brute_quality(docs, labels).sort_values("doc_id")
    left = brute_lines(list(zip(good["doc_id"], good["text"], strict=True)))
    kept = good[good["doc_id"].isin(left)].assign(text=lambda d: d["doc_id"].map(left))
    kept = kept[~kept["doc_id"].isin({b for _, b in groups(brute_pairs(kept))})]
    words = {i: len(t.split()) for i, t in zip(kept["doc_id"], kept["text"], strict=True)}
    trained = brute_mix([(i, s, words[i]) for i, s in zip(kept["doc_id"], kept["source"], strict=True)])
    pieces = [(i, p, min(packing.CAPACITY, words[i] - p * packing.CAPACITY)) for i in trained for p in range(math.ceil(words[i] / packing.CAPACITY))]
    got = corpus_pipeline.run(spark, data).collect()
    assert Counter((r.doc_id, r.piece, r.length) for r in got) == Counter(pieces)
    # equal lengths are interchangeable, so bins are compared by the lengths that they hold
    bins = lambda rows: Counter(tuple(sorted(v)) for v in rows.values())
    brute, mine = defaultdict(list), defaultdict(list)
    for b, (*_, n) in zip(packing.brute_force([n for *_, n in pieces], packing.CAPACITY), pieces, strict=True):
        brute[b].append(n)
    for r in got:
        mine[r.bin_id].append(r.length)
    assert bins(mine) == bins(brute)
    assert all(sum(v) <= packing.CAPACITY for v in mine.values())
