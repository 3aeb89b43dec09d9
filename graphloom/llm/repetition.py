"""Operator 3: quality rules on repetition, from suffix arrays.

The tokens of each document get a suffix array (prefix doubling) and the longest common prefixes of
neighbours in it. Every LCP interval with a prefix of at least ``min_repeat`` tokens is a repeated substring,
and the union of the spans of the maximal ones is the union, over positions, of the longest repeat that
starts there (the larger LCP with the two neighbours). A document is kept if that union covers at most
``max_covered`` of its tokens and its longest repeat has at most ``max_longest`` tokens.

One suffix array serves all documents of a slice: the document is the most significant part of a suffix's
first rank, so suffixes of different documents never meet. All steps are numpy operations over the slice.

Defined results: a document without tokens (NULL, empty or blank) has no repeats and is kept. Very long
documents are worked on whole. Repeated rows are judged alike; an empty table gives no rows. Only the id and
the text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import table
from graphloom.llm.tokens import Slice, slices

MIN_REPEAT = 8
MAX_COVERED = 0.5
MAX_LONGEST = 200


def _dense(sorted_keys: np.ndarray) -> np.ndarray:
    """For sorted keys, the index at which each one's group of equals starts."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    at = np.flatnonzero(new)
    return np.repeat(at, np.diff(np.append(at, len(sorted_keys))))


def suffix_order(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array, and ranks by the first 1, 2, 4, ... tokens: equal ranks mean equal beginnings."""
    n = len(hashes)
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.ones(n, bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    starts = np.flatnonzero(new)
    group = np.repeat(starts, np.diff(np.append(starts, n)))
    rank = np.empty(n, np.int64)
    rank[order] = group
    levels, step = [rank], 1
    last = np.append(np.flatnonzero(doc[1:] != doc[:-1]), n - 1)  # last token of each document
    end = last[np.searchsorted(last, np.arange(n))]
    while True:
        size = np.bincount(group, minlength=n)
        slots = np.flatnonzero(size[group] > 1)
        if not len(slots):
            return order, levels
        at = order[slots]
        beyond = at + step
        second = np.where(beyond <= end[at], rank[np.minimum(beyond, n - 1)] + 1, 0)
        key = group[slots] * np.int64(n + 1) + second
        by = np.argsort(key, kind="stable")
        order[slots] = at[by]
        group[slots] = slots[_dense(key[by])]
        rank = rank.copy()
        rank[order[slots]] = group[slots]
        levels.append(rank)
        step *= 2


def neighbour_lcp(doc: np.ndarray, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """LCP of each suffix in the array with the one before it; 0 across documents."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    i, j = order[:-1].copy(), order[1:].copy()
    live = doc[i] == doc[j]
    slot, i, j = np.flatnonzero(live) + 1, i[live], j[live]
    last = np.append(np.flatnonzero(doc[1:] != doc[:-1]), n - 1)
    end = last[np.searchsorted(last, np.arange(n))]
    stop = np.minimum(end[i] - i, end[j] - j) + 1
    length = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = length + (1 << k) <= stop
        a, b = np.minimum(i + length, n - 1), np.minimum(j + length, n - 1)
        length += ((levels[k][a] == levels[k][b]) & inside).astype(np.int64) << k
    lcp[slot] = length
    return lcp


def longest_from(s_doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each position, the longest prefix of its suffix that occurs elsewhere in the document."""
    n = len(hashes)
    longest = np.zeros(n, np.int64)
    if n:
        order, levels = suffix_order(s_doc, hashes)
        lcp = neighbour_lcp(s_doc, order, levels)
        longest[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    return longest


def measure(s: Slice, min_repeat: int) -> np.ndarray:
    """(tokens, covered tokens, longest repeat) of each document."""
    longest = longest_from(s.doc, s.hashes)
    n = len(longest)
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(longest >= min_repeat)
    edge[at] += 1
    np.subtract.at(edge, at + longest[at], 1)
    covered = np.cumsum(edge[:n]) > 0
    out = np.zeros((s.docs, 3), np.int64)
    out[:, 0] = np.bincount(s.doc, minlength=s.docs)
    out[:, 1] = np.bincount(s.doc[covered], minlength=s.docs)
    np.maximum.at(out[:, 2], s.doc, np.where(longest >= min_repeat, longest, 0))
    return out


def repetition(text: Column, min_repeat: int = MIN_REPEAT) -> Column:
    @F.arrow_udf("struct<n_tokens: bigint, covered: bigint, longest_repeat: bigint>")
    def measured(text: pa.Array) -> pa.Array:
        rows = [measure(s, min_repeat) for s in slices(text)]
        flat = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
        return pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["n_tokens", "covered", "longest_repeat"])

    # not deterministic to the optimiser: else the filter on the result evaluates it a second time
    return measured.asNondeterministic()(text)


def judged(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """doc_id, n_tokens, covered_fraction, longest_repeat and keep of every document."""
    seen = docs.select("doc_id", repetition(F.col("text"), min_repeat).alias("r"))
    share = F.coalesce(F.try_divide("r.covered", "r.n_tokens"), F.lit(0.0))
    return seen.select("doc_id", "r.n_tokens", share.alias("covered_fraction"), "r.longest_repeat", ((share <= max_covered) & (F.col("r.longest_repeat") <= max_longest)).alias("keep"))


def op3_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that pass, with their measures."""
    return judged(table(spark, sf_dir, "documents")).filter("keep").drop("keep")
