"""Operator 4: MinHash near-duplicates through a multi-index Hamming join.

A document's signature has ``POSITIONS`` minima over its 3-token shingles, each cut to 16 bits. Two documents
are near duplicates if their signatures differ in at most ``MAX_DISTANCE`` positions. The positions form
chunks; by the pigeonhole principle two signatures within the threshold have a chunk with at most
``floor(threshold / chunks)`` errors. With 80 positions, 16 chunks of 5 and a threshold of 31 that is one
error: every way of leaving out one position of a chunk is a key, and every pair within the threshold shares
a key. So the join finds all such pairs; each candidate is verified on whole signatures.

``hamming_pairs`` lists all pairs. ``near_groups`` gives the connected components of the same pairs without
listing them, as a group of n copies has n * n / 2: equal signatures are merged first; in every bucket of a
key each member is tried against the smallest id; what that connects is contracted; then only pairs of
*different* components within a bucket are still open, and all of those are tried. The components are those
of all pairs, whatever the sizes of groups or buckets. ``near_links`` adds the number of links of each document,
that is, of documents within the threshold, which counts the different signatures of a component against each other.
Groups of more than ``SMALL`` members meet in blocks of bounded size, compared as arrays in a task that gives at most a
row a member: no pair is ever a row there. A large group costs quadratically in its number of *different* signatures.

Defined results: documents without tokens (NULL, empty or blank text) have no signature and are near to
nothing; so are rows without an id. A text of fewer than three tokens is one shingle; texts of any length are
signed whole, however long. Rows with one id are one document: they stay or go together, and its links are those of its
texts added up. Ties are broken by the smaller id, which stays; repeated rows count once. Ids of any type that can be
ordered will do. An empty table gives no pairs. Only the id and the text are read; ``keep_one`` passes all columns
through, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import local_roots, quoted, table, unused
from graphloom.llm.tokens import Slice, binary_rows, flat_rows, mix64, slices
from graphloom.operators.community import star_roots
from graphloom.storage import materialise, shuffled

POSITIONS = 80
CHUNKS = 16
MAX_DISTANCE = 31
SHINGLE = 3
#: Members of a group that are joined pair by pair; beyond, they meet in blocks of about BLOCK.
SMALL = 32
BLOCK = 1024

_rng = np.random.default_rng(4242)
_A = _rng.integers(0, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, POSITIONS, dtype=np.uint64)
_PLACE = _rng.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WEIGHT = _rng.integers(0, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _rng.integers(0, 2**63, POSITIONS, dtype=np.uint64)


def signatures(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """The documents that have tokens, and their signatures (one row of 16-bit minima each)."""
    n = len(s.hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros((0, POSITIONS), np.uint16)
    off = s.token_offsets()
    size = np.diff(off)
    has = np.flatnonzero(size)
    count = np.maximum(size[has] - SHINGLE + 1, 1)
    first = np.cumsum(count) - count
    at = np.arange(count.sum()) - np.repeat(first - off[has], count)
    end = np.repeat(off[has + 1], count)
    shingle = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        inside = at + k < end
        shingle += np.where(inside, s.hashes[np.minimum(at + k, n - 1)], np.uint64(0)) * _PLACE[k]
    shingle = mix64(shingle)
    out = np.empty((len(has), POSITIONS), np.uint16)
    for p in range(POSITIONS):
        least = np.minimum.reduceat(shingle * _A[p] + _B[p], first)
        out[:, p] = mix64(least) & np.uint64(0xFFFF)
    return has, out


def signature_column(text: Column) -> Column:
    @F.arrow_udf("binary")
    def sign(text: pa.Array) -> pa.Array:
        valid, parts = np.zeros(len(text), bool), [np.zeros((0, POSITIONS), np.uint16)]
        for s in slices(text, 1 << 20):
            has, sig = signatures(s)
            valid[has + s.first] = True
            parts.append(sig)
        return binary_rows(np.concatenate(parts).ravel(), valid * POSITIONS, valid).cast(pa.binary())

    return sign.asNondeterministic()(text)


def _matrix(sigs: pa.Array) -> np.ndarray:
    return flat_rows(sigs, np.uint16)[0].reshape(-1, POSITIONS)


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """For each signature, a key for every chunk and every position of it that may differ."""
    per = POSITIONS // CHUNKS
    value = sig.astype(np.uint64) * _WEIGHT
    whole = value.reshape(len(sig), CHUNKS, per).sum(axis=2, dtype=np.uint64)
    return mix64(np.repeat(whole, per, axis=1) - value + _SALT).view(np.int64)


def key_column(sig: Column) -> Column:
    @F.arrow_udf("array<bigint>")
    def keys(sig: pa.Array) -> pa.Array:
        flat = chunk_keys(_matrix(sig)).ravel()
        return pa.ListArray.from_arrays(np.arange(0, flat.size + 1, POSITIONS, dtype=np.int32), pa.array(flat))

    return keys(sig)


def distance_column(a: Column, b: Column) -> Column:
    @F.arrow_udf("int")
    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array((_matrix(a) != _matrix(b)).sum(axis=1).astype(np.int32))

    return distance(a, b)


def signed(docs: DataFrame) -> DataFrame:
    """(id, sig) of the documents that have an id and tokens; written, as several steps read it."""
    return materialise(docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), signature_column(F.col("text")).alias("sig")).filter("sig IS NOT NULL"), "signatures")


def postings(sigs: DataFrame) -> DataFrame:
    """(key, id): 80 rows for each signature, which Spark takes for one, so they must not be broadcast."""
    return shuffled(sigs.select(F.explode(key_column(F.col("sig"))).alias("key"), "id"))


def within(pairs: DataFrame, sigs: DataFrame, limit: int) -> DataFrame:
    """The pairs (a, b) whose signatures differ in at most ``limit`` positions, with the distance."""
    left = sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"))
    right = sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"))
    measured = pairs.join(left, "a").join(right, "b").select("a", "b", distance_column(F.col("sig_a"), F.col("sig_b")).alias("distance"))
    return measured.filter(F.col("distance") <= limit)


def _checked(limit: int) -> None:
    """One error a chunk is enumerated, which the pigeonhole principle makes enough up to this threshold."""
    if limit > 2 * CHUNKS - 1:
        raise ValueError(f"a threshold of {limit} would lose pairs: {CHUNKS} chunks with one error each hold up to {2 * CHUNKS - 1}")


def hamming_pairs(docs: DataFrame, limit: int = MAX_DISTANCE) -> DataFrame:
    """All pairs doc_id_a < doc_id_b within ``limit`` (at most 2 * CHUNKS - 1), with the distance."""
    _checked(limit)
    sigs = signed(docs).distinct()
    keys = postings(sigs)
    other = keys.select("key", F.col("id").alias("b"))
    candidates = keys.withColumnRenamed("id", "a").join(other, "key").filter("a < b").select("a", "b").distinct()
    return within(candidates, sigs, limit).groupBy(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b")).agg(F.min("distance").alias("distance"))


def _block_pairs(members: DataFrame) -> DataFrame:
    """Members (g, n, sig, ...) of large groups, each once for every pair of blocks (bi, bj) of its group that its block is in."""
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    own = members.withColumn("b", F.pmod(F.xxhash64("sig"), parts).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), parts - 1)))
    return own.withColumn("bi", F.least("b", "x")).withColumn("bj", F.greatest("b", "x")).drop("x")


def _near_in_blocks(pdf: pd.DataFrame, limit: int):
    """Yields (i, j), rows of pdf of blocks bi and bj whose signatures are within the limit, each pair once."""
    sig = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(len(pdf), POSITIONS)
    b, bi, bj = pdf["b"].to_numpy(), pdf["bi"].iloc[0], pdf["bj"].iloc[0]
    left, right = np.flatnonzero(b == bi), np.flatnonzero(b == bj)
    other = np.ascontiguousarray(sig[right].T)
    for at in range(0, len(left), 256):
        part = left[at : at + 256]
        same = np.zeros((len(part), len(right)), np.uint8)
        for p in range(POSITIONS):
            same += sig[part, p][:, None] == other[p][None, :]
        i, j = np.nonzero(same >= POSITIONS - limit)
        i, j = part[i], right[j]
        keep = i < j if bi == bj else np.ones(len(i), bool)
        if keep.any():
            yield i[keep], j[keep]


def _late_edges(mixed: DataFrame, limit: int) -> DataFrame:
    """(a, b) that connect whatever is within the limit in a bucket; mixed has g, n, id, root and sig."""
    few = mixed.filter(F.col("n") <= SMALL)
    mine, other = few.select("g", F.col("id").alias("a"), F.col("root").alias("root_a"), F.col("sig").alias("sig_a")), few.select("g", F.col("id").alias("b"), F.col("root").alias("root_b"), F.col("sig").alias("sig_b"))
    pairs = shuffled(mine).join(other, "g").filter("a < b AND root_a <> root_b").select("a", "b", distance_column(F.col("sig_a"), F.col("sig_b")).alias("d"))
    kind = dict(mixed.dtypes)["id"]

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        label, ids, root = np.arange(len(pdf)), pdf["id"].to_numpy(), pdf["root"].to_numpy()
        for i, j in _near_in_blocks(pdf, limit):
            apart = root[i] != root[j]
            local_roots(label, i[apart], j[apart])
        moved = np.flatnonzero(label != np.arange(len(pdf)))
        return pd.DataFrame({"a": ids[label[moved]], "b": ids[moved]})

    many = _block_pairs(mixed.filter(F.col("n") > SMALL)).groupBy("g", "bi", "bj").applyInPandas(join, f"a {kind}, b {kind}")
    return pairs.filter(F.col("d") <= limit).select("a", "b").unionByName(many)


def _connected(sigs: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The distinct signatures (sig, id: the smallest that has it), and (id, root) of every id that isn't the least of its group."""
    first = sigs.groupBy("sig").agg(F.min("id").alias("id"))
    single = materialise(first.select("id", "sig"), "distinct-signatures")
    alike = sigs.join(single.withColumnRenamed("id", "r"), "sig").filter("id <> r").select(F.col("r").alias("a"), F.col("id").alias("b"))
    alike = materialise(alike, "equal-signatures")
    keys = postings(single)
    # buckets of one member end here
    shared_keys = keys.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("key", "least")
    shared = materialise(keys.join(shared_keys, "key").select("key", "id", "least"), "buckets")
    stars = shared.filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    edges = materialise(within(stars, single, limit).select("a", "b").distinct(), "edges")
    labels = star_roots(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    named = shared.join(labels, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    open_keys = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).filter("low < high").select("key", "n")
    mixed = named.join(open_keys, "key").join(single, "id").select(F.col("key").alias("g"), "n", "id", "root", "sig")
    late = _late_edges(materialise(mixed, "open-buckets"), limit)
    ends = edges.unionByName(late).unionByName(alike)
    return single, star_roots(ends.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def near_groups(docs: DataFrame, limit: int = MAX_DISTANCE) -> DataFrame:
    """(id, root) of every document that is not the smallest of its group."""
    _checked(limit)
    return _connected(signed(docs), limit)[1]


def near_links(docs: DataFrame, limit: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id_a, doc_id_b, links_a, links_b): the smallest id of a class, each further document of it, and their links."""
    _checked(limit)
    sigs = materialise(signed(docs).distinct(), "distinct-rows")
    single, roots = _connected(sigs, limit)
    weight = sigs.groupBy("sig").agg(F.count("*").alias("w"))
    named = single.join(roots, "id", "left").select(F.coalesce("root", "id").alias("g"), "sig")
    sizes = named.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1")
    members = materialise(named.join(sizes, "g").join(weight, "sig").select("g", "n", "sig", "w"), "members")
    few = members.filter(F.col("n") <= SMALL)
    mine, other = (few.select("g", F.col("sig").alias(f"sig_{x}"), F.col("w").alias(f"w_{x}")) for x in "ab")
    pairs = mine.join(other, "g").filter("sig_a < sig_b").withColumn("d", distance_column(F.col("sig_a"), F.col("sig_b"))).filter(F.col("d") <= limit)
    both = pairs.select(F.explode(F.array(F.struct(F.col("sig_a").alias("sig"), F.col("w_b").alias("near")), F.struct(F.col("sig_b").alias("sig"), F.col("w_a").alias("near")))).alias("e")).select("e.*")

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        got, w = np.zeros(len(pdf)), pdf["w"].to_numpy(np.float64)
        for i, j in _near_in_blocks(pdf, limit):
            got += np.bincount(i, weights=w[j], minlength=len(pdf)) + np.bincount(j, weights=w[i], minlength=len(pdf))
        some = np.flatnonzero(got)
        return pd.DataFrame({"sig": pdf["sig"].iloc[some], "near": got[some].astype(np.int64)})

    many = _block_pairs(members.filter(F.col("n") > SMALL)).groupBy("g", "bi", "bj").applyInPandas(links, "sig binary, near bigint")
    near = both.unionByName(many).groupBy("sig").agg(F.sum("near").alias("near"))
    linked = weight.join(near, "sig", "left").filter("w > 1 OR near IS NOT NULL").select("sig", (F.col("w") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    counts = sigs.join(linked, "sig").groupBy("id").agg(F.sum("links").alias("links"))
    counts = materialise(counts, "link-counts")
    a, b = counts.select(F.col("id").alias("doc_id_a"), F.col("links").alias("links_a")), counts.select(F.col("id").alias("doc_id_b"), F.col("links").alias("links_b"))
    # a document may be in a class by its other text alone, so counts may be missing
    listed = roots.select(F.col("root").alias("doc_id_a"), F.col("id").alias("doc_id_b")).join(a, "doc_id_a", "left").join(b, "doc_id_b", "left")
    return listed.select("doc_id_a", "doc_id_b", F.coalesce("links_a", F.lit(0)).alias("links_a"), F.coalesce("links_b", F.lit(0)).alias("links_b"))


def near_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b): the document of a group that stays, and each one that goes."""
    return near_groups(docs).select(F.col("root").alias("doc_id_a"), F.col("id").alias("doc_id_b"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without those of near duplicates of a smaller id."""
    (name,) = unused(docs, "_near_id")
    gone = near_groups(docs).select(F.col("id").alias(name))
    return docs.join(gone, F.col("doc_id") == quoted(name), "left_anti")


def op4_multi_index_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document that has a near duplicate of a smaller id: its class, and both ends' links."""
    return near_links(table(spark, sf_dir, "documents"))
