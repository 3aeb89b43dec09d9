"""Operator 8: line dedup through a deletion-neighbourhood join.

Lines are compared by their words. Of all lines, those that an earlier line (by doc_id, then line number) equals are
taken out, and of lines of at least ``MIN_WORDS`` words also those within one word edit (a word replaced, added or
removed) of an earlier one of such length; the earliest stays. Equality needs no variants and is safe from one word
on (``EQUAL_WORDS``), while one edit of a short line is often another line: that is what ``MIN_WORDS`` is for.

1. Equal lines meet by a 128-bit hash; all but the first occurrence go. Shorter lines take part in this step only.
2. A line within one edit of another shares one of its halves with it, so a first occurrence none of whose
   halves (for its own length and for one word less) is shared has no partner. The shared halves are broadcast as a
   bitmap while there are at most ``MOST_SHARED`` of them, 32 bits or more each; beyond, they are joined. Both are exact:
   what a bitmap lets through in vain costs time, never results.
3. Each remaining line emits every variant with one word deleted as a hashed key; equal variants meet.
   Lines that lost the word at the same place are one replacement apart; a line that equals a variant of
   another is one word shorter. Of each group only the earliest is taken as the witness of the others; it is found by
   an aggregation and joined back, so groups cost in proportion to their size and none has to meet in one task.
4. Each pair with a witness is verified by edit distance over the words.

``spare_copies`` leaves documents whole that are near duplicates, by the signatures of operator 4, of *one* earlier document
whose lines they repeat: these are for near-dedup to take out; cut, they would be fragments that nothing recognises.
Only pairs that share ``COPY_SHARE`` of the words of both in such lines and differ at most twofold in length are looked at.
Lines that repeat within such a document still go.

Defined results: empty and blank lines are left alone. A document that loses all its words goes;
one that had none (NULL or empty text) stays as it is. Rows with the same id and text are one document and are
edited alike; a NULL id counts as earliest, and of rows with one id but different texts the one of the smaller
text hash is earlier. Ids of any type that can be ordered will do. Lines and texts of any length are worked on whole.
An empty table gives no rows. Other columns pass through ``without_repeats`` as they are, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import minhash
from graphloom.llm.common import quoted, table, unused
from graphloom.llm.tokens import _POWER, Slice, binary_rows, flat_rows, mix64, slices
from graphloom.storage import materialise

MIN_WORDS = 8
EQUAL_WORDS = 1
COPY_SHARE = 0.05
MOST_SHARED = 1 << 25
LEAST_BITS = 27

_P1, _P2 = _POWER, mix64(_POWER)
_HALVES = np.uint64(0x5851F42D4C957F2D)


def _at(power: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return power[pos & 0xFFFF]


class Lines:
    """The lines of a slice that have at least ``min_words`` words."""

    def __init__(self, s: Slice, min_words: int):
        self.h = s.hashes
        breaks = np.flatnonzero(s.buf == 10)
        ahead = np.searchsorted(s.starts, breaks)
        line = np.cumsum(np.bincount(ahead, minlength=len(s.starts) + 1)[: len(s.starts)]) - np.searchsorted(breaks, s.offsets[:-1])[s.doc]
        new = np.ones(len(self.h), bool)
        new[1:] = (s.doc[1:] != s.doc[:-1]) | (line[1:] != line[:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(self.h)))
        self.pos = np.arange(len(self.h)) - np.repeat(first, n)
        self.left = np.repeat(n, n) - 1 - self.pos
        keep = n >= min_words
        self.first, self.n = first[keep], n[keep]
        self.doc = s.doc[self.first] + s.first
        self.line = line[self.first]

    def _sums(self, values: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for power in (_P1, _P2):
            c = self._sums(self.h * _at(power, self.pos))
            out.append(mix64(c[self.first + self.n] - c[self.first]))
        return out[0], out[1]

    def halves(self) -> np.ndarray:
        """Four keys a line: its first and last half, cut as in lines of its length and of one word less."""
        forth, back = self._sums(self.h * _at(_P1, self.pos)), self._sums(self.h * _at(_P1, self.left))
        keys = []
        for less in (0, 1):
            size = self.n - less
            head, salt = size // 2, (size * 2).astype(np.uint64) * _HALVES
            end = self.first + self.n
            keys.append(mix64(forth[self.first + head] - forth[self.first] + salt))
            keys.append(mix64(back[end] - back[end - (size - head)] + salt + _HALVES))
        return np.stack(keys, axis=1)


def _spans(ends: np.ndarray, most: int):
    """Ranges of rows with about ``most`` items each; a longer row is a range of its own."""
    at = 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield at, to
        at = to


def variants(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, roles, line) over all lines: role 0 a line without the word at a place, 1 without any one word, 2 whole."""
    n = np.diff(ends)
    first, line = np.repeat(ends[:-1], n), np.repeat(np.arange(len(n)), n)
    pos, size = np.arange(len(words)) - first, np.repeat(n, n).astype(np.uint64)
    here = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _at(_P1, pos), dtype=np.uint64)])
    moved = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(pos > 0, words * _at(_P1, pos - 1), np.uint64(0)), dtype=np.uint64)])
    at = np.arange(len(words))
    gone = here[at] - here[first] + moved[np.repeat(ends[1:], n)] - moved[at + 1]
    same_place = mix64(gone + mix64(pos.astype(np.uint64) * np.uint64(2) + np.uint64(1) + (size << np.uint64(32))))
    any_place = mix64(gone ^ mix64((size - np.uint64(1)) * _HALVES))
    whole = mix64((here[ends[1:]] - here[ends[:-1]]) ^ mix64(n.astype(np.uint64) * _HALVES))
    roles = np.repeat(np.array([0, 1, 2], np.int8), [len(words), len(words), len(n)])
    return np.concatenate([same_place, any_place, whole]), roles, np.concatenate([line, line, np.arange(len(n))])


def within_one(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Whether each pair of word sequences is at most one edit apart: what they have in common at the front and at
    the back leaves at most one word of either."""
    n, m = np.diff(a_ends), np.diff(b_ends)
    long, short = np.maximum(n, m), np.minimum(n, m)
    out = (long - short <= 1) & (long <= 1)
    rows = np.flatnonzero((long - short <= 1) & (short > 0))
    if not len(rows):
        return out
    size = short[rows]
    first = np.cumsum(size) - size
    k = np.arange(size.sum()) - np.repeat(first, size)
    most = np.repeat(size, size)
    forth = a[np.repeat(a_ends[rows], size) + k] == b[np.repeat(b_ends[rows], size) + k]
    back = a[np.repeat(a_ends[rows + 1], size) - 1 - k] == b[np.repeat(b_ends[rows + 1], size) - 1 - k]
    common = np.minimum.reduceat(np.where(forth, most, k), first) + np.minimum.reduceat(np.where(back, most, k), first)
    out[rows] = common >= long[rows] - 1
    return out


POS = ["doc_id", "th", "line"]


def _doc_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").alias("text"))


def _pos_schema(rows: DataFrame) -> str:
    return f"doc_id {dict(rows.dtypes)['doc_id']}, th bigint, line int"


def _positions(batch: pa.RecordBatch, at: pa.Array, line: np.ndarray) -> list[pa.Array]:
    return [batch.column("doc_id").take(at), batch.column("th").take(at), pa.array(line.astype(np.int32))]


def _line_hashes(equal_words: int):
    """Positions, numbers of words and hashes of lines."""

    def run(batches):
        for batch in batches:
            for s in slices(batch.column("text")):
                x = Lines(s, equal_words)
                h1, h2 = x.hashes()
                yield pa.RecordBatch.from_arrays([*_positions(batch, pa.array(x.doc), x.line), pa.array(x.n.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=[*POS, "n", "h1", "h2"])

    return run


def _half_keys(min_words: int, placed: bool):
    """The four half keys of every line with the line's hash, or with its position."""

    def run(batches):
        for batch in batches:
            for s in slices(batch.column("text")):
                x = Lines(s, min_words)
                keys = pa.array(x.halves().ravel().view(np.int64))
                if placed:
                    yield pa.RecordBatch.from_arrays([*_positions(batch, pa.array(np.repeat(x.doc, 4)), np.repeat(x.line, 4)), keys], names=[*POS, "key"])
                else:
                    yield pa.RecordBatch.from_arrays([keys, pa.array(np.repeat(x.hashes()[0], 4).view(np.int64))], names=["key", "h1"])

    return run


def _words_of(x: Lines, which: np.ndarray) -> pa.Array:
    n = x.n[which]
    return binary_rows(x.h[np.repeat(x.first[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n).cast(pa.binary())


def _possible_lines(shipped, bits: int, min_words: int):
    """The lines with a half that the bitmap marks, with the fingerprints of their words."""

    def run(batches):
        marks = None
        for batch in batches:
            if marks is None:
                marks = np.frombuffer(shipped.value, np.uint64)
            for s in slices(batch.column("text")):
                x = Lines(s, min_words)
                slot = x.halves() >> np.uint64(64 - bits)
                hit = np.flatnonzero(((marks[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)).any(axis=1))
                if len(hit):
                    h1, h2 = x.hashes()
                    yield pa.RecordBatch.from_arrays([*_positions(batch, pa.array(x.doc[hit]), x.line[hit]), pa.array(h1[hit].view(np.int64)), pa.array(h2[hit].view(np.int64)), _words_of(x, hit)], names=[*POS, "h1", "h2", "words"])

    return run


def _named_lines(min_words: int):
    """The lines whose numbers ``lines`` holds, with their hashes and the fingerprints of their words."""

    def run(batches):
        for batch in batches:
            wanted = batch.column("lines")
            for s in slices(batch.column("text")):
                x = Lines(s, min_words)
                own = wanted.slice(s.first, s.docs)
                size = np.diff(own.offsets.to_numpy())
                asked = (np.repeat(np.arange(s.docs) + s.first, size) << 32) | own.flatten().to_numpy(zero_copy_only=False)
                hit = np.flatnonzero(np.isin((x.doc << 32) | x.line, asked))
                h1, h2 = x.hashes()
                yield pa.RecordBatch.from_arrays([*_positions(batch, pa.array(x.doc[hit]), x.line[hit]), pa.array(h1[hit].view(np.int64)), pa.array(h2[hit].view(np.int64)), _words_of(x, hit)], names=[*POS, "h1", "h2", "words"])

    return run


def _emit(batches, most: int = 100_000):
    for batch in batches:
        words, ends = flat_rows(batch.column("words"))
        for at, to in _spans(ends, most):
            keys, roles, line = variants(words[ends[at] : ends[to]], ends[at : to + 1] - ends[at])
            of = pa.array(line + at)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(roles), *(batch.column(c).take(of) for c in POS)], names=["key", "role", *POS])


def _bitmap(shared: DataFrame, bits: int) -> bytes:
    """One bit for each shared half: 2 ** bits in all, of which one in 32 is set at most."""
    word = shared.select(F.expr(f"cast(shiftrightunsigned(key, {64 - bits + 6}) as int)").alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - bits}) & 63 as int))").alias("b"))
    got = word.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    if got.num_rows:
        out[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return out.tobytes()


def _candidates(rows: DataFrame, firsts: DataFrame, min_words: int) -> DataFrame:
    """Positions and words of the first occurrences that share a half with another line."""
    keys = rows.mapInArrow(_half_keys(min_words, False), "key bigint, h1 bigint")
    halves = keys.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high"))
    shared = materialise(halves.filter("low < high").select("key"), "shared-halves")
    count = shared.count()
    schema = f"{_pos_schema(rows)}, h1 bigint, h2 bigint, words binary"
    if count <= MOST_SHARED:
        bits = max(LEAST_BITS, (32 * count).bit_length())
        possible = rows.mapInArrow(_possible_lines(rows.sparkSession.sparkContext.broadcast(_bitmap(shared, bits)), bits, min_words), schema)
    else:
        placed = rows.mapInArrow(_half_keys(min_words, True), f"{_pos_schema(rows)}, key bigint")
        marked = placed.join(shared, "key", "left_semi").groupBy(F.col("doc_id").alias("m_doc"), F.col("th").alias("m_th")).agg(F.sort_array(F.collect_set("line")).alias("lines"))
        own = rows.join(marked, F.col("doc_id").eqNullSafe(F.col("m_doc")) & F.col("th").eqNullSafe(F.col("m_th"))).select("doc_id", "th", "text", "lines")
        possible = own.mapInArrow(_named_lines(min_words), schema)
    only = firsts.select("h1", "h2", F.col("p.doc_id").alias("f_doc"), F.col("p.th").alias("f_th"), F.col("p.line").alias("f_line"))
    first = F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("th") == F.col("f_th")) & (F.col("line") == F.col("f_line"))
    return materialise(possible.join(only, ["h1", "h2"]).filter(first).select(*POS, "words").dropDuplicates(POS), "candidate-lines")


def _verified(candidates: DataFrame) -> DataFrame:
    """(y, x, n): each candidate that is one edit from an earlier one, that one, and the words of y."""
    pos = F.struct(*POS)
    emitted = candidates.repartition("th", "line").mapInArrow(_emit, f"key bigint, role tinyint, {_pos_schema(candidates)}")
    # most variants are nobody else's: keys alone tell which are shared, so that only those carry positions further. A key
    # connects lines that lost a word at one place (role 0), or one that lost any word (1) with a whole one (2)
    meets = "c > 1 AND ((roles & 1) = 1 OR (roles & 6) = 6)"
    shared = emitted.groupBy("key").agg(F.count("*").alias("c"), F.bit_or(F.expr("shiftleft(1, cast(role AS int))")).alias("roles")).filter(meets).select("key")
    kept = materialise(emitted.join(materialise(shared, "shared-variants"), "key", "left_semi"), "variants")
    groups = kept.groupBy("key").agg(*[F.min(F.when(F.col("role") == r, pos)).alias(f"r{r}") for r in range(3)])
    witness = F.when(F.col("role") == 0, F.col("r0")).when(F.col("role") == 1, F.col("r2")).otherwise(F.col("r1"))
    pairs = kept.join(groups, "key").select(pos.alias("y"), witness.alias("x")).filter("x < y").distinct()
    mine = candidates.select(F.struct(*POS).alias("my"), F.col("words").alias("w_y"))
    theirs = candidates.select(F.struct(*POS).alias("tx"), F.col("words").alias("w_x"))
    # ids may be NULL, so equality is null-safe
    near = pairs.join(mine, F.col("y").eqNullSafe(F.col("my"))).join(theirs, F.col("x").eqNullSafe(F.col("tx")))
    return near.filter(_one_edit(F.col("w_x"), F.col("w_y"))).select("y", "x", (F.octet_length("w_y") / 8).cast("int").alias("n"))


def _one_edit(a: Column, b: Column) -> Column:
    @F.arrow_udf("boolean")
    def near(a: pa.Array, b: pa.Array) -> pa.Array:
        x, x_ends = flat_rows(a)
        y, y_ends = flat_rows(b)
        out = np.zeros(len(a), bool)
        for at, to in _spans(x_ends, 1 << 20):
            out[at:to] = within_one(x[x_ends[at] : x_ends[to]], x_ends[at : to + 1] - x_ends[at], y[y_ends[at] : y_ends[to]], y_ends[at : to + 1] - y_ends[at])
        return pa.array(out)

    return near(a, b)


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, equal_words: int = EQUAL_WORDS, spare_copies: bool = False) -> DataFrame:
    """(doc_id, th, line) of the lines to take out; th is the hash of the document's text.

    ``equal_words``: from how many words on equal lines go; ``min_words``: those within one edit.
    """
    rows = _doc_rows(docs)
    equal_words = min(equal_words, min_words)
    lines = materialise(rows.mapInArrow(_line_hashes(equal_words), f"{_pos_schema(rows)}, n int, h1 bigint, h2 bigint"), "lines")
    pos = F.struct(*POS)
    firsts = materialise(lines.groupBy("h1", "h2").agg(F.min(pos).alias("p"), F.count("*").alias("c")), "first-lines")
    again = lines.select("h1", "h2", "n", pos.alias("y")).join(firsts.filter("c > 1").select("h1", "h2", F.col("p").alias("x")), ["h1", "h2"]).filter(~F.col("y").eqNullSafe(F.col("x"))).select("y", "x", "n")
    found = again.unionByName(_verified(_candidates(rows, firsts, min_words)))
    if not spare_copies:
        return found.select("y.*").distinct()
    found = materialise(found.groupBy("y").agg(F.min("x").alias("x"), F.max("n").alias("n")), "repeated-lines")
    doc = lambda p, a: F.struct(F.col(f"{p}.doc_id").alias("d"), F.col(f"{p}.th").alias("t")).alias(a)
    # repeated rows are one document; their lines are in ``lines`` once for each
    sizes = lines.dropDuplicates(POS).groupBy(F.struct(F.col("doc_id").alias("d"), F.col("th").alias("t")).alias("doc")).agg(F.sum("n").alias("words"))
    shared = found.select(doc("y", "a"), doc("x", "b"), "n").filter("NOT a <=> b").groupBy("a", "b").agg(F.sum("n").alias("n"))
    mine, theirs = sizes.select(F.col("doc").alias("da"), F.col("words").alias("wa")), sizes.select(F.col("doc").alias("db"), F.col("words").alias("wb"))
    both = shared.join(mine, F.col("a").eqNullSafe(F.col("da"))).join(theirs, F.col("b").eqNullSafe(F.col("db")))
    like = (F.col("n") >= COPY_SHARE * (F.col("wa") + F.col("wb") - F.col("n"))) & (2 * F.least("wa", "wb") >= F.greatest("wa", "wb"))
    tried = materialise(both.filter(like).select("a", "b"), "copy-pairs")
    ends = tried.select(F.explode(F.array("a", "b")).alias("end")).distinct()
    text = rows.join(ends, (F.col("doc_id").eqNullSafe(F.col("end.d"))) & (F.col("th") == F.col("end.t")), "left_semi").dropDuplicates(["doc_id", "th"])
    signed = materialise(text.select(F.struct(F.col("doc_id").alias("d"), F.col("th").alias("t")).alias("doc"), minhash.signature_column(F.col("text")).alias("sig")).filter("sig IS NOT NULL"), "copy-signatures")
    mine, theirs = (signed.select(F.col("doc").alias(f"d{x}"), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    near = tried.join(mine, F.col("a").eqNullSafe(F.col("da"))).join(theirs, F.col("b").eqNullSafe(F.col("db")))
    far = minhash.distance_column(F.col("sig_a"), F.col("sig_b"))
    whole = near.select("a", far.alias("far")).filter(F.col("far") <= minhash.MAX_DISTANCE).select(F.col("a").alias("copy")).distinct()
    other = found.withColumn("a", doc("y", "a")).withColumn("b", doc("x", "b"))
    own, foreign = other.filter("a <=> b"), other.filter("NOT a <=> b").join(whole, F.col("a").eqNullSafe(F.col("copy")), "left_anti")
    return own.select("y.*").unionByName(foreign.select("y.*"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, removed: str | None = None, equal_words: int = EQUAL_WORDS, spare_copies: bool = False) -> DataFrame:
    """docs with repeated lines taken out of text (and n_chars brought up to date, if there is such a column);
    ``removed`` names a column for the number of lines taken out."""
    key, doc, th, drop, left = unused(docs, "_key", "_doc", "_th", "_drop", "_left")
    drops = repeats(docs, min_words, equal_words, spare_copies).groupBy(F.col("doc_id").alias(doc), F.col("th").alias(th)).agg(F.sort_array(F.collect_list("line")).alias(drop))
    own = docs.withColumn(key, F.xxhash64("text"))
    both = own.join(drops, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(th)), "left")
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(drop, i))
    text = F.when(F.col(drop).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = both.withColumn(left, text).filter(F.col(drop).isNull() | F.col(left).rlike(r"\S"))
    columns = []
    for c in docs.columns:
        new = F.when(F.col(drop).isNull(), quoted(c)).otherwise(F.length(left).cast("bigint")) if c == "n_chars" else F.col(left) if c == "text" else quoted(c)
        columns.append(new.alias(c))
    if removed:
        columns.append(F.coalesce(F.size(drop), F.lit(0)).alias(removed))
    return out.select(*columns)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text and the number of lines taken out of every document that has words left."""
    return without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), removed="lines_removed")


SQL = f"""
WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents),
l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM s),
w AS (SELECT doc_id, i, line, regexp_extract_all(line, '\\S+') AS w FROM l),
k AS (SELECT doc_id::HUGEINT * 1000000000 + i AS pos, w, len(w) AS n, array_to_string(w, ' ') AS t FROM w WHERE len(w) >= {EQUAL_WORDS}),
f AS (SELECT t, n, any_value(w) AS w, min(pos) AS pos FROM k WHERE n >= {MIN_WORDS} GROUP BY t, n),
e AS (SELECT t, min(pos) AS pos FROM k GROUP BY t),
v AS (SELECT pos, n, u.i, array_to_string(list_concat(w[:u.i - 1], w[u.i + 1:]), ' ') AS del FROM f, LATERAL (SELECT unnest(range(1, n + 1)) AS i) u),
r AS (SELECT pos FROM (SELECT pos, min(pos) OVER (PARTITION BY n, i, del) AS m FROM v) WHERE m < pos),
x AS (SELECT greatest(v.pos, f.pos) AS pos FROM v JOIN f ON f.n = v.n - 1 AND f.t = v.del),
g AS (SELECT k.pos FROM k JOIN e ON e.t = k.t WHERE k.pos <> e.pos UNION SELECT pos FROM r UNION SELECT pos FROM x),
o AS (SELECT l.doc_id, string_agg(CASE WHEN g.pos IS NULL THEN line END, chr(10) ORDER BY l.i) AS text, count(g.pos)::INT AS lines_removed
      FROM l LEFT JOIN g ON g.pos = l.doc_id::HUGEINT * 1000000000 + l.i GROUP BY l.doc_id)
SELECT doc_id, text, lines_removed FROM o WHERE lines_removed = 0 OR regexp_matches(text, '\\S')
"""
