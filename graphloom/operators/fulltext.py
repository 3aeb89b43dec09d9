"""Full-text search over text columns: BM25, phrases, fuzzy and phonetic terms."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.phonetics import metaphone, soundex, stem
from graphloom.storage import fresh_path, materialise

K1, B = 1.2, 0.75
SOUNDS = {"soundex": soundex, "metaphone": metaphone}
BREAK = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK, -1), lambda t: t != "")


def terms_of(query: str) -> list[str]:
    return [t for t in re.split(r"[^\w]+|_+", query.lower()) if t]


@dataclass
class Parsed:
    """A query: terms and phrases of which any counts, those that must occur, and those that must not."""

    any_of: list[list[str]] = field(default_factory=list)
    all_of: list[list[str]] = field(default_factory=list)
    none_of: list[list[str]] = field(default_factory=list)


def parse_query(query: str) -> Parsed:
    """Words and "phrases", joined by OR unless AND or + says otherwise; - and NOT exclude."""
    p, must_next, not_next = Parsed(), False, False
    pieces = re.findall(r'([+-]?)(?:"([^"]*)"|(\S+))', query)
    for k, (mark, phrase, word) in enumerate(pieces):
        if word in ("AND", "OR", "NOT"):
            if word == "AND" and p.any_of:
                p.all_of.append(p.any_of.pop())
            must_next, not_next = word == "AND", word == "NOT"
            continue
        words = terms_of(phrase or word)
        if words:
            (p.none_of if mark == "-" or not_next else p.all_of if mark == "+" or must_next else p.any_of).append(words)
        must_next = not_next = False
    return p


def _spaced(text: Column, stop: set[str]) -> Column:
    """The tokens in one string, each with a space of its own before and after it, so that counting needs no arrays."""
    if stop:
        return F.concat(F.lit(" "), F.array_join(F.filter(tokens(text), lambda t: ~t.isin(sorted(stop))), "  "), F.lit(" "))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), BREAK, "  ")), F.lit(" "))


def _holds(words: list[str]) -> Column:
    """Whether the tokens have these words one after the other."""
    return F.contains("t", F.lit(f" {'  '.join(words)} "))


def _bytes_of(what: str) -> Column:
    """How many bytes of the tokens' string are occurrences of a string."""
    return F.octet_length("t") - F.octet_length(F.replace(F.col("t"), F.lit(what)))


def _times(word: str) -> Column:
    return F.floor(_bytes_of(f" {word} ") / (len(word.encode()) + 2)).cast("int")


def search(docs: DataFrame, query: str, k: int | None = 10, stop_words: list[str] | None = None) -> DataFrame:
    """(id, score) of docs (id, text) by BM25, best first.

    The texts are read and tokenised once and in place: term counts need no shuffle, and the statistics of the
    corpus are one row. (Where many queries are asked, ``build_index`` keeps an index that ``index_search`` reads.)
    """
    parsed = parse_query(query)
    stop = set(stop_words or [])
    words = sorted({w for group in parsed.any_of + parsed.all_of for w in group} - stop)
    held = docs.select("id", _spaced(F.col("text"), stop).alias("t"))
    length = F.when(F.col("t") == "  ", F.lit(0)).otherwise(F.floor(_bytes_of(" ") / 2)).cast("int")
    hits = [_holds([w for w in g if w not in stop] or g) for g in parsed.any_of]
    want = F.lit(not parsed.any_of or bool(parsed.all_of))
    for h in hits:
        want = want | h
    for g in parsed.all_of:
        want = want & _holds(g)
    for g in parsed.none_of:
        want = want & ~_holds(g)
    # a few numbers a document, kept: the statistics and the scores both follow from them
    counted = materialise(held.select("id", length.alias("dl"), want.alias("want"), *[_times(w).alias(f"tf{i}") for i, w in enumerate(words)]), "term-counts")
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(words))])
    score = F.lit(0.0)
    for i in range(len(words)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log1p((F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    found = counted.filter("want").crossJoin(F.broadcast(stats)).select("id", score.alias("score"))
    return found if k is None else found.orderBy(F.desc("score"), "id").limit(k)


def postings(docs: DataFrame) -> DataFrame:
    """(term, id, tf, positions) of docs (id, text): the index to write and search by term."""
    return docs.select("id", F.posexplode(tokens(F.col("text"))).alias("pos", "term")).groupBy("term", "id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def _swapped(word: str, most: int) -> dict[str, int]:
    """The word with up to ``most`` neighbouring letters swapped, and with how many."""
    found, last = {word: 0}, {word}
    for n in range(1, most + 1):
        last = {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for w in last for i in range(len(w) - 1)} - found.keys()
        found |= dict.fromkeys(last, n)
    return found


def edits(term: Column, word: str, most: int) -> Column:
    """The number of edits (letters put in, left out, replaced, or neighbours swapped) from a term to the word; NULL beyond ``most``."""
    parts = [F.levenshtein(term, F.lit(w), most - n) + n if n else F.levenshtein(term, F.lit(w), most) for w, n in _swapped(word, most).items()]
    near = [F.when(F.levenshtein(term, F.lit(w), most - n) >= 0, p) for p, (w, n) in zip(parts, _swapped(word, most).items(), strict=True)]
    least = near[0] if len(near) == 1 else F.least(*near)
    return F.when(F.length(term).between(len(word) - most, len(word) + most), least)


def _weights(term: Column, words: list[str], distance: int) -> Column:
    weight = F.lit(0.0)
    for w in words:
        weight = weight + F.coalesce(1.0 / (1 + edits(term, w, distance)), F.lit(0.0))
    return weight


def fuzzy(docs: DataFrame, query: str, k: int, distance: int = 1) -> DataFrame:
    """(id, score): for each query word, occurrences of words within the edit distance, nearer ones for more.

    A word is counted once a document, and its distance is taken only where its length allows a hit.
    """
    words = terms_of(query)
    seen = docs.select("id", F.explode(tokens(F.col("text"))).alias("term")).filter(" OR ".join(f"length(term) BETWEEN {len(w) - distance} AND {len(w) + distance}" for w in words) or "false")
    counted = seen.groupBy("id", "term").agg(F.count("*").alias("tf")).select("id", (F.col("tf") * _weights(F.col("term"), words, distance)).alias("w"))
    return counted.filter("w > 0").groupBy("id").agg(F.sum("w").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def phonetic(docs: DataFrame, word: str) -> DataFrame:
    """(id, hits): how many words of the text sound like the given one."""
    return docs.select("id", F.explode(tokens(F.col("text"))).alias("term")).filter(F.soundex("term") == F.soundex(F.lit(word))).groupBy("id").agg(F.count("*").alias("hits"))


#: Parts of an index by a hash of the term; a query reads only those of its own terms.
INDEX_PARTS = 64
#: Tokens that a task groups at once, and words whose stems it remembers.
SPAN = 1_000_000
#: Languages whose words have stems here.
STEMMED = ("english",)


@dataclass(frozen=True)
class TextIndex:
    """An index in the shared folder: documents (id, dl), the vocabulary (raw, term, part, and the codes of the raw
    term), and the postings (part, term, id, positions), each term sorted into its part."""

    documents: DataFrame
    vocabulary: DataFrame
    postings: DataFrame
    language: str | None
    phonetic: str | None
    deleted: DataFrame | None = None

    def delete(self, ids: DataFrame) -> TextIndex:
        """The index without some documents (id); its files stay as they are."""
        gone = ids.select("id") if self.deleted is None else self.deleted.unionByName(ids.select("id"))
        return replace(self, deleted=materialise(gone.distinct(), "deleted-documents"))

    def _live(self, df: DataFrame) -> DataFrame:
        return df if self.deleted is None else df.join(self.deleted, "id", "left_anti")


def _analysed(words: list[str], language: str | None) -> list[str]:
    return [stem(w) for w in words] if language in STEMMED else words


def _by_document(language: str | None):
    """Batches of (id, t: tokens) to (term, id, positions): a document's postings come from its own row, so that no token
    is sent anywhere by itself."""

    def run(batches):
        known: dict[str, str] = {}
        for batch in batches:
            t, ids = batch.column("t"), batch.column("id")
            ends = t.offsets.to_numpy()
            at = 0
            while at < len(batch):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + SPAN, side="right")) - 1)
                n = int(ends[to] - ends[at])
                if n:
                    words = t.values.slice(ends[at], n).dictionary_encode()
                    terms, code = words.dictionary, words.indices.to_numpy()
                    if language in STEMMED:
                        raw = terms.to_pylist()
                        new = [w for w in raw if w not in known]
                        known = known if len(known) + len(new) <= SPAN else {w: known[w] for w in raw if w in known}
                        known.update(zip(new, _analysed(new, language), strict=True))
                        stems = pa.array([known[w] for w in raw], pa.string()).dictionary_encode()
                        terms, code = stems.dictionary, stems.indices.to_numpy()[code]
                    each = np.diff(ends[at : to + 1])
                    doc = np.repeat(np.arange(to - at), each)
                    pos = np.arange(n) - np.repeat(ends[at:to] - ends[at], each)
                    key = doc * np.int64(len(terms)) + code
                    order = np.argsort(key, kind="stable")
                    first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
                    head = order[first]
                    places = pa.ListArray.from_arrays(np.r_[first, n].astype(np.int32), pa.array(pos[order].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([terms.take(pa.array(code[head])), ids.take(pa.array(doc[head] + at)), places], names=["term", "id", "positions"])
                at = to

    return run


def analyse(term: Column, language: str | None, sound: str | None) -> Column:
    """Struct (term, code) of a raw term: its stem, if there is a stemmer for the language, and its sound."""

    @F.arrow_udf("struct<term: string, code: string>")
    def run(raw: pa.Array) -> pa.Array:
        words = raw.to_pylist()
        codes = [SOUNDS[sound](w) or None for w in words] if sound else [None] * len(words)
        return pa.StructArray.from_arrays([pa.array(_analysed(words, language), pa.string()), pa.array(codes, pa.string())], names=["term", "code"])

    return run(term)


def build_index(docs: DataFrame, language: str | None = None, sound: str | None = None) -> TextIndex:
    """Writes the index of docs (id, text): tokens, without the language's stop words, stemmed once for each distinct term.

    ``sound`` is soundex or metaphone: query words then also find words of the same sound.
    """
    if sound is not None and sound not in SOUNDS:
        raise ValueError(f"unknown sound code {sound}")
    stop = stop_words(language) if language else []
    held = docs.select("id", tokens(F.col("text")).alias("t"))
    if stop:
        held = held.withColumn("t", F.filter("t", lambda t: ~t.isin(sorted(stop))))
    documents = materialise(held.select("id", F.size("t").alias("dl")), "text-documents")
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(INDEX_PARTS)).cast("int")
    by_document = held.mapInArrow(_by_document(language), f"term string, id {dict(held.dtypes)['id']}, positions array<int>").withColumn("part", part("term"))
    path = fresh_path(docs.sparkSession, "postings")
    # salted, so that a part with a very frequent term is several files, written by several tasks
    by_document.repartition("part", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("part", "term").write.partitionBy("part").parquet(path)
    postings = docs.sparkSession.read.schema(by_document.schema).parquet(path)
    # only where words have stems do the texts tell more of the vocabulary than the postings
    raw = held.select(F.explode("t").alias("raw")) if language in STEMMED else postings.select(F.col("term").alias("raw"))
    words = raw.distinct().withColumn("a", analyse(F.col("raw"), language, sound)).select("raw", "a.term", "a.code", part("a.term").alias("part"))
    return TextIndex(documents, materialise(words, "vocabulary"), postings, language, sound)


def _read(index: TextIndex, terms: list[str]) -> DataFrame:
    """The postings of some terms, of live documents: the parts of other terms are not read."""
    parts = index.vocabulary.filter(F.col("term").isin(terms)).select("part").distinct()
    known = [r.part for r in parts.collect()]
    return index._live(index.postings.filter(F.col("part").isin(known) & F.col("term").isin(terms)))


def _less(n: int):
    return lambda x: x - n


def index_search(index: TextIndex, query: str, k: int | None = 10) -> DataFrame:
    """(id, score) by BM25 over the stored postings, best first; the same as ``search`` where no word is stemmed.

    Phrases are found by their positions. With a sound code, a word stands for all words of its sound, too.
    """
    parsed = parse_query(query)
    stop = set(stop_words(index.language)) if index.language else set()
    clean = lambda groups: [g for g in (_analysed([w for w in ws if w not in stop], index.language) for ws in groups) if g]
    any_of, all_of, none_of = clean(parsed.any_of), clean(parsed.all_of), clean(parsed.none_of)
    words = sorted({w for g in any_of + all_of for w in g})
    asked = sorted({w for g in any_of + all_of + none_of for w in g})
    alike = {w: {w} for w in asked}
    if index.phonetic and asked:
        codes = {w: SOUNDS[index.phonetic](w) for w in asked}
        # the vocabulary's words of the same sound come to the driver: a query has few words
        for r in index.vocabulary.filter(F.col("code").isin(sorted(set(codes.values()) - {""}))).select("term", "code").distinct().collect():
            for w in asked:
                if codes[w] == r.code:
                    alike[w].add(r.term)
    rows = _read(index, sorted(set().union(*alike.values()))) if asked else index.postings.filter("false")
    sums = [F.coalesce(F.sum(F.when(F.col("term").isin(sorted(alike[w])), F.size("positions"))), F.lit(0)).alias(f"tf{i}") for i, w in enumerate(words)]
    places = [F.sort_array(F.flatten(F.collect_list(F.when(F.col("term").isin(sorted(alike[w])), F.col("positions"))))).alias(f"at{i}") for i, w in enumerate(asked)]
    found = rows.groupBy("id").agg(*sums, *places) if words else rows.groupBy("id").agg(*places) if places else rows.select("id").distinct()

    def holds(group: list[str]) -> Column:
        at = F.col(f"at{asked.index(group[0])}")
        for n, w in enumerate(group[1:], 1):
            at = F.array_intersect(at, F.transform(F.col(f"at{asked.index(w)}"), _less(n)))
        return F.size(at) > 0

    want = F.lit(not any_of or bool(all_of)) if words else F.lit(False)
    for g in any_of:
        want = want | holds(g)
    for g in all_of:
        want = want & holds(g)
    for g in none_of:
        want = want & ~holds(g)
    live = index._live(index.documents)
    stats = live.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    if words:
        stats = stats.crossJoin(found.agg(*[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(words))]))
    score = F.lit(0.0)
    for i in range(len(words)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        score = score + F.log1p((F.col("n") - df + 0.5) / (df + 0.5)) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    out = found.filter(want).join(live, "id").crossJoin(F.broadcast(stats)).select("id", score.alias("score"))
    return out if k is None else out.orderBy(F.desc("score"), "id").limit(k)


def index_fuzzy(index: TextIndex, query: str, k: int, distance: int = 1) -> DataFrame:
    """(id, score) as ``fuzzy``: the distances are taken over the vocabulary, and only the hits' postings are read."""
    words = terms_of(query)
    near = index.vocabulary.withColumn("w", _weights(F.col("raw"), words, distance)).filter("w > 0").groupBy("part", "term").agg(F.max("w").alias("w"))
    near = materialise(near, "near-terms")
    parts = [r.part for r in near.select("part").distinct().collect()]
    hits = index._live(index.postings.filter(F.col("part").isin(parts))).join(near, ["part", "term"])
    return hits.groupBy("id").agg(F.sum(F.col("w") * F.size("positions")).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def naive(docs: DataFrame, query: str, k: int = 50) -> DataFrame:
    """(id, score) of docs (id, title, body): 1 and 0.5 for the whole query, 0.3 and 0.1 for each of its words."""
    q, title, body = query.lower(), F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("body", F.lit("")))
    yes = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    score = yes(title.contains(q), 1.0) + yes(body.contains(q), 0.5)
    for w in q.split():
        score = score + yes(title.contains(w), 0.3) + yes(body.contains(w), 0.1)
    return docs.select("id", F.round(score, 6).alias("score")).filter("score > 0").orderBy(F.desc("score"), "id").limit(k)


LANGUAGES = ["danish", "dutch", "english", "finnish", "french", "german", "hungarian", "italian", "norwegian", "portuguese", "russian", "spanish", "swedish", "turkish"]


def stop_words(language: str) -> list[str]:
    from pyspark.ml.feature import StopWordsRemover

    if language not in LANGUAGES:
        return []
    return StopWordsRemover.loadDefaultStopWords(language)
