"""Operator 6: token counts of documents, counting each distinct pre-token once.

A byte-pair tokenizer first splits text into pre-tokens and then merges bytes within each, so a document's
token count is the sum, over its pre-tokens, of frequency times pieces. The distinct pre-tokens of the corpus
are collected, the pieces of each are counted once, and the counts are joined to the per-document pre-token
frequencies and summed. Token ids are never kept.

The join is split by how common a pre-token is. The ``hot`` most frequent ones (a fixed number, so what is
broadcast does not grow with the corpus) are joined within the scan; only the frequencies of the others are
shuffled, to meet the counts of the rest of the vocabulary. Both parts are exact.

Defined results: NULL and empty texts have 0 tokens. Texts of any length are split whole. A NULL id, and ids
that are repeated, keep a row for each row of the input, as the sums are by row, not by id. An empty table
gives no rows. Only the id and the text are read.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import table
from graphloom.storage import materialise

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split of byte-level vocabularies of this kind; (?U) makes \s Unicode's white space in Java.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HOT = 1_000_000


def pre_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + PATTERN), F.lit(0))


@lru_cache(maxsize=2)
def _built(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding(hashlib.md5(vocabulary).hexdigest(), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoding(path: str):
    with open(path, "rb") as f:
        return _built(f.read())


def piece_counter(spark: SparkSession, path: str):
    """A column function: pieces of one pre-token each. The vocabulary (about 1 MB) is read in the driver and sent along,
    so the path need not be there where tasks run."""
    with open(path, "rb") as f:
        shipped = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("int")
    def pieces(piece: pd.Series) -> pd.Series:
        bpe = _built(shipped.value)._core_bpe
        return pd.Series([len(bpe.encode_single_piece(p.encode())) for p in piece], dtype="int32")

    return pieces


def _flat(batch: pa.RecordBatch, name: str) -> tuple[pa.Array, np.ndarray]:
    """The values of a list column and, for each, the row of the batch that it is in."""
    lists = batch.column(name)
    return lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))


def _distinct(batches):
    """(piece, n) once for each distinct pre-token of a batch."""
    for batch in batches:
        values, _ = _flat(batch, "p")
        seen = values.value_counts()
        yield pa.RecordBatch.from_arrays([seen.field("values").cast(pa.string()), seen.field("counts").cast(pa.int64())], names=["piece", "n"])


def vocabulary(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(piece, n, pieces): each distinct pre-token of the corpus, how often it occurs, and its token count."""
    split = docs.select(pre_tokens(F.col("text")).alias("p"))
    counted = split.mapInArrow(_distinct, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    return materialise(counted.select("piece", "n", piece_counter(docs.sparkSession, path)("piece").alias("pieces")), "pre-tokens")


def _hot_join(shipped):
    """Per row the summed counts of its hot pre-tokens, and (piece, frequency) of each other one."""

    def run(batches):
        hot = None
        for batch in batches:
            if hot is None:
                hot = pa.ipc.open_file(pa.BufferReader(shipped.value)).read_all()
                pieces = hot.column("pieces").to_numpy()
                hot_values = hot.column("piece").combine_chunks()
            values, row = _flat(batch, "p")
            coded = values.dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            at = pc.index_in(coded.dictionary, value_set=hot_values)
            known = pc.is_valid(at).to_numpy(zero_copy_only=False)
            n = np.where(known, pieces[pc.fill_null(at, 0).to_numpy()] if len(pieces) else 0, 0) if len(known) else np.zeros(0, np.int64)
            sums = np.bincount(row, weights=n[codes] if len(codes) else None, minlength=batch.num_rows).astype(np.int64)
            ids = batch.column("row")
            cold = np.flatnonzero(~known[codes]) if len(codes) else np.zeros(0, np.int64)
            pair = row[cold] * np.int64(max(len(known), 1)) + codes[cold]
            pair, freq = np.unique(pair, return_counts=True)
            names = coded.dictionary.take(pa.array(pair % max(len(known), 1)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([ids, ids.take(pa.array(pair // max(len(known), 1)))]),
                    pa.concat_arrays([batch.column("doc_id"), batch.column("doc_id").take(pa.array(pair // max(len(known), 1)))]),
                    pa.concat_arrays([pa.nulls(batch.num_rows, pa.string()), names.cast(pa.string())]),
                    pa.concat_arrays([pa.array(sums), pa.array(freq.astype(np.int64))]),
                ],
                names=["row", "doc_id", "piece", "n"],
            )

    return run


def hot_part(vocab: DataFrame, hot: int) -> DataFrame:
    """The pre-tokens above a frequency that at most ``hot`` of them reach, found without sorting.

    Frequencies are counted by eighths of an octave, so a few hundred rows at most come to the driver.
    """
    octave = F.floor(F.log2("n") * 8)
    steps = vocab.groupBy(octave.alias("o")).agg(F.count("*").alias("c")).collect()
    least, held = None, 0
    for r in sorted(steps, key=lambda r: -r["o"]):
        held += r["c"]
        if held > hot:
            break
        least = r["o"]
    return vocab.select("piece", "pieces").filter(F.lit(False) if least is None else octave >= least)


def token_counts(docs: DataFrame, path: str = VOCABULARY, hot: int = HOT) -> DataFrame:
    """doc_id and n_tokens of every row of docs."""
    spark = docs.sparkSession
    vocab = vocabulary(docs, path)
    sink = pa.BufferOutputStream()
    common = hot_part(vocab, hot).toArrow()
    with pa.ipc.new_file(sink, common.schema) as writer:
        writer.write_table(common)
    shipped = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), pre_tokens(F.col("text")).alias("p"))
    parts = rows.mapInArrow(_hot_join(shipped), "row bigint, doc_id bigint, piece string, n bigint")
    # rows of hot sums have no piece; their own row number spreads them over the join's partitions
    parts = parts.withColumn("key", F.coalesce("piece", F.col("row").cast("string"))).withColumn("rare", F.col("piece").isNotNull())
    rare = vocab.select(F.col("piece").alias("v_piece"), F.lit(True).alias("v_rare"), "pieces")
    summed = parts.join(rare, (F.col("key") == F.col("v_piece")) & (F.col("rare") == F.col("v_rare")), "left").withColumn("t", F.col("n") * F.coalesce("pieces", F.lit(1)))
    return summed.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("t").alias("n_tokens")).select("doc_id", "n_tokens")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
