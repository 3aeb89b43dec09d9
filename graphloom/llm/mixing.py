"""Operator 7: mixing sources to target weights that change over the training run.

Each source has a weight schedule, linear between knots of training time 0..1. Its integral is the source's
cumulative token demand; a document that starts ``c`` tokens into its source is trained on at the time when
the demand reaches ``c``, which the inverse of the integral (a quadratic in each segment) gives. Positions
are then sorted by range: since the mixed stream has, by construction, one token of demand per position,
equal-width ranges of position are equally full, and no sampling pass is needed.

A source with more tokens than its demand gives its first ones in scrambled order; one with fewer starts over
until its demand is met, so every weight holds to the end of the run. Demand sums to the corpus's tokens, so the
output is no longer than the corpus; ``max_epochs`` bounds the repeats if a caller wants that, and ``unmet_demand`` tells
what that leaves open.

Documents are counted along their source in two steps: ranges of the scrambled id, as many as the source's size asks for
(about ``RANGE_ROWS`` documents each), then within a range. So a source that holds most of the corpus is spread over
tasks that stay equally large at any size. The counting carries ids and numbers only.

Defined results: a NULL source is a source of its own. NULL and empty texts hold 0 tokens; they take the
position of the next document and no room. Equal scrambled ids are ordered by (doc_id, text); repeated rows
follow each other and each has its own position. Texts of any length count whole. Ids that are not whole numbers are
scrambled by their hash. An empty table gives no rows. Further columns pass through ``mix`` untouched, whatever they are
called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import MIXED_KEY_SQL, mixed_key, quoted, table, unused, words
from graphloom.storage import materialise

#: Knots of time, each with the power of a source's share of tokens that its weight follows there: from the
#: natural mix over the square root to all sources alike.
SCHEDULE = ((0.0, 1.0), (0.6, 0.5), (1.0, 0.0))
#: Documents of a range, about.
RANGE_ROWS = 4_096


def _share(tokens: Column, power: float) -> Column:
    t = tokens.cast("double")
    return {1.0: t, 0.5: F.sqrt(t), 0.0: F.when(t > 0, F.lit(1.0)).otherwise(F.lit(0.0))}.get(power, F.pow(t, F.lit(power)))


def demand_segments(supply: DataFrame, schedule=SCHEDULE, total: Column | None = None) -> DataFrame:
    """For each source of ``supply`` (source, tokens): tokens, demand, and its segments (t0, dt, w0, w1, c0, c1).

    Weights are normalised over all sources at each knot; linear interpolation keeps their sum at 1 between.
    """
    everyone = W.partitionBy()
    df = supply.withColumn("total", F.sum("tokens").over(everyone).cast("double") if total is None else total.cast("double"))
    for k, (_, power) in enumerate(schedule):
        df = df.withColumn(f"s{k}", _share(F.col("tokens"), power))
    for k in range(len(schedule)):
        df = df.withColumn(f"w{k}", F.coalesce(F.try_divide(f"s{k}", F.sum(f"s{k}").over(everyone)), F.lit(0.0)))
    done, segments = F.lit(0.0), []
    for k in range(len(schedule) - 1):
        t0, dt = schedule[k][0], schedule[k + 1][0] - schedule[k][0]
        after = done + F.col("total") * F.lit(dt) * (F.col(f"w{k}") + F.col(f"w{k + 1}")) / 2
        segments.append(F.struct(F.lit(t0).alias("t0"), F.lit(dt).alias("dt"), F.col(f"w{k}").alias("w0"), F.col(f"w{k + 1}").alias("w1"), done.alias("c0"), after.alias("c1")))
        done = after
    return df.select("source", "tokens", "total", done.alias("demand"), F.array(*segments).alias("segments"))


def _invert(c: Column, segments: Column, total: Column) -> Column:
    """The time at which the cumulative demand reaches c (c below the whole demand)."""
    hit = F.element_at(F.filter(segments, lambda s: (c < s["c1"]) & (s["c1"] > s["c0"])), 1)
    need = F.greatest(c - hit["c0"], F.lit(0.0)) / total
    slope = (hit["w1"] - hit["w0"]) / hit["dt"]
    root = F.sqrt(F.greatest(hit["w0"] * hit["w0"] + 2 * slope * need, F.lit(0.0)))
    return hit["t0"] + F.when(need == 0, F.lit(0.0)).otherwise(2 * need / (hit["w0"] + root))


#: What ``positions`` adds, by its plain name.
ADDED = ["source", "key", "id", "text", "tokens", "epoch", "position", "total"]


def positions(docs: DataFrame, carried: list[str], schedule=SCHEDULE, max_epochs: int | None = None) -> tuple[DataFrame, dict[str, str]]:
    """``carried`` columns of docs with those of ``ADDED``, whose real names, unused by docs, come second."""
    n = dict(zip([*ADDED, "range", "run", "s", "r", "start", "plan", "size"], unused(docs, *[f"_mix_{x}" for x in [*ADDED, "range", "run", "s", "r", "start", "plan", "size"]]), strict=True))
    c = {k: quoted(v) for k, v in n.items()}
    counted = docs.groupBy(F.col("source").alias(n["s"])).agg(F.count("*").alias("rows"))
    ranges = materialise(counted.select(n["s"], F.greatest(F.ceil(F.col("rows") / RANGE_ROWS), F.lit(1)).cast("bigint").alias(n["size"])), "mix-ranges")
    own = docs.select(
        *[quoted(x) for x in carried],
        F.col("source").alias(n["source"]),
        mixed_key(docs, "doc_id").alias(n["key"]),
        F.col("doc_id").alias(n["id"]),
        F.xxhash64("text").alias(n["text"]),
        words(F.col("text")).alias(n["tokens"]),
    )
    # a row a source
    own = own.join(ranges, c["source"].eqNullSafe(c["s"])).withColumn(n["range"], F.floor(c["key"] * c["size"] / F.lit(4294967296.0)).cast("bigint")).drop(n["s"], n["size"])
    # a row for each RANGE_ROWS documents; kept, as both the supply and the starts follow from it
    sizes = materialise(own.groupBy(n["source"], n["range"]).agg(F.sum(n["tokens"]).alias("n")), "mix-sizes")
    supply = sizes.groupBy(c["source"].alias("source")).agg(F.sum("n").alias("tokens"))
    before = W.partitionBy(n["source"]).orderBy(n["range"]).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(n["source"], n["range"], F.coalesce(F.sum("n").over(before), F.lit(0)).alias(n["start"]))
    plan = demand_segments(supply, schedule)
    starts = starts.join(plan, c["source"].eqNullSafe(F.col("source"))).select(
        c["source"].alias(n["s"]), c["range"].alias(n["r"]), n["start"], F.struct("tokens", "total", "demand", "segments").alias(n["plan"])
    )
    within = W.partitionBy(n["source"], n["range"]).orderBy(n["key"], n["id"], n["text"]).rowsBetween(W.unboundedPreceding, 0)
    run = own.withColumn(n["run"], F.sum(n["tokens"]).over(within) - c["tokens"])
    both = run.join(starts, c["source"].eqNullSafe(c["s"]) & (c["range"] == c["r"]))
    at, supply_, demand = (c["start"] + c["run"]).cast("double"), c["plan"]["tokens"].cast("double"), c["plan"]["demand"]
    last = F.ceil(F.try_divide(demand - at, supply_)) - 1
    last = last if max_epochs is None else F.least(last, F.lit(max_epochs - 1))
    fits = both.filter((at < demand) & (supply_ > 0)).withColumn(n["epoch"], F.explode(F.sequence(F.lit(0), F.greatest(last, F.lit(0)).cast("int"))))
    time = _invert(at + c["epoch"] * supply_, c["plan"]["segments"], c["plan"]["total"])
    placed = fits.withColumn(n["position"], time * c["plan"]["total"]).withColumn(n["total"], c["plan"]["total"])
    return placed, n


def range_sorted(placed: DataFrame, n: dict[str, str], partitions: int) -> DataFrame:
    """Partition i holds the i-th of equally wide ranges of position, each sorted."""
    slot = F.least(F.floor(quoted(n["position"]) / quoted(n["total"]) * partitions), F.lit(partitions - 1)).cast("int")
    return placed.repartitionById(partitions, slot).sortWithinPartitions(*[n[x] for x in ("position", "key", "id", "text", "epoch")])


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(docs: DataFrame, schedule=SCHEDULE, max_epochs: int | None = None) -> DataFrame:
    """The documents to train on, in training order, with the columns of docs; repeats are rows of their own."""
    placed, n = positions(docs, docs.columns, schedule, max_epochs)
    return range_sorted(placed, n, _partitions(docs.sparkSession)).select(*[quoted(x) for x in docs.columns])


def training_order(docs: DataFrame, schedule=SCHEDULE, max_epochs: int | None = None) -> DataFrame:
    """doc_id, source, epoch, n_tokens and position of every document that is trained on, in order."""
    placed, n = positions(docs, [], schedule, max_epochs)
    return range_sorted(placed, n, _partitions(docs.sparkSession)).select(
        quoted(n["id"]).alias("doc_id"), quoted(n["source"]).alias("source"), quoted(n["epoch"]).alias("epoch"), quoted(n["tokens"]).alias("n_tokens"), F.round(quoted(n["position"]), 2).alias("position")
    )


def unmet_demand(docs: DataFrame, schedule=SCHEDULE, max_epochs: int | None = None) -> DataFrame:
    """source, tokens, demand and the part of it that ``max_epochs`` leaves open (0 without that bound)."""
    supply = docs.groupBy("source").agg(F.sum(words(F.col("text"))).alias("tokens"))
    given = F.lit(None) if max_epochs is None else F.greatest(F.col("demand") - F.col("tokens") * max_epochs, F.lit(0.0))
    return demand_segments(supply, schedule).select("source", "tokens", "demand", F.coalesce(given, F.lit(0.0)).alias("unmet"))


def op7_time_varying_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order(table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '\\S+')), 0)::BIGINT AS n, {MIXED_KEY_SQL} AS key FROM documents),
r AS (SELECT *, (sum(n) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - n)::DOUBLE AS c FROM d),
s AS (SELECT source, sum(n)::DOUBLE AS tokens FROM d GROUP BY source),
w AS (SELECT source, tokens, sum(tokens) OVER () AS total, tokens / sum(tokens) OVER () AS w0, sqrt(tokens) / sum(sqrt(tokens)) OVER () AS w1, 1.0::DOUBLE / count(*) OVER () AS w2 FROM s WHERE tokens > 0),
q AS (SELECT *, total * 0.6::DOUBLE * (w0 + w1) / 2 AS q1, total * 0.6::DOUBLE * (w0 + w1) / 2 + total * 0.4::DOUBLE * (w1 + w2) / 2 AS demand FROM w),
g AS (SELECT r.doc_id, r.source, r.n, r.c AS start, unnest(range(greatest(ceil((q.demand - r.c) / q.tokens), 1)::BIGINT)) AS epoch, q.* EXCLUDE (source) FROM r JOIN q ON q.source = r.source WHERE r.c < q.demand),
e AS (SELECT *, start + epoch * tokens AS c FROM g),
x AS (SELECT *, CASE WHEN c < q1 THEN 0.0 ELSE 0.6 END::DOUBLE AS t0, CASE WHEN c < q1 THEN c ELSE c - q1 END / total AS need,
      CASE WHEN c < q1 THEN w0 ELSE w1 END AS a, CASE WHEN c < q1 THEN (w1 - w0) / 0.6::DOUBLE ELSE (w2 - w1) / 0.4::DOUBLE END AS slope FROM e)
SELECT doc_id, source, epoch::INT AS epoch, n AS n_tokens, round((t0 + CASE WHEN need = 0 THEN 0 ELSE 2 * need / (a + sqrt(greatest(a * a + 2 * slope * need, 0))) END) * total, 2) AS position FROM x
"""
