import numpy as np
from tests.llm.helpers import awkward, clashing, empty

from graphloom.llm import mixing


def test_weights_follow_the_schedule(spark):
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(int(k), " ".join(["w"] * int(rng.integers(5, 40))), "ab"[int(k % 10 > 7)]) for k in range(4000)], "doc_id bigint, text string, source string")
    rows = mixing.training_order(docs).toPandas()
    total = {s: g["n_tokens"].sum() for s, g in docs.selectExpr("source", "size(split(text, ' ')) AS n_tokens").toPandas().groupby("source")}
    whole = sum(total.values())
    share = {s: n / whole for s, n in total.items()}
    root = {s: np.sqrt(n) / sum(np.sqrt(x) for x in total.values()) for s, n in total.items()}
    for low, high in ((0.0, 0.2), (0.4, 0.6), (0.8, 1.0)):
        part = rows[(rows.position >= low * whole) & (rows.position < high * whole)]
        weight = lambda t: share["b"] + (root["b"] - share["b"]) * t / 0.6 if t < 0.6 else root["b"] + (0.5 - root["b"]) * (t - 0.6) / 0.4
        wanted = np.mean([weight(t) for t in np.linspace(low, high, 200)])
        assert abs(part[part.source == "b"].n_tokens.sum() / part.n_tokens.sum() - wanted) < 0.02
    assert rows[rows.source == "b"].epoch.max() >= 1, "the small source is repeated"
    assert len(rows[rows.source == "a"]) < docs.filter("source = 'a'").count(), "the large source is cut"


def test_inverse_of_the_integral(spark):
    plan = mixing.demand_segments(spark.createDataFrame([("a", 900), ("b", 100)], "source string, tokens bigint")).collect()
    for r in plan:
        for c in np.linspace(0, r["demand"] * 0.999, 50):
            for s in r["segments"]:
                if s["c0"] <= c < s["c1"]:
                    slope = (s["w1"] - s["w0"]) / s["dt"]
                    need = (c - s["c0"]) / r["total"]
                    x = 2 * need / (s["w0"] + np.sqrt(s["w0"] ** 2 + 2 * slope * need)) if need else 0.0
                    assert abs(s["c0"] + r["total"] * (s["w0"] * x + slope * x * x / 2) - c) < 1e-6
    assert abs(sum(r["demand"] for r in plan) - 1000) < 1e-6


def test_order_and_columns(spark):
    docs = clashing(awkward(spark))
    out = mixing.mix(docs)
    assert out.dtypes == docs.dtypes
    names = [tuple(r) for r in out.select("doc_id", "source").collect()]
    assert set(names) <= {tuple(r) for r in docs.select("doc_id", "source").collect()}
    assert any(s is None for _, s in names)
    order = [r.position for r in mixing.training_order(docs).collect()]
    assert order == sorted(order)


def test_ties_and_repeats_have_their_own_positions(spark):
    docs = spark.createDataFrame([(5, "one two three", "a")] * 4 + [(None, "four five six", "a")] * 2, "doc_id bigint, text string, source string")
    rows = mixing.training_order(docs).collect()
    assert len(rows) == 6 and len({r.position for r in rows}) == 6


def test_empty_and_wordless(spark):
    assert mixing.mix(empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id bigint, text string, source string")
    assert mixing.mix(nothing).count() == 0


def test_text_ids_and_own_names(spark):
    docs = spark.createDataFrame([(f"d{k}", "one two three", "a" if k % 3 else None, k) for k in range(60)], "doc_id string, text string, source string, _mix_tokens int")
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert {r["_mix_tokens"] for r in out.collect()} <= set(range(60)) and out.count() > 50


def test_ranges_of_a_source_follow_its_size(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "w " * (1 + k % 7), "hot" if k % 10 else "cold") for k in range(3000)], "doc_id bigint, text string, source string")
    whole = sorted(tuple(r) for r in mixing.training_order(docs).collect())
    monkeypatch.setattr(mixing, "RANGE_ROWS", 37)
    assert sorted(tuple(r) for r in mixing.training_order(docs).collect()) == whole


def test_a_bound_on_epochs_tells_what_it_leaves_open(spark):
    docs = spark.createDataFrame([(k, "w " * 50, "hot") for k in range(200)] + [(1000, "one word", "cold")], "doc_id bigint, text string, source string")
    open_ = {r.source: r.unmet for r in mixing.unmet_demand(docs, max_epochs=3).collect()}
    assert open_["hot"] == 0 and open_["cold"] > 1000
    assert {r.unmet for r in mixing.unmet_demand(docs).collect()} == {0.0}
