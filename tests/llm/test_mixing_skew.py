import numpy as np

from graphloom.llm import mixing


def test_a_short_source_is_repeated_until_its_demand_is_met(spark):
    """One source has 90 % of the tokens, 20 have 0.5 % each: these need more than five epochs."""
    rows = [(k, " ".join(["w"] * 10), "hot") for k in range(3600)]
    rows += [(10_000 + 20 * s + k, " ".join(["w"] * 10), f"cold{s:02d}") for s in range(20) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.training_order(docs).toPandas()
    whole = 40_000
    shares = np.array([0.9] + [0.005] * 20)
    root = np.sqrt(shares) / np.sqrt(shares).sum()
    demand = 0.6 * (shares + root) / 2 + 0.4 * (root + 1 / 21) / 2
    given = out.groupby("source").n_tokens.sum() / whole
    assert out.epoch.max() == 5
    assert abs(given["hot"] - demand[0]) < 0.001
    assert all(abs(given[f"cold{s:02d}"] - demand[1]) < 0.001 for s in range(20))
    late = out[out.position >= 0.95 * whole]
    assert abs(late.n_tokens.sum() / (0.05 * whole) - 1) < 0.1, "positions stay empty late in the run"


def test_epochs_are_bounded_only_when_asked(spark):
    docs = spark.createDataFrame([(k, "w " * 50, "hot") for k in range(200)] + [(1000, "one word", "cold")], "doc_id bigint, text string, source string")
    assert mixing.training_order(docs).filter("source = 'cold'").count() > 100
    assert mixing.training_order(docs, max_epochs=3).filter("source = 'cold'").count() == 3
