import numpy as np
from tests.llm.helpers import awkward, clashing, empty

from graphloom.llm import quality
from graphloom.llm.common import table

LABELS = "doc_id bigint, quality int, toxic int"


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), quality.clean_labels(table(spark, d, "labels"))
    known = docs.join(labels, "doc_id").select("preferred", quality.feature_column(docs["text"]).alias("x")).toPandas()
    x, good = np.array(known["x"].tolist()), known["preferred"].to_numpy(bool)
    half = np.arange(len(x)) % 2 == 0
    ranker = quality.fit(x[half & good], x[half & ~good])
    score = ranker.score(x)
    a, b = score[~half & good], score[~half & ~good]
    assert (a[:, None] > b[None, :]).mean() > 0.98


def test_fit_prefers_the_better_of_a_pair():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(size=(50, quality.N_FEATURES)), rng.normal(size=(40, quality.N_FEATURES))
    good[:, 2] += 3
    r = quality.fit(good, bad)
    assert r.weights[2] > 0 and (r.score(good)[:, None] > r.score(bad)[None, :]).mean() > 0.95


def test_fit_minimises_the_pairwise_loss():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0.3, 1, (20, quality.N_FEATURES)), rng.normal(0, 1, (20, quality.N_FEATURES))
    r = quality.fit(good, bad)
    x = ((good[:, None] - bad[None, :]) / r.scale).reshape(-1, quality.N_FEATURES)
    loss = lambda w: np.log1p(np.exp(-x @ w)).mean() + 0.5e-3 * w @ w
    for _ in range(50):
        assert loss(r.weights) <= loss(r.weights + rng.normal(0, 0.05, quality.N_FEATURES)) + 1e-12


def test_awkward_documents(spark):
    docs = clashing(awkward(spark))
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 1, None), (10, 0, 0), (10, 1, 0), (8, 0, 0), (None, 1, 0), (3, None, 0), (99, 0, 0)], LABELS)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert not {4, 5, 6} & set(ids), "documents without words have no score"
    assert ids.count(2) == 2 and 1 in ids


def test_lowest_label_counts_and_ties_stay(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0)], LABELS)
    assert {(r.doc_id, r.preferred) for r in quality.clean_labels(labels).collect()} == {(1, False), (2, True)}
    scores = spark.createDataFrame([(2, 0.5), (2, 0.5), (3, 0.1)], "doc_id bigint, score double")
    assert quality.threshold(scores, labels) == 0.5


def test_one_class_or_nothing(spark):
    docs = awkward(spark)
    nothing = spark.createDataFrame([], LABELS)
    assert quality.keep_good(docs, nothing).count() == docs.count() - 3
    assert quality.keep_good(empty(spark), nothing).count() == 0
    only_good = spark.createDataFrame([(1, 1, 0)], LABELS)
    assert quality.keep_good(docs, only_good).count() == docs.count() - 3


def brute_fit(good, bad, ridge=1e-3):
    """Newton's method over every pair, one row each."""
    both = np.concatenate([good, bad])
    scale = both.std(0)
    scale[scale < 1e-12] = 1
    x = ((good[:, None] - bad[None, :]) / scale).reshape(-1, both.shape[1])
    w = np.zeros(both.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(np.clip(x @ w, -500, 500)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w)), x.T @ p / len(x) - ridge * w)
    return both.mean(0), scale, w


def test_all_pairs_count():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(0.4, 1, (37, quality.N_FEATURES)), rng.normal(0, 2, (23, quality.N_FEATURES))
    found = quality.fit(good, bad, block=8)
    assert np.allclose(found.weights, brute_fit(good, bad)[2], atol=1e-6)


def test_the_query_against_brute_force(spark, data):
    """Fit, scores, threshold and filter of the registered query, over the whole table, done again with plain loops."""
    docs, labels = table(spark, data, "documents").toPandas(), table(spark, data, "labels").toPandas()
    import pyarrow as pa

    from graphloom.llm.tokens import slices

    x = np.concatenate([quality.features(s) for s in slices(pa.array(docs["text"], pa.string()))])
    at = {i: k for k, i in enumerate(docs["doc_id"])}
    good = [at[i] for i, q in zip(labels["doc_id"], labels["quality"], strict=True) if q and i in at]
    bad = [at[i] for i, q in zip(labels["doc_id"], labels["quality"], strict=True) if not q and i in at]
    mean, scale, w = brute_fit(x[good], x[bad])
    score = ((x - mean) / scale) @ w
    least = sorted(score[good])[max(0, int(np.ceil(quality.QUANTILE * len(good))) - 1)]
    got = {r.doc_id: r.score for r in quality.op1_bradley_terry(spark, data).collect()}
    sure = {i for i, k in at.items() if score[k] >= least + 1e-6}
    assert sure <= set(got) <= {i for i, k in at.items() if score[k] >= least - 1e-6}
    assert all(abs(got[i] - score[at[i]]) < 1e-5 for i in got)


def test_own_names(spark):
    docs = awkward(spark).selectExpr("*", "1 AS _score", "2 AS _quality_score")
    kept = quality.keep_good(docs, spark.createDataFrame([], LABELS))
    assert kept.columns == docs.columns and {(r["_score"], r["_quality_score"]) for r in kept.collect()} == {(1, 2)}
