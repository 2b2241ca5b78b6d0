"""Forests and linear learners against plain versions."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from candora.operators import forest, linear, models
from candora.operators.splits import stratified_kfold

SCHEMA = "review_id long, label int, features array<double>"


def table(spark, n=400, seed=3, width=4):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, width)), 1)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(scale=0.5, size=n)) > 0.4).astype(int)
    return x, y, spark.createDataFrame([(k, int(y[k]), x[k].tolist()) for k in range(n)], SCHEMA).repartition(3)


def plain_tree(x, y, depth):
    """Probability of each row by recursion over all cuts between neighbouring values."""
    out = np.full(len(y), y.mean())
    if depth == 0 or y.min() == y.max():
        return out
    gini = lambda z: 2 * z.sum() * (len(z) - z.sum()) / len(z) if len(z) else 0.0
    best = (1e-9, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            side = x[:, f] <= cut
            gain = gini(y) - gini(y[side]) - gini(y[~side])
            if gain > best[0] + 1e-9:
                best = (gain, side)
    if best[1] is None:
        return out
    side = best[1]
    out[side], out[~side] = plain_tree(x[side], y[side], depth - 1), plain_tree(x[~side], y[~side], depth - 1)
    return out


def test_one_tree_equals_plain_recursion(spark):
    x, y, df = table(spark, n=150)
    x = np.round(x)
    df = spark.createDataFrame([(k, int(y[k]), x[k].tolist()) for k in range(len(y))], SCHEMA)
    scored = models.random_forest(df, trees=1, depth=4)(df).orderBy("review_id").collect()
    assert [r["prob"] for r in scored] == pytest.approx(plain_tree(x, y, 4).tolist(), abs=1e-6)


def same(a, b):
    for left, right in zip(a.forest.trees, b.forest.trees, strict=True):
        assert (left.feature == right.feature).all() and (left.cut == right.cut).all() and (left.left == right.left).all()
        assert left.prob == pytest.approx(right.prob) and left.gain == pytest.approx(right.gain)


@pytest.mark.parametrize("balanced", [False, True])
def test_both_plans_grow_the_same_trees(spark, monkeypatch, balanced):
    _, _, df = table(spark)
    df = df.cache()
    whole = models.random_forest(df, trees=5, depth=6, balanced=balanced)
    monkeypatch.setattr(forest, "LOCAL_BYTES", 0)
    same(whole, models.random_forest(df, trees=5, depth=6, balanced=balanced))
    monkeypatch.setattr(forest, "HISTOGRAM_BYTES", 3 * 4 * forest.BINS * 16)  # three nodes at a time
    same(whole, models.random_forest(df, trees=5, depth=6, balanced=balanced))
    again = forest.forest_from(forest.forest_table(whole))
    same(whole, again)
    assert again(df).select("prob").collect() == whole(df).select("prob").collect()


@pytest.mark.parametrize(("rows", "depth"), [(1 << 40, 0), (1 << 40, 9), (150, 9), (40, 9), (0, 4)])
def test_nodes_grown_by_one_task_continue_the_tree(spark, monkeypatch, rows, depth):
    """Trees cut level by level down to nodes of few rows are those grown in one go, whatever few is."""
    _, _, df = table(spark)
    df = df.cache()
    whole = models.random_forest(df, trees=3, depth=depth, balanced=True)
    monkeypatch.setattr(forest, "LOCAL_BYTES", 0)
    monkeypatch.setattr(forest, "NODE_ROWS", rows)
    monkeypatch.setattr(forest, "SHUFFLE_BYTES", 4000)  # two trees at a time
    monkeypatch.setattr(forest, "CHUNK_ROWS", 50)
    same(whole, models.random_forest(df, trees=3, depth=depth, balanced=True))


def test_nodes_are_counted_in_small_parts(monkeypatch):
    """Once a node's rows fit a part, no array is longer than one, and the trees are those of whole arrays."""
    rng = np.random.default_rng(8)
    bins = rng.integers(0, 30, (3000, 5)).astype(np.uint8)
    label, keys = (rng.random(3000) < 0.2 + 0.5 * (bins[:, 0] > bins[:, 1])).astype(np.uint8), rng.integers(0, 1 << 60, 3000)
    settings = {"bootstrap": True, "depth": 12, "seed": 1, "take": 2, "classes": np.ones(2)}
    whole, sizes, counts = [forest.grow(bins, label, keys, t, **settings) for t in range(3)], [], forest._counts
    monkeypatch.setattr(forest, "PART_ROWS", 100)
    monkeypatch.setattr(forest, "GROUP_NODES", 3)
    monkeypatch.setattr(forest, "_counts", lambda coded, weight, node, *a: sizes.append(len(node)) or counts(coded, weight, node, *a))
    for t, tree in enumerate(whole):
        parted = forest.grow(bins, label, keys, t, **settings)
        for name in ("feature", "cut", "left", "prob", "gain"):
            assert getattr(parted, name) == pytest.approx(getattr(tree, name), abs=1e-9)
    assert max(sizes) <= 100


def test_large_tables_take_few_passes(spark, monkeypatch):
    """Beyond the broadcast, a forest of nodes that one task can grow costs no pass a level."""
    _, _, df = table(spark)
    whole = models.random_forest(df, trees=5, depth=12)
    monkeypatch.setattr(forest, "LOCAL_BYTES", 0)
    passes = []
    monkeypatch.setattr(forest, "_cuts_of_nodes", lambda *a: pytest.fail("cut on the driver"))
    group = type(df).groupBy
    monkeypatch.setattr(type(df), "groupBy", lambda self, *names: passes.extend(names[:1]) or group(self, *names))
    same(whole, models.random_forest(df, trees=5, depth=12))
    assert passes == ["_t"]


def test_forest_on_dirty_rows(spark):
    _, _, df = table(spark, n=200)
    odd = spark.createDataFrame(
        [(900, None, [1.0] * 4), (901, 1, [float("nan"), None, 1.0, 2.0]), (902, 0, None), (903, 1, [1.0]), (903, 1, [1.0])], SCHEMA
    )
    rows = df.unionByName(odd).withColumn("prob", F.lit("x")).withColumn("_key", F.lit(1))
    score = models.random_forest(rows, trees=7, depth=20)
    got = score(rows.drop("prob"))
    assert got.count() == 205 and got.filter("prob IS NULL OR prob < 0 OR prob > 1").count() == 0
    assert got.filter("label IS NOT NULL").agg(F.avg((F.col("label") == F.col("pred")).cast("int"))).collect()[0][0] > 0.9
    vectors = df.withColumn("features", array_to_vector("features"))
    same(models.random_forest(df, trees=3, depth=3), models.random_forest(vectors, trees=3, depth=3))
    nothing = models.random_forest(df.limit(0), trees=3)
    assert {r["prob"] for r in nothing(df).collect()} == {0.0}
    one = models.random_forest(df.filter("label = 1"), trees=3)
    assert {r["prob"] for r in one(df).collect()} == {1.0}


def test_draws_are_poisson():
    keys = np.arange(200_000, dtype=np.int64)
    counts = forest.draws(keys, 3, 42)
    assert counts.mean() == pytest.approx(1, abs=0.02) and (counts == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)
    assert (counts == forest.draws(keys, 3, 42)).all() and (counts != forest.draws(keys, 4, 42)).any()
    chosen = forest.subset(np.arange(1, 4000), 2, 42, 6, 2)
    assert (chosen[:, 0] < chosen[:, 1]).all() and np.bincount(chosen.ravel(), minlength=6) == pytest.approx(1333, rel=0.1)


def plain_linear(x, y, share, loss, penalised):
    """Newton's method with the whole Hessian."""
    x = np.c_[x, np.ones(len(x))]
    w, s = np.zeros(x.shape[1]), 2 * y - 1
    ridge = np.ones(len(w))
    ridge[-1] = float(penalised)

    def parts(w):
        m = s * (x @ w)
        if loss == linear.SQUARED_HINGE:
            gap = np.maximum(0, 1 - m)
            return (share * gap**2).sum(), x.T @ (-2 * share * s * gap), (x * (2 * share * (gap > 0))[:, None]).T @ x
        p = 1 / (1 + np.exp(m))
        return (share * np.log1p(np.exp(-m))).sum(), x.T @ (-share * s * p), (x * (share * p * (1 - p))[:, None]).T @ x

    for _ in range(60):
        _, g, h = parts(w)
        step = np.linalg.solve(h + np.diag(ridge), g + ridge * w)
        value = lambda w: parts(w)[0] + 0.5 * (ridge * w * w).sum()
        t = 1.0
        while value(w - t * step) > value(w) and t > 1e-9:
            t /= 2
        w = w - t * step
    return w


@pytest.mark.parametrize("sparse", [False, True])
def test_logistic_regression_equals_newton(spark, sparse):
    x, y, df = table(spark, width=5)
    x = np.where(np.abs(x) < 0.4, 0.0, x)
    make = (lambda r: Vectors.sparse(5, [(int(k), float(r[k])) for k in np.flatnonzero(r)])) if sparse else (lambda r: Vectors.dense(r.tolist()))
    rows = spark.createDataFrame([(k, int(y[k]), make(x[k])) for k in range(len(y))], ["review_id", "label", "features"])
    rows = rows.withColumn("label", F.col("label").cast("int")).repartition(3)
    score = models.logreg_balanced(rows, tolerance=1e-10)
    share = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum()))
    assert score.weights[0] == pytest.approx(plain_linear(x, y, share, linear.LOGISTIC, False), abs=1e-6)


@pytest.mark.parametrize("tasks", [1, 30])
def test_machines_equal_newton_per_fold(spark, monkeypatch, tasks):
    x, y, df = table(spark)
    monkeypatch.setattr(linear, "MOST_ROWS", len(y) // tasks)
    monkeypatch.setattr(linear, "SLICE", 4)
    df = df.cache()
    score = models.linear_svm_calibrated(df, tolerance=1e-10)
    fold = np.zeros(len(y), int)
    for r in stratified_kfold(df, 3).select("review_id", "fold").collect():
        fold[r["review_id"]] = r["fold"]
    for k in (1, 2, 3):
        own = fold != k
        ones = y[own].sum()
        share = np.where(y[own] == 1, own.sum() / 2 / ones, own.sum() / 2 / (own.sum() - ones))
        assert score.weights[k - 1] == pytest.approx(plain_linear(x[own], y[own], share, linear.SQUARED_HINGE, True), abs=1e-6)
        margin = np.c_[x[~own], np.ones((~own).sum())] @ score.weights[k - 1]
        one, zero = y[~own].sum(), (~own).sum() - y[~own].sum()
        goal = np.where(y[~own] == 1, (one + 1) / (one + 2), 1 / (zero + 2))
        a, b = score.curves[k - 1]
        error = 1 / (1 + np.exp(-(a * margin + b))) - goal
        assert abs(error.sum()) < 1e-5 and abs((error * margin).sum()) < 1e-5


def test_linear_learners_on_dirty_rows(spark):
    _, _, df = table(spark, n=120)
    odd = spark.createDataFrame([(900, None, [1.0] * 4), (901, 1, [float("nan"), None, 1.0, 2.0]), (902, 0, None), (903, 1, []), (903, 1, [])], SCHEMA)
    rows = df.unionByName(odd).withColumn("fold", F.lit("x")).withColumn("prob", F.lit(1))
    for fit in (models.logreg_balanced, models.linear_svm_calibrated):
        got = fit(rows)(rows.drop("prob"))
        assert got.count() == 125 and got.filter("prob IS NULL OR prob <= 0 OR prob >= 1").count() == 0
        one_class = fit(df.filter("label = 1"))(df)
        assert one_class.filter("prob IS NULL").count() == 0
        nothing = fit(df.limit(0))(df)
        assert nothing.filter("prob IS NULL").count() == 0


@pytest.mark.parametrize("rows_per_task", [100, 20_000])
def test_one_step_over_all_rows_whatever_their_layout(spark, monkeypatch, rows_per_task):
    """A batch larger than the table is one step from the mean gradient, in one task or several and beyond one block."""
    from candora.operators import mlp

    monkeypatch.setattr(mlp, "ROWS_PER_TASK", rows_per_task)
    x, y, df = table(spark, n=900)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    start = mlp.xavier_layers([4, 3, 1])
    settings = {"epochs": 1, "lr": 0.05, "alpha": 0.7, "dropout": 0.0, "layers": start}
    got = mlp._flatten(mlp.mlp_focal_train(df, df, batch=1 << 40, **settings).layers)
    state = mlp._State(mlp._flatten(start), *(np.zeros(len(got)) for _ in range(2)), 0.0)
    state.step(mlp.focal_gradient(start, x, y, 2.0, 0.7)[0] / len(y), 0.05)
    assert got == pytest.approx(state.weights, abs=1e-9)
    taken = mlp.mlp_focal_train(df, df, batch=300, **settings)  # batches go on beyond a block
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert np.abs(mlp._flatten(taken.layers) - got).max() > 1e-3


def test_sigmoids_are_stationary_for_large_sums(spark):
    """Errors and errors times margins vanish in absolute terms, as the sums they are, also where the first ones are large."""
    x, y, df = table(spark, n=300)
    numbered = df.withColumn("features", F.expr("transform(features, v -> v * 100000)")).withColumn("fold", (F.col("review_id") % 2 + 1).cast("int"))
    blocks, _, seen = linear.packed(numbered)
    weights = np.tile([1.0, 0.5, -0.5, 0.2, 3.0], (2, 1))
    curves = linear.platt(blocks, weights, seen[1:])
    blocks.unpersist()
    for k in (0, 1):
        own = np.arange(300) % 2 == k
        margin = x[own] * 1e5 @ weights[k, :4] + 3
        one = y[own].sum()
        goal = np.where(y[own] == 1, (one + 1) / (one + 2), 1 / (own.sum() - one + 2))
        error = 1 / (1 + np.exp(-(curves[k, 0] * margin + curves[k, 1]))) - goal
        assert abs(error.sum()) < 1e-4 and abs((error * margin).sum()) < 1e-4


def test_words_whose_signs_cancel_keep_their_length():
    from candora.operators.text import hashing_encoder

    encode = hashing_encoder(64)  # w0 and w13 share a cell, with opposite signs
    assert np.linalg.norm(encode(["w0 w13", "w13 w0 w0 w13", "w0", "", "! a"]), axis=1) == pytest.approx([1, 1, 1, 0, 0])


def test_tasks_and_blocks_are_bounded_by_entries(spark, monkeypatch):
    """Long rows make more tasks and smaller blocks, and the same sums."""
    x, y, df = table(spark, n=400)
    plain = models.logreg_balanced(df, tolerance=1e-10).weights
    monkeypatch.setattr(linear, "MOST_ENTRIES", 400)
    monkeypatch.setattr(linear, "BLOCK_ENTRIES", 30)
    blocks, width, seen = linear.packed(df)
    sizes = [len(r["_index"]) // 4 for r in blocks.collect()]
    assert blocks.rdd.getNumPartitions() == 4 and max(sizes) <= 30 and sum(sizes) == x.size and width == 4 and seen.sum() == 400
    monkeypatch.setattr(linear, "BLOCK_ENTRIES", 3)  # less than a row
    assert len(linear.packed(df)[0].collect()) == 400
    assert models.logreg_balanced(df, tolerance=1e-10).weights == pytest.approx(plain, abs=1e-7)


def test_calibration_reads_the_vectors_once(spark, monkeypatch):
    """Folds are numbered without making the vectors again, and a sigmoid's steps don't pass over the rows."""
    x, y, df = table(spark, n=300)
    made, passes = spark.sparkContext.accumulator(0), []

    @F.udf("array<double>")
    def counted(features):
        made.add(1)
        return features

    counted = counted.asNondeterministic()  # not made again by the optimiser
    old = linear.platt
    call = linear.Sums.__call__
    monkeypatch.setattr(linear.Sums, "__call__", lambda self, *a: passes.append(self.blocks.columns) or call(self, *a))
    monkeypatch.setattr(linear, "platt", lambda *a: passes.clear() or old(*a))
    models.linear_svm_calibrated(df.withColumn("features", counted("features")))
    assert made.value == 300
    assert passes and all("_value" not in columns for columns in passes) and len(passes) < 40


def test_no_more_tasks_than_cores_for_few_entries(spark, monkeypatch):
    """Every task adds up sums as long as the weights, so many shuffle partitions make no more of them."""
    _, _, df = table(spark, n=400)
    monkeypatch.setattr(linear, "ROWS_PER_TASK", 1)
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    blocks, _, _ = linear.packed(df)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert blocks.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    blocks.unpersist()
