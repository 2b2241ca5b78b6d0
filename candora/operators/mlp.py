"""Focal-loss multilayer perceptron trained data-parallel.

Rows are packed once into blocks that stay cached on the executors. An epoch is one job: each task goes through its
blocks in mini-batches, starting from the common weights, and the tasks' results are averaged. What moves is one set of
weights a task (added up on the executors beyond :data:`PARTIAL_SUMS` tasks) and the common ones back.

One exchange of gradients a step, inside a barrier stage, was measured and left: Spark's exchange between the tasks of a
barrier stage takes 1.0 s however small the message (4 tasks, 20 exchanges of 200 kB), so 30 epochs of 10 steps would
take five minutes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candora.operators.balance import focal_alpha
from candora.operators.evaluation import all_metrics
from candora.plans.scalars import one_row
from candora.plans.storage import freeze

Layers = list[tuple[np.ndarray, np.ndarray]]  # (weights out x in, bias) per layer

PARTIAL_SUMS = 16  # states that reach the driver per epoch
ROWS_PER_TASK = 20_000  # rows that train in one task; more of them are dealt over several
MOST_ROWS = 500_000  # rows that a task holds at most


def xavier_layers(sizes: Sequence[int], seed: int = 42) -> Layers:
    """Xavier-uniform weights, zero biases."""
    rng = np.random.default_rng(seed)
    layers = []
    for fan_in, fan_out in zip(sizes[:-1], sizes[1:], strict=True):
        bound = np.sqrt(6.0 / (fan_in + fan_out))
        layers.append((rng.uniform(-bound, bound, (fan_out, fan_in)), np.zeros(fan_out)))
    return layers


def forward_function(layers: Layers) -> Callable[[np.ndarray], np.ndarray]:
    """Batch forward pass (dropout off): rows of features to logits."""

    def forward(x: np.ndarray) -> np.ndarray:
        hidden = np.asarray(x, dtype=float)
        for i, (weights, bias) in enumerate(layers):
            hidden = hidden @ weights.T + bias
            if i < len(layers) - 1:
                hidden = np.maximum(hidden, 0.0)
        return hidden[:, 0]

    return forward


def mlp_score(df: DataFrame, layers: Layers, column: str = "features", threshold: float = 0.5) -> DataFrame:
    """Add logit, probability and prediction, one matrix product per Arrow batch and layer.

    What is missing in a vector counts as 0.
    """
    forward, width = forward_function(layers), layers[0][0].shape[1]

    @F.arrow_udf(T.DoubleType())
    def logit(vectors: pa.Array) -> pa.Array:
        return pa.array(forward(dense_rows(vectors, width)))

    scored = df.withColumn("logit", logit(F.col(column).cast("array<double>")))
    scored = scored.withColumn("prob", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("logit"))))
    return scored.withColumn("pred", (F.col("prob") >= threshold).cast("int"))


@dataclass
class TrainedMlp:
    """Weights of the best epoch and the per-epoch history."""

    layers: Layers
    history: DataFrame
    best_epoch: int

    def __call__(self, df: DataFrame) -> DataFrame:
        return mlp_score(df, self.layers)


def _uniform(keys: np.ndarray, columns: int, seed: int) -> np.ndarray:
    """Random numbers in [0, 1) that depend on each row's key alone, not on where the row is processed."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.int64).view(np.uint64)[:, None] + np.uint64(seed + 1) * np.uint64(0x9E3779B97F4A7C15)
        h = h + np.arange(1, columns + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def focal_gradient(
    layers: Layers, x: np.ndarray, y: np.ndarray, gamma: float, alpha: float, dropout: float = 0.0, keys: np.ndarray | None = None, seed: int = 0
) -> tuple[np.ndarray, float, int]:
    """Gradient of the summed focal loss as one flat array, the loss, and how many rows are predicted right.

    With ``dropout`` the rows' ``keys`` and the seed say which units are left out.
    """
    inputs, masks, hidden = [], [], x
    for i, (weights, bias) in enumerate(layers):
        inputs.append(hidden)
        hidden = hidden @ weights.T + bias
        if i < len(layers) - 1:
            mask = (hidden > 0).astype(float)
            if dropout > 0:
                mask *= (_uniform(keys, hidden.shape[1], seed * 16 + i) >= dropout) / (1.0 - dropout)
            hidden = hidden * mask
            masks.append(mask)
    z = hidden[:, 0]
    p = 1.0 / (1.0 + np.exp(-z))
    p_true = np.clip(np.where(y == 1, p, 1.0 - p), 1e-12, 1.0)
    a = np.where(y == 1, alpha, 1.0 - alpha)
    bce = np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))
    miss = 1.0 - p_true
    sign = np.where(y == 1, 1.0, -1.0)
    back = (a * sign * (gamma * miss**gamma * p_true * np.log(p_true) - miss ** (gamma + 1.0)))[:, None]
    grads: list[np.ndarray] = []
    for i in range(len(layers) - 1, -1, -1):
        grads[:0] = [(back.T @ inputs[i]).ravel(), back.sum(axis=0)]
        if i > 0:
            back = (back @ layers[i][0]) * masks[i - 1]
    return np.concatenate(grads), float((a * miss**gamma * bce).sum()), int(((p >= 0.5) == (y == 1)).sum())


def _blocks(rows: DataFrame, width: int) -> DataFrame:
    """Rows packed for the network: features, labels and keys of an Arrow batch in one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = dense_rows(batch.column(2), width)
                y, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 0))
                blob = [pa.array([v.tobytes()], pa.binary()) for v in (x, y.astype(float), keys.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(blob, ["_x", "_y", "_keys"])

    return rows.select("_key", "label", "features").mapInArrow(run, "_x binary, _y binary, _keys binary")


def dense_rows(lists: pa.Array, width: int) -> np.ndarray:
    """Arrays of numbers as rows of a matrix; what is missing counts as 0."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.nan_to_num(lists.flatten().to_numpy(zero_copy_only=False).astype(float), nan=0.0)
    if (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width))
    row, place = np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[row[place < width], place[place < width]] = flat[place < width]
    return out


def _decoded(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, y, keys = (np.frombuffer(batch.column(c)[k].as_py(), kind) for c, kind in enumerate((float, float, np.int64)))
    return x.reshape(len(y), -1), y, keys


def loss_gradient(df: DataFrame, layers: Layers, gamma: float = 2.0, alpha: float = 0.5) -> DataFrame:
    """Gradient of the mean focal loss over all rows: ``(layer, kind, position, gradient)``, one pass, added up by position."""
    names = [(i, kind) for i in range(len(layers)) for kind in ("weights", "bias")]
    sizes = [part.size for layer in layers for part in layer]
    place = pa.array(np.concatenate([np.arange(n) for n in sizes]), pa.int32())
    layer = pa.array(np.repeat([i for i, _ in names], sizes), pa.int32())
    kind = pa.array(np.repeat([k for _, k in names], sizes), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(place)), 0
        for batch in batches:
            x = dense_rows(batch.column(1), layers[0][0].shape[1])
            total += focal_gradient(layers, x, batch.column(0).to_numpy(zero_copy_only=False).astype(float), gamma, alpha)[0]
            rows += batch.num_rows
        counts = pa.array(np.full(len(place), rows))
        yield pa.RecordBatch.from_arrays([layer, kind, place, pa.array(total), counts], ["layer", "kind", "position", "g", "n"])

    slim = df.filter(F.col("label").isNotNull()).select(F.col("label").cast("int"), F.col("features").cast("array<double>"))
    sums = slim.mapInArrow(run, "layer int, kind string, position int, g double, n long").groupBy("layer", "kind", "position")
    return sums.agg((F.sum("g") / F.sum("n")).alias("gradient"))


@dataclass
class _State:
    """Weights and Adam's moments as flat arrays, and how many steps were taken."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: float

    def step(self, gradient: np.ndarray, lr: float) -> None:
        self.steps += 1
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient**2
        self.weights = self.weights - lr * (self.first / (1 - 0.9**self.steps)) / (np.sqrt(self.second / (1 - 0.999**self.steps)) + 1e-8)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.weights, self.first, self.second, [self.steps]])

    @classmethod
    def of(cls, flat: np.ndarray) -> _State:
        weights, first, second = np.split(np.array(flat[:-1]), 3)
        return cls(weights, first, second, float(flat[-1]))


_SUMS = "rows bigint, loss double, hits bigint, state binary"


def _sums(rows: int, loss: float, hits: int, state: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([rows]), pa.array([loss]), pa.array([hits]), pa.array([state.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["rows", "loss", "hits", "state"])


def _epoch_task(known, like: Layers, epoch: int, batch_rows: int, lr: float, gamma: float, alpha: float, dropout: float, seed: int, whole: bool):
    """One epoch over a task's rows in shuffled batches, from the common state; yields the new state times the rows.

    With ``whole`` all tasks' rows are one batch: no step is taken, the summed gradient is yielded in the state's place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, rows, loss, hits = _State.of(known.value), 0, 0.0, 0
        held, waiting = np.zeros_like(state.weights), 0
        for batch in batches:
            for k in range(batch.num_rows):
                x, y, keys = _decoded(batch, k)
                order = np.argsort(_uniform(keys, 1, seed * 100_003 + epoch)[:, 0], kind="stable")
                low = 0
                while low < len(order):  # a batch may go on in the next block
                    own = order[low : low + batch_rows - waiting]
                    number = seed * 100_003 + int(state.steps)
                    gradient, more, right = focal_gradient(_unflatten(state.weights, like), x[own], y[own], gamma, alpha, dropout, keys[own], number)
                    low, held, waiting = low + len(own), held + gradient, waiting + len(own)
                    rows, loss, hits = rows + len(own), loss + more, hits + right
                    if waiting == batch_rows and not whole:
                        state.step(held / waiting, lr)
                        held, waiting = np.zeros_like(held), 0
        if waiting and not whole:
            state.step(held / waiting, lr)
        if rows:
            yield _sums(rows, loss, hits, held if whole else state.flat() * rows)

    return run


def _add_up(table: pa.Table) -> pa.Table:
    state = sum(np.frombuffer(x.as_buffer(), float) for x in table.column("state"))
    return pa.Table.from_batches([_sums(pc.sum(table.column("rows")).as_py(), pc.sum(table.column("loss")).as_py(), pc.sum(table.column("hits")).as_py(), state)])


def _flatten(layers: Layers) -> np.ndarray:
    return np.concatenate([part.ravel() for layer in layers for part in layer])


def _unflatten(flat: np.ndarray, like: Layers) -> Layers:
    out, at = [], 0
    for weights, bias in like:
        w = flat[at : at + weights.size].reshape(weights.shape)
        at += weights.size
        out.append((w, flat[at : at + bias.size]))
        at += bias.size
    return out


def mlp_focal_train(
    train: DataFrame,
    validation: DataFrame,
    hidden: Sequence[int] = (256, 64),
    epochs: int = 30,
    *,
    batch: int = 128,
    lr: float = 1e-3,
    gamma: float = 2.0,
    alpha: float | None = None,
    dropout: float = 0.3,
    seed: int = 42,
    layers: Layers | None = None,
    restart: str | None = None,
) -> TrainedMlp:
    """Train on ``(review_id, label, features)`` and keep the epoch with the best validation AUC.

    An epoch is one job: every task takes Adam steps over its rows in shuffled batches of ``batch`` rows, and the tasks'
    weights and moments are averaged by their rows. Tables of up to :data:`ROWS_PER_TASK` rows are one task, which is
    plain mini-batch training. A batch is not cut at a block of rows, and one that covers the table is one step from the
    gradient of all tasks; in between, it ends with its task's rows (:data:`MOST_ROWS` at most). ``layers`` are the weights to begin with. With ``restart``, a folder that all executors
    reach, the state is written after each epoch, and a later call with the same folder goes on behind the last one.
    Validation scores of all epochs are computed in one pass at the end. Rows without a label take no part; what is
    missing in a vector counts as 0; without training rows the weights stay as they were.
    """
    spark = train.sparkSession
    slim = train.filter(F.col("label").isNotNull()).select(
        F.xxhash64("review_id", "features").alias("_key"), F.col("label").cast("int").alias("label"),
        F.col("features").cast("array<double>").alias("features"),
    ).persist()
    sizes = one_row(slim.agg(F.max(F.size("features")).alias("w"), F.count(F.lit(1)).alias("n")))
    width = layers[0][0].shape[1] if layers else max(1, sizes["w"] or 1)
    if alpha is None:
        alpha = one_row(focal_alpha(slim))["alpha"] if sizes["n"] else 0.5
    like = layers or xavier_layers([width, *hidden, 1], seed)
    start = _flatten(like)
    state = _State(start, np.zeros_like(start), np.zeros_like(start), 0.0)
    usual = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    whole = batch >= sizes["n"]
    fewest = sizes["n"] // MOST_ROWS
    tasks = max(1, min(sizes["n"] // ROWS_PER_TASK, usual, sizes["n"] if whole else sizes["n"] // batch), fewest)
    blocks = _blocks(slim.repartition(tasks, "_key").sortWithinPartitions("_key"), width).persist()
    snapshots, progress = [], []
    done = _epochs_done(spark, restart)
    for epoch in range(1, epochs + 1):
        if epoch in done:
            flat, loss, accuracy = done[epoch]
            state = _State.of(flat)
        else:
            known = spark.sparkContext.broadcast(state.flat())  # three numbers a weight
            task = _epoch_task(known, like, epoch, batch, lr, gamma, alpha, dropout, seed, whole)
            sums = blocks.mapInArrow(task, _SUMS)
            if tasks > PARTIAL_SUMS:
                sums = sums.groupBy(F.pmod(F.monotonically_increasing_id(), F.lit(PARTIAL_SUMS))).applyInArrow(_add_up, _SUMS)
            parts = sums.collect()  # at most PARTIAL_SUMS states
            known.unpersist()
            rows = max(1, sum(r["rows"] for r in parts))
            if parts:
                mean = sum(np.frombuffer(r["state"], float) for r in parts) / rows
                if whole:
                    state.step(mean, lr)
                else:
                    state = _State.of(mean)
            loss, accuracy = sum(r["loss"] for r in parts) / rows, sum(r["hits"] for r in parts) / rows
            if restart:
                row = [(epoch, [float(v) for v in state.flat()], loss, accuracy)]
                spark.createDataFrame(row, _EPOCH).coalesce(1).write.mode("overwrite").parquet(f"{restart}/epoch={epoch}")
        snapshots.append(_unflatten(state.weights, like))
        progress.append((epoch, loss, accuracy))
    for frame in (blocks, slim):
        frame.unpersist()
    history = _history(spark, validation, snapshots, progress)
    best = one_row(best_epoch(history))["best_epoch"]
    return TrainedMlp(snapshots[best - 1], history, best)


_EPOCH = "number int, state array<double>, loss double, accuracy double"


def _epochs_done(spark: SparkSession, folder: str | None) -> dict[int, tuple[np.ndarray, float, float]]:
    """States written below ``folder`` by an earlier call, by epoch."""
    if not folder:
        return {}
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return {}
    rows = spark.read.schema(_EPOCH).parquet(folder).orderBy("number").collect()  # one per epoch
    return {r["number"]: (np.array(r["state"]), r["loss"], r["accuracy"]) for r in rows}


def _history(spark: SparkSession, validation: DataFrame, snapshots: list[Layers], progress) -> DataFrame:
    """Per-epoch training progress and validation metrics; all epochs are scored in one pass."""
    forwards, width = [forward_function(s) for s in snapshots], snapshots[0][0][0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = dense_rows(batch.column(1), width)
            for epoch, forward in enumerate(forwards, 1):
                p = 1.0 / (1.0 + np.exp(-forward(x)))
                columns = [pa.array(np.full(len(p), epoch, np.int32)), batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["epoch", "label", "prob", "pred"])

    slim = validation.filter(F.col("label").isNotNull()).select(
        F.col("label").cast("int").alias("label"), F.col("features").cast("array<double>").alias("features")
    )
    scored = slim.mapInArrow(run, "epoch int, label int, prob double, pred int")
    measured = all_metrics(freeze(scored), ["epoch"])
    trained = spark.createDataFrame(progress, "epoch int, train_loss double, train_accuracy double")
    return freeze(
        trained.join(measured, "epoch").select(
            "epoch",
            "train_loss",
            "train_accuracy",
            F.col("accuracy").alias("val_accuracy"),
            F.col("auc_roc").alias("val_auc_roc"),
            F.col("macro_f1").alias("val_macro_f1"),
            F.col("precision_fake").alias("val_precision_fake"),
            F.col("recall_fake").alias("val_recall_fake"),
        )
    )


def training_history(history: DataFrame) -> DataFrame:
    """Per-epoch long table ``(epoch, metric, value)``."""
    metrics = [c for c in history.columns if c != "epoch"]
    return history.unpivot(["epoch"], metrics, "metric", "value")


def best_epoch(history: DataFrame, metric: str = "val_auc_roc") -> DataFrame:
    """The first epoch with the highest validation metric."""
    best = F.max(F.struct(F.col(metric).alias("value"), (-F.col("epoch")).alias("e")))
    return history.agg(best.alias("b")).select((-F.col("b.e")).alias("best_epoch"), F.col("b.value").alias(metric))
