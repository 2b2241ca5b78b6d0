"""Linear learners by a distributed truncated Newton method.

Rows are packed once into sparse blocks that stay cached on the executors. A step asks all tasks for one sum: the loss and
gradient at some weights, or the product of the Hessian with some direction. Several problems on the same rows, such as
the folds of a calibrated machine, are solved side by side: every pass over a block serves all of them, and each has its
own step lengths and stops on its own. Only sums as long as the weights reach the driver.

Passes are what costs, so few are made. Up to :data:`HESSIAN_WIDTH` features the pass for the gradient adds up the whole
Hessian too, and a Newton step needs no other. Beyond, the conjugate gradients are preconditioned with the Hessian of a
bounded sample of rows, which the driver inverts; it only says in which order directions are tried, and the fit ends, as
without it, when the gradient of all rows has fallen.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOGISTIC, SQUARED_HINGE = "logistic", "squared hinge"
PARTIAL_SUMS = 16  # sums of tasks that the driver adds up itself
SLICE = 1 << 18  # numbers of a sum that are added up together beyond
ROWS_PER_TASK = 1000  # below this a task's start-up outweighs its work
MOST_ROWS = 500_000  # rows that a task holds at most
MOST_ENTRIES = 8_000_000  # entries that a task holds at most
BLOCK_ENTRIES = 500_000  # entries of a block
HESSIAN_WIDTH = 256  # features up to which Hessians are added up
SAMPLE_ROWS = 2000  # rows, about, whose Hessian stands for that of all in the preconditioner
SAMPLE_ENTRIES = 4_000_000  # entries, about, that they have at most
LEVEL = 1.0  # part of the weight that a sampled row stands for that is held to be chance
GRAM_COLUMNS = 2048  # features of the sample that are laid out at a time
CONJUGATE_STEPS = 60
HALVINGS = 30
CALIBRATED = 1e-12  # the gradient's fall at which a sigmoid is fitted: sums over all rows, so near rounding


@dataclass
class Rows:
    """Sparse rows: row ``i`` has ``value[first[i]:first[i + 1]]`` at the places ``index``."""

    first: np.ndarray
    index: np.ndarray
    value: np.ndarray

    def times(self, weights: np.ndarray) -> np.ndarray:
        """Inner products of all rows with each of ``weights`` (problems by rows); the last weight is the intercept."""
        out = np.repeat(weights[:, -1:], len(self.first) - 1, axis=1)
        some = np.flatnonzero(np.diff(self.first))
        if len(some):
            for k, w in enumerate(weights):
                out[k, some] += np.add.reduceat(self.value * w[self.index], self.first[some])
        return out

    def weighted(self, amounts: np.ndarray, size: int) -> np.ndarray:
        """Sums of the rows, each taken ``amounts`` times (problems by rows)."""
        row = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        out = np.empty((len(amounts), size))
        for k, a in enumerate(amounts):
            out[k, :-1] = np.bincount(self.index, weights=self.value * a[row], minlength=size - 1)
            out[k, -1] = a.sum()
        return out

    def taken(self, own: np.ndarray) -> Rows:
        """The rows numbered ``own``."""
        size = np.diff(self.first)[own]
        first = np.r_[0, np.cumsum(size)]
        at = np.repeat(self.first[own] - first[:-1], size) + np.arange(first[-1])
        return Rows(first, self.index[at], self.value[at])

    def products(self) -> np.ndarray:
        """Inner products of all pairs of rows, each with a last entry of 1 for the intercept."""
        count = len(self.first) - 1
        row = np.repeat(np.arange(count), np.diff(self.first))
        distinct, place = np.unique(self.index, return_inverse=True)
        order = np.argsort(place, kind="stable")
        ends = np.searchsorted(place[order], np.arange(0, len(distinct) + GRAM_COLUMNS, GRAM_COLUMNS))
        out = np.ones((count, count))
        for low, (start, stop) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            part = order[start:stop]
            cell = row[part] * GRAM_COLUMNS + place[part] - low * GRAM_COLUMNS
            dense = np.bincount(cell, self.value[part], count * GRAM_COLUMNS).reshape(count, GRAM_COLUMNS).astype(np.float32)
            out += dense @ dense.T
        return out

    def dense_parts(self, width: int) -> Iterator[tuple[slice, np.ndarray]]:
        """Runs of rows as matrices of at most :data:`BLOCK_ENTRIES` numbers or one row, with a last column of ones."""
        count, most = len(self.first) - 1, max(1, BLOCK_ENTRIES // (width + 1))
        for low in range(0, count, most):
            high = min(count, low + most)
            start, stop = self.first[low], self.first[high]
            row = np.repeat(np.arange(high - low), np.diff(self.first[low : high + 1]))
            cell = row * (width + 1) + self.index[start:stop]
            dense = np.bincount(cell, self.value[start:stop], (high - low) * (width + 1)).reshape(high - low, width + 1)
            dense[:, -1] = 1.0
            yield slice(low, high), dense


def sparse_rows(column: pa.Array) -> Rows:
    """Rows of a column of vectors or of arrays; what is null or NaN counts as 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_struct(column.type):
        kind = pc.fill_null(column.field("type"), 0).to_numpy(zero_copy_only=False)
        lists, places = column.field("values"), column.field("indices")
    else:
        kind, lists, places = np.ones(len(column), np.int8), column, None
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.r_[0, np.cumsum(size)]
    value = np.nan_to_num(lists.flatten().to_numpy(zero_copy_only=False).astype(float), nan=0.0)
    index = np.arange(len(value)) - np.repeat(first[:-1], size)
    if places is not None and (kind == 0).any():
        index[np.repeat(kind == 0, size)] = places.flatten().to_numpy(zero_copy_only=False)
    return Rows(first, index, value)


def _sizes(df: DataFrame, column: str = "features") -> tuple[int, int]:
    """The number of features, and of all rows' entries."""
    if isinstance(df.schema[column].dataType, VectorUDT):
        size = df.select(_length("size")(column).alias("n"), _length("entries")(column).alias("entries"))
    else:
        size = df.select(F.size(column).alias("n"), F.size(column).alias("entries"))
    found = size.agg(F.max("n").alias("n"), F.sum(F.greatest("entries", F.lit(0)).cast("long")).alias("entries")).collect()[0]
    return max(1, found["n"] or 1), found["entries"] or 0


def _length(what: str):
    @F.arrow_udf(T.IntegerType())
    def length(column: pa.Array) -> pa.Array:
        dense = pc.list_value_length(column.field("values"))
        return pc.cast(dense if what == "entries" else pc.coalesce(column.field("size"), dense), pa.int32())

    return length


def _pieces(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch cut so that a piece has at most ``most`` entries, or one row."""
    column = batch.column(2)
    lists = column.field("values") if pa.types.is_struct(column.type) else column
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, low = np.cumsum(size), 0
    while low < batch.num_rows:
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(low, high - low)
        low = high


def packed(train: DataFrame) -> tuple[DataFrame, int, np.ndarray]:
    """Cached blocks of ``(label, fold, features)``, the number of features, and rows by fold and label.

    Rows without a label take no part. Small tables take few tasks, and no task holds more than :data:`MOST_ROWS` rows or
    :data:`MOST_ENTRIES` entries, but for chance: all blocks of a task may reach Python at once.
    """
    spark = train.sparkSession
    if "fold" not in train.columns:
        train = train.withColumn("fold", F.lit(0))
    slim = train.filter(F.col("label").isNotNull()).select(F.col("label").cast("int").alias("label"), F.col("fold").cast("int").alias("fold"), "features")
    slim = slim.persist()
    counts = slim.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()  # folds times labels
    seen = np.zeros((max([r["fold"] for r in counts], default=0) + 1, 2))
    for r in counts:
        seen[r["fold"], r["label"]] = r["n"]
    rows = int(seen.sum())
    width, entries = _sizes(slim)
    # a task's sums are as long as the weights, however few its rows: no more tasks than can run at once
    usual = spark.sparkContext.defaultParallelism
    tasks = max(1, min(rows // ROWS_PER_TASK, usual), rows // MOST_ROWS, entries // MOST_ENTRIES)
    most = BLOCK_ENTRIES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch, most):
                found = sparse_rows(part.column(2))
                parts = (found.first.astype(np.int64), found.index.astype(np.int32), found.value)
                own = [part.column(c).to_numpy(zero_copy_only=False).astype(np.int32) for c in (0, 1)]
                blob = [pa.array([x.tobytes()], pa.binary()) for x in (*parts, *own)]
                yield pa.RecordBatch.from_arrays(blob, ["_first", "_index", "_value", "_label", "_fold"])

    blocks = slim.repartition(tasks).mapInArrow(run, "_first binary, _index binary, _value binary, _label binary, _fold binary")
    blocks = blocks.persist()
    blocks.count()
    slim.unpersist()
    return blocks, width, seen


def _block(batch: pa.RecordBatch, k: int) -> tuple[Rows, np.ndarray, np.ndarray]:
    kinds = (np.int64, np.int32, float, np.int32, np.int32)
    first, index, value, label, fold = (np.frombuffer(batch.column(c)[k].as_py(), kind) for c, kind in enumerate(kinds))
    return Rows(first, index.astype(np.intp), value), label, fold


def _margin_block(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    margin, label, fold = (np.frombuffer(batch.column(c)[k].as_py(), kind) for c, kind in enumerate((float, np.int32, np.int32)))
    return margin, label, fold


class Sums:
    """Adds up over all blocks what ``work(rows, label, fold, *known)`` gives for each: a flat array of ``length`` numbers.

    ``decode`` reads ``rows``, ``label`` and ``fold`` of a block.
    """

    def __init__(self, blocks: DataFrame, decode: Callable[[pa.RecordBatch, int], tuple] = _block):
        self.blocks, self.decode = blocks, decode
        self.many = blocks.rdd.getNumPartitions() > PARTIAL_SUMS

    def __call__(self, length: int, work: Callable[..., np.ndarray], *known) -> np.ndarray:
        context = self.blocks.sparkSession.sparkContext
        shared = context.broadcast(known)  # as long as the weights: problems times features
        decode = self.decode

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for k in range(batch.num_rows):
                    part = work(*decode(batch, k), *shared.value)
                    total = part if total is None else total + part
            if total is not None:
                for low in range(0, len(total), SLICE):
                    blob = pa.array([total[low : low + SLICE].tobytes()], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([low // SLICE], pa.int32()), blob], ["part", "sums"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_buffer(), float) for x in table.column("sums"))
            return pa.Table.from_arrays([table.column("part").slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])

        sums = self.blocks.mapInArrow(run, "part int, sums binary")
        if self.many:
            sums = sums.groupBy("part").applyInArrow(add, "part int, sums binary")
        found: dict[int, np.ndarray] = {}
        for r in sums.collect():  # at most PARTIAL_SUMS sums
            part = np.frombuffer(r["sums"], float)
            found[r["part"]] = found[r["part"]] + part if r["part"] in found else part
        shared.unpersist()
        return np.concatenate([found[k] for k in sorted(found)]) if found else np.zeros(length)


def _shares(label: np.ndarray, fold: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """What each row counts in each problem; a problem leaves out the fold of its number (from 1), if there are folds."""
    out = classes[:, label]
    for k in range(len(classes)):
        out[k, fold == k + 1] = 0.0
    return out


def _slopes(loss: str, margin: np.ndarray, label: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, its derivative and curvature by the margin, all weighted."""
    sign = 2.0 * label - 1.0
    towards = sign * margin
    if loss == SQUARED_HINGE:
        gap = np.maximum(0.0, 1.0 - towards)
        return share * gap * gap, -2.0 * share * sign * gap, 2.0 * share * (gap > 0)
    wrong = 0.5 * (1.0 - np.tanh(0.5 * towards))  # 1 / (1 + exp(towards)), without overflow
    return share * np.logaddexp(0.0, -towards), -share * sign * wrong, share * wrong * (1.0 - wrong)


def minimise(
    value: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], curve: Callable[[np.ndarray, np.ndarray], np.ndarray], shape: tuple[int, int],
    max_iter: int, tolerance: float, near: Callable[[np.ndarray, np.ndarray], Callable[[np.ndarray], np.ndarray]] | None = None,
) -> np.ndarray:
    """Minimum of each of several smooth convex functions: a row of weights for each.

    ``value`` gives values and gradients, ``curve`` products of the Hessians with directions. Directions come from
    conjugate gradients, cut off early as long as the gradient is large; a problem is done when its gradient has fallen to
    ``tolerance`` times the first one. ``near(weights, active)`` gives the product with about the Hessians' inverses, to
    precondition them.
    """
    weights = np.zeros(shape)
    now, slope = value(weights)
    start = np.linalg.norm(slope, axis=1)
    for _ in range(max_iter):
        size = np.linalg.norm(slope, axis=1)
        active = size > tolerance * np.maximum(start, 1e-300)
        if not active.any():
            break
        limit = np.minimum(0.1, np.sqrt(size / np.maximum(start, 1e-300))) * size
        inverse = near(weights, active) if near else np.copy
        move, rest = np.zeros(shape), np.where(active[:, None], -slope, 0.0)
        way = inverse(rest)
        square, live = (rest * way).sum(axis=1), active.copy()
        for _ in range(CONJUGATE_STEPS):
            bent = curve(weights, way)
            length = np.where(live, square / np.maximum((way * bent).sum(axis=1), 1e-300), 0.0)
            move += length[:, None] * way
            rest = rest - length[:, None] * bent
            live &= np.linalg.norm(rest, axis=1) > limit
            if not live.any():
                break
            eased = inverse(rest)
            fresh = (rest * eased).sum(axis=1)
            way = np.where(live[:, None], eased + (fresh / np.maximum(square, 1e-300))[:, None] * way, 0.0)
            square = fresh
        drop, step, open_ = (slope * move).sum(axis=1), np.where(active, 1.0, 0.0), active.copy()
        for _ in range(HALVINGS):
            trial = weights + step[:, None] * move
            then, bent = value(trial)
            good = open_ & (then <= now + 1e-4 * step * drop + 1e-12 * np.abs(now))
            weights[good], slope[good], now[good] = trial[good], bent[good], then[good]
            open_ &= ~good
            if not open_.any():
                break
            step = np.where(open_, step / 2, 0.0)
        if open_[active].all():  # no descent within rounding
            break
    return weights


def _sample(blocks: DataFrame) -> tuple[Rows, np.ndarray, np.ndarray, float]:
    """Some rows of all blocks, drawn by chance, their labels and folds, and the share of all rows that they are, about."""
    rows, entries = Sums(blocks)(2, lambda rows, label, fold: np.array([len(label), len(rows.index)], float))
    share = min(1.0, SAMPLE_ROWS / max(1.0, rows), SAMPLE_ENTRIES / max(1.0, entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, label, fold = _block(batch, k)
                own = np.flatnonzero(np.random.default_rng(zlib.crc32(rows.value.tobytes())).random(len(label)) < share)
                some = rows.taken(own)
                parts = (np.diff(some.first), some.index, some.value, label[own].astype(np.int64), fold[own].astype(np.int64))
                blob = [pa.array([x.tobytes()], pa.binary()) for x in parts]
                yield pa.RecordBatch.from_arrays(blob, ["_size", "_index", "_value", "_label", "_fold"])

    drawn = blocks.mapInArrow(run, "_size binary, _index binary, _value binary, _label binary, _fold binary").toArrow()
    kinds = (np.int64, np.int64, float, np.int64, np.int64)
    size, index, value, label, fold = (
        np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in drawn.column(c)] or [np.zeros(0, kind)]) for c, kind in enumerate(kinds)
    )
    return Rows(np.r_[0, np.cumsum(size)], index, value), label, fold, share


def _sampled_inverse(blocks: DataFrame, loss: str, classes: np.ndarray, ridge: np.ndarray):
    """For :func:`minimise`: products with the inverse of the sample's Hessian, scaled up to all rows.

    The inverse is that of a multiple of the identity plus the sample's part (a matrix of the sample's rows is inverted,
    not one of the features). The multiple is what a row of the sample stands for beyond itself, besides the penalty of 1.
    """
    rows, label, fold, share = _sample(blocks)
    products, counts = rows.products(), _shares(label, fold, classes) / share
    size = len(ridge)

    def near(weights: np.ndarray, active: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        bent = _slopes(loss, rows.times(weights), label, counts)[2]
        parts = {}
        for k in np.flatnonzero(active):
            own = np.flatnonzero(bent[k] > 0)
            root = np.sqrt(bent[k, own])
            inner = products[np.ix_(own, own)] * root * root[:, None]
            level = 1.0 + (1.0 - share) * LEVEL * (inner.diagonal().mean() if len(own) else 0.0)
            inner[np.diag_indices(len(own))] += level
            parts[k] = (rows.taken(own), root, np.linalg.inv(inner), level)

        def inverse(rest: np.ndarray) -> np.ndarray:
            out = np.zeros_like(rest)
            for k, (some, root, inner, level) in parts.items():
                out[k] = rest[k] / level
                if len(root):
                    amounts = root * (inner @ (root * some.times(rest[k : k + 1])[0]))
                    out[k] -= some.weighted(amounts[None, :], size)[0] / level
            return out

        return inverse

    return near


def solve(blocks: DataFrame, width: int, loss: str, classes: np.ndarray, penalised: bool, max_iter: int, tolerance: float) -> np.ndarray:
    """Weights (the intercept last) with the least ``|w|^2 / 2`` plus weighted losses, a row for each row of ``classes``.

    ``classes`` holds what a row of each label counts in each problem. ``penalised`` counts the intercept among ``w``.
    """
    sums = Sums(blocks)
    size, count = width + 1, len(classes)
    ridge = np.ones(size)
    ridge[-1] = float(penalised)
    small = width <= HESSIAN_WIDTH
    hessians: dict[tuple[int, bytes], np.ndarray] = {}  # of the latest places, by problem

    def at(rows: Rows, label: np.ndarray, fold: np.ndarray, weights: np.ndarray) -> np.ndarray:
        losses, slopes, bent = _slopes(loss, rows.times(weights), label, _shares(label, fold, classes))
        parts = [losses.sum(axis=1), rows.weighted(slopes, size).ravel()]
        if small:
            whole = np.zeros((count, size, size))
            for own, dense in rows.dense_parts(width):
                for k in range(count):
                    whole[k] += (dense * bent[k, own, None]).T @ dense
            parts.append(whole.ravel())
        return np.concatenate(parts)

    def bend(rows: Rows, label: np.ndarray, fold: np.ndarray, weights: np.ndarray, way: np.ndarray) -> np.ndarray:
        open_ = np.flatnonzero(way.any(axis=1))  # problems that are done have no direction
        out = np.zeros((len(classes), size))
        curvature = _slopes(loss, rows.times(weights[open_]), label, _shares(label, fold, classes)[open_])[2]
        out[open_] = rows.weighted(curvature * rows.times(way[open_]), size)
        return out.ravel()

    def value(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = sums(count + count * size * (1 + small * size), at, weights)
        if small:
            for k, whole in enumerate(found[count + count * size :].reshape(count, size, size)):
                hessians[k, weights[k].tobytes()] = whole + np.diag(ridge)
        losses, slopes = found[:count], found[count : count + count * size].reshape(count, size)
        return losses + 0.5 * (ridge * weights * weights).sum(axis=1), slopes + ridge * weights

    def curve(weights: np.ndarray, way: np.ndarray) -> np.ndarray:
        if small:
            return np.stack([hessians[k, weights[k].tobytes()] @ way[k] for k in range(count)])
        return sums(way.size, bend, weights, way).reshape(way.shape) + ridge * way

    def exact(weights: np.ndarray, active: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        kept = [(k, weights[k].tobytes()) for k in range(count)]
        for key in set(hessians) - set(kept):
            del hessians[key]
        inverses = np.stack([np.linalg.pinv(hessians[key], hermitian=True) for key in kept])
        return lambda rest: np.einsum("kij,kj->ki", inverses, rest)

    near = exact if small else _sampled_inverse(blocks, loss, classes, ridge)
    return minimise(value, curve, (count, size), max_iter, tolerance, near)


def balanced(counts: np.ndarray) -> np.ndarray:
    """What a row of each label counts so that both labels weigh the same and all rows together their number."""
    return counts.sum(axis=-1, keepdims=True) / (2.0 * np.maximum(counts, 1.0))


def platt(blocks: DataFrame, weights: np.ndarray, counts: np.ndarray, max_iter: int = 100) -> np.ndarray:
    """Slope and offset of each problem's sigmoid, fitted to its margins on the fold that it left out.

    Targets are Platt's: ``(n1 + 1) / (n1 + 2)`` and ``1 / (n0 + 2)`` with the fold's counts of the labels. The rows are
    read once, for their margins; every step then reads a number a row, and its one pass gives the Hessian too.
    """
    goals = np.stack([1.0 / (counts[:, 0] + 2.0), (counts[:, 1] + 1.0) / (counts[:, 1] + 2.0)], 1)
    problems = len(weights)
    known = blocks.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, label, fold = _block(batch, k)
                own = np.flatnonzero((fold >= 1) & (fold <= problems))
                margin = rows.times(known.value)[fold[own] - 1, own]
                blob = [pa.array([x.tobytes()], pa.binary()) for x in (margin, label[own], fold[own])]
                yield pa.RecordBatch.from_arrays(blob, ["_margin", "_label", "_fold"])

    margins = blocks.mapInArrow(run, "_margin binary, _label binary, _fold binary").persist()
    sums = Sums(margins, _margin_block)

    def work(margin: np.ndarray, label: np.ndarray, fold: np.ndarray, curves: np.ndarray) -> np.ndarray:
        own = fold[None, :] == np.arange(1, problems + 1)[:, None]
        z = curves[:, :1] * margin + curves[:, 1:]
        p = 0.5 * (1.0 + np.tanh(0.5 * z))
        goal = goals[:, label]
        error, bent = own * (p - goal), own * p * (1.0 - p)
        parts = (own * (np.logaddexp(0.0, z) - goal * z), error * margin, error, bent * margin * margin, bent * margin, bent)
        return np.concatenate([part.sum(axis=1) for part in parts])

    hessians: dict[tuple, np.ndarray] = {}  # of the places tried so far, by problem: two numbers each way

    def value(curves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        loss, by_slope, by_offset, *bent = sums(6 * problems, work, curves).reshape(6, problems)
        for k in range(problems):
            hessians[k, *curves[k].tolist()] = np.array([[bent[0][k], bent[1][k]], [bent[1][k], bent[2][k]]])
        return loss, np.stack([by_slope, by_offset], 1)

    def curve(curves: np.ndarray, way: np.ndarray) -> np.ndarray:
        return np.stack([hessians[k, *curves[k].tolist()] @ way[k] for k in range(problems)]) + 1e-12 * way

    curves = minimise(value, curve, (problems, 2), max_iter, CALIBRATED)
    margins.unpersist()
    return curves


def margins(df: DataFrame, weights: np.ndarray, column: str = "features") -> DataFrame:
    """Add ``_margins``: an array with each problem's margin."""
    known = df.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def margin(features: pa.Array) -> pa.Array:
        rows = sparse_rows(features)
        inside = rows.index < known.value.shape[1] - 1  # places beyond the training vectors weigh nothing
        kept = Rows(np.r_[0, np.cumsum(inside)][rows.first], rows.index[inside], rows.value[inside])
        found = np.ascontiguousarray(kept.times(known.value).T)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))

    features = F.col(column) if isinstance(df.schema[column].dataType, VectorUDT) else F.col(column).cast("array<double>")
    return df.withColumn("_margins", margin(features))
