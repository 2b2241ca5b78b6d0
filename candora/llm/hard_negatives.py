"""Hard negatives by shared candidate lists: exact inner-product search for all anchors of a cluster over one sorted list.

Vectors are integers. Anchors are clustered by direction (spherical k-means on a bounded sample; every anchor is then
put into its nearest cluster). No row can score more with any anchor ``u`` of a cluster than ``|u| |i| cos(t - r)``,
where ``t`` is the row's angle to the cluster's centre and ``r`` the largest angle of an anchor to it (0 for rows
inside that cone). Each cluster's list holds all rows by falling ``|i| cos(t - r)``, cut into bins by quantiles and the
bins into blocks of bounded size; it is sorted and written once. All anchors of the cluster walk it from the top, in
rounds that take four times more of it each, and leave it when nothing below can enter their result: the smaller of the
list's bound and the bound from the anchor's own angle lies below the score that it still has to beat. Bins whose own
bound is too low for an anchor are not visited. Bounds carry a slack far above the error of floating point, and scores
are exact integers, so results don't depend on clusters, bins or rounds.

The list is walked twice: for the best rows of the anchor's label, then for the best rows of other labels inside the
window of scores that each of these positives opens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candora.llm import tokens
from candora.llm.shared import over_batches, stored, stored_chunks

CLUSTERS = 8
SAMPLE = 4096  # anchors that place the centres
BLOCK = 8192  # rows of a block of a list
BINS = 1024  # bins of a list at most: the driver knows each
GROWTH = 4  # a round takes so many times the rows of all rounds before
PART = 100_000  # anchors that visit a block in one task
VISITS = 200_000  # visits of blocks that a task lays out at a time
SLACK = 1e-6  # added to cosines: above the error of an angle near 0 (2e-8)
_LOW, _HIGH = -(1 << 62), 1 << 62


def encode(matrix: np.ndarray) -> pa.Array:
    """Integer vectors, each in the narrowest width that holds it, after one byte naming the width."""
    top = np.abs(matrix).max(axis=1, initial=0)
    width = np.select([top < 1 << 7, top < 1 << 15, top < 1 << 31], [1, 2, 4], 8)
    parts, rows = [], []
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        body = np.ascontiguousarray(matrix[own].astype(f"<i{w}")).view(np.uint8).reshape(len(own), -1)
        flat = np.hstack([np.full((len(own), 1), w, np.uint8), body])
        ends = np.arange(len(own) + 1, dtype=np.int32) * flat.shape[1]
        parts.append(pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))]))
        rows.append(own)
    if not parts:
        return pa.array([], pa.binary())
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(rows), kind="stable")))


def decode(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of :func:`encode`, missing components as 0."""
    data, offsets = tokens.buffers(column)
    out = np.zeros((len(column), dim), np.int64)
    if not len(column):
        return out
    size, width = np.diff(offsets) - 1, data[offsets[:-1]].astype(np.int64)
    for w, n in np.unique(np.stack([width, size]), axis=1).T:
        own = np.flatnonzero((width == w) & (size == n))
        body = data[(offsets[own] + 1)[:, None] + np.arange(n)]
        out[own, : n // w] = np.ascontiguousarray(body).view(f"<i{w}")
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors (beyond 2^62 they count as that); no partial sum passes the norms' product."""
    most = _norms(a).max(initial=0) * _norms(b).max(initial=0)
    if most < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 1 << 62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, _LOW + 1, _HIGH - 1).astype(np.int64)


def _norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m.astype(float) ** 2).sum(axis=1))


def _angles(m: np.ndarray, norm: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Angle of every vector to every centre (unit length); 0 for vectors of length 0, which bounds them."""
    cosine = (m.astype(float) @ centres.T) / np.where(norm > 0, norm, 1.0)[:, None]
    return np.where(norm[:, None] > 0, np.arccos(np.clip(cosine, -1, 1)), 0.0)


def fit_centres(vectors: np.ndarray, clusters: int, rounds: int = 12) -> np.ndarray:
    """Directions of clusters by spherical k-means; the start is the first vector, then the one farthest from all chosen."""
    norm = _norms(vectors)
    unit = np.unique(vectors[norm > 0] / norm[norm > 0, None], axis=0)
    if not len(unit):
        return np.eye(1, max(1, vectors.shape[1]))
    centres = unit[:1]
    while len(centres) < min(clusters, len(unit)):
        centres = np.vstack([centres, unit[np.argmin((unit @ centres.T).max(axis=1))]])
    for _ in range(rounds):
        own = (unit @ centres.T).argmax(axis=1)
        sums = np.stack([unit[own == c].sum(axis=0) for c in range(len(centres))])
        length = _norms(sums)
        centres = np.where(length[:, None] > 1e-9, sums / np.maximum(length, 1e-9)[:, None], centres)
    return centres


def _vectors(rows: DataFrame, scale: int) -> tuple[DataFrame, int]:
    """Usable rows with integer vectors (``_v``), and the number of components of the longest."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    usable = rows.filter(F.col("_label").isNotNull() & F.col("_x").isNotNull()).filter(~F.exists("_x", bad))
    dim = usable.agg(F.max(F.size("_x")).alias("d")).collect()[0]["d"] or 1
    dim = max(1, dim)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("_x")
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        whole = np.zeros((batch.num_rows, dim))
        row = np.repeat(np.arange(batch.num_rows), size)
        whole[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = np.floor(scale * flat)
        whole = np.clip(whole, _LOW, _HIGH).astype(np.int64)
        kept = [batch.column(c) for c in ("_id", "_label", "_anchor")]
        return pa.RecordBatch.from_arrays([*kept, encode(whole)], ["_id", "_label", "_anchor", "_v"])

    out = over_batches(usable.select("_id", "_label", "_anchor", "_x"), work, "_id long, _label long, _anchor boolean, _v binary")
    return stored(out.withColumn("_row", F.monotonically_increasing_id()), "vectors"), dim


@dataclass
class Lists:
    """What the driver knows of the clusters' lists: one entry per bin, in the order of the walk."""

    centres: np.ndarray
    spread: np.ndarray  # per cluster: largest angle of an anchor to its centre
    edges: list[np.ndarray]  # per cluster: falling lower ends of all bins but the last
    cluster: np.ndarray
    top: np.ndarray  # largest bound per unit of an anchor's length
    angle: np.ndarray  # smallest angle to the centre
    norm: np.ndarray  # largest length
    blocks: np.ndarray
    first: np.ndarray  # number of the bin's first block
    round: np.ndarray

    def rounds(self) -> int:
        return int(self.round.max(initial=-1)) + 1

    def bound(self, bins: np.ndarray, norm: float, angle: float) -> np.ndarray:
        """What an anchor can score at most in each of ``bins`` of its cluster's list."""
        own = np.cos(np.clip(self.angle[bins] - angle, 0, np.pi)).clip(0) + SLACK
        return norm * np.minimum(self.top[bins], self.norm[bins] * own)


def _keys(lists_centres: np.ndarray, spread: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bound per unit of an anchor's length for every row and cluster, angles, lengths."""
    norm = _norms(m)
    angle = _angles(m, norm, lists_centres)
    return norm[:, None] * (np.cos(np.clip(angle - spread, 0, np.pi)) + SLACK), angle, norm


def _bin_of(edges: np.ndarray, key: np.ndarray) -> np.ndarray:
    return np.searchsorted(-edges, -key, "left")


def _plan(vectors: DataFrame, dim: int, centres: np.ndarray, spread: np.ndarray, block: int) -> Lists:
    """Cut every cluster's list into bins by quantiles of the bound, and count what they hold."""
    names = [f"_k{c}" for c in range(len(centres))]

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        key = _keys(centres, spread, decode(batch.column(0), dim))[0]
        return pa.RecordBatch.from_arrays([pa.array(key[:, c]) for c in range(len(centres))], names)

    count = vectors.count()
    bins = int(min(BINS, max(1, -(-count // block))))
    edges = [np.zeros(0)] * len(centres)
    if bins > 1:
        probs = [1 - k / bins for k in range(1, bins)]
        row = over_batches(vectors.select("_v"), keys, ", ".join(f"{n} double" for n in names))
        found = row.agg(*[F.percentile_approx(n, probs, 10 * bins).alias(n) for n in names]).collect()[0]
        edges = [np.unique(np.array(found[n]))[::-1] for n in names]

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, angle, norm = _keys(centres, spread, decode(batch.column(0), dim))
        out = []
        for c in range(len(centres)):
            place = _bin_of(edges[c], key[:, c])
            for b in np.unique(place):
                own = place == b
                out.append((c, int(b), int(own.sum()), float(key[own, c].max()), float(angle[own, c].min()), float(norm[own].max())))
        columns = list(zip(*out, strict=True))
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["c", "b", "n", "top", "angle", "norm"])

    small = over_batches(vectors.select("_v"), measure, "c int, b int, n long, top double, angle double, norm double")
    sums = [F.sum("n").alias("n"), F.max("top").alias("top"), F.min("angle").alias("angle"), F.max("norm").alias("norm")]
    rows = sorted(small.groupBy("c", "b").agg(*sums).collect())  # a row per bin: at most CLUSTERS * BINS
    table = [np.array([r[k] for r in rows]) for k in ("c", "b", "n", "top", "angle", "norm")]
    cluster, size = table[0].astype(np.int64), table[2].astype(np.int64)
    blocks = -(-size // block)
    rounds = np.zeros(len(rows), np.int64)
    for c in np.unique(cluster):
        own = np.flatnonzero(cluster == c)
        before = np.cumsum(size[own]) - size[own]
        rounds[own] = np.searchsorted(block * GROWTH ** np.arange(64, dtype=float), before, "right")
    return Lists(centres, spread, edges, cluster, table[3], table[4], table[5], blocks, np.cumsum(blocks) - blocks, rounds)


def _blocks(vectors: DataFrame, dim: int, lists: Lists) -> DataFrame:
    """The lists, a row per block: ids (ascending, nulls last), labels and vectors."""
    places = [np.flatnonzero(lists.cluster == c) for c in range(len(lists.centres))]

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        key = _keys(lists.centres, lists.spread, decode(batch.column("_v"), dim))[0]
        number = batch.column("_row").to_numpy(zero_copy_only=False)
        chunk = []
        for c, own in enumerate(places):
            entry = own[_bin_of(lists.edges[c], key[:, c])]
            chunk.append(lists.first[entry] + number % lists.blocks[entry])
        take = pa.array(np.tile(np.arange(batch.num_rows), len(places)))
        kept = [batch.column(c).take(take) for c in ("_id", "_label", "_v")]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(chunk)), *kept], ["_chunk", "_id", "_label", "_v"])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_id", "ascending")]).combine_chunks()
        chunk = table.column("_chunk")[0].as_py()
        entry = int(np.searchsorted(lists.first, chunk, "right")) - 1
        ids, labels, vectors = (table.column(c).combine_chunks() for c in ("_id", "_label", "_v"))
        whole = pa.array(np.array([0, len(ids)], np.int32))
        columns = [pa.array([chunk]), pa.array([int(lists.round[entry])], pa.int32())]
        columns += [pa.ListArray.from_arrays(whole, x) for x in (ids, labels, vectors)]
        return pa.Table.from_arrays(columns, ["_chunk", "_round", "_ids", "_labels", "_vectors"])

    dealt = over_batches(vectors.select("_row", "_id", "_label", "_v"), deal, "_chunk long, _id long, _label long, _v binary")
    schema = "_chunk long, _round int, _ids array<long>, _labels array<long>, _vectors array<binary>"
    return stored_chunks(dealt.groupBy("_chunk").applyInArrow(pack, schema), "lists")


def best_in_windows(
    anchors: np.ndarray, rows: np.ndarray, allowed, low: np.ndarray, high: np.ndarray, top: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per anchor and window the ``top`` rows of highest score inside it, equal scores by row.

    ``low`` and ``high`` have a column per window; ``allowed(a)`` says which rows may count for the anchors of slice ``a``.
    Result: anchor, window, row and score of each hit.
    """
    out = []
    for begin in range(0, len(anchors), 256):
        part = slice(begin, begin + 256)
        score = scores(anchors[part], rows)
        wide = allowed(part) & (score >= low[part].min(axis=1)[:, None]) & (score <= high[part].max(axis=1)[:, None])
        who, where = np.nonzero(wide)
        value = score[who, where]
        order = np.lexsort((where, -value, who))
        who, where, value = who[order], where[order], value[order]
        for window in range(low.shape[1]):
            inside = (value >= low[part][who, window]) & (value <= high[part][who, window])
            own = who[inside]
            if not len(own):
                continue
            start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            place = np.arange(len(own)) - np.repeat(start, np.diff(np.r_[start, len(own)]))
            keep = place < top
            out.append((own[keep] + begin, np.full(keep.sum(), window), where[inside][keep], value[inside][keep]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *(o[k] for o in out)]).astype(np.int64) for k in range(4))


def _visits(open_anchors: DataFrame, lists: Lists, number: int, parts: int) -> DataFrame:
    """Every open anchor once per block of the round that may hold something for it."""
    places = [np.flatnonzero((lists.cluster == c) & (lists.round == number)) for c in range(len(lists.centres))]
    names = ["_a", "_id", "_label", "_v", "_lo", "_hi"]

    def laid_out(batch: pa.RecordBatch, rows: np.ndarray, blocks: np.ndarray) -> Iterator[pa.RecordBatch]:
        for begin in range(0, len(rows), 10_000):
            take = pa.array(rows[begin : begin + 10_000])
            part = pc.take(batch.column("_a"), take).to_numpy(zero_copy_only=False) % parts
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks[begin : begin + 10_000]), pa.array(part.astype(np.int32)), *(batch.column(c).take(take) for c in names)],
                ["_chunk", "_part", *names],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clusters, norms, angles = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_cluster", "_norm", "_angle"))
            least = np.array([min(x) for x in batch.column("_lo").to_pylist()])
            who, chunk, held = [], [], 0
            for k in range(batch.num_rows):
                bins = places[clusters[k]]
                bins = bins[lists.bound(bins, norms[k], angles[k]) >= least[k]]
                for b in bins:
                    chunk.append(np.arange(lists.first[b], lists.first[b] + lists.blocks[b]))
                    who.append(np.full(int(lists.blocks[b]), k))
                    held += int(lists.blocks[b])
                if held >= VISITS:
                    yield from laid_out(batch, np.concatenate(who), np.concatenate(chunk))
                    who, chunk, held = [], [], 0
            if held:
                yield from laid_out(batch, np.concatenate(who), np.concatenate(chunk))

    schema = "_chunk long, _part int, _a long, _id long, _label long, _v binary, _lo array<long>, _hi array<long>"
    return open_anchors.mapInArrow(run, schema)


def _walk(
    anchors: DataFrame, blocks: DataFrame, lists: Lists, dim: int, top: int, same: bool, part_size: int
) -> DataFrame | None:
    """``_a``, ``_window``, ``_place`` (from 1), ``_other`` and ``_score``: the ``top`` rows in each window of each anchor.

    ``anchors`` carry windows ``_lo`` and ``_hi`` (arrays of equal length, the inclusive ends). ``same`` asks for rows of
    the anchor's label and another id, else for rows of other labels.
    """

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        hits = []
        if left.num_rows and right.num_rows:
            ids, labels, vectors = (left.column(c).combine_chunks().flatten() for c in ("_ids", "_labels", "_vectors"))
            matrix, label = decode(vectors, dim), labels.to_numpy(zero_copy_only=False)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            number = ids.fill_null(0).to_numpy(zero_copy_only=False)
            right = right.combine_chunks()
            own, mine = decode(right.column("_v").combine_chunks(), dim), right.column("_label").to_numpy()
            own_id = right.column("_id").to_numpy()
            low, high = (np.array(right.column(c).to_pylist(), np.int64) for c in ("_lo", "_hi"))

            def allowed(part: slice) -> np.ndarray:
                equal = mine[part][:, None] == label
                return equal & ((own_id[part][:, None] != number) | ~known) if same else ~equal

            who, window, row, score = best_in_windows(own, matrix, allowed, low, high, top)
            hits = [
                right.column("_a").combine_chunks().take(pa.array(who)), pa.array(window.astype(np.int32)), ids.take(pa.array(row)),
                pa.array(score),
            ]
        names, kinds = ["_a", "_window", "_other", "_score"], [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays(hits or [pa.array([], k) for k in kinds], names)

    spark = anchors.sparkSession
    order = [F.desc("_score"), F.asc_nulls_last("_other")]
    ranked = Window.partitionBy("_a", "_window").orderBy(*order)
    found, opened = None, anchors
    for number in range(lists.rounds()):
        size = opened.count()
        if not size:
            break
        parts = -(-size // part_size)
        table = blocks.filter(F.col("_round") == number)
        keys = ["_chunk"]
        if parts > 1:  # a block meets the anchors in several tasks
            table = table.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
            keys = ["_chunk", "_part"]
        visits = _visits(opened, lists, number, parts)
        schema = "_a long, _window int, _other long, _score long"
        hits = table.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(meet, schema)
        if found is not None:
            hits = hits.unionByName(found.drop("_place"))
        hits = hits.withColumn("_place", F.row_number().over(ranked)).filter(F.col("_place") <= top)
        found = stored(hits, "found")
        if number + 1 < lists.rounds():
            opened = stored(_still_open(opened, found, lists, number, top), "open")
    return found if found is not None else spark.createDataFrame([], "_a long, _window int, _other long, _score long, _place int")


def _still_open(opened: DataFrame, found: DataFrame, lists: Lists, number: int, top: int) -> DataFrame:
    """Anchors that rows below this round may still concern, with the least scores that count from now on."""
    full = found.groupBy("_a", "_window").agg(F.count(F.lit(1)).alias("n"), F.min("_score").alias("s")).filter(F.col("n") == top)
    reached = full.groupBy("_a").agg(F.map_from_entries(F.collect_list(F.struct("_window", "s"))).alias("_reached"))  # a few windows
    joined = opened.join(reached, "_a", "left")
    low = F.transform("_lo", lambda x, i: F.greatest(x, F.coalesce(F.col("_reached")[i.cast("int")], x)))
    joined = joined.withColumn("_lo", F.when(F.col("_reached").isNull(), F.col("_lo")).otherwise(low)).drop("_reached")
    rest = [np.flatnonzero((lists.cluster == c) & (lists.round > number)) for c in range(len(lists.centres))]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        clusters, norms, angles = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_cluster", "_norm", "_angle"))
        lows, highs = batch.column("_lo").to_pylist(), batch.column("_hi").to_pylist()
        keep = []
        for c, norm, angle, low, high in zip(clusters, norms, angles, lows, highs, strict=True):
            most = lists.bound(rest[c], norm, angle).max(initial=-np.inf)
            keep.append(any(a <= b and most >= a for a, b in zip(low, high, strict=True)))
        return batch.filter(pa.array(keep, pa.bool_()))

    return over_batches(joined, work, joined.schema)


def mine(
    rows: DataFrame,
    anchor: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    clusters: int = CLUSTERS,
    block: int = BLOCK,
    part_size: int = PART,
) -> DataFrame:
    """For each anchor and each of its ``positives`` best rows of the same label, the ``negatives`` best rows of other labels.

    A negative's score lies between ``low`` and ``high`` percent of the positive's. Columns: ``anchor_id``,
    ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``. Components become
    ``floor(scale * x)``; scores are integer inner products, higher first, equal ones by smaller id (null last). Rows with
    a null label or vector, or a null or non-finite component, take no part. Shorter vectors are filled up with zeros.
    Components and scores beyond 2^62 in size count as 2^62. Ids and labels are integers. ``anchor`` is a condition on ``rows``; null is false, and rows without an id are no
    anchors. Rows with repeated ids all count, each repeated anchor is an anchor, and a row with an anchor's id is no
    positive of it. Other columns don't matter. Empty tables give an empty result.
    """
    spark = rows.sparkSession
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    source = rows.select(
        F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("long").alias("_label"),
        (F.coalesce(anchor, F.lit(False)) & F.col(id_col).isNotNull()).alias("_anchor"), F.col(vector_col).cast("array<double>").alias("_x"),
    )
    vectors, dim = _vectors(source, scale)
    own = vectors.filter("_anchor")
    sample = own.orderBy(F.xxhash64("_row")).limit(SAMPLE).select("_v").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], empty)
    centres = fit_centres(decode(sample.column(0).combine_chunks(), dim), clusters)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        matrix = decode(batch.column("_v"), dim)
        norm = _norms(matrix)
        angle = _angles(matrix, norm, centres)
        cluster = angle.argmin(axis=1)
        more = [pa.array(cluster.astype(np.int32)), pa.array(norm), pa.array(angle[np.arange(len(cluster)), cluster])]
        kept = [batch.column(c) for c in ("_row", "_id", "_label", "_v")]
        return pa.RecordBatch.from_arrays([*kept, *more], ["_a", "_id", "_label", "_v", "_cluster", "_norm", "_angle"])

    schema = "_a long, _id long, _label long, _v binary, _cluster int, _norm double, _angle double"
    placed = stored(over_batches(own.select("_row", "_id", "_label", "_v"), place, schema), "anchors")
    spread = np.zeros(len(centres))
    for r in placed.groupBy("_cluster").agg(F.max("_angle").alias("a")).collect():  # a row per cluster
        spread[r["_cluster"]] = r["a"]
    lists = _plan(vectors, dim, centres, spread, block)
    blocks = _blocks(vectors, dim, lists)

    ends = lambda x: F.array(F.lit(x).cast("long"))
    first = _walk(placed.withColumn("_lo", ends(_LOW)).withColumn("_hi", ends(_HIGH)), blocks, lists, dim, positives, True, part_size)
    # ceil(low * p / 100) and floor(high * p / 100) without a product beyond 64 bits; p is split at 100
    hundreds, rest = F.floor(F.col("_score") / F.lit(100).cast("decimal(3,0)")).cast("long"), F.pmod("_score", F.lit(100).cast("long"))
    least = hundreds * low + F.ceil(rest * low / 100).cast("long")
    most = hundreds * high + F.floor(rest * high / 100).cast("long")
    windows = first.withColumn("_least", least).withColumn("_most", most)
    opened = windows.groupBy("_a").agg(F.sort_array(F.collect_list(F.struct("_place", "_least", "_most"))).alias("_w"))  # a few positives
    fill = lambda name, x: F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.get(F.col("_w")[name], i - 1), F.lit(x).cast("long")))
    opened = opened.withColumn("_lo", fill("_least", _HIGH)).withColumn("_hi", fill("_most", _LOW)).drop("_w")
    second = _walk(stored(placed.join(opened, "_a"), "windows"), blocks, lists, dim, negatives, False, part_size)
    pairs = first.select("_a", (F.col("_place") - 1).alias("_window"), F.col("_other").alias("positive_id"), F.col("_score").alias("positive_score"))
    result = second.join(pairs, ["_a", "_window"]).join(placed.select("_a", F.col("_id").alias("anchor_id")), "_a")
    return result.select(
        "anchor_id", "positive_id", F.col("_place").cast("int").alias("rank"), F.col("_other").alias("negative_id"), "positive_score",
        F.col("_score").alias("negative_score"),
    )


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh has its label moved on by one."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) FOR x IN embedding] AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS same, list_inner_product(a.e, o.e)::BIGINT AS score
  FROM v a JOIN v o ON a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same AND other_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT p.*, s.other_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
