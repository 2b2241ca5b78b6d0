"""Near-duplicate components by MinHash with tensored banding.

Two small collections of ``halves`` sketches, each of ``width`` minhashes, are computed per text. A table key combines
sketch i of the first collection with sketch j of the second, so ``2 * halves * width`` minhashes serve ``halves ** 2``
tables that compare ``2 * width`` minhashes each: about the square root of what independent tables would need. A pair of
Jaccard similarity J meets in some table with probability ``(1 - (1 - J ** width) ** halves) ** 2``.

Texts with equal shingle sets are one class and take part once. In a bucket, all members are first compared with the
smallest one. Where a bucket still spans several components, the members outside the largest one are compared with
everything outside their own, as arrays inside tasks and block by block, so that no list of all pairs is ever written:
first everyone's closest partner is confirmed, which connects most, then whatever still agrees. No pair that meets in a
table is left undecided, and connected members are not paired. Confirming uses full shingle sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candora.llm import tokens
from candora.llm.graph import components
from candora.llm.shared import attach, over_batches, stored

WIDTH = 2  # minhashes of a half key
MISS = 2e-4  # probability that a pair just at the threshold meets in no table
BLOCK = 1000  # members of a bucket, or of a block of a larger one, that a task compares as arrays
GROUP_ROWS = 20_000  # members of buckets handed to a task at a time
WIDE = 512  # minhash bytes by which unconnected members are screened


def halves_for(similarity: float, width: int = WIDTH, miss: float = MISS) -> int:
    """Sketches per collection so that a pair at ``similarity`` is missed with probability ``miss`` at most."""
    return max(2, math.ceil(math.log(miss / 2) / math.log(1 - similarity**width)))


def least_equal(similarity: float, minhashes: int, miss: float = MISS / 4) -> int:
    """Equal minhashes that a pair at ``similarity`` has but for a probability of ``miss``; pairs with fewer aren't read."""
    below, k = 0.0, 0
    while True:
        below += math.comb(minhashes, k) * similarity**k * (1 - similarity) ** (minhashes - k)
        if below > miss:
            return k
        k += 1


def _seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.random.Generator(np.random.PCG64(4004)).integers(1, 1 << 63, (2, count), dtype=np.uint64)
    return numbers[0], numbers[1] | np.uint64(1)


def sketch(docs: DataFrame, id_col: str, text_col: str, shingle: int, halves: int, width: int) -> DataFrame:
    """Per row: ``_id``, ``_n`` (distinct shingles), a 128-bit fingerprint of the set, half keys ``_a`` and ``_b``, and
    one byte of each minhash in ``_sig``."""
    count = 2 * halves * width

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = tokens.buffers(batch.column(1))
        flip, factor = _seeds(count)
        rows = batch.num_rows
        size = np.zeros(rows, np.int64)
        print1, print2 = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
        mins = np.zeros((rows, count), np.uint64)
        for low, high in tokens.row_groups(offsets):
            part = offsets[low : high + 1]
            found = tokens.words(data[part[0] : part[-1]], part - part[0], lower=True)
            value, row = tokens.distinct(*tokens.shingles(found, shingle))
            if not len(value):
                continue
            at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            own = row[at] + low
            size[own] = np.diff(np.r_[at, len(row)])
            print1[own] = np.add.reduceat(tokens.mix(value), at)
            print2[own] = np.add.reduceat(tokens.mix(value ^ np.uint64(0x5851F42D4C957F2D)), at)
            for k in range(count):
                mins[own, k] = np.minimum.reduceat((value ^ flip[k]) * factor[k], at)
        bands = mins.reshape(rows, 2, halves, width)
        keys = bands[..., 0]
        for k in range(1, width):
            keys = keys * np.uint64(0x9E3779B97F4A7C15) + bands[..., k]
        keys = (tokens.mix(keys) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        fixed = lambda a: pa.ListArray.from_arrays(
            pa.array(np.arange(rows + 1, dtype=np.int32) * halves), pa.array(np.ascontiguousarray(a).reshape(-1))
        )
        low_bytes = tokens.mix(mins).astype(np.uint8)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(size),
                pa.array(print1.view(np.int64)),
                pa.array(print2.view(np.int64)),
                fixed(keys[:, 0]),
                fixed(keys[:, 1]),
                pa.array([r.tobytes() for r in low_bytes], pa.binary()),
            ],
            ["_id", "_n", "_f1", "_f2", "_a", "_b", "_sig"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    return over_batches(
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")),
        work,
        f"_id {kind}, _n long, _f1 long, _f2 long, _a array<int>, _b array<int>, _sig binary",
    )


def _screened(pairs: DataFrame, signatures: DataFrame, least: int) -> DataFrame:
    """Pairs with at least ``least`` equal minhash bytes."""
    left = signatures.select(F.col("_id").alias("u"), F.col("_sig").alias("_s"))
    right = signatures.select(F.col("_id").alias("v"), F.col("_sig").alias("_t"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.num_rows
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(rows, -1) for k in (2, 3))
        keep = pa.array((a == b).sum(1) >= least)
        return batch.select([0, 1]).filter(keep)

    kind = pairs.schema["u"].dataType.simpleString()
    return over_batches(pairs.join(left, "u").join(right, "v").select("u", "v", "_s", "_t"), work, f"u {kind}, v {kind}")


def _wide_signatures(texts: DataFrame, shingle: int) -> DataFrame:
    """``_id`` and one byte of each of :data:`WIDE` minhashes of the text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        flip, factor = _seeds(WIDE)
        data, offsets = tokens.buffers(batch.column(1))
        out = np.zeros((batch.num_rows, WIDE), np.uint8)
        for low, high in tokens.row_groups(offsets):
            part = offsets[low : high + 1]
            found = tokens.words(data[part[0] : part[-1]], part - part[0], lower=True)
            value, row = tokens.distinct(*tokens.shingles(found, shingle))
            at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
            for k in range(WIDE if len(row) else 0):
                out[row[at] + low, k] = tokens.mix(np.minimum.reduceat((value ^ flip[k]) * factor[k], at)).astype(np.uint8)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in out], pa.binary())], ["_id", "_sig"])

    return over_batches(texts.select("_id", "_text"), work, f"_id {texts.schema['_id'].dataType.simpleString()}, _sig binary")


class _Members:
    """Members of buckets as arrays, from an Arrow table of them."""

    def __init__(self, rows: pa.Table, labels: pa.Array):
        self.ids = rows.column("_id").combine_chunks()
        self.bands = [rows.column(c).combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1) for c in ("_a", "_b")]
        self.sig = np.frombuffer(b"".join(rows.column("_sig").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        self.size, self.table = rows.column("_n").to_numpy(), rows.column("_t").to_numpy()
        self.label = labels.to_numpy(zero_copy_only=False)


def _agreeing(one: _Members, mine: np.ndarray, other: _Members, theirs: np.ndarray, percent: int, least: int, best: bool):
    """Places in ``one`` and ``other`` of unconnected pairs of a bucket that agree in ``least`` minhash bytes.

    A pair that meets in several tables counts in the first of them; with ``best`` only the closest partner does.
    """
    found_u, found_v = [], []
    halves = one.bands[0].shape[1]
    for k in mine:
        small, large = np.minimum(one.size[k], other.size[theirs]), np.maximum(one.size[k], other.size[theirs])
        fits = theirs[(other.label[theirs] != one.label[k]) & (100 * small >= percent * large)]
        if len(fits):
            same = [(other.bands[x][fits] == one.bands[x][k]).argmax(1) for x in (0, 1)]
            fits = fits[same[0] * halves + same[1] == one.table[k]]
        equal = (other.sig[fits] == one.sig[k]).sum(1)
        fits, equal = fits[equal >= least], equal[equal >= least]
        if best and len(fits):
            fits = fits[[equal.argmax()]]
        found_u.append(np.full(len(fits), k))
        found_v.append(fits)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_u]).astype(np.int64), np.concatenate([none, *found_v]).astype(np.int64)


def _ordered(u: pa.Array, v: pa.Array) -> pa.Table:
    return pa.Table.from_arrays([pc.if_else(pc.less(u, v), u, v), pc.if_else(pc.less(u, v), v, u)], ["u", "v"])


def _close_pairs(rows: DataFrame, count: int, percent: int, least: int, best: bool) -> DataFrame:
    """Unconnected pairs of open buckets (``count`` rows) that agree in ``least`` minhash bytes; who is outside the largest component
    (``_label`` other than ``_main``) meets everyone of another one.

    Tasks compare members as arrays, and only what agrees becomes a row: many buckets of up to :data:`BLOCK` members in
    a task, larger ones dealt into blocks.
    """
    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"u {kind}, v {kind}"
    columns = ["_key", "_t", "_id", "_n", "_label", "_main", "_a", "_b", "_sig"]
    usual = rows.filter(F.col("_total") <= BLOCK)
    usual = usual.withColumn("_g", F.pmod(F.xxhash64("_key"), F.lit(1 + count // GROUP_ROWS)))

    def buckets(table: pa.Table) -> pa.Table:
        table = table.sort_by("_key")
        labels = pa.concat_arrays([table.column(c).combine_chunks() for c in ("_label", "_main")]).dictionary_encode().indices
        members = _Members(table, labels.slice(0, table.num_rows))
        outside = members.label != labels.slice(table.num_rows).to_numpy(zero_copy_only=False)
        key = table.column("_key").to_numpy()
        edges = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
        found = []
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            everyone = np.arange(low, high)
            found.append(_agreeing(members, everyone[outside[low:high]], members, everyone, percent, least, best))
        u, v = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        return _ordered(members.ids.take(pa.array(u)), members.ids.take(pa.array(v)))

    pairs = usual.select("_g", *columns).groupBy("_g").applyInArrow(buckets, schema)

    large = rows.filter(F.col("_total") > BLOCK)
    place = F.xxhash64("_id")
    out_blocks, all_blocks = (F.ceil(F.col(c) / BLOCK).cast("long") for c in ("_others", "_total"))
    outside = large.filter("_label != _main").withColumn("_i", F.pmod(place, out_blocks))
    outside = outside.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), all_blocks - 1))).select("_i", "_j", *columns)
    # fresh names: both sides of the grouping come from one table
    everyone = large.select(*[F.col(c).alias(c) for c in large.columns]).withColumn("_j", F.pmod(place, all_blocks))
    everyone = everyone.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), out_blocks - 1))).select("_i", "_j", *columns)

    def blocks(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:  # a block that nobody fell into
            none = pa.concat_tables([left, right]).column("_id").combine_chunks().slice(0, 0)
            return _ordered(none, none)
        labels = pa.concat_arrays([t.column("_label").combine_chunks() for t in (left, right)]).dictionary_encode().indices
        one, other = _Members(left, labels.slice(0, left.num_rows)), _Members(right, labels.slice(left.num_rows))
        u, v = _agreeing(one, np.arange(left.num_rows), other, np.arange(right.num_rows), percent, least, best)
        return _ordered(one.ids.take(pa.array(u)), other.ids.take(pa.array(v)))

    keys = ["_key", "_i", "_j"]
    return pairs.unionByName(outside.groupBy(*keys).cogroup(everyone.groupBy(*keys)).applyInArrow(blocks, schema))


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets have ``100 * intersection >= percent * union``."""
    left = texts.select(F.col("_id").alias("u"), F.col("_text").alias("_s"))
    right = texts.select(F.col("_id").alias("v"), F.col("_text").alias("_t"))

    def sets(column: pa.Array, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = tokens.buffers(column.slice(low, high - low))
        return tokens.distinct(*tokens.shingles(tokens.words(data, offsets, lower=True), shingle))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.num_rows
        linked = np.zeros(rows, bool)
        for low in range(0, rows, 100):
            high = min(rows, low + 100)
            a, in_a = sets(batch.column(2), low, high)
            b, in_b = sets(batch.column(3), low, high)
            size = np.bincount(in_a, minlength=high - low) + np.bincount(in_b, minlength=high - low)
            value, row = np.concatenate([a, b]), np.concatenate([in_a, in_b])
            order = np.lexsort((value, row))
            value, row = value[order], row[order]
            twice = row[1:][(value[1:] == value[:-1]) & (row[1:] == row[:-1])]
            shared = np.bincount(twice, minlength=high - low)
            linked[low:high] = (shared > 0) & (100 * shared >= percent * (size - shared))
        return batch.select([0, 1]).filter(pa.array(linked))

    kind = pairs.schema["u"].dataType.simpleString()
    return over_batches(pairs.join(left, "u").join(right, "v").select("u", "v", "_s", "_t"), work, f"u {kind}, v {kind}")


def _open_buckets(pending: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that span several components, with their label, the largest one's, and the bucket's size."""
    named = pending.join(labels.withColumnRenamed("node", "_id"), "_id", "left")
    named = named.withColumn("_label", F.coalesce("label", "_id")).drop("label")
    parts = named.groupBy("_key", "_label").agg(F.count(F.lit(1)).alias("_part"))
    keys = parts.groupBy("_key").agg(
        F.max(F.struct("_part", "_label")).alias("_main"), F.count(F.lit(1)).alias("_parts"), F.sum("_part").alias("_total")
    )
    keys = keys.filter("_parts > 1").select(
        "_key", F.col("_main._label").alias("_main"), "_total", (F.col("_total") - F.col("_main._part")).alias("_others")
    )
    return named.join(keys, "_key")


def _by_rows(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, width: int) -> DataFrame:
    """:func:`near_duplicates` of rows that their ids don't tell apart: by numbers of rows, named by ids afterwards."""
    texts = docs.select(F.col(id_col).alias("_own"), F.col(text_col).cast("string").alias("_text"))
    texts = stored(texts.withColumn("_number", F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(texts, "_number", "_text", shingle=shingle, percent=percent, width=width)
    found = stored(found.join(texts.select("_number", "_own"), "_number"), "found")
    names = found.groupBy("component_id").agg(F.min("_own").alias("_name"), F.count(F.lit(1)).alias("_size"))
    named = attach(found, names, ["component_id"], "_size", ["_number"])
    return named.select(
        F.col("_own").alias(id_col), "n_shingles", F.col("_name").alias("component_id"), F.col("_own").eqNullSafe(F.col("_name")).alias("kept")
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    shingle: int = 5,
    percent: int = 80,
    width: int = WIDTH,
) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` (smallest id of its component), ``kept``.

    Documents are linked when ``100 * intersection >= percent * union`` of their sets of ``shingle``-word shingles (A-Z
    lower-cased; fewer words count as one shingle). Null, empty and blank texts have no shingle and stay alone. Rows with
    repeated or null ids are documents of their own: a component is named by its smallest id (null only if it has no
    other), and every row that carries this id is kept. Other columns are ignored.
    """
    halves = halves_for(percent / 100, width)
    rows = stored(sketch(docs, id_col, text_col, shingle, halves, width), "sketches")
    ids = rows.groupBy("_id").agg(F.count(F.lit(1)).alias("n"))
    if not ids.filter("n > 1 OR _id IS NULL").isEmpty():
        return _by_rows(docs, id_col, text_col, shingle, percent, width)
    same = ["_f1", "_f2", "_n"]
    classes = rows.filter("_n > 0").groupBy(*same).agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_size"))
    classes = stored(classes, "classes")
    reps = rows.join(classes.select(F.col("_rep").alias("_id")), "_id", "left_semi")

    tables = F.explode(F.sequence(F.lit(0), F.lit(halves * halves - 1)))
    keyed = reps.select("_id", "_n", "_a", "_b", tables.alias("_t"))
    first, second = F.floor(F.col("_t") / halves).cast("int"), F.col("_t") % halves
    keyed = keyed.select("_id", "_n", "_t", F.xxhash64("_t", F.col("_a")[first], F.col("_b")[second]).alias("_key"))
    buckets = keyed.groupBy("_key").agg(
        F.min("_id").alias("_low"), F.min_by("_n", "_id").alias("_low_n"), F.count(F.lit(1)).alias("_members")
    )
    buckets = buckets.filter("_members > 1")
    # Spark's estimate doesn't know that every row became one per table, and would broadcast them all
    members = stored(keyed.join(buckets.hint("merge"), "_key"), "members")

    involved = members.select("_id").distinct()
    signatures = stored(rows.select("_id", "_sig", "_a", "_b").join(involved, "_id", "left_semi"), "signatures")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    texts = stored(texts.join(involved, "_id", "left_semi"), "texts")
    least = least_equal(percent / 100, 2 * halves * width)

    def comparable(n: str, m: str):
        return 100 * F.least(n, m) >= percent * F.greatest(n, m)

    star = members.filter((F.col("_id") != F.col("_low")) & comparable("_n", "_low_n"))
    pairs = star.select(F.col("_low").alias("u"), F.col("_id").alias("v")).distinct()
    links = stored(_verified(_screened(pairs, signatures, least), texts, shingle, percent), "links")
    labels = stored(components(links), "labels")

    # buckets that still span several components: everyone's closest partner first, which connects most of them, then
    # all that is left
    pending = members.filter(F.col("_id") != F.col("_low")).select("_key", "_t", "_id", "_n")
    close, wide = least_equal(percent / 100, WIDE), None
    bands = signatures.select("_id", "_a", "_b")
    for best in (True, False):
        unsettled = stored(_open_buckets(pending, labels), "open")
        if wide is None:
            wide = stored(_wide_signatures(texts.join(unsettled.select("_id").distinct(), "_id", "left_semi"), shingle), "wide")
        pairs = _close_pairs(unsettled.join(bands, "_id").join(wide, "_id"), unsettled.count(), percent, close, best).distinct()
        found = stored(_verified(pairs, texts, shingle, percent), "links")
        hung = labels.select(F.col("node").alias("u"), F.col("label").alias("v")).filter("u != v")
        labels = stored(components(hung.unionByName(found)), "labels")
        pending = unsettled.select("_key", "_t", "_id", "_n")

    named = classes.join(labels.select(F.col("node").alias("_rep"), "label"), "_rep", "left")
    named = named.select(*same, "_size", F.coalesce("label", "_rep").alias("_component"))
    out = attach(rows.select("_id", *same), named, same, "_size", ["_id"])
    component = F.coalesce("_component", "_id")
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_n").alias("n_shingles"),
        component.alias("component_id"),
        (component == F.col("_id")).alias("kept"),
    )


def op4_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 3-word shingles, similarity of 0.85 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, percent=85)
