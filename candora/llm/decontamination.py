"""Benchmark decontamination: which test items stand, whole or nearly, inside which documents.

A short item and a long document have a tiny Jaccard similarity even when the item is copied whole, so plain MinHash
cannot find it. Items are therefore partitioned by size (powers of two of their number of shingles), and for each
partition documents are read in overlapping windows of four times the partition's lower bound: an item inside a window
has a similarity of at least 0.19 with it at 80 % containment. MinHash sketches of windows and items meet on single hash
values; the window minima of larger partitions are minima of those of smaller ones, so all partitions together cost
little more than one. Items below the smallest partition are searched by all their shingles. Every candidate is verified
by the exact containment of the item's shingles in the whole document.

Items with equal shingle sets are searched once. Sets are searched in blocks of bounded size, one broadcast at a time, so
that what is broadcast doesn't grow with the benchmark.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candora.llm import tokens
from candora.llm.shared import over_batches, stored

HASHES = 48  # (1 - 0.19) ** 48 = 4e-5: chance to miss a pair just at the threshold
SMALLEST = 3  # items of fewer than 2 ** 3 shingles are searched by all of them
BLOCK_SHINGLES = 1_000_000  # item shingles broadcast at a time (about 8 MB)


def _numbers() -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.Generator(np.random.PCG64(9009)).integers(1, 1 << 63, (2, HASHES), dtype=np.uint64)
    return drawn[0], drawn[1] | np.uint64(1)


@dataclass
class ItemIndex:
    """Items' distinct shingles (item ``k`` has ``value[first[k]:first[k + 1]]``) and what leads to them."""

    value: np.ndarray
    first: np.ndarray
    small: tuple[np.ndarray, np.ndarray]  # shingles of small items, sorted, and their items
    classes: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]  # per class and hash: marks, minima, items


def build_index(value: np.ndarray, first: np.ndarray) -> ItemIndex:
    """Sketches of the items by size class."""
    size = np.diff(first)
    item = np.repeat(np.arange(len(size)), size)
    level = np.floor(np.log2(np.maximum(size, 1))).astype(int)
    tiny = (size > 0) & (size < 1 << SMALLEST)
    mine = tiny[item] if len(item) else np.zeros(0, bool)
    order = np.argsort(value[mine], kind="stable")
    small = value[mine][order], item[mine][order]
    flip, factor = _numbers()
    classes = {}
    for g in np.unique(level[size >= 1 << SMALLEST]):
        own = np.flatnonzero((level == g) & (size > 0))
        tables = []
        for k in range(HASHES):
            low = np.array([((value[first[i] : first[i + 1]] ^ flip[k]) * factor[k]).min() for i in own], np.uint64)
            order = np.argsort(low, kind="stable")
            marks = np.zeros(1 << 16, bool)
            marks[(low >> np.uint64(48)).astype(int)] = True
            tables.append((marks, low[order], own[order]))
        classes[int(g)] = tables
    return ItemIndex(value, first, small, classes)


def _equal_pairs(keys: np.ndarray, rows: np.ndarray, table: np.ndarray, items: np.ndarray) -> np.ndarray:
    """``row, item`` for every key that stands in the sorted ``table``, repeated entries included."""
    low, high = np.searchsorted(table, keys, "left"), np.searchsorted(table, keys, "right")
    hits = high - low
    at = np.repeat(low, hits) + np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)
    return np.stack([np.repeat(rows, hits), items[at]], 1)


def search(index: ItemIndex, value: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Candidate ``row, item`` pairs for documents given as shingles in text order (``row`` ascending)."""
    none = np.zeros((0, 2), np.int64)
    if not len(value):
        return none
    found = [none]
    if len(index.small[0]):
        found.append(np.unique(_equal_pairs(value, row, *index.small), axis=0))
    if index.classes:
        base = 2 << SMALLEST  # shingles of a block: half a window of the smallest class
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        local = np.arange(len(value)) - np.repeat(first, np.diff(np.r_[first, len(value)]))
        starts = np.flatnonzero(local % base == 0)
        block_row, block = row[starts], local[starts] // base
        flip, factor = _numbers()
        levels = [(block_row, block)]
        for _ in range(SMALLEST, max(index.classes)):
            r, b = levels[-1]
            up = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (b[1:] // 2 != b[:-1] // 2)])
            levels.append((r[up], b[up] // 2))
        for k in range(HASHES):
            minima = np.minimum.reduceat((value ^ flip[k]) * factor[k], starts)
            for g in range(SMALLEST, max(index.classes) + 1):
                r, b = levels[g - SMALLEST]
                if g > SMALLEST:
                    r0, b0 = levels[g - SMALLEST - 1]
                    minima = np.minimum.reduceat(
                        minima, np.flatnonzero(np.r_[True, (r0[1:] != r0[:-1]) | (b0[1:] // 2 != b0[:-1] // 2)])
                    )
                if g not in index.classes:
                    continue
                window = minima.copy()
                same = r[1:] == r[:-1]
                window[:-1][same] = np.minimum(minima[:-1][same], minima[1:][same])
                marks, table, items = index.classes[g][k]
                maybe = np.flatnonzero(marks[(window >> np.uint64(48)).astype(np.int32)])
                if len(maybe):
                    found.append(_equal_pairs(window[maybe], r[maybe], table, items))
    return np.unique(np.concatenate(found), axis=0)


def contained(index: ItemIndex, value: np.ndarray, row: np.ndarray, percent: int) -> list[tuple[int, int, int, int]]:
    """``row, item, shared, size`` of candidates whose exact containment is at least ``percent``."""
    pairs = search(index, value, row)
    if not len(pairs):
        return []
    own, in_row = tokens.distinct(value, row)
    out = []
    for r, item in pairs.tolist():
        low, high = np.searchsorted(in_row, r, "left"), np.searchsorted(in_row, r, "right")
        wanted = index.value[index.first[item] : index.first[item + 1]]
        doc = own[low:high]
        at = np.minimum(np.searchsorted(doc, wanted), len(doc) - 1)
        shared = int((doc[at] == wanted).sum())
        if 100 * shared >= percent * len(wanted):
            out.append((r, item, shared, len(wanted)))
    return out


def _item_shingles(items: DataFrame, item_id: str, text: str, shingle: int) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = tokens.buffers(batch.column(1))
        value, row = tokens.distinct(*tokens.shingles(tokens.words(data, offsets, lower=True), shingle))
        first = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(pa.array(first), pa.array(value.view(np.int64)))], ["_item", "_values"]
        )

    kind = items.schema[item_id].dataType.simpleString()
    return over_batches(
        items.select(F.col(item_id).alias("_item"), F.col(text).cast("string").alias("_text")), work, f"_item {kind}, _values array<long>"
    )


def find_contained(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    shingle: int = 5,
    percent: int = 80,
) -> DataFrame:
    """One row per document and item with at least ``percent`` of the item's distinct shingles in the document.

    Columns: the two ids, ``item_shingles``, ``shared`` and ``containment``. Words are split at white space, A-Z
    lower-cased. A text of fewer than ``shingle`` words counts as one shingle, so a very short item is found only where
    it is the whole document: single common words don't condemn long texts. Null and blank texts match nothing. Items
    and documents that occur repeatedly are reported each time. Other columns, and equal names on both sides, don't
    matter.
    """
    named = stored(_item_shingles(items, item_id, item_text, shingle).filter(F.size("_values") > 0), "items")
    values = stored(named.select("_values").distinct().withColumn("_set", F.monotonically_increasing_id()), "sets")
    named = named.join(values, "_values").select("_item", "_set")
    total = values.agg(F.sum(F.size("_values")).alias("n")).collect()[0]["n"] or 0
    blocks = max(1, -(-total // BLOCK_SHINGLES))
    id_kind, item_kind = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    item_name = item_id if item_id != doc_id else f"{item_id}_item"
    schema = f"`{doc_id}` {id_kind}, _set long, item_shingles long, shared long, containment double"
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(doc_text).cast("string").alias("_text"))
    names = [doc_id, "_set", "item_shingles", "shared", "containment"]
    kinds = [pa.int64(), pa.int64(), pa.float64()]
    result = None
    for number in range(blocks):
        part = values.filter(F.pmod(F.xxhash64("_values"), F.lit(blocks)) == number).select("_set", "_values").toArrow()
        lists = part.column("_values").combine_chunks()
        value = np.array(lists.flatten().to_numpy(zero_copy_only=False)).view(np.uint64) if len(lists) else np.zeros(0, np.uint64)
        size = np.array([len(x) for x in lists], np.int64)
        index = build_index(value, np.r_[0, np.cumsum(size)].astype(np.int64))
        known = docs.sparkSession.sparkContext.broadcast((index, part.column("_set").combine_chunks()))

        def work(batch: pa.RecordBatch, known=known) -> pa.RecordBatch:
            index, ids = known.value
            data, offsets = tokens.buffers(batch.column(1))
            hits = []
            for low, high in tokens.row_groups(offsets):
                part = offsets[low : high + 1]
                found = tokens.words(data[part[0] : part[-1]], part - part[0], lower=True)
                hits += [(r + low, *rest) for r, *rest in contained(index, *tokens.shingles(found, shingle), percent)]
            rows = pa.array([h[0] for h in hits], pa.int64())
            shared, size = np.array([h[2] for h in hits], np.int64), np.array([h[3] for h in hits], np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows),
                    ids.take(pa.array([h[1] for h in hits], pa.int64())),
                    *(pa.array(c, k) for c, k in zip((size, shared, shared / np.maximum(size, 1)), kinds, strict=True)),
                ],
                names,
            )

        matches = over_batches(texts, work, schema)
        if blocks > 1:
            matches = stored(matches, "matches")
            known.unpersist()
        result = matches if result is None else result.unionByName(matches)
    rows = result.join(named, "_set")
    return rows.select(doc_id, F.col("_item").cast(item_kind).alias(item_name), "item_shingles", "shared", "containment")


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items."""
    return find_contained(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )


_SHINGLES = """
  SELECT {id}, w, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s
  FROM (SELECT {id}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table})"""

ORACLE = f"""
WITH d AS ({_SHINGLES.format(id="doc_id", table="documents")}),
b AS ({_SHINGLES.format(id="item_id", table="benchmark")}),
de AS (SELECT doc_id, unnest(s) AS x FROM d), be AS (SELECT item_id, len(s) AS item_shingles, unnest(s) AS x FROM b)
SELECT doc_id, item_id, item_shingles, count(*) AS shared, count(*) / item_shingles::DOUBLE AS containment
FROM de JOIN be USING (x) GROUP BY doc_id, item_id, item_shingles HAVING 100 * count(*) >= 80 * item_shingles
"""
