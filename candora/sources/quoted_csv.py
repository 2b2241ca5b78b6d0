"""Delimited files whose quoted fields hold line breaks, read by ranges of each file.

Whether a line break ends a record depends on the quotes before it, from the beginning of the file. Three steps tell
without reading a file in one task: the quotes of every split are counted; running sums over a file's splits say for each
whether it begins inside a quoted field; then every split cuts its own lines into records, and only what crosses a border
(at most two pieces a split) is put together afterwards.

Quotes stand around fields or, doubled, inside quoted ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}


class _Cutter:
    """Cuts the lines of one split after the other into records."""

    def __init__(self):
        self.key, self.odd, self.held, self.continued, self.records = None, 0, [], False, 0
        self.out: list[tuple] = []

    def begin(self, key: tuple[int, int], odd: int) -> None:
        self.end()
        self.key, self.odd, self.held, self.continued, self.records = key, odd, [], bool(odd), 0

    def end(self) -> None:
        """What is held of the split: a record if its quotes are closed, else a piece of one."""
        if self.held:
            self._emit_held(not self.odd)

    def _emit_held(self, closed: bool) -> None:
        kind = ("end" if closed else "middle") if self.continued else ("record" if closed else "begin")
        self._emit(kind, ["\n".join(self.held)])
        self.held, self.continued = [], False

    def _emit(self, kind: str, texts: list[str]) -> None:
        for text in texts:
            first = kind == "record" and self.key[1] == 0 and self.records == 0
            self.records += kind in ("record", "begin")
            self.out.append((*self.key, "header" if first else kind, text))

    def add(self, lines: pa.Array) -> None:
        quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)
        before = (self.odd + np.cumsum(quotes) - quotes) % 2
        starts = np.flatnonzero(before == 0)
        cut = int(starts[0]) if len(starts) else len(lines)
        self.held += lines.slice(0, cut).to_pylist()
        self.odd = int((before[-1] + quotes[-1]) % 2)
        if not len(starts):
            return
        if self.held:
            self._emit_held(True)
        self.continued = False
        last = int(starts[-1])
        if len(starts) > 1:
            lists = pa.ListArray.from_arrays(pa.array((starts - cut).astype(np.int32)), lines.slice(cut, last - cut))
            self._emit("record", pc.binary_join(lists, "\n").to_pylist())
        self.held = lines.slice(last).to_pylist()

    def take(self) -> pa.RecordBatch | None:
        if not self.out:
            return None
        columns = [pa.array(c, k) for c, k in zip(zip(*self.out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
        self.out = []
        return pa.RecordBatch.from_arrays(columns, ["_file", "_block", "_kind", "_record"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cutter = _Cutter()
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks, odd = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_file", "_block", "_odd"))
        edges = np.r_[0, np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1, len(files)]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            key = (int(files[low]), int(blocks[low]))
            if key != cutter.key:
                cutter.begin(key, int(odd[low]))
            cutter.add(batch.column("value").slice(low, high - low))
        found = cutter.take()
        if found is not None:
            yield found
    cutter.end()
    found = cutter.take()
    if found is not None:
        yield found


def read_quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, named by the files' header, which must be the same in every file.

    A large file is read by as many tasks as it has splits. Blank lines are no records; fields that are missing at a
    record's end are null; an unclosed quote makes the rest of its file one record.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    splits = lines.groupBy("_file", "_block").agg(F.sum(quotes).alias("_quotes"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    odd = splits.select("_file", "_block", (F.coalesce(F.sum("_quotes").over(before), F.lit(0)) % 2).alias("_odd"))
    joined = lines.join(F.broadcast(odd), ["_file", "_block"])  # 24 bytes a split: 20 MB for 100 TB
    pieces = joined.select("_file", "_block", "_odd", "value").mapInArrow(_cut, "_file long, _block long, _kind string, _record string")
    pieces = pieces.withColumn("_record", F.regexp_replace("_record", r"\r$", ""))

    heads = [r[0] for r in pieces.filter("_kind = 'header'").select(F.regexp_replace("_record", "^﻿", "")).distinct().limit(2).collect()]
    if len(heads) > 1:
        raise ValueError("the files of one folder must have the same header")
    if not heads:
        return spark.createDataFrame([], "value string")
    names = _fields(spark, heads[0])
    crossing = pieces.filter("_kind IN ('begin', 'middle', 'end')")
    place = F.when(F.col("_kind") == "begin", 1).otherwise(0)  # a split's first piece may end a record, its last one begin the next
    order = Window.partitionBy("_file").orderBy("_block", place)  # at most two rows a split
    numbered = crossing.withColumn("_number", F.sum(place).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_place", place)
    parts = F.sort_array(F.collect_list(F.struct("_block", "_place", "_record")))  # the splits that one record spans
    whole = numbered.groupBy("_file", "_number").agg(F.array_join(F.transform(parts, lambda p: p["_record"]), "\n").alias("_record"))
    records = pieces.filter("_kind = 'record'").select("_record").unionByName(whole.select("_record")).filter("_record <> ''")
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    return records.select(F.from_csv("_record", F.lit(schema), OPTIONS).alias("r")).select("r.*")


def _fields(spark: SparkSession, header: str) -> list[str]:
    """Names of a header record; missing ones are numbered."""
    count = header.count(",") + 1
    schema = ", ".join(f"c{k} string" for k in range(count))
    row = spark.createDataFrame([(header,)], "h string").select(F.from_csv("h", F.lit(schema), OPTIONS).alias("r")).collect()[0]["r"]
    found = [row[k] for k in range(count)]
    while len(found) > 1 and found[-1] is None and not header.endswith(","):
        found.pop()  # commas inside quoted names
    return [name if name is not None else f"_c{k}" for k, name in enumerate(found)]
