"""Removal of repeated passages with compressed FM-indexes, one per shard.

A window is a run of ``window`` words of one text. Every word goes that a window covers whose words also start earlier
(in a smaller id, or earlier in the same text).

Windows reach their shard by content. A window's anchor is its smallest hash of a few consecutive words; neighbouring
windows mostly share it and travel together as one segment, and equal windows have equal anchors, so what may be equal
meets. An anchor that occurs once in the corpus ends there. Segments with the same words are counted as one: the first
stays, the windows of the others are repeats. First segments whose anchor stands in different segments are laid out in
order of appearance and indexed per shard: suffix order, Burrows-Wheeler transform, wavelet matrix with rank counts.
Backward search streams their windows through the index; a window whose suffix interval holds an earlier place is a
repeat, and runs of such windows are reported as intervals. Windows of anchors with very many segments are not indexed
but counted by content one by one, as whole segments are, so a passage that stands everywhere does not fill one shard.

Texts are held as compressed chunks in a table bucketed by chunk, read again by each step without being shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candora.llm import tokens
from candora.llm.packing import pack, pack_keys, range_slices, unpack, unpack_keys
from candora.llm.shared import attach, stored, stored_chunks

WINDOW = 20
ANCHOR = 6  # words of an anchor
CHUNK_BYTES = 6 << 20
RANGE_KEYS = 1 << 20
SHARD_WORDS = 1 << 20  # words that a shard's index holds
CROWDED = 2000  # segments of an anchor above which its windows are counted one by one


class WaveletMatrix:
    """Rank over a sequence of integers: one bit vector per bit, with counts every 64 places."""

    def __init__(self, values: np.ndarray, largest: int):
        self.size = len(values)
        self.levels = []
        for bit in range(max(1, int(largest).bit_length()) - 1, -1, -1):
            ones = (values >> bit) & 1
            padded = np.zeros((self.size // 64 + 1) * 64, np.uint8)
            padded[: self.size] = ones
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.zeros(len(packed) + 1, np.int32)
            np.cumsum(np.bitwise_count(packed), out=before[1:])
            zeros = self.size - int(ones.sum())
            self.levels.append((bit, packed, before, zeros))
            flag = ones.astype(bool)
            values = np.concatenate([values[~flag], values[flag]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Place of ``place`` after following each symbol's bits; differences of two such places are ranks."""
        place = place.copy()
        for bit, packed, before, zeros in self.levels:
            word, offset = place >> 6, (place & 63).astype(np.uint64)
            below = packed[word] & ((np.uint64(1) << offset) - np.uint64(1))
            ones = before[word] + np.bitwise_count(below)
            place = np.where((symbol >> bit) & 1, zeros + ones, place - ones)
        return place


class FMIndex:
    """Suffix order of a text of symbols (0 separates), compared on the first ``depth`` symbols, and its transform."""

    def __init__(self, text: np.ndarray, depth: int):
        size = len(text)
        rank = text.astype(np.int64)
        length = 1
        while length < depth:
            pair = np.zeros(size, np.int64)
            pair[: size - length] = rank[length:] + 1 if length < size else 0
            _, rank = np.unique(rank * (size + 2) + pair, return_inverse=True)
            length *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        self.largest = int(text.max(initial=0))
        transform = text[self.suffixes - 1]  # the text is circular
        self.matrix = WaveletMatrix(transform, self.largest)
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=self.largest + 1))]
        symbols = np.arange(self.largest + 1)
        self.begin = self.matrix.rank(symbols, np.zeros(len(symbols), np.int64))

    def search(self, text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of ``text`` at ``starts`` that occur more than once: which, and their intervals of suffixes.

        Backward search, a word at a time for all windows at once. A window whose interval shrinks to one place (its
        own) leaves the search.
        """
        alive = np.arange(len(starts))
        last = text[starts + length - 1]
        low, high = self.first[last].astype(np.int64), self.first[last + 1].astype(np.int64)
        for k in range(length - 2, -1, -1):
            many = high - low > 1
            alive, low, high = alive[many], low[many], high[many]
            if not len(alive):
                break
            symbol = text[starts[alive] + k]
            base = self.first[symbol] - self.begin[symbol]
            low = base + self.matrix.rank(symbol, low)
            high = base + self.matrix.rank(symbol, high)
        many = high - low > 1
        return alive[many], low[many], high[many]


def repeated_windows(words: np.ndarray, lengths: np.ndarray, window: int) -> np.ndarray:
    """For segments in order of appearance (their words one after another), the starts of windows, as places among all
    words, whose words also start in an earlier place."""
    segments = len(lengths)
    if not segments or int(lengths.max()) < window:
        return np.zeros(0, np.int64)
    begin = np.cumsum(lengths) - lengths
    _, code = np.unique(words, return_inverse=True)
    text = np.zeros(len(words) + segments, np.int64)
    shift = np.repeat(np.arange(segments), lengths)
    text[np.arange(len(words)) + shift] = code + 1
    counts = np.maximum(lengths - window + 1, 0)
    starts = np.repeat(begin + np.arange(segments), counts) + (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    index = FMIndex(text, window)
    which, low, high = index.search(text, starts, window)
    if not len(which):
        return np.zeros(0, np.int64)
    # intervals of equal length are equal or disjoint: the earliest place of each, once
    left, inverse = np.unique(low, return_inverse=True)
    right = np.zeros(len(left), np.int64)
    right[inverse] = high
    edges = np.stack([left, right], 1).reshape(-1)
    places = np.append(index.suffixes, np.iinfo(np.int64).max)
    earliest = np.minimum.reduceat(places, edges)[::2][inverse]
    mine = starts[which]
    later = np.sort(mine[mine > earliest])
    return later - np.searchsorted(begin + np.arange(segments), later, "right") + 1


def segments_of(found: tokens.Words, window: int, anchor: int) -> dict[str, np.ndarray]:
    """Segments of several texts: runs of windows with the same anchor place.

    ``row``, ``start`` (first window's first word, counted in its text), ``windows`` and ``anchor``.
    """
    counts = found.counts()
    windows = np.maximum(counts - window + 1, 0)
    total = int(windows.sum())
    empty = np.zeros(0, np.int64)
    if not total:
        return {"row": empty, "start": empty, "windows": empty, "anchor": np.zeros(0, np.uint64)}
    gram = tokens.ngram_hashes(found.hash, anchor)
    # sliding minimum over the anchors of a window, by doubling; the place of the leftmost minimum goes along
    span = window - anchor + 1
    place = np.arange(len(gram))
    value, width = gram, 1
    while width < span:
        step = min(width, span - width)
        rows = len(value) - step
        take = value[step:] < value[:rows]
        place = np.where(take, place[step:], place[:rows])
        value = np.where(take, value[step:], value[:rows])
        width += step
    row = np.repeat(np.arange(len(counts)), windows)
    local = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows)
    at = found.first[row] + local
    own = place[at]
    new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (row[1:] != row[:-1])])
    return {
        "row": row[new], "start": local[new], "windows": np.diff(np.r_[new, total]), "anchor": gram[own[new]],
    }


def _chunk_table(docs: DataFrame) -> DataFrame:
    """Texts as compressed chunks in a table bucketed by chunk below the shared folder."""
    kind = docs.schema["_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, data, held, number = [], [], [], 0, 0

        def chunk() -> pa.RecordBatch:
            offsets = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
            blob = zstandard.ZstdCompressor(level=3).compress(b"".join(data))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{TaskContext.get().partitionId()}-{number}"]), offsets(pa.concat_arrays(ids)),
                    offsets(pa.array(np.concatenate(sizes), pa.int64())), pa.array([blob], pa.binary()), pa.array([held], pa.int64()),
                ],
                ["_chunk", "_ids", "_sizes", "_data", "_bytes"],
            )

        for batch in batches:
            raw, offsets = tokens.buffers(batch.column(1))
            for low, high in tokens.row_groups(offsets, 1 << 20):
                ids.append(batch.column(0).slice(low, high - low))
                sizes.append(np.diff(offsets[low : high + 1]))
                data.append(raw[offsets[low] : offsets[high]].tobytes())
                held += len(data[-1])
                if held >= CHUNK_BYTES:
                    yield chunk()
                    ids, sizes, data, held, number = [], [], [], 0, number + 1
        if ids:
            yield chunk()

    rows = docs.mapInArrow(work, f"_chunk string, _ids array<{kind}>, _sizes array<long>, _data binary, _bytes long")
    return stored_chunks(rows, "texts")


class Chunk:
    """Decoded chunk: bytes and words of its texts."""

    def __init__(self, sizes, data: bytes):
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8) if data else np.zeros(0, np.uint8)
        self.offsets = np.r_[0, np.cumsum(np.asarray(sizes, np.int64))].astype(np.int64)
        self.words = tokens.words(self.data, self.offsets, lower=False)


def _anchor_requests(chunks: DataFrame, ranges: int, window: int, anchor: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                name, sizes, data = (batch.column(k)[row].as_py() for k in range(3))
                found = segments_of(Chunk(sizes, data).words, window, anchor)
                keys, counts = np.unique(found["anchor"], return_counts=True)
                own = range_slices(keys, ranges)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r for r, _ in own], pa.int32()), pa.array([name] * len(own), pa.string()),
                        pa.array([pack_keys(keys[at]) for _, at in own], pa.binary()),
                        pa.array([pack(np.minimum(counts[at], 2)) for _, at in own], pa.binary()),
                    ],
                    ["_range", "_chunk", "_keys", "_counts"],
                )

    return chunks.select("_chunk", "_sizes", "_data").mapInArrow(work, "_range int, _chunk string, _keys binary, _counts binary")


def _anchor_answers(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    keys = [unpack_keys(r["_keys"]) for r in rows]
    own, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    twice = np.bincount(inverse, weights=np.concatenate([unpack(r["_counts"]) for r in rows]), minlength=len(own)) >= 2
    answers, at, out = twice[inverse], 0, []
    for k in keys:
        out.append(np.packbits(answers[at : at + len(k)]).tobytes() + len(k).to_bytes(8, "little"))
        at += len(k)
    return pa.Table.from_arrays(
        [pa.array([r["_range"] for r in rows], pa.int32()), pa.array([r["_chunk"] for r in rows], pa.string()), pa.array(out, pa.binary())],
        ["_range", "_chunk", "_answer"],
    )


def _content(words: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hash of the words of each segment."""
    out = []
    for salt in (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)):
        order = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        longest = int(length.max(initial=1))
        powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(longest, salt | np.uint64(1))])
        values = tokens.mix(words[np.repeat(start, length) + order] ^ salt) * powers[order]
        out.append(tokens.mix(np.add.reduceat(values, np.cumsum(length) - length)) if len(length) else np.zeros(0, np.uint64))
    return out[0].view(np.int64), out[1].view(np.int64)


def _later(places: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows of ``places`` whose content ``repeated`` has at an earlier place."""
    found = attach(places, repeated.select("_c1", "_c2", "_first", "_n"), ["_c1", "_c2"], "_n", ["_chunk", "_row", "_start"])
    elsewhere = [F.col(c) != F.col(f"_first.{c}") for c in ("_chunk", "_row", "_start")]
    return found.filter(F.col("_first").isNotNull() & (elsewhere[0] | elsewhere[1] | elsewhere[2]))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row per text: id, ``n_words``, ``n_removed``, ``kept_sha256`` and ``kept_text`` (kept words, one space between).

    Words are split at white space and compared as they are. Null and empty texts have no words. Rows with a null id come
    before all others; rows with equal ids are texts of their own, one of them the earlier (the place in the input
    decides). Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    chunks = _chunk_table(rows)
    total = chunks.agg(F.sum("_bytes").alias("n")).collect()[0]["n"] or 0
    ranges = int(max(4, -(-total // (40 * RANGE_KEYS))))  # a segment stands for about 40 bytes
    asked = _anchor_requests(chunks, ranges, window, anchor)
    answers = stored(asked.groupBy("_range").applyInArrow(_anchor_answers, "_range int, _chunk string, _answer binary"), "answers")

    def occurrences(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema(
            [("_chunk", pa.string()), ("_row", pa.int32()), ("_id", left.schema.field("_ids").type.value_type), ("_anchor", pa.int64()),
             ("_c1", pa.int64()), ("_c2", pa.int64()), ("_start", pa.int64()), ("_windows", pa.int32())]
        )
        if not right.num_rows:
            return schema.empty_table()
        chunk = Chunk(left.column("_sizes")[0].as_py(), left.column("_data")[0].as_py())
        found = segments_of(chunk.words, window, anchor)
        flags = []
        for blob in right.select(["_range", "_answer"]).sort_by("_range").column(1).to_pylist():
            flags.append(np.unpackbits(np.frombuffer(blob[:-8], np.uint8))[: int.from_bytes(blob[-8:], "little")].astype(bool))
        keys = np.unique(found["anchor"])
        own = np.concatenate(flags)[np.searchsorted(keys, found["anchor"])]
        row, start, windows = found["row"][own], found["start"][own], found["windows"][own]
        c1, c2 = _content(chunk.words.hash, chunk.words.first[row] + start, windows + window - 1)
        ids = left.column("_ids").combine_chunks().flatten()
        return pa.Table.from_arrays(
            [
                pa.array([left.column("_chunk")[0].as_py()] * len(row), pa.string()), pa.array(row, pa.int32()), ids.take(pa.array(row)),
                pa.array(found["anchor"][own].view(np.int64)), pa.array(c1), pa.array(c2), pa.array(start, pa.int64()), pa.array(windows, pa.int32()),
            ],
            schema=schema,
        )

    schema = f"_chunk string, _row int, _id {kind}, _anchor long, _c1 long, _c2 long, _start long, _windows int"
    found = chunks.select("_chunk", "_ids", "_sizes", "_data").groupBy("_chunk").cogroup(answers.groupBy("_chunk"))
    found = stored(found.applyInArrow(occurrences, schema), "segments")
    same = ["_c1", "_c2"]
    place = F.struct("_id", "_chunk", "_row", "_start")
    contents = found.groupBy(*same).agg(
        F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n"), F.first("_anchor").alias("_anchor"), F.first("_windows").alias("_windows")
    )
    contents = stored(contents, "contents")
    later = _later(found, contents.filter("_n > 1"))
    whole = later.select("_chunk", "_row", "_start", (F.col("_start") + F.col("_windows") + window - 1).alias("_end"))

    # first segments whose anchor has several contents
    crowds = contents.groupBy("_anchor").agg(F.count(F.lit(1)).alias("_segments")).filter("_segments > 1")
    wanted = attach(contents.select("_first", "_anchor", "_windows"), crowds, ["_anchor"], "_segments", ["_first"])
    wanted = wanted.filter("_segments > 1").select(
        "_first._chunk", "_first._row", "_first._id", "_first._start", "_anchor", "_windows", (F.col("_segments") > CROWDED).alias("_crowded")
    )
    wanted = stored(wanted, "wanted")
    sent = wanted.agg(
        F.sum(F.when(~F.col("_crowded"), F.col("_windows") + window - 1)).alias("words"), F.count(F.when(F.col("_crowded"), 1)).alias("crowded")
    ).collect()[0]
    shards = int(max(4, -(-(sent["words"] or 0) // SHARD_WORDS)))

    def singles(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema(
            [("_chunk", pa.string()), ("_row", pa.int32()), ("_id", left.schema.field("_ids").type.value_type),
             ("_start", pa.int64()), ("_c1", pa.int64()), ("_c2", pa.int64())]
        )
        if not right.num_rows or not left.num_rows:
            return schema.empty_table()
        chunk = Chunk(left.column("_sizes")[0].as_py(), left.column("_data")[0].as_py())
        row, start, windows = (right.column(c).to_numpy() for c in ("_row", "_start", "_windows"))
        source = np.repeat(np.arange(len(row)), windows)
        inner = start[source] + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        first = chunk.words.first[row[source]] + inner
        halves = []
        for low in range(0, len(first), 1 << 16):  # the words of that many windows are laid out at once
            part = first[low : low + (1 << 16)]
            halves.append(_content(chunk.words.hash, part, np.full(len(part), window)))
        c1, c2 = (np.concatenate([h[k] for h in halves]) for k in (0, 1))
        return pa.Table.from_arrays(
            [
                pa.array([left.column("_chunk")[0].as_py()] * len(source), pa.string()), pa.array(row[source], pa.int32()),
                right.column("_id").combine_chunks().take(pa.array(source)), pa.array(inner, pa.int64()), pa.array(c1), pa.array(c2),
            ],
            schema=schema,
        )

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["_shard", "_chunk", "_row", "_id", "_start", "_words"]
        schema = pa.schema(
            [("_shard", pa.int64()), ("_chunk", pa.string()), ("_row", pa.int32()), ("_id", left.schema.field("_ids").type.value_type),
             ("_start", pa.int64()), ("_words", pa.binary())]
        )
        if not right.num_rows or not left.num_rows:
            return schema.empty_table()
        chunk = Chunk(left.column("_sizes")[0].as_py(), left.column("_data")[0].as_py())
        row, start, anchors, windows = (right.column(c).to_numpy() for c in ("_row", "_start", "_anchor", "_windows"))
        first = chunk.words.first[row] + start
        length = windows + window - 1
        shard = (tokens.mix(anchors.view(np.uint64)) % np.uint64(shards)).astype(np.int64)
        hashes = chunk.words.hash
        return pa.Table.from_arrays(
            [
                pa.array(shard), pa.array([left.column("_chunk")[0].as_py()] * len(row), pa.string()), pa.array(row, pa.int32()),
                right.column("_id").combine_chunks(), pa.array(start, pa.int64()),
                pa.array([hashes[a : a + n].tobytes() for a, n in zip(first.tolist(), length.tolist(), strict=True)], pa.binary()),
            ],
            schema=schema,
        ).select(names)

    schema = f"_shard long, _chunk string, _row int, _id {kind}, _start long, _words binary"
    texts = chunks.select("_chunk", "_ids", "_sizes", "_data").groupBy("_chunk")
    segments = texts.cogroup(wanted.filter("NOT _crowded").groupBy("_chunk")).applyInArrow(cut, schema)

    def index(table: pa.Table) -> pa.Table:
        order = [(c, "ascending") for c in ("_id", "_chunk", "_row", "_start")]
        table = table.take(pc.sort_indices(table, sort_keys=order, null_placement="at_start"))
        lengths = np.array([len(b) // 8 for b in table.column("_words").to_pylist()], np.int64)
        words = np.frombuffer(b"".join(table.column("_words").to_pylist()), np.uint64)
        begin = np.cumsum(lengths) - lengths
        places = repeated_windows(words, lengths, window)
        segment = np.searchsorted(begin, places, "right") - 1
        # runs of repeated windows of a segment become one interval
        new = np.flatnonzero(np.r_[True, (np.diff(places) != 1) | (np.diff(segment) != 0)]) if len(places) else np.zeros(0, np.int64)
        last = np.r_[new[1:], len(places)] - 1 if len(new) else new
        own = segment[new]
        start = table.column("_start").to_numpy()[own] - begin[own]
        return pa.Table.from_arrays(
            [
                table.column("_chunk").combine_chunks().take(pa.array(own)), table.column("_row").combine_chunks().take(pa.array(own)),
                pa.array(start + places[new], pa.int64()), pa.array(start + places[last] + window, pa.int64()),
            ],
            ["_chunk", "_row", "_start", "_end"],
        )

    partial = segments.groupBy("_shard").applyInArrow(index, "_chunk string, _row int, _start long, _end long")
    intervals = whole.unionByName(partial)
    if sent["crowded"]:
        schema = f"_chunk string, _row int, _id {kind}, _start long, _c1 long, _c2 long"
        windows = stored(texts.cogroup(wanted.filter("_crowded").groupBy("_chunk")).applyInArrow(singles, schema), "windows")
        counted = windows.groupBy(*same).agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n"))
        later = _later(windows, stored(counted.filter("_n > 1"), "repeated"))
        intervals = intervals.unionByName(later.select("_chunk", "_row", "_start", (F.col("_start") + window).alias("_end")))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = Chunk(left.column("_sizes")[0].as_py(), left.column("_data")[0].as_py())
        words = chunk.words
        change = np.zeros(len(words.hash) + 1, np.int32)
        if right.num_rows:
            row = right.column("_row").to_numpy()
            np.add.at(change, words.first[row] + right.column("_start").to_numpy(), 1)
            np.add.at(change, words.first[row] + right.column("_end").to_numpy(), -1)
        kept = np.cumsum(change[:-1]) == 0
        n_kept = np.add.reduceat(np.r_[kept, False].astype(np.int64), words.first[:-1]) * (words.counts() > 0)
        # kept words and one blank after each, all at once; the last blank of a text is left out of its slice
        length = words.end[kept] - words.start[kept]
        total = int((length + 1).sum())
        out = np.full(total, 32, np.uint8)
        begin = np.cumsum(length + 1) - (length + 1)
        order = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(begin, length) + order] = chunk.data[np.repeat(words.start[kept], length) + order]
        text = out.tobytes()
        upto = np.r_[0, np.cumsum(n_kept)]
        bounds = np.r_[begin, total]
        texts = [text[bounds[a] : max(bounds[a], bounds[b] - 1)] for a, b in zip(upto[:-1], upto[1:], strict=True)]
        return pa.Table.from_arrays(
            [
                left.column("_ids").combine_chunks().flatten(), pa.array(words.counts(), pa.int64()), pa.array(words.counts() - n_kept, pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array([t.decode("utf-8", "surrogatepass") for t in texts], pa.string()),
            ],
            [id_col, "n_words", "n_removed", "kept_sha256", "kept_text"],
        )

    grouped = texts.cogroup(intervals.groupBy("_chunk"))
    return grouped.applyInArrow(finish, f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without its repeated passages."""
    cleaned = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return cleaned.select("doc_id", "n_words", "n_removed", "kept_sha256")
