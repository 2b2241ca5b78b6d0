"""Mixing sources to target weights by fixed-length blocks.

The words of each source, document after document, are cut into blocks of ``block`` words. A source's target fixes how
many slots of the mix it fills. Output shards draw multinomial source counts; a source's slots, numbered through all
shards, map through pseudorandom permutations of its block indices (a keyed Feistel network, another one for every pass
over the source), and slots and pieces of documents meet in a join on source and block index. So each pass takes every
block once before any block comes again, no document is taken more often than its source's target allows, and two runs
agree. What the draws leave over or short of a target is cut off or dealt out over the shards.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candora.llm import tokens
from candora.llm.shared import over_batches, stored
from candora.plans.ordering import running_totals

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 256  # words of a block
SHARD_WORDS = 1 << 20  # words of an output shard, unless that would make more than MAX_SHARDS
MAX_SHARDS = 1 << 16
RANGE_SLOTS = 1 << 14  # slots of a source that a task lays out at a time
TASK_SLOTS = 1 << 20  # slots that a task lays out
MAX_SOURCES = 1_000_000  # one small record per source is held by the driver and the tasks; more is an error


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, most: float) -> list[float]:
    """Words to take from each source: ``share`` of all words by weight, at most ``most`` times a source's size; what a
    full source can't take is shared again by weight among the others."""
    total = share * sum(sizes)
    full: set[int] = set()
    while True:
        rest = total - sum(most * sizes[k] for k in full)
        weight = sum(weights[k] for k in range(len(sizes)) if k not in full)
        goal = [most * n if k in full else rest * weights[k] / weight for k, n in enumerate(sizes)]
        above = {k for k, n in enumerate(sizes) if k not in full and goal[k] > most * n}
        if not above:
            return goal
        full |= above
        if len(full) == len(sizes):
            return [most * n for n in sizes]


def permute(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """Pseudorandom permutation of ``range(size)``, evaluated at ``index``."""
    return _walk(index, size, _network(size, key)[0])


def unpermute(value: np.ndarray, size: int, key: int) -> np.ndarray:
    """Indices that :func:`permute` maps to ``value``."""
    return _walk(value, size, _network(size, key)[1])


def _network(size: int, key: int):
    """A keyed permutation of at least ``size`` numbers, and its inverse."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    rounds = np.random.Generator(np.random.PCG64(key)).integers(1, 1 << 63, 6, dtype=np.uint64) | np.uint64(1)

    def mixed(x: np.ndarray, k: np.uint64) -> np.ndarray:
        y = (x + k) * np.uint64(0x9E3779B97F4A7C15)
        return (((y ^ (y >> np.uint64(29))) * k) >> np.uint64(40)) & mask

    def there(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in rounds:
            left, right = right, left ^ mixed(right, k)
        return (left << shift) | right

    def back(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in rounds[::-1]:
            left, right = right ^ mixed(left, k), left
        return (left << shift) | right

    return there, back


def _walk(index: np.ndarray, size: int, once) -> np.ndarray:
    """Along the cycle of each index until the value is below ``size``."""
    out = once(index.astype(np.uint64))
    while True:
        outside = out >= size
        if not outside.any():
            return out.astype(np.int64)
        out[outside] = once(out[outside])


@dataclass
class Plan:
    """Per source: blocks, slots, the words of its last slot, and the key of its permutations."""

    blocks: np.ndarray
    slots: np.ndarray
    last_words: np.ndarray
    keys: np.ndarray
    shards: int
    seed: int

    def block_of(self, source: int, slot: np.ndarray) -> np.ndarray:
        size = int(self.blocks[source])
        out = np.empty(len(slot), np.int64)
        passes = slot // size
        for p in np.unique(passes):
            mine = passes == p
            out[mine] = permute(slot[mine] % size, size, int(self.keys[source]) + int(p))
        return out


def plan_mix(sizes: Sequence[int], goals: Sequence[float], block: int, shard_words: int, seed: int) -> Plan:
    """Slots per source that take ``goals`` words, the last slot shortened to meet them exactly."""
    count = len(sizes)
    blocks, slots, last = np.zeros(count, np.int64), np.zeros(count, np.int64), np.zeros(count, np.int64)
    keys = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 60, count)
    for k, (size, goal) in enumerate(zip(sizes, goals, strict=True)):
        want = int(goal + 0.5)
        if not size or not want:
            continue
        n = blocks[k] = -(-size // block)
        tail = size - (n - 1) * block  # words of the last block
        passes, rest = divmod(want, size)
        if not rest:
            slots[k], last[k] = passes * n, block
            continue
        # where the short last block comes in the pass that is cut off
        at = int(unpermute(np.array([n - 1]), int(n), int(keys[k]) + passes)[0])
        if rest <= at * block:
            more = -(-rest // block)
            left = rest - (more - 1) * block
        elif rest <= at * block + tail:
            more, left = at + 1, rest - at * block
        else:
            more = 1 + -(-(rest - tail) // block)
            left = rest - tail - (more - 2) * block
        slots[k], last[k] = passes * n + more, left
    shards = max(1, min(MAX_SHARDS, -(-int(sum(goals)) // shard_words)))
    return Plan(blocks, slots, last, keys, shards, seed)


def _slots(spark, plan: Plan) -> DataFrame:
    """``_shard``, ``_source``, ``_slot``, ``_block`` and ``_most`` (words to take of the block) of the whole mix."""
    total = int(plan.slots.sum())
    per_shard = -(-total // plan.shards)
    chance = plan.slots / max(1, total)

    def draw(frames):
        for frame in frames:
            shards, sources, counts = [], [], []
            for shard in frame["id"]:
                rng = np.random.Generator(np.random.Philox(key=[plan.seed, int(shard)]))
                drawn = rng.multinomial(per_shard, chance / chance.sum()) if total else np.zeros(len(chance), int)
                mine = np.flatnonzero(drawn)
                shards.append(np.full(len(mine), shard))
                sources.append(mine)
                counts.append(drawn[mine])
            yield pd.DataFrame({"_shard": np.concatenate(shards), "_source": np.concatenate(sources), "_count": np.concatenate(counts)})

    drawn = stored(spark.range(plan.shards).mapInPandas(draw, "_shard long, _source long, _count long"), "draws")
    before = Window.partitionBy("_source").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    numbered = drawn.withColumn("_from", F.coalesce(F.sum("_count").over(before), F.lit(0)))
    short = {int(r["_source"]): int(r["n"]) for r in drawn.groupBy("_source").agg(F.sum("_count").alias("n")).collect()}
    rest = [
        (-1, k, int(plan.slots[k]) - short.get(k, 0), short.get(k, 0))
        for k in range(len(plan.slots))
        if plan.slots[k] > short.get(k, 0)
    ]
    numbered = numbered.select("_shard", "_source", "_count", "_from")
    if rest:
        numbered = numbered.unionByName(spark.createDataFrame(rest, numbered.schema))

    # ranges of a bounded number of slots, dealt over the tasks: a source may hold almost all of them
    starts = F.sequence(F.col("_from"), F.col("_from") + F.col("_count") - 1, F.lit(RANGE_SLOTS).cast("long"))
    ranges = numbered.filter("_count > 0").withColumn("_low", F.explode(starts))
    ranges = ranges.select("_shard", "_source", "_low", F.least(F.col("_low") + RANGE_SLOTS, F.col("_from") + F.col("_count")).alias("_high"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_SLOTS)
    ranges = ranges.repartition(tasks, "_shard", "_source", "_low")  # few bytes, much work: a given number isn't coalesced

    def expand(frames):
        for frame in frames:
            for shard, source, low, high in frame.itertuples(index=False):
                slot = np.arange(int(low), min(int(high), int(plan.slots[source])))
                if not len(slot):
                    continue
                most = np.full(len(slot), np.iinfo(np.int64).max)
                most[slot == plan.slots[source] - 1] = plan.last_words[source]
                yield pd.DataFrame(
                    {
                        "_shard": np.full(len(slot), shard) if shard >= 0 else slot % plan.shards,
                        "_source": np.full(len(slot), source),
                        "_slot": slot,
                        "_block": plan.block_of(int(source), slot),
                        "_most": most,
                    }
                )

    return ranges.mapInPandas(expand, "_shard long, _source long, _slot long, _block long, _most long")


@dataclass
class Mix:
    """``rows``: one row per document with ``_row``, ``_id``, ``source``, ``size``, ``source_size``, ``target`` and
    ``_start``; ``pieces``: what each slot takes (``_shard``, ``_source``, ``_slot``, ``_row``, ``_start``, ``first_word``,
    ``n_words``); ``texts``: ``_row`` and ``_text`` of the documents. ``_row`` is the id, or a number where ids are null or
    repeat."""

    rows: DataFrame
    pieces: DataFrame
    texts: DataFrame


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    block: int = BLOCK,
    shard_words: int = SHARD_WORDS,
    seed: int = 20240229,
) -> Mix:
    """Mix documents so that sources, in the order of their names (null last), hold words by the repeating ``weights``.

    The mix has ``share`` times the words of all documents; no source gives more than ``most`` times its own words.
    Null and empty texts have no words and are never taken. Repeated ids and rows are mixed one by one. A null source
    is a source. An empty table gives an empty mix. Other columns are ignored.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), F.col(text_col).cast("string").alias("_text"))
    ids = read.groupBy("_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.filter("n > 1 OR _id IS NULL").isEmpty():
        read = read.withColumn("_row", F.col("_id"))
    else:  # rows that their ids don't tell apart get numbers, which only storage keeps
        read = stored(read.withColumn("_row", F.monotonically_increasing_id()), "texts")
    sizes = stored(read.select("_row", "_id", "source", word_count(F.col("_text")).alias("size")), "sizes")
    found = sizes.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"]))
    totals = [int(r["n"]) for r in found]
    goals = targets(totals, [weights[k % len(weights)] for k in range(len(found))], share, most) if found else []
    plan = plan_mix(totals, goals, block, shard_words, seed)
    named = spark.createDataFrame(
        [(r["source"], k, int(r["n"]), float(goals[k])) for k, r in enumerate(found)],
        f"source {sizes.schema['source'].dataType.simpleString()}, _source long, source_size long, target double",
    )
    known = sizes.join(F.broadcast(named), sizes["source"].eqNullSafe(named["source"])).drop(named["source"])
    known = known.select("_row", "_id", "source", "size", "_source", "source_size", "target")
    placed = running_totals(known, ["_source"], ["_id", "size", "_row"], {"_end": "size"})
    rows = stored(placed.withColumn("_start", F.col("_end") - F.col("size")).drop("_end"), "placed")
    whole = rows.filter("size > 0")
    first, last = F.expr(f"_start div {block}"), F.expr(f"(_start + size - 1) div {block}")
    parts = whole.select("_row", "_source", "_start", "size", F.explode(F.sequence(first, last)).alias("_block"))
    low = F.greatest(F.col("_start"), F.col("_block") * block)
    high = F.least(F.col("_start") + F.col("size"), (F.col("_block") + 1) * block)
    parts = parts.select("_row", "_source", "_start", "_block", low.alias("_low"), high.alias("_high"))
    joined = parts.join(_slots(spark, plan).hint("merge"), ["_source", "_block"])  # both sides grow with the documents
    # a shortened slot takes the first words of its block
    end = F.least(F.col("_high"), F.when(F.col("_most") < block, F.col("_block") * block + F.col("_most")).otherwise(F.col("_high")))
    pieces = joined.withColumn("n_words", end - F.col("_low")).filter("n_words > 0")
    pieces = pieces.select(
        "_shard", "_source", "_slot", "_row", "_start", (F.col("_low") - F.col("_start")).alias("first_word"), "n_words"
    )
    return Mix(rows, pieces, read.select("_row", "_text"))


def write_mix(mix: Mix) -> DataFrame:
    """The mix, written below the shared folder, a row per piece: ``shard``, ``source_number``, ``slot``, ``place`` (order
    of a slot's pieces), ``row`` (the document's key), ``n_words`` and ``text``, as it stands in the document.

    A document's pieces are cut out of it together, where its text is. :func:`mixed_blocks` puts the pieces of slots
    together.
    """
    cuts = F.collect_list(F.struct("_shard", "_source", "_slot", "first_word", "n_words", (F.col("_start") + F.col("first_word")).alias("_at")))
    wanted = mix.pieces.groupBy("_row").agg(cuts.alias("_cuts"))  # as many as a document has blocks, times the passes
    names = ["_shard", "_source", "_slot", "_at", "_row", "n_words", "_part"]

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = tokens.buffers(batch.column(1))
        pieces = batch.column(2).flatten()
        field = {n: pieces.field(n).to_numpy(zero_copy_only=False) for n in ("_shard", "_source", "_slot", "first_word", "n_words", "_at")}
        doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))
        low, high = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
        for first, last in tokens.row_groups(offsets):
            own = offsets[first : last + 1]
            found = word_edges(data[own[0] : own[-1]], own - own[0])
            mine = slice(*np.searchsorted(doc, [first, last]))
            begin = found[2][doc[mine] - first] + field["first_word"][mine]
            low[mine], high[mine] = found[0][begin] + own[0], found[1][begin + field["n_words"][mine] - 1] + own[0]
        ends = np.cumsum(high - low)
        place = np.repeat(low - (ends - (high - low)), high - low) + np.arange(ends[-1] if len(ends) else 0)
        raw = pa.py_buffer(np.ascontiguousarray(data[place]))
        text = pa.Array.from_buffers(pa.large_string(), len(doc), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), raw]).cast(pa.string())
        columns = [pa.array(field[n]) for n in ("_shard", "_source", "_slot", "_at")]
        return pa.RecordBatch.from_arrays([*columns, batch.column(0).take(pa.array(doc)), pa.array(field["n_words"]), text], names)

    joined = mix.texts.join(wanted, "_row").select("_row", "_text", "_cuts")
    kind = mix.texts.schema["_row"].dataType.simpleString()
    parts = over_batches(joined, cut, f"_shard long, _source long, _slot long, _at long, _row {kind}, n_words long, _part string")
    named = {"_shard": "shard", "_source": "source_number", "_slot": "slot", "_at": "place", "_row": "row", "_part": "text"}
    return stored(parts.withColumnsRenamed(named), "mix")


def mixed_blocks(parts: DataFrame) -> DataFrame:
    """``shard``, ``source_number``, ``slot`` and ``text`` of a written mix: a slot's pieces joined by a blank."""
    pieces = F.sort_array(F.collect_list(F.struct("place", "text")))  # a block's words at most
    blocks = parts.groupBy("shard", "source_number", "slot").agg(pieces.alias("_parts"))
    return blocks.select("shard", "source_number", "slot", F.array_join(F.col("_parts.text"), " ").alias("text"))


def word_edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Beginnings and ends of all words, and the number of each text's first word."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    before, after = np.r_[True, blank[:-1]], np.r_[blank[1:], True]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    start = np.flatnonzero(before & ~blank)
    return start, np.flatnonzero(after & ~blank) + 1, np.searchsorted(start, offsets)


def taken_words(mix: Mix, parts: DataFrame | None = None) -> DataFrame:
    """Every document with ``size``, ``source_size``, ``target`` and ``taken``, the words that the written mix takes of it."""
    parts = write_mix(mix) if parts is None else parts
    taken = parts.groupBy(F.col("row").alias("_row")).agg(F.sum("n_words").alias("taken"))
    return mix.rows.join(taken, "_row", "left").select(
        "_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")
    )


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """Words that the mix, which is written below the shared folder, takes of each document."""
    mix = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return taken_words(mix).select(F.col("_id").alias("doc_id"), "size", "source_size", "target", "taken")
