"""Ranked lexical search: the best documents for each item, by exact inner products over sparse ball trees.

A text's terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. Documents are
reduced to the terms that any item holds (no other term can add to a score), weighted, and cut into chunks of bounded
size. Each chunk becomes one ball tree: a node knows the centroid of its documents' sparse vectors, its radius (the
largest distance of a document from the centroid), and how far each term's largest weight lies above the centroid. A
node's bound for an item is the smaller of centroid product plus radius times the item's norm, and centroid product
plus the excesses of the item's terms; both are rounded up by more than the error of floating point.

An item descends a tree best-first and leaves it when the best open bound lies below the score that it has to reach;
documents of a leaf are scored with 64-bit integers. All chunks are visited twice: first for the best leaves only, which
gives each item a score that its tenth document reaches at least, then with that score as the least one to reach, so
that most trees are left at their root.

64-bit hashes stand for terms. Items are searched in blocks whose terms are bounded, so that what is broadcast doesn't
grow with the items; documents are read once for each block.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candora.llm import tokens
from candora.llm.packing import pack, unpack
from candora.llm.shared import over_batches, stored

TOP = 10
BLOCK_TERMS = 500_000  # item terms (with repeats) searched at a time: bounds the broadcast index of items
CHUNK_DOCS = 2048  # documents of one tree
CHUNK_ENTRIES = 250_000  # terms of the documents of one tree; a longer document stands alone
LEAF = 64  # documents that are scored together
SAFE = 1e-9  # relative error allowed for in bounds; sums of 64-bit floats of this length err by far less

_TERMS = np.full(256, 32, np.uint8)  # every byte of a term as itself, A-Z lower-cased; the rest are blanks
_TERMS[48:58] = np.arange(48, 58)
_TERMS[97:123] = np.arange(97, 123)
_TERMS[65:91] = np.arange(97, 123)
_TERMS[128:] = np.arange(128, 256)


def term_hashes(column: pa.Array) -> Iterator[tuple[int, int, tokens.Words]]:
    """Row ranges of a text column with the hashed terms of their texts, in order."""
    data, offsets = tokens.buffers(column)
    for low, high in tokens.row_groups(offsets):
        part = offsets[low : high + 1]
        yield low, high, tokens.words(_TERMS[data[part[0] : part[-1]]], part - part[0], lower=False)


def _counted(value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``row, value`` pairs in order, and how often each occurs."""
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (row[1:] != row[:-1])]) if len(value) else np.zeros(0, np.int64)
    return row[new], value[new], np.diff(np.r_[new, len(value)])


def _lists(first: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))


def _item_terms(items: DataFrame) -> DataFrame:
    """``_item`` with its distinct terms' hashes and their repeats."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, values, counts = [], [], []
        for low, _, found in term_hashes(batch.column(1)):
            r, v, c = _counted(found.hash, found.row)
            rows.append(r + low)
            values.append(v)
            counts.append(c)
        none = np.zeros(0, np.int64)
        row = np.concatenate([none, *rows])
        first = np.searchsorted(row, np.arange(batch.num_rows + 1))
        value = np.concatenate([none.astype(np.uint64), *values]).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), _lists(first, value, pa.int64()), _lists(first, np.concatenate([none, *counts]), pa.int64())],
            ["_item", "_terms", "_times"],
        )

    return over_batches(items, work, "_item long, _terms array<long>, _times array<long>").filter(F.size("_terms") > 0)


def _postings(texts: DataFrame, kind: str, vocabulary) -> DataFrame:
    """Per document: the number of all its terms, and places in the vocabulary and occurrences of those that items hold."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = vocabulary.value
        size = np.zeros(batch.num_rows, np.int64)
        rows, values, counts = [], [], []
        for low, high, found in term_hashes(batch.column(1)):
            size[low:high] = found.counts()
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, found.hash), len(known) - 1)
            hit = known[at] == found.hash
            r, v, c = _counted(at[hit], found.row[hit])
            rows.append(r + low)
            values.append(v)
            counts.append(c)
        none = np.zeros(0, np.int64)
        first = np.searchsorted(np.concatenate([none, *rows]), np.arange(batch.num_rows + 1))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(size), _lists(first, np.concatenate([none, *values]), pa.int32()),
                _lists(first, np.concatenate([none, *counts]), pa.int32()),
            ],
            ["_id", "_n", "_at", "_tf"],
        )

    return over_batches(texts, work, f"_id {kind}, _n long, _at array<int>, _tf array<int>")


def term_weight(documents: int, frequency: int) -> int:
    """Weight of a term that ``frequency`` of ``documents`` hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def occurrence_weights(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What ``tf`` occurrences in a document of ``n`` terms count, in 64-bit integers."""
    if len(n) and int(n.max()) * 75 * documents >= 1 << 63:  # the product may pass 64 bits, the quotient doesn't
        length = np.array([25 + (75 * int(x) * documents) // total for x in n], np.int64)
    else:
        length = 25 + (75 * n * documents) // total
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 8 * length)


@dataclass
class Tree:
    """Documents in rows of a sparse matrix, and the nodes over them.

    Place ``i`` is document ``rows[i]`` and holds ``term[first[i]:first[i + 1]]`` with ``weight``. A node has the places
    ``begin`` to ``end``, children ``left`` and ``right`` (-1 at leaves), its radius, and centroid entries
    ``c_first[k]:c_first[k + 1]``.
    """

    first: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    rows: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray
    radius: np.ndarray
    c_first: np.ndarray
    c_term: np.ndarray
    c_mean: np.ndarray
    c_above: np.ndarray


_FIELDS = ("first", "term", "weight", "rows", "begin", "end", "left", "right", "radius", "c_first", "c_term", "c_mean", "c_above")
_REAL = {"radius", "c_mean", "c_above"}


def to_blobs(tree: Tree) -> list[bytes]:
    """Compressed fields; real numbers with 24 bits, rounded up (a larger centroid or excess only raises bounds)."""
    out = []
    for name in _FIELDS:
        values = getattr(tree, name)
        if name in _REAL:
            short = np.nextafter(values.astype(np.float32), np.float32(np.inf))
            out.append(zstandard.ZstdCompressor(level=1).compress(short.tobytes()))
        else:
            out.append(pack(values + 1 if name in ("left", "right") else values))  # -1 at leaves
    return out


def from_blobs(blobs: list[bytes]) -> Tree:
    fields = {}
    for name, blob in zip(_FIELDS, blobs, strict=True):
        if name in _REAL:
            fields[name] = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.float32).astype(float)
        else:
            fields[name] = unpack(blob).view(np.int64) - (name in ("left", "right"))
    return Tree(**fields)


def _entries(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the entries of ``rows``, and where each row's entries begin among them."""
    size = first[rows + 1] - first[rows]
    starts = np.cumsum(size) - size
    return np.repeat(first[rows] - starts, size) + np.arange(size.sum()), starts


def build_tree(first: np.ndarray, term: np.ndarray, weight: np.ndarray) -> Tree:
    """Split documents in two by the nearer of two far apart ones, again and again down to :data:`LEAF` documents.

    Every document must have an entry. Equal documents, which no distance tells apart, are halved.
    """
    count = len(first) - 1
    tree = Tree(first, term, weight, np.arange(count), *([None] * 9))
    value = weight.astype(float)
    square = np.add.reduceat(value * value, first[:-1]) if count else np.zeros(0)
    place = np.zeros(int(term.max(initial=-1)) + 1)

    def distances(rows: np.ndarray, entries: np.ndarray, starts: np.ndarray, pivot: int) -> np.ndarray:
        own = slice(first[pivot], first[pivot + 1])
        place[term[own]] = value[own]
        product = np.add.reduceat(place[term[entries]] * value[entries], starts)
        place[term[own]] = 0.0
        return square[rows] - 2 * product + square[pivot]

    begin, end, left, right, radius, terms, means, above = [], [], [], [], [], [], [], []
    open_nodes = [(0, count, -1, False)] if count else []
    while open_nodes:
        low, high, parent, is_right = open_nodes.pop()
        node = len(begin)
        if parent >= 0:
            (right if is_right else left)[parent] = node
        rows = tree.rows[low:high]
        entries, starts = _entries(first, rows)
        order = np.argsort(term[entries], kind="stable")
        sorted_terms, sorted_values = term[entries][order], value[entries][order]
        new = np.flatnonzero(np.r_[True, sorted_terms[1:] != sorted_terms[:-1]])
        mean = np.add.reduceat(sorted_values, new) / len(rows)
        own = sorted_terms[new]
        place[own] = mean
        product = np.add.reduceat(place[term[entries]] * value[entries], starts)
        place[own] = 0.0
        gap = float(np.max(square[rows] - 2 * product + mean @ mean, initial=0.0))
        # cancellation leaves an error in proportion to the squares, not to their difference
        radius.append(math.sqrt(max(gap, 0.0) + SAFE * float(square[rows].max())))
        begin.append(low)
        end.append(high)
        left.append(-1)
        right.append(-1)
        terms.append(own)
        means.append(mean)
        above.append(np.maximum.reduceat(sorted_values, new) - mean)
        if len(rows) <= LEAF:
            continue
        far = int(rows[np.argmax(distances(rows, entries, starts, int(rows[0])))])
        from_far = distances(rows, entries, starts, far)
        other = int(rows[np.argmax(from_far)])
        near_far = from_far <= distances(rows, entries, starts, other)
        size = int(near_far.sum())
        if size == 0 or size == len(rows):
            size = len(rows) // 2
            near_far = np.arange(len(rows)) < size
        tree.rows[low:high] = np.concatenate([rows[near_far], rows[~near_far]])
        open_nodes += [(low + size, high, node, True), (low, low + size, node, False)]
    entries, starts = _entries(first, tree.rows)
    tree.first, tree.term, tree.weight = np.r_[starts, len(entries)].astype(np.int64), term[entries], weight[entries]
    tree.begin, tree.end = np.array(begin, np.int64), np.array(end, np.int64)
    tree.left, tree.right, tree.radius = np.array(left, np.int64), np.array(right, np.int64), np.array(radius, float)
    tree.c_first = np.r_[0, np.cumsum([len(t) for t in terms])].astype(np.int64)
    tree.c_term = np.concatenate([np.zeros(0, np.int64), *terms])
    tree.c_mean, tree.c_above = (np.concatenate([np.zeros(0), *x]) for x in (means, above))
    return tree


def search_tree(
    tree: Tree, terms: np.ndarray, times: np.ndarray, coefficient: np.ndarray, least: int, top: int, leaves: int | None = None
) -> tuple[list[tuple[int, int]], int]:
    """The ``top`` best ``score, row`` of at least ``least`` (and above 0), equal scores by row, and the leaves scored.

    ``terms`` are sorted, ``times`` their repeats; ``coefficient`` is an array of zeros over all terms, used as scratch
    and left as it was. With ``leaves`` the search ends after so many leaves.
    """
    norm = math.sqrt(float((times * times).sum()))
    coefficient[terms] = times
    best: list[tuple[int, int]] = []  # smallest score first; of equal scores the largest row
    least = max(least, 1)

    def bound(node: int) -> float:
        low, high = tree.c_first[node], tree.c_first[node + 1]
        at = low + np.searchsorted(tree.c_term[low:high], terms)
        at[at == high] = low
        hit = tree.c_term[at] == terms
        at, use = at[hit], times[hit]
        product = float(use @ tree.c_mean[at])
        return (product + min(norm * tree.radius[node], float(use @ tree.c_above[at]))) * (1 + SAFE) + 1

    heap = [(-bound(0), 0)] if len(tree.begin) else []
    scored = 0
    while heap:
        high, node = heapq.heappop(heap)
        if -high < least or (leaves is not None and scored >= leaves):
            break
        if tree.left[node] >= 0:
            for child in (int(tree.left[node]), int(tree.right[node])):
                limit = min(-high, bound(child))
                if limit >= least:
                    heapq.heappush(heap, (-limit, child))
            continue
        scored += 1
        places = tree.first[tree.begin[node] : tree.end[node] + 1]
        rows, own = tree.rows[tree.begin[node] : tree.end[node]], slice(places[0], places[-1])
        scores = np.add.reduceat(coefficient[tree.term[own]] * tree.weight[own], places[:-1] - places[0])
        good = scores >= least
        for entry in zip(scores[good].tolist(), (-rows[good]).tolist(), strict=True):
            if len(best) < top:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
        if len(best) == top:
            least = max(least, best[0][0])
    coefficient[terms] = 0
    return [(score, -row) for score, row in sorted(best, reverse=True)], scored


def _trees(postings: DataFrame, kind: str, documents: int, total: int, weights) -> DataFrame:
    """One row per chunk of documents: their ids (ascending, nulls last) and the packed tree."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, rows, entries = [], 0, 0
        for batch in batches:
            sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            low = 0
            while low < batch.num_rows:
                fit = int(np.searchsorted(np.cumsum(sizes[low:]), CHUNK_ENTRIES - entries, "right"))
                take = min(CHUNK_DOCS - rows, fit, batch.num_rows - low)
                if take <= 0 and not held:
                    take = 1
                if take > 0:
                    held.append(batch.slice(low, take))
                    rows, entries, low = rows + take, entries + int(sizes[low : low + take].sum()), low + take
                if low < batch.num_rows:
                    yield pa.Table.from_batches(held)
                    held, rows, entries = [], 0, 0
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches):
            table = table.take(pc.sort_indices(table, sort_keys=[("_id", "ascending")], null_placement="at_end")).combine_chunks()
            ids, n, at, tf = (table.column(c).combine_chunks() for c in ("_id", "_n", "_at", "_tf"))
            first = np.r_[0, np.cumsum(pc.list_value_length(at).to_numpy(zero_copy_only=False))].astype(np.int64)
            term, tf = at.flatten().to_numpy(zero_copy_only=False).astype(np.int64), tf.flatten().to_numpy(zero_copy_only=False)
            length = np.repeat(n.to_numpy(zero_copy_only=False), np.diff(first))
            weight = weights.value[term] * occurrence_weights(tf, length, documents, total)
            tree = build_tree(first, term, weight)
            packed = [pa.array([blob], pa.binary()) for blob in to_blobs(tree)]
            whole = pa.array(np.array([0, len(ids)], np.int32))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(whole, ids), *packed], ["_ids", *_FIELDS])

    schema = ", ".join([f"_ids array<{kind}>", *(f"{f} binary" for f in _FIELDS)])
    return postings.mapInArrow(run, schema)


def _found(trees: DataFrame, kind: str, items, size: int, top: int, leaves: int | None) -> DataFrame:
    """``_item``, ``_id`` and ``score`` of each chunk's best documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, first, terms, times, least = items.value
        coefficient = np.zeros(size, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                tree = from_blobs([batch.column(f)[k].as_py() for f in _FIELDS])
                item, score, row = [], [], []
                for q in range(len(numbers)):
                    own = slice(first[q], first[q + 1])
                    for value, place in search_tree(tree, terms[own], times[own], coefficient, int(least[q]), top, leaves)[0]:
                        item.append(numbers[q])
                        score.append(value)
                        row.append(place)
                if item:
                    ids = batch.column("_ids")[k].values.take(pa.array(row, pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), ids, pa.array(score, pa.int64())], ["_item", "_id", "score"])

    return trees.mapInArrow(run, f"_item long, _id {kind}, score long")


def _best(found: DataFrame, top: int, order: list[Column]) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("_item").orderBy(*order)))
    return ranked.filter(F.col("rank") <= top)


def search(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    top: int = TOP,
) -> DataFrame:
    """The ``top`` documents of highest score for each item, scores above 0 only: item id, ``rank``, document id, ``score``.

    A term's weight is ``floor(1000 ln((2N + 2) / (2 df + 1)))`` over the ``N`` documents that have any term; a document
    of ``n`` terms counts ``tf`` occurrences as ``1e9 tf div (1000 tf + 8 m)`` with ``m = 25 + 75 n N div L``, ``L`` being
    all documents' terms. Equal scores are ranked by document id, null ids last. Null, empty and term-less texts match
    nothing. Repeated document ids and rows are documents of their own; every item row is a query of its own, also where
    its id repeats or is null, and texts that repeat among items are searched once. Empty tables give an empty result.
    Other columns, and equal names on both sides, don't matter: where both ids have one name, the item's gets ``_item``.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    item_name = item_id if item_id != doc_id else f"{item_id}_item"
    wanted = items.select(F.col(item_id).alias("_item_id"), F.col(item_text).cast("string").alias("_text"))
    wanted = wanted.filter(F.col("_text").isNotNull())
    texts = stored(wanted.select("_text").distinct().withColumn("_item", F.monotonically_increasing_id()), "item_texts")
    terms = stored(_item_terms(texts.select("_item", "_text")), "item_terms")
    amount = terms.agg(F.sum(F.size("_terms")).alias("n")).collect()[0]["n"] or 0
    blocks = max(1, -(-amount // BLOCK_TERMS))
    corpus = docs.select(F.col(doc_id).alias("_id"), F.col(doc_text).cast("string").alias("_text"))
    order = [F.desc("score"), F.asc_nulls_last("_id")]
    result = None
    for block in range(blocks):
        part = terms.filter(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == block).toArrow().combine_chunks()
        hashes = _flat(part, "_terms").view(np.uint64)
        size = pc.list_value_length(part.column("_terms")).to_numpy() if part.num_rows else np.zeros(0, np.int64)
        vocabulary, place = np.unique(hashes, return_inverse=True)
        postings = stored(_postings(corpus, kind, spark.sparkContext.broadcast(vocabulary)), "postings")
        sums = postings.agg(F.count(F.when(F.col("_n") > 0, True)).alias("docs"), F.sum("_n").alias("terms")).collect()[0]
        documents, total = sums["docs"], max(sums["terms"] or 0, 1)
        held = postings.select(F.explode("_at").alias("_at")).groupBy("_at").agg(F.count(F.lit(1)).alias("df")).toArrow()  # one row a term
        weights = np.zeros(len(vocabulary), np.int64)
        for at, frequency in zip(held.column(0).to_pylist(), held.column(1).to_pylist(), strict=True):
            weights[at] = term_weight(documents, frequency)
        trees = _trees(postings.filter(F.size("_at") > 0), kind, documents, total, spark.sparkContext.broadcast(weights))
        trees = stored(trees, "trees")
        numbers = part.column("_item").to_numpy() if part.num_rows else np.zeros(0, np.int64)
        first = np.r_[0, np.cumsum(size)].astype(np.int64)
        known = [numbers, first, place.astype(np.int64), _flat(part, "_times"), np.zeros(len(numbers), np.int64)]
        seeds = _found(trees, kind, spark.sparkContext.broadcast(known), len(vocabulary), top, 1)
        reached = _best(seeds, top, order).groupBy("_item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score"))
        floor = {r["_item"]: r["score"] for r in reached.filter(F.col("n") == top).collect()}  # one row per item of the block
        known[4] = np.array([floor.get(int(q), 0) for q in numbers], np.int64)
        found = _best(_found(trees, kind, spark.sparkContext.broadcast(known), len(vocabulary), top, None), top, order)
        result = found if result is None else result.unionByName(found)
    chosen = wanted.join(texts, "_text").select("_item_id", "_item")
    named = chosen.join(result, "_item").select(
        F.col("_item_id").cast(item_kind).alias(item_name), "rank", F.col("_id").alias(doc_id), "score"
    )
    return named


def _flat(table: pa.Table, column: str) -> np.ndarray:
    if not table.num_rows:
        return np.zeros(0, np.int64)
    return np.array(table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False))


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SPLIT = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
)

ORACLE = f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS terms FROM documents), b AS (SELECT item_id, {_SPLIT} AS terms FROM benchmark),
size AS (SELECT doc_id, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS l FROM size),
posting AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM posting, total GROUP BY term),
wanted AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(terms) AS term FROM b) GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // l))))::BIGINT AS score
  FROM wanted JOIN weight USING (term) JOIN posting USING (term) JOIN size USING (doc_id), total GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
