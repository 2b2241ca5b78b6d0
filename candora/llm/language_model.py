"""Trigram language model as a weighted backoff automaton, learned from and applied to whole corpora.

States are the beginning of a text and the words and word pairs seen in training. A state h has an arc for every word w
seen after it, with weight ``(c(h w) + m p(w)) / (c(h) + m)``, where p belongs to the state without h's first word, and a
failure arc to that state with weight ``m / (c(h) + m)``. The root's arcs carry add-one unigram probabilities, one of
them for the unknown word. Weights out of a state sum to one. A text is read once from left to right: from the present
state the arc of the next word is taken, or failure arcs down to a state that has one, and the logarithms add up. A word
unknown in training leads back to the root.

The automaton of a large corpus fits no machine, so each task builds the part its texts can reach (:class:`Automaton`)
and walks it, all texts of a chunk side by side, one token a step. Long texts are walked in segments: which state a
segment begins in is known from the two tokens before it. Texts are cut into chunks. A chunk asks for the counts of its distinct words, pairs and triples, in packed requests per range of the hash
space; each range adds up the counts of all chunks and answers every request in the order of its keys. Work, shuffled
bytes and answers grow with the input; no task holds more than a chunk or a range, whatever the word frequencies.

The smoothing weight is ``m = a c(h) ** b`` with a and b for pairs and triples from :data:`SMOOTHING`: the choice under
which training texts set aside for this (one in seven) are likeliest when their own counts are taken out. All choices
are scored in the same walk. Only these set-aside texts are also scored by formula, since no automaton leaves out each
text's own counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candora.llm import tokens
from candora.llm.packing import pack, pack_keys, range_slices, unpack, unpack_keys
from candora.llm.shared import stored, stored_chunks

CHUNK_TOKENS = 1 << 19
RANGE_TOKENS = 1 << 20  # tokens of the corpus per range of the hash space
GUARD_BITS = 24
# a and b of words, then of pairs: from texts that mostly repeat one another to texts that never do
SMOOTHING = [(1, 0.9, 0.25, 1), (4, 0.75, 1, 0.75), (4, 0.9, 1, 0.5), (4, 0.9, 1, 1), (16, 0.9, 4, 1), (64, 1, 16, 1)]
SEGMENT = 256  # tokens that one walk follows; longer texts are several walks
END, BEGIN = np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B)
PAIR, TRIPLE = np.uint64(0x3C6EF372FE94F82B), np.uint64(0xA54FF53A5F1D36F1)


def _chunks(docs: DataFrame) -> DataFrame:
    """One row per chunk: ids, held-out and tuning flags, tokens per text, token codes, and the hash of each code."""
    kind = docs.schema["_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = number = 0

        def chunk() -> pa.RecordBatch:
            hashes = np.concatenate([h[3] for h in held])
            vocabulary, code = np.unique(hashes, return_inverse=True)
            offsets = lambda column: pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
            join = lambda k: pa.concat_arrays([h[k] for h in held])
            lengths = pa.array(np.concatenate([h[4] for h in held]), pa.int64())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{TaskContext.get().partitionId()}-{number}"]), offsets(join(0)), offsets(join(1)), offsets(join(2)),
                    offsets(lengths), pa.array([pack(code)], pa.binary()), pa.array([pack_keys(vocabulary)], pa.binary()),
                    pa.array([len(hashes)], pa.int64()),
                ],
                ["_chunk", "_ids", "_held", "_tune", "_lengths", "_codes", "_words", "_size"],
            )

        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                data, offsets = tokens.buffers(part.column(3))
                for first, last in tokens.row_groups(offsets, 4 * tokens.PIECE_BYTES):
                    own = offsets[first : last + 1]
                    found = tokens.words(data[own[0] : own[-1]], own - own[0], lower=True)
                    hashes = np.insert(found.hash, found.first[1:], END)
                    rows = part.slice(first, last - first)
                    held.append((rows.column(0), rows.column(1), rows.column(2), hashes, found.counts() + 1))
                    size += len(hashes)
                    if size >= CHUNK_TOKENS:
                        yield chunk()
                        held.clear()
                        size, number = 0, number + 1
        if held:
            yield chunk()

    schema = (
        f"_chunk string, _ids array<{kind}>, _held array<boolean>, _tune array<boolean>, _lengths array<long>, "
        "_codes binary, _words binary, _size long"
    )
    return docs.mapInArrow(work, schema)


def _numbered(values: np.ndarray, first: np.ndarray, last: np.ndarray, salt: np.uint64, spare: int):
    """Distinct values by hash: sorted hashes, and for every value its place among them. ``first`` and ``last`` hold the
    hashes of a value's parts."""
    _, at, inverse = np.unique(values, return_index=True, return_inverse=True)
    keys = tokens.mix(first[at] * salt + tokens.mix(last[at])) >> np.uint64(spare) << np.uint64(spare)
    order = np.argsort(keys, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return keys[order], place[inverse]


class Chunk:
    """Decoded chunk: its tokens, the words, pairs and triples that end at each of them, and their hashes.

    A pair is a token and what stands before it, the beginning of a text included; a triple is a token and the pair
    that ends before it (-1 for the first token of a text).
    """

    def __init__(self, held, lengths, codes: bytes, words: bytes, spare: int):
        self.lengths = np.asarray(lengths, np.int64)
        self.code = unpack(codes).astype(np.int64)
        self.words = unpack_keys(words)  # 64 bits: what is counted of words is exact
        self.held = np.asarray(held, bool)
        self.start = np.cumsum(self.lengths) - self.lengths
        self.before = np.empty(len(self.code), np.int64)
        self.before[1:] = self.code[:-1]
        self.before[self.start] = len(self.words)  # the beginning of a text
        states, token = np.append(self.words, BEGIN), self.words[self.code]
        size = max(1, len(self.words))
        self.pairs, self.pair = _numbered(self.before * size + self.code, states[self.before], token, PAIR, spare)
        inner = np.ones(len(self.code), bool)
        inner[self.start] = False
        self.inner = np.flatnonzero(inner)
        context = self.pair[self.inner - 1]
        values = context * size + self.code[self.inner]
        self.triples, self.triple = _numbered(values, self.pairs[context], token[self.inner], TRIPLE, spare)
        self.taught = ~np.repeat(self.held, self.lengths)

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.words, self.pairs, self.triples

    def counts(self) -> list[np.ndarray]:
        """Occurrences of the distinct words, pairs and triples in training texts of the chunk."""
        taught = (self.code[self.taught], self.pair[self.taught], self.triple[self.taught[self.inner]])
        return [np.bincount(x, minlength=len(k)) for x, k in zip(taught, self.keys(), strict=True)]


def _spare_bits(size: int) -> int:
    """Low bits of a pair's or triple's key that can go: what is left tells each of ``size`` tokens' pairs and triples
    from all others but for one in ``2 ** GUARD_BITS``, in small corpora as in large ones."""
    return max(0, 64 - GUARD_BITS - (3 * size).bit_length())


def _requests(chunks: DataFrame, ranges: int, spare: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                name, held, lengths, codes, words = (batch.column(k)[row].as_py() for k in range(5))
                chunk = Chunk(held, lengths, codes, words, spare)
                out = []
                for kind, (keys, counts) in enumerate(zip(chunk.keys(), chunk.counts(), strict=True)):
                    for r, own in range_slices(keys, ranges):
                        out.append((r, kind, name, pack_keys(keys[own], spare if kind else 0), pack(counts[own])))
                columns = list(zip(*out, strict=True))
                kinds = [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["_range", "_kind", "_chunk", "_keys", "_counts"]
                )

    rows = chunks.select("_chunk", "_held", "_lengths", "_codes", "_words")
    return rows.mapInArrow(work, "_range int, _kind int, _chunk string, _keys binary, _counts binary")


def _answer(table: pa.Table) -> pa.Table:
    """Add up the counts of a range; answer each request, and report the words' numbers (``_kind`` 3)."""
    out, stats = [], [0, 0]
    ranged = table.column("_range")[0].as_py() if table.num_rows else 0
    for kind in (0, 1, 2):
        rows = [r for r in table.to_pylist() if r["_kind"] == kind]
        if not rows:
            continue
        keys = [unpack_keys(r["_keys"]) for r in rows]
        own, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([unpack(r["_counts"]) for r in rows])
        total = np.bincount(inverse, weights=counts, minlength=len(own)).astype(np.int64)  # exact below 2 ** 53
        answers = total[inverse]
        at = 0
        for r, k in zip(rows, keys, strict=True):
            out.append((ranged, kind, r["_chunk"], pack(answers[at : at + len(k)])))
            at += len(k)
        if kind == 0:
            stats = [int(total.sum()), int((total > 0).sum())]
    out.append((ranged, 3, None, np.array(stats, np.int64).tobytes()))
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.binary()]
    return pa.Table.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["_range", "_kind", "_chunk", "_answer"]
    )


@dataclass
class Automaton:
    """States 0 (the root), then words, the beginning of a text, and pairs; weights are logarithms, one per smoothing.

    ``arc_key`` is state times ``words`` plus word, sorted. The root has an arc for every word. Every other state has a
    failure arc; what it lacks an arc for is asked of the state that this leads to.
    """

    words: int
    arc_key: np.ndarray
    arc_weight: np.ndarray
    arc_next: np.ndarray
    root_weight: np.ndarray
    root_next: np.ndarray
    fail_weight: np.ndarray
    fail_next: np.ndarray
    entry: np.ndarray  # state after each token of the chunk
    begin: int

    def walk(self, code: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log10 probability of each text (its tokens begin at ``start`` of ``code``), a column per smoothing."""
        pieces = -(-lengths // SEGMENT)
        text = np.repeat(np.arange(len(start)), pieces)
        inside = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * SEGMENT
        first = start[text] + inside
        size = np.minimum(lengths[text] - inside, SEGMENT)
        state = np.where(inside > 0, self.entry[np.maximum(first - 1, 0)], self.begin)
        order = np.argsort(-size, kind="stable")
        text, first, size, state = text[order], first[order], size[order], state[order]
        score = np.zeros((len(text), self.fail_weight.shape[1]))
        for k in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -k, "left"))  # walks longer than k
            word, now = code[first[:live] + k], state[:live].copy()
            todo = np.arange(live)
            while len(todo):
                rooted = now[todo] == 0
                done = todo[rooted]
                score[done] += self.root_weight[word[done]]
                state[done] = self.root_next[word[done]]
                todo = todo[~rooted]
                key = now[todo] * self.words + word[todo]
                at = np.minimum(np.searchsorted(self.arc_key, key), max(len(self.arc_key) - 1, 0))
                hit = self.arc_key[at] == key if len(self.arc_key) else np.zeros(len(todo), bool)
                done = todo[hit]
                score[done] += self.arc_weight[at[hit]]
                state[done] = self.arc_next[at[hit]]
                todo = todo[~hit]
                score[todo] += self.fail_weight[now[todo]]
                now[todo] = self.fail_next[now[todo]]
        out = np.zeros((len(start), score.shape[1]))
        np.add.at(out, text, score)
        return out


def build_automaton(chunk: Chunk, counts: list[np.ndarray], texts: float, total: float, distinct: float) -> Automaton:
    """States and arcs that the chunk's texts can reach, from the corpus counts of its words, pairs and triples."""
    words, pairs = len(chunk.words), len(chunk.pairs)
    word_n, pair_n, triple_n = counts[0].astype(float), counts[1].astype(float), counts[2].astype(float)
    context_n = np.append(word_n, texts)  # every training token has a successor; the last is the beginning of a text
    before, word = np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
    before[chunk.pair], word[chunk.pair] = chunk.before, chunk.code
    context, under = np.zeros(len(chunk.triples), np.int64), np.zeros(len(chunk.triples), np.int64)
    context[chunk.triple], under[chunk.triple] = chunk.pair[chunk.inner - 1], chunk.pair[chunk.inner]
    unigram = (word_n + 1) / (total + (distinct + 1))
    pair_arc, triple_arc = np.flatnonzero(pair_n > 0), np.flatnonzero(triple_n > 0)
    word_state = np.where(word_n > 0, 1 + np.arange(words), 0)
    pair_state = words + 2 + np.arange(pairs)
    key = np.concatenate([(1 + before[pair_arc]) * words + word[pair_arc], pair_state[context[triple_arc]] * words + word[under[triple_arc]]])
    order = np.argsort(key, kind="stable")
    leads = np.concatenate([pair_state[pair_arc], pair_state[under[triple_arc]]])[order]
    # one column after the other into its place: the tables are the largest of the task
    arc_weight, fail_weight = np.empty((len(key), len(SMOOTHING))), np.zeros((words + 2 + pairs, len(SMOOTHING)))
    for k, (a, b, a3, b3) in enumerate(SMOOTHING):
        m, m3 = a * np.maximum(context_n, 1) ** b, a3 * np.maximum(pair_n, 1) ** b3
        of_pair = (pair_n + m[before] * unigram[word]) / (context_n[before] + m[before])
        of_triple = (triple_n[triple_arc] + (m3[context] * of_pair[under])[triple_arc]) / (pair_n[context] + m3[context])[triple_arc]
        arc_weight[:, k] = np.log10(np.concatenate([of_pair[pair_arc], of_triple])[order])
        fail_weight[1 : words + 2, k] = np.log10(m / (context_n + m))
        fail_weight[words + 2 :, k] = np.log10(m3 / (pair_n + m3))
    entry = np.where(pair_n[chunk.pair] > 0, pair_state[chunk.pair], word_state[chunk.code])
    fail_next = np.concatenate([np.zeros(words + 2, np.int64), word_state[word]])
    return Automaton(
        words, key[order], arc_weight, leads, np.log10(unigram)[:, None], word_state, fail_weight, fail_next, entry, words + 1 if texts else 0
    )


def traverse(chunk: Chunk, counts: list[np.ndarray], texts: float, total: float, distinct: float, tune: np.ndarray):
    """Per text: known tokens, base score, score under each smoothing, and score with its own counts taken out (tuning).

    ``counts`` are those of the whole corpus for the chunk's words, pairs and triples; ``texts``, ``total`` and
    ``distinct`` the training texts, tokens and words.
    """
    add = lambda x, at: np.add.reduceat(x, at) if len(at) else np.zeros(0)
    word, pair = counts[0][chunk.code].astype(float), counts[1][chunk.pair].astype(float)
    triple, around = np.zeros(len(word)), np.zeros(len(word))
    triple[chunk.inner], around[chunk.inner] = counts[2][chunk.triple], pair[chunk.inner - 1]
    context = np.append(counts[0], texts).astype(float)[chunk.before]  # every training token has a successor

    def logs(w, p, h, t, g, n) -> Iterator[np.ndarray]:
        unigram = (w + 1) / (n + (distinct + 1))
        for a, b, a3, b3 in SMOOTHING:
            # where there is no arc its count is 0, and what remains is the failure arc's weight and the arc below it
            m = a * np.maximum(h, 1) ** b
            below = (p + m * unigram) / (h + m)
            m = a3 * np.maximum(g, 1) ** b3
            yield np.log10((t + m * below) / (g + m))

    known = add((word > 0).astype(np.int64), chunk.start)
    base = add(np.log10((word + 1) / (total + (distinct + 1))), chunk.start)
    scores = build_automaton(chunk, counts, texts, total, distinct).walk(chunk.code, chunk.start, chunk.lengths)
    without = np.zeros_like(scores)
    pick = tune & ~chunk.held
    if pick.any():
        chosen = np.repeat(pick, chunk.lengths)
        text = np.repeat(np.arange(len(chunk.lengths)), chunk.lengths)

        def own(values: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
            _, inverse, n = np.unique(rows * (size + 1) + values, return_inverse=True, return_counts=True)
            return n[inverse].astype(float)

        size = len(chunk.words) + 1
        rows, inner = text[chosen], chosen[chunk.inner]
        own_word, own_pair = own(chunk.code[chosen], rows, size), own(chunk.pair[chosen], rows, len(chunk.pairs))
        own_before = own(chunk.before[chosen], rows, size)
        own_triple, own_around = np.zeros(len(word)), np.zeros(len(word))
        at = chunk.inner[inner]
        own_triple[at] = own(chunk.triple[inner], text[at], len(chunk.triples))
        spread = np.zeros(len(word))
        spread[chosen] = own_pair
        own_around[at] = spread[at - 1]
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        rest = np.maximum(total - chunk.lengths[rows], 1.0)
        left = (
            word[chosen] - own_word, pair[chosen] - own_pair, context[chosen] - own_before,
            triple[chosen] - own_triple[chosen], around[chosen] - own_around[chosen], rest,
        )
        without[rows[starts]] = np.stack([add(x, starts) for x in logs(*left)], 1)
    return known, base, scores, without


def score_texts(docs: DataFrame, held_out, tuning, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the texts that are not ``held_out`` and score all: one row per text.

    ``held_out`` and ``tuning`` are boolean columns of ``docs``; null counts as false. Columns: the id, ``held_out``,
    ``n_tokens`` (words and one end), ``n_known``, ``train_tokens``, ``base_score`` (add-one unigrams), ``score`` and
    ``smoothing`` (place in :data:`SMOOTHING`). A-Z is lower-cased. Null and empty texts are a lone end. Without training
    texts every token has the probability of the one unknown word. Repeated ids and rows are texts of their own.
    """
    rows = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(held_out, F.lit(False)).alias("_held"), F.coalesce(tuning, F.lit(False)).alias("_tune"),
        F.col(text_col).cast("string").alias("_text"),
    )
    chunks = stored_chunks(_chunks(rows), "chunks")
    size = chunks.agg(F.sum("_size").alias("n")).collect()[0]["n"] or 0
    texts = chunks.agg(F.sum(F.size(F.filter("_held", lambda x: ~x))).alias("n")).collect()[0]["n"] or 0
    ranges = int(max(4, -(-size // RANGE_TOKENS)))
    spare = _spare_bits(size)
    answers = _requests(chunks, ranges, spare).groupBy("_range").applyInArrow(_answer, "_range int, _kind int, _chunk string, _answer binary")
    answers = stored(answers, "answers")
    total = distinct = 0
    for row in answers.filter("_kind = 3").select("_answer").toLocalIterator():  # one small row per range
        numbers = np.frombuffer(row["_answer"], np.int64)
        total, distinct = total + int(numbers[0]), distinct + int(numbers[1])
    kind = docs.schema[id_col].dataType.simpleString()

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["_id", "held_out", "n_tokens", "n_known", "base_score", "_scores", "_without"]
        row = {c: left.column(c)[0].as_py() for c in ("_held", "_lengths", "_codes", "_words")}
        tune = np.asarray(left.column("_tune")[0].as_py(), bool)
        ids = left.column("_ids").combine_chunks().flatten()
        chunk = Chunk(row["_held"], row["_lengths"], row["_codes"], row["_words"], spare)
        order = right.select(["_kind", "_range", "_answer"]).sort_by([("_kind", "ascending"), ("_range", "ascending")])
        none = np.zeros(0, np.uint64)  # texts of a lone end have no triple
        found = [
            np.concatenate([none, *(unpack(a) for k, a in zip(order.column(0).to_pylist(), order.column(2).to_pylist(), strict=True) if k == kind)])
            for kind in (0, 1, 2)
        ]
        known, base, scores, without = traverse(chunk, found, texts, float(total), float(distinct), tune)
        lists = lambda x: pa.ListArray.from_arrays(
            pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(SMOOTHING)), pa.array(np.ascontiguousarray(x).reshape(-1))
        )
        return pa.Table.from_arrays(
            [ids, pa.array(chunk.held), pa.array(chunk.lengths), pa.array(known), pa.array(base), lists(scores), lists(without)], names
        )

    schema = f"_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, _scores array<double>, _without array<double>"
    requests = answers.filter("_kind < 3").select("_chunk", "_kind", "_range", "_answer")
    scored = chunks.groupBy("_chunk").cogroup(requests.groupBy("_chunk")).applyInArrow(finish, schema)
    scored = stored(scored, "scored")
    sums = scored.agg(*[F.sum(F.col("_without")[k]).alias(f"s{k}") for k in range(len(SMOOTHING))]).collect()[0]
    likelihood = [sums[f"s{k}"] or 0.0 for k in range(len(SMOOTHING))]
    best = int(np.argmax(likelihood)) if any(likelihood) else 3
    return scored.select(
        F.col("_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score",
        F.col("_scores")[best].alias("score"), F.lit(best).alias("smoothing"),
    )


def op5_language_model(spark, sf_dir: str) -> DataFrame:
    """Log10 probability of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    return score_texts(docs, remainder == 2, remainder == 3)
