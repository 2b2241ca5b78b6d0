"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel compares two letter strings by the subsequences of four letters they share. A subsequence may skip letters;
each skipped letter costs a factor ``DECAY`` and the letters must lie within ``SPAN``, so that insults with inserted
characters still resemble the plain ones. Strings are the words of a sentence with marks between letters removed
(``i.d.i.o.t``) and runs of three or more single letters joined (``i d i o t``).

Training uses sentences that inherit the label of their document, repeated sentences once. A toxic document's sentences
are mostly harmless, so words count as positive examples only where their frequency in toxic sentences is far above that
in clean ones. Landmarks are drawn from both kinds, every example is mapped by the Nyström method, and a squared-hinge
support vector machine is fitted. As its decision function is a sum over landmarks, it folds into one table over
subsequences, which scores all words of a text in a few array passes. A logistic function of a text's worst words and of
how many there are is its score.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candora.llm.shared import over_batches, stored

LENGTH = 4  # letters of a subsequence
SPAN = 6  # letters from its first to its last
DECAY = 0.5
SYMBOLS = 32
EDGE = 27  # symbol before and after a word
DOCUMENTS = 3000  # training documents per class at most, by smallest hash of the id
CANDIDATES = 4000  # words with the strongest contrast that are looked at
CLEAN_WORDS = 6000  # words of clean sentences used as negative examples, the most frequent and a hash sample
LANDMARKS = 400
FLOOR = 4.0  # added to the deviance that a word of toxic sentences must have
SUSPICIOUS = -0.5  # decision value from which a word counts as evidence
RIDGE = 1e-3
THRESHOLD = 0.3
PIECE = 1 << 20  # characters scored at a time

_OFFSETS = [(0, *rest) for rest in combinations(range(1, SPAN), LENGTH - 1)]


def _letter_table() -> np.ndarray:
    """Symbol of each code point below 0x10000: 0 separator, 1-26 letters (accents removed), 28-31 other scripts,
    255 for marks inside words, which are dropped."""
    import unicodedata

    table = np.full(0x10000, 255, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = 0
    table[0x1680] = table[0x3000] = table[0x00A0] = table[0x2028] = table[0x2029] = 0
    for code in range(0x2000, 0x200B):
        table[code] = 0
    for code in range(65, 0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        ch = chr(code)
        if not ch.isalpha():
            continue
        base = unicodedata.normalize("NFKD", ch)[0].lower()[:1] if code < 0x2000 or code >= 0xF900 else ch
        if "a" <= base <= "z":
            table[code] = ord(base) - 96
        else:
            table[code] = 28 + code % 4
    return table


_TABLE: list[np.ndarray] = []


def symbols(text: str) -> np.ndarray:
    """The text's words as symbols, each with one :data:`EDGE` before it and a last one at the end.

    Marks between letters vanish, and three or more words of one letter in a row are joined to one.
    """
    if not _TABLE:
        _TABLE.append(_letter_table())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sym = _TABLE[0][np.minimum(codes, 0xFFFF)]
    wide = codes > 0xFFFF
    if wide.any():
        sym = np.where(wide, np.uint8(255), sym)
    sym = sym[sym != 255]
    space = sym == 0
    # one separator between words, one at either end
    sym = np.concatenate([[np.uint8(0)], sym[~(space & np.r_[True, space[:-1]])], [np.uint8(0)]]).astype(np.uint8)
    if len(sym) > 1 and sym[-2] == 0:
        sym = sym[:-1]
    edges = np.flatnonzero(sym == 0)
    single = np.diff(edges) == 2
    if single.sum() >= 3:
        # a separator between two single letters goes if their run has three letters or more
        start = np.flatnonzero(single & ~np.r_[False, single[:-1]])
        stop = np.flatnonzero(single & ~np.r_[single[1:], False]) + 1
        drop = np.zeros(len(sym), bool)
        for low, high in zip(start, stop, strict=True):
            if high - low >= 3:
                drop[edges[low + 1 : high]] = True
        sym = sym[~drop]
    sym[sym == 0] = EDGE
    return sym


def _scale(size: np.ndarray) -> np.ndarray:
    """Norm of a word of ``size`` symbols with its edges, as if none of its subsequences were repeated."""
    total = np.zeros(len(size))
    for offsets in _OFFSETS:
        total += np.maximum(0, size - offsets[-1]) * DECAY ** (2 * (offsets[-1] - LENGTH + 1))
    return np.sqrt(np.maximum(total, 1.0))


def _subsequences(sym: np.ndarray):
    """Code, weight and place of every gapped subsequence that stays inside one word."""
    wide = sym.astype(np.int32)
    inner = np.cumsum(sym == EDGE)
    for offsets in _OFFSETS:
        span = offsets[-1]
        if len(sym) <= span:
            continue
        rows = len(sym) - span
        code = wide[:rows]
        for k in offsets[1:]:
            code = code * SYMBOLS + wide[k : k + rows]
        inside = inner[span - 1 : span - 1 + rows] == inner[:rows]
        yield code, DECAY ** (span - LENGTH + 1), inside, inner[:rows] - 1


def word_scores(sym: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Decision value of each word of :func:`symbols`, before the intercept."""
    edges = np.flatnonzero(sym == EDGE)
    if len(edges) < 2:
        return np.zeros(0)
    total = np.zeros(len(sym), np.float32)
    for code, weight, inside, _ in _subsequences(sym):
        total[: len(code)] += table[code] * (inside * np.float32(weight))
    sums = np.add.reduceat(total, edges[:-1])
    return sums / _scale(np.diff(edges) + 1)


def evidence(values: list[np.ndarray], words: int) -> np.ndarray:
    """What the decision values of a text's suspicious words (above :data:`SUSPICIOUS`) say about it: the three worst,
    how many there are of moderate and of strong ones, and their density."""
    found = np.sort(np.concatenate([np.full(3, SUSPICIOUS), *values]))[::-1]
    moderate, strong = int((found > 0.3).sum()), int((found > 0.7).sum())
    dense = 50 / max(1, words)
    return np.array([*found[:3], np.log1p(moderate), np.log1p(strong), min(3.0, moderate * dense), min(3.0, strong * dense)])


@dataclass
class ToxicityModel:
    """``table``: weight of each subsequence in a word's decision value; ``weights`` and ``offset`` turn the evidence of
    a text's words into its score, a sigmoid."""

    table: np.ndarray
    intercept: float
    weights: np.ndarray
    offset: float

    def evidence_of(self, texts: list[str | None]) -> np.ndarray:
        """Evidence of whole texts, one row each. Short texts are read together, long ones piece by piece at white
        space."""
        out, group, size = np.zeros((len(texts), 7)), [], 0

        def flush() -> None:
            if not group:
                return
            parts = [symbols(texts[k] or "") for k in group]
            # each part ends with an edge: between two parts lies an empty word without subsequences
            value = np.append(word_scores(np.concatenate(parts), self.table), -1.0) + self.intercept
            words = np.array([np.count_nonzero(p == EDGE) for p in parts]) - 1
            first = np.cumsum(words + 1) - (words + 1)
            value[(first + words)[:-1]] = SUSPICIOUS
            hits = np.flatnonzero(value[:-1] > SUSPICIOUS)
            low, high = np.searchsorted(hits, first), np.searchsorted(hits, first + words)
            for k, a, b, n in zip(group, low, high, words, strict=True):
                out[k] = evidence([value[hits[a:b]]], int(n))
            group.clear()

        for k, text in enumerate(texts):
            if text is not None and len(text) > PIECE // 4:
                out[k] = self._long(text)
                continue
            group.append(k)
            size += len(text or "")
            if size > PIECE // 4:
                flush()
                size = 0
        flush()
        return out

    def _long(self, text: str) -> np.ndarray:
        found, words, low = [], 0, 0
        while low < len(text):
            high = min(len(text), low + PIECE)
            while high < len(text) and not text[high].isspace():
                high += 1
            value = word_scores(symbols(text[low:high]), self.table) + self.intercept
            found.append(value[value > SUSPICIOUS])
            words += len(value)
            low = high
        return evidence(found, words)

    def score_many(self, texts: list[str | None]) -> np.ndarray:
        value = self.evidence_of(texts) @ self.weights + self.offset
        return 1 / (1 + np.exp(-np.clip(value, -30, 30)))

    def score(self, text: str | None) -> float:
        return float(self.score_many([text])[0])


def _features(strings: list[str], index: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Scaled kernel feature vectors of words, over the subsequences ``index`` (default: all that occur)."""
    parts = [symbols(s) for s in strings]
    entries = []
    for k, sym in enumerate(parts):
        for code, weight, inside, _ in _subsequences(sym):
            entries.append((np.full(int(inside.sum()), k), code[inside], np.full(int(inside.sum()), weight)))
    row, code, weight = (np.concatenate(x) if x else np.zeros(0) for x in zip(*entries, strict=True)) if entries else (
        np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    if index is None:
        index = np.unique(code)
    at = np.minimum(np.searchsorted(index, code), max(0, len(index) - 1))
    known = index[at] == code if len(index) else np.zeros(len(code), bool)
    dense = np.zeros((len(strings), len(index)), np.float32)
    np.add.at(dense, (row[known].astype(int), at[known]), weight[known])
    scale = _scale(np.array([len(s) for s in parts]))
    return dense / scale[:, None].astype(np.float32), index


def fit_words(words: list[str], toxic: np.ndarray, weight: np.ndarray) -> ToxicityModel:
    """Nyström features and squared-hinge support vector machine for labelled words.

    Without both classes the model scores everything low. The weights of a text's evidence are fitted by :func:`calibrate`.
    """
    size = SYMBOLS**LENGTH
    if not toxic.any() or toxic.all():
        return ToxicityModel(np.zeros(size, np.float32), -1.0, np.zeros(7), -4.0)
    positive, negative = np.flatnonzero(toxic), np.flatnonzero(~toxic)
    half = LANDMARKS // 2
    marks = np.r_[positive[:half], negative[: LANDMARKS - min(half, len(positive))]]
    landmarks, index = _features([words[k] for k in marks], None)
    kernel = landmarks.astype(np.float64) @ landmarks.T.astype(np.float64)
    values, vectors = np.linalg.eigh(kernel)
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    x = np.empty((len(words), int(good.sum())))
    for low in range(0, len(words), 500):
        dense, _ = _features(words[low : low + 500], index)
        x[low : low + 500] = (dense @ landmarks.T).astype(np.float64) @ whiten
    x = np.c_[x, np.ones(len(x))]
    y = np.where(toxic, 1.0, -1.0)
    cost = weight / np.where(toxic, weight[toxic].sum(), weight[~toxic].sum()) * len(words) / 2
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1.0)
    ridge[-1] = 1e-3
    for _ in range(30):  # Newton steps on the squared hinge; each solves for the present set of margin violations
        inside = y * (x @ w) < 1
        xs = x[inside] * cost[inside, None]
        fresh = np.linalg.solve(x[inside].T @ xs + np.diag(ridge), xs.T @ y[inside])
        if np.allclose(fresh, w, atol=1e-7):
            break
        w = fresh
    beta = whiten @ w[:-1]
    table = np.zeros(size, np.float32)
    table[index] = landmarks.T.astype(np.float64) @ beta
    return ToxicityModel(table, float(w[-1]), np.zeros(7), -4.0)


_SENTENCE = r"[^.!?\n]+"


def _sentence_words(rows: DataFrame) -> DataFrame:
    """``_word`` (cleaned letters), ``_toxic`` sentences and ``_clean`` sentences that hold it, repeated sentences once."""
    sentences = rows.select("_toxic", F.explode(F.regexp_extract_all(F.lower("_text"), F.lit(_SENTENCE), F.lit(0))).alias("_s"))
    sentences = sentences.withColumn("_s", F.trim("_s")).filter("_s != ''").groupBy("_s").agg(F.min("_toxic").alias("_toxic"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, toxic = [], []
        for text, flag in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sym = symbols(text)
            letters = np.where(sym == EDGE, 32, np.where(sym > EDGE, 150 + sym, 96 + sym.astype(int))).astype(np.uint8)
            own = {w for w in letters.tobytes().decode("latin-1").split() if 2 <= len(w) <= 40}
            words.extend(own)
            toxic.extend([flag] * len(own))
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int32())], ["_word", "_t"])

    exploded = over_batches(sentences.select("_s", "_toxic"), work, "_word string, _t int")
    return exploded.groupBy("_word").agg(
        F.sum("_t").alias("_toxic"), (F.count(F.lit(1)) - F.sum("_t")).alias("_clean")
    )


def _back(word: str) -> str:
    """Letters of :func:`_sentence_words` as a text that gives the same symbols."""
    other = {178: "а", 179: "б", 180: "в", 181: "г"}  # 28 + code % 4 of these is 28 to 31
    fixed = {28 + ord(c) % 4: c for c in other.values()}
    return "".join(c if c <= "z" else fixed[ord(c) - 150] for c in word)


def fit_toxicity(labelled: DataFrame, id_col: str, text_col: str, label_col: str) -> ToxicityModel:
    """Fit from labelled documents: at most :data:`DOCUMENTS` of each class, those with the smallest hash of the id.

    Null labels, null texts and labels other than 0 and 1 are left out. Only words and counts reach the driver.
    """
    rows = labelled.select(
        F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(label_col).cast("int").alias("_toxic")
    ).filter("_text IS NOT NULL AND _toxic IN (0, 1)")
    parts = [
        rows.filter(F.col("_toxic") == k).orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(DOCUMENTS)
        for k in (0, 1)
    ]
    sample = stored(parts[0].unionByName(parts[1]), "sample")
    model = _fit_sample(sample)
    found = _evidence(sample, model).toPandas()  # at most 2 * DOCUMENTS rows
    return calibrate(model, np.array(found["_found"].tolist(), float).reshape(len(found), 7), found["_toxic"].to_numpy() == 1)


def _evidence(sample: DataFrame, model: ToxicityModel) -> DataFrame:
    shared = sample.sparkSession.sparkContext.broadcast(model)  # 4 MB

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [shared.value.evidence_of(batch.column(0).slice(k, 200).to_pylist()) for k in range(0, batch.num_rows, 200)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows).tolist(), pa.list_(pa.float64())), batch.column(1)], ["_found", "_toxic"])

    return over_batches(sample.select("_text", "_toxic"), work, "_found array<double>, _toxic int")


def _fit_sample(sample: DataFrame) -> ToxicityModel:
    counts = stored(_sentence_words(sample), "words")
    total = counts.agg(F.sum("_toxic").alias("t"), F.sum("_clean").alias("c")).collect()[0]
    if not total["t"] or not total["c"]:
        return fit_words([], np.zeros(0, bool), np.zeros(0))
    share = total["t"] / (total["t"] + total["c"])
    vocabulary = counts.count()
    t, c = F.col("_toxic"), F.col("_clean")
    part = lambda x, p: F.when(x > 0, x * F.log(x / ((t + c) * p))).otherwise(0.0)
    deviance = 2 * (part(t, share) + part(c, 1 - share)) * F.signum(t - (t + c) * share)
    rated = counts.withColumn("_g", deviance)
    # twice the logarithm of the number of words looked at: words that are frequent in toxic sentences by chance stay out
    limit = 2 * float(np.log(max(2, vocabulary))) + FLOOR
    strong = rated.filter((F.col("_g") > limit) & (t > 4 * share / (1 - share) * (c + 0.5)))
    strong = strong.orderBy(F.desc("_g"), "_word").limit(CANDIDATES).collect()
    clean = rated.filter((c > 0) & (F.col("_g") <= limit))
    common = clean.orderBy(F.desc("_clean"), "_word").limit(CLEAN_WORDS // 3).collect()
    spread = clean.orderBy(F.xxhash64("_word"), "_word").limit(CLEAN_WORDS - CLEAN_WORDS // 3).collect()
    return _fit_rows(strong, [*common, *spread])


def _fit_rows(strong: list, negative: list) -> ToxicityModel:
    clean = {r["_word"]: r["_clean"] for r in negative}
    words = [_back(w) for w in [*(r["_word"] for r in strong), *clean]]
    toxic = np.r_[np.ones(len(strong), bool), np.zeros(len(clean), bool)]
    weight = np.sqrt(np.array([r["_toxic"] for r in strong] + list(clean.values()), float))
    return fit_words(words, toxic, weight)


def calibrate(model: ToxicityModel, found: np.ndarray, toxic: np.ndarray) -> ToxicityModel:
    """Logistic regression of the label on the evidence, both classes weighing the same; the score :data:`THRESHOLD` is
    then placed where it separates the documents best, in the middle of the widest such gap."""
    if not toxic.any() or toxic.all():
        return model
    mean, scale = found.mean(0), found.std(0) + 1e-9
    x = np.c_[(found - mean) / scale, np.ones(len(found))]
    weight = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
    ridge = np.r_[np.full(x.shape[1] - 1, RIDGE), 1e-9]
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (p - toxic)) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    value = np.sort(x @ w)
    order = np.argsort(x @ w, kind="stable")
    missed = np.r_[0, np.cumsum(toxic[order])] / toxic.sum()
    alarms = 1 - np.r_[0, np.cumsum(~toxic[order])] / (~toxic).sum()
    edges = np.r_[value[0] - 1.0, value, value[-1] + 1.0]
    gap, loss = np.diff(edges), missed + alarms
    loss[gap <= 0] = np.inf
    best = np.flatnonzero(loss <= loss.min() + 1e-12)
    at = best[np.argmax(gap[best])]
    border = (edges[at] + edges[at + 1]) / 2
    offset = w[-1] - (w[:-1] * mean / scale).sum() - border + np.log(THRESHOLD / (1 - THRESHOLD))
    return ToxicityModel(model.table, model.intercept, w[:-1] / scale, float(offset))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str, text_col: str) -> DataFrame:
    """``id_col`` and ``score`` (0 to 1) of every whole text; null, empty and wordless texts score low.

    Repeated words are evidence: a text with an insult five times scores at least what one with it once does. Null and
    repeated ids and repeated rows are scored one by one, and equal texts score equal. Texts of more than
    :data:`PIECE` characters are read piece by piece, cut at white space. Empty tables give an empty result; other columns,
    whatever their names, don't matter.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB, whatever the data

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1)
        scores = [shared.value.score_many(texts.slice(k, 200).to_pylist()) for k in range(0, len(texts), 200)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores))], [id_col, "score"])

    return over_batches(
        docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_scored_text")), work, f"`{id_col}` {kind}, score double"
    )


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, all columns, whose text scores below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB, whatever the data
    at = docs.columns.index(text_col)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at)
        scores = [shared.value.score_many(texts.slice(k, 200).to_pylist()) for k in range(0, len(texts), 200)]
        return batch.filter(pa.array(np.concatenate(scores) < threshold))

    return over_batches(docs, work, docs.schema)


def in_training(id_col: str):
    """Documents that may teach: crc32 of the id as text, modulo 4, is not 2. Those without an id don't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2, F.lit(False))


def fit_from_folder(spark, docs: DataFrame, sf_dir: str) -> ToxicityModel:
    """Model from ``docs`` and the ``labels`` table, held-out documents excluded."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("_label_id"), "toxic")
    labels = labels.filter(in_training("_label_id") & F.col("toxic").isin(0, 1))
    picked = [
        labels.filter(F.col("toxic") == k).orderBy(F.xxhash64(F.col("_label_id").cast("string")), "_label_id").limit(DOCUMENTS)
        for k in (0, 1)
    ]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * DOCUMENTS rows at most
    teaching = docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("_label_id"))
    return fit_toxicity(stored(teaching.select("doc_id", "text", "toxic"), "teaching"), "doc_id", "text", "toxic")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_from_folder(spark, docs, sf_dir)
    scored = score_toxicity(docs, model, "doc_id", "text")
    return scored.select(
        "doc_id", (~in_training("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
