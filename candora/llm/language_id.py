"""Language identification: sparse multinomial logistic regression on TF-IDF weighted character n-grams.

Texts become lower-case letters with one boundary sign for everything between them; all runs of one to three signs are
hashed to :data:`BUCKETS` features. Document frequencies come from every training document. The regression is trained
by follow-the-regularised-leader with elastic-net penalties, which leaves most weights zero, on a bounded sample with
equally many documents per language; a part of the sample is set aside to fit the temperature that calibrates scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candora.llm.shared import over_batches, stored

BUCKETS = 1 << 16
SAMPLE = 4000  # training documents read by the regression in expectation, divided among the languages
MAX_LANGUAGES = 500  # the sample must leave several documents per language; more languages are an error
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-3, 1e-4
PIECE = 1 << 20  # characters taken at a time

_TABLES: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Lower-case code point of each letter below 0x10000, 0 for everything else."""
    if not _TABLES:
        table = np.zeros(0x10000, np.uint32)
        for code in range(0x10000):
            ch = chr(code)
            if ch.isalpha():
                table[code] = ord(ch.lower()[0])
        _TABLES.append(table)
    return _TABLES[0]


def _signs(text: str) -> np.ndarray:
    """Lower-case letters as code points, 0 for anything else."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sign = _letters()[np.minimum(codes, 0xFFFF)]
    wide = codes > 0xFFFF
    if wide.any():
        alpha = {int(c): ord(chr(c).lower()[0]) for c in np.unique(codes[wide]) if chr(c).isalpha()}
        sign[wide] = [alpha.get(int(c), 0) for c in codes[wide]]
    return sign


def _features(sign: np.ndarray, seen: int) -> np.ndarray:
    """Feature of every n-gram that ends at or after place ``seen``."""
    sign = sign.astype(np.uint64)
    parts = []
    for n in (1, 2, 3):
        first = max(0, seen - n + 1)
        rows = len(sign) - n + 1 - first
        if rows <= 0:
            continue
        total = np.full(rows, n, np.uint64)
        for k in range(n):
            total = (total + sign[first + k : first + k + rows]) * np.uint64(0x9E3779B97F4A7C15)
        total = (total ^ (total >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        code = (total >> np.uint64(48)).astype(np.int64)
        parts.append(code[sign[first : first + rows] != 0] if n == 1 else code)
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def text_counts(text: str) -> np.ndarray | None:
    """Number of occurrences of each feature in a whole text; None if it has no letter."""
    total = None
    tail, letters = np.zeros(1, np.uint32), False
    for low in range(0, len(text) + 1, PIECE):
        sign = _signs(text[low : low + PIECE])
        if low + PIECE > len(text):
            sign = np.append(sign, np.uint32(0))  # what follows the last letter
        # one boundary sign between letters, also across pieces
        sign = sign[~((sign == 0) & (np.r_[tail[-1:], sign[:-1]] == 0))]
        letters = letters or bool(sign.any())
        joined = np.concatenate([tail, sign])
        if len(sign):
            counts = np.bincount(_features(joined, len(tail)), minlength=BUCKETS)
            total = counts if total is None else total + counts
        tail = joined[-2:]
    return total if letters else None


@dataclass
class LanguageModel:
    """``weights`` (features by languages), ``bias``, ``idf`` and the calibrating ``temperature``."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def logits(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = weighted(counts, self.idf[features])
        return x @ self.weights[features] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = text_counts(text) if text and self.languages else None
        if counts is None:
            return "und", 0.0
        seen = np.flatnonzero(counts)
        p = softmax(self.logits(seen, counts[seen]) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF vector of length 1."""
    x = counts * idf
    return x / np.sqrt((x * x).sum())


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def train_ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], languages: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by follow-the-regularised-leader (per-coordinate rates, L1 and L2); the bias is not penalised."""
    z = np.zeros((BUCKETS + 1, languages))
    n = np.zeros((BUCKETS + 1, languages))
    l1 = np.full((1, languages), L1)

    def weights(at: np.ndarray) -> np.ndarray:
        pull = np.where((at == BUCKETS)[:, None], 0.0, l1)
        held = np.abs(z[at]) <= pull
        return np.where(held, 0.0, -(z[at] - np.sign(z[at]) * pull) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(examples)):
            features, x, y = examples[k]
            at = np.append(features, BUCKETS)
            value = np.append(x, 1.0)
            w = weights(at)
            error = softmax(value @ w)
            error[y] -= 1
            g = value[:, None] * error
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - rate * w
            n[at] += g * g
    final = weights(np.arange(BUCKETS + 1))
    return final[:-1].astype(np.float32), final[-1]


def fit_temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """Temperature with the smallest negative log likelihood, by golden-section search."""
    if not len(truth):
        return 1.0

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(truth)), truth]).mean())

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, and the number of texts with a letter."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                for text in batch.column(0).slice(low, 200).to_pylist():
                    counts = text_counts(text) if text else None
                    if counts is not None:
                        total += counts > 0
                        rows += 1
        if rows:
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(seen, BUCKETS).astype(np.int32)), pa.array(np.append(total[seen], rows))], ["f", "n"]
            )

    summed = texts.mapInArrow(work, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS + 1, np.int64)
    df[summed["f"].to_numpy()] = summed["n"].to_numpy()
    return df[:BUCKETS], int(df[BUCKETS])


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on every row for the document frequencies, and on a sample of about :data:`SAMPLE` rows for the weights.

    Rows with a null text or language, and texts without a letter, teach nothing. Without any language the model
    answers ``und`` for everything.
    """
    rows = docs.select(
        F.col(id_col).cast("string").alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang")
    ).filter("_text IS NOT NULL AND _lang IS NOT NULL")
    found = rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(r["_lang"] for r in found)
    empty = LanguageModel(languages, np.zeros((BUCKETS, len(languages)), np.float32), np.zeros(len(languages)), np.ones(BUCKETS))
    if not languages:
        return empty
    df, texts = _document_frequencies(rows.select("_text"))
    idf = np.log((1 + texts) / (1 + df)) + 1
    each = SAMPLE / len(languages)
    share = {r["_lang"]: min(1.0, each / r["n"]) for r in found}
    place = F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1 << 30)) / (1 << 30)
    wanted = F.lit(False)
    for lang, part in share.items():
        wanted = wanted | ((F.col("_lang") == lang) & (place < part))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        features, counts = [], []
        for text in batch.column(1).to_pylist():
            total = text_counts(text)
            seen = np.flatnonzero(total) if total is not None else np.zeros(0, int)
            features.append(seen.astype(np.int32))
            counts.append((total[seen] if total is not None else seen).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(features, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
            ["id", "lang", "features", "counts"],
        )

    sample = over_batches(
        rows.filter(wanted).select("_id", "_text", "_lang"), work, "id string, lang string, features array<int>, counts array<int>"
    )
    sample = stored(sample, "sample").filter(F.size("features") > 0)
    table = sample.withColumn("aside", F.crc32(F.concat(F.lit("aside"), "id").cast("binary")) % 5 == 0)
    # repeated ids are told apart by what they count, so that the order of training is the same in every run
    table = table.orderBy("id", F.xxhash64("features", "counts"), "lang").toArrow()
    number = {lang: k for k, lang in enumerate(languages)}
    examples, aside = [], []
    for lang, features, counts, set_aside in zip(*(table.column(c) for c in ("lang", "features", "counts", "aside")), strict=True):
        f = features.values.to_numpy()
        c = counts.values.to_numpy()
        (aside if set_aside.as_py() else examples).append((f, weighted(c, idf[f]), number[lang.as_py()]))
    weights, bias = train_ftrl(examples, len(languages))
    logits = np.array([x @ weights[f] + bias for f, x, _ in aside]).reshape(len(aside), len(languages))
    temperature = fit_temperature(logits, np.array([y for _, _, y in aside], int))
    return LanguageModel(languages, weights, bias, idf, temperature)


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score`` of every whole text; ``und`` with score 0 where there is no letter.

    Null and empty texts have no letter. Null and repeated ids and repeated rows are predicted one by one; equal texts get
    equal predictions, however long they are. Empty tables give an empty result; other columns, whatever their names,
    don't matter. A model that learned no language predicts ``und``.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS by at most MAX_LANGUAGES numbers

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for low in range(0, batch.num_rows, 200):
            found += [shared.value.predict(text) for text in batch.column(1).slice(low, 200).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([f[0] for f in found]), pa.array([f[1] for f in found])], [id_col, "lang_pred", "score"]
        )

    return over_batches(
        docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")),
        work,
        f"`{id_col}` {kind}, lang_pred string, score double",
    )


def in_training(id_col: str):
    """Documents that may teach: crc32 of the id as text, modulo 4, is not 2. Those without an id don't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2, F.lit(False))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_languages(docs.filter(in_training("doc_id")))
    found = predict_languages(docs, model)
    return found.select("doc_id", (~in_training("doc_id")).alias("held_out"), "lang_pred", "score")
