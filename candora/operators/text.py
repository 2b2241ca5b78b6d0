"""Tokens, vocabulary, TF-IDF, embeddings and PCA."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA, PCAModel, StandardScaler, StandardScalerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candora.functions.text import ngrams, tokens
from candora.plans.ordering import global_row_number, running_totals
from candora.plans.skew import spread_join
from candora.plans.storage import freeze

Encoder = Callable[[list[str]], np.ndarray]


def tokenize_words(df: DataFrame, column: str = "text", out: str = "tokens") -> DataFrame:
    """Add the array of lower-cased, accent-free tokens of two or more word characters."""
    return df.withColumn(out, tokens(F.col(column)))


def word_ngrams(df: DataFrame, low: int = 1, high: int = 2, column: str = "text") -> DataFrame:
    """Add ``terms``: all n-grams of the text's tokens, in order."""
    tokenized = tokenize_words(df, column, "_tokens")
    return tokenized.withColumn("terms", ngrams(F.col("_tokens"), low, high)).drop("_tokens")


TEXTS_PER_STEP = 500  # texts whose terms are counted at a time
TOKENS_PER_STEP = 500_000  # tokens of the texts whose terms are looked up or added up at a time, but for one long text


@dataclass
class _Counts:
    """Distinct terms of some texts: row and frequency of each, ordered by row; names on demand."""

    row: np.ndarray
    tf: np.ndarray
    term: pa.Array


def _count_terms(tokenized: pa.Array, low: int, high: int) -> _Counts:
    """Count the n-grams of every token array, whole arrays at a time."""
    lengths = pc.fill_null(pc.list_value_length(tokenized), 0).to_numpy(zero_copy_only=False)
    words = pc.dictionary_encode(tokenized.flatten())
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    rows, counts, terms = [], [], []
    gram, names = code, words.dictionary
    for n in range(1, high + 1):
        if n > 1:
            ends = max(0, len(gram) - 1)
            same = row[:ends] == row[n - 1 :][:ends]
            # a gram with a negative number crosses the end of a text
            pair = gram[:-1] * (len(words.dictionary) + 1) + code[n - 1 :][:ends]
            pair = np.where(same & (gram[:-1] >= 0), pair, -1)
            distinct, inverse = np.unique(pair, return_inverse=True)
            inside = distinct >= 0
            first, last = (pa.array(x[inside]) for x in np.divmod(distinct, len(words.dictionary) + 1))
            names = pc.binary_join_element_wise(names.take(first), words.dictionary.take(last), " ")
            gram = inverse - int((~inside).sum())
        if n < low:
            continue
        taken = np.flatnonzero(gram >= 0)
        key, tf = np.unique(row[taken] * max(1, len(names)) + gram[taken], return_counts=True)
        r, g = np.divmod(key, max(1, len(names)))
        rows.append(r)
        counts.append(tf)
        terms.append(names.take(pa.array(g)))
    r = np.concatenate(rows)
    order = np.argsort(r, kind="stable")
    return _Counts(r[order], np.concatenate(counts)[order], pa.concat_arrays(terms).take(pa.array(order)))


def _counted_steps(batches: Iterator[pa.RecordBatch], low: int, high: int) -> Iterator[tuple[pa.RecordBatch, _Counts]]:
    """Arrow batches with a last column of tokens, cut to steps, and their counts."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_PER_STEP):
            step = batch.slice(at, TEXTS_PER_STEP)
            yield step, _count_terms(step.column(step.num_columns - 1), low, high)


def _tokenized(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, tokens(F.col("text")).alias("_tokens"))


def term_counts(df: DataFrame, low: int = 1, high: int = 2) -> DataFrame:
    """``(review_id, term, tf)``. A text's terms are counted where the text is: nothing is shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step, found in _counted_steps(batches, low, high):
            yield pa.RecordBatch.from_arrays(
                [step.column(0).take(pa.array(found.row)), found.term, pa.array(found.tf, pa.int64())], ["review_id", "term", "tf"]
            )

    kind = df.schema["review_id"].dataType.simpleString()
    return _tokenized(df, ["review_id"]).mapInArrow(work, f"review_id {kind}, term string, tf bigint")


def _token_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array]]:
    """Arrow batches with a last column of tokens, cut to steps by their tokens: the step, each token's row, and the tokens."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < batch.num_rows:
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + TOKENS_PER_STEP, "right")))
            step = batch.slice(low, high - low)
            sizes = np.diff(ends[low:high], prepend=before)
            yield step, np.repeat(np.arange(high - low), sizes), step.column(step.num_columns - 1).flatten()
            low = high


def _term_sums(df: DataFrame, low: int, high: int) -> DataFrame:
    """``(term, df, cf)`` with several rows a term: texts that hold it and how often, added up where the texts are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step, row, found in _token_steps(batches):
            words = pc.dictionary_encode(found)
            code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            base = max(1, len(words.dictionary))
            gram, at, names = code, np.arange(len(code)), words.dictionary  # grams, where they start, and their terms
            for n in range(1, high + 1):
                if n > 1:
                    inside = at + n - 1 < len(code)
                    inside[inside] = row[at[inside]] == row[at[inside] + n - 1]
                    at, gram = at[inside], gram[inside]
                    distinct, gram = np.unique(gram * base + code[at + n - 1], return_inverse=True)
                    first, last = (pa.array(x) for x in np.divmod(distinct, base))
                    names = pc.binary_join_element_wise(names.take(first), words.dictionary.take(last), " ")
                if n < low or not len(names):
                    continue
                times = np.bincount(gram, minlength=len(names))
                # texts that hold a gram: its first place in each
                held = np.unique(gram * max(1, step.num_rows) + row[at]) // max(1, step.num_rows)
                texts = np.bincount(held, minlength=len(names))
                yield pa.RecordBatch.from_arrays([names, pa.array(texts, pa.int64()), pa.array(times, pa.int64())], ["term", "df", "cf"])

    return _tokenized(df, []).mapInArrow(work, "term string, df bigint, cf bigint")


def build_vocabulary(
    df: DataFrame, max_features: int = 50_000, min_df: int = 2, low: int = 1, high: int = 2
) -> DataFrame:
    """``(term, df, cf)``: terms in at least ``min_df`` texts, the ``max_features`` most frequent of them.

    Ties are broken by term. The frequency at the cut comes from a histogram of frequencies, so only terms
    at or above it are ever ranked, and the ranking is distributed.
    """
    terms = freeze(
        _term_sums(df, low, high)
        .groupBy("term")
        .agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        .filter(F.col("df") >= min_df)
    )
    histogram = terms.groupBy("cf").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(histogram, [], [F.desc("cf")], {"cum": "n"})
    reached = ranked.filter(F.col("cum") >= max_features).agg(F.max("cf").alias("cut")).collect()
    cut = reached[0]["cut"]
    if cut is None:
        return terms
    candidates = terms.filter(F.col("cf") >= cut)
    kept = global_row_number(candidates, [F.desc("cf"), "term"], "_rank")
    return kept.filter(F.col("_rank") < max_features).drop("_rank")


@dataclass
class TfidfModel:
    """Vocabulary with inverse document frequencies: ``(term, idf, index)``."""

    vocabulary: DataFrame
    size: int


def tfidf_fit(
    df: DataFrame, max_features: int = 50_000, min_df: int = 2, low: int = 1, high: int = 2
) -> TfidfModel:
    """Smoothed inverse document frequency ``ln((1 + n) / (1 + df)) + 1`` over the training texts."""
    total = df.count()
    vocabulary = build_vocabulary(df, max_features, min_df, low, high)
    idf = F.log(F.lit(1.0 + total) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    indexed = global_row_number(vocabulary.withColumn("idf", idf), ["term"], "index")
    indexed = indexed.select("term", "df", "cf", "idf", F.col("index").cast("int").alias("index"))
    return TfidfModel(indexed, indexed.count())


BROADCAST_TERMS = 1_000_000  # largest vocabulary that is broadcast


@dataclass
class _Known:
    """A vocabulary for looking up grams by number: no term is spelt out to be found.

    ``grams[n - 1]`` holds the sorted keys of the grams of ``n`` words that begin a term (number of the gram before times
    the number of words, plus the last word's number), and ``places[n - 1]`` the place of the term that each is, or -1.
    """

    words: pa.Array
    grams: list[np.ndarray]
    places: list[np.ndarray]
    term: pa.Array
    idf: np.ndarray
    index: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> _Known:
        """Of a table ``(term, idf, index)`` in the order of ``index``."""
        terms = table.column("term").combine_chunks()
        lists = pc.split_pattern(terms, " ")
        words = pc.dictionary_encode(lists.flatten())
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        length = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(length) - length
        grams, places, number = [], [], np.zeros(len(length), np.int64)
        for n in range(1, int(length.max(initial=0)) + 1):
            long = np.flatnonzero(length >= n)
            distinct, number[long] = np.unique(number[long] * len(words.dictionary) + code[first[long] + n - 1], return_inverse=True)
            place = np.full(len(distinct), -1)
            whole = np.flatnonzero(length == n)
            place[number[whole]] = whole
            grams.append(distinct)
            places.append(place)
        return cls(words.dictionary, grams, places, terms, *(table.column(c).to_numpy() for c in ("idf", "index")))

    def found(self, row: np.ndarray, tokens: pa.Array, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and place of every gram of ``low`` to ``high`` words that is a term, repeats included."""
        words = pc.dictionary_encode(tokens)
        own = pc.fill_null(pc.index_in(words.dictionary, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        code = own[words.indices.to_numpy(zero_copy_only=False)] if len(own) else np.zeros(0, np.int64)
        at = np.flatnonzero(code >= 0)
        number, rows, places = np.zeros(len(at), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, (keys, place) in enumerate(zip(self.grams[:high], self.places, strict=False), 1):
            if n > 1:
                inside = at + n - 1 < len(code)
                inside[inside] = (row[at[inside]] == row[at[inside] + n - 1]) & (code[at[inside] + n - 1] >= 0)
                at, number = at[inside], number[inside]
            wanted = number * len(self.words) + code[at + n - 1]
            number = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            known = keys[number] == wanted
            at, number = at[known], number[known]
            if n >= low:
                term = place[number] >= 0
                rows.append(row[at[term]])
                places.append(place[number[term]])
        return np.concatenate(rows), np.concatenate(places)


def _weighted_steps(model: TfidfModel, low: int, high: int):
    """Function over Arrow batches that yields each step with row, place in the vocabulary and weight of its terms.

    Places are in the order of ``index``. Needs a vocabulary small enough to broadcast: at most :data:`BROADCAST_TERMS` terms.
    """
    known = _Known.of(model.vocabulary.select("term", "idf", "index").orderBy("index").toArrow().combine_chunks())
    shared = model.vocabulary.sparkSession.sparkContext.broadcast(known)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        known = shared.value
        size = max(1, len(known.term))
        for step, row, tokens in _token_steps(batches):
            rows, places = known.found(row, tokens, low, high)
            key, tf = np.unique(rows * size + places, return_counts=True)
            row, place = np.divmod(key, size)
            weight = (1.0 + np.log(tf)) * known.idf[place]
            norm = np.sqrt(np.bincount(row, weights=weight * weight, minlength=step.num_rows))
            yield step, row, place, weight / norm[row], known

    return steps


def tfidf_transform(df: DataFrame, model: TfidfModel, low: int = 1, high: int = 2) -> DataFrame:
    """Long ``(review_id, term, index, weight)``: sublinear tf times idf, rows scaled to unit length.

    A vocabulary of up to :data:`BROADCAST_TERMS` terms is broadcast and texts are weighted where they are. Beyond, the
    counts are joined with it, frequent terms spread over several tasks.
    """
    kind = df.schema["review_id"].dataType.simpleString()
    if model.size <= BROADCAST_TERMS:
        steps = _weighted_steps(model, low, high)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for step, row, place, weight, known in steps(batches):
                ids, term = step.column(0).take(pa.array(row)), known.term.take(pa.array(place))
                yield pa.RecordBatch.from_arrays(
                    [ids, term, pa.array(known.index[place], pa.int32()), pa.array(weight)], ["review_id", "term", "index", "weight"]
                )

        schema = f"review_id {kind}, term string, index int, weight double"
        return _tokenized(df, ["review_id"]).mapInArrow(work, schema)
    vocabulary = model.vocabulary.select("term", "idf", "index", F.col("df").alias("_rows"))
    joined = spread_join(term_counts(df, low, high), vocabulary, ["term"], "_rows", spread_by=["review_id"])
    weighted = joined.filter(F.col("idf").isNotNull()).withColumn(
        "weight", (F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf")
    )
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("review_id")))
    return weighted.select("review_id", "term", "index", (F.col("weight") / norm).alias("weight"))


def tfidf_vectors(df: DataFrame, model: TfidfModel, keep: tuple[str, ...] = ("label",)) -> DataFrame:
    """One sparse vector ``features`` per text; a text without vocabulary terms gets the zero vector."""
    size = model.size
    if size > BROADCAST_TERMS:
        entries = tfidf_transform(df, model).groupBy("review_id").agg(
            F.sort_array(F.collect_list(F.struct("index", "weight"))).alias("_e")
        )
        joined = df.select("review_id", *keep).join(entries, "review_id", "left")
        empty = F.array().cast("array<int>"), F.array().cast("array<double>")
        parts = joined.select(
            "review_id", *keep, F.coalesce(F.col("_e.index"), empty[0]).alias("_i"), F.coalesce(F.col("_e.weight"), empty[1]).alias("_w")
        )
    else:
        steps = _weighted_steps(model, 1, 2)
        columns = ["review_id", *keep]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for step, row, place, weight, known in steps(batches):
                index = known.index[place]
                first = pa.array(np.searchsorted(row, np.arange(step.num_rows + 1)).astype(np.int32))
                lists = [
                    pa.ListArray.from_arrays(first, pa.array(index, pa.int32())),
                    pa.ListArray.from_arrays(first, pa.array(weight)),
                ]
                yield pa.RecordBatch.from_arrays([*step.columns[:-1], *lists], [*columns, "_i", "_w"])

        kept = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)
        parts = _tokenized(df, columns).mapInArrow(work, f"{kept}, _i array<int>, _w array<double>")
    return parts.select("review_id", *keep, _sparse(size)("_i", "_w").alias("features"))


def _sparse(size: int):
    """Arrow columns of places and weights as a column of sparse vectors, without touching single rows."""

    @F.arrow_udf(VectorUDT())
    def build(index: pa.Array, weight: pa.Array) -> pa.Array:
        rows = len(index)
        return pa.StructArray.from_arrays(
            [pa.array(np.zeros(rows, np.int8)), pa.array(np.full(rows, size, np.int32)), index, weight],
            ["type", "size", "indices", "values"],
        )

    return build


def _hash_cell(dim: int) -> tuple[Column, Column]:
    """A term's position and sign."""
    digest = F.md5("term")
    position = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % dim).cast("int")
    return position, F.when(F.substring(digest, 9, 1).isin(list("01234567")), -1.0).otherwise(1.0)


def hashed_embedding(weights: DataFrame, dim: int = 64) -> DataFrame:
    """Signed feature hashing of TF-IDF weights: ``(review_id, position, value)``, zero cells left out."""
    position, sign = _hash_cell(dim)
    return weights.groupBy("review_id", position.alias("position")).agg(F.sum(sign * F.col("weight")).alias("value"))


def _hashed_steps(model: TfidfModel, dim: int):
    """Function over Arrow batches that yields each step with its rows' hashed weights, and how many terms each cell holds."""
    steps, (position, sign) = _weighted_steps(model, 1, 2), _hash_cell(dim)
    cells = model.vocabulary.select("index", position.alias("position"), sign.alias("sign")).orderBy("index").toArrow()
    shared = model.vocabulary.sparkSession.sparkContext.broadcast(tuple(cells.column(c).to_numpy() for c in ("position", "sign")))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        position, sign = shared.value
        for step, row, place, weight, _ in steps(batches):
            cell = row * dim + position[place]
            value = np.bincount(cell, weight * sign[place], step.num_rows * dim).astype(float)  # whole numbers where there is no cell
            yield step, value, np.bincount(cell, minlength=step.num_rows * dim)

    return hashed


def hashed_tfidf(df: DataFrame, model: TfidfModel, dim: int = 64) -> DataFrame:
    """:func:`hashed_embedding` of the texts' weights. Where the vocabulary can be broadcast, cells are added up where the texts are."""
    if model.size > BROADCAST_TERMS:
        return hashed_embedding(tfidf_transform(df, model), dim)
    steps = _hashed_steps(model, dim)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step, value, terms in steps(batches):
            at = np.flatnonzero(terms)
            ids = step.column(0).take(pa.array(at // dim))
            yield pa.RecordBatch.from_arrays([ids, pa.array(at % dim, pa.int32()), pa.array(value[at])], ["review_id", "position", "value"])

    kind = df.schema["review_id"].dataType.simpleString()
    cells = _tokenized(df, ["review_id"]).mapInArrow(work, f"review_id {kind}, position int, value double")
    return cells.groupBy("review_id", "position").agg(F.sum("value").alias("value"))  # an id may have several texts


def hashed_vectors(df: DataFrame, model: TfidfModel, dim: int = 64, keep: Sequence[str] = ()) -> DataFrame:
    """Hashed TF-IDF as dense vectors ``features``, one per row; texts without known terms are zero vectors."""
    if model.size > BROADCAST_TERMS:
        cells = hashed_embedding(tfidf_transform(df.select("review_id", "text"), model), dim)
        filled = cells.groupBy("review_id").agg(  # at most ``dim`` cells
            F.map_from_entries(F.collect_list(F.struct("position", "value"))).alias("_cells")
        )
        joined = df.select("review_id", *keep).join(filled, "review_id", "left")
        vector = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda p: F.coalesce(F.element_at("_cells", p), F.lit(0.0)))
        return joined.select("review_id", *keep, vector.alias("features"))
    steps = _hashed_steps(model, dim)
    columns = ["review_id", *keep]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step, value, _ in steps(batches):
            first = pa.array(np.arange(step.num_rows + 1, dtype=np.int32) * dim)
            yield pa.RecordBatch.from_arrays([*step.columns[:-1], pa.ListArray.from_arrays(first, pa.array(value))], [*columns, "features"])

    kept = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)
    return _tokenized(df, columns).mapInArrow(work, f"{kept}, features array<double>")


def hashing_encoder(dim: int = 64) -> Encoder:
    """Default encoder: signed, log-scaled counts of hashed words, scaled to unit length.

    Words are those of :func:`tokenize_words` but for accents, which are kept: an encoder sees plain texts. Where the signs
    of a text's words cancel out in every cell, the counts are taken without signs: only a text without words is zero.
    """

    def encode(texts: list[str]) -> np.ndarray:
        found = pa.array([_WORD.findall(text.lower()) for text in texts], pa.list_(pa.string()))
        counts = _count_terms(found, 1, 1)
        names = counts.term.dictionary_encode()
        code = np.array([zlib.crc32(w.encode()) for w in names.dictionary.to_pylist()], np.int64).reshape(-1)
        own = code[names.indices.to_numpy(zero_copy_only=False)] if len(code) else np.zeros(0, np.int64)
        value = np.where(own & 1, 1.0, -1.0) * (1.0 + np.log(counts.tf))
        cell = counts.row * dim + (own >> 1) % dim
        out = np.bincount(cell, weights=value, minlength=len(texts) * dim).reshape(len(texts), dim)
        bare = np.bincount(cell, weights=np.abs(value), minlength=len(texts) * dim).reshape(len(texts), dim)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        out = np.where(norms > 1e-9 * np.linalg.norm(bare, axis=1, keepdims=True), out, bare)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1.0, norms)

    return encode


_WORD = re.compile(r"\w\w+")


def text_embedding(
    df: DataFrame,
    encoder: Encoder | Callable[[], Encoder],
    dim: int,
    *,
    batch: int = 64,
    lazy: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``(review_id, …, features)`` from any batch encoder, run inside Arrow batches on the executors.

    With ``lazy`` the encoder argument is a factory that is called once per task, for models that must be
    loaded on the executor. Whole texts are passed; null texts are encoded as empty ones.
    """
    kept = [df.schema[c] for c in ("review_id", *keep)]
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder() if lazy else encoder
        for frame in frames:
            texts = frame.pop("text").fillna("").tolist()
            parts = [encode(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            if parts:
                frame["features"] = list(np.vstack(parts).astype(np.float64))
            else:
                frame["features"] = pd.Series([], dtype=object)
            yield frame

    return df.select("review_id", *keep, "text").mapInPandas(run, schema=f"{columns}, features array<double>")


@dataclass
class PcaModel:
    """Centring plus principal directions with a fixed sign."""

    center: StandardScalerModel
    rotation: PCAModel
    signs: list[float]

    @property
    def components(self) -> np.ndarray:
        """k x d directions, the largest loading of each positive."""
        return (self.rotation.pc.toArray() * np.array(self.signs)).T


def pca_fit(df: DataFrame, k: int = 16, column: str = "features") -> PcaModel:
    """Principal directions of the rows around their mean. The covariance is aggregated on the executors."""
    vectors = df.select(array_to_vector(F.col(column).cast("array<double>")).alias("_raw"))
    center = StandardScaler(withMean=True, withStd=False, inputCol="_raw", outputCol="_centred").fit(vectors)
    rotation = PCA(k=k, inputCol="_centred", outputCol="_pca").fit(center.transform(vectors))
    loadings = rotation.pc.toArray()
    strongest = loadings[np.abs(loadings).argmax(axis=0), np.arange(k)]
    return PcaModel(center, rotation, [1.0 if v >= 0 else -1.0 for v in strongest])


def pca_transform(df: DataFrame, model: PcaModel, column: str = "features") -> DataFrame:
    """Replace the vector by its coordinates, centred with the training mean."""
    vectors = df.withColumn("_raw", array_to_vector(F.col(column).cast("array<double>")))
    rotated = model.rotation.transform(model.center.transform(vectors))
    signs = F.array(*[F.lit(s) for s in model.signs])
    coordinates = F.zip_with(vector_to_array("_pca"), signs, lambda x, s: x * s)
    return rotated.withColumn(column, coordinates).drop("_raw", "_centred", "_pca")
