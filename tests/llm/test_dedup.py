"""Exact and near duplicates, repeated passages, contained benchmark items."""

import random

import pytest
from brute import components, repeats, shingles, words
from pyspark.sql import functions as F

from candora.llm import decontamination, exact_dedup, minhash_dedup, substring_dedup


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "one", "One", "two words", "a b c", prose(rng, 9000)]
    texts += [prose(rng, rng.randrange(25, 120)) for _ in range(20)]
    base = prose(rng, 150)
    texts += [base, base.upper(), base.replace(" ", "\n  ", 5)]
    for _ in range(25):  # a group of near copies that no member is the centre of
        w = words(rng.choice(texts[-20:]) if len(texts) > 50 else base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        texts.append(" ".join(w))
    passage = prose(rng, 60)
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 30)} {passage}" for _ in range(6)]
    texts += ["a " * 70, "a " * 50, "é" * 30, "ab " * 10 + "cd"]
    rows = [(100 - k, t, "noise", k) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, size string, _id long").repartition(3)


def listed(corpus):
    return [(r["doc_id"], r["text"]) for r in corpus.collect()]


def test_exact_groups(corpus):
    docs = listed(corpus)
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(corpus).collect()}
    import re

    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in docs}
    for i, n in norm.items():
        group = [j for j, m in norm.items() if m == n]
        assert (got[i]["keep_id"], got[i]["group_size"]) == (min(group), len(group))


def test_exact_groups_split_off_heavy_digests(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    rows = exact_dedup.digests(docs)
    heavy = exact_dedup.heavy_digests(rows).collect()
    assert [(r["_keep"], r["_size"]) for r in heavy] == [(0, 1000)]
    out = exact_dedup.exact_groups(docs)
    assert out.count() == 3000 and out.filter("doc_id = keep_id").count() == 2001


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(docs).collect())
    assert got == [("1", 1, 3), ("1", 1, 3), ("2", 2, 2), ("3", 2, 2), ("None", 1, 3)]


@pytest.mark.parametrize("shingle,percent", [(3, 85), (5, 80)])
def test_near_duplicates_match_all_pairs(corpus, shingle, percent):
    expected = components(listed(corpus), shingle, percent)
    got = minhash_dedup.near_duplicates(corpus, shingle=shingle, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == expected
    assert len(got) == len(expected)


def test_block_of_a_bucket_is_worked_off(corpus, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 2)
    expected = components(listed(corpus), 3, 85)
    got = minhash_dedup.near_duplicates(corpus, shingle=3, percent=85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == expected


def test_rows_repeated_for_every_table_are_never_broadcast(corpus, monkeypatch):
    plans, stored = {}, minhash_dedup.stored

    def planned(df, name):
        plans[name] = df._jdf.queryExecution().sparkPlan().toString()
        return stored(df, name)

    monkeypatch.setattr(minhash_dedup, "stored", planned)
    minhash_dedup.near_duplicates(corpus)
    assert "Generate explode" in plans["members"] and "BroadcastHashJoin [_key" not in plans["members"]


def test_miss_probability():
    for similarity in (0.8, 0.85):
        m = minhash_dedup.halves_for(similarity)
        assert 1 - (1 - (1 - similarity**2) ** m) ** 2 <= minhash_dedup.MISS


def test_repeated_passages(corpus):
    expected = repeats(listed(corpus))
    got = substring_dedup.remove_repeats(corpus).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == expected
    assert sum(v[1] for v in expected.values()) > 500


def test_crowded_anchors(corpus, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CROWDED", 1)
    expected = repeats(listed(corpus))
    got = substring_dedup.remove_repeats(corpus).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == expected


def test_windows_of_a_passage_that_stands_everywhere_are_not_indexed(spark, monkeypatch):
    rng = random.Random(6)
    passage, searched = prose(rng, 30, 10**6), substring_dedup.repeated_windows
    docs = [(k, f"{prose(rng, 25, 10**6)} {passage} {prose(rng, 25, 10**6)}") for k in range(60)]
    docs += [(100, f"{passage} {docs[0][1]}"), (101, docs[1][1])]

    def few(found, lengths, window):
        assert len(lengths) <= 10, "a shard was sent the windows of all texts"
        return searched(found, lengths, window)

    monkeypatch.setattr(substring_dedup, "CROWDED", 10)
    monkeypatch.setattr(substring_dedup, "repeated_windows", few)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(table).collect()}
    assert got == repeats(docs) and got[0][1] == 0 and got[5][1] == 30 and got[101][1] == 80


def test_fm_index_counts():
    import numpy as np

    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, 400).astype(np.uint64)
    lengths = np.array([100, 50, 5, 245])
    got = set(substring_dedup.repeated_windows(words, lengths, 6).tolist())
    seen, expected, at = set(), set(), 0
    for n in lengths:
        for k in range(at, at + n - 5):
            w = tuple(words[k : k + 6])
            expected |= {k} if w in seen else set()
            seen.add(w)
        at += n
    assert got == expected


def test_contained_items(spark, corpus):
    rng = random.Random(8)
    docs = listed(corpus)
    items, texts = [(1, None), (2, ""), (3, "two words"), (4, "a b c d e")], dict(docs)
    long = words(texts[93])
    for k in range(12):  # passages of a long text, some with words changed
        n = rng.randrange(6, 80)
        at = rng.randrange(len(long) - n)
        part = long[at : at + n]
        for _ in range(k % 3):
            part[rng.randrange(n)] = "changed"
        items.append((10 + k, " ".join(part).upper() if k % 2 else "\n".join(part)))
    items.append((10, items[4][1]))
    table = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, shared int")
    got = sorted(tuple(r) for r in decontamination.find_contained(corpus, table).select("doc_id", "item_id", "shared").collect())
    expected = []
    for i, t in docs:
        own = shingles(t, 5)
        for j, u in items:
            want = shingles(u, 5)
            both = len(own & want)
            if both and 100 * both >= 80 * len(want):
                expected.append((i, j, both))
    assert got == sorted(expected) and len(got) > 8


def test_items_in_blocks(spark, corpus, monkeypatch):
    items = corpus.filter("doc_id < 60").select(F.col("doc_id").alias("item_id"), "text")
    whole = sorted(map(tuple, decontamination.find_contained(corpus, items).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_SHINGLES", 700)
    assert sorted(map(tuple, decontamination.find_contained(corpus, items).collect())) == whole


def test_empty_tables(spark, corpus):
    none = corpus.limit(0)
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert exact_dedup.exact_groups(none).count() == 0
    assert minhash_dedup.near_duplicates(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert decontamination.find_contained(none, items).count() == 0
    assert decontamination.find_contained(corpus, items.limit(0)).count() == 0


def test_near_duplicates_with_repeated_and_null_ids(spark):
    rng = random.Random(9)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(7, a), (7, a), (3, a), (None, b), (None, b), (5, c), (5, b), (None, None), (9, c + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash_dedup.near_duplicates(docs).collect()
    found = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got), key=str)
    want = [(7, 3, False), (7, 3, False), (3, 3, True), (None, 5, False), (None, 5, False), (5, 5, True), (5, 5, True), (None, None, True), (9, 5, False)]
    assert found == sorted(want, key=str)


def test_repeats_between_rows_of_one_id(spark):
    rng = random.Random(10)
    text, other = " ".join(f"u{k}" for k in range(50)), prose(rng, 40)
    rows = [(1, text), (1, text), (None, other), (None, other), (2, f"a {other} b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for crowded in (2000, 0):
        old, substring_dedup.CROWDED = substring_dedup.CROWDED, crowded
        got = sorted(((r["doc_id"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs).collect()), key=str)
        substring_dedup.CROWDED = old
        assert got == sorted([(1, 0), (1, 50), (None, 0), (None, 40), (2, 40)], key=str)
