"""Hard negatives and ranked search against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from candora.llm import hard_negatives, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_negatives(rows, anchors, positives=5, negatives=10, low=30, high=90):
    rows = [
        (i, label, [math.floor(256 * float(x)) for x in v])
        for i, v, label in rows
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    late = lambda i: (i is None, i or 0)
    product = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, label, v in rows:
        if i is None or not anchors(i):
            continue
        same = [(-product(v, w), late(j), j) for j, other, w in rows if other == label and j != i]
        different = sorted((-product(v, w), late(j), j) for j, other, w in rows if other != label)
        for score, _, j in sorted(same)[:positives]:
            fit = [(n, -s) for s, _, n in different if low * -score <= 100 * -s <= high * -score][:negatives]
            out += [(i, j, rank, n, -score, s) for rank, (n, s) in enumerate(fit, 1)]
    return Counter(out)


SCHEMA = "vec_id long, embedding array<float>, label int, _v string, _row int"


def vectors(seed, count, width=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, width))
    rows = []
    for k in range(count):
        label = int(rng.integers(0, 4))
        v = centres[label] * (k % 3 > 0) + rng.normal(scale=0.5, size=width)
        rows.append((k, [float(x) for x in v.astype(np.float32)], label))
    same = rows[7][1]
    rows += [(count + k, same, k % 3) for k in range(150)]  # equal vectors under several labels
    rows += [
        (5000, None, 1), (5010, rows[0][1], None), (5020, [0.1, None, 0.2], 1), (5030, [float("nan")] * width, 2), (5040, [float("inf")], 2),
        (5050, [], 1), (5060, [0.0] * width, 2), (5070, [0.5, 0.25], 3), (None, rows[3][1], 1), (20, rows[20][1], 3), (30, rows[31][1], rows[30][2]),
    ]
    return rows


@pytest.mark.parametrize(("clusters", "block", "part"), [(3, 40, 100_000), (1, 10_000, 100_000), (5, 25, 7)])
def test_hard_negatives_are_exact(spark, monkeypatch, clusters, block, part):
    monkeypatch.setattr(hard_negatives, "VISITS", 3 if part == 7 else 200_000)
    rows = vectors(1, 400)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, clusters=clusters, block=block, part_size=part)
    assert Counter(tuple(r) for r in got.collect()) == brute_negatives(rows, lambda i: i % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.mine(empty, F.col("vec_id") == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0], 1, "", 0), (1, [1.0], 2, "", 0)], SCHEMA)
    assert hard_negatives.mine(one, F.col("vec_id") == 0).count() == 0  # no positive, no negative
    assert hard_negatives.mine(one, F.col("vec_id") == 9).count() == 0  # no anchor


def test_large_components(spark):
    rows = [(k, [float(10.0 ** (k % 8)) * (k + 1), -(2.0**k), float(k)], k % 2) for k in range(24)]
    df = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)
    stored = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    got = hard_negatives.mine(df, F.col("vec_id") % 4 == 0, block=5)
    assert Counter(tuple(r) for r in got.collect()) == brute_negatives(stored, lambda i: i % 4 == 0)
    huge = spark.createDataFrame([(k, [3e38, -3e38], k % 2, "", 0) for k in range(4)], SCHEMA)
    assert hard_negatives.mine(huge, F.col("vec_id") == 0).count() == 0  # scores are equal, so above 90 percent


def test_bounds_hold_and_lists_are_left_early():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 16)) * 80
    rows = (centres[np.arange(4000) % 4] + rng.normal(size=(4000, 16)) * 6).astype(np.int64)
    anchors = rows[:40]
    found = hard_negatives.fit_centres(anchors, 4)
    norm = hard_negatives._norms(anchors)
    angle = hard_negatives._angles(anchors, norm, found)
    own = angle.argmin(axis=1)
    spread = np.array([angle[own == c, c].max(initial=0) for c in range(len(found))])
    key, row_angle, row_norm = hard_negatives._keys(found, spread, rows)
    score = hard_negatives.scores(anchors, rows)
    assert (score == anchors @ rows.T).all()
    for u in range(40):
        assert (score[u] <= norm[u] * key[:, own[u]]).all()
        tenth = np.sort(score[u])[-10]
        assert (norm[u] * key[:, own[u]] >= tenth).mean() < 0.5  # the rest of the list can't enter the result


def test_vector_coding_round_trip():
    rng = np.random.default_rng(2)
    matrix = rng.integers(-100, 100, (50, 5)) * (10 ** rng.integers(0, 14, (50, 1)))
    assert (hard_negatives.decode(hard_negatives.encode(matrix), 5) == matrix).all()
    assert hard_negatives.decode(hard_negatives.encode(matrix[:0]), 5).shape == (0, 5)


def brute_ranking(docs, items, top=10):
    split = lambda t: TERM.findall((t or "").translate(LOWER))
    found = [(i, Counter(split(t))) for i, t in docs]
    n = sum(1 for _, c in found if c)
    total = sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in found:
            if not c:
                continue
            m = 25 + (75 * sum(c.values()) * n) // total
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in split(text) if t in c
            )
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1)]
    return Counter(out)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(int(rng.paretovariate(0.7)) % 300)
    text = lambda n: rng.choice([" ", ", ", "-"]).join(word() for _ in range(n))
    docs = [(k, text(rng.randrange(1, 120))) for k in range(300)]
    docs += [(1000 + k, docs[5][1]) for k in range(60)]  # equal scores
    docs += [(None, docs[6][1]), (6, docs[6][1]), (2000, None), (2001, ""), (2002, " .,\x00 "), (2003, text(30_000)), (2004, "Ünï x y"), (2005, "A1 a1 É")]
    items = [(k, docs[k][1][:60]) for k in range(12)] + [(50, None), (51, ""), (52, "nosuchterm"), (3, "a1 a1 a1 A1"), (54, "ünï É x"), (None, docs[5][1])]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_ranked_search_is_exact(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 40)
    docs, items = corpus(4)
    left = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, score string, _item int").repartition(3)
    right = spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, doc_id string")
    got = ranked_search.search(left, right)
    assert Counter(tuple(r) for r in got.collect()) == brute_ranking(docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]


def test_ranked_search_of_nothing(spark):
    docs, items = corpus(4)
    kinds = "doc_id long, text string", "item_id long, text string"
    none = [spark.createDataFrame([], kind) for kind in kinds]
    assert ranked_search.search(none[0], spark.createDataFrame(items, kinds[1])).count() == 0
    assert ranked_search.search(spark.createDataFrame(docs, kinds[0]), none[1]).count() == 0


def test_trees_are_exact_and_prune():
    rng = np.random.default_rng(3)
    topic = rng.integers(0, 12, 1500)
    rows = [np.unique(np.r_[rng.integers(0, 40, 6) + 40 * t, rng.integers(480, 520, 3)]) for t in topic]
    rows += [rows[0]] * 200
    first = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int64)
    term = np.concatenate(rows)
    weight = rng.integers(1, 10**9, len(term))
    weight[first[1500] :] = np.tile(weight[: first[1]], 200)
    tree = ranked_search.build_tree(first, term, weight)
    assert sorted(tree.rows) == list(range(len(rows)))
    again = ranked_search.from_blobs(ranked_search.to_blobs(tree))
    assert all((getattr(again, f) == getattr(tree, f)).all() for f in ranked_search._FIELDS if f not in ranked_search._REAL)
    assert all((getattr(again, f) >= getattr(tree, f)).all() for f in ranked_search._REAL)
    tree = again
    leaves, scratch = int((tree.left < 0).sum()), np.zeros(520, np.int64)
    visited = 0
    for item in range(60):
        terms = np.unique(rows[item][:7])
        times = rng.integers(1, 3, len(terms))
        plain = [(int(sum(t * w[r == x].sum() for x, t in zip(terms, times, strict=True))), k) for k, (r, w) in enumerate((r, weight[first[k] : first[k + 1]]) for k, r in enumerate(rows))]
        want = sorted((p for p in plain if p[0] > 0), key=lambda p: (-p[0], p[1]))[:10]
        got, scored = ranked_search.search_tree(tree, terms, times, scratch, 0, 10)
        assert got == want and not scratch.any()
        visited += scored
    assert visited < 0.7 * 60 * leaves


def test_weights_beyond_64_bits():
    n = np.array([10**7], np.int64)
    assert ranked_search.occurrence_weights(np.array([3]), n, 5 * 10**11, 10**13)[0] == (3 * 10**9) // (3000 + 8 * (25 + 75 * 10**7 * 5 * 10**11 // 10**13))
