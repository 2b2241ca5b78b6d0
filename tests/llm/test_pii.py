"""Personal data: patterns against ``re``, decoding against all label sequences, the field on unseen sentences."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from candora.llm import pii
from candora.llm.pii_examples import EXAMPLES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed([int(c) for c in digits])):
        total += d if k % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def plain_base(text):
    out = []
    for number, kind in enumerate(pii.KINDS):
        for m in re.finditer(PATTERNS[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fits:
                out.append((m.start(), number, m.end()))
    return sorted(out)


def written(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


@pytest.fixture(scope="module")
def field():
    return pii.fit_field(EXAMPLES)


def prepared(texts):
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)
    return data, offsets, pii.shapes(data, offsets)


TEXTS = [
    None, "", "   ", "und.34@mail7.example.com é und", "a@b.c@d.e", "a@@b.c x@y z@.c q@w.e-r.t.", "é1.2.3.4ü 256.1.1.1 1.2.3.4.5.6.7.8.9 0001.02.3.255",
    "4111 1111 1111 1111", "4111-1111-1111-1111 and 4111111111111111x", "17 4111111111111111", "+1 (017) 555-7713.", "+1 (017) 555-7713 4111111111111111 end",
    "+49 30 5550 1234 71.129.171.132 4111111111111111", "+ 1 +1 +12345678 +123456789", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"",
    "nothing at all\nin here", "日本 jane.roe (at) example.org 日本", "9" * 3000, "+" + "1 " * 3000, "@" * 2000, "a" * 5000 + "@b.c", "1.2.3.4" * 50,
]


def test_patterns_equal_plain_ones():
    rng = random.Random(1)
    texts = [t for t in TEXTS if t] + ["".join(rng.choice("a1.@+-( )%é5 ") for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice("0123456789 -") for _ in range(rng.randrange(10, 40))) for _ in range(500)]
    for text in texts:
        raw = text.encode()
        place = np.cumsum([(b & 0xC0) != 0x80 for b in raw])
        got = sorted((int(place[a]) - 1, k, int(place[b - 1])) for a, k, b in pii.base_spans(raw))
        assert got == plain_base(text), text


def test_query_on_dirty_rows(spark, field):
    rows = [(k, t, "x", 1, "s") for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], "y", 2, "s"), (None, TEXTS[10], "z", 3, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_ip int, _id string").repartition(2)
    got = sorted(pii.find_personal_data(docs, field).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for k, text in [*enumerate(TEXTS), (None, TEXTS[10])]:
        base = plain_base(text)
        r = by_id[k]
        assert [r[f"n_{kind}"] for kind in pii.KINDS] == [sum(b[1] == j for b in base) for j in range(4)]
        assert r["base_sha256"] == hashlib.sha256(written(base).encode()).hexdigest()
        every = [x for x in r["spans"].split(",") if x]
        assert {x for x in written(base).split(",") if x} <= set(every) and len(every) == len(base) + r["n_added"]
    # numbers side by side are one failing run for the patterns
    assert by_id[9]["spans"] == "card:3:19" and by_id[11]["spans"] == "phone:0:17,card:18:34"
    assert by_id[12]["spans"] == "phone:0:16,card:1:19,ip:17:31,card:32:48" and by_id[12]["n_ip"] == 1
    assert by_id[16]["spans"] == "email:3:28" and by_id[14]["spans"] == by_id[15]["spans"] == ""
    empty = spark.createDataFrame([], docs.schema)
    assert pii.find_personal_data(empty, field).count() == 0


def test_decoding_equals_all_sequences():
    rng = np.random.default_rng(4)
    for _ in range(20):
        field = pii.Field(np.zeros((1, 9)), rng.normal(size=(9, 9)), rng.normal(size=9), rng.normal(size=9))
        sizes = rng.integers(1, 5, 4)
        starts = np.cumsum(sizes) - sizes
        emitted = rng.normal(size=(sizes.sum(), 9))
        opens, closes = rng.integers(0, 2, 4).astype(bool), rng.integers(0, 2, 4).astype(bool)
        got = pii.viterbi(field, emitted, starts, sizes, opens, closes)
        for k in range(4):
            own = emitted[starts[k] : starts[k] + sizes[k]]

            def value(path, own=own, k=k):
                total = (field.first if opens[k] else field.step[0])[path[0]] + (field.last if closes[k] else field.step[:, 0])[path[-1]]
                return total + sum(own[i, y] for i, y in enumerate(path)) + sum(field.step[a, b] for a, b in itertools.pairwise(path))

            best = max(itertools.product(range(9), repeat=int(sizes[k])), key=value)
            assert tuple(got[starts[k] : starts[k] + sizes[k]]) == best


def test_skipping_plain_words_changes_nothing(field):
    around = field.around()
    assert around is not None
    rng = random.Random(8)
    pieces = [re.sub(r"\{\w+\|(.*?)\}", r"\1", e) for e in EXAMPLES] + ["plain words only and more of them here"] * 60 + ["at", "5", "+1 (017)", "dot"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 30))) for _ in range(60)] + ["", "one", "555-0199"]
    _, _, found = prepared(texts)
    words, label = pii.decode(field, found, around)
    every, all_labels = pii.decode(field, found, None)
    assert len(every) == len(found.start) > 2 * len(words) or len(words) < len(every)
    dense = np.zeros(len(every), np.int8)
    dense[words] = label
    assert (dense == all_labels).all()
    strong = pii.Field(field.emission + np.r_[np.zeros(1), np.full(8, 3.0)] / 8, field.step, field.first, field.last)
    assert strong.around() is None or strong.around() >= around  # a field that leans inwards needs more, or whole texts


def test_gradient_free_of_mistakes(field):
    """The trained field labels its own sentences, and leaves most of unseen ones right."""
    texts, spans = pii.labelled(EXAMPLES)

    def right(by, chosen):
        data, offsets, found = prepared([texts[k] for k in chosen])
        gold = pii._gold(found, [texts[k] for k in chosen], [spans[k] for k in chosen])
        _, label = pii.decode(by, found, None)
        return (label == gold).mean(), (label == gold)[gold > 0].mean()

    assert right(field, range(len(texts)))[1] > 0.95
    seen = [k for k in range(len(texts)) if k % 4]
    unseen = [k for k in range(len(texts)) if k % 4 == 0]
    overall, inside = right(pii.fit_field([EXAMPLES[k] for k in seen]), unseen)
    assert overall > 0.9 and inside > 0.7


def test_clean_texts_stay_clean(field):
    clean = [pii.marked(e)[0] for e in EXAMPLES if "|" not in e and "{" not in e]
    data, offsets, found = prepared(clean)
    assert not any(pii.added_spans(field, data, found, field.around(), [[] for _ in clean], offsets))
