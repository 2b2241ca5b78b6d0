"""Archives, page text, mixing, language model, toxicity, language identification."""

import hashlib
import random
import re
import tempfile
from collections import Counter

import numpy as np
import pytest
from brute import language_model, remainder, words
from pyspark.sql import functions as F

from candora.llm import html_text, language_id, language_model as lm, mixing, toxicity, warc

NOISE = "doc_id long, text string, lang string, source string, score double, _id long"


# ---- archives


def test_archives_round_trip(spark):
    html = ["<p>ä\r\n\r\nWARC/1.1\r\nhttp://x 0.0.0.0 1 a 5\n</p>" * 4, None, "", "short", "short", "x" * 300_000, "y" * 100, "z" * 99]
    rows = [(9 - k, f"http://h/ä b{k}" if k else None, h, k) for k, h in enumerate(html)]
    rows += [(20, "http://h/1", html[0], 0), (3, "http://h/1", html[0], 0), (21, "u", html[6], 0), (22, "u", html[7], 0), (None, "u", "n" * 200, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, size int").repartition(3)
    found = warc.read_warc_records(spark, warc.pages_to_warc(pages)).collect()
    first = {}
    for i, _, h, _ in rows:
        if len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, 1 << 60), i if i is not None else 1 << 59)
    expected = []
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        to = first.get(h) if first.get(h) not in (i, None, 1 << 59) else None
        expected.append((str(i), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if to is not None else "response", to))
    got = [(str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert {r["payload"].decode() for r in found if r["payload"]} == {h for _, _, h, _ in rows if h}
    assert len({r["record_id"] for r in found}) == len(rows)


def test_both_versions_and_declared_lengths():
    for version in (1, 2):
        block = warc.http_response(b"a\nhttp://y 0.0.0.0 2 b 3\n", 5)
        raw = warc.arc_version_block(version, "20240101") + b"\n" + warc.arc_header(version, b"http://a b", "199602", "text/html", len(block)) + b"\n" + block + b"\n"
        (record,) = warc.read_arc(raw)
        assert (record["version"], record["url"], record["block"]) == (version, "http://a b", block)
        assert warc.iso_date(record["date"]) == "1996-02-01T00:00:00Z"
        with pytest.raises(ValueError):
            list(warc.read_arc(raw[:-9]))


def test_archive_of_foreign_bytes(spark):
    folder = tempfile.mkdtemp()
    raw = warc.arc_version_block(1, "20240101000000") + b"\n" + warc.arc_header(1, b"ftp://a", "20240101000000", "x/y", 5) + b"\n\xff\xfe\n\r\n\n"
    open(f"{folder}/a.arc", "wb").write(raw)
    out = tempfile.mkdtemp() + "/warc"
    warc.convert(spark, folder, out)
    (record,) = warc.read_warc_records(spark, out).collect()
    assert (record["record_type"], bytes(record["payload"])) == ("resource", b"\xff\xfe\n\r\n")


# ---- page text


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use</div><!-- <p>no</p> -->
%s<aside>Side</aside><form><input value="x"><button>Go</button></form><footer>&copy; me</footer></body></html>"""


def test_article_of_a_page():
    article = (
        "<article class='post'><header><h1>A &amp; B</h1></header><p><b>First\n  line.<br><p>Second&nbsp;one &eacute;<p class=ad>Buy"
        "<p>a &lt; b > c <em>x</em>y</p><div class='share'>Share</div><section id='comments'><p>Nice</p></section><ul><li>u<li>v</ul></article>"
    )
    lines, kinds = html_text.page_lines(PAGE % article)
    assert html_text.main_lines(lines, kinds, []) == ["A & B", "First line.", "Second one é", "a < b > c xy", "u", "v"]


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ('<p>one <img class="ad"> two</p>', "one two"), ("<p>see <embed src=x> rest</p>", "see rest"), ('a <br class="share">b', "a b"),
        ('x <input class="login" value=q>y<hr class=menu>z', "x y|z"), ("<link class=sidebar>k <wbr id=ad>l", "k l"),
        ('<aside>gone <img> too</aside><p>k</p>', "k"), ('<p class="ad">gone<p>k', "k"),
    ],
)
def test_void_elements_take_nothing_along(source, text):
    for whole in (source, f"<article>{source}</article>"):
        lines, kinds = html_text.page_lines(whole)
        assert "|".join(html_text.main_lines(lines, kinds, [False] * len(lines))) == text


def test_pages_without_names(spark):
    rows = [(None, "http://h/1", "<article>one</article>"), (None, "http://h/1", "<article>one</article>"), (3, None, "<p>x"), (3, "http://h/3", "<p>y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["text"]) for r in html_text.extract_text(pages).collect()), key=str)
    assert got == [(3, "x"), (3, "y"), (None, "one"), (None, "one")]


def test_neighbours_without_markup(spark):
    def page(k):
        return f"<body><div>Menu of the site</div><div>All news</div><p>Own text {k}</p><p>More of {k}</p><div>Imprint</div></body>"

    rows = [(k, f"https://h.example/n/{k % 7}/{k}?x=1", page(k), "t") for k in range(9)]
    rows += [(50, "http://other/1", page(50), "t"), (51, None, None, "t"), (52, "http://e/1", "", "t"), (53, "http://e/2", "plain &amp; text", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(4)
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract_text(pages).collect()}
    assert all(got[k][0] == f"Own text {k}\n\nMore of {k}" for k in range(9))
    assert got[50][0].startswith("Menu") and got[51] == ("", 0) and got[52] == ("", 0) and got[53] == ("plain & text", 12)
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_copies_are_no_neighbours(spark):
    def page(k):
        return f"<body><div>Menu of the site</div><div>All news</div><p>Own text {k}</p><p>More of {k}</p><div>Imprint</div></body>"

    rows = [(10 * k + c, f"http://h.example/p/{k}.html?copy={c}", page(k)) for k in range(6) for c in range(4)]
    rows += [(90, "http://h.example/p/2-empty", ""), (91, "http://h.example/p/3-near", page(3) + "<p>Read 17 times</p>")]
    rows += [(92, "http://h.example/p/4-article", page(4).replace("<p>", "<article><p>", 1).replace("<div>Imp", "</article><div>Imp"))]
    rows += [(100 + c, "http://alone.example/", page(9)) for c in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: r["text"].split("\n\n") for r in html_text.extract_text(pages).collect()}
    assert len(got) == len(rows) and got[90] == [""] and got[92] == ["Own text 4", "More of 4"]
    for k in range(6):
        assert all(got[10 * k + c] == [f"Own text {k}", f"More of {k}"] for c in range(4))
    assert got[91] == ["Own text 3", "More of 3", "Read 17 times"]
    assert all(len(got[100 + c]) == 5 for c in range(3))


def test_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(60):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(0, 14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found = html_text.lcs_members(np.array(a, int), np.array(b, int))
        assert found.sum() == table[-1][-1]
        rest = iter(b)
        assert all(any(x == y for y in rest) for x in np.array(a, int)[found])


# ---- mixing


def test_mix_meets_its_targets(spark):
    rng = random.Random(5)
    rows = [(k, "w " * rng.randrange(0, 300), rng.choice(["b", "a", None, "é", "B"]), k) for k in range(300)]
    rows += [(900, None, "a", 0), (901, "", "z", 0), (902, "x " * 50_000, "b", 0), (5, "again and again", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long").repartition(3)
    mix = mixing.mix_sources(docs, block=32, shard_words=4096)
    out = mixing.taken_words(mix).collect()
    assert len(out) == len(rows) and sorted(map(tuple, mixing.taken_words(mixing.mix_sources(docs, block=32, shard_words=4096)).collect()), key=str) == sorted(map(tuple, out), key=str)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    names = sorted(sizes, key=lambda s: (s is None, s))
    goals = mixing.targets([sizes[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5, 2.0)
    assert abs(sum(goals) - 1.5 * sum(sizes.values())) < 1e-6
    for s, goal in zip(names, goals, strict=True):
        own = [r for r in out if r["source"] == s]
        assert {(r["source_size"], r["target"]) for r in own} == {(sizes[s], goal)}
        assert abs(sum(r["taken"] for r in own) - goal) <= 1
    assert all(r["taken"] <= 2 * r["size"] for r in out)
    shards = {r["_shard"] for r in mix.pieces.select("_shard").distinct().collect()}
    assert len(shards) > 5


def test_written_mix_holds_what_is_taken(spark):
    """The words of the written blocks are those that the plan takes of each document; rows are told apart without ids."""
    rng = random.Random(3)
    rows = [(k if k % 5 else None, rng.choice([" ", "\n", " \t "]).join(f"d{k}é{j}" for j in range(rng.randrange(0, 90))), "ab"[k % 2]) for k in range(60)]
    rows += [(7, "d900é0 " * 3000, "a"), (8, None, "a"), (8, "  ", "b"), (8, "d901é0", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    mix = mixing.mix_sources(docs, block=16, shard_words=256)
    parts = mixing.write_mix(mix)
    blocks = mixing.mixed_blocks(parts)
    found = Counter(w.split("é")[0] for r in blocks.collect() for w in words(r["text"]))
    texts = {r["_row"]: r["_text"] for r in mix.texts.collect()}
    taken = {r["_row"]: sum(p["n_words"] for p in mix.pieces.filter(f"_row = {r['_row']}").collect()) for r in mix.rows.limit(9).collect()}
    for row, n in taken.items():
        if row in texts:
            assert found[words(texts[row])[0].split("é")[0]] == n
    out = mixing.taken_words(mix, parts).collect()
    unique = mixing.mix_sources(docs.filter("doc_id < 7"), block=16, shard_words=256)
    assert unique.texts.schema['_row'].dataType.simpleString() == 'bigint' and mixing.taken_words(unique).count() == 5
    assert len(out) == len(rows) and sum(r["taken"] for r in out) == sum(found.values())
    assert max(len(words(r["text"])) for r in blocks.collect()) == 16
    assert all(r["taken"] <= 2 * r["size"] for r in out)


def test_slots_of_one_source_are_dealt_over_tasks(spark, many_chunks, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_SLOTS", 50)
    plan = mixing.plan_mix([40_000, 300], [60_000, 300], 8, 1 << 20, 1)
    slots = mixing._slots(spark, plan)
    rows = [r["n"] for r in slots.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(rows) == plan.slots.sum() and len(rows) > 3 and max(rows) < 0.5 * sum(rows)


def test_permutations_and_targets():
    for n in (1, 2, 3, 17, 1000):
        there = mixing.permute(np.arange(n), n, 7)
        assert sorted(there.tolist()) == list(range(n)) and (mixing.unpermute(there, n, 7) == np.arange(n)).all()
    assert mixing.permute(mixing.unpermute(np.array([6 * 10**10 - 1]), 6 * 10**10, 3), 6 * 10**10, 3)[0] == 6 * 10**10 - 1
    assert mixing.targets([10, 10, 100], [3, 1, 2], 1.5, 2) == pytest.approx([20, 20, 140])
    assert mixing.targets([0, 10], [3, 1], 1.5, 2) == [0, 15]


def test_empty_mix(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.taken_words(mixing.mix_sources(docs)).collect()] == [0, 0]
    assert mixing.taken_words(mixing.mix_sources(docs.limit(0))).count() == 0


# ---- language model


def small_chunk(rng):
    sizes = [rng.randrange(1, 700 if k == 3 else 30) for k in range(30)]
    hashes = [np.append(np.array([1 + int(rng.paretovariate(0.8)) % 40 for _ in range(n - 1)], np.uint64) * np.uint64(977), lm.END) for n in sizes]
    vocabulary, code = np.unique(np.concatenate(hashes), return_inverse=True)
    return lm.Chunk([k % 4 == 0 for k in range(30)], sizes, lm.pack(code), lm.pack_keys(vocabulary), 0)


def test_arcs_out_of_a_state_sum_to_one():
    """A state's arcs, and through failure arcs those of the states below for all other words, are a distribution."""
    chunk = small_chunk(random.Random(2))
    counts = chunk.counts()
    total, distinct, texts = float(counts[0].sum()), float((counts[0] > 0).sum()), float((~chunk.held).sum())
    automaton = lm.build_automaton(chunk, counts, texts, total, distinct)
    assert len(np.unique(automaton.arc_key)) == len(automaton.arc_key)
    known = np.flatnonzero(counts[0] > 0)

    def chance(state, word):
        weight = np.zeros(len(lm.SMOOTHING))
        while state:
            at = np.searchsorted(automaton.arc_key, state * automaton.words + word)
            if at < len(automaton.arc_key) and automaton.arc_key[at] == state * automaton.words + word:
                return 10 ** (weight + automaton.arc_weight[at])
            weight, state = weight + automaton.fail_weight[state], automaton.fail_next[state]
        return 10 ** (weight + automaton.root_weight[word])

    def unknown(state):
        weight = np.zeros(len(lm.SMOOTHING))
        while state:
            weight, state = weight + automaton.fail_weight[state], automaton.fail_next[state]
        return 10 ** weight / (total + distinct + 1)

    going_on = np.delete(automaton.entry, chunk.start + chunk.lengths - 1)  # nothing follows an end
    states = [0, automaton.begin, *np.unique(going_on)[::7]]
    for state in states:
        whole = sum(chance(state, w) for w in known) + unknown(state)
        assert whole == pytest.approx(np.ones(len(lm.SMOOTHING)), abs=1e-9)


def test_segments_walk_like_whole_texts(monkeypatch):
    chunk = small_chunk(random.Random(5))
    automaton = lm.build_automaton(chunk, chunk.counts(), float((~chunk.held).sum()), 400.0, 30.0)
    whole = automaton.walk(chunk.code, chunk.start, chunk.lengths)
    monkeypatch.setattr(lm, "SEGMENT", 3)
    assert automaton.walk(chunk.code, chunk.start, chunk.lengths) == pytest.approx(whole)


def test_scores_match_a_plain_automaton(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 500)
    monkeypatch.setattr(lm, "RANGE_TOKENS", 700)
    rng = random.Random(6)
    texts = [None, "", " ", "One", "one two", "the " * 3000] + [" ".join(rng.choice("the a of to Be in x y".split()) + rng.choice(["", "", "s"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    rows = [(k, t, "x", None, 0.5, 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, NOISE).repartition(3)
    left = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    got = lm.score_texts(docs, left == 2, left == 3).collect()
    (chosen,) = {r["smoothing"] for r in got}
    assert len(got) == len(rows)
    expected = language_model([(r[0], r[1]) for r in rows], lm.SMOOTHING[chosen])
    for r in got:
        n, known, total, base, score = expected[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, remainder(r["doc_id"], 7) == 2)
        assert r["base_score"] == pytest.approx(base, abs=1e-9) and r["score"] == pytest.approx(score, abs=1e-9)


def test_model_without_training_texts(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    got = lm.score_texts(docs, F.lit(True), F.lit(False)).collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got} == {(0, 0, 0.0, 0.0)}
    assert lm.score_texts(docs.limit(0), F.lit(False), F.lit(False)).count() == 0


# ---- toxicity


def test_symbols_join_gapped_words():
    same = [toxicity.symbols(t).tolist() for t in ("idiot", " i d i o t ", "I.d.i.o.t", "i-d i-o t", "ídïot!")]
    assert same[0] == same[1] == same[2] == same[4]
    assert toxicity.symbols("").tolist() == [toxicity.EDGE] and toxicity.symbols("!!").tolist() == [toxicity.EDGE]


def test_insults_are_learned(spark):
    rng = random.Random(7)
    stems = ["an", "the", "re", "ing", "ou", "tion", "st", "ly", "ed", "er"]
    word = lambda: "".join(rng.choice(stems) for _ in range(rng.randrange(1, 4)))
    bad = ["wretchof", "dumbolt", "slurpig"]

    def text(toxic):
        w = [word() for _ in range(rng.randrange(20, 90))]
        for _ in range(3 if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(bad)
        return re.sub(r"((?:\S+ ){8}\S+) ", r"\1. ", " ".join(w))

    rows = [(k, text(k % 4 == 0), "x", "s", 0.1, int(k % 4 == 0)) for k in range(260)]
    rows += [(1000, None, "x", "s", 0.0, 1), (1001, "", "x", "s", 0.0, None), (1002, text(True) * 3, "x", "s", 0.0, None), (1003, "the " * 60_000, "x", "s", 0.0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, toxic int").repartition(2)
    model = toxicity.fit_toxicity(docs.filter("doc_id % 3 != 0"), "doc_id", "text", "toxic")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model, "doc_id", "text").collect()}
    assert len(got) == len(rows)
    for i, _, _, _, _, label in rows[:260]:
        assert (got[i] >= toxicity.THRESHOLD) == bool(label)
    assert got[1002] > 0.3 and max(got[1000], got[1001], got[1003]) < 0.3
    plain, gapped, inserted = (model.score(f"re the {w} ing") for w in ("slurpig", "s l u r p i g", "slurpxig"))
    assert plain >= 0.3 and gapped >= 0.3 and inserted > model.score("re the stedly ing")
    texts = ["ing", None, "dumbolt " * 5, "dumbolt", ""]
    assert model.score_many(texts) == pytest.approx([model.score(t) for t in texts])
    assert model.score("dumbolt " * 5) >= model.score("dumbolt")  # repeats are evidence


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, "b", 0)], "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(docs, "doc_id", "text", "toxic")
    assert all(r["score"] < 0.3 for r in toxicity.score_toxicity(docs, model, "doc_id", "text").collect())
    assert toxicity.score_toxicity(docs.limit(0), model, "doc_id", "text").count() == 0


# ---- languages


def test_languages_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE", 120)
    rng = random.Random(9)
    stems = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ung", "ö"], "cc": ["ción", "os", "ñ"]}
    text = lambda lang, n: " ".join("".join(rng.choice(stems[lang]) for _ in range(3)) for _ in range(n))
    rows = [(k, text("abc"[k % 3] * 2, rng.randrange(4, 60)), "abc"[k % 3] * 2) for k in range(300)]
    rows += [(400, None, "aa"), (401, "", "bb"), (402, "12 %% ?", "cc"), (403, text("bb", 30_000), None), (404, "日本語", None)]
    docs = spark.createDataFrame([(*r, "s", 1.0, 2) for r in rows], "doc_id long, text string, lang string, source string, score double, _id long")
    model = language_id.fit_languages(docs.filter("doc_id % 4 != 2"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict_languages(docs, model).collect()}
    assert len(got) == len(rows) and all(got[r[0]][0] == r[2] for r in rows[:300])
    assert [got[k] for k in (400, 401, 402)] == [("und", 0.0)] * 3 and got[403][0] == "bb" and got[404][0] in stems
    assert (model.weights == 0).mean() > 0.9 and 0 < model.temperature < 20
    empty = language_id.fit_languages(docs.limit(0))
    assert empty.predict("text") == ("und", 0.0) and language_id.predict_languages(docs.limit(0), model).count() == 0


def test_pieces_lose_no_ngram(monkeypatch):
    text = " 1añb  \u65e5x " * 50
    whole = language_id.text_counts(text)
    monkeypatch.setattr(language_id, "PIECE", 16)
    assert np.array_equal(language_id.text_counts(text), whole)


def test_temperature():
    truth = np.array([0, 0, 0, 1] * 20)
    logits = np.tile([5.0, 0.0], (80, 1))
    t = language_id.fit_temperature(logits, truth)
    assert 1 / (1 + np.exp(-5 / t)) == pytest.approx(0.75, abs=0.01)


def test_scores_of_dirty_rows(spark, tmp_path):
    """Toxicity and language: null and repeated ids, null and empty texts, repeated rows, clashing names, empty tables."""
    rng = random.Random(11)
    word = {"aa": lambda: rng.choice(["the", "and", "thing", "over"]), "bb": lambda: rng.choice(["der", "und", "ding", "über"])}
    rows = [(k, " ".join(word[lang]() for _ in range(30)) + (" dumbolt dumbolt" if k % 3 == 0 else ""), lang, 0.5, "x") for k, lang in enumerate(["aa", "bb"] * 80)]
    rows += [(None, rows[0][1], "aa", 0.1, "y"), (None, None, None, 0.1, "y"), (7, "", "aa", 0.0, "z"), (7, " .1 ", "bb", 0.0, "z"), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(k, 1, int(k % 3 == 0)) for k in range(160)] + [(None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for query, value in ((toxicity.op7_toxicity, "predicted"), (language_id.op10_language_id, "lang_pred")):
        got = query(spark, str(tmp_path)).collect()
        assert len(got) == len(rows) and all(r["held_out"] is not None and 0 <= r["score"] <= 1 for r in got)
        assert all(r["held_out"] for r in got if r["doc_id"] is None)
        assert len({(r["score"], r[value]) for r in got if r["doc_id"] == 3}) == 1
    found = {r["doc_id"]: r["lang_pred"] for r in got}
    assert all(found[k] == lang for k, _, lang, _, _ in rows[:160] if k != 7)
    assert [r["lang_pred"] for r in got if r["doc_id"] is None].count("und") == 1
    model = language_id.fit_languages(docs.filter("doc_id < 100"))
    assert language_id.predict_languages(docs.limit(0), model).count() == 0
