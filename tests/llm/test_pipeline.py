"""The cleaning pipeline, stage by stage against plain versions; entry without the subpackage; registered queries."""

import os
import random
import shutil
import subprocess
import sys

import pytest
from brute import components, shingles, words

import corpus_pipeline
from candora.llm import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    stems = ["an", "the", "re", "ing", "ou", "tion", "st", "ly", "ed", "er"]
    word = lambda: "".join(rng.choice(stems) for _ in range(rng.randrange(1, 4)))
    text = lambda n: [word() for _ in range(n)]
    rows, toxic = [], {}
    for k in range(220):
        w = text(rng.randrange(30, 120))
        if k % 5 == 0:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["dumbolt", "slurpig"])
        toxic[k] = int(k % 5 == 0)
        rows.append([k, " ".join(w)])
    items = [[k, " ".join(text(30))] for k in range(3)]
    rows += [[300, rows[1][1].replace(" ", "  ")], [301, rows[1][1].replace(" ", "\n")], [302, " ".join(words(rows[2][1])[:-1] + ["changed"])]]
    rows += [[303, " ".join(text(40) + words(items[1][1]) + text(20))], [304, None], [305, ""], [306, " ".join(text(9000))], [307, rows[0][1]]]
    path = str(tmp_path_factory.mktemp("sf"))
    docs = [(i, t, "en", rng.choice(["a", "b", None]), len(t or "")) for i, t in rows] + [(None, "no id", "en", "a", 5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, toxic, items


def test_stages(spark, folder):
    path, toxic, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path).cache()
        assert out.columns == columns
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert all(before[i] == t for i, t in after.items())
        gone = set(before) - set(after)
        if name == "toxicity":
            assert gone == {i for i, t in toxic.items() if t} | {307}
        elif name == "exact dedup":
            assert gone == {300, 301, 305} and 304 in after
        elif name == "MinHash near-dedup":
            wanted = components([(i, t) for i, t in before.items() if i is not None], 5, 80)
            assert gone == {i for i, (_, _, stays) in wanted.items() if not stays} and 302 in gone
        else:
            leaks = {
                i for i, t in before.items() for _, u in items
                if 100 * len(shingles(t, 5) & shingles(u, 5)) >= 80 * len(shingles(u, 5))
            }
            assert gone == leaks == {303}
        kept[name] = len(after)
        docs = out
    final = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert len(final) == docs.count() and sum(r["taken"] for r in final) > sum(r["size"] for r in final)


def test_run_equals_its_stages(spark, folder):
    path, _, _ = folder
    got = corpus_pipeline.run(spark, path)
    assert got.columns == ["doc_id", "source", "size", "source_size", "target", "taken"]
    ids = [r["doc_id"] for r in got.collect()]
    assert len(ids) == len(set(ids)) and not {300, 301, 302, 303, 305, 0, 5} & set(ids) and {1, 2, 304, 306} <= set(ids)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_queries_match_their_sql(spark, name):
    import oracle

    assert oracle.compare(catalog.QUERIES[name](spark, SF), oracle.connect(SF), catalog.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_other_queries_return_every_row(spark, name):
    out = catalog.QUERIES[name](spark, SF)
    table = "pages" if "page_id" in out.columns else "documents"
    assert out.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_entry_without_the_subpackage(tmp_path):
    for name in ("candora", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        copy = shutil.copytree if os.path.isdir(source) else shutil.copy
        copy(source, tmp_path / name, **({"ignore": shutil.ignore_patterns("llm", "__pycache__")} if os.path.isdir(source) else {}))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 90 and not [q for q in e.queries() if q[:2] == 'op' or q == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_entry_registers_all():
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' in q and sum(k.startswith('op') and k[2].isdigit() for k in q) == 13"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
