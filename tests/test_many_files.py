"""Many small files in few scans, and labels repaired by their parts."""

import random

import pytest
from pyspark.sql import functions as F

from assayloom.operators import labels
from assayloom.sources import files


def test_files_with_several_headers(spark, tmp_path):
    for i in range(60):
        head, row = ("a,b", f"{i},x{i}") if i % 3 else ("b,c,Unnamed: 0", f"y{i},{i}.5,9")
        (tmp_path / f"m_{i} +é.csv").write_text(f"{head}\n{row}\n")
    (tmp_path / "m_t.txt").write_text("a\td\n7\tNaN\n")
    spark.createDataFrame([(1, 2.0)], "a int, e double").write.parquet(str(tmp_path / "m_p1"))
    spark.createDataFrame([(2, "z")], "a int, f string").write.parquet(str(tmp_path / "m_p2"))
    found = files.read_folder(spark, f"{tmp_path}/m_*", ("m_",))
    assert set(found.columns) == {"a", "b", "c", "d", "e", "f", "source"}
    got = {r.source: r for r in found.collect()}
    assert set(got) == set(files.list_files(spark, f"{tmp_path}/m_*"))
    name = lambda n: f"file:{tmp_path}/{n}"
    assert (got[name("m_1 +é.csv")].a, got[name("m_1 +é.csv")].b, got[name("m_3 +é.csv")].c, got[name("m_3 +é.csv")].a) == (1, "x1", 3.5, None)
    assert (got[name("m_t.txt")].a, got[name("m_t.txt")].d, got[name("m_p1")].e, got[name("m_p2")].f) == (7, None, 2.0, "z")


def test_the_plan_does_not_grow_with_the_files(spark, tmp_path):
    sizes = []
    for n in (3, 300):
        folder = tmp_path / str(n)
        folder.mkdir()
        for i in range(n):
            (folder / f"r_{i}.csv").write_text(f"a,b\n{i},{i}\n" if i % 2 else f"a,c\n{i},{i}\n")
        found = files.read_folder(spark, f"{folder}/*")
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(plan.count("Relation"))
        assert found.count() == n
    assert sizes == [2, 2]


def test_model_names(spark, tmp_path):
    names = ["run_rfe_important_features_gbt.csv", "plain.csv", "x_rfe_important_features_a.b.csv", "rfe_important_features_rfe_important_features_z.csv"]
    for i, n in enumerate(names):
        (tmp_path / n).write_text(f"a\n{i}\n")
    got = {r.a: r.model for r in files.read_results(spark, [f"{tmp_path}/{n}" for n in names]).collect()}
    assert got == {i: files.model_name(n) for i, n in enumerate(names)}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.fixture(scope="module")
def words():
    rng = random.Random(4)
    base = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(60)] + ["", "é", "日本語 x"]
    other = []
    for w in base:
        v = list(w)
        for _ in range(rng.randint(0, 5)):
            at = rng.randint(0, len(v))
            v[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "é"])
        other.append("".join(v))
    return sorted(set(base)), sorted(set(other))


@pytest.mark.parametrize("most", [1, 2, 3])
def test_pairs_within_some_edits(spark, words, most):
    new, old = words
    found = {(r.old, r.new) for r in labels.near_labels(spark.createDataFrame([(w,) for w in old], "old string"), spark.createDataFrame([(w,) for w in new], "new string"), most).collect()}
    assert found >= {(a, b) for a in old for b in new if a != b and edits(a, b) <= most}


def test_labels_are_repaired(spark, words):
    common, rare = words
    rare = [w for w in rare if w not in common] + ["nothing like any of the others at all"]
    rows = [w for i, w in enumerate(common) for _ in range(2 + i % 4)] + rare + [None]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, label string")
    n = {w: rows.count(w) for w in common}
    got = {r.id: r.label for r in labels.repair_labels(df).collect()}
    for i, w in enumerate(rows):
        assert got[i] == (w if w is None or w in n else min((edits(w, c), -n[c], c.encode()) for c in common)[2].decode())


def test_comparisons_grow_with_the_labels(spark):
    """Labels that share little are not compared, however many there are."""
    for n in (200, 800):
        rng = random.Random(n)
        new = ["".join(rng.choice("abcdefghijklmnop") for _ in range(20)) for _ in range(n)]
        old = [w[:7] + "?" + w[8:] for w in new]
        pairs = labels.near_labels(spark.createDataFrame([(w,) for w in old], "old string"), spark.createDataFrame([(w,) for w in new], "new string"), 1)
        assert n <= pairs.count() <= 2 * n
    assert labels.repair_labels(spark.createDataFrame([], "label string").withColumn("k", F.lit(1))).collect() == []
