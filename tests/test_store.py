"""The index on disk: what a second run rewrites, what a failed one leaves."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking, retrieval, store, structure


def files(spark, texts):
    return spark.createDataFrame(list(texts.items()), "path string, text string").withColumn("hash", F.sha2("text", 256))


def makers():
    grams = lambda f: f.select("path", F.explode(retrieval.grams(F.col("text"))).alias("gram"))
    vectors = lambda f: f.select("path", retrieval.letter_vector(F.col("text")).alias("vector"))
    return {"chunks": chunking.chunk_files, "symbols": structure.symbols, "dependencies": structure.dependencies, "postings": grams, "vectors": vectors}


def source(i, more=""):
    return f"import {{ x }} from './f{i + 1}.js'\nexport function go{i}() {{}}\n{more}"


def written(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def contents(spark, path):
    return {t: sorted(tuple(map(str, r)) for r in store.read(spark, path, t).drop("bucket").collect()) for t in ("files", *makers())}


def test_a_second_run_rewrites_touched_buckets_alone(spark, tmp_path):
    path, again = str(tmp_path / "index"), str(tmp_path / "anew")
    one = {f"f{i}.ts": source(i) for i in range(60)}
    first = store.update(path, files(spark, one), makers(), buckets=16)
    assert (first.version, first.states, first.carried) == (1, {"new": 60, "modified": 0, "missing": 0, "kept": 0}, 0)
    assert first.touched == store.read(spark, path, "files").select("bucket").distinct().count() > 8
    before = written(path)
    two = {k: v for k, v in one.items() if k != "f7.ts"} | {"f3.ts": source(3, "// changed"), "new.ts": "let a = 1"}
    second = store.update(path, files(spark, two), makers())
    assert (second.version, second.states) == (2, {"new": 1, "modified": 1, "missing": 1, "kept": 58})
    assert 1 <= second.touched <= 3 and second.carried < 58
    assert before < written(path)  # nothing was written over
    new = {f.split("/")[-2] for f in written(path) - before}
    assert len(new) <= second.touched
    store.update(again, files(spark, two), makers(), buckets=5)
    assert contents(spark, path) == contents(spark, again)
    assert store.update(path, files(spark, two), makers()) == store.Run(2, {"new": 0, "modified": 0, "missing": 0, "kept": 60}, 0, 0)
    held = contents(spark, path)
    assert store.vacuum(spark, path) > 0 and contents(spark, path) == held and len(written(path)) < len(before) + len(new) * 6
    assert store.read(spark, path, "chunks").where("bucket = 3").count() < 60


def test_a_failed_run_leaves_the_version_before(spark, tmp_path):
    path = str(tmp_path / "index")
    store.update(path, files(spark, {"a.ts": source(1), "b.ts": source(2)}), makers(), buckets=4)
    held = contents(spark, path)
    broken = {**makers(), "vectors": lambda f: f.select("path", F.raise_error(F.lit("refused")).cast("array<double>").alias("vector"))}
    with pytest.raises(Exception, match="refused"):
        store.update(path, files(spark, {"a.ts": source(9)}), broken)
    assert contents(spark, path) == held and store.latest(spark, path)["version"] == 1
    store.update(path, files(spark, {"a.ts": source(9)}), makers())
    assert {r.path for r in store.read(spark, path, "files").collect()} == {"a.ts"} and store.latest(spark, path)["version"] == 2


def test_of_two_runs_at_once_one_wins(spark, tmp_path):
    path = str(tmp_path / "index")
    store.update(path, files(spark, {"a.ts": source(1)}), {}, buckets=4)

    def slow(f):
        store.update(path, files(spark, {"a.ts": source(1), "c.ts": source(3)}), {})
        return f.select("path", F.lit(1).alias("x"))

    with pytest.raises(RuntimeError, match="first"):
        store.update(path, files(spark, {"a.ts": source(1), "b.ts": source(2)}), {"rows": slow})
    assert {r.path for r in store.read(spark, path, "files").collect()} == {"a.ts", "c.ts"}


def test_stores_of_nothing(spark, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(ValueError):
        store.read(spark, path, "files")
    none = files(spark, {"a": ""}).where("false")
    assert store.update(path, none, makers()).version == 1 and store.read(spark, path, "chunks").count() == 0
    assert store.update(path, files(spark, {"a.ts": ""}), makers()).states["new"] == 1 and store.read(spark, path, "chunks").count() == 1
    assert store.update(path, none, makers()).states["missing"] == 1 and store.read(spark, path, "files").count() == 0


def test_carried_rows_stay_right_where_the_bitmap_cannot_tell_files_apart(spark, monkeypatch):
    """With two bits of a bitmap most kept files look like changed ones: their rows are joined, and none is lost or doubled."""
    from lodestone import storage

    monkeypatch.setattr(storage, "LEAST_BITS", 2)
    monkeypatch.setattr(storage, "MOST_BITS", 2)
    path = storage.scratch(spark, "doubtful")
    old = [(f"p{i}", f"h{i}", i % 4) for i in range(40)]
    new = [(p, h + ("x" if int(p[1:]) % 9 == 0 else ""), n + (int(p[1:]) % 9 == 0)) for p, h, n in old if int(p[1:]) % 7] + [("q", "hq", 2)]
    makers = {"rows": lambda f: f.selectExpr("path", "explode(sequence(0, n)) AS i")}
    for rows in (old, new):
        store.update(path, spark.createDataFrame(rows, "path string, hash string, n int"), makers, 3)
    got = sorted((r.path, r.i) for r in store.read(spark, path, "rows").collect())
    assert got == sorted((p, i) for p, _, n in new for i in range(n + 1))
