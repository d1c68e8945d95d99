import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.jobs import text_queries
from lodestone.operators import chunking, evaluate, graph, index, pack, search, structure
from lodestone.sources import files as sources
from lodestone.streaming import ingest


def test_chunks_cover_and_overlap():
    assert list(chunking.chunks("")) == [(1, 1, "")]
    got = list(chunking.chunks("a" * 10_000, chunking.Limits(target=1000, overlap=100)))
    assert all(len(t) <= 1000 for _, _, t in got) and got[-1][2].endswith("a")
    assert len(list(chunking.chunks("line\n" * 10_000, chunking.Limits(target=200, overlap=20, most=3)))) == 3
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab\n") for _ in range(rng.randint(0, 300)))
        parts = list(chunking.chunks(text, chunking.Limits(target=rng.randint(1, 40), overlap=rng.randint(0, 30), most=10_000, reach=5)))
        reach = 0  # every chunk is of the text, goes on from what the ones before it cover, or overlaps it, and none is left out
        for _, _, t in parts:
            at = max(i for i in range(reach + 1) if text.startswith(t, i))
            reach = max(reach, at + len(t))
        assert reach == len(text)
        assert text == "" or parts[-1][2] == text[len(text) - len(parts[-1][2]) :]
    with pytest.raises(ValueError):
        chunking.Limits(target=0)


@pytest.mark.parametrize("text", ["0123456789" * 30_000, "a line of text\n" * 20_000])
def test_registered_chunks_reach_the_end(text):
    got = list(chunking.chunks(text, text_queries.LIMITS))
    assert len(got) > 80 and text.endswith(got[-1][2])
    assert got[-1][1] == max(1, text.count("\n")) and sum(len(t) for _, _, t in got) >= len(text)


def test_symbols_and_dependencies(spark):
    text = "export class Foo {}\nimport { a } from './b.js'\n  def run(x):\npub fn go() {}\nconst y = require(\"z\")\nfrom os.path import join"
    files = spark.createDataFrame([("src/a.ts", text), ("src/b.ts", ""), ("m.py", text)], "path string, text string")
    got = {(r.name, r.kind, r.line, r.exported) for r in structure.symbols(files).where("path = 'src/a.ts'").collect()}
    assert got == {("Foo", "class", 1, True), ("run", "function", 3, False), ("go", "function", 4, True), ("y", "const", 5, False)}
    deps = structure.dependencies(files)
    assert {(r.specifier, r.line) for r in deps.where("path = 'src/a.ts'").collect()} == {("./b.js", 2), ("z", 5)}
    assert {r.specifier for r in deps.where("path = 'm.py'").collect()} == {"os.path"}
    resolved = structure.resolve(deps, files)
    assert {(r.specifier, r.resolved_path) for r in resolved.where("path = 'src/a.ts'").collect()} == {("./b.js", "src/b.ts"), ("z", None)}


@pytest.mark.parametrize("base, relative, path", [("a/b.ts", "./c", "a/c"), ("a/b.ts", "../c", "c"), ("b.ts", "../../c", "c"), ("a/b/c.ts", "../d/./e", "a/d/e")])
def test_joined_path(spark, base, relative, path):
    assert spark.range(1).select(structure.joined_path(F.lit(base), F.lit(relative)).alias("p")).first()["p"] == path


def test_walk_keeps_first_way(spark):
    rows = [("root.ts", "./a", 1, "a.ts"), ("a.ts", "./b", 1, "b.ts"), ("root.ts", "./t", 2, "a.test.ts"), ("b.ts", "./root", 1, "root.ts")]
    resolved = spark.createDataFrame(rows, "path string, specifier string, line int, resolved_path string")
    seeds = spark.createDataFrame([("root.ts", 0)], "path string, order int")
    got = [(r.path, r.depth, r.via) for r in graph.walk(resolved, seeds, 3, 10).orderBy("position").collect()]
    assert got == [("root.ts", 0, None), ("a.ts", 1, "root.ts"), ("b.ts", 1, "root.ts"), ("a.test.ts", 1, "root.ts")]
    assert len(graph.walk(resolved, seeds, 3, 2).collect()) == 2


def test_knn_and_fuse(spark):
    v = spark.createDataFrame([(1, [0.1] * 8), (2, [0.2] * 8), (3, [0.3] * 7)], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in search.nearest(v, [0.12] * 8, 5).collect()] == [1, 2]
    with pytest.raises(ValueError):
        search.nearest(v, [0.1] * 8, 0)
    s = spark.createDataFrame([(1, 0.1), (2, 0.2)], "key long, distance double")
    w = spark.createDataFrame([(2, -3.0), (3, -1.0)], "key long, score double")
    got = search.fuse(s, w, 10).collect()
    assert got[0].key == 2 and got[0].kinds == ["semantic", "keyword"] and len(got) == 3


def test_bm25_and_fallback(spark):
    f = spark.createDataFrame([("a.ts", "payment payment"), ("b.ts", "other"), ("payment.ts", "x")], "path string, text string")
    got = {r.path: r.score for r in search.bm25(f, ["payment", "zz"]).collect()}
    assert set(got) == {"a.ts", "payment.ts"} and all(x < 0 for x in got.values())
    assert search.bm25(f, ["zz"]).count() == 0 and search.matches(f, ["ab"]).count() == 0
    assert {r.path: r.score for r in search.like_fallback(f, "B.").collect()} == {"b.ts": -10.0}


def test_budget(spark):
    rows = [("q", 1, "a", "12345"), ("q", 2, "b", "x" * 26), ("q", 3, "c", "y")]
    got = pack.budgeted(spark.createDataFrame(rows, "query string, position int, path string, snippet string"), 20).orderBy("position").collect()
    assert [r.truncated for r in got] == [False, True, True] and sum(len(r.snippet) for r in got) <= 20


def test_index_maintenance(spark):
    schema = "path string, size long, mtime double, hash string, text string"
    old = spark.createDataFrame([("same", 1, 1.0, "h", "a"), ("gone", 1, 1.0, "h", "a"), ("edit", 1, 1.0, "h", "a"), ("touch", 1, 1.0, "h", "a")], schema)
    new = spark.createDataFrame([("same", 1, 1.0, "h", "a"), ("edit", 2, 2.0, "i", "ab"), ("touch", 1, 9.0, "h", "a"), ("new", 1, 1.0, "n", "n")], schema)
    got = {r.path: r.state for r in index.freshness(old, new).collect()}
    assert got == {"same": "fresh", "gone": "missing", "edit": "modified", "touch": "metadata_changed", "new": "new"}
    assert index.freshness_counts(index.freshness(old, new)).first()["status"] == "stale"
    cut = lambda f: chunking.chunk_files(f)
    assert {r.path for r in index.reindex(cut(old), old, new, cut).collect()} == {"same", "edit", "touch", "new"}
    chunks = spark.createDataFrame([("1", "abc"), ("2", "a" * 12)], "chunk_id string, text string")
    got = {r.chunk_id: r.vector for r in index.embed(chunks, index.length_provider(2), 2).collect()}
    assert got["1"] == pytest.approx([0.3, 0.3]) and got["2"] == pytest.approx([0.2, 0.2])


def test_measures(spark):
    ranked = spark.createDataFrame([("a", 1), ("b", 4), ("c", None)], "case_id string, rank int")
    r = evaluate.gate(evaluate.measures(ranked)).first()
    assert (r.cases, r.passed) == (3, False) and r.hit1 == pytest.approx(1 / 3) and r.mrr == pytest.approx((1 + 0.25) / 3)


def test_project_files(spark, tmp_path):
    (tmp_path / ".gitignore").write_text("ignored.txt\n")
    (tmp_path / "ignored.txt").write_text("x")
    (tmp_path / "index.ts").write_text("export const a = 1")
    (tmp_path / "package-lock.json").write_text("{}")
    (tmp_path / "large.txt").write_text("x" * 128)
    (tmp_path / "binary.bin").write_bytes(bytes([0, 1, 2, 3]))
    os.mkdir(tmp_path / "node_modules")
    (tmp_path / "node_modules" / "m.js").write_text("x")
    sources.register(spark)
    rows = {r.path: r.reason for r in spark.read.format("project_files").option("max_bytes", 64).load(str(tmp_path)).collect()}
    assert rows == {".gitignore": None, "index.ts": None, "ignored.txt": "ignored", "large.txt": "too_large", "binary.bin": "binary"}


def test_binary():
    assert not sources.is_binary(b"") and sources.is_binary(b"a\0b") and sources.is_binary(b"\xff\xfe")
    assert not sources.is_binary(("界" * 3000).encode()[:8192])


def test_ingest(spark, tmp_path):
    src, table = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", "one"), ("b", "two")], "path string, text string").write.parquet(src)
    run = lambda: ingest.ingest(spark.readStream.schema("path string, text string").parquet(src), table, str(tmp_path / "ck")).awaitTermination()
    run()
    spark.createDataFrame([("a", "three")], "path string, text string").write.mode("append").parquet(src)
    run()
    assert {(r.path, r.text) for r in ingest.current(spark, table).collect()} == {("a", "three"), ("b", "two")}


def test_signature_and_paths_of_imports(spark):
    files = spark.createDataFrame([("a/b.ts", "\tclass  Foo {}\n  import x from './c d.js?raw'\r\n"), ("m.py", "from pkg.mod import x\n  def  go(a):\n"), ("m.rs", "\tpub fn run() {}\nuse std::io;\npub struct S;"), ("m.go", "func (s *T) Do() {}\nimport \"fmt\"\n")], "path string, text string")
    got = {(r.path, r.kind, r.name, r.signature, r.exported) for r in structure.symbols(files).collect()}
    assert got == {("a/b.ts", "class", "Foo", "class Foo {}", False), ("m.py", "function", "go", "def go(a):", False), ("m.rs", "function", "run", "pub fn run() {}", True), ("m.rs", "struct", "S", "pub struct S;", True), ("m.go", "function", "Do", "func (s *T) Do() {}", False)}
    assert {(r.path, r.specifier) for r in structure.dependencies(files).collect()} == {("a/b.ts", "./c d.js?raw"), ("m.py", "pkg.mod"), ("m.rs", "std::io"), ("m.go", "fmt")}
    cases = {("src/a/b.ts", "../c.js"): "src/c.js", ("src/a/b.ts", "../../../c"): "c", ("b.ts", "./x?raw#y"): "x", ("src/b.ts", "./d/"): "src/d/", ("src/b.ts", "."): "src/", ("src/b.ts", ".."): "", ("src/b.ts", "./a b/\u00e9.ts"): "src/a%20b/%C3%A9.ts", ("src/b.ts", "./a//b"): "src/a//b", ("src/b.ts", "./[id].ts"): "src/[id].ts"}
    rows = spark.createDataFrame(list(cases), "p string, r string").select("p", "r", structure.joined_path(F.col("p"), F.col("r")).alias("j")).collect()
    assert {(r.p, r.r): r.j for r in rows} == cases


def test_chunk_search_falls_back_and_reranks_counterparts(spark):
    from lodestone.operators import retrieval

    chunks = spark.createDataFrame([("src/a.ts", 0, 1, 2, "export function alpha() {}"), ("src/a.test.ts", 0, 1, 3, "alpha spec alpha alpha"), ("docs/a.md", 0, 1, 1, "nothing here"), ("docs/a.md", 1, 1, 1, "zq_9 alpha")], "path string, ordinal int, start_line int, end_line int, text string")
    queries = spark.createDataFrame([("1", "alpha"), ("2", "zq"), ("3", "!"), ("4", "absent")], "query_id string, query string")
    got = retrieval.keyword(chunks, retrieval.postings_index(chunks), queries, 5).collect()
    assert {(r.query_id, r.path, r.ordinal) for r in got} == {("1", "src/a.ts", 0), ("1", "src/a.test.ts", 0), ("1", "docs/a.md", 1), ("2", "docs/a.md", 1)}
    assert {r.score for r in got if r.query_id == "2"} == {-1.0}
    found = spark.createDataFrame([("1", "src/a.test.ts", 0, 1, 3, 2.0, "spec", ["keyword"]), ("1", "src/a.ts", 0, 1, 2, 0.1, "own", ["keyword"])], "query_id string, path string, ordinal int, start_line int, end_line int, score double, snippet string, kinds array<string>")
    with_sources = {r.path: (r.score, r.kinds) for r in retrieval.with_counterparts(found, chunks, 0.85).collect()}
    assert with_sources == {"src/a.test.ts": (2.0, ["keyword"]), "src/a.ts": (1.7, ["local"])}
    symbols = spark.createDataFrame([("src/a.ts", "alpha", 1)], "path string, name string, line int")
    degrees = spark.createDataFrame([("src/a.ts", 1, 1)], "path string, n_imports int, n_imported_by int")
    ranked = retrieval.rerank(found, queries, chunks, symbols, degrees, 5).collect()
    assert [(r.path, r.rank_score) for r in sorted(ranked, key=lambda r: r.position)] == [("src/a.ts", 2.75), ("src/a.test.ts", 1.75)]
    plain = retrieval.rerank(found, queries, chunks, symbols, degrees, 5, {"symbol": 0.0, "role": 0.0, "graph": 0.0, "counterpart": 0.0}).collect()
    assert sorted(plain, key=lambda r: r.position)[0].path == "src/a.test.ts"


def test_related_snippets_keep_their_budget(spark):
    from lodestone.operators import pack

    chunks = spark.createDataFrame([("a", i, i + 1, i + 1, t) for i, t in enumerate(["x" * 50, "y" * 10, "z"])] + [("b", 0, 1, 1, "  "), ("b", 1, 2, 2, "never"), ("c", 0, 1, 1, "w" * 40)], "path string, ordinal int, start_line int, end_line int, text string")
    paths = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b"), ("q", 3, "c")], "query_id string, at int, path string")
    got = [(r.path, r.start_line, r.snippet, r.truncated) for r in pack.related_snippets(paths, chunks, 2, 40, 70).collect()]
    assert got == [("a", 1, "x" * 24 + "\n... [truncated]", True), ("a", 2, "y" * 10, False), ("c", 1, "w" * 4 + "\n... [truncated]", True)]


@pytest.mark.parametrize(
    "rules, path, out",
    [("a/*.ts", "a/b/c.ts", False), ("a/*.ts", "a/c.ts", True), ("**/x", "x", True), ("**/x", "q/r/x", True), ("\\#a", "#a", True), ("\\!a", "!a", True), ("#a", "#a", False), ("*.log\n!keep.log", "d/keep.log", False), ("*.log\n!keep.log", "d/z.log", True), ("build/", "a/build/x", True), ("build/", "build", False), ("/build", "a/build/x", False), ("dir\n!dir/a", "dir/a", True), ("a/**", "a/b/c", True), ("a/**", "a", False), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("a?c", "a/c", False), ("[!a]x", "bx", True), ("[!a]x", "ax", False), ("FOO", "foo", True), ("foo  ", "foo", True), ("foo\\ ", "foo ", True)],
)
def test_ignore_rules(tmp_path, rules, path, out):
    (tmp_path / ".gitignore").write_text(rules)
    assert sources.ignored(path, sources.ignore_rules(str(tmp_path))) is out


def test_built_in_rules_bind_at_the_root(spark, tmp_path):
    os.mkdir(tmp_path / "sub")
    for name in ("bun.lock", "a.7z", "sub/bun.lock", "sub/a.png"):
        (tmp_path / name).write_text("x")
    sources.register(spark)
    assert {r.path for r in spark.read.format("project_files").load(str(tmp_path)).collect()} == {"sub/bun.lock", "sub/a.png"}


def test_cases_and_suites(spark, tmp_path):
    import json

    def read(*cases):
        (tmp_path / "cases.json").write_text(json.dumps(cases))
        return evaluate.read_cases(spark, str(tmp_path / "cases.json"))

    one = {"id": "1", "query": "q", "expectedPaths": ["./src/a.ts", "src/a.ts", "b"], "tags": [" x "]}
    two = {"id": "2", "query": "q", "expectedPaths": ["c"]}
    got = read(one, two)
    assert {(r.case_id, r.path, tuple(r.tags)) for r in got.collect()} == {("1", "src/a.ts", ("x",)), ("1", "b", ("x",)), ("2", "c", ())}
    assert {r.case_id for r in evaluate.in_suites(got, ["x"]).collect()} == {"1"} and evaluate.in_suites(got, ["full", "x"]).count() == 3
    with pytest.raises(ValueError, match="unknown suites: y"):
        evaluate.in_suites(got, ["x", "y"])
    for wrong in ({**two, "query": " "}, {**two, "id": "1"}, {**two, "expectedPaths": []}, {**two, "expectedPaths": ["/etc/x"]}, {**two, "expectedPaths": ["a/../../x"]}, {**two, "tags": [" "]}):
        with pytest.raises(ValueError):
            read(one, wrong)


def test_ranks_count_distinct_paths_without_the_excluded(spark):
    results = spark.createDataFrame([("1", "a", 1), ("1", "a", 2), ("1", "x", 3), ("1", "b", 4), ("2", "a", 1)], "case_id string, path string, position int")
    expected = spark.createDataFrame([("1", "b"), ("2", "z")], "case_id string, path string")
    assert {r.case_id: r.rank for r in evaluate.ranks(results, expected).collect()} == {"1": 3, "2": None}
    assert {r.case_id: r.rank for r in evaluate.ranks(results, expected, spark.createDataFrame([("x",)], "path string")).collect()} == {"1": 2, "2": None}
    runs = spark.createDataFrame([("auto", 1, 100), ("auto", None, 300), ("off", 5, 50), ("off", None, None)], "mode string, rank int, tokens long")
    got = evaluate.measures_by(runs, "mode")
    r = {x["mode"]: x for x in got.collect()}
    assert (r["auto"].hit1, r["auto"].hit5_per_1k, r["off"].tokens) == (0.5, 2.5, 25.0)
    d = evaluate.delta(got, "mode", "auto", "off", ["hit1", "mrr"]).first()
    assert d.hit1 == 0.5 and d.mrr == pytest.approx(0.4)


def test_next_actions(spark):
    schema = "files long, chunks long, posting_chunks long, symbols long, dependencies long, embeddings long, status string"
    ask = lambda *rows: [r.action for r in index.next_actions(spark.createDataFrame(rows, schema)).orderBy("position").collect()]
    assert ask((2, 5, 5, 1, 1, 5, "fresh")) == ["ready"]
    assert ask((2, 5, 4, 0, 0, 3, "stale")) == ["refresh changed files", "repair missing postings", "extract symbols", "extract dependencies", "embed missing chunks"]
    assert ask((1, 0, 0, 1, 0, 0, "fresh")) == ["index files and chunks", "embed chunks"]
    assert ask() == ["create the index", "embed chunks"]


def test_latest_records(spark):
    held = spark.createDataFrame([("a", 1, "old"), ("b", 1, "kept")], "k string, at long, v string")
    new = spark.createDataFrame([("a", 2, "mid"), ("a", 3, "new"), ("c", 1, "c")], "k string, at long, v string")
    assert {tuple(r) for r in index.latest_records(held, new, ["k"]).collect()} == {("a", 3, "new"), ("b", 1, "kept"), ("c", 1, "c")}
