"""Every profile at once against one run a profile; line search for all cases against one run a case."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import index, lines, retrieval, search


def test_profiles_are_those_of_one_run_each(spark):
    chunks = spark.createDataFrame([("src/alpha.ts", 0, 1, 2, "export function alpha() {}"), ("src/alpha.test.ts", 0, 1, 3, "alpha spec"), ("docs/a.md", 0, 1, 1, "alpha docs"), ("src/b.ts", 0, 1, 1, "beta"), ("src/b.spec.ts", 0, 1, 1, "beta spec")], "path string, ordinal int, start_line int, end_line int, text string")
    rows = [("1", 1, "docs/a.md", 0, 1, 1, 1.9, "alpha docs"), ("1", 2, "src/alpha.test.ts", 0, 1, 3, 1.5, "alpha spec"), ("1", 3, "src/alpha.ts", 0, 1, 2, 1.2, "export function alpha() {}"), ("2", 1, "src/b.spec.ts", 0, 1, 1, 1.0, "beta spec"), ("3", 1, "src/b.spec.ts", 0, 1, 1, 0.9, "beta spec"), ("3", 2, "src/b.ts", 0, 1, 1, 0.8, "beta")]
    found = spark.createDataFrame(rows, "query_id string, position int, path string, ordinal int, start_line int, end_line int, score double, snippet string").withColumn("kinds", F.array(F.lit("keyword")))
    queries = spark.createDataFrame([("1", "alpha function"), ("2", "beta test"), ("3", "!")], "query_id string, query string")
    symbols = spark.createDataFrame([("src/alpha.ts", "alpha", 1)], "path string, name string, line int")
    degrees = spark.createDataFrame([("src/alpha.ts", 1, 3)], "path string, n_imports int, n_imported_by int")
    listed = [{"name": "off", "mode": "off"}, {"name": "default"}, {"name": "names", "weights": {"symbol": 3, "role": 0.0}}, {"name": "beside", "weights": {"counterpart": 1.5}}, {"name": "alone", "weights": {"counterpart": 0.0}}]
    got = retrieval.rerank_profiles(found, queries, chunks, symbols, degrees, retrieval.profiles(spark, listed), 4).collect()
    for p in listed:
        mine = sorted((r.query_id, r.position, r.path, r.rank_score) for r in got if r.profile == p["name"])
        if p.get("mode") == "off":
            want = sorted((r[0], r[1], r[2], r[6]) for r in rows)
        else:
            want = sorted((r.query_id, r.position, r.path, r.rank_score) for r in retrieval.rerank(found, queries, chunks, symbols, degrees, 4, p.get("weights")).collect())
        assert mine == want, p["name"]
        assert [m[1:] for m in mine if m[0] == "3"] == [(1, "src/b.spec.ts", 0.9), (2, "src/b.ts", 0.8)]  # no terms: as they came
    for wrong in ([{"name": " "}], [{"name": "a"}, {"name": "a"}], [{"name": "a", "mode": "on"}], [{"name": "a", "weights": {"size": 1}}], [{"name": "a", "weights": {"path": float("nan")}}], [{"name": "a", "weights": {"path": True}}]):
        with pytest.raises(ValueError):
            retrieval.profiles(spark, wrong)


def test_all_cases_at_once(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abA") for _ in range(rnd.randint(2, 5)))
    files = spark.createDataFrame([(f"f{i}", "\n".join(" ".join(word() for _ in range(rnd.randint(0, 6))) for _ in range(rnd.randint(0, 5)))) for i in range(60)] + [("none", None), ("empty", "")], "path string, text string")
    asked = [("1", "aba bab aab"), ("2", "aaaa"), ("3", "ab b"), ("4", " ".join(f"{a}{b}{c}a" for a in "ab" for b in "ab" for c in "abA")), ("5", "zzz aba")]
    got = {(r.case_id, r.path): (r.score, r.first_line) for r in lines.search_cases(files, spark.createDataFrame(asked, "case_id string, query string")).collect()}
    want = {}
    for c, q in asked:
        terms = spark.range(1).select(T.keyword_terms(F.lit(q)).alias("t")).first()["t"]
        want |= {(c, r.path): (r.score, r.first_line) for r in search.line_search(files, terms).collect()}
    assert got == want and len(got) > 50
    assert lines.search_cases(files, spark.createDataFrame([], "case_id string, query string")).count() == 0


def test_guards(spark):
    rows = spark.createDataFrame([("1", 1)], "query_id string, x int")
    for k in (0, -1):
        with pytest.raises(ValueError):
            retrieval.best(rows, ["x"], k)
        with pytest.raises(ValueError):
            index.embed(rows, index.length_provider(2), 2, k)


def test_files_that_hold_a_phrase_are_those_of_every_run_of_words(spark):
    rnd = random.Random(4)
    texts = {f"f{i}": "".join(rnd.choice("ab") + rnd.choice(["", rnd.choice("ab")]) + rnd.choice([" ", " ", "\n", "  "]) for _ in range(rnd.randint(0, 40))) for i in range(60)} | {"none": None, "empty": ""}
    phrases = [(f"p{i}", " ".join("".join(rnd.choice("ab") for _ in range(rnd.randint(1, 2))) for _ in range(3))) for i in range(30)] + [("short", "a b"), ("null", None), ("twin", "a a a"), ("blank", "a  b")]
    want = {(c, p) for c, w in phrases if w and len(w.split(" ")) == 3 for p, t in texts.items() for v in [(t or "").replace("\n", " ").split(" ")] if any(v[i : i + 3] == w.split(" ") for i in range(len(v)))}
    files = spark.createDataFrame(list(texts.items()), "path string, text string")
    got = lines.holding(files, spark.createDataFrame(phrases, "case_id string, words string"), 3).collect()
    assert sorted((r.case_id, r.path) for r in got) == sorted(want) and len(want) > 20


def test_a_batch_is_worked_off_in_bounded_pieces():
    texts = ["x" * n for n in (10, lines.MOST_BYTES // 2, lines.MOST_BYTES // 2 + 1, 3 * lines.MOST_BYTES, 0, 5)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    pieces = [b["text"].to_pylist() for b in lines.slices(batch, "text")]
    assert sum(pieces, []) == texts and [len(p) for p in pieces] == [2, 1, 1, 3]


def test_only_files_that_may_be_ranked_are_looked_at(spark):
    found = spark.createDataFrame([("q", "src/a.test.ts"), ("q", "docs/x.md"), ("r", "docs/x.md")], "query_id string, path string")
    got = [r.path for r in retrieval.candidate_paths(found).collect()]
    assert sorted(got) == sorted(["src/a.test.ts", "docs/x.md", *["src/a" + e for e in retrieval.EXTENSIONS]])
