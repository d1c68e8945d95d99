import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def test_keyword_terms(spark):
    assert one(spark, T.keyword_terms(F.lit("find processPayment() in payment-service.ts"))) == ["find", "processPayment", "in", "payment-service.ts"]
    assert one(spark, T.keyword_terms(F.lit("a"))) == []


def test_identifiers(spark):
    assert one(spark, T.split_identifier(F.lit("getUserName_v2"))) == ["get", "user", "name", "v2"]
    assert one(spark, T.query_terms(F.lit("processPayment now"))) == ["processpayment", "process", "payment", "now"]


def test_grep_keywords(spark):
    got = one(spark, T.grep_keywords(F.lit("find processPayment logging"), F.lit("src/payment-service.ts")))
    assert got == ["find", "processPayment", "logging", "src", "payment", "service"]


def test_match_reason(spark):
    got = one(spark, T.match_reason(F.array(F.lit("semantic")), F.lit(0.123456), F.lit(None).cast("double")))
    assert got.endswith("0.1235")


@pytest.mark.parametrize("path, role", [("src/a.test.ts", "test"), ("src/__mocks__/a.ts", "mock"), ("src/fixtures/a.ts", "fixture"), ("src/generated/a.ts", "generated"), ("README.md", "docs"), ("src/a.ts", "source")])
def test_roles(spark, path, role):
    assert one(spark, T.classify_path(F.lit(path))) == role
    assert one(spark, T.role_priority(F.lit(role))) == T.ROLES.index(role)


def test_snippets(spark):
    assert one(spark, T.compact_snippet(F.lit("abc  \n"), 5)) == "abc"
    assert one(spark, T.compact_snippet(F.lit("abcdefgh"), 6)) == "abc..."
    assert one(spark, T.fit_budget(F.lit("a" * 30), F.lit(20))) == "aaaa\n... [truncated]"
    assert one(spark, T.fit_budget(F.lit("a" * 30), F.lit(15))) == "... [truncated]"
    assert one(spark, T.fit_budget(F.lit("a" * 30), F.lit(3))) == ""
    assert one(spark, T.estimate_tokens(F.lit(5))) == 2


@pytest.mark.parametrize("text, term, n", [("aaaa", "aa", 3), ("abcabc", "abc", 2), ("a.a.a", "a.a", 2), ("", "abc", 0)])
def test_occurrences(spark, text, term, n):
    assert one(spark, T.occurrences(F.lit(text), term)) == n
    assert one(spark, T.occurrences(F.lit(text), F.lit(term))) == n


def test_vectors(spark):
    assert one(spark, T.valid_vector(F.array(F.lit(1.0), F.lit(2.0)), 2)) is True
    assert one(spark, T.valid_vector(F.array(F.lit(1.0), F.lit(float("nan"))), 2)) is False
    assert one(spark, T.valid_vector(F.array(F.lit(1.0)), 2)) is False
