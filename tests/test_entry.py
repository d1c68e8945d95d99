import os
import random

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone.jobs import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cells(frame):
    show = lambda x: repr(round(x, 6)) if isinstance(x, float) else repr(x)
    cols = sorted(frame.columns)
    return cols, sorted(tuple(map(show, r)) for r in frame[cols].astype(object).where(frame[cols].notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, duck, name):
    assert cells(registry.QUERIES[name](spark, SF).toPandas()) == cells(duck.sql(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", ["keyword_chunks", "hybrid_chunks", "rerank_chunks"])
def test_terms_that_overlap_themselves_match_sql(spark, tmp_path, name):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("nai") for _ in range(rnd.randint(2, 6)))
    docs = [(i, " ".join(word() for _ in range(rnd.randint(5, 40))), rnd.choice(["en", "fr"])) for i in range(120)]
    items = [(i, f"{x} nothing{i} elsewhere{i} ever{i} {word()}") for i, x in enumerate(["ana", "nan", "inin", "aaa", "naana", "iaia"])]
    con = duckdb.connect()
    for t, rows, schema in (("documents", docs, "doc_id long, text string, lang string"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert cells(registry.QUERIES[name](spark, str(tmp_path)).toPandas()) == cells(con.sql(registry.ORACLES[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
