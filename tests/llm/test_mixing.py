from __future__ import annotations

import random

import compare
import duckdb
import pytest
from pyspark.sql import functions as F

from skumetry.llm import mixing, queries

SCHEMA = "doc_id long, text string, lang string, source string, epoch string, domain string"


def corpus():
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["en", "en", "en", "de", "fr", "xx", None]), rng.choice(["src0"] * 9 + ["src1", "src2", "src7", "odd", "", None]), "e", "d") for i in range(600)]
    rows += [(700, None, "en", "src0", None, None), (701, "", "en", "src9", None, None), (None, "a b c", "en", "src0", "e", "d")]
    return rows + rows[:5]


@pytest.mark.parametrize("leaves", [mixing.BROADCAST_LEAVES, 0])
def test_mix_equals_sql(spark, tmp_path, monkeypatch, leaves):
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", leaves)
    monkeypatch.setattr(mixing, "RANGE_DOCUMENTS", 20)
    spark.createDataFrame(corpus(), SCHEMA).select("doc_id", "text", "lang", "source").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op3_hierarchical_mix(spark, str(tmp_path)).collect()), key=str)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    expected = duck.execute(queries.oracle_sql()["op3_hierarchical_mix"]).fetchall()
    assert got == sorted(map(tuple, expected), key=str)


def test_extra_columns_stay_and_empty_tables_pass(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    mix = mixing.mix_sources(docs)
    assert mix.columns == ["doc_id", "text", "lang", "source", "domain", "epoch"]
    assert mix.where("domain = 'd'").count() > 0 and mix.where("text is null or text = ''").count() == 0
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def brute_share(budget, children):
    """Water filling by repeated sharing: fill whoever takes less than its share, share the rest anew."""
    full = set()
    while True:
        rest = budget - sum(children[c][1] for c in full)
        weight = sum(children[c][0] for c in children if c not in full)
        more = {c for c in children if c not in full and children[c][1] * weight <= children[c][0] * rest}
        if not more:
            return {c: children[c][1] if c in full else children[c][0] * rest // weight for c in children}
        full |= more


def test_sharing(spark):
    rng = random.Random(8)
    for _ in range(3):
        families = {p: (rng.randint(0, 3000), {f"c{i}": (rng.randint(1, 9), rng.randint(1, 900)) for i in range(rng.randint(1, 9))}) for p in range(8)}
        rows = [(p, c, w, cap, b) for p, (b, children) in families.items() for c, (w, cap) in children.items()]
        df = spark.createDataFrame(rows, "p int, c string, weight int, capacity long, budget long")
        df = df.withColumn("weight", F.col("weight").cast("decimal(38,0)")).withColumn("capacity", F.col("capacity").cast("decimal(38,0)"))
        got = {(r.p, r.c): r.target for r in mixing.share_out(df, ["p"], "c").collect()}
        assert got == {(p, c): t for p, (b, children) in families.items() for c, t in brute_share(b, children).items()}


def test_query_matches_duckdb_on_the_test_tables(spark):
    folder = "/root/testdata/sf0.001"
    result = queries.op3_hierarchical_mix(spark, folder)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    assert compare.differences(result, duck, queries.oracle_sql()["op3_hierarchical_mix"]) == []
