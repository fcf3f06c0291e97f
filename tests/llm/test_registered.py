"""The registered queries against their SQL, the native rule, and the pipeline."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm.queries import ORACLE_SQL, QUERIES


def normal(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("NULL" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = QUERIES[name](spark, sf_dir).toPandas()
    wanted = con.execute(ORACLE_SQL[name]).df()
    as_float = {c: float for c in ("first_word", "last_word", "score") if c in wanted}
    assert normal(found.astype(as_float)) == normal(wanted.astype(as_float))


def test_names_follow_the_numbers():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 11)]


@pytest.mark.parametrize("name", ["op6_license_scan", "op7_kd_sharding"])
def test_native_plans(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = set(docs.columns)
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        last = k == len(corpus_pipeline.STAGES) - 1
        assert last or set(out.columns) == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        assert docs.select("doc_id").distinct().count() == counts[-1]
    assert counts[0] >= counts[1] == counts[2] >= counts[3] == counts[4] > 0


def test_pipeline_run_equals_its_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"} <= set(out.columns)
    assert out.filter(F.size("ids") != F.col("n_tokens")).count() == 0


def test_pipeline_on_an_empty_table_and_nulls(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, "s", 0), (2, "x y", "en", None, None)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        stage(spark, odd, sf_dir).collect()
