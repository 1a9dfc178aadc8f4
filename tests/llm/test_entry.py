"""The registered queries on the small tables, and the pipeline against its parts."""

import os

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from folio.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracles(spark, tables, name):
    got = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = tables.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want, key=str)


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]
    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLES])
def test_one_row_a_document(spark, name):
    got = __spark_entry__.queries()[name](spark, SF)
    whole = spark.read.parquet(f"{SF}/{'pages' if name.startswith('op4') else 'documents'}.parquet").count()
    if name.startswith(("op8", "op10")):
        assert got.count() > 0
    else:
        assert got.count() == whole


def test_pipeline_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(str(tmp_path / f"{k}{name}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}{name}"))
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    run = {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()}
    assert run == {r.doc_id for r in docs.select("doc_id").collect()}


ODD = [(1, None), (2, ""), (2, ""), (3, " \n"), (4, "some words here " * 20), (4, "some words here " * 20), (None, "some words  here " * 20), (None, None)]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(make, spark, tmp_path, name):
    spark.createDataFrame([(4, 1, 0), (None, None, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage, df = dict(corpus_pipeline.STAGES)[name], make(ODD)
    done = stage(spark, df, str(tmp_path))
    kept = sorted((str(r.doc_id) for r in done.collect()))
    if name in ("exact_copies", "near_copies"):
        assert len(kept) == {"exact_copies": 2, "near_copies": 3}[name] and done.columns == df.columns
    elif name == "packed":
        assert set(kept) == {"1", "2", "3", "4", "None"}
    else:
        assert len(kept) == len(ODD) and done.columns == df.columns
    assert stage(spark, make([]), str(tmp_path)).count() == 0
