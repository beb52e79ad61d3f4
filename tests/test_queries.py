"""Every registered query of the flow operators against its DuckDB SQL."""

import pytest

from rillspark.queries import ORACLE_SQL, QUERIES
from tests.oracle import actual, expected

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    assert actual(QUERIES[name](spark, SF)) == expected(SF, ORACLE_SQL[name])


@pytest.mark.parametrize("texts", [[], [None, None], ["", None], ["é", None, "", "漢😀b", "abcdefghij" * 9]])
def test_base64_chunks_of_odd_texts(spark, tmp_path, texts):
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/made")
    next(tmp_path.glob("made/*.parquet")).rename(tmp_path / "documents.parquet")
    assert actual(QUERIES["base64_chunks"](spark, str(tmp_path))) == expected(tmp_path, ORACLE_SQL["base64_chunks"])


def test_base64_chunks_puts_no_texts_into_one_row(spark):
    plan = QUERIES["base64_chunks"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "listagg" not in plan


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry_without_the_llm_folder(spark, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "registry", None)
    monkeypatch.setattr(entry, "corpus_pipeline", None)
    assert set(entry.queries()) == set(QUERIES) and entry.oracle_sql() == ORACLE_SQL
    assert entry.entry(spark).count() > 0
