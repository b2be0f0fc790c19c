"""Every registered query of the engine against its SQL in DuckDB."""

import duckdb
import pytest

from quillon.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(frame, columns):
    def plain(v):
        if v is None or repr(v) in ("nan", "<NA>", "NaT"):
            return None
        v = v.item() if hasattr(v, "item") else v
        return round(v, 6) if isinstance(v, float) and not v.is_integer() else int(v) if isinstance(v, float) else v

    return sorted(repr(tuple(map(plain, r))) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = registry.queries()[name](spark, sf).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_entry_has_rows(spark):
    assert registry.entry(spark).count() > 0


def test_a_query_returns_tokens_beyond_the_first_20(spark, tmp_path):
    tail = lambda last: (1, " ".join(f"w{i}" for i in range(30)) + " " + last)
    got = []
    for last in ("one", "two"):
        spark.createDataFrame([tail(last)], "doc_id long, text string").write.parquet(f"{tmp_path}/{last}/documents.parquet")
        got.append(registry.queries()["extract_tokens"](spark, f"{tmp_path}/{last}").first())
    assert got[0]["n"] == got[1]["n"] == 31 and got[0]["digest"] != got[1]["digest"]


def test_page_queries_run_on_a_whole_page(spark, sf):
    assert registry.queries()["result_lines"](spark, sf).count() == 200
    assert registry.queries()["line_lookup"](spark, sf).select("relative_path").distinct().count() > 1


def test_searches_find_something(spark, sf):
    for name in ("find_exact_cs", "find_exact_ci", "stored_find_exact_cs", "stored_find_exact_ci", "stored_find_token_phrase", "find_in_results", "open_file_results"):
        assert registry.queries()[name](spark, sf).count() > 0, name
