"""Every registered query with SQL gives DuckDB's rows; the others run and have stable columns."""

import pytest

from millrace.plans import registered

SQL = registered.oracle_sql()


def rounded(v):
    return round(v, 6) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query(name, spark, duck, sf_dir):
    df = registered.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(rounded(r[c]) for c in columns) for r in df.collect())
    if name in SQL:
        want = duck.sql(SQL[name])
        at = [want.columns.index(c) for c in columns]
        assert sorted(want.columns) == columns
        assert got == sorted(tuple(rounded(r[i]) for i in at) for r in want.fetchall())
    else:
        assert got


ODD = ["", " ", "\n", ".\n", "one.\ntwo.\n\nthree", "a b, c! (d)", "...", "7" * 1024 + "!" * 1024, "x.\n.\n", "naïve 中文 ß", None]


def same_as_sql(name, spark, folder, texts):
    import duckdb

    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    df = registered.queries()[name](spark, str(folder))
    want = con.sql(SQL[name])
    # NaN equals itself as a string only, and is not null
    shown = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert shown(df.select(*want.columns).collect()) == shown(want.fetchall())
    return df.count()


@pytest.mark.parametrize("name", ["ext_alnum_ratio", "ext_special_ratio", "ext_special_ratio_filter"])
def test_shares_of_empty_texts(name, spark, tmp_path):
    """F3 to F5: an empty text has no share, where it had 0 and was kept by the filter."""
    assert same_as_sql(name, spark, tmp_path, ODD) == (7 if name.endswith("filter") else len(ODD))


def test_sections_of_empty_texts(spark, tmp_path):
    """an empty or blank text is one section, where it had none."""
    assert same_as_sql("chunk_sections", spark, tmp_path, ODD) == 15
