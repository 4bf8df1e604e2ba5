"""Small tables for the operators' tests."""

CLASHING = ("size", "unit", "key", "digest", "at", "bin", "v", "label", "tag", "id")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def documents(spark, rows):
    """(doc_id, text[, lang[, source]]) rows with extra columns whose names clash with inner ones."""
    full = [(*r, *[None] * (4 - len(r)))[:4] for r in rows]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *["x"] * len(CLASHING)) for r in full], SCHEMA)


def real(name, sf="sf0.001"):
    """Rows of a given table, by DuckDB."""
    import duckdb

    con = duckdb.connect()
    return con.execute(f"SELECT * FROM '/root/testdata/{sf}/{name}.parquet'").fetchall()
