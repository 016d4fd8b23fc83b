"""Frames, and DuckDB beside Spark, for the text operators' tests."""

import math
import os

import duckdb
import pandas as pd

SMALL = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels conversations".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, name, sf_dir=SMALL):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_frame(spark, rows):
    """documents-like rows from (doc_id, text[, lang[, source]]) tuples."""
    full = []
    for r in rows:
        i, t, lang, source = (*r, *("en", "s")[len(r) - 2:])
        full.append((i, t, lang, source, None if t is None else len(t)))
    return spark.createDataFrame(full, DOCS).repartition(3)


def _plain(v):
    v = v.item() if hasattr(v, "item") else v
    if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 9) if isinstance(v, int | float) and not isinstance(v, bool) else v


def same_as_sql(df, sql, sf_dir=SMALL, **tables):
    """Whether a frame has the rows that DuckDB gets over the given tables."""
    con = duckdb.connect()
    for t in TABLES:
        if t not in tables and os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, frame in tables.items():
        con.register(name, frame)
    want = con.execute(sql).df()
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    rows = [sorted((tuple(map(_plain, r)) for r in x), key=repr) for x in (
        df.select(*cols).toPandas().astype(object).itertuples(index=False, name=None),
        want[cols].astype(object).itertuples(index=False, name=None))]
    assert rows[0] == rows[1]
