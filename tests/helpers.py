"""What the tests share."""

import glob
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def rows(df):
    """Rows as comparable strings, columns by name."""
    cols = sorted(df.columns)
    values = df[cols].astype(object).where(df[cols].notna(), None).values.tolist()
    return cols, sorted(map(repr, values))


def oracle(sql, sf_dir=DATA):
    db = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return db.sql(sql).df()
