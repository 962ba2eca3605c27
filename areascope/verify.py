"""Result comparison used by the oracle check and the tests: row count, column names and an
order-insensitive comparison of normalised values (dates vs midnight timestamps, float repr)."""

from __future__ import annotations

import datetime
import math

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def norm(v):
    if v is None or type(v).__name__ in ("NAType", "NaTType"):
        return None
    if isinstance(v, float):
        # a whole column of numbers with nulls is float in pandas: 9.0 is 9
        return "nan" if math.isnan(v) else str(int(v)) if v.is_integer() else repr(round(v, 9))
    if hasattr(v, "to_pydatetime"):
        v = v.to_pydatetime()
    if isinstance(v, datetime.datetime):
        return v.date().isoformat() if v.time() == datetime.time(0) else v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v)


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(norm(None if (isinstance(x, float) and math.isnan(x)) else x) for x in rec))
    return cols, sorted(out, key=repr)


def duckdb_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark_pdf, oracle_pdf) -> tuple[bool, str]:
    scols, srows = rows_of(spark_pdf)
    ocols, orows = rows_of(oracle_pdf)
    if scols != ocols:
        return False, f"columns differ: spark-only {sorted(set(scols) - set(ocols))} oracle-only {sorted(set(ocols) - set(scols))}"
    if len(srows) != len(orows):
        return False, f"row count {len(srows)} vs {len(orows)}"
    if srows != orows:
        oset = set(orows)
        diff = [r for r in srows if r not in oset][:2]
        return False, f"values differ, e.g. spark {diff}"
    return True, ""
