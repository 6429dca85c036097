"""Run registered queries against their SQL counterparts: ``check_oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from jobcast.checks import ORACLES, QUERIES  # noqa: E402
from jobcast.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = []
    for row in df[cols].itertuples(index=False):
        cells = []
        for v in row:
            if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
                cells.append("null")
            elif isinstance(v, bool) or type(v).__name__ == "bool_":
                cells.append(str(bool(v)))
            elif hasattr(v, "isoformat"):
                cells.append(pd.Timestamp(v).isoformat())
            elif isinstance(v, str):
                cells.append("'" + v)
            else:
                cells.append(repr(float(v) + 0.0))
        out.append(tuple(cells))
    return sorted(out)


def compare(spark, con, name: str, sf_dir: str) -> str:
    started = time.time()
    mine = QUERIES[name](spark, sf_dir).toPandas()
    took = time.time() - started
    if name not in ORACLES:
        return f"rows-only {len(mine):7d} rows {took:6.1f}s"
    other = con.execute(ORACLES[name]).df()
    if sorted(mine.columns) != sorted(other.columns):
        return f"COLUMNS {sorted(mine.columns)} / {sorted(other.columns)}"
    a, b = canonical(mine), canonical(other)
    if a == b and len(a) > 0:
        kinds = [c for c in mine.columns if mine[c].dtype != other[c].dtype]
        note = " types " + ", ".join(f"{c}:{mine[c].dtype}/{other[c].dtype}" for c in kinds) if kinds else ""
        return f"ok {len(mine):7d} rows {took:6.1f}s{note}"
    left, right = set(a) - set(b), set(b) - set(a)
    return (f"MISMATCH rows {len(a)}/{len(b)} differing {len(left)}/{len(right)}\n"
            f"   spark {sorted(left)[:2]}\n   sql   {sorted(right)[:2]}\n   columns {sorted(mine.columns)}")


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = local_session(8)
    if os.environ.get("CHECK_ZONE"):
        spark.conf.set("spark.sql.session.timeZone", os.environ["CHECK_ZONE"])
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in args or list(QUERIES):
        try:
            text = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            text = "ERROR " + str(error)[:700]
        bad += not text.startswith(("ok", "rows-only"))
        print(f"{name:28s} {text}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
