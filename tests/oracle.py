"""Compare registered queries with their SQL on DuckDB.

``python tests/oracle.py [folder] [query ...]`` prints one line per query.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return None
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float):
            return 0.0 if v == 0 else v
        return v
    return sorted((tuple(cell(v) for v in row) for row in df.itertuples(index=False)),
                  key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


def difference(spark_df: pd.DataFrame, duck_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(duck_df.columns):
        return f"columns {sorted(spark_df.columns)} / {sorted(duck_df.columns)}"
    a, b = normal(spark_df), normal(duck_df)
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} values differ, first {wrong[0]}" if wrong else None


def main() -> int:
    from harrow.session import build_session
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session("oracle", "local[8]", {
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con, failed = connect(sf), 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            got = run(spark, sf).toPandas()
            took = time.time() - started
            sql = entry.oracle_sql().get(name)
            if sql is None:
                verdict = f"rows only {len(got)}"
            else:
                rel = con.sql(sql)
                problem = difference(got, rel.df())
                verdict = f"ok {len(got)}" if problem is None else "WRONG " + problem
                failed += problem is not None
                ints = [c for c, t in zip(rel.columns, rel.types) if str(t) in ("HUGEINT", "DECIMAL")
                        or str(t).startswith("DECIMAL")]
                if ints:
                    verdict += f"  (types {ints})"
        except Exception as e:  # report and go on with the next query
            failed += 1
            took, verdict = time.time() - started, f"ERROR {type(e).__name__} {str(e)[:400]}"
        print(f"{name:28} {took:6.2f}s {verdict}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
