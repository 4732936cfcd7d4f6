"""Run every query in Spark and its SQL in DuckDB and compare columns, types and rows.

``python tests/parity.py [sf_dir] [query ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def session() -> SparkSession:
    scratch = tempfile.mkdtemp(prefix="parity-")
    spark = (SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '8')}]")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", f"{scratch}/checkpoint")
             .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
             .config("spark.driver.memory", "8g")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def _plain(rows):
    return sorted((tuple(
        float(v) if isinstance(v, float) and not math.isnan(v) else v for v in row)
        for row in rows), key=_key)


SPARK_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
               "timestamp": "TIMESTAMP", "boolean": "BOOLEAN", "float": "FLOAT", "timestamp_ntz": "TIMESTAMP"}


def compare(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Differences between a Spark result and a SQL result; empty if there are none."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    problems = [f"type of {c}: {SPARK_TYPES.get(t, t)} != {kinds[c]}" for c, t in df.dtypes
                if SPARK_TYPES.get(t, t) not in kinds[c]]
    actual = _plain(tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect())
    expected = _plain(expected)
    if len(actual) != len(expected):
        problems.append(f"{len(actual)} rows != {len(expected)}")
    wrong = [(a, e) for a, e in zip(actual, expected) if a != e]
    if wrong:
        first = " != ".join(str(row)[:300] for row in wrong[0])
        problems.append(f"{len(wrong)} rows differ, first {first}")
    return problems


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = session(), oracle(sf_dir)
    sqls, failed = contract.oracle_sql(), 0
    for name, run in contract.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            problems = compare(df, con, sqls[name]) if name in sqls else []
            size = "" if name in sqls else f"rows only: {len(df.collect())}"
        except Exception as error:  # noqa: BLE001
            problems, size = [f"{type(error).__name__}: {str(error)[:800]}"], ""
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok':4} {name} {time.time() - start:.2f}s {size}",
              *problems, sep="\n       " if problems else " ", flush=True)
    print(f"{failed} failed")
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
