"""Hold queries against their SQL in DuckDB: python tests/oracle_check.py SF_DIR [NAME...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def tidy(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows(columns: list[str], found) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(tidy(r[i]) for i in order) for r in found), key=repr)


def compare(spark, c, name: str, query, sql: str, sf_dir: str) -> str:
    df = query(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = c.execute(sql)
    theirs = rows([d[0] for d in cursor.description], cursor.fetchall())
    if mine == theirs:
        return ""
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} {theirs[0]}"
    odd = [(a, b) for a, b in zip(mine[1], theirs[1], strict=False) if a != b][:2]
    return f"{len(mine[1])} and {len(theirs[1])} rows; {odd}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "3g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf, *names = sys.argv[1:]
    c, queries, sql = connect(sf), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or sql:
        t = time.time()
        try:
            said = compare(spark, c, name, queries[name], sql[name], sf)
        except Exception as e:
            said = str(e)[:700]
        bad += bool(said)
        print(name, "ok" if not said else f"DIFFERS {said[:900]}", f"{time.time() - t:.1f}", flush=True)
    print("bad", bad)
