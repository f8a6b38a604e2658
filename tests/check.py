"""Runs registered queries against their SQL: python tests/check.py [sf] [name prefix ...]."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)) and not hasattr(value, "asDict"):
        return [plain(v) for v in value]
    if hasattr(value, "asDict"):
        return [plain(v) for v in value.asDict().values()]
    if isinstance(value, dict):
        return [plain(v) for v in value.values()]
    return str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=str)


def compare(spark, connection, sf_dir, name, query, sql):
    start = time.time()
    df = query(spark, sf_dir)
    mine = df.collect()
    took = time.time() - start
    if sql is None:
        return len(mine) > 0, f"{len(mine)} rows, no SQL", took
    relation = connection.sql(sql)
    theirs = relation.fetchall()
    if sorted(df.columns) != sorted(relation.columns):
        return False, f"columns {sorted(df.columns)} / {sorted(relation.columns)}", took
    a, b = rows(df.columns, mine), rows(relation.columns, theirs)
    if a == b:
        return True, f"{len(a)} rows", took
    only_a = [r for r in a if r not in b][:2] if len(a) < 20000 else a[:1]
    only_b = [r for r in b if r not in a][:2] if len(b) < 20000 else b[:1]
    return False, f"{len(a)} / {len(b)} rows\n   spark {sorted(df.columns)} {only_a}\n   sql   {only_b}", took


def connect(sf_dir):
    import duckdb
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from saccade.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:]) or ("",)
    session = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                  "spark.driver.memory": "12g"})
    session.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/sf{sf}"
    duck, oracles, bad = connect(folder), oracle_sql(), []
    for key, function in queries().items():
        if not key.startswith(prefixes):
            continue
        try:
            good, text, seconds = compare(session, duck, folder, key, function, oracles.get(key))
        except Exception as error:  # noqa: BLE001
            good, text, seconds = False, f"{type(error).__name__}: {str(error)[:1500]}", 0.0
        print(f"{'ok  ' if good else 'FAIL'} {key:32s} {seconds:6.1f}s {text}", flush=True)
        if not good:
            bad.append(key)
    print("failed:", bad)
