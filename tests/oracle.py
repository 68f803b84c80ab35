"""Run registered queries in Spark and their SQL in DuckDB, and compare whole results."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
TESTDATA = os.environ.get("COHORTIS_TESTDATA", "/root/testdata")


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None:
        return "~null"
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows), key=lambda t: tuple(map(str, t))
    )


def _family(kind: str) -> str:
    kind = kind.lower()
    for k, v in {"bigint": "bigint", "long": "bigint", "int": "int", "double": "double", "string": "string",
                 "varchar": "string"}.items():
        if kind.startswith(k):
            return v
    return kind


def compare(name, df, con, sql) -> list[str]:
    """Differences between a Spark result and a SQL result (empty when equal)."""
    problems = []
    rel = con.sql(sql)
    spark_types = {n: _family(t) for n, t in df.dtypes}
    duck_types = {n: _family(str(t)) for n, t in zip(rel.columns, rel.types)}
    if spark_types != duck_types:
        problems.append(f"{name}: types {sorted(set(spark_types.items()) ^ set(duck_types.items()))}")
    left = _rows(df.columns, [tuple(row) for row in df.collect()])
    right = _rows(rel.columns, rel.fetchall())
    if left[0] != right[0]:
        return problems + [f"{name}: columns {left[0]} vs {right[0]}"]
    if len(left[1]) != len(right[1]):
        problems.append(f"{name}: {len(left[1])} rows vs {len(right[1])}")
    bad = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    if bad:
        problems.append(f"{name}: {len(bad)} rows differ, first {bad[0]}")
    return problems


def main():
    from __spark_entry__ import oracle_sql, queries
    from cohortis.session import local_session

    sf_dir = f"{TESTDATA}/{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark, con = local_session("oracle", 8), connect(sf_dir)
    all_queries, sqls = queries(), oracle_sql()
    failed = 0
    for name in [n for n in all_queries if not wanted or any(n.startswith(w) for w in wanted)]:
        start = time.time()
        try:
            df = all_queries[name](spark, sf_dir)
            if name in sqls:
                problems = compare(name, df, con, sqls[name])
            else:
                problems = [] if df.count() else [f"{name}: no rows"]
        except Exception as e:  # noqa: BLE001
            problems = [f"{name}: {type(e).__name__} {str(e)[:600]}"]
        failed += bool(problems)
        print(f"{'BAD' if problems else 'ok '} {name} {time.time() - start:.1f}s", *problems, sep="\n   " if problems else " ",
              flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
