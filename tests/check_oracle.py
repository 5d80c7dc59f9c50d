"""Run the registered queries next to their SQL in DuckDB and report the ones that differ.

    python tests/check_oracle.py [folder] [query ...]
"""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder):
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for name in TABLES:
        db.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return db


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        return repr(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else repr(v)

    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, db, folder, name, query, sql):
    """None if equal, else a short text saying how they differ."""
    df = query(spark, folder)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(sql)
    want = canonical([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        here, there = set(got[1]), set(want[1])
        extra, missing = [r for r in got[1] if r not in there][:2], [r for r in want[1] if r not in here][:2]
        return f"{len(got[1])} rows != {len(want[1])} rows; only here {extra}; only in SQL {missing}"
    return None


def main(folder="/root/testdata/sf0.01", *only):
    import __spark_entry__ as entry
    from turnstile.session import build_session
    spark = build_session("local[8]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                          spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    db, sql, bad = connect(folder), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        began = time.time()
        problem = compare(spark, db, folder, name, query, sql[name])
        bad += problem is not None
        print(f"{name:32} {time.time() - began:6.2f}s {problem or 'ok'}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
