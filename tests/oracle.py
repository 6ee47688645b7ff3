"""Run the registered queries next to their SQL: python tests/oracle.py [folder] [name …]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connection(folder: str):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return db


def _key(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value + 0.0:.12g}"
    if isinstance(value, int):
        return f"{float(value):.12g}" if abs(value) < 2**53 else str(value)
    return str(value)


def _rows(table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return names, sorted(tuple(map(_key, row)) for row in zip(*columns))


def compare(spark, db, query, sql, folder):
    ours = query(spark, folder).toArrow()
    theirs = db.sql(sql).to_arrow_table()
    names, got = _rows(ours)
    other, want = _rows(theirs)
    if names != other:
        return f"columns {names} against {other}"
    kinds = [(n, str(ours.schema.field(n).type), str(theirs.schema.field(n).type)) for n in names]
    loose = [k for k in kinds if k[1] != k[2]]
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    wrong = [(a, b) for a, b in zip(got, want) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(got)} rows differ, as {wrong[0]}"
    if not got:
        return "no rows"
    return f"types {loose}" if loose else None


def main(folder="/root/testdata/sf0.01", *only):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from __spark_entry__ import oracle_sql, queries
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    db, sql, bad = connection(folder), oracle_sql(), 0
    for name, query in queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.time()
        try:
            if name in sql:
                found = compare(spark, db, query, sql[name], folder)
            else:
                found = f"no SQL, {query(spark, folder).count()} rows"
        except Exception as failed:  # noqa: BLE001 - reported, and the rest still runs
            found = f"{type(failed).__name__}: {str(failed)[:600]}"
        bad += bool(found)
        print(f"{name:32} {time.time() - start:6.2f}s  {found or 'ok'}", flush=True)
    print(f"{bad} to look at")


if __name__ == "__main__":
    main(*sys.argv[1:])
