"""Run queries next to their SQL and report differences."""

from __future__ import annotations

import datetime
import decimal
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def normalized(rows: list[dict]) -> list[tuple]:
    return sorted((tuple((k, plain(r[k])) for k in sorted(r)) for r in rows), key=repr)


def compare(spark, con, query, sql: str, sf_dir: str) -> tuple[bool, str]:
    df = query(spark, sf_dir)
    started = time.time()
    left = normalized([r.asDict() for r in df.collect()])
    spent = time.time() - started
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    right = normalized([dict(zip(names, r)) for r in cursor.fetchall()])
    if left == right:
        return True, f"{len(left)} rows, spark {spent:.1f}s, all {time.time() - started:.1f}s"
    gone = [r for r in left if r not in set(right)][:2]
    extra = [r for r in right if r not in set(left)][:2]
    return False, f"rows {len(left)} / {len(right)}\n   spark only {gone}\n   sql only   {extra}"


def main() -> None:
    from checks.oracle import ORACLE
    from checks.queries import QUERIES
    from rolecast.session import build_session

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        "checks", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name in names:
        if name not in ORACLE:
            print(name, "no SQL", flush=True)
            continue
        try:
            ok, note = compare(spark, con, QUERIES[name], ORACLE[name], sf_dir)
            print(name, "ok" if ok else "DIFFERENT", note, flush=True)
        except Exception as error:  # report and go on with the next query
            print(name, "FAILED", str(error)[:600], flush=True)


if __name__ == "__main__":
    main()
