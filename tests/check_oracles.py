"""Run registered queries next to their SQL in DuckDB and compare the rows.

    python tests/check_oracles.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import pathlib
import sys
import time

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

import duckdb  # noqa: E402

from tidemark.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if value is None or isinstance(value, (int, str, bool)):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return float(value)


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def compare(spark_df, sql: str, con) -> str:
    got_names, got = sorted_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_names, want = sorted_rows([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    got, want = sorted(got, key=str), sorted(want, key=str)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else ""


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry

    folder = f"/root/testdata/sf{args.sf}"
    conf = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    spark = build_session("oracles", "local[8]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = connect(folder), entry.queries(), entry.oracle_sql()
    failed = 0
    wanted = [n for n in queries if not args.names or any(n.startswith(a) for a in args.names)]
    for name in wanted:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            verdict = compare(df, oracles[name], con) if name in oracles else f"(no SQL) {len(df.collect())} rows"
        except Exception as error:  # noqa: BLE001
            verdict = f"{type(error).__name__}: {str(error)[:700]}"
        ok = verdict == "" or verdict.startswith("(no SQL)")
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {verdict}", flush=True)
    print(f"{len(wanted) - failed} of {len(wanted)} good")
    return int(failed > 0)


if __name__ == "__main__":
    raise SystemExit(main())
