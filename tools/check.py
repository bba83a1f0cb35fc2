"""Compare registered queries with their check SQL in DuckDB.

    python tools/check.py [--sf 0.01] [query ...]
"""

from __future__ import annotations

import argparse
import glob
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

import duckdb
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if glob.glob(path):
            con.execute(f"create view {t} as select * from read_parquet('{path}')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr), [columns[i] for i in order]


def compare(spark, con, name, fn, sql, sf_dir) -> tuple[bool, str]:
    t = time.time()
    df = fn(spark, sf_dir)
    got, gc = rows_of(df.columns, [tuple(x) for x in df.collect()])
    took = time.time() - t
    if sql is None:
        return True, f"rows={len(got)} {took:.1f}s (rows only)"
    res = con.execute(sql)
    want, wc = rows_of([d[0] for d in res.description], res.fetchall())
    if gc != wc:
        return False, f"columns differ: {gc} / {wc}"
    if got == want:
        kinds = []
        for i, c in enumerate(gc):
            a = {type(x[i]).__name__ for x in got if x[i] is not None}
            b = {type(x[i]).__name__ for x in want if x[i] is not None}
            if a != b:
                kinds.append(f"{c}:{a}/{b}")
        return not kinds, f"rows={len(got)} {took:.1f}s {' '.join(kinds)}"
    gs, ws = set(map(repr, got)), set(map(repr, want))
    a, b = sorted(gs - ws)[:2], sorted(ws - gs)[:2]
    return False, f"rows={len(got)}/{len(want)} differ={len(gs - ws)} {took:.1f}s\n   {gc}\n   spark {a}\n   sql   {b}"


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from fairlead.catalog import ORACLES, QUERIES
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark, con, bad = session(), duck(sf_dir), []
    for name in args.names or QUERIES:
        try:
            ok, text = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            ok, text = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print("ok " if ok else "BAD", name, text, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} bad: {bad}")


if __name__ == "__main__":
    main()
