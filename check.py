"""Run registered queries against their SQL and report differences: check.py [sf] [name part ...]."""

from __future__ import annotations

import importlib
import sys
import time

import duckdb

from proofspark.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    if sql is None:
        return len(got), None, df
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    want = normal(cur.fetchall(), columns)
    if sorted(df.columns) != sorted(columns):
        return len(got), f"columns {sorted(df.columns)} / {sorted(columns)}", df
    if [list(map(repr, r)) for r in got] != [list(map(repr, r)) for r in want]:
        g, w = set(map(repr, got)), set(map(repr, want))
        return len(got), f"rows {len(got)}/{len(want)} only spark {sorted(g - w)[:3]} only sql {sorted(w - g)[:3]}", df
    return len(got), "", df


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.001"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/{sf}"
    spark, con = local_session(8), connect(sf_dir)
    mods = [w[4:] for w in wanted if w.startswith("mod:")]
    names = [w for w in wanted if not w.startswith("mod:")]
    from proofspark import catalog
    for mod in mods or catalog.MODULES:
        m = importlib.import_module(f"proofspark.catalog.{mod}")
        for name, query in m.QUERIES.items():
            if names and not any(w in name for w in names):
                continue
            t = time.time()
            try:
                n, bad, _ = compare(spark, con, sf_dir, query, m.ORACLES.get(name))
                word = "rows-only" if bad is None else "ok" if bad == "" else "DIFF " + bad[:700]
            except Exception as e:  # noqa: BLE001
                n, word = -1, "ERROR " + str(e)[:900]
            print(f"{name:28s} {n:7d} {time.time() - t:6.2f}s {word}", flush=True)


if __name__ == "__main__":
    main()
