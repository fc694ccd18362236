"""Compare registered queries with their SQL counterparts: python tests/compare.py [sf_dir] [query…]"""

from __future__ import annotations

import collections
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], collections.Counter(tuple(r[i] for i in order) for r in rows)


def compare(spark, con, sf_dir: str, query, sql: str) -> str | None:
    """None when equal, else what differs."""
    df = query(spark, sf_dir)
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    theirs = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if ours[1] != theirs[1]:
        extra, missing = ours[1] - theirs[1], theirs[1] - ours[1]
        show = lambda c: [str(r)[:400] for r in list(c)[:3]]
        return f"{sum(extra.values())} extra {show(extra)} {sum(missing.values())} missing {show(missing)}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from tests.conftest import make_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = make_session(), connect(sf_dir)
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if name not in oracles or (len(sys.argv) > 2 and name not in sys.argv[2:]):
            continue
        begin = time.time()
        try:
            problem = compare(spark, con, sf_dir, query, oracles[name])
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print("ok  " if problem is None else "FAIL", name, round(time.time() - begin, 1), problem or "", flush=True)


if __name__ == "__main__":
    main()
