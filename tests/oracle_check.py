"""Compare every registered query with its oracle SQL (run as a script, or through test_oracle.py)."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else ("num", repr(round(v, 9) + 0.0))
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, int):
        return ("num", repr(float(v)) if abs(v) < 2**53 else str(v))
    if type(v).__name__ == "Decimal":
        return ("num", repr(float(v)))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def difference(df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    names = sorted(df.columns)
    spark_rows = [tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in names]).collect()]
    cur = con.execute(sql)
    duck_names = [d[0] for d in cur.description]
    if sorted(duck_names) != names:
        return f"columns {names} vs {sorted(duck_names)}"
    at = [duck_names.index(c) for c in names]
    duck_rows = [tuple(plain(r[i]) for i in at) for r in cur.fetchall()]
    if len(spark_rows) != len(duck_rows):
        return f"{len(spark_rows)} rows vs {len(duck_rows)}"
    a, b = Counter(spark_rows), Counter(duck_rows)
    if a != b:
        x, y = list((a - b).elements()), list((b - a).elements())
        return f"{len(x)} rows differ, e.g.\n   columns {names}\n   spark {sorted(x, key=repr)[:2]}\n   sql   {sorted(y, key=repr)[:2]}"
    return None


def main() -> None:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from admitlens.session import local_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session()
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = []
    for name, make in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            df = make(spark, sf_dir)
            if name in oracle:
                problem = difference(df, con, oracle[name])
            else:
                problem = None if df.count() else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        n = "" if problem else f"{df.count() if len(wanted) < 8 and wanted else ''}"
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.time() - start:.1f}s {n} {problem or ''}", flush=True)
        if problem:
            bad.append(name)
    print("bad:", bad, "of", len(queries), "without sql:", sorted(set(queries) - set(oracle)))


if __name__ == "__main__":
    main()
