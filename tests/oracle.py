"""Compare queries with their DuckDB SQL: python tests/oracle.py SF_DIR [NAME...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def normal(v):
    import math
    from datetime import datetime

    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), normal(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return normal(v.asDict())
    return v


def compare(spark, sf_dir: str, name: str, query, sql: str | None) -> str:
    """'' if both agree, else what differs."""
    import duckdb

    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    mine = sorted((tuple(normal(r[c]) for c in cols) for r in df.collect()), key=repr)
    if sql is None:
        return f"(no SQL) {len(mine)} rows"
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    order = [names.index(c) for c in cols]
    theirs = sorted((tuple(normal(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    if mine == theirs:
        return ""
    a, b = [x for x in mine if x not in theirs[:5000]][:2], [x for x in theirs if x not in mine[:5000]][:2]
    return f"{len(mine)} rows and {len(theirs)}: {a} / {b}"


if __name__ == "__main__":
    import __spark_entry__ as e
    from keyreel.session import local_session

    spark, qs, sqls = local_session(8), e.queries(), e.oracle_sql()
    for n in sys.argv[2:] or qs:
        t = time.time()
        try:
            said = compare(spark, sys.argv[1], n, qs[n], sqls.get(n))
        except Exception as x:  # noqa: BLE001
            said = f"ERROR {type(x).__name__}: {str(x)[:600]}"
        print(f"{n}: {said or 'same'} {time.time() - t:.1f} s", flush=True)
