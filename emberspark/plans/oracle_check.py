"""Compare a Spark result with its SQL twin run by DuckDB (tests and tools)."""

from __future__ import annotations

import math
import os
import re

from ..sources.tables import DRIVER_TABLES, table_path


def connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        p = table_path(sf_dir, t)
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    # Exact: per-row arithmetic is written in the same operation order on
    # both sides and every float aggregate is rounded, so doubles agree bit
    # for bit (checked at sf0.01 and sf0.001).
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def canonical(cols, rows):
    """Rows as a sorted multiset with columns ordered by name."""
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def run_both(spark, con, builder, sql: str, sf_dir: str):
    df = builder(spark, sf_dir)
    rows, cols = df.collect(), df.columns
    cur = con.execute(sql)
    ocols = [c[0] for c in cur.description]
    return (cols, rows), (ocols, cur.fetchall())


def same(a, b) -> bool:
    (cols, rows), (ocols, orows) = a, b
    return sorted(cols) == sorted(ocols) and canonical(cols, rows) == canonical(ocols, orows)


def in_order(sql: str) -> bool:
    """Whether the result of a query comes in a stated order."""
    return re.search(r"ORDER BY [^()]*$", sql) is not None


def same_order(a, b) -> bool:
    """Equal rows at equal places (columns by name)."""
    (cols, rows), (ocols, orows) = a, b

    def listed(names, values):
        order = sorted(range(len(names)), key=lambda i: names[i])
        return [tuple(_norm(r[i]) for i in order) for r in values]

    return listed(cols, rows) == listed(ocols, orows)
