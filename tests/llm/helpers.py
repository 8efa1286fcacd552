"""Small tables with the odd cases, written where the queries read them."""

import os
import random
import tempfile

import duckdb

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeio") for _ in range(rng.randint(1, 6))) for _ in range(n))


def odd_documents(seed=1):
    """Nulls, empty and long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(seed)
    base = [words(rng, rng.randint(3, 120)) for _ in range(40)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)]
    rows += [(100, None, None, None, None), (101, "", "en", "s", 0), (102, " \t\n", "en", "s", 3), (None, base[0], "en", "s", 1),
             (None, None, None, None, None), (103, base[1], "en", "hot", 1), (103, base[1], "en", "hot", 1),
             (104, words(rng, 30000), "en", "hot", 1), (105, "one", "en", "s", 3), (106, "ONE", "en", "s", 3),
             (107, "Ünï çødé 日本 " * 20, "xx", "s", 1), (108, "x" * 5000, "xx", "s", 1)]
    for k in range(12):  # near copies of a text of 120 words
        own = words(random.Random(99), 120).split()
        own[10 * (k % 12)] = f"changed{k}"
        rows.append((200 + k, " ".join(own), "en", "hot", 1))
    return rows


def write_tables(spark, folder=None, **tables):
    """Each table (rows, schema) or DataFrame as one Parquet file ``name.parquet`` of a new folder."""
    folder = folder or tempfile.mkdtemp(prefix="llm-tables-")
    for name, t in tables.items():
        df = spark.createDataFrame(*t) if isinstance(t, tuple) else t
        df.coalesce(1).write.mode("overwrite").parquet(os.path.join(folder, f"{name}.parquet"))
    return folder


def run_sql(sql, folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        path = os.path.join(folder, name)
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    cur = con.execute(sql)
    return [c[0] for c in cur.description], cur.fetchall()


def same_rows(df, sql, folder):
    cols, rows = run_sql(sql, folder)
    mine = [tuple(r[c] for c in sorted(cols)) for r in df.collect()]
    theirs = [tuple(x for _, x in sorted(zip(cols, r))) for r in rows]
    assert sorted(map(repr, mine)) == sorted(map(repr, theirs))
