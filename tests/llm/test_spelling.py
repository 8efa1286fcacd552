import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helpers import LOWER, SCHEMA, odd_documents, same_rows, write_tables
from emberspark.llm import spelling as W


def plain_counts(rows):
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def edit(a, b):
    """Whether one inserted, deleted or replaced code point separates a and b."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(counts):
    near = {w: [x for x in counts if edit(w, x)] for w in counts}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None
    rows = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return rows


def vocabulary(seed=2):
    """Variants of a few words, words of one letter, a crowd that shares its beginning and end, chains of forms."""
    rng = random.Random(seed)
    words = {"a" * k for k in range(7, 30)} | {"abcabca" * 3, "bcabcab" * 3}
    for _ in range(40):
        w = "".join(rng.choice("aeionstré") for _ in range(rng.randint(7, 14)))
        words.add(w)
        for _ in range(8):
            i, c = rng.randrange(len(w)), rng.choice("aeionstré日")
            words |= {w[:i] + c + w[i + 1:], w[:i] + c + w[i:], w[:i] + w[i + 1:]}
    words |= {f"begin{a}{b}{c}finish" for a in "abcdefgh" for b in "abcdefgh" for c in "abc"}
    words |= {"x" * 3000 + t for t in ("", "y", "yy", "z")}
    counts = {w: rng.choice([2, 3, 20, 30, 300]) for w in sorted(words) if len(w) >= 7}
    counts |= {"chainaaaaa": 2, "chainaaaab": 20, "chainaaabb": 200, "chainaabbb": 2000, "chainabbbb": 20000, "chainbbbbb": 200000}
    return counts


def rows_of(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("split", [W.SPLIT, 20, 1])
def test_variants_match_brute_force(spark, split):
    counts = vocabulary()
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    got = W.spelling_variants(df, split=split)
    assert got.count() == len(counts) and rows_of(got) == plain(counts)
    chain = {r.word: r.root for r in got.where("word like 'chain%'").collect()}
    assert set(chain.values()) == {"chainbbbbb"}


def test_each_pair_once(spark):
    df = spark.createDataFrame(list(vocabulary().items()), "word string, n long")
    near = W.near_words(df, 30)
    assert near.count() == near.select("word", "other").distinct().count()


def test_word_counts_and_query(spark):
    rng = random.Random(6)
    base = ["Überraschung", "ENTSCHEIDUNG", "notwendig", "çouelleéan", "kürzlich×so", "naïveté", "abcdefgh", "theÿonheing"]
    rows = []
    for d in range(120):
        text = " ".join(rng.choice(base) + rng.choice(["", "", "", "s", "1x", "-"]) for _ in range(60))
        rows.append((d if d % 17 else None, text, "en", "s", 1))
    rows += odd_documents()
    df = spark.createDataFrame(rows, SCHEMA)
    counts = plain_counts([(r[0], r[1]) for r in rows])
    assert {r.word: r.n for r in W.word_counts(df).collect()} == counts and len(counts) > 50
    folder = write_tables(spark, documents=df)
    assert rows_of(W.op13_spelling(spark, folder)) == plain(counts)
    same_rows(W.op13_spelling(spark, folder), W.SQL["op13_spelling"], folder)


def test_odd_tables(spark, none, odd, clashing):
    assert W.spelling_variants(W.word_counts(none)).count() == 0
    assert rows_of(W.spelling_variants(W.word_counts(clashing))) == rows_of(W.spelling_variants(W.word_counts(odd)))
    one = W.spelling_variants(spark.createDataFrame([("only one", 3)], "word string, n long").withColumn("key", F.lit(1)))
    assert rows_of(one) == {("only one", None, "only one", 3, 0, None)}
