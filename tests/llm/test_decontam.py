import re

from helpers import LOWER, SCHEMA, odd_documents, same_rows, write_tables
from emberspark.llm import decontam as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(text, items, n):
    w = [m.group().translate(LOWER) for m in WORD.finditer(text or "")]
    hit, ids = set(), set()
    for item, t in items:
        iw = [m.group().translate(LOWER) for m in WORD.finditer(t or "")]
        k = min(n, len(iw))
        keys = {tuple(iw[i:i + k]) for i in range(len(iw) - k + 1)} if iw else set()
        for i in range(len(w) - k + 1):
            if tuple(w[i:i + k]) in keys:
                hit.update(range(i, i + k))
                ids |= {str(item)} - {"None"}  # an item without id hits words, but is not named
    return len(w), len(hit), sorted(ids), w, hit


def items():
    texts = [r[1] for r in odd_documents() if r[1]]
    return [(1, texts[0]), (2, texts[0].upper() + "!"), (3, texts[5][:60]), (4, "one"), (5, ""), (6, None), (None, texts[3]),
            (7, texts[3].replace(" ", ", ")), (8, "日本 x"), (9, texts[2])]


def test_matches_brute_force_for_every_slice_size(spark, odd):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    kept = items()
    for size in (D.SLICE_BYTES, 4000):
        for r in D.decontaminate(odd, bench, slice_bytes=size).collect():
            n, hits, ids, w, hit = brute(r.text, kept, 10)
            assert (r.n_words, r.n_hit, r.item_ids) == (n, hits, ids)
            covered = " ".join(m for s in r.spans for m in WORD.findall(r.text[s.start:s.end])).translate(LOWER).split()
            assert covered == [w[i] for i in sorted(hit)]


def test_query_matches_sql(spark, odd):
    folder = write_tables(spark, documents=odd, benchmark=(items(), "item_id long, text string"))
    same_rows(D.op10_decontaminate(spark, folder), D.SQL["op10_decontaminate"], folder)


def test_empty_tables_and_clashing_columns(spark, odd, none, clashing):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in D.decontaminate(odd, bench).collect()} == {0}
    full = spark.createDataFrame(items(), "item_id long, text string")
    assert D.decontaminate(none, full).count() == 0
    assert D.decontaminate(clashing, full).where("n_hit > 0").count() > 0
    assert SCHEMA.startswith("doc_id")


def test_items_without_id_are_hit_but_not_named(spark):
    docs = spark.createDataFrame([(1, "one two three four", "en", "s", 1)], SCHEMA)
    bench = spark.createDataFrame([(None, "two three"), (None, None)], "item_id long, text string")
    assert [(r.n_hit, r.item_ids) for r in D.decontaminate(docs, bench).collect()] == [(2, [])]
