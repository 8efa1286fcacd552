"""The pipeline against a plain version of each stage on a small fixture."""

import random

import corpus_pipeline as C
from helpers import SCHEMA, odd_documents, words, write_tables
from emberspark.llm import toxicity as T
from test_decontam import brute as brute_hits
from test_neardup import brute as brute_classes
from test_packing import reference  # noqa: F401
from test_secrets import all_spans


def fixture(spark):
    rng = random.Random(8)
    docs = odd_documents()
    for i in range(300, 500):
        docs.append((i, words(rng, 40) + (". you grumble you" if i % 4 == 0 else ".") + (" password=abcdef0123456789" if i % 7 == 0 else ""),
                     "en", "s", None))
    item = words(rng, 14)
    docs.append((600, words(rng, 20) + " " + item.upper() + " " + words(rng, 20), "en", "s", None))
    docs = [d[:4] + ((None if d[1] is None else len(d[1])),) for d in docs]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(300, 500)]
    folder = write_tables(spark, documents=(docs, SCHEMA), labels=(labels, "doc_id long, quality int, toxic int"),
                          benchmark=([(1, item), (2, None)], "item_id long, text string"))
    return docs, item, folder


def test_stages_and_run(spark, reference, tmp_path):  # noqa: F811
    docs, item, folder = fixture(spark)
    df = spark.read.parquet(f"{folder}/documents.parquet")
    states = [sorted(map(tuple, df.collect()), key=repr)]
    for k, (_, stage) in enumerate(C.STAGES):
        out = stage(spark, df, folder)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or out.columns == df.columns
        df = out
        states.append(sorted(map(tuple, df.collect()), key=repr))
    given, mild, single, unseen, redacted, packed = states
    model = T.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    score = dict(zip([r[0] for r in given], T.score_texts([(r[1] or "").encode() for r in given], model, {})[0]))
    gone = {r[0] for r in given} - {r[0] for r in mild}
    assert gone - {None} == {i for i, s in score.items() if s >= 0.5 and i is not None} >= {i for i in range(300, 500) if i % 4 == 0}
    label = brute_classes([(r[0], r[1]) for r in mild], 5)
    assert sorted(r[0] for r in single if r[0] is not None) == sorted(set(label.values()))
    assert [r for r in single if r[0] is None] == [r for r in mild if r[0] is None]
    assert unseen == [r for r in single if not brute_hits(r[1], [(1, item)], 10)[1]] and 600 not in {r[0] for r in unseen}
    for before, after in zip(sorted(unseen, key=lambda r: repr((r[0], r[1] is None))), sorted(redacted, key=lambda r: repr((r[0], r[1] is None)))):
        spans = all_spans(before[1] or "")
        assert (before[1] == after[1]) == (not spans)
        if spans:
            assert "[SECRET]" in after[1] and after[4] == len(after[1]) and "0123456789" not in after[1]
    tokens = sum(len(reference.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in redacted)
    assert sum(r[3] for r in packed) == tokens and len({r[5] for r in packed}) <= -(-tokens // 2048) + 1
    again = sorted((r.doc_id, r.piece, r.ids_crc32) for r in C.run(spark, folder).where("doc_id is not null").collect())
    assert again == sorted((r[0], r[1], r[4]) for r in packed if r[0] is not None)


def test_empty_documents(spark):
    folder = write_tables(spark, documents=([], SCHEMA), labels=([], "doc_id long, quality int, toxic int"),
                          benchmark=([], "item_id long, text string"))
    assert C.run(spark, folder).count() == 0


def test_extra_columns_go_through(spark, clashing):
    folder = write_tables(spark, documents=clashing, labels=([], "doc_id long, quality int, toxic int"),
                          benchmark=([], "item_id long, text string"))
    df = clashing
    for _, stage in C.STAGES[:4]:
        df = stage(spark, df, folder)
        assert df.columns == clashing.columns
    assert df.where("kept = 'mine' and toxic_score = 'mine'").count() == df.count() > 0
