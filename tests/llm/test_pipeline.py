import os
import random

from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm.shared import materialise

from .helpers import SCHEMA, corpus, words
from .test_search_join_dedup import brute_classes, brute_kept
from .test_text_and_packing import brute_spans, check_packing

def test_stages_against_brute_force(spark, tmp_path):
    """With columns that are named like the operators' own, in several cases of letters: they come out as they went in."""
    r = random.Random(2)
    own = SCHEMA.replace("spans string", "`SPANS` string").replace("node string", "`Kept_Text` string, clean_text string, `_ROW` string, `n removed` string")
    rows = [(i, t and (t + " token=0123456789abcdef0" if r.random() < 0.2 else t), lang, s, n, *x[:5], *(f"{i}-{c}" for c in "abcd"), x[-1]) for i, t, lang, s, n, *x in corpus(21)]
    spark.createDataFrame(rows, own).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 0 if (t or "").startswith("w ") else 1, 0) for i, t, *_ in rows if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(materialise(stage(spark, seen[-1], str(tmp_path))))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "secret scans", "best-fit packing"]
    assert all(d.columns == docs.columns and [f.dataType for f in d.schema] == [f.dataType for f in docs.schema] for d in seen[:-1])
    for d in seen[1:-1]:
        for x in d.collect():
            assert x["_ROW"] == f"{x.doc_id}-c" and x["n removed"] == f"{x.doc_id}-d" and (x.score, x["SPANS"], x["Kept_Text"], x.clean_text) == ("clash", "clash", f"{x.doc_id}-a", f"{x.doc_id}-b") and x["_other"] == 7
    _, good, single, cut, clean, packed = [d.collect() for d in seen]

    # one document of each class of what came in, repeated rows once
    pairs = [(x.doc_id, x.text) for x in good]
    classes = {(i, c) for i, c, _ in brute_classes(pairs)}
    want = {p for p in pairs if p[0] is None or any(i == p[0] == c for i, c in classes)}
    gone = {i for i, c in classes if i is not None and i != c}
    want = {p for p in want if p[0] not in gone}
    assert {(x.doc_id, x.text) for x in single} == want and len([x for x in single if x.doc_id is not None]) == len([p for p in want if p[0] is not None])

    kept = brute_kept([(x.doc_id, x.text) for x in single])
    removed = {(i, n): g for i, n, g, _ in kept}
    for x in single:
        after = [y for y in cut if y.doc_id == x.doc_id]
        assert any(len(words(y.text)) == len(words(x.text)) - removed[(x.doc_id, len(words(x.text)))] for y in after)
    assert len(clean) == len(cut) == len(single)
    assert any(brute_spans(x.text) for x in cut) and not any(brute_spans((x.text or "").replace("[SECRET]", " ")) for x in clean)
    sizes = {}
    for x in clean:
        sizes[x.doc_id] = sizes.get(x.doc_id, 0) + len(words(x.text))
    check_packing(packed, sizes, (512, 1024, 2048, 4096))


def test_stages_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_is_its_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.agg(F.count_distinct("doc_id")).first()[0] > 100 and os.path.exists("/root/testdata/sf0.001")
