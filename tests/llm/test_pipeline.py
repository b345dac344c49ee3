"""The pipeline's stages, each against what it was given."""

from pyspark.sql import functions as F

import corpus_pipeline
from sensorloom.llm.common import stored
from tests.llm.conftest import SF, rows_of
from tests.llm.test_decontam import brute as hits
from tests.llm.test_jaccard import brute as groups
from tests.llm.test_lines import common, measured, normal


def test_stages(spark, documents, odd):
    extra = odd.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.col("n_words").alias("n_chars"))
    docs = stored(documents.unionByName(extra.withColumn("doc_id", F.col("doc_id") + 10_000)))
    bench = [(r["item_id"], r["text"]) for r in rows_of(spark.read.parquet(f"{SF}/benchmark.parquet"))]
    given, seen = rows_of(docs), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
        seen[name] = (given, rows_of(docs))
        given = seen[name][1]
        if name != "best-fit packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)

    before, after = seen["quality rules"]
    often = common(before, 0.02, 3)
    keep = []
    for r in before:
        m = measured(r["text"] or "")
        left = m["n_words"] - sum(len(x.split()) for x in (r["text"] or "").split("\n") if ((r["source"] or ""), normal(x)) in often)
        if m["n_words"] >= 50 and 2 * m["n_repeat_words"] <= m["n_words"] and left >= 20 and left >= 0.3 * m["n_words"]:
            keep.append(r)
    assert sorted(map(repr, after)) == sorted(map(repr, keep)) and 0 < len(after) < len(before)

    before, after = seen["line dedup"]
    assert [r["doc_id"] for r in sorted(before, key=repr)] == [r["doc_id"] for r in sorted(after, key=repr)]

    before, after = seen["n-gram Jaccard join"]
    want = [g.strip("()").split(", ") for g in groups([(r["doc_id"], r["text"]) for r in before])]
    assert sorted(r["doc_id"] for r in after if r["doc_id"] is not None) == sorted({int(g[2]) for g in want if g[2] != "None"})
    rows = [(1, "one text of the id that two rows share", "en", "h", 1), (1, "and quite another text of it here", "en", "h", 1)]
    rows += [(None, "a text without any id but two copies", "en", "h", 1)] * 2 + [(2, "One text of the id that two rows share", "en", "h", 1), (None, None, None, None, None)]
    odd = spark.createDataFrame(rows, documents.select(*corpus_pipeline.COLUMNS).schema)
    stay = [(r["doc_id"], r["text"]) for r in rows_of(corpus_pipeline.near_duplicates(spark, odd, SF))]
    assert sorted(stay, key=repr) == sorted({(r[0], r[1]) for r in rows} - {(2, rows[4][1])}, key=repr)

    before, after = seen["benchmark decontamination"]
    mostly = {r["doc_id"] for r in before for n, hit, _ in [hits(r["text"], bench)] if hit > 0.5 * n}
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - mostly
    assert all(a["text"] == b["text"] for a in after for b in before if a["doc_id"] == b["doc_id"] and not hits(b["text"], bench)[1])

    before, after = seen["best-fit packing"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}


def test_run_is_registered(spark):
    from sensorloom.llm.queries import QUERIES

    assert QUERIES["pipeline"] is corpus_pipeline.run and len(QUERIES) == 14
