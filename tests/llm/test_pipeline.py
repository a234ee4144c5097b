"""Each stage on its own input, and the whole run."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from conftest import SF_SMALL
from scorelake.llm import language, secrets
from test_simhash import slow_groups
from test_text_scans import slow_hits
from test_tokens import Untouched, check_pieces
from scorelake.llm.tokens import default_vocabulary


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    stages = dict(pipeline.STAGES)
    for name, stage in pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        after = stage(spark, docs, SF_SMALL).cache()
        assert after.columns == docs.columns
        rows = {r["doc_id"]: r for r in after.collect()}
        assert len(rows) == after.count()
        texts = [(i, r["text"]) for i, r in before.items()]
        if name == "language_id":
            model = language.fit(docs)
            assert set(rows) == {i for i, t in texts for label, score in [model.predict(t)] if label != "und" and score >= pipeline.LEAST_SCORE}
            assert set(rows) >= {i for i, t in texts if len(t.split()) > 20 and sum(c.isalpha() for c in t) > len(t) / 2}
        elif name == "near_duplicates":
            assert set(rows) == {c for *_, c in slow_groups(texts)}
        elif name == "benchmark_passages":
            assert set(rows) == {r[0] for r in slow_hits(texts, items) if not r[-1]}
        else:
            assert set(rows) == set(before)
            for i, r in rows.items():
                assert (r["text"] == before[i]["text"]) == (not secrets.scan(before[i]["text"])[1])
                assert r["text"] == before[i]["text"] or r["n_chars"] == len(r["text"])
        if name != "secret_scan":
            assert all(rows[i] == before[i] for i in rows)
        docs = after
    left = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check_pieces(Untouched(default_vocabulary()), left, stages["packing"](spark, docs, SF_SMALL).collect())


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF_SMALL)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, pipeline.run(spark, SF_SMALL).select(columns).collect())) == sorted(map(tuple, docs.select(columns).collect()))


CLASHING = ["found_language", "benchmark_hits", "clean_text", "simhash_id", "simhash_hash", "simhash_keep", "simhash_slot", "simhash_word", "simhash_bits", "simhash_own",
            "__language", "__hits", "__clean", "__own_hash", "__id", "__hash", "__rows", "hash", "fp", "component", "Text_"]


def test_columns_named_like_working_ones(spark):
    """They come through every stage as they are."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    wide = docs.select("*", *[F.concat(F.lit(f"{i}-"), F.col("doc_id").cast("string")).alias(c) for i, c in enumerate(CLASHING)])
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, wide, SF_SMALL)
        assert after.columns == wide.columns
        rows = after.collect()
        assert rows and all(r[c] == f"{i}-{r['doc_id']}" for r in rows for i, c in enumerate(CLASHING))
    assert pipeline.STAGES[-1][1](spark, wide, SF_SMALL).count() > 0


@pytest.mark.parametrize("rows", [0, 15])
def test_edge_rows_and_empty_tables(spark, edge_docs, rows):
    docs = edge_docs.selectExpr("doc_id", "text", "lang", "component_id AS source", "n_words AS n_chars", "hits", "TEXT_ AS fp").limit(rows)
    docs = docs.selectExpr("doc_id", "text", "lang", "source", "cast(n_chars AS long) AS n_chars", "hits", "fp")
    for name, stage in pipeline.STAGES:
        before, docs = docs.count(), stage(spark, docs, SF_SMALL).cache()
        assert name == "packing" or docs.count() <= before
    assert (docs.count() > 0) == (rows > 0)
