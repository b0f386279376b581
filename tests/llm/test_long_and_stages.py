"""Very long texts through every operator; edge cases through every stage of the pipeline."""

from collections import Counter

import pytest

import corpus_pipeline
from tessera.llm import chunk_dedup, dedup_exact, licenses, mix, near_dedup, packing, quality, shard_ring, telephony
from tests.llm.conftest import EDGE, frame, words


@pytest.fixture(scope="module")
def long(spark):
    text = words(250_000, 3)  # 1.8 MB
    return frame(spark, [(1, text, "a"), (2, text + " end", "a"), (3, "short one", "b"), (4, "z" * 1_300_000, "b")]).repartition(2)


def test_long_texts(spark, long):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r["size"] for r in mix.mix(long).docs.collect()} == {1: 250_000, 2: 250_001, 3: 2, 4: 1}
    assert len(quality.quality_scores(long, labels).collect()) == 4
    tokens = packing.pack(long, packing.word_tokenizer()).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(tokens) == 4 and all(r["sum(length)"] == r["max(doc_tokens)"] for r in tokens)
    assert {r.doc_id: r.n_words for r in licenses.license_scan(long).collect()} == {1: 250_000, 2: 250_001, 3: 2, 4: 1}
    assert {r.doc_id: r.n_bytes for r in telephony.telephony(long).select("doc_id", "n_bytes").collect()}[4] == 1_300_000
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(long).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    spans = chunk_dedup.repeated_spans(long).groupBy("doc_id").agg({"length": "max"}).collect()
    assert {r.doc_id for r in spans} == {1, 2} and all(r["max(length)"] > 1_500_000 for r in spans)
    assert Counter(r.shard for r in shard_ring.ring_shards(long, 4).collect()) == {0: 1, 1: 1, 2: 1, 3: 1}
    assert all(r.kept for r in dedup_exact.exact_duplicates(long).collect())


@pytest.mark.parametrize("rows", [EDGE, []])
def test_stages_on_edges(spark, tmp_path, rows):
    spark.createDataFrame([(1, 1, 0), (None, 0, 0), (7, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark, rows)  # with further columns whose names the stages use inside
    ids = Counter(r[0] for r in rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        got = Counter(r.doc_id for r in out.collect())
        if name == "quality":
            assert got == ids  # labels of one kind accept all
        elif name == "exact_dedup":
            assert not rows or got == {1: 1, 3: 1, 5: 1, 6: 1, 7: 1, None: 1, 9: 1, 10: 1, 11: 1}
        elif name == "near_dedup":
            assert set(got) <= set(ids) and got[None] == ids[None]
        else:
            assert set(got) <= set(ids) and (not rows or got)
        assert name == "packing" or out.columns == list(corpus_pipeline.COLUMNS)
