"""Packing gives the same sequences however many pieces a worker remembers."""

import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from granula.llm import packing, tokens  # noqa: E402


def test_remembered_pieces_change_no_row(spark):
    docs = spark.createDataFrame([(i, " ".join(f"word{chr(97 + k % 26)}{chr(97 + i % 26)}, x{k}" for k in range(300))) for i in range(40)] + [(40, None)], "doc_id long, text string").coalesce(1)
    path = P.path("byte_bpe_50k.json")
    key = lambda df: sorted(map(tuple, packing.digest(df).collect()))
    assert key(packing.pack(docs, path, remembered=60)) == key(packing.pack(docs, path)) != []


def test_an_encoder_has_the_memory_asked_for():
    assert tokens.encoder(P.path("byte_bpe_50k.json"), False, most=1234).most == 1234


def test_workers_of_the_pipeline_keep_no_pieces_after_packing(spark):
    path = P.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, " ".join(f"kept{chr(97 + i)}{chr(97 + k % 26)}" for k in range(300))) for i in range(16)], "doc_id long, text string").repartition(4)

    def held(batches):
        for _ in batches:
            pass
        e = tokens.encoder(path, False, most=500_000)
        yield pa.record_batch([pa.array([sum(" kept" in x[:5] for x in (*e.young, *e.old))])], ["n"])

    assert len(corpus_pipeline.pack(spark, docs, "").collect()) >= 16
    assert [r.n for r in spark.range(0, 16, 1, 16).mapInArrow(held, "n long").collect()] == [0] * 16
