"""Python workers that wait for tasks are small, and whole texts reach them in small batches."""

from __future__ import annotations

import ctypes

import psutil
import pyarrow as pa
import pytest

from tidebar.llm import packing
from tidebar.llm.common import BATCH, TEXT_ROWS, staged, trimmed


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="glibc only")
def test_a_task_gives_back_what_it_freed():
    pinned = []

    def each(batches):
        for b in batches:
            freed = [bytes(700) for _ in range(300_000)]
            pinned.append(bytes(700))  # above the freed blocks, so that the heap cannot shrink by itself
            del freed
            yield b

    rss = psutil.Process().memory_info
    before = rss().rss
    assert sum(b.num_rows for b in trimmed(each)(iter([pa.record_batch({"a": [1, 2]})]))) == 2
    assert rss().rss - before < 100e6


def test_texts_reach_a_task_in_small_batches(spark, monkeypatch):
    own, seen = spark.conf.get(BATCH), []
    docs = spark.range(2 * TEXT_ROWS + 7).selectExpr("id AS doc_id", "'a b' AS text").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.record_batch({"n": pa.array([b.num_rows], pa.int64())})

    got = [r.n for r in staged(docs.mapInArrow(sizes, "n bigint"), "sizes", TEXT_ROWS).collect()]
    assert sum(got) == 2 * TEXT_ROWS + 7 and max(got) == TEXT_ROWS
    monkeypatch.setattr(packing, "staged", lambda df, name, batch=None: seen.append(batch) or staged(df, name, batch))
    assert packing.pack(docs.limit(5)).select("doc_id").distinct().count() == 5 and seen == [TEXT_ROWS]
    assert spark.conf.get(BATCH) == own


def test_a_worker_keeps_no_words_after_packing(spark):
    docs = spark.range(0, 400, 1, 8).selectExpr("id AS doc_id", "concat('word', id, ' other') AS text")
    assert packing.pack(docs).select("doc_id").distinct().count() == 400

    def left(batches):
        for _ in batches:
            pass
        made = packing.encoder.cache_info().currsize
        yield pa.record_batch({"made": pa.array([made], pa.int64()), "n": pa.array([len(packing.encoder(None).words) if made else 0], pa.int64())})

    got = spark.range(0, 8, 1, 8).mapInArrow(left, "made bigint, n bigint").collect()
    assert max(r.made for r in got) == 1  # a worker that has packed
    assert max(r.n for r in got) == 0
