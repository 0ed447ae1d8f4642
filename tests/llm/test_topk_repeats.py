"""Top-k search over rows that repeat a vec_id."""

from __future__ import annotations

import numpy as np
import pytest

from tidebar.llm import topk_search


@pytest.mark.parametrize("k", [3, 20, 500])
def test_repeated_ids_are_candidates(spark, k):
    rnd = np.random.default_rng(4)
    rows = [(int(i) % 150, [float(x) for x in rnd.normal(0, 0.2, 6).astype("f4")]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    v = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in e]) for i, e in rows]
    want = []
    for q in sorted({i for i, _ in v if i % 20 == 0}):
        mine = [x for i, x in v if i == q]
        best = sorted((-sum(a * b for a, b in zip(m, x, strict=True)), i) for m in mine for i, x in v if i != q)[:k]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    got = topk_search.top_k(df, df.where("vec_id % 20 = 0"), k=k, query_block=7, row_block=60)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
