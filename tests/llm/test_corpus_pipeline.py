"""The pipeline, stage by stage, against brute force on a small documents table."""

from __future__ import annotations

import random

import corpus_pipeline
from tests.llm.test_corpus_ops import SCHEMA, made, words
from tests.llm.test_jaccard import brute

from tidebar.llm import quality_rules
from tidebar.session import scratch_path


def test_stages_and_run(spark):
    root = scratch_path(spark, "pipeline-test")
    # Line dedup leaves nothing of copies line by line, so near copies that reach the next stage differ in every line.
    rnd = random.Random(1)
    near = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 6) for _ in range(90)) for _ in range(6)]
    near += [t.replace(t.split(" ")[k], "word", 1) for k, t in enumerate(near)]
    texts = [*made(80, 9), None, "", "A B! " * 100, *near]
    rows = [(i, t, "en", f"s{i % 4}", len(t or ""), "s", "f", "k", "o") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60, 3)], "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    docs = spark.read.parquet(f"{root}/documents.parquet")
    seen, columns = [docs], docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], root)
        if k < 4:
            assert out.columns == columns
        out.write.parquet(f"{root}/{k}")
        seen.append(spark.read.parquet(f"{root}/{k}"))
    good = [i for i, t in enumerate(texts) if not any(r.rejects(quality_rules.View((t or "").encode())) for r in quality_rules.RULES)]
    assert sorted(r.doc_id for r in seen[1].collect()) == good and 10 < len(good) < len(texts)
    lined = sorted((r.doc_id, r.text, r.n_chars) for r in seen[2].collect())
    assert all(n == len(t) for _, t, n in lined)
    kept, _ = brute([(i, t) for i, t, _ in lined])
    stay = sorted(i for i, _ in kept)
    assert sorted(r.doc_id for r in seen[3].collect()) == stay and len(stay) < len(lined)
    times = {}
    for r in seen[4].collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert set(times) <= set(stay) and max(times.values()) <= 3
    kept = {r.doc_id: len(words(r.text)) for r in seen[3].collect()}
    assert abs(sum(n * kept[i] for i, n in times.items()) - sum(kept.values())) <= 4 * max(kept.values())
    pieces = seen[5].collect()
    assert {r.doc_id for r in pieces} == set(times)
    run = corpus_pipeline.run(spark, root)
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert run.columns == seen[5].columns and sum(r.length for r in run.collect()) == sum(r.length for r in pieces)
    assert {key(r)[0] for r in run.collect()} == set(times)
