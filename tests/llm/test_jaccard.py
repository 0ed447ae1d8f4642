"""The near-duplicate stage of the pipeline against brute-force Jaccard of five-word shingles."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_corpus_ops import made, words

from tidebar.llm import jaccard


def brute(rows):
    """The rows (doc_id, text) that stay: the smallest of each component at Jaccard 0.8 or more."""
    found = []
    for _, t in rows:
        w = [x.lower() for x in words(t)]
        found.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = 0
    for a in range(len(rows)):
        for b in range(a):
            both = len(found[a] & found[b])
            if 5 * both >= 4 * (len(found[a]) + len(found[b]) - both):
                linked += found[a] != found[b]
                root[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(find(k), set()).add(r)
    return sorted(min(g, key=lambda r: r[0]) for g in groups.values()), linked


def texts():
    """Near copies around 0.8, a dense group far larger than the window, a common passage, short and empty texts."""
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdef") for _ in range(5)) for _ in range(3000)]
    some = lambda n: [rnd.choice(vocab) for _ in range(n)]
    out, passage, base = made(60, 4), some(30), some(150)
    for k in range(40):
        w = some(rnd.randint(45, 200))
        out.append(" ".join(w))
        for _ in range(rnd.randint(1, 5)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        out.append(" ".join(w))
        g = list(base)
        for _ in range(k % 3):
            g[rnd.randrange(150)] = rnd.choice(vocab)
        out.append(" ".join(g))
        out.append(" ".join(some(15) + passage + some(15)))
    return [*out, "A b c d E f", "a B c d e F", "two words", "", " \n", None]


@pytest.mark.parametrize(("near", "tile"), [(1, 2048), (8, 6)])
def test_stage_keeps_one_of_each_component(spark, monkeypatch, near, tile):
    monkeypatch.setattr(jaccard, "NEAR", near)
    monkeypatch.setattr(jaccard, "TILE", tile)  # 6: the common passage and the dense group are cut into blocks of 3
    rows = list(enumerate(texts()))
    want, linked = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == want and linked > 200


def test_bitmaps_exclude_no_similar_pair():
    rnd = np.random.default_rng(3)
    checked, excluded = 0, 0
    for _ in range(3000):
        n, moved = int(rnd.integers(1, 300)), int(rnd.integers(0, 60))
        pool = np.unique(rnd.integers(0, 1 << 63, n + moved, dtype=np.uint64))
        a, b = pool[:n], pool[min(moved, len(pool) - 1) :]
        a, b = np.sort(rnd.permutation(a)), np.sort(b)
        passes = jaccard.may_be_alike(jaccard.parity(a), jaccard.parity(b), len(a) + len(b))
        assert passes or not jaccard.alike(a, b)
        checked += jaccard.alike(a, b)
        excluded += not passes
    assert checked > 300 and excluded > 1000


def test_intermediate_tables_are_deleted(spark, tmp_path):
    from tidebar.session import checkpoint_dir

    there = lambda: {p for p in os.listdir(checkpoint_dir(spark)) if p.startswith("near-")}
    before = there()
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id bigint, text string")
    corpus_pipeline.near_dedup(spark, docs, "").count()
    assert {p.rsplit("-", 1)[0] for p in there() - before} <= {"near-fates", "near-shingles"}


def test_clashing_columns_pass_unchanged(spark):
    names = ["near", "fate", "sieve", "stays", "node", "key", "text_hash", "near_doc", "near_text"]
    rows = [(1, "a b c d e f", *"x" * 9), (2, "a b c d e f", *"y" * 9), (3, "g h", *"z" * 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string" + "".join(f", {c} string" for c in names))
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [rows[0], rows[2]]


def test_repeated_ids_and_rows_without_id(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (1, b), (2, b + " more"), (None, a), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, "").collect() if r.doc_id is not None)
    assert got == [(1, a), (1, b)]
    assert corpus_pipeline.near_dedup(spark, docs, "").where("doc_id IS NULL").count() == 2
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_simhash_finds_near_copies_by_itself(spark, monkeypatch):
    none = spark.createDataFrame([], "tok bigint, a bigint, b bigint, n bigint, at bigint")
    monkeypatch.setattr(jaccard, "candidates", lambda nodes: none)
    rnd = random.Random(2)
    w = ["".join(rnd.choice("abcdef") for _ in range(6)) for _ in range(2000)]
    near, other = [*w[:900], "changed", *w[901:]], w[::-1]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(near)), (3, " ".join(other))], "doc_id bigint, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {1, 3}
