"""Corpus operators against brute force on small documents, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.llm import (
    line_templates, packing, pii, quality_rules, simhash, source_mix, substring_dedup, token_rollup, topk_search, url_rules,
)
from tidebar.session import scratch_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, fp string, kept string, `odd name` string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def made(n=60, seed=3):
    """Documents with copies, near copies, shared passages and repeated lines."""
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 5))) for _ in range(400)]
    passage = " ".join(rnd.choice(vocab) for _ in range(30))
    texts = []
    for i in range(n):
        lines = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 40))) for _ in range(rnd.randint(1, 5))]
        if i % 5 == 0:
            lines.append(f"page {i} of the long report ended here")
        if i % 7 == 0:
            lines.append(passage)
        if i % 11 == 3:
            lines = [texts[i - 2]]
        if i % 13 == 5:
            w = texts[i - 3].split(" ")
            w[len(w) // 2] = "changed"
            lines = [" ".join(w)]
        texts.append("\n".join(lines))
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    texts = [*made(), None, "", " \t\n", "word", "x " * 30_000, "Ünï\u00a0codé\x85 word"]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or ""), "s", "f", "k", "o") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[1], None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def taken(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def words(text):
    return WORD.findall(text or "")


def test_repeats_match_brute_force(docs):
    rows = taken(docs, "doc_id", "text")
    first = {}
    last = float("inf")
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, last), last if i is None else i)
    want = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < (last if i is None else i):
                gone.update(range(k, k + 13))
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = taken(substring_dedup.remove_repeats(docs, chunk_bytes=3000), "doc_id", "n_words", "n_removed", "text")
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(x[2] for x in got) > 100


def simhash_brute(texts, radius=4):
    fps = [simhash.fingerprint((t or "").encode()) for t in texts]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return fps, [find(x) for x in range(len(fps))]


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_brute_force(spark, docs):
    rows = taken(docs, "doc_id", "text")
    fps, roots = simhash_brute([t for _, t in rows])
    assert fps == [plain_fingerprint(t) for _, t in rows]
    groups = {}
    for (i, _), r in zip(rows, roots, strict=True):
        groups.setdefault(r, []).append(i)
    want = [(i, f"{f:016x}", min(x for x in groups[r] if x is not None)) for (i, _), f, r in zip(rows, fps, roots, strict=True)]
    got = taken(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id")
    assert sorted(got, key=str) == sorted(want, key=str)
    assert max(Counter(roots).values()) > 2


@pytest.mark.parametrize("nodes", [1000, 1 << 27])
def test_hamming_links_lose_nothing(nodes):
    rnd = np.random.default_rng(nodes)
    centres = rnd.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = [int(c) for c in centres]
    for c in centres:
        for _ in range(40):
            flip = sum(1 << int(b) for b in rnd.choice(64, rnd.integers(0, 6), replace=False))
            fps.append(int(c) ^ flip)
    fps = np.unique(np.array(fps, np.uint64))
    keys, whose, probes = simhash.table_rows(fps, simhash.segments(nodes, 4))
    a, b = simhash.bucket_links(keys, whose, probes, 4)
    near = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    want = simhash.forest(fps[near[:, 0]], fps[near[:, 1]])
    got = simhash.forest(a, b)
    assert dict(zip(*(x.tolist() for x in got), strict=True)) == dict(zip(*(x.tolist() for x in want), strict=True))
    assert len(a) < len(fps)


def test_star_contraction_of_a_long_chain(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    other = spark.createDataFrame([(1000, 2000), (2000, 1500), (7, 7)], "a bigint, b bigint")
    got = dict(taken(simhash.components(chain.unionByName(other)), "node", "root"))
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1500: 1000, 2000: 1000}


def test_packing_is_gapless_and_exact(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = taken(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), "doc_id", "text")
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    one = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).repartition(5, "doc_id")
    got = [r.asDict() for r in packing.pack(one, length=256, open_windows=3, merge=2).collect()]
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
        piece = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert r["ids_crc32"] == zlib.crc32(piece) and r["doc_tokens"] == len(ids[r["doc_id"]])
    assert set(by_doc) == set(ids)
    for i, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at
            at += p["length"]
        assert at == len(ids[i])
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 256 and (at & (at - 1)) == 0


def test_packing_of_repeated_rows_and_null_ids(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = Counter()
    for i, t in taken(docs, "doc_id", "text"):
        tokens[i] += len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    got = packing.pack(docs.repartition(3), length=256, open_windows=3, merge=2).collect()
    packed, ends = Counter(), {}
    for r in got:
        packed[r.doc_id] += r.length
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert packed == tokens
    for pieces in ends.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256 and at & (at - 1) == 0  # so no sequence is padded


def test_pii_leaves_clashing_columns_and_repeats_alone(spark):
    rows = [(1, "mail a@b.co", "x", "y", "z"), (1, "mail a@b.co", "x", "y", "z"), (None, None, None, None, None)]
    got = pii.report(spark.createDataFrame(rows, "doc_id bigint, text string, p_email string, h_ip string, spans string")).collect()
    assert sorted((r.n_email, r.spans) for r in got) == [(0, ""), (1, "email:5:11"), (1, "email:5:11")]


def test_word_encoder_equals_tokenizer():
    import public_tokenizers

    e = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), most=50)
    odd = ["don't DON'T l'été", "ÀÉ İstanbul ﬁne ½ 3.14 №5", "a\u0301b e\u0301. x\u00a0y\u2003z", "***x*** \x85 中文。 한글", "it's!!! we'll, end.'s", "<|endoftext|> ok"]
    texts = [*odd, *[t for t in made(20) if t]]
    want = [np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for k in range(0, len(texts), 4):
        assert list(e.encode([t.encode() for t in texts[k : k + 4]])) == want[k : k + 4]


def test_top_k_matches_brute_force(spark):
    rnd = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rnd.normal(0, 0.2, 10).astype("f4")]) for i in range(400)]
    rows += [(400 + i, rows[5][1]) for i in range(50)] + [(900, None), (901, [1.0, None]), (902, [float("nan")]), (903, [float("inf")]), (904, []), (None, [1.0]), (905, [2.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    ok = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for qi, q in ok:
        if qi % 20 == 0:
            best = sorted(((-sum(a * b for a, b in zip(q, v, strict=False)), i) for i, v in ok if i != qi))[:20]
            want += [(qi, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    got = taken(topk_search.top_k(df, df.where("vec_id % 20 = 0"), query_block=7, row_block=60), "query_id", "rank", "vec_id", "score")
    assert sorted(got) == sorted(want)
    few = df.where("vec_id < 3")
    assert len(taken(topk_search.top_k(few, few.where("vec_id = 0")), "query_id")) == 2
    assert taken(topk_search.top_k(df.limit(0), df.limit(0)), "query_id") == []


def test_quality_rules(docs, empty):
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for i, t in taken(docs.where("doc_id IS NOT NULL"), "doc_id", "text"):
        w = words(t)
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        rep = {k + o for k in range(len(w) - 2) for o in range(3) if tri[tuple(w[k : k + 3])] > 1}
        lines = [x for x in (t or "").split("\n") if words(x)]
        base = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(rep), base)
        assert not (base and r.kept)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in quality_rules.judge(docs).collect())
    assert quality_rules.judge(empty).count() == 0 and quality_rules.keep_good(empty).count() == 0
    order = [r.name for r in quality_rules.ordered(quality_rules.RULES, {"few_words": (1.0, 0.1), "symbols": (0.1, 0.1), "capitals": (0.1, 0.0)})]
    assert order[:3] == ["symbols", "few_words", "capitals"]


def test_source_mix(spark, docs, empty):
    rows = source_mix.mix(docs, buckets=8).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault((r.source, r.target, r.source_size), []).append(r)
    for (_, target, size), rs in by.items():
        assert sum(r.size for r in rs) == size and target <= 3 * size + 1e-6
        assert abs(sum(r.taken for r in rs) - target) <= 1
    assert abs(sum(k[1] for k in by) - sum(k[2] for k in by)) < 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, source_mix.mix(docs.repartition(7), buckets=8).collect()))
    out = source_mix.mixed_documents(docs, source_mix.label_weights(spark.createDataFrame([(1, 1), (1, None), (2, 0), (None, 1)], "doc_id bigint, quality int")))
    assert out.columns == docs.columns and out.count() > 0
    assert source_mix.mix(empty).count() == 0 and source_mix.mixed_documents(empty).count() == 0


def test_heavy_weights_are_taken_first(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("source"))
    heavy = docs.select("doc_id", F.when(F.col("doc_id") % 4 < 2, 10.0).otherwise(0.1).alias("mix_weight"))
    got = source_mix.mix(docs, heavy).where("source = 'y'")
    share = {r.h: r.s for r in got.groupBy((F.col("doc_id") % 4 < 2).alias("h")).agg(F.sum("taken").alias("s")).collect()}
    assert share[True] > 3 * share[False] > 0


def test_line_templates(docs, empty):
    got = line_templates.drop_recurring(docs)
    assert got.columns[: len(docs.columns)] == docs.columns and got.count() == docs.count()
    rows = {r.doc_id: r for r in got.collect() if r.doc_id is not None}
    source = dict(taken(docs.where("doc_id IS NOT NULL"), "doc_id", "text"))
    ended = [i for i, t in source.items() if t and "of the long report ended here" in t]
    left = [i for i in ended if "ended here" in (rows[i].text or "")]
    assert len(ended) >= 5 and left == [min(ended)]
    for i, t in source.items():
        if t is None:
            assert rows[i].text is None and rows[i].line_count == 0
        else:
            assert rows[i].line_count == len(t.split("\n"))
            assert rows[i].line_dropped == len(t.split("\n")) - len(rows[i].text.split("\n")) or not rows[i].text
    assert line_templates.without_lines(docs).columns == docs.columns
    assert line_templates.drop_recurring(empty).count() == 0


def test_two_families_share_a_leaf(spark):
    texts = [f"user has just logged in from {w} today" for w in ("oslo", "rome", "lima", "cairo", "quito", "paris", "bonn", "bern", "riga", "kyiv")]
    texts += [f"user has just changed the password of {w}" for w in ("ann", "bob", "cem", "dan", "eve", "fay", "gus", "hal")]
    texts += [f"user has just {w} one two three four" for w in "abcd"]  # a third, but in four documents only
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = dict(taken(line_templates.drop_recurring(docs), "doc_id", "line_dropped"))
    assert got == {i: int(0 < i < 10 or 10 < i < 18) for i in range(22)}


def test_equal_lines_recur_from_two_documents_and_short_ones_from_twenty(spark):
    rows = [(i, f"own words of number {'x' * i} here\nShare this page\nread more") for i in range(20)]
    rows = [(i, t if i < 19 else t.replace("read more", "the end")) for i, t in rows]
    rows += [(30, "a line with 7 tokens of its own"), (31, "a line with 12 tokens of its own"), (32, "alone"), (33, "alone")]
    got = dict(taken(line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id bigint, text string")), "doc_id", "text"))
    # Families of 5 documents and more recur as well, so the own lines go but for the first.
    assert got[0] == rows[0][1] and got[30] == rows[20][1] and got[31] == "" and got[33] == "alone"
    assert all("Share this page" not in got[i] and ("read more" in got[i]) == (i < 19) for i in range(1, 20))


def test_line_dedup_leaves_clashing_columns_alone(spark):
    names = ["lines", "gone", "line_doc", "line_hash", "line_count", "line_dropped", "line_drop", "doc", "hash", "no", "own", "leaf"]
    rows = [(1, "a b c d e", *"x" * 12), (2, "a b c d e", *"y" * 12), (3, "g h", *[None] * 12)]
    got = line_templates.without_lines(spark.createDataFrame(rows, "doc_id bigint, text string" + "".join(f", {c} string" for c in names)))
    assert got.columns == ["doc_id", "text", *names] and sorted(map(tuple, got.collect())) == [rows[0], rows[2]]


def test_mix_leaves_clashing_columns_alone(spark):
    names = ["mix_weight", "mix_source", "mix_key", "mix_times", "mix_size", "mix_bucket", "mix", "mix_copy", "goal", "weight", "words"]
    rows = [(i, "a b c", "s" if i % 2 else "t", *[10_000 + i] * 11) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string" + "".join(f", {c} bigint" for c in names))
    plain = source_mix.mixed_documents(docs.drop(*names), source_mix.label_weights(spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")))
    got = source_mix.mixed_documents(docs, source_mix.label_weights(spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")))
    assert got.columns == docs.columns and all(tuple(r) in rows for r in got.collect())
    assert sorted(taken(got, "doc_id")) == sorted(taken(plain, "doc_id"))


def test_line_templates_generalise_words(spark):
    texts = [f"user logged in from {w} at the desk" for w in ("berlin", "rome", "oslo", "lima", "cairo", "quito")]
    texts += ["user logged in with nothing else like that", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = dict(taken(line_templates.drop_recurring(docs), "doc_id", "line_dropped"))
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 0, 7: 0}


PII_TEXT = (
    "mail a@b.c_x@d.e ok a.b+c@x-y.co.uk, 1.2.3.4.5 0010.2.3.255 1.2.3.256 card 4111 1111 1111 1111 and 4111-1111-1111-1112 "
    "+49 (30) 1234-567 +1 2 phone. IBAN DE89 3704 0044 0532 0130 00 and DE88370400440532013000 ssn 123-45-6789 x123-45-6789 é€😀 z@y.xx"
)


def brute_base(text):
    def ok(kind, x):
        d = re.sub("[^0-9]", "", x)
        if kind == "ip":
            return all(int(p) <= 255 for p in x.split("."))
        if kind == "card":
            s = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d)))
            return 16 <= len(d) <= 19 and s % 10 == 0
        return kind == "email" or 8 <= len(d) <= 15

    return [f"{k.name}:{m.start()}:{m.end()}" for k in pii.KINDS if k.base for m in re.finditer(k.plain, text) if ok(k.name, m[0])]


def test_pii_matches_brute_force(spark, empty):
    rnd = random.Random(5)
    parts = ["a@b.co", "@", ".", "1.2.3.4", "300.1.1.1", "+1 234 567 8901", "4111111111111111", " ", "x_", "é", "-", "12", "(", "😀", "b@c-d.e.f"]
    texts = [PII_TEXT, None, "", "a.b@" * 3000, "1.2.3.4 " * 2000, "a@b." + "c." * 20_000 + "d"] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40))) for _ in range(150)]
    rows = pii.report(spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")).collect()
    for r in rows:
        want = ",".join(brute_base(texts[r.doc_id] or ""))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (texts[r.doc_id] or "")[:200]
        assert r.spans == want or (r.n_added and r.spans.startswith(want))
    first = next(r for r in rows if r.doc_id == 0)
    at = PII_TEXT.index("DE89")
    assert f"iban:{at}:{at + 27}" in first.spans and first.spans.count("iban:") == 1 and first.spans.count("ssn:") == 1
    assert pii.report(empty).count() == 0


def test_rollup_is_additive_and_idempotent(spark, docs):
    counts = token_rollup.counted(docs)
    r = token_rollup.Rollup(spark, scratch_path(spark, "rollup-test"))
    assert r.totals().count() == 0
    key = ("source", "lang", "tokenizer")
    assert r.commit("a", token_rollup.signed(counts, new=F.col("tokens")))
    whole = sorted(map(str, taken(r.totals(), *key, "n_docs", "n_tokens")))
    assert not r.commit("a", token_rollup.signed(counts, new=F.col("tokens")))
    assert sorted(map(str, taken(r.totals(), *key, "n_docs", "n_tokens"))) == whole
    r.commit("b", token_rollup.signed(counts.where("doc_id < 10"), new=F.col("tokens") + 2, old=F.col("tokens")))
    r.commit("c", token_rollup.signed(counts.where("doc_id >= 10 OR doc_id IS NULL"), old=F.col("tokens")))
    r.commit("d", token_rollup.signed(counts.limit(0), new=F.col("tokens")))
    low = counts.where("doc_id < 10").groupBy(*key).agg(F.count("*").alias("n_docs"), F.sum(F.col("tokens") + 2).alias("n_tokens"))
    want = sorted(map(str, taken(low, *key, "n_docs", "n_tokens")))
    assert sorted(map(str, taken(r.totals(), *key, "n_docs", "n_tokens"))) == want
    assert r.compact("e") and r.committed() == ["e"] and not r.commit("b", token_rollup.signed(counts, new=F.col("tokens")))
    assert sorted(map(str, taken(r.totals(), *key, "n_docs", "n_tokens"))) == want
    toxic = counts.where("doc_id < 5")
    one = token_rollup.Rollup(spark, scratch_path(spark, "rollup-test"))
    one.commit("a", token_rollup.signed(counts, new=F.col("tokens")))
    one.commit("b", token_rollup.signed(toxic, old=F.col("tokens")))  # a deleted document leaves every version
    left = counts.where("NOT doc_id <=> 0 AND NOT coalesce(doc_id < 5, false)").groupBy(*key).agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
    assert sorted(map(str, taken(one.totals(), *key, "n_docs", "n_tokens"))) == sorted(map(str, taken(left, *key, "n_docs", "n_tokens")))
    for r in counts.join(docs.select("doc_id", "text").dropDuplicates(), "doc_id").collect():
        plain = WORD.findall(r.text or "") if r.tokenizer == "words-1" else re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+|[!-/:-@\\[-`{-~]", r.text or "")
        assert r.tokens == len(plain)
    lost = docs.where("doc_id = 5").limit(0)
    assert token_rollup.counted(lost).count() == 0


def test_url_rules(spark):
    urls = [None, "", "no scheme/net/", "http://Example.NET/en/1", "http://a.example.net", "x://net/", "http://sub.example.com/de/x?y=1#z", "https://b.org/fr/", "https://notnet/", "http://b.org?x=/fr/", "ftp://example.net/en"]
    bad = [f"http://w{i}.site.com/buy/pills/{i}?ref=1" for i in range(40)]
    good = [f"http://w{i}.site.com/read/{i}?ref=1" for i in range(40)] + [f"http://w{i}.site.com/buy/books/" for i in range(40)]
    pages = spark.createDataFrame([*enumerate([*urls, *bad, *good])], "page_id bigint, url string")
    labelled = spark.createDataFrame([(u, True) for u in bad[:30]] + [(u, False) for u in good] + [(None, True), ("http://x/", None)], "url string, bad boolean")
    got = {r.page_id: r for r in url_rules.judge(pages, labelled, support=0.05).collect()}
    want = [(None, "allow"), (None, "allow"), (None, "allow"), ("example.net/en/", "allow"), (None, "allow"), ("net/", "block"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "allow"), (None, "allow"), ("net/", "block")]
    assert [(got[i].rule, got[i].verdict) for i in range(len(urls))] == want
    assert (got[0].host, got[3].host, got[6].path, got[9].path) == ("", "example.net", "/de/x", "")
    n = len(urls)
    assert all(got[n + i].verdict == "block" for i in range(40)) and all(got[n + 40 + i].verdict == "allow" for i in range(80))
    none = labelled.limit(0)
    assert {r.verdict for r in url_rules.judge(pages.where(f"page_id >= {n}"), none).collect()} == {"allow"}
    assert url_rules.judge(pages.limit(0), labelled).count() == 0


def test_url_tokens_are_whole_and_long_rules_are_found(spark):
    row = spark.createDataFrame([("http://a.b.c.d.e.evil9.com/x/y/z/w/casino88/p7?a=1&b2=&c&d&e",)], "url string")
    got = row.select(url_rules.tokens_of(F.col("url")).alias("t")).first().t
    want = [f"h:{x}" for x in ("a", "b", "c", "d", "e", "evil0", "com")] + [f"p:{x}" for x in ("x", "y", "z", "w", "casino0", "p0")] + [f"q:{x}" for x in ("a", "b0", "c", "d", "e")]
    assert got == sorted(want)
    five = "abcde"
    bad = [f"http://h/{'/'.join(five)}"] * 20
    good = [f"http://h/{'/'.join(x for x in five if x != y)}" for y in five for _ in range(20)]
    pages = spark.createDataFrame([(0, bad[0], "k"), (0, bad[0], "k"), (1, good[0], "k"), (None, None, "k")], "page_id bigint, url string, tokens string")
    labelled = spark.createDataFrame([(u, True) for u in bad] + [(u, False) for u in good], "url string, bad boolean")
    rules = url_rules.mined_rules(labelled, 0.05, 0.8).collect()
    assert [r.tokens for r in rules] == [[f"p:{x}" for x in five]]  # no shorter list is bad, no longer one is kept
    assert sorted((r.page_id, r.verdict) for r in url_rules.judge(pages, labelled, support=0.05).collect() if r.page_id is not None) == [(0, "block"), (0, "block"), (1, "allow")]


def test_empty_tables(empty):
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    assert packing.pack(empty).count() == 0
