"""Near-duplicate titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.catalog.base import cte, query
from tidebar.catalog.q_functions import TOKENS
from tidebar.operators import selection, similarity

cte("title_sets", f"""
SELECT toks, min(doc_id) AS id FROM (SELECT doc_id, {TOKENS} AS toks FROM headlines) WHERE len(toks) > 0 GROUP BY toks""")


@query("j14_similar_pairs", "a:i b:i jaccard:7", """
WITH z AS MATERIALIZED (SELECT id, toks, len(toks) AS n FROM title_sets WHERE len(toks) >= 4),
p AS (SELECT x.id AS a, y.id AS b, x.n + y.n AS n, len(list_intersect(x.toks, y.toks)) AS k FROM z x JOIN z y ON x.id < y.id AND least(x.n, y.n) >= 0.6 * greatest(x.n, y.n))
SELECT a, b, k / (n - k) AS jaccard FROM p WHERE k / (n - k) >= 0.6""")
def _j14(t):
    return similarity.near_duplicate_pairs(t.headlines, "title", "doc_id")


def _prefer():
    return [F.when(F.col("feed") == "curated", 0).otherwise(1), -F.unix_micros("t")]


def collapsed(t):
    return similarity.collapse(t.headlines, "title", "doc_id", _prefer())


# The recursion runs over the sets that have a similar set, in order of preference.
def greedy(src: str) -> str:
    return f"""
WITH RECURSIVE f AS MATERIALIZED (SELECT doc_id, feed, {TOKENS} AS toks, (CASE WHEN feed = 'curated' THEN 0 ELSE 1 END, -epoch_us(t), doc_id) AS pref FROM {src}),
z AS MATERIALIZED (SELECT arg_min(doc_id, pref) AS id, min(pref) AS pref, toks, len(toks) AS n FROM f WHERE len(toks) > 0 GROUP BY toks),
p AS (SELECT x.id AS a, y.id AS b, x.n + y.n AS n, len(list_intersect(x.toks, y.toks)) AS k FROM z x JOIN z y
  ON x.pref < y.pref AND x.n >= 4 AND y.n >= 4 AND least(x.n, y.n) >= 0.6 * greatest(x.n, y.n)),
e AS MATERIALIZED (SELECT a, b FROM p WHERE k / (n - k) >= 0.6),
o AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY pref) AS i FROM z WHERE id IN (SELECT a FROM e UNION SELECT b FROM e)),
nb AS MATERIALIZED (SELECT ob.i, list(oa.i) FILTER (oa.i IS NOT NULL) AS earlier FROM o ob LEFT JOIN e ON e.b = ob.id LEFT JOIN o oa ON oa.id = e.a GROUP BY ob.i),
r(i, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT nb.i, CASE WHEN earlier IS NOT NULL AND list_has_any(earlier, kept) THEN kept ELSE list_append(kept, nb.i) END FROM r JOIN nb ON nb.i = r.i + 1),
gone AS (SELECT id FROM o WHERE NOT list_contains((SELECT kept FROM r ORDER BY i DESC LIMIT 1), i))
SELECT doc_id, feed FROM f WHERE len(toks) = 0 OR doc_id IN (SELECT id FROM z WHERE id NOT IN (SELECT id FROM gone))"""


@query("x19_near_duplicate_collapse", "doc_id:i feed", greedy("headlines"))
def _x19(t):
    return collapsed(t)


cte("recent_once", """
SELECT max(doc_id) AS doc_id, title, feed, t FROM (SELECT *, max(t) OVER (PARTITION BY feed, title) AS last FROM headlines WHERE t >= (SELECT max(t) FROM headlines) - INTERVAL 48 HOUR)
WHERE t = last GROUP BY title, feed, t""")


@query("o3_recent_headlines", "doc_id:i feed", f"""
WITH g AS ({greedy('recent_once')}), r AS (SELECT doc_id, g.feed, t, row_number() OVER (PARTITION BY g.feed ORDER BY t DESC, doc_id) AS rn FROM g JOIN headlines h USING (doc_id)),
n AS (SELECT count(CASE WHEN feed = 'curated' THEN 1 END) AS cur, count(CASE WHEN feed <> 'curated' THEN 1 END) AS oth FROM r WHERE rn <= 80),
k AS (SELECT least(oth, greatest(0, 80 - least(40, cur))) AS places FROM n)
SELECT doc_id, feed FROM r CROSS JOIN k WHERE rn <= CASE WHEN feed = 'curated' THEN 80 - places ELSE places END ORDER BY t DESC, doc_id LIMIT 80""")
def _o3(t):
    """Recent window, title dedup, collapse, then the reserved-quota selection."""
    from tidebar.operators.sets import pick

    newest = t.headlines.agg(F.max("t").alias("_now"))
    recent = t.headlines.crossJoin(F.broadcast(newest)).where(F.col("t") >= F.col("_now") - F.expr("interval 48 hours")).drop("_now")
    once = pick(recent, ["feed", "title"], ["t", "doc_id"], last=True)
    pool = similarity.collapse(once, "title", "doc_id", _prefer())
    return selection.quota_top_k(pool, "feed", "curated", "t", "doc_id", 80, 40)
