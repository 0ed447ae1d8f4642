"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only.

Each source gets a word budget. As many complete epochs as fit are taken of all its documents; the rest of the
budget is sampled: every document draws the exponential key -ln(u) / weight, the keys are sorted within the source
and documents are taken in this order until the prefix sum of their sizes reaches the budget.

The sort is never made of a whole source. Keys fall into ``buckets`` ranges; the sums per range, which combine before
the shuffle, say in which range the budget ends. Only documents of this one range are sorted, so a source with a
third of all rows sorts about 1/buckets of them in a task.

Edge cases: a null source is a source of its own, ordered last. Null or empty texts have size 0 and are taken 0 times.
Rows that repeat are mixed one by one; they share a key and stand side by side. Weights that are null, not finite or
below 0.001 count as 1, 1 and 0.001. An empty table gives an empty result. Other columns are left alone, whatever their
names: own values travel in structs under names that the table does not have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.common import free_name, n_words, staged, unit_hash

SEED = "mix-1"
SIZED = ("doc_id", "source", "words")


def label_weights(labels: DataFrame) -> DataFrame:
    """Sampling weight of labelled documents: 0.5 for quality 0 up to 2 for quality 1; one row per document."""
    q = F.avg(F.col("quality").cast("double"))
    return labels.groupBy("doc_id").agg((F.lit(0.5) + F.lit(1.5) * q).alias("mix_weight"))


def with_keys(docs: DataFrame, weights: DataFrame | None, buckets: int, seed: str, own: str) -> DataFrame:
    """Add the struct ``own`` (source, size, key, bucket) to every row. The bucket never falls as the key grows.

    Weights are joined by sort and merge at every size: how much is shuffled then grows in proportion to the rows.
    """
    if weights is None:
        out, given = docs, F.lit(1.0)
    else:
        name = free_name(docs, f"{own}_weight")
        out = docs.join(weights.select("doc_id", F.struct("mix_weight").alias(name)).hint("merge"), "doc_id", "left")
        given = F.col(f"{name}.mix_weight").cast("double")
    w = F.when(given.isNull() | F.isnan(given) | (given == float("inf")), 1.0).otherwise(F.greatest(given, F.lit(0.001)))
    key = -F.log(unit_hash(F.lit(seed), F.col("doc_id"))) / w
    bucket = F.least(F.floor((F.lit(1.0) - F.exp(-key)) * buckets).cast("int"), F.lit(buckets - 1))
    size = F.col("words") if docs.columns == list(SIZED) else n_words(F.col("text"))
    made = F.struct(F.col("source").alias("source"), size.alias("size"), key.alias("key"), bucket.alias("bucket"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], made.alias(own))


def sized(docs: DataFrame) -> DataFrame:
    """What the keys need, without texts."""
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("words"))


def targets(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Word targets of (source, source_size): shares by weight, none above ``max_epochs`` times its source.

    Sources that reach their limit are those with the least limit per weight. Filling them in this order, the words
    per weight left to the others first rise and then fall; the highest value is the level at which none is above.
    The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    wts = F.array(*[F.lit(float(w)) for w in weights])
    out = sizes.withColumn("w", F.element_at(wts, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    out = out.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    used = F.coalesce(F.sum("w").over(before), F.lit(0.0))
    total = F.sum("source_size").over(everything).cast("double")
    level = (total - full) / (F.sum("w").over(everything) - used)
    out = out.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return out.select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def budgets(keyed: DataFrame, own: str, weights: tuple[int, ...], max_epochs: int, buckets: int) -> DataFrame:
    """One row per source: its size and target, complete epochs, the words left to sample, the range where they end."""
    sums = keyed.groupBy(f"{own}.source", F.col(f"{own}.bucket").alias("bucket")).agg(F.sum(f"{own}.size").alias("n"))
    sums = staged(sums, "mix-sums")
    goal = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, max_epochs)
    whole = F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))
    goal = goal.withColumn("epochs", F.coalesce(F.floor(whole), F.lit(0)).cast("bigint"))
    rest = F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + F.lit(0.5))
    goal = goal.withColumn("rest", F.greatest(F.lit(0), rest).cast("bigint"))
    run = Window.partitionBy("source").orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("n").over(run))
    s, g = sums.alias("s"), goal.alias("g")
    met = g.join(s, F.col("g.source").eqNullSafe(F.col("s.source")) & (F.col("s.upto") > F.col("g.rest")), "left")
    first = F.min(F.struct("s.bucket", (F.col("s.upto") - F.col("s.n")).alias("before")))
    out = met.groupBy("g.source", "g.source_size", "g.target", "g.epochs", "g.rest").agg(first.alias("edge"))
    return staged(out.select(F.struct(
        "source", "source_size", "target", "epochs", "rest", F.coalesce("edge.bucket", F.lit(buckets)).alias("edge"), F.col("edge.before").alias("before"),
    ).alias("goal")), "mix-budgets")


def take(keyed: DataFrame, own: str, budget: DataFrame, cut_last: bool) -> DataFrame:
    """Add the structs goal (of the row's source) and taken (words: those taken of the row) under names behind ``own``.
    ``cut_last``: the document in which a budget ends is taken in part; otherwise it is taken whole if that brings the
    source nearer to its target, else not."""
    goal, taken = f"{own}_goal", f"{own}_taken"
    me = {c: F.col(f"{own}.{c}") for c in ("source", "size", "key", "bucket")}
    of = {c: F.col(f"{goal}.{c}") for c in ("source", "epochs", "rest", "edge", "before")}
    rows = keyed.join(budget.select(F.col("goal").alias(goal)), me["source"].eqNullSafe(of["source"]))
    epochs = of["epochs"] * me["size"]
    sure = rows.where(me["bucket"] != of["edge"])
    sure = sure.withColumn(taken, epochs + F.when(me["bucket"] < of["edge"], me["size"]).otherwise(0))
    order = Window.partitionBy(me["source"], me["bucket"]).orderBy(me["key"], "doc_id", me["size"])
    running = F.sum(me["size"]).over(order.rowsBetween(Window.unboundedPreceding, 0))
    left = of["rest"] - of["before"] - (running - me["size"])
    part = F.greatest(F.lit(0), F.least(me["size"], left)) if cut_last else F.when(me["size"] <= 2 * left, me["size"]).otherwise(0)
    return sure.unionByName(rows.where(me["bucket"] == of["edge"]).withColumn(taken, epochs + part))


def own_name(docs: DataFrame) -> str:
    """A name for the struct of own values such that no column of the table has it or begins with it."""
    name = "mix"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    return name


def mix(
    docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3,
    buckets: int = 1024, seed: str = SEED,
) -> DataFrame:
    """Decisions for every row of ``docs`` (doc_id, text, source): size, source_size, target, taken, epochs.

    ``weights`` go to the sources in order of their names, again from the first when they end. ``quality`` has
    (doc_id, mix_weight), one row per document. Only sizes and keys are shuffled, no texts.
    """
    keyed = staged(with_keys(sized(docs), quality, buckets, seed, "mix"), "mix-keys")
    goal = budgets(keyed, "mix", weights, max_epochs, buckets)
    return take(keyed, "mix", goal, True).select(
        "doc_id", "source", F.col("mix.size").alias("size"), F.col("mix_goal.source_size").alias("source_size"),
        F.col("mix_goal.target").alias("target"), F.col("mix_taken").cast("bigint").alias("taken"),
        F.col("mix_goal.epochs").alias("epochs"),
    )


def mixed_documents(
    docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3,
    buckets: int = 1024, seed: str = SEED,
) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, whole documents only, same columns."""
    own = own_name(docs)
    goal = budgets(with_keys(sized(docs), quality, buckets, seed, own), own, weights, max_epochs, buckets)
    rows = take(with_keys(docs, quality, buckets, seed, own), own, goal, False)
    size, taken = F.col(f"{own}.size"), F.col(f"{own}_taken")
    times = F.when(size > 0, taken / size).otherwise(0).cast("int")
    copies = rows.withColumn(f"{own}_times", times).where(F.col(f"{own}_times") > 0)
    copies = copies.withColumn(f"{own}_copy", F.explode(F.sequence(F.lit(1), F.col(f"{own}_times"))))
    return copies.select(*[F.col(f"`{c}`") for c in docs.columns])
