"""Secret scans by multipart credential linking. DataFrame functions only.

Parts are found by patterns, as spans of code points: base kinds (assigned secrets, access identifiers, long hex) stay
whatever stands around them; weak kinds (named identifiers, blobs that look like keys, endpoints) are parts of a
credential only beside others. A scope is a paragraph of one document; inside it an interval join over the parts'
starts (a range frame of ``reach`` code points to both sides) says which complementary parts co-occur. A weak
identifier is reported beside a secret, a blob beside an identifier, an endpoint beside both. A blob inside a base
span is part of that span and no finding of its own.

Texts are never shuffled. Documents whose parts cannot be related are finished in the first pass; of the others only the
parts travel, by (document, scope), and a frame holds the parts of ``reach`` code points, so no pairs are formed.

All patterns run in time linear in the text: repetitions are possessive and runs start only where no run goes on.

Edge cases: a null text counts as empty. Every row is a document of its own, so repeats, null ids and ties do not matter.
Parts at one start come in the order of their kinds. An empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.common import staged
from tidebar.llm.pii import ends_of, matches

REACH = 300
VALUE = "[A-Za-z0-9+/_.=-]"
NAMED = r"""["']?\x20*[:=]\x20*["']?"""
ID, SECRET, ENDPOINT = "id", "secret", "endpoint"
# The same break between scopes in both forms: a line of blanks only.
BREAK, BREAK_PLAIN = r"\n[\x20\t\r]*+\n", r"\n[\x20\t\r]*\n"


def folded(word: str) -> str:
    """A pattern for ``word`` with letters in either case, for engines whose case folding goes beyond A-Z."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


SECRET_NAMES = "|".join(map(folded, ("password", "passwd", "secret", "token", "api_?key")))
ID_NAMES = "|".join(map(folded, ("client_?id", "key_?id", "account_?id", "user_?name", "login")))


@dataclass(frozen=True)
class Part:
    """``pattern``: linear form for Java. ``plain``: what it matches, as any engine reads it. ``hint``: a text without
    a match of it has no match of the pattern. ``valid``: which matches are parts."""

    name: str
    pattern: str
    plain: str
    hint: str
    valid: Callable[[Column], Column]
    role: str
    weak: bool = False


def value_of(hit: Column) -> Column:
    return F.regexp_extract(hit, rf"^(?:{SECRET_NAMES}){NAMED}({VALUE}+)", 1)


PARTS = (
    Part(
        "assign", rf"(?:{SECRET_NAMES}){NAMED}{VALUE}++", rf"(?:{SECRET_NAMES}){NAMED}{VALUE}+",
        r"(?i)(?:passw(?:or)?d|secret|token|api_?key)[\"']?\x20*+[:=]", lambda h: F.length(value_of(h)) >= 8, SECRET,
    ),
    Part("access", "AKIA[A-Z0-9]{12,}+", "AKIA[A-Z0-9]{12,}", "AKIA", lambda h: F.lit(True), ID),
    Part("hex", "(?<![0-9a-f])[0-9a-f]{32,}+", "[0-9a-f]{32,}", "(?<![0-9a-f])[0-9a-f]{32}", lambda h: F.lit(True), SECRET),
    Part(
        "ident", rf"(?:{ID_NAMES}){NAMED}[A-Za-z0-9_.@-]++", rf"(?:{ID_NAMES}){NAMED}[A-Za-z0-9_.@-]+",
        r"(?i)(?:_?id|_?name|login)[\"']?\x20*+[:=]", lambda h: F.lit(True), ID, True,
    ),
    Part(
        "blob", "(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}+", "[A-Za-z0-9+/]{40,}", "(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}",
        lambda h: (F.length(h) <= 64) & h.rlike("[A-Z]") & h.rlike("[a-z]") & h.rlike("[0-9]"), SECRET, True,
    ),
    Part("endpoint", r"https?://[A-Za-z0-9.-]++", r"https?://[A-Za-z0-9.-]+", "https?://", lambda h: F.lit(True), ENDPOINT, True),
)


def related(prefix: str, parts: tuple[Part, ...]) -> Column:
    """Whether a document has a weak part, or an identifier and a secret."""
    def some(wanted: Callable[[Part], bool]) -> Column:
        return sum((F.size(f"{prefix}{k.name}") for k in parts if wanted(k)), F.lit(0)) > 0

    return some(lambda k: k.weak) | (some(lambda k: k.role == ID) & some(lambda k: k.role == SECRET))


def with_parts(cut: DataFrame, no: int, name: str, valid: Callable[[Column], Column]) -> DataFrame:
    """Add s_<name>, the parts (start, kind, end) of one kind, from its pieces p_<name> and matches h_<name>."""
    p, h, e = F.col(f"p_{name}"), F.col(f"h_{name}"), F.col(f"e_{name}")
    out = cut.withColumn(f"l_{name}", F.transform(h, lambda x, i: F.length(F.get(p, i)) + F.length(x)))
    out = out.withColumn(f"e_{name}", F.when(F.size(f"l_{name}") > 0, ends_of(F.col(f"l_{name}"))))

    def placed(x: Column, i: Column) -> Column:
        end = F.get(e, i).cast("bigint")
        return F.struct((end - F.length(x)).cast("bigint").alias("start"), F.lit(no).alias("kind"), end.alias("end"), valid(x).alias("ok"))

    spans = F.filter(F.transform(h, placed), lambda s: s["ok"])
    return out.withColumn(f"s_{name}", F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))


def parts_of(docs: DataFrame, parts: tuple[Part, ...] = PARTS) -> DataFrame:
    """(row, doc_id, s_<kind> ..., s_break): all parts of every row of ``docs`` (doc_id, text); breaks where parts can be related."""
    out = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for k in parts:
        pieces, hits = matches(F.col("text"), k.pattern, k.hint)
        out = out.withColumn(f"p_{k.name}", pieces).withColumn(f"h_{k.name}", hits)
    none, several = F.array().cast("array<string>"), related("h_", parts)
    out = out.withColumn("p_break", F.when(several, F.split("text", BREAK, -1)).otherwise(none))
    out = out.withColumn("h_break", F.when(several, F.regexp_extract_all("text", F.lit(BREAK), F.lit(0))).otherwise(none)).drop("text")
    for i, k in enumerate(parts):
        out = with_parts(out, i, k.name, k.valid)
    out = with_parts(out, len(parts), "break", lambda h: F.lit(True))
    return out.select("row", "doc_id", *[f"s_{k.name}" for k in parts], "s_break")


def is_any(kind: Column, parts: tuple[Part, ...], wanted: Callable[[Part], bool]) -> Column:
    return kind.isin([i for i, k in enumerate(parts) if wanted(k)])


def linked(found: DataFrame, parts: tuple[Part, ...] = PARTS, reach: int = REACH) -> DataFrame:
    """Every part in a document where parts can be related: row, doc_id, scope, start, kind, end, and which roles stand within
    reach (near_id, near_secret, near_endpoint), with the nearest identifier and endpoint before or behind."""
    every = F.concat(*[F.col(f"s_{k.name}") for k in parts], F.col("s_break"))
    kind = F.col("kind")
    rows = found.where(related("s_", parts)).select("row", "doc_id", F.inline(every))
    order = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("scope", F.sum((kind == len(parts)).cast("int")).over(order))
    base_end = F.max(F.when(is_any(kind, parts, lambda k: not k.weak), F.col("end"))).over(order)
    rows = rows.withColumn("inside", is_any(kind, parts, lambda k: k.weak and k.role == SECRET) & (F.coalesce(base_end, F.lit(0)) > F.col("start")))
    rows = rows.where((kind < len(parts)) & ~F.col("inside")).drop("inside")
    scope = Window.partitionBy("row", "scope")
    near = scope.orderBy("start").rangeBetween(-reach, reach)
    before = scope.orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    behind = scope.orderBy("start", "kind").rowsBetween(1, Window.unboundedFollowing)
    me = F.struct("start", "kind", "end")
    for role in (ID, SECRET, ENDPOINT):
        there = is_any(kind, parts, lambda k, role=role: k.role == role)
        rows = rows.withColumn(f"near_{role}", F.max(there).over(near))
        if role != SECRET:
            x, y = (f(F.when(there, me), ignorenulls=True).over(w) for f, w in ((F.last, before), (F.first, behind)))
            rows = rows.withColumn(f"x_{role}", x).withColumn(f"y_{role}", y)
    at = F.col("start")
    for role in (ID, ENDPOINT):
        x, y = (F.when(F.abs(F.col(f"{c}_{role}.start") - at) <= reach, F.col(f"{c}_{role}")) for c in "xy")
        closer = x.isNotNull() & (y.isNull() | (at - x["start"] <= y["start"] - at))
        rows = rows.withColumn(f"the_{role}", F.when(closer, x).otherwise(y)).drop(f"x_{role}", f"y_{role}")
    return rows


def supported(parts: tuple[Part, ...]) -> Column:
    """Whether a weak part has the complementary parts that it needs."""
    kind, has_id, has_secret = F.col("kind"), F.col("near_id"), F.col("near_secret")
    needs = {ID: has_secret, SECRET: has_id, ENDPOINT: has_id & has_secret}
    out = F.lit(False)
    for role, need in needs.items():
        out = out | (is_any(kind, parts, lambda k, role=role: k.weak and k.role == role) & need)
    return out


def credentials(docs: DataFrame, parts: tuple[Part, ...] = PARTS, reach: int = REACH) -> DataFrame:
    """(doc_id, secret, identifier, endpoint): each secret with the nearest identifier of its scope, and the endpoint if
    there is one; spans are (kind, start, end). Secrets without identifier are no credential."""
    def named(s: str) -> Column:
        names = F.array(*[F.lit(k.name) for k in parts])
        made = F.struct(F.get(names, F.col(f"{s}kind")).alias("kind"), F.col(f"{s}start").alias("start"), F.col(f"{s}end").alias("end"))
        return F.when(F.col(f"{s}kind").isNotNull(), made)

    found = staged(parts_of(docs, parts), "secret-parts")
    rows = linked(found, parts, reach).where(is_any(F.col("kind"), parts, lambda k: k.role == SECRET) & F.col("the_id").isNotNull())
    return rows.select("doc_id", named("").alias("secret"), named("the_id.").alias("identifier"), named("the_endpoint.").alias("endpoint"))


def written(spans: Column, parts: tuple[Part, ...]) -> Column:
    """kind:start:end of the parts, by start and kind, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in parts])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame, parts: tuple[Part, ...] = PARTS, reach: int = REACH) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, digest of the base spans, all spans, how many are added, and how many
    secrets have an identifier in reach."""
    found = staged(parts_of(docs, parts), "secret-parts")
    rows = linked(found, parts, reach)
    secret = is_any(F.col("kind"), parts, lambda k: k.role == SECRET)
    added = rows.groupBy("row").agg(
        F.collect_list(F.when(supported(parts), F.struct("start", "kind", "end"))).alias("added"),
        F.count_if(secret & F.col("near_id")).alias("linked"),
    )
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    more = found.where(related("s_", parts)).join(added, "row")
    rest = found.where(~related("s_", parts)).withColumn("added", none).withColumn("linked", F.lit(0).cast("bigint"))
    out = more.unionByName(rest)
    base = F.concat(*[F.col(f"s_{k.name}") for k in parts if not k.weak])
    return out.select(
        "doc_id", *[F.size(f"s_{k.name}").cast("bigint").alias(f"n_{k.name}") for k in parts if not k.weak],
        F.sha2(written(base, parts), 256).alias("base_sha256"), written(F.concat(base, F.col("added")), parts).alias("spans"),
        F.size("added").cast("bigint").alias("n_added"), F.col("linked").cast("bigint").alias("n_linked"),
    )
