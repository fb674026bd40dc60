"""Mixing sources to target weights (problem 9).

Hierarchical budgeting over a domain-language-source tree. A leaf is one (domain, language,
source): a source that writes in several languages or domains has several leaves, among
which its weight is divided by their tokens. The total is given, or is the largest at which every
source with tokens reaches its share (of the shares of such sources) within its repeats; then
nothing is short. With a larger total, what a leaf can't give is passed on by weight, as far as
there is room: first to the source's other leaves, then to its siblings (other sources of the
same domain and language), then within the domain, then to all.

A leaf's budget is whole epochs of its documents and a token-prefix of one more, in the
order of a hash of (seed, epoch, document); the prefix ends at the document boundary that is
nearest to the budget. What a source's prefixes miss or exceed together goes to its largest
leaf, so a source is off by half a document, not each leaf. Prefix sums run over 4,096 hash
ranges a leaf and then inside each, so no leaf is ever sorted in one task.

Sources that aren't listed, null sources and documents without tokens are left out. A share
of 0 or null, a null or non-positive ``max_repeats`` gives an empty budget. A source listed
with a share but without tokens appears in the report with nothing reached. A null domain
is the domain "", a null language "und".
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from velatura.session import stage

RANGES = 4096
MAX_LEAVES = 100_000


def _give(leaves: list[dict], extra: float) -> float:
    """Spread ``extra`` over the leaves by weight within their room; returns what is left."""
    while extra > 1e-9:
        room = [x for x in leaves if x["cap"] - x["budget"] > 1e-9 and x["weight"] > 0]
        total = sum(x["weight"] for x in room)
        if not total:
            break
        left = 0.0
        for x in room:
            more = extra * x["weight"] / total
            fits = min(more, x["cap"] - x["budget"])
            x["budget"] += fits
            left += more - fits
        if left >= extra - 1e-12:
            break
        extra = left
    return extra


def budgets(leaves: list[dict], total: float | None = None) -> list[dict]:
    """Adds ``budget`` to leaves with domain, lang, source, size, weight and repeats."""
    for x in leaves:
        x["weight"] = max(0.0, x["weight"] or 0.0)
        x["cap"] = float(x["size"] * max(0, x["repeats"] or 0))
    if total is None:
        for x in leaves:
            x["weight"] *= x["cap"] > 0
        whole = sum(x["weight"] for x in leaves) or 1.0
        for x in leaves:
            x["weight"] /= whole
        caps, weights = defaultdict(float), defaultdict(float)
        for x in leaves:
            caps[x["source"]] += x["cap"]
            weights[x["source"]] += x["weight"]
        total = min((caps[s] / w for s, w in weights.items() if w > 0 and caps[s] > 0), default=0.0)
    for x in leaves:
        want = total * x["weight"]
        x["budget"] = min(want, x["cap"])
        x["short"] = want - x["budget"]
    # the shortage of each leaf climbs from its source's leaves to the whole tree
    for level in (("source",), ("domain", "lang"), ("domain",), ()):
        groups: dict[tuple, list[dict]] = defaultdict(list)
        for x in leaves:
            groups[tuple(x[k] for k in level)].append(x)
        for group in groups.values():
            short = sum(x["short"] for x in group)
            if short > 1e-9:
                rest = _give(group, short)
                for x in group:  # what is left stays with those that were short
                    x["short"] *= rest / short
    return leaves


_KEY = ["source", "domain", "lang"]
_LEAF = T.StructType([T.StructField("source", T.StringType()), T.StructField("domain", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("target_share", T.DoubleType()), T.StructField("max_repeats", T.IntegerType()), T.StructField("size", T.LongType()), T.StructField("budget", T.DoubleType()), T.StructField("full", T.LongType()), T.StructField("rest", T.DoubleType())])


def _placed_in_tree(docs: DataFrame) -> DataFrame:
    return docs.withColumn("domain", F.coalesce(F.col("domain").cast("string"), F.lit(""))).withColumn("lang", F.coalesce(F.lower("lang"), F.lit("und")))


def leaf_budgets(docs: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """One row a leaf of a listed source: its size, budget, whole epochs and rest."""
    cells = docs.groupBy(*_KEY).agg(F.sum("tokens").alias("size"))
    listed = targets.where("source IS NOT NULL").groupBy("source").agg(F.first("target_share").alias("target_share"), F.first("max_repeats").alias("max_repeats"))
    rows = listed.join(cells, "source", "left").limit(MAX_LEAVES + 1).collect()
    if len(rows) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    whole: dict[str, int] = defaultdict(int)
    for r in rows:
        whole[r.source] += r["size"] or 0
    leaves = []
    for r in sorted(rows, key=lambda r: (r.source, r.domain or "", r.lang or "")):
        size, share = r["size"] or 0, r.target_share or 0.0
        part = size / whole[r.source] if whole[r.source] else 1.0
        leaves.append({"source": r.source, "domain": r.domain or "", "lang": r.lang or "", "size": size, "weight": share * part, "share": r.target_share, "repeats": r.max_repeats})
    out = []
    for x in budgets(leaves, total):
        full = int((x["budget"] + 1e-6) // x["size"]) if x["size"] else 0
        out.append((x["source"], x["domain"], x["lang"], x["share"], x["repeats"], x["size"], x["budget"], full, max(0.0, x["budget"] - full * x["size"])))
    return docs.sparkSession.createDataFrame(out, _LEAF)


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(rows, leaves): each used document of (id, source, domain, lang, tokens) with its ``uses``."""
    docs = docs.where("tokens > 0 AND source IS NOT NULL").join(targets.select("source").distinct(), "source", "left_semi")
    docs = _placed_in_tree(docs.select("id", "source", "domain", "lang", "tokens"))
    leaves = leaf_budgets(docs, targets, total)
    rows = docs.join(leaves.select(*_KEY, "full", "rest"), _KEY).withColumn("h", F.xxhash64(F.lit(seed), "full", "id"))
    rows = rows.withColumn("range", F.shiftrightunsigned("h", 52))
    ranges = rows.groupBy(*_KEY, "range").agg(F.sum("tokens").alias("t"))
    before = Window.partitionBy(*_KEY).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    start = ranges.select(*_KEY, "range", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*_KEY, "range").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # both sides are in the same partitions: the window and the join take one shuffle
    placed = rows.withColumn("upto", F.sum("tokens").over(inside)).join(start, [*_KEY, "range"]).withColumn("upto", F.col("upto") + F.col("start"))
    placed = stage(placed.select("id", *_KEY, "tokens", "full", "rest", "upto"), "mix-order")
    within = lambda rest: (rest > 0) & (F.col("upto") - F.col("tokens") / 2 <= rest)
    # one row a leaf: what its prefix gives beyond the budget
    given = placed.groupBy(*_KEY).agg(F.sum(F.when(within(F.col("rest")), F.col("tokens")).otherwise(0)).alias("given"))
    over = leaves.join(given, _KEY).select(*_KEY, "size", (F.col("given") - F.col("rest")).alias("over"))
    largest = over.groupBy("source").agg(F.max_by(F.struct("domain", "lang", "over"), F.struct("size", "domain", "lang")).alias("x"), F.sum("over").alias("all"))
    shift = largest.select("source", "x.domain", "x.lang", (F.col("all") - F.col("x.over")).alias("shift")).join(leaves, _KEY)
    room = (F.col("max_repeats") - F.col("full")) * F.col("size")  # never more than the repeats allow
    evened = shift.select(*_KEY, F.least(F.col("rest") - F.col("shift"), room.cast("double")).alias("evened"))
    ends = placed.join(evened, _KEY, "left").withColumn("rest", F.coalesce("evened", "rest"))
    used = ends.select("id", "source", "domain", "lang", "tokens", (F.col("full") + F.when(within(F.col("rest")), 1).otherwise(0)).cast("int").alias("uses")).where("uses > 0")
    return used, leaves


def shares(used: DataFrame, leaves: DataFrame) -> DataFrame:
    """The share that each listed source really reaches."""
    per = used.groupBy("source").agg(F.count("*").alias("documentos"), F.sum("uses").alias("usos"), F.max("uses").alias("mais_usos"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens"))
    sources = leaves.groupBy("source").agg(F.first("target_share").alias("target_share"), F.first("max_repeats").alias("max_repeats"), F.count("*").alias("folhas"), F.sum("budget").alias("orcamento"))
    total = per.agg(F.sum("tokens").alias("total"))  # one row
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return (
        sources.join(per, "source", "left")
        .join(F.broadcast(total), F.lit(True), "left")
        .select("source", "target_share", "max_repeats", "folhas", zero("documentos"), zero("usos"), zero("mais_usos"), zero("tokens"), F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("parcela"), "orcamento")
    )
