"""Lines repeated across the documents of one source (problem 4).

A line is its text without letter case, white space and digits; it counts once per
record. Its frequency inside the source is compared with one outside by a log-likelihood
ratio. ``exp(-G/2)`` bounds the tail of the statistic from above; the Benjamini-Hochberg rule on
these bounds keeps the share of false discoveries under ``fdr``. A significant line is repeated
excessively when it also stands in at least ``min_share`` and ``min_records`` of the records
of its source. There are two outsides (``against``):

* ``line``: the same line in the other sources. A line that all sources use alike is no line
  of any of them: the ratio rejects it, however frequent it is.
* ``ordinary``: also an ordinary line (the mean over all lines of the other sources), so that
  a notice that several sources share counts in each. The ratio then rejects only lines that
  are no more frequent than lines are in general, as in a corpus of forms.

Records with a null text count in the total of their source. A null source is a source
of its own. Blank lines and lines without a letter are never cases. Each row is a record.
With a single source the outside is empty and any repetition is in excess.

The lines are shuffled once, as counts of (source, line). The places are found inside each
record, against the excess lines of its source, while these are at most ``BROADCAST_LINES`` in all;
beyond, the lines are joined with them by (source, line) in ``SALT`` salted copies, as a hot
line of a hot source may stand in a third of all records. Texts never go through that join.
"""

from __future__ import annotations

from math import exp, inf

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from velatura.session import stage

_NO_SOURCE = "\u0000"
#: Excess lines that are sent to every task, at most.
BROADCAST_LINES = 100_000
SALT = 16


def line_key(line: Column) -> Column:
    """The line without letter case, white space and digits; null when it has no letter."""
    return F.when(line.rlike(r"\p{L}"), F.regexp_replace(F.lower(line), r"(?U)[\s\p{Z}\d]+", ""))


def _lines(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("doc"), F.coalesce(F.col(source_col).cast("string"), F.lit(_NO_SOURCE)).alias("src"), F.split(F.col(text_col), "\n", -1).alias("lines"))


def _g(a: Column, n: Column, b: Column, m: Column) -> Column:
    """Log-likelihood ratio of a of n against b of m."""
    part = lambda x, e: F.when((x > 0) & (e > 0), x * F.ln(x / e)).otherwise(0.0)
    p = (a + b) / (n + m)
    return 2 * (part(a, n * p) + part(n - a, n * (1 - p)) + part(b, m * p) + part(m - b, m * (1 - p)))


def excess_lines(df: DataFrame, id_col: str, text_col: str, source_col: str, min_share: float = 0.05, min_records: int = 10, fdr: float = 0.01, against: str = "ordinary") -> DataFrame:
    """(src, key, k, total, g): the significant excess lines of each source."""
    lines = _lines(df, id_col, text_col, source_col)
    totals = lines.groupBy("src").agg(F.count("*").alias("total"))
    keys = lines.select("src", F.explode(F.array_distinct(F.transform("lines", line_key))).alias("key")).where("key IS NOT NULL")
    counts = keys.groupBy("src", "key").agg(F.count("*").alias("k"))
    # at most one row a source in each partition of the window
    alike = Window.partitionBy("key")
    counts = stage(counts.select("src", "key", "k", F.sum("k").over(alike).alias("k_all"), F.count("*").over(alike).alias("in_sources")), "line-counts")
    # the number of records, of lines in records, and of different lines
    n_all = totals.agg(F.sum("total")).first()[0] or 0
    k_sum, n_keys = (x or 0 for x in counts.agg(F.sum("k"), F.round(F.sum(1 / F.col("in_sources")))).first())
    tests = counts.join(totals, "src")
    a, n = F.col("k").cast("double"), F.col("total").cast("double")
    b, m = (F.col("k_all") - F.col("k")).cast("double"), (F.lit(float(n_all)) - F.col("total"))
    # the mean of the other lines; a source that is (nearly) alone meets an outside of its own size
    ordinary = (F.lit(float(k_sum)) - F.col("k_all")) / max(1, n_keys - 1) / max(1, n_all)
    out = F.greatest(m, n)
    same = F.when((m > 0) & (a * m > b * n), _g(a, n, b, m)).otherwise(F.lit(0.0))
    if against == "ordinary" or n_all == 0:
        usual = F.when(a > n * ordinary, _g(a, n, out * ordinary, out)).otherwise(F.lit(0.0))
        same = F.greatest(same, usual)
    else:  # alone: the line meets none outside
        same = F.when(m > 0, same).otherwise(_g(a, n, F.lit(0.0), n))
    tests = tests.select("src", "key", "k", "total", same.alias("g"))
    # histogram of the statistic in steps of 0.1 up to 2000: bounded, whatever the corpus
    hist = {r.step: r["n"] for r in tests.groupBy(F.least(F.floor(F.col("g") * 10), F.lit(20000)).alias("step")).agg(F.count("*").alias("n")).collect()}
    n_tests, above, least = sum(hist.values()), 0, inf
    for step in sorted(hist, reverse=True):
        above += hist[step]
        if 2 * exp(-step / 20) <= fdr * above / n_tests:
            least = step / 10
    return tests.where((F.col("g") >= least) & (F.col("k") >= min_records) & (F.col("k") >= min_share * F.col("total") - 1e-9))


def _places(df: DataFrame, id_col: str, text_col: str, source_col: str, broadcast_lines: int, how: dict, texts: bool = True) -> DataFrame:
    """(doc, lines, at): each record's lines and the places of its excess lines; without ``texts`` (doc, linha)."""
    found = stage(excess_lines(df, id_col, text_col, source_col, **how).select("src", "key"), "excess-lines")
    rows = _lines(df, id_col, text_col, source_col)
    none = F.array().cast("array<int>")
    one = lambda rows, *cols: rows.select(*cols, "src", F.posexplode("lines").alias("linha", "line")).select(*cols, "src", "linha", line_key(F.col("line")).alias("key")).where("key IS NOT NULL")
    if found.count() <= broadcast_lines and not texts:
        return one(rows, "doc").join(F.broadcast(found), ["src", "key"], "left_semi")
    if found.count() <= broadcast_lines:
        keys = F.broadcast(found.groupBy("src").agg(F.collect_list("key").alias("keys")))
        at = F.filter(F.transform("lines", lambda x, i: F.when(F.array_contains("keys", line_key(x)), i)), lambda i: i.isNotNull())
        return rows.join(keys, "src", "left").select("doc", "lines", F.coalesce(F.when(F.col("keys").isNotNull(), at), none).alias("at"))
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "line-records")
    lines = one(rows, "row", *[] if texts else ["doc"])
    copies = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    hits = lines.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int")).join(copies, ["src", "key", "salt"], "left_semi")
    if not texts:
        return hits
    per = hits.groupBy("row").agg(F.array_sort(F.collect_list("linha")).alias("at"))
    return rows.join(per, "row", "left").select("doc", "lines", F.coalesce("at", none).alias("at"))


def excess_places(df: DataFrame, id_col: str, text_col: str, source_col: str, broadcast_lines: int = BROADCAST_LINES, **how) -> DataFrame:
    """(id, linha): every occurrence of an excess line."""
    places = _places(df, id_col, text_col, source_col, broadcast_lines, how, texts=False)
    return places.select(F.col("doc").alias(id_col), "linha")


def without_excess(df: DataFrame, id_col: str, text_col: str, source_col: str, broadcast_lines: int = BROADCAST_LINES, **how) -> DataFrame:
    """(id, texto): each text without its excess lines, the other lines in their order."""
    keep = F.filter("lines", lambda x, i: ~F.array_contains("at", i))
    return _places(df, id_col, text_col, source_col, broadcast_lines, how).select(F.col("doc").alias(id_col), F.array_join(keep, "\n").alias("texto"))
