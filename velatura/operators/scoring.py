"""Scores of positional masks against labelled places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from velatura.functions.text import misaligned, quote
from velatura.session import stage

# The subcategories that count
RELEVANT = ["DOCTOR", "PATIENT", "CITY", "COUNTRY", "STATE", "STREET", "HOSPITAL", "ORGANIZATION", "LOCATION_OTHER", "PHONE", "EMAIL", "ZIP", "DATE", "IDNUM", "MEDICAL_RECORD", "HEALTH_PLAN", "AGE", "PROFESSION", "OTHER"]


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def ground_truth(text: Column, labels: Column, char: str, only: list[str] | None = None) -> Column:
    """The text with every labelled place (of some subcategories) overwritten by ``char``."""
    if only is not None:
        labels = F.filter(labels, lambda r: r["subcategory"].isin(*only))
    n = F.length(text)

    def step(acc: Column, r: Column) -> Column:
        a, b = F.greatest(r["first_position"], F.lit(0)), F.least(r["last_position"], n)
        return F.when(b > a, F.overlay(acc, F.repeat(F.lit(char), b - a), a + 1, b - a)).otherwise(acc)

    return F.coalesce(F.aggregate(labels, text, step), text)


def offsets(records: DataFrame, id_col: str, length_col: str) -> DataFrame:
    """(id, n, at): where each record begins when all stand one after another, in the order of the ids.

    Ranges of ids are summed first (one row a range), so no window runs over all records.
    """
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(records.select(F.col(id_col), F.col(length_col).cast("long").alias("n")).repartitionByRange(n, id_col).withColumn("_p", F.spark_partition_id()), "offsets")
    total = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = ranged.groupBy("_p").agg(F.sum("n").alias("t")).select("_p", F.coalesce(F.sum("t").over(total), F.lit(0)).alias("s"))
    inside = Window.partitionBy("_p").orderBy(id_col).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(starts), "_p").withColumn("at", F.col("s") + F.coalesce(F.sum("n").over(inside), F.lit(0))).select(id_col, "n", "at")


def slice_pieces(records: DataFrame, pieces: DataFrame, id_col: str, length_col: str, size: int = 1 << 16) -> DataFrame:
    """(id, mascara, inteira): one continuous mask, given in numbered pieces, cut by the records' lengths.

    A record past the end of the mask is left out; one that the end cuts isn't ``inteira``.
    """
    rows = offsets(records, id_col, length_col)
    ends = F.greatest(F.col("at") + F.col("n") - 1, F.col("at"))
    need = rows.select(id_col, "n", "at", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor(ends / size))).alias("peca"))
    begin = F.greatest(F.col("at") - F.col("peca") * size, F.lit(0))
    stop = F.least(F.col("at") + F.col("n") - F.col("peca") * size, F.lit(size))
    part = F.substring("texto", (begin + 1).cast("int"), (stop - begin).cast("int"))
    held = need.join(pieces, "peca").where(begin < F.length("texto")).select(id_col, "n", "peca", part.alias("t"))
    whole = held.groupBy(id_col, "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("peca", "t"))), lambda x: x["t"]), "").alias("mascara"))
    return whole.select(id_col, "mascara", (F.length("mascara") == F.col("n")).alias("inteira"))


def slice_buffer(records: DataFrame, buffer: str, id_col: str, length_col: str, size: int = 1 << 16) -> DataFrame:
    """The same for a mask that the driver holds: (id, mascara)."""
    pieces = records.sparkSession.createDataFrame([(k // size, buffer[k : k + size]) for k in range(0, len(buffer), size)], "peca long, texto string")
    return slice_pieces(records, pieces, id_col, length_col, size).select(id_col, "mascara")


def alignment(records: DataFrame, id_col: str, text_col: str, mask_col: str, chars: tuple[str, str]) -> DataFrame:
    """One row: records with a mask of their length, records that the mask doesn't fit, and the first five of these."""
    bad = (F.length(mask_col) != F.length(text_col)) | (misaligned(F.col(text_col), F.col(mask_col), "".join(chars)) > 0)
    rows = records.where(F.col(mask_col).isNotNull()).select(F.col(id_col).alias("id"), bad.alias("bad"))
    worst = [r.id for r in rows.where("bad").orderBy("id").limit(5).collect()]  # a report of five
    kind = records.schema[id_col].dataType.simpleString()
    return rows.agg(F.count("*").alias("avaliados"), F.count_if("bad").alias("desalinhados")).withColumn("primeiros", F.array(*[F.lit(x) for x in worst]).cast(f"array<{kind}>"))


def _count(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, "[^" + "".join(quote(c) for c in chars) + "]", ""))


def verdicts(records: DataFrame, id_col: str, labels_col: str, mask_col: str, chars: tuple[str, str]) -> DataFrame:
    """(id, ordem, subcategory, word, veredito): tp, tp_unknown, fn, or total (zero length).

    A label is found when more than half of its place is masked; it is unknown if most of that
    is the second character. A place beyond the mask is a miss.
    """
    pii, unk = chars
    rows = records.where(F.size(labels_col) > 0).select(F.col(id_col), F.col(mask_col).alias("m"), F.posexplode(labels_col).alias("ordem", "r"))
    size = F.col("r.last_position") - F.col("r.first_position")
    rows = rows.withColumn("s", F.substring("m", F.col("r.first_position") + 1, size)).withColumn("p", _count(F.col("s"), pii)).withColumn("u", _count(F.col("s"), unk))
    hit = (F.col("p") + F.col("u")) / size > 0.5
    verdict = F.when(size <= 0, "total").when(F.col("r.last_position") > F.length("m"), "fn").when(hit & (F.col("p") >= F.col("u")), "tp").when(hit, "tp_unknown").otherwise("fn")
    return rows.select(id_col, "ordem", F.coalesce(F.col("r.subcategory"), F.lit("OTHER")).alias("subcategory"), F.col("r.word").alias("word"), verdict.alias("veredito"))


def residual_runs(records: DataFrame, id_col: str, text_col: str, labels_col: str, mask_col: str, chars: tuple[str, str], least: int = 3) -> DataFrame:
    """(id, ordem, ini, termo, tamanho): mask runs outside of every labelled place (false positives)."""
    from velatura.functions.patterns import places

    left = ground_truth(F.col(mask_col), F.coalesce(F.col(labels_col), F.array().cast("array<struct<word:string,category:string,subcategory:string,first_position:int,last_position:int>>")), "\u0001")
    run = "[" + "".join(quote(c) for c in chars) + f"]{{{least},}}"
    rows = records.select(F.col(id_col), F.col(text_col).alias("t"), F.posexplode(places(left, run)).alias("ordem", "x"))
    return rows.select(id_col, "ordem", F.col("x.ini").alias("ini"), F.substring("t", F.col("x.ini") + 1, F.col("x.fim") - F.col("x.ini")).alias("termo"), (F.col("x.fim") - F.col("x.ini")).alias("tamanho"))


def totals(found: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: counts and precision, recall, F1, F2."""
    v = found.agg(
        F.count("*").alias("rotulos"),
        F.count_if(F.col("veredito") == "tp").alias("tp"),
        F.count_if(F.col("veredito") == "tp_unknown").alias("tp_unknown"),
        F.count_if(F.col("veredito") == "fn").alias("fn"),
    )
    r = runs.agg(F.count("*").alias("fp"), F.coalesce(F.sum("tamanho"), F.lit(0)).cast("long").alias("fp_chars"))
    return with_scores(v.join(r, F.lit(True)))  # one row each


def rounded(scores: DataFrame, places: int = 4) -> DataFrame:
    """The scores as they are reported."""
    return scores.select(*[F.round(c, places).alias(c) if c in ("precision", "recall", "f1", "f2") else c for c in scores.columns])


def error_views(records: DataFrame, id_col: str, text_col: str, labels_col: str, mask_col: str, chars: tuple[str, str], least: int = 3) -> DataFrame:
    """(id, fp_visual, fn_visual): the text with all but the false positives, or all but the missed labels, blotted out."""
    text, blot = F.col(text_col), F.regexp_replace(F.col(text_col), r"(?s)[^\n]", ".")
    show = lambda spans: F.aggregate(spans, blot, lambda acc, x: F.overlay(acc, F.substring(text, x["ini"] + 1, x["fim"] - x["ini"]), x["ini"] + 1, x["fim"] - x["ini"]))
    kind = "array<struct<ini:int,fim:int>>"
    wrong = residual_runs(records, id_col, text_col, labels_col, mask_col, chars, least).select(id_col, F.struct("ini", (F.col("ini") + F.col("tamanho")).alias("fim")).alias("x")).groupBy(id_col).agg(F.collect_list("x").alias("fp"))
    missed = verdicts(records, id_col, labels_col, mask_col, chars).where("veredito = 'fn'").groupBy(id_col).agg(F.collect_set("ordem").alias("perdidos"))
    rows = records.join(wrong, id_col, "left").join(missed, id_col, "left")
    spot = lambda i: F.element_at(labels_col, i + 1)
    places = F.transform("perdidos", lambda i: F.struct(F.greatest(spot(i)["first_position"], F.lit(0)).alias("ini"), F.least(spot(i)["last_position"], F.length(text)).alias("fim")))
    fn = F.filter(F.coalesce(places, F.array().cast(kind)), lambda x: x["fim"] > x["ini"])
    return rows.select(id_col, show(F.coalesce(F.col("fp").cast(kind), F.array().cast(kind))).alias("fp_visual"), show(fn).alias("fn_visual"))


def with_scores(df: DataFrame) -> DataFrame:
    hit = F.col("tp") + F.col("tp_unknown")
    p, r = ratio(hit, hit + F.col("fp")), ratio(hit, hit + F.col("fn"))
    return df.withColumn("precision", p).withColumn("recall", r).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("f2", ratio(5 * F.col("precision") * F.col("recall"), 4 * F.col("precision") + F.col("recall")))


def by_category(found: DataFrame) -> DataFrame:
    """Recall of each subcategory that has labels."""
    out = found.groupBy("subcategory").agg(F.count("*").alias("total"), F.count_if(F.col("veredito").isin("tp", "tp_unknown")).alias("achados"), F.count_if(F.col("veredito") == "fn").alias("perdidos"))
    return out.withColumn("recall", ratio(F.col("achados"), F.col("total")))


def term_frequency(rows: DataFrame, term_col: str) -> DataFrame:
    """(termo, total): how often each false positive or missed term occurs."""
    return rows.where(F.col(term_col).isNotNull()).groupBy(F.col(term_col).alias("termo")).agg(F.count("*").alias("total"))
