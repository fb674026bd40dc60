"""Gold-label preparation: inline tags out of the text, label places moved along."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velatura.functions.text import strip
from velatura.operators.knowledge import sequential_ids

LABELS = "array<struct<word:string,category:string,subcategory:string,first_position:int,last_position:int>>"


def clean_inline(df: DataFrame, text_col: str = "text", labels_col: str = "labels") -> DataFrame:
    """Adds ``texto_limpo``, ``rotulos`` and ``com_erro``.

    Each label must stand between ``<SUB ...>`` right before (within 50 characters) and
    ``</SUB ...>`` right after; both go, blanks around the word stay outside of it (leading)
    or vanish (trailing). A missing tag, or any ``<...>`` left, is an error. A row without
    labels keeps its text. Null texts stay null and count as errors.
    """
    text = F.col(text_col)
    order = F.array_sort(
        F.transform(F.coalesce(F.col(labels_col).cast(LABELS), F.array().cast(LABELS)), lambda x, i: F.struct(x["first_position"].alias("a"), i.alias("i"), x["last_position"].alias("b"), x["word"].alias("w"), x["subcategory"].alias("s"), x["category"].alias("c")))
    )
    kind = "struct<at:int,txt:string,out:" + LABELS + ",bad:boolean>"
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("txt"), F.array().cast(LABELS).alias("out"), F.lit(False).alias("bad")).cast(kind)

    def step(acc, x):
        name = F.concat(F.lit(r"\Q"), x["s"], F.lit(r"\E"))
        before = F.substring(text, F.greatest(x["a"] - 50, F.lit(0)) + 1, F.least(x["a"], F.lit(50)))
        after = F.substring(text, x["b"] + 1, F.lit(50))
        opening = F.call_function("regexp_extract", before, F.concat(F.lit("(<"), name, F.lit(r"\b[^>]*>)$")), F.lit(1))
        closing = F.call_function("regexp_extract", after, F.concat(F.lit("^(</"), name, F.lit(r"\b[^>]*>)")), F.lit(1))
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["a"] - acc["at"] - F.length(opening), F.lit(0)))
        lead = F.regexp_extract(x["w"], r"(?U)^(\s+)", 1)
        word = strip(x["w"])
        txt = F.concat(acc["txt"], gap, lead)
        label = F.struct(word.alias("word"), x["c"].alias("category"), x["s"].alias("subcategory"), F.length(txt).alias("first_position"), (F.length(txt) + F.length(word)).alias("last_position"))
        return F.struct((x["b"] + F.length(closing)).alias("at"), F.concat(txt, word).alias("txt"), F.concat(acc["out"], F.array(label)).alias("out"), (acc["bad"] | (opening == "") | (closing == "")).alias("bad")).cast(kind)

    done = F.aggregate(order, start, step)
    out = df.withColumn("_d", done).withColumn("texto_limpo", F.concat(F.col("_d.txt"), F.substring(text, F.col("_d.at") + 1, F.length(text))))
    out = out.withColumn("rotulos", F.col("_d.out")).withColumn("com_erro", F.coalesce(F.col("_d.bad") | F.col("texto_limpo").rlike("<[^>]+>"), F.lit(True)))
    return out.drop("_d")


def gold_records(cleaned: DataFrame, first_id: int = 875, order_col: str = "id") -> DataFrame:
    """(prontuario, descricao, labels): rows without error, ids running on from ``first_id``."""
    rows = cleaned.where(~F.col("com_erro")).select(F.col(order_col).alias("_o"), "texto_limpo", "rotulos").withColumn("_g", F.lit(0))
    return sequential_ids(rows, ["_g"], ["_o"], "k").select((F.col("k") + first_id - 1).alias("prontuario"), F.col("texto_limpo").alias("descricao"), F.col("rotulos").alias("labels"))


def label_errors(df: DataFrame, id_col: str, text_col: str, labels_col: str) -> DataFrame:
    """(id, rotulos, errados): labels whose word isn't what stands at their place."""
    rows = df.where(F.size(labels_col) > 0).select(F.col(id_col), F.col(text_col).alias("t"), F.explode(labels_col).alias("r"))
    ok = F.substring("t", F.col("r.first_position") + 1, F.col("r.last_position") - F.col("r.first_position")) == F.col("r.word")
    return rows.groupBy(id_col).agg(F.count("*").alias("rotulos"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("errados"))
