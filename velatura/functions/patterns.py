"""Rigid identifier patterns: scan, places and per-kind counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MONTHS = "jan(?:eiro)?|fev(?:ereiro)?|mar(?:ço)?|abr(?:il)?|mai(?:o)?|jun(?:ho)?|jul(?:ho)?|ago(?:sto)?|set(?:embro)?|out(?:ubro)?|nov(?:embro)?|dez(?:embro)?"
# The patterns, in the order in which they apply, and the tag of each
PATTERNS = {
    "CPF": r"(?U)\b\d{3}\.\d{3}\.\d{3}[-.]\d{2}\b",
    "DATA": r"(?U)\b(?:0?[1-9]|[12]\d|3[01])/(?:0?[1-9]|1[0-2])/\d{2,4}\b",
    "DATA_EXTENSO": rf"(?Ui)\b\d{{1,2}}\s+de\s+(?:{_MONTHS})(?:\s+de\s+\d{{2,4}})?\b",
    "TEL": r"(?U)\b(?:\(\d{2}\)|\d{2}[ -])\s*9?\s*\d{4}[- ]?\d{4}\b",
    "CNS": r"(?U)\b[12789]\d{14}\b",
    "EMAIL": r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
}
TAG_OF = {"CPF": "CPF", "DATA": "DATE", "DATA_EXTENSO": "DATE", "TEL": "PHONE", "CNS": "INFO", "EMAIL": "EMAIL"}


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def has_identifier(text: Column) -> Column:
    out = F.lit(False)
    for p in PATTERNS.values():
        out = out | text.rlike(p)
    return out


def places(text: Column, pattern: str) -> Column:
    """array<struct<ini, fim, termo>> of all matches, from 0, end exclusive.

    Pieces and matches alternate, so running lengths give the places.
    """
    found = matches(text, pattern)
    pieces = F.split(text, pattern, -1)
    kind = "array<struct<ini:int,fim:int,termo:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        ini = acc["at"] + F.length(x["g"])
        fim = ini + F.length(x["t"])
        return F.struct(fim.alias("at"), F.concat(acc["out"], F.array(F.struct(ini.alias("ini"), fim.alias("fim"), x["t"].alias("termo")))).alias("out"))

    return F.aggregate(F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("g"), found.alias("t")), start, step)["out"]


def scan(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, padrao, ini, fim, termo): every match of every pattern."""
    text = F.col(text_col)
    kinds = F.array(*[F.struct(F.lit(k).alias("padrao"), places(text, p).alias("m")) for k, p in PATTERNS.items()])
    rows = df.where(has_identifier(text)).select(F.col(id_col), F.inline(kinds))
    return rows.select(id_col, "padrao", F.inline("m"))


def pattern_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per kind: matches, different terms, records; kinds without a match stay, with zeros."""
    spark = df.sparkSession
    text = F.col(text_col)
    kinds = F.array(*[F.struct(F.lit(k).alias("padrao"), matches(text, p).alias("m")) for k, p in PATTERNS.items()])
    rows = df.select(F.col(id_col).alias("doc"), F.inline(kinds)).select("doc", "padrao", F.explode("m").alias("termo"))
    found = rows.groupBy("padrao").agg(F.count("*").alias("total"), F.countDistinct("termo").alias("termos"), F.countDistinct("doc").alias("registros"))
    return spark.createDataFrame([(k,) for k in PATTERNS], "padrao string").join(found, "padrao", "left").na.fill(0, ["total", "termos", "registros"])
