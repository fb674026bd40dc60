"""Readers: record and gold datasets, masks, metric files."""

from __future__ import annotations

import csv
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velatura.session import exists, list_files, path_of

RECORD = "prontuario string, descricao string"
GOLD = "id long, text string, labels array<struct<word:string,category:string,subcategory:string,first_position:int,last_position:int>>, synthetic boolean"
METRICS = "metricas struct<precision:double,recall:double,f1_score:double,f2_score:double>"


def read_records(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """A record dataset by its suffix: .json (array or lines), .csv (header on the second line), .parquet.

    Another suffix is a ValueError. Rows get ``rec_idx`` in file order.
    """
    suffix = os.path.splitext(path)[1].lower()
    if suffix == ".json":
        df = spark.read.schema(schema).option("multiLine", True).json(path)
    elif suffix == ".csv":
        df = _csv_second_header(spark, path, schema)
    elif suffix == ".parquet":
        return spark.read.parquet(path)
    else:
        raise ValueError(f"no reader for {suffix or path!r}: .json, .csv or .parquet")
    return with_index(df)


def _csv_second_header(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The first line of a file is dropped; the second names the columns. Quoted line breaks are kept.

    Only two lines reach the driver. A file whose fields hold line breaks can't be split, so
    each file is one task; several files are read beside each other.
    """
    files = [f"{path}/{n}" for n in list_files(spark, path) if n.endswith(".csv")] if _is_folder(spark, path) else [path]
    want = spark.createDataFrame([], schema).schema
    out = spark.createDataFrame([], schema)
    for f in files:
        head = [r.value for r in spark.read.text(f).limit(2).collect()]
        if len(head) < 2:
            continue
        names = next(csv.reader([head[1]]))
        raw = spark.read.option("multiLine", True).option("header", False).option("escape", '"').schema(", ".join(f"c{i} string" for i in range(len(names)))).csv(f)
        rows = raw.where(F.monotonically_increasing_id() >= 2)
        cols = [F.col(f"c{names.index(x.name)}").cast(x.dataType).alias(x.name) if x.name in names else F.lit(None).cast(x.dataType).alias(x.name) for x in want]
        out = rows.select(*cols) if f == files[0] else out.unionByName(rows.select(*cols))
    return out


def _is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = path_of(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def with_index(df: DataFrame, name: str = "rec_idx") -> DataFrame:
    """Consecutive numbers from 0 in reading order: offsets of the partitions plus the place in each."""
    from velatura.session import stage

    raw = stage(df.withColumn("_m", F.monotonically_increasing_id()), "indexed")
    part = F.shiftright("_m", 33)
    sizes = [(r.p, r["n"]) for r in raw.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()]  # one row a partition
    starts, at = [], 0
    for p, n in sizes:
        starts.append((p, at))
        at += n
    if not starts:
        return raw.withColumn(name, F.lit(None).cast("long")).drop("_m")
    table = df.sparkSession.createDataFrame(starts, "_p long, _s long")
    return raw.withColumn("_p", part).join(F.broadcast(table), "_p").withColumn(name, F.col("_s") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_p", "_s")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Labelled records; an empty table where the file is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], GOLD)
    return spark.read.schema(GOLD).option("multiLine", True).json(path)


def read_tagged_parts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several tagged partitions in one table, with the file of each row."""
    return spark.read.schema(GOLD).option("multiLine", True).json(paths).withColumn("arquivo", F.input_file_name())


def read_mask(spark: SparkSession, path: str) -> str:
    """A mask file as one text; '' where it is missing. For exports of a bounded size; see ``mask_pieces``."""
    if not exists(spark, path):
        return ""
    row = spark.read.text(path, wholetext=True).first()
    return row.value if row else ""


def mask_pieces(spark: SparkSession, path: str, size: int = 1 << 16) -> DataFrame:
    """(peca, texto): a mask file in pieces of ``size`` characters, numbered from 0; none where it is missing."""
    schema = "peca long, texto string"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text in b["value"]:
                for k in range(0, len(text), 64 * size):
                    part = text[k : k + 64 * size]
                    rows = [((k + j) // size, part[j : j + size]) for j in range(0, len(part), size)]
                    yield pd.DataFrame(rows, columns=["peca", "texto"])

    return spark.read.text(path, wholetext=True).mapInPandas(cut, schema)


def read_mask_chars(path: str, spark: SparkSession | None = None) -> tuple[str, str]:
    """The two mask characters of a mask's metadata file; ('&', '*') by default."""
    spark = spark or SparkSession.active()
    meta = os.path.splitext(path)[0] + ".meta.json"
    if not exists(spark, meta):
        return "&", "*"
    row = spark.read.schema("char_pii string, char_unk string").option("multiLine", True).json(meta).first()
    return (row.char_pii or "&", row.char_unk or "*") if row else ("&", "*")


def read_metric_files(spark: SparkSession, folder: str) -> DataFrame:
    """Metric files of a folder, best F2 first; files without metrics and broken files are left out."""
    from velatura.functions.text import artefact_level, artefact_mode, artefact_model

    df = spark.read.schema(METRICS).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{folder}/*.json")
    name = F.col("_metadata.file_name")
    rows = df.select(name.alias("arquivo"), "metricas.*").where("f2_score IS NOT NULL")
    return rows.select("*", artefact_model(F.col("arquivo")).alias("modelo"), artefact_mode(F.col("arquivo")).alias("modo"), artefact_level(F.col("arquivo")).alias("nivel")).orderBy(F.desc("f2_score"), F.desc("precision"), "arquivo")
