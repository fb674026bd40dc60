"""Sinks: report files, versioned keyed tables, append logs."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velatura.operators import goldlabels, scoring
from velatura.session import exists, list_files, path_of, stage


def write_report(rows: DataFrame, folder: str, prefix: str, chars: tuple[str, str], order_col: str = "rec_idx") -> dict[str, str]:
    """Originals, tagged texts and masks, each as one file without separators, and the mask's metadata.

    ``rows`` has original, anonimizado and mascara. The rows stream through the driver one
    partition at a time, in order; the tables themselves are better kept as Parquet.
    """
    os.makedirs(folder, exist_ok=True)
    names = {k: os.path.join(folder, f"{prefix}_{k}.txt") for k in ("original", "anonimizado", "mascara")}
    files = {k: open(p, "w", encoding="utf-8", newline="") for k, p in names.items()}
    try:
        for r in rows.select(order_col, "original", "anonimizado", "mascara").orderBy(order_col).toLocalIterator():
            for k, f in files.items():
                f.write(r[k] or "")
    finally:
        for f in files.values():
            f.close()
    with open(os.path.splitext(names["mascara"])[0] + ".meta.json", "w", encoding="utf-8") as f:
        json.dump({"char_pii": chars[0], "char_unk": chars[1]}, f, ensure_ascii=False)
    return names


def write_scores(records: DataFrame, folder: str, chars: tuple[str, str], id_col: str = "id", text_col: str = "text", labels_col: str = "labels", mask_col: str = "mascara", least: int = 3) -> str | None:
    """All score artefacts of masked records; an earlier result in the folder is kept and returned.

    totais and categorias (rounded), fp and fn (terms by frequency), visual (texts with the errors
    alone) and referencia (the ground truth, all labels and the relevant ones). Without a record
    nothing is written and None is returned.
    """
    spark = records.sparkSession
    if exists(spark, f"{folder}/totais"):
        return folder
    if records.isEmpty():
        return None
    found = scoring.verdicts(records, id_col, labels_col, mask_col, chars)
    wrong = scoring.residual_runs(records, id_col, text_col, labels_col, mask_col, chars, least)
    truth = lambda only: scoring.ground_truth(F.col(text_col), F.col(labels_col), chars[0], only)
    tables = {
        "categorias": scoring.by_category(found),
        "fp": scoring.term_frequency(wrong, "termo"),
        "fn": scoring.term_frequency(found.where("veredito = 'fn'"), "word"),
        "visual": scoring.error_views(records, id_col, text_col, labels_col, mask_col, chars, least),
        "referencia": records.select(id_col, truth(None).alias("todos"), truth(scoring.RELEVANT).alias("relevantes")),
        "totais": scoring.rounded(scoring.totals(found, wrong)),  # last: it marks the folder as done
    }
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")
    return folder


class InvalidLabels(ValueError):
    """A dataset holds labels that don't stand at their places."""


def write_gold(parts: dict[str, DataFrame], folder: str, first_id: int = 875) -> dict[str, int]:
    """Cleaned gold records of each tagged part and, together, ``FULL``: part -> rows written.

    Synthetic rows and rows with broken tags are left out, ids run on from part to part. A part
    in which any label isn't found at its place isn't written, and then neither is FULL: all valid
    parts are written first, and InvalidLabels names the others.
    """
    written, bad, whole = {}, [], None
    for name, df in parts.items():
        rows = df.where("NOT coalesce(synthetic, false)") if "synthetic" in df.columns else df
        gold = stage(goldlabels.gold_records(goldlabels.clean_inline(rows), first_id), "gold")
        wrong = goldlabels.label_errors(gold, "prontuario", "descricao", "labels").agg(F.sum("errados")).first()[0] or 0
        if wrong:
            bad.append(name)
            continue
        gold.write.mode("overwrite").json(f"{folder}/{name}")
        written[name] = gold.count()
        first_id += written[name]
        whole = gold if whole is None else whole.unionByName(gold)
    if bad:
        raise InvalidLabels(f"labels out of place in {', '.join(bad)}")
    if whole is not None:
        whole.write.mode("overwrite").json(f"{folder}/FULL")
        written["FULL"] = sum(written.values())
    return written


class Conflict(RuntimeError):
    """Another writer published first."""


class VersionedTable:
    """A keyed table in Parquet buckets, by a hash of the key.

    An upsert reads and writes only the buckets that hold its keys. A manifest names the folder of
    each bucket; it is created under the next number only if that doesn't exist, so of two writers
    one is told of the conflict and goes again from what the other wrote. Readers keep the version
    they opened; a failed write leaves the old one in place. What the two last manifests don't
    name is deleted.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 16, tries: int = 5):
        self.spark, self.path, self.schema, self.keys, self.buckets, self.tries = spark, path, schema, keys, buckets, tries

    def _manifest(self, name: str) -> dict[str, str]:
        fs, p = path_of(self.spark, f"{self.path}/_manifests/{name}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _current(self) -> tuple[int, dict[str, str]]:
        names = list_files(self.spark, f"{self.path}/_manifests")
        return (int(names[-1]), self._manifest(names[-1])) if names else (0, {})

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _open(self, manifest: dict[str, str]) -> DataFrame:
        paths = [f"{self.path}/{folder}/_b={b}" for b, folder in manifest.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._open(self._current()[1])

    def _publish(self, number: int, manifest: dict[str, str]) -> None:
        fs, p = path_of(self.spark, f"{self.path}/_manifests/{number:010d}")
        try:
            out = fs.create(p, False)
        except Exception as e:  # noqa: BLE001 - the file system's own kinds of "already exists"
            if fs.exists(p):
                raise Conflict(f"version {number} of {self.path} was published by another writer") from e
            raise
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        names = list_files(self.spark, f"{self.path}/_manifests")
        used = {f for n in names[-2:] for f in self._manifest(n).values()}
        for n in names[:-2]:
            for folder in set(self._manifest(n).values()) - used:
                fs.delete(path_of(self.spark, f"{self.path}/{folder}")[1], True)
            fs.delete(path_of(self.spark, f"{self.path}/_manifests/{n}")[1], True)

    def _replace(self, make, touched: list[int] | None) -> None:
        """``make`` gets the rows of the touched buckets (all, if None) and gives those to keep."""
        for k in range(self.tries):
            number, manifest = self._current()
            mine = {b: f for b, f in manifest.items() if touched is None or int(b) in touched}
            folder = f"v-{uuid.uuid4().hex}"
            make(self._open(mine)).withColumn("_b", self._bucket()).write.partitionBy("_b").parquet(f"{self.path}/{folder}")
            new = {n.removeprefix("_b="): folder for n in list_files(self.spark, f"{self.path}/{folder}") if n.startswith("_b=")}
            try:
                return self._publish(number + 1, {b: f for b, f in manifest.items() if b not in mine} | new)
            except Conflict:
                if k == self.tries - 1:
                    raise

    def overwrite(self, df: DataFrame) -> None:
        df = stage(df.select(*self.read().columns), "versioned")
        self._replace(lambda _: df, None)

    def _last(self, new: DataFrame) -> DataFrame:
        """One row a key: of several, the last."""
        rest = [c for c in new.columns if c not in self.keys]
        last = new.withColumn("_o", F.monotonically_increasing_id()).groupBy(*self.keys).agg(F.max_by(F.struct(*rest) if rest else F.lit(True), "_o").alias("_r"))
        return stage(last.select(*self.keys, *([F.col("_r.*")] if rest else [])), "upsert")

    def _touched(self, new: DataFrame) -> list[int]:
        return [r[0] for r in new.select(self._bucket()).distinct().collect()]  # at most ``buckets``

    def upsert(self, new: DataFrame, keep_null: bool = True) -> None:
        """Rows of ``new`` by key, the last of a key wins; with ``keep_null``, its nulls leave the old values.

        Without a row it does nothing.
        """
        new = self._last(new)
        touched = self._touched(new)

        def make(old: DataFrame) -> DataFrame:
            rest = [c for c in old.columns if c not in self.keys]
            a, b = old.alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
            both = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in self.keys], "full_outer")
            is_new = F.col("b._new").isNotNull()
            value = lambda c: F.coalesce(f"b.{c}", f"a.{c}") if keep_null else F.when(is_new, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
            cols = [F.when(is_new, F.col(f"b.{k}")).otherwise(F.col(f"a.{k}")).alias(k) for k in self.keys]
            cols += [(value(c) if c in new.columns else F.col(f"a.{c}")).alias(c) for c in rest]
            return both.select(*cols).select(*old.columns)

        if touched:
            self._replace(make, touched)

    def insert_absent(self, new: DataFrame) -> None:
        """Rows whose key isn't there yet; of several in ``new``, the last."""
        new = self._last(new)
        touched = self._touched(new)

        def make(old: DataFrame) -> DataFrame:
            on = [new[k].eqNullSafe(old[k]) for k in self.keys]
            return old.unionByName(new.join(old, on, "left_anti"), allowMissingColumns=True)

        if touched:
            self._replace(make, touched)


def save_combinations(combos: VersionedTable, members: VersionedTable, rows: DataFrame) -> None:
    """Scored combinations (label_combo, modo, grupo, nivel, f2_score, precision, recall, podado, sessoes) and, one row each, their sessions."""
    combos.upsert(rows.drop("sessoes"))
    members.upsert(rows.select("label_combo", "grupo", F.explode("sessoes").alias("sessao_id")))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("mergeSchema", True).parquet(path)


def cache_hits(events: DataFrame, key: str = "resultado_id") -> DataFrame:
    """Hits are events that are appended; their number is counted when it is read."""
    return events.groupBy(key).agg(F.count("*").alias("cache_hits"))
