"""The knowledge table: (sessao_id, tipo, texto_original, id_local_sessao, created_at).

Everything is keyed by (sessao_id, tipo, texto_original). Ids are given in order of first
occurrence, from the highest id of their session and kind on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from velatura.functions.patterns import has_identifier
from velatura.functions.text import comparison_key, strip
from velatura.session import stage

KEY = ["sessao_id", "tipo", "texto_original"]
# Which kind keeps a term that several kinds claim, first to last
PRIORITY = ["nome", "endereco", "info", "cpf", "tel", "email", "data", "unknown"]
# Tag word of each kind
TAG_OF_KIND = {"nome": "PERSON", "endereco": "LOCATION", "info": "INFO", "boilerplate": "BOILERPLATE", "revisao": "REVIEW", "unknown": "UNKNOWN", "cpf": "CPF", "tel": "PHONE", "email": "EMAIL", "data": "DATE"}


def sequential_ids(df: DataFrame, by: list[str], order: list[str], name: str = "seq", parts: int | None = None) -> DataFrame:
    """Adds 1, 2, 3, ... in each group ``by``, in the given order, without sorting a group in one task.

    Rows are range-partitioned by (by, order); numbers inside a range start after the rows of
    the ranges before it (one row a range and group).
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(df.repartitionByRange(n, *by, *order).withColumn("_p", F.spark_partition_id()), "ids")
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    start = ranged.groupBy(*by, "_p").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    start = start.select(*[F.col(c).alias(f"_j{i}") for i, c in enumerate([*by, "_p"])], "_start")
    on = [F.col(c).eqNullSafe(F.col(f"_j{i}")) for i, c in enumerate([*by, "_p"])]
    joined = ranged.join(start, on).drop(*[f"_j{i}" for i in range(len(by) + 1)])
    inside = Window.partitionBy(*by, "_p").orderBy(*order)
    return joined.withColumn(name, F.row_number().over(inside) + F.col("_start")).drop("_p", "_start")


def first_occurrences(found: DataFrame, order: list[str]) -> DataFrame:
    """One row a key of ``found``, with the first place (struct ``primeiro`` of the order columns)."""
    return found.groupBy(*KEY).agg(F.min(F.struct(*order)).alias("primeiro"))


def register(knowledge: DataFrame, found: DataFrame, order: list[str]) -> DataFrame:
    """Knowledge plus the new keys of ``found``, with the next ids in order of first occurrence.

    Terms are stripped; empty and null ones are dropped. A term belongs to one kind of a
    session only: one that is known under any kind of PRIORITY isn't registered again, and
    of several new kinds the earliest occurrence wins, then the order of PRIORITY.
    A known review term is promoted: its review row goes when a definitive kind arrives.
    """
    new = found.withColumn("texto_original", strip(F.col("texto_original"))).where("texto_original <> ''")
    new = stage(first_occurrences(new, order), "first-seen")
    rank = F.array_position(F.array(*[F.lit(k) for k in PRIORITY]), F.col("tipo"))
    unique = F.col("tipo").isin(*PRIORITY)
    won = new.where(unique).groupBy("sessao_id", "texto_original").agg(F.min_by("tipo", F.struct("primeiro", rank)).alias("tipo"), F.min("primeiro").alias("primeiro"))
    rows = won.select(*KEY, "primeiro").unionByName(new.where(~unique).select(*KEY, "primeiro"))
    held = knowledge.where(F.col("tipo").isin(*PRIORITY)).select("sessao_id", "texto_original").distinct()
    fresh = rows.where(F.col("tipo").isin(*PRIORITY)).join(held, ["sessao_id", "texto_original"], "left_anti")
    fresh = fresh.unionByName(rows.where(~F.col("tipo").isin(*PRIORITY)).join(knowledge.select(*KEY), KEY, "left_anti"))
    top = knowledge.groupBy("sessao_id", "tipo").agg(F.max("id_local_sessao").alias("_top"))
    numbered = sequential_ids(fresh, ["sessao_id", "tipo"], ["primeiro", "texto_original"], "_k").join(top, ["sessao_id", "tipo"], "left")
    numbered = numbered.select(*KEY, (F.col("_k") + F.coalesce("_top", F.lit(0))).cast("int").alias("id_local_sessao"))
    definitive = fresh.where(unique).select("sessao_id", "texto_original", F.lit("revisao").alias("tipo")).distinct()
    kept = knowledge.select(*KEY, "id_local_sessao").join(definitive, KEY, "left_anti")
    return kept.unionByName(numbered)


def upsert(knowledge: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` replace or join those of the same key; of equal new keys the last id stays."""
    one = new.groupBy(*KEY).agg(F.max("id_local_sessao").alias("id_local_sessao"))
    other = one.toDF("_s", "_t", "_x", "_i")
    on = [F.col(c).eqNullSafe(F.col(x)) for c, x in zip(KEY, ("_s", "_t", "_x"))]
    return knowledge.join(other, on, "left_anti").select(*KEY, "id_local_sessao").unionByName(one)


def retype(knowledge: DataFrame, session: int, old: str, new: str, terms: list[str] | None = None) -> DataFrame:
    """Move terms (all, if none are named) of a session to another kind."""
    hit = (F.col("sessao_id") == session) & (F.col("tipo") == old)
    if terms is not None:
        hit = hit & F.col("texto_original").isin(*terms) if terms else F.lit(False)
    return knowledge.withColumn("tipo", F.when(hit, F.lit(new)).otherwise(F.col("tipo")))


def load(knowledge: DataFrame, session: int) -> DataFrame:
    """A session's terms; of a repeated term the row with the highest id stays."""
    rows = knowledge.where(F.col("sessao_id") == session)
    return rows.groupBy("tipo", "texto_original").agg(F.max("id_local_sessao").alias("id_local_sessao"))


def resume_points(log: DataFrame, ngram_max: int = 101) -> DataFrame:
    """(sessao_id, ultima_linha, proximo_n): where a session's run goes on."""
    return log.groupBy("sessao_id").agg(
        F.coalesce(F.max(F.when(F.col("fase_atual") == "linha_a_linha", F.col("evolucao_index"))), F.lit(-1)).alias("ultima_linha"),
        F.coalesce(F.min(F.when(F.col("fase_atual") == "ngram", F.col("tamanho_ngram"))), F.lit(ngram_max + 1)).alias("proximo_n"),
    )


def variants_of_known(candidates: DataFrame, knowledge: DataFrame, text_col: str, min_chars: int = 15) -> DataFrame:
    """Candidates that equal a known boilerplate apart from case, punctuation and spacing."""
    known = knowledge.where(F.col("tipo") == "boilerplate").select(comparison_key(F.col("texto_original")).alias("_key")).where("_key <> ''").distinct()
    return candidates.withColumn("_key", comparison_key(F.col(text_col))).where(F.length(strip(F.col(text_col))) >= min_chars).join(known, "_key", "left_semi").drop("_key")


def union_sessions(knowledge: DataFrame, sessions: list[int]) -> DataFrame:
    """(tipo, texto_original, id): terms of any of the sessions, ids in first-seen order."""
    order = F.array_position(F.array(*[F.lit(s).cast("long") for s in sessions]), F.col("sessao_id").cast("long"))
    rows = knowledge.where(F.col("sessao_id").isin(*sessions)).groupBy("tipo", "texto_original").agg(F.min(F.struct(order.alias("o"), F.col("id_local_sessao").alias("i"))).alias("primeiro"))
    return sequential_ids(rows, ["tipo"], ["primeiro", "texto_original"], "id").select("tipo", "texto_original", F.col("id").cast("int").alias("id"))


def intersect_sessions(knowledge: DataFrame, sessions: list[int]) -> DataFrame:
    """(tipo, texto_original, id): terms of all the sessions, ids in text order; unknown terms are united."""
    rows = knowledge.where(F.col("sessao_id").isin(*sessions))
    both = rows.groupBy("tipo", "texto_original").agg(F.countDistinct("sessao_id").alias("k")).where((F.col("k") == len(set(sessions))) | (F.col("tipo") == "unknown"))
    return sequential_ids(both.drop("k"), ["tipo"], ["texto_original"], "id").select("tipo", "texto_original", F.col("id").cast("int").alias("id"))


def safe_fragments(text: Column, terms: Column, min_chars: int = 15, min_words: int = 3) -> Column:
    """array<string>: parts of a text that hold none of the terms, to be learned as boilerplate.

    Cut at line ends and ". ", then at every term (any letter case, longest first); short parts
    and parts with an identifier pattern are left out.
    """
    order = F.transform(F.array_sort(F.transform(F.filter(terms, lambda t: t != ""), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda x: x["t"])
    cut = F.aggregate(order, text, lambda acc, t: F.regexp_replace(acc, F.concat(F.lit(r"(?iu)\Q"), t, F.lit(r"\E")), F.lit("\u0001")))
    parts = F.transform(F.split(cut, "\n|\\. |\u0001"), strip)
    return F.filter(parts, lambda x: (F.length(x) >= min_chars) & (F.size(F.split(x, r"(?U)\s+")) >= min_words) & ~has_identifier(x))


def tag(ini: str, fim: str, kind: Column, number: Column) -> Column:
    words = F.create_map(*[F.lit(x) for kv in TAG_OF_KIND.items() for x in kv])
    return F.concat_ws(" ", F.lit(ini), F.element_at(words, kind), number.cast("string"), F.lit(fim))
