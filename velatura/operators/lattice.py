"""Search over unions and intersections of sessions, level by level."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velatura.operators import scoring
from velatura.operators.spans import dictionary_spans, masked, pattern_terms, span, term_end, term_rank
from velatura.session import stage


def parse_ids(text: str) -> list[int]:
    """Session ids of a list with commas or blanks, sorted, each once."""
    return sorted({int(x) for x in text.replace(",", " ").split()})


def subsets(spark: SparkSession, sessions: Iterable[int], sizes: Iterable[int] | None = None) -> DataFrame:
    """(combo, k): all non-empty subsets, or those of some sizes, smallest first."""
    ids = sorted(set(sessions))
    rows = [(list(c), k) for k in (sizes or range(1, len(ids) + 1)) for c in combinations(ids, k)]
    return spark.createDataFrame(rows, "combo array<int>, k int")


def label(mode: str, names: Column) -> Column:
    """Mode and the joined names; single sessions share one mode."""
    return F.concat_ws("_", F.when(F.size(names) == 1, F.lit("unico")).otherwise(F.lit(mode)), F.array_join(names, "-"))


def next_level(history: DataFrame, k: int) -> DataFrame:
    """(combo, melhor_pai): sets of size k all of whose (k-1)-subsets are active in ``history``.

    ``history`` has combo (sorted), f2 and podado. Candidates come from pairs of active sets
    that share all but their last element; a set is kept if all k parents are active.
    """
    active = history.where((F.size("combo") == k - 1) & ~F.col("podado")).select("combo", "f2")
    head = F.slice("combo", 1, k - 2) if k > 2 else F.array().cast("array<int>")
    a = active.select(head.alias("h"), F.element_at("combo", -1).alias("x"))
    pairs = a.alias("p").join(a.alias("q"), F.col("p.h") == F.col("q.h") if k > 2 else F.lit(True)).where("p.x < q.x")
    cand = pairs.select(F.concat("p.h", F.array("p.x", "q.x")).alias("combo"))
    parents = cand.select("combo", F.explode(F.transform("combo", lambda y: F.array_remove("combo", y))).alias("pai"))
    found = parents.join(active.withColumnRenamed("combo", "pai"), "pai").groupBy("combo").agg(F.count("*").alias("n"), F.max("f2").alias("melhor_pai"))
    return found.where(F.col("n") == k).select("combo", "melhor_pai")


def decide(scored: DataFrame) -> DataFrame:
    """Adds ``podado``: a set must beat its best parent strictly; level 1 is always kept."""
    return scored.withColumn("podado", (F.size("combo") > 1) & ~(F.col("f2") > F.coalesce("melhor_pai", F.lit(0.0))))


def combo_terms(combos: DataFrame, knowledge: DataFrame, mode: str) -> DataFrame:
    """(combo, tipo, termo, id): a combination's terms; an intersection still unites unknown terms."""
    k = knowledge.where(F.col("tipo").isin("nome", "endereco", "info", "unknown"))
    rows = combos.select("combo", F.explode("combo").alias("sessao_id")).join(k, "sessao_id")
    out = rows.groupBy("combo", "tipo", F.col("texto_original").alias("termo")).agg(F.countDistinct("sessao_id").alias("n"), F.min("id_local_sessao").alias("id"))
    if mode == "interseccao":
        out = out.where((F.col("n") == F.size("combo")) | (F.col("tipo") == "unknown"))
    return out.drop("n")


_COUNTS = ["tp", "tp_unknown", "fn", "fp"]


def _counted(rows: DataFrame, key: list[str], chars: tuple[str, str]) -> DataFrame:
    """(key..., tp, tp_unknown, fn, fp) of masked rows, by record."""
    rows = rows.withColumn("chave", F.struct(*key))
    found = scoring.verdicts(rows, "chave", "labels", "mascara", chars).groupBy("chave").agg(*[F.count_if(F.col("veredito") == v).alias(v) for v in _COUNTS[:3]])
    wrong = scoring.residual_runs(rows, "chave", "texto", "labels", "mascara", chars).groupBy("chave").agg(F.count("*").alias("fp"))
    return found.join(wrong, "chave", "full_outer").na.fill(0, _COUNTS).select("chave.*", *_COUNTS)


def base_scores(records: DataFrame, chars: tuple[str, str] = ("*", "#")) -> tuple[DataFrame, DataFrame]:
    """(records with their pattern matches, counts of each record's mask without any term)."""
    rows = stage(records.select("rec_idx", "texto", "labels", pattern_terms(F.col("texto")).alias("padroes")).where("texto IS NOT NULL"), "lattice-records")
    none = F.array().cast("array<struct<ini:int,fim:int,posto:string,alvo:string>>")
    return rows, stage(_counted(rows.withColumn("mascara", masked(F.col("texto"), none, F.col("padroes"), chars[0])), ["rec_idx"], chars), "lattice-base")


def score_level(combos: DataFrame, base: tuple[DataFrame, DataFrame], knowledge: DataFrame, mode: str, chars: tuple[str, str] = ("*", "#")) -> DataFrame:
    """(combo, counts, precision, recall, f1, f2) of all combinations of a level in one job.

    ``base`` is what ``base_scores`` gives. A term's spans in a record are found once, whatever the number
    of combinations that hold it, and only the records in which a combination has a term are
    masked for it: the others count as they do without any term.
    """
    rows, alone = base
    terms = stage(combo_terms(combos, knowledge, mode), "combo-terms")
    spans = dictionary_spans(rows, terms.select("termo").distinct())
    kind, term = F.col("tipo"), F.col("termo")
    one = span(F.col("ini"), term_end(kind, term, F.col("ini"), F.col("fim")), term_rank(kind, term, F.col("id")), F.when(kind == "unknown", F.lit(chars[1])).otherwise(F.lit(chars[0])))
    pairs = spans.join(terms, "termo").groupBy("combo", "rec_idx").agg(F.collect_list(one).alias("spans"))
    both = pairs.join(rows, "rec_idx").select("combo", "rec_idx", "texto", "labels", masked(F.col("texto"), F.col("spans"), F.col("padroes"), chars[0]).alias("mascara"))
    both = stage(both, "combo-masks")
    mine = _counted(both, ["combo", "rec_idx"], chars).groupBy("combo").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    instead = both.select("combo", "rec_idx").join(alone, "rec_idx").groupBy("combo").agg(*[F.sum(c).alias(f"b_{c}") for c in _COUNTS])
    whole = alone.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTS]).first()  # one row
    out = combos.select("combo").join(mine, "combo", "left").join(instead, "combo", "left").na.fill(0)
    return scoring.with_scores(out.select("combo", *[(F.lit(whole[c]) - F.col(f"b_{c}") + F.col(c)).alias(c) for c in _COUNTS]))


def search(records: DataFrame, knowledge: DataFrame, sessions: list[int], mode: str = "uniao", depth: int | None = None, history: DataFrame | None = None) -> DataFrame:
    """(combo, f2, podado): the whole search; a level is one job, and stops where none is active.

    Combinations that ``history`` holds aren't scored again.
    """
    spark = records.sparkSession
    done = history if history is not None else spark.createDataFrame([], "combo array<int>, f2 double, podado boolean")
    base = base_scores(records)
    combos = subsets(spark, sessions, [1]).select("combo").withColumn("melhor_pai", F.lit(None).cast("double"))
    for k in range(1, (depth or len(set(sessions))) + 1):
        if k > 1:
            combos = stage(next_level(done, k), "combos")
        fresh = combos.join(done.select("combo"), "combo", "left_anti")
        if not fresh.isEmpty():
            scored = score_level(fresh, base, knowledge, mode).select("combo", "f2").join(fresh, "combo")
            done = stage(done.unionByName(decide(scored).select("combo", "f2", "podado")), "lattice")
        elif combos.isEmpty():
            break
    return done
