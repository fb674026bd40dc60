"""Rankings over the persisted run tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_detector(simulated: DataFrame, logs: DataFrame, results: DataFrame, session: int | None = None) -> DataFrame:
    """(loop_tipo, total_itens): which detector fired first, for a session or all; rarest first."""
    s = simulated.where("loop_detectado").select("log_llm_id", "loop_tipo")
    r = results.select(F.col("id").alias("resultado_id"), "sessao_brkga_id")
    if session is not None:
        r = r.where(F.col("sessao_brkga_id") == session)
    rows = s.join(logs.select(F.col("id").alias("log_llm_id"), "resultado_id"), "log_llm_id").join(r, "resultado_id")
    return rows.groupBy("loop_tipo").agg(F.count("*").alias("total_itens")).orderBy("total_itens", "loop_tipo")


def winner_bucket(compared: DataFrame, logs: DataFrame, session: int | None = None) -> DataFrame:
    """(detector_mais_preciso, total_itens) of the logs that failed, most first."""
    rows = compared if session is None else compared.where(F.col("sessao_brkga_id") == session)
    failed = logs.where("houve_falha").select(F.col("id").alias("log_llm_id"))
    return rows.join(failed, "log_llm_id").groupBy("detector_mais_preciso").agg(F.count("*").alias("total_itens")).orderBy(F.desc("total_itens"), "detector_mais_preciso")


def winner_detail(compared: DataFrame, logs: DataFrame, session: int | None = None) -> DataFrame:
    """(tecnica_vencedora, total_itens): the winning detector itself, or the pair of a tie."""
    rows = compared if session is None else compared.where(F.col("sessao_brkga_id") == session)
    failed = logs.where("houve_falha").select(F.col("id").alias("log_llm_id"))
    name = lambda c: F.coalesce(F.col(c), F.lit("NULL"))
    won = F.col("detector_mais_preciso")
    label = F.when(won == "artigo", F.col("artigo_tipo")).when(won == "det4", F.col("det4_tipo")).when(won == "empate", F.concat(F.lit("Empate ("), name("artigo_tipo"), F.lit(" + "), name("det4_tipo"), F.lit(")"))).otherwise(won)
    return rows.join(failed, "log_llm_id").groupBy(label.alias("tecnica_vencedora")).agg(F.count("*").alias("total_itens")).orderBy(F.desc("total_itens"), "tecnica_vencedora")


def logs_with_parameters(logs: DataFrame, results: DataFrame) -> DataFrame:
    """Each log with the hyper-parameters of its result; nulls where it has none."""
    p = results.select(F.col("id").alias("resultado_id"), "sessao_brkga_id", "temperature", "top_k", "top_p", "repeat_penalty", "repeat_last_n")
    return logs.join(p, "resultado_id", "left")


def not_simulated(logs: DataFrame, simulated: DataFrame) -> DataFrame:
    """Logs without a simulation row."""
    return logs.join(simulated.select(F.col("log_llm_id").alias("id")), "id", "left_anti")


def fitness_cache(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """Known fitness of the wanted parameter sets; a null fitness is a miss."""
    keys = ["sessao_brkga_id", "temperature", "top_k", "top_p", "repeat_penalty", "repeat_last_n"]
    return wanted.join(results.where("fitness IS NOT NULL").select(*keys, "id", "fitness"), keys)


def top_metrics(df: DataFrame, n: int = 20) -> DataFrame:
    """The n best by F2, then precision (a top-k report)."""
    return df.orderBy(F.desc("f2"), F.desc("precision"), *[c for c in ("label", "id") if c in df.columns]).limit(n)


def combination_cache(combos: DataFrame, mode: str, group: str) -> DataFrame:
    """(label_combo, f2): processed combinations of a mode or single sessions; -1 where pruned."""
    rows = combos.where(F.col("modo").isin(mode, "unico") & (F.col("grupo") == group))
    return rows.select("label_combo", F.when(F.col("podado"), F.lit(-1.0)).otherwise(F.col("f2_score")).alias("f2"))


def chart_table(df: DataFrame) -> DataFrame:
    """(modo, nivel, n, melhor_f2, menor_precision, menor_recall) for a metrics chart."""
    return df.groupBy("modo", "nivel").agg(F.count("*").alias("n"), F.max("f2").alias("melhor_f2"), F.min("precision").alias("menor_precision"), F.min("recall").alias("menor_recall"))


def valid_combinations(combos: DataFrame) -> DataFrame:
    """Combinations that weren't pruned."""
    return combos.where(~F.coalesce("podado", F.lit(False)))
