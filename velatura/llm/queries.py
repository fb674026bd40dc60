"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velatura.llm import bpe, mixing, overlap, pairs, percentiles, personal, repetition, sentences, site_lines, truncation
from velatura.session import stage, table


LOGS, SIMULATED, RUNS = "p02_brkga_logs_llm", "p02_brkga_simular_injection", "p02_logs_execucao"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.row_pairs(*overlap.cross_split(table(spark, sf_dir, "dataset_registros")))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_report(*overlap.cross_split(table(spark, sf_dir, "dataset_registros")))


QUANTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
METRICS = ["eval_tokens_per_second", "total_duration_sec"]


def p2_digestos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each day and ``resultado_id``: what is stored, and added when it is read."""
    logs = table(spark, sf_dir, LOGS, "resultado_id", "created_at", *METRICS).withColumn("dia", F.to_date("created_at"))
    return percentiles.digest(logs, ["dia", "resultado_id"], METRICS)


def p2_percentis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles over all days, from the digests of the days."""
    return percentiles.read(p2_digestos(spark, sf_dir), by="resultado_id", quantiles=QUANTILES)


def p2_por_dia(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each day over all ``resultado_id``, from the same digests."""
    return percentiles.read(p2_digestos(spark, sf_dir), by="dia", quantiles=QUANTILES)


def p2_postos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentiles held against the log: are their ranks within the stated error?"""
    found = p2_percentis(spark, sf_dir)
    cols = [f"p{round(q * 1000):04d}" for q in QUANTILES]
    each = found.select("resultado_id", "metrica", "n", "erro_posto", F.explode(F.array(*[F.struct(F.lit(q).alias("quantil"), F.col(c).alias("valor")) for q, c in zip(QUANTILES, cols)])).alias("q")).select("resultado_id", "metrica", "n", "erro_posto", "q.*")
    # the values themselves are rounded by 2 ** -24 of their size
    slack = F.abs("valor") * 2.0**-23
    values = table(spark, sf_dir, LOGS, "resultado_id", *METRICS).select("resultado_id", F.inline(F.array(*[F.struct(F.lit(m).alias("metrica"), F.col(m).alias("x")) for m in METRICS]))).where("NOT isnan(x)")
    ranks = values.select(F.col("resultado_id").alias("r"), F.col("metrica").alias("m"), "x").join(each, F.col("r").eqNullSafe(F.col("resultado_id")) & (F.col("m") == F.col("metrica")))
    counted = ranks.groupBy("resultado_id", "metrica", "quantil", "n", "erro_posto").agg(F.count_if(F.col("x") < F.col("valor") - slack).alias("abaixo"), F.count_if(F.col("x") <= F.col("valor") + slack).alias("ate"))
    want = F.ceil(F.col("quantil") * F.col("n") - 1e-9)
    inside = (F.col("abaixo") - F.col("erro_posto") < want) & (want <= F.col("ate") + F.col("erro_posto")) & (F.col("erro_posto") <= 0.005 * F.col("n"))
    return counted.select("resultado_id", "metrica", "quantil", "n", inside.alias("dentro"))


def p2_contagens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that the digests hold: nothing is lost in folding and adding."""
    added = percentiles.merge(p2_digestos(spark, sf_dir), by="resultado_id")
    return added.groupBy("resultado_id", "metrica").agg(F.sum("n").alias("n"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.excess_places(table(spark, sf_dir, "prontuarios"), "rec_idx", "descricao", "unidade")


def p4_proprias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that set a unit apart: excess over the same line elsewhere, which the ratio alone decides."""
    found = site_lines.excess_lines(table(spark, sf_dir, "prontuarios"), "rec_idx", "descricao", "unidade", against="line")
    return found.select(F.nullif("src", F.lit("\u0000")).alias("unidade"), F.col("key").alias("linha"), "k", "total", "g")


def p4_textos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.without_excess(table(spark, sf_dir, "prontuarios"), "rec_idx", "descricao", "unidade")


def _model_of_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_id, modelo): the model of the session behind each log."""
    logs = table(spark, sf_dir, LOGS, "id", "resultado_id")
    results = table(spark, sf_dir, "p02_brkga_resultados", "id", "sessao_brkga_id").toDF("resultado_id", "sessao_id")
    sessions = table(spark, sf_dir, "p02_brkga_sessoes", "id", "modelo_llm").toDF("sessao_id", "modelo")
    return logs.join(results.join(sessions, "sessao_id"), "resultado_id", "left").select(F.col("id").alias("log_id"), "modelo")


def _endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tabela, campo, id, modelo, done_reason, cortado) of both fields."""
    model = _model_of_log(spark, sf_dir)
    fields = [(LOGS, "resposta_bruta", "id"), (SIMULATED, "raciocinio", "log_llm_id")]
    parts = [table(spark, sf_dir, name).select(F.lit(name).alias("tabela"), F.lit(field).alias("campo"), "id", F.col(log).alias("log_id"), "done_reason", truncation.ending(field).alias("s")) for name, field, log in fields]
    # the texts are read once; only their states go on
    states = stage(parts[0].unionByName(parts[1]).join(model, "log_id", "left"), "endings")
    return truncation.cut(states, ["tabela", "campo", "modelo"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _endings(spark, sf_dir).where("cortado").select("tabela", "id", "campo")


def p3_taxas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each model's texts are cut, and how often ``done_reason`` says otherwise."""
    said = F.lower("done_reason") == "length"
    return _endings(spark, sf_dir).groupBy("modelo", "tabela", "campo").agg(
        F.count("*").alias("valores"),
        F.count_if(F.col("s.estado") != "vazio").alias("com_conteudo"),
        F.count_if("cortado").alias("cortados"),
        F.count_if(F.col("cortado") & ~F.coalesce(said, F.lit(False))).alias("cortados_sem_aviso"),
        F.count_if(~F.col("cortado") & said).alias("aviso_sem_corte"),
    )


def _reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetitive(_union_texts(spark, sf_dir, [(LOGS, "id", "raciocinio"), (RUNS, "id", "raciocinio")]))


def _union_texts(spark: SparkSession, sf_dir: str, fields: list[tuple[str, str, str]]) -> DataFrame:
    """(src, id, text) of several text fields."""
    out = None
    for name, key, text in fields:
        df = table(spark, sf_dir, name, key, text).select(F.lit(name).alias("src"), F.col(key).alias("id"), F.col(text).alias("text"))
        out = df if out is None else out.unionByName(df)
    return out


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _union_texts(spark, sf_dir, [("prontuarios", "rec_idx", "descricao"), ("dataset_registros", "id", "text"), ("documents", "doc_id", "text")])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find(_notes(spark, sf_dir), table(spark, sf_dir, "p02_conhecimento"))
    return found.select(F.col("src").alias("tabela"), F.col("id").alias("row_id"), "tipo", "inicio", "fim")


def p5_textos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.redact(_notes(spark, sf_dir), table(spark, sf_dir, "p02_conhecimento")).select(F.col("src").alias("tabela"), F.col("id").alias("row_id"), "texto")


def p5_rotuladores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimated reliability of every labeler."""
    return personal.reliability(_notes(spark, sf_dir), table(spark, sf_dir, "p02_conhecimento"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reasoning(spark, sf_dir).where("repetitivo").select(F.col("src").alias("tabela"), "id")


def p6_parcelas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reasoning(spark, sf_dir).select(F.col("src").alias("tabela"), "id", F.col("coberto").alias("parcela_repetida"), "regra")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, SIMULATED, "id", "prompt_enviado", "resposta_bruta").select(F.lit(SIMULATED).alias("source"), "id", F.col("prompt_enviado").alias("prompt"), F.col("resposta_bruta").alias("answer"))
    b = table(spark, sf_dir, LOGS, "id", "texto_pre_llm", "resposta_bruta").select(F.lit(LOGS).alias("source"), "id", F.col("texto_pre_llm").alias("prompt"), F.col("resposta_bruta").alias("answer"))
    model = _model_of_log(spark, sf_dir)
    logs = model.select(F.lit(LOGS).alias("source"), F.col("log_id").alias("id"), F.col("modelo").alias("maker"))
    simulated = table(spark, sf_dir, SIMULATED, "id", "log_llm_id").join(model, F.col("log_llm_id") == F.col("log_id")).select(F.lit(SIMULATED).alias("source"), "id", F.col("modelo").alias("maker"))
    return pairs.defective(a.unionByName(b), makers=logs.unionByName(simulated)).withColumnRenamed("source", "tabela")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p8_textos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded and decoded again."""
    return bpe.decode(p8_ids(spark, sf_dir), "doc_id")


def _mix(spark: SparkSession, sf_dir: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang", "tipo_documento")
    rows = bpe.with_token_counts(docs, "text").select(F.col("doc_id").alias("id"), "source", "lang", F.col("tipo_documento").alias("domain"), "tokens")
    sized, targets = stage(rows, "mix-sizes"), table(spark, sf_dir, "mix_targets")
    total = sized.join(targets.select("source").distinct(), "source", "left_semi").agg(F.sum("tokens")).first()[0] if whole else None
    return mixing.mix(sized, targets, total)


def p9_mistura(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0].select(F.col("id").alias("doc_id"), "source", "tokens", "uses")


def p9_parcelas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(*_mix(spark, sf_dir))


def p9_parcelas_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as the listed sources have: short sources repeat, then pass their shortage on."""
    return mixing.shares(*_mix(spark, sf_dir, whole=True))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_units(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text").select("doc_id", "inicio", "fim")


def p10_unidades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_units(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", with_text=True)


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_digestos, p2_percentis, p2_por_dia, p2_postos, p2_contagens, p3_found, p3_taxas, p4_found, p4_textos, p4_proprias, p5_found, p5_textos, p5_rotuladores, p6_found, p6_parcelas, p7_found, p8_ids, p8_textos, p9_mistura, p9_parcelas, p9_parcelas_corpus, p10_found, p10_unidades)}
_LINES = r"""
WITH r AS (SELECT rec_idx, unidade, descricao FROM prontuarios),
tot AS (SELECT unidade, count(*) AS total FROM r GROUP BY unidade),
l AS (SELECT rec_idx, unidade, unnest(string_split(descricao, chr(10))) AS line, generate_subscripts(string_split(descricao, chr(10)), 1) - 1 AS linha FROM r),
k AS (SELECT rec_idx, unidade, linha, line, CASE WHEN regexp_matches(line, '\p{L}') THEN regexp_replace(lower(line), '[\s\p{Z}\p{Nd}]+', '', 'g') END AS key FROM l),
big AS (SELECT k.unidade, k.key FROM k JOIN tot ON k.unidade IS NOT DISTINCT FROM tot.unidade WHERE key IS NOT NULL GROUP BY k.unidade, k.key, tot.total HAVING count(DISTINCT rec_idx) >= 10 AND count(DISTINCT rec_idx) >= 0.05 * tot.total - 1e-9)
"""
_METRIC = " UNION ALL ".join(f"SELECT resultado_id, '{m}' AS metrica, {m} AS x FROM {LOGS} WHERE {m} IS NOT NULL AND NOT isnan({m})" for m in METRICS)
SQL: dict[str, str] = {
    "p8_textos": "SELECT doc_id, coalesce(text, '') AS texto FROM documents",
    "p2_contagens": f"SELECT resultado_id, metrica, CAST(count(*) AS BIGINT) AS n FROM ({_METRIC}) GROUP BY ALL",
    "p2_postos": f"SELECT resultado_id, metrica, quantil, CAST(count(*) AS BIGINT) AS n, true AS dentro FROM ({_METRIC}), (SELECT CAST(unnest({QUANTILES}) AS DOUBLE) AS quantil) GROUP BY ALL",
    "p4_found": _LINES + "SELECT k.rec_idx, CAST(k.linha AS INTEGER) AS linha FROM k JOIN big ON k.unidade IS NOT DISTINCT FROM big.unidade AND k.key = big.key",
    "p4_textos": _LINES + ", kept AS (SELECT k.rec_idx, string_agg(k.line, chr(10) ORDER BY k.linha) AS texto FROM k LEFT JOIN big ON k.unidade IS NOT DISTINCT FROM big.unidade AND k.key = big.key WHERE big.key IS NULL GROUP BY k.rec_idx) SELECT r.rec_idx, CASE WHEN r.descricao IS NULL THEN NULL ELSE coalesce(kept.texto, '') END AS texto FROM r LEFT JOIN kept USING (rec_idx)",
}
