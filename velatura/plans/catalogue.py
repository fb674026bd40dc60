"""Queries of the core operators over the driver tables, and their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velatura.config import LoopSettings
from velatura.functions import patterns, text
from velatura.operators import extractor, goldlabels, knowledge, lattice, ngrams, scoring, spans, tags, views
from velatura.plans import pipeline
from velatura.session import shared_dir, spread, stage, table
from velatura.streaming import loops

LOGS, SIMULATED, RUNS, RESULTS, TERMS = "p02_brkga_logs_llm", "p02_brkga_simular_injection", "p02_logs_execucao", "p02_brkga_resultados", "p02_conhecimento"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _values(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {sql}")


# --- patterns -------------------------------------------------------------------------------

_RE2 = {k: p.removeprefix("(?U)").replace("(?Ui)", "(?i)") for k, p in patterns.PATTERNS.items()}
_FOUND = " UNION ALL ".join(f"SELECT '{k}' AS padrao, rec_idx AS doc, unnest(regexp_extract_all(descricao, '{p}')) AS termo FROM prontuarios" for k, p in _RE2.items())
_KINDS = ", ".join(f"('{k}')" for k in _RE2)


@query(f"SELECT k.padrao, CAST(count(f.termo) AS BIGINT) AS total, CAST(count(DISTINCT f.termo) AS BIGINT) AS termos, CAST(count(DISTINCT f.doc) AS BIGINT) AS registros FROM (VALUES {_KINDS}) k(padrao) LEFT JOIN ({_FOUND}) f USING (padrao) GROUP BY 1")
def pattern_counts(spark: SparkSession, d: str) -> DataFrame:
    return patterns.pattern_counts(spread(table(spark, d, "prontuarios", "rec_idx", "descricao")), "rec_idx", "descricao")


@query(f"SELECT doc AS rec_idx, padrao, termo, CAST(count(*) AS BIGINT) AS n FROM ({_FOUND}) GROUP BY ALL")
def pattern_scan(spark: SparkSession, d: str) -> DataFrame:
    return patterns.scan(table(spark, d, "prontuarios", "rec_idx", "descricao"), "rec_idx", "descricao").groupBy("rec_idx", "padrao", "termo").agg(F.count("*").alias("n"))


_LITERALS = "(1, 'CPF 123.456.789-00 e 224.145.138.68'), (2, 'em 31/12/2024 e 32/13/2024'), (3, 'dia 5 de março de 2024 e 7 DE JAN'), (4, 'ligar (82) 99999-1234 ou 82 99999-1234'), (5, 'CNS 712345678901234 e 612345678901234'), (6, 'a.b@c.com.br, x@y'), (7, ''), (8, NULL)"


@query("SELECT id, padrao, termo FROM (" + " UNION ALL ".join(f"SELECT id, '{k}' AS padrao, unnest(regexp_extract_all(t, '{p}')) AS termo FROM (VALUES {_LITERALS}) v(id, t)" for k, p in _RE2.items()) + ")")
def pattern_literals(spark: SparkSession, d: str) -> DataFrame:
    return patterns.scan(_values(spark, f"{_LITERALS} AS v(id, t)"), "id", "t").select("id", "padrao", "termo")


@query()
def pattern_places(spark: SparkSession, d: str) -> DataFrame:
    return patterns.scan(table(spark, d, "prontuarios", "rec_idx", "descricao"), "rec_idx", "descricao")


# --- text -----------------------------------------------------------------------------------

_STRIP = r"regexp_replace(regexp_replace({0}, '^[\s\x0b\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+', ''), '[\s\x0b\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+$', '')"
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n[ \t]+', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
_KEY = r"regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s\x0b\x{{85}}\p{{Z}}]', '', 'g'), '[\s\x0b\x{{85}}\p{{Z}}]+', ' ', 'g')"


@query(f"SELECT rec_idx, {_STRIP.format(_CLEAN.format('descricao'))} AS texto FROM prontuarios")
def normalise_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "prontuarios", "rec_idx", "descricao").select("rec_idx", text.clean_record(F.col("descricao")).alias("texto"))


@query(f"SELECT rec_idx, trim({_KEY.format('descricao')}) AS chave FROM prontuarios")
def comparison_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "prontuarios", "rec_idx", "descricao").select("rec_idx", text.comparison_key(F.col("descricao")).alias("chave"))


@query(r"SELECT id, trim(regexp_replace(upper(s), 'PACIENTE\s*-\s*', '', 'g')) AS chave FROM (VALUES (1, 'paciente - p001'), (2, ' P002 '), (3, 'X PACIENTE-9'), (4, ''), (5, NULL)) v(id, s)")
def subject_key(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, "(1, 'paciente - p001'), (2, ' P002 '), (3, 'X PACIENTE-9'), (4, ''), (5, NULL) AS v(id, s)").select("id", text.subject_key(F.col("s")).alias("chave"))


@query(r"SELECT rec_idx, trim(regexp_replace(upper(prontuario), 'PACIENTE\s*-\s*', '', 'g')) AS chave FROM prontuarios")
def subject_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "prontuarios", "rec_idx", "prontuario").select("rec_idx", text.subject_key(F.col("prontuario")).alias("chave"))


_CANDIDATES = ", ".join(f"({i}, '{c}')" for i, c in enumerate(text.MASK_CANDIDATES))


@query(f"SELECT CAST(ordem AS INTEGER) AS ordem, c FROM (VALUES {_CANDIDATES}) v(ordem, c) WHERE NOT EXISTS (SELECT 1 FROM documents WHERE contains(text, c))")
def mask_characters(spark: SparkSession, d: str) -> DataFrame:
    free = pipeline.absent_characters(table(spark, d, "documents", "text"), "text", 0)
    docs = table(spark, d, "documents", "text")
    row = docs.agg(*[F.coalesce(F.max(F.contains("text", F.lit(c))), F.lit(False)).alias(f"c{i}") for i, c in enumerate(text.MASK_CANDIDATES)])
    assert free == []
    return row.select(F.inline(F.array(*[F.struct(F.lit(i).alias("ordem"), F.lit(c).alias("c"), F.col(f"c{i}").alias("usado")) for i, c in enumerate(text.MASK_CANDIDATES)]))).where("NOT usado").drop("usado")


@query("SELECT * FROM (VALUES (1, 'PERSON 3', false), (2, 'PERSON 4', true), (3, 'Maria', true), (4, 'info7', false), (5, 'EMAIL 20', true), (6, '', true)) v(id, termo, fica)")
def leak_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = _values(spark, "(1, 'PERSON 3'), (2, 'PERSON 4'), (3, 'Maria'), (4, 'info7'), (5, 'EMAIL 20'), (6, '') AS v(id, termo)")
    context = F.lit("Visto [ PERSON 3 ] e [INFO7]; código EMAIL 20, PERSON 4.")
    return rows.select("id", "termo", (F.size(text.drop_leaked_tags(F.array("termo"), context)) == 1).alias("fica"))


@query("SELECT id, regexp_replace(regexp_replace(regexp_replace(nome_identificador, '[\\s/\\\\:_\\[\\]()]+', '-', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g') AS arquivo FROM p02_brkga_sessoes")
def session_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "p02_brkga_sessoes", "id", "nome_identificador").select("id", text.slug(F.col("nome_identificador")).alias("arquivo"))


@query("SELECT * FROM (VALUES ('1_2_mascara_s57-s58_uniao_a-b.json', 'uniao_a-b', 'Uniao', 2), ('1_2_mascara_s57_unico_a.json', 'unico_a', 'Unico', 1), ('1_2_mascara_s1-s2-s3_interseccao_x_y.json', 'interseccao_x_y', 'Interseccao', 3), ('solto.json', 'solto', 'Uniao', 1)) v(nome, modelo, modo, nivel)")
def artefact_name_parts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("nome")
    rows = _values(spark, "('1_2_mascara_s57-s58_uniao_a-b.json'), ('1_2_mascara_s57_unico_a.json'), ('1_2_mascara_s1-s2-s3_interseccao_x_y.json'), ('solto.json') AS v(nome)")
    return rows.select("nome", text.artefact_model(n).alias("modelo"), text.artefact_mode(n).alias("modo"), text.artefact_level(n).alias("nivel"))


@query("SELECT doc_id, CAST(length(text) - length(replace(text, 'a', '')) AS INTEGER) AS erros FROM documents")
def alignment_errors(spark: SparkSession, d: str) -> DataFrame:
    mask = F.translate("text", "0123456789a", "**********é")
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", text.misaligned(F.col("text"), mask, "*").alias("erros"))


@query(r"SELECT doc_id, CASE WHEN text IS NULL THEN -1 ELSE CAST(len(list_filter(regexp_split_to_array(text, '[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]+'), lambda w: w <> '')) AS INTEGER) END AS tokens FROM documents")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", text.token_count(F.col("text")).alias("tokens"))


# --- dictionary, masks, tags ----------------------------------------------------------------


@query("""
WITH r AS (SELECT rec_idx, lower(descricao) AS t, ' ' || regexp_replace(lower(descricao), '[^\\p{L}\\p{N}]', ' ', 'g') || ' ' AS b FROM prontuarios WHERE descricao IS NOT NULL),
k AS (SELECT DISTINCT texto_original AS termo, lower(texto_original) AS low, ' ' || regexp_replace(lower(texto_original), '[^\\p{L}\\p{N}]', ' ', 'g') || ' ' AS b FROM p02_conhecimento WHERE texto_original <> '')
SELECT rec_idx, termo FROM r, k WHERE contains(r.t, k.low) AND contains(r.b, k.b)
""")
def dictionary_hits(spark: SparkSession, d: str) -> DataFrame:
    records = spread(table(spark, d, "prontuarios", "rec_idx", "descricao")).withColumnRenamed("descricao", "texto")
    terms = table(spark, d, TERMS, "texto_original").select(F.col("texto_original").alias("termo")).distinct()
    return spans.dictionary_spans(records, terms).select("rec_idx", "termo").distinct()


@query()
def mask_dictionary(spark: SparkSession, d: str) -> DataFrame:
    records = spread(table(spark, d, "prontuarios", "rec_idx", "descricao")).withColumnRenamed("descricao", "texto")
    return spans.masks(records, table(spark, d, TERMS), ("*", "#"))


@query("SELECT rec_idx, length(descricao) AS tamanho, CASE WHEN descricao IS NOT NULL THEN 0 END AS desalinhados FROM prontuarios")
def mask_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Every mask has its text's length and differs from it in mask characters only."""
    rows = mask_dictionary(spark, d)
    same = F.length("texto") == F.length("mascara")
    return rows.select("rec_idx", F.length("mascara").cast("long").alias("tamanho"), F.when(same, text.misaligned(F.col("texto"), F.col("mascara"), "*#")).otherwise(F.lit(None)).alias("desalinhados"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "prontuarios", "rec_idx", "descricao")).select("rec_idx", text.clean_record(F.col("descricao")).alias("texto"))


def _session(spark: SparkSession, d: str, session: int) -> DataFrame:
    return table(spark, d, TERMS, "sessao_id", "tipo", "texto_original", "id_local_sessao").where(F.col("sessao_id") == session)


def _all_terms(spark: SparkSession, d: str) -> DataFrame:
    """The terms of all sessions, under new ids, as those of session 1."""
    terms = table(spark, d, TERMS)
    rows = knowledge.union_sessions(terms, _sessions(terms))
    return rows.select(F.lit(1).cast("long").alias("sessao_id"), "tipo", "texto_original", F.col("id").alias("id_local_sessao"))


@query("SELECT rec_idx, true AS igual FROM prontuarios")
def tag_and_restore(spark: SparkSession, d: str) -> DataFrame:
    rows = stage(_records(spark, d), "records")
    tagged, known = tags.anonymise(rows, _all_terms(spark, d), 1, "⦃", "⦄")
    back = tags.restore(stage(tagged, "tagged"), stage(known, "known"), "⦃", "⦄")
    return back.withColumnRenamed("texto", "volta").join(rows, "rec_idx").select("rec_idx", (F.col("volta") == F.col("texto")).alias("igual"))


@query()
def tagged_texts(spark: SparkSession, d: str) -> DataFrame:
    return tags.anonymise(_records(spark, d), _all_terms(spark, d), 1, "⦃", "⦄")[0]


@query()
def anonymised_records(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.run(table(spark, d, "prontuarios"), _all_terms(spark, d), 1)[0]


# --- knowledge ------------------------------------------------------------------------------


@query("SELECT 1 AS sessao_id, tipo, texto_original, CAST(max(id_local_sessao) AS INTEGER) AS id_local_sessao FROM (SELECT tipo, texto_original, id_local_sessao FROM p02_conhecimento WHERE sessao_id = 1 AND (tipo, texto_original) NOT IN (SELECT (tipo, texto_original) FROM p02_conhecimento WHERE sessao_id = 2) UNION ALL SELECT tipo, texto_original, id_local_sessao FROM p02_conhecimento WHERE sessao_id = 2) GROUP BY ALL")
def knowledge_upsert(spark: SparkSession, d: str) -> DataFrame:
    one, two = _session(spark, d, 1), _session(spark, d, 2).withColumn("sessao_id", F.lit(1).cast("long"))
    return knowledge.upsert(one, two).withColumn("sessao_id", F.col("sessao_id").cast("int"))


@query("SELECT tipo, texto_original, CAST(row_number() OVER (PARTITION BY tipo ORDER BY s, i, texto_original) AS INTEGER) AS id FROM (SELECT tipo, texto_original, min(sessao_id) AS s, min_by(id_local_sessao, (sessao_id, id_local_sessao)) AS i FROM p02_conhecimento WHERE sessao_id IN (1, 2, 3) GROUP BY ALL)")
def knowledge_union(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.union_sessions(table(spark, d, TERMS), [1, 2, 3])


@query("SELECT tipo, texto_original, CAST(row_number() OVER (PARTITION BY tipo ORDER BY texto_original) AS INTEGER) AS id FROM (SELECT tipo, texto_original FROM p02_conhecimento WHERE sessao_id IN (1, 2) GROUP BY ALL HAVING count(DISTINCT sessao_id) = 2 OR tipo = 'unknown')")
def knowledge_intersect(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.intersect_sessions(table(spark, d, TERMS), [1, 2])


@query("SELECT sessao_id, CASE WHEN tipo = 'revisao' THEN 'revisao_arquivada' ELSE tipo END AS tipo, texto_original, id_local_sessao FROM p02_conhecimento")
def archived_reviews(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, TERMS, "sessao_id", "tipo", "texto_original", "id_local_sessao")
    for session in _sessions(known):
        known = knowledge.retype(known, session, "revisao", "revisao_arquivada")
    return known


@query("SELECT sessao_id, tipo, texto_original, max(id_local_sessao) AS id_local_sessao FROM p02_conhecimento WHERE sessao_id IS NOT NULL GROUP BY ALL")
def loaded_knowledge(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, TERMS)
    each = [knowledge.load(terms, x).withColumn("sessao_id", F.lit(x).cast("long")) for x in _sessions(terms)]
    return reduce(DataFrame.unionByName, each).select("sessao_id", "tipo", "texto_original", "id_local_sessao")


def _sessions(terms: DataFrame) -> list[int]:
    return [r[0] for r in terms.select("sessao_id").where("sessao_id IS NOT NULL").distinct().orderBy("sessao_id").collect()]


@query("SELECT tipo, texto_original, CAST(row_number() OVER (PARTITION BY tipo ORDER BY s, i, texto_original) AS INTEGER) AS id FROM (SELECT tipo, texto_original, min(sessao_id) AS s, min_by(id_local_sessao, (sessao_id, id_local_sessao)) AS i FROM p02_conhecimento WHERE sessao_id IS NOT NULL GROUP BY ALL)")
def knowledge_union_all(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, TERMS)
    return knowledge.union_sessions(terms, _sessions(terms))


@query("SELECT tipo, texto_original, CAST(row_number() OVER (PARTITION BY tipo ORDER BY texto_original) AS INTEGER) AS id FROM (SELECT tipo, texto_original FROM p02_conhecimento WHERE sessao_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT sessao_id) = (SELECT count(DISTINCT sessao_id) FROM p02_conhecimento) OR tipo = 'unknown')")
def knowledge_intersect_all(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, TERMS)
    return knowledge.intersect_sessions(terms, _sessions(terms))


@query("SELECT sessao_id, coalesce(max(CASE WHEN fase_atual = 'linha_a_linha' THEN evolucao_index END), -1) AS ultima_linha, coalesce(min(CASE WHEN fase_atual = 'ngram' THEN tamanho_ngram END), 102) AS proximo_n FROM p02_logs_execucao GROUP BY 1")
def resume_points(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.resume_points(table(spark, d, RUNS, "sessao_id", "fase_atual", "evolucao_index", "tamanho_ngram"))


_BLANK = r"[\s\x0b\x{85}\p{Z}]"


@query(f"WITH l AS (SELECT rec_idx, unnest(string_split(descricao, chr(10))) AS linha FROM prontuarios), b AS (SELECT DISTINCT trim({_KEY.format('texto_original')}) AS k FROM p02_conhecimento WHERE tipo = 'boilerplate') SELECT rec_idx, linha, CAST(count(*) AS BIGINT) AS n FROM l WHERE length({_STRIP.format('linha')}) >= 15 AND trim({_KEY.format('linha')}) IN (SELECT k FROM b WHERE k <> '') GROUP BY ALL")
def boilerplate_variants(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "prontuarios", "rec_idx", "descricao").select("rec_idx", F.explode(F.split("descricao", "\n")).alias("linha"))
    return knowledge.variants_of_known(lines, table(spark, d, TERMS), "linha").groupBy("rec_idx", "linha").agg(F.count("*").alias("n"))


@query()
def safe_fragments(spark: SparkSession, d: str) -> DataFrame:
    records = stage(_records(spark, d), "records")
    found = spans.dictionary_spans(records, table(spark, d, TERMS).where("tipo IN ('nome', 'endereco', 'info')").select(F.col("texto_original").alias("termo")).distinct())
    per = found.groupBy("rec_idx").agg(F.collect_set("termo").alias("termos"))
    rows = records.join(per, "rec_idx", "left").withColumn("termos", F.coalesce("termos", F.array().cast("array<string>")))
    return rows.select("rec_idx", F.explode(knowledge.safe_fragments(F.col("texto"), F.col("termos"))).alias("fragmento"))


# --- n-grams --------------------------------------------------------------------------------

_TOKENS = r"""
t AS (SELECT upper(prontuario) AS subject, rec_idx, list_filter(regexp_split_to_array(regexp_replace(lower(descricao), '[^\p{L}\p{N}_\s\x0b\x{85}\p{Z}⦃]', ' ', 'g'), '[\s\x0b\x{85}\p{Z}]+'), lambda w: w <> '') AS w FROM prontuarios WHERE descricao IS NOT NULL AND prontuario IS NOT NULL AND prontuario <> '')"""


def _ngram_sql(n: int, source: str = "t") -> str:
    return f"g AS (SELECT subject, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS frase FROM {source} WHERE len(w) >= {n})"


@query(f"WITH {_TOKENS}, {_ngram_sql(10)} SELECT frase, CAST(count(*) AS BIGINT) AS total, CAST(count(DISTINCT subject) AS BIGINT) AS pacientes FROM g GROUP BY 1 HAVING count(DISTINCT subject) >= 5")
def ngram_candidates(spark: SparkSession, d: str) -> DataFrame:
    frags = ngrams.corpus(spread(table(spark, d, "prontuarios", "rec_idx", "prontuario", "descricao")), "prontuario", "descricao", "rec_idx")
    return ngrams.candidates(frags, 10, 5).select("frase", "total", "pacientes")


_PHRASE = "nega alergias medicamentosas"


@query(rf"WITH {_TOKENS}, c AS (SELECT subject, unnest(string_split(regexp_replace(array_to_string(w, ' '), '(^|[^\p{{L}}\p{{N}}_])nega alergias medicamentosas($|[^\p{{L}}\p{{N}}_])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS s FROM t), u AS (SELECT subject, list_filter(string_split(s, ' '), lambda x: x <> '') AS w FROM c), {_ngram_sql(4, 'u')} SELECT frase, CAST(count(*) AS BIGINT) AS total, CAST(count(DISTINCT subject) AS BIGINT) AS pacientes FROM g GROUP BY 1 HAVING count(DISTINCT subject) >= 5")
def ngram_after_removal(spark: SparkSession, d: str) -> DataFrame:
    frags = ngrams.corpus(spread(table(spark, d, "prontuarios", "rec_idx", "prontuario", "descricao")), "prontuario", "descricao", "rec_idx")
    return ngrams.candidates(ngrams.without_phrases(frags, [_PHRASE]), 4, 5).select("frase", "total", "pacientes")


# --- gold labels and scores -----------------------------------------------------------------


@query()
def gold_clean(spark: SparkSession, d: str) -> DataFrame:
    out = goldlabels.clean_inline(table(spark, d, "dataset_registros", "id", "text", "labels"))
    return out.select("id", "texto_limpo", F.size("rotulos").alias("rotulos"), "com_erro")


@query("SELECT id, CAST(count(*) AS BIGINT) AS rotulos, CAST(count(*) FILTER (coalesce(substring(text, r.first_position + 1, r.last_position - r.first_position), '') IS DISTINCT FROM r.word) AS BIGINT) AS errados FROM (SELECT id, text, unnest(labels) AS r FROM dataset_registros) GROUP BY 1")
def label_errors(spark: SparkSession, d: str) -> DataFrame:
    return goldlabels.label_errors(table(spark, d, "dataset_registros", "id", "text", "labels"), "id", "text", "labels")


def _masked_gold(spark: SparkSession, d: str) -> DataFrame:
    """Digits masked, and the letters a and o as unknown: a mask that SQL can derive too."""
    return table(spark, d, "dataset_registros", "id", "text", "labels").withColumn("mascara", F.translate("text", "0123456789ao", "**********##"))


_GOLD = "m AS (SELECT id, text, labels, translate(text, '0123456789ao', '**********##') AS mask FROM dataset_registros), "
_VERDICT = (
    _GOLD
    + """l AS (SELECT id, mask, unnest(labels) AS r FROM m),
s AS (SELECT id, r.subcategory AS subcategory, r.word AS word, r.last_position - r.first_position AS n, r.last_position AS e, length(mask) AS z, substring(mask, r.first_position + 1, r.last_position - r.first_position) AS s FROM l),
c AS (SELECT *, length(s) - length(replace(s, '*', '')) AS p, length(s) - length(replace(s, '#', '')) AS u FROM s),
v AS (SELECT id, coalesce(subcategory, 'OTHER') AS subcategory, word, CASE WHEN n <= 0 THEN 'total' WHEN e > z THEN 'fn' WHEN (p + u) / n > 0.5 AND p >= u THEN 'tp' WHEN (p + u) / n > 0.5 THEN 'tp_unknown' ELSE 'fn' END AS veredito FROM c)"""
)
_CHARS = ("*", "#")


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    return scoring.verdicts(_masked_gold(spark, d), "id", "labels", "mascara", _CHARS)


@query(f"WITH {_VERDICT} SELECT id, subcategory, word, veredito, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY ALL")
def label_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d).groupBy("id", "subcategory", "word", "veredito").agg(F.count("*").alias("n"))


@query(f"WITH {_VERDICT} SELECT subcategory, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (veredito IN ('tp', 'tp_unknown')) AS BIGINT) AS achados, CAST(count(*) FILTER (veredito = 'fn') AS BIGINT) AS perdidos, count(*) FILTER (veredito IN ('tp', 'tp_unknown')) / count(*) AS recall FROM v GROUP BY 1")
def score_by_category(spark: SparkSession, d: str) -> DataFrame:
    return scoring.by_category(_verdicts(spark, d))


@query(f"WITH {_VERDICT} SELECT word AS termo, CAST(count(*) AS BIGINT) AS total FROM v WHERE veredito = 'fn' AND word IS NOT NULL GROUP BY 1")
def missed_terms(spark: SparkSession, d: str) -> DataFrame:
    return scoring.term_frequency(_verdicts(spark, d).where("veredito = 'fn'"), "word")


_COVERED = "least(r.last_position, length({0})) > i AND greatest(r.first_position, 0) <= i"
_RUNS = (
    "g AS (SELECT id, text, mask, labels, unnest(range(0, length(mask))) AS i FROM m), "
    "f AS (SELECT id, text, i FROM g WHERE substring(mask, i + 1, 1) IN ('*', '#') AND len(list_filter(coalesce(labels, []), lambda r: " + _COVERED.format("mask") + ")) = 0), "
    "o AS (SELECT id, text, i, i - row_number() OVER (PARTITION BY id ORDER BY i) AS ilha FROM f), "
    "q AS (SELECT id, min(i) AS ini, count(*) AS tamanho, any_value(text) AS text FROM o GROUP BY id, ilha HAVING count(*) >= 3)"
)


@query(f"WITH {_GOLD} {_RUNS} SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY ini) - 1 AS INTEGER) AS ordem, CAST(ini AS INTEGER) AS ini, substring(text, ini + 1, tamanho) AS termo, CAST(tamanho AS INTEGER) AS tamanho FROM q")
def residual_runs(spark: SparkSession, d: str) -> DataFrame:
    return scoring.residual_runs(_masked_gold(spark, d), "id", "text", "labels", "mascara", _CHARS)


@query(
    f"WITH {_VERDICT}, {_RUNS}, "
    "a AS (SELECT CAST(count(*) AS BIGINT) AS rotulos, CAST(count(*) FILTER (veredito = 'tp') AS BIGINT) AS tp, CAST(count(*) FILTER (veredito = 'tp_unknown') AS BIGINT) AS tp_unknown, CAST(count(*) FILTER (veredito = 'fn') AS BIGINT) AS fn FROM v), "
    "b AS (SELECT CAST(count(*) AS BIGINT) AS fp, CAST(coalesce(sum(tamanho), 0) AS BIGINT) AS fp_chars FROM q), "
    "e AS (SELECT *, (tp + tp_unknown) / (tp + tp_unknown + fp) AS precision, (tp + tp_unknown) / (tp + tp_unknown + fn) AS recall FROM a, b) "
    "SELECT *, 2 * precision * recall / (precision + recall) AS f1, 5 * precision * recall / (4 * precision + recall) AS f2 FROM e"
)
def score_totals(spark: SparkSession, d: str) -> DataFrame:
    return scoring.totals(_verdicts(spark, d), residual_runs(spark, d))


_RELEVANT = ", ".join(f"'{x}'" for x in scoring.RELEVANT)


@query(f"WITH m AS (SELECT id, text, labels FROM dataset_registros), g AS (SELECT id, i, substring(text, i + 1, 1) AS c, len(list_filter(coalesce(labels, []), lambda r: r.subcategory IN ({_RELEVANT}) AND {_COVERED.format('text')})) > 0 AS hit FROM (SELECT *, unnest(range(0, length(text))) AS i FROM m)), s AS (SELECT id, string_agg(CASE WHEN hit THEN '*' ELSE c END, '' ORDER BY i) AS mascara FROM g GROUP BY id) SELECT m.id, CASE WHEN m.text = '' THEN '' ELSE s.mascara END AS mascara FROM m LEFT JOIN s USING (id)")
def ground_truth_mask(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dataset_registros", "id", "text", "labels").select("id", scoring.ground_truth(F.col("text"), F.col("labels"), "*", scoring.RELEVANT).alias("mascara"))


@query()
def score_views(spark: SparkSession, d: str) -> DataFrame:
    return scoring.error_views(_masked_gold(spark, d), "id", "text", "labels", "mascara", _CHARS)


@query(f"WITH {_VERDICT}, {_RUNS} SELECT substring(text, ini + 1, tamanho) AS termo, CAST(count(*) AS BIGINT) AS total FROM q GROUP BY 1")
def wrong_terms(spark: SparkSession, d: str) -> DataFrame:
    return scoring.term_frequency(residual_runs(spark, d), "termo")


@query("SELECT id, CAST(length(text) AS BIGINT) AS n, CAST(coalesce(sum(length(text)) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM dataset_registros WHERE text IS NOT NULL")
def record_offsets(spark: SparkSession, d: str) -> DataFrame:
    return scoring.offsets(table(spark, d, "dataset_registros", "id", "text").where("text IS NOT NULL").withColumn("k", F.length("text")), "id", "k")


# --- lattice --------------------------------------------------------------------------------

_HISTORY = "(1, 0.5, false), (2, 0.4, false), (3, 0.6, false), (4, 0.1, false)"
_PAIRS = "('1-2', 0.55, false), ('1-3', 0.7, false), ('2-3', 0.65, false), ('1-4', 0.5, true), ('2-4', 0.45, false), ('3-4', 0.61, false)"


@query(f"WITH h AS (SELECT * FROM (VALUES {_PAIRS}) v(c, f2, podado)), a AS (SELECT c, f2, CAST(string_split(c, '-')[1] AS INTEGER) AS x, CAST(string_split(c, '-')[2] AS INTEGER) AS y FROM h WHERE NOT podado) SELECT concat_ws('-', p.x, p.y, q.y) AS combo, CAST(greatest(p.f2, q.f2, r.f2) AS DOUBLE) AS melhor_pai FROM a p JOIN a q ON p.x = q.x AND p.y < q.y JOIN a r ON r.x = p.y AND r.y = q.y")
def lattice_level(spark: SparkSession, d: str) -> DataFrame:
    h = _values(spark, f"{_PAIRS} AS v(c, f2, podado)").select(F.split("c", "-").cast("array<int>").alias("combo"), F.col("f2").cast("double").alias("f2"), "podado")
    return lattice.next_level(h, 3).select(F.array_join(F.col("combo").cast("array<string>"), "-").alias("combo"), "melhor_pai")


def _search(spark: SparkSession, d: str, mode: str) -> DataFrame:
    """Over all sessions of the table and all levels."""
    gold = table(spark, d, "dataset_registros", "id", "text", "labels").select(F.col("id").alias("rec_idx"), F.col("text").alias("texto"), "labels")
    terms = table(spark, d, TERMS).withColumn("sessao_id", F.col("sessao_id").cast("int"))
    out = lattice.search(gold, terms, _sessions(terms), mode)
    return out.select(F.array_join(F.col("combo").cast("array<string>"), "-").alias("combo"), "f2", "podado")


@query()
def lattice_search(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "uniao")


@query()
def lattice_search_intersect(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "interseccao")


# --- loops ----------------------------------------------------------------------------------


@query(r"""
WITH t AS (SELECT id, list_filter(regexp_split_to_array(raciocinio, '[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]+'), lambda w: w <> '') AS w FROM p02_brkga_logs_llm WHERE raciocinio IS NOT NULL)
SELECT id, CASE WHEN len(w) < 3 THEN 0.0 ELSE 1 - len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], chr(1))))) / (len(w) - 2) END AS repetido FROM t
""")
def repeated_ratio(spark: SparkSession, d: str) -> DataFrame:
    w = F.filter(F.split("raciocinio", r"(?U)\s+"), lambda x: x != "")
    g = ngrams.grams(F.col("w"), 3)
    rows = spread(table(spark, d, LOGS, "id", "raciocinio")).where("raciocinio IS NOT NULL").select("id", w.alias("w"))
    return rows.select("id", F.when(F.size("w") < 3, F.lit(0.0)).otherwise(1 - F.size(F.array_distinct(g)) / F.size(g)).alias("repetido"))


@query("SELECT id, length(raciocinio) >= 300 AND right(raciocinio, 100) = substring(raciocinio, length(raciocinio) - 199, 100) AND right(raciocinio, 100) = substring(raciocinio, length(raciocinio) - 299, 100) AS igual FROM p02_brkga_logs_llm WHERE raciocinio IS NOT NULL")
def exact_window(spark: SparkSession, d: str) -> DataFrame:
    t, n = F.col("raciocinio"), F.length("raciocinio")
    part = lambda k: F.substring(t, n - 100 * k + 1, F.lit(100))
    return table(spark, d, LOGS, "id", "raciocinio").where(t.isNotNull()).select("id", F.when(n >= 300, (part(1) == part(2)) & (part(1) == part(3))).otherwise(False).alias("igual"))


@query()
def loop_detect_batch(spark: SparkSession, d: str) -> DataFrame:
    return loops.detect_texts(spread(table(spark, d, LOGS, "id", "raciocinio")), "id", "raciocinio")


@query()
def detector_comparison(spark: SparkSession, d: str) -> DataFrame:
    return loops.compare_detectors(spread(table(spark, d, LOGS, "id", "raciocinio")), "id", "raciocinio")


@query()
def stateful_loops(spark: SparkSession, d: str) -> DataFrame:
    """The reasoning of the execution logs as a stream of chunks, read from files."""
    base = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    t = F.col("raciocinio")
    rows = table(spark, d, RUNS, "id", "raciocinio").where("length(raciocinio) > 0").select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.ceil(F.length(t) / 4).cast("int") - 1), lambda k: F.substring(t, k * 4 + 1, F.lit(4)))).alias("seq", "trecho"))
    rows.write.parquet(f"{base}/in")
    found = loops.detect_stream(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), "id", "seq", "trecho")
    name, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    old = spark.conf.get(name, None)
    spark.conf.set(name, rocks)
    try:
        run = found.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(name, old) if old else spark.conf.unset(name)
    return spark.read.schema(found.schema).parquet(f"{base}/out")


# --- extractor ------------------------------------------------------------------------------


def _scripted() -> extractor.Scripted:
    good = '{"map_nomes": ["Ana Lima"], "map_idades": ["39 anos"]}'
    return extractor.Scripted(
        {
            "bom": [{"resposta": good}],
            "segundo": [{"status_erro": "timeout"}, {"resposta": f"```json\n{good}\n```"}],
            "vazio": [{"resposta": "  "}],
            "laco": [{"status_erro": "loop", "raciocinio": "aaaa bbbb", "loop_inicio": 4}, {"resposta": good}],
            "duvida": [{"resposta": '{"duvidas_pendentes": ["Rosa"]}'}],
        }
    )


@query()
def extractor_retry(spark: SparkSession, d: str) -> DataFrame:
    rows = _values(spark, "('bom', 'p'), ('segundo', 'p'), ('vazio', 'p'), ('laco', 'p'), ('duvida', 'p') AS v(chave, prompt)").withColumn("prompt_bruto", F.lit("b"))
    return extractor.two_rounds(rows, _scripted()).select("chave", "rodada", "tentativa", "resposta", "status_erro", "houve_falha", "final")


@query("SELECT * FROM (VALUES (1, 'penso', 'digo'), (2, NULL, 'só isto'), (3, '', 'x'), (4, NULL, NULL)) v(id, raciocinio, resposta)")
def thinking_split(spark: SparkSession, d: str) -> DataFrame:
    rows = _values(spark, "(1, '<think>penso</think>  digo'), (2, 'só isto'), (3, '<think></think>x'), (4, NULL) AS v(id, t)")
    think, answer = extractor.split_thinking(F.col("t"))
    return rows.select("id", think.alias("raciocinio"), answer.alias("resposta"))


@query(r"WITH t AS (SELECT id, llm_raw_response AS t, regexp_matches(llm_raw_response, '(?s)<think>.*?</think>') AS dentro FROM p02_brkga_logs_llm) SELECT id, CASE WHEN dentro THEN regexp_extract(t, '(?s)<think>(.*?)</think>\s*(.*)', 1) END AS raciocinio, CASE WHEN dentro THEN regexp_extract(t, '(?s)<think>(.*?)</think>\s*(.*)', 2) ELSE t END AS resposta FROM t")
def raw_responses_split(spark: SparkSession, d: str) -> DataFrame:
    think, answer = extractor.split_thinking(F.col("llm_raw_response"))
    return table(spark, d, LOGS, "id", "llm_raw_response").select("id", think.alias("raciocinio"), answer.alias("resposta"))


@query("SELECT id, CASE WHEN eval_duration_sec > 0 AND NOT isnan(eval_duration_sec) THEN eval_count / eval_duration_sec END AS taxa, CASE WHEN status_erro = 'timeout' THEN 'timeout' WHEN status_erro IS NOT NULL THEN 'erro' WHEN done_reason IS NOT NULL AND done_reason <> 'stop' THEN 'erro_stop_reason' END AS estado FROM p02_brkga_logs_llm")
def call_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, LOGS, "id", "eval_count", "eval_duration_sec", "status_erro", "done_reason")
    sec = F.col("eval_duration_sec")
    return rows.select("id", F.when((sec > 0) & ~F.isnan(sec), F.col("eval_count") / sec).alias("taxa"), extractor.stop_status(F.col("done_reason"), F.col("status_erro")).alias("estado"))


@query()
def answer_terms(spark: SparkSession, d: str) -> DataFrame:
    return extractor.answer_terms(table(spark, d, LOGS, "id", "texto_pre_llm", "resposta_bruta"), "resposta_bruta", "texto_pre_llm", "id").groupBy("id", "tipo").agg(F.count("*").alias("termos"))


# --- views ----------------------------------------------------------------------------------


@query("SELECT s.loop_tipo, CAST(count(*) AS BIGINT) AS total_itens FROM p02_brkga_simular_injection s JOIN p02_brkga_logs_llm l ON s.log_llm_id = l.id JOIN p02_brkga_resultados r ON l.resultado_id = r.id WHERE s.loop_detectado GROUP BY 1")
def first_detector(spark: SparkSession, d: str) -> DataFrame:
    return views.first_detector(table(spark, d, SIMULATED), table(spark, d, LOGS), table(spark, d, RESULTS))


@query("SELECT r.sessao_brkga_id, s.loop_tipo, CAST(count(*) AS BIGINT) AS total_itens FROM p02_brkga_simular_injection s JOIN p02_brkga_logs_llm l ON s.log_llm_id = l.id JOIN p02_brkga_resultados r ON l.resultado_id = r.id WHERE s.loop_detectado AND r.sessao_brkga_id = 7 GROUP BY ALL")
def first_detector_of_session(spark: SparkSession, d: str) -> DataFrame:
    return views.first_detector(table(spark, d, SIMULATED), table(spark, d, LOGS), table(spark, d, RESULTS), 7).withColumn("sessao_brkga_id", F.lit(7).cast("long"))


_COMPARED = "c AS (SELECT log_llm_id, CASE WHEN loop_tipo LIKE 'thinking%' THEN loop_tipo END AS artigo_tipo, posicao_corte AS pa, CASE WHEN tamanho_raciocinio_truncado IS NOT NULL THEN 'bloco' END AS det4_tipo, tamanho_raciocinio_truncado AS pb FROM p02_brkga_simular_injection), w AS (SELECT *, CASE WHEN artigo_tipo IS NOT NULL AND det4_tipo IS NOT NULL THEN CASE WHEN pa < pb THEN 'artigo' WHEN pb < pa THEN 'det4' ELSE 'empate' END WHEN artigo_tipo IS NOT NULL THEN 'artigo' WHEN det4_tipo IS NOT NULL THEN 'det4' ELSE 'nenhum' END AS vencedor FROM c)"


def _compared(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, SIMULATED)
    return loops.compared(s.select("log_llm_id", F.when(F.col("loop_tipo").startswith("thinking"), F.col("loop_tipo")).alias("artigo_tipo"), F.col("posicao_corte").alias("artigo_posicao"), F.when(F.col("tamanho_raciocinio_truncado").isNotNull(), "bloco").alias("det4_tipo"), F.col("tamanho_raciocinio_truncado").alias("det4_posicao")))


@query(f"WITH {_COMPARED} SELECT vencedor AS detector_mais_preciso, CAST(count(*) AS BIGINT) AS total_itens FROM w JOIN p02_brkga_logs_llm l ON w.log_llm_id = l.id WHERE l.houve_falha GROUP BY 1")
def winner_bucket(spark: SparkSession, d: str) -> DataFrame:
    return views.winner_bucket(_compared(spark, d), table(spark, d, LOGS))


@query(f"WITH {_COMPARED} SELECT CASE vencedor WHEN 'artigo' THEN artigo_tipo WHEN 'det4' THEN det4_tipo WHEN 'empate' THEN 'Empate (' || coalesce(artigo_tipo, 'NULL') || ' + ' || coalesce(det4_tipo, 'NULL') || ')' ELSE vencedor END AS tecnica_vencedora, CAST(count(*) AS BIGINT) AS total_itens FROM w JOIN p02_brkga_logs_llm l ON w.log_llm_id = l.id WHERE l.houve_falha GROUP BY 1")
def winner_detail(spark: SparkSession, d: str) -> DataFrame:
    return views.winner_detail(_compared(spark, d), table(spark, d, LOGS))


@query("SELECT l.id, r.sessao_brkga_id, r.temperature, r.top_k, r.repeat_penalty FROM p02_brkga_logs_llm l LEFT JOIN p02_brkga_resultados r ON l.resultado_id = r.id")
def logs_with_parameters(spark: SparkSession, d: str) -> DataFrame:
    return views.logs_with_parameters(table(spark, d, LOGS, "id", "resultado_id"), table(spark, d, RESULTS)).select("id", "sessao_brkga_id", "temperature", "top_k", "repeat_penalty")


@query("SELECT id FROM p02_brkga_logs_llm WHERE id NOT IN (SELECT log_llm_id FROM p02_brkga_simular_injection WHERE log_llm_id IS NOT NULL)")
def not_simulated(spark: SparkSession, d: str) -> DataFrame:
    return views.not_simulated(table(spark, d, LOGS, "id"), table(spark, d, SIMULATED, "log_llm_id"))


@query("SELECT id, f2, precision FROM p02_brkga_simular_injection ORDER BY f2 DESC NULLS LAST, precision DESC NULLS LAST, id LIMIT 20")
def top_metrics(spark: SparkSession, d: str) -> DataFrame:
    return views.top_metrics(table(spark, d, SIMULATED, "id", "f2", "precision"))


@query("SELECT r.id, CAST(r.fitness AS DOUBLE) AS fitness, CAST(count(*) AS BIGINT) AS usos FROM p02_brkga_resultados r JOIN p02_brkga_resultados w ON r.sessao_brkga_id = w.sessao_brkga_id AND r.temperature = w.temperature AND r.top_k = w.top_k AND r.top_p = w.top_p AND r.repeat_penalty = w.repeat_penalty AND r.repeat_last_n = w.repeat_last_n WHERE r.fitness IS NOT NULL GROUP BY ALL")
def fitness_cache(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, RESULTS)
    wanted = r.select("sessao_brkga_id", "temperature", "top_k", "top_p", "repeat_penalty", "repeat_last_n")
    return views.fitness_cache(r, wanted).groupBy("id", F.col("fitness").cast("double").alias("fitness")).agg(F.count("*").alias("usos"))


@query("SELECT coalesce(loop_tipo, 'nenhum') AS modo, CAST(posicao_corte IS NOT NULL AS INTEGER) AS nivel, CAST(count(*) AS BIGINT) AS n, max(f2) AS melhor_f2, min(precision) AS menor_precision, min(recall) AS menor_recall FROM p02_brkga_simular_injection GROUP BY ALL")
def chart_table(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, SIMULATED, "loop_tipo", "posicao_corte", "f2", "precision", "recall")
    return views.chart_table(rows.withColumn("modo", F.coalesce("loop_tipo", F.lit("nenhum"))).withColumn("nivel", F.col("posicao_corte").isNotNull().cast("int")))
