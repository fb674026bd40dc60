"""A whole de-identification run: mine phrases, ask the extractor, learn, tag, mask, score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velatura.config import Settings
from velatura.functions.text import MASK_CANDIDATES, clean_record, to_model_tags, valid_term
from velatura.operators import extractor, knowledge, ngrams, spans, tags
from velatura.session import stage

KNOWLEDGE = "sessao_id long, tipo string, texto_original string, id_local_sessao int"
PROMPT = "Liste em JSON os trechos que identificam pessoas.\n---\n"


def absent_characters(df: DataFrame, text_col: str, n: int = 2) -> list[str]:
    """The first n mask candidates that no text holds, in one pass; ValueError if there are fewer."""
    row = df.agg(*[F.coalesce(F.max(F.contains(F.col(text_col), F.lit(c))), F.lit(False)).alias(f"c{i}") for i, c in enumerate(MASK_CANDIDATES)]).first()
    free = [c for i, c in enumerate(MASK_CANDIDATES) if not row[i]]
    if len(free) < n:
        raise ValueError(f"only {len(free)} of {n} characters are absent from the texts")
    return free[:n]


def prepare(records: DataFrame) -> DataFrame:
    """rec_idx, prontuario, texto (clean) and bruto (as it came)."""
    return records.select("rec_idx", "prontuario", clean_record(F.col("descricao")).alias("texto"), F.coalesce("descricao", F.lit("")).alias("bruto"))


def learn(records: DataFrame, known: DataFrame, session: int, provider: Callable, ini: str, fim: str, settings: Settings = Settings(), start_after: int = -1) -> tuple[DataFrame, DataFrame]:
    """(knowledge, attempts): one pass of the extractor over the records after ``start_after``."""
    rows = records.where(F.col("rec_idx") > start_after)
    tagged = tags.apply_tags(rows, known, ini, fim, ["boilerplate"])
    prompts = tagged.join(rows.select("rec_idx", "bruto"), "rec_idx").select(
        F.col("rec_idx").cast("string").alias("chave"),
        F.concat(F.lit(PROMPT), to_model_tags(F.col("texto"), ini, fim)).alias("prompt"),
        F.concat(F.lit(PROMPT), F.col("bruto")).alias("prompt_bruto"),
    )
    tries = stage(extractor.two_rounds(prompts, provider, settings), "attempts")
    last = tries.where("final AND NOT houve_falha").groupBy("chave").agg(F.max_by("resposta", "rodada").alias("resposta"), F.max("prompt").alias("prompt"))
    found = extractor.answer_terms(last, "resposta", "prompt", "chave").where(valid_term(F.col("termo"), ini, fim))
    new = found.select(F.lit(session).cast("long").alias("sessao_id"), "tipo", F.col("termo").alias("texto_original"), F.col("chave").cast("long").alias("rec"), F.col("lista").alias("passo"), "pos")
    return stage(knowledge.register(known, new, ["rec", "passo", "pos"]), "knowledge"), tries


def run(records: DataFrame, known: DataFrame, session: int, provider: Callable | None = None, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(rows, knowledge): rec_idx, original, anonimizado and mascara of every record."""
    rows = stage(prepare(records), "records")
    ini, fim = absent_characters(rows, "bruto")
    pii, unknown = absent_characters(rows, "bruto", 4)[2:]
    if provider is not None:
        known, _ = learn(rows, known, session, provider, ini, fim, settings)
    tagged, known = tags.anonymise(rows.select("rec_idx", "texto"), known, session, ini, fim)
    masked = spans.masks(rows.select("rec_idx", F.col("bruto").alias("texto")), known, (pii, unknown))
    out = masked.select("rec_idx", F.col("texto").alias("original"), "mascara").join(tagged.select("rec_idx", F.col("texto").alias("anonimizado")), "rec_idx")
    return out, known


def safe_phrases(records: DataFrame, settings: Settings = Settings()) -> list[tuple[int, str]]:
    """Phrases of the n-gram phase: (n, phrase), longest first."""
    fragments = stage(ngrams.corpus(records, "prontuario", "texto", "rec_idx"), "fragments")
    return ngrams.mine(fragments, settings.ngram_max, settings.ngram_min, settings.min_subjects)
