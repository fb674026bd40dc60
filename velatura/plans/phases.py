"""The phases of a run over stored tables: phrases, records in micro-batches, review.

Each phase reads what the tables hold, so a run that was stopped goes on where the log ends.
Knowledge is saved before the log says that a batch is done: a batch that was cut off is done again,
and terms it had saved already keep their ids.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velatura.config import Settings
from velatura.functions.text import comparison_key, strip, to_model_tags, valid_term
from velatura.operators import extractor, knowledge, ngrams, tags
from velatura.plans.pipeline import KNOWLEDGE, absent_characters, prepare, run
from velatura.session import exists, stage
from velatura.sources.sinks import VersionedTable, append_log

LOG = "sessao_id long, fase_atual string, evolucao_index long, tamanho_ngram int, rodada int, tentativa int, texto_original string, texto_pre_llm string, raciocinio string, resposta_bruta string, status_erro string, houve_falha boolean, houve_duvida boolean, chars_reducao_boilerplate int, created_at timestamp"
# Own wording of the three questions to the extractor
ASK_RECORD = "Liste em JSON os trechos que identificam pessoas.\n---\n"
ASK_PHRASE = "Esta frase, comum a muitos textos, identifica alguém? Responda em JSON.\n---\n"
ASK_REVIEW = "Classifique o termo como nome, endereco, outros ou seguro. Responda em JSON.\n---\n"


@dataclass(frozen=True)
class Tables:
    """Where a run keeps its knowledge and its log."""

    spark: SparkSession
    folder: str

    @property
    def knowledge(self) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.folder}/knowledge", KNOWLEDGE, knowledge.KEY)

    def of(self, session: int) -> DataFrame:
        return self.knowledge.read().where(F.col("sessao_id") == session)

    def log(self) -> DataFrame:
        path = f"{self.folder}/log"
        return self.spark.read.schema(LOG).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], LOG)

    def append(self, rows: DataFrame) -> None:
        names = [x.split()[0] for x in LOG.split(", ")]
        kinds = dict(x.split() for x in LOG.split(", "))
        full = rows.withColumn("created_at", F.current_timestamp())
        append_log(full.select(*[(F.col(n) if n in full.columns else F.lit(None)).cast(kinds[n]).alias(n) for n in names]), f"{self.folder}/log")

    def resume(self, session: int, settings: Settings) -> tuple[int, int]:
        """(last record done, next n-gram size)."""
        row = knowledge.resume_points(self.log().where(F.col("sessao_id") == session), settings.ngram_max).first()
        return (row.ultima_linha, row.proximo_n) if row else (-1, settings.ngram_max + 1)


def renumbered(tries: DataFrame) -> DataFrame:
    """Attempts of both rounds counted on, and whether a round ended in doubt (on its last attempt)."""
    p = extractor.parsed(F.col("resposta"))
    first = tries.where("rodada = 1").groupBy("chave").agg(F.count("*").alias("antes"))
    rows = tries.join(first, "chave", "left").withColumn("tentativa", F.when(F.col("rodada") > 1, F.col("tentativa") + F.coalesce("antes", F.lit(0))).otherwise(F.col("tentativa")))
    doubt = F.col("final") & F.coalesce(F.size(p["duvidas_pendentes"]) > 0, F.lit(False))
    return rows.withColumn("houve_duvida", doubt).drop("antes")


def _terms(answers: DataFrame, session: int, ini: str, fim: str, *order: str) -> DataFrame:
    """Terms of answers, for registration; doubts are kept for review only after the second round."""
    found = extractor.answer_terms(answers, "resposta", "prompt", "rodada", *order).where(valid_term(F.col("termo"), ini, fim)).where("tipo <> 'revisao' OR rodada = 2")
    return found.select(F.lit(session).cast("long").alias("sessao_id"), "tipo", F.col("termo").alias("texto_original"), *order, F.col("lista").alias("passo"), "pos")


def learn_batch(rows: DataFrame, known: DataFrame, session: int, provider: Callable, ini: str, fim: str, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(knowledge, log rows) of a batch of rec_idx, texto and bruto.

    The texts go to the extractor with their boilerplates tagged; what it finds is registered, and
    the rest of a text, in parts without any of its terms, becomes boilerplate. A failed record
    teaches nothing.
    """
    tagged = stage(tags.apply_tags(rows, known, ini, fim, ["boilerplate"]).join(rows.select("rec_idx", "bruto"), "rec_idx"), "batch")
    ask = lambda c: F.concat(F.lit(ASK_RECORD), c)
    prompts = tagged.select(F.col("rec_idx").cast("string").alias("chave"), ask(to_model_tags(strip(F.col("texto")), ini, fim)).alias("prompt"), ask(F.col("bruto")).alias("prompt_bruto"))
    tries = stage(renumbered(extractor.two_rounds(prompts, provider, settings)), "attempts")
    last = tries.where("final AND NOT houve_falha").groupBy("chave").agg(F.max_by(F.struct("resposta", "prompt", "rodada"), "rodada").alias("x"))
    answers = stage(last.select(F.col("chave").cast("long").alias("rec"), "x.*"), "answers")
    terms = stage(_terms(answers, session, ini, fim, "rec"), "terms")
    # parts of the clean text between the terms; tags end a part, as their phrases are known already
    per = terms.groupBy("rec").agg(F.collect_set("texto_original").alias("termos"))
    texts = tagged.join(answers.select(F.col("rec").alias("rec_idx")), "rec_idx", "left_semi").join(per.withColumnRenamed("rec", "rec_idx"), "rec_idx", "left")
    plain = F.regexp_replace("texto", f"{tags.quote(ini)}[^\\n]*?{tags.quote(fim)}", "\n")
    parts = knowledge.safe_fragments(plain, F.coalesce("termos", F.array().cast("array<string>")), settings.min_chars_safe, settings.min_words_safe)
    safe = texts.select(F.lit(session).cast("long").alias("sessao_id"), F.lit("boilerplate").alias("tipo"), F.col("rec_idx").alias("rec"), F.posexplode(parts).alias("pos", "texto_original"))
    new = terms.unionByName(safe.select("sessao_id", "tipo", "texto_original", "rec", F.lit(99).alias("passo"), "pos"))
    saved = tagged.select(F.col("rec_idx").cast("string").alias("chave"), F.col("bruto").alias("texto_original"), (F.length("bruto") - F.length("texto")).alias("chars_reducao_boilerplate"))
    log = tries.join(saved, "chave").select("*", F.lit(session).alias("sessao_id"), F.lit("linha_a_linha").alias("fase_atual"), F.col("chave").cast("long").alias("evolucao_index"), F.col("prompt").alias("texto_pre_llm"), F.col("resposta").alias("resposta_bruta"))
    return stage(knowledge.register(known, new, ["rec", "passo", "pos"]), "knowledge"), log


def row_phase(tables: Tables, records: DataFrame, session: int, provider: Callable, ini: str, fim: str, settings: Settings = Settings(), batch: int = 1000, start: int = 0, end: int | None = None, batches: int | None = None) -> int:
    """Records from ``start`` to before ``end``, in batches of consecutive rec_idx; the number of batches done.

    A batch knows what all batches before it have taught; ``batch=1`` is the strict order of records.
    Goes on after the last record in the log. ``batches`` ends it early.
    """
    span = records.agg(F.max("rec_idx").alias("b")).first()
    last = -1 if span.b is None else min(span.b, end - 1) if end is not None else span.b
    at, done = max(start, tables.resume(session, settings)[0] + 1), 0
    while at <= last and (batches is None or done < batches):
        stop = min(at + batch, last + 1)
        rows = records.where((F.col("rec_idx") >= at) & (F.col("rec_idx") < stop))
        known, log = learn_batch(rows, tables.of(session), session, provider, ini, fim, settings)
        tables.knowledge.upsert(known)
        tables.append(log)
        at, done = stop, done + 1
    return done


def judged_phrases(phrases: DataFrame, provider: Callable, settings: Settings = Settings()) -> DataFrame:
    """(frase, veredito, + attempt columns): duvida, pii or seguro; null where the answer can't be read."""
    prompts = phrases.select(F.col("frase").alias("chave"), F.concat(F.lit(ASK_PHRASE), F.col("frase")).alias("prompt"))
    tries = extractor.attempts(prompts, provider, settings).where("final")
    p = extractor.parsed(F.col("resposta"))
    some = lambda *names: F.size(F.flatten(F.array(*[p[n] for n in names]))) > 0
    verdict = F.when(F.col("houve_falha") | p.isNull(), F.lit(None)).when(some("duvidas_pendentes"), "duvida").when(some("map_nomes", "map_enderecos", "map_outros", "map_idades", "map_profissoes"), "pii").otherwise("seguro")
    return tries.select(F.col("chave").alias("frase"), verdict.alias("veredito"), "*")


def ngram_phase(tables: Tables, records: DataFrame, session: int, provider: Callable, ini: str, fim: str, settings: Settings = Settings()) -> int:
    """Phrases from the longest n down; the number of levels judged.

    A phrase in doubt goes to review; personal terms are registered and leave the corpus; a safe
    phrase becomes boilerplate and leaves the corpus; an answer that can't be read changes nothing.
    """
    fragments = stage(ngrams.corpus(records, "prontuario", "texto", "rec_idx", ini, fim), "fragments")
    known = tables.of(session).where("tipo = 'boilerplate'").select("texto_original")
    # phrases of earlier levels that a stopped run has learned already; at most one level's worth at a time is new
    fragments = stage(ngrams.without_phrases(fragments, [r[0] for r in known.toLocalIterator()]), "fragments")
    top = min(tables.resume(session, settings)[1] - 1, ngrams.largest_viable(fragments, settings.ngram_min, settings.ngram_max, settings.min_subjects))
    levels = 0
    for n in range(top, settings.ngram_min - 1, -1):
        level = stage(ngrams.candidates(fragments, n, settings.min_subjects), "level")
        judged = stage(judged_phrases(level, provider, settings).join(level.select("frase", "pacientes", "total"), "frase"), "judged")
        own = lambda kind: F.lit(kind).alias("tipo")
        place = [F.lit(session).cast("long").alias("sessao_id"), (-F.col("pacientes")).alias("rec"), F.lit(n).alias("passo")]
        safe = judged.where("veredito = 'seguro'").select(*place, own("boilerplate"), F.col("frase").alias("texto_original"), (-F.col("total")).alias("pos"))
        doubt = judged.where("veredito = 'duvida'").select(*place, own("revisao"), F.col("frase").alias("texto_original"), (-F.col("total")).alias("pos"))
        found = extractor.answer_terms(judged.where("veredito = 'pii'"), "resposta", "prompt", "pacientes", "total").where("tipo <> 'revisao'")
        pii = found.select(*place, "tipo", F.col("termo").alias("texto_original"), (-F.col("total")).alias("pos"))
        new = stage(safe.unionByName(doubt).unionByName(pii), "level-terms")
        if not new.isEmpty():
            tables.knowledge.upsert(knowledge.register(tables.of(session), new, ["rec", "pos", "passo"]))
            gone = [r[0] for r in new.where("tipo <> 'revisao'").select(comparison_key(F.col("texto_original"))).distinct().toLocalIterator()]
            fragments = stage(ngrams.without_phrases(fragments, gone), "fragments")
        tables.append(judged.select(F.lit(session).alias("sessao_id"), F.lit("ngram").alias("fase_atual"), F.lit(n).alias("tamanho_ngram"), "tentativa", "raciocinio", F.col("resposta").alias("resposta_bruta"), "status_erro", "houve_falha", (F.col("veredito") == "duvida").alias("houve_duvida")).unionByName(_mark(tables.spark, session, n), allowMissingColumns=True))
        levels += 1
    return levels


def _mark(spark: SparkSession, session: int, n: int) -> DataFrame:
    """A log row that says that the level is done, also where it had no phrase."""
    return spark.createDataFrame([(session, "ngram", n, False)], "sessao_id int, fase_atual string, tamanho_ngram int, houve_falha boolean")


def review_phase(tables: Tables, session: int, provider: Callable, settings: Settings = Settings()) -> int:
    """Terms under review get their final kind, or none; the review rows are archived. The number reviewed."""
    known = stage(tables.of(session), "known")
    rows = known.where("tipo = 'revisao'")
    prompts = rows.select(F.col("texto_original").alias("chave"), F.concat(F.lit(ASK_REVIEW), F.col("texto_original")).alias("prompt"))
    done = stage(extractor.attempts(prompts, provider, settings).where("final"), "reviewed")
    n = done.count()
    if n:
        error = F.when(F.col("houve_falha"), F.coalesce("status_erro", F.lit("erro")))
        kinds = done.select(F.col("chave").alias("texto_original"), extractor.review_kind(F.col("resposta"), error).alias("tipo")).where("tipo IS NOT NULL")
        new = kinds.join(rows.select("texto_original", "id_local_sessao"), "texto_original").select(F.lit(session).cast("long").alias("sessao_id"), "tipo", "texto_original", F.col("id_local_sessao").alias("rec"))
        rest = known.where("tipo <> 'revisao'")
        archived = rows.withColumn("tipo", F.lit("revisao_arquivada"))
        whole = knowledge.register(rest, new, ["rec"]).unionByName(archived.select(*rest.columns))
        others = tables.knowledge.read().where(F.col("sessao_id") != session)
        tables.knowledge.overwrite(others.unionByName(whole.select(*others.columns)))
    return n


def whole_run(tables: Tables, records: DataFrame, session: int, provider: Callable, settings: Settings = Settings(), batch: int = 1000) -> DataFrame:
    """All phases, then rec_idx, original, anonimizado and mascara of every record of rec_idx, prontuario, descricao.

    Called again after it was stopped, it goes on; called again after it ended, it only renders.
    """
    rows = stage(prepare(records), "records")
    ini, fim = absent_characters(rows, "bruto")
    ngram_phase(tables, rows, session, provider, ini, fim, settings)
    row_phase(tables, rows, session, provider, ini, fim, settings, batch)
    review_phase(tables, session, provider, settings)
    out, known = run(records, tables.of(session).where("tipo <> 'revisao_arquivada'"), session)
    tables.knowledge.upsert(known)
    return out
