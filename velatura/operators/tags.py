"""Reversible tags: write them for patterns and known terms, and restore the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velatura.functions.patterns import PATTERNS, places
from velatura.functions.text import quote
from velatura.operators import knowledge as K
from velatura.operators.ngrams import phrase_pattern
from velatura.operators.spans import _SPAN, SCAN_CLASS, dictionary_spans, rebuild, resolve_leftmost, span
from velatura.session import stage

# The kind under which each pattern's terms are registered
KIND_OF_PATTERN = {"CPF": "cpf", "DATA": "data", "DATA_EXTENSO": "data", "TEL": "tel", "CNS": "info", "EMAIL": "email"}


def pattern_terms(records: DataFrame, session: int, id_col: str = "rec_idx", text_col: str = "texto") -> DataFrame:
    """(sessao_id, tipo, texto_original, rec, passo, pos): every match, for registration."""
    parts = [F.struct(F.lit(i).alias("passo"), F.lit(KIND_OF_PATTERN[k]).alias("tipo"), places(F.col(text_col), p).alias("m")) for i, (k, p) in enumerate(PATTERNS.items())]
    rows = records.select(F.col(id_col).alias("rec"), F.inline(F.array(*parts)))
    rows = rows.select("rec", "passo", "tipo", F.inline("m"))
    return rows.select(F.lit(session).cast("long").alias("sessao_id"), "tipo", F.col("termo").alias("texto_original"), "rec", "passo", F.col("ini").alias("pos"))


def case_variants(records: DataFrame, known: DataFrame, session: int, kinds: list[str], id_col: str = "rec_idx", text_col: str = "texto") -> DataFrame:
    """Occurrences of known terms in another letter case, as terms to register themselves."""
    terms = known.where(F.col("tipo").isin(*kinds)).select("tipo", F.col("texto_original").alias("termo"))
    found = dictionary_spans(records, terms, id_col, text_col, SCAN_CLASS).join(records.select(id_col, text_col), id_col)
    own = F.substring(F.col(text_col), F.col("ini") + 1, F.col("fim") - F.col("ini"))
    rows = found.select(F.lit(session).cast("long").alias("sessao_id"), "tipo", own.alias("texto_original"), "termo", F.col(id_col).alias("rec"), F.lit(9).alias("passo"), F.col("ini").alias("pos"))
    return rows.where("texto_original <> termo").drop("termo")


def apply_tags(records: DataFrame, known: DataFrame, ini: str, fim: str, kinds: list[str] | None = None, id_col: str = "rec_idx", text_col: str = "texto", case_sensitive: bool = True) -> DataFrame:
    """(id, texto): each occurrence of a known term becomes its tag; leftmost first, then longest.

    ``case_sensitive`` leaves occurrences in another letter case alone (register them first,
    see ``case_variants``).
    """
    rows = known if kinds is None else known.where(F.col("tipo").isin(*kinds))
    terms = rows.select(F.col("texto_original").alias("termo"), K.tag(ini, fim, F.col("tipo"), F.col("id_local_sessao")).alias("marca"))
    found = dictionary_spans(records, terms, id_col, text_col, SCAN_CLASS)
    if case_sensitive:
        found = found.join(records.select(id_col, text_col), id_col).where(F.substring(F.col(text_col), F.col("ini") + 1, F.col("fim") - F.col("ini")) == F.col("termo"))
    per = found.groupBy(id_col).agg(F.collect_list(span(F.col("ini"), F.col("fim"), F.col("termo"), F.col("marca"))).alias("spans"))
    text = F.col(text_col)
    return records.select(id_col, text_col).join(per, id_col, "left").select(id_col, rebuild(text, resolve_leftmost(F.coalesce("spans", F.array().cast(f"array<{_SPAN}>")))).alias(text_col))


def anonymise(records: DataFrame, known: DataFrame, session: int, ini: str, fim: str, id_col: str = "rec_idx", text_col: str = "texto") -> tuple[DataFrame, DataFrame]:
    """(texts with tags, knowledge): patterns first, then personal terms, then boilerplates."""
    records = stage(records.select(id_col, text_col), "records")
    known = stage(K.register(known.where(F.col("sessao_id") == session), pattern_terms(records, session, id_col, text_col), ["rec", "passo", "pos"]), "known")
    variants = case_variants(records, known, session, ["nome", "endereco", "info", "boilerplate"], id_col, text_col)
    known = stage(K.register(known, variants, ["rec", "passo", "pos"]), "known")
    personal = ["cpf", "tel", "email", "data", "nome", "endereco", "info"]
    tagged = stage(apply_tags(records, known, ini, fim, personal, id_col, text_col), "tagged")
    return apply_tags(tagged, known, ini, fim, ["boilerplate"], id_col, text_col), known


def found_tags(text: Column, ini: str, fim: str) -> Column:
    """array<string> of the different tags of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"{quote(ini)}\\s*[A-Z]+\\s+\\d+\\s*{quote(fim)}"), F.lit(0)))


def restore(tagged: DataFrame, known: DataFrame, ini: str, fim: str, kinds: list[str] | None = None, id_col: str = "rec_idx", text_col: str = "texto") -> DataFrame:
    """(id, texto): tags back to their terms (all, or those of some kinds); unknown tags stay.

    A term that begins with a number also takes the rest of itself when it follows the tag.
    """
    rows = known if kinds is None else known.where(F.col("tipo").isin(*kinds))
    words = F.create_map(*[F.lit(x) for kv in K.TAG_OF_KIND.items() for x in kv])
    lookup = rows.select(F.element_at(words, F.col("tipo")).alias("palavra"), F.col("id_local_sessao").alias("numero"), F.col("texto_original").alias("termo"))
    text = F.col(text_col)
    tags = tagged.select(F.col(id_col), F.posexplode(found_tags(text, ini, fim)).alias("ordem", "marca"))
    tags = tags.withColumn("palavra", F.regexp_extract("marca", r"([A-Z]+)\s+\d+", 1)).withColumn("numero", F.regexp_extract("marca", r"(\d+)", 1).cast("int"))
    per = tags.join(lookup, ["palavra", "numero"]).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("ordem", "marca", "termo"))).alias("trocas"))

    def one(acc: Column, x: Column) -> Column:
        rest = F.regexp_extract(x["termo"], r"^\d+(\s+.*)$", 1)
        with_rest = F.concat(x["marca"], rest)
        return F.when((rest != "") & F.contains(acc, with_rest), F.replace(acc, with_rest, x["termo"])).otherwise(F.replace(acc, x["marca"], x["termo"]))

    out = tagged.select(id_col, text_col).join(per, id_col, "left")
    return out.select(id_col, F.when(F.col("trocas").isNull(), text).otherwise(F.aggregate("trocas", text, one)).alias(text_col))


def replace_terms(text: Column, pairs: Column) -> Column:
    """Replace listed terms, map<term, tag>, literally and longest first."""
    order = F.array_sort(F.transform(F.map_entries(pairs), lambda e: F.struct((-F.length(e["key"])).alias("n"), e["key"].alias("k"), e["value"].alias("v"))))
    return F.aggregate(order, text, lambda acc, e: F.replace(acc, e["k"], e["v"]))


def mark_term(text: Column, term: str, tag: str, padded: bool = False) -> Column:
    """Every occurrence of a term, whatever signs stand between its words, becomes a tag; ``padded`` puts blanks around it."""
    to = f" {tag} " if padded else tag
    return F.regexp_replace(text, phrase_pattern(term), F.lit(to.replace("\\", r"\\").replace("$", r"\$")))


def mark_for_review(records: DataFrame, known: DataFrame, session: int, term: str, ini: str, fim: str, kind: str = "revisao", id_col: str = "rec_idx", text_col: str = "texto") -> tuple[DataFrame, DataFrame]:
    """(texts, knowledge): a term is registered (for review, or as ``kind``) and tagged wherever it stands.

    A phrase that becomes boilerplate (``kind="boilerplate"``) gets blanks around its tag. A
    term that is known under a definitive kind keeps that kind's tag.
    """
    new = records.sparkSession.createDataFrame([(session, kind, term, 0)], "sessao_id long, tipo string, texto_original string, rec int")
    known = stage(K.register(known, new, ["rec"]), "known")
    row = known.where((F.col("sessao_id") == session) & (F.col("texto_original") == term.strip())).select(K.tag(ini, fim, F.col("tipo"), F.col("id_local_sessao")).alias("m"), (F.col("tipo") == kind).alias("own")).orderBy(F.desc("own")).first()
    return (records.select(id_col, mark_term(F.col(text_col), term, row.m, kind == "boilerplate").alias(text_col)) if row else records.select(id_col, text_col)), known


def replace_listed(records: DataFrame, known: DataFrame, session: int, terms: dict[str, list[str]], ini: str, fim: str, id_col: str = "rec_idx", text_col: str = "texto") -> tuple[DataFrame, DataFrame]:
    """(texts, knowledge): listed terms by kind are registered, then replaced literally, longest first."""
    rows = [(session, kind, t, i) for i, (kind, t) in enumerate((k, t) for k, ts in terms.items() for t in ts)]
    known = stage(K.register(known, records.sparkSession.createDataFrame(rows, "sessao_id long, tipo string, texto_original string, rec int"), ["rec"]), "known")
    mine = known.where((F.col("sessao_id") == session) & F.col("texto_original").isin(*[t.strip() for ts in terms.values() for t in ts]) & F.col("tipo").isin(*K.PRIORITY))
    pairs = {r.texto_original: r.m for r in mine.select("texto_original", K.tag(ini, fim, F.col("tipo"), F.col("id_local_sessao")).alias("m")).collect()}  # the caller's list
    if not pairs:
        return records.select(id_col, text_col), known
    both = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return records.select(id_col, replace_terms(F.col(text_col), both).alias(text_col)), known
