"""Text normalisation as Column expressions.

All of them keep nulls null unless stated. White space and word characters are Unicode.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word character: any letter, digit or the underscore (combining marks aren't).
WORD = r"\p{L}\p{N}_"

# Mask characters in order of preference
MASK_CANDIDATES = ["⦃", "⦄", "⟦", "⟧", "⟨", "⟩", "❮", "❯", "*", "#", "@", "&", "%", "§", "¶", "†", "‡", "Ψ", "Ω", "β", "Σ"]
# Tag words that a model may leak
LEAKED_TAGS = ["BOILERPLATE", "PERSON", "LOCATION", "INFO", "DATE", "EMAIL", "PHONE", "UNKNOWN", "REVISAO", "REVIEW", "CPF", "CNS"]


def quote(literal: str) -> str:
    """A literal as a Java pattern."""
    return re.escape(literal)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Outer white space off, inner runs to one blank."""
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def clean_record(c: Column) -> Column:
    """Line ends to LF, no blanks around them, at most one empty line; null becomes ''."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t]+\n", "\n")
    c = F.regexp_replace(c, r"\n[ \t]+", "\n")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def comparison_key(c: Column) -> Column:
    """Lower case without punctuation, blanks squeezed."""
    return squeeze(F.regexp_replace(F.lower(c), rf"(?U)[^{WORD}\s]", ""))


def subject_key(c: Column) -> Column:
    """Upper case without the word PACIENTE and its dash."""
    return strip(F.regexp_replace(F.upper(c), r"(?U)PACIENTE\s*-\s*", ""))


def ngram_text(c: Column, ini: str, fim: str) -> Column:
    """Lower case; tag spans become a triple delimiter, other punctuation a blank."""
    i, f = quote(ini), quote(fim)
    c = F.regexp_replace(F.lower(c), f"{i}[^\\n]*?{f}", f" {ini * 3} ")
    c = F.regexp_replace(c, f"(?U)[^{WORD}\\s{i}]", " ")
    return squeeze(c)


def to_model_tags(c: Column, ini: str, fim: str) -> Column:
    return F.translate(c, ini + fim, "[]")


def from_model_tags(c: Column, ini: str, fim: str) -> Column:
    return F.translate(c, "[]", ini + fim)


def pretty_tags(c: Column, ini: str, fim: str) -> Column:
    """``INI  A  1 FIM`` to ``[A 1]``."""
    i, f = quote(ini), quote(fim)
    found = F.regexp_extract_all(c, F.lit(f"(?s){i}.*?{f}"), F.lit(0))
    return F.aggregate(found, c, lambda acc, t: F.replace(acc, t, F.concat(F.lit("["), squeeze(F.substring(t, F.lit(len(ini) + 1), F.length(t) - len(ini + fim))), F.lit("]"))))


def slug(c: Column) -> Column:
    """A session name as part of a file name."""
    c = F.regexp_replace(c, r"[\s/\\:_\[\]()]+", "-")
    return F.regexp_replace(F.regexp_replace(c, r"-{2,}", "-"), r"^-+|-+$", "")


def tag_leaked(term: Column, context: Column) -> Column:
    """Whether a term is a system tag (kind and number) that stands in brackets in the context."""
    words = "|".join(LEAKED_TAGS)
    t = strip(term)
    kind = F.regexp_extract(t, rf"(?i)^({words})\s*\d+$", 1)
    number = F.regexp_extract(t, r"(\d+)$", 1)
    inside = F.regexp_replace(F.upper(context), r"(?U)\s+", "")
    gap = F.regexp_extract(t, rf"(?i)^(?:{words})(\s*)\d+$", 1) != ""
    joined = F.contains(inside, F.concat(F.lit("["), F.upper(kind), number, F.lit("]")))
    tight = F.rlike(F.upper(context), F.concat(F.lit(r"\[\s*"), F.upper(kind), number, F.lit(r"\s*\]")))
    return (kind != "") & F.when(gap, joined).otherwise(tight)


def drop_leaked_tags(terms: Column, context: Column) -> Column:
    """An array without its leaked tags and nulls; a null array is empty."""
    return F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: t.isNotNull() & ~F.coalesce(tag_leaked(t, context), F.lit(False)))


def valid_term(c: Column, ini: str, fim: str) -> Column:
    """Two characters or more, not a short number, without tag characters."""
    t = strip(c)
    return F.coalesce((F.length(t) >= 2) & ~(t.rlike(r"^\d+$") & (F.length(t) < 5)) & ~F.contains(t, F.lit(ini)) & ~F.contains(t, F.lit(fim)), F.lit(False))


def artefact_model(name: Column) -> Column:
    """The model part of an artefact's file name."""
    base = F.regexp_replace(name, r"\.json", "")
    parts = F.split(base, "_")
    return F.when(F.size(parts) >= 5, F.array_join(F.slice(parts, 5, 1000), "_")).otherwise(base)


def artefact_mode(name: Column) -> Column:
    parts = F.split(F.regexp_replace(name, r"\.json", ""), "_")
    mode = F.lower(F.try_element_at(parts, F.lit(5)))
    return F.when(mode == "interseccao", "Interseccao").when(mode == "unico", "Unico").otherwise("Uniao")


def artefact_level(name: Column) -> Column:
    parts = F.split(F.regexp_replace(name, r"\.json", ""), "_")
    return F.when(F.size(parts) >= 4, F.size(F.split(F.try_element_at(parts, F.lit(4)), "-s"))).otherwise(1)


def misaligned(original: Column, mask: Column, chars: str) -> Column:
    """Places where the mask is neither the original nor a mask character, up to the shorter text."""
    n = F.least(F.length(original), F.length(mask))
    pair = F.arrays_zip(F.split(F.substring(original, F.lit(1), n), "").alias("a"), F.split(F.substring(mask, F.lit(1), n), "").alias("b"))
    return F.size(F.filter(pair, lambda p: (p["a"] != p["b"]) & ~F.contains(F.lit(chars), p["b"])))


def token_count(c: Column) -> Column:
    """White-space tokens; -1 for null."""
    return F.when(c.isNull(), -1).otherwise(F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")))


def encoded_count(c: Column, make) -> Column:
    """Tokens of each text by an encoder; ``make()`` gives a function text -> tokens, once a batch of rows.

    -1 for null and for a text that the encoder can't take.
    """

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        encode = make()

        def one(t):
            try:
                return -1 if t is None else len(encode(t))
            except Exception:  # noqa: BLE001 - encoders raise errors of their own
                return -1

        return pd.Series([one(t) for t in texts], dtype="int32")

    return count(c)
