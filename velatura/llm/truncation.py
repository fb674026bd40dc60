"""Texts cut off before their end (problem 3).

``state`` reads the whole text once with a stack automaton. Its stack holds what is open, by
kind: braces and brackets of structures, strings inside them (with their escapes), fences,
markup tags, and in prose quotation marks and parentheses, which a line break ends. A closing
mark pops its own kind only. What is still open at the end, or how the end looks, gives the state:

* ``vazio``: null, blank, or only signs, fences, an empty structure or a placeholder;
* ``estrutura``: a structure, string, fence, tag, quotation or parenthesis is still open, or
  the text ends inside an escape, a tag or a multibyte sequence;
* ``inteiro``: ends with a terminator of some script (also behind closing marks), an
  announcement (colon), or a closed structure;
* ``aberto``: ends without a terminator, with a comma or hyphen, or after an abbreviation.

An ``aberto`` text isn't cut where its source usually ends so: the whole last line, with its
digits folded, ends at least the share ``natural`` of the different texts of that source and
field, ``prior`` more texts that end otherwise being added (so the evidence for a baseline
grows with the texts that show it, and there is no least size). Copies of a text count once, so a
cut answer that is retried or copied doesn't make its own ending natural; only of answers of at
most three words, which are repeated as they are, every row counts. A short list entry (``label:
value``) is no cut either, unless it is the beginning of an entry that ends at least ten times
as many different texts of its table.
"""

from __future__ import annotations

import json
import re
from itertools import islice

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that stand for "no answer"
PLACEHOLDERS = {"null", "none", "nil", "nan", "na", "undefined", "vazio", "vazia", "empty", "json", "string", "tbd", "todo", "semresposta", "placeholder"}
# Abbreviations that never end a sentence
ABBREVIATIONS = {"dr", "dra", "sr", "sra", "srta", "enf", "prof", "profa", "hosp", "av", "trav", "tv", "al", "rod", "pça", "lad", "r", "n", "nº", "pág", "art", "tab", "fig", "mod", "temp", "máx", "mín", "aprox", "cf", "vs", "seg", "méd", "st", "mr", "mrs", "ms", "sto", "sta", "c.p.f", "r.g"}

_TERMINAL = set(".!?…。！？｡．।॥؟۔:：;") - {";"}
_CLOSERS = " \t\r\n\"'”’»›)]}）」』】*_`~>＂"
_MARK = re.compile(r'["\\{}\[\]]')
_OPEN = re.compile(r'[{\[](?=\s*(?:["{}\[\]]|$))')
_FENCE = re.compile(r"^\s*```\w*[ \t]*\n?|\n?```\s*$")
_ENTRY = re.compile(r"^[\s\-*•·–\d.)]*[^\W\d_]+(?: [^\W\d_]+){0,2}: \S+(?: \S+)?$")
_ALNUM = re.compile(r"[^\W_]+")
_TAG = re.compile(r"<(/?)([A-Za-z][\w-]*)(?:\s[^<>]*)?(/?)>")
_CLOSED_TAGS = re.compile(r"(?:\s*</[A-Za-z][\w-]*\s*/?>)+\s*\Z")
_TAG_END = re.compile(r"</?[A-Za-z][^<>\n]{0,40}\Z")
# Tags that are never closed
_VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "col", "area", "base", "source", "embed", "track"}
_PROSE_MARK = re.compile(r'"{3,}|["“”«»「」『』()（）]')
_PAIR = {"”": "“", "»": "«", "」": "「", "』": "『", ")": "(", "）": "（"}
_SMILEY = re.compile(r"(?:^|\s)[:;=]-?\Z")
_ESCAPE_END = re.compile(r"(?<!\\)(?:\\\\)*\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?\Z")
_BROKEN_END = re.compile("[\ufffd\ud800-\udfff]\\Z")


def is_empty(text: str | None) -> bool:
    """No real content; a structure with named keys counts as content."""
    if text is None or not _ALNUM.search(text):
        return True
    words = [m.group().casefold() for m in islice(_ALNUM.finditer(text), 4)]
    return len(words) <= 3 and "".join(words) in PLACEHOLDERS or words == ["json", "null"]


def _structure_end(s: str, start: int) -> int:
    """Place after the structure that opens at ``start``, or -1 if it never closes."""
    stack, i = [], start
    while m := _MARK.search(s, i):
        c, i = s[m.start()], m.end()
        if c == '"':  # inside a string only its end and escapes count
            while True:
                j = s.find('"', i)
                if j < 0:
                    return -1
                k = j
                while k > i and s[k - 1] == "\\":
                    k -= 1
                i = j + 1
                if (j - k) % 2 == 0:
                    break
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and c == stack[-1]:  # another kind of closing mark closes nothing
            stack.pop()
            if not stack:
                return i
    return -1


def _tags_open(s: str) -> bool:
    """A markup tag of the text is still open, or the text ends inside one."""
    if "<" not in s:
        return False
    stack: list[str] = []
    for m in _TAG.finditer(s):
        name = m.group(2).lower()
        if m.group(1):
            if name in stack:  # what was opened inside ends with it
                del stack[len(stack) - 1 - stack[::-1].index(name) :]
        elif not m.group(3) and name not in _VOID:
            stack.append(name)
    return bool(stack) or bool(_TAG_END.search(s))


def _quotes_open(s: str) -> bool:
    """A quotation or parenthesis of the last line is still open."""
    stack: list[str] = []
    for m in _PROSE_MARK.finditer(s, s.rstrip().rfind("\n") + 1):
        c, at = m.group(), m.start()
        if len(c) > 1:
            continue  # a fence of quotes, not a quotation
        if c == '"':
            if '"' in stack:
                del stack[stack.index('"') :]
            elif not (at and s[at - 1].isalnum()):  # 5" or a closing mark alone opens nothing
                stack.append(c)
        elif c in _PAIR:
            if _PAIR[c] in stack:
                del stack[len(stack) - 1 - stack[::-1].index(_PAIR[c]) :]
        elif not (c == "(" and _SMILEY.search(s, max(0, at - 3), at)):
            stack.append(c)
    return bool(stack)


def _tail(s: str) -> tuple[str, str | None]:
    line = s.rstrip().rsplit("\n", 1)[-1]
    key = re.sub(r"\d+", "#", line.strip(" \t\r-*•·–")).casefold()
    return "aberto", "\x01" + key if _ENTRY.match(line.strip()) else xxhash.xxh3_128_hexdigest(key.encode("utf-8", "surrogatepass"))


def _prose(s: str) -> tuple[str, str | None]:
    if s.endswith(">"):
        s = _CLOSED_TAGS.sub("", s)
    core = s.rstrip(_CLOSERS)
    if not core:
        return "inteiro", None
    if _quotes_open(s):
        return "estrutura", None
    last = core[-1]
    if last not in _TERMINAL:
        return _tail(s)
    if last == ".":
        token = re.split(r"[\s(\[\"“«]", core)[-1][:-1]
        if token and (token.casefold() in ABBREVIATIONS or (len(token) == 1 and token.isupper()) or re.fullmatch(r"\d+(?:\.\d+)+", token)):
            return _tail(s)
    return "inteiro", None


def state(text: str | None) -> tuple[str, str | None]:
    """(state, folded last line of an ``aberto`` text)."""
    if is_empty(text):
        return "vazio", None
    s = text.strip()
    if s[0] == "{" and s[-1] == "}":
        try:
            json.loads(s)
            return "inteiro", None
        except ValueError:
            pass
    if s.count("```") % 2 or _BROKEN_END.search(s) or _ESCAPE_END.search(s):
        return "estrutura", None
    if "```" in s:
        s = _FENCE.sub("", s).strip() or s
    at, rest = 0, s
    if "{" in s or "[" in s:
        while m := _OPEN.search(s, at):
            end = _structure_end(s, m.start())
            if end < 0:
                return "estrutura", None
            at = end
        rest = s[at:]
        if at and not rest.strip("` \n\t\r.;"):
            return "inteiro", None
    if _tags_open(s):
        return "estrutura", None
    return _prose(rest)


_STATE = T.StructType([T.StructField("estado", T.StringType()), T.StructField("fim", T.StringType()), T.StructField("marca", T.LongType()), T.StructField("curto", T.BooleanType())])


def mark(text: str | None) -> tuple[int | None, bool]:
    """(a number that copies of a text share, whether it has at most three words)."""
    if text is None:
        return None, True
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63), len(text.split(None, 3)) <= 3


def marks(texts: pd.Series) -> pd.DataFrame:
    got = [mark(t) for t in texts]
    return pd.DataFrame({"marca": pd.array([m for m, _ in got], dtype="Int64"), "curto": [c for _, c in got]})


@F.pandas_udf(_STATE)
def ending(text: pd.Series) -> pd.DataFrame:
    return pd.concat([pd.DataFrame([state(t) for t in text], columns=["estado", "fim"]), marks(text)], axis=1)


def different_texts(states: DataFrame, group: list[str]) -> DataFrame:
    """(group, marca, estado, fim, w): one row per text with content; w is 1, or a short text's rows."""
    rows = states.where("s.estado <> 'vazio'").select(*group, "s.*").groupBy(*group, "marca").agg(F.first("estado").alias("estado"), F.first("fim").alias("fim"), F.first("curto").alias("curto"), F.count("*").alias("w"))
    return rows.withColumn("w", F.when(F.col("curto"), F.col("w")).otherwise(F.lit(1)))


def natural_endings(texts: DataFrame, group: list[str], natural: float, prior: int) -> DataFrame:
    """(group, fim) of the last lines that are no cut: at most 1/natural of them a group."""
    total = texts.groupBy(*group).agg(F.sum("w").alias("n"))
    ends = texts.where("estado = 'aberto'").groupBy(*group, "fim").agg(F.sum("w").alias("k"))
    on = [ends[g].eqNullSafe(total[g]) for g in group]
    return ends.join(total, on).where(F.col("k") >= natural * (F.col("n") + prior)).select(*[ends[g] for g in group], "fim", F.lit(True).alias("natural"))


def begun_entries(texts: DataFrame, group: list[str], times: int = 10) -> DataFrame:
    """(group, fim) of the entries that are the beginning of one with at least ``times`` as many texts."""
    ends = texts.where("estado = 'aberto'").where(F.col("fim").startswith("\x01")).groupBy(*group, "fim").agg(F.count("*").alias("k"))
    places = F.when(F.length("fim") > 2, F.sequence(F.lit(2), F.length("fim") - 1))
    starts = ends.where(F.col("k") >= times).withColumn("n", F.explode(places)).groupBy(*[F.col(g).alias(f"b_{g}") for g in group], F.substring("fim", F.lit(1), F.col("n")).alias("b_fim")).agg(F.max("k").alias("b_k"))
    on = (F.col("fim") == F.col("b_fim")) & _all(F.col(g).eqNullSafe(F.col(f"b_{g}")) for g in group)
    return ends.join(starts, on).where(F.col("b_k") >= times * F.col("k")).select(*group, "fim", F.lit(True).alias("begun"))


def cut(states: DataFrame, group: list[str], natural: float = 0.01, prior: int = 200) -> DataFrame:
    """Adds ``cortado`` to rows with the column ``s`` that ``ending`` gives.

    ``group`` begins with the table, within which entries are compared.
    """
    texts = different_texts(states, group)
    usual = _renamed(natural_endings(texts, group, natural, prior), group, "u")
    begun = _renamed(begun_entries(different_texts(states, group[:1]), group[:1]), group[:1], "v")
    out = states.join(usual, _same(group, "u"), "left").join(begun, _same(group[:1], "v"), "left")
    fits = F.when(F.col("s.fim").startswith("\x01"), F.col("begun").isNull()).otherwise(F.lit(False))
    out = out.withColumn("cortado", (F.col("s.estado") == "estrutura") | ((F.col("s.estado") == "aberto") & F.col("natural").isNull() & ~fits))
    return out.drop("u_fim", "v_fim", "natural", "begun", *[f"u_{g}" for g in group], f"v_{group[0]}")


def _renamed(ends: DataFrame, group: list[str], by: str) -> DataFrame:
    return ends.withColumnsRenamed({c: f"{by}_{c}" for c in [*group, "fim"]})


def _same(group: list[str], by: str) -> Column:
    return (F.col("s.fim") == F.col(f"{by}_fim")) & _all(F.col(g).eqNullSafe(F.col(f"{by}_{g}")) for g in group)


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
