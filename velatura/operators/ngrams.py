"""Recurring safe phrases: n-grams counted over distinct subjects."""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velatura.functions.text import ngram_text, squeeze, subject_key
from velatura.session import stage


def corpus(records: DataFrame, subject_col: str, text_col: str, order_col: str, ini: str = "⦃", fim: str = "⦄") -> DataFrame:
    """(subject, rec, frag, tokens): cleaned fragments; null texts and empty subjects are left out.

    ``frag`` is a path: a fragment that is cut again adds the number of the part.
    """
    rows = records.select(subject_key(F.col(subject_col)).alias("subject"), F.col(order_col).alias("rec"), ngram_text(F.col(text_col), ini, fim).alias("t"))
    rows = rows.where("t IS NOT NULL AND subject <> ''").select("subject", "rec", F.posexplode(F.split("t", ini)).alias("frag", "t"))
    return rows.select("subject", "rec", F.array("frag").alias("frag"), F.filter(F.split(squeeze(F.col("t")), " "), lambda w: w != "").alias("tokens")).where(F.size("tokens") > 0)


def grams(tokens: Column, n: int) -> Column:
    """The n-grams of a token array as texts; none if it is too short."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def candidates(fragments: DataFrame, n: int, min_subjects: int = 5) -> DataFrame:
    """(frase, total, pacientes, primeiro): n-grams of at least ``min_subjects`` subjects.

    What is shuffled is a 128-bit hash and the first place of each n-gram, not its text; the
    text of those that are left is read at that place. Counted per (n-gram, subject) first, so the
    final count of distinct subjects needs no second distinct shuffle and a hot phrase is
    spread over its subjects.
    """
    text = F.col("x.frase")
    rows = fragments.select("subject", "rec", "frag", F.inline(F.transform(grams(F.col("tokens"), n), lambda g, i: F.struct(F.struct(i.alias("pos"), g.alias("frase")).alias("x")))))
    rows = rows.select("subject", F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2"), F.struct("rec", "frag", F.col("x.pos").alias("pos")).alias("lugar"))
    per = rows.groupBy("h1", "h2", "subject").agg(F.count("*").alias("k"), F.min("lugar").alias("primeiro"))
    found = per.groupBy("h1", "h2").agg(F.sum("k").alias("total"), F.count("*").alias("pacientes"), F.min("primeiro").alias("primeiro"))
    found = found.where(F.col("pacientes") >= min_subjects).select("total", "pacientes", "primeiro", "primeiro.rec", "primeiro.frag")
    whole = found.join(fragments.select("rec", "frag", "tokens"), ["rec", "frag"])
    return whole.select(F.array_join(F.slice("tokens", F.col("primeiro.pos") + 1, n), " ").alias("frase"), "total", "pacientes", "primeiro")


def ordered(found: DataFrame) -> DataFrame:
    """Most subjects first, then most occurrences, then first seen."""
    return found.orderBy(F.desc("pacientes"), F.desc("total"), "primeiro")


def phrase_pattern(phrase: str) -> str:
    """A phrase whose words may stand apart by anything but word characters."""
    return r"(?Ui)\b" + r"[^\w]+".join(f"\\Q{w}\\E" for w in phrase.split()) + r"\b"


def without_phrases(fragments: DataFrame, phrases: list[str]) -> DataFrame:
    """Fragments cut where one of the phrases stands; longest phrase first."""
    if not phrases:
        return fragments
    any_of = "(?Ui)(?:" + "|".join(r"\b" + r"[^\w]+".join(f"\\Q{w}\\E" for w in p.split()) + r"\b" for p in sorted(set(phrases), key=lambda p: (-len(p), p)) if p.strip()) + ")"
    cut = F.split(F.regexp_replace(F.array_join("tokens", " "), any_of, "\u0001"), "\u0001")
    rows = fragments.select("subject", "rec", "frag", F.posexplode(cut).alias("part", "t"))
    return rows.select("subject", "rec", F.concat("frag", F.array("part")).alias("frag"), F.filter(F.split(squeeze(F.col("t")), " "), lambda w: w != "").alias("tokens")).where(F.size("tokens") > 0)


def largest_viable(fragments: DataFrame, low: int, high: int, min_subjects: int) -> int:
    """The largest n in [low, high] with a candidate, or low - 1: support falls with n."""
    if candidates(fragments, low, min_subjects).isEmpty():
        return low - 1
    good, step = low, 1
    while good + step <= high and not candidates(fragments, good + step, min_subjects).isEmpty():
        good, step = good + step, step * 2
    bad = min(high + 1, good + step)
    while bad - good > 1:
        mid = (good + bad) // 2
        if candidates(fragments, mid, min_subjects).isEmpty():
            bad = mid
        else:
            good = mid
    return good


def mine(fragments: DataFrame, n_max: int = 101, n_min: int = 10, min_subjects: int = 5, verdict: Callable[[list[str]], list[str]] | None = None, page: int = 1000) -> list[tuple[int, str]]:
    """Descend from the longest n: the accepted phrases of a level leave the corpus before the next.

    ``verdict`` gets a level's phrases in order, ``page`` at a time, and returns those that
    are safe (all, by default). A level is decided from one snapshot and left only when all of
    its phrases have been judged.
    """
    learned: list[tuple[int, str]] = []
    for n in range(largest_viable(fragments, n_min, n_max, min_subjects), n_min - 1, -1):
        level = ordered(candidates(fragments, n, min_subjects)).select("frase").toLocalIterator()
        safe: list[str] = []
        while some := [r.frase for r in islice(level, page)]:
            safe += verdict(some) if verdict else some
        learned += [(n, p) for p in safe]
        if safe:
            fragments = stage(without_phrases(fragments, safe), "ngram-corpus")
    return learned
