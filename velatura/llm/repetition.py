"""Repetition inside a single document (problem 6).

``measure`` reads each text once and gives plain figures: the share of its phrases of four
words that occurred before in it, the characters in repeated lines and sentences, the share of
distinct words, and the longest run of the same few signs or word, all apart from letter
case, numbering and spacing.

``learn`` grows ordered rules over these figures by sequential covering: each rule adds
the threshold that gains most, is pruned on held-out rows, and takes the rows it covers
out; the list ends when a rule no longer pays. ``as_column`` turns the list into one Spark
conditional, which decides. The labelled rows are made from a bounded sample of the corpus's
own texts (``SAMPLE`` texts, lowest hash first), with repetitions of known share put in.

The exact share (``coberto``: characters in passages that occurred before) isn't among the
figures. It is measured in the same reading, and takes out accepted texts under the limit.

Nulls and texts without a character have no figures and are no case. A corpus without a text
to learn from (of 80 characters, without much repetition) gets one rule a figure.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 400
PHRASE = 4
FEATURES = ["frases", "linhas", "sentencas", "distintas", "corrida"]
_TOKEN = re.compile(r"[^\W_]+(?:[.,:/][^\W_]+)*")
_NUMBERING = re.compile(r"(?m)^[ \t]*(?:[-*•·–]+[ \t]*)?(?:[^\W\d_]+[ \t]+)?\(?\d+[ \t]*[).:ªº-]+[ \t]+|^[ \t]*[-*•·–]+[ \t]+")
_SENTENCE = re.compile(r"[^.!?…\n]+[.!?…]*")
_RUN = re.compile(r"(.{1,8}?)\1{5,}", re.S)
_SPACE = re.compile(r"[\W_]+")


def measure(text: str | None) -> list[float] | None:
    """The figures named in FEATURES, and last the exact share."""
    if not text or not text.strip():
        return None
    n = len(text)
    low = text.lower()
    if len(low) != n:  # a few letters change length in lower case
        low = text
    marks = bytearray(n)
    skip = [m.span() for m in _NUMBERING.finditer(low)] if "\n" in low or low[:40].find(")") >= 0 or low[:40].find(":") >= 0 else []
    words, starts, ends = [], [], []
    k, gap_from, runs = 0, 0, 0
    for m in _TOKEN.finditer(low):
        s, e = m.span()
        while k < len(skip) and skip[k][1] <= s:
            k += 1
        if s - gap_from > 24 or e - s > 40:
            runs = max(runs, _mark_runs(low, gap_from if s - gap_from > 24 else s, e, marks))
        gap_from = e
        if k < len(skip) and skip[k][0] <= s < skip[k][1]:
            continue
        words.append(m.group())
        starts.append(s)
        ends.append(e)
    if n - gap_from > 24:
        runs = max(runs, _mark_runs(low, gap_from, n, marks))
    repeated, seen = 0, set()
    for i, g in enumerate(zip(words, words[1:], words[2:], words[3:])):
        if g in seen:
            repeated += 1
            s, e = starts[i], ends[i + 3]
            marks[s:e] = b"\1" * (e - s)
        else:
            seen.add(g)
    lines = _repeated(low, ((s, e) for s, e in _spans(low)), marks) if "\n" in low else 0
    sentences = _repeated(low, (m.span() for m in _SENTENCE.finditer(low)), marks)
    return [repeated / max(1, len(words) - PHRASE + 1), lines / n, sentences / n, len(set(words)) / max(1, len(words)), runs / n, sum(marks) / n]


def _spans(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for line in text.split("\n"):
        yield at, at + len(line)
        at += len(line) + 1


def _repeated(text: str, spans, marks: bytearray) -> int:
    seen, total = set(), 0
    for s, e in spans:
        m = _NUMBERING.match(text, s)
        if m and m.end() < e:
            s = m.end()
        key = _SPACE.sub(" ", text[s:e]).strip()
        if len(key) < 3 or key.isdigit():
            continue
        if key in seen:
            marks[s:e] = b"\1" * (e - s)
            total += e - s
        else:
            seen.add(key)
    return total


def _mark_runs(text: str, start: int, end: int, marks: bytearray) -> int:
    longest = 0
    for m in _RUN.finditer(text, start, end):
        s, e = m.span()
        if e - s >= 20 and m.group().strip():
            s += len(m.group(1))
            marks[s:e] = b"\1" * (e - s)
            longest = max(longest, e - s)
    return longest


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [(i, src, *x) for i, src, t in zip(b["id"], b["src"], b["text"]) if (x := measure(t)) is not None]
        yield pd.DataFrame(got, columns=["id", "src", *FEATURES, "coberto"])


def statistics(df: DataFrame) -> DataFrame:
    """The figures and the exact share of each row of (src, id, text)."""
    return df.select("id", "src", "text").where("text IS NOT NULL").mapInPandas(_measured, "id long, src string, " + ", ".join(f"{f} double" for f in [*FEATURES, "coberto"]))


def labelled(texts: list[str], limit: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Figures and labels of texts with repetitions of known share put in."""
    rng = random.Random(seed)
    xs, ys = [], []
    for t in texts:
        base = measure(t)
        if base is None or len(t) < 80 or base[-1] > 0.2:
            continue
        parts = [p for p in re.split(r"(?<=[.!?…])\s+|\n+", t) if len(p.split()) >= 5]
        xs.append(base)
        ys.append(0)
        for share in (0.15, 0.25, 0.32, 0.45, 0.55, 0.75):
            unit = rng.choice(parts) if parts else t
            kind = rng.randrange(4)
            if kind == 0:
                unit = " ".join(unit.split()[: rng.randint(4, 6)])
            elif kind == 1:
                unit = rng.choice(["sim", "ok", "A", "-", "aguarde"])
            more = share * len(t) / (1 - share)
            sep = rng.choice([" ", "\n", "\n- "]) if kind else " "
            copies = max(1, round(more / (len(unit) + len(sep))))
            body = t + sep + sep.join([unit] * (copies + (kind < 2)))
            x = measure(body)
            xs.append(x)
            ys.append(int(copies * (len(unit) + len(sep)) / len(body) >= limit))
    return np.array(xs, dtype=float).reshape(len(xs), len(FEATURES) + 1)[:, : len(FEATURES)], np.array(ys)


def learn(x: np.ndarray, y: np.ndarray, max_rules: int = 10, seed: int = 7) -> list[list[tuple[int, bool, float]]]:
    """Ordered rules for label 1; a condition is (feature, at_least, threshold)."""
    rng = np.random.default_rng(seed)
    left = np.ones(len(y), dtype=bool)
    rules: list[list[tuple[int, bool, float]]] = []
    while len(rules) < max_rules and y[left].any():
        at = rng.permutation(np.nonzero(left)[0])
        grow, hold = at[: len(at) * 2 // 3], at[len(at) * 2 // 3 :]
        rule: list[tuple[int, bool, float]] = []
        inside = grow
        while len(rule) < 3 and (y[inside] == 0).any():
            best = max((c for f in range(x.shape[1]) for c in _thresholds(x, y, inside, f)), default=None)
            if best is None or best[0] <= 1e-9:
                break
            rule.append(best[1])
            inside = inside[_holds(x[inside], [best[1]])]
        while len(rule) > 1 and _worth(x, y, hold, rule[:-1]) >= _worth(x, y, hold, rule):
            rule.pop()
        if not rule or _worth(x, y, hold, rule) < 0.5:
            break
        covered = left & _holds(x, rule)
        if not y[covered].any():
            break
        rules.append(rule)
        left &= ~covered
    return rules


def _thresholds(x, y, at, f):
    pos, n = y[at].sum(), len(at)
    if not pos:
        return
    for v in np.unique(np.quantile(x[at, f], np.linspace(0, 1, 65))):
        for up in (True, False):
            m = x[at, f] >= v if up else x[at, f] <= v
            p, k = y[at][m].sum(), m.sum()
            if p and k < n:
                yield p * (np.log2(p / k) - np.log2(pos / n)), (f, up, float(v))


def _holds(x, rule):
    m = np.ones(len(x), dtype=bool)
    for f, up, v in rule:
        m &= x[:, f] >= v if up else x[:, f] <= v
    return m


def _worth(x, y, at, rule) -> float:
    m = _holds(x[at], rule)
    return (y[at][m].sum() + 1) / (m.sum() + 2)


def as_column(rules: list[list[tuple[int, bool, float]]]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        cond = F.lit(True)
        for f, up, v in rule:
            cond = cond & (F.col(FEATURES[f]) >= v if up else F.col(FEATURES[f]) <= v)
        out = F.when(cond, i) if out is None else out.when(cond, i)
    return F.lit(0) if out is None else out.otherwise(0)


def learned(df: DataFrame, limit: float = 0.4, sample: int = SAMPLE, slack: float = 0.05) -> list[list[tuple[int, bool, float]]]:
    """The decision list for (src, id, text), learned for a limit lower by ``slack``."""
    # the lowest hashes first, as numbers alone, then the few texts behind them
    hashed = df.where("length(text) >= 80").select(F.xxhash64("text").alias("h"), "text")
    lowest = [r.h for r in hashed.select("h").orderBy("h").limit(sample).collect()]
    picked = hashed.where(F.col("h") <= lowest[-1]).dropDuplicates(["h"]).orderBy("h").collect() if lowest else []
    x, y = labelled([r.text for r in picked], limit - slack)
    return (learn(x, y) if len(y) else []) or [[(FEATURES.index(f), True, limit / 2)] for f in ("frases", "linhas", "sentencas", "corrida")]


def repetitive(df: DataFrame, limit: float = 0.4, **how) -> DataFrame:
    """Figures, the exact share, the rule that fired and ``repetitivo`` for each row of (src, id, text)."""
    out = statistics(df).withColumn("regra", as_column(learned(df, limit, **how)))
    return out.withColumn("repetitivo", (F.col("regra") > 0) & (F.col("coberto") >= limit))
