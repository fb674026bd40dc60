"""Sentence units across languages and scripts (problem 10).

A stop is a boundary unless something says otherwise. What a word before a full stop is,
an abbreviation or the end of a sentence, is decided by the document first: a word that
stands elsewhere in it before a stop and a small letter is an abbreviation there, one that
stands elsewhere before a stop and a word that the document also writes small ends sentences,
and a capitalised word that stands elsewhere in small letters begins a sentence. Where the
document is silent, the corpus decides: ``stop_counts`` counts, over all documents, what
follows each word's stops, and words with a clear majority become the fallback lists. What
neither knows falls to two short fixed lists.

The lists of at most ``LISTED`` words are sent to every task; in a corpus with more such words
the most frequent are sent, and the others reach the documents that hold them by a join, so a
document is split alike whatever the size of the corpus.

Script rules: the Devanagari danda, the Arabic and the full-width marks end sentences
without a blank; an ellipsis inside unspaced text is a pause; Thai has no stop, so a blank
between two Thai letters separates statements. Stops inside quotation marks or
parentheses, however long, don't count, unless the closing mark follows at once and the
sentence ends there; an opening mark without a closing one in its line opens nothing. A line
break is a boundary unless the next line goes on in lower case; a blank line always is.

Null and blank texts have no units. Places count code points. A run of more than ``LONGEST``
signs without a blank is no word.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velatura.session import stage

# Titles and street kinds; a name follows, never a new sentence
TITLES = set("dr dra drs sr sra srta prof profa profs enf téc tec mr mrs ms st sto sta d.ª hosp av trav rod al lad pça r eng adv des exmo exma ilmo gen cel mod c mme mlle hr fr herr д د डॉ".split())
# Other abbreviations
SHORTENED = set("aprox approx apr ex ej p pág págs pp art arts fig figs tab cf vs v i.e e.g etc n nº nos no num máx mín max min temp méd med seg resp esq dir prescr diag fl fls lâm lâms obs ref vol cap cx tel ramal cont r.n b.i.d t.i.d q.d kcal/d x/d d sept jan fev feb mar abr apr mai jun jul ago aug set sep out oct nov dez dec séc hab av i.v v.o s.c".split())

_STOP = re.compile(r"[.!?…。！？।॥؟۔｡．]+|[\r\n  \x85\x0b\x0c]+")
# an opening mark isn't read over, so each text is scanned once
_LONE = re.compile(r"(?<![.!?…。！？।॥؟۔｡．])\.[ \t\u00a0]+")
_SPANS = re.compile(r"\"[^\"\n]+\"|“[^“”\n]+”|«[^«»\n]+»|‘[^‘’\n]+’|(?<![^\s(])'[^'\n]{2,}'(?![^\W_])|\([^()\n]+\)|（[^（）\n]+）|「[^「」\n]+」|『[^『』\n]+』")
_SIGN = re.compile(r"@|＠|\[arroba\]|\(at\)|\barroba\b|://|www\.")
_MAIL = re.compile(r" ?(?:@|＠|\[arroba\]|\(at\)|\barroba\b) ?(?:[a-z0-9-]+(?:\.[a-z0-9-]+)*|[A-Z0-9-]+(?:\.[A-Z0-9-]+)*)")
_URL = re.compile(r"(?:https?://|www\.)[!-~]+(?<![.,;])")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_BLANK = " \t\u00a0"
_CLOSE = "\"'”’»)）」』]》*_"
_BULLET = re.compile(r"[ \t ]*(?:[-*•·–—▪◦‣]+[ \t ]|\(?\d{1,3}[.)][ \t ]|\(?[a-zA-Z]\)[ \t ])")
_DOTTED = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]")
_WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")
_THAI_GAP = re.compile(r"(?<=[฀-๿])[  ]+(?=[฀-๿])")
_UNSPACED = re.compile(r"[぀-ヿ㐀-鿿＀-￯฀-๿]")

#: Words of the fallback lists that are sent to every task, at most.
LISTED = 50_000
#: Signs of a word before a stop, at most.
LONGEST = 64


class Known:
    """The corpus's fallback lists."""

    def __init__(self, short: set[str] = frozenset(), final: set[str] = frozenset(), ends: set[str] = frozenset()):
        self.short, self.final, self.ends = short, final, ends

    def plus(self, words: list[tuple[str, int]]) -> Known:
        """With a document's rarer words: (word, kinds), kinds being 1 short + 2 final + 4 ends."""
        return Known(*(have | {w for w, k in words if k & bit} for have, bit in ((self.short, 1), (self.final, 2), (self.ends, 4))))


def _masked(text: str) -> list[tuple[int, int]]:
    """E-mail and network addresses, found at their signs."""
    out: list[tuple[int, int]] = []
    end = 0
    for m in _SIGN.finditer(text):
        at = m.start()
        if m.group() in ("://", "www."):
            s = at if m.group() == "www." else next((at - k for k in (5, 4) if text[at - k : at] == "https"[:k]), -1)
            found = _URL.match(text, s) if s >= end else None
        else:
            e = at - 1 if at and text[at - 1] == " " else at
            s = e
            while s > end and text[s - 1] in _LOCAL:
                s -= 1
            found = _MAIL.match(text, e) if s < e else None
        if found:
            end = found.end()
            out.append((s, end))
    return out


def _covers(spans: list[tuple[int, int]], s: int) -> tuple[int, int] | None:
    """The span of a sorted list without overlaps that holds the place."""
    k = bisect_right(spans, (s, 1 << 60)) - 1
    return spans[k] if k >= 0 and s < spans[k][1] else None


def _stops(text: str) -> list[tuple[int, int, str, int, str]]:
    """(start, end, marks, next character's place, word before a full stop) of the stops and line breaks."""
    n, out = len(text), []
    for m in _STOP.finditer(text):
        s, e = m.span()
        nxt = e
        while nxt < n and text[nxt] in _BLANK:
            nxt += 1
        out.append((s, e, m.group(), nxt, _word_before(text, s) if text[s] == "." else ""))
    return out


def _word_before(text: str, s: int) -> str:
    if s == 0 or text[s - 1].isspace():
        return ""
    part = text[max(0, s - LONGEST) : s].split()[-1]
    whole = len(part) < LONGEST or s == LONGEST
    for c in "([“\"«":
        if c in part:
            part, whole = part[part.rindex(c) + 1 :], True
    return part.casefold() if whole else ""


def _marks(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(quotations and parentheses, addresses) of a text."""
    return [m.span() for m in _SPANS.finditer(text)], _masked(text)


def stop_counts(text: str | None, stops=None, spans=None, addresses=None, lower: set[str] | None = None) -> Counter:
    """(word, kind) of one text's stops by what follows: "a" a small letter or digit, "b" a capital,
    "u" (besides "b") a capitalised word that the text also writes small."""
    found: Counter = Counter()
    if not text or "." not in text:
        return found
    if stops is None:  # only single full stops before a blank can count
        stops = [(m.start(), m.start() + 1, ".", m.end(), _word_before(text, m.start())) for m in _LONE.finditer(text)]
        if not stops:
            return found
        lower = set(_WORD.findall(text))
        spans, addresses = _marks(text)
    for s, e, marks, nxt, w in stops:
        if marks != "." or nxt == e or nxt >= len(text) or _covers(spans, s) or _covers(addresses, s):
            continue
        if w and not w[-1].isdigit():
            c = text[nxt]
            if c.islower() or c.isdigit() or c in ",;":
                found[w, "a"] += 1
            elif c.isupper() and not text[nxt : nxt + 4].isupper():
                found[w, "b"] += 1
                m = _WORD.match(text, nxt)
                if m and m.group().lower() in lower:
                    found[w, "u"] += 1
    return found


def units(text: str | None, known: Known = Known()) -> list[tuple[int, int]]:
    """(start, end) of the sentence units, in order."""
    if not text or not text.strip():
        return []
    n = len(text)
    spans, addresses = _marks(text)
    lower = set(_WORD.findall(text))
    stops = _stops(text)
    here = stop_counts(text, stops, spans, addresses, lower)
    small = _small_style(text, spans, addresses, here, known)
    cuts: list[int] = []
    k = 0
    for s, e, marks, nxt, w in stops:
        if marks[0] in "\r\n\u2028\u2029\x85\x0b\x0c":
            if _line_ends(text, s, e, marks):
                cuts.append(e)
            continue
        held = _covers(addresses, s)
        if held and e <= held[1] - 1:
            continue
        while k < len(spans) and spans[k][1] <= s:
            k += 1
        close = e
        if k < len(spans) and spans[k][0] < s < spans[k][1]:
            if e != spans[k][1] - 1 or not _ends_in_quote(text, spans[k], marks, s):
                continue
            close = spans[k][1]
            nxt = close
            while nxt < n and text[nxt] in _BLANK:
                nxt += 1
        else:
            while close < n and text[close] in _CLOSE and not (close + 1 < n and text[close + 1].isalnum()):
                close += 1
            if close > e:
                nxt = close
                while nxt < n and text[nxt] in _BLANK:
                    nxt += 1
        if _is_end(text, s, e, marks, w, close, nxt, here, lower, known, small):
            cuts.append(close)
    if _UNSPACED.search(text):
        cuts = sorted(set(cuts) | {m.end() for m in _THAI_GAP.finditer(text) if not _covers(spans, m.start())})
    out, at = [], 0
    for c in [*cuts, n]:
        s, e = at, c
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if s < e:
            out.append((s, e))
        at = max(at, c)
    return out


def _line_ends(text: str, s: int, e: int, marks: str) -> bool:
    if marks.count("\n") > 1 or marks.count("\r") > 1 or " " in marks:
        return True
    nxt = e
    while nxt < len(text) and text[nxt] in " \t ":
        nxt += 1
    if nxt >= len(text) or text[nxt] in "\r\n":
        return True
    return bool(_BULLET.match(text, e)) or not text[nxt].islower()


def _ends_in_quote(text: str, span: tuple[int, int], marks: str, s: int) -> bool:
    """Whether the sentence that holds the quotation ends with it."""
    after = span[1]
    nxt = after
    while nxt < len(text) and text[nxt].isspace():
        nxt += 1
    if nxt >= len(text):
        return True
    c = text[nxt]
    if _UNSPACED.match(c) and nxt == after:  # no blank: only a quotation after a colon is complete
        lead = text[: span[0]].rstrip()[-1:]
        return lead in ":：" or text[nxt] in "\r\n"
    if c.islower() or c in ",;:)":
        return False
    if c.isupper() and text[nxt + 1 : nxt + 4].isupper() and text[span[0] : span[1]].isupper():  # capitals throughout tell nothing
        return text[: span[0]].rstrip()[-1:] in (":", ",")
    if text[span[0]] in "(（":
        return c.isupper() or "\n" in text[after:nxt]
    return True


def _is_end(text, s, e, marks, w, close, nxt, here, lower, known, small) -> bool:
    n = len(text)
    if nxt >= n or text[nxt] in "\r\n  ":
        if marks == "." and nxt < n:
            rest = nxt
            while rest < n and text[rest].isspace():
                rest += 1
            if rest < n and text[rest].islower() and "\n\n" not in text[nxt:rest]:
                return not _short(w, here, known)
        return True
    c = text[nxt]
    pause = "…" in marks or (len(marks) > 1 and set(marks) == {"."})
    if pause:
        return not (c.islower() or c in ",;:" or _UNSPACED.match(c) or nxt == close and c.isalnum() and not c.isupper())
    last = marks[-1]
    if last in "。！？।॥؟۔｡．":
        return c not in ",;、，" + _CLOSE
    if c in ",;:" or c == "-" and nxt == close:
        return False
    if last in "!?":
        if c.islower():
            return small and nxt > close
        return nxt > close or not c.isdigit() and c not in "/"
    if not w:
        return False
    line = max(text.rfind("\n", 0, s), text.rfind("\r", 0, s)) + 1
    if w.isdigit() and len(w) <= 3 and not text[line:s].strip()[: -len(w)].strip("-*•( "):
        return False  # the number of a list entry
    if nxt == close:  # no blank after the stop
        if c.isalpha() and not c.islower():
            b = text[s - 1]
            if _UNSPACED.match(c):
                return True
            low = len(w) >= 2 and "." not in w and (b.islower() or b in ")%" or b.isdigit() and not c.isdigit())
            if c.isupper() and (b.isupper() and len(w) >= 3 and w not in TITLES and "." not in w):
                return not _short(w, here, known)
            nxt_two = text[nxt + 1 : nxt + 2]
            return low and w not in TITLES and not _short(w, here, known) and nxt_two not in (".", "")
        return c in "\"“«¿¡•" and b_lower(text, s)
    if c.islower():
        if small:
            return len(w) > 1 and w not in SHORTENED and w not in TITLES and w not in known.short and not _DOTTED.fullmatch(w)
        return w in known.final and len(w) > 2 and not here.get((w, "a"))
    if re.match(r"[ऀ-ॿ]", text[s - 1]):
        return False  # the Devanagari full stop is the danda
    if re.match(r"[؀-ۿ]", text[s - 1]):
        return len(w) > 1
    if w in TITLES and not (len(w) == 1 and w != "r" and not _name_before(text, s)):
        return False
    if len(w) == 1 and w.isalpha():
        return not _name_before(text, s) and not (w in ("r",) and c.isupper())
    if c.isdigit():
        return not _short(w, here, known)
    if _short(w, here, known):
        m = _WORD.match(text, nxt)
        word = m.group() if m else ""
        if text[s - 1].isupper() and word.isupper():
            return False
        if not word:
            return c not in "([\"“«"
        return word[:1].isupper() and (word.lower() in lower or word.lower() in known.final or (w in ("etc", "d", "b.i.d") or w.endswith("/d")) or not _likely_name(text, nxt))
    return True


def _small_style(text, spans, addresses, here, known) -> bool:
    """Whether this text begins its sentences with small letters."""
    up = sum(n for (w, k), n in here.items() if k == "b" and w not in TITLES and w not in SHORTENED and w not in known.short and len(w) > 1)
    down = sum(n for (w, k), n in here.items() if k == "a" and w not in TITLES and w not in SHORTENED and w not in known.short and len(w) > 3)
    return down > up


def b_lower(text: str, s: int) -> bool:
    return s > 0 and text[s - 1].islower()


def _likely_name(text: str, at: int) -> bool:
    """Two capitalised words in a row: more likely a name than the start of a sentence."""
    return bool(re.match(r"[^\W\d_]+ (?:d[aeo]s? )?[A-ZÀ-Þ]", text[at : at + 60]))


def _name_before(text: str, s: int) -> bool:
    """Whether the one-letter word before the stop follows a capitalised word or a title."""
    m = re.search(r"(\S+)\s+\S\Z", text[max(0, s - 40) : s])
    if not m:
        return not text[:s][:-1].strip()
    before = m.group(1)
    return before[0].isupper() and (len(before) > 1 or before == "R") and not before.isupper() or before.rstrip(".").casefold() in TITLES or before.isupper() and len(before) > 2


def _short(w: str, here: Counter, known: Known) -> bool:
    """Whether the word is an abbreviation: the document's evidence, then the corpus's, then the lists."""
    if "." in w and _DOTTED.fullmatch(w):
        return True
    a, b, u = here.get((w, "a"), 0), here.get((w, "b"), 0), here.get((w, "u"), 0)
    if a and not b and w not in known.final:
        return True
    if u > 1 and u == b and not a:  # every capital after it begins a word that is written small elsewhere
        return False
    if w in known.short:
        return True
    return w not in known.ends and (w in SHORTENED or w in TITLES)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for b in batches:
        for t in b.column(0).to_pylist():
            total.update(stop_counts(t))
        if len(total) > 300_000:
            yield _batch(total)
            total = Counter()
    yield _batch(total)


def _batch(total: Counter) -> pa.RecordBatch:
    columns = [pa.array([w for w, _ in total], pa.string()), *[pa.array([n if k == x else 0 for (_, k), n in total.items()], pa.int64()) for x in "abu"]]
    return pa.RecordBatch.from_arrays(columns, names=["w", "a", "b", "u"])


def corpus_words(df: DataFrame, text_col: str, least: int = 5, share: float = 0.75) -> DataFrame:
    """(w, n, kinds) of the words with at least ``least`` stops and a clear majority, as a stage table.

    kinds: 1 an abbreviation, 2 the end of a sentence, 4 the end of a sentence by unambiguous cases.
    """
    counts = df.select(F.col(text_col).alias("text")).where("text IS NOT NULL").mapInArrow(_counted, "w string, a long, b long, u long").groupBy("w").agg(*[F.sum(c).alias(c) for c in "abu"])
    n = F.col("a") + F.col("b")
    bit = lambda c, v: F.when(c, v).otherwise(0)
    ends = (F.col("u") >= least) & (F.col("u") >= share * (F.col("a") + F.col("u"))) & (F.col("u") >= 0.3 * F.col("b"))
    kinds = bit(F.col("a") >= share * n, 1) + bit(F.col("b") >= share * n, 2) + bit(ends, 4)
    return stage(counts.where(n >= least).select("w", n.alias("n"), kinds.alias("kinds")).where("kinds > 0"), "sentence-words")


def _listed(words: DataFrame, listed: int) -> tuple[Known, DataFrame | None]:
    """(the most frequent words, at most ``listed``; the table of the others or None)."""
    step = F.floor(F.log2("n") * 16).cast("int")  # at most 16 * 64 steps, whatever the corpus
    total, cut, left = 0, 1 << 30, 0
    for r in sorted(words.groupBy(step.alias("s")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r.s):
        if left or total + r.k > listed:
            left += r.k
        else:
            total, cut = total + r.k, r.s
    rows = [(r.w, r.kinds) for r in words.where(step >= cut).toLocalIterator()]
    return Known(set(), set(), set()).plus(rows), words.where(step < cut) if left else None


def _asked(text: str | None) -> set[str]:
    """The words whose kinds decide something in a text: those before stops and those after."""
    if not text or "." not in text:
        return set()
    out = set()
    for _, _, marks, nxt, w in _stops(text):
        if marks == ".":
            out.add(w)
            m = _WORD.match(text, nxt)
            if m:
                out.add(m.group().lower())
    return out - {""}


def _asked_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(k, w) for k, t in zip(b["key"], b["text"]) for w in _asked(t)]
        yield pd.DataFrame(rows, columns=["key", "w"])


def sentence_units(df: DataFrame, id_col: str, text_col: str, with_text: bool = False, listed: int = LISTED) -> DataFrame:
    """(id, ordem, inicio, fim[, texto]): the units of every text, in order."""
    known, rest = _listed(corpus_words(df, text_col), listed)
    held = df.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            own = b.column("own").to_pylist() if "own" in b.schema.names else [None] * len(texts)
            rows, numbers, starts, ends, parts = [], [], [], [], []
            for i, (t, o) in enumerate(zip(texts, own)):
                found = units(t, held.value if o is None else held.value.plus([(x["w"], x["kinds"]) for x in o]))
                rows += [i] * len(found)
                numbers += range(len(found))
                starts += [s for s, _ in found]
                ends += [e for _, e in found]
                if with_text:
                    parts += [t[s:e] for s, e in found]
            columns = [b.column("id").take(pa.array(rows, pa.int32())), *[pa.array(x, pa.int32()) for x in (numbers, starts, ends)]]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(parts, pa.string())] * with_text, names=["id", "ordem", "inicio", "fim"] + ["texto"] * with_text)

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    if rest is not None:
        rows = stage(rows.withColumn("key", F.monotonically_increasing_id()), "sentence-texts")
        asked = rows.select("key", "text").mapInPandas(_asked_rows, "key long, w string").join(rest, "w")
        rows = rows.join(asked.groupBy("key").agg(F.collect_list(F.struct("w", "kinds")).alias("own")), "key", "left").drop("key")
    schema = f"id {df.schema[id_col].dataType.simpleString()}, ordem int, inicio int, fim int" + ", texto string" * with_text
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
