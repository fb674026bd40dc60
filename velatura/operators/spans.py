"""Dictionary spans: one candidate builder, two ways to resolve overlaps, masks.

The alphanumeric runs of a term that stands between word boundaries are whole tokens of the
record. A dictionary of at most ``HELD_TERMS`` terms is sent to every task, keyed by its terms'
first runs; each record is then read once, and nothing is shuffled. A larger one is joined with
the records' tokens on the hashes of the leading runs: places and hashes go through that
join, not texts, and each record's candidates are tested against its text.
Terms without an alphanumeric character find nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velatura.functions.patterns import PATTERNS, matches

#: Tokens and boundaries of masks: any letter or digit.
ALNUM = r"[\p{L}\p{N}]+"
# The literal word class of the tag scan (other letters count as boundaries)
SCAN_CLASS = "[a-zA-Z0-9áéíóúâêôãõçÁÉÍÓÚÂÊÔÃÕÇ]+"

#: Terms that are sent to every task, at most.
HELD_TERMS = 200_000
_SPAN = "struct<ini:int,fim:int,posto:string,alvo:string>"


def _edge_free(text: Column, ini: Column, fim: Column, word: str) -> Column:
    one = word[:-1]  # a single character of the class
    before, after = F.substring(text, ini, F.lit(1)), F.substring(text, fim + 1, F.lit(1))
    return ((ini == 0) | ~before.rlike(f"^{one}$")) & ~after.rlike(f"^{one}$")


def _runs_key(runs: Column, n: Column) -> Column:
    """Hash of the number of leading runs that count (up to three) and the runs."""
    return F.xxhash64(n, F.array_join(F.slice(runs, F.lit(1), n), "|"))


class Dictionary:
    """Terms by their first alphanumeric run, for one scan of a text."""

    def __init__(self, terms: list[str], word: str = ALNUM):
        self.run = re.compile(r"[^\W_]+" if word == ALNUM else word)
        self.one = re.compile(r"[^\W_]" if word == ALNUM else word[:-1])
        self.by: dict[str, list[tuple[str, int, int]]] = {}
        for i, t in enumerate(terms):
            low = t.lower()
            m = self.run.search(low)
            if m:
                self.by.setdefault(m.group(), []).append((low, m.start(), i))

    def spans(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, number of the term) of all bounded occurrences, any letter case."""
        low, by, n = text.lower(), self.by, len(text)
        for m in self.run.finditer(low):
            for term, off, i in by.get(m.group(), ()):
                s = m.start() - off
                if s < 0 or not low.startswith(term, s):
                    continue
                e = s + len(term)
                if not (0 < s <= n and self.one.match(text, s - 1)) and not (e < n and self.one.match(text, e)):
                    yield s, e, i


def held(terms: DataFrame, limit: int = HELD_TERMS) -> list | None:
    """The rows of a table of at most ``limit`` terms, else None."""
    rows = terms.where("termo <> ''").limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def dictionary_spans(records: DataFrame, terms: DataFrame, id_col: str = "rec_idx", text_col: str = "texto", word: str = ALNUM, limit: int = HELD_TERMS) -> DataFrame:
    """(id, ini, fim, + the columns of ``terms``): all bounded occurrences, any letter case.

    ``terms`` has ``termo``; null and empty terms find nothing, repeated terms are found
    once for each row of ``terms``. The table of terms is evaluated once.
    """
    rows = held(terms, limit)
    if rows is None:
        return _joined_spans(records, terms, id_col, text_col, word)
    number = {t: i for i, t in enumerate(dict.fromkeys(r.termo for r in rows))}
    dictionary = records.sparkSession.sparkContext.broadcast(Dictionary(list(number), word))
    key = records.schema[id_col].dataType
    out = T.StructType([T.StructField("_id", key), T.StructField("ini", T.IntegerType()), T.StructField("fim", T.IntegerType()), T.StructField("_n", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(i, s, e, n) for i, t in zip(b["_id"], b["_t"]) for s, e, n in dictionary.value.spans(t)]
            yield pd.DataFrame(found, columns=["_id", "ini", "fim", "_n"])

    spans = records.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).mapInPandas(run, out)
    names = [c for c in terms.columns if c != "termo"]
    schema = T.StructType([T.StructField("_n", T.IntegerType()), T.StructField("termo", T.StringType()), *[terms.schema[c] for c in names]])
    table = records.sparkSession.createDataFrame([(number[r.termo], r.termo, *[r[c] for c in names]) for r in rows], schema)
    return spans.join(F.broadcast(table), "_n").select(F.col("_id").alias(id_col), "ini", "fim", "termo", *names)


def _joined_spans(records: DataFrame, terms: DataFrame, id_col: str, text_col: str, word: str) -> DataFrame:
    """The same by a join on the hashes of up to three leading runs, for a dictionary of any size."""
    extra = [c for c in terms.columns if c != "termo"]
    t = terms.where("termo <> ''").select(*extra, "termo", F.lower("termo").alias("t_low"), F.regexp_extract_all(F.lower("termo"), F.lit(word), F.lit(0)).alias("runs"))
    t = t.where(F.size("runs") > 0).withColumn("h", _runs_key(F.col("runs"), F.least(F.size("runs"), F.lit(3)))).withColumn("off", F.expr("instr(t_low, runs[0]) - 1")).drop("runs")
    text = F.col(text_col)
    key = records.schema[id_col].dataType.simpleString()

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = Dictionary([], word).run
        for b in batches:
            rows = []
            for i, text in zip(b["_id"], b["_low"]):
                found = [(m.start(), m.group()) for m in run.finditer(text)]
                rows += [(i, at, n, "|".join(w for _, w in found[k : k + n])) for k, (at, _) in enumerate(found) for n in range(1, min(3, len(found) - k) + 1)]
            yield pd.DataFrame(rows, columns=["_id", "at", "n", "runs"])

    toks = records.where(text.isNotNull()).select(F.col(id_col).alias("_id"), F.lower(text).alias("_low")).mapInPandas(tokens, f"_id {key}, at int, n int, runs string")
    toks = toks.select("_id", "at", F.xxhash64("n", "runs").alias("h"))
    hit = toks.join(t, "h").select("_id", F.struct((F.col("at") - F.col("off")).alias("ini"), "t_low", "termo", *extra).alias("c")).where("c.ini >= 0")
    per = hit.groupBy("_id").agg(F.collect_list("c").alias("cs"))
    rows = records.where(text.isNotNull()).select(F.col(id_col).alias("_id"), text.alias("_t"), F.lower(text).alias("_low")).join(per, "_id")

    def real(c: Column) -> Column:
        end = c["ini"] + F.length(c["t_low"])
        return (F.substring(F.col("_low"), c["ini"] + 1, F.length(c["t_low"])) == c["t_low"]) & _edge_free(F.col("_t"), c["ini"], end, word)

    found = rows.select("_id", F.explode(F.filter("cs", real)).alias("c"))
    return found.select(F.col("_id").alias(id_col), F.col("c.ini").alias("ini"), (F.col("c.ini") + F.length("c.t_low")).alias("fim"), F.col("c.termo").alias("termo"), *[F.col(f"c.{x}").alias(x) for x in extra])


def accepted_by_rank(spans: list[tuple]) -> list[tuple]:
    """Of (rank, start, end, ...) in order, those that are free when their turn comes, by place."""
    starts: list[int] = []
    kept: list[tuple] = []
    for x in sorted(spans):
        s, e = x[1], x[2]
        k = bisect_left(starts, e)
        if e > s and (k == 0 or kept[k - 1][2] <= s):
            k = bisect_left(starts, s)
            starts.insert(k, s)
            kept.insert(k, x)
    return kept


def rendered(text: str, spans: list[tuple]) -> str:
    """The text with accepted (rank, start, end, char) spans overwritten, in one pass."""
    out, at = [], 0
    for _, s, e, char in spans:
        e = min(e, len(text))
        out += [text[at:s], char * (e - s)]
        at = max(at, e)
    return "".join([*out, text[at:]])


def resolve_leftmost(spans: Column) -> Column:
    """Leftmost start, then longest; array<struct<ini, fim, posto, alvo>>."""
    kind = f"array<{_SPAN}>"
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["ini"].alias("ini"), (-s["fim"]).alias("f"), s["posto"].alias("posto"), s["alvo"].alias("alvo"))))
    back = F.transform(order, lambda s: F.struct(s["ini"].alias("ini"), (-s["f"]).alias("fim"), s["posto"].alias("posto"), s["alvo"].alias("alvo")))
    return F.aggregate(back, F.array().cast(kind), lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["fim"] > s["ini"]), acc).otherwise(F.concat(acc, F.array(s))))


def rebuild(text: Column, accepted: Column) -> Column:
    """The text with each accepted span (in order, none overlapping) replaced by its ``alvo``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    order = F.array_sort(accepted)
    done = F.aggregate(order, start, lambda acc, s: F.struct(s["fim"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["ini"] - acc["at"]), s["alvo"]).alias("out")))
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def span(ini: Column, fim: Column, rank: Column, target: Column) -> Column:
    return F.struct(ini.cast("int").alias("ini"), fim.cast("int").alias("fim"), rank.cast("string").alias("posto"), target.cast("string").alias("alvo"))


def term_end(tipo: Column, termo: Column, ini: Column, fim: Column) -> Column:
    """The end of what a term masks: of an age, "39 anos", the number."""
    age = F.regexp_extract(termo, r"(?i)^(\d+)\s+anos", 1)
    return F.when((tipo == "info") & (age != ""), ini + F.length(age)).otherwise(fim)


def _order_key(group: str, length: Column, tie: Column) -> Column:
    """Text that sorts by (group, longest first, tie)."""
    return F.concat(F.lit(group), F.lpad((F.lit(1_000_000) - length).cast("string"), 7, "0"), tie)


PII_KINDS = ["nome", "endereco", "cpf", "tel", "email", "data"]


def term_rank(tipo: Column, termo: Column, number: Column) -> Column:
    """Where a term's spans stand in the order of masking."""
    size = F.length(termo)
    return F.when(tipo.isin(*PII_KINDS), _order_key("1", size, termo)).when(tipo == "info", _order_key("2", size, F.lpad(F.coalesce(number, F.lit(0)).cast("string"), 9, "0"))).otherwise(_order_key("4", size, termo))


def pattern_terms(text: Column) -> Column:
    """array<string>: the different matches of all patterns, in pattern order."""
    return F.array_distinct(F.flatten(F.array(*[matches(text, p) for p in PATTERNS.values()])))


def pattern_spans(text: str, terms: list[str], char: str) -> list[tuple]:
    """Bounded occurrences of the pattern matches of a text, ranked after known terms (3)."""
    terms = list(terms)
    return [(f"3{i:07d}", s, e, char) for s, e, i in Dictionary(terms).spans(text)] if terms else []


def masked(text: Column, spans: Column, patterns: Column, char: str) -> Column:
    """Equal-length mask of a text from array<struct<posto, ini, fim, alvo>> and its pattern matches."""

    @F.pandas_udf(T.StringType())
    def make(text: pd.Series, spans: pd.Series, patterns: pd.Series) -> pd.Series:
        each = ((t, [(x["posto"], x["ini"], x["fim"], x["alvo"]) for x in xs] + pattern_spans(t, ps, char)) for t, xs, ps in zip(text, spans, patterns))
        return pd.Series([rendered(t, accepted_by_rank(xs)) for t, xs in each], dtype=object)

    return make(text, spans, patterns)


_AGE = re.compile(r"^(\d+)\s+anos", re.I)


def masks(records: DataFrame, knowledge: DataFrame, chars: tuple[str, str], id_col: str = "rec_idx", text_col: str = "texto", limit: int = HELD_TERMS) -> DataFrame:
    """(id, texto, mascara): equal-length masks from knowledge, patterns and unknown terms.

    ``knowledge`` has tipo, texto_original and id_local_sessao. Personal kinds go first,
    longest first; then other terms (of an age, "39 anos", only the number is masked); then the
    patterns; then unknown terms, with the second character. A span that meets an accepted one
    is dropped whole. Null texts keep a null mask. A held dictionary is applied in one pass
    over the records, without a shuffle.
    """
    pii, unknown = chars
    k = knowledge.where(F.col("tipo").isin(*PII_KINDS, "info", "unknown")).groupBy("tipo", F.col("texto_original").alias("termo")).agg(F.min("id_local_sessao").alias("id"))
    k = k.select("tipo", "termo", term_rank(F.col("tipo"), F.col("termo"), F.col("id")).alias("posto"))
    rows = records.select(id_col, F.col(text_col).alias("texto"), pattern_terms(F.col(text_col)).alias("padroes"))
    terms = held(k, limit)
    if terms is None:
        found = _joined_spans(records, k, id_col, text_col, ALNUM)
        per = found.groupBy(id_col).agg(F.collect_list(F.struct("posto", "ini", "fim", "tipo", "termo")).alias("achados"))
        rows = rows.join(per, id_col, "left")
        terms = []
    dictionary = records.sparkSession.sparkContext.broadcast((Dictionary([r.termo for r in terms]), [(r.posto, r.tipo, r.termo) for r in terms]))

    def one(text: str | None, patterns, more) -> str | None:
        if text is None:
            return None
        words, about = dictionary.value
        found = [(about[i][0], s, e, *about[i][1:]) for s, e, i in words.spans(text)]
        found += [(x["posto"], x["ini"], x["fim"], x["tipo"], x["termo"]) for x in more]
        spans = []
        for rank, s, e, kind, term in found:
            age = _AGE.match(term) if kind == "info" else None
            spans.append((rank, s, s + len(age.group(1)) if age else e, unknown if kind == "unknown" else pii))
        return rendered(text, accepted_by_rank(spans + pattern_spans(text, patterns, pii)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            more = [() if x is None else x for x in b["achados"]] if "achados" in b else [()] * len(b)
            yield pd.DataFrame({id_col: b[id_col], "texto": b["texto"], "mascara": [one(t, () if p is None else p, m) for t, p, m in zip(b["texto"], b["padroes"], more)]})

    key = records.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(run, f"`{id_col}` {key}, texto string, mascara string")
