"""Encoding of a corpus with a public byte-level tokenizer (problem 8).

The merges run in Spark's higher-order functions, once for each distinct word of the corpus.
A word is its UTF-8 bytes, written as the characters 0-255; ``aggregate`` folds over it: each
step merges the neighbours whose joined piece has the lowest rank, and keeps the ranks of the
neighbouring pairs beside the pieces, so a step looks two pairs up. The ranks are one
literal of the plan: ``BUCKETS`` small maps, the bucket being a hash of the piece.

The distinct words and their counts are the only thing that is shuffled. The ids of the most
frequent words (at most ``frequent``, cut at a count) become a second such literal, and are
looked up inside each record. Words below the cut are joined by the word; the cut bounds how
often any of them occurs, so none is a hot key. Where no word is below it, there is no join.
Decoding looks the pieces up in a literal array and concatenates their bytes.

Null and empty texts have an empty list of ids. Strings that look like control tokens are
ordinary text. The vocabulary file is a parameter; it isn't part of this repository.
Repeated ids and extra columns are kept as they are.
"""

from __future__ import annotations

import base64
import importlib
import json
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velatura.session import stage

BUCKETS = 8192
#: Distinct words whose ids are a literal of the plan, at most.
FREQUENT = 100_000
#: Bytes from which a word's merges are done by pairs instead of by places; the ids are the same.
LONG_WORD = 256
#: The pre-tokenizer of the byte-level vocabularies, in Java's dialect.
WORDS = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The vocabulary file of the installed public tokenizers."""
    return str(importlib.import_module("public_tokenizers").path(name))


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _json(value) -> str:
    """As short as it can be: it stands in the plan."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _bucket_of(piece: Column) -> Column:
    return F.pmod(F.hash(piece), F.lit(BUCKETS))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(piece, rank): each byte of a piece as one character."""
    return spark.createDataFrame([(k.decode("latin-1"), v) for k, v in ranks(path).items()], "piece string, rank int")


@cache
def _rank_literal(path: str, app: str) -> str:
    """JSON of the buckets; the hash is Spark's own."""
    spark = SparkSession.active()
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for r in vocabulary(spark, path).where(F.length("piece") > 1).withColumn("b", _bucket_of(F.col("piece"))).toLocalIterator():
        buckets[r.b][r.piece] = r.rank
    return _json(buckets)


def rank_map(spark: SparkSession, path: str) -> Column:
    """A literal array of maps: piece -> rank."""
    return F.from_json(F.lit(_rank_literal(path, spark.sparkContext.applicationId)), "array<map<string,int>>")


def bytes_of(text: Column) -> Column:
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


_NONE = 2147483647


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a lambda's body has no common subexpressions."""
    return F.element_at(F.transform(F.array(value), use), 1)


def merged(word: Column, table: Column) -> Column:
    """Pieces of a byte word, by ranked merges."""
    rank = lambda a, b: F.coalesce(F.element_at(F.element_at(table, _bucket_of(F.concat(a, b)) + 1), F.concat(a, b)), F.lit(_NONE))
    parts = F.split(word, "")
    n = F.length(word)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: rank(F.substring(word, i, 1), F.substring(word, i + 1, 1)))
    start = F.struct(parts.alias("p"), F.when(n > 1, pairs).otherwise(F.array().cast("array<int>")).alias("r"))

    none = F.array().cast("array<int>")

    def step(acc: Column, _: Column) -> Column:
        p, r = acc["p"], acc["r"]

        def merge(i: Column, new: Column) -> Column:
            size = F.size(p)
            left = F.when(i > 1, F.concat(F.slice(r, 1, i - 2), F.array(rank(F.element_at(p, i - 1), new)))).otherwise(none)
            right = F.when(i + 1 < size, F.concat(F.array(rank(new, F.element_at(p, i + 2))), F.slice(r, i + 2, size))).otherwise(none)
            return F.struct(F.concat(F.slice(p, 1, i - 1), F.array(new), F.slice(p, i + 2, size)).alias("p"), F.concat(left, right).alias("r"))

        at = lambda low: F.array_position(r, low).cast("int")  # the leftmost of the lowest
        return _let(F.array_min(r), lambda low: F.when(low < _NONE, _let(at(low), lambda i: _let(F.concat(F.element_at(p, i), F.element_at(p, i + 1)), lambda new: merge(i, new)))).otherwise(acc))

    return F.aggregate(F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")), start, step)["p"]


def merged_long(word: Column, table: Column) -> Column:
    """The same for a long word: each step merges every place of the lowest pair at once.

    The pieces stand in one text, each between two marks, so a step is one replacement, and
    there are as many steps as different merges instead of as many as bytes. A pair's joined
    piece never ranks below the pair's own merge, so the order of merges is the same.
    """
    a, z = "\u0201", "\u0202"
    rank = lambda x, y: F.coalesce(F.element_at(F.element_at(table, _bucket_of(F.concat(x, y)) + 1), F.concat(x, y)), F.lit(_NONE))
    pieces = lambda t: F.split(F.substring(t, F.lit(2), F.length(t) - 2), z + a)
    whole = F.concat(F.lit(a), F.array_join(F.split(word, ""), z + a), F.lit(z))
    start = F.struct(whole.alias("t"), F.lit(False).alias("done"))

    def step(acc: Column, _: Column) -> Column:
        pairs = _let(pieces(acc["t"]), lambda p: F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p)), lambda x, y: F.struct(rank(x, y).alias("r"), x.alias("x"), y.alias("y"))))

        def merge(low: Column) -> Column:
            found = F.coalesce(low["r"] < _NONE, F.lit(False))
            joined = F.replace(acc["t"], F.concat(F.lit(a), low["x"], F.lit(z + a), low["y"], F.lit(z)), F.concat(F.lit(a), low["x"], low["y"], F.lit(z)))
            return F.struct(F.when(found, joined).otherwise(acc["t"]).alias("t"), (~found).alias("done"))

        return F.when(acc["done"], acc).otherwise(_let(F.array_min(pairs), merge))

    return pieces(F.aggregate(F.sequence(F.lit(1), F.length(word)), start, step)["t"])


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def encoded_words(df: DataFrame, text_col: str, path: str) -> DataFrame:
    """(w, n, ids) of each distinct word and its count in the corpus, as a stage table."""
    spark = df.sparkSession
    vocab = vocabulary(spark, path)
    counts = df.select(F.explode(words(F.col(text_col))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    # a number of partitions of its own: few rows, but many seconds a row
    counts = counts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "w").withColumn("b", bytes_of(F.col("w")))
    known = counts.join(F.broadcast(vocab), F.col("b") == F.col("piece"), "left").select("w", "n", "b", "rank")
    single = F.array(*[F.lit(ranks(path).get(bytes([i]), -1)) for i in range(256)])

    # the ranks are bound once, or each use of them would be a copy in the plan
    def folded(table: Column) -> Column:
        pieces = F.when(F.length("b") <= LONG_WORD, merged(F.col("b"), table)).otherwise(merged_long(F.col("b"), table))
        number = lambda p: F.when(F.length(p) == 1, F.element_at(single, F.ascii(p) + 1)).otherwise(F.element_at(F.element_at(table, _bucket_of(p) + 1), p))
        return F.transform(pieces, number)

    ids = F.when(F.col("rank").isNotNull(), F.array("rank")).otherwise(_let(rank_map(spark, path), folded))
    return stage(known.select("w", "n", ids.alias("ids")), "bpe-words")


def _split(table: DataFrame, value: Column, kind: str, frequent: int) -> tuple[Column, DataFrame | None]:
    """(literal of the frequent words' values, table (w, value) of the others or None)."""
    step = F.floor(F.log2("n") * 16).cast("int")  # at most 16 * 64 steps, whatever the corpus
    total, cut, left = 0, None, 0
    for r in sorted(table.groupBy(step.alias("s")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r.s):
        if left or total + r.k > frequent:
            left += r.k
        else:
            total, cut = total + r.k, r.s
    buckets: list[dict] = [{} for _ in range(BUCKETS)]
    if cut is not None:
        for r in table.where(step >= cut).select("w", value.alias("v"), _bucket_of(F.col("w")).alias("b")).toLocalIterator():
            buckets[r.b][r.w] = r.v
    literal = F.from_json(F.lit(_json(buckets)), f"array<map<string,{kind}>>")
    return literal, table.where(step < (cut if cut is not None else 1 << 30)).select("w", value.alias("v")) if left else None


def _per_word(df: DataFrame, text_col: str, out: str, path: str | None, value: str, kind: str, combine, frequent: int) -> DataFrame:
    """``df`` with a column that combines the values of its words, in order."""
    table = encoded_words(df, text_col, path or default_path())
    literal, rest = _split(table, F.expr(value), kind, frequent)
    ws = F.coalesce(words(F.col(text_col)), F.array().cast("array<string>"))
    found = lambda t, w: F.element_at(F.element_at(t, _bucket_of(w) + 1), w)
    if rest is None:
        return df.withColumn(out, combine(_let(literal, lambda t: F.transform(ws, lambda w: found(t, w)))))
    each = _let(literal, lambda t: F.transform(ws, lambda w, i: F.struct(i.alias("p"), w.alias("w"), found(t, w).alias("v"))))
    rows = stage(df.select(F.struct(*df.columns).alias("row"), F.monotonically_increasing_id().alias("key"), each.alias("ws")), "bpe-rows")
    rare = rows.select("key", F.inline(F.filter("ws", lambda x: x["v"].isNull()))).select("key", "p", "w").join(rest, "w")
    rare = rare.groupBy("key").agg(F.collect_list(F.struct("p", "v")).alias("rare"))
    done = F.transform(F.filter("ws", lambda x: x["v"].isNotNull()), lambda x: F.struct(x["p"].alias("p"), x["v"].alias("v")))
    whole = F.array_sort(F.concat(done, F.coalesce("rare", F.array().cast(f"array<struct<p:int,v:{kind}>>"))))
    return rows.join(rare, "key", "left").select("row.*", combine(F.transform(whole, lambda x: x["v"])).alias(out))


def with_ids(df: DataFrame, text_col: str, out: str = "ids", path: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """``df`` with the ids of each text."""
    return _per_word(df, text_col, out, path, "ids", "array<int>", F.flatten, frequent)


def with_token_counts(df: DataFrame, text_col: str, out: str = "tokens", path: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """``df`` with the number of ids of each text."""
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    return _per_word(df, text_col, out, path, "size(ids)", "int", add, frequent)


def encode(df: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    """(id, ids) of each row of ``df``."""
    return with_ids(df.select(F.col(id_col), F.col(text_col).alias("_text")), "_text", "ids", **how).select(id_col, "ids")


def token_counts(df: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    """(id, tokens): the number of ids of each text, without the ids themselves."""
    return with_token_counts(df.select(F.col(id_col), F.col(text_col).alias("_text")), "_text", "tokens", **how).select(id_col, "tokens")


@cache
def _piece_literal(path: str) -> str:
    table = {v: k.decode("latin-1") for k, v in ranks(path).items()}
    return _json([table.get(i, "") for i in range(max(table) + 1)])


def decode(encoded: DataFrame, id_col: str, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, texto): the text behind the ids; an empty list gives an empty text, null gives null."""
    pieces = F.from_json(F.lit(_piece_literal(path or default_path())), "array<string>")
    whole = _let(pieces, lambda t: F.array_join(F.transform(ids_col, lambda i: F.element_at(t, i + 1)), ""))
    return encoded.select(id_col, F.decode(F.encode(whole, "ISO-8859-1"), "UTF-8").alias("texto"))
