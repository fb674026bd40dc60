"""Mergeable percentiles with a deterministic rank error (problem 2).

A value becomes a leaf of a dyadic tree over 2**32 ordered leaves (the order-
preserving bits of the value as a 32-bit float, a relative rounding of 2**-24). A
digest is a set of (node, count) rows. ``compress`` folds a pair of siblings and
their parent into the parent wherever the three hold at most ``floor(n / k)`` values,
with ``k = ceil(32 / eps)``; every level adds at most that many values of uncertain
place, so any rank is off by at most ``eps * n``. Digests of pieces merge by adding the
counts of equal nodes, and the bound stays ``eps`` times the total.

Each task folds its own rows into digests before anything is shuffled, so a hot group
costs at most ``3k`` nodes a task. The pieces are then added in two steps: a piece carries
a part number, the number of its task modulo ``sqrt(tasks)``; each (group, part) is folded
by itself, and then each group from its folded parts. So no task gets more than about
``3k * sqrt(tasks)`` nodes of a group, and it holds at most ``_FLUSH`` of them at a time.

A digest keeps the columns it was grouped by, so days can be stored as they are and added
later by any of these columns (``merge``), or read at once (``read``).

Nulls and NaN are left out; infinities are kept, as the ends of the order. A null
group is a group of its own. Groups without a value give no row. A percentile that
falls on a folded node is the upper end of that node.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 32
_FLUSH = 400_000
_NODES = "chave string, metrica string, parte int, no long, n long"


def leaf_of(values: np.ndarray) -> np.ndarray:
    """Order-preserving 32-bit code of each value."""
    with np.errstate(over="ignore"):
        bits = (np.asarray(values, dtype=np.float64) + 0.0).astype(np.float32).view(np.uint32).astype(np.int64)
    bits = np.where(bits == 0x80000000, 0, bits)
    return np.where(bits & 0x80000000, 0xFFFFFFFF - bits, bits | 0x80000000)


def value_of(leaf: np.ndarray) -> np.ndarray:
    bits = np.where(leaf & 0x80000000, leaf & 0x7FFFFFFF, 0xFFFFFFFF - leaf).astype(np.uint32)
    return bits.view(np.float32).astype(np.float64)


#: The codes of the infinities: an end of a folded node may lie beyond them.
_ENDS = tuple(leaf_of(np.array([-np.inf, np.inf])).tolist())


def _sum(group: np.ndarray, node: np.ndarray, count: np.ndarray):
    if not len(node):
        return group, node, count
    order = np.lexsort((node, group))
    g, v, c = group[order], node[order], count[order]
    first = np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])]
    return g[first], v[first], np.add.reduceat(c, np.nonzero(first)[0])


def compress(group: np.ndarray, node: np.ndarray, count: np.ndarray, k: int):
    """Fold (group, node, count) rows, many groups at once; groups are small integers."""
    g, v, c = _sum(group, node, count)
    if not len(v):
        return g, v, c
    limit = np.bincount(g, weights=c).astype(np.int64) // k
    if not limit.any():
        return g, v, c
    depth = np.floor(np.log2(v.astype(np.float64))).astype(np.int64)
    done, up = [], (g[:0], v[:0], c[:0])
    for d in range(BITS, 0, -1):
        at = depth == d
        lg, lv, lc = _sum(np.r_[g[at], up[0]], np.r_[v[at], up[1]], np.r_[c[at], up[2]])
        above = depth == d - 1
        pg, pv, pc = _sum(np.r_[lg, g[above]], np.r_[lv >> 1, v[above]], np.r_[lc, c[above]])
        fold = pc <= limit[pg]
        key = {(a, b) for a, b in zip(pg[fold].tolist(), pv[fold].tolist())} if fold.any() else ()
        gone = np.fromiter(((a, b) in key for a, b in zip(lg.tolist(), (lv >> 1).tolist())), dtype=bool, count=len(lg)) if key else np.zeros(len(lg), dtype=bool)
        done.append((lg[~gone], lv[~gone], lc[~gone]))
        up = (lg[gone], lv[gone] >> 1, lc[gone])
    root = depth == 0
    done.append(_sum(np.r_[g[root], up[0]], np.r_[v[root], up[1]], np.r_[c[root], up[2]]))
    return tuple(np.concatenate([x[i] for x in done]) for i in range(3))


def _digests(k: int, metrics: list[str], parts: int):
    """Arrow batches of (group, metrics...) -> digest rows of this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() % parts
        held = [[np.empty(0, np.int64)] * 3 for _ in metrics]
        codes: dict = {}
        names: list = []

        def out():
            for i, m in enumerate(metrics):
                g, v, c = held[i]
                if len(v):
                    yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in g], pa.string()), pa.array([m] * len(v)), pa.array([part] * len(v), pa.int32()), pa.array(v), pa.array(c)], names=["chave", "metrica", "parte", "no", "n"])

        for b in batches:
            enc = b.column(0).dictionary_encode()
            own = enc.dictionary.to_pylist()
            to = np.array([codes.setdefault(x, len(codes)) for x in own], dtype=np.int64)
            names += list(codes)[len(names) :]
            at = to[enc.indices.to_numpy(zero_copy_only=False)]
            for i, _ in enumerate(metrics):
                x = b.column(i + 1).cast(pa.float64()).to_numpy(zero_copy_only=False)
                ok = ~np.isnan(x)
                node = leaf_of(x[ok]) + (1 << BITS)
                h = held[i]
                held[i] = list(_sum(np.r_[h[0], at[ok]], np.r_[h[1], node], np.r_[h[2], np.ones(len(node), np.int64)]))
                if len(held[i][1]) > _FLUSH:
                    held[i] = list(compress(*held[i], k))
            if sum(len(h[1]) for h in held) > 4 * _FLUSH:  # many groups: hand over what there is
                for i in range(len(metrics)):
                    held[i] = list(compress(*held[i], k))
                yield from out()
                held = [[np.empty(0, np.int64)] * 3 for _ in metrics]
                codes, names = {}, []
        for i in range(len(metrics)):
            held[i] = list(compress(*held[i], k))
        yield from out()

    return run


def _key(by: list[str]) -> Column:
    """The group as one text; null columns stay null when it is read again."""
    return F.to_json(F.struct(*by))


def _columns(rows: DataFrame, by: T.StructType) -> DataFrame:
    """The group's own columns in the place of ``chave``."""
    return rows.select(F.from_json("chave", by).alias("c"), "*").select("c.*", *[c for c in rows.columns if c != "chave"])


def _types(df: DataFrame, by: list[str]) -> T.StructType:
    return T.StructType([df.schema[c] for c in by])


def digest(df: DataFrame, by: str | list[str], metrics: list[str], eps: float = 0.005) -> DataFrame:
    """Digest rows (the columns of ``by``, metrica, no, n)."""
    by = [by] if isinstance(by, str) else by
    rows = df.select(_key(by).alias("chave"), *[F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(metrics)])
    tasks = rows._jdf.queryExecution().toRdd().getNumPartitions()
    parts = max(1, isqrt(tasks))
    nodes = rows.mapInArrow(_digests(ceil(BITS / eps), metrics, parts), _NODES)
    return _columns(_added(nodes, parts, eps), _types(df, by))


def _groups(k: int, finish):
    """Sorted digest rows -> ``finish(keys, metrics, group, nodes, counts)`` of whole groups."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []  # pieces of the group that may go on in the next batch
        size, key = 0, None

        def fold():
            v, c = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            return compress(np.zeros(len(v), np.int64), v, c, k)

        for b in batches:
            if not len(b):
                continue
            chave, metrica = b["chave"].to_numpy(), b["metrica"].to_numpy()
            no, n = b["no"].to_numpy(np.int64), b["n"].to_numpy(np.int64)
            starts = np.r_[0, np.nonzero((chave[1:] != chave[:-1]) | (metrica[1:] != metrica[:-1]))[0] + 1]
            first = 0
            if held and key == (chave[0], metrica[0]):
                end = starts[1] if len(starts) > 1 else len(b)
                held.append((no[:end], n[:end]))
                size += end
                if size > max(_FLUSH, 8 * k):  # what is held is a piece of its own: fold it
                    held = [fold()[1:]]
                    size = len(held[0][0])
                if len(starts) == 1:
                    continue
                first = 1
            done = [finish([key[0]], [key[1]], *fold())] if held else []
            low, high = starts[first], starts[-1]
            if low < high:
                at = starts[first:-1]
                group = np.repeat(np.arange(len(at)), np.diff(starts[first:]))
                done.append(finish(chave[at], metrica[at], *compress(group, no[low:high], n[low:high], k)))
            held, size, key = [(no[high:], n[high:])], len(b) - high, (chave[high], metrica[high])
            if done:
                yield pd.concat(done, ignore_index=True)
        if held:
            yield finish([key[0]], [key[1]], *fold())

    return run


def _nodes(keys, metrics, group: np.ndarray, v: np.ndarray, c: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"chave": np.asarray(keys, object)[group], "metrica": np.asarray(metrics, object)[group], "parte": np.zeros(len(v), np.int32), "no": v, "n": c})


def _added(nodes: DataFrame, parts: int, eps: float, finish=_nodes, schema: str = _NODES) -> DataFrame:
    """Fold each (group, part), then each group; ``finish`` makes the rows of a whole group."""
    k = ceil(BITS / eps)
    if parts > 1:
        nodes = nodes.repartition("metrica", "chave", "parte").sortWithinPartitions("parte", "metrica", "chave").mapInPandas(_groups(k, _nodes), _NODES)
    out = nodes.repartition("metrica", "chave").sortWithinPartitions("metrica", "chave").mapInPandas(_groups(k, finish), schema)
    return out.drop("parte")


def _pieces(digests: tuple[DataFrame, ...], by: list[str]) -> tuple[DataFrame, int]:
    """The nodes of digests under the groups of ``by``, in parts."""
    rows = reduce(DataFrame.unionByName, digests)
    parts = max(1, isqrt(rows._jdf.queryExecution().toRdd().getNumPartitions()))
    part = F.pmod(F.spark_partition_id(), F.lit(parts))
    return rows.select(_key(by).alias("chave"), "metrica", part.cast("int").alias("parte"), "no", "n"), parts


def merge(*digests: DataFrame, by: str | list[str], eps: float = 0.005) -> DataFrame:
    """Add the digests of separate pieces (partitions, days) into one of the groups ``by``."""
    by = [by] if isinstance(by, str) else by
    return _columns(_added(*_pieces(digests, by), eps), _types(digests[0], by))


def _read(quantiles: list[float], k: int):
    def rows(keys, metrics, group: np.ndarray, v: np.ndarray, c: np.ndarray) -> pd.DataFrame:
        depth = np.floor(np.log2(v.astype(np.float64))).astype(np.int64)
        high = ((v + 1) << (BITS - depth)) - 1 - (1 << BITS)
        order = np.lexsort((-depth, high, group))
        group, high, c = group[order], high[order], c[order]
        ends = np.searchsorted(group, np.arange(len(keys) + 1))
        ns, found = [], []
        for s, e in zip(ends, ends[1:]):
            upto = np.cumsum(c[s:e])
            ns.append(int(upto[-1]))
            found.append(high[s + np.searchsorted(upto, [max(1, ceil(q * ns[-1] - 1e-9)) for q in quantiles])])
        values = value_of(np.clip(np.array(found), *_ENDS))
        own = {"chave": list(keys), "metrica": list(metrics), "n": ns, "erro_posto": [int(BITS * (n // k)) for n in ns]}
        return pd.DataFrame(own | {f"p{round(q * 1000):04d}": values[:, i] for i, q in enumerate(quantiles)})

    return rows


def read(*digests: DataFrame, by: str | list[str], quantiles: list[float], eps: float = 0.005) -> DataFrame:
    """One row a group of ``by`` and metric: n, the rank error in rows, and pNNNN (per mille) columns.

    The digests may be of any pieces and of finer groups; they are added on the way.
    """
    by = [by] if isinstance(by, str) else by
    cols = ", ".join(f"p{round(q * 1000):04d} double" for q in quantiles)
    out = _added(*_pieces(digests, by), eps, _read(quantiles, ceil(BITS / eps)), f"chave string, metrica string, n long, erro_posto long, {cols}")
    return _columns(out, _types(digests[0], by))
