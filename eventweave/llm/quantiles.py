"""Mergeable percentiles with a deterministic rank error: quantile digests over a bounded universe.

A value is quantized exactly to a signed 64-bit code, in order: an integer is its own code, a decimal its unscaled digits, a float its bit
pattern put in order. Codes are the leaves of two binary trees (negative codes, and the others) of BITS levels. A digest holds counts at
tree nodes and with each node the greatest code counted there; compressing pushes small counts up to their parents, merging adds node by
node. With n rows and k = BITS / eps, a node above the leaves holds floor(n / k) rows at most, in whatever order digests were merged, and
only those on one path to a root can lie on either side of a value: its rank is off by BITS * floor(n / k) <= eps * n rows at most.
Digests of fewer than k rows are exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Levels above the leaves. The node of a code on a level is the code shifted right by it; on level BITS only -1 and 0 are left.
BITS = 63
#: The scale of codes that are ordered bit patterns of floats; other scales are the decimals behind the point.
FLOAT = -1
#: Rows of a digest taken together before they are compressed.
CHUNK = 200_000
_NODE = "scale int, level int, node bigint, top bigint, n bigint"


def float_codes(x: np.ndarray) -> np.ndarray:
    """Signed codes in the order of the floats; both zeros have one."""
    bits = (np.asarray(x, "float64") + 0.0).view("int64")
    return np.where(bits >= 0, bits, np.int64(-(2**63)) - bits)


def code_values(code: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The values of codes: exact but for rounding to the nearest double."""
    bits = np.where(code >= 0, code, np.int64(-(2**63)) - code)
    return np.where(scale == FLOAT, bits.view("float64"), code / 10.0 ** np.maximum(scale, 0))


@F.pandas_udf(T.LongType())
def _float_code(x: pd.Series) -> pd.Series:
    return pd.Series(float_codes(x.to_numpy("float64", na_value=np.nan)))


def code(value: Column, kind: T.DataType) -> tuple[Column, int]:
    """The code of a value of this type and the scale of its codes; null for null and NaN."""
    if isinstance(kind, T.IntegralType):
        return value.cast("bigint"), 0
    if isinstance(kind, T.DecimalType):
        if kind.precision > 18:
            raise ValueError("decimals of more than 18 digits have no 64-bit code; cast them to double first")
        # Up to 2^50 the nearest double gives the digits by rounding; only beyond is decimal arithmetic needed.
        near = value.cast("double") * float(10**kind.scale)
        exact = (value * F.lit(10**kind.scale).cast(T.DecimalType(kind.scale + 1, 0))).cast("bigint")
        return F.when(F.abs(near) < float(2**50), F.rint(near).cast("bigint")).otherwise(exact), kind.scale
    x = value.cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), _float_code(x)), FLOAT


def _sums(start: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    return [np.add.reduceat(c, start) for c in columns]


def compress(group: np.ndarray, level: np.ndarray, node: np.ndarray, top: np.ndarray, n: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pushes counts up the trees for many digests at once: (group, level, node, top, n).

    ``keep`` is each row's floor(n / k). From the leaves up, a node, its sibling and its parent that together hold no more than that
    become the parent. Rows of one node are added. Digests whose keep is 0 only have their rows added.
    """
    group, level, node, top, n, keep = (np.asarray(x, "int64") for x in (group, level, node, top, n, keep))
    order = np.lexsort((node, group, level))
    group, level, node, top, n, keep = (x[order] for x in (group, level, node, top, n, keep))
    if len(group):
        start = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (level[1:] != level[:-1]) | (node[1:] != node[:-1])]))
        top, (n,) = np.maximum.reduceat(top, start), _sums(start, n)
        group, level, node, keep = group[start], level[start], node[start], keep[start]
    still = keep == 0
    done = [(group[still], level[still], node[still], top[still], n[still])]
    group, level, node, top, n, keep = (x[~still] for x in (group, level, node, top, n, keep))
    at = np.searchsorted(level, np.arange(BITS + 2))
    live = [x[at[0] : at[1]] for x in (group, node, top, n, keep)]
    for lv in range(BITS):
        g, v, t, c, k = live
        above = [x[at[lv + 1] : at[lv + 2]] for x in (group, node, top, n, keep)]
        if not len(g):
            live = above
            continue
        up = v >> 1
        # Children and what their parents hold already, by parent.
        ag, av = np.concatenate([g, above[0]]), np.concatenate([up, above[1]])
        ac, ak, at_top = np.concatenate([c, above[3]]), np.concatenate([k, above[4]]), np.concatenate([t, above[2]])
        child = np.arange(len(ag)) < len(g)
        order = np.lexsort((av, ag))
        ag, av, ac, ak, at_top, child = (x[order] for x in (ag, av, ac, ak, at_top, child))
        head = np.concatenate([[True], (ag[1:] != ag[:-1]) | (av[1:] != av[:-1])])
        start = np.flatnonzero(head)
        family = np.cumsum(head) - 1
        fits = (np.add.reduceat(ac, start) <= ak[start])[family]
        goes = fits | ~child
        stays = np.zeros(len(g), bool)
        stays[order[child & ~fits]] = True
        done.append((g[stays], np.full(stays.sum(), lv), v[stays], t[stays], c[stays]))
        ag, av, ac, ak, at_top = (x[goes] for x in (ag, av, ac, ak, at_top))
        if len(ag):
            start = np.flatnonzero(np.concatenate([[True], (ag[1:] != ag[:-1]) | (av[1:] != av[:-1])]))
            live = [ag[start], av[start], np.maximum.reduceat(at_top, start), np.add.reduceat(ac, start), ak[start]]
        else:
            live = [ag, av, at_top, ac, ak]
    done.append((live[0], np.full(len(live[0]), BITS), live[1], live[2], live[3]))
    return tuple(np.concatenate(x) for x in zip(*done))


def _heads(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Marks the first row of each stretch of equal keys; nulls equal each other."""
    head = np.zeros(len(pdf), bool)
    head[:1] = True
    for k in keys:
        v, gone = pdf[k].to_numpy(), pdf[k].isna().to_numpy()
        head[1:] |= (gone[1:] != gone[:-1]) | (~gone[1:] & ~gone[:-1] & np.asarray(v[1:] != v[:-1], bool))
    return head


def _compress_frame(pdf: pd.DataFrame, keys: list[str], k: int) -> pd.DataFrame:
    head = _heads(pdf, keys)
    group = np.cumsum(head) - 1
    n = pdf["n"].to_numpy("int64")
    total = np.zeros(group[-1] + 1, "int64")
    np.add.at(total, group, n)
    if total.max() < k and not pdf.duplicated([*keys, "level", "node"]).any():
        return pdf
    g, lv, v, t, c = compress(group, pdf["level"].to_numpy(), pdf["node"].to_numpy(), pdf["top"].to_numpy(), n, (total // k)[group])
    order = np.argsort(g, kind="stable")
    out = pdf[keys].iloc[np.flatnonzero(head)].reset_index(drop=True).iloc[g[order]].reset_index(drop=True)
    for name, x in (("level", lv), ("node", v), ("top", t), ("n", c)):
        out[name] = x[order]
    return out.astype({"level": "int32"})


def _streams(batches: Iterator[pd.DataFrame], keys: list[str], k: int) -> Iterator[pd.DataFrame]:
    """Compressed digests of whole groups, from batches in which the rows of a group follow each other.

    A group that is longer than CHUNK rows is compressed as it comes, so that a task holds a chunk and a digest at most.
    """
    held: list[pd.DataFrame] = []
    size = 0
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        size += len(pdf)
        if size < CHUNK:
            continue
        whole = pd.concat(held, ignore_index=True)
        last = int(np.flatnonzero(_heads(whole, keys))[-1])
        if last:
            yield _compress_frame(whole.iloc[:last].reset_index(drop=True), keys, k)
        rest = _compress_frame(whole.iloc[last:].reset_index(drop=True), keys, k)
        held, size = [rest], 0
    if held:
        yield _compress_frame(pd.concat(held, ignore_index=True), keys, k)


def budget(eps: float) -> int:
    return math.ceil(BITS / eps)


def _compressed(nodes: DataFrame, keys: list[str], eps: float, then: Callable[[pd.DataFrame], pd.DataFrame] | None = None, made: str = "") -> DataFrame:
    """One digest per key from (keys, scale, level, node, top, n), in which a node may come several times; or what ``then`` makes of them.

    Nodes are added first, hashed by key and node, so that a hot key's rows lie in all partitions. Each partition compresses what it
    has of a key, and only these parts, of 3 * k nodes at most each, come together in one task.
    """
    k = budget(eps)
    by = [*keys, "scale"]
    kinds = dict(nodes.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], _NODE])
    cols = [*by, "level", "node", "top", "n"]
    run = lambda batches: (x[cols] for x in _streams(batches, by, k))
    summed = nodes.groupBy(*by, "level", "node").agg(F.max("top").alias("top"), F.sum("n").alias("n")).select(*cols)
    parts = summed.sortWithinPartitions(*by).mapInPandas(run, schema)
    whole = parts.repartition(*keys).sortWithinPartitions(*by)
    if then is None:
        return whole.mapInPandas(run, schema)
    return whole.mapInPandas(lambda batches: (then(x) for x in _streams(batches, by, k)), made)


def digests(df: DataFrame, keys: list[str], values: list[str], eps: float = 0.01) -> DataFrame:
    """One digest per key and value column, as rows of (keys, field, scale, level, node, top, n).

    Values are integers, decimals of up to 18 digits or floats. Nulls and NaN are left out; a group of nothing else has no digest. Null
    keys are groups like others. Equal values are counted before anything moves. Other columns are ignored, whatever their names.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    coded = [(v, *code(F.col(f"`{v}`"), kinds[v])) for v in values]
    each = F.array(*[F.struct(F.lit(v).alias("field"), F.lit(s).alias("scale"), c.alias("node")) for v, c, s in coded])
    long = df.select(*[F.col(f"`{c}`") for c in keys], F.inline(each)).where("node is not null")
    leaves = long.select(*keys, "field", "scale", F.lit(0).alias("level"), "node", F.col("node").alias("top"), F.lit(1).cast("bigint").alias("n"))
    return _compressed(leaves, [*keys, "field"], eps)


def merge(parts: DataFrame, keys: list[str], eps: float = 0.01) -> DataFrame:
    """Digests of unions: adds the nodes of all digests of the same keys and field. ``keys`` are those to keep."""
    return _compressed(parts.select(*keys, "field", "scale", "level", "node", "top", "n"), [*keys, "field"], eps)


def quantiles(parts: DataFrame, keys: list[str], at: list[float], eps: float = 0.01) -> DataFrame:
    """(keys, field, q, value DOUBLE, n, rank_error) for each key and field and each q in ``at``, of the union of its digests.

    ``parts`` may hold one digest per key or many (of days, say), which are merged on the way. ``value`` is one of the data's own values.
    Of the n rows, want = max(1, ceil(q * n)) or more are no greater than it, and fewer than want + rank_error are less. ``rank_error`` is
    what the merged digest itself leaves open there, BITS * floor(n / k) <= eps * n at most, and 0 where it is exact.
    """
    by, wanted = [*keys, "field", "scale"], np.asarray(at, float)

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        level, node, top, n = (pdf[c].to_numpy("int64") for c in ("level", "node", "top", "n"))
        mask = np.where(level == BITS, np.int64(2**63 - 1), (np.int64(1) << np.minimum(level, 62)) - 1)
        low = node << level
        high = low | mask
        head = np.flatnonzero(_heads(pdf, by))
        values, errors, totals = [], [], []
        for a, z in zip(head, np.append(head[1:], len(pdf))):
            # By the end of a node's span, the shorter span first: what comes before a node lies in it or left of it.
            order = a + np.lexsort((level[a:z], high[a:z]))
            upto = np.cumsum(n[order])
            want = np.maximum(1, np.ceil(wanted * upto[-1] - 1e-9).astype("int64"))
            x = np.maximum.accumulate(top[order])[np.searchsorted(upto, want, "left")]
            inner = a + np.flatnonzero(level[a:z] > 0)
            values.append(x)
            errors.append((((low[inner] < x[:, None]) & (high[inner] >= x[:, None])) * n[inner]).sum(1))
            totals.append(np.full(len(wanted), upto[-1]))
        first = pdf[by].iloc[np.repeat(head, len(wanted))].reset_index(drop=True)
        value = code_values(np.concatenate(values), first["scale"].to_numpy())
        return first[[*keys, "field"]].assign(q=np.tile(wanted, len(head)), value=value, n=np.concatenate(totals), rank_error=np.concatenate(errors).astype("int64"))

    kinds = dict(parts.dtypes)
    made = ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], "field string, q double, value double, n bigint, rank_error bigint"])
    return _compressed(parts.select(*by, "level", "node", "top", "n"), [*keys, "field"], eps, read, made)
