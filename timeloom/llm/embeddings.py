"""Near duplicates among embeddings: tile products of int8 codes with rigorous error bounds.

Every vector is scaled to length one and rounded to int8; the length of what rounding left is kept. The product of the
codes of two vectors then tells their cosine up to a bound made of these lengths. Pairs that the bound puts below the
threshold are done; only the others are computed again in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.session import checkpointed, connected_components, small

#: Vectors of a tile (the side of what one product compares) and about how many a block of vectors has.
TILE = 1024
BLOCK = 4096
#: Room for the rounding of the bounds themselves, far above what double precision can lose.
_SLACK = 1e-9


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, int8 codes (as float32), the scale of the codes, the lengths of what codes stand for, and of the rest."""
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of what is left neither overflow nor vanish altogether
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return x, codes.astype(np.float32), scale, np.linalg.norm(back, axis=1) + 1e-12, np.linalg.norm(x - back, axis=1) + 1e-12


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 codes: in float32 as long as sums stay below 2**24, in runs of dimensions beyond."""
    if a.shape[1] <= 1024:
        return a @ b.T
    return sum((a[:, k : k + 1024] @ b[:, k : k + 1024].T).astype(np.float64) for k in range(0, a.shape[1], 1024))


def linked_pairs(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of a tile with another whose cosine in double precision reaches the threshold."""
    (xa, ca, sa, na, ea), (xb, cb, sb, nb, eb) = a, b
    # |cosine - estimate| <= na * eb + ea * nb + ea * eb, here for the largest values of the other tile
    room = threshold - (na * eb.max() + ea * nb.max() + ea * eb.max()) - _SLACK
    bar = room / sa
    bar -= 1e-6 * (1 + np.abs(bar))  # for the rounding of float32, whatever the sign
    i, j = np.nonzero(_product(ca, cb) * sb[None].astype(np.float32) >= bar[:, None].astype(np.float32))
    sharp = (ca[i] * cb[j]).sum(axis=1, dtype=np.float64) * sa[i] * sb[j] if len(i) < 100_000 else None
    if sharp is not None:
        may = sharp + na[i] * eb[j] + ea[i] * nb[j] + ea[i] * eb[j] >= threshold - _SLACK
        i, j = i[may], j[may]
    good = np.zeros(len(i), bool)
    for k in range(0, len(i), 100_000):
        part = slice(k, k + 100_000)
        good[part] = (xa[i[part]] * xb[j[part]]).sum(axis=1) >= threshold
    return i[good], j[good]


def _compare(threshold: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        low, high = key[0].as_py(), key[1].as_py()
        ids, own = table.column("id").to_numpy(), table.column("block").to_numpy()
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        n = len(ids)
        order = np.argsort(own, kind="stable")
        ids, own, x = ids[order], own[order], x[order]
        cut = int(np.searchsorted(own, low, "right")) if low != high else n
        everything = quantised(x)
        tiles = [(k, min(k + TILE, end)) for begin, end in ((0, cut), (cut, n)) for k in range(begin, end, TILE)]
        parts = [tuple(y[a:b] for y in everything) for a, b in tiles]
        links, root = np.zeros(n, np.int64), np.arange(n)
        for s, (a, b) in enumerate(tiles):
            for t, (c, d) in enumerate(tiles):
                if t < s or low != high and (a < cut) == (c < cut):
                    continue
                i, j = linked_pairs(parts[s], parts[t], threshold)
                if s == t:
                    i, j = i[i < j], j[i < j]
                i, j = i + a, j + c
                links += np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
                _join(root, i, j)
        keep = np.flatnonzero((links > 0) | (root != np.arange(n)))
        return pa.table({"id": pa.array(ids[keep], pa.int64()), "n": pa.array(links[keep], pa.int64()), "root": pa.array(ids[root[keep]], pa.int64())})

    return run


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Make the roots of all linked positions the smallest of their component; roots are flat before and after."""
    while len(i):
        a, b = root[i], root[j]
        differ = a != b
        i, j = i[differ], j[differ]
        if not len(i):
            break
        low, high = np.minimum(a, b)[differ], np.maximum(a, b)[differ]
        np.minimum.at(root, high, low)
        while (flat := root[root]).tolist() != root.tolist():
            root[:] = flat


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per input row: ``vec_id``, ``n_links`` (other vectors with a cosine of at least the threshold),
    ``component_id`` (the smallest id reachable by links) and ``kept`` (whether that is its own).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and vectors of different
    lengths don't link with each other. Rows that repeat an id count as one vector (the first in the order of their
    components). A row without an id links with nothing and is not kept. Further columns are ignored, and an empty
    table gives an empty result.

    Vectors are dealt into blocks by a hash of their id, so that equal vectors spread; each pair of blocks is a task
    of its own that hands over counts and a spanning forest, never the pairs.
    """
    every = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    usable = (
        every.where("id is not null and v is not null and size(v) > 0")
        .where(F.forall("v", finite) & F.exists("v", lambda x: x != 0))
        .groupBy("id")
        .agg(F.min("v").alias("v"))
        .withColumn("width", F.size("v"))
    )
    blocks = checkpointed(usable.groupBy("width").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("many")))
    block = F.pmod(F.xxhash64("id"), F.col("many")).cast("int")
    dealt = (
        usable.join(small(blocks), "width")
        .select("id", "v", "width", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("other"))
        .select("id", "v", "width", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    )
    found = dealt.groupBy("low", "high", "width").applyInArrow(_compare(threshold), "id long, n long, root long")
    found = checkpointed(found)
    counts = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    labels = connected_components(found.where("id <> root"), "id", "root")
    return (
        every.select("id")
        .join(counts, "id", "left")
        .join(labels, F.col("id") == F.col("node"), "left")
        .select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
