"""Exact metric range join of embeddings: pivot cells, boundary replication by the triangle inequality, cells joined independently.

Vectors of cosine >= c are points of the unit sphere at distance <= e = sqrt(2 - 2c).
Every vector is a native of the cell of its nearest pivot p. If y is native to
cell q and |x - y| <= e, then d(x, q) - d(x, p) <= 2e by the triangle inequality;
between points of a Euclidean space the sharper |x - y| >= (d(x, q)^2 - d(x, p)^2)
/ (2 d(p, q)) holds, so x visits exactly the cells q where the right side is <= e.
A native then finds all its partners among the natives and visitors of its cell.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import connected_components, stage

#: Vectors a cell should have on average; pivots at most (beyond, cells are larger and joined in more blocks);
#: candidates per pivot for the farthest-first choice; rows of a block of a cell.
CELL, MAX_PIVOTS, CANDIDATES, BLOCK = 4096, 512, 8, 4096


def slack(width: int) -> float:
    """Pairs this far below the limit in single precision are compared again in double.

    Twice the bound of the rounding errors of a single-precision product of two unit vectors: half a unit in the last
    place (2^-24) for each of the ``width`` products and sums, and for rounding the components of both.
    """
    return (width + 8) * 2.0 ** -23


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(candidates: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first among ``candidates``, from the first; stops when no other direction is left."""
    picked, near = [0], candidates @ candidates[0]
    while len(picked) < min(n, len(candidates)):
        i = int(np.argmin(near))
        if near[i] > 1 - 1e-6:
            break
        picked.append(i)
        near = np.maximum(near, candidates @ candidates[i])
    return candidates[picked]


def places(x: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell, cells visited as a matrix of booleans, home included) of unit vectors."""
    cos = x @ pivots.T
    home = cos.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
    gap = (cos[np.arange(len(x)), home][:, None] - cos) <= (reach + 1e-9) * apart[home]
    gap[np.arange(len(x)), home] = True
    return home, gap


def _matrix(col, dtype, width) -> np.ndarray:
    return np.frombuffer(b"".join(col), dtype).reshape(len(col), width)


def _smallest_labels(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest id reachable over the links a-b (positions in ``ids``): minima spread until nothing changes."""
    label = ids.copy()
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, low[a])
        if (low == label).all():
            return label
        label = low


def _join_blocks(dtype, width, least):
    """Links of one block of natives with one block of their cell: weighted counts per native, and a spanning set of links."""
    def run(pdf):
        import pandas as pd
        nat, tgt = pdf[pdf["native"]], pdf[~pdf["native"]]
        out_id, out_n, edge_a, edge_b = [], [], [], []
        if len(nat) and len(tgt):
            x, y = unit(_matrix(nat["vec"], dtype, width)), unit(_matrix(tgt["vec"], dtype, width))
            xi, yi, weight = nat["id"].to_numpy(), tgt["id"].to_numpy(), tgt["size"].to_numpy()
            x32, y32 = x.astype(np.float32), y.astype(np.float32)
            count = np.zeros(len(x), np.int64)
            ids, place = np.unique(np.concatenate([xi, yi]), return_inverse=True)
            px, py = place[:len(xi)], place[len(xi):]
            label = ids.copy()
            for lo in range(0, len(x), 512):
                near = x32[lo:lo + 512] @ y32.T >= least - slack(width)
                rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                if not len(rows):
                    continue
                hit = (x[lo + rows] @ y[cols].T >= least) & (xi[lo + rows][:, None] != yi[cols][None])
                count[lo + rows] += hit @ weight[cols]
                r, c = np.nonzero(hit)
                if len(r):
                    # The links of this strip join labels; only the labels are carried on.
                    a, b = np.searchsorted(ids, label[px[lo + rows[r]]]), np.searchsorted(ids, label[py[cols[c]]])
                    pair = np.unique(np.stack([a, b], axis=1)[a != b], axis=0)
                    if len(pair):
                        root = _smallest_labels(ids, pair[:, 0], pair[:, 1])
                        label = root[np.searchsorted(ids, label)]
            linked = np.flatnonzero(label != ids)
            edge_a, edge_b = ids[linked], label[linked]
            out_id, out_n = xi[count > 0], count[count > 0]
        return pd.DataFrame({"id": np.concatenate([out_id, edge_a]).astype(np.int64), "n": np.concatenate([out_n, np.zeros(len(edge_a))]).astype(np.int64),
                             "other": np.concatenate([np.full(len(out_id), -1), edge_b]).astype(np.int64),
                             "edge": np.concatenate([np.zeros(len(out_id), bool), np.ones(len(edge_a), bool)])})
    return run


def _links(classes: DataFrame, width: int, dtype: str, least: float, cell: int, max_pivots: int, block: int) -> DataFrame:
    """(id, n, other, edge) rows of ``classes`` (id, size, vec) of one width."""
    spark = classes.sparkSession
    reach = math.sqrt(max(0.0, 2 - 2 * least))
    n = classes.count()
    want = max(1, min(max_pivots, -(-n // cell)))
    # About max_pivots * CANDIDATES vectors reach the driver, picked by a hash of the id; all of a table smaller than that.
    share = want * CANDIDATES / n
    seen = classes.select("id", "vec").where(F.pmod(F.xxhash64("id"), F.lit(1_000_000_000)) < share * 1_000_000_000).collect()
    if not seen:
        seen = classes.select("id", "vec").limit(1).collect()
    pivots = choose_pivots(unit(_matrix([r["vec"] for r in sorted(seen, key=lambda r: r["id"])], dtype, width)), want)
    shared = spark.sparkContext.broadcast(pivots)

    def count(batches):
        natives, all_ = np.zeros(len(pivots), np.int64), np.zeros(len(pivots), np.int64)
        for b in batches:
            if b.num_rows:
                home, seen_in = places(unit(_matrix(b.column(0).to_pylist(), dtype, width)), shared.value, reach)
                natives += np.bincount(home, minlength=len(natives))
                all_ += seen_in.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(natives))), pa.array(natives), pa.array(all_)], names=["cell", "natives", "all"])

    sizes = classes.select("vec").mapInArrow(count, "cell long, natives long, all long").groupBy("cell").sum("natives", "all").collect()
    blocks = np.ones((len(pivots), 2), np.int64)
    for c, natives, all_ in sizes:
        blocks[c] = max(1, -(-natives // block)), max(1, -(-all_ // block))
    shared_blocks = spark.sparkContext.broadcast(blocks)

    def deal(batches):
        blocks = shared_blocks.value
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("id").to_numpy()
            home, seen_in = places(unit(_matrix(b.column("vec").to_pylist(), dtype, width)), shared.value, reach)
            spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            row, cell = np.nonzero(seen_in)
            for native in (True, False):
                r, c = (np.arange(len(ids)), home) if native else (row, cell)
                mine, other = (0, 1) if native else (1, 0)
                times = blocks[c, other]                   # once per block of the other side
                at = np.repeat(np.arange(len(r)), times)
                turn = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                own = spread[r] % blocks[c, mine]
                key = (own[at], turn) if native else (turn, own[at])
                take = pa.array(r[at])
                yield pa.RecordBatch.from_arrays([pa.array(c[at]), pa.array(key[0]), pa.array(key[1]), pa.array(np.full(len(at), native)),
                                                  b.column("id").take(take), b.column("size").take(take), b.column("vec").take(take)],
                                                 names=["cell", "nb", "tb", "native", "id", "size", "vec"])

    dealt = classes.select("id", "size", "vec").mapInArrow(deal, "cell long, nb long, tb long, native boolean, id long, size long, vec binary")
    return dealt.groupBy("cell", "nb", "tb").applyInPandas(_join_blocks(dtype, width, least), "id long, n long, other long, edge boolean")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.9,
                    cell: int = CELL, max_pivots: int = MAX_PIVOTS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row: links are pairs of cosine >= ``least`` in double precision.

    Equal vectors are compared once and counted as often as they occur. Null,
    empty and zero vectors and vectors with null or non-finite parts link with
    nothing and are their own component; so do rows without an id, which get a
    null component and stay. Vectors of unequal length do not link. Rows that
    repeat an id share its vertex. Other columns are not read.
    """
    v = F.col("v")
    x = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    usable = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, x) & F.exists(v, lambda c: c != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")) \
        .select("vec_id", "v", F.coalesce(usable, F.lit(False)).alias("usable"))
    single = vectors.schema[vec_col].dataType.elementType.typeName() == "float"
    dtype = "<f4" if single else "<f8"

    def as_bytes(batches):
        for b in batches:
            vec = [np.asarray(a, dtype).tobytes() for a in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vec, pa.binary())], names=["vec_id", "vec"])

    good = stage(rows.where("usable").select("vec_id", "v").mapInArrow(as_bytes, "vec_id long, vec binary"), "emb-rows")
    keyed = good.withColumn("digest", F.md5("vec"))
    classes = keyed.groupBy("digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"))
    classes = stage(classes, "emb-classes")
    reps = stage(keyed.withColumnRenamed("vec_id", "id").join(classes, ["digest", "id"]).dropDuplicates(["digest", "id"])
                 .select("id", "size", "vec", F.octet_length("vec").alias("bytes")), "emb-reps")
    found = None
    for r in sorted(r["bytes"] for r in reps.select("bytes").distinct().collect()):    # one run per vector length
        part = _links(reps.where(F.col("bytes") == r), r // np.dtype(dtype).itemsize, dtype, least, cell, max_pivots, block)
        found = part if found is None else found.unionAll(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = stage(found, "emb-links")
    comp = connected_components(found.where("edge").select(F.col("id").alias("a"), F.col("other").alias("b")))
    links = found.where("NOT edge").groupBy("id").agg(F.sum("n").alias("n"))
    result = stage(classes.join(links, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left")
                   .select("digest", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "emb-result")
    linked = keyed.select("vec_id", "digest").join(result, "digest").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
