"""Nearest neighbours by shifted space-filling curves.

Vectors get one more component that makes all norms equal, so the largest inner product is the nearest
point. Several random projections to few dimensions, each scaled to a shifted grid, are put in Hilbert order. Spark
range-sorts each order and counts rows, so every vector has its place on each curve, and places are cut in blocks of
equal size. A query finds its own place the same way and looks into the blocks within a window around it; the windows of all
curves merge, and the union is reranked by exact inner products in double precision.

How many curves, and how wide the windows, is fitted: for a bounded sample of queries the exact neighbours
are found by a scan, and the cheapest setting that finds AIM of them is taken. Where the vectors have no structure that a
curve could follow, no window is cheaper than the whole curve, which is then an exact search in blocks; exact=True asks for
that outright.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraframe.llm._common import prefix_sums, written

K, CURVES, DIMS, BITS = 20, 8, 6, 10
#: Vectors that fit projections and scales; queries that fit the windows; recall they must reach.
FIT_VECTORS, FIT_QUERIES, AIM = 8_192, 64, 0.97
#: Rows of a block: a sixteenth of all within these bounds. Queries that meet a block in one group at most, about.
BLOCK_ROWS, QUERY_ROWS, MAX_SCORES = (64, 2_048), 8_192, 1 << 22


def hilbert(grid: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (rows of grid), each coordinate below 2**bits.

    From the top bit down, each coordinate with a bit set inverts the lower bits of the first, others swap
    them with it; the Gray code of the result is then undone and its bits interleaved.
    """
    x = grid.T.astype(np.uint64).copy()
    n, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        low = (one << np.uint64(b)) - one
        for i in range(n):
            high = (x[i] >> np.uint64(b)) & one == one
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap if i else np.uint64(0)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint64(b)) & one == one, (one << np.uint64(b)) - one, np.uint64(0))
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << one | (x[i] >> np.uint64(b)) & one
    return key.astype(np.int64)


@dataclass
class Index:
    """What tasks need to place a vector: a few small arrays, bounded by CURVES; and the fitted windows, in rows of a curve."""

    dim: int
    norm: float
    n: int
    axes: list[np.ndarray]
    low: list[np.ndarray]
    span: list[np.ndarray]
    curves: int = 1
    width: int = 0
    #: (curves, width, share of true neighbours found, scores a query over all rows) of every setting tried
    tried: list[tuple[int, int, float, float]] = field(default_factory=list)

    def keys(self, curve: int, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        square = (vectors**2).sum(1)
        if query:
            scale = self.norm / np.sqrt(square)
            lifted = np.c_[vectors * scale[:, None], np.zeros(len(vectors))]
        else:
            lifted = np.c_[vectors, np.sqrt(np.maximum(self.norm**2 - square, 0))]
        place = (lifted @ self.axes[curve] - self.low[curve]) / self.span[curve]
        shifted = 0.5 * np.clip(place, 0, 1) + 0.5 * curve / CURVES
        return hilbert(np.minimum((shifted * 2**BITS).astype(np.int64), 2**BITS - 1), BITS)

    @property
    def block_rows(self) -> int:
        return int(np.clip(self.n // 16, *BLOCK_ROWS))

    @property
    def blocks(self) -> int:
        return max(1, -(-self.n // self.block_rows))

    @property
    def whole(self) -> bool:
        return self.width >= self.n


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and v (doubles) of the rows that take part: an id, no null or non-finite component, and not zero."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(~bad).filter(F.exists("v", lambda x: x != 0))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 1))


def best(query: np.ndarray, query_id: int, vectors: np.ndarray, ids: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best ids and their scores. rough only preselects, with a margin, so that equal vectors score and tie alike."""
    pick = np.flatnonzero(rough >= np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1] - 1e-9 * (1 + np.abs(rough).max())) if len(rough) > k + 1 else np.arange(len(rough))
    pick = pick[ids[pick] != query_id]
    score = (vectors[pick] * query).sum(axis=1)
    order = np.lexsort((ids[pick], -score))[:k]
    return ids[pick][order], score[order]


def search_block(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    ids, vectors = rows["id"].to_numpy(), matrix(rows["v"])
    asked, points = queries["id"].to_numpy(), matrix(queries["v"])
    found = []
    if len(ids):
        step = max(1, MAX_SCORES // len(ids))
        for lo in range(0, len(asked), step):
            rough = points[lo : lo + step] @ vectors.T
            found += [best(points[lo + i], asked[lo + i], vectors, ids, rough[i], k) for i in range(len(rough))]
    return pd.DataFrame({"id": asked[: len(found)], "ids": [f[0] for f in found], "scores": [f[1] for f in found]})


HITS = "id long, ids array<long>, scores array<double>"


def merged(hits: DataFrame, k: int) -> DataFrame:
    """id and its k best hits as (minus score, id), nearest first, each id once. Lists are cut to k in two steps, so none grows with the blocks."""
    each = F.transform(F.arrays_zip("scores", "ids"), lambda h: F.struct((-h["scores"]).alias("minus"), h["ids"].alias("vec_id")))
    best = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, k).alias("hits")
    some = hits.select("id", F.pmod(F.hash("ids"), F.lit(64)).alias("_part"), each.alias("hits")).groupBy("id", "_part").agg(best("hits"))
    return some.groupBy("id").agg(best("hits"))


PLACED = "id long, v array<double>, curve int, key long, one long"


def placed(rows: DataFrame, asked: DataFrame, index: Index, curves: int) -> DataFrame:
    """rows (one = 1) and asked (one = 0) on each curve with _place, the number of rows before them there.

    Equal keys go queries first and then by id, so equal vectors are met smallest id first.
    """

    def place(query: bool):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    points = matrix(frame["v"])
                    for c in range(curves):
                        yield frame.assign(curve=c, key=index.keys(c, points, query), one=int(not query))

        return run

    both = rows.mapInPandas(place(False), PLACED).unionByName(asked.mapInPandas(place(True), PLACED))
    return prefix_sums(both, ["curve", "key", "one", "id"], "one", "_before", "curve-order").withColumn("_place", F.col("_before") - F.col("curve") * F.lit(index.n)).drop("_before")


def fit(rows: DataFrame, is_query, k: int = K, seed: int = 3, exact: bool = False) -> Index | None:
    """The index for rows (id, v), fitted on bounded samples by the smallest MD5 of the id; None without rows."""
    by = F.md5(F.col("id").cast("string"))
    sample = rows.orderBy(by, "id").limit(FIT_VECTORS).toPandas()
    if not len(sample):
        return None
    dim = int(sample["v"].map(len).mode().iloc[0])
    same = rows.filter(F.size("v") == dim)
    n, norm = same.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    points = matrix(sample.loc[sample["v"].map(len) == dim, "v"])
    rng = np.random.default_rng(seed)
    axes = [np.linalg.qr(rng.normal(size=(dim + 1, min(DIMS, dim + 1))))[0] for _ in range(CURVES)]
    lifted = np.c_[points, np.sqrt(np.maximum(norm**2 - (points**2).sum(1), 0))]
    places = [lifted @ a for a in axes]
    index = Index(dim, float(norm), int(n), axes, [p.min(0) for p in places], [np.maximum(p.max(0) - p.min(0), 1e-12) for p in places], width=int(n))
    if not exact and index.blocks > 1:
        _fit_windows(index, same, same.filter(is_query).orderBy(by, "id").limit(FIT_QUERIES), k)
    return index


def _fit_windows(index: Index, rows: DataFrame, asked: DataFrame, k: int) -> None:
    """Sets curves and width: the fewest scores a query that find AIM of the true neighbours of the asked."""
    asked = written(asked, "fit-queries")
    few = asked.toPandas()
    if not len(few):
        return

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield search_block(few, frame, k)

    pairs = written(merged(rows.mapInPandas(scan, HITS), k).select("id", F.explode("hits.vec_id").alias("near")), "true-neighbours")
    near = rows.join(F.broadcast(pairs.select(F.col("near").alias("_near")).distinct()), F.col("id") == F.col("_near"), "left_semi")
    # only the bounded sample's neighbours and the sample itself come to the driver with their places
    on_curves = placed(rows, asked, index, CURVES).select("id", "curve", "one", "_place")
    wanted = near.select(F.col("id").alias("_id")).unionByName(asked.select(F.col("id").alias("_id"))).distinct()
    at = on_curves.join(F.broadcast(wanted), F.col("id") == F.col("_id")).select("id", "curve", "one", "_place").toPandas()
    where = {(one, c): dict(zip(g["id"], g["_place"])) for (one, c), g in at.groupby(["one", "curve"])}
    got = pairs.toPandas()
    gaps = [np.array([abs(where[0, c][a] - where[1, c][b]) for a, b in zip(got["id"], got["near"])]) for c in range(CURVES)]
    cheapest = float(index.n)
    for curves in range(1, CURVES + 1):
        nearest = np.sort(np.min(gaps[:curves], axis=0))
        width = int(nearest[min(len(nearest) - 1, int(np.ceil(AIM * len(nearest))) - 1)])
        cost = curves * min(2 * width + index.block_rows, index.n)
        index.tried.append((curves, width, float((nearest <= width).mean()), cost / index.n))
        if cost < cheapest:
            cheapest, index.curves, index.width = cost, curves, width


def search(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", exact: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest rows, by inner product, of every query row.

    is_query is a condition on id. Rows that valid() leaves out, and vectors of another length than most of
    the sample, take no part. Rows that repeat an id and vector count once; ties go to the smaller id; fewer
    than k candidates are all returned; other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = valid(vectors, id_col, vector_col)
    index = fit(rows, is_query, k, exact=exact)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search_index(rows.filter(F.size("v") == index.dim), is_query, index, k)


def search_index(rows: DataFrame, is_query, index: Index, k: int = K) -> DataFrame:
    """search() with an index that is there already; rows has id and v, all of the index's length."""
    on_curves = written(placed(rows, rows.filter(is_query), index, index.curves), "curve-places")
    block, last = index.block_rows, index.blocks - 1
    # a block meets its queries in parts of bounded size; a query is in one part of each block of its windows
    share = min(1.0, (2 * index.width + block) / max(index.n, 1))
    asking = on_curves.filter("one = 0")
    parts = max(1, int(-(-(asking.count() // index.curves) * share // QUERY_ROWS)))
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    at = lambda place: F.least(F.greatest(F.floor(place / block), F.lit(0).cast("long")), F.lit(last).cast("long"))
    windows = F.sequence(at(F.col("_place") - index.width), at(F.col("_place") + index.width))
    asked = asking.select("id", "v", "curve", F.explode(windows).alias("block"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
    fresh = [F.col(c).alias(c) for c in ("id", "v", "curve")]  # new columns: both sides of the cogroup come from one table
    stored = on_curves.filter("one = 1").select(*fresh, at(F.col("_place")).alias("block"), F.explode(every).alias("part"))
    key = ["curve", "block", "part"]
    hits = asked.groupBy(*key).cogroup(stored.groupBy(*key)).applyInPandas(lambda q, r: search_block(q, r, k), HITS)
    ranked = merged(hits, k).select(F.col("id").alias("query_id"), F.posexplode("hits").alias("pos", "hit"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score"))
