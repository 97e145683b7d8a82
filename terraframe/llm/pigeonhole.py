"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with a cosine of c or more are at a squared distance of 2 - 2c or less. They are rotated (random signs
and Walsh-Hadamard transforms, which keep distances) and cut into blocks of a few dimensions; the squared distance is
the sum over blocks, so in at least one block it is within that block's share of the budget. Each block is range-joined:
a tree of median cuts deals vectors to leaves, and a vector also asks in every later leaf that its ball in the block
meets. Pairs within the share are verified there and then by their cosine in double precision; a pair that several blocks
propose belongs to the first of them, so every link is counted once and no pair is ever a row. Equal vectors are one class
from the start. Leaves that hold more than SIDE rows are cut in parts, and each two parts meet in a task of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraframe.llm._common import bitmap, marked, without, written
from terraframe.llm.components import components

COSINE = 0.98
#: Dimensions of a block; rows of either side that meet in a task.
BLOCK_DIMS, SIDE = 8, 2_048
#: Vectors that fit the cuts (the smallest hashes), and how many of them a leaf holds at least.
FIT_VECTORS, FIT_LEAF = 16_384, 16
#: Distances and pairs looked at in one step.
STEP_SCORES, STEP_PAIRS = 1 << 20, 1 << 15
#: What rounding may add to a squared distance of unit vectors.
SLACK = 1e-9
MADE = ("n_links", "component_id", "kept")


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled by the largest component first, so none overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def rotated(units: np.ndarray, seed: int = 11) -> np.ndarray:
    """units turned by two rounds of random signs and a Walsh-Hadamard transform, padded to a power of two.

    Only sums of two and products by signs, element by element, so a vector is turned into the same bits wherever it is met.
    """
    n, d = units.shape
    wide = max(1, 1 << (d - 1).bit_length())
    x = np.zeros((n, wide))
    x[:, :d] = units
    rng = np.random.default_rng(seed)
    for _ in range(2):
        x = x * (2.0 * rng.integers(0, 2, wide) - 1)
        half = 1
        while half < wide:
            pair = x.reshape(n, wide // (2 * half), 2, half)
            x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, wide)
            half *= 2
        x /= np.sqrt(wide)
    return x


def blocks_of(turned: np.ndarray) -> np.ndarray:
    """(n, blocks, dimensions of a block)."""
    width = min(BLOCK_DIMS, turned.shape[1])
    return turned.reshape(len(turned), -1, width)


@dataclass
class Cuts:
    """Median cuts of each block, for vectors of one length: axis and value of node k, whose children are 2k and 2k + 1."""

    dim: int = 0
    depth: int = 0
    axis: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def leaves(self, block: int, points: np.ndarray, depth: int, budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each point's own leaf, and (row, leaf) of every later leaf that its ball meets; leaves are nodes of that depth."""
        own = np.ones(len(points), np.int64)
        row, node, off, far = np.arange(len(points)), own.copy(), np.zeros_like(points), np.zeros(len(points))
        for _ in range(depth):
            axis, cut = self.axis[block], self.value[block]
            own = 2 * own + (points[np.arange(len(points)), axis[own]] >= cut[own])
            a = axis[node]
            gap = points[row, a] - cut[node]
            right = (gap >= 0).astype(np.int64)
            beyond = far - off[np.arange(len(row)), a] ** 2 + gap**2
            also = np.flatnonzero(beyond <= budget)
            moved = off[also]
            moved[np.arange(len(also)), a[also]] = gap[also]
            row, off, far = np.r_[row, row[also]], np.concatenate([off, moved]), np.r_[far, beyond[also]]
            node = np.r_[2 * node + right, 2 * node[also] + 1 - right[also]]
        later = node > own[row]
        return own, row[later], node[later]


def fit(vectors: DataFrame, limit: int = FIT_VECTORS) -> Cuts:
    """Cuts from at most `limit` vectors (v), the smallest by hash; for the length that most of these have."""
    sample = vectors.orderBy(F.xxhash64("v"), F.col("v")).limit(limit).select("v").toPandas()["v"]
    if not len(sample):
        return Cuts()
    dim = int(sample.map(len).mode().iloc[0])
    parts = blocks_of(rotated(unit(np.stack([v for v in sample if len(v) == dim]).astype(np.float64))))
    depth = max(0, (len(parts) // FIT_LEAF).bit_length() - 1)
    cuts = Cuts(dim, depth)
    for b in range(parts.shape[1]):
        axis, value = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        held = {1: parts[:, b]}
        for k in range(1, 1 << depth):
            own = held.pop(k)
            if len(own):
                axis[k] = int((own.max(axis=0) - own.min(axis=0)).argmax())
                value[k] = np.median(own[:, axis[k]])
            right = own[:, axis[k]] >= value[k]
            held[2 * k], held[2 * k + 1] = own[~right], own[right]
        cuts.axis.append(axis)
        cuts.value.append(value)
    return cuts


def _bytes(v: np.ndarray) -> bytes:
    """The components in four bytes each where that loses nothing, else in eight."""
    short = v.astype(np.float32)
    return short.tobytes() if (short == v).all() else v.tobytes()


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(b, np.float32 if len(b) == 4 * dim else np.float64) for b in column]).astype(np.float64)


PLACED = "key long, dim int, block int, leaf long, home boolean, node long, n long, v binary"


def _placed(classes: DataFrame, cuts: Cuts, cosine: float) -> DataFrame:
    """classes (node, key, n, v, depth) in every block: at home in one leaf, and asking in later ones."""
    whole = 2 - 2 * cosine

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (dim, depth), rows in frame.groupby([frame["v"].map(len), "depth"]):
                vectors = np.stack(rows["v"].to_numpy()).astype(np.float64)
                parts = blocks_of(rotated(unit(vectors)))
                share = whole / parts.shape[1] + SLACK
                base = pd.DataFrame({"key": rows["key"].to_numpy(), "dim": np.int32(dim), "node": rows["node"].to_numpy(), "n": rows["n"].to_numpy(), "v": [_bytes(v) for v in vectors]})
                for b in range(parts.shape[1]):
                    own, row, leaf = cuts.leaves(b, parts[:, b], depth if dim == cuts.dim else 0, share + SLACK)
                    for home, at, where in ((True, np.arange(len(own)), own), (False, row, leaf)):
                        yield base.iloc[at].assign(block=np.int32(b), leaf=where, home=home)[["key", "dim", "block", "leaf", "home", "node", "n", "v"]]

    return classes.select("node", "key", "n", "v", "depth").mapInPandas(run, PLACED)


def _pairs(left: np.ndarray, right: np.ndarray, block: int, share: float, triangle: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) whose distance in the block is within the share, and in no block before it; i < j with triangle."""
    width = left.shape[2]
    x, y = left[:, block], right[:, block]
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    for lo in range(0, len(x), step := max(1, STEP_SCORES // max(1, len(y)))):
        rough = xx[lo : lo + step, None] + yy - 2 * (x[lo : lo + step] @ y.T)
        i, j = np.nonzero(rough <= share + SLACK)
        i += lo
        if triangle:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), STEP_PAIRS):
            a, b = i[at : at + STEP_PAIRS], j[at : at + STEP_PAIRS]
            gaps = left[a, : block + 1] - right[b, : block + 1]
            near = np.zeros(gaps.shape[:2])
            for k in range(width):  # in one order, so every task finds the same bits
                near += gaps[:, :, k] ** 2
            first = (near[:, block] <= share) & ~(near[:, :block] <= share).any(axis=1)
            yield a[first], b[first]


def _merge(comp: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets that the links (i, j) connect, sorted by i; comp names each row's set by its first row."""
    ends = np.r_[np.flatnonzero(np.diff(i)) + 1, len(i)]
    for lo, hi in zip(np.r_[0, ends[:-1]], ends):
        sets = np.unique(comp[np.r_[i[lo:hi][:1], j[lo:hi]]])
        if len(sets) > 1:
            comp[np.isin(comp, sets)] = sets[0]


FOUND = "node long, links long, towards long"


def _links(cosine: float):
    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, dim, block, _, one, two = key
        rows = rows.sort_values("node", kind="stable").reset_index(drop=True)
        home, part = rows["home"].to_numpy(), rows["part"].to_numpy()
        first = np.flatnonzero(home & (part == one))
        other = np.flatnonzero(~home | (part != one))
        if not len(first):
            return pd.DataFrame({c: np.empty(0, np.int64) for c in ("node", "links", "towards")})
        vectors = _matrix(rows["v"], dim)
        parts, units, n, node = blocks_of(rotated(unit(vectors))), vectors / np.abs(vectors).max(axis=1, keepdims=True), rows["n"].to_numpy(), rows["node"].to_numpy()
        norm = np.sqrt((units * units).sum(axis=1))
        share = (2 - 2 * cosine) / parts.shape[1] + SLACK
        links, comp = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for there, triangle in ((first, True), (other, False)):
            if (triangle and one != two) or not len(there):
                continue
            for i, j in _pairs(parts[first], parts[there], block, share, triangle):
                a, b = first[i], there[j]
                fine = (units[a] * units[b]).sum(axis=1) / (norm[a] * norm[b]) >= cosine
                a, b = a[fine], b[fine]
                np.add.at(links, a, n[b])
                np.add.at(links, b, n[a])
                _merge(comp, a, b)
        some = np.flatnonzero(links)
        return pd.DataFrame({"node": node[some], "links": links[some], "towards": node[comp[some]]})

    return work


def _met(placed: DataFrame) -> DataFrame:
    """placed in the groups (key, dim, block, leaf, one, two) of bounded size where rows meet: part one at home with itself, with part two or with askers."""
    leaf = ["key", "dim", "block", "leaf"]
    sizes = placed.groupBy(*leaf).agg(F.count_if("home").alias("_homes"), F.count_if(~F.col("home")).alias("_asks")).filter("_homes > 1 OR (_homes > 0 AND _asks > 0)")
    parts = lambda c: F.ceil(F.col(c) / SIDE)
    counted = sizes.select(*leaf, parts("_homes").alias("_h"), parts("_asks").alias("_a"))
    rows = placed.join(counted.hint("merge"), leaf).withColumn("part", F.pmod(F.xxhash64("node"), F.when(F.col("home"), F.col("_h")).otherwise(F.col("_a"))))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    group = lambda a, b: F.struct(a.alias("one"), b.alias("two"))
    alone = (F.col("_h") == 1) & (F.col("_a") <= 1)
    at_home = F.concat(
        F.transform(upto(F.col("_h")), lambda t: group(F.least(F.col("part"), t), F.greatest(F.col("part"), t))),
        F.when(F.col("_a") == 0, F.array().cast("array<struct<one:bigint,two:bigint>>")).otherwise(F.transform(upto(F.greatest(F.col("_a"), F.lit(1))), lambda p: group(F.col("part"), F.col("_h") + p))),
    )
    asking = F.transform(upto(F.col("_h")), lambda s: group(s, F.col("_h") + F.col("part")))
    where = F.when(alone, F.array(group(F.lit(0).cast("long"), F.lit(0).cast("long")))).when(F.col("home"), at_home).otherwise(asking)
    return rows.withColumn("_at", F.explode(where)).select(*leaf, "_at.one", "_at.two", "home", "part", "node", "n", "v")


def near_groups(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", limit: int = FIT_VECTORS) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors; rows of one label are linked at a cosine of `cosine` (over 0) or more.

    A row with a null label, or a vector that is null, empty, zero or holds null or non-finite components, is linked with
    nothing; vectors of different lengths are never linked. Rows that repeat a vector are vectors of their own, whatever
    their ids, and linked to each other. component_id is the smallest id reachable, null ids aside (none where all are
    null); kept tells vec_id = component_id. Other columns are ignored; an empty table gives an empty result.

    Work in a dense group follows its links, as each of them is counted; what is shuffled and held does not.
    """
    v = F.transform(F.col(f"`{vector_col}`").cast("array<double>"), lambda x: x + F.lit(0.0))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("_in", F.col("label").isNotNull() & F.coalesce(~bad, F.lit(False)))
    taking = rows.filter("_in")
    grouped = taking.groupBy("label", "v").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    classes = written(grouped.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    # labels by number, with the depth of cuts that leaves about SIDE rows in a leaf
    cuts = fit(classes, limit)
    halvings = F.least(F.lit(cuts.depth), F.greatest(F.lit(0), F.ceil(F.log2(F.col("_rows") / SIDE))))
    labels = written(classes.groupBy("label").agg(F.count("*").alias("_rows")).select("label", F.monotonically_increasing_id().alias("key"), halvings.cast("int").alias("depth")), "labels")
    placed = written(_placed(classes.join(labels.hint("merge"), "label"), cuts, cosine), "placed-vectors")
    group = ["key", "dim", "block", "leaf", "one", "two"]
    found = written(_met(placed).groupBy(*group).applyInPandas(_links(cosine), FOUND), "found-links")

    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = components(found.filter("node <> towards").select(F.col("node").alias("u"), F.col("towards").alias("v")).distinct())
    told = classes.join(linked.hint("merge"), "node", "left").join(comps.hint("merge"), "node", "left").filter("n > 1 OR links > 0")
    told = written(told.select("label", "v", "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("comp", "node").alias("comp")), "linked-classes")
    lowest = told.groupBy("comp").agg(F.min("low").alias("component_id"))
    results = written(told.join(lowest.hint("merge"), "comp").select(F.col("label").alias("_label"), F.col("v").alias("_v"), "n_links", "component_id"), "link-results")
    # rows whose bit isn't set have no links and stay where they are
    tested = marked(rows, bitmap(results.select(F.col("_label").alias("label"), F.col("_v").alias("v")), "label", "v"), "label", "v")
    alone = tested.filter("NOT (_marked AND _in)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    maybe = tested.filter("_marked AND _in")
    joined = maybe.join(results.hint("merge"), (maybe["label"] == results["_label"]) & (maybe["v"] == results["_v"]), "left")
    own = joined.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return alone.unionByName(own).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def deduplicate(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", **columns: str) -> DataFrame:
    """The rows of vectors whose id is its group's smallest; see near_groups(). Rows that share a kept id all stay."""
    gone = written(near_groups(vectors, cosine, id_col, **columns).filter("NOT kept").select(F.col("vec_id").alias("_gone")).distinct(), "gone")
    ids = F.col(f"`{id_col}`").cast("long")
    return without(vectors.withColumn("_id", ids).join(gone.hint("merge"), F.col("_id").eqNullSafe(F.col("_gone")), "left_anti"), "_id")
