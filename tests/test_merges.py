"""Draws, batches, boxes and fills against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraframe.functions.grids import FAR, nearest_columns
from terraframe.operators import catalog, raster, sample


@pytest.mark.parametrize("seed", range(4))
def test_draws_match_running_shares(spark, seed):
    rng = random.Random(seed)
    weights = [rng.choice([0, 1, 2, 0.25, 1000]) for _ in range(300)] if seed else [1e-12, 1e12, 1e-12, 3.0, 0.0, 5e11]
    us = [rng.random() for _ in range(500)] + [0.0, 1 - 2**-53] + [sum(weights[:k]) / sum(weights) for k in range(0, len(weights), 7)]
    items = spark.createDataFrame([(k, float(w)) for k, w in enumerate(weights)], "item long, w double").repartition(5)
    us = [u for u in us if u < 1]
    draws = spark.createDataFrame([(k, float(u)) for k, u in enumerate(us)], "draw long, u double").repartition(3)
    got = {r["draw"]: r["item"] for r in sample.weighted_draws(items, "w", draws).collect()}
    assert sorted(got) == list(range(len(us)))  # every draw once
    ends = np.cumsum(weights) / np.sum(weights)
    for k, u in enumerate(us):
        assert weights[got[k]] > 0
        assert ends[got[k]] - weights[got[k]] / np.sum(weights) <= u + 1e-12 and u <= ends[got[k]] + 1e-12
    even = sample.weighted_draws(items.withColumn("w", F.lit(None).cast("double")), "w", draws)
    assert {r["draw"]: r["item"] for r in even.collect()} == {k: min(int(u * len(weights) + 1e-9), len(weights) - 1) for k, u in enumerate(us)}


def greedy(sizes, limit):
    out, used, batch = [], 0, -1
    for s in sizes:
        if batch < 0 or used + s > limit:
            batch, used = batch + 1, 0
        used += s
        out.append(batch)
    return out


@pytest.mark.parametrize("limit", [1, 10, 1000])
def test_batches_match_the_greedy_rule(spark, limit):
    rng = random.Random(limit)
    shards = {"big": [rng.randrange(0, 13) for _ in range(700)], "one": [99], "zeros": [0, 0, 0, 5, 0], "large": [50] * 9, None: [3, 4, 5, 6]}
    rows = [(s, i, n) for s, ns in shards.items() for i, n in enumerate(ns)]
    rng.shuffle(rows)
    got = sample.pack_batches(spark.createDataFrame(rows, "shard string, item long, n long").repartition(4), limit).collect()
    assert len(got) == len(rows)
    for s, ns in shards.items():
        assert [r["batch"] for r in sorted((r for r in got if r["shard"] == s), key=lambda r: r["item"])] == greedy(ns, limit), s


def test_boxes_of_very_different_size(spark):
    rng = random.Random(5)
    boxes = [(k, x, y, x + side * rng.random(), y + side * rng.random()) for k in range(150) for x, y, side in [(rng.uniform(-1e5, 1e5), rng.uniform(-1e5, 1e5), rng.choice([0.0, 1.0, 30.0, 1e3, 1e5]))]]
    boxes += [(150, -1e5, -1e5, 1e5, 1e5), (151, 0.0, 0.0, 64.0, 64.0), (152, 64.0, 64.0, 64.0, 64.0), (153, -1e5, 0.0, 1e5, 0.0)]
    schema = "path long, min_x double, min_y double, max_x double, max_y double"
    a, b = spark.createDataFrame(boxes[::2] + boxes[-3:], schema), spark.createDataFrame(boxes[1::2] + boxes[-4:], schema).withColumnRenamed("path", "raster")
    met = catalog.match_extent(a, b, 1.0)
    got = sorted((r["path"], r["raster"]) for r in met.collect())
    left, right = boxes[::2] + boxes[-3:], boxes[1::2] + boxes[-4:]
    assert got == sorted((p[0], q[0]) for p in left for q in right if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    assert len(got) > 300


@pytest.mark.parametrize("w", [1, 2, 3, 7, 8, 9, 40])
def test_nearest_columns(w):
    rng = np.random.default_rng(w)
    n = 30
    source = rng.integers(0, n, (n, w))
    gap = np.abs(np.arange(n)[:, None] - source)
    gap2 = np.where(rng.random((n, w)) < 0.3, FAR, gap**2)
    best = nearest_columns(gap2, source)
    for r in range(n):
        for c in range(w):
            want = min(range(w), key=lambda k: (min(gap2[r, k] + (c - k) ** 2, FAR), source[r, k], k))
            assert gap2[r, best[r, c]] == gap2[r, want] == FAR or best[r, c] == want


@pytest.mark.parametrize(("h", "w", "share"), [(150, 37, 0.02), (1, 60, 0.2), (90, 1, 0.2), (20, 20, 0.5), (70, 70, 0.003)])
def test_fill_takes_the_nearest_cell(spark, h, w, share):
    rng = np.random.default_rng(h)
    known = {(int(r), int(c)): float(i) for i, (r, c) in enumerate(np.argwhere(rng.random((h, w)) < share))}
    rows = [("A", r, c, v, None if (r + c) % 3 else -v) for (r, c), v in known.items()] + [("B", 0, 0, None, 4.0)]
    frame = spark.createDataFrame([("A", 0.0, 0.0, h, w), ("B", 0.0, 0.0, 2, 3)], "cloud string, x_min double, y_min double, h long, w long")
    cells = spark.createDataFrame(rows, "cloud string, row long, col long, a double, b double")
    got = {(r["cloud"], r["row"], r["col"]): (r["a"], r["b"]) for r in raster.fill_nearest(cells, frame, ["a", "b"]).collect()}
    assert len(got) == h * w + 6
    assert {v for k, v in got.items() if k[0] == "B"} == {(None, 4.0)}
    for band, at in ((0, list(known)), (1, [k for k in known if sum(k) % 3 == 0])):
        for r in range(h):
            for c in range(w):
                want = min(at, key=lambda k: ((k[0] - r) ** 2 + (k[1] - c) ** 2, k)) if at else None
                assert got["A", r, c][band] == (None if want is None else known[want] * (1 if band == 0 else -1))
