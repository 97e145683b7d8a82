"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + sum over i<j of <v_i, v_j> x_i x_j); the pairwise part is taken in
linear time as half of (sum v_i x_i)^2 - sum (v_i x_i)^2 over the factors.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraframe.llm._common import in_small_batches, without, written

#: At most so many labelled rows are fitted, those with the smallest hashes; the bound keeps the driver's share fixed.
FIT_ROWS = 12_000
WORD_DIM, FACTORS, EPOCHS, RATE, DECAY, THRESHOLD = 1 << 13, 6, 12, 0.05, 1e-4, 0.3
STATS = 22


def structure(text: str, words: list[str], counts: Counter, n_chars: int | None) -> list[float]:
    """Structure statistics, each within about -1 and 1. Reads the whole text.

    Characters are counted by their UTF-8 bytes; those beyond ASCII count as letters.
    """
    n, m = max(len(text), 1), max(len(words), 1)
    octets = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    upper, digits = octets[65:91].sum(), octets[48:58].sum()
    letters = upper + octets[97:123].sum() + octets[0xC0:].sum()
    spaces = octets[9:14].sum() + octets[32]
    symbols = max(n - letters - digits - spaces, 0)
    sentence = octets[[46, 33, 63]].sum()
    lines = text.split("\n")
    filled = [x for x in lines if x and not x.isspace()]
    line_counts = Counter(filled) if len(filled) > 1 else {}
    return [
        min(np.log1p(n) / 12, 1), min(np.log1p(m) / 10, 1), letters / n, digits / n, spaces / n, upper / max(letters, 1),
        symbols / n, min(10 * sentence / m, 3) / 3, len(counts) / m, max(counts.values()) / m if counts else 1.0, sum(map(eq, words, words[1:])) / m,
        1 - len(set(map(hash, zip(words, words[1:])))) / max(m - 1, 1), sum(c for c in line_counts.values() if c > 1) / max(len(filled), 1),
        sum(x.rstrip().endswith((".", "!", "?")) for x in filled) / max(len(filled), 1),
        min(n / len(lines) / 500, 1), min((n - spaces) / m / 15, 1), 5 * octets[[124, 35, 36, 37, 38, 42, 123, 125, 60, 62, 61]].sum() / n,
        5 * octets[33] / n, float("http" in text or "www." in text), float(len(words) < 20),
        min(np.log1p(n_chars or 0) / 12, 1), float(n_chars is not None and n_chars != len(text)),
    ]


class Features:
    """Turns texts into sparse rows: hashed words weighted by damped, length-normalised counts, then statistics."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def row(self, text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        words = text.split()
        counts = Counter(words)
        if len(self.seen) > 150_000:
            self.seen = {}
        seen = self.seen
        for w in [w for w in counts if w not in seen]:
            seen[w] = zlib.crc32(w.lower().encode("utf-8", "replace")) % WORD_DIM
        at = np.fromiter(map(seen.__getitem__, counts), np.int64, len(counts))
        x = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
        x /= max(np.sqrt((x * x).sum()), 1e-9)
        idx, back = np.unique(at, return_inverse=True)
        val = np.bincount(back, x, len(idx)) if len(idx) else np.empty(0)
        stats = np.array(structure(text, words, counts, n_chars))
        return np.concatenate([idx, WORD_DIM + np.arange(STATS)]), np.concatenate([val, stats])


class Machine:
    """The fitted weights; small and of fixed size, so tasks get them in their closure."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray) -> None:
        self.w0, self.w, self.v = w0, w, v

    def raw(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Scores before the sigmoid, by the sum-of-squares identity over all rows' features at once."""
        if not rows:
            return np.empty(0)
        row = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
        idx, x = np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows])
        linear = np.bincount(row, self.w[idx] * x, len(rows))
        vx = self.v[idx] * x[:, None]
        pair = sum(np.bincount(row, vx[:, f], len(rows)) ** 2 - np.bincount(row, vx[:, f] ** 2, len(rows)) for f in range(self.v.shape[1]))
        return self.w0 + linear + 0.5 * pair

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -35, 35)))


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Machine:
    """Mini-batch AdaGrad on the logistic loss, classes weighted evenly."""
    rng = np.random.default_rng(seed)
    dim = WORD_DIM + STATS
    w0, w, v = 0.0, np.zeros(dim), rng.normal(0, 0.02, (dim, FACTORS))
    if not len(rows) or labels.min() == labels.max():
        return Machine(0.0 if not len(rows) else (4.0 if labels[0] else -4.0), w, np.zeros_like(v))
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    g0, gw, gv = 1e-8, np.full(dim, 1e-8), np.full((dim, FACTORS), 1e-8)
    for _ in range(EPOCHS):
        for lot in np.array_split(rng.permutation(len(rows)), max(len(rows) // 64, 1)):
            row = np.repeat(np.arange(len(lot)), [len(rows[i][0]) for i in lot])
            idx, x = np.concatenate([rows[i][0] for i in lot]), np.concatenate([rows[i][1] for i in lot])
            vx = v[idx] * x[:, None]
            sums = np.stack([np.bincount(row, vx[:, f], len(lot)) for f in range(FACTORS)], axis=1)
            raw = w0 + np.bincount(row, w[idx] * x, len(lot)) + 0.5 * ((sums**2).sum(1) - np.bincount(row, (vx**2).sum(1), len(lot)))
            err = weight[lot] * (1 / (1 + np.exp(-np.clip(raw, -35, 35))) - labels[lot]) / len(lot)
            used, back = np.unique(idx, return_inverse=True)
            dw = np.bincount(back, err[row] * x, len(used)) + DECAY * w[used]
            per = err[row][:, None] * x[:, None] * (sums[row] - vx)
            dv = np.stack([np.bincount(back, per[:, f], len(used)) for f in range(FACTORS)], axis=1) + DECAY * v[used]
            d0 = err.sum()
            g0 += d0 * d0
            gw[used] += dw * dw
            gv[used] += dv * dv
            w0 -= RATE * d0 / np.sqrt(g0)
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= RATE * dv / np.sqrt(gv[used])
    return Machine(w0, w, v)


def held_out(doc_id):
    """Rows never learnt from: CRC-32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = FIT_ROWS) -> Machine:
    """Fits on labelled rows that are not held out, max_rows of them at most (the smallest MD5 of the id).

    Null labels and unlabelled documents are left out; of rows that repeat a doc_id each counts.
    Features are made on the executors; the driver gets max_rows sparse rows at most, and labels are no feature.
    """
    wanted = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_label")).filter("_label IN (0, 1)").filter(~held_out(F.col("_id")))
    few = written(wanted.orderBy(F.md5(F.col("_id").cast("string")), "_id", "_label").limit(max_rows), "fit-labels")
    text = docs.select("doc_id", "text", _n_chars(docs).alias("n_chars"))
    joined = text.join(F.broadcast(few), text["doc_id"] == few["_id"]).select("doc_id", "text", "n_chars", "_label")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Features()
        for frame in frames:
            rows = [(d, int(y), *make.row(t, None if pd.isna(c) else int(c))) for d, t, c, y in frame.itertuples(index=False)]
            yield pd.DataFrame({"doc_id": [r[0] for r in rows], "y": [r[1] for r in rows], "idx": [r[2].astype("<i2").tobytes() for r in rows], "val": [r[3].astype("<f4").tobytes() for r in rows]})

    sample = in_small_batches(joined).mapInPandas(run, "doc_id long, y int, idx binary, val binary")
    # a repeated doc_id can only widen the sample by its repeats; the cut keeps the bound
    got = written(sample, "fit-rows").orderBy("doc_id", "idx").limit(max_rows).toArrow()
    rows = [(np.frombuffer(i.as_py(), "<i2").astype(np.int64), np.frombuffer(x.as_py(), "<f4").astype(np.float64)) for i, x in zip(got["idx"], got["val"])]
    return fit_rows(rows, got["y"].to_numpy().astype(np.float64))


def _n_chars(docs: DataFrame):
    return F.col("n_chars").cast("long") if "n_chars" in [c.lower() for c in docs.columns] else F.lit(None).cast("long")


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted (score >= threshold) for every whole text.

    A null text is scored as an empty one, a null n_chars as absent. Rows stand alone, so ties, repeats and
    empty tables need nothing; input columns with the names of results are replaced, all others pass.
    """
    base = without(docs, "held_out", "score", "predicted").withColumn("held_out", held_out(F.col("doc_id")))
    names = base.columns
    low = [c.lower() for c in names]
    at, n_at = low.index("text"), low.index("n_chars") if "n_chars" in low else None
    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features()
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                chars = part.column(n_at).to_pylist() if n_at is not None else [None] * part.num_rows
                rows = [make.row(t, c) for t, c in zip(part.column(at).to_pylist(), chars)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(machine.score(rows), pa.float64())], names=schema.names)

    return in_small_batches(base).mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Fit on the labelled part of docs, then score all of them; see fit() and score()."""
    return score(docs, fit(docs, labels, max_rows), threshold)
