"""Periodic runs of words: harmonic-grid candidates, extended exactly by queries on a recompressed grammar.

A run of period q and at least max(LEAST, 3q) words repeats itself q words on over max(LEAST - q, 2q) words or more. So with
half of that as the step of a grid, at least two neighbouring grid points lie in it, and both equal the word q further. All
periods together look at n (1 + 1/2 + 1/3 + ...) words. Where both points agree, the grammar tells how far the
repetition reaches to either side; a stretch that several periods find has the smallest of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraframe.llm._common import WORD_GAP, in_small_batches
from terraframe.llm.recompression import Grammar

#: Words of the shortest run, and how often its period fits.
LEAST, TIMES = 24, 3
#: Words of texts that are taken together.
PART_WORDS = 1 << 20
RUN = "array<struct<start:long,length:long,period:long>>"


def candidates(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grid points (place, period, chain) of sequences given one after another, the longest first; a chain is a stretch of neighbouring points of a period."""
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    found, chains = [], 0
    for q in range(1, int(sizes[0]) // TIMES + 1 if len(sizes) else 0):
        long = np.searchsorted(-sizes, -max(LEAST, TIMES * q), "right")
        if not long:
            break
        n, step = int(ends[long - 1]), max(LEAST - q, (TIMES - 1) * q) // 2
        same = words[: n - q : step] == words[q:n:step]
        at = np.flatnonzero(same[:-1] & same[1:]) * step
        at = at[owner[at] == owner[np.minimum(at + step + q, len(owner) - 1)]]
        if len(at):
            chain = np.cumsum(np.r_[True, np.diff(at) > step]) + chains
            chains = int(chain[-1])
            found.append((at, np.full(len(at), q), chain))
    return tuple(np.concatenate(c).astype(np.int64) for c in zip(*found)) if found else (np.empty(0, np.int64),) * 3


def runs_of(words: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The runs of each sequence as rows (start, length, period), by start and then period."""
    none = np.empty((0, 3), np.int64)
    order = np.argsort(-sizes, kind="stable")
    starts = np.cumsum(sizes) - sizes
    ordered = np.concatenate([words[starts[k] : starts[k] + sizes[k]] for k in order]) if len(order) else words
    at, period, chain = candidates(ordered, sizes[order])
    out = [none] * len(sizes)
    if not len(at):
        return out
    # a grammar of the sequences that have candidates, and of no others
    ends = np.cumsum(sizes[order])
    owner = np.searchsorted(ends, at, "right")
    some, owner = np.unique(owner, return_inverse=True)
    first = ends - sizes[order]
    grammar = Grammar(np.concatenate([ordered[first[k] : ends[k]] for k in some]), sizes[order][some])
    shift = grammar.at[owner] - first[some][owner]
    wide = len(ordered) + 1
    key, ask, rows = chain * wide + at, np.flatnonzero(np.r_[True, chain[1:] != chain[:-1]]), []
    while len(ask):
        i, q = at[ask] + shift[ask], period[ask]
        on, back = grammar.extend(i, i + q, 1), grammar.extend(i, i + q, -1)
        rows.append(np.stack([owner[ask], at[ask] - first[some][owner[ask]] - back + 1, on + back - 1 + q, q], axis=1))
        # the next point of the chain that the stretch doesn't hold, if any
        onward = np.searchsorted(key, key[ask] + on)
        keep = onward < len(key)
        keep[keep] = chain[onward[keep]] == chain[ask[keep]]
        ask = onward[keep]
    all_rows = np.concatenate(rows)
    all_rows = all_rows[all_rows[:, 2] >= np.maximum(LEAST, TIMES * all_rows[:, 3])]
    all_rows = all_rows[np.lexsort(all_rows.T[[3, 2, 1, 0]])]
    fresh = np.ones(len(all_rows), bool)
    fresh[1:] = (all_rows[1:, :3] != all_rows[:-1, :3]).any(axis=1)  # of one stretch the smallest period
    all_rows = all_rows[fresh]
    bounds = np.searchsorted(all_rows[:, 0], np.arange(len(some) + 1))
    for k, lo, hi in zip(some, bounds, bounds[1:]):
        mine = all_rows[lo:hi, 1:]
        out[order[k]] = mine[np.lexsort((mine[:, 2], mine[:, 0]))]
    return out


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words, less those that a run repeats after its first period."""
    if not len(runs):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([w for w, deep in zip(words, np.cumsum(edges[:-1]).tolist()) if not deep])


def _parts(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    part, size = [], 0
    for text in texts:
        # bytes split at the six characters between words, no others
        words = (text or "").encode().split()
        if part and size + len(words) > PART_WORDS:
            yield part
            part, size = [], 0
        part.append(words)
        size += len(words)
    if part:
        yield part


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed for every row of docs (doc_id, text).

    collapsed has the words, joined by one space, that no run holds after its first period. Null, empty and wordless texts have no
    words, no runs and an empty collapsed text; texts of any length are taken whole; repeated rows stay; other columns are
    ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for part in _parts(batch.column(1).to_pylist()):
                number: dict[bytes, int] = {}
                sizes = np.array([len(w) for w in part], np.int64)
                flat = np.fromiter((number.setdefault(w, len(number)) for words in part for w in words), np.int64, int(sizes.sum()))
                runs = runs_of(flat, sizes)
                rows = np.concatenate(runs)
                fields = [pa.array(rows[:, c]) for c in range(3)]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                text = pa.array([_collapsed(w, r).decode() for w, r in zip(part, runs)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(part)), pa.array(sizes), lists, text], names=["doc_id", "n_words", "runs", "collapsed"])
                lo += len(part)

    return in_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, f"doc_id long, n_words long, runs {RUN}, collapsed string")


def repeated(text: Column, doc_id: Column) -> Column:
    """text with a repetition in it where the contract of the query asks for one: from a word on, a part of the words over and over."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")

    def again(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))))

    # the words are made once for a text, as the one element of a list
    made = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, again(w)).otherwise(text)), F.lit(0))
    return F.when(F.coalesce(h % 10 == 0, F.lit(False)), made).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns of find()'s rows; the best run has the greatest exact length / period, of equals the first start, then period."""
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    rows = found.withColumn("_best", best)
    line = lambda r: F.concat(*[x for c in ("start", "length", "period") for x in (r[c].cast("string"), F.lit("\n" if c == "period" else ","))])
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * _best.length DIV _best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", line)), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
