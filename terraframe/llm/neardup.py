"""Near-duplicate groups by HyperMinHash banding, estimates and exact confirmation.

Documents with equal shingle sets are one class from the start, so copies never make pairs (a class is named by a
64-bit hash of its set). Classes that share a band meet in a bucket; buckets of the same members count once. Two
passes over the buckets follow, both in blocks of bounded size:

1. By registers alone, a block is spanned by the tree of its likeliest pairs, no more pairs than members. These
   are confirmed on full shingle sets and give first components.
2. Only buckets whose members are then in several components are looked at again. Members with a pair that may
   still join two components bring their texts, and such pairs are compared in place on full sets, likeliest first,
   skipping what is joined by then. Of all buckets that a pair shares, the one of its first band looks at it.

So no pair that may be a link is dropped, none is looked at twice, and what is shuffled follows the number of
members of buckets, not their squares.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraframe.llm import hyperminhash as hmh
from terraframe.llm._common import bitmap, in_small_batches, less, marked, without, written
from terraframe.llm.components import components

#: Members and shingles a block aims at.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
SIGNATURE_SCHEMA = "doc_id long, n_shingles long, class long, regs binary, bands array<long>"


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class (key of the set), regs and bands; the last three null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in hmh.slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                sets, bounds = hmh.shingle_sets(part.column(1))
                size = np.diff(bounds)
                regs = hmh.registers(sets, bounds)
                none = size == 0
                key = np.array([hmh.class_key(sets[a:b]) for a, b in zip(bounds, bounds[1:])], np.int64)
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * hmh.REGISTERS), len(size), [None, pa.py_buffer(regs.tobytes())]).cast(pa.binary())
                bands = pa.FixedSizeListArray.from_arrays(pa.array(hmh.band_keys(regs).ravel()), hmh.BANDS).cast(pa.list_(pa.int64()))
                hide = lambda x: pa.compute.if_else(pa.array(none), pa.scalar(None, x.type), x)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(key, mask=none), hide(packed), hide(bands)], names=["doc_id", "n_shingles", "class", "regs", "bands"])

    return in_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, SIGNATURE_SCHEMA)


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, hmh.REGISTERS)


def _by_group(work: Callable[[pa.RecordBatch], list[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs work on runs of whole groups of rows sorted by their first three columns (band, b1, b2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(c)[batch.num_rows - 1].as_py() for c in range(3)]
            same = np.logical_and.reduce([batch.column(c).to_numpy() == last[c] for c in range(3)])
            tail = int(same.argmax())  # rows are sorted, so the last group is a run
            if tail == 0 and held and all(held[-1].column(c)[held[-1].num_rows - 1].as_py() == last[c] for c in range(3)):
                held.append(batch)
                continue
            yield from work(pa.concat_batches([*held, batch.slice(0, tail)]))
            held = [batch.slice(tail)]
        if held:
            yield from work(pa.concat_batches(held))

    return run


def _groups(rows: pa.RecordBatch) -> np.ndarray:
    """The bounds of the groups of rows sorted by their first three columns."""
    if not rows.num_rows:
        return np.zeros(1, np.int64)
    key = np.stack([rows.column(c).to_numpy() for c in range(3)])
    return np.r_[np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)]), rows.num_rows]


def spanning_tree(regs: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
    """The pairs that span members by their likeliest links, a forest where no pair may link; grown a member at a time."""
    best, parent, left = np.full(len(n), -np.inf), np.zeros(len(n), np.int64), np.ones(len(n), bool)
    now, out = 0, []
    for _ in range(len(n) - 1):
        left[now] = False
        equal = np.count_nonzero(regs == regs[now], axis=1) / hmh.REGISTERS
        closer = left & (equal > best) & hmh.may_link(equal, n, n[now])
        best[closer], parent[closer] = equal[closer], now
        now = int(np.where(left, best, -np.inf).argmax())
        if not left[now]:
            now = int(left.argmax())
        if best[now] > -np.inf:
            out.append((int(parent[now]), now))
    return out


def _dealt(members: DataFrame, others) -> DataFrame:
    """members (band, size, words, u, ...) dealt to groups (band, b1, b2) of two blocks, in order; others tells which a block meets."""
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("words") / BLOCK_SHINGLES))
    dealt = members.withColumn("_own", F.pmod(F.xxhash64("u"), blocks)).withColumn("_other", F.explode(others(F.col("_own"), blocks)))
    rest = [c for c in members.columns if c not in ("band", "size", "words")]
    grouped = dealt.select("band", F.least("_own", "_other").alias("b1"), F.greatest("_own", "_other").alias("b2"), "_own", *rest)
    return grouped.repartition("band", "b1", "b2").sortWithinPartitions("band", "b1", "b2", "u")


def _likely_trees(members: DataFrame) -> DataFrame:
    """Pairs (u, v), u the larger, that span the blocks of buckets: each block by itself, and with the first one of its bucket."""

    def work(rows: pa.RecordBatch) -> list[pa.RecordBatch]:
        u, n, regs = rows.column(4).to_numpy(), rows.column(5).to_numpy().astype(float), _registers(rows.column(6))
        bounds = _groups(rows)
        a, size = bounds[:-1], np.diff(bounds)
        two = a[size == 2]
        fine = two[hmh.may_link((regs[two] == regs[two + 1]).mean(axis=1), n[two], n[two + 1])]
        left, right = [fine], [fine + 1]
        for lo, m in zip(a[size > 2], size[size > 2]):
            pairs = np.array(spanning_tree(regs[lo : lo + m], n[lo : lo + m]), np.int64).reshape(-1, 2) + lo
            left.append(pairs[:, 0])
            right.append(pairs[:, 1])
        x, y = u[np.concatenate(left)], u[np.concatenate(right)]
        return [pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["u", "v"])]

    near = lambda own, blocks: F.when(own == 0, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(F.lit(0).cast("long"), own))
    return _dealt(members.select("band", "size", "words", "u", "n_shingles", "regs"), near).mapInArrow(_by_group(work), "u long, v long")


def _open_pairs(rows: pa.RecordBatch, lo: int, hi: int, cols: dict) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows lo to hi, likeliest first, that this group must look at: in different components, may link, first band here."""
    own, comp, n, regs = (cols[c][lo:hi] for c in ("own", "comp", "n", "regs"))
    if (comp == comp[0]).all():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    one, number = cols["b1"][lo] == cols["b2"][lo], cols["band"][lo] & hmh.BAND_BITS
    left, right, near = [], [], []
    for i in range(hi - lo - 1):
        rest = np.flatnonzero((comp[i + 1 :] != comp[i]) & (100 * np.minimum(n[i + 1 :], n[i]) >= 75 * np.maximum(n[i + 1 :], n[i])) & (one | (own[i + 1 :] != own[i]))) + i + 1
        if len(rest):
            equal = regs[rest] == regs[i]
            share = np.count_nonzero(equal, axis=1) / hmh.REGISTERS
            fine = np.flatnonzero(hmh.may_link(share, n[rest], n[i]))
            fine = fine[hmh.first_band(equal[fine]) == number]
            left.append(np.full(len(fine), i))
            right.append(rest[fine])
            near.append(share[fine])
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(-np.concatenate(near), kind="stable")
    return np.concatenate(left)[order], np.concatenate(right)[order]


def _columns(rows: pa.RecordBatch) -> dict:
    names = rows.schema.names
    at = lambda c: rows.column(names.index(c))
    return {"band": at("band").to_numpy(), "b1": at("b1").to_numpy(), "b2": at("b2").to_numpy(), "own": at("_own").to_numpy(), "u": at("u").to_numpy(), "comp": at("comp").to_numpy(), "n": at("n_shingles").to_numpy().astype(float), "regs": _registers(at("regs"))}


def _askers(members: DataFrame) -> DataFrame:
    """The members, per group, with pairs to look at: band, b1, b2, _own, u, comp, n_shingles, regs, doc."""

    def work(rows: pa.RecordBatch) -> list[pa.RecordBatch]:
        cols, bounds = _columns(rows), _groups(rows)
        keep = np.zeros(rows.num_rows, bool)
        for lo, hi in zip(bounds, bounds[1:]):
            for side in _open_pairs(rows, lo, hi, cols):
                keep[lo + side] = True
        return [rows.filter(pa.array(keep))]

    everyone = lambda own, blocks: F.sequence(F.lit(0).cast("long"), blocks - 1)
    dealt = _dealt(members.select("band", "size", "words", "u", "comp", "n_shingles", "regs", "doc"), everyone)
    return dealt.mapInArrow(_by_group(work), dealt.schema)


def _links_inside(askers: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) of askers that are linked on full sets; of those that join the same components one."""

    def work(rows: pa.RecordBatch) -> list[pa.RecordBatch]:
        bounds, text, u = _groups(rows), rows.column(rows.schema.names.index("text")), rows.column(4).to_numpy()
        out = [pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["u", "v"])]
        for lo, hi in zip(bounds, bounds[1:]):
            sets, edges = hmh.shingle_sets(text.slice(lo, hi - lo))
            # a doc_id that stands for several texts brings them all; the class tells which is meant
            right = [k for k in range(hi - lo) if hmh.class_key(sets[edges[k] : edges[k + 1]]) == u[lo + k]]
            group = rows.slice(lo, hi - lo).take(pa.array(right, pa.int64()))
            if len(right) < 2:
                continue
            cols = _columns(group)
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while (up := parent.get(x, x)) != x:
                    parent[x] = x = parent.get(up, up)
                return x

            found = []
            for i, j in zip(*(x.tolist() for x in _open_pairs(group, 0, len(right), cols))):
                a, b = root(cols["comp"][i]), root(cols["comp"][j])
                if a != b and hmh.linked(sets[edges[right[i]] : edges[right[i] + 1]], sets[edges[right[j]] : edges[right[j] + 1]]):
                    parent[a] = b
                    found.append((cols["u"][i], cols["u"][j]))
            if found:
                x, y = np.array(found, np.int64).T
                out.append(pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["u", "v"]))
        return out

    # every column but the text is small; texts go by the document to the groups that ask for them
    named = texts.select(F.col("_doc"), "text").hint("merge")
    met = askers.join(named, F.col("doc").eqNullSafe(F.col("_doc"))).drop("_doc", "doc")
    ordered = met.select("band", "b1", "b2", "_own", "u", "comp", "n_shingles", "regs", "text").repartition("band", "b1", "b2").sortWithinPartitions("band", "b1", "b2", "u")
    return ordered.mapInArrow(_by_group(work), "u long, v long")


def _confirmed(pairs: DataFrame, known: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    end = lambda c: known.select(F.col("class").alias(c), F.col("doc").alias(f"doc_{c}")).hint("merge")
    text = lambda c: texts.select(F.col("_doc").alias(f"_{c}"), F.col("text").alias(f"text_{c}")).hint("merge")
    ids = written(pairs.join(end("u"), "u").join(end("v"), "v"), "pairs")
    one = ids.join(text("u"), F.col("doc_u").eqNullSafe(F.col("_u")))
    two = one.join(text("v"), F.col("doc_v").eqNullSafe(F.col("_v")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                (a, at), (b, bt) = hmh.shingle_sets(part.column(2)), hmh.shingle_sets(part.column(3))
                ok = []
                for k, (u, v) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                    x, y = a[at[k] : at[k + 1]], b[bt[k] : bt[k + 1]]
                    ok.append(hmh.class_key(x) == u and hmh.class_key(y) == v and hmh.linked(x, y))
                yield pa.RecordBatch.from_arrays(part.columns[:2], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return two.select("u", "v", "text_u", "text_v").mapInArrow(run, "u long, v long")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text).

    A null or wordless text has an empty set and is linked with nothing. component_id is the smallest doc_id
    reachable, null doc_ids aside (a group of them alone has none); kept tells doc_id = component_id, so rows
    that repeat a kept doc_id are all marked. Texts of any length are taken whole; other columns are ignored. An
    empty table gives an empty result.
    """
    made = written(signatures(docs), "signatures")
    full = made.filter("n_shingles > 0")
    by_class = written(full.groupBy("class").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n")), "classes")

    # a row a class: only rows whose class may have several are moved for that
    flagged = marked(full.select("class", "bands"), bitmap(by_class.filter("n > 1"), "class"), "class")
    once = flagged.filter("NOT _marked").select("class", "bands").unionByName(flagged.filter("_marked").groupBy("class").agg(F.first("bands").alias("bands")))
    # buckets: bands that several classes share, each set of members once
    bands = once.select(F.explode("bands").alias("band"), F.col("class").alias("u"))
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    met = written(bands.join(shared.hint("merge"), "band", "left_semi"), "bucket-rows")
    sized = met.groupBy("band").agg(F.count("*").alias("size"), F.min("u").alias("least"), F.sum(F.xxhash64("u").cast("decimal(20,0)")).alias("sum"))
    number = F.struct(F.col("band").bitwiseAND(F.lit(int(hmh.BAND_BITS))).alias("number"), F.col("band"))
    buckets = written(sized.groupBy("size", "least", "sum").agg(F.min(number)["band"].alias("band")).select("band", "size"), "buckets")
    members = written(met.join(buckets.hint("merge"), "band"), "bucket-members")

    # what the members of buckets are known by: the document that stands for them, size and registers
    involved = members.select(F.col("u").alias("class")).distinct()
    rows = marked(full.select("class", "doc_id", "n_shingles", "regs"), bitmap(involved, "class"), "class").filter("_marked")
    known = written(rows.groupBy("class").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs")), "known")
    words = members.join(known.select(F.col("class").alias("u"), "n_shingles").hint("merge"), "u").groupBy("band").agg(F.sum("n_shingles").alias("words"))
    sides = written(members.join(words.hint("merge"), "band"), "bucket-sizes")
    with_regs = sides.join(known.select(F.col("class").alias("u"), "doc", "n_shingles", "regs").hint("merge"), "u")
    likely = written(_likely_trees(with_regs).distinct(), "likely")

    named_texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), "text")
    texts = written(marked(named_texts, bitmap(known.select(F.col("doc").alias("_doc")), "_doc"), "_doc").filter("_marked").drop("_marked"), "pair-texts")
    first = written(_confirmed(likely, known, texts), "confirmed")
    labels = components(first)

    comp = F.coalesce("comp", "u")
    named = written(sides.join(labels.withColumnRenamed("node", "u").hint("merge"), "u", "left").select("band", "size", "words", "u", comp.alias("comp")), "named-members")
    split = named.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("size").alias("n"), F.max("words").alias("words")).filter(f"lo <> hi AND (n > 2 OR words > {BLOCK_SHINGLES})").select("band")
    opened = named.join(split.hint("merge"), "band", "left_semi").join(known.select(F.col("class").alias("u"), "doc", "n_shingles", "regs").hint("merge"), "u")
    askers = written(_askers(opened), "askers")
    more = written(_links_inside(askers, texts), "links-inside")
    if not more.isEmpty():
        labels = components(labels.filter("node <> comp").select(F.col("node").alias("u"), F.col("comp").alias("v")).unionByName(more))

    touched = by_class.join(labels.withColumnRenamed("node", "class").hint("merge"), "class").select("class", "comp", "doc")
    lowest = touched.groupBy("comp").agg(F.min("doc").alias("lowest"))
    moved = touched.select("class", "comp").join(lowest.hint("merge"), "comp").select("class", "lowest")
    final = written(by_class.join(moved.hint("merge"), "class", "left").select("class", F.coalesce("lowest", "doc").alias("component_id")), "class-components")
    whole = made.select("doc_id", "n_shingles", "class")
    linked = whole.filter("class IS NOT NULL").join(final.hint("merge"), "class").select("doc_id", "n_shingles", "component_id")
    alone = whole.filter("class IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs of which one stays of each group, with docs' columns; of rows that repeat a kept doc_id one stays.

    Null, empty and wordless texts are linked with nothing and all stay (of those that repeat a doc_id one); a
    group whose doc_ids are all null keeps one row; columns of any other name pass; an empty table stays empty.
    """
    columns = docs.columns
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct("*").alias("_row"))
    return _stay(docs).select("_row.*").select(*[F.col(f"`{c}`") for c in columns])


def _stay(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, _row) that stay."""
    out = written(groups(docs), "near")
    kept = less(docs, written(out.filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone"))
    twice = written(out.filter("kept").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("_twice")), "repeated-ids")
    if twice.isEmpty():
        return kept
    plain = kept.join(twice, kept["doc_id"].eqNullSafe(twice["_twice"]), "left_anti")
    again = kept.join(twice, kept["doc_id"].eqNullSafe(twice["_twice"]), "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text")) == 1
    return plain.unionByName(without(again.withColumn("_first", first).filter("_first"), "_first"))
