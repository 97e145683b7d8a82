"""Token ids in files: bit- or byte-plane shuffling, zstandard, and a chunk index.

A data set is a folder of Parquet rows, one a chunk, written and committed by Spark, so it works on any
store and survives lost executors. Documents go in ascending doc_id order over shards (one a range
partition) and within them. A chunk holds CHUNK_IDS consecutive ids of its shard (the last fewer): its ids
as unsigned 32-bit integers, transposed into planes, each plane compressed by itself. Beside the payload
stands the index: shard, chunk, position of the first id, number of ids, compressed size of each plane,
and ordinal, doc_id, position and length of every document that has ids there.

Null texts or id lists are empty documents; null doc_ids come first; rows that repeat a doc_id are
documents of their own, side by side; an empty table gives an empty data set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraframe.llm._common import in_small_batches
from terraframe.llm.bpe import encoder, ended, slices

CHUNK_IDS = 1 << 16
CHUNK_SCHEMA = "shard int, chunk int, first long, n_ids int, kind string, sizes array<int>, payload binary, docs array<struct<seq:long,doc_id:long,start:long,n:long>>"
PIECE_SCHEMA = "shard int, seq long, doc_id long, start long, n long, chunk int, ids array<int>"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of ids, lowest first; 4 byte planes or 32 bit planes."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [p.tobytes() for p in np.ascontiguousarray(octets.T)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(p, bitorder="little").tobytes() for p in np.ascontiguousarray(bits.T)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if n == 0:
        return np.empty(0, np.uint32)
    if kind == "byte":
        octets = np.stack([np.frombuffer(p, np.uint8) for p in planes])
        return np.ascontiguousarray(octets.T).view("<u4").ravel()
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes])
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u4").ravel()


def part_of(planes: list[bytes], start: int, stop: int, n: int, kind: str) -> np.ndarray:
    """Ids start to stop of the n that planes hold; of byte planes only these are put together."""
    if kind == "byte":
        return from_planes([memoryview(p)[start:stop] for p in planes], stop - start, kind)
    return from_planes(planes, n, kind)[start:stop]


class _Shard:
    """Gathers the ids of one partition and cuts them into chunks; holds one chunk and one document at most."""

    def __init__(self, shard: int, kind: str, chunk_ids: int) -> None:
        import zstandard

        self.shard, self.kind, self.size, self.pack = shard, kind, chunk_ids, zstandard.ZstdCompressor(level=3).compress
        self.chunk = self.first = self.seq = self.held = 0
        self.ids: list[np.ndarray] = []
        self.docs: list[dict] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[dict]:
        doc = {"seq": self.seq, "doc_id": doc_id, "start": self.first + self.held, "n": len(ids)}
        self.seq += 1
        self.docs.append(doc)
        while self.held + len(ids) >= self.size:
            cut = self.size - self.held
            self.ids.append(ids[:cut])
            ids = ids[cut:]
            yield self.flush()
            if len(ids):
                self.docs.append(doc)
        if len(ids):
            self.ids.append(ids)
            self.held += len(ids)

    def flush(self) -> dict:
        ids = np.concatenate(self.ids) if self.ids else np.empty(0, np.int32)
        planes = [self.pack(p) for p in to_planes(ids, self.kind)] if len(ids) else []
        row = {"shard": self.shard, "chunk": self.chunk, "first": self.first, "n_ids": len(ids), "kind": self.kind, "sizes": [len(p) for p in planes], "payload": b"".join(planes), "docs": self.docs}
        self.chunk, self.first, self.held, self.ids, self.docs = self.chunk + 1, self.first + len(ids), 0, [], []
        return row


def write_texts(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = None, kind: str = "byte", chunk_ids: int = CHUNK_IDS) -> None:
    """Encodes the whole texts of docs (doc_id, text) and writes their ids to path in doc_id order.

    The range sort moves texts, which compress better than ids; encoding and packing follow in one pass. A null or empty
    text has no ids but the end id, a text of any length is cut over as many chunks as it needs; null doc_ids come first,
    rows that repeat a doc_id stand side by side; other columns are ignored; an empty table writes an empty data set.
    """
    # rows that share a doc_id, or have none, may still be many: the text's hash parts them
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_tie"))
    ordered = keyed.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")
    arrow_schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("kind", pa.string()), ("sizes", pa.list_(pa.int32())), ("payload", pa.binary()), ("docs", pa.list_(pa.struct([("seq", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer_path)
        shard = _Shard(TaskContext.get().partitionId(), kind, chunk_ids)
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                ids, bounds = ended(*enc.encode_column(part.column(1)), end_id)
                for doc_id, a, b in zip(part.column(0).to_pylist(), bounds, bounds[1:]):
                    for row in shard.add(doc_id, ids[a:b]):
                        yield pa.RecordBatch.from_pylist([row], schema=arrow_schema)
        if shard.docs or shard.ids:
            yield pa.RecordBatch.from_pylist([shard.flush()], schema=arrow_schema)

    in_small_batches(ordered).mapInArrow(run, CHUNK_SCHEMA).write.option("compression", "none").parquet(path)


def _pieces(chunks: DataFrame, whole: bool) -> DataFrame:
    """The documents that lie whole in one chunk, or else the parts of those that do not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("shard", "chunk", "first", "n_ids", "kind", "sizes")}
                docs = batch.column("docs")[i].values
                start, n = docs.field("start").to_numpy(), docs.field("n").to_numpy()
                lo, hi = row["first"], row["first"] + row["n_ids"]
                pick = ((start >= lo) & (start + n <= hi)) == whole
                if not pick.any():
                    continue
                payload = memoryview(batch.column("payload")[i].as_buffer())
                ends = np.cumsum([0, *row["sizes"]])
                planes = [unpack(payload[a:b]) for a, b in zip(ends, ends[1:])]
                size = np.minimum(start + n, hi) - np.maximum(start, lo)  # documents follow each other without a gap
                at = np.r_[0, np.cumsum(size)]
                # runs of neighbouring documents: the whole ones are one, those cut lie at the ends
                edge = np.flatnonzero(np.diff(np.r_[0, pick.astype(np.int8), 0])).reshape(-1, 2)
                ids = np.concatenate([part_of(planes, at[a], at[b], row["n_ids"], row["kind"]) for a, b in edge])
                parts = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size[pick])], pa.int32()), pa.array(ids.view(np.int32), pa.int32()))
                chosen = docs.filter(pa.array(pick))
                cols = [pa.array(np.full(len(chosen), row["shard"]), pa.int32()), *(chosen.field(k) for k in ("seq", "doc_id", "start", "n")), pa.array(np.full(len(chosen), row["chunk"]), pa.int32()), parts]
                yield pa.RecordBatch.from_arrays(cols, names=["shard", "seq", "doc_id", "start", "n", "chunk", "ids"])

    return chunks.mapInArrow(run, PIECE_SCHEMA)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of every document of a data set.

    Only documents cut by a chunk's end are put together by a shuffle. Shard totals, a row a shard, give
    each shard's place in the whole. Documents without ids are there with none; null and repeated doc_ids come back as they
    were written; an empty data set gives no rows.
    """
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    whole = _pieces(chunks, True).select("shard", "doc_id", "start", "n", "ids")
    cut = _pieces(chunks, False).groupBy("shard", "seq").agg(
        F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.first("n").alias("n"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda p: p["ids"])).alias("ids"),
    ).drop("seq")
    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    docs = whole.unionByName(cut).join(F.broadcast(offsets), "shard")
    return docs.select("doc_id", (F.col("before") + F.col("start")).alias("start"), F.col("n").alias("n_tokens"), "ids")


def id_crc32(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, the CRC-32 of the ids as little-endian unsigned 32-bit integers (0 for none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat, offs = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[offs[i] : offs[i + 1]].tobytes()) for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return docs.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
