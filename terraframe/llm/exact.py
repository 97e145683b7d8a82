"""Exact deduplication by progressive refinement, in DataFrame operations alone.

Texts are equal when identical after lower-casing A-Z. Rows group by byte length, then by the hash of a
prefix, then by the hash of the whole text; each step only looks at what the step before left in groups of
two or more, so most texts are never hashed whole. The keys that survive the prefix step are kept as a
bitmap of fixed size: a key that falls on another's bit is hashed once too often,
nothing else. No text is ever shuffled; groups, however large, are pre-aggregated to one row a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraframe.llm._common import ascii_lower, bitmap, less, marked, without, written

PREFIX_CHARS = 256
MADE = ("keep_id", "group_size", "kept", "full_hash")


def refine(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Every row of docs with keep_id, group_size and kept, and full_hash where a whole text had to be hashed.

    carry names the columns to return beside doc_id (default: all but text). A null text counts as empty.
    The row with the largest doc_id of a group stays (null doc_ids count as the smallest); among rows that
    repeat that doc_id and text one stays, whichever, as they are alike in both. Texts of any length are hashed
    whole; an empty table stays empty; input columns with the names of results are replaced, all others pass.
    """
    docs = without(docs, *MADE)
    carry = [c for c in docs.columns if c.lower() not in ("doc_id", "text")] if carry is None else [c for c in carry if c.lower() != "doc_id"]
    norm = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    # what is carried travels as one column, so no name of it can meet one made here
    keyed = docs.select("doc_id", (F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None)).alias("_carry"), norm.alias("_norm")).withColumns({
        "_len": F.octet_length("_norm"), "_prefix": F.xxhash64(F.left(F.col("_norm"), F.lit(PREFIX_CHARS))),
    })

    pairs = keyed.groupBy("_len", "_prefix").agg(F.count("*").alias("n"))
    lengths = pairs.groupBy("_len").agg(F.sum("n").alias("n")).filter("n > 1").select("_len")
    shared = pairs.filter("n > 1").join(lengths, "_len", "left_semi")
    tested = marked(keyed, bitmap(shared, "_len", "_prefix"), "_len", "_prefix")
    hashed = written(tested.select("doc_id", "_carry", "_len", "_prefix", F.when(F.col("_marked"), F.sha2("_norm", 256)).alias("full_hash")), "hashed")

    by_id = hashed.filter("full_hash IS NOT NULL").groupBy("_len", "_prefix", "full_hash", "doc_id").agg(F.count("*").alias("n"))
    groups = by_id.groupBy("_len", "_prefix", "full_hash").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"), F.max(F.struct(F.col("doc_id"), F.col("n")))["n"].alias("_top"))
    several = groups.filter("group_size > 1")
    key = ["_len", "_prefix", "full_hash"]
    # a key without a whole hash is alone, and has its own length and prefix to be dealt by
    cols = ["doc_id", *[F.col(f"_carry.`{c}`") for c in carry], "keep_id", "group_size", "kept", "full_hash"]
    is_top = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    joined = hashed.join(several, key, "left").withColumn("_alone", F.col("group_size").isNull())
    once = joined.filter(F.col("_alone") | ~is_top | (F.col("_top") == 1)).withColumns({
        "kept": F.col("_alone") | is_top,
        "keep_id": F.when(F.col("_alone"), F.col("doc_id")).otherwise(F.col("keep_id")),
        "group_size": F.coalesce("group_size", F.lit(1)),
    })
    first = F.row_number().over(Window.partitionBy(*key, "doc_id").orderBy(F.lit(1)))
    again = hashed.join(several.filter("_top > 1"), key).filter(is_top).withColumn("kept", first == 1)
    return once.select(cols).unionByName(again.select(cols))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their columns; see refine(). Only the dropped ids are shuffled against texts.

    Rows that repeat both doc_id and text leave one; distinct texts all stay, even under one doc_id. Null texts count as
    empty, null doc_ids as the smallest; other columns pass, whatever their names; an empty table stays empty.
    """
    columns = docs.columns
    docs = docs.select("doc_id", "text", F.struct("*").alias("_row"))
    return _stay(docs).select("_row.*").select(*[F.col(f"`{c}`") for c in columns])


def _stay(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, _row) that stay."""
    decided = written(refine(docs.select("doc_id", "text"), []), "exact")
    gone = decided.filter("NOT kept AND NOT (doc_id <=> keep_id)").select(F.col("doc_id").alias("_gone")).distinct()
    # a doc_id may stand for several texts, one of which stays: such ids are told apart by text, not by id alone
    twice = decided.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("_twice"))
    single_gone = gone.join(twice, gone["_gone"].eqNullSafe(twice["_twice"]), "left_anti")
    kept = less(docs, written(single_gone, "gone"))
    rare = written(twice, "repeated-ids")
    if rare.isEmpty():
        return kept
    plain = kept.join(rare, kept["doc_id"].eqNullSafe(rare["_twice"]), "left_anti")
    again = docs.join(rare, docs["doc_id"].eqNullSafe(rare["_twice"]), "left_semi").withColumn("_norm", ascii_lower(F.coalesce(F.col("text"), F.lit(""))))
    told = refine(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("_sha", F.sha2(ascii_lower(F.col("text")), 256)), ["_sha"])
    stay = told.filter("kept").select(F.col("doc_id").alias("_id"), F.col("_sha").alias("_text_sha"))
    one = again.withColumn("_sha", F.sha2("_norm", 256)).dropDuplicates(["doc_id", "_sha"])
    return plain.unionByName(one.join(stay, one["doc_id"].eqNullSafe(stay["_id"]) & (one["_sha"] == stay["_text_sha"]), "left_semi").select(docs.columns))
