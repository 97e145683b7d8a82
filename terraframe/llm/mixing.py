"""Mixing sources to target weights by weighted fair queueing.

Within its source every document comes up in a shuffled but fixed order, once and then once more. A copy's
virtual finish time is the number of the source's words up to its end, divided by the source's target. All
copies of all sources are range-sorted by that time, and the mix takes them until its budget is spent.
Both running sums are two-level prefix sums over range partitions, so no source, however large, meets in
one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraframe.llm._common import prefix_sums, word_count, written

WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source, source_rank, source_size, earlier (words of the sources before it), target and budget; one row a source.

    Sources in code-point order, null last, take the weights in turn. The budget, share x all words, is
    dealt by weight; none gets more than repeats x its size, and what it leaves goes to the others by weight.
    In the order of size per weight the sources that fill up come first; the level of the rest is what is
    left of the budget over the weights left, at the first source that the level does not fill.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    dealt = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")).select(
        "source", F.row_number().over(one).alias("source_rank"), "source_size",
    )
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("source_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    caps = dealt.withColumns({"w": weight, "cap": F.col("source_size") * F.lit(float(repeats))}).withColumn("ratio", F.col("cap") / F.col("w"))
    fill = Window.orderBy("ratio", "source_rank")
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    budget = F.sum("source_size").over(everything) * F.lit(share)
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing))
    levels = caps.withColumns({"k": F.row_number().over(fill), "level": level, "earlier": F.coalesce(F.sum("source_size").over(one.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    found = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("k", "level"))).over(everything)
    return levels.withColumn("found", found).select(
        "source", "source_rank", "source_size", "earlier",
        F.when(F.col("k") < F.col("found.k"), F.col("cap")).otherwise(F.col("w") * F.col("found.level")).alias("target"),
        F.floor(budget).alias("budget"),
    )


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = 0) -> DataFrame:
    """doc_id, source, size, rows, source_size, target, taken, copies and finish (times of the copies taken).

    size is the number of words of a text (null: 0). Rows that repeat doc_id, source and size are one unit
    of `rows` rows, taken together; all others are units of one. Documents without words, and sources
    without any, take nothing. An empty table gives an empty plan. The order within a source is the MD5 of
    seed and doc_id, so reruns agree.
    """
    units = docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    sized = written(units, "sized")
    sources = written(targets(sized, weights, share, repeats), "targets")
    right = sources.withColumnRenamed("source", "_source")
    known = sized.join(right, sized["source"].eqNullSafe(right["_source"])).drop("_source")
    shuffled = known.withColumns({"_key": F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "_words": F.col("size") * F.col("rows")})
    queued = prefix_sums(shuffled, ["source_rank", "_key", "doc_id", "size"], "_words", "_before", "queue")
    upto = F.col("_before") + F.col("_words") - F.col("earlier")
    copies = queued.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn(
        "_finish", F.when((F.col("target") > 0) & (F.col("_words") > 0), (upto + F.col("_copy") * F.col("source_size")) / F.col("target")).otherwise(F.lit(float("inf")))
    )
    served = prefix_sums(copies.drop("_before", "earlier"), ["_finish", "source_rank", "_key", "doc_id", "size"], "_words", "_served", "served")
    taken = served.withColumn("_in", (F.col("_finish") < float("inf")) & (F.col("_served") + F.col("_words") <= F.col("budget")))
    key = ["doc_id", "source", "size", "rows", "source_size", "target"]
    return taken.groupBy(*key).agg(F.sum(F.when(F.col("_in"), 1).otherwise(0)).alias("copies"), F.array_sort(F.collect_list(F.when(F.col("_in"), F.col("_finish")))).alias("finish")).withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as the mix takes them (each 0, 1, ... times) with docs' columns, range-sorted by virtual finish time.

    docs has doc_id, source and text; its other columns pass, whatever their names. Null texts, texts without words and
    sources without any words take no part; null sources are a source; rows that repeat doc_id, source and size are taken
    together; ties go by doc_id; an empty table stays empty.
    """
    row = F.struct("*").alias("_row")  # the columns travel as one, so no name of theirs can meet one made here
    base = docs.select(row, F.col("doc_id").alias("_doc"), F.col("source").alias("_from"), word_count(F.col("text")).alias("_size"))
    chosen = written(plan(docs.select("doc_id", "source", "text"), **options).filter("copies > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_words"), F.col("finish").alias("_times")), "mix")
    same = F.col("_doc").eqNullSafe(F.col("_id")) & F.col("_from").eqNullSafe(F.col("_source")) & (F.col("_size") == F.col("_words"))
    found = base.join(chosen, same).withColumn("_finish", F.explode("_times"))
    return found.repartitionByRange("_finish", "_id").sortWithinPartitions("_finish", "_id").select("_row.*")


def per_document(planned: DataFrame) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken."""
    each = planned.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return each.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
