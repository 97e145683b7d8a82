"""A Merkle manifest of a table by bitmap ranks, in DataFrame operations alone.

The doc_ids of each group (lang) form a compressed bitmap: the 64-bit words that have a bit, gathered by bucket of 512
words with a directory of popcounts. The rank of an id - bits before its bucket, before its word, and below it in the word -
is its leaf's place, so the leaves themselves are never sorted. Places then key slot arrays of eight digests: a level
hashes every array into one slot of the next, until one digest a group is left; the groups' digests are reduced likewise.
Proofs run back down the same arrays: a node hands its path to the slots of its array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraframe.llm._common import ascii_lower, prefix_sums, written

WIDTH = 8
#: Bits of a word's and of a bucket's number within an id.
WORD_BITS, BUCKET_BITS = 6, 15
#: The word of null ids, before all others.
NULL_WORD = -(1 << 58)
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """`-` for null, else the length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf and, where it is another, the leaf of the row once tampered with; number tells rows apart."""
    told = [F.col("text") if f == "text" else F.col(f) for f in FIELDS]
    plain = digest(*[encoded(c) for c in told])
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    lower = ascii_lower(F.col("text"))
    changed = F.when(hit & (lower != F.col("text")), digest(*[encoded(lower if f == "text" else F.col(f)) for f in FIELDS]))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", plain.alias("leaf"), changed.alias("changed"), F.monotonically_increasing_id().alias("number"))


def _word(doc_id: Column) -> Column:
    return F.coalesce(F.shiftright(doc_id, WORD_BITS), F.lit(NULL_WORD))


def _bit(doc_id: Column) -> Column:
    return F.coalesce(doc_id.bitwiseAND(F.lit((1 << WORD_BITS) - 1).cast("long")), F.lit(0).cast("long")).cast("int")


def _shift(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def ranked(rows: DataFrame, group: str) -> DataFrame:
    """rows (group, doc_id, leaf, number, ...; written) with place: the number of rows of the group before it.

    Order: doc_id, nulls first, then leaf, then any. A word of the bitmap whose ids all stand for one row gives
    places by popcounts; the rows of other words, where an id repeats, are counted by a two-level range sort of these rows alone.
    """
    at = rows.withColumn("_word", _word(F.col("doc_id")))
    words = at.groupBy(group, "_word").agg(F.bit_or(_shift(_bit(F.col("doc_id")))).alias("bits"), F.count("*").alias("rows"))
    entry = F.struct(F.col("_word").alias("word"), F.col("bits"), F.col("rows"))
    bucket = F.shiftright("_word", BUCKET_BITS - WORD_BITS).alias("bucket")
    packed = written(words.groupBy(group, bucket).agg(F.array_sort(F.collect_list(entry)).alias("words"), F.sum("rows").alias("rows")), "bitmap-words")
    ordered = prefix_sums(packed.select(group, "bucket", "rows"), [group, "bucket"], "rows", "before", "bitmap-buckets")
    sizes = ordered.groupBy(F.col(group).alias("_s")).agg(F.min("before").alias("_start"))
    offsets = ordered.join(sizes.hint("merge"), F.col(group).eqNullSafe(F.col("_s"))).select(F.col(group).alias("_g"), F.col("bucket").alias("_b"), (F.col("before") - F.col("_start")).alias("offset"))
    # the directory of a bucket: rows before each of its words, 512 at most
    sums = F.aggregate("words", F.array(F.lit(0).cast("long")), lambda a, w: F.concat(a, F.array(F.element_at(a, -1) + w["rows"])))
    filed = packed.join(offsets.hint("merge"), F.col(group).eqNullSafe(F.col("_g")) & (F.col("bucket") == F.col("_b")))
    directory = filed.select(group, "offset", F.explode(F.arrays_zip("words", F.slice(sums, 1, 1 << (BUCKET_BITS - WORD_BITS)).alias("sums"))).alias("e"))
    looked = written(directory.select(F.col(group).alias("_g"), F.col("e.words.word").alias("_w"), F.col("e.words.bits").alias("bits"), (F.col("e.words.rows") > F.bit_count("e.words.bits")).alias("repeats"), (F.col("offset") + F.col("e.sums")).alias("base")), "bitmap-directory")
    met = at.join(looked.hint("merge"), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_word") == F.col("_w")))
    below = F.col("bits").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), _bit(F.col("doc_id")))))
    simple = met.filter("NOT repeats").select(*rows.columns, (F.col("base") + F.bit_count(below)).alias("place"))
    several = met.filter("repeats").select(*rows.columns, "_word", "base", F.lit(1).alias("_one"))
    counted = written(prefix_sums(several, [group, "_word", "doc_id", "leaf", "number"], "_one", "_at", "repeated-ids"), "repeated-places")
    first = counted.groupBy(group, "_word").agg(F.min("_at").alias("_first")).select(F.col(group).alias("_g"), F.col("_word").alias("_w"), "_first")
    again = counted.join(first.hint("merge"), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_word") == F.col("_w")))
    return simple.unionByName(again.select(*rows.columns, (F.col("base") + F.col("_at") - F.col("_first")).alias("place")))


def _slots(nodes: DataFrame, group: str) -> DataFrame:
    """nodes (group, place, digest, ...) in arrays of WIDTH slots: group, place of the array, slots (sorted), digest of the array."""
    up = nodes.groupBy(group, F.shiftright("place", 3).alias("_up")).agg(F.array_sort(F.collect_list(F.struct("place", *[c for c in nodes.columns if c not in (group, "place")]))).alias("slots"))
    return up.select(group, F.col("_up").alias("place"), "slots", F.sha2(F.concat_ws("", F.transform("slots", lambda s: s["digest"])), 256).alias("digest"))


def reduced(nodes: DataFrame, group: str) -> tuple[DataFrame, list[DataFrame]]:
    """The last digest of each group (group, digest, lone), and the levels of slot arrays below, the lowest first.

    A group is reduced until one array is left; lone tells that it has a single leaf, which is its digest itself. Only the
    first array of a group can be its last, so no other one is joined to what is known of the group.
    """
    tops, levels = None, []
    while True:
        level = written(_slots(nodes, group), f"slots-{len(levels)}")
        if levels and level.isEmpty():
            return tops, levels
        ends = level.groupBy(group).agg(F.max("place").alias("_last")).select(F.col(group).alias("_g"), "_last")
        first = level.filter("place = 0")
        first = written(first.join(ends.hint("merge"), F.col(group).eqNullSafe(F.col("_g"))).select(group, "place", "digest", "slots", "_last"), "first-slots")
        lone = F.lit(not levels) & (F.size("slots") == 1)
        done = first.filter("_last = 0").select(group, F.when(lone, F.element_at("slots", 1)["digest"]).otherwise(F.col("digest")).alias("digest"), lone.alias("lone"))
        tops = done if tops is None else tops.unionByName(done)
        levels.append(level)
        nodes = level.filter("place > 0").select(group, "place", "digest").unionByName(first.filter("_last > 0").select(group, "place", "digest"))


STEP = "struct<l:string,r:string>"


def _opened(slots: Column, path: Column) -> Column:
    """A path for each slot: the digests left and right of it in its array, then the path of the array."""
    digests = F.transform(slots, lambda s: s["digest"])
    return F.transform(slots, lambda s, i: F.struct(s.alias("slot"), F.concat(F.array(F.struct(
        F.concat_ws("", F.slice(digests, F.lit(1), i)).alias("l"), F.concat_ws("", F.slice(digests, i + 2, F.lit(WIDTH))).alias("r"))), path).alias("path")))


def paths(levels: list[DataFrame], tops: DataFrame, group: str, label: str) -> DataFrame:
    """group, slot (a leaf's struct), path and top of every leaf; tops (group, lone, above, top) has the path above each group's digest, and what to hand down."""
    above = tops.select(F.col(group).alias("_g"), F.lit(0).cast("long").alias("_p"), F.col("above").alias("path"), "top", "lone")
    down = above
    for depth, level in reversed(list(enumerate(levels))):
        met = level.join(down.hint("merge"), F.col(group).eqNullSafe(F.col("_g")) & (F.col("place") == F.col("_p")))
        # the single slot of a lone leaf is the group's digest itself
        opened = _opened(F.col("slots"), F.col("path"))
        stays = F.transform("slots", lambda s: F.struct(s.alias("slot"), F.col("path").alias("path")))
        each = met.select(group, "top", F.explode(F.when(F.col("lone"), stays).otherwise(opened)).alias("x")).select(group, "x.slot", "x.path", "top")
        if depth == 0:
            return each
        # an array below is a slot of this level, or the last one of its group
        ends = levels[depth - 1].groupBy(group).agg(F.max("place").alias("_last")).filter("_last = 0").select(F.col(group).alias("_r"))
        roots = above.join(ends.hint("merge"), F.col("_g").eqNullSafe(F.col("_r")), "left_semi")
        slots = each.select(F.col(group).alias("_g"), F.col("slot.place").alias("_p"), "path", "top", F.lit(False).alias("lone"))
        down = written(slots.unionByName(roots), f"{label}-{depth}")
    raise ValueError("there are no levels")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, lang, place, leaf, subroot, root, path (from the leaf up, siblings left and right), proof_sha256, folded_root and verified for every row of docs.

    docs has doc_id, source, lang, n_chars and text; other columns are ignored. Within a lang, null doc_ids come first and rows that
    repeat a doc_id go by their leaf; a null lang is a group, the first one. A proof without siblings is the hash of nothing. Tampering lower-cases
    A-Z of the texts of every third doc_id by hash, null ids aside; such a row is verified only if that leaves its text as it is. An empty table gives an empty result.
    """
    made = written(leaves(docs.select(*[F.col(f) for f in FIELDS])), "leaves")
    placed = written(ranked(made, "lang").select("lang", "place", F.col("leaf").alias("digest"), "doc_id", "changed"), "leaf-places")
    subroots, levels = reduced(placed, "lang")
    subroots = written(subroots, "subroots")
    numbered = prefix_sums(subroots.withColumn("_one", F.lit(1).cast("long")), ["lang"], "_one", "place", "subroot-places")
    root, upper = reduced(written(numbered.select(F.lit(0).alias("all"), "place", "digest", "lang", "lone"), "root-leaves"), "all")
    top = F.struct(F.col("digest").alias("root"))
    over = paths(upper, root.select("all", "lone", top.alias("top"), F.array().cast(f"array<{STEP}>").alias("above")), "all", "root-paths")
    top = F.struct(F.col("slot.digest").alias("subroot"), F.col("top.root").alias("root"))
    tops = written(over.select(F.col("slot.lang").alias("lang"), F.col("slot.lone").alias("lone"), F.col("path").alias("above"), top.alias("top")), "subroot-paths")
    under = paths(levels, tops, "lang", "leaf-paths")
    out = under.select("slot.doc_id", "lang", "slot.place", F.col("slot.digest").alias("leaf"), "slot.changed", "top.subroot", "top.root", "path")
    siblings = F.concat_ws("", F.transform("path", lambda s: F.concat(s["l"], s["r"])))
    fold = F.aggregate("path", F.coalesce("changed", "leaf"), lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]), 256))
    told = out.withColumn("proof_sha256", F.sha2(siblings, 256)).withColumn("folded_root", fold)
    return told.withColumn("verified", F.col("folded_root") == F.col("root")).drop("changed")
