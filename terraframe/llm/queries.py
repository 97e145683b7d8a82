"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.llm import bpe, chat, exact, hilbert_ann, html_paths, merkle, mixing, neardup, pigeonhole, pii, planes, quality, runs
from terraframe.llm._common import ascii_lower, new_path, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, repeated rows too. Null and empty texts are scored by their statistics alone, null n_chars as absent; without labels every score is 0.5; an empty table gives no rows."""
    scored = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a conversation and one for -7. Null texts and roles count as empty, null turns come first, ties go by role and text, repeated rows are turns of their own, a turn over the budget has a window of its own; an empty table gives -7 alone."""
    odd = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    return chat.digests(chat.windows(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, repeated rows too. Null and empty texts have no spans; long texts are read whole; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digests(pii.detect(docs, pii.fit(docs)).drop("text"))


def op4_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, repeated rows too. Null texts count as empty, null doc_ids as the smallest; of rows alike in id and text one is kept; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256))
    return exact.refine(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, repeated rows too, side by side. Null and empty texts have the end id alone; null doc_ids come first; an empty table gives no rows."""
    path = new_path(spark, "token-ids")
    planes.write_texts(table(spark, sf_dir, "documents"), path, TOKENIZER, END_ID)
    return planes.id_crc32(planes.read_ids(spark, path))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a page, repeated rows too. Null, empty and textless pages have an empty text; pages of any length and depth are read whole; an empty table gives no rows."""
    return html_paths.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, repeated rows too. Null, empty and wordless texts are linked with nothing; null doc_ids are never a component's name; an empty table gives no rows."""
    return neardup.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 20 rows a query. Null ids and null, zero, non-finite or oddly long vectors take no part; ties go to the smaller id; rows alike in id and vector count once; an empty table gives no rows."""
    return hilbert_ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, repeated rows too. Null texts have no words and take nothing, null sources are a source, null ids come first, repeated rows are taken together; an empty table gives no rows."""
    return mixing.per_document(mixing.plan(table(spark, sf_dir, "documents")))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, repeated rows too. Null and empty texts have no ids and an empty decoded text; long texts are taken whole; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode_decode(docs, TOKENIZER))


def op11_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a vector, repeated rows too, which are linked to each other. Null labels and null, zero or non-finite vectors are linked with nothing; null ids are never a component's name; an empty table gives no rows."""
    return pigeonhole.near_groups(table(spark, sf_dir, "embeddings"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, repeated rows too. Null, empty and wordless texts have no runs, and nothing is repeated under a null id; long texts are read whole; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", runs.repeated(F.col("text"), F.col("doc_id")).alias("text"))
    return runs.digests(runs.find(docs))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, repeated rows too, which are leaves of their own. Null fields are a dash in the leaf, null doc_ids come first and are never tampered with, a null lang is the first group; an empty table gives no rows."""
    return merkle.manifest(table(spark, sf_dir, "documents")).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_chat": op2_chat,
        "op3_pii": op3_pii,
        "op4_exact": op4_exact,
        "op5_planes": op5_planes,
        "op6_html": op6_html,
        "op7_neardup": op7_neardup,
        "op8_ann": op8_ann,
        "op9_mixing": op9_mixing,
        "op10_bpe": op10_bpe,
        "op11_pigeonhole": op11_pigeonhole,
        "op12_runs": op12_runs,
        "op13_merkle": op13_merkle,
    }


def manifest_sql(levels: int = 7, over: int = 3) -> str:
    """op13 in SQL: every level of the trees in a step of its own, for up to 8 ** levels leaves a lang and 8 ** over langs."""
    told = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(told(c if c != "text" else text) for c in merkle.FIELDS) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # the unsigned crc32 of the decimal id, a bit a step
    bits = "list_concat([4294967295::UBIGINT], flatten([[ascii(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0] for c in string_split(CAST(doc_id AS VARCHAR), '')]))"
    crc = f"xor(list_reduce({bits}, lambda a, x: xor(xor(a, x) >> 1, 3988292384::UBIGINT * (xor(a, x) & 1))), 4294967295::UBIGINT)"
    steps = [f"f AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS bad FROM documents)",
             "l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM f)",
             "a0 AS (SELECT lang AS g, k, n, leaf AS h FROM l)"]

    def tree(name: str, depth: int) -> None:
        for i in range(depth):
            side = lambda rows: f"coalesce(string_agg(h, '') OVER (PARTITION BY g, k // 8 ORDER BY k ROWS BETWEEN {rows}), '')"
            steps.append(f"{name}s{i} AS (SELECT g, k, n, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM {name}{i})")
            steps.append(f"{name}{i + 1} AS (SELECT g, k // 8 AS k, CASE WHEN any_value(n) > 1 THEN (any_value(n) + 7) // 8 ELSE 1 END AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY k)) ELSE any_value(h) END AS h FROM {name}{i} GROUP BY g, k // 8)")

    tree("a", levels)
    steps.append(f"b0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS k, count(*) OVER () AS n, h, g AS lang FROM a{levels})")
    tree("b", over)
    path = [(f"as{i}", f"as{i}.g IS NOT DISTINCT FROM l.lang AND as{i}.k = l.k // {8**i}") for i in range(levels)] + [("b0", "b0.lang IS NOT DISTINCT FROM l.lang")] + [(f"bs{i}", f"bs{i}.k = b0.k // {8**i}") for i in range(over)]
    fold = ["bad AS h0"] + [f"CASE WHEN {t}.n > 1 THEN sha256({t}.l || h{i} || {t}.r) ELSE h{i} END AS h{i + 1}" for i, t in enumerate(t for t, _ in path if t != "b0")]
    proof = " || ".join(f"{t}.l || {t}.r" for t, _ in path if t != "b0")
    joins = " ".join(f"JOIN {t} ON {on}" for t, on in path)
    return f"""WITH {", ".join(steps)}, w AS (SELECT doc_id, leaf, b0.h AS subroot, b{over}.h AS root, sha256({proof}) AS proof_sha256, {", ".join(fold)} FROM l {joins} CROSS JOIN b{over})
        SELECT doc_id, leaf, subroot, root, proof_sha256, h{levels + over} AS folded_root, h{levels + over} = root AS verified FROM w"""


ORACLE_SQL: dict[str, str] = {
    "op13_merkle": manifest_sql(),
    "op8_ann": """
        WITH v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op11_pigeonhole": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
        l AS (
            SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) >= 0.98),
        r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT l.w, r.c FROM r JOIN l ON r.vec_id = l.u),
        n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
        SELECT r.vec_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_links, min(r.c) AS component_id, r.vec_id = min(r.c) AS kept
        FROM r LEFT JOIN n ON n.u = r.vec_id GROUP BY r.vec_id
    """,
    "op4_exact": """
        WITH t AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY norm)
    """,
    "op9_mixing": r"""
        WITH t AS (
            SELECT doc_id, source, CAST(len([w for w in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if w <> '']) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, row_number() OVER (ORDER BY source NULLS LAST) AS rk, CAST(sum(size) AS BIGINT) AS ss FROM t GROUP BY source),
        c AS (SELECT *, CAST(CASE (rk - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w, CAST(2 AS DOUBLE) * ss AS cap FROM s),
        l AS (
            SELECT *, row_number() OVER o AS k, cap / w AS ratio, CAST(1.5 AS DOUBLE) * sum(ss) OVER () AS budget,
                   (CAST(1.5 AS DOUBLE) * sum(ss) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
                   coalesce(sum(ss) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
            FROM c WINDOW o AS (ORDER BY cap / w, rk)),
        f AS (SELECT min(k) AS k0, arg_min(level, k) AS lv FROM l WHERE level <= ratio),
        g AS (SELECT l.*, CASE WHEN k < k0 THEN cap ELSE w * lv END AS target FROM l, f),
        q AS (
            SELECT t.doc_id, t.source, size, rk, ss, target, budget, md5(concat('0:', t.doc_id)) AS h,
                   sum(size) OVER (ORDER BY rk, md5(concat('0:', t.doc_id)), t.doc_id ROWS UNBOUNDED PRECEDING) - earlier AS upto
            FROM t JOIN g ON t.source IS NOT DISTINCT FROM g.source),
        p AS (SELECT *, CASE WHEN target > 0 AND size > 0 THEN CAST(upto + n * ss AS DOUBLE) / target ELSE CAST('inf' AS DOUBLE) END AS finish FROM q, range(2) AS r(n)),
        v AS (SELECT *, sum(size) OVER (ORDER BY finish, rk, h, doc_id ROWS UNBOUNDED PRECEDING) AS served FROM p)
        SELECT doc_id, size, ss AS source_size, target, source, CAST(count(*) FILTER (finish < 'inf' AND served <= floor(budget)) AS BIGINT) AS copies,
               CAST(size * count(*) FILTER (finish < 'inf' AND served <= floor(budget)) AS BIGINT) AS taken
        FROM v GROUP BY doc_id, source, size, ss, target
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
