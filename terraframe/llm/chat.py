"""Chat formatting in budgeted windows.

A turn is written `<turn ROLE>` line feed TEXT `</turn>` line feed. Inside role and text a backslash becomes two and `<`
becomes backslash and `l`, and in a role `>` becomes backslash and `g`, so no control string can occur
there and the way back is exact. Prefix sums of turn tokens lay a conversation on a line; the line is cut every `stride` tokens, and a turn belongs to the cut it starts in, so windows
hold whole turns. A window repeats the system turn and the last turns before it, up to `history` tokens;
what is repeated carries no loss, so every assistant text is a target exactly once.

The running sum is over range partitions and windows are bounded groups, so a conversation of any length
spreads over tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraframe.llm._common import in_small_batches, prefix_sums, word_count, written

#: Tokens a window may hold; half of them start new turns, a quarter may be history, and the rest is for
#: the system turn and a last turn that runs over the cut. A longer turn makes a window of its own length.
BUDGET = 1024
OPEN, SHUT = "<turn ", "</turn>\n"
WINDOW_SCHEMA = "conv_id long, window long, n_repeated int, text string, loss_spans array<struct<start:int,end:int>>, n_tokens long, over_budget boolean"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"l": "<", "g": ">"}.get(m[1], m[1]), text, flags=re.DOTALL)


def count_tokens(text: Column) -> Column:
    """Tokens of a turn, as the budget counts them: its words and four for the marks."""
    return word_count(text) + 4


def windows(turns: DataFrame, budget: int = BUDGET, tokens=count_tokens) -> DataFrame:
    """The windows of all conversations: conv_id, window, n_repeated, text, loss_spans, n_tokens, over_budget.

    turns has conv_id, turn, role, text; other columns are ignored. A null text or role counts as empty.
    Turns go by turn (null first), ties by role and text; rows repeated in full are turns of their own, in
    a row. The first turn is retained in every window if its role is system. loss_spans are the code
    points of text under the loss mask. An empty table has no windows.
    """
    stride, history = budget // 2, budget // 4
    plain = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    summed = prefix_sums(plain.withColumn("n", tokens(F.col("text"))), order, "n", "_before", "turns")
    conv = summed.groupBy("conv_id").agg(F.min("_before").alias("_start"), F.sum("n").alias("_total"))
    starts = written(conv, "conversations").withColumnRenamed("conv_id", "_conv")
    placed = summed.join(starts, summed["conv_id"].eqNullSafe(starts["_conv"])).drop("_conv").withColumn("at", F.col("_before") - F.col("_start"))
    cut = placed.withColumn("window", F.floor(F.col("at") / stride))
    end = F.max(F.col("at") + F.col("n")).over(Window.partitionBy("conv_id", "window"))
    ended = cut.withColumn("end", end)
    system = (F.col("at") == 0) & (F.col("role") == "system")
    follows = (F.col("end") < F.col("_total")) & (F.col("end") - F.col("at") <= history) & ~system
    own = F.struct(F.col("window"), F.lit(False).alias("again"))
    repeated = F.struct(F.floor(F.col("end") / stride).alias("window"), F.lit(True).alias("again"))
    dealt = ended.withColumn("_at", F.explode(F.when(follows, F.array(own, repeated)).otherwise(F.array(own))))
    turn = F.struct(F.col("_before").alias("at"), F.col("turn"), F.col("role"), F.col("text"), F.col("n"), F.col("_at.again").alias("again"))
    gathered = written(dealt.groupBy("conv_id", F.col("_at.window").alias("window")).agg(F.array_sort(F.collect_list(turn)).alias("turns")), "windows")
    opening = written(ended.filter(system).select(F.col("conv_id").alias("_conv"), F.struct(F.lit(-1).cast("long").alias("at"), "turn", "role", "text", "n", F.lit(True).alias("again")).alias("opening")), "system-turns")
    later = gathered.filter("window > 0").join(opening, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    first = gathered.filter("window = 0").withColumn("opening", F.lit(None).cast(opening.schema["opening"].dataType))
    whole = first.unionByName(later).select("conv_id", "window", F.concat(F.when(F.col("opening").isNull(), F.array().cast(gathered.schema["turns"].dataType)).otherwise(F.array("opening")), "turns").alias("turns"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for conv_id, window, listed in frame.itertuples(index=False):
                text, spans, size, used, n_repeated = [], [], 0, 0, 0
                for t in listed:
                    head, body = f"{OPEN}{escape(t['role']).replace('>', chr(92) + 'g')}>\n", escape(t["text"])
                    if t["role"] == "assistant" and not t["again"] and body:
                        spans.append({"start": size + len(head), "end": size + len(head) + len(body)})
                    text += (head, body, SHUT)
                    size += len(head) + len(body) + len(SHUT)
                    used += t["n"]
                    n_repeated += t["again"]
                rows.append((conv_id, window, n_repeated, "".join(text), spans, used, used > budget))
            out = pd.DataFrame(rows, columns=["conv_id", "window", "n_repeated", "text", "loss_spans", "n_tokens", "over_budget"])
            yield out.astype({"conv_id": "Int64"})

    return in_small_batches(whole).mapInPandas(run, WINDOW_SCHEMA)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a window."""
    return [(unescape(role), unescape(body)) for role, body in re.findall(r"<turn ([^<>]*)>\n([^<]*)</turn>\n", text)]


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest needs a conversation's text in order; the windows stream past, sorted, and only the hash
    states and one window are held. Null conv_ids are one conversation; empty texts are turns of no characters; an empty
    table gives no rows.
    """
    ordered = formatted.select("conv_id", "window", "n_repeated", "text", "loss_spans").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: list | None = None

        def done(s: list) -> tuple:
            return (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])

        for frame in frames:
            rows = []
            for conv_id, _, n_repeated, text, spans in frame.itertuples(index=False):
                conv_id = None if pd.isna(conv_id) else int(conv_id)
                if now is None or now[0] != conv_id:
                    if now is not None:
                        rows.append(done(now))
                    now = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parse(text)[n_repeated:]:
                    now[1] += 1
                    now[2].update(f"{role}\n{body}\n".encode())
                for span in spans:
                    target = unescape(text[span["start"] : span["end"]])
                    now[3] += len(target)
                    now[4].update(target.encode())
                now[5] += len(text)
            yield pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})
        if now is not None:
            yield pd.DataFrame([done(now)], columns=names).astype({"conv_id": "Int64"})

    return ordered.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
