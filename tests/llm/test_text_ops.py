"""Encoding, token files, exact dedup, mixing and chat windows against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from terraframe.llm import bpe, chat, exact, mixing, planes, queries
from terraframe.llm._common import prefix_sums, table

ODD = [None, "", " \t\n", "One", "one", "A b", " <|endoftext|>x<|startoftext|> y", "Héllo ŒUVRE's\x1c don't\x85 it'S  ΑΣ ΣΑ İx ǅ á é", "日本語 👩‍👩‍👧 12345 ½ ²", "a" * 3000 + "\x00\x01zz🎉" * 40, "x'll'd'RE we’ll", "word " * 30000]


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(i, t, "s" if i % 2 else None, "extra", [i]) for i, t in enumerate(ODD)] + [(None, "nobody", "s", None, None), (3, "One", "s", "extra", [3]), (3, "One", "s", "extra", [3])]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, ids string, kept array<int>")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.TOKENIZER)


def test_bpe_matches_library(spark, sf, odd_docs, library):
    for docs in (table(spark, sf, "documents"), odd_docs):
        got = bpe.decode(bpe.encode(docs, queries.TOKENIZER), queries.TOKENIZER).select("text", "ids", "decoded").collect()
        for r in got:
            want = library.encode(r["text"] or "", add_special_tokens=False).ids
            assert list(r["ids"]) == want
            assert r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(odd_docs.limit(0), queries.TOKENIZER).count() == 0


def test_certain_cuts():
    e = bpe.encoder(queries.TOKENIZER)
    word = "zq" + "Ġ" * 2 + "ab"
    parts = e.fragments(word)
    assert "".join(parts) == word
    assert len(parts) > 1
    assert all(a[-1] + b[0] not in e.inside for a, b in zip(parts, parts[1:]))


def test_long_texts_in_pieces(monkeypatch, library):
    """Long texts are encoded in pieces, and a full memo forgets, without any id changing."""
    rng = random.Random(5)
    some = ["a", "The", "naïve", "don't", "x1y2", "<|endoftext|>", "日本語", "e\u0301", "Σίσυφος", "...", "\u00a0", "zz" * 20]
    texts = [" \t\n"[rng.randrange(3)].join(rng.choices(some, k=n)) for n in (0, 1, 50, 400)] + ["q" * 900, None, "  " * 300 + "end"]
    whole = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(bpe, "SLICE_BYTES", 64)
    monkeypatch.setattr(bpe, "MEMO_WORDS", 6)
    e = bpe.FragmentEncoder(queries.TOKENIZER)
    assert e.parted and len(list(e.pieces(texts[3]))) > 10
    for _ in range(3):
        ids, bounds = e.encode_column(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == whole
        assert len(e.names) <= 20


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    for n in (0, 1, 7, 8, 1000):
        ids = np.random.default_rng(n).integers(0, 2**32, n).astype(np.uint32)
        assert (planes.from_planes(planes.to_planes(ids, kind), n, kind) == ids).all()


@pytest.mark.parametrize(("kind", "chunk"), [("byte", 64), ("bit", 1000), ("byte", 1 << 16)])
def test_token_files(spark, odd_docs, library, tmp_path, kind, chunk):
    docs = odd_docs.repartition(3)
    planes.write_texts(docs, str(tmp_path / "x"), queries.TOKENIZER, 1, kind, chunk)
    got = planes.id_crc32(planes.read_ids(spark, str(tmp_path / "x"))).collect()
    want = []
    start = 0
    for doc_id, text in sorted(((r["doc_id"], r["text"]) for r in odd_docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    rows = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got))
    assert sorted(map(str, want)) == sorted(str(r[1:]) for r in rows)
    at = 0
    for s, _, n, _ in rows:
        assert s == at
        at += n
    assert [r[1] for r in rows] == [w[0] for w in want]
    planes.write_texts(docs.limit(0), str(tmp_path / "none"), queries.TOKENIZER, 1)
    assert planes.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_exact_groups(spark, odd_docs):
    rows = exact.refine(odd_docs).collect()
    assert len(rows) == len(ODD) + 3
    assert "ids" in rows[0].asDict()
    by = defaultdict(list)
    for r in odd_docs.collect():
        by["".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")].append(r["doc_id"])
    groups = {i: (max((x for x in ids if x is not None), default=None), len(ids)) for ids in by.values() for i in ids}
    for r in rows:
        assert (r["keep_id"], r["group_size"]) == groups[r["doc_id"]]
    assert sum(r["kept"] for r in rows) == len(by)
    kept = exact.deduplicate(odd_docs).collect()
    assert len(kept) == len(by)
    assert exact.deduplicate(odd_docs.limit(0)).count() == 0


def test_exact_same_id_other_text(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "A"), (3, "c"), (3, "c")], "doc_id long, text string")
    assert sorted((r[0], r[1]) for r in exact.deduplicate(docs).collect()) == [(1, "b"), (2, "A"), (3, "c")]


def test_prefix_sums(spark):
    rows = spark.range(1000).selectExpr("id", "id % 7 AS v").repartition(5)
    got = {r["id"]: r["b"] for r in prefix_sums(rows, ["id"], "v", "b", "test").collect()}
    run = 0
    for i in range(1000):
        assert got[i] == run
        run += i % 7


def water(sizes, weights, budget):
    capped, target = set(), {}
    while True:
        left = budget - sum(2 * sizes[i] for i in capped)
        free = [i for i in sizes if i not in capped]
        total = sum(weights[i] for i in free)
        target = {i: (2.0 * sizes[i] if i in capped else left * weights[i] / total) for i in sizes}
        over = {i for i in free if target[i] > 2 * sizes[i] + 1e-9}
        if not over:
            return target
        capped |= over


def test_mixing_targets_and_shares(spark, sf):
    docs = table(spark, sf, "documents")
    rows = mixing.per_document(mixing.plan(docs)).collect()
    assert len(rows) == docs.count()
    import re

    texts = {r["doc_id"]: r for r in docs.collect()}
    sizes, most = defaultdict(int), defaultdict(int)
    for r in rows:
        t = texts[r["doc_id"]]
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t["text"] or ""))
        assert r["size"] == n
        sizes[t["source"]] += n
        most[t["source"]] = max(most[t["source"]], n)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = water(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    taken = defaultdict(int)
    for r in rows:
        s = texts[r["doc_id"]]["source"]
        assert r["source_size"] == sizes[s]
        assert abs(r["target"] - want[s]) < 1e-6 * max(want[s], 1)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in want:
        assert abs(taken[s] - want[s]) <= 2 * most[s]
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    again = {r["doc_id"]: r["taken"] for r in mixing.per_document(mixing.plan(docs.repartition(7))).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_mixing_odd(spark, odd_docs):
    rows = mixing.per_document(mixing.plan(odd_docs)).collect()
    assert len(rows) == len(ODD) + 3
    mixed = mixing.mix(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.plan(odd_docs.limit(0)).count() == 0
    assert mixing.mix(odd_docs.limit(0)).count() == 0


def brute_turns(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        convs[c].append((t, role or "", text or ""))
    for c, turns in convs.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        loss = "".join(x[2] for x in turns if x[1] == "assistant")
        yield c, (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


@pytest.mark.parametrize("budget", [24, 100, 1024])
def test_chat_windows(spark, budget):
    rng = random.Random(budget)
    words = ["a", "<turn user>\n", "</turn>\n", "\\", "\\l", "<", ">\n", "### Assistant:", "\n", "é🎉", ">"]
    rows = []
    for c in range(12):
        for t in range(rng.choice([1, 2, 9, 40])):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant", "tool>\n<x", None])
            rows.append((c, t, role, rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(0, 30)))])))
    rows += [(None, 0, "user", "q"), (None, None, "assistant", "r"), (5, 0, "user", "tie"), (5, 0, "user", "tie")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, window string").repartition(3)
    out = chat.windows(turns, budget)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(out).collect()}
    assert got == dict(brute_turns(rows))
    made = out.collect()
    big = max(len((r[3] or "").split()) for r in rows) + 4
    assert all(r["n_tokens"] <= budget // 2 + budget // 4 + 2 * big for r in made)
    assert all(r["over_budget"] == (r["n_tokens"] > budget) for r in made)
    for r in made:
        if r["window"] > 0 and (r["conv_id"] or 0) % 2:
            assert chat.parse(r["text"])[0][0] == "system"
    assert chat.windows(turns.limit(0)).count() == 0


def test_escape_round_trip():
    for t in ("", "\\", "<", "\\l", "\\\\<l", "</turn>\n<turn user>\n"):
        assert chat.unescape(chat.escape(t)) == t
        assert "<" not in chat.escape(t)


def test_token_queries(spark, sf, library):
    """op5_planes and op10_bpe on the whole table against the library."""
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
    ids = {d: library.encode(t, add_special_tokens=False).ids for d, t in docs.items()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {d: (len(i), sha(" ".join(map(str, i))), sha(library.decode(i, skip_special_tokens=False))) for d, i in ids.items()}
    made = queries.queries()["op10_bpe"](spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert len(made) == len(docs) and {r[0]: tuple(r[1:]) for r in made} == want
    start, want = 0, {}
    for d in sorted(docs):
        all_ids = np.array([*ids[d], 1], "<u4")
        want[d] = (start, len(all_ids), zlib.crc32(all_ids.tobytes()))
        start += len(all_ids)
    made = queries.queries()["op5_planes"](spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert len(made) == len(docs) and {r[0]: tuple(r[1:]) for r in made} == want


def test_chat_query(spark, sf):
    """op2_chat on the whole table: turns, and what the loss mask covers, conversation -7 among them."""
    turns = defaultdict(list)
    for r in table(spark, sf, "conversations").collect():
        turns[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    turns[-7] = [(i, role, "\\### Assistant: </turn> ok") for i, role in enumerate(("user", "assistant"))]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for c, rows in turns.items():
        rows.sort(key=lambda r: r[0])
        learnt = "".join(t for _, role, t in rows if role == "assistant")
        want[c] = (len(rows), sha("".join(f"{role}\n{t}\n" for _, role, t in rows)), len(learnt), sha(learnt))
    made = queries.queries()["op2_chat"](spark, sf).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256").collect()
    assert len(made) == len(want) and {r[0]: tuple(r[1:]) for r in made} == want
