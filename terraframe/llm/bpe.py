"""BPE encoding and decoding by forced-boundary splitting.

No merge can join two neighbouring bytes that stand side by side inside no token of the vocabulary, so
such a pair is a certain cut: the pieces on either side encode independently, and their ids joined are
the ids of the whole. White space is in no token either (the normaliser drops it), so a text falls
at white space first, then into words by the tokenizer's own normaliser and word pattern, words fall into fragments
at the certain cuts, and fragments go through BPE one by one. The words of a corpus repeat: each worker numbers
them in a bounded memo, new ones are encoded many at a time, and the ids of all words of a slice are gathered in one step.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraframe.llm._common import in_small_batches, without

#: The normaliser's \s: the Unicode White_Space property.
SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
#: Anything but printable Latin letters, signs and plain white space, all of which are their own canonical
#: composition and lower-case one by one within the same range.
NOT_PLAIN = re.compile("[^\\t-\\r\\x20-\\x7e\\xa0-\\u012f\\u0131-\\u0239]")
#: A memo that reaches MEMO_WORDS or MEMO_IDS starts afresh with the half of its words that came up most, but for those over MEMO_CHARS.
#: A slice ends at SLICE_BYTES of text; a longer text is a slice of its own, and encoded in pieces of about as many characters.
MEMO_WORDS, MEMO_IDS, MEMO_CHARS, SLICE_ROWS, SLICE_BYTES = 300_000, 1 << 22, 64, 500, 1 << 20
#: The byte-level alphabet ends before; pairs of its characters stand in a table.
ALPHABET = 512


class FragmentEncoder:
    """Encodes with one tokenizer file; for use inside a worker."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        whole = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = whole.normalizer, whole.pre_tokenizer
        model = spec["model"]
        vocab, merges = model["vocab"], [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        suffix = model.get("end_of_word_suffix") or ""
        last, inner = BPE(vocab, merges, end_of_word_suffix=suffix or None, cache_capacity=0), BPE(vocab, merges, cache_capacity=0)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.added = added
        self.added_re = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        plain = (t[: len(t) - len(suffix)] if suffix and t.endswith(suffix) else t for t in vocab if t not in added)
        self.closing = None
        if suffix:
            self.closing = np.zeros(1 + max(vocab.values()), bool)
            self.closing[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.inside = {t[i : i + 2] for t in plain for i in range(len(t) - 1)}
        self.pairs = np.zeros((ALPHABET, ALPHABET), bool)
        for a, b in ((ord(p[0]), ord(p[1])) for p in self.inside):
            if a < ALPHABET and b < ALPHABET:
                self.pairs[a, b] = True
        self._start()
        self.words_re = self._words_re(spec)
        self.parted = self.words_re is not None and not any(SPACE.search(t) for t in added)
        self.byte_chars = {c: self._shown(chr(c)) for c in range(0xA0, 0x250)}
        self.last, self.inner = self._by_spaces(last), self._by_spaces(inner)

    @staticmethod
    def _by_spaces(model):
        """BPE over a line of fragments: the byte-level alphabet has no white space, so spaces part them."""
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        line = Tokenizer(model)
        line.pre_tokenizer = WhitespaceSplit()
        return line

    @staticmethod
    def _shown(char: str) -> str:
        """A character as the byte-level alphabet writes it."""
        from tokenizers.pre_tokenizers import ByteLevel

        return ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(char)[0][0]

    @staticmethod
    def _words_re(spec: dict):
        """The word pattern for plain text, if normaliser and pre-tokenizer have the form that words() can follow; else None.

        Its letter and number classes are written out for the range of plain text.
        """
        steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if steps != ["NFC", "Replace", "Lowercase"] or [x.get("type") for x in pre] != ["Split", "ByteLevel"]:
            return None
        split = pre[0]
        if split["behavior"] != "Removed" or not split["invert"]:
            return None
        group = lambda kind: "".join(re.escape(c) for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == kind)
        parts, letters = split["pattern"]["Regex"].split("|"), r"[\p{L}]+"
        if letters in parts and all(p.startswith("'") for p in parts[: parts.index(letters)]):  # these start with no letter, so letters may be tried first
            parts = [letters, *[p for p in parts if p != letters]]
        return re.compile("|".join(parts).replace(r"\p{L}", group("L")).replace(r"\p{N}", group("N")))

    def fragments(self, word: str) -> list[str]:
        """The pieces of a word between certain cuts."""
        if self.inside.issuperset(map(add, word, word[1:])):
            return [word]
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.inside]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens: those of plain text as they are, others in the byte-level alphabet behind a zero unless ASCII."""
        if self.words_re is not None and not NOT_PLAIN.search(text):
            return self.words_re.findall(text.lower())
        out: list[str] = []
        for chunk in [text] if self.words_re is None else SPACE.split(text):
            if self.words_re is None or NOT_PLAIN.search(chunk):
                out += [w if w.isascii() else "\0" + w for w, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(chunk))]
            elif chunk:
                out += self.words_re.findall(chunk.lower())
        return out

    def shown(self, word: str) -> str:
        """A word in the byte-level alphabet."""
        if word.isascii():
            return word
        return word[1:] if word[0] == "\0" else word.translate(self.byte_chars)

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some words, end to end, and how many each has: the last fragments of all words in one call, those before certain cuts in another."""
        words = list(map(self.shown, words))
        line = "\n".join(words)
        codes = np.frombuffer(line.encode("utf-32-le"), np.uint32)
        mark, known = codes == 10, codes < ALPHABET
        low = np.where(known, codes, 0)
        uncut = self.pairs[low[:-1], low[1:]] & known[:-1] & known[1:]
        starts = np.r_[0, np.flatnonzero(mark) + 1]
        ends = np.r_[starts[1:] - 1, len(codes)]
        cut = np.r_[~uncut & ~mark[:-1] & ~mark[1:], False]
        for k in np.flatnonzero(np.logical_or.reduceat(~known, starts)).tolist():  # characters beyond the table: by the pairs themselves
            cut[starts[k] : ends[k]] = False
            cut[starts[k] - 1 + np.cumsum([len(f) for f in self.fragments(words[k])])[:-1]] = True
        cuts = np.flatnonzero(cut)  # a head, a fragment before a cut, ends at each
        of = np.searchsorted(starts, cuts, "right") - 1
        tail_at = starts.copy()
        tail_at[of] = cuts + 1  # the last cut of a word stays
        step = np.zeros(len(codes), np.int8)
        step[tail_at] += 1
        step[starts[1:]] -= 1
        tail = np.cumsum(step, dtype=np.int8) == 1
        ids, size = self._ids(self.last, codes[tail], len(words))
        if not len(cuts):
            return ids, size
        heads = np.insert(codes[~tail], np.cumsum(~tail)[cuts], 32)
        more, sizes = self._ids(self.inner, heads, len(cuts))
        # heads and tails fall into the order of their words
        order = np.r_[of + np.arange(len(cuts)), np.arange(len(words)) + np.searchsorted(of, np.arange(len(words)), "right")]
        each, place = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        held = np.r_[sizes, size]
        each[order], place[order] = held, np.cumsum(held) - held
        at = np.cumsum(each) - each
        ids = np.concatenate([more, ids])[np.repeat(place - at, each) + np.arange(len(more) + len(ids))]
        return ids, size + np.bincount(of, weights=sizes, minlength=len(words)).astype(np.int64)

    def _ids(self, line, codes: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of count fragments, parted by white space and given as characters' codes, and how many each has."""
        text = codes.tobytes().decode("utf-32-le")
        if line is self.last and self.closing is not None:  # tokens that end a word tell where it ends, so nothing else need be tracked
            ids = np.array(line.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) == count:
                return ids, np.diff(ends, prepend=0)
        found = line.encode(text, add_special_tokens=False)
        return np.array(found.ids, np.int32), np.bincount(np.array(found.word_ids, np.int64), minlength=count)

    def _start(self) -> None:
        """An empty memo: number of each word, and place and length of its ids in the table."""
        self.memo, self.names = {}, []
        self.table, self.at, self.size, self.hits = np.empty(0, np.int32), *(np.empty(0, np.int64) for _ in range(3))

    def _forget(self) -> None:
        """Keeps the half of a full memo that came up most, and of it words that came up twice and aren't long."""
        self.memo = {}  # goes before its successor is made
        most = np.argsort(-self.hits, kind="stable")[: MEMO_WORDS // 2]
        kept = np.array([i for i in most[self.hits[most] > 1].tolist() if len(self.names[i]) <= MEMO_CHARS], np.int64)
        self.names = [self.names[i] for i in kept.tolist()]
        self.memo = dict(zip(self.names, range(len(kept))))
        size = self.size[kept]
        at = np.cumsum(size) - size
        self.table = self.table[np.repeat(self.at[kept] - at, size) + np.arange(size.sum())]
        self.at, self.size, self.hits = at, size, np.zeros(len(kept), np.int64)

    def _add(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        self.memo.update(zip(words, range(len(self.names), len(self.names) + len(words))))
        self.names += words
        self.at = np.r_[self.at, len(self.table) + np.cumsum(size) - size]
        self.size = np.r_[self.size, size]
        self.hits = np.r_[self.hits, np.zeros(len(size), np.int64)]
        self.table = np.r_[self.table, ids]

    def pieces(self, text: str) -> Iterator[str]:
        """A text cut at white space into pieces of some SLICE_BYTES characters, which encode independently; one piece where white space may be in a token."""
        lo = 0
        while self.parted and len(text) - lo > SLICE_BYTES and (gap := SPACE.search(text, lo + SLICE_BYTES)):
            yield text[lo : gap.start()]
            lo = gap.end()
        yield text[lo:]

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the whole texts of a column, end to end, and the bounds of each text's; none for a null text.

        A long text is taken piece by piece, so that its words are never all in memory at once.
        """
        texts = column.to_pylist()
        if not any(t is not None and len(t) > SLICE_BYTES for t in texts):
            return self._encode(texts)
        each = [np.concatenate([self._encode([piece])[0] for piece in self.pieces(t or "")]) for t in texts]
        return np.concatenate(each), np.r_[0, np.cumsum(list(map(len, each)))]

    def _encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        rows = []
        for text in texts:
            if self.added_re is not None and text and any(t in text for t in self.added):
                rows.append(list(chain.from_iterable([p] if p in self.added else self.words(p) for p in self.added_re.split(text))))
            else:
                rows.append(self.words(text) if text else [])
        flat = list(chain.from_iterable(rows))
        number = np.fromiter(map(self.memo.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(number < 0).tolist()
        if missing:
            new = list(dict.fromkeys(map(flat.__getitem__, missing)))
            plain = [w for w in new if w not in self.added]
            if plain:
                self._add(plain, *self.learn(plain))
            special = [w for w in new if w in self.added]
            self._add(special, np.array([self.added[w] for w in special], np.int32), np.ones(len(special), np.int64))
            number[missing] = [self.memo[flat[i]] for i in missing]
        size = self.size[number]
        stop = np.cumsum(size)
        ids = self.table[np.repeat(self.at[number] - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)]
        self.hits += np.bincount(number, minlength=len(self.hits))
        if len(self.names) > MEMO_WORDS or len(self.table) > MEMO_IDS:
            self._forget()
        return ids, np.r_[0, stop][np.r_[0, np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))]]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_column(pa.array([text], pa.string()))[0]


class Decoder:
    """Decodes with one tokenizer file: as the library does with special tokens kept; without a decoder, tokens joined by spaces."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = None
        if spec.get("decoder") is not None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(path)
        named = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec.get("added_tokens", [])}}
        tokens = [""] * (1 + max(named.values()))
        for t, i in named.items():
            tokens[i] = t
        self.tokens = pa.array(tokens, pa.string())

    def decode_lists(self, lists: pa.ListArray) -> pa.Array:
        """The text of each list of ids; an empty one for null."""
        flat, ends = lists.flatten(), np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())]
        if self.whole is None:
            return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.tokens.take(flat)), " ")
        ids = flat.to_pylist()
        return pa.array([self.whole.decode(ids[a:b], skip_special_tokens=False) for a, b in zip(ends, ends[1:])], pa.string())


@lru_cache(maxsize=2)
def encoder(path: str) -> FragmentEncoder:
    """One encoder a worker process and file."""
    return FragmentEncoder(path)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Cuts a column of strings or lists in runs of few rows and bytes or items."""
    lo, held = 0, 0
    length = pc.list_value_length if pa.types.is_list(column.type) else pc.binary_length
    for i, n in enumerate(pc.fill_null(length(column), 0).to_pylist()):
        if i > lo and (i - lo >= SLICE_ROWS or held + n > size):
            yield lo, i
            lo, held = i, 0
        held += n
    if len(column):
        yield lo, len(column)


def ended(ids: np.ndarray, bounds: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """ids and bounds with end_id after each text's ids, if given."""
    if end_id is None:
        return ids, bounds
    after = bounds + np.arange(len(bounds))
    out = np.full(after[-1], end_id, np.int32)
    inner = np.ones(len(out), bool)
    inner[after[1:] - 1] = False
    out[inner] = ids
    return out, after


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", end_id: int | None = None) -> DataFrame:
    """docs with ids_col, the token ids of the whole text (and end_id after them, if given).

    A null or empty text has no ids but the end id; a text of any length is taken whole. Every row stands alone: repeated
    rows, ties, null keys and empty tables need nothing special, an input column named ids_col is replaced, and the others pass.
    """
    return _encoded(docs, tokenizer_path, text_col, ids_col, end_id, None)


def encode_decode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encode() and decode() in one pass: docs with ids_col and out_col, so that ids need not come back to be decoded."""
    return _encoded(docs, tokenizer_path, text_col, ids_col, None, out_col)


def _encoded(docs: DataFrame, tokenizer_path: str, text_col: str, ids_col: str, end_id: int | None, out_col: str | None) -> DataFrame:
    made = [c for c in (ids_col, out_col) if c is not None]
    kept = without(docs, *[c for c in made if c.lower() != text_col.lower()])
    at = [c.lower() for c in kept.columns].index(text_col.lower())
    types = [T.ArrayType(T.IntegerType()), T.StringType()]
    schema = T.StructType([*kept.schema.fields, *[T.StructField(c, t) for c, t in zip(made, types)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            for lo, hi in slices(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                ids, bounds = ended(*enc.encode_column(part.column(at)), end_id)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                texts = [] if out_col is None else [decoder(tokenizer_path).decode_lists(lists)]
                yield pa.RecordBatch.from_arrays([*part.columns, lists, *texts], names=schema.names)

    return in_small_batches(kept).mapInArrow(run, schema)


def decode(rows: DataFrame, tokenizer_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """rows with out_col, the text of ids_col as the library decodes it; a null or empty list gives an empty text.

    Rows stand alone, so repeats, ties and empty tables need nothing; an input column named out_col is replaced, the others pass.
    """
    kept = without(rows, out_col)
    at = [c.lower() for c in kept.columns].index(ids_col.lower())
    schema = T.StructType([*kept.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = decoder(tokenizer_path)
        for batch in batches:
            for lo, hi in slices(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, dec.decode_lists(part.column(at))], names=schema.names)

    return in_small_batches(kept).mapInArrow(run, schema)


def digests(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_tokens and SHA-256 of the ids (decimal, joined by spaces) and of the decoded text; one row for each, no ids have the digest of nothing."""
    return rows.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
