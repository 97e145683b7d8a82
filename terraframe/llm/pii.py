"""Personal data: high-recall generators, boosted trees over format and context, calibrated thresholds.

Generators propose spans, which may overlap, for four kinds. The base rules (see base_spans) fix part of the answer.
Every other candidate, such as a number written the local way, an address with its at sign spelt out, or a number that
stands so close to another that the base rules miss it, is scored by gradient-boosted trees.

The trees learn from evidence that does not come from the base rules: into a bounded sample of the documents known
personal data is planted in many written forms (plant()), next to decoys such as dates, order numbers and versions; what was
planted is right, every other proposal of those texts is wrong. Per kind the threshold is the lowest score at which, on
planted documents kept for calibration, enough of the best proposals are right. A candidate over it is added unless it overlaps
a span already taken.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraframe.llm._common import in_small_batches, without, written

KINDS = ("email", "ip", "card", "phone")
#: Documents whose candidates are fitted, those with the smallest MD5 of the id, and the most candidates of these; a third of the documents calibrate.
#: A threshold is never under LEAST: plants are many more in the sample than personal data is in texts.
FIT_DOCS, FIT_ROWS, PRECISION, LEAST = 3_000, 60_000, 0.99, 0.5
TREES, DEPTH, BINS, RATE = 60, 4, 16, 0.2
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
HOST = re.compile(r"[A-Za-z0-9-]+")
CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+){3,}")
NUMBER = re.compile(r"[0-9]+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Numbers in a row, one sign between them, as cards and phones are written.
ROW = re.compile(r"[0-9]+(?:(?:[\x20./_-]|\)[\x20-]?|[\x20-]\()[0-9]+)*")
AT = re.compile(r"\s?(?:\[at\]|\(at\)|\[@\])\s?|\sat\s", re.IGNORECASE)
SPELT_HOST = re.compile(r"[A-Za-z0-9-]+(?:(?:\s?(?:\[dot\]|\(dot\)|\[\.\])\s?|\sdot\s|\.)[A-Za-z0-9-]+)+", re.IGNORECASE)
SPELT_IP = re.compile(r"[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\s?\[dot\]\s?|\s?\(dot\)\s?|\s\.\s)[0-9]{1,3}){3}", re.IGNORECASE)
ANY = re.compile(r"[0-9@]|\bat\b", re.IGNORECASE)
DATE = re.compile(r"(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}")
WORDS = {"email": ("mail", "contact", "write", "kontakt"), "ip": ("ip", "host", "server", "addr"), "card": ("card", "visa", "pay", "carte"), "phone": ("tel", "call", "phone", "fax")}
TOP_LEVEL = "com org net edu gov io co info de fr es it uk nl eu".split()


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the address rule, found from the at signs, so in linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1  # no match can run across this sign
        at = text.find("@", max(free, at + 1))
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Dotted chains of numbers, cut in fours from the left, good or not."""
    out = []
    for chain in CHAIN.finditer(text):
        numbers = list(NUMBER.finditer(text, chain.start(), chain.end()))
        out += [(numbers[i].start(), numbers[i + 3].end()) for i in range(0, len(numbers) - 3, 4)]
    return out


def good(kind: str, span: str) -> bool:
    """The check that a match of the base rule must pass."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in span.split("."))
    digits = "".join(NUMBER.findall(span))
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed rules, by kind and then start."""
    if not ANY.search(text):
        return []
    found = [("email", a, b) for a, b in emails(text)]
    found += [("ip", a, b) for a, b in addresses(text)]
    found += [("card", m.start(), m.end()) for m in DIGITS.finditer(text)]
    found += [("phone", m.start(), m.end()) for m in PLUS.finditer(text)] if "+" in text else []
    return [s for s in found if good(s[0], text[s[1] : s[2]])]


def _windows(text: str, run: re.Match, low: int, high: int) -> Iterator[tuple[int, int, int]]:
    """Runs of whole numbers of a row with low to high digits in all: start, end, how many numbers. A few a number."""
    numbers = [m.span() for m in NUMBER.finditer(text, run.start(), run.end())]
    for i in range(len(numbers)):
        digits = 0
        for j in range(i, len(numbers)):
            digits += numbers[j][1] - numbers[j][0]
            if digits > high:
                break
            if digits >= low:
                yield numbers[i][0], numbers[j][1], j - i + 1


def candidates(text: str) -> list[tuple[str, int, int]]:
    """All proposals of the generators, wider than the base rules; spans of a kind may overlap. Linear in the text."""
    if not ANY.search(text):
        return []
    out = {("ip", a, b) for a, b in addresses(text)} | {("ip", m.start(), m.end()) for m in SPELT_IP.finditer(text)}
    out |= {("email", a, b) for a, b in emails(text)}
    free = 0
    for m in AT.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        host = SPELT_HOST.match(text, m.end()) if start < m.start() else None
        free = m.end()
        if host:
            out.add(("email", start, host.end()))
            free = host.end()
    for run in ROW.finditer(text):
        if run.end() - run.start() < 9:
            continue
        plus = run.start() > 0 and text[run.start() - 1] == "+"
        out |= {("card", a, b) for a, b, _ in _windows(text, run, 13, 19)}
        for a, b, n in _windows(text, run, 9, 15):
            first = a == run.start()
            if plus and first:
                out.add(("phone", a - 1, b))
            elif n > 1:
                out.add(("phone", a - (a > 0 and text[a - 1] == "(" and ")" in text[a:b]), b))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span and the context around it."""
    span, before, after = text[start:end], text[max(0, start - 24) : start].lower(), text[end : end + 12].lower()
    numbers = NUMBER.findall(span)
    digits, groups = "".join(numbers), [len(x) for x in numbers] or [0]
    last = re.split(r"[^A-Za-z0-9-]+", span.lower())[-1] if kind == "email" else ""
    return [
        KINDS.index(kind), min(end - start, 100), min(len(digits), 40), min(len(groups), 20), min(max(groups), 40), min(min(groups), 40), min(groups[0], 40), min(groups[-1], 40),
        min(span.count("."), 20), span.count(" "), span.count("-"), span.count("/") + span.count("_"), span.count("["), span.count("("), float("+" in span), float("@" in span),
        float(13 <= len(digits) <= 19 and luhn(digits)), float(len(numbers) == 4 and all(int(x) <= 255 for x in numbers) if max(groups) <= 3 else 0), float(last in TOP_LEVEL), float(last.isdigit()),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(bool(re.search(r"[0-9][^a-z0-9]?$", before))), float(bool(re.match(r"[^a-z0-9]?[0-9]", after))),
        float(before[-1:] in ("", " ", "\n", ":", "(")), float(after[:1] in ("", " ", "\n", ".", ",")), float(before[-1:] in ".-/_"), float(any(w in before for w in WORDS[kind])),
        sum(c.isdigit() for c in before), sum(c.isdigit() for c in after), float(digits[:1] == "0"), float(digits[:2] == "00"), float(digits[:3] == "978"), float(bool(DATE.match(span))),
    ]


def plant(text: str, seed: int, each: int = 4) -> tuple[str, list[tuple[str, int, int]]]:
    """text with made personal data and decoys put between its words, and the spans of the personal data.

    Names come from the text's own words, numbers from the seed. The forms are ways of writing that the base rules do
    not know, and numbers beside other numbers; the decoys look alike and are none.
    """
    rng = random.Random(seed)
    words = [w for w in re.findall(r"[A-Za-z]{3,12}", text[:20_000])[:500]] or ["name"]
    word = lambda: rng.choice(words).lower()
    num = lambda n: "".join(rng.choices("0123456789", k=n))
    lead = lambda n: rng.choice("23456789") + num(n - 1)
    part = lambda: str(rng.randint(1, 255))
    top = lambda: rng.choice(TOP_LEVEL)

    def card() -> str:
        body = rng.choice("3456") + num(14)
        return body + next(d for d in "0123456789" if luhn(body + d))

    def no_card() -> str:
        body = card()
        return body[:-1] + str((int(body[-1]) + rng.randint(1, 9)) % 10)

    def fours(x: str, sign: str) -> str:
        return sign.join(x[i : i + 4] for i in range(0, 16, 4))

    def email() -> tuple[str, str, str]:
        user, host = word() + rng.choice(["", ".", "_"]) + word() + rng.choice(["", num(2)]), word() + rng.choice(["", num(1)])
        form = rng.choice(["{u} (at) {h} (dot) {t}", "{u}(at){h}(dot){t}", "{u} [at] {h} [dot] {t}", "{u}[at]{h}[dot]{t}", "{u} at {h} dot {t}", "{u}[@]{h}.{t}", "{u} (at) {h}.{t}", "{u} AT {h} DOT {t}"])
        return "", form.format(u=user, h=host, t=top()), ""

    def phone() -> tuple[str, str, str]:
        form = rng.choice(["({a}) {b}-{c}", "({a}) {b} {c}", "{a}-{b}-{c}", "{a}.{b}.{c}", "0{d} {e}", "0{d}-{e}", "(0{d}) {e}", "0{d}/{e}", "00{f} {a} {b} {c}", "1-{a}-{b}-{c}"])
        value = form.format(a=lead(3), b=lead(3), c=num(4), d=lead(rng.randint(2, 4)), e=lead(rng.randint(6, 7)), f=lead(2))
        if rng.random() < 0.3:  # so close to another number that one run holds too many digits
            return "", f"+{rng.randint(1, 99)} ({lead(3)}) {lead(3)}-{num(4)}", " " + ".".join(part() for _ in range(4))
        return "", value, ""

    def good_card() -> tuple[str, str, str]:
        how = rng.randrange(4)
        if how == 0:
            return num(rng.randint(2, 6)) + " ", fours(card(), " "), ""
        if how == 1:
            return "", fours(card(), "-"), " " + num(rng.randint(3, 6))
        return "", fours(card(), rng.choice("./_")), ""

    def ip() -> tuple[str, str, str]:
        return "", rng.choice(["[.]", "(.)", " [dot] ", "(dot)", "[dot]"]).join(part() for _ in range(4)), ""

    def decoy() -> str:
        year, month, day = str(rng.randint(1900, 2049)), f"{rng.randint(1, 12):02d}", f"{rng.randint(1, 28):02d}"
        return rng.choice([
            f"{year}-{month}-{day} {num(2)}", f"{day}.{month}.{year} {num(4)}", f"{year}/{month}/{day} {num(4)}", f"{year}{month}{day}-{num(4)}", no_card(), fours(no_card(), " "), fours(no_card(), rng.choice("-./_")), lead(12), f"{lead(6)}-{num(4)}-{num(2)}",
            f"{num(1)}.{num(4)} {num(1)}.{num(4)} {num(1)}.{num(4)}", ".".join(num(1) for _ in range(rng.randint(5, 7))), f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", f"{lead(2)} {lead(3)} {num(3)} {num(3)}", f"{lead(1)} {num(1)} {num(2)} {num(1)} {num(3)} {num(2)} {num(1)}",
            "[.]".join(str(rng.randint(256, 999)) for _ in range(4)), f"{word()} at {word()} dot {word()}", f"{word()} at {word()}", f"{word()} (at) {word()} {word()}", f"{lead(8)} {lead(8)}", f"{year} {year} {year}", f"{lead(5)}/{num(5)}/{num(4)}",
        ])

    gaps = [m.end() for m in re.finditer(r"\s", text)]
    put = [*(rng.choice([(k, f) for k, f in (("email", email), ("phone", phone), ("card", good_card), ("ip", ip))]) for _ in range(each)), *[("", decoy)] * each]
    places = sorted((rng.choice(gaps) if gaps else 0, rng.random(), k, f) for k, f in put)
    out, spans, size, at = [], [], 0, 0
    for place, _, kind, make in places:
        head, value, tail = make() if kind else ("", make(), "")
        lead_in = rng.choice(WORDS[kind]) + rng.choice([": ", " "]) if kind and rng.random() < 0.3 else ""
        piece = text[at:place] + lead_in + head
        out += [piece, value, tail + " "]
        if kind:
            spans.append((kind, size + len(piece), size + len(piece) + len(value)))
        size += len(piece) + len(value) + len(tail) + 1
        at = place
    return "".join(out) + text[at:], spans


class Trees:
    """Gradient-boosted regression trees on the logistic loss, grown level by level over quantile bins."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.base, self.trees = 0.0, []
        if not len(y) or y.min() == y.max():
            self.base = 0.0 if not len(y) else (6.0 if y[0] else -6.0)
            return self
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
        raw = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            node, tree = np.zeros(len(y), int), []
            for depth in range(DEPTH):
                width = 2**depth
                best = [(1e-9, 0, np.inf)] * width
                for f, e in enumerate(edges):
                    cell = node * (BINS + 1) + bins[:, f]
                    g = np.bincount(cell, grad, width * (BINS + 1)).reshape(width, -1).cumsum(1)
                    h = np.bincount(cell, hess, width * (BINS + 1)).reshape(width, -1).cumsum(1)
                    rest_g, rest_h = g[:, -1:] - g, h[:, -1:] - h
                    gain = g**2 / (h + 1) + rest_g**2 / (rest_h + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                    for k in range(width):
                        b = int(gain[k, : len(e)].argmax()) if len(e) else 0
                        if len(e) and gain[k, b] > best[k][0]:
                            best[k] = (gain[k, b], f, e[b])
                f_at, cut = np.array([b[1] for b in best]), np.array([b[2] for b in best])
                tree.append((f_at, cut))
                node = 2 * node + (x[np.arange(len(y)), f_at[node]] > cut[node])
            leaf = RATE * np.bincount(node, grad, 2**DEPTH) / (np.bincount(node, hess, 2**DEPTH) + 1)
            self.trees.append((tree, leaf))
            raw += leaf[node]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        for tree, leaf in self.trees:
            node = np.zeros(len(x), int)
            for f_at, cut in tree:
                node = 2 * node + (x[np.arange(len(x)), f_at[node]] > cut[node])
            raw += leaf[node]
        return 1 / (1 + np.exp(-raw))


def best_first(spans: list[tuple[str, int, int]], scores, taken: list[tuple[int, int]], limits: dict[str, float] | None = None) -> list[int]:
    """Which of spans stay, likeliest first, each free of those before it and of taken; below its kind's limit none does."""
    held = sorted(taken)
    out = []
    for k in sorted(range(len(spans)), key=lambda k: (-scores[k], spans[k][1], spans[k][2])):
        kind, a, b = spans[k]
        if limits is not None and scores[k] < limits[kind]:
            continue
        at = bisect_left(held, (a, b))
        if (at == 0 or held[at - 1][1] <= a) and (at == len(held) or held[at][0] >= b):
            held.insert(at, (a, b))
            out.append(k)
    return out


def _merged(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The places that spans cover, overlaps joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s[1], s[2]) for s in spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def fit(docs: DataFrame, max_docs: int = FIT_DOCS, max_rows: int = FIT_ROWS) -> tuple[Trees, dict[str, float]]:
    """Trees and thresholds from the planted texts of max_docs documents (null texts and ids aside) and max_rows candidates at most.

    A candidate is right if it is what was planted. Proposals over base spans say nothing and are left out. Where no
    score is right often enough on the calibration part, or the kind has few candidates there, the threshold is out of reach.
    """
    few = written(docs.select(F.col("doc_id").alias("_id")).filter("_id IS NOT NULL").orderBy(F.md5(F.col("_id").cast("string"))).limit(max_docs), "fit-ids")
    texts = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("_id")).select(F.col("doc_id").cast("long"), "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, text in frame.itertuples(index=False):
                held, right = plant(text or "", zlib.crc32(str(doc_id).encode()))
                base, right = _merged(base_spans(held)), set(right)
                for s in candidates(held):
                    at = bisect_left(base, (s[1], s[1]))
                    if (at == 0 or base[at - 1][1] <= s[1]) and (at == len(base) or base[at][0] >= s[2]):
                        rows.append((doc_id, *s, float(s in right), np.array(features(held, *s), "<f4").tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "a", "b", "y", "x"])

    rows = written(in_small_batches(texts).mapInPandas(run, "doc_id long, kind string, a int, b int, y double, x binary"), "fit-candidates")
    got = rows.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "kind", "a", "b").limit(max_rows).toPandas()
    if not len(got):
        return Trees().fit(np.empty((0, 1)), np.empty(0)), dict.fromkeys(KINDS, 2.0)
    x, y = np.stack([np.frombuffer(v, "<f4") for v in got["x"]]).astype(np.float64), got["y"].to_numpy()
    calibrating = (got["doc_id"] % 3 == 0).to_numpy()
    trees = Trees().fit(x[~calibrating], y[~calibrating])
    held, limits = got[calibrating].assign(score=trees.score(x[calibrating])), {}
    best = []
    for _, doc in held.groupby("doc_id", sort=False):
        keep = best_first(list(zip(doc["kind"], doc["a"], doc["b"])), doc["score"].to_numpy(), [])
        best.append(doc.iloc[keep][["kind", "score", "y"]])
    best = pd.concat(best) if best else held[["kind", "score", "y"]]
    for kind in KINDS:
        own = best[best["kind"] == kind].sort_values("score", ascending=False, kind="stable")
        s, right = own["score"].to_numpy(), np.cumsum(own["y"].to_numpy())
        fine = np.flatnonzero((right / np.arange(1, len(s) + 1) >= PRECISION) & np.r_[s[1:] < s[:-1], np.ones(min(len(s), 1), bool)])
        limits[kind] = max(float(s[fine[-1]]), LEAST) if len(fine) and len(s) >= 20 else 2.0
    return trees, limits


def detect(docs: DataFrame, model: tuple[Trees, dict[str, float]]) -> DataFrame:
    """docs with pii, an array of (kind, start, end, base, score) in code points, end exclusive, by kind and start.

    base tells a span of the fixed rules; these always stay, the others are what the trees add. A null text has none, a text
    of any length is read whole. Rows stand alone: repeats, ties and empty tables need nothing; an input column named pii is
    replaced, all others pass.
    """
    trees, limits = model
    kept = without(docs, "pii")
    at = [c.lower() for c in kept.columns].index("text")
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())])
    spark_kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType()), T.StructField("score", T.DoubleType())]))

    schema = T.StructType([*kept.schema.fields, T.StructField("pii", spark_kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [t or "" for t in part.column(at).to_pylist()]
                found = [candidates(t) for t in texts]
                flat = [features(t, *s) for t, spans in zip(texts, found) for s in spans]
                scores = trees.score(np.array(flat)) if flat else np.empty(0)
                out, done = [], 0
                for text, spans in zip(texts, found):
                    own, done = scores[done : done + len(spans)], done + len(spans)
                    base = base_spans(text)
                    by = dict(zip(spans, own))
                    taken = [{"kind": k, "start": a, "end": b, "base": True, "score": float(by.get((k, a, b), 1.0))} for k, a, b in base]
                    for k in best_first(spans, own, _merged(base), limits):
                        taken.append({"kind": spans[k][0], "start": spans[k][1], "end": spans[k][2], "base": False, "score": float(own[k])})
                    out.append(sorted(taken, key=lambda t: (KINDS.index(t["kind"]), t["start"])))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.list_(kind))], names=schema.names)

    return in_small_batches(kept).mapInArrow(run, schema)


def redact(found: DataFrame) -> DataFrame:
    """found with redacted: the text with every span replaced by its kind in brackets (of overlapping ones the first).

    A null text stays null, one without spans as it is; an input column named redacted is replaced; rows stand alone.
    """
    cut = F.aggregate(
        F.array_sort(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))),
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(F.concat(acc["done"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("done"), s["end"].alias("at"))),
        lambda acc: F.concat(acc["done"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    return found.withColumn("redacted", cut)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans as text, and n_added, how many of them the trees added.

    A null or empty text has no spans and the digest of nothing; one row for each row of found, columns of any other name are left out.
    """
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("pii", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("pii")).alias("spans"), F.size(F.filter("pii", lambda s: ~s["base"])).cast("long").alias("n_added"))
