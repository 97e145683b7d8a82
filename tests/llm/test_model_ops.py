"""Classifier, personal data, page extraction, near-duplicates, neighbours and the pipeline against brute force."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from terraframe.llm import bpe, exact, hilbert_ann, html_paths, mixing, neardup, pii, quality, queries
from terraframe.llm import hyperminhash as hmh
from terraframe.llm._common import table
from terraframe.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd(spark):
    rows = [(0, None, "a", None), (1, "", "a", "z"), (2, "x " * 20000, None, "z"), (3, "same text here", "b", "z"), (3, "same text here", "b", "z"), (None, "nobody@example.com", "b", "z"), (4, "é" * 500 + " +1 (702) 555-0742", "b", "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score string")


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=quality.WORD_DIM + quality.STATS), rng.normal(size=(quality.WORD_DIM + quality.STATS, 4)))
    rows = [(np.sort(rng.choice(8000, n, replace=False)), rng.normal(size=n)) for n in (1, 5, 30)]
    for (idx, x), got in zip(rows, m.raw(rows)):
        want = 0.3 + m.w[idx] @ x + sum(m.v[idx[i]] @ m.v[idx[j]] * x[i] * x[j] for i in range(len(idx)) for j in range(i))
        assert abs(want - got) < 1e-8


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    out = quality.classify(docs, labels)
    assert set(docs.columns) | {"held_out", "score", "predicted"} == set(out.columns)
    got = {r["doc_id"]: r for r in out.drop("text").collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([a == b for a, b in held]) >= 0.95


def test_quality_odd(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, None), (None, 1)], "doc_id long, quality int")
    assert quality.classify(docs, labels).count() == docs.count()
    assert quality.classify(docs, labels.limit(0)).count() == docs.count()
    assert quality.classify(docs.limit(0), labels).count() == 0


def slow_spans(text):
    """The base rules, literally."""
    rules = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    out = []
    for kind, rule in rules:
        for m in re.finditer(rule, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            doubled = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and doubled % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_rules_random():
    rng = random.Random(4)
    parts = ["a", "@", ".", "com", "-", "+", "1", "25", "255", "300", " ", "(", ")", "4111 1111 1111 1111", "é", "@@", "..", "x.y@z.w", "+49 30 1234567", "1.2.3.4", "10.0.0.1.9.8.7.6"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        assert pii.base_spans(text) == slow_spans(text), text


def test_pii_base_spans_stay(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text"))
    model = pii.fit(docs)
    found = pii.redact(pii.detect(docs, model)).collect()
    added = total = 0
    for r in found:
        spans = [(s["kind"], s["start"], s["end"]) for s in r["pii"]]
        base = [s for s, m in zip(spans, r["pii"]) if m["base"]]
        assert base == slow_spans(r["text"] or "")
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        more = [s for s, m in zip(spans, r["pii"]) if not m["base"]]
        assert all(b <= c or a >= d for _, a, b in more for _, c, d in base)
        added += len(more)
        total += len(base)
        if base and r["text"]:
            assert r["text"][base[0][1] : base[0][2]] not in r["redacted"][: base[0][2]] or len(base) > 1
    assert total > 50
    assert added <= 0.05 * total  # these texts hold next to nothing that the base rules miss
    shown = {r["doc_id"]: r for r in pii.digests(pii.detect(docs, model)).collect() if r["doc_id"] is not None}
    assert sum(r["n_added"] for r in shown.values()) <= added + 1
    assert pii.detect(docs.limit(0), pii.fit(docs.limit(0))).count() == 0
    assert pii.digests(pii.detect(docs.limit(0), model)).count() == 0


def test_pii_trees_find_what_the_base_rules_miss(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").filter("text IS NOT NULL")
    model = pii.fit(docs)
    assert all(v < 2 for v in model[1].values())
    planted = [(r["doc_id"], *pii.plant(r["text"], 10**6 + r["doc_id"])) for r in docs.collect()]  # other seeds than those of the fit
    made = spark.createDataFrame([(d, t) for d, t, _ in planted], "doc_id long, text string")
    got = {r["doc_id"]: {(s["kind"], s["start"], s["end"]) for s in r["pii"] if not s["base"]} for r in pii.detect(made, model).collect()}
    clean = {r["doc_id"]: sum(not s["base"] for s in r["pii"]) for r in pii.detect(docs, model).collect()}
    want = {d: set(spans) for d, _, spans in planted}
    hits = {k: sum(s in got[d] for d in want for s in want[d] if s[0] == k) for k in pii.KINDS}
    all_of = {k: sum(s[0] == k for d in want for s in want[d]) for k in pii.KINDS}
    assert all(hits[k] >= 0.9 * all_of[k] for k in pii.KINDS), (hits, all_of)
    # of what is added but not planted, what the texts held themselves is no mistake
    wrong = sum(len(got[d] - want[d]) for d in want) - sum(clean.values())
    assert wrong <= 0.03 * sum(hits.values())
    assert sum(clean.values()) <= 0.02 * len(clean)
    # the forms are no base spans, so the base rules alone find none of them
    assert not any(s in slow_spans(t) for d, t, spans in planted[:100] for s in spans)


def test_pii_long_and_digit_heavy(spark):
    texts = ["12 " * 30_000, "1.2." * 20_000, "a" * 100_000 + "@b.com", "x@" * 30_000, "+49 30 1234567 " * 3_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.detect(docs, (pii.Trees().fit(np.empty((0, 1)), np.empty(0)), dict.fromkeys(pii.KINDS, 2.0))).collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["pii"]] == slow_spans(r["text"]) if r["doc_id"] != 2 else True


def test_pages(spark, sf):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    from html import unescape

    for r in html_paths.extract(pages).collect():
        body = re.search(r"<article>(.*?)(</article>|<footer>)", r["html"], re.S)[1]
        lines = [" ".join(unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", p))).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(x for x in lines if x)
        assert r["n_chars"] == len(r["text"])
    few = spark.createDataFrame([(1, None, "x"), (2, "", None), (2, "", None)], "page_id long, html string, text string")
    assert [r["text"] for r in html_paths.extract(few).collect()] == [""] * 3
    assert html_paths.extract(few.limit(0)).count() == 0


def test_page_without_article():
    page = """<html><body><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav><div class="content"><h2>Head &amp; line</h2>
    <p>First para, with <a href=y>a link</a>. It is long enough, I hope; yes.</p><ul><li>One item, fine.<li>Two items. ok</ul>
    <div class="sidebar">Side, bar.</div><form>Your name, please: <input></form><div id="comments"><p>I like it, really.</p></div>
    <p>Second para<br>with&nbsp;break. Well, well.</div><footer>&copy; x</footer><script>var a="<p>x</p>";</script></body></html>"""
    assert html_paths.main_text(page).split("\n") == ["Head & line", "First para, with a link. It is long enough, I hope; yes.", "One item, fine.", "Two items. ok", "Second para with break. Well, well."]


def test_page_whose_article_is_not_its_text():
    body = [f"Paragraph {i}, which tells the story at length; it goes on, and on, until the reader, tired, has enough of it. So it ends." for i in range(6)]
    text = "".join(f"<p>{p}</p>" for p in body)
    # the only article is a teaser, or a comment: the ratios bring the body outside it back
    teaser = f'<html><body><article><b>More</b></article><div class="story">{text}</div></body></html>'
    assert html_paths.main_text(teaser).split("\n")[-6:] == body
    comment = f'<html><body><div class="story">{text}</div><article class="comment"><p>{body[0]}</p></article></body></html>'
    assert html_paths.main_text(comment).split("\n")[:6] == body
    # inside an article that stands, paths of low ratio go, here a run of labels without links
    labels = "".join(f'<span><div class="label">t{i}</div></span>' for i in range(12))
    assert html_paths.main_text(f"<html><body><article><header><h1>Head</h1></header>{text}{labels}</article></body></html>").split("\n") == ["Head", *body]
    # an article that names noise besides its text keeps its headline
    assert html_paths.main_text(f'<html><body><article class="post has-sidebar"><header><h1>Head</h1></header>{text}</article></body></html>').split("\n") == ["Head", *body]


def test_page_ratios_decide_without_marks(monkeypatch):
    """No article mark and no telling class name: only the ratios of the paths part the story from what surrounds it."""
    body = [f"Paragraph {i}, which tells the story at length; it goes on, and on, until the reader, tired, has enough of it. So it ends." for i in range(5)]
    short = ["Oslo, Monday.", "By A. Reporter", "Updated: 10:30", "4 min read"]
    page = (
        "<html><body>" + "".join(f'<div class="k1"><span>{s}</span></div>' for s in short) + '<div class="k2">' + "".join(f"<p>{p}</p>" for p in body[:3])
        + '<ul class="k3"><li>First point, which is long enough to matter; it has signs.<li>Second point, as long as the first one, more or less.</ul>' + "".join(f"<p>{p}</p>" for p in body[3:]) + "</div>"
        + "".join(f'<div class="k4"><b>{s}</b></div>' for s in ("Oslo", "Harbour", "Ferries", "Weather", "Older stories", "Print")) + "</body></html>"
    )
    want = [*body[:3], "First point, which is long enough to matter; it has signs.", "Second point, as long as the first one, more or less.", *body[3:]]
    assert html_paths.main_text(page).split("\n") == want
    monkeypatch.setattr(html_paths, "least_share", lambda shares: 0.0)
    assert html_paths.main_text(page).split("\n") != want
    monkeypatch.undo()
    # a short page without any such rest keeps all it has
    assert html_paths.main_text("<div><p>One line, only.</p></div>") == "One line, only."


STORY = "This is a long paragraph, which tells the story at length; it goes on, and on, until the reader, tired, has enough. So it ends."


def test_page_keeps_short_blocks_of_its_article():
    short = "<ul><li>Yes<li>No</ul><table><tr><th>a<th>b<tr><td>1<td>2</table><pre>x = 1</pre>"
    want = [STORY, STORY, "Yes", "No", "a", "b", "1", "2", "x = 1"]
    assert html_paths.main_text(f"<article><p>{STORY}<p>{STORY}</p>{short}</article>").split("\n") == want
    # no mark: the ratios find the element, and what lies around it goes
    page = f"<div><div>An advert.</div><div><p>{STORY}<p>{STORY}</p>{short}</div><div>2020 me</div></div>"
    assert html_paths.main_text(page).split("\n") == want
    # a second section with text as dense as the body's stays, though the body is another element
    page = f"<body><div>{f'<p>{STORY}' * 6}</div><div>advert</div><div><p>{STORY}</div></body>"
    assert html_paths.main_text(page) == "\n".join([STORY] * 7)


def test_pages_without_marks(monkeypatch):
    """Pages of the table without article, class, id and role: at least 85 % come out exactly by the ratios, and no page loses text."""
    import pyarrow.parquet as pq

    pages = [h or "" for h in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()]
    bare = [re.sub(r"""\s(class|id|role)=("[^"]*"|'[^']*'|[^\s>]+)""", "", re.sub(r"<(/?)(article|main)\b", r"<\1div", h)) for h in pages]
    want, got = [html_paths.main_text(h) for h in pages], [html_paths.main_text(h) for h in bare]
    assert sum(a == b for a, b in zip(want, got)) >= 0.85 * len(pages)
    assert all(set(a.split("\n")) <= set(b.split("\n")) for a, b in zip(want, got))
    monkeypatch.setattr(html_paths, "least_share", lambda shares: 0.0)
    assert sum(html_paths.main_text(h) == b for h, b in zip(bare, got)) <= 0.5 * len(pages)


def test_pages_long_and_odd(spark):
    rows = [(1, None), (2, ""), (3, "<p>" * 30_000 + "deep, indeed." + "</p>" * 30_000), (4, "<p>" + "word, " * 60_000), (5, "<" * 20_000), (6, "&amp;" * 20_000), (7, "<div><p>a"), (7, "<div><p>a")]
    got = html_paths.extract(spark.createDataFrame(rows, "page_id long, html string")).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[3]["text"] == "deep, indeed."
    assert by[4]["n_chars"] == 60_000 * 6 - 1
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def sets_of(rows):
    out = []
    for doc_id, text in rows:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        out.append((doc_id, {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()))
    return out


def brute_groups(rows):
    sets = sets_of(rows)
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * min(len(a), len(b)) >= 75 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 75 * (len(a) + len(b) - both):
                    parent[max(root(i), root(j))] = min(root(i), root(j))
    low = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        low[root(i)].append(d)
    return sorted((d, len(s), min(low[root(i)])) for i, (d, s) in enumerate(sets))


def test_near_duplicates_match_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    rng = random.Random(1)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    base = [f"w{rng.randint(0, 99999)}" for _ in range(300)]
    for k in range(250):  # one chain of small edits: neighbours are alike, the ends are not
        base[rng.randrange(300)] = f"n{k}"
        base[rng.randrange(300)] = f"m{k}"
        rows.append((10_000 + k, " ".join(base)))
    passage = [f"p{i}" for i in range(120)]
    rows += [(20_000 + k, " ".join(passage + [f"u{k}_{i}" for i in range(90)])) for k in range(150)]  # a shared passage, no links
    rows += [(30_000 + k, t) for k, t in enumerate([None, "", " \n", "a b", "A b", "a b c", "one two three four five", "one two three four six"])]
    rows += [(40_000 + k, " ".join(f"s{i}" for i in range(k % 7 + 18))) for k in range(30)]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = neardup.groups(made).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_groups(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 300)
    rng = random.Random(2)
    rows, base = [], [f"w{i}" for i in range(100)]
    for k in range(60):
        base[rng.randrange(100)] = f"n{k}"
        rows.append((k, " ".join(base)))
    got = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_groups(rows)


def test_near_duplicates_odd(spark):
    docs = odd(spark)
    assert neardup.groups(docs).count() == docs.count()
    kept = neardup.deduplicate(docs).collect()
    assert len(kept) == docs.count() - 1
    assert neardup.groups(docs.limit(0)).count() == 0
    assert neardup.deduplicate(docs.limit(0)).count() == 0


def test_registers():
    rng = np.random.default_rng(5)
    for n, common in ((20, 18), (400, 340), (5000, 4000)):
        pool = np.unique(rng.integers(0, 2**63, 3 * n).astype(np.uint64))
        errors = []
        for _ in range(20):
            pick = rng.permutation(pool)
            a, b = np.sort(pick[:n]), np.sort(np.r_[pick[:common], pick[n : 2 * n - common]])
            regs = hmh.registers(np.r_[a, b], np.array([0, n, 2 * n]))
            errors.append(hmh.estimate((regs[0] == regs[1]).mean(), n, n) - common / (2 * n - common))
        assert abs(np.mean(errors)) < 0.08
    x = np.sort(rng.integers(0, 2**63, 50).astype(np.uint64))
    regs = hmh.registers(np.r_[x, x[:1]], np.array([0, 50, 50, 51]))
    assert (regs[1] == 0).all()
    assert len(set(regs[2])) == 1
    keys = hmh.band_keys(regs)
    assert len(set(keys[0])) == hmh.BANDS
    assert (keys[0] & hmh.BAND_BITS == np.arange(hmh.BANDS)).all()


@pytest.mark.parametrize("piece", [7, 64, 1 << 19])
def test_shingle_sets_match_words(monkeypatch, piece):
    monkeypatch.setattr(hmh, "PIECE", piece)
    monkeypatch.setattr(hmh, "_powers", [np.ones(1, np.uint64)] * 2)
    rng = random.Random(1)
    texts = [None, "", " ", "a B a b A b", "x" * 3000, *("".join(rng.choices(["a", "B", "b", " ", "\n", "é", "日", "\x0b", "\x1c", "."], k=rng.randint(0, 60))) for _ in range(1500))]
    sets, bounds = hmh.shingle_sets(pa.array(["zz", *texts])[1:])
    keys = {}
    for i, (_, words) in enumerate(sets_of(enumerate(texts))):
        got = sets[bounds[i] : bounds[i + 1]]
        assert len(got) == len(words)
        assert (got[1:] > got[:-1]).all()
        keys.setdefault(frozenset(words), set()).add(hmh.class_key(got))
    assert all(len(k) == 1 for k in keys.values())
    assert len({min(k) for k in keys.values()}) == len(keys)


def test_spanning_tree_takes_likeliest_pairs():
    rng = np.random.default_rng(3)
    regs = rng.integers(0, 60000, (3, hmh.REGISTERS)).astype(np.uint16).repeat(4, axis=0)  # three groups of four
    for k in range(12):
        regs[k, rng.integers(0, hmh.REGISTERS, 10)] = k
    pairs = neardup.spanning_tree(regs, np.full(12, 300.0))
    assert len(pairs) == 9
    assert all(a // 4 == b // 4 for a, b in pairs)


def test_components(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 180)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(-5, 300), (7, 7)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    parent = {x: x for e in links for x in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in links)}


def brute_near(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, x in good:
        if q % 20 == 0:
            hits = sorted({(-float((x * v).sum()), i) for i, v in good if i != q})[:k]
            out += [(q, r + 1, i) for r, (_, i) in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_neighbours(spark, monkeypatch, spread):
    monkeypatch.setattr(hilbert_ann, "QUERY_ROWS", 40)
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(30, 16))
    x = (centers[rng.integers(0, 30, 2000)] + spread * rng.normal(size=(2000, 16))).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)] + [(5001, None), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [None] * 16), (5005, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in hilbert_ann.search(df, "id % 20 = 0").collect())
    want = brute_near([r for r in rows if r[0] != 5005], 20)
    assert len(got) == len(want)
    assert len(set((q, v) for q, _, v in got) & set((q, v) for q, _, v in want)) >= 0.9 * len(want)
    exactly = {q: [v for a, _, v in want if a == q] for q in range(100, 400, 20)}
    assert all([v for a, _, v in got if a == q] == exactly[q] for q in exactly)


def test_neighbours_windows_narrow_the_search(spark):
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(6000, 4)) @ rng.normal(size=(4, 32)) + 0.05 * rng.normal(size=(6000, 32))).astype(np.float32)  # four true dimensions
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, curve int").repartition(4)
    rows = hilbert_ann.valid(df)
    index = hilbert_ann.fit(rows, "id % 20 = 0")
    assert not index.whole
    assert index.curves * (2 * index.width + index.block_rows) < 0.7 * index.n
    got = {(r["query_id"], r["vec_id"]) for r in hilbert_ann.search_index(rows, "id % 20 = 0", index).collect()}
    want = {(q, v) for q, _, v in brute_near(list(enumerate(x)), 20)}
    assert len(got & want) >= 0.9 * len(want)


def test_neighbours_recall_on_the_table(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    got = {(r["query_id"], r["vec_id"]) for r in hilbert_ann.search(df, "id % 20 = 0").collect()}
    want = {(q, v) for q, _, v in brute_near([(r["vec_id"], r["embedding"]) for r in df.collect()], 20)}
    assert len(got & want) >= 0.9 * len(want)
    assert {(r["query_id"], r["vec_id"]) for r in hilbert_ann.search(df, "id % 20 = 0", exact=True).collect()} == want


def test_neighbours_repeated_ids(spark):
    rows = [(i % 50, [float(i % 50), 1.0, float(i % 7)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["vec_id"]) for r in hilbert_ann.search(df, "id % 20 = 0", k=5).collect()]
    assert all(q != v for q, v in got)
    assert {q for q, _ in got} == {0, 20, 40}


def test_neighbours_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in hilbert_ann.search(df, "id % 20 = 0").collect()]
    assert sorted(got) == [(0, 1, 1, 4.0), (0, 2, 2, -1.0)]
    assert hilbert_ann.search(df.limit(0), "id % 20 = 0").count() == 0


def test_hilbert_steps():
    for dims, bits in ((2, 4), (3, 3), (6, 2)):
        side = 1 << bits
        grid = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = hilbert_ann.hilbert(grid, bits)
        assert sorted(key) == list(range(side**dims))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    columns, now, seen = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf).cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        seen[name] = (now, out)
        now = out
    before, after = seen["exact dedup"]
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    best = {}
    for r in before.collect():
        best[low(r["text"])] = max(best.get(low(r["text"]), -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(best.values())
    before, after = seen["MinHash near-dedup"]
    want = brute_groups([(r["doc_id"], r["text"]) for r in before.collect()])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(d for d, _, c in want if d == c)
    before, after = seen["mixing sources to target weights"]
    taken = {r["doc_id"]: r["copies"] for r in mixing.per_document(mixing.plan(before)).collect()}
    counts = defaultdict(int)
    for r in after.collect():
        counts[r["doc_id"]] += 1
    assert dict(counts) == {d: c for d, c in taken.items() if c}
    assert corpus_pipeline.run(spark, sf).count() == sum(counts.values())
    assert exact.refine(docs).count() == docs.count()


CLASHING = "_len _prefix _bucket _norm _top _alone _row _bits _carry _marked _id _source _words _size _finish _times _doc _from finish size rows taken copies u v band comp class regs bands node _gone _twice _first pii ids decoded score".split()


@pytest.fixture(scope="module")
def clashing(spark):
    """Few odd rows with columns named like those that operators make on the way, and one with a dot."""
    rows = [(0, None, None), (1, "", "b"), (2, "one two three four five six", "b"), (3, "One two three four five six", "b"), (3, "One two three four five six", "b"), (None, "seven", None), (4, "w " * 20_000, "c")]
    wide = [(*r, *range(len(CLASHING)), "dot") for r in rows]
    return spark.createDataFrame(wide, f"doc_id long, text string, source string, {', '.join(f'{c} int' for c in CLASHING)}, `a.b` string")


def test_clashing_columns_pass(spark, clashing):
    made = {"mixing": mixing.mix(clashing), "exact": exact.deduplicate(clashing), "near": neardup.deduplicate(clashing)}
    for name, out in made.items():
        assert out.columns == clashing.columns, name
        for r in out.collect():
            assert r["_len"] == 0
            assert r["a.b"] == "dot"
    assert {r["doc_id"]: r["kept"] for r in exact.refine(clashing).select("doc_id", "kept", "_len", "_top").collect()}[2] is False
    assert sorted(str(r["doc_id"]) for r in made["exact"].collect()) == ["1", "3", "4", "None"]
    assert made["near"].count() == 5  # rows 3 repeat, and 2 links them
    shown = bpe.encode(clashing, queries.TOKENIZER)
    assert shown.count() == clashing.count()
    assert neardup.groups(clashing).count() == clashing.count()


def test_quality_finds_columns_in_any_case(spark):
    docs = spark.createDataFrame([(1, "a b c", 5), (2, None, None)], "doc_id long, Text string, N_CHARS int")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.classify(docs, labels).count() == 2


def test_pipeline_stages_on_odd_and_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    rows = [(i, "One two three four five six." if i % 3 else None, "en", "a" if i % 2 else None, 3) for i in range(12)] + [(None, "x", None, None, None), (3, "", "en", "b", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (2, 0, None), (4, None, 1)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, folder)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == now.columns
            assert out.count() >= 0
            now = out
