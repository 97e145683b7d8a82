"""Main text of web pages by tag-path ratios.

A page is read once into text blocks, each under its root-to-leaf path of tags and classes. Per path the text
length, the punctuation and the number of nodes are added up; text per node and punctuation per node are
smoothed along the page and fused by their product. Paths through elements that are never main text (menus, footers,
forms, ...) are out from the start. A marked article is the body of the page if its paths score like the rest; where
none is marked, the body is the innermost element that holds nearly all of the page's score. Outside the body, paths
well below the typical content path go; how far below, the widest gap between the page's own ratios tells. Inside it,
a low ratio alone drops nothing that is marked up as text (paragraphs, list items, table cells, preformatted text):
such paths go only if they are mostly links. Headings belong to the content that follows them.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from terraframe.llm._common import in_small_batches, without

TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>", re.DOTALL)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
RAW = frozenset("script style noscript template textarea iframe svg math object canvas select title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROP = frozenset("nav footer aside form button fieldset dialog menu head".split()) | RAW
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open element of these names, as the HTML rules let authors leave out end tags.
P_ENDS = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body html article section div td th main".split())
#: Elements that say themselves that they hold text, however short.
TEXTUAL = frozenset("p li dt dd td th caption figcaption pre blockquote address summary details".split()) | HEADINGS
#: Words in class, id or role that mark what is not main text.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navigation navbar menu menubar breadcrumb breadcrumbs "
    "sidebar aside footer header masthead cookie cookies consent notice notices alert disclaimer popup modal overlay newsletter subscribe subscription "
    "comment comments commentlist disqus reply replies respond discussion share sharing social related recommended recommendations widget pagination pager toolbar "
    "login signup search complementary contentinfo".split()
)
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：()\"'«»„“”‘’-]")
#: A path stays if its fused ratio is at least a share of the typical one; the page's own ratios set that share within these bounds.
SHARES, SMOOTH = (0.02, 0.25), (0.25, 0.5, 0.25)
#: The body of an unmarked page is the innermost element with this share of the score of its text; what lies outside needs OUTSIDE times the least share, or ENOUGH.
BODY_SHARE, OUTSIDE, ENOUGH = 0.8, 6.0, 0.5
#: A marked article stands for the page if its typical fused ratio is at least this share of that of the rest.
ARTICLE_SHARE = 0.25


def noisy(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element and all in it is not main text. A header inside the article holds its headline."""
    if tag in DROP or (tag == "header" and not inside):
        return True
    if not attributes:
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return True
        if name in ("class", "id", "role") and not NOISE.isdisjoint(re.split(r"[^a-z0-9]+", value)) and tag not in ("html", "body", "article", "main"):
            return True
    return False


def landmark(tag: str, attributes: str) -> bool:
    """Whether an element marks the article of its page; one whose class, id or role names noise, as a comment's, does not."""
    if not (tag in ("article", "main") or 'role="main"' in attributes or "articlebody" in attributes.lower()):
        return False
    return not any(name.lower() in ("class", "id", "role") and not NOISE.isdisjoint(re.split(r"[^a-z0-9]+", value.lower())) for name, value in ATTRIBUTE.findall(attributes))


def blocks(html: str) -> list[tuple[tuple[str, ...], str, int, bool, tuple[int, ...]]]:
    """(path, text, characters in links, inside the marked article, numbers of the elements around) of every text block, noise left out."""
    out: list[tuple[tuple[str, ...], str, int, bool, tuple[int, ...]]] = []
    stack: list[tuple[str, str, bool, bool, int]] = []  # tag, path step, noise, article, number
    held: list[str] = []
    held_path: tuple[str, ...] = ()
    held_around: tuple[int, ...] = ()
    held_in, links = False, 0

    def close() -> None:
        nonlocal held, links
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                out.append((held_path, text, links, held_in, held_around))
        held, links = [], 0

    def pop(to: int) -> None:
        if any(s[0] not in INLINE for s in stack[to:]):
            close()
        del stack[to:]

    at, end = 0, len(html)
    while at < end:
        m = TOKEN.search(html, at)
        text = html[at : m.start() if m else end]
        if text and not (stack and stack[-1][2]):
            if not held and not text.isspace():
                held_path = tuple(s[1] for s in stack if s[0] not in INLINE)
                held_around = tuple(s[4] for s in stack if s[0] not in INLINE)
                held_in = bool(stack) and stack[-1][3]
            if held or not text.isspace():
                held.append(text)
                links += len(text) if any(s[0] == "a" for s in stack) else 0
        if m is None:
            break
        at = m.end()
        if m[0].startswith("<![CDATA["):
            held.append(m[0][9:-3].replace("&", "&amp;") if held else "")
            continue
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if (m[1] or m[4]) == "/":
            if tag in INLINE:
                # misnested formatting ends where it can; blocks are not ended by it
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k]
                        break
                    if stack[k][0] not in INLINE:
                        break
            else:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        pop(k)
                        break
                else:
                    close()
            continue
        attributes = m[3] or m[6] or ""
        if tag in VOID:
            if tag not in INLINE:
                close()
            elif held:
                held.append(" " if tag == "br" else "")
            continue
        if tag in P_ENDS or tag in SIBLINGS:
            ended = {"p"} if tag in P_ENDS else SIBLINGS[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ended:
                    pop(k)
                    break
                if stack[k][0] in SCOPES and stack[k][0] not in ended:
                    break
        if tag not in INLINE:
            close()
        outer_noise, inside = (stack[-1][2], stack[-1][3]) if stack else (False, False)
        is_noise = outer_noise or noisy(tag, attributes, inside or any(s[0] in ("article", "main") for s in stack))
        if tag in RAW:
            # what a raw element holds is no markup; an unclosed one takes the rest
            stop = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(html, at)
            at = stop.end() if stop else end
            continue
        names = re.search(r"""\bclass\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", attributes, re.IGNORECASE) if attributes else None
        step = tag + ("." + names[1].strip("\"'").lower() if names else "")
        stack.append((tag, step, is_noise, inside or landmark(tag, attributes), m.start()))
    close()
    return out


def fused_ratios(found: list[tuple[tuple[str, ...], str, int, bool, tuple[int, ...]]]) -> tuple[np.ndarray, float]:
    """The smoothed and fused ratio of every block's path, and its mean over the text of the blocks."""
    size, punct, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, text, *_ in found:
        size[path] += len(text)
        punct[path] += len(PUNCTUATION.findall(text))
        count[path] += 1
    ratio = np.array([size[b[0]] / count[b[0]] for b in found])
    marks = np.array([(1 + punct[b[0]]) / count[b[0]] for b in found])
    smooth = lambda x: np.convolve(np.r_[x[:1], x, x[-1:]], SMOOTH, "valid")
    fused = smooth(ratio) * smooth(marks)
    weight = np.array([len(b[1]) for b in found], float)
    return fused, float((fused * weight).sum() / weight.sum())


def least_share(shares: np.ndarray) -> float:
    """The share that parts content from the rest: the middle of the widest gap, on a log scale, between the page's own shares up to the first over the bounds."""
    low, high = np.log(SHARES)
    at = np.sort(np.log(np.maximum(shares, 1e-12)))
    over = at[at >= high][:1]
    edges = np.r_[low, at[(at > low) & (at < high)], over if len(over) else high]
    widest = int(np.diff(edges).argmax())
    return float(np.exp(min((edges[widest] + edges[widest + 1]) / 2, high)))


def tag_of(step: str) -> str:
    return step.split(".")[0]


def body_of(found: list[tuple[tuple[str, ...], str, int, bool, tuple[int, ...]]], fused: np.ndarray) -> list[bool]:
    """Which blocks lie in the innermost element, no text element itself, that holds BODY_SHARE of the score: ratio times text, links left out."""
    score = [f * max(len(b[1]) - b[2], 0) for b, f in zip(found, fused)]
    enough, inside, depth = BODY_SHARE * sum(score), list(range(len(found))), 0
    while True:
        mass: dict[int, float] = defaultdict(float)
        for i in inside:
            path, around = found[i][0], found[i][4]
            if depth < len(around) - 1 and tag_of(path[depth]) not in TEXTUAL:  # an element that only holds text is no body
                mass[around[depth]] += score[i]
        best = max(mass, key=mass.get, default=None)
        if best is None or mass[best] < enough:
            break
        inside = [i for i in inside if depth < len(found[i][4]) and found[i][4][depth] == best]
        depth += 1
    chosen = set(inside)
    return [i in chosen for i in range(len(found))]


def main_text(html: str | None) -> str:
    """The main text of a page: its content blocks in page order, one a line; empty if it has none."""
    found = blocks(html or "")
    inner, outer = [b for b in found if b[3]], [b for b in found if not b[3]]
    marked = bool(inner) and (not outer or fused_ratios(inner)[1] >= ARTICLE_SHARE * fused_ratios(outer)[1])
    if marked:
        found = inner
    if not found:
        return ""
    size, linked, score = defaultdict(int), defaultdict(int), defaultdict(list)
    fused, typical = fused_ratios(found)
    body = [True] * len(found) if marked else body_of(found, fused)
    around = [i for i, inside in enumerate(body) if not inside]
    if around:  # what lies outside takes nothing from the text it lies next to
        fused[around] = fused_ratios([found[i] for i in around])[0]
    for (path, text, links, *_), f, inside in zip(found, fused, body):
        size[path] += len(text)
        linked[path] += min(links, len(text))
        score[path, inside].append(f)
    shares = {p: float(np.mean(s)) / typical for p, s in score.items()}
    least = least_share(np.array(list(shares.values())))

    def stays(path: tuple[str, ...], inside: bool) -> bool:
        if linked[path] > 0.5 * size[path]:
            return False
        if inside:
            return shares[path, True] >= least or (bool(path) and tag_of(path[-1]) in TEXTUAL)
        return shares[path, False] >= min(OUTSIDE * least, ENOUGH)

    keep = [stays(b[0], inside) for b, inside in zip(found, body)]
    for i in range(len(found) - 2, -1, -1):  # a heading stays with what follows it
        if found[i][0] and tag_of(found[i][0][-1]) in HEADINGS and linked[found[i][0]] <= 0.5 * size[found[i][0]]:
            keep[i] = keep[i] or keep[i + 1]
    return "\n".join(b[1] for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text, the main text, and n_chars, its code points.

    A null or empty html gives an empty text. Rows stand alone, so repeats, ties and empty tables need
    nothing; input columns named text or n_chars are replaced, all others pass.
    """
    kept = without(pages, *(c for c in ("text", "n_chars") if c != html_col.lower()))
    at = [c.lower() for c in kept.columns].index(html_col.lower())
    schema = T.StructType([*kept.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                texts = [main_text(h) for h in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return in_small_batches(kept).mapInArrow(run, schema)
