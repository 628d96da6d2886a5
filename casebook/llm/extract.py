"""Operator 5: main text of HTML pages by the maximum-scoring subsequence.

A page is a sequence of tags and words.  Words score above zero, tags below, by
weights learnt from labelled pages (those that mark their content with
<article> or <main>); one linear scan finds the contiguous region of the largest
sum.  The blocks of that region, without the parts that are never article text,
are the main text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import bounded_batches, pick

#: Labelled pages the weights are learnt from, at most (the first in md5 order), and
#: characters of them together: a page that doesn't fit any more is left out.
TRAIN_PAGES, TRAIN_CHARS = 2_000, 20_000_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|title)(?=[\s/>])[^>]*?(?:/>|(?<!/)>.*?(?:</\1\s*>|\Z))"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
NAME_WORD = re.compile(r"[a-z]+")

BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot
    th thead tr ul""".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never part of an article's text.
NEVER = frozenset("aside button datalist dialog footer form head menu nav noscript object select".split())
#: Words of class, id and role attributes that mark such parts.
MARKS = frozenset("""ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments
    complementary consent contentinfo cookie cookies disqus feedback footer login masthead menu modal nav navbar navigation
    newsletter notice notices pagination popup promo promotion related replies reply respond search share sharing sidebar
    signup social sponsor sponsored subscribe toolbar widget""".split())
#: Words of places and shapes: a name made of marks and of these marks such a part too
#: ("comments-area"), any other name with a mark in it doesn't ("social-proof").
PLACES = frozenset("""area bar block body bottom box button buttons container entry form global group holder icons id inner item
    items label left link links list message outer panel primary right row secondary section site slot text top unit wrap
    wrapper""".split())
CONTENT = frozenset(("article", "main"))
#: Of NEVER, what may hold a whole page: a form around it, a head that isn't closed.
WRAPPERS = frozenset(("form", "head"))


@dataclass
class Weights:
    """Score of a word, and of a tag: of its name with its classes, of its name, or,
    if it wasn't met, of any block tag (an inline tag costs a quarter)."""

    word: float = 1.0
    tags: dict[str, float] = field(default_factory=dict)
    other: float = -2.0

    def tag(self, name: str, marks: tuple[str, ...]) -> float:
        other = self.other if name in BLOCKS else self.other / 4
        return min([self.tags.get(f"{name}.{m}", 0.0) for m in marks] + [self.tags.get(name, other)])


def marked(name: str) -> bool:
    """Whether a class, id or role, taken whole, names a part that is no article text."""
    words = NAME_WORD.findall(name)
    return not MARKS.isdisjoint(words) and all(w in MARKS or w in PLACES for w in words)


def events(html: str):
    """(kind, name, marks, marked, text) in page order; kind: 'open', 'close' or 'text'.
    marks: the words of the tag's class, id and role; marked: one of those, taken whole,
    names a part that is no article text."""
    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at:
            yield "text", "", (), False, html[at:m.start()]
        at = m.end()
        if m[3]:
            name = m[3].lower()
            if m[2]:
                yield "close", name, (), False, ""
            else:
                marks, out = (), False
                if "=" in m[4]:
                    names = " ".join(NAMES.findall(m[4])).lower()
                    marks = tuple(NAME_WORD.findall(names))
                    out = not MARKS.isdisjoint(marks) and any(marked(x) for x in names.split())
                yield "open", name, marks, out, ""
                if m[4].endswith("/") and name not in VOID:
                    yield "close", name, (), False, ""
    if at < len(html):
        yield "text", "", (), False, html[at:]


@dataclass
class Piece:
    """A run of text, or a tag: score, block number, text, element path facts."""

    score: float
    block: int
    text: str
    content: int   # the <article> or <main> it is in, 0 without
    never: bool
    heading: bool = False


def wrappers(seen: list) -> set[int]:
    """Numbers of the events that open an element with most of the page's words and,
    if the page has any <article>, <main> or <h1>, with one of them inside."""
    at, stack, words, heads = {}, [], 0, 0
    spans = []  # event, words and heads in it

    def close():
        i = stack.pop()[1]
        spans.append((i, words - at[i][0], heads - at[i][1]))

    for i, (kind, name, _, _, text) in enumerate(seen):
        if kind == "text":
            words += len(text.split())
        elif kind == "open":
            if name == "p" or name in BLOCKS:
                while stack and stack[-1][0] == "p":
                    close()
            if name not in VOID:
                stack.append((name, i))
                at[i] = (words, heads)
            heads += name in CONTENT or name == "h1"
        elif any(x[0] == name for x in stack):
            while stack[-1][0] != name:
                close()
            close()
    while stack:
        close()
    return {i for i, w, h in spans if 2 * w > words and (h or not heads)}


def pieces(html: str, weights: Weights, leave_out: bool = True) -> list[Piece]:
    """The page as scored pieces; without ``leave_out`` no part is marked as never text."""
    out: list[Piece] = []
    stack: list[tuple[str, int, bool]] = []  # name, content, never
    block, contents = 0, 0
    seen = list(events(html))
    whole = wrappers(seen) if leave_out else set()
    for i, (kind, name, marks, out_mark, text) in enumerate(seen):
        content, never = (stack[-1][1], stack[-1][2]) if stack else (0, False)
        if kind == "text":
            n = len(text.split())
            # parts that are never article text are no reason to stay in or to leave
            out.append(Piece(0.0 if never else weights.word * n, block, text, content, never,
                             any(x[0] in HEADINGS for x in stack[-3:])))
            continue
        if name in BLOCKS:
            block += 1
        if kind == "open":
            if name == "p" or name in BLOCKS:
                while stack and stack[-1][0] == "p":
                    stack.pop()
                content, never = (stack[-1][1], stack[-1][2]) if stack else (0, False)
            # what holds most of the page is no part of it that could be left out, whatever its class
            own = leave_out and ((name in NEVER and not (name in WRAPPERS and i in whole)) or (name == "header" and not content)
                                 or (out_mark and name not in ("html", "body") and name not in CONTENT and i not in whole))
            if name in CONTENT:
                contents += 1
                content = content or contents
            score = 0.0 if never or own else weights.tag(name, marks)
            if name not in VOID:
                stack.append((name, content, never or own))
            out.append(Piece(score, block, " " if name == "br" else "", 0 if name in CONTENT else content, never or own))
        else:
            if any(s[0] == name for s in stack):
                while stack:
                    gone = stack.pop()
                    if gone[0] == name:
                        break
            out.append(Piece(0.0 if never else weights.tag(name, ()), block, "", 0 if name in CONTENT else content, never))
    return out


def best_region(scores) -> tuple[int, int]:
    """[start, end) of the contiguous run of the largest sum (the first of equal
    ones; empty if no score is above zero)."""
    best, lo, hi, total, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, lo, hi = total, start, i + 1
    return lo, hi


def blocks_text(parts: list[Piece], between: str) -> str:
    out, last, held = [], None, []
    for p in parts:
        if p.block != last:
            out.append("".join(held))
            last, held = p.block, []
        if p.text and not p.never:
            held.append(p.text)
    out.append("".join(held))
    done = (" ".join(entities.unescape(x).split()) for x in out)
    return between.join(x for x in done if x)


def main_text(html: str, weights: Weights) -> str:
    """The main text of a page: the best region, widened to whole blocks and the
    headings right before it, and to all of each <article> or <main> with words in it;
    blocks are joined by an empty line."""
    parts = pieces(html, weights)
    lo, hi = best_region([p.score for p in parts])
    if lo == hi:
        return ""
    inside = {p.content for p in parts[lo:hi] if p.text.strip() and not p.never} - {0}
    if not parts[lo].content:
        while lo and parts[lo - 1].block == parts[lo].block:
            lo -= 1
        for i in range(lo - 1, -1, -1):
            if parts[i].text.strip() and not parts[i].never:
                if not parts[i].heading:
                    break
                lo = i
    first, last = parts[lo].block, parts[hi - 1].block
    return blocks_text([p for p in parts if first <= p.block <= last or p.content in inside], "\n\n")


def plain_text(html: str) -> str:
    """All visible text of a page, a line for each block."""
    return blocks_text(pieces(html, Weights(), leave_out=False), "\n")


def learn(pages: list[str]) -> Weights:
    """Weights from labelled pages: how much more often a word or tag stands outside
    of the marked content than in it (log ratio of the rates), words at least
    0.1 and tags at most -0.1.  Without labelled pages, the default weights."""
    inside, outside = Counter(), Counter()
    n_in = n_out = 0
    for html in pages:
        depth = 0
        for kind, name, marks, _, text in events(html):
            if name in CONTENT and kind == "close":
                depth = max(0, depth - 1)
            keys = ["#word"] * len(text.split()) if kind == "text" else [name, *(f"{name}.{m}" for m in set(marks))]
            (inside if depth else outside).update(keys)
            if depth:
                n_in += len(keys)
            else:
                n_out += len(keys)
            if name in CONTENT and kind == "open":
                depth += 1
    if not n_in or not n_out:
        return Weights()
    odds = {k: float(np.log((inside[k] + 0.5) / (n_in + 1) * (n_out + 1) / (outside[k] + 0.5)))
            for k in inside.keys() | outside.keys()}
    return Weights(max(0.1, odds.pop("#word", 1.0)), {k: min(-0.1, v) for k, v in odds.items()}, -2.0)


def fit(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", train_pages: int = TRAIN_PAGES,
        train_chars: int = TRAIN_CHARS) -> Weights:
    """Learn from a bounded sample of the pages that mark their content: the first
    ``train_pages`` rows in md5 order of the id, chosen by id and length before any page
    is fetched, less those whose characters no longer fit and repeated pages."""
    html = F.coalesce("html", F.lit(""))
    some = (pick(pages, id=id_col, html=html_col).where(F.col("html").rlike("(?i)<(article|main)\\b"))
            .select("id", F.xxhash64(html).alias("hash"), F.length("html").alias("chars"))
            .orderBy(F.md5(F.col("id").cast("string")), "id", "hash").limit(train_pages).collect())
    chosen, left = [], train_chars
    for r in dict.fromkeys((r["id"], r["hash"], r["chars"]) for r in some):
        if r[2] <= left:
            chosen.append((r[0], r[1], len(chosen)))
            left -= r[2]
    if not chosen:
        return Weights()
    ids = pages.sparkSession.createDataFrame(chosen, f"__id {dict(pages.dtypes)[id_col]}, __hash long, __place int")
    got = (pick(pages, id=id_col, html=html_col).join(F.broadcast(ids), F.col("id").eqNullSafe(F.col("__id")) & (F.xxhash64(html) == F.col("__hash")))
           .groupBy("__place").agg(F.first("html").alias("html")))
    return learn([r["html"] for r in sorted(got.collect(), key=lambda r: r["__place"])])


def extract(pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.  NULL html is an
    empty page; a page without a region has an empty text; a page is read whole,
    whatever its length."""
    bounded_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for pdf in batches:
            text = [main_text(h, shared.value) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": text,
                                "n_chars": [len(t) for t in text]})

    base = pick(pages, page_id=id_col, url=url_col, html=html_col).withColumn("html", F.coalesce("html", F.lit("")))
    return base.mapInPandas(run, "page_id long, url string, text string, n_chars long")
