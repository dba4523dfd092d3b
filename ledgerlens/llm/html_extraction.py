"""Main text of a web page by the maximum-scoring contiguous region.

A page is a row of words and tags. A word scores the log odds that words in
its surroundings (innermost block, link or not, in a nav, footer or the like)
are content. In an element whose class, id or role has a word of MARKS, it
scores the log odds of that word instead; such a name does not reach into an
article or main element, nor count if the element holds most of the page. A tag scores below zero by how rarely it is met inside content.
The weights are learned from labelled pages: those that mark their content
with an article or main element, which is not itself a feature. A linear scan
finds the contiguous region with the largest sum; blocks of the region whose
surroundings are negative (a notice or an advert in the article) are left out,
and inside an article or main element they cost nothing, however long. What
stands under a heading such as "3 comments", up to the next heading of its
rank or the end of the element around it, scores as an element named so.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import by_value

by_value(__name__)

SAMPLE_PAGES = 2_000  # bound of the sample of labelled pages the weights are fitted on
TAG_FLOOR = -0.05  # a tag never scores above this
WORD_CLIP = 4.0
MOST = 2 / 3  # of a page's words outside links and nav, footer and the like: a named element with more is the page
APART_RANGE = (-1.5, -0.5)

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|iframe|title|textarea)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<tag>/?[a-z][a-z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<odd>/?[a-z][a-z0-9:-]*)[^>]*>"
    r"|<[!?/][^>]*(?:>|\Z)", re.IGNORECASE | re.DOTALL)
NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
SPACE = re.compile(r"\s+")

# names from the HTML standard
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
          "kbd", "label", "mark", "q", "ruby", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
          "time", "tt", "u", "var", "wbr", "img", "br",
          "math", "mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder",
          "mover", "munderover", "mmultiscripts", "mprescripts", "mtable", "mtr", "mtd", "mspace", "mstyle", "mpadded",
          "mphantom", "menclose", "merror", "semantics"}
#: Elements without text of the page; one that is not closed ends where a block begins or ends.
SILENT = {"svg", "object", "select", "button", "template", "annotation", "annotation-xml"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
          "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p",
          "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: A block that opens ends an open paragraph or an item of its own kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
CONTENT = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}  # an id or class there names the text below
#: Elements, and parts of class, id and role names, that are common around an article; the weight of each name is learned.
APART = {"nav", "footer", "aside", "form", "dialog", "menu"}
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "bar", "breadcrumb", "breadcrumbs",
         "comment", "comments", "commentlist", "consent", "contentinfo", "cookie", "cookies", "copyright", "disclaimer", "disqus",
         "footer", "gdpr", "header", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter",
         "notice", "notices", "notification", "overlay", "pager", "pagination", "popup", "promo", "promotion", "recommended",
         "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "sidenav", "signup", "skip", "social",
         "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget", "widgets", "alert", "complementary", "toc"}
#: Headings of reader comments.
COMMENTS = re.compile(r"(?:(?:\d+|all|reader|user|your) )?(?:comments?|replies)(?: ?\(\d+\))?:?|(?:leave|post|add|write) a (?:comment|reply)"
                      r"|\d+ (?:comments?|responses?|thoughts?) (?:on|to)\b.*|join the (?:discussion|conversation)", re.IGNORECASE | re.DOTALL)
JOINERS = {"with", "has", "no", "without"}


def marked(rest: str) -> str:
    """The first word of MARKS in the names of an element."""
    for m in NAMES.finditer(rest):
        parts = re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", m[1] or m[2] or m[3] or "").lower())
        for i, p in enumerate(parts):
            if p in MARKS and (i == 0 or parts[i - 1] not in JOINERS):
                return p
    return ""


def silent(page: str, marks: list[re.Match]) -> dict[int, tuple[int, int]]:
    """First mark of each silent element -> the mark and the place that follow it."""
    ends: dict[int, tuple[int, int]] = {}
    opened: dict[str, list[int]] = {}
    names = [(m["tag"] or m["odd"] or "").lower() for m in marks]
    for k, name in enumerate(names):
        if name in SILENT:
            if (marks[k]["rest"] or "").endswith("/") and name == "svg":
                ends[k] = k + 1, marks[k].end()
            else:
                opened.setdefault(name, []).append(k)
        elif opened.get(name[1:]) and name[0] == "/":
            ends[opened[name[1:]].pop()] = k + 1, marks[k].end()
    loose = {k for own in opened.values() for k in own}
    after = len(marks), len(page)
    for k in range(len(marks) - 1, -1, -1) if loose else ():
        if k in loose:
            ends[k] = after
        elif names[k].lstrip("/") in BLOCKS:
            after = k, marks[k].start()
    return ends


def scan(page: str) -> list[tuple]:
    """("tag", name), ("block",) where a block begins or ends, ("gap",) for a
    line break, and ("text", raw, place, inside); place: (innermost block, in a
    link, apart by an element, word of MARKS around it or none); inside an
    article or main element or not."""
    parts = list(_parts(page))
    words: Counter = Counter()  # of the page (none), and of each named element
    for part in parts:
        if part[0] == "text" and part[2] is not None and not part[2][1] and not part[2][2]:
            n = len(part[1].split())
            words[None] += n
            words.update({mark: n for mark in part[2][3]})
    least = MOST * words[None]

    def name(chain):
        return next((word for at, word in reversed(chain) if words[at, word] <= least), "")

    return [(*part[:2], (*part[2][:3], name(part[2][3])), part[3]) if part[0] == "text" and part[2] is not None else part
            for part in parts]


def _parts(page: str) -> Iterator[tuple]:
    """As scan, but with the names around a place as (element, word of MARKS)."""
    stack: list[tuple[str, bool, bool, tuple]] = []  # name, apart, content, names
    under: list[tuple[int, str, tuple]] = []  # headings of comments: depth around them, rank, name
    at = 0

    def place():
        block = next((n for n, *_ in reversed(stack) if n not in INLINE), "")
        link = any(n == "a" for n, *_ in stack)
        names = (*(stack[-1][3] if stack else ()), *(name for *_, name in under))
        return (block if block not in CONTENT else "div", link, bool(stack) and stack[-1][1], names)

    def close(kept):
        del stack[kept:]
        under[:] = [u for u in under if u[0] <= kept]

    marks = list(MARKUP.finditer(page))
    ends, upto = silent(page, marks), 0
    for k, m in enumerate(marks):
        if k < upto:  # in a silent element
            continue
        if m.start() > at and page[at:m.start()].strip():
            yield "text", page[at:m.start()], place(), bool(stack) and stack[-1][2]
        elif m.start() > at:
            yield "text", page[at:m.start()], None, False
        at = m.end()
        name = (m["tag"] or m["odd"] or "").lower()
        if not name:
            continue
        if k in ends:
            upto, at = ends[k]
            continue
        yield "tag", name
        if name[0] == "/":
            name = name[1:]
            if name not in INLINE:
                yield ("block",)
            last = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            if last >= 0:
                close(last)
            continue
        if name == "br":
            yield ("gap",)
        if name not in INLINE:
            yield ("block",)
            # a paragraph ends where a block begins, with the inline elements left open in it
            opened = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in INLINE), -1)
            if opened >= 0 and (stack[opened][0] == "p" or stack[opened][0] in CLOSES.get(name, ())):
                close(opened)
        if name in HEADINGS:
            under[:] = [u for u in under if u[0] < len(stack) or u[1] < name]
            end = next((x for x in marks[k + 1:k + 20] if (x["tag"] or "").lower() == f"/{name}"), None)
            if name != "h1" and end and COMMENTS.fullmatch(SPACE.sub(" ", html.unescape(MARKUP.sub(" ", page[at:end.start()]))).strip()):
                under.append((len(stack), name, (k, "comments")))
        if name in VOID or (m["rest"] or "").endswith("/"):
            continue
        outer = stack[-1] if stack else ("", False, False, ())
        own = name in APART or (name == "header" and not outer[2])
        names = () if name in CONTENT else outer[3]
        if not own and m["rest"] and name not in CONTENT and name not in HEADINGS and name not in ("html", "body", "header"):
            word = marked(m["rest"])
            names = (*names, (k, word)) if word else names
        stack.append((name, outer[1] or own, outer[2] or name in CONTENT, names))
    if page[at:].strip():
        yield "text", page[at:], place(), bool(stack) and stack[-1][2]


def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (feature, inside content) over the labelled pages of a task."""
    seen: Counter = Counter()
    for batch in batches:
        for page in batch.column(0).to_pylist():
            inside = False
            for part in scan(page):
                if part[0] == "text" and part[2] is not None:
                    inside = part[3]
                    seen[_word(part[2]), inside] += len(part[1].split())
                elif part[0] == "tag":
                    seen[f"<{part[1]}", inside] += 1
    rows = [(k, inside, n) for (k, inside), n in seen.items()]
    key, inside, n = zip(*rows) if rows else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(inside, pa.bool_()), pa.array(n, pa.int64())],
                                     names=["feature", "inside", "n"])


def _word(place: tuple) -> str:
    return f"@{place[3]}" if place[3] and not place[2] else f"{place[0]}|{int(place[1])}|{int(place[2])}"


def fit(pages: DataFrame, text: str = "html", sample: int = SAMPLE_PAGES) -> dict[str, float]:
    """Feature weights from at most about ``sample`` labelled pages, drawn by a
    hash of the whole row, so that copies of a page under other keys are drawn
    one by one. Features seen under 20 times are left to the prior, so those
    that reach the driver are at most a twentieth of the sample's words and tags."""
    body = pages.select(F.col(text).cast("string").alias("page"), F.xxhash64(*[F.col(f"`{c}`") for c in pages.columns]).alias("draw"))
    body = body.where(F.col("page").rlike("(?i)<(article|main)\\b"))
    total = body.count()
    if total > sample:
        body = body.where(F.pmod("draw", F.lit(1 << 30)) < int((1 << 30) * sample / total))
    counts = body.select("page").mapInArrow(learn, "feature string, inside boolean, n bigint").groupBy("feature").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("yes"),
        F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("no")).where("yes + no >= 20")
    weights = {}
    for r in counts.collect():
        prior = _prior(r["feature"])
        odds = math.log((r["yes"] + 20 * prior) / (r["no"] + 20 * (1 - prior)))
        weights[r["feature"]] = max(-WORD_CLIP / 2, min(WORD_CLIP, odds))
    return weights


def _prior(feature: str) -> float:
    if feature[0] == "<":
        return 0.45
    if feature[0] == "@":
        return 0.2
    _, link, apart = feature.rsplit("|", 2)
    return 0.02 if apart == "1" else 0.25 if link == "1" else 0.8


def _weight(weights: dict[str, float], feature: str) -> float:
    known = weights.get(feature)
    if known is None:
        p = _prior(feature)
        known = math.log(p / (1 - p))
    return known


def word_weight(weights: dict[str, float], place: tuple) -> float:
    """Words apart from the article by an element never count as content,
    however often a labelled page had such a block inside its article element;
    those apart by a name do if its weight says so. Outside article and main
    elements a few words of either kind do not end an article that goes on below."""
    w = _weight(weights, _word(place))
    if place[2]:
        return max(APART_RANGE[0], min(w, APART_RANGE[1]))
    return max(APART_RANGE[0], w) if place[3] else w


def extract(page: str | None, weights: dict[str, float]) -> str:
    """Main text: blocks of the best region, one a line."""
    parts = scan(page or "")
    best, best_from, best_to, run, start = 0.0, 0, 0, 0.0, 0

    def left_out(place):
        return (place[2] or place[3]) and word_weight(weights, place) < 0

    for i, part in enumerate(parts):  # maximum-scoring contiguous subsequence
        if part[0] == "text" and part[2] is not None:
            if part[3] and left_out(part[2]):
                continue  # not charged to the article around it
            score = word_weight(weights, part[2]) * len(part[1].split())
        elif part[0] == "tag":
            score = min(TAG_FLOOR, 0.1 * _weight(weights, f"<{part[1]}"))
        else:
            continue
        if run <= 0:
            run, start = 0.0, i
        run += score
        if run > best:
            best, best_from, best_to = run, start, i + 1
    blocks, block = [], []

    def end():
        line = SPACE.sub(" ", html.unescape("".join(block))).strip()
        block.clear()
        if line:
            blocks.append(line)

    for part in parts[best_from:best_to]:
        if part[0] == "block":
            end()
        elif part[0] == "gap":
            block.append(" ")
        elif part[0] == "text" and (part[2] is None or not left_out(part[2])):
            block.append(part[1])
    end()
    return "\n".join(blocks)


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html",
              weights: dict[str, float] | None = None, sample: int = SAMPLE_PAGES) -> DataFrame:
    """(key, url, text, n_chars) of every row.

    A null, empty or unreadable page has the empty text. Repeated rows are
    extracted each; empty tables give no rows; other columns are not read; no
    page is cut. Character references are decoded, white space in a block
    becomes one space, blocks are joined by one line feed."""
    weights = fit(pages, text, sample) if weights is None else weights
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("page"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("key", "url")]

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p.as_py(), weights) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                                             names=["key", "url", "text"])

    out = rows.mapInArrow(extracted, f"key {kinds[0]}, url {kinds[1]}, text string")
    return out.select(F.col("key").alias(key), F.col("url").alias(url), "text", F.char_length("text").cast("long").alias("n_chars"))
