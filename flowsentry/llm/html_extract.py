"""Main text of web pages by the maximum-scoring subsequence of tokens.

A page is read as one sequence of tokens: tags and words.  Each token has a
weight by its kind.  A word's kind is the block it stands in, whether it is in
a link, and whether a boilerplate element encloses it; a tag's kind is its
name.  One linear scan finds the contiguous run with the largest sum: the
content region.  Its blocks, without those inside boilerplate elements, are
the text.

The weights are learnt from labelled pages: pages that say themselves where
their content is, by an ``article`` or ``main`` element.  Spark counts over a
sample of about ``fit_pages`` of them how often each kind is inside and
outside; a word's weight is the log odds of its kind, a tag's the same but
never positive, so words pull the region open and tags push it shut.  Words of
boilerplate inside the content weigh nothing (they are left out anyway).  Kinds
that no labelled page shows keep a default (words positive, tags and words in
boilerplate negative); without labelled pages all do.

An element is boilerplate by its own name (nav, footer, ...), by being hidden,
or by a word in the class, id or role its author gave it.  Such a word says
nothing about html, body, main and article, nor about an element around the
content element (the largest main, else article) or around most words;
articles that stand in smaller elements named as boilerplate are not it.  Inside
the content only a whole name counts (``share``, not ``share-of-votes``), and a
header is content.  Names of comments count for any article but the content
element, and for any size.

Elements that hold no prose (scripts, styles, forms, ...) and comments are
never tokens; a form around the content or most words is no such element.  The
tags of a formula are no tokens, its text is.  Character references are decoded; white space inside a block
becomes one space; blocks are joined by an empty line.  Null html is the empty
page, and a page without a positive run has an empty text.  Broken markup is
read as far as it goes: an element never closed ends with its parent.
Repeated rows are answered row by row; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, unit_hash

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|select|textarea|object|title|annotation(?:-xml)?)(?=[\s/>])[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<svg(?=[\s/>])(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+(?:(?<=/)>|>.*?(?:</svg\s*>|\Z))"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>"
    r"|<[!?][^>]*+>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD_SPLIT = re.compile(r"[^a-z0-9]+")

# Element names of HTML, and the names pages give to boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr q "
                   "s samp small span strike strong sub sup time tt u var wbr".split())
MATH = frozenset("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow "
                 "ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
#: Elements that hold one block or the parts of one, not a text of several.
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption".split())
#: A tag inside an element that says it is the content costs no more than this.
INSIDE = -0.1
CONTENT = frozenset(("article", "main"))
NO_PROSE = frozenset(("form", "button", "head", "dialog", "menu", "fieldset"))
BOILERPLATE = frozenset(("nav", "footer", "aside"))
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notification alert popup modal overlay newsletter subscribe subscription signup login sidebar aside menu nav "
    "navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead toolbar share sharing social related "
    "recommended comment comments disqus reply replies search widget copyright skip".split())


#: Names of what others wrote, which may well be longer than the content.
OTHERS = frozenset("comment comments disqus reply replies".split())


def _attributes(raw: str) -> dict:
    found: dict = {}
    for m in _ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), (m[2] or "").strip("\"'").lower())
    return found


def _names(attributes: dict) -> set:
    return {n for key in ("class", "id", "role") for n in attributes.get(key, "").split()}


def _hint(name: str, raw: str, in_content: bool, around: bool, most: bool) -> bool:
    """Whether an element is boilerplate by its name or by the names its author
    gave it; ``around``: it is or encloses the content element; ``most``: it
    encloses most words."""
    if name in ("form", "fieldset"):
        if not (around or most):
            return True
    elif name in BOILERPLATE or name in NO_PROSE or (name == "header" and not in_content and not around):
        return True
    if not raw or raw == "/":
        return False
    attributes = _attributes(raw)
    if name not in ("html", "body") and ("hidden" in attributes or re.search(r"display\s*:\s*none", attributes.get("style", ""))):
        return True
    if around or name in ("html", "body"):
        return False
    names = _names(attributes)
    if most or name in CONTENT:
        return not names.isdisjoint(OTHERS)
    if in_content:
        return not names.isdisjoint(HINTS - {"header"})
    return any(w in HINTS for n in names for w in _WORD_SPLIT.split(n))


def _judged(elements: list, own: list):
    """(boilerplate, in content) of each element, from (name, attributes,
    parent) and the number of words right inside it; parents come first."""
    words = list(own)
    # words of lists of links, footers and the like don't count for what most words are in
    plain = [0 if e[0] in BOILERPLATE or (e[0] in NO_PROSE and e[0] not in ("form", "fieldset")) else 1 for e in elements]
    for k in range(len(elements) - 1, 0, -1):
        words[elements[k][2]] += words[k] * plain[k]
    aside = [False] * len(elements)    # in an element named as boilerplate, whole
    if any(e[0] == "article" for e in elements):
        for k, (name, raw, parent) in enumerate(elements[1:], 1):
            aside[k] = aside[parent] or not plain[k] or bool(
                raw and name not in CONTENT and name not in ("html", "body") and 2 * words[k] <= words[0]
                and not HINTS.isdisjoint(_names(_attributes(raw))))
    content = max((k for k, e in enumerate(elements) if words[k] and (e[0] == "main" or (e[0] == "article" and not aside[k]))), default=None,
                  key=lambda k: (elements[k][0] == "main", words[k], -k))
    around = set()
    while content is not None:
        around.add(content)
        content = elements[content][2]
    judged = [(False, False)]
    for k, (name, raw, parent) in enumerate(elements[1:], 1):
        bad, inside = judged[parent]
        bad = bad or _hint(name, raw, inside, k in around, 2 * words[k] > words[0])
        judged.append((bad, inside or (name in CONTENT and not bad)))
    return judged


def _open_ended(m) -> bool:
    """Whether a match that should hold its element or comment whole has not
    come to its end."""
    if m[0].startswith("<!--"):
        return not m[0].endswith("-->")
    name = m[1] or ("svg" if not m[3] and not m[6] and m[0][1:4].lower() == "svg" and not m[0].endswith("/>") else "")
    return bool(name) and not re.search(rf"</{name}\s*+>\Z", m[0][-len(name) - 200:], re.I)


def _parsed(page: str):
    """The tokens of a page (see :func:`tokens`) with the number of the element
    they are in, and the elements as (name, attributes, parent, last inside).

    Time grows with the page whatever its markup: all tags end with a ``>``, so
    none is looked for behind the last one; an element knows its nearest block;
    and an end tag looks for its element only where one is open, and closes all
    that it passes."""
    stack: list[tuple] = []            # (name, number of the element, linked, holder)
    is_open: dict = {}
    elements, own = [("", "", None)], [0]
    out, at, block = [], 0, 0

    def text(raw: str) -> None:
        if not raw or raw.isspace():
            if raw:
                out.append(("words", "", 0, (raw, block, True, False, -1)))
            return
        plain = html.unescape(raw) if "&" in raw else raw
        linked, holder = (stack[-1][2], stack[-1][3]) if stack else (False, "body")
        element, n = stack[-1][1] if stack else 0, len(plain.split())
        own[element] += n
        out.append(("words", "w:" + holder + (":link" if linked else ""), n, (plain, block, element)))

    def leave() -> str:
        name = stack.pop()[0]
        is_open[name] -= 1
        return name

    last = page.rfind(">") + 1
    for m in _TOKEN.finditer(page, 0, last):
        text(page[at:m.start()])
        at = m.end() if m.end() < last or not _open_ended(m) else len(page)
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        close, attributes = bool(m[2] or m[5]), m[4] or m[7] or ""
        inline = name in INLINE or name in MATH
        if not inline:
            block += 1
        if name not in MATH:
            out.append(("tag", "t:" + ("/" if close else "") + name, 1, stack[-1][1] if stack else 0))
        if name == "br":
            out.append(("words", "", 0, (" ", block, True, False, -1)))
        if close:
            if is_open.get(name):
                while leave() != name:
                    pass
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if not inline:
            while stack and (stack[-1][0] in INLINE or stack[-1][0] in MATH or (stack[-1][0] == "p")):
                leave()                # a new block ends an open paragraph and its inline elements
            if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                leave()
        elements.append((name, attributes, stack[-1][1] if stack else 0))
        own.append(0)
        is_open[name] = is_open.get(name, 0) + 1
        stack.append((name, len(elements) - 1, (bool(stack) and stack[-1][2]) or name == "a",
                      name if not inline else stack[-1][3] if stack else "body"))
    rest = page[at:]
    text(rest[:rest.find("<!--")] if "<!--" in rest else rest)
    judged = _judged(elements, own)
    for k, (what, kind, n, info) in enumerate(out):
        if what == "tag":
            out[k] = (what, kind, n, judged[info][1])
        elif len(info) == 3:
            bad, content = judged[info[2]]
            out[k] = (what, ("w:inner" if content else "w:boilerplate") if bad else kind, n, (info[0], info[1], bad, content, info[2]))
    inside = list(range(len(elements)))
    for k in range(len(elements) - 1, 0, -1):
        inside[elements[k][2]] = max(inside[elements[k][2]], inside[k])
    return out, [(*e, x) for e, x in zip(elements, inside)]


def tokens(page: str):
    """The tokens of a page, in order: ("tag", kind, 1, in content) and
    ("words", kind, number of words, (text, block, boilerplate, labelled
    content, element)).  ``block`` numbers the block a text belongs to."""
    return _parsed(page)[0]


def kind_counts(page: str) -> dict:
    """For a labelled page: each kind's number of tokens inside and outside the
    content; empty for a page that labels nothing."""
    found: dict = {}
    seq = tokens(page)
    if not any(t[0] == "words" and t[3][3] and not t[3][2] for t in seq):
        return found
    inside = False
    for what, kind, n, info in seq:
        if what == "words":
            if not n or kind == "w:inner":
                continue
            inside = info[3] and not info[2]
        row = found.setdefault(kind, [0, 0])
        row[0 if inside else 1] += n
    return found


class Weights:
    """Token weights: learnt ones by kind, defaults for the rest."""

    def __init__(self, counts: dict):
        total = [sum(c[k] for c in counts.values()) + 1 for k in (0, 1)]
        self.known = {}
        for kind, (a, b) in counts.items():
            odds = math.log((a + 0.5) / total[0]) - math.log((b + 0.5) / total[1])
            self.known[kind] = max(-4.0, min(4.0, odds)) if kind[0] == "w" else max(-4.0, min(-0.1, odds))

    def of(self, kind: str) -> float:
        w = self.known.get(kind)
        if w is not None:
            return w
        if kind[0] == "t":
            return -1.0
        return 0.0 if kind == "w:inner" else -1.0 if kind == "w:boilerplate" or kind.endswith(":link") else 1.0


def best_run(scores: list[float]):
    """(start, end) of the contiguous run of the largest sum, None if no sum is
    over 0: one pass."""
    best = total = 0.0
    start, region = 0, None
    for k, score in enumerate(scores):
        if total <= 0.0:
            total, start = 0.0, k
        total += score
        if total > best:
            best, region = total, (start, k + 1)
    return region


def _whole_container(seq: list, elements: list, region: tuple) -> tuple:
    """The run grown to all words of the smallest element for several blocks that
    encloses its words, unless that is the page as a whole: short blocks after the best run
    belong to it where they stand in the same element."""
    held = [info[4] for what, _, n, info in seq[region[0]:region[1]] if what == "words" and n and not info[2]]
    if not held:
        return region
    around, end = min(held), max(held)
    while elements[around][3] < end or elements[around][0] in INLINE or elements[around][0] in MATH or elements[around][0] in PARTS:
        around = elements[around][2]
    if elements[around][0] in ("", "html", "body"):
        return region
    start, stop = region
    for k, (what, _, n, info) in enumerate(seq):
        if what == "words" and n and around <= info[4] <= elements[around][3]:
            start, stop = min(start, k), max(stop, k + 1)
    return start, stop


def extract(page: str | None, weights: Weights) -> str:
    """The text of the best contiguous run of tokens, with the blocks around it
    that stand in the same element."""
    seq, elements = _parsed(page or "")
    region = best_run([(max(weights.of(kind), INSIDE) if what == "tag" and info else weights.of(kind)) * n if n else 0.0
                       for what, kind, n, info in seq])
    if region is None:
        return ""
    region = _whole_container(seq, elements, region)
    blocks: dict[int, list[str]] = {}
    for what, _, _, info in seq[region[0]:region[1]]:
        if what == "words" and (not info[2] or not info[0].strip()):
            blocks.setdefault(info[1], []).append(info[0])
    joined = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n\n".join(b for b in joined if b)


def _count(batches):
    for batch in batches:
        total: dict = {}
        for page in batch.column("html"):
            for kind, (a, b) in kind_counts(page.as_py() or "").items():
                row = total.setdefault(kind, [0, 0])
                row[0] += a
                row[1] += b
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array([v[0] for v in total.values()], pa.int64()),
             pa.array([v[1] for v in total.values()], pa.int64())], names=["kind", "inside", "outside"])


def learn(pages: DataFrame, fit_pages: int = 3000) -> Weights:
    """Weights from a sample of about ``fit_pages`` pages, by a hash of the id."""
    prepare(pages.sparkSession)
    n = pages.count()
    chosen = pages.where(unit_hash("page_id", seed=3) < fit_pages / max(n, 1)).select("html")
    # one row per kind of element that the chosen pages hold
    rows = (chosen.mapInArrow(_count, "kind string, inside long, outside long").groupBy("kind")
            .agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect())
    return Weights({r.kind: (r.inside, r.outside) for r in rows})


def _extract(shared):
    def run(batches):
        for batch in batches:
            texts = [extract(page.as_py(), shared.value) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
    return run


def extract_pages(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = prepare(pages.sparkSession)
    shared = spark.sparkContext.broadcast(weights or learn(pages))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(
        _extract(shared), "page_id long, url string, text string, n_chars long")
