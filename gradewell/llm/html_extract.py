"""Main text of web pages as a maximum-scoring run of tokens.

A page becomes a sequence of words and tags. Words score above zero and tags below, with weights
learnt from labelled pages: pages whose markup names the article (one ``article`` or ``main``
element) tell which words and tags lie inside. One linear scan finds the contiguous run with the
largest sum; its words, block by block, are the main text.

What is never part of an article, by element or by a name in its class, id or role (menus, page
headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments), and what is
hidden, scores nothing and gives no text, wherever it stands, unless it holds an ``article`` or
``main`` element. A name that only contains such a word (``has-sidebar``) drops nothing: the
element's begin and end score below zero, learnt by name, and so do those of elements that are kept
for the article they hold. A run inside a layout wrapper pays neither.

Character references are decoded; white space inside a block becomes one space; empty blocks go;
blocks are joined by one line break. A null page is empty and gives the empty text. Unclosed tags
end with their parent or, for paragraphs and list items, with the next block. A ``<`` that opens
no tag is text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>",
    re.DOTALL,
)
ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NO_DISPLAY = re.compile(r"display\s*:\s*none")
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")

# element names that fix what is a block, what has no content, what holds raw text
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
# what is not an article, by element and by the words of class, id and role
OUTSIDE = frozenset(
    "head script style noscript template iframe object svg math canvas audio video nav menu aside footer form button select "
    "textarea input label fieldset dialog title noembed noframes".split()
)
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe signup login share sharing social related recommended recommendations comment comments disqus reply "
    "replies respond contentinfo complementary search pagination pager toolbar widget".split()
)


@dataclass
class Weights:
    """Scores: ``word`` and ``link`` (a word inside a link) above zero, tags by name below; ``unseen`` for others."""

    word: float = 1.0
    link: float = 0.2
    tags: dict[str, float] = field(default_factory=dict)
    unseen: float = -0.2
    outside: float = -20.0  # begin or end of an element with an unseen name that contains an outside word


@dataclass
class Page:
    """Text runs and tags in page order.

    kind: "" for text, else the tag's name; value: words in the run, 0 for tags; block: number of
    the block a run belongs to; inside: within the labelled article; link: within a link.
    marks: (kind, begin, end) of elements whose begin and end score as ".name".
    """

    kind: list[str] = field(default_factory=list)
    value: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    block: list[int] = field(default_factory=list)
    inside: list[bool] = field(default_factory=list)
    link: list[bool] = field(default_factory=list)
    marks: list[tuple[str, int, int]] = field(default_factory=list)
    articles: int = 0


def boilerplate(name: str, attrs: str, in_article: bool) -> tuple[bool, list[str]]:
    """Whether the element is outside any article, and the kinds its begin and end score as."""
    if name in OUTSIDE or (name == "header" and not in_article):
        return True, [f".{name}"]
    if not attrs or name in ("html", "body", "main", "article"):
        return False, []
    drop, kinds = False, []
    for key, *values in ATTR.findall(attrs):
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and NO_DISPLAY.search(value)):
            drop = True
            kinds.append(".hidden")
        elif key in ("class", "id", "role"):
            for named in value.split():
                words = [w for w in SPLIT.split(named) if w and not w.isdigit()]
                if not OUTSIDE_WORDS.isdisjoint(words):
                    drop = drop or OUTSIDE_WORDS.issuperset(words)
                    kinds.append("." + "-".join(words))
    return drop, sorted(set(kinds))


def tokens(page: str) -> Page:
    """The page's words and tags outside boilerplate."""
    out = Page()
    stack: list[str] = []
    opened: list[tuple[list[str], int]] = []  # of each open element: its kinds, and where it began
    drops: list[int] = []  # depths of open elements that go unless they hold an article
    article = 0
    links = 0
    block = 0
    columns = (out.kind, out.value, out.text, out.block, out.inside, out.link)

    def put(text: str) -> None:
        if text:
            out.kind.append("")
            out.value.append(len(text.split()))
            out.text.append(text)
            out.block.append(block)
            out.inside.append(article > 0)
            out.link.append(links > 0)

    def put_tag(name: str) -> None:
        out.kind.append(name)
        out.value.append(0)
        out.text.append("")
        out.block.append(block)
        out.inside.append(article > 0)
        out.link.append(links > 0)

    def pop(depth: int) -> None:
        nonlocal article, links
        while len(stack) > depth:
            gone = stack.pop()
            kinds, begin = opened.pop()
            article -= gone in ("article", "main")
            links -= gone == "a"
            if drops and drops[-1] == len(stack):
                drops.pop()
                for column in columns:
                    del column[begin:]
                while out.marks and out.marks[-1][1] >= begin:
                    out.marks.pop()
            else:
                for kind in kinds:
                    out.marks.append((kind, begin, len(out.kind)))
                for kind in kinds:
                    put_tag(kind)

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if m is None:
            put(html.unescape(page[at:]))
            break
        put(html.unescape(page[at : m.start()]))
        at = m.end()
        if m["cdata"] is not None:
            put(m["cdata"])
        if m["name"] is None:
            continue
        name, closes = m["name"].lower(), bool(m["close"])
        if name in BLOCKS:
            block += 1
        elif name == "br":
            put(" ")
        if closes:
            if name in stack:
                pop(len(stack) - 1 - stack[::-1].index(name))
            put_tag(name)
            continue
        if name in BLOCKS:  # paragraphs and list items end where the next block begins
            for open_name, enders in (("p", BLOCKS), ("li", ("li",)), ("dt", ("dt", "dd")), ("dd", ("dt", "dd")), ("option", ("option",))):
                if name in enders and open_name in stack[-8:]:
                    depth = len(stack) - 1 - stack[::-1].index(open_name)
                    if not any(x in BLOCKS for x in stack[depth + 1 :]):
                        pop(depth)
        outside, kinds = boilerplate(name, m["attrs"], article > 0)
        if name in RAW and not m["attrs"].endswith("/"):
            stop = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else end
            continue
        if not outside:
            put_tag(name)
        if name in VOID or m["attrs"].rstrip().endswith("/") and name not in BLOCKS:
            continue
        if name in ("article", "main"):
            drops.clear()  # what holds it stays
            article += 1
            out.articles += article == 1
        links += name == "a"
        if outside:
            drops.append(len(stack))
        opened.append((kinds, len(out.kind)))
        for kind in kinds:
            put_tag(kind)
        stack.append(name)
    pop(0)
    return out


def best_run(page: Page, weights: Weights) -> tuple[int, int]:
    """Begin and end (exclusive) of the contiguous run of entries with the largest sum, the first of equals."""
    if not page.kind:
        return 0, 0
    score = np.array(
        [n * (weights.link if link else weights.word) if not kind else weights.tags.get(kind, weights.outside if kind[0] == "." else weights.unseen)
         for kind, n, link in zip(page.kind, page.value, page.link)]
    )
    total = np.concatenate([[0.0], np.cumsum(score)])
    lowest = np.minimum.accumulate(total[:-1])
    stop = int(np.argmax(total[1:] - lowest))
    begin = int(np.argmin(total[: stop + 1]))
    return (begin, stop + 1) if total[stop + 1] > lowest[stop] else (0, 0)


def main_text(page: str, weights: Weights) -> str:
    got = tokens(page)
    begin, stop = best_run(got, weights)
    blocks: dict[int, list[str]] = {}
    for k in range(begin, stop):
        if not got.kind[k]:
            blocks.setdefault(got.block[k], []).append(got.text[k])
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def from_counts(seen: dict[tuple[bool, str], int]) -> Weights:
    """Weights from counts of (inside the article, kind): log odds of being inside, kept above zero
    for words and below for tags. For the kinds of marks, the count is the most words that one of their
    elements held, and those that held no part of the article must cost more than their words score."""
    marks = {k for k in seen if k[1][0] == "."}
    total = {side: sum(n for k, n in seen.items() if k[0] == side and k not in marks) for side in (True, False)}
    if not total[True]:
        return Weights()

    def odds(kind: str) -> float:
        own = [math.log((seen.get((side, kind), 0) + 1) / (total[side] + 1)) for side in (True, False)]
        return own[0] - own[1]

    word = max(1.0, odds("#word"))
    link = min(max(0.05 * word, odds("#link")), word)
    # tags that occur inside articles at all cost little, so that lines of one word stay
    tags = {
        k: -0.1 if seen.get((True, k), 0) > seen.get((False, k), 0) else -min(max(0.1, -odds(k)), 4.0)
        for k in {k for s, k in seen if (s, k) not in marks} - {"#word", "#link"}
    }
    tags |= {k: -0.1 if (True, k) in marks else -word * (seen[False, k] + 1) for _, k in marks}
    return Weights(word, link, tags)


def learn(pages: DataFrame, max_labelled: int = 2_000, id_col: str = "page_id", html_col: str = "html") -> Weights:
    """Fit on at most ``max_labelled`` pages that name their article, those with the smallest hash of their id."""
    marked = pages.where(F.col(html_col).rlike(r"(?i)<(article|main)[\s>]"))
    keys = marked.select(F.xxhash64(id_col).alias("h")).orderBy("h").limit(max_labelled)
    most = keys.agg(F.max("h")).first()[0]
    if most is None:
        return Weights()
    rows = marked.where(F.xxhash64(id_col) <= most).select(F.xxhash64(id_col).alias("h"), F.col(html_col).alias("html"))

    def count(batches):
        for batch in batches:
            for page in batch.column("html").to_pylist():
                got = tokens(page)
                if got.articles == 1:
                    own: Counter = Counter()
                    for kind, n, inside, link in zip(got.kind, got.value, got.inside, got.link):
                        if kind[:1] != ".":
                            own[inside, kind or ("#link" if link else "#word")] += 1 if kind else n
                    for kind, begin, stop in got.marks:
                        key = any(got.inside[begin:stop]), kind
                        own[key] = max(own[key], sum(got.value[begin:stop]))
                    if own:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([k[0] for k in own]), pa.array([k[1] for k in own]), pa.array(list(own.values()), type=pa.int64())],
                            names=["inside", "kind", "n"],
                        )

    counts = rows.mapInArrow(count, "inside boolean, kind string, n bigint")
    most = F.when(F.startswith("kind", F.lit(".")), F.max("n")).otherwise(F.sum("n"))
    counts = counts.groupBy("inside", "kind").agg(most.alias("n"))
    return from_counts({(r["inside"], r["kind"]): r["n"] for r in counts.collect()})


def main_texts(pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars. A narrow pass."""
    rows = pages.select(F.col(id_col), F.col(url_col).alias("url"), text_or_empty(html_col).alias("html"))
    schema = T.StructType(
        [
            T.StructField(id_col, pages.schema[id_col].dataType),
            T.StructField("url", T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField("n_chars", T.LongType()),
        ]
    )

    def extract(batches):
        for batch in batches:
            texts = [main_text(page, weights) for page in batch.column("html").to_pylist()]
            size = pa.array([len(t) for t in texts], type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, type=pa.string()), size], names=schema.names)

    return rows.mapInArrow(extract, schema)
