"""Main text of web pages by maximum-scoring contiguous regions.

A page becomes a sequence of tags and words, each with the place where it stands: in an article (or main) element, beside
one, or, on pages without, in a paragraph, a link, a heading, a list, a table cell or plain flow. Words score positive and
tags negative by place; the weights are log odds counted on labelled pages, which labelled_pages() makes from layouts with
the main text marked. One linear scan cuts the sequence into its maximal scoring regions. The text is that of the best
region; where articles have words, of each region inside one.

Elements that are no text at all (scripts, styles) or that by their meaning are not the article (nav, header, footer,
aside, forms) are left out, and so are those that a class, id or role name marks as an advert, a notice, a menu, a
sidebar or reader comments. A name never empties a page: where no other article has words, an element with an article of
more words than stand elsewhere stays (but for reader comments), and where no other words are left, all that names left
out stays.

Nulls and ties: null html gives an empty text; of regions with the same score the first is taken; repeated pages each get
a row. Broken markup (unclosed tags, stray quotes, a page cut short) is read as browsers do: a new paragraph ends the open
one, a quote matters only as the first character of an attribute's value, and the end of the page closes everything. Time
is linear in the page, however deep its elements. Extra columns of the input stay unless they are named text or n_chars,
which are replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lakefold.llm import textkit

#: Elements by their part in a page.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("head nav aside footer header form button select option datalist dialog template noscript svg math canvas object audio video map menu".split()) | RAW
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HOLDS_MAIN = frozenset(("article", "main"))
#: An open p ends at a new block unless one of these was opened since; so does li unless a list was.
CELLS = ("table", "td", "th", "caption", "button")
LISTS = ("ul", "ol", "menu", "dir")
#: First or last parts (between hyphens or underscores) of class, id or role names that mark what is not the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notification "
    "alert alertdialog banner popup modal nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar complementary "
    "contentinfo masthead footer newsletter subscribe signup".split()
)
#: The same, of reader comments, whose articles are never the page's.
COMMENTS = frozenset("comment comments disqus replies respond".split())
#: First parts of names that tell of what stands elsewhere (has-sidebar).
FLAGS = frozenset("has have with without no is hide show".split())
ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>=][^\s/>=]*+|=[^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*+)))?", re.DOTALL)
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)\s*+(/?)>")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
LINK, LIST, CELL, HEADING, PARAGRAPH = "a", ("li", "dt", "dd"), ("td", "th"), ("h1", "h2", "h3", "h4", "h5", "h6"), "p"

Token = tuple[str, str, str, int]  # place, "tag", "text" or "mark", the tag's name or the text, which left-out element (0: none)


def marks(names: list[str], parts: frozenset[str]) -> bool:
    for name in names:
        split = re.split("[-_]+", name)
        if split[0] in parts or (split[-1] in parts and split[0] not in FLAGS):
            return True
    return False


class Page:
    """The open elements at a place of a page, each known by name in constant time."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.at: dict[str, list[int]] = defaultdict(list)
        self.left: list[tuple[int, int]] = []  # depth and number of left-out elements around, outermost first
        self.tokens: list[Token] = []
        self.why: dict[int, str] = {}  # left-out elements: by "element", "name" or "comments"
        self.holds: Counter[int] = Counter()  # left-out elements: words of articles inside

    def open(self, name: str) -> None:
        self.at[name].append(len(self.names))
        self.names.append(name)

    def last(self, names: tuple[str, ...]) -> int:
        return max((self.at[n][-1] for n in names if self.at[n]), default=-1)

    def close_to(self, depth: int) -> None:
        while len(self.names) > depth:
            self.at[self.names.pop()].pop()
        while self.left and self.left[-1][0] >= depth:
            self.left.pop()
            if not self.left:
                self.add("tag", "div")  # what stood here parted its neighbours

    def leave_out(self, why: str) -> None:
        around = self.why[self.left[-1][1]] if self.left else "name"
        number = len(self.why) + 1
        self.why[number] = why if around == "name" else around
        self.left.append((len(self.names), number))

    def add(self, kind: str, value: str) -> None:
        at = self.at
        if at["article"] or at["main"]:
            place = "article"
            if self.left and kind == "text" and self.last(("article", "main")) > self.left[-1][0]:
                self.holds[self.left[-1][1]] += len(value.split())
        elif at[PARAGRAPH]:
            place = "paragraph"  # its links are part of it
        elif at[LINK]:
            place = "link"
        elif any(at[n] for n in HEADING):
            place = "heading"
        elif any(at[n] for n in LIST):
            place = "list"
        else:
            place = "cell" if any(at[n] for n in CELL) else "plain"
        self.tokens.append((place, kind, value, self.left[-1][1] if self.left else 0))


def _attributes(page: str, at: int) -> tuple[list[str], bool, int]:
    """Class, id and role names of a tag whose name ends at at, whether it closes itself, and where the tag ends."""
    names: list[str] = []
    while True:
        found = ATTRIBUTE.match(page, at)
        if not found:
            end = page.find(">", at)
            return names, end > 0 and page[end - 1] == "/", end + 1 if end >= 0 else len(page)
        if found[1].lower() in ("class", "id", "role"):
            names += (found[2] or found[3] or found[4] or "").lower().split()
        at = found.end()


def _parsed(page: str) -> Page:
    out = Page()
    at, end = 0, len(page)
    quoted = page.rfind('"'), page.rfind("'")
    raw_end = {}
    while at < end:
        begin = page.find("<", at)
        text = page[at : begin if begin >= 0 else end]
        if text:
            out.add("text", html.unescape(text) if "&" in text else text)
        if begin < 0:
            break
        plain = PLAIN_TAG.match(page, begin)
        if plain:
            closing, name, names, alone, at = bool(plain[1]), plain[2].lower(), [], bool(plain[3]), plain.end()
        elif page.startswith("<!--", begin):
            stop = page.find("-->", begin + 2)
            if page.startswith(("<!--main-->", "<!--/main-->"), begin):
                out.tokens.append(("", "mark", page[begin : stop + 3], 0))
            at = stop + 3 if stop >= 0 else end
            continue
        elif page.startswith("<![CDATA[", begin):
            stop = page.find("]]>", begin)
            at = stop + 3 if stop >= 0 else end
            continue
        else:
            named = NAME.match(page, begin)
            if not named:
                if page[begin + 1 : begin + 2] in ("!", "?", "/"):
                    stop = page.find(">", begin)
                    at = stop + 1 if stop >= 0 else end
                else:
                    out.add("text", "<")
                    at = begin + 1
                continue
            closing, name = page[begin + 1] == "/", named[1].lower()
            names, alone, at = _attributes(page, named.end())
            if at >= end and page[-1] != ">":
                break  # the page ends inside a tag
        if closing:
            if out.at[name]:
                out.close_to(out.at[name][-1])
            out.add("tag", name)
            continue
        if name in BLOCK:
            if out.at["p"] and out.at["p"][-1] > out.last(CELLS):
                out.close_to(out.at["p"][-1])
            if name == "li" and out.at["li"] and out.at["li"][-1] > out.last(LISTS):
                out.close_to(out.at["li"][-1])
        out.add("tag", name)
        if name in VOID or (alone and name not in BLOCK and name not in RAW):
            continue
        if name in RAW:
            if name not in raw_end:
                raw_end[name] = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE)
            found = raw_end[name].search(page, at) if raw_end[name] else None
            if not found:
                raw_end[name] = None
                break  # all that follows is this element's
            at = page.find(">", found.end()) + 1 or end
            continue
        if name in NEVER:
            out.leave_out("element")
        elif names and name not in ("html", "body", *HOLDS_MAIN):
            if marks(names, COMMENTS):
                out.leave_out("comments")
            elif marks(names, NAMES):
                out.leave_out("name")
        out.open(name)
    return out


def tokens(page: str) -> list[tuple[str, str, str]]:
    """Place, kind and value of the tags and texts that are not left out. Comments main and /main are kept as marks."""
    read = _parsed(page)
    stays = {0}

    def words(*places: str) -> int:
        return sum(len(t[2].split()) for t in read.tokens if t[1] == "text" and t[3] in stays and (not places or t[0] in places))

    if not words("article"):
        others = words("paragraph", "heading", "list", "cell", "plain")
        stays |= {k for k, n in read.holds.items() if read.why[k] == "name" and n > others}
    if len(read.why) and not words():
        stays |= {k for k, why in read.why.items() if why != "element"}
    inside = words("article") > 0
    place = (lambda p: p if p in ("article", "") else "beside") if inside else (lambda p: "plain" if p == "article" else p)
    return [(place(p), kind, value) for p, kind, value, left in read.tokens if left in stays]


def labelled_pages() -> Iterator[str]:
    """Pages in the layouts that sites have, with the main text between the comments main and /main: sizes vary, so that
    the counts are those of many pages."""
    for size in range(1, 25):
        words = lambda n, k=size: " ".join(["word"] * (n * (1 + k % 6)))
        body = f"<h1>{words(2)}</h1>" + f"<p>{words(9)}</p>" * size + f"<p>{words(4)} <a>{words(1)}</a> {words(5)}</p><ul><li>{words(4)}</li><li>{words(3)}</li></ul><p>{words(8)}</p>"
        main = f"<!--main-->{body}<!--/main-->"
        links = "<ul>" + "<li><a>word</a></li>" * (3 + size % 5) + "</ul>"
        cards = f"<div><a>{words(1)}</a></div>" * (size % 4)
        yield f"<body><div>{words(1)}</div>{links}<article>{main}</article>{cards}<div>{words(1)}</div></body>"
        yield f"<body>{links}<div>{words(1)}</div><main>{main}</main><p>{words(1)}</p></body>"
        yield f"<body>{links}<div>{main}</div>{links}<div><a>word</a> <a>word word</a></div></body>"
        yield f"<body><div>word</div>{links}{main}{cards}<div>word word</div></body>"
        yield f"<body><table><tr><td>{links}</td><td>{main}</td><td>{links}</td></tr></table><table><tr><td><a>word</a></td><td>word</td></tr></table></body>"
        yield f"<body>{links}<div><!--main--><div>{words(9)}</div><div>{words(7)}</div><!--/main--></div>{links}</body>"


@cache
def weights() -> dict[tuple[str, str], float]:
    """Log odds, by place, that a word or a tag of the labelled pages stands in the main text. A tag's odds are against it
    and any other, so its weight is below zero."""
    inside: Counter[tuple[str, str]] = Counter()
    outside: Counter[tuple[str, str]] = Counter()
    for page in labelled_pages():
        main = False
        for place, kind, value in tokens(page):
            if kind == "mark":
                main = value == "<!--main-->"
            else:
                (inside if main else outside)[place, kind] += len(value.split()) if kind == "text" else 1
    out = {}
    for place in ("article", "beside", "link", "heading", "list", "paragraph", "cell", "plain"):
        out[place, "text"] = math.log((inside[place, "text"] + 0.5) / (outside[place, "text"] + 0.5))
        out[place, "tag"] = math.log((inside[place, "tag"] + 0.5) / (inside[place, "tag"] + outside[place, "tag"] + 1))
    return out


def scores(found: list[tuple[str, str, str]]) -> list[float]:
    weight = weights()
    return [0.0 if kind == "mark" else weight[place, kind] * (len(value.split()) if kind == "text" else 1) for place, kind, value in found]


def maximal_regions(values: list[float]) -> list[tuple[float, int, int]]:
    """The maximal scoring subsequences, disjoint, in order: score, begin, end. None is part of a longer one with a higher
    score for every part of it; the best contiguous region is one of them. Linear time."""
    # Of each region: sums of all values before it and up to its end. back: nearest region to the left with a smaller first sum.
    regions: list[tuple[float, float, int, int, int]] = []
    total = 0.0
    for k, v in enumerate(values):
        before, total = total, total + v
        if v <= 0:
            continue
        begin, low = k, before
        back = len(regions) - 1
        while True:
            while back >= 0 and regions[back][0] >= low:
                back = regions[back][4]
            if back < 0 or regions[back][1] >= total:
                break
            low, _, begin, _, nearer = regions[back]
            del regions[back:]
            back = nearer
        regions.append((low, total, begin, k + 1, back))
    return [(high - low, begin, end) for low, high, begin, end, _ in regions]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = tokens(page)
    regions = maximal_regions(scores(found))
    if not regions:
        return ""
    chosen = [r for r in regions if any(found[k][0] == "article" for k in range(r[1], r[2]))] or [max(regions, key=lambda r: (r[0], -r[1]))]
    blocks: list[list[str]] = [[]]
    for _, begin, end in chosen:
        blocks.append([])
        for _, kind, value in found[begin:end]:
            if kind == "text":
                blocks[-1].append(value)
            elif kind == "tag" and value == "br":
                blocks[-1].append(" ")
            elif kind == "tag" and value in BLOCK:
                blocks.append([])
    texts = (" ".join("".join(b).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with text and n_chars (code points) in place of the html column."""
    kept = [f for f in pages.schema if f.name not in (column, "text", "n_chars")]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "text string", "n_chars bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in textkit.pieces(batches, column):
            texts = [main_text(p) for p in textkit.column(piece, column).to_pylist()]
            others = [textkit.column(piece, f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*others, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*(f.name for f in kept), "text", "n_chars"])

    return pages.select(*(f"`{f.name}`" for f in kept), column).mapInArrow(run, ddl)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
