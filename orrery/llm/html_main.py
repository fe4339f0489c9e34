"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags. Containers that never hold main text (menus, page
headers, footers, sidebars, forms, scripts, styles) and containers named as notices, adverts,
comments and the like are set aside at once; a name counts if it is made of such words, beside words
of layout, only (`ad-box`, not `search-for-truth`), and names of paragraphs, headings and list items
count nothing. Every other block is read by its features:

pass 1 - link density over `LINKS` or links in a short block: boilerplate; shorter than `SHORT`:
         undecided short; otherwise stop-word density decides between main text (dense and long),
         undecided (dense but of middling length, half dense, or without a link) and boilerplate;
pass 2 - undecided blocks inherit the label of the nearest decided neighbours: main text if both
         agree or the nearer says so, a tie going to main text for undecided long blocks only. With no
         decided block at all, they are main text if one of them is long.

Where a page marks its main part (article or main), that is one more feature: blocks outside are
boilerplate, blocks inside are undecided where pass 1 would reject them for lack of stop words, and
look for neighbours inside; with none decided, they are main text. So headings and one-word
paragraphs of an article stay.

A link is text behind an `a` with an address, to its end tag or the block's end. Tags that end with
a slash hold nothing, and elements other than scripts and styles that are never closed are read as
if their tag was not there.

Null and empty pages give an empty text; so do pages without any main text. Repeated rows are
extracted each; only the page id, url and html columns are read. Texts of any length are taken
whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINKS, SHORT, LONG = 0.33, 70, 200
STOPS_LOW, STOPS_HIGH = 0.15, 0.30

# Fixed word lists and tag classes.
STOP_WORDS = frozenset(
    "the and of to a in is it that for on with as this be at by from are was or an not have has had they you which one we all were their can would "
    "der die das und in zu den von mit ist im für auf des dem ein eine nicht auch es an als sich er sie "
    "de la le et les des en un une du que qui dans pour par sur au avec est pas elle il ne se ce plus "
    "el los las y del se por con una su para al es como más lo no ha o esta".split()
)
RAW = "script style"
HELD = frozenset("noscript template iframe svg canvas object textarea select".split())
DROPPED = frozenset("nav footer aside form button menu dialog label fieldset head title".split())
MAIN = frozenset("article main".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINERS = frozenset("article aside body details dialog div dl fieldset figure footer form head header label main menu nav ol section table title ul blockquote button li p td th tr h1 h2 h3 h4 h5 h6".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup paywall "
    "sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments respond replies reply disqus social share sharing related recommended widget toolbar pagination pager login search".split()
)
NAMED = frozenset("div section ul ol dl aside nav form header footer table span figure details dialog".split())
LAYOUT = frozenset("area bar block body bottom box btn button container content group inner item items left link links list main outer page panel right row section site slot top unit wrap wrapper".split())

_PART = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)"
    rf"|<(?P<raw>{RAW.replace(' ', '|')})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/a-z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_ADDRESS = re.compile(r"(?:^|\s)href\s*=", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int
    inside: int  # number of the main part it lies in, 0 outside


# Within a marked main part these name the heading of the text itself.
HEADINGS = frozenset("header masthead".split())


def _hinted(tag: str, attrs: str, inside: bool = False) -> bool:
    if tag not in NAMED or "=" not in attrs:
        return False
    hints = HINTS - HEADINGS if inside else HINTS
    for m in _NAMED.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))
            if not words.isdisjoint(hints) and words <= hints | LAYOUT:
                return True
    return False


def blocks(html: str) -> list[Block]:
    """Blocks outside of dropped containers, white space turned to single spaces."""
    out: list[Block] = []
    open_: list[tuple[str, bool, bool]] = []  # (tag, dropped, main part)
    dropped = main = part = 0
    pieces: list[str] = []
    linked = links = 0
    lower = html.lower()
    last_end = {tag: lower.rfind(f"</{tag}") for tag in HELD}

    def end_block() -> None:
        nonlocal pieces, linked, links
        text = " ".join("".join(pieces).split())
        if text:
            out.append(Block(text, linked, part if main else 0))
        pieces, linked, links = [], 0, 0

    def take(raw: str) -> None:
        nonlocal linked
        if raw and not dropped:
            text = unescape(raw)
            pieces.append(text)
            if links:
                linked += len("".join(text.split()))

    at = 0
    for m in _PART.finditer(html):
        take(html[at : m.start()])
        at = m.end()
        if m["cdata"]:
            take(m["cdata"])
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            pieces.append(" ")
        empty = (m["attrs"] or "").endswith("/")
        if tag == "a":
            links = 0 if m["close"] or empty or not _ADDRESS.search(m["attrs"]) else 1
        if tag in HELD:
            if not m["close"]:
                if not empty and last_end[tag] >= at:
                    open_.append((tag, True, False))
                    dropped += 1
            elif any(t == tag for t, _, _ in open_):
                while True:
                    name, was_dropped, was_main = open_.pop()
                    dropped -= was_dropped
                    main -= was_main
                    if name == tag:
                        break
            continue
        if tag not in BLOCKS:
            if tag == "span" and not m["close"] and not empty:
                hinted = _hinted(tag, m["attrs"], bool(main))
                if hinted or (open_ and open_[-1][0] == "span"):  # plain spans count only within a named one
                    open_.append((tag, hinted, False))
                    dropped += hinted
            elif tag == "span" and m["close"] and open_ and open_[-1][0] == "span":
                dropped -= open_.pop()[1]
            continue
        end_block()
        if m["close"]:
            if any(t == tag for t, _, _ in open_):
                while True:
                    name, was_dropped, was_main = open_.pop()
                    dropped -= was_dropped
                    main -= was_main
                    if name == tag:
                        break
        elif tag in CONTAINERS and not empty:
            while tag in ("p", "li", "td", "th", "tr") and open_ and open_[-1][0] in (("p", tag) if tag != "tr" else ("p", "td", "th", "tr")):
                name, was_dropped, was_main = open_.pop()  # its end tag may be left out
                dropped -= was_dropped
                main -= was_main
            drop = tag in DROPPED or (tag == "header" and not main) or _hinted(tag, m["attrs"], bool(main))
            is_main = tag in MAIN and not dropped
            part += is_main
            open_.append((tag, drop, is_main))
            dropped += drop
            main += is_main
    take(html[at:])
    end_block()
    return out


def _first_pass(block: Block) -> str:
    size = len(block.text)
    density = block.linked / max(1, size - block.text.count(" "))
    if density > LINKS or (size < SHORT and block.linked):
        return "bad"
    if size < SHORT:
        return "short"
    words = _LETTERS.findall(block.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stops >= STOPS_HIGH:
        return "good" if size >= LONG else "near"
    if stops >= STOPS_LOW:
        return "near"
    return "near" if block.inside or not block.linked else "bad"


def _second_pass(labels: list[str], default: bool) -> list[bool]:
    """Whether each block is main text; undecided ones inherit from the nearest decided ones."""
    n = len(labels)
    decided = [k for k in range(n) if labels[k] in ("good", "bad")]
    before: list[int | None] = [None] * n
    after: list[int | None] = [None] * n
    last = None
    for k in range(n):
        last = k if labels[k] in ("good", "bad") else last
        before[k] = last
    last = None
    for k in range(n - 1, -1, -1):
        last = k if labels[k] in ("good", "bad") else last
        after[k] = last
    if not decided:
        return [default] * n
    out = []
    for k, label in enumerate(labels):
        if label in ("good", "bad"):
            out.append(label == "good")
            continue
        near = [(abs(k - j), labels[j] == "good") for j in (before[k], after[k]) if j is not None]
        least = min(d for d, _ in near)
        votes = {good for d, good in near if d == least}
        out.append(votes == {True} or (len(votes) == 2 and (label == "near" or default)))
    return out


def main_text(html: str | None) -> str:
    """Main text of a page: its blocks in order, joined by one space."""
    found = blocks(html or "")
    marked = {b.inside for b in found if b.inside}
    keep: list[bool] = [False] * len(found)
    for part in marked or {0}:
        rows = [k for k, b in enumerate(found) if b.inside == part]
        labels = [_first_pass(found[k]) for k in rows]
        for k, good in zip(rows, _second_pass(labels, bool(part) or "near" in labels)):
            keep[k] = good
    return " ".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text): one row per input row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h) for h in batch.column(2).to_pylist()], pa.string())
            yield pa.record_batch([batch.column(0), batch.column(1), texts], ["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string")
