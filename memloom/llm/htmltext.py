"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one decides blocks from what they are: parts
of menus, adverts, forms and the like are bad; long blocks with many stop words and few links
are good; the rest is open. In pass two an open block takes the label of the
nearest decided block, looking first inside its own section.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from memloom.llm.textio import in_batches, pieces, table

# Element names by their role in HTML.
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul""".split())
CONTAINER = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header html main menu nav ol section table td ul".split())
BAD = frozenset("nav footer aside form menu dialog fieldset".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("head template svg object select button datalist canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
BAD_NAMES = frozenset("""ad ads advert advertisement adverts advertising adsense banner sponsor sponsored sponsors promo promotion promoted
 nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars aside widget widgets footer footnotes masthead topbar
 cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login
 comment comments commentlist disqus respond replies reply share sharing social related recommended recommendations tags tagcloud skip copyright""".split())
STOP = {
    "en": "the of and a to in is it that was for on are as with be by at this from or an not have he his they which you had but were her she all their there been one if would who",
    "de": "der die das und in zu den ist von mit sich des auf für im ein eine nicht dem als auch es an werden aus er hat dass sie nach bei um am sind noch wie einer über einen zum war",
    "fr": "le la les de des et un une est que qui dans en du pour pas au sur par il elle plus avec ce se sont ne son sa ses aux ou mais comme nous vous leur été cette être",
    "es": "el la los las de que y en un una es por con para del se no su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay",
}
STOP_WORDS = frozenset(w for x in STOP.values() for w in x.split())

LEAST_GOOD_CHARS, LEAST_STOP, MOST_LINK = 70, 0.12, 0.5
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[^\W\d_]+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    linked: int
    section: int
    bad: bool
    inside: bool
    heading: bool


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


def _bad(name: str, raw: str, inside: bool) -> bool:
    """Whether an element is no part of an article."""
    if name in BAD or name == "header" and not inside:
        return True
    if not raw or name in ("body", "html", "main"):
        return False
    a = _attributes(raw)
    if a.get("role", "").lower() in BAD_ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""):
        return True
    parts = [p.lower() for p in _NAME.findall(f"{a.get('class', '')} {a.get('id', '')}")]
    return any(p in BAD_NAMES for p in parts)


def blocks(page: str) -> list[Block]:
    """Blocks with text, in page order. Unclosed and stray tags do not matter; a tag cut off by the end is no text, nor is
    what follows a quote that never closes inside a tag. Time is in proportion to the page."""
    found: list[Block] = []
    opened: Counter = Counter()
    stack: list[tuple[str, bool, bool, int]] = [("", False, False, 0)]  # name, bad, inside an article, section
    pieces_: list[tuple[str, bool]] = []
    links = sections = 0
    heading = False
    at = 0

    def flush() -> None:
        if pieces_:
            text = " ".join(html.unescape("".join(p for p, _ in pieces_)).split())
            if text:
                linked = len(" ".join(html.unescape("".join(p for p, in_link in pieces_ if in_link)).split()))
                _, bad, inside, section = stack[-1]
                found.append(Block(text, linked, section, bad, inside, heading))
            pieces_.clear()

    while True:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            pieces_.append((text, links > 0))
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCK:
                flush()
                heading = False
                if opened[name]:
                    last = None
                    while last != name:
                        last = stack.pop()[0]
                        opened[last] -= 1
                links = 0
            continue
        if name in RAW or name in HIDDEN:
            if not m[3].rstrip().endswith("/"):
                close = re.compile(rf"</{name}\s*+(?:>|\Z)", re.I).search(page, at)
                body = re.compile(r"<body[\s>]", re.I).search(page, at) if name == "head" else None
                if body and (not close or body.start() < close.start()):
                    at = body.start()
                else:
                    at = close.end() if close else len(page)
        elif name == "br":
            pieces_.append((" ", links > 0))
        elif name == "a":
            links += 1
        elif name in BLOCK:
            flush()
            heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")
            links = 0
            _, bad, inside, section = stack[-1]
            now_bad = bad or _bad(name, m[3], inside)
            if name in CONTAINER and name not in VOID:
                sections += 1
                stack.append((name, now_bad, inside or name in ("article", "main"), sections))
                opened[name] += 1
            elif now_bad and not bad:  # a single bad block, such as <p class="ad">
                sections += 1
                stack.append((f"/{name}", True, inside, sections))
                end = re.compile(rf"</{name}\s*>|<(?:p|h[1-6]|li|/?(?:div|section|article|ul|ol|table))[\s>]", re.I).search(page, at)
                pieces_.append((_TAG.sub(" ", page[at : end.start() if end else len(page)]), False))
                flush()
                stack.pop()
                at = end.start() if end else len(page)
    flush()
    return found


def _first(b: Block, articles: bool) -> bool | None:
    """Pass one: good, bad, or None where it is open."""
    if b.bad or articles and not b.inside:
        return False
    if b.linked >= MOST_LINK * len(b.text) and b.linked:
        return False
    if len(b.text) >= LEAST_GOOD_CHARS:
        tokens = [w.lower() for w in _WORD.findall(b.text)]
        if tokens and sum(w in STOP_WORDS for w in tokens) >= LEAST_STOP * len(tokens):
            return True
    return None


def _nearest(labels: list[bool | None], at: int, among: list[int]) -> bool | None:
    """Label of the decided block nearest to ``at`` among the places ``among``; a tie of unlike labels is good."""
    best: list[tuple[int, bool]] = []
    for i in among:
        if labels[i] is not None:
            best.append((abs(i - at), labels[i]))
    if not best:
        return None
    near = min(d for d, _ in best)
    return any(label for d, label in best if d == near)


def main_text(page: str | None) -> str:
    """The article's blocks, joined by two line feeds; "" for null, empty and text-free pages."""
    found = blocks(page or "")
    articles = any(b.inside and not b.bad for b in found)
    labels = [_first(b, articles) for b in found]
    second = list(labels)
    # Nearest decided places on both sides, over the whole page and inside each section.
    for same_section in (True, False):
        before: dict[int, int] = {}
        left: list[int | None] = []
        for i, b in enumerate(found):
            key = b.section if same_section else 0
            left.append(before.get(key))
            if labels[i] is not None:
                before[key] = i
        after: dict[int, int] = {}
        for i in range(len(found) - 1, -1, -1):
            key = found[i].section if same_section else 0
            if second[i] is None:
                around = [p for p in (left[i], after.get(key)) if p is not None]
                if not same_section and found[i].inside:
                    second[i] = True  # nothing decided beside it in its part of the article
                elif found[i].heading and after.get(key) is not None:
                    second[i] = labels[after[key]]
                else:
                    second[i] = _nearest(labels, i, around)
            if labels[i] is not None:
                after[key] = i
    # A page whose blocks are all open keeps them: nothing speaks against them.
    return "\n\n".join(b.text for b, label in zip(found, second, strict=True) if label or label is None)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of ``pages`` (page_id, url, html). A null or empty html, or one without an article, has the
    text ""; repeated rows are returned each, an empty table gives none."""
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "html"):
                texts = [main_text(h) for h in piece.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return in_batches(pages.select("page_id", "url", "html"), run, f"{kinds}, text string, n_chars bigint")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
