"""HTML main text by two-pass block rules (operator 3).

A page is cut into blocks at block-level tags. First pass: containers that name their purpose, link density,
stop-word density and length decide a block as good or bad, or leave it open (short blocks and long ones
with few stop words). Second pass: open blocks take the label of the nearest decided neighbours, found by one
run forward and one backward. A container's name does not count where it would take the text away: if nothing
good is left outside it, or if it holds nearly all of the page and is not for comments.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of elements by role.
RAW = frozenset("script style title textarea noscript template iframe svg math xmp noframes object select audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img input".split())
LOOSE = frozenset("p tbody thead tfoot colgroup caption option b i em strong u font small code".split())
#: Elements that end where one of their kind starts, unless one of the third kind was opened between.
ENDED = {
    "li": ("li", "ul ol menu"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tr": ("tr", "table"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"),
}
BAD = frozenset("nav footer aside form menu dialog button fieldset".split())
MAIN = frozenset("article main".split())
#: Words in class, id or role that name boilerplate; those for reader comments; words that may stand beside them.
PURPOSE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner banners sponsor sponsored sponsors promo promos promotion sidebar sidebars aside menu menus nav navbar navigation "
    "navlinks breadcrumb breadcrumbs footer foot masthead topbar toolbar cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login signin register search searchbox share sharing social follow related recommended recommendations trending "
    "widget widgets copyright legal disclaimer pagination pager tags skip hidden complementary contentinfo dialog".split()
)
COMMENTS = frozenset("comment comments commentlist reply replies disqus respond".split())
BESIDE = frozenset(
    "site page main global top bottom left right upper lower box block bar wrap wrapper container content inner outer area section module list item items entry links link cloud form field body row col column unit slot "
    "post posts article articles story stories thread header head side text title panel group holder region primary secondary small large sticky fixed mobile desktop user the my our your js new".split()
)
CAMEL = re.compile("(?<=[a-z])(?=[A-Z])")
#: Frequent words of the languages at hand.
STOP = frozenset(
    "the of and to in is that for it as was with on be by at this are from or an have not they which you his her but had were their been has will would there what all one more when "
    "who so if out up about into than them can only other its our my me we he she do no your de la le les des et un une du que qui en dans pour est pas sur au par ne ce il elle avec "
    "plus se son sa ses aux mais ou sont nous vous ils cette comme der die das und ist ein eine zu den von mit im nicht sich auf dem des auch als für an werden aus er hat dass sie nach "
    "wird bei einer um am sind noch wie einem über el los las y por con su al para una lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay del".split()
)
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""", re.S
)
NAMED = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
WORD = re.compile(r"[^\W\d_]+")
LONG, SHORT, STOP_HIGH, STOP_LOW, LINKED = 160, 70, 0.28, 0.12, 0.5


#: A container that holds so much of the text, or that leaves nothing good outside, is not what its name says.
MOST, NEARLY_ALL = 0.5, 0.8


@dataclass
class Block:
    text: str
    linked: int
    bad: bool
    main: int
    heading: bool
    marked: tuple[int, ...] = ()
    label: str = field(default="")


def _purpose(attributes: str) -> str:
    """comments, bad or nothing: what the class, id or role of an element says. A name counts if all its parts do."""
    said = ""
    for m in NAMED.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = {p for p in re.split("[^a-z]+", CAMEL.sub("-", name).lower()) if p}
            if parts <= PURPOSE | COMMENTS | BESIDE:
                if parts & COMMENTS:
                    return "comments"
                if parts & PURPOSE:
                    said = "bad"
    return said


def blocks(page: str) -> tuple[list[Block], dict[int, str]]:
    """Blocks of text in page order, with what their containers say; and the purposes of the marked containers."""
    out: list[Block] = []
    parts: list[str] = []
    open_: list[tuple[str, bool, bool, int]] = []  # name, bad, main, marked container
    names: Counter[str] = Counter()
    purposes: dict[int, str] = {}
    chain: list[int] = []
    state = {"linked": 0, "link": False, "own": 0, "bad": 0, "main": 0, "mains": 0, "heading": False, "breaks": 0, "hidden": False}

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, state["linked"], bool(state["bad"] or state["hidden"]), state["mains"] if state["main"] else 0, state["heading"], (*chain, *([state["own"]] if state["own"] else []))))
        parts.clear()
        state.update(linked=0, own=0, heading=False, breaks=0, hidden=False)

    def say(raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if not text.isspace():
                state["breaks"] = 0
                if state["link"]:
                    state["linked"] += len(" ".join(text.split()))

    def pop(at: int) -> None:
        for name, bad, main, mark in open_[at:]:
            names[name] -= 1
            state["bad"] -= bad
            state["main"] -= main
            if mark:
                chain.pop()
        del open_[at:]

    def mark(attributes: str) -> int:
        said = _purpose(attributes) if attributes else ""
        if said:
            purposes[len(purposes) + 1] = said
            return len(purposes)
        return 0

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            if name not in ("select", "noscript"):
                continue
        if name == "a":
            state["link"] = not closing and "href" in attributes.lower()
            continue
        if name == "br":
            state["breaks"] += 1
            parts.append(" ")
            if state["breaks"] > 1:
                flush()
            continue
        if name in INLINE and name in LOOSE or name in VOID and name != "hr":
            continue
        if name not in INLINE:
            flush()
            state["link"] = state["link"] and not closing
        if closing:
            if names[name]:
                pop(next(k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == name))
            continue
        if name == "hr":
            continue
        hidden = bool(attributes) and bool(HIDDEN.search(attributes))
        if name in LOOSE:
            state["own"], state["hidden"] = mark(attributes), hidden
            continue
        if name in ENDED:
            same, within = (x.split() for x in ENDED[name])
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] in within:
                    break
                if open_[k][0] in same:
                    pop(k)
                    break
        if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            state["heading"] = True
        if name in ("html", "body"):
            continue
        bad = hidden or name in BAD or name == "header" and not state["main"]
        here = mark(attributes)
        main = name in MAIN and not state["bad"] and not bad
        if main and not state["main"]:
            state["mains"] += 1
        open_.append((name, bad, main, here))
        names[name] += 1
        if here:
            chain.append(here)
        state["bad"] += bad
        state["main"] += main
    flush()
    return out, purposes


def decide(found: list[Block], void: set[int]) -> None:
    """First pass: the label of each block by itself, or none; marks of containers in `void` do not count."""
    for b in found:
        words = WORD.findall(b.text.lower())
        stops = sum(w in STOP for w in words) / len(words) if words else 0.0
        b.label = ""
        if b.bad or any(m not in void for m in b.marked) or b.linked > LINKED * len(b.text):
            b.label = "bad"
        elif len(b.text) >= SHORT and stops >= STOP_HIGH or len(b.text) >= LONG and stops >= STOP_LOW:
            b.label = "good"
        elif len(b.text) >= LONG and not b.main:
            b.label = "bad"
        elif b.linked and not b.main:
            b.label = "bad"


def misnamed(found: list[Block], purposes: dict[int, str]) -> set[int]:
    """The marked containers whose name would take the page's text away."""
    sizes, total = Counter(), 0
    for b in found:
        if not b.bad:
            free = len(b.text) - b.linked
            total += free
            for m in set(b.marked):
                sizes[m] += free
    article = any(b.main and b.label != "bad" for b in found)
    some_good = article or any(b.label == "good" for b in found)
    return {m for m, n in sizes.items() if n > MOST * total and not some_good or n > NEARLY_ALL * total and not article and purposes[m] != "comments"}


def inherit(found: list[Block], void: set[int]) -> None:
    """Second pass: open blocks take the label of the nearest decided neighbours of their region; blocks in containers named bad are no neighbours."""

    def nearest(order) -> list[tuple[int, str] | None]:
        last: dict[int, tuple[int, str]] = {}
        near: list = [None] * len(found)
        for k in order:
            b = found[k]
            if not b.label:
                near[k] = last.get(b.main)
            elif not b.bad and all(m in void for m in b.marked):
                last[b.main] = (k, b.label)
        return near

    before, after = nearest(range(len(found))), nearest(range(len(found) - 1, -1, -1))
    for k, b in enumerate(found):
        if b.label:
            continue
        if b.main and before[k] is None and after[k] is None:
            label = "good"
        else:
            edge = "good" if b.main else "bad"
            left = (k - before[k][0], before[k][1]) if before[k] else (k + 1, edge)
            right = (after[k][0] - k, after[k][1]) if after[k] else (len(found) - k, edge)
            if left[1] == right[1]:
                label = left[1]
            elif b.heading:
                label = right[1]
            elif left[0] != right[0]:
                label = min(left, right)[1]
            else:
                label = "good" if b.main else "bad"
        b.label = "later " + label
    for b in found:
        b.label = b.label.removeprefix("later ")


def classify(found: list[Block], purposes: dict[int, str] | None = None) -> None:
    """Label every block good or bad."""
    decide(found, set())
    void = misnamed(found, purposes or {})
    if void:
        decide(found, void)
    good = sum(len(b.text) for b in found if b.label == "good")
    inside = sum(len(b.text) for b in found if b.main and b.label == "good")
    if any(b.main and b.label != "bad" for b in found) and inside >= MOST * good:
        for b in found:  # an article that holds most of the good text is all of it
            if not b.main:
                b.label = "bad"
    inherit(found, void)


def main_text(page: str | None) -> str:
    """The good blocks of a page, one a line; null, empty and all-boilerplate pages give an empty text."""
    found, purposes = blocks(page or "")
    classify(found, purposes)
    return "\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of `pages`, of any length.

    Null and empty pages give an empty text; equal rows and rows with one page_id or none each give their own row;
    broken markup is read as far as it goes; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
