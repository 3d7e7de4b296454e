"""Main text of web pages by the distribution of text over blocks of lines (operator 9).

Markup is stripped to lines, each line has a weight, and sums of weights over sliding windows tell where text surges
and dives.  Elements and names only enter as evidence for the weights.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.storage import table

#: Lines in a window of the distribution.
WINDOW = 3
#: Text of a window that tells an article from a stray line; what a line in an article element weighs beside its text.
SURGE = 80
#: Shares of the text: articles of less than the first hold teasers, not the page's text; a line of more than the
#: second in links is a menu's.
ARTICLES, LINKED = 1 / 3, 0.5

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|template|noscript|svg|iframe|textarea|title|select|object)\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][\w:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][\w:-]*+)(?P<attrs2>[^>]*+)>"
    r"|<[!?/][^>]*+>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Elements that begin and end a line of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
#: Elements, roles and words of class or id names whose content is not the article's.
ASIDE = frozenset("nav footer aside form button menu dialog head label input datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Words of adverts, reader comments and consent boxes: no element of an article has such a name.
FOREIGN = frozenset(
    "ad ads adsbygoogle adsense advert adverts advertisement advertisements advertising sponsor sponsored promo promoted "
    "comment comments disqus respond replies cookie cookies consent gdpr".split()
)
#: Words of other parts of a page; an article's paragraph may have such a name, too.
PARTS = frozenset(
    "banner nav navbar navigation menu sidebar breadcrumb breadcrumbs footer masthead notice popup modal overlay newsletter "
    "subscribe subscription share sharing social related recommended recommendations widget toolbar pagination pager "
    "copyright legal login signup skip".split()
)
NAMES = FOREIGN | PARTS
#: Words that join names in a class or id without saying anything else.
FILLERS = frozenset(
    "area bar block body box btn button buttons container content div footer form global group header inner item items label link links list main message module outer "
    "page panel primary row secondary section site slot text thread title top bottom left right unit wrap wrapper the my js is".split()
)
#: Words that turn a name into what an element has, lacks or is filed under.
RELATIONS = frozenset("has with no not without category tag tags type format topic theme style layout".split())
#: Words that tell an article's own header from a site's.
OWN = frozenset("article content entry post story".split())
#: Elements of one line of an article; their names, but for FOREIGN ones, are hints.
LINE_TAGS = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th tr".split())
#: Elements whose lines belong together where no element marks the article.
CONTAINERS = frozenset("body center div section table".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an element whose end tag may be left out, and elements that shield it from them.
_CELL_ENDS = frozenset("caption colgroup tbody td tfoot th thead tr".split())
ENDED_BY = {
    "p": BLOCKS - frozenset("body caption head html legend".split()) | {"hgroup"},
    "li": frozenset(["li"]),
    "dd": frozenset(["dd", "dt"]),
    "dt": frozenset(["dd", "dt"]),
    "td": _CELL_ENDS,
    "th": _CELL_ENDS,
    "tr": _CELL_ENDS - {"td", "th"},
}
TABLE_PARTS = frozenset("table tbody tfoot thead tr".split())
SHIELDS = {k: frozenset(["table"]) for k in ("td", "th", "tr")} | {"p": frozenset("button caption table td th".split())}
SHIELDS |= {k: BLOCKS - frozenset("address div p".split()) - ENDED_BY[k] for k in ("li", "dd", "dt")}


def _still_open(opened: list[str], tag: str) -> list[str]:
    """What stays open of nested elements when a start tag ends some of them by implication."""
    for k in range(len(opened) - 1, -1, -1):
        if tag in ENDED_BY.get(opened[k], ()) and not any(x in SHIELDS[opened[k]] for x in opened[k + 1 :]):
            opened = opened[:k]
    return opened


def _ends_parent(out_tag: str, tag: str, around: dict[str, int]) -> bool:
    """Whether an end tag that opens nothing inside an unwanted element is that of an element around it."""
    if out_tag not in ENDED_BY or not around.get(tag):
        return False
    return tag in TABLE_PARTS if out_tag in ("td", "th", "tr") else tag in BLOCKS and tag not in ENDED_BY or tag in ("li", "dd", "dt", "td", "th", "tr")


@lru_cache(maxsize=1 << 14)
def _named(name: str) -> tuple[frozenset[str], str]:
    """The words of one class or id name, split at marks, digits and capitals, and the word that says what it is.

    That is the last word beside fillers (user-comments, CommentList, ad_slot), or a consent box's word anywhere
    (cookie-policy); empty if the name tells a relation (has-sidebar, category-ads).
    """
    words = [w for w in re.split(r"[\W_\d]+", CAMEL.sub("-", name).lower()) if w]
    if RELATIONS & set(words):
        return frozenset(), ""
    telling = [w for w in words if w not in FILLERS or w == "footer"]
    consent = [w for w in words if w in ("cookie", "cookies", "consent", "gdpr")]
    return frozenset(words), (consent or telling or [""])[-1]


def _doubt_of_names(tag: str, names: list[str], inside: bool) -> float:
    """What the names of an element tell: 1 if it isn't the article's, a half for a hint, or 0."""
    doubt = 0.0
    for one in names:
        words, head = _named(one)
        sites = words & {"site", "global", "masthead"} if inside else not words - FILLERS
        if "header" in words and sites and head in ("", "masthead"):
            return 1
        if not words & NAMES:
            continue
        if tag in ("article", "main"):
            sure = not words - NAMES - FILLERS
        elif tag in LINE_TAGS or (inside and tag not in BLOCKS):
            sure = head in FOREIGN
        else:
            sure = head in NAMES
        if sure:
            return 1
        doubt = 0.5
    return doubt


def _marked(tag: str, attrs: str, inside: bool, quoted: bool = False) -> float:
    """How sure an element's tag, role or names are that it isn't part of the article: 1, a half or 0.

    A compound name is what its last telling word is (user-comments); with such a word before others (related-work)
    it is a hint.  Names of lines (p, li, ...) and, in articles, of inline elements are sure for adverts, comments and
    consent boxes, else hints.  In quoted text (pre) names are those of a highlighter.
    """
    names = [(n.lower(), v.strip("\"'")) for n, v in ATTRIBUTE.findall(attrs)] if attrs and tag not in ("html", "body") else []
    called = [one for n, v in names if n in ("class", "id") for one in v.split()]
    if tag in ASIDE or (tag == "header" and not inside and not any(_named(x)[0] & OWN for x in called)):
        return 1
    for name, value in names:
        value = value.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return 1
        if name == "style" and "display:none" in value.replace(" ", ""):
            return 1
        if name == "role" and value in ROLES:
            return 1
    return 0 if quoted else _doubt_of_names(tag, called, inside)


class Line(NamedTuple):
    """A line of a page, markup stripped.

    article: whether an article or main element holds it; doubted: a name hints that it is none of the article's, a
    half for that of an element around it (within the article, if there is one), 1 for its own; gap: other content (menus, adverts) stood before it; linked: share of its text in links; container: number of
    the innermost container element around it, 0 for none.
    """

    text: str
    article: bool
    doubted: float
    gap: bool
    linked: float
    container: int


def lines(page: str) -> list[Line]:
    """The lines of a page in order; elements that are surely not the article's leave a gap only."""
    out: list[Line] = []
    held: list[str] = []
    linked = 0
    in_link = False
    gap = False
    roots: list[str] = []
    doubts: list[str] = []  # a doubted element and those of its tag in it
    doubted_in: list[bool] = []  # whether these are in an article
    own_doubt = False
    within: list[tuple[str, int]] = []
    containers = 0
    out_tag, out_depth = "", 0  # the unwanted element that holds the current place
    inner: list[str] = []  # it and what is open in it, if its end tag may be left out
    around: dict[str, int] = {}

    def end_line() -> None:
        nonlocal linked, gap, own_doubt
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                share = min(1.0, linked / len(text))
                doubt = 1.0 if own_doubt else 0.5 * any(k == bool(roots) for k in doubted_in)
                out.append(Line(text, bool(roots), doubt, gap, share, within[-1][1] if within else 0))
                gap = False
            held.clear()
            linked = 0
        own_doubt = False

    def add(text: str) -> None:
        nonlocal linked
        if text and not out_tag:
            held.append(text)
            if in_link:
                linked += len(text.strip())

    at = 0
    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        attrs = m["attrs"] or m["attrs2"] or ""
        if m["close"] or m["close2"]:
            if tag == "a":
                in_link = False
            if inner and tag in inner:
                while inner.pop() != tag:
                    pass
                out_tag = out_tag if inner else ""
                continue
            if inner and _ends_parent(out_tag, tag, around):
                inner, out_tag = [], ""
            if out_tag:
                if tag == out_tag and not inner:
                    out_depth -= 1
                    if not out_depth:
                        out_tag = ""
                continue
            if tag in BLOCKS:
                end_line()
                around[tag] = max(0, around.get(tag, 0) - 1)
            if any(tag == x for x, _ in within):
                while within.pop()[0] != tag:
                    pass
            if roots and tag == roots[-1]:
                roots.pop()
            if doubts and tag == doubts[-1]:
                doubts.pop()
                doubted_in.pop()
            continue
        if tag == "a":
            in_link = True
        if tag in BLOCKS:
            if not out_tag:
                end_line()
            in_link = in_link and tag not in ("p", "article", "main")
        if inner:
            inner = _still_open(inner, tag)
            out_tag = out_tag if inner else ""
        sure = _marked(tag, attrs, bool(roots), bool(around.get("pre")))
        if out_tag:
            if tag in ("article", "main") and sure < 1 and not roots:
                inner, out_tag, out_depth = [], "", 0  # an unwanted element that was never closed
            elif inner:
                if tag not in VOID and not attrs.endswith("/"):
                    inner.append(tag)
                continue
            else:
                out_depth += tag == out_tag and not attrs.endswith("/")
                continue
        if sure == 1:
            if tag not in VOID:
                end_line()
                out_tag, out_depth = tag, 1
                inner = [tag] if tag in ENDED_BY else []
            gap = True
            continue
        if tag == "br":
            add(" ")
        if tag in LINE_TAGS:
            own_doubt = bool(sure)
        elif (sure or (doubts and tag == doubts[-1])) and tag not in VOID and tag not in ENDED_BY:
            doubts.append(tag)
            doubted_in.append(bool(roots) if sure else doubted_in[-1])
        if tag in BLOCKS and tag not in VOID:
            around[tag] = around.get(tag, 0) + 1
        if tag in CONTAINERS:
            containers += 1
            within.append((tag, containers))
        if tag in ("article", "main") or "main" in attrs and re.search(r"role\s*=\s*[\"']?main\b", attrs):
            roots.append(tag)
        elif roots and tag == roots[-1]:
            roots.append(tag)
    add(page[at:])
    end_line()
    return out


def stretches(weights: list[int], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(surge, dive, peak) of each stretch: from a weight behind a window without any to the last one before such a
    window, and the greatest sum over a window in it."""
    given = np.asarray(weights, np.int64)
    some = np.flatnonzero(given)
    if not len(some):
        return []
    sums = np.convolve(given, np.ones(window, np.int64))[: len(given)]  # of a line and those before it
    first = np.flatnonzero(np.append(True, np.diff(some) > window))
    last = np.append(first[1:], len(some)) - 1
    return [(int(some[a]), int(some[b]), int(sums[some[a] : some[b] + window].max())) for a, b in zip(first, last, strict=True)]


def main_text(page: str | None) -> str:
    """The lines between the surge and dive points of the page's text, joined by line feeds.

    A line weighs the length of its text, half of it if a name casts doubt on it, none if most of it is links or if it
    is shorter than SURGE and its own name is in doubt; content that is not the article's counts as a window of empty lines.  If article and main elements hold a fair
    share of that weight, lines in them weigh SURGE more, whatever links they hold unless a name casts doubt on them,
    and others weigh nothing; else these elements (teasers, cards) say nothing.  Of the stretches between surge and dive those whose windows
    sum to SURGE count, or the one of greatest sum if none does.  Without such elements every line between the first
    and the last of them stays, and the stretches of text beside them in the same container.
    """
    found = lines(page or "")
    if not found:
        return ""
    plain = [0 if x.linked > LINKED or (x.doubted == 1 and len(x.text) < SURGE) else len(x.text) // (2 if x.doubted else 1) or 1 for x in found]
    in_articles = sum(w for w, x in zip(plain, found, strict=True) if x.article)
    trusted = any(x.article for x in found) and in_articles >= ARTICLES * sum(plain)
    weights: list[int] = []
    place: list[int] = []
    for x, weight in zip(found, plain, strict=True):
        weights += [0] * (WINDOW * x.gap)
        place.append(len(weights))
        article = x.article and not (x.doubted and x.linked > LINKED)
        weights.append(weight if not trusted else len(x.text) + SURGE if article else 0)
    parts = stretches(weights)
    chosen = [p for p in parts if p[2] >= SURGE] or sorted(parts, key=lambda p: (-p[2], p[0]))[:1]
    between = np.zeros(len(weights), bool)
    for surge, dive, _ in chosen:
        between[surge : dive + 1] = True
    sure = [n for n, k in enumerate(place) if weights[k] and between[k]]
    if trusted or not sure:
        return "\n".join(found[n].text for n in sure)
    beside = {found[n].container for n in sure}
    kept = [x.text for n, x in enumerate(found) if sure[0] <= n <= sure[-1] or (weights[place[n]] and x.container in beside)]
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of pages; row-local, without a shuffle.

    Defined results: null, empty and text-less html give an empty text; null ids and urls stay null, and ids of any
    type pass unchanged; repeated rows give repeated results; an empty table gives an empty one; a very long page is
    one pass over its text; other columns, of any name, are not read.
    """
    rows = pages.select("page_id", "url", "html")
    schema = rows.drop("html").schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x) for x in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=schema.names)

    return rows.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all pages."""
    return extract(table(spark, sf_dir, "pages"))
