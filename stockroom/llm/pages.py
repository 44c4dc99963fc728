"""Main text of web pages, from containers that the pages of a host agree on.

First each page scores its containers by the text they hold outside boilerplate and links. A class or id that names boilerplate
does not drop a wrapper that holds the page's text (`_settled`). The scores are added over all pages of a host by path, the tags and classes from the root with numbers generalised. Then every page is read again, and its text
is taken from the container whose path its host votes for most among those the page has.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from stockroom.llm.common import lean, strings, written

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)>""", re.S | re.X)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
DIGITS = re.compile(r"\d+")

# Fixed values of the markup language.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub "
             "sup time tt u var wbr img".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
               "header hgroup hr main menu nav ol p pre section summary table ul".split())
IN_HEAD = set("title meta link script style base noscript template".split())
SIBLINGS = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "option": ("option", {"select"}),
            "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}),
            "tbody": ("thead tbody tr td th", {"table"}), "tfoot": ("thead tbody tr td th", {"table"})}
# Elements that are never main text, and words in class or id that mark such elements.
DROPPED = set("head nav footer aside noscript template svg canvas button select textarea object menu iframe script style "
              "audio video map datalist".split())
MARKS = set("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
            "notice notices notification newsletter subscribe subscription signup login sidebar menu nav navbar navigation breadcrumb "
            "breadcrumbs pagination pager related recommended recommendations share sharing social comment comments disqus replies "
            "discussion footer masthead popup modal overlay widget toolbar copyright disclaimer paywall".split())
ROLES = set("navigation banner contentinfo complementary search alertdialog alert menu menubar".split())
#: Elements and roles that are boilerplate like marked ones, unless they hold the page's text: some frameworks wrap whole pages in them.
WRAPPERS = {"form", "dialog"}
#: Of these, marks of what may be most of a page's text and still not be its main text.
DISCUSSION = set("comment comments disqus replies discussion".split())
TEXT_MARKS = set("article content entry post story text".split())
WHOLE = {"html", "body", "article", "main"}
CONTAINERS = set("html body article main section div td center".split())
DECAY, LINKED, LEAST = 0.75, 0.1, 1e-4
LONGEST_PATH = 1000
BOOST = {"article": 3.0, "main": 2.5}
TEXT_BOOST = 1.5


def _attributes(rest: str) -> dict[str, str]:
    return {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(rest)}


class _Open:
    """An element. `marked`: its class or id names boilerplate; `dropped`: it is none of the page's text whatever it holds."""

    __slots__ = ("tag", "path", "words", "dropped", "marked", "linked", "outer", "up", "inside", "boost", "article", "mass", "main", "best", "talk")

    def __init__(self, tag, path, words, dropped, marked, linked, outer, up, inside, boost, article):
        self.tag, self.path, self.words, self.dropped, self.marked, self.linked = tag, path, words, dropped, marked, linked
        self.outer, self.up, self.inside, self.boost, self.article = outer, up, inside, boost, article
        self.talk = outer is not None and outer.talk or marked and bool(words & DISCUSSION)
        # Characters outside links, and whether it is or holds a main element or the page's foremost text container.
        self.mass, self.main, self.best = 0, tag == "main" and not dropped, False


def _entered(tag: str, rest: str, outer: _Open, chosen: str | None) -> _Open:
    names = _attributes(rest) if rest.strip(" /") else {}
    path, dropped, marked, boost = outer.path, outer.dropped, False, 1.0
    words: set[str] = set()
    if names:
        listed = f"{names.get('class', '')} {names.get('id', '')}"
        words = {w.lower() for w in NAME.findall(listed)}
    if (tag not in INLINE or words & MARKS) and not dropped:
        role = names.get("role", "").lower()
        dropped = tag in DROPPED or "hidden" in names or names.get("aria-hidden") == "true" or role in ROLES or \
            "display:none" in names.get("style", "").replace(" ", "").lower() or tag == "dialog" and "open" not in names
        if not dropped and tag not in WHOLE:
            # A header belongs to the page unless it stands in an article, whose title it holds.
            header = (tag == "header" or "header" in words) and not outer.article and not words & TEXT_MARKS
            marked = header or bool(words & MARKS) or tag in WRAPPERS or role in WRAPPERS
    if tag in CONTAINERS:
        classes = ".".join(sorted(DIGITS.sub("#", names.get("class", "")).split())) if names else ""
        path = f"{path}>{tag}.{classes}" if classes else f"{path}>{tag}"
        if len(path) > LONGEST_PATH:  # the same path gives the same digest on every page
            path = "#" + xxhash.xxh128_hexdigest(path)
        boost = BOOST.get(tag, TEXT_BOOST if words & TEXT_MARKS else 1.0)
    up = outer if outer.tag in CONTAINERS or outer.up is None else outer.up
    return _Open(tag, path, words, dropped, marked, outer.linked or tag == "a", outer, up, outer.inside or (tag in CONTAINERS and path == chosen),
                 boost, outer.article or tag in ("article", "main"))


def _settled(nodes: list[_Open]) -> None:
    """Drop the marked elements, and what is inside, except those that hold the page's text.

    Spared are elements with a main element, with the foremost text container (an article or a container with a text mark, the
    one with the most text outside comments), or with more than half of the page's text outside links. Comments are
    not spared for their length while there is a text container.
    """
    if any(n.marked for n in nodes):
        for n in reversed(nodes):
            if n.outer is not None and not n.dropped:
                n.outer.mass += n.mass
                n.outer.main |= n.main
        texts = [n for n in nodes if n.mass and not n.dropped and (n.tag == "article" or n.tag in CONTAINERS and n.tag not in WHOLE and n.words & TEXT_MARKS)]
        best = max(texts, key=lambda n: (not n.talk, n.mass), default=None)
        n = best
        while n is not None:
            n.best, n = True, n.outer
        for n in nodes:
            most = 2 * n.mass > nodes[0].mass and (best is None or not n.talk)
            n.marked = n.marked and not (n.main or n.best or most)
    for n in nodes[1:]:
        n.dropped = n.dropped or n.marked or n.outer.dropped


def read_page(source: str, chosen: str | None = None) -> tuple[dict[str, float], str]:
    """The score of each container path, and the text in containers of the `chosen` path (all of the page for the empty path)."""
    root = _Open("", "", set(), False, False, False, None, None, chosen == "", 1.0, False)
    stack, scores, at, end = [root], {}, 0, len(source)
    nodes: list[_Open] = [root]
    found_texts: list[tuple[_Open | None, str, int]] = []  # element, text, characters that are no spaces; breaks have no element
    number: Counter[str] = Counter()  # of open elements

    def text(piece: str) -> None:
        top = stack[-1]
        if top.dropped:
            return
        if "&" in piece:
            piece = html.unescape(piece)
        mass = len(piece) - piece.count(" ") - piece.count("\n")
        if not top.linked:
            top.mass += mass
        found_texts.append((top, piece, mass))

    def cut(depth: int) -> None:
        for o in stack[depth:]:
            number[o.tag] -= 1
        del stack[depth:]

    def close(depth: int) -> None:
        cut(depth)
        found_texts.append((None, " ", 0))

    def last_open(tags: str, stops: set[str]) -> int | None:
        if not any(number[t] for t in tags.split()):
            return None
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in tags.split():
                return depth
            if stack[depth].tag in stops:
                return None
        return None

    while at < end:
        start = source.find("<", at)
        if start < 0:
            text(source[at:])
            break
        if start > at:
            text(source[at:start])
        found = TOKEN.match(source, start)
        if not found:
            text("<")
            at = start + 1
            continue
        at = found.end()
        tag = found["tag"] or found["tag2"]
        if not tag:
            continue
        tag, ending, rest = tag.lower(), found["end"] or found["end2"], found["rest"] or found["rest2"] or ""
        if ending:
            if tag in ("html", "body") or not number[tag]:
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    if tag in INLINE:
                        cut(depth)
                    else:
                        close(depth)
                    break
                if tag in INLINE and stack[depth].tag not in INLINE or stack[depth].tag in ("td", "th") and tag not in ("tr", "table", "tbody"):
                    break
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            close(len(stack) - 1)
        if tag in RAW:
            closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            at = closing.end() if closing else end
            continue
        if tag in CLOSES_P and (depth := last_open("p", {"td", "th", "button", "caption", "object"})):
            close(depth)
        if tag in SIBLINGS and (depth := last_open(*SIBLINGS[tag])):
            while (again := last_open(*SIBLINGS[tag])) and again <= depth:
                depth = again
                close(depth)
        if tag not in INLINE:
            found_texts.append((None, " ", 0))
        if tag in VOID or rest.endswith("/") and tag not in CONTAINERS | CLOSES_P:
            continue
        if tag in ("html", "body") and number[tag]:
            continue
        stack.append(_entered(tag, rest, stack[-1], chosen))
        nodes.append(stack[-1])
        number[tag] += 1
    _settled(nodes)
    out = []
    for top, piece, mass in found_texts:
        if top is None:
            out.append(piece)
            continue
        if top.dropped:
            continue
        if top.inside:
            out.append(piece)
        if chosen is None and mass:
            worth, box = mass * (LINKED if top.linked else 1.0), top if top.tag in CONTAINERS or top.up is None else top.up
            while box is not None and worth > LEAST * mass:
                scores[box.path] = scores.get(box.path, 0.0) + worth * box.boost
                worth *= DECAY
                box = box.up
    return scores, " ".join("".join(out).split())


def extract(df: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `df` (page_id, url, html).

    Null or empty html gives the empty text. Pages without a host in their url vote together. Rows may repeat and page_id may be null:
    a page is known by its id and a hash of its contents. An empty table gives no rows.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = df.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("mark"), host.alias("host"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, paths, shares = [], [], []
            for i, source in enumerate(strings(batch.column(2))):
                scores, _ = read_page(source)
                total = sum(scores.values())
                for path, value in scores.items():
                    at.append(i)
                    paths.append(path)
                    shares.append(int(1e6 * value / total))
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(paths, pa.string()),
                                              pa.array(shares, pa.int64())], ["mark", "host", "path", "share"])

    voted = written(rows.select("mark", "host", "html").mapInArrow(lean(score), "mark long, host string, path string, share long"), "paths")
    votes = voted.groupBy("host", "path").agg(F.sum("share").alias("votes"))
    chosen = voted.join(votes, ["host", "path"]).groupBy("mark").agg(
        F.max(F.struct("votes", "share", "path"))["path"].alias("path"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [read_page(s, p)[1] if p is not None else "" for s, p in zip(strings(batch.column(2)), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = df.schema["page_id"].dataType.simpleString()
    return rows.join(chosen, "mark", "left").select("page_id", "url", "html", "path").mapInArrow(
        lean(take), f"page_id {kind}, url string, text string, n_chars long")
