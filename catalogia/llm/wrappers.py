"""Main text of HTML pages by wrappers that are inferred from all pages of a host.

A page is a balanced stream of block tags and texts. A wrapper is a union-free regular expression over such streams: tags, text slots, optional parts (?)
and repeated groups (+). Streams of one host are aligned one after the other, and so are wrappers: parts with the same tag and class meet in order; a part
that only one side has becomes optional; parts that come again, or in another order, make everything between them a repeated group; texts that differ make
a slot. So each part stands once among its siblings, and a page's tokens lead through the wrapper without search.

Slots keep how much text they had, how much of it was links, and whether it was always the same. By that, and by what tags and classes say, a wrapper
tells the regions that hold the host's articles, and in them the parts that are no article.

Every task makes a wrapper of its pages of each host; then wrappers of a host are merged some at a time, in as many rounds as it takes, so no host's pages
or wrappers meet in one task. The longest page of a task is held whole.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from catalogia.llm import common

#: Wrappers of a host that are merged at once.
MERGED = 64
#: Parts of all wrappers that a task keeps before it gives them out and begins anew.
HELD_PARTS = 200_000
#: Siblings with different classes that a part keeps apart; beyond, tags alone count.
SIBLINGS = 64
#: Nested blocks; what lies deeper counts as lying here.
DEPTH = 100
#: Bytes of all wrappers that may be sent to every task.
SMALL_BYTES = 32 << 20
#: The share of a part's text that one of its children must hold for the region to be looked for in there.
MOST = 0.7
#: A text that this many pages share, and no page has otherwise, belongs to the template.
SHARED = 3
#: A slot whose characters are links to this share is a menu, unless it is in what is called an article.
LINKS = 0.7

# What HTML says of its tags, and words by which authors name parts that are no article: fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes xmp textarea title".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup html legend li listing main menu nav ol "
    "optgroup option p plaintext pre section select summary table tbody td tfoot th thead tr ul button hr head".split()
)
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "body": {"head"}}
HOLDERS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
CONTAINERS = frozenset("html body div main article section center table tbody tr td form fieldset".split())
NO_ARTICLE = frozenset("nav footer aside form head select option optgroup button dialog menu fieldset legend svg canvas object audio video datalist".split())
NO_ARTICLE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NO_ARTICLE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar cookie cookies consent "
    "gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended comment comments disqus respond reply replies widget pagination pager toolbar copyright".split()
)
SITE_WORDS = frozenset("header".split())
NOT_SO = frozenset("no has with without hide".split())

PLAIN, APART, ARTICLE, HEADER, NAMED_APART = range(5)
_TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I | re.S)
_SPEAKS = re.compile(r"class|id|role|itemprop|style|hidden", re.I)
_SPACE = re.compile(r"\s+")


def _told(tag: str, attributes: str) -> tuple[str, int]:
    """What a tag is called in wrappers, and what it and its attributes say of it."""
    return _known(tag, attributes if _SPEAKS.search(attributes) else "")


@lru_cache(100_000)
def _known(tag: str, attributes: str) -> tuple[str, int]:
    said = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    names = [re.sub(r"\d{3,}", "", w) for w in (said.get("class", "") + " " + said.get("id", "")).split()]
    names = sorted({w for w in names if w})
    words = [re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", w) for w in names]
    words = {w[k].lower() for w in words for k in range(len(w)) if not NOT_SO & {x.lower() for x in w[:k]}}
    role = said.get("role", "").lower()
    key = tag if tag in ("html", "body", "head") else ".".join([tag, *names[:4]]) + (f"@{role}" if role else "")
    if tag in NO_ARTICLE and tag not in ("form", "fieldset") or role in NO_ARTICLE_ROLES or "hidden" in said or said.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", said.get("style", "")):
        return key, APART
    if tag in ("html", "body"):
        return key, PLAIN
    if tag in ("article", "main") or role in ("main", "article") or said.get("itemprop", "").lower() == "articlebody":
        return key, NAMED_APART if words & {"comment", "comments", "reply", "replies"} else ARTICLE
    if tag == "header" or words & SITE_WORDS:
        return key, HEADER
    return key, NAMED_APART if tag in ("form", "fieldset") or words & NO_ARTICLE_WORDS else PLAIN


class Block:
    """An element of a page: its name, what that says, and its blocks and texts (text, characters of links) in order."""

    __slots__ = ("key", "tag", "kind", "kids")

    def __init__(self, key: str, tag: str, kind: int):
        self.key, self.tag, self.kind, self.kids = key, tag, kind, []


def _text(parts: list[tuple[str, bool]]) -> tuple[str, int]:
    whole = _SPACE.sub(" ", entities.unescape("".join(t for t, _ in parts))).strip()
    return whole, min(len(whole), sum(len(t) for t, link in parts if link))


def parsed(page: str) -> Block:
    """The page as balanced blocks. Raw elements (scripts, styles, titles) and comments are left out, inline tags are only looked through."""
    root = Block("", "", PLAIN)
    stack, deep, inline, parts = [root], [], [], []  # deep: open blocks beyond DEPTH; inline: open inline tags and whether they are no article

    def ended() -> None:
        if parts:
            text = _text(parts)
            if text[0]:
                stack[-1].kids.append(text)
            parts.clear()

    def said(text: str) -> None:
        if text and not any(apart for _, apart in inline):
            parts.append((text, any(name == "a" for name, _ in inline)))

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if not m:
            said(page[at:])
            break
        said(page[at : m.start()])
        at = m.end()
        close, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            if tag in BLOCKS:
                ended()
                inline.clear()
                if tag in deep:
                    del deep[len(deep) - 1 - deep[::-1].index(tag) :]
                    continue
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
                if k and not (tag == "p" and any(b.tag in CONTAINERS for b in stack[k + 1 :])):
                    del stack[k:]
                    deep.clear()
            else:
                k = next((k for k in range(len(inline) - 1, -1, -1) if inline[k][0] == tag), -1)
                if k >= 0:
                    del inline[k:]
        elif tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else size
        elif tag in BLOCKS:
            ended()
            if stack[-1].tag == "p":
                stack.pop()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in HOLDERS.get(tag, ()):
                    break
                if stack[k].tag in IMPLIED.get(tag, ()):
                    del stack[k:]
                    break
            inline.clear()
            if len(stack) >= DEPTH:
                deep += [tag] * (tag not in VOID and len(deep) < DEPTH)
            elif tag not in VOID:
                key, kind = _told(tag, attributes)
                stack[-1].kids.append(Block(key, tag, kind))
                stack.append(stack[-1].kids[-1])
        elif tag == "br":
            said(" ")
        elif tag not in VOID:
            inline.append((tag, _told(tag, attributes)[1] in (APART, NAMED_APART)))
    ended()
    return root


# ---- wrappers: a part is [key, tag, kind, times, parts, groups] or, for a text, ["#", pages, characters, characters of links, hash or ""];
# groups are first and last places among the parts that may come again.


def _aligned(a: list, b: list) -> tuple[list, dict[int, int], dict[int, int]]:
    """Both sides' parts in one order, those that meet side by side, and where each side's parts are now."""
    where = {part[0]: j for j, part in enumerate(b)}
    both = [(i, where[part[0]]) for i, part in enumerate(a) if part[0] in where]
    tails, ends, before = [], [], {}
    for i, j in both:  # the longest row of common parts that come in the same order on both sides
        low, high = 0, len(tails)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if tails[mid] < j else (low, mid)
        before[j] = (i, ends[low - 1] if low else None)
        tails[low:], ends[low:] = ([j], [j]) if low == len(tails) else ([j, *tails[low + 1 :]], [j, *ends[low + 1 :]])
    anchors, j = [], ends[-1] if ends else None
    while j is not None:
        i, up = before[j]
        anchors.append((i, j))
        j = up
    out, at_a, at_b, x, y = [], {}, {}, 0, 0
    for i, j in [*reversed(anchors), (len(a), len(b))]:
        for at, side, k, end in ((at_a, a, x, i), (at_b, b, y, j)):
            for p in range(k, end):
                at[p] = len(out)
                out.append(side[p])
        x, y = i + 1, j + 1
        if i < len(a):
            at_a[i] = len(out)
            out.append(a[i])
            at_b[j] = len(out)
            out.append(b[j])
    return out, at_a, at_b


def _folded(parts: list, groups: list, same_page: bool, met: set[int] = frozenset()) -> tuple[list, list]:
    """Each key once: parts that come again make a repeated group of all between. met: places whose part meets the one before it, which is no repetition."""
    first: dict[str, int] = {}
    last: dict[str, int] = {}
    for k, part in enumerate(parts):
        first.setdefault(part[0], k)
        last[part[0]] = k
    spans = sorted([*groups, *((first[key], k) for key, k in last.items() if k > first[key] and not (k == first[key] + 1 and k in met))])
    whole: list[list[int]] = []
    for s, e in spans:
        if whole and s <= whole[-1][1]:
            whole[-1][1] = max(e, whole[-1][1])
        else:
            whole.append([s, e])
    out, place, bounds = [], {}, []
    owner = {}
    for k, part in enumerate(parts):
        if part[0] in place:
            at = place[part[0]]
            out[at] = merged(out[at], part, same_page)
        else:
            at = place[part[0]] = len(out)
            out.append(part)
        owner[k] = at
    for s, e in whole:
        held = {owner[k] for k in range(s, e + 1)}
        bounds.append([min(held), max(held)])
    return out, bounds


def _wide(parts: list, groups: list) -> tuple[list, list]:
    """Too many siblings: those with the same tag and the same meaning become one."""
    if len(parts) <= SIBLINGS:
        return parts, groups
    plain = [p if p[0] == "#" else [f"{p[1]}.~{p[2]}" if p[2] else f"{p[1]}.~", *p[1:]] for p in parts]
    return _folded(plain, groups, False)


def merged(a: list, b: list, same_page: bool) -> list:
    """The wrapper of both: of two parts of one page, or of parts of different pages."""
    if a[0] == "#":
        return ["#", max(a[1], b[1]) if same_page else a[1] + b[1], a[2] + b[2], a[3] + b[3], a[4] if a[4] == b[4] else ""]
    parts, at_a, at_b = _aligned(a[4], b[4])
    groups = [[at_a[s], at_a[e]] for s, e in a[5]] + [[at_b[s], at_b[e]] for s, e in b[5]]
    met = {k for k in at_b.values() if k and parts[k - 1][0] == parts[k][0]}
    parts, groups = _folded(parts, groups, same_page, met)
    return [a[0], a[1], a[2], a[3] + b[3], *_wide(parts, groups)]


def wrapper_of(block: Block) -> list:
    """The wrapper of one page."""
    parts = [["#", 1, len(kid[0]), kid[1], blake2b(kid[0].encode("utf-8", "replace"), digest_size=8).hexdigest()] if isinstance(kid, tuple) else wrapper_of(kid) for kid in block.kids]
    return [block.key, block.tag, block.kind, 1, *_wide(*_folded(parts, [], True))]


def size_of(part: list) -> int:
    return 1 if part[0] == "#" else 1 + sum(map(size_of, part[4]))


def as_regex(part: list) -> str:
    """The wrapper as text: # is a slot, #= a text of the template; in a group that comes again each part may be left out."""
    if part[0] == "#":
        return "#=" if part[4] and part[1] >= SHARED else "#"
    inner, ends, begins = [], {e for _, e in part[5]}, {s for s, _ in part[5]}
    for k, p in enumerate(part[4]):
        grouped = any(s <= k <= e for s, e in part[5])
        text = as_regex(p)
        if not grouped and p[0] != "#" and p[3] < part[3]:
            text = f"({text})?"
        inner.append("(" * (k in begins) + text + ")+" * (k in ends))
    return f"<{part[0]}>{''.join(inner)}</>" if part[0] else "".join(inner)


class Reader:
    """What a wrapper says of the pages of its host: for each part whether it is left out, and the regions of articles, the surest first."""

    def __init__(self, root: list):
        self.parts: dict[int, dict[str, list]] = {}
        self.apart: set[int] = set()
        self.held: dict[int, int] = {}
        self.root = root
        self.total = self._weigh(root, False)
        self._name(root, False)
        self._weigh(root, True)
        self.regions: list[int] = []
        self.article: set[int] = set()
        while len(self.regions) < 8:
            found = self._region()
            if found is None:
                break
            self.regions.append(found)
        self.varied = self._varies(root)

    def _weigh(self, part: list, skip: bool) -> int:
        """Characters of the part's texts, links left out, kept by part; skip: without what is no article."""
        if part[0] == "#":
            return max(0, part[2] - part[3])
        if skip and id(part) in self.apart:
            self.held[id(part)] = 0
            return 0
        self.held[id(part)] = sum(self._weigh(p, skip) for p in part[4])
        return self.held[id(part)]

    def _name(self, part: list, inside: bool) -> None:
        """Which parts are no article: by tag, or by name unless they hold most of the host's text; a header only outside an article."""
        self.parts[id(part)] = {p[0]: p for p in part[4]}
        for p in part[4]:
            if p[0] == "#":
                continue
            most = self.held[id(p)] > 0.5 * self.total
            if p[2] == APART or p[2] == NAMED_APART and not most or p[2] == HEADER and not inside and not (most and p[1] != "header"):
                self.apart.add(id(p))
            self._name(p, inside or p[2] == ARTICLE)

    def _region(self) -> int | None:
        """The part that holds the articles best, of the text that no region holds yet."""
        if self.held[id(self.root)] <= 0.05 * self.total or not self.total:
            return None
        part, path, article = self.root, [self.root], None
        while True:
            inner = [p for k, p in enumerate(part[4]) if p[0] != "#" and id(p) not in self.apart and self.held[id(p)] and p[1] in CONTAINERS and (p[2] == ARTICLE or not any(s <= k <= e and part[3] * 1.5 < p[3] for s, e in part[5]))]
            named = self._article_below(part)
            if named and named[-1] is not part and self.held[id(named[-1])] >= 0.3 * self.held[id(part)]:
                path += named
                part = article = named[-1]
                break
            best = max(inner, key=lambda p: self.held[id(p)], default=None)
            if best is None or self.held[id(best)] < MOST * self.held[id(part)]:
                break
            part = best
            path.append(part)
        if article is not None:
            self.article.add(id(article))
        taken = self.held[id(part)]
        if not taken:
            return None
        for p in path:
            self.held[id(p)] -= taken
        return id(part)

    def _article_below(self, part: list) -> list | None:
        """The way to the part that is called an article, holds text, and holds the most of it; the outermost of such."""
        best, way = 0, None
        for p in part[4]:
            if p[0] == "#" or id(p) in self.apart or self.held[id(p)] <= best:
                continue
            below = [p] if p[2] == ARTICLE else self._article_below(p)
            if below and p[2] != ARTICLE:
                below = [p, *below]
            if below and self.held[id(below[-1])] > best:
                best, way = self.held[id(below[-1])], below
        if way and way[-1][1] == "main":  # an article in main, if it holds most of it
            inner = self._article_below(way[-1])
            if inner and self.held[id(inner[-1])] >= MOST * best:
                way = [*way, *inner]
        return way

    def _varies(self, part: list) -> bool:
        """Whether a text that isn't left out differs between pages."""
        return not part[4] if part[0] == "#" else id(part) not in self.apart and any(map(self._varies, part[4]))

    def text(self, page: Block) -> str:
        """The page's texts in the first region that it has; if it has none, all that isn't left out."""
        found: dict[int, list[str]] = {}
        self._read(page, self.root, (), found, False)
        return "\n\n".join(next((found[r] for r in self.regions if r in found), found.get(0, [])))

    def _read(self, block: Block, part: list | None, regions: tuple[int, ...], found: dict[int, list[str]], article: bool) -> None:
        if part is not None and id(part) in self.regions:
            regions = (*regions, id(part))
            found.setdefault(id(part), [])
            article = article or id(part) in self.article
        known = self.parts[id(part)] if part is not None else {}
        for kid in block.kids:
            if isinstance(kid, tuple):
                slot = known.get("#")
                if not article and self.varied and slot is not None and (slot[4] and slot[1] >= SHARED or slot[3] >= LINKS * slot[2]):
                    continue
                for r in (0, *regions):
                    found.setdefault(r, []).append(kid[0])
                continue
            below = known.get(kid.key) or known.get(f"{kid.tag}.~{kid.kind}" if kid.kind else f"{kid.tag}.~")
            if id(below) in self.apart if below is not None else kid.kind not in (PLAIN, ARTICLE):
                continue
            self._read(kid, below, regions, found, article)


@lru_cache(256)
def _reader(wrapper: str) -> Reader:
    return Reader(json.loads(wrapper))


def _with_host(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))


def _of_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A wrapper of the task's pages of each host."""
    held: dict[str, list] = {}
    count: dict[str, int] = {}
    parts = 0
    for b in batches:
        for host, page in zip(b.column("host").to_pylist(), b.column("html")):
            new = wrapper_of(parsed(page.as_py()))
            before = size_of(held[host]) if host in held else 0
            held[host] = merged(held[host], new, False) if host in held else new
            count[host] = count.get(host, 0) + 1
            parts += size_of(held[host]) - before
            if parts > HELD_PARTS:
                yield _rows(held, count)
                held, count, parts = {}, {}, 0
    yield _rows(held, count)


def _rows(held: dict[str, list], count: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([count[h] for h in held], pa.int64()), pa.array([json.dumps(w, separators=(",", ":")) for w in held.values()], pa.string())], ["host", "pages", "wrapper"])


def _merged_rows(rows: pd.DataFrame) -> pd.DataFrame:
    order = rows.sort_values(["pages", "wrapper"], ascending=[False, True])
    whole = None
    for text in order["wrapper"]:
        one = json.loads(text)
        whole = one if whole is None else merged(whole, one, False)
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "pages": [int(rows["pages"].sum())], "wrapper": [json.dumps(whole, separators=(",", ":"))]})


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, pages, wrapper (JSON; see as_regex): one row a host, inferred from all its pages. Pages without a host are those of the host "".

    Null and empty html are pages without parts. An empty table has no wrappers. Written to the shared folder.
    """
    src = _with_host(pages, url_col, url_col, html_col).select("host", "html")
    found = common.saved(src.mapInArrow(_of_tasks, "host string, pages long, wrapper string"), "wrappers")
    while (most := found.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        part = F.pmod(F.xxhash64("wrapper", "pages"), F.lit(-(-most // MERGED)))
        if most <= MERGED:
            part = F.lit(0)
        found = common.saved(found.groupBy("host", part.alias("part")).applyInPandas(_merged_rows, "host string, pages long, wrapper string"), "wrappers")
    return found


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", small_bytes: int = SMALL_BYTES) -> DataFrame:
    """page_id, url, text: each page's article, its blocks parted by an empty line.

    A row for each row of pages, repeated and null ids included; null and empty html, and pages without any text, have an empty text. Other columns don't
    matter. Wrappers meet their pages by broadcast if all of them have at most small_bytes, else by a join on the host whose hot hosts Spark splits.
    """
    wrappers = infer_wrappers(pages, url_col, html_col)
    size = wrappers.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    known = wrappers.select("host", "wrapper")
    src = _with_host(pages, id_col, url_col, html_col)
    both = src.join(F.broadcast(known) if size <= small_bytes else known.hint("merge"), "host").select("page_id", "url", "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [_reader(w).text(parsed(h.as_py())) for h, w in zip(b.column("html"), b.column("wrapper").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return both.mapInArrow(run, f"page_id {src.schema['page_id'].dataType.simpleString()}, url string, text string")
