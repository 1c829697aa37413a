"""Main text of web pages by inferred wrappers (operator 3).

Pages of one host come from few templates. Each page becomes a tree of block
tags and text tokens. The trees of a host are aligned one after another into its
wrapper, a union-free regular expression: equal tokens stay as they are; texts
that differ in one place become a text slot; what only one side has becomes an
optional item; and elements with slots that repeat become a repeated group of
optional items, (h2? p? ul?)+. A constant text is template text if it stands in
its place on more than half of the host's pages, on ``PROOF`` different ones at
least; anything else is what a page brings, its slots. The wrapper also tells
the host's content element: the narrowest that holds nearly all slot text.

A page is read through its wrapper: its tree is aligned with it once more, its
template text is left out, and what remains is read from the content element, if
that holds nearly all of the page's own text too, or else from the page's own.
``article`` and ``main`` are taken at their word: where they hold most of a
page's text they are its content, with their repeated texts. On a host where
template texts would be most of the text (copies of a page, say), they aren't
held to be template. A page whose host has no wrapper is read by the same rules,
all its texts being slots.

Some elements are left out by what they are: ``nav``, ``footer``, ``aside`` and
the like; and forms, headers outside an article, elements whose class or id ends
in a word for chrome (``cookie-notice`` does, ``share-price-news`` doesn't), and
lists of short links only, unless they hold nearly all of a page without an article.

Scale: a task aligns the pages it reads, so a host costs its pages' alignment,
wherever these lie, and one wrapper for each task that met it; those meet in
salted parts, then by host. A wrapper holds at most ``WIDEST`` items beside each
other (rare constants are forgotten first, which loses evidence, never text), and
elements below ``DEEP`` levels count as their ancestor's. Wrappers are stored,
then joined with the pages by host: Spark knows their size, and broadcasts them
if that is below its threshold or else splits a skewed host.

Defined results: a null or empty html, or one without content, gives ''; a null
or odd url is the host ''; pages are read whole, of any length and depth;
repeated rows give repeated results; other columns play no part.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.llm.common import stored

#: A constant text is proven by so many different pages.
PROOF = 3
#: Levels of a tree, and items beside each other in a wrapper.
DEEP, WIDEST = 64, 256
#: Longest text of an item in a list of links.
LINK_CHARS = 40
#: Wrappers that a task holds at once, and parts that a host's wrappers meet in.
HELD, SALTS = 1000, 32

# Tag names and class words.
RAW = "script|style|textarea|title|noscript|template|iframe|svg|xmp|noembed|noframes"
DROPPED = frozenset("head nav footer aside menu dialog button select option label fieldset video audio canvas object map math datalist legend input".split())
SOFT = frozenset(["header", "form"])
BLOCKS = frozenset("html body head nav header footer aside form menu dialog fieldset article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address center details summary hgroup search".split())
HOLDING = frozenset("html body article main div section table tbody tr td center".split())
FLOW = frozenset("h1 h2 h3 h4 h5 h6 hgroup header p blockquote pre figure dl table".split())
VOID = frozenset("br hr img meta link input area base col embed source track wbr".split())
CLOSES_P = BLOCKS
CHROME = frozenset(
    "ad ads advert adverts advertisement adsense adbox banner sponsor sponsored promo promotion nav navbar navigation menu menubar topbar breadcrumb breadcrumbs sidebar side rail widget footer foot header masthead "
    "comment comments respond reply replies discussion disqus cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "toolbar pagination pager copyright legal disclaimer form search tags meta byline hidden skip".split()
)
#: Class words that say nothing of what an element holds.
HOLDERS = frozenset("area bar block box button buttons container content group holder inner item items layer link links list message outer panel section slot text title unit wrap wrapper zone".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog note".split())
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>{RAW})\b[^>]*+(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*?)(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\shidden(?:[\s/]|$)", re.I)
KEY_PART = re.compile(r"[a-z][a-z0-9]*")
NAME_PART = re.compile(r"[a-z]+")
BESIDE = frozenset("has with without no show hide is".split())
SPACE = re.compile(r"\s+")
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def is_chrome(name: str) -> bool:
    """Does a class or id end in a word for chrome, words for mere holders aside?"""
    words = NAME_PART.findall(name.lower())
    if not words or words[0] in BESIDE:
        return False
    while len(words) > 1 and words[-1] in HOLDERS:
        words.pop()
    return words[-1] in CHROME


@lru_cache(maxsize=8192)
def element(name: str, rest: str) -> tuple[str, bool, bool, bool]:
    """An element's key (tag and class words), whether it is left out, whether it is unless it holds most of the text, and whether it is named as content."""
    attributes = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(rest)} if rest else {}
    named = attributes.get("class", "").split() + attributes.get("id", "").split()
    role = attributes.get("role", "").lower()
    hidden = "hidden" in attributes or HIDDEN.search(rest) is not None or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
    words = sorted({w for n in named for w in KEY_PART.findall(n.lower())})
    return name + ("." + ".".join(words) if words else ""), name in DROPPED or hidden or role in ROLES, name in SOFT or any(map(is_chrome, named)), name in ("article", "main") or role == "main"


class Page:
    """A page's elements, in order, and its text blocks."""

    def __init__(self, html: str | None):
        self.parent, self.name, self.key = [-1], [""], [""]
        self.hard, self.soft, self.named = [False], [False], [False]
        #: (text, element, characters outside links)
        self.blocks: list[tuple[str, int, int]] = []
        self._read(html or "")
        self._weigh()

    def _read(self, page: str) -> None:
        parent, name_of, key_of = self.parent, self.name, self.key
        open_, names = [0], Counter()
        parts: list[str] = []
        linked: list[str] = []
        link = False

        def flush() -> None:
            if parts:
                text = SPACE.sub(" ", html_lib.unescape("".join(parts))).strip()
                parts.clear()
                if text:
                    inside = sum(len(x.strip()) for x in linked)
                    self.blocks.append((text, open_[-1], max(0, len(text) - inside)))
            linked.clear()

        def close() -> None:
            names[name_of[open_.pop()]] -= 1

        at = 0
        for m in TOKEN.finditer(page):
            if m.start() > at:
                parts.append(page[at : m.start()])
                if link:
                    linked.append(parts[-1])
            at = m.end()
            name = m["name"]
            if name is None:
                continue
            name = name.lower()
            if at == len(page) and not m[0].endswith(">"):
                break  # a tag cut off by the end of the page
            if name == "a":
                link = not m["close"]
            elif name in ("br", "hr"):
                flush()
            elif name in VOID or (name not in BLOCKS and name not in DROPPED):
                continue
            elif m["close"]:
                flush()
                if names[name]:
                    while name_of[open_[-1]] != name:
                        close()
                    close()
            else:
                flush()
                top = name_of[open_[-1]]
                if (top == "p" and name in CLOSES_P) or (top == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
                    close()
                key, hard, soft, named = element(name, m["rest"] or "")
                up = open_[-1]
                inside = self.named[up]
                open_.append(len(parent))
                parent.append(up)
                name_of.append(name)
                key_of.append(key)
                self.hard.append(hard or self.hard[up])
                self.soft.append(soft and not (name in ("html", "body", "article", "main") or (name == "header" and inside)))
                self.named.append(named or inside)
                names[name] += 1
        if at < len(page):
            parts.append(page[at:])
        flush()

    def _weigh(self) -> None:
        """Which elements are chrome: soft ones aren't if they hold nearly all of the text, and none of it is in an article beside them."""
        n = len(self.parent)
        mass, linked = [0] * n, [0] * n
        most = [0] * n  # longest text
        for text, i, prose in self.blocks:
            if not self.hard[i]:
                mass[i] += len(text)
                linked[i] += len(text) - prose
                most[i] = max(most[i], len(text))
        items = [0] * n
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            mass[up] += mass[i]
            linked[up] += linked[i]
            most[up] = max(most[up], most[i])
            items[up] += self.name[i] == "li" and mass[i] > 0
        beside = [False] * n
        for i in range(1, n):
            beside[i] = self.soft[i] or self.hard[i] or beside[self.parent[i]]
        article = any(self.named[i] and not beside[i] for _, i, _ in self.blocks)
        self.chrome = [False] * n
        for i in range(1, n):
            part = article or 10 * mass[i] < 9 * mass[0]
            soft = self.soft[i] and part
            menu = self.name[i] in ("ul", "ol") and not self.named[i] and items[i] > 1 and linked[i] >= mass[i] > 0 and most[i] <= LINK_CHARS and part
            self.chrome[i] = self.hard[i] or soft or menu or self.chrome[self.parent[i]]

    def tree(self) -> list:
        """Items of the page: a text is its block's number, an element is [element, items]; chrome and empty elements are left out."""
        depth, at = [0] * len(self.parent), list(range(len(self.parent)))
        for i in range(1, len(depth)):
            up = self.parent[i]
            depth[i] = depth[up] + 1
            if depth[i] > DEEP:
                at[i], depth[i] = at[up], DEEP
        items: dict[int, list] = {0: []}
        for k, (_, i, _) in enumerate(self.blocks):
            if self.chrome[i]:
                continue
            i = at[i]
            fresh, node = [], i
            while node not in items:
                fresh.append(node)
                items[node] = []
                node = at[self.parent[node]]
            for x in reversed(fresh):
                items[at[self.parent[x]]].append([x, items[x]])
            items[i].append(k)
        return items[0]


# ---- union-free regular expressions ----
# An item is (TEXT, hash, pages, count, characters outside links), (SLOT, characters), (ELEMENT, key, items), or (GROUP, items) whose
# items are optional and have different heads. In a list, any item may be missing on a page: those that always stand are told by their counts.

TEXT, SLOT, ELEMENT, GROUP = range(4)


def expression(page: Page) -> list:
    """The page's own expression: all its texts are constants, of one page."""
    digest = [xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) >> 1 for t, *_ in page.blocks]
    own = xxhash.xxh64_intdigest(json.dumps(digest).encode()) >> 1

    def of(items: list) -> list:
        return middled([(TEXT, digest[x], (own,), 1, page.blocks[x][2]) if isinstance(x, int) else (ELEMENT, page.key[x[0]], of(x[1])) for x in items])

    return of(page.tree())


def middled(items: list) -> list:
    """Of a very long list all but the ends become one repeated group, so that lists that are aligned are short."""
    return items if len(items) <= WIDEST else [*items[: WIDEST // 4], group(items[WIDEST // 4 : -WIDEST // 4]), *items[-WIDEST // 4 :]]


def head(item: tuple) -> str:
    return item[1] if item[0] == ELEMENT else "#" if item[0] != GROUP else "+"


def same(item: tuple) -> tuple | None:
    """What tells an item of constants; None for one that holds a slot or a group."""
    if item[0] == TEXT:
        return ("#", item[1])
    if item[0] != ELEMENT:
        return None
    inner = [same(x) for x in item[2]]
    return None if None in inner else (item[1], *inner)


def proven(item: tuple) -> int:
    """The most pages that a constant inside has been seen on."""
    if item[0] == TEXT:
        return item[3]
    return max((proven(x) for x in item[2]), default=0) if item[0] == ELEMENT else 0


def chars(item: tuple) -> int:
    if item[0] in (TEXT, SLOT):
        return item[-1]
    return sum(map(chars, item[-1]))


def merge(a: tuple, b: tuple) -> tuple:
    """Two items with the same head, aligned."""
    if a[0] == ELEMENT:
        return (ELEMENT, a[1], align(a[2], b[2]))
    if a[0] == GROUP:
        return group([*a[1], *b[1]])
    if a[0] == b[0] == TEXT and a[1] == b[1]:
        return (TEXT, a[1], tuple(sorted({*a[2], *b[2]})[:PROOF]), a[3] + b[3], a[4] + b[4])
    return (SLOT, a[-1] + b[-1])


def group(items: list) -> tuple:
    """A repeated group: items with the same head become one."""
    by_head: dict[str, tuple] = {}
    for x in items:
        for y in x[1] if x[0] == GROUP else [x]:
            h = head(y)
            by_head[h] = merge(by_head[h], y) if h in by_head else y
    return (GROUP, [by_head[h] for h in sorted(by_head)][:WIDEST])


def pairs(a: list, b: list) -> Iterator[tuple[str, int, int, int, int]]:
    """Matching and other stretches of two lists of keys, the ends first."""
    lo, hi = 0, 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    if lo:
        yield "equal", 0, lo, 0, lo
    mid_a, mid_b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if mid_a and mid_b and not set(mid_a).isdisjoint(mid_b):
        for op, i, i2, j, j2 in SequenceMatcher(None, mid_a, mid_b, autojunk=False).get_opcodes():
            yield op, lo + i, lo + i2, lo + j, lo + j2
    elif mid_a or mid_b:
        yield "replace", lo, len(a) - hi, lo, len(b) - hi
    if hi:
        yield "equal", len(a) - hi, len(a), len(b) - hi, len(b)


def anchors(a: list, b: list) -> Iterator[tuple[str, int, int, int, int]]:
    """Stretches of equal constants, and those between them. What isn't constant equals nothing."""
    return pairs([same(x) or ("a", i) for i, x in enumerate(a)], [same(x) or ("b", i) for i, x in enumerate(b)])


def align(a: list, b: list) -> list:
    """The expression of both sides: first by equal constants, then, between these, by heads."""
    out: list[tuple] = []
    for op, i, i2, j, j2 in anchors(a, b):
        if op == "equal":
            out += [merge(x, y) for x, y in zip(a[i:i2], b[j:j2], strict=True)]
        else:
            out += between(a[i:i2], b[j:j2])
    return narrowed(folded(out))


def between(a: list, b: list) -> list:
    """Items without an equal constant on the other side. Runs of what a group of either side repeats join that group."""
    repeated = {head(y) for x in (*a, *b) if x[0] == GROUP for y in x[1]}
    if repeated:
        a, b = runs(a, repeated), runs(b, repeated)
    out: list[tuple] = []
    for op, i, i2, j, j2 in pairs([head(x) for x in a], [head(x) for x in b]):
        out += [merge(x, y) for x, y in zip(a[i:i2], b[j:j2], strict=True)] if op == "equal" else [*a[i:i2], *b[j:j2]]
    return out


def runs(items: list, repeated: set[str]) -> list:
    """Stretches of items that a group repeats become one group; constants of several pages stay by themselves."""
    out: list[tuple] = []
    for x in items:
        if x[0] == GROUP or (head(x) in repeated and proven(x) < 2):
            out.append(group([out.pop(), x]) if out and out[-1][0] == GROUP else group([x]))
        else:
            out.append(x)
    return out


def varies(item: tuple) -> bool:
    return item[0] in (SLOT, GROUP) or (item[0] == ELEMENT and any(map(varies, item[2])))


def folded(items: list) -> list:
    """Stretches of items with slots become one repeated group where a head repeats among them."""
    out: list[tuple] = []
    at = 0
    while at < len(items):
        end = at
        while end < len(items) and varies(items[end]):
            end += 1
        run = items[at:end]
        heads = [head(x) for x in run]
        out += [group(run)] if len(run) > 1 and ("+" in heads or len(set(heads)) < len(heads)) else run
        out += items[end : end + 1]
        at = end + 1
    return out


def narrowed(items: list) -> list:
    """At most ``WIDEST`` items: constants seen least go first, the later of equals."""
    if len(items) <= WIDEST:
        return items
    order = sorted(range(len(items)), key=lambda i: (not varies(items[i]), -proven(items[i]), i))
    return [items[i] for i in sorted(order[:WIDEST])]


def thaw(x):
    return (*x[:-1], [thaw(y) for y in x[-1]]) if x[0] >= ELEMENT else tuple(tuple(y) if isinstance(y, list) else y for y in x)


# ---- wrappers ----


def finish(items: list, pages: int) -> dict:
    """The wrapper that pages are read by: template texts and the path of the content element."""

    def template(x: tuple) -> bool:
        return x[0] == TEXT and len(x[2]) >= PROOF and 2 * x[3] > pages

    def weigh(items: list) -> tuple[int, int]:
        slot = fixed = 0
        for x in items:
            if x[0] >= ELEMENT:
                s, f = weigh(x[-1])
                slot, fixed = slot + s, fixed + f
            elif template(x):
                fixed += x[-1]
            else:
                slot += x[-1]
        return slot, fixed

    slot, fixed = weigh(items)
    believed = fixed <= slot

    def keep(items: list) -> list:
        """What a page is held against: template texts as hashes, slots as None."""
        return [x[1] if believed and template(x) else None if x[0] <= SLOT else [x[1], keep(x[2])] if x[0] == ELEMENT else ["+", keep(x[1])] for x in items]

    path: list[str] = []
    level = items
    while True:
        mass: dict[str, int] = {}
        for x in level:
            if x[0] == ELEMENT and x[1].partition(".")[0] in HOLDING:
                mass[x[1]] = mass.get(x[1], 0) + (weigh(x[2])[0] if believed else chars(x))
        best = max(mass, key=lambda k: (mass[k], k), default=None)
        if best is None or 10 * mass[best] < 9 * (slot if believed else slot + fixed):
            break
        path.append(best)
        level = [y for x in level if x[0] == ELEMENT and x[1] == best for y in x[2]]
    kept = keep(items)
    return {"items": kept, "path": path, "template": believed and fixed_count(kept)}


def fixed_count(items: list) -> bool:
    """Does a wrapper hold any template text?"""
    return any(fixed_count(x[1]) if isinstance(x, list) else x is not None for x in items)


def prepared(items: list) -> list[tuple[int | None, str, list]]:
    """A wrapper's items as (identity, head, items); the identity is None where a slot or a group is inside."""
    out: list[tuple[int | None, str, list]] = []
    for x in items:
        if not isinstance(x, list):
            out.append((None if x is None else hash(("#", x)), "#", []))
        else:
            inner = prepared(x[1])
            whole = x[0] != "+" and all(y[0] is not None for y in inner)
            out.append((hash((x[0], *(y[0] for y in inner))) if whole else None, x[0], inner))
    return out


def fixed_texts(wrapper: list, page: Page) -> set[int]:
    """Numbers of the page's blocks that align with template text."""
    tree = page.tree()
    known: dict[int, int] = {}

    def identity(x) -> int:
        if isinstance(x, int):
            return hash(("#", xxhash.xxh64_intdigest(page.blocks[x][0].encode("utf-8", "replace")) >> 1))
        if x[0] not in known:
            known[x[0]] = hash((page.key[x[0]], *map(identity, x[1])))
        return known[x[0]]

    def texts(x) -> Iterator[int]:
        if isinstance(x, int):
            yield x
        else:
            for y in x[1]:
                yield from texts(y)

    out: set[int] = set()
    todo = [(wrapper, tree)]
    while todo:
        items, level = todo.pop()
        for op, i, i2, j, j2 in pairs([x[0] or ("a", i) for i, x in enumerate(items)], [identity(x) for x in level]):
            if op == "equal":
                for x in level[j:j2]:
                    out.update(texts(x))
                continue
            # between constants elements meet by their heads, or as items of a group
            rest = [x for x in level[j:j2] if not isinstance(x, int)]
            plain = [x for x in items[i:i2] if x[1] not in "#+"]
            met: set[int] = set()
            for op2, m, m2, k, k2 in pairs([x[1] for x in plain], [page.key[x[0]] for x in rest]):
                if op2 == "equal":
                    for x, y in zip(plain[m:m2], rest[k:k2], strict=True):
                        met.add(y[0])
                        todo.append((x[2], y[1]))
            grouped = {y[1]: y for x in items[i:i2] if x[1] == "+" for y in x[2] if y[1] != "#"}
            todo += [(grouped[page.key[y[0]]][2], y[1]) for y in rest if y[0] not in met and page.key[y[0]] in grouped]
    return out


def extract(html: str | None, wrapper: dict | None = None) -> str:
    """The page's main text through its host's wrapper."""
    page = Page(html)
    template = fixed_texts(prepared(wrapper["items"]) if "prepared" not in wrapper else wrapper["prepared"], page) if wrapper is not None and wrapper["template"] else set()
    open_ = [(k, i) for k, (_, i, _) in enumerate(page.blocks) if not page.chrome[i]]
    slots = [(k, i) for k, i in open_ if k not in template]
    n = len(page.parent)
    mass, named = [0] * n, 0
    for k, i in slots:
        mass[i] += page.blocks[k][2]
        named += page.named[i] * page.blocks[k][2]
    for i in range(n - 1, 0, -1):
        mass[page.parent[i]] += mass[i]
    if 2 * named > mass[0]:
        return "\n".join(page.blocks[k][0] for k, i in open_ if page.named[i])
    inside = content(page, mass, wrapper["path"] if wrapper is not None else [])
    return "\n".join(page.blocks[k][0] for k, i in slots if inside[i])


def content(page: Page, mass: list[int], path: list[str]) -> list[bool]:
    """For each element, whether it is in the content: the host's content element if that holds nine tenths of the page's text, else the page's narrowest that does. Headings and paragraphs that stand beside it, in no container of their own, belong to it."""
    n = len(page.parent)
    step = [0] + [-1] * (n - 1)  # how far down the host's path an element stands
    for i in range(1, n):
        at = step[page.parent[i]]
        if 0 <= at < len(path) and page.key[i] == path[at]:
            step[i] = at + 1
    roots = {i for i in range(n) if step[i] == len(path)} if path else set()
    if not roots or 10 * sum(mass[i] for i in roots) < 9 * mass[0]:
        wide = [i for i in range(n) if (not i or page.name[i] in HOLDING) and 10 * mass[i] >= 9 * mass[0]]
        roots = {min(wide, key=lambda i: (mass[i], -i))} if mass[0] else {0}
    above = set()
    for i in roots:
        while i and (i := page.parent[i]) not in above:
            above.add(i)
    inside = [i in roots or (page.name[i] in FLOW and page.parent[i] in above) for i in range(n)]
    for i in range(1, n):
        inside[i] = inside[i] or inside[page.parent[i]]
    return inside


# ---- distributed ----

_PART = "host string, pages long, expression string"


def infer(pages: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per host: ``host``, ``wrapper`` (JSON: items, path)."""

    def own(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The wrappers of the pages that this task reads."""
        held: dict[str, list] = {}

        def out() -> pd.DataFrame:
            rows = [(host, n, json.dumps(items)) for host, (n, items) in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=["host", "pages", "expression"])

        for batch in batches:
            for url, html in zip(batch["url"], batch["html"], strict=True):
                host, items = host_of(url), expression(Page(html))
                known = held.get(host)
                held[host] = [1, items] if known is None else [known[0] + 1, align(known[1], items)]
                if len(held) >= HELD:
                    yield out()
        yield out()

    def both(part: pd.DataFrame) -> tuple[int, list]:
        items: list | None = None
        for e in part.sort_values(["pages", "expression"], ascending=[False, True])["expression"]:
            more = [thaw(x) for x in json.loads(e)]
            items = more if items is None else align(items, more)
        return int(part["pages"].sum()), items or []

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        n, items = both(part)
        return pd.DataFrame([(part["host"].iloc[0], n, json.dumps(items))], columns=["host", "pages", "expression"])

    def end(part: pd.DataFrame) -> pd.DataFrame:
        n, items = both(part)
        return pd.DataFrame([(part["host"].iloc[0], json.dumps(finish(items, n)))], columns=["host", "wrapper"])

    parts = pages.select("url", "html").mapInPandas(own, _PART)
    salted = parts.groupBy("host", F.pmod(F.xxhash64("expression"), F.lit(salts)).alias("salt")).applyInPandas(meet, _PART)
    return salted.groupBy("host").applyInPandas(end, "host string, wrapper string")


@lru_cache(maxsize=512)
def parsed(wrapper: str) -> dict:
    got = json.loads(wrapper)
    return got | {"prepared": prepared(got["items"])}


def main_text(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""
    # written out, so that Spark knows their size: small tables are broadcast and the pages stay where they are
    wrappers = stored(infer(pages), "wrappers") if wrappers is None else wrappers
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/?#:]*)", 1))
    rows = pages.select("page_id", "url", "html", host.alias("host")).join(wrappers, "host", "left")

    @F.pandas_udf("string")
    def text(html: pd.Series, wrapper: pd.Series) -> pd.Series:
        return pd.Series([extract(h, parsed(w) if isinstance(w, str) else None) for h, w in zip(html, wrapper, strict=True)])

    return rows.select("page_id", "url", text("html", "wrapper").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
