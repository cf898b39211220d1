"""Main text of web pages by deduction of their hosts' templates from equivalence classes.

Tokens of a page are the start and end tags of its elements, each told apart by its path from the root, and its
text: words where an element is on a page at most once, and whole blocks elsewhere. A token's occurrence vector
holds its count on every page of the host. Vectors are never built: two sums of a hash of (page, count) stand
for them, so they are pre-aggregated like any sum and a host of any number of pages fits.

1. Elements of one path that are equally many on all pages, within an element that each page has once, get roles:
   their numbers tell them apart. Elements of one host with equal vectors form an equivalence class. It is valid with CLASS_TOKENS tokens or
   more, or if it is on a page at most once, on PAGE_SHARE of the host's pages, and if its elements follow each
   other in one order on as many of them.
2. Valid classes nest into the host's template: an element's place is its nearest ancestor in the template and
   the template token before it. Text tokens with the vector of a valid class of (nearly) all pages belong to it.
3. A slot is what stands between two successive tokens of the template. Each has sums over the host's pages:
   characters, those in links, and whether its text varies.
4. The main slot is the one with most varying text outside of links. The main text is what the template's element
   around it holds, and that of its parent as long as that adds SHARE of varying text or the heading; without
   slots of links, records that repeat beside the main slot, text of the template, and what hints set aside.

HTML's own element kinds, roles and usual names (ASIDE, ROLES, NAMES) are hints only: they rule out a slot unless
its text contradicts them. Of a host with one page no vector tells anything; all its blocks' elements bound
slots, and hints and the share of text decide.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field, replace
from itertools import accumulate
from urllib.parse import urlsplit

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import materialise, mixed

#: A class is valid with so many tokens (a start and an end tag count as two), on this share of the host's pages.
CLASS_TOKENS, PAGE_SHARE = 3, 0.5
#: Text is the template's if it is on this share of the host's pages, of which there are so many.
TEXT_SHARE, TEXT_PAGES = 0.9, 3
#: A slot is one of links with this share of its text in links.
LINKS = 0.5
#: What a parent must add, as a share of the main text's varying text, for it to be taken as a part of it.
SHARE = 0.25
#: What the template's own text may be of the main text at most, to be left out. If it is more, the pages are copies of each other.
OWN_SHARE = 0.1
#: A hint does not count against an element with so much of the varying text.
MAIN_SHARE = 0.6

#: Element kinds of HTML.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "select", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
ASIDE = {"head", "nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "fieldset"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARTS = {"p", "li", "dt", "dd", "td", "th", "tr", "pre", "blockquote", "caption", "figcaption", *HEADINGS}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog"}
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adbox|adslot|banner|promo\w*|sponsor\w*|side|sidebar|menu|nav|navbar|navigation|breadcrumbs?|masthead|header|foot|footer|cookies?|consent|gdpr|notice|alert|popup|modal|"
    r"newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|discussion|replies|reply|respond|widget|toolbar|pagination|pager|skip)(?:$|[\s_-])",
    re.IGNORECASE,
)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>", re.DOTALL)
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?=[\s/]|$))", re.IGNORECASE)
_DIGITS = re.compile(r"\d+")
_ENDS: dict[str, re.Pattern] = {}
#: What is kept of an element besides its path: hints, and its kind.
HINTED, NAMED, PART, HEADING, TOP, LINK = 1, 2, 4, 8, 16, 32
_K = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Page:
    """Elements in page order: path, parent, flags. Blocks: element, the last element before it, text, characters in links."""

    keys: list[int] = field(default_factory=lambda: [0])
    parents: list[int] = field(default_factory=lambda: [-1])
    flags: list[int] = field(default_factory=lambda: [0])
    at: list[int] = field(default_factory=list)
    after: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    links: list[int] = field(default_factory=list)


def _hash(parent: int, name: str) -> int:
    """63 bits, so that it is a long of Spark's too."""
    import xxhash

    return xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass"), parent) >> 1


def _hints(tag: str, attrs: str) -> tuple[str, int]:
    """An element's names, and its flags."""
    names, flags = [], HINTED * (tag in ASIDE)
    for kind, *values in _ATTR.findall(attrs) if attrs else ():
        value, kind = next((v for v in values if v), ""), kind.lower()
        if kind in ("class", "id"):
            names.append(value)
            if NAMES.search(value) and tag not in ("body", "html", "article", "main"):
                flags |= NAMED
        elif kind == "hidden" or value.lower() in ROLES:
            flags |= HINTED
    flags |= PART * (tag in PARTS) | HEADING * (tag in HEADINGS) | TOP * (tag == "h1") | LINK * (tag == "a")
    return _DIGITS.sub("0", ".".join(sorted(names))), flags


def parse(source: str | None) -> Page:
    """Elements and text blocks of a page. Forgives missing and stray end tags and malformed attributes, as browsers do.

    Elements within a line of text have no place in the tree, but links do. A quote opens an attribute's value
    right after its equals sign only.
    """
    page = Page()
    # of every open element: kind, number (of the nearest element in the tree)
    stack, pending, linked, at, source = [("", 0)], [], 0, 0, source or ""

    def flush():
        nonlocal linked
        text = " ".join(html.unescape("".join(pending)).split())
        if text:
            page.at.append(next(i for t, i in reversed(stack) if t not in INLINE))
            page.after.append(len(page.keys) - 1)
            page.texts.append(text)
            page.links.append(min(linked, len(text)))
        pending.clear()
        linked = 0

    for m in _TAG.finditer(source):
        if m.start() < at:  # within a raw element
            continue
        if m.start() > at:
            pending.append(source[at : m.start()])
            if any(t == "a" for t, _ in stack):
                linked += len(pending[-1].strip())
        at, (end, tag, attrs) = m.end(), m.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        elif tag == "br":
            pending.append(" ")
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in RAW:
            if not attrs.endswith("/"):
                close = _ENDS.setdefault(tag, re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE)).search(source, at)
                at = close.end() if close else len(source)
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P or tag in ("li", "td", "th", "tr", "dt", "dd", "option"):
            same = {"p"} if tag in CLOSES_P else {"td", "th"} if tag in ("td", "th") else {"dt", "dd"} if tag in ("dt", "dd") else {tag}
            for i in range(len(stack) - 1, 0, -1):
                t = stack[i][0]
                if t in same:
                    del stack[i:]
                    break
                if t not in INLINE and t != "p":
                    break
        if tag in INLINE and tag != "a":
            stack.append((tag, stack[-1][1]))
            continue
        above = stack[-1][1]
        names, flags = _hints(tag, attrs)
        page.keys.append(_hash(page.keys[above], tag + names))
        page.parents.append(above)
        page.flags.append(flags)
        stack.append((tag, len(page.keys) - 1))
    pending.append(source[at:])
    flush()
    return page


@dataclass
class Template:
    """Of a host: its pages; (class, order, repeats, elements) of its classes; its texts; (slot, characters, those in links, varies) of its slots; elements with roles, and how many."""

    pages: int = 1
    classes: list = field(default_factory=list)
    texts: set = field(default_factory=set)
    slots: dict = field(default_factory=dict)
    roles: dict = field(default_factory=dict)

    def __post_init__(self):
        self.of = {key: c for c, _, _, keys in self.classes for key in keys}
        self.size = {c: len(keys) for c, _, _, keys in self.classes}
        self.order = {c: order for c, order, _, _ in self.classes}
        self.repeats = {c for c, _, repeats, _ in self.classes if repeats}


_ROLE = 0x1000003


def in_roles(page: Page, template: Template) -> Page:
    """The page with elements told apart by their roles, if it has as many of a path as the template."""
    times = Counter(k for k in page.keys if k in template.roles)
    if not times:
        return page
    seen, keys = Counter(), list(page.keys)
    for i, k in enumerate(page.keys):
        if times.get(k) == template.roles.get(k, 0):
            seen[k] += 1
            keys[i] = k ^ seen[k] * _ROLE
    return replace(page, keys=keys)


def orders(page: Page, template: Template) -> dict[int, int]:
    """A hash of the order of each class's elements on the page; 0 if they don't follow each other in one order."""
    found: dict[int, list[int]] = defaultdict(list)
    for key in page.keys:
        if key in template.of:
            found[template.of[key]].append(key)
    out = {}
    for c, seen in found.items():
        m = template.size[c]
        whole = len(seen) % m == 0 and len(set(seen[:m])) == m and seen == seen[:m] * (len(seen) // m)
        out[c] = _hash(c, ".".join(map(str, seen[:m]))) if whole else 0
    return out


def bounds(page: Page, template: Template, unchecked: bool = False) -> list[bool]:
    """Which elements of the page are the template's: those of classes that stand in the template's order."""
    if template.pages < 2:  # nothing to compare with: all elements that can hold several blocks
        return [not f & (PART | LINK) for f in page.flags]
    there = {c for c, order in orders(page, template).items() if order and (unchecked or order == template.order[c])}
    out = [template.of.get(key) in there for key in page.keys]
    out[0] = True
    return out


def slots(page: Page, bound: list[bool]) -> tuple[list[int], list[int]]:
    """For each block: the nearest element of the template around it, and its slot, by the token before it."""
    near = list(range(len(page.keys)))
    last = [0] * len(page.keys)  # the last element of the template up to here
    for i in range(1, len(near)):  # elements are in page order, so children follow parents
        near[i] = i if bound[i] else near[page.parents[i]]
        last[i] = i if bound[i] else last[i - 1]
    around = [near[i] for i in page.at]
    keys = page.keys
    return around, [(keys[e] * 31 + (keys[last[a]] if last[a] != e else 0)) % 2**63 for e, a in zip(around, page.after, strict=True)]


def text_tokens(page: Page, at: int, text: str, once: bool) -> list[int]:
    """A block's tokens: its words in an element that is on a page at most once, else the block as a whole."""
    key = page.keys[at]
    return [_hash(key, w) for w in text.split()] if once else [_hash(key, " " + text)]


def _ends(page: Page) -> list[int]:
    """For each element, one more than the last one within it: elements are in page order, so all between are within."""
    end = list(range(1, len(page.keys) + 1))
    for i in range(len(end) - 1, 0, -1):
        end[page.parents[i]] = max(end[page.parents[i]], end[i])
    return end


def _sums(page: Page, weight: list) -> list:
    """Sums of the weights of blocks over the elements before each one, and over all."""
    of = [0] * (len(page.keys) + 1)
    for a, w in zip(page.at, weight, strict=True):
        of[a + 1] += w
    return list(accumulate(of))


def main_text(page: Page, template: Template) -> str:
    """The blocks of the main text, in page order."""
    n = len(page.texts)
    if not n:
        return ""
    page = in_roles(page, template)
    bound = bounds(page, template)
    around, slot = slots(page, bound)
    once = {k for c, _, repeats, keys in template.classes if not repeats for k in keys}
    known = [template.texts and template.texts.issuperset(text_tokens(page, a, t, page.keys[a] in once)) for a, t in zip(page.at, page.texts, strict=True)]

    # Sums over the host's pages say what a slot is; the page's own where it has no peers.
    own: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for s, t, linked in zip(slot, page.texts, page.links, strict=True):
        own[s][0] += len(t)
        own[s][1] += linked
    sums = {s: template.slots.get(s, (*x, True)) for s, x in own.items()}
    links = {s for s, (chars, linked, _) in sums.items() if linked >= LINKS * chars}
    records = [template.of.get(page.keys[e]) in template.repeats and not page.flags[e] & PART for e in around]
    varying = {s: chars - linked if varies and s not in links else 0 for s, (chars, linked, varies) in sums.items()}
    weight = [0 if known[k] else varying[s] * len(page.texts[k]) / own[s][0] * (0.5 if records[k] else 1) for k, s in enumerate(slot)]
    if not any(weight):  # pages that are copies of one another, or only links
        weight = [float(len(t) - linked) for t, linked in zip(page.texts, page.links, strict=True)]
        if not any(weight):
            weight = [float(len(t)) for t in page.texts]

    # Hints: an element that holds most of the varying text, and the page's headings, is not set aside by its name.
    keys, flags, parents, at, end = page.keys, page.flags, page.parents, page.at, _ends(page)
    tagged, named = [bool(f & HINTED) for f in flags], [bool(f & NAMED) for f in flags]
    for i in range(1, len(keys)):
        tagged[i] |= tagged[parents[i]]
        named[i] |= named[parents[i]]
    heads = {k for k in range(n) if flags[at[k]] & TOP}
    text = _sums(page, [0 if tagged[a] else w for w, a in zip(weight, at, strict=True)])
    tops = _sums(page, [int(k in heads and not tagged[a]) for k, a in enumerate(at)])
    unnamed = any(w for w, a in zip(weight, at, strict=True) if not tagged[a] and not named[a])
    hinted = list(tagged)
    for i in range(1, len(keys)):
        hinted[i] |= hinted[parents[i]]
        if flags[i] & NAMED and not hinted[i]:
            most = text[end[i]] - text[i] >= MAIN_SHARE * text[-1] > 0
            hinted[i] = not (most and tops[end[i]] - tops[i] == tops[-1] and (tops[-1] or not unnamed))
    free = [k for k in range(n) if not hinted[at[k]]]
    if not free:
        return ""

    score: dict[int, float] = defaultdict(float)
    for k in free:
        score[slot[k]] += weight[k]
    best = max(free, key=lambda k: (score[slot[k]], -k))
    main = around[best]

    def container(i: int) -> int:
        while i and (flags[i] & (PART | LINK) or template.of.get(keys[i]) in template.repeats or not bound[i]):
            i = parents[i]
        return i

    main = container(main)
    taken = {k for k in free if main <= at[k] < end[main]}
    while main:
        above = container(parents[main])
        more = [k for k in free if above <= at[k] < end[above] and not main <= at[k] < end[main] and not records[k] and slot[k] not in links]
        has = sum(weight[k] for k in taken)
        parts: dict[int, list[int]] = defaultdict(list)  # by the parent's child that they stand in
        for k in more:
            parts[_child(page, at[k], above)].append(k)
        titled = any(k in taken for k in heads)
        adds = [k for i, ks in parts.items() for k in ks if sum(weight[j] for j in ks) >= SHARE * has or (flags[i] & PART or i == above) and weight[k] or not titled and k in heads]
        if sum(weight[k] for k in adds) < SHARE * has and (titled or not any(k in heads for k in adds)):
            adds = []
        taken.update(adds)
        main = above

    beside = {s for k, s in enumerate(slot) if records[k]} & links
    kept = [k for k in sorted(taken) if slot[k] not in beside]
    kept = [k for k in kept if records[best] or not records[k] or score[slot[k]] >= score[slot[best]] * MAIN_SHARE]
    left = {k for k in kept if known[k] and not flags[at[k]] & HEADING}
    if template.pages >= TEXT_PAGES and sum(len(page.texts[k]) for k in left) <= OWN_SHARE * sum(len(page.texts[k]) for k in kept):
        kept = [k for k in kept if k not in left]
    return "\n".join(page.texts[k] for k in kept)


def _child(page: Page, i: int, above: int) -> int:
    """The child of ``above`` around ``i``; ``above`` itself for its own text."""
    while i != above and page.parents[i] != above:
        i = page.parents[i]
    return i


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


_PAGE = "page long, keys array<long>, parents array<int>, flags array<int>, at array<int>, after array<int>, texts array<string>, links array<int>"
_LISTS = ("keys", "parents", "flags", "at", "after", "texts", "links")


def parsed(df: DataFrame, url_col: str, html_col: str, carry: tuple[str, ...]) -> DataFrame:
    """Every page parsed once: the columns ``carry`` as _0, _1, ..., the host, a hash of the page, elements and blocks."""
    fields = [df.schema[c] for c in carry]
    inner = df.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(carry)])

    def read(batches):
        import pyarrow as pa

        kinds = [pa.list_(x) for x in (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32())]
        for batch in batches:
            for lo in range(0, len(batch), 200):
                part = batch.slice(lo, 200)
                urls, sources = part.column(0).to_pylist(), part.column(1).to_pylist()
                pages = [parse(x) for x in sources]
                rest = [pa.array([getattr(p, name) for p in pages], kind) for name, kind in zip(_LISTS, kinds, strict=True)]
                marks = [_hash(0, x or "") for x in sources]
                yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array([host(u) for u in urls], pa.string()), pa.array(marks, pa.int64()), *rest], [*[f"_{i}" for i in range(len(fields))], "host", "page", *_LISTS])

    schema = T.StructType([*[T.StructField(f"_{i}", f.dataType) for i, f in enumerate(fields)], T.StructField("host", T.StringType()), *T.StructType.fromDDL(_PAGE).fields])
    return inner.mapInArrow(read, schema)


def _vectors(page: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two parts of a hash of (page, count)."""
    h = mixed(page.astype(np.uint64) + count.astype(np.uint64) * _K)
    return (h >> np.uint64(33)).astype(np.int64), (h & np.uint64(0x7FFFFFFF)).astype(np.int64)


_SUMS = "host string, kind int, k long, v long, s1 long, s2 long, n long, lo long, hi long"
#: Rows of _SUMS that a task holds before it sends them.
HELD = 200_000


class _Rows(dict):
    """Rows of _SUMS by (host, kind, k, v)."""

    def add(self, key, s1: int, s2: int, lo: int, hi: int) -> None:
        one = self.get(key)
        if one is None:
            self[key] = [s1, s2, 1, lo, hi]
        else:
            one[0] += s1
            one[1] += s2
            one[2] += 1
            one[3] = min(one[3], lo)
            one[4] = max(one[4], hi)

    def batch(self):
        import pyarrow as pa

        kinds = (pa.string(), pa.int32(), *[pa.int64()] * 7)
        rows = zip(*((*key, *v) for key, v in self.items()), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["host", "kind", "k", "v", "s1", "s2", "n", "lo", "hi"])


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("host", "kind", "k", "v").agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _element_sums(pages: DataFrame) -> DataFrame:
    """_SUMS of elements: k is the path, v the parent's, lo and hi its least and largest count on a page."""

    def count(batches):
        sums = _Rows()
        for batch in batches:
            for at, mark, keys, parents in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2), batch.column(3), strict=True):
                every = keys.values.to_numpy()
                own, first, n = np.unique(every, return_index=True, return_counts=True)
                above = every[parents.values.to_numpy()[first]]
                s1, s2 = _vectors(np.full(len(n), mark), n)
                for k, v, a, b, c in zip(own.tolist(), above.tolist(), s1.tolist(), s2.tolist(), n.tolist(), strict=True):
                    if k:
                        sums.add((at, 0, k, v), a, b, c, c)
            if len(sums) >= HELD:
                yield sums.batch()
                sums = _Rows()
        if sums:
            yield sums.batch()

    return _summed(pages.select("host", "page", "keys", "parents").mapInArrow(count, _SUMS))


def _pages_of(batch, names: list[str]):
    """The pages of a batch."""
    lists = [batch.column(names.index(x)).to_pylist() for x in _LISTS]
    for row in zip(*lists, strict=True):
        yield Page(*row)


ORDER, TEXT, SLOT = 1, 2, 3


def _page_sums(pages: DataFrame) -> DataFrame:
    """_SUMS of the orders of classes, of text tokens and of slots, from pages with their host's ``classes``."""
    names = ["host", "page", "n_pages", "classes", "roles", *_LISTS]

    def count(batches):
        sums, cached, template, once = _Rows(), None, Template(), set()
        for batch in batches:
            hosts, marks, sizes, classes, roles = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_pylist(), batch.column(3), batch.column(4)
            for i, page in enumerate(_pages_of(batch, names)):
                at, mark = hosts[i], marks[i]
                if at != cached:
                    cached, template = at, Template(sizes[i], [(x["class"], 0, x["repeats"], x["keys"]) for x in classes[i].as_py() or ()], roles={x["k"]: x["times"] for x in roles[i].as_py() or ()})
                    once = {k for _, _, repeats, keys in template.classes if not repeats for k in keys}
                page = in_roles(page, template)
                for c, order in orders(page, template).items():
                    sums.add((at, ORDER, c, order), 0, 0, 0, 0)
                _, slot = slots(page, bounds(page, template, unchecked=True))
                seen, tokens = defaultdict(lambda: [0, 0, 0]), Counter()
                for a, s, text, linked in zip(page.at, slot, page.texts, page.links, strict=True):
                    one = seen[s]
                    one[0] += len(text)
                    one[1] += linked
                    one[2] = _hash(one[2], text)
                    tokens.update(text_tokens(page, a, text, page.keys[a] in once))
                for s, (chars, linked, mark_of) in seen.items():
                    sums.add((at, SLOT, s, 0), chars, linked, mark_of, mark_of)
                if tokens:
                    s1, s2 = _vectors(np.full(len(tokens), mark), np.fromiter(tokens.values(), np.int64, len(tokens)))
                    for k, a, b in zip(tokens, s1.tolist(), s2.tolist(), strict=True):
                        sums.add((at, TEXT, k, 0), a, b, 0, 0)
                if len(sums) >= HELD:
                    yield sums.batch()
                    sums = _Rows()
        if sums:
            yield sums.batch()

    return _summed(pages.select(*names).mapInArrow(count, _SUMS))


def classes(pages: DataFrame) -> DataFrame:
    """(host, n_pages, classes, roles) of hosts with two pages or more.

    ``classes``: class, its vector s1, s2, n, whether it repeats on a page, its elements. ``roles``: elements with
    roles k, and how many times each page has them.

    An element is on PAGE_SHARE of the host's pages, so a host has no more of them than two of its pages.
    """
    size = pages.groupBy("host").agg(F.count("*").alias("n_pages")).where("n_pages > 1")
    sums = _element_sums(pages).join(size, "host").where((F.col("n") > 1) & (F.col("n") >= PAGE_SHARE * F.col("n_pages")))
    sums = materialise(sums, "element-sums")
    alone = sums.where("hi = 1").select("host", F.col("k").alias("v"), "n", F.col("s1").alias("p1"), F.col("s2").alias("p2"))
    split = sums.where("lo = hi and hi > 1").join(alone, ["host", "v", "n"])
    number = F.explode(F.sequence(F.lit(1).cast("long"), F.col("hi"))).alias("i")
    told = split.select("host", "n_pages", F.col("p1").alias("s1"), F.col("p2").alias("s2"), "n", "k", number).select("host", "n_pages", "s1", "s2", "n", F.col("k").bitwiseXOR(F.col("i") * _ROLE).alias("k"), F.lit(1).cast("long").alias("hi"))
    roles = split.groupBy("host").agg(F.collect_list(F.struct("k", F.col("hi").alias("times"))).alias("roles"))
    sums = sums.join(split, ["host", "k"], "left_anti").select(*told.columns).union(told)
    found = sums.groupBy("host", "n_pages", "s1", "s2", "n").agg(F.sort_array(F.collect_list("k")).alias("keys"), (F.max("hi") > 1).alias("repeats")).where((2 * F.size("keys") >= CLASS_TOKENS) | ~F.col("repeats"))
    one = F.struct(F.element_at("keys", 1).alias("class"), "s1", "s2", "n", "repeats", "keys")
    return found.groupBy("host", "n_pages").agg(F.collect_list(one).alias("classes")).join(roles, "host", "left")


def templates(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """(host, n_pages, roles, classes, known, slots): every host's template.

    ``classes`` have their order; a class without one order on PAGE_SHARE of its pages is dropped.
    """
    with_classes = pages.join(candidates.select("host", "n_pages", "classes", "roles"), "host")
    sums = materialise(_page_sums(with_classes), "page-sums")
    each = candidates.select("host", "n_pages", F.inline("classes"))
    order = sums.where((F.col("kind") == ORDER) & (F.col("v") != 0)).groupBy("host", F.col("k").alias("class")).agg(F.max_by("v", F.struct("n", "v")).alias("order"), F.max("n").alias("ordered"))
    valid = each.join(order, ["host", "class"]).where(F.col("ordered") >= PAGE_SHARE * F.col("n"))
    kept = valid.groupBy("host").agg(F.collect_list(F.struct("class", "order", "repeats", "keys")).alias("classes"))
    wide = valid.where(F.col("n") >= TEXT_SHARE * F.col("n_pages")).select("host", "s1", "s2", "n").distinct()
    texts = sums.where((F.col("kind") == TEXT) & (F.col("n") > 1)).join(wide, ["host", "s1", "s2", "n"], "left_semi").groupBy("host").agg(F.collect_list("k").alias("known"))
    held = sums.where(F.col("kind") == SLOT).select("host", F.struct("k", F.col("s1").alias("chars"), F.col("s2").alias("links"), ((F.col("lo") != F.col("hi")) | (F.col("n") == 1)).alias("varies")).alias("slot"))
    return candidates.select("host", "n_pages", "roles").join(kept, "host", "left").join(texts, "host", "left").join(held.groupBy("host").agg(F.collect_list("slot").alias("slots")), "host", "left")


def extract(df: DataFrame, url_col: str = "url", html_col: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``carry``, text and n_chars of every page.

    A null or empty page has the text ''. Pages with a null or unreadable address share the host ''. Repeated
    rows and ids are pages of their own. Of slots with equally much text the first one is the main slot. Texts
    of any length are read whole. An empty table gives an empty table; other columns are ignored.
    """
    fields = [df.schema[c] for c in carry]
    pages = materialise(parsed(df, url_col, html_col, carry), "pages", compression="zstd")
    candidates = materialise(classes(pages), "classes")
    found = materialise(templates(pages, candidates), "templates")
    names = ["host", "n_pages", "classes", "known", "slots", "roles", *_LISTS]
    mine = [f"_{i}" for i in range(len(fields))]

    def texts(batches):
        import pyarrow as pa

        cached, template, n = None, Template(), len(fields)
        for batch in batches:
            rest, out = batch.select([*range(n, n + len(names))]), []
            hosts, sizes = rest.column(0).to_pylist(), rest.column(1).to_pylist()
            for i, page in enumerate(_pages_of(rest, names)):
                if hosts[i] != cached:
                    cached = hosts[i]
                    held = [rest.column(k)[i].as_py() or () for k in (2, 3, 4, 5)]
                    template = Template(sizes[i] or 1, [(x["class"], x["order"], x["repeats"], x["keys"]) for x in held[0]], set(held[1]), {x["k"]: (x["chars"], x["links"], x["varies"]) for x in held[2]}, {x["k"]: x["times"] for x in held[3]})
                out.append(main_text(page, template))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], [*carry, "text", "n_chars"])

    joined = pages.join(found, "host", "left").select(*mine, *names)
    return joined.mapInArrow(texts, T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def op1_equivalence_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
