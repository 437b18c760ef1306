"""HTML extraction with wrappers: union-free regular expressions per host.

A page becomes a stream of text blocks; a block's token is the path of block
elements above it, and its text is a token as well. A run of equal tokens or token
groups is one item, a repeated group. The streams of a host are aligned: where two
agree the item stays, and if its texts differ it becomes a text slot; where only one
has it the mismatch becomes an optional; equal neighbours become a repeated group. The
result is the host's wrapper, ``a (b)+ (c d)?``, in which each item is constant or a
slot, with the pages, letters and link letters that it stood for.

Pages with one sequence of tokens differ in texts only: those are merged by an
aggregate per position (combined on the map side, so a host with a third of all pages
shrinks at once; copies of a page count once). The distinct sequences of a host are
merged in a tree, ``FAN`` a task, whose depth grows with their number.

An expression has a bounded number of items, so that aligning it takes bounded memory.
What a host has beyond them is not lost: it is summed by token in a table, as many rows
as it takes, and a page gets the rows of its own tokens by a join.

The wrapper decides first. It gives the host's content element, the deepest one that
holds most of the letters of its slots (links aside), and marks items that are constant on
three or more distinct pages and on half of all, or mostly links, as template. A page is
matched against the wrapper, block by block. Its text is what lies in the content element;
outside ``article`` and ``main`` template items are left out. Tags, roles and class words
(menus, headers, footers, sidebars, notices, adverts, forms, comments) have no say in that;
they only leave out what varies within the content element like the article itself, such
as adverts and comments. Classes of html, body, main and article, and classes that say
what a layout has (``with-sidebar``), do not count, nor do classes and forms around most of
the page's text.

A host of fewer than three distinct pages proves no wrapper, and a page with more
text in slots elsewhere does not follow it: such a page's text is ``main`` where it
holds most of what is left, else ``article``, else both together, else all of it.

Cases: a null or empty html gives the empty text; a page without host is grouped
under the empty host; broken markup is read as far as it goes (a quote that never
closes ends with its tag); null ids and repeated rows are kept; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from difflib import SequenceMatcher
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partweave.llm.common import arrow_pass, stored
from partweave.llm.hashing import text_batches

# Element names of HTML and words that mark page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html head body title article main section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table"
    " thead tbody tfoot tr td th caption figure figcaption blockquote pre form fieldset legend address details summary"
    " dialog menu hgroup center button label".split()
)
NOISE_TAGS = frozenset("head title nav header footer aside form fieldset menu dialog button label".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners promo sponsor sponsored nav navbar navigation menu"
    " breadcrumb breadcrumbs sidebar aside widget related share sharing social comment comments disqus reply replies"
    " respond cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription signup login"
    " footer header masthead copyright toolbar pagination pager search form".split()
)
#: Whole-page elements, whose classes describe the layout, and words that begin such classes elsewhere.
PAGE_TAGS = frozenset("html body main article".split())
LAYOUT_WORDS = frozenset("has with without no".split())
#: Noise by tag that can still wrap a whole page.
WRAPPING_TAGS = frozenset("form fieldset".split())
#: Beside an element that wraps the page, at most this part of its letters is other text.
BESIDE = 0.1
HARD, SOFT = 2, 1
#: Opening the key closes an open element of these names.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<(script|style|noscript|template|svg|iframe|textarea|select|object|canvas)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</\1\s*+>|\Z)
    |<(/?)([a-zA-Z][a-zA-Z0-9-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |<[!?][^>]*+>
    |<(/?)([a-zA-Z][a-zA-Z0-9-]*+)([^<>]*+)>""",
    re.S | re.I | re.X,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"\d+")
SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/$""")
#: Elements that hold text and no layout: their parent is the content element.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption address summary".split())
#: Distinct pages that prove a wrapper, and the part of a host's pages for a constant.
PROOF, MOST = 3, 0.5
#: The content element holds at least this part of the slots' letters.
CONTENT = 0.6
#: Sequences that a task merges.
FAN = 64
#: Items of an expression; where a host has more, those of the fewest pages lie beside it,
#: as rows by their token.
MOST_ITEMS = 4096
TEXT, TEMPLATE, LINKS = 0, 1, 2


def _signature(name: str, attributes: str) -> tuple[str, int]:
    """The element's token, and whether it is page furniture: HARD by tag or role,
    SOFT by class, id or as a form."""
    noise = SOFT if name in WRAPPING_TAGS else HARD if name in NOISE_TAGS else 0
    parts = [name]
    for key, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        value = next((v for v in values if v), "")
        key = key.lower()
        if key == "role":
            if value.lower() in NOISE_ROLES and name not in PAGE_TAGS:
                noise = max(noise, SOFT if value.lower() == "form" else HARD)
            continue
        if name not in PAGE_TAGS:
            for one in value.split():
                words = [w.lower() for w in WORD.findall(one)]
                if words and words[0] not in LAYOUT_WORDS and not NOISE_WORDS.isdisjoint(words):
                    noise = max(noise, SOFT)
        parts += [("." if key == "class" else "#") + DIGITS.sub("0", v) for v in sorted(value.split())]
    return re.sub(r"[\s()+?/]", "", "".join(parts)), noise


def _wrapping(found: list[tuple[str, str, int, int, tuple[int, ...]]]) -> set[int]:
    """The SOFT elements that are no furniture: they hold most of the page's text, not
    mostly links, and beside them there is hardly any other text. ``found`` has the
    SOFT elements around each block last, -1 among them if one is HARD."""
    open_: set[int] = set()
    texts = [(len(f[1]), f[2], f[4]) for f in found if -1 not in f[4]]
    total = sum(t[0] for t in texts)
    while True:
        mass: dict[int, list[int]] = {}
        clear = 0
        for n, links, around in texts:
            own = [e for e in around if e not in open_]
            if own:
                m = mass.setdefault(own[0], [0, 0])
                m[0] += n
                m[1] += links
            else:
                clear += n
        best = max(mass, key=lambda e: (mass[e][0], -e), default=None)
        if best is None or 2 * mass[best][0] <= total or 2 * mass[best][1] > mass[best][0] or clear > BESIDE * mass[best][0]:
            return open_
        open_.add(best)


def blocks(html: str | None) -> list[tuple[str, str, int, int]]:
    """(slot, text, link letters, kind) of each text block in page order. Kind: 0
    noise, 1 below article, 2 below main, 3 elsewhere, 4 below both."""
    out: list[tuple[str, str, int, int, tuple[int, ...]]] = []
    stack: list[tuple[str, str, int, int]] = []
    parts: list[str] = []
    links, in_link, opened = 0, False, 0

    def flush() -> None:
        nonlocal links
        # References are decoded before white space is joined: some stand for white space.
        text = " ".join("".join(parts).split())
        if text:
            names = [s[0] for s in stack]
            around = tuple(-1 if s[2] == HARD else s[3] for s in stack if s[2])
            kind = (4 if "main" in names else 1) if "article" in names else 2 if "main" in names else 3
            out.append(("/".join(s[1] for s in stack), text, links, kind, around))
        parts.clear()
        links = 0

    at = 0
    html = html or ""
    for m in TOKEN.finditer(html):
        if m.start() > at:
            piece = unescape(html[at : m.start()])
            parts.append(piece)
            if in_link:
                links += len(piece)
        at = m.end()
        ends, name, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not name:
            continue
        name = name.lower()
        if name == "br" or name == "hr":
            parts.append(" ")
        closed = not ends and SELF_CLOSED.search(attributes) is not None
        if name == "a":
            in_link = not ends and not closed
        if name not in BLOCK:
            continue
        flush()
        if ends:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is not None:
                del stack[depth:]
        else:
            if stack and stack[-1][0] == "p":
                stack.pop()
            closing = CLOSES.get(name, ())
            while stack and stack[-1][0] in closing:
                stack.pop()
            if not closed:
                opened += 1
                stack.append((name, *_signature(name, attributes), opened))
    if at < len(html):
        parts.append(unescape(html[at:]))
    flush()
    wrapping = _wrapping(out) if any(f[4] for f in out) else set()
    return [(slot, text, links, kind if wrapping.issuperset(around) else 0) for slot, text, links, kind, around in out]


def content(found: list[tuple[str, str, int, int]], template: set[str]) -> list[str]:
    """The texts of a page's blocks that make its article."""
    clear = [b for b in found if b[3]]
    kept = [b for b in clear if not (b[3] == 3 and b[0] in template)] or clear
    total = sum(len(b[1]) for b in kept)
    for kinds in ((2, 4), (1, 4), (1, 2, 4)):
        inner = [b[1] for b in kept if b[3] in kinds]
        if 2 * sum(map(len, inner)) > total:
            return inner
    return [b[1] for b in kept]


# --- wrappers ----------------------------------------------------------------


@dataclass(frozen=True)
class Item:
    """A token or group of a wrapper. ``low`` and ``high`` bound the hashes of its texts:
    equal for a constant, different for a slot."""

    core: str
    repeated: bool = False
    optional: bool = False
    low: int = 0
    high: int = 0
    pages: int = 1
    chars: int = 0
    links: int = 0

    def __str__(self) -> str:
        inner = self.core if self.low == self.high else f"{self.core}#"
        inner = f"({inner})+" if self.repeated else inner
        return f"({inner})?" if self.optional else inner


FIELDS = "core:string,repeated:boolean,optional:boolean,low:long,high:long,pages:long,chars:long,links:long"
SEPARATOR = "\n"


def _group_sizes(cores: list[str], size: int) -> int | None:
    """The least size from ``size`` on of a group that stands at least twice in a row. Only
    stretches of tokens that all occur again can hold one."""
    seen: dict[str, int] = {}
    number = np.fromiter((seen.setdefault(c, len(seen)) for c in cores), dtype=np.int64, count=len(cores))
    again = np.bincount(number)[number] > 1
    edge = np.flatnonzero(np.diff(np.concatenate([[0], again.view(np.int8), [0]])))
    best = None
    for at, end in zip(edge[0::2], edge[1::2], strict=True):
        own = number[at:end]
        for n in range(size, min(len(own) // 2, (best or len(own)) - 1) + 1):
            gaps = np.flatnonzero(own[n:] != own[:-n])
            if np.diff(np.concatenate([[-1], gaps, [len(own) - n]])).max() > n:  # n equal pairs in a row
                best = n
                break
    return best


def runs(tokens: list[str]) -> list[tuple[str, bool, int, int]]:
    """(core, repeated, first token, end) of the items: repeated neighbours and repeated
    groups of any length become one, short groups first."""
    now = [(t, False, k, k + 1) for k, t in enumerate(tokens)]
    size = 0
    while (size := _group_sizes([t[0] for t in now], size + 1)) is not None:
        out: list[tuple[str, bool, int, int]] = []
        cores, at = [t[0] for t in now], 0
        while at < len(now):
            group, end = cores[at : at + size], at + size
            while len(group) == size and cores[end : end + size] == group:
                end += size
            if end > at + size:
                out.append((" ".join(group), True, now[at][2], now[end - 1][3]))
                at = end
            else:
                out.append(now[at])
                at += 1
        now = out
    return now


def _both(a: Item, b: Item, pages: int) -> Item:
    """One item for two that match the same token."""
    return Item(a.core, a.repeated or b.repeated, a.optional or b.optional, min(a.low, b.low), max(a.high, b.high), pages, a.chars + b.chars, a.links + b.links)


def align(a: list[Item], b: list[Item]) -> list[Item]:
    """The union-free expression that matches what either of two matches: mismatches
    become optionals, texts that differ become slots, equal neighbours repeated groups."""
    out: list[Item] = []

    def put(item: Item) -> None:
        if out and out[-1].core == item.core:
            out[-1] = replace(_both(out[-1], item, max(out[-1].pages, item.pages)), repeated=True, optional=out[-1].optional and item.optional)
        else:
            out.append(item)

    matcher = SequenceMatcher(None, [i.core for i in a], [i.core for i in b], autojunk=False)
    for kind, i0, i1, j0, j1 in matcher.get_opcodes():
        if kind == "equal":
            for x, y in zip(a[i0:i1], b[j0:j1], strict=True):
                put(_both(x, y, x.pages + y.pages))
        else:
            for x in (*a[i0:i1], *b[j0:j1]):
                put(replace(x, optional=True))
    return out


def expression(items: list[Item]) -> str:
    """The wrapper as text; ``#`` marks slots."""
    return " ".join(map(str, items))


def deepest(mass: dict[str, int]) -> str:
    """The path of the deepest layout element that holds most of the slots' letters, or ''.
    ``mass``: letters by path, of all paths or of those that hold as much."""
    total, best = sum(m for path, m in mass.items() if "/" not in path), ""
    for path, m in mass.items():
        names = [re.match(r"[a-z0-9]*", part)[0] for part in path.split("/")]
        if total and m >= CONTENT * total and TEXT_TAGS.isdisjoint(names) and path.count("/") >= best.count("/") + bool(best):
            best = path
    return best


def content_element(items: list[Item]) -> str:
    """The content element of an expression alone."""
    mass: dict[str, int] = {}
    for item in items:
        if item.low == item.high or 2 * item.links > item.chars:
            continue
        cores = item.core.split(" ")
        for core in cores:
            parts = core.split("/")
            for k in range(1, len(parts) + 1):
                path = "/".join(parts[:k])
                mass[path] = mass.get(path, 0) + item.chars // len(cores)
    return deepest(mass)


def marks(items: list[Item], pages: int) -> list[int]:
    """TEXT, TEMPLATE or LINKS of each item of a host with so many distinct pages."""
    constant = lambda i: i.low == i.high and i.pages >= PROOF and i.pages >= MOST * pages
    return [TEMPLATE if constant(i) else LINKS if 2 * i.links > i.chars > 0 else TEXT for i in items]


def matched(cores: list[str], items: list[tuple[str, bool, int, int]]) -> list[int]:
    """For each item of a page the place of the wrapper's item that matches it, or -1."""
    out = [-1] * len(items)
    for kind, i0, i1, j0, _ in SequenceMatcher(None, [i[0] for i in items], cores, autojunk=False).get_opcodes():
        if kind == "equal":
            out[i0:i1] = range(j0, j0 + i1 - i0)
    # A token of a group that stands alone, or one that repeats elsewhere, matches by its core.
    place = {core: k for k, core in reversed(list(enumerate(cores)))}
    return [place.get(item[0], -1) if k < 0 else k for item, k in zip(items, out, strict=True)]


def page_text(
    found: list[tuple[str, str, int, int]], cores: list[str], verdicts: list[int], element: str | None, rest: dict[str, int] | None = None
) -> tuple[list[str], bool]:
    """The texts of a page's blocks that make its article, and whether the wrapper decided.
    ``element`` is None where the host proves no wrapper, ``rest`` has the verdicts of
    cores that its expression lacks."""
    items = runs([f[0] for f in found])
    verdict = [TEXT] * len(found)
    for (core, _, first, end), k in zip(items, matched(cores, items), strict=True):
        for b in range(first, end):
            verdict[b] = verdicts[k] if k >= 0 else (rest or {}).get(core, TEXT)
    if element is not None:
        # The expression comes first: slots in the content element against slots elsewhere.
        inside = lambda path: path == element or path.startswith(f"{element}/") or not element
        slots = [(f, inside(f[0])) for f, v in zip(found, verdict, strict=True) if v == TEXT or (f[3] in (1, 2, 4) and inside(f[0]))]
        held, beside = (sum(len(f[1]) for f, own in slots if own == side) for side in (True, False))
        # Tags and class words only tell adverts and comments within the element.
        kept = [f[1] for f, own in slots if own and f[3]]
        if kept and held >= beside:
            return kept, True
    template = {f[0] for f, v in zip(found, verdict, strict=True) if v != TEXT}
    return content(found, template), False


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


SEEN = "array<struct<repeated:boolean,text:long,chars:long,links:long>>"


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _page_key(found: list[tuple[str, str, int, int]]) -> int:
    """Equal for copies of a page: they have the same blocks."""
    return _hash("\0".join(f"{f[0]}\0{f[1]}\0{f[2]}" for f in found))


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind_of = pa.list_(pa.struct([("repeated", pa.bool_()), ("text", pa.int64()), ("chars", pa.int64()), ("links", pa.int64())]))
    for whole in batches:
        for batch in text_batches(whole, "html"):
            streams, items, pages = [], [], []
            for html in batch.column("html"):
                found = blocks(html.as_py())
                own = runs([f[0] for f in found])
                streams.append(SEPARATOR.join(core for core, *_ in own))
                items.append(
                    [
                        {
                            "repeated": repeated,
                            "text": _hash("\0".join(f[1] for f in found[a:b])),
                            "chars": sum(len(f[1]) for f in found[a:b]),
                            "links": sum(f[2] for f in found[a:b]),
                        }
                        for _, repeated, a, b in own
                    ]
                )
                pages.append(_page_key(found))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(streams, pa.string()), pa.array(items, kind_of), pa.array(pages, pa.int64())], ["host", "stream", "items", "page"])


def _parted(items: list[Item], most: int) -> tuple[list[Item], list[Item]]:
    """``most`` of a wrapper's items, those of most pages, in their order, and the rest."""
    if len(items) <= most:
        return items, []
    kept = set(sorted(range(len(items)), key=lambda k: (-items[k].pages, k))[:most])
    return [i for k, i in enumerate(items) if k in kept], [i for k, i in enumerate(items) if k not in kept]


def _merge(frame: pd.DataFrame, most: int) -> pd.DataFrame:
    """One wrapper from some of a host's, those of most pages first; what its expression
    has no room for comes in a row of its own, with ``rest``."""
    frame = frame.sort_values(["pages", "stream"], ascending=[False, True])
    wrapper: list[Item] | None = None
    rest: list[Item] = []
    for own in frame["items"]:
        items = [Item(**i) for i in own]
        wrapper = items if wrapper is None else align(wrapper, items)
        if len(wrapper) > 2 * most:
            wrapper, more = _parted(wrapper, most)
            rest += more
    wrapper, more = _parted(wrapper, most)
    rows = [(SEPARATOR.join(i.core for i in wrapper), [vars(i) for i in wrapper], int(frame["pages"].sum()), False)]
    if rest or more:
        rows.append(("", [vars(i) for i in rest + more], 0, True))
    out = pd.DataFrame(rows, columns=["stream", "items", "pages", "rest"])
    out.insert(0, "host", frame["host"].iloc[0])
    return out


@dataclass
class Wrappers:
    """``expressions``: (host, stream, items, pages), one a host; ``rest``: (host, core, low,
    high, pages, chars, links) of items beyond the expressions, or None; ``streams``:
    (host, page, stream, items) of the distinct pages."""

    expressions: DataFrame
    rest: DataFrame | None
    streams: DataFrame


def infer_wrappers(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", fan: int = FAN, most_items: int = MOST_ITEMS) -> Wrappers:
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    seen = arrow_pass(rows, _streams, f"host string, stream string, items {SEEN}, page long")
    distinct = stored(seen.groupBy("host", "page").agg(F.min(F.struct("stream", "items")).alias("s")).select("host", "page", "s.*"), "streams")
    by_place = (
        distinct.select("host", "stream", F.posexplode("items").alias("at", "i"))
        .groupBy("host", "stream", "at")
        .agg(
            F.max("i.repeated").alias("repeated"), F.min("i.text").alias("low"), F.max("i.text").alias("high"),
            F.count(F.lit(1)).alias("pages"), F.sum("i.chars").alias("chars"), F.sum("i.links").alias("links"),
        )
    )
    core = F.split("stream", SEPARATOR)[F.col("at")].alias("core")
    item = F.struct("at", core, "repeated", F.lit(False).alias("optional"), "low", "high", "pages", "chars", "links")
    level = by_place.groupBy("host", "stream").agg(F.array_sort(F.collect_list(item)).alias("placed"), F.max("pages").alias("pages")).select(
        "host", "stream", F.col("placed").cast(f"array<struct<at:int,{FIELDS}>>").alias("placed"), "pages"
    ).select("host", "stream", F.transform("placed", lambda x: x.dropFields("at")).alias("items"), "pages")
    level = stored(level, "wrappers")
    rest = None
    while True:
        sizes = level.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        most = sizes.agg(F.max("n")).first()[0] or 1
        if most == 1:
            break
        # Only hosts with several sequences go on; a part of one is at most about ``fan``.
        part = F.pmod(F.xxhash64("stream", F.lit(most)), F.ceil(F.col("n") / fan).cast("int"))
        dealt = level.join(sizes, "host").withColumn("part", part)
        merged = stored(
            dealt.where("n > 1").select("host", "stream", "items", "pages", "part").groupBy("host", "part").applyInPandas(
                lambda f: _merge(f, most_items), f"host string, stream string, items array<struct<{FIELDS}>>, pages long, rest boolean"
            ),
            "merged",
        )
        own = merged.where("rest").select("host", F.explode("items").alias("i")).select("host", "i.*")
        rest = own if rest is None else rest.unionByName(own)
        level = stored(dealt.where("n = 1").select("host", "stream", "items", "pages").unionByName(merged.where("NOT rest").drop("rest")), "wrappers")
    if rest is not None:
        sums = [F.min("low").alias("low"), F.max("high").alias("high"), *(F.sum(c).alias(c) for c in ("pages", "chars", "links"))]
        rest = stored(rest.groupBy("host", "core").agg(*sums), "rest")
        rest = rest if rest.limit(1).count() else None
    return Wrappers(level, rest, distinct)


def content_elements(found: Wrappers) -> DataFrame:
    """(host, element) from expressions and rest together: letters of slots summed by path.
    Of an element that holds most of them each host has one a depth."""
    items = found.expressions.select("host", F.explode("items").alias("i")).select("host", "i.core", "i.low", "i.high", "i.chars", "i.links")
    if found.rest is not None:
        items = items.unionByName(found.rest.select("host", "core", "low", "high", "chars", "links"))
    slots = items.where("low <> high AND 2 * links <= chars").withColumn("cores", F.split("core", " "))
    each = slots.select("host", F.expr("chars DIV size(cores)").alias("chars"), F.explode("cores").alias("core")).withColumn("parts", F.split("core", "/"))
    paths = each.select("host", "chars", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.array_join(F.slice("parts", F.lit(1), k), "/"))).alias("path"))
    mass = paths.groupBy("host", "path").agg(F.sum("chars").alias("chars"))
    total = mass.where(~F.col("path").contains("/")).groupBy("host").agg(F.sum("chars").alias("total"))
    large = mass.join(total, "host").where((F.col("total") > 0) & (F.col("chars") >= CONTENT * F.col("total")))
    tags = F.transform(F.split("path", "/"), lambda p: F.regexp_extract(p, "^[a-z0-9]*", 0))
    layout = large.where(~F.exists(tags, lambda t: t.isin(*sorted(TEXT_TAGS))))
    return layout.groupBy("host").agg(F.max_by("path", F.struct(F.size(F.split("path", "/")), "path")).alias("element"))


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a host's pages need of its expression."""
    for batch in batches:
        verdicts = [marks([Item(**i) for i in items], pages) for items, pages in zip(batch.column("items").to_pylist(), batch.column("pages").to_pylist(), strict=True)]
        kept = ["host", "stream", "pages", "element"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(verdicts, pa.list_(pa.int32()))], [*kept, "verdicts"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the key of their page."""
    for whole in batches:
        for batch in text_batches(whole, "html"):
            keys = pa.array([_page_key(blocks(html.as_py())) for html in batch.column("html")], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], [*batch.schema.names, "page"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in text_batches(whole, "html"):
            columns = [batch.column(c).to_pylist() for c in ("stream", "verdicts", "element", "rest")]
            texts, by_wrapper = [], []
            for html, stream, verdicts, element, rest in zip(batch.column("html"), *columns, strict=True):
                cores = (stream or "").split(SEPARATOR) if verdicts else []
                own, decided = page_text(blocks(html.as_py()), cores, verdicts or [], element, {r["core"]: r["verdict"] for r in rest or ()})
                texts.append(" ".join(own))
                by_wrapper.append(decided)
            kept = [c for c in batch.schema.names if c not in ("html", "stream", "verdicts", "element", "rest")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array(by_wrapper)], [*kept, "text", "by_wrapper"])


REST = "array<struct<core:string,verdict:int>>"


def _rest_of_pages(found: Wrappers, known: DataFrame) -> DataFrame:
    """(host, page, rest): of each distinct page the cores beyond its host's expression that
    are template or links there."""
    one = (F.col("low") == F.col("high")) & (F.col("r.pages") >= PROOF) & (F.col("r.pages") >= MOST * F.col("k.pages"))
    verdict = F.when(one, TEMPLATE).when((2 * F.col("links") > F.col("chars")) & (F.col("chars") > 0), LINKS).otherwise(TEXT)
    judged = found.rest.alias("r").join(known.select("host", "pages").alias("k"), "host").select("host", "core", verdict.alias("verdict")).where(F.col("verdict") != TEXT)
    held = found.streams.select("host", "page", F.explode(F.array_distinct(F.split("stream", SEPARATOR))).alias("core"))
    return held.join(judged, ["host", "core"]).groupBy("host", "page").agg(F.collect_list(F.struct("core", "verdict")).cast(REST).alias("rest"))


def extract_articles(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", fan: int = FAN, most_items: int = MOST_ITEMS) -> DataFrame:
    """page_id, url, text, by_wrapper (whether the host's wrapper decided), n_chars of every page."""
    found = infer_wrappers(pages, url_col=url_col, html_col=html_col, fan=fan, most_items=most_items)
    elements = content_elements(found)
    proven = F.when(F.col("pages") >= PROOF, F.coalesce("element", F.lit("")))
    ready = found.expressions.join(elements, "host", "left").select("host", "stream", "items", "pages", proven.alias("element"))
    # One row a host; Spark broadcasts it where its size allows, else joins by host.
    known = stored(arrow_pass(ready, _decided, "host string, stream string, pages long, element string, verdicts array<int>"), "decided")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host_of(F.col("url")))
    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string"
    columns = ["page_id", "url", "html", "stream", "verdicts", "element"]
    joined = rows.join(known, "host", "left").select(*columns, F.lit(None).cast(REST).alias("rest"))
    if found.rest is not None:
        # Pages of the hosts whose expression has not room for all: by host and page.
        large = stored(found.rest.select("host").distinct(), "large", files=1)
        keyed = arrow_pass(rows.join(large, "host", "left_semi").select("page_id", "url", "html", "host"), _keys, f"{schema}, html string, host string, page long")
        beyond = keyed.join(_rest_of_pages(found, known), ["host", "page"], "left").join(known, "host").select(*columns, "rest")
        joined = rows.join(large, "host", "left_anti").join(known, "host", "left").select(*columns, F.lit(None).cast(REST).alias("rest")).unionByName(beyond)
    return arrow_pass(joined, _texts, f"{schema}, text string, by_wrapper boolean").withColumn("n_chars", F.length("text").cast("long"))
