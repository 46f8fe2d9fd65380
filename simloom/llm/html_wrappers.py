"""Main text of web pages by wrappers inferred per host.

Each page is read as a stream of block tags and text slots (inline markup is
part of a slot).  Aligning the streams of a host's pages gives a union-free
regular expression, its wrapper: where streams repeat themselves the repeated
part becomes a repeated group, where one has tags that others lack they become
an optional group, and texts that differ become text slots, equal ones stay
constant.  Streams are nested by their tags, so alignment runs level by level:
siblings are matched in order by their tags and matched ones are merged.

A page's stream is folded first (repeats of up to four siblings become one
group), so a host's pages share few streams.  Pages are counted by stream,
streams of a host are merged in two steps, first in parts of a host, then all
parts, so a host may have any share of the pages.

The main text is decided per stream from what the wrapper knows of its slots.
A slot that stays constant, or whose text is mostly links, is no main text;
any other weighs as many characters as all pages of the host have in it.
Marks (article and main elements, words of class, id and role) are a factor of
that weight.  From the root the search goes down to the child that has most of
the weight, as long as one has; what it ends at holds the main text, all of
its slots but those ruled out, short ones too.  If most of a host's text is
constant its pages are copies, and constancy tells nothing.

Defined cases: null or empty html gives an empty text; a null url is a host of
its own; broken and unclosed markup is read with the tags that are implied;
elements nested over ``DEPTH`` deep are read as siblings at that depth; whole
pages are read; repeated rows get equal results; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.shared import written

BROADCAST_BYTES = 8 << 20
HOST_PARTS = 16
LONGEST_REPEAT = 4
#: Levels of elements that are kept.
DEPTH = 64
#: Most link share of main text, and of main text that is marked as such.
MOST_LINKS, MOST_MARKED_LINKS = 0.4, 0.8
#: Pages in which a constant slot must have been seen; the share of constant text that tells copies.
CONSTANT_PAGES, COPIES = 3, 0.5
#: Weight of marked text beside other text, and the share of it that leads down to a child.
MARKED, MOST = 20.0, 0.75
#: Siblings times siblings that are aligned at best.
ALIGNED = 40_000
#: Wrappers that a task holds.
HELD = 256

#: Elements whose content isn't markup.
_RAW = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in "script style noscript template svg textarea iframe".split()}
_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: What a tag has before its end; an angle bracket may stand in a quoted value.
_INSIDE = re.compile(r"(?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+")
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_LEFT_OUT = frozenset("head nav header footer aside form button select option menu dialog object audio video canvas".split())
_ARTICLE = frozenset("article main".split())
#: Words of class, id and role that mark parts which aren't main text.
_OTHER_PARTS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|banner|sponsor|sponsored|promo|promotion|sidebar|side|aside|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|header|masthead|footer|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|signup|comment|comments|respond|disqus|replies|share|sharing|social|related|recommended|widget|login|search|form|toolbar|contentinfo|complementary|banner|dialog|hidden)(?:$|[\s_-])",
    re.IGNORECASE,
)
_MAIN_PARTS = re.compile(r"(?:^|\s)(?:articlebody|article-body|article__body|post-content|entry-content|main|main-content|article-content)(?:$|\s)", re.IGNORECASE)
#: A start tag that ends an open element of the same level.
_ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())


@dataclass
class Node:
    """An element of a stream or wrapper; a text slot has the tag ``#``."""

    tag: str
    children: list[Node] = field(default_factory=list)
    repeated: bool = False
    optional: bool = False
    #: Of slots: pages, characters, characters of links, hash of the text while it is the same.
    pages: int = 0
    chars: int = 0
    links: int = 0
    text: int | None = None
    #: Of slots while a page is read: its position among the stream's slots.
    places: list[int] = field(default_factory=list)


@dataclass
class Page:
    root: Node
    #: In page order: slot node and text.
    blocks: list[tuple[Node, str]]


def markup(source: str) -> Iterator[tuple[str, bool, str, str]]:
    """Pieces of a page: the text before a tag, whether the tag ends an element, its name and attributes.

    The name is empty where no element begins or ends: after comments,
    declarations and raw content, and at the end of the page.  Each character
    is looked at a bounded number of times.
    """
    at, looked, n = 0, -1, len(source)
    closed = -1  # the next end of any tag
    while True:
        k = source.find("<", max(at, looked))
        if k < 0:
            break
        if source.startswith("<!--", k):
            end = source.find("-->", k + 4)
            yield source[at:k], False, "", ""
            at = looked = n if end < 0 else end + 3
            continue
        if closed < k:
            closed = source.find(">", k)
            if closed < 0:
                break
        m = _NAME.match(source, k + 1)
        if m is None:
            if source[k + 1 : k + 2] in ("/", "!", "?"):
                yield source[at:k], False, "", ""
                at = looked = closed + 1
            else:
                looked = k + 1
            continue
        end = _INSIDE.match(source, m.end()).end()
        if end >= n:  # no end outside of quotes
            end = source.find(">", m.end())
            if end < 0:
                break
        tag, attributes = m[2].lower(), source[m.end() : end]
        before, at = source[at:k], end + 1
        if tag in _RAW and not m[1]:
            if not attributes.endswith("/"):
                close = _RAW[tag].search(source, at)
                at = close.end() if close else n
            tag = ""
        looked = at
        yield before, bool(m[1]), tag, attributes
    yield source[at:], False, "", ""


def _kind(tag: str, attributes: str) -> str:
    """The tag with marks: ``!`` isn't main text, ``*`` is main text."""
    if tag in _LEFT_OUT:
        return tag + "!"
    if tag in _ARTICLE:
        return tag + "*"
    if attributes and tag not in ("html", "body"):
        named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        marks = " ".join(named.get(k, "") for k in ("class", "id", "role"))
        if "hidden" in named or named.get("aria-hidden") == "true" or _OTHER_PARTS.search(marks):
            return tag + "!"
        if _MAIN_PARTS.search(marks) or named.get("itemprop", "").lower() == "articlebody":
            return tag + "*"
    return tag


def read(source: str) -> Page:
    """The tree of block tags and text slots of a page."""
    root = Node("^")
    open_nodes, open_tags, blocks = [root], [""], []
    counts: dict[str, int] = {}
    pieces: list[str] = []
    links = chars_in_links = 0

    def slot() -> None:
        nonlocal chars_in_links
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                node = Node("#", pages=1, chars=len(text), links=min(chars_in_links, len(text)), text=hash_text(text))
                open_nodes[-1].children.append(node)
                blocks.append((node, text))
        chars_in_links = 0

    def close(k: int) -> None:
        slot()
        for t in open_tags[k:]:
            counts[t] -= 1
        del open_nodes[k:], open_tags[k:]

    for before, ends, tag, attributes in markup(source):
        if before:
            pieces.append(before)
            if links:
                chars_in_links += len(before)
        if not tag:
            continue
        if tag in _INLINE:
            if tag == "a":
                links = max(0, links - 1) if ends else links + 1
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if ends:
            if counts.get(tag):
                k = len(open_tags) - 1
                while open_tags[k] != tag:
                    k -= 1
                close(k)
            else:
                slot()
            links = 0
            continue
        slot()
        links = 0
        if open_tags[-1] == "p" and tag in _CLOSES_P:
            close(len(open_nodes) - 1)
        implied = _ENDS.get(tag)
        while implied and open_tags[-1] in implied:
            close(len(open_nodes) - 1)
        if tag == "body":  # ends a head that was left open
            while len(open_nodes) > 1 and open_tags[-1] != "html":
                close(len(open_nodes) - 1)
        kind = _kind(tag, attributes)
        inside = open_nodes[-1]
        if len(open_nodes) <= DEPTH or (kind.endswith("!") and not inside.tag.endswith("!")):
            node = Node(kind)
            (inside if len(open_nodes) <= DEPTH else open_nodes[DEPTH]).children.append(node)
        else:
            node = inside
        if tag not in _VOID and not attributes.endswith("/"):
            open_nodes.append(node)
            open_tags.append(tag)
            counts[tag] = counts.get(tag, 0) + 1
    slot()
    return Page(root, blocks)


def hash_text(text: str) -> int:
    return zlib.crc32(text.encode())


# alignment


def _merge(a: Node, b: Node) -> Node:
    """The wrapper of both; ``a`` is changed and returned."""
    a.repeated |= b.repeated
    a.optional |= b.optional
    a.pages += b.pages
    a.chars += b.chars
    a.links += b.links
    if a.text != b.text:
        a.text = None
    a.places += b.places
    if a.children or b.children:
        a.children = _align(a.children, b.children)
    return a


def _align(a: list[Node], b: list[Node]) -> list[Node]:
    if [n.tag for n in a] == [n.tag for n in b]:
        return [_merge(x, y) for x, y in zip(a, b, strict=True)]
    pairs = _common([n.tag for n in a], [n.tag for n in b])
    out, i, j = [], 0, 0
    for x, y in [*pairs, (len(a), len(b))]:
        for n in (*a[i:x], *b[j:y]):
            n.optional = True
            out.append(n)
        if x < len(a):
            out.append(_merge(a[x], b[y]))
        i, j = x + 1, y + 1
    return _fold(out)


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    x, y = a[start : len(a) - end], b[start : len(b) - end]
    middle = _longest(x, y) if len(x) * len(y) <= ALIGNED else _in_step(x, y)
    return [(k, k) for k in range(start)] + [(start + i, start + j) for i, j in middle] + [(len(a) - end + k, len(b) - end + k) for k in range(end)]


def _longest(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _in_step(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Of very many siblings: those that are the same number among the siblings of their tag, in order."""
    seen, place = Counter(), {}
    for j, tag in enumerate(y):
        place[tag, seen[tag]] = j
        seen[tag] += 1
    pairs, seen = [], Counter()
    for i, tag in enumerate(x):
        j = place.get((tag, seen[tag]))
        seen[tag] += 1
        if j is not None:
            pairs.append((i, j))
    tails, back, at = [], [], []  # longest increasing run of j
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        back.append(at[p - 1] if p else -1)
        tails[p : p + 1], at[p : p + 1] = [j], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _form(node: Node) -> tuple:
    """What siblings must share to be repeats of each other: the tag, and the tags inside."""
    return node.tag, *sorted({c.tag for c in node.children})


def _fold(nodes: list[Node]) -> list[Node]:
    """Runs of one to four siblings that repeat become one repeated group."""
    out = nodes
    for size in range(1, LONGEST_REPEAT + 1):
        if len(out) < 2 * size:
            break
        forms = [_form(n) for n in out]
        kept: list[Node] = []
        i = 0
        while i < len(out):
            here = forms[i : i + size]
            if len(here) == size and forms[i + size : i + 2 * size] == here:
                group = out[i : i + size]
                i += size
                while forms[i : i + size] == here:
                    group = [_merge(x, y) for x, y in zip(group, out[i : i + size], strict=True)]
                    i += size
                for n in group:
                    n.repeated = True
                if size > 1:
                    group = [Node("(" + " ".join(n.tag for n in group) + ")", group, repeated=True)]
                kept += group
            else:
                kept.append(out[i])
                i += 1
        out = kept
    return out


def folded(node: Node) -> Node:
    for n in node.children:
        if n.children:
            folded(n)
    node.children = _fold(node.children)
    return node


def slots(node: Node) -> Iterator[Node]:
    """Slots in order."""
    stack = [node]
    while stack:
        n = stack.pop()
        if n.tag == "#":
            yield n
        stack += reversed(n.children)


def pattern(node: Node) -> str:
    """The expression as text: (..)+ repeats, (..)? may be absent."""
    inner = "".join(pattern(n) for n in node.children)
    body = "#" if node.tag == "#" else inner if node.tag[0] in "(^" else f"<{node.tag}>{inner}</>"
    if node.repeated:
        body = f"({body})+"
    return f"({body})?" if node.optional else body


def dump(node: Node) -> str:
    """A compact form that ``parse`` reads back."""
    flags = "+" * node.repeated + "?" * node.optional
    if node.tag == "#":
        return f"#{flags}{node.pages},{node.chars},{node.links},{'' if node.text is None else node.text};"
    return f"<{node.tag}|{flags}|" + "".join(map(dump, node.children)) + ">"


_DUMPED = re.compile(r"#(\+?\??)(\d+),(\d+),(\d+),(\d*);|<([^|]*)\|(\+?\??)\||>")


def parse(text: str) -> Node:
    top = Node("")
    stack = [top]
    for m in _DUMPED.finditer(text):
        if m[0] == ">":
            stack.pop()
        elif m[6] is not None:
            node = Node(m[6], repeated="+" in m[7], optional="?" in m[7])
            stack[-1].children.append(node)
            stack.append(node)
        else:
            stack[-1].children.append(Node("#", repeated="+" in m[1], optional="?" in m[1], pages=int(m[2]), chars=int(m[3]), links=int(m[4]), text=int(m[5]) if m[5] else None))
    return top.children[0]


@dataclass
class Role:
    """What a host's pages tell of a slot: all its characters, the share of links, and whether it is constant."""

    chars: float
    links: float
    constant: bool


def roles(wrapper: Node) -> dict[int, Role]:
    """Roles of a wrapper's slots, by their identity."""
    out = {id(n): Role(n.chars, n.links / max(n.chars, 1), n.text is not None and n.pages >= CONSTANT_PAGES and not n.repeated) for n in slots(wrapper)}
    text = [r for r in out.values() if r.links <= MOST_LINKS]
    if sum(r.chars for r in text if r.constant) > COPIES * sum(r.chars for r in text):
        for r in out.values():
            r.constant = False
    return out


def aligned(stream: Node, wrapper: Node) -> dict[int, Node]:
    """The wrapper slot of each slot of a stream, by identity; a slot without one is left out."""
    out: dict[int, Node] = {}
    todo = [([stream], [wrapper])]
    while todo:
        a, b = todo.pop()
        met = {i: b[j] for i, j in _common([n.tag for n in a], [n.tag for n in b])}
        by_tag = {n.tag: n for n in reversed(b)}
        for i, n in enumerate(a):
            w = met.get(i) or by_tag.get(n.tag)
            if n.tag == "#":
                if w is not None:
                    out[id(n)] = w
            elif w is not None:
                todo.append((n.children, w.children))
            else:  # inside a group that the wrapper folded further, or the other way round
                inner = [x for g in b if g.tag.startswith("(") for x in g.children]
                todo.append(([n] if n.tag in {x.tag for x in inner} else n.children, inner or b))
    return out


def decided(stream: Node, wrapper: Node, role: dict[int, Role]) -> list[bool]:
    """Whether each slot of a stream is main text."""
    partner = aligned(stream, wrapper)
    weight: dict[int, float] = {}
    main: dict[int, bool] = {}
    order, stack = [], [(stream, False, False)]
    while stack:  # parents before children
        n, marked, other = stack.pop()
        order.append(n)
        marked, other = marked or n.tag.endswith("*"), other or n.tag.endswith("!")
        if n.tag == "#":
            w = partner.get(id(n))
            r = role[id(w)] if w is not None else Role(n.chars, n.links / max(n.chars, 1), False)
            main[id(n)] = not other and not r.constant and r.links <= (MOST_MARKED_LINKS if marked else MOST_LINKS)
            weight[id(n)] = main[id(n)] * r.chars * (1 - r.links) * (MARKED if marked else 1.0)
        stack += [(c, marked, other) for c in n.children]
    for n in reversed(order):
        if n.tag != "#":
            weight[id(n)] = sum(weight[id(c)] for c in n.children)
    top = stream
    while True:
        inner = [c for c in top.children if any(x.tag != "#" for x in c.children)]
        best = max(inner, key=lambda c: weight[id(c)], default=None)
        if best is None or best.tag.startswith("(") or not weight[id(best)] or weight[id(best)] < MOST * weight[id(top)]:
            break
        top = best
    kept = {id(n) for n in slots(top) if main[id(n)]}
    return [id(n) in kept for n in slots(stream)]


# dataflow

_PAGE = "page_id long, url string, host string, stream string, places array<int>, texts array<string>"


def _read_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's folded stream without its counts, and of each text its slot."""
    for b in batches:
        streams, places, texts = [], [], []
        for source in b.column(3).to_pylist():
            page = read(source or "")
            for k, (node, _) in enumerate(page.blocks):
                node.places = [k]
            root = folded(page.root)
            at = {}
            for s, node in enumerate(slots(root)):
                for k in node.places:
                    at[k] = s
                if node.repeated:
                    node.text = None
            streams.append(dump(root))
            places.append([at[k] for k in range(len(page.blocks))])
            texts.append([t for _, t in page.blocks])
        yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(streams, pa.string()), pa.array(places, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.string()))], names=["page_id", "url", "host", "stream", "places", "texts"])


_COUNTS = re.compile(r"(#\+?\??)[\d,]*;")


def shape_of(stream: str) -> str:
    """A stream without its counts: pages of one template share it."""
    return _COUNTS.sub(r"\1;", stream)


def _merge_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper per host of a task's pages."""
    hosts: dict = {}
    for b in batches:
        for host, stream in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            node = parse(stream)
            hosts[host] = _merge(hosts[host], node) if host in hosts else node
    yield pa.record_batch([pa.array(list(hosts), pa.string()), pa.array([dump(n) for n in hosts.values()], pa.string())], names=["host", "wrapper"])


def _merge_parts(t: pa.Table) -> pa.Table:
    found = None
    for text in sorted(t.column("wrapper").to_pylist()):
        found = parse(text) if found is None else _merge(found, parse(text))
    return pa.table([t.column("host")[:1], pa.array([dump(found)], pa.string())], names=["host", "wrapper"])


def wrappers(pages: DataFrame) -> DataFrame:
    """``host`` and ``wrapper`` from rows of ``host`` and ``stream``."""
    parts = pages.select("host", "stream").mapInArrow(_merge_host, "host string, wrapper string")
    some = parts.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(HOST_PARTS)).alias("part")).applyInArrow(_merge_parts, "host string, wrapper string")
    return some.groupBy("host").applyInArrow(_merge_parts, "host string, wrapper string")


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[Node, dict[int, Role]]] = {}
    for b in batches:
        keep = []
        for stream, wrapper in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if wrapper not in held:
                if len(held) >= HELD:
                    held.clear()
                root = parse(wrapper)
                held[wrapper] = (root, roles(root))
            keep.append([k for k, main in enumerate(decided(parse(stream), *held[wrapper])) if main])
        yield pa.record_batch([b.column(0), b.column(1), pa.array(keep, pa.list_(pa.int32()))], names=["host", "shape", "keep"])


def main_text(df: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of each page."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    narrow = df.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), host.alias("host"), F.col(source).alias("html"))
    read_all = narrow.mapInArrow(_read_pages, _PAGE)
    shape = F.xxhash64(F.regexp_replace("stream", r"(#\+?\??)[\d,]*;", "$1;"))
    pages = written(read_all.withColumn("shape", shape), "pages")
    found = wrappers(pages)
    each = pages.groupBy("host", "shape").agg(F.min("stream").alias("stream"))
    kept = written(each.join(found, "host").select("host", "shape", "stream", "wrapper").mapInArrow(_match, "host string, shape long, keep array<int>"), "page-roles")
    size = kept.agg(F.sum(F.length("host") + 4 * F.size("keep") + 64)).first()[0] or 0
    out = pages.drop("stream").join(F.broadcast(kept) if size <= BROADCAST_BYTES else kept, ["host", "shape"])
    chosen = F.filter(F.arrays_zip("places", "texts"), lambda x: F.array_contains("keep", x["places"]))
    text = F.array_join(F.transform(chosen, lambda x: x["texts"]), "\n\n")
    return out.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
