"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of a host."""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache, partial

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeledger.llm.common import ship_package, steps, stored
from codeledger.llm.url_templates import host

SCHEMA = "page_id long, url string, text string, n_chars long"
WRAPPER = "host string, part long, pages long, nodes string"
STRUCTURE = "host string, shape long, pages long, nodes string"
#: Elements that hold blocks, elements that are a block of text, and of both those that never hold an article.
CONTAINERS = frozenset("html head body div section article main nav header footer aside ul ol dl table thead tbody tfoot tr form fieldset figure blockquote details center menu dialog template noscript select button svg iframe object video audio canvas map".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd pre figcaption summary caption address legend label option title textarea".split())
OUTSIDE = frozenset("head nav header footer aside form fieldset menu dialog template noscript select button svg iframe object video audio canvas map legend label option title textarea".split())
REGIONS = frozenset(["article", "main"])
#: Words of class, id and role that mark what is no article text.
MARKED = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo "
    "promoted promotion related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar widget contentinfo complementary alert".split()
)
#: Those of them that mark wherever they stand in a name; the others do as its head word.
MARKED_ANYWHERE = frozenset("ad ads advert adverts advertisement advertising comment comments cookie cookies disqus footer nav navbar newsletter share sharing social sponsor sponsored".split())
#: Elements that are never marked: they hold the page or the article, whatever their class says of its layout.
UNMARKED = frozenset("html body main article".split())
#: Parts of a name that say nothing of what an element holds, and first parts of names that tell what a page has.
NEUTRAL = frozenset("area block box container content inner item items left list outer panel posts right section wrap wrapper".split())
STATES = frozenset("has hide is no not show with without".split())
#: Last parts of names that tell of a page's layout or of a state.
LAYOUTS = frozenset("closed disabled enabled layout open page site template theme".split())
#: Texts that every page of a host has in a place, seen on so many pages, belong to its template; ones that differ are slots.
FIXED_PAGES, LINK_SHARE = 3, 0.5
#: Hosts' wrappers up to this many bytes go to every executor; more are joined.
BROADCAST_BYTES = 32_000_000
#: Structures, and then wrappers, of a host that are aligned in one group, on average; a host with no more is one group.
ALIGNED = 64
#: Nodes of structures that a task holds before it passes them on; aligned structures that an extractor remembers.
HELD_NODES, HELD = 200_000, 20_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[a-zA-Z/!?][^>]*\Z",
    re.S | re.I,
)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_REPEAT = re.compile(r"(.{1,24}?)\1+", re.S)


class Leaf:
    """A block of text: its place (the elements around it and its own) and what it says."""

    __slots__ = ("place", "text", "links")

    def __init__(self, place: tuple[str, ...], text: str, links: int) -> None:
        self.place, self.text, self.links = place, text, links


@lru_cache(maxsize=50_000)
def _element(tag: str, attributes: str) -> str:
    """An element's name in a place: the tag, and after a dot each the names of its class, id and role, their words joined by hyphens."""
    names = (re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) for value in _NAMES.findall(attributes) for name in value.split()) if attributes else ()
    words = sorted({"-".join(name) for name in names if name})
    return f"{tag}.{'.'.join(words)}" if words else tag


def leaves(page: str) -> list[Leaf]:
    """The blocks of a page in order, character references decoded and white space one space; empty ones left out.

    Only containers nest; a block ends where another begins, so unclosed paragraphs do no harm.
    """
    stack: list[str] = []
    out: list[Leaf] = []
    words: list[str] = []
    leaf, links, in_link = "", 0, False

    def flush() -> None:
        nonlocal words, links
        if words:
            text = " ".join("".join(words).split())
            if text:
                out.append(Leaf((*stack, leaf), text, min(links, len(text))))
        words, links = [], 0

    def say(raw: str) -> None:
        nonlocal links
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            words.append(text)
            if in_link:
                links += len(text)

    at = 0
    for found in _TOKEN.finditer(page):
        say(page[at : found.start()])
        at = found.end()
        tag = found[3] or found[6]
        if not tag:
            continue
        closing, tag, attributes = found[2] or found[5], tag.lower(), found[4] or found[7] or ""
        if tag in CONTAINERS:
            flush()
            leaf, in_link = "", False
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].partition(".")[0] == tag:
                        del stack[k:]
                        break
            elif not attributes.rstrip().endswith("/"):
                if tag == "body":
                    stack = [x for x in stack if x.partition(".")[0] != "head"]
                stack.append(_element(tag, attributes))
        elif tag in LEAVES:
            flush()
            leaf, in_link = "" if closing else _element(tag, attributes), False
        elif tag == "a":
            in_link = not closing
        elif tag == "br":
            words.append(" ")
        elif tag == "hr":
            flush()
    say(page[at:])
    flush()
    return out


def folded(tokens: list[str]) -> tuple[tuple[str, ...], list[int], list[bool]]:
    """Repeats folded into one: the structure, each token's place in it, and which places repeat."""
    code: dict[str, str] = {}
    text = "".join(code.setdefault(token, chr(0x10000 + len(code) % 0xFFFFF)) for token in tokens)
    back = {char: token for token, char in code.items()}
    place, many = list(range(len(text))), [False] * len(text)
    while True:
        parts, moved, flags, end = [], [0] * len(text), [], 0
        for found in _REPEAT.finditer(text):
            for k in range(end, found.start()):
                moved[k] = len(flags)
                flags.append(many[k])
            period, base = len(found[1]), len(flags)
            flags += [True] * period
            for k in range(found.start(), found.end()):
                moved[k] = base + (k - found.start()) % period
            parts += [text[end : found.start()], found[1]]
            end = found.end()
        if not parts:
            return tuple(back[char] for char in text), place, many
        for k in range(end, len(text)):
            moved[k] = len(flags)
            flags.append(many[k])
        text, many = "".join([*parts, text[end:]]), flags
        place = [moved[k] for k in place]


# A node of a wrapper: [token, repeats, optional, pages, fixed text's checksum or None, characters, characters of links].


def align(left: list[list], right: list[list]) -> list[list]:
    """One wrapper for two: equal nodes meet, and what only one side has becomes optional.

    Where nodes meet whose texts differ, the text is a slot. A group that stands twice after the
    alignment, because one side had it more often, is folded into a repeat.
    """
    out: list[list] = []
    matcher = SequenceMatcher(None, [node[0] for node in left], [node[0] for node in right], autojunk=False)
    for what, a, b, c, d in matcher.get_opcodes():
        if what == "equal":
            out += [[x[0], x[1] or y[1], x[2] or y[2], x[3] + y[3], x[4] if x[4] == y[4] else None, x[5] + y[5], x[6] + y[6]] for x, y in zip(left[a:b], right[c:d], strict=True)]
        else:
            out += [[*node[:2], True, *node[3:]] for node in (*left[a:b], *right[c:d])]
    structure, place, many = folded([node[0] for node in out])
    if len(structure) == len(out):
        return out
    merged: list[list | None] = [None] * len(structure)
    for node, k in zip(out, place, strict=True):
        old = merged[k]
        merged[k] = [node[0], many[k] or node[1], node[2], *node[3:]] if old is None else [node[0], True, old[2] and node[2], max(old[3], node[3]), old[4] if old[4] == node[4] else None, old[5] + node[5], old[6] + node[6]]
    return merged


def infer(wrappers: Iterable[tuple[int, list[list]]]) -> tuple[int, list[list]]:
    """The wrapper of many pages or wrappers, aligned one after the other, those of most pages first."""
    pages, nodes = 0, None
    for n, other in sorted(wrappers, key=lambda x: (-x[0], [node[0] for node in x[1]], json.dumps(x[1]))):
        pages, nodes = pages + n, other if nodes is None else align(nodes, other)
    return pages, nodes or []


def expression(nodes: list[list]) -> str:
    """A wrapper as a regular expression: #PCDATA for slots, ``( )+`` for repeats and ``( )?`` for optional parts."""
    shown = []
    for token, many, optional, _, fixed, *_ in nodes:
        one = f"{token}[{'#PCDATA' if fixed is None else 'fixed'}]"
        shown.append(f"({one})+" if many and not optional else f"({one})*" if many else f"({one})?" if optional else one)
    return " ".join(shown)


def _is_marked(name: str) -> bool:
    """Whether a name marks what is no article text, by some words anywhere in it, by others as its head word.

    ``share-buttons``, ``comment-body`` and ``cookie-notice`` do; ``no-sidebar``, ``page-with-ads``, ``comments-open`` and ``search-result-page`` don't.
    """
    parts = name.split("-")
    if parts[0] in STATES or len(parts) > 1 and parts[-1] in LAYOUTS:
        return False
    if any(part in MARKED_ANYWHERE and not (k and parts[k - 1] in STATES) for k, part in enumerate(parts)):
        return True
    while len(parts) > 1 and parts[-1] in NEUTRAL:
        parts.pop()
    return parts[-1] in MARKED and not (len(parts) > 1 and parts[-2] in STATES)


@lru_cache(maxsize=50_000)
def _read_element(element: str) -> tuple[str, bool, bool, bool]:
    """An element's tag, whether its names mark it, whether they do but for a header, and whether it is an article's region."""
    tag, *names = element.split(".")
    marks = [name for name in names if _is_marked(name)] if tag not in UNMARKED else []
    return tag, bool(marks), any(name.rpartition("-")[2] != "header" for name in marks), tag in REGIONS or tag == "div" and any("main" in name.split("-") and name.split("-")[0] not in STATES for name in names)


def _kind(token: str, freed: frozenset[str] = frozenset()) -> int:
    """0: outside of any article by its place; 2: in one; 1: neither. Elements in ``freed`` count as not marked."""
    inside, verdict, path = False, 1, ""
    for element in token.split(" "):
        path = f"{path} {element}" if path else element
        tag, marked, but_header, region = _read_element(element)
        # A header of an article has its heading, unlike that of a page.
        if tag in OUTSIDE and not (inside and tag == "header") or (but_header if inside else marked) and path not in freed:
            return 0
        if region:
            inside, verdict = True, 2
    return verdict


def _freed(held: dict[str, int]) -> frozenset[str]:
    """Marked elements whose mark can't be true, by the characters without links that places hold.

    Such an element has more than half of them, and an article or main element stands in it or none beside it.
    """
    inner: dict[str, int] = {}
    within: set[str] = set()
    for token, chars in held.items():
        path, around = "", []
        for element in token.split(" "):
            path = f"{path} {element}" if path else element
            tag, marked, _, region = _read_element(element)
            if tag in OUTSIDE and tag != "header":
                around = []
                break
            if region:
                within.update(around)
            if marked:
                around.append(path)
        for one in around:
            inner[one] = inner.get(one, 0) + chars
    if not inner:
        return frozenset()
    total = sum(held.values())
    found = {path for path, chars in inner.items() if 2 * chars > total}
    article = any(chars and _kind(token) == 2 for token, chars in held.items()) if found - within else False
    return frozenset(path for path in found if path in within or not article)


def _free(blocks: list[Leaf]) -> frozenset[str]:
    held: dict[str, int] = {}
    for block in blocks:
        token = " ".join(block.place)
        held[token] = held.get(token, 0) + len(block.text) - block.links
    return _freed(held)


def _prior(blocks: list[Leaf]) -> list[str]:
    """The texts of a page's blocks that its own tags and classes speak for most."""
    freed = _free(blocks)
    kinds = [_kind(" ".join(block.place), freed) for block in blocks]
    best = max(kinds, default=0)
    return [block.text for block, kind in zip(blocks, kinds, strict=True) if kind == best and best]


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page its structure with what its places hold, and a hash of its text that copies share.

    The text of a place that repeats is all that it holds, so a list that differs from page to page is none of the template.
    """
    for batch in steps(batches, "html"):
        names, copies, shown = [], [], []
        for name, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            blocks = leaves(page or "")
            structure, place, many = folded([" ".join(block.place) for block in blocks])
            nodes = [[token, flag, False, 1, 0, 0, 0] for token, flag in zip(structure, many, strict=True)]
            for block, k in zip(blocks, place, strict=True):
                node = nodes[k]
                node[4] = zlib.crc32(f"{block.text}\n".encode("utf-8", "surrogatepass"), node[4])
                node[5], node[6] = node[5] + len(block.text), node[6] + block.links
            names.append(name)
            copies.append(xxhash.xxh3_64_intdigest("\n".join(_prior(blocks)).encode("utf-8", "surrogatepass")) - (1 << 63))
            shown.append(json.dumps(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(copies, pa.int64()), pa.array(shown, pa.string())], names=["host", "copy", "nodes"])


def _shape(nodes: list[list]) -> int:
    """A hash of a structure's tokens, as a signed 64-bit integer."""
    return xxhash.xxh3_64_intdigest("\n".join(node[0] for node in nodes).encode("utf-8", "surrogatepass")) - (1 << 63)


def _add(held: dict[tuple, list], key: tuple, pages: int, nodes: list[list]) -> bool:
    """Count pages of a structure, a text being fixed only where all have it; whether the structure is new.

    The same whatever the order and in however many steps, so it serves before a shuffle and after it.
    """
    old = held.get(key)
    if old is None:
        held[key] = [pages, nodes]
        return True
    old[0] += pages
    for mine, node in zip(old[1], nodes, strict=True):
        mine[1:] = [mine[1] or node[1], False, mine[3] + node[3], mine[4] if mine[4] == node[4] else None, mine[5] + node[5], mine[6] + node[6]]
    return False


def _batch(held: dict[tuple, list]) -> pa.RecordBatch:
    """The structures held; keys begin with host and shape."""
    rows = [{"host": key[0], "shape": key[1], "pages": pages, "nodes": json.dumps(nodes)} for key, (pages, nodes) in held.items()]
    return pa.RecordBatch.from_pylist(rows, pa.schema([("host", pa.string()), ("shape", pa.int64()), ("pages", pa.int64()), ("nodes", pa.string())]))


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The structures of the pages of a task, most of them one row each."""
    held: dict[tuple, list] = {}
    size = 0
    for batch in batches:
        for name, text in zip(batch.column("host").to_pylist(), batch.column("nodes").to_pylist(), strict=True):
            nodes = json.loads(text)
            size += _add(held, (name, _shape(nodes), tuple(node[0] for node in nodes)), 1, nodes) * len(nodes)
            if size >= HELD_NODES:
                yield _batch(held)
                held, size = {}, 0
    if held:
        yield _batch(held)


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each structure of a host, from rows in order of host and shape; shapes that collide stay apart."""
    done: dict[tuple, list] = {}
    held: dict[tuple, list] = {}
    of, size = None, 0
    for batch in batches:
        for name, shape, pages, text in zip(*(batch.column(column).to_pylist() for column in ("host", "shape", "pages", "nodes")), strict=True):
            if of != (name, shape):
                done.update(held)
                held, of = {}, (name, shape)
                if size >= HELD_NODES:
                    yield _batch(done)
                    done, size = {}, 0
            nodes = json.loads(text)
            size += _add(held, (name, shape, tuple(node[0] for node in nodes)), pages, nodes) * len(nodes)
    done.update(held)
    if done:
        yield _batch(done)


def _aligned(rows: pd.DataFrame) -> pd.DataFrame:
    pages, nodes = infer((int(n), json.loads(text)) for n, text in zip(rows["pages"], rows["nodes"], strict=True))
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "part": [int(rows["part"].iloc[0])], "pages": [pages], "nodes": [json.dumps(nodes)]})


def wrappers(pages: DataFrame, aligned: int = ALIGNED) -> DataFrame:
    """One wrapper per host, of all its pages: host, html in; host, pages, nodes out.

    A page is the stream of its text blocks, each with its place. Repeats are folded. Copies, pages of
    one host with the same text, have one vote together, so a text isn't taken for the template's because
    its page is there often. Pages of one structure are counted together, in each task and then in all;
    structures are dealt by their hash into parts of ``aligned`` on average, each part is aligned, those of most
    pages first, and so are the parts in rounds, ``aligned`` of them at a time. Parts hang on a host's own structures
    alone, so the wrapper is the same however rows lie and whatever other hosts there are, and what a
    group gathers is bounded by ``aligned`` but for the length of the wrappers themselves.
    """
    votes = pages.mapInArrow(_read, "host string, copy long, nodes string").groupBy("host", "copy").agg(F.min("nodes").alias("nodes"))
    counted = votes.select("host", "nodes").mapInArrow(_counted, STRUCTURE).repartition("host", "shape").sortWithinPartitions("host", "shape")
    found = stored(counted.mapInArrow(_merged, STRUCTURE), "structures")
    parts = found.groupBy("host").agg(F.ceil(F.count("*") / aligned).alias("parts"))
    left = parts.agg(F.max("parts")).first()[0] or 1
    rows = found.join(parts, "host").select("host", F.pmod("shape", "parts").cast("long").alias("part"), "pages", "nodes")
    while True:
        rows = rows.groupBy("host", "part").applyInPandas(_aligned, WRAPPER)
        if left <= 1:
            return rows.drop("part")
        left = -(-left // aligned)
        rows = rows.withColumn("part", F.floor(F.col("part") / aligned).cast("long"))


def _is_headline(block: Leaf) -> bool:
    return block.place[-1].partition(".")[0] == "h1"


class Extractor:
    """Applies a host's wrapper to its pages; pages of one structure are aligned once."""

    def __init__(self, pages: int, nodes: list[list]) -> None:
        self.tokens = [node[0] for node in nodes]
        self.kinds = []
        held: dict[str, int] = {}
        for token, _, _, seen, fixed, chars, links in nodes:
            if fixed is None or seen < FIXED_PAGES:
                held[token] = held.get(token, 0) + chars - links
        self.freed = _freed(held)
        for token, _, _, seen, fixed, chars, links in nodes:
            kind = _kind(token, self.freed)
            if kind and fixed is not None and seen >= FIXED_PAGES and 2 * seen > pages or kind == 1 and links > LINK_SHARE * chars:
                kind = 0
            elif kind == 1 and fixed is None and seen >= FIXED_PAGES:
                kind = 2
            self.kinds.append(kind)
        self.fixed = [node[4] is not None and node[3] >= FIXED_PAGES and 2 * node[3] > pages or node[6] > LINK_SHARE * node[5] for node in nodes]
        self.known: dict[tuple, list[int]] = {}

    def text(self, page: str) -> str:
        blocks = leaves(page)
        structure, place, _ = folded([" ".join(block.place) for block in blocks])
        freed = _free(blocks) - self.freed
        kinds = self.known.get((structure, freed))
        if kinds is None:
            priors = [_kind(token, self.freed | freed) for token in structure]
            kinds = priors.copy()
            matcher = SequenceMatcher(None, self.tokens, structure, autojunk=False)
            for a, b, n in matcher.get_matching_blocks():
                for k in range(n):
                    # What this page alone frees has no verdict of the host's but that of its template.
                    kinds[b + k] = self.kinds[a + k] if not freed or self.kinds[a + k] or self.fixed[a + k] else priors[b + k]
            if len(self.known) > HELD:
                self.known = {}
            self.known[structure, freed] = kinds
        of = [kinds[k] for k in place]
        best = max(of, default=0)
        if best == 2:
            first = of.index(2)
            if first and of[first - 1] and _is_headline(blocks[first - 1]) and sum(map(_is_headline, blocks)) == 1:
                of[first - 1] = 2
        return "\n".join(block.text for block, kind in zip(blocks, of, strict=True) if kind == best) if best else ""


def _texts(batches: Iterable[pa.RecordBatch], known: dict[str, tuple[int, str]] | None) -> Iterator[pa.RecordBatch]:
    made: dict[str, Extractor] = {}
    for batch in steps(batches, "html"):
        names, texts = batch.column("host").to_pylist(), []
        given = None if known is not None else list(zip(batch.column("pages").to_pylist(), batch.column("nodes").to_pylist(), strict=True))
        for k, (name, page) in enumerate(zip(names, batch.column("html").to_pylist(), strict=True)):
            if name not in made:
                if len(made) > 1000:
                    made = {}
                pages, nodes = known.get(name, (0, "[]")) if known is not None else given[k]
                made[name] = Extractor(pages or 0, json.loads(nodes or "[]"))
            texts.append(made[name].text(page or ""))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars.

    The host's wrapper says which of a page's blocks are slots of the article. Tags and classes speak
    first: what the elements around a block or their class, id or role show to be menus, headers, footers,
    sidebars, notices, adverts, forms or comments is none, and what is in an article or main element is
    one, with the page's only h1 if it stands right before. A class marks by its whole names, their head words or, for some words, any
    part of a name, but for names of states and layouts; html, body, main and article are never marked, nor is an element that holds most of the page's or of the host's slots' text, unless the article
    is beside it. Then the host's pages do, copies counted once: a place whose text is the same on FIXED_PAGES pages
    or more, and on most, is the template's, in an article too; one whose text differs between
    FIXED_PAGES pages or more is a slot, beside an article too, unless it is mostly links. A place with
    fewer pages is a slot only where a page has no other. Blocks stand in page order, one a line;
    nothing else is dropped.

    A null html or one without text gives an empty text; a null url has the empty host. Repeated rows
    and null ids come out as they are; only page_id, url and html are read. Wrappers of up to
    ``broadcast_bytes`` go to every executor, beyond that they are joined by host.
    """
    spark = pages.sparkSession
    ship_package(spark)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).withColumn("host", host(F.col("url")))
    found = stored(wrappers(rows.select("host", "html")), "wrappers")
    size = found.agg(F.sum(F.octet_length("nodes") + F.octet_length("host"))).first()[0] or 0
    if size <= broadcast_bytes:
        known = {row.host: (row.pages, row.nodes) for row in found.collect()}
        return rows.mapInArrow(partial(_texts, known=known), SCHEMA)
    return rows.join(found, "host", "left").select("page_id", "url", "html", "host", "pages", "nodes").mapInArrow(partial(_texts, known=None), SCHEMA)
