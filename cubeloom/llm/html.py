"""Main text of pages by wrappers: union-free regular expressions inferred from pages of one host.

A page is a stream of tags and text slots. From all pages of a host a wrapper is inferred: their different streams, with
repeated stretches folded, are aligned by few, and what comes of that again, up a tree, until a host has one expression;
tags and slots that differ are resolved as a repeated group (a stretch that stands there again and again) or as an
optional one. Each stream is matched against that expression, so that the texts of its pages have slots of it. Tags, names and links label a slot as article, main, links or out; outside of articles, a
text that is the same in its slot on the host's pages is fixed. Pages are then read by their slots; a text that matches
no slot, or one that too few pages have, counts by its number in its place (path of containers), or else by the place,
over all pages of the host as well; by a place alone, nothing is dropped but fixed texts and links.
"""

from __future__ import annotations

import html as entities
import hashlib
import json
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, shared_dir, small_batches, stored

#: Elements without text of the page.
DROPPED = frozenset("script style template noscript iframe svg math object canvas audio video select textarea button datalist head title".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html body main article section div nav header footer aside form ul ol dl menu table tbody thead tfoot tr details dialog figure fieldset blockquote center address".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption pre summary legend hgroup search".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog search".split())
#: Words in class, id or role that name what is not the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget "
    "comment comments respond disqus reply replies cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations pagination pager toolbar complementary contentinfo search skip legal copyright paywall".split()
)
#: Words that may stand beside them in one token, as in site-header or ad-box; with any other word, as in no-comments, a token names nothing.
BESIDE = frozenset("box wrapper wrap container block area section list bar left right top bottom main site page global primary secondary inner outer panel unit slot row group links link items item buttons button content posts articles stories body text author meta count thread threads form the of and 0".split())
#: What may stand before a last word that names readers' comments or adverts, as in post-comments.
OWNERS = frozenset("post article entry user users reader readers story fb facebook wp".split())
OWNED = frozenset("comment comments replies respond disqus ad ads advert adverts share sharing related".split())
#: Names that drop nothing inside of an article, whose own heading may be called so.
KEPT_INSIDE = frozenset("header masthead banner legal copyright search skip modal overlay".split())
ARTICLE_NAMES = frozenset("articlebody main".split())
INLINE = frozenset("html body p a span b i em strong".split())
#: As browsers do: a quote opens a value after an equals sign only.
ATTRIBUTES = r"(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+"
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)(" + ATTRIBUTES + r")(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=>\"'/][^\s=>/]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
SPLIT = re.compile(r"[_\-]+|(?<=[a-z])(?=[A-Z])")


def parts_of(word: str) -> list[str]:
    """A word of two run together, as in commentlist, as its two."""
    if word in NAMES or word in BESIDE:
        return [word]
    return next(([word[:i], word[i:]] for i in range(len(word) - 1, 4, -1) if word[:i] in NAMES and word[i:] in BESIDE), [word])


def names_of(token: str) -> set[str]:
    """The names in a whole token of a class, id or role that says nothing else."""
    words = [x for w in SPLIT.split(token) if w for x in parts_of(re.sub(r"[0-9]+", "0", w.lower()))]
    rest = [w for w in words if w not in NAMES and w not in BESIDE]
    if rest and not (words[-1] in OWNED and OWNERS.issuperset(rest)):
        return set()
    return NAMES.intersection(words)


def tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): 'text' with its raw characters in rest, 'open' with attributes in rest, 'close'."""
    at, n = 0, len(source)
    while at < n:
        m = TAG.search(source, at)
        if m is None:
            yield "text", "", source[at:]
            return
        if m.start() > at:
            yield "text", "", source[at : m.start()]
        at = m.end()
        if not m.group(2):
            continue
        name = m.group(2).lower()
        if m.group(1):
            yield "close", name, ""
            continue
        yield "open", name, m.group(3)
        if name in RAW and not m.group(3).rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else n
            yield "close", name, ""


def digest(*parts: str) -> int:
    """64 bits of a hash."""
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


PLAIN: tuple[frozenset[str], str, bool, bool] = (frozenset(), "", False, False)
TOLD = re.compile(r"class|id|role|itemprop|hidden|style", re.I)


def described(rest: str) -> tuple[frozenset[str], str, bool, bool]:
    """What the attributes of a tag say: names, the label of first class and id, whether it is hidden, whether it is the article's body."""
    return _described(rest) if TOLD.search(rest) else PLAIN


@lru_cache(maxsize=20_000)
def _described(rest: str) -> tuple[frozenset[str], str, bool, bool]:
    names, kind, own_id, hidden, body = set(), "", "", False, False
    for m in ATTRIBUTE.finditer(rest):
        key, value = m.group(1).lower(), (m.group(2) or "").strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            hidden = True
        elif key == "itemprop":
            body |= value.lower() in ARTICLE_NAMES
        elif key in ("class", "id", "role"):
            tokens = value.split()
            names.update(*map(names_of, tokens))
            body |= key == "role" and value.lower() == "main"
            if key == "class" and tokens:
                kind = f".{re.sub(r'[0-9]+', '0', tokens[0].lower())}"
            elif key == "id" and value:
                own_id = f"#{re.sub(r'[0-9]+', '0', value.lower())}"
    return frozenset(names), kind + own_id, hidden, body


@lru_cache(maxsize=100_000)
def _down(over: str, label: str) -> str:
    return f"{digest(over, label) & (1 << 64) - 1:016x}"


class Part:
    """An open element: where it stands (a digest of the labels of the blocks down to it), whether it is in one without text
    of the page, whether its tag or its name says that it is out, whether it is or is in an article, and whether that lies in something named otherwise."""

    __slots__ = ("name", "place", "gone", "hard", "named", "article", "doubt", "link")

    def __init__(self, name: str, rest: str, above: Part | None) -> None:
        names, label, hidden, body = described(rest) if "=" in rest or "hidden" in rest else PLAIN
        self.name = name
        over = above.place if above is not None else ""
        self.place = _down(over, name + label) if name in BLOCKS else over
        inside = above is not None and above.article
        opens = name in ("article", "main") or body
        self.article = inside or opens
        self.gone = (above is not None and above.gone) or name in DROPPED
        self.hard = (above is not None and above.hard) or self.gone or name in BOILERPLATE or hidden or (name == "header" and not inside)
        own = name not in INLINE and bool(names - KEPT_INSIDE if inside else names)
        around = above is not None and above.named
        first = opens and not inside
        self.named = False if first else around or own
        self.doubt = (first and (around or own)) or (above is not None and above.doubt)
        self.link = name == "a" or (above is not None and above.link)


class Block(NamedTuple):
    """A text with its place; whether it is out; 2 in an article, 1 in one that lies in something named otherwise; its share of linked characters."""

    place: str
    text: str
    out: bool
    article: int
    links: float


def blocks(source: str) -> tuple[list[Block], list[str]]:
    """The text blocks and the stream of tags and slots, a slot with its place for each block."""
    stack: list[Part] = []
    count: Counter = Counter()  # of open elements by name
    found: list[Block] = []
    stream: list[str] = []
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                top = stack[-1] if stack else None
                place = top.place if top else ""
                found.append(Block(place, whole, bool(top and (top.hard or top.named)), (1 if top.doubt else 2) if top and top.article else 0, linked / max(1, len(whole))))
                stream.append(f"#{place}")
            text.clear()
        linked = 0

    def start(name: str, rest: str) -> None:
        stack.append(Part(name, rest, stack[-1] if stack else None))
        count[name] += 1

    def close(upto: int) -> None:
        count.subtract(p.name for p in stack[upto:])
        del stack[upto:]

    for kind, name, rest in tokens(source):
        if kind == "text":
            if not (stack and stack[-1].gone):
                text.append(entities.unescape(rest))
                if stack and stack[-1].link:
                    linked += len(text[-1].strip())
        elif kind == "open":
            if name == "br":
                text.append(" ")
            if name in BLOCKS or name in DROPPED:
                if name in BLOCKS:
                    flush()
                    if name not in ("li", "dt", "dd", "td", "th", "tr"):
                        ends = {"p", "h1", "h2", "h3", "h4", "h5", "h6"} if name in BLOCKS else set()
                    else:
                        ends = {"p", name, "dt", "dd"} if name in ("dt", "dd") else {"p", "td", "th"} if name in ("td", "th") else {"p", "td", "th", "tr"} if name == "tr" else {"p", "li"}
                    for i in range(len(stack) - 1, -1, -1) if any(count[e] for e in ends) else ():  # an open paragraph, item or cell ends here, up to the next container
                        if stack[i].name in ends:
                            close(i)
                            break
                        if stack[i].name in CONTAINERS and stack[i].name not in ends:
                            break
                    stream.append(f"<{name}>")
                if name not in VOID and not rest.rstrip().endswith("/") or name in BLOCKS:
                    start(name, rest)
            elif name not in VOID:
                start(name, rest)
        else:
            for i in range(len(stack) - 1, -1, -1) if count[name] else ():
                if stack[i].name == name:
                    if name in BLOCKS:
                        flush()
                        stream.append(f"</{name}>")
                    close(i)
                    break
                if stack[i].name in CONTAINERS and name not in BLOCKS:
                    break
    flush()
    return found, stream


def folded(stream: list, most: int = 12) -> tuple[list, list[int]]:
    """Stretches that stand there again and again, as ('+', stretch), and where in the stream each item starts."""
    out: list = []
    starts: list[int] = []
    for at, item in enumerate(stream):
        out.append(item)
        starts.append(at)
        for size in range(1, min(most, len(out)) + 1):
            last = out[-size - 1] if len(out) > size else None
            grouped = isinstance(last, tuple) and last[0] == "+"
            if grouped:
                if last[1][-1] != item or list(last[1]) != out[-size:]:
                    continue
                del out[-size:], starts[-size:]
                break
            if size > 1 and last == item and out[-2 * size : -size] == out[-size:]:
                tail = out[-size:]
                del out[-2 * size :], starts[-2 * size + 1 :]
                out.append(("+", tuple(tail)))
                break
    return out, starts


def fold_repeats(stream: list, most: int = 12) -> list:
    """Stretches that stand there again and again, as ('+', stretch)."""
    return folded(stream, most)[0]


def sizes_of(groups: set) -> dict:
    """The sizes of the groups that start with an item, largest first."""
    sizes = defaultdict(set)
    for g in groups:
        sizes[g[1][0]].add(len(g[1]))
    return {x: sorted(n, reverse=True) for x, n in sizes.items()}


def single(items: list, tags: list, groups: set, sizes: dict, both: Callable) -> tuple[list, list]:
    """Items with stretches that stand there once but are a repeated group elsewhere as that group; the tags of what becomes one are joined by `both`."""
    out, kept, i = [], [], 0
    while i < len(items):
        stretches = (("+", tuple(items[i : i + n])) for n in sizes.get(items[i], ()))
        size, item = next(((len(g[1]), g) for g in stretches if g in groups), (1, items[i]))
        tag = tags[i]
        for t in tags[i + 1 : i + size]:
            tag = both(tag, t)
        if out and out[-1] == item and item in groups:
            kept[-1] = both(kept[-1], tag)
        else:
            out.append(item)
            kept.append(tag)
        i += size
    return out, kept


def coded(items: list) -> tuple[dict, np.ndarray]:
    """A number for each different item, and the items as such numbers."""
    number: dict = {}
    return number, np.array([number.setdefault(v, len(number)) for v in items], np.int64)


def common(x: list, y: list, known: tuple[dict, np.ndarray] | None = None) -> list[tuple[int, int]]:
    """The places in x and y of a longest common subsequence, in bounded memory: large tables are halved by Hirschberg's method.

    A row of the table is a number whose bit k is 0 where the length grows from k to k + 1 items of y. `known` is x coded.
    """
    number, a = known or coded(x)
    b = np.array([number.get(v, -1) for v in y], np.int64)

    def rows(a: np.ndarray, b: np.ndarray) -> Iterator[int]:
        full = (1 << len(b)) - 1
        where: dict[int, int] = defaultdict(int)
        for k, v in enumerate(b.tolist()):
            where[v] |= 1 << k
        row = full
        yield row
        for v in a.tolist():
            if v in where:
                met = row & where[v]
                row = ((row + met) | (row - met)) & full
            yield row

    def lengths(row: int, n: int) -> np.ndarray:
        bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
        return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))

    def pairs(a: np.ndarray, b: np.ndarray, i0: int, j0: int) -> list[tuple[int, int]]:
        n = min(len(a), len(b))
        differ = np.nonzero(a[:n] != b[:n])[0]
        start = int(differ[0]) if len(differ) else n
        n -= start
        differ = np.nonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])[0]
        end = int(differ[0]) if len(differ) else n
        out = [(i0 + k, j0 + k) for k in range(start)]
        tail = [(i0 + len(a) - k, j0 + len(b) - k) for k in range(end, 0, -1)]
        a, b, i0, j0 = a[start : len(a) - end], b[start : len(b) - end], i0 + start, j0 + start
        if not len(a) or not len(b):
            return out + tail
        if len(a) > 1 and len(a) * len(b) > 4_000_000:
            half = len(a) // 2
            for up in rows(a[:half], b):
                pass
            for down in rows(a[half:][::-1], b[::-1]):
                pass
            k = int((lengths(up, len(b)) + lengths(down, len(b))[::-1]).argmax())
            return out + pairs(a[:half], b[:k], i0, j0) + pairs(a[half:], b[k:], i0 + half, j0 + k) + tail
        table = list(rows(a[::-1], b[::-1]))[::-1]  # the lowest len(b) - j bits of table[i]: the longest of a[i:] and b[j:]
        x, y = a.tolist(), b.tolist()
        i = j = 0
        while i < len(x) and j < len(y):
            low = (1 << len(y) - j) - 1
            if x[i] == y[j]:
                out.append((i0 + i, j0 + j))
                i, j = i + 1, j + 1
            elif table[i] is table[i + 1] or not table[i] >> (len(y) - j - 1) & 1 or (table[i + 1] & low).bit_count() == (table[i] & low).bit_count():
                i += 1
            else:
                j += 1
        return out + tail

    return pairs(a, b, 0, 0)


def bare(wrapper: list) -> tuple[list, list[bool]]:
    """The wrapper's items without the mark of optional ones, and which are."""
    maybe = [isinstance(x, tuple) and x[0] == "?" for x in wrapper]
    return [x[1][0] if m else x for x, m in zip(wrapper, maybe)], maybe


def groups_of(items: list) -> set:
    return {x for x in items if isinstance(x, tuple) and x[0] == "+"}


def align(wrapper: list, other: list) -> list:
    """The wrapper that also accepts the other stream or wrapper: equal items stay, a repeated group takes single ones, all else becomes optional."""
    (a, maybe), (b, too) = bare(wrapper), bare(other)
    groups = groups_of(a) | groups_of(b)
    sizes = sizes_of(groups)
    a, maybe = single(a, maybe, groups, sizes, lambda m, n: m and n)
    b, too = single(b, too, groups, sizes, lambda m, n: m and n)
    out, i, j = [], 0, 0
    for k, m in [*common(a, b), (len(a), len(b))]:
        out += [("?", (v,)) for v in a[i:k] + b[j:m]]
        if k < len(a):
            out.append(("?", (a[k],)) if maybe[k] or too[m] else a[k])
        i, j = k + 1, m + 1
    return out


def leaves(item: str | tuple) -> list[str]:
    """The places of the texts in an item, those of a repeated group once."""
    if isinstance(item, str):
        return [item] if item[0] == "#" else []
    return [p for x in item[1] for p in leaves(x)]


def laid(stream: list) -> tuple[list, list[int]]:
    """The folded stream, and for each text of the stream which of the leaves of its items it is."""
    items, starts = folded(stream)
    out: list[int] = []
    n = 0
    for item, lo, hi in zip(items, starts, [*starts[1:], len(stream)]):
        places = leaves(item)
        at = {p: n + k for k, p in reversed(list(enumerate(places)))}
        out += [at[x] for x in stream[lo:hi] if x[0] == "#"]
        n += len(places)
    return items, out


class Ready(NamedTuple):
    """A wrapper made ready for many matches: its bare items, these coded, its groups and their sizes."""

    items: list
    known: tuple[dict, np.ndarray]
    groups: set
    sizes: dict


def ready(wrapper: list) -> Ready:
    items, _ = bare(wrapper)
    groups = groups_of(items)
    return Ready(items, coded(items), groups, sizes_of(groups))


def slots_of(wrapper: Ready, items: list) -> list[int]:
    """For each leaf of a folded stream the number of the wrapper's item that takes it; of one that no item takes, -1 less the number of the stream's own items of that place before it."""
    b, starts = single(items, list(range(len(items))), wrapper.groups, wrapper.sizes, lambda m, n: m)
    takes = {m: k for k, m in common(wrapper.items, b, wrapper.known)}
    slots: list[int] = []
    seen: Counter = Counter()
    for m, (lo, hi) in enumerate(zip(starts, [*starts[1:], len(items)])):
        places = [p for item in items[lo:hi] for p in leaves(item)]
        slots += [takes[m] if m in takes else -1 - seen[p] for p in places]
        seen.update(set(places))
    return slots


def match(wrapper: list, stream: list) -> list[str]:
    """For each text of the stream its slot of the wrapper: the number of the item that takes it, with its place; of a text that no item takes, which of the page's own items of that place it is in."""
    items, at = laid(stream)
    slots = slots_of(ready(wrapper), items)
    numbers = (slots[leaf] for leaf in at)
    return [f"{n}{p}" if n >= 0 else f"~{-1 - n}{p}" for n, p in zip(numbers, (x for x in stream if x[0] == "#"))]


#: A slot has a label, and a text is fixed in its slot, by this share of the host's pages, of LEAST_PAGES different ones at least.
SHARE, LEAST_PAGES = 0.6, 3


def kind_of(block: Block) -> str:
    return "out" if block.out else "article" if block.article else "links" if block.links > SHARE else "main"


def infer(pages: list[str]) -> dict:
    """The wrapper of pages of one host: {'wrapper': items, 'places': {slot: label}, 'fixed': texts that stand in one slot on SHARE of the pages outside of articles}."""
    wrapper: list | None = None
    slots: dict[str, Counter] = defaultdict(Counter)
    texts: Counter = Counter()
    parsed = [blocks(source) for source in dict.fromkeys(pages)]
    for _, stream in parsed:
        items = fold_repeats(stream)
        wrapper = items if wrapper is None else align(wrapper, items)
    for found, stream in parsed:
        named = list(zip(match(wrapper or [], stream), found))
        for slot, block in named:
            for key in {slot, f"#{block.place}"}:
                slots[key][kind_of(block)] += 1
        texts.update({(slot, b.text) for slot, b in named if kind_of(b) in ("main", "links")})
    enough = len(parsed) >= LEAST_PAGES
    labels = {slot: next((k for k, n in c.items() if n >= SHARE * sum(c.values())), "main") for slot, c in slots.items()}
    return {
        "wrapper": wrapper or [],
        "places": labels,
        "fixed": sorted({t for (_, t), n in texts.items() if enough and n >= SHARE * len(parsed)}),
    }


def label_of(labels: dict[str, str], slot: str, block: Block) -> str:
    """The label of a text in a slot: a place says less than an item of the wrapper, so it makes links only of what is linked itself."""
    if slot[0] != "~" and slot in labels:
        return labels[slot]
    return "links" if kind_of(block) == "links" == labels.get(slot, labels.get(f"#{block.place}")) else "main"


def extract(source: str | None, wrapper: dict | None = None) -> str:
    """The main text of a page: the blocks in its slots, joined by line ends. Without a wrapper, by tags and names alone.

    Inside of an article nothing is dropped but what its tags or names say is no part of it.

    The wrapper's 'marks' are slots ('' for texts that no item takes) and digests of place and text that are fixed in them.
    """
    found, stream = blocks(source or "")
    labels = (wrapper or {}).get("places", {})
    fixed, marks = ((wrapper or {}).get(k, ()) for k in ("fixed", "marks"))
    slots = match((wrapper or {}).get("wrapper", []), stream)
    known = [(b, label_of(labels, slot, b), slot) for slot, b in zip(slots, found) if not b.out]
    for least in (2, 1):  # articles in what is named otherwise count only where there are no others
        articles = [b.text for b, label, _ in known if b.article >= least or (label == "article" and b.article == 0)]
        if articles:
            return "\n".join(articles)
    return "\n".join(b.text for b, label, slot in known if label == "main" and b.text not in fixed and not (marks and ("" if slot[0] == "~" else slot, digest(b.place, b.text)) in marks))


def frozen(items: list) -> list:
    """The wrapper's items as they were before JSON made lists of them."""
    deep = lambda x: tuple(map(deep, x)) if isinstance(x, list) else x
    return [deep(x) for x in items]


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


PARSED = pa.list_(pa.struct([("leaf", pa.int32()), ("place", pa.string()), ("mark", pa.int64()), ("kind", pa.string()), ("article", pa.int32()), ("out", pa.bool_()), ("text", pa.string())]))


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, page (a digest of html, null with it), stream (the folded one, JSON), form (a digest of that) and blocks of each page (page_id, url, host, html): which leaf of the stream, place, kind, text, and, outside of articles, a digest of place and text."""
    id_type = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, rows, digests, streams = [0], [], [], []
            for source in batch.column(3).to_pylist():
                found, stream = blocks(source or "")
                digests.append(None if source is None else digest(source))
                items, at = laid(stream)
                streams.append(json.dumps(items, separators=(",", ":")))
                for leaf, b in zip(at, found):
                    kind = kind_of(b)
                    rows.append((leaf, b.place, digest(b.place, b.text) if kind in ("main", "links") else 0, kind, b.article, b.out, b.text))
                ends.append(len(rows))
            columns = zip(*rows) if rows else [()] * len(PARSED.value_type)
            fields = [pa.array(c, f.type) for c, f in zip(columns, PARSED.value_type)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(PARSED.value_type)))
            more = [pa.array(digests, pa.int64()), pa.array(streams, pa.string()), pa.array([digest(x) for x in streams], pa.int64()), lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *more], ["page_id", "url", "host", "page", "stream", "form", "blocks"])

    block = "leaf: int, place: string, mark: bigint, kind: string, article: int, out: boolean, text: string"
    return pages.select("page_id", "url", "host", "html").mapInArrow(run, f"page_id {id_type}, url string, host string, page long, stream string, form long, blocks array<struct<{block}>>")


def streams_of(pages: DataFrame) -> DataFrame:
    """host, form, stream, n: the different folded streams of all pages of a host, and how many different pages have each."""
    pages = pages.where("stream <> '[]'")
    n = pages.select("host", "form", "page").distinct().groupBy("host", "form").agg(F.count("*").alias("n"))
    return pages.select("host", "form", "stream").distinct().join(n, ["host", "form"])


def without_rare(streams: DataFrame) -> DataFrame:
    """host, wrapper (JSON), n: the different streams without items of places that fewer than LEAST_PAGES different pages of the host have: no slot there could get a label."""
    places = F.array_distinct(F.regexp_extract_all("stream", F.lit('"(#[0-9a-f]*)"'), F.lit(1)))
    each = streams.select("host", "form", "n", F.explode(places).alias("place"))
    rare = each.groupBy("host", "place").agg(F.sum("n").alias("pages")).where(F.col("pages") < LEAST_PAGES).select("host", "place")
    of = each.join(rare, ["host", "place"]).groupBy("host", "form").agg(F.collect_set("place").alias("rare"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = []
            for stream, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                left.append(stream if not gone else json.dumps([x for x in frozen(json.loads(stream)) if not set(gone).intersection(leaves(x))], separators=(",", ":")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.string()), batch.column(1)], ["host", "wrapper", "n"])

    kept = streams.join(of, ["host", "form"], "left").select("host", "n", "stream", "rare").mapInArrow(run, "host string, wrapper string, n long")
    return kept.groupBy("host", "wrapper").agg(F.sum("n").alias("n"))


def wrappers(streams: DataFrame, at_once: int = 64) -> DataFrame:
    """host, wrapper (JSON): inferred from all streams (host, form, stream, n) of a host.

    About at_once of a host's are merged in one group, the most frequent ones first, and what comes of that again, until
    each host has one; so the steps grow with the logarithm of a host's different streams.
    """
    fan = max(2, at_once)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n", "wrapper"], ascending=[False, True])
        first, *more = (frozen(json.loads(w)) for w in group["wrapper"])
        for other in more:
            first = align(first, other)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps(first, separators=(",", ":"))], "n": [int(group["n"].sum())]})

    now = without_rare(streams).checkpoint()
    while True:
        sizes = now.groupBy("host").agg(F.count("*").alias("rows"), F.ceil(F.count("*") / fan).alias("parts")).checkpoint()
        if (sizes.agg(F.max("rows")).first()[0] or 0) <= 1:
            return now.select("host", "wrapper")
        part = F.pmod(F.xxhash64("wrapper"), F.col("parts"))
        now = join_hot(now, sizes, "host", "rows").withColumn("part", part).groupBy("host", "part").applyInPandas(run, "host string, wrapper string, n long").checkpoint()


def placed_in(streams: DataFrame, known: DataFrame, at_once: int = 256) -> DataFrame:
    """host, form, slots: for each leaf of the streams (host, form, stream) its slot of the host's wrapper (host, wrapper), which goes to about at_once streams of the host at a time."""
    sizes = streams.groupBy("host").agg(F.count("*").alias("rows"), F.ceil(F.count("*") / at_once).alias("parts")).checkpoint()

    def run(some: pd.DataFrame, one: pd.DataFrame) -> pd.DataFrame:
        if not len(some):
            return pd.DataFrame({"host": [], "form": [], "slots": []})
        wrapper = ready(frozen(json.loads(one["wrapper"].iloc[0])))
        return pd.DataFrame({"host": some["host"], "form": some["form"], "slots": [slots_of(wrapper, frozen(json.loads(x))) for x in some["stream"]]})

    parts = join_hot(streams.select("host", "form", "stream"), sizes, "host", "rows").withColumn("part", F.pmod("form", "parts")).drop("parts")
    given = known.join(sizes, "host").select("host", "wrapper", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return parts.groupBy("host", "part").cogroup(given.groupBy("host", "part")).applyInPandas(run, "host string, form long, slots array<int>")


def slotted(block: Column, slots: Column) -> list[Column]:
    """What is known of a block but its text, with its slot."""
    number = slots[block["leaf"]]
    slot = F.concat(F.when(number >= 0, number.cast("string")).otherwise(F.concat(F.lit("~"), (-1 - number).cast("string"))), F.lit("#"), block["place"])
    return [slot.alias("slot"), *(block[k].alias(k) for k in ("mark", "kind", "article", "out"))]


def counts(pages: DataFrame) -> DataFrame:
    """host, page, slot, mark, kind, n of each different page: texts by slot; a row with the slot '' for the page."""
    slim = F.transform("blocks", lambda b: F.struct(b["slot"].alias("slot"), b["mark"].alias("mark"), b["kind"].alias("kind")))
    whole = F.array(F.struct(F.lit("").alias("slot"), F.lit(0).cast("long").alias("mark"), F.lit("").alias("kind")))
    pages = pages.where(F.col("page").isNotNull()).select("host", "page", F.concat(whole, slim).alias("b")).groupBy("host", "page").agg(F.min("b").alias("b"))
    return pages.select("host", "page", F.inline("b")).groupBy("host", "page", "slot", "mark", "kind").agg(F.count("*").alias("n"))


def taken(slot: Column) -> Column:
    """Whether an item of the wrapper takes the text."""
    return slot.rlike("^[0-9]")


def place_of(slot: Column) -> Column:
    return F.substring_index(slot, "#", -1)


def labelled(each: DataFrame, key: str) -> DataFrame:
    """host, key, label: what SHARE of the texts there are, for slots or places that LEAST_PAGES different pages have."""
    kinds = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in ("out", "article", "links")]
    found = each.groupBy("host", key, "page").agg(*kinds, F.sum("n").alias("n")).groupBy("host", key).agg(*(F.sum(k).alias(k) for k in ("out", "article", "links", "n")), F.count("*").alias("on"))
    label = F.coalesce(*(F.when(F.col(k) >= SHARE * F.col("n"), F.lit(k)) for k in ("out", "article", "links")), F.lit("main"))
    return found.where(F.col("on") >= LEAST_PAGES).select("host", key, label.alias("label"))


def fixed(each: DataFrame) -> DataFrame:
    """host, marks (slot and digest of place and text), by SHARE over all different pages of a host, LEAST_PAGES at least.

    A text that no item takes could stand in any slot of its place: it counts for each, and is fixed itself by all pages
    that have it there. One that an item takes counts for the other slots of its place that its page has nothing in.
    """
    pages = each.where("slot = ''").groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    enough = lambda n: n >= F.greatest(F.lit(LEAST_PAGES), SHARE * F.col("pages"))
    each = each.withColumn("place", place_of(F.col("slot")))
    texts = each.where("mark <> 0").groupBy("host", "page", "place", "mark").agg(F.collect_set(F.when(taken(F.col("slot")), F.col("slot"))).alias("slots"))
    often = texts.groupBy("host", "place", "mark").agg(F.count("*").alias("all")).join(pages, "host").where(enough(F.col("all"))).checkpoint()
    stands = texts.join(often, ["host", "place", "mark"]).where(F.size("slots") > 0)
    held = each.where(taken(F.col("slot"))).join(often.select("host", "place").distinct(), ["host", "place"], "left_semi").groupBy("host", "page", "place").agg(F.collect_set("slot").alias("held"))
    other = stands.join(held, ["host", "page", "place"]).select("host", "mark", F.explode(F.array_except("held", "slots")).alias("slot")).groupBy("host", "mark", "slot").agg(F.count("*").alias("other"))
    own = stands.select("host", "mark", "all", "pages", F.explode("slots").alias("slot")).distinct()
    bound = own.join(other, ["host", "mark", "slot"], "left").where(enough(F.col("all") - F.coalesce("other", F.lit(0)))).select("host", "slot", "mark")
    bound = bound.unionByName(often.select("host", F.lit("").alias("slot"), "mark"))
    return bound.select("host", F.struct("slot", "mark").alias("m")).groupBy("host").agg(F.array_sort(F.collect_set("m")).alias("marks"))


def rules(each: DataFrame, known: DataFrame) -> DataFrame:
    """host, places (labels of the wrapper's slots, whose number is bounded), marks (the fixed texts)."""
    places = known.groupBy("host").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot", "label")))).alias("places"))
    return fixed(each).join(places, "host", "full").select("host", "places", "marks")


def remainder(each: DataFrame, known: DataFrame) -> DataFrame:
    """host, page, links: slots of a page's linked texts that are not known but links by all texts of pages that have such a slot, or else by all of its place."""
    each = each.where("slot <> ''").withColumn("place", place_of(F.col("slot")))
    needed = each.where("kind = 'links'").join(known.select("host", "slot"), ["host", "slot"], "left_anti").select("host", "page", "slot", "place").distinct()
    slots = labelled(each.where(~taken(F.col("slot"))), "slot")
    places = labelled(each.join(needed.select("host", "place").distinct(), ["host", "place"], "left_semi"), "place").withColumnRenamed("label", "over")
    found = needed.join(slots, ["host", "slot"], "left").join(places, ["host", "place"], "left")
    return found.where("coalesce(label, over) = 'links'").groupBy("host", "page").agg(F.array_sort(F.collect_list("slot")).alias("links"))


MOST_BROADCAST_BYTES = 32 << 20


def main_text(pages: DataFrame, at_once: int = 64) -> DataFrame:
    """page_id, url, text of each row of pages (page_id, url, html).

    A null or empty html has an empty text. A null or broken URL belongs to the host ''. A page that is cut off is read as
    far as it goes; a tag without end is no text. Pages of any length are read whole. Repeated rows stay. An empty table
    gives none. The expression comes from all pages of a host, whose different streams are merged by about at_once; what
    its slots hold is counted over all of its pages, and so are, by their places, texts that none of its items takes.
    """
    small_batches(pages.sparkSession, 500)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    placed = pages.select("page_id", "url", "html", host.alias("host"))
    shared_dir(pages.sparkSession)

    def joined(rows: DataFrame, known: DataFrame, *on: str) -> DataFrame:
        size = known.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
        return rows.join(F.broadcast(known) if size <= MOST_BROADCAST_BYTES else known, list(on), "left")

    read = stored(parsed(placed), "blocks")
    streams = streams_of(read).checkpoint()
    slots = placed_in(streams, wrappers(streams, at_once)).checkpoint()
    slim = read.select("host", "form", "page", F.transform("blocks", lambda b: b.dropFields("text")).alias("blocks"))
    counted = counts(joined(slim, slots, "host", "form").withColumn("blocks", F.transform("blocks", lambda b: F.struct(*slotted(b, F.col("slots")))))).checkpoint()
    known = labelled(counted.where(taken(F.col("slot"))), "slot").checkpoint()
    whole = joined(read.drop("stream"), slots, "host", "form").withColumn("blocks", F.transform("blocks", lambda b: F.struct(*slotted(b, F.col("slots")), b["text"].alias("text"))))
    ruled = joined(joined(whole, rules(counted, known).checkpoint(), "host"), remainder(counted, known).checkpoint(), "host", "page")
    linked = lambda b: (b["kind"] == "links") & F.array_contains(F.coalesce("links", F.array().cast("array<string>")), b["slot"])
    label = lambda b: F.coalesce(F.try_element_at(F.coalesce("places", F.create_map().cast("map<string,string>")), b["slot"]), F.when(linked(b), "links"))
    bound = lambda b: F.struct(F.when(taken(b["slot"]), b["slot"]).otherwise("").alias("slot"), b["mark"].alias("mark"))
    inside = F.filter("blocks", lambda b: ~b["out"])
    # as extract() does: articles; those in what is named otherwise only where there are no others; else the main slots without fixed texts
    articles = lambda least: F.filter(inside, lambda b: (b["article"] >= least) | (F.coalesce(label(b) == "article", F.lit(False)) & (b["article"] == 0)))
    sure, doubtful = articles(2), articles(1)
    rest = F.filter(inside, lambda b: (F.coalesce(label(b), F.lit("main")) == "main") & ~F.array_contains(F.coalesce("marks", F.array().cast("array<struct<slot:string,mark:bigint>>")), bound(b)))
    kept = F.when(F.size(sure) > 0, sure).when(F.size(doubtful) > 0, doubtful).otherwise(rest)
    return ruled.select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), "\n").alias("text"))
