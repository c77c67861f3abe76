"""Main text of web pages: a suffix array over each host's token streams, with the pages' structure.

Parsing. A page is cut into blocks at block-level tags. Structure says of a block that it is text (inside ``article`` or ``main``),
that it is not (menus, page headers, footers, sidebars, notices, adverts, forms, reader comments, by element or by a class, id or
role that is such a name or begins with one), or nothing: blocks outside of articles, and blocks whose name only ends like one, such
as "post-footer". Ids of headings are made of their words and say nothing. Inside an article neither do compound ids, nor any name of an
inline element or of what is in ``pre`` or ``code``; and a name that begins like one but goes on otherwise, such as "related-work", leaves
the block to the array. Scripts, styles and
what isn't shown is no block.

Suffix array. The blocks of a host's pages, each a run of tokens with an end of its own, are concatenated. All suffixes are sorted to
``REACH`` tokens by prefix doubling, and neighbours have their common prefix (LCP) from the ranks of each doubling; a longer repeat is
the union of overlapping ones. From both come, for every position, the longest substring that another page has too, and on how many
pages of the host the ``DEPTH`` tokens at that position occur. A page that shares over ``COPIED`` of its tokens, in text and open blocks,
with others is a copy, or has nothing of its own, and counts as none: near copies are no evidence against each other. A token is repeated if it lies in
a run of ``DEPTH`` tokens on ``LEAST_PAGES`` or more of the other distinct pages, and ``SHARE`` of them.

Decision. Of the blocks that structure leaves open, those of repeated tokens throughout (short ones: those that are blocks of as many
pages) are boilerplate and go; the rest, the unique runs, stays. A passage of an article stays however often the host repeats it, as
does a part of a block. If a page's articles hold less text than what stays outside of them, they are teasers and both are the text;
else the articles are.

A host of more than ``PART_PAGES`` pages or ``PART_BYTES`` of html is dealt by a hash of the blocks into parts of about that size, each of
which has an array, so that equal pages meet. The parts then tell each other what their arrays can't see, by 64-bit hashes of the ``DEPTH``
tokens of a window: which stretches of hashes two parts use, on how many pages the windows in those lie, and, if the host has open blocks,
on how many pages that count. So the counts are those of the whole host, and parts change no result. Copies that fill a batch of rows
leave one row in their part; the others are judged in parts where they count as no page.

Defined cases: null or empty html gives empty text; null urls are one host, without a name; null ``page_id`` and repeated rows stay, and
equal pages of a host count as one; a very long page is parsed whole and needs about a hundred bytes a token; an empty table gives no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html as entities
import hashlib
import math
import re
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import partitions, table, written

DEPTH, REACH = 8, 64  # tokens; powers of two
LEAST_PAGES, SHARE, COPIED = 3, 0.05, 0.75
PART_PAGES, PART_BYTES, BROADCAST_HOSTS = 500, 1 << 23, 10_000
HOT = 8  # copies in one batch
TEXT, NOT_TEXT, OPEN, OPEN_OUTSIDE = range(4)

_TAG = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CONTAINER = {"article", "main"}
_DROPPED = _RAW | {"nav", "footer", "aside", "form", "head", "menu", "dialog", "button", "select", "svg", "canvas", "object", "audio", "video", "datalist", "fieldset"}
_VERBATIM = {"pre", "code"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Words of class, id and role that name what isn't main text: in any place of a name, as a name or its first word, reader comments.
_ANYWHERE = set(
    "nav navbar navigation menu menubar menus breadcrumb breadcrumbs pagination pager sidebar aside cookie cookies consent gdpr "
    "ad ads adv advert adverts advertisement advertising sponsor sponsored newsletter subscribe subscription signup login searchbox".split()
)
_FIRST = set(
    "toolbar complementary footer contentinfo header masthead banner notice notices notification alert popup modal overlay dialog promo promotion "
    "share sharing social related recommended search form widget skip".split()
)
# With one of these behind it, or alone, such a word names a part of a page; before other words it may be an article's own ("related-work").
_PARTS = set(
    "area articles bar block box btn button buttons container content footer form group header icons inline inner items link links list listing module news "
    "overlay pages panel popup post posts promo reading row section side stories strip text topics widget widgets wrap wrapper".split()
)
_OF_PAGE = {"site", "page", "global", "top", "main", "web"}
_REMARKS = {"comment", "comments", "disqus", "respond", "replies"}
_FLAGS = {"has", "with", "no", "is", "js"}
_AT_HEAD = {"header", "masthead", "banner"}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

_NOTHING, _MAYBE, _NAMED, _COMMENTS = range(4)  # what names say


class _Node:
    __slots__ = ("tag", "parent", "dropped", "outside", "inside", "container", "holds", "verbatim")

    def __init__(self, tag, parent, dropped=False, outside=_NOTHING, inside=_NOTHING):
        self.tag, self.parent, self.dropped, self.outside, self.inside = tag, parent, dropped, outside, inside
        self.container = tag in _CONTAINER
        self.holds = False  # a container is below
        self.verbatim = tag in _VERBATIM or (parent is not None and parent.verbatim)


def _name(name: str, inside: bool) -> int:
    """What one class, id or role says, inside of an article or not."""
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or words[0] in _FLAGS:
        return _NOTHING
    if not _REMARKS.isdisjoint(words):
        return _COMMENTS
    if not _ANYWHERE.isdisjoint(words):
        return _NAMED
    if words[0] in _FIRST or (words[0] in _OF_PAGE and words[-1] in _FIRST):
        if inside and words[0] in _AT_HEAD:
            return _NOTHING
        return _MAYBE if inside and not all(w in _PARTS or w in _FIRST or w.isdigit() for w in words[1:]) else _NAMED
    if words[-1] in _FIRST:
        return _NOTHING if inside and words[-1] in _AT_HEAD else _MAYBE
    return _NOTHING


def _marks(tag: str, attributes: str) -> tuple[bool, int, int]:
    """Whether an element is dropped by its kind; what its names say outside of an article, and inside."""
    dropped = tag in _DROPPED
    if not attributes or attributes.isspace():
        return dropped, _NOTHING, _NOTHING
    own = {}
    for m in _ATTRIBUTE.finditer(attributes):
        own.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(own.get("style", "").lower()):
        dropped = True
    names = f"{own.get('class', '')} {own.get('role', '')}".split()
    ids = [] if tag in _HEADINGS else own.get("id", "").split()
    plain = [x for x in ids if len(_WORD.findall(x)) == 1]
    inside = [] if tag in _INLINE else names + plain
    return dropped, max((_name(x, False) for x in names + ids), default=0), max((_name(x, True) for x in inside), default=0)


def parsed_blocks(html: str | None) -> list[tuple[int, str]]:
    """The page's blocks in order, white space turned into single spaces: (TEXT, NOT_TEXT, OPEN inside or OPEN_OUTSIDE of articles, text)."""
    html = html or ""
    root = _Node("", None)
    here, at, n = root, 0, len(html)
    containers = []
    pieces: list[tuple[_Node, str]] = []  # text and where it is; an empty text ends a block
    while at < n:
        m = _TAG.search(html, at)
        begin = m.start() if m else n
        if begin > at:
            pieces.append((here, html[at:begin]))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if tag not in _INLINE:
            pieces.append((here, ""))
        if m[1] or m[4]:
            node = here
            while node is not root and node.tag != tag and (tag not in _INLINE or node.tag in _INLINE):
                node = node.parent
            if node is not root and node.tag == tag:
                here = node.parent
            continue
        if tag in _VOID:
            continue
        attributes = m[3] or m[6] or ""
        if tag == "p" and here.tag == "p":
            here = here.parent
        node = _Node(tag, here, *_marks(tag, attributes))
        if node.container:
            containers.append(node)
            up = here
            while up is not None and not up.holds:
                up.holds, up = True, up.parent
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(html, at)
            at = end.start() if end else n
            continue
        if not attributes.endswith("/"):
            here = node

    def fates(strict: bool):
        """Of a node: what names and elements say of it, and whether it is inside a container that isn't dropped.

        ``strict``: names count on any element, else not on one around a container, save for reader comments."""
        fate: dict[_Node, tuple[int, bool]] = {root: (_NOTHING, False)}

        def of(node: _Node) -> tuple[int, bool]:
            path = []
            while node not in fate:
                path.append(node)
                node = node.parent
            for x in reversed(path):
                says, inside = fate[x.parent]
                named = x.outside if not inside else _NOTHING if x.verbatim else x.inside
                if x.tag not in ("html", "body", "main") and (strict or not x.holds or named == _COMMENTS):
                    says = max(says, named)
                if x.dropped or (x.tag == "header" and not inside and not x.holds):
                    says = _COMMENTS
                fate[x] = says, inside or (x.container and says < _NAMED)
            return fate[path[0] if path else node]

        return of

    fate_of = fates(True)
    if containers and not any(fate_of(x)[1] for x in containers):
        fate_of = fates(False)
    out, now, kind = [], [], None

    def end() -> None:
        if now and (text := " ".join(entities.unescape("".join(now)).split())):
            out.append((kind, text))
        now.clear()

    for node, text in pieces:
        if text == "":
            end()
            continue
        says, inside = fate_of(node)
        own = NOT_TEXT if says >= _NAMED else (TEXT if says == _NOTHING else OPEN) if inside else OPEN_OUTSIDE
        if own != kind:  # an inline element may be boilerplate inside a block
            end()
            kind = own
        now.append(text)
    end()
    return out


def blocks(html: str | None) -> tuple[list[str], bool]:
    """The blocks that structure alone finds to be text, and True; without any, those that it leaves open, and False."""
    found = parsed_blocks(html)
    text = [t for k, t in found if k == TEXT]
    return (text, True) if text else ([t for k, t in found if k in (OPEN, OPEN_OUTSIDE)], False)


def suffix_array(ids: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``ids`` in the order of their first ``reach`` tokens, and the common prefix of each with the one before it (below
    ``2 * reach``)."""
    n = len(ids)
    rank, width, levels = np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1, 1, []
    while True:
        levels.append((width, rank.astype(np.int32)))
        if width >= reach or rank.max(initial=0) == n:
            break
        after = np.zeros_like(rank)
        after[:-width] = rank[width:]
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
        width *= 2
    order = np.argsort(rank, kind="stable")
    a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(max(n - 1, 0), np.int64)
    for width, rank in reversed(levels):
        ranked = np.append(rank, [0])
        same = (a < n) & (b < n)
        same &= ranked[np.minimum(a, n)] == ranked[np.minimum(b, n)]
        for x in (a, b, common):
            x[same] += width
    return order, np.concatenate([[0], common])[:n]


def repeats(ids: np.ndarray, owner: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For each position of ``ids``: the length of the longest substring there that another owner has too, and a number that names the
    ``depth`` tokens there, in order of suffixes. Owners end with tokens that nothing else has."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, common = suffix_array(ids)
    own = owner[order]
    # Least common prefix back to the nearest suffix of another owner: a running minimum that starts anew where the owner changes.
    starts, big = np.concatenate([[True], own[1:] != own[:-1]]), 4 * REACH

    def running(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        run = np.cumsum(starts) * big
        return np.minimum.accumulate(values - run) + run

    back = running(common, starts)
    ends = np.concatenate([starts[1:], [True]])
    ahead = running(np.concatenate([common[1:], [0]])[::-1], ends[::-1])[::-1]
    longest, window = np.empty(n, np.int64), np.empty(n, np.int64)
    longest[order] = np.maximum(back, ahead)
    window[order] = np.cumsum(common < depth) - 1
    return longest, window


def _distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, ascending."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def holders(window: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each position: how many of the owners that count (``counts``, by owner) have its window."""
    if not len(window):
        return window
    n, own = len(counts), counts[owner]
    distinct = _distinct(window[own] * n + owner[own]) // n
    return np.bincount(distinct, minlength=int(window.max()) + 1)[window]


def _spread(starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Which tokens the runs that begin where ``starts`` is true cover."""
    marks = np.zeros(len(starts) + 1, np.int64)
    where = np.nonzero(starts)[0]
    np.add.at(marks, where, 1)
    np.add.at(marks, where + (lengths if np.isscalar(lengths) else lengths[where]), -1)
    return np.cumsum(marks)[:-1] > 0


def _concatenated(pages: Iterable[Iterable[list[str]]]) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Token ids of all pages' blocks, each block with an end that nothing else has; the page of each; the tokens of each page's blocks.
    Only ids are held, and one block's tokens at a time."""
    number: dict[str, int] = {}
    ids, sizes, end = array("q"), [], 0
    for blocks in pages:
        sizes.append([])
        for tokens in blocks:
            end -= 1
            ids.extend(number.setdefault(t, len(number)) for t in tokens)
            ids.append(end)
            sizes[-1].append(len(tokens))
    return np.frombuffer(ids, np.int64) if ids else np.zeros(0, np.int64), np.repeat(np.arange(len(sizes)), [sum(n) + len(n) for n in sizes]), sizes


def covered(streams: list[list[str]], depth: int = DEPTH) -> list[np.ndarray]:
    """Of each stream, which tokens lie in a substring of ``depth`` or more tokens that another stream has too."""
    ids, owner, _ = _concatenated([[s] for s in streams])
    longest, _ = repeats(ids, owner, depth)
    cover = _spread(longest >= depth, longest)
    ends = np.cumsum([len(s) + 1 for s in streams])
    return [cover[e - len(s) - 1 : e - 1] for s, e in zip(streams, ends, strict=True)]


class _Part:
    """The distinct pages of a part, as blocks, and their tokens, numbered. A page that isn't ``home`` is here to be judged only."""

    def __init__(self, pages: list[tuple[tuple[int, str], ...]], home: list[bool], depth: int):
        self.pages, self.home, self.depth, n = pages, np.array(home, bool), depth, len(pages)
        self.texts = pa.array([t for page in pages for _, t in page], pa.string())
        self.kinds = np.array([k for page in pages for k, _ in page], np.int64)
        words = pc.split_pattern(self.texts, " ")
        coded = words.flatten().dictionary_encode()
        self.vocabulary = coded.dictionary
        self.sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        self.page_of = np.repeat(np.arange(n), [len(page) for page in pages])
        blocks = np.repeat(np.arange(len(self.sizes)), self.sizes + 1)
        ends = np.cumsum(self.sizes + 1) - 1
        token = np.ones(len(blocks), bool)
        token[ends] = False
        self.ids = np.empty(len(blocks), np.int64)
        self.ids[token], self.ids[ends] = coded.indices.to_numpy(zero_copy_only=False), -1 - np.arange(len(ends))
        self.owner = self.page_of[blocks]
        self.starts = ends[blocks] - np.arange(len(blocks)) >= depth  # a window begins here
        self.left = token & (self.kinds != NOT_TEXT)[blocks]
        self.short = np.nonzero(self.sizes < depth)[0]
        self.opened = bool(np.isin(self.kinds, (OPEN, OPEN_OUTSIDE)).any())

    def hashes(self) -> np.ndarray:
        """Of each position, a hash of the tokens of the window there; without meaning where none begins."""
        out, width = np.append(_hashed(self.vocabulary, "of one token...."), np.uint64(0))[np.maximum(self.ids, -1)], 1
        while width < self.depth:
            after = np.zeros_like(out)
            after[:-width] = out[width:]
            out = out * np.uint64(0x9E3779B97F4A7C15) + after
            out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out, width = out ^ (out >> np.uint64(31)), width * 2
        return out

    def short_hashes(self) -> np.ndarray:
        return _hashed(self.texts.take(pa.array(self.short, pa.int64())), "of a whole block")

    def counted(self, elsewhere: np.ndarray) -> np.ndarray:
        """The pages that don't share over ``COPIED`` of their tokens."""
        shared, words = (np.bincount(self.owner[x], minlength=len(self.pages)) for x in (self.left & elsewhere, self.left))
        return shared <= COPIED * words


def _hashed(texts: pa.Array, key: str) -> np.ndarray:
    return pd.util.hash_array(texts.to_numpy(zero_copy_only=False), hash_key=key, categorize=False) if len(texts) else np.zeros(0, np.uint64)


Counts = tuple[np.ndarray, np.ndarray]  # hashes in order, and a count of each
NO_COUNTS: Counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)


def _looked_up(counts: Counts, hashes: np.ndarray) -> np.ndarray:
    """The count of each hash, 0 where it has none."""
    keys, values = counts
    if not len(keys):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, values[at], 0)


def _pages_with(hashes: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> Counts:
    """On how many of the pages that count each hash is."""
    keys, number = np.unique(hashes, return_inverse=True)
    n = max(len(counts), 1)
    distinct = _distinct(number * n + owner)
    return keys, np.bincount(distinct // n, counts[distinct % n], len(keys)).astype(np.int64)


def _decided(part: _Part, share: float, total: Counts = NO_COUNTS, counting: Counts = NO_COUNTS, pages: int | None = None) -> list[tuple[str, int, int]]:
    """Of each page what ``main_texts`` returns. Other parts of the host add: the pages with each window that several parts have, those of
    them that count, also by short blocks, and how many pages of the host count."""
    depth, ids, owner = part.depth, part.ids, part.owner
    longest, window = repeats(ids, owner, depth)
    elsewhere = _spread(longest >= depth, longest)
    if len(total[0]):
        first = np.unique(window, return_index=True)[1]  # one position of each window of the array
        hashes, real = part.hashes()[first], part.starts[first]
        elsewhere |= _spread((real & (_looked_up(total, hashes) > 1))[window], depth)
    counts = part.counted(elsewhere) & part.home
    need = max(LEAST_PAGES, math.ceil(share * (int(counts.sum()) if pages is None else pages)))
    held = holders(window, owner, counts)
    if len(total[0]) and len(counting[0]):
        held = np.maximum(held, np.where(real, _looked_up(counting, hashes), 0)[window])
    boilerplate = _spread(held >= need, depth) if len(ids) else elsewhere
    texts, page_of, sizes = part.texts.to_pylist(), part.page_of.tolist(), part.sizes.tolist()
    short = Counter(t for _, t in {(page_of[i], texts[i]) for i in part.short.tolist() if counts[page_of[i]]})
    if len(counting[0]):
        for i, n in zip(part.short.tolist(), _looked_up(counting, part.short_hashes()).tolist(), strict=True):
            short[texts[i]] = max(short[texts[i]], n)
    found, at, block = [], 0, 0
    for page in part.pages:
        gone, repeated, own = [], [], sizes[block : block + len(page)]
        for (_, text), n in zip(page, own, strict=True):
            here = slice(at, at + n)
            gone.append(bool(boilerplate[here].all()) if n >= depth else short[text] >= need)
            repeated.append(int(elsewhere[here].sum()))
            at += n + 1
        block += len(page)
        open_ = [i for i, (kind, _) in enumerate(page) if kind in (OPEN, OPEN_OUTSIDE)]
        left = [i for i in open_ if not gone[i]]
        inside = {i for i, (kind, _) in enumerate(page) if kind == TEXT} | {i for i in left if page[i][0] == OPEN}
        if sum(own[i] for i in inside) < sum(own[i] for i in left if page[i][0] == OPEN_OUTSIDE):
            inside |= set(left)
        kept = sorted(inside)
        found.append((" ".join(page[i][1] for i in kept), sum(repeated[i] for i in kept), sum(own[i] for i in open_) - sum(own[i] for i in left)))
    return found


def main_texts(pages: list[list[tuple[int, str]]], depth: int = DEPTH, share: float = SHARE) -> list[tuple[str, int, int]]:
    """Of each of a host's pages, as blocks: the main text, how many of its tokens other pages have in runs of ``depth`` or more, and how
    many tokens of open blocks were boilerplate."""
    distinct: dict[tuple, int] = {}
    for page in pages:
        distinct.setdefault(tuple(page), len(distinct))
    found = _decided(_Part(list(distinct), [True] * len(distinct), depth), share)
    return [found[distinct[tuple(page)]] for page in pages]


# What a part tells of one range of hashes (``bucket``) and what it hears back there: hashes in order, counts of them, pages that count.
_TOLD = "host string, part int, cell int, bucket int, step int, hashes binary, counts binary, pages long, opened boolean"
_Told = tuple[np.ndarray, np.ndarray, int, bool]


def _packed(values: np.ndarray) -> bytes:
    """Ascending hashes as their differences, byte by byte."""
    return zlib.compress(np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_TOLD_SCHEMA = pa.schema(
    [("host", pa.string()), ("part", pa.int32()), ("cell", pa.int32()), ("bucket", pa.int32()), ("step", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary()), ("pages", pa.int64()), ("opened", pa.bool_())]
)


def _met(told: pa.Table) -> pa.Table:
    """What parts told of one bucket: each hears of the hashes that another part has told too, with the sums of their counts."""
    rows = told.to_pylist()
    hashes = [_unpacked(r["hashes"]) for r in rows]
    keys, number, parts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    sums = np.bincount(number, np.concatenate([np.frombuffer(zlib.decompress(r["counts"]), np.int32) for r in rows]), len(keys)).astype(np.int32)
    pages, opened, out, at = sum(r["pages"] for r in rows), any(r["opened"] for r in rows), [], 0
    for r, own in zip(rows, hashes, strict=True):
        which = number[at : at + len(own)]
        which, at = which[parts[which] > 1], at + len(own)
        out.append((r["host"], r["part"], r["cell"], r["bucket"], r["step"], _packed(keys[which]), zlib.compress(sums[which].tobytes(), 1), pages, opened))
    return _table(out, _TOLD_SCHEMA)


def _heard(rows: list[dict]) -> tuple[Counts, int, bool]:
    """What a part has heard back in one step from all buckets."""
    if not rows:
        return NO_COUNTS, 0, False
    rows = sorted(rows, key=lambda r: r["bucket"])
    counts = np.concatenate([np.frombuffer(zlib.decompress(r["counts"]), np.int32) for r in rows]).astype(np.int64)
    return (np.concatenate([_unpacked(r["hashes"]) for r in rows]), counts), rows[0]["pages"], rows[0]["opened"]


def _tells_stretches(part: _Part, bits: int, heard: dict[int, list[dict]]) -> _Told:
    """The stretches of hashes, by their first ``bits``, that the part's windows use; about thirty for each window of the host."""
    stretches = _distinct(part.hashes()[part.starts] >> np.uint64(64 - bits)) << np.uint64(64 - bits)
    return stretches, np.zeros(len(stretches), np.int32), 0, part.opened


def _tells_windows(part: _Part, bits: int, heard: dict[int, list[dict]]) -> _Told:
    """The windows in stretches that other parts use, and on how many pages they are."""
    (stretches, _), _, opened = _heard(heard[0])
    hashes, owner = part.hashes()[part.starts], part.owner[part.starts]
    used = _looked_up((stretches, np.ones(len(stretches), np.int64)), hashes >> np.uint64(64 - bits) << np.uint64(64 - bits)) > 0
    return *_pages_with(hashes[used], owner[used], part.home), 0, opened


def _tells_counting(part: _Part, bits: int, heard: dict[int, list[dict]]) -> _Told | None:
    """On how many pages that count the windows of several parts are, and the short blocks; nothing if the host leaves no block open."""
    total, _, opened = _heard(heard[1])
    if not opened:
        return None
    hashes, owner = part.hashes(), part.owner
    starts = np.nonzero(part.starts)[0]
    pages = np.maximum(_looked_up(total, hashes[starts]), _looked_up(_pages_with(hashes[starts], owner[starts], part.home), hashes[starts]))
    elsewhere = np.zeros(len(hashes), bool)
    elsewhere[starts] = pages > 1
    counts = part.counted(_spread(elsewhere, part.depth)) & part.home
    often = starts[_looked_up(total, hashes[starts]) >= LEAST_PAGES]
    return *_pages_with(np.concatenate([hashes[often], part.short_hashes()]), np.concatenate([owner[often], part.page_of[part.short]]), counts), int(counts.sum()), True


def _parts(rows: pa.Table, depth: int, least: int) -> Iterator[tuple[str, int, dict, _Part, list[tuple[list, int]]]]:
    """The parts in a table of rows, of hosts with ``least`` parts or more: host, part, one row, the distinct pages, and of each row the
    pages' ids and urls and which page it is."""
    groups = defaultdict(list)
    for i, key in enumerate(zip(*(rows.column(c).to_pylist() for c in ("host", "part", "parts")), strict=True)):
        if key[2] >= least:
            groups[key[:2]].append(i)
    for (host, part), at in groups.items():
        distinct: dict[tuple, int] = {}
        home, of = [], []
        for row in rows.take(at).to_pylist():
            texts = zlib.decompress(row["body"]).decode().split("\n") if row["kinds"] else []
            number = distinct.setdefault(tuple(zip(row["kinds"], texts, strict=True)), len(distinct))
            if number == len(home):
                home.append(row["home"])
            of.append((row["pages"], number))
        yield host, part, row, _Part(list(distinct), home, depth), of


def _telling(step: int, tells: Callable[..., _Told | None], depth: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function of a cell's rows and of what its parts have heard, to what they tell in this step."""

    def told(rows: pa.Table, answers: pa.Table) -> pa.Table:
        heard, out = _by_part(answers), []
        for host, part, row, pages, _ in _parts(rows, depth, 2):
            if said := tells(pages, row["bits"], heard[host, part]):
                hashes, counts, n, opened = said
                buckets = -(-row["parts"] // 8)
                edges = np.searchsorted((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
                for b, (i, j) in enumerate(zip(edges, edges[1:], strict=False)):
                    out.append((host, part, row["cell"], b, step, _packed(hashes[i:j]), zlib.compress(counts[i:j].astype(np.int32).tobytes(), 1), n, opened))
        return _table(out, _TOLD_SCHEMA)

    return told


def _by_part(answers: pa.Table) -> dict[tuple[str, int], dict[int, list[dict]]]:
    heard = defaultdict(lambda: defaultdict(list))
    for r in answers.to_pylist():
        heard[r["host"], r["part"]][r["step"]].append(r)
    return heard


def main_text(df: DataFrame, depth: int = DEPTH, share: float = SHARE, part_pages: int = PART_PAGES, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per row of ``df`` (page_id, url, html): page_id, url, text, n_repeated (its tokens in runs that other pages of the host have), and
    n_removed (tokens of open blocks that were boilerplate)."""
    spark = df.sparkSession
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    pages = df.select(F.col("page_id").cast("long"), "url", "html", host.alias("host"))
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length("html"), F.lit(0))).alias("bytes"))
    sizes = sizes.select("host", "bytes", F.greatest(F.ceil(F.col("n") / part_pages), F.ceil(F.col("bytes") / part_bytes)).cast("int").alias("parts"))
    sizes = written(sizes, "host-sizes")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    bits = F.greatest(F.lit(16), F.ceil(F.log2(F.col("bytes") * 4.0))).cast("int").alias("bits")
    large = sizes.filter("parts > 1").select("host", "parts", bits)
    # Broadcast if there are few such hosts, which is counted first; else joined by sorting.
    n_large = large.count()
    large = F.broadcast(large) if n_large <= BROADCAST_HOSTS else large.hint("merge")
    dealt = pages.join(large, "host", "left").select("host", F.coalesce("parts", F.lit(1)).alias("parts"), F.coalesce("bits", F.lit(16)).alias("bits"), "page_id", "url", "html")
    cells = partitions(spark, total, part_bytes // 4)
    of_pages = pa.list_(pa.struct([("page_id", pa.int64()), ("url", pa.string())]))
    row_schema = pa.schema(
        [("cell", pa.int32()), ("host", pa.string()), ("part", pa.int32()), ("parts", pa.int32()), ("bits", pa.int32()), ("home", pa.bool_()), ("pages", of_pages), ("kinds", pa.binary()), ("body", pa.binary())]
    )

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in (whole.slice(i, 256) for i in range(0, len(whole), 256))):
            equal: dict[tuple, list[dict]] = defaultdict(list)
            for host, parts, bits, page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = parsed_blocks(html)
                equal[host, parts, bits, bytes(k for k, _ in found), "\n".join(t for _, t in found).encode()].append({"page_id": page_id, "url": url})
            out = []
            for (host, parts, bits, kinds, body), rows in equal.items():
                digest = hashlib.blake2b(kinds + b"\n" + body, digest_size=8).digest()
                here, packed = int.from_bytes(digest, "little") % parts, zlib.compress(body, 1)
                groups = {here: rows}
                if parts > 1 and len(rows) >= HOT:
                    there = zlib.crc32(f"{rows[1]}".encode(), here) % parts
                    groups = {here: rows[:1], there: rows[1:]} if there != here else groups
                for part, own in groups.items():
                    out.append((zlib.crc32(f"{part} {host}".encode()) % cells, host, part, parts, bits, part == here, own, kinds, packed))
            yield from _table(out, row_schema).to_batches()

    found_schema = pa.schema([("pages", of_pages), ("text", pa.string()), ("n_repeated", pa.int64()), ("n_removed", pa.int64())])

    def decided(rows: pa.Table, answers: pa.Table | None = None) -> pa.Table:
        heard, out = _by_part(answers) if answers is not None else {}, []
        for host, part, row, distinct, of in _parts(rows, depth, 1):
            others = ()
            if row["parts"] > 1:
                counting, n, _ = _heard(heard[host, part][2])
                others = _heard(heard[host, part][1])[0], counting, n
            found = _decided(distinct, share, *others)
            out += [(own, *found[number]) for own, number in of]
        return _table(out, found_schema)

    structs = "array<struct<page_id: bigint, url: string>>"
    rows = dealt.mapInArrow(parsed, f"cell int, host string, part int, parts int, bits int, home boolean, pages {structs}, kinds binary, body binary")
    rows = rows.repartition(cells, "cell").groupBy("cell")
    result = f"pages {structs}, text string, n_repeated long, n_removed long"
    if n_large:
        # All steps read the same dealt rows, which Spark shuffles once.
        def met(told: DataFrame) -> DataFrame:
            return told.groupBy("host", "bucket").applyInArrow(_met, _TOLD).repartition(cells, "cell")

        none = spark.createDataFrame([], _TOLD)
        stretches = met(rows.cogroup(none.groupBy("cell")).applyInArrow(_telling(0, _tells_stretches, depth), _TOLD))
        windows = met(rows.cogroup(stretches.groupBy("cell")).applyInArrow(_telling(1, _tells_windows, depth), _TOLD))
        counting = met(rows.cogroup(windows.groupBy("cell")).applyInArrow(_telling(2, _tells_counting, depth), _TOLD))
        found = rows.cogroup(windows.union(counting).groupBy("cell")).applyInArrow(decided, result)
    else:
        found = rows.applyInArrow(lambda rows: decided(rows), result)
    return found.select(F.inline("pages"), "text", "n_repeated", "n_removed")


def op3_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: page_id, url, text, n_chars, n_repeated, n_removed."""
    found = main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_repeated", "n_removed")
