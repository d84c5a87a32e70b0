"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a stream of tags and text slots. Streams of one host are aligned one by one: what one side lacks becomes
optional, a block that follows itself becomes a repeated group. The resulting expression is the host's wrapper. Every page
is matched against it, and what a slot holds over all pages (the same text or others, links or words) tells whether it is
article text; pages are then read slot by slot. Wrappers and slots are folded within each task first, so a host of any size
sends one partial row per task.
"""

from __future__ import annotations

import functools
import hashlib
import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.tables import written

#: Hosts whose wrappers a task folds before it hands them on.
HOSTS_PER_FOLD = 2000

#: Different pages on which a slot must hold the same text to count as the host's own.
CONSTANT_PAGES = 3
#: Wrappers that a worker keeps ready, and steps kept for each; then it starts anew.
MATCHERS, STEPS = 500, 50_000

#: Fixed values of the markup language: parts that are no text, marks within a line, leaves of a page, holders of leaves.
SILENT = "script style noscript template svg math iframe object canvas textarea title select option button audio video map".split()
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input source track area".split())
LEAVES = set("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption caption address summary hr".split())
VOID = set("br img input hr wbr source track area meta link base col embed param".split())
#: Holders that never belong to an article, and words in a holder's class, id or role that say the same.
OUTSIDE_TAGS = set("head nav footer aside form dialog menu fieldset".split())
OUTSIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup login sidebar "
    "menu nav navbar navigation breadcrumb breadcrumbs footer header masthead toolbar comment comments respond replies disqus related recommended share sharing social widget pagination pager skip search".split()
)
#: Words that may stand beside those in one class token (site-footer, comment-list) and say nothing themselves.
PLACE_WORDS = set("site page main top bottom left right primary secondary inner outer global list area box bar block section wrap wrapper container holder link links item items form".split())
MAIN_TAGS = ("article", "main")
#: Holders whose names are never asked.
FRAME_TAGS = {"html", "body", *MAIN_TAGS}

#: What stands between a tag's name and its end; the name is whole there, so a custom element such as video-player is no video.
_ATTRS = r"(?>[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?:svg|math)(?=[\s/]){_ATTRS}(?<=/)>"
    rf"|<(?P<silent>{'|'.join(SILENT)})(?=[\s/>]){_ATTRS}>.*?(?:</(?P=silent)\s*>|\Z)"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>{_ATTRS})>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
_APART = re.compile(r"[\s,=\]]+")

SLOT = "#"


@functools.lru_cache(1 << 16)
def _name(tag: str, attrs: str) -> str:
    """The tag with its class, id and role, if any; numbers in them, which count pages or parts, are all 0."""
    if "=" not in attrs:
        return tag
    found = sorted(f"{k.lower()}={' '.join((a or b or c).split())}" for k, a, b, c in _NAMED.findall(attrs))
    return f"{tag}[{_DIGITS.sub('0', ','.join(found))}]" if found else tag


@functools.lru_cache(1 << 16)
def _named_outside(name: str) -> bool:
    """Whether a whole token of the holder's class, id or role says that it is outside; ``has-sidebar`` and the like do not."""
    tag, _, named = name.partition("[")
    if not named or tag in FRAME_TAGS:
        return False
    tokens = (set(_WORD.findall(x)) for x in _APART.split(named.lower()))
    return any(x & OUTSIDE_WORDS and x <= OUTSIDE_WORDS | PLACE_WORDS for x in tokens)


@functools.lru_cache(1 << 14)
def outside_at(holders: tuple[str, ...]) -> tuple[tuple[int, ...], int | None]:
    """(holders that are outside by their names, first article or main), as places in ``holders``.

    A form may hold a whole page, so above an article it is not outside; an article's header holds its title.
    """
    own = next((k for k, h in enumerate(holders) if h.partition("[")[0] in MAIN_TAGS), None)
    out = []
    for k, h in enumerate(holders):
        tag = h.partition("[")[0]
        framing = own is not None and (tag in ("form", "fieldset") if k < own else tag == "header")
        if ((tag in OUTSIDE_TAGS or tag == "header") and not framing) or _named_outside(h):
            out.append(k)
    return tuple(out), own


def blocks(page: str) -> Iterator[tuple[tuple[str, ...], str, str, int]]:
    """(holders from the root, leaf, text, characters of it in links) of every text block in page order; text is decoded and tidy.

    A holder that is closed closes those inside it; a closing tag without its opening one only ends a block.
    """
    stack: list[str] = []
    leaf, parts, linked, links = "", [], 0, 0

    def flush() -> Iterator[tuple[tuple[str, ...], str, str, int]]:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                yield tuple(stack), leaf, text, linked
        parts, linked = [], 0

    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            parts.append(text)
            linked += len(text) if links else 0
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(m["close"])
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                links = 0 if closing else 1
            continue
        yield from flush()
        if tag in LEAVES:
            leaf = "" if closing else tag
            links = 0
            continue
        if tag in VOID:
            continue
        leaf, links = "", 0
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].partition("[")[0] == tag:
                    del stack[k:]
                    break
        else:
            stack.append(_name(tag, m["attrs"]))
    yield from flush()


# --- expressions: a list of items; an item is a tag or slot (str), or [mark, list] with mark "?" (optional) or "+" (repeated)
def _core(item) -> str:
    """Items with equal cores can be one: a block and the group that repeats it have the same."""
    while isinstance(item, list) and len(item[1]) == 1:
        item = item[1][0]
    return item if isinstance(item, str) else "(" + " ".join(_core(x) for x in item[1]) + ")"


def folded(items: list, longest: int = 12) -> list:
    """Adjacent equal blocks, of up to ``longest`` items, become one repeated group; shortest blocks first."""
    for size in range(1, longest + 1):
        cores = [_core(x) for x in items]
        out, k = [], 0
        while k < len(items):
            reps = 1
            while k + (reps + 1) * size <= len(items) and cores[k : k + size] == cores[k + reps * size : k + (reps + 1) * size]:
                reps += 1
            if reps > 1 and not (size == 1 and isinstance(items[k], str) and items[k].startswith("/")):
                block = items[k] if size == 1 else None
                out.append(block if isinstance(block, list) and block[0] == "+" else ["+", items[k : k + size]])
                k += reps * size
            else:
                out.append(items[k])
                k += 1
        items = out
    return items


def stream(page_blocks: list[tuple[tuple[str, ...], str, str, int]]) -> tuple[list[str], list[int]]:
    """A page's items, holders open and close, leaves with their slot between; and the place of each block's slot in them."""
    items: list[str] = []
    slots: list[int] = []
    now: tuple[str, ...] = ()
    for holders, leaf, _, _ in page_blocks:
        same = 0
        while same < min(len(now), len(holders)) and now[same] == holders[same]:
            same += 1
        items += [f"/{x}" for x in reversed(now[same:])] + list(holders[same:])
        slots.append(len(items))
        items.append(f"{leaf}{SLOT}")
        now = holders
    return items + [f"/{x}" for x in reversed(now)], slots


def shape(page_blocks: list[tuple[tuple[str, ...], str, str, int]]) -> list:
    """The expression of one page."""
    return folded(stream(page_blocks)[0])


def _optional(items: list) -> list:
    return [x if isinstance(x, list) and x[0] == "?" else ["?", [x]] for x in items]


def _one(a, b):
    """Two items with equal cores as one: repeated if either is, optional if either is."""
    marks = {x[0] for x in (a, b) if isinstance(x, list)}
    inner_a, inner_b = (x[1] if isinstance(x, list) else [x] for x in (a, b))
    while len(inner_a) == 1 and isinstance(inner_a[0], list):
        marks.add(inner_a[0][0])
        inner_a = inner_a[0][1]
    while len(inner_b) == 1 and isinstance(inner_b[0], list):
        marks.add(inner_b[0][0])
        inner_b = inner_b[0][1]
    inner = inner_a if inner_a == inner_b else aligned(inner_a, inner_b)
    out = inner[0] if len(inner) == 1 and not marks else None
    for mark in ("+", "?"):
        if mark in marks:
            out = [mark, inner if out is None else [out]]
    return out if out is not None else ["+", inner]


def aligned(a: list, b: list) -> list:
    """The expression of both: longest common sequence of cores, the rest optional."""
    if a == b:
        return a
    ca, cb = [_core(x) for x in a], [_core(x) for x in b]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if ca[i] == cb[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if ca[i] == cb[j]:
            out.append(_one(a[i], b[j]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out += _optional([a[i]])
            i += 1
        else:
            out += _optional([b[j]])
            j += 1
    return folded(out + _optional(a[i:]) + _optional(b[j:]))


def to_text(items: list) -> str:
    return " ".join(x if isinstance(x, str) else f"({to_text(x[1])}){x[0]}" for x in items)


def host_of(url: Column) -> Column:
    """Lower-case host of an address, without port and user; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _bits(places: int) -> Iterator[int]:
    while places:
        low = places & -places
        yield low.bit_length() - 1
        places ^= low


class Matcher:
    """A wrapper as an automaton over its places, to tell which place each item of a page is. Sets of places are bits."""

    def __init__(self, items: list):
        self.names: list[str] = []
        self.follow: list[int] = []
        self.first, _, _ = self._built(items)
        self.named: dict[str, int] = {}
        self.before = [0] * len(self.names)
        for p, name in enumerate(self.names):
            self.named[name] = self.named.get(name, 0) | 1 << p
            for q in _bits(self.follow[p]):
                self.before[q] |= 1 << p
        self.steps: dict[tuple[int, str], int] = {}

    def _built(self, items: list) -> tuple[int, int, bool]:
        """(first places, last places, may be empty)"""
        first, last, empty = 0, 0, True
        for x in items:
            if isinstance(x, str):
                own = end = 1 << len(self.names)
                void = False
                self.names.append(x)
                self.follow.append(0)
            else:
                own, end, void = self._built(x[1])
                if x[0] == "+":
                    for p in _bits(end):
                        self.follow[p] |= own
                else:
                    void = True
            for p in _bits(last):
                self.follow[p] |= own
            first = first | own if empty else first
            last = last | end if void else end
            empty = empty and void
        return first, last, empty

    def places(self, items: list[str]) -> list[int]:
        """The place of each item: of all ways through the wrapper the one with the earliest places, from the end; -1 for
        an item that the wrapper lacks. Where no way goes on, any place of the item's name may follow."""
        states, state = [], -1
        for name in items:
            after = self.steps.get((state, name))
            if after is None:
                reach = self.first if state < 0 else 0
                for p in _bits(max(state, 0)):
                    reach |= self.follow[p]
                after = reach & self.named.get(name, 0) or self.named.get(name, 0)
                if len(self.steps) >= STEPS:
                    self.steps.clear()
                self.steps[state, name] = after
            states.append(after)
            state = after
        out, later = [], -1
        for state in reversed(states):
            can = (state & self.before[later] if later >= 0 else 0) or state
            later = (can & -can).bit_length() - 1
            out.append(later)
        return out[::-1]


@functools.lru_cache(MATCHERS)
def _matcher(items: str) -> Matcher:
    return Matcher(json.loads(items))


def _digest(texts: list[str]) -> str:
    return hashlib.blake2b("\n".join(texts).encode("utf-8", "replace"), digest_size=8).hexdigest()


class Slots:
    """What the places of a host's wrapper hold over its pages; sums of this kind can be merged."""

    def __init__(self) -> None:
        #: place: [characters, those in links, those in no outside holder, least and greatest digest of a page's text, first digests of pages, name]
        self.held: dict[str, list] = {}
        #: outside holder's path: place: characters that are not in links
        self.under: dict[str, dict[str, int]] = {}

    def add(self, matcher: Matcher, page_blocks: list) -> None:
        items, at = stream(page_blocks)
        places = matcher.places(items)
        texts: dict[str, list[str]] = {}
        whole = _digest([b[2] for b in page_blocks])
        for (holders, _, text, links), k in zip(page_blocks, at):
            place = str(places[k])
            out, _ = outside_at(holders)
            texts.setdefault(place, []).append(text)
            have = self.held.setdefault(place, [0, 0, 0, "~", "", [whole], items[k]])
            have[0] += len(text)
            have[1] += links
            have[2] += 0 if out else len(text)
            for o in out:
                under = self.under.setdefault(json.dumps(holders[: o + 1]), {})
                under[place] = under.get(place, 0) + max(0, len(text) - links)
        for place, own in texts.items():
            digest, have = _digest(own), self.held[place]
            have[3], have[4] = min(have[3], digest), max(have[4], digest)
            if whole not in have[5] and (len(have[5]) < CONSTANT_PAGES or whole < have[5][-1]):
                have[5] = sorted([*have[5], whole])[:CONSTANT_PAGES]

    def merge(self, held: dict[str, list], under: dict[str, dict[str, int]]) -> None:
        for place, (chars, links, inside, lo, hi, pages, name) in held.items():
            have = self.held.setdefault(place, [0, 0, 0, "~", "", [], name])
            self.held[place] = [have[0] + chars, have[1] + links, have[2] + inside, min(have[3], lo), max(have[4], hi), sorted({*have[5], *pages})[:CONSTANT_PAGES], name]
        for path, more in under.items():
            sums = self.under.setdefault(path, {})
            for place, n in more.items():
                sums[place] = sums.get(place, 0) + n

    def verdict(self) -> dict:
        """``constant``: places with one text on all pages, unless most of the text is so, as on copies of one page;
        ``links``: places of links; ``inside``: outside holders that hold a page's title or over half of the host's text, and so are not."""
        held = self.held
        constant = {p for p, h in held.items() if len(h[5]) >= CONSTANT_PAGES and h[3] == h[4]}
        varied = sum(h[0] - min(h[0], h[1]) for p, h in held.items() if p not in constant)
        if sum(held[p][2] for p in constant) > sum(h[2] for p, h in held.items() if p not in constant):
            constant_text: set[str] = set()
        else:
            constant_text = constant
        links = {p for p, h in held.items() if 2 * h[1] > h[0] and h[6] != f"h1{SLOT}"}
        inside = []
        for path, sums in self.under.items():
            title = any(held[p][6] == f"h1{SLOT}" and held[p][3] != held[p][4] and n for p, n in sums.items())
            if title or 2 * sum(n for p, n in sums.items() if p not in constant) > varied:
                inside.append(path)
        return {"constant": sorted(map(int, constant_text)), "links": sorted(map(int, links)), "inside": sorted(inside)}


def infer(pages: DataFrame, url_col: str = "url", body_col: str = "html") -> DataFrame:
    """``(host, wrapper, items)``: the host's expression as text and as nested lists, from all its pages."""
    fields = "host string, items string"

    def merge(into: dict, host: str, items: list) -> None:
        old = into.setdefault(host, items)
        into[host] = old if old == items else aligned(old, items)

    def rows(folds: dict) -> pa.RecordBatch:
        found = sorted(folds.items())
        return pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.string()), pa.array([json.dumps(i) for _, i in found], pa.string())], names=["host", "items"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds: dict = {}
        seen: dict[str, set[str]] = {}
        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("body").to_pylist()):
                items = shape(list(blocks(page)))
                known = seen.setdefault(host, set())
                name = json.dumps(items)
                if name not in known:  # a shape already folded in adds nothing
                    merge(folds, host, items)
                    known.add(name)
                if len(folds) >= HOSTS_PER_FOLD:
                    yield rows(folds)
                    folds, seen = {}, {}
        if folds:
            yield rows(folds)

    def across(key: tuple, group: pa.Table) -> pa.Table:
        folds: dict = {}
        for items in sorted(group.column("items").to_pylist()):
            merge(folds, "", json.loads(items))
        items = folds[""]
        return pa.table({"host": [key[0].as_py()], "wrapper": [to_text(items)], "items": [json.dumps(items)]}, schema=pa.schema([(n, pa.string()) for n in ("host", "wrapper", "items")]))

    rows_in = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(body_col).cast("string"), F.lit("")).alias("body"))
    return rows_in.mapInArrow(within, fields).groupBy("host").applyInArrow(across, "host string, wrapper string, items string")


def judged(rows: DataFrame, wrappers: DataFrame) -> DataFrame:
    """``(host, items, verdict)`` of every wrapper ``(host, items)``, from the pages ``(host, body)`` matched against it."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds: dict[str, Slots] = {}

        def folded_rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(folds), pa.string()), pa.array([json.dumps([x.held, x.under]) for x in folds.values()], pa.string())], names=["host", "slots"])

        for batch in batches:
            for host, page, items in zip(batch.column("host").to_pylist(), batch.column("body").to_pylist(), batch.column("items").to_pylist()):
                folds.setdefault(host, Slots()).add(_matcher(items), list(blocks(page)))
                if len(folds) >= HOSTS_PER_FOLD:
                    yield folded_rows()
                    folds.clear()
        if folds:
            yield folded_rows()

    def across(key: tuple, group: pa.Table) -> pa.Table:
        slots = Slots()
        for x in group.column("slots").to_pylist():
            slots.merge(*json.loads(x))
        return pa.table({"host": [key[0].as_py()], "verdict": [json.dumps(slots.verdict())]}, schema=pa.schema([("host", pa.string()), ("verdict", pa.string())]))

    slots = rows.join(wrappers, "host").select("host", "body", "items").mapInArrow(within, "host string, slots string")
    return wrappers.join(slots.groupBy("host").applyInArrow(across, "host string, verdict string"), "host")


@functools.lru_cache(MATCHERS)
def _verdict(verdict: str) -> tuple[frozenset[int], frozenset[int], frozenset[tuple[str, ...]]]:
    found = json.loads(verdict)
    return frozenset(found["constant"]), frozenset(found["links"]), frozenset(tuple(json.loads(p)) for p in found["inside"])


def article(page: str, items: str, verdict: str) -> str:
    """The page's text by its wrapper's slots: those in articles or mains, else those that are not links; nothing outside, no constants.

    A page with no such text has its articles' constants, else all that is not outside, else articles of outside holders.
    """
    matcher = _matcher(items)
    constant, linked, overruled = _verdict(verdict)
    own_blocks = list(blocks(page))
    names, at = stream(own_blocks)
    places = matcher.places(names)
    found: list[list[str]] = [[], [], [], [], []]
    for (holders, _, text, _), k in zip(own_blocks, at):
        place = places[k]
        out, own = outside_at(holders)
        still = [o for o in out if holders[: o + 1] not in overruled]
        if not still:
            # an article in an overruled holder may be one of many comments: it does not shut out the rest of the page
            if own is not None and not any(o < own for o in out):
                found[1].append(text)
                if place not in constant:
                    found[0].append(text)
            if place not in constant and (place not in linked or own is not None):
                found[2].append(text)
            found[3].append(text)
        elif own is not None and all(o < own for o in still):
            found[4].append(text)
    return "\n".join(next((x for x in found if x), []))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """``(id_col, url_col, text, n_chars)`` per row: the main text by the wrapper of the page's host.

    A null or empty body has the empty text. Addresses without a host share a wrapper. Ids may repeat or be null; other
    columns are ignored. The table of wrappers has a row per host; Spark broadcasts it or not by its measured size.
    """
    rows = pages.select(F.col(id_col).alias("key"), F.col(url_col).alias("address"), F.coalesce(F.col(body_col).cast("string"), F.lit("")).alias("body"), host_of(F.col(url_col)).alias("host"))
    inferred = written(infer(pages, url_col, body_col).select("host", "items"), "wrappers")
    wrappers = written(judged(rows.select("host", "body"), inferred), "wrappers")
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [article(page, items, verdict) for page, items, verdict in zip(*(batch.column(c).to_pylist() for c in ("body", "items", "verdict")))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("address"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return rows.join(wrappers, "host").select("key", "address", "body", "items", "verdict").mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars bigint")
