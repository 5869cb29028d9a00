"""Main text of web pages: a union-free expression inferred for each host, then template evidence across hosts.

A page is a stream of line tokens (markup stripped, case, digits and outer marks normalised, the page's own
address part at the end of a trail replaced by a slot). A host's pages are aligned, two expressions at a time
(longest common run in order), and every mismatch widens the expression: an element one side lacks becomes
optional, a repeated run of elements a group, differing texts between two aligned elements a text slot. A token
met at another place is another optional element there. Elements that too few pages confirm fall back into the
slot around them. Then every page is read by its host's expression: a line aligned with an element has that
element's support, a line that falls into a slot has none but its own page's, even if an equal line is an
element elsewhere. Support decides, by one rule for hosts of every size: with ``c`` of the host's ``n`` pages
carrying the line's element, and ``t`` the mean share of pages that carry lines of its template on other hosts,

    own = (c - 1) / (n - 1 + PRIOR),    estimate = 1 - (1 - own) * (1 - t)

so a host of one page rests on the other hosts, a large one mostly on itself. Lines at ``FRAME`` or above are frame.

Scale: alignment is a tree over the bits of the address hash, so it is fixed by the set of pages, not by how
they are cut: a block of a host is a subtree, its pages stream through a stack of at most 64 expressions, each
held to 16 times a page's mean length. Large hosts are cut by leading bits into blocks (``BLOCK`` pages, or
1/20000 of all, whichever is more: the list of cut hosts, the one thing broadcast, has at most 20000 rows) and
their expressions combined level by level, ``FAN`` a task. Pages are held in memory up to ``HOLD`` characters;
beyond it, and for cut hosts, they are read again and parsed by the finished expression.

Defined results: NULL or empty text gives no lines; repeated deliveries of an address count as one page;
pages without a site are grouped by their address's; texts and lines of any length are read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.functions.urls import root_domain
from orgweave.llm.residue import weighed
from orgweave.operators.skew import spread_join
from orgweave.shipping import ship
from orgweave.staging import stage

#: Pages of a block, expressions combined in a task (a power of two), characters of text held for parsing.
BLOCK, FAN_BITS, HOLD = 512, 6, 1 << 23
MAX_SPLIT_SITES = 20000
#: Bytes of expressions, as rows in memory, that are sent to every executor; more are joined to their pages.
SENT = 1 << 22
#: An element needs this share of the pages (two at least); one below 1/KEEP of KEEP * 2 pages or more is let go.
CONFIRM, KEEP = 0.1, 16
#: Occurrences of one token on a page that are aligned; more make one repeated element of them all.
PLACES = 4
#: Pages by which a host's own shares are shrunk, and the estimate that makes a line frame.
PRIOR, FRAME = 4, 0.35
#: Hosts of a template needed to believe it; pages up to which a host's word weighs more.
FINE_SITES, COARSE_SITES, VOICE = 2, 3, 16

_TAG = re.compile(r"</?[a-z!][^>]*>")
_NUM = re.compile(r"\d[\d.,:]*")
_MASK = re.compile(r"(?<![\w.,])[A-ZÀ-ÖØ-Þ][\w'’]*|[$€£]?\d[\w.,:]*")
_OPEN = re.compile(r"^<(main|article|section|div)\b[^>]*>$")
_FRAME_TAG = re.compile(r"^<(?:nav|footer|header|aside|html|head|title|form)\b")
#: Separators of menus and trails; such a line is judged by the first of its parts.
_TRAIL = re.compile(r"\s+[>|·»/]\s+|\t+| {2,}")
_EDGE = " \t*-–—•·|>#:.!,;\"'“”"


class Wrapper:
    """A union-free expression: its elements in order and the pages that carry each. One carried by all is fixed,
    the others are optional; a repeated run is one element; text slots are what lies between."""

    __slots__ = ("pages", "support", "tokens")

    def __init__(self, tokens: list[str], support: list[int], pages: int) -> None:
        self.tokens, self.support, self.pages = tokens, support, pages

    @classmethod
    def of_page(cls, elements: list[str]) -> Wrapper:
        return cls(elements, [1] * len(elements), 1)

    def confirmed(self) -> Wrapper:
        """The elements that enough pages carry; the others are text of the slots."""
        least = max(2, CONFIRM * self.pages)
        return self._only([s >= least for s in self.support])

    def _only(self, keep: list[bool]) -> Wrapper:
        pick = lambda xs: [x for x, k in zip(xs, keep) if k]
        return Wrapper(pick(self.tokens), pick(self.support), self.pages)


def squares(tokens: list[str]) -> tuple[list[str], Sequence[int]]:
    """(elements, element of each token): runs of one to three tokens that repeat at once are one group,
    and a token at more than PLACES places is one repeated element."""
    if len(set(tokens)) == len(tokens):
        return tokens, range(len(tokens))
    kept: list[str] = []
    at: list[int] = []
    places: dict[str, list[int]] = {}
    i, n = 0, len(tokens)
    while i < n:
        for p in (1, 2, 3):
            if p <= len(kept) and tokens[i] == kept[-p] and tokens[i : i + p] == kept[-p:]:
                for k in range(p):
                    at.append(len(kept) - p + k)
                i += p
                break
        else:
            t = tokens[i]
            mine = places.setdefault(t, [])
            if len(mine) == PLACES:
                at.append(mine[0])
            else:
                mine.append(len(kept))
                at.append(len(kept))
                kept.append(t)
            i += 1
    return kept, at


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Longest run of equal tokens in the order of both: increasing pairs of places."""
    lo, ha, hb = 0, len(a), len(b)
    short = min(ha, hb)
    while lo < short and a[lo] == b[lo]:
        lo += 1
    while ha > lo and hb > lo and a[ha - 1] == b[hb - 1]:
        ha, hb = ha - 1, hb - 1
    out = [(i, i) for i in range(lo)]
    if ha > lo and hb > lo:
        places: dict[str, list[int]] = {}
        for i in range(ha - 1, lo - 1, -1):
            places.setdefault(a[i], []).append(i)
        tails: list[int] = []
        ends: list[tuple] = []
        for j in range(lo, hb):
            for i in places.get(b[j], ()):
                k = bisect_left(tails, i)
                node = (i, j, ends[k - 1] if k else None)
                if k == len(tails):
                    tails.append(i)
                    ends.append(node)
                elif i < tails[k]:
                    tails[k], ends[k] = i, node
        run, node = [], ends[-1] if ends else None
        while node:
            run.append(node[:2])
            node = node[2]
        out += reversed(run)
    return out + [(ha + k, hb + k) for k in range(len(a) - ha)]


def merge(a: Wrapper, b: Wrapper, same: bool = False) -> Wrapper:
    """The expression of both sides' pages. ``same``: both are deliveries of one page."""
    tokens: list[str] = []
    support: list[int] = []
    i = j = 0
    for x, y in [*align(a.tokens, b.tokens), (len(a.tokens), len(b.tokens))]:
        if i < x:
            tokens += a.tokens[i:x]
            support += a.support[i:x]
        if j < y:
            tokens += b.tokens[j:y]
            support += b.support[j:y]
        if x < len(a.tokens):
            tokens.append(a.tokens[x])
            support.append(max(a.support[x], b.support[y]) if same else a.support[x] + b.support[y])
        i, j = x + 1, y + 1
    w = Wrapper(tokens, support, a.pages if same else a.pages + b.pages)
    if w.pages >= 2 * KEEP and min(support, default=w.pages) * KEEP < w.pages:
        w = w._only([s * KEEP >= w.pages for s in support])
    return w


class Tree:
    """Merges expressions that come in order of their hashes, as the tree over the hashes' bits does."""

    def __init__(self) -> None:
        self.waiting: list[tuple[Wrapper, int]] = []
        self.last: Wrapper | None = None
        self.hash = 0

    def add(self, h: int, w: Wrapper) -> None:
        if self.last is not None:
            shared = 64 - ((h ^ self.hash) & 0xFFFFFFFFFFFFFFFF).bit_length()
            cur = self._close(shared)
            self.waiting.append((cur, shared))
        self.last, self.hash = w, h

    def _close(self, shared: int) -> Wrapper:
        cur = self.last
        while self.waiting and self.waiting[-1][1] > shared:
            cur = merge(self.waiting.pop()[0], cur)
        return cur

    def done(self) -> Wrapper:
        return self._close(-1)


def infer(pages: Iterable[tuple[int, list[str]]]) -> Wrapper:
    """The expression of (address hash, tokens), in order of the hashes, equal hashes being one page."""
    tree, h, page = Tree(), None, None
    for k, tokens in pages:
        w = Wrapper.of_page(squares(tokens)[0])
        if k == h:
            page = merge(page, w, same=True)
        else:
            if page is not None:
                tree.add(h, page)
            h, page = k, w
    if page is not None:
        tree.add(h, page)
    return tree.done() if tree.last is not None else Wrapper([], [], 0)


class Reader:
    """Reads pages by an expression."""

    def __init__(self, w: Wrapper) -> None:
        self.w, self.pages = w.confirmed(), max(w.pages, 1)
        total: dict[str, int] = {}
        for t, s in zip(self.w.tokens, self.w.support):
            total[t] = total.get(t, 0) + s
        self.total = {t: min(s, self.pages) for t, s in total.items()}

    def supports(self, kept: list[str], at: Sequence[int]) -> list[int]:
        """For each line the pages that carry its element; 1 for lines of the slots. ``kept`` and ``at`` are the page's
        elements and the element of each line."""
        own = [1] * len(kept)
        placed = set()
        for _, j in align(self.w.tokens, kept):
            own[j] = self.total[kept[j]]
            placed.add(kept[j])
        if len(placed) < len(kept):  # an element that isn't in its place may have moved
            for j, t in enumerate(kept):
                if t in self.total and t not in placed:
                    own[j] = self.total[t]
                    placed.add(t)
        return [own[k] for k in at]


def line_text(line: str) -> str:
    """The line without markup and outer blanks."""
    return (_TAG.sub(" ", line) if "<" in line else line).strip()


def _key(kind: str, text: str) -> int:
    return int.from_bytes(blake2b(f"{kind}{text}".encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def templates(text: str) -> tuple[int, int]:
    """Keys of the masked line (numbers and capitalised words N), and of its label or first words among lines of about
    its length."""
    first, _, rest = text.partition(" ")
    masked = _MASK.sub("N", rest)
    if first[:1].isupper() and rest[:1].isupper() or first[:1].isdigit():
        first = "N"  # else a capital only begins the sentence
    masked = f"{first} {masked}".replace("N and N", "N").replace("N & N", "N").replace("N N N", "N").replace("N N", "N")
    words = masked.split(" ", 3)
    head = next((k for k, x in enumerate(words[:3], 1) if x[-1:] == ":"), 3)  # a label, or three words
    long = max((masked.count(" ") + 1).bit_length(), 4)
    return _key("f", masked), _key(f"c{long} ", " ".join(words[:head]))


def _trail(text: str) -> str | None:
    """First part of a menu or trail on one line: at least two short parts, no sentence."""
    if len(text) > 160:
        return None
    parts = _TRAIL.split(text)
    if len(parts) < 2 or any(len(p) > 40 or p[-1:] in ".!?" for p in parts):
        return None
    return parts[0]


def read_lines(url: str, text: str) -> tuple[list[tuple[int, str, bool, bool]], list[str]]:
    """((line_no, text, in a frame's tag, in an open container) of lines with text, their tokens)."""
    tail = (url or "").rstrip("/").rpartition("/")[2]
    lines, tokens, inside, framed = [], [], False, False
    for no, raw in enumerate(text.split("\n"), 1):
        s = raw.strip()
        if not s:
            continue
        frame = False
        if s[0] == "<":
            if _OPEN.match(s):
                inside = framed = True
                continue
            if s.startswith("</"):
                inside = False
            frame = bool(_FRAME_TAG.match(s))
        t = line_text(s)
        if not t:
            continue
        # a trail ends in the page's own address part: a text slot of the wrapper
        token = t[: -len(tail)] if len(tail) > 2 and t.endswith(tail) and _trail(t) else t
        token = _NUM.sub("#", token).lower().strip(_EDGE) or token
        tokens.append(token)
        lines.append((no, t, frame, inside if framed else True))
    if not framed:  # no container anywhere: position says nothing
        return [(no, t, frame, True) for no, t, frame, _ in lines], tokens
    return lines, tokens


_ARROW = pa.schema(
    [("site", pa.string()), ("block", pa.int64()), ("hash", pa.int64()), ("page_id", pa.int64()), ("line_no", pa.int32()), ("framed", pa.bool_()), ("size", pa.int32()),
     ("weight", pa.int32()), ("kind", pa.int32()), ("c", pa.int64()), ("n", pa.int64()), ("lean", pa.int32()), ("fine", pa.int64()), ("coarse", pa.int64()),
     ("share", pa.float64()), ("tokens", pa.list_(pa.string())), ("support", pa.list_(pa.int64()))]
)
_SCHEMA = (
    "site string, block bigint, hash bigint, page_id bigint, line_no int, framed boolean, size int, weight int, kind int, c bigint, n bigint, lean int, "
    "fine bigint, coarse bigint, share double, tokens array<string>, support array<bigint>"
)


class _Out:
    """Rows of the result, given out in batches."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def expression(self, site: str, block: int, first: int, w: Wrapper) -> None:
        self.rows.append((site, block, first, *[None] * 7, w.pages, *[None] * 4, w.tokens, w.support))

    def batch(self, least: int) -> Iterator[pa.RecordBatch]:
        if self.rows and len(self.rows) >= least:
            cols = list(zip(*self.rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)
            self.rows = []


class _Site:
    """Parses the pages of one host, and adds up what its lines say of their templates."""

    def __init__(self, site: str, w: Wrapper, out: _Out) -> None:
        self.site, self.reader, self.out = site, Reader(w), out
        self.n = self.reader.pages
        self.keys: dict[str, tuple[int, int]] = {}
        self.kinds: dict[str, tuple[int, int, int]] = {}
        self.trails: dict[str, str | None] = {}
        self.said: dict[int, list[float]] = {}

    def page(self, page_id: int, lines: list, tokens: list[str], kept: list[str], at: Sequence[int]) -> None:
        n, rows, kinds, trails = self.n, self.out.rows, self.kinds, self.trails
        before = ""
        for (no, t, frame, inside), token, c in zip(lines, tokens, self.reader.supports(kept, at)):
            known = kinds.get(t)
            if known is None:
                known = kinds[t] = weighed(t)
            kind, size, weight = known
            if kind and before:  # a wrapped line is read on from the one before it
                kind, size, weight = weighed(t, before)
            before = t if len(t) > 50 and t[-1] not in ".!?…:" else ""
            lead = trails[t] if t in trails else trails.setdefault(t, _trail(t))
            key = t if lead is None else lead
            got = self.keys.get(key)
            if got is None:
                fine, coarse = templates(key)
                got = self.keys[key] = (fine, coarse if lead is None else fine)
            share = 0.0
            if n > 1:
                share = (c - 1) / (n - 1)
                for h in got if lead is None else got[:1]:
                    s = self.said.get(h)
                    if s is None:
                        self.said[h] = [share, 1]
                    else:
                        s[0] += share
                        s[1] += 1
            framed = None
            if frame or (no == 1 and t[:5] == "<html") or (c - 1) / (n - 1 + PRIOR) >= FRAME:
                if not kind:
                    continue
                framed = True
            lean = 1 if lead is not None or not inside or (c > 1 and share >= FRAME) else 0
            # the columns of _ARROW
            rows.append(
                (None, None, _key(self.site, token) if kind else None, page_id, no, framed, size, weight, kind, c, n, lean, got[0], got[1], None, None, None)
            )

    def close(self, cut: bool) -> None:
        """What the host says of templates: the share of pages that carry a line of each, by line."""
        for h, (s, k) in self.said.items():
            self.out.rows.append((self.site if cut else None, *[None] * 8, k, self.n, None, h, None, s, None, None))


def _infer(hold: int):
    """Blocks arrive as runs of equal (site, block), in order of the hashes. Whole hosts are parsed at once; the
    expressions of blocks, and of hosts longer than ``hold`` characters, are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out()
        key, tree = None, None
        held: list[tuple] | None = []
        size = 0
        last: tuple[int, Wrapper] | None = None
        first = 0

        def finish() -> None:
            tree.add(*last)
            w = tree.done()
            site, block, whole = key
            if whole and held is not None:
                one = _Site(site, w, out)
                for page in held:
                    one.page(*page)
                one.close(False)
            else:
                out.expression(site, block, first, w)

        for b in batches:
            for site, block, whole, h, page_id, url, text in zip(*(b.column(i).to_pylist() for i in range(7))):
                if (site, block, whole) != key:
                    if key is not None:
                        finish()
                        yield from out.batch(20000)
                    key, tree, held, size, last, first = (site, block, whole), Tree(), [], 0, None, h
                lines, tokens = read_lines(url, text)
                kept, at = squares(tokens)
                w = Wrapper.of_page(kept)
                if last is None:
                    last = (h, w)
                elif last[0] == h:
                    last = (h, merge(last[1], w, same=True))
                else:
                    tree.add(*last)
                    last = (h, w)
                size += len(text)
                if held is not None and whole and size <= hold:
                    held.append((page_id, lines, tokens, kept, at))
                else:
                    held = None
        if key is not None:
            finish()
        yield from out.batch(1)

    return run


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Expressions (site, block, hash, n, tokens, support) of neighbouring blocks into one."""
    out, key, tree, first = _Out(), None, None, 0

    def finish() -> None:
        w = tree.done()
        out.expression(key[0], key[1], first, w)

    for b in batches:
        for site, block, h, n, tokens, support in zip(*(b.column(i).to_pylist() for i in range(6))):
            if (site, block) != key:
                if key is not None:
                    finish()
                    yield from out.batch(200)
                key, tree, first = (site, block), Tree(), h
            tree.add(h, Wrapper(tokens, support, n))
    if key is not None:
        finish()
    yield from out.batch(1)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages (site, page_id, url, text) beside their host's expression (n, tokens, support)."""
    out = _Out()
    sites: dict[str, _Site] = {}  # rows of a host need not stand together
    for b in batches:
        names = b.schema.names
        wide = [b.column(names.index(c)) for c in ("tokens", "support", "n")]
        for i, (site, page_id, url, text) in enumerate(zip(*(b.column(names.index(c)).to_pylist() for c in ("site", "page_id", "url", "text")))):
            one = sites.get(site)
            if one is None:
                if len(sites) == 64:
                    sites.pop(next(iter(sites))).close(True)
                one = sites[site] = _Site(site, Wrapper(*(c[i].as_py() for c in wide)), out)
            lines, tokens = read_lines(url, text)
            kept, at = squares(tokens)
            one.page(page_id, lines, tokens, kept, at)
            yield from out.batch(20000)
    for one in sites.values():
        one.close(True)
    yield from out.batch(1)


def _beside(src: DataFrame, parts: DataFrame) -> DataFrame:
    """Pages of the hosts in ``parts`` beside their expressions. A Parquet file says little of the memory expressions need,
    as hosts share lines, so their size is counted, and the copies of a spread join are never broadcast."""
    wide = parts.select("site", "n", "tokens", "support")
    size = parts.agg(F.sum(F.octet_length(F.array_join("tokens", "")) + 24 * F.size("tokens") + 100)).first()[0]
    if size <= SENT:
        return src.join(F.broadcast(wide), "site")
    # names of cut hosts, and of hosts with more than HOLD characters
    src = src.join(F.broadcast(parts.select("site")), "site", "left_semi")
    return spread_join(src, wide.hint("merge"), ["site"], "inner", 64)


_PART = ["site", "block", "hash", "n", "tokens", "support"]


def _read_again(src: DataFrame, parts: DataFrame, cut: DataFrame) -> DataFrame:
    """Lines of the hosts that were cut or too long to hold, by their blocks' combined expressions."""
    bits = cut.agg(F.max("bits")).first()[0] or 0
    for _ in range(0, bits, FAN_BITS):
        parts = parts.withColumn("block", F.expr(f"shiftright(block, {FAN_BITS})"))
        parts = parts.repartition("site", "block").sortWithinPartitions("site", "block", "hash").mapInArrow(_combine, _SCHEMA).select(*_PART)
        parts = stage(parts, "expressions")
    # arithmetic shifts leave -1 and 0 for the two halves
    parts = parts.withColumn("block", F.lit(0)).repartition("site").sortWithinPartitions("site", "hash").mapInArrow(_combine, _SCHEMA).select(*_PART)
    parts = stage(parts, "expressions")
    return stage(_beside(src, parts).mapInArrow(_parse, _SCHEMA), "parsed")


def page_lines(pages: DataFrame) -> DataFrame:
    """Lines of main text, and framed lines that show residue: (page_id, line_no, framed, size, weight, kind, hash).

    ``pages`` needs page_id, domain, url and text.
    """
    ship(pages.sparkSession)
    url = F.coalesce(F.regexp_replace(F.lower("url"), r"^https?://(?:www\.)?", ""), F.col("page_id").cast("string"))
    src = pages.filter("text IS NOT NULL AND text <> ''").select(
        F.coalesce(root_domain("domain"), root_domain("url"), F.lit("")).alias("site"), "page_id", url.alias("url"), "text"
    )
    counts = src.groupBy("site").count()
    most = F.greatest(F.lit(BLOCK), F.ceil(src.agg(F.count(F.lit(1))).scalar() / MAX_SPLIT_SITES))
    # a block is a number of leading bits of the hash
    cut = counts.filter(F.col("count") > most).select("site", F.ceil(F.log2(F.col("count") / most)).cast("int").alias("bits"))
    cut = stage(cut, "cut")
    h = F.xxhash64("url")
    block = F.when(F.col("bits") > 0, F.expr("shiftright(hash, 64 - bits)")).otherwise(0)
    keyed = src.join(F.broadcast(cut), "site", "left").withColumn("hash", h)
    keyed = keyed.select("site", block.alias("block"), F.col("bits").isNull().alias("whole"), "hash", "page_id", "url", "text")
    runs = keyed.repartition("site", "block").sortWithinPartitions("site", "block", "hash", "page_id")
    found = stage(runs.mapInArrow(_infer(HOLD), _SCHEMA), "wrappers")
    # expressions of blocks are combined by neighbours until each host has one
    parts = found.filter("tokens IS NOT NULL").select(*_PART)
    rows = found.filter("tokens IS NULL")
    if not parts.isEmpty():
        rows = rows.unionByName(_read_again(src, parts, cut))
    said = rows.filter("share IS NOT NULL").select("site", F.col("fine").alias("_h"), "share", "c", "n")
    whole = said.filter("site IS NULL").drop("site")
    of_cut = said.filter("site IS NOT NULL").groupBy("site", "_h").agg(F.sum("share").alias("share"), F.sum("c").alias("c"), F.max("n").alias("n")).drop("site")
    voice = F.least(F.col("n") - 1, F.lit(VOICE))
    said = whole.unionByName(of_cut).groupBy("_h").agg(
        (F.sum(voice * F.col("share") / F.col("c")) / F.sum(voice)).alias("_s"), F.count(F.lit(1)).alias("_k")
    )
    said = stage(said.filter(f"_k >= {min(FINE_SITES, COARSE_SITES)}"), "templates")
    lines = rows.filter("page_id IS NOT NULL").select("page_id", "line_no", "framed", "size", "weight", "kind", "hash", "c", "n", "lean", "fine", "coarse")
    sure, open_ = lines.filter("framed IS NOT NULL"), lines.filter("framed IS NULL")
    fine = said.select(F.col("_h").alias("fine"), F.col("_s").alias("_fine"), F.col("_k").alias("_fk"))
    coarse = said.filter(f"_k >= {COARSE_SITES}").select(F.col("_h").alias("coarse"), F.col("_s").alias("_coarse"))
    open_ = spread_join(spread_join(open_, fine, ["fine"]), coarse, ["coarse"])
    # a template of few hosts leans on what its first words say
    both = (F.col("_fine") * F.col("_fk") + F.col("_coarse") * COARSE_SITES) / (F.col("_fk") + COARSE_SITES)
    other = F.coalesce(both, F.col("_fine"), F.col("_coarse"), F.col("lean").cast("double"))
    estimate = 1 - (1 - (F.col("c") - 1) / (F.col("n") - 1 + PRIOR)) * (1 - other)
    open_ = open_.withColumn("framed", estimate >= FRAME).filter("NOT framed OR kind > 0")
    cols = ["page_id", "line_no", "framed", "size", "weight", "kind", "hash"]
    return stage(sure.select(cols).unionByName(open_.select(cols)), "lines")


def main_lines(lines: DataFrame, excluded: DataFrame) -> DataFrame:
    """(page_id, line_no) of main text, without the excluded pages, nor notices that stand beside the text."""
    text = lines.filter("NOT framed AND (kind <> 2 OR weight > 0)")
    return text.select("page_id", "line_no").join(excluded.select("page_id"), "page_id", "left_anti")
