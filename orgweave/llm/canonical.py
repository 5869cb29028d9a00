"""One consistent form for texts that look alike: Arrow buffers, numpy tables, no per-row string calls.

A batch's UTF-8 bytes become one array of code points. A lookup table gathers each point's replacement
(full- and half-width forms, ligatures, look-alike letters, canonical parts; nothing for invisible
characters; one blank for all kinds), expansion offsets place those of several points, combining marks are
put in canonical order and composed with their letters, blanks are squeezed, and the array is encoded again.

Joiners are kept between characters they shape (Arabic and Indic letters, emoji) and dropped elsewhere; overrides of
direction are kept, as they turn letters round. Further look-alikes can be given as ``extra``, or read from the public
confusables file (``read_confusables``).

Defined results: NULL stays NULL, the empty text stays empty, a text of invisible characters and blanks
alone becomes empty; texts of any length are read whole, in slices of rows of about ``SLICE`` bytes.
Line ends stay line ends; other runs of blanks become one, and none stand beside a line end.
"""

from __future__ import annotations

import functools
import unicodedata as u
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orgweave.shipping import ship
from orgweave.staging import stage

SLICE = 1 << 20

# Letters of other scripts that are drawn like the Latin letter beside them.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M",
    "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "Ӏ": "I", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Һ": "h",
    # Greek
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I",
    "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian, Latin letters of the phonetic alphabet, kana drawn alike, hyphens
    "օ": "o", "ս": "u", "հ": "h", "Օ": "O", "Տ": "S", "ɡ": "g", "ɑ": "a", "ɩ": "i", "へ": "ヘ", "り": "リ",
    "‐": "-", "‑": "-",
    # Cherokee, small capitals that are drawn like the small letter
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G",
    "Ꮓ": "Z", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B", "Ꮷ": "d",
    "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s",
}
LOOKALIKES["Һ"] = "H"
#: Kinds of compatibility forms that differ from their letters in width or joining only.
_SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>")
#: Of <compat>, spacing accents and dotted leaders differ visibly from what they decompose to.
_BLANKS = "\t\x0b\x0c\x85"
_ZWNJ, _ZWJ = 0x200C, 0x200D
#: Characters that stay although they are invisible, as what stands beside them looks different with them.
_KEPT = "\u200c\u200d\u202d\u202e"


def shaped(i: int) -> bool:
    """Whether a joiner beside this point can change what is drawn."""
    return 0x0600 <= i <= 0x0DFF or 0x0F00 <= i <= 0x109F or 0x1780 <= i <= 0x18AF or 0xA800 <= i <= 0xABFF or 0x2190 <= i <= 0x27BF or 0x2B00 <= i <= 0x2BFF or 0x1F000 <= i <= 0x1FAFF


def _parts(ch: str) -> str:
    """The replacement of one character."""
    cat = u.category(ch)
    if ch in "\n\r":
        return ch
    if cat == "Zs" or ch in _BLANKS:
        return " "
    if cat in ("Zl", "Zp"):
        return "\n"
    if ch in _KEPT:
        return ch
    if cat in ("Cf", "Cc") or ch in "͏ᅟᅠㅤﾠ" or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF:
        return ""
    if 0xAC00 <= ord(ch) <= 0xD7A3:
        return ch
    kind = u.decomposition(ch).partition(" ")
    if kind[0].startswith("<"):
        if kind[0] == "<font>" and u.name(ch, "").startswith(("MATHEMATICAL SANS-SERIF CAPITAL", "MATHEMATICAL SANS-SERIF SMALL", "MATHEMATICAL SANS-SERIF DIGIT", "MATHEMATICAL MONOSPACE")):
            return chr(int(kind[2], 16))  # drawn like the letter of a plain typeface
        if kind[0] not in _SAME_LOOK:
            return ch
        out = "".join(chr(int(x, 16)) for x in kind[2].split())
        if kind[0] == "<compat>" and (out[:1] == " " or "." in out):
            return ch
        return "".join(_parts(x) for x in out)
    if kind[0]:
        return "".join(_parts(chr(int(x, 16))) for x in u.decomposition(ch).split())
    return LOOKALIKES.get(ch, ch)


def read_confusables(path: str) -> dict[str, str]:
    """Single characters and what they are drawn like, from the public file of lines ``hex ; hex hex ; type``; those of
    ASCII stay themselves."""
    got = {}
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            cells = [x.strip() for x in line.partition("#")[0].split(";")]
            if len(cells) >= 2 and cells[0] and " " not in cells[0] and int(cells[0], 16) > 0x7F:
                got[chr(int(cells[0], 16))] = "".join(chr(int(x, 16)) for x in cells[1].split())
    return got


class _Tables:
    def __init__(self, extra: tuple[tuple[str, str], ...] = ()) -> None:
        more = dict(extra)
        size = 0x110000
        self.start = np.zeros(size, np.int32)  # into ``flat``, for points with another replacement
        self.count = np.ones(size, np.int8)
        self.plain = np.ones(size, bool)
        self.shapes = np.zeros(size, bool)
        flat: list[int] = []
        marks = np.zeros(size, np.uint8)
        pairs: dict[int, int] = {}
        for i in [*range(0xD800), *range(0xE000, 0x32000), *range(0xE0000, 0xE0200)]:
            ch = chr(i)
            if u.category(ch) == "Cn":
                continue
            marks[i] = u.combining(ch)
            new = more.get(ch) or _parts(ch)
            self.shapes[i] = shaped(i)
            if new != ch:
                self.plain[i] = False
                self.start[i], self.count[i] = len(flat), len(new)
                flat += map(ord, new)
            two = u.decomposition(ch).split()
            if len(two) == 2 and u.normalize("NFC", ch) == ch and not two[0].startswith("<"):
                first = LOOKALIKES.get(chr(int(two[0], 16)), chr(int(two[0], 16)))
                # Latin wins over a script whose letter was folded into it
                if first == chr(int(two[0], 16)) or (ord(first) << 21 | int(two[1], 16)) not in pairs:
                    pairs[ord(first) << 21 | int(two[1], 16)] = i
        self.flat, self.marks = np.array(flat, np.uint32), marks
        keys = np.array(sorted(pairs), np.int64)
        self.pair, self.whole = keys, np.array([pairs[k] for k in keys.tolist()], np.uint32)


@functools.cache
def _tables(extra: tuple[tuple[str, str], ...] = ()) -> _Tables:
    return _Tables(extra)


def _join(cp: np.ndarray, row: np.ndarray, t: _Tables) -> tuple[np.ndarray, np.ndarray]:
    """Joiners kept once, and only between two points of a text that they shape."""
    at = (cp == _ZWNJ) | (cp == _ZWJ)
    if not at.any():
        return cp, row
    same = np.r_[False, (row[1:] == row[:-1]) & (cp[1:] == cp[:-1])]
    keep = ~(at & same)
    cp, row, at = cp[keep], row[keep], at[keep]
    ok = t.shapes[cp]
    before = np.r_[False, ok[:-1] & (row[1:] == row[:-1])]
    after = np.r_[ok[1:] & (row[1:] == row[:-1]), False]
    keep = ~at | (before & after)
    return cp[keep], row[keep]


def _compose(cp: np.ndarray, row: np.ndarray, t: _Tables) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order, then composition, of the marks of all rows at once."""
    while True:
        ccc = t.marks[cp]
        at = np.flatnonzero(ccc)
        if not len(at):
            return cp, row
        run = np.cumsum((ccc == 0) | np.r_[True, row[1:] != row[:-1]])
        inner = at[at > 0]
        if ((ccc[inner] < ccc[inner - 1]) & (run[inner] == run[inner - 1])).any():
            order = np.argsort(run.astype(np.int64) * 256 + ccc, kind="stable")
            cp, row, ccc = cp[order], row[order], ccc[order]
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        lead = starts[run[at] - 1]
        # a mark reaches its letter when every mark between is of a lower class
        free = (lead < at) & (ccc[lead] == 0) & ((at - 1 == lead) | (ccc[np.maximum(at - 1, 0)] < ccc[at]))
        at, lead = at[free], lead[free]
        key = cp[lead].astype(np.int64) << 21 | cp[at].astype(np.int64)
        hit = np.searchsorted(t.pair, key)
        ok = (hit < len(t.pair)) & (t.pair[np.minimum(hit, len(t.pair) - 1)] == key)
        if not ok.any():
            return cp, row
        lead, first = np.unique(lead[ok], return_index=True)
        cp[lead] = t.whole[hit[ok][first]]
        keep = np.ones(len(cp), bool)
        keep[at[ok][first]] = False
        cp, row = cp[keep], row[keep]


def _jamo(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hangul letters joined into syllables."""
    if not ((cp >= 0x1100) & (cp <= 0x11FF)).any():
        return cp, row
    for low, high, base, width in ((0x1161, 0x1175, 0x1161, 0), (0x11A8, 0x11C2, 0x11A7, 1)):
        prev, same = cp[:-1], row[1:] == row[:-1]
        if width == 0:
            fits = (prev >= 0x1100) & (prev <= 0x1112)
            made = 0xAC00 + ((prev.astype(np.int64) - 0x1100) * 21 + (cp[1:].astype(np.int64) - base)) * 28
        else:
            fits = (prev >= 0xAC00) & (prev <= 0xD7A3) & ((prev - 0xAC00) % 28 == 0)
            made = prev.astype(np.int64) + cp[1:] - base
        ok = np.flatnonzero(same & fits & (cp[1:] >= low) & (cp[1:] <= high))
        cp[ok] = made[ok].astype(np.uint32)
        keep = np.ones(len(cp), bool)
        keep[ok + 1] = False
        cp, row = cp[keep], row[keep]
    return cp, row


def _squeeze(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One blank for a run of blanks, one line end for a run with line ends, none at a text's edges."""
    line = (cp == 10) | (cp == 13)
    blank = line | (cp == 32)
    if not blank.any():
        return cp, row
    edge = np.r_[True, row[1:] != row[:-1]]
    first = blank & (np.r_[True, ~blank[:-1]] | edge)  # first of its run
    run = np.cumsum(first)
    has_line = np.zeros(run[-1] + 1, bool)
    has_line[run[line]] = True
    cp = np.where(first, np.where(has_line[run], 10, 32), cp).astype(np.uint32)
    keep = ~blank | first
    cp, row, blank = cp[keep], row[keep], blank[keep]
    ends = np.r_[row[1:] != row[:-1], True]
    begins = np.r_[True, row[1:] != row[:-1]]
    keep = ~(blank & (begins | ends))
    return cp[keep], row[keep]


def canonical_array(texts: pa.Array, extra: tuple[tuple[str, str], ...] = ()) -> pa.Array:
    """The consistent form of each text; NULL where the text is NULL."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset :]
    data = texts.buffers()[2]
    out, size = [], np.zeros(n, np.int64)
    raw = memoryview(data) if data is not None else memoryview(b"")
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        j = min(j, n)
        piece, lengths = _slice(raw[offsets[i] : offsets[j]], np.diff(offsets[i : j + 1]), _tables(extra))
        out.append(piece)
        size[i:j] = lengths
        i = j
    ends = np.r_[0, np.cumsum(size)].astype(np.int64)
    valid = None
    if texts.null_count:
        mask = texts.is_valid().to_numpy(zero_copy_only=False)
        valid = pa.py_buffer(np.packbits(mask, bitorder="little").tobytes())
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join(out)), valid)


def _slice(raw: memoryview, nbytes: np.ndarray, t: _Tables) -> tuple[bytes, np.ndarray]:
    n = len(nbytes)
    if not len(raw):
        return b"", np.zeros(n, np.int64)
    cp = np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), np.uint32)
    width = 1 + (cp > 0x7F).astype(np.int8) + (cp > 0x7FF) + (cp > 0xFFFF)
    row = np.searchsorted(np.cumsum(nbytes), np.cumsum(width, dtype=np.int64) - width, "right").astype(np.int32)
    if not t.plain[cp].all():
        count = t.count[cp].astype(np.int64)
        ends = np.cumsum(count)
        source = np.repeat(np.arange(len(cp), dtype=np.int64), count)
        within = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) - np.repeat(ends - count, count)
        old = cp[source]
        cp = np.where(t.plain[old], old, t.flat[np.minimum(t.start[old] + within, len(t.flat) - 1)]).astype(np.uint32)
        row = row[source]
    else:
        cp = cp.copy()
    if len(cp):
        cp, row = _join(cp, row, t)
        cp, row = _compose(cp, row, t)
        cp, row = _jamo(cp, row)
        cp, row = _squeeze(cp, row)
    width = 1 + (cp > 0x7F).astype(np.int8) + (cp > 0x7FF) + (cp > 0xFFFF)
    sizes = np.bincount(row, weights=width, minlength=n).astype(np.int64) if len(cp) else np.zeros(n, np.int64)
    return cp.tobytes().decode("utf-32-le").encode("utf-8"), sizes


def canonical_text(df: DataFrame, text: str = "text", out: str = "canonical", extra: dict[str, str] | None = None) -> DataFrame:
    """df with one more column, the consistent form of ``text``; a column of that name is replaced. ``extra`` maps further
    characters to what they are drawn like."""
    ship(df.sparkSession)
    rest = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType([*rest, T.StructField(out, T.StringType())])
    at = [f.name for f in rest].index(text)
    more = tuple(sorted((extra or {}).items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = canonical_array(b.column(at), more).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, col], names=[*b.schema.names, out])

    return df.select(*[df[f.name] for f in rest]).mapInArrow(run, schema)


def _looks(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, look, stored): two digests of each text; all that is shuffled of it."""
    keyed = canonical_text(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).dropna(), "t", "c").select(
        "id", F.unhex(F.md5("c")).alias("look"), F.unhex(F.md5("t")).alias("stored")
    )
    return stage(keyed, "lookalike")


def _several(keyed: DataFrame) -> DataFrame:
    """(look, stored) of the looks that are stored in more than one way."""
    forms = keyed.groupBy("look", "stored").agg(F.count(F.lit(1)).alias("n"))
    looks = forms.groupBy("look").agg(F.count(F.lit(1)).alias("forms")).filter("forms > 1").select("look")
    return forms.join(looks, "look", "left_semi").select("look", "stored")


def lookalike_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_a, doc_b) of texts that look the same but are not equal as stored.

    Pairs are made between the forms of a look and then opened to their rows: copies of one text are never held against
    each other, and a text copied over a third of the rows without another form costs one aggregation.
    """
    keyed = _looks(docs, doc_id, text)
    forms = stage(_several(keyed), "forms")
    twos = forms.join(forms.select("look", F.col("stored").alias("stored_b")), "look").filter("stored < stored_b")
    a = twos.join(keyed, ["look", "stored"]).select("look", F.col("stored_b").alias("stored"), F.col("id").alias("a"))
    both = a.join(keyed, ["look", "stored"])
    return both.select(F.least("a", "id").alias("doc_a"), F.greatest("a", "id").alias("doc_b"))


def lookalike_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class, form): membership instead of pairs, for the looks stored in more than one way; the class is the
    smallest id of the look, the form that of its stored text."""
    keyed = _looks(docs, doc_id, text)
    forms = keyed.groupBy("look", "stored").agg(F.min("id").alias("form"), F.count(F.lit(1)).alias("n"))
    looks = forms.groupBy("look").agg(F.min("form").alias("class"), F.count(F.lit(1)).alias("forms")).filter("forms > 1").select("look", "class")
    return keyed.join(forms.join(looks, "look").select("look", "stored", "class", "form"), ["look", "stored"]).select(F.col("id").alias(doc_id), "class", "form")
