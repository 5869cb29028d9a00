"""Variant spellings of organisations' names: suffix blocking, LCS comparison, entities.

Every typed name is read into its own words (accents, legal forms, places, titles and trade words taken
off), the trade it states, an initial if one stands for a word, given names by the name they are short for, and
its site. Words of trades are the seeds below and every word that spreads over the sites of the data
(``spread_words``). The suffixes of the own words, and of the labels of sites, are the index: all forms enter it.
A suffix shared by too many forms is not dropped but refined, by longer suffixes and by more and more letters of
the other words; what is common after that is discarded. Forms in one block are compared by the ratio of their
longest common subsequence, in either order of their words, by their trades and their given names.

A site is evidence. Rows of one root are one organisation unless the host is shared by many (names there don't
resemble each other); two roots are one organisation if their stated trades agree and their words are equal, or
similar where the roots differ in their endings alone. Forms without a
site go to the best fitting site, by way of other forms if need be; what fits none is joined by components.

Defined results: NULL, blank and stand-in names take part by their site alone; without a site they belong
to nothing. Names of any length are compared whole (beyond 64 characters by an exact, slower way). Equal
rows get equal entities. Empty tables give empty results.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import reduce
from types import MappingProxyType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orgweave.functions.urls import root_domain
from orgweave.llm.components import components
from orgweave.operators.skew import spread_join
from orgweave.shipping import ship
from orgweave.staging import stage_plain as stage

#: Letters of the shortest suffix; a key is common where more pairs than in a block of COMMON forms meet.
SUFFIX, COMMON, RATIO = 4, 500, 0.85

# Ways to write that there is no value.
STAND_INS = ("", "-", "--", "n/a", "na", "none", "null", "unknown", "tbd", "tba", "coming soon", "not available", "?")
# Legal forms, joining words and titles, which name nobody.
NOISE = frozenset(
    "inc incorporated llc ltd limited corp corporation pllc plc lp llp co company comp gmbh sa the and of n a by sons son dr mr mrs ms "
    "prof main office".split()
)
#: A word is one of trades where it stands in names of so many sites: at least LEAST, and one in SPREAD of all.
LEAST, SPREAD = 4, 2000
#: Rows up to which roots of one organisation, roots of many forms, labels and words of two roots are sent to all
#: executors; more are joined.
FEW_ROOTS = 100_000
#: A host is shared if it has MANY forms or more and fewer than this share of its rows resemble its label or its
#: commonest name.
MANY, RESEMBLE = 5, 0.3

# Seeds of the words of trades; those in the second list state no trade on their own.
TRADES = (
    "accounting advertising air apparel auto bakery bath brand brewing cafe clinic coffee communications creative credit dental "
    "digital eye estate family fitness furniture garage growth heating home insurance interactive kitchen landscaping law "
    "marketing media medical moving orthodontics outdoor performance pet physical plumbing real repair roasters roofing "
    "search skin social solar storage strategy therapy tutoring windows"
).split()
GENERIC = "agency care center centre doors group partners services studio supply union".split()
# Abbreviations that are no shortening of the words.
SHORT = {
    "cu": "credit", "pt": "therapy", "re": "real", "realty": "real", "hvac": "heating", "rpr": "repair", "pr": "communications", "mktg": "marketing",
}
# Given names, with the short forms in use for them.
GIVEN = {
    "alexandra": "alex sandra lexi sasha", "anthony": "tony ant", "charles": "charlie chuck chas", "deborah": "deb debbie",
    "edward": "ed eddie ted ned", "elizabeth": "liz beth betty lizzie eliza", "francis": "frank fran", "james": "jim jimmy jamie",
    "joseph": "joe joey jo", "josephine": "josie jo", "katherine": "kate kathy katie kat", "margaret": "maggie peggy meg marge",
    "michael": "mike mick mickey", "patricia": "pat patty tricia trish", "rebecca": "becky becca", "richard": "rick dick rich richie",
    "robert": "bob rob bobby bert", "susan": "sue susie suzy", "theodore": "theo ted teddy", "william": "will bill billy liam",
}
_GIVEN: dict[str, set[str]] = {}
for _g, _short in GIVEN.items():
    for _w in (_g, *_short.split()):
        _GIVEN.setdefault(_w, set()).add(_g)
_SEEDS = frozenset(TRADES)

_CAMEL = re.compile(r"([A-ZÀ-Þ])(?<=[a-zà-ÿ].)(?=[a-zà-ÿ])")  # begins with what is rare
_ASIDE = re.compile(r"\([^)]*\)|\s-\s.*$")
_TOKEN = re.compile(r"(?:[a-z0-9]\.){2,}[a-z0-9]?|[a-z0-9]+")


def _subsequence(short: str, word: str) -> bool:
    rest = iter(word)
    return all(c in rest for c in short)


def _trade(token: str, trades: dict[str, list[str]], spread: Mapping[str, float]) -> str | None:
    """The trade words a token is or may shorten, joined by |; '' for a generic one, None for none. ``trades`` are the
    words by their first letter."""
    if token in SHORT:
        return SHORT[token]
    if token in _SEEDS:
        return token
    if token in GENERIC:
        return ""
    if 2 <= len(token) <= 9:
        n = len(token)
        longer = [w for w in trades.get(token[0], ()) if n < len(w) and _subsequence(token, w)]
        fits = [w for w in longer if w in _SEEDS]
        if fits:
            return "|".join(fits)
        for w in _GENERIC.get(token[0], ()):
            if n < len(w) and _subsequence(token, w):
                return ""
        if token not in spread:
            # a word cut short is a few letters of the longer one, so that most words of names fit none
            fits = [w for w in longer if spread.get(w, 0.0) >= LEAST and n <= 5]
            return "|".join(fits) or None
    return token if token in spread else None


def by_letter(words: Iterable[str]) -> dict[str, list[str]]:
    got: dict[str, list[str]] = {}
    for w in sorted(words):
        got.setdefault(w[0], []).append(w)
    return got


_SEEDED, _GENERIC = by_letter(TRADES), by_letter(GENERIC)
_NEW = object()  # stands for a token not met before


def read_name(
    name: str | None, cache: dict[str, str | None], trades: dict[str, list[str]] = _SEEDED, spread: Mapping[str, float] = MappingProxyType({})
) -> tuple[str, str, str, str]:
    """(own words joined by |, trades joined by |, initial, given names joined by |). Where every word is one of trades
    by its spread alone, the one that spreads least is the own word."""
    if not name:
        return "", "", "", ""
    s = _CAMEL.sub(r" \1", name)
    if not s.isascii():
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    if "(" in s or "- " in s:
        s = _ASIDE.sub(" ", s)
    own, found, initial, given = [], set(), "", set()
    for t in _TOKEN.findall(s.lower()):
        if "." in t:
            t = t.replace(".", "")
        trade = cache.get(t, _NEW)
        if trade is _NEW:
            if len(cache) > 200_000:
                cache.clear()
            # what is no word of its own and no trade is looked at below
            trade = cache[t] = "" if t in NOISE or t in _GIVEN or len(t) == 1 else _trade(t, trades, spread)
        if trade is None:
            own.append(t)
        elif trade:
            found.update(trade.split("|"))
        elif t in _GIVEN and t not in NOISE:
            given |= _GIVEN[t]
        elif len(t) == 1 and t not in NOISE:
            initial = initial or t
    if not own and spread:
        learned = [t for t in found if t in spread and t not in _SEEDS]
        if learned:
            least = min(learned, key=lambda t: (spread[t], t))
            own, found = [least], found - {least}
    return "|".join(own), "|".join(sorted(found)), initial, "|".join(sorted(given))


def stand_in(c: Column) -> Column:
    """Whether a value is blank or says that there is none. No letter's lower case is shorter than it, so longer values
    needn't be put into lower case."""
    return c.isNull() | ((F.length(F.trim(c)) <= max(map(len, STAND_INS))) & F.lower(F.trim(c)).isin(*STAND_INS))


def _spread(n: Column, scale: int) -> Column:
    """A set of 64 bits of the sites that one in ``scale`` hash to."""
    bit = F.expr("shiftleft(1L, cast(pmod(_site, 64) as int))")
    return F.bit_or(F.when(F.pmod(F.shiftright("_site", 8), F.lit(scale)) == 0, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"_b{scale}")


_SCALES = (1, 32, 1024, 32768)


def spread_words(df: DataFrame, name: str, domain: str) -> dict[str, float]:
    """Words that stand in names of at least LEAST sites, and of one in SPREAD: (word, about how many sites).

    All names count, in one pass. A word's sites are kept as sets of 64 bits at four scales (linear counting), so a
    row is reduced before the shuffle; the sites of all words together are those of the empty word. Fewer than
    SPREAD times the words of a site can be returned.
    """
    words = F.array_append(F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit("[a-z]{3,}"), F.lit(0))), F.lit(""))
    src = df.filter(F.col(domain).isNotNull() & F.col(name).isNotNull()).select(words.alias("_words"), root_domain(domain).alias("_root"))
    src = src.select(F.when(F.col("_root").isNotNull(), F.col("_words")).alias("_words"), F.xxhash64("_root").alias("_site"))
    # outer, though no array is empty: else they are made twice, once to see that; of rows without a root a NULL is left
    src = src.select(F.explode_outer("_words").alias("word"), "_site").filter("word IS NOT NULL")
    bits = src.groupBy("word").agg(*[_spread(F.col("_site"), k) for k in _SCALES])
    counted = [F.when(F.bit_count(f"_b{k}") < 50, -64.0 * k * F.log(1 - F.bit_count(f"_b{k}") / 64.0)) for k in _SCALES]
    found = bits.select("word", F.coalesce(*counted, F.lit(64.0 * _SCALES[-1] * 2)).alias("sites")).filter(F.col("sites") >= LEAST - 0.5)
    found = stage(found, "words")
    every = found.filter("word = ''").first()
    least = max(LEAST - 0.5, (every["sites"] if every else 0) / SPREAD)
    return {r["word"]: r["sites"] for r in found.filter((F.col("sites") >= least) & (F.col("word") != "")).collect()}


_FORM = ("own", "trade", "initial", "given")
_READ = T.StructType([T.StructField(n, T.StringType()) for n in _FORM])


def _reader(spread: dict[str, float]):
    known = frozenset(GENERIC) | NOISE | frozenset(_GIVEN) | frozenset(SHORT)
    trades = by_letter(_SEEDS | {w for w in spread if w not in known})
    words: dict[str, str | None] = {}  # of all batches of a task; read_name bounds it

    def read(names: pa.Array) -> pa.Array:
        """The parts of each name; equal names of a batch are read once."""
        seen: dict[str | None, tuple[str, ...]] = {}
        got = []
        for x in names.to_pylist():
            r = seen.get(x)
            if r is None:
                r = seen[x] = read_name(x, words, trades, spread)
            got.append(r)
        cols = [pa.array(c, pa.string()) for c in zip(*got)] if got else [pa.array([], pa.string())] * len(_FORM)
        return pa.StructArray.from_arrays(cols, names=list(_FORM))

    return read


_PLACES = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")} | {c: 52 + i for i, c in enumerate("0123456789")}


def bag(own: str) -> int:
    """A bit for each letter and digit, and one for each letter that stands twice or more. Two words differ
    in no more bits than letters have to be taken out of both to make them equal."""
    got = 0
    for c in own:
        k = _PLACES.get(c)
        if k is not None:
            got |= 1 << (k + 26 if k < 26 and got >> k & 1 else k)
    return got


_WIDE = 62
_CODES = np.full(256, -1, np.int64)
for _c, _i in _PLACES.items():
    _CODES[ord(_c)] = _i
_ONCE, _TWICE = np.left_shift(1, np.arange(_WIDE)), np.left_shift(1, np.arange(26) + 26)


def _bags(own: pa.Array) -> pa.Array:
    """``bag`` of each word, by the counts of the letters of all."""
    n = len(own)
    codes = _CODES[np.frombuffer("".join(own.to_pylist()).encode(), np.uint8)]
    at = np.repeat(np.arange(n), pc.binary_length(own).to_numpy(zero_copy_only=False)) * _WIDE + codes
    counts = np.bincount(at[codes >= 0], minlength=n * _WIDE).reshape(n, _WIDE)
    return pa.array((counts > 0).astype(np.int64) @ _ONCE + (counts[:, :26] > 1).astype(np.int64) @ _TWICE, pa.int64())


def _kept(i: int) -> str:
    """Name under which a column to keep passes, whatever its own."""
    return f"_keep{i}"


def read_names(df: DataFrame, row: str, name: str, domain: str, keep: Sequence[str] = ()) -> DataFrame:
    """(row, name, root, own, trade, initial, given) and the columns to keep as _keep0, ...; name NULL where it is a
    stand-in."""
    ship(df.sparkSession)
    src = df.select(
        F.col(row).cast("bigint").alias("row"), F.when(~stand_in(F.col(name)), F.col(name)).alias("name"),
        root_domain(domain).alias("root"), *[df[c].alias(_kept(i)) for i, c in enumerate(keep)],
    )
    # the address as typed, as its root would be read again in each place that names it
    spread = spread_words(df.select(F.when(~stand_in(F.col(name)), F.col(name)).alias("name"), F.col(domain).alias("domain")), "name", "domain")
    read = src.withColumn("_r", F.arrow_udf(_reader(spread), _READ)("name"))
    return read.select("row", "name", "root", *[f"_r.{x}" for x in _FORM], *map(_kept, range(len(keep))))


#: Pairs compared at once, so that the masks of their letters stay in the processor's cache.
_AT_ONCE = 1000


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Longest common subsequence of each pair: bit-parallel, _AT_ONCE pairs a step."""
    if len(a) > _AT_ONCE:
        return np.concatenate([lcs_lengths(a[i : i + _AT_ONCE], b[i : i + _AT_ONCE]) for i in range(0, len(a), _AT_ONCE)])
    n = len(a)
    out = np.zeros(n, np.int64)
    la = np.fromiter(map(len, a), np.int64, n)
    lb = np.fromiter(map(len, b), np.int64, n)
    ok = np.flatnonzero((la <= 64) & (la > 0) & (lb > 0))
    for i in np.flatnonzero(la > 64).tolist():
        masks: dict[str, int] = {}
        for k, c in enumerate(a[i]):
            masks[c] = masks.get(c, 0) | 1 << k
        full = v = (1 << len(a[i])) - 1
        for c in b[i]:
            u = v & masks.get(c, 0)
            v = (v + u | v - u) & full
        out[i] = len(a[i]) - v.bit_count()
    if len(ok):
        wide = max(int(la[ok].max()), 1)
        ca = np.array([a[i] for i in ok.tolist()], dtype=f"<U{wide}").view(np.uint32).reshape(len(ok), wide)
        long = max(int(lb[ok].max()), 1)
        cb = np.array([b[i] for i in ok.tolist()], dtype=f"<U{long}").view(np.uint32).reshape(len(ok), long)
        rows = np.arange(len(ok))
        masks_ = np.zeros((len(ok), 128), np.uint64)
        for k in range(wide):
            masks_[rows, ca[:, k] & 127] |= np.uint64(1) << np.uint64(k)  # own words hold a-z and 0-9 only
        masks_[:, 0] = 0
        v = np.full(len(ok), ~np.uint64(0))
        for k in range(long):
            m = masks_[rows, cb[:, k] & 127]
            u = v & m
            v = (v + u) | (v - u)
        size = la[ok].astype(np.uint64)
        full_ = np.where(size >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(size, 63)) - np.uint64(1))
        out[ok] = np.bitwise_count(~v & full_)
    return out


def _ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the LCS ratio of (own_a, initial_a) and (own_b, initial_b), the last four columns, as ``score``."""
    for b in batches:
        n = b.num_columns
        own_a, ini_a, own_b, ini_b = (b.column(n - 4 + i).to_pylist() for i in range(4))
        one, two, turn = [], [], []
        for x, i, y, j in zip(own_a, ini_a, own_b, ini_b):
            xs, ys = x.split("|"), y.split("|")
            if i and not j and len(xs) == 1 and len(ys) == 2:
                # an initial stands for a word: compare the word that is written
                k = 0 if ys[1].startswith(i) else 1
                ok = ys[1 - k].startswith(i)
                xs, ys = xs, [ys[k]] if ok else [""]
            elif j and not i and len(ys) == 1 and len(xs) == 2:
                k = 0 if xs[1].startswith(j) else 1
                ok = xs[1 - k].startswith(j)
                xs, ys = [xs[k]] if ok else [""], ys
            one.append("".join(xs))
            two.append("".join(ys))
            turn.append("".join(reversed(ys)) if len(ys) > 1 else "")
        total = np.array([len(x) + len(y) for x, y in zip(one, two)], np.float64)
        best = lcs_lengths(one, two)
        # what has all letters of the shorter one can't have more in the other order
        alt = [k for k, (t, x, n) in enumerate(zip(turn, one, best.tolist())) if t and n < min(len(x), len(t))]
        if alt:
            best[alt] = np.maximum(best[alt], lcs_lengths([one[k] for k in alt], [turn[k] for k in alt]))
        score = 2 * best / np.maximum(total, 1)
        yield pa.RecordBatch.from_arrays([*b.columns[: n - 4], pa.array(score)], names=[*b.schema.names[: n - 4], "score"])


def _indexed_words(label: str) -> Column:
    """The words whose suffixes a form is found by, each once, joined by |: its own of three letters or more, and the label of
    its site, if it has one."""
    words = F.array_distinct(F.filter(F.split("own", r"\|"), lambda w: F.length(w) > 2))
    # a label that ends in one of the words has that word's suffixes
    more = F.col(label).isNotNull() & ~F.exists(words, lambda w: F.endswith(F.col(label), w))
    return F.concat_ws("|", words, F.when(more, F.col(label)))


def _open(forms: DataFrame, first: bool) -> DataFrame:
    """forms, one row for each key: the shortest suffix of a word or site label, with a trade.

    Trades are part of the key, as only forms whose trades don't exclude each other are compared: ``first``
    forms that state one meet seconds that state the same, and seconds that state none (S); first forms that
    state none meet all (U). An initial is little to go by: with one the trade must be stated on both sides.
    """
    none, some = ("U", "|S") if first else ("S|U", "|U")
    bare = F.col("initial") == ""
    kinds = F.when(F.col("trade") == "", F.lit(none)).otherwise(F.concat("trade", F.when(bare, F.lit(some)).otherwise(F.lit(""))))
    rows = forms.filter((F.col("words") != "") & (bare | (F.col("trade") != ""))).withColumn("kind", F.explode(F.split(kinds, r"\|"))).withColumn("word", F.explode(F.split("words", r"\|")))
    rows = rows.select(
        "id", "own", "bag", _meta(F.col("letters"), bare, F.col("root").isNotNull()).alias("meta"), "word", "kind",
        F.least(F.lit(SUFFIX), F.length("word")).alias("size"), F.lit("").alias("tail"),
    )
    return _keyed(rows)


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("suffix", F.xxhash64("kind", F.expr("right(word, size)"), "tail"))


def _split(rows: DataFrame) -> DataFrame:
    """Rows of common keys, each replaced by keys of longer suffixes, and by keys of the same suffix with more of the
    beginning or end of another word. A key that is two whole words can't be refined: it is discarded where it is
    common, as forms with equal words and trades are few (their initials and given names). No row gives a key twice;
    rows of one word with different keys may give the same one."""
    size, longer = F.col("size"), F.col("size") < F.length("word")
    own = F.split("own", r"\|")
    others = F.filter(own, lambda w: w != F.col("word"))
    rest = F.length(F.array_join(others, ""))
    # a form of one word, or nearly, may be written as two elsewhere
    heads = F.when(rest * RATIO <= F.length("word") * 2 * (1 - RATIO), F.concat(others, F.array("word"))).otherwise(others)
    tails = F.concat(
        F.transform(heads, lambda w: F.concat(F.lit("<"), F.substring(w, 1, 3))),
        F.transform(others, lambda w: F.concat(F.lit(">"), F.right(w, F.lit(SUFFIX)))),
    )
    more = F.length("tail") + 1
    sign, part = F.substring("tail", 1, 1), F.substring("tail", F.lit(2), F.length("tail"))
    further = F.concat(
        F.transform(F.filter(heads, lambda w: (sign == "<") & F.startswith(w, part) & (F.length(w) > F.length(part))), lambda w: F.concat(F.lit("<"), F.substring(w, F.lit(1), more))),
        F.transform(F.filter(others, lambda w: (sign == ">") & F.endswith(w, part) & (F.length(w) > F.length(part))), lambda w: F.concat(F.lit(">"), F.right(w, more))),
    )
    key = lambda size, tail: F.struct(size.alias("size"), tail.alias("tail"))
    none = F.array().cast("array<struct<size:int,tail:string>>")
    grown = F.coalesce(F.when(longer, F.array(key(size + 1, F.col("tail")))), none)
    wider = F.transform(F.array_distinct(F.when(F.col("tail") == "", tails).otherwise(further)), lambda t: key(size, t))
    got = rows.withColumn("_k", F.explode(F.concat(grown, wider))).drop("size", "tail", "suffix")
    return _keyed(got.select("*", "_k.size", "_k.tail").drop("_k"))


def _index(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys of the forms as first and as second of a pair, none of them common: no more than COMMON * COMMON / 4 pairs
    meet under one."""
    now = [_open(first, True), _open(second, False)]
    done: list[list[DataFrame]] = [[], []]
    first_split = True
    while True:
        every = now[0].select("suffix", F.lit(1).alias("a")).unionByName(now[1].select("suffix", F.lit(0).alias("a")))
        common = every.groupBy("suffix").agg(F.sum("a").alias("a"), F.sum(1 - F.col("a")).alias("b"))
        common = stage(common.filter(F.col("a") * F.col("b") > COMMON * COMMON / 4).select("suffix"), "common")
        last = common.isEmpty()
        for i, rows in enumerate(now):
            done[i].append(rows if last else rows.join(common, "suffix", "left_anti"))
            if not last:
                # opened forms have one key for each word and kind, so that no two of them give the same
                got = _split(rows.join(common, "suffix", "left_semi"))
                now[i] = stage(got if first_split else got.distinct(), "split")
        first_split = False
        if last:
            cols = ["suffix", "id", "bag", "meta"]
            return tuple(reduce(DataFrame.unionByName, (x.select(cols) for x in d)) for d in done)


def _match(a: DataFrame, b: DataFrame, free: DataFrame, forms: DataFrame) -> DataFrame:
    """(id, id_b, sited_b, stated, score) of the pairs of one block with an LCS ratio >= RATIO; a's are of the ``free`` forms,
    which have no site, and of two without a site each is held against later ones only."""
    opened = lambda df, x: df.select(
        "suffix", F.col("id").alias(f"id{x}"), F.col("bag").alias(f"bag{x}"), F.shiftright("meta", 2).alias(f"letters{x}"),
        (F.col("meta").bitwiseAND(2) > 0).alias(f"bare{x}"), (F.col("meta").bitwiseAND(1) > 0).alias(f"sited{x}"),
    )
    # the forms without a site are the fewer; no block is large
    pairs = opened(a, "").hint("shuffle_hash").join(opened(b, "_b"), "suffix").filter(_near() & (F.col("sited_b") | (F.col("id") < F.col("id_b")))).select("id", "id_b", "sited_b").distinct()
    return _compared(pairs, free, forms)


def _meta(letters: Column, bare: Column, sited: Column) -> Column:
    """Three small values of an index row in one, as these rows are what is shuffled most."""
    return letters * 4 + F.when(bare, 2).otherwise(0) + F.when(sited, 1).otherwise(0)


def _near() -> Column:
    """Letters that one of two words lacks are lost to their subsequence; of words with an initial only a part is compared."""
    total = F.col("letters") + F.col("letters_b")
    near = F.bit_count(F.col("bag").bitwiseXOR(F.col("bag_b"))) <= total * (1 - RATIO) + 1e-6
    return near | ~F.col("bare") | ~F.col("bare_b")


def _compared(pairs: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """pairs (id of first, id_b of second, sited_b), those kept whose trades and given names don't exclude each other, with
    ``stated`` (both state a trade) and the LCS ratio, RATIO at least, as ``score``."""
    named = lambda df, x: df.select(F.col("id").alias("id" + x), *[F.col(c).alias(c + x) for c in _FORM])
    pairs = pairs.join(named(first, ""), "id").join(named(second, "_b"), "id_b")
    both = lambda c: (F.col(c) != "") & (F.col(c + "_b") != "")
    shared = lambda c: F.arrays_overlap(F.split(c, r"\|"), F.split(c + "_b", r"\|"))
    pairs = pairs.filter((~both("trade") | shared("trade")) & (~both("given") | shared("given")))  # keys are hashes
    pairs = pairs.select("id", "id_b", "sited_b", both("trade").alias("stated"), "own", "initial", "own_b", "initial_b")
    got = pairs.mapInArrow(_ratios, "id bigint, id_b bigint, sited_b boolean, stated boolean, score double")
    return got.filter(F.col("score") >= RATIO)


def _two_sites(sited: DataFrame, chief: DataFrame) -> DataFrame:
    """(_from, _to): pairs of roots that are one organisation: those whose commonest forms have the same words, trade and
    given names (each tied to the smallest root, so a word at many roots makes no pairs), and those of one label (as
    many as there are endings), a similar name and an overlapping trade."""
    words = F.array_join(F.sort_array(F.split("own", r"\|")), "|")
    keys = chief.filter("trade <> ''").select("root", F.explode(F.split("trade", r"\|")).alias("_t"), words.alias("_w"), "given")
    # most stand at one root only: those are left out by their hashes, before words are sorted
    hashed = keys.withColumn("_k", F.xxhash64("_t", "_w", "given"))
    more = _sent(stage(hashed.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_k"), "equals"))
    keys = stage(hashed.join(more, "_k", "left_semi").drop("_k"), "twins")
    least = keys.groupBy("_t", "_w", "given").agg(F.min("root").alias("_to"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    equal = keys.join(least, ["_t", "_w", "given"]).filter("root <> _to").select(F.col("root").alias("_from"), "_to")
    label = _label("root").alias("_l")
    twice = _sent(stage(chief.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_l"), "twice"))
    stated = lambda df: df.filter("trade <> ''").withColumn("bare", F.col("initial") == "").withColumn("_l", label)
    few = stage(stated(sited.drop("n", "words")).join(twice, "_l", "left_semi"), "few")
    a = few.join(chief.select("id"), "id").select("_l", "id", "root", "bag", "letters", "bare")
    b = few.select("_l", *[F.col(c).alias(f"{c}_b") for c in ("id", "root", "bag", "letters", "bare")])
    pairs = a.join(b, "_l").filter(_near() & (F.col("root") != F.col("root_b"))).select("id", "id_b", F.lit(True).alias("sited_b"))
    alike = _compared(pairs, few, few).filter("stated")
    alike = alike.join(few.select("id", F.col("root").alias("_from")), "id").join(few.select(F.col("id").alias("id_b"), F.col("root").alias("_to")), "id_b")
    return equal.unionByName(alike.select("_from", "_to")).distinct()


def _sent(few: DataFrame) -> DataFrame:
    """few, counted first: sent to all executors where it has no more than FEW_ROOTS rows; joined beyond."""
    return F.broadcast(few) if few.count() <= FEW_ROOTS else few


def _label(root: str) -> Column:
    return F.replace(F.substring_index(root, ".", 1), F.lit("-"), F.lit(""))


def chief_forms(sited: DataFrame) -> DataFrame:
    """The commonest form with words of its own of each site, and how many ``forms`` the site has."""
    best = F.struct((F.col("plain") != "").alias("has"), "n", -F.col("id"), *[c for c in sited.columns if c not in ("root", "n")])
    chief = sited.groupBy("root").agg(F.max(best).alias("m"), F.count(F.lit(1)).alias("forms"))
    return stage(chief.select("root", "m.n", "forms", *[f"m.{c}" for c in sited.columns if c not in ("root", "n")]), "chief")


def shared_hosts(sited: DataFrame, chief: DataFrame) -> DataFrame:
    """(root) of hosts many organisations share, from their forms (root, plain, n) and commonest forms."""
    many = _sent(chief.filter(F.col("forms") >= MANY).select("root", F.regexp_replace("plain", r"\|", "").alias("_top")))
    plain = sited.filter("plain <> ''").select("root", F.regexp_replace("plain", r"\|", "").alias("own"), "n").join(many, "root")
    like = lambda x: F.levenshtein("own", x) * 2 <= F.greatest(F.length("own"), F.length(x))
    fits = plain.groupBy("root").agg(
        (F.sum(F.when(like(F.col("_top")) | like(_label("root")), F.col("n")).otherwise(0)) / F.sum("n")).alias("_fit"), F.count(F.lit(1)).alias("_forms")
    )
    return fits.filter((F.col("_forms") >= MANY) & (F.col("_fit") < RESEMBLE)).select("root")


def entities(df: DataFrame, row: str, name: str, domain: str, keep: Sequence[str] = ()) -> DataFrame:
    """(row, name, entity) and the columns to keep: rows of one organisation share an entity; rows of none
    are left out."""
    if {"row", "name", "entity"} & set(keep):
        raise ValueError("row, name and entity are the result's own columns")
    rows = stage(read_names(df, row, name, domain, keep), "names")
    form = list(_FORM)
    has_own = F.col("own") != ""

    def grouped(rows: DataFrame) -> DataFrame:
        # a form's id is its smallest row; a site none of whose names has words of its own is known by its label
        got = rows.groupBy("root", *form).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("id"))
        got = got.filter(F.col("root").isNotNull() | has_own).withColumn("plain", F.col("own"))
        got = got.withColumn("_l", _label("root")).withColumn("own", F.when(has_own, F.col("own")).otherwise(F.col("_l")))
        got = got.withColumn("bag", F.arrow_udf(_bags, "bigint")("own")).withColumn("letters", F.length(F.replace("own", F.lit("|"), F.lit(""))))
        return stage(got.withColumn("words", _indexed_words("_l")).drop("_l"), "forms")

    measured = grouped(rows)
    chief = chief_forms(measured.filter("root IS NOT NULL").drop("words"))
    shared = stage(shared_hosts(measured.filter("root IS NOT NULL"), chief), "shared")
    if not shared.isEmpty():
        rows = spread_join(rows, shared.withColumn("_shared", F.lit(True)), ["root"])
        rows = stage(rows.withColumn("root", F.when(F.col("_shared").isNull(), F.col("root"))).drop("_shared"), "names")
        measured = grouped(rows)
        chief = chief_forms(measured.filter("root IS NOT NULL").drop("words"))
    measured, chief = measured.drop("plain"), chief.drop("plain", "forms")
    sited, free = measured.filter("root IS NOT NULL"), measured.filter("root IS NULL")
    links = stage(_match(*_index(free, measured), free, measured), "links")

    homes = sited.select(F.col("id").alias("id_b"), F.col("root").alias("home"), "n")
    fit = F.max(F.struct("stated", F.round("score", 2).alias("score"), "n", "home")).alias("m")
    best = links.filter("sited_b").join(homes, "id_b").groupBy("id").agg(fit)
    best = stage(best.select("id", F.col("m.home").alias("home")), "best")
    # what fits no site may fit one by way of other forms: components take the best site any of their forms reaches
    twos = links.filter("NOT sited_b").select("id", "id_b", "stated", "score")
    both = twos.unionByName(twos.select(F.col("id_b").alias("id"), F.col("id").alias("id_b"), "stated", "score"))
    out = stage(both.join(best.select("id"), "id", "left_anti"), "open")
    at = best.select(F.col("id").alias("id_b"), F.col("home"))
    inner = components(out.join(at.select("id_b"), "id_b", "left_anti").filter("id < id_b"), "id", "id_b")
    alone = free.select("id").join(best.select("id"), "id", "left_anti").join(inner, "id", "left")
    alone = stage(alone.select("id", F.coalesce("component", "id").alias("component")), "alone")
    via = out.join(at, "id_b").join(alone, "id").groupBy("component").agg(F.max(F.struct("stated", F.round("score", 2).alias("score"), "home"))["home"].alias("home"))
    rest = alone.join(via, "component", "left").select("id", "home", F.concat(F.lit("f:"), F.col("component").cast("string")).alias("entity"))
    at_site = F.concat(F.lit("s:"), F.col("home"))
    of_form = best.select("id", "home", at_site.alias("entity")).unionByName(rest.select("id", "home", F.coalesce(at_site, F.col("entity")).alias("entity")))
    of_form = free.select(*form, "id").join(of_form, "id").drop("id")
    with_site = rows.filter("root IS NOT NULL").withColumn("entity", F.concat(F.lit("s:"), F.col("root")))
    # roots of one organisation; of a site the commonest form seeks the others
    apart = stage(_two_sites(sited, chief), "apart")
    if not apart.isEmpty():
        no = chief.select("root", "id")
        ids = apart.join(no.select(F.col("root").alias("_from"), F.col("id").alias("a")), "_from").join(no.select(F.col("root").alias("_to"), F.col("id").alias("b")), "_to")
        same = components(ids, "a", "b").join(no, "id").select("root", F.concat(F.lit("r:"), F.col("component").cast("string")).alias("_e"))
        same = _sent(stage(same, "same"))
        with_site = with_site.join(same, "root", "left").withColumn("entity", F.coalesce("_e", "entity"))
        of_form = of_form.join(same.withColumnRenamed("root", "home"), "home", "left").withColumn("entity", F.coalesce("_e", "entity"))
    without = rows.filter(F.col("root").isNull() & has_own).join(of_form.select(*form, "entity"), form)
    cols = ["row", "name", "entity", *[F.col(_kept(i)).alias(c) for i, c in enumerate(keep)]]
    return with_site.select(*cols).unionByName(without.select(*cols))


def variant_pairs(ent: DataFrame) -> DataFrame:
    """(row_a, row_b) of one entity whose stored names differ, row_a < row_b.

    Pairs are made between an entity's different names, then opened to their rows: copies of one name
    are never held against each other.
    """
    named = ent.filter("name IS NOT NULL").select("row", "entity", F.xxhash64("name").alias("h"))
    named = stage(named, "named")
    kinds = named.groupBy("entity", "h").agg(F.count(F.lit(1)).alias("n"))
    twos = kinds.select("entity", "h").join(kinds.select("entity", F.col("h").alias("h2")), "entity").filter("h < h2")
    a = twos.join(named, ["entity", "h"]).select("entity", F.col("h2").alias("h"), F.col("row").alias("r"))
    both = a.join(named, ["entity", "h"])
    return both.select(F.least("r", "row").alias("row_a"), F.greatest("r", "row").alias("row_b"))
