"""Consistent text forms against a form built one character at a time."""

import re
import unicodedata as u

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orgweave.llm import canonical as C


def plain(text):
    """The same form, without arrays."""
    if text is None:
        return None
    s = "".join(C._parts(c) for c in text)
    s = re.sub("(\u200c|\u200d)\\1+", "\\1", s)
    on = lambda i: 0 <= i < len(s) and C.shaped(ord(s[i]))
    s = "".join(c for i, c in enumerate(s) if c not in "\u200c\u200d" or (on(i - 1) and on(i + 1)))
    # canonical order
    out = []
    for c in s:
        i = len(out)
        while u.combining(c) and i and u.combining(out[i - 1]) > u.combining(c):
            i -= 1
        out.insert(i, c)
    t = C._tables()
    pairs = dict(zip(t.pair.tolist(), t.whole.tolist()))
    made, start = [], -1
    for c in out:
        k = u.combining(c)
        if start >= 0 and k and (len(made) - 1 == start or u.combining(made[-1]) < k):
            whole = pairs.get(ord(made[start]) << 21 | ord(c))
            if whole:
                made[start] = chr(whole)
                continue
        if not k:
            start = len(made)
        made.append(c)
    s = "".join(made)
    lines = []
    for part in re.split("[\n\r]", s):
        part = " ".join(x for x in part.split(" ") if x)
        if part:
            lines.append(part)
    return "\n".join(lines)


def many(texts):
    return C.canonical_array(pa.array(texts, pa.string())).to_pylist()


ALPHABET = st.text(st.sampled_from("aeо еcсxёйé́̈̌ﬁｆＡ１ﾊﾟﾞㅤ​ \n\t　 ⅷΑοKÅ\U0001f600漢ß"), max_size=25)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), ALPHABET), max_size=12))
def test_against_plain(texts):
    assert many(texts) == [plain(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=8))
def test_once_is_enough(texts):
    once = many(texts)
    assert many(once) == once


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("ﬁne ＡＢ", "fine AB", True), ("café", "café", True), ("pаypal", "paypal", True), ("a​b", "ab", True), ("a b", "a  b", True),
     ("cafe", "café", False), ("Cafe", "cafe", False), ("a.", "a!", False), ("5²", "52", False), ("ﾊﾟ", "パ", True), ("한", "한", True)],
)
def test_looks(a, b, same):
    x, y = many([a, b])
    assert (x == y) is same


def test_edges(monkeypatch):
    assert many([]) == [] and many([None, ""]) == [None, ""]
    long = "x" * 300_000 + "é" + " " * 1000 + "y"
    monkeypatch.setattr(C, "SLICE", 1000)
    assert many([long, "", None, "ａ"] * 3) == [long.replace(" " * 1000, " "), "", None, "a"] * 3


def test_pairs(spark):
    rows = [(1, "abc def"), (2, "abc def"), (3, "аbc  def"), (4, "ABC def"), (5, None), (6, ""), (7, "​")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("look", F.lit(1))
    got = {(r.doc_a, r.doc_b) for r in C.lookalike_pairs(df).collect()}
    assert got == {(1, 3), (2, 3), (6, 7)}
    assert C.lookalike_pairs(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    kept = C.canonical_text(df.withColumn("canonical", df.doc_id))  # a clashing column is replaced
    assert kept.columns == ["doc_id", "text", "look", "canonical"]


def test_what_differs_visibly_stays_apart(tmp_path):
    family, apart = "\U0001f468\u200d\U0001f469\u200d\U0001f467", "\U0001f468\U0001f469\U0001f467"
    persian, joined = "می\u200cخواهم", "میخواهم"
    a, b, c, d, e, f = many([family, apart, persian, joined, "a\u202eb", "ab"])
    assert a != b and c != d and e != f
    assert many(["a\u200db", "a\u200cb", "ab"]) == ["ab"] * 3 and many([family.replace("\u200d", "\u200d\u200d")]) == [a]
    assert many(["Ꭺ", "ᴏ", "\U0001d5ba", "\U0001d670", "\U0001d41a"]) == ["A", "o", "a", "A", "\U0001d41a"]
    (tmp_path / "c.txt").write_text("# sample\n2A00 ;\t0041 ;\tMA\t# x\n0041 0042 ; 0043 ; MA\n", encoding="utf-8-sig")
    extra = C.read_confusables(str(tmp_path / "c.txt"))
    assert extra == {"\u2a00": "A"}
    assert C.canonical_array(pa.array(["\u2a00b"]), tuple(extra.items())).to_pylist() == ["Ab"]


def test_pairs_between_forms(spark):
    rows = [(i, "plain text") for i in range(40)] + [(50, "plain\u00a0text"), (51, "plain  text"), (60, "other"), (61, "other")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    pairs = {(r.doc_a, r.doc_b) for r in C.lookalike_pairs(df).collect()}
    assert pairs == {(i, j) for i in range(40) for j in (50, 51)} | {(50, 51)}
    classes = {r.doc_id: (r["class"], r.form) for r in C.lookalike_classes(df).collect()}
    assert classes == {i: (0, 0) for i in range(40)} | {50: (0, 50), 51: (0, 51)}
