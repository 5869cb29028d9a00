"""Packed fields against a scanner written by hand."""

import re

import pytest

from orgweave.operators.packed import split_packed

K = "[pixel] https://a.test/ :: "
CASES = {
    "tokens": {
        "a|b": ["a", "b"], '["a", "b"]': ["a", "b"], '"a";"b"': ["a", "b"], " a / b ": ["a", "b"], "||": [], "": [], None: [], "a,,a": ["a", "a"],
        '"a" b\tc': ["a", "b", "c"], '"open': ['"open'], "x.test\n\ny.test": ["x.test", "y.test"],
    },
    "evidence": {
        f"{K}one | {K}two": [f"{K}one", f"{K}two"], f"{K}a; b || {K}c": [f"{K}a; b", f"{K}c"], f'"{K}he said ""x || y"" so" || {K}z': [f'{K}he said "x || y" so', f"{K}z"],
        f" || {K}a ||  || {K}b || ": [f"{K}a", f"{K}b"], f"{K}a\n{K}b": [f"{K}a", f"{K}b"], f"{K}p | q | r": [f"{K}p | q | r"],
    },
    "notes": {
        "a=1 | b=2": ["a=1", "b=2"], "a=1;b | c;d=2": ["a=1", "b | c", "d=2"], "a=1 || x | y || b=2": ["a=1", "x | y", "b=2"], '"x | y" | a=1': ["x | y", "a=1"],
        "a=1\nx; y": ["a=1", "x; y"], '"""no"" they say" | b=2': ['"no" they say', "b=2"], 'said "x" twice | a=1': ['said "x" twice', "a=1"], "a=1 |  | b=2": ["a=1", "b=2"],
        '"p; q"': ["p; q"], "one": ["one"], "x; y | a=1": ["x; y", "a=1"],
    },
}


@pytest.mark.parametrize("style", list(CASES))
def test_cases(spark, style):
    rows = [(i, v) for i, v in enumerate(CASES[style])]
    df = spark.createDataFrame(rows, "id bigint, v string")
    got = {i: [] for i, _ in rows}
    for r in split_packed(df, "v", "id", style).orderBy("row_id", "pos").collect():
        assert r.pos == len(got[r.row_id]) + 1
        got[r.row_id].append(r.item)
    assert [got[i] for i, _ in rows] == list(CASES[style].values())


def test_flags_and_length(spark):
    long = "|".join(f"v{i}" for i in range(50_000))
    df = spark.createDataFrame([(1, long), (2, '"broken'), (3, '"fine"')], "id bigint, v string")
    rows = split_packed(df, "v", "id", "tokens").collect()
    assert sum(r.row_id == 1 for r in rows) == 50_000
    assert {(r.row_id, r.malformed) for r in rows if r.row_id > 1} == {(2, True), (3, False)}


def test_empty_table(spark):
    assert split_packed(spark.createDataFrame([], "id bigint, v string"), "v", "id", "notes").count() == 0


def quoted(s, i, ends):
    """End of a quoted value at i that closes before a boundary, else None."""
    if s[i] != '"':
        return None
    j = i + 1
    while j < len(s):
        if s[j] == '"':
            if s[j + 1 : j + 2] == '"':
                j += 2
                continue
            k = j + 1
            while k < len(s) and s[k].isspace():
                k += 1
            return j + 1 if ends(s, k, j + 1) else None
        j += 1
    return None


def scan(s, style, sep=None):
    """One pass, character by character."""
    kind = lambda k: bool(re.match(r'"?\[[A-Za-z_]+\]\s', s[k:]))

    def boundary(k):  # of evidence: a run of separators and blanks, then a value or the end
        j = k
        while j < len(s) and (s[j] in "|;" or s[j].isspace()):
            j += 1
        return j == len(s) or kind(j)

    if style == "tokens":
        stop = lambda k: s[k].isspace() or s[k] in "|,;[]"
        ends = lambda t, k, j: k == len(t) or j < k or stop(k)
    elif style == "evidence":
        stop = lambda k: s[k] in "|;\n" and boundary(k)
        ends = lambda t, k, j: k == len(t) or t[k] in "|;\n" or kind(k)
    else:
        stop = lambda k: s.startswith(sep, k)
        ends = lambda t, k, j: k == len(t) or t.startswith(sep, k) or (sep == "\n" and "\n" in t[j:k])
    out, i = [], 0
    while i < len(s):
        if s[i].isspace() or stop(i) or (style == "evidence" and s[i] in "|;"):
            i += len(sep) if sep and s.startswith(sep, i) else 1
            continue
        end = quoted(s, i, ends)
        if end:
            item = s[i + 1 : end - 1].replace('""', '"').strip()
        else:
            end = i
            while end < len(s) and not stop(end):
                end += 1
            item = s[i:end].strip()
        if item and item != "/":
            out.append(item)
        i = end
    return out


@pytest.mark.parametrize(("tab", "field", "style"), [("agencies", "tiktok_evidence", "evidence"), ("agency_scorecard", "qualifying_client_domains", "tokens"), ("results", "gtm_ids", "tokens")])
def test_whole_tables_against_a_scanner(spark, sf, tab, field, style):
    df = spark.read.parquet(f"{sf}/{tab}.parquet")
    row = df.columns[0]
    want = {r[0]: scan(r[1], style) for r in df.select(row, field).collect() if r[1] and r[1].strip()}
    got = {k: [] for k in want}
    for r in split_packed(df, field, row, style).orderBy("row_id", "pos").collect():
        got[r.row_id].append(r.item)
    assert got == want


def test_notes_against_every_separator(spark, sf):
    """Each note string is what the scanner makes of it with one of the separators, and key=values are never joined."""
    df = spark.read.parquet(f"{sf}/agencies.parquet")
    notes = {r.agency_row: r.notes for r in df.collect() if r.notes and r.notes.strip()}
    got = {k: [] for k in notes}
    for r in split_packed(df, "notes", "agency_row", "notes").orderBy("row_id", "pos").collect():
        got[r.row_id].append(r.item)
    for k, s in notes.items():
        assert got[k] in [scan(s, "notes", sep) for sep in ("\n", "||", "|", ";")]
        assert not any(re.search(r"[|;]\s*[a-z_]+=", x) for x in got[k])


def test_very_long_strings(spark):
    """Patterns must not recurse by the length of a string."""
    n = 40_000
    rows = [
        (1, f"{K}" + "a; b | c " * n), (2, '"' + 'x ""y"" | ' * n + '" | a=1'), (3, "word; " * n + "| a=1"), (4, f' || {K}x' * n), (5, '"' * (2 * n + 1)),
        (6, "| " * n), (7, "y" * (10 * n)),
    ]
    df = spark.createDataFrame(rows, "id bigint, v string")
    for style in ("tokens", "evidence", "notes"):
        got = {r.row_id: r.n for r in split_packed(df, "v", "id", style).groupBy("row_id").count().withColumnRenamed("count", "n").collect()}
        assert got[7] == 1 and 6 not in got
        if style == "evidence":
            assert got[1] == 1 and got[4] == n
        if style == "notes":
            assert got[2] == 2 and got[3] == 2


def test_brackets_and_malformed(spark):
    """A bracketed value keeps the separators inside it; brackets around the whole string enclose a list; what has no
    partner is an ordinary mark."""
    cases = {
        "[GTM-A; GTM-B]": ["GTM-A", "GTM-B"], "GTM-A; [GTM-B, left]; GTM-C": ["GTM-A", "GTM-B, left", "GTM-C"], "[GTM-A] [GTM-B]": ["GTM-A", "GTM-B"],
        '["a b"]': ["a b"], "GTM-A, [GTM-B": ["GTM-A", "GTM-B"], "GTM-A], GTM-B": ["GTM-A", "GTM-B"], "[]": [], '"a;b" ; "c': ["a;b", '"c'], '["x", y]': ["x", "y"],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i bigint, v string")
    got = {}
    for r in split_packed(df, "v", "i", "tokens").orderBy("row_id", "pos").collect():
        got.setdefault(r.row_id, []).append((r.item, r.malformed))
    for i, (text, want) in enumerate(cases.items()):
        assert [x for x, _ in got.get(i, [])] == want, text
    assert got[7][1] == ('"c', True)
