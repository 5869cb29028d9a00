"""Several values packed in one field: one row a value, position kept.

A list is read by a grammar of ordered alternatives for each item: a quoted value (which must end before a separator,
a closing bracket or the end; else the parser goes back and reads the quote as an ordinary character), a bracketed
value (one pair of brackets around one value, separators inside included, before a separator or the end; else the
brackets are read as ordinary marks), a bare value. Which characters separate depends on the style:

* ``tokens``   values without blanks, such as ids and domains: blanks, | , ; and a spaced / separate; brackets
  around the whole string enclose the list;
* ``evidence`` values of the shape ``[kind] url :: context``: a run of | or ;, or a line end, separates
  when another such value, or nothing, follows it (its brackets belong to the value);
* ``notes``    ``key=value`` items and remarks: one separator a string. The list is an ordered choice too: by line
  ends, by ||, by | or by ;, each behind a predicate that must hold for the whole string.

Defined results: NULL and blank strings give no row; empty values are dropped and not counted;
repeated values are kept; very long strings are read whole. ``malformed`` is true on a value that starts
with a quote which never closes properly (it is then kept bare, as stored).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.operators.peg import BLANK, END, QUOTED, Peg, chars, runs, token


def _list_of(boundary: Peg, bare: Peg, bracketed: Peg | None = None) -> str:
    """Pattern for one item behind blanks: quoted and then a boundary, bracketed and then a boundary, else bare."""
    ends = (BLANK + boundary).ahead()
    item = QUOTED + ends
    if bracketed is not None:
        item = item / (bracketed + ends)
    return (BLANK + (item / bare)).java


# Blanks, pipes, commas and semicolons separate; brackets only enclose. A lone slash is dropped later.
_TOKEN_STOP = r"\s|,;\[\]"
#: One value in brackets of its own: no bracket within, and something beside it in the list.
_BRACKETED = token(r"\[(?:[^\[\]\"]++|\"[^\"]*+\")++\]")
_TOKENS = _list_of(chars(_TOKEN_STOP) / END, runs("^" + _TOKEN_STOP, 1), _BRACKETED)
#: Brackets around the whole string.
_ENCLOSED = r"^\s*+\[([^\[\]]*+)\]\s*+$"

_KIND = token(r'"?+\[[A-Za-z_]++\]\s')
_EVIDENCE_SEP = chars(r"|;\n")
#: A run of separators before the next value or the end; elsewhere the characters belong to the value.
_EVIDENCE_END = runs(r"|;\s", 1) + (_KIND / END)
_EVIDENCE = _list_of(
    END / _EVIDENCE_SEP / _KIND,
    (runs(r"^|;\n", 1) / (_EVIDENCE_END.absent() + _EVIDENCE_SEP)).many(1),
)


def _notes(sep: str) -> str:
    """Bare items run to the separator; a quoted one must stand before it or the end."""
    stop, lead = token(sep), sep[:2] if sep[0] == "\\" else sep[0]
    rest = runs("^" + lead, 1) / (stop.absent() + chars(lead))  # half a separator belongs to the value
    return _list_of(stop / END, chars(lead).absent() + rest.many(1))


# The separators of notes, tried in this order once quoted values are out of the way.
_NOTE_SEPS = {"line": r"\n", "pipes": r"\|\|", "pipe": r"\|", "semi": r";"}


def note_separator(s: Column) -> Column:
    """Name of the one separator of a note string.

    Line ends win; || wins unless a tight single | shows that it is an empty value between two pipes;
    between | and ; the one that borders on a key=value wins, | when neither or both do.
    """
    bare = F.regexp_replace(s, QUOTED.java, "Q")
    body = F.regexp_replace(bare, r"^\s+|\s+$", "")
    key = r'\s*+"?[A-Za-z_]++='
    semi_key = body.rlike(rf";{key}") | body.rlike(r"(?:^|;)\s*+[A-Za-z_]++=[^;|]*+;")
    pipe_key = body.rlike(rf"\|{key}") | body.rlike(r"(?:^|\|)\s*+[A-Za-z_]++=[^;|]*+\|")
    quoted_semi, quoted_pipe = body.rlike(r"Q\s*+;|;\s*+Q(?![A-Za-z])"), body.rlike(r"Q\s*+\||\|\s*+Q(?![A-Za-z])")
    return (
        F.when(body.contains("\n"), "line")
        .when(body.contains("||") & ~body.rlike(r"[^\s|]\|[^\s|]"), "pipes")
        .when(body.contains("|") & body.contains(";"), F.when((semi_key | quoted_semi) & ~(pipe_key | quoted_pipe), "semi").otherwise("pipe"))
        .when(body.contains("|"), "pipe")
        .when(body.contains(";"), "semi")
        .otherwise("line")
    )


def packed_items(value: Column, style: str) -> Column:
    """Array of (item, malformed) of a packed string, in order, empties dropped."""

    def cut(pattern: str) -> Column:
        return F.regexp_extract_all(value, F.lit(pattern), F.lit(0))

    if style == "tokens":
        inner = F.when(value.rlike(_ENCLOSED), F.regexp_extract(value, _ENCLOSED, 1)).otherwise(value)
        raw = F.regexp_extract_all(inner, F.lit(_TOKENS), F.lit(0))
    elif style == "evidence":
        raw = cut(_EVIDENCE)
    elif style == "notes":
        sep = note_separator(value)
        raw = F.lit(None).cast("array<string>")
        for name, pattern in _NOTE_SEPS.items():
            raw = F.when(sep == name, cut(_notes(pattern))).otherwise(raw)
    else:
        raise ValueError(f"style {style!r}")

    def clean(x: Column) -> Column:
        x = F.regexp_replace(x, r"^\s+|\s+$", "")
        if style == "tokens":
            x = F.regexp_replace(F.regexp_replace(x, r"^\[([^\[\]]*+)\]$", "$1"), r"^\s+|\s+$", "")
        whole = x.rlike("^" + QUOTED.java + r"\z")
        inner = F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), '""', '"')
        return F.struct(
            F.when(whole, F.regexp_replace(inner, r"^\s+|\s+$", "")).otherwise(x).alias("item"),
            (x.startswith('"') & ~whole).alias("malformed"),
        )

    return F.filter(F.transform(raw, clean), lambda s: ~s["item"].isin("", "/"))


def split_packed(df: DataFrame, field: str, row_id: str, style: str, name: str | None = None) -> DataFrame:
    """(field_name, row_id, pos, item, malformed) of one packed field."""
    got = df.select(F.col(row_id).alias("row_id"), F.col(field).alias("_value")).filter(F.trim("_value") != "")
    got = got.select("row_id", F.posexplode(packed_items(F.col("_value"), style)).alias("pos", "_s"))
    return got.select(
        F.lit(name or field).alias("field_name"), "row_id", (F.col("pos") + 1).cast("int").alias("pos"),
        F.col("_s.item").alias("item"), F.col("_s.malformed").alias("malformed"),
    )
