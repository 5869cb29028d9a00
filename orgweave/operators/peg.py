"""Parsing expression grammars, compiled to Java regular expressions.

A PEG's choice is ordered and, once an alternative has matched, is not reopened; its repetition is
greedy and gives nothing back. Java's atomic groups and possessive quantifiers have the same meaning, so a
grammar without recursion becomes one pattern that Spark runs inside codegen, without a Python worker.
"""

from __future__ import annotations

import re


class Peg:
    def __init__(self, java: str):
        self.java = java

    def __add__(self, other: Peg) -> Peg:
        """Sequence."""
        return Peg(self.java + other.java)

    def __truediv__(self, other: Peg) -> Peg:
        """Ordered choice."""
        return Peg(f"(?>{self.java}|{other.java})")

    def many(self, least: int = 0) -> Peg:
        return Peg(f"(?:{self.java}){'*' if least == 0 else '+'}+")

    def maybe(self) -> Peg:
        return Peg(f"(?:{self.java})?+")

    def ahead(self) -> Peg:
        """And-predicate: matches here, consumes nothing."""
        return Peg(f"(?={self.java})")

    def absent(self) -> Peg:
        """Not-predicate."""
        return Peg(f"(?!{self.java})")


def text(s: str) -> Peg:
    return Peg("".join(f"\\x{ord(c):02x}" if not c.isalnum() else c for c in s))


def chars(cls: str) -> Peg:
    """One character of a class, given as inside [...]."""
    return Peg(f"[{cls}]")


def runs(cls: str, least: int = 0) -> Peg:
    return Peg(f"[{cls}]{'*' if least == 0 else '+'}+")


def token(java: str) -> Peg:
    re.compile(java.replace("*+", "*").replace("++", "+"))  # a typo fails here, not on an executor
    return Peg(java)


END = Peg(r"\z")
ANY = Peg(r"[\s\S]")
BLANK = runs(r"\s")
#: A quoted value: doubled quotes stand for one.
QUOTED = Peg(r'"[^"]*+(?:""[^"]*+)*+"')
