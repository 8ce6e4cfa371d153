"""Column builders for text: trimming, inserting, deleting, tokens, patterns with named classes, composite dates and values."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named character classes of POSIX patterns.
CLASSES = {
    "alpha": "A-Za-z", "digit": "0-9", "alnum": "A-Za-z0-9", "upper": "A-Z", "lower": "a-z", "space": r" \t\n\r\f\x0B", "blank": r" \t",
    "punct": r"!-/:-@\[-`{-~", "xdigit": "0-9A-Fa-f", "cntrl": r"\x00-\x1F\x7F", "print": r"\x20-\x7E", "graph": r"\x21-\x7E",
}


def posix_pattern(pattern: str) -> str:
    """A pattern with ``[:name:]`` classes in the syntax of Spark's regular expressions."""
    return re.sub(r"\[:(\w+):\]", lambda m: CLASSES[m[1]], pattern)


def matches(text: Column, pattern: str) -> Column:
    """All matches of a POSIX pattern."""
    return F.regexp_extract_all(text, F.lit(f"({posix_pattern(pattern)})"), F.lit(1))


def chop(text: Column) -> Column:
    """Without white space at the end."""
    return F.regexp_replace(text, r"\s+$", "")


def insert(text: Column, at: int, what: str) -> Column:
    """``what`` before place ``at``, from 0."""
    return F.concat(F.substring(text, 1, at), F.lit(what), F.substring(text, at + 1, 1 << 30))


def delete(text: Column, at: int, count: int) -> Column:
    """Without ``count`` letters from place ``at`` on."""
    return F.concat(F.substring(text, 1, at), F.substring(text, at + count + 1, 1 << 30))


def tokens(text: Column, separators: str = " \t\n") -> Column:
    """The parts between any of the separators, empty ones left out."""
    return F.filter(F.split(text, f"[{re.escape(separators)}]+"), lambda t: t != "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"\S")


class Composite:
    """Named decoders of values that are made of several parts, such as dates."""

    known: dict[str, Callable[[Column], Column]] = {}

    @classmethod
    def register(cls, name: str, decode: Callable[[Column], Column]) -> None:
        cls.known[name] = decode

    @classmethod
    def decode(cls, name: str, value: Column) -> Column:
        if name not in cls.known:
            raise ValueError(f"no decoder is registered for {name}")
        return cls.known[name](value)


def date_seconds(form: str) -> Callable[[Column], Column]:
    """A decoder of dates in a format to seconds since 1970; null where the text isn't one."""
    return lambda value: F.unix_timestamp(F.try_to_timestamp(value, F.lit(form)))


Composite.register("date", date_seconds("yyyy-MM-dd"))
Composite.register("timestamp", date_seconds("yyyy-MM-dd HH:mm:ss"))
Composite.register("us-date", date_seconds("MM/dd/yyyy"))
