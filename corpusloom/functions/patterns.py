"""User regexes: validated once at plan time, then handed to the JVM as literals."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark import SparkContext
from pyspark.sql import Column, functions as F

# Letters, digits, groups, quantifiers and word edges only: such a match holds no blank, so it can
# never reach over a sentence boundary.
_WITHIN_WORDS = re.compile(r"(?:\w|[|()?*+'-]|\(\?:|\[\w+\]|\\b|\\w)+")


_QUANTIFIER = re.compile(r"\{(\d*)(,?)(\d*)\}")
_FLAGS = re.compile(r"\(\?([aiLmsux]+)(-[imsx]+)?(:|\))")
_ESCAPES = {"Z": r"\z", "v": r"\x0B"}


def validate(patterns: Iterable[str]) -> None:
    """Check every pattern as a Python one and, translated, with the JVM that will run it."""
    context = SparkContext._active_spark_context
    for pattern in patterns:
        try:
            re.compile(pattern)
        except re.error as error:
            raise ValueError(f"not a regular expression: {pattern}") from error
        translated = java_regex(pattern)
        if context is not None:
            try:
                context._jvm.java.util.regex.Pattern.compile(translated)
            except Exception as error:
                raise ValueError(f"regular expression cannot be run by Spark: {pattern}") from error


def java_regex(pattern: str, case_sensitive: bool = False) -> str:
    """The same pattern in Java syntax: Unicode classes, only ``\\n`` ends a line and, by default, any case."""
    return ("(?Ud)" if case_sensitive else "(?iUd)") + f"(?:{_translated(pattern)})"


def _translated(pattern: str) -> str:
    """Python's syntax in Java's, for what the two write or read differently."""
    out, i, names = [], 0, {}
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            text, i = _escape(pattern, i)
            out.append(text)
        elif c == "[":
            text, i = _character_class(pattern, i)
            out.append(text)
        elif c == "{":
            m = _QUANTIFIER.match(pattern, i)
            if m and out and (m[1] or (m[2] and m[3])):
                out.append("{" + (m[1] or "0") + m[2] + m[3] + "}")
                i = m.end()
            elif m and out and m[2]:  # {,} is {0,}
                out.append("{0,}")
                i = m.end()
            else:
                out.append("\\{")
                i += 1
        elif pattern.startswith("(?P<", i):
            end = pattern.index(">", i)
            names[pattern[i + 4 : end]] = new = f"g{len(names)}"  # Java's names have no underscore
            out.append(f"(?<{new}>")
            i = end + 1
        elif pattern.startswith("(?P=", i):
            end = pattern.index(")", i)
            out.append(f"\\k<{names[pattern[i + 4 : end]]}>")
            i = end + 1
        elif pattern.startswith("(?#", i):
            i = pattern.index(")", i) + 1
        elif pattern.startswith("(?(", i):
            raise ValueError(f"conditions are not supported: {pattern}")
        elif m := _FLAGS.match(pattern, i):
            if set(m[1]) & set("aLx"):
                raise ValueError(f"flags a, L and x are not supported: {pattern}")
            letters = m[1].replace("u", "")
            out.append(f"(?{letters}{m[2] or ''}{m[3]}" if letters or m[2] or m[3] == ":" else "")
            i = m.end()
        else:
            out.append(c)
            i += 1
    return "".join(out)


def _escape(pattern: str, i: int) -> tuple[str, int]:
    c = pattern[i + 1]
    if c == "0":
        m = re.compile(r"\\0[0-7]{0,2}").match(pattern, i)
        return f"\\x{int(m[0][1:], 8):02x}", m.end()
    if c == "U":
        return "\\x{" + pattern[i + 2 : i + 10] + "}", i + 10
    return _ESCAPES.get(c, pattern[i : i + 2]), i + 2


def _character_class(pattern: str, i: int) -> tuple[str, int]:
    """A class with every character that Java would read as a nested class or an intersection escaped."""
    start = i + (2 if pattern.startswith("[^", i) else 1)
    out, i = [pattern[i:start]], start
    while pattern[i] != "]" or i == start:
        if pattern[i] == "\\":
            text, i = _escape(pattern, i)
            out.append("\\x08" if text == "\\b" else text)
        else:
            out.append("\\" + pattern[i] if pattern[i] in "[]&^" else pattern[i])
            i += 1
    return "".join(out) + "]", i + 1


def stays_within_words(pattern: str) -> bool:
    return bool(_WITHIN_WORDS.fullmatch(pattern)) and re.compile(pattern).fullmatch("") is None


def sql_literal(text: str) -> str | None:
    """``text`` as a raw SQL string, in which nothing is an escape; None when both quotes occur in it."""
    for quote in ("'", '"'):
        if quote not in text:
            return f"r{quote}{text}{quote}"
    return None


def match_count(text: Column, pattern: str, case_sensitive: bool = False) -> Column:
    """Number of non-overlapping matches."""
    return F.regexp_count(text, F.lit(java_regex(pattern, case_sensitive)))
