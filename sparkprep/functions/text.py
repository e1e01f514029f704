"""Text expressions with Python ``str`` semantics on the JVM.

Python's ``str.strip()`` / ``re.sub(r"\\s+", ...)`` treat every Unicode
whitespace character plus U+001C..U+001F as space; Spark's ``trim`` strips
only U+0020 and Java's ``\\s`` is ASCII-only unless ``(?U)`` is set.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _python_whitespace() -> str:
    """Every character Python's ``str.isspace()`` accepts (the set that
    ``str.strip()`` and ``re``'s ``\\s`` use), derived from Python itself."""
    import sys

    return "".join(chr(cp) for cp in range(sys.maxunicode + 1) if chr(cp).isspace())


PY_WHITESPACE = _python_whitespace()
# Java's Unicode White_Space class plus the four information separators is
# the same set; with (?U) this is the fastest exact form we measured.
_WS_RUN = r"(?U)[\s\x1c-\x1f]+"


def py_strip(c: Column) -> Column:
    """``str.strip()``: Spark's ``trim(BOTH chars FROM s)`` with the exact
    whitespace set (no regex)."""
    return F.trim(c, F.lit(PY_WHITESPACE))


def py_collapse_whitespace(c: Column) -> Column:
    """``re.sub(r"\\s+", " ", s).strip()``: after the runs are collapsed only
    U+0020 can remain at the ends, so a plain space trim finishes it."""
    return F.trim(F.regexp_replace(c, _WS_RUN, " "))


_COMBINING_CLASS: str | None = None


def _combining_pattern() -> str:
    """RE2 character class of every code point with a non-zero canonical
    combining class, built once per worker from ``unicodedata``."""
    global _COMBINING_CLASS
    if _COMBINING_CLASS is None:
        import sys

        ranges: list[list[int]] = []
        for cp in range(sys.maxunicode + 1):
            if unicodedata.combining(chr(cp)):
                if ranges and ranges[-1][1] == cp - 1:
                    ranges[-1][1] = cp
                else:
                    ranges.append([cp, cp])
        parts = [f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges]
        _COMBINING_CLASS = "[" + "".join(parts) + "]+"
    return _COMBINING_CLASS


@F.pandas_udf(T.StringType())
def _strip_accents_udf(s: pd.Series) -> pd.Series:
    """NFKD, then one RE2 pass that deletes combining marks, both over the
    whole batch."""
    import pyarrow as pa
    import pyarrow.compute as pc

    split = pc.utf8_normalize(pa.Array.from_pandas(s, type=pa.string()), form="NFKD")
    out = pc.replace_substring_regex(split, pattern=_combining_pattern(), replacement="")
    return out.to_pandas()


def remove_accents(c: Column) -> Column:
    """NFKD, then drop combining marks.

    Spark has no Unicode normaliser, so non-ASCII values go through one
    Arrow-batched pandas UDF. Python UDFs are evaluated outside conditional
    expressions, so ASCII rows are passed as null (nothing to ship) and
    keep their value through ``coalesce``.
    """
    return F.coalesce(_strip_accents_udf(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c)


def python_repl_to_java(repl: str) -> str:
    """Translate a Python ``re.sub`` replacement into Java's syntax."""
    out = []
    i = 0
    while i < len(repl):
        ch = repl[i]
        if ch == "\\" and i + 1 < len(repl):
            nxt = repl[i + 1]
            if nxt.isdigit():
                j = i + 1
                while j < len(repl) and repl[j].isdigit() and j < i + 3:
                    j += 1
                out.append("$" + repl[i + 1 : j])
                i = j
                continue
            if nxt == "g" and i + 2 < len(repl) and repl[i + 2] == "<":
                end = repl.index(">", i + 3)
                out.append("${" + repl[i + 3 : end] + "}" if not repl[i + 3 : end].isdigit() else "$" + repl[i + 3 : end])
                i = end + 1
                continue
            simple = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\\\"}
            if nxt in simple:
                out.append(simple[nxt])
                i += 2
                continue
            out.append("\\\\" + nxt)
            i += 2
            continue
        if ch == "$":
            out.append("\\$")
        else:
            out.append(ch)
        i += 1
    return "".join(out)


def python_pattern_to_java(pattern: str) -> str:
    """Python 3 ``str`` patterns are Unicode-aware by default; Java's are not."""
    return "(?U)" + pattern.replace("(?P<", "(?<").replace("(?P=", "\\k<")
