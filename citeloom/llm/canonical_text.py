"""One consistent form for text that only looks the same.

Method: a longest-match transducer over grapheme clusters, compiled once from a mapping that is built by
rules and checked for conflicts, rewrites widths, spaces, invisible characters, ligatures, separate
accents and look-alike letters in one pass.  Look-alikes are rewritten only inside a word that holds a
Latin letter, so whole words of another script, and Greek letters used as symbols, stay as they are.

Text of plain characters never leaves the JVM: a regular expression keeps everything else from Python.

Defined results: null stays null, empty stays empty; the result is a fixed point (applying the operator
again changes nothing); very long texts are processed whole.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that are invisible, and spaces other than U+0020 (tab and line ends are no case).
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# Letters that pass for Latin ones.
LOOK_ALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o",
    "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ӏ": "l", "Ӏ": "I", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p", "υ": "u", "κ": "k", "χ": "x", "γ": "y",
    # Armenian
    "ո": "n", "ս": "u", "օ": "o", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Տ": "S", "Լ": "L",
    # Latin letters of phonetic alphabets
    "ɡ": "g", "ɑ": "a", "ı": "i",
}
_MARK = "\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f"
_FOREIGN = "".join(LOOK_ALIKES)
#: Java and Python agree on this class: a text without any of these characters is already in form.
SUSPECT = f"[{INVISIBLE}{SPACES}\uff01-\uff5e\uffe0-\uffe6\ufb00-\ufb06\ufe00-\ufe0f{_MARK}{_FOREIGN}]"


class Conflict(ValueError):
    """Two rules give one key different results, or a result would itself be rewritten."""


def compile_rules(*tables: dict[str, str]) -> dict:
    """A trie (nested dicts, result under '') of all tables' keys; raises Conflict where they disagree."""
    merged: dict[str, str] = {}
    for t in tables:
        for key, value in t.items():
            if merged.setdefault(key, value) != value:
                raise Conflict(f"{key!r}: {merged[key]!r} or {value!r}")
    for key, value in merged.items():
        if any(c in merged for c in value):
            raise Conflict(f"{key!r} gives {value!r}, which is rewritten again")
    trie: dict = {}
    for key, value in merged.items():
        node = trie
        for c in key:
            node = node.setdefault(c, {})
        node[""] = value
    return trie


def _widths() -> dict[str, str]:
    out = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    return out | {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFFE0, 0xFFE7) if c != 0xFFE3}


def _accents() -> dict[str, str]:
    """Canonical decompositions of letters up to U+1FFF, from the Unicode data that Python carries."""
    out = {}
    for c in map(chr, range(0xC0, 0x2000)):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and unicodedata.normalize("NFC", parts) == c and all(unicodedata.combining(x) for x in parts[1:]):
            out[parts] = c
            out.setdefault(unicodedata.normalize("NFC", parts[:-1]) + parts[-1], c)
    return out


WIDTHS = _widths()
ACCENTS = _accents()
SIMPLE = WIDTHS | dict.fromkeys(SPACES, " ") | dict.fromkeys(INVISIBLE, "") | {chr(c): "" for c in range(0xFE00, 0xFE10)} | {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFB00, 0xFB07)}
# Inside Latin words the look-alikes join; an accented full-width or look-alike letter composes as its plain form does.
_BASES = SIMPLE | LOOK_ALIKES


def _with_bases(bases: dict[str, str]) -> dict[str, str]:
    by_plain: dict[str, list[str]] = {}
    for variant, plain in bases.items():
        by_plain.setdefault(plain, []).append(variant)
    return {v + parts[1:]: c for parts, c in ACCENTS.items() for v in by_plain.get(parts[0], ()) if len(parts) > 1}


ANYWHERE = compile_rules(SIMPLE, ACCENTS, _with_bases(SIMPLE))
# Greek small letters that serve as symbols next to a Latin one; they pass for Latin only in longer words.
SYMBOLS = "ιαρυκχγ"
_SHORT_BASES = {k: v for k, v in _BASES.items() if k not in SYMBOLS}
IN_LATIN_WORD = compile_rules(_BASES, {k: v for k, v in ACCENTS.items() if k[0] not in LOOK_ALIKES}, _with_bases(_BASES))
IN_SHORT_WORD = compile_rules(_SHORT_BASES, {k: v for k, v in ACCENTS.items() if k[0] not in _SHORT_BASES}, _with_bases(_SHORT_BASES))

_WORD = regex.compile(rf"[\p{{L}}\p{{M}}{INVISIBLE}]+|{SUSPECT}")
_HAS_SUSPECT = regex.compile(SUSPECT)
_LATIN = regex.compile(r"[\p{Latin}--[ɡɑı]]", regex.V1)
_SPLIT_MARKS = regex.compile(rf"[{INVISIBLE}]+(?=[{_MARK}])")


def _run(trie: dict, s: str) -> str:
    out, i, n = [], 0, len(s)
    while i < n:
        node, best, end, j = trie, None, i, i
        while j < n and (node := node.get(s[j])) is not None:
            j += 1
            if "" in node:
                best, end = node[""], j
        if best is None:
            out.append(s[i])
            i += 1
        else:
            out.append(best)
            i = end
    return "".join(out)


def canonical(text: str | None) -> str | None:
    """The one form of ``text``."""
    if not text or text.isascii() or not _HAS_SUSPECT.search(text):
        return text

    def word(m: regex.Match) -> str:
        w = m.group()
        if not _HAS_SUSPECT.search(w):
            return w
        w = _SPLIT_MARKS.sub("", w)
        latin = len(_LATIN.findall(w))
        trie = IN_LATIN_WORD if latin > 2 else IN_SHORT_WORD if latin else ANYWHERE
        while (new := _run(trie, w)) != w:
            w = new
        return w

    return _WORD.sub(word, text)


def suspicious(text: str | None) -> bool:
    """Whether a field is a case: some character is not in the one form.

    A mark that composes with nothing stays in the text but is a case all the same.
    """
    return bool(text) and not text.isascii() and (canonical(text) != text or regex.search(f"[{_MARK}]", text) is not None)


@F.pandas_udf(T.StringType())
def _canonical_udf(s: pd.Series) -> pd.Series:
    return s.map(canonical, na_action="ignore")


@F.pandas_udf(T.BooleanType())
def _suspicious_udf(s: pd.Series) -> pd.Series:
    return s.map(suspicious).astype(bool)


def may_need_it(c: Column) -> Column:
    """Whether a value has a suspicious character; plain ASCII is told by its length in bytes, without a search."""
    return (F.octet_length(c) != F.length(c)) & c.rlike(SUSPECT)


def canonical_column(c: Column) -> Column:
    """``c`` in its one form; only suspicious values cross to Python."""
    return F.coalesce(_canonical_udf(F.when(may_need_it(c), c)), c)


def cases(df: DataFrame, tbl: str, key: str, text: Column) -> DataFrame:
    """``(tbl, row_key)`` of the rows whose text is not in its one form, redelivered rows once."""
    rows = df.select(F.lit(tbl).alias("tbl"), F.col(key).cast("long").alias("row_key"), text.alias("_text"))
    return rows.filter(may_need_it(F.col("_text"))).filter(_suspicious_udf("_text")).select("tbl", "row_key")
