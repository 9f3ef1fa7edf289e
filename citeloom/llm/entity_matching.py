"""Matching reference entries with source records: a cascade of deterministic rules.

Method
    The rules are exact joins on combinations of attributes, ever weaker, in three passes (PASSES).  In the
    first pass equal titles with an equal author and no contradicting year decide by themselves; what the other
    rules join must pass the exact check ``agree``, which reads titles, authors and years and nothing else.
    What a pass resolves, an entry for a service, leaves the cascade by an anti-join before the next pass,
    and of several rules that resolve the same the strongest counts.  Records of one publication at one
    service that the same rule finds all match.

    Confidence is the rule's precision on labelled pairs.  The labels come from attributes that neither rules
    nor check read: where both sides have a volume and a first page, a pair is true if both agree and false if
    neither does.  They are counted over all pairs a rule accepts, and the precision is smoothed,
    (true + a) / (true + false + a + b).

    No key stands for an author alone: it takes a second author, a word at an edge of the title or, for an
    entry without a title, the year.

    What an entry's csl lacks of title, authors and year is read off its raw_text before the keys are built.
    A title read that way may be cut wrongly, so the work's title is also looked for in the whole raw_text.

    Keys that many rows share (a title such as "Editorial") only count together with a name or a year.
    Redelivered rows and exact copies of an entry's matching attributes join as one representative.

Defined results: an entry without title and authors, in csl and raw_text, matches nothing; null attributes neither help nor
contradict; repeated rows of a key count once; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.canonical_text import canonical_column
from citeloom.llm.name_variants import close_tokens
from citeloom.session import materialize


@dataclass(frozen=True)
class Params:
    prior_true: float = 2.0
    prior_false: float = 1.0
    sure_title: float = 0.86
    fair_title: float = 0.7
    shared_words: float = 0.45
    poor_title: float = 0.6  # with all authors and the year the same


#: The passes, each with its rules from strong to weak: attributes that must be equal.  A rule's number is its place.
PASSES: tuple[tuple[tuple[str, ...], ...], ...] = (
    (("title", "first author", "year"), ("title", "any author"), ("title of four words",)),
    (("pair of authors",), ("any author", "edge word of title"), ("any author", "year within one", "no title")),
    (("three words of title", "year"), ("four words of title",)),
)
RULE_NAMES = [" + ".join(r) for rules in PASSES for r in rules]
# Words that tell titles apart too little to be part of a phrase.
STOP_WORDS = frozenset("a an the of in on for with to and or from by as at is does do study case approach evidence towards toward using".split())
PARTICLES = "van|von|der|den|de|di|da|du|del|della|la|le|ter|ten|zu"
# Accented small letters and their plain forms, from the Unicode data that Python carries.
_ACCENTED = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xE0, 0x250) if chr(c).islower() and unicodedata.normalize("NFD", chr(c))[0] in "abcdefghijklmnopqrstuvwxyz"} | {"ø": "o", "ł": "l", "đ": "d"}


def _plain(c: Column) -> Column:
    """Lower case without accents; ASCII, told by its length in bytes, skips the table of accents."""
    low = F.replace(F.lower(c), F.lit("&"), F.lit(" and "))
    bare = F.translate(F.regexp_replace(F.replace(low, F.lit("ß"), F.lit("ss")), r"\p{M}+", ""), "".join(_ACCENTED), "".join(_ACCENTED.values()))
    return F.when(F.octet_length(c) == F.length(c), low).otherwise(bare)


def _families(author: Column) -> Column:
    """Family names without blanks, joined by '|'.

    Of a literal what stands before a comma, or its last word with particles.  The whole list is one string
    while it is rewritten (a literal is marked '~'), so that every step is one compiled expression.
    """
    of = lambda a: F.coalesce(F.when(F.trim(a["family"]) != "", a["family"]), F.concat(F.lit("~"), a["literal"]))
    s = _plain(F.concat_ws("|", F.transform(author, of)))
    named = F.regexp_replace(s, r"~([^|,]*),[^|]*", "$1")
    named = F.regexp_replace(named, r"(~[^|]*?)(?:\s+\p{L}\.?)+\s*(?=\||$)", "$1")
    named = F.regexp_replace(named, rf"~(?:[^|]*?[\s.])?((?:(?:{PARTICLES})\s+)*[^\s.|~]+)\s*(?=\||$)", "$1")
    s = F.when(F.contains(s, F.lit("~")), named).otherwise(s)
    s = F.regexp_replace(s, r"[^a-z0-9|]+", "")
    return F.regexp_replace(F.regexp_replace(s, r"(?<=^|\|)[a-z0-9]?(?:\||$)", ""), r"\|$", "")


# Notes that stand anywhere in an entry and belong to no field.
_NOTES = r"(?i)\[[^\]]*\]\.?\s*|\bet al\b\.?|\b(?:reprinted|special issue|in press|epub ahead of print|accessed [^.]*)(?:\.|$)"
# The part before a year that stands before the title, and the text behind it.
_DATED = r"^(.+?)[(,.\s]\s*(?:19|20)\d{2}[a-z]?\s*[).]+[:.]?\s*(\p{L}.*)$"
_UNDATED = r"^(.+?)\.\s+(.+)$"


def read_off(raw: Column) -> tuple[Column, Column, Column]:
    """(title, author, issued) of an entry's text, in the shape of csl; null where it is not there.

    The title is quoted, or stands behind the year, or behind the authors; a year is no part of a range of pages
    nor of a date in words.
    """
    s = F.regexp_replace(raw, _NOTES, "")
    part = lambda pattern, i: F.nullif(F.regexp_extract(s, pattern, i), F.lit(""))
    rest = F.coalesce(part(_DATED, 2), part(_UNDATED, 2))
    sentence = F.coalesce(F.nullif(F.regexp_extract(rest, r"^(.+?)[.?!]\s+(?=\p{Lu})", 1), F.lit("")), rest)
    title = F.coalesce(part(r'[“"](.+?)[”"]', 1), sentence, raw)
    head = F.coalesce(part(r'^(.+?)[“"]', 1), part(_DATED, 1), part(_UNDATED, 1))
    names = F.transform(F.split(head, r"[,;&]|\band\b"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"\s+(?:\p{Lu}[.\s]*){1,4}$|\.$", "")))
    names = F.filter(names, lambda x: F.regexp_like(x, F.lit(r"\p{Ll}|\p{Lu}{4}")))
    none = F.lit(None).cast("string")
    family = lambda x: F.when(F.regexp_like(x, F.lit(rf"(?i)^(?:{PARTICLES})\s")), x)
    author = F.transform(names, lambda x: F.struct(family(x).alias("family"), none.alias("given"), x.alias("literal")))
    years = F.regexp_extract_all(raw, F.lit(r"(?<![\d\p{L}])(?<!\p{L}\s)(?<![-–]\s?)((?:19|20)\d{2})(?!\d|\s?[-–])"), F.lit(1))
    year = F.try_element_at(years, F.lit(-1)).cast("int")
    return title, author, F.when(year.isNotNull(), F.array(F.array(year)))


def _completed(df: DataFrame) -> DataFrame:
    """Entries with what csl lacks read off raw_text; raw: the text where the title or the authors were read."""
    title, author, issued = read_off(F.col("raw_text"))
    named = F.exists("author", lambda a: (F.length(F.trim(a["family"])) > 1) | (F.length(F.trim(a["literal"])) > 1))
    no_title, no_author = F.trim(F.coalesce("title", F.lit(""))) == "", ~F.coalesce(named, F.lit(False))
    return df.select(
        "id",
        F.when(no_title, title).otherwise(F.col("title")).alias("title"),
        F.when(no_author, author).otherwise(F.col("author")).alias("author"),
        F.when(F.expr("try_element_at(try_element_at(issued, 1), 1)").isNull(), issued).otherwise(F.col("issued")).alias("issued"),
        "volume",
        "page",
        "service",
        F.when(no_title | no_author, F.col("raw_text")).alias("raw"),
    )


def _words(c: Column) -> Column:
    return F.trim(F.regexp_replace(_plain(canonical_column(c)), r"[^\p{L}\p{N}]+", " "))


def _attributes(df: DataFrame) -> DataFrame:
    """df: id, title, author, issued, volume, page, service, raw -> id, title (plain words), families, year, volume, page, service, raw (plain words)."""
    title = _words(F.col("title"))
    return df.select(
        "id",
        F.coalesce(title, F.lit("")).alias("title"),
        F.coalesce(_families(F.col("author")), F.lit("")).alias("families"),
        F.expr("try_element_at(try_element_at(issued, 1), 1)").cast("int").alias("year"),
        "volume",
        F.nullif(F.regexp_extract("page", r"^\D*(\d+)", 1), F.lit("")).alias("page"),
        "service",
        *([_words(F.col("raw")).alias("raw")] if "raw" in df.columns else []),
    )


def _grams(s: str) -> set[str]:
    return {s[i : i + 3] for i in range(len(s) - 2)} or {s}


def title_score(a: list[str], b: list[str]) -> float | None:
    """Likeness of two titles on letter trigrams, 0 to 1; a cut title counts by containment; None if one is missing."""
    x, y = "".join(a), "".join(b)
    if not x or not y:
        return None
    if x == y:
        return 1.0
    g, h = _grams(x), _grams(y)
    both = len(g & h)
    dice = 2 * both / (len(g) + len(h))
    if min(len(x), len(y)) >= 20:
        return max(dice, 0.95 * both / min(len(g), len(h)))
    return dice


def held_score(title: list[str], raw: list[str]) -> float:
    """Likeness of a title with the text that should hold it, 0 to 1, by containment; short titles say nothing."""
    x = "".join(title)
    if len(x) < 20:
        return 0.0
    g = _grams(x)
    return 0.95 * len(g & _grams("".join(raw))) / len(g)


def _near(a: str, b: str) -> bool:
    if a == b:
        return True
    if a.endswith(b) or b.endswith(a):
        return min(len(a), len(b)) >= 5
    return close_tokens(a, b)


def author_score(a: list[str], b: list[str]) -> float | None:
    """Share of the shorter list found in the longer one; None if one is missing."""
    if not a or not b:
        return None
    short, long = (a, b) if len(a) <= len(b) else (b, list(a))
    return sum(any(_near(x, y) for y in long) for x in short) / len(short)


def agree(entry: dict, work: dict, p: Params) -> bool:
    """Whether title, authors and year of a candidate pair agree as far as they are there; nothing else is read."""
    ye, yw = entry["year"], work["year"]
    y = None if ye is None or yw is None else abs(ye - yw)
    if y is not None and y > 1:
        return False
    t = title_score(entry["words"], work["words"])
    held = held_score(work["words"], entry["raw"]) if t is not None and entry.get("raw") else 0.0
    if held > (t or 0.0):
        t, entry = held, {**entry, "words": work["words"]}
    generic = t is not None and min(len([w for w in s["words"] if w not in STOP_WORDS]) for s in (entry, work)) < 4
    if generic and (set(entry["words"]) <= set(work["words"]) or set(work["words"]) <= set(entry["words"])):
        t = 1.0
    if t is not None and t < p.poor_title:
        return False  # whatever the authors
    a = author_score(entry["families"], work["families"])
    if entry.get("raw") and work["families"]:  # blanks inside names come and go
        text = "".join(entry["raw"])
        named = sum(len(x) > 3 and x in text for x in work["families"]) / len(work["families"])
        a = max(a or 0.0, named) if a is not None or named >= 0.5 else None
    if (t is None and a is None) or (a is not None and a < 0.5):
        return False
    all_authors = a is not None and a >= 0.99
    if t is None:  # no title: several authors, all the same, in the same year
        return all_authors and y == 0 and len(entry["families"]) == len(work["families"]) > 1
    if t < p.fair_title or generic:
        return all_authors and (y is not None if t >= p.fair_title else y == 0)
    if t < p.sure_title:
        return all_authors
    return a is not None or y is not None or t >= 0.95


def _keys(df: DataFrame, number: int, near: bool) -> DataFrame:
    """(id, service, rule, k): hashed keys of one pass's rules; near: the side that is looked up by neighbouring years."""
    fam, year = F.col("f"), F.col("year")
    no = F.array().cast("array<struct<rule:int,k:bigint>>")
    key = lambda rule, *cs: F.struct(F.lit(rule).alias("rule"), F.xxhash64(F.lit(rule), *cs).alias("k"))
    text = F.coalesce("raw", "title") if number == 2 and "raw" in df.columns else F.col("title")  # a title may be read wrongly
    base = df.select("id", "service", "year", "title", F.array_distinct(F.filter(F.split("families", r"\|"), lambda x: x != "")).alias("f"), F.filter(F.split(text, " "), lambda w: (F.length(w) > 2) & ~w.isin(*sorted(STOP_WORDS))).alias("c"))
    n, m = F.size("f"), F.size("c")
    if number == 0:
        titled = F.replace("title", F.lit(" "), F.lit(""))
        base = base.withColumn("t", titled).filter("t <> ''")
        # A long title is a key of its own, a short one only together with an author; which of the rules holds is told later.
        keys = F.when(m > 3, F.array(key(0, F.col("t")))).otherwise(F.transform(fam, lambda a: key(0, F.col("t"), a)))
    elif number == 1:
        pairs = F.flatten(F.transform(fam, lambda a: F.transform(F.filter(fam, lambda b: b > a), lambda b: key(3, a, b))))
        edges = F.array_distinct(F.concat(F.slice("c", 1, 2), F.slice("c", -1, 1)))
        by_word = F.flatten(F.transform(fam, lambda a: F.transform(edges, lambda w: key(4, a, w))))
        # Spans of three years, of which the entry asks those of the year before and after; only an entry without a title asks.
        span = lambda y: F.floor(y / 3).cast("int")
        years = F.array_distinct(F.array(span(year - 1), span(year + 1))) if near else F.array(span(year))
        by_year = F.flatten(F.transform(fam, lambda a: F.transform(years, lambda y: key(5, a, y))))
        asks = year.isNotNull() & ((m == 0) if near else F.lit(True))
        keys = F.concat(pairs, by_word, F.when(asks, by_year).otherwise(no))
    else:
        runs = lambda k: F.when(m >= k, F.transform(F.sequence(F.lit(1), m - k + 1), lambda i: F.array_sort(F.slice("c", i, k)))).otherwise(F.array().cast("array<array<string>>"))
        keys = F.concat(F.when(year.isNotNull(), F.transform(runs(3), lambda w: key(6, w, year))).otherwise(no), F.transform(runs(4), lambda w: key(7, w)))
    return base.select("id", "service", F.inline(keys))


_CHECK = ("year", "families", "title", "volume", "page")
_FOUND = ("entry", "work", "service", "rule", "same")


def _with_attributes(met: DataFrame, e: DataFrame, w: DataFrame) -> DataFrame:
    pairs = met.join(e.select(F.col("id").alias("entry"), *[F.col(c).alias(f"e_{c}") for c in (*_CHECK, "raw")]), "entry")
    pairs = pairs.join(w.select(F.col("id").alias("work"), *[F.col(c).alias(f"w_{c}") for c in _CHECK]), "work")
    volume, page = F.col("e_volume") == F.col("w_volume"), F.col("e_page") == F.col("w_page")
    return pairs.withColumn("same", F.when(volume == page, volume))


def _decided(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of the first pass that its rules decide by equality, and the rest; equal titles of few words decide nothing."""
    names = lambda c: F.filter(F.split(c, r"\|"), lambda x: x != "")
    telling = F.size(F.array_except(F.split("e_title", " "), F.array(*map(F.lit, sorted(STOP_WORDS))))) > 3
    year = F.coalesce(F.abs(F.col("e_year") - F.col("w_year")) <= 1, F.lit(True))
    sure = F.coalesce((F.col("e_title") == F.col("w_title")) & telling & year & F.arrays_overlap(names("e_families"), names("w_families")), F.lit(False))
    first = (F.get(names("e_families"), F.lit(0)) == F.get(names("w_families"), F.lit(0))) & (F.col("e_year") == F.col("w_year"))
    ruled = pairs.filter(sure).withColumn("rule", F.when(first, 0).otherwise(1)).select(*_FOUND)
    return ruled, pairs.filter(~sure).withColumn("rule", F.lit(2))


def _checked(pairs: DataFrame, p: Params, by_title: bool) -> DataFrame:
    """The pairs that agree; by_title: those met by words of their titles, where those that share too few cannot."""
    cols = [*_FOUND, *[f"{k}_{c}" for k in "ew" for c in _CHECK[:3]], "e_raw"]

    def side(year, families, title) -> dict:
        return {"year": year, "families": families.split("|") if families else [], "words": title.split()}

    def run(batches):
        for batch in batches:
            kept = []
            for i, r in enumerate(zip(*(batch.column(n).to_pylist() for n in range(5, 12)))):
                x, y = side(*r[:3]), side(*r[3:6])
                if r[6]:
                    x["raw"] = r[6].split()
                if agree(x, y, p):
                    kept.append(i)
            yield batch.select(list(_FOUND)).take(pa.array(kept, pa.int32()))

    if by_title:
        s, t = (F.array_except(F.split(c, " "), F.array(*map(F.lit, sorted(STOP_WORDS)))) for c in (F.coalesce("e_raw", "e_title"), F.col("w_title")))
        pairs = pairs.filter(F.size(F.array_intersect(s, t)) >= p.shared_words * F.least(F.size(s), F.size(t)))
    return pairs.select(cols).mapInArrow(run, "entry long, work long, service string, rule int, same boolean")


def match(entries: DataFrame, works: DataFrame, p: Params = Params()) -> DataFrame:
    """``(entry_key, work_key, service, rule, confidence)``; entries: entry_key, csl (, raw_text); works: work_key, service and CSL fields."""
    csl = [F.col(f"csl.{c}").alias(c) for c in ("title", "author", "issued", "volume", "page")]
    raw = F.col("raw_text") if "raw_text" in entries.columns else F.lit(None).cast("string").alias("raw_text")
    e = _completed(entries.select(F.col("entry_key").cast("long").alias("id"), *csl, F.lit("").alias("service"), raw))
    w = works.select(F.col("work_key").cast("long").alias("id"), "title", "author", "issued", "volume", "page", F.coalesce("service", F.lit("")).alias("service"))
    # Redelivered rows are equal, so they only repeat pairs; pairs are made distinct, rows need not be.
    e, w = (materialize(_attributes(x.filter("id IS NOT NULL")), f"em-{n}") for x, n in ((e, "entries"), (w, "works")))
    n_services = w.select("service").distinct().count()
    parts: list[DataFrame] = []
    for number in range(len(PASSES)):
        open_entries, resolved = e, None
        if parts:
            resolved = reduce(DataFrame.unionByName, parts).select("entry", "service").distinct()
            full = resolved.groupBy(F.col("entry").alias("id")).agg(F.count("*").alias("n")).filter(F.col("n") >= n_services)
            open_entries = e.join(full, "id", "left_anti")
        left = _keys(open_entries, number, True).select(F.col("id").alias("entry"), "k", "rule")
        right = _keys(w, number, False).select(F.col("id").alias("work"), "service", "k")
        met = left.join(right, "k").groupBy("entry", "work", "service").agg(F.min("rule").alias("rule"))
        if resolved is not None:
            met = met.join(resolved, ["entry", "service"], "left_anti")
        pairs = _with_attributes(met, e, w)
        if number == 0:
            ruled, pairs = _decided(pairs)
            out = ruled.unionByName(_checked(pairs, p, False))
        else:
            out = _checked(pairs, p, number == 2)
        parts.append(materialize(out.distinct(), f"em-pass{number}"))
    seen = reduce(DataFrame.unionByName, parts)
    strongest = F.min("rule").over(Window.partitionBy("entry", "service"))
    matched = seen.withColumn("strongest", strongest).filter("rule = strongest")
    labels = seen.filter("same IS NOT NULL").groupBy("rule").agg(F.count_if("same").alias("yes"), F.count("*").alias("n"))
    precision = labels.select("rule", ((F.col("yes") + p.prior_true) / (F.col("n") + p.prior_true + p.prior_false)).alias("precision"))
    unlabelled = p.prior_true / (p.prior_true + p.prior_false)
    confidence = F.round(F.coalesce("precision", F.lit(unlabelled)), 4)
    name = F.element_at(F.array(*map(F.lit, RULE_NAMES)), F.col("rule") + 1)
    return matched.join(F.broadcast(precision), "rule", "left").select(F.col("entry").alias("entry_key"), F.col("work").alias("work_key"), "service", name.alias("rule"), confidence.alias("confidence"))  # one row a rule is broadcast
