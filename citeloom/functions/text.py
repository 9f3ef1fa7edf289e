"""Column expressions over text: the scalar functions that the operators share.

Everything here is built from JVM expressions, so it stays inside generated code and pushes no row to
Python.  Offsets are code points.  Patterns avoid look-around where the SQL twin of a query uses them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of markers in running text.
BRACKET = r"\[(\d{1,3}(?:\s*[,–-]\s*\d{1,3})*)\]"
SUPERSCRIPT = r"⟦\^([\d\s,;–-]+)⟧"
PAREN_CITE = r"\(([^()]{2,120}?(?:19|20)\d{2}[a-z]?(?:[^()]{0,80})?)\)"
NARRATIVE_CITE = r"\b([A-Z][\p{L}'’-]+)(?:\s+et al\.?|\s+(?:and|&)\s+[A-Z][\p{L}'’-]+)?\s+\(((?:19|20)\d{2}[a-z]?)\)"
MATH_CHARS = r"[√∑∏∫≈≤≥±×÷∈∀∃∇∂∞·∗‖|=+^_{}\\]"


def array_of(kind: str = "string") -> Column:
    return F.array().cast(f"array<{kind}>")


def squeeze(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def mask_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\d+", "#")


def words(c: Column) -> Column:
    return F.split(c, r"\s+")


def title_tokens(c: Column) -> Column:
    """Distinct words of two or more characters, lower case, without punctuation; null for null."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", " "), r"\s+"), lambda x: F.length(x) > 1))


def token_score(a: Column, b: Column) -> Column:
    """Likeness of two token sets: full containment of four or more tokens counts 1, else the shared part of the larger."""
    both, small, large = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return F.when(small == 0, F.lit(0.0)).when((both == small) & (small >= 4), F.lit(1.0)).otherwise(both / large)


def doi_of(c: Column) -> Column:
    found = F.regexp_extract(c, r"(?i)(?:^|[^0-9A-Za-z_])(10\.\d{4,9}/[^\s\"<>;,]+)", 1)
    return F.nullif(F.regexp_replace(found, r"[.,;)\]]+$", ""), F.lit(""))


def arxiv_of(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?i)(?:arxiv[:\s]*|abs/)(\d{4}\.\d{4,5})(v\d+)?", 1), F.lit(""))


def last_year(c: Column, as_of_year: int) -> Column:
    """The last year of the text from 1900 up to the one after as_of_year."""
    found = F.regexp_extract_all(c, F.lit(r"(?:^|[^0-9A-Za-z_])((?:19|20)\d{2})(?=[a-z]?(?:[^0-9A-Za-z_]|$))"), F.lit(1))
    return F.try_element_at(F.filter(F.transform(found, lambda y: y.cast("int")), lambda y: (y >= 1900) & (y <= as_of_year + 1)), F.lit(-1))


def quote_form(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def quote_in_text(quote: Column, text: Column) -> Column:
    """A quote of at least ten normal characters occurs in the text."""
    q = quote_form(quote)
    return (F.length(q) >= 10) & F.contains(quote_form(text), q)


def plain_superscripts(c: Column) -> Column:
    return F.regexp_replace(c, SUPERSCRIPT, "[$1]")


def spans_of(c: Column, pattern: str, group: int = 1) -> Column:
    """``array<struct<start_pos, end_pos, raw, inner>>`` of every match, positions counted from 0.

    The text is cut at the matches; a match starts behind all pieces and matches before it.
    """
    raws = F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))
    inners = F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1 + group))
    pieces = F.transform(F.split(c, pattern, -1), F.length)
    total = lambda xs, n: F.aggregate(F.slice(xs, F.lit(1), n), F.lit(0), lambda acc, x: acc + x)
    start = lambda i: total(pieces, i + 1) + total(F.transform(raws, F.length), i)
    return F.transform(
        raws,
        lambda raw, i: F.struct(
            start(i).cast("bigint").alias("start_pos"),
            (start(i) + F.length(raw)).cast("bigint").alias("end_pos"),
            raw.alias("raw"),
            F.get(inners, i).alias("inner"),
        ),
    )


def number_list(c: Column) -> Column:
    """'1, 3-5' -> [1, 3, 4, 5]; a range runs over at most 100 numbers, what is no number falls away."""

    def expand(part: Column) -> Column:
        number = lambda x: F.when(F.trim(x) == "", F.lit(0)).otherwise(F.trim(x).try_cast("int"))
        ends = F.transform(F.split(part, "[–-]"), number)
        a, b = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
        is_range = (F.size(ends) == 2) & a.isNotNull() & b.isNotNull() & (b > a)
        return F.when(is_range, F.sequence(a, F.least(b, a + 99))).when(a.isNotNull(), F.array(a)).otherwise(array_of("int"))

    return F.flatten(F.transform(F.split(c, "[,;]"), expand))


def is_math_noise(c: Column) -> Column:
    """Three mathematical characters, or more than 2 % of them, or more than half of the words of one or two letters."""
    hits, ws = F.regexp_count(c, F.lit(MATH_CHARS)), words(c)
    return (hits >= 3) | (hits > 0.02 * F.length(c)) | (F.size(F.filter(ws, lambda w: F.length(w) <= 2)) > 0.5 * F.size(ws))


def is_numeric_debris(c: Column, with_bars: bool = True) -> Column:
    """Four or more words, at least 60 % of them numbers or no longer than two characters."""
    ws = words(c)
    pattern = r"^[\d.,()%×±\-–|]+$" if with_bars else r"^[\d.,()%×±\-–]+$"
    return (F.size(ws) >= 4) & (F.size(F.filter(ws, lambda w: w.rlike(pattern) | (F.length(w) <= 2))) >= 0.6 * F.size(ws))


def is_markdown_table(c: Column) -> Column:
    return c.rlike(r"^\|.*\|\n\| ?---")


def join_wrapped(lines: Column) -> Column:
    """Lines as one text: a hyphen at an end is taken away before a small letter, else a blank comes between."""
    step = lambda out, x: F.when(out.rlike(r"-\z") & x.rlike("^[a-z]"), F.concat(F.substring(out, F.lit(1), F.length(out) - 1), x)).when(out == "", x).otherwise(F.concat(out, F.lit(" "), x))
    return F.aggregate(lines, F.lit(""), step)


def author_label(author: Column) -> Column:
    """'A', 'A & B', 'A et al.' or a dash."""
    name = lambda i: F.coalesce(F.get(author, F.lit(i))["family"], F.get(author, F.lit(i))["literal"], F.lit("?"))
    n = F.coalesce(F.size(author), F.lit(0))
    return F.when(n < 1, F.lit("—")).when(n == 1, name(0)).when(n == 2, F.concat(name(0), F.lit(" & "), name(1))).otherwise(F.concat(name(0), F.lit(" et al.")))


def first_authors(author: Column, n: int = 3) -> Column:
    return F.array_join(F.transform(F.slice(F.coalesce(author, F.array()), 1, n), lambda a: F.coalesce(a["family"], a["literal"], F.lit(""))), ", ")


def slug(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, r"[^\p{L}\p{N}]+", "-"), 1, 60)


def search_form(c: Column) -> Column:
    """A query as a search service takes it."""
    return squeeze(F.regexp_replace(c, r"[^\p{L}\p{N}\s-]", " "))


def bare_doi(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^https://doi\.org/", ""))


def host_name(url: Column) -> Column:
    host = F.parse_url(url, F.lit("HOST"))
    return F.when(F.contains(host, F.lit("openalex")), "OpenAlex").when(F.contains(host, F.lit("semanticscholar")), "Semantic Scholar").otherwise(host)


def split_display_name(c: Column) -> Column:
    """The last word is the family name; one word alone is a literal."""
    ws = words(c)
    return F.when(
        F.size(ws) > 1,
        F.struct(F.element_at(ws, -1).alias("family"), F.array_join(F.slice(ws, F.lit(1), F.size(ws) - 1), " ").alias("given"), F.lit(None).cast("string").alias("literal")),
    ).otherwise(F.struct(F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("given"), c.alias("literal")))


def rebuild_from_index(index: Column) -> Column:
    """Text of a word -> positions map, words in order of position."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.nullif(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "), F.lit(""))


def latex(c: Column) -> Column:
    """Special characters escaped; superscript tokens become plain markers first, a backslash last of all its kind."""
    out = plain_superscripts(c)
    out = F.regexp_replace(out, r"\\", "\u0001")
    out = F.regexp_replace(out, r"([&%$#_{}])", r"\\$1")
    out = F.regexp_replace(F.regexp_replace(out, "~", r"\\textasciitilde{}"), r"\^", r"\\textasciicircum{}")
    return F.regexp_replace(out, "\u0001", r"\\textbackslash{}")


def sentences(c: Column) -> Column:
    """Sentences of a reference: what follows '.', '?' or '!' and starts like one begins the next, but not behind an initial.

    Dots of initials and cuts are marked by control characters, so that no look-around is needed.
    """
    held = F.regexp_replace(c, r"([A-Z])\.", "$1\u0001")
    cut = F.regexp_replace(held, r"([.?!])\s+([A-Z\"“]|arXiv\b|in\s|pages\s)", "$1\u0002$2")
    parts = F.transform(F.split(cut, "\u0002"), lambda x: F.trim(F.replace(x, F.lit("\u0001"), F.lit("."))))
    return F.filter(parts, lambda x: x != "")


def sentence_at(text: Column, start: Column) -> Column:
    """The sentence of a paragraph that holds the position."""
    cut = r"(?<=(?<!\bet al)(?<!\be\.g)(?<!\bi\.e)(?<!\bFig)(?<!\bvs)(?<!\s[A-Z])[.!?])(?=\s+[A-Z⟦\[(]|\s*$)"
    pieces = F.split(text, cut, -1)
    ends = lambda i: F.aggregate(F.slice(pieces, F.lit(1), i + 1), F.lit(0), lambda acc, x: acc + F.length(x))
    hit = F.filter(F.transform(pieces, lambda s, i: F.struct(ends(i).alias("e"), s.alias("s"))), lambda x: x["e"] > start)
    return F.trim(F.coalesce(F.get(hit, F.lit(0))["s"], text))
