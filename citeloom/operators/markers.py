"""Operators over in-text citation markers and the entries they name.

A paper's rows meet by joins on (paper_id, key); no operator gathers a paper into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import text as tx
from citeloom.operators.entries import PARTICLES
from citeloom.operators.prefix import running_sum

PARTICLE = rf"(?:(?:{'|'.join(PARTICLES)})\s+)*"
SURNAME = rf"^({PARTICLE}[A-Z][\p{{L}}\d@&'’-]*)"


def _known(c: str):
    return F.filter(F.coalesce(c, tx.array_of()), lambda x: x.isNotNull())


def cited_ids(markers: DataFrame) -> DataFrame:
    """Distinct (paper_id, id) that some marker targets."""
    return markers.select("paper_id", F.explode("targets").alias("id")).filter("id IS NOT NULL").distinct()


def cited(markers: DataFrame, entries: DataFrame) -> DataFrame:
    return entries.join(cited_ids(markers), ["paper_id", "id"], "left_semi").select("entry_key")


def uncited(markers: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries no marker targets; an entry without id can be targeted by none."""
    return entries.join(cited_ids(markers), ["paper_id", "id"], "left_anti").select("entry_key")


def times_cited(markers: DataFrame, entries: DataFrame) -> DataFrame:
    """How many markers name each entry; a marker that names it twice counts once."""
    counts = (
        markers.select("marker_key", "paper_id", F.explode(F.array_distinct("targets")).alias("id"))
        .filter("id IS NOT NULL")
        .groupBy("paper_id", "id")
        .agg(F.count("*").alias("n"))
    )
    return entries.join(counts, ["paper_id", "id"], "left").select("entry_key", F.coalesce("n", F.lit(0)).cast("long").alias("times_cited"))


def orphans(markers: DataFrame) -> DataFrame:
    """Markers with unresolved cites."""
    return markers.withColumn("n_unresolved", F.size(_known("unresolved")).cast("long")).filter("n_unresolved > 0")


def unresolved_digest(markers: DataFrame, most: int = 40) -> DataFrame:
    """The first distinct unresolved cites of a paper; a feature with a limit, as it is shown to people."""
    first = markers.select("paper_id", "marker_key", F.explode(_known("unresolved")).alias("v")).groupBy("paper_id", "v").agg(F.min("marker_key").alias("k"))
    ranked = first.withColumn("rn", F.row_number().over(Window.partitionBy("paper_id").orderBy("k", "v"))).filter(F.col("rn") <= most)
    lines = F.array_sort(F.collect_list(F.struct("rn", "v")))
    return ranked.groupBy("paper_id").agg(F.array_join(F.transform(lines, lambda x: x["v"]), "\n").alias("cites"))


def citation_report(markers: DataFrame, entries: DataFrame) -> DataFrame:
    n = F.size(_known("unresolved"))
    m = markers.groupBy("paper_id").agg(F.count("*").alias("n_markers"), F.count_if(n > 0).alias("n_orphans"), F.sum(n).cast("long").alias("n_unresolved"))
    hit = entries.join(cited_ids(markers).withColumn("hit", F.lit(1)), ["paper_id", "id"], "left")
    e = hit.groupBy("paper_id").agg(F.count("*").alias("n_entries"), F.count("hit").alias("n_cited"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return (
        m.join(e, "paper_id", "full")
        .withColumn("n_uncited", F.col("n_entries") - F.col("n_cited"))
        .select("paper_id", *map(zero, ("n_markers", "n_orphans", "n_unresolved", "n_entries", "n_cited", "n_uncited")))
    )


def find_markers(sections: DataFrame) -> DataFrame:
    """Markers of four kinds in all paragraphs, numbered within the paper in order of section, paragraph, kind, position.

    A parenthesis counts only if one of its parts starts with a name and holds a year.
    """
    paras = sections.select("section_key", "paper_id", "section_ix", F.posexplode("paragraphs").alias("para_ix", "t")).filter("t IS NOT NULL")
    is_cite = lambda c: F.trim(c).rlike(r"^[A-Z][\p{L}\d@&'’.-]*") & c.rlike(r"(?:19|20)\d{2}")
    kinds = (("bracket", tx.BRACKET), ("superscript", tx.SUPERSCRIPT), ("parenthetical", tx.PAREN_CITE), ("narrative", tx.NARRATIVE_CITE))

    def tag(kind: str, rank: int, pattern: str):
        return F.transform(tx.spans_of(F.col("t"), pattern), lambda s: s.withField("kind", F.lit(kind)).withField("rank", F.lit(rank)))

    tagged = [tag(kind, rank, pattern) for rank, (kind, pattern) in enumerate(kinds)]
    found = paras.select("section_key", "paper_id", "section_ix", "para_ix", F.explode(F.concat(*tagged)).alias("m")).select("section_key", "paper_id", "section_ix", "para_ix", "m.*")
    kept = found.filter((F.col("kind") != "parenthetical") | F.exists(F.split("inner", ";"), is_cite))
    order = ["section_ix", "section_key", "para_ix", "rank", "start_pos"]
    numbered = running_sum(kept, ["paper_id"], F.coalesce(F.col("section_ix"), F.lit(-1)).cast("long"), order, F.lit(1), "place")
    return numbered.select("section_key", "paper_id", F.col("para_ix").cast("long"), "kind", "start_pos", "end_pos", "raw", (F.col("place") - 1).cast("long").alias("seq"))


def style_vote(spans: DataFrame) -> DataFrame:
    """The kind of marker a paper has most of; brackets win ties, then superscripts."""
    votes = spans.groupBy("paper_id").agg(
        F.count_if(F.col("kind") == "bracket").alias("brackets"),
        F.count_if(F.col("kind") == "superscript").alias("superscripts"),
        F.count_if(F.col("kind").isin("parenthetical", "narrative")).alias("author_years"),
    )
    most = F.greatest("brackets", "superscripts", "author_years")
    return votes.withColumn("style", F.when(most == 0, "unknown").when(F.col("brackets") == most, "numeric-bracket").when(F.col("superscripts") == most, "superscript").otherwise("author-year"))


def drop_foreign_superscripts(spans: DataFrame, styles: DataFrame) -> DataFrame:
    return spans.join(styles.select("paper_id", "style"), "paper_id").filter("style = 'superscript' OR NOT startswith(raw, '⟦^')")


def link_numbers(markers: DataFrame, entries: DataFrame) -> DataFrame:
    """(marker_key, number, entry_key) of bracketed and superscript markers: entry_key is null where no entry has the number."""
    inner = F.when(F.col("raw").rlike(tx.BRACKET), F.regexp_extract("raw", tx.BRACKET, 1)).when(F.col("raw").rlike(tx.SUPERSCRIPT), F.regexp_extract("raw", tx.SUPERSCRIPT, 1))
    wanted = markers.withColumn("inner", inner).filter("inner IS NOT NULL").select("marker_key", "paper_id", F.explode(F.array_distinct(tx.number_list(F.col("inner")))).alias("number")).withColumn("number", F.col("number").cast("long"))
    last = entries.filter("marker IS NOT NULL").groupBy("paper_id", "marker").agg(F.max_by("entry_key", F.struct("entry_ix", "entry_key")).alias("entry_key"))
    return wanted.join(last, (wanted.paper_id == last.paper_id) & (F.col("number").cast("string") == last.marker), "left").select("marker_key", "number", "entry_key")


# A year with its letters, which may go on behind commas: '2024a,b'.
YEAR_LETTERS = r"((?:19|20)\d{2})((?:[a-z]\b(?:\s*,\s*[a-z]\b)*)?)"


def author_year_cites(markers: DataFrame) -> DataFrame:
    """Distinct (marker_key, paper_id, surname, year, letter): every year and letter of every cite of a marker.

    A marker in parentheses holds cites between semicolons; a narrative one, 'Doe et al. (2001)', is one cite.
    """
    whole = F.regexp_extract("raw", r"^\((.*)\)$", 1)
    parts = F.when(F.startswith("raw", F.lit("(")), F.split(whole, ";")).when(F.col("raw").rlike(r"^\p{L}.*\("), F.array("raw"))
    cites = markers.select("marker_key", "paper_id", F.explode(parts).alias("cite")).withColumn("cite", F.trim("cite")).filter(F.col("cite").rlike(SURNAME))
    both = F.arrays_zip(*[F.regexp_extract_all("cite", F.lit(YEAR_LETTERS), F.lit(i)).alias(n) for i, n in ((1, "year"), (2, "letters"))])
    years = cites.select("marker_key", "paper_id", F.lower(F.regexp_extract("cite", SURNAME, 1)).alias("surname"), F.inline(both))
    return years.select("marker_key", "paper_id", "surname", F.col("year").cast("int").alias("year"), F.explode(F.split("letters", r"\s*,\s*")).alias("letter")).distinct()


def link_author_years(markers: DataFrame, entries: DataFrame) -> DataFrame:
    """Each author-year cite with the number of entries of its paper that fit; one is a link, more are ambiguous.

    An entry fits if its year is equal and the name is a family name, or stands as whole words in a literal
    author or among the first 120 characters of the entry.  Of several the one whose text has the year with
    the cite's letter is meant, if it is only one.  Cites and entries meet by paper, year and the name's last
    word, of which an entry has few, so a paper with many entries of a year is no hot key.
    """
    cites = author_year_cites(markers)
    spaced = lambda c: F.concat(F.lit(" "), F.regexp_replace(c, r"[^\p{L}\d]+", " "), F.lit(" "))
    people = F.coalesce("author", F.array().cast("array<struct<family:string,given:string,literal:string>>"))
    e = entries.select("entry_key", "paper_id", F.expr("try_element_at(try_element_at(csl.issued, 1), 1)").alias("year"), F.transform("csl.author", lambda a: F.struct(a["family"].alias("family"), F.lit(None).cast("string").alias("given"), a["literal"].alias("literal"))).alias("author"), "raw_text")
    e = e.select("entry_key", "paper_id", "year", "raw_text", F.transform(people, lambda a: F.lower(a["family"])).alias("families"), F.transform(people, lambda a: spaced(F.lower(a["literal"]))).alias("literals"), spaced(F.lower(F.substring("raw_text", 1, 120))).alias("head"))
    known = lambda c: F.filter(c, lambda x: x.isNotNull())
    names = F.concat_ws(" ", known(F.transform("families", spaced)), known("literals"), "head")
    words = e.filter("year IS NOT NULL").select("*", F.explode(F.array_distinct(F.split(names, " +"))).alias("word")).filter("word <> ''")
    name = spaced(F.col("surname"))
    asked = cites.withColumn("word", F.element_at(F.split(F.trim(name), " +"), -1))
    fits = F.exists("families", lambda f: F.coalesce(f == F.col("surname"), F.lit(False))) | F.exists("literals", lambda x: F.coalesce(F.contains(x, name), F.lit(False))) | F.coalesce(F.contains("head", name), F.lit(False))
    lettered = (F.col("letter") != "") & F.coalesce(F.contains("raw_text", F.concat(F.col("year").cast("string"), F.col("letter"))), F.lit(False))
    key = ["marker_key", "surname", "year", "letter"]
    hit = (
        asked.join(words, ["paper_id", "year", "word"])
        .filter(fits)
        .groupBy(*key)
        .agg(F.count("*").alias("n"), F.min("entry_key").alias("only"), F.count_if(lettered).alias("n_lettered"), F.min(F.when(lettered, F.col("entry_key"))).alias("by_letter"))
    )
    n = F.coalesce("n", F.lit(0)).cast("long")
    chosen = F.when(n == 1, F.col("only")).when(F.col("n_lettered") == 1, F.col("by_letter"))
    return cites.join(hit, key, "left").select(
        "marker_key", "surname", "year", "letter", n.alias("n_fits"), chosen.alias("entry_key"), F.when(n == 0, "unresolved").when(chosen.isNotNull(), "linked").otherwise("ambiguous").alias("outcome")
    )


def superscript_segments(spans: DataFrame) -> DataFrame:
    hits = spans.filter(F.col("text").rlike(tx.SUPERSCRIPT))
    return hits.select("span_key", tx.plain_superscripts(F.col("text")).alias("plain"), F.regexp_extract_all("text", F.lit(tx.SUPERSCRIPT), F.lit(1)).alias("tokens"))
