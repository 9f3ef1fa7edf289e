"""Papers as LaTeX, BibTeX and Markdown, one text a paper.

A paper's parts are put in order inside one aggregate; the texts can be written with ``write.text``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import text as tx

FORMATS = ("tex", "bib", "md")


def in_order(parts: DataFrame, group: str, order: list[str], text: str, separator: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(*order, text)))
    return parts.groupBy(group).agg(F.array_join(F.transform(rows, lambda r: r[text]), separator).alias("text"))


def bibtex_entry(key: Column, csl: Column) -> Column:
    """A BibTeX record; fields without a value are left out, braces fall away."""
    kind = F.when(csl["csl_type"] == "paper-conference", "inproceedings").when(csl["csl_type"] == "book", "book").otherwise("article")
    person = lambda a: F.coalesce(a["literal"], F.nullif(F.concat_ws(", ", a["family"], a["given"]), F.lit("")), F.lit(""))
    authors = F.array_join(F.transform(csl["author"], person), " and ")
    year = F.try_element_at(F.try_element_at(csl["issued"], F.lit(1)), F.lit(1)).cast("string")
    venue = F.when(kind == "inproceedings", "booktitle").otherwise("journal")
    fields = [("title", csl["title"]), ("author", authors), ("year", year), (venue, csl["container_title"]), ("volume", csl["volume"]), ("pages", csl["page"]), ("doi", csl["doi"])]
    lines = [F.when(v != "", F.concat(F.lit("  "), n if isinstance(n, Column) else F.lit(n), F.lit(" = {"), F.regexp_replace(v, "[{}]", ""), F.lit("}"))) for n, v in fields]
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))


def bibtex(entries: DataFrame) -> DataFrame:
    """``(paper_id, text)``: entries: paper_id, entry_ix, entry_key, id, csl."""
    name = F.coalesce("id", F.concat(F.lit("entry-"), F.col("entry_key").cast("string")))
    return in_order(entries.withColumn("line", bibtex_entry(name, F.col("csl"))), "paper_id", ["entry_ix", "entry_key"], "line", "\n\n")


def section_command(level: Column) -> Column:
    return F.when(level >= 3, "subsubsection").when(level == 2, "subsection").otherwise("section")


def latex_sections(sections: DataFrame) -> DataFrame:
    """``(paper_id, text)``: the body of a document; sections of level 0 are front matter and stay out."""
    heading = F.regexp_replace(F.coalesce("heading", F.lit("")), r"^\d+(\.\d+)*\.?\s+", "")
    body = F.concat_ws("\n\n", F.concat(F.lit("\\"), section_command(F.col("heading_level")), F.lit("{"), tx.latex(heading), F.lit("}")), F.transform(F.filter("paragraphs", lambda p: p.isNotNull()), tx.latex))
    return in_order(sections.filter("heading_level > 0").withColumn("line", body), "paper_id", ["section_ix", "section_key"], "line", "\n\n")


def markdown_sections(sections: DataFrame) -> DataFrame:
    depth = F.least(F.when(F.col("heading_level") > 0, F.col("heading_level") + 1).otherwise(2), F.lit(6))
    body = F.concat_ws("\n\n", F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), F.coalesce("heading", F.lit(""))), F.transform(F.filter("paragraphs", lambda p: p.isNotNull()), tx.plain_superscripts))
    return in_order(sections.withColumn("line", body), "paper_id", ["section_ix", "section_key"], "line", "\n\n")


def cite_commands(text: Column, known: Column) -> Column:
    """Bracketed markers as cite commands; known maps a number to a key, a marker without known number stays."""
    raws = F.regexp_extract_all(text, F.lit(f"({tx.BRACKET})"), F.lit(1))
    inner = F.regexp_extract_all(text, F.lit(tx.BRACKET), F.lit(1))
    keys = F.transform(inner, lambda x: F.filter(F.transform(tx.number_list(x), lambda n: F.try_element_at(known, n.cast("string"))), lambda k: k.isNotNull()))
    shown = F.transform(keys, lambda ks, i: F.when(F.size(ks) > 0, F.concat(F.lit("\\cite{"), F.array_join(ks, ","), F.lit("}"))).otherwise(F.get(raws, i)))
    pieces = F.split(text, tx.BRACKET, -1)
    return F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(shown, i), F.lit("")))), "")


def cite_markers(markers: DataFrame, entries: DataFrame) -> DataFrame:
    """``(marker_key, latex)`` of bracketed markers: a cite command of the ids their numbers name, in order.

    A marker none of whose numbers is known stays as it is.  Numbers meet entries by a join; only a marker's own
    numbers come together in one row.  markers: marker_key, paper_id, raw; entries: paper_id, id, entry_ix, marker.
    """
    asked = markers.filter(F.col("raw").rlike(rf"^{tx.BRACKET}$")).select("marker_key", "paper_id", "raw", F.posexplode(tx.number_list(F.regexp_extract("raw", tx.BRACKET, 1))).alias("pos", "number"))
    last = entries.filter("marker IS NOT NULL AND id IS NOT NULL").groupBy("paper_id", "marker").agg(F.max_by("id", F.struct("entry_ix", "entry_key")).alias("id"))
    met = asked.withColumn("marker", F.col("number").cast("string")).join(last, ["paper_id", "marker"], "left")
    ids = F.transform(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "id")))), lambda x: x["id"])
    shown = met.groupBy("marker_key", "raw").agg(ids.alias("ids"))
    latex = F.when(F.size("ids") > 0, F.concat(F.lit("\\cite{"), F.array_join("ids", ","), F.lit("}"))).otherwise(F.col("raw"))
    return shown.select("marker_key", latex.alias("latex"))


def tables_in(text: Column) -> Column:
    """The markdown tables of a text: runs of two or more lines that begin with a bar."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"((?:^|\n)\|[^\n]*(?:\n\|[^\n]*)+)"), F.lit(1)), lambda t: F.regexp_replace(t, r"^\n", ""))


def tabular(markdown: Column) -> Column:
    """A markdown table as a LaTeX table."""
    rows = F.filter(F.split(markdown, "\n"), lambda r: ~r.rlike(r"^\| ?---"))
    cells = F.transform(rows, lambda r: F.transform(F.split(F.regexp_replace(F.regexp_replace(r, r"^\| ", ""), r" \|$", ""), r" \| "), lambda c: tx.latex(F.replace(c, F.lit("\\|"), F.lit("|")))))
    most = F.array_max(F.transform(cells, F.size))
    lines = F.transform(cells, lambda r, i: F.concat(F.array_join(F.concat(r, F.array_repeat(F.lit(""), most - F.size(r))), " & "), F.lit(" \\\\"), F.when(i == 0, F.lit(" \\hline")).otherwise(F.lit(""))))
    return F.concat(F.lit("{\\small\n\\begin{tabular}{"), F.array_join(F.array_repeat(F.lit("l"), most), " "), F.lit("}\n"), F.array_join(lines, "\n"), F.lit("\n\\end{tabular}}"))


def initials(given: str | None, point: str = ".") -> str:
    return "" if not given else (" " if point else "").join(f"{w[0]}{point}" for w in given.replace("-", " ").split() if w)


def render(csl: dict, template: str) -> str:
    """One bibliography line in the form of three public styles: apa, vancouver, harvard1."""
    names = []
    for a in csl.get("author") or ():
        if a.get("literal") or not a.get("family"):
            names.append(a.get("literal") or a.get("given") or "")
        elif template == "vancouver":
            names.append(f"{a['family']} {initials(a.get('given'), '')}".strip())
        else:
            names.append(f"{a['family']}, {initials(a.get('given'))}".rstrip(", "))
    year = str(csl["year"]) if csl.get("year") else "n.d."
    title, venue = (csl.get("title") or "").rstrip("."), csl.get("container_title") or ""
    volume, page = csl.get("volume") or "", csl.get("page") or ""
    if template == "vancouver":
        who = ", ".join(names[:6]) + (", et al" if len(names) > 6 else "")
        place = f"{venue}. {year}" + (f";{volume}" if volume else "") + (f":{page}" if page else "")
        return ". ".join(x for x in (who, title, place) if x) + "."
    if template == "harvard1":
        who = ", ".join(names[:-1]) + (" and " if len(names) > 1 else "") + names[-1] if names else ""
        tail = ", ".join(x for x in (venue, volume, f"pp.{page}" if page else "") if x)
        return f"{who}, {year}. {title}. {tail}.".lstrip(", ")
    who = ", ".join(names[:-1]) + (", & " if len(names) > 1 else "") + names[-1] if names else ""
    tail = ", ".join(x for x in (venue, volume, page) if x)
    return " ".join(x for x in (who, f"({year}).", f"{title}." if title else "", f"{tail}." if tail else "") if x)


def bibliography(entries: DataFrame, template: str = "apa") -> DataFrame:
    """``(entry_key, line)``; an entry without title and authors shows its raw text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lines = []
            for csl, raw in zip(pdf["csl"], pdf["raw_text"]):
                c = dict(csl) if csl is not None else {}
                c["year"] = c["issued"][0][0] if c.get("issued") is not None and len(c["issued"]) and len(c["issued"][0]) else None
                c["author"] = [dict(a) for a in c["author"]] if c.get("author") is not None else []
                lines.append(render(c, template) if c.get("title") or c["author"] else raw)
            yield pd.DataFrame({"entry_key": pdf["entry_key"], "line": lines})

    return entries.select("entry_key", "csl", "raw_text").mapInPandas(run, "entry_key long, line string")


def export(entries: DataFrame, sections: DataFrame, fmt: str) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    return {"tex": lambda: latex_sections(sections), "md": lambda: markdown_sections(sections), "bib": lambda: bibtex(entries)}[fmt]()
