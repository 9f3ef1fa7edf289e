"""From positioned spans to lines: the order-dependent folds run page by page.

A page is a bounded unit (some hundred spans), so each is one group of ``applyInPandas``; papers of any
length spread over all tasks.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of fonts that are bold, and the form of a superscript number list.
BOLD_FONT = r"(?i)bold|black|heavy|semibold|demi|medi"
_NUMBERS = re.compile(r"^[\d\s,;–-]+$")


def is_bold_font(c: Column) -> Column:
    return c.rlike(BOLD_FONT)


def usable_spans(spans: DataFrame) -> DataFrame:
    """Spans with text and a place; rotated ones are not delivered in this table."""
    return spans.filter("text IS NOT NULL AND trim(text) <> '' AND x_pos IS NOT NULL AND y_pos IS NOT NULL AND font_size IS NOT NULL")


def nfkc(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, text)`` in compatibility form without soft hyphens; only texts beyond ASCII cross to Python."""
    import unicodedata

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize("NFKC", t).replace("­", ""), na_action="ignore")

    beyond = F.octet_length(text) != F.length(text)
    return df.select(key, F.coalesce(fold(F.when(beyond, F.col(text))), F.col(text)).alias("text"))


def weighted_mode(pairs: list[tuple[float, int]]) -> float:
    """The value with the greatest weight; of equals the one seen first."""
    weight: dict[float, int] = defaultdict(int)
    for value, w in pairs:
        weight[value] += w
    return max(weight, key=lambda v: weight[v])


def join_spans(row: list[tuple], size: float) -> str:
    """Spans (x, y, width, font size, text) from left to right as one text; small raised numbers become tokens."""
    base = next((s[1] for s in row if s[3] >= 0.95 * size), row[0][1])
    out, before = "", None
    for s in row:
        x, y, width, font, text = s[:5]
        if before is not None and x - (before[0] + before[2]) > 0.15 * before[3] and not out.endswith(" ") and not text.startswith(" "):
            out += " "
        raised = font < 0.8 * size and y > base + 1 and _NUMBERS.match(text.strip())
        out += f"⟦^{text.strip()}⟧" if raised else text
        before = s
    return " ".join(out.split())


def line_of(spans: list[tuple]) -> tuple | None:
    """(text, x, y, font size, bold) of the spans of one line, or None if it has no text."""
    row = sorted(spans, key=lambda s: s[0])
    size = weighted_mode([(int(s[3] * 10 + 0.5) / 10, len(s[4])) for s in row])
    text = join_spans(row, size)
    if not text:
        return None
    anchor = next((s for s in row if s[3] >= 0.95 * size), row[0])
    n, bold = sum(len(s[4]) for s in row), sum(len(s[4]) for s in row if s[5])
    return text, row[0][0], anchor[1], size, n > 0 and bold >= 0.6 * n, row


def visual_lines(spans: list[tuple]) -> list[list[tuple]]:
    """Spans grouped by height: a line goes on while a span stays near the first span of the line."""
    groups: list[list[tuple]] = []
    for s in sorted(spans, key=lambda s: (-s[1], s[0])):
        if groups and abs(s[1] - groups[-1][0][1]) <= max(2.5, 0.5 * max(s[3], groups[-1][0][3])):
            groups[-1].append(s)
        else:
            groups.append([s])
    return groups


def split_columns(groups: list[list[tuple]], middle: float, gutter: float = 10.0) -> list[tuple[int, list[tuple]]]:
    """(column, spans) of each line; a page has two columns if a quarter of at least eight lines says so."""
    parts = []
    for g in groups:
        left, right = [s for s in g if s[0] < middle], [s for s in g if s[0] >= middle]
        crossing = any(s[0] < middle - 2 and s[0] + s[2] > middle + 2 for s in g)
        gap = min(s[0] for s in right) - max(s[0] + s[2] for s in left) if left and right and not crossing else 0.0
        parts.append((g, left, right, gap))
    evidence = sum((bool(left) and bool(right) and gap >= gutter) or (not left and bool(right)) for _, left, right, gap in parts)
    if len(groups) < 8 or evidence < 0.25 * len(groups):
        return [(0, g) for g in groups]
    out: list[tuple[int, list[tuple]]] = []
    for g, left, right, gap in parts:
        if left and right and gap >= gutter:
            out += [(0, left), (1, right)]
        else:
            out.append((1 if not left else 0, g))
    return out


def page_lines(spans: DataFrame) -> DataFrame:
    """``(paper_id, page, place, col_no, text, x_pos, y_pos, font_size, bold)`` in reading order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(pdf["x_pos"], pdf["y_pos"], pdf["width"].fillna(0.0), pdf["font_size"], pdf["text"], pdf["bold"].fillna(False)))
        edge = max(r[0] + r[2] for r in rows) + min(r[0] for r in rows)
        made = [(column, line_of(g)) for column, g in split_columns(visual_lines(rows), edge / 2)]
        lines = sorted(((c, *x[:5]) for c, x in made if x is not None), key=lambda x: (x[0], -x[3], x[2]))
        out = pd.DataFrame([(i, *x) for i, x in enumerate(lines)], columns=["place", "col_no", "text", "x_pos", "y_pos", "font_size", "bold"])
        out.insert(0, "page", pdf["page"].iloc[0])
        out.insert(0, "paper_id", pdf["paper_id"].iloc[0])
        return out

    schema = "paper_id string, page int, place int, col_no int, text string, x_pos double, y_pos double, font_size double, bold boolean"
    return usable_spans(spans).groupBy("paper_id", "page").applyInPandas(run, schema)


def cells_of(row: list[tuple], size: float) -> list[tuple[float, str]]:
    """(x, text) cells of a line: spans apart by 0.7 of the font size, six points at least, start a new cell."""
    cells: list[list] = []
    before = None
    for s in row:
        gap = s[0] - (before[0] + before[2]) if before else float("inf")
        if not cells or gap >= max(6.0, 0.7 * size):
            cells.append([s[0], s[4].strip()])
        else:
            cells[-1][1] += (" " if gap > 0.15 * before[3] else "") + s[4].strip()
        before = s
    return [(x, t) for x, t in cells if t]


def column_centers(xs: list[float], tolerance: float = 18.0) -> list[float]:
    """Means of sorted positions; a position further than the tolerance from the running mean starts a new one."""
    centers: list[float] = []
    members = 0
    for x in sorted(xs):
        if not centers or x - centers[-1] > tolerance:
            centers.append(x)
            members = 1
        else:
            centers[-1] = (centers[-1] * members + x) / (members + 1)
            members += 1
    return centers


def table_markdown(rows: list[list[tuple[float, str]]]) -> str | None:
    """A run of rows as a markdown table, or None if it has not 2 to 24 columns or is mostly empty."""
    centers = column_centers([x for r in rows for x, _ in r])
    if len(rows) < 3 or not 2 <= len(centers) <= 24:
        return None
    grid = []
    for r in rows:
        line = [""] * len(centers)
        for x, t in r:
            c = min(range(len(centers)), key=lambda i: abs(x - centers[i]))
            line[c] = f"{line[c]} {t}".strip().replace("|", "\\|") if line[c] else t.replace("|", "\\|")
        grid.append(line)
    if sum(sum(c != "" for c in line) >= 2 for line in grid) < 0.7 * len(grid):
        return None
    show = lambda cells: f"| {' | '.join(cells)} |"
    return "\n".join([show(grid[0]), show(["---"] * len(centers)), *map(show, grid[1:])])


def page_tables(spans: DataFrame) -> DataFrame:
    """``(paper_id, page, first_line, n_rows, markdown)`` of runs of three or more lines with several cells."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(pdf["x_pos"], pdf["y_pos"], pdf["width"].fillna(0.0), pdf["font_size"], pdf["text"], pdf["bold"].fillna(False)))
        out, held, first = [], [], 0
        lines = [x for x in map(line_of, visual_lines(rows)) if x is not None]
        for i, line in enumerate([*lines, None]):
            cells = cells_of(line[5], line[3]) if line else []
            if len(cells) >= 2:
                first = first if held else i
                held.append(cells)
                continue
            table = table_markdown(held) if held else None
            if table:
                out.append((pdf["paper_id"].iloc[0], int(pdf["page"].iloc[0]), first, len(held), table))
            held = []
        return pd.DataFrame(out, columns=["paper_id", "page", "first_line", "n_rows", "markdown"])

    return usable_spans(spans).groupBy("paper_id", "page").applyInPandas(run, "paper_id string, page int, first_line int, n_rows int, markdown string")


def clusters(df: DataFrame, group: list[str], value: str, tolerance: float = 18.0) -> DataFrame:
    """Centers of the values of each group, the running-mean fold as an expression: ``(group, centers)``."""
    start = F.struct(F.array().cast("array<double>").alias("c"), F.lit(0).alias("m"))

    def step(acc: Column, x: Column) -> Column:
        n = acc["m"]
        fresh = (F.size(acc["c"]) == 0) | (x - F.coalesce(F.get(acc["c"], F.size(acc["c"]) - 1), F.lit(0.0)) > tolerance)
        moved = F.concat(F.slice(acc["c"], F.lit(1), F.greatest(F.size(acc["c"]) - 1, F.lit(0))), F.array((F.get(acc["c"], F.size(acc["c"]) - 1) * n + x) / (n + 1)))
        return F.when(fresh, F.struct(F.concat(acc["c"], F.array(x)).alias("c"), F.lit(1).alias("m"))).otherwise(F.struct(moved.alias("c"), (n + 1).alias("m")))

    xs = F.sort_array(F.collect_list(F.col(value).cast("double")))
    return df.groupBy(*group).agg(xs.alias("xs")).select(*group, F.aggregate("xs", start, step)["c"].alias("centers"))
