import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from citeloom import session
from citeloom.operators import editing, entries, export, graph, layout, markers, orphans, reports, review, structure
from citeloom.sources import store


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---------------------------------------------------------------- graph


def test_components_against_union_find(spark):
    random.seed(3)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(1, 1), (None, 4), (70, 71), (71, 72), (72, 73), (70, 71)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = graph.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    assert {r["node"]: r["component"] for r in got.collect()} == {x: find(x) for x in list(parent)}
    assert rows(graph.members_of(spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "node long, component long"))) == [(1, 2)]


def test_components_of_nothing(spark):
    assert graph.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# ---------------------------------------------------------------- orphans

ENTRY = "paper_id string, id string, marker string, csl struct<author:array<struct<family:string,given:string,literal:string>>,issued:array<array<int>>>, recorded_at timestamp, removed_at timestamp, extra int"
MARKER = "marker_key long, paper_id string, targets array<string>, unresolved array<string>, recorded_at timestamp, extra string"


def _tables(spark):
    import datetime as dt

    day = lambda n: dt.datetime(2025, 1, n)
    e = [
        ("p", "ref-1", "1", ([("Doe", "J", None)], [[2001]]), day(1), None, 0),
        ("p", "ref-1", "1", ([("Doe", "J", None)], [[2001]]), day(1), None, 0),
        ("p", "Ref-2", None, (None, None), day(5), None, 0),
        ("p", "ref-3", None, ([], [[]]), day(1), day(3), 0),
        ("p", None, None, None, None, None, None),
        ("q", "ref-9", None, None, day(1), None, 1),
    ]
    m = [
        (1, "p", [" REF-1 ", "ref-1", None, "ref-9"], None, day(2), "x"),
        (1, "p", [" REF-1 ", "ref-1", None, "ref-9"], None, day(2), "x"),
        (2, "p", ["ref-2", "ref-3"], ["1", "7"], day(4), None),
        (3, "p", [], ["doe, 2001", "Doe (2001)", "Doe, 2002", "Doe, 2001 (ambiguous: matches 2 entries)", "odd"], day(2), None),
        (4, "p", ["ref-1"], None, None, None),
        (5, "p", None, None, day(2), None),
    ]
    return spark.createDataFrame(m, MARKER), spark.createDataFrame(e, ENTRY)


EXPECTED = [(1, "targets", "ref-9"), (2, "targets", "ref-2"), (2, "targets", "ref-3"), (2, "unresolved", "7"), (3, "unresolved", "doe, 2002"), (3, "unresolved", "odd"), (4, "targets", "ref-1")]


@pytest.mark.parametrize("most", [64 << 20, 16])
def test_orphans_with_filters_of_any_size(spark, most):
    m, e = _tables(spark)
    assert rows(orphans.orphan_references(m, e, max_filter_bytes=most).select("marker_key", "field", "ref_value")) == EXPECTED


def test_orphans_of_empty_tables(spark):
    m, e = _tables(spark)
    assert orphans.orphan_references(m.limit(0), e).count() == 0
    assert orphans.orphan_references(m, e.limit(0)).count() == orphans.references(m).count()


def test_orphan_report_counts_every_reference(spark):
    m, e = _tables(spark)
    report = orphans.orphan_report(orphans.orphan_references(m, e), orphans.references(m)).collect()
    assert sum(r["n_references"] for r in report) == orphans.references(m).count()
    assert sum(r["n_orphans"] for r in report) == len(EXPECTED)


@pytest.mark.parametrize("most", [1 << 20, 512])
def test_filter_has_no_false_negative(spark, most):
    keys = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    words, k = orphans.bloom_words(keys, ["k"], 3000, 0.01, most)
    pdf = keys.select(*orphans._hashes("k")).toPandas()
    pos = orphans._positions(pdf["_h1"].to_numpy(), pdf["_h2"].to_numpy(), k, words.size * 64)
    import numpy as np

    hit = (words[(pos >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (pos & np.uint64(63))) & np.uint64(1)
    assert hit.all()


# ---------------------------------------------------------------- structure


@pytest.mark.parametrize(
    ("text", "size", "bold", "expected"),
    [
        ("3 Method", 12.0, False, (1, "numbered")), ("2.1 Setup of it", 10.0, False, (2, "numbered")), ("3 apples were eaten by us", 10.0, False, None),
        ("A bold line", 10.0, True, (1, "styled")), ("Figure 3: of it", 14.0, True, None), ("IV. RESULTS OF IT", 10.0, False, (1, "numbered")),
        ("Introduction", 12.0, False, (1, "known")), ("123 Not a heading", 14.0, False, None), ("A large line that ends.", 13.0, False, None), ("", 14.0, True, None), ("x" * 91, 14.0, True, None),
    ],
)
def test_heading_rules(spark, text, size, bold, expected):
    df = spark.createDataFrame([(text, size, bold)], "t string, s double, b boolean")
    h = df.select(structure.heading_of(F.col("t"), F.col("s"), F.col("b"), F.lit(10.0)).alias("h")).first()["h"]
    assert (None if h is None else tuple(h)) == expected


def test_segment_failures(spark):
    text = ["before", "[1] First entry that goes", "on in a second line", "[2] x.", "[4] Fourth entry with enough text"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "doc_id long, line_no int, text string")
    assert rows(structure.segment_failures(df)) == [(1, "preamble", 1), (1, "sequence-gap", 1), (1, "too-short", 1)]


def test_numbered_segments(spark):
    text = ["before", "[1] First entry that goes", "on in a second line", "[2] x.", "[3] Third entry with enough text", "[4] Fourth entry with enough text"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "doc_id long, line_no int, text string")
    got = {r["entry_ix"]: (r["marker"], r["text"], r["too_short"]) for r in structure.segment_numbered(df).collect()}
    assert got[1] == ("1", "First entry that goes on in a second line", False) and got[2][2] is True and len(got) == 4


def test_longest_run_against_a_loop(spark):
    random.seed(5)
    docs = [[random.random() < 0.45 for _ in range(random.randrange(1, 30))] for _ in range(60)]

    def loop(hits):
        best, start, misses, at = 0, -1, 0, 0
        for i, h in enumerate(hits):
            if h:
                start, misses = (i if start < 0 else start), 0
            elif start >= 0:
                misses += 1
                if misses > 3:
                    if i - misses - start > best:
                        best, at = i - misses - start, start
                    start, misses = -1, 0
        if start >= 0 and len(hits) - start > best:
            best, at = len(hits) - start, start
        return (at, best) if best > 0 else None

    df = spark.createDataFrame([(d, i, "[1] x" if h else "words") for d, hs in enumerate(docs) for i, h in enumerate(hs)], "doc_id long, line_no int, text string")
    got = {r["doc_id"]: (r["first_line"], r["n_lines"]) for r in structure.citation_runs(df).collect()}
    assert got == {d: loop(hs) for d, hs in enumerate(docs) if loop(hs)}


# ---------------------------------------------------------------- entries


@pytest.mark.parametrize(
    ("head", "expected"),
    [
        ("Smith, J. A., van der Berg, K. and Ann Doe", [("Smith", "J. A.", None), ("van der Berg", "K.", None), ("Doe", "Ann", None)]),
        ("Jan van der Berg, A. Bell", [("van der Berg", "Jan", None), ("Bell", "A.", None)]), ("Llama3 Team", [(None, None, "Llama3 Team")]), ("x" * 301, []), ("", []), ("Doe, J. et al.", [("Doe", "J.", None)]),
    ],
)
def test_authors_of_a_head(spark, head, expected):
    r = spark.createDataFrame([(head,)], "h string").select(entries.authors_of(F.col("h")).alias("a")).first()
    assert [tuple(x) for x in r["a"]] == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("A. Bell, “A quoted title of some length,” Journal of It", "A quoted title of some length"), ("Smith, J. (2019). The title of the work. Journal, 3.", "The title of the work"), ("one", None),
        ("Bell, Anna. A third way to do it. Journal of It. 2001;3:1-2.", "A third way to do it"),
    ],
)
def test_titles_of_entries(spark, text, expected):
    assert entries.entry_fields(spark.createDataFrame([(1, text)], "k long, text string"), "k").first()["title"] == expected


def test_entry_fields_of_raw_text(spark):
    df = spark.createDataFrame([(1, "Smith, J. (2019). A title of four words. Journal of It, 3, 1-2. doi:10.1000/xyz."), (2, None)], "k long, text string")
    (r,) = entries.entry_fields(df, "k").collect()
    assert (r["doi"], r["year"], r["title"]) == ("10.1000/xyz", 2019, "A title of four words")


@pytest.mark.parametrize(
    ("score", "year", "author", "expected"),
    [(0.8, True, None, "verified"), (0.95, False, True, "low-confidence"), (0.9, True, False, "low-confidence"), (0.95, None, None, "verified"), (0.78, None, None, "low-confidence"), (0.5, True, True, "rejected")],
)
def test_verdicts(spark, score, year, author, expected):
    df = spark.createDataFrame([(score, year, author)], "s double, y boolean, a boolean")
    assert df.select(entries.verdict(F.col("s"), F.col("y"), F.col("a"))).first()[0] == expected


def test_similarity_join_loses_nothing(spark):
    random.seed(11)
    words = [f"w{i}" for i in range(14)]
    make = lambda n: [(i, [random.choice(words[: random.choice((4, 14))]) for _ in range(random.randrange(0, 8))]) for i in range(n)]
    a, b = make(70), make(70)

    def score(x, y):
        x, y = set(x), set(y)
        if not x or not y:
            return 0.0
        o, s, m = len(x & y), min(len(x), len(y)), max(len(x), len(y))
        return 1.0 if o == s and s >= 4 else o / m

    left, right = (spark.createDataFrame([(i, " ".join(t)) for i, t in z], f"{k} long, t string") for z, k in ((a, "l"), (b, "r")))
    for threshold in (0.75, 0.85):
        got = entries.similar_titles(entries.tokens(left, "l", F.col("t")), entries.tokens(right, "r", F.col("t")), "l", "r", threshold)
        assert {(r["l"], r["r"]) for r in got.collect()} == {(i, j) for (i, x), (j, y) in itertools.product(a, b) if score(x, y) >= threshold}


def test_repeated_titles_are_one_set(spark):
    """Pairs are of token sets, so titles that many rows have do not multiply before the rows are asked for."""
    left, right = (spark.createDataFrame([(i, "Editorial notes") for i in range(40)], f"{k} long, t string") for k in "lr")
    l, r, pairs = entries.similar_sets(*(entries.tokens(df, k, F.col("t")) for df, k in ((left, "l"), (right, "r"))))
    assert (l.count(), r.count(), pairs.count()) == (40, 40, 1)


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}


def test_a_written_stage_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    rows = session.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):  # they are removed in the background
        if _shuffle_files(spark) <= before:
            break
        time.sleep(0.2)
    assert _shuffle_files(spark) <= before and rows.count() == 7


def test_similarity_join_keeps_no_stage_that_is_done(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_stages", lambda _: f"file://{tmp_path}")
    left, right = (spark.createDataFrame([(i, f"notes on {w} of small rivers") for i, w in enumerate(("mud", "sand", "silt"))], f"{k} long, t string") for k in "lr")
    pairs = entries.similar_titles(*(entries.tokens(df, k, F.col("t")) for df, k in ((left, "l"), (right, "r"))), "l", "r")
    assert {p.name.rpartition("-")[0] for p in tmp_path.iterdir()} == {"similar-left", "similar-right", "similar-pairs"}
    assert pairs.count() == 9


def test_similarity_join_of_long_titles(spark):
    """Sets of more than PAIRED words meet by single words, and short ones that they contain by their rarest word."""
    random.seed(5)
    words = [f"w{i}" for i in range(90)]
    long = [random.sample(words, n) for n in (30, 33, 40, 44, 60, 75)]
    near = [x[: max(4, len(x) * k // 10)] for x in long for k in (2, 7, 8, 9)] + [[*x, "other"] for x in long]
    both = [(i, " ".join(t)) for i, t in enumerate([*long, *near])]

    def alike(x, y):
        x, y = set(x.split()), set(y.split())
        o, s, m = len(x & y), min(len(x), len(y)), max(len(x), len(y))
        return o == s and s >= 4 or o / m >= 0.75

    left, right = (spark.createDataFrame(both, f"{k} long, t string") for k in "lr")
    got = entries.similar_titles(entries.tokens(left, "l", F.col("t")), entries.tokens(right, "r", F.col("t")), "l", "r")
    assert sorted((x["l"], x["r"]) for x in got.collect()) == sorted((i, j) for (i, x), (j, y) in itertools.product(both, both) if alike(x, y))
    with pytest.raises(ValueError):
        entries.similar_sets(left, right, 0.5)


def test_best_record_among_many_of_one_title(spark):
    e = [(1, "Editorial", 2001, "Doe 2001"), (2, "Editorial", 1990, "Roe"), (3, "Editorial", None, "x"), (3, "Preface", None, "Lee"), (4, None, None, "Doe")]
    w = [(k, s, "Editorial", y, [(f, None, None)]) for k, s, y, f in [(9, "openalex", 2001, "Roe"), (8, "openalex", 2001, "Doe"), (7, "openalex", 2001, "Doe"), (6, "semanticscholar", 1990, "Roe")]] + [(5, "openalex", "Preface", 2001, None)]
    works = spark.createDataFrame(w, "work_key long, service string, title string, year int, author array<struct<family:string,given:string,literal:string>>")
    got = entries.resolve_by_title(spark.createDataFrame(e, "entry_key long, title string, year int, raw_text string"), works)
    assert rows(got) == [(1, 7, "openalex", 1.0, "verified"), (2, 6, "semanticscholar", 1.0, "verified"), (3, 5, "openalex", 1.0, "verified")]


def test_all_pairs_of_repeated_keys_and_titles(spark, monkeypatch):
    """Rows keep their number, also where only the most frequent word is ranked."""
    monkeypatch.setattr(entries, "FREQUENT", 1)
    left = spark.createDataFrame([(1, "Editorial notes"), (1, "Editorial notes"), (2, "Notes editorial"), (3, "!")], "l long, t string")
    right = spark.createDataFrame([(1, "Editorial: notes"), (2, None), (3, "editorial notes again")], "r long, t string")
    got = entries.similar_titles(entries.tokens(left, "l", F.col("t")), entries.tokens(right, "r", F.col("t")), "l", "r")
    assert rows(got) == [(1, 1, 1.0), (1, 1, 1.0), (2, 1, 1.0)]


def test_unmatched_works_of_repeated_titles(spark):
    e = spark.createDataFrame([(i, "Editorial notes", None) for i in range(30)] + [(99, None, "10.1/X")], "entry_key long, title string, doi string")
    w = [(i, "Notes, editorial", 2001, None) for i in range(30)] + [(50, "?", None, None), (51, "Another title", 2001, "10.1/x"), (52, "Another title", 2030, None), (53, "Another title", 0, None), (54, None, 2001, None)]
    works = spark.createDataFrame(w, "work_key long, title string, year int, doi string")
    assert rows(entries.unmatched_works(works, e, 2020)) == [(50,), (53,)]


def test_unmatched_works_meet_in_stages(spark, monkeypatch):
    """No two ways to meet hold their keys on disk at once."""
    labels = []
    monkeypatch.setattr(entries, "materialize", lambda df, label: labels.append(label) or session.materialize(df, label))
    known = spark.createDataFrame([(1, None, "notes on mud of small rivers")], "entry_key long, doi string, title string")
    works = spark.createDataFrame([(7, None, "Notes on mud of rivers", 2001), (8, None, "stars", 2001)], "work_key long, doi string, title string, year int")
    assert [r.work_key for r in entries.unmatched_works(works, known).collect()] == [8]
    assert labels.count("similar-met") == 3


@pytest.mark.parametrize("once", [1, 100_000])
def test_unmatched_works_in_rounds(spark, monkeypatch, once):
    """Works whose title an entry has ask no more, rounds lose no pair, and few pairs take their texts at a time."""
    random.seed(4)
    words = [f"w{i}" for i in range(40)]
    e = [" ".join(random.sample(words, random.randrange(2, 13))) for _ in range(60)] + [" ".join(f"x{i}" for i in range(n)) for n in (33, 40)]
    near = [" ".join([*x.split()[random.randrange(2) :], *random.sample(words, random.randrange(2))]) for x in e]
    w = [*e, *near, *(" ".join(random.sample(words, 6)) for _ in range(30))]

    def alike(x, y):
        x, y = set(x.split()), set(y.split())
        o, s, m = len(x & y), min(len(x), len(y)), max(len(x), len(y))
        return o == s and s >= 4 or o / m >= 0.75

    met, n_parts = [], []

    def seen(df, label):
        stage = session.materialize(df, label)
        if label == "similar-met":
            met.append({x["b_id"] for x in stage.collect()})
        n_parts.append(label == "resembling-seen")
        return stage

    monkeypatch.setattr(entries, "materialize", seen)
    monkeypatch.setattr(entries, "SETS_AT_ONCE", once)
    monkeypatch.setattr(entries, "PAIRS_AT_ONCE", 50 if once == 1 else 2_000_000)
    known = spark.createDataFrame([(i, None, t) for i, t in enumerate(e)], "entry_key long, doi string, title string")
    works = spark.createDataFrame([(i, None, t, 2001) for i, t in enumerate(w)], "work_key long, doi string, title string, year int")
    assert {r.work_key for r in entries.unmatched_works(works, known).collect()} == {i for i, t in enumerate(w) if not any(alike(x, t) for x in e)}
    assert len(met) == (entries.ROUNDS if once == 1 else 1) + 2 and sum(n_parts) > (2 if once == 1 else 1)
    assert len(set().union(*met)) <= len({frozenset(t.split()) for t in w} - {frozenset(t.split()) for t in e})


def test_rows_of_repeated_keys_collapse(spark):
    from citeloom.sources.tables import once, once_by_key

    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (None, "a"), (None, "a"), (None, None)], "k long, t string")
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(map(key, once_by_key(df, "k").collect())) == sorted(map(key, once(df).collect()))


def test_greedy_keeps_the_first_of_similar_ones(spark):
    df = spark.createDataFrame([("g", 1, "alpha beta gamma delta"), ("g", 2, "alpha beta gamma delta"), ("g", 3, "other words stand here"), ("h", 4, "alpha beta gamma delta")], "g string, work_key long, title string")
    assert rows(entries.greedy_distinct(df, ["g"], "work_key")) == [("g", 1), ("g", 3), ("h", 4)]


@pytest.mark.parametrize(("meta", "years", "expected"), [(None, [2014, 2017, 2016], 2017), (2023, [2014, 2017], 2018), (2017, [2015, 2017], 2017), (2020, [], 2020), (None, [], None)])
def test_paper_year(spark, meta, years, expected):
    e = spark.createDataFrame([("p", y) for y in years], "paper_id string, year int")
    m = spark.createDataFrame([("p", meta)], "paper_id string, meta_year int")
    assert entries.paper_years(e, m).first()["paper_year"] == expected


# ---------------------------------------------------------------- markers


def test_author_years_are_linked_or_reported(spark):
    e = spark.createDataFrame(
        [(1, "p", "r1", "Doe, J. (2001).", ([("Doe", "J", None)], [[2001]])), (2, "p", "r2", "Roe", ([("Roe", "A", None)], [[2002]])), (3, "p", "r3", "Roe", ([("Roe", "B", None)], [[2002]]))],
        "entry_key long, paper_id string, id string, raw_text string, csl struct<author:array<struct<family:string,given:string,literal:string>>,issued:array<array<int>>>",
    )
    m = spark.createDataFrame([(1, "p", "(Doe et al., 2001; Roe, 2002)"), (2, "p", "(Poe, 1999)"), (3, "p", None)], "marker_key long, paper_id string, raw string")
    got = {(r["marker_key"], r["surname"]): (r["outcome"], r["entry_key"]) for r in markers.link_author_years(m, e).collect()}
    assert got == {(1, "doe"): ("linked", 1), (1, "roe"): ("ambiguous", None), (2, "poe"): ("unresolved", None)}


def test_narrative_cites_and_all_years_are_linked(spark):
    e = spark.createDataFrame(
        [(1, "p", "Doe, J. (2023).", ([("Doe", "J", None)], [[2023]])), (2, "p", "Doe, J. (2024a).", ([("Doe", "J", None)], [[2024]])), (3, "p", "Doe, J. (2024b).", ([("Doe", "J", None)], [[2024]])), (4, "p", None, ([(None, None, "de la Roe Group")], [[2001]])), (5, "p", "x", None)],
        "entry_key long, paper_id string, raw_text string, csl struct<author:array<struct<family:string,given:string,literal:string>>,issued:array<array<int>>>",
    )
    m = spark.createDataFrame([(1, "p", "(Doe, 2023, 2024a,b)"), (2, "p", "Doe et al. (2023)"), (3, "p", "(de la Roe, 2001)"), (4, "p", "[3]")], "marker_key long, paper_id string, raw string")
    got = {(r["marker_key"], r["year"], r["letter"]): (r["outcome"], r["entry_key"]) for r in markers.link_author_years(m, e).collect()}
    assert got == {(1, 2023, ""): ("linked", 1), (1, 2024, "a"): ("linked", 2), (1, 2024, "b"): ("linked", 3), (2, 2023, ""): ("linked", 1), (3, 2001, ""): ("linked", 4)}


def test_superscript_numbers_are_linked(spark):
    e = spark.createDataFrame([(1, "p", "a", 0, "4"), (2, "p", "b", 1, "5")], "entry_key long, paper_id string, id string, entry_ix int, marker string")
    m = spark.createDataFrame([(1, "p", "⟦^4–5⟧")], "marker_key long, paper_id string, raw string")
    assert rows(markers.link_numbers(m, e)) == [(1, 4, 1), (1, 5, 2)]


def test_cite_commands_keep_what_is_unknown(spark):
    e = spark.createDataFrame([(1, "p", "a", 0, "1"), (2, "p", "b", 1, "3")], "entry_key long, paper_id string, id string, entry_ix int, marker string")
    m = spark.createDataFrame([(1, "p", "[3, 1-2]"), (2, "p", "[9]"), (3, "q", "[1]"), (4, "p", None)], "marker_key long, paper_id string, raw string")
    assert rows(export.cite_markers(m, e)) == [(1, "\\cite{b,a}"), (2, "[9]"), (3, "[1]")]


def test_last_entry_of_a_number_wins(spark):
    e = spark.createDataFrame([(1, "p", "a", 0, "1"), (2, "p", "b", 1, "1"), (3, "p", "c", 2, None)], "entry_key long, paper_id string, id string, entry_ix int, marker string")
    m = spark.createDataFrame([(1, "p", "[1, 3]")], "marker_key long, paper_id string, raw string")
    assert rows(markers.link_numbers(m, e)) == [(1, 1, 2), (1, 3, None)]


def test_markers_are_found_in_order(spark):
    s = spark.createDataFrame([(1, "p", 0, ["See [2] and (Doe, 2001).", None, "As Roe (1999) says⟦^4⟧, (a note of 2001)."])], "section_key long, paper_id string, section_ix int, paragraphs array<string>")
    got = markers.find_markers(s).orderBy("seq").collect()
    assert [(r["kind"], r["para_ix"]) for r in got] == [("bracket", 0), ("parenthetical", 0), ("superscript", 2), ("narrative", 2)]
    assert markers.style_vote(markers.find_markers(s)).first()["style"] == "author-year"


# ---------------------------------------------------------------- layout


def test_spans_become_lines_with_superscripts():
    row = [(72.0, 700.0, 30.0, 10.0, "known", False), (102.0, 704.0, 5.0, 6.0, "1,2", False), (110.0, 700.0, 20.0, 10.0, "fact", False)]
    assert layout.line_of(row)[0] == "known⟦^1,2⟧ fact"
    assert len(layout.visual_lines([(0, 700, 1, 10, "a", False), (5, 698, 1, 10, "b", False), (0, 690, 1, 10, "c", False)])) == 2


def test_columns_and_centers(spark):
    assert layout.column_centers([220, 72, 150, 73, 152]) == [72.5, 151, 220]
    df = spark.createDataFrame([("a", x) for x in (220.0, 72.0, 150.0, 73.0, 152.0)] + [("b", 1.0)], "g string, x double")
    assert {r["g"]: r["centers"] for r in layout.clusters(df, ["g"], "x").collect()} == {"a": [72.5, 151.0, 220.0], "b": [1.0]}
    two = [[(72.0, y, 100.0, 10.0, "l", False), (300.0, y, 100.0, 10.0, "r", False)] for y in range(700, 600, -10)]
    assert {c for c, _ in layout.split_columns(two, 236.0)} == {0, 1}


def test_tables_of_cells():
    made = [[(72.0, a), (150.0, b), (220.0, c)] for a, b, c in (("x", "y", "z|"), ("1", "2", "3"), ("4", "5", "6"))]
    assert layout.table_markdown(made).split("\n") == ["| x | y | z\\| |", "| --- | --- | --- |", "| 1 | 2 | 3 |", "| 4 | 5 | 6 |"]
    assert layout.table_markdown(made[:2]) is None


# ---------------------------------------------------------------- edits


def test_operations_apply_in_order(spark):
    p = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "z")], "section_key long, para_ix int, text string")
    o = spark.createDataFrame([(1, 0, "insert_paragraph", -1, "front"), (1, 1, "delete_paragraph", 1, None), (1, 2, "insert_paragraph", 1, "behind"), (1, 3, "replace_paragraph", 2, "C")], "section_key long, op_ix int, op string, at int, text string")
    assert rows(editing.apply_operations(p, o)) == [(1, 0, "front"), (1, 1, "a"), (1, 2, "behind"), (1, 3, "C"), (2, 0, "z")]


def test_violations(spark):
    s = spark.createDataFrame([(1, 2)], "section_key long, n_paragraphs int")
    o = spark.createDataFrame([(1, 0, "replace_paragraph", 0), (1, 1, "delete_paragraph", 0), (1, 2, "insert_paragraph", -1), (1, 3, "delete_paragraph", 5), (9, 4, "edit_heading", None)], "section_key long, op_ix int, op string, at int")
    assert rows(editing.structural_violations(s, o)) == [(1, 1, "conflict"), (1, 3, "out-of-range"), (9, 4, "no-section")]


def test_diff_rebuilds_both_sides():
    random.seed(2)
    for _ in range(50):
        a, b = ([random.choice("abcd") for _ in range(random.randrange(7))] for _ in "xy")
        parts = editing.word_diff(a, b)
        assert " ".join(w for k, w in parts if k != "add").split() == a and " ".join(w for k, w in parts if k != "del").split() == b
        assert all(x[0] != y[0] for x, y in zip(parts, parts[1:]))


def test_decisions(spark):
    p = spark.createDataFrame([("a", "proposed"), ("b", "approved")], "proposal_id string, status string")
    d = spark.createDataFrame([("a", "approve"), ("b", "approve"), ("c", "reject"), ("a", "maybe")], "proposal_id string, decision string")
    assert rows(editing.decide(p, d)) == [("a", "400"), ("a", "approved"), ("b", "409"), ("c", "404")]


# ---------------------------------------------------------------- review, export, reports, store


def test_review_resumes_and_judges(spark):
    u = spark.createDataFrame([("r", "section", "1"), ("r", "entry", "2")], "run_id string, unit_kind string, unit_id string")
    assert rows(review.pending(u, u.filter("unit_id = '1'"))) == [("r", "entry", "2")]
    pairs = spark.createDataFrame([(1, "long words stand here", "long words stand there"), (2, "nothing alike", "other topics"), (3, None, None)], "k long, claim string, source string")
    got = {r["k"]: r["verdict"] for r in review.judged(pairs, "k").collect()}
    assert got == {1: "supports", 2: "cannot-tell", 3: "cannot-tell"}
    assert review.findings(review.judged(pairs, "k"), "k").count() == 0


def test_claims_hold_three_distinct_sentences(spark):
    text = " ".join(f"The claim of number {w} stands here [7]." for w in ("one", "two", "two", "three", "four"))
    s = spark.createDataFrame([(1, "p", 0, [text])], "section_key long, paper_id string, section_ix int, paragraphs array<string>")
    got = review.claims(s).orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3] and len({r["sentence"] for r in got}) == 3


def test_bibliography_styles():
    csl = {"title": "A title.", "author": [{"family": "Doe", "given": "Jane A."}, {"family": "Roe", "given": "R"}], "year": 2001, "container_title": "J", "volume": "3", "page": "1-2"}
    assert export.render(csl, "apa") == "Doe, J. A., & Roe, R. (2001). A title. J, 3, 1-2."
    assert export.render(csl, "vancouver") == "Doe JA, Roe R. A title. J. 2001;3:1-2."
    assert export.render(csl, "harvard1") == "Doe, J. A. and Roe, R., 2001. A title. J, 3, pp.1-2."


def test_cites_and_tables_in_latex(spark):
    known = F.create_map(F.lit("1"), F.lit("a"), F.lit("3"), F.lit("c"))
    df = spark.range(1).select(export.cite_commands(F.lit("x [1-3], [9]."), known).alias("t"), export.tabular(F.lit("| a | b% |\n| --- | --- |\n| 1 | 2 |")).alias("b"))
    r = df.first()
    assert r["t"] == "x \\cite{a,c}, [9]."
    assert r["b"] == "{\\small\n\\begin{tabular}{l l}\na & b\\% \\\\ \\hline\n1 & 2 \\\\\n\\end{tabular}}"
    with pytest.raises(ValueError):
        export.export(df, df, "doc")


def test_failures_by_region(spark):
    f = spark.createDataFrame([("p", "resolve", "x", 2), ("p", "segment", "y", 3), ("p", "link-markers", "uncited-references", 9)], "paper_id string, stage string, code string, n long")
    assert rows(reports.by_region(f)) == [("p", "references", 5, 2)]


def test_uploads_and_versions(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 /CreationDate (D:20190101)")
    (tmp_path / "b.txt").write_bytes(b"x")
    (tmp_path / "c.pdf").write_bytes(b"0" * 60)
    good, bad = store.read_uploads(spark, f"file://{tmp_path}", most_bytes=50)
    assert [r["status"] for r in bad.orderBy("path").collect()] == ["415", "413"]
    assert [(r["is_pdf"], r["year"]) for r in store.pdf_header(good).collect()] == [(True, 2019)]
    v = spark.createDataFrame([("p", 1, "old"), ("p", 2, "new"), ("q", 1, "one")], "paper_id string, version_ts int, document string")
    assert rows(store.current_versions(v).select("paper_id", "document")) == [("p", "new"), ("q", "one")]
    assert store.load_document(v, "none").count() == 0


def test_unfinished_frames_wait(spark):
    t = spark.createDataFrame([(1, 'data: {"type":"a"}\n\n: note\n\ndata: {"type":"b"}\n\ndata: {"ty')], "stream long, value string")
    assert [r["event"] for r in store.parse_events(t).orderBy("seq").collect()] == ["a", "b"]


# ---------------------------------------------------------------- whole documents


def _document(spark):
    rows, y = [], 760.0
    for i, (text, size, page) in enumerate(
        [("A title of the work", 16.0, 1), ("some words before it all", 10.0, 1), ("1 Introduction", 12.0, 2), ("It was known [1] before this was said.", 10.0, 2), ("And so on [2, 3].", 10.0, 2), ("References", 12.0, 3), ("[1] Doe, J. 2001.", 10.0, 3)]
    ):
        rows.append((i, "p", page, i, text, 72.0, y - 12.0 * i, size, 0, False))
    return spark.createDataFrame(rows, "line_key long, paper_id string, page int, line_no int, text string, x_pos double, y_pos double, font_size double, col_no int, bold boolean")


def test_lines_become_sections_and_markers(spark):
    from citeloom.operators import parsing

    parsed = parsing.parse(_document(spark))
    got = {r["heading"]: (r["kind"], r["paragraphs"]) for r in parsed.sections.collect()}
    assert got["1 Introduction"][0] == "body" and got["References"][0] == "references" and "(front matter)" in got
    assert [r["raw"] for r in parsed.markers.orderBy("seq").collect()] == ["[1]", "[2, 3]"]
    assert parsed.titles.first()["title"] == "A title of the work"


def test_abstract_without_the_numbers_of_a_figure(spark):
    from citeloom.operators import parsing

    s = spark.createDataFrame(
        [("p", 0, "Abstract", ["This is a sentence of eight words or more.", "A stub", "1 2 3 4 5 6", "behind"]), ("q", 0, "Start", ["Abstract: led by the word."]), ("r", 0, "x", [None])],
        "paper_id string, section_ix int, heading string, paragraphs array<string>",
    )
    assert rows(parsing.abstracts(s)) == [("p", "This is a sentence of eight words or more.", True), ("q", "led by the word.", False)]


def test_small_workflow_operators(spark):
    from citeloom.operators import parsing

    pages = spark.createDataFrame([("a", 1, 2), ("a", 2, 2), ("b", 1, 2), ("b", 2, 1), ("c", 1, 1)], "paper_id string, page int, columns int")
    assert rows(parsing.layout_labels(pages)) == [("a", "two-column"), ("b", "mixed"), ("c", "single-column")]
    before = spark.createDataFrame([("p", 1, "unverified"), ("p", 2, "verified"), ("p", 3, "unverified")], "paper_id string, entry_key long, status string")
    after = spark.createDataFrame([("p", 1, "verified"), ("p", 2, "verified"), ("p", 3, "unverified")], "paper_id string, entry_key long, status string")
    assert rows(parsing.healed(before, after)) == [("p", 1, 1)]
    answers = spark.createDataFrame([(["a", "b", "c"], ["x", None, "z"])], "ids array<string>, records array<string>")
    assert rows(parsing.zipped_answers(answers)) == [("a", "x"), ("c", "z")]
    q = spark.createDataFrame([(1, i, f"q{i}") for i in range(4)] + [(9, 0, "lost")], "section_key long, pos int, query string")
    assert rows(parsing.guarded_queries(q, spark.createDataFrame([(1,)], "section_key long"))) == [(1, 0, "q0"), (1, 1, "q1")]
    f = spark.createDataFrame([(1, "missing-work", "s", "d" * 900)], "finding_id long, kind string, summary string, detail string")
    assert len(parsing.fix_commands(f).first()["command"]) == 490
    e = spark.createDataFrame([("p", 1, "verified", "text"), ("p", 2, "verified", None), ("p", 3, "verified", "t")], "paper_id string, number int, status string, abstract string")
    assert rows(parsing.checkable(e, spark.createDataFrame([("p", 1), ("p", 1), ("p", 2)], "paper_id string, number int")).select("number")) == [(1,)]


def test_two_level_windows_against_plain_ones(spark):
    from pyspark.sql import Window

    from citeloom.operators.prefix import chunk_of, previous, running_sum

    random.seed(9)
    data = [(random.choice("ab") if i % 7 else None, i, random.randrange(5)) for i in range(200)]
    df = spark.createDataFrame(data, "g string, i int, v int")
    w = Window.partitionBy("g").orderBy("i")
    plain = df.withColumn("s", F.sum("v").over(w)).withColumn("p", F.lag("v").over(w))
    made = previous(running_sum(df, ["g"], chunk_of(F.col("i"), 16), ["i"], F.col("v"), "s"), ["g"], chunk_of(F.col("i"), 16), ["i"], "v", "p")
    assert rows(made.select("g", "i", "v", "s", "p")) == rows(plain)
