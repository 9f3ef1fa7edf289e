import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeloom.llm import canonical_text as ct
from citeloom.llm import entity_matching as em
from citeloom.llm import mixing
from citeloom.llm import name_variants as nv
from citeloom.llm import near_duplicates as nd
from citeloom.llm import scan_repair as sr
from citeloom.llm import text_quality as tq
from citeloom.llm import tokenizer as tk
from citeloom.session import materialize


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def typo(rng, s, n=1):
    for _ in range(n):
        i = rng.randrange(len(s) - 1)
        s = rng.choice([s[:i] + s[i + 1 :], s[:i] + s[i + 1] + s[i] + s[i + 2 :], s[:i] + rng.choice("abcdefgh") + s[i + 1 :]])
    return s


# ---------------------------------------------------------------- 1 near duplicates


def _records(n=40):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "nur", "tes", "vol", "pra", "den"]) for _ in range(4))
    base = [f"{word()}, A. and {word()}, B. ({rng.randrange(1970, 2020)}). {' '.join(word() for _ in range(7))}. {word()} Journal, {rng.randrange(90)}, {rng.randrange(900)}-{rng.randrange(900)}." for _ in range(n)]
    out = []
    for i, b in enumerate(base):
        out += [(10 * i, b), (10 * i + 1, typo(rng, b, 3)), (10 * i + 2, b.replace(" ", "", 3).upper()), (10 * i + 3, b + " Reprinted.")]
    return out


def test_near_duplicates_against_all_pairs(spark):
    records = _records()
    p = nd.Params()
    skeleton = lambda t: "".join(c for c in t.lower() if c.isalnum())
    expected = {(a, b) for (a, x), (b, y) in itertools.combinations(records, 2) if skeleton(x) == skeleton(y) or nd.same_record(skeleton(x), skeleton(y), x, y, p)}
    df = spark.createDataFrame([(k, t, "x") for k, t in records], "entry_key long, raw_text string, class_id string")
    assert set(rows(nd.near_duplicate_pairs(df, "entry_key", "raw_text"))) == expected


def test_near_duplicates_of_odd_rows(spark):
    rng = random.Random(6)
    long = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(20_000))
    data = [(1, None), (2, ""), (3, ""), (4, "..."), (5, "Same text of it"), (5, "Same text of it"), (6, "same TEXT of-it"), (7, long), (8, long + "more"), (None, "Same text of it"), (9, "ab")]
    df = spark.createDataFrame(data, "entry_key long, raw_text string")
    assert rows(nd.near_duplicate_pairs(df, "entry_key", "raw_text")) == [(2, 3), (5, 6), (7, 8)]
    members, _ = nd.near_duplicate_classes(df, "entry_key", "raw_text")
    assert {r["entry_key"] for r in members.collect()} == {2, 3, 4, 5, 6, 7, 8, 9}
    assert nd.near_duplicate_pairs(df.limit(0), "entry_key", "raw_text").count() == 0


def test_a_hot_cell_loses_no_pair(spark):
    """Half of the rows are copies with small edits; partitions far below the usual size are split as skewed."""
    rng = random.Random(5)
    one = _records(1)[0][1]
    records = [(1000 + i, typo(rng, one, 1)) for i in range(120)] + _records(12)
    df = spark.createDataFrame(records, "entry_key long, raw_text string")
    usual = rows(nd.near_duplicate_pairs(df, "entry_key", "raw_text"))
    assert {(a, b) for a, b in itertools.combinations(sorted(k for k, _ in records if k >= 1000), 2)} <= set(usual)
    names = ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionFactor", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in zip(names, ("1KB", "1", "-1", "1KB")):
            spark.conf.set(n, v)
        assert rows(nd.near_duplicate_pairs(df, "entry_key", "raw_text")) == usual
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_rounds_write_only_near_pairs_and_lose_none(spark, monkeypatch):
    """What meets in a cell is dropped there unless the folded embedding lets it through, in any number of rounds."""
    rng, p = random.Random(5), nd.Params()
    head = "journal of rural education and practice volume of the proceedings"
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(90)) for _ in range(40)]
    texts = [head + w for w in words] + [head + w[:-2] for w in words[:10]]
    items = spark.createDataFrame([(i, t.replace(" ", "")) for i, t in enumerate(texts)], "id long, skeleton string")
    vectors = nd.embedded(items, p).cache()
    written = []
    monkeypatch.setattr(nd, "materialize", lambda df, label: written.append(materialize(df, label)) or written[-1])
    once, turns = (set(rows(nd.candidates(vectors, p, n))) for n in (1, 5))
    cells = {r["id"]: set(r["cells"]) for r in vectors.collect()}
    met = sum(bool(cells[i] & cells[j]) for i in cells for j in cells if i < j)
    assert once == turns >= {(i, 40 + i) for i in range(10)}
    assert len(written) == 6 and written[0].count() < met / 2


def _edited(rng, length, jaccard):
    """A text of random letters and a copy with equally spread one-letter edits, of about that similarity."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    a = "".join(rng.choice(letters) for _ in range(length))
    n = max(1, round(length * (1 - jaccard) / (1 + jaccard) / 3))
    while True:
        b = list(a)
        for i in range(n):
            b[min(length - 1, int((i + rng.random()) * length / n))] = rng.choice(letters)
        x, y = nd.trigrams(a), nd.trigrams("".join(b))
        if len(x & y) <= (jaccard + 0.01) * len(x | y):
            return a, "".join(b)
        n += max(1, n // 20)


@pytest.mark.parametrize("length", [60, 150, 300, 600, 1500, 4000])
def test_similar_records_meet_at_every_length(length):
    rng, p = random.Random(length), nd.Params()
    for jaccard in (0.7, 0.8, 0.9):
        met = tried = 0
        for _ in range(120 if length < 1000 else 50):
            pair = _edited(rng, length, jaccard)
            if not nd.same_record(*pair, *pair, p):
                continue
            owner, bit = nd.fingerprint(list(pair))
            record, cell = nd.cells_of(owner, bit, np.bincount(owner, minlength=2), p)
            met += bool(set(cell[record == 0]) & set(cell[record == 1]))
            tried += 1
        assert tried >= 40 and met >= 0.98 * tried


@settings(max_examples=40, deadline=None)
@given(st.text("abcdef12", min_size=3, max_size=60), st.text("abcdef12", min_size=3, max_size=60))
def test_manhattan_distance_is_a_lower_bound(a, b):
    owner, bit = nd.fingerprint([a, b])
    v = np.unpackbits(nd.fold(owner, bit, 2).view(np.uint8), axis=1).astype(int)
    assert np.abs(v[0] - v[1]).sum() <= len(nd.trigrams(a) ^ nd.trigrams(b))


# ---------------------------------------------------------------- 3 names

PEOPLE = [
    (1, "Kerlanvol", "Daniel", None), (2, "Kerlanvol", "Dan", None), (3, None, None, "KERLANVOL, D."), (4, "Daniel", "Kerlanvol", None), (5, "Kerlnavol", "Daniel", None),
    (6, "Kerlanvol", "Matthew", None), (7, "Kerlanvol", "M", None), (8, "di Zesonlelze", "Ann", None), (9, "Dizesonlelze", "Ann", None),
    (10, None, None, "Institute of Applied Physics, Torvanmul"), (11, None, None, "Torvanmul Inst. for Appl. Phys."), (12, None, None, "IAP Torvanmul"), (13, None, None, "Institute of Applied History, Torvanmul"),
    (14, None, None, None), (15, "", "  ", "..."), (1, "Kerlanvol", "Daniel", None), (16, "Kerlanvol", "Dr. D.", None),
]


def _crowd():
    """Other people and organisations, so that given names and subjects are common words as they are in a corpus."""
    rng = random.Random(12)
    family = lambda: "".join(rng.choice(["kor", "lim", "pas", "gur", "tin", "fol", "jer", "bun"]) for _ in range(4)).capitalize()
    given = ["Daniel", "Dan", "Matthew", "Ann", "Deborah", "D.", "M."] * 25
    people = [(1000 + i, family(), g, None) for i, g in enumerate(given)]
    short = [(3000 + i, None, None, f"{family()} Inst. for Appl. {s}") for i, s in enumerate(["Phys.", "Hist."] * 25)] + [(4000 + i, None, None, f"IAP {family()}") for i in range(25)]
    return people + short + [(2000 + i, None, None, f"Institute of Applied {s}, {family()}") for i, s in enumerate(["Physics", "History"] * 25)]


def test_names_are_grouped(spark):
    df = spark.createDataFrame([(*r, "x") for r in PEOPLE + _crowd()], "name_key long, family string, given string, literal string, form string")
    groups = {}
    for r in nv.name_groups(df).filter("name_key < 1000").collect():
        groups.setdefault(r["group_id"], set()).add(r["name_key"])
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3, 4, 5, 16], [6, 7], [8, 9], [10, 11, 12], [13]]


def test_names_pass_the_driver_only_if_measured_as_few(spark, monkeypatch):
    plans, write = {}, nv.materialize

    def seen(df, label="stage"):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label)

    monkeypatch.setattr(nv, "materialize", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    names = [(1, "Lindqvist", "Robert", None), (2, "Lindqvist", "Bob", None), (3, "Lindkvist", "R.", None), (4, "Okonkwo", "Amara", None)]
    got = nv.name_pairs(spark.createDataFrame(names, "name_key long, family string, given string, literal string"))
    assert {"names-tokens", "names-met", "names-good"} <= set(plans) and not [label for label, plan in plans.items() if "BroadcastHashJoin" in plan]
    assert sorted(map(tuple, got.collect())) == [(1, 2), (1, 3), (2, 3)]
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before and spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None


def test_vague_names_are_not_guessed(spark):
    vague = [(1, "Torvanmul", "Daniel", None), (2, "Torvanmul", "Deborah", None), (3, "Torvanmul", "D.", None), (4, "Torvanmul", None, None)]
    df = spark.createDataFrame(vague + _crowd(), "name_key long, family string, given string, literal string")
    assert nv.name_pairs(df).filter("name_key_a < 1000").count() == 0
    assert nv.name_pairs(df.limit(0)).count() == 0


def test_variants_of_a_hot_family_meet(spark):
    """A third of the names have one family name, which is in no name's prefix; given names differ in spelling."""
    rng = random.Random(3)
    given = ["".join(rng.choice(["ka", "lo", "mi", "nu", "te", "vo"]) for _ in range(4)).capitalize() for _ in range(60)]
    hot = [(i, "Torvanmul", g, None) for i, g in enumerate(given)] + [(100, "Torvanmul", "Robert", None), (101, None, None, "TORVANMUL, Bob"), (102, "Torvnamul", "Robert", None), (103, "Quentin", "Torvanmul", None), (104, "Torvanmul", "Q.", None)]
    df = spark.createDataFrame(hot + _crowd(), "name_key long, family string, given string, literal string")
    df = df.unionByName(spark.createDataFrame([(9000 + i, f"Family{chr(97 + i % 26) * 3}{chr(97 + i // 26) * 3}", g, None) for i, g in enumerate(["Robert", "Bob", "Quentin"] * 30)], df.schema))
    got = {tuple(r) for r in nv.name_pairs(df).filter("name_key_b < 1000").collect()}
    assert {(100, 101), (100, 102), (101, 102), (103, 104)} <= got


def test_groups_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(PEOPLE + _crowd(), "name_key long, family string, given string, literal string")
    first = rows(nv.name_pairs(df.repartition(7)))
    assert rows(nv.name_pairs(df.repartition(3, "given"))) == first


def test_token_join_against_all_pairs(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice(["kar", "lon", "mis", "nur", "tes", "vol"]) for _ in range(3)) for _ in range(40)]
    words = sorted({*base, *(typo(rng, b) for b in base)})
    p = nv.Params()
    expected = set()
    for a, b in itertools.permutations(words, 2):
        if min(len(a), len(b)) >= p.least_typo and nv.close_tokens(a, b):
            expected.add((a, b))
    got = set(rows(nv.token_neighbours(spark.createDataFrame([(w,) for w in words], "t string"), p)))
    assert got == expected


# ---------------------------------------------------------------- 4 scanned text

SENTENCES = ["the circular register and the method of sediment were found before it", "the reservoir of the river can measure a peer-reviewed habitat", "they describe the nonlinear method with the reservoir and the habitat"]


def _scanned(spark, lines=(), paragraphs=(), entries=()):
    clean = [(1000 + i, "c", 1, i, t, 400.0) for i, t in enumerate(SENTENCES * 30)]
    tl = spark.createDataFrame(clean + list(lines), "line_key long, paper_id string, page int, line_no int, text string, y_pos double")
    se = spark.createDataFrame(list(paragraphs) or [(1, None)], "section_key long, paragraphs array<string>")
    re = spark.createDataFrame(list(entries) or [(1, None)], "raw_key long, text string")
    return sr.repair(tl, se, re)


def test_scanned_lines_are_repaired(spark):
    lines = [
        (1, "p", 3, 0, "ON THE METHOD OF IT [3]", 760.0), (2, "p", 3, 1, "the cireular register and the me-", 700.0), (3, "p", 3, 2, "thod of a peer-", 690.0), (4, "p", 3, 3, "reviewed reserv0ir.", 680.0),
        (4, "p", 3, 3, "reviewed reserv0ir.", 680.0), (5, "p", 3, 4, None, 670.0), (6, "p", 3, 5, "  ", 660.0), (7, "p", 3, 6, "Page 3 of 9", 40.0),
    ]
    got = _scanned(spark, lines).filter("tbl = 'text_lines' AND row_key < 100").collect()
    kinds = {(r["row_key"], k) for r in got for k in r["kinds"]}
    assert kinds == {(1, "furniture"), (2, "misread"), (2, "hyphen"), (4, "misread"), (7, "furniture")}
    text = {r["row_key"]: r["repaired"] for r in got}
    assert text[2] == "the circular register and the method" and text[3] == "of a peer-" and text[4] == "reviewed reservoir." and text[1] is None


def test_paragraphs_and_entries_are_repaired(spark):
    found = _scanned(
        spark,
        paragraphs=[(1, ["they descri- be the me¬\nthod", None, "", "the river - 17 - can measure", "two- and three-way methods"]), (1, ["they descri- be the me¬\nthod", None, "", "the river - 17 - can measure", "two- and three-way methods"]), (2, None)],
        entries=[(1, "Doe, J. The reservolr of the hab1tat. 2001. REFERENCES 65"), (2, None)],
    )
    assert set(rows(sr.found(found).filter("tbl <> 'text_lines'"))) == {("sections", 1, 0, "hyphen"), ("sections", 1, 3, "furniture"), ("raw_entries", 1, 0, "misread"), ("raw_entries", 1, 0, "furniture")}
    text = {(r["row_key"], r["para_ix"]): r["repaired"] for r in found.filter("tbl = 'sections'").collect()}
    assert text[(1, 0)] == "they describe the method" and text[(1, 3)] == "the river can measure" and text[(1, 4)] == "two- and three-way methods"


def test_names_with_numbers_are_no_furniture():
    names = ["Open Access Repository System", "The Protein Data Bank Consortium", "Royal Society Fellows Programme", "National Library Reading Service", "Human Genome Mapping Project"]
    texts = [f"{a} {n} {y} {b}" for n in names for y in (12, 1999, 2019, 2020, 3) for a, b in (("the", "release"), ("As", "was used"))]
    texts += ["NASA ESA JAXA 12 missions", "the GDP USD EUR 100 series", "see Page 12 of it", "Fig 3 shows 12 - 14 of them"]
    assert len(texts) > 50 and all(sr.cut_furniture(t, True) == (t, False) for t in texts)
    assert sr.cut_furniture("how much On The Turbine Of Recurrent Markets 479 of this", True) == ("how much of this", True)


def test_decoding_is_the_same_in_runs_and_whole(spark):
    model = sr.learn(spark.createDataFrame([(t,) for t in SENTENCES * 30], "text string"))
    words = "the cireular register and the mefhod of sediment were fouud before rescrvoir habitat".split() * 60
    whole = model._viterbi(words, [model.candidates(w) for w in words])
    assert model.decode(words) == whole and {"circular", "method"} <= set(whole) and len(whole) == len(words) > 600


def test_lines_without_page_stand_alone(spark):
    got = _scanned(spark, [(k, None, None, 0, "the river - can measure", None) for k in range(5)])
    assert got.filter("tbl = 'text_lines' AND row_key < 10").count() == 5


def test_empty_scans(spark):
    none = [spark.createDataFrame([], s) for s in ("line_key long, paper_id string, page int, line_no int, text string, y_pos double", "section_key long, paragraphs array<string>", "raw_key long, text string")]
    assert sr.repair(*none).count() == 0


# ---------------------------------------------------------------- 5 matching entities

CSL = "struct<title:string,author:array<struct<family:string,given:string,literal:string>>,issued:array<array<int>>,volume:string,page:string>"


def _person(*names):
    return [(n, "J.", None) for n in names]


def test_entities_match_by_rules(spark):
    title = "Circular registers of river delta habitats with modular methods"
    e = [
        (1, (title, _person("Kerlanvol", "Doe"), [[2001]], "3", "10-20")), (2, ("Circular regsters of river delta habitats with modular methods", _person("Kerlanvol"), None, None, None)),
        (3, (None, _person("Kerlanvol", "Doe"), [[2001]], "3", None)), (4, ("Editorial", _person("Roe"), [[1999]], None, None)), (5, (None, None, None, None, None)), (6, None), (7, (title, None, [[2001]], None, None)),
    ]
    w = [
        (10, "a", title.upper(), _person("Kerlanvol", "Doe"), [[2001]], "3", "10"), (11, "b", title, [(None, None, "J. Kerlanvol")], [[2002]], None, None), (12, "a", "Editorial", _person("Poe"), [[1999]], None, None),
        (13, "b", "Editorial", _person("Roe"), [[1999, 3]], "1", None), (14, "a", "Another title of other words entirely", _person("Kerlanvol", "Doe"), [[1980]], None, None), (15, "b", None, None, None, None, None),
    ]
    entries = spark.createDataFrame([(k, c, "x") for k, c in e], f"entry_key long, csl {CSL}, service string")
    works = spark.createDataFrame(w, "work_key long, service string, title string, author array<struct<family:string,given:string,literal:string>>, issued array<array<int>>, volume string, page string")
    got = em.match(entries, works).collect()
    assert {(r["entry_key"], r["work_key"]) for r in got} == {(1, 10), (1, 11), (2, 10), (2, 11), (3, 10), (4, 13), (7, 10), (7, 11)}
    assert all(0 < r["confidence"] <= 1 for r in got)
    assert em.match(entries.limit(0), works).count() == 0 and em.match(entries, works.limit(0)).count() == 0


RAW_STYLES = [
    "J. Kerlanvol, R. de Doe, “{t},” Journal of Tests, vol. 3, pp. 1950-1960, 2001.",
    "Kerlanvol, J. and de Doe, R., 2001. {t}. Journal of Tests, 3, pp.1950-1960. Accessed 12 May 2021.",
    "Kerlanvol J, de Doe RS. {t}. Journal of Tests. 2001;3:1950-1960.",
    "Kerlanvol, J., de Doe, R. (2001). {t}. Journal of Tests, 3, 1950-1960.",
    "Jane Kerlanvol, Rob de Doe. “{t}.” Journal of Tests 3 (2001): 1950-1960.",
]


def test_what_csl_lacks_is_read_off_the_raw_text(spark):
    title, other = "Circular registers of river delta habitats with modular methods", "Seasonal tariffs in coastal markets and rural curricula"
    styles = [(10 * i, s.format(t=title)) for i, s in enumerate(RAW_STYLES)]
    df = spark.createDataFrame(styles, "k long, raw_text string")
    t, a, y = em.read_off(F.col("raw_text"))
    read = df.select(em._words(t).alias("t"), em._families(a).alias("a"), y[0][0].alias("y")).collect()
    assert {tuple(r) for r in read} == {(title.lower(), "kerlanvol|dedoe", 2001)}
    bare = [(k, x, (None, None, None, None, None)) for k, x in styles]
    torn = "J. Kerlanvol, R. de Doe ;Circular registers of river delta habitats with modular methods” Journal of Tests  vol. 3"
    more = [(1, torn, (None, None, None, None, None)), (2, RAW_STYLES[0].format(t="Editorial"), ("Editorial", None, None, None, None)), (3, RAW_STYLES[2].format(t=other), (None, _person("Kerlanvol"), [[2001]], None, None)), (4, None, (None, None, None, None, None))]
    entries = spark.createDataFrame(bare + more, f"entry_key long, raw_text string, csl {CSL}")
    w = [(100, "a", title, _person("Kerlanvol", "de Doe"), [[2001]], None, None), (101, "a", "Editorial", _person("Kerlanvol", "de Doe"), [[2001]], None, None), (102, "b", title, None, None, None, None)]
    works = spark.createDataFrame(w, "work_key long, service string, title string, author array<struct<family:string,given:string,literal:string>>, issued array<array<int>>, volume string, page string")
    got = {(r["entry_key"], r["work_key"]) for r in em.match(entries, works).collect()}
    assert got == {(k, x) for k in (*range(0, 50, 10), 1) for x in (100, 102)} | {(2, 101)}


def test_scores_of_titles_and_authors():
    assert em.title_score(["a", "title"], ["a", "title"]) == 1.0 and em.title_score([], ["x"]) is None
    assert em.author_score(["doe", "roe"], ["roe"]) == 1.0 and em.author_score([], ["x"]) is None


def test_confidence_is_close_to_the_precision_held_out(spark):
    """Publications with twins by the same authors; every second entry has a volume and a page, the rest is held out."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice(["kar", "lon", "mis", "nur", "tes", "vol", "ped", "rim"]) for _ in range(3))
    entries, works, truth = [], [], set()
    for k in range(160):
        names = [(word().capitalize(), "A.", None) for _ in range(1 + k % 3)]
        title, year = " ".join(word() for _ in range(7)), 1980 + k % 30
        twin = " ".join([*title.split()[:4], *(word() for _ in range(3))]) if k % 4 == 0 else " ".join(word() for _ in range(7))
        for j, (text, key) in enumerate(((title, k), (twin, 1000 + k))):
            works.append((key, "s", text, names, [[year]], str(k % 90 + j), f"{10 * k + j}-{10 * k + 9}"))
        typed = typo(rng, title, k % 4)
        entries.append((k, (typed, names, [[year]], str(k % 90) if k // 4 % 2 else None, f"{10 * k}" if k // 4 % 2 else None)))
        truth.add((k, k))
    person = "array<struct<family string, given string, literal string>>"
    e = spark.createDataFrame(entries, f"entry_key long, csl struct<title string, author {person}, issued array<array<int>>, volume string, page string>")
    w = spark.createDataFrame(works, f"work_key long, service string, title string, author {person}, issued array<array<int>>, volume string, page string")
    got = em.match(e, w).collect()
    pairs = {(r["entry_key"], r["work_key"]) for r in got}
    assert len(pairs & truth) >= 0.95 * len(truth) and len(pairs & truth) >= 0.95 * len(pairs)
    for rule in {r["rule"] for r in got}:
        held_out = [(r["entry_key"], r["work_key"]) in truth for r in got if r["rule"] == rule and r["entry_key"] // 4 % 2 == 0]
        if len(held_out) >= 20:
            confidence = next(r["confidence"] for r in got if r["rule"] == rule)
            assert abs(confidence - sum(held_out) / len(held_out)) < 0.12


# ---------------------------------------------------------------- 6 canonical text


@pytest.mark.parametrize(
    ("text", "form"),
    [("Ｋｏ ｉｓ", "Ko is"), ("résumé", "résumé"), ("cut-oﬀ", "cut-off"), ("i﻿n it", "in it"), ("ɡraԁieոt", "gradient"), ("Воth", "Both"), ("e​́", "é"), ("е́tude", "étude")],
)
def test_look_alikes_get_one_form(text, form):
    assert ct.canonical(text) == form and ct.suspicious(text) and not ct.suspicious(form)


@pytest.mark.parametrize("text", [None, "", "plain", "résumé “x” — 1–4", "«решётка»", "λόγος ώρα", "Δt β-sheet θ ∈ [0, 1] 20 °C μm", "ρc"])
def test_other_characters_stay(text):
    assert ct.canonical(text) == text and not ct.suspicious(text)


@settings(max_examples=300, deadline=None)
@given(st.text("aeо́ｅ​ ɡТh ﬁβ", max_size=14))
def test_one_form_is_a_fixed_point(text):
    once = ct.canonical(text)
    assert ct.canonical(once) == once


def test_conflicts_are_refused():
    with pytest.raises(ct.Conflict):
        ct.compile_rules({"x": "y"}, {"x": "z"})
    with pytest.raises(ct.Conflict):
        ct.compile_rules({"x": "y", "y": "z"})


def test_the_sql_of_cases_agrees(spark):
    import duckdb

    from citeloom.llm import queries

    texts = ["Ｋｏ", "résumé", "résumé", "cut-oﬀ", "i﻿n", "ɡraԁieոt", "Воth", "решётка", "λόγος", "Δt", "β-sheet", "plain", "", None, "ɡ", "νector", "x y"]
    con = duckdb.connect()
    for t, key, col in (("text_spans", "span_key", "text"), ("works", "work_key", "title"), ("raw_entries", "raw_key", "text")):
        con.execute(f"CREATE TABLE {t} ({key} BIGINT, {col} VARCHAR)")
    con.execute("CREATE TABLE ref_entries (entry_key BIGINT, csl STRUCT(title VARCHAR))")
    con.executemany("INSERT INTO text_spans VALUES (?, ?)", list(enumerate(texts)))
    assert {r[1] for r in con.execute(queries.SQL["p6_found"]).fetchall()} == {i for i, t in enumerate(texts) if ct.suspicious(t)}


def test_cases_in_a_table(spark):
    df = spark.createDataFrame([(1, "ｘ"), (2, "x"), (3, None), (4, ""), (5, "é " * 50_000 + "​"), (6, "решётка")], "k long, t string")
    assert rows(ct.cases(df, "t", "k", F.col("t"))) == [("t", 1), ("t", 5)]
    assert {r["k"]: r["c"] for r in df.select("k", ct.canonical_column(F.col("t")).alias("c")).collect()}[1] == "x"


# ---------------------------------------------------------------- 7 tokens


def _reference():
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tk.read_ranks(tk.VOCABULARY), special_tokens={})


def test_ids_equal_those_of_the_public_tokenizer():
    enc, ref, rng = tk.Encoder(tk.sentencepiece_model(tk.read_ranks(tk.VOCABULARY))), _reference(), random.Random(1)
    parts = ["a", "the", "'s", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "é", "中文", "1", "²", "🙂", "<|endoftext|>", "\x00", "▁", "'ll", "\r\n", "क्षि", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert enc.encode(text) == ref.encode_ordinary(text)
        assert enc.decode(enc.encode(text)) == text


def test_encoding_a_table(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 1), (3, "Two words", 2), (4, "x" * 200_000, 3)], "doc_id long, text string, ids int")
    got = {r["doc_id"]: r["ids"] for r in tk.encode_documents(df).collect()}
    ref = _reference()
    assert got[1] == got[2] == [] and got[3] == ref.encode_ordinary("Two words") and got[4] == ref.encode_ordinary("x" * 200_000)
    assert {r["doc_id"]: r["n_tokens"] for r in tk.count_tokens(df).collect()} == {k: len(v) for k, v in got.items()}
    assert tk.encode_documents(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 8 mixing


def _mixed(spark, total=None):
    docs = [(i, "big", "word " * (3 + i % 5)) for i in range(400)] + [(1000 + i, "small", "word " * 6) for i in range(20)] + [(2000, "none", "word"), (2001, None, "word"), (2002, "big", None), (2003, "big", "")]
    targets = [("big", 0.7, 1), ("small", 0.3, 3), ("absent", 0.1, 2), (None, 0.1, 1), ("bad", None, 1)]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string")
    t = spark.createDataFrame(targets, "source_name string, target_share double, max_repeats int")
    m, s = mixing.mix(d, t, mixing.Params(total_tokens=total, shard_tokens=256, blocks_per_shard=4))
    return m.collect(), {r["source"]: r for r in s.collect()}


def test_mixture_has_its_shares_and_repeats(spark):
    m, s = _mixed(spark)
    assert max(sum(1 for _ in g) for _, g in itertools.groupby(sorted(r["doc_id"] for r in m))) <= 3
    assert len({(r["doc_id"], r["copy"]) for r in m}) == len(m) and all(r["copy"] == 0 for r in m if r["source"] == "big")
    assert s["big"]["actual_share"] == pytest.approx(0.7, abs=0.02) and s["small"]["actual_share"] == pytest.approx(0.3, abs=0.02)
    assert s["absent"]["tokens"] == 0 and s["small"]["most_uses"] == 3
    by_shard = {}
    for r in m:
        by_shard.setdefault(r["shard"], []).append(r["position"])
    assert all(sorted(p) == list(range(len(p))) for p in by_shard.values())


def test_mixture_of_a_given_size(spark):
    _, s = _mixed(spark, 300)
    assert abs(s["big"]["tokens"] - 210) <= 8 and abs(s["small"]["tokens"] - 90) <= 8


def test_blocks_are_dealt_whole():
    rng = np.random.default_rng(1)
    dealt = mixing.split_blocks([17, 3, 40], 7, rng)
    assert dealt.sum(axis=0).tolist() == [17, 3, 40] and dealt.sum(axis=1).max() - dealt.sum(axis=1).min() <= 1


def test_nothing_to_mix(spark):
    d = spark.createDataFrame([], "doc_id long, source string, text string")
    t = spark.createDataFrame([("a", 1.0, 1)], "source_name string, target_share double, max_repeats int")
    m, s = mixing.mix(d, t)
    assert m.count() == 0 and s.first()["tokens"] == 0


# ---------------------------------------------------------------- 9 quality

PROSE = "This is because the method of it was found before the other one. They did not see that it would change. "
WORDS = [("en", w) for w in "the of and to is was that it they not be by".split()] + [("de", w) for w in "der die und ist nicht das".split()]


def _quality(spark, docs):
    d = spark.createDataFrame([(i, t, lang, "x") for i, (t, lang) in enumerate(docs)], "doc_id long, text string, lang string, chars string")
    c = spark.createDataFrame([(lang, w, i) for i, (lang, w) in enumerate(WORDS)], "lang string, word string, word_rank int")
    return d, c


def test_junk_is_told_from_prose(spark):
    docs = [(PROSE * 3, "en")] * 6 + [
        (PROSE.upper() * 2, None), (PROSE.replace(". ", "\n") * 2, "EN"), ("> " + PROSE, "xx"), (None, "en"), ("", "en"), ("  \n ", "en"), ("1) an item\n2) another item\n3) a third", "en"),
        ("| a | b |\n| --- | --- |\n| 1 | 2 |", "en"), ("x#@! %% ^^ ~~ #@! %%", "en"), ("page break " * 50, "en"), ("a1b2c3d4 " * 30, "de"), (PROSE + "\n" + "| 1 | 2 | 3 | 4 |\n" * 20, "en"),
        ("Das ist nicht der Fall und die Sache ist klar. " * 3, "en"),
    ]
    d, c = _quality(spark, docs)
    assert {r["doc_id"] for r in tq.found(d, c).collect()} == {12, 13, 14, 15, 16, 17}
    stats = {r["doc_id"]: r for r in tq.scored(d, c).collect()}
    assert len(stats) == len(docs) and stats[18]["lang"] == "de" and stats[9]["n_words"] == 0 and stats[9]["prose_share"] is None and not stats[10]["candidate"]
    assert tq.found(d.limit(0), c).count() == 0


def test_groups_of_junk_alone_lose_no_document(spark):
    debris = "zshb hlnknbjsd nckp ckmzf vrtw plkg"
    docs = [(debris, None)] * 30 + [("zshb hlnknbjsd nckp, ckmzf. 12 # 3", None)] + [("die der das und 1 2 3 | 4 | 5 |", "de")] + [(PROSE * 3, "en")] * 5 + [("  ", None)]
    d, c = _quality(spark, docs)
    stats = tq.scored(d, c).collect()
    assert {r["doc_id"] for r in tq.found(d, c).collect()} == set(range(32))
    assert {r["doc_id"] for r in stats if r["chars"] and r["prose_chars"] < 0.5 * r["chars"]} <= {r["doc_id"] for r in stats if r["candidate"]}
    scores = sorted((r["outlier_score"] for r in stats if r["lang"] == "und" and r["chars"]), reverse=True)
    assert all(r["candidate"] for r in stats if r["outlier_score"] is not None and r["lang"] == "und" and r["outlier_score"] >= scores[0])


def test_the_score_chooses_what_is_checked(spark):
    docs = [(PROSE * (1 + i % 5), "en") for i in range(120)] + [(f"- item {i} ## {i * 7}\n- thing %% {i}\n- other {i}", "en") for i in range(40)]
    d, c = _quality(spark, docs)
    rows_ = tq.scored(d, c).collect()
    junk = {r["doc_id"] for r in rows_ if r["prose_share"] < 0.5}
    least = min(r["outlier_score"] for r in rows_ if r["doc_id"] in junk)
    assert junk == set(range(120, 160)) == {r["doc_id"] for r in tq.found(d, c).collect()}
    assert {r["doc_id"] for r in rows_ if r["candidate"]} == {r["doc_id"] for r in rows_ if r["outlier_score"] >= least} != set(range(160))


def test_a_bar_in_a_long_line_is_no_table_row(spark):
    d, c = _quality(spark, [(PROSE.strip() * 3 + " <|end|>", "en"), ("a | b | c\n1 | 2 | 3", "en")])
    assert {r["doc_id"] for r in tq.found(d, c).collect()} == {1}


def test_tails_are_exact_ranks(spark):
    d, c = _quality(spark, [(PROSE * (1 + i % 4), "en") for i in range(20)])
    stats = tq.statistics(d, c)
    values = sorted(r["n_words"] for r in stats.collect())
    for r in tq.tails(stats).filter("stat = 'n_words'").collect():
        assert r["low"] == pytest.approx(sum(v <= r["value"] for v in values) / 20) and r["high"] == pytest.approx(sum(v >= r["value"] for v in values) / 20)


def test_thresholds_of_documents_come_from_all_rows(spark):
    """The one row of junk with a low score is the last in the order of hashes, far behind the first 20,000."""
    rows = spark.range(20_200).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit(10).alias("chars"), F.lit(0).alias("prose_chars"), F.xxhash64("id").alias("h"))
    last = rows.agg(F.max("h")).first()[0]
    scores = rows.withColumn("outlier_score", F.when(F.col("h") == last, 1.0).otherwise(7.0))
    assert [tuple(r) for r in tq.thresholds(scores).collect()] == [("en", 1.0)]
