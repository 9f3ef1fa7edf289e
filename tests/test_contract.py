import duckdb
import pytest

import __spark_entry__ as driver
from citeloom.plans import catalogue


def test_every_query_has_one_name_and_known_sql():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert catalogue.FLAGSHIP in driver.queries()


def test_entry_runs(spark, smallest):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["citation_report", "p2_found", "marker_spans", "heading_classes", "resolve_titles", "edit_apply", "export_bibtex", "activity_sessions"])
def test_sql_twins_agree(spark, smallest, name):
    con = duckdb.connect()
    for t in ("ref_entries", "works", "markers", "csl_names", "text_lines", "sections", "raw_entries", "text_spans", "documents", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{smallest}/{t}.parquet')")
    expected = con.execute(driver.oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    show = lambda v: "" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    df = driver.queries()[name](spark, smallest)
    assert sorted(df.columns) == sorted(columns)
    got = sorted("|".join(show(r[c]) for c in sorted(columns)) for r in df.collect())
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    assert got == sorted("|".join(show(r[i]) for i in order) for r in expected.fetchall())


def test_nothing_in_the_core_needs_the_llm_package():
    import pathlib
    import re

    root = pathlib.Path(driver.__file__).parent / "citeloom"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"citeloom\.llm|from \.+llm", path.read_text()), path
