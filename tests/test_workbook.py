"""Workbooks with damaged sheets, other epochs and several sheets."""

import zipfile

from helpers import rows, write_xlsx
from pyspark.sql import functions as F

from pricewright.plans import bronze
from pricewright.sources import files, workbook

GRID = [["Customer", "When", "Value"], ["Acme", ("date", 45292), 10], ["Zen", ("date", 45293.5), 2.5]]


def rewritten(path, changes):
    """The same book with some parts changed by a function of their text."""
    with zipfile.ZipFile(path) as z:
        parts = {n: z.read(n).decode() for n in z.namelist()}
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, changes.get(name, lambda t: t)(text))


def test_a_broken_sheet_stands_beside_good_ones(spark, tmp_path):
    write_xlsx(tmp_path / "mixed.xlsx", {"Good": GRID, "Cut": GRID, "Index": GRID, "Also": GRID, "Gone": GRID})
    rewritten(tmp_path / "mixed.xlsx", {
        "xl/worksheets/sheet2.xml": lambda t: t[: len(t) * 2 // 3],
        "xl/worksheets/sheet3.xml": lambda t: t.replace('t="s"><v>0<', 't="s"><v>999<', 1),
        "xl/_rels/workbook.xml.rels": lambda t: t.replace("sheet5.xml", "sheet9.xml"),
    })
    (tmp_path / "torn.xlsx").write_bytes((tmp_path / "mixed.xlsx").read_bytes()[:300])
    (tmp_path / "no.xlsx").write_text("not a workbook")
    (tmp_path / "~lock.xlsx").write_text("skipped")
    sheets = workbook.read_sheets(spark, str(tmp_path))
    assert sheets.rdd.getNumPartitions() == 7  # five sheets and two damaged files
    cells = workbook.read_cells(spark, str(tmp_path))
    assert {(r.file, r.sheet): r["count"] for r in cells.groupBy("file", "sheet").count().collect()} == {("mixed.xlsx", "Good"): 3, ("mixed.xlsx", "Also"): 3}
    assert [r[:2] for r in rows(workbook.problems(spark, str(tmp_path)).select("file", "sheet", "error"))] == [
        ("mixed.xlsx", "Cut"), ("mixed.xlsx", "Gone"), ("mixed.xlsx", "Index"), ("no.xlsx", None), ("torn.xlsx", None)]
    assert rows(workbook.unreadable(files.discover(spark, str(tmp_path)), cells).select("file")) == [("no.xlsx",), ("torn.xlsx",)]
    # The whole ingest goes on, too.
    assert bronze.read_folder(spark, str(tmp_path)).select("sheet").distinct().count() == 2
    assert bronze.problems(spark, str(tmp_path)).count() == 5


def test_sheets_are_read_by_tasks_of_their_own(spark, tmp_path):
    write_xlsx(tmp_path / "b.xlsx", {f"S{i}": [["n"]] + [[i * 10_000 + j] for j in range(5000)] for i in range(3)})
    sheets = workbook.read_sheets(spark, str(tmp_path))
    per_task = sheets.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("sheet").alias("sheets"), F.count("*").alias("rows"))
    assert [(r.sheets, r.rows) for r in per_task.collect()] == [(1, 5001)] * 3
    got = sheets.where("sheet = 'S2'").orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(5001)) and got[5000].cells == ["24999"] and got[0].is_text == [True]


def test_dates_from_1904_and_beyond_the_calendar(spark, tmp_path):
    for name, mark in (("late", "1"), ("early", "0"), ("word", "true")):
        write_xlsx(tmp_path / f"{name}.xlsx", {"S": [["When"], [("date", 1000)], [("date", 10**9)]]})
        rewritten(tmp_path / f"{name}.xlsx", {"xl/workbook.xml": lambda t: t.replace("<sheets>", f'<workbookPr date1904="{mark}"/><sheets>')})  # noqa: B023
    got = {(r.file, r.seq): r.cells for r in workbook.read_cells(spark, str(tmp_path)).collect()}
    assert got["late.xlsx", 1] == got["word.xlsx", 1] == ["1906-09-27 00:00:00"] and got["early.xlsx", 1] == ["1902-09-26 00:00:00"]
    assert got["late.xlsx", 2] == ["1000000000"]


def test_folders_and_single_files(spark, tmp_path):
    (tmp_path / "deep + er").mkdir()
    (tmp_path / "_hidden").mkdir()
    write_xlsx(tmp_path / "deep + er" / "a b.xlsx", {"S": GRID})
    write_xlsx(tmp_path / "_hidden" / "a.xlsx", {"S": GRID})
    assert {r.file for r in workbook.read_cells(spark, str(tmp_path)).collect()} == {"deep + er/a b.xlsx"}
    assert {r.file for r in workbook.read_cells(spark, f"file://{tmp_path}").collect()} == {"deep + er/a b.xlsx"}
    assert {r.file for r in workbook.read_cells(spark, str(tmp_path / "deep + er" / "a b.xlsx")).collect()} == {"a b.xlsx"}
