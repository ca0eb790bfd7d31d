"""From grids of untyped cells to named columns: header rows, header names, date headers, sheet samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import DATE_FORMATS, MONTHS, read_format
from ..functions.text import strip

CELLS_SCHEMA = "file string, sheet string, block long, seq long, cells array<string>, is_text array<boolean>"

# Rows searched for a header, words of sheets that hold no entity data, sheets to profile.
HEADER_ROWS = 15
NON_ENTITY_SHEETS = (
    "summary", "accrual", "volume", "growth", "top 10", "offers", "liability", "itd", "validation", "style", "cover",
)
MAX_SHEETS = 12
ALL_ENTITY_SHEETS = "ALL_DISTRIBUTOR_SHEETS"

# A bare number is read as a year between these.
FIRST_BARE_YEAR, LAST_BARE_YEAR = 1900, 2100


def header_score() -> Column:
    """Text cells of more than two characters."""
    pairs = F.arrays_zip("cells", "is_text")
    return F.size(F.filter(pairs, lambda p: p["is_text"] & (F.length(strip(p["cells"])) > 2)))


def sheet_summary(cells: DataFrame, by_score: bool | None = None) -> DataFrame:
    """One row per sheet: (file, sheet, sheet_index, rows, block, seq, header), from one pass over the cells.

    Workbook sheets take the row with the most text among the first fifteen as header, the earliest on a tie.
    Delimited files take their first row. ``by_score`` forces one rule for all.
    """
    delimited = F.lower("file").rlike(r"\.(csv|tsv)$")
    searched = F.col("block") == 0
    if by_score is None:
        scored = ~delimited
        searched = searched & (delimited | (F.col("seq") < HEADER_ROWS))
    else:
        # Rows of delimited files are numbered per task, so the start of each file is looked up first.
        scored = F.lit(by_score)
        start = cells.filter(F.col("block") == 0).groupBy("file", "sheet").agg(F.min("seq").alias("_first"))
        cells = cells.join(start, ["file", "sheet"], "left")
        searched = searched & (F.col("seq") - F.col("_first") < HEADER_ROWS)
    score = F.when(scored, header_score()).otherwise(F.lit(0))
    rank = F.when(searched, F.struct(score.alias("score"), (-F.col("seq")).alias("early")))
    index = F.min("sheet_index") if "sheet_index" in cells.columns else F.lit(0)
    # Only rows that may be headers carry their cells into the aggregation.
    candidates = cells.withColumn("_rank", rank).withColumn("_head", F.when(searched, F.struct("block", "seq", "cells")))
    return (
        candidates.groupBy("file", "sheet")
        .agg(index.alias("sheet_index"), F.count(F.lit(1)).alias("rows"), F.max_by("_head", "_rank").alias("h"))
        .select("file", "sheet", "sheet_index", "rows", "h.block", "h.seq", header_names(F.col("h.cells")).alias("header"))
    )


def header_names(cells: Column) -> Column:
    """Trimmed names; the second 'Amount' becomes 'Amount_1'; blanks become 'Unnamed: n'."""
    raw = F.transform(
        cells,
        lambda c, i: F.when(F.coalesce(strip(c), F.lit("")) == "", F.concat(F.lit("Unnamed: "), i.cast("string"))).otherwise(strip(c)),
    )
    numbered = F.transform(raw, lambda n, i: F.struct(n.alias("n"), F.size(F.filter(F.slice(raw, F.lit(1), i), lambda p: p == n)).alias("k")))
    return F.transform(numbered, lambda e: F.when(e["k"] == 0, e["n"]).otherwise(F.concat(e["n"], F.lit("_"), e["k"].cast("string"))))


def header_date(name: Column, first_year: int | None = None, last_year: int | None = None) -> Column:
    """The date a header spells, when its year is inside the window, if there is one."""
    year = read_format(strip(name), "yyyy").cast("date")
    bare = F.when(F.year(year).between(FIRST_BARE_YEAR, LAST_BARE_YEAR), year)
    day = F.coalesce(*[read_format(strip(name), f).cast("date") for f in DATE_FORMATS], bare)
    inside = F.lit(True)
    if first_year is not None:
        inside = inside & (F.year(day) >= first_year)
    if last_year is not None:
        inside = inside & (F.year(day) <= last_year)
    return F.when(inside, day)


def header_month(name: Column, year: int = 2024) -> Column:
    """The fifteenth of the month a header names, in the fallback year."""
    months = F.create_map(*[x for n, m in MONTHS.items() for x in (F.lit(n), F.lit(m))])
    number = F.try_element_at(months, F.lower(strip(name)))
    return F.when(number.isNotNull(), F.make_date(F.lit(year), number, F.lit(15)))


def date_positions(header: Column, first_year: int | None = None, last_year: int | None = None) -> Column:
    """Array of (pos, day) of the columns whose names are dates inside the window."""
    days = F.transform(header, lambda n, i: F.struct((i + 1).alias("pos"), header_date(n, first_year, last_year).alias("day")))
    return F.filter(days, lambda e: e["day"].isNotNull())


def month_positions(header: Column, year: int = 2024) -> Column:
    """Array of (pos, day) of the columns named after months; used when no name is a date."""
    days = F.transform(header, lambda n, i: F.struct((i + 1).alias("pos"), header_month(n, year).alias("day")))
    return F.filter(days, lambda e: e["day"].isNotNull())


# A sheet counts as wide from this many date columns on.
WIDE_FROM = 3


def sample_sheets(sheets: DataFrame, max_sheets: int = MAX_SHEETS, stride: bool = True) -> DataFrame:
    """Sheets (file, sheet, sheet_index from 0) to profile of each workbook.

    All when few enough; otherwise the first four, the last two and evenly spaced ones between, in that order of
    preference; with ``stride=False`` simply the first ``max_sheets``. A workbook's sheets form one small group.
    """
    per_file = Window.partitionBy("file")
    total = F.count(F.lit(1)).over(per_file)
    i = F.col("sheet_index")
    if not stride:
        return sheets.filter(i < max_sheets)
    sized = sheets.withColumn("_n", total)
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / (max_sheets - 6)))
    rank = (
        F.when((i < 4) | (i >= F.col("_n") - 2), 0)
        .when((i < F.col("_n") - 2) & (F.pmod(i - 4, step) == 0), 1)
    )
    picked = sized.withColumn("_rank", F.when(F.col("_n") <= max_sheets, 0).otherwise(rank)).filter(F.col("_rank").isNotNull())
    place = F.row_number().over(per_file.orderBy("_rank", "sheet_index"))
    return picked.withColumn("_place", place).filter((F.col("_n") <= max_sheets) | (F.col("_place") <= max_sheets)).select(*sheets.columns)


def expand_entity_sheets(decisions: DataFrame, sheets: DataFrame, limit: int | None = None) -> DataFrame:
    """Replace a decision for all entity sheets of a file by one decision per sheet that looks like entity data.

    ``limit`` keeps only the first sheets of each file; by default all of them count.
    """
    every = F.col("sheet") == ALL_ENTITY_SHEETS
    entity = sheets.filter(~F.lower("sheet").rlike("|".join(NON_ENTITY_SHEETS)))
    if limit is not None:
        place = F.row_number().over(Window.partitionBy("file").orderBy("sheet_index"))
        entity = entity.withColumn("_place", place).filter(F.col("_place") <= limit)
    expanded = (
        decisions.filter(every).drop("sheet").join(entity.select("file", "sheet"), "file").select(*decisions.columns)
    )
    return decisions.filter(~every).unionByName(expanded)
