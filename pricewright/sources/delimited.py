"""Delimited text as grids of text cells, split-parallel, with quoted line breaks and rows of any width."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import staged
from .files import plain_path, relative

# Separators by file ending, and spellings of an empty cell.
SEPARATORS = {"csv": ",", "tsv": "\t"}
MISSING = (
    "", " ", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
SHEET = "Sheet1"

# Where a scan of a line stands: at the start of a cell, in a cell without quotes, inside quotes, behind a quote inside quotes.
_START, _PLAIN, _QUOTED, _CLOSED = range(4)


def cell_values(cells: Column) -> Column:
    """Markers of a missing cell become null."""
    return F.transform(cells, lambda c: F.when(~c.isin(*MISSING), c))


def line_ends(line: Column, separator: str) -> Column:
    """struct(outside, inside): whether a line ends inside quotes (1) if it starts outside them, or inside.

    A quote opens a cell only at its start, is doubled inside a quoted cell, and is an ordinary letter elsewhere.
    """
    between = F.split(line, '"', -1)

    def at_quote(state: Column, before: Column) -> Column:
        """The state behind a quote that follows the text ``before``."""
        new_cell = before.endswith(separator)
        return (
            F.when(state == _QUOTED, _CLOSED)
            .when(new_cell | ((before == "") & state.isin(_START, _CLOSED)), _QUOTED)
            .otherwise(_PLAIN)
        )

    both = F.struct(F.lit(_START).alias("a"), F.lit(_QUOTED).alias("b"))
    last = F.aggregate(
        F.slice(between, F.lit(1), F.size(between) - 1), both,
        lambda s, before: F.struct(at_quote(s["a"], before).alias("a"), at_quote(s["b"], before).alias("b")),
    )
    scanned = F.struct((last["a"] == _QUOTED).cast("int").alias("outside"), (last["b"] == _QUOTED).cast("int").alias("inside"))
    return F.when(line.contains('"'), scanned).otherwise(F.struct(F.lit(0).alias("outside"), F.lit(1).alias("inside")))


def split_record(record: Column, separator: str) -> Column:
    """The cells of one record, however many; quotes around cells go, doubled quotes inside them become one."""
    sep = "\\t" if separator == "\t" else separator
    # Possessive, so that cells of any length and number are matched without backtracking.
    cell = f'("[^"]*+(?:""[^"]*+)*+"[^{sep}]*+|[^{sep}]*+){sep}'
    raw = F.regexp_extract_all(F.concat(record, F.lit(separator)), F.lit(cell), 1)
    closed = '^"([^"]*+(?:""[^"]*+)*+)"((?s:.*))$'

    def unquoted(c: Column) -> Column:
        inner = F.concat(F.replace(F.regexp_extract(c, closed, 1), F.lit('""'), F.lit('"')), F.regexp_extract(c, closed, 2))
        return F.when(c.startswith('"') & c.rlike(closed), inner).otherwise(c)

    return F.when(record.contains('"'), F.transform(raw, unquoted)).otherwise(F.split(record, sep, -1))


def _lines(spark: SparkSession, root: str, extension: str) -> DataFrame:
    """(file, block, seq, line): ``block`` is the start of the file split, ``seq`` grows inside it."""
    raw = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension}").text(root)
        .select(
            relative(plain_path(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))), root).alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
            F.col("value").alias("line"),
        )
    )
    name = F.element_at(F.split("file", "/"), -1)
    bare = F.when((F.col("block") == 0) & F.col("line").startswith("\ufeff"), F.substring("line", 2, 1 << 30)).otherwise(F.col("line"))
    return raw.filter(~name.startswith("~") & ~name.startswith(".")).withColumn("line", bare)


def join_lines(lines: DataFrame, separator: str) -> DataFrame:
    """(file, block, seq, record): the lines of files with line breaks inside quotes, put together to records.

    Every split is scanned as if it began outside quotes and as if it began inside. A line leaves, keeps or turns that state,
    so the state before a line is what the last line that fixes it left, turned by the lines since: running sums and
    last values within the split, for both beginnings at once. One row per split then settles, file by file, which beginning
    holds, and where the record open at its start began. Quotes that a file never closes open nothing: lines from there
    on are records of their own, so a stray quote costs one cell, not the file.
    """
    in_split = Window.partitionBy("file", "block").orderBy("seq")
    before = in_split.rowsBetween(Window.unboundedPreceding, -1)
    ends = lines.withColumn("e", line_ends(F.col("line"), separator))
    ends = ends.select(
        "file", "block", "seq", "line", F.col("e.outside").alias("out"), F.col("e.inside").alias("in"),
        (F.col("e.outside") > F.col("e.inside")).cast("int").alias("turns"), (F.col("e.outside") == F.col("e.inside")).alias("fixes"),
    )
    turned = ends.withColumn("turned", F.sum("turns").over(in_split) % 2)
    fixed = turned.withColumn("fixed", F.last(F.when(F.col("fixes"), F.col("out").bitwiseXOR(F.col("turned"))), ignorenulls=True).over(before))
    sofar = F.coalesce(F.lag("turned").over(in_split), F.lit(0))

    def before_line(start: int) -> Column:
        return F.coalesce("fixed", F.lit(start)).bitwiseXOR(sofar)

    both = staged(fixed.select("file", "block", "seq", "line", "out", "in", before_line(0).alias("s0"), before_line(1).alias("s1")), "lines")

    def after(s: str) -> Column:
        return F.when(F.col(s) == 0, F.col("out")).otherwise(F.col("in"))

    splits = both.groupBy("file", "block").agg(
        F.max_by(F.struct(after("s0").alias("outside"), after("s1").alias("inside")), "seq").alias("e"),
        F.max(F.when(F.col("s0") == 0, F.col("seq"))).alias("open0"), F.max(F.when(F.col("s1") == 0, F.col("seq"))).alias("open1"),
    )
    # The same composition, over the splits of a file.
    in_file = Window.partitionBy("file").orderBy("block")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    out, inside = F.col("e.outside"), F.col("e.inside")
    chained = splits.withColumn("turned", F.sum((out > inside).cast("int")).over(in_file) % 2)
    chained = chained.withColumn("fixed", F.last(F.when(out == inside, out.bitwiseXOR(F.col("turned"))), ignorenulls=True).over(earlier))
    chained = chained.withColumn("start", F.coalesce("fixed", F.lit(0)).bitwiseXOR(F.coalesce(F.lag("turned").over(in_file), F.lit(0))))
    opened = F.when(F.col("start") == 0, F.col("open0")).otherwise(F.col("open1"))
    place = F.when(opened.isNotNull(), F.struct(F.col("block").alias("block"), opened.alias("seq")))
    ending = F.when(F.col("start") == 0, out).otherwise(inside)
    whole = Window.partitionBy("file")
    chained = chained.withColumn("place", place).withColumn("ending", ending)
    chained = chained.select(
        "file", "block", "start", F.last("place", ignorenulls=True).over(earlier).alias("carried"),
        # Of a file that ends inside quotes, where its last record begins.
        F.when(F.max_by("ending", "block").over(whole) == 1, F.max("place").over(whole)).alias("never_closed"),
    )
    placed = both.join(chained, ["file", "block"])
    state = F.when(F.col("start") == 0, F.col("s0")).otherwise(F.col("s1"))
    here = F.struct("block", "seq")
    loose = F.col("never_closed").isNotNull() & (here >= F.col("never_closed"))
    starts = placed.withColumn("own", F.when((state == 0) | loose, here))
    first = F.coalesce(F.last("own", ignorenulls=True).over(in_split), F.col("carried"))
    grouped = starts.withColumn("first", first).groupBy("file", "first").agg(F.sort_array(F.collect_list(F.struct("block", "seq", "line"))).alias("parts"))
    return grouped.select("file", "first.block", "first.seq", F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("record"))


def read_records(spark: SparkSession, root: str, extension: str) -> DataFrame:
    """(file, block, seq, record) of all files with one ending below ``root``; blank lines are no records.

    A first scan finds the files in which some line ends inside quotes. All other files, in most folders all of them, are read
    line by line without a shuffle; only the lines of the files found are put together by ``join_lines``.
    """
    separator = SEPARATORS[extension]
    lines = _lines(spark, root, extension)
    broken = lines.groupBy("file").agg(F.max(line_ends(F.col("line"), separator)["outside"]).alias("open")).where("open = 1")
    broken = staged(broken.select("file"), "broken")
    records = lines.withColumnRenamed("line", "record")
    if not broken.isEmpty():
        records = records.join(broken, "file", "left_anti").unionByName(join_lines(lines.join(broken, "file", "left_semi"), separator))
    return records.where(F.col("record") != "")


def read_cells(spark: SparkSession, root: str, extension: str) -> DataFrame:
    """Cells of all files with one ending below ``root``.

    ``block`` is the start of the file split and ``seq`` grows with the rows inside it; together they order a file's
    rows without any shuffle. They hold for one scan: whoever looks at the cells more than once stages them first.
    Rows may have any number of cells, and cells may hold line breaks inside quotes (read as line feeds).
    """
    placed = read_records(spark, root, extension).select(
        "file",
        F.lit(SHEET).alias("sheet"),
        F.lit(0).alias("sheet_index"),
        "block",
        "seq",
        cell_values(split_record(F.col("record"), SEPARATORS[extension])).alias("cells"),
    )
    # Cells behind a row's last value carry nothing.
    trimmed = placed.withColumn("cells", F.slice("cells", F.lit(1), _used(F.col("cells"))))
    return trimmed.withColumn("is_text", F.transform("cells", lambda c: c.isNotNull() & c.try_cast("double").isNull()))


def _used(cells: Column) -> Column:
    """Number of cells up to the last one with a value."""
    return F.coalesce(F.array_max(F.transform(cells, lambda c, i: F.when(c.isNotNull(), i + 1))), F.lit(0))
