"""Finding spreadsheet files without reading them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged

# File endings that count as spreadsheets.
EXTENSIONS = ("xlsx", "xlsb", "csv", "tsv", "xls")

FILES_SCHEMA = "path string, file string, name string, extension string, bytes long"


def plain_path(path: Column) -> Column:
    """Local paths in one spelling, whether a source writes file:/ or file:///."""
    return F.regexp_replace(path, "^file:/+", "/")


def relative(path: Column, root: str) -> Column:
    base = root.rstrip("/")
    base = base[len("file:"):] if base.startswith("file:") else base
    base = "/" + base.lstrip("/") if "://" not in base else base
    tail = F.when(path.startswith(base + "/"), path.substr(F.lit(len(base) + 2), F.length(path))).otherwise(path)
    return tail


def discover(spark: SparkSession, root: str, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """Spreadsheets anywhere below ``root``: (path, file relative to root, name, extension, bytes).

    Only the listing is used: the content column is never asked for.
    """
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
        .load(root)
        .select(plain_path(F.col("path")).alias("path"), F.col("length").alias("bytes"))
    )
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(
        "path",
        relative(F.col("path"), root).alias("file"),
        name.alias("name"),
        F.lower(F.element_at(F.split(name, r"\."), -1)).alias("extension"),
        "bytes",
    ).filter(~F.col("name").startswith("~") & ~F.col("name").startswith("."))


def priority(files: DataFrame, wanted: Sequence[str], by: str = "name") -> DataFrame:
    """Files named in a priority list.

    ``by='name'``: exact name anywhere; when a name is found nowhere, names containing it in any case.
    ``by='path'``: path relative to the root; when absent, its last part anywhere.
    ``by='folder'``: as a path, and an entry that is a folder stands for the files below it.
    """
    if not wanted:
        return files
    entries = F.array(*[F.lit(w.rstrip("/")) for w in dict.fromkeys(wanted)])
    file, name = F.col("file"), F.col("name")

    def level(w: Column) -> Column:
        """1 for a proper match, 2 for the fallback."""
        last = F.element_at(F.split(w, "/"), -1)
        if by == "name":
            return F.when(name == w, 1).when(F.lower(name).contains(F.lower(w)), 2)
        if by == "path":
            return F.when(file == w, 1).when(name == last, 2)
        if by == "folder":
            return F.when((file == w) | file.startswith(F.concat(w, F.lit("/"))), 1)
        raise ValueError(f"unknown rule {by!r}")

    hits = F.filter(F.transform(entries, lambda w: F.struct(w.alias("entry"), level(w).alias("level"))), lambda h: h["level"].isNotNull())
    matched = files.withColumn("h", F.explode(hits))
    best = matched.groupBy("h.entry").agg(F.min("h.level").alias("level"))
    kept = matched.select(*files.columns, "h.entry", "h.level").join(best, ["entry", "level"], "left_semi")
    return kept.select(*files.columns).distinct()


#: Letters of the pieces by which partial names are looked up.
GRAM = 3


def grams(text: Column, size: Column | int = GRAM) -> Column:
    """The distinct pieces of ``size`` letters of a text, none if it is shorter."""
    size = F.lit(size) if isinstance(size, int) else size
    places = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, size)))).otherwise(F.array().cast("array<string>"))


def first_containing(parts: DataFrame, names: DataFrame, part: str, name: str, gram: int = GRAM) -> DataFrame:
    """(part, name): the first name, in order, that contains each part; parts found nowhere are left out.

    Names are indexed by their pieces of ``gram`` letters, as many as they have letters. A part looks up the rarest of its
    own pieces, and what stands there is compared in full. Parts shorter than that are looked up whole, in an index of
    their own length. A part with a piece that no name has meets nothing.
    """
    asked = parts.select(F.col(part).alias("_part")).where(F.length("_part") > 0).distinct()
    asked = asked.withColumn("_size", F.least(F.length("_part"), F.lit(gram)))
    asked = staged(asked.withColumn("_grams", grams(F.col("_part"), F.col("_size"))), "parts")
    sizes = [r[0] for r in asked.select("_size").distinct().collect()]  # at most ``gram`` numbers
    wanted = asked.select(F.explode("_grams").alias("_gram")).distinct()
    every = F.flatten(F.array(*[grams(F.col(name), n) for n in sizes])) if sizes else F.array().cast("array<string>")
    index = staged(names.select(F.col(name).alias("_name"), F.explode(every).alias("_gram")).join(wanted, "_gram", "left_semi"), "grams")
    held = index.groupBy("_gram").agg(F.count(F.lit(1)).alias("_names"))
    probes = asked.select("_part", F.explode("_grams").alias("_gram")).join(held, "_gram", "left")
    # Without a name that has the piece the whole part can't be in any.
    rarest = probes.groupBy("_part").agg(F.min(F.struct(F.coalesce("_names", F.lit(0)).alias("n"), "_gram")).alias("r")).where("r.n > 0")
    candidates = rarest.select("_part", F.col("r._gram").alias("_gram")).join(index, "_gram")
    return candidates.where(F.col("_name").contains(F.col("_part"))).groupBy(F.col("_part").alias(part)).agg(F.min("_name").alias(name))


def resolve(decisions: DataFrame, sheets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions with the real file and sheet names, decisions that match nothing).

    A decision names a file by name, relative path or a part of either, and a sheet in any case; delimited files have
    one sheet whatever the decision calls it. ``sheets`` holds (file, sheet). Partial names mean the first file that
    contains them, found through an index of short pieces.
    """
    asked = staged(decisions.select(F.col("file").alias("_file"), F.col("sheet").alias("_sheet")).distinct(), "asked")
    files = staged(sheets.select("file").distinct().withColumn("name", F.element_at(F.split("file", "/"), -1)), "files")
    names = asked.select("_file").distinct()
    exact = names.join(files, names["_file"] == files["name"]).select("_file", "file").unionByName(
        names.join(files, names["_file"] == files["file"]).select("_file", "file")
    )
    rest = names.join(exact, "_file", "left_anti")
    partial = first_containing(rest, files, "_file", "file")
    chosen = exact.unionByName(partial).groupBy("_file").agg(F.min("file").alias("_real_file"))

    with_file = asked.join(chosen, "_file")
    delimited = F.lower("_real_file").rlike(r"\.(csv|tsv)$")
    real = sheets.select(F.col("file").alias("_real_file"), F.col("sheet").alias("_real_sheet"), F.lower("sheet").alias("_low"))
    by_name = with_file.filter(~delimited).withColumn("_low", F.lower("_sheet")).join(real, ["_real_file", "_low"])
    rank = F.struct((F.col("_sheet") != F.col("_real_sheet")).alias("inexact"), F.col("_real_sheet"))
    by_name = by_name.groupBy("_file", "_sheet", "_real_file").agg(F.min_by("_real_sheet", rank).alias("_real_sheet"))
    only = with_file.filter(delimited).join(real.select("_real_file", "_real_sheet"), "_real_file").select("_file", "_sheet", "_real_file", "_real_sheet")
    links = by_name.unionByName(only)
    plain = decisions.withColumnRenamed("file", "_file").withColumnRenamed("sheet", "_sheet")
    matched = plain.join(links, ["_file", "_sheet"]).select(
        F.col("_real_file").alias("file"), F.col("_real_sheet").alias("sheet"), *[c for c in decisions.columns if c not in ("file", "sheet")]
    )
    misses = plain.join(links, ["_file", "_sheet"], "left_anti").select(
        F.col("_file").alias("file"), F.col("_sheet").alias("sheet"), *[c for c in decisions.columns if c not in ("file", "sheet")]
    )
    return matched, misses
