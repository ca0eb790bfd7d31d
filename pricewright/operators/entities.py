"""Groups of spellings of one company name, found by rule.

Spellings that are equal after removing case, punctuation and legal form are one company. Names that differ by one inserted,
deleted or replaced letter are candidates with a score; they are merged only above a stated score, or by decision, and
only straight into the name that stays: chains of such pairs do not add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import staged

# Legal forms dropped from the end of a name.
LEGAL_FORMS = (
    "inc", "incorporated", "corp", "corporation", "co", "company", "llc", "llp", "lp", "ltd", "limited", "plc",
    "gmbh", "ag", "sa", "bv", "pty",
)


def normal_name(name: Column) -> Column:
    """Lower case, letters and digits only, single blanks, no legal form at the end."""
    words = strip(F.regexp_replace(F.regexp_replace(F.lower(name), r"[.'’]", ""), r"[^\p{L}\p{N}]+", " "))
    bare = F.regexp_replace(words, rf"( ({'|'.join(LEGAL_FORMS)}))+$", "")
    return F.when(bare == "", words).otherwise(bare)


def near_edges(keys: DataFrame, min_letters: int = 1) -> DataFrame:
    """Edges (src, dst) joining keys at edit distance one, without comparing pairs.

    Each key is written once as it is and once per position with that letter removed. Keys sharing position and rest
    differ in that letter only, so linking each to the smallest of them links them all. A key equal to another one's
    rest differs by one missing letter; it links to every such one. Digits must agree, hence only letters are removed
    and replaced, and digits never meet letters because the digit string is part of the match.
    """
    digits = F.regexp_replace("key", r"\P{N}", "")
    letters = F.length(F.regexp_replace("key", r"\P{L}", ""))
    long = keys.select("key", digits.alias("digits"), letters.alias("letters")).filter(F.col("letters") >= min_letters)
    cut = long.select("key", "digits", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("pos")).select(
        "key", "digits", "pos",
        F.concat(F.expr("substring(key, 1, pos - 1)"), F.expr("substring(key, pos + 1)")).alias("rest"),
        F.expr("substring(key, pos, 1)").alias("gone"),
    ).filter(~F.col("gone").rlike(r"\p{N}"))
    replaced_groups = cut.groupBy("digits", "pos", "rest").agg(F.min("key").alias("dst"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    replaced = cut.join(replaced_groups, ["digits", "pos", "rest"]).filter(F.col("key") != F.col("dst")).select(F.col("key").alias("src"), "dst")
    whole = long.select(F.col("key").alias("dst"), F.col("key").alias("rest"), "digits")
    missing = cut.select(F.col("key").alias("src"), "digits", "rest").distinct().join(whole, ["digits", "rest"]).select("src", "dst")
    return replaced.unionByName(missing).distinct()


def name_groups(names: DataFrame, name: str = "name") -> DataFrame:
    """(name, key, canonical): names of equal normal form, under the longest spelling, ties by alphabet. One aggregate.

    Spellings are made distinct as they are written first, so that the text work is spread however few files there are; the
    test for blanks, which Spark moves to the scan, needs no more than a look at the first letter.
    """
    written = names.select(F.col(name).cast("string").alias("name")).filter(F.col("name").rlike(r"\S")).distinct()
    keyed = written.select(strip("name").alias("name")).distinct().withColumn("key", normal_name(F.col("name")))
    best = keyed.groupBy("key").agg(F.min(F.struct(-F.length("name"), F.col("name"))).alias("b")).select("key", F.col("b.name").alias("canonical"))
    return keyed.join(best, "key").select("name", "key", "canonical")


def near_names(groups: DataFrame) -> DataFrame:
    """(key, canonical, near_key, near_canonical, score) of groups whose keys are one letter apart, for review.

    ``score`` is 1 - edit distance / longer length of the normal forms, so a letter weighs more in a short name. ``near_key``
    is the name that would stay: the one with the longer spelling, ties by alphabet. The names are found once and staged, as
    five passes read them.
    """
    kept = staged(groups.select("key", "canonical").distinct(), "name-keys")
    edges = near_edges(kept.select("key"))
    pairs = edges.join(kept.withColumnsRenamed({"key": "src", "canonical": "a"}), "src").join(kept.withColumnsRenamed({"key": "dst", "canonical": "b"}), "dst")
    stays = F.struct(-F.length("b"), F.col("b")) < F.struct(-F.length("a"), F.col("a"))
    longer = F.greatest(F.length("src"), F.length("dst"))
    return pairs.select(
        F.when(stays, F.col("src")).otherwise(F.col("dst")).alias("key"), F.when(stays, F.col("a")).otherwise(F.col("b")).alias("canonical"),
        F.when(stays, F.col("dst")).otherwise(F.col("src")).alias("near_key"), F.when(stays, F.col("b")).otherwise(F.col("a")).alias("near_canonical"),
        (F.lit(1.0) - F.lit(1.0) / longer).alias("score"),
    ).distinct()


def merge_map(groups: DataFrame, decisions: DataFrame | None = None, min_score: float | None = None) -> DataFrame:
    """(name, canonical) of names to be replaced.

    Equal normal forms merge by rule. With ``min_score``, a group also goes to its best near name of at least that score,
    if that one itself stays. ``decisions`` (name, canonical) override both, also to keep a name as it is; of several for one
    name the first by alphabet counts.
    """
    if min_score is not None:
        groups = staged(groups, "name-groups")
    found = groups.select("name", "canonical")
    if min_score is not None:
        near = near_names(groups).filter(F.col("score") >= min_score)
        best = near.groupBy("key").agg(F.max_by(F.struct("near_key", "near_canonical"), F.struct("score", -F.length("near_canonical"), "near_canonical")).alias("to"))
        moved = best.select("key", "to.*").join(best.select(F.col("key").alias("near_key")), "near_key", "left_anti")
        found = groups.join(moved, "key", "left").select("name", F.coalesce("near_canonical", "canonical").alias("canonical"))
    if decisions is not None:
        told = decisions.groupBy("name").agg(F.min("canonical").alias("canonical"))
        found = found.join(told, "name", "left_anti").unionByName(told)
    return found.filter(F.col("name") != F.col("canonical"))
