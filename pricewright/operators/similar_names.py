"""Company names that share their rare words, in any order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged

#: Words in common, by weight, in percent of the words of both.
MIN_SCORE = 60


def name_tokens(key: Column) -> Column:
    """The distinct words of a normal name, without a plural s."""
    words = F.filter(F.split(key, " "), lambda w: w != "")
    single = F.transform(words, lambda w: F.when(w.rlike("^.{2,}[^s]s$"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))
    return F.array_sort(F.array_distinct(single))


def token_sets(groups: DataFrame) -> DataFrame:
    """(tokens, canonical, names): groups whose keys have the same words are one, under the longest spelling."""
    keys = groups.groupBy("key").agg(F.min("canonical").alias("canonical")).withColumn("tokens", name_tokens(F.col("key")))
    best = F.min(F.struct(-F.length("canonical"), "canonical"))["canonical"]
    return keys.where(F.size("tokens") > 0).groupBy("tokens").agg(best.alias("canonical"), F.count(F.lit(1)).alias("keys"))


def weighted(sets: DataFrame) -> DataFrame:
    """Add ``weights``: (weight, token) by falling weight, ``total`` and ``rest``, the weight from each word on.

    A word's weight is its inverse frequency, round(1000 ln(1 + sets / sets with it)), so a word that all names have counts
    least. Weights are whole numbers: sums and comparisons are exact.
    """
    count = sets.agg(F.count(F.lit(1)).alias("_sets"))
    held = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("_with"))
    # One row; the weight of every word is found once.
    told = held.join(count).select("token", F.round(1000 * F.ln(1 + F.col("_sets") / F.col("_with"))).cast("long").alias("weight"))
    words = sets.select("tokens", "canonical", "keys", F.explode("tokens").alias("token")).join(told, "token")
    listed = F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("order"), "token", "weight")))
    out = words.groupBy("tokens", "canonical", "keys").agg(F.transform(listed, lambda w: F.struct(w["weight"].alias("weight"), w["token"].alias("token"))).alias("weights"))
    total = lambda weights: F.aggregate(weights, F.lit(0).cast("long"), lambda s, w: s + w["weight"])
    rest = F.transform(F.sequence(F.lit(1), F.size("weights")), lambda i: total(F.slice("weights", i, F.size("weights"))))
    return out.withColumn("total", total(F.col("weights"))).withColumn("rest", rest)


def similar_names(groups: DataFrame, min_score: int = MIN_SCORE) -> DataFrame:
    """(canonical, other, common, union, score): pairs of names whose words in common weigh ``min_score`` percent of all their words.

    ``groups`` is the result of ``entities.name_groups``; ``score`` is the share in percent, rounded down. The name with the
    smaller spelling comes first. Names are listed by their rarest words first, and only as many of these as leave less than
    the asked share behind are keys of the join: two names that meet at none of them can't be similar. A word that most
    names have is the last of each and so a key of hardly any. A pair is compared at its first common word only.
    """
    sets = staged(weighted(staged(token_sets(groups), "name-sets")), "token-sets")
    keys = sets.select("canonical", "weights", "total", F.posexplode("rest").alias("at", "rest")).where(F.col("rest") * 100 >= F.col("total") * min_score)
    keys = keys.withColumn("token", F.col("weights")[F.col("at")]["token"])
    left = keys.withColumnsRenamed({c: f"l_{c}" for c in keys.columns if c != "token"})
    right = keys.withColumnsRenamed({c: f"r_{c}" for c in keys.columns if c != "token"})
    most = F.least("l_rest", "r_rest")
    able = (F.col("l_canonical") < F.col("r_canonical")) & (most * 100 >= min_score * (F.col("l_total") + F.col("r_total") - most))
    pairs = left.join(right, "token").where(able)
    tokens = F.transform("r_weights", lambda w: w["token"])
    shared = F.filter("l_weights", lambda w: F.array_contains(tokens, w["token"]))
    met = pairs.withColumn("shared", shared).where(F.col("shared")[0]["token"] == F.col("token"))
    common = F.aggregate("shared", F.lit(0).cast("long"), lambda s, w: s + w["weight"])
    scored = met.select(F.col("l_canonical").alias("canonical"), F.col("r_canonical").alias("other"), common.alias("common"), (F.col("l_total") + F.col("r_total") - common).alias("union"))
    return scored.withColumn("score", F.floor(F.col("common") * 100 / F.col("union")).cast("long")).where(F.col("common") * 100 >= F.col("union") * min_score)
