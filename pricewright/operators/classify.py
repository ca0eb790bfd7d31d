"""Which canonical table a source table belongs to, and which canonical column each header means."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import ALIASES, BENEFITS_ALIASES, BRONZE_BENEFITS, FALLBACK_RULES, TABLES, bronze_columns
from ..functions.text import normal_header, strip


def _has(text: Column, word: str, whole_words: bool) -> Column:
    if not whole_words:
        return text.contains(word)
    # Plural forms count as the word itself.
    return text.rlike(rf"(^|[^a-z0-9]){word.replace('-', '[-]')}(s|es)?([^a-z0-9]|$)")


def classify_name(name: Column, whole_words: bool = True, routes: Mapping[str, str] | None = None) -> Column:
    """Canonical table of a source name, or null.

    Catalog order, then the fallback rules. ``whole_words=False`` also accepts a keyword inside a longer word.
    ``routes`` (phrase -> table) come first.
    """
    text = F.lower(name)
    if whole_words:
        text = F.regexp_replace(text, "_", " ")
    out = F.when(name.isNull(), F.lit(None).cast("string"))
    for phrase, table in (routes or {}).items():
        out = out.when(_has(text, phrase, whole_words), table)
    for table in TABLES.values():
        for word in table.keywords:
            out = out.when(_has(text, word, whole_words), table.name)
    for table, groups in FALLBACK_RULES:
        for words in groups:
            hit = _has(text, words[0], whole_words)
            for w in words[1:]:
                hit = hit & _has(text, w, whole_words)
            out = out.when(hit, table)
    return out


def classify(names: DataFrame, name: str = "name", whole_words: bool = True, routes: Mapping[str, str] | None = None) -> DataFrame:
    return names.withColumn("target_table", classify_name(F.col(name), whole_words, routes))


def route(target: Column, default: str = "transaction_fact") -> Column:
    """First target of a decision such as 'customer_dim + contract'; blanks inside become underscores."""
    first = F.regexp_extract(target, r"^([^,+/]*)", 1)
    return F.coalesce(F.regexp_replace(strip(first), " ", "_"), F.lit(default))


def header_rules(aliases: Mapping[str, Sequence[str]] = ALIASES, columns: Mapping[str, Sequence[str]] | None = None) -> list[tuple[str, str, str, int]]:
    """(table, spelling, canonical column, rank): the exact name ranks 0, aliases follow in their order."""
    if columns is None:
        columns = {t.name: ("client_id", *t.columns) for t in TABLES.values()}
    rules = []
    for table, names in columns.items():
        rules += [(table, n, n, 0) for n in names]
        for rank, (canonical, spellings) in enumerate(aliases.items(), start=1):
            if canonical in names:
                rules += [(table, s, canonical, rank) for s in spellings]
    return rules


def benefits_rules() -> list[tuple[str, str, str, int]]:
    """Header rules with the benefits-management spellings, also for the tables only that domain has; its own come first."""
    columns = {**{t.name: ("client_id", *t.columns) for t in TABLES.values()}, **{t: bronze_columns(t, benefits=True) for t in BRONZE_BENEFITS}}
    spellings = {c: tuple(dict.fromkeys((*BENEFITS_ALIASES.get(c, ()), *ALIASES.get(c, ())))) for c in (*BENEFITS_ALIASES, *ALIASES)}
    return header_rules(spellings, columns)


def map_columns(columns: DataFrame, rules: Sequence[tuple[str, str, str, int]] | None = None) -> DataFrame:
    """Canonical column per (source, target_table, column); unmapped headers get null.

    The rule table is a constant of a few hundred rows; best rank wins.
    """
    spark = columns.sparkSession
    table = spark.createDataFrame(list(rules or header_rules()), "target_table string, _spelling string, canonical string, _rank int")
    best = table.groupBy("target_table", "_spelling").agg(F.min_by("canonical", "_rank").alias("canonical"))
    return (
        columns.withColumn("_spelling", normal_header("column"))
        .join(F.broadcast(best), ["target_table", "_spelling"], "left")
        .select(*columns.columns, "canonical")
    )


def apply_decisions(mapped: DataFrame, decisions: DataFrame, columns: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Fill headers the rules left open from outside decisions (source, target_table, column, canonical).

    Decisions for headers already mapped, or naming a column the table does not have, are ignored; of several for one
    header the first by alphabet counts.
    """
    spark = mapped.sparkSession
    allowed = columns or {t.name: t.columns for t in TABLES.values()}
    catalog = spark.createDataFrame([(t, c) for t, cs in allowed.items() for c in cs], "target_table string, _decided string")
    valid = (
        decisions.select("source", "target_table", "column", F.col("canonical").alias("_decided"))
        .join(F.broadcast(catalog), ["target_table", "_decided"], "left_semi")
        .groupBy("source", "target_table", "column").agg(F.min("_decided").alias("_decided"))
    )
    return (
        mapped.join(valid, ["source", "target_table", "column"], "left")
        .withColumn("canonical", F.coalesce("canonical", "_decided"))
        .select(*mapped.columns)
    )
