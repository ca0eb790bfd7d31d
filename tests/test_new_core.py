"""Names sharing rare words, as-of prices, grouping sets, merged sketches and context files."""

import json
import math
import random
from datetime import date, timedelta

import pytest
from helpers import rows
from pyspark.sql import functions as F

from pricewright.operators import asof, content, context, entities, similar_names, sketches
from pricewright.plans import filters


# names

def brute_similar(names, least):
    def normal(n):
        return "".join(c.lower() if c.isalnum() else " " for c in n).split()
    by_set = {}
    for n in set(names):
        tokens = frozenset(w[:-1] if len(w) > 3 and w.endswith("s") and w[-2] != "s" else w for w in normal(n))
        by_set.setdefault(tokens, []).append(n)
    spelled = {t: min(ns, key=lambda n: (-len(n), n)) for t, ns in by_set.items()}
    weight = {w: round(1000 * math.log(1 + len(spelled) / sum(w in t for t in spelled))) for t in spelled for w in t}
    out = []
    for a, x in spelled.items():
        for b, y in spelled.items():
            common, union = (sum(weight[w] for w in s) for s in (a & b, a | b))
            if x < y and common * 100 >= least * union:
                out.append((x, y, common, union, common * 100 // union))
    return sorted(out, key=repr)


def test_similar_names_against_brute_force(spark):
    rng = random.Random(8)
    words = ["Group"] * 6 + ["Holdings", "Holding", "Europe", "Trade"] + [f"N{i}" for i in range(25)]
    names = [" ".join(rng.sample(words, rng.randint(1, 4))) + " Group" for _ in range(150)] + ["Acme Holdings Europe", "Europe Acme Holding", "Acme Europe Trade", "!!", None]
    groups = entities.name_groups(spark.createDataFrame([(n,) for n in names], "name string"))
    for least in (40, 60, 90):
        got = similar_names.similar_names(groups, least)
        assert rows(got) == brute_similar([n for n in names if n and n != "!!"], least)
    assert similar_names.similar_names(groups.limit(0)).count() == 0


def test_a_word_that_all_names_share_is_no_key(spark):
    names = [(f"Unique{i} Word{i % 500} Group",) for i in range(3000)]
    sets = similar_names.weighted(similar_names.token_sets(entities.name_groups(spark.createDataFrame(names, "name string"))))
    keys = sets.select("weights", "total", F.posexplode("rest").alias("at", "rest")).where("rest * 100 >= total * 60")
    assert keys.where(F.col("weights")[F.col("at")]["token"] == "group").count() == 0 and keys.count() <= 6000


# as-of

def brute_as_of(events, history):
    out = []
    for e in events:
        known = [(h[1], h[2]) for h in history if None not in (e[1], e[2], h[0], h[1]) and h[0] == e[1] and h[1] <= e[2]]
        # of equal dates the largest value, nulls first
        best = max(known, key=lambda h: (h[0], h[1] is not None, h[1] or 0), default=(None, None))
        out.append((*e, *best))
    return sorted(out, key=repr)


def test_as_of_over_slices(spark, uncoalesced):
    rng, start = random.Random(9), date(2020, 1, 1)
    day = lambda: rng.choice([None] + [start + timedelta(days=i) for i in range(60)])
    key = lambda: rng.choice(["hot"] * 5 + ["a", "b", "c", None])
    events = [(i, key(), day()) for i in range(900)] + [(0, "hot", start), (0, "hot", start)]
    history = [(key(), day(), rng.choice([None, 1, 2, 3])) for _ in range(60)] + [("late", start, 7)]
    e = spark.createDataFrame(events, "id int, sku string, day date")
    h = spark.createDataFrame(history, "sku string, since date, price int")
    got = asof.as_of(e, h, ["sku"], "day", "since", ["price"])
    assert rows(got) == brute_as_of(events, history)
    assert got.columns == ["id", "sku", "day", "since", "price"]
    assert rows(asof.as_of(e, h.limit(0), ["sku"], "day", "since", ["price"])) == brute_as_of(events, [])
    assert asof.as_of(e.limit(0), h, ["sku"], "day", "since", ["price"]).count() == 0


def test_a_hot_key_is_several_tasks(spark, uncoalesced):
    e = spark.range(20_000).select(F.lit("hot").alias("sku"), F.expr("date_add(date'2020-01-01', cast(id % 300 as int))").alias("day"), "id")
    h = spark.createDataFrame([("hot", date(2020, 1, 1), 1), ("hot", date(2020, 6, 1), 2)], "sku string, since date, price int")
    got = asof.as_of(e, h, ["sku"], "day", "since", ["price"])
    per_task = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 20_000 and max(per_task) < 15_000
    assert {r.price: r["count"] for r in got.groupBy("price").count().collect()} == {1: 152 * 67 - 152 * 67 + got.where("day < '2020-06-01'").count(), 2: got.where("day >= '2020-06-01'").count()}


# grouping sets

def test_grouping_sets_tell_totals_from_nulls(spark, capsys):
    df = spark.createDataFrame([("a", None, 1), ("a", "x", 2), ("b", "x", 4), (None, None, 8)], "g string, k string, v int")
    got = rows(filters.grouped_sets(df, ["g", "k"], {"total": "v"}))
    want = [("a", None, 0, 1, 1), ("a", "x", 0, 2, 1), ("b", "x", 0, 4, 1), (None, None, 0, 8, 1), ("a", None, 1, 3, 2), ("b", None, 1, 4, 1), (None, None, 1, 8, 1),
            (None, None, 2, 9, 2), (None, "x", 2, 6, 2), (None, None, 3, 15, 4)]
    assert got == sorted(want, key=repr)
    sets = filters.grouped_sets(df, ["g", "k"], {"total": "v"}, [["k"], []])
    assert rows(sets) == sorted([(None, None, 2, 9, 2), (None, "x", 2, 6, 2), (None, None, 3, 15, 4)], key=repr)
    with pytest.raises(ValueError):
        filters.grouped_sets(df, ["g"], {"total": "v"}, [["nope"]])
    path = spark.createDataFrame([], df.schema)
    assert filters.grouped_sets(path, ["g"], {"total": "v"}, [["g"]]).count() == 0


# sketches

def test_merged_sketches_equal_one_pass(spark, tmp_path):
    cells = spark.range(60_000).select(
        F.concat(F.lit("f"), F.col("id") % 6).alias("file"), F.when(F.col("id") % 2 == 0, "key").otherwise("kind").alias("column"),
        F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).when(F.col("id") % 10 == 1, None).otherwise(F.concat(F.lit("v"), F.sqrt(F.col("id")).cast("int") % 40)).alias("value"))
    per_file = sketches.sketch_columns(cells.where("file < 'f5'"))
    per_file.write.parquet(str(tmp_path / "stored"))
    # A new file adds its own sketch; the others are not read again.
    added = spark.read.parquet(str(tmp_path / "stored")).unionByName(sketches.sketch_columns(cells.where("file = 'f5'")))
    plain = ["column", "rows", "filled", "shortest", "longest", "smallest", "largest", "n_distinct"]
    merged = sketches.profile_of(sketches.merge_sketches(added))
    whole = sketches.profile_of(sketches.sketch_columns(cells, by=()))
    assert rows(merged.select(*plain)) == rows(whole.select(*plain))
    exact = {r["column"]: r for r in sketches.exact_counts(cells).groupBy("column").agg(F.count("*").alias("n"), F.max("n").alias("most")).collect()}
    for r in merged.collect():
        assert abs(r.n_distinct - exact[r["column"]].n) <= 4 * sketches.HLL_ERROR * exact[r["column"]].n + 1
    kinds = next(r for r in merged.collect() if r["column"] == "kind")
    assert kinds.frequent[0]["count"] == exact["kind"].most
    twice = sketches.merge_sketches(sketches.merge_sketches(added, ["file"]))
    assert rows(sketches.profile_of(twice).select(*plain)) == rows(merged.select(*plain))


# context files

def test_context_files(spark, tmp_path):
    def put(client, name, text):
        (tmp_path / client).mkdir(exist_ok=True)
        (tmp_path / client / name).write_text(text)
    put("acme", "a.json", json.dumps({
        "company_name": "Acme", "industry": {"value": "Energy", "source": "team-entered"}, "size": {"staff": 7, "open": True, "note": None},
        "goals": ["grow", "sell"], "people": [{"name": "x", "role": {"title": "boss"}}, {"name": "y"}], "empty": {}, "none": [], "dotted.key": "é \"q\""}))
    put("acme", "b.json", '{"company_name": "Acme Inc", "revenue_range": 1.50}')
    put("bad", "cut.json", '{"company_name": "Cut"')
    put("bad", "list.json", "[1, 2]")
    put("bad", "blank.json", " \n")
    facts, problems = context.read_context(spark, str(tmp_path))
    got = {(r.client_id, r.field): (r.value, r.source) for r in facts.where(~F.col("seq.file").endswith("b.json")).collect()}
    told = "extracted-from-file"
    assert got == {
        ("acme", "company_name"): ("Acme", told), ("acme", "industry"): ("Energy", "team-entered"), ("acme", "size.staff"): ("7", told), ("acme", "size.open"): ("true", told),
        ("acme", "goals"): ('["grow","sell"]', told), ("acme", "people.0.name"): ("x", told), ("acme", "people.0.role.title"): ("boss", told),
        ("acme", "people.1.name"): ("y", told), ("acme", "empty"): ("{}", told), ("acme", "none"): ("[]", told), ("acme", "dotted.key"): ('é "q"', told),
    }
    assert sorted((r.file.rsplit("/", 1)[1], r.problem) for r in problems.collect()) == [(n, "no JSON object") for n in ("blank.json", "cut.json", "list.json")]
    merged = {r.field: (r.value, r.alternatives) for r in context.merge_context(facts).collect()}
    assert merged["company_name"] == ("Acme", 1) and merged["revenue_range"][0] == "1.5" and merged["industry"] == ("Energy", 0)
    deep = spark.createDataFrame([("d", '{"a": {"b": {"c": {"d": 1}}}, "x": 2}')], "client_id string, content string")
    found, lost = context.flatten_json(deep, depth=2)
    assert rows(found.select("field", "value")) == [("x", "2")] and lost.first()["problem"] == "deeper than 2 levels: a.b"
    assert context.flatten_json(deep.limit(0))[0].count() == 0


# mapping by content

def test_columns_are_known_by_what_they_hold(spark):
    def cells(source, columns, name="column"):
        return spark.createDataFrame([(source, "fact", c, v) for c, vs in columns.items() for v in vs], f"source string, target_table string, {name} string, value string")

    towns, codes = [f"Town {i}" for i in range(60)], [f"SKU-{i:04d}" for i in range(80)]
    old = cells("x", {"geography": towns[:30], "product_sku": codes, "quantity": [str(i) for i in range(50)]}, "canonical")
    more = cells("y", {"geography": towns[30:] + towns[:5]}, "canonical")
    known = content.merge(content.sketch(old.union(more), ["source", "target_table", "canonical"]), ["target_table", "canonical"])
    whole = content.sketch(old.union(more).drop("source"), ["target_table", "canonical"])
    assert rows(known) == rows(whole)
    new = cells("n", {"a": [t.upper() + " " for t in towns] * 3, "b": codes[:70], "c": [f"{i}.00" for i in range(45)], "d": ["free text", "of some kind"], "e": ["", " ", None], "f": towns[:40]})
    sketched = content.sketch(new, ["source", "target_table", "column"])
    found = {r["column"]: r.canonical for r in content.map_by_content(sketched, known).collect()}
    assert found == {"a": "geography", "b": "product_sku", "c": "quantity"}  # of two columns of towns the fuller one
    mapped = spark.createDataFrame([("n", "fact", "a", None), ("n", "fact", "b", None), ("n", "fact", "Qty", "quantity"), ("n", "fact", "c", None)], "source string, target_table string, column string, canonical string")
    filled = {r["column"]: r.canonical for r in content.fill_mapping(mapped, content.map_by_content(sketched, known)).collect()}
    assert filled == {"a": "geography", "b": "product_sku", "Qty": "quantity", "c": None}
    assert content.map_by_content(sketched.limit(0), known).count() == 0 and content.map_by_content(sketched, known.limit(0)).count() == 0
