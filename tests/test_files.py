"""Files named in part."""

import random

from helpers import rows

from pricewright.sources import files


def test_partial_names_against_brute_force(spark):
    rng = random.Random(4)
    names = ["".join(rng.choice("ab/._") for _ in range(rng.randint(1, 30))) for _ in range(150)] + ["x" * 200, "dir/sales äö.csv"]
    parts = ["".join(rng.choice("ab/._") for _ in range(rng.randint(1, 8))) for _ in range(120)] + ["xxxx", "x", "zz", "zzzzz", "äö", "es ä", ""]
    got = files.first_containing(
        spark.createDataFrame([(p,) for p in parts] + [(None,)], "part string"), spark.createDataFrame([(n,) for n in names] + [(None,)], "name string"), "part", "name")
    want = {p: min(n for n in names if p in n) for p in parts if p and any(p in n for n in names)}
    assert dict(rows(got)) == want
    assert files.first_containing(spark.createDataFrame([], "part string"), spark.createDataFrame([("a",)], "name string"), "part", "name").count() == 0


def test_an_index_has_no_more_entries_than_letters(spark):
    name = "".join(chr(97 + i % 26) + str(i) for i in range(100))[:200]
    index = spark.createDataFrame([(name,)], "name string").select(files.grams(files.F.col("name")).alias("g")).first()["g"]
    assert len(index) <= len(name) == 200 and len(index) == len(set(index))
