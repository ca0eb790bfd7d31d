"""Cases that caps, unstable orders and steps used to spoil."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pricewright.llm import fertility, line_dedup, mixing, pii_surrogates, secret_scan, token_store
from pricewright.llm.common import shared_folder


def test_mixture_agrees_over_layouts(spark, corpus, uncoalesced):
    rng = random.Random(3)
    rows = [(None if i % 3 == 0 else i // 4 if i % 3 == 1 else i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 30))), None, rng.choice("ab")) for i in range(300)]
    rows += rows[:5]
    docs = corpus(rows)
    columns = ["doc_id", "source", "size", "taken", "place"]
    first, second = (Counter(map(tuple, mixing.mix(d).select(*columns).collect())) for d in (docs.repartition(2), docs.orderBy(F.rand(5)).repartition(7)))
    assert first == second
    mixed = [Counter(map(tuple, mixing.stage(spark, d, "").select("doc_id", "text", "source").collect())) for d in (docs.repartition(2), docs.orderBy(F.rand(6)).repartition(5))]
    assert mixed[0] == mixed[1] and len(mixed[0]) > 200
    taken = {(r["doc_id"], r["source"], r["place"]): r["copies"] for r in mixing.mix(docs).collect()}
    null_rows = sum(n for (i, _, _), n in mixed[0].items() if i is None)
    assert null_rows >= sum(c for (i, _, _), c in taken.items() if i is None) > 0


def test_slices_grow_with_the_documents(spark, corpus, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 10)
    docs = corpus([(i, "w " * (i % 7), None, "a" if i % 3 else "b") for i in range(600)])
    small = sorted(map(tuple, mixing.mix(docs).select("doc_id", "taken").collect()))
    monkeypatch.setattr(mixing, "SLICE_ROWS", 4096)
    assert small == sorted(map(tuple, mixing.mix(docs).select("doc_id", "taken").collect()))


def test_long_names_and_deep_addresses_go_whole(spark, corpus):
    name, address = "A" + "b" * 60, "x@" + ".".join(f"l{i}" for i in range(12)) + ".com"
    texts = [f"Mr {name} came.", f"Write to {address}.", f"Mme {name}, Dr Marie Curie and Господин Иванов"]
    got = {r["doc_id"]: r for r in pii_surrogates.with_surrogates(corpus([(i, t, None, None) for i, t in enumerate(texts)]), "k").collect()}
    assert [got[i]["n_entities"] for i in range(3)] == [1, 1, 3]
    for word in (name, "b" * 15, "l3.l4", "Curie", "Иванов"):
        assert all(word not in got[i]["text"] for i in range(3))
    assert got[0]["text"].startswith("Mr ") and got[2]["text"].startswith("Mme ") and " Dr " in got[2]["text"]


def _mod97(iban):
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def test_check_digits_tell_cards_and_accounts(spark, corpus):
    texts = ["4111 1111 1111 1111 and GB82 WEST 1234 5698 7654 32", "4111 1111 1111 1112 and AB12CDEF3456 or DE00 3704 0044 0532 0130 00", "tracking 1234567890123456"]
    docs = corpus([*[(i, t, None, None) for i, t in enumerate(texts)], (0, texts[0], None, None), (None, texts[0], None, None)])
    got = pii_surrogates.with_surrogates(docs, "k").collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == 5 and len({r["text"] for r in got if r["doc_id"] in (0, None)}) == 1
    assert by_id[0]["n_entities"] == 2 and by_id[1]["n_entities"] == by_id[2]["n_entities"] == 0
    assert by_id[1]["text"] == texts[1] and by_id[2]["text"] == texts[2]
    card, iban = re.fullmatch(r"(4\d{3}(?: \d{4}){3}) and (GB\d\d [A-Z]{4}(?: \d{4}){3} \d\d)", by_id[0]["text"]).groups()
    digits = [int(c) for c in card.replace(" ", "")][::-1]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert _mod97(iban) == 1 and iban != "GB82 WEST 1234 5698 7654 32"


def test_long_secrets_are_taught_as_secrets(spark, corpus):
    secret = "password=" + "aB3" * 700
    found = corpus([("x " * 900 + secret + " tail")]).select("text").mapInArrow(secret_scan._examples, "line string, starts array<int>, ends array<int>, signs double").collect()
    assert len(found) == 1 and len(found[0]["line"]) == secret_scan.TRAIN_CHARS
    start, end = found[0]["starts"][0], found[0]["ends"][0]
    assert end == secret_scan.TRAIN_CHARS and set(found[0]["line"][start:end]) <= set("aB3") and found[0]["line"][:start].endswith("password=")


def test_training_lines_are_bounded(spark, corpus, monkeypatch):
    taken = []
    monkeypatch.setattr(secret_scan, "train", lambda lines, spans, signs: taken.append(len(lines)))
    rng = random.Random(2)
    docs = corpus(["\n".join(f"{rng.getrandbits(80):020x} file" for _ in range(2000))] * 1 + ["token: abcdefghijklmnop"])
    secret_scan.fit(docs, train_lines=200)
    secret_scan.fit(docs)
    assert 100 < taken[0] < 400 and taken[1] >= 2000


def test_spans_seen_in_part_are_kept():
    base = [("hex", 4, 24), ("assign", 30, 60), ("hex", 35, 50)]
    assert secret_scan.uncovered([(0, 40), (4, 24), (5, 20), (30, 60), (35, 61), (70, 90)], base) == [(0, 40), (35, 61), (70, 90)]
    assert secret_scan.uncovered([], base) == [] and secret_scan.uncovered([(1, 2)], []) == [(1, 2)]


def test_one_more_document_moves_bands_by_little(spark, corpus):
    rng = random.Random(4)
    words = "the of people went house over river small green hill and to with from water".split()

    def text(mean):
        return " ".join(rng.choices(words, k=60)) + " " + " ".join("".join(rng.choices("abcdefghij", k=mean)) for _ in range(rng.randint(0, 3)))

    docs = [(i, text(8), None, None) for i in range(25)]
    bands = {}
    for n in (19, 20, 21):
        measured = corpus(docs[:n]).select("doc_id", "text").mapInArrow(fertility.partial(fertility._run, fertility.RANKS, fertility.PIECES, fertility.BANDS), fertility._MEASURED)
        parts, _ = fertility.spreads(measured)
        r = parts.where("part = 'Latin'").first()
        weight = r["c_n"] / (r["c_n"] + fertility.EVEN_DOCS)
        assert r["c_n"] == n
        bands[n] = 1.7 + (r["c_low"] - 1.7) * weight, 8.0 + (r["c_high"] - 8.0) * weight
    for a, b in ((19, 20), (20, 21)):
        assert all(abs(x - y) < 0.25 for x, y in zip(bands[a], bands[b]))
    repeated = corpus([docs[0], docs[0], (None, docs[0][1], None, None)])
    got = fertility.judge(repeated).collect()
    assert len(got) == 3 and len({(r["kept"], r["chars_per_token"]) for r in got}) == 1


def test_a_hot_key_runs_on_over_shards(spark, corpus, uncoalesced):
    rng = random.Random(9)
    rows = [(i if i % 3 else 7, " ".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) + f" {i}", None, None) for i in range(600)]
    rows += [(None, f"no id {i}", None, None) for i in range(300)]
    folder = shared_folder(spark, "hot-store")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    token_store.write_store(corpus(rows), folder)
    spark.conf.set("spark.sql.shuffle.partitions", old)
    keys = corpus(rows).select(F.coalesce("doc_id", F.lit(token_store.NULL_KEY)).alias("key")).distinct()
    found = token_store.read_store(keys.union(spark.range(10_000, 10_500).select("id")), folder)
    got = found.collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [token_store.NULL_KEY if r["doc_id"] is None else r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order)
    plain = Tokenizer.from_file(token_store.VOCABULARY)
    want = Counter(zlib.crc32(np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for _, t, _, _ in rows)
    assert Counter(r["ids_crc32"] for r in got) == want
    keys_of = {}
    for n in range(12):
        try:
            keys_of[n] = token_store.Shard(folder, n).keys
        except FileNotFoundError:
            pass
    assert sum(7 in k for k in keys_of.values()) > 1 and sum(token_store.NULL_KEY in k for k in keys_of.values()) > 1


def test_runs_are_read_in_place(spark, uncoalesced):
    runs = line_dedup.Runs(fanout=3)
    frame = lambda low: spark.range(low, low + 500).select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(1), "id").alias("h2"), F.col("id").alias("owner"))
    runs.add(frame(0))
    runs.add(frame(1000))
    batch = frame(400).groupBy(*line_dedup.KEY).agg(F.min("owner").alias("own"))
    for i, run in enumerate(runs.all()):
        batch = batch.join(run.withColumnRenamed("owner", f"owner{i}").hint("merge"), line_dedup.KEY, "left")
    found = batch.where("owner0 IS NOT NULL")
    assert found.count() == 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    # One exchange, of the batch; the files of the runs lie below none.
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1 and plan.count("Bucketed: true") >= 2
