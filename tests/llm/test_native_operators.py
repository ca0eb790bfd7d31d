"""Line dedup, mixing, chat formatting, decontamination and surrogates against brute force, with awkward rows."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from pricewright.llm import chat_format, decontaminate, line_dedup, mixing, pii_surrogates

SPACES = " \t\n\x0b\x0c\r"


def brute_lines(rows):
    def key(line):
        return line.strip(SPACES).translate({c: c + 32 for c in range(65, 91)})
    owners = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            owners[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and min(owners[key(x)]) < i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup(spark, corpus):
    rng = random.Random(1)
    pool = [f"line number {i} of the pool" for i in range(12)] + ["short", "", "  \t", "ÄÖÜ äöü ÄÖÜ äöü"]
    rows = [(i, "\n".join(rng.choice([str.upper, str, lambda s: f" {s}\t"])(rng.choice(pool)) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\n\n"), (5, rows[5][1]), (63, "\n".join(["a line that is repeated"] * 3000))]
    docs = corpus([(i, t, None, None) for i, t in rows])
    for batches, fanout in ((1, 2), (5, 2)):
        got = sorted((tuple(r) for r in line_dedup.drop_repeated_lines(docs, batches=batches, fanout=fanout).collect()), key=repr)
        assert got == brute_lines(rows)
    with_null = corpus([(None, "the same long line\nown line of this one", None, None), (3, "The Same Long Line", None, None)])
    assert {(r["doc_id"], r["n_dropped"]) for r in line_dedup.drop_repeated_lines(with_null).collect()} == {(None, 1), (3, 0)}
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0


def test_runs_are_compacted(spark):
    runs = line_dedup.Runs(fanout=2)
    for i in range(4):
        runs.add(spark.createDataFrame([(i, i, i)], "h1 long, h2 long, owner long"))
    assert {level: len(r) for level, r in runs.levels.items()} == {0: 0, 1: 0, 2: 1}
    assert sorted(r["owner"] for r in runs.all()[0].collect()) == [0, 1, 2, 3]


def test_mixing(spark, corpus):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 30))), None, "big" if i % 3 else rng.choice(["b", "é", "a", None])) for i in range(400)]
    rows += [(400, None, None, "a"), (401, "", None, "empty"), (7, rows[7][1], None, rows[7][3])]
    docs = corpus(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    total = sum(sizes.values())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    level = _brute_targets(sizes, weight, total)
    for s in sizes:
        assert abs(target[s] - level[s]) < 1e-6 * max(1, level[s])
        assert abs(taken[s] - target[s]) <= 60
    assert sum(taken.values()) <= total
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(corpus([(1, None, None, None)])).first()["taken"] == 0


def _brute_targets(sizes, weight, total):
    capped = {s for s in sizes if sizes[s] == 0}
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in sizes if s not in capped]
        level = {s: 3 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in sizes}
        over = {s for s in free if level[s] > 3 * sizes[s]}
        if not over:
            return level
        capped |= over


def test_mixing_stage_repeats_documents(spark, corpus):
    docs = corpus([(i, "one two three", "en", "a" if i < 4 else "b") for i in range(40)])
    out = mixing.stage(spark, docs, "")
    assert out.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert all(counts[i] == 3 for i in range(4))


def test_chat_format(spark):
    rng = random.Random(3)
    base = [("user", f"q{i}") if i % 2 == 0 else ("assistant", f"a{i}") for i in range(8)]
    talks = {1: base[:2], 2: base[:5], 3: base, 4: base, 5: base[:5] + [("user", "other")], 6: base[:2] + [("assistant", None)], 7: [(None, "")], 8: [(None, None)]}
    for c in range(10, 60):
        talks[c] = base[: rng.randint(1, 8)]
    rows = [(c, i * 2, r, t, "x") for c, turns in talks.items() for i, (r, t) in enumerate(turns)]
    rows += [(3, 0, *base[0], "x"), (None, 0, "user", "no conversation <|im_end|>", "x"), (9, None, "user", "no turn", "x"), (9, 0, "user", "turn", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, c string").repartition(9)
    got = chat_format.maximal_turns(df)
    assert {r["conv_id"] for r in got.select("conv_id").collect()} == {3, 5, 6, 7, 8, 9, None}
    chats = {r["conv_id"]: r["chat"] for r in chat_format.render(got).collect()}
    assert chats[3] == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in base)
    assert chats[9].index("turn<") < chats[9].index("no turn") and "< |im_end|>" in chats[None]
    assert chat_format.maximal_turns(df.limit(0)).count() == 0


def _words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def test_decontamination(spark, corpus):
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(300)]
    items = [" ".join(rng.choices(vocabulary, k=rng.randint(15, 50))) for _ in range(30)] + ["tiny item", "One", "", None]
    texts = []
    for i in range(120):
        words = rng.choices([f"other{j}" for j in range(300)], k=rng.randint(0, 200))
        if i % 4 == 0:
            leak = items[i // 4].split() if items[i // 4] else []
            if i % 8 == 0 and len(leak) > 30:
                leak[0] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() + "," if i % 3 else w for w in leak]
        texts.append(" ".join(words))
    texts += [None, "", "tiny item", "tiny", texts[0]]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, n int")
    expected = set()
    for d, text in enumerate(texts):
        words = _words(text)
        for b, item in enumerate(items):
            iw = _words(item)
            if not iw:
                continue
            k = min(5, len(iw))
            want = [tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)]
            best = 0.0
            for s in range(max(1, len(words) - len(iw) + 1)):
                w = words[s : s + len(iw)]
                kk = min(5, len(w))
                have = [tuple(w[i : i + kk]) for i in range(len(w) - kk + 1)] if w else []
                inter = sum(min(have.count(x), want.count(x)) for x in set(have))
                best = max(best, inter / (len(have) + len(want) - inter))
            if best >= 0.8:
                expected.add((d, b))
    docs = corpus([(i, t, None, None) for i, t in enumerate(texts)])
    for limit in ("10m", "-1"):  # the items broadcast by Spark, and not
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert got == expected
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_index_finds_all_within_the_radius():
    rng = random.Random(5)
    for _ in range(200):
        fp = rng.getrandbits(64)
        other = fp
        for b in rng.sample(range(64), decontaminate.RADIUS):
            other ^= 1 << b
        assert any(
            bin((fp >> low ^ other >> low) & ((1 << width) - 1)).count("1") <= decontaminate.RADIUS // len(decontaminate.BLOCKS)
            for low, width in decontaminate.BLOCKS)


def test_surrogates(spark, corpus):
    rng = random.Random(6)
    mails = [f"user{i}.name@mail{i % 3}.org" for i in range(40)]
    cards = ["4111111111111111", "5500 0000 0000 0004"]
    fixed = ["Call +1 (389) 555-5010 or 389-555-5010, host 10.1.2.3.", "SSN 123-45-6789; IBAN DE89 3704 0044 0532 0130 00.",
             "Mrs Anna Smith met Mr. Smith and Frau Müller; г-жа is no title, госпожа Анна Иванова is.", None, "", "nothing here at all 12 34"]
    texts = fixed + [f"{rng.choice(mails)} wrote to {rng.choice(mails).upper()} about {rng.choice(cards)}" for _ in range(60)] + ["Anna " * 20_000 + mails[0]]
    docs = corpus([(i, t, None, None) for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in pii_surrogates.with_surrogates(docs, "k").collect()}
    assert got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == texts[5] and got[5]["n_entities"] == 0
    assert re.fullmatch(r"Call \+1 \(\d{3}\) \d{3}-\d{4} or \d{3}-\d{3}-\d{4}, host (\d+\.){3}\d+\.", got[0]["text"]) and got[0]["n_entities"] == 3
    assert re.fullmatch(r"SSN 9\d\d-\d\d-\d{4}; IBAN DE\d\d( \d{4}){4} \d\d\.", got[1]["text"])
    m = re.fullmatch(r"Mrs ([A-Z]\w+a) ([A-Z]\w+) met Mr\. ([A-Z]\w+) and Frau ([A-Z]\w+); г-жа is no title, госпожа ([А-Я][а-я]+) ([А-Я][а-я]+) is\.", got[2]["text"])
    assert m and m[2] == m[3] != m[4]
    seen = {}
    for i, t in enumerate(texts[6:], 6):
        old, new = re.findall(r"\S+@\S+", t or ""), re.findall(r"\S+@\S+", got[i]["text"] or "")
        assert len(old) == len(new)
        for a, b in zip(old, new):
            assert a.lower() not in b.lower() and b.endswith("example.com")
            assert seen.setdefault(a.lower(), b.lower()) == b.lower()
        for card in re.findall(r"\d(?: ?\d){15}", got[i]["text"]):
            digits = [int(c) for c in card if c.isdigit()]
            assert sum(sum(divmod(2 * d, 10)) if k % 2 == 0 else d for k, d in enumerate(digits)) % 10 == 0
    assert len(set(seen.values())) == len(seen)
    other = {r["doc_id"]: r["text"] for r in pii_surrogates.with_surrogates(docs, "another").collect()}
    assert other[0] != got[0]["text"]
    assert pii_surrogates.with_surrogates(docs.limit(0), "k").count() == 0


def test_phone_shapes(spark, corpus):
    same = ["+14155550123", "+1 4155550123", "+1 (415) 555-0123", "+1.415.555.0123"]
    phones = same + ["+44 20 7946 0958", "+33 6 12 34 56 78", "+33612345678", "+49 (0)30 123456", "+7 495 123-45-67", "06 12 34 56 78", "06.12.34.56.78", "0612345678",
                     "030 12345678", "030/12345678", "(030) 12345678", "(06) 12 34 56 78", "0171-1234567", "020 7946 0958", "555-1234", "389-555-5010", "030.12.34.567"]
    others = ["am 01.02.2024 08:30 Uhr", "01-02-2024 12", "in 2024-01-02", "(2010) 12 3456", "0.123456789", "1234567890", "2010-2024", "pages 555-12", "0123456789abcdef", "+12 apples"]
    texts = [f"call {p}, now" for p in phones] + others
    got = {r["doc_id"]: r for r in pii_surrogates.with_surrogates(corpus(texts), "k").collect()}
    digits = []
    for i, p in enumerate(phones):
        new = re.fullmatch("call (.*), now", got[i]["text"])[1]
        assert got[i]["n_entities"] == 1 and new != p and re.sub("[0-9]", "9", new) == re.sub("[0-9]", "9", p), (p, new)
        assert new[:2] == p[:2] if p[0] == "0" and p[1] == "0" else new[0] == p[0] or p[0] not in "0+(", (p, new)
        digits.append(re.sub("[^0-9]", "", new))
    assert len(set(digits[:4])) == 1 and digits[5] == digits[6] and digits[9] == digits[10] == digits[11]
    assert [digits[i][:2] for i in (4, 5, 7)] == ["44", "33", "49"] and digits[0][0] == "1" and digits[8][0] == "7"
    assert [got[i]["text"] for i in range(len(phones), len(texts))] == others


def test_collisions_are_tried_anew(spark, monkeypatch, corpus):
    real = pii_surrogates.surrogate

    def crowded(kind, canon, tries, key):
        few = F.concat(F.lit("1"), F.lpad((F.crc32(canon) % 3).cast("string"), 3, "0"))
        return F.when(tries == 0, few).otherwise(real(kind, canon, tries, key))

    monkeypatch.setattr(pii_surrogates, "surrogate", crowded)
    docs = corpus([(i, f"{100 + i}-45-{6000 + i}", None, None) for i in range(30)])
    texts = [r["text"] for r in pii_surrogates.with_surrogates(docs, "k").collect()]
    assert len(set(texts)) == 30
