"""Delimited text over many splits, against a sequential reader."""

import csv
import io
import random

import pytest

from pricewright.sources import delimited


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def cells_of(spark, folder, extension="csv"):
    """Rows of each file in their order; missing cells as empty text."""
    out = {}
    for r in delimited.read_cells(spark, str(folder), extension).orderBy("file", "block", "seq").collect():
        out.setdefault(r.file, []).append([c or "" for c in r.cells])
    return out


def trimmed(rows):
    out = []
    for r in rows:
        while r and r[-1] == "":
            r = r[:-1]
        out.append(r)
    return out


def random_cell(rng):
    parts = ["a", "bc", ",", '"', "\n", ",,", '""', " x ", "\t", "é", '"\n"', "\n\n", '",', ',"']
    return "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 1, 2, 3, 8])))


@pytest.mark.parametrize("extension,seed", [("csv", 1), ("csv", 2), ("tsv", 3)])
def test_quoted_files_over_splits(spark, tmp_path, small_splits, extension, seed):
    rng, sep = random.Random(seed), delimited.SEPARATORS[extension]
    want = {}
    for i in range(6):
        rows = [[random_cell(rng) for _ in range(rng.randint(1, 6))] for _ in range(rng.choice([0, 3, 40, 120]))]
        rows = [r for r in rows if r != [""]]
        out = io.StringIO()
        csv.writer(out, delimiter=sep, lineterminator=rng.choice(["\n", "\r\n"]), quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])).writerows(rows)
        text = out.getvalue() if i % 2 else out.getvalue().rstrip("\r\n")
        (tmp_path / f"f{i}.{extension}").write_text(text, newline="")
        read = list(csv.reader(io.StringIO(text, newline=""), delimiter=sep))
        if read:
            want[f"f{i}.{extension}"] = trimmed([[c.replace("\r\n", "\n") if c not in delimited.MISSING else "" for c in r] for r in read if r])
    (tmp_path / f"plain.{extension}").write_text("".join(f"{i}{sep}{i * 2}\n" for i in range(200)))
    want[f"plain.{extension}"] = [[str(i), str(i * 2)] for i in range(200)]
    got = cells_of(spark, tmp_path, extension)
    assert got == want
    lines = spark.read.text(str(tmp_path / f"plain.{extension}"))
    assert lines.rdd.getNumPartitions() > 2


def test_a_cell_with_many_separators_widens_no_other_row(spark, tmp_path):
    note = ",".join(str(i) for i in range(25_000))
    (tmp_path / "notes.csv").write_text(f'id,note\n1,"{note}"\n2,short\n' + '3,"' + 'say ""hi"" ' * 20_000 + '"\n')
    got = cells_of(spark, tmp_path)["notes.csv"]
    assert [len(r) for r in got] == [2, 2, 2, 2] and got[1][1] == note and got[3][1] == 'say "hi" ' * 20_000
    (tmp_path / "wide.csv").write_text(",".join(str(i) for i in range(30_000)) + '\n"x",y\n')
    assert [len(r) for r in cells_of(spark, tmp_path)["wide.csv"]] == [30_000, 2]


def test_a_cell_longer_than_its_splits(spark, tmp_path, small_splits):
    long = "\n".join(f"line {i}, with, separators" for i in range(100))
    (tmp_path / "long.csv").write_text(f'a,b\n1,"{long}"\n2,"x\ny"\n3,z\n')
    assert cells_of(spark, tmp_path)["long.csv"] == [["a", "b"], ["1", long], ["2", "x\ny"], ["3", "z"]]


def test_stray_and_unclosed_quotes(spark, tmp_path, small_splits):
    (tmp_path / "inch.csv").write_text('pipe 5" long,3\npipe 6",4\n"a"b,"c" d\n')
    (tmp_path / "open.csv").write_text('a,"x\ny"\n1,"never closed\n' + "".join(f"{i},{i}\n" for i in range(2, 100)))
    (tmp_path / "mark.csv").write_text('\ufeff"first",b\n\n \n1,2\n', encoding="utf-8")
    (tmp_path / "empty.csv").write_text("")
    got = cells_of(spark, tmp_path)
    assert got["inch.csv"] == [['pipe 5" long', "3"], ['pipe 6"', "4"], ["ab", "c d"]]
    assert got["open.csv"] == [["a", "x\ny"], ["1", '"never closed']] + [[str(i), str(i)] for i in range(2, 100)]
    assert got["mark.csv"] == [["first", "b"], [], ["1", "2"]] and "empty.csv" not in got


def test_files_without_broken_lines_are_not_shuffled(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text('1,"b, c"\n2,d\n')
    delimited.read_cells(spark, str(tmp_path), "csv").explain()
    assert "Exchange" not in capsys.readouterr().out
