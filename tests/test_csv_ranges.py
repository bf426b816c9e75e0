"""CSV files cut into byte ranges against Spark's own scan of whole files."""

from __future__ import annotations

import random

import pytest

from tabulens.sources import csv_ranges, readers
from tabulens.sources.csv_ranges import CLOSING, PLAIN, QUOTED, START, csv_records, outside, scan_csv_ranges


def byte_by_byte(data, state):
    ends = []
    for place, byte in enumerate(data):
        if state == QUOTED:
            state = CLOSING if byte == 34 else QUOTED
        elif byte == 34 and state in (CLOSING, START):
            state = QUOTED
        elif byte == 10:
            state = START
            ends.append(place + 1)
        else:
            state = START if byte == 44 else PLAIN
    return ends, state


def test_states_byte_by_byte():
    rng = random.Random(3)
    for _ in range(20000):
        data = bytes(rng.choice(b'"",\nab') for _ in range(rng.randrange(14)))
        for state in range(4):
            ends, last = outside(data, state, ",")
            assert (ends.tolist(), last) == byte_by_byte(data, state), (data, state)


def written(path, rows, end="\n", sep=","):
    def quoted(text):
        return '"' + text.replace('"', '""') + '"' if any(c in text for c in '"\r\n' + sep) else text

    lines = [sep.join(["id", "text", "size"])] + [sep.join([str(i), quoted(t), str(n)]) for i, t, n in rows]
    path.write_bytes((end.join(lines) + end).encode())


def made(rng, count):
    pieces = ["a", 'say "so"', "\n", "\r\n", ",", "\t", '"', "é中", "plain words", '\n"\n', "1,2", " x "]
    return [(i, "w" + "".join(rng.choice(pieces) for _ in range(rng.randrange(6))), i % 7 / 2) for i in range(count)]


@pytest.mark.parametrize(("range_bytes", "block"), [(7, 1024), (64, 3), (1000, 2), (1 << 25, 1024)])
def test_ranges_equal_the_whole_scan(spark, tmp_path, monkeypatch, range_bytes, block):
    monkeypatch.setattr(csv_ranges, "BLOCK", block)
    rng = random.Random(range_bytes)
    folder = tmp_path / "files with space"
    folder.mkdir()
    written(folder / "a.csv", made(rng, 150))
    written(folder / "b.csv", [(1000, "long\n" * 400, 1.5)] + made(rng, 20))
    (folder / "c.csv").write_text("id,text,size\n")
    (folder / "d.csv").write_text("")
    (folder / "e.csv").write_text('id,text,size\n7,"no\nlast break",2.5')
    schema = "id int, text string, size double"
    whole = readers.scan_csv(spark, str(folder), schema)
    cut = scan_csv_ranges(spark, str(folder), schema, range_bytes=range_bytes)
    assert cut.schema == whole.schema
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))


@pytest.mark.parametrize(("end", "sep"), [("\r\n", ","), ("\n", "\t")])
def test_types_line_ends_and_separators(spark, tmp_path, end, sep):
    rows = [(i, t.replace("\r", ""), n) for i, t, n in made(random.Random(5), 60)]
    written(tmp_path / "a.csv", rows, end, sep)
    whole = readers.scan_csv(spark, str(tmp_path), sep=sep)
    cut = scan_csv_ranges(spark, str(tmp_path), sep=sep, range_bytes=50)
    assert cut.schema == whole.schema
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect())) == sorted(rows)


def test_one_file_is_many_tasks(spark, tmp_path):
    written(tmp_path / "a.csv", made(random.Random(9), 400))
    records = csv_records(spark, str(tmp_path / "a.csv"), range_bytes=200)
    tasks = records.selectExpr("spark_partition_id() as p").groupBy("p").count().collect()
    assert len(tasks) > 3 and sum(t["count"] for t in tasks) == 400


def test_separators_that_cannot_be(spark, tmp_path):
    for sep in ("", "||", '"', "\n", "é"):
        with pytest.raises(ValueError):
            csv_records(spark, str(tmp_path), sep)
