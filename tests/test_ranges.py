"""Files cut into byte ranges: every range size must give what a plain reader of the whole file gives."""

import csv
import hashlib
import io
import json
import random

import pytest

from placeloom.sources import files, ranges


def values(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return rng.choice(['a"b', "\\", "\\\\\"", "[x, {y", "é\n ", "]},", ""])
    if kind < 3:
        return rng.choice([1, -2.5, True, None])
    if kind == 3:
        return "x" * rng.randint(0, 300)
    if kind < 6:
        return [values(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {rng.choice(['k"', "l\\", "m"]): values(rng, depth + 1) for _ in range(2)}


@pytest.mark.parametrize("size", [7, 64, 1000, 1 << 25])
def test_json_array_by_ranges(spark, tmp_path, size):
    rng = random.Random(size)
    wanted = [[i, values(rng)] for i in range(60 if size > 10 else 12)]
    (tmp_path / "a.json").write_text(json.dumps(wanted, ensure_ascii=False, indent=rng.choice([None, 1])))
    (tmp_path / "b.json").write_text(" [ ] ")
    (tmp_path / "c.json").write_text("")
    got = [json.loads(r.value) for r in ranges.read_json_array(spark, str(tmp_path), size).collect()]
    assert sorted(got, key=lambda v: v[0]) == wanted


def test_json_array_round_trip(spark, tmp_path):
    df = spark.range(500, numPartitions=5).selectExpr("to_json(struct(id, repeat('a\\\\\"', cast(id % 9 as int)) as t)) as value")
    ranges.write_json_array(df, str(tmp_path / "one"))
    whole = "".join(p.read_text() for p in (tmp_path / "one").glob("part-*"))
    assert len(json.loads(whole)) == 500
    back = ranges.read_json_array(spark, str(tmp_path / "one"), 1000)
    assert back.rdd.getNumPartitions() > 5
    assert sorted(r.value for r in back.collect()) == sorted(r.value for r in df.collect())


CELLS = ["plain", 'quote " inside', "line\nbreak", "a,b", "", '"', "\r\n", 'end"', "é" * 30, " lead", 'x\n"y"\n,z']


@pytest.mark.parametrize("size", [5, 40, 300, 1 << 25])
def test_csv_by_ranges(spark, tmp_path, size):
    rng = random.Random(size)
    rows = [[str(i), rng.choice(CELLS), rng.choice(CELLS)] for i in range(80 if size > 10 else 15)]
    out = io.StringIO(newline="")
    csv.writer(out).writerows([["id", "a", "b"], *rows])
    # quotes that do not open a field, and text behind a closing quote
    out.write('900,5" pipe,x\r\n901,"a"b"c,"d"\r\n902,last,"no line end"')
    (tmp_path / "f.csv").write_bytes(out.getvalue().encode())
    got = [r.value for r in ranges.read_csv_records(spark, str(tmp_path / "f.csv"), range_bytes=size).collect()]
    want = list(csv.reader(io.StringIO(out.getvalue(), newline="")))
    parsed = sorted((next(csv.reader(io.StringIO(v, newline=""))) for v in got))
    assert parsed == sorted(want)


def test_foreign_csv_is_read_by_many_tasks(spark, tmp_path):
    rows = [(i, f"t\n{i}" if i % 3 else 'say "x", y') for i in range(400)]
    with open(tmp_path / "f.csv", "w", newline="") as f:
        csv.writer(f).writerows([("id", "t"), *rows])
    df = files.read_csv(spark, str(tmp_path / "f.csv"), "id long, t string", range_bytes=500)
    assert df.rdd.getNumPartitions() > 8
    assert sorted(map(tuple, df.collect())) == rows


def test_digests_of_files(spark, tmp_path):
    data = {f"p-{i}.xml-p1p{i}": random.Random(i).randbytes(i * 1000 + 1) for i in range(6)}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    listed = ranges.files_in(spark, str(tmp_path), "*.xml-p*")
    got = {r.path.rsplit("/", 1)[1]: r.digest for r in ranges.file_digests(listed, chunk=700).collect()}
    assert got == {n: hashlib.md5(c).hexdigest() for n, c in data.items()}
