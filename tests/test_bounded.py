"""Steps that must not hold or pass the whole table in one task, or do the same work for equal rows."""

import json

import pytest
from pyspark.sql import functions as F

from placeloom.operators import evaluation, gram
from placeloom.plans import sources
from placeloom.sources import files, ranges


def test_json_arrays_are_written_by_many_tasks(spark, tmp_path):
    df = spark.range(500, numPartitions=5).selectExpr("to_json(array(id)) as value")
    ranges.write_json_array(df, str(tmp_path / "many"), single=False)
    parts = [p.read_text() for p in (tmp_path / "many").glob("part-*")]
    assert len(parts) == 5 and sum(len(json.loads(p)) for p in parts) == 500
    back = ranges.read_json_array(spark, str(tmp_path / "many"), 300)
    assert sorted(r.value for r in back.collect()) == sorted(r.value for r in df.collect())


@pytest.mark.parametrize("name", ["foreign_csv", "positional_records"])
def test_queries_write_a_file_from_each_task(spark, tmp_path, monkeypatch, name):
    docs = spark.range(90).selectExpr("id as doc_id", "concat('a\"b\nc ', id) as text", "'en' as lang", "'s' as source", "cast(9 as long) as n_chars")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(sources, "scratch_path", lambda spark, label: str(tmp_path / "out"))
    monkeypatch.setattr(sources, "table", lambda spark, d, n: spark.read.parquet(f"{d}/{n}.parquet").repartition(3))
    found = getattr(sources, name)(spark, str(tmp_path))
    assert len(list((tmp_path / "out").glob("part-*"))) == 3
    assert {r.digest for r in found.collect()} == {r.d for r in docs.select(F.md5("text").alias("d")).collect()} and found.count() == 90


def test_folders_are_listed_by_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(f"dump-{i}.xml-p{i}p9.txt", "x" * i, i % 3) for i in range(40)] + [("other.txt", "x", 1), ("_a.xml-p1p2.txt", "x", 1)], "file string, content string, home int")
    ranges.write_files(rows, str(tmp_path / "f"), under="home")
    folders = [str(tmp_path / "f" / str(i)) for i in range(4)]  # one does not exist
    found = files.list_parts(spark, folders)
    want = {(f"dump-{i}.xml-p{i}p9.txt", i) for i in range(1, 40)}
    assert {tuple(r) for r in found.collect()} == want
    (tmp_path / "f" / "3").mkdir()
    assert {tuple(r) for r in files.list_parts(spark, str(tmp_path / "f" / "*")).collect()} == want


@pytest.fixture
def lines(spark):
    return spark.range(6000, numPartitions=3).selectExpr(
        "id as _id", "cast(id % 3 as string) as fold", "cast(id % 5 as double) as a", "cast(id % 4 = 0 as int) as b_1", "cast((id * 37) % 101 + id % 5 as double) as y")


def test_trees_from_merged_rows_are_the_same(lines, monkeypatch):
    rows = evaluation.assembled(lines, ["a", "b_1"])
    maker = evaluation.boosted_trees(rounds=3, depth=2)
    plain = {tuple(r.features): r.prediction for r in maker(rows).fit(rows).transform(rows).collect()}
    monkeypatch.setattr(evaluation, "GROUP_ROWS", 1000)
    merged = maker.merged(rows)
    assert merged.count() == 10 and merged.agg(F.sum("_weight")).first()[0] == 6000
    found = {tuple(r.features): r.prediction for r in evaluation.fitted(maker, rows).transform(rows).collect()}
    assert found == pytest.approx(plain)
    assert maker.merged(evaluation.assembled(lines, ["y", "_id"])).rdd.getNumPartitions() == 6
    assert maker.merged(rows.withColumn("y", F.when(F.col("_id") > 0, F.col("y")))).filter("y is null").count() == 1


def test_moments_of_summed_rows(lines):
    folds = ["0", "1"]
    plain, sums = gram.moments_by_fold(lines, folds, ["a", "b_1"], ["b_1"])
    found, found_sums = gram.moments_by_fold(lines, folds, ["a", "b_1"], ["b_1"], repeated=True)
    for fold in folds:
        assert found[fold].n == plain[fold].n
        assert found[fold].mean == pytest.approx(plain[fold].mean) and found[fold].cross == pytest.approx(plain[fold].cross)
        assert (found_sums[fold] == sums[fold]).all()
    with pytest.raises(ValueError):
        gram.moments_by_fold(lines.withColumn("y", F.when(F.col("_id") != 3, F.col("y"))), folds, ["a"], repeated=True)
