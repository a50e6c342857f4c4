"""Conversation repair against enumeration of all edits, and against its SQL on odd rows."""

import hashlib
import itertools
import random

import duckdb
import pytest
from placeloom.llm import turn_repair
from placeloom.llm.queries import damaged_turns, load
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("_pos", T.StringType()), T.StructField("audit", T.StringType())])


def cheapest(rows):
    """All edit sequences with up to three inserts in each gap, by plain enumeration."""
    best = None
    for gaps in itertools.product(["", "u", "a", "ua", "au", "uau", "aua"], repeat=len(rows) + 1):
        for acts in itertools.product(["D", "K", "Ru", "Ra"], repeat=len(rows)):
            made, cost, audit = gaps[0], 2 * len(gaps[0]), "I" * len(gaps[0])
            for (initial, gone, cut), act, gap in zip(rows, acts, gaps[1:], strict=True):
                if act == "D":
                    cost += 3
                elif gone:
                    break
                else:
                    made += initial if act == "K" else act[1]
                    cost += cut + (0 if act == "K" else 2)
                audit += act[0] + "I" * len(gap)
                made += gap
                cost += 2 * len(gap)
            else:
                pairs = made[1:] if made[:1] == "s" else made
                if pairs == "ua" * (len(pairs) // 2) and made != "s":
                    best = min(best or (cost, audit), (cost, audit))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_weights_against_all_edits(seed):
    rng = random.Random(seed)
    for n in (0, 1, 2, 3):
        rows = [(rng.choice("suat"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]
        weight = turn_repair.fold(rows, turn_repair.ENDINGS, True)[0]
        assert turn_repair.split_weight(weight, n) == cheapest(rows)


@pytest.mark.parametrize("seed", range(4))
def test_pieces_join_to_the_whole(seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ssuuaat"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(23)]
    cuts = [0, 1, 8, 9, 23]
    cells = None
    for a, b in zip(cuts, cuts[1:], strict=False):
        piece = turn_repair.matrix(rows[a:b], a == 0, b == len(rows))
        cells = piece if cells is None else turn_repair.joined(cells, piece)
    assert cells[0] == turn_repair.matrix(rows, True, True)[0]


def turns():
    rng = random.Random(3)
    rows = []
    for conv in [*range(60), None, -4]:
        for turn in range(rng.randint(1, 9)):
            text = rng.choice(["one.", "two", "three!", "", " \n\x0b", None, "four? ", "fünf…", "same."])
            rows.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", "system", "user", "tool", "", None]), text))
    rows += [(7777, t, "user" if t % 3 else "assistant", rng.choice(["x.", "y", "long " * 50 + "."])) for t in range(200)]
    rows += [(8888, None, "user", "twin.")] * 5 + [(8889, 2**40, "system", "end." * 20000)]
    return [(*r, "x", "y") for r in rows]


def by_sql(rows):
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", [r[:4] for r in rows])
    return con.execute(load()[1]["op11_turn_repair"]).fetchall()


@pytest.mark.parametrize("rows_per_piece", [4, 1024])
def test_report_against_sql(spark, rows_per_piece):
    rows = turns()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = turn_repair.report(df, damaged_turns(df), rows_per_piece=rows_per_piece, fan=2).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, by_sql(rows)))


def test_repaired_rows_keep_to_the_pattern(spark):
    df = spark.createDataFrame([r for r in turns() if r[0] is not None and r[0] < 20], SCHEMA)
    ordered = turn_repair.in_order(df, "conv_id", "turn", "role", "text")
    found = turn_repair.edits(ordered)
    new: dict = {}
    for row in turn_repair.repaired_turns(ordered, found).orderBy("_c", "place").collect():
        new.setdefault(row._c, []).append(row)
    digests = dict(turn_repair.repaired_digests(ordered, found).collect())
    for row in found.collect():
        out = new.get(row._c, [])
        made = "".join(r.role[0] for r in out)
        pairs = made.removeprefix("s")
        assert pairs == "ua" * (len(pairs) // 2) and made != "s"
        assert [r.edit for r in out] == [e for e in row.audit if e != "D"]
        assert all(r.text == "" for r in out if r.edit == "I")
        assert digests[row._c] == hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in out).encode()).hexdigest()


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert turn_repair.report(none, damaged_turns(none)).count() == 0


def test_conversation_that_loses_all_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "a.", "", "")], SCHEMA)
    row = turn_repair.report(df, df.limit(0)).first()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
