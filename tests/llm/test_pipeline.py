"""The pipeline against brute force, and every query over a small table."""

import hashlib
import random

import corpus_pipeline
import pytest
from odd_rows import prose
from test_operators import brute_components, brute_leaks, brute_lines

from placeloom.llm.queries import load

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    good = [prose(rng, rng.randint(40, 120)) for _ in range(60)]
    bad = ["##! " + " ".join("BUY!!" for _ in range(rng.randint(5, 90))) for _ in range(20)]
    items = [(k, prose(rng, 30)) for k in range(3)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    rows += [(200 + i, good[i]) for i in range(5)] + [(210 + i, good[10 + i] + " one more word") for i in range(5)]
    rows += [(220 + i, good[20 + i] + "\n" + items[i][1] + "\n" + good[25 + i]) for i in range(3)]
    rows += [(230 + i, good[30 + i] + "\n" + good[40] + "\n" + good[41]) for i in range(4)] + [(300, None), (301, "")]
    path = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    marks = [(i, int(i < 60), 0) for i in range(80)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_stages(spark, tables):
    path, rows, items = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    docs = corpus_pipeline.STAGES[0][1](spark, docs, path)
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    assert docs.columns == corpus_pipeline.COLUMNS
    assert {i for i, _ in kept} >= {i for i, _ in rows if i < 60 or 200 <= i < 300}  # clean documents stay
    assert len({i for i, _ in kept} & set(range(60, 80))) <= 1  # rejected ones go
    want = [(i, t) for i, t, n in brute_lines(kept) if not n or t.strip()]
    components = {i: c for i, _, c in brute_components(want, 5, 80)}
    want = [(i, t) for i, t in want if components[i] == i]
    gone = {i for i, _ in brute_leaks(want, items)}
    assert gone == {220, 221, 222}
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, path)
        assert docs.columns == corpus_pipeline.COLUMNS
    left = {(r.doc_id, r.text, r.n_chars) for r in docs.collect()}
    assert left == {(i, t, None if t is None else len(t)) for i, t in want if i not in gone}


def test_multi_line_copies_go(spark):
    rng = random.Random(13)
    base = [(i, "\n".join(prose(rng, 12).replace("\n", "") for _ in range(2 + i % 20))) for i in range(40)]
    rows = base + [(100 + i, t) for i, t in base] + [(200 + i, t) for i, t in base]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.line_stage(spark, docs, "")
    assert sorted((r.doc_id, r.text) for r in left.collect()) == base  # no stump stays


def test_run(spark, tables):
    tokenizers = pytest.importorskip("tokenizers")
    P = pytest.importorskip("public_tokenizers")
    path, rows, _ = tables
    library = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = dict(rows)
    out = corpus_pipeline.run(spark, path).collect()
    whole = [r for r in out if r.doc_id < 60 and r.doc_id not in (40, 41)]
    assert len(whole) > 50 and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in out)
    assert all(r.token_ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids for r in whole[:5])


def test_every_operator_has_a_query():
    queries, sql = load()
    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in queries} and set(sql) <= set(queries)


def test_queries_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    queries, sql = load()
    con = duckdb.connect()
    for name in ("documents", "conversations", "pages", "embeddings"):
        con.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    for name, text in sql.items():
        got = queries[name](spark, SMALL).toPandas()
        want = con.execute(text).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        digest = lambda df: sorted(hashlib.md5(repr(r).encode()).hexdigest() for r in df[columns].astype(str).values.tolist())
        assert digest(got) == digest(want), name
