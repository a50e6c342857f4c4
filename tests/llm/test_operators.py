"""Operators against brute force on a small table with all the odd rows."""

import collections
import hashlib
import json
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from placeloom.llm import bpe, count_tree, line_chunks, lm_bloom, quality, recipes, spaced_seeds, suffix_repeats, tool_calls, warc_fixity


def collect(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def test_exact_duplicates(docs, texts):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t in texts:
        groups[norm(t)].append(i)
    want = []
    for i, t in texts:
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = min(ids) if ids else None
        want.append((i, keep, len(groups[norm(t)]), i == keep, sha(norm(t).encode())))
    assert collect(recipes.exact_duplicates(docs)) == sorted(want, key=repr)


def test_chunks_join_to_the_text(spark, texts):
    rows = spark.createDataFrame([(t or "",) for _, t in texts], "t string")
    joined = rows.select("t", F.array_join(recipes.chunks(F.col("t")), "").alias("j"), F.expr("0 = 1").alias("x")).collect()
    assert all(r.t == r.j for r in joined)


def brute_lines(texts):
    seen, out = {}, []
    order = sorted({(i is None, i or 0, t or "") for i, t in texts})
    first = {}
    for none, i, t in order:
        for k, (a, b, n) in enumerate(line_chunks.cut(t)):
            if n >= 2:
                first.setdefault(t[a:b].removesuffix("\n"), []).append((none, i, k))
    for i, t in texts:
        left, removed = [], 0
        for k, (a, b, n) in enumerate(line_chunks.cut(t or "")):
            if n >= 2 and min(first[t[a:b].removesuffix("\n")]) != (i is None, i or 0, k):
                removed += n
            else:
                left.append(t[a:b])
        out.append((i, t if t is None else "".join(left), removed))
    return sorted(out, key=repr)


def test_line_chunks(docs, texts):
    got = line_chunks.without_repeats(docs)
    assert got.columns == [*docs.columns, "lines_removed"]
    want = brute_lines(texts)
    assert collect(got.select("doc_id", "text", "lines_removed")) == want
    assert any(n for _, _, n in want)


def brute_passages(rows):
    """Lines in two adjacent ones that stand before, by the lines themselves."""
    lines = lambda t: t.removesuffix("\n").split("\n") if t else []
    first = {}
    for none, i, t in sorted({(i is None, i or 0, t or "") for i, t in rows}):
        for k, pair in enumerate(zip(lines(t), lines(t)[1:])):
            first[pair] = min(first.get(pair, (True, math.inf, 0)), (none, i, k))
    out = []
    for i, t in rows:
        own, gone = lines(t), set()
        for k, pair in enumerate(zip(own, own[1:])):
            if first[pair] != (i is None, i or 0, k):
                gone |= {k, k + 1}
        ends = [*["\n"] * (len(own) - 1), "\n" if (t or "").endswith("\n") else ""]
        out.append((i, t if t is None else "".join(x + e for k, (x, e) in enumerate(zip(own, ends)) if k not in gone), len(gone)))
    return sorted(out, key=repr)


def test_repeated_passages(spark, docs, texts):
    got = line_chunks.without_repeated_passages(docs)
    assert got.columns == [*docs.columns, "lines_removed"]
    assert collect(got.select("doc_id", "text", "lines_removed")) == brute_passages(texts)
    # planted passages of 2 to 9 lines in other surroundings, at the start, inside and at the end
    rng = random.Random(6)
    line = lambda: f"line {rng.random()}"
    rows, want = [], {}
    for n in range(2, 10):
        passage = [line() for _ in range(n)]
        rows.append((n, "\n".join([line(), *passage, line()])))
        for k, (a, b) in enumerate([(0, 0), (0, 2), (1, 0), (3, 4)]):
            before, after = [line() for _ in range(a)], [line() for _ in range(b)]
            rows.append((100 * n + k, "\n".join([*before, *passage, *after])))
            want[100 * n + k] = ("\n".join([*before, *after]).rstrip("\n"), n)
    rows += [(5000, "same\nsame\nsame\nend\n"), (5001, "\n\n"), (5002, "one\n")]
    found = line_chunks.without_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert collect(found.select("doc_id", "text", "lines_removed")) == brute_passages(rows)
    for r in found.collect():
        if r.doc_id in want:
            assert (r.text.rstrip("\n"), r.lines_removed) == want[r.doc_id]


def test_no_chunk_of_one_line():
    rng = random.Random(7)
    for n in range(2, 200):
        text = "\n".join(f"line {rng.random()}" for _ in range(n)) + "\n" * (n % 2)
        chunks = line_chunks.cut(text)
        assert "".join(text[a:b] for a, b, _ in chunks) == text and all(text[a:b].rstrip("\n").count("\n") >= 1 for a, b, _ in chunks)


def test_line_boundaries_resist_shifts():
    rng = random.Random(1)
    lines = [f"line {rng.random()}" for _ in range(60)]
    chunk = lambda text: {text[a:b].removesuffix("\n") for a, b, _ in line_chunks.cut(text)}
    one, two = chunk("\n".join(lines)), chunk("\n".join(["new", *lines]))
    assert len(one & two) >= len(one) - 2


def test_suffix_repeats(docs, texts):
    length = suffix_repeats.LENGTH
    raws = [(i, (t or "").encode()) for i, t in texts]
    count = collections.Counter(r[p:p + length] for _, r in raws for p in range(len(r) - length + 1))
    want = []
    for i, r in raws:
        gone = [False] * len(r)
        for p in range(len(r) - length + 1):
            if count[r[p:p + length]] > 1:
                gone[p:p + length] = [True] * length
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((i, len(r), sha(bytes(b for b, g in zip(r, gone) if not g)), runs))
    got = suffix_repeats.without_repeats(docs).select("doc_id", "n_bytes", F.sha2("kept", 256), F.size("spans"))
    assert collect(got) == sorted(want, key=repr)


@pytest.mark.parametrize("length,letters", [(24, b"ab"), (24, b"abcdefg "), (200, b"abc")])
def test_two_stage_sort(length, letters):
    rng = random.Random(length)
    base = [bytes(rng.choice(letters) for _ in range(3 * length)) for _ in range(3)]
    parts = [rng.choice(base)[rng.randint(0, length):] + rng.choice(base)[:rng.randint(0, 2 * length)] for _ in range(12)]
    count = collections.Counter(p[i:i + length] for p in parts for i in range(len(p) - length + 1))
    for part, got in zip(parts, suffix_repeats.repeated_starts(parts, length)):
        twice = [i for i in range(len(part) - length + 1) if count[part[i:i + length]] > 1]
        assert got == ((twice[0], twice[-1]) if twice else None)


def test_suffix_repeats_in_blocks(docs, monkeypatch):
    want = collect(suffix_repeats.without_repeats(docs))
    monkeypatch.setattr(suffix_repeats, "BLOCK", 2)
    assert collect(suffix_repeats.without_repeats(docs)) == want


def brute_components(texts, n, share):
    sets, parent = [], {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            one, two = sets[a][1], sets[b][1]
            if one and two and len(one & two) * 100 >= share * len(one | two):
                parent[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)].append(i)
    return sorted(((i, len(s), min(least[find(k)], default=None)) for k, (i, s) in enumerate(sets)), key=repr)


@pytest.mark.parametrize("n,share", [(3, 90), (5, 80)])
def test_jaccard_join(docs, texts, n, share):
    assert collect(count_tree.near_duplicates(docs, n=n, threshold=share / 100)) == brute_components(texts, n, share)


def test_jaccard_join_chain(spark):
    # variants of one text, each linked with its neighbours only; the star of a key does not settle them
    rng = random.Random(2)
    words = [f"w{rng.random()}" for _ in range(120)]
    rows = []
    for i in range(40):
        words = list(words)
        words[rng.randrange(120)] = f"v{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collect(count_tree.near_duplicates(df)) == brute_components(rows, 3, 90)


def test_tree_finds_all_pairs():
    import numpy as np

    rng = np.random.default_rng(0)
    points = rng.poisson(3, (200, 16)).astype(np.int32)
    points[100:] = np.maximum(points[:100] + rng.integers(-1, 2, (100, 16)) * (rng.random((100, 16)) < 0.05), 0)
    sizes, parts = points.sum(1), np.arange(200)
    a, b = count_tree.tree_pairs(points, sizes, parts, 0.9)
    got = {frozenset(p) for p in zip(a.tolist(), b.tolist())}
    want = {frozenset((i, j)) for i in range(200) for j in range(i) if np.minimum(points[i], points[j]).sum() >= math.ceil(
        (sizes[i] + sizes[j]) * 0.9 / 1.9 - 1e-9)}
    assert got == want and len(want) >= 50


def test_keep_one(docs, texts):
    gone = {i for i, _, c in brute_components(texts, 5, 80) if i is not None and c != i}
    got = count_tree.keep_one(docs)
    assert got.columns == docs.columns
    assert collect(got.select("doc_id", "text")) == sorted(((i, t) for i, t in texts if i not in gone), key=repr)


def brute_leaks(texts, items):
    """(document id, item id) of all pairs with a window of 13 words (or the item) that agrees in 80 %."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    found = set()
    for i, t in texts:
        w = words(t)
        for item, it in items:
            it = words(it)
            span = min(13, len(it))
            if len(it) < 8:
                continue
            for shift in range(-len(it), len(w)):
                same = [0 <= k + shift < len(w) and w[k + shift] == x for k, x in enumerate(it)]
                inside = [s for k, s in enumerate(same) if 0 <= k + shift < len(w)]
                if max((sum(inside[k:k + span]) for k in range(len(inside) - span + 1)), default=0) >= math.ceil(span * 0.8):
                    found.add((i, item))
    return found


def test_spaced_seeds(spark, docs, texts):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    rng = random.Random(3)
    long = words(texts[2][1])
    changed = long[5:35]
    for k in (4, 11, 19, 26):
        changed[k] = "zzz"
    items = [(1, " ".join(long[3:30])), (2, " ".join(changed).upper()), (3, "too short an item"), (4, None), (5, ""),
             (6, " ".join(f"u{rng.random()}" for _ in range(30))), (1, " ".join(long[3:30]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = brute_leaks(texts, items)
    got = spaced_seeds.leaks(docs, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == found and {1, 2} <= {b for _, b in found}
    left = spaced_seeds.without_leaks(docs, bench)
    assert left.columns == docs.columns
    gone = {i for i, _ in found}
    assert collect(left.select("doc_id")) == sorted(((i,) for i, _ in texts if i not in gone), key=repr)


def test_leaks_go_by_id_and_text(spark):
    item = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(None, item), (None, "clean text"), (1, "before " + item), (1, "other clean text"), (2, None)], "doc_id long, text string")
    left = spaced_seeds.without_leaks(docs, spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert collect(left) == sorted([(None, "clean text"), (1, "other clean text"), (2, None)], key=repr)


def test_every_fifth_word_replaced(spark):
    words = [f"w{k}" for k in range(40)]
    changed = [w if k % 5 else "zzz" for k, w in enumerate(words)]
    docs = spark.createDataFrame([(1, "before it " + " ".join(changed) + " after")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.offset) for r in spaced_seeds.leaks(docs, bench).collect()] == [(1, 9, 2)]


def test_language_model(docs, texts):
    tokens = [(i, (t or "").encode().lower().split() + [b""]) for i, t in texts]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts}
    count = collections.Counter(w for i, ws in tokens if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    for frequent in (200_000, 3):  # with and without the join of rare words
        got = collect(lm_bloom.scores(docs, frequent=frequent).select(
            "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6)))
        want = [(i, held[i], len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens]
        assert len(got) == len(want)
        for a, b in zip(got, sorted(want, key=repr)):
            assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-4)
    assert all(r.score < 0 for r in lm_bloom.scores(docs).collect())


def test_filter_never_loses_a_count(spark, docs, texts):
    import numpy as np

    rows = docs.select(F.col("text").alias("_text"))
    filter = lm_bloom.build_filter(rows, 20_000)
    word, pair, _ = lm_bloom.keys([lm_bloom.words(t) for _, t in texts])
    key, n = np.unique(np.concatenate([word, pair]), return_counts=True)
    low = filter.levels(key) - lm_bloom.level(n)
    assert (low >= 0).all() and (low > 0).mean() < 0.05


def test_filter_grows_with_the_tokens():
    import numpy as np

    for tokens in (10 ** 6, 10 ** 8, 5 * 10 ** 9, 10 ** 11):
        blocks, block_bits = lm_bloom.geometry(tokens)
        assert blocks * block_bits >= 8 * tokens and block_bits <= 8 * lm_bloom.BLOCK_TOKENS
    # a block's rate of false hits at the load it has at any size: a distinct pair of count one per two tokens
    rates = []
    for tokens in (50_000_000, 5_000_000_000):
        blocks, block_bits = lm_bloom.geometry(tokens)
        rng = np.random.default_rng(1)
        inside, outside = rng.integers(0, 1 << 32, (2, tokens // blocks // 2), np.uint64)
        bits = lm_bloom.block_bitmap(inside, np.ones(len(inside), np.int64), block_bits)
        rates.append((lm_bloom.Filter(bits, 1, block_bits).levels(outside) > 0).mean())
    assert max(rates) < 0.01 and abs(rates[0] - rates[1]) < 0.001


def test_language_model_against_exact_counts(spark):
    import numpy as np

    rng = random.Random(9)
    texts = [(i, " ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randint(1, 400)))) for i in range(60)] + [(None, "w1 w2"), (70, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    tokens = [(i, (t or "").encode().lower().split() + [b""]) for i, t in texts]
    pairs = lambda ws: list(zip([b"", *ws[:-1]], ws))
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts}
    one = collections.Counter(w for i, ws in tokens if not held[i] for w in ws)
    two = collections.Counter(p for i, ws in tokens if not held[i] for p in pairs(ws))
    n, v = sum(one.values()), len(one)
    at = lambda c: int(lm_bloom.level(np.array([c]))[0]) if c else 0
    mid = lambda c: float(lm_bloom.middle(np.array([at(c)]))[0])
    once, more = collections.Counter(), collections.Counter()
    for i, ws in tokens:
        for a, b in pairs(ws) if not held[i] else ():
            (more if at(two[a, b]) >= 2 else once)[at(one[a])] += 1
    weight = lambda c: (more[at(c)] + 1) / (more[at(c)] + once[at(c)] + 2) if c else 0
    want = collections.defaultdict(list)
    for i, ws in tokens:
        want[i].append(sum(math.log10(weight(one[a]) * min(1, mid(two[a, b]) / max(mid(one[a]), 1)) + (1 - weight(one[a])) * (mid(one[b]) + 1) / (n + v + 1))
                           for a, b in pairs(ws)))
    got = lm_bloom.scores(docs).select("doc_id", "n_tokens", "score").collect()
    off = [min(abs(r.score - x) for x in want[r.doc_id]) / r.n_tokens for r in got]
    assert len(got) == len(texts) and max(off) < 0.1 and sorted(off)[len(off) // 2] < 0.02


def test_quality(spark, texts):
    rng = random.Random(8)
    rows = [(i, texts[i % 20][1] if i % 3 else "##! " + " ".join("BUY!!" for _ in range(rng.randint(5, 90)))) for i in range(300)]
    marks = [(i, int(i % 3 > 0)) for i in range(200)] + [(None, 1), (7, None)]
    more = [(900, None), (901, ""), (None, "the or"), (1, rows[1][1])]
    df = spark.createDataFrame(rows + more, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    got = quality.quality_scores(df, labels).collect()
    assert len(got) == len(rows) + len(more)
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id < 300}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert sum(by[i].predicted == (i % 3 > 0) for i in range(300)) >= 290
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(300))
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {i for i in range(300) if by[i].predicted}
    none = quality.quality_scores(df, labels.filter("quality = 1"))
    assert none.filter("predicted = 1").count() == len(got)


def test_bpe(docs, texts):
    P = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = P.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    want = []
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    assert collect(bpe.round_trip(docs, path)) == sorted(want, key=repr)
    assert bpe.decode(bpe.encode(docs, path), path).columns == [*docs.columns, "token_ids", "decoded"]


def test_bpe_in_one_pass(docs):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    rows = bpe.coded(docs, path)
    assert rows.columns == [*docs.columns, "token_ids", "decoded"]
    assert collect(rows) == collect(bpe.decode(bpe.encode(docs, path), path))
    plan = bpe.round_trip(docs, path)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1  # each such node is a Python worker more in every task


def test_bpe_in_small_blocks():
    P = pytest.importorskip("public_tokenizers")
    merges = bpe.loaded(P.path("byte_bpe_50k.json"))
    work = bpe.Transducer(merges, block=32)
    rng = random.Random(4)
    for letters in ("aehitnors", "ab", "=-"):
        text = "".join(rng.choice(letters) for _ in range(3000)).encode()
        whole = merges.merge(text)
        assert list(work.long_piece(text)) == whole == merges.tokens(text)


def test_text_machine():
    machine = bpe.TextMachine({i: bytes([i]) for i in range(256)})
    raw = "aé🙂".encode()
    assert "".join([machine.feed([b]) for b in raw] + [machine.feed([], True)]) == "aé🙂"
    assert machine.text([0xF0, 0x9F, 0x61]) == b"\xf0\x9fa".decode("utf-8", "replace")


SCHEMAS = {"f": {"a": ("integer", True), "b": ("string", False)}}
CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after string"


def test_tool_calls(spark):
    calls = [
        (1, 0, "c0", "f", '{"b":"é\\n","a":1}', None), (1, 2, "c1", "f", '{"a":2}', "c0"), (1, 4, "c2", "f", '{"a":"x","z":0}', "c1"),
        (1, 6, "c3", "g", "{}", "c2"), (2, 0, "k0", "f", "{bad", "k1"), (2, 1, "k1", "f", '{"a":1}', "k0"), (2, 2, "k2", "f", '{"a":1}', "k1"),
        (3, 0, "p", "f", '{"a":1}', "gone"), (3, 1, None, "f", None, None), (1, 9, "c0", "f", '{"a":1}', None), (1, 9, "c0", "f", '{"a":1}', None),
        (4, 0, "n", "f", "[1]", None), (4, 1, "m", "f", '{"a":null}', None)]
    results = [(1, 1, "c0", "done"), (1, 3, "c1", None), (1, 8, "c1", "late"), (9, 1, "zz", "lost"), (9, 2, None, "x")]
    got = tool_calls.linked(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string"), SCHEMAS).collect()
    by = {r.call_id: r for r in got if r.status not in ("duplicate", "no_id")}
    assert {k: (r.level, r.status) for k, r in by.items()} == {
        "c0": (0, "linked"), "c1": (1, "linked"), "c2": (2, "invalid"), "c3": (3, "invalid"), "k0": (None, "cycle"), "k1": (None, "cycle"),
        "k2": (None, "cycle"), "p": (None, "no_parent"), "n": (0, "invalid"), "m": (0, "invalid"), "zz": (None, "orphan")}
    assert sorted(r.status for r in got if r.status in ("duplicate", "no_id")) == ["duplicate", "duplicate", "no_id"]
    assert by["c0"].line == '{"arguments":{"a":1,"b":"é\\n"},"call_id":"c0","name":"f","result":"done"}'
    assert by["c2"].errors == ["a: not integer", "z: unknown"] and by["m"].errors == ["a: missing"]
    assert all(json.loads(r.line) for r in got)
    empty = tool_calls.linked(spark.createDataFrame([], CALLS), spark.createDataFrame([], "conv_id long, turn long, call_id string, content string"), SCHEMAS)
    assert empty.collect() == []


def test_long_chain_of_calls(spark):
    rows = [(1, i, f"c{i}", "f", '{"a":1}', f"c{i - 1}" if i else None) for i in range(300)]
    calls = spark.createDataFrame(rows, CALLS)
    none = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    assert {(r.turn, r.level) for r in tool_calls.linked(calls, none, SCHEMAS).collect()} == {(i, i) for i in range(300)}


def test_warc(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>é {i}</p>\r\n\r\nx" * (i % 40 + 1)) for i in range(1200)] + [(None, None, None), (5, None, ""), (3, "http://h/3", "<p>é 3</p>\r\n\r\nx" * 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    first = warc_fixity.archive(pages).cache()
    assert first.count() == 1202 and first.agg(F.sum("copies")).first()[0] == len(rows)
    assert warc_fixity.audit(first, first).count() == 0
    hurt = F.when(F.col("page_id") == 17, F.concat("record", F.lit("?"))).otherwise(F.col("record"))
    other = first.filter("page_id is null or page_id <> 90").withColumn("record", hurt)
    found = warc_fixity.audit(first, other).join(first, ["file_no", "offset"]).select("page_id", "status")
    assert collect(found) == [(17, "corrupt"), (90, "missing")]
    assert warc_fixity.audit(first.limit(0), first.limit(0)).count() == 0
    assert warc_fixity.audit(first.limit(0), other).filter("status = 'extra'").count() == 1201
    warc_fixity.write_files(first, str(tmp_path / "warc"))
    back = warc_fixity.read_files(spark, str(tmp_path / "warc"))
    assert back.filter("whole").count() == 1202
    assert collect(back.filter("page_id is not null").select("page_id", "html")) == sorted(
        {(i, h) for i, _, h in rows if i is not None}, key=repr)


def test_empty_tables(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert recipes.exact_duplicates(no_docs).count() == 0
    assert line_chunks.without_repeats(no_docs).count() == 0
    assert suffix_repeats.without_repeats(no_docs).count() == 0
    assert count_tree.near_duplicates(no_docs).count() == 0
    assert count_tree.keep_one(no_docs).count() == 0
    assert spaced_seeds.leaks(no_docs, bench).count() == 0
    assert quality.quality_scores(no_docs, labels).count() == 0
    assert lm_bloom.scores(no_docs).count() == 0
    assert warc_fixity.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    P = pytest.importorskip("public_tokenizers")
    assert bpe.round_trip(no_docs, P.path("byte_bpe_50k.json")).count() == 0


def test_links_of_a_hot_key_are_a_line(spark, monkeypatch):
    # two families whose members nearly all link and share keys; one centre cannot settle them
    rng = random.Random(2)
    rows = []
    for kin in range(2):
        words = [f"w{rng.random()}" for _ in range(300)]
        for i in range(60):
            own = list(words)
            for at in rng.sample(range(300), 2 if i % 2 else 4):
                own[at] = f"v{i}"
            rows.append((1000 * kin + i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    count_tree_once, sizes = count_tree.write_once, {}

    def once(table, label):
        out = count_tree_once(table, label)
        sizes.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(count_tree, "write_once", once)
    assert collect(count_tree.near_duplicates(df)) == brute_components(rows, 3, 90)
    assert sum(sizes["families"]) <= 2 * sizes["members"][0]  # a row for a member, not one for each pair that may link


def test_a_class_is_in_one_family(spark, monkeypatch):
    # keys that hold different parts of a family: its sets meet once, not once for each key
    rng = random.Random(3)
    words = [f"w{rng.random()}" for _ in range(300)]
    rows = []
    for i in range(90):
        own = list(words)
        for at in rng.sample(range(300), 2 + i % 4):
            own[at] = f"v{i}"
        rows.append((i, " ".join(own)))
    met, joining = [], count_tree._joining

    def counted(members, *rest):
        met.append((members.count(), members.select("_class").distinct().count()))
        return joining(members, *rest)

    monkeypatch.setattr(count_tree, "_joining", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collect(count_tree.near_duplicates(df)) == brute_components(rows, 3, 90)
    assert met and all(n == classes for n, classes in met)
    monkeypatch.setattr(count_tree, "BLOCK", 7)  # families in blocks
    assert collect(count_tree.near_duplicates(df)) == brute_components(rows, 3, 90)


def test_spanning_edges_name_the_smallest_class():
    # two keys that hold different parts of a family give edges that meet
    import numpy as np

    edges = []
    for classes in ([5, 9, 7, 2], [9, 4, 8]):
        pairs = np.array([(i, j) for i in range(len(classes)) for j in range(i)]).T
        edges += zip(*(side.tolist() for side in count_tree.spanning(np.array(classes), tuple(pairs))))
    assert sorted(edges) == [(2, 5), (2, 7), (2, 9), (4, 8), (4, 9)]


def test_joining_links():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[8:], rng.integers(0, 1 << 62, 8).astype(np.uint64)))) for _ in range(100)]
    sets += [np.unique(rng.integers(0, 1 << 62, 200).astype(np.uint64)) for _ in range(10)]
    parts = np.arange(110)
    assert len(count_tree.tree_pairs(np.ones((110, 1), np.int32) * 200, np.full(110, 200), parts, 0.9)[0]) == 110 * 109 // 2
    links = count_tree.joining_links(sets, parts, 0.9)
    assert len(links) == 99 and all(count_tree.linked(sets[i], sets[j], 0.9) for i, j in links)
    assert {i for pair in links for i in pair} == set(range(100))
    parts[50:100] = 7
    links = count_tree.joining_links(sets, parts, 0.9)
    assert len(links) == 49 and all(parts[i] != parts[j] for i, j in links)
