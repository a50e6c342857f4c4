"""One query per operator over its whole table, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm import bpe, count_tree, html_region, line_chunks, lm_bloom, quality, recipes, spaced_seeds, suffix_repeats, tool_calls, turn_repair, warc_fixity, whitening
from placeloom.llm.registry import ORACLES, QUERIES, query, table
from placeloom.session import write_once


@query("op1_decontamination")
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_line_dedup")
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_chunks.without_repeated_passages(table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id", "lines_removed", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_repeats.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_lm_scores")
def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_bloom.scores(table(spark, sf_dir, "documents"))


# The tools that the derived calls name, with the fields of their arguments.
TOOLS = {
    "search": {"query": ("string", True), "turn": ("integer", True), "exact": ("boolean", False)},
    "count": {"query": ("string", True), "turn": ("integer", True)},
}


@query("op5_tool_calls", r"""
    WITH c AS (
        SELECT conv_id, turn, conv_id || ':' || turn AS call_id,
            CASE WHEN turn % 4 = 0 THEN 'search' WHEN turn % 4 = 2 THEN 'count' ELSE 'other' END AS name, text, role
        FROM conversations),
    calls AS (SELECT * FROM c WHERE role = 'user'),
    answers AS (SELECT conv_id, turn, conv_id || ':' || (turn - 1) AS call_id, text AS content FROM c WHERE role = 'assistant'),
    chain AS (
        SELECT a.*, EXISTS (SELECT 1 FROM calls b WHERE b.call_id = a.conv_id || ':' || (a.turn - 2)) AS follows FROM calls a),
    depth AS (
        SELECT *, turn // 2 - max(CASE WHEN NOT follows THEN turn // 2 END) OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS level
        FROM chain),
    j AS (
        SELECT coalesce(d.conv_id, a.conv_id) AS conv_id, coalesce(d.turn, a.turn) AS turn, coalesce(d.call_id, a.call_id) AS call_id,
            d.level::BIGINT AS level, d.name, d.text, a.content, d.call_id IS NULL AS orphan, a.call_id IS NOT NULL AS has
        FROM depth d FULL JOIN answers a ON d.call_id = a.call_id)
    SELECT conv_id, turn, call_id, level,
        CASE WHEN orphan THEN 'orphan' WHEN name = 'other' OR (conv_id % 7 = 3 AND name = 'count') THEN 'invalid' WHEN NOT has THEN 'no_result' ELSE 'linked' END AS status,
        CASE WHEN orphan THEN '' WHEN name = 'other' THEN 'tool: unknown' WHEN conv_id % 7 = 3 AND name = 'count' THEN 'exact: unknown' ELSE '' END AS errors,
        '{"arguments":' || CASE WHEN orphan THEN 'null' ELSE '{' || CASE WHEN conv_id % 7 = 3 THEN '"exact":true,' ELSE '' END
            || '"query":' || to_json(text)::VARCHAR || ',"turn":' || turn || '}' END || ',"call_id":' || to_json(call_id)::VARCHAR
            || ',"name":' || coalesce(to_json(name)::VARCHAR, 'null') || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS line
    FROM j
""")
def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns stand for calls that follow the user turn before, assistant turns for results of the turn before."""
    turns = table(spark, sf_dir, "conversations")
    call_id = lambda back: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    name = F.when(F.col("turn") % 4 == 0, "search").when(F.col("turn") % 4 == 2, "count").otherwise("other")
    users = turns.filter("role = 'user'")
    before = users.select(call_id(0).alias("_before")).distinct()
    arguments = F.to_json(F.struct(
        F.col("turn"), F.col("text").alias("query"), F.when(F.col("conv_id") % 7 == 3, F.lit(True)).alias("exact")))
    calls = users.withColumn("_back", call_id(2)).join(before, F.col("_back") == F.col("_before"), "left").select(
        "conv_id", "turn", call_id(0).alias("call_id"), name.alias("name"), arguments.alias("arguments"), F.col("_before").alias("after"))
    results = turns.filter("role = 'assistant'").select("conv_id", "turn", call_id(1).alias("call_id"), F.col("text").alias("content"))
    return tool_calls.linked(calls, results, TOOLS).withColumn("errors", F.array_join("errors", ", "))


@query("op6_bpe")
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op7_quality_ranking")
def op7_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_exact_dedup", r"""
    WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
        doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d
""")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op9_jaccard_join")
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tree.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_warc_fixity", r"""
    WITH r AS (
        SELECT page_id, count(*) AS copies, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
            || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10)
            || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
            || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
            || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
        FROM pages GROUP BY page_id, url, html),
    n AS (SELECT greatest(1, ceil(count(*) / 500.0)::BIGINT) AS files FROM r),
    p AS (SELECT *, md5(record) AS k, ('0x' || substr(md5(record), 1, 8))::BIGINT % files AS file_no, strlen(record) AS n_bytes FROM r, n),
    o AS (SELECT *, coalesce(sum(n_bytes) OVER (PARTITION BY file_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM p)
    SELECT file_no, "offset", page_id, n_bytes, CASE WHEN page_id % 211 = 13 THEN 'missing' ELSE 'corrupt' END AS status,
        sha256(record) AS sha256_one, CASE WHEN page_id % 211 = 13 THEN NULL ELSE sha256(record || '~') END AS sha256_two
    FROM o WHERE page_id % 211 = 13 OR page_id % 101 = 7
""")
def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of the archive of all pages against a replica in which some records were altered or lost."""
    first = write_once(warc_fixity.archive(table(spark, sf_dir, "pages")), "archive")
    damaged = F.when(F.col("page_id") % 101 == 7, F.concat("record", F.lit("~"))).otherwise(F.col("record"))
    second = first.filter("page_id is null or page_id % 211 <> 13").withColumn("record", damaged)
    named = first.select("file_no", "offset", "page_id", "n_bytes")
    return warc_fixity.audit(first, second).join(named, ["file_no", "offset"]).select(
        "file_no", "offset", "page_id", "n_bytes", "status", "sha256_one", "sha256_two")


@query("op11_turn_repair", r"""
    WITH RECURSIVE steps AS (
        SELECT i, 0 AS k, i AS c FROM range(256) r(i)
        UNION ALL
        SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM steps WHERE k < 8),
    crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
    keyed AS (
        SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
    coded AS (
        SELECT keyed.*, xor(list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(str_split(k, ''), lambda x: ord(x)::BIGINT)),
            lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256)), 4294967295) % 20 AS code
        FROM keyed, crc),
    rows_left AS (
        SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
            CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text
        FROM coded, range(CASE WHEN code = 0 THEN 0 WHEN code = 3 THEN 2 ELSE 1 END)),
    ordered AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS rn,
            rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
        FROM rows_left),
    faults AS (
        SELECT *, body = '' AS blank,
            body <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 AS again,
            body <> '' AND right(body, 1) NOT IN ('.', '!', '?') AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) = 1 AS cut,
            lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY rn) || left(role, 1) AS pair
        FROM ordered),
    counts AS (
        SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
            count_if(blank) AS blank, count_if(again) AS duplicate, count_if(cut) AS truncated,
            count_if(pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
        FROM faults GROUP BY conv_id),
    walk AS (
        SELECT conv_id, n + 1 AS rn, {'c': 0, 'l': '', 'r': ''} AS a0,
            {'c': 4, 'l': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'} AS a1,
            {'c': 2, 'l': 'I', 'r': chr(10) || 'assistant:'} AS a2, {'c': 0, 'l': '', 'r': ''} AS a3
        FROM counts
        UNION ALL
        SELECT conv_id, rn,
            list_min([e0, {'c': o2.c + 2, 'l': 'I' || o2.l, 'r': chr(10) || 'user:' || o2.r}]),
            list_min([e1, {'c': o2.c + 2, 'l': 'I' || o2.l, 'r': chr(10) || 'user:' || o2.r}]),
            list_min([e2, {'c': o3.c + 2, 'l': 'I' || o3.l, 'r': chr(10) || 'assistant:' || o3.r}]),
            list_min([e3, {'c': o2.c + 2, 'l': 'I' || o2.l, 'r': chr(10) || 'user:' || o2.r}])
        FROM (
            SELECT *,
                list_min([e2, {'c': e3.c + 2, 'l': 'I' || e3.l, 'r': chr(10) || 'assistant:' || e3.r}]) AS o2,
                list_min([e3, {'c': e2.c + 2, 'l': 'I' || e2.l, 'r': chr(10) || 'user:' || e2.r}]) AS o3
            FROM (
                SELECT w.conv_id, f.rn,
                    list_min([{'c': a0.c + 3, 'l': 'D' || a0.l, 'r': a0.r},
                        CASE WHEN stay THEN {'c': a2.c + 2 + add, 'l': 'R' || a2.l, 'r': chr(10) || 'user:' || text || a2.r} END,
                        CASE WHEN stay AND i = 'u' THEN {'c': a2.c + add, 'l': 'K' || a2.l, 'r': chr(10) || role || ':' || text || a2.r}
                            WHEN stay AND i = 's' THEN {'c': a1.c + add, 'l': 'K' || a1.l, 'r': chr(10) || role || ':' || text || a1.r} END]) AS e0,
                    list_min([{'c': a1.c + 3, 'l': 'D' || a1.l, 'r': a1.r},
                        CASE WHEN stay THEN {'c': a2.c + 2 + add, 'l': 'R' || a2.l, 'r': chr(10) || 'user:' || text || a2.r} END,
                        CASE WHEN stay AND i = 'u' THEN {'c': a2.c + add, 'l': 'K' || a2.l, 'r': chr(10) || role || ':' || text || a2.r} END]) AS e1,
                    list_min([{'c': a2.c + 3, 'l': 'D' || a2.l, 'r': a2.r},
                        CASE WHEN stay THEN {'c': a3.c + 2 + add, 'l': 'R' || a3.l, 'r': chr(10) || 'assistant:' || text || a3.r} END,
                        CASE WHEN stay AND i = 'a' THEN {'c': a3.c + add, 'l': 'K' || a3.l, 'r': chr(10) || role || ':' || text || a3.r} END]) AS e2,
                    list_min([{'c': a3.c + 3, 'l': 'D' || a3.l, 'r': a3.r},
                        CASE WHEN stay THEN {'c': a2.c + 2 + add, 'l': 'R' || a2.l, 'r': chr(10) || 'user:' || text || a2.r} END,
                        CASE WHEN stay AND i = 'u' THEN {'c': a2.c + add, 'l': 'K' || a2.l, 'r': chr(10) || role || ':' || text || a2.r} END]) AS e3
                FROM walk w JOIN (SELECT *, left(role, 1) AS i, NOT blank AND NOT again AS stay, cut::INT AS add FROM faults) f
                    ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.rn = w.rn - 1))),
    best AS (SELECT conv_id, a0 FROM walk WHERE rn = 1)
    SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
        coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.a0.c, 0)::BIGINT AS cost,
        coalesce(b.a0.l, '') AS audit, sha256(coalesce(substr(b.a0.r, 2), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
        LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM e.conv_id
""")
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turn_repair.report(turns, damaged_turns(turns))


def damaged_turns(turns: DataFrame) -> DataFrame:
    """The damage that the contract names, by the checksum of conversation and turn."""
    id_, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    rows = turns.select(
        "conv_id", "turn", (F.crc32(F.concat(id_, F.lit(":"), turn)) % 20).alias("_code"), role.alias("role"), text.alias("text"))
    copies = F.when(F.col("_code") == 0, 0).when(F.col("_code") == 3, 2).otherwise(1)
    return rows.select(
        "conv_id", "turn", F.when(F.col("_code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy")).drop("_copy")


@query("op12_html_region", r"""
    WITH a AS (
        SELECT page_id, url, row_number() OVER () AS r, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages),
    b AS (SELECT page_id, url, r, unnest(str_split(regexp_replace(body, '</?(p|h1)>', chr(30), 'g'), chr(30))) AS raw,
        generate_subscripts(str_split(regexp_replace(body, '</?(p|h1)>', chr(30), 'g'), chr(30)), 1) AS i FROM a),
    c AS (
        SELECT page_id, url, r, i, trim(regexp_replace(
            replace(replace(regexp_replace(regexp_replace(regexp_replace(raw, '<br>', ' ', 'g'), '</?b>', '', 'g'), '&amp\b;?', chr(31), 'g'),
                '&quot;', '"'), chr(31), '&'), '\s+', ' ', 'g')) AS line FROM b),
    t AS (SELECT page_id, url, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (line <> ''), '') AS text FROM c GROUP BY page_id, url, r)
    SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
""")
def op12_html_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_region.extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def load():
    """All queries of the subpackage and their SQL."""
    return QUERIES, ORACLES
