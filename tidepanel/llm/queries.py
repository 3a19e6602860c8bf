"""The contract's queries: each applies an operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import bpe, checksums, importance, licenses, packing, personal_data, repair, repetition, simhash, suffix_dedup, token_counts, token_files, topk, url_rules
from tidepanel.llm.common import shared_dir, table

BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality(table(spark, sf_dir, "documents")).drop("repeat_spans")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(table(spark, sf_dir, "documents"), bpe.read_ranks(BYTE_BPE), decoded=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.cut_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


def op7_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), WORD_BPE)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), WORD_BPE)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(personal_data.find_spans(table(spark, sf_dir, "documents")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.report(repair.damaged(rows), rows.select("conv_id"))


def op12_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), path, WORD_BPE)
    return token_files.documents(spark, path)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


_HOST = r"translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*(/[^?#]*)', 1)"


def _judged() -> str:
    """The url rules in DuckDB's SQL, from the same rule lists."""
    scopes = sorted(url_rules.SCOPES, key=lambda s: (-len(s.host + s.path), s.host, s.path))
    fits = lambda s: f"(host = '{s.host}' OR suffix(host, '.{s.host}')) AND starts_with(path, '{s.path}')"
    rule = " ".join(f"WHEN {fits(s)} THEN '{s.host}{s.path}'" for s in scopes)
    verdict = " ".join(f"WHEN {fits(s)} THEN '{s.verdict}'" for s in scopes)
    n = " + ".join(f"CASE WHEN regexp_matches(u, '{p.regex}') THEN 1 ELSE 0 END" for p in url_rules.PATTERNS)
    return f"SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN n_patterns > 0 THEN 'block' ELSE 'allow' END AS verdict, n_patterns FROM (SELECT page_id, {_HOST} AS host, {_PATH} AS path, CAST({n} AS BIGINT) AS n_patterns FROM (SELECT page_id, url, lower(coalesce(url, '')) AS u FROM pages))"


_TOP_K = "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(CAST(q.ints AS DOUBLE[]), CAST(c.ints AS DOUBLE[])) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)) WHERE rank <= 5"


def _scanned(threshold: float = 0.8) -> str:
    """The license scan in DuckDB's SQL, without filters: each line and each window of words against each template."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = lambda t: f"list_filter(regexp_split_to_array({t}, '{licenses.GAP}'), lambda x: x <> '')"
    place = lambda p: "list_filter(range(0, len(ws)), lambda i: " + " AND ".join(f"ws[i + {k + 1}] = '{w}'" for k, w in enumerate(p.split())) + ")"
    columns = ", ".join(f"{place(p)} AS p{k}" for k, (p, _) in enumerate(licenses.PHRASES))
    every = "list_concat(" + ", ".join(f"p{k}" for k in range(len(licenses.PHRASES))) + ")"
    base = "list_sort(list_filter([" + ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(licenses.PHRASES)) + "], lambda x: x IS NOT NULL))"
    templates = " UNION ALL ".join(f"SELECT '{t.label}' AS label, {sorted(set(t.text.split()))} AS tokens, {len(t.text.split())} AS step" for t in licenses.TEMPLATES)
    return (
        f"WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM documents), "
        f"w AS (SELECT r, doc_id, {words('t')} AS ws FROM d), b AS (SELECT r, doc_id, len(ws) AS n_words, {columns} FROM w), "
        f"l AS (SELECT r, {words('line')} AS lw FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)), t AS ({templates}), "
        f"c AS (SELECT r, label, tokens, lw FROM l, t UNION ALL SELECT r, label, tokens, ws[j * step + 1 : (j + 2) * step] FROM (SELECT r, ws, label, tokens, step, unnest(range(0, (len(ws) - 1) // step + 1)) AS j FROM w, t)), "
        f"m AS (SELECT r, list(DISTINCT label) AS more, max(k / n) AS best FROM (SELECT r, label, len(list_intersect(tokens, lw)) AS k, len(tokens) AS n FROM c) WHERE k >= greatest(1, ceil({threshold} * n - 1e-9)) GROUP BY r) "
        f"SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len({every}) AS BIGINT) AS n_base, CAST(list_min({every}) AS BIGINT) AS first_word, CAST(list_max({every}) AS BIGINT) AS last_word, array_to_string({base}, ',') AS base_labels, "
        f"array_to_string(list_sort(list_distinct(list_concat({base}, coalesce(more, [])))), ',') AS labels, CASE WHEN len({every}) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score FROM b LEFT JOIN m USING (r)"
    )


#: The table of CRC-32 by bytes, and the CRC of a string's UTF-8 bytes by it.
_CRC_TABLE = f"crc AS (SELECT list(c ORDER BY v) AS crc FROM (SELECT v, list_reduce(list_prepend(v, range(8)), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, {checksums.POLYNOMIAL}) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS v)))"


def _crc(text: str) -> str:
    raw = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i - 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {raw}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"


def _resampled(buckets: int = 10_000, seed: int = 2024, least: int = 20, percent: int = 10) -> str:
    """The resampling in DuckDB's SQL: each distinct word's bucket, sums by bucket, gains, and a draw over all documents."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '{licenses.GAP}'), lambda x: x <> '')"
    return (
        f"WITH {_CRC_TABLE}, d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS ws FROM documents), "
        "u AS MATERIALIZED (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY 1, 2), "
        f"v AS MATERIALIZED (SELECT w, count(*) AS n FROM (SELECT unnest({words}) AS w FROM benchmark) GROUP BY 1), "
        f"b AS MATERIALIZED (SELECT w, {_crc('w')} % {buckets} AS bucket FROM (SELECT w FROM u UNION SELECT w FROM v), crc), "
        "s AS (SELECT bucket, sum(n) AS n FROM u JOIN b USING (w) GROUP BY 1), t AS (SELECT bucket, sum(n) AS n FROM v JOIN b USING (w) GROUP BY 1), "
        f"g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + {buckets})::DOUBLE / ((coalesce(s.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + {buckets})::DOUBLE))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)), "
        "x AS (SELECT r, CAST(sum(n * gain) AS BIGINT) AS weight FROM u JOIN b USING (w) JOIN g USING (bucket) GROUP BY r), "
        f"z AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN x USING (r)), "
        f"k AS (SELECT *, n_features >= {least} AS fit, row_number() OVER (PARTITION BY n_features >= {least} ORDER BY score DESC, doc_id NULLS FIRST) AS place FROM z) "
        f"SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= (SELECT count(*) FROM k WHERE fit) * {percent} // 100 THEN place END AS rank FROM k"
    )


def _repaired() -> str:
    """The repair in DuckDB's SQL: rows one after another, the least (cost, audit) of each state with the lines so far."""
    blank = "[\\x20\\x09-\\x0D]"
    grown = lambda x, role: f"CASE WHEN {x} IS NOT NULL THEN {{'c': ({x}).c + {repair.INSERT}, 'a': ({x}).a || 'I', 'l': list_append(({x}).l, '{role}:')}} END"
    least = lambda *cells: f"list_min(list_filter([{', '.join(cells)}], lambda x: x IS NOT NULL))"
    moved = lambda x, when, cost, letter, line: f"CASE WHEN {x} IS NOT NULL AND {when} THEN {{'c': ({x}).c + {cost}, 'a': ({x}).a || '{letter}', 'l': {f'list_append(({x}).l, {line})' if line else f'({x}).l'}}} END"
    more = f"CASE WHEN fault = 'truncated' THEN {repair.TRUNCATED} ELSE 0 END"
    gone = lambda k: moved(f"b[{k}]", "true", repair.DELETE, "D", "")
    kept = lambda k, i: moved(f"b[{k}]", f"initial = '{i}' AND fault IN ('none', 'truncated')", more, "K", "role || ':' || text")
    turned = lambda k, role: moved(f"b[{k}]", "fault IN ('none', 'truncated')", f"{repair.REROLE} + {more}", "R", f"'{role}:' || text")
    step = f"[{gone(1)}, {least(gone(2), kept(1, 's'))}, {least(gone(3), *(f(k, x) for k in (1, 2, 4) for f, x in ((kept, 'u'), (turned, 'user'))))}, {least(gone(4), kept(3, 'a'), turned(3, 'assistant'))}]"
    closed = lambda source, columns: f"SELECT {columns}, [b[1], b[2], u, {least('b[4]', grown('u', 'assistant'))}] AS b FROM (SELECT *, {least('b[3]', *(grown(f'b[{k}]', 'user') for k in (1, 2, 4)))} AS u FROM ({source}))"
    start = f"SELECT conv_id, CAST(0 AS BIGINT) AS i, [{{'c': 0, 'a': '', 'l': CAST([] AS VARCHAR[])}}, NULL, NULL, NULL] AS b FROM (SELECT DISTINCT conv_id FROM conversations)"
    return (
        f"WITH RECURSIVE {_CRC_TABLE}, q AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations), "
        f"h AS (SELECT *, {_crc('key')} % 20 AS kind FROM q, crc), "
        "a AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS again FROM h WHERE kind > 0), "
        "o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM a), "
        f"f AS MATERIALIZED (SELECT *, substr(role, 1, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN regexp_extract(text, '([^\\x20\\x09-\\x0D]){blank}*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM o), "
        f"p AS ({closed(start, 'conv_id, i')} UNION ALL {closed(f'SELECT f.conv_id, f.i, {step} AS b FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1', 'conv_id, i')}), "
        f"e AS (SELECT conv_id, arg_max(b, i) AS b FROM p GROUP BY conv_id), best AS (SELECT conv_id, {least('b[1]', 'b[4]')} AS w FROM e), "
        "n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (near IS NOT NULL AND near || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS near FROM f) GROUP BY conv_id) "
        "SELECT best.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(w.c AS BIGINT) AS cost, w.a AS audit, sha256(array_to_string(w.l, chr(10))) AS repaired_sha256 FROM best LEFT JOIN n ON best.conv_id IS NOT DISTINCT FROM n.conv_id"
    )


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can express; the others are tested by brute force."""
    return {"op3_license_scan": _scanned(), "op5_url_rules": _judged(), "op6_exact_top_k": _TOP_K, "op11_conversation_repair": _repaired(), "op13_importance": _resampled()}
