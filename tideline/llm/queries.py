"""The registered queries of this package: (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, html_extract, jaccard_join, language_id, mixing, packing, quality_rules, repeat_removal, resharding, secret_scan, spelling, token_alignment
from .common import documents


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).withColumn("target", F.round("target", 6))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_query(documents(spark, sf_dir))


def op3_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_tokens(documents(spark, sf_dir))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicate_components(documents(spark, sf_dir), width=4, percent=85)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html_extract.extract_main_text(pages, html_extract.fit_labeller(pages))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets_query(documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.apply_quality_rules(documents(spark, sf_dir), labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum", "rejected_by")


def op8_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_removal.remove_repeats(documents(spark, sf_dir))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return chat_format.conversation_digests(chat_format.format_turns(chat_format.with_tricky(spark, conversations)))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_query(documents(spark, sf_dir))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(spelling.misspelt_words(documents(spark, sf_dir)))


def op13_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resharding.sharding_query(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_source_mixing, op2_language_id, op3_token_packing, op4_ngram_jaccard, op5_html_extraction, op6_secret_scan, op7_quality_rules, op8_repeat_removal, op9_decontamination, op10_chat_format, op11_token_alignment, op12_spelling_variants, op13_resharding)}

_MIX_SQL = r"""
WITH sized AS (SELECT doc_id, source, substr(md5(coalesce(text, '')), 1, 16) AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS texts FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM per_source),
ranked AS (SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total, row_number() OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST) AS nth FROM weighed),
levels AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked),
opened AS (SELECT arg_min(level, nth) AS level FROM levels WHERE level <= cap / weight),
targets AS (SELECT l.* EXCLUDE (level), coalesce(least(cap, weight * o.level), cap) AS target FROM levels l LEFT JOIN opened o ON true),
plan AS (SELECT *, round(sum(target) OVER () / 64)::BIGINT AS n, greatest(1, ceil(source_size / 1048576.0::DOUBLE), ceil(texts / 65536.0::DOUBLE))::BIGINT AS shards FROM targets),
cut AS (SELECT *, sum(target) OVER () AS votes, count(*) OVER () AS parties, ceil(source_size / 64.0::DOUBLE)::BIGINT * 2 + shards * 2 AS most FROM plan),
spread AS (SELECT *, CASE WHEN votes > 0 THEN target / votes * n ELSE 0 END AS exact, CASE WHEN votes > 0 THEN target / votes * parties ELSE 0 END + 2 AS slack FROM cut),
ends AS (SELECT *, least(greatest(floor(exact - slack), 0), most)::BIGINT AS lo, least(ceil(exact + slack) + 2, most)::BIGINT AS hi FROM spread),
rest AS (SELECT *, n - sum(lo) OVER () AS rest FROM ends),
quotients AS (SELECT source, target, lo, rest, target / (2 * k + 1) AS q, k FROM (SELECT *, unnest(CASE WHEN hi > lo THEN range(lo, hi) ELSE [NULL] END) AS k FROM rest)),
won AS (SELECT source, any_value(lo) + count(*) FILTER (nth <= rest AND k IS NOT NULL AND target > 0) AS seats FROM (SELECT *, row_number() OVER (ORDER BY q DESC NULLS LAST, source NULLS LAST, k) AS nth FROM quotients) GROUP BY source),
copied AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, key) - 1 AS copy FROM sized),
dealt AS (SELECT s.*, p.source_size, p.target, w.seats, ('0x' || substr(md5('17|' || coalesce(doc_id, -1) || '|' || key || '|' || copy // greatest(1, least(65536, 1048576 // greatest(size, 1)))), 1, 8))::BIGINT % p.shards AS shard FROM copied s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source JOIN won w ON s.source IS NOT DISTINCT FROM w.source),
placed AS (SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY md5('18|' || coalesce(doc_id, -1)), doc_id NULLS FIRST, key, copy ROWS UNBOUNDED PRECEDING)::BIGINT AS fin FROM dealt WHERE size > 0),
shards AS (SELECT source, shard, sum(size)::BIGINT AS shard_size, any_value(seats) AS n, ceil(sum(size) / 64.0::DOUBLE)::BIGINT AS blocks FROM placed GROUP BY source, shard),
s1 AS (SELECT *, sum(shard_size) OVER (PARTITION BY source) AS votes, count(*) OVER (PARTITION BY source) AS parties, blocks * 2 AS most FROM shards),
s2 AS (SELECT *, shard_size::DOUBLE / votes * n AS exact, shard_size::DOUBLE / votes * parties + 2 AS slack FROM s1),
s3 AS (SELECT *, least(greatest(floor(exact - slack), 0), most)::BIGINT AS lo, least(ceil(exact + slack) + 2, most)::BIGINT AS hi FROM s2),
s4 AS (SELECT *, n - sum(lo) OVER (PARTITION BY source) AS rest FROM s3),
s5 AS (SELECT *, unnest(CASE WHEN hi > lo THEN range(lo, hi) ELSE [NULL] END) AS k FROM s4),
s6 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY shard_size::DOUBLE / (2 * k + 1) DESC NULLS LAST, shard, k) AS nth FROM s5),
s7 AS (SELECT source, shard, blocks, any_value(lo) + count(*) FILTER (nth <= rest AND k IS NOT NULL) AS seats FROM s6 GROUP BY source, shard, blocks),
b1 AS (SELECT *, unnest(range(0, blocks)) AS block FROM s7),
b2 AS (SELECT source, shard, block, seats // blocks + (row_number() OVER (PARTITION BY source, shard ORDER BY md5('17|' || coalesce(source, '') || '|' || shard || '|' || block), block) <= seats % blocks)::BIGINT AS times FROM b1),
pieces AS (SELECT p.*, unnest(range((fin - size) // 64, (fin - 1) // 64 + 1)) AS block FROM placed p),
got AS (SELECT p.doc_id, p.source, p.fin, p.shard, p.size, p.source_size, p.target, sum((least(p.fin, (p.block + 1) * 64) - greatest(p.fin - p.size, p.block * 64)) * b.times)::BIGINT AS taken FROM pieces p JOIN b2 b ON p.source IS NOT DISTINCT FROM b.source AND p.shard = b.shard AND p.block = b.block GROUP BY ALL)
SELECT doc_id, source, size, source_size, round(target, 6) AS target, taken FROM got UNION ALL SELECT doc_id, source, size, source_size, round(target, 6), 0 FROM dealt WHERE size = 0
"""

_CHAT_SQL = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum(4 + 2 + 8 + length(regexp_replace(role, '(\\|###|</turn>|: )', '\\\1', 'g')) + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""

#: All pairs that share a shingle are counted: for small tables, as SQL has no other way.
_JACCARD_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words),
sized AS (SELECT doc_id, len(g)::BIGINT AS n FROM sets),
shingles AS (SELECT doc_id, unnest(g) AS g FROM sets),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sized a ON a.doc_id = x JOIN sized b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM sized UNION SELECT r.node, e.y FROM reach r JOIN edges e ON r.seen = e.x)
SELECT doc_id, n AS n_shingles, (SELECT min(seen) FROM reach WHERE node = doc_id) AS component_id FROM sized
"""

#: Every window of 100 bytes is a row: for small tables, and for ids that don't repeat.
_REPEATS_SQL = r"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT *, (length(h) // 2)::BIGINT AS n_bytes FROM docs),
windows AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS g FROM (SELECT doc_id, h, unnest(range(0, n_bytes - 99)) AS i FROM sized WHERE n_bytes >= 100)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS nth FROM windows) WHERE nth > 1),
begun AS (SELECT *, CASE WHEN i <= lag(i) OVER k + 100 THEN 0 ELSE 1 END AS new FROM again WINDOW k AS (PARTITION BY doc_id ORDER BY i)),
spans AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM begun) GROUP BY doc_id, span),
kept AS (SELECT s.doc_id, lo, substr(h, 2 * coalesce(lag(hi) OVER k, 0) + 1, 2 * (lo - coalesce(lag(hi) OVER k, 0))) AS part FROM spans s JOIN sized d ON d.doc_id = s.doc_id WINDOW k AS (PARTITION BY s.doc_id ORDER BY lo)),
heads AS (SELECT doc_id, string_agg(part, '' ORDER BY lo) AS head FROM kept GROUP BY 1),
cut AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, max(hi) AS reach FROM spans GROUP BY 1)
SELECT d.doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(reach, 0) + 1))) AS kept_sha256 FROM sized d LEFT JOIN cut c ON c.doc_id = d.doc_id LEFT JOIN heads e ON e.doc_id = d.doc_id
"""

#: Checksums by a table of 256 entries, near words by cutting each letter out.
_SPELLING_SQL = r"""
WITH RECURSIVE steps AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256))::BIGINT AS i)),
runs AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY 1, 2),
coded AS (SELECT run, c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS b FROM runs),
summed AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(b) // 2), lambda k: ('0x' || substr(b, 2 * k + 1, 2))::BIGINT)), lambda h, x: xor(h >> 8, t[(xor(h, x) & 255) + 1])), 4294967295) AS h FROM coded, steps),
words AS (SELECT word, sum(c)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM summed) WHERE length(word) >= 5 GROUP BY 1 HAVING sum(c) >= 3),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
 UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY 1),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (SELECT word, word AS root, form AS next FROM formed UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""

ORACLE_SQL: dict[str, str] = {"op1_source_mixing": _MIX_SQL, "op4_ngram_jaccard": _JACCARD_SQL, "op8_repeat_removal": _REPEATS_SQL, "op10_chat_format": _CHAT_SQL, "op12_spelling_variants": _SPELLING_SQL}
