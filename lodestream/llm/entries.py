"""The queries of this subpackage and their DuckDB oracles, for __spark_entry__.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import bpe, chat_format, decontaminate, fill_middle, fingerprints, line_dedup, minhash, packing, prefix_trie, secret_scan, token_shards, toxicity, url_filter
from lodestream.llm.common import table
from lodestream.sources.tables import spread


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def control_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose turns say control strings."""
    said = "\\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(control_conversation(spark))
    return chat_format.read_back(chat_format.format_windows(turns))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(corpus(spark, sf_dir))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.summary(secret_scan.scan(corpus(spark, sf_dir)))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(corpus(spark, sf_dir))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) = 1 THEN ws
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS items FROM w
), items AS (SELECT doc_id, len(items) AS n, unnest(items) AS item FROM sets
), inter AS (
  SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS nx, any_value(y.n) AS ny, count(*) AS c
  FROM items x JOIN items y ON x.item = y.item AND x.doc_id < y.doc_id AND x.n * 100 >= 80 * y.n AND y.n * 100 >= 80 * x.n GROUP BY 1, 2
), link AS (SELECT a, b FROM inter WHERE 100 * c >= 80 * (nx + ny - c)
), arc AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN arc l ON r.b = l.a
), comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, CAST(len(items) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM sets s JOIN comp USING (doc_id)
"""


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(corpus(spark, sf_dir))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(corpus(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def tracked(pages: DataFrame) -> DataFrame:
    """The list op7 tests against: every page url that carries a tracking parameter."""
    return pages.filter(F.col("url").contains("utm_source=")).select("url")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, tracked(pages)).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH p AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, coalesce(url, '') AS url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), k AS (
  SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '') AS key FROM q
), listed AS (SELECT DISTINCT key FROM k WHERE contains(url, 'utm_source=') AND key <> ''
), rules(action, rule_host, start) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fit AS (
  SELECT page_id, arg_max(rule_host || start, length(rule_host || start)) AS rule, arg_max(action, length(rule_host || start)) AS action
  FROM k JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, start) GROUP BY page_id
)
SELECT k.page_id, k.host, k.path, fit.rule, coalesce(fit.action, CASE WHEN listed.key IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM k LEFT JOIN fit ON k.page_id = fit.page_id LEFT JOIN listed ON k.key = listed.key
"""

def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.remove_lines(corpus(spark, sf_dir).select("doc_id", "source", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM l
), gone AS (SELECT bare FROM t WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= 10
), marked AS (SELECT t.*, gone.bare IS NOT NULL AS out FROM t LEFT JOIN gone ON t.bare = gone.bare
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE out) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT out), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT doc_id, n_lines, n_removed, CAST(length(text) AS BIGINT) AS kept_chars, sha256(text) AS kept_sha256 FROM kept
"""


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.shards(corpus(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(corpus(spark, sf_dir))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transform(corpus(spark, sf_dir))
    restored = fill_middle.restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h, regexp_extract_all(coalesce(text, ''), '[^
]*
|[^
]+') AS u FROM documents
), k AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM d
), c AS (
  SELECT *, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT c, xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)), lambda crc, b:
    list_reduce(range(8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(crc, b)), 4294967295), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT c FROM own)
), taken AS (SELECT ids.c, o.role, o.text, o.pos FROM ids JOIN own o ON o.c = ids.c - ids.c % 5 AND o.pos < ids.h
), given AS (SELECT c, count(*) AS n FROM taken GROUP BY c
), turns AS (
  SELECT * FROM taken UNION ALL
  SELECT own.c, role, text, pos - h + coalesce(n, 0) FROM own JOIN ids USING (c) LEFT JOIN given USING (c) WHERE pos >= h
), paths AS (SELECT c, list({'r': role, 't': text} ORDER BY pos) AS path FROM turns GROUP BY c
), members AS (
  SELECT c, len(coalesce(path, [])) AS n, coalesce(path, []) AS path, unnest(range(0, len(coalesce(path, [])) + 1)) AS d FROM ids LEFT JOIN paths USING (c)
), keyed AS (
  SELECT c, n, d, path[1:d] AS own, CASE WHEN d > 0 THEN strlen(path[d].t) ELSE 0 END AS bytes FROM members
), nodes AS (
  SELECT sha256(CAST(to_json(own) AS VARCHAR)) AS id, any_value(own) AS own, d, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256
  FROM keyed GROUP BY 1, d
), up AS (SELECT id, conv_id, n_convs, bytes, CASE WHEN d > 0 THEN sha256(CAST(to_json(own[1:d - 1]) AS VARCHAR)) END AS parent FROM nodes
), kids AS (SELECT parent AS id, count(*) AS n FROM up GROUP BY parent
), above AS (SELECT id AS node, own, unnest(range(0, d + 1)) AS a, n_convs, bytes FROM nodes
), under AS (
  SELECT sha256(CAST(to_json(own[1:a]) AS VARCHAR)) AS id, count(*) FILTER (kids.id IS NULL) AS leaves, sum((n_convs - 1) * bytes) AS saved
  FROM above LEFT JOIN kids ON kids.id = node GROUP BY 1
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, under.leaves AS n_leaves, CAST(under.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN up USING (id) LEFT JOIN nodes p ON p.id = up.parent LEFT JOIN kids ON kids.id = n.id JOIN under ON under.id = n.id
"""


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_fingerprints": op2_fingerprints,
    "op3_secret_scan": op3_secret_scan,
    "op4_minhash": op4_minhash,
    "op5_bpe": op5_bpe,
    "op6_decontaminate": op6_decontaminate,
    "op7_url_filter": op7_url_filter,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_shards": op9_token_shards,
    "op10_toxicity": op10_toxicity,
    "op11_packing": op11_packing,
    "op12_fill_middle": op12_fill_middle,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES = {"op4_minhash": OP4_SQL, "op7_url_filter": OP7_SQL, "op8_line_dedup": OP8_SQL, "op12_fill_middle": OP12_SQL, "op13_prefix_trie": OP13_SQL}
