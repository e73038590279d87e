"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import bpe_stream, decontaminate, jaccard, licenses, ordinal, packing, polytope, prefix_trie, repair, repeats, token_counts, token_store, url_filter

WORD_BPE, WORD_END, WORD_SIZE = "word_bpe_49k.json", 1, 49_408
BYTE_BPE = "byte_bpe_50k.json"
CONTEXT = 2048


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.digest(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), WORD_END, WORD_SIZE)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return ordinal.score(docs, ordinal.train(docs, ordinal.graded(_table(spark, sf_dir, "labels"))))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), CONTEXT)


def op6_polytope_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polytope.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.digest(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op9_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(_table(spark, sf_dir, "documents")).drop("spans")


# Dated changes of the URL lists that op8 judges the captures of pages by.
LIST_CHANGES = [
    ("block", "domain", "spam-farm.example.org", "spam", "add", "2024-01-01"),
    ("block", "domain", "cheap-pills.example.com", "spam", "add", "2024-02-01"),
    ("block", "domain", "cheap-pills.example.com", "spam", "remove", "2024-06-01"),
    ("block", "domain", "cheap-pills.example.com", "spam", "add", "2024-09-01"),
    ("block", "domain", "example.net", "mirror", "add", "2024-04-01"),
    ("block", "domain", "example.net", "mirror", "remove", "2024-10-01"),
    ("allow", "domain", "tionsh.example.net", "partner", "add", "2024-05-01"),
    ("allow", "domain", "blog.tionble.example.com", "partner", "add", "2024-01-15"),
    ("block", "domain", "blog.tionble.example.com", "malware", "add", "2024-03-15"),
    ("block", "domain", "blog.tionble.example.com", "malware", "remove", "2024-07-01"),
    ("block", "prefix", "blog.ththth.example.org/es", "adult", "add", "2024-02-20"),
    ("allow", "prefix", "tionsh.example.net/fr", "partner", "remove", "2024-03-01"),
    ("block", "prefix", "tionsh.example.net/de", "gambling", "add", "2024-08-01"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages has no fetch time: each page counts as fetched at noon of a day of 2024 that its id gives."""
    names = "list string, kind string, value string, category string, action string, effective string"
    changes = spark.createDataFrame(LIST_CHANGES, names).withColumn("effective", F.to_timestamp("effective"))
    fetched = F.timestamp_seconds(F.lit(1_704_110_400) + F.pmod("page_id", F.lit(366)) * 86_400)
    return url_filter.evaluate(_table(spark, sf_dir, "pages").select("page_id", "url").withColumn("fetched", fetched), changes)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("detections")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(repair.damage(_table(spark, sf_dir, "conversations")))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.shared(_table(spark, sf_dir, "conversations"))


OP8_SQL = f"""
WITH changes(list, kind, value, category, action, effective) AS (VALUES {", ".join("('" + "','".join(x) + "')" for x in LIST_CHANGES)}),
ranges AS (
  SELECT list, kind, value, category, action, CAST(effective AS TIMESTAMP) AS valid_from,
         LEAD(CAST(effective AS TIMESTAMP)) OVER (PARTITION BY list, kind, value ORDER BY effective) AS valid_to FROM changes),
pages_at AS (
  SELECT page_id, TIMESTAMP '2024-01-01 12:00:00' + (page_id % 366) * INTERVAL 1 DAY AS fetched,
         coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p FROM pages),
hits AS (
  SELECT page_id, r.*, row_number() OVER (PARTITION BY page_id ORDER BY length(value) DESC, list, kind, value) AS k
  FROM pages_at JOIN ranges r ON r.action = 'add' AND fetched >= valid_from AND (valid_to IS NULL OR fetched < valid_to)
   AND ((kind = 'domain' AND (host = value OR ends_with(host, '.' || value)))
     OR (kind = 'prefix' AND starts_with(lower(host || CASE WHEN p = '' THEN '/' ELSE p END) || '/', value || '/'))))
SELECT page_id, host, coalesce(list, 'none') AS decision, value AS entry, category, CAST(valid_from AS DATE) AS active_since
FROM pages_at LEFT JOIN (SELECT * FROM hits WHERE k = 1) USING (page_id)
"""

OP2_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
shingles AS (SELECT DISTINCT doc_id, s FROM runs),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id WHERE 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
ends AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT reach.doc_id, ends.v FROM reach JOIN ends ON ends.u = reach.c),
least AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY 1)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

OP6_SQL = """
WITH RECURSIVE sound AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
ends AS (SELECT a.vec_id AS u, b.vec_id AS v FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT reach.vec_id, ends.v FROM reach JOIN ends ON ends.u = reach.c),
degree AS (SELECT u, count(*) AS n FROM ends GROUP BY 1), least AS (SELECT vec_id, min(c) AS component_id FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN degree ON u = vec_id
"""


def _crc32(text: str) -> str:
    """The unsigned crc32 of an ASCII string, a bit at a time."""
    bits = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, k: xor(y >> 1, 3988292384 * (y & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda z: ascii(z)::BIGINT)), lambda a, b: {bits}), 4294967295)"


def _least(*items: str) -> str:
    return f"list_min(list_filter([{', '.join(items)}], lambda z: z IS NOT NULL))"


def _edit(state: str, cost: str, edit: str, when: str = "true") -> str:
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}'}} END"


def _steps_sql() -> str:
    """A row more for each grammar symbol: nothing yet (e), system (s), user (u), pairs complete (p)."""
    stays, deleted = "NOT doomed", lambda x: _edit(x, "3", "D")
    to_u = [_edit(x, "extra", "K", f"{stays} AND ini = 'u'") for x in "esp"] + [_edit(x, "2 + extra", "R", stays) for x in "esp"]
    to_p = [_edit("u", "extra", "K", f"{stays} AND ini = 'a'"), _edit("u", "2 + extra", "R", stays)]
    read = f"{deleted('e')} AS e, {_least(deleted('s'), _edit('e', 'extra', 'K', stays + ' AND ini = ' + chr(39) + 's' + chr(39)))} AS s, {_least(deleted('u'), *to_u)} AS u, {_least(deleted('p'), *to_p)} AS p"
    with_u = f"SELECT conv_id, i, e, s, {_least('u', *(_edit(x, '2', 'I') for x in 'esp'))} AS u, p FROM (SELECT st.conv_id, r.i, {read} FROM st JOIN marked r ON r.conv_id = st.conv_id AND r.i = st.i + 1)"
    return f"SELECT conv_id, i, e, s, u, {_least('p', _edit('u', '2', 'I'))} AS p FROM ({with_u})"


OP11_SQL = rf"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations),
damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN k = 0 THEN 0 WHEN k = 3 THEN 2 ELSE 1 END)) AS again FROM keyed),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare FROM damaged),
seen AS (SELECT *, bare = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again_, role[1] AS ini FROM placed),
marked AS (SELECT conv_id, turn, role, text, i, ini, blank, NOT blank AND again_ AS duplicate, NOT blank AND NOT again_ AND NOT regexp_matches(bare, '[.!?]$') AS truncated, blank OR again_ AS doomed,
  CASE WHEN NOT blank AND NOT again_ AND NOT regexp_matches(bare, '[.!?]$') THEN 1 ELSE 0 END AS extra, coalesce(lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini NOT IN ('su', 'ua', 'au'), false) AS illegal FROM seen),
st AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': ''}} AS e, NULL::STRUCT(c INTEGER, a VARCHAR) AS s, {{'c': 2, 'a': 'I'}} AS u, {{'c': 4, 'a': 'II'}} AS p FROM conversations UNION ALL {_steps_sql()}),
best AS (SELECT conv_id, {_least('e', 'p')} AS b FROM st QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
edits AS (SELECT conv_id, unnest(string_split(b.a, '')) AS edit, generate_subscripts(string_split(b.a, ''), 1) AS j FROM best WHERE b.a <> ''),
numbered AS (SELECT *, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS o FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
joined AS (SELECT n.conv_id, n.o, n.edit, m.role, m.text, m.ini FROM numbered n LEFT JOIN marked m ON m.conv_id = n.conv_id AND m.i = n.i AND n.edit <> 'I' WHERE n.edit <> 'D'),
due AS (SELECT *, CASE WHEN (o - CASE WHEN first_value(edit = 'K' AND ini = 's') OVER (PARTITION BY conv_id ORDER BY o) THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END AS said FROM joined),
lines AS (SELECT conv_id, string_agg(CASE edit WHEN 'K' THEN role ELSE said END || ':' || coalesce(text, ''), chr(10) ORDER BY o) AS repaired FROM due GROUP BY 1),
faults AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
  count(*) FILTER (illegal) AS illegal FROM marked GROUP BY 1)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(b.c AS BIGINT) AS cost,
  b.a AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256 FROM best LEFT JOIN faults USING (conv_id) LEFT JOIN lines USING (conv_id)
"""

OP13_SQL = rf"""
WITH placed AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(x ORDER BY pos) AS turns FROM placed GROUP BY 1), hashed AS (SELECT c, turns, CAST({_crc32('CAST(c AS VARCHAR)')} % 4 AS INTEGER) AS h FROM own),
paths AS (SELECT a.c, list_concat(b.turns[1:h], a.turns[h + 1:]) AS path FROM hashed a LEFT JOIN own b ON b.c = a.c - a.c % 20),
begun AS (SELECT c, len(path) AS n, path, unnest(range(len(path) + 1)) AS d FROM paths),
nodes AS (SELECT path[1:d] AS p, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '') AS ends FROM begun GROUP BY 1, 2),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
own_sums AS (SELECT nodes.p, d, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf, CASE WHEN d > 0 THEN (n_convs - 1) * len(regexp_extract_all(nodes.p[d].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saved FROM nodes LEFT JOIN kids ON kids.p = nodes.p),
above AS (SELECT p[1:k] AS p, leaf, saved FROM (SELECT *, unnest(range(d + 1)) AS k FROM own_sums)), sums AS (SELECT p, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY 1)
SELECT nodes.conv_id, nodes.d AS depth, up.conv_id AS parent_conv_id, nodes.n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(nodes.ends) AS ends_sha256
FROM nodes JOIN sums ON sums.p = nodes.p LEFT JOIN kids ON kids.p = nodes.p LEFT JOIN nodes up ON nodes.d > 0 AND up.d = nodes.d - 1 AND up.p = nodes.p[1:nodes.d - 1]
"""

_ALL = (
    op1_token_store, op2_ngram_jaccard, op3_decontaminate, op4_ordinal_quality, op5_token_counts,
    op6_polytope_neardup, op7_bpe_stream, op8_url_filter, op9_repeated_strings, op10_license_scan,
    op11_conversation_repair, op12_packing, op13_prefix_trie,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = {"op2_ngram_jaccard": OP2_SQL, "op6_polytope_neardup": OP6_SQL, "op8_url_filter": OP8_SQL, "op11_conversation_repair": OP11_SQL, "op13_prefix_trie": OP13_SQL}
