"""Inputs of the registered queries, derived from the given tables.

Each definition is one SELECT that Spark and DuckDB read alike; braces name the
tables or definitions it builds on.  ``frame`` gives it as a DataFrame, ``ctes`` as
the WITH clause of a checking statement.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .sources.tables import read_table, spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

DEFINITIONS = {
    # a corpus: documents as notes with frontmatter (some of odd types, some broken), links, tags, and links inside code
    # and math that don't count; every tenth is an attachment, two of fifty share a stem
    "corpus": """
SELECT doc_id, source || '/' || lang || CASE WHEN doc_id % 50 IN (1, 26) THEN '/d' || doc_id || '/twin' || CAST(floor(doc_id / 50) AS BIGINT) || '.md' ELSE '/note' || doc_id || CASE WHEN doc_id % 10 = 9 THEN '.PNG' ELSE '.md' END END AS path,
 CASE WHEN doc_id % 10 <> 9 THEN
  CASE WHEN doc_id % 4 = 0 THEN '---' || chr(10) || 'tags: [Alpha, beta]' || chr(10) || 'rank: 3' || chr(10) || 'empty:' || chr(10) || '---' || chr(10)
   WHEN doc_id % 8 = 2 THEN '---' || chr(10) || 'tags: ' || chr(123) || 'a: 1' || chr(125) || chr(10) || 'aliases: 7' || chr(10) || '---' || chr(10)
   WHEN doc_id % 8 = 6 THEN '---' || chr(10) || '[open' || chr(10) || '---' || chr(10) ELSE '' END
  || coalesce(text, '') || chr(10) || chr(10) || '[[note' || (doc_id * 7 + 3) % 1000 || '#Part|seen]] [[missing' || doc_id % 5
  || ']] [x](note' || (doc_id + 20) || '.md#top) [[note' || doc_id || ']] #Tag' || doc_id % 11
  || CASE WHEN doc_id % 7 = 0 THEN ' ![[twin' || CAST(floor(doc_id / 50) AS BIGINT) || ']]' ELSE '' END || chr(10)
  || CASE WHEN doc_id % 3 = 0 THEN chr(10) || chr(96) || '[[code]]' || chr(96) || ' $[[math]]$ ' || chr(92) || '[[escaped]] it is $5 or $6' || chr(10) || chr(10) || chr(96) || chr(96) || chr(96) || chr(10) || '[[fenced]] #fenced' || chr(10) || chr(96) || chr(96) || chr(96) || chr(10) ELSE '' END
 END AS content
FROM {documents}""",
    "scan": """
SELECT 'p' || (o_custkey % 7) AS profile_id, 'dir' || (o_orderkey % 13) || '/sub' || (o_orderkey % 3) || '/f' || o_orderkey || '.md' AS rel_path,
 o_orderkey * 10 + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS size, o_custkey + CASE WHEN o_orderkey % 19 = 0 THEN 5 ELSE 0 END AS mod_time, 'h' || o_orderkey % 23 AS hash
FROM {orders} WHERE o_orderkey % 5 <> 0
UNION ALL SELECT 'p' || (c_custkey % 7), 'new/f' || c_custkey || '.md', c_custkey * 3, c_custkey, 'n' || c_custkey FROM {customer}""",
    "ledger": """
SELECT 'p' || (o_custkey % 7) AS profile_id, 'dir' || (o_orderkey % 13) || '/sub' || (o_orderkey % 3) || '/f' || o_orderkey || '.md' AS rel_path,
 o_orderkey * 10 AS size, o_custkey AS mod_time, 'h' || o_orderkey % 29 AS hash,
 CASE WHEN o_orderkey % 11 = 0 THEN 'suppressed' WHEN o_orderkey % 17 = 0 THEN 'protected' ELSE 'active' END AS state,
 CASE WHEN o_orderkey % 11 = 0 THEN 'hash' || o_custkey % 2 END AS suppressed_policy_hash, CASE WHEN o_orderkey % 11 = 0 THEN o_custkey % 4 END AS suppressed_generation
FROM {orders} WHERE o_orderkey % 4 <> 0""",
    "ignored_keys": "SELECT profile_id, rel_path FROM {ledger} WHERE rel_path LIKE 'dir3/%' OR rel_path LIKE '%7.md'",
    "remote": """
SELECT profile_id, rel_path, size, hash FROM {ledger} WHERE size % 30 <> 0
UNION ALL SELECT 'p' || (l_suppkey % 7), 'dir3/extra' || l_partkey % 50 || '.md', 1, 'x' FROM {lineitem}""",
    "pending": """
SELECT 'p' || (o_custkey % 7) AS profile_id, 'dir' || (o_orderkey % 13) || '/sub' || (o_orderkey % 3) || '/f' || o_orderkey || '.md' AS rel_path,
 CASE o_orderkey % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'modify' WHEN 2 THEN 'delete' ELSE 'rename' END AS event_kind,
 o_orderdate AS first_seen, o_orderdate AS last_seen, o_orderkey % 100 AS source_generation, 'hash' || o_orderkey % 3 AS observed_policy_hash, o_orderkey % 2 = 0 AS policy_context_known
FROM {orders} WHERE o_orderkey % 6 = 0""",
    # change events and progress frames out of the event stream; minutes between frames vary
    "raw_events": """
SELECT event_id, ts, 'p' || user_id % 9 AS profile_id, 'n' || event_id % 40 || '.md' AS path,
 CASE event_id % 12 WHEN 0 THEN 0 WHEN 1 THEN 514 WHEN 2 THEN 516 WHEN 3 THEN 520 WHEN 4 THEN 768 WHEN 5 THEN 1024 WHEN 6 THEN 1026 WHEN 7 THEN 2562 WHEN 8 THEN 8706 WHEN 9 THEN 528 WHEN 10 THEN 576 ELSE 640 END AS flags
FROM {events}""",
    "frames": """
SELECT 'r' || user_id AS run_id, event_id AS seq, ts, CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(floor(value * 10) AS BIGINT) * 100 END AS bytes, event_id % 7 AS checks,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 3 END AS transfers, CAST(0 AS BIGINT) AS listed, CAST(NULL AS BIGINT) AS deletes,
 CASE WHEN event_id % 4 = 0 THEN 'doc' || event_id % 3 END AS item, CASE WHEN event_id % 4 = 0 THEN event_id % 9 END AS item_bytes,
 CASE WHEN event_id % 6 < 2 THEN 'scanning' ELSE 'uploading' END AS phase
FROM {events}""",
    "runs": """
SELECT 'p' || o_custkey % 50 AS profile_id, o_orderkey AS seq, 'run' || o_orderkey AS run_id, o_orderdate AS started_at, o_orderdate AS completed_at,
 CASE WHEN o_orderkey % 5 = 0 THEN 'succeeded' WHEN o_orderkey % 31 = 0 THEN 'running' ELSE 'failed' END AS status,
 CASE WHEN o_orderkey % 3 = 0 THEN 'retryable_limited' WHEN o_orderkey % 7 = 0 THEN 'terminal' ELSE 'retryable' END AS classification,
 o_orderkey % 1000 AS target_generation, 'e' || o_orderkey % 6 AS error_code, CASE WHEN o_orderkey % 2 = 0 THEN 'uploading' ELSE 'scanning' END AS phase
FROM {orders}""",
    "requests": """
SELECT 'p' || (c_custkey % 7) AS profile_id, 'q' || c_custkey AS request_id, 'hash' || c_custkey % 2 AS policy_hash, c_custkey * 17 % 101 AS created_at,
 CASE c_custkey % 5 WHEN 0 THEN 'preview' WHEN 1 THEN 'authorized' WHEN 2 THEN 'running' WHEN 3 THEN 'completed' ELSE 'failed' END AS state
FROM {customer}""",
    "policies": "SELECT DISTINCT 'p' || (c_custkey % 7) AS profile_id, 'hash' || (c_custkey % 7) % 2 AS hash, CASE WHEN c_custkey % 7 = 3 THEN 'pending' ELSE 'ready' END AS refresh_state, 'hash' || (c_custkey % 7) % 2 AS refreshed_hash FROM {customer}",
    "targets": "SELECT profile_id, rel_path, CASE WHEN size % 40 = 0 THEN 'deleted' ELSE 'pending' END AS target_state, 'q' || size % 90 AS request_id FROM {ledger} WHERE state = 'suppressed'",
    "outcomes": "SELECT profile_id, rel_path, CASE size % 3 WHEN 0 THEN 'deleted' WHEN 1 THEN 'missing' ELSE 'failed' END AS outcome FROM {ledger} WHERE state = 'suppressed' AND size % 50 <> 0",
    "recorded": """
SELECT t.profile_id, t.rel_path, CASE WHEN t.target_state IN ('deleted', 'missing') OR o.outcome IS NULL THEN t.target_state ELSE o.outcome END AS target_state, t.request_id,
 t.target_state NOT IN ('deleted', 'missing') AND o.outcome IS NOT NULL AND o.outcome <> t.target_state AS changed
FROM {targets} t LEFT JOIN {outcomes} o ON o.profile_id = t.profile_id AND o.rel_path = t.rel_path""",
    "audit_docs": """
SELECT source || CASE WHEN doc_id % 50 = 7 THEN '/credentials.json' WHEN doc_id % 50 = 8 THEN '/k' || doc_id || '.pem' ELSE '/d' || doc_id || '.md' END || CASE WHEN doc_id % 50 = 7 THEN '' ELSE '' END AS folder_path,
 'd' || doc_id || '/' || CASE WHEN doc_id % 50 = 7 THEN 'credentials.json' WHEN doc_id % 50 = 8 THEN 'k.pem' ELSE 'x.md' END AS path,
 CASE WHEN doc_id % 30 = 5 THEN text || ' someone@gmail.com' ELSE text END AS text FROM {documents}""",
    "needles": "SELECT text AS needle FROM {benchmark} UNION ALL SELECT '# ' || item_id FROM {benchmark} UNION ALL SELECT '' FROM {region}",
    "short_needles": "SELECT split_part(text, ' ', 1) AS needle FROM {benchmark} UNION ALL SELECT split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) FROM {benchmark} UNION ALL SELECT substr(c_name, 10, 1) || '.' FROM {customer} UNION ALL SELECT substr(p_name, 1, 2) FROM {part}",
    # bursts of at most two seconds, a minute apart: every burst is a batch of its own
    "bursts": """
SELECT 'p' || (o_custkey % 211) AS profile_id, o_custkey % 211 AS p, (o_orderkey % 37) * 60000 + (o_orderkey % 7) * 300 AS ms, 'f' || o_orderkey % 11 || '.md' AS path,
 CASE WHEN o_orderkey % 2 = 0 THEN 'create' ELSE 'modify' END AS event_kind, o_orderkey AS k FROM {orders}""",
    "roots": "SELECT 'c' || c_custkey AS profile_id, '/srv/' || c_mktsegment || CASE WHEN c_custkey % 40 = 0 THEN '' WHEN c_custkey % 3 = 0 THEN '/n' || c_nationkey ELSE '/n' || c_nationkey || '/c' || c_custkey END AS root FROM {customer}",
    "odd_paths": "SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'a//b' WHEN 1 THEN '/abs' WHEN 2 THEN 'a/../b' WHEN 3 THEN 'a\\b' WHEN 4 THEN '' WHEN 5 THEN 'a/' WHEN 6 THEN '.knowledge-derived/x' ELSE source || '/' || lang || '/n.md' END AS path FROM {documents}",
    "targets_text": "SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN '#frag' WHEN 2 THEN 'My%20Note+' || page_id || '.md#Head' WHEN 3 THEN '//host/x' WHEN 4 THEN CASE WHEN page_id % 12 = 4 THEN '/abs/' || page_id || '.md' ELSE 'bad%zz' END ELSE '../up/' || page_id || '/./x.md' END AS target, 'a/b' || page_id % 4 AS folder FROM {pages}",
}


def _needs(name: str, seen: list[str]) -> list[str]:
    for d in re.findall(r"{(\w+)}", DEFINITIONS.get(name, "")):
        if d not in TABLES:
            _needs(d, seen)
    if name not in seen:
        seen.append(name)
    return seen


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        rows = read_table(spark, sf_dir, name)
        return spread(rows) if name == "documents" else rows
    used = {d: frame(spark, sf_dir, d) for d in set(re.findall(r"{(\w+)}", DEFINITIONS[name]))}
    return spark.sql(DEFINITIONS[name].replace("\\b'", "\\\\b'"), **used)


def ctes(*names: str) -> str:
    """The definitions behind the names, as a WITH clause; empty where all are tables."""
    order: list[str] = []
    for n in names:
        if n not in TABLES:
            _needs(n, order)
    parts = [f"{n} AS ({re.sub(r'{(\w+)}', r'\1', DEFINITIONS[n])})" for n in order]
    return "WITH " + ",\n".join(parts) if parts else ""
