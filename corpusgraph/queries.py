"""Registered queries of the engine and the SQL that checks them."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions import links as L
from .functions import paths as P
from .inputs import ctes, frame
from .operators import audit, extract, fingerprint, graph, ledger, policy, telemetry
from .operators.blocks import numbered
from .plans import compile as plan
from .plans import incremental, publish
from .sources import corpus as corpus_source
from .sources import feed, logs
from .streaming import events as stream
from .streaming import pending_log as pending
from .streaming import rates as live

Query = Callable[[SparkSession, str], DataFrame]


class Entry(NamedTuple):
    query: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def entry(name: str, inputs: tuple[str, ...], sql: str | None, recursive: bool = False):
    """Register a function of input frames under ``name`` with the SELECT over the same inputs.

    An SQL text that starts with a comma goes on with the inputs' WITH clause.
    """

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(frame(spark, sf_dir, i) for i in inputs))

        with_ = ctes(*inputs)
        ENTRIES[name] = Entry(run, sql and (with_.replace("WITH", "WITH RECURSIVE", 1) if recursive else with_) + "\n" + sql)
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = plan.compile_corpus(frame(spark, sf_dir, "corpus"))
    flags = c.orphans.select("path", "hard_orphan")
    return c.degrees.join(flags, "path", "left").select("path", F.col("incoming_edge_count").alias("incoming"), F.col("outgoing_edge_count").alias("outgoing"), F.coalesce("hard_orphan", F.lit(False)).alias("hard_orphan"))


def queries() -> dict[str, Query]:
    return {n: e.query for n, e in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: e.sql for n, e in ENTRIES.items() if e.sql}


# ---- corpus graph -----------------------------------------------------------------

FILES = """files AS (SELECT *, regexp_extract(path, '(\\.[^./]*)$', 1) AS extension, CASE WHEN doc_id % 10 = 9 THEN 'attachment' ELSE 'note' END AS kind,
 regexp_extract(path, '([^/]*)\\.[^./]*$', 1) AS stem FROM corpus),
asked AS (
 SELECT doc_id, path AS source_path, 0 AS ordinal, 'wikilink' AS link_kind, 'note' || (doc_id * 7 + 3) % 1000 AS raw_target, 'seen' AS display, 'Part' AS fragment, false AS embed FROM files WHERE kind = 'note'
 UNION ALL SELECT doc_id, path, 1, 'wikilink', 'missing' || doc_id % 5, 'missing' || doc_id % 5, '', false FROM files WHERE kind = 'note'
 UNION ALL SELECT doc_id, path, 2, 'markdown', 'note' || (doc_id + 20) || '.md#top', 'x', 'top', false FROM files WHERE kind = 'note'
 UNION ALL SELECT doc_id, path, 3, 'wikilink', 'note' || doc_id, 'note' || doc_id, '', false FROM files WHERE kind = 'note'
 UNION ALL SELECT doc_id, path, 5, 'wikilink', 'twin' || doc_id // 50, 'twin' || doc_id // 50, '', true FROM files WHERE kind = 'note' AND doc_id % 7 = 0),
edges AS (
 SELECT a.source_path, a.ordinal, a.link_kind, a.raw_target, a.display, a.fragment, a.embed, CASE count(t.path) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution_status,
  CASE WHEN count(t.path) = 1 THEN min(t.path) END AS resolved_target_path, CASE WHEN count(t.path) = 1 THEN min(t.kind) END AS target_kind, CASE WHEN count(t.path) > 1 THEN string_agg(t.path, ',' ORDER BY t.path) ELSE '' END AS candidates
 FROM asked a LEFT JOIN files t ON t.kind = 'note' AND CASE WHEN a.link_kind = 'wikilink' THEN t.stem = a.raw_target
  ELSE t.path = regexp_replace(a.source_path, '[^/]*$', '') || split_part(a.raw_target, '#', 1) END GROUP BY ALL),
pairs AS (SELECT source_path, resolved_target_path AS t, count(*) AS n FROM edges WHERE resolution_status = 'resolved' GROUP BY ALL),
degree AS (
 SELECT f.path, coalesce(i.e, 0) AS incoming_edge_count, coalesce(o.e, 0) AS outgoing_edge_count, coalesce(i.nb, 0) AS incoming_neighbor_count, coalesce(g.nb, 0) AS outgoing_neighbor_count,
  coalesce(o.s, 0) AS self_link_count, coalesce(o.u, 0) AS unresolved_link_count, coalesce(o.a, 0) AS ambiguous_link_count
 FROM files f
 LEFT JOIN (SELECT source_path, count(*) AS e, count(*) FILTER (resolved_target_path = source_path) AS s, count(*) FILTER (resolution_status = 'unresolved') AS u, count(*) FILTER (resolution_status = 'ambiguous') AS a FROM edges GROUP BY 1) o ON o.source_path = f.path
 LEFT JOIN (SELECT source_path, count(*) FILTER (source_path <> t) AS nb FROM pairs GROUP BY 1) g ON g.source_path = f.path
 LEFT JOIN (SELECT t, CAST(sum(n) AS BIGINT) AS e, count(*) FILTER (source_path <> t) AS nb FROM pairs GROUP BY 1) i ON i.t = f.path
 WHERE f.kind = 'note'),
orphan AS (SELECT *, incoming_neighbor_count = 0 AND outgoing_neighbor_count = 0 AS hard_orphan, incoming_neighbor_count = 0 AS no_backlink, incoming_neighbor_count = 0 AND outgoing_neighbor_count > 0 AS outbound_only
 FROM degree WHERE incoming_neighbor_count = 0),
tags AS (
 SELECT path, 'tag' || doc_id % 11 AS tag, '#Tag' || doc_id % 11 AS variant FROM files WHERE kind = 'note'
 UNION ALL SELECT path, 'alpha', 'Alpha' FROM files WHERE kind = 'note' AND doc_id % 4 = 0
 UNION ALL SELECT path, 'beta', 'beta' FROM files WHERE kind = 'note' AND doc_id % 4 = 0)"""


WARNINGS = """warned AS (SELECT 'frontmatter_tag_type_unsupported' AS code, path, 'tags must be a scalar or sequence of scalars' AS message FROM files WHERE kind = 'note' AND doc_id % 8 = 2
 UNION ALL SELECT 'frontmatter_alias_type_unsupported', path, 'aliases must be a scalar or sequence' FROM files WHERE kind = 'note' AND doc_id % 8 = 2
 UNION ALL SELECT 'frontmatter_malformed', path, 'frontmatter could not be decoded' FROM files WHERE kind = 'note' AND doc_id % 8 = 6)"""


def on_corpus(name: str, sql: str | None, keep: bool = True):
    """Register a function of the compiled corpus; ``keep`` where it uses facts or links more than once."""

    def add(f: Callable[[plan.Compiled], DataFrame]) -> Callable:
        ENTRIES[name] = Entry(lambda spark, sf_dir: f(plan.compile_corpus(frame(spark, sf_dir, "corpus"), keep)), sql and ctes("corpus") + ",\n" + FILES + ",\n" + WARNINGS + "\n" + sql)
        return f

    return add


@on_corpus("corpus_files", "SELECT path, kind, extension, stem, sha256(path) AS path_id, split_part(path, '/', 1) AS top, CAST(len(string_split(path, '/')) - 1 AS INTEGER) AS depth, regexp_replace(path, '/[^/]*$', '') AS folder FROM files", keep=False)
def _(c):
    return c.files.select("path", "kind", "extension", "stem", "path_id", P.top_folder("path").alias("top"), P.depth("path").alias("depth"), P.dirname("path").alias("folder"))


@on_corpus("corpus_links", "SELECT source_path, CAST(ordinal AS INTEGER) AS ordinal, link_kind, raw_target, display, fragment, embed, resolution_status, resolved_target_path, target_kind, candidates FROM edges", keep=False)
def _linked(c):
    return c.links.select("source_path", "ordinal", "link_kind", "raw_target", "display", "fragment", "embed", "resolution_status", "resolved_target_path", "target_kind", F.array_join("candidate_paths", ",").alias("candidates"))


@on_corpus("link_candidates", "SELECT source_path, CAST(ordinal AS INTEGER) AS ordinal, unnest(string_split(coalesce(resolved_target_path, candidates), ',')) AS candidate_path FROM edges WHERE resolution_status <> 'unresolved'", keep=True)
def _(c):
    """Every file that a link may mean, as rows."""
    return graph.link_candidates(c.links.select("source_path", "ordinal", "link_kind", "raw_target"), c.files).select("source_path", "ordinal", "candidate_path")


@on_corpus("corpus_degrees", "SELECT * FROM degree")
def _(c):
    return c.degrees


@on_corpus("corpus_orphans", "SELECT * FROM orphan")
def _(c):
    return c.orphans


@on_corpus("corpus_broken", "SELECT source_path, raw_target, resolution_status FROM edges WHERE resolution_status <> 'resolved'", keep=False)
def _(c):
    return c.broken.select("source_path", "raw_target", "resolution_status")


@on_corpus("corpus_broken_groups", "SELECT resolution_status AS status, raw_target AS target, split_part(source_path, '/', 1) AS folder, count(*) AS n FROM edges WHERE resolution_status <> 'resolved' GROUP BY ALL", keep=False)
def _(c):
    return graph.broken_groups(c.broken)


@on_corpus("corpus_orphan_folders", "SELECT split_part(path, '/', 1) AS folder, count(*) FILTER (hard_orphan) AS hard, count(*) FILTER (no_backlink) AS no_backlink, count(*) FILTER (outbound_only) AS outbound_only FROM orphan GROUP BY 1")
def _(c):
    return graph.orphan_folders(c.orphans)


@on_corpus("corpus_tag_index", "SELECT tag, count(DISTINCT path) AS note_count, count(*) AS occurrence_count, array_to_string(list_sort(list_distinct(list(variant))), ',') AS variants, array_to_string(list_sort(list_distinct(list(path))), ',') AS note_paths FROM tags GROUP BY 1", keep=False)
def _(c):
    return graph.tag_index(c.tags).withColumns({x: F.array_join(x, ",") for x in ("variants", "note_paths")})


@on_corpus("corpus_tag_notes", "SELECT tag, path, count(*) AS occurrences FROM tags GROUP BY ALL", keep=False)
def _(c):
    return graph.tag_notes(c.tags)


@on_corpus("corpus_frontmatter", """SELECT field, CAST(sum(n) AS BIGINT) AS present_count, CAST(sum(CASE WHEN kind2 = 'null' THEN n ELSE 0 END) AS BIGINT) AS null_count, string_agg(kind2 || '=' || n, ',' ORDER BY kind2) AS type_counts
 FROM (SELECT field, kind2, count(*) AS n FROM (SELECT unnest(['tags', 'rank', 'empty']) AS field, unnest(['sequence', 'number', 'null']) AS kind2 FROM files WHERE kind = 'note' AND doc_id % 4 = 0
  UNION ALL SELECT unnest(['tags', 'aliases']), unnest(['mapping', 'number']) FROM files WHERE kind = 'note' AND doc_id % 8 = 2) GROUP BY ALL) GROUP BY field""", keep=False)  # fmt: skip
def _(c):
    return graph.frontmatter_stats(c.parsed).withColumn("type_counts", F.array_join(F.transform(F.map_entries("type_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


@on_corpus("corpus_with_frontmatter", "SELECT count(*) FILTER (doc_id % 2 = 0) AS notes_with_frontmatter FROM files WHERE kind = 'note'", keep=False)
def _(c):
    return graph.notes_with_frontmatter(c.parsed)


@on_corpus("corpus_counts", """SELECT (SELECT count(*) FROM files) AS eligible_files, (SELECT count(*) FROM degree) AS notes, (SELECT count(*) FROM files WHERE kind <> 'note') AS attachments,
 (SELECT count(*) FROM edges) AS link_occurrences, (SELECT count(*) FROM edges WHERE resolution_status <> 'resolved') AS broken_links, (SELECT count(*) FROM orphan WHERE hard_orphan) AS hard_orphans,
 (SELECT count(*) FROM orphan) AS no_backlink_notes, (SELECT count(*) FROM orphan WHERE outbound_only) AS outbound_only_notes, (SELECT count(DISTINCT tag) FROM tags) AS tags, (SELECT count(*) FROM warned) AS warnings""")  # fmt: skip
def _(c):
    return c.counts()


@on_corpus("corpus_records", """SELECT f.path, f.kind, coalesce(d.incoming_edge_count, 0) AS incoming_edge_count, coalesce(d.outgoing_neighbor_count, 0) AS outgoing_neighbor_count, coalesce(t.tags, '') AS tags
 FROM files f LEFT JOIN degree d ON d.path = f.path LEFT JOIN (SELECT path, array_to_string(list_sort(list_distinct(list(tag))), ',') AS tags FROM tags GROUP BY 1) t ON t.path = f.path""")  # fmt: skip
def _(c):
    return graph.file_records(c.files, c.degrees, c.tags).select("path", "kind", "incoming_edge_count", "outgoing_neighbor_count", F.array_join("tags", ",").alias("tags"))


@on_corpus("corpus_warnings", "SELECT * FROM warned", keep=False)
def _(c):
    return c.warnings


# ---- path and link functions ------------------------------------------------------

@entry("path_checks", ("odd_paths",), "SELECT doc_id, path, path <> '' AND NOT contains(path, chr(92)) AND NOT contains('/' || path || '/', '//') AND NOT contains('/' || path || '/', '/../') AND NOT contains('/' || path || '/', '/./') AS canonical, path = '.knowledge-derived' OR starts_with(path, '.knowledge-derived/') AS reserved FROM odd_paths")
def _(d):
    return d.select("doc_id", "path", P.is_canonical("path").alias("canonical"), P.is_reserved("path").alias("reserved"))


@entry("link_targets", ("targets_text",), """SELECT page_id, target, starts_with(target, '#') OR starts_with(target, '//') OR contains(target, ':') AS external, split_part(target, '#', 1) AS bare,
 CASE WHEN contains(target, '#') THEN substr(target, instr(target, '#') + 1) ELSE '' END AS fragment, CASE WHEN contains(target, '%zz') THEN NULL ELSE replace(target, '%20', ' ') END AS decoded FROM targets_text""")  # fmt: skip
def _(d):
    return d.select("page_id", "target", L.is_external("target").alias("external"), L.without_fragment("target").alias("bare"), L.fragment("target").alias("fragment"), L.percent_decoded("target").alias("decoded"))


@entry("joined_targets", ("targets_text",), "SELECT page_id, CASE WHEN starts_with(target, '/') THEN NULL WHEN page_id % 6 = 5 THEN 'a/up/' || page_id || '/x.md' ELSE rtrim(regexp_replace(folder || '/' || target, '/+', '/', 'g'), '/') END AS joined FROM targets_text")
def _(d):
    return d.select("page_id", P.join_clean("folder", "target").alias("joined"))


@entry("relative_paths", ("roots",), "SELECT profile_id, CASE WHEN root = '/srv/BUILDING' THEN '' WHEN starts_with(root, '/srv/BUILDING/') THEN substr(root, 15) END AS rel FROM roots")
def _(d):
    return d.select("profile_id", P.relative_to("root", "/srv/BUILDING").alias("rel"))


@entry("contract_digests", ("orders",), "SELECT o_orderkey, sha256(encode(o_orderstatus) || '\\x00'::BLOB || encode(CAST(o_orderkey AS VARCHAR))) AS framed, CASE WHEN o_orderkey % 3 = 0 THEN 'empty' ELSE sha256(CASE WHEN o_orderkey % 3 = 1 THEN '' ELSE o_orderstatus END) END AS policy FROM orders")
def _(d):
    content = F.when(F.col("o_orderkey") % 3 == 1, "").when(F.col("o_orderkey") % 3 == 2, F.col("o_orderstatus"))
    return d.select("o_orderkey", L.framed_digest("o_orderstatus", F.col("o_orderkey").cast("string")).alias("framed"), L.policy_hash(content).alias("policy"))


@entry("parsed_times", ("events",), "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE date_trunc('second', ts) END AS parsed FROM events")
def _(d):
    text = F.when(F.col("event_id") % 4 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.000'Z'"))
    return d.select("event_id", L.parsed_time(text).cast("timestamp_ntz").alias("parsed"))


# ---- policies ---------------------------------------------------------------------

POLICY = [("", "", "# comment\n*.PNG\n/src1/\nnote?7.md\n!note17.md\n**/es/note2*\n"), ("src2/.gitignore", "src2", "note[0-3]*.md\n!note12.md\n")]
IGNORED = """(path LIKE '%.PNG' OR path LIKE 'src1/%' OR (regexp_matches(path, '/note.7[.]md$') AND path NOT LIKE '%/note17.md') OR regexp_matches(path, '(^|/)es/note2[^/]*$')
 OR (path LIKE 'src2/%' AND regexp_matches(path, '/note[0-3][^/]*[.]md$')))
 AND NOT (path LIKE 'src2/%' AND path LIKE '%/note12.md')"""


def _rules(d: DataFrame) -> DataFrame:
    return policy.rule_frame(d.sparkSession, policy.compile_policy(POLICY)[0])


@entry("ignored_paths", ("corpus",), f"SELECT path, false AS is_dir, {IGNORED} AS ignored FROM corpus")
def _(d):
    return policy.ignored(d.select("path", F.lit(False).alias("is_dir")), _rules(d))


@entry("eligibility", ("corpus",), f"SELECT path, CASE WHEN {IGNORED} THEN 'ignored' WHEN doc_id % 21 = 0 THEN 'symlink' WHEN doc_id % 22 = 0 THEN 'irregular' WHEN doc_id > 700 THEN 'oversize' ELSE 'eligible' END AS status FROM corpus")
def _(d):
    e = d.select("path", F.col("doc_id").alias("size"), (F.col("doc_id") % 21 == 0).alias("is_symlink"), (F.col("doc_id") % 22 != 0).alias("is_regular"))
    v = policy.ignored(e.select("path", F.lit(False).alias("is_dir")), _rules(d))
    return policy.eligibility(e, v, 700).select("path", "status")


LEGACY = [("exclude_path_prefix", "src3/en"), ("exclude_dir_name", "fr"), ("exclude_filename", "note44.md"), ("exclude_extension", "png")]


@entry("legacy_excluded", ("corpus",), """SELECT path, CASE WHEN path = 'src3/en' OR starts_with(path, 'src3/en/') THEN 'exclude_path_prefix:src3/en' WHEN path LIKE 'fr/%' OR path LIKE '%/fr/%' THEN 'exclude_dir_name:fr'
 WHEN path LIKE '%/note44.md' THEN 'exclude_filename:note44.md' WHEN lower(path) LIKE '%.png' THEN 'exclude_extension:png' END AS reason FROM corpus""")  # fmt: skip
def _(d):
    return policy.legacy_excluded(d.select("path"), LEGACY)


@entry("legacy_patterns", ("part",), "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '/a\\*b' || p_partkey WHEN 1 THEN '**/d' || p_partkey || '/' WHEN 2 THEN 'x\\[' || p_partkey || '\\]' ELSE '*.[tT][mM]' || p_partkey END AS pattern FROM part")
def _(d):
    k, n = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    kinds = F.element_at(F.array(*map(F.lit, ("exclude_path_prefix", "exclude_dir_name", "exclude_filename", "exclude_extension"))), (k + 1).cast("int"))
    value = F.when(k == 0, F.concat(F.lit("/a*b"), n)).when(k == 1, F.concat(F.lit("d"), n)).when(k == 2, F.concat(F.lit("x["), n, F.lit("]"))).otherwise(F.concat(F.lit(".tm"), n))
    return policy.legacy_to_patterns(d.select("p_partkey", kinds.alias("kind"), value.alias("value"))).select("p_partkey", "pattern")


@entry("overlapping_roots", ("roots",), """SELECT o.profile_id AS outer_profile, o.root AS outer_root, i.profile_id AS inner_profile, i.root AS inner_root FROM roots o JOIN roots i
 ON o.profile_id <> i.profile_id AND ((o.root = i.root AND o.profile_id < i.profile_id) OR starts_with(i.root, o.root || '/'))""")  # fmt: skip
def _(d):
    return policy.overlapping_roots(d)


# ---- ledger -----------------------------------------------------------------------

DIFF = """SELECT coalesce(s.profile_id, l.profile_id) AS profile_id, coalesce(s.rel_path, l.rel_path) AS rel_path, CASE WHEN s.rel_path IS NULL THEN 'deleted' ELSE 'changed' END AS change
 FROM scan s FULL JOIN (SELECT * FROM ledger{where}) l ON l.profile_id = s.profile_id AND l.rel_path = s.rel_path WHERE s.rel_path IS NULL OR l.rel_path IS NULL OR s.size <> l.size OR s.mod_time <> l.mod_time"""
ACTIVE = DIFF.format(where=" WHERE state = 'active'")
BOTH = "USING (profile_id, rel_path)"


@entry("ledger_diff", ("scan", "ledger"), ACTIVE)
def _(s, l):
    return ledger.diff_ledger(s, l)


@entry("catch_up", ("scan", "ledger"), f"SELECT profile_id, rel_path, CASE WHEN change = 'deleted' THEN 'delete' ELSE 'modify' END AS event_kind FROM ({DIFF.format(where='')})")
def _(s, l):
    return ledger.catch_up_events(s, l)


@entry("sync_now", ("scan", "ledger", "pending"), f"SELECT p.*, coalesce((SELECT bool_or(change = 'deleted') FROM ({ACTIVE}) d WHERE d.profile_id = p.profile_id), false) AS \"full\" FROM (SELECT profile_id, rel_path FROM ({ACTIVE}) WHERE change = 'changed' UNION SELECT profile_id, rel_path FROM pending) p")
def _(s, l, p):
    return ledger.sync_now_paths(s, l, p)


VERDICTS = f"""SELECT l.profile_id, l.rel_path, CASE WHEN h.rel_path IS NULL OR EXISTS (SELECT 1 FROM pending p WHERE p.profile_id = l.profile_id AND p.rel_path = l.rel_path AND p.event_kind IN ('delete', 'rename', 'other') AND p.policy_context_known AND p.observed_policy_hash <> 'hash1') THEN 'delete' ELSE 'suppress' END AS verdict
 FROM ledger l LEFT JOIN ignored_keys h {BOTH} WHERE l.state = 'active' AND NOT EXISTS (SELECT 1 FROM scan s WHERE s.profile_id = l.profile_id AND s.rel_path = l.rel_path)"""


@entry("disappearances", ("ledger", "scan", "pending", "ignored_keys"), VERDICTS)
def _(l, s, p, i):
    return ledger.classify_disappearances(l, s, p.withColumnRenamed("rel_path", "path"), "hash1", i)


@entry("ledger_refresh", ("ledger", "scan", "pending", "ignored_keys"), f"""SELECT l.profile_id, l.rel_path, l.size, l.mod_time, l.hash, CASE WHEN hide THEN 'suppressed' WHEN back THEN 'active' ELSE state END AS state,
 CASE WHEN hide THEN 'hash1' WHEN NOT back THEN suppressed_policy_hash END AS suppressed_policy_hash, CASE WHEN hide THEN 9 WHEN NOT back THEN suppressed_generation END AS suppressed_generation
 FROM (SELECT l.*, l.state = 'active' AND s.rel_path IS NULL AND coalesce(v.verdict, '') <> 'delete' AS hide, l.state = 'suppressed' AND s.rel_path IS NOT NULL AS back FROM ledger l LEFT JOIN scan s {BOTH} LEFT JOIN ({VERDICTS}) v {BOTH}) l""")  # fmt: skip
def _(l, s, p, i):
    v = ledger.classify_disappearances(l, s, p.withColumnRenamed("rel_path", "path"), "hash1", i)
    return ledger.refresh_ledger(l, s, v.filter("verdict = 'delete'"), "hash1", 9)


APPLY = f"""SELECT profile_id, rel_path, CASE WHEN s.rel_path IS NULL THEN l.size ELSE s.size END AS size, CASE WHEN s.rel_path IS NULL THEN l.mod_time ELSE s.mod_time END AS mod_time, CASE WHEN s.rel_path IS NULL THEN l.hash ELSE s.hash END AS hash,
 coalesce(l.state, 'active') AS state, l.suppressed_policy_hash, l.suppressed_generation FROM ledger l FULL JOIN scan s {BOTH}"""


@entry("ledger_apply", ("ledger", "scan"), APPLY + " WHERE s.rel_path IS NOT NULL OR l.state <> 'active'")
def _(l, s):
    return ledger.apply_ledger(l, s)


@entry("ledger_upsert", ("ledger", "scan"), APPLY)
def _(l, s):
    return ledger.apply_ledger(l, s, delete_stale=False)


@entry("ledger_suppress", ("ledger", "ignored_keys"), f"""SELECT profile_id, rel_path, size, mod_time, hash, CASE WHEN m THEN 'suppressed' ELSE state END AS state, CASE WHEN m THEN 'hash1' ELSE suppressed_policy_hash END AS suppressed_policy_hash,
 CASE WHEN m THEN 4 ELSE suppressed_generation END AS suppressed_generation FROM (SELECT l.*, i.rel_path IS NOT NULL AND l.state <> 'protected' AS m FROM ledger l LEFT JOIN (SELECT profile_id, rel_path FROM ignored_keys) i ON i.profile_id = l.profile_id AND i.rel_path = l.rel_path)""")  # fmt: skip
def _(l, i):
    return ledger.mark_suppressed(l, i, "hash1", 4)


@entry("ledger_reactivate", ("ledger", "ignored_keys"), """SELECT profile_id, rel_path, size, mod_time, hash, CASE WHEN m THEN 'active' ELSE state END AS state, CASE WHEN NOT m THEN suppressed_policy_hash END AS suppressed_policy_hash,
 CASE WHEN NOT m THEN suppressed_generation END AS suppressed_generation FROM (SELECT l.*, i.rel_path IS NOT NULL AND l.state <> 'protected' AS m FROM ledger l LEFT JOIN ignored_keys i ON i.profile_id = l.profile_id AND i.rel_path = l.rel_path)""")  # fmt: skip
def _(l, i):
    return ledger.reactivate(l, i)


@entry("ledger_delete", ("ledger", "ignored_keys"), f"SELECT l.* FROM ledger l ANTI JOIN ignored_keys i {BOTH}")
def _(l, i):
    return ledger.delete_rows(l, i)


@entry("ledger_counts", ("ledger",), "SELECT profile_id, count(*) AS total, count(*) FILTER (state = 'active') AS active_count, count(*) FILTER (state = 'suppressed') AS suppressed_count, count(*) FILTER (state = 'protected') AS protected_count FROM ledger GROUP BY 1")
def _(l):
    return ledger.ledger_counts(l)


@entry("remote_orphans", ("remote", "ledger", "ignored_keys"), "SELECT DISTINCT profile_id, rel_path FROM remote r WHERE rel_path LIKE 'dir3/extra%'")
def _(r, l, i):
    hidden = i.unionByName(r.filter("rel_path LIKE 'dir3/%'").select("profile_id", "rel_path"))
    return ledger.unmanaged_orphans(r, l, hidden)


@entry("still_unmanaged", ("remote", "ledger"), f"SELECT DISTINCT r.profile_id, r.rel_path FROM remote r ANTI JOIN ledger l {BOTH}")
def _(r, l):
    return ledger.still_unmanaged(r, l)


@entry("target_presence", ("targets", "remote"), f"SELECT t.*, CASE WHEN r.rel_path IS NULL THEN 'missing' ELSE 'existing' END AS presence FROM targets t LEFT JOIN (SELECT DISTINCT profile_id, rel_path FROM remote) r {BOTH}")
def _(t, r):
    return ledger.classify_targets(t, r)


@entry("verify_hash", ("scan", "ledger"), f"SELECT s.profile_id, s.rel_path, CASE WHEN l.rel_path IS NULL THEN 'missing' WHEN s.size <> l.size THEN 'size_differs' ELSE 'hash_differs' END AS problem FROM scan s LEFT JOIN ledger l {BOTH} WHERE l.rel_path IS NULL OR s.size <> l.size OR s.hash <> l.hash")
def _(s, l):
    return ledger.verify_one_way(s, l, "hash")


@entry("verify_size", ("scan", "ledger"), f"SELECT s.profile_id, s.rel_path, CASE WHEN l.rel_path IS NULL THEN 'missing' ELSE 'size_differs' END AS problem FROM scan s LEFT JOIN ledger l {BOTH} WHERE l.rel_path IS NULL OR s.size <> l.size")
def _(s, l):
    return ledger.verify_one_way(s, l)


@entry("remote_duplicates", ("remote",), "SELECT profile_id, rel_path, count(*) AS copies FROM remote GROUP BY ALL HAVING count(*) > 1")
def _(r):
    return ledger.duplicate_paths(r, ("profile_id", "rel_path"))


@entry("event_fates", ("pending", "scan", "ignored_keys"), f"SELECT p.profile_id, p.rel_path, p.event_kind, CASE WHEN i.rel_path IS NOT NULL THEN 'excluded' WHEN s.rel_path IS NOT NULL THEN 'eligible' ELSE 'stale' END AS fate FROM pending p LEFT JOIN scan s {BOTH} LEFT JOIN ignored_keys i {BOTH}")
def _(p, s, i):
    return ledger.eligible_events(p, s, i).select("profile_id", "rel_path", "event_kind", "fate")


@entry("pending_summary", ("pending",), "SELECT profile_id, count(*) AS pending, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM pending GROUP BY 1")
def _(p):
    return ledger.pending_summary(p)


EVENTS_SQL = "SELECT profile_id, path, CASE WHEN event_id % 3 = 0 THEN 'modify' ELSE 'delete' END AS event_kind, ts AS first_seen, ts AS last_seen, event_id AS source_generation, 'hash' || event_id % 3 AS observed_policy_hash, event_id % 4 AS observed_policy_generation, event_id % 5 <> 0 AS policy_context_known FROM raw_events"


def _events(d: DataFrame) -> DataFrame:
    return d.select("profile_id", "path", F.when(F.col("event_id") % 3 == 0, "modify").otherwise("delete").alias("event_kind"), F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"), F.col("event_id").alias("source_generation"),
                    F.concat(F.lit("hash"), (F.col("event_id") % 3).cast("string")).alias("observed_policy_hash"), (F.col("event_id") % 4).alias("observed_policy_generation"), (F.col("event_id") % 5 != 0).alias("policy_context_known"))


UPSERT = f"SELECT profile_id, path, max_by(event_kind, source_generation) AS event_kind, min(first_seen) AS first_seen, max(last_seen) AS last_seen, max(source_generation) AS source_generation, max_by(observed_policy_hash, source_generation) AS observed_policy_hash, max_by(observed_policy_generation, source_generation) AS observed_policy_generation, max_by(policy_context_known, source_generation) AS policy_context_known FROM ({EVENTS_SQL}) GROUP BY 1, 2"


@entry("pending_upsert", ("raw_events",), UPSERT)
def _(d):
    e = _events(d)
    return ledger.upsert_pending(e.filter("source_generation % 2 = 0"), e.filter("source_generation % 2 = 1"))


@entry("pending_clear", ("raw_events",), f"SELECT u.* FROM ({UPSERT}) u LEFT JOIN (SELECT profile_id, path, max(event_id) AS done FROM raw_events WHERE event_id % 3 <> 1 GROUP BY 1, 2) b ON b.profile_id = u.profile_id AND b.path = u.path WHERE b.done IS NULL OR u.source_generation > b.done")
def _(d):
    e = _events(d)
    return ledger.clear_pending(ledger.upsert_pending(e, e.limit(0)), e.filter("source_generation % 3 <> 1"))


@entry("preflight", ("scan", "ledger"), f"""SELECT profile_id, coalesce(f.n, 0) AS source_files, coalesce(d.c, 0) AS to_copy, coalesce(d.x, 0) AS to_delete, coalesce(d.x, 0) <= 100 AS within_budget FROM (SELECT profile_id, count(*) AS n FROM scan GROUP BY 1) f
 FULL JOIN (SELECT profile_id, count(*) FILTER (change = 'changed') AS c, count(*) FILTER (change = 'deleted') AS x FROM ({ACTIVE}) GROUP BY 1) d USING (profile_id)""")  # fmt: skip
def _(s, l):
    return ledger.preflight(s, ledger.diff_ledger(s, l), 100)


@entry("budget_gate", ("scan", "ledger"), f"SELECT * FROM ({ACTIVE}) d WHERE profile_id NOT IN (SELECT profile_id FROM ({ACTIVE}) WHERE change = 'deleted' GROUP BY 1 HAVING count(*) > 330)")
def _(s, l):
    return ledger.budgeted(ledger.diff_ledger(s, l), 330)


@entry("freeze_prune", ("ledger", "policies"), "SELECT l.profile_id, l.rel_path, p.hash AS policy_hash, 'pending' AS target_state FROM ledger l JOIN policies p ON p.profile_id = l.profile_id AND p.refresh_state = 'ready' AND p.refreshed_hash = p.hash WHERE l.state = 'suppressed' AND l.suppressed_policy_hash = p.hash")
def _(l, p):
    return ledger.freeze_prune(l, p)


@entry("prune_outcomes", ("targets", "outcomes", "recorded"), "SELECT profile_id, rel_path, target_state, request_id, changed FROM recorded")
def _(t, o, r):
    return ledger.record_outcomes(t, o)


@entry("prune_counts", ("recorded",), "SELECT profile_id, count(*) FILTER (changed AND target_state = 'deleted') AS deleted, count(*) FILTER (changed AND target_state = 'missing') AS missing, count(*) FILTER (changed AND target_state = 'failed') AS failed FROM recorded GROUP BY 1")
def _(r):
    return ledger.outcome_counts(r)


@entry("prune_complete", ("ledger", "recorded"), "SELECT l.* FROM ledger l WHERE NOT (l.state = 'suppressed' AND EXISTS (SELECT 1 FROM recorded r WHERE r.profile_id = l.profile_id AND r.rel_path = l.rel_path AND r.target_state IN ('deleted', 'missing')))")
def _(l, r):
    return ledger.complete_prune(l, r)


@entry("stale_requests", ("requests", "targets", "policies"), "SELECT r.profile_id, r.request_id, r.policy_hash, r.created_at, CASE WHEN r.state IN ('preview', 'authorized', 'running') AND r.policy_hash IS DISTINCT FROM p.hash THEN 'stale' ELSE r.state END AS state FROM requests r LEFT JOIN policies p ON p.profile_id = r.profile_id")
def _(r, t, p):
    return ledger.stale_requests(r, t, p)


@entry("newest_open_request", ("requests",), "SELECT * FROM requests WHERE state IN ('preview', 'authorized', 'running') QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY created_at DESC, request_id DESC) = 1")
def _(r):
    return ledger.newest_open(r)


@entry("target_batches", ("targets",), "SELECT *, CAST((row_number() OVER (PARTITION BY profile_id ORDER BY rel_path) - 1) // 512 AS BIGINT) AS batch FROM targets")
def _(t):
    return ledger.batched(t)


@entry("running_progress", ("recorded",), """SELECT profile_id, rel_path, CAST(c AS BIGINT) AS completed, CAST(count(*) OVER (PARTITION BY profile_id) - c AS BIGINT) AS remaining FROM (SELECT *, sum(CASE WHEN target_state IN ('deleted', 'missing') THEN 1 ELSE 0 END) OVER (PARTITION BY profile_id ORDER BY rel_path) AS c FROM recorded)""")
def _(r):
    return ledger.running_progress(r.withColumn("seq", F.col("rel_path"))).select("profile_id", "rel_path", "completed", "remaining")


@entry("target_folders", ("targets",), "SELECT DISTINCT profile_id, folder, CAST(len(string_split(folder, '/')) - 1 AS INTEGER) AS depth FROM (SELECT profile_id, split_part(rel_path, '/', 1) AS folder FROM targets UNION ALL SELECT profile_id, split_part(rel_path, '/', 1) || '/' || split_part(rel_path, '/', 2) FROM targets)")
def _(t):
    return ledger.deepest_first(ledger.target_folders(t))


@entry("folded_runs", ("runs",), """SELECT profile_id, max(target_generation) FILTER (status = 'succeeded') AS last_success_generation, min(completed_at) FILTER (status = 'succeeded') AS initialized_at, max(completed_at) FILTER (status = 'succeeded') AS last_success_at, max(target_generation) AS desired_generation,
 CASE max_by(status, seq) WHEN 'failed' THEN max_by(error_code, seq) WHEN 'running' THEN 'worker_interrupted' END AS last_error_code,
 CASE WHEN max_by(status, seq) <> 'succeeded' THEN 'error' WHEN count(*) FILTER (status = 'succeeded') = 0 THEN 'initializing' WHEN max(target_generation) > max(target_generation) FILTER (status = 'succeeded') THEN 'syncing' ELSE 'ready' END AS state FROM runs GROUP BY 1""")  # fmt: skip
def _(r):
    return ledger.fold_runs(r)


@entry("generation_debt", ("orders",), "SELECT o_orderkey, o_custkey % 4 > 0 AND (o_orderkey % 3 = 0 OR o_custkey % 4 > o_orderkey % 3) AS debt FROM orders")
def _(o):
    return o.select("o_orderkey", ledger.has_debt(F.col("o_custkey") % 4, F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 3)).alias("debt"))


@entry("checked_targets", ("targets",), "SELECT rel_path AS value FROM targets")
def _(t):
    return publish.target_list(t)


@entry("expired_generations", ("runs",), "SELECT profile_id AS root, run_id AS name, started_at AS mtime, seq % 50 = 0 AS current, seq % 51 = 0 AS in_flight FROM runs WHERE seq % 50 <> 0 AND seq % 51 <> 0 QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY started_at DESC, run_id DESC) > 1")
def _(r):
    g = r.select(F.col("profile_id").alias("root"), F.col("run_id").alias("name"), F.col("started_at").alias("mtime"), (F.col("seq") % 50 == 0).alias("current"), (F.col("seq") % 51 == 0).alias("in_flight"))
    return publish.expired_generations(g)


CELL = lambda c: f"CASE WHEN {c} IS NULL THEN 'n' ELSE 'v' || length(CAST({c} AS VARCHAR)) || ':' || {c} END"
PRINT = f""", h AS (SELECT sha256({" || '|' || ".join(map(CELL, ("profile_id", "rel_path", "size", "mod_time")))}) AS h FROM scan),
p AS (SELECT CAST('0x' || substr(h, 1, 12) AS BIGINT) AS p1, CAST('0x' || substr(h, 13, 12) AS BIGINT) AS p13, CAST('0x' || substr(h, 25, 12) AS BIGINT) AS p25, CAST('0x' || substr(h, 37, 12) AS BIGINT) AS p37 FROM h),
b AS (SELECT p1 % 4096 AS bucket, count(*) AS n, sum(p1) AS s1, sum(p13) AS s13, sum(p25) AS s25, sum(p37) AS s37, bit_xor(p1) AS x1, bit_xor(p13) AS x13, bit_xor(p25) AS x25, bit_xor(p37) AS x37 FROM p GROUP BY 1)
SELECT sha256(string_agg(sha256(concat_ws('|', bucket, n, s1, s13, s25, s37, x1, x13, x25, x37)), '' ORDER BY bucket)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n_rows FROM b"""


@entry("scan_fingerprint", ("scan",), PRINT)
def _(s):
    return fingerprint.fingerprint(s, ["profile_id", "rel_path", "size", "mod_time"])


# ---- telemetry --------------------------------------------------------------------

@entry("progress_frames", ("events",), """SELECT 'r' || user_id AS run_id, event_id AS seq, event_id * 10 AS bytes, CASE WHEN event_id % 2 = 0 THEN event_id % 5 END AS checks, CASE WHEN event_id % 3 = 0 THEN 'd' || event_id END AS item, CASE WHEN event_id % 3 = 0 THEN CAST(7 AS BIGINT) END AS item_bytes, CASE WHEN event_id % 3 = 0 THEN CAST(1 AS BIGINT) END AS active_transfers FROM events WHERE event_id % 4 <> 0""")
def _(e):
    n = F.col("event_id").cast("string")
    stats = F.concat(F.lit('{"level":"notice","msg":"stats","stats":{"bytes":'), n, F.lit("0"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(',"checks":'), (F.col("event_id") % 5).cast("string"))).otherwise(F.lit("")),
                     F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(',"currentTransfers":[{"name":"d'), n, F.lit('","bytes":7,"size":9}]'))).otherwise(F.lit("")), F.lit("}}"))
    lines = e.select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("run_id"), F.col("event_id").alias("seq"), "ts", F.when(F.col("event_id") % 4 == 0, F.when(F.col("event_id") % 8 == 0, "no json").otherwise('{"msg":"x"}')).otherwise(stats).alias("line"))
    return telemetry.progress_frames(lines).select("run_id", "seq", "bytes", "checks", "item", "item_bytes", "active_transfers")


BY_RUN = "OVER (PARTITION BY run_id ORDER BY seq)"


@entry("transfer_rates", ("frames",), f"SELECT run_id, seq, CASE WHEN dt > 0 AND d >= 0 THEN round(d * 1e6 / dt, 6) END AS bytes_rate FROM (SELECT run_id, seq, epoch_us(ts) - lag(epoch_us(ts)) {BY_RUN} AS dt, bytes - lag(bytes) {BY_RUN} AS d FROM frames WHERE phase = 'uploading')")
def _(f):
    return telemetry.rates(f.filter("phase = 'uploading'"), ("bytes",)).select("run_id", "seq", F.round("bytes_rate", 6).alias("bytes_rate"))


MEASURED = f"""SELECT run_id, seq, ts, coalesce(CASE WHEN first THEN coalesce(bytes > 0, false) OR coalesce(checks > 0, false) OR coalesce(transfers > 0, false) OR coalesce(item <> '', false)
 ELSE coalesce(bytes > pb, false) OR coalesce(checks > pc, false) OR coalesce(transfers > pt, false) OR (item IS NOT NULL AND item IS DISTINCT FROM pi) OR coalesce(item_bytes > pib, false) END, false) AS measurable
 FROM (SELECT *, lag(seq) {BY_RUN} IS NULL AS first, lag(bytes) {BY_RUN} AS pb, lag(checks) {BY_RUN} AS pc, lag(transfers) {BY_RUN} AS pt, lag(item) {BY_RUN} AS pi, lag(item_bytes) {BY_RUN} AS pib FROM frames)"""


@entry("measurable_progress", ("frames",), f"SELECT run_id, seq, measurable FROM ({MEASURED})")
def _(f):
    return telemetry.measurable(f).select("run_id", "seq", "measurable")


@entry("stalled_runs", ("frames",), f"SELECT run_id, seq, last_progress, coalesce(epoch_us(ts) - epoch_us(last_progress) >= 1800000000, false) AS possible_stall FROM (SELECT *, max(CASE WHEN measurable THEN seq END) {BY_RUN} AS k, last_value(CASE WHEN measurable THEN ts END IGNORE NULLS) {BY_RUN} AS last_progress FROM ({MEASURED}))")
def _(f):
    return telemetry.stalls(f).select("run_id", "seq", "last_progress", "possible_stall")


@entry("upload_starts", ("frames",), "SELECT run_id, min(ts) FILTER (phase = 'uploading') AS upload_started_at FROM frames GROUP BY 1")
def _(f):
    return telemetry.upload_start(f)


@entry("run_heartbeats", ("frames",), f"SELECT run_id, max(ts) AS last_heartbeat_at, max(ts) FILTER (measurable) AS last_progress_at FROM ({MEASURED}) GROUP BY 1")
def _(f):
    return telemetry.heartbeats(telemetry.measurable(f))


@entry("newest_frames", ("frames",), "SELECT run_id, max(seq) AS seq, max_by(struct_pack(b := bytes), seq).b AS bytes, max_by(phase, seq) AS phase FROM frames GROUP BY 1")
def _(f):
    return telemetry.newest_status(f).select("run_id", "seq", "bytes", "phase")


@entry("newest_runs", ("runs",), "SELECT profile_id, run_id, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY started_at DESC, run_id DESC) AS INTEGER) AS rank FROM runs QUALIFY rank <= 20")
def _(r):
    return telemetry.newest_runs(r).select("profile_id", "run_id", "rank")


@entry("run_retries", ("runs",), """SELECT profile_id, seq, CAST(CASE WHEN status <> 'failed' THEN NULL WHEN classification = 'retryable' THEN least(pow(2, least(greatest(c, 1) - 1, 10)), 1800) WHEN classification = 'retryable_limited' AND l <= 3 THEN CASE l WHEN 1 THEN 60 WHEN 2 THEN 300 ELSE 900 END END AS BIGINT) AS delay_seconds,
 CASE WHEN status <> 'failed' THEN NULL WHEN classification = 'retryable_limited' AND l > 3 THEN 'terminal' ELSE classification END AS final_classification FROM (
 SELECT *, sum(CASE WHEN status = 'failed' AND classification = 'retryable' THEN 1 ELSE 0 END) OVER (PARTITION BY profile_id, g ORDER BY seq) AS c, sum(CASE WHEN status = 'failed' AND classification = 'retryable_limited' THEN 1 ELSE 0 END) OVER (PARTITION BY profile_id, g ORDER BY seq) AS l
 FROM (SELECT *, sum(CASE WHEN status = 'succeeded' THEN 1 ELSE 0 END) OVER (PARTITION BY profile_id ORDER BY seq) AS g FROM runs))""")  # fmt: skip
def _(r):
    return telemetry.retries(r).select("profile_id", "seq", "delay_seconds", "final_classification")


@entry("error_classes", ("orders",), """SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'retryable' WHEN o_custkey % 5 = 1 THEN 'terminal' WHEN o_orderkey % 9 = 5 THEN 'retryable' WHEN o_orderkey % 9 IN (2, 6, 7) THEN 'terminal' WHEN o_orderkey % 9 = 8 THEN 'terminal' ELSE 'retryable_limited' END AS class FROM orders""")
def _(o):
    code = F.when(F.col("o_custkey") % 5 == 0, "source_unstable").when(F.col("o_custkey") % 5 == 1, "delete_budget_exceeded").otherwise("exit")
    status = F.when(F.col("o_orderkey") % 9 != 8, F.col("o_orderkey") % 9)
    return o.select("o_orderkey", telemetry.error_class(code, status).alias("class"))


@entry("fleet_health", ("customer",), """SELECT c_custkey, CASE WHEN k % 13 = 0 THEN 'TOMBSTONED' WHEN k % 12 = 0 THEN 'DELETING' WHEN k % 11 = 0 THEN 'DISABLED' WHEN k % 10 = 0 THEN 'STALE' WHEN k % 9 = 0 THEN 'INITIALIZING' WHEN k % 9 = 1 THEN 'SYNCING' WHEN k % 9 = 2 THEN 'BROKEN'
 WHEN k % 8 = 0 THEN 'RECONCILE_REQUESTED' WHEN k % 7 = 0 THEN 'STALE' WHEN k % 6 = 0 THEN 'BROKEN' WHEN k % 5 = 0 THEN 'QUOTA_FULL' WHEN k % 5 = 1 THEN 'QUOTA_LOW' ELSE 'HEALTHY' END AS health FROM (SELECT c_custkey, c_custkey AS k FROM customer)""")  # fmt: skip
def _(c):
    k = F.col("c_custkey")
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    fleet = c.select(
        "c_custkey", (k % 13 == 0).alias("tombstoned"), F.when(k % 12 == 0, now).alias("deletion_requested_at"), (k % 11 != 0).alias("enabled"), (k % 10 != 0).alias("has_runtime"),
        F.when(k % 9 == 0, "initializing").when(k % 9 == 1, "syncing").when(k % 9 == 2, "error").otherwise("ready").alias("sync_state"), (k % 8 == 0).alias("reconcile_requested"),
        F.when(k % 7 == 0, F.lit("2024-01-01 00:00:00").cast("timestamp")).otherwise(now).alias("last_reconcile_success"), F.when(k % 6 == 0, "failed").otherwise("").alias("last_error"), F.when(k % 5 == 0, 0).when(k % 5 == 1, 10).otherwise(1000).alias("free_bytes"),
    )
    return telemetry.health(fleet, now, 100).select("c_custkey", "health")


@entry("fleet_status", ("requests", "runs", "policies", "ledger"), """SELECT p.profile_id, r.run_id, CASE WHEN p.profile_id = 'p1' THEN 'live' ELSE r.phase END AS phase, p.hash AS policy_hash, q.request_id, c.total FROM policies p
 LEFT JOIN (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY started_at DESC, run_id DESC) = 1) r ON r.profile_id = p.profile_id
 LEFT JOIN (SELECT * FROM requests WHERE state IN ('preview', 'authorized', 'running') QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY created_at DESC, request_id DESC) = 1) q ON q.profile_id = p.profile_id
 LEFT JOIN (SELECT profile_id, count(*) AS total FROM ledger GROUP BY 1) c ON c.profile_id = p.profile_id""")  # fmt: skip
def _(q, r, p, l):
    profiles = p.select("profile_id", F.lit(False).alias("tombstoned"))
    sync = p.select("profile_id", F.when(F.col("profile_id") == "p1", "live").alias("phase"))
    return telemetry.fleet_status(profiles, sync, r, p, q, l).select("profile_id", "run_id", "phase", "policy_hash", "request_id", "total")


@entry("log_summaries", ("events",), "SELECT 'r' || user_id AS run_id, coalesce(max_by(event_id % 90, event_id) FILTER (event_id % 2 = 0), 0) AS transferred, coalesce(max_by(-(event_id % 7), event_id) FILTER (event_id % 2 = 1), 0) AS deleted FROM events GROUP BY 1")
def _(e):
    n = F.col("event_id")
    line = F.when(n % 2 == 0, F.concat(F.lit("Transferred:   "), (n % 90).cast("string"), F.lit(" / 9, 100%"))).otherwise(F.concat(F.lit("Deleted: "), (-(n % 7)).cast("string"), F.lit(" (files)")))
    return telemetry.log_summary(e.select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("run_id"), n.alias("line_no"), line.alias("line")))


FOLD = """, f AS (SELECT run_id, seq, epoch_us(ts) AS t, phase, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS k FROM frames),
kept AS (SELECT run_id, seq, k, phase, t AS at, true AS keep FROM f WHERE k = 1
 UNION ALL SELECT n.run_id, n.seq, n.k, n.phase, CASE WHEN due THEN n.t ELSE n.at END, due FROM (SELECT f.*, p.at, f.phase IS DISTINCT FROM p.phase OR f.t - p.at >= 3600000000 AS due FROM kept p JOIN f ON f.run_id = p.run_id AND f.k = p.k + 1) n)
"""


@entry("run_checkpoints", ("frames",), FOLD + "SELECT run_id, seq FROM kept WHERE keep", recursive=True)
def _(f):
    return telemetry.checkpoints(f).select("run_id", "seq")


@entry("live_rates", ("frames",), FOLD + """SELECT k.run_id, k.seq, k.keep AS checkpoint, round(CASE WHEN f.bytes >= f.b AND f.t > f.p THEN (f.bytes - f.b) * 1e6 / (f.t - f.p) END, 6) AS bytes_rate
 FROM kept k JOIN (SELECT *, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER w AS p, lag(bytes) OVER w AS b FROM frames WINDOW w AS (PARTITION BY run_id ORDER BY seq)) f ON f.run_id = k.run_id AND f.seq = k.seq""", recursive=True)  # fmt: skip
def _(f):
    return live.live_rates(f).select("run_id", "seq", "checkpoint", F.round("bytes_rate", 6).alias("bytes_rate"))


KIND = "CASE event_id % 12 WHEN 1 THEN 'modify' WHEN 2 THEN 'modify' WHEN 3 THEN 'rename' WHEN 4 THEN 'modify' WHEN 9 THEN 'rename' WHEN 11 THEN 'rename' ELSE 'other' END"


@entry("event_kinds", ("raw_events",), f"SELECT event_id, profile_id, path, {KIND} AS event_kind FROM raw_events WHERE event_id % 12 <> 5")
def _(e):
    return stream.classified(e).select("event_id", "profile_id", "path", "event_kind")


@entry("destructive_pending", ("raw_events",), f"SELECT profile_id, bool_or({KIND} NOT IN ('create', 'modify')) AS destructive FROM raw_events WHERE event_id % 12 <> 5 GROUP BY 1")
def _(e):
    return stream.has_destructive(stream.classified(e))


# times run 400 times as fast, so that batches and passes overlap
SETTLED = f""", e AS (SELECT profile_id, path, {KIND} AS event_kind, us // 1000 AS ms, row_number() OVER (PARTITION BY profile_id ORDER BY us, path) AS seq
 FROM (SELECT *, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 400 AS us FROM raw_events) WHERE event_id % 12 <> 5),
steps AS (
 SELECT profile_id, seq, ms, CASE WHEN safe THEN ms END AS f1, CASE WHEN safe THEN ms END AS f2, CAST(0 AS BIGINT) AS batch, CASE WHEN NOT safe THEN ms + 10000 END AS soon, CASE WHEN NOT safe THEN ms + 60000 END AS late,
  CAST(NULL AS BIGINT) AS batch_done, CAST(NULL AS BIGINT) AS batch_at, CAST(NULL AS BIGINT) AS full_at FROM (SELECT *, event_kind IN ('create', 'modify') AS safe FROM e) WHERE seq = 1
 UNION ALL
 SELECT profile_id, seq, ms, CASE WHEN safe THEN CASE WHEN f1 IS NULL OR b THEN ms ELSE f1 END END, CASE WHEN safe THEN ms END, batch + CASE WHEN f1 IS NULL OR b THEN 1 ELSE 0 END,
  CASE WHEN NOT safe THEN ms + 10000 WHEN NOT u THEN soon END, CASE WHEN NOT safe THEN coalesce(CASE WHEN NOT u THEN late END, ms + 60000) WHEN NOT u THEN late END,
  CASE WHEN b THEN batch END, CASE WHEN b THEN least(f2 + 3000, f1 + 30000) END, CASE WHEN u THEN least(soon, late) END
 FROM (SELECT n.profile_id, n.seq, n.ms, p.f1, p.f2, p.batch, p.soon, p.late, n.event_kind IN ('create', 'modify') AS safe, coalesce(n.ms >= least(p.f2 + 3000, p.f1 + 30000), false) AS b, coalesce(n.ms >= least(p.soon, p.late), false) AS u
  FROM steps p JOIN e n ON n.profile_id = p.profile_id AND n.seq = p.seq + 1))
SELECT profile_id, 'full' AS action, NULL AS path, NULL AS event_kind, NULL AS first_ms, NULL AS last_ms, seq - 1 AS source_generation, full_at AS at_ms FROM steps WHERE full_at IS NOT NULL
UNION ALL SELECT e.profile_id, 'upsert', e.path, max_by(e.event_kind, e.seq), min(e.ms), max(e.ms), max(e.seq), d.batch_at FROM steps s JOIN e ON e.profile_id = s.profile_id AND e.seq = s.seq AND s.f1 IS NOT NULL
 JOIN steps d ON d.profile_id = s.profile_id AND d.batch_done = s.batch GROUP BY e.profile_id, e.path, d.batch_done, d.batch_at"""


@entry("settled_batches", ("raw_events",), SETTLED, recursive=True)
def _(e):
    since = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp"), F.col("ts").cast("timestamp"))
    rows = stream.classified(e).select("profile_id", F.timestamp_micros(F.floor(since / 400).cast("long")).alias("ts"), "path", "event_kind", F.lit(100_000).cast("long").alias("ledger_rows"), F.lit(True).alias("has_success"))
    ms = lambda c: F.unix_millis(c)
    return stream.settled_batches(rows).select("profile_id", "action", "path", "event_kind", ms("first_seen").alias("first_ms"), ms("last_seen").alias("last_ms"), "source_generation", ms("at").alias("at_ms"))


PROMOTED = """, e AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY ms, path, k) AS seq, ms // 60000 AS slot FROM bursts),
last AS (SELECT profile_id, max(slot) AS slot FROM e GROUP BY 1),
b AS (SELECT e.profile_id, e.slot, any_value(p) AS p, min(ms) AS f, max(seq) AS gen, bool_or(seq = 1 AND p % 3 = 0) AS boot, max(ms) FILTER (NOT (seq = 1 AND p % 3 = 0)) AS l, count(DISTINCT path) FILTER (NOT (seq = 1 AND p % 3 = 0)) AS n
 FROM e JOIN last ON last.profile_id = e.profile_id AND e.slot < last.slot GROUP BY ALL),
d AS (SELECT *, coalesce(n > 500 OR n > 0.05 * CASE WHEN p % 2 = 0 THEN 30 ELSE 1000 END, false) AS backlog FROM b)
SELECT profile_id, 'full' AS action, NULL AS path, NULL AS event_kind, gen AS source_generation, CASE WHEN backlog THEN l + 13000 ELSE f + 10000 END AS at_ms FROM d WHERE boot OR backlog
UNION ALL SELECT e.profile_id, 'upsert', e.path, max_by(e.event_kind, e.seq), max(e.seq), any_value(d.l) + 3000 FROM d JOIN e ON e.profile_id = d.profile_id AND e.slot = d.slot AND NOT (e.seq = 1 AND e.p % 3 = 0) WHERE NOT d.backlog GROUP BY e.profile_id, e.slot, e.path"""


@entry("promoted_batches", ("bursts",), PROMOTED)
def _(e):
    """Profiles whose first event comes before any success, and batches that are a backlog against a small ledger."""
    rows = e.select("profile_id", F.timestamp_millis(F.col("ms").cast("long")).alias("ts"), "path", "event_kind", F.when(F.col("p") % 2 == 0, 30).otherwise(1000).cast("long").alias("ledger_rows"), (F.col("p") % 3 != 0).alias("has_success"), F.col("k").cast("long").alias("k"))
    return stream.settled_batches(rows, tie="k").select("profile_id", "action", "path", "event_kind", "source_generation", F.unix_millis("at").alias("at_ms"))


# ---- sources and publication ------------------------------------------------------

def scratch(spark: SparkSession) -> str:
    """A folder of its own below what driver and executors share: the checkpoint folder, or one of this machine in a session of one process."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base and not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster") and not base:
        raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
    base = base or tempfile.mkdtemp(prefix="corpusgraph-")
    return f"{base.rstrip('/')}/corpusgraph-{uuid.uuid4().hex}"


@entry("remote_inventory", ("remote",), "SELECT rel_path AS path, CAST(size AS BIGINT) AS size, false AS is_dir FROM remote")
def _(r):
    """Listings as JSON lines, some with Name only, read back through the source."""
    folder = scratch(r.sparkSession)
    odd = F.col("size") % 2 == 1
    r.select(F.when(~odd, F.col("rel_path")).alias("Path"), F.when(odd, F.col("rel_path")).otherwise("n").alias("Name"), F.col("size").alias("Size"), F.when(odd, False).alias("IsDir")).write.json(folder)
    return logs.remote_inventory(r.sparkSession, folder)


@entry("path_list", ("odd_paths",), "SELECT trim(replace(path, chr(92), '/'), ' ') AS path FROM odd_paths WHERE doc_id % 9 NOT IN (0, 1, 2, 4, 5) UNION ALL SELECT CASE doc_id % 9 WHEN 0 THEN 'a/b' WHEN 2 THEN 'b' ELSE 'a' END FROM odd_paths WHERE doc_id % 9 IN (0, 2, 5)")
def _(p):
    folder = scratch(p.sparkSession)
    p.select(F.concat(F.lit("  "), "path", F.lit("\r")).alias("value")).write.text(folder)
    return logs.path_list(p.sparkSession, folder)


@entry("progress_log", ("events",), "SELECT event_id, CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS seq, event_id * 10 AS bytes FROM events")
def _(e):
    """Log files that follow one another: the place of a frame is that of its file, then that in the file."""
    folder = scratch(e.sparkSession)
    line = F.format_string('{"msg":"%d","stats":{"bytes":%d}}', "event_id", F.col("event_id") * 10)
    e.orderBy("event_id").select(line.alias("value")).write.text(folder)
    log = numbered(logs.progress_log(e.sparkSession, folder), (), ("run_id", "seq"), "place")
    frames = telemetry.progress_frames(log.withColumn("seq", (F.col("place") - 1).cast("long")))
    return frames.join(log.select((F.col("place") - 1).cast("long").alias("seq"), F.get_json_object("line", "$.msg").cast("long").alias("event_id")), "seq").select("event_id", "seq", "bytes")


@entry("change_feed", ("raw_events",), f"SELECT profile_id, path, CASE WHEN event_id % 12 = 3 THEN 'other' ELSE {KIND} END AS event_kind FROM raw_events WHERE event_id % 12 <> 5")
def _(e):
    """Events as JSON files whose flags are text, some no number."""
    folder = scratch(e.sparkSession)
    flags = F.when(F.col("event_id") % 12 == 3, "none").otherwise(F.col("flags").cast("string"))
    e.select("ts", "profile_id", "path", flags.alias("flags")).write.json(folder)
    return stream.classified(logs.static_events(e.sparkSession, folder)).select("profile_id", "path", "event_kind")


PAIRS = "SELECT profile_id || '/' || path AS path, CASE WHEN event_id % 12 = 3 THEN 0 ELSE flags END AS flags FROM raw_events"


def _pair_files(e: DataFrame) -> str:
    """Events as watchers write them: path and flags, a NUL after each; some flags are no number."""
    folder = scratch(e.sparkSession)
    flags = F.when(F.col("event_id") % 12 == 3, "none").otherwise(F.col("flags").cast("string"))
    e.select(F.concat("profile_id", F.lit("/"), "path", F.lit("\x00"), flags).alias("value")).write.option("lineSep", "\x00").text(folder)
    return folder


@entry("change_pairs", ("raw_events",), PAIRS)
def _(e):
    return feed.pair_events(e.sparkSession, _pair_files(e)).select("path", "flags")


@entry("change_stream", ("raw_events",), PAIRS)
def _(e):
    """The same as a stream that stops after half of the feed, and goes on from its offset when the rest has come."""
    spark, out, marks = e.sparkSession, scratch(e.sparkSession), scratch(e.sparkSession)
    half = F.col("event_id") % 2 == 0
    folder = _pair_files(e.filter(half))
    for more in (None, e.filter(~half)):
        if more is not None:
            flags = F.when(F.col("event_id") % 12 == 3, "none").otherwise(F.col("flags").cast("string"))
            more.select(F.concat("profile_id", F.lit("/"), "path", F.lit("\x00"), flags).alias("value")).write.mode("append").option("lineSep", "\x00").text(folder)
        feed.pair_events(spark, folder, streaming=True).select("path", "flags").writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("path string, flags long").parquet(out)


@entry("pending_log", ("pending",), """SELECT profile_id, rel_path AS path, CASE WHEN g % 2 = 0 THEN 'modify' ELSE event_kind END AS event_kind, first_seen, CASE WHEN g % 2 = 0 THEN last_seen + INTERVAL 1 DAY ELSE last_seen END AS last_seen,
 CASE WHEN g % 2 = 0 THEN g + 1000 ELSE g END AS source_generation FROM (SELECT *, source_generation AS g FROM pending) WHERE g % 2 = 0 OR g % 3 <> 0""")
def _(p):
    """Three batches: all events, newer ones of every second path, and what a worker of the first batch clears; one batch comes twice."""
    log = pending.PendingLog(p.sparkSession, scratch(p.sparkSession))
    rows = p.select("profile_id", F.col("rel_path").alias("path"), "event_kind", F.col("first_seen").cast("timestamp"), F.col("last_seen").cast("timestamp"), F.col("source_generation").cast("long"))
    g = F.col("source_generation")
    day = F.expr("INTERVAL 1 DAY")
    newer = rows.filter(g % 2 == 0).withColumns({"event_kind": F.lit("modify"), "first_seen": F.col("last_seen") + day, "last_seen": F.col("last_seen") + day, "source_generation": g + 1000})
    log.append(0, rows)
    log.append(1, newer)
    log.append(1, newer)
    log.append(2, cleared=rows.filter(g % 3 == 0))
    return log.read().select("profile_id", "path", "event_kind", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "source_generation")


@entry("coarse_scan", ("scan",), "SELECT rel_path AS path, size, CAST(mod_time AS BIGINT) AS mtime_s FROM scan")
def _(s):
    return corpus_source.coarse(s.select(F.col("rel_path").alias("path"), "size", (F.col("mod_time") * 1_000_000_000 + F.col("size") % 1_000_000_000).alias("mtime_ns")))


@entry("scan_counts", ("corpus",), f"SELECT count(*) AS visited, count(*) FILTER (NOT {IGNORED} AND doc_id % 21 <> 0) AS eligible FROM corpus")
def _(d):
    """What an observation counts while the scan passes by."""
    e = d.select("path", F.lit(1).alias("size"), (F.col("doc_id") % 21 == 0).alias("is_symlink"), F.lit(True).alias("is_regular"))
    v = policy.ignored(e.select("path", F.lit(False).alias("is_dir")), _rules(d))
    seen = Observation("scan_counts")
    corpus_source.observed(policy.eligibility(e, v), seen).write.format("noop").mode("overwrite").save()
    return d.sparkSession.createDataFrame([(seen.get["visited"], seen.get["eligible"])], "visited long, eligible long")


@entry("policy_files", ("corpus",), "SELECT 'src' || k || '/' || l || '/.gitignore' AS path, CAST(row_number() OVER (ORDER BY k, l) - 1 AS INTEGER) AS place FROM (SELECT DISTINCT regexp_extract(path, '^src([0-9]+)', 1) AS k, split_part(path, '/', 2) AS l FROM corpus) WHERE k <> '1'")
def _(d):
    """Ignore files of every folder, those below an ignored folder left out, parents first."""
    below = d.select(P.dirname("path").alias("folder")).filter(F.col("folder").rlike("^[^/]*/[^/]*$")).distinct().select(F.concat("folder", F.lit("/.gitignore")).alias("path"), F.lit("*.tmp\n").alias("content"))
    top = d.sparkSession.createDataFrame([(".gitignore", "/src1/\n")], "path string, content string")
    taken = policy.taken_policy(below.unionByName(top)).filter("scope <> ''").withColumn("depth", P.depth("path"))
    return numbered(taken, (), ("depth", "path"), "n").select("path", (F.col("n") - 1).cast("int").alias("place"))


@entry("policy_rules", ("part",), "SELECT 'f' || p_partkey % 5 AS source, p_partkey, CASE p_partkey % 4 WHEN 1 THEN true ELSE false END AS negated, p_partkey % 4 = 2 AS dir_only, p_partkey % 4 = 3 AS bad FROM part")
def _(p):
    """Rules and warnings of ignore lines: a quarter each plain, negated, folders only, broken."""
    k = F.col("p_partkey") % 4
    line = F.concat(F.when(k == 1, "!").otherwise(""), F.when(k == 3, "[").otherwise(""), F.lit("n"), F.col("p_partkey").cast("string"), F.when(k == 2, "/").otherwise(""))
    # ignore files of up to a hundred lines, of five sources
    files = p.groupBy((F.col("p_partkey") % 5).alias("f"), F.floor(F.col("p_partkey") / 500).alias("part")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("content"))
    rules = policy.compiled(files.select(F.concat(F.lit("f"), F.col("f").cast("string")).alias("path"), F.lit("").alias("scope"), "content"))
    known = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return rules.select("source", F.regexp_replace("pattern", r"\D", "").cast("long").alias("p_partkey"), known("negated"), known("dir_only"), F.col("warning").isNotNull().alias("bad"))


@on_corpus("published_links", "SELECT source_path, CAST(ordinal AS BIGINT) AS ordinal, raw_target, resolution_status FROM edges")
def _(c):
    """LINKS of a generation that was written, verified and read back."""
    spark = c.links.sparkSession
    root = scratch(spark)
    publish.publish(c.artifacts(), root, "g1")
    if not publish.verify_generation(spark, root).isEmpty():
        raise RuntimeError("what was published can't be verified")
    return publish.read_generation(spark, root, "LINKS").select("source_path", "ordinal", "raw_target", "resolution_status")


@on_corpus("published_inventory", """SELECT 'FILE_INDEX' AS artifact, count(*) AS records FROM files UNION ALL SELECT 'LINKS', count(*) FROM edges UNION ALL SELECT 'ORPHANS', count(*) FROM orphan UNION ALL SELECT 'BROKEN_LINKS', count(*) FROM edges WHERE resolution_status <> 'resolved'
 UNION ALL SELECT 'TAG_INDEX', count(DISTINCT tag) FROM tags UNION ALL SELECT 'WARNINGS', count(*) FROM warned UNION ALL SELECT 'FRONTMATTER_STATS', 4 UNION ALL SELECT 'README.md', 11 UNION ALL SELECT 'HEALTH.md', 8""")
def _(c):
    """Records of each artifact as the manifest has them, all equal to what a second inventory finds."""
    spark = c.links.sparkSession
    root, counts = scratch(spark), c.counts()
    said = publish.publish(c.artifacts(), root, "g1", {"README.md": publish.readme_summary(counts, "g1"), "HEALTH.md": publish.health_summary(counts, "g1")})["artifacts"]
    found = publish.inventory(spark, f"{root}/generations/g1", sorted(said))
    want = spark.createDataFrame([(n, a["bytes"], a["digest"]) for n, a in said.items()], "artifact string, bytes long, digest string")
    return found.join(want, ["artifact", "bytes", "digest"]).select("artifact", "records")


@on_corpus("orphan_page", """SELECT '# Orphans' || chr(10) || chr(10) || 'Generation: `g1`' || chr(10) || chr(10) || 'Summary: ' || sum(h) || ' hard orphans, ' || sum(b) || ' notes without backlinks, ' || sum(o) || ' outbound-only notes.' || chr(10)
 || chr(10) || '## Hard orphans by top folder' || chr(10) || chr(10) || coalesce(string_agg(CASE WHEN h > 0 THEN '- "' || f || '": ' || h || chr(10) END, '' ORDER BY f), '')
 || chr(10) || '## Notes without backlinks by top folder' || chr(10) || chr(10) || coalesce(string_agg(CASE WHEN b > 0 THEN '- "' || f || '": ' || b || chr(10) END, '' ORDER BY f), '')
 || chr(10) || '## Outbound-only notes by top folder' || chr(10) || chr(10) || coalesce(string_agg(CASE WHEN o > 0 THEN '- "' || f || '": ' || o || chr(10) END, '' ORDER BY f), '') AS value
 FROM (SELECT split_part(path, '/', 1) AS f, count(*) FILTER (hard_orphan) AS h, count(*) FILTER (no_backlink) AS b, count(*) FILTER (outbound_only) AS o FROM orphan GROUP BY 1)""")  # fmt: skip
def _(c):
    return publish.orphan_summary(graph.orphan_folders(c.orphans), "g1")


def _edited(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A scan of the corpus as it was and as it is: notes added, edited, renamed, and some gone that others ask for."""
    now = c.select("doc_id", "path", "content", F.coalesce(F.length("content"), F.lit(-1)).cast("long").alias("size"), F.lit(2).cast("long").alias("mtime_ns"))
    edited, renamed = F.col("doc_id") % 13 == 0, F.col("doc_id") % 29 == 0
    then = now.filter(F.col("doc_id") % 17 != 0).withColumns({
        "content": F.when(edited, F.concat("content", F.lit(" [[note1]] [[twin2]] #Old"))).otherwise(F.col("content")),
        "path": F.when(renamed, F.concat(F.lit("old/"), "path")).otherwise(F.col("path")),
        "mtime_ns": F.when(edited, 1).otherwise(F.col("mtime_ns")),
    })
    gone = now.filter("doc_id < 5").withColumns({"path": F.concat(F.lit("gone/missing"), F.col("doc_id").cast("string"), F.lit(".md")), "content": F.lit("[[note3]]")})
    return then.unionByName(gone).drop("doc_id"), now.drop("doc_id")


def _rebuilt(c: DataFrame) -> plan.Compiled:
    then, now = _edited(c)
    return incremental.rebuild(plan.compile_corpus(then.select("path", "content"), keep=True), then, now)


ENTRIES["incremental_links"] = Entry(lambda spark, sf_dir: _linked(_rebuilt(frame(spark, sf_dir, "corpus"))), ENTRIES["corpus_links"].sql)
ENTRIES["incremental_degrees"] = Entry(lambda spark, sf_dir: _rebuilt(frame(spark, sf_dir, "corpus")).degrees, ENTRIES["corpus_degrees"].sql)


@entry("stable_scan", ("scan",), "SELECT profile_id, rel_path AS path, CASE WHEN size % 3 = 0 THEN size + 1 ELSE size END AS size FROM scan")
def _(s):
    """A scan of a table that changes while it is read first, and stays as it is the second time."""
    scan = s.select("profile_id", F.col("rel_path").alias("path"), "size", F.col("mod_time").alias("mtime_ns"))
    folders = [scratch(s.sparkSession), scratch(s.sparkSession)]
    scan.write.parquet(folders[0])
    scan.withColumn("size", F.when(F.col("size") % 3 == 0, F.col("size") + 1).otherwise(F.col("size"))).write.parquet(folders[1])
    seen = iter([folders[0], folders[1], folders[1], folders[1]])
    return fingerprint.stable_scan(lambda: s.sparkSession.read.schema(scan.schema).parquet(next(seen)), lambda d: d.select("profile_id", "path", "size"))


@entry("snapshot_digest", ("scan",), """, one AS (SELECT rel_path AS path, min(size) AS size, min(mod_time) AS t, min(hash) AS h FROM scan GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY path) - 1 AS n FROM one),
b AS (SELECT n // 512 AS b, sha256(string_agg(path || chr(0) || size || chr(0) || t || chr(0) || h || chr(0), '' ORDER BY n)) AS d FROM n GROUP BY 1),
c AS (SELECT b // 512 AS c, sha256(string_agg(d, '' ORDER BY b)) AS d FROM b GROUP BY 1)
SELECT sha256('source-snapshot-v1' || chr(0) || sha256('x') || chr(0) || sha256('y') || chr(0) || CASE WHEN (SELECT count(*) FROM b) > 1 THEN (SELECT min(d) FROM c) ELSE (SELECT min(d) FROM b) END || chr(0)) AS digest""")  # fmt: skip
def _(s):
    rows = s.groupBy(F.col("rel_path").alias("path")).agg(F.min("size").alias("size"), F.min("mod_time").alias("mtime_ns"), F.min("hash").alias("hash"))
    of = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return s.sparkSession.createDataFrame([(fingerprint.snapshot_digest(rows, of("x"), of("y")),)], "digest string")


@on_corpus("broken_page", """, page AS (SELECT row_number() OVER (ORDER BY status, target, folder) + 4 AS place, '- status="' || status || '" source_folder="' || folder || '" target=' || to_json(target) || ' count=' || n AS value
  FROM (SELECT resolution_status AS status, raw_target AS target, split_part(source_path, '/', 1) AS folder, count(*) AS n FROM edges WHERE resolution_status <> 'resolved' GROUP BY ALL))
SELECT place, CAST(value AS VARCHAR) AS value FROM page UNION ALL SELECT * FROM (VALUES (1, '# Broken links'), (2, ''), (3, 'Generation: `g1`'), (4, ''))""")
def _(c):
    return publish.broken_page(graph.broken_groups(c.broken), "g1")


@on_corpus("health_page", """SELECT '# Corpus health' || chr(10) || chr(10) || '- Generation: `g1`' || chr(10) || '- Compiled at: `2024-01-01T00:00:00Z`' || chr(10) || '- Eligibility contract: `c`' || chr(10)
 || '- Files: ' || (SELECT count(*) FROM files) || ' (' || (SELECT count(*) FROM files WHERE kind = 'note') || ' notes, ' || (SELECT count(*) FROM files WHERE kind <> 'note') || ' attachments)' || chr(10)
 || '- Links: ' || (SELECT count(*) FROM edges) || ' (' || (SELECT count(*) FROM edges WHERE resolution_status <> 'resolved') || ' broken or ambiguous)' || chr(10)
 || '- Orphans: ' || (SELECT count(*) FROM orphan WHERE hard_orphan) || ' hard, ' || (SELECT count(*) FROM orphan WHERE no_backlink) || ' without backlinks, ' || (SELECT count(*) FROM orphan WHERE outbound_only) || ' outbound only' || chr(10)
 || '- Tags: ' || (SELECT count(DISTINCT tag) FROM tags) || chr(10) || '- Notes with frontmatter: ' || (SELECT count(*) FROM files WHERE kind = 'note' AND (doc_id % 4 = 0 OR doc_id % 8 IN (2, 6))) || chr(10) || '- Warnings: ' || (SELECT count(*) FROM warned) AS value""")
def _(c):
    return c.pages("g1", "2024-01-01T00:00:00Z", "c")["HEALTH.md"]


@on_corpus("published_order", """SELECT artifact, CAST(row_number() OVER (PARTITION BY artifact ORDER BY a, b, c, n) AS BIGINT) AS place, a, b, c, CAST(n AS BIGINT) AS n FROM (
 SELECT 'LINKS' AS artifact, source_path AS a, '' AS b, '' AS c, ordinal AS n FROM edges UNION ALL SELECT 'FILE_INDEX', path, '', '', 0 FROM files UNION ALL SELECT 'ORPHANS', path, '', '', 0 FROM orphan
 UNION ALL SELECT 'BROKEN_LINKS', resolution_status, raw_target, source_path, 0 FROM edges WHERE resolution_status <> 'resolved' UNION ALL SELECT 'WARNINGS', path, code, message, 0 FROM warned)""")
def _(c):
    """Sort keys of artifacts in the order in which their parts hold them, by file and place in it."""
    spark, root, all_ = c.links.sparkSession, scratch(c.links.sparkSession), c.artifacts()
    keys = {"LINKS": ("source_path", "", "", "ordinal"), "FILE_INDEX": ("path", "", "", ""), "ORPHANS": ("path", "", "", ""), "BROKEN_LINKS": ("resolution_status", "raw_target", "source_path", ""), "WARNINGS": ("path", "code", "message", "")}
    publish.publish({n: all_[n] for n in keys}, root, "g1")
    out = None
    for name, fields in keys.items():
        lines = numbered(logs.progress_log(spark, f"{root}/generations/g1/{name}"), (), ("run_id", "seq"), "place")
        value = lambda f: F.get_json_object("line", f"$.{f}") if f else F.lit("")
        n = value(fields[3]) if fields[3] else F.lit("0")
        one = lines.select(F.lit(name).alias("artifact"), F.col("place").cast("long").alias("place"), *(value(f).alias(x) for f, x in zip(fields, "abc")), n.cast("long").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@entry("scanned_tree", ("documents",), "SELECT 'd' || doc_id % 7 || '/' || CASE WHEN doc_id % 5 = 0 THEN '.hidden' ELSE 'n' END || doc_id || '.md' AS path, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, true AS is_regular, sha256(coalesce(text, '')) AS digest FROM documents")
def _(d):
    """A tree of files that the query writes, scanned with its content; its folders are wide enough to be split."""
    root = scratch(d.sparkSession)
    tree = d.select(F.format_string("d%d/%s%d.md", F.col("doc_id") % 7, F.when(F.col("doc_id") % 5 == 0, ".hidden").otherwise("n"), "doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    corpus_source.write_tree(tree, root)
    got = corpus_source.scan_corpus(d.sparkSession, root, content=True, wide=50)
    return got.select("path", "size", "is_regular", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))


@entry("large_policy", ("scan", "orders"), """SELECT DISTINCT s.path, CASE WHEN o.o_orderkey IS NULL THEN false WHEN o.o_orderkey % 4 = 0 THEN o.o_orderkey % 8 <> 0 WHEN o.o_orderkey % 4 = 1 THEN s.path = 'dir' || o.o_orderkey % 13 || '/sub' || o.o_orderkey % 3 || '/f' || o.o_orderkey || '.md' ELSE false END AS ignored
 FROM (SELECT rel_path AS path, CAST(regexp_extract(rel_path, 'f([0-9]+)[.]md$', 1) AS BIGINT) AS k FROM scan) s LEFT JOIN orders o ON o.o_orderkey = s.k""")
def _(s, o):
    """A policy of as many rules as there are orders: names (some taken back), paths, extensions."""
    k = F.col("o_orderkey")
    name = F.format_string("f%d.md", k)
    line = F.when(k % 8 == 0, F.concat(name, F.lit("\n!"), name)).when(k % 4 == 0, name).when(k % 4 == 1, F.concat(F.format_string("/dir%d/sub%d/", k % 13, k % 3), name)).when(k % 4 == 2, F.format_string("*.x%d", k)).otherwise(F.format_string("/only%d/*/[ab]?", k))
    files = o.groupBy(F.floor(k / 500).alias("part")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("content"))
    rules = policy.compiled(files.select(F.col("part").cast("string").alias("path"), F.lit("").alias("scope"), "content"))
    return policy.ignored(s.select(F.col("rel_path").alias("path"), F.lit(False).alias("is_dir")), rules).select("path", "ignored")


@entry("first_symlinks", ("scan",), "SELECT profile_id, rel_path AS path, CAST(k AS INTEGER) AS place, greatest(n - 10, 0) AS more FROM (SELECT profile_id, rel_path, row_number() OVER (PARTITION BY profile_id ORDER BY rel_path) AS k, count(*) OVER (PARTITION BY profile_id) AS n FROM scan WHERE size % 3 = 0) WHERE k <= 10")
def _(s):
    return ledger.first_skipped(s.select("profile_id", F.col("rel_path").alias("path"), (F.col("size") % 3 == 0).alias("is_symlink")))


@entry("pending_in_order", ("pending",), "SELECT profile_id, rel_path AS path, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY first_seen, rel_path) AS INTEGER) AS place FROM pending")
def _(p):
    return ledger.by_first_seen(p.withColumnRenamed("rel_path", "path")).select("profile_id", "path", "place")


REQUESTS = """SELECT profile_id, request_id, policy_hash, CASE WHEN state = 'preview' AND profile_id IN (SELECT profile_id FROM policies WHERE refresh_state = 'ready') THEN 'superseded' ELSE state END AS state, NULL AS candidate_count, NULL AS candidate_digest FROM requests
UNION ALL SELECT p.profile_id, 'prune-' || p.profile_id || '-20240110000000', p.hash, 'preview', coalesce(c.n, 0), coalesce(c.d, sha256('')) FROM policies p LEFT JOIN (
 SELECT profile_id, CAST(sum(n) AS BIGINT) AS n, sha256(unhex(string_agg(hex(encode(d)) || '00', '' ORDER BY batch))) AS d FROM (
  SELECT profile_id, batch, count(*) AS n, sha256(unhex(string_agg(hex(encode(rel_path)) || '00', '' ORDER BY rel_path))) AS d FROM (
   SELECT l.profile_id, l.rel_path, (row_number() OVER (PARTITION BY l.profile_id ORDER BY l.rel_path) - 1) // 512 AS batch FROM ledger l JOIN policies p ON p.profile_id = l.profile_id AND p.refresh_state = 'ready' WHERE l.state = 'suppressed' AND l.suppressed_policy_hash = p.hash)
  GROUP BY 1, 2) GROUP BY 1) c ON c.profile_id = p.profile_id WHERE p.refresh_state = 'ready'"""


@entry("prune_requests", ("ledger", "policies", "requests"), REQUESTS)
def _(l, p, r):
    at = F.lit("2024-01-10 00:00:00").cast("timestamp")
    out = ledger.prune_requests(l, p.withColumn("max_delete", F.lit(100)), r.withColumn("created_at", F.timestamp_seconds("created_at")), at)
    return out.select("profile_id", "request_id", "policy_hash", "state", "candidate_count", "candidate_digest")


# ---- audit ------------------------------------------------------------------------

FLAGS = f"""SELECT path, regexp_matches(text, '{audit.SECRET}') AS secret, regexp_matches(text, '{audit.PRIVATE}') AS private, regexp_matches(path, '{audit.CREDENTIAL_FILE}') AS credential_file,
 EXISTS (SELECT 1 FROM needles n WHERE n.needle <> '' AND NOT starts_with(n.needle, '#') AND contains(d.text, n.needle)) AS denylisted FROM audit_docs d"""
VERDICT = "CASE WHEN secret OR credential_file OR denylisted THEN 'BLOCKED' WHEN private THEN 'REVIEW' ELSE 'PASS' END"


@entry("audit_flags", ("audit_docs", "needles"), f"SELECT *, {VERDICT} AS verdict FROM ({FLAGS})")
def _(d, n):
    return audit.audit(d, n)


@entry("audit_denied", ("audit_docs", "needles"), "SELECT path, needle FROM audit_docs d JOIN (SELECT DISTINCT needle FROM needles WHERE needle <> '' AND NOT starts_with(needle, '#')) n ON contains(d.text, n.needle)")
def _(d, n):
    return audit.denied(d, n)


@entry("audit_short_needles", ("audit_docs", "short_needles"), "SELECT needle, count(*) AS texts FROM audit_docs d JOIN (SELECT DISTINCT needle FROM short_needles WHERE needle <> '' AND NOT starts_with(needle, '#')) n ON contains(d.text, n.needle) GROUP BY 1")
def _(d, n):
    """Texts with needles of one or two words and of a few letters."""
    return audit.denied(d, n).groupBy("needle").agg(F.count("*").alias("texts"))


@entry("audit_verdict", ("audit_docs", "needles"), f"SELECT CASE max(CASE {VERDICT} WHEN 'BLOCKED' THEN 2 WHEN 'REVIEW' THEN 1 ELSE 0 END) WHEN 2 THEN 'BLOCKED' WHEN 1 THEN 'REVIEW' ELSE 'PASS' END AS verdict FROM ({FLAGS})")
def _(d, n):
    return audit.overall(audit.audit(d, n))
