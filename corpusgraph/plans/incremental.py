"""Rebuilding a compiled corpus after a few files have changed.

An anti-join of fingerprints (path, size, time) tells what was added, edited and
removed.  Only notes among the first two are parsed.  Links are resolved again where
their source changed, or where a file appeared or vanished that they ask for (by path,
by path without ``.md``, or by stem); all others keep their resolution.  Degrees are
counted again for the notes at either end of a link that was dropped or resolved
again.  The result equals a full compile.

A rename is a removal and an addition.  Files whose fingerprint is the same are taken
to be the same; where that isn't enough, put a hash among ``fingerprint``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import extract, graph
from ..operators.blocks import kept
from .compile import Compiled

FINGERPRINT = ("size", "mtime_ns")


def changes(known: DataFrame, scan: DataFrame, fingerprint: tuple[str, ...] = FINGERPRINT) -> DataFrame:
    """path and change (added, edited, removed) of what differs between two scans."""
    old = known.select("path", F.struct(*fingerprint).alias("old"))
    new = scan.select("path", F.struct(*fingerprint).alias("new"))
    both = old.join(new, "path", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "edited")
    return both.select("path", change.alias("change")).filter("change IS NOT NULL")


def touched(links: DataFrame, moved: DataFrame) -> DataFrame:
    """Links (source_path, ordinal) that ask for a path or stem of a file that appeared or vanished."""
    asked = graph.wanted(links)
    files = graph.as_files(moved.select("path"))
    note = files.filter("kind = 'note'")
    paths = files.select(F.col("path").alias("want")).unionByName(note.filter(F.col("path").endswith(".md")).select(F.expr("left(path, length(path) - 3)").alias("want"))).distinct()
    stems = note.select(F.col("stem").alias("want_stem")).distinct()
    key = ["source_path", "ordinal"]
    return asked.join(paths, "want", "left_semi").select(*key).unionByName(asked.join(stems, "want_stem", "left_semi").select(*key))


def rebuild(before: Compiled, known: DataFrame, scan: DataFrame, fingerprint: tuple[str, ...] = FINGERPRINT) -> Compiled:
    """``before`` (compiled from ``known``) brought up to ``scan`` (path, fingerprint columns, content)."""
    delta = kept(changes(known, scan, fingerprint))
    stale = delta.filter("change <> 'added'").select("path")
    fresh = delta.filter("change <> 'removed'").select("path")
    moved = delta.filter("change <> 'edited'").select("path")

    files = graph.as_files(scan.select("path"))
    notes = scan.join(fresh, "path", "left_semi").filter(P.node_kind("path") == "note").select("path", "content")
    parsed_new = kept(extract.extract_facts(notes))
    parsed = before.parsed.join(stale, "path", "left_anti").unionByName(parsed_new)

    own = before.links.join(stale.withColumnRenamed("path", "source_path"), "source_path", "left_anti")
    key = ["source_path", "ordinal"]
    again = kept(touched(own, moved).distinct())
    facts = extract.link_facts(parsed_new)
    resolved = kept(graph.resolve_links(facts.unionByName(own.join(again, key, "left_semi").select(*facts.columns)), files))
    links = kept(own.join(again, key, "left_anti").unionByName(resolved))

    dropped = before.links.join(stale.withColumnRenamed("path", "source_path"), "source_path", "left_semi").unionByName(own.join(again, key, "left_semi"))
    ends = [d.select(F.col(c).alias("path")) for d in (dropped, resolved) for c in ("source_path", "resolved_target_path")]
    at = delta.select("path")
    for e in ends:
        at = at.unionByName(e)
    at = kept(at.filter("path IS NOT NULL").distinct())
    mark = lambda name, flag: at.select(F.col("path").alias(name), F.lit(True).alias(flag))
    near = links.join(mark("source_path", "__s"), "source_path", "left").join(mark("resolved_target_path", "__t"), "resolved_target_path", "left").filter("__s OR __t").drop("__s", "__t")
    counted = graph.degrees(near, files.filter("kind = 'note'").join(at, "path", "left_semi"))
    degree = before.degrees.join(at, "path", "left_anti").unionByName(counted)
    return Compiled(files, parsed, links, degree, graph.orphans(degree), graph.broken_links(links), extract.tag_facts(parsed), extract.warning_rows(parsed))
