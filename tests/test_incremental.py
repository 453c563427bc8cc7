"""Rebuilding after edits against compiling anew; only changed notes are parsed."""

import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import extract, graph
from corpusgraph.plans import compile as plan
from corpusgraph.plans import incremental

SCHEMA = "path string, size long, mtime_ns long, content string"
BEFORE = {
    "a.md": "[[b]] [[gone]] [x](sub/c.md) #t1", "b.md": "[[a]] [[dup]]", "sub/c.md": "[[sub/dup.md]] ![[pic.png]]", "sub/dup.md": "", "gone.md": "[[a]]", "pic.png": None,
    "old.md": "[[a]]", "asks.md": "[[soon]] [[old]] [y](late) [[pic.png]]", "edit.md": "[[a]] [[b]]", "still.md": "[[still]] [[sub/c]]",
}
AFTER = {**{k: v for k, v in BEFORE.items() if k not in ("gone.md", "old.md", "pic.png")}, "dup.md": "", "soon.md": "[[asks]]", "late.md": "", "new/old.md": "[[a]]", "edit.md": "[[soon]] #t2"}


def scan(spark, tree, edited=()):
    return spark.createDataFrame([(p, len(c or ""), 2 if p in edited else 1, c) for p, c in tree.items()], SCHEMA)


def told(c):
    out = {n: sorted(map(str, getattr(c, n).select(*sorted(getattr(c, n).columns)).collect())) for n in ("links", "degrees", "orphans", "broken", "tags", "warnings")}
    return out | {"files": sorted(map(str, c.files.collect()))}


@pytest.mark.parametrize("after,edited", [(AFTER, ("edit.md",)), (BEFORE, ()), (BEFORE, ("a.md",)), ({}, ()), ({**BEFORE, "z.md": "[[a]]"}, ())])
def test_equals_a_full_compile(spark, monkeypatch, after, edited):
    then, now = scan(spark, BEFORE), scan(spark, after, edited)
    first = plan.compile_corpus(then.select("path", "content"), keep=True)
    parsed, extract_facts = [], extract.extract_facts

    def counted(notes):
        parsed.extend(r["path"] for r in notes.select("path").collect())
        return extract_facts(notes)

    monkeypatch.setattr(incremental.extract, "extract_facts", counted)
    got = told(incremental.rebuild(first, then, now))
    monkeypatch.undo()
    assert got == told(plan.compile_corpus(now.select("path", "content"), keep=True))
    assert sorted(parsed) == sorted(p for p, c in after.items() if p.endswith(".md") and (p not in BEFORE or p in edited))


def test_kinds_of_change(spark):
    got = {(r["path"], r["change"]) for r in incremental.changes(scan(spark, BEFORE), scan(spark, AFTER, ("edit.md",))).collect()}
    assert got == {("gone.md", "removed"), ("old.md", "removed"), ("pic.png", "removed"), ("dup.md", "added"), ("soon.md", "added"), ("late.md", "added"), ("new/old.md", "added"), ("edit.md", "edited")}


def test_shared_stem_holds_each_candidate_once(spark):
    """Three hundred notes of one stem, one link to it from each: 300 candidates, not 90,000."""
    files = graph.as_files(spark.range(300).select(F.format_string("d%d/index.md", "id").alias("path")))
    links = files.select(F.col("path").alias("source_path"), F.lit(0).alias("ordinal"), F.lit("wikilink").alias("link_kind"), F.lit("index").alias("raw_target"))
    one = graph.stem_candidates(files).collect()
    assert [(r["want_stem"], r["n"], len(r["found"])) for r in one] == [("index", 300, graph.CANDIDATES)]
    out = graph.resolve_links(links, files, most=10)
    assert {(r["resolution_status"], r["candidate_count"], tuple(r["candidate_paths"])) for r in out.collect()} == {("ambiguous", 300, tuple(sorted(f"d{i}/index.md" for i in range(300))[:10]))}
    assert graph.link_candidates(links.limit(2), files).count() == 600
