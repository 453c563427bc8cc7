"""The corpus fixture: facts, resolution, counters, publication, scanning."""

import os

import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import audit, extract, graph, policy
from corpusgraph.operators.fingerprint import UnstableScan, fingerprint, stable_scan
from corpusgraph.plans import compile as plan
from corpusgraph.plans import publish
from corpusgraph.sources import corpus, tables

FILES = {
    "a.md": "[[b]] [[b]] ![[asset.png]] [[missing]] [[dup]] #Topic",
    "b.md": "[[a]]",
    "self.md": "[[self]]",
    "one/dup.md": "one",
    "two/dup.md": "two",
    "asset.png": "binary",
}

SNIPPETS = [
    ("---\ntags: [Alpha, beta]\naliases: note\n---\n[[Target#Heading|shown]] ![[image.png]] [other](folder/other.md) #Inline\n```\n[[fake]]\n```\n`[[fake]]`\n", 3, 1, "Target"),
    ("---\ntags: [broken\n---\n[[body-link]] #body-tag", 1, 1, "body-link"),
    ("---\nbody [[still-parsed]] #still-tag", 1, 1, "still-parsed"),
    ("$[[fake]]$", 0, 0, None),
    ("$x #fake [[fake]]$", 0, 0, None),
    ("$x\n#fake [[fake]]$", 0, 0, None),
    ("$x\n\n[[real]]", 1, 0, "real"),
    ("$$[[fake]]$$", 0, 0, None),
    ("$$\n$x #fake [[fake]]\n$$\n[[real]]", 1, 0, "real"),
    ("intro\n$$\n[[fake]] #fake\n$$\n[[real]]", 1, 0, "real"),
    ("before [[real]] $[[fake]]$ after", 1, 0, "real"),
    ("![[image.png]] $![[fake.png]]$", 1, 0, "image.png"),
    ("pay $5 and [[real]] for $10", 1, 0, "real"),
    ("$20 and $30 then [[real]] and $x$", 1, 0, "real"),
    ("$[[text]] followed by [[real]]", 2, 0, "text"),
    ("$$\nordinary [[real]]", 1, 0, "real"),
    ("$$\nordinary [[real]]\n- $$\n  [[list-real]]", 2, 0, "real"),
    ("$$\nordinary [[real]]\n> $$\n> [[quote-real]]", 2, 0, "real"),
    ("`$[[fake]]$`", 0, 0, None),
    ("```md\n$[[fake]]$ #fake\n```", 0, 0, None),
    ("    $$\n    [[fake]]\n    $$", 0, 0, None),
    ("\\$[[real]]\\$", 1, 0, "real"),
    ("$$\n[[fake-a]] #fake-a\n$$\n$$\n[[fake-b]] #fake-b\n$$\n[[real]]", 1, 0, "real"),
    ("> $$\n> [[fake]] #fake\n> $$\n> [[real]]", 1, 0, "real"),
    ("- $$\n  [[fake]] #fake\n  $$\n- [[real]]", 1, 0, "real"),
    ("---\ntags: [broken\n---\n$x #fake [[fake]]$\n[[real]]", 1, 0, "real"),
    ("```\n[[fake]]\n```\n\nafter [[real]] #tag\n\n~~~py\n[[fake]]\n~~~\n[[more]]", 2, 1, "real"),
    ("````\n```\n[[fake]]\n````\n[[real]]\n```\n[[open]]", 1, 0, "real"),
]


def test_snippets(spark):
    notes = spark.createDataFrame([(str(k), s[0]) for k, s in enumerate(SNIPPETS)], "path string, content string")
    got = {r.path: r.facts for r in extract.extract_facts(notes).collect()}
    for k, (text, links, tags, first) in enumerate(SNIPPETS):
        found = [f for f in got[str(k)] if f.kind != "tag"]
        assert (len(found), len(got[str(k)]) - len(found)) == (links, tags), text
        assert first is None or found[0].raw_target == first


@pytest.fixture(scope="module")
def compiled(spark):
    return plan.compile_corpus(spark.createDataFrame(list(FILES.items()), "path string, content string"))


def test_counts(compiled):
    c = compiled.counts().first().asDict()
    assert c == {"eligible_files": 6, "notes": 5, "attachments": 1, "link_occurrences": 7, "broken_links": 2, "hard_orphans": 3, "no_backlink_notes": 3, "outbound_only_notes": 0, "tags": 1, "warnings": 0}


def test_degrees_and_ambiguity(compiled):
    d = {r["path"]: (r["incoming_edge_count"], r["outgoing_edge_count"], r["incoming_neighbor_count"], r["outgoing_neighbor_count"], r["self_link_count"]) for r in compiled.degrees.collect()}
    assert d["a.md"] == (1, 5, 1, 1, 0) and d["b.md"] == (2, 1, 1, 1, 0) and d["self.md"] == (1, 1, 0, 0, 1)
    dup = compiled.links.filter("raw_target = 'dup'").first()
    assert (dup["resolution_status"], dup["candidate_paths"]) == ("ambiguous", ["one/dup.md", "two/dup.md"])


@pytest.mark.parametrize("mode,x,y", [("documented", (0, 1), (1, 0)), ("observed", (1, 0), (0, 1))])
def test_neighbor_modes(spark, mode, x, y):
    c = plan.compile_corpus(spark.createDataFrame([("x.md", "[[y]]"), ("y.md", "")], "path string, content string"), neighbor_mode=mode)
    d = {r["path"]: (r["incoming_neighbor_count"], r["outgoing_neighbor_count"]) for r in c.degrees.collect()}
    assert d == {"x.md": x, "y.md": y}


def test_warnings(spark):
    docs = [("a.md", "---\ntags: [x, 3, {k: v}]\naliases: [1, 2]\n---\n"), ("b.md", "---\ntags: {a: b}\naliases: 5\n---\n"), ("c.md", "---\ntags: [bad\n---\n")]
    rows = extract.warning_rows(extract.extract_facts(spark.createDataFrame(docs, "path string, content string")))
    got = sorted((r["path"], r["code"]) for r in rows.collect())
    assert got == [("a.md", "frontmatter_alias_type_unsupported"), ("a.md", "frontmatter_tag_type_unsupported"), ("a.md", "frontmatter_tag_type_unsupported"), ("b.md", "frontmatter_alias_type_unsupported"), ("b.md", "frontmatter_tag_type_unsupported"), ("c.md", "frontmatter_malformed")]


def test_publish_and_verify(spark, compiled, tmp_path):
    root = f"file://{tmp_path}/out"
    summaries = {"HEALTH.md": publish.health_summary(compiled.counts(), "g1"), "BROKEN.md": publish.broken_page(graph.broken_groups(compiled.broken), "g1")}
    m = publish.publish(compiled.artifacts(), root, "g1", summaries)
    assert m["artifacts"]["LINKS"]["records"] == 7
    assert publish.verify_generation(spark, root).count() == 0
    assert publish.read_generation(spark, root, "FILE_INDEX").count() == 6
    part = next(p for p in (tmp_path / "out/generations/g1/LINKS").iterdir() if p.name.startswith("part-") and p.stat().st_size)
    os.remove(part.parent / f".{part.name}.crc")
    part.write_bytes(part.read_bytes().replace(b"missing", b"MISSING"))
    assert [r["problem"] for r in publish.verify_generation(spark, root).collect()] == ["digest_differs"]
    with pytest.raises(ValueError):
        publish.publish({"../x": compiled.links}, root, "g2")


def test_scan(spark, tmp_path):
    for p, text in {"public.md": "x", "private/secret.md": "y", ".knowledge-derived/generated.md": "z", "large.bin": "12345", ".gitignore": "private/\n.gitignore\n", "_under.md": "u", ".git/x.md": "g"}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(text)
    os.symlink(tmp_path / "public.md", tmp_path / "alias.md")
    scan = corpus.scan_corpus(spark, str(tmp_path), content=True)
    status = {r["path"]: r["status"] for r in plan.eligible(scan, 4).collect()}
    assert status == {"public.md": "eligible", "_under.md": "eligible", "private/secret.md": "ignored", ".gitignore": "ignored", ".knowledge-derived/generated.md": "reserved", "large.bin": "oversize", "alias.md": "symlink"}
    assert {r["mtime_ns"] % 1_000_000_000 > 0 for r in scan.collect()} >= {True}


def test_deep_folders_are_partitions(spark, tmp_path, monkeypatch):
    for k in range(4):
        for j in range(3):
            (tmp_path / f"a/b{k}/c{j}").mkdir(parents=True)
            (tmp_path / f"a/b{k}/c{j}/x.md").write_text("x")
    (tmp_path / "a/y.md").write_text("y")
    monkeypatch.setattr(corpus, "FOLDERS", 6)
    reader = corpus.CorpusReader({"path": str(tmp_path)}, corpus.CorpusSource({}).schema() and spark.createDataFrame([], corpus.SCHEMA).schema)
    parts = reader.partitions()
    found = sorted(r[0] for p in parts for r in reader.read(p))
    assert len(parts) > 4 and found == sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.md"))


def test_pointer_is_replaced_in_one_step(spark, compiled, tmp_path):
    root = f"file://{tmp_path}/out"
    for g in ("g1", "g2"):
        publish.publish({"LINKS": compiled.links}, root, g)
        assert publish.current(spark, root)["generation"] == g
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["CURRENT.json", "generations"]


def test_long_denylist(spark):
    """Needles meet texts by an inner word; single words and edges of words count as well."""
    docs = spark.createDataFrame([("a", "some secret project name here"), ("b", "xsecret projects name"), ("c", None), ("d", "project")], "path string, text string")
    lines = spark.createDataFrame([("secret project name",), ("cret project n",), ("project",), ("# project",), ("",), ("secret  project",)], "needle string")
    got = sorted((r["path"], r["needle"]) for r in audit.denied(docs, lines).collect())
    assert got == [("a", "cret project n"), ("a", "project"), ("a", "secret project name"), ("b", "project"), ("d", "project")]


def test_fingerprint(spark):
    rows = [("a", 1, 10), ("b", 2, 20), (None, 3, 30)]
    frame = lambda r: spark.createDataFrame(r, "path string, size long, mtime_ns long")
    f = lambda r: fingerprint(frame(r), ["path", "size", "mtime_ns"]).first()["fingerprint"]
    assert f(rows) == f(rows[::-1])
    assert len({f(rows), f([("a", 1, 11), *rows[1:]]), f(rows[:2]), f([*rows, rows[0]]), f([])}) == 5
    scans = iter([rows, rows[:2], rows, rows[:1]])
    with pytest.raises(UnstableScan):
        stable_scan(lambda: frame(next(scans)), lambda d: d.count())
    assert stable_scan(lambda: frame(rows), lambda d: d.count()) == 3


IGNORE = [
    (["*.log"], "a.log", False, True), (["*.log"], "sub/a.log", False, True), (["**/build"], "a/b/build", True, True), (["a?c.txt"], "abc.txt", False, True),
    (["file[0-9].txt"], "file7.txt", False, True), (["*.[Dd]oc"], "report.Doc", False, True), (["/foo.txt"], "foo.txt", False, True), (["/foo.txt"], "sub/foo.txt", False, False),
    (["build/"], "build", True, True), (["build/"], "build", False, False), (["build/"], "build/out.txt", False, True), (["# comment"], "a.txt", False, False), (["\\#file"], "#file", False, True),
    (["*.log", "!keep.log"], "keep.log", False, False), (["*.log", "!keep.log", "keep.log"], "keep.log", False, True), (["/sub/only.md"], "sub/only.md", False, True), (["/sub/only.md"], "other/only.md", False, False),
    (["tmp"], "tmp/x", False, True), ([""], "a", False, False), (["vendor/", "!vendor/foo.txt"], "vendor/foo.txt", False, True), (["a/**/z"], "a/b/c/z", False, True), (["a/**"], "a/b", False, True),
]


@pytest.mark.parametrize("lines,path,is_dir,want", IGNORE)
def test_ignore(spark, lines, path, is_dir, want):
    rules, _ = policy.compile_policy([("", "", "\n".join(lines))])
    got = policy.ignored(spark.createDataFrame([(path, is_dir)], "path string, is_dir boolean"), policy.rule_frame(spark, rules)).first()
    assert got["ignored"] is want


def test_long_policies_decide_alike(spark, monkeypatch):
    lines = [("", "", "*.log\n!keep.log\nbuild/\n/top.md\n"), ("a/.gitignore", "a", "*.md\n!b/x.md\nc/\n")]
    rules = policy.rule_frame(spark, policy.compile_policy(lines)[0])
    paths = spark.createDataFrame([(p, d) for p in ("x.log", "keep.log", "build", "build/y", "top.md", "a/top.md", "a/b/x.md", "a/c/z", "a/c", "z.md", "a/build/keep.log") for d in (False, True)], "path string, is_dir boolean")
    one = {tuple(r) for r in policy.ignored(paths, rules).collect()}
    monkeypatch.setattr(policy, "LITERAL", 0)
    assert one == {tuple(r) for r in policy.ignored(paths, rules).collect()} and 5 < sum(r[2] for r in one) < 20


def test_scoped_and_bad_patterns(spark):
    rules, warnings = policy.compile_policy([("notes/.gitignore", "notes", "*.tmp\n[bad\n")])
    paths = spark.createDataFrame([("notes/a.tmp", False), ("a.tmp", False)], "path string, is_dir boolean")
    got = {r["path"]: r["ignored"] for r in policy.ignored(paths, policy.rule_frame(spark, rules)).collect()}
    assert got == {"notes/a.tmp": True, "a.tmp": False} and [w[1:3] for w in warnings] == [(2, "[bad")]


def test_nested_policy(spark):
    files = spark.createDataFrame([(".gitignore", "vendor/\n"), ("vendor/.gitignore", "!foo.txt\n"), ("src/.gitignore", "*.o\n"), (".git/.gitignore", "x")], "path string, content string")
    assert [p for p, _, _ in policy.collect_policy(files)] == [".gitignore", "src/.gitignore"]


def test_legacy_equals_patterns(spark):
    rules = [("exclude_path_prefix", "Private"), ("exclude_dir_name", ".git"), ("exclude_filename", ".DS_Store"), ("exclude_extension", "tmp")]
    paths = ["Private", "Private/secret.md", "docs/Private/a.md", "Private2/a.md", ".git/config", "a/b/.git/x", "gitfile", "notes/.gitignore", "a/.DS_Store", "b.txt", "c.tmp", "d.TMP", "x.c.tmp.bak"]
    df = spark.createDataFrame([(p, False) for p in paths], "path string, is_dir boolean")
    patterns = [r["pattern"] for r in policy.legacy_to_patterns(spark.createDataFrame(rules, "kind string, value string")).collect()]
    by_pattern = {r["path"]: r["ignored"] for r in policy.ignored(df, policy.rule_frame(spark, policy.compile_policy([("", "", "\n".join(patterns))])[0])).collect()}
    by_rule = {r["path"]: r["reason"] is not None for r in policy.legacy_excluded(df, rules).collect()}
    assert by_pattern == by_rule and sum(by_rule.values()) == 7


def test_empty_corpus(spark):
    c = plan.compile_corpus(spark.createDataFrame([], "path string, content string"))
    assert c.counts().first()["eligible_files"] == 0 and c.links.count() == 0 and c.degrees.select(F.count("*")).first()[0] == 0


def test_few_splits_are_dealt_over_the_cores(spark, tmp_path):
    spark.range(5000).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    rows = tables.read_table(spark, str(tmp_path), "t")
    cores = spark.sparkContext.defaultParallelism
    assert tables.spread(rows).rdd.getNumPartitions() == cores and tables.spread(rows).count() == 5000
    many = rows.repartition(cores + 1)
    assert tables.spread(many) is many
