"""Policies, denylists and folders beyond what fits one expression, list or task."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import links as L
from corpusgraph.operators import audit, fingerprint, policy
from corpusgraph.plans import publish
from corpusgraph.sources import corpus


def test_index_keys():
    want = {
        "a.md": ("name", "a.md"), "/a.md": ("path", "a.md"), "a/b.md": ("path", "a/b.md"), "**/a": ("name", "a"), "*.md": ("ext", ".md"), "**/*.md": ("ext", ".md"), "*.tar.gz": ("scan", ""),
        "a*": ("scan", ""), "/a/*.md": ("under", "a"), "a/**/b": ("under", "a"), "/*.md": ("scan", ""), "*/b": ("scan", ""), "[ab]/c": ("scan", ""), "a\\*": ("scan", ""), "**/a/b": ("scan", ""),
    }
    assert {g: policy.index_key(g) for g in want} == want


@pytest.mark.parametrize("seed", range(3))
def test_index_equals_expression(spark, monkeypatch, seed):
    rng = random.Random(seed)
    parts = ["a", "b", "c", "x.md", "y.md", ".z", "w.tar.gz"]
    globs = ["a", "/a", "a/", "b/c", "**/c", "*.md", "**/*.md", "/b/*.md", "a/**/c", "?", "*", "[ab]", "*.tar.gz", "x.*", "c/**", "/*/c", ".z", "\\a"]
    files = [(f"{s}/.gitignore" if s else ".gitignore", s, "\n".join(rng.choice(("", "", "!")) + rng.choice(globs) for _ in range(12))) for s in ("", "a", "a/b", "c")]
    paths = sorted({"/".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(150)})
    df = spark.createDataFrame([(p, rng.random() < 0.2) for p in paths], "path string, is_dir boolean")
    rules = policy.compiled(spark.createDataFrame(files, "path string, scope string, content string")).filter("warning IS NULL")
    want = {(r["path"], r["is_dir"]): r["ignored"] for r in policy.ignored(df, rules).collect()}
    monkeypatch.setattr(policy, "LITERAL", 3)
    assert {(r["path"], r["is_dir"]): r["ignored"] for r in policy.ignored(df, rules).collect()} == want and len(set(want.values())) == 2
    on_driver = policy.rule_frame(spark, policy.compile_policy(files)[0])
    assert {(r["path"], r["is_dir"]): r["ignored"] for r in policy.ignored(df, on_driver).collect()} == want


def test_hundred_thousand_rules(spark):
    n = 100_000
    lines = spark.range(n).select(F.floor(F.col("id") / 1000).cast("string").alias("path"), F.lit("").alias("scope"), F.when(F.col("id") % 2 == 0, F.format_string("n%d.md", "id")).otherwise(F.format_string("/d/n%d.md", "id")).alias("line"))
    files = lines.groupBy("path", "scope").agg(F.array_join(F.collect_list("line"), "\n").alias("content"))
    paths = spark.range(0, n, 97).select(F.format_string("d/n%d.md", "id").alias("path"), F.lit(False).alias("is_dir")).unionByName(spark.range(0, n, 97).select(F.format_string("e/n%d.md", "id").alias("path"), F.lit(False).alias("is_dir")))
    rules = policy.compiled(files)
    got = {r["path"]: r["ignored"] for r in policy.ignored(paths, rules).collect()}
    assert rules.count() == n and got == {f"{d}/n{i}.md": d == "d" or i % 2 == 0 for d in "de" for i in range(0, n, 97)}


@pytest.mark.parametrize("seed", range(2))
def test_denylist_equals_search(spark, seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcé 🦊\n") for _ in range(n))
    docs = [(f"d{i}", text(rng.randrange(200))) for i in range(60)] + [("none", None), ("empty", ""), ("long", text(5000) + "needle at the end")]
    lines = ["", "# note", "needle at the end", "a", "é", "🦊", "ab", "zz"] + [text(rng.randrange(1, 9)) for _ in range(60)] + [(docs[i][1] or "")[5 : 5 + rng.randrange(1, 40)] for i in range(40)]
    got = sorted(map(tuple, audit.denied(spark.createDataFrame(docs, "path string, text string"), spark.createDataFrame([(x,) for x in lines], "needle string")).collect()))
    assert got == sorted((d, x) for d, t in docs for x in set(lines) if x and not x.startswith("#") and t and x in t)


def test_stretches_of_a_long_text(spark, monkeypatch):
    docs = spark.createDataFrame([("d", "x" * 97 + "needle of some length" + "y" * 50)], "path string, text string")
    needle = spark.createDataFrame([("needle of some length",), ("xn",), ("hy",)], "needle string")
    for step in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(audit, "STEP", step)
        assert audit.denied(docs, needle).count() == 3


def test_many_needles(spark):
    """Needles far beyond the former limit, one word each."""
    needles = spark.range(300_000).select(F.format_string("w%d.", "id").alias("needle"))
    docs = spark.range(50).select(F.format_string("d%d", "id").alias("path"), F.format_string("about w%d. and xw%d. here", F.col("id") * 7, F.col("id") + 299_960).alias("text"))
    got = audit.denied(docs, needles).groupBy("path").count().collect()
    assert {r["path"]: r["count"] for r in got} == {f"d{i}": 2 if i < 40 else 1 for i in range(50)}


def test_no_needles(spark):
    docs = spark.createDataFrame([("d", "text")], "path string, text string")
    assert audit.denied(docs, spark.createDataFrame([("",), ("#x",)], "needle string")).count() == 0


def test_grams_are_those_of_the_bytes():
    a, b = (np.frombuffer(x, np.uint8) for x in (b"abcabc", b"zabcz"))
    ha, hb = audit.gram_hashes(a, 3), audit.gram_hashes(b, 3)
    assert ha[0] == ha[3] == hb[1] and len(set(ha.tolist())) == 3 and len(audit.gram_hashes(a, 7)) == 0


def test_wide_folder_in_shares(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"f{i}.md").write_text("x")
    for i in range(30):
        (tmp_path / f"sub{i}").mkdir()
        (tmp_path / f"sub{i}/y.md").write_text("y")
    reader = corpus.CorpusReader({"path": str(tmp_path), "wide": "20"}, spark.createDataFrame([], corpus.SCHEMA).schema)
    parts = reader.partitions()
    assert sum(p.path == "" for p in parts) == 5
    got = [r[0] for p in parts for r in reader.read(p)]
    assert sorted(got) == sorted([f"f{i}.md" for i in range(60)] + [f"sub{i}/y.md" for i in range(30)])


def test_wide_deep_folder_in_shares(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "FOLDERS", 2)
    for i in range(40):
        (tmp_path / f"a/s{i}/t").mkdir(parents=True)
        (tmp_path / f"a/s{i}/t/y.md").write_text("y")
    reader = corpus.CorpusReader({"path": str(tmp_path), "wide": "10"}, spark.createDataFrame([], corpus.SCHEMA).schema)
    got = [r[0] for p in reader.partitions() for r in reader.read(p)]
    assert sorted(got) == sorted(f"a/s{i}/t/y.md" for i in range(40))


def test_written_tree_is_replaced(spark, tmp_path):
    for text in ("old", "a\r\nb"):
        corpus.write_tree(spark.createDataFrame([("x/é.md", text)], "path string, content string"), f"file://{tmp_path}")
    assert [(r["path"], r["size"], r["content"]) for r in corpus.scan_corpus(spark, str(tmp_path), content=True).collect()] == [("x/é.md", 4, "a\r\nb")]
    with pytest.raises(ValueError):
        corpus.scan_corpus(spark, "hdfs://h/x")


def test_contract_and_binding_digests(spark):
    import hashlib

    sha = lambda *p: hashlib.sha256("\x00".join(p).encode()).hexdigest()
    row = spark.createDataFrame([("ph", 5, "drive:", "id")], "p string, m long, r string, f string").select(L.contract_hash("p", "m").alias("c"), L.binding_digest("r", "f").alias("b"), L.binding_digest(F.lit("drive"), "f").alias("b2")).first()
    assert row["c"] == sha("eligibility-contract-v1", "ph", "5", "regular-file-v1", "no-follow-symlink-v1", "system-reservation-v1", "")
    assert row["b"] == row["b2"] == sha("derived-binding-v1", "drive", "id")


def test_snapshot_digest_tells_changes(spark):
    rows = [(f"p{i:05}", i, i * 10, f"h{i}") for i in range(1200)]
    of = lambda r, *a: fingerprint.snapshot_digest(spark.createDataFrame(r, "path string, size long, mtime_ns long, hash string").repartition(3), *a)
    base = of(rows, "p", "c")
    assert base == of(rows[::-1], "p", "c") and len({base, of(rows, "q", "c"), of(rows, "p", "d"), of(rows[1:], "p", "c"), of([("p00000", 0, 0, "x"), *rows[1:]], "p", "c"), of([], "p", "c")}) == 6


def test_parts_of_any_size_and_missing_ones(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = spark.range(5000).select(F.col("id"), F.repeat(F.lit("x"), 50).alias("v"))
    empty = rows.limit(0)
    publish.publish({"A": rows.repartition(3), "EMPTY": empty}, root, "g")
    assert publish.verify_generation(spark, root).isEmpty()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        assert publish.verify_generation(spark, root).isEmpty()  # other splits, the same digests
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    os.rename(tmp_path / "generations/g/A", tmp_path / "away")
    assert {(r["artifact"], r["problem"]) for r in publish.verify_generation(spark, root).collect()} == {("A", "missing")}


def test_compiled_line_by_line(spark, monkeypatch):
    """What Python's splitlines ends is a line, and a task holds a batch of lines, not of files."""
    ends = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " "]
    globs = ["a", "!b/", "", "# c", "d*[x-", "[z-a]", "/e/**/f ", "g\\ ", "\\", "h.i", "[!j]k", "é?"]
    files = [(f"f{i}", s, "".join(g + e for g in globs)) for i, (s, e) in enumerate((s, e) for s in ("", "x/y") for e in ends)] + [("none", "", None), ("last", "x", "a\n\nb")]
    want = set()
    for path, scope, content in files:
        rules, warnings = policy.compile_policy([(path, scope, content or "")])
        want |= {(r.scope, r.regex, r.negated, r.dir_only, r.source, r.line, r.pattern, None) for r in rules} | {(scope, None, None, None, *w) for w in warnings}
    got = policy.compiled(spark.createDataFrame(files, "path string, scope string, content string")).collect()
    assert {(r["scope"], r["regex"], r["negated"], r["dir_only"], r["source"], r["line"], r["pattern"], r["warning"]) for r in got} == want and len(got) == len(want) > 150
    assert all(r["ord"] == (len(r["scope"].split("/")) if r["scope"] else 0) << 32 | r["line"] for r in got)

    # Python gets a row a line, which Spark cuts into batches, not a row a file
    given, big = [], spark.createDataFrame([("f", "", "\n".join(f"n{k}" for k in range(300)))], "path string, scope string, content string")
    monkeypatch.setattr(type(big), "mapInPandas", lambda self, f, schema: given.append(self) or self)
    policy.compiled(big)
    assert given[0].count() == 300


def test_shares_of_wide_folders_are_bounded(spark, tmp_path):
    """Every share lists its whole folder, so that more entries mean larger shares, not more listings."""
    for d, n in (("a", 300), ("b", 100), ("c", 5)):
        (tmp_path / d).mkdir()
        for i in range(n):
            (tmp_path / d / f"f{i}.md").write_text("x")
    schema = spark.createDataFrame([], corpus.SCHEMA).schema
    reader = corpus.CorpusReader({"path": str(tmp_path), "wide": "10", "shares": "8"}, schema)
    parts = reader.partitions()
    assert {d: sum(p.path == d for p in parts) for d in ("", "a", "b", "c")} == {"": 1, "a": 6, "b": 2, "c": 1}
    assert sorted(r[0] for p in parts for r in reader.read(p)) == sorted(f"{d}/f{i}.md" for d, n in (("a", 300), ("b", 100), ("c", 5)) for i in range(n))
    scan = corpus.scan_corpus(spark, str(tmp_path), wide=1)
    assert scan.count() == 405 and scan.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism + 4


def test_pairs_of_one_root_are_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(policy, "CELL", 8, raising=False)
    monkeypatch.setattr(policy, "TASK_PAIRS", 256, raising=False)
    roots = [(f"p{k:03}", ("/a", "/a/", "/a/b", "/a/b/c", "/ab", "/", "", "/z/1//2", "/z/1")[k % 9]) for k in range(150)] + [("p900", "/alone"), ("p901", None), (None, "/a"), ("p000", "/a/b")]
    df = spark.createDataFrame(roots, "profile_id string, root string")
    clean = [(p, r.rstrip("/")) for p, r in roots if r is not None and p is not None]
    want = sorted((o, a, i, b) for o, a in clean for i, b in clean if a and o != i and ((a == b and o < i) or b.startswith(a + "/")))
    out = policy.overlapping_roots(df)
    assert sorted(map(tuple, out.collect())) == want
    held = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == len(want) and max(held) < len(want) / 4
    assert policy.overlapping_roots(df.limit(0)).count() == 0
