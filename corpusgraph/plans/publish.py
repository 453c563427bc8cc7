"""Immutable generations of artifacts: written aside, manifest last, pointer swapped, verified by digest.

Everything goes through Spark's file systems, so a generation can live in any
store Spark reaches.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import is_canonical, is_reserved
from ..operators.blocks import numbered
from ..operators.fingerprint import fingerprints

PART_RECORDS = 500_000
SAFE = re.compile(r"^[A-Za-z0-9][A-Za-z0-9._-]*$")


def _safe(name: str) -> str:
    if not SAFE.match(name) or ".." in name:
        raise ValueError(f"unsafe name: {name!r}")
    return name


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole, then rename it over the old one in one step."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, path + ".new"))
    out = target.getFileSystem(conf).create(aside, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(aside, target, over)


def _get(spark: SparkSession, path: str) -> str | None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return None
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def inventory(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """artifact, bytes, records, digest of the artifacts that are there.

    Parts are read line by line in splits of the session's size, so a part may be of any
    size.  The digest covers each line with the part it is in and how often it occurs,
    through sums in buckets (``fingerprint``), not the order inside a part.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = lambda n: (p := jvm.org.apache.hadoop.fs.Path(f"{folder}/{_safe(n)}")).getFileSystem(conf).exists(p)
    found = [n for n in names if there(n)]
    m = F.col("_metadata")
    out = spark.createDataFrame([(n,) for n in found], "artifact string")
    rows = None
    for n in found:
        one = spark.read.option("lineSep", "\n").option("pathGlobFilter", "part-*").text(f"{folder}/{n}")
        one = one.select(F.lit(n).alias("artifact"), m["file_name"].alias("part"), m["file_size"].alias("size"), F.col("value").cast("binary").alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        return out.selectExpr("artifact", "0L AS bytes", "0L AS records", "'' AS digest")
    digest = fingerprints(rows, ["artifact"], F.sha2(F.concat(F.col("part").cast("binary"), F.lit("\x00").cast("binary"), "value"), 256))
    size = rows.groupBy("artifact", "part").agg(F.max("size").alias("size")).groupBy("artifact").agg(F.sum("size").alias("bytes"))
    told = out.join(digest, "artifact", "left").join(size, "artifact", "left")
    return told.select("artifact", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), F.coalesce("n_rows", F.lit(0)).cast("long").alias("records"), F.coalesce("fingerprint", F.sha2(F.lit("").cast("binary"), 256)).alias("digest"))


def publish(frames: dict[str, DataFrame], root: str, generation: str, summaries: dict[str, DataFrame] | None = None) -> dict:
    """Write a generation and make it current; returns its manifest."""
    spark = next(iter(frames.values())).sparkSession
    folder = f"{root}/generations/{_safe(generation)}"
    for name, df in frames.items():
        df.write.mode("error").option("maxRecordsPerFile", PART_RECORDS).json(f"{folder}/{_safe(name)}", ignoreNullFields=False)
    for name, df in (summaries or {}).items():
        df = df.orderBy("place").select("value") if "place" in df.columns else df
        df.write.mode("error").text(f"{folder}/{_safe(name)}")
    rows = inventory(spark, folder, [*frames, *(summaries or {})]).collect()
    manifest = {"generation": generation, "artifacts": {r["artifact"]: {"bytes": r["bytes"], "records": r["records"], "digest": r["digest"]} for r in sorted(rows, key=lambda r: r["artifact"])}}
    text = json.dumps(manifest, sort_keys=True)
    _put(spark, f"{folder}/MANIFEST.json", text)
    _put(spark, f"{root}/CURRENT.json", json.dumps({"generation": generation, "manifest_sha256": hashlib.sha256(text.encode()).hexdigest()}))
    return manifest


def current(spark: SparkSession, root: str) -> dict | None:
    text = _get(spark, f"{root}/CURRENT.json")
    return json.loads(text) if text else None


def read_generation(spark: SparkSession, root: str, name: str, generation: str | None = None) -> DataFrame:
    g = generation or (current(spark, root) or {}).get("generation")
    if not g:
        raise FileNotFoundError("nothing is published")
    return spark.read.json(f"{root}/generations/{_safe(g)}/{_safe(name)}")


def verify_generation(spark: SparkSession, root: str, generation: str | None = None) -> DataFrame:
    """Artifacts whose parts don't agree with the manifest: artifact, problem (no rows: sound)."""
    pointer = current(spark, root)
    g = generation or pointer["generation"]
    text = _get(spark, f"{root}/generations/{_safe(g)}/MANIFEST.json")
    if pointer and g == pointer["generation"] and hashlib.sha256((text or "").encode()).hexdigest() != pointer["manifest_sha256"]:
        return spark.createDataFrame([("MANIFEST.json", "digest_differs")], "artifact string, problem string")
    said = json.loads(text)["artifacts"]
    want = spark.createDataFrame([(n, a["bytes"], a["records"], a["digest"]) for n, a in said.items()], "artifact string, w_bytes long, w_records long, w_digest string")
    j = want.join(inventory(spark, f"{root}/generations/{_safe(g)}", sorted(said)), "artifact", "full_outer")
    problem = F.when(F.col("w_digest").isNull(), "unexpected").when(F.col("digest").isNull(), "missing").when((F.col("bytes") != F.col("w_bytes")) | (F.col("records") != F.col("w_records")), "size_differs").when(F.col("digest") != F.col("w_digest"), "digest_differs")
    return j.select("artifact", problem.alias("problem")).filter("problem IS NOT NULL")


def expired_generations(generations: DataFrame, keep: int = 1) -> DataFrame:
    """Generations (root, name, mtime, current, in_flight) to remove: neither current, in flight, nor among the newest others."""
    w = Window.partitionBy("root").orderBy(F.col("mtime").desc(), F.col("name").desc())
    return generations.filter("NOT current AND NOT in_flight").withColumn("k", F.row_number().over(w)).filter(F.col("k") > keep).drop("k")


def health_summary(counts: DataFrame, generation: str, compiled_at: str = "", contract: str = "", with_frontmatter: DataFrame | None = None) -> DataFrame:
    """A short markdown page of the corpus counts (one row of text), with when and under which contract it was compiled where these are given."""
    if with_frontmatter is not None:
        counts = counts.join(with_frontmatter)  # one row each
    head = [f"- Generation: `{generation}`"] + [f"- {what}: `{value}`" for what, value in (("Compiled at", compiled_at), ("Eligibility contract", contract)) if value]
    lines = {
        "Files: %d (%d notes, %d attachments)": ("eligible_files", "notes", "attachments"), "Links: %d (%d broken or ambiguous)": ("link_occurrences", "broken_links"),
        "Orphans: %d hard, %d without backlinks, %d outbound only": ("hard_orphans", "no_backlink_notes", "outbound_only_notes"), "Tags: %d": ("tags",),
    } | ({"Notes with frontmatter: %d": ("notes_with_frontmatter",)} if with_frontmatter is not None else {}) | {"Warnings: %d": ("warnings",)}
    text = "\n".join(["# Corpus health", "", *(h.replace("%", "%%") for h in head), *(f"- {x}" for x in lines)])
    return counts.select(F.format_string(text, *(c for x in lines.values() for c in x)).alias("value"))


def readme_summary(counts: DataFrame, generation: str) -> DataFrame:
    """The entry page of a generation (one row of text)."""
    page = ("# Corpus index", "", "Written by the compiler; edits are lost.", "", f"- Generation: `{generation}`", "- Digests of everything: `MANIFEST.json`", "- Structure: `HEALTH.md`", "- Orphans: `ORPHANS.md`", "- Broken links: `BROKEN.md`", "- Indexes: `FILE_INDEX`, `LINKS`, `TAG_INDEX`", "- Fields and warnings: `FRONTMATTER_STATS`, `WARNINGS`")
    return counts.limit(1).select(F.lit("\n".join(page)).alias("value"))


def _counts(field: str) -> Callable[[Column], Column]:
    return lambda r: r[field] > 0


def _folder_line(field: str) -> Callable[[Column], Column]:
    return lambda r: F.concat(F.lit('- "'), r["folder"], F.lit('": '), r[field].cast("string"), F.lit("\n"))


def orphan_summary(folders: DataFrame, generation: str) -> DataFrame:
    """The page of orphans: totals, then each class by top folder in order (folder counts are few)."""
    kinds = {"hard": "hard orphans", "no_backlink": "notes without backlinks", "outbound_only": "outbound-only notes"}
    rows = F.array_sort(F.collect_list(F.struct("folder", *kinds)))
    total = folders.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in kinds), rows.alias("rows"))
    parts = [F.lit(f"# Orphans\n\nGeneration: `{generation}`\n\nSummary: "), F.concat_ws(", ", *(F.concat(F.col(k).cast("string"), F.lit(f" {what}")) for k, what in kinds.items())), F.lit(".\n")]
    for k, what in kinds.items():
        lines = F.transform(F.filter("rows", _counts(k)), _folder_line(k))
        parts += [F.lit(f"\n## {what.capitalize()} by top folder\n\n"), F.array_join(lines, "")]
    return total.select(F.concat(*parts).alias("value"))


def quoted(c: Column | str) -> Column:
    """A value between quotes, with escapes as in JSON."""
    return F.regexp_extract(F.to_json(F.struct((F.col(c) if isinstance(c, str) else c).alias("v"))), r'^\{"v":(.*)\}$', 1)


def broken_page(groups: DataFrame, generation: str) -> DataFrame:
    """The page of broken links as numbered lines (place, value): a heading, then one line a group (status, target, folder, n) in order.

    Groups may be many, so lines are numbered in blocks and written in order of place.
    """
    head = ["# Broken links", "", f"Generation: `{generation}`", ""]
    line = F.concat(F.lit("- status="), quoted("status"), F.lit(" source_folder="), quoted("folder"), F.lit(" target="), quoted("target"), F.lit(" count="), F.col("n").cast("string"))
    rows = numbered(groups, (), ("status", "target", "folder"), "place").select((F.col("place") + len(head)).alias("place"), line.alias("value"))
    return groups.sparkSession.createDataFrame(list(enumerate(head, 1)), "place long, value string").unionByName(rows)


def target_list(targets: DataFrame, column: str = "rel_path") -> DataFrame:
    """Sorted lines of checked paths for a transfer; an unsafe path is an error."""
    p = F.col(column)
    ok = is_canonical(p) & ~is_reserved(p)
    return targets.select(F.when(ok, p).otherwise(F.raise_error(F.concat(F.lit("unsafe path: "), F.coalesce(p, F.lit("null"))))).alias("value")).orderBy("value")
