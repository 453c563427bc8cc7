"""The note graph: link resolution, degrees, orphans, broken links, tag and field indexes.

Paths are resolved by equi-joins of distinct wanted paths with the file table, bare
names by one row a stem that holds its count and first candidates; occurrences join
the result back, so work grows with links and notes, not with their product.  Degrees
are partial aggregates by source and by target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import links as L
from ..functions import paths as P

CANDIDATES = 256


def as_files(entries: DataFrame) -> DataFrame:
    """path, kind, extension, stem, path_id of eligible entries."""
    return entries.withColumns({"kind": P.node_kind("path"), "extension": P.extension("path"), "stem": P.stem("path"), "path_id": P.path_id("path")})


def wanted(links: DataFrame) -> DataFrame:
    """Local links with what they ask for: ``want``, a path, or ``want_stem``, a note's stem.

    A bare name asks for a stem, wherever it stands; anything else for an exact path.
    """
    local = links.filter(~L.is_external("raw_target"))
    wiki = F.col("link_kind") == "wikilink"
    if "fragment" in links.columns:
        local = local.withColumn("fragment", F.when(wiki, F.col("fragment")).otherwise(L.fragment("raw_target")))
    target = L.percent_decoded(F.when(wiki, F.col("raw_target")).otherwise(L.without_fragment("raw_target")))
    name = F.regexp_replace(target, r"^\./", "")
    bare = wiki & ~name.contains("/") & (P.extension(name) == "")
    some = target != ""
    want = F.when(some & wiki & ~bare, name).when(some & ~wiki, P.join_clean(P.dirname("source_path"), target))
    return local.withColumns({"want": want, "want_stem": F.when(some & bare, name)})


def stem_candidates(files: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """Per stem of notes: how many have it, and the first ``most`` of them in order, once for all links."""
    notes = files.filter("kind = 'note'").select("stem", F.struct(F.col("path").alias("candidate"), F.col("kind").alias("candidate_kind")).alias("c"))
    n = notes.groupBy("stem").agg(F.count("*").alias("n"))
    first = notes.withColumn("k", F.row_number().over(Window.partitionBy("stem").orderBy("c"))).filter(F.col("k") <= most)
    return first.groupBy("stem").agg(F.array_sort(F.collect_list("c")).alias("found")).join(n, "stem").select(F.col("stem").alias("want_stem"), "n", "found")


def resolve_links(links: DataFrame, files: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """Add resolution_status, resolved_target_path, target_kind, candidate_count, candidate_paths to local links; other than wikilinks get the fragment of their target.

    links: source_path, link_kind, raw_target, ...; external targets of wikilinks
    and markdown links are left out.  ``candidate_paths`` of an ambiguous link has the
    first ``most`` paths in order; ``link_candidates`` has all, as rows.
    """
    local = wanted(links)
    file = lambda rows: rows.select(F.col("path").alias("candidate"), F.col("kind").alias("candidate_kind"))
    asked = local.filter("want IS NOT NULL").select("want").distinct()
    exact = asked.join(file(files), F.col("want") == F.col("candidate"))
    with_md = asked.filter(P.extension("want") == "").join(file(files.filter("kind = 'note'")), F.concat("want", F.lit(".md")) == F.col("candidate"))
    # a path asks for two files at most
    by_path = exact.unionByName(with_md).groupBy("want").agg(F.array_sort(F.collect_set(F.struct("candidate", "candidate_kind"))).alias("found"))
    by_path = by_path.select("want", F.size("found").cast("long").alias("n"), "found")
    of_paths = local.filter("want_stem IS NULL").join(by_path, "want", "left")
    of_stems = local.filter("want_stem IS NOT NULL").join(stem_candidates(files, most), "want_stem", "left")
    out = of_paths.unionByName(of_stems)
    n = F.coalesce("n", F.lit(0).cast("long"))
    one = F.get("found", F.lit(0))
    return out.withColumns({
        "resolution_status": F.when(n == 0, F.lit("unresolved")).when(n == 1, F.lit("resolved")).otherwise(F.lit("ambiguous")),
        "resolved_target_path": F.when(n == 1, one["candidate"]),
        "target_kind": F.when(n == 1, one["candidate_kind"]),
        "candidate_count": n,
        "candidate_paths": F.when(n > 1, F.transform("found", lambda x: x["candidate"])).otherwise(F.array().cast("array<string>")),
    }).drop("found", "n", "want", "want_stem")


def link_candidates(links: DataFrame, files: DataFrame) -> DataFrame:
    """The long form: one row for each link and each file it may mean."""
    local = wanted(links)
    key = [c for c in ("source_path", "ordinal", "link_kind", "raw_target") if c in links.columns]
    candidate = files.select(F.col("path").alias("candidate_path"), "kind", "stem")
    notes = candidate.filter("kind = 'note'")
    bare = local.filter("want_stem IS NOT NULL").join(notes, F.col("want_stem") == F.col("stem"))
    paths = local.filter("want IS NOT NULL")
    exact = paths.join(candidate, F.col("want") == F.col("candidate_path"))
    with_md = paths.filter(P.extension("want") == "").join(notes, F.concat("want", F.lit(".md")) == F.col("candidate_path"))
    rows = [r.select(*key, "candidate_path") for r in (bare, exact, with_md)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def degrees(edges: DataFrame, notes: DataFrame, neighbor_mode: str = "documented") -> DataFrame:
    """Seven counters per note; neighbours are distinct and never the note itself.

    ``neighbor_mode="observed"`` swaps the two neighbour columns.
    """
    one = lambda c: F.count_if(c).alias
    to_note = (F.col("resolution_status") == "resolved") & (F.col("target_kind") == "note")
    self_ = to_note & (F.col("resolved_target_path") == F.col("source_path"))
    out = edges.groupBy(F.col("source_path").alias("path")).agg(
        F.count("*").alias("outgoing_edge_count"),
        one(self_)("self_link_count"),
        one(F.col("resolution_status") == "unresolved")("unresolved_link_count"),
        one(F.col("resolution_status") == "ambiguous")("ambiguous_link_count"),
    )
    pairs = edges.filter(to_note).groupBy("source_path", "resolved_target_path").agg(F.count("*").alias("n"))
    other = F.col("source_path") != F.col("resolved_target_path")
    given = pairs.groupBy(F.col("source_path").alias("path")).agg(F.count_if(other).alias("outgoing_neighbor_count"))
    got = pairs.groupBy(F.col("resolved_target_path").alias("path")).agg(F.sum("n").alias("incoming_edge_count"), F.count_if(other).alias("incoming_neighbor_count"))
    joined = notes.select("path").join(out, "path", "left").join(given, "path", "left").join(got, "path", "left").fillna(0)
    if neighbor_mode == "observed":
        joined = joined.withColumnsRenamed({"outgoing_neighbor_count": "x", "incoming_neighbor_count": "outgoing_neighbor_count"}).withColumnRenamed("x", "incoming_neighbor_count")
    return joined.select("path", "incoming_edge_count", "outgoing_edge_count", "incoming_neighbor_count", "outgoing_neighbor_count", "self_link_count", "unresolved_link_count", "ambiguous_link_count")


def orphans(degree: DataFrame) -> DataFrame:
    """Notes of an orphan class with their three flags and counters."""
    i, o = F.col("incoming_neighbor_count"), F.col("outgoing_neighbor_count")
    flagged = degree.withColumns({"hard_orphan": (i == 0) & (o == 0), "no_backlink": i == 0, "outbound_only": (i == 0) & (o > 0)})
    return flagged.filter("hard_orphan OR no_backlink OR outbound_only")


def broken_links(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("resolution_status").isin("unresolved", "ambiguous"))


def tag_index(tags: DataFrame, with_lists: bool = True) -> DataFrame:
    """Per tag: occurrences, notes, and (where wanted) variants and note paths.

    Lists of a hot tag grow with its notes; ``tag_notes`` gives them as rows.
    """
    per_note = tags.groupBy("tag", "path").agg(F.count("*").alias("n"), F.collect_set("variant").alias("v"))
    lists = (F.array_sort(F.array_distinct(F.flatten(F.collect_set("v")))).alias("variants"), F.array_sort(F.collect_list("path")).alias("note_paths")) if with_lists else ()
    return per_note.groupBy("tag").agg(F.count("*").alias("note_count"), F.sum("n").alias("occurrence_count"), *lists)


def tag_notes(tags: DataFrame) -> DataFrame:
    """The long form of the tag index: one row per tag and note."""
    return tags.groupBy("tag", "path").agg(F.count("*").alias("occurrences"))


def frontmatter_stats(parsed: DataFrame) -> DataFrame:
    """Per field: notes that have it, nulls among them, notes by type."""
    fields = parsed.select(F.explode("frontmatter").alias("field", "type")).groupBy("field", "type").agg(F.count("*").alias("n"))
    return fields.groupBy("field").agg(F.sum("n").alias("present_count"), F.sum(F.when(F.col("type") == "null", F.col("n")).otherwise(0)).alias("null_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("type_counts"))


def notes_with_frontmatter(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count_if("frontmatter_present").alias("notes_with_frontmatter"))


def broken_groups(broken: DataFrame) -> DataFrame:
    return broken.groupBy(F.col("resolution_status").alias("status"), F.col("raw_target").alias("target"), P.top_folder("source_path").alias("folder")).agg(F.count("*").alias("n"))


def orphan_folders(orphan_rows: DataFrame) -> DataFrame:
    return orphan_rows.groupBy(P.top_folder("path").alias("folder")).agg(F.count_if("hard_orphan").alias("hard"), F.count_if("no_backlink").alias("no_backlink"), F.count_if("outbound_only").alias("outbound_only"))


def file_records(files: DataFrame, degree: DataFrame, tags: DataFrame) -> DataFrame:
    """Files with counters and sorted tags."""
    listed = tags.groupBy("path").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return files.join(degree, "path", "left").join(listed, "path", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))).fillna(0)


def corpus_counts(files: DataFrame, edges: DataFrame, orphan_rows: DataFrame, tags: DataFrame, warnings: DataFrame) -> DataFrame:
    """Ten counts of a corpus in one row."""
    a = files.agg(F.count("*").alias("eligible_files"), F.count_if(F.col("kind") == "note").alias("notes"), F.count_if(F.col("kind") == "attachment").alias("attachments"))
    b = edges.agg(F.count("*").alias("link_occurrences"), F.count_if(F.col("resolution_status") != "resolved").alias("broken_links"))
    c = orphan_rows.agg(F.count_if("hard_orphan").alias("hard_orphans"), F.count_if("no_backlink").alias("no_backlink_notes"), F.count_if("outbound_only").alias("outbound_only_notes"))
    d = tags.agg(F.count_distinct("tag").alias("tags"))
    e = warnings.agg(F.count("*").alias("warnings"))
    # five rows in all: each side is a total
    return a.join(b).join(c).join(d).join(e)
