"""The whole corpus compile as one job graph: scan, policy, facts, links, indexes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extract, graph, policy
from ..operators.blocks import kept
from . import publish


@dataclass
class Compiled:
    files: DataFrame
    parsed: DataFrame
    links: DataFrame
    degrees: DataFrame
    orphans: DataFrame
    broken: DataFrame
    tags: DataFrame
    warnings: DataFrame

    def artifacts(self) -> dict[str, DataFrame]:
        """The named artifacts in their contract order."""
        records = graph.file_records(self.files, self.degrees, self.tags)
        return {
            "FILE_INDEX": records.orderBy("path"),
            "LINKS": self.links.orderBy("source_path", "ordinal"),
            "ORPHANS": self.orphans.orderBy("path"),
            "BROKEN_LINKS": self.broken.orderBy("resolution_status", "raw_target", "source_path"),
            "TAG_INDEX": graph.tag_index(self.tags).orderBy("tag"),
            "WARNINGS": self.warnings.orderBy("path", "code", "message"),
            "FRONTMATTER_STATS": graph.frontmatter_stats(self.parsed).orderBy("field"),
        }

    def pages(self, generation: str, compiled_at: str = "", contract: str = "") -> dict[str, DataFrame]:
        """The markdown pages of a generation."""
        counts = self.counts()
        return {
            "README.md": publish.readme_summary(counts, generation),
            "HEALTH.md": publish.health_summary(counts, generation, compiled_at, contract, graph.notes_with_frontmatter(self.parsed)),
            "ORPHANS.md": publish.orphan_summary(graph.orphan_folders(self.orphans), generation),
            "BROKEN.md": publish.broken_page(graph.broken_groups(self.broken), generation),
        }

    def counts(self) -> DataFrame:
        return graph.corpus_counts(self.files, self.links, self.orphans, self.tags, self.warnings)

    def release(self) -> None:
        for df in (self.parsed, self.links):
            df.unpersist()


def compile_corpus(entries: DataFrame, keep: bool = False, neighbor_mode: str = "documented") -> Compiled:
    """Compile eligible (path, content) rows.

    Several artifacts share facts and links; ``keep=True`` keeps the two: as checkpoints
    where the session names a folder for them, else persisted (with the disk as
    overflow) until ``release``.  Bodies are gone after extraction.
    """
    files = graph.as_files(entries.select("path"))
    notes = graph.as_files(entries).filter("kind = 'note'").select("path", "content")
    parsed = kept(extract.extract_facts(notes)) if keep else extract.extract_facts(notes)
    links = graph.resolve_links(extract.link_facts(parsed), files)
    if keep:
        links = kept(links)
    degree = graph.degrees(links, files.filter("kind = 'note'"), neighbor_mode)
    return Compiled(files, parsed, links, degree, graph.orphans(degree), graph.broken_links(links), extract.tag_facts(parsed), extract.warning_rows(parsed))


def eligible(scan: DataFrame, cap: int = 0) -> DataFrame:
    """Scan rows (with content) with their status under the ignore files in the scan."""
    rules = policy.compiled(policy.taken_policy(scan)).filter("warning IS NULL")
    verdicts = policy.ignored(scan.select("path", F.lit(False).alias("is_dir")), rules)
    return policy.eligibility(scan, verdicts, cap)
