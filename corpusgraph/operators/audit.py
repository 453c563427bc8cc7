"""Publication audit of documents (path, text): only names of findings leave, never values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import kept

# Credential and privacy shapes, and names of credential files.
SECRET = r"(AIza[0-9A-Za-z_-]{35}|gh[pousr]_[0-9A-Za-z]{20,}|github_pat_[0-9A-Za-z_]{20,}|AKIA[0-9A-Z]{16}|GOCSPX-[0-9A-Za-z_-]{20,}|1//[0-9A-Za-z_-]{20,}|-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----)"
PRIVATE = r"(/Users/[^/\s]+|/home/[^/\s]+|[A-Za-z0-9._%+-]+@(gmail\.com|icloud\.com|outlook\.com|hotmail\.com))"
CREDENTIAL_FILE = r"(^|/)(rclone\.conf|credentials\.json|token\.json|client_secret_[^/]+\.json|[^/]*service-account[^/]*\.json|application_default_credentials\.json|[^/]+\.(pem|key|p12|pfx|jks|keystore))$"
# lengths of grams in bytes by which needles are looked up, size of the bitmap, bytes of a text that are hashed at once
GRAMS, BITS, STEP = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32), 1 << 26, 1 << 20


def needles(lines: DataFrame) -> DataFrame:
    """Denylist lines (needle) without blank lines and comments."""
    return lines.filter((F.col("needle") != "") & ~F.startswith("needle", F.lit("#"))).distinct()


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q bytes from each place on."""
    with np.errstate(over="ignore"):
        x = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h = np.zeros(max(0, len(data) - q + 1), np.uint64)
        for k in range(q):
            h = h * np.uint64(0xC2B2AE3D27D4EB4F) + x[k : len(data) - q + 1 + k]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(29)) ^ np.uint64(q)


def anchors(lines: DataFrame) -> DataFrame:
    """needle, q, h: each needle's anchor, the gram of q bytes in it (the longest length of GRAMS that fits) with the smallest hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for needle in b.column(0).to_pylist():
                raw = np.frombuffer(needle.encode("utf-8"), np.uint8)
                q = max(g for g in GRAMS if g <= len(raw))
                found.append((needle, q, int(gram_hashes(raw, q).min().view(np.int64))))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64()))], ["needle", "q", "h"])

    return needles(lines).select("needle").mapInArrow(run, "needle string, q int, h long")


def _place(h: np.ndarray) -> np.ndarray:
    return h & np.uint64(BITS - 1)


def _marked(found: DataFrame) -> tuple[list[int], bytes]:
    """Lengths of anchors in use, and a bitmap of BITS bits with their hashes: as large for any number of needles."""
    place = F.col("h").bitwiseAND(F.lit(BITS - 1)) + 1
    rows = found.withColumn("place", place).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"), F.collect_set("q").alias("q")).collect()
    out = bytearray(BITS // 8)
    for r in rows:
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = r["bits"]
    return sorted({q for r in rows for q in r["q"]}), bytes(out)


def denied(docs: DataFrame, lines: DataFrame, key: str = "path") -> DataFrame:
    """(key, needle) of exact hits; any number of needles of any length.

    A text that holds a needle holds its anchor.  Texts look their grams up in a bitmap
    of all anchors, of fixed size, and only grams that are marked leave the task; these
    meet the needles by hash, and what meets is searched.
    """
    found = kept(anchors(lines))
    lengths, bits = _marked(found)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            row, hit = [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                raw = np.frombuffer((text or "").encode("utf-8"), np.uint8)
                for q in lengths:
                    for at in range(0, len(raw) - q + 1, STEP):  # long texts a stretch at a time
                        h = gram_hashes(raw[at : at + STEP + q - 1], q)
                        place = _place(h)
                        h = np.unique(h[(marked[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0])
                        row += [k] * len(h)
                        hit.append(h)
            h = np.concatenate(hit) if hit else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int32())), pa.array(h.view(np.int64))], [key, "h"])

    met = docs.select(key, "text").mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, h long")
    pairs = met.join(found.select("h", "needle"), "h").select(key, "needle").distinct()
    return docs.select(key, "text").join(pairs, key).filter(F.contains("text", "needle")).select(key, "needle")


def audit(docs: DataFrame, lines: DataFrame | None = None, exempt: tuple[str, ...] = ()) -> DataFrame:
    """docs' key columns with flags of each finding and the verdict BLOCKED, REVIEW or PASS."""
    flags = docs.select(
        "path",
        F.coalesce(F.col("text").rlike(SECRET), F.lit(False)).alias("secret"),
        (F.coalesce(F.col("text").rlike(PRIVATE), F.lit(False)) & ~F.col("path").isin(*exempt)).alias("private"),
        F.col("path").rlike(CREDENTIAL_FILE).alias("credential_file"),
    )
    if lines is not None:
        hit = denied(docs, lines).select("path").distinct().withColumn("denylisted", F.lit(True))
        flags = flags.join(hit, "path", "left").withColumn("denylisted", F.coalesce("denylisted", F.lit(False)))
    else:
        flags = flags.withColumn("denylisted", F.lit(False))
    block = F.col("secret") | F.col("credential_file") | F.col("denylisted")
    return flags.withColumn("verdict", F.when(block, "BLOCKED").when(F.col("private"), "REVIEW").otherwise("PASS"))


def overall(flags: DataFrame) -> DataFrame:
    severity = F.max(F.when(F.col("verdict") == "BLOCKED", 2).when(F.col("verdict") == "REVIEW", 1).otherwise(0))
    return flags.agg(F.coalesce(severity, F.lit(0)).alias("severity")).select(F.when(F.col("severity") == 2, "BLOCKED").when(F.col("severity") == 1, "REVIEW").otherwise("PASS").alias("verdict"))
