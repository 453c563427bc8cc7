"""Column functions over link targets, tags and digests of contracts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import col


def is_external(target: Column | str) -> Column:
    """Targets that stay out of the graph: fragments, network paths, anything with a colon."""
    t = col(target)
    return t.startswith("#") | t.startswith("//") | t.contains(":")


def without_fragment(target: Column | str) -> Column:
    return F.substring_index(col(target), "#", 1)


def fragment(target: Column | str) -> Column:
    t = col(target)
    return F.when(F.instr(t, "#") > 0, F.substring(t, F.instr(t, "#") + 1, F.length(t))).otherwise(F.lit(""))


def percent_decoded(target: Column | str) -> Column:
    """Path decoding: ``+`` stays, a bad escape gives null."""
    return F.try_url_decode(F.replace(col(target), F.lit("+"), F.lit("%2B")))


def normal_tag(tag: Column | str) -> Column:
    return F.lower(F.regexp_replace(col(tag), "^#", ""))


def framed_digest(*parts: Column | str) -> Column:
    """SHA-256 of parts joined by NUL."""
    return F.sha2(F.concat_ws("\x00", *(col(p) for p in parts)).cast("binary"), 256)


def policy_hash(content: Column | str) -> Column:
    """Hash of a policy's content: no policy is ``empty``, an empty one hashes like nothing."""
    c = col(content)
    return F.when(c.isNull(), F.lit("empty")).otherwise(F.sha2(c.cast("binary"), 256))


# Names and versions that the digests of a contract are framed with.
CONTRACT = ("eligibility-contract-v1", "regular-file-v1", "no-follow-symlink-v1", "system-reservation-v1")
BINDING = "derived-binding-v1"


def contract_hash(policy: Column | str, max_size: Column | str) -> Column:
    """Digest of all that decides on eligibility: the policy's hash, the size limit and the versions of the fixed rules."""
    name, *rules = map(F.lit, CONTRACT)
    return framed_digest(name, policy, col(max_size).cast("string"), *rules, F.lit(""))


def binding_digest(remote: Column | str, folder: Column | str) -> Column:
    """Identity of a remote root: its name, with or without the colon, and its folder."""
    return framed_digest(F.lit(BINDING), F.regexp_replace(col(remote), ":$", ""), folder)


def parsed_time(text: Column | str) -> Column:
    """A UTC timestamp in the extended ISO form with optional fraction; null otherwise."""
    return F.try_to_timestamp(F.regexp_replace(col(text), "Z$", "+00:00"))
