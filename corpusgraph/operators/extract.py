"""Facts of markdown documents: links, tags, frontmatter, warnings.

Links and tags are column functions (``markup``).  Python runs for the YAML of
frontmatter alone: a vectorised function gets that piece of a note, nothing else.
Ordinals, tag and alias rules and the warning stream are native again.
"""

from __future__ import annotations

import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.links import normal_tag
from . import markup

VALUE = "struct<kind:string,items:array<struct<kind:string,value:string>>,value:string>"
DECODED = f"frontmatter map<string,string>, tags_field {VALUE}, aliases_field {VALUE}, malformed boolean"


def value_kind(v: object) -> str:
    """Type name of a decoded frontmatter value; dates count as strings."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (str, datetime.date)):
        return "string"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, list):
        return "sequence"
    return "mapping" if isinstance(v, dict) else "other"


def _field(v: object, present: bool) -> dict | None:
    if not present:
        return None
    items = [{"kind": value_kind(x), "value": x if isinstance(x, str) else None} for x in v] if isinstance(v, list) else None
    return {"kind": value_kind(v), "items": items, "value": v if isinstance(v, str) else None}


def _fields(front: str | None) -> tuple:
    import yaml

    data: object = {}
    try:
        data = yaml.load(front, getattr(yaml, "CSafeLoader", yaml.SafeLoader)) if front is not None else {}
        malformed = not isinstance(data, dict | None)
    except Exception:
        malformed = True
    data = {} if malformed or data is None else data
    return {str(k): value_kind(v) for k, v in data.items()}, _field(data.get("tags"), "tags" in data), _field(data.get("aliases"), "aliases" in data), malformed


def _decoded(front: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_fields(f) for f in front], columns=["frontmatter", "tags_field", "aliases_field", "malformed"])


def extract_facts(notes: DataFrame) -> DataFrame:
    """One row per note of (path, content): frontmatter, facts in order, warnings."""
    front, body = markup.front_and_body(F.coalesce("content", F.lit("")))
    found = notes.select("path", front.alias("front"), body.alias("body")).withColumn("masked", markup.without_blocks(F.col("body"))).select("path", "front", markup.facts_of(F.col("masked")).alias("facts"))
    decoded = found.select("path", F.col("front").isNotNull().alias("frontmatter_present"), "facts", F.pandas_udf(_decoded, DECODED)("front").alias("yaml"))
    malformed = F.when(F.col("yaml.malformed"), F.array(F.lit("frontmatter_malformed"))).otherwise(F.array().cast("array<string>"))
    return decoded.select("path", "frontmatter_present", "yaml.frontmatter", "yaml.tags_field", "yaml.aliases_field", "facts", malformed.alias("warnings"))


def numbered(parsed: DataFrame) -> DataFrame:
    """One row per fact with its ordinal in the document (links and tags share one sequence)."""
    return parsed.select("path", F.posexplode("facts").alias("ordinal", "fact")).select("path", "ordinal", "fact.*")


def link_facts(parsed: DataFrame) -> DataFrame:
    return numbered(parsed).filter("kind <> 'tag'").withColumnsRenamed({"path": "source_path", "kind": "link_kind"})


def tag_facts(parsed: DataFrame) -> DataFrame:
    """Tag occurrences: path, tag (normalised), variant; frontmatter tags and hashtags."""
    inline = numbered(parsed).filter("kind = 'tag'").select("path", F.col("raw_target").alias("raw"), "display")
    t = F.col("tags_field")
    listed = F.when(t["kind"] == "string", F.array(t["value"])).when(t["kind"] == "sequence", F.transform(F.filter(t["items"], lambda x: x["value"].isNotNull()), lambda x: x["value"]))
    front = parsed.select("path", F.explode(listed).alias("raw")).select("path", "raw", F.col("raw").alias("display"))
    return inline.unionByName(front).select("path", normal_tag("raw").alias("tag"), F.col("display").alias("variant")).filter("tag <> ''")


def warning_rows(parsed: DataFrame) -> DataFrame:
    """Warnings of the parser and of tag and alias types: code, path, message."""
    t, a = F.col("tags_field"), F.col("aliases_field")
    tag_items = F.transform(F.filter(t["items"], lambda x: x["value"].isNull()), lambda x: F.struct(F.lit("frontmatter_tag_type_unsupported").alias("code"), F.lit("tags sequence contains a non-scalar value").alias("message")))
    none = F.array().cast("array<struct<code:string,message:string>>")
    one = lambda code, message: F.array(F.struct(F.lit(code).alias("code"), F.lit(message).alias("message")))
    tags = F.when(t["kind"] == "sequence", tag_items).when(t.isNotNull() & ~t["kind"].isin("string", "null"), one("frontmatter_tag_type_unsupported", "tags must be a scalar or sequence of scalars"))
    odd = F.exists(a["items"], lambda x: x["value"].isNull() & (x["kind"] != "null"))
    aliases = F.when((a["kind"] == "sequence") & odd, one("frontmatter_alias_type_unsupported", "aliases sequence contains a non-scalar value")).when(
        a.isNotNull() & ~a["kind"].isin("string", "null", "sequence"), one("frontmatter_alias_type_unsupported", "aliases must be a scalar or sequence")
    )
    parsed_w = F.transform("warnings", lambda w: F.struct(w.alias("code"), F.lit("frontmatter could not be decoded").alias("message")))
    every = F.concat(parsed_w, F.coalesce(tags, none), F.coalesce(aliases, none))
    return parsed.select("path", F.explode(every).alias("w")).select(F.col("w.code").alias("code"), "path", F.col("w.message").alias("message"))
