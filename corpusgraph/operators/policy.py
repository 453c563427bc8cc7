"""Ignore policies: patterns with scopes, negation and nesting, structured rules, overlaps.

Patterns become anchored regular expressions, compiled once where their files are.  A path is decided from
the root down: at every ancestor the last rule that matches wins, and an ignored
folder hides all below it, so a negation cannot reach into it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from .blocks import kept

LITERAL = 200


@dataclass(frozen=True)
class Rule:
    scope: str
    ord: int
    regex: str
    negated: bool
    dir_only: bool
    source: str
    line: int
    pattern: str


@lru_cache(4096)
def _compiles(regex: str) -> bool:
    try:
        re.compile(regex)
    except re.error:
        return False
    return True


def glob_regex(glob: str, classes: list[str] | None = None) -> str:
    """One pattern segment list as a regular expression over a path relative to its scope; its character classes go into ``classes``."""
    if not any(c in glob for c in "*?[\\"):
        return re.escape(glob)
    out, i, n = [], 0, len(glob)
    while i < n:
        c = glob[i]
        if glob.startswith("**", i):
            alone = (i == 0 or glob[i - 1] == "/") and (i + 2 == n or glob[i + 2] == "/")
            if alone and i + 2 < n:
                out.append("(?:[^/]+/)*")
                i += 3
                continue
            out.append(".*" if alone else "[^/]*")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[":
            j = i + 1
            if j < n and glob[j] in "!^":
                j += 1
            if j < n and glob[j] == "]":
                j += 1
            while j < n and glob[j] != "]":
                j += 2 if glob[j] == "\\" else 1
            if j >= n:
                raise ValueError("character class isn't closed")
            body = glob[i + 1 : j]
            neg = body[:1] in ("!", "^") and len(body) > 1
            body = body[1:] if neg else body
            out.append(f"(?!/)[{'^' if neg else ''}" + re.sub(r"([\[&~^])", r"\\\1", body) + "]")
            if classes is not None:
                classes.append(out[-1])
            i = j + 1
        elif c == "\\":
            if i + 1 >= n:
                raise ValueError("pattern ends in an escape")
            out.append(re.escape(glob[i + 1]))
            i += 2
        else:
            out.append(re.escape(c))
            i += 1
    return "".join(out)


def compile_line(source: str, scope: str, k: int, line: str, ord_: int) -> Rule | tuple[str, int, str, str] | None:
    """The rule of line k of an ignore file, a warning (file, line, pattern, message), or nothing."""
    pattern = re.sub(r"(?<!\\)[ \t]+$", "", line)
    if not pattern or pattern.startswith("#"):
        return None
    glob, negated = (pattern[1:], True) if pattern.startswith("!") else (pattern, False)
    dir_only = glob.endswith("/")
    glob = glob.rstrip("/")
    anchored = "/" in glob
    glob = glob.removeprefix("/")
    if not glob:
        return None
    try:
        body = glob_regex(glob, classes := [])
        if not all(map(_compiles, classes)):  # all else compiles
            re.compile(body)
    except (ValueError, re.error) as e:
        return source, k, pattern, str(e)
    return Rule(scope, ord_, "^" + ("" if anchored else "(?:.*/)?") + body + "$", negated, dir_only, source, k, pattern)


def compile_policy(files: list[tuple[str, str, str]]) -> tuple[list[Rule], list[tuple[str, int, str, str]]]:
    """Rules and warnings (file, line, pattern, message) of (relative_path, scope_dir, content), parents first."""
    rules, warnings = [], []
    for source, scope, content in files:
        for k, line in enumerate(content.splitlines(), 1):
            made = compile_line(source, scope, k, line, len(rules))
            if made is not None:
                (rules if isinstance(made, Rule) else warnings).append(made)
    return rules, warnings


RULES = "scope string, ord long, regex string, negated boolean, dir_only boolean, kind string, key string, source string, line int, pattern string"


def index_key(glob: str) -> tuple[str, str]:
    """How a pattern (without its slashes at the ends) can be looked up, and under what.

    name: the last segment is equal; path: the whole path below the scope is; ext: the
    end of the last segment from its last dot on is; under: the first segment is; scan:
    nothing is known, every path below the scope has to be tried.
    """
    wild = lambda t: any(c in t for c in "*?[\\")
    glob, anchored = glob.removeprefix("/"), "/" in glob
    bare = glob.removeprefix("**/")
    if "/" not in bare and (not anchored or bare != glob):
        if not wild(bare):
            return "name", bare
        if bare.startswith("*.") and not wild(bare[2:]) and "." not in bare[2:]:
            return "ext", bare[1:]
        return "scan", ""
    if not anchored:
        return "scan", ""
    if not wild(glob):
        return "path", glob
    first = glob.split("/", 1)[0]
    return ("under", first) if not wild(first) and "/" in glob else ("scan", "")


def _row(r: Rule, ord_: int) -> tuple:
    return r.scope, ord_, r.regex, r.negated, r.dir_only, *index_key(r.pattern.removeprefix("!").rstrip("/")), r.source, r.line, r.pattern


def rule_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules that were compiled on the driver, as rows."""
    return spark.createDataFrame([_row(r, r.ord) for r in rules], RULES)


# where Python's splitlines ends a line
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def compiled(files: DataFrame) -> DataFrame:
    """Rules and warnings of ignore files (path, scope, content), compiled where the files are, line by line.

    ``ord`` orders the rules that can meet one path: by depth of their scope, then line.
    A pattern that can't be compiled is a row with a ``warning`` and no regex.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in RULES.split(", ")]
        for pdf in batches:
            rows: list[tuple] = []
            for path, scope, k, line in zip(pdf["path"], pdf["scope"], pdf["k"], pdf["line"]):
                ord_ = (len(scope.split("/")) if scope else 0) << 32 | k
                made = compile_line(path, scope, k, line, ord_)
                if isinstance(made, Rule):
                    rows.append((*_row(made, ord_), None))
                elif made:
                    source, _, pattern, text = made
                    rows.append((scope, ord_, None, None, None, None, None, source, k, pattern, text))
            yield pd.DataFrame(rows, columns=[*names, "warning"]).astype({"negated": object, "dir_only": object})

    # a batch of lines is small, whatever the files hold
    lines = files.select("path", "scope", F.posexplode(F.split(F.coalesce("content", F.lit("")), LINE_END)).alias("k", "line"))
    return lines.select("path", "scope", (F.col("k") + 1).alias("k"), "line").mapInPandas(run, RULES + ", warning string")


def taken_policy(files: DataFrame) -> DataFrame:
    """Ignore files (path, content) with their scope, without those an outer file ignores and those under ``.git``.

    Goes down one level of folders that hold any at a time; what is left of a level
    decides on the next.
    """
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    found = kept(files.filter((P.basename("path") == ".gitignore") & ~F.array_contains(folders, ".git")).select("path", P.dirname("path").alias("scope"), "content", F.size(folders).alias("depth")))
    taken = found.filter("depth = 0").drop("depth")
    for r in found.filter("depth > 0").select("depth").distinct().orderBy("depth").collect():  # as many as the tree is deep
        level = found.filter(F.col("depth") == r["depth"]).drop("depth")
        rules = compiled(taken).filter("warning IS NULL")
        hidden = ignored(level.select(F.col("scope").alias("path"), F.lit(True).alias("is_dir")), rules).filter("ignored").select(F.col("path").alias("scope"))
        taken = kept(taken.unionByName(level.join(hidden, "scope", "left_anti").select("path", "scope", "content")))
    return taken


def prefixes(path: Column, is_dir: Column) -> Column:
    """The path and every folder above it: prefix, whether it is a folder, its depth."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("prefix"), (is_dir | (n < F.size(parts))).alias("dir"), n.alias("depth")))


def _last_rule(rules: list) -> Column:
    """Whether the last rule that matches a prefix is negated; null where none does."""
    out = [F.lit(None).cast("boolean")]
    for r in sorted(rules, key=lambda r: r["ord"]):
        scope, prefix = r["scope"], F.col("prefix")
        hit = (F.substring(prefix, len(scope) + 2, 1 << 30) if scope else prefix).rlike(r["regex"])
        hit = prefix.startswith(scope + "/") & hit if scope else hit
        out.append(F.when(F.col("dir") & hit if r["dir_only"] else hit, F.lit(r["negated"])))
    return F.coalesce(*out[::-1])


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (path, is_dir) with ``ignored``.

    Each distinct prefix is decided once: by one expression of up to LITERAL rules
    (their patterns are compiled once a task), by equi-joins with an index of the rules
    of a larger policy (scope, and a name, path, extension or first segment); only
    patterns that have none of these are tried on every path below their scope.  A
    prefix that no rule touches takes no part afterwards.
    """
    own = paths.select("path", "is_dir").distinct()
    each = own.select("path", "is_dir", F.explode(prefixes(F.col("path"), F.col("is_dir"))).alias("p")).select("path", "is_dir", "p.*")
    unique = each.select("prefix", "dir").distinct()
    few = rules.limit(LITERAL + 1).collect()
    if len(few) <= LITERAL:
        verdict = unique.filter(~_last_rule(few))
    else:
        # each prefix asks at every scope above it that may have rules, by each kind of key there is
        deepest = {r["kind"]: r["depth"] for r in rules.groupBy("kind").agg(F.max(F.when(F.col("scope") == "", 0).otherwise(F.size(F.split("scope", "/")))).alias("depth")).collect()}
        parts = F.split("prefix", "/")
        above = F.transform(F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(max(deepest.values())))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        asked = unique.withColumn("scope", F.explode(above))
        asked = asked.withColumn("rel", F.when(F.col("scope") == "", F.col("prefix")).otherwise(F.substring(F.col("prefix"), F.length("scope") + 2, F.length("prefix"))))
        keys = {"name": P.basename("prefix"), "path": F.col("rel"), "ext": F.regexp_extract("prefix", r"(\.[^./]*)$", 1), "under": F.substring_index("rel", "/", 1), "scan": F.lit("")}
        asked = asked.withColumn("k", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in keys.items() if k in deepest)))).select("prefix", "dir", "scope", "rel", "k.kind", "k.key")
        hits = asked.join(rules.select("scope", "kind", "key", "ord", "regex", "negated", "dir_only"), ["scope", "kind", "key"]).filter((~F.col("dir_only") | F.col("dir")) & F.regexp_like("rel", F.col("regex")))
        verdict = hits.groupBy("prefix", "dir").agg(F.max_by("negated", "ord").alias("keep")).filter("NOT keep").select("prefix", "dir")
    hidden = each.join(verdict, ["prefix", "dir"]).select("path", "is_dir").distinct().withColumn("ignored", F.lit(True))
    return own.join(hidden, ["path", "is_dir"], "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))


def eligibility(entries: DataFrame, verdicts: DataFrame, cap: int = 0, root: str = P.RESERVED) -> DataFrame:
    """Entries with a status: symlink, irregular, reserved, ignored, oversize or eligible."""
    joined = entries.join(verdicts.filter("NOT is_dir").select("path", "ignored"), "path", "left")
    over = F.lit(cap > 0) & (F.col("size") > cap)
    status = (
        F.when(P.is_reserved("path", root), "reserved")
        .when(F.coalesce("ignored", F.lit(False)), "ignored")
        .when(F.col("is_symlink"), "symlink")
        .when(~F.col("is_regular"), "irregular")
        .when(over, "oversize")
        .otherwise("eligible")
    )
    return joined.withColumn("status", status).drop("ignored")


def legacy_reason(path: Column, rules: list[tuple[str, str]]) -> Column:
    """Reason (kind:value) of the first structured rule that excludes a path, or null."""
    out = F.lit(None).cast("string")
    dirs = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    for kind, value in reversed(rules):
        v = value.strip()
        if not v:
            continue
        if kind == "exclude_path_prefix":
            v = v.strip("/")
            hit = (path == v) | path.startswith(v + "/")
        elif kind == "exclude_dir_name":
            hit = F.array_contains(dirs, v)
        elif kind == "exclude_filename":
            hit = P.basename(path) == v
        elif kind == "exclude_extension":
            hit = F.lower(P.extension(path)) == "." + v.lower().removeprefix(".")
        else:
            continue
        out = F.when(hit, F.lit(f"{kind}:{value}")).otherwise(out)
    return out


def legacy_excluded(df: DataFrame, rules: list[tuple[str, str]], cap: int = 0) -> DataFrame:
    reason = legacy_reason(F.col("path"), rules)
    if cap > 0:
        reason = F.coalesce(reason, F.when(F.col("size") > cap, F.lit("oversize")))
    return df.withColumn("reason", reason)


def legacy_to_patterns(rules: DataFrame) -> DataFrame:
    """Structured rules (kind, value) as ignore patterns."""
    escaped = lambda c: F.regexp_replace(c, r"([*?\[\]!#\\])", r"\\$1")
    v = F.trim("value")
    bare = F.regexp_replace(v, "^/", "")
    letters = F.filter(F.split(F.regexp_replace(v, r"^\.", ""), ""), lambda c: c != "")
    folded = F.array_join(F.transform(letters, lambda c: F.when(c.rlike("[a-z]"), F.concat(F.lit("["), c, F.upper(c), F.lit("]"))).when(c.rlike("[A-Z]"), F.concat(F.lit("["), F.lower(c), c, F.lit("]"))).otherwise(c)), "")
    kind = F.col("kind")
    pattern = (
        F.when((kind == "exclude_path_prefix") & (bare != ""), F.concat(F.lit("/"), escaped(bare)))
        .when((kind == "exclude_dir_name") & v.contains("/") & (bare != ""), F.concat(F.lit("/"), escaped(bare), F.lit("/")))
        .when((kind == "exclude_dir_name") & (v != "") & ~v.contains("/"), F.concat(F.lit("**/"), escaped(v), F.lit("/")))
        .when((kind == "exclude_filename") & (v != ""), escaped(v))
        .when((kind == "exclude_extension") & (F.size(letters) > 0), F.concat(F.lit("*."), folded))
    )
    return rules.withColumn("pattern", pattern)


def collect_policy(files: DataFrame) -> list[tuple[str, str, str]]:
    """``taken_policy`` of a tree with few ignore files, as a list, parents first."""
    rows = [(r["path"], r["scope"], r["content"] or "") for r in taken_policy(files).collect()]
    return sorted(rows, key=lambda r: (r[0].count("/"), r[0]))


# rows of a side in one cell of the pairs of a root, and pairs a task is to make
CELL, TASK_PAIRS, TASKS = 2048, 1 << 24, 10_000


def overlapping_roots(profiles: DataFrame) -> DataFrame:
    """Pairs of profiles whose roots are equal or one below the other (profile_id, root).

    There may be as many pairs as profiles squared.  The pairs of one root are dealt out
    as a grid of cells of about CELL x CELL, each of which gets its own rows of both
    sides, so that a task holds one cell and a root that all share is made by many.
    """
    clean = profiles.select("profile_id", F.regexp_replace("root", "/+$", "").alias("root"))
    parts = F.split("root", "/")
    up = clean.select("profile_id", "root", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("above")).filter("above <> ''")
    outer = clean.withColumnsRenamed({"profile_id": "outer_profile", "root": "outer_root"})
    # a root is above itself, so the ones with a single row have no pair
    sizes = up.groupBy("above").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("above") == F.col("root")).alias("m")).filter("n > 1 AND m > 0")
    pairs = sizes.agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0
    tasks = int(min(TASKS, max(profiles.sparkSession.sparkContext.defaultParallelism, pairs // TASK_PAIRS)))
    sizes = sizes.select("above", F.ceil(F.col("n") / CELL).alias("across"), F.ceil(F.col("m") / CELL).alias("down"))
    cell = lambda n, *c: F.pmod(F.xxhash64(*c), n)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    inner = up.join(sizes, "above").select("profile_id", "root", "above", cell(F.col("across"), "profile_id", "root").alias("i"), each(F.col("down")).alias("j"))
    outer = outer.join(sizes, F.col("outer_root") == F.col("above")).select("outer_profile", "outer_root", "above", cell(F.col("down"), "outer_profile").alias("j"), each(F.col("across")).alias("i"))
    at = ["above", "i", "j"]
    hit = inner.repartition(tasks, *at).join(outer.repartition(tasks, *at), at).filter((F.col("profile_id") != F.col("outer_profile")) & ((F.col("root") != F.col("outer_root")) | (F.col("outer_profile") < F.col("profile_id"))))
    return hit.select("outer_profile", "outer_root", F.col("profile_id").alias("inner_profile"), F.col("root").alias("inner_root"))
