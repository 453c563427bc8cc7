"""Column functions over relative paths with ``/`` separators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the reserved folder of published artifacts.
RESERVED = ".knowledge-derived"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def extension(path: Column | str) -> Column:
    """From the last dot of the last segment on, or empty."""
    return F.regexp_extract(col(path), r"(\.[^./]*)$", 1)


def stem(path: Column | str) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def dirname(path: Column | str) -> Column:
    """The folder, empty at the root."""
    p = col(path)
    return F.when(F.instr(p, "/") > 0, F.regexp_replace(p, r"/[^/]*$", "")).otherwise(F.lit(""))


def top_folder(path: Column | str) -> Column:
    p = col(path)
    return F.when(F.instr(p, "/") > 0, F.substring_index(p, "/", 1)).otherwise(F.lit("(root)"))


def depth(path: Column | str) -> Column:
    return F.size(F.split(col(path), "/")) - 1


def ancestors(path: Column | str) -> Column:
    """Every folder above a path, outermost first."""
    parts = F.split(col(path), "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.when(F.size(parts) > n, F.array_join(F.slice(parts, 1, n), "/")))


def ancestor_list(path: Column | str) -> Column:
    return F.filter(ancestors(path), lambda a: a.isNotNull())


def is_reserved(path: Column | str, root: str = RESERVED) -> Column:
    p = col(path)
    return (p == root) | p.startswith(root + "/")


def is_canonical(path: Column | str) -> Column:
    """A clean relative path: no empty, ``.`` or ``..`` segment, no backslash, NUL or line break."""
    p = col(path)
    bad = p.rlike(r"[\\\x00\r\n]") | F.exists(F.split(p, "/", -1), lambda s: s.isin("", ".", ".."))
    return F.coalesce((p != "") & ~bad, F.lit(False))


def join_clean(folder: Column | str, target: Column | str) -> Column:
    """folder/target with ``.`` and ``..`` resolved; null where it leaves the root."""
    f, t = col(folder), col(target)
    whole = F.when(t.startswith("/"), F.lit(None)).otherwise(F.when(f == "", t).otherwise(F.concat(f, F.lit("/"), t)))

    def step(s: Column, part: Column) -> Column:
        up = F.when(F.size(s) > 0, F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.array(F.lit("..")))
        escaped = F.get(s, F.lit(0)) == ".."
        return F.when(part.isin("", ".") | F.coalesce(escaped, F.lit(False)), s).otherwise(F.when(part == "..", up).otherwise(F.concat(s, F.array(part))))

    parts = F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step)
    return F.when((F.size(parts) > 0) & (F.get(parts, F.lit(0)) != ".."), F.array_join(parts, "/"))


def relative_to(path: Column | str, root: str) -> Column:
    """An absolute path below ``root`` as a relative one; null elsewhere."""
    p, base = col(path), root.rstrip("/")
    return F.when(p == base, F.lit("")).when(p.startswith(base + "/"), F.substring(p, F.lit(len(base) + 2), F.length(p)))


def node_kind(path: Column | str) -> Column:
    return F.when(F.lower(extension(path)) == ".md", F.lit("note")).otherwise(F.lit("attachment"))


def path_id(path: Column | str) -> Column:
    return F.sha2(col(path).cast("binary"), 256)
