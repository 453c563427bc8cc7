"""A slow markdown walk, line by line and character by character, that the columns of ``markup`` have to equal."""

from __future__ import annotations

import re

_LINK = re.compile(
    r"(?P<wembed>!?)\[\[(?P<wiki>[^\[\]\n]*)\]\]"
    r"|(?P<membed>!?)\[(?P<text>(?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\]\((?:<(?P<angle>[^<>\n]*)>|(?P<dest>[^\s()]*(?:\([^\s()]*\)[^\s()]*)*))(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)"
    r"|(?<![\w/#&])#(?P<tag>[\w/-]*[^\W\d][\w/-]*)"
)
_CONTAINER = re.compile(r"^((?: {0,3}>[ ]?)|(?: {0,3}(?:[-*+]|\d{1,9}[.)])(?: {1,4}|$)))")
_MARK = re.compile(r"[\\`$]")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")


def split_frontmatter(text: str) -> tuple[str | None, int]:
    """The YAML between the opening and closing rule, and where the body starts."""
    m = re.match(r"---[ \t]*\r?\n", text)
    if not m:
        return None, 0
    end = re.compile(r"^---[ \t]*\r?(?:\n|\Z)", re.M).search(text, m.end())
    return (None, 0) if not end else (text[m.end() : end.start()], end.end())


def _prefix(line: str, quote_depth: int | None = None) -> tuple[int, int, int]:
    """Length of a line's container marks, quotes in it, and width of its list indent."""
    at = quotes = 0
    indent = 0
    while m := _CONTAINER.match(line[at:]):
        if ">" in m[1]:
            quotes += 1
        else:
            indent = at + len(m[1])
        at += len(m[1])
        if not m[1].strip():
            break
    return at, quotes, indent


def mask_blocks(text: str) -> list[tuple[int, int]]:
    """Spans of code blocks and closed display math."""
    spans: list[tuple[int, int]] = []
    fence = math = None
    list_indent, blank_before = 0, True
    at = 0
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        body = line.rstrip("\r\n")
        lead, quotes, indent = _prefix(body)
        marker = body[:lead].strip(" >") != ""
        if marker:
            list_indent = indent
        elif body.strip() and not body.startswith(" " * list_indent):
            list_indent = 0
        inner = body[lead:]
        own = (quotes, list_indent)
        if fence:
            spans.append((at, at + len(line)))
            m = _FENCE.match(inner.strip() and inner.lstrip())
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = None
            blank_before = not body.strip()
            at += len(line)
            continue
        elif math:
            closes = inner.strip() == "$$"
            if own != math[1] or marker:
                math = None  # no closer within its container: what opened it is plain text
            elif closes:
                spans.append((math[0], at + len(line)))
                math = None
                at += len(line)
                blank_before = True
                continue
        if not fence and not math:
            m = _FENCE.match(inner.lstrip() if list_indent else inner)
            if m and not (m[1][0] == "`" and "`" in m[2]):
                fence = m[1]
                spans.append((at, at + len(line)))
            elif inner.strip() == "$$" and not inner.startswith("    "):
                math = (at, own)
            elif inner.startswith("    ") and not marker and not list_indent and not quotes and blank_before and inner.strip():
                spans.append((at, at + len(line)))
                at += len(line)
                continue
        blank_before = not body.strip()
        at += len(line)
    return spans


def blank(text: str, spans: list[tuple[int, int]]) -> str:
    out, last = [], 0
    for a, b in sorted(spans):
        if b <= last:
            continue
        a = max(a, last)
        out.append(text[last:a])
        out.append(re.sub(r"[^\n]", " ", text[a:b]))
        last = b
    return "".join(out) + text[last:]


def mask_inline(par: str) -> str:
    """A paragraph with its code spans and inline math blanked."""
    if "`" not in par and "$" not in par:
        return par
    out, i = list(par), 0
    while m := _MARK.search(par, i):
        i = m.start()
        c = par[i]
        if c == "\\":
            i += 2
        elif c == "`":
            k = len(par[i:]) - len(par[i:].lstrip("`"))
            close = re.compile(rf"(?<!`)`{{{k}}}(?!`)").search(par, i + k)
            if close:
                out[i : close.end()] = [x if x == "\n" else " " for x in par[i : close.end()]]
                i = close.end()
            else:
                i += k
        elif c == "$":
            two = par.startswith("$$", i)
            end = _math_end(par, i, two)
            if end:
                out[i:end] = [x if x == "\n" else " " for x in par[i:end]]
                i = end
            else:
                i += 2 if two else 1
    return "".join(out)


def _math_end(par: str, i: int, two: bool) -> int | None:
    """End of the math that opens at i, or None where it is money or stays open."""
    start = i + (2 if two else 1)
    if start >= len(par) or (not two and par[start].isspace()):
        return None
    j = start
    while j < len(par):
        if par[j] == "\\":
            j += 2
            continue
        if two and par[j] == "\n":
            return None
        if par[j] == "$":
            if two:
                if par.startswith("$$", j):
                    return j + 2 if j > start else None
            elif par.startswith("$$", j):
                return None
            elif par[j - 1].isspace() or par[j + 1 : j + 2].isdigit():
                return None
            else:
                return j + 1
        j += 1
    return None


def plain(text: str) -> str:
    """Text of a link label without emphasis and escapes."""
    return re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", re.sub(r"(?<!\\)[*`]", "", text))


def facts_of(body: str) -> list[dict]:
    """Links and tags of a body in document order."""
    masked = blank(body, mask_blocks(body))
    found: list[dict] = []

    def scan(masked: str, a: int, b: int) -> None:
        for m in _LINK.finditer(masked, a, b):
            back = m.start()
            while back and masked[back - 1] == "\\":
                back -= 1
            if (m.start() - back) % 2:
                continue
            if m["wiki"] is not None:
                target, bar, label = m["wiki"].replace("\\|", "|").partition("|")
                target, _, frag = target.partition("#")
                found.append({"kind": "wikilink", "raw_target": target, "display": label if bar else m["wiki"], "fragment": frag, "embed": bool(m["wembed"])})
            elif m["tag"] is not None:
                found.append({"kind": "tag", "raw_target": m["tag"], "display": "#" + m["tag"], "fragment": "", "embed": False})
            else:
                target = m["angle"] if m["angle"] is not None else m["dest"]
                found.append({"kind": "markdown_embed" if m["membed"] else "markdown", "raw_target": target, "display": plain(m["text"]), "fragment": "", "embed": bool(m["membed"])})
                scan(masked, m.start("text"), m.end("text"))

    for paragraph in re.split(r"\n[ \t>]*\n", masked):
        text = mask_inline(paragraph)
        scan(text, 0, len(text))
    return found
