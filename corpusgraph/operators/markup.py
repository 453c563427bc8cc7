"""Links and tags of markdown as array columns, without leaving the JVM.

A body goes through three steps.  Its lines are folded once, in order, to find code
blocks and closed display math (only where it has a mark of one).  What is left falls
into paragraphs, in which one pattern meets escapes, code spans and inline math from
left to right, and spans of these are blanked.  Paragraphs are matched for links and
tags; the text of a link is matched again, as it may hold others.

Patterns repeat groups possessively only, so the matcher needs no stack that grows
with a text.  The work is linear in a body, but for the list of its blocks, which is
copied once a block.  Lines end at a line feed, with or without a carriage return.

Not covered, on purpose: reference links, HTML blocks, link titles over several lines
and other corners of full CommonMark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\p{IsWhite_Space}"
WORD = r"\p{L}\p{N}_"
TEXT = r"(?:[^\[\]\\]|\\[^\n]|\[[^\[\]]*+\])*+"
DEST = rf"""(?:<([^<>\n]*+)>|([^{SPACE}()]*+(?:\([^{SPACE}()]*+\)[^{SPACE}()]*+)*+))(?:[{SPACE}]+(?:"[^"]*+"|'[^']*+'))?[{SPACE}]*+\)"""
MARKDOWN = rf"!?\[({TEXT})\]\({DEST}"
TAG = rf"(?<![{WORD}/#&])#[{WORD}/-]*[\p{{L}}\p{{No}}\p{{Nl}}_][{WORD}/-]*+"
LINK = rf"(?=[\\!\[#])(?<!\\)\\*+(?:!?\[\[[^\[\]\n]*+\]\]|{MARKDOWN}|{TAG})"
SPAN = (
    r"(?s)(?=[\\`$])(?:\\(?:.|\z)"
    r"|(`++)(?:.*?(?<!`)\1(?!`))?"
    r"|\$\$(?:(?:\\.|[^\\\n$]|\$(?!\$))++\$\$)?"
    rf"|\$(?:(?![{SPACE}])(?:\\.|[^\\$])++(?<![{SPACE}])\$(?![$\p{{Nd}}]))?)"
)
CONTAINERS = r"^(?: {0,3}> ?| {0,3}(?:[-*+]|\d{1,9}[.)])(?: {1,4}|\z))*+"
LIST_MARKS = r"^.*[-*+.)](?: {1,4}|\z)"
OPENER = rf"^[{SPACE}]*+(?:(`{{3,}}+)[^`]*+|(~{{3,}}+).*+)\z"
CLOSER = rf"^[{SPACE}]*+(`{{3,}}+|~{{3,}}+)[{SPACE}]*+\z"
PLAIN = rf"^[^{SPACE}>\-*+0-9`~$]"
FRONT = r"(?s)\A---[ \t]*+\r?\n(|.*?\n)---[ \t]*+\r?(?:\n|\z)"

STATE = "struct<i:int,list:int,gap:boolean,fence:string,fence_at:int,math_at:int,math_quotes:int,math_list:int,code_at:int,spans:array<struct<a:int,b:int>>>"


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)``, with the value computed once."""
    return F.transform(F.array(value), fn)[0]


def front_and_body(text: Column) -> tuple[Column, Column]:
    """The YAML between the opening and closing rule (null without), and what follows."""
    has = text.startswith("---") & text.rlike(FRONT)
    return F.when(has, F.regexp_extract(text, FRONT, 1)), F.when(has, F.substr(text, F.length(F.regexp_extract(text, FRONT, 0)) + 1)).otherwise(text)


# ---- blocks -----------------------------------------------------------------------


def _line(raw: Column) -> Column:
    """What the fold asks of a line: quotes and list marks before it, width, fences, display math."""
    no, none, word = F.lit(False), F.lit(0), F.lit("")

    def shape(*fields: Column) -> Column:
        return F.struct(*(f.alias(n) for f, n in zip(fields, ("plain", "indent", "quotes", "blank", "empty", "spaces", "opener", "closer", "deep", "near", "dollars"), strict=True)))

    def inside(line: Column, lead: Column) -> Column:
        inner = F.substr(line, F.length(lead) + 1)
        fence = line.contains("```") | line.contains("~~~")
        return shape(
            no,
            F.when(lead == "", none).otherwise(F.length(F.regexp_extract(lead, LIST_MARKS, 0))),
            F.length(lead) - F.length(F.replace(lead, F.lit(">"), F.lit(""))),
            ~line.rlike(rf"[^{SPACE}]"),
            ~inner.rlike(rf"[^{SPACE}]"),
            F.length(F.regexp_extract(line, "^ *+", 0)),
            F.when(fence, F.concat(F.regexp_extract(inner, OPENER, 1), F.regexp_extract(inner, OPENER, 2))).otherwise(""),
            F.when(fence, F.regexp_extract(inner, CLOSER, 1)).otherwise(""),
            inner.startswith("    "),
            fence & inner.rlike("^ {0,3}[`~]"),
            line.contains("$$") & inner.rlike(rf"^[{SPACE}]*+\$\$[{SPACE}]*+\z"),
        )

    marked = let(F.regexp_replace(raw, r"\r++\z", ""), lambda line: let(F.regexp_extract(line, CONTAINERS, 0), lambda lead: inside(line, lead)))
    return F.when(raw.rlike(PLAIN), shape(F.lit(True), none, none, no, no, none, word, word, no, no, no)).otherwise(marked)


def _step(s: Column, x: Column) -> Column:
    """The state after a line."""
    marker = x["indent"] > 0
    width = F.when(marker, x["indent"]).when(~x["blank"] & (x["spaces"] < s["list"]), F.lit(0)).otherwise(s["list"])

    def event(w: Column) -> Column:
        closes = (x["closer"] != "") & (F.substring(x["closer"], 1, 1) == F.substring(s["fence"], 1, 1)) & (F.length(x["closer"]) >= F.length(s["fence"]))
        in_math = (s["math_at"] >= 0) & (s["math_quotes"] == x["quotes"]) & (s["math_list"] == w) & ~marker
        return (
            F.when(s["fence"] != "", F.when(closes, "fence ends").otherwise("fence"))
            .when(in_math, F.when(x["dollars"], "math ends").otherwise("math"))
            .when((x["opener"] != "") & ((w > 0) | x["near"]), "fence begins")
            .when(x["dollars"] & ~x["deep"], "math begins")
            .when(x["deep"] & ~marker & (w == 0) & (x["quotes"] == 0) & s["gap"] & ~x["empty"], "code")
            .otherwise("text")
        )

    def after(w: Column, e: Column) -> Column:
        one = lambda a, b: F.array(F.struct(a.alias("a"), b.alias("b")))
        ended = F.when(e == "fence ends", one(s["fence_at"], s["i"])).when(e == "math ends", one(s["math_at"], s["i"])).when((s["code_at"] >= 0) & (e != "code"), one(s["code_at"], s["i"] - 1))
        return F.struct(
            (s["i"] + 1).alias("i"),
            w.alias("list"),
            (x["blank"] | e.isin("code", "math ends")).alias("gap"),
            F.when(e == "fence begins", x["opener"]).when(e == "fence", s["fence"]).otherwise("").alias("fence"),
            F.when(e == "fence begins", s["i"]).otherwise(s["fence_at"]).alias("fence_at"),
            F.when(e == "math begins", s["i"]).when(e == "math", s["math_at"]).otherwise(-1).alias("math_at"),
            F.when(e == "math begins", x["quotes"]).otherwise(s["math_quotes"]).alias("math_quotes"),
            F.when(e == "math begins", w).otherwise(s["math_list"]).alias("math_list"),
            F.when(e != "code", F.lit(-1)).when(s["code_at"] >= 0, s["code_at"]).otherwise(s["i"]).alias("code_at"),
            F.when(ended.isNull(), s["spans"]).otherwise(F.concat(s["spans"], ended)).alias("spans"),
        )

    quiet = x["plain"] & (s["list"] == 0) & (s["fence"] == "") & (s["math_at"] < 0) & (s["code_at"] < 0)
    passed = F.struct(*(v.alias(n) for n, v in {"i": s["i"] + 1, "list": s["list"], "gap": F.lit(False), **{n: s[n] for n in ("fence", "fence_at", "math_at", "math_quotes", "math_list", "code_at", "spans")}}.items()))
    return F.when(quiet, passed).otherwise(let(width, lambda w: let(event(w), lambda e: after(w, e))))


def _blocks(lines: Column) -> Column:
    """First and last line of each code block and closed display math, in order."""
    begin = F.from_json(F.lit('{"i":0,"list":0,"gap":true,"fence":"","fence_at":-1,"math_at":-1,"math_quotes":0,"math_list":0,"code_at":-1,"spans":[]}'), STATE)
    still = lambda s: F.when(s["fence"] != "", s["fence_at"]).when(s["code_at"] >= 0, s["code_at"])
    last = lambda s: F.when(still(s).isNotNull(), F.concat(s["spans"], F.array(F.struct(still(s).alias("a"), (s["i"] - 1).alias("b"))))).otherwise(s["spans"])
    return F.aggregate(F.transform(lines, _line), begin, _step, last)


def without_blocks(body: Column) -> Column:
    """A body whose code blocks and display math are empty lines."""

    def emptied(lines: Column, spans: Column) -> Column:
        upto = lambda k: F.when(k > 0, F.get(spans, k - 1)["b"] + 1).otherwise(0)
        parts = F.transform(spans, lambda s, k: F.concat(F.slice(lines, upto(k) + 1, s["a"] - upto(k)), F.array_repeat(F.lit(""), s["b"] - s["a"] + 1)))
        return F.array_join(F.concat(F.flatten(parts), F.slice(lines, upto(F.size(spans)) + 1, F.size(lines))), "\n")

    marks = body.contains("```") | body.contains("~~~") | body.contains("$$") | body.contains("\n    ") | body.startswith("    ")
    return F.when(marks, let(F.split(body, "\n"), lambda lines: let(_blocks(lines), lambda spans: emptied(lines, spans)))).otherwise(body)


# ---- paragraphs -------------------------------------------------------------------


def without_spans(paragraph: Column) -> Column:
    """A paragraph whose code spans and inline math are blanks."""
    stays = lambda t: t.startswith("\\") | t.rlike(r"^(?:`++|\$++)\z")
    masked = lambda t: F.when(stays(t), t).otherwise(F.regexp_replace(t, r"[^\n]", " "))
    joined = lambda found: F.array_join(F.transform(F.split(paragraph, SPAN), lambda gap, k: F.concat(gap, F.coalesce(masked(F.get(found, k)), F.lit("")))), "")
    return F.when(paragraph.contains("`") | paragraph.contains("$"), let(F.regexp_extract_all(paragraph, F.lit(SPAN), F.lit(0)), joined)).otherwise(paragraph)


def plain(text: Column) -> Column:
    """Text of a link label without emphasis and escapes."""
    return F.regexp_replace(F.regexp_replace(text, r"(?<!\\)[*`]", ""), r"\\([!-/:-@\[-`{-~])", "$1")


def _fact(kind: Column, raw: Column, display: Column, fragment: Column, embed: Column) -> Column:
    return F.struct(kind.alias("kind"), raw.alias("raw_target"), display.alias("display"), fragment.alias("fragment"), embed.alias("embed"))


def _wikilink(m: Column) -> Column:
    embed = m.startswith("!")
    inner = F.regexp_extract(m, r"(?s)\[\[(.*)\]\]", 1)
    unescaped = F.replace(inner, F.lit("\\|"), F.lit("|"))
    bar = F.instr(unescaped, "|")
    target = F.substring_index(unescaped, "|", 1)
    fragment = F.when(F.instr(target, "#") > 0, F.substr(target, F.instr(target, "#") + 1)).otherwise("")
    return _fact(F.lit("wikilink"), F.substring_index(target, "#", 1), F.when(bar > 0, F.substr(unescaped, bar + 1)).otherwise(inner), fragment, embed)


def _markdown(m: Column) -> Column:
    embed = m.startswith("!")
    raw = F.concat(F.regexp_extract(m, "^" + MARKDOWN, 2), F.regexp_extract(m, "^" + MARKDOWN, 3))
    return _fact(F.when(embed, "markdown_embed").otherwise("markdown"), raw, plain(F.regexp_extract(m, "^" + MARKDOWN, 1)), F.lit(""), embed)


def _tag(m: Column) -> Column:
    return _fact(F.lit("tag"), F.substr(m, F.lit(2)), m, F.lit(""), F.lit(False))


def _found(text: Column, inner: int) -> Column:
    """Facts of a text, in order; the text of a link is matched too, ``inner`` levels deep."""
    marks = F.regexp_extract_all(text, F.lit(LINK), F.lit(0))
    even = F.filter(marks, lambda m: F.length(F.regexp_extract(m, r"^\\*+", 0)) % 2 == 0)

    def facts(m: Column) -> Column:
        own = F.array(_markdown(m))
        if inner:
            own = F.concat(own, _found(F.regexp_extract(m, "^" + MARKDOWN, 1), inner - 1))
        return F.when(m.startswith("#"), F.array(_tag(m))).when(m.endswith("]]"), F.array(_wikilink(m))).otherwise(own)

    return F.flatten(F.transform(even, lambda m: let(F.regexp_replace(m, r"^\\*+", ""), facts)))


def facts_of(masked: Column) -> Column:
    """Links and tags of a body without blocks, in order.

    Brackets nest once in the text of a link, so a link in it holds no further link, but may hold tags.
    """
    return F.flatten(F.transform(F.split(masked, r"\n[ \t>]*+\n"), lambda p: F.when(p.contains("[") | p.contains("#"), let(without_spans(p), lambda t: _found(t, 2))).otherwise(F.array().cast("array<struct<kind:string,raw_target:string,display:string,fragment:string,embed:boolean>>"))))
