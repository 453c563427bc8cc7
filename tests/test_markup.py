"""Columns of links and tags against a slow walk of the same texts."""

import random

import pytest

from corpusgraph.operators import extract
from tests import slow_markup

PIECES = (
    "[[a]]", "![[b|c]]", "[[d#e\\|f]]", "[x](y.md)", "![i](<j k>)", "[![alt #q](img)](dest 'title')", "[`code` *z*](w(1).md)", "#tag", "#a/b-1", "#12", "x#no", "é#no", "##twice", "#ünï",
    "`", "``", "```", "````py", "~~~", "~~~ x", "$", "$$", "$5", "$x$", "\\", "\\\\", "\\$", "\\[", "[", "]", "(", ")", "!", "\n", "\n", "\n", "\n\n", "\n \n", "\n>\n", "\n    ", "\n- ", "\n10. ", "\n> ", "\n> > ", "\n  ",
    "\n```\n", "\n~~~\n", "\n$$\n", "\n> $$\n", "\n- $$\n", "\n  $$\n", "\r\n", "\r\n```\r\n", "word", " ", " ", "\t", "日本", "*b*",
)


def facts(spark, texts):
    notes = spark.createDataFrame(list(enumerate(texts)), "path int, content string").selectExpr("cast(path as string) path", "content")
    return {int(r.path): [f.asDict() for f in r.facts] for r in extract.extract_facts(notes).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_equals_slow_walk(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    got = facts(spark, texts)
    for k, text in enumerate(texts):
        assert got[k] == slow_markup.facts_of(text[slow_markup.split_frontmatter(text)[1] :]), text


def test_frontmatter_borders(spark):
    texts = ["---\n---\n#t", "---\na: 1\n---", "---\r\na: 1\r\n---\r\n[[x]]", "---\na: 1\n--- \n#t", "--- \n\n---\n#t", "---\na: 1\n----\n#t", " ---\n---\n#t", "---\n[1, 2]\n---\n", "", None, "---\na: 1\n --- \n---\n#t"]
    notes = spark.createDataFrame(list(enumerate(texts)), "path int, content string")
    for r in extract.extract_facts(notes).collect():
        front, at = slow_markup.split_frontmatter(texts[r.path] or "")
        assert r.frontmatter_present == (front is not None)
        assert [f.asDict() for f in r.facts] == slow_markup.facts_of((texts[r.path] or "")[at:])
        assert r.warnings == (["frontmatter_malformed"] if r.path == 7 else [])


def test_long_texts(spark):
    """Marks that open and never close, deep marks, many blocks: no stack, no quadratic work."""
    n = 100_000
    texts = [
        "[" * n, "[a" + "\\]" * n + "](b)", "[x](" + "(y)" * n + ")", "> " * n + "[[a]]", "- " * n, "$" + "\\x" * n + "$ [[a]]", "$$" + "y" * n + "$$ #t", "`" + "z\n" * n + "` [[a]]",
        "```\n" + "[[no]]\n" * n + "```\n[[a]]", "    code\n" * n + "\n[[a]]", "```\nx\n```\n#t\n" * 2000, "---\n" + "a\n" * n + "[[b]]", "#" + "1" * n, "#" * n + "a", "\\" * n + "[[a]]", "[[a]] " * n, "$$\n" + "[[a]]\n" * n,
    ]
    got = facts(spark, texts)
    sizes = [len(got[k]) for k in range(len(texts))]
    assert sizes == [0, 1, 1, 1, 0, 1, 1, 1, 1, 1, 2000, 1, 0, 0, 1, n, n]
