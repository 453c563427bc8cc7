"""Long structured texts through private data as the first query of a new JVM, where the matcher isn't compiled yet."""

import os
import subprocess
import sys

import pytest

SCRIPT = """
import re, sys
from pyspark.sql import SparkSession
sys.path[:0] = sys.argv[1:3]
from corpusgraph.llm import pipeline_stages, private
import test_llm_operators as twin
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
n = int(sys.argv[3])
texts = [
    "x@" + "a." * n + "com", "x@" + "a-" * n, "1." * n, "12 " * n, "1" * n, "+1" + " 415" * n, "(212) " * n, "a@b.c " * n,
    "10.1.2.3 " * (n // 10), "password = " + "k" * n, "4111 1111 1111 1111 " * (n // 100), "2001-02-03" * (n // 10), "123-45-6789 " * (n // 10), "\\n" * n, "=" * n,
]
if n > 10_000:  # what repeats without bound in the patterns; groups of digits are cut one by one, which takes minutes here
    texts = [texts[k] for k in (0, 1, 2, 4, 9, 13, 14)]
docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
got = {r["doc_id"]: r["text"] for r in private.clean_documents(docs, "k").collect()}
assert got == {r["doc_id"]: r["text"] for r in pipeline_stages.hide_private(docs, "k").collect()}
told = {}
for i, t in enumerate(texts):
    out, at, whole = [], 0, True
    for m in re.finditer(private.ANY, t):
        if m[0] not in told:
            told[m[0]] = twin.slow_pseudonym(m[0], "k")
        whole = whole and told[m[0]] is not None
        out += [t[at : m.start()], told[m[0]][1] if told[m[0]] else ""]
        at = m.end()
    assert len(got[i]) >= 20 and (not whole or got[i] == "".join(out) + t[at:]), i
print("same", len(got) == len(texts))
"""


@pytest.mark.parametrize("n", [10_000, 1_000_000])
def test_long_texts_in_a_new_jvm(n):
    here = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(os.path.dirname(here))
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--driver-memory 4g pyspark-shell"}
    ran = subprocess.run([sys.executable, "-c", SCRIPT, root, here, str(n)], capture_output=True, text=True, timeout=300, env=env)
    assert ran.returncode == 0 and "same True" in ran.stdout, ran.stderr[-2000:]
