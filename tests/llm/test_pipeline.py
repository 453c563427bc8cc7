"""The pipeline's stages against brute force over the smallest tables."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusgraph.llm import quality
from corpusgraph.llm.common import cut_lineage, table
from corpusgraph.llm.queries import piece_model

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_stages(spark):
    docs = table(spark, SF, "documents")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(cut_lineage(stage(spark, kept[-1], SF)))
    assert all(d.columns == docs.columns for d in kept[1:-1])
    ids = [[r["doc_id"] for r in d.select("doc_id").collect()] for d in kept]
    good = {r["doc_id"] for r in quality.rate_quality(docs, table(spark, SF, "labels")).filter("kept").collect()}
    assert set(ids[1]) == good
    texts = {r["doc_id"]: r["text"] for r in kept[1].collect()}
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower() if t.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(ids[2]) == sorted(i for i in sets if find(i) == i)
    assert sorted(ids[3]) == sorted(ids[2])
    assert not any(re.search(r"[\w.]+@mail\d|AKIA[0-9A-Z]{16}", r["text"]) for r in kept[3].collect())
    assert set(ids[4]) <= set(ids[3]) and len(ids[4]) > len(ids[3]) and sorted(ids[5]) == sorted(ids[4])
    assert corpus_pipeline.run(spark, SF).count() == len(ids[5])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, th string, q_kept string"


def test_near_copies_of_odd_rows(spark):
    """Repeated ids, missing ids, texts without words, clashing names, an empty table."""
    from corpusgraph.llm import pipeline_stages as stages

    a, b = (" ".join(f"{w}{i}" for i in range(60)) for w in ("one", "two"))
    texts = [(5, a), (5, a), (5, b), (8, b + " more"), (9, a.upper()), (None, a), (None, None), (7, ""), (7, ""), (6, None), (4, "x " * 30_000)]
    docs = spark.createDataFrame([(i, t, None, None, 0, "x", "y") for i, t in texts], SCHEMA)
    out = stages.drop_near_copies(docs)
    assert out.columns == docs.columns
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], (r["text"] or "")[:4]) for r in out.collect())
    assert got == [(-1, ""), (-1, "one0"), (4, "x x "), (5, "one0"), (5, "two0"), (6, ""), (7, ""), (7, "")]
    assert stages.drop_near_copies(docs.limit(0)).count() == 0


def odd_rows(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, names that stages use inside."""
    rng = random.Random(3)
    prose = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    long_, good = prose(30_000), prose(80)
    texts = [(1, good, "s"), (1, good, "s"), (2, good, None), (3, None, "s"), (None, None, None), (4, "", "s"), (5, long_, "t"), (None, prose(70), "t"), (6, good + " mail a@b.example 10.1.2.3", "t"), (7, "a " * 200, "t")]
    names = ("q_kept", "q_prob", "pii_found", "pii_new", "pii_kinds", "times", "mix_doc", "mix_th", "mix_times", "th", "size", "src", "block", "p", "h")
    docs = spark.createDataFrame([(i, t, None, s, None) for i, t, s in texts], "doc_id long, text string, lang string, source string, n_chars int")
    return docs.select("*", *(F.lit(n).alias(n) for n in names)), texts, names


def test_stages_on_odd_rows(spark):
    from corpusgraph.llm import pipeline_stages as stages

    docs, texts, names = odd_rows(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    unchanged = lambda d: d.columns == docs.columns and all(r[n] == n for r in d.collect() for n in names)
    good = stages.keep_good(docs, labels)
    assert unchanged(good) and sorted(len(r["text"]) for r in good.collect()) == sorted(len(t) for i, t, _ in texts if t and len(t.split()) >= 50 and not t.startswith("a a"))
    labelled = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (None, 1, 0), (2, None, 0)], labels.schema)
    assert unchanged(stages.keep_good(docs, labelled))
    clean = stages.hide_private(docs, "k")
    assert unchanged(clean) and clean.count() == len(texts) and clean.filter("text LIKE '%10.1.2.3%' OR text LIKE '%a@b.example%'").count() == 0
    mixed = stages.mix_sources(docs)
    assert unchanged(mixed) and {r["text"] for r in mixed.collect()} <= {t for _, t, _ in texts}
    pieces = stages.encode(docs, piece_model()).collect()
    assert len(pieces) == len(texts) and sum(r["n_tokens"] == 2 for r in pieces) == 3
    none = docs.limit(0)
    assert not any(d.count() for d in (stages.keep_good(none, labels), stages.hide_private(none, "k"), stages.mix_sources(none), stages.encode(none, piece_model())))
