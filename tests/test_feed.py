"""The NUL-separated change feed: borders, odd records, splits, streams that go on."""

import os

import pytest

from corpusgraph.sources import feed


def put(folder, name, data, mode="wb"):
    with open(folder / name, mode) as f:
        f.write(data)


def read(spark, folder, name="q"):
    return sorted((r["feed"], r["place"], r["path"], r["flags"]) for r in feed.pair_events(spark, str(folder)).collect())


def test_pairs_and_borders():
    assert feed.pairs(b"a\x001\x00b\x002\x00c\x00") == ([(0, b"a", b"1"), (4, b"b", b"2")], 8)
    assert feed.pairs(b"a\x001\x00c", ended=True) == ([(0, b"a", b"1"), (4, b"c", b"")], 5)
    assert feed.pairs(b"a\x001\x00c\x00", ended=True) == ([(0, b"a", b"1"), (4, b"c", b"")], 6)
    assert feed.pairs(b"\x00\x00a\x00\x00") == ([(2, b"a", b"")], 5) and feed.pairs(b"") == ([], 0) and feed.pairs(b"ab") == ([], 0)
    assert [feed.flags_of(x) for x in (b" 512\n", b"x", b"-1", b"", b"18446744073709551615", "٣".encode())] == [512, 0, 0, 0, -1, 0]


def test_batch_reads_complete_pairs(spark, tmp_path):
    put(tmp_path, "w1", b"a/b.md\x00512\x00\xff\x00none\x00half")
    put(tmp_path, "w2", b"c.md\x00516\x00last.md\x00")
    put(tmp_path, "w2.done", b"")
    put(tmp_path, ".hidden", b"x\x001\x00")
    put(tmp_path, "w3", b"")
    assert read(spark, tmp_path) == [("w1", 0, "a/b.md", 512), ("w1", 11, "�", 0), ("w2", 0, "c.md", 516), ("w2", 9, "last.md", 0)]
    (tmp_path / "none").mkdir()
    assert read(spark, tmp_path / "none") == [] and read(spark, tmp_path / "absent") == []


def test_many_tasks_read_one_file(spark, tmp_path, monkeypatch):
    want = [(f"d{i % 7}/{'x' * (i % 50)}{i}.md", i) for i in range(3000)]
    put(tmp_path, "w", b"".join(f"{p}\x00{n}\x00".encode() for p, n in want))
    monkeypatch.setattr(feed, "CHUNK", 1000)
    monkeypatch.setattr(feed, "SPLIT", 5000)
    parts = feed.FeedReader(str(tmp_path)).partitions()
    assert len(parts) > 5 and parts[0].start == 0 and all(a.end == b.start for a, b in zip(parts, parts[1:]))
    rows = [r for s in parts for b in feed._rows(str(tmp_path), s) for r in zip(b["place"].to_pylist(), b["path"].to_pylist(), b["flags"].to_pylist())]
    assert [(p, n) for _, p, n in rows] == want and [k for k, _, _ in rows] == sorted(k for k, _, _ in rows)


def test_offsets_go_on(tmp_path):
    put(tmp_path, "w", b"a\x001\x00b\x00")
    reader = feed.FeedStreamReader(str(tmp_path))
    first = reader.latestOffset()
    assert first["files"]["w"][0] == 4 and reader.latestOffset() == first
    put(tmp_path, "w", b"2\x00c\x003\x00", "ab")
    again = feed.FeedStreamReader(str(tmp_path))  # as after a restart
    second = again.latestOffset()
    (span,) = again.partitions(first, second)
    assert (span.start, span.end) == (4, 12)
    assert [b["path"].to_pylist() for b in again.read(span)] == [["b", "c"]]
    assert again.partitions(second, second) == []
    put(tmp_path, "w", b"tail", "ab")
    put(tmp_path, "w.done", b"")
    third = again.latestOffset()
    assert [b["path"].to_pylist() for s in again.partitions(second, third) for b in again.read(s)] == [["tail"]]
    os.truncate(tmp_path / "w", 6)
    with pytest.raises(OSError):
        list(again.read(span))


def test_stream_resumes_and_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in", "p1", b"a\x00512\x00b\x00")

    def run():
        q = feed.pair_events(spark, str(tmp_path / "in"), streaming=True).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        q.trigger(availableNow=True).start().awaitTermination(120)
        return sorted((r["feed"], r["place"], r["path"], r["flags"]) for r in spark.read.schema(feed.SCHEMA).parquet(str(tmp_path / "out")).collect())

    assert run() == [("p1", 0, "a", 512)]
    put(tmp_path / "in", "p1", b"516\x00", "ab")
    put(tmp_path / "in", "p2", b"c\x001\x00")
    assert run() == [("p1", 0, "a", 512), ("p1", 6, "b", 516), ("p2", 0, "c", 1)] == read(spark, tmp_path / "in")
    assert run() == read(spark, tmp_path / "in")


def test_paths_below_a_root(spark):
    df = spark.createDataFrame([("/w/a.md",), ("/w/",), ("/x/a.md",), ("/wa",)], "path string")
    assert [r["path"] for r in feed.below(df, "/w/").collect()] == ["a.md"]
