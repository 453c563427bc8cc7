"""Phrases whose words keep company, by multikey three-way quicksort of suffix pointers.

A suffix is a word of a piece of text and up to ``longest`` - 1 words after it.

1. Single words are counted per language first (summed up in the tasks).
2. Each batch of texts counts its equal suffixes and sends them on by their leading
   words: one packed row for all suffixes of a batch with one leading word.  A word
   of more than HOT suffixes (or a 100,000th of all words, which bounds the list that
   the tasks get) is dealt over as many parts as it needs, by its second word, and
   where that is such a word too, by all words.  So no task gets more of one word.
3. In a task whole leading words are sorted a block at a time: three-way partitions
   of all open segments at once around a middle key, one word deeper in each equal
   partition, up to the maximum depth.  The weight of an equal partition is the count
   of its phrase; what weighs less than ``low`` is abandoned unsorted.  A part of a
   leading word (more than LIMIT bytes) abandons nothing, the parts are summed.
4. Frequent phrases, a small part of all, are joined with their parts for the scores.

A phrase is as cohesive as its worst cut: floor(10^6 a a / (l r)) in exact decimals
(a, l, r: counts of the phrase and of both sides; exact up to counts of 10^15).

Edge cases: null and empty texts have no words; a null language is ``und``; repeated
rows count again; doc_id and other columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, mix64, ranges, slices, utf8
from .tokens import bounds, byte_set, hashes, joined

HOT, MOST_HOT = 200_000, 100_000
STEP, BLOCK, LIMIT, PARTS = 3 << 20, 2 << 20, 16 << 20, 64
_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_INSIDE = byte_set(b"\x20\x09" + _BREAKS)
_BREAK = ~byte_set(_BREAKS)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte strings data[start : end] as Arrow strings."""
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.r_[0, np.cumsum(end - start)]), pa.py_buffer(np.ascontiguousarray(data[ranges(start, end - start)])))


def _batch(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Lower-cased bytes, start, end, code and language of each word, whether the next is in its piece; words by code, names of languages."""
    data, off = utf8(b.column(1))
    data = _LOWER[data]
    start, end, doc = bounds(data, off, _INSIDE)
    piece = np.cumsum(_BREAK[data])[start] if len(start) else start
    linked = np.r_[(doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1]), False] if len(start) else np.zeros(0, bool)
    lang = b.column(0).dictionary_encode()
    words = strings(data, start, end).dictionary_encode()
    pa.default_memory_pool().release_unused()
    return data, start, end, words.indices.to_numpy().astype(np.int64), lang.indices.to_numpy()[doc].astype(np.int64), linked, words.dictionary, lang.dictionary


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def _words(docs: DataFrame) -> DataFrame:
    """lang, phrase, f of every word, and a row with a null phrase for the sum of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", STEP):
            data, start, end, code, lang, _, _, names = _batch(b)
            if len(code):
                key, first, n = np.unique(lang * (code.max() + 1) + code, return_index=True, return_counts=True)
                sums = np.bincount(lang, minlength=len(names))
                words = pa.concat_arrays([strings(data, start[first], end[first]).cast(pa.string()), pa.nulls(len(names), pa.string())])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.r_[lang[first], np.arange(len(names))])), words, pa.array(np.r_[n, sums].astype(np.int64))], ["lang", "phrase", "f"])

    return _texts(docs).mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _name_hash(names: pa.Array) -> np.ndarray:
    data, off = utf8(names)
    return hashes(data, off[:-1], off[1:])


def _hot_words(words: DataFrame, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words with too many suffixes for one task, MOST_HOT at most, and in how many parts each goes."""
    most = max(hot, (words.filter("phrase IS NULL").agg(F.sum("f")).first()[0] or 0) // MOST_HOT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            with np.errstate(over="ignore"):
                yield pa.RecordBatch.from_arrays([pa.array((_name_hash(b.column(1)) ^ mix64(_name_hash(b.column(0)))).view(np.int64)), b.column(2)], ["h", "f"])

    found = words.filter(F.col("phrase").isNotNull() & (F.col("f") > most)).mapInArrow(run, "h long, f long").collect()
    h, f = np.array([r["h"] for r in found], np.int64).view(np.uint64), np.array([r["f"] for r in found], np.int64)
    order = np.argsort(h)
    return h[order], 2 * (f[order] // most + 1)


def _suffixes(docs: DataFrame, longest: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """lang, word, route, split (parts of a pair are elsewhere), rest: what follows the word, a line each, n: how often."""
    hot_h, hot_parts = hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", STEP):
            data, start, end, code, lang, linked, words, names = _batch(b)
            at = np.flatnonzero(linked)
            if not len(at):
                continue
            size, rank, many = np.ones(len(at), np.int64), code[at], int(code.max()) + 2
            going = np.ones(len(at), bool)
            for k in range(1, longest):
                going &= linked[at + k - 1] if k == 1 else linked[np.minimum(at + k - 1, len(code) - 1)]
                size += going
                rank = np.unique(rank * many + np.where(going, code[np.minimum(at + k, len(code) - 1)] + 1, 0), return_inverse=True)[1]
            _, first, n = np.unique(lang[at] * (int(rank.max()) + 1) + rank, return_index=True, return_counts=True)
            at, size = at[first], size[first]
            with np.errstate(over="ignore"):
                word = _name_hash(words)[code] ^ mix64(_name_hash(names))[lang]
                route = word[at].copy()
                if len(hot_h):
                    place = np.minimum(np.searchsorted(hot_h, word), len(hot_h) - 1)
                    is_hot = hot_h[place] == word
                    split = is_hot[at] & is_hot[at + 1]
                    deal = word[at + 1].copy()
                    for k in range(2, longest):
                        there = split & (size > k)
                        deal[there] = deal[there] * np.uint64(0x9E3779B97F4A7C15) + word[at[there] + k]
                    part = mix64(deal) % np.where(is_hot, hot_parts[place], 1)[at].astype(np.uint64)
                    route += part * np.uint64(0xC2B2AE3D27D4EB4F)
                else:
                    split = np.zeros(len(at), bool)
            order = np.lexsort((split, route, code[at], lang[at]))
            at, size, n, route, split = at[order], size[order], n[order], route[order], split[order]
            new = np.flatnonzero(np.r_[True, (route[1:] != route[:-1]) | (split[1:] != split[:-1]) | (code[at[1:]] != code[at[:-1]]) | (lang[at[1:]] != lang[at[:-1]])])
            flat, place = joined(data, start, end)
            a, z = place[at + 1], place[at + size]
            lines = flat[ranges(a, z - a)]
            ends = np.r_[0, np.cumsum(z - a)]
            lines[ends[1:] - 1] = 10
            stop = np.r_[new, len(at)]
            rest = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(new), [None, pa.py_buffer(ends[stop]), pa.py_buffer(lines)]).cast(pa.binary())
            number = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(new), [None, pa.py_buffer(4 * stop), pa.py_buffer(n.astype(np.int32))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([names.take(pa.array(lang[at[new]])), strings(data, start[at[new]], end[at[new]]).cast(pa.string()), pa.array(route[new].view(np.int64)), pa.array(split[new]), rest, number], ["lang", "word", "route", "split", "rest", "n"])

    return _texts(docs).mapInArrow(run, "lang string, word string, route long, split boolean, rest binary, n binary")


def partitions(keys: np.ndarray, weight: np.ndarray, group: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal partitions of the rows of each group: depth (words compared), a row of it, weight.

    ``keys`` has a line for each depth, negative where the suffix has ended;
    ``low[d]`` is what a partition has to weigh in order to be told (or sorted) at depth d, per row.
    """
    at = np.argsort(group, kind="stable")
    segment, depth = group[at], np.zeros(len(at), np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(at):
        first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        size = np.diff(np.r_[first, len(at)])
        key = keys[depth, at]
        side = np.sign(key - np.repeat(key[first + size // 2], size)) + 1
        sub = 3 * np.repeat(np.arange(len(first)), size) + side
        order = np.argsort(sub, kind="stable")
        at, depth, key, sub = at[order], depth[order], key[order], sub[order]
        first = np.flatnonzero(np.r_[True, sub[1:] != sub[:-1]])
        size = np.diff(np.r_[first, len(at)])
        total = np.add.reduceat(weight[at], first)
        equal = (sub[first] % 3 == 1) & (key[first] >= 0)
        told = equal & (total >= low[depth[first], at[first]])
        found.append((depth[first[told]] + 1, at[first[told]], total[told]))
        below = np.where(equal, depth[first] + 1, depth[first])
        goes_on = (below < len(keys)) & (equal | (sub[first] % 3 != 1))
        goes_on &= total >= low[np.minimum(below, len(keys) - 1), at[first]]
        stay = np.repeat(goes_on, size)
        depth = np.repeat(below, size)[stay]
        at, segment = at[stay], sub[stay]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def _count(t: pa.Table, longest: int, low: int, whole: bool) -> pa.RecordBatch:
    """lang, phrase, f of the frequent phrases of a block of leading words; of all phrases of parts of a word."""
    lines = pc.split_pattern(t.column("rest").combine_chunks().cast(pa.large_string()), "\n")
    number = pc.list_value_length(lines).to_numpy() - 1  # nothing follows the last line's end
    text = lines.flatten()
    text = text.filter(pa.array(np.arange(len(text)) != np.repeat(np.cumsum(number + 1) - 1, number + 1)))
    row = np.repeat(np.arange(len(number)), number)
    weight = np.frombuffer(b"".join(t.column("n").to_pylist()), np.int32).astype(np.int64)
    pieces = pc.split_pattern(text, " ")
    length = pc.list_value_length(pieces).to_numpy()
    words = pieces.flatten().dictionary_encode()
    codes, base = words.indices.to_numpy().astype(np.int64), np.r_[0, np.cumsum(length)][:-1]
    keys = np.stack([np.where(length > d, codes[np.minimum(base + d, len(codes) - 1)], -1) for d in range(longest - 1)])
    split = t.column("split").combine_chunks().to_numpy(zero_copy_only=False)
    lead = pc.binary_join_element_wise(t.column("lang").combine_chunks(), t.column("word").combine_chunks(), " ").dictionary_encode().indices.to_numpy()
    group = (2 * lead + split)[row]
    least = np.full((longest - 1, len(row)), low if whole else 1)
    least[: longest - 2, split[row]] = 1  # shorter phrases of such a pair are in parts
    depth, at, f = partitions(keys, weight, group, least)
    phrase = t.column("word").combine_chunks().cast(pa.large_string()).take(pa.array(row[at]))
    for d in range(longest - 1):
        more = words.dictionary.take(pa.array(np.maximum(keys[d, at], 0)))
        phrase = pc.if_else(pa.array(depth > d), pc.binary_join_element_wise(phrase, more, pa.scalar(" ", pa.large_string())), phrase)
    return pa.RecordBatch.from_arrays([t.column("lang").combine_chunks().take(pa.array(row[at])), phrase.cast(pa.string()), pa.array(f)], ["lang", "phrase", "f"])


def _sorted(rows: DataFrame, longest: int, low: int, block: int, limit: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, parts = 0, False  # parts: of the first route some rows have been counted before
        for b in batches:
            for piece in slices(iter([b]), "rest", block):
                held.append(piece)
                size += int(pc.sum(pc.binary_length(piece.column(4))).as_py() or 0)
                if size < block:
                    continue
                t = pa.Table.from_batches(held)
                route = np.asarray(t.column("route"))
                done = int(np.searchsorted(route, route[-1]))  # the last route may go on
                if parts and done:
                    end = int(np.searchsorted(route, route[0], "right"))
                    yield _count(t.slice(0, end), longest, low, False)
                    t, done, parts = t.slice(end), done - end, False
                if done:
                    yield _count(t.slice(0, done), longest, low, True)
                    t = t.slice(done)
                elif size >= limit:
                    yield _count(t, longest, low, False)
                    t, parts = t.slice(t.num_rows), True
                held = t.combine_chunks().to_batches()
                size = sum(int(pc.sum(pc.binary_length(x.column(4))).as_py() or 0) for x in held)
        if held:
            t = pa.Table.from_batches(held)
            if parts:
                end = int(np.searchsorted(np.asarray(t.column("route")), t.column("route")[0].as_py(), "right")) if t.num_rows else 0
                if end:
                    yield _count(t.slice(0, end), longest, low, False)
                t = t.slice(end)
            if t.num_rows:
                yield _count(t, longest, low, True)

    return rows.repartition("route").sortWithinPartitions("route").mapInArrow(run, "lang string, phrase string, f long")


def frequent_phrases(docs: DataFrame, longest: int = 3, low: int = 10, hot: int = HOT, block: int = BLOCK, limit: int = LIMIT) -> DataFrame:
    """lang, phrase, f of all phrases of up to ``longest`` words with f >= low; a null phrase for all words of a language."""
    words = cut_lineage(_words(docs).filter(F.col("phrase").isNull() | (F.col("f") >= low)))
    grams = _sorted(_suffixes(docs, longest, _hot_words(words, hot)), longest, low, block, limit)
    grams = grams.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= low)
    return cut_lineage(words.unionByName(grams))


def collocations(docs: DataFrame, longest: int = 3, low: int = 10, part: int = 50, top: int | None = 2000, **sizes: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of 2 to ``longest`` words of each language.

    A phrase that lies inside a longer one of at least ``part`` per cent of its count is left out.
    ``top`` rows a language, or all where it is None.
    """
    if longest < 2 or low < 1:
        raise ValueError("a phrase has two words at least and occurs at least once")
    f = frequent_phrases(docs, longest, low, **sizes)
    word = F.split("phrase", " ")
    found = f.filter(F.instr("phrase", " ") > 0).select("lang", "phrase", F.col("f").alias("a"), word.alias("w"))

    def some(first: object, count: object) -> F.Column:
        return F.array_join(F.slice("w", first, count), " ")

    inside = found.select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("m")).filter("m >= 2 AND m < size(w)") if longest > 2 else None
    kept = found
    if inside is not None:
        starts = inside.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("i"))
        longer = starts.select("lang", some(F.col("i"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        kept = found.join(longer, ["lang", "phrase"], "left").filter(f"longer IS NULL OR 100 * longer < {int(part)} * a").drop("longer")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.withColumns({"left": some(F.lit(1), F.col("k")), "right": some(F.col("k") + 1, F.size("w") - F.col("k"))})
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(f.filter("phrase IS NOT NULL").select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    exact = "CAST(CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) AS DECIMAL(38,0)) DIV CAST(CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)) AS DECIMAL(38,0))"
    worst = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr(exact).alias("score"), "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = (F.desc("score"), F.desc("a"), "phrase")
    if top is not None:  # the best of each of PARTS parts of a language first, so that few rows meet for one language
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
        worst = worst.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    best = worst.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    if top is not None:
        best = best.filter(F.col("rank") <= top)
    totals = f.filter("phrase IS NULL").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def oracle() -> str:
    upper = "".join(map(chr, range(65, 91)))
    return rf"""
WITH pieces AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
grams AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM pieces, (VALUES (1), (2), (3)) AS sizes(m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
found AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 10),
longer AS (SELECT lang, phrase, max(a) AS longer FROM (
  SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM found WHERE m = 3) GROUP BY lang, phrase),
kept AS (SELECT found.* FROM found LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
cuts AS (SELECT lang, phrase, a, w, m, unnest(generate_series(1, m - 1)) AS k FROM kept),
scored AS (SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1 : k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1 : c.m], ' ')),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""
