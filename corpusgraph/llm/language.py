"""Language identification by cross-parsing entropy.

A bounded sample of labelled text per language is turned into a suffix automaton.
A document is cut greedily into the longest pieces that occur in a language's
sample.  Longer samples hold longer pieces, so pieces are normalised: their number
times the logarithm of the sample's length estimates the bits a language's model
needs (cross-parsing entropy), and the language that needs the fewest wins.  The
score is one minus the winner's normalised pieces over the runner-up's.

Automata are kept as one array of slots for all states, rows over rows: some 40 bytes a
character of the samples and state, whatever the alphabet.  Every letter of the samples
has a symbol of its own.  Texts are cut into lanes of LANE symbols that take a step
together; the state is carried from lane to lane afterwards, so pieces are those of
whole texts.

Learning reads text and lang only, of documents outside the held-out fold:
SAMPLE_DOCS documents a language at most, chosen by a hash, SAMPLE_CHARS
characters in all, an equal share of each (what short ones leave over goes to the
others), taken at a place that a hash chooses.  Scoring reads text alone, and all of
it.

Edge cases: null text, or text without a letter, is ``und`` with score 0; null
lang is never learned; with no labelled row everything is ``und``; ties go to
the language that sorts first; with one language its score is 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

SAMPLE_DOCS, SAMPLE_CHARS, LANE, STEP = 60, 40_000, 512, 4 << 20
POINTS, FEW = 0x110000, 20_000
_READY: dict = {}


def fold(text: str) -> str:
    """Lower case, every run of other than letters one blank."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def displaced(nxt: list[dict[int, int]], symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The transitions in one array of slots: base of each state, and owner and target of the slot base + symbol.

    Rows of states lie over one another, each moved to where its slots are free; about
    two slots a transition.  A slot of another owner tells that there is no transition.
    """
    size = 2 * sum(map(len, nxt)) + symbols
    used, base = bytearray(size + symbols), np.zeros(len(nxt), np.int64)
    owner, target = np.full(size + 2 * symbols, -1, np.int64), np.zeros(size + 2 * symbols, np.int64)
    free, at = 0, 0
    for s in sorted(range(len(nxt)), key=lambda s: -len(nxt[s])):
        row = nxt[s]
        if not row:
            continue
        if len(row) == 1:
            (c,) = row
            while used[free]:
                free += 1
            b = free - c
        else:
            while any(used[at + c] for c in row):
                at = (at + 1) % size
            b, at = at, (at + 1) % size
        base[s] = b
        for c, to in row.items():
            used[b + c] = 1
            owner[symbols + b + c], target[symbols + b + c] = s, to
    return base + symbols, owner, target


class Parsers:
    """Automata of all languages in shared arrays, and how text becomes symbols.

    States, slots and symbols are numbered through all languages by 64-bit numbers.
    """

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        folded = {x: fold(samples[x]) for x in self.langs}
        letters = sorted(set("".join(folded.values())) - {" "})
        # what is no letter is the blank's symbol 0, a letter that no sample has is symbol 1, every other one has its own
        code = np.fromiter((chr(c).isalpha() for c in range(POINTS)), np.int32, POINTS)
        for i, c in enumerate(letters):
            code[ord(c)] = i + 2
        for c in np.flatnonzero(code).tolist():
            low = chr(c).lower()
            if len(low) == 1 and low != chr(c):
                code[c] = code[ord(low)]
        self.code, symbols = code, len(letters) + 2
        bases, owners, targets, again, roots = [], [], [], [], []
        states = slots = 0
        for x in self.langs:
            nxt = suffix_automaton(code[np.frombuffer(folded[x].encode("utf-32-le"), np.uint32)].tolist())
            lone = len(nxt)  # a letter that the sample lacks is a piece of its own
            begin = np.array([nxt[0].get(c, lone) for c in range(symbols)], np.int64)
            nxt[0] = dict(enumerate(begin.tolist()))
            base, owner, target = displaced([*nxt, {}], symbols)
            bases.append(base + slots)
            owners.append(np.where(owner < 0, -1, owner + states))
            targets.append(target + states)
            again.append(begin + states)  # where the next piece goes on after one has ended
            roots.append(states)
            states, slots = states + len(base), slots + len(owner)
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.base, self.owner, self.target = map(join, (bases, owners, targets))
        self.again = np.stack(again) if again else np.zeros((0, symbols), np.int64)
        self.roots = np.array(roots, np.int64)
        self.bits = np.array([np.log(2 + len(folded[x])) for x in self.langs])

    def step(self, state: np.ndarray, lang: np.ndarray | slice, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states by symbols ``c``, and where a piece ended before it."""
        slot = self.base[state] + c
        there = self.owner[slot] == state
        again = self.again[:, c] if isinstance(lang, slice) else self.again[lang, c]
        return np.where(there, self.target[slot], again), ~there

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each text (rows) in each language (columns), and symbols of each text.

        Lanes of LANE symbols of all texts are parsed at once, as if each began a text.
        Then each lane is parsed again from the state that the lane before it ends in,
        beside its first parse, until both are in one state: from there on they are the
        same.  A lane that isn't by its end hands another state on, so the next is
        parsed again.  The pieces are those of whole texts.
        """
        sym = []
        for t in texts:
            s = self.code[np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32)]
            if len(s):
                s = s[np.r_[True, (s[1:] != 0) | (s[:-1] != 0)]]  # runs of blanks are one
            sym.append(s)
        n = np.array([len(s) for s in sym], np.int64)
        flat = np.concatenate(sym) if sym else np.zeros(0, np.int32)
        lanes = -(-n // LANE)
        owner = np.repeat(np.arange(len(texts)), lanes)
        first = np.cumsum(lanes) - lanes
        k = np.arange(len(owner)) - np.repeat(first, lanes)
        start = np.repeat(np.cumsum(n) - n, lanes) + k * LANE
        size = np.minimum(LANE, n[owner] - k * LANE)
        order = np.argsort(-size, kind="stable")
        alive = len(size) - np.searchsorted(size[order][::-1], np.arange(LANE), "right")
        final = np.broadcast_to(self.roots[:, None], (len(self.roots), len(owner))).copy()
        ended = np.zeros(final.shape, np.int64)
        for i in range(LANE):
            m = order[: alive[i]]
            if not len(m):
                break
            final[:, m], new = self.step(final[:, m], slice(None), flat[start[m] + i])
            ended[:, m] += new
        own_final, own_ended = final.copy(), ended.copy()
        lang, lane = (x.ravel() for x in np.meshgrid(np.arange(len(self.roots)), np.flatnonzero(k > 0), indexing="ij"))
        while len(lane):
            before, was = final[lang, lane - 1], final[lang, lane]
            a, b, extra = self.roots[lang], before, np.zeros(len(lane), np.int64)
            open_ = np.flatnonzero(a != b)
            for i in range(LANE):
                open_ = open_[size[lane[open_]] > i]
                if not len(open_):
                    break
                c, x = flat[start[lane[open_]] + i], lang[open_]
                na, ea = self.step(a[open_], x, c)
                nb, eb = self.step(b[open_], x, c)
                a[open_], b[open_] = na, nb
                extra[open_] += eb.astype(np.int64) - ea
                open_ = open_[na != nb]
            ended[lang, lane] = own_ended[lang, lane] + extra
            final[lang, lane] = np.where(a == b, own_final[lang, lane], b)
            # those whose lane before ends otherwise now
            turned = (final[lang, lane] != was) & (lane + 1 < len(k))
            lang, lane = lang[turned], lane[turned] + 1
            own = k[lane] > 0
            lang, lane = lang[own], lane[own]
        count = np.array([np.bincount(owner, e, len(texts)) for e in ended]).T.reshape(len(texts), len(self.roots))
        return count + (n > 0)[:, None], n


def shares(lengths: list[int], chars: int) -> list[int]:
    """Characters to take of texts of these lengths: equal shares, what short ones leave over shared by the others."""
    out, left = [0] * len(lengths), chars
    for done, i in enumerate(sorted(range(len(lengths)), key=lengths.__getitem__)):
        out[i] = min(lengths[i], left // (len(lengths) - done))
        left -= out[i]
    return out


def learn_samples(docs: DataFrame, per_lang: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """A bounded sample of text per language of the documents outside the held-out fold."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~F.coalesce(held_out(), F.lit(False)))
    first = Window.partitionBy("lang").orderBy("h", "doc_id", "th")
    few = rows.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("th"), F.length("text").alias("n")).withColumn("k", F.row_number().over(first)).filter(F.col("k") <= per_lang)
    by_lang: dict[str, list] = {}
    for r in few.collect():  # per_lang rows a language at most
        by_lang.setdefault(r["lang"], []).append(r)
    asked = []
    for lang, found in by_lang.items():
        for r, take in zip(found, shares([r["n"] for r in found], chars)):
            if take:
                asked.append((lang, r["th"], r["k"], 1 + r["h"] % (r["n"] - take + 1), take))
    if not asked:
        return {}
    want = docs.sparkSession.createDataFrame(asked, "lang string, th long, k int, start int, take int")
    if len(asked) <= FEW:  # known to be small: no exchange of texts
        want = F.broadcast(want)
    texts = docs.select("lang", "text", F.xxhash64("text").alias("th")).join(want, ["lang", "th"])
    got = texts.groupBy("lang", "k").agg(F.min(F.substring(F.col("text"), F.col("start"), F.col("take"))).alias("text")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["k"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return {lang: "\n".join(t) for lang, t in out.items()}


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def predict_language(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """doc_id, lang_pred, score, nats_per_char of every row; reads no column but doc_id (carried) and text."""
    rows = docs.select("doc_id", F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))
    key = hash(tuple(sorted(samples.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _READY:
            _READY.clear()
            _READY[key] = Parsers(samples)
        ready = _READY[key]
        langs = ready.langs
        for b in slices(batches, "text", STEP):
            texts = b.column(1).to_pylist()
            pred, score, rate = [], [], []
            count, n = ready.pieces([t or "" for t in texts]) if langs else (np.zeros((len(texts), 0)), np.zeros(len(texts)))
            for t, c, k in zip(texts, count, n):
                if t is None or not langs:
                    pred.append("und"), score.append(0.0), rate.append(None)
                    continue
                c = c * ready.bits
                best = int(np.argmin(c))
                rest = np.delete(c, best)
                pred.append(langs[best])
                score.append(float(1 - c[best] / rest.min()) if len(rest) else 1.0)
                rate.append(float(c[best] / max(1, k)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], ["doc_id", "lang_pred", "score", "nats_per_char"])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, nats_per_char double")


def identify_languages(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    out = predict_language(docs, learn_samples(docs))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "nats_per_char")
