"""SentencePiece BPE encoding and decoding with vectorised merge rounds.

Blanks become the model's blank mark and a text is cut before each run of marks,
and around each character that no piece of the model holds together with others:
no merge crosses these cuts (checked against the model's pieces when it is read).
The distinct units of a batch are laid out as one flat array of symbols.  In every
round each unit finds the rank of its best pair (segmented minimum) and merges all
pairs that have it, leftmost first, at once; the array is compacted, until no pair is
left.  Where one of these merges forms a pair that ranks before the others, the
library would take that one next; such a unit merges its leftmost pair alone in that
round.  Long units need more rounds, in which the others take no part any more.

The ids of a unit are kept for the other batches of a task, within a bound.

Edge cases: null text counts as empty and gives the begin and end ids alone; the
blank mark in a text is a blank to the model and decodes as one; characters out
of the vocabulary become byte pieces, so nothing is lost; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranges, slices

MARK, KEEP, STEP = "▁", 200_000, 2 << 20
NONE = np.iinfo(np.int64).max
_MODELS: dict[str, PieceModel] = {}


class PieceModel:
    """Ranks, ids and bytes of a BPE model file with byte fallback and no normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.byte_id, self.id_of, self.score = [self.unk] * 256, {}, {}
        self.piece_bytes: list[bytes] = []
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[1:-1], 16)] = i
                self.piece_bytes.append(bytes([int(p[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.piece_bytes.append(b"")
            else:
                self.id_of[p], self.score[p] = i, sp.get_score(i)
                self.piece_bytes.append(p.replace(MARK, " ").encode())
        pieces = list(self.id_of)
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds a blank after other characters: units can't be cut at blanks")
        self.joined = {c for p in pieces if len(p) > 1 for c in p}
        # symbols are numbered: pieces first, then single characters without a piece
        self.symbol = {p: k for k, p in enumerate(pieces)}
        self.text = pieces
        rank = {s: r for r, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = np.array([rank[self.score[p]] for p in pieces], np.int64)
        keys, into = [], []
        for p in pieces:
            for cut in range(1, len(p)):
                a, b = self._single(p[:cut]), self._single(p[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    into.append(self.symbol[p])
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.pair = np.array(keys, np.int64)[order]
        self.into = np.array(into, np.int32)[order]
        ids = [self._ids(p) for p in self.text]
        self.size_of_symbol = np.array([len(i) for i in ids], np.int64)
        self.flat_ids = np.array([i for own in ids for i in own], np.int64)
        # the symbol of each code point that is one
        self.single = np.full(0x110000, -1, np.int32)
        for p, k in self.symbol.items():
            if len(p) == 1:
                self.single[ord(p)] = k
        # begin and end of each piece's bytes, for decoding
        self.blob = np.frombuffer(b"".join(self.piece_bytes), np.uint8)
        self.blob_len = np.array([len(b) for b in self.piece_bytes], np.int64)
        self.blob_at = np.cumsum(self.blob_len) - self.blob_len
        self.kept: dict[str, tuple[int, ...]] = {}
        self.cut = re.compile(f"(?<=[^{MARK}])(?={MARK})|(?<=[\n\t])(?=.)|(?<=.)(?=[\n\t])", re.S) if not self.joined & {"\n", "\t"} else re.compile(f"(?<=[^{MARK}])(?={MARK})")

    def _single(self, s: str) -> int | None:
        """The symbol that is exactly ``s``: a piece, or a lone character."""
        if s not in self.symbol:
            if len(s) > 1:
                return None
            self.symbol[s] = len(self.text)
            self.text.append(s)
        return self.symbol[s]

    def _ids(self, s: str) -> tuple[int, ...]:
        return (self.id_of[s],) if s in self.id_of else tuple(self.byte_id[b] for b in s.encode("utf-8"))

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Symbol that a pair merges into, or -1."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair, key)
        at[at == len(self.pair)] = 0
        return np.where(self.pair[at] == key, self.into[at], -1)

    def merge_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Final symbols of all units joined, how many each has, and the characters behind symbols the model lacks."""
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        sym = self.single[codes].astype(np.int64)
        lacking = sym < 0  # characters the model doesn't know: each is a symbol of this call
        extra, which = np.unique(codes[lacking], return_inverse=True)
        sym[lacking] = len(self.text) + which
        length = np.array([len(u) for u in units], np.int64)
        done = np.empty(len(sym), np.int64)
        done_len = np.zeros(len(units), np.int64)
        done_at = np.cumsum(length) - length
        live = np.arange(len(units))
        seg = np.repeat(live, length)
        # what each symbol and the next of its unit merge into, and that pair's rank
        to, rank = np.full(len(sym), -1, np.int64), np.full(len(sym), NONE)
        at = np.flatnonzero(seg[1:] == seg[:-1])
        to[at] = self.lookup(sym[at], sym[at + 1])
        rank[at] = self.ranks(to[at])
        while len(live):
            best = np.minimum.reduceat(rank, np.cumsum(length) - length)
            if (end := best == NONE).any():
                out = np.repeat(end, length)
                done_len[live[end]] = length[end]
                done[ranges(done_at[live[end]], length[end])] = sym[out]
                sym, to, rank = sym[~out], to[~out], rank[~out]
                live, length, best = live[~end], length[~end], best[~end]
                if not len(live):
                    break
            seg = np.repeat(np.arange(len(live)), length)
            hit = self.sites(sym, to, rank, seg, np.flatnonzero(rank == best[seg]))
            sym[hit] = to[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            length -= np.bincount(seg[hit], minlength=len(live))
            hit -= np.arange(len(hit))  # places after compaction
            sym, to, rank, seg = sym[keep], to[keep], rank[keep], seg[keep]
            # only pairs of a merged symbol have changed
            moved = np.zeros(len(sym), bool)
            moved[hit] = moved[np.maximum(hit - 1, 0)] = True
            at = np.flatnonzero(moved)
            to[at], rank[at] = -1, NONE
            at = at[at + 1 < len(sym)]
            at = at[seg[at] == seg[at + 1]]
            to[at] = self.lookup(sym[at], sym[at + 1])
            rank[at] = self.ranks(to[at])
        return done[ranges(done_at, done_len)], done_len, [chr(c) for c in extra]

    def ranks(self, to: np.ndarray) -> np.ndarray:
        return np.where(to >= 0, self.rank[to], NONE)

    def sites(self, sym: np.ndarray, to: np.ndarray, rank: np.ndarray, seg: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Which of the pairs at ``hit``, the best of their units, merge in this round.

        Of overlapping pairs the leftmost, and so on along the unit.  One merge after
        the other would do the same, unless a merge forms a pair that ranks before the
        others; in a unit where one does, only the leftmost pair merges now.
        """
        begins = np.flatnonzero(np.r_[True, hit[1:] != hit[:-1] + 1])
        place = np.arange(len(hit)) - np.repeat(begins, np.diff(np.r_[begins, len(hit)]))
        hit = hit[place % 2 == 0]
        own = seg[hit]
        first = np.r_[True, own[1:] != own[:-1]]
        if first.all():
            return hit
        into = to[hit]
        before = np.full(len(hit), NONE)
        left = hit - 1
        in_unit = (left >= 0) & (seg[left] == own)
        beside = np.r_[False, hit[1:] == hit[:-1] + 2] & ~first
        with_left = np.where(beside, np.r_[into[:1], into[:-1]], sym[left])
        before[in_unit] = self.ranks(self.lookup(with_left[in_unit], into[in_unit]))
        right = np.minimum(hit + 2, len(sym) - 1)
        in_unit = (hit + 2 < len(sym)) & (seg[right] == own)
        after = np.full(len(hit), NONE)
        after[in_unit] = self.ranks(self.lookup(into[in_unit], sym[right][in_unit]))
        one = np.zeros(int(own[-1]) + 1, bool)
        one[own[np.minimum(before, after) < rank[hit]]] = True
        return hit[first | ~one[own]]

    def ids_of(self, units: list[str]) -> dict[str, tuple[int, ...]]:
        """The ids of each unit; none is empty."""
        symbols, count, extra = self.merge_units(units)
        more = [self._ids(c) for c in extra]
        size = np.r_[self.size_of_symbol, np.array([len(i) for i in more], np.int64)]
        flat = np.r_[self.flat_ids, np.array([i for ids in more for i in ids], np.int64)]
        at = np.cumsum(size) - size
        ids = flat[ranges(at[symbols], size[symbols])].tolist()
        ends = np.r_[0, np.cumsum(size[symbols])][np.cumsum(count)].tolist()
        return {u: tuple(ids[i:j]) for u, i, j in zip(units, [0, *ends], ends)}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, begin and end included."""
        cut = [self.cut.split(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        units_here = {u for units in cut for u in units}
        known = {u: self.kept[u] for u in units_here if u in self.kept}
        if new := self.ids_of(sorted(units_here - known.keys())):
            known |= new
            # the store only saves work: no batch reads it after this
            if len(self.kept) + len(new) > KEEP:
                self.kept.clear()
            self.kept.update(islice(new.items(), KEEP))
        out = []
        for units in cut:
            ids = [self.bos]
            for u in units:
                ids += known[u]
            ids.append(self.eos)
            out.append(np.array(ids, np.uint32))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text that the ids stand for, without the blank put in front."""
        raw = self.blob[ranges(self.blob_at[ids], self.blob_len[ids])].tobytes()
        return raw[1:] if raw[:1] == b" " else raw


def model_at(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int), decoded text of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path)
        for b in slices(batches, "text", STEP):
            ids = model.encode(b.column(1).to_pylist())
            texts = [model.decode(i) for i in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], ["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest_pieces(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path)
        for b in slices(batches, "text", STEP):
            ids = model.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids]), pa.array([hashlib.sha256(model.decode(i)).hexdigest() for i in ids])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
