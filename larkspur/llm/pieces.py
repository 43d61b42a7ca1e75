"""SentencePiece encoding and decoding: the N best segmentations of a text over the piece lattice.

The pieces come from a public vocabulary file. It ranks its pieces, so a piece's score is the log probability of its
rank under Zipf's law, and a path's score is the sum over its pieces; characters without a piece of their own are
spelled in byte pieces, at ``BYTE_PENALTY`` below the last rank. As in the library, a space becomes the mark U+2581,
one more stands before the text, and nothing else is normalised. A mark that is in the text itself is spelled in
bytes, so decoding always gives the text back.

No piece has a mark behind another character, so the lattice falls apart before each mark (and around line ends,
which no piece holds). Forward and backward Viterbi run over all distinct segments of a batch at once in numpy and
give each segment's best path and the score of its second best. For the N best paths of a whole text only the N - 1
segments with the smallest loss from best to second best can differ from the best path; for those the N best paths
come from a backward A* search whose heuristic, the forward Viterbi score, is exact. Their combinations are merged.

A null text gives null (no segmentation); an empty one has one segmentation without pieces. Fewer than N
segmentations are returned only where no more exist. Among equal scores the order is that in which the search meets
them, which depends on the text alone. Memory and time are linear in a segment's length, however long it is. Equal texts
have equal segmentations, repeated rows stay, an empty table gives an empty one, and other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from larkspur.llm._store import read_table, ship
from larkspur.llm._text import raw_bytes, slices
from larkspur.llm.token_counts import vocabulary_path

VOCABULARY = "piece_bpe_32k.model"
N_BEST = 4
BYTE_PENALTY = 2.0
MARK = 0xFF  # stands for U+2581; not a byte of any UTF-8 text
LONG = 40
#: Bytes of segments and of their paths, as estimated, that a task keeps.
_CACHE = 64 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BREAKS = b"\n\r\t"


class Lattice:
    """A vocabulary, and the paths through its pieces."""

    def __init__(self, name: str = VOCABULARY):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(name))
        n = sp.get_piece_size()
        rank = {i: -sp.get_score(i) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        order = {i: r for r, i in enumerate(sorted(rank, key=lambda i: (rank[i], i)))}
        total = math.log(sum(1 / (r + 2) for r in range(len(order))))
        self.score = np.full(n + 1, -np.inf)
        for i, r in order.items():
            self.score[i] = -math.log(r + 2) - total
        self.byte_score = -math.log(len(order) + 2) - total - BYTE_PENALTY
        #: The score of each piece on a path; ``score`` is without the byte pieces, which are no words of their own.
        self.worth = self.score.tolist()
        self.byte_id = np.zeros(256, np.int64)
        self.raw: list[bytes] = [b""] * n
        self.pieces: dict[bytes, int] = {}
        for i in range(n):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_id[b], self.raw[i] = i, bytes([b])
                self.worth[i] = self.byte_score
            elif i in order:
                key = sp.id_to_piece(i).encode().replace("▁".encode(), bytes([MARK]))
                self.pieces[key], self.raw[i] = i, key.replace(bytes([MARK]), b" ")
        self.longest = max(map(len, self.pieces))
        whole = [k.lstrip(bytes([MARK])) for k in self.pieces]
        self.splits = not any(MARK in k for k in whole)
        self.breaks = bytes(b for b in _BREAKS if not any(b in k for k in self.pieces))
        self.table_bits = 20
        self.salt = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64) | np.uint64(1)
        keys = np.array([self._hash(k) for k in self.pieces], np.uint64)
        slot = (keys >> np.uint64(64 - self.table_bits)).astype(np.int64)
        self.keys, self.ids = np.zeros(1 << self.table_bits, np.uint64), np.full(1 << self.table_bits, -1, np.int64)
        rest: dict[int, int] = {}
        for h, s, i in zip(keys, slot, self.pieces.values(), strict=True):
            if self.ids[s] < 0:
                self.keys[s], self.ids[s] = h, i
            else:
                rest[int(h)] = i
        over = sorted(rest)
        self.more_keys, self.more_ids = np.array(over, np.uint64), np.array([rest[h] for h in over], np.int64)
        self.crowded = np.zeros(1 << self.table_bits, bool)
        if over:
            self.crowded[(self.more_keys >> np.uint64(64 - self.table_bits)).astype(np.int64)] = True
        self.starts = {k[:n] for k in self.pieces for n in range(1, len(k) + 1)}
        self.cache: dict[bytes, list[tuple[float, tuple[int, ...]]]] = {}
        self.cached = 0

    def _hash(self, key: bytes) -> int:
        h = 0
        for b in key:
            h = ((h + int(self.salt[b])) * int(_MULT)) & (2**64 - 1)
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        slot = (h >> np.uint64(64 - self.table_bits)).astype(np.int64)
        out = np.where(self.keys[slot] == h, self.ids[slot], -1)
        odd = np.flatnonzero(self.crowded[slot] & (out < 0))
        if len(odd):
            at = np.minimum(np.searchsorted(self.more_keys, h[odd]), len(self.more_keys) - 1)
            hit = self.more_keys[at] == h[odd]
            out[odd[hit]] = self.more_ids[at[hit]]
        return out

    # -- one segment ------------------------------------------------------------------------------------------
    def edges(self, seg: bytes) -> tuple[np.ndarray, array, array]:
        """The edges of a segment's lattice by their end: where the edges into each position begin (one more entry at the
        end), the start of each and its piece."""
        start, end, piece = array("q"), array("q"), array("q")
        for i in range(len(seg)):
            if 0x80 <= seg[i] < 0xC0:
                continue
            w = _char_bytes(seg[i])
            whole = None
            for j in range(i + 1, min(i + self.longest, len(seg)) + 1):
                key = seg[i:j]
                if key not in self.starts:
                    break
                p = self.pieces.get(key)
                if p is not None:
                    start.append(i)
                    end.append(j)
                    piece.append(p)
                    if j == i + w:
                        whole = p
            if whole is None:
                for k in range(i, min(i + w, len(seg))):
                    start.append(k)
                    end.append(k + 1)
                    piece.append(int(self.byte_id[seg[k]]))
        ends = np.frombuffer(end, np.int64) if len(end) else np.zeros(0, np.int64)
        order = np.argsort(ends, kind="stable")
        into = lambda a: array("q", np.frombuffer(a, np.int64)[order].tobytes()) if len(a) else a
        return np.searchsorted(ends[order], np.arange(len(seg) + 2)), into(start), into(piece)

    def search(self, seg: bytes, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best paths of a segment: forward Viterbi, then A* from its end back to its start. The heuristic is exact, so each
        entry of the heap stands for a whole path of its score, and no more than the n best entries can matter."""
        first, start, piece = self.edges(seg)
        first, worth = first.tolist(), self.worth
        forward = array("d", [0.0]) + array("d", [-math.inf]) * len(seg)
        for j in range(1, len(seg) + 1):
            forward[j] = max((forward[start[e]] + worth[piece[e]] for e in range(first[j], first[j + 1])), default=-math.inf)
        met, found = itertools.count(), []
        heap = [(-forward[-1], next(met), len(seg), None, 0.0)]
        while heap and len(found) < n:
            f, _, at, path, cost = heapq.heappop(heap)
            if not at:
                pieces = []
                while path:
                    pieces.append(path[0])
                    path = path[1]
                found.append((-f, tuple(pieces)))
                continue
            for e in range(first[at], first[at + 1]):
                s = worth[piece[e]]
                heapq.heappush(heap, (-(forward[start[e]] + s + cost), next(met), start[e], (piece[e], path), cost + s))
            if len(heap) > 4 * n + 64:
                heap = heapq.nsmallest(n - len(found), heap)
        return found

    def paths(self, seg: bytes, n: int, best: tuple[int, ...]) -> list[tuple[float, tuple[int, ...]]]:
        """(loss, pieces) of the n best paths, the given best one first."""
        found = self.cache.get(seg)
        if found is None or len(found) < n:
            found = self.search(seg, n + 1)
            if self.cached > _CACHE:
                self.cache.clear()
                self.cached = 0
            size = 200 + len(seg) + sum(150 + 40 * len(p) for _, p in found)
            if size < _CACHE // 16:
                self.cache[seg] = found
                self.cached += size
        top = found[0][0]
        return [(0.0, best), *[(max(0.0, top - s), p) for s, p in found if p != best][: n - 1]]

    # -- all segments of a batch ------------------------------------------------------------------------------
    def solve(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each segment the best score, the loss to the second best, and its best path's pieces, one segment
        after another, with the number in each."""
        m = len(start)
        score, loss, count = np.zeros(m), np.full(m, np.inf), np.zeros(m, np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for n in np.unique(length):
            rows = np.flatnonzero(length == n)
            if n > LONG:
                for r in rows:
                    seg = data[start[r] : start[r] + n].tobytes()
                    two = self._long(seg)
                    score[r], loss[r], count[r] = two[0], two[1], len(two[2])
                    found.append((np.array([r]), np.array([two[2]], np.int64)))
                continue
            for part in np.array_split(rows, max(1, len(rows) * int(n) // 200_000)):
                w = data[start[part][:, None] + np.arange(n)]
                s, d, ids = self._viterbi(w)
                score[part], loss[part], count[part] = s, d, (ids >= 0).sum(1)
                found.append((part, ids))
        at = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int64)
        for part, ids in found:
            keep = ids >= 0
            to = at[part][:, None] + np.cumsum(keep, 1) - 1
            out[to[keep]] = ids[keep]
        return score, loss, out, count

    def _viterbi(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m, n = w.shape
        ids = np.full((n, min(n, self.longest) + 1, m), -1, np.int64)
        with np.errstate(over="ignore"):
            for i in range(n):
                h = np.zeros(m, np.uint64)
                for k in range(1, min(n - i, self.longest) + 1):
                    h = (h + self.salt[w[:, i + k - 1]]) * _MULT
                    ids[i, k] = self.find(h)
        spelled = np.zeros((n, m), bool)
        for i in range(n):
            width = _CHAR[w[:, i]]
            for c in range(1, min(4, n - i) + 1):
                lone = (width == c) & (ids[i, c] < 0 if c < ids.shape[1] else True)
                if lone.any():
                    spelled[i : i + c] |= lone
        forward, back = np.full((n + 1, m), -np.inf), np.zeros((n + 1, m), np.int64)
        forward[0] = 0
        for j in range(1, n + 1):
            s = np.where(spelled[j - 1], forward[j - 1] + self.byte_score, -np.inf)
            forward[j] = s
            for k in range(1, min(j, ids.shape[1] - 1) + 1):
                s = forward[j - k] + self.score[ids[j - k, k]]
                better = s > forward[j]
                if better.any():
                    forward[j] = np.where(better, s, forward[j])
                    back[j] = np.where(better, k, back[j])
        backward = np.full((n + 1, m), -np.inf)
        backward[n] = 0
        for i in range(n - 1, -1, -1):
            b = np.where(spelled[i], backward[i + 1] + self.byte_score, -np.inf)
            for k in range(1, min(n - i, ids.shape[1] - 1) + 1):
                b = np.maximum(b, self.score[ids[i, k]] + backward[i + k])
            backward[i] = b
        # The best path, from its end; chosen[j]: the length of its edge into j, 0 for a byte, -1 for none.
        chosen, path = np.full((n + 1, m), -1, np.int64), np.full((m, n), -1, np.int64)
        at = np.full(m, n)
        for j in range(n, 0, -1):
            here = np.flatnonzero(at == j)
            if not len(here):
                continue
            k = back[j, here]
            chosen[j, here] = k
            path[here, j - 1] = np.where(k > 0, ids[j - np.maximum(k, 1), k, here], self.byte_id[w[here, j - 1]])
            at[here] = j - np.maximum(k, 1)
        second = np.full(m, -np.inf)
        for j in range(1, n + 1):
            s = np.where(spelled[j - 1] & (chosen[j] != 0), forward[j - 1] + self.byte_score + backward[j], -np.inf)
            second = np.maximum(second, s)
            for k in range(1, min(j, ids.shape[1] - 1) + 1):
                s = forward[j - k] + self.score[ids[j - k, k]] + backward[j]
                second = np.maximum(second, np.where(chosen[j] != k, s, -np.inf))
        return forward[n], np.maximum(0.0, forward[n] - second), path

    def _long(self, seg: bytes) -> tuple[float, float, list[int]]:
        first, start, piece = self.edges(seg)
        first, worth = first.tolist(), self.worth
        n = len(seg)
        forward, back = array("d", [0.0]) + array("d", [-math.inf]) * n, array("q", [-1]) * (n + 1)
        for j in range(1, n + 1):
            for e in range(first[j], first[j + 1]):
                s = forward[start[e]] + worth[piece[e]]
                if s > forward[j]:
                    forward[j], back[j] = s, e
        backward = array("d", [-math.inf]) * n + array("d", [0.0])
        for j in range(n, 0, -1):
            for e in range(first[j], first[j + 1]):
                s = worth[piece[e]] + backward[j]
                if s > backward[start[e]]:
                    backward[start[e]] = s
        path, at, on = [], n, bytearray(len(start))
        while at:
            e = back[at]
            on[e] = 1
            path.append(piece[e])
            at = start[e]
        second = -math.inf
        for j in range(1, n + 1):
            for e in range(first[j], first[j + 1]):
                if not on[e]:
                    second = max(second, forward[start[e]] + worth[piece[e]] + backward[j])
        return forward[-1], max(0.0, forward[-1] - second), path[::-1]

    # -- whole texts ------------------------------------------------------------------------------------------
    def encode(self, texts: pa.Array, n: int = N_BEST) -> list[list[tuple[float, np.ndarray]] | None]:
        """For each text its n best segmentations, (score, pieces) each, best first."""
        data, offsets = raw_bytes(texts)
        some = np.diff(offsets) > 0
        # A mark before each text that is not empty; marks for spaces.
        shifted = offsets[:-1] + np.cumsum(some) - some
        marked = np.empty(len(data) + int(some.sum()), np.uint8)
        lead = np.zeros(len(marked), bool)
        lead[shifted[some]] = True
        marked[lead], marked[~lead] = MARK, np.where(data == 32, np.uint8(MARK), data)
        cut = lead.copy()
        if self.splits:
            cut[1:] |= (marked[1:] == MARK) & (marked[:-1] != MARK)
            for b in self.breaks:
                at = np.flatnonzero(marked == b)
                cut[at] = True
                cut[at[at + 1 < len(cut)] + 1] = True
        start = np.flatnonzero(cut)
        length = np.diff(np.append(start, len(marked)))
        first = np.searchsorted(start, np.append(shifted, len(marked)))
        if len(start):
            h = _segment_hashes(marked, start, length)
            _, one, inverse = np.unique(h, return_index=True, return_inverse=True)
            score, loss, ids, count = self.solve(marked, start[one], length[one])
            where = np.cumsum(count) - count
        out: list[list[tuple[float, np.ndarray]] | None] = []
        valid = texts.is_valid().to_pylist()
        for t in range(len(texts)):
            if not valid[t]:
                out.append(None)
                continue
            seg = inverse[first[t] : first[t + 1]] if first[t + 1] > first[t] else np.zeros(0, np.int64)
            if not len(seg):
                out.append([(0.0, np.zeros(0, np.int64))])
                continue
            each = count[seg]
            ends = np.cumsum(each)
            best = ids[np.repeat(where[seg] - (ends - each), each) + np.arange(ends[-1])]
            total = float(score[seg].sum())
            choices = self._combine(marked, start[first[t] : first[t + 1]], length[first[t] : first[t + 1]], loss[seg], best, ends, each, n)
            result = []
            for lost, changes in choices:
                parts, at = [], 0
                for k, pieces in changes:
                    parts += [best[at : ends[k] - each[k]], np.array(pieces, np.int64)]
                    at = ends[k]
                result.append((total - lost, np.concatenate([*parts, best[at:]])))
            out.append(result)
        return out

    def _combine(self, marked, start, length, loss, best, ends, each, n) -> list[tuple[float, tuple]]:
        if n < 2 or not np.isfinite(loss).any():
            return [(0.0, ())]
        most = n - 1
        if len(loss) > most:
            bar = np.partition(loss, most - 1)[most - 1]
            candidates = np.flatnonzero(loss <= bar)
            candidates = candidates[np.argsort(loss[candidates], kind="stable")][:most]
        else:
            candidates = np.arange(len(loss))
        kept: list[tuple[float, tuple]] = [(0.0, ())]
        for k in sorted(candidates.tolist()):
            if not np.isfinite(loss[k]):
                continue
            seg = marked[start[k] : start[k] + length[k]].tobytes()
            own = tuple(best[ends[k] - each[k] : ends[k]].tolist())
            options = self.paths(seg, n, own)
            merged = [(a + b, changes if p == own else (*changes, (k, p))) for a, changes in kept for b, p in options]
            kept = heapq.nsmallest(n, merged, key=lambda x: (round(x[0], 9), x[1]))
        return kept

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of pieces."""
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


def _char_bytes(b: int) -> int:
    return 1 if b < 0xC0 or b == MARK else 2 if b < 0xE0 else 3 if b < 0xF0 else 4


_CHAR = np.array([0 if 0x80 <= b < 0xC0 else _char_bytes(b) for b in range(256)])


def _segment_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    from larkspur.llm._text import _BASE, _BASE_INV, _EXACT, _powers, mix

    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_EXACT[data] * _powers(len(data), _BASE), out=total[1:])
        return mix((total[start + length] - total[start]) * _powers(len(data), _BASE_INV)[start] + length.astype(np.uint64))


@lru_cache(maxsize=2)
def lattice(name: str = VOCABULARY) -> Lattice:
    return Lattice(name)


def encode_nbest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N_BEST, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, rank, score, n_pieces, pieces): a row for each of the n best segmentations of each text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(vocabulary)
        for batch in batches:
            at = 0
            for part in slices(batch.column(1), 2 << 20):
                owner, rank, score, pieces = [], [], [], []
                for i, paths in enumerate(model.encode(part, n)):
                    for r, (s, ids) in enumerate(paths or []):
                        owner.append(at + i)
                        rank.append(r)
                        score.append(round(s, 6))
                        pieces.append(ids.astype(np.int32))
                ends = np.cumsum([0, *map(len, pieces)])
                flat = pa.array(np.concatenate(pieces) if pieces else np.zeros(0, np.int32), pa.int32())
                yield pa.record_batch([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(rank, pa.int32()), pa.array(score, pa.float64()), pa.array(np.diff(ends), pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["doc_id", "rank", "score", "n_pieces", "pieces"])
                at += len(part)

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, rank int, score double, n_pieces int, pieces array<int>")


def decode_pieces(rows: DataFrame, pieces_col: str = "pieces", out_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """rows with the text of a column of pieces; null pieces give null."""
    from pyspark.sql import functions as F

    ship(rows.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = lattice(vocabulary)
        for column in batches:
            yield pa.array([None if not x.is_valid else model.decode(np.asarray(x.values)) for x in column], pa.string())

    return rows.withColumn(out_col, F.arrow_udf(run, "string")(F.col(pieces_col)))


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N_BEST, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row for each text that is not null: the best segmentation with its score, the scores and the pieces of the other
    n - 1, best first, and whether every one of them decodes to the text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(vocabulary)
        for batch in batches:
            at = 0
            for part in slices(batch.column(1)):
                owner, rows = [], []
                for i, (value, paths) in enumerate(zip(part, model.encode(part, n), strict=True)):
                    if paths is None:
                        continue
                    text = value.as_py()
                    owner.append(at + i)
                    pieces = [ids.astype(np.int32) for _, ids in paths]
                    rows.append((round(paths[0][0], 6), len(pieces[0]), pieces[0], [round(s, 6) for s, _ in paths[1:]], pieces[1:], all(model.decode(x) == text for x in pieces)))
                kinds = [pa.float64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.list_(pa.int32())), pa.bool_()]
                made = [pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)]
                yield pa.record_batch([batch.column(0).take(pa.array(owner, pa.int64())), *made], names=["doc_id", "score", "n_pieces", "pieces", "other_scores", "other_pieces", "round_trip"])
                at += len(part)

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, score double, n_pieces int, pieces array<int>, other_scores array<double>, other_pieces array<array<int>>, round_trip boolean")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N_BEST, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row for each text: pieces in the best segmentation, SHA-256 of its pieces (32-bit little-endian), the n best
    scores, the piece counts of all n, SHA-256 of the other segmentations, and whether every one of them decodes to
    the text. All but doc_id are null for a null text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(vocabulary)
        for batch in batches:
            at = 0
            for part in slices(batch.column(1), 2 << 20):
                rows = []
                for value, paths in zip(part, model.encode(part, n), strict=True):
                    if paths is None:
                        rows.append((None,) * 6)
                        continue
                    text = value.as_py()
                    other = hashlib.sha256()
                    for _, ids in paths[1:]:
                        other.update(ids.astype("<i4").tobytes())
                    best = paths[0][1]
                    rows.append((len(best), hashlib.sha256(best.astype("<i4").tobytes()).hexdigest(), [round(s, 6) for s, _ in paths], [len(x) for _, x in paths], other.hexdigest(), all(model.decode(x) == text for _, x in paths)))
                kinds = [pa.int64(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.string(), pa.bool_()]
                made = [pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)]
                yield pa.record_batch([batch.column(0).slice(at, len(part)), *made], names=["doc_id", "n_pieces", "pieces_sha256", "scores", "piece_counts", "others_sha256", "round_trip"])
                at += len(part)

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, n_pieces long, pieces_sha256 string, scores array<double>, piece_counts array<int>, others_sha256 string, round_trip boolean")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))
