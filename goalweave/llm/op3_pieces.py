"""SentencePiece encoding and decoding by suffix-array matching, for byte-fallback BPE models.

A batch's text is cut into segments that no piece crosses: runs of spaces stay with the word they precede, and a line
feed stands alone if no piece holds one. Distinct segments that the worker has not met yet are concatenated and indexed:

1. The suffixes of the concatenation are sorted (as far as the longest piece reaches).
2. Every piece of two or more characters is looked up by binary search; its range of suffixes lists all its occurrences.
3. These edges (start, length, piece) are sorted by position.
4. Relaxation: each segment starts as single characters, and in every round takes the edge over two neighbouring symbols
   with the best score (the leftmost of equal ones) until no edge joins two neighbours. Long segments do the same with a
   heap. What remains are the model's own ids; characters without a piece become their bytes.

Decoding joins the pieces' bytes, turns the space mark into a space and drops the space put in front. Text comes back
exactly unless it holds the space mark U+2581 itself, which is decoded as a space, as the model has it.

Null and empty texts have no ids and decode to the empty text. Only models without normalisation are accepted. Any other
columns named in ``keep`` pass through; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from . import kernels

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPACE = "▁"
#: Longest piece in characters (four 64-bit keys of four 16-bit characters), and segments relaxed with a heap.
REACH, LONG = 16, 64
CACHE_WORDS, SLICE_CHARS = 300_000, 2_000_000
#: New segments that are indexed together.
NEW_SEGMENTS = 30_000
NONE = np.iinfo(np.int64).max


class Pieces:
    """A model's pieces as tables."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        texts = [model.id_to_piece(i) for i in range(n)]
        scores = np.array([model.get_score(i) for i in range(n)], dtype=np.float32)
        special = [model.is_control(i) or model.is_unknown(i) for i in range(n)]
        self.byte_ids = np.zeros(256, dtype=np.int64)
        raw = []
        for i, text in enumerate(texts):
            if model.is_byte(i):
                self.byte_ids[int(text[3:5], 16)] = i
                raw.append(bytes([int(text[3:5], 16)]))
            elif model.is_unknown(i):
                raw.append(" ⁇ ".encode())
            else:
                raw.append(b"" if special[i] else text.replace(SPACE, " ").encode())
        if model.encode("ﬁ", out_type=str) != [SPACE, "ﬁ"] and model.encode("ﬁ", out_type=str) != [SPACE + "ﬁ"]:
            raise ValueError(f"{path} normalises its text")
        usable = [i for i in range(n) if not special[i] and not model.is_byte(i)]
        self.char_id = np.full(0x110000, -1, dtype=np.int32)
        longer = []
        for i in usable:
            if len(texts[i]) == 1:
                self.char_id[ord(texts[i])] = i
            else:
                longer.append(i)
        if any(len(texts[i]) > REACH or SPACE in texts[i].lstrip(SPACE) for i in longer):
            raise ValueError(f"{path} has pieces over {REACH} characters or with spaces inside")
        alphabet = sorted({ord(c) for i in longer for c in texts[i]})
        self.rank = np.zeros(0x110000, dtype=np.uint64)
        self.rank[alphabet] = np.arange(1, len(alphabet) + 1)
        if len(alphabet) >= 0xFFFF:
            raise ValueError(f"{path} has too many characters")
        self.ids = np.array(longer, dtype=np.int64)
        self.length = np.array([len(texts[i]) for i in longer], dtype=np.int64)
        # Better scores first; equal scores share a place, so that position decides between them.
        _, place = np.unique(-scores[self.ids], return_inverse=True)
        self.place = place.astype(np.int64)
        low = np.zeros((len(longer), REACH), dtype=np.uint64)
        for k, i in enumerate(longer):
            low[k, : len(texts[i])] = self.rank[[ord(c) for c in texts[i]]]
        high = np.where(np.arange(REACH) < self.length[:, None], low, np.uint64(0xFFFF))
        self.low, self.high = _packed(low), _packed(high)
        self.raw_length = np.array([len(b) for b in raw], dtype=np.int64)
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        feed = any("\n" in texts[i] for i in usable)
        self.segments = re.compile(r" *[^ ]+| +" if feed else r" *[^ \n]+| +|\n")


def _packed(ranks: np.ndarray) -> list[np.ndarray]:
    parts = ranks.reshape(len(ranks), REACH // 4, 4)
    return [(p[:, 0] << np.uint64(48)) | (p[:, 1] << np.uint64(32)) | (p[:, 2] << np.uint64(16)) | p[:, 3] for p in parts.transpose(1, 0, 2)]


def suffix_order(ranks: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes by their first REACH characters, and their four keys in that order."""
    n = len(ranks)
    ahead = np.concatenate([ranks, np.zeros(REACH + 4, dtype=np.uint64)])
    four = ahead[: n + REACH] << np.uint64(48)
    for k in (1, 2, 3):
        four |= ahead[k : n + REACH + k] << np.uint64(16 * (3 - k))
    keys = [four[4 * k : 4 * k + n] for k in range(REACH // 4)]
    order = np.lexsort(keys[::-1])
    return order, [k[order] for k in keys]


def _bound(keys: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
    """Binary search of many keys at once: the first suffix not below (after: above) each."""
    lo = np.zeros(len(wanted[0]), dtype=np.int64)
    hi = np.full(len(wanted[0]), len(keys[0]), dtype=np.int64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        at = np.minimum(mid, len(keys[0]) - 1)
        less, same = np.zeros(len(mid), dtype=bool), np.ones(len(mid), dtype=bool)
        for key, want in zip(keys, wanted):
            found = key[at]
            less |= same & (found < want)
            same &= found == want
        right = (less | same if after else less) & open_
        lo = np.where(right, mid + 1, lo)
        hi = np.where(right | ~open_, hi, mid)
    return lo


class Edges:
    """All occurrences of pieces in a text, sorted by position: bit L of mask[p] says that one of length L starts at p."""

    def __init__(self, pieces: Pieces, ranks: np.ndarray):
        order, keys = suffix_order(ranks)
        lo, hi = _bound(keys, pieces.low, False), _bound(keys, pieces.high, True)
        count = np.maximum(hi - lo, 0)
        total = int(count.sum())
        inside = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        start = order[np.repeat(lo, count) + inside]
        piece = np.repeat(np.arange(len(count)), count)
        length = pieces.length[piece]
        by_place = np.argsort(start * 32 + length)
        self.piece, start, length = piece[by_place], start[by_place], length[by_place]
        n = len(ranks)
        self.first = np.searchsorted(start, np.arange(n + 1))
        bits = np.int64(1) << length
        self.mask = np.zeros(n, dtype=np.int64)
        if total:
            filled = np.flatnonzero(self.first[:-1] < self.first[1:])
            self.mask[filled] = np.bitwise_or.reduceat(bits, self.first[filled])

    def find(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Piece of each (start, length), or -1."""
        short = np.minimum(length, REACH + 1)
        mask = self.mask[start]
        has = (mask >> short) & 1 == 1
        below = np.bitwise_count(mask & ((np.int64(1) << short) - 1)).astype(np.int64)
        at = np.where(has, self.first[start] + below, 0)
        return np.where(has, self.piece[at] if len(self.piece) else -1, -1)


def _relaxed(pieces: Pieces, edges: Edges, begin: np.ndarray, end: np.ndarray, done: list) -> None:
    """All segments at once, one merge each per round. Appends (start, piece or -1) of the symbols that remain."""
    size = end - begin
    start = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    stop, owner = start + 1, np.repeat(np.arange(len(begin)), size)
    piece = np.full(len(start), -1, dtype=np.int64)
    offered = _offers(edges, start, stop, owner)
    while len(start):
        n = len(start)
        rated = np.where(offered >= 0, pieces.place[offered] * (n + 1) + np.arange(n), NONE)
        heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        best = np.minimum.reduceat(rated, heads)
        over = np.repeat(best == NONE, np.diff(np.append(heads, n)))
        if over.any():
            done.append((start[over], piece[over]))
        chosen = best[best != NONE] % (n + 1)
        piece[chosen] = offered[chosen]
        stop[chosen] = stop[chosen + 1]
        keep = ~over
        keep[chosen + 1] = False
        # Only the pairs that a merge touches are looked up again.
        stale = np.zeros(n, dtype=bool)
        stale[chosen] = True
        stale[chosen[chosen > 0] - 1] = True
        start, stop, owner, piece, offered, stale = (x[keep] for x in (start, stop, owner, piece, offered, stale))
        again = np.flatnonzero(stale)
        offered[again] = _offers(edges, start, stop, owner, again)


def _offers(edges: Edges, start, stop, owner, at: np.ndarray | None = None) -> np.ndarray:
    """The piece over each symbol and the next one of its segment, or -1."""
    at = np.arange(len(start)) if at is None else at
    following = np.minimum(at + 1, max(len(start) - 1, 0))
    found = edges.find(start[at], stop[following] - start[at])
    return np.where((at + 1 < len(start)) & (owner[following] == owner[at]), found, -1)


def _relaxed_long(pieces: Pieces, edges: Edges, begin: int, end: int, done: list) -> None:
    """One long segment with a heap of offers; an offer counts only while both its symbols are unchanged."""
    after = {p: p + 1 for p in range(begin, end)}
    before = {p: p - 1 for p in range(begin + 1, end)}
    piece: dict[int, int] = {}
    starts = np.arange(begin, end - 1)
    offers = edges.find(starts, np.full(len(starts), 2, dtype=np.int64))
    heap = [(int(pieces.place[k]), p, p + 1, p + 2, int(k)) for p, k in zip(starts.tolist(), offers.tolist()) if k >= 0]
    heapq.heapify(heap)

    def offer(p: int, q: int) -> None:
        r = after[q]
        if r - p <= REACH and (k := int(edges.find(np.array([p]), np.array([r - p]))[0])) >= 0:
            heapq.heappush(heap, (int(pieces.place[k]), p, q, r, k))

    while heap:
        _, p, q, r, k = heapq.heappop(heap)
        if after.get(p) != q or after.get(q) != r:
            continue
        piece[p], after[p] = k, r
        del after[q]
        if r < end:
            before[r] = p
            offer(p, r)
        if p > begin:
            offer(before[p], p)
    left = sorted(after)
    done.append((np.array(left), np.array([piece.get(p, -1) for p in left])))


def encode_segments(pieces: Pieces, segments: list[str]) -> list[np.ndarray]:
    """Ids of each segment (spaces already as the space mark)."""
    # U+0000 between segments has rank 0, like every character that no longer piece holds.
    text = "\0".join(segments)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    edges = Edges(pieces, pieces.rank[points])
    size = np.array([len(s) for s in segments], dtype=np.int64)
    begin = np.cumsum(size + 1) - size - 1
    done: list = []
    short = size <= LONG
    _relaxed(pieces, edges, begin[short], (begin + size)[short], done)
    for k in np.flatnonzero(~short).tolist():
        _relaxed_long(pieces, edges, int(begin[k]), int(begin[k] + size[k]), done)
    start = np.concatenate([d[0] for d in done])
    piece = np.concatenate([d[1] for d in done])
    order = np.argsort(start)
    start, piece = start[order], piece[order]
    ids = np.where(piece >= 0, pieces.ids[piece], pieces.char_id[points[start]])
    if (unknown := np.flatnonzero(ids < 0)).size:
        spelled = {c: pieces.byte_ids[list(chr(c).encode())] for c in set(points[start[unknown]].tolist())}
        parts, last = [], 0
        for i in unknown.tolist():
            parts += [ids[last:i], spelled[int(points[start[i]])]]
            last = i + 1
        repeats = np.ones(len(ids), dtype=np.int64)
        repeats[unknown] = [len(spelled[c]) for c in points[start[unknown]].tolist()]
        ids, start = np.concatenate([*parts, ids[last:]]), np.repeat(start, repeats)
    return np.split(ids, np.searchsorted(start, begin[1:]))


class PieceCoder:
    """Encodes and decodes lists of texts; remembers the segments it has met, up to a bound."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.words = kernels.WordTable()

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        at = 0
        while at < len(texts):
            some, size = [], 0
            while at < len(texts) and (not some or size < SLICE_CHARS):
                some.append(texts[at] or "")
                size += len(some[-1])
                at += 1
            if len(self.words) > CACHE_WORDS:
                self.words = kernels.WordTable()
            split = self.pieces.segments.findall
            cut = [split(" " + t.replace(SPACE, " ")) if t else [] for t in some]
            flat = [w for words in cut for w in words]
            new = self.words.unknown(flat)
            for i in range(0, len(new), NEW_SEGMENTS):
                part = new[i : i + NEW_SEGMENTS]
                ids = encode_segments(self.pieces, [w.replace(" ", SPACE) for w in part])
                self.words.add(part, np.concatenate(ids), np.array([len(x) for x in ids]))
            yield from self.words.joined(flat, [len(words) for words in cut])

    def decode(self, ids: np.ndarray) -> str:
        p = self.pieces
        size = p.raw_length[ids]
        ends = np.cumsum(size)
        at = np.repeat(p.raw_start[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        text = p.raw[at].tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _name(path: str) -> str:
    return f"piece coder {path}"


def coder(path: str) -> PieceCoder:
    return kernels.kept(_name(path), lambda: PieceCoder(path))


def _with_texts(docs: DataFrame, path: str, keep: list[str], added: str, make) -> DataFrame:
    """``keep`` columns, then what ``make`` returns for a list of texts."""
    names = [c.split()[0] for c in added.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in kernels.small(batches, 1000, _name(path)):
            columns = make(part.column(part.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], [*keep, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}, {added}")


def _id_lists(found: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate([np.empty(0, np.int32), *[f.astype(np.int32) for f in found]])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32)), pa.array(flat))


def encoded(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """``keep`` columns of each row and ``ids`` of its text."""
    return _with_texts(docs, path, keep, "ids array<int>", lambda texts: [_id_lists(list(coder(path).encode(texts)))])


def decoded(rows: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """``keep`` columns of each row and ``text`` of its ``ids``; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.small(batches, keep=_name(path)):
            lists = batch.column(batch.num_columns - 1).to_pylist()
            texts = [coder(path).decode(np.array(ids or [], dtype=np.int64)) for ids in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*keep, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.select(*keep, "ids").mapInArrow(run, f"{kinds}, text string")


def round_trips(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """Both in one pass: ``keep`` columns, ``ids`` and ``decoded`` (the text that the ids give)."""

    def make(texts: list[str | None]) -> list[pa.Array]:
        found = list(coder(path).encode(texts))
        return [_id_lists(found), pa.array([coder(path).decode(ids) for ids in found], pa.string())]

    return _with_texts(docs, path, keep, "ids array<int>, decoded string", make)


def checksums(docs: DataFrame, path: str) -> DataFrame:
    """Per row, from ids and the text decoded from them: doc_id, n_tokens, ids_crc32 (little-endian unsigned 32-bit ids),
    decoded_sha256 and exact (the decoded text is the row's)."""

    def make(texts: list[str | None]) -> list[pa.Array]:
        found = list(coder(path).encode(texts))
        back = [coder(path).decode(ids) for ids in found]
        return [
            pa.array([len(ids) for ids in found], pa.int64()),
            pa.array([zlib.crc32(ids.astype("<u4").tobytes()) for ids in found], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
            pa.array([t == (text or "") for t, text in zip(back, texts)], pa.bool_()),
        ]

    return _with_texts(docs, path, ["doc_id"], "n_tokens long, ids_crc32 long, decoded_sha256 string, exact boolean", make)
