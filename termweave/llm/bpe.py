"""Byte-level BPE encoding and decoding by numpy.

Each match of the splitting pattern is a piece. A piece that is itself in the vocabulary is one token. The other distinct
pieces of a batch are put into matrices of equal padded length; in every round each row merges its leftmost pair of
minimum rank, found by a hashed lookup of pairs, and the rows that have no pair left are taken out. Pieces of over
``LONG`` bytes go through a heap instead, with the same merges in the same order, as a matrix row would cost the square
of its length.

Defined cases: a null text is encoded as the empty one (no ids); repeated rows give the same ids; an empty table gives
none. Very long texts are encoded whole, one at a time; other texts in lots of a bounded number of characters. Other
columns of the input stay out of the result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from termweave.llm.wordspans import Lookup

LONG = 1024
#: Distinct pieces, and characters of them, that a task keeps between batches; a matter of memory, not of results.
KEEP, KEEP_CHARS = 300_000, 16 << 20
NONE = np.int32(2**31 - 1)
_CODECS: dict[tuple[str, str], Codec] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


class _Numbered(dict):
    """Gives each new key the next number, and lists those not taken yet."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.single < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        pairs = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        left, right = np.array([*pairs], np.uint64).reshape(-1, 2).T
        self.pairs = Lookup(left << np.uint64(32) | right, np.array([*pairs.values()], np.int32))
        self.pair = pairs
        self.forget()

    def forget(self) -> None:
        self.number, self.size, self.chars = _Numbered(), np.zeros(0, np.int64), 0
        self.ids = np.zeros(0, np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it is no token; negative ids are padding."""
        out = self.pairs(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64))
        return np.where((out < 0) | (left < 0) | (right < 0), NONE, out)

    def merge_rows(self, rows: np.ndarray) -> np.ndarray:
        """rows: ids padded by -1 at the right. The same with all merges done."""
        out = np.full_like(rows, -1)
        ids, where = rows.copy(), np.arange(len(rows))
        rank = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(ids):
            at = rank.argmin(1)
            best = rank[np.arange(len(ids)), at]
            over = best == NONE
            if over.any():
                out[where[over], : ids.shape[1]] = ids[over]
                ids, rank, at, best, where = (x[~over] for x in (ids, rank, at, best, where))
                if not len(ids):
                    break
            row = np.arange(len(ids))
            later = np.arange(ids.shape[1] - 1) > at[:, None]
            ids[row, at] = best
            ids[:, :-1] = np.where(later, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            if rank.shape[1] > 1:
                rank[:, :-1] = np.where(later[:, :-1] | (np.arange(rank.shape[1] - 1) >= at[:, None]), rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NONE
            nxt = np.minimum(at + 1, ids.shape[1] - 1)
            rank[row, np.minimum(at, rank.shape[1] - 1)] = np.where(at + 1 < ids.shape[1], self.rank(ids[row, at], ids[row, nxt]), NONE)
            inner = np.flatnonzero(at > 0)
            rank[inner, at[inner] - 1] = self.rank(ids[inner, at[inner] - 1], ids[inner, at[inner]])
            width = int((ids >= 0).sum(1).max())
            if width < ids.shape[1]:
                ids, rank = ids[:, : max(width, 1)], rank[:, : max(width - 1, 1)]
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        """The same for one long piece."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        before, after = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := self.pair.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (s := self.pair.get((ids[k], ids[after[k]]))) is not None:
                    heapq.heappush(heap, (s, k, ids[k], ids[after[k]]))
        return [x for x in ids if x >= 0]

    def pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[k] = np.array([whole], np.int32)
            elif len(p) > LONG:
                out[k] = np.array(self.merge_long(p), np.int32)
            else:
                by_width.setdefault(max(4, (len(p) + 3) // 4 * 4) if len(p) <= 32 else 1 << (len(p) - 1).bit_length(), []).append(k)
        for width, which in by_width.items():
            step = max(1, (1 << 18) // width)
            for lo in range(0, len(which), step):
                some = which[lo : lo + step]
                n = np.array([len(pieces[k]) for k in some])
                rows = np.full((len(some), width), -1, np.int32)
                rows[np.arange(width) < n[:, None]] = self.single[np.frombuffer(b"".join([pieces[k] for k in some]), np.uint8)]
                done = self.merge_rows(rows)
                full = done >= 0
                for k, ids in zip(some, np.split(done[full], np.cumsum(full.sum(1))[:-1])):
                    out[k] = ids
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each whole text."""
        if len(self.number) > KEEP or self.chars > KEEP_CHARS:
            self.forget()
        numbers = [np.array(list(map(self.number.__getitem__, self.split.findall(t or ""))), np.int64) for t in texts]
        if self.number.new:
            self.chars += sum(map(len, self.number.new))
            done = self.pieces([p.encode() for p in self.number.new])
            self.number.new.clear()
            self.size = np.concatenate([self.size, np.array([len(x) for x in done], np.int64)])
            self.ids = np.concatenate([self.ids, *done])
            self.first = np.cumsum(self.size) - self.size
        out = []
        for k in numbers:
            n = self.size[k]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(k) else 0
            out.append(self.ids[np.repeat(self.first[k] - ends + n, n) + np.arange(total)] if total else np.zeros(0, np.int32))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for this file and pattern, built once."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(load_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, batch_chars: int = 4 << 20) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids) of every whole text; one pass, no shuffle.

    path: the ranks file, which each worker opens, so every host needs it there.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from termweave.llm.bpe import codec

        c = codec(path, pattern)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size < batch_chars):
                    size += len(texts[hi] or "")
                    hi += 1
                found = c.encode(texts[lo:hi])
                n = [len(x) for x in found]
                columns = [ids.slice(lo, hi - lo), pa.array(n, pa.int64())]
                columns.append(pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found], pa.string()))
                columns.append(pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in found], pa.string()))
                if with_ids:
                    columns.append(pa.array([x.tolist() for x in found], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])
                lo = hi
        c.forget()  # the worker may go on to other stages

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
