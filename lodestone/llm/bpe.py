"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

All distinct pre-tokens of an Arrow batch lie in one linked list of byte positions, with no link
across pre-tokens. A bucket for each merge rank holds the positions of pairs that merge to that
rank; a bitmap of three levels (64 bits a word) marks the buckets in use, so find-first-set gives
the next rank. From the bucket of the least rank each pre-token takes, from left to right, the pairs that
sequential BPE merges before any pair of a lower rank: all of them, unless a merge gives such a pair, which is rare; then those
behind it stay queued. An entry whose pair has changed since is stale and is skipped. A pop serves all pre-tokens of the
batch and all places of a long one, so a pre-token costs about its length times the logarithm of it.

A bounded memory of pre-token ids lives as long as a task; it only saves work. Tasks keep no
state beyond it, so a lost executor costs a rerun of its partitions.

Defined results: null is an empty text, which has no ids; texts of any length are encoded whole;
other columns pass through, and one named like a new column, in any case, is kept under its name with underscores. A byte that the ranks lack, or an unknown id when decoding, raises.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.common import set_aside, slices
from lodestone.llm.pretokens import Splitter

#: Pre-tokens, and bytes of them, whose ids a task remembers before it starts afresh.
MEMORY, MEMORY_BYTES = 150_000, 16 << 20
#: About so many bytes of text are encoded at a time, so that memory follows bytes, not rows.
SLICE_BYTES = 4 << 20


class RankQueue:
    """Buckets by rank under a three-level bitmap."""

    def __init__(self, ranks: int):
        self.levels = [[0] * ((ranks >> s) + 1) for s in (6, 12, 18)]
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        if rank in self.buckets:
            self.buckets[rank].append(positions)
            return
        self.buckets[rank] = [positions]
        for level in self.levels:
            level[rank >> 6] |= 1 << (rank & 63)
            rank >>= 6

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The least rank and its positions."""
        top = next((i for i, w in enumerate(self.levels[2]) if w), None)
        if top is None:
            return None
        at = top
        for level in reversed(self.levels):
            word = level[at]
            at = (at << 6) | ((word & -word).bit_length() - 1)
        rank, x = at, at
        found = self.buckets.pop(rank)
        for level in self.levels:
            level[x >> 6] &= ~(1 << (x & 63))
            if level[x >> 6]:
                break
            x >>= 6
        return rank, found[0] if len(found) == 1 else np.concatenate(found)


class Codec:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.size = max(ranks.values(), default=0) + 1
        self.single = np.full(256, -1, np.int64)
        for b, i in ranks.items():
            if len(b) == 1:
                self.single[b[0]] = i
        pairs = {}
        for b, i in ranks.items():
            for cut in range(1, len(b)):
                x, y = ranks.get(b[:cut]), ranks.get(b[cut:])
                if x is not None and y is not None:
                    pairs[x * self.size + y] = i
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in sorted(pairs)] + [-1], np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair of ids merges to, or -1."""
        if not len(self.pair_keys):
            return np.full(len(left), -1, np.int64)
        key = left * self.size + right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def _together(self, at: np.ndarray, rank: int, tok: np.ndarray, nxt: np.ndarray, prv: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of one rank that sequential BPE merges, from left to right, before any pair of a lower rank; and those that wait.

        Of overlapping pairs every second one is merged. In each piece the first merge that gives a pair of a lower rank is the last for now; every
        pair of that piece behind it waits, as the merges of lower ranks decide which of them still overlap."""
        chained = nxt[at[:-1]] == at[1:]
        begins = np.flatnonzero(np.concatenate(([True], ~chained)))
        nth = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
        every, at = at, at[nth % 2 == 0]
        after, before = nxt[nxt[at]], prv[at]
        merged = np.concatenate(([False], after[:-1] == at[1:]))  # the pair before is merged by then
        right = np.full(len(at), -1, np.int64)
        right[after >= 0] = self._rank(np.full(int((after >= 0).sum()), rank), tok[after[after >= 0]])
        left = np.full(len(at), -1, np.int64)
        left[before >= 0] = self._rank(np.where(merged, rank, tok[before])[before >= 0], np.full(int((before >= 0).sum()), rank))
        lower = ((right >= 0) & (right < rank)) | ((left >= 0) & (left < rank))
        if not lower.any():
            return at, at[:0]
        earlier = np.cumsum(lower) - lower
        first = np.concatenate(([True], piece[at[1:]] != piece[at[:-1]]))
        now = at[earlier == np.maximum.accumulate(np.where(first, earlier, 0))]
        return now, np.setdiff1d(every, now, assume_unique=True)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece, as merging it alone by least rank, leftmost first, gives them."""
        out: list[list[int] | None] = [[i] if (i := self.ranks.get(p)) is not None else [] if not p else None for p in pieces]
        todo = [i for i, ids in enumerate(out) if ids is None]
        if not todo:
            return out  # type: ignore[return-value]
        lengths = np.array([len(pieces[i]) for i in todo], np.int64)
        tok = self.single[np.frombuffer(b"".join(pieces[i] for i in todo), np.uint8)]
        if (tok < 0).any():
            raise ValueError("the ranks lack a single byte of the text")
        n, starts = len(tok), np.concatenate(([0], np.cumsum(lengths)))
        piece = np.repeat(np.arange(len(todo)), lengths)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[starts[1:] - 1] = -1
        prv[starts[:-1]] = -1
        alive = np.ones(n, bool)
        pair = np.full(n, -1, np.int64)
        has = np.flatnonzero(nxt >= 0)
        pair[has] = self._rank(tok[has], tok[nxt[has]])

        queue = RankQueue(self.size)

        def enqueue(at: np.ndarray) -> None:
            r = pair[at]
            at, r = at[r >= 0], r[r >= 0]
            if len(at) == 1:
                queue.push(int(r[0]), at)
            elif len(at):
                order = np.argsort(r, kind="stable")
                at, r = at[order], r[order]
                cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
                for rank, group in zip(r[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts), strict=True):
                    queue.push(rank, group)

        enqueue(has)
        while popped := queue.pop():
            rank, at = popped
            at = at[pair[at] == rank]  # the rest is stale
            if not len(at):
                continue
            if len(at) > 1:
                at = np.unique(at)
                if len(at) > 1 and (piece[at[1:]] == piece[at[:-1]]).any():
                    at, later = self._together(at, rank, tok, nxt, prv, piece)
                    if len(later):
                        queue.push(rank, later)
            gone = nxt[at]
            after = nxt[gone]
            tok[at] = rank
            alive[gone] = False
            pair[gone] = -1
            nxt[at] = after
            tail = after >= 0
            prv[after[tail]] = at[tail]
            pair[at] = -1
            right = at[tail]
            pair[right] = self._rank(tok[right], tok[after[tail]])
            left = prv[at]
            left = left[left >= 0]
            pair[left] = self._rank(tok[left], tok[nxt[left]])
            enqueue(np.concatenate((right, left)))
        ids, ends = tok[alive].tolist(), np.cumsum(np.add.reduceat(alive, starts[:-1])).tolist()
        begin = 0
        for i, end in zip(todo, ends, strict=True):
            out[i] = ids[begin:end]
            begin = end
        return out  # type: ignore[return-value]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class TextEncoder:
    """Ids of texts, batch by batch. A text is held as numbers of pre-tokens, its strings only while it is split."""

    def __init__(self, codec: Codec, splitter: Splitter):
        self.codec, self.splitter = codec, splitter
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.size, self.starts, self.lengths, self.flat = 0, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and where each text ends in them."""
        if len(self.number) > MEMORY or self.size > MEMORY_BYTES:
            self.forget()
        find, number = self.splitter.find, self.number
        rows = [np.fromiter(map(number.__getitem__, find(t)), np.int64) if t else np.zeros(0, np.int64) for t in texts]
        new = [p.encode("utf-8") for p in islice(number, len(self.starts), None)]
        self.size += sum(map(len, new))
        ids = self.codec.encode_pieces(new)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lengths) - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum()))))
        parts, ends = [], [0]
        for row in rows:
            n = self.lengths[row]
            total = int(n.sum())
            at = np.repeat(self.starts[row] - np.cumsum(n) + n, n) + np.arange(total)
            parts.append(self.flat[at])
            ends.append(ends[-1] + total)
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.array(ends, np.int32)


def _with(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` with ``columns`` at its end, in place of those of the same name."""
    kept = [c for c in batch.schema.names if c not in columns]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns.values()], [*kept, *columns])


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, public: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the column ``ids`` (array of int): each match of ``pattern`` in ``text`` encoded by ``ranks``."""
    df = set_aside(df, ids)
    shared = df.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary: its size doesn't depend on the data
    schema = T.StructType([*(f for f in df.schema.fields if f.name != ids), T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        encoder = None
        for whole in batches:
            encoder = encoder or TextEncoder(Codec(shared.value), Splitter(pattern, public))
            for batch in slices(whole, text, SLICE_BYTES):
                flat, ends = encoder.encode(batch.column(text).to_pylist())
                yield _with(batch, {ids: pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))})

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``df`` with the column ``out`` (binary): the bytes of ``ids``; null ids have none."""
    df = set_aside(df, out)
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    schema = T.StructType([*(f for f in df.schema.fields if f.name != out), T.StructField(out, T.BinaryType(), False)])

    def run(batches):
        tokens = None
        for batch in batches:
            tokens = tokens or {i: b for b, i in shared.value.items()}
            texts = [b"".join(map(tokens.__getitem__, row.values.to_pylist())) if row.is_valid else b"" for row in batch.column(ids)]
            yield _with(batch, {out: pa.array(texts, pa.binary())})

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, ranks: dict[bytes, int], pattern: str, public: str | None = None, text: str = "text", ids: str = "ids", out: str = "bytes", keep_text: bool = True) -> DataFrame:
    """``decode(encode(df))`` in one Python worker a task instead of two; ``out`` is read from the ids alone."""
    df = set_aside(df, ids, out)
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    passed = [f for f in df.schema.fields if f.name not in (ids, out) and (keep_text or f.name != text)]
    names = [f.name for f in passed]
    schema = T.StructType([*passed, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), T.StructField(out, T.BinaryType(), False)])

    def run(batches):
        encoder = None
        for whole in batches:
            encoder = encoder or TextEncoder(Codec(shared.value), Splitter(pattern, public))
            for batch in slices(whole, text, SLICE_BYTES):
                flat, ends = encoder.encode(batch.column(text).to_pylist())
                back = [encoder.codec.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)]
                yield _with(batch.select(names), {ids: pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), out: pa.array(back, pa.binary())})

    return df.mapInArrow(run, schema)
