"""Periodic runs of words: stretches of a smallest period q and of a length of at least ``exponent`` periods that no neighbour extends.

1. A run of period q and length n overlaps its own shift in n - q words, so all its words lie in k-grams that occur twice in the
   text, k being the least such overlap. Words outside repeated k-grams are masked; what is left falls into segments, and no run crosses two.
2. Main and Lorentz's search halves a segment again and again. A run that crosses a middle reaches beyond one more period on one of its
   sides, so it shows as equal words one period apart at the middle; its ends are the common extensions of the two places. All middles of
   one size, of all segments at hand, are searched at once. Extensions are exact: they are read from tables that number the equal stretches of 2^j words.
3. A stretch is found under its smallest period and under multiples; the smallest stays.

Work is n log n in the words of the segments, and nothing in texts without repeated k-grams.

Defined results: a null or empty text has no words, no runs and an empty collapsed text; words are compared as bytes; a text without
runs collapses to its words joined by single spaces; rows are looked at one by one, so ties and repeated rows get results of their own;
an empty table gives no rows; columns whose names clash with new ones get underscores at their end.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import set_aside, slices

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_MULT = np.uint64(0x9E3779B97F4A7C15)


def least_overlap(min_length: int, exponent: int) -> int:
    """The least number of words that a run shares with itself a period later."""
    return min(max(min_length, exponent * q) - q for q in range(1, min_length + 1))


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def survivors(words: np.ndarray, text: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that their text has twice. Equal hashes count as equal k-grams: that can only let more words survive."""
    n = len(words) - k + 1
    if n < 2:
        return np.zeros(len(words), bool)
    h = text[:n].astype(np.uint64)
    for i in range(k):
        h = (h ^ words[i : i + n].astype(np.uint64)) * _MULT
        h ^= h >> np.uint64(29)
    whole = np.flatnonzero(text[:n] == text[k - 1 :])
    h = h[whole]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, whole[twice], 1)
    np.add.at(change, whole[twice] + k, -1)
    return np.cumsum(change[:-1]) > 0


class Extensions:
    """How far equal stretches reach from two places, by tables that number the distinct stretches of 2^j words."""

    def __init__(self, words: np.ndarray, longest: int):
        self.tables, width = [np.unique(words, return_inverse=True)[1].astype(np.int64)], 1
        while 2 * width <= longest and 2 * width < len(words):
            last = self.tables[-1]
            self.tables.append(np.unique(last[:-width] * len(words) + last[width:], return_inverse=True)[1])
            width *= 2

    def _reach(self, a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        for j in range(len(self.tables) - 1, -1, -1):
            known, width = self.tables[j], 1 << j
            x, y = (a - out - width, b - out - width) if back else (a + out, b + out)
            inside = np.flatnonzero((np.minimum(x, y) >= 0) & (np.maximum(x, y) < len(known)))
            equal = inside[known[x[inside]] == known[y[inside]]]
            out[equal] += width
        return out

    def after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._reach(a, b, False)

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._reach(a, b, True)


def runs_of(words: np.ndarray, lengths: np.ndarray, min_length: int, exponent: int) -> np.ndarray:
    """(start, length, period) of all runs within segments of these ``lengths``, which lie one after the other in ``words``; by start, then period."""
    ends = np.cumsum(lengths + 1)
    starts = ends - lengths - 1
    apart = np.full(int(ends[-1]), -1, np.int64)  # a word of its own behind each segment
    inner = np.ones(len(apart), bool)
    inner[ends - 1] = False
    apart[inner] = words
    apart[ends - 1] = -1 - np.arange(len(ends))
    reach, found, half = Extensions(apart, int(lengths.max())), [], 1
    while half < lengths.max():
        most = 2 * half // exponent  # the longest period of a run inside a block of two halves
        blocks = np.maximum((lengths + half - 1) // (2 * half), 0)  # those with a middle inside the segment
        if most and blocks.sum():
            of = np.repeat(np.arange(len(lengths)), blocks)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            middle = np.repeat(starts[of] + half * (2 * nth + 1), most)
            p = np.tile(np.arange(1, most + 1), len(of))
            for right in (True, False):
                x = middle if right else middle - 1 - p
                ok = (x >= 0) & (x + p < len(apart))
                ok[ok] = apart[x[ok]] == apart[x[ok] + p[ok]]
                a, q = (middle[ok] if right else middle[ok] - p[ok]), p[ok]
                b = a + q
                first = a - reach.before(a, b)
                long = b + reach.after(a, b) - first
                good = long >= np.maximum(min_length, exponent * q)
                found.append(np.stack([first[good], long[good], q[good]], axis=1))
        half *= 2
    if not found or not sum(map(len, found)):
        return np.zeros((0, 3), np.int64)
    all_ = np.unique(np.concatenate(found), axis=0)
    all_ = all_[np.concatenate(([True], (all_[1:, :2] != all_[:-1, :2]).any(axis=1)))]  # a stretch under its smallest period
    all_ = all_[np.lexsort((all_[:, 2], all_[:, 0]))]
    all_[:, 0] -= np.searchsorted(ends, all_[:, 0], "right")  # without the words between segments
    return all_


def text_runs(words: np.ndarray, text: np.ndarray, min_length: int, exponent: int, most: int = 1 << 20) -> np.ndarray:
    """All runs of texts that lie one after the other in ``words``; ``text`` tells them apart. Segments are searched in groups of about ``most`` words."""
    alive = survivors(words, text, least_overlap(min_length, exponent))
    before = np.concatenate(([False], alive[:-1] & (text[1:] == text[:-1])))
    after = np.concatenate((before[1:], [False]))
    starts, stops = np.flatnonzero(alive & ~before), np.flatnonzero(alive & ~(after & np.concatenate((alive[1:], [False])))) + 1
    enough = stops - starts >= min_length
    starts, stops = starts[enough], stops[enough]
    out, group = [np.zeros((0, 3), np.int64)], np.cumsum(stops - starts) // most
    for g in np.unique(group):
        s, e = starts[group == g], stops[group == g]
        places = np.concatenate([np.arange(a, b) for a, b in zip(s, e, strict=True)])
        runs = runs_of(words[places], e - s, min_length, exponent)
        runs[:, 0] = places[runs[:, 0]]
        out.append(runs)
    return np.concatenate(out)


def find_runs(df: DataFrame, text: str = "text", min_length: int = 6, exponent: int = 4) -> DataFrame:
    """``df`` with ``text`` replaced by n_words, runs (start, length, period; by start, then period) and collapsed: the words joined by a space, without those that a run has after its first period.

    ``exponent``: periods that a run has at least, 3 or more."""
    if exponent < 3:
        raise ValueError("a run of fewer than three periods need not reach beyond a period on either side of a middle")
    df = set_aside(df, "n_words", "runs", "collapsed")
    schema = T.StructType([*(f for f in df.schema.fields if f.name != text), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, text)):
            words = [t.split() if t else [] for t in batch.column(text).cast(pa.binary()).to_pylist()]
            counts = np.fromiter(map(len, words), np.int64, len(words))
            number = np.fromiter(map(_Numbers().__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
            text_of, first = np.repeat(np.arange(len(words)), counts), np.cumsum(counts) - counts
            runs = text_runs(number, text_of, min_length, exponent) if len(number) else np.zeros((0, 3), np.int64)
            drop = np.zeros(len(number) + 1, np.int64)
            np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
            np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
            gone = np.cumsum(drop[:-1]) > 0
            owner = text_of[runs[:, 0]]
            lists, kept = [[] for _ in words], [b" ".join(w) if not n else None for w, n in zip(words, np.bincount(owner, minlength=len(words)).tolist(), strict=True)]
            for i, (s, n, q) in zip(owner.tolist(), runs.tolist(), strict=True):
                lists[i].append({"start": s - int(first[i]), "length": n, "period": q})
            for i, k in enumerate(kept):
                if k is None:
                    kept[i] = b" ".join(w for w, g in zip(words[i], gone[first[i] : first[i] + counts[i]].tolist(), strict=True) if not g)
            names = [c for c in batch.schema.names if c != text]
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in RUN.fieldNames()]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(counts), pa.array(lists, kind), pa.array(kept, pa.binary()).cast(pa.string())], [*names, "n_words", "runs", "collapsed"])

    return df.mapInArrow(run, schema)


def strongest(runs):
    """The run of the greatest length for its period; ties: the smallest start, then period. Null without runs."""
    a_more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    order = lambda a, b: F.when(a_more(a, b), -1).when(a_more(b, a), 1).when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).otherwise(F.signum(a["period"] - b["period"]).cast("int"))
    return F.get(F.array_sort(runs, order), F.lit(0))
