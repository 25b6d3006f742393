"""Language-model scoring by Katz backoff.

Tokens are words and one end token a text; a text's first token follows a start mark. Word counts are
Good-Turing discounted, the mass set free goes to the unknown word. All word pairs of the training texts are
counted too, without any threshold, and discounted in the same way; a pair that was never seen backs off to its word:

    p(w | v) = d(c(v w)) c(v w) / c(v)  if the pair was seen, else alpha(v) p(w)

with alpha(v) such that p(. | v) sums to one over all words and the unknown one; alpha is 1 for contexts
without pairs. Counts cover all training texts; the tables of words and pairs grow with the corpus.

The pair table is partitioned by context into buckets of about ``BUCKET`` training tokens, one row of sorted
arrays for each. Texts send their pairs to the buckets in the same way, so a bucket has all that its contexts need: it
finds a pair or adds log alpha and takes the word's own probability; words that only the word table knows
go on to a join with that table, one level down. A bucket gives back the sums of its texts, block by block.

No key is hot: tasks count before they send, and a context with more than an eighth of a bucket's tokens is spread over all
buckets by its second word; its alpha is summed up from there. Words that make up at least ``HOT_SHARE`` of the
tokens (at most a million, so their size is bounded) are numbered and their counts sent to all tasks.

Defined results: null is an empty text, which has only its end; a null id is trained on; without training
texts every word is unknown with probability one half; equal rows are counted as often as they stand. Words are
told apart by 63 bits of their hash: among 10^9 distinct words about one in twenty corpora would have two that count as one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import slices, stored

#: Least share of the tokens of a word whose count is sent to the tasks.
HOT_SHARE = 1e-6
#: Training tokens of a bucket, about.
BUCKET = 1 << 20
#: Counts up to this are discounted.
MOST_DISCOUNTED = 5
#: Tokens that a task gathers before it passes them on.
FLUSH = 2_000_000
#: Not words, as they hold a space.
END, START = b" end", b" start"
_TOP = np.uint64(1 << 63)


def _hash(word: bytes) -> int:
    """63 bits under a set one: numbers of frequent words have it clear."""
    return xxhash.xxh3_64_intdigest(word) | 1 << 63


_draw = np.random.default_rng(20240203)
#: A number for each byte, of A-Z those of a-z, and an odd one by which a word's bytes are weighted in turn.
_BYTES = _draw.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + _draw.integers(0, 2, 256, dtype=np.uint64)
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_STEP = np.uint64(int(_draw.integers(1, 1 << 63)) * 2 + 1)
_IS_WORD = bytes(i not in b" \t\n\x0b\x0c\r" for i in range(256))
#: Bytes up to which a word's hash is its weighted sum; strings of over a thousand bytes could be made to collide in that.
_SHORT = 64


def hash_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts in lower case, and how many words each text has; for bytes, case and white space are those of ASCII.

    All words of equal length are hashed together, byte by byte."""
    sizes = np.array([len(t) if t else 0 for t in texts], np.int64) + 1
    joined = b"\n".join(t or b"" for t in texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    solid = np.frombuffer(joined.translate(_IS_WORD), np.int8)
    edges = np.flatnonzero(np.diff(solid, prepend=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]  # the last byte is white space
    length = ends - starts
    out = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    capped = np.minimum(length, _SHORT + 1)
    order = np.argsort((_SHORT + 1 - capped).astype(np.uint8), kind="stable")
    left = np.cumsum(np.bincount(capped, minlength=_SHORT + 2)[::-1])[::-1]  # words of at least each length
    at, sums, weight = starts[order], np.zeros(len(starts), np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(_SHORT):
            n = int(left[k + 1])
            if not n:
                break
            sums[:n] += _BYTES[data[at[:n] + k]] * weight
            weight = weight * _STEP
        out[order] += sums
        out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(31)
    for i in np.flatnonzero(length > _SHORT).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes().lower())
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    return out | _TOP, np.diff(np.searchsorted(starts, bounds))


def hash_tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """``hash_words`` with the end token after each text's words."""
    words, counts = hash_words(texts)
    ends = np.cumsum(counts)
    return np.insert(words, ends, np.uint64(_hash(END))), counts + 1


def pack(a: np.ndarray) -> bytes:
    """Compressed by planes of bytes: of small or sorted numbers most are zero."""
    a = np.ascontiguousarray(a)
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), 1)


def unpack(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(kind)


def _differences(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=np.zeros(1, a.dtype))


def _trained(batches):
    """The rows to train on, in slices."""
    for whole in batches:
        yield from slices(whole.filter(pc.invert(whole.column("held_out"))), "text")


def word_counts(docs: DataFrame) -> DataFrame:
    """(key, c): training tokens of each word, by its hash."""

    def run(batches):
        parts, total = [], 0

        def flush():
            keys, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))  # sorted keys shrink in the exchange
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

        for batch in _trained(batches):
            parts.append(hash_tokens(batch.column("text").cast(pa.binary()).to_pylist())[0])
            total += len(parts[-1])
            if total > FLUSH:
                yield flush()
                parts, total = [], 0
        yield flush()

    return docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("c"))


def good_turing(counts_of_counts: dict[int, int]) -> list[float]:
    """d(0), d(1), ... d(MOST_DISCOUNTED) by Katz; absolute discounting by one half where the counts of counts don't give factors in (0, 1)."""
    n, k = counts_of_counts, MOST_DISCOUNTED
    out = [1.0]
    first = (k + 1) * n.get(k + 1, 0) / n[1] if n.get(1) else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - first) / (1 - first) if n.get(r) and first < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def _discounted(c: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array(d)[np.where(c <= MOST_DISCOUNTED, c, 0)] * c


class Unigrams:
    """Discounted word probabilities as a function of the count."""

    def __init__(self, total: int, distinct: int, counts_of_counts: dict[int, int], beyond: int):
        """``beyond``: tokens of words with more than MOST_DISCOUNTED occurrences."""
        self.total, self.distinct = total, distinct
        self.d = good_turing(counts_of_counts)
        kept = beyond + sum(self.d[r] * r * counts_of_counts.get(r, 0) for r in range(1, MOST_DISCOUNTED + 1))
        self.unknown = max(1 - kept / total, 1 / (total + 1)) if total else 0.5
        self.scale = (1 - self.unknown) / kept if kept else 0.0

    def probability(self, c):
        c = np.asarray(c, np.int64)
        return np.where(c > 0, _discounted(c, self.d) * self.scale, self.unknown)

    def column(self, c):
        d = F.element_at(F.array(*map(F.lit, self.d)), F.when(c <= MOST_DISCOUNTED, c.cast("int") + 1).otherwise(1))
        return F.when(c > 0, d * c * self.scale).otherwise(self.unknown)

    def base(self, c):
        return np.log10((np.asarray(c) + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


class Vocabulary:
    """Frequent words, numbered by falling count, the unigram function and the layout of the buckets."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, unigrams: Unigrams, ends: int):
        order = np.lexsort((keys, -counts))
        self.counts, self.unigrams, self.ends = counts[order], unigrams, ends
        self.keys = keys[order]
        self._sorted = np.argsort(self.keys)
        self.buckets = max(1, math.ceil(unigrams.total / BUCKET))
        self.hot = int((self.counts > BUCKET / 8).sum())  # numbers below this are spread, and so is the start
        self.start = np.uint64(_hash(START))

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """The number of a frequent word, the hash of any other."""
        if not len(self.keys):
            return hashes
        at = self._sorted[np.minimum(np.searchsorted(self.keys, hashes, sorter=self._sorted), len(self.keys) - 1)]
        return np.where(self.keys[at] == hashes, at.astype(np.uint64), hashes)

    def spread(self, codes: np.ndarray) -> np.ndarray:
        return (codes < self.hot) | (codes == self.start)

    def bucket(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        x = np.where(self.spread(v), v ^ (w * np.uint64(0x9E3779B97F4A7C15)), v) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x >> np.uint64(31)) % np.uint64(self.buckets)).astype(np.int64)

    def count(self, codes: np.ndarray, otherwise) -> np.ndarray:
        """Counts of frequent words, ``otherwise`` for all others."""
        known = codes < len(self.counts)
        if not len(self.counts):
            return np.broadcast_to(otherwise, codes.shape)
        return np.where(known, self.counts[np.where(known, codes, 0).astype(np.int64)], otherwise)


class _Reader:
    """Texts that a task has gathered, as pairs sorted by bucket, first and second word."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.tokens: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.total = 0

    def add(self, texts: list[bytes | None]) -> None:
        tokens, sizes = hash_tokens(texts)
        self.tokens.append(tokens)
        self.sizes.append(sizes)
        self.total += len(tokens)

    def full(self) -> bool:
        return self.total > FLUSH

    def pairs(self, distinct: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bucket, codes of both words, and how often each pair stands there (``distinct``) or the text it stands in."""
        tokens = np.concatenate(self.tokens) if self.tokens else np.zeros(0, np.uint64)
        sizes = np.concatenate(self.sizes) if self.sizes else np.zeros(0, np.int64)
        by_hash = np.argsort(tokens)
        ranked = tokens[by_hash]
        first = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, bool)
        hashes, w = ranked[first], np.empty(len(tokens), np.int64)
        w[by_hash] = np.cumsum(first) - 1
        v = np.concatenate(([-1], w[:-1])) if len(w) else w
        v[np.cumsum(sizes)[:-1]] = -1  # the start is the last of `codes`
        codes = np.append(self.vocabulary.codes(hashes), self.vocabulary.start)
        order = np.argsort(codes)
        rank = np.empty(len(codes), np.int64)
        rank[order] = np.arange(len(codes))
        bucket = self.vocabulary.bucket(codes, np.zeros(1, np.uint64))[v]
        if (spread := self.vocabulary.spread(codes)).any():
            at = np.flatnonzero(spread[v])
            bucket[at] = self.vocabulary.bucket(codes[v[at]], codes[w[at]])
        bits = len(codes).bit_length()
        ranked = codes[order]
        if self.vocabulary.buckets.bit_length() + 2 * bits < 64:  # else the words are too many for one number
            key = (bucket << 2 * bits) | (rank[v] << bits) | rank[w]
            key, last = np.unique(key, return_counts=True) if distinct else (key[o := np.argsort(key)], np.repeat(np.arange(len(sizes)), sizes)[o])
            return key >> 2 * bits, ranked[(key >> bits) & ((1 << bits) - 1)], ranked[key & ((1 << bits) - 1)], last
        o = np.lexsort((rank[w], rank[v], bucket))
        bucket, v, w = bucket[o], codes[v[o]], codes[w[o]]
        if not distinct:
            return bucket, v, w, np.repeat(np.arange(len(sizes)), sizes)[o]
        first = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (w[1:] != w[:-1]) | (bucket[1:] != bucket[:-1]))))
        return bucket[first], v[first], w[first], np.diff(np.append(first, len(v)))


def _by_bucket(bucket: np.ndarray):
    """Slices of sorted ``bucket`` with their value."""
    cuts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b > a:
            yield int(bucket[a]), slice(a, b)


_HOT = [*(f"r{i}" for i in range(1, MOST_DISCOUNTED + 1)), "beyond", "half", "seen"]


def pair_table(docs: DataFrame, shared) -> DataFrame:
    """One row a bucket: its sorted pairs and their training counts, counts of counts, sums of spread contexts, and pairs whose word isn't frequent."""

    def count(batches):
        reader = _Reader(shared.value)

        def flush():
            bucket, v, w, n = reader.pairs(distinct=True)
            rows = [(k, pack(_differences(v[s])), pack(w[s]), pack(n[s].astype(np.uint32))) for k, s in _by_bucket(bucket)]
            reader.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), *[pa.binary()] * 3))], ["bucket", "v", "w", "n"])

        for batch in _trained(batches):
            reader.add(batch.column("text").cast(pa.binary()).to_pylist())
            if reader.full():
                yield flush()
        yield flush()

    def merge(pdf):
        words = shared.value
        v = np.concatenate([np.cumsum(unpack(b, np.uint64), dtype=np.uint64) for b in pdf["v"]])
        w = np.concatenate([unpack(b, np.uint64) for b in pdf["w"]])
        n = np.concatenate([unpack(b, np.uint32) for b in pdf["n"]]).astype(np.int64)
        order = np.lexsort((w, v))
        v, w, n = v[order], w[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (w[1:] != w[:-1]))))
        v, w, c = v[first], w[first], np.add.reduceat(n, first)
        few = np.minimum(c, MOST_DISCOUNTED + 2)
        rare = (w & _TOP) > 0
        hot = []
        spread = words.spread(v)
        seen = np.where(rare, 0.0, words.unigrams.probability(words.count(w, 1)))
        for code in np.unique(v[spread]):
            own = v == code
            r = np.bincount(few[own], minlength=MOST_DISCOUNTED + 3)
            hot.append((int(code.view(np.int64)), *map(float, r[1 : MOST_DISCOUNTED + 1]), float(c[own & (c > MOST_DISCOUNTED)].sum()), float((c[own] - 0.5).sum()), float(seen[own].sum())))
        r = np.bincount(few, minlength=MOST_DISCOUNTED + 3)
        row = {"bucket": [int(pdf["bucket"].iloc[0])], "v": [pack(_differences(v))], "w": [pack(w)], "c": [pack(c.astype(np.uint32 if c.max() < 1 << 32 else np.uint64))], "wide": [bool(c.max() >= 1 << 32)]}
        row |= {f"n{i}": [int(r[i])] for i in range(1, MOST_DISCOUNTED + 2)}
        row |= {"hot": [[dict(zip(["v", *_HOT], h, strict=True)) for h in hot]], "rare_v": [v[rare].view(np.int64)], "rare_w": [w[rare].view(np.int64)]}
        return pd.DataFrame(row)

    schema = f"bucket long, v binary, w binary, c binary, wide boolean, {', '.join(f'n{i} long' for i in range(1, MOST_DISCOUNTED + 2))}, hot array<struct<v: long, {', '.join(f'{x}: double' for x in _HOT)}>>, rare_v array<long>, rare_w array<long>"
    return docs.mapInArrow(count, "bucket long, v binary, w binary, n binary").groupBy("bucket").applyInPandas(merge, schema)


class Model:
    """The trained tables: ``words`` (key, c), ``pairs`` (one row a bucket), ``rest`` (bucket, v, seen: probability of the seen words
    of each context that aren't frequent); and what tasks are sent: ``shared`` vocabulary, factors ``d``, and (cv, plain, log alpha) of spread contexts."""

    def __init__(self, docs: DataFrame):
        """``docs`` has text and held_out."""
        spark = docs.sparkSession
        self.words = stored(word_counts(docs), "words")
        small, c = F.col("c") <= MOST_DISCOUNTED + 1, F.col("c")
        total, distinct, beyond = self.words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(c > MOST_DISCOUNTED, c)), F.lit(0))).first()
        unigrams = Unigrams(total, distinct, {r.c: r.n for r in self.words.filter(small).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}, beyond)
        few = self.words.filter(c >= max(1.0, HOT_SHARE * total)).select("key", "c").toArrow()  # at most 1 / HOT_SHARE rows
        ends = self.words.filter(F.col("key") == int(np.uint64(_hash(END)).view(np.int64))).select("c").first()
        vocabulary = Vocabulary(few.column("key").to_numpy().view(np.uint64), few.column("c").to_numpy(), unigrams, ends.c if ends else 0)
        self.vocabulary, self.shared = vocabulary, spark.sparkContext.broadcast(vocabulary)
        self.pairs = stored(pair_table(docs, self.shared), "pairs")
        sums = self.pairs.agg(*(F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in range(1, MOST_DISCOUNTED + 2))).first()
        self.d = good_turing(dict(enumerate(sums, 1)))
        rare = self.pairs.select("bucket", F.explode(F.arrays_zip("rare_v", "rare_w")).alias("p")).select("bucket", F.col("p.rare_v").alias("v"), F.col("p.rare_w").alias("key"))
        rare = rare.join(self.words, "key").groupBy("bucket", "v").agg(F.sum(unigrams.column(c)).alias("seen"))
        self.rest = stored(rare, "rest")
        self.spread = self._spread()

    def _spread(self) -> dict[int, tuple[float, bool, float]]:
        """Of each context that is spread over the buckets; there are at most 1 / HOT_SHARE, and the start."""
        parts = self.pairs.select(F.explode("hot").alias("h")).select("h.*").groupBy("v").agg(*(F.sum(x).alias(x) for x in _HOT))
        rows = parts.join(self.rest.groupBy("v").agg(F.sum("seen").alias("rest")), "v", "left").collect()
        out = {}
        for r in rows:
            turing = r.beyond + sum(self.d[i] * i * r[f"r{i}"] for i in range(1, MOST_DISCOUNTED + 1))
            cv = r.beyond + sum(i * r[f"r{i}"] for i in range(1, MOST_DISCOUNTED + 1))
            out[r.v] = _alpha(cv, turing, r.half, r.seen + (r.rest or 0.0))
        return out


def _alpha(cv, turing, half, seen):
    """cv, whether Good-Turing applies, and log alpha. A context whose pairs were all too frequent for a discount keeps half a count of each back."""
    plain = turing / cv < 1 - 1e-9
    return cv, plain, np.log10((1 - np.where(plain, turing, half) / cv) / (1 - seen))


#: What a bucket gives back for each block of texts: sums for its texts, and words to look up one level down.
_ANSWER = "chunk long, doc binary, n binary, known binary, base binary, score binary, ids binary, no_id binary, low_doc array<int>, low_key array<long>, low_n array<int>"


def _evaluate(texts: pd.DataFrame, block: pd.DataFrame, words: Vocabulary, d: list[float], spread: dict) -> pd.DataFrame:
    u = words.unigrams
    v = [np.cumsum(unpack(b, np.uint64), dtype=np.uint64) for b in texts["v"]]
    ends = np.cumsum([len(x) for x in v]).tolist()
    v, w = np.concatenate(v), np.concatenate([unpack(b, np.uint64) for b in texts["w"]])
    context, start, second, c, rest = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), {}
    if len(block):
        b = block.iloc[0]
        pv, second, c = np.cumsum(unpack(b["v"], np.uint64), dtype=np.uint64), unpack(b["w"], np.uint64), unpack(b["c"], np.uint64 if b["wide"] else np.uint32).astype(np.int64)
        at = np.flatnonzero(np.concatenate(([True], pv[1:] != pv[:-1])))
        context, start = pv[at], np.append(at, len(pv))
        rest = {} if b["rest"] is None else {np.uint64(x["v"] & 0xFFFFFFFFFFFFFFFF): x["seen"] for x in b["rest"]}
    # the contexts of this bucket
    size = np.diff(start)
    cv, plain, alpha = np.zeros(0), np.zeros(0, bool), np.zeros(0)
    if len(context):
        seen = np.where((second & _TOP) > 0, 0.0, u.probability(words.count(second, 1)))
        add = lambda x: np.add.reduceat(x, start[:-1])
        more = np.fromiter((rest.get(x, 0.0) for x in context), np.float64, len(context))
        cv, plain, alpha = _alpha(add(c).astype(float), add(_discounted(c, d)), add(c - 0.5), np.minimum(add(seen) + more, 1 - 1e-15))
        for i in np.flatnonzero(words.spread(context)).tolist():
            cv[i], plain[i], alpha[i] = spread[int(context[i].view(np.int64))]
    # each pair of the texts: its context, then its place among the pairs
    at = np.minimum(np.searchsorted(context, v), max(len(context) - 1, 0))
    there = context[at] == v if len(context) else np.zeros(len(v), bool)
    seconds, number = np.unique(second, return_inverse=True)
    key = np.repeat(np.arange(len(context)), size) * max(len(seconds), 1) + number
    wi = np.minimum(np.searchsorted(seconds, w), max(len(seconds) - 1, 0))
    both = there & (seconds[wi] == w) if len(seconds) else there
    wanted = at * max(len(seconds), 1) + wi
    place = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
    hit = both & (key[place] == wanted) if len(key) else both
    back = np.zeros(len(v))  # log alpha of the contexts; 0 for those without pairs
    back[there] = alpha[at[there]]
    if (lost := words.spread(v) & ~there).any():  # spread contexts whose pairs lie in other buckets
        back[lost] = [spread[x][2] if x in spread else 0.0 for x in v[lost].view(np.int64).tolist()]
    n, ctx = c[place[hit]], at[hit]
    value = np.empty(len(v))
    value[hit] = np.log10(np.where(plain[ctx], _discounted(n, d), n - 0.5) / cv[ctx])
    frequent = (w & _TOP) == 0
    value[~hit] = back[~hit] + np.where(frequent[~hit], np.log10(u.probability(words.count(w[~hit], 0))), 0.0)
    # what the words count for: a word in its own bucket as a context, the end as a second word
    own = np.zeros(len(v), np.int64)
    own[there] = cv[at[there]]
    own = words.count(v, own)
    word, end = v != words.start, w == words.codes(np.array([_hash(END)], np.uint64))[0]
    base = np.where(word, u.base(own), 0.0) + np.where(end, u.base(words.ends), 0.0)
    known = (word & (own > 0)).astype(np.int64) + (end & (words.ends > 0))
    pending = ~hit & ~frequent
    rows = []
    for b, first, last in zip(texts.itertuples(index=False), [0, *ends], ends, strict=False):
        doc, local, s = unpack(b.docs, np.uint32), unpack(b.doc, np.uint32), slice(first, last)
        add = lambda x, k=None: np.bincount(local, x[s], len(doc)) if k is None else np.bincount(local, x[s], len(doc)).astype(k)  # noqa: B023, E731
        late = np.flatnonzero(pending[s])
        low, times = np.unique(np.stack((doc[local[late]].astype(np.int64), w[s][late].view(np.int64))), axis=1, return_counts=True) if len(late) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
        n = np.bincount(local, minlength=len(doc)).astype(np.uint32)
        rows.append((b.chunk, b.docs, pack(n), pack(add(known, np.uint32)), pack(add(base)), pack(add(value)), b.ids, b.no_id, low[0].astype(np.int32), low[1], times.astype(np.int32)))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in _ANSWER.split(", ")])


def _sum_up(answers: pd.DataFrame) -> pd.DataFrame:
    """The sums of all buckets for each text of a block."""
    head = answers[answers["ids"].notna()].iloc[0]
    ids, no_id = unpack(head["ids"], np.int64), unpack(head["no_id"], np.bool_)
    out = {k: np.zeros(len(ids)) for k in ("n", "known", "base", "score")}
    for b in answers.itertuples(index=False):
        doc = unpack(b.doc, np.uint32)
        for k, kind in (("n", np.uint32), ("known", np.uint32), ("base", np.float64), ("score", np.float64)):
            out[k][doc] += unpack(getattr(b, k), kind)
    return pd.DataFrame({"chunk": head["chunk"], "doc": np.arange(len(ids)), "id": pd.array(np.where(no_id, None, ids), "Int64"), **out}).astype({"n": "int64", "known": "int64", "doc": "int32"})


def score(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row for each row of ``docs``."""
    held = lambda c: F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1
    own = docs.select(F.col(row_id).cast("long").alias("id"), F.col(text).alias("text"), held(F.col(row_id)).alias("held_out"))
    model = Model(own.select("text", "held_out"))
    shared, d = model.shared, model.d
    spread = docs.sparkSession.sparkContext.broadcast(model.spread)
    names = ["bucket", "chunk", "v", "w", "doc", "docs", "ids", "no_id"]

    def send(batches):
        reader, rows, chunk = _Reader(shared.value), [], TaskContext.get().partitionId() << 33

        def flush():
            nonlocal rows, chunk
            bucket, v, w, doc = reader.pairs(distinct=False)
            head = pack(np.array([i or 0 for i in rows], np.int64)), pack(np.array([i is None for i in rows], bool))
            out = []
            for k, s in _by_bucket(bucket):
                present, local = np.unique(doc[s], return_inverse=True)
                out.append((k, chunk, pack(_differences(v[s])), pack(w[s]), pack(local.astype(np.uint32)), pack(present.astype(np.uint32)), *(head if not out else (None, None))))
            chunk += 1
            rows = []
            reader.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((*[pa.int64()] * 2, *[pa.binary()] * 6))], names)

        for batch in (part for whole in batches for part in slices(whole, "text")):
            rows += batch.column("id").to_pylist()
            reader.add(batch.column("text").cast(pa.binary()).to_pylist())
            if reader.full():
                yield flush()
        if rows:
            yield flush()

    sent = own.select("id", "text").mapInArrow(send, "bucket long, chunk long, v binary, w binary, doc binary, docs binary, ids binary, no_id binary")
    rest = model.rest.groupBy("bucket").agg(F.collect_list(F.struct("v", "seen")).alias("rest"))  # at most the pairs of a bucket
    blocks = model.pairs.select("bucket", "v", "w", "c", "wide").join(rest, "bucket", "left")

    def evaluate(left, right):
        if not len(left):
            return pd.DataFrame({x.split()[0]: [] for x in _ANSWER.split(", ")})
        return _evaluate(left, right, shared.value, d, spread.value)

    answers = stored(sent.groupBy("bucket").cogroup(blocks.groupBy("bucket")).applyInPandas(evaluate, _ANSWER), "answers")
    lower = answers.select("chunk", F.explode(F.arrays_zip("low_doc", "low_key", "low_n")).alias("x")).select("chunk", F.col("x.low_doc").alias("doc"), F.col("x.low_key").alias("key"), F.col("x.low_n").alias("times"))
    log_p = F.log10(model.vocabulary.unigrams.column(F.coalesce("c", F.lit(0))))
    lower = lower.join(model.words, "key", "left").groupBy("chunk", "doc").agg(F.sum(F.col("times") * log_p).alias("lower"))
    sums = answers.drop("low_doc", "low_key", "low_n").groupBy("chunk").applyInPandas(_sum_up, "chunk long, doc int, id long, n long, known long, base double, score double")
    sums = sums.join(lower, ["chunk", "doc"], "left")
    return sums.select(
        F.col("id").alias(row_id), held(F.col("id")).alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(model.vocabulary.unigrams.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("score") + F.coalesce("lower", F.lit(0.0))).alias("score"),
    )


def probability(previous: bytes | None, word: bytes, counts: dict[bytes, int], pairs: dict[tuple[bytes, bytes], int]) -> float:
    """p(word | previous) by the definition, for tests: ``counts`` with END, ``pairs`` with START and END."""
    total = sum(counts.values())
    of = lambda table: {r: sum(x == r for x in table.values()) for r in range(1, MOST_DISCOUNTED + 2)}
    u = Unigrams(total, len(counts), of(counts), sum(x for x in counts.values() if x > MOST_DISCOUNTED))
    p = lambda w: float(u.probability(counts.get(w, 0)))
    d = good_turing(of(pairs))
    own = {w: c for (v, w), c in pairs.items() if v == (START if previous is None else previous)}
    if not own:
        return p(word)
    cv = counts[END] if previous is None else counts[previous]
    share = {w: c * (d[c] if c <= MOST_DISCOUNTED else 1) / cv for w, c in own.items()}
    if math.fsum(share.values()) >= 1 - 1e-9:
        share = {w: (c - 0.5) / cv for w, c in own.items()}
    if word in share:
        return share[word]
    return (1 - math.fsum(share.values())) / (1 - math.fsum(map(p, own))) * p(word)
