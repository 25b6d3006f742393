"""Token counts under a unigram tokenizer, by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens of a batch go into a byte trie. Each node keeps the best unigram score of
its prefix and the number of pieces of that segmentation; both depend on the prefix alone, so
pre-tokens that share a prefix share its forward scores, and the node where a pre-token ends
stores its count. Documents then only look up terminal counts. Nothing is shuffled.

The vocabulary is a public byte-level vocabulary with every single byte, so each text has a
segmentation. Its file gives ranks, not probabilities; a piece of rank r has probability proportional to
1 / (r + 1), Zipf's law, summing to one over the vocabulary, unless the caller gives scores. Nothing is trained. Equal scores
go to the longer last piece.

Defined results: null and empty texts have no pre-tokens, no tokens and score 0; whole texts
count, whatever their length; a trie over ``MOST_NODES`` is dropped and built anew, and a pre-token over ``LONG`` bytes is scored
outside it with the scores of its last prefixes alone, which changes no result; other columns pass through, and one named like
a new column, in any case, is kept under its name with underscores.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.common import set_aside, slices
from lodestone.llm.pretokens import Splitter

#: Trie nodes of a task before it starts afresh.
MOST_NODES = 1_000_000
#: Bytes of a pre-token beyond which it doesn't enter the trie.
LONG = 1 << 14


def zipf_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    """Logarithms of probabilities that sum to one."""
    whole = math.log(math.fsum(1 / (r + 1) for r in ranks.values())) if ranks else 0.0
    return {b: -math.log(r + 1) - whole for b, r in ranks.items()}


class PrefixTrie:
    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=0)
        # a piece can only end in a suffix that other pieces have, so a suffix test ends the search early
        self.suffixes = {b[i:] for b in scores for i in range(len(b))}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.count = [0.0], [0]

    def terminal(self, word: bytes) -> int:
        """The node of ``word``, with forward scores for each prefix that is new."""
        child, best, count, scores, suffixes = self.child, self.best, self.count, self.scores, self.suffixes
        path, node = [0], 0
        for end, byte in enumerate(word, 1):
            key = node << 8 | byte
            node = child.get(key, -1)
            if node < 0:
                top, pieces = -math.inf, 0
                for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
                    piece = word[start:end]
                    if piece not in suffixes:
                        break
                    s = scores.get(piece)
                    if s is not None and (s := best[path[start]] + s) >= top:
                        top, pieces = s, count[path[start]] + 1
                if not pieces:
                    raise ValueError("the vocabulary lacks a single byte of the text")
                node = child[key] = len(best)
                best.append(top)
                count.append(pieces)
            path.append(node)
        return node

    def apart(self, word: bytes) -> tuple[int, float]:
        """Pieces and score of a word that stays out of the trie; only the scores of its last prefixes are kept."""
        keep = self.longest
        best, count = [0.0] + [-math.inf] * keep, [0] * (keep + 1)  # by prefix length modulo keep + 1
        for end in range(1, len(word) + 1):
            top, pieces = -math.inf, 0
            for start in range(end - 1, max(-1, end - 1 - keep), -1):
                piece = word[start:end]
                if piece not in self.suffixes:
                    break
                s = self.scores.get(piece)
                if s is not None and (s := best[start % (keep + 1)] + s) >= top:
                    top, pieces = s, count[start % (keep + 1)] + 1
            if not pieces:
                raise ValueError("the vocabulary lacks a single byte of the text")
            best[end % (keep + 1)], count[end % (keep + 1)] = top, pieces
        return count[len(word) % (keep + 1)], best[len(word) % (keep + 1)]


def count_tokens(df: DataFrame, scores: dict[bytes, float], pattern: str, public: str | None = None, text: str = "text", out: tuple[str, str, str] = ("n_pretokens", "n_tokens", "score")) -> DataFrame:
    """``df`` with the pre-tokens, tokens and summed best unigram score of each text."""
    df = set_aside(df, *out)
    shared = df.sparkSession.sparkContext.broadcast(scores)  # a vocabulary: its size doesn't depend on the data
    schema = T.StructType([*(f for f in df.schema.fields if f.name not in out), *(T.StructField(c, k, False) for c, k in zip(out, (T.LongType(), T.LongType(), T.DoubleType()), strict=True))])

    def run(batches):
        trie, find, known = None, Splitter(pattern, public).find, {}
        for batch in (part for whole in batches for part in slices(whole, text)):
            trie = trie or PrefixTrie(shared.value)
            if len(trie.best) > MOST_NODES:
                trie.clear()
                known = {}
            rows = []
            for t in batch.column(text).to_pylist():
                words = find(t) if t else []
                tokens, total = 0, 0.0
                for w in words:
                    got = known.get(w)
                    if got is None and len(w) > LONG:
                        got = trie.apart(w.encode("utf-8"))
                    elif got is None:
                        node = trie.terminal(w.encode("utf-8"))
                        got = known[w] = (trie.count[node], trie.best[node])
                        if len(trie.best) > MOST_NODES:
                            trie.clear()
                            known = {}
                    tokens += got[0]
                    total += got[1]
                rows.append((len(words), tokens, total))
            kept = [c for c in batch.schema.names if c not in out]
            cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], [*kept, *out])

    return df.mapInArrow(run, schema)
