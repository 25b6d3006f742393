"""Conversations formatted as windows of a token budget, and read back.

Template: a turn is ``<|turn|>``, the role, a line end, the text, ``<|end|>`` and a line end. Control strings within a text or role get a
backslash behind their first character (more than one if some stand there already), which reading takes away again; line ends and backslashes of
roles are written as ``\\n`` and ``\\\\``.

Turns are numbered, and the prefix sums of their tokens taken, over ranges of all rows, so a conversation of any size is dealt out to many
tasks. The prefix sums cut a conversation into blocks of ``BLOCK`` budgets. Within a block windows take whole turns while they fit. Each window
begins with the conversation's system turn (its first turn, if its role says so) and repeats the last turns before it, up to ``history``
tokens and as far as the next turn fits too; a block gets the turns that its first window may repeat, and the system turn, along with its own. Only assistant texts that
are new in a window are under its loss mask. A task holds one block at a time.

Defined results: a null text is an empty one, a null role an empty one; a null turn comes first; turns of one number are in the order of their roles,
then of a hash of their texts; repeated rows are turns of their own; rows with a null conversation are one conversation; a turn longer than the budget is
never cut and has a window that exceeds it; an empty table gives no windows; further columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import numbered, stored

TURN, END = "<|turn|>", "<|end|>\n"
#: What texts may hold and trainers give a meaning: each as its first character and the rest.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]")
#: Windows whose tokens a block holds.
BLOCK = 16
SYSTEM, TARGET = "system", "assistant"

_HEADS = "".join(sorted({re.escape(c[0]) for c in CONTROL}))
_RESTS = "|".join(re.escape(c[1:]) for c in CONTROL)
_ESCAPED = re.compile(rf"([{_HEADS}]\\*)\\(?={_RESTS})")
_MARKED = re.compile(rf"{re.escape(TURN)}(.*?)\n(.*?){re.escape(END)}", re.S)


def escaped(text: Column) -> Column:
    """``text`` without a control string; no two texts give the same."""
    return F.regexp_replace(text, rf"([{_HEADS}]\\*)(?={_RESTS})", r"$1\\")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _unquoted(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


def turns_of(window: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    return [(_unquoted(unescaped(role)), unescaped(text)) for role, text in _MARKED.findall(window)]


def bpe_counter(ranks: dict[bytes, int], pattern: str, public: str | None = None) -> Callable[[DataFrame, str, str], DataFrame]:
    """A counter for ``windows``: adds the number of byte-level BPE tokens of a column."""

    def count(df: DataFrame, text: str, out: str) -> DataFrame:
        from lodestone.llm.bpe import encode

        return encode(df, ranks, pattern, public, text, "bpe_ids").withColumn(out, F.size("bpe_ids").cast("long")).drop("bpe_ids")

    return count


def _window(system: dict | None, earlier: list[dict], new: list[dict]) -> dict:
    parts = [*([system] if system else []), *earlier, *new]
    loss, at = [], sum(len(t["segment"]) for t in parts[: len(parts) - len(new)])
    for t in new:
        if t["target"]:
            loss.append({"start": at + t["head"], "end": at + len(t["segment"]) - len(END)})
        at += len(t["segment"])
    return {"first_turn": new[0]["at"], "n_turns": len(new), "n_repeated": len(parts) - len(new), "n_tokens": sum(t["n_tokens"] for t in parts), "loss": loss, "text": "".join(t["segment"] for t in parts)}


def pack(turns: list[dict], system: dict | None, budget: int, history: int) -> Iterator[dict]:
    """Windows over the turns of a block, in order. Turns that aren't the block's own can only be repeated; ``system`` can't, unless it is None here."""
    own = next((i for i, t in enumerate(turns) if t["own"]), len(turns))
    while own < len(turns):
        is_first = turns[own]["at"] == 0
        fixed = system if system is not None and not is_first else None
        used = (fixed["n_tokens"] if fixed else 0) + turns[own]["n_tokens"]
        back = own
        while back and turns[back - 1] is not system and sum(t["n_tokens"] for t in turns[back - 1 : own]) <= history and used + sum(t["n_tokens"] for t in turns[back - 1 : own]) <= budget:
            back -= 1
        used += sum(t["n_tokens"] for t in turns[back:own])
        stop = own + 1
        while stop < len(turns) and used + turns[stop]["n_tokens"] <= budget:
            used += turns[stop]["n_tokens"]
            stop += 1
        yield _window(fixed, turns[back:own], turns[own:stop])
        own = stop


_WINDOW = T.StructType([
    *(T.StructField(c, T.LongType()) for c in ("block", "nth", "first_turn", "n_turns", "n_repeated", "n_tokens")),
    T.StructField("loss", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("text", T.StringType()),
])


def windows(df: DataFrame, count: Callable[[DataFrame, str, str], DataFrame], budget: int = 1024, history: int = 256, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(``conv``, block, nth, first_turn, n_turns, n_repeated, n_tokens, loss, text): the windows of all conversations, in the order of block and nth.

    ``loss``: code points [start, end) of ``text`` that are targets; the first ``n_repeated`` turns of a window are repeated. ``count``
    adds the tokens of a formatted turn; ``history`` must be below ``budget``."""
    quoted = F.replace(F.replace(F.coalesce(F.col(role).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(TURN), escaped(quoted), F.lit("\n"))
    body = escaped(F.coalesce(F.col(text), F.lit("")))
    turns = df.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("grp"), F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.xxhash64(text).alias("key"),
        F.concat(head, body, F.lit(END)).alias("segment"), F.length(head).cast("long").alias("head"), F.coalesce(F.col(role) == TARGET, F.lit(False)).alias("target"), F.coalesce(F.col(role) == SYSTEM, F.lit(False)).alias("system"),
    )
    placed = numbered(stored(count(turns, "segment", "n_tokens"), "turns"), "grp", ["turn", "role", "key"], ("n_tokens",), "placed_turns")
    size = BLOCK * budget
    placed = placed.withColumn("block", F.floor(F.col("n_tokens_before") / F.lit(size)).cast("long")).withColumn("system", F.col("system") & (F.col("at") == 0))
    held = placed.select("grp", "conv", "block", "at", "segment", "head", "target", "system", "n_tokens", F.lit(True).alias("own"))
    # a block that may repeat turns of the one before it begins at its bound or later
    tail = placed.filter((F.col("block") + 1) * size - F.col("n_tokens_before") <= history).withColumn("block", F.col("block") + 1)
    later = placed.filter("block > 0").select(F.col("grp").alias("of"), F.col("block").alias("later")).distinct()
    first = placed.filter("system").join(later, F.col("grp") == F.col("of")).withColumn("block", F.col("later"))
    lent = tail.filter("not system").unionByName(first.drop("of", "later")).select(*held.drop("own").columns, F.lit(False).alias("own"))
    dealt = held.unionByName(lent).repartition("grp", "block").sortWithinPartitions("grp", "block", "at", "own")
    schema = T.StructType([placed.schema["grp"], placed.schema["conv"], *_WINDOW.fields])

    def run(batches):
        kinds, out = None, []
        rows = (r for b in batches for r in b.to_pylist())
        kinds = pa.schema([("grp", pa.string()), ("conv", kind), *((c, pa.int64()) for c in _WINDOW.fieldNames()[:6]), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("text", pa.string())])
        for (grp, block), block_rows in groupby(rows, lambda r: (r["grp"], r["block"])):
            held = list(block_rows)
            system = next((t for t in held if t["system"]), None)
            packed = pack([t for t in held if t["own"] or not t["system"]], system, budget, history)
            out += [{"grp": grp, "conv": held[0]["conv"], "block": block, "nth": i} | w for i, w in enumerate(packed)]
            if len(out) > 500:
                yield pa.RecordBatch.from_pylist(out, kinds)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, kinds)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(placed.schema["conv"].dataType)
    return dealt.mapInArrow(run, schema).drop("grp").withColumnRenamed("conv", conv)


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(``conv``, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, from its windows' texts and masks alone.

    Windows are parsed where they are; one task then hashes a conversation's parts in their order, as they come, holding one at a time: a digest of a
    whole conversation can't be made in parts."""
    grp = F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))
    parts = T.StructType([T.StructField("grp", T.StringType()), formatted.schema[conv], T.StructField("block", T.LongType()), T.StructField("nth", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns", T.StringType()), T.StructField("loss", T.StringType()), T.StructField("chars", T.LongType())])

    def parse(batches):
        for b in batches:
            rows = b.to_pylist()
            turns = [turns_of(r["text"])[r["n_repeated"] :] for r in rows]
            said = ["".join(f"{role}\n{text}\n" for role, text in t) for t in turns]
            loss = ["".join(unescaped(r["text"][s["start"] : s["end"]]) for s in r["loss"]) for r in rows]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("grp", conv, "block", "nth")), pa.array(list(map(len, turns)), pa.int64()), pa.array(said, pa.string()), pa.array(loss, pa.string()), pa.array([len(r["text"]) for r in rows], pa.int64())], parts.fieldNames())

    schema = T.StructType([formatted.schema[conv], T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def digest(batches):
        def rows():
            for b in batches:
                for i in range(b.num_rows):
                    yield {c: b.column(c)[i].as_py() for c in b.schema.names}

        out, kind = [], pa.schema([(conv, conv_kind), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        for _, group in groupby(rows(), lambda r: r["grp"]):
            said, loss, turns, chars, total = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for r in group:
                said.update(r["turns"].encode())
                loss.update(r["loss"].encode())
                turns, chars, total, name = turns + r["n_turns"], chars + len(r["loss"]), total + r["chars"], r[conv]
            out.append({conv: name, "n_turns": turns, "turns_sha256": said.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": total})
            if len(out) > 5000:
                yield pa.RecordBatch.from_pylist(out, kind)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, kind)

    from pyspark.sql.pandas.types import to_arrow_type

    conv_kind = to_arrow_type(formatted.schema[conv].dataType)
    parsed = formatted.select(grp.alias("grp"), conv, "block", "nth", "n_repeated", "loss", "text").mapInArrow(parse, parts)
    return parsed.repartition("grp").sortWithinPartitions("grp", "block", "nth").mapInArrow(digest, schema)
