"""Merkle manifests, periodic runs and chat windows against brute force."""

import hashlib
import itertools
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import chat, merkle, periodic
from lodestone.llm.queries import QUERIES

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


# -- Merkle manifest
def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, fanout):
    """The root of ``nodes``, and for each the siblings (before, after) up to it."""
    paths, spans = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, wider = [], []
        for a in range(0, len(nodes), fanout):
            run = nodes[a : a + fanout]
            for j, span in enumerate(spans[a : a + fanout]):
                for i in span:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(H("".join(run)))
            wider.append(list(itertools.chain(*spans[a : a + fanout])))
        nodes, spans = above, wider
    return nodes[0], paths


def whole_tree(rows, fanout=2):
    """(doc_id, leaf) -> (subroot, root, path) of all rows, as lists."""
    by = defaultdict(list)
    for r in rows:
        by["" if r["lang"] is None else "=" + r["lang"]].append((r["doc_id"] is not None, r["doc_id"], H("".join(field(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")))))
    groups = sorted(by, key=str.encode)
    subs = {}
    for g in groups:
        by[g].sort(key=lambda x: (x[0], x[1] or 0, x[2]))
        subs[g] = tree([x[2] for x in by[g]], fanout)
    root, over = tree([subs[g][0] for g in groups], fanout) if groups else (None, [])
    out = defaultdict(list)
    for g, up in zip(groups, over, strict=True):
        for (_, i, leaf), path in zip(by[g], subs[g][1], strict=True):
            out[i, leaf].append((subs[g][0], root, path + up))
    return out


def fold(leaf, path):
    for before, after in path:
        leaf = H(before + leaf + after)
    return leaf


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = [{"doc_id": i, "source": r.choice(["s", None]), "lang": r.choice(["en", "en", "en", "de", "zß", "Z", None, ""]), "n_chars": r.choice([None, 5, 9]), "text": r.choice(["", None, "a b", "é\n"]) if i % 3 else "x" * i} for i in range(150)]
    return out + [dict(out[7]), dict(out[7]), dict(out[9], text="other"), dict(out[11], doc_id=None), {"doc_id": 3, "source": None, "lang": "one", "n_chars": 1, "text": "only"}]


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("fanout,height", [(2, 8), (2, 1), (3, 2)])
def test_manifest(spark, rows, fanout, height):
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    df = spark.createDataFrame(rows, DOCS).repartition(4).withColumns({"grp": F.lit(1), "at": F.lit("x"), "digest": F.lit(None)})
    got = merkle.manifest(df, fields, fanout=fanout, height=height, keep={"other": F.col("at")}).withColumn("fold", merkle.folded(F.col("leaf"), F.col("proof"))).withColumn("sha", merkle.proof_digest(F.col("proof"))).collect()
    want = whole_tree(rows, fanout)
    assert Counter((g.doc_id, g.leaf) for g in got) == Counter({k: len(v) for k, v in want.items()})
    for g in got:
        assert (g.subroot, g.root, [tuple(x.split(",")) for x in g.proof]) in want[g.doc_id, g.leaf] and g.fold == g.root and g.other == "x"
        assert g.sha == H("".join(a + b for a, b in (x.split(",") for x in g.proof)))


def test_manifest_query(spark, rows, tmp_path):
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_merkle_manifest"](spark, str(tmp_path)).collect()
    want = whole_tree(rows)
    assert len(got) == len(rows) and any(not g.verified for g in got) and any(g.verified for g in got)
    by = {}
    for r in rows:
        changed = r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
        by[r["doc_id"], H("".join(field(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")))] = H("".join(field(r[c] + 1 if c == "n_chars" and changed else r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")))
    for g in got:
        match = [p for s, root, p in want[g.doc_id, g.leaf] if (s, root, H("".join(a + b for a, b in p))) == (g.subroot, g.root, g.proof_sha256)]
        assert match and g.folded_root == fold(by[g.doc_id, g.leaf], match[0]) and g.verified == (g.folded_root == g.root)


def test_manifest_empty_and_single(spark, rows):
    assert merkle.manifest(spark.createDataFrame([], DOCS), ["doc_id", "text"]).count() == 0
    one = merkle.manifest(spark.createDataFrame(rows[:1], DOCS), ["doc_id", "text"]).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root and one[0].proof == []


def test_subtree_order_and_memory():
    r = random.Random(1)
    for size in (1, 2, 3, 5, 8, 13):
        members = [{"at": i, "digest": H(str(i))} for i in range(size)]
        r.shuffle(members)
        t = merkle.Subtree(size, 2, 5)
        assert [t.add(m) for m in members] == [False] * (size - 1) + [True]
        assert t.top == tree([H(str(i)) for i in range(size)], 2)[0]


# -- periodic runs
def brute_runs(w, min_length=6, exponent=4):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(min_length, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1) if j == i else j
    return sorted((s, n, q) for (s, n), q in found.items())


def collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.text("ab", min_size=1, max_size=3), st.integers(1, 7)), max_size=6), min_size=1, max_size=4), st.sampled_from([(6, 4), (3, 3), (10, 5), (1, 3)]))
def test_runs_equal_brute_force(texts, limits):
    words = [[*"".join(unit * n for unit, n in t)] for t in texts]
    flat = [x for w in words for x in w]
    of = np.repeat(np.arange(len(words)), [len(w) for w in words])
    got = periodic.text_runs(np.array([ord(x) for x in flat], np.int64), of, *limits) if flat else []
    first, want = 0, []
    for w in words:
        want += [(s + first, n, q) for s, n, q in brute_runs(w, *limits)]
        first += len(w)
    assert sorted(map(tuple, (x.tolist() for x in got))) == want


def test_least_overlap_masks_no_run():
    assert periodic.least_overlap(6, 4) == 5
    w = np.array([1, 2, 3, 4, 1, 2, 3, 5])
    assert not periodic.survivors(w, np.zeros(8, np.int64), 5).any()


def test_runs_query(spark, tmp_path):
    r = random.Random(5)
    texts = [None, "", " \t", "a", "a " * 6, "a b " * 4 + "c", "x\n" * 5 + "y"]
    for _ in range(80):
        parts = [" ".join(r.choice("uvwxyz") for _ in range(r.randrange(1, 30))) for _ in range(3)]
        unit = " ".join(r.choice("pqé") for _ in range(r.randrange(1, 6)))
        texts.append(parts[0] + "  " + " ".join([unit] * r.randrange(1, 9)) + "\n" + parts[1] + " " + " ".join([unit] * 4) + " " + parts[2])
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, "a"), (None, "b b b b b b")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()
    want = []
    for i, t in docs:
        w0 = (t or "").split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        n, g = len(w0), h // 10
        w = w0
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w0[k] if k < a else w0[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(w)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, H("".join(f"{s},{n},{q}\n" for s, n, q in runs)), H(" ".join(collapse(w, runs)))))
    assert Counter(map(tuple, got)) == Counter(want) and sum(x[1] for x in want) > 20


def test_runs_clashing_columns_and_empty(spark):
    schema = "text string, runs int, Collapsed int, n_words int"
    got = periodic.find_runs(spark.createDataFrame([("a a a a a a b", 1, 2, 3)], schema)).collect()[0]
    assert (got["runs_"], got["Collapsed_"], got["n_words_"], got["n_words"], got["collapsed"]) == (1, 2, 3, 7, "a b")
    assert [tuple(x) for x in got["runs"]] == [(0, 6, 1)]
    assert periodic.find_runs(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(spark.createDataFrame([], schema), exponent=2)


def test_long_periodic_text_is_not_quadratic():
    r = np.random.default_rng(0)
    unit = r.integers(0, 500, 997)
    w = np.concatenate([np.tile(unit, 300), np.zeros(100_000, np.int64)])
    began = time.time()
    runs = periodic.text_runs(w, np.zeros(len(w), np.int64), 6, 4)
    assert time.time() - began < 60 and (0, 299_100 + (1 if unit[0] == 0 else 0), 997) in {tuple(x) for x in runs.tolist()}


# -- chat windows
SAID = "conv_id long, turn long, role string, text string"
PIECES = ["<|turn|>", "<|end|>\n", "<|", "<\\|", "<\\\\|end|>", "\\", "\\n", "\n", "[INST]", "[/INST]", "[\\INST]", "</s>", "<s>", "<", "|", "[", "é𝄞", "plain words", "<<|", "[[INST]"]


def words_counter(df, text, out):
    return df.withColumn(out, F.size(F.split(text, " ")).cast("long"))


@pytest.fixture(scope="module")
def said():
    r = random.Random(9)
    rows = []
    for c in range(30):
        rows += [(c, t, ["system", "user", "assistant"][0 if t == 0 and c % 2 else 1 + t % 2], "".join(r.choice(PIECES) for _ in range(r.randrange(6)))) for t in range(r.randrange(1, 9))]
    rows += [(99, t, "assistant" if t % 2 else "user" if t else "system", "w " * r.randrange(1, 30) + f"#{t}") for t in range(400)]
    rows += [(98, 0, "user", None), (98, 1, None, "null role"), (98, 1, None, "null role"), (98, None, "assistant", "null turn"), (98, 2, "ro\nle\\n<|x", ""), (None, 0, "user", "null conversation"), (97, 0, "assistant", "w " * 700), (97, 1, "user", "a"), (97, 2, "assistant", "b")]
    return rows


def in_order(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role is not None, role or "", text or ""))
    return {c: [(x[3], x[4]) for x in sorted(v)] for c, v in by.items()}


def test_windows(spark, said):
    budget, history = 120, 25
    got = chat.windows(spark.createDataFrame(said, SAID).repartition(4), words_counter, budget, history).collect()
    by = defaultdict(list)
    for g in sorted(got, key=lambda g: (g.block, g.nth)):
        by[g.conv_id].append(g)
    want = in_order(said)
    assert set(by) == set(want) and max(g.block for g in got) > 1
    for c, ws in by.items():
        assert [w.first_turn for w in ws] == list(itertools.accumulate([0, *(w.n_turns for w in ws[:-1])]))
        new = [t for w in ws for t in chat.turns_of(w.text)[w.n_repeated :]]
        assert new == want[c]
        for w in ws:
            turns = chat.turns_of(w.text)
            assert len(turns) == w.n_repeated + w.n_turns and (w.n_tokens <= budget or w.n_turns == 1)
            sys = want[c][0][0] == "system" and w.first_turn > 0
            assert not sys or turns[0] == want[c][0]
            again = turns[sys : w.n_repeated]
            assert again == want[c][w.first_turn - len(again) : w.first_turn]
            assert [chat.unescaped(w.text[a:b]) for a, b in w.loss] == [t for r, t in turns[w.n_repeated :] if r == "assistant"]
    assert any(w.n_repeated > 2 for w in by[99]) and all(w.n_repeated for w in by[99][1:])


def test_windows_are_filled(spark):
    rows = [(1, t, "user", "w " * (1 + t % 7)) for t in range(60)]
    got = sorted(chat.windows(spark.createDataFrame(rows, SAID), words_counter, 40, 0).collect(), key=lambda g: (g.block, g.nth))
    sizes = [1 + len(("w " * (1 + t % 7)).split(" ")) for t in range(60)]
    for a, b in itertools.pairwise(got):
        if a.block == b.block:  # the next turn didn't fit
            assert a.n_tokens + chat.turns_of(b.text)[0][1].count("w") + 1 > 40
    assert sizes and sum(g.n_turns for g in got) == 60


def test_read_back(spark, said):
    got = chat.read_back(chat.windows(spark.createDataFrame(said, SAID).repartition(4), words_counter, 120, 25))
    got = {g.conv_id: g for g in got.collect()}
    for c, turns in in_order(said).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), H("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), H(loss)) and g.formatted_chars > 0
    assert chat.read_back(chat.windows(spark.createDataFrame([], SAID), words_counter)).count() == 0


def test_escape_is_reversible(spark):
    texts = ["".join(x) for n in (1, 2, 3) for x in itertools.product(PIECES, repeat=n)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e")).collect()
    assert all(chat.unescaped(g.e) == g.t and not any(c in g.e for c in chat.CONTROL) for g in got) and len({g.e for g in got}) == len({g.t for g in got})


def test_chat_query(spark, tmp_path):
    rows = [(1, 1, "assistant", "</s> hi"), (1, 0, "user", "<|turn|>")]
    spark.createDataFrame(rows, SAID).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {g.conv_id: g for g in QUERIES["op13_chat_windows"](spark, str(tmp_path)).collect()}
    ok = "</s>[INST] ok [/INST]"
    assert set(got) == {1, -7} and got[-7].turns_sha256 == H(f"user\n{ok}\nassistant\n{ok}\n") and got[-7].loss_sha256 == H(ok) and got[-7].loss_chars == len(ok)
    assert got[1].turns_sha256 == H("user\n<|turn|>\nassistant\n</s> hi\n")
