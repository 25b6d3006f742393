"""The registered queries against brute force, in every column that they return by contract, on a small table with nulls, empty and repeated texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import tiktoken

from lodestone.llm import license_scan, pii, pretokens
from lodestone.llm.queries import QUERIES

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(11)
    words = ["the", "Of", "and", "été", "mail"] + ["".join(r.choice("abcdeéou") for _ in range(r.randrange(2, 8))) for _ in range(120)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    texts = [text(r.randrange(1, 120)) for _ in range(40)]
    texts += [texts[0], texts[1] + " more", None, "", " \t\n", "a", "Under the MIT license and\nthe same line\nthe same line", "x " * 40]
    texts += ["Write to a.b@c.de or 10.0.0.255, call +49 (30) 1234-5678, pay 4111 1111 1111 1111 now", "Apache License, Version 2.0; CC BY-NC-ND"]
    item = text(14)
    texts += [text(5) + " " + item + " " + text(3), item.upper()]
    documents = [(i * 3, t, ["en", "de"][i % 2], f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    items = [(1, item), (20, "a"), (3, None), (None, texts[2]), (4, texts[3])]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, documents, items


@pytest.fixture
def run(spark, tables):
    def rows(name):
        got = [g.asDict() for g in QUERIES[name](spark, tables[0]).collect()]
        assert Counter(g["doc_id"] for g in got) == Counter(d[0] for d in tables[1])
        return {g["doc_id"]: g for g in got}

    return rows


def test_op1(run, tables):
    got = run("op1_sharding")
    by = defaultdict(list)
    for i, t, *_ in tables[1]:
        g, data = got[i], (t or "").encode()
        assert (g["size"], g["text_crc32"], g["law"], g["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "bytes", None) and 0 <= g["shard"] < 40
        by[g["shard"]].append(g)
    assert all(sorted(x["slot"] for x in v) == list(range(len(v))) for v in by.values())
    total, largest = sum(g["size"] for g in got.values()), max(g["size"] for g in got.values())
    for i in range(1, 40):  # each boundary is as near as rows allow
        assert abs(sum(g["size"] for g in got.values() if g["shard"] < i) - total * i / 40) <= largest / 2 + 0.001 * total / 40 + 1


def test_op2(run, tables):
    from lodestone.llm.token_counts import zipf_scores

    got = run("op2_token_counts")
    split, scores = pretokens.Splitter(P.PATTERN), zipf_scores(pretokens.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")))
    for i, t, *_ in tables[1]:
        tokens = score = 0
        for w in (x.encode() for x in split.find(t or "")):
            best = [(0.0, 0)] + [(-1e300, 0)] * len(w)
            for b in range(1, len(w) + 1):
                for a in range(b - 1, -1, -1):
                    if (s := scores.get(w[a:b])) is not None and best[a][0] + s >= best[b][0]:
                        best[b] = (best[a][0] + s, best[a][1] + 1)
            score, tokens = score + best[-1][0], tokens + best[-1][1]
        assert (got[i]["n_pretokens"], got[i]["n_tokens"]) == (len(split.find(t or "")), tokens) and abs(got[i]["score"] - score) < 1e-6


def test_op3(run, tables):
    got = run("op3_benchmark_decontamination")
    for i, t, *_ in tables[1]:
        w, hit, ids = ALNUM.findall((t or "").translate(LOW)), set(), set()
        for k, x in tables[2]:
            x = ALNUM.findall((x or "").translate(LOW))
            for a in range(max(1, len(x) - 9)) if x and k is not None else ():
                win = x[a : a + 10]
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        hit.update(range(s, s + len(win)))
                        ids.add(str(k))
        want = {"doc_id": i, "n_words": len(w), "n_hit": len(hit), "n_items": len(ids), "items_sha256": sha(",".join(sorted(ids))), "contaminated": bool(hit)}
        assert {k: got[i][k] for k in want} == want


def test_op4(run, tables):
    got = run("op4_license_scan")
    for i, t, *_ in tables[1]:
        w = ALNUM.findall((t or "").translate(LOW))
        places = sorted((a, label) for p, label in license_scan.BASE.items() for a in range(len(w)) if w[a : a + len(p.split())] == p.split())
        g = got[i]
        assert (g["n_words"], g["n_base"], g["base_labels"]) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert (g["first_word"], g["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        labels = g["labels"].split(",") if g["labels"] else []
        assert labels == sorted(set(labels)) and {x for _, x in places} <= set(labels) and 0 <= g["score"] <= 1


def test_op5(run, tables):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=pretokens.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = run("op5_byte_bpe")
    for i, t, *_ in tables[1]:
        ids = own.encode_ordinary(t or "")
        assert got[i] == {"doc_id": i, "n_tokens": len(ids), "ids_sha256": sha(",".join(map(str, ids))), "decoded_sha256": sha(t or "")}


def test_op6(run, tables):
    got = run("op6_quality_rules")
    for i, t, *_ in tables[1]:
        t = t or ""
        w = SPACED.findall(t)
        windows = [tuple(w[a : a + 5]) for a in range(len(w) - 4)]
        often = {x for x, n in Counter(windows).items() if n > 1}
        repeated = len({j for a, x in enumerate(windows) if x in often for j in range(a, a + 5)})
        lines = [x for x in t.split("\n") if SPACED.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeated, len(w) < 10 or 100 * repeated > 20 * len(w))
        assert tuple(got[i][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want and not (want[-1] and got[i]["kept"])


def test_op7(run, tables):
    import math

    got = run("op7_lm_scoring")
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, *_ in tables[1]}
    tokens = {i: [*SPACED.findall((t or "").translate(LOW)), " end"] for i, t, *_ in tables[1]}
    counts = Counter(x for i, w in tokens.items() if not held[i] for x in w)
    total, v = sum(counts.values()), len(counts)
    for i, w in tokens.items():
        g = got[i]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (held[i], len(w), sum(counts[x] > 0 for x in w), total)
        assert math.isclose(g["base_score"], sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (v + 1))) for x in w), rel_tol=1e-9) and g["score"] < 0


def test_op8(run, tables):
    got = run("op8_personal_data")
    kinds = ["email", "ip", "card", "phone"]
    for i, t, *_ in tables[1]:
        t = t or ""
        digits = lambda m: re.sub("[^0-9]", "", m)
        found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
        found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
        found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m.group())) <= 15]
        base = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(found))
        assert [got[i][f"n_{k}"] for k in kinds] == [sum(x[1] == k for x in found) for k in range(4)] and got[i]["base_sha256"] == sha(base)
        assert set(filter(None, base.split(","))) <= set(got[i]["spans"].split(","))


def test_op10(run, tables):
    got = run("op10_minhash_near_dedup")
    sets = {}
    for i, t, *_ in tables[1]:
        w = SPACED.findall((t or "").translate(LOW))
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[a : a + 5]) for a in range(len(w) - 4)}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    for i in sets:
        assert got[i] == {"doc_id": i, "n_shingles": len(sets[i]), "component_id": root[i], "kept": root[i] == i}
