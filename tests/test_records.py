"""Ledgers, traces, versions, copies, objects, logs, laid-out pages and office files."""

import datetime as dt
import itertools
import random
import zipfile
from collections import defaultdict

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lodestone.operators import index as N
from lodestone.operators import ledger as D
from lodestone.operators import trace as T
from lodestone.sources import copying as C
from lodestone.sources import layout as Y
from lodestone.sources import objects as B
from lodestone.sources import office as O
from lodestone.sources import versions
from lodestone.streaming import logs as LG

EVENTS = "document_id string, step string, status string, at timestamp, seq long"


def step_events(n, seed=1):
    r, start = random.Random(seed), dt.datetime(2024, 1, 1)
    return [(f"d{r.randrange(6)}", r.choice(["parse", "embed"]), r.choice([*list(D.FOLLOWS)[1:], None, "odd"]), start + dt.timedelta(seconds=i // 2), i) for i in range(n)]


def folded(events):
    """Events with their flags, in order; and where each step stands."""
    out, now = [], defaultdict(lambda: ("", 0))
    for d, s, status, at, seq in sorted(events, key=lambda e: (e[3], e[4])):
        was, tries = now[d, s]
        ok = (status or "?") in D.FOLLOWS[was]
        now[d, s] = (status, tries + (status == "running")) if ok else (was, tries)
        out.append((d, s, seq, status or "?", ok, *now[d, s]))
    return out, now


def test_ledger_of_a_table_and_of_a_stream(spark, tmp_path):
    events = step_events(240)
    flags, now = folded(events)
    df = spark.createDataFrame(events, EVENTS)
    pick = lambda rows: sorted((r.document_id, r.step, r.seq, r.status, r.legal, r.now, r.attempts) for r in rows)
    assert pick(D.flagged_events(df).collect()) == sorted(flags)
    rows = {(r.document_id, r.step): r for r in D.ledger(df).collect()}
    assert {k: (r.status or "", r.attempts) for k, r in rows.items()} == dict(now)
    assert sum(r.illegal for r in rows.values()) == sum(not f[4] for f in flags)
    assert all((r.finished is not None) == (r.status in D.DONE) for r in rows.values())
    for i in range(4):  # batches in time order
        spark.createDataFrame(events[60 * i : 60 * i + 60], EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = D.follow(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert pick(spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(flags)
    status = spark.createDataFrame([("a", "failed"), ("a", "running"), ("b", "running"), ("b", "completed"), ("c", None), ("d", "pending")], "document_id string, status string")
    assert dict(D.document_status(status).collect()) == {"a": "failed", "b": "running", "c": "ready", "d": "pending"}


def test_traces_equal_brute_force(spark):
    r = random.Random(2)
    spans = []
    for t in range(6):
        for i in range(r.randrange(1, 40)):
            a = r.randrange(50)
            spans.append((t, i, None if i == 0 else 99 if r.random() < 0.05 else r.randrange(i), float(a), float(a + r.randrange(12))))
    df = spark.createDataFrame(spans, "trace_id int, span_id int, parent_id int, start double, end double").repartition(3)
    got = {(g.trace_id, g.span_id): g for g in T.self_times(df).collect()}
    assert len(got) == len(spans)
    for t, i, _, a, b in spans:
        inside = [(max(a, x), min(b, y)) for tt, _, p, x, y in spans if tt == t and p == i]
        covered = sum(any(x <= k < y for x, y in inside) for k in range(int(a), int(b)))
        assert got[t, i].self_time == b - a - covered and got[t, i].children == len(inside)
    ids, want = {(t, i) for t, i, *_ in spans}, set()
    for t, i, p, *_ in spans:
        if p is None or (t, p) not in ids:
            at, depth = i, 0
            while at is not None:
                want.add((t, at, depth))
                at, depth = min(((-y, -x, j) for tt, j, q, x, y in spans if tt == t and q == at), default=(0, 0, None))[2], depth + 1
    assert {tuple(g) for g in T.critical_paths(df).select("trace_id", "span_id", "depth").collect()} == want
    assert T.summary(df).count() == 6 and T.critical_paths(df.limit(0)).count() == 0


def test_versions_are_seen_whole_and_kept(spark, tmp_path):
    path, table = str(tmp_path), lambda n: spark.range(n).toDF("x")
    assert versions.latest(spark, path) is None and versions.history(spark, path).count() == 0
    one = versions.publish(spark, path, {"a": table(1), "b": table(2)})
    pinned = one.table(spark, "a")
    table(9).write.parquet(f"{path}/tables/half-written/a")  # a writer that stopped before its marker
    assert versions.latest(spark, path) == one
    two = versions.publish(spark, path, {"a": table(3)}, base=one)
    assert (two.number, versions.latest(spark, path), versions.latest(spark, path, 1)) == (2, two, one)
    assert pinned.count() == 1 and one.table(spark, "b").count() == 2 and two.table(spark, "a").count() == 3
    with pytest.raises(KeyError):
        two.table(spark, "b")
    with pytest.raises(AnalysisException):  # another version was published since
        versions.publish(spark, path, {"a": table(4)}, base=one)
    three = versions.publish(spark, path, {"a": table(5)})
    assert versions.expire(spark, path, keep=2, grace_seconds=3600) == [] and versions.expire(spark, path, keep=2, grace_seconds=0) == [1]
    assert versions.latest(spark, path, 1) is None and versions.latest(spark, path) == three and two.table(spark, "a").count() == 3


def test_tables_of_a_scope_are_deleted(spark):
    from lodestone.sources.stored import scope, stored

    outside = stored(spark.range(3), "kept")
    with scope(spark):
        inside = stored(spark.range(5), "gone")
        with scope(spark):
            deeper = stored(inside, "gone")
            assert deeper.count() == 5
        with pytest.raises(Exception, match="(?i)not exist|FILE_NOT_EXIST"):
            deeper.collect()
        assert inside.count() == 5
    assert outside.count() == 3
    with pytest.raises(Exception, match="(?i)not exist|FILE_NOT_EXIST"):
        inside.collect()


def test_index_versions(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "d1", 1, "NEU-DET defects", "text"), (2, "d2", 1, "steel images", "text"), *((i, f"d{i}", 1, f"other words {i}", "text") for i in range(3, 9))], "chunk_id long, document_id string, ordinal int, content string, modality string")
    N.publish(N.build(chunks), str(tmp_path))
    old = N.at_version(spark, str(tmp_path))
    q = spark.createDataFrame([(1, "steel defects")], "query_id int, query string")
    N.publish(N.delete_documents(old, spark.createDataFrame([("d2",)], "document_id string")), str(tmp_path))
    hits = lambda i: {r.chunk_id for r in i.search(q, 5).collect()}
    assert hits(old) == {1, 2} and hits(N.at_version(spark, str(tmp_path))) == {1} and hits(N.at_version(spark, str(tmp_path), 1)) == {1, 2}
    again = N.at_version(spark, str(tmp_path))
    assert {tuple(r) for r in again.terms.collect()} == {tuple(r) for r in N.R.term_stats(again.posts).collect()}


def test_copy_levels_cycles_and_repeats(spark, tmp_path):
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "d"), ("e", "f"), ("f", "e"), ("g", "f"), ("x", "outside")], "child string, parent string")
    got = {r.name: (r.level, r.cyclic) for r in C.levels(spark, [*"abcdefg", "x"], links).collect()}
    assert got == {"a": (0, False), "d": (0, False), "x": (0, False), "b": (1, False), "c": (2, False), "e": (3, True), "f": (3, True), "g": (3, True)}
    assert C.levels(spark, [], links).count() == 0
    people, pets = spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string"), spark.createDataFrame([(7, 1), (8, 5), (9, None)], "id int, owner int")
    keys, foreign = {"people": ["id"], "pets": ["id"]}, [("pets", "people", {"owner": "id"})]
    for _ in range(2):
        report = {r.name: (r.level, r.rows, r.orphans) for r in C.copy_tables(spark, {"pets": pets, "people": people}, keys, foreign, str(tmp_path)).collect()}
        assert report == {"people": (0, 2, 0), "pets": (1, 3, 1)}
    C.copy_tables(spark, {"people": spark.createDataFrame([(2, "new"), (3, "z"), (3, "z")], "id int, name string"), "pets": pets.limit(0)}, keys, foreign, str(tmp_path))
    last = versions.latest(spark, str(tmp_path))
    assert last.number == 3 and sorted(last.table(spark, "people").collect()) == [(1, "x"), (2, "new"), (3, "z")] and last.table(spark, "pets").count() == 3


def test_objects(spark, tmp_path):
    path = f"{tmp_path}/store"
    good, bad = ["a", "dir/b.txt", "a b", "é/ü", "..a", "a..", "x/.hidden"], ["", "/a", "../a", "a/../b", "a//b", "a/", ".", "a/.", "a\\b", "c:x", "file:/etc", "a\nb", None, "x" * 1025]
    rows = spark.createDataFrame([(k, (k or "").encode() or None) for k in good + bad] + [("a", b"second")], "key string, content binary")
    assert B.listed(spark, path).count() == 0 and not any(r.exists for r in B.exists(spark, rows.select("key").limit(2), path).collect())
    assert sorted(r.key or "" for r in B.put(rows, path).collect()) == sorted(k or "" for k in bad)
    B.put(spark.createDataFrame([("a", b"new"), ("dir/b.txt", None)], "key string, content binary"), path)
    B.delete(spark.createDataFrame([("a b",), ("../a",)], "key string"), path)
    got = {r.key: (r.found, bytes(r.content) if r.content is not None else None) for r in B.get(spark, spark.createDataFrame([("a",), ("a",), ("a b",), ("dir/b.txt",), ("nope",)], "key string"), path).collect()}
    assert got == {"a": (True, b"new"), "a b": (False, None), "dir/b.txt": (True, b""), "nope": (False, None)}
    assert {r.key for r in B.listed(spark, path).collect()} == set(good) - {"a b"}
    B.put(spark.createDataFrame([("a b", b"back")], "key string, content binary"), path)
    assert {r.key: r.size for r in B.listed(spark, path).collect()}["a b"] == 4


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    kind = f"query_id long, question string, asked_at timestamp, answer string, status string, confidence double, strategies {LG.STRATEGY}, chunk_ids array<long>, scores array<double>, corrective_rounds int, latency_ms double"
    rows = [(i, "q" * 2000, None, "a", "completed", 0.5, [("naive", 1.0, 2, 0.9), ("graph", 2.0, 1, 0.4)] if i % 2 else None if i % 4 else [], list(range(40)), [0.123456] * 40, i % 3, 5.0) for i in range(12)]
    for i in range(3):
        spark.createDataFrame(rows[4 * i : 4 * i + 4], kind).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(kind).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for n in range(2):  # a new checkpoint: all batches come again
        LG.follow(stream, f"{tmp_path}/log", f"{tmp_path}/cp{n}", availableNow=True).awaitTermination()
        q, s = LG.read(spark, f"{tmp_path}/log", "queries"), LG.read(spark, f"{tmp_path}/log", "strategies")
        assert q.count() == 12 and q.select("batch").distinct().count() == 3 and {r.query_id for r in q.filter("corrective_triggered").collect()} == {i for i in range(12) if i % 3}
        assert sorted((r.query_id, r.strategy) for r in s.collect()) == sorted((i, x) for i in range(12) for x in (["naive", "graph"] if i % 2 else ["unknown"]))
    one = s.filter("query_id = 0").first()
    assert (len(one.effective_query), one.results_returned, one.top_score, one.mean_score, len(one.chunk_ids), one.scores[0]) == (1000, 40, 0.123456, 0.1235, 30, 0.1235)


SPANS = "document_id string, page int, block int, line int, span int, text string, size double, bold boolean, y0 double, y1 double"


def test_pages_headings_sections_and_titles(spark):
    long = "running text of a body paragraph that goes on and on until nobody could take it for a heading of anything at all, as it is far too long for that " * 2
    lines = [(1, "A Title of Some Length", 20.0, False), (1, long, 10.0, False), (1, "Abstract:", 10.0, False), (1, "1.2 Numbered", 10.0, True), (2, "Large heading", 12.0, False), (2, "bold line", 10.0, True), (2, long, 10.0, False), (3, "References", 9.0, False), (3, "two\nlines", 30.0, False)]
    spans = [("d", p, i, 0, 0, t, s, b, 0.0, 1.0) for i, (p, t, s, b) in enumerate(lines)] + [("d", 1, 1, 1, 0, "tail ", 10.0, False, 0.0, 1.0), ("d", 1, 1, 1, 1, "end", 10.0, False, 0.0, 1.0), ("e", 1, 0, 0, 0, "  ", 10.0, False, 0.0, 1.0), ("f", 5, 0, 0, 0, "late only", 14.6, False, 0.0, 1.0)]
    got = Y.text_blocks(spark.createDataFrame(spans, SPANS).repartition(3))
    rows = {(r.document_id, r.n): r for r in got.collect()}
    assert [rows["d", i].heading_level for i in range(1, 10)] == [1, None, 1, 2, 2, 2, None, 1, None]
    assert rows["d", 2].text.endswith("\ntail end") and rows["d", 4].section_path == ["Abstract:", "1.2 Numbered"] and rows["d", 7].section_path == ["Abstract:", "bold line"] and rows["d", 9].section_path == ["References"]
    assert rows["f", 1].heading_level == 1 and ("e", 1) not in rows  # without sizes on the first pages the body's is 10
    assert dict(Y.titles(got).collect()) == {"d": "A Title of Some Length"}


def test_nearest_captions_equal_greedy_matching(spark):
    r, left, right = random.Random(3), [], []
    for page in range(12):
        for side, n in ((left, r.randrange(6)), (right, r.randrange(6))):
            side += [("d", page, i + 1, float(y := r.randrange(0, 40, 4)), float(y + r.randrange(0, 9, 4))) for i in range(n)]
    kind = "document_id string, page int, nth int, y0 double, y1 double"
    got = {tuple(g) for g in Y.nearest_pairs(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind)).select("page", "nth", "other").collect()}
    want = set()
    for page in range(12):
        pairs = sorted((max(0.0, c[3] - f[4], f[3] - c[4]), f[2], c[2]) for f in left for c in right if f[1] == c[1] == page)
        taken = set()
        for _, f, c in pairs:
            if not {("f", f), ("c", c)} & taken:
                taken |= {("f", f), ("c", c)}
                want.add((page, f, c))
    assert got == want and len(want) > 15
    spans = [("d", 1, 0, 0, 0, "Figure 2. near the second", 10.0, False, 50.0, 52.0), ("d", 1, 1, 0, 0, "Fig. 1a near the first", 10.0, False, 12.0, 14.0)]
    images = spark.createDataFrame([("d", 1, 1, 9000, 100, 100, 0.0, 10.0), ("d", 1, 2, 9000, 100, 100, 40.0, 49.0), ("d", 1, 3, 100, 100, 100, 60.0, 61.0), ("d", 2, 1, 9000, 90, 90, 0.0, 1.0), ("d", 2, 2, 9000, 89, 90, 0.0, 1.0)], "document_id string, page int, nth int, size_bytes int, width int, height int, y0 double, y1 double")
    blocks = Y.text_blocks(spark.createDataFrame(spans, SPANS))
    labels = lambda near: {(g.page, g.nth): g.figure_label for g in Y.figures(images, blocks, near).collect()}
    assert labels(True) == {(1, 1): "Figure 1a", (1, 2): "Figure 2", (2, 1): None} and labels(False) == {(1, 1): "Figure 2", (1, 2): "Figure 1a", (2, 1): None}


def test_docx_files(spark):
    W = O._W[1:-1]
    merged = f'<w:document xmlns:w="{W}"><w:body><w:p><w:pPr><w:pStyle w:val="X"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>wide</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>tall</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc></w:tr></w:tbl><w:p><w:r><w:t>x</w:t><w:tab/><w:t>y</w:t><w:br/><w:t>z</w:t></w:r></w:p></w:body></w:document>'
    import io

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", merged)
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{W}"><w:style w:styleId="X"><w:name w:val="Title"/></w:style></w:styles>')
    paragraphs = [("", "before  any\theading"), ("heading 1", "One"), ("", "a & <b>"), ("", " "), ("", "second\nline"), ("Heading 3", "Deep"), ("heading", "Plain"), ("Heading 12", "Deepest"), ("", "end \x00é𝄞")]
    tables = [[["h", "i"], *[[str(i)] for i in range(70)]], [["only one row"]], [["", ""], ["p", ""], ["q", "r"]]]
    files = [("good", O.write_docx(paragraphs, tables)), ("odd", out.getvalue()), ("empty", O.write_docx([])), ("broken", b"not a zip"), ("null", None), ("other", (lambda b: (zipfile.ZipFile(b, "w").writestr("x", "y"), b.getvalue())[1])(io.BytesIO()))]
    parts = O.docx_parts(spark.createDataFrame(files, "document_id string, content binary")).cache()
    assert {r.document_id for r in O.failures(parts).collect()} == {"broken", "null", "other"}
    got = defaultdict(list)
    for r in O.docx_blocks(parts).orderBy("document_id", "block_order").collect():
        got[r.document_id].append((r.text, r.modality, r.section_path, r.heading_level, r.table_label))
    assert set(got) == {"good", "odd"}
    good = got["good"]
    assert good[:7] == [("before any heading", "text", [], None, None), ("One", "text", ["One"], 1, None), ("a & <b>\nsecond\nline", "text", ["One"], None, None), ("Deep", "text", ["One", "Deep"], 3, None), ("Plain", "text", ["Plain"], 1, None), ("Deepest", "text", ["Plain", "Deepest"], 9, None), ("end é𝄞", "text", ["Plain", "Deepest"], None, None)]
    assert [g[4] for g in good[7:]] == ["Table 1", "Table 3"] and len(good[7][0].split("\n")) == 62 and good[8][0] == "| p |  |\n| --- | --- |\n| q | r |" and good[7][2] == ["Plain", "Deepest"]
    assert [g[:4] for g in got["odd"]] == [("Top", "text", ["Top"], 1), ("x y\nz", "text", ["Top"], None), ("| wide | wide | tall |\n| --- | --- | --- |\n| a |  | tall |", "table", ["Top"], None)]


def test_image_blocks_describe_only_what_has_little_text(spark):
    images = spark.createDataFrame([("a.png", b"long"), ("b.png", b"short"), ("c.png", b"none"), ("d.png", b"unreadable")], "document_id string, content binary")

    def read(c):
        return c.map(lambda x: {b"long": "t" * 50, b"short": " few  words "}.get(bytes(x), ""))

    def describe(c):
        if any(bytes(x) == b"long" for x in c):
            raise AssertionError("an image with enough text was described")
        return c.map(lambda x: {b"short": "a chart", b"unreadable": "Unreadable image"}.get(bytes(x), ""))

    got = {r.document_id: (r.text, r.method, r.figure_label) for r in O.image_blocks(images, read, describe).collect()}
    none = "Image file '{}' with no readable text content."
    assert got == {"a.png": ("t" * 50, "text", "Figure 1"), "b.png": ("few words\n\na chart", "text+description", "Figure 1"), "c.png": (none.format("c.png"), "none", "Figure 1"), "d.png": (none.format("d.png"), "none", "Figure 1")}
    assert {r.method for r in O.image_blocks(images, read).collect()} == {"text", "none"}


def test_markdown_tables_are_bounded(spark):
    from lodestone.sources.parsers import table_markdown

    tables = [([[" ", None], ["a", "b"], [None, None], ["c"]],), ([["h"], ["", None]],), ([],), (None,), ([["h"], *[["x"]] * 80],)]
    df = spark.createDataFrame(tables, "t array<array<string>>")
    plain, named = zip(*((r.a, r.b) for r in df.select(table_markdown(F.col("t")).alias("a"), table_markdown(F.col("t"), name_columns=True).alias("b")).collect()), strict=True)
    assert named[0] == "| col1 | col2 |\n| --- | --- |\n| a | b |\n| c |  |" and plain[0].startswith("|  |  |") and plain[1:4] == (None, None, None)
    assert len(plain[4].split("\n")) == 62 and len(list(itertools.chain(named))) == 5
