"""DuckDB SQL for the queries that SQL can express."""

_LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

#: {docs}: a table with doc_id and text. Gives doc_id, n_words, n_hit, items.
DECONTAMINATION = (
    """
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(%(low_item)s, %(alnum)s) AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, list_slice(w, s + 1, s + least(10, len(w))) AS words FROM i, unnest(range(0, greatest(0, len(w) - 10) + 1)) AS r(s) WHERE len(w) > 0),
lens AS (SELECT DISTINCT len(words) AS n FROM win),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(%(low_doc)s, %(alnum)s) AS w FROM {docs}),
p AS (SELECT row, s, n, list_slice(w, s + 1, s + n) AS words FROM d, lens, unnest(range(0, len(w) - n + 1)) AS r(s) WHERE len(w) >= n),
m AS (SELECT row, s, n, item FROM p JOIN win USING (words)),
h AS (SELECT row, count(DISTINCT s + k) AS n_hit FROM (SELECT DISTINCT row, s, n FROM m), unnest(range(0, n)) AS r(k) GROUP BY row),
t AS (SELECT row, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM m GROUP BY row)
"""
    % {"low_item": _LOW.format("text"), "low_doc": _LOW.format("text"), "alnum": _ALNUM}
).strip()

#: {docs}: a table with doc_id, source and text; l has its solid lines, bad its boilerplate lines by source.
LINES = """
d0 AS (SELECT row_number() OVER () AS row, * FROM {docs}),
l AS (SELECT DISTINCT row, source, line FROM d0, unnest(string_split(text, chr(10))) AS r(line) WHERE trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
total AS (SELECT source, count(*) AS pages FROM d0 GROUP BY source),
bad AS (SELECT source, list(line) AS lines FROM (SELECT l.source, l.line FROM l JOIN total ON l.source IS NOT DISTINCT FROM total.source GROUP BY l.source, l.line, pages HAVING count(*) >= 3 AND count(*) > 0.1 * pages) GROUP BY source),
kept AS (SELECT d0.* EXCLUDE (text), string_split(text, chr(10)) AS a, CASE WHEN lines IS NULL THEN string_split(text, chr(10)) ELSE list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(lines, x)) END AS b FROM d0 LEFT JOIN bad ON d0.source IS NOT DISTINCT FROM bad.source)
""".strip()

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = lambda n_chars: "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"
#: crc32 of a short ASCII string, bit by bit.
_CRC32 = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda r, b: list_reduce(list_prepend(xor(r, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))))"
#: A binary Merkle tree over {rows} (grp, pos, n, h), as {name}_tree, and each row's fold and siblings, as {name}_path; k tells rows apart.
_TREE = """
{name}_tree(grp, lev, pos, n, h) AS (SELECT grp, 0, pos, n, leaf FROM {rows} UNION ALL SELECT grp, lev + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {name}_tree WHERE n > 1 GROUP BY grp, lev, pos // 2, n),
{name}_path(k, grp, lev, pos, n, fold, sibs) AS (SELECT k, grp, 0, pos, n, start, '' FROM {rows} UNION ALL
  SELECT f.k, f.grp, f.lev + 1, f.pos // 2, (f.n + 1) // 2, CASE WHEN s.h IS NULL THEN sha256(f.fold) WHEN f.pos % 2 = 1 THEN sha256(s.h || f.fold) ELSE sha256(f.fold || s.h) END, f.sibs || coalesce(s.h, '')
  FROM {name}_path f LEFT JOIN {name}_tree s ON s.grp = f.grp AND s.lev = f.lev AND s.pos = xor(f.pos, 1) WHERE f.n > 1)"""

ORACLES = {
    "op3_benchmark_decontamination": f"""WITH {DECONTAMINATION.format(docs="documents")}
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (row) LEFT JOIN t USING (row)""",
    "op9_line_dedup": f"""WITH {LINES.format(docs="documents")}
SELECT doc_id, source, CASE WHEN a IS NULL THEN NULL ELSE array_to_string(b, chr(10)) END AS text, CAST(coalesce(len(a), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(a) - len(b), 0) AS BIGINT) AS n_dropped
FROM kept""",
    "op11_merkle_manifest": f"""WITH RECURSIVE
d AS (SELECT row_number() OVER () AS k, coalesce('=' || lang, '') AS grp, doc_id, {_LEAF("n_chars")} AS leaf,
  CASE WHEN {_CRC32.format("CAST(doc_id AS VARCHAR)")} % 7 = 0 AND n_chars IS NOT NULL THEN {_LEAF("(n_chars + 1)")} END AS tampered FROM documents),
p AS (SELECT k, grp, doc_id, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n, leaf, coalesce(tampered, leaf) AS start FROM d),
{_TREE.format(name="a", rows="p").strip()},
s AS (SELECT grp AS k, '' AS grp, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos, count(*) OVER () AS n, h AS leaf, h AS start FROM a_tree WHERE n = 1),
{_TREE.format(name="b", rows="s").strip()},
r AS (SELECT h AS root FROM b_tree WHERE n = 1),
w(k, lev, pos, n, fold) AS (SELECT a_path.k, 0, s.pos, s.n, a_path.fold FROM a_path JOIN s ON s.k = a_path.grp WHERE a_path.n = 1 UNION ALL
  SELECT w.k, w.lev + 1, w.pos // 2, (w.n + 1) // 2, CASE WHEN x.h IS NULL THEN sha256(w.fold) WHEN w.pos % 2 = 1 THEN sha256(x.h || w.fold) ELSE sha256(w.fold || x.h) END
  FROM w LEFT JOIN b_tree x ON x.lev = w.lev AND x.pos = xor(w.pos, 1) WHERE w.n > 1)
SELECT p.doc_id, p.leaf, s.leaf AS subroot, root, sha256(a_path.sibs || b_path.sibs) AS proof_sha256, w.fold AS folded_root, w.fold = root AS verified
FROM p JOIN a_path ON a_path.k = p.k AND a_path.n = 1 JOIN s ON s.k = p.grp JOIN b_path ON b_path.k = p.grp AND b_path.n = 1 JOIN w ON w.k = p.k AND w.n = 1, r""",
    "op12_periodic_runs": f"""WITH
d0 AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w0, {_CRC32.format("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
d1 AS (SELECT *, CAST(len(w0) AS BIGINT) AS n, h // 10 AS g, (h // 10) % greatest(len(w0), 1) AS a FROM d0),
d2 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM d1),
d AS (SELECT k, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w0[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w0 END AS w FROM d2),
grams AS (SELECT k, n, i, list_slice(w, i + 1, i + 5) AS gram FROM d, unnest(range(0, greatest(n - 4, 0))) AS r(i)),
pairs AS (SELECT a.k, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.k = b.k AND a.gram = b.gram AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
isles AS (SELECT k, q, min(i) AS start, max(i) + 5 - min(i) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS isle FROM pairs) GROUP BY k, q, isle),
runs AS (SELECT k, start, length, min(q) AS period FROM isles WHERE length >= greatest(6, 4 * q) GROUP BY k, start, length),
text AS (SELECT k, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY k),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY k ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1),
gone AS (SELECT k, list(DISTINCT i) AS places FROM runs, unnest(range(start + period, start + length)) AS r(i) GROUP BY k),
kept AS (SELECT d.k, array_to_string(CASE WHEN places IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(places, j - 1)) END, ' ') AS text FROM d LEFT JOIN gone ON gone.k = d.k)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(kept.text) AS collapsed_sha256
FROM d JOIN kept ON kept.k = d.k LEFT JOIN text ON text.k = d.k LEFT JOIN best ON best.k = d.k""",
}
