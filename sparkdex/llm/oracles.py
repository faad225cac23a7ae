"""DuckDB SQL for the queries that SQL can express on whole tables."""

from .licenses import TEMPLATES

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT item, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS s FROM i WHERE len(w) > 0),
items AS (SELECT DISTINCT item, least(8, len(w)) AS k, array_to_string(w[s:s + 7], ' ') AS win FROM p),
sizes AS (SELECT DISTINCT k FROM items),
q AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d CROSS JOIN sizes WHERE len(w) >= k),
windows AS (SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS win FROM q),
hits AS (SELECT doc_id, s, k, item FROM windows JOIN items USING (k, win)),
spots AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS spot FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN spots ON spots.doc_id = d.doc_id LEFT JOIN found ON found.doc_id = d.doc_id
"""

OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS s FROM d WHERE len(w) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 2], ' ') AS sh FROM p),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(sh, chr(10) ORDER BY sh)) AS key FROM sh GROUP BY doc_id),
classes AS (SELECT key, n, min(doc_id) AS rep FROM sets GROUP BY key, n),
own AS (SELECT rep, sh, n FROM classes JOIN sh ON sh.doc_id = rep),
shared AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS common
  FROM own a JOIN own b ON a.sh = b.sh AND a.rep < b.rep AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n),
links AS (SELECT a, b FROM shared WHERE 100 * common >= 90 * (na + nb - common)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rep AS node, rep AS root FROM classes UNION SELECT ways.b, reach.root FROM reach JOIN ways ON ways.a = reach.node),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(sets.n, 0) AS n_shingles, coalesce(roots.root, d.doc_id) AS component_id
FROM d LEFT JOIN sets ON sets.doc_id = d.doc_id LEFT JOIN classes ON classes.key = sets.key AND classes.n = sets.n LEFT JOIN roots ON roots.node = classes.rep
"""


OP3 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, s, b[s:s + 49] AS win FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) AS s FROM d WHERE doc_id IS NOT NULL)),
first AS (SELECT win, min(doc_id) AS low FROM w GROUP BY win HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, s FROM w JOIN first USING (win) WHERE doc_id > low),
marked AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM marked),
span AS (SELECT doc_id, k, min(s) AS a, max(s) + 50 AS z FROM run GROUP BY doc_id, k),
gap AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS before FROM span),
cut AS (SELECT g.doc_id, sum(z - a) AS removed, count(*) AS n, max(z) AS last, string_agg(hex(b[before:a - 1]), '' ORDER BY a) AS kept
  FROM gap g JOIN d USING (doc_id) GROUP BY g.doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(CASE WHEN removed IS NULL THEN b ELSE unhex(concat(kept, hex(b[last:octet_length(b)]))) END) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def op2() -> str:
    """Each template's blocks, of its words and twice a quarter of them, as slices that are intersected with it."""
    rows = []
    for label, text, must in TEMPLATES:
        words = text.replace(".", " ").split()
        tokens, step = sorted(set(words)), (len(words) + 3) // 4
        rows.append(f"('{label}', {_list(tokens)}, {_list(must.split())}, {(4 * len(tokens) + 4) // 5}, {len(words) + 2 * step}, {step})")
    places = " UNION ALL ".join(
        f"SELECT doc_id, s, '{label}' AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM d WHERE list_has_all(w, {_list(x.split())})) WHERE w[s:s + {len(x.split()) - 1}] = {_list(x.split())}"
        for x, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
    )
    return f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
t(label, tokens, must, need, size, step) AS (VALUES {", ".join(rows)}),
blocks AS (SELECT doc_id, label, tokens, must, need, w[k * step + 1:k * step + size] AS block
  FROM (SELECT d.*, t.*, unnest(range(0, (len(w) + step - 1) // step)) AS k FROM d JOIN t ON list_has_all(d.w, t.must))),
found AS (SELECT doc_id, label, len(list_intersect(tokens, block)) / len(tokens) AS c FROM blocks
  WHERE list_has_all(block, must) AND len(list_intersect(tokens, block)) >= need),
places AS ({places}),
base AS (SELECT doc_id, count(*) AS n, min(s) - 1 AS a, max(s) - 1 AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id),
labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(c) AS c FROM (SELECT doc_id, label, c FROM found UNION ALL SELECT doc_id, label, 1.0 FROM places) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word,
       coalesce(base.labels, '') AS base_labels, coalesce(labels.labels, '') AS labels, CAST(coalesce(c, 0) AS DOUBLE) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN labels USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": op2(), "op3_substrings": OP3, "op8_decontaminate": OP8, "op10_jaccard_join": OP10}
