"""DuckDB SQL of the newer operators, some of it repeated by level."""

from __future__ import annotations


def crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII text: a table-free fold over its characters, eight steps each."""
    bit = "CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
    byte = f"list_reduce(list_prepend(xor(c, ascii(ch)::BIGINT), range(8)), lambda v, i: {bit})"
    # The fold carries numbers, so characters come as numbers too.
    byte = byte.replace("ascii(ch)::BIGINT", "ch")
    codes = f"list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, ch: {byte}), 4294967295)"


def value(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


def levels(name: str, depth: int) -> str:
    """Common tables ``{name}1``.. over ``{name}0(g, r, d)``: nodes of the next level, and groups with one node as they are."""
    out = []
    for k in range(depth):
        out.append(f"""
{name}{k}n AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}{k}),
{name}{k + 1} AS (
  SELECT g, r // 8 AS r, sha256(string_agg(d, '' ORDER BY r)) AS d FROM {name}{k}n WHERE n > 1 GROUP BY g, r // 8
  UNION ALL SELECT g, r, d FROM {name}{k}n WHERE n = 1)""")
    return ",".join(out)


def climbs(name: str, tree: str, depth: int) -> str:
    """Common tables ``{name}1``.. over ``{name}0(id, g, r, proof, node)``: one level up the tree each."""
    out = []
    for k in range(depth):
        out.append(f"""
{name}{k}s AS (
  SELECT x.id, coalesce(string_agg(t.d, '' ORDER BY t.r) FILTER (WHERE t.r < x.r), '') AS low,
    coalesce(string_agg(t.d, '' ORDER BY t.r) FILTER (WHERE t.r > x.r), '') AS high, max(t.n) > 1 AS up
  FROM {name}{k} x JOIN {tree}{k}n t ON t.g = x.g AND t.r // 8 = x.r // 8 GROUP BY x.id),
{name}{k + 1} AS (
  SELECT x.id, g, CASE WHEN up THEN r // 8 ELSE r END AS r, proof || low || high AS proof,
    CASE WHEN up THEN sha256(low || node || high) ELSE node END AS node
  FROM {name}{k} x JOIN {name}{k}s s ON s.id = x.id)""")
    return ",".join(out)


def merkle(depth: int = 9, groups_depth: int = 4) -> str:
    leaf = "sha256({} || {})".format(" || ".join(value(c) for c in ("doc_id", "source", "lang", "n_chars")), "{}")
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS id, doc_id, dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS g,
    {leaf.format(value("text"))} AS leaf,
    CASE WHEN {crc32("doc_id::VARCHAR")} % 3 = 0 THEN {leaf.format(value(lowered))} END AS tampered FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM docs),
t0 AS (SELECT g, r, leaf AS d FROM placed),{levels("t", depth)},
subroots AS (SELECT g, d FROM t{depth}),
u0 AS (SELECT 0 AS g, g AS r, d FROM subroots),{levels("u", groups_depth)},
top AS (SELECT d AS root FROM u{groups_depth}),
x0 AS (SELECT id, g, r, '' AS proof, coalesce(tampered, leaf) AS node FROM placed),{climbs("x", "t", depth)},
y0 AS (SELECT id, 0 AS g, g AS r, proof, node FROM x{depth}),{climbs("y", "u", groups_depth)}
SELECT p.doc_id, p.leaf, s.d AS subroot, top.root, sha256(y.proof) AS proof_sha256, y.node AS folded_root, y.node = top.root AS verified
FROM placed p JOIN subroots s ON s.g = p.g JOIN y{groups_depth} y ON y.id = p.id CROSS JOIN top
"""


# Counts everything, where the operator counts what the frontier asks for.
PHRASES = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT d, lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
numbered AS (SELECT row_number() OVER () AS p, lang, list_filter(string_split_regex(piece, '[ \x09]+'), lambda w: w <> '') AS ws FROM pieces),
tokens AS (SELECT p, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM numbered WHERE len(ws) > 0),
runs AS (
  SELECT lang, w AS w1, lead(w, 1) OVER (PARTITION BY p ORDER BY pos) AS w2, lead(w, 2) OVER (PARTITION BY p ORDER BY pos) AS w3 FROM tokens),
totals AS (SELECT lang, count(*) AS n FROM runs GROUP BY lang),
one AS (SELECT lang, w1, count(*) AS a FROM runs GROUP BY ALL),
two AS (SELECT lang, w1, w2, count(*) AS a FROM runs WHERE w2 IS NOT NULL GROUP BY ALL),
three AS (SELECT lang, w1, w2, w3, count(*) AS a FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT t.lang, t.w1, t.w2, NULL AS w3, t.a, 1 AS k, x.a AS l, y.a AS r
  FROM two t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN one y ON y.lang = t.lang AND y.w1 = t.w2 WHERE t.a >= 10
  UNION ALL
  SELECT t.lang, t.w1, t.w2, t.w3, t.a, 1, x.a, y.a
  FROM three t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1, t.w2, t.w3, t.a, 2, x.a, y.a
  FROM three t JOIN two x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN one y ON y.lang = t.lang AND y.w1 = t.w3),
scored AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, w1, w2, w3 ORDER BY score, k) = 1),
longer AS (
  SELECT lang, w1, w2, max(a) AS a FROM (
    SELECT lang, w1, w2, a FROM three UNION ALL SELECT lang, w2, w3, a FROM three) GROUP BY ALL),
kept AS (
  SELECT s.lang, concat_ws(' ', s.w1, s.w2, s.w3) AS phrase, s.a, l, r, score
  FROM lowest s LEFT JOIN longer x ON s.w3 IS NULL AND x.lang = s.lang AND x.w1 = s.w1 AND x.w2 = s.w2
  WHERE x.a IS NULL OR 100 * x.a < 50 * s.a),
best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT b.lang, rank, phrase, a, l, r, n, score FROM best b JOIN totals t ON t.lang = b.lang WHERE rank <= 2000
"""
