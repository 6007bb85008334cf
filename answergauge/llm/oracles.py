"""SQL that the corpus queries have to equal, where SQL can say it."""

from __future__ import annotations

# crc32 of an ASCII text, bit by bit; 3988292384 is its reversed polynomial
_CRC = """xor(list_reduce(list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT),
  lambda c, b: list_reduce(range(0, 8),
    lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)),
  4294967295::BIGINT), 4294967295)"""


def _framed(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_framed, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


def _tree(name: str, nodes: str) -> str:
    """All nodes (grp, lvl, pos, n, h) of the trees over ``nodes`` (grp, pos, n, h), and each node's siblings."""
    return f"""{name} AS (
  SELECT grp, 0 AS lvl, pos, n, h FROM {nodes}
  UNION ALL
  SELECT grp, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1
  GROUP BY grp, lvl, pos // 3, n),
{name}_near AS (
  SELECT a.grp, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM {name} a JOIN {name} b ON a.grp = b.grp AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3
  WHERE a.n > 1 GROUP BY ALL)"""


MERKLE = f"""WITH RECURSIVE docs AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS grp, {_leaf('text')} AS h,
    CASE WHEN {_CRC.format('doc_id::VARCHAR')} & 1 = 0 THEN {_leaf("replace(text, chr(10), '')")}
         ELSE {_leaf('text')} END AS tampered
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id, h) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n
  FROM docs),
{_tree('low', 'leaves')},
tops AS (SELECT '' AS grp, grp AS src, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n, h
  FROM low WHERE n = 1),
{_tree('high', 'tops')},
walk AS (
  SELECT doc_id, grp, h AS leaf, 0 AS lvl, pos, tampered AS cur, '' AS proof FROM leaves
  UNION ALL
  SELECT doc_id, grp, leaf, lvl + 1, pos // 3, sha256(l || cur || r), proof || l || r
  FROM walk JOIN low_near USING (grp, lvl, pos)),
inner_end AS (SELECT * FROM walk QUALIFY lvl = max(lvl) OVER (PARTITION BY doc_id, leaf)),
onward AS (
  SELECT w.doc_id, w.grp AS src, w.leaf, t.h AS subroot, '' AS grp, 0 AS lvl, t.pos, w.cur, w.proof
  FROM inner_end w JOIN tops t ON t.src = w.grp
  UNION ALL
  SELECT doc_id, src, leaf, subroot, grp, lvl + 1, pos // 3, sha256(l || cur || r), proof || l || r
  FROM onward JOIN high_near USING (grp, lvl, pos)),
outer_end AS (SELECT * FROM onward QUALIFY lvl = max(lvl) OVER (PARTITION BY doc_id, leaf)),
top AS (SELECT h AS root FROM high WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM outer_end, top"""


def _hash(i: int) -> str:
    return f"('0x' || substr(digest, {8 * i + 1}, 8))::BIGINT"


FILL_MIDDLE = f"""WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS digest
  FROM documents),
drawn AS (
  SELECT *, {_hash(0)} % (n + 1) AS x, {_hash(1)} % (n + 1) AS y,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
           OR {_hash(2)} % 100 >= 90 THEN 'plain'
         WHEN {_hash(3)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed),
parts AS (
  SELECT *, least(x, y) AS a, greatest(x, y) - least(x, y) AS b, text[1:least(x, y)] AS p,
    text[least(x, y) + 1:greatest(x, y)] AS m, text[greatest(x, y) + 1:] AS s
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
         ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts"""
