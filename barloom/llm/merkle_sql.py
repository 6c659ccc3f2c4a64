"""SQL twin of the Merkle manifest query: the levels of the tree written out."""

LEVELS = 9


def _level(k: int) -> str:
    """Nodes of level k with what stands beside them, and the nodes of the next level; ``t`` numbers trees."""
    beside = "PARTITION BY t, i // 3 ORDER BY i ROWS BETWEEN"
    return f"""s{k} AS (
  SELECT t, i, n, h, coalesce(string_agg(h, '') OVER ({beside} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
         coalesce(string_agg(h, '') OVER ({beside} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM l{k}
), l{k + 1} AS (
  SELECT t, i // 3 AS i, max(n + 2) // 3 AS n, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
  FROM l{k} GROUP BY t, i // 3
), f{k + 1} AS (
  SELECT doc_id, f{k}.t, f{k}.i // 3 AS i, leaf, proof || lft || rgt AS proof,
         CASE WHEN s{k}.n = 1 THEN folded ELSE sha256(lft || folded || rgt) END AS folded
  FROM f{k} JOIN s{k} ON f{k}.t = s{k}.t AND f{k}.i = s{k}.i
)"""


def _field(name: str, kind: str) -> str:
    value = name if kind == "text" else f"CAST({name} AS VARCHAR)"
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    others = [_field(c, k) for c, k in (("doc_id", "int"), ("source", "text"), ("lang", "text"), ("n_chars", "int"))]
    return f"sha256({' || '.join(others)} || coalesce(strlen({text}) || ':' || {text}, '-'))"


def _crc32(text: str) -> str:
    """Unsigned CRC of an ASCII text, a bit at a time."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    chars = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce({chars}, lambda a, b: list_reduce(range(8), lambda c, k: {step}, xor(a, b)), 4294967295), 4294967295)"


OP12_SQL = f"""
WITH x AS (
  SELECT *, CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS got FROM documents
), d AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) AS t, {_leaf("text")} AS leaf, {_leaf("got")} AS got_leaf FROM x
), o AS (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM d
), l0 AS (
  SELECT t, i, n, leaf AS h FROM o
), f0 AS (
  SELECT doc_id, t, i, leaf, '' AS proof, got_leaf AS folded FROM o
), {", ".join(_level(k) for k in range(LEVELS))},
l{LEVELS + 1} AS (
  SELECT 0 AS t, t - 1 AS i, count(*) OVER () AS n, h FROM l{LEVELS}
), f{LEVELS + 1} AS (
  SELECT doc_id, 0 AS t, t - 1 AS i, leaf, proof, folded FROM f{LEVELS}
), {", ".join(_level(k) for k in range(LEVELS + 1, 2 * LEVELS + 1))}
SELECT doc_id, leaf, l{LEVELS}.h AS subroot, (SELECT h FROM l{2 * LEVELS + 1}) AS root, sha256(proof) AS proof_sha256,
       folded AS folded_root, folded = (SELECT h FROM l{2 * LEVELS + 1}) AS verified
FROM f{2 * LEVELS + 1} JOIN d USING (doc_id, leaf) JOIN l{LEVELS} ON l{LEVELS}.t = d.t"""
