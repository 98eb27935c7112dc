"""Longer SQL counterparts of corpus queries."""

from __future__ import annotations


def _field(name: str) -> str:
    return f"coalesce(octet_length(encode(CAST({name} AS VARCHAR))) || ':' || CAST({name} AS VARCHAR), '-')"


def _power(level: str) -> str:
    return f"CAST(8 ** ({level}) AS BIGINT)"


MERKLE = f"""
WITH RECURSIVE crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
docs AS (
    SELECT row_number() OVER () AS r, doc_id, lang, concat_ws('', {_field("doc_id")}, {_field("source")}, {_field("lang")}, {_field("n_chars")}) AS head, text,
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
        xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 3 = 0 AS tampered
    FROM documents, crc),
hashed AS (
    SELECT r, doc_id, lang, sha256(head || {_field("text")}) AS leaf,
        CASE WHEN tampered THEN sha256(head || {_field("lowered")}) END AS altered
    FROM docs),
leaves AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM hashed),
nodes AS (
    SELECT lang, 0 AS lvl, place AS i, leaf AS node, n FROM leaves
    UNION ALL
    SELECT lang, lvl + 1, i // 8, sha256(string_agg(node, '' ORDER BY i)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY lang, lvl, i // 8, n),
subroots AS (SELECT lang, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
over AS (
    SELECT 0 AS lvl, place AS i, node, n FROM subroots
    UNION ALL
    SELECT lvl + 1, i // 8, sha256(string_agg(node, '' ORDER BY i)), (n + 7) // 8 FROM over WHERE n > 1 GROUP BY lvl, i // 8, n),
low AS (
    SELECT l.r, x.lvl AS step, coalesce(string_agg(x.node, '' ORDER BY x.i) FILTER (WHERE x.i < l.place // {_power("x.lvl")}), '') AS lft,
        coalesce(string_agg(x.node, '' ORDER BY x.i) FILTER (WHERE x.i > l.place // {_power("x.lvl")}), '') AS rgt
    FROM leaves l JOIN nodes x ON x.lang IS NOT DISTINCT FROM l.lang AND x.n > 1 AND x.i // 8 = l.place // {_power("x.lvl + 1")} GROUP BY l.r, x.lvl),
high AS (
    SELECT l.r, 100 + x.lvl AS step, coalesce(string_agg(x.node, '' ORDER BY x.i) FILTER (WHERE x.i < s.place // {_power("x.lvl")}), '') AS lft,
        coalesce(string_agg(x.node, '' ORDER BY x.i) FILTER (WHERE x.i > s.place // {_power("x.lvl")}), '') AS rgt
    FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN over x ON x.n > 1 AND x.i // 8 = s.place // {_power("x.lvl + 1")} GROUP BY l.r, x.lvl),
steps AS (SELECT r, lft, rgt, row_number() OVER (PARTITION BY r ORDER BY step) AS k, step FROM (SELECT * FROM low UNION ALL SELECT * FROM high)),
fold AS (
    SELECT r, CAST(0 AS BIGINT) AS k, coalesce(altered, leaf) AS node FROM leaves
    UNION ALL
    SELECT f.r, s.k, sha256(s.lft || f.node || s.rgt) FROM fold f JOIN steps s ON s.r = f.r AND s.k = f.k + 1),
ends AS (SELECT r, arg_max(node, k) AS folded_root FROM fold GROUP BY r),
proofs AS (SELECT r, string_agg(lft || rgt, '' ORDER BY k) AS proof FROM steps GROUP BY r)
SELECT l.doc_id, l.leaf, s.node AS subroot, o.node AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, e.folded_root, e.folded_root = o.node AS verified
FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN over o ON o.n = 1 JOIN ends e ON e.r = l.r LEFT JOIN proofs p ON p.r = l.r
"""


def _beta_fraction(x: str, a: str, b: str) -> str:
    m = "floor(k / 2)"
    even = f"{m} * ({b} - {m}) * {x} / (({a} + 2 * {m} - 1) * ({a} + 2 * {m}))"
    odd = f"-({a} + {m}) * ({a} + {b} + {m}) * {x} / (({a} + 2 * {m}) * ({a} + 2 * {m} + 1))"
    terms = f"CAST(list_reverse(range(1, 101 + CAST(floor(10 * sqrt(greatest({a}, {b}))) AS BIGINT))) AS DOUBLE[])"
    rest = f"list_reduce({terms}, lambda rest, k: CASE WHEN k % 2 = 0 THEN {even} ELSE {odd} END / (1 + rest), CAST(0 AS DOUBLE))"
    return f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({x}) + {b} * ln(1 - {x})) / {a} / (1 + {rest})"


def _level(name: str, above: str, key: str, columns: str) -> str:
    """CTEs: the rows of `name` with their prior's rate, its weight and their own rate."""
    return f"""
{name}_known AS (SELECT c.*, a.rate AS prior_rate FROM {name} c JOIN {above} a USING ({key})),
{name}_sums AS (
    SELECT sum(n * (bad / n - prior_rate) ** 2) - sum(prior_rate * (1 - prior_rate)) AS more, sum(prior_rate * (1 - prior_rate) * (n - 1)) AS together
    FROM {name}_known WHERE n > 0),
{name}_weight AS (
    SELECT CASE WHEN coalesce(together, 0) = 0 THEN 1 WHEN more / together > 0 THEN least(greatest(together / more - 1, 1), 10000) ELSE 10000 END AS weight
    FROM {name}_sums),
{name}_rates AS (SELECT {columns}, n, bad, prior_rate, weight, (bad + prior_rate * weight) / (n + weight) AS rate FROM {name}_known, {name}_weight)"""


REPUTATION = rf"""
WITH rests AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM rests),
shown AS (SELECT DISTINCT host, TRY_CAST(regexp_extract(path, '^/[a-z]+/([0-9]+)', 1) AS BIGINT) AS doc_id FROM parts),
marked AS (SELECT doc_id, max(CAST(coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 AS INT)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
counts AS (
    SELECT host, CAST(count(m.bad) AS DOUBLE) AS n, CAST(coalesce(sum(m.bad), 0) AS DOUBLE) AS bad, string_split(host, '.') AS labels
    FROM shown LEFT JOIN marked m USING (doc_id) GROUP BY host),
ends AS (
    SELECT *, array_to_string(list_slice(labels, greatest(len(labels) - 2, 1), len(labels)), '.') AS three,
        array_to_string(list_slice(labels, greatest(len(labels) - 1, 1), len(labels)), '.') AS two FROM counts),
hosts AS (
    SELECT host, n, bad, CASE WHEN two IN ({{suffixes}}) THEN three ELSE two END AS domain, CASE WHEN two IN ({{suffixes}}) THEN two ELSE labels[-1] END AS suffix
    FROM ends),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
tops AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, TRUE AS every FROM domains GROUP BY suffix),
whole AS (SELECT every, (sum(bad) + 1) / (sum(n) + 2) AS rate FROM tops GROUP BY every),{_level("tops", "whole", "every", "suffix")},{_level("domains", "tops_rates", "suffix", "domain")},{_level("hosts", "domains_rates", "domain", "host")},
posteriors AS (SELECT host, CAST(0.5 AS DOUBLE) AS x, bad + prior_rate * weight AS a, n - bad + (1 - prior_rate) * weight AS b FROM hosts_rates),
reputations AS (
    SELECT host, 1 - CASE WHEN x < (a + 1) / (a + b + 2) THEN {_beta_fraction("x", "a", "b")} ELSE 1 - ({_beta_fraction("(1 - x)", "b", "a")}) END AS beyond FROM posteriors),
rules(place, verdict, host, path) AS (VALUES {{rules}}),
fits AS (
    SELECT page_id, arg_max(r.host || r.path, (length(r.host || r.path), -place)) AS rule, arg_max(verdict, (length(r.host || r.path), -place)) AS verdict
    FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, CASE WHEN beyond >= 0.95 THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p JOIN reputations USING (host) LEFT JOIN fits f USING (page_id)
"""
