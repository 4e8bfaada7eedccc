"""DuckDB twins of the corpus operators that SQL can express.

Each follows the operator's rule by other means: regular expressions and windows where
the operator works on bytes, a recursive query where it walks, a bitwise checksum.
"""

from __future__ import annotations

import math

from . import pii, quality_rules, sharding

_OP1 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT r, doc_id, i, s[i] AS line,
    translate(regexp_replace(s[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT r, doc_id, string_split(text, chr(10)) AS s FROM d))
),
k AS (SELECT key, max(doc_id) AS holder FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id <> k.holder AS gone FROM l LEFT JOIN k ON l.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""

_OP7 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(14 + length(regexp_replace(role, '[\\#<:]', '__', 'g')) + length(regexp_replace(text, '[\\#<]', '__', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def _op2() -> str:
    p = quality_rules.Params()
    rules, share = len(p.rules), p.alpha / len(p.rules)
    least = math.ceil(math.log(p.delta / rules) / math.log1p(-share))
    cells, last = quality_rules.CELLS, quality_rules.CELLS - 1
    without = lambda chars: f"length(text) - length(regexp_replace(text, '{chars}', '', 'g'))"
    values = ("n_symbols / greatest(n_words, 1)", "n_bangs / greatest(n_words, 1)", "n_dup_lines / greatest(n_lines, 1)", "n_upper / greatest(n_upper + n_lower, 1)")
    cell = ", ".join(f"CAST(least(trunc({v} / CAST({r.top} AS DOUBLE) * {cells}), {last}) AS INTEGER)" for v, r in zip(values, p.rules, strict=True))
    over = " OR ".join(f"cell[{i + 1}] >= coalesce(cutoffs[{i + 1}], {cells})" for i in range(rules))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, chr(1) || 'null') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines FROM d),
g AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
e AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1) GROUP BY r),
b AS (
  SELECT w.r, doc_id, stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {without('[#*$%&|<>]')} AS n_symbols,
    len(full_lines) - len(list_distinct(full_lines)) AS n_dup_lines, coalesce(e.n, 0) AS n_repeat_words, len(string_split(text, chr(10))) AS n_lines,
    {without('[!?]')} AS n_bangs, {without('[A-Z]')} AS n_upper, {without(r'[a-z\x{80}-\x{10FFFF}]')} AS n_lower
  FROM w LEFT JOIN e ON w.r = e.r
),
m AS (SELECT *, n_words < {p.min_words} OR 100 * n_repeat_words > {p.max_repeat_percent} * n_words AS base_failed, [{cell}] AS cell FROM b),
x AS (SELECT stratum, quality = 1 AS good, rule, cell[rule] AS cell FROM m JOIN labels ON m.doc_id = labels.doc_id, range(1, {rules + 1}) t(rule) WHERE quality IS NOT NULL AND NOT base_failed),
large AS (SELECT stratum, count(*) OVER () AS strata FROM x WHERE good AND rule = 1 GROUP BY stratum HAVING count(*) >= {least}),
tail AS (
  SELECT x.stratum, rule, c, any_value(strata) AS strata, count(*) FILTER (WHERE good) AS n, greatest(count(*) FILTER (WHERE NOT good), 1) AS n_bad,
    count(*) FILTER (WHERE good AND cell >= c) AS k, count(*) FILTER (WHERE NOT good AND cell >= c) AS bad
  FROM x JOIN large ON x.stratum = large.stratum, range(1, {cells}) s(c) GROUP BY x.stratum, rule, c
),
sure AS (
  SELECT *, bad / n_bad - {p.penalty} * k / n AS gain, bool_and(CASE WHEN k > {share!r} * n THEN false ELSE
    list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share!r}) + (n - i) * ln(1 - {share!r})))) <= {p.delta!r} / ({rules} * strata) END)
    OVER (PARTITION BY stratum, rule ORDER BY c DESC) AS certified
  FROM tail
),
best AS (SELECT *, max(gain) OVER (PARTITION BY stratum, rule) AS most FROM sure WHERE certified),
tied AS (SELECT stratum, rule, c, max(c) OVER (PARTITION BY stratum, rule) AS c0, row_number() OVER (PARTITION BY stratum, rule ORDER BY c DESC) AS nth FROM best WHERE most > 1e-12 AND gain >= most - 1e-12),
cut AS (SELECT stratum, rule, c0 - count(*) // 2 AS cutoff FROM tied WHERE c = c0 - nth + 1 GROUP BY stratum, rule, c0),
cuts AS (SELECT stratum, [{', '.join(f'max(cutoff) FILTER (WHERE rule = {i + 1})' for i in range(rules))}] AS cutoffs FROM cut GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({over}) AS kept FROM m LEFT JOIN cuts ON m.stratum = cuts.stratum
"""


def _op4(shards: int = 8, seed: int = 20240229) -> str:
    keys = ", ".join(f"({i}, CAST({m} AS BIGINT), CAST({c} AS BIGINT))" for i, (m, c) in enumerate(sharding.keys(seed)))
    noise = lambda x: f"(({x} % {sharding.PRIME} * m + c) % {sharding.PRIME})"
    added = lambda x: f"({noise(x)} * {noise(x)} + {noise(x)} * m) % {sharding.PRIME}"
    return rf"""
WITH RECURSIVE t AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)) AS v FROM range(256) r(i))),
h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (
  SELECT doc_id, length(h) // 2 + 1 AS size,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(list_filter(string_split(regexp_replace(h, '(..)', '\1 ', 'g'), ' '), lambda x: x <> ''), lambda x: CAST('0x' || x AS BIGINT))),
      lambda a, b: xor(a >> 8, t.t[CAST(xor(a, b) & 255 AS INTEGER) + 1])), 4294967295) AS text_crc32
  FROM h, t
),
n AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS row_number, count(*) OVER () AS n FROM s),
z AS (SELECT *, greatest(1, (n + a - 1) // a) AS b FROM (SELECT n, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS a FROM (SELECT any_value(n) AS n FROM n))),
k(i, m, c) AS (VALUES {keys}),
-- a number at n or above goes through the rounds again: it is its halves
f(row_number, l, r, i) AS (
  SELECT row_number, row_number % a, row_number // a, 0 FROM n, z
  UNION ALL
  SELECT row_number, CASE WHEN k.i % 2 = 0 THEN (l + {added('r')}) % a ELSE l END, CASE WHEN k.i % 2 = 1 THEN (r + {added('l')}) % b ELSE r END, f.i + 1
  FROM f JOIN k ON f.i % {sharding.ROUNDS} = k.i, z WHERE f.i = 0 OR f.i % {sharding.ROUNDS} <> 0 OR r * a + l >= z.n
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST((r * a + l) % {shards} AS INTEGER) AS shard, (r * a + l) // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard, n.row_number
FROM f JOIN n ON f.row_number = n.row_number, z WHERE f.i > 0 AND f.i % {sharding.ROUNDS} = 0 AND r * a + l < z.n
"""


#: Patterns that a regular expression without looks around can match; what they lack is checked after.
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}([A-Z0-9]{11,30}|( [A-Z0-9]{4}){2,7}( [A-Z0-9]{1,3})?)\b",
    "ssn": r"[0-9-]+",
    "secret": r"[A-Za-z0-9+/_-]+=*",
}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_TURNED = "(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4))"
_VALID = {
    "email": "true",
    "ip": "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS HUGEINT), 0) > 255)) = 0",
    "card": f"""length({_DIGITS}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i:
      CASE WHEN i % 2 = 1 THEN CAST({_DIGITS}[-i] AS INTEGER) ELSE 2 * CAST({_DIGITS}[-i] AS INTEGER) // 10 + 2 * CAST({_DIGITS}[-i] AS INTEGER) % 10 END)) % 10 = 0""",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
    "iban": f"""length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split({_TURNED}, ''), lambda x: ascii(x))),
      lambda a, x: CASE WHEN x >= 65 THEN (a * 100 + x - 55) % 97 ELSE (a * 10 + x - 48) % 97 END) = 1""",
    "ssn": "regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$')",
    "secret": f"""regexp_full_match(m, '[^=]+={{0,2}}') AND length(rtrim(m, '=')) BETWEEN 20 AND 512 AND coalesce(next, 'x') <> ''
      AND length({_DIGITS}) >= 4 AND length(regexp_replace(m, '[^A-Za-z]', '', 'g')) >= 4""",
}


def _op5(threshold: float = 0.5, window: int = 40) -> str:
    kinds = (*pii.BASE, *pii.MORE)
    # a word with no letter or digit beside it
    consumed = lambda x: x.replace(r"(?<![\p{L}\p{N}])", r"(^|[^\p{L}\p{N}])").replace(r"(?![\p{L}\p{N}])", r"([^\p{L}\p{N}]|$)").replace("(?:", "(")
    parts = []
    for i, kind in enumerate(kinds):
        base = i < len(pii.BASE)
        # an underscore would count as part of a word; nothing matches it
        text = "replace(text, '_', '~')" if kind.name == "iban" else "text"
        rated = f"{kind.prior} + CASE WHEN regexp_matches(near, '{consumed(kind.near)}') THEN 0.25 ELSE 0 END - CASE WHEN regexp_matches(near, '{consumed(kind.against)}') THEN 0.25 ELSE 0 END >= {threshold}"
        parts.append(rf"""
  SELECT r, {i} AS kind_no, '{kind.name}' AS kind, s, e FROM (
    SELECT *, lower(CASE WHEN length(b) > {window} THEN regexp_replace(b, '^([\p{{L}}\p{{N}}]+|.)', '') ELSE b END || chr(10) || CASE WHEN length(a) > {window} THEN regexp_replace(a, '([\p{{L}}\p{{N}}]+|.)$', '') ELSE a END) AS near
    FROM (SELECT *, right(substr(text, 1, s), {window + 1}) AS b, substr(text, e + 1, {window + 1}) AS a FROM (
      SELECT r, text, m, lead(g) OVER (PARTITION BY r ORDER BY i) AS next,
        CAST(sum(length(g)) OVER (PARTITION BY r ORDER BY i) + coalesce(sum(length(m)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s, s + length(m) AS e
      FROM (SELECT r, text, i, ms[i] AS m, gs[i] AS g FROM (SELECT r, text, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
        SELECT r, text, regexp_extract_all({text}, '{_PLAIN[kind.name]}') AS ms, string_split_regex({text}, '{_PLAIN[kind.name]}') AS gs FROM d)))) WHERE {_VALID[kind.name]}))
  WHERE {'true' if base else rated}""")
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k.name}') AS n_{k.name}" for k in pii.BASE)
    own = "kind || ':' || s || ':' || e"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({' UNION ALL '.join(parts)})
SELECT any_value(doc_id) AS doc_id, {counts}, sha256(coalesce(string_agg({own}, ',' ORDER BY s, kind_no) FILTER (WHERE kind_no < {len(pii.BASE)}), '')) AS base_sha256, coalesce(string_agg({own}, ',' ORDER BY s, kind_no), '') AS spans, count(kind) AS n_spans
FROM d LEFT JOIN f ON d.r = f.r GROUP BY d.r
"""


def sql() -> dict[str, str]:
    return {"op1_line_dedup": _OP1, "op2_quality_rules": _op2(), "op4_feistel_sharding": _op4(), "op5_pii": _op5(), "op7_prefix_target": _OP7}
