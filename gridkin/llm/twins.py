"""SQL twins of the queries of this package that are longer than a few lines."""

from __future__ import annotations

from gridkin.llm import filter_audit, personal_data

WORDS = r"[^\x20\x09-\x0D]+"

FILTER_AUDIT = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORDS}') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
said AS (
  SELECT doc_id AS id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
  FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(w) < 200)::INTEGER + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INTEGER
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INTEGER
    + 8 * regexp_matches(t, '[#$%&*|]')::INTEGER + 16 * coalesce(least < doc_id, false)::INTEGER AS bits
  FROM w LEFT JOIN said ON doc_id = id),
c AS (SELECT part, bits, good, toxic, count(*) AS n FROM f GROUP BY ALL),
l(x, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS b
  FROM l p, l q, l r, l s, l t WHERE p.b + q.b + r.b + s.b + t.b = 31 AND p.b | q.b | r.b | s.b | t.b = 31),
z AS (
  SELECT filter_order, step, b[step] AS bit, coalesce(list_sum(b[1:step - 1]), 0)::INTEGER AS gone
  FROM o, (SELECT unnest(range(1, {len(filter_audit.FILTERS) + 1}))::INTEGER AS step)),
a AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (bits & (gone | bit) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (bits & gone = 0 AND bits & bit <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (bits & gone <> 0 AND bits & bit <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (bits = bit), 0) AS unique_fails,
    coalesce(sum(n) FILTER (bits & gone = 0 AND bits & bit <> 0 AND good), 0) AS good_lost,
    coalesce(sum(n) FILTER (bits & gone = 0 AND bits & bit <> 0 AND toxic), 0) AS toxic_lost
  FROM c, z GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM a"""


def _assign(codebook: str) -> str:
    return f"""(
  SELECT rid, p.p, any_value(p.x) AS x, min(d * 64 + e) // 64 AS d, min(d * 64 + e) % 64 AS e
  FROM (SELECT rid, p.p, p.x, e, list_sum(list_transform(list_zip(p.x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM p JOIN {codebook} c ON p.p = c.p) p
  GROUP BY rid, p.p)"""


def _update(codebook: str, assigned: str) -> str:
    return f"""(
  SELECT c.p, c.e, coalesce(m.c, c.c) AS c
  FROM {codebook} c LEFT JOIN (
    SELECT p, e, list(floored ORDER BY j) AS c FROM (
      SELECT p, e, j, (sum(v) - (sum(v) % count(*) + count(*)) % count(*)) // count(*) AS floored
      FROM (SELECT p, e, unnest(x) AS v, unnest(range(len(x))) AS j FROM {assigned}) GROUP BY p, e, j)
    GROUP BY p, e) m ON c.p = m.p AND c.e = m.e)"""


VECTOR_CODES = f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
p AS MATERIALIZED (
  SELECT rid, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS x
  FROM k, (SELECT unnest(range(16)) AS p)),
s AS (SELECT rid, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM k QUALIFY e < 64),
c0 AS MATERIALIZED (SELECT p, e, x AS c FROM p JOIN s USING (rid)),
a0 AS MATERIALIZED {_assign("c0")},
c1 AS MATERIALIZED {_update("c0", "a0")},
a1 AS MATERIALIZED {_assign("c1")},
c2 AS MATERIALIZED {_update("c1", "a1")},
a2 AS MATERIALIZED {_assign("c2")},
r AS (
  SELECT rid, string_agg(lpad(to_hex(e), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY rid),
h AS (
  SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(c) AS v, unnest(range(len(c))) AS j FROM c2))
SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM k JOIN r USING (rid), h"""

# What the matches m of a piece-wise cut text look like; b and a are the pieces before and after.
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""len({_DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(string_split(reverse({_DIGITS}), ''),
  lambda c, i: CASE WHEN i % 2 = 1 THEN c::INTEGER ELSE (2 * c::INTEGER) // 10 + (2 * c::INTEGER) % 10 END)) % 10 = 0"""
_IP = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}\z"
_WHOLE = rf"NOT regexp_matches(b, '{personal_data._INSIDE_BEFORE}') AND NOT regexp_matches(a, '{personal_data._INSIDE_AFTER}')"
_LENGTH = (
    "CASE "
    + " ".join(
        f"WHEN m[1:2] IN ({', '.join(repr(c) for c in countries.split())}) THEN {n}"
        for n, countries in personal_data.ACCOUNT_LENGTHS.items()
    )
    + " END"
)
_UPTO = f"({_LENGTH} + CASE WHEN contains(m, ' ') THEN ({_LENGTH} - 1) // 4 ELSE 0 END)"
_CODE = f"replace(m[1:{_UPTO}], ' ', '')"
_VALUES = "lambda c: CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END"
_ACCOUNT = f"""coalesce({_LENGTH} IS NOT NULL AND length({_CODE}) = {_LENGTH}
  AND NOT regexp_matches((m || a[1:1])[{_UPTO} + 1:{_UPTO} + 1], '[A-Za-z0-9]') AND NOT regexp_matches(b, '[A-Za-z0-9]\\z')
  AND list_reduce(list_transform(string_split({_CODE}[5:] || {_CODE}[1:4], ''), {_VALUES}),
        lambda r, c: (CASE WHEN c > 9 THEN r * 100 + c ELSE r * 10 + c END) % 97) = 1, false)"""
# The plain patterns, without the marks that keep a backtracking engine fast.
_SQL_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", "length(m)"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", f"regexp_matches(m, '{_IP}')", "length(m)"),
    "card": (r"[0-9]([\x20-]?[0-9])+", _LUHN, "length(m)"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15", "length(m)"),
    "account": (
        r"[A-Z]{2}[0-9]{2}((\x20[A-Z0-9]{4}){2,7}(\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})", _ACCOUNT, _UPTO,
    ),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", rf"NOT regexp_matches(m, '^(000|666|9)|-00-|0000\z') AND {_WHOLE}", "length(m)"),
    "local_phone": (r"(\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}", _WHOLE, "length(m)"),
}


def _kind(number: int, name: str) -> str:
    pattern, check, length = _SQL_KINDS[name]
    kind = personal_data.KINDS[number]
    nearby = "lower(right(b, {0}) || ' ' || left(a, {1}))".format(personal_data.BEFORE, personal_data.AFTER)
    fall = f" - {personal_data.LOWER} * regexp_matches({nearby}, '{kind.not_near}')::INTEGER" if kind.not_near else ""
    score = f"round(greatest(0, least(1, {kind.weight} + {personal_data.RAISE} * regexp_matches({nearby}, '{kind.near}')::INTEGER{fall})), 2)::DOUBLE"
    least = 0 if number < personal_data.BASE else personal_data.FOUND
    return f"""
  SELECT rid, {number} AS kind, s AS start, s + {length} AS stop, {score} AS score FROM (
    SELECT rid, m[i] AS m, q[i] AS b, q[i + 1] AS a,
      length(q[i]) + coalesce(list_sum(list_transform(range(1, i), lambda k: length(q[k]) + length(m[k]))), 0) AS s
    FROM (SELECT rid, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS q FROM d)
      , unnest(range(1, len(m) + 1)) u(i))
  WHERE {check} AND {score} >= {least}"""


PERSONAL_DATA = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
x AS MATERIALIZED ({" UNION ALL ".join(_kind(i, n) for i, n in enumerate(personal_data.NAMES))}),
y AS (
  SELECT *, {personal_data.NAMES!r}[kind + 1] AS name FROM (SELECT * FROM x) z
  WHERE kind <= {personal_data.BASE} OR NOT EXISTS (
    SELECT 1 FROM x b WHERE b.rid = z.rid AND b.kind < {personal_data.BASE} AND b.start < z.stop AND z.start < b.stop)),
g AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip,
    count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone,
    string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) FILTER (kind < {personal_data.BASE}) AS base,
    string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) AS spans, min(score) AS least_score
  FROM y GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
  coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, least_score
FROM d LEFT JOIN g USING (rid)""".replace(repr(personal_data.NAMES), repr(list(personal_data.NAMES)))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Every pair of different sets that share a shingle, then everything that links reach.
JACCARD_JOIN = rf"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORDS}') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT rid, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s
  FROM w),
c AS MATERIALIZED (SELECT rid, doc_id, len(s) AS n, min(rid) OVER (PARTITION BY s) AS rep, s FROM s),
e AS MATERIALIZED (SELECT rid, n, unnest(s) AS g FROM c WHERE rid = rep),
i AS (
  SELECT a.rid AS x, b.rid AS y FROM e a JOIN e b ON a.g = b.g AND a.rid < b.rid
    AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
l AS MATERIALIZED (SELECT x, y FROM i UNION ALL SELECT y, x FROM i),
r AS (SELECT rid AS root, rid AS node FROM c WHERE rid = rep UNION SELECT r.root, l.y FROM r JOIN l ON l.x = r.node),
least_of AS (SELECT rep, min(doc_id) AS least FROM c GROUP BY 1),
m AS (SELECT root, min(least) AS least FROM r JOIN least_of ON rep = node GROUP BY 1)
SELECT doc_id, n AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE least END AS component_id
FROM c JOIN m ON root = rep"""


QUOTATION = r"""
WITH RECURSIVE m AS (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS raw FROM conversations),
q AS (SELECT conv_id, turn, min(raw) AS raw FROM m GROUP BY ALL),
mails AS (
  SELECT m.conv_id, m.turn, m.role, CASE m.turn % 3
      WHEN 0 THEN concat_ws(chr(10), '>> ' || replace(b.raw, chr(10), chr(10) || '>> '), '> ' || replace(a.raw, chr(10), chr(10) || '> '), m.raw)
      WHEN 1 THEN concat_ws(chr(10), '> ' || string_split(a.raw, chr(10))[1], m.raw, '> ' || string_split(a.raw, chr(10))[-1])
      ELSE concat_ws(chr(10), '> > ' || replace(b.raw, chr(10), chr(10) || '> > '), m.raw) END AS mail
  FROM m LEFT JOIN q a ON a.conv_id = m.conv_id AND a.turn = m.turn - 1 LEFT JOIN q b ON b.conv_id = m.conv_id AND b.turn = m.turn - 2),
lines AS (
  SELECT conv_id, turn, role, unnest(string_split(mail, chr(10))) AS line,
         generate_subscripts(string_split(mail, chr(10)), 1) AS i FROM mails),
bare AS (
  SELECT *, len(regexp_extract_all(regexp_extract(line, '^[ \t]*(?:>[ \t]?)+'), '>')) AS level,
         regexp_replace(line, '^[ \t]*(?:>[ \t]?)+', '') AS text FROM lines),
said AS (
  SELECT *, CASE WHEN regexp_matches(text, '^[^\n]{1,200} wrote:[ \t]*$') THEN ''
                 ELSE lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) END AS s FROM bare),
own AS (
  SELECT conv_id, turn, role, coalesce(trim(string_agg(line, chr(10) ORDER BY i) FILTER (level = 0
           AND NOT regexp_matches(line, '^[^\n]{1,200} wrote:[ \t]*$')), chr(32) || chr(9) || chr(13) || chr(10)), '') AS text
  FROM said GROUP BY ALL),
starts AS (
  SELECT *, (s <> '' AND coalesce(lag(s) OVER w = '' OR lag(level) OVER w <> level, true))::INTEGER AS fresh
  FROM said WINDOW w AS (PARTITION BY conv_id, turn, role ORDER BY i)),
runs AS (
  SELECT *, sum(fresh) OVER (PARTITION BY conv_id, turn, role ORDER BY i) AS passage FROM starts),
kept AS (SELECT * FROM runs WHERE s <> ''),
whole AS (
  SELECT conv_id, turn, role, level, passage, string_agg(s, ' ' ORDER BY i) AS s FROM kept GROUP BY ALL),
units AS (
  SELECT conv_id, turn, level, passage, true AS whole, s FROM whole
  UNION ALL SELECT conv_id, turn, level, passage, false, s FROM kept),
cited AS (
  SELECT u.conv_id, u.turn, u.level, u.passage, u.whole, u.s, max(h.turn) AS parent
  FROM units u JOIN (SELECT DISTINCT conv_id, turn, s FROM units WHERE level = 0) h
    ON u.conv_id = h.conv_id AND u.s = h.s AND h.turn < u.turn
  WHERE u.level > 0 GROUP BY ALL),
used AS (
  SELECT c.*, (SELECT count(*) FROM kept k WHERE k.conv_id = c.conv_id AND k.turn = c.turn AND k.level = c.level
                 AND k.passage = c.passage AND k.s = c.s) AS times
  FROM cited c WHERE whole OR NOT EXISTS (
    SELECT 1 FROM cited w WHERE w.whole AND w.conv_id = c.conv_id AND w.turn = c.turn AND w.level = c.level AND w.passage = c.passage)),
scored AS (
  SELECT conv_id, turn, level, parent, sum(length(s) * CASE WHEN whole THEN 1 ELSE times END) AS n FROM used GROUP BY ALL),
link AS (
  SELECT conv_id, turn, parent FROM scored
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, parent DESC) = 1),
t AS (SELECT own.*, link.parent FROM own LEFT JOIN link USING (conv_id, turn)),
chain AS (
  SELECT conv_id, turn, parent, turn AS root, 0::BIGINT AS depth FROM t WHERE parent IS NULL
  UNION
  SELECT t.conv_id, t.turn, t.parent, c.root, c.depth + 1 FROM t JOIN chain c ON t.conv_id = c.conv_id AND t.parent = c.turn)
SELECT t.conv_id, c.root, c.depth, t.turn, t.parent, t.role, md5(t.text) AS text_md5
FROM t JOIN (SELECT DISTINCT conv_id, turn, root, depth FROM chain) c ON t.conv_id = c.conv_id AND t.turn = c.turn"""
