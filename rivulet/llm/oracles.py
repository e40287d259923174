"""SQL for the registered queries that SQL can express; DuckDB runs it on the same tables.

Each text goes its own way: the secret scan joins all spans of a document, the
edit matching fills the whole table of distances around exact hits, the search
compares every query with every row, and the fingerprints are linked pair by
pair.  The other queries learn a model, use a tokenizer's vocabulary or read
markup, and are held against brute force in the tests.
"""

from __future__ import annotations


def _either(pattern: str) -> str:
    """The pattern with every letter outside brackets in either case, ASCII only."""
    out, depth = [], 0
    for c in pattern:
        depth += (c == "[") - (c == "]")
        out.append(f"[{c.lower()}{c.upper()}]" if c.isalpha() and not depth else c)
    return "".join(out)


_SIGN = r"""["']?[ ]*[:=][ ]*["']?"""
_SCANS = (
    ("assign", "(" + _either("password|passwd|secret|token|api_?key") + ")" + _SIGN + "([A-Za-z0-9+/_.=-]+)", False),
    ("access", "AKIA[A-Z0-9]{16,}", False),
    ("hex", "[0-9a-f]{24,}", False),
    ("opaque", "[A-Za-z0-9+/]{20,}", False),
    ("user", "(?:" + _either("user(?:_?name)?|login|account|client_?id|access_?key_?id") + ")" + _SIGN + "[A-Za-z0-9@._+-]{3,}", True),
    (
        "endpoint",
        "(?:" + _either("https?|ftp|sftp|ssh|s3|jdbc:[A-Za-z]+|postgres(?:ql)?|mysql|mongodb(?:[+]srv)?|redis|amqps?") + ")"
        "://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+",
        True,
    ),
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets() -> str:
    cuts = []
    for k, (_, pattern, word_start) in enumerate(_SCANS):
        # no look-behind here: the character before is taken along and put back
        whole, instead = (f"(^|[^A-Za-z0-9_])({pattern})", "'\\1' || chr(1) || '\\2' || chr(1)") if word_start else (pattern, "chr(1) || '\\0' || chr(1)")
        cuts.append(f"SELECT r, {k} AS k, string_split(regexp_replace(t, {_quoted(whole)}, {instead}, 'g'), chr(1)) AS p FROM d")
    names = "[" + ", ".join(_quoted(name) for name, _, _ in _SCANS) + "]"
    listed = f"string_agg({names}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
cut AS ({" UNION ALL ".join(cuts)}),
piece AS (SELECT r, k, unnest(p) AS x, generate_subscripts(p, 1) AS n FROM cut WHERE len(p) > 1),
placed AS (SELECT r, k, n, x, CAST(sum(length(x)) OVER (PARTITION BY r, k ORDER BY n) AS BIGINT) AS e FROM piece),
span AS (
  SELECT r, k, e - length(x) AS s, e FROM placed WHERE n % 2 = 0 AND CASE k
    WHEN 0 THEN length(regexp_extract(x, {_quoted(_SCANS[0][1])}, 2)) >= 6
    WHEN 3 THEN regexp_matches(x, '[a-z]') AND regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[0-9]') ELSE true END),
met AS (
  SELECT w.r, w.k, w.s, w.e, bool_or(o.k IN (0, 2, 3)) AS secret, bool_or(o.k IN (1, 4)) AS identifier, bool_or(o.k = 5) AS endpoint
  FROM span w JOIN span o ON w.r = o.r AND o.s <= w.e + 200 AND o.e >= w.s - 200 AND (o.s <> w.s OR o.e <> w.e)
  WHERE w.k >= 3 GROUP BY w.r, w.k, w.s, w.e),
kept AS (
  SELECT r, k, s, e FROM span WHERE k < 3 UNION ALL
  SELECT r, k, s, e FROM met WHERE CASE k WHEN 3 THEN identifier OR endpoint WHEN 4 THEN secret ELSE secret AND identifier END),
summed AS (
  SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    {listed.replace("ORDER BY s, k, e)", "ORDER BY s, k, e) FILTER (k < 3)")} AS base, {listed} AS spans
  FROM kept GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN summed USING (r)"""


_EDITS = r"""
WITH RECURSIVE
item AS (
  SELECT *, length(x) AS m, CAST(floor(length(x) * 0.05::DOUBLE) AS INTEGER) AS k, string_split(x, '') AS letters FROM (
    SELECT row_number() OVER () AS i, item_id, array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), ' ') AS x
    FROM benchmark) WHERE x <> ''),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), ' ') AS t
  FROM documents),
piece AS (
  SELECT i, m, k, m * n // (k + 1) AS a, substr(x, m * n // (k + 1) + 1, m * (n + 1) // (k + 1) - m * n // (k + 1)) AS run
  FROM (SELECT *, unnest(range(0, k + 1)) AS n FROM item)),
hit AS (SELECT r, t, i, m, k, a, run, string_split(t, run) AS parts FROM doc JOIN piece ON contains(t, run)),
place AS (
  SELECT r, t, i, m, k, a, run, n,
    CAST(sum(length(part)) OVER (PARTITION BY r, i, a ORDER BY n) AS BIGINT) + (n - 1) * length(run) AS pos
  FROM (SELECT *, unnest(parts) AS part, generate_subscripts(parts, 1) AS n FROM hit)),
-- a hit that overlaps one of these begins before its end, so the stretch is longer by a run
stretch AS MATERIALIZED (
  SELECT row_number() OVER () AS n, r, i, m, k, lo, letters, string_split(substr(t, lo + 1, hi - lo), '') AS s FROM (
    SELECT DISTINCT r, t, i, greatest(0, pos - a - k) AS lo, least(length(t), pos - a + m + k + m // (k + 1) + 1) AS hi
    FROM place JOIN (SELECT r, i, a, max(n) AS last FROM place GROUP BY r, i, a) USING (r, i, a) WHERE n < last)
  JOIN item USING (i)),
-- the table of distances, one column for each letter of the stretch; values above k + 1 count as k + 1
step AS (
  SELECT n, 0 AS pos, [least(v, k + 1) FOR v IN range(1, m + 1)] AS c, k + 1 AS d FROM stretch
  UNION ALL
  SELECT n, pos + 1, list_transform(range(1, m + 1), lambda j: least(k + 1, j, j + list_min(list_slice(x, greatest(1, j - k), j)))) AS c,
    least(k + 1, m, m + list_min(list_slice(x, greatest(1, m - k), m)))
  FROM (
    SELECT n, pos, m, k, list_transform(range(1, m + 1), lambda h: least(c[h] + 1, CASE WHEN h = 1 THEN 0 ELSE c[h - 1] END
      + CASE WHEN letters[h] = s[pos + 1] THEN 0 ELSE 1 END) - h) AS x
    FROM step JOIN stretch USING (n) WHERE pos < len(s))),
best AS (SELECT r, i, min({'d': CAST(d AS INTEGER), 'e': lo + pos}) AS b FROM step JOIN stretch USING (n) WHERE d <= k GROUP BY r, i)
SELECT doc_id, item_id, b.d AS distance, k AS budget, b.e AS "end" FROM best JOIN doc USING (r) JOIN item USING (i)"""

_SEARCH = """
WITH v AS (
  SELECT vec_id AS id, min(x) AS v FROM (SELECT vec_id, [CAST(c AS DOUBLE) FOR c IN embedding] AS x FROM embeddings)
  WHERE vec_id IS NOT NULL AND len([c FOR c IN x IF c IS NULL OR isnan(c) OR isinf(c)]) = 0 AND len([c FOR c IN x IF c <> 0]) > 0
  GROUP BY vec_id),
u AS (SELECT * FROM v WHERE len(v) = (SELECT len(v) FROM v GROUP BY len(v) ORDER BY count(*) DESC, len(v) LIMIT 1)),
pair AS (
  SELECT q.id AS query_id, w.id AS vec_id, list_sum([q.v[i] * w.v[i] FOR i IN range(1, len(q.v) + 1)]) AS score
  FROM u q JOIN u w ON q.id <> w.id WHERE q.id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pair QUALIFY rank <= 20"""

# the five primes of XXH64
_P1, _P2, _P3, _P4, _P5 = (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261,
)
_SEED, _WORD = 42, 1 << 64


def _times(a: str, b: int) -> str:
    return f"(({a}) * {b}::UHUGEINT % {_WORD}::UHUGEINT)"


def _plus(*terms: str | int) -> str:
    return "((" + " + ".join(f"{t}::UHUGEINT" if isinstance(t, int) else t for t in terms) + f") % {_WORD}::UHUGEINT)"


def _turn(a: str, by: int, name: str) -> str:
    """``a`` turned left; ``name``: a variable of its own, so that ``a`` stands here once."""
    big = f"{name} * {1 << by}::UHUGEINT"
    return f"list_transform([{a}], lambda {name}: ({big}) % {_WORD}::UHUGEINT + (({big}) >> 64))[1]"


def _lane(size: int, at: str) -> str:
    """The little-endian number in ``size`` bytes from place ``at`` (from 0) of the list b."""
    return "(" + " + ".join(f"b[{at} + {i + 1}]::UHUGEINT * {1 << 8 * i}::UHUGEINT" for i in range(size)) + ")"


def _round(acc: str, lane: str, name: str) -> str:
    return _times(_turn(_plus(acc, _times(lane, _P2)), 31, name), _P1)


def _fingerprints() -> str:
    lanes = [
        f"list_reduce(list_prepend({start}::UHUGEINT, [{_lane(8, f'g * 32 + {8 * i}')} FOR g IN range(0, n // 32)]), lambda a, l: {_round('a', 'l', 'y')}) AS v{i}"
        for i, start in enumerate(((_SEED + _P1 + _P2) % _WORD, (_SEED + _P2) % _WORD, _SEED, (_SEED - _P1) % _WORD))
    ]
    merged = _plus(*(_turn(f"v{i}", by, f"t{i}") for i, by in enumerate((1, 7, 12, 18))))
    steps = ["SELECT s, b, n, " + ", ".join(lanes) + " FROM bytes", f"SELECT *, {merged} AS h FROM x0"]
    for i in range(4):
        steps.append(f"SELECT * REPLACE ({_plus(_times(f'xor(h, {_round("0::UHUGEINT", f"v{i}", "y")})', _P1), _P4)} AS h) FROM x{len(steps) - 1}")
    steps.append(f"SELECT s, b, n, n // 32 * 32 AS z, {_plus(f'CASE WHEN n < 32 THEN {_SEED + _P5}::UHUGEINT ELSE h END', 'n::UHUGEINT')} AS h FROM x{len(steps) - 1}")
    eight = f"xor(a, {_round('0::UHUGEINT', 'l', 'y')})"
    eights = f"[{_lane(8, 'z + g * 8')} FOR g IN range(0, (n - z) // 8)]"
    steps.append(
        f"SELECT * REPLACE (list_reduce(list_prepend(h, {eights}), lambda a, l: {_plus(_times(_turn(eight, 27, 'w'), _P1), _P4)}) AS h, "
        f"z + (n - z) // 8 * 8 AS z) FROM x{len(steps) - 1}"
    )
    four = _plus(_times(_turn(f"xor(h, {_times(_lane(4, 'z'), _P1)})", 23, "w"), _P2), _P3)
    steps.append(f"SELECT * REPLACE (CASE WHEN n - z >= 4 THEN {four} ELSE h END AS h, CASE WHEN n - z >= 4 THEN z + 4 ELSE z END AS z) FROM x{len(steps) - 1}")
    one = _times(_turn(f"xor(a, {_times('l', _P5)})", 11, "w"), _P1)
    steps.append(f"SELECT * REPLACE (list_reduce(list_prepend(h, [b[z + g]::UHUGEINT FOR g IN range(1, n - z + 1)]), lambda a, l: {one}) AS h) FROM x{len(steps) - 1}")
    for by, times in ((33, _P2), (29, _P3), (32, 1)):
        steps.append(f"SELECT * REPLACE ({_times(f'xor(h, h >> {by})', times)} AS h) FROM x{len(steps) - 1}")
    bits = " + ".join(f"CASE WHEN sum(c * CAST((h >> {i}) & 1 AS BIGINT)) * 2 > sum(c) THEN {1 << i}::UHUGEINT ELSE 0 END" for i in range(64))
    chain = ",\n".join(f"x{i} AS MATERIALIZED ({x})" for i, x in enumerate(steps))
    digit = lambda at: f"(strpos('0123456789ABCDEF', substr(x, {at}, 1)) - 1)"
    return f"""
WITH RECURSIVE
doc AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
shingle AS (
  SELECT r, array_to_string(list_slice(w, g, g + least(3, len(w)) - 1), ' ') AS s
  FROM (SELECT r, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS g FROM doc WHERE len(w) > 0)),
counted AS (SELECT r, s, count(*) AS c FROM shingle GROUP BY r, s),
bytes AS (
  SELECT s, [CAST({digit("2 * g + 1")} * 16 + {digit("2 * g + 2")} AS UTINYINT) FOR g IN range(0, strlen(s))] AS b, strlen(s) AS n
  FROM (SELECT s, hex(encode(s)) AS x FROM (SELECT DISTINCT s FROM counted))),
{chain},
print AS (SELECT r, CAST({bits} AS UBIGINT) AS fp FROM counted JOIN x{len(steps) - 1} USING (s) GROUP BY r),
given AS (SELECT r, doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM doc LEFT JOIN print USING (r)),
least_id AS (SELECT fp, min(doc_id) AS id FROM given GROUP BY fp),
link AS (SELECT a.fp AS a, b.fp AS b FROM least_id a, least_id b WHERE a.fp <> b.fp AND bit_count(CAST(xor(a.fp, b.fp) AS BIT)) <= 3),
reach AS (SELECT fp AS a, fp AS b FROM least_id UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
root AS (SELECT a, min(id) AS component_id FROM reach JOIN least_id ON b = fp GROUP BY a)
SELECT doc_id, lower(lpad(to_hex(fp), 16, '0')) AS fingerprint, component_id FROM given JOIN root ON fp = a"""


SQL: dict[str, str] = {
    "op6_secrets": _secrets(),
    "op7_decontamination": _EDITS,
    "op8_forest": _SEARCH,
    "op9_simhash": _fingerprints(),
}
