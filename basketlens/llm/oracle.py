"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op9_url_filter"] = r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rhost, rpath, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                 ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT p.page_id, p.host, p.path,
       arg_max(r.rhost || r.rpath, length(r.rhost || r.rpath)) AS rule,
       coalesce(arg_max(r.verdict, length(r.rhost || r.rpath)), 'allow') AS verdict
FROM parts p LEFT JOIN rules r
  ON (p.host = r.rhost OR suffix(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
GROUP BY p.page_id, p.host, p.path
"""

ORACLE_SQL["op10_warc"] = r"""
WITH body AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM body),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < newest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < newest THEN newest END AS refers_to
FROM m
"""

ORACLE_SQL["op2_ngram_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2),
         lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])) END AS grams FROM w),
e AS (SELECT doc_id, unnest(grams) AS g FROM s),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
           GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN s sx ON sx.doc_id = x JOIN s sy ON sy.doc_id = y
          WHERE 100 * c >= 85 * (len(sx.grams) + len(sy.grams) - c)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, len(s.grams)::BIGINT AS n_shingles, least(s.doc_id, min(r.y)) AS component_id
FROM s LEFT JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, s.grams
"""

ORACLE_SQL["op1_decontaminate"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM benchmark),
dg AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' '))) END) AS g FROM d),
ig AS (SELECT item_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' '))) END) AS g FROM i),
n AS (SELECT item_id, count(*) AS n_item_shingles FROM ig GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_common FROM dg JOIN ig USING (g) GROUP BY ALL)
SELECT doc_id, item_id, n_item_shingles, n_common, n_common::DOUBLE / n_item_shingles AS containment
FROM c JOIN n USING (item_id) WHERE 100 * n_common >= 80 * n_item_shingles
"""

# (kind, regex in RE2 with both cases spelled out, group that is measured, least length)
_SECRETS = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|"""
               r"""[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("google", "AIza[A-Za-z0-9_-]{35}", 0, 1),
    ("stripe", "[sr]k_live_[A-Za-z0-9]{16,}", 0, 1),
    ("jwt", "eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]+", 0, 1),
    ("pem", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1),
)


def _secret_sql() -> str:
    found = ",\n".join(
        f"regexp_extract_all(t, '{p}') AS m{k}, regexp_split_to_array(t, '{p}') AS s{k}, "
        f"regexp_extract_all(t, '{p}', {g}) AS v{k}" for k, (_, p, g, _) in enumerate(_SECRETS))
    total = "coalesce(list_sum(list_transform({0}[1:{1}], lambda x: length(x))), 0)"
    spans = ",\n".join(
        f"list_filter(list_transform(range(1, len(m{k}) + 1), lambda i: {{'start': "
        f"({total.format(f's{k}', 'i')} + {total.format(f'm{k}', 'i - 1')})::BIGINT, 'ord': {k}, 'kind': '{kind}', "
        f"'stop': ({total.format(f's{k}', 'i')} + {total.format(f'm{k}', 'i')})::BIGINT, 'long': length(v{k}[i]) >= {least}}}), "
        f"lambda x: x.long) AS k{k}" for k, (kind, _, _, least) in enumerate(_SECRETS))
    text = "array_to_string(list_transform(list_sort({}), lambda x: x.kind || ':' || x.start || ':' || x.stop), ',')"
    merged = lambda ks: "flatten([" + ", ".join(f"k{k}" for k in ks) + "])"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT doc_id, {found} FROM d),
spans AS (SELECT doc_id, {spans} FROM found)
SELECT doc_id, len(k0)::BIGINT AS n_assign, len(k1)::BIGINT AS n_access, len(k2)::BIGINT AS n_hex,
  sha256(coalesce({text.format(merged(range(3)))}, '')) AS base_sha256,
  coalesce({text.format(merged(range(len(_SECRETS))))}, '') AS spans
FROM spans
"""


ORACLE_SQL["op5_secret_scan"] = _secret_sql()


def _quality_sql() -> str:
    """Counts by lists, limits by exact quantiles (a sketch of up to 1,024 rows is exact too)."""
    ratios = {"a": 0.1, "b": 0.35, "c": 0.3}     # symbols a word, repeated lines, repeated words: their floors
    ranks = "[0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.98]"

    def level(keys: str) -> str:
        sketches = ", ".join(
            f"quantile_disc({x}, {ranks}) FILTER (NOT base_failed) AS q{x}, "
            f"quantile_disc({x}, {ranks}) FILTER (NOT base_failed AND {x} > 0) AS p{x}, "
            f"count(*) FILTER (NOT base_failed AND {x} > 0) AS n{x}" for x in ratios)
        return f"SELECT {keys}count(*) FILTER (NOT base_failed) AS n, {sketches} FROM r"

    def fence(q: str, floor: float) -> str:
        end = f"list_reduce({q}, lambda e, v: CASE WHEN v - e <= {floor} / 2 THEN v ELSE e END)"
        return f"({end} + greatest({floor}, {end} - {q}[1]))"

    def above(t: str, x: str, least: int) -> str:
        q, floor = f"{t}.p{x}", ratios[x]
        return (f"CASE WHEN {t}.n{x} >= {least} THEN CASE WHEN {q}[1] > {floor} THEN {q}[1] / 3 "
                f"ELSE {fence(q, floor)} END END")

    def limit(t: str, x: str, levels: list[tuple[str, int]]) -> str:
        q, floor = f"{t}.q{x}", ratios[x]
        end = f"list_reduce({q}, lambda e, v: CASE WHEN v - e <= {floor} / 2 THEN v ELSE e END)"
        zeros = ", ".join(above(*args) for args in ((u, x, least) for u, least in levels))
        return f"CASE WHEN {end} = 0 THEN coalesce({zeros}, {floor}) ELSE {fence(q, floor)} END"

    usual, mine, final = [], [], []
    for x in ratios:
        usual.append(f"CASE WHEN l.n >= 20 THEN {limit('l', x, [('l', 20), ('o', 1)])} "
                     f"WHEN o.n > 0 THEN {limit('o', x, [('o', 1)])} END AS usual_{x}")
        mine.append(f"{limit('g', x, [('g', 20), ('l', 20), ('o', 1)])} AS mine_{x}, g.q{x}")
        final.append(f"CASE WHEN n < 20 THEN usual_{x} WHEN q{x}[1] <= usual_{x} AND q{x}[4] > usual_{x} "
                     f"THEN least(mine_{x}, usual_{x}) ELSE mine_{x} END AS limit_{x}")
    return rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
d AS (SELECT *, len(ws) AS n, list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS tri,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
windows AS (SELECT doc_id, unnest(tri) AS gram, unnest(range(1, len(tri) + 1)) AS pos FROM d),
repeated AS (SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT pos + k) AS n_repeat FROM repeated, (VALUES (0), (1), (2)) x(k) GROUP BY doc_id),
m AS (SELECT doc_id, lang, source, n::BIGINT AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
    coalesce(n_repeat, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN covered USING (doc_id)),
r AS (SELECT *, n_symbols::DOUBLE / greatest(n_words, 1) AS a, n_dup_lines::DOUBLE / greatest(n_lines, 1) AS b,
    n_repeat_words::DOUBLE / greatest(n_words, 1) AS c,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
o AS ({level('')}), l AS ({level('lang, ')} GROUP BY lang), g AS ({level('lang, source, ')} GROUP BY lang, source),
both_limits AS (SELECT g.lang, g.source, g.n, {', '.join(usual)}, {', '.join(mine)}
    FROM g JOIN l ON g.lang IS NOT DISTINCT FROM l.lang CROSS JOIN o),
limits AS (SELECT lang, source, {', '.join(final)} FROM both_limits)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND a <= limit_a AND b <= limit_b AND c <= limit_c AS kept
FROM r JOIN limits ON r.lang IS NOT DISTINCT FROM limits.lang AND r.source IS NOT DISTINCT FROM limits.source
"""


ORACLE_SQL["op7_quality_rules"] = _quality_sql()

ORACLE_SQL["op13_lexical_search"] = r"""
WITH terms AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
d AS (SELECT doc_id, ts, len(ts)::BIGINT AS n, row_number() OVER () AS r FROM terms WHERE len(ts) > 0),
total AS (SELECT count(*)::BIGINT AS nd, coalesce(sum(n), 0)::BIGINT AS words FROM d),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, nd),
item AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
asked AS (SELECT item_id, term, count(*)::BIGINT AS times FROM item GROUP BY ALL),
norm AS (SELECT r, doc_id, 25 + (75 * n * nd) // words AS m FROM d, total),
scored AS (
  SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN norm USING (r) GROUP BY ALL),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
