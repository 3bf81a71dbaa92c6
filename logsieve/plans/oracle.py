"""SQL twins of the named queries, written independently of the DataFrame operators, for any ANSI-like engine
with RE2-style ``regexp_matches``. They read the same tables as views named ``events`` and ``pages``."""

from logsieve.functions import fixed_values as V
from logsieve.functions.requests import ALL_FEATURES, PROFILES
from logsieve.sources.derived import PATHS, SITE_HOST, USER_AGENTS

ORACLE: dict[str, str] = {}


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listing(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def like(column: str, *patterns: str) -> str:
    """Any of the patterns matches. RE2 has no look-behind, so the one such pattern consumes the character."""
    joined = "|".join(f"(?:{p})" for p in patterns).replace(r"(?<=[&?=])\s*", r"[&?=]\s*")
    return f"regexp_matches({column}, {q('(?i)' + joined)})"


def h(salt: str, key: str) -> str:
    return f"CAST('0x' || substr(md5(concat('{salt}', CAST({key} AS VARCHAR))), 1, 8) AS BIGINT)"


def div(top: str, bottom: str) -> str:
    return f"CASE WHEN ({bottom}) <> 0 THEN CAST({top} AS DOUBLE) / CAST({bottom} AS DOUBLE) ELSE 0.0 END"


def rnd(value: str, name: str, digits: int = 6) -> str:
    return f"round({value}, {digits}) AS {name}"


# --- shared tables ---------------------------------------------------------------------

LOG = f"""
hashed AS (
  SELECT event_id AS row_id, user_id, event_type, epoch_us(ts) - 1704067200000000 AS us,
    {h('p', 'event_id')} AS hp, {h('u', 'event_id')} AS hu, {h('s', 'event_id')} AS hs, {h('r', 'event_id')} AS hr
  FROM events),
log AS (
  SELECT row_id, concat('10.0.', user_id // 256, '.', user_id % 256) AS ip,
    1704067200 + us // 3000000000 AS event_s,
    CASE event_type WHEN 'signup' THEN 'POST' WHEN 'purchase' THEN 'PUT' WHEN 'error' THEN 'HEAD' ELSE 'GET' END
      AS method,
    CASE WHEN hp % 97 <> 0 THEN {listing(PATHS)}[hp % {len(PATHS)} + 1] END AS path,
    CAST(CASE WHEN event_type <> 'error' THEN 200 WHEN hs % 5 = 0 THEN 403 WHEN hs % 5 = 1 THEN 444
      WHEN hs % 5 = 2 THEN 500 ELSE 404 END AS INT) AS status,
    hs % 20000 AS size,
    CASE hr % 3 WHEN 0 THEN '-' WHEN 2 THEN 'https://www.{SITE_HOST}/' END AS referer,
    {listing(USER_AGENTS)}[hu % {len(USER_AGENTS)} + 1] AS user_agent,
    CASE WHEN hr % 10 = 0 THEN 'data' ELSE 'www' END AS source
  FROM hashed),
req AS (SELECT *, coalesce(path, '') AS p, coalesce(user_agent, '') AS a, coalesce(referer, '') AS f,
    coalesce(path, '') || ' ' || coalesce(referer, '') AS pf FROM log)"""

FIELD = {"path": "p", "user_agent": "a", "path_ref": "pf"}
RULES = [
    (n, FIELD[f], "|".join(patterns).replace("{host}", SITE_HOST.replace(".", r"\."))) for n, f, patterns in V.LABEL_RULES
]
LABELED = LOG + f""",
classed AS (SELECT *, CASE {' '.join(f"WHEN {like(c, p)} THEN '{n}'" for n, c, p in RULES)} ELSE 'normal' END
    AS attack_type FROM req),
labeled AS (SELECT *, CAST(attack_type <> 'normal' AS INT) AS is_attack FROM classed)"""


def repaired(source: str, typed: bool) -> str:
    """Relabel rows that are still normal by the first repair rule that matches."""
    branches = " ".join(
        f"WHEN {like('p', pattern)} THEN '{name if typed else V.REPAIR_CONSTANT}'" for pattern, name in V.REPAIR_RULES
    )
    return f"""patched AS (SELECT *, CASE WHEN attack_type = 'normal' AND is_attack = 0 THEN CASE {branches} END END AS patch
  FROM {source}),
fixed AS (SELECT * REPLACE (coalesce(patch, attack_type) AS attack_type,
  CASE WHEN patch IS NOT NULL THEN 1 ELSE is_attack END AS is_attack) FROM patched)"""


KEPT = LABELED + ",\nkept AS (SELECT * FROM labeled WHERE attack_type <> 'seo_spam')"
CLEANED = KEPT + ",\n" + repaired("kept", False)
TYPED = KEPT + ",\n" + repaired("kept", True)
ALL_TYPED = LABELED + ",\n" + repaired("labeled", True)


def score_of(source: str) -> str:
    return (
        f"scored AS (SELECT *, CAST(score >= 0.40 AS INT) AS predicted FROM (SELECT *, "
        f"CAST(({h('m', 'row_id')} % 1000) * 6 + 3500 * is_attack AS DOUBLE) / 10000.0 AS score FROM {source}))"
    )


SCORED = CLEANED + ",\n" + score_of("fixed")
URI = "CASE WHEN starts_with(p, '/') THEN p ELSE '/' || p END"
OLD_ALL = V.OLD_URI_RULES + [p for p, _ in V.REPAIR_RULES]
MATCHED = CLEANED + f""",
sent AS (SELECT *, {URI} AS uri, a AS ua FROM fixed),
matched AS (SELECT *, {like('uri', *OLD_ALL)} OR {like('ua', *V.OLD_UA_RULES)} AS old_blocked,
    {like('uri', *V.NEW_URI_RULES)} OR {like('ua', *V.NEW_UA_RULES)} AS new_blocked FROM sent)"""
PREDICTED = TYPED + f""",
pred AS (SELECT attack_type AS label, CASE WHEN {h('c', 'row_id')} % 10 < 8 THEN attack_type ELSE 'normal' END AS pred
  FROM fixed)"""


def put(name: str, tables: str, body: str) -> None:
    ORACLE[name] = f"WITH {tables.strip()}\n{body}"


# --- features in SQL ----------------------------------------------------------------------


def count_of(column: str, chars: str) -> str:
    terms = [f"(length({column}) - length(replace({column}, {q(c)}, '')))" for c in chars]
    return "(" + " + ".join(terms) + ")"


def flag(condition: str) -> str:
    return f"CAST(coalesce({condition}, FALSE) AS INT)"


DIGITS = count_of("p", "0123456789")
SPECIAL = count_of("p", V.SPECIAL_CHARS)
SLASHES = count_of("p", "/")
URL_SQL = {
    "url_length": "length(p)",
    "num_special_chars": SPECIAL,
    "num_digits": DIGITS,
    "num_dots": count_of("p", "."),
    "num_slashes": SLASHES,
    "num_params": count_of("p", "&="),
    "has_and_pattern": flag(like("p", V.AND_TRAIN)),
    "encoded_chars": count_of("p", "%"),
    "path_depth": f"{SLASHES} - {flag(chr(39).join(['starts_with(p, ', '/', ')']))}",
    "digit_ratio": f"CAST({DIGITS} AS DOUBLE) / greatest(length(p), 1)",
    "special_char_ratio": f"CAST({SPECIAL} AS DOUBLE) / greatest(length(p), 1)",
}
UA_SQL = {
    "ua_length": "length(a)",
    "is_bot_ua": flag(like("a", *V.BOT_WORDS)),
    "is_legitimate_bot": flag(like("a", *V.SEARCH_BOTS)),
    "is_empty_ua": flag("a IN ('', '-')"),
}
REQUEST_SQL = {
    "method_code": "CASE method WHEN 'GET' THEN 0 WHEN 'POST' THEN 1 WHEN 'OPTIONS' THEN 2 WHEN 'HEAD' THEN 3 "
    "WHEN 'PUT' THEN 4 WHEN 'DELETE' THEN 5 ELSE 6 END",
    "is_get": flag("method = 'GET'"),
    "is_post": flag("method = 'POST'"),
    "is_options": flag("method = 'OPTIONS'"),
    "is_head": flag("method = 'HEAD'"),
    "status_code": "status",
    "is_4xx": flag("status >= 400 AND status < 500"),
    "is_5xx": flag("status >= 500 AND status < 600"),
    "is_444": flag("status = 444"),
    "is_404": flag("status = 404"),
    "is_403": flag("status = 403"),
    "body_size": "size",
    "is_empty_referer": flag("f IN ('', '-')"),
}
PATH_SQL = {
    "path_is_root": flag("p IN ('/', '/index.html', '/index.htm', '/index.php')"),
    "is_static_file": flag(like("p", V.STATIC_FILE)),
    "has_hash_filename": flag(like("p", V.HASH_FILE)),
    "is_known_api_prefix": flag(like("p", V.API_PREFIX)),
}
SCALAR_SQL = {**URL_SQL, **UA_SQL, **REQUEST_SQL, **PATH_SQL}
SERVE_SQL = {
    **SCALAR_SQL,
    "has_and_pattern": flag(like("p", V.AND_SERVE)),
    "is_empty_referer": "1",
    **{f: "0" for f in V.WINDOW_FEATURES},
}
WIDE = {"body_size"}  # long; every other whole-number feature is int


def typed(name: str, sql: str) -> str:
    if name.endswith("_ratio") or name in WIDE:
        return f"{sql} AS {name}"
    return f"CAST({sql} AS INT) AS {name}"


def cols(features: dict[str, str], names: list[str] | None = None) -> str:
    return ", ".join(typed(n, features[n]) for n in (names or list(features)))


def windowed(source: str) -> str:
    """Per-client 60-second sums: the range frame with all peers, less the later rows of the same second."""

    def frame(value: str) -> str:
        return (
            f"sum({value}) OVER (PARTITION BY ip ORDER BY event_s RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) - "
            f"coalesce(sum({value}) OVER (PARTITION BY ip, event_s ORDER BY row_id "
            f"ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)"
        )

    return f"""
stepped AS (SELECT *, 1 AS one, CAST(status = 404 AS INT) AS e404,
    lag(p) OVER (PARTITION BY ip ORDER BY event_s, row_id) AS prev_path FROM {source}),
lagged AS (SELECT *, CAST(coalesce(p = prev_path, FALSE) AS INT) AS same_url FROM stepped),
framed AS (SELECT *, CAST({frame('one')} AS INT) AS req_count_60s, CAST({frame('e404')} AS INT) AS err_count_60s,
    CAST({frame('same_url')} AS INT) AS same_60s FROM lagged),
windows AS (SELECT *, CAST(greatest(1, req_count_60s - same_60s) AS INT) AS unique_url_60s FROM framed)"""


META = "row_id, is_attack, attack_type, ip, path, source"
FULL_SQL = {**SCALAR_SQL, **{f: f for f in V.WINDOW_FEATURES}}
FEATURED = LABELED + "," + windowed("labeled") + f""",
features AS (SELECT {META}, {cols(FULL_SQL, ALL_FEATURES)} FROM windows)"""
# Windows count every request; spam leaves the finished table.
SCORED_FEATURED = LABELED + "," + windowed("labeled") + ",\nkept AS (SELECT * FROM windows WHERE attack_type <> 'seo_spam'),\n" + repaired("kept", False) + f""",
features AS (SELECT {META}, {cols(FULL_SQL, ALL_FEATURES)} FROM fixed),
{score_of('features')}"""


# --- parsing --------------------------------------------------------------------------------

RAW = LOG + """,
raw AS (SELECT row_id, source, CASE WHEN row_id % 53 = 0 THEN 'garbage ' || row_id ELSE
    ip || ' - - [' || strftime(make_timestamp(event_s * 1000000), '%d/%b/%Y:%H:%M:%S') || ' +0000] "' || method
    || ' ' || p || ' HTTP/1.1" ' || status || ' ' || size || ' "' || coalesce(referer, '-') || '" "' || user_agent
    || '"' END AS value FROM req)"""
LINE = q(r"^\s*" + V.LOG_LINE)


def group(i: int) -> str:
    """Group ``i`` of a line; the engine numbers groups up to 9, so the tenth is found with the first uncaptured."""
    if i == 10:
        return f"regexp_extract(value, {LINE.replace('(', '(?:', 1)}, 9)"
    return f"regexp_extract(value, {LINE}, {i})"


put("parse_log", RAW, f"""
SELECT row_id, source, {group(1)} AS ip, nullif({group(2)}, '-') AS "user", {group(3)} AS "time",
  {group(4)} AS method, {group(5)} AS path, {group(6)} AS protocol, CAST({group(7)} AS INT) AS status,
  CAST({group(8)} AS BIGINT) AS size, {group(9)} AS referer, {group(10)} AS user_agent,
  CAST(epoch(strptime(substr({group(3)}, 1, 20), '%d/%b/%Y:%H:%M:%S')) AS BIGINT) AS event_s
FROM raw WHERE regexp_matches(value, {LINE})""")
put("parse_text_log", RAW + """,
numbered AS (SELECT row_number() OVER (ORDER BY source, row_id) - 1 AS row_id, source, value FROM raw)""", f"""
SELECT row_id, source, {group(1)} AS ip, nullif({group(2)}, '-') AS "user", {group(3)} AS "time",
  {group(4)} AS method, {group(5)} AS path, {group(6)} AS protocol, CAST({group(7)} AS INT) AS status,
  CAST({group(8)} AS BIGINT) AS size, {group(9)} AS referer, {group(10)} AS user_agent,
  CAST(epoch(strptime(substr({group(3)}, 1, 20), '%d/%b/%Y:%H:%M:%S')) AS BIGINT) AS event_s
FROM numbered WHERE regexp_matches(value, {LINE})""")
put("parse_incremental", RAW + """,
numbered AS (SELECT row_number() OVER (ORDER BY source, row_id) - 1 AS row_id, source, value FROM raw),
fields AS (SELECT row_id, source, """ + f"""{group(5)} AS p, {group(10)} AS a, {group(5)} || ' ' || {group(9)} AS pf,
  CAST({group(7)} AS INT) AS status, CAST({group(8)} AS BIGINT) AS size FROM numbered WHERE regexp_matches(value, {LINE}))""", f"""
SELECT row_id, source, p AS path, status, size,
  CASE {' '.join(f"WHEN {like(c, p)} THEN '{n}'" for n, c, p in RULES)} ELSE 'normal' END AS attack_type
FROM fields""")
put("parse_stats", RAW, f"""
SELECT source, count(*) AS total, count(*) FILTER (ok) AS parsed, count(*) FILTER (NOT ok) AS failed,
  CAST(0 AS BIGINT) AS bad_time
FROM (SELECT source, regexp_matches(value, {LINE}) AS ok FROM raw) GROUP BY source""")
put("table_round_trip", LABELED, """
SELECT source, attack_type, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM labeled GROUP BY ALL""")

# --- projections, families ----------------------------------------------------------------------

put("exclude_class", KEPT, "SELECT row_id, attack_type, is_attack FROM kept")
for _profile, _names in PROFILES.items():
    put(f"feature_profile_{_profile}", FEATURED, f"SELECT {META}, {', '.join(_names)} FROM features")
put("align_features", LOG, "SELECT row_id, " + ", ".join(
    f"CAST({SCALAR_SQL.get(n, '0')} AS FLOAT) AS {n}" for n in PROFILES["v3"]) + " FROM req")
put("top_first_segment", LABELED, """
SELECT CASE WHEN contains(p, '/') THEN split_part(p, '/', 2) ELSE p END AS segment, count(*) AS n
FROM labeled WHERE attack_type = 'normal' GROUP BY 1 ORDER BY n DESC, segment LIMIT 30""")
URI_FAMILY = """CASE WHEN path IS NULL THEN 'unknown' WHEN path = '/' OR starts_with(path, '/index') THEN 'root'
  WHEN starts_with(path, '/api/') THEN '/api/*' WHEN starts_with(path, '/uploads/') THEN '/uploads/*'
  WHEN starts_with(path, '/project/') THEN '/project/*' WHEN contains(path, '.php') THEN '*.php'
  WHEN contains(path, '%') THEN 'encoded_url' ELSE 'other' END"""
UA_FAMILY = """CASE WHEN user_agent IS NULL THEN 'unknown' WHEN contains(lower(user_agent), 'undici') THEN 'undici'
  WHEN contains(lower(user_agent), 'mozilla') THEN 'mozilla/browser'
  WHEN contains(lower(user_agent), 'java') THEN 'java'
  WHEN contains(lower(user_agent), 'bot') OR contains(lower(user_agent), 'crawl') THEN 'bot'
  WHEN contains(lower(user_agent), 'mycustomua') THEN 'custom' ELSE 'other' END"""


def mix(name: str, tables: str, source: str, column: str, alias: str, tail: str = "") -> None:
    put(name, tables, f"""
SELECT {column} AS {alias}, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS share
FROM {source} GROUP BY 1 {tail}""")


mix("uri_family_mix", LOG, "log", URI_FAMILY, "family")
mix("ua_family_mix", LOG, "log", UA_FAMILY, "family")
mix("mix_status", LOG, "log", "status", "status")
mix("mix_status_normal", LABELED, "labeled WHERE is_attack = 0", "status", "status", "ORDER BY n DESC, status LIMIT 20")
mix("mix_method", LOG, "log", "method", "method", "ORDER BY n DESC, method LIMIT 10")
mix("mix_source", LOG, "log", "source", "source")
mix("csv_report_round_trip", LABELED, "labeled", "attack_type", "attack_type")
mix("json_report_round_trip", LABELED, "labeled", "attack_type", "attack_type")
mix("mix_class", LABELED, "labeled", "attack_type", "attack_type")

# --- rules ----------------------------------------------------------------------------------------

for _n, _c, _p in RULES:
    put(f"label_{_n}", LOG, f"SELECT row_id, CAST({like(_c, _p)} AS INT) AS matched FROM req")
put("label_requests", LABELED, "SELECT row_id, attack_type, is_attack FROM labeled")
put("rule_table_labels", LABELED, "SELECT row_id, attack_type FROM labeled")
put("rule_table_pages", "paths AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1) AS path FROM pages)", """
SELECT page_id AS row_id, ord, 'page ' || ord AS name FROM (
  SELECT page_id, min(page_id) OVER (PARTITION BY lower(path)) AS ord FROM paths)""")
put("label_mix", LABELED, "SELECT attack_type, is_attack, count(*) AS n FROM labeled GROUP BY ALL")
put("repair_labels", CLEANED, "SELECT row_id, attack_type, is_attack FROM fixed")
put("repair_labels_typed", ALL_TYPED, "SELECT row_id, attack_type, is_attack FROM fixed")
put("repair_counts", LABELED, f"""
SELECT ord, {listing([p for p, _ in V.REPAIR_RULES])}[ord + 1] AS pattern, count(*) AS repaired FROM (
  SELECT CAST(CASE {' '.join(f"WHEN {like('p', p)} THEN {i}" for i, (p, _) in enumerate(V.REPAIR_RULES))} END AS INT)
    AS ord FROM labeled WHERE attack_type = 'normal' AND is_attack = 0) WHERE ord IS NOT NULL GROUP BY ord""")
NORMALS = LABELED + ",\nnormals AS (SELECT * FROM labeled WHERE attack_type = 'normal')"
put("audit_patterns", NORMALS, "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS pattern, count(*) AS hits FROM normals WHERE {like('p', p)}" for n, p in V.AUDIT_PATTERNS
) + ") WHERE hits > 0")
put("audit_samples", NORMALS, "SELECT pattern, CAST(rank AS INT) AS rank, row_id, substr(p, 1, 150) AS path FROM ("
    "SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY row_id) AS rank FROM (" + " UNION ALL ".join(
        f"SELECT '{n}' AS pattern, row_id, p FROM normals WHERE {like('p', p)}" for n, p in V.AUDIT_PATTERNS
    ) + ")) WHERE rank <= 5")
for _key, _p in (("audit_php", V.AUDIT_PHP), ("audit_suffix", V.AUDIT_SUFFIX)):
    put(_key, NORMALS, f"""
SELECT p AS path, count(*) AS n FROM normals WHERE {like('p', _p)} GROUP BY 1 ORDER BY n DESC, path LIMIT 20""")
put("audit_residual", NORMALS, f"""
SELECT count(*) AS normal_rows, count(*) FILTER ({like('p', V.AND_TRAIN)}) AS and_pattern,
  count(*) FILTER (a IN ('', '-')) AS empty_ua FROM normals""")


def first_rule(body: bool) -> tuple[str, str]:
    rules = [("uri", p, "uri_rule", p[:40]) for p in V.OLD_URI_RULES]
    rules += [("uri", V.SEO_SPAM_RULE, "seo_spam", V.SEO_SPAM_NAME)]
    rules += [("uri", p, "mislabel_rule", n) for p, n in V.REPAIR_RULES]
    rules += [("ua", p, "ua_rule", p[:40]) for p in V.OLD_UA_RULES]
    tests = [(like(c, p), t, m) for c, p, t, m in rules]
    if body:
        carries = "method IN ('POST', 'PUT', 'PATCH') AND "
        tests += [(carries + like("body", p), "body_rule", p[:40]) for p in V.BODY_RULES]
    return (
        "CASE " + " ".join(f"WHEN {c} THEN {q(t)}" for c, t, _ in tests) + " END",
        "CASE " + " ".join(f"WHEN {c} THEN {q(m)}" for c, _, m in tests) + " END",
    )


_type, _match = first_rule(False)
FIRST = CLEANED + f""",
sent AS (SELECT *, {URI} AS uri, a AS ua FROM fixed),
ruled AS (SELECT *, {_type} AS rule_type, {_match} AS matched FROM sent)"""
put("rule_first_match", FIRST, """
SELECT row_id, CAST(rule_type IS NOT NULL AS INT) AS blocked, rule_type, matched FROM ruled""")
_type, _match = first_rule(True)
put("rule_first_match_body", LABELED + f""",
sent AS (SELECT *, {URI} AS uri, a AS ua, concat_ws(' ', path, referer) AS body FROM labeled)""", f"""
SELECT method, {_type} AS rule_type, {_match} AS matched, count(*) AS n FROM sent GROUP BY ALL""")
put("rule_match_oldnew", MATCHED, """
SELECT row_id, CAST(old_blocked AS INT) AS old_blocked, CAST(new_blocked AS INT) AS new_blocked FROM matched""")


def probes(source: str) -> str:
    hits = " UNION ALL ".join(
        f"SELECT {q(n)} AS probe, attack_type FROM {source} WHERE {like('uri', p)}" for n, p in V.MISSED_PROBES
    )
    return f"""
SELECT probe, CAST(missed AS BIGINT) AS missed, CAST(rank AS INT) AS rank, attack_type, n FROM (
  SELECT probe, attack_type, n, sum(n) OVER (PARTITION BY probe) AS missed,
    row_number() OVER (PARTITION BY probe ORDER BY n DESC, attack_type) AS rank
  FROM (SELECT probe, attack_type, count(*) AS n FROM ({hits}) GROUP BY ALL)) WHERE rank <= 3"""


put("missed_probe", FIRST + ",\nlost AS (SELECT * FROM ruled WHERE is_attack = 1 AND rule_type IS NULL)", probes("lost"))
put("missed_probe_all", LABELED + f",\nlost AS (SELECT *, {URI} AS uri FROM labeled WHERE is_attack = 1)", probes("lost"))

_corpus = ", ".join(f"({q(n)}, {q(u)})" for n, uris in V.PAYLOADS.items() for u in uris)
CORPUS = f"""
corpus AS (
  SELECT * FROM (VALUES {_corpus}) v(class, uri)
  UNION ALL
  SELECT 'page', '/' || regexp_extract(url, '^[a-z]+://[^/]*/?(.*)$', 1) FROM pages),
probed AS (SELECT *, {like('uri', *V.NEW_URI_RULES)} OR {like(q(V.PROBE_USER_AGENT), *V.NEW_UA_RULES)} AS hit
  FROM corpus)"""
put("payload_coverage", CORPUS, f"""
SELECT class, total, blocked, {rnd(div('blocked * 100', 'total'), 'rate')} FROM (
  SELECT class, count(*) AS total, count(*) FILTER (hit) AS blocked FROM probed GROUP BY class
  UNION ALL
  SELECT 'TOTAL ATTACK', count(*), count(*) FILTER (hit) FROM probed WHERE class NOT IN ('normal', 'page'))""")
PAGE_CLASS = " ".join(f"WHEN {like('uri', p)} THEN '{n}'" for n, c, p in RULES if c == "p")
put("payload_missed", CORPUS, f"""
SELECT class, uri, count(*) AS n FROM (
  SELECT hit, uri, CASE WHEN class = 'page' THEN CASE {PAGE_CLASS} END ELSE class END AS class FROM probed)
WHERE NOT hit AND class <> 'normal' GROUP BY ALL""")
put("rule_coverage", FIRST, f"""
SELECT t.attack_type, total, blocked, {rnd(div('blocked * 100', 'total'), 'rate')}, main_rule FROM (
  SELECT attack_type, count(*) AS total, count(rule_type) AS blocked FROM ruled WHERE is_attack = 1 GROUP BY 1) t
LEFT JOIN (SELECT attack_type, rule_type AS main_rule FROM (
  SELECT attack_type, rule_type, row_number() OVER (PARTITION BY attack_type ORDER BY count(*) DESC, rule_type) AS r
  FROM ruled WHERE is_attack = 1 AND rule_type IS NOT NULL GROUP BY 1, 2) WHERE r = 1) m USING (attack_type)""")


def tally(side: str) -> str:
    return (
        f"count(*) FILTER (is_attack = 1 AND {side}_blocked) AS {side}_tp, "
        f"count(*) FILTER (is_attack = 1 AND NOT {side}_blocked) AS {side}_fn, "
        f"count(*) FILTER (is_attack = 0 AND {side}_blocked) AS {side}_fp, "
        f"count(*) FILTER (is_attack = 0 AND NOT {side}_blocked) AS {side}_tn"
    )


def compare_row(name: str, old: str, new: str) -> str:
    return (
        f"SELECT '{name}' AS metric, round(CAST({old} AS DOUBLE), 6) AS old_value, "
        f"round(CAST({new} AS DOUBLE), 6) AS new_value, "
        f"round(CAST({new} AS DOUBLE) - CAST({old} AS DOUBLE), 6) + 0.0 AS change FROM tallies"
    )


_rows = [compare_row(m, f"old_{m}", f"new_{m}") for m in ("tp", "fn", "fp", "tn")]
_rows.append(compare_row("block_rate", div("old_tp * 100", "old_tp + old_fn"), div("new_tp * 100", "new_tp + new_fn")))
_rows.append(
    compare_row("false_block_rate", div("old_fp * 100", "old_fp + old_tn"), div("new_fp * 100", "new_fp + new_tn"))
)
put("rule_compare", MATCHED + f",\ntallies AS (SELECT {tally('old')}, {tally('new')} FROM matched)",
    " UNION ALL ".join(_rows))
put("rule_missed", MATCHED, """
SELECT * FROM (SELECT attack_type,
  count(*) FILTER (is_attack = 1 AND NOT old_blocked) AS old_missed,
  count(*) FILTER (is_attack = 1 AND NOT new_blocked) AS new_missed,
  count(*) FILTER (is_attack = 0 AND old_blocked) AS old_false_block,
  count(*) FILTER (is_attack = 0 AND new_blocked) AS new_false_block
FROM matched GROUP BY 1) WHERE old_missed + new_missed + old_false_block + new_false_block > 0""")
LISTED = "SELECT row_id, attack_type, method, substr(uri, 1, 60) AS uri, substr(ua, 1, 30) AS ua FROM matched"
put("rule_missed_listing", MATCHED, LISTED + " WHERE is_attack = 1 AND NOT new_blocked ORDER BY row_id LIMIT 20")


def false_blocks(version: str) -> str:
    """Rule type and text of the first rule that blocks, per falsely blocked row."""
    if version == "old":
        kind, text = first_rule(False)
    else:
        tests = [(like("uri", p), "uri_rule", p[:40]) for p in V.NEW_URI_RULES]
        tests += [(like("ua", p), "ua_rule", p[:40]) for p in V.NEW_UA_RULES]
        kind = "CASE " + " ".join(f"WHEN {c} THEN {q(t)}" for c, t, _ in tests) + " END"
        text = "CASE " + " ".join(f"WHEN {c} THEN {q(m)}" for c, _, m in tests) + " END"
    return f"""
SELECT row_id, method, substr(uri, 1, 60) AS uri, substr(ua, 1, 30) AS ua, {kind} AS rule_type, {text} AS matched
FROM matched WHERE is_attack = 0 AND {version}_blocked"""


put("rule_false_block_listing", MATCHED, false_blocks("old"))
put("rule_false_block_listing_new", MATCHED, false_blocks("new"))

# --- features -----------------------------------------------------------------------------------------

put("features_url", LOG, f"SELECT row_id, {cols(URL_SQL)} FROM req")
put("features_url_serve", LOG, f"SELECT row_id, {cols({n: SERVE_SQL[n] for n in URL_SQL})} FROM req")
put("features_ua", LOG, f"SELECT row_id, {cols(UA_SQL)} FROM req")
put("features_request", LOG, f"SELECT row_id, {cols(REQUEST_SQL)} FROM req")
put("features_path", LOG, f"SELECT row_id, {cols(PATH_SQL)} FROM req")
put("feature_table", FEATURED, "SELECT * FROM features")
put("feature_table_serve", LABELED, f"SELECT {META}, {cols(SERVE_SQL, ALL_FEATURES)} FROM labeled")
WINDOWED = LOG + "," + windowed("req")
put("lag_same_url", WINDOWED, "SELECT row_id, prev_path, same_url FROM windows")
for _key, _f in zip(("win_req_count", "win_err_count", "win_unique_url"), V.WINDOW_FEATURES, strict=True):
    put(_key, WINDOWED, f"SELECT row_id, ip, event_s, {_f} FROM windows")
IMPORTANCE = FEATURED + ",\nimportance AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, count(*) FILTER (is_attack = 1 AND {f} > 0) AS importance FROM features"
    for f in PROFILES["v3"]) + ")"
put("importance_cum", IMPORTANCE, f"""
SELECT CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INT) AS rank, feature, importance,
  {rnd(div('importance * 100', '(SELECT sum(importance) FROM importance)'), 'pct')},
  round(CAST((sum(importance) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING)) * 100 AS DOUBLE)
    / (SELECT sum(importance) FROM importance), 6) AS cumulative_pct
FROM importance""")
put("samples_per_class", LABELED, """
SELECT attack_type, CAST(rank AS INT) AS rank, row_id, substr(p, 1, 150) AS path FROM (
  SELECT *, row_number() OVER (PARTITION BY attack_type ORDER BY row_id) AS rank FROM labeled) WHERE rank <= 5""")
put("top_fn_per_class", SCORED, """
SELECT attack_type, CAST(rank AS INT) AS rank, row_id, score, substr(p, 1, 100) AS path FROM (
  SELECT *, row_number() OVER (PARTITION BY attack_type ORDER BY score DESC, row_id) AS rank
  FROM scored WHERE is_attack = 1 AND predicted = 0) WHERE rank <= 10""")

# --- samples, splits, joins ------------------------------------------------------------------------------

KEY42 = "md5(concat('42', CAST(row_id AS VARCHAR)))"
put("sample_n", LOG, f"SELECT row_id, ip, path FROM log ORDER BY {KEY42}, row_id LIMIT 1000")
put("balanced_sample", CLEANED, f"""
SELECT row_id, attack_type, CASE WHEN is_attack = 1 THEN 'attack' ELSE 'normal' END AS label FROM (
  SELECT *, row_number() OVER (PARTITION BY is_attack ORDER BY {KEY42}, row_id) AS r FROM fixed) WHERE r <= 500""")
put("split_random", CLEANED, f"""
SELECT row_id, is_attack, CASE WHEN {h('split', 'row_id')} % 100 < 80 THEN 'train' ELSE 'test' END AS split
FROM fixed""")
put("split_stratified", TYPED, """
SELECT row_id, attack_type, CASE WHEN r <= n * 80 // 100 THEN 'train' ELSE 'test' END AS split FROM (
  SELECT row_id, attack_type, count(*) OVER (PARTITION BY attack_type) AS n, row_number() OVER (
    PARTITION BY attack_type ORDER BY md5(concat('split', CAST(row_id AS VARCHAR))), row_id) AS r FROM fixed)""")
put("fp_sample", SCORED, """
SELECT row_id, path, attack_type, source, ip, is_attack, score FROM scored
WHERE is_attack = 0 AND predicted = 1 ORDER BY row_id LIMIT 1000""")
put("join_labels", LABELED, f"""
SELECT r.row_id, {', '.join(f'r.{n}' for n in PATH_SQL)}, l.is_attack, l.attack_type
FROM (SELECT row_id, {cols(PATH_SQL)} FROM req) r JOIN labeled l ON r.row_id = l.row_id""")
ORACLE["join_labels_colocated"] = ORACLE["join_labels"]
put("join_labels_left", RAW + f""",
lines AS (SELECT row_id, {group(5)} AS p, {group(10)} AS a, {group(5)} || ' ' || {group(9)} AS pf
  FROM raw WHERE regexp_matches(value, {LINE})),
relabeled AS (SELECT row_id, CASE {' '.join(f"WHEN {like(c, p)} THEN '{n}'" for n, c, p in RULES)} ELSE 'normal' END
  AS attack_type FROM lines)""", f"""
SELECT r.row_id, {', '.join(f'r.{n}' for n in UA_SQL)}, l.attack_type
FROM (SELECT row_id, {cols(UA_SQL)} FROM req) r
LEFT JOIN (SELECT * FROM relabeled) l ON r.row_id = l.row_id""")
BANS = """
failed AS (SELECT ip, event_s FROM req WHERE status >= 400 AND status < 500),
hot AS (SELECT DISTINCT ip, event_s FROM (SELECT ip, event_s, count(*) OVER (
  PARTITION BY ip ORDER BY event_s RANGE BETWEEN 299 PRECEDING AND CURRENT ROW) AS c FROM failed) WHERE c >= 4),
marks AS (SELECT *, CASE WHEN event_s - lag(event_s) OVER (PARTITION BY ip ORDER BY event_s) >= 120 THEN 1 ELSE 0 END
  AS fresh FROM hot),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY ip ORDER BY event_s ROWS UNBOUNDED PRECEDING) AS island FROM marks),
bans AS (SELECT ip, min(event_s) AS ban_start, max(event_s) + 120 AS ban_end, count(*) AS triggers
  FROM islands GROUP BY ip, island)"""
put("ban_windows", LOG + "," + BANS, "SELECT * FROM bans")
BANNED = "CAST(EXISTS (SELECT 1 FROM bans b WHERE b.ip = {t}.ip AND {t}.event_s >= b.ban_start AND {t}.event_s < b.ban_end) AS INT)"
put("ban_interval_join", LOG + "," + BANS, f"""
SELECT row_id, ip, event_s, {BANNED.format(t='req')} AS banned FROM req""")
put("rate_limit", LOG, """
SELECT ip, event_s // 60 * 60 AS window_start, count(*) AS requests FROM log GROUP BY 1, 2 HAVING count(*) > 8""")
put("layered_verdict", LABELED + "," + BANS + "," + windowed("labeled") + ",\n" + score_of("windows"), f"""
SELECT row_id, attack_type, CASE WHEN {like(URI, *V.NEW_URI_RULES)} OR {like('a', *V.NEW_UA_RULES)} THEN 'rule_block'
  WHEN req_count_60s > 8 THEN 'rate_limit' WHEN {BANNED.format(t='scored')} = 1 THEN 'banned'
  WHEN score >= 0.40 THEN 'observed' ELSE 'pass' END AS verdict FROM scored""")

# --- reports ------------------------------------------------------------------------------------------------

put("label_balance", CLEANED, """
SELECT count(*) AS n_rows, CAST(sum(is_attack) AS BIGINT) AS positives, round(avg(is_attack), 6) AS rate FROM fixed""")
COUNTS = ("count(*) FILTER (is_attack = 0 AND {p}) AS fp, count(*) FILTER (is_attack = 0 AND NOT ({p})) AS tn, "
          "count(*) FILTER (is_attack = 1 AND NOT ({p})) AS fn, count(*) FILTER (is_attack = 1 AND {p}) AS tp")
RATE_SQL = {
    "accuracy": div("tp + tn", "tp + tn + fp + fn").replace("CAST(tp + tn AS", "CAST((tp + tn) AS"),
    "precision": div("tp", "tp + fp"),
    "recall": div("tp", "tp + fn"),
    "f1": div("2 * tp", "2 * tp + fp + fn"),
    "fpr": div("fp", "fp + tn"),
    "fnr": div("fn", "fn + tp"),
}
RATES = ", ".join(rnd(s, n) for n, s in RATE_SQL.items())
put("confusion", SCORED, f"SELECT {COUNTS.format(p='predicted = 1')} FROM scored")
put("binary_metrics", SCORED, f"""
SELECT tn, fp, fn, tp, {RATES} FROM (SELECT {COUNTS.format(p='predicted = 1')} FROM scored)""")


def sweep_table(grid: str) -> str:
    values = ", ".join(f"(CAST({t} AS DOUBLE))" for t in V.SWEEP_GRIDS[grid])
    return SCORED + f""",
grid(threshold) AS (VALUES {values}),
swept AS (SELECT threshold, tn, fp, fn, tp, {RATES} FROM (
  SELECT threshold, {COUNTS.format(p='score >= threshold')} FROM scored, grid GROUP BY threshold))"""


put("threshold_sweep", sweep_table("fourteen"), "SELECT * FROM swept")
for _g in ("half_up", "eight", "ten", "offline", "full", "complete", "search"):
    put(f"threshold_sweep_{_g}", sweep_table(_g), "SELECT * FROM swept")
put("best_threshold_fpr", sweep_table("fourteen"), """
SELECT *, CAST(fpr < 0.05 AS INT) AS within_limit FROM swept
ORDER BY (fpr < 0.05) DESC, CASE WHEN fpr < 0.05 THEN fnr ELSE fpr END, threshold LIMIT 1""")
put("best_threshold_f1", sweep_table("search"), "SELECT * FROM swept ORDER BY f1 DESC, threshold LIMIT 1")

mix("missed_mix_high", SCORED, "scored WHERE is_attack = 1 AND score < 0.85", "attack_type", "attack_type")
put("missed_paths_high", SCORED, """
SELECT row_id, substr(p, 1, 120) AS path FROM scored WHERE is_attack = 1 AND score < 0.85 ORDER BY row_id LIMIT 30""")

put("auc", SCORED, """
, ranked AS (SELECT is_attack, score, avg(r) OVER (PARTITION BY score) AS rank FROM (
  SELECT is_attack, score, row_number() OVER (ORDER BY score) AS r FROM scored)),
sums AS (SELECT count(*) FILTER (is_attack = 1) AS positives, count(*) FILTER (is_attack = 0) AS negatives,
  sum(rank) FILTER (is_attack = 1) AS s FROM ranked)
SELECT positives, negatives, round((s - CAST(positives AS DOUBLE) * (positives + 1) / 2)
  / (CAST(positives AS DOUBLE) * negatives), 6) AS auc FROM sums""")
AUC_CTE = ORACLE["auc"].split("\n, ranked", 1)[1].rsplit("SELECT positives, negatives, round", 1)[0]
AUC_VALUE = ("(SELECT round((s - CAST(positives AS DOUBLE) * (positives + 1) / 2) "
             "/ (CAST(positives AS DOUBLE) * negatives), 6) FROM sums)")
put("metric_delta", SCORED + ",\nranked" + AUC_CTE + f""",
m AS (SELECT {RATES} FROM (SELECT {COUNTS.format(p='predicted = 1')} FROM scored))""", " UNION ALL ".join(
    f"SELECT '{k}' AS metric, CAST({v} AS DOUBLE) AS old_value, {AUC_VALUE if k == 'auc' else k} AS new_value, "
    f"round({AUC_VALUE if k == 'auc' else k} - CAST({v} AS DOUBLE), 6) + 0.0 AS delta FROM m"
    for k, v in V.STORED_BASELINE.items()))
FNR = f"""
SELECT attack_type, count(*) AS total, count(*) FILTER (predicted = 1) AS tp, count(*) FILTER (predicted = 0) AS fn,
  round(CAST(count(*) FILTER (predicted = 0) AS DOUBLE) / count(*), 6) AS fnr, round(avg(score), 6) AS avg_score
FROM scored WHERE is_attack = 1 GROUP BY 1"""
put("fnr_by_class", SCORED, FNR)
put("rule_priority", SCORED, f"""
SELECT attack_type, total, fnr, CASE WHEN fnr > 0.15 AND total >= 10 THEN 'high'
  WHEN fnr > 0.05 AND total >= 10 THEN 'medium' ELSE 'low' END AS priority, CAST(total < 100 AS INT) AS rare
FROM ({FNR})""")
put("fn_detail", SCORED, """
SELECT attack_type, count(*) AS fn, round(avg(score), 6) AS avg_score, round(max(score), 6) AS max_score
FROM scored WHERE is_attack = 1 AND predicted = 0 GROUP BY 1""")
put("block_rate_by_class", SCORED, f"""
SELECT *, round(CASE WHEN attacks > 0 THEN {div('blocked', 'attacks')} ELSE {div('false_blocks', 'normals')} END, 6)
  AS rate FROM (SELECT attack_type, count(*) FILTER (is_attack = 1) AS attacks,
  count(*) FILTER (is_attack = 1 AND predicted = 1) AS blocked, count(*) FILTER (is_attack = 0) AS normals,
  count(*) FILTER (is_attack = 0 AND predicted = 1) AS false_blocks FROM scored GROUP BY 1)""")


def means(names: list[str], left: str, right: str) -> str:
    return "means AS (" + " UNION ALL ".join(
        f"SELECT '{n}' AS feature, avg({n}) FILTER ({left}) AS l, avg({n}) FILTER ({right}) AS r FROM source"
        for n in names) + ")"


put("fp_tn_means", SCORED_FEATURED + ",\nsource AS MATERIALIZED (SELECT * FROM scored),\n" + means(
    V.FP_COMPARE_FEATURES, "is_attack = 0 AND predicted = 1", "is_attack = 0 AND predicted = 0"), """
SELECT feature, round(l, 6) AS fp_mean, round(r, 6) AS tn_mean, round(l - r, 6) + 0.0 AS difference FROM means""")
put("class_means", FEATURED + ",\nsource AS MATERIALIZED (SELECT * FROM features),\n" + means(
    PROFILES["v3"], "is_attack = 0", "is_attack = 1"), """
SELECT feature, round(l, 6) AS normal_mean, round(r, 6) AS attack_mean, round(r / greatest(abs(l), 0.001), 6) AS ratio
FROM means""")
put("stat_feature_health", IMPORTANCE, " UNION ALL ".join(f"""
SELECT '{f}' AS feature, round(avg({f}) FILTER (is_attack = 0), 6) AS normal_mean,
  round(avg({f}) FILTER (is_attack = 1), 6) AS attack_mean,
  round(avg(CAST({f} > 0 AS INT)) FILTER (is_attack = 0), 6) AS normal_nonzero,
  round(avg(CAST({f} > 0 AS INT)) FILTER (is_attack = 1), 6) AS attack_nonzero,
  (SELECT round(100.0 * max(importance) FILTER (feature = '{f}') / CAST(sum(importance) AS DOUBLE), 6)
   FROM importance) AS importance_pct
FROM features""" for f in V.WINDOW_FEATURES))
put("train_serve_skew", FEATURED + f""",
served AS (SELECT {cols(SERVE_SQL, PROFILES['v3'])} FROM labeled),
t AS (SELECT {', '.join(f'avg({n}) AS {n}' for n in PROFILES['v3'])} FROM features),
s AS (SELECT {', '.join(f'avg({n}) AS {n}' for n in PROFILES['v3'])} FROM served)""", " UNION ALL ".join(
    f"SELECT '{n}' AS feature, round(t.{n}, 6) AS train_mean, round(s.{n}, 6) AS serve_mean, "
    f"round(t.{n} - s.{n}, 6) + 0.0 AS skew FROM t, s" for n in PROFILES["v3"]))


def spread(name: str, tables: str, source: str, value: str) -> None:
    quantiles = ", ".join(f"round(quantile_cont(v, {x}), 6) AS p{round(x * 100)}" for x in (0.25, 0.5, 0.75, 0.9))
    put(name, tables, f"""
SELECT is_attack, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min,
  round(max(v), 6) AS max, {quantiles} FROM (SELECT is_attack, CAST({value} AS DOUBLE) AS v FROM {source}) GROUP BY 1""")


spread("score_distribution", SCORED, "scored", "score")
spread("ua_length_distribution", LABELED, "labeled", "length(a)")
put("short_ua_share", LABELED, """
SELECT is_attack, count(*) AS n, round(avg(CAST(length(a) < 10 AS INT)), 6) AS short_share FROM labeled GROUP BY 1""")
put("fp_breakdown", SCORED + ",\nwrong AS (SELECT * FROM scored WHERE is_attack = 0 AND predicted = 1)", " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {c} AS value, count(*) AS n, "
    f"round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM wrong), 6) AS share FROM wrong GROUP BY 2"
    for d, c in (("attack_type", "attack_type"), ("source", "source"), ("method", "method"),
                 ("uri_family", URI_FAMILY), ("ua_family", UA_FAMILY))))
REPLAY = MATCHED + f""",
replay AS (SELECT row_id, CASE WHEN new_blocked THEN 403 ELSE status END AS status, is_attack, attack_type,
  {h('e', 'row_id')} % 40 = 0 AS failed FROM matched)"""
put("replay_report", REPLAY, f"""
SELECT errors, tn, fp, fn, tp, {', '.join(rnd(RATE_SQL[n], n) for n in ('recall', 'fnr', 'fpr', 'precision'))} FROM (
  SELECT count(*) FILTER (failed) AS errors,
    count(*) FILTER (NOT failed AND is_attack = 0 AND status <> 403) AS tn,
    count(*) FILTER (NOT failed AND is_attack = 0 AND status = 403) AS fp,
    count(*) FILTER (NOT failed AND is_attack = 1 AND status <> 403) AS fn,
    count(*) FILTER (NOT failed AND is_attack = 1 AND status = 403) AS tp FROM replay)""")
put("replay_by_class", REPLAY, """
SELECT attack_type, count(*) AS total, count(*) FILTER (status = 403) AS blocked,
  round(100.0 * count(*) FILTER (status = 403) / count(*), 6) AS rate
FROM replay WHERE NOT failed AND is_attack = 1 GROUP BY 1""")
CLASSES = PREDICTED + """,
names AS (SELECT label AS class FROM pred UNION SELECT pred FROM pred),
per_class AS (SELECT class, count(*) FILTER (label = class AND pred = class) AS hits,
  count(*) FILTER (label = class) AS support, count(*) FILTER (pred = class) AS predicted FROM names, pred GROUP BY 1),
report AS (SELECT class, CASE WHEN predicted > 0 THEN CAST(hits AS DOUBLE) / predicted ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN CAST(hits AS DOUBLE) / support ELSE 0 END AS recall,
  CASE WHEN support + predicted > 0 THEN 2.0 * hits / CAST(support + predicted AS DOUBLE) ELSE 0 END AS f1, support
  FROM per_class)"""
put("class_report", CLASSES, """
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM report""")
put("macro_metrics", CLASSES, "SELECT round(sum(recall * support) / sum(support), 4) AS accuracy, " + ", ".join(
    f"round(avg({m}), 4) AS macro_{m}" for m in ("precision", "recall", "f1")) + ", " + ", ".join(
    f"round(sum({m} * support) / sum(support), 4) AS weighted_{m}" for m in ("precision", "recall", "f1")) + " FROM report")
MC = ["automated_tool", "normal", "path_padding", "path_traversal", "sensitive_scan", "seo_spam_slash",
      "sql_injection", "vuln_scan"]
put("confusion_mc", PREDICTED, "SELECT label, " + ", ".join(
    f"count(*) FILTER (pred = '{c}') AS {c}" for c in MC) + " FROM pred GROUP BY 1")
put("normal_fpr", PREDICTED, """
SELECT count(*) AS normal_total, count(*) FILTER (pred <> 'normal') AS misclassified,
  round(CAST(count(*) FILTER (pred <> 'normal') AS DOUBLE) / count(*), 6) AS normal_fpr FROM pred
WHERE label = 'normal'""")
put("class_weight_binary", CLEANED, """
SELECT positives, negatives, round(CAST(negatives AS DOUBLE) / positives, 6) AS full_weight,
  round(sqrt(CAST(negatives AS DOUBLE) / positives), 6) AS sqrt_weight FROM (
  SELECT count(*) FILTER (is_attack = 1) AS positives, count(*) FILTER (is_attack = 0) AS negatives FROM fixed)""")
put("class_weight_multi", TYPED + """,
n AS (SELECT attack_type AS class, count(*) AS n FROM fixed GROUP BY 1),
w AS (SELECT class, n, sqrt(CAST((SELECT sum(n) FROM n) AS DOUBLE) / ((SELECT count(*) FROM n) * n)) AS raw FROM n)""", """
SELECT class, n, round(raw / (SELECT sum(raw) FROM w) * (SELECT count(*) FROM w), 6) AS weight FROM w""")
put("label_index", TYPED, """
SELECT attack_type AS class, CAST(dense_rank() OVER (ORDER BY attack_type) - 1 AS INT) AS label_index, count(*) AS n
FROM fixed GROUP BY 1""")
put("stream_label", RAW + f""",
lines AS (SELECT source, {group(5)} AS p, {group(10)} AS a, {group(5)} || ' ' || {group(9)} AS pf
  FROM raw WHERE regexp_matches(value, {LINE})),
classed AS (SELECT source, CASE {' '.join(f"WHEN {like(c, p)} THEN '{n}'" for n, c, p in RULES)} ELSE 'normal' END
  AS attack_type FROM lines)""", "SELECT source, attack_type, count(*) AS n FROM classed GROUP BY ALL")
put("stream_live_features", WINDOWED, f"SELECT row_id, {', '.join(V.WINDOW_FEATURES)} FROM windows")
put("stream_bans", LOG + "," + BANS, "SELECT ip, ban_start, ban_end FROM bans")
put("stream_rate_limit", LOG, """
SELECT ip, event_s // 60 * 60 AS window_start, count(*) AS requests FROM log GROUP BY 1, 2 HAVING count(*) > 8""")

# --- training: what SQL can know of it -----------------------------------------------------------------

PARTS = CLEANED + f""",
parts AS (SELECT *, CASE WHEN s < 70 THEN 'train' WHEN s < 80 THEN 'valid' ELSE 'test' END AS split
  FROM (SELECT *, {h('split', 'row_id')} % 100 AS s FROM fixed))"""
CLASSES = """count(*) FILTER (split = 'test' AND is_attack = 1) AS positives,
  count(*) FILTER (split = 'test' AND is_attack = 0) AS negatives"""


def binary_report(*profiles: str) -> str:
    listed = ", ".join(f"({q(p)})" for p in profiles)
    return f"""
SELECT profile, {CLASSES}, CAST(1 AS INT) AS rates_ok, count(*) FILTER (split = 'train') AS train_rows,
  count(*) FILTER (split = 'valid') AS valid_rows, count(*) FILTER (split = 'test') AS test_rows
FROM parts, (VALUES {listed}) v(profile) GROUP BY profile"""


put("train_binary", PARTS, binary_report("v3", "v4"))
for _key in ("base", "weighted"):
    put(f"train_binary_{_key}", PARTS, binary_report("v3"))
put("train_multiclass", TYPED, """
SELECT attack_type AS class, count(*) AS support, CAST(1 AS INT) AS rates_ok FROM (
  SELECT attack_type, count(*) OVER (PARTITION BY attack_type) AS n, row_number() OVER (
    PARTITION BY attack_type ORDER BY md5(concat('split', CAST(row_id AS VARCHAR))), row_id) AS r FROM fixed)
WHERE r > n * 80 // 100 GROUP BY 1""")
put("train_patience", PARTS, f"""
SELECT {CLASSES}, CAST(1 AS INT) AS rates_ok, CAST(1 AS INT) AS waited, CAST(1 AS INT) AS lowest,
  count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'valid') AS valid_rows,
  count(*) FILTER (split = 'test') AS test_rows FROM parts""")
put("train_multiclass_boosted", TYPED, """
SELECT attack_type AS class, count(*) AS support, count(*) AS summed, CAST(1 AS INT) AS rates_ok FROM (
  SELECT attack_type, count(*) OVER (PARTITION BY attack_type) AS n, row_number() OVER (
    PARTITION BY attack_type ORDER BY md5(concat('split', CAST(row_id AS VARCHAR))), row_id) AS r FROM fixed)
WHERE r > n * 80 // 100 GROUP BY 1""")
put("config_search", PARTS, f"""
SELECT config, {CLASSES}, CAST(1 AS INT) AS in_grid, CAST(1 AS INT) AS rates_ok
FROM parts, (VALUES ('A_v3_baseline'), ('B_relaxed'), ('C_aggressive')) v(config) GROUP BY config""")
put("score", LABELED, """
SELECT row_id, attack_type, CAST(1 AS INT) AS score_ok, CAST(1 AS INT) AS decision_ok FROM labeled""")
_features = ", ".join(f"({q(n)})" for n in PROFILES["v3"])
ORACLE["feature_importance"] = f"SELECT feature, CAST(100 AS DOUBLE) AS total_pct FROM (VALUES {_features}) v(feature)"
ORACLE["importance_splits"] = f"SELECT feature, CAST(1 AS INT) AS counts_ok FROM (VALUES {_features}) v(feature)"
