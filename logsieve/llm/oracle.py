"""SQL twins, for DuckDB, of the operators that SQL can express."""

from logsieve.llm.license_rules import CONFIDENCE, RULES
from logsieve.llm.licenses import LOWER, SEPARATORS, UPPER

_WHITE = r"[\x20\x09-\x0D]"

OP6 = rf"""
WITH norm AS (
    SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '{_WHITE}+', '', 'g') AS body FROM documents
), ranked AS (
    SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY size DESC, doc_id NULLS LAST) AS keep_id,
        count(*) OVER (PARTITION BY body) AS group_size
    FROM norm
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(body) AS text_sha256 FROM ranked
"""

# The production setting: two lines at a time, and single lines of 50 words.
OP7 = rf"""
WITH raw AS (
    SELECT doc_id, text, unnest(string_split(text, chr(10))) AS form, generate_subscripts(string_split(text, chr(10)), 1) AS raw
    FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), line AS (
    SELECT doc_id, text, form, raw, trim(form, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM raw
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY raw) - 1 AS pos FROM line WHERE body <> ''
), pair AS (
    SELECT doc_id, pos, struct_pack(a := body, b := lead(body) OVER (PARTITION BY doc_id ORDER BY pos)) AS two,
        lead(body) OVER (PARTITION BY doc_id ORDER BY pos) IS NOT NULL AS whole
    FROM numbered
), first AS (
    SELECT *, first_value(doc_id) OVER w AS first_doc, first_value(pos) OVER w AS first_pos
    FROM pair WHERE whole WINDOW w AS (PARTITION BY two ORDER BY doc_id, pos)
), later AS (
    SELECT doc_id, pos FROM first WHERE CASE WHEN doc_id = first_doc THEN pos - first_pos >= 2 ELSE true END
), single AS (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS copy FROM numbered
    WHERE length(body) - length(translate(body, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) + 1 >= 50
), gone AS (
    SELECT doc_id, pos FROM later UNION SELECT doc_id, pos + 1 FROM later UNION SELECT doc_id, pos FROM single WHERE copy > 1
), marked AS (
    SELECT l.doc_id, l.raw, l.form, n.pos IS NOT NULL AS full_line, g.pos IS NOT NULL AS goes
    FROM line l LEFT JOIN numbered n USING (doc_id, raw) LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.pos = n.pos
), kept AS (
    SELECT doc_id, count(*) FILTER (WHERE full_line) AS n_lines, (count(*) FILTER (WHERE goes))::INT AS n_removed,
        coalesce(string_agg(form, chr(10) ORDER BY raw) FILTER (WHERE NOT goes), '') AS text
    FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0)::INT AS n_removed, coalesce(k.text, d.text) AS text
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

OP5 = rf"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), per AS (
    SELECT source, sum(size)::BIGINT AS source_size,
        CAST(list_extract([5, 2, 1], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT) AS DOUBLE) AS weight
    FROM sized GROUP BY source
), capped AS (
    SELECT *, source_size * 2.0::DOUBLE AS cap, (source_size * 2.0::DOUBLE) / weight AS full_at FROM per
), levels AS (
    SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
        - coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM capped
), goals AS (
    SELECT source, source_size, CASE WHEN top IS NULL THEN cap ELSE least(cap, top * weight) END AS target
    FROM (SELECT *, max(level) FILTER (WHERE level <= full_at) OVER () AS top FROM levels)
), block AS (
    SELECT b, round_even(total / b, 0)::BIGINT AS n
    FROM (SELECT coalesce(sum(target), 0) AS total, greatest(1, least(64, coalesce(ceil(sum(target) / 262144), 1)))::BIGINT AS b FROM goals)
), parts AS (
    SELECT source, floor((upper - target) / total * 4294967296)::BIGINT AS low, floor(upper / total * 4294967296)::BIGINT AS high
    FROM (SELECT source, target, sum(target) OVER (ORDER BY source NULLS LAST) AS upper, sum(target) OVER () AS total FROM goals WHERE target > 0)
), slots AS (
    SELECT source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
    FROM (SELECT i AS slot, (i * 2654435769) % 4294967296 AS point FROM (SELECT unnest(range(n)) AS i FROM block)) p JOIN parts ON low <= point AND point < high
), taken AS (
    SELECT s.source, rank % blocks AS block, count(*) AS times
    FROM slots s JOIN (SELECT source, ceil(source_size / b)::BIGINT AS blocks FROM goals, block) g ON s.source IS NOT DISTINCT FROM g.source
    WHERE rank < 2 * blocks GROUP BY ALL
), placed AS (
    SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT, doc_id NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM sized WHERE size > 0
), pieces AS (
    SELECT doc_id, source, size, start, b, unnest(range(start // b, (start + size - 1) // b + 1)) AS block FROM placed, block
), got AS (
    SELECT p.doc_id, p.source, p.size,
        sum((least(start + size, (p.block + 1) * b) - greatest(start, p.block * b)) * coalesce(times, 0))::BIGINT AS taken
    FROM pieces p LEFT JOIN taken t ON p.source IS NOT DISTINCT FROM t.source AND p.block = t.block GROUP BY p.doc_id, p.source, p.size, p.start
    UNION ALL SELECT doc_id, source, size, 0 FROM sized WHERE size = 0
)
SELECT doc_id, size, source_size, target, taken FROM got JOIN goals ON got.source IS NOT DISTINCT FROM goals.source
"""

_RULES = ", ".join(f"({i}, '{r.label}', {r.level}, '{r.keyword}', '{r.pattern}', {str(r.base).lower()})" for i, r in enumerate(RULES))

OP11 = rf"""
WITH rules(rule, label, level, keyword, pattern, base) AS (VALUES {_RULES}),
plain AS (
    SELECT row_number() OVER () AS id, doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}', '  ', 'g'), ' ') AS body
    FROM documents
), word AS (
    SELECT id, doc_id, CASE WHEN body = '' THEN '' ELSE ' ' || body || ' ' END AS words FROM plain
), marked AS (
    SELECT id, rule, label, level, base,
        list_filter(string_split(regexp_replace(words, pattern, ' ' || chr(1) || ' \0 ' || chr(2) || ' ', 'g'), ' '), lambda w: w <> '') AS token
    FROM word JOIN rules ON contains(words, keyword) WHERE regexp_matches(words, pattern)
), mark AS (
    SELECT id, rule, label, level, base, w, i - 1 AS i
    FROM (SELECT id, rule, label, level, base, unnest(token) AS w, generate_subscripts(token, 1) AS i FROM marked) t WHERE w IN (chr(1), chr(2))
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY id, rule, w ORDER BY i) - 1 AS k FROM mark
), hit AS (
    SELECT a.id, a.rule, a.label, a.level, a.base, a.i - 2 * a.k AS first, b.i - 2 * b.k - 2 AS last
    FROM numbered a JOIN numbered b ON a.id = b.id AND a.rule = b.rule AND a.k = b.k AND a.w = chr(1) AND b.w = chr(2)
), kept AS (
    SELECT * FROM hit a WHERE base OR NOT EXISTS (
        SELECT 1 FROM hit b WHERE b.id = a.id AND b.first <= a.first AND b.last >= a.last AND b.level <= a.level
            AND (b.first < a.first OR b.last > a.last OR b.level < a.level OR b.rule < a.rule))
), each AS (
    SELECT id, count(*) FILTER (WHERE base) AS n_base, min(first) FILTER (WHERE base) AS first_word, max(first) FILTER (WHERE base) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
        max([{", ".join(map(str, CONFIDENCE))}][level + 1])::DOUBLE AS score
    FROM kept GROUP BY id
)
SELECT doc_id, ((length(words) - length(replace(words, ' ', ''))) // 2)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
    first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
    coalesce(score, 0)::DOUBLE AS score
FROM word LEFT JOIN each USING (id)
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP13 = rf"""
WITH said AS (
    SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_TERM}') AS terms FROM documents
), asked AS (
    SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_TERM}') AS terms FROM benchmark
), total AS (
    SELECT count(*) FILTER (WHERE len(terms) > 0)::BIGINT AS big_n, coalesce(sum(len(terms)), 0)::BIGINT AS big_l FROM said
), posting AS (
    SELECT id, term, count(*)::BIGINT AS tf FROM (SELECT id, unnest(terms) AS term FROM said) t GROUP BY ALL
), weighed AS (
    SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM posting GROUP BY term) t, total
), query AS (
    SELECT item, term, count(*)::BIGINT AS times FROM (SELECT item, unnest(terms) AS term FROM asked) t GROUP BY ALL
), sized AS (
    SELECT id, doc_id, 25 + (75 * len(terms)::BIGINT * big_n) // greatest(1, big_l) AS m FROM said, total
), scored AS (
    SELECT item, id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM query JOIN weighed USING (term) JOIN posting USING (term) JOIN sized USING (id) GROUP BY ALL
), ranked AS (
    SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank
    FROM scored JOIN sized USING (id) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked JOIN asked USING (item) WHERE rank <= 10
"""

# The checksum of a decimal, bit by bit: each byte goes in at its first of eight steps.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT],
    flatten(list_transform(string_split({0}::VARCHAR, ''), lambda ch: [ord(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))), 4294967295::BIGINT)"""

OP12 = f"""
WITH said AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) - 1 AS idx FROM said
), plan AS (
    SELECT conv_id, conv_id - conv_id % 5 AS donor, {_CRC.format("conv_id")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM said) c
), turns AS (
    SELECT p.conv_id, 0 AS part, idx, role, text FROM plan p JOIN numbered n ON n.conv_id = p.donor AND idx < h
    UNION ALL SELECT p.conv_id, 1, idx, role, text FROM plan p JOIN numbered n ON n.conv_id = p.conv_id AND idx >= h
), seq AS (
    SELECT p.conv_id, coalesce(list(struct_pack(r := role, t := text) ORDER BY part, idx) FILTER (WHERE idx IS NOT NULL), []) AS own
    FROM plan p LEFT JOIN turns USING (conv_id) GROUP BY p.conv_id
), member AS (
    SELECT conv_id, own, unnest(range(len(own) + 1)) AS depth FROM seq
), keyed AS (
    SELECT *, list_slice(own, 1, depth) AS key FROM member
), node AS (
    SELECT key, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs,
        coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(own) = depth), '') AS ends,
        count(*) FILTER (WHERE len(own) = depth) AS n_ends
    FROM keyed GROUP BY key
), below AS (
    SELECT a.conv_id, a.depth, count(*) FILTER (WHERE n.depth = a.depth + 1) AS n_children, count(*) FILTER (WHERE n.n_convs = n.n_ends) AS n_leaves,
        sum((n.n_convs - 1) * coalesce(strlen(n.key[-1].t), 0)) AS saved_tokens
    FROM node n, unnest(range(n.depth + 1)) r(d) JOIN node a ON a.key = list_slice(n.key, 1, d) GROUP BY ALL
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children,
    n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM node n JOIN below b ON b.conv_id = n.conv_id AND b.depth = n.depth LEFT JOIN node p ON n.depth > 0 AND p.key = list_slice(n.key, 1, n.depth - 1)
"""

ORACLE = {"op5_mixing": OP5, "op6_exact_dedup": OP6, "op7_line_runs": OP7, "op11_licenses": OP11, "op12_conversation_trie": OP12, "op13_lexical_search": OP13}
