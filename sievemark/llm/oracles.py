"""SQL for DuckDB of the training-data queries that SQL can express, over whole tables and texts."""

from __future__ import annotations

from .quality import SYMBOLS, WORDS, QualityRules

_RULES = QualityRules()
_WORD = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[A-Za-z0-9\x{80}-\x{10FFFF}]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINES = r"""
    WITH lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
        FROM documents
    ), keyed AS (
        SELECT doc_id, place, line,
               translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
        FROM lines
    ), common AS (
        SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
    )
    SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(common.k) AS BIGINT) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE common.k IS NULL), '')) AS kept_sha256
    FROM keyed LEFT JOIN common USING (k) GROUP BY doc_id
"""


def _found(kind: str, rank: int, pattern: str, value: str, test: str) -> str:
    """Places of the matches: the pieces between them and the matches before them are added up."""
    return f"""
        SELECT doc_id, '{kind}' AS kind, {rank} AS rank, start, start + length(m) AS stop, {value} AS secret FROM (
            SELECT doc_id, m, CAST(sum(length(piece) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS BIGINT) AS start FROM (
                SELECT doc_id, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS piece, generate_subscripts(ms, 1) AS i FROM (
                    SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS ps FROM docs
                )
            )
        ) WHERE {test}
    """


_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_SPELT = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"

SECRETS = f"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, source, lang FROM documents),
    base AS (
        {_found("assign", 0, _ASSIGN, f"regexp_extract(m, '{_ASSIGN}', 2)", "length(secret) >= 6")} UNION ALL
        {_found("access", 1, "AKIA[A-Z0-9]+", "m", "length(m) >= 20")} UNION ALL
        {_found("hex", 2, "[0-9a-f]+", "m", "length(m) >= 24")}
    ), opaque AS (
        {_found("opaque", 3, "[A-Za-z0-9+/_=-]+", "m", "length(m) >= 20 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND len(list_distinct(string_split(m, ''))) >= 10")}
    ), spans AS (
        SELECT * FROM base UNION ALL
        SELECT o.* FROM opaque o WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = o.doc_id AND b.start < o.stop AND o.start < b.stop)
    ), held AS (
        SELECT secret, count(DISTINCT coalesce(source, '~null')) AS owners, count(DISTINCT (coalesce(source, '~null'), coalesce(lang, '~null'))) AS repos
        FROM spans JOIN docs USING (doc_id) GROUP BY secret
    ), rated AS (
        SELECT spans.*, repos, owners <= 1 AND repos <= 3 AS live FROM spans JOIN held USING (secret)
    ), per AS (
        SELECT doc_id, {_SPELT} FILTER (rank < 3) AS base_spans, {_SPELT} FILTER (rank < 3 OR live) AS spans, count(*) FILTER (rank = 0) AS n_assign,
               count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, count(*) FILTER (live) AS n_live,
               count(*) FILTER (NOT live) AS n_copied, max(repos) AS most_repos FROM rated GROUP BY doc_id
    )
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
           coalesce(n_copied, 0) AS n_copied, coalesce(most_repos, 0) AS most_repos
    FROM docs LEFT JOIN per USING (doc_id)
"""

COMPONENTS = f"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents
    ), sets AS (
        SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 3], ' ') END AS gram
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM words)
    ), sizes AS (
        SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
    ), pairs AS (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sets x JOIN sets y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL
    ), linked AS (
        SELECT a, b FROM pairs JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * shared >= 85 * (s.n + t.n - shared)
    ), links AS (
        SELECT a, b FROM linked UNION SELECT b, a FROM linked
    ), reach AS (
        SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
    ), least_of AS (
        SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
    )
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM least_of LEFT JOIN sizes USING (doc_id)
"""

CONTAINED = f"""
    WITH words AS (
        SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents
    ), items AS (
        SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM benchmark
    ), held AS (
        SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words)
    ), wanted AS (
        SELECT DISTINCT item_id, array_to_string(w[i : i + 4], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM items)
    ), sizes AS (
        SELECT item_id, count(*) AS n FROM wanted GROUP BY item_id
    )
    SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_found FROM held JOIN wanted USING (gram) JOIN sizes USING (item_id)
    GROUP BY doc_id, item_id, n HAVING count(*) >= 0.8 * n
    UNION ALL
    SELECT doc_id, item_id, 1 AS n_shingles, 1 AS n_found
    FROM words, (SELECT item_id, ' ' || array_to_string(w, ' ') || ' ' AS gram FROM items WHERE len(w) BETWEEN 1 AND 4)
    WHERE contains(' ' || array_to_string(w, ' ') || ' ', gram)
"""

CAPTURES = r"""
    WITH p AS (
        SELECT page_id, lower(replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A')) AS url, coalesce(html, '') AS html,
               min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
    ), cut AS (
        SELECT *, sha1(html) AS hex, '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]+)?([^#]*)' AS pattern FROM p
    )
    SELECT page_id, strlen(html) AS payload_bytes,
           array_to_string(list_transform(range(32), lambda i : substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               CAST((CAST('0x' || substr(hex, i // 4 * 5 + 1, 5) AS BIGINT) >> (5 * (3 - i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to,
           CASE WHEN NOT regexp_matches(url, pattern) THEN url
                ELSE array_to_string(list_reverse(string_split(regexp_replace(regexp_extract(url, pattern, 1), '^www\.', ''), '.')), ',') || ')'
                     || CASE WHEN regexp_extract(url, pattern, 2) = '' THEN '/' ELSE regexp_extract(url, pattern, 2) END END AS url_key
    FROM cut
"""


def _distance(counts: str, reference: str) -> str:
    part = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END"
    terms = f"list_transform(list_zip(list_transform({counts}, lambda v : v / list_sum({counts})), {reference}), lambda z : {part.format('z[1]', 'z[2]')} + {part.format('z[2]', 'z[1]')})"
    return f"CASE WHEN list_sum({counts}) > 0 THEN sqrt(greatest(0, list_sum({terms}) / 2)) END"


_SYMBOL = "[" + "".join("\\" + c for c in SYMBOLS) + "]"
_STOP = r"""[.,;:!?''"()\-]"""
_COUNTED = ["[a-z]", "[A-Z]", "[0-9]", r"[ \t\n\x0b\x0c\r]", _STOP, _SYMBOL]
_SIZE = "length(regexp_replace(text, '{}', '', 'g'))"
#: Characters of each class; what is left of ASCII comes before what is beyond it.
_CLASSES = ", ".join(
    [f"length(text) - {_SIZE.format(c)}" for c in _COUNTED]
    + [f"length(regexp_replace(regexp_replace(text, '{'|'.join(_COUNTED)}', '', 'g'), '[^\\x00-\\x7f]', '', 'g'))", f"length(text) - {_SIZE.format('[^\\x00-\\x7f]')}"]
)
_LISTED = ", ".join(f"'{w}'" for w in WORDS)

QUALITY = f"""
    WITH docs AS (
        SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang FROM documents
    ), words AS (
        SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS w FROM docs)
    ), windows AS (
        SELECT doc_id, i, word, CASE WHEN lead(word, 4) OVER own IS NOT NULL
               THEN concat_ws(' ', word, lead(word) OVER own, lead(word, 2) OVER own, lead(word, 3) OVER own, lead(word, 4) OVER own) END AS gram
        FROM words WINDOW own AS (PARTITION BY doc_id ORDER BY i)
    ), often AS (
        SELECT *, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS twice FROM windows
    ), covered AS (
        SELECT *, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS repeated FROM often
    ), of_words AS (
        SELECT doc_id, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars, count(*) FILTER (repeated) AS n_repeat_words FROM covered GROUP BY doc_id
    ), of_lines AS (
        SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
        WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id
    ), letters AS (
        SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[A-Za-z\\x{{80}}-\\x{{10FFFF}}]+')) AS word FROM docs
    ), listed AS (
        SELECT doc_id, coalesce(list_position([{_LISTED}], word), {len(WORDS) + 1}) AS k, count(*) AS n FROM letters GROUP BY ALL
    ), by_word AS (
        SELECT doc_id, map_from_entries(list((k, n))) AS held FROM listed GROUP BY doc_id
    ), counts AS (
        SELECT doc_id, lang, length(text) - {_SIZE.format(_SYMBOL)} AS n_symbols, [{_CLASSES}] AS classes,
               list_transform(range(1, {len(WORDS) + 2}), lambda k : coalesce(held[k], 0)) AS words
        FROM docs LEFT JOIN by_word USING (doc_id)
    ), summed AS (
        SELECT lang, 'c' AS kind, k, sum(v) AS v FROM (SELECT lang, unnest(classes) AS v, generate_subscripts(classes, 1) AS k FROM counts) GROUP BY ALL
        UNION ALL
        SELECT lang, 'w', k, sum(v) FROM (SELECT lang, unnest(words) AS v, generate_subscripts(words, 1) AS k FROM counts) GROUP BY ALL
    ), shares AS (
        SELECT lang, kind, list(v ORDER BY k) AS vs FROM (
            SELECT lang, kind, k, CASE WHEN sum(v) OVER (PARTITION BY lang, kind) > 0 THEN v / sum(v) OVER (PARTITION BY lang, kind) ELSE 0 END AS v FROM summed
        ) GROUP BY ALL
    ), judged AS (
        SELECT c.*, {_distance("c.classes", "a.vs")} AS class_distance, {_distance("c.words", "b.vs")} AS word_distance
        FROM counts c JOIN shares a ON a.lang = c.lang AND a.kind = 'c' JOIN shares b ON b.lang = c.lang AND b.kind = 'w'
    ), joined AS (
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
               coalesce(n_repeat_words, 0) AS n_repeat_words, class_distance, word_distance
        FROM judged LEFT JOIN of_words USING (doc_id) LEFT JOIN of_lines USING (doc_id)
    ), based AS (
        SELECT *, n_words < {_RULES.min_total_words} OR 100 * n_repeat_words > {_RULES.max_repeat_percent} * n_words AS base_failed,
               coalesce(n_words >= {_RULES.min_words} AND (class_distance > {_RULES.max_class_distance}
                        OR word_distance > greatest({_RULES.max_word_distance}, {_RULES.word_noise} / sqrt(n_words))), false) AS diverges FROM joined
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT diverges AS kept FROM based
"""

AUDIT = r"""
    WITH RECURSIVE docs AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
    ), words AS (
        SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w : w <> '') AS ws FROM docs
    ), marks AS (
        SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic
        FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
    ), masks AS (
        SELECT part, doc_id, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
               + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT
               + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask
        FROM words
    ), cells AS (
        SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
        FROM masks LEFT JOIN marks USING (doc_id) GROUP BY part, mask
    ), orders AS (
        SELECT '' AS o, 0 AS used UNION ALL
        SELECT o || substr('ABCDE', i + 1, 1), used + (1 << i)
        FROM orders, (SELECT unnest(range(5))::INT AS i) WHERE used & (1 << i) = 0
    ), steps AS (
        SELECT o.o AS filter_order, len(p.o)::INT + 1 AS step, p.used AS before, 1 << (ascii(substr(o.o, len(p.o)::INT + 1, 1)) - 65) AS own
        FROM orders o JOIN orders p ON len(o.o) = 5 AND len(p.o) < 5 AND starts_with(o.o, p.o)
    ), counted AS (
        SELECT part, filter_order, step, own,
               sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept,
               sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN n ELSE 0 END) AS removed,
               sum(CASE WHEN mask & before > 0 AND mask & own > 0 THEN n ELSE 0 END) AS redundant,
               sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
               sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN good ELSE 0 END) AS good_lost,
               sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN toxic ELSE 0 END) AS toxic_lost
        FROM cells, steps GROUP BY part, filter_order, step, own
    )
    SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
           good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
    FROM counted
"""

ORACLES = {
    "op1_line_dedup": LINES,
    "op4_secret_scan": SECRETS,
    "op5_ngram_jaccard_join": COMPONENTS,
    "op6_decontamination": CONTAINED,
    "op9_warc": CAPTURES,
    "op10_quality_rules": QUALITY,
    "op11_filter_audit": AUDIT,
}
