"""The registered queries again as plain SQL over the same tables, to check results against."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from corpusloom.plans import source_queries
from corpusloom.functions.dates import MONTHS
from corpusloom.functions.sentences import MARK
from corpusloom.functions.stopwords import stop_words
from corpusloom.operators.cleanup import FILTER_LIST, LANGUAGES, PREPROCESS_LANGUAGES
from corpusloom.plans.queries import DICTIONARY, EPS, GLOSSARY, KEYWORDS, PHRASES

_B = r"[ \t\r\n]"
_W = r"[\p{L}\p{N}_]"


def _stop_words(language: str) -> tuple[str, ...]:
    """Spark's own list, asked from the running session; one is started where none runs."""
    SparkSession.builder.getOrCreate()
    return stop_words(language)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words: Iterable[str]) -> str:
    return "(" + ", ".join(_q(w) for w in words) + ")"


def _tokens(text: str, n: int = 2) -> str:
    return f"regexp_extract_all(lower({text}), '{_W}{{{n},}}')"


# --- class-based TF-IDF ------------------------------------------------------------------------------


def _weights(group: str, text: str, lang: str | None) -> str:
    stop = f"WHERE word NOT IN {_list(_stop_words(lang))}" if lang else ""
    return f"""
    words AS (SELECT {group} AS group_label, unnest({_tokens(text)}) AS word FROM documents),
    tf AS (SELECT group_label, word, count(*) AS tf FROM words {stop} GROUP BY ALL),
    totals AS (SELECT word, sum(tf) AS total FROM tf GROUP BY word),
    weights AS (SELECT group_label, word, tf, tf * ln((SELECT count(*) FROM documents) / total) AS weight
                FROM tf JOIN totals USING (word))"""


def _ctfidf(group: str, text: str, ranks: int, lang: str, include_tf: bool = False) -> str:
    word_tf = "word_tf, " if include_tf else ""
    join = "JOIN by_tf USING (group_label, rank)" if include_tf else ""
    return f"""WITH {_weights(group, text, lang)},
    top AS (SELECT *, row_number() OVER (PARTITION BY group_label ORDER BY weight DESC, word) AS rank FROM weights),
    by_tf AS (SELECT group_label, word AS word_tf,
                     row_number() OVER (PARTITION BY group_label ORDER BY tf DESC, word) AS rank FROM weights),
    norms AS (SELECT group_label, sum(abs(weight)) AS norm FROM weights GROUP BY group_label)
    SELECT group_label, word, {word_tf} CAST(rank AS INTEGER) AS rank,
           round(CASE WHEN norm = 0 THEN 0 ELSE weight / norm END, 6) AS tfidf
    FROM top JOIN norms USING (group_label) {join} WHERE rank <= {ranks}"""


def _similarity(group: str, lang: str | None) -> str:
    return f"""WITH {_weights(group, 'text', lang)},
    norms AS (SELECT group_label, sqrt(sum(weight * weight)) AS norm FROM weights GROUP BY group_label),
    products AS (SELECT a.group_label AS group_a, b.group_label AS group_b, sum(a.weight * b.weight) AS product
                 FROM weights a JOIN weights b USING (word) GROUP BY ALL),
    groups AS (SELECT DISTINCT {group} AS g FROM documents)
    SELECT x.g AS group_a, y.g AS group_b, round(coalesce(product / (na.norm * nb.norm), 0), 6) AS similarity
    FROM groups x CROSS JOIN groups y
    LEFT JOIN products ON group_a = x.g AND group_b = y.g
    LEFT JOIN norms na ON na.group_label = x.g LEFT JOIN norms nb ON nb.group_label = y.g"""


# --- sentences ---------------------------------------------------------------------------------------


def _marked(text: str) -> str:
    """Mark every candidate end, then take back the ones the exceptions rule out."""
    m = MARK
    ends = f"""regexp_replace({text}, '([.!?]["'')\\]}}]*)({_B}+)', '\\1{m}\\2{m}', 'g')"""
    ends = f"regexp_replace({ends}, '(\\.\\.){m}({_B}+){m}', '\\1\\2', 'g')"
    initial = f"((?:^|[ \\t\\r\\n{m}])\\p{{L}}\\.){m}({_B}+){m}(\\p{{L}})"
    ordinal = f"((?:^|[ \\t\\r\\n{m}])[0-9,]+\\.){m}({_B}+){m}(\\p{{Ll}})"
    for pattern in (initial, initial, ordinal, ordinal):  # neighbours share a letter: one pass sees every other
        ends = f"regexp_replace({ends}, '{pattern}', '\\1\\2\\3', 'g')"
    return ends


_PIECES = f"pieces AS (SELECT *, string_split({_marked('text')}, '{MARK}') AS p FROM documents)"
_CLEAN = r"CASE WHEN i % 2 = 0 THEN '' WHEN i = len(p) THEN rtrim(s, E' \t\r\n') ELSE s END"
_SENTENCES = (
    f"{_PIECES}, sents AS (SELECT *, list_filter(list_transform(p, lambda s, i: {_CLEAN}), lambda s: s <> '') AS s"
    " FROM pieces)"
)
_SPANS = f"""{_PIECES},
    rows AS (SELECT doc_id, p, unnest(p) AS s, unnest(range(1, len(p) + 1)) AS i FROM pieces),
    placed AS (SELECT doc_id, {_CLEAN} AS s, i,
                      coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i
                                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at
               FROM rows),
    spans AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS sentence, s,
                     CAST(start_at AS BIGINT) AS start_at, CAST(start_at + length(s) AS BIGINT) AS end_at
              FROM placed WHERE s <> '')"""


def _hits(patterns: Iterable[str], labels: Iterable[str]) -> str:
    """Every match with the sentence it starts in; whole texts are searched, as the offsets need."""
    found = [
        f"""SELECT doc_id, {k} AS k, {_q(label)} AS keyword,
            string_split(regexp_replace(text, {_q('(?i)(?:' + p + ')')}, '{MARK}\\0', 'g'), '{MARK}') AS m FROM documents"""
        for k, (p, label) in enumerate(zip(patterns, labels))
    ]
    return f"""found AS ({' UNION ALL '.join(found)}),
    parts AS (SELECT doc_id, k, keyword, unnest(m) AS part, unnest(range(1, len(m) + 1)) AS n FROM found),
    starts AS (SELECT doc_id, k, keyword, n,
                      sum(length(part)) OVER (PARTITION BY doc_id, k ORDER BY n
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS at FROM parts),
    hits AS (SELECT h.doc_id, h.k, h.keyword, h.n, s.sentence
             FROM (SELECT * FROM starts WHERE n > 1) h ASOF JOIN spans s
             ON h.doc_id = s.doc_id AND h.at >= s.start_at)"""


_CONTEXT = """coalesce(b.s, '') || ' ' || m.s || ' ' || coalesce(a.s, '')"""
_AROUND = """JOIN spans m ON m.doc_id = h.doc_id AND m.sentence = h.sentence
    LEFT JOIN spans b ON b.doc_id = h.doc_id AND b.sentence = h.sentence - 1
    LEFT JOIN spans a ON a.doc_id = h.doc_id AND a.sentence = h.sentence + 1
    JOIN documents d ON d.doc_id = h.doc_id"""


def _kwic(patterns: Iterable[str], labels: Iterable[str]) -> str:
    return f"""WITH {_SPANS}, {_hits(patterns, labels)}
    SELECT d.lang, d.source, {_CONTEXT} AS context, h.keyword, h.doc_id AS parent_id FROM hits h {_AROUND}"""


_NO_OVERLAP = f"""WITH RECURSIVE {_SPANS}, {_hits(KEYWORDS, KEYWORDS)},
    firsts AS (SELECT doc_id, sentence, min(k) AS k FROM hits GROUP BY ALL),
    candidates AS (SELECT doc_id, sentence, k, row_number() OVER (PARTITION BY doc_id ORDER BY k, sentence) AS n
                   FROM firsts),
    walk AS (
        SELECT doc_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS kept FROM documents
        UNION ALL
        SELECT w.doc_id, c.n, CASE WHEN len(list_filter(w.kept, lambda x: abs(x - c.sentence) <= 2)) > 0
                                   THEN w.kept ELSE list_append(w.kept, c.sentence) END
        FROM walk w JOIN candidates c ON c.doc_id = w.doc_id AND c.n = w.n + 1),
    last AS (SELECT doc_id, arg_max(kept, n) AS kept FROM walk GROUP BY doc_id),
    h AS (SELECT c.doc_id, c.sentence, c.k FROM candidates c JOIN last USING (doc_id)
          WHERE list_contains(kept, c.sentence))
    SELECT d.lang, d.source, {_CONTEXT} AS context, [{', '.join(_q(k) for k in KEYWORDS)}][h.k + 1] AS keyword,
           h.doc_id AS parent_id
    FROM h {_AROUND}"""


def _match_counter() -> str:
    def count(row: dict) -> str:
        flags = "" if row["exact"] else "(?i)"
        return f"len(regexp_extract_all(text, {_q(flags + '(?:' + row['regex'] + ')')}))"

    columns = []
    for level in ("category", "language"):
        for name in dict.fromkeys(row[level] for row in DICTIONARY):
            columns.append(" + ".join(count(r) for r in DICTIONARY if r[level] == name) + f" AS {name}")
    return f"SELECT doc_id, lang, source, {', '.join(columns)} FROM documents"


# --- clean-up ----------------------------------------------------------------------------------------


def _detected(text: str = "text", source: str = "documents") -> str:
    hits = ", ".join(f"len(list_filter(t, lambda w: w IN {_list(_stop_words(c))})) AS {c}_hits" for c in LANGUAGES)
    top = f"greatest({', '.join(c + '_hits' for c in LANGUAGES)})"
    pick = " ".join(f"WHEN {c}_hits = {top} THEN '{c}'" for c in LANGUAGES)
    return f"""toks AS (SELECT *, {_tokens(text)} AS t FROM {source}),
    hits AS (SELECT *, {hits} FROM toks),
    detected AS (SELECT *, CASE WHEN {top} = 0 THEN 'de' {pick} END AS language_id FROM hits)"""


def _preprocessed(lang: str) -> str:
    def kept(code: str) -> str:
        banned = sorted(set(FILTER_LIST) | set(_stop_words(code)))
        return f"list_filter({_tokens('text', 1)}, lambda w: w NOT IN {_list(banned)})"

    branches = " ".join(f"WHEN '{c}' THEN {kept(c)}" for c in PREPROCESS_LANGUAGES)
    return f"array_to_string(CASE {lang} {branches} ELSE {kept('de')} END, ' ')"


def _dates() -> str:
    german = "['Januar','Februar','März','April','Mai','Juni','Juli','August','September','Oktober','November','Dezember']"
    english = "['January','February','March','April','May','June','July','August','September','October','November','December']"
    numbers = ", ".join(f"{_q(m)}: {n}" for n, names in MONTHS.items() for m in names)
    name = "regexp_extract(lower(date), '([a-zä]+)', 1)"
    day = r"regexp_extract(date, '(?:^|[a-z] )(\d{1,2})[.,]', 1)"
    year = r"regexp_extract(date, '(\d{4})$', 1)"
    month = f"MAP {{{numbers}}}[{name}]"
    named = f"make_timestamp(CAST({year} AS BIGINT), {month}, CAST({day} AS BIGINT), 0, 0, 0)"
    return f"""WITH written AS (SELECT o_orderkey, CASE o_orderpriority
            WHEN '1-URGENT' THEN strftime(o_orderdate, '%d.%m.%Y')
            WHEN '2-HIGH' THEN day(o_orderdate) || '. ' || {german}[month(o_orderdate)] || ' ' || year(o_orderdate)
            WHEN '3-MEDIUM' THEN {english}[month(o_orderdate)] || ' ' || day(o_orderdate) || ', ' || year(o_orderdate)
            WHEN '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
            ELSE CASE o_orderstatus WHEN 'O' THEN NULL WHEN 'F' THEN 'nan' ELSE 'order ' || o_orderkey || ' undated' END
            END AS date, o_orderpriority AS p FROM orders),
    parsed AS (SELECT *, CASE p WHEN '1-URGENT' THEN try_strptime(date, '%d.%m.%Y')
            WHEN '4-NOT SPECIFIED' THEN try_strptime(date, '%Y-%m-%d %H:%M:%S')
            WHEN '2-HIGH' THEN {named} WHEN '3-MEDIUM' THEN {named} END AS ts FROM written)
    SELECT o_orderkey,
           CASE WHEN ts IS NOT NULL THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN date IS NULL THEN 'n.a.' ELSE date END
               AS date_standardized,
           CASE WHEN ts IS NOT NULL THEN 'parsed' WHEN date IS NULL THEN 'missing' WHEN date = 'nan' THEN 'nan'
                ELSE 'unparsed' END AS date_status
    FROM parsed"""


# --- annotation --------------------------------------------------------------------------------------

_SENTIMENT = f"""WITH {_SENTENCES},
    flat AS (SELECT doc_id, unnest(s) AS sentence FROM sents),
    counted AS (SELECT doc_id, len(list_filter({_tokens('sentence')}, lambda w: w IN ('good', 'the', 'und'))) AS p,
                       len(list_filter({_tokens('sentence')}, lambda w: w IN ('worthless', 'of', 'nicht'))) AS n FROM flat),
    scored AS (SELECT doc_id, avg((p - n) / (p + n)) FILTER (WHERE p <> n) AS score FROM counted GROUP BY doc_id)
    SELECT doc_id, round(coalesce(score, 0), 6) AS sentiment_score FROM documents LEFT JOIN scored USING (doc_id)"""


def _translated() -> str:
    table = "MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in GLOSSARY.items()) + "}"
    pieces = f"regexp_extract_all(text, '{_W}+|[^\\p{{L}}\\p{{N}}_]+')"
    words = f"list_transform({pieces}, lambda w: coalesce({table}[w], w))"
    return f"""SELECT doc_id, lang, CASE WHEN lang = 'de' THEN array_to_string({words}, '') ELSE text END AS translated
    FROM documents"""


# --- labels and vectors ------------------------------------------------------------------------------

_LABELLED = """labelled AS (SELECT d.*, CASE WHEN l.doc_id IS NULL THEN NULL ELSE
        concat_ws('; ', CASE WHEN quality = 1 THEN 'Good' ELSE 'Poor' END, CASE WHEN toxic = 1 THEN 'Toxic' END) END AS label
    FROM documents d LEFT JOIN labels l USING (doc_id)),
    parsed AS (SELECT doc_id, list_transform(regexp_split_to_array(lower(label), '[,;]'), lambda x: trim(x)) AS ls
               FROM labelled)"""

_SCORES = f"""{_LABELLED},
    scores AS (SELECT doc_id, n_chars / (n_chars + 900.0) AS long, 1.0 - n_chars / (n_chars + 900.0) AS short
               FROM (SELECT doc_id, label, CAST(n_chars AS DOUBLE) AS n_chars FROM labelled) WHERE label IS NULL)"""

_COMPONENTS = f"""vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    pairs AS (SELECT a.vec_id AS x, b.vec_id AS y, list_distance(a.v, b.v) AS d
              FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id AND list_distance(a.v, b.v) <= {EPS}),
    ranked AS (SELECT x, d, row_number() OVER (PARTITION BY x ORDER BY d) AS n FROM pairs),
    cores AS (SELECT x AS id, d AS core FROM ranked WHERE n = 6),
    edges AS (SELECT x, y FROM pairs WHERE x IN (SELECT id FROM cores) AND y IN (SELECT id FROM cores)),
    reach AS (SELECT id AS x, id AS y FROM cores UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y),
    members AS (SELECT x AS id, min(y) AS component FROM reach GROUP BY x),
    clusters AS (SELECT component, min(core) AS densest, row_number() OVER (ORDER BY component) - 1 AS number
                 FROM members JOIN cores USING (id) GROUP BY component HAVING count(*) >= 15),
    clustered AS (SELECT vec_id, CAST(coalesce(number, -1) AS INTEGER) AS hdbscan,
                         round(coalesce(densest / core, 0), 6) AS hdbscan_p
                  FROM embeddings LEFT JOIN members ON vec_id = members.id
                  LEFT JOIN clusters USING (component) LEFT JOIN cores ON vec_id = cores.id)"""


def _bare(token: str) -> str:
    return rf"""regexp_replace(regexp_replace(lower({token}), '^["''(\[{{]+', ''), '["'')\]}},;:]+$', '')"""


def _type(bare: str) -> str:
    kept = f"regexp_replace({bare}, '[.!?]+$', '')"
    return f"CASE WHEN regexp_matches({kept}, '^[0-9][0-9.,]*$') THEN '##number##' ELSE {kept} END"


def _mark(bare: str) -> str:
    return f"CASE WHEN regexp_matches({bare}, '[!?]$') THEN '!' WHEN regexp_matches({bare}, '(^|[^.])[.]$') THEN '.' ELSE '' END"


def _likely(k: str, n: str, p: str) -> str:
    return f"(CASE WHEN ({k}) > 0 THEN ({k}) * ln({p}) ELSE 0 END + CASE WHEN ({n}) - ({k}) > 0 THEN (({n}) - ({k})) * ln(1 - ({p})) ELSE 0 END)"


_TYPES = rf"""token_lists AS (SELECT list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda x: x <> '') AS t FROM documents),
    words AS (SELECT {_bare("token")} AS bare FROM (SELECT unnest(t) AS token FROM token_lists)),
    counted AS (SELECT {_type("bare")} AS type, {_mark("bare")} AS mark, count(*) AS n FROM words GROUP BY 1, 2 HAVING type <> ''),
    totals AS (SELECT CAST(sum(n) AS DOUBLE) AS tokens, CAST(sum(n) FILTER (mark = '.') AS DOUBLE) AS periods FROM counted),
    typed AS (SELECT type, CAST(coalesce(sum(n) FILTER (mark = '.'), 0) AS BIGINT) AS with_period,
                     CAST(coalesce(sum(n) FILTER (mark <> '.'), 0) AS BIGINT) AS without_period FROM counted GROUP BY 1),
    scored AS (SELECT type, with_period, without_period,
                      2 * (with_period * (ln(0.99) - ln(periods / tokens)) + without_period * (ln(0.01) - ln(greatest(1 - periods / tokens, 1e-300))))
                      * exp(-length(replace(type, '.', ''))) * (length(type) - length(replace(type, '.', '')) + 1)
                      * exp(-without_period * ln(CAST(length(replace(type, '.', '')) AS DOUBLE))) AS score
               FROM typed, totals WHERE with_period > 0 AND regexp_matches(type, '\p{{L}}'))"""


def oracle_sql() -> dict[str, str]:
    masters = [k + r"[ \t\r\n]+[a-z]+" for k in KEYWORDS]
    joined = """SELECT coalesce(c_custkey, o_custkey) AS c_custkey, c_name, c_nationkey, o_orderkey, o_totalprice
        FROM customer {} JOIN orders ON c_custkey = o_custkey"""
    return source_queries.ORACLE_SQL | {
        "ctfidf_lang": _ctfidf("lang", "text", 20, "english"),
        "ctfidf_source_tf": _ctfidf("source", "text", 10, "german", True),
        "ctfidf_two_groups": _ctfidf(
            """'{"lang":"' || lang || '","source":"' || source || '"}'""", "source || '. ' || text", 5, "french"
        ),
        "group_similarity": _similarity("source", "english"),
        "group_similarity_lang": _similarity("lang", None),
        "filter_orders": "SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000",
        "filter_mapper": """SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS new_id, o_orderkey AS old_id
            FROM orders WHERE o_orderstatus = 'F'""",
        "join_inner": joined.format("INNER"),
        "join_left": joined.format("LEFT"),
        "join_right": joined.format("RIGHT"),
        "join_outer": joined.format("FULL"),
        "join_null_keys": """SELECT coalesce(k, j) AS n_nationkey, n_name AS name_x, s_name AS name_y
            FROM (SELECT nullif(n_nationkey, 3) AS k, n_name FROM nation)
            FULL JOIN (SELECT nullif(s_nationkey, 5) AS j, s_name FROM supplier) ON k IS NOT DISTINCT FROM j""",
        "combine_text": """SELECT p_partkey, p_name || '. ' || coalesce(nullif(p_brand, 'Brand#13'), 'None') || '. '
            || p_type || '. ' || p_size AS combined FROM part""",
        "with_row_id": "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders",
        "append_column": "SELECT doc_id, lang, n_chars, upper(lang) AS lang_code FROM documents",
        "append_column_position": "SELECT doc_id, lang, n_chars, source AS origin FROM documents",
        "clip_rows": "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 50",
        "group_count": "SELECT lang, source, count(*) AS count FROM documents GROUP BY ALL",
        "group_count_events": """SELECT event_type, count(*) AS count FROM events WHERE event_type <> 'error'
            GROUP BY ALL""",
        "column_sums": """SELECT 'quality' AS cols, CAST(sum(quality) AS BIGINT) AS count FROM labels
            UNION ALL SELECT 'toxic', CAST(sum(toxic) AS BIGINT) FROM labels""",
        "group_concat": """SELECT conv_id, coalesce(string_agg(role, ', ' ORDER BY turn) FILTER (WHERE role <> ''), '') AS role,
            coalesce(string_agg(text, ', ' ORDER BY turn) FILTER (WHERE text <> ''), '') AS text
            FROM conversations GROUP BY conv_id""",
        "group_concat_parts": """SELECT source, doc_id // 100 AS part, string_agg(lang, ', ' ORDER BY doc_id) AS lang
            FROM documents GROUP BY ALL""",
        "sentence_spans": f"WITH {_SPANS} SELECT doc_id, sentence, start_at, end_at FROM spans",
        "segment_sentences": f"""WITH {_SENTENCES}
            SELECT doc_id, lang, unnest(list_transform(range(0, len(s), 8),
                   lambda i: array_to_string(s[i + 1 : i + 8], ' '))) AS segment FROM sents""",
        "normalize_text": r"""SELECT doc_id, regexp_replace(lower(text), '\s+', ' ', 'g') AS text FROM documents""",
        "kwic": _kwic(KEYWORDS, KEYWORDS),
        "kwic_master": _kwic(masters, KEYWORDS),
        "kwic_phrases": _kwic(PHRASES, PHRASES),
        "kwic_no_overlap": _NO_OVERLAP,
        "match_counter": _match_counter(),
        "detect_language": f"WITH {_detected()} SELECT doc_id, lang, language_id FROM detected",
        "language_stats": f"WITH {_detected()} SELECT language_id, count(*) AS count FROM detected GROUP BY language_id",
        "standardize_dates": _dates(),
        "preprocess_text": f"SELECT doc_id, {_preprocessed('lang')} AS text_preprocessed FROM documents",
        "standard_cleanup": f"""WITH {_detected()}, dated AS ({_dates()})
            SELECT doc_id, coalesce(date_standardized, 'n.a.') AS date_standardized, language_id,
            {_preprocessed('language_id')} AS text_preprocessed FROM detected LEFT JOIN dated ON o_orderkey = doc_id""",
        "sentiment_lexicon": _SENTIMENT,
        "map_text_where": _translated(),
        "sentiment_model": f"""WITH {_SENTENCES},
            flat AS (SELECT doc_id, unnest(s) AS sentence FROM sents),
            said AS (SELECT doc_id, CASE WHEN contains(sentence, '?') THEN 0.0
                            ELSE (length(sentence) % 7 + 1) / 10.0 * (length(sentence) % 3 - 1) END AS score,
                            NOT contains(sentence, '?') AND length(sentence) % 3 = 1 AS neutral FROM flat),
            scored AS (SELECT doc_id, avg(CAST(score AS DOUBLE)) FILTER (NOT neutral) AS score FROM said GROUP BY doc_id)
            SELECT doc_id, round(coalesce(score, 0), 6) AS sentiment_score FROM documents LEFT JOIN scored USING (doc_id)""",
        "map_text_model": """SELECT doc_id, lang, CASE WHEN lang = 'fr' AND NOT contains(text, '|')
            THEN length(text) || ':' || substring(text, 1, 7) ELSE text END AS translated FROM documents""",
        "encode_model": """SELECT doc_id, unnest([0, 1, 2])::BIGINT AS dimension,
            unnest([length(text), length(text) - length(replace(text, 'e', '')), 0.5])::DOUBLE AS value FROM documents""",
        "encode_hash_norm": f"""SELECT doc_id, CASE WHEN len({_tokens('text', 1)}) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm
            FROM documents""",
        "vector_json_roundtrip": """SELECT vec_id, unnest(range(0, len(embedding))) AS dimension,
            round(CAST(unnest(embedding) AS DOUBLE), 6) AS value FROM embeddings""",
        "combine_features": """SELECT vec_id, unnest(range(0, len(f))) AS dimension, round(unnest(f), 6) AS value
            FROM (SELECT vec_id, list_append(CAST(embedding AS DOUBLE[]), CAST(label AS DOUBLE)) AS f FROM embeddings)""",
        "validate_collection": """SELECT doc_id, CASE WHEN lang = 'es' THEN 'corpusName is missing; ' ELSE '' END
            || 'date is not timestamp' AS errors FROM documents""",
        "abbreviation_scores": f"WITH {_TYPES} SELECT type, with_period, without_period, round(score, 4) AS score FROM scored",
        "starter_scores": f"""WITH {_TYPES},
            pairs AS (SELECT list_transform(range(1, len(t)), lambda i: {{'a': t[i], 'b': t[i + 1]}}) AS ps FROM token_lists),
            ends AS (SELECT p.a AS a, p.b AS b FROM (SELECT unnest(ps) AS p FROM pairs) WHERE regexp_matches(p.a, '[.!?]["'')\\]}},;:]*$')),
            marked AS (SELECT {_type(_bare("a"))} AS type, {_mark(_bare("a"))} AS mark, {_type(_bare("b"))} AS next FROM ends),
            kept AS (SELECT next FROM marked WHERE mark <> '' AND next <> '' AND type IS NOT NULL
                     AND NOT (mark = '.' AND type IN (SELECT type FROM scored WHERE score >= 0.3))),
            behind AS (SELECT next AS type, count(*) AS behind FROM kept GROUP BY 1),
            sums AS (SELECT type, CAST(sum(n) AS BIGINT) AS n FROM counted GROUP BY 1),
            four AS (SELECT type, n, behind, CAST((SELECT count(*) FROM kept) AS DOUBLE) AS a, CAST(n AS DOUBLE) AS b,
                            CAST(least(behind, n) AS DOUBLE) AS k, CAST((SELECT sum(n) FROM counted) AS DOUBLE) AS t
                     FROM sums JOIN behind USING (type) WHERE regexp_matches(type, '\\p{{L}}')),
            ratios AS (SELECT type, n, behind, k * t > a * b AS more, 2 * ({_likely("k", "a", "k / a")} + {_likely("b - k", "t - a", "(b - k) / (t - a)")}
                              - {_likely("k", "a", "b / t")} - {_likely("b - k", "t - a", "b / t")}) AS ratio FROM four)
            SELECT type, n, behind, round(CASE WHEN more THEN ratio ELSE -ratio END, 4) AS score FROM ratios""",
        "kernel_products": "SELECT vec_id, true AS near FROM embeddings WHERE vec_id + 1 IN (SELECT vec_id FROM embeddings)",
        "language_posterior": """WITH low AS (SELECT doc_id, lang, lower(text) AS text FROM documents),
            grams AS (SELECT doc_id, lang, substr(text, CAST(i AS BIGINT), 3) AS gram FROM (SELECT *, unnest(range(1, length(text) - 1)) AS i FROM low)),
            counts AS (SELECT lang, gram, count(*) AS n FROM grams GROUP BY ALL),
            totals AS (SELECT lang, sum(n) AS total FROM counts GROUP BY 1),
            langs AS (SELECT lang, ln(count(*) / (SELECT count(*) FROM low)) AS prior FROM low GROUP BY 1),
            size AS (SELECT count(DISTINCT gram) + 1 AS distinct_grams FROM counts),
            own AS (SELECT doc_id, gram, count(*) AS times FROM grams GROUP BY ALL),
            scored AS (SELECT d.doc_id, l.lang, l.prior + coalesce(sum(o.times * ln((coalesce(c.n, 0) + 0.5) / (t.total + 0.5 * distinct_grams))), 0) AS score
                       FROM low d CROSS JOIN langs l JOIN totals t ON t.lang = l.lang CROSS JOIN size LEFT JOIN own o ON o.doc_id = d.doc_id
                            LEFT JOIN counts c ON c.gram = o.gram AND c.lang = l.lang GROUP BY d.doc_id, l.lang, l.prior)
            SELECT doc_id, lang AS language, round(score, 3) AS score FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1""",
        "match_counts": """WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM benchmark),
            low AS (SELECT doc_id, lower(text) AS text FROM documents),
            found AS (SELECT doc_id, word, CAST((length(text) - length(replace(text, word, ''))) // length(word) AS BIGINT) AS n
                      FROM low JOIN words ON contains(text, word))
            SELECT doc_id, word AS node, n FROM found
            UNION ALL SELECT doc_id, 'initial ' || left(word, 1), CAST(sum(n) AS BIGINT) FROM found GROUP BY ALL""",
        "density_cluster": f"WITH RECURSIVE {_COMPONENTS} SELECT vec_id, hdbscan, CASE WHEN hdbscan < 0 THEN 0.0 ELSE hdbscan_p END AS hdbscan_p FROM clustered",
        "cluster_sizes": f"WITH RECURSIVE {_COMPONENTS} SELECT hdbscan, count(*) AS count FROM clustered GROUP BY hdbscan",
        "parse_labels": f"WITH {_LABELLED} SELECT doc_id, array_to_string(ls, '|') AS labels FROM parsed",
        "label_classes": f"WITH {_LABELLED} SELECT DISTINCT unnest(ls) AS class FROM parsed",
        "binarize_labels": f"""WITH {_LABELLED} SELECT doc_id, CAST(list_contains(ls, 'good') AS INTEGER) AS good,
            CAST(list_contains(ls, 'poor') AS INTEGER) AS poor, CAST(list_contains(ls, 'toxic') AS INTEGER) AS toxic
            FROM parsed""",
        "query_set_length": f"""WITH {_SCORES},
            first AS (SELECT doc_id, 1 - greatest(long, short) AS score FROM scores ORDER BY score DESC, doc_id LIMIT 7),
            second AS (SELECT doc_id, least(long, short) - greatest(long, short) AS score FROM scores
                       WHERE doc_id NOT IN (SELECT doc_id FROM first) ORDER BY score DESC, doc_id LIMIT 7)
            SELECT CAST(0 AS BIGINT) AS strategy_no, 'uncertainty' AS strategy, doc_id, round(score, 6) AS score FROM first
            UNION ALL SELECT 1, 'margin', doc_id, round(score, 6) FROM second""",
        "classwise_length": f"""WITH {_SCORES},
            flat AS (SELECT doc_id, 'long' AS class, long AS value FROM scores
                     UNION ALL SELECT doc_id, 'short', short FROM scores),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY abs(value - 1.0), doc_id) AS rank FROM flat)
            SELECT doc_id, class, round(value, 6) AS value, rank FROM ranked WHERE rank <= 7""",
        "nearest_per_column": """WITH flat AS (SELECT p_partkey, 'p_size' AS class, CAST(p_size AS DOUBLE) AS value FROM part
                UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY abs(value - 25), p_partkey) AS rank FROM flat)
            SELECT p_partkey, class, value, rank FROM ranked WHERE rank <= 10""",
    }
