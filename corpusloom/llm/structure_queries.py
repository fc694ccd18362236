"""The queries of packing, conversation repair and the conversation trie, and SQL for the last two."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.llm.packing import pack_documents
from corpusloom.llm.repair import damaged, repair_conversations
from corpusloom.llm.trie import conversation_trie

TOKENIZER = "byte_bpe_50k.json"


def op11_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Tokens of all documents packed into sequences of 2,048."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    packing = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), tokenizer)
    pieces = packing.pieces.select("doc_id", "piece", "start", "length", "part", "local", F.crc32("ids").alias("ids_crc32"))
    return packing.place(pieces)


def op12_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations repaired with the cheapest edits."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair_conversations(damaged(turns), copies_col="copies")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of conversations that share first turns."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return conversation_trie(turns, share_first=True)


QUERIES = {
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_repair_conversations": op12_repair_conversations,
    "op13_conversation_trie": op13_conversation_trie,
}

_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([CAST(i AS BIGINT)], CAST(range(8) AS BIGINT[])),
    lambda a, k: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t)"""


def _crc(text: str) -> str:
    """CRC-32 of an ASCII string in SQL, with ``crc_table`` in reach."""
    codes = f"list_transform(string_split({text}, ''), lambda s: CAST(ascii(s) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295)"


def _add(state: str, cost: str, edit: str, line: str | None = None) -> str:
    """A state with one more edit: ``k`` is nine digits of cost and the audit, ``o`` the repaired lines."""
    lines = f"list_append({state}.o, {line})" if line else f"{state}.o"
    return f"{{'k': printf('%09d', CAST(left({state}.k, 9) AS BIGINT) + {cost}) || substr({state}.k, 10) || '{edit}', 'o': {lines}}}"


def _least(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


def _repair_sql() -> str:
    nothing = "{'k': '900000000', 'o': CAST([] AS VARCHAR[])}"
    user, assistant = "'user:'", "'assistant:'"
    keep, change = "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END", "CASE WHEN fault = 'truncated' THEN 6 ELSE 3 END"
    own = "role || ':' || text"

    def after(state: str, before: str, initial: str, line: str | None) -> str:
        ways = [f"CASE WHEN stays AND left(role, 1) = '{initial}' THEN {_add(b, keep, 'K', own)} ELSE {nothing} END" for b in before]
        if line:
            ways += [f"CASE WHEN stays THEN {_add(b, change, 'R', f'{line} || text')} ELSE {nothing} END" for b in before]
        return _least(_add(state, "4", "D"), *ways)

    def closed(source: str) -> str:
        with_user = _least("u", *(_add(b, "3", "I", user) for b in "esa"))
        return f"SELECT conv_id, n, e, s, u, {_least('a', _add('u', '3', 'I', assistant))} AS a FROM (SELECT conv_id, n, e, s, {with_user} AS u, a FROM ({source}))"

    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""
WITH RECURSIVE {_TABLE},
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 {_crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
          FROM conversations, crc_table),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM given),
lined AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS n FROM damaged),
judged AS (SELECT conv_id, n, turn, role, text, CASE WHEN rtrim(text, {blank}) = '' THEN 'blank'
                  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
                  WHEN right(rtrim(text, {blank}), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair FROM lined),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
                   count(*) AS lines FROM judged GROUP BY conv_id),
steps AS ({closed(f"SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, {{'k': '000000000', 'o': CAST([] AS VARCHAR[])}} AS e, {nothing} AS s, {nothing} AS u, {nothing} AS a FROM judged")}
          UNION ALL
          {closed(f'''SELECT conv_id, n, {_add("e", "4", "D")} AS e, {after("s", "e", "s", None)} AS s, {after("u", "esa", "u", user)} AS u,
                             {after("a", "u", "a", assistant)} AS a
                      FROM (SELECT p.conv_id, r.n, p.e, p.s, p.u, p.a, r.role, r.text, r.fault, r.fault NOT IN ('blank', 'duplicate') AS stays
                            FROM steps p JOIN judged r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.n = p.n + 1)''')}),
ended AS (SELECT p.conv_id, list_min([p.e, p.a]) AS best, c.* EXCLUDE (conv_id, lines)
          FROM steps p JOIN counted c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.lines = p.n)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(left(best.k, 9) AS BIGINT), 0) AS cost,
       coalesce(substr(best.k, 10), '') AS audit, sha256(coalesce(array_to_string(best.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN ended d ON d.conv_id IS NOT DISTINCT FROM g.conv_id"""


_TRIE_SQL = rf"""
WITH {_TABLE},
turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, {_crc("CAST(c AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id AS c FROM turns), crc_table),
rebuilt AS (SELECT c, 0 AS part, place, role, text FROM convs JOIN turns ON conv_id = c - c % 20 AND place < h
            UNION ALL SELECT c, 1, place, role, text FROM convs JOIN turns ON conv_id = c AND place >= h),
placed AS (SELECT c, row_number() OVER w AS depth, string_agg(md5(length(role) || ':' || role || text), '') OVER w AS path,
                  len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
           FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY part, place ROWS UNBOUNDED PRECEDING)),
paths AS (SELECT c, depth, path, words FROM placed UNION ALL SELECT c, 0, '', 0 FROM convs),
lengths AS (SELECT c, max(depth) AS depth FROM paths GROUP BY c),
ends AS (SELECT p.depth, p.path, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends_sha256
         FROM paths p JOIN lengths l USING (c, depth) GROUP BY p.depth, p.path),
nodes AS (SELECT depth, path, min(c) AS conv, count(*) AS n_convs, max(words) AS words FROM paths GROUP BY depth, path),
kids AS (SELECT depth - 1 AS depth, left(path, 32 * (depth - 1)) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
tree AS (SELECT n.*, coalesce(n_children, 0) AS n_children, e.ends_sha256, up.conv AS parent
         FROM nodes n LEFT JOIN kids k ON k.depth = n.depth AND k.path = n.path LEFT JOIN ends e ON e.depth = n.depth AND e.path = n.path
              LEFT JOIN nodes up ON up.depth = n.depth - 1 AND up.path = left(n.path, 32 * (n.depth - 1))),
below AS (SELECT p.depth, p.path, count(*) FILTER (w.n_children = 0) AS n_leaves, sum((w.n_convs - 1) * w.words) AS saved
          FROM tree w JOIN paths p ON p.c = w.conv AND p.depth <= w.depth GROUP BY p.depth, p.path)
SELECT conv AS conv_id, t.depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
       coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM tree t JOIN below b ON b.depth = t.depth AND b.path = t.path"""

ORACLE_SQL = {"op12_repair_conversations": _repair_sql(), "op13_conversation_trie": _TRIE_SQL}
