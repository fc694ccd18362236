"""The queries of this folder and, where SQL can express them, their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.llm import common, structure_queries
from corpusloom.llm.ann import nearest
from corpusloom.llm.chat import InstructTemplate, format_chats, read_back
from corpusloom.llm.decontam import benchmark_leaks
from corpusloom.llm.licenses import scan_licenses
from corpusloom.llm.lm import score_texts
from corpusloom.llm.mixing import count_words, mix_sources
from corpusloom.llm.neardup import near_duplicates
from corpusloom.llm.quality import fit
from corpusloom.llm.substring import remove_repeats
from corpusloom.llm.suffix import maximal_repeats


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark, sf_dir):
    """Words that a mix of all sources takes from every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", count_words(F.col("text")).alias("size"))
    rows, _ = mix_sources(common.stored(docs))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op2_decontaminate(spark, sf_dir):
    """Documents that hold benchmark items, verbatim or with other numbers, names and units."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return benchmark_leaks(docs, table(spark, sf_dir, "benchmark"))


def op3_quality_classifier(spark, sf_dir):
    """Quality and toxicity of every document, and whether it is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fit(docs, table(spark, sf_dir, "labels")).score(docs).drop("text")


def op4_lm_scores(spark, sf_dir):
    """Unigram and log-bilinear log10 probabilities of every text."""
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_format_chats(spark, sf_dir):
    """Conversations formatted, and what can be read back from the result."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], turns.schema)
    chats = format_chats(turns.unionByName(extra))
    return chats.select("conv_id", read_back(F.col("formatted"), F.col("spans")).alias("got")).select("conv_id", "got.*")


def op7_nearest_neighbours(spark, sf_dir):
    """Ten nearest neighbours of every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op8_license_scan(spark, sf_dir):
    """Licence notices in documents, with coverage and place."""
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_minhash_near_dedup(spark, sf_dir):
    """Components of documents that share 80 % of their 4-word shingles."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, shingle=4).select("doc_id", "n_shingles", "component_id", "kept")


def op9_substring_dedup(spark, sf_dir):
    """Words in windows of 13 that also start in a smaller document, removed."""
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_suffix_array_dedup(spark, sf_dir):
    """Maximal repeats of 50 words or more that a smaller document has too."""
    return maximal_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_lm_scores": op4_lm_scores,
    "op5_format_chats": op5_format_chats,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_license_scan": op8_license_scan,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
} | structure_queries.QUERIES
_CONTROLS = "|".join(c.replace("[", r"\[").replace("]", r"\]") for c in InstructTemplate.CONTROLS)
ORACLE_SQL = {
    "op7_nearest_neighbours": """
WITH vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
              WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
near AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, c.v),
                lambda x: (x[1] - x[2]) * (x[1] - x[2])), lambda a, b: a + b)) AS score
         FROM vecs q JOIN vecs c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM near QUALIFY rank <= 10""",
    "op5_format_chats": rf"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (SELECT *, length(regexp_replace(text, '(\\|{_CONTROLS})', '\\\1', 'g')) AS body FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(body + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 4
                            ELSE 19 + length(regexp_replace(role, '(\\|{_CONTROLS})', '\\\1', 'g')) END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id""",
    "op1_mix_sources": r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
               FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM sized GROUP BY source),
weighed AS (SELECT *, CAST(number % 3 + 1 AS DOUBLE) AS weight, 3.0 * source_size / (number % 3 + 1) AS ratio FROM sources),
leveled AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3.0 * source_size) OVER (ORDER BY ratio, number
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, number
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
rest AS (SELECT first(level ORDER BY ratio, number) AS level FROM leveled WHERE ratio > level),
targets AS (SELECT source, source_size, CAST(least(3.0 * source_size, weight * (SELECT level FROM rest)) AS DOUBLE) AS target
            FROM weighed),
quotas AS (SELECT *, least(CAST(floor(target + 1e-6) AS BIGINT), 3 * source_size) AS quota FROM targets),
laid AS (SELECT s.*, q.source_size, q.target, q.quota,
                sum(size) OVER (PARTITION BY s.source ORDER BY md5('mix:' || doc_id), doc_id, size
                                ROWS UNBOUNDED PRECEDING) - size AS start
         FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE
       quota // source_size * size + greatest(0, least(start + size, quota % source_size) - start) END AS BIGINT) AS taken
FROM laid""",
} | structure_queries.ORACLE_SQL
