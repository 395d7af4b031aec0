"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import read_documents, ship
from tidewatch.llm.embedding_dedup import near_vectors
from tidewatch.llm.exact_dedup import exact_dedup
from tidewatch.llm.language_id import held_out, identify
from tidewatch.llm.line_dedup import dedup_lines
from tidewatch.llm.lexical_search import search
from tidewatch.llm.license_scan import scan_licenses
from tidewatch.llm.mixing import mix_sources
from tidewatch.llm.neighbours import nearest
from tidewatch.llm.packing import pack_documents
from tidewatch.llm.phrases import collocations
from tidewatch.llm.quality import score_quality
from tidewatch.llm.simhash import simhash_groups
from tidewatch.llm.token_files import read_token_files, write_token_files
from tidewatch.session import scratch_path


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(read_documents(spark, sf_dir))
    return cleaned.select("doc_id", F.col("lines.all").alias("n_lines"), F.col("lines.dropped").alias("n_dropped"),
                          F.col("lines.near").alias("n_near"),
                          F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(read_documents(spark, sf_dir), labels).drop("_row")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_documents(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read_documents(spark, sf_dir)).select(
        "doc_id", "fingerprint", "component_id", "group_size", "is_kept")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken", "copies")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_documents(spark, sf_dir), ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    path = scratch_path(spark, "token-files")
    write_token_files(docs, path, word_tokenizer(), end_id=2)
    copy = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.lit(1))) - 1
    keys = docs.select("doc_id").withColumn("copy", copy)
    return read_token_files(spark, path, keys).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_documents(spark, sf_dir))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_documents(spark, sf_dir), word_tokenizer(), end_id=1).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_documents(spark, sf_dir))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, after the executors have its code."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


LLM_QUERIES = {
    "op1_line_dedup": shipped(op1_line_dedup),
    "op2_quality": shipped(op2_quality),
    "op3_license_scan": shipped(op3_license_scan),
    "op4_simhash": shipped(op4_simhash),
    "op5_mixing": shipped(op5_mixing),
    "op6_language_id": shipped(op6_language_id),
    "op7_token_files": shipped(op7_token_files),
    "op8_exact_dedup": shipped(op8_exact_dedup),
    "op9_neighbours": shipped(op9_neighbours),
    "op10_packing": shipped(op10_packing),
    "op11_collocations": shipped(op11_collocations),
    "op12_lexical_search": shipped(op12_lexical_search),
    "op13_embedding_dedup": shipped(op13_embedding_dedup),
}

LLM_ORACLES = {
    "op1_line_dedup": r"""
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS every FROM documents),
        lines AS (SELECT doc_id, i AS line, every[i] AS content,
                         regexp_extract_all(every[i], '[^\x20\x09-\x0D]+') AS words
                  FROM split, unnest(range(1, len(every) + 1)) AS r(i)),
        spelled AS (SELECT doc_id, line, content, words, len(words) AS n,
                           array_to_string(words, ' ') AS spelling FROM lines),
        classes AS (SELECT spelling, any_value(words) AS words, any_value(n) AS n,
                           min((doc_id, line)) AS earliest FROM spelled WHERE n > 0 GROUP BY spelling),
        variants AS (SELECT spelling, earliest, 0 AS i, spelling AS variant FROM classes WHERE n >= 4
                     UNION ALL
                     SELECT spelling, earliest, i,
                            array_to_string(list_concat(words[1:i - 1], words[i + 1:]), ' ')
                     FROM classes, unnest(range(1, n + 1)) AS r(i) WHERE n >= 5),
        near AS (SELECT DISTINCT a.spelling FROM variants a JOIN variants b USING (variant)
                 WHERE (a.i = b.i OR a.i = 0 OR b.i = 0) AND b.earliest < a.earliest),
        judged AS (SELECT doc_id, line, content, near.spelling IS NOT NULL AS is_near,
                          classes.earliest IS NOT NULL AND (doc_id, line) <> classes.earliest AS is_copy
                   FROM spelled LEFT JOIN classes USING (spelling) LEFT JOIN near USING (spelling))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (is_near OR is_copy) AS n_dropped,
               count(*) FILTER (is_near AND NOT is_copy) AS n_near,
               sha256(coalesce(string_agg(content, chr(10) ORDER BY line)
                               FILTER (NOT is_near AND NOT is_copy), '')) AS text_sha256
        FROM judged GROUP BY doc_id""",
    "op8_exact_dedup": """
        WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM n WINDOW g AS (PARTITION BY text_sha256)""",
    "op11_collocations": r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
                            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
        sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
        grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
                  FROM pieces, unnest([1, 2, 3, 4]) AS s(k), unnest(range(1, len(w) - k + 2)) AS r(i)),
        counts AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*) AS f
                   FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 30),
        cuts AS (SELECT p.lang, p.phrase, p.k, p.f AS a, c, h.f AS l, t.f AS r,
                        (2000000::HUGEINT * p.f) // (h.f + t.f) AS score
                 FROM counts p, unnest(range(1, p.k)) AS x(c)
                 JOIN counts h ON h.lang = p.lang AND h.phrase = array_to_string(p.w[1:c], ' ')
                 JOIN counts t ON t.lang = p.lang AND t.phrase = array_to_string(p.w[c + 1:], ' ')
                 WHERE p.k > 1),
        lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS o FROM cuts),
        longer AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(f) AS most
                   FROM counts, unnest([2, 3]) AS y(s), unnest(range(1, k - s + 2)) AS z(i)
                   WHERE s < k GROUP BY ALL),
        ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
                          phrase, a, l, r, score::BIGINT AS score
                   FROM lowest LEFT JOIN longer USING (lang, phrase)
                   WHERE o = 1 AND (most IS NULL OR 100 * most < 80 * a))
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000""",
    "op12_lexical_search": r"""
        WITH rows AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text,
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        docs AS (SELECT r, doc_id, w, len(w) AS n FROM rows WHERE len(w) > 0),
        corpus AS (SELECT count(*) AS dn, sum(n)::BIGINT AS ln FROM docs),
        asked AS (SELECT item_id, term, count(*) AS repeats FROM (
                      SELECT item_id, unnest(regexp_extract_all(translate(text,
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
        held AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs)
                 WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
        weights AS (SELECT term, floor(1000 * ln((2 * any_value(dn) + 2) / (2 * count(*) + 1)))::BIGINT AS weight
                    FROM held, corpus GROUP BY term),
        scores AS (SELECT item_id, r, sum(repeats * weight * ((1000000000 * tf) //
                          (1000 * tf + 8 * (100 - 75 + (75 * n * dn) // ln))))::BIGINT AS score
                   FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN docs USING (r), corpus
                   GROUP BY item_id, r),
        ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank,
                          doc_id, score FROM scores JOIN docs USING (r) WHERE score > 0)
        SELECT * FROM ranked WHERE rank <= 10""",
    "op13_embedding_dedup": """
        WITH RECURSIVE fit AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
                               WHERE NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
                                 AND list_contains(list_transform(embedding, lambda x: x <> 0), true)),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b
                  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
                  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
        reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings
                    UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
        roots AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a)
        SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id,
               vec_id = component_id AS kept FROM roots""",
}
