"""The thin opN_ queries: each applies one operator to its whole table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, lm_scoring, packing, preference, quality_rules, sentencepieces, sharding, simhash, substrings, topk
from .common import read, spread


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), k=10, every=100).withColumnRenamed("id", "vec_id")


def op2_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.classify(spread(read(spark, sf_dir, "documents")), read(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op3_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    out = sentencepieces.decode(sentencepieces.encode(spread(read(spark, sf_dir, "documents")), path), path)
    return out.select(F.col("id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_ids"), "ids", F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"), F.octet_length("decoded").cast("bigint").alias("decoded_bytes"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(spread(read(spark, sf_dir, "documents")))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(read(spark, sf_dir, "documents"), shards=8)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_id.fit(spread(read(spark, sf_dir, "documents")))
    return language_id.identify_pages(spread(read(spark, sf_dir, "pages")), model).drop("row").withColumnRenamed("id", "page_id")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.removals(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(spread(read(spark, sf_dir, "documents")))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(spread(read(spark, sf_dir, "documents")), public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(spread(read(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_topk": op1_topk, "op2_preference": op2_preference, "op3_sentencepieces": op3_sentencepieces, "op4_simhash": op4_simhash, "op5_sharding": op5_sharding, "op6_language_id": op6_language_id, "op7_substrings": op7_substrings, "op8_quality_rules": op8_quality_rules, "op9_packing": op9_packing, "op10_lm_scoring": op10_lm_scoring}
WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quality_sql() -> str:
    """The quality rules over DuckDB's lists: base counts, languages and their words, histograms, references, Jensen-Shannon distances."""
    q = quality_rules
    size = len(q.CLASSES) + 2
    gone = lambda pattern: "length(t) - length(regexp_replace(t, '" + pattern.replace("'", "''") + "', '', 'g'))"
    chars = ", ".join([*(gone(c) for c in q.CLASSES), "length(t) - word_chars", f"word_chars - ({' + '.join(gone(c) for c in q.CLASSES)})"])
    js = lambda p, q_: f"sqrt(greatest(0.0, list_sum(list_transform(list_zip({p}, {q_}), lambda x: (CASE WHEN x[1] > 0 THEN x[1] * log2(x[1] / ((x[1] + x[2]) / 2)) ELSE 0 END + CASE WHEN x[2] > 0 THEN x[2] * log2(x[2] / ((x[1] + x[2]) / 2)) ELSE 0 END) / 2))))"
    shares = lambda counts, n: f"list_transform(list_append({counts}, {n} - list_sum({counts})), lambda x: x::DOUBLE / greatest({n}, 1))"
    sums = lambda name, n: ", ".join(f"coalesce(sum({name}[{k + 1}]), 0)" for k in range(n))
    return f"""
        WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, {WORDS_SQL} AS w FROM documents),
        windows AS (SELECT doc_id, i, w[i:i + 4] AS k FROM d, LATERAL unnest(range(1, len(w) - 3)) r(i)),
        twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM windows) WHERE n > 1),
        repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM twice, LATERAL unnest(range(i, i + 5)) r(p) GROUP BY doc_id),
        lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
        base AS (
            SELECT d.doc_id, lang, t, w, len(w) AS n_words, list_sum(list_append(list_transform(w, lambda x: length(x)), 0))::BIGINT AS word_chars,
                   len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
            FROM d JOIN lines USING (doc_id) LEFT JOIN repeated r USING (doc_id)
        ), counted AS (
            SELECT *, n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.MOST_REPEATED} * n_words AS base_failed, [{chars}] AS chars FROM base
        ), langs AS (SELECT lang FROM documents WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT {q.MAX_LANGUAGES}),
        held AS (SELECT lang, unnest(w) AS word FROM d JOIN langs USING (lang)),
        top AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS nth FROM held GROUP BY lang, word QUALIFY nth <= {q.COMMON}),
        vocabulary AS (SELECT lang AS of_lang, list(word ORDER BY nth) AS words FROM top GROUP BY lang),
        common AS (SELECT counted.*, of_lang, list_transform(words, lambda v: len(list_filter(w, lambda x: x = v))) AS c FROM counted, vocabulary),
        refs AS (SELECT of_lang, sum(n_words) AS n, [{sums("chars", size)}] AS ref_chars, [{sums("c", q.COMMON)}] AS ref_words FROM common WHERE NOT base_failed AND lang = of_lang GROUP BY of_lang HAVING count(*) >= {q.LEAST_TEXTS}),
        far AS (
            SELECT doc_id, min(({js("list_transform(chars, lambda x: x::DOUBLE / greatest(list_sum(chars), 1))", "list_transform(ref_chars, lambda x: x::DOUBLE / greatest(list_sum(ref_chars), 1))")} + {js(shares(f"list_resize(c, {q.COMMON}, 0)", "n_words"), shares("ref_words", "n"))}) / 2) AS distance
            FROM common JOIN refs USING (of_lang) WHERE lang IS NULL OR lang IN (SELECT of_lang FROM refs) GROUP BY doc_id
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT (n_words >= {q.MIN_WORDS} AND coalesce(distance, 0) > greatest({q.MAX_DISTANCE}, {q.FLOOR} + {q.NOISE} / sqrt(greatest(n_words, 1)))) AS kept
        FROM counted LEFT JOIN far USING (doc_id)
    """


ORACLES: dict[str, str] = {
    "op1_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 100 = 0
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op7_substrings": f"""
        WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
        windows AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM d, LATERAL unnest(range(1, len(w) - 48)) r(i)),
        firsts AS (SELECT k, min(doc_id) AS least FROM windows GROUP BY k),
        gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS p FROM windows JOIN firsts USING (k) WHERE least < doc_id GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(len(p), 0) AS n_removed,
               sha256(coalesce(array_to_string(list_filter(w, lambda x, i: p IS NULL OR NOT list_contains(p, i)), ' '), '')) AS kept_sha256
        FROM d LEFT JOIN gone USING (doc_id)
    """,
    "op8_quality_rules": _quality_sql(),
}
