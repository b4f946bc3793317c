"""The operators over the given tables: one query each, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm import (
    bpe,
    decontaminate,
    embedding_dedup,
    filter_audit,
    language_id,
    lexical_search,
    minhash,
    pii,
    quality_crf,
    reshard,
    toxicity,
    url_filter,
    warc_fixity,
)
from rankforge.llm.common import id_remainder, table

SHARDS = 16
# Shards the documents lie in before: their sources, dealt to so many.
OLD_SHARDS = 12
RECORDS_PER_ARCHIVE = 256
# From these scores on a document counts as good, and as toxic.
GOOD, TOXIC = 0.3, 0.7
RANKS = "byte_bpe_multi_50k.tiktoken"
URL_RULES = (
    "allow com/",
    "block example.com/en/",
    "allow www.example.com/en/",
    "block net/es/",
    "block net/fr/",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_reshard": op1_reshard,
        "op2_url_filter": op2_url_filter,
        "op3_embedding_dedup": op3_embedding_dedup,
        "op4_language_id": op4_language_id,
        "op5_quality_crf": op5_quality_crf,
        "op6_decontaminate": op6_decontaminate,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_toxicity": op8_toxicity,
        "op9_minhash_dedup": op9_minhash_dedup,
        "op10_warc_fixity": op10_warc_fixity,
        "op11_lexical_search": op11_lexical_search,
        "op12_filter_audit": op12_filter_audit,
        "op13_personal_data": op13_personal_data,
    }


def op1_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(OLD_SHARDS))
    placed = docs.withColumn("old_shard", old)
    path = reshard.reshard(placed, "old_shard", SHARDS)
    text = F.coalesce("row.text", F.lit(""))
    return reshard.read_shards(spark, path, placed).select(
        "row.doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("row.old_shard").cast("int").alias("old_shard"),
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = [url_filter.parse_rule(r) for r in URL_RULES]
    return url_filter.filter_urls(pages, rules).select("page_id", "url_match.*")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.similar_vectors(table(spark, sf_dir, "embeddings"))


def profiles(spark: SparkSession, sf_dir: str) -> language_id.Profiles:
    docs = table(spark, sf_dir, "documents")
    return language_id.learn_profiles(docs.where(id_remainder(F.col("doc_id"), 4) != 2))


def line_model(spark: SparkSession, sf_dir: str) -> quality_crf.LineModel:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_crf.learn_quality(docs, labels.where(id_remainder(F.col("doc_id"), 5) != 0))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(table(spark, sf_dir, "documents"), profiles(spark, sf_dir))
    return found.withColumn("held_out", id_remainder(F.col("doc_id"), 4) == 2)


def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_crf.score_quality(table(spark, sf_dir, "documents"), line_model(spark, sf_dir))
    return found.withColumn("held_out", id_remainder(F.col("doc_id"), 5) == 0).withColumn(
        "predicted", (F.col("score") >= GOOD).cast("int")
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_overlaps(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ).select(
        "doc_id", "item_id", "item_words", "covered", "coverage", F.size("tiles").alias("n_tiles")
    )


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(RANKS))
    docs = table(spark, sf_dir, "documents")
    tokens = bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)
    return tokens.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    train = labels.where(id_remainder(F.col("doc_id"), 3) != 1)
    return (
        toxicity.score_toxicity(docs, docs, train)
        .withColumn("held_out", id_remainder(F.col("doc_id"), 3) == 1)
        .withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))
    )


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    # Archives of so many consecutive records; the replica is damaged by the url's md5.
    records = pages.select(
        F.expr(f"page_id div {RECORDS_PER_ARCHIVE}").alias("archive"),
        F.col("page_id").alias("record_id"),
        warc_fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"),
        F.substring(F.md5("url"), 1, 2).alias("mark"),
    )
    replica = warc_fixity.damaged(records, F.col("mark")).drop("mark")
    return warc_fixity.audit(records.drop("mark"), replica).withColumnRenamed("record_id", "page_id")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def listed(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    def total(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [total(kind) for kind in ("email", "ip", "card", "phone")]
    return found.select(
        "doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


_UPPER, _LOWER = url_filter._UPPER, url_filter._LOWER

_OP2 = f"""
    WITH rest AS (
        SELECT page_id,
               CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3)
                    ELSE '' END AS r
        FROM pages),
    parts AS (
        SELECT page_id, translate(regexp_extract(r, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host,
               regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
        FROM rest),
    rules AS (
        SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
                              ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'),
                              ('net', '/fr/', 'block')) AS t(rhost, rpath, verdict)),
    hits AS (
        SELECT page_id, rhost || rpath AS rule, verdict,
               row_number() OVER (PARTITION BY page_id
                   ORDER BY length(rhost) DESC, length(rpath) DESC) AS n
        FROM parts JOIN rules
          ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
    SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
    FROM parts p LEFT JOIN hits h ON p.page_id = h.page_id AND n = 1
"""


_OP10 = f"""
    WITH records AS (
        SELECT page_id, page_id // {RECORDS_PER_ARCHIVE} AS archive, md5(url)[1:2] AS mark,
               'WARC/1.0' || e'\\r\\n' || 'WARC-Type: response' || e'\\r\\n'
               || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e'\\r\\n'
               || 'WARC-Target-URI: ' || url || e'\\r\\n'
               || 'Content-Length: ' || strlen(html) || e'\\r\\n\\r\\n' || html || e'\\r\\n\\r\\n' AS r
        FROM pages),
    placed AS (
        SELECT *, CAST(strlen(r) AS BIGINT) AS length,
               CAST(sum(strlen(r)) OVER (PARTITION BY archive ORDER BY page_id) - strlen(r) AS BIGINT) AS start
        FROM records)
    SELECT CAST(archive AS VARCHAR) AS archive, page_id, start, length,
           CASE WHEN mark = '0c' THEN 'missing' ELSE 'altered' END AS fault, sha256(r) AS expected,
           CASE mark WHEN '0a' THEN sha256(encode(r)[1:strlen(r) - 1] || encode('x'))
                     WHEN '0b' THEN sha256(encode(r)[1:strlen(r) // 2]) END AS found
    FROM placed WHERE mark IN ('0a', '0b', '0c')
    UNION ALL
    SELECT CAST(archive AS VARCHAR), -1 - page_id, NULL, NULL, 'extra', NULL, sha256(r)
    FROM placed WHERE mark = '0d'
"""


# What separates terms, as the characters that are none of theirs.
_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
_OP11 = f"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), {_TERM}) AS ts
        FROM documents),
    held AS (SELECT doc_id, ts, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0),
    totals AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS occ FROM held),
    tf AS (SELECT doc_id, n, t, CAST(count(*) AS BIGINT) AS tf
           FROM (SELECT doc_id, n, unnest(ts) AS t FROM held) GROUP BY ALL),
    df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
    asked AS (
        SELECT DISTINCT item_id,
               unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), {_TERM})) AS t
        FROM benchmark),
    scored AS (
        SELECT item_id, doc_id,
               CAST(sum(CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT)
                   * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // occ)))) AS BIGINT) AS score
        FROM asked JOIN tf USING (t) JOIN df USING (t), totals GROUP BY ALL),
    ranked AS (
        SELECT item_id, doc_id, score,
               CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
        FROM scored WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def _per_order(measure: str) -> str:
    return f"CAST(coalesce(sum(n) FILTER ({measure}), 0) AS BIGINT)"


_OP12 = f"""
    WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
                 min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
    l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
    failing AS (
        SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
               CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
               + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
               + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
               + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
               + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS fails
        FROM w LEFT JOIN l USING (doc_id)),
    masks AS (SELECT part, good, toxic, fails, count(*) AS n FROM failing GROUP BY ALL),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    orders AS (
        SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
        FROM letters a, letters b, letters c, letters d, letters e
        WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    steps AS (
        SELECT filter_order, step, own,
               list_sum([1 << (ascii(y) - 65) FOR y IN string_split(filter_order[1:step - 1], '') IF y <> '']) AS b
        FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
             LATERAL (SELECT 1 << (ascii(filter_order[step]) - 65) AS own)),
    per AS (
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, own,
               {_per_order("WHERE fails & (b + own) = 0")} AS kept,
               {_per_order("WHERE fails & b = 0 AND fails & own > 0")} AS removed,
               {_per_order("WHERE fails & b > 0 AND fails & own > 0")} AS redundant,
               {_per_order("WHERE fails = own")} AS unique_fails,
               {_per_order("WHERE fails & b = 0 AND fails & own > 0 AND good")} AS good_lost,
               {_per_order("WHERE fails & b = 0 AND fails & own > 0 AND toxic")} AS toxic_lost
        FROM masks, (SELECT filter_order, step, CAST(own AS INTEGER) AS own, CAST(coalesce(b, 0) AS INTEGER) AS b FROM steps)
        GROUP BY ALL)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
    FROM per
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": _OP2,
        "op10_warc_fixity": _OP10,
        "op11_lexical_search": _OP11,
        "op12_filter_audit": _OP12,
    }
