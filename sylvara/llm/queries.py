"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup_substrings

    out = dedup_substrings(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL: dict[str, str] = {}

SQL["op1_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d)
), again AS (
  SELECT s FROM win GROUP BY s HAVING count(*) > 1
), hit AS (
  SELECT doc_id, list(DISTINCT p) AS gone FROM (
    SELECT doc_id, unnest(generate_series(i, i + 34)) AS p FROM win WHERE s IN (SELECT s FROM again)) GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS r,
         CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE NULL END AS whole FROM d LEFT JOIN hit USING (doc_id)
), part AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM (
    SELECT d.doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM d JOIN hit USING (doc_id)) u
  WHERE (u.doc_id, u.p) NOT IN (SELECT (doc_id, q) FROM (SELECT doc_id, unnest(gone) AS q FROM hit)) GROUP BY doc_id
)
SELECT k.doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(coalesce(whole, t, '')) AS kept_sha256
FROM kept k LEFT JOIN part USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_substring_dedup": op1_substring_dedup}


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_components

    return ngram_components(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES["op3_ngram_join"] = op3_ngram_join
SQL["op3_ngram_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), e AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 85 * (na.n + nb.n - o)
), r AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(seen) AS component_id FROM r GROUP BY node) c USING (doc_id)
"""


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprints

    out = fingerprints(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


QUERIES["op7_fingerprints"] = op7_fingerprints


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import read_media, text_media

    stored = text_media(_read(spark, sf_dir, "documents"))
    stored = stored.withColumn("media_bytes", F.length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    out = read_media(stored, "media", ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    return out.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), "media_bytes", "media_sha256", F.col("dhash").alias("feature"),
    )


QUERIES["op9_media"] = op9_media


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import encode_column

    out = encode_column(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


QUERIES["op8_sentencepiece"] = op8_sentencepiece


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES["op10_packing"] = op10_packing


def held_out(column: str = "doc_id"):
    """The fold that language models may not learn from."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learns(column: str = "doc_id"):
    return F.col(column).isNotNull() & ~held_out(column)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    out = identify(_read(spark, sf_dir, "documents"), learns())
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")


QUERIES["op4_language_id"] = op4_language_id


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


QUERIES["op5_url_filter"] = op5_url_filter


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES["op2_html_text"] = op2_html_text


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import derivatives, page_responses

    out = derivatives(page_responses(_read(spark, sf_dir, "pages")))
    return out.select("page_id", "source_id", "record_type", "record_id", F.length("record").cast("long").alias("n_bytes"), F.sha2("record", 256).alias("record_sha256"))


QUERIES["op6_warc"] = op6_warc


# What SQL can say of the queries above.


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES["edited_texts"] = edited_texts
SQL["edited_texts"] = """
SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 4) || substr(coalesce(lead(t) OVER (ORDER BY doc_id), first(t) OVER (ORDER BY doc_id)), 1, length(t) // 4)) AS edited_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""


def media_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_media(spark, sf_dir).drop("tail_crc32", "feature")


QUERIES["media_bytes"] = media_bytes
SQL["media_bytes"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT doc_id, n, greatest(192, (n + 191) // 192 * 192) AS size, t || repeat(' ', CAST(greatest(192, (n + 191) // 192 * 192) - n AS INTEGER)) AS payload FROM d),
m AS (SELECT *, 'P6' || chr(10) || '64 ' || (size // 192) || chr(10) || '255' || chr(10) || payload AS media FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(size AS BIGINT) AS payload_bytes, sha256(payload) AS payload_sha256, CAST(strlen(media) AS BIGINT) AS media_bytes, sha256(media) AS media_sha256 FROM m
"""


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host and path of every URL, and the verdicts of rules; those of the method have no SQL."""
    out = op5_url_filter(spark, sf_dir)
    return out.withColumn("verdict", F.when(F.col("rule").isNotNull(), F.col("verdict")))


QUERIES["url_rules"] = url_rules
SQL["url_rules"] = r"""
WITH rules(rule, verdict) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM h, rules
  WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, instr(rule, '/'))) GROUP BY page_id)
SELECT h.page_id, host, path, rule, verdict FROM h LEFT JOIN f USING (page_id)
"""
