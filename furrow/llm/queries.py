"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontam, exact_dedup, fill_middle, lang_id, license_scan, lm_score, mixing, resample, sharding, simhash, token_count, token_output


def tokenizer(name: str) -> str:
    """The place of an installed vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(_documents(spark, sf_dir))


def op5_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_documents(spark, sf_dir)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.concat_ws(";", "spans").alias("spans"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.tokenise(_documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.predictions(_documents(spark, sf_dir))


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.importance_resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "n_features", "weight", "score", "rank")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(_documents(spark, sf_dir))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    file, pattern = tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    done = byte_bpe.decode(byte_bpe.encode(_documents(spark, sf_dir), file, pattern), file, pattern)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


_LOW = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"list_filter(regexp_split_to_array({_LOW}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("text")} AS w FROM benchmark),
g AS (
  SELECT DISTINCT item, list_slice(w, i, i + 9) AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(gram) AS n FROM g),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN lens WHERE len(w) >= n),
h AS (SELECT p.doc_id, p.i, p.n, g.item FROM p JOIN g ON list_slice(p.w, p.i, p.i + p.n - 1) = g.gram),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP6_SQL = f"""
WITH t AS (SELECT doc_id, sha256({_LOW.format("text")}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
"""

OP5_SQL = f"""
WITH RECURSIVE s AS (SELECT source, CAST(sum(coalesce(strlen(text), 0) + 1) AS BIGINT) AS size FROM documents GROUP BY source),
w AS (SELECT sum(size) AS whole, sum(pow(CAST(size AS DOUBLE), {mixing.POWER})) AS shares FROM s),
r AS (SELECT source, pow(CAST(size AS DOUBLE), {mixing.POWER}) / shares * CAST(whole AS DOUBLE) / size AS rate FROM s, w),
q AS (SELECT source, CAST(greatest(ceil(rate / {mixing.MAX_RATE}), 1) AS BIGINT) AS parts, rate / greatest(ceil(rate / {mixing.MAX_RATE}), 1) AS m FROM r),
cdf AS (
  SELECT source, m, 0 AS k, exp(-m) AS p, exp(-m) AS c FROM q
  UNION ALL SELECT source, m, k + 1, p * m / (k + 1), c + p * m / (k + 1) FROM cdf WHERE k < {mixing.TERMS - 1}),
d AS (SELECT doc_id, q.source, unnest(range(0, parts)) AS part FROM documents t JOIN q ON t.source IS NOT DISTINCT FROM q.source),
u AS (SELECT *, CAST(CAST('0x' || substr(md5('{mixing.SEED}|' || doc_id || CASE WHEN part > 0 THEN '|#' || part ELSE '' END), 1, 13) AS BIGINT) AS DOUBLE) / {1 << 52}.0 AS u FROM d),
n AS (
  SELECT u.doc_id, count(*) FILTER (WHERE cdf.c <= u.u) AS n
  FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source GROUP BY u.doc_id),
e AS (SELECT doc_id, unnest(range(0, CAST(n AS BIGINT))) AS copy FROM n)
SELECT d.*, CAST(e.copy AS INTEGER) AS copy, md5('{mixing.SEED}|' || d.doc_id || '|' || e.copy) AS mix_key FROM documents d JOIN e USING (doc_id)
"""

OP12_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (
  SELECT doc_id, x, length(x) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (
  SELECT doc_id, x, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(x, 1, a) AS pre, substring(x, a + 1, b - a) AS mid, substring(x, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(x) AS restored_sha256
FROM p
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_decontamination, op2_simhash, op3_token_counts, op4_lm_scores, op5_poisson_mix, op6_exact_dedup, op7_license_scan, op8_sharding, op9_token_output, op10_language_id, op11_importance_resample, op12_fill_in_middle, op13_byte_bpe)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op5_poisson_mix": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op12_fill_in_middle": OP12_SQL}
