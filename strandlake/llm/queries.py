"""The query of each corpus operator over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, language_id, licenses, secrets, simhash, spotsigs, substrings, token_counts, url_filter
from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def joined(spans: Column | str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select("doc_id", *map(count, secrets.BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The base phrases of op3_license_scan and their labels.
LICENSE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"), phrases=LICENSE_PHRASES)
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.byte_bpe_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spotsigs.edited_and_next(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.fingerprint(F.col("signs")).alias("fingerprint"),
        spotsigs.fingerprint(F.col("edited_signs")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.token_counts(table(spark, sf_dir, "documents"), path, limit=512)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_decontamination, op3_license_scan, op4_url_filter, op5_substring_dedup, op6_simhash, op7_language_id, op8_byte_bpe, op9_spotsigs, op10_token_counts)}


SUBSTRING_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 windows AS (SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
 repeated AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
 covered AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM windows JOIN repeated USING (s)),
 words AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
 kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) FILTER (c.p IS NULL) AS kept, count(c.p) AS n FROM words LEFT JOIN covered c USING (rid, p) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)"""


def oracle_sql() -> dict[str, str]:
    return {"op5_substring_dedup": SUBSTRING_SQL}
