"""Queries of the corpus operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(common.table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import decode_documents, encode_documents

    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    both = decode_documents(encode_documents(common.table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, token_pieces

    return pack(token_pieces(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kd_shards import kd_shards

    return kd_shards(common.table(spark, sf_dir, "documents"))


def op5_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .id_files import read_ids, write_ids

    path = common.new_path(spark, "ids")
    write_ids(common.table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(spark, path, with_ids=False)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(common.table(spark, sf_dir, "documents"))


def op4_compress_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .compress_quality import scores

    return scores(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_rules import line_rules

    return line_rules(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op6_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sanitise import PATTERNS, find_spans, written_spans

    found = find_spans(common.table(spark, sf_dir, "documents"))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id",
        *[count(rank).alias(f"n_{kind}") for rank, kind in enumerate(PATTERNS)],
        F.sha2(written_spans(F.col("base")), 256).alias("base_sha256"),
        written_spans(F.col("spans")).alias("spans"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    return line_dedup(common.table(spark, sf_dir, "documents"), removed_col="removed_lines").select("doc_id", "text", "removed_lines")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    return variants(common.table(spark, sf_dir, "documents"))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_join

    return jaccard_join(common.table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(common.table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents
), words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
gram AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
  FROM words, (VALUES (1), (2), (3)) AS ks(k)
),
f AS (SELECT lang, k, phrase, count(*) AS f FROM gram GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cut AS (SELECT *, array_to_string(w[1 : c], ' ') AS p1, array_to_string(w[c + 1 : k], ' ') AS p2 FROM cand, (VALUES (1), (2)) AS cs(c) WHERE c < k),
told AS (
  SELECT cut.lang, cut.k, cut.phrase, a, c, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = p1 AND l.k = c JOIN f r ON r.lang = cut.lang AND r.phrase = p2 AND r.k = cut.k - c
), least AS (SELECT * FROM told QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS a
  FROM (SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM cand WHERE k = 3 UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM cand WHERE k = 3)
  GROUP BY ALL
), kept AS (SELECT least.* FROM least LEFT JOIN longer USING (lang, phrase) WHERE longer.a IS NULL OR 100 * longer.a < 50 * least.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang)
QUALIFY rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [f for k, f in globals().items() if k.startswith("op") and callable(f)]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op10_exact_dedup": OP10_SQL, "op13_collocations": OP13_SQL}
