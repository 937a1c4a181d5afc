"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import public_tokenizers
from caregrid.llm import bpe, compress_quality, exact_dedup, id_files, jaccard, kd_shards, line_dedup, line_rules, packing, sanitise, similar, simhash
from caregrid.llm.common import new_path

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def runs(spark, no_labels):
    def files(docs):
        path = new_path(spark, "test")
        id_files.write_ids(docs, path, BYTE)
        return id_files.read_ids(spark, path)

    return {
        "simhash": simhash.near_duplicates,
        "jaccard": jaccard.jaccard_join,
        "line_dedup": line_dedup.line_dedup,
        "kd_shards": kd_shards.kd_shards,
        "compress": lambda d: compress_quality.scores(d, no_labels),
        "files": files,
        "sanitise": sanitise.find_spans,
        "sanitised": sanitise.sanitised,
        "rules": lambda d: line_rules.line_rules(d, no_labels),
        "bpe": lambda d: bpe.decode_documents(bpe.encode_documents(d, WORD), WORD),
        "exact": exact_dedup.exact_dedup,
    }


def test_rows_stay(spark, odd, no_labels):
    want = sorted([r.doc_id for r in odd.collect()], key=str)
    for name, run in runs(spark, no_labels).items():
        assert sorted([r.doc_id for r in run(odd).collect()], key=str) == want, name


def test_empty_tables(spark, empty, no_labels):
    for name, run in runs(spark, no_labels).items():
        assert run(empty).collect() == [], name
    assert packing.pack(packing.token_pieces(empty, WORD)).collect() == []
    assert similar.keep_one(empty).collect() == []


def test_filters_keep_columns(spark, odd, no_labels):
    for rows in (similar.keep_one(odd), line_dedup.line_dedup(odd), sanitise.sanitised(odd), line_rules.kept_rows(odd, no_labels)):
        assert rows.columns == odd.columns
    # one of each: the null id, the first of 1, 2 and 7 (no words), of 3 and 4, of both rows 5, 6 and 8
    assert sorted(str(r.doc_id) for r in similar.keep_one(odd).collect()) == ["1", "3", "5", "6", "8", "None"]


def test_all_rows_alike(spark):
    docs = spark.createDataFrame([(None, None)] * 5 + [(1, "one line of text")] * 500, "doc_id long, text string")
    assert kd_shards.kd_shards(docs).count() == 505
    assert packing.pack(packing.token_pieces(docs, WORD)).count() == 505
    assert simhash.near_duplicates(docs).count() == 505
    assert exact_dedup.exact_dedup(docs).filter("doc_id = 1").select("keep_id", "group_size").distinct().collect() == [(1, 500)]


def test_values_with_names_used_inside(spark):
    """Columns that have the names operators use inside change nothing."""
    rows = [(1, "Alpha beta gamma delta epsilon zeta"), (2, "alpha BETA gamma delta epsilon zeta"), (3, None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    taken = ["_id", "_row", "_text", "_k1", "_k2", "_n", "_salt", "node", "key", "root", "n", "bits", "hashes", "word", "phrase", "lang_", "a", "b"]
    docs = spark.createDataFrame([(*r, *[str(k) for k in range(len(taken))]) for r in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in taken))
    asked = lambda df: sorted(map(str, df.collect()))
    for run in (simhash.near_duplicates, jaccard.jaccard_join, exact_dedup.exact_dedup):
        assert asked(run(docs)) == asked(run(plain))
    assert asked(jaccard.jaccard_join(docs)) == asked(spark.createDataFrame([(1, 2, 1), (2, 2, 1), (3, 0, 3)], "doc_id long, n_shingles long, component_id long"))
    for run in (similar.keep_one, line_dedup.line_dedup):
        assert asked(run(docs).select("doc_id", "text")) == asked(run(plain)) and run(docs).columns == docs.columns
