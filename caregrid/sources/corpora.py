"""Readers of document folders, curated chunk files, rule layers and evaluation sets."""

from __future__ import annotations

import csv
import io
import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Extensions that are imported.
EXTENSIONS = ["txt", "md", "csv", "svg"]
RULE = """rule_id string, condition string, snomed_codes array<string>, icd10_unspecified array<string>, icd10_specific map<string,string>,
  attributes array<struct<name string, description string, required boolean, evidence_patterns array<string>, snomed_descendants array<string>, values array<string>>>,
  query_template string, priority string"""


def corpus_chunks(spark: SparkSession, path: str, source_type: str, prefix: str) -> DataFrame:
    """Chunks of files {version, chunks: [{id, title, text}]}; those without id or text go. to_embed: title, blank line, text."""
    raw = spark.read.json(path, schema="version string, chunks array<struct<id string, title string, text string>>", multiLine=True)
    rows = raw.select(F.coalesce("version", F.lit("unknown")).alias("version"), F.explode("chunks").alias("c")).select("version", "c.*").filter("id <> '' AND text <> ''")
    title = F.nullif("title", F.lit(""))
    return rows.select(F.concat(F.lit(prefix), "id").alias("doc_id"), "text", F.concat_ws("\n\n", title, "text").alias("to_embed"), F.lit(source_type).alias("source_type"), "title", F.col("id").alias("chunk_id"), F.col("version").alias("corpus_version"))


def scan_files(spark: SparkSession, path: str, extensions: list[str] = EXTENSIONS) -> DataFrame:
    """path, tag (folder below the root), source (file name), ext, hash, content of all files with the extensions, subfolders included. Spark leaves out files of no length."""
    pattern = "*.{" + ",".join([*extensions, *map(str.upper, extensions)]) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    root = path.rstrip("/") + "/"
    below = F.element_at(F.split("path", "\\Q" + root + "\\E", 2), -1)
    tag = F.regexp_replace(below, "/?[^/]*$", "")
    return files.select("path", tag.alias("tag"), F.element_at(F.split("path", "/"), -1).alias("source"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"), F.sha2("content", 256).alias("hash"), "content")


def static_tags(files: DataFrame, tags: dict[str, str], default: str = "general") -> DataFrame:
    """Replaces a file's tag by the one listed for its name; files without a folder and a listed tag get the default."""
    listed = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv]) if tags else F.create_map().cast("map<string,string>")
    return files.withColumn("tag", F.coalesce(F.try_element_at(listed, F.col("source")), F.nullif("tag", F.lit("")), F.lit(default)))


def extract_text(ext: str, content: bytes) -> tuple[str, str | None]:
    """(text, error) of one file: text as it is, CSV as a Markdown table without rows of another width, the text nodes of SVG."""
    if ext == "svg":
        try:
            nodes = ET.fromstring(content).iter()
        except ET.ParseError as e:
            return "", f"SVG: {e}"
        return "\n".join(n.text.strip() for n in nodes if str(n.tag).endswith("text") and n.text and n.text.strip()), None
    text = content.decode("utf-8", errors="ignore")
    if ext != "csv":
        return text.strip(), None
    try:
        rows = list(csv.reader(io.StringIO(text)))
    except csv.Error as e:
        return "", f"CSV: {e}"
    if not rows:
        return "", None
    body = [r for r in rows[1:] if len(r) == len(rows[0])]
    return "\n".join("| " + " | ".join(r) + " |" for r in [rows[0], ["---"] * len(rows[0]), *body]), None


def extracted(files: DataFrame) -> DataFrame:
    """path, text, error of scanned files."""

    def run(frames):
        for frame in frames:
            found = [extract_text(e, bytes(c)) for e, c in zip(frame["ext"], frame["content"])]
            yield frame[["path"]].assign(text=[t for t, _ in found], error=[e for _, e in found])

    return files.select("path", "ext", "content").mapInPandas(run, "path string, text string, error string")


def import_report(files: DataFrame, texts: DataFrame) -> DataFrame:
    """path, hash, status, kept_path, error: error, else duplicate of the first path with the content, else imported. Contents are not shuffled."""
    keyed = files.select("path", "hash")
    kept = keyed.groupBy("hash").agg(F.min("path").alias("kept_path"))
    rows = keyed.join(kept, "hash").join(texts.select("path", "error"), "path")
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("path") != F.col("kept_path"), "duplicate").otherwise("imported")
    return rows.select("path", "hash", status.alias("status"), "kept_path", "error")


def load_rules(spark: SparkSession, base: str, override: str | None = None) -> DataFrame:
    """Rules of JSON files that hold one rule or a list. Of equal ids the override layer (3) wins over the base (1), then the last file by name."""
    layers = [(1, base)] + ([(3, override)] if override else [])
    rows = None
    for layer, path in layers:
        read = spark.read.schema(RULE).option("multiLine", "true").option("pathGlobFilter", "*.json").json(path)
        read = read.select("*", F.col("_metadata.file_name").alias("_file"), F.lit(layer).alias("layer")).filter("rule_id IS NOT NULL")
        rows = read if rows is None else rows.unionByName(read)
    last = F.row_number().over(Window.partitionBy("rule_id").orderBy(F.desc("layer"), F.desc("_file")))
    return rows.withColumn("_r", last).filter("_r = 1").drop("_r", "_file")


def matchable(rules: DataFrame) -> DataFrame:
    """Rules in the shape that the note checks take; null lists are empty."""
    full = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    part: Column = F.transform(
        "attributes",
        lambda a: F.struct(
            a["name"].alias("name"), F.coalesce(a["required"], F.lit(True)).alias("required"), full(a["evidence_patterns"]).alias("patterns"), full(a["values"]).alias("values"), full(a["snomed_descendants"]).alias("codes")
        ),
    )
    return rules.select("rule_id", "condition", full(F.col("snomed_codes")).alias("codes"), part.alias("attributes"))


def evaluation_set(spark: SparkSession, path: str, schema: str = "query string, expected string") -> DataFrame:
    """A .json file (a list) or a .jsonl file (an object a line)."""
    kind = path.rsplit(".", 1)[-1]
    if kind not in ("json", "jsonl"):
        raise ValueError("only .json and .jsonl are read")
    return spark.read.json(path, schema=schema, multiLine=kind == "json")
