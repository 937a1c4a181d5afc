"""Readers of terminology releases (RF2: tab, header; RRF: pipe, by position) and of public hospital files.

All columns are read as text with quoting off, then cast; a release has exactly
one file of each kind, else reading fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import safe_bool, safe_float, safe_int, safe_str
from ..functions.vocabulary import DRUG_LINKS, DRUG_TYPES, HOSPITAL_FIELDS, PROVIDER_FIELDS, RELATIONSHIPS, SERVICE_FIELDS

#: Identifiers of the release formats.
FSN_TYPE = "900000000000003001"
DEFINITION = {"900000000000074008": "PRIMITIVE", "900000000000073002": "FULLY_DEFINED"}
TERM_TYPES = ["PSN", "SCD", "SBD", "IN", "PIN", "MIN", "BN"]


def one_file(spark: SparkSession, path: str, pattern: str) -> str:
    """The one file under the path whose name fits; fails on none or several."""
    files = [r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path").limit(2).collect()]
    if len(files) != 1:
        raise FileNotFoundError(f"{pattern}: {len(files) or 'no'} files under {path}" + (" at least" if files else ""))
    return files[0]


def _rf2(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    file = one_file(spark, path, f"{prefix}*.txt")
    rows = spark.read.option("sep", "\t").option("header", "true").option("quote", "").option("inferSchema", "false").csv(file)
    return rows.filter(F.col("active") == "1")


def rf2_concepts(spark: SparkSession, path: str) -> DataFrame:
    """Active concepts; an unknown definition status stays as it is."""
    status = F.create_map(*[F.lit(x) for kv in DEFINITION.items() for x in kv])
    return _rf2(spark, path, "sct2_Concept_Snapshot").select("id", "moduleId", F.coalesce(F.try_element_at(status, F.col("definitionStatusId")), "definitionStatusId").alias("definition_status"))


def rf2_descriptions(spark: SparkSession, path: str) -> DataFrame:
    rows = _rf2(spark, path, "sct2_Description_Snapshot")
    return rows.select("id", F.col("conceptId").alias("concept_id"), "term", (F.col("typeId") == FSN_TYPE).alias("is_fsn"))


def rf2_relationships(spark: SparkSession, path: str, names: dict[str, str] = RELATIONSHIPS) -> DataFrame:
    """Active relationships; a type without a name is REL_<id>."""
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    kind = F.coalesce(F.try_element_at(known, F.col("typeId")), F.concat(F.lit("REL_"), F.col("typeId")))
    return _rf2(spark, path, "sct2_Relationship_Snapshot").select(F.col("sourceId").alias("src"), F.col("destinationId").alias("dst"), kind.alias("type"), F.col("relationshipGroup").try_cast("int").alias("group"))


def rf2_code_map(spark: SparkSession, path: str) -> DataFrame:
    """Active map rows with a target."""
    rows = _rf2(spark, path, "der2_iisssccRefset_ExtendedMap").withColumn("target", F.trim("mapTarget")).filter("target <> ''")
    return rows.select(F.col("referencedComponentId").alias("concept_id"), "target", F.col("mapGroup").try_cast("int").alias("group"), F.col("mapPriority").try_cast("int").alias("priority"), F.col("mapAdvice").alias("advice"))


def _rrf(spark: SparkSession, path: str, name: str, least: int, **places: int) -> DataFrame:
    """Named fields of lines with at least ``least`` fields."""
    parts = spark.read.text(one_file(spark, path, name)).select(F.split("value", r"\|", -1).alias("f"))
    return parts.filter(F.size("f") >= least).select(*[F.col("f")[k].alias(c) for c, k in places.items()])


def rrf_atoms(spark: SparkSession, path: str, types: list[str] = DRUG_TYPES) -> DataFrame:
    rows = _rrf(spark, path, "RXNCONSO.RRF", 17, rxcui=0, sab=11, tty=12, code=13, str=14, suppress=16)
    return rows.filter((F.col("sab") == "RXNORM") & (F.col("suppress") == "N") & F.col("tty").isin(types)).select("rxcui", "tty", "str")


def rrf_relationships(spark: SparkSession, path: str, relas: list[str] = DRUG_LINKS) -> DataFrame:
    rows = _rrf(spark, path, "RXNREL.RRF", 15, src=0, dst=4, rela=7, sab=10, suppress=14)
    ok = (F.col("sab") == "RXNORM") & (F.col("suppress") == "N") & F.col("rela").isin(relas) & (F.col("src") != "") & (F.col("dst") != "")
    return rows.filter(ok).select("src", "dst", F.col("rela").alias("type"))


def rrf_crosswalk(spark: SparkSession, path: str) -> DataFrame:
    rows = _rrf(spark, path, "RXNCONSO.RRF", 17, rxcui=0, sab=11, code=13, suppress=16)
    return rows.filter("sab = 'SNOMEDCT_US' AND suppress = 'N' AND code <> ''").select("rxcui", "code").distinct()


def concept_lookup(descriptions: DataFrame) -> DataFrame:
    """concept_id, fsn, preferred, synonyms: the last full name and the first synonym by description id."""
    from ..functions.scalars import trailing_tag, without_tag

    order = F.struct(F.length("id"), "id")
    syn = F.when(~F.col("is_fsn"), F.struct(F.length("id").alias("n"), "id", "term"))
    rows = descriptions.groupBy("concept_id").agg(F.max_by("term", F.when(F.col("is_fsn"), order)).alias("fsn"), F.array_sort(F.collect_list(syn)).alias("s"))
    synonyms = F.transform("s", lambda x: x["term"])
    return rows.select("concept_id", "fsn", trailing_tag(F.coalesce("fsn", F.lit(""))).alias("tag"), F.coalesce(F.get(synonyms, 0), without_tag(F.col("fsn"))).alias("preferred"), synonyms.alias("synonyms"))


def drug_lookup(atoms: DataFrame, types: list[str] = TERM_TYPES) -> DataFrame:
    """rxcui, preferred, synonyms: the best term by type, the others distinct and never the preferred one."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, types)), F.col("tty")), F.lit(0)), F.lit(len(types) + 1))
    rows = atoms.groupBy("rxcui").agg(F.min_by("str", F.struct(place, F.col("str"))).alias("preferred"), F.array_sort(F.collect_set("str")).alias("all"))
    return rows.select("rxcui", "preferred", F.array_except("all", F.array("preferred")).alias("synonyms"))


def _latin_tsv(spark: SparkSession, path: str, least: int) -> DataFrame:
    """Fields of the lines that have enough of them; titles and blank lines have not."""
    lines = spark.read.option("encoding", "ISO-8859-1").option("sep", "\u0001").option("quote", "").csv(path, schema="line string")
    return lines.select(F.split("line", "\t", -1).alias("f")).filter(F.size("f") >= least)


def drg_weights(spark: SparkSession, path: str) -> DataFrame:
    """Rows whose first field is an integer; blank numbers are 0."""
    rows = _latin_tsv(spark, path, 10)
    f, number = F.col("f"), lambda k: F.coalesce(safe_float(F.col("f")[k]), F.lit(0.0))
    yes = lambda k: F.lower(F.trim(f[k])) == "yes"
    out = rows.select(
        f[0].try_cast("int").alias("drg"), yes(1).alias("post_acute"), yes(2).alias("special_pay"), F.trim(f[3]).alias("mdc"), F.trim(f[4]).alias("type"), F.trim(f[5]).alias("title"),
        number(6).alias("weight_uncapped"), number(7).alias("weight_capped"), number(8).alias("gmlos"), number(9).alias("alos"),
    )
    return out.filter("drg IS NOT NULL")


def designations(spark: SparkSession, path: str, designation: str) -> DataFrame:
    """icd10_code, description, designation of lines that the first tab splits into two texts; the two title lines of a file have no tab or no code."""
    lines = spark.read.option("encoding", "ISO-8859-1").option("sep", "\u0001").option("quote", "").csv(path, schema="line string")
    cut = F.locate("\t", "line")
    rows = lines.filter(cut > 0).select(F.trim(F.substring("line", F.lit(1), cut - 1)).alias("icd10_code"), F.trim(F.substring("line", cut + 1, F.length("line"))).alias("description"))
    # a code has a digit and no blank, which the words of a heading have not
    return rows.filter(F.col("icd10_code").rlike("[0-9]") & ~F.col("icd10_code").rlike(r"\s")).withColumn("designation", F.lit(designation))


def named_csv(spark: SparkSession, path: str, columns: dict[str, tuple[str, str]], key: str, encoding: str = "UTF-8") -> DataFrame:
    """columns: name in the file -> (our name, int | float | bool | str); rows without the key go; a byte order mark is ignored."""
    whole = lambda c: F.when(F.trim(c).rlike("^[+-]?[0-9]+$"), F.trim(c).try_cast("int"))
    cast = {"int": safe_int, "float": safe_float, "bool": safe_bool, "str": safe_str, "whole": whole}
    rows = spark.read.option("header", "true").option("encoding", encoding).option("multiLine", "true").csv(path)
    rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
    made: list[Column] = [cast[kind](F.col(f"`{source}`")).alias(name) for source, (name, kind) in columns.items()]
    return rows.select(*made).filter(F.col(key).isNotNull())


def hospitals(spark: SparkSession, path: str) -> DataFrame:
    """The hospital directory: 24 columns; rows without an id go, a name that is missing is 'Unknown'."""
    return named_csv(spark, path, HOSPITAL_FIELDS, "ccn").withColumn("name", F.coalesce("name", F.lit("Unknown")))


def providers(spark: SparkSession, path: str) -> DataFrame:
    """Provider aggregates: 17 columns, Latin-1; rows without an id go."""
    return named_csv(spark, path, PROVIDER_FIELDS, "ccn", "ISO-8859-1")


def provider_services(spark: SparkSession, path: str) -> DataFrame:
    """Provider by DRG, Latin-1: rows without an id or a whole number as DRG go; no discharges are 0."""
    rows = named_csv(spark, path, SERVICE_FIELDS, "ccn", "ISO-8859-1").filter(F.col("drg").isNotNull())
    return rows.withColumn("discharges", F.coalesce("discharges", F.lit(0)))
