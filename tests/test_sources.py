"""Small release files, written and read back."""

import pytest
from caregrid.sources import terminology as tm


def write(path, rows, sep="\t"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(sep.join(r) + "\n" for r in rows), encoding="utf-8")


@pytest.fixture
def rf2(tmp_path):
    d = tmp_path / "Terminology"
    write(d / "sct2_Concept_Snapshot_X.txt", [("id", "active", "moduleId", "definitionStatusId"), ("1", "1", "m", "900000000000074008"), ("2", "0", "m", "x"), ("3", "1", "m", "odd")])
    fsn, syn = "900000000000003001", "900000000000013009"
    head = ("id", "active", "conceptId", "typeId", "term")
    write(d / "sct2_Description_Snapshot-en_X.txt", [head, ("11", "1", "1", fsn, "Alpha (finding)"), ("12", "1", "1", syn, 'The "alpha"'), ("13", "1", "1", syn, "Alfa"), ("14", "1", "3", fsn, "Gamma (disorder)")])
    write(d / "sct2_Relationship_Snapshot_X.txt", [("id", "active", "sourceId", "destinationId", "relationshipGroup", "typeId"), ("1", "1", "4", "2", "0", "116680003"), ("2", "1", "4", "3", "1", "77")])
    head = ("active", "referencedComponentId", "mapGroup", "mapPriority", "mapAdvice", "mapTarget")
    write(tmp_path / "Refset" / "Map" / "der2_iisssccRefset_ExtendedMap_X.txt", [head, ("1", "1", "1", "2", "a", " I10 "), ("1", "1", "1", "1", "a", " ")])
    return str(tmp_path)


def test_rf2(spark, rf2):
    assert {(r.id, r.definition_status) for r in tm.rf2_concepts(spark, rf2).collect()} == {("1", "PRIMITIVE"), ("3", "odd")}
    look = {r.concept_id: r for r in tm.concept_lookup(tm.rf2_descriptions(spark, rf2)).collect()}
    assert (look["1"].fsn, look["1"].tag, look["1"].preferred, look["1"].synonyms) == ("Alpha (finding)", "finding", 'The "alpha"', ['The "alpha"', "Alfa"])
    assert (look["3"].preferred, look["3"].synonyms) == ("Gamma", [])
    assert {(r.src, r.dst, r.type, r.group) for r in tm.rf2_relationships(spark, rf2).collect()} == {("4", "2", "IS_A", 0), ("4", "3", "REL_77", 1)}
    assert [(r.concept_id, r.target, r.group, r.priority) for r in tm.rf2_code_map(spark, rf2).collect()] == [("1", "I10", 1, 2)]
    with pytest.raises(FileNotFoundError):
        tm.one_file(spark, rf2, "sct2_*")


def atom(rxcui, sab, tty, code, text, suppress="N"):
    f = [""] * 18
    f[0], f[11], f[12], f[13], f[14], f[16] = rxcui, sab, tty, code, text, suppress
    return f


def test_rrf(spark, tmp_path):
    rows = [atom("1", "RXNORM", "BN", "1", "Alpha"), atom("1", "RXNORM", "SCD", "1", "alpha 5 MG"), atom("1", "RXNORM", "SY", "1", "alfa"), atom("1", "RXNORM", "SY", "1", "alfa"), atom("1", "RXNORM", "XX", "1", "no")]
    rows += [atom("1", "SNOMEDCT_US", "PT", "99", "x"), atom("1", "SNOMEDCT_US", "PT", "99", "x"), atom("2", "RXNORM", "IN", "2", "gone", "Y"), ["short", "row"]]
    write(tmp_path / "RXNCONSO.RRF", rows, "|")
    got = tm.drug_lookup(tm.rrf_atoms(spark, str(tmp_path), [*tm.TERM_TYPES, "SY"])).collect()
    assert [(r.rxcui, r.preferred, sorted(r.synonyms)) for r in got] == [("1", "alpha 5 MG", ["Alpha", "alfa"])]
    assert [tuple(r) for r in tm.rrf_crosswalk(spark, str(tmp_path)).collect()] == [("1", "99")]


def test_hospital_files(spark, tmp_path):
    lines = ["title", "", '"note"', "001\tYes\tNo\t01\tSURG\tALPHA WITH MCC\t2.5\t2.4\t\t3.1", "x\tYes\tNo\t01\tSURG\tB\t1\t1\t1\t1"]
    (tmp_path / "t5.txt").write_text("\n".join(lines), encoding="latin-1")
    (row,) = tm.drg_weights(spark, str(tmp_path / "t5.txt")).collect()
    assert (row.drg, row.post_acute, row.special_pay, row.title, row.weight_capped, row.gmlos) == (1, True, False, "ALPHA WITH MCC", 2.4, 0.0)
    (tmp_path / "mcc.txt").write_text("Table\n\nI10\tHyper\ttension\n", encoding="latin-1")
    assert [tuple(r) for r in tm.designations(spark, str(tmp_path / "mcc.txt"), "MCC").collect()] == [("I10", "Hyper\ttension", "MCC")]
    (tmp_path / "h.csv").write_text("﻿Facility ID,Emergency Services,Rating\n1,Yes,4\n,No,3\n2,maybe,Not Available\n", encoding="utf-8")
    rows = tm.named_csv(spark, str(tmp_path / "h.csv"), {"Facility ID": ("id", "str"), "Emergency Services": ("er", "bool"), "Rating": ("rating", "int")}, "id")
    assert [tuple(r) for r in rows.collect()] == [("1", True, 4), ("2", None, None)]


def test_streams_equal_batches(spark, tmp_path):
    from caregrid.streaming import jobs
    from pyspark.sql import functions as F

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("rating", F.when(F.col("value") >= 50, "positive").otherwise("negative"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = jobs.daily_ratings(stream, "ts", "rating").writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = events.groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("rating") == "positive").alias("p"), F.count_if(F.col("rating") == "negative").alias("n"))
    assert sorted(map(tuple, spark.table("days").collect())) == sorted(map(tuple, want.collect()))
    q = jobs.first_decisions(stream, "user_id", "event_type", "ts").writeStream.format("memory").queryName("cards").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("cards").count() == events.select("user_id").distinct().count()
    for _ in range(2):  # a second run finds nothing new
        run = jobs.incremental(stream, str(tmp_path / "store"), str(tmp_path / f"c{_}"), "event_id", lambda x: x.select("event_id"))
        run.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "store")).count() == events.count()


def test_suppressed_rows_stay_out(spark, tmp_path):
    """Only rows that are not suppressed count: Y, O and E are."""
    write(tmp_path / "RXNCONSO.RRF", [atom(str(k), "SNOMEDCT_US", "PT", f"c{k}", "x", s) for k, s in enumerate("NYOE")], "|")
    assert [tuple(r) for r in tm.rrf_crosswalk(spark, str(tmp_path)).collect()] == [("0", "c0")]
    rel = lambda src, dst, rela, s: [src, "", "", "", dst, "", "", rela, "", "", "RXNORM", "", "", "", s, ""]
    write(tmp_path / "RXNREL.RRF", [rel(str(k), "9", "isa", s) for k, s in enumerate("NYOE")] + [rel("7", "9", "unheard_of", "N")], "|")
    assert [tuple(r) for r in tm.rrf_relationships(spark, str(tmp_path)).collect()] == [("0", "9", "isa")]


def test_designation_list(spark, tmp_path):
    """Codes of any form, both sides trimmed, one split at the first tab, any number of further tabs."""
    long = "\t".join("x" * 1200)
    (tmp_path / "cc.txt").write_text(f"TABLE 6J\nICD-10 CM\tDescription\n A00.1 \t Fever, acute \nu071\tnew code\nZ9\t{long}\nno tab here\n", encoding="latin-1")
    got = {r.icd10_code: r.description for r in tm.designations(spark, str(tmp_path / "cc.txt"), "CC").collect()}
    assert got == {"A00.1": "Fever, acute", "u071": "new code", "Z9": long}


def test_directory_and_provider_files(spark, tmp_path):
    head = ",".join(tm.HOSPITAL_FIELDS)
    (tmp_path / "h.csv").write_text(f"﻿{head}\n010001,,1 ROAD,DOTHAN,AL,36301,HOUSTON,(334) 793,Acute Care Hospitals,Gov,Yes,Y,4,7,1,0,8,2,0,11,0,1,8,Not Available\n,NAMED{',' * 22}\n", encoding="utf-8")
    (row,) = tm.hospitals(spark, str(tmp_path / "h.csv")).collect()
    assert len(row) == 24 and (row.ccn, row.name, row.zip, row.emergency_services, row.birthing_friendly, row.overall_rating, row.te_measures_count) == ("010001", "Unknown", "36301", True, True, 4, None)
    (tmp_path / "p.csv").write_text(",".join(tm.PROVIDER_FIELDS) + "\n010001,1200,2500,9.5,8.25,7,1,2,75.5,1.9,40,30,,20,10,5,3\n", encoding="latin-1")
    (row,) = tm.providers(spark, str(tmp_path / "p.csv")).collect()
    assert len(row) == 17 and (row.total_beneficiaries, row.avg_beneficiary_age, row.pct_ckd, row.pct_stroke) == (1200, 75.5, None, 3.0)
    lines = ["010001,470,JOINT R\xc9PLACEMENT,,1.5,2,3", "010001,4.5,not whole,1,1,1,1", "010001,x,y,1,1,1,1", ",470,no id,1,1,1,1", "010002, 039 ,EXTRA,12,1,2,3"]
    (tmp_path / "s.csv").write_text(",".join(tm.SERVICE_FIELDS) + "\n" + "\n".join(lines) + "\n", encoding="latin-1")
    got = [(r.ccn, r.drg, r.drg_description, r.discharges) for r in tm.provider_services(spark, str(tmp_path / "s.csv")).orderBy("ccn").collect()]
    assert got == [("010001", 470, "JOINT R\xc9PLACEMENT", 0), ("010002", 39, "EXTRA", 12)]
