"""Readers of folders, chunk files, rules and evaluation sets; chunks and load phases by brute force."""

import json

import pytest
from caregrid.operators import retrieval as rt
from caregrid.operators import scans as sn
from caregrid.sources import corpora as co


def test_corpus_chunks(spark, tmp_path):
    chunks = [{"id": "a", "title": "T", "text": "body"}, {"id": "b", "text": "plain"}, {"id": "", "text": "x"}, {"id": "c", "title": "no text"}]
    (tmp_path / "c.json").write_text(json.dumps({"version": "2", "chunks": chunks}, indent=1))
    got = {r.doc_id: r for r in co.corpus_chunks(spark, str(tmp_path / "c.json"), "docs", "p:").collect()}
    assert set(got) == {"p:a", "p:b"}
    assert (got["p:a"].to_embed, got["p:a"].corpus_version, got["p:b"].to_embed, got["p:b"].title) == ("T\n\nbody", "2", "plain", None)


def test_folder(spark, tmp_path):
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    for name, body in {"a.txt": b" hi \xff there\n", "sub/b.md": b"# head", "sub/deep/c.TXT": b"# head", "t.csv": b'x,y\n1,2\n3\n"4,5",6\n', "d.svg": b"<svg xmlns='http://www.w3.org/2000/svg'><text> one </text><g><text>two</text></g></svg>", "e.svg": b"<svg", "z.bin": b"no", "n.csv": b""}.items():
        (tmp_path / name).write_bytes(body)
    files = co.scan_files(spark, str(tmp_path))
    rows = {r.source: r for r in co.static_tags(files, {"t.csv": "tables"}).collect()}
    assert {k: r.tag for k, r in rows.items()} == {"a.txt": "general", "b.md": "sub", "c.TXT": "sub/deep", "t.csv": "tables", "d.svg": "general", "e.svg": "general"}
    texts = co.extracted(files)
    by_name = {r.path.rsplit("/", 1)[1]: r.text for r in texts.collect()}
    assert (by_name["a.txt"], by_name["d.svg"], co.extract_text("csv", b"")[0]) == ("hi  there", "one\ntwo", "")
    assert by_name["t.csv"] == "| x | y |\n| --- | --- |\n| 1 | 2 |\n| 4,5 | 6 |"
    status = {r.path.rsplit("/", 1)[1]: r.status for r in co.import_report(files, texts).collect()}
    assert status == {"a.txt": "imported", "b.md": "imported", "c.TXT": "duplicate", "t.csv": "imported", "d.svg": "imported", "e.svg": "error"}


def test_rules(spark, tmp_path):
    for layer in ("base", "own"):
        (tmp_path / layer).mkdir()
    rule = {"rule_id": "r1", "condition": "cold", "snomed_codes": ["1"], "attributes": [{"name": "side", "required": True, "evidence_patterns": ["left"], "values": ["left"]}], "icd10_specific": {"left": "X1"}}
    (tmp_path / "base" / "a.json").write_text(json.dumps(rule))
    (tmp_path / "base" / "b.json").write_text(json.dumps([rule | {"rule_id": "r2"}, rule | {"rule_id": "r3", "attributes": None}], indent=1))
    (tmp_path / "base" / "bad.json").write_text("{")
    (tmp_path / "own" / "a.json").write_text(json.dumps(rule | {"condition": "warm"}))
    rules = co.load_rules(spark, str(tmp_path / "base"), str(tmp_path / "own"))
    assert {(r.rule_id, r.condition, r.layer) for r in rules.collect()} == {("r1", "warm", 3), ("r2", "cold", 1), ("r3", "cold", 1)}
    shaped = {r.rule_id: r for r in co.matchable(rules).collect()}
    assert shaped["r1"].attributes[0].asDict() == {"name": "side", "required": True, "patterns": ["left"], "values": ["left"], "codes": []}


def test_evaluation_set(spark, tmp_path):
    rows = [{"query": "a", "expected": "b"}, {"query": "c"}]
    (tmp_path / "e.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "e.jsonl").write_text("\n".join(map(json.dumps, rows)))
    for name in ("e.json", "e.jsonl"):
        assert sorted(map(tuple, co.evaluation_set(spark, str(tmp_path / name)).collect())) == [("a", "b"), ("c", None)]
    with pytest.raises(ValueError):
        co.evaluation_set(spark, "e.csv")


def test_split_text_by_hand():
    seps = ["\n\n", "\n", ". ", " "]
    assert rt.split_text("aa bb cc dd", 6, 3, seps) == ["aa bb", "bb cc", "cc dd"]
    assert rt.split_text("one\n\ntwo three four", 10, 0, seps) == ["one", "two three", "four"]
    assert rt.split_text("x" * 25, 10, 4, seps) == ["x" * 10, "x" * 10, "x" * 10, "x" * 7]
    assert rt.split_text("short", 10, 2, seps) == ["short"]


def test_recursive_chunks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id AS id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, " \n "), (-3, "w" * 9000)], docs.schema))
    got: dict = {}
    for r in rt.recursive_chunks(docs, 300, 80).orderBy("id", "chunk").collect():
        got.setdefault(r.id, []).append(r)
    assert [r.text for r in got[-1]] == [r.text for r in got[-2]] == ["[Empty document]"]
    for d in docs.filter("id <> -1 AND id <> -2").collect():
        assert [r.chunk for r in got[d.id]] == list(range(len(got[d.id])))
        covered = 0
        for r in got[d.id]:  # of bounded size, and each reaches on from what is covered with no gap but white space
            assert 0 < len(r.text) <= 300
            left = len(d.text) - len(d.text[covered:].lstrip())
            start = d.text.rfind(r.text, 0, left + len(r.text))
            assert start >= 0
            covered = max(covered, start + len(r.text))
        assert not d.text[covered:].strip()


def test_phases(spark, tmp_path):
    some = spark.range(5)
    stats = sn.run_phases({"a": some, "b": some.filter("id > 9"), "c": some.selectExpr("raise_error('no')"), "d": some}, str(tmp_path))
    assert [(s["phase"], s["rows"], s["status"]) for s in stats] == [("a", 5, "complete"), ("b", 0, "empty"), ("c", 0, "error")]
