"""Checks of notes: mapping to codes, coverage, consistency, specificity, a report a note, and claims against evidence.

concepts(note, line, term, category, negated, qualifier, code, mapped_term, confidence): what was found in the notes.
``line`` tells a note's concepts apart. Lists are gathered a note at a time; a note is one document's concepts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import ancestors
from .store import written
from .textjoin import contained, sharing

#: Relationships that a documented concept is expected to have, with their priority.
EXPECTED = {
    "FINDING_SITE": "high",
    "ASSOCIATED_MORPHOLOGY": "high",
    "DIRECT_MORPHOLOGY": "high",
    "CAUSATIVE_AGENT": "medium",
    "PATHOLOGICAL_PROCESS": "medium",
    "DUE_TO": "medium",
    "PROCEDURE_SITE_DIRECT": "medium",
    "METHOD": "low",
    "INTERPRETS": "low",
    "AFTER": "low",
}
#: Words that do not count when a rule's condition and a term are compared.
COMMON = ["of", "the", "a", "an", "in", "on", "with", "and", "or", "to", "for", "acute", "chronic", "type", "unspecified"]
#: Rules beyond this number are not broadcast.
STEM = 6


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def expected_concepts(edges: DataFrame, terms: DataFrame, priorities: dict[str, str] = EXPECTED) -> DataFrame:
    """edges(src, dst, type), terms(code, term, synonyms) -> code, kind, priority, target, target_term, synonyms; other types go."""
    kept = edges.withColumn("priority", F.try_element_at(_map(priorities), F.col("type"))).filter("priority IS NOT NULL")
    named = terms.select(F.col("code").alias("dst"), F.col("term").alias("target_term"), "synonyms")
    return kept.join(named, "dst").select(F.col("src").alias("code"), F.col("type").alias("kind"), "priority", F.col("dst").alias("target"), "target_term", "synonyms")


def map_concepts(concepts: DataFrame, hits: DataFrame, entries: DataFrame, tags: dict[str, list[str]], drug_category: str, drug_types: list[str], threshold: float = 0.9) -> DataFrame:
    """concepts(q, category), hits(q, id, score, place), entries(id, ontology, tag) -> q, id, confidence, confirmed, refused, reason.

    A hit's confidence is 0.95 of its share of the query's best score. The expected tag adds 0.1, another one takes 0.3 of
    it. A drug entry of a known type adds 0.1 for a drug, of an unknown type takes a tenth, and half for other categories.
    The earliest of the best hits stays. Below the threshold, or without hits, the mapping is refused: no id, and a reason.
    """
    best = F.max("score").over(Window.partitionBy("q"))
    ratio = F.when((best > 0) & (F.col("score") > 0), F.round(F.least(F.col("score") / best * 0.95, F.lit(1.0)), 3)).otherwise(0.0)
    allowed = F.try_element_at(_map({k: "|".join(v) for k, v in tags.items()}), F.col("category"))
    fits = F.coalesce(F.array_contains(F.split(allowed, r"\|"), F.lower("tag")), F.lit(False))
    drug, known = F.col("category") == drug_category, F.lower("tag").isin(drug_types)
    is_drug_entry = F.col("ontology") == "rxnorm"
    up = F.least(F.col("_c") + 0.1, F.lit(1.0))
    of_drug = F.when(drug & known, up).when(drug, F.col("_c") * 0.9).otherwise(F.col("_c") * 0.5)
    of_term = F.when(fits, up).when(allowed.isNotNull(), F.col("_c") * 0.7).otherwise(F.col("_c"))
    rows = hits.withColumn("_c", ratio).join(entries, "id").join(concepts, "q")
    rows = rows.select("q", "id", "place", F.round(F.when(is_drug_entry, of_drug).otherwise(of_term), 6).alias("_s"), F.when(is_drug_entry, drug & known).otherwise(fits).alias("_ok"))
    first = rows.groupBy("q").agg(F.max_by(F.struct("id", "_s", "_ok"), F.struct("_s", -F.col("place"))).alias("b"))
    out = concepts.select("q").join(first, "q", "left")
    score = F.coalesce("b._s", F.lit(0.0))
    refused = score < threshold
    reason = F.when(F.col("b").isNull(), "no candidate").when(refused, F.concat(F.lit("confidence "), F.round(score, 3).cast("string"), F.lit(f" below threshold {threshold:.2f}")))
    return out.select("q", F.when(~refused, F.col("b.id")).alias("id"), F.round(score, 3).alias("confidence"), (~refused & F.coalesce("b._ok", F.lit(False))).alias("confirmed"), refused.alias("refused"), reason.alias("reason"))


def _documented(concepts: DataFrame, least: float, checkable: Column) -> DataFrame:
    """note, _codes, _terms, _checked: what each note documents, terms in lower case."""
    sure = F.col("code").isNotNull() & (F.col("confidence") >= least)
    low = lambda c: F.collect_set(F.when(sure, F.lower(c)))
    # whole rows are shuffled: they pack better than sets, and a note's concepts lie in few tasks
    rows = concepts.select("note", "code", "confidence", "category", "negated", "term", "mapped_term").repartition("note")
    rows = rows.groupBy("note").agg(F.collect_set(F.when(sure, F.col("code"))).alias("_codes"), low("term").alias("_a"), low("mapped_term").alias("_b"), F.collect_set(F.when(checkable, F.lower("term"))).alias("_checked"))
    return rows.select("note", "_codes", F.array_union("_a", "_b").alias("_terms"), "_checked")


def coverage(concepts: DataFrame, expectations: DataFrame, categories: list[str], least: float = 0.3, cap: int = 5) -> tuple[DataFrame, DataFrame]:
    """scores(note, coverage, checked) and missing(note, line, kind, priority, target, target_term, suggested).

    Concepts of the categories that are sure and not negated are checked against at most ``cap`` expectations of high or
    medium priority each (by priority, kind, target). One is met by its code, its term, its term without the tag or a
    synonym of three letters inside a documented term, or a word's first six letters there. A note's score is the mean of
    its concepts' shares; a concept without expectations, and a note without such concepts, has 1. Missing ones of low
    priority are listed too. Of the missing, the first five high and three medium ones of a note are suggested.
    """
    checkable = F.col("code").isNotNull() & (F.col("confidence") >= least) & F.col("category").isin(categories) & ~F.col("negated")
    order = F.array_position(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), F.col("priority"))
    scored = F.col("priority").isin("high", "medium")
    w = Window.partitionBy("code", scored).orderBy(order, "kind", "target")
    asked = expectations.withColumn("_n", F.row_number().over(w)).filter(~scored | (F.col("_n") <= cap)).drop("_n")
    checked = concepts.filter(checkable).select("note", "line", "code", F.lower("term").alias("_term"))
    documented = _documented(concepts, least, checkable)
    core = F.trim(F.substring_index(F.lower("target_term"), "(", 1))
    names = F.concat(F.array(core), F.transform(F.coalesce("synonyms", F.array().cast("array<string>")), F.lower))
    stems = F.transform(F.filter(F.split(F.array_join("_names", " "), " "), lambda x: F.length(x) >= STEM), lambda x: F.substring(x, 1, STEM))

    def told(asked: DataFrame, own: Column) -> DataFrame:
        """Each concept's expectations, with whether the note's terms or ``own`` meet them."""
        blob = F.array_join(F.concat("_terms", own), " ||| ")
        rows = checked.join(asked, "code", "left").join(documented, "note").withColumn("_names", names).withColumn("_blob", blob)
        met = (
            F.array_contains("_codes", F.col("target")) | F.coalesce(F.array_contains("_terms", F.lower("target_term")), F.lit(False))
            | F.exists("_names", lambda x: (F.length(x) >= 3) & F.contains(F.col("_blob"), x)) | F.exists(stems, lambda x: F.contains(F.col("_blob"), x))
        )
        return rows.select("note", "line", "kind", "priority", "target", "target_term", scored.alias("_scored"), F.coalesce(met, F.lit(False)).alias("_met"))

    rows = told(asked.filter(scored), F.array("_term"))  # scores need no other ones
    scored_met = F.try_divide(F.count_if(F.col("_scored") & F.col("_met")), F.count_if(F.col("_scored")))
    share = rows.groupBy("note", "line").agg(F.coalesce(scored_met, F.lit(1.0)).alias("s"))
    per_note = share.groupBy("note").agg(F.round(F.round(F.avg("s"), 9), 3).alias("coverage"), F.count("*").alias("checked"))
    notes = concepts.select("note").distinct().join(per_note, "note", "left")
    scores = notes.select("note", F.coalesce("coverage", F.lit(1.0)).alias("coverage"), F.coalesce("checked", F.lit(0)).alias("checked"))
    missing = told(asked, F.when(scored, F.array("_term")).otherwise(F.col("_checked"))).filter(F.col("kind").isNotNull() & ~F.col("_met"))
    rank = F.row_number().over(Window.partitionBy("note", "priority").orderBy("line", "kind", "target"))
    suggested = (F.col("priority") == "high") & (F.col("_r") <= 5) | (F.col("priority") == "medium") & (F.col("_r") <= 3)
    missing = missing.withColumn("_r", rank).select("note", "line", "kind", "priority", "target", "target_term", suggested.alias("suggested"))
    return scores, missing


def consistency(concepts: DataFrame, parents: DataFrame, tags: dict[str, list[str]], tag: str = "tag") -> tuple[DataFrame, DataFrame]:
    """flags(note, flag, severity, what) and verdicts(note, consistent): no error.

    Error: a term both affirmed and denied. Warning: a tag that its category does not expect. Info: a concept beside its
    parent; parents(child, parent).
    """
    term = F.lower(F.trim("term"))
    both = concepts.groupBy("note", term.alias("what")).agg(F.bool_or("negated").alias("_d"), F.bool_or(~F.col("negated")).alias("_a")).filter("_d AND _a")
    allowed = F.split(F.try_element_at(_map({k: "|".join(v) for k, v in tags.items()}), F.col("category")), r"\|")
    wrong = concepts.filter(F.col("code").isNotNull() & ~F.array_contains(allowed, F.lower(tag))).select("note", term.alias("what")).distinct()
    codes = concepts.filter("code IS NOT NULL").select("note", "code").distinct()
    pairs = codes.join(parents.select(F.col("child").alias("code"), F.col("parent")).distinct(), "code").filter("code <> parent")
    near = pairs.join(codes.withColumnRenamed("code", "parent"), ["note", "parent"], "left_semi").select("note", F.concat_ws(">", "code", "parent").alias("what"))
    flag = lambda rows, name, severity: rows.select("note", F.lit(name).alias("flag"), F.lit(severity).alias("severity"), "what")
    flags = flag(both, "negation", "error").unionByName(flag(wrong, "tag", "warning")).unionByName(flag(near, "parent", "info"))
    bad = both.select("note").distinct().withColumn("_bad", F.lit(True))
    return flags, concepts.select("note").distinct().join(bad, "note", "left").select("note", F.col("_bad").isNull().alias("consistent"))


def matching_rules(concepts: DataFrame, rules: DataFrame, edges: DataFrame) -> DataFrame:
    """concepts(code, term), rules(rule_id, condition, codes), edges(child, parent) -> code, term, rule_id, tier.

    Tier 1: the code is a rule's; 2: one of its ancestors within two steps is; 3: the condition is in the term, the term in
    the condition, or more than half of the condition's words (four letters or more, common ones left out) are the term's.
    Only a concept's first tier with rules counts. Blank conditions and terms match nothing. Tier 3 joins on
    rare trigrams and words, so the work grows with what matches, for any number of rules.
    """
    known = concepts.select("code", F.lower("term").alias("term")).distinct()
    by_code = rules.select("rule_id", F.explode("codes").alias("code"))
    one = known.join(by_code, "code").select("code", "term", "rule_id", F.lit(1).alias("tier"))
    up = ancestors(edges, 2).select(F.col("node").alias("code"), "ancestor").join(by_code.withColumnRenamed("code", "ancestor"), "ancestor").select("code", "rule_id").distinct()
    two = known.join(up, "code").select("code", "term", "rule_id", F.lit(2).alias("tier"))
    conditions = rules.select("rule_id", F.lower("condition").alias("_c"))
    common = F.array(*map(F.lit, COMMON))
    named, said = conditions.select("_c").distinct(), known.select("term").distinct()
    words = F.array_distinct(F.filter(F.array_except(F.split("_c", r"\s+"), common), lambda x: F.length(x) >= 4))
    pair = lambda c, t: (F.col(c).alias("_c"), F.col(t).alias("term"))
    inside = contained(named.withColumnRenamed("_c", "needle"), said.withColumnRenamed("term", "text")).select(*pair("needle", "text"))
    around = contained(said.withColumnRenamed("term", "needle"), named.withColumnRenamed("_c", "text")).select(*pair("text", "needle"))
    shared = sharing(named.select(F.col("_c").alias("name"), words.alias("words")), said.select(F.col("term").alias("text"), F.split("term", r"\s+").alias("words")), F.floor(F.size("words") / 2) + 1)
    terms = inside.unionByName(around).unionByName(shared.select(*pair("name", "text"))).distinct().join(conditions, "_c").select("term", "rule_id")
    three = known.join(terms, "term").select("code", "term", "rule_id", F.lit(3).alias("tier"))
    found = one.unionByName(two).unionByName(three).withColumn("_first", F.min("tier").over(Window.partitionBy("code", "term")))
    return found.filter("tier = _first").drop("_first").distinct()


def specificity(concepts: DataFrame, notes: DataFrame, rules: DataFrame, edges: DataFrame, categories: list[str], cues: str, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """notes(note, text), rules as in matching_rules with attributes -> scores(note, specificity, rules) and gaps(note, rule_id, line, missing, present, query).

    attributes: array of struct(name, required, patterns, values, codes). Sure concepts of the categories that neither they
    nor the text deny are matched to rules; a note meets a rule once, through its first concept. An attribute is present by
    the first pattern found in the text (its group, if it has one, else the whole match), by the concept's qualifier among
    the values, or by one of the codes affirmed in the note. A rule with a required attribute missing is a gap.
    """
    from ..functions.scalars import negated as denied

    sure = F.col("code").isNotNull() & (F.col("confidence") >= least) & F.col("category").isin(categories) & ~F.col("negated")
    picked = concepts.filter(sure).select("note", "line", "code", F.lower("term").alias("term"), F.lower("qualifier").alias("_q"))
    texts = notes.select("note", F.lower("text").alias("_text"))
    # a note's text stands beside its concepts for the check only: no shuffle has it once a concept
    picked = picked.join(texts, "note").filter(~F.coalesce(denied(F.col("_text"), F.col("term"), cues), F.lit(False))).drop("_text")
    picked = written(picked, "picked")
    found = picked.join(written(matching_rules(picked, rules, edges), "matched"), ["code", "term"])
    once = found.groupBy("note", "rule_id").agg(F.min_by(F.struct("line", "term", "_q"), "line").alias("c")).select("note", "rule_id", "c.*")
    once = written(once, "once")
    said = concepts.filter("code IS NOT NULL AND NOT negated").groupBy("note").agg(F.collect_set("code").alias("_said"))
    # rules have long patterns: they are joined last, on the rows of notes that meet one
    rows = once.join(said, "note", "left").join(texts, "note").join(rules.select("rule_id", "attributes"), "rule_id")
    group = lambda p: F.when(p.rlike(r"(?<!\\)\((?!\?)"), 1).otherwise(0)
    by_text = lambda a: F.get(F.filter(F.transform(a["patterns"], lambda p: F.trim(F.call_function("regexp_extract", F.col("_text"), p, group(p)))), lambda x: x != ""), 0)
    by_value = lambda a: F.when(F.exists(a["values"], lambda v: F.lower(v) == F.col("_q")), F.col("_q"))
    by_code = lambda a: F.get(F.array_sort(F.array_intersect(a["codes"], F.coalesce("_said", F.array().cast("array<string>")))), 0)
    held = F.transform("attributes", lambda a: F.struct(a["name"].alias("name"), a["required"].alias("required"), F.coalesce(by_text(a), by_value(a), by_code(a)).alias("value")))
    rows = rows.select("note", "rule_id", "line", "term", held.alias("h"))
    missing = F.transform(F.filter("h", lambda x: x["required"] & x["value"].isNull()), lambda x: x["name"])
    present = F.transform(F.filter("h", lambda x: x["value"].isNotNull()), lambda x: F.concat_ws(": ", x["name"], x["value"]))
    rows = rows.select("note", "rule_id", "line", "term", F.array_join(missing, ",").alias("missing"), F.array_join(present, "; ").alias("present"))
    per_note = rows.groupBy("note").agg(F.round(F.round(F.avg(F.when(F.col("missing") == "", 1.0).otherwise(0.0)), 9), 3).alias("specificity"), F.count("*").alias("rules"))
    scores = notes.select("note").join(per_note, "note", "left").select("note", F.coalesce("specificity", F.lit(1.0)).alias("specificity"), F.coalesce("rules", F.lit(0)).alias("rules"))
    found_text = F.when(F.col("present") == "", "no details found").otherwise(F.col("present"))
    query = F.concat(F.lit("Please clarify "), "term", F.lit(": "), F.replace("missing", F.lit(","), F.lit(", ")), F.lit(" (documented: "), found_text, F.lit(")"))
    return scores, rows.filter("missing <> ''").select("note", "rule_id", "line", "missing", "present", query.alias("query"))


def note_report(mapped: DataFrame, covered: DataFrame, verdicts: DataFrame, specific: DataFrame) -> DataFrame:
    """mapped(note, mapped, concepts) and the checks' scores -> note, overall, summary; a quarter each, an inconsistent note has half of one."""
    rows = mapped.join(covered, "note", "left").join(verdicts, "note", "left").join(specific, "note", "left").fillna({"coverage": 1.0, "consistent": True, "specificity": 1.0})
    parts = F.try_divide("mapped", "concepts") + F.col("coverage") + F.when(F.col("consistent"), 1.0).otherwise(0.5) + F.col("specificity")
    overall = F.coalesce(F.round(F.round(parts / 4, 9), 3), F.lit(0.0))
    counted = F.format_string("%d of %d concepts mapped", "mapped", "concepts")
    state = F.when(F.col("consistent"), "consistent").otherwise("inconsistent")
    return rows.select("note", overall.alias("overall"), F.concat_ws(", ", counted, state).alias("summary"))


def signed_report(report: DataFrame, notes: DataFrame) -> DataFrame:
    """``note_report`` with the first 16 hex digits of the SHA-256 of the note's text (notes(note, text); null: empty), for the audit trail."""
    signs = notes.select("note", F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 16).alias("note_hash"))
    return report.join(signs, "note", "left")


def validated_claims(claims: DataFrame, hits: DataFrame, mentions: DataFrame, nodes: DataFrame, weak: float = 0.2, support: float = 0.5) -> DataFrame:
    """claims(q), hits(q, id, score), mentions(q, concept), nodes(name) -> q, evidence, found, missing, supported, confidence.

    Scores within 1.5 are clamped to 0..1, greater ones divided by the claim's largest. Evidence is above ``weak``. Above
    ``support`` a claim is supported with its best score, and 0.1 more if the graph has one of its concepts; else, if most
    of its concepts are there, with 0.4 and 0.1 each. What has neither gets 0.1, the rest 0.25.
    """
    top = F.max(F.abs("score")).over(Window.partitionBy("q"))
    unit = F.greatest(F.least(F.when(F.abs("score") <= 1.5, F.col("score")).otherwise(F.col("score") / top), F.lit(1.0)), F.lit(0.0))
    seen = hits.select("q", F.round(unit, 6).alias("u")).filter(F.col("u") > weak).groupBy("q").agg(F.count("*").alias("evidence"), F.max("u").alias("best"))
    there = nodes.select(F.col("name").alias("concept")).distinct().withColumn("_in", F.lit(True))
    known = mentions.join(there, "concept", "left").groupBy("q").agg(F.count("_in").alias("found"), F.count_if(F.col("_in").isNull()).alias("missing"))
    rows = claims.select("q").join(seen, "q", "left").join(known, "q", "left").fillna({"evidence": 0, "best": 0.0, "found": 0, "missing": 0})
    strong, more = F.col("best") > support, F.col("found") > F.col("missing")
    by_evidence = F.least(F.col("best") + F.when(F.col("found") > 0, 0.1).otherwise(0.0), F.lit(1.0))
    confidence = F.when(strong, by_evidence).when(more, F.least(F.col("found") * 0.1 + 0.4, F.lit(1.0))).when(F.col("found") == 0, 0.1).otherwise(0.25)
    return rows.select("q", "evidence", "found", "missing", (strong | more).alias("supported"), F.round(F.round(confidence, 6), 3).alias("confidence"))


def code_suggestions(concepts: DataFrame, least: float = 0.3) -> DataFrame:
    """concepts with codes (an array) -> note, line, term, codes of those that are mapped, have codes and are sure enough."""
    return concepts.filter((F.size(F.coalesce("codes", F.array().cast("array<string>"))) > 0) & F.col("code").isNotNull() & (F.col("confidence") >= least)).select("note", "line", "term", "codes")


def _named_in(text: Column, names: list[str], whole: bool) -> Column:
    """Those of the names that stand in the text (as whole words, if asked), by one pattern in one pass.

    The pattern looks ahead at each place for the longest name there; names that begin another one are added where that one is found.
    """
    edge = r"[\p{L}\p{N}_]"
    before, after = (f"(?<!{edge})", f"(?!{edge})") if whole else ("", "")
    either = "|".join(rf"\Q{n}\E" for n in sorted(names, key=len, reverse=True))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"{before}(?=({either}){after})"), F.lit(1)))
    begin = {n: [m for m in names if m != n and n.startswith(m) and not (whole and (n[len(m)].isalnum() or n[len(m)] == "_"))] for n in names}
    more = [F.when(F.array_contains(found, n), F.array(*map(F.lit, own))).otherwise(F.array().cast("array<string>")) for n, own in begin.items() if own]
    return F.array_union(found, F.concat(*more)) if more else found


def dictionary_concepts(notes: DataFrame, key: str = "note", text: str = "text", most: int = 50) -> DataFrame:
    """key, place, term, category, negated, qualifier: the first ``most`` different concepts of a note.

    In this order: laboratory values with their unit, medications, abbreviations of conditions written out, terms (negated where a cue stands in the
    25 characters before the first mention; with the first qualifier there or in the 15 after it), procedures. A concept found twice counts once.
    Names are found in one pass a kind; only those found are looked at more closely. A null text has none.
    """
    from ..functions import vocabulary as vo

    kind = "struct<term:string,category:string,negated:boolean,qualifier:string>"
    names = [n for own in vo.NOTE_TERMS.values() for n in own]
    rows = notes.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("_low", F.lower("_t"))
    rows = rows.withColumns({"_m": _named_in(F.col("_low"), [*vo.MEDICATIONS, *vo.CONDITION_SHORT], True), "_n": _named_in(F.col("_low"), names, False)})
    t, low, words, held = (F.col(c) for c in ("_t", "_low", "_m", "_n"))
    one = lambda term, category, negated=F.lit(False), qualifier=F.lit(None): F.struct(term, F.lit(category), negated, qualifier.cast("string")).cast(kind)

    lab = rf"(?i)(?<![\p{{L}}\p{{N}}_])({'|'.join(vo.LABS)})\s*(?:of\s+)?(\d[\d,]*\.?\d*)\s*({'|'.join(vo.UNITS)})?"
    part = lambda k: F.regexp_extract_all(t, F.lit(lab), F.lit(k))
    labs = F.transform(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c")), lambda x: one(F.concat(x["a"], F.lit(" "), x["b"], F.coalesce(x["c"], F.lit(""))), "lab_value"))
    medications = [F.when(F.array_contains(words, m), one(F.lit(m), "medication")) for m in vo.MEDICATIONS]
    shorts = [F.when(F.array_contains(words, a), one(F.lit(x), "condition", low.rlike(rf"(?:no|denies|without)\s+\Q{a}\E"))) for a, x in vo.CONDITION_SHORT.items()]
    terms = []
    for category, own in vo.NOTE_TERMS.items():
        for name in own:
            at = F.locate(name, low)
            before = F.substring(low, F.greatest(at - 25, F.lit(1)), at - F.greatest(at - 25, F.lit(1)))
            after = F.substring(low, at, F.lit(len(name) + 15))
            near = F.coalesce(*[F.when(F.contains(before, F.lit(q)) | F.contains(after, F.lit(q)), q) for q in vo.QUALIFIERS])
            terms.append(F.when(F.array_contains(held, name), one(F.lit(name), category, before.rlike(vo.NEGATION), near)))
    procedures = [F.when(low.rlike(p), one(F.lit(x), "procedure")) for p, x in vo.PROCEDURES.items()]
    any_list = lambda xs, some: F.when(F.size(some) > 0, F.array_compact(F.array(*xs))).otherwise(F.array().cast(f"array<{kind}>"))
    found = F.concat(labs, any_list(medications + shorts, words), any_list(terms, held), F.array_compact(F.array(*procedures)))
    said = F.transform("found", lambda c: F.lower(F.trim(c["term"])))
    first = F.filter("found", lambda c, k: F.array_position(said, F.lower(F.trim(c["term"]))) == k + 1)
    return rows.select(key, found.alias("found")).select(key, F.posexplode(F.slice(first, 1, most)).alias("place", "c")).select(key, "place", "c.*")
