"""Personal data and the terms that give it away, in DataFrame expressions only.

Base entities are found by fixed patterns. The corpus then tells how strongly
the words of its documents reveal an entity: for a term t and an entity e that occurs
in at least ``support`` different texts, with counts of documents n(e), n(t) and
n(e, t) out of N,

    disclosure(t, e) = PMI(t, e) / IC(e) = 1 - log(n(t) / n(e, t)) / log(N / n(e)),

the share of the entity's information content that the term gives away. An entity
that occurs in fewer texts says nothing about its terms and backs off to the finest of its
groups that occurs in so many: the host and the end of the host of an
address, the first three, two and one parts of an IP, the first six, four, two
and one digits of a number, the kind. A term is a run of letters, marks and digits
outside the base spans, of any length and script; all terms of the whole text count,
wherever the entity stands, for n(t) and n(e, t) alike. In each document of the
entity, every occurrence of terms at ``remove_at`` or more is removed, and of
terms at ``generalise_at`` or more replaced by a general tag. Documents without
an entity are never changed, and pairs seen in fewer than ``support`` texts are
no evidence.

Positions come from splitting a text by a pattern and walking along pieces and
matches, in runs of bounded length, so that no array grows match by match.
Possessive quantifiers give the same leftmost matches as the plain patterns, in
linear time and constant stack on any text.

Null texts are empty; texts of any length are taken whole. Rows that agree in id and
text are one document and get equal results. Extra columns are left out; empty
tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, written

#: The kinds in order, and the pattern of each, with a test that most texts fail fast.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MAYBE = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": "+"}
KINDS = [*PATTERNS, "generalise", "remove"]
TAGS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalise": "[TERM]", "remove": ""}
TERM = r"[\p{L}\p{M}\p{N}]++"
SALT = 16
RUN = 128
SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"


def _let(value: Column, body) -> Column:
    """body(value), the value being worked out once: what a lambda takes from outside is worked out for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _walk(xs: Column, out_type: str, move, say) -> Column:
    """say(at, x) of each element, at going from 0 to move(at, x). Results are gathered in runs of RUN elements."""
    none, nones = F.array().cast(f"array<{out_type}>"), F.array().cast(f"array<array<{out_type}>>")

    def step(acc: Column, x: Column) -> Column:
        return F.struct(move(acc["at"], x).cast("int").alias("at"), F.concat(acc["out"], F.array(say(acc["at"], x).cast(out_type))).alias("out"))

    def run(acc: Column, part: Column) -> Column:
        add = lambda a: F.struct(a["at"].alias("at"), F.concat(acc["out"], F.array(a["out"])).alias("out"))
        return F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), step, add)

    runs = lambda xs: F.transform(F.sequence(F.lit(1), F.size(xs), F.lit(RUN)), lambda k: F.slice(xs, k, RUN))
    whole = lambda xs: F.aggregate(runs(xs), F.struct(F.lit(0).alias("at"), nones.alias("out")), run, lambda acc: F.flatten(acc["out"]))
    return _let(xs, lambda xs: F.when(F.size(xs) > 0, whole(xs)).otherwise(none))


def _spans(text: Column, pattern: str, rank: int) -> Column:
    """All matches as (start, rank, end, value), in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    both = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda h, g: F.struct(F.length(g).alias("gap"), F.length(h).alias("n"), h.alias("hit")))
    span = lambda at, x: F.struct(at + x["gap"], F.lit(rank), at + x["gap"] + x["n"], x["hit"])
    return _walk(both, "struct<start:int,rank:int,end:int,value:string>", lambda at, x: at + x["gap"] + x["n"], span)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.transform(F.split(F.reverse(_digits(value)), ""), lambda c, i: F.coalesce(c.try_cast("int"), F.lit(0)) * (1 + i % 2))
    total = F.aggregate(digits, F.lit(0), lambda acc, d: acc + F.when(d > 9, d - 9).otherwise(d))
    return F.length(_digits(value)).between(14, 19) & (total % 10 == 0)


def _byte_parts(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("long"), F.lit(256)) <= 255)


VALID = {"ip": _byte_parts, "card": _luhn, "phone": lambda v: F.length(_digits(v)).between(10, 15)}


def _only(spans: Column, valid) -> Column:
    return F.filter(spans, lambda s: valid(s["value"]))


def base_spans(text: Column) -> Column:
    """Valid matches of all kinds, by start, then kind."""
    kinds = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        test = text.contains(MAYBE[kind]) if len(MAYBE[kind]) == 1 else text.rlike(MAYBE[kind])
        spans = _spans(text, pattern, rank)
        if kind in VALID:
            spans = _only(spans, VALID[kind])
        kinds.append(F.when(test, spans).otherwise(F.array().cast(SPAN)))
    return F.array_sort(F.concat(*kinds))


def _entities(span: Column) -> Column:
    """The forms of an entity, however it is written, from the finest to its kind: (level, name)."""
    value, digits = F.lower(span["value"]), _digits(span["value"])
    host, parts = F.substring_index(value, "@", -1), F.split(value, r"\.")
    first = lambda n: F.array_join(F.slice(parts, 1, n), ".")
    forms = [
        F.array(value, F.concat(F.lit("@"), host), F.concat(F.lit("@."), F.substring_index(host, ".", -1))),
        F.array(value, first(3), first(2), first(1)),
        *[F.array(digits, *[F.substring(digits, 1, n) for n in (6, 4, 2, 1)])] * 2,
    ]
    named = F.element_at(F.array(*[F.concat(x, F.array(F.lit(""))) for x in forms]), span["rank"] + 1)
    return F.transform(named, lambda x, k: F.struct(k.alias("level"), F.concat_ws(":", span["rank"].cast("string"), k.cast("string"), x).alias("entity")))


def _blanked(text: Column, spans: Column) -> Column:
    """The text with as many blanks in the place of each span, so that places stay."""
    blanks = lambda s, r: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], r), F.lit(0)))
    return F.when(F.size(spans) > 0, _pieced(text, spans, blanks)).otherwise(text)


def disclosures(rows: DataFrame, held: DataFrame, support: int = 3) -> tuple[DataFrame, DataFrame]:
    """What the corpus (``rows``: _text) says of ``held``: the same rows with _key, _mark, base and, where that is not empty, _text.

    First _mark, entity, docs, term: the terms of each text of an entity, and how many documents the text has. Second
    entity, term, n_et, n_e, n_t, disclosure, for pairs with enough texts.
    """
    with_any = held.filter(F.size("base") > 0)
    mentions = with_any.select("_key", "_mark", F.explode("base").alias("s"))
    forms = mentions.select("_key", "_mark", F.struct("s.start", "s.rank").alias("at"), F.inline(_entities(F.col("s"))))
    # the key counts rows that agree in id and text once, everywhere
    frequent = forms.groupBy("entity").agg(F.count_distinct("_mark").alias("texts")).filter(F.col("texts") >= support).select("entity")
    chosen = _salted(forms, frequent, F.col("_mark")).groupBy("_key", "_mark", "at").agg(F.min_by("entity", "level").alias("entity"))
    # one row a text and entity, then one row a text: what equal texts hold is counted, not repeated
    holders = written(chosen.groupBy("_mark", "entity").agg(F.count_distinct("_key").alias("docs")), "holders")
    texts = with_any.select("_mark", "base", "_text").join(holders.select("_mark").distinct(), "_mark", "left_semi").dropDuplicates(["_mark"])
    together = holders.join(written(texts.select("_mark", _terms(_clear()).alias("terms")), "terms"), "_mark").select("_mark", "entity", "docs", F.explode("terms").alias("term"))
    pairs = together.groupBy("entity", "term").agg(F.sum("docs").alias("n_et"), F.count("*").alias("texts")).filter(F.col("texts") >= support).drop("texts")
    # n(t) is counted in whole texts, and put right where base spans stand in them
    counted = [(rows, _terms(_low(F.col("_text"))), 1), (with_any, _terms(_low(F.col("_text"))), -1), (with_any, _terms(_clear()), 1)]
    each = [df.select(F.explode(terms).alias("term"), F.lit(one).alias("one")) for df, terms, one in counted]
    totals = each[0].unionByName(each[1]).unionByName(each[2]).groupBy("term").agg(F.sum("one").alias("n_t"))
    n, n_e = max(held.count(), 2), holders.groupBy("entity").agg(F.sum("docs").alias("n_e"))
    ic = F.greatest(F.log(F.lit(float(n)) / F.col("n_e")), F.lit(1e-9))
    share = 1 - F.log(F.greatest(F.col("n_t"), F.col("n_et")) / F.col("n_et")) / ic
    return together, _salted(pairs, n_e, F.col("term")).join(totals, "term").withColumn("disclosure", share)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))


def _clear() -> Column:
    """The text in lower case without its base spans."""
    return _low(_blanked(F.col("_text"), F.col("base")))


def _salted(rows: DataFrame, one_each: DataFrame, by: Column) -> DataFrame:
    """``rows`` joined with ``one_each`` (one row an entity); a hot entity's rows go to SALT tasks."""
    spread = one_each.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("_salt", F.pmod(F.hash(by), F.lit(SALT))).join(spread, ["entity", "_salt"]).drop("_salt")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = 3, generalise_at: float = 0.8, remove_at: float = 0.95) -> DataFrame:
    """One row a document: id, _key, base and spans (arrays of start, rank, end, value; rank is the place in KINDS)."""
    rows = _keyed(id_and_text(docs, id_col, text_col))
    # the texts of documents with entities go along, for the terms in them
    held = written(rows.withColumn("base", base_spans(F.col("_text"))).withColumn("_text", F.when(F.size("base") > 0, F.col("_text"))), "spans")
    together, pairs = disclosures(rows, held, support)
    telling = pairs.filter(F.col("disclosure") >= generalise_at)
    rank = F.when(F.col("disclosure") >= remove_at, KINDS.index("remove")).otherwise(KINDS.index("generalise"))
    # a hot entity's rows are dealt over SALT tasks a term
    telling = telling.select("entity", "term", rank.cast("int").alias("rank"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt"))
    salted = together.select("_mark", "entity", "term", F.pmod(F.hash("_mark"), F.lit(SALT)).alias("_salt"))
    tells = salted.join(telling, ["entity", "term", "_salt"]).groupBy("_mark", "term").agg(F.max("rank").alias("rank"))
    named = tells.groupBy("_mark").agg(F.map_from_entries(F.collect_list(F.struct("term", "rank"))).alias("ranks"))  # bounded by the text
    both = held.join(named, "_mark", "left")
    spots = F.filter(_spans(_clear(), TERM, 0), lambda t: F.map_contains_key("ranks", t["value"]))
    more = F.transform(spots, lambda t: F.struct(t["start"].alias("start"), F.element_at("ranks", t["value"]).alias("rank"), t["end"].alias("end"), t["value"].alias("value")))
    more = F.when(F.col("ranks").isNotNull(), more).otherwise(F.array().cast(SPAN))
    return both.select(F.col("_id").alias(id_col), "_key", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def _low(text: Column) -> Column:
    """Lower case at the same places: the one letter that would become two is replaced first."""
    return F.lower(F.replace(text, F.lit("\u0130"), F.lit("i")))


def _keyed(rows: DataFrame) -> DataFrame:
    """_key names the document (id and text), _mark its text."""
    key = F.concat_ws(":", F.xxhash64("_id", "_text").cast("string"), F.xxhash64(F.lit(1), "_text", "_id").cast("string"), F.octet_length("_text").cast("string"))
    mark = F.concat_ws(":", F.xxhash64("_text").cast("string"), F.xxhash64(F.lit(1), "_text").cast("string"), F.octet_length("_text").cast("string"))
    return rows.withColumns({"_key": key, "_mark": mark})


def written_spans(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _pieced(text: Column, spans: Column, new) -> Column:
    """The text with ``new(span, r)`` in the place of each span, or of what it has beyond r, the reach of those before it."""
    farthest = lambda at, s: F.greatest(at, s["end"])
    reach = _walk(spans, "int", farthest, lambda at, s: at)  # how far the spans before each one go
    end = F.array_max(F.transform(spans, lambda s: s["end"]))

    def joined(chars: Column) -> Column:
        part = lambda a, z: F.array_join(F.slice(chars, a + 1, F.greatest(z - a, F.lit(0))), "")
        pieces = F.zip_with(spans, reach, lambda s, r: F.concat(part(r, s["start"]), new(s, r)))
        return F.concat(F.array_join(pieces, ""), part(end, F.size(chars)))

    return _let(F.split(text, ""), joined)


def replaced(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by the tag of its first."""
    tag = F.array(*[F.lit(TAGS[k]) for k in KINDS])
    first = lambda s, r: F.when(s["start"] >= r, F.element_at(tag, s["rank"] + 1)).otherwise(F.lit(""))
    return F.when(F.size(spans) > 0, _pieced(text, spans, first)).otherwise(text)


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` with personal data and telling terms replaced in the text; all other columns as they were."""
    found = find_spans(docs, id_col, text_col, **params).filter(F.size("spans") > 0).select("_key", "spans").dropDuplicates(["_key"])
    plain = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")  # no name of it can clash
    rows = _keyed(docs.select(row, F.col(id_col).cast("long").alias("_id"), plain.alias("_text")))
    out = rows.join(found, "_key", "left")
    text = F.when(F.col("spans").isNull(), F.col(f"_row.`{text_col}`")).otherwise(replaced(F.col("_text"), F.coalesce("spans", F.array().cast(SPAN))))
    return out.select(*[text.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
