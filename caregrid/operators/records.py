"""Operators over linked records: lookups and edges between coded tables, logs and their totals, exports, views and answer rules.

Tables and columns are parameters; results keep the names of the columns given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textjoin import contained

from ..functions.scalars import confidence_label


def enrich(rows: DataFrame, details: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with n, how many details they have, and flags, the different values joined by commas; none: 0 and ''."""
    found = details.groupBy(key).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set(value)), ",").alias("flags"))
    return rows.join(found, key, "left").withColumns({"n": F.coalesce("n", F.lit(0)), "flags": F.coalesce("flags", F.lit(""))})


def code_edges(codes: DataFrame, known: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Different (src, dst) whose src is among the known nodes."""
    return codes.select(src, dst).distinct().join(known.select(src).distinct(), src, "left_semi")


def cross_edges(edges: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Different (src, dst) with src in ``left`` (src) and dst in ``right`` (dst)."""
    return code_edges(edges, left).join(right.select("dst").distinct(), "dst", "left_semi").select("src", "dst")


def first_codes(nodes: DataFrame, codes: DataFrame, key: str, n: int = 5, second: DataFrame | None = None) -> DataFrame:
    """Each node with its n smallest codes as text, '' for none; ``second`` (code, next) adds a hop that a code may lack."""
    if second is not None:
        codes = codes.join(second, "code", "left").select(key, F.coalesce("next", "code").alias("code"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("code"))
    first = codes.select(key, "code").distinct().withColumn("_place", place).filter(F.col("_place") <= n)
    lists = first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("code")), lambda c: c.cast("string")), ",").alias("codes"))  # at most n
    return nodes.select(key).join(lists, key, "left").withColumn("codes", F.coalesce("codes", F.lit("")))


def designated(rows: DataFrame, table: DataFrame, key: str, default: str = "NONE") -> DataFrame:
    """``rows`` with the designation of their code; a code without one has the default."""
    return rows.join(table.select(key, "designation"), key, "left").withColumn("designation", F.coalesce("designation", F.lit(default)))


def context_links(used: DataFrame, cards: DataFrame, prefix: str = "memory:") -> DataFrame:
    """Different links from a source to the card that its id with the prefix names; ids of other kinds and of no card give none."""
    ids = used.filter(F.startswith("rid", F.lit(prefix))).withColumn("card", F.substring("rid", F.lit(len(prefix) + 1), F.length("rid")).try_cast("long")).drop("rid").distinct()
    return ids.join(cards.select("card").distinct(), "card")


def inherited(entries: DataFrame, mentions: DataFrame, keys: list[str]) -> DataFrame:
    """(entry, concept): an entry is about the concepts that its source cards mention."""
    return entries.join(mentions, keys).select("entry", "concept").distinct()


def type_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def profile(rows: DataFrame, key: str, at: str) -> DataFrame:
    """How many rows a key has, its first and its last time."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))


def counts_by_each(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Counts by each column alone, in one pass; columns: name in the table -> name in the result."""
    one = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("_k"), F.col(c).cast("string").alias("_v")) for k, c in enumerate(columns)])).alias("_x")).groupBy("_x").agg(F.count("*").alias("n"))
    return one.select(*[F.when(F.col("_x._k") == k, F.col("_x._v")).alias(name) for k, name in enumerate(columns.values())], "n")


def rating_totals(feedback: DataFrame, rating: str = "rating") -> DataFrame:
    """One row: total, positive, negative, rate (0 where there is none)."""
    pos, neg = F.count_if(F.col(rating) == "positive"), F.count_if(F.col(rating) == "negative")
    return feedback.agg(F.count("*").alias("total"), pos.alias("positive"), neg.alias("negative"), F.coalesce(F.round(F.try_divide(pos, F.count("*")), 3), F.lit(0.0)).alias("rate"))


def rating_averages(feedback: DataFrame, calls: DataFrame, key: str, score: str, duration: str) -> DataFrame:
    """Mean score and whole mean duration of the calls of each rating."""
    return feedback.join(calls, key).groupBy("rating").agg(F.round(F.avg(score), 6).alias("grounding"), F.floor(F.avg(duration)).cast("int").alias("duration"))


def daily_ratings(feedback: DataFrame, now: DataFrame, days: int = 30, at: str = "ts") -> DataFrame:
    """Ratings by day of the last ``days``; ``now`` has one row, now."""
    rows = feedback.crossJoin(F.broadcast(now)).filter(F.col(at) > F.col("now") - F.expr(f"INTERVAL {int(days)} DAYS"))
    return rows.groupBy(F.to_date(at).alias("day")).agg(F.count_if(F.col("rating") == "positive").alias("positive"), F.count_if(F.col("rating") == "negative").alias("negative"))


def monthly_counts(rows: DataFrame, at: str, category: str) -> DataFrame:
    return rows.groupBy(F.date_format(at, "yyyy-MM").alias("month"), F.col(category).alias("category")).agg(F.count("*").alias("n"))


def diversity(rows: DataFrame, key: str, source: str, prefixes: dict[str, str], full: int = 3) -> DataFrame:
    """Of ``full`` kinds of sources, the share that a key has; the first prefix that fits names the kind, else 'other'."""
    kind = F.lit("other")
    for prefix, name in reversed(prefixes.items()):
        kind = F.when(F.startswith(source, F.lit(prefix)), name).otherwise(kind)
    return rows.groupBy(key).agg(F.round(F.least(F.count_distinct(kind) / full, F.lit(1.0)), 6).alias("diversity"))


def feedback_with_call(feedback: DataFrame, calls: DataFrame, key: str, prompt: str, rating: str | None = None, n: int = 50, at: str = "ts", order: str = "event_id") -> DataFrame:
    """The newest feedback (of one rating) with the first 80 characters of its call's prompt; null where the call is gone."""
    rows = feedback if rating is None else feedback.filter(F.col("rating") == rating)
    return rows.join(calls.select(key, prompt), key, "left").select(order, at, F.substring(prompt, 1, 80).alias("prompt")).orderBy(F.desc(at), F.desc(order)).limit(n)


def claim_rollup(claims: DataFrame, key: str, score: Column, supported: float = 0.5, weak: float = 0.2) -> DataFrame:
    """Supported, weak and unsupported claims of each key, their mean, its label and a sentence."""
    rows = claims.groupBy(key).agg(
        F.count_if(score >= supported).alias("supported"), F.count_if((score >= weak) & (score < supported)).alias("weak"), F.count_if(score < weak).alias("unsupported"), F.round(F.avg(score), 6).alias("confidence")
    )
    total = F.col("supported") + F.col("weak") + F.col("unsupported")
    return rows.withColumn("label", confidence_label(F.col("confidence"))).withColumn("detail", F.format_string("%d of %d supported", "supported", total))


def turn_history(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """role:hash of the turns of a session in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, role, F.sha2(text, 256).alias("hash"))))  # bounded by the session
    return turns.groupBy(key).agg(F.array_join(F.transform(rows, lambda t: F.concat_ws(":", t[role], F.substring(t["hash"], 1, 8))), ",").alias("history"))


def session_list(turns: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text", n: int = 50, preview: int = 60) -> DataFrame:
    """The newest sessions with their number of messages and the start of the first."""
    rows = turns.groupBy(key).agg(F.count("*").alias("messages"), F.min_by(text, order).alias("first"))
    return rows.select(key, "messages", F.substring("first", 1, preview).alias("preview")).orderBy(F.desc(key)).limit(n)


def newest_first(rows: DataFrame, at: str, tie: str, n: int = 50) -> DataFrame:
    return rows.orderBy(F.desc(at), tie).limit(n)


def card_filter(cards: DataFrame, order: list[str], approval: str | None = None, category: str | None = None, search: str | None = None, text: str = "text", reason: str = "reason") -> DataFrame:
    """Cards of an approval state and category that hold a text, in any case, in theirs or in the reason of their origin; newest first."""
    rows = cards
    if approval is not None:
        rows = rows.filter(F.col("approval") == approval)
    if category is not None:
        rows = rows.filter(F.col("category") == category)
    if search:
        held = lambda c: F.coalesce(F.contains(F.lower(F.col(c)), F.lit(search.lower())), F.lit(False))
        rows = rows.filter(held(text) | held(reason))
    return rows.orderBy(*map(F.desc, order))


def name_search(rows: DataFrame, query: str, state: str | None = None, n: int = 20, key: str = "provider", name: str = "name", city: str = "city", aliases: str = "aliases", order: str = "discharges") -> DataFrame:
    """Rows whose id is the query, whose name or an alias holds it, or whose city is it or starts with it and a blank.

    rank: 0 for the id, 1 where name, city or an alias starts with the query, else 2; then by ``order`` falling, then name.
    """
    low, q = (lambda c: F.lower(F.col(c))), F.lit(query.strip().lower())
    names = F.coalesce(F.transform(aliases, lambda a: F.lower(a)), F.array().cast("array<string>")) if aliases in rows.columns else F.array().cast("array<string>")
    place = low(city) if city in rows.columns else F.lit(None).cast("string")
    same, in_city = F.lower(F.col(key).cast("string")) == q, F.coalesce((place == q) | F.startswith(place, F.concat(q, F.lit(" "))), F.lit(False))
    hit = same | F.coalesce(F.contains(low(name), q), F.lit(False)) | in_city | F.exists(names, lambda a: F.contains(a, q))
    starts = F.coalesce(F.startswith(low(name), q), F.lit(False)) | F.coalesce(F.startswith(place, q), F.lit(False)) | F.exists(names, lambda a: F.startswith(a, q))
    found = rows.filter(hit if state is None else hit & (F.col("state") == state))
    return found.withColumn("rank", F.when(same, 0).when(starts, 1).otherwise(2)).orderBy("rank", F.desc_nulls_last(order), name).limit(n)


def name_searches(rows: DataFrame, queries: DataFrame, n: int = 20, key: str = "provider", name: str = "name", city: str = "city", aliases: str = "aliases", order: str = "discharges") -> DataFrame:
    """queries(q, query) -> q, place and the rows of ``name_search`` for each query, in one plan; a blank query finds nothing.

    Ids and cities (whole, or up to any blank) are joined as they are, names and aliases by a rare trigram of the query.
    Keys are unique. Hits that are alike in rank, order and name come in order of the key.
    """
    asked = queries.select("q", F.lower(F.trim("query")).alias("_a")).filter("_a <> ''")
    none = F.array().cast("array<string>")
    names = F.coalesce(F.transform(aliases, lambda a: F.lower(a)), none) if aliases in rows.columns else none
    place = F.lower(F.col(city)) if city in rows.columns else F.lit(None).cast("string")
    parts = F.split(place, " ")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), " "))
    told = rows.select(F.col(key).alias("_key"), F.lower(F.col(key).cast("string")).alias("_id"), F.coalesce(heads, none).alias("_heads"), F.array_compact(F.array_append(names, F.lower(F.col(name)))).alias("_names"))
    spread = told.select("_key", F.explode(F.array_distinct("_names")).alias("text"))
    held = contained(asked.select(F.col("_a").alias("needle")).distinct(), spread.select("text").distinct())
    by_name = held.join(spread, "text").select(F.col("needle").alias("_a"), "_key")
    by_id_ = told.select(F.col("_id").alias("_a"), "_key")
    by_city = told.select(F.explode("_heads").alias("_a"), "_key")
    wanted = asked.select("_a").distinct()
    hits = by_name.unionByName(by_id_.join(wanted, "_a", "left_semi")).unionByName(by_city.join(wanted, "_a", "left_semi")).distinct()
    begins = lambda c: F.coalesce(F.startswith(c, F.col("_a")), F.lit(False))
    low = F.lower(F.col(name))
    starts = begins(low) | begins(place) | F.exists(names, lambda a: F.startswith(a, F.col("_a")))
    rank = F.when(F.lower(F.col(key).cast("string")) == F.col("_a"), 0).when(starts, 1).otherwise(2)
    found = asked.join(hits, "_a").join(rows.withColumn("_key", F.col(key)), "_key").withColumn("rank", rank)
    order_ = Window.partitionBy("q").orderBy("rank", F.desc_nulls_last(order), name, "_key")
    return found.withColumn("place", F.row_number().over(order_)).filter(F.col("place") <= n).drop("_a", "_key")


def substring_lookup(rows: DataFrame, text: str, search: str | None = None, code: str | None = None, codes: list | None = None, priority: tuple[str, str] | None = None) -> DataFrame:
    """Rows whose text holds ``search`` in any case (by_text), or whose code is among ``codes``; priority: (column, value) they must have."""
    by_text = F.coalesce(F.contains(F.lower(F.col(text)), F.lit(search.lower())), F.lit(False)) if search else F.lit(False)
    by_code = F.coalesce(F.col(code).isin(codes), F.lit(False)) if code and codes else F.lit(False)
    out = rows.withColumn("by_text", by_text).filter(F.col("by_text") | by_code)
    return out if priority is None else out.filter(F.col(priority[0]) == priority[1])


def by_id(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The rows with just this id, else those with it in another case."""
    found = rows.filter(F.lower(key) == value.lower())
    exact = found.agg(F.coalesce(F.bool_or(F.col(key) == value), F.lit(False)).alias("_exact"))
    return found.crossJoin(F.broadcast(exact)).filter(~F.col("_exact") | (F.col(key) == value)).drop("_exact")  # one row


def timeline(parts: dict[str, tuple[DataFrame, str, str, str]]) -> DataFrame:
    """What touches a concept, newest first. parts: kind -> (rows, concept, id and time columns)."""
    out = None
    for kind, (rows, concept, key, at) in parts.items():
        one = rows.select(F.col(concept).alias("concept"), F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(at).cast("timestamp").alias("at"))
        out = one if out is None else out.unionByName(one)
    return out.orderBy("concept", F.desc("at"), "kind", "id")


def view_counts(edges: DataFrame, views: dict[str, list[str]], kind: str = "type") -> DataFrame:
    """How many edges each view (a set of types) has; an edge counts in all that hold its type."""
    which = F.array(*[F.when(F.col(kind).isin(types), F.lit(name)) for name, types in views.items()])
    return edges.select(F.explode(F.array_compact(which)).alias("view")).groupBy("view").agg(F.count("*").alias("n"))


def csv_lines(rows: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and the CSV line of each row, all fields quoted, nulls as ''."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]
    return rows.select(*keep, F.to_csv(F.struct(*cells), {"quoteAll": "true", "escape": '"'}).alias("line"))


def session_markdown(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Blocks of each session's Markdown: a head (at -1) with the number of turns, then a block a turn."""
    head = turns.groupBy(key).agg(F.count("*").alias("n")).select(key, F.lit(-1).cast("long").alias(order), F.format_string("# Session %d\n\n%d turns", key, "n").alias("block"))
    blocks = turns.select(key, order, F.concat(F.lit("## "), F.initcap(role), F.lit("\n\n"), F.coalesce(text, F.lit(""))).alias("block"))
    return head.unionByName(blocks)


def category_markdown(rows: DataFrame, category: str, key: str, line: Column, categories: list[str] | None = None) -> DataFrame:
    """Lines of a Markdown file: place of the category, id (null: its heading), line. Written sorted by these three they are the file.

    ``categories`` fixes which come and in which order; empty ones have no heading. No category is gathered in one row.
    """
    place = F.array_position(F.array(*map(F.lit, categories)), F.col(category)) if categories else F.lit(0)
    items = rows.filter(place > 0) if categories else rows
    lines = items.select(F.col(category).alias("category"), place.cast("int").alias("place"), F.col(key).alias("id"), line.alias("line"))
    heads = lines.groupBy("category", "place").agg(F.count("*").alias("n")).select("category", "place", F.lit(None).cast(rows.schema[key].dataType).alias("id"), F.concat(F.lit("## "), F.col("category")).alias("line"))
    return heads.unionByName(lines)


#: The test of each kind of rule: (answer, value, threshold) -> held.
RULE_KINDS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "contains": lambda a, v, t: F.contains(F.lower(a), F.lower(v)),
    "not_contains": lambda a, v, t: ~F.contains(F.lower(a), F.lower(v)),
    "starts_with": lambda a, v, t: F.startswith(F.lower(F.trim(a)), F.lower(v)),
    "ends_with": lambda a, v, t: F.endswith(F.lower(F.trim(a)), F.lower(v)),
    "length_gt": lambda a, v, t: F.length(a) > v.try_cast("int"),
    "regex": lambda a, v, t: F.regexp_like(a, v),
    "tokens_gt": lambda a, v, t: F.size(F.split(F.trim(a), r"\s+")) > v.try_cast("int"),
    "fuzzy_match": lambda a, v, t: 1 - F.levenshtein(F.lower(a), F.lower(v)) / F.greatest(F.length(a), F.length(v)) >= t,
}


def answer_rules(answers: DataFrame, rules: list[tuple[str, str, float]], key: str, answer: str) -> DataFrame:
    """Whether all rules (kind, value, threshold) hold for an answer, and how many do not; a rule of an unknown kind holds."""
    table = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value"), F.lit(float(t)).alias("threshold")) for k, v, t in rules])
    rows = answers.select(key, F.col(answer).alias("_a"), F.explode(table).alias("_r"))
    held = F.lit(True)
    for kind, test in RULE_KINDS.items():
        held = F.when(F.col("_r.kind") == kind, test(F.col("_a"), F.col("_r.value"), F.col("_r.threshold"))).otherwise(held)
    return rows.groupBy(key).agg(F.bool_and(held).alias("passed"), F.count_if(~held).alias("failed"))


def first_decisions(decisions: DataFrame, card: str, decision: str, order: list[str]) -> DataFrame:
    """The first decision on each card counts; later ones change nothing."""
    return decisions.groupBy(F.col(card).alias("card")).agg(F.min_by(F.col(decision), F.struct(*order)).alias("decision"), F.count("*").alias("decisions"))


def promoted(cards: DataFrame, firsts: DataFrame, approve: str) -> tuple[DataFrame, DataFrame]:
    """Cards with their state (pending until decided), and one entry for each approved card."""
    state = F.when(F.col("decision").isNull(), "pending").when(F.col("decision") == approve, "approved").otherwise("rejected")
    told = cards.join(firsts.select("card", "decision"), "card", "left").withColumn("status", state)
    return told, told.filter("status = 'approved'").select("card").distinct()


def backfill(items: DataFrame, entries: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The entries to make, one for each item without any; and one row, how many are created and how many were there."""
    there = entries.select(key).distinct().withColumn("_there", F.lit(True))
    rows = items.select(key).distinct().join(there, key, "left")
    return rows.filter("_there IS NULL").select(key), rows.agg(F.count_if(F.col("_there").isNull()).alias("created"), F.count_if("_there").alias("skipped"))
