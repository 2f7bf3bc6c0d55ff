"""Entity resolution: candidates by shared identifiers and trigrams, rules, decisions (ER, JN-06/07, WIN-05/06, SET-01).

Tables that grow with records, companies or names are joined by sort and merge: Spark judges a table by its compressed files, and would
send ones of a few megabytes, which are many times that as rows, whole through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import graph
from factloom.operators.cut import cut

# What matches score, the decision bands, and the search's bounds.
CIN_SCORE, GSTIN_SCORE, DOMAIN_SCORE, EMAIL_SCORE = 1.0, 0.95, 0.75, 0.60
SAME_NAME_PLACED, SAME_NAME, LIKE_NAME_PLACED, LIKE_NAME = 0.75, 0.55, 0.65, 0.30
SAME, LIKE = 0.98, 0.85
AUTO, REVIEW = 0.90, 0.50
CANDIDATES, LEAST_SIMILARITY = 10, 0.3
#: Similarities above which names are looked for first.
STEPS = (0.55,)
#: Names of one trigram that meet in a task at most, on each side.
CHUNK = 4000
#: Different trigrams that are sent to all tasks at most.
SENT = 100_000
SIGNALS = ("cin", "gstin", "domain", "name", "state", "postal", "email_domain")


def folded(signals: DataFrame, key: str) -> DataFrame:
    """ER-01/02: the signals as they are compared, empty ones null (candidates are found on what is scored)."""
    empty = lambda c: F.nullif(c, F.lit(""))
    c = F.col
    return signals.select(
        c(key),
        *(empty(text.identifier(c(n))).alias(n) for n in ("cin", "gstin")),
        *(empty(F.lower(text.strip_all(c(n)))).alias(n) for n in ("domain", "state", "email_domain")),
        *(empty(c(n)).alias(n) for n in ("name", "postal")),
    )


def _first(rows: DataFrame, by: str, order: list[Column], count: int) -> DataFrame:
    """The first rows of each group; Spark cuts the groups in every task before it shuffles them."""
    place = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(place)).filter(F.col("__n") <= count).drop("__n")


def exact_candidates(records: DataFrame, companies: DataFrame, cap: int | None = CANDIDATES) -> DataFrame:
    """JN-06: (record_id, company_id) that share a CIN, GSTIN or domain: three equi-joins, so no nested loop. As the first ``cap``
    count, a domain that very many companies share takes part with its first ``cap`` only."""

    def shared(name: str) -> DataFrame:
        side = companies.select("company_id", name).filter(F.col(name).isNotNull())
        side = side if cap is None else _first(side, name, [F.asc("company_id")], cap)
        return records.select("record_id", name).join(side.hint("merge"), name).select("record_id", "company_id")

    found = shared("cin").union(shared("gstin")).union(shared("domain")).distinct()
    return found if cap is None else _first(found, "record_id", [F.asc("company_id")], cap)


def ranked_trigrams(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, name, t, on_left_of, on_right_of, size, met, bits, on_left, on_right): distinct names with their trigrams, those first at which the
    fewest pairs meet, how many names of each side have each, how many of them both sides have, 128 bits of which each such trigram
    sets one, and the sides they are on. Ids are numbers that only the table they are written to keeps."""
    sides = left.select("name", F.lit(True).alias("l"), F.lit(False).alias("r")).union(right.select("name", F.lit(False), F.lit(True)))
    names = sides.filter("name IS NOT NULL").groupBy("name").agg(F.max("l").alias("on_left"), F.max("r").alias("on_right"))
    pieces = names.select("*", F.explode(text.trigrams(F.col("name"))).alias("piece"))
    often = cut(pieces.groupBy("piece").agg(F.count_if("on_left").alias("l"), F.count_if("on_right").alias("r")), "often")
    often = F.broadcast(often) if often.count() <= SENT else often.hint("merge")
    each = F.sort_array(F.collect_list(F.struct((F.col("l") * F.col("r")).alias("pairs"), "piece", "l", "r")))  # of one name, so as long as it
    rows = pieces.join(often, "piece").groupBy("name", "on_left", "on_right").agg(each.alias("e"))
    alone = F.size(F.filter("e", lambda x: x["pairs"] == 0))  # trigrams of one side's names, which come first
    rows = rows.select(
        F.monotonically_increasing_id().alias("id"), "name", F.col("e.piece").alias("t"), F.col("e.l").alias("on_left_of"), F.col("e.r").alias("on_right_of"),
        F.size("e").alias("size"), (F.size("e") - alone).alias("met"), "on_left", "on_right",
    )
    shared = F.slice("t", F.col("size") - F.col("met") + 1, F.col("met"))

    def half(bits: int) -> Column:
        own = F.filter(F.transform(shared, lambda p: F.pmod(F.xxhash64(p), F.lit(128)).cast("int")), lambda x: F.shiftright(x, 6) == bits)
        one = lambda held, x: held.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63))))
        return F.aggregate(own, F.lit(0).cast("long"), one)

    return rows.withColumn("bits", F.struct(half(0).alias("low"), half(1).alias("high")))


def _prefixes(side: DataFrame, least: float, own: str, other: str, smaller: int) -> DataFrame:
    """Rows of a name's rarest trigrams, of which one at least is shared with any partner more similar than ``least``: a partner that isn't
    smaller shares more than 2 * least / (1 + least) of this name's trigrams, any other one ``least`` of them. In the join of
    kind ``smaller`` this side's name is not the greater one, so the fewer rows are enough.

    A trigram that only one side's names have meets nothing. Rows of one that many have are dealt into chunks by id, each a copy for every
    chunk of the other side, so that any two chunks meet once, and no task gets all of them."""
    short, long = ((F.col("size") - F.floor(share * F.col("size") - 1e-9)).cast("int") for share in (2 * least / (1 + least), least))
    counts = {"a": "on_left_of", "b": "on_right_of"}
    head = F.arrays_zip(*(F.slice(c, F.lit(1), long).alias(n) for n, c in (("piece", "t"), ("own", counts[own]), ("other", counts[other]))))
    rows = side.select("id", "size", "met", "bits", short.alias("short"), F.posexplode(head).alias("place", "p")).filter("p.other > 0")
    kinds = F.when(F.col("place") < F.col("short"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1 - smaller)))
    chunks, others = (F.ceil(F.col(f"p.{n}") / CHUNK).cast("int") for n in ("own", "other"))
    rows = rows.select(F.struct("id", "size", "met", "bits", "place").alias(own), F.xxhash64("p.piece").alias("piece"), F.pmod("id", chunks).cast("int").alias(own + "_chunk"), others.alias("others"), F.explode(kinds).alias("kind"))
    return rows.select(own, "piece", own + "_chunk", "kind", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias(other + "_chunk"))


def _pairs_above(ranked: DataFrame, left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(left_name, right_name, similarity) of names more similar than ``least``; ``left`` and ``right`` are rows of ``ranked``.

    Names that are share one of the rarest trigrams of both. What meets there is judged by numbers only: by sizes, by how many trigrams
    can still be shared behind the first one's places, and by the bits that differ, as each of these needs a trigram of
    one name alone. Only trigrams that both sides have count there, as no other is shared. Trigrams themselves travel for the pairs that are left."""
    a, b = _prefixes(left, least, "a", "b", 0), _prefixes(right, least, "b", "a", 1)
    n, m = F.col("a.size"), F.col("b.size")
    needed = least / (1 + least) * (n + m) - 1e-9
    sized = ((F.col("kind") == 0) == (n <= m)) & (F.least(n, m) > least * F.greatest(n, m))
    differ = sum(F.bit_count(F.col(f"a.bits.{x}").bitwiseXOR(F.col(f"b.bits.{x}"))) for x in ("low", "high"))
    meet = ["piece", "kind", "a_chunk", "b_chunk"]
    # a count of its own, as the work is in the pairs: by their few bytes, adaptive execution would make one task of all rows
    tasks = int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = a.repartition(tasks, *meet).hint("merge").join(b.repartition(tasks, *meet), meet).filter(sized & (F.least(n - F.col("a.place"), m - F.col("b.place")) > needed) & (differ < F.col("a.met") + F.col("b.met") - 2 * needed))
    found = near.select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))
    whole = lambda s: ranked.select(F.col("id").alias(f"{s}_id"), F.struct("name", "t").alias(s))
    pairs = found.distinct().join(whole("a").hint("merge"), "a_id").join(whole("b").hint("merge"), "b_id")
    common = F.size(F.array_intersect("a.t", "b.t"))
    similarity = common / (F.size("a.t") + F.size("b.t") - common)
    return pairs.select(F.col("a.name").alias("left_name"), F.col("b.name").alias("right_name"), similarity.alias("similarity")).filter(F.col("similarity") > least)


def similar_pairs(left: DataFrame, right: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """JN-07, STR-14: (left_name, right_name, similarity) over distinct names, by shared trigrams."""
    ranked = cut(ranked_trigrams(left, right), "trigrams")
    return _pairs_above(ranked, ranked.filter("on_left"), ranked.filter("on_right"), least)


def fuzzy_candidates(records: DataFrame, companies: DataFrame, top: int = CANDIDATES, least: float = LEAST_SIMILARITY) -> DataFrame:
    """JN-07, WIN-06: the ``top`` companies of most similar names, for each record.

    Names with a trigram that very many have go through ``STEPS`` first: one that finds ``top`` companies above such a similarity has
    found its best, and looks no further, so that all but the odd ones never meet the many that are hardly alike. Of
    companies with one name the first ``top`` can count."""
    ranked = cut(ranked_trigrams(records, companies), "trigrams")
    left, right = ranked.filter("on_left"), ranked.filter("on_right")
    owners = _first(companies.select("company_id", F.col("name").alias("right_name")).filter("right_name IS NOT NULL"), "right_name", [F.asc("company_id")], top)
    best, found = [F.desc("similarity"), F.asc("company_id")], None

    def nearest(names: DataFrame, above: float) -> DataFrame:
        pairs = _pairs_above(ranked, names, right, above).join(owners.hint("merge"), "right_name").select("left_name", "company_id", "similarity")
        return _first(pairs, "left_name", best, top)

    rare = F.slice("on_right_of", F.lit(1), (F.col("size") - F.floor(least * F.col("size") - 1e-9)).cast("int"))
    for step in [x for x in STEPS if x > least]:
        crowded = left.filter(F.array_max(rare) > CHUNK)
        if not crowded.limit(1).count():
            break
        now = cut(nearest(crowded, step), "similar")
        full = now.groupBy(F.col("left_name").alias("name")).count().filter(F.col("count") >= top).hint("merge")
        left = left.join(full, "name", "left_anti")
        done = now.join(full, now.left_name == full.name, "left_semi").select(*now.columns)
        found = done if found is None else found.union(done)
    rest = nearest(left, least)
    found = rest if found is None else found.union(rest)
    return records.select("record_id", F.col("name").alias("left_name")).join(found.hint("merge"), "left_name").select("record_id", "company_id", "similarity")


def candidates(records: DataFrame, companies: DataFrame) -> DataFrame:
    """ER-03, SET-01: exact and fuzzy candidates, each once; exact ones come first."""
    both = exact_candidates(records, companies).select("record_id", "company_id", F.lit(0).alias("kind"), F.lit(None).cast("double").alias("similarity"))
    both = both.unionByName(fuzzy_candidates(records, companies).withColumn("kind", F.lit(1)))
    return both.groupBy("record_id", "company_id").agg(F.min("kind").alias("kind"), F.max("similarity").alias("similarity"))


def rules(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """ER-04, ER-06: what two sides' signals say; null where a side lacks the signal."""
    equal = {n: a[n] == b[n] for n in ("cin", "gstin", "domain", "email_domain", "state", "postal")}
    both = a["name"].isNotNull() & b["name"].isNotNull()
    return {**equal, "name_similarity": F.when(both, text.token_sort_similarity(a["name"], b["name"]))}


def match_score(found: dict[str, Column]) -> Column:
    """ER-04: the best of the rules that fire."""
    placed = F.coalesce(found["state"], F.lit(False)) | F.coalesce(found["postal"], F.lit(False))
    name = found["name_similarity"]
    by_name = (
        F.when(name >= SAME, F.when(placed, SAME_NAME_PLACED).otherwise(SAME_NAME))
        .when(name >= LIKE, F.when(placed, LIKE_NAME_PLACED).otherwise(LIKE_NAME))
        .otherwise(0.0)
    )
    fired = [F.when(found[n], s).otherwise(0.0) for n, s in (("cin", CIN_SCORE), ("gstin", GSTIN_SCORE), ("domain", DOMAIN_SCORE), ("email_domain", EMAIL_SCORE))]
    return F.greatest(*fired, F.coalesce(by_name, F.lit(0.0)))


def decision(score: Column) -> Column:
    """ER-05."""
    return F.when(score >= AUTO, "auto_match").when(score >= REVIEW, "review").otherwise("no_match")


def scored(pairs: DataFrame, records: DataFrame, companies: DataFrame) -> DataFrame:
    """Candidate pairs with ``score``, ``decision`` and the signals that say so."""
    a = records.select("record_id", *(F.col(n).alias(f"a_{n}") for n in SIGNALS))
    b = companies.select("company_id", *(F.col(n).alias(f"b_{n}") for n in SIGNALS))
    rows = pairs.join(a.hint("merge"), "record_id").join(b.hint("merge"), "company_id")
    found = rules({n: F.col(f"a_{n}") for n in SIGNALS}, {n: F.col(f"b_{n}") for n in SIGNALS})
    said = F.struct(*(c.alias(n) for n, c in found.items())).alias("signals")
    return rows.select(*pairs.columns, said).withColumn("score", match_score({n: F.col(f"signals.{n}") for n in found})).withColumn("decision", decision(F.col("score")))


def resolve(records: DataFrame, companies: DataFrame) -> DataFrame:
    """ER-07, WIN-05: each record's best company, or none: highest score, then exact before fuzzy, then similarity."""
    judged = scored(candidates(records, companies), records, companies)
    best = Window.partitionBy("record_id").orderBy(F.desc("score"), F.asc("kind"), F.desc_nulls_last("similarity"), F.asc("company_id"))
    first = judged.withColumn("n", F.row_number().over(best)).filter("n = 1").drop("n", "kind", "similarity")
    out = records.select("record_id", F.col("name").alias("record_name")).join(first.hint("merge"), "record_id", "left")
    return out.withColumns({"score": F.coalesce("score", F.lit(0.0)), "decision": F.coalesce("decision", F.lit("no_match"))})


def outcomes(resolved: DataFrame) -> DataFrame:
    """ER-08, ER-09: what becomes of each record: attached, queued for review, a new company, or dropped without a name."""
    named = F.coalesce(F.col("record_name") != "", F.lit(False))
    what = F.when(F.col("decision") == "auto_match", "attach").when(F.col("decision") == "review", "queue").when(named, "create").otherwise("drop")
    new_id = F.when(what == "create", F.sha2(F.concat_ws("|", F.lit("company"), F.col("record_id").cast("string")), 256))
    return resolved.withColumns({"outcome": what, "new_company_id": new_id})


def review(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """ER-10, ER-11: pending rows can be confirmed, any row can be rejected."""
    status = (
        F.when((F.col("verdict") == "confirm") & (F.col("status") == "pending"), "confirmed")
        .when(F.col("verdict") == "reject", "rejected").otherwise(F.col("status"))
    )
    return queue.join(decisions, "candidate_id", "left").withColumn("status", status).drop("verdict")


def first_come(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """ER-09, order-dependent creation: nodes (id, in order of arrival) and edges (earlier, later) that score for review or more. A
    node is new unless an earlier neighbour is; the rest goes to review."""
    behind = graph.behind_first(edges).select("id", F.lit("review").alias("state"))
    return nodes.select("id").join(behind, "id", "left").select("id", F.coalesce("state", F.lit("new")).alias("state"))


def decision_counts(resolved: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """AGG-09: what an import's records came to, as counters; ``failures``: rows that could not be read."""
    counts = outcomes(resolved).agg(
        F.count_if(F.col("outcome") == "create").alias("new_companies"),
        F.count_if(F.col("outcome") == "attach").alias("existing_companies"),
        F.count_if(F.col("outcome") == "queue").alias("ambiguous_matches"),
        F.count_if(F.col("outcome") == "drop").alias("no_match"),
    )
    if failures is None:
        return counts.withColumn("parsing_failures", F.lit(0).cast("long"))
    return counts.join(F.broadcast(failures.agg(F.count("*").alias("parsing_failures"))))  # a row each
