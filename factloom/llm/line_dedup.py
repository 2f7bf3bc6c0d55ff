"""Line dedup: later copies of repeated runs of lines are deleted.

A document is the sequence of its lines that aren't blank, and every line begins a suffix of it. Prefix doubling sorts the
suffixes of all documents by their first 1, 2, 4, ... lines: a suffix's rank by ``2**(k + 1)`` lines is the place of its pair
of ranks by ``2**k`` lines, ``2**k`` lines apart, in a distributed sort of all such pairs; lines themselves rank by their
64-bit hashes. Only pairs that occur more than once are sorted and ranked: a suffix whose prefix is unique has no common
prefix of that length with any other, so it leaves, and later levels hold repeated text only.

Suffixes with the first r lines in common are an interval of the suffix array, the longest-common-prefix interval of depth
r. With 2**k <= r < 2**(k + 1) it is the one whose suffixes share their ranks of level k at their first line and at
the line ``2**k`` before the end, so an interval of any depth is known by two ranks, and an aggregate finds its first place;
no task holds an interval, one of a third of all lines neither.

A run repeats if it has ``min_words`` words and begins earlier too, by (key, line). All lines of such runs go.
They are found from the shortest runs of ``min_words`` words that begin or that end at a line: every line of a
maximal repeated run lies in one of these that is itself repeated, and each of these is a repeated run. As a
line that isn't blank has a word, they have ``min_words`` lines at most, which bounds the levels.

Defined results: null text stays null and has no lines; blank lines stay unless they lie inside a deleted run;
a text whose every line goes is empty; rows that agree in key and text are one document, so none is the other's
later copy; rows that share only the key are ordered by their text's hash; words are what blanks part; other columns pass
through and may have any names but the operator's outputs, which they give way to; an empty table stays empty.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import let_go, table, written

MIN_WORDS = 50


def _words(line: Column) -> Column:
    """Blanks and one, of what is between the outer blanks."""
    inner = F.trim(line)
    return F.when(inner == "", 0).otherwise(F.octet_length(inner) - F.octet_length(F.replace(inner, F.lit(" "), F.lit(""))) + 1)


def suffixes(docs: DataFrame, min_words: int) -> DataFrame:
    """A row for each line that isn't blank: its number i, its hash, and the shortest runs that begin and end there."""
    lines = (
        docs.select("k", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select("k", "th", "pos", _words(F.col("line")).alias("w"), F.xxhash64("line").alias("h"), F.octet_length("line").alias("size"))
        .filter("w > 0")
        .repartition("k", "th")
        .dropDuplicates(["k", "th", "pos"])
    )
    doc = Window.partitionBy("k", "th")
    by_place = doc.orderBy("pos")
    lines = lines.select(
        "*",
        (F.row_number().over(by_place)).alias("i"),
        F.sum("w").over(by_place).alias("upto"),
        F.sum("size").over(by_place).alias("sized"),
        F.sum("w").over(doc).alias("total"),
    )
    lines = lines.withColumns({"before": F.col("upto") - F.col("w"), "after": F.col("total") - F.col("upto")})
    within = (Window.unboundedPreceding, min_words - 1)
    return lines.select(
        "k", "th", "i", "pos", "h", "size", "sized",
        F.when(F.col("after") + F.col("w") >= min_words, F.max("i").over(doc.orderBy("before").rangeBetween(*within))).alias("stop"),
        F.when(F.col("upto") >= min_words, F.min("i").over(doc.orderBy("after").rangeBetween(*within))).alias("begin"),
    )


def ranked(rows: DataFrame, names: list[str]) -> DataFrame:
    """What several rows are named, with its place in a distributed sort."""
    repeated = rows.groupBy(*names).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    return repeated.repartitionByRange(*names).sortWithinPartitions(*names).withColumn("rank", F.monotonically_increasing_id())


def doubled(lines: DataFrame, min_words: int) -> list[DataFrame]:
    """Written rows (k, th, i, r) for each level: the ranks of suffixes whose first ``2**level`` lines begin another one too."""
    out = [written(lines.select("k", "th", "i", "h").join(ranked(lines, ["h"]), "h").select("k", "th", "i", F.col("rank").alias("r")), "ranks")]
    for level in range(min_words.bit_length() - 1):
        ahead = Window.partitionBy("k", "th").orderBy("i").rangeBetween(2**level, 2**level)
        pairs = out[-1].withColumn("s", F.max("r").over(ahead)).filter("s IS NOT NULL")
        out.append(written(pairs.join(ranked(pairs, ["r", "s"]), ["r", "s"]).select("k", "th", "i", F.col("rank").alias("r")), "ranks"))
    return out


def sequences(lines: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """A row for each document: its lines, each with its ranks, null where it is unique, and its shortest runs."""
    own = ["pos", "stop", "begin", "sized", "size"]
    names = [f"n{x}" for x in range(len(levels))]
    rows = lines.select("k", "th", "i", *own)
    for name, level in zip(names, levels, strict=True):
        rows = rows.unionByName(level.withColumnRenamed("r", name), allowMissingColumns=True)
    each = rows.repartition("k", "th").groupBy("k", "th", "i").agg(*(F.max(c).alias(c) for c in [*own, *names]))
    return each.groupBy("k", "th").agg(F.sort_array(F.collect_list(F.struct("i", *own, *names))).alias("a"))


def runs(sequence: DataFrame, levels: int) -> DataFrame:
    """The shortest runs that can be repeated, (k, th, first line, last line, name of the run: its length and two ranks)."""
    forward = F.transform(F.filter("a", lambda x: x.stop.isNotNull()), lambda x: F.struct(x.i.alias("s"), x.stop.alias("t")))
    backward = F.transform(F.filter("a", lambda x: x.begin.isNotNull()), lambda x: F.struct(x.begin.alias("s"), x.i.alias("t")))
    # a run that ends at a line is one that begins at another, unless that one's stops elsewhere: looked up, so that lines cost no pairs
    backward = F.filter(backward, lambda x: ~F.col("a")[x.s - 1].stop.eqNullSafe(x.t))
    spans = sequence.select("k", "th", "a", F.concat(forward, backward).alias("spans"))

    def named(x: Column) -> Column:
        long = x.t - x.s + 1
        first, last = F.col("a")[x.s - 1], F.col("a")[x.t - 1]
        left = right = F.lit(None).cast("long")
        for k in range(levels):
            left = F.when(long >= 2**k, first[f"n{k}"]).otherwise(left)
            right = F.when(long >= 2**k, F.col("a")[x.t - 2**k][f"n{k}"]).otherwise(right)
        return F.struct(
            first.pos.alias("s"), last.pos.alias("t"), long.alias("long"), left.alias("left"), right.alias("right"),
            (last.sized - first.sized + first["size"]).alias("size"),
        )

    return spans.select("k", "th", F.inline(F.filter(F.transform("spans", named), lambda x: x.left.isNotNull() & x.right.isNotNull())))


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(k, th, gone): the stretches of lines to delete, apart from each other, of documents that have any."""
    lines = written(suffixes(docs, min_words), "suffixes")
    levels = doubled(lines, min_words)
    found = written(runs(sequences(lines, levels), len(levels)), "runs")
    let_go(lines, *levels)
    name = ["long", "left", "right", "size"]
    firsts = (
        found.groupBy(*name)
        .agg(F.min(F.struct("k", "th", "s")).alias("first"), F.count("*").alias("copies"))
        .filter("copies > 1")
    )
    firsts = written(firsts, "firsts")  # so that the join is between two tables, whose large partitions can be split
    later = found.join(firsts, name).filter(~F.struct("k", "th", "s").eqNullSafe(F.col("first")))
    doc = Window.partitionBy("k", "th").orderBy("s", "t")
    reach = F.max("t").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.select("k", "th", "s", "t", (F.coalesce(reach, F.lit(-2)) + 1 < F.col("s")).cast("int").alias("new"))
    islands = islands.withColumn("island", F.sum("new").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("k", "th", "island").agg(F.min("s").alias("s"), F.max("t").alias("t"))
    return merged.groupBy("k", "th").agg(F.sort_array(F.collect_list(F.struct("s", "t"))).alias("gone"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the text that is left, and ``n_lines`` and ``n_removed`` lines."""
    others = [c for c in docs.columns if c not in (text, "n_lines", "n_removed")]
    column = {c: F.col(f"`{c}`") for c in docs.columns}
    names = docs.select(column[key].alias("k"), column[text].alias("text")).withColumn("th", F.xxhash64("text"))
    gone = later_copies(names, min_words).select(F.col("k").alias("__k"), F.col("th").alias("__th"), F.col("gone").alias("__gone"))
    held = docs.select(F.struct(*(column[c] for c in others)).alias("row"), column[key].alias("k"), column[text].alias("text"))
    held = held.withColumn("th", F.xxhash64("text"))
    joined = held.join(gone, held.k.eqNullSafe(gone["__k"]) & (held.th == gone["__th"]), "left")
    lines = F.split("text", "\n")
    # what lies before, between and behind the stretches, which are apart and in order
    begins, ends = F.concat(F.array(F.lit(0)), F.transform("__gone", lambda g: g.t + 1)), F.concat(F.transform("__gone", lambda g: g.s), F.array(F.size("lines")))
    between = F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda x: F.slice("lines", x.a + 1, F.greatest(x.b - x.a, F.lit(0))))
    left = joined.withColumn("lines", lines).select(
        "row",
        F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(between), "\n")).alias("text"),
        F.coalesce(F.size(F.when(F.col("text").isNotNull(), F.col("lines"))), F.lit(0)).alias("lines"),
        F.coalesce(F.aggregate("__gone", F.lit(0), lambda n, g: n + (g.t - g.s + 1).cast("int")), F.lit(0)).alias("removed"),
    )
    out = [F.col("row")[c].alias(c) if c in others else F.col("text").alias(text) for c in docs.columns if c in others or c == text]
    return left.select(
        *out,
        F.greatest(F.col("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.greatest(F.col("removed"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP9_SQL = """
WITH docs AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
raw AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM docs),
counted AS (
  SELECT doc_id, pos, line, CASE WHEN trim(line, ' ') = '' THEN 0
    ELSE length(trim(line, ' ')) - length(replace(trim(line, ' '), ' ', '')) + 1 END AS w FROM raw),
numbered AS (
  SELECT doc_id, pos, line, w, row_number() OVER d AS i, sum(w) OVER d AS upto,
    sum(w) OVER (PARTITION BY doc_id) AS total FROM counted WHERE w > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
placed AS (SELECT *, upto - w AS bef, total - upto AS aft FROM numbered),
reach AS (
  SELECT *, max(i) OVER (PARTITION BY doc_id ORDER BY bef RANGE BETWEEN UNBOUNDED PRECEDING AND 49 FOLLOWING) AS stop,
    min(i) OVER (PARTITION BY doc_id ORDER BY aft RANGE BETWEEN UNBOUNDED PRECEDING AND 49 FOLLOWING) AS start FROM placed),
seqs AS (SELECT doc_id, list(line ORDER BY i) AS a, list(pos ORDER BY i) AS p FROM numbered GROUP BY doc_id),
spans AS (
  SELECT doc_id, i AS s, stop AS t FROM reach WHERE aft + w >= 50
  UNION SELECT doc_id, start, i FROM reach WHERE upto >= 50),
named AS (
  SELECT doc_id, p[s] AS s, p[t] AS t, array_to_string(a[s:t], chr(10)) AS run FROM spans JOIN seqs USING (doc_id)),
marked AS (SELECT doc_id, s, t, min((doc_id, s)) OVER (PARTITION BY run) AS first FROM named),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, t + 1)) AS pos FROM marked WHERE (doc_id, s) <> first),
judged AS (SELECT r.doc_id, r.pos, r.line, g.pos IS NOT NULL AS cut FROM raw r LEFT JOIN gone g ON r.doc_id = g.doc_id AND r.pos = g.pos),
rebuilt AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT cut), '') AS text,
    count(*) AS n_lines, count(*) FILTER (WHERE cut) AS n_removed FROM judged GROUP BY doc_id)
SELECT d.doc_id, r.text, coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN rebuilt r ON d.doc_id = r.doc_id
"""
