"""Conversation prefix trie: which beginnings conversations share, and what is saved by storing them once.

A conversation is its turns in order, of which only the SHA-256 of role and text and the text's length travel. Each turn's prefix digest
is the SHA-256 of the digest before it and the turn's own, made as sorted turns stream by, so that a task holds one digest, however long a
conversation. Every prefix is a row, and grouping these by (depth, digest) gives the nodes.

The nodes with one smallest member are the end of that conversation's path, a chain. Sums over subtrees are taken within
chains by a window from their end, and each chain's sums go to all ancestors of its first node, which are prefixes
of the same conversation. So every node reaches all its ancestors with no more rows than there are turns, whatever the
depth. A node with very many members, children or ends is no group of any task: members, sums and children are added up before they are
shuffled, and the ids that end at a node are sorted over all tasks and joined in pieces, which its hash takes in order.

Defined results: rows without conv_id are of no conversation; turns are ordered by turn (null first), role, digest of role and
text, so repeated rows are turns each; null role or text is empty; a conversation left without turns ends at the root; an empty
table has no node, not even the root; other columns are not read. Very long texts are only hashed and measured.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import map_batches, table, written

#: Ids of conversations whose first turns are lent, and how many turns at most, less one.
LENT_BY, LENT = 100, 6
#: Ids that are joined before they are shuffled.
PIECE = 2000
ROOT = hashlib.sha256(b"").digest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, said, size): turns numbered from 0, with the digest of role and text, and the text's code points."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    said = F.unhex(F.sha2(F.concat(F.octet_length(text("role")).cast("string"), F.lit(":"), text("role"), text("text")), 256))
    rows = conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", text("role").alias("role"), said.alias("said"), F.length(text("text")).cast("long").alias("size"))
    place = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "said")
    return rows.select("conv_id", (F.row_number().over(place) - 1).alias("i"), "said", "size")


def rebuilt(turns: DataFrame, lender: Column, lent: Column, most: int) -> DataFrame:
    """(conv_id, depth, said, size): the first ``lent`` turns (``most`` at most) of conversation ``lender``, then one's own behind as many;
    depth 0 is a row of every conversation, its ``last`` the depth of its end."""
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", lender.alias("lender"), lent.alias("h"))
    first = turns.filter(F.col("i") < most).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("i", "said", "size"))).alias("first"))
    whole = own.join(first.withColumnRenamed("conv_id", "lender"), "lender", "left")
    whole = whole.withColumn("first", F.filter(F.coalesce("first", F.array().cast(first.schema["first"].dataType)), lambda t: t.i < F.col("h")))
    whole = whole.withColumn("last", F.size("first") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    root = F.array(F.struct(F.lit(-1).alias("i"), F.lit(None).cast("binary").alias("said"), F.lit(0).cast("long").alias("size")))
    begun = whole.select("conv_id", "last", F.explode(F.concat(root, "first")).alias("t"))
    begun = begun.select("conv_id", (F.col("t.i") + 1).alias("depth"), "t.said", "t.size", "last")
    rest = turns.join(whole.select("conv_id", "h", F.size("first").alias("had"), "last"), "conv_id").filter("i >= h")
    return begun.union(rest.select("conv_id", (F.col("i") - F.col("h") + F.col("had") + 1).alias("depth"), "said", "size", "last"))


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, up, size, last): every prefix, with its digest and that of the one before."""
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "depth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now = ROOT
        for batch in batches:
            own, before = [], []
            for said in batch.column("said").to_pylist():
                before.append(None if said is None else now)
                now = ROOT if said is None else hashlib.sha256(now + said).digest()
                own.append(now)
            yield {"digest": own, "up": before} | {c: batch.column(c) for c in ("conv_id", "depth", "size", "last")}

    schema = "conv_id long, depth long, digest binary, up binary, size long, last long"
    return map_batches(ordered.select("conv_id", F.col("depth").cast("long"), "said", "size", F.col("last").cast("long")), T._parse_datatype_string(schema), run)


def ends(rows: DataFrame) -> DataFrame:
    """(digest, ends_sha256): of the ids of conversations that end at a node, in order and joined by commas.

    Ids sorted over all tasks are joined in pieces there; what is left for a node's one hash, which can't be split, are its pieces."""
    ordered = rows.filter("depth = last").select("digest", "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            pieces: list[tuple[bytes, int, list[str]]] = []
            for digest, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not pieces or pieces[-1][0] != digest or len(pieces[-1][2]) == PIECE:
                    pieces.append((digest, key, []))
                pieces[-1][2].append(str(key))
            yield {"digest": [p[0] for p in pieces], "first": [p[1] for p in pieces], "ids": [",".join(p[2]) for p in pieces]}

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, digest = None, None
        for batch in batches:
            out: list[tuple[bytes, str]] = []
            for own, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own == digest:
                    now.update(b",")
                else:
                    if now:
                        out.append((digest, now.hexdigest()))
                    now, digest = hashlib.sha256(), own
                now.update(ids.encode())
            yield {"digest": [x for x, _ in out], "ends_sha256": [x for _, x in out]}
        if now:
            yield {"digest": [digest], "ends_sha256": [now.hexdigest()]}

    pieces = map_batches(ordered, T._parse_datatype_string("digest binary, first long, ids string"), joined)
    pieces = pieces.repartition("digest").sortWithinPartitions("digest", "first")
    return map_batches(pieces, T._parse_datatype_string("digest binary, ends_sha256 string"), hashed)


def trie(turns: DataFrame, lender: Column | None = None, lent: Column | None = None, most: int = 0) -> DataFrame:
    """The nodes of the trie of conversations ``turns`` (of turns_of()), rebuilt with lent first turns where ``lent`` says so."""
    lender, lent = F.col("conv_id") if lender is None else lender, F.lit(0) if lent is None else lent
    every = written(prefixes(rebuilt(turns, lender, lent, most)), "prefixes")
    nodes = every.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("up").alias("up"), F.first("size").alias("size"))
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    chain = Window.partitionBy("conv_id")
    nodes = nodes.withColumns({"saved": F.sum((F.col("n_convs") - 1) * F.col("size")).over(below), "top": F.min("depth").over(chain), "bottom": F.max("depth").over(chain)})
    nodes = written(nodes, "nodes")
    heads = nodes.filter("depth = top").select("conv_id", "up", "top", "bottom", "saved")
    # a chain's last node is a leaf unless another chain hangs there
    hung = heads.filter("up IS NOT NULL").groupBy(F.col("up").alias("digest")).agg(F.count("*").alias("n_heads"))
    tails = nodes.filter("depth = bottom").join(hung, "digest", "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    chains = written(heads.join(tails, "conv_id", "left").withColumn("leaf", F.coalesce("leaf", F.lit(0))), "chains")
    ancestors = every.select("conv_id", "depth", "digest").join(chains.select("conv_id", "top", F.col("saved").alias("s"), "leaf"), "conv_id").filter("depth < top")
    given = ancestors.groupBy("depth", "digest").agg(F.sum("s").alias("given"), F.sum("leaf").alias("leaves"))
    # parents of chains' first nodes; all others have their own chain's
    parents = nodes.select(F.col("digest").alias("up"), F.col("conv_id").alias("parent"))
    parents = chains.select("conv_id", "up").join(parents, "up").select("conv_id", "parent")
    own = chains.select("conv_id", "leaf").join(parents, "conv_id", "left")
    out = nodes.join(own, "conv_id").join(hung, "digest", "left").join(given, ["depth", "digest"], "left").join(ends(every), "digest", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "conv_id", "depth",
        F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        ((F.col("depth") < F.col("bottom")).cast("long") + zero("n_heads")).alias("n_children"),
        (F.col("leaf") + zero("leaves")).cast("long").alias("n_leaves"),
        (F.col("saved") + zero("given")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(ROOT.hex())).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = written(turns_of(table(spark, sf_dir, "conversations")), "turns")
    lender = F.col("conv_id") - F.col("conv_id") % LENT_BY
    return trie(turns, lender, (F.crc32(F.col("conv_id").cast("string")) % LENT).cast("int"), LENT - 1)


OP12_SQL = """
WITH RECURSIVE turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, said) - 1 AS i, said, size FROM (
    SELECT conv_id, turn, coalesce(role, '') AS role, length(coalesce(text, '')) AS size,
      sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS said FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
  SELECT conv_id, n, conv_id - conv_id % 100 AS lender, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 6 AS h
  FROM (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id)),
rebuilt AS (
  SELECT c.conv_id, t.i + 1 AS depth, t.said, t.size FROM convs c JOIN turns t ON t.conv_id = c.lender WHERE t.i < c.h
  UNION ALL
  SELECT c.conv_id, t.i - c.h + least(c.h, coalesce(l.n, 0)) + 1, t.said, t.size FROM convs c JOIN turns t ON t.conv_id = c.conv_id LEFT JOIN convs l ON l.conv_id = c.lender WHERE t.i >= c.h),
prefixes AS (
  SELECT conv_id, 0::BIGINT AS depth, ''::VARCHAR AS digest, NULL::VARCHAR AS up, 0::BIGINT AS size FROM convs
  UNION ALL
  SELECT p.conv_id, r.depth, sha256(p.digest || r.said), p.digest, r.size FROM prefixes p JOIN rebuilt r ON r.conv_id = p.conv_id AND r.depth = p.depth + 1),
lasts AS (SELECT conv_id, max(depth) AS last FROM prefixes GROUP BY conv_id),
nodes AS (
  SELECT depth, digest, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = last), '')) AS ends_sha256
  FROM prefixes JOIN lasts USING (conv_id) GROUP BY depth, digest),
children AS (SELECT n.*, count(c.digest) AS n_children, any_value(p.conv_id) AS parent_conv_id FROM nodes n
  LEFT JOIN nodes c ON c.up = n.digest AND c.depth = n.depth + 1 LEFT JOIN nodes p ON p.digest = n.up AND p.depth = n.depth - 1 GROUP BY ALL),
sums AS (
  SELECT a.depth, a.digest, count(*) FILTER (WHERE c.n_children = 0) AS n_leaves, sum((c.n_convs - 1) * c.size) AS saved_tokens
  FROM children c JOIN prefixes a ON a.conv_id = c.conv_id AND a.depth <= c.depth GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256 FROM children JOIN sums USING (depth, digest)
"""
