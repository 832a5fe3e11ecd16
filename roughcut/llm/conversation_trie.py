"""Conversation prefix trie: every shared opening of conversations as a node, by ROLLUP over
positional turn-id columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roughcut.llm.common import numbered, stored, text_or_empty

#: Turns of one row of positional columns; longer conversations go on in further rows.
BLOCK_TURNS = 8
#: Blocks that are summed together first, so that no window holds a whole long conversation.
GROUP_BLOCKS = 1024
#: Conversation ids are joined in ranges of this size before they are hashed.
ID_RANGE = 1024


def ordered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                  role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, pos, role, text, bytes, turn_id``: the turns of each conversation, numbered
    from 0 in the order of ``turn`` (null first). Turns of equal number come in the order of the
    digest of role and text, so the numbering is the same whatever the partitioning. Null roles
    and texts are empty strings. Rows without a conversation id belong to no conversation and
    are left out. Only ids, numbers and digests are sorted, and a conversation of very many
    turns is spread over many tasks."""
    role, text = text_or_empty(role_col), text_or_empty(text_col)
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        digest.alias("turn_id"), F.octet_length(text).cast("long").alias("bytes"))
    return numbered(rows, ["conv_id"], ["turn", "turn_id"], "pos", "turns").drop("turn")


def rebuilt(turns: DataFrame, head: Column, base: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Each conversation of ``turns`` with its first ``head`` turns replaced by the first
    ``head`` turns of conversation ``base`` (both of ``conv_id``; all its turns if it has fewer,
    none if it has none or does not exist); ``head`` is at most ``most``. Returns one row per
    conversation (``conv_id``), turnless ones included, and the rebuilt turns."""
    known = stored(turns.groupBy("conv_id").agg(F.count("*").alias("n"))
                   .withColumn("head", head.cast("long")).withColumn("base", base.cast("long")), "convs")
    size = known.select(F.col("conv_id").alias("base"), F.least("n", F.lit(most).cast("long")).alias("base_n"))
    convs = stored(known.join(size, "base", "left")
                   .withColumn("lent", F.least("head", F.coalesce("base_n", F.lit(0).cast("long")))), "lent")
    first = turns.where(F.col("pos") < most).withColumnRenamed("conv_id", "base")
    lent = (convs.where("lent > 0").select("conv_id", "base", "lent").join(first, "base")
            .where("pos < lent").select("conv_id", "pos", "turn_id", "bytes"))
    own = (turns.join(convs.select("conv_id", "head", "lent"), "conv_id").where("pos >= head")
           .select("conv_id", (F.col("pos") - F.col("head") + F.col("lent")).alias("pos"), "turn_id", "bytes"))
    return convs.select("conv_id"), lent.unionByName(own)


def _running(df: DataFrame, parts: dict[str, tuple], width: int, name: str) -> DataFrame:
    """Running aggregates before each block of a conversation, in two levels: inside groups of
    ``width`` blocks, and over the groups."""
    df = df.withColumn("__g", F.floor(F.col("block") / width))
    whole = df.groupBy("conv_id", "__g").agg(*[fn(F.col(c)).alias(f"__g_{o}") for o, (c, fn, _) in parts.items()])
    groups = W.partitionBy("conv_id").orderBy("__g").rowsBetween(W.unboundedPreceding, -1)
    whole = whole.select("conv_id", "__g", *[F.coalesce(fn(f"__g_{o}").over(groups), F.lit(0).cast("long")).alias(f"__g_{o}")
                                             for o, (_, fn, _) in parts.items()])
    inside = W.partitionBy("conv_id", "__g").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    df = df.select("*", *[F.coalesce(fn(c).over(inside), F.lit(0).cast("long")).alias(f"__i_{o}")
                          for o, (c, fn, _) in parts.items()])
    joined = df.join(whole, ["conv_id", "__g"])
    cols = [both(F.col(f"__g_{o}"), F.col(f"__i_{o}")).alias(o) for o, (_, _, both) in parts.items()]
    plain = [c for c in df.columns if not c.startswith("__")]
    return stored(joined.select(*plain, *cols), name)


def _mark(turn: Column, pos: Column, seed: int) -> Column:
    """A 64-bit value of a turn at a place; a prefix is known by the exclusive or of two such
    values over its turns (128 bits) and its depth."""
    return F.xxhash64(turn, pos, F.lit(seed))


def _sha_of_streams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the comma-joined ``ids`` of each node; rows come by node, in order."""
    node, digest = None, None
    for batch in batches:
        out = []
        for *key, ids in zip(batch["depth"], batch["k1"], batch["k2"], batch["ids"]):
            if key != node:
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=["depth", "k1", "k2", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(*node, digest.hexdigest())], columns=["depth", "k1", "k2", "ends_sha256"])


def prefix_trie(convs: DataFrame, turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The trie of ``turns`` (``conv_id, pos, turn_id, bytes``, positions from 0 without gaps;
    see :func:`ordered_turns`) of the conversations ``convs`` (``conv_id``).

    Every distinct sequence of first d turns is a node of depth d; its members are the
    conversations that start with it. One row per node: ``conv_id`` (smallest member),
    ``depth, parent_conv_id`` (null for the root), ``n_convs, n_children, n_leaves``
    (childless nodes in its subtree, itself included), ``saved_tokens`` (over its subtree:
    members but one, times the bytes of the node's last text) and ``ends_sha256`` (of the
    ascending, comma-joined ids of the members that end there). Conversations without turns
    are members of the root. Without conversations there is no node.

    A conversation is a row of ``block_turns`` positional turn ids per block, keyed by the
    node that its turns before that block lead to. ROLLUP over those columns, with the
    block's key, counts all prefixes of all blocks in one aggregation (map-side combined,
    so an opening of very many conversations is no hot group); ``grouping_id`` tells the
    depth. Node keys are 128-bit hashes of the whole prefix, so no block waits for the one
    before and the number of jobs does not depend on the length of a conversation.

    Subtrees need no walk either. A conversation is the smallest member of one stretch of
    nodes on its path, from some depth down to its end. So a node's leaves are those owned by
    its members, and the bytes of its subtree's distinct texts are what its members own below
    it and what its smallest member owns from it on; both are sums over members, which a second
    ROLLUP takes. Of all members' bytes that leaves the bytes saved.
    """
    width = block_turns
    at = F.col("pos") % width
    marks = turns.select("conv_id", F.floor(F.col("pos") / width).alias("block"), at.cast("int").alias("at"),
                         F.struct("turn_id", "bytes").alias("t"), "bytes",
                         *[_mark(F.col("turn_id"), F.col("pos"), s).alias(f"m{s}") for s in (1, 2)])
    slots = [F.max(F.when(F.col("at") == j, F.col("t"))).alias(f"t{j}") for j in range(width)]
    wide = stored(marks.groupBy("conv_id", "block").agg(
        *slots, F.bit_xor("m1").alias("x1"), F.bit_xor("m2").alias("x2"), F.sum("bytes").alias("b"),
        F.count("*").alias("used")), "wide")

    def xor(a: Column, b: Column) -> Column:
        return a.bitwiseXOR(b)
    wide = _running(wide, {"k1": ("x1", F.bit_xor, xor), "k2": ("x2", F.bit_xor, xor),
                           "before": ("b", F.sum, lambda a, b: a + b)}, GROUP_BLOCKS, "keyed")
    whole = stored(convs.join(wide.groupBy("conv_id").agg(
        F.sum("used").alias("depth"), F.sum("b").alias("total"), F.bit_xor("x1").alias("k1"),
        F.bit_xor("x2").alias("k2")), "conv_id", "left").na.fill(0), "whole")

    # conversations without turns are rows without turn ids in the first block
    names = [f"t{j}" for j in range(width)]
    zero = F.lit(0).cast("long")
    blocks = wide.select("conv_id", "block", "k1", "k2", "before", *names).unionByName(
        whole.where("depth = 0").select("conv_id", zero.alias("block"), zero.alias("k1"), zero.alias("k2"),
                                        zero.alias("before")), allowMissingColumns=True)

    def rolled(columns: DataFrame, aggs: list[Column]) -> DataFrame:
        """One row per prefix of each block that is a node: a prefix in which every column is a turn."""
        keys = ["block", "k1", "k2", "before"]
        out = columns.rollup(*[F.struct(*keys).alias("key")], *names).agg(
            F.grouping_id().alias("gid"), *aggs)
        # k trailing columns rolled up: grouping_id is 2**k - 1
        level = F.lit(width) - F.length(F.regexp_replace(F.bin("gid"), "0", ""))
        last = F.array(*[F.col(n) for n in names])
        out = out.where(f"gid < {1 << width}").withColumn("level", level) \
            .withColumn("last", F.get(last, F.col("level") - 1))
        return out.where((F.col("level") > 0) & F.col("last").isNotNull()
                         | (F.col("level") == 0) & (F.col("key.block") == 0))

    def prefix_key(seed: int, used: Column) -> Column:
        """The key of the first ``used`` turns of a block."""
        return reduce(lambda k, j: k.bitwiseXOR(F.when(used > j, _mark(
            F.col(f"t{j}.turn_id"), F.col("key.block") * width + j, seed)).otherwise(zero)),
            range(width), F.col(f"key.k{seed}"))
    nodes = rolled(blocks.join(whole.select("conv_id", "total"), "conv_id"),
                   [F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"),
                    F.sum("total").alias("member_bytes")])
    earlier = reduce(lambda s, j: s + F.when(F.col("level") - 1 > j, F.col(f"t{j}.bytes")).otherwise(zero),
                     range(width), F.col("key.before"))
    nodes = stored(nodes.select(
        (F.col("key.block") * width + F.col("level")).alias("depth"),
        *[prefix_key(s, F.col("level")).alias(f"k{s}") for s in (1, 2)],
        *[prefix_key(s, F.col("level") - 1).alias(f"p{s}") for s in (1, 2)],
        "conv_id", "n_convs", "member_bytes", F.coalesce(F.col("last.bytes"), zero).alias("bytes"),
        # bytes of the texts above the node
        earlier.alias("above")), "nodes")

    # children and parents
    node = ["depth", "k1", "k2"]
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"),
                                                F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, node, "left").na.fill(0, ["n_children"]), "inner")

    # what each conversation owns: the nodes whose smallest member it is
    owned = nodes.groupBy("conv_id").agg(F.sum("bytes").alias("owned"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    owned = stored(whole.select("conv_id", "total").join(owned, "conv_id", "left").na.fill(0), "owned")
    sums = rolled(blocks.join(owned, "conv_id"), [F.sum("owned").alias("owned"), F.sum("leaves").alias("n_leaves")])
    sums = sums.select((F.col("key.block") * width + F.col("level")).alias("depth"),
                       *[prefix_key(s, F.col("level")).alias(f"k{s}") for s in (1, 2)], "owned", "n_leaves")
    smallest = owned.select("conv_id", F.col("owned").alias("own"), "total")
    nodes = nodes.join(stored(sums, "sums"), node).join(smallest, "conv_id")
    # distinct bytes of the subtree, and all bytes of the members from the node on
    distinct = F.col("owned") - F.col("own") + F.col("total") - F.col("above")
    passed = F.col("member_bytes") - F.col("n_convs") * F.col("above")
    nodes = stored(nodes.withColumn("saved_tokens", passed - distinct), "saved")

    # ids of the conversations that end at a node, joined in ranges, then hashed in order
    ranges = whole.groupBy(*node, F.floor(F.col("conv_id") / ID_RANGE).alias("range")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    ends = (ranges.repartition(*node).sortWithinPartitions(*node, "range")
            .select(*node, "ids").mapInPandas(_sha_of_streams, "depth long, k1 long, k2 long, ends_sha256 string"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                           F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(stored(ends, "ends"), node, "left")
            .join(parents, ["depth", "p1", "p2"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))


#: DuckDB SQL for the query. DuckDB has no CRC-32, so it is computed byte by byte from its
#: defining polynomial.
CONVERSATION_TRIE_SQL = """
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(
         list_concat([i], range(8)),
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
turns AS (SELECT conv_id, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS k,
                 strlen(coalesce(text, '')) AS b, turn FROM conversations WHERE conv_id IS NOT NULL),
orig AS (SELECT conv_id, list({'k': k, 'b': b} ORDER BY turn NULLS FIRST, md5(k)) AS seq FROM turns GROUP BY conv_id),
h AS (SELECT conv_id, seq, conv_id - conv_id % 5 AS base, hex(CAST(conv_id AS VARCHAR)) AS hx,
             strlen(CAST(conv_id AS VARCHAR)) AS n FROM orig),
c AS (SELECT conv_id, seq, base, xor(4294967295, list_reduce(
         list_concat([4294967295], list_transform(range(n),
           lambda i: CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT))),
         lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) % 9 AS h FROM h, tab),
s AS (SELECT c.conv_id, list_concat(coalesce(list_slice(o.seq, 1, c.h), []), list_slice(c.seq, c.h + 1, len(c.seq))) AS seq
      FROM c LEFT JOIN orig o ON o.conv_id = c.base),
p AS (SELECT conv_id, d, len(seq) AS n, list_slice(seq, 1, d) AS prefix, seq[d].b AS b
      FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM s)),
w AS (SELECT conv_id, d, n, coalesce(b, 0) AS b, min(conv_id) OVER (PARTITION BY prefix) AS rep,
             count(*) OVER (PARTITION BY prefix) AS n_convs FROM p),
parent AS (SELECT w.*, u.rep AS up FROM w LEFT JOIN w u ON u.conv_id = w.conv_id AND u.d = w.d - 1),
node AS (SELECT conv_id, d, up, n_convs, b FROM parent WHERE conv_id = rep),
kids AS (SELECT up AS conv_id, d - 1 AS d, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
n AS (SELECT node.*, coalesce(kids.n_children, 0) AS n_children FROM node LEFT JOIN kids USING (conv_id, d)),
sub AS (SELECT w.rep AS conv_id, w.d, sum(CAST(n.n_children = 0 AS BIGINT)) AS n_leaves, sum((n.n_convs - 1) * n.b) AS saved
        FROM n JOIN w ON w.conv_id = n.conv_id AND w.d <= n.d GROUP BY ALL),
ends AS (SELECT rep AS conv_id, d, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
         FROM w WHERE d = n GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, n.up AS parent_conv_id, n.n_convs, n.n_children, CAST(sub.n_leaves AS BIGINT) AS n_leaves,
       CAST(sub.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM n JOIN sub USING (conv_id, d) LEFT JOIN ends USING (conv_id, d)
"""
