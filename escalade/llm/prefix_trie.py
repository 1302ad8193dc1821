"""Prefix trie of conversations, with subtree totals by parallel tree contraction in join rounds.

A node is a distinct sequence of first turns; all conversations that begin with it are its members.

1. Turns get their position by a range layout of all turns (a conversation of any length spreads over tasks). A node's key is its
   depth and the XOR of two 64-bit hashes of (position, turn) over its turns, a running value: inside blocks of ``_BLOCK``
   positions by a window, across blocks by the blocks' own values. One aggregate by key makes the nodes, one join their parents.
2. Contraction. Each node holds a value (its own weight and what was contracted into it) and the weight of the edge to its
   parent. A round first compresses all unary chains: pointers down the chain are doubled join by join, so a chain of n nodes takes
   log2 n joins; then its nodes are removed, and its lower end hangs on the chain's parent by an edge that weighs what the chain held.
   Then all leaves are raked: summed by parent (an aggregate, whatever a parent's number of leaves) and added to its value. What remains of a tree
   without unary nodes has under half of its nodes, so rounds grow with the logarithm of the trie's size, not with its depth.
3. Re-expansion, last round first: a raked leaf's total is its value; a chain node's total is what the chain held from it down plus the total of
   the chain's lower end, known by then.

Every step is checkpointed; the driver sees only counts. The digest of a node's own conversations takes their ids in
ascending order: ids meet in ranges of ``_IDS`` first, so a node with very many sends few rows, which are hashed as they come.

Defined cases: turns without a conversation id are no turns; a null role or text is empty; a null turn number comes first, turns
with one number are ordered by role, then text (repeated rows are two turns); without conversations there are no nodes, not even the
root; other columns are ignored. Ids and turn numbers may be any bigint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from escalade.llm.common import packed, ready

_BLOCK = 4096  # positions of one window
_IDS = 4096  # width of a range of ids whose text is one row


def turn_keys(role: Column, text: Column) -> list[Column]:
    """k1, k2 and chars: 128 bits that stand for a turn's role and text, and the code points of the text."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return [F.xxhash64(role, text).alias("k1"), F.xxhash64(F.lit(1), text, role).alias("k2"), F.char_length(text).cast("bigint").alias("chars")]


def numbered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """(conv, pos, k1, k2, chars) of every turn, pos from 1 in each conversation."""
    ready(conversations.sparkSession)
    rows = conversations.select(F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).alias("turn"),
                                F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    # sorted with the texts; what goes on are their keys. The input's own order splits repeats of one turn.
    rows = rows.filter("conv is not null").withColumn("row", F.monotonically_increasing_id())
    order = ["conv", "turn", "role", "text", "row"]
    keys = rows.select(*order, *turn_keys(F.col("role"), F.col("text")))
    laid = keys.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(
        *[F.col(c).asc_nulls_first() for c in order])
    laid = laid.select("conv", F.monotonically_increasing_id().alias("place"), F.spark_partition_id().alias("part"), "k1", "k2", "chars").checkpoint()
    # a conversation that began in earlier parts goes on from there: at most two rows a part tell
    counts = laid.groupBy("part", "conv").agg(F.count(F.lit(1)).alias("n"))
    edges = laid.groupBy("part").agg(F.min("conv").alias("lo"), F.max("conv").alias("hi"))
    spread = counts.join(F.broadcast(edges), "part").filter("conv = lo or conv = hi")
    ahead = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ahead = spread.select("part", "conv", ahead.alias("ahead")).filter("ahead is not null")
    inside = F.row_number().over(Window.partitionBy("part", "conv").orderBy("place"))
    return (laid.withColumn("pos", inside).join(F.broadcast(ahead), ["part", "conv"], "left")
            .select("conv", (F.col("pos") + F.coalesce("ahead", F.lit(0))).alias("pos"), "k1", "k2", "chars"))


def _running_keys(turns: DataFrame) -> DataFrame:
    """(conv, d, p1, p2, h1, h2, chars): the key of each conversation's first d turns, and what turn d put into it."""
    rows = turns.select("conv", F.col("pos").cast("bigint").alias("d"), F.xxhash64("pos", "k1", "k2").alias("h1"),
                        F.xxhash64("k2", "pos", "k1").alias("h2"), "chars").withColumn("block", F.floor((F.col("d") - 1) / _BLOCK))
    inside = Window.partitionBy("conv", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"p1": F.bit_xor("h1").over(inside), "p2": F.bit_xor("h2").over(inside)})
    later = rows.filter("block > 0").select("conv").distinct()  # conversations of several blocks
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (rows.join(later, "conv", "left_semi").groupBy("conv", "block").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
              .select("conv", "block", F.bit_xor("x1").over(before).alias("x1"), F.bit_xor("x2").over(before).alias("x2")).filter("block > 0"))
    rows = rows.join(blocks, ["conv", "block"], "left")
    whole = lambda p, x: F.col(p).bitwiseXOR(F.coalesce(x, F.lit(0).cast("bigint"))).alias(p)
    return rows.select("conv", "d", whole("p1", "x1"), whole("p2", "x2"), "h1", "h2", "chars")


def _sha256_of_ends(ends: DataFrame) -> DataFrame:
    """(d, p1, p2, ends_sha256) of (conv, d, p1, p2): ids ascending, joined by commas."""
    pieces = (ends.groupBy("d", "p1", "p2", F.floor(F.col("conv") / _IDS).alias("piece"))
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sha = None, None
        for pdf in batches:
            out = []
            for d, p1, p2, ids in zip(pdf["d"].tolist(), pdf["p1"].tolist(), pdf["p2"].tolist(), pdf["ids"]):
                if (d, p1, p2) != at:
                    if at is not None:
                        out.append((*at, sha.hexdigest()))
                    at, sha = (d, p1, p2), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["d", "p1", "p2", "ends_sha256"])
        if at is not None:
            yield pd.DataFrame([(*at, sha.hexdigest())], columns=["d", "p1", "p2", "ends_sha256"])

    dealt = pieces.repartition("d", "p1", "p2").sortWithinPartitions("d", "p1", "p2", "piece").select("d", "p1", "p2", "ids")
    return dealt.mapInPandas(run, "d bigint, p1 bigint, p2 bigint, ends_sha256 string")


def _compress(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (id, par, a, b, ea, eb, c, child, ca, cb): (id, end, a, b) of the nodes of unary chains, a and b from the node down to the
    chain's lower end (without it); and (id, par, ea, eb) of the ends, hung on the chain's parent."""
    chain = state.filter("c = 1").select("id", F.col("child").alias("end"), (F.col("a") + F.col("ca")).alias("a"),
                                         (F.col("b") + F.col("cb")).alias("b"), "par", "ea", "eb", F.lit(1).cast("bigint").alias("steps"))
    chain = packed(chain)
    done, open_ = chain.filter("false"), chain
    while True:
        known = done.unionByName(open_).select(F.col("id").alias("end"), F.col("end").alias("further"), F.col("a").alias("a2"),
                                               F.col("b").alias("b2"), F.col("steps").alias("s2"))
        met = open_.join(known, "end", "left")
        met = packed(met.select("id", F.coalesce("further", "end").alias("end"), (F.col("a") + F.coalesce("a2", F.lit(0))).alias("a"),
                                (F.col("b") + F.coalesce("b2", F.lit(0))).alias("b"), "par", "ea", "eb",
                                (F.col("steps") + F.coalesce("s2", F.lit(0))).alias("steps"), F.col("further").isNotNull().alias("moved")))
        done = done.unionByName(met.filter("not moved").drop("moved"))
        open_ = met.filter("moved").drop("moved")
        if open_.isEmpty():
            break
    top = F.max(F.struct("steps", "par", (F.col("a") + F.col("ea")).alias("ea"), (F.col("b") + F.col("eb")).alias("eb")))
    ends = done.groupBy("end").agg(top.alias("t")).select(F.col("end").alias("id"), "t.par", "t.ea", "t.eb")
    return done.select("id", "end", "a", "b"), ends


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """(id, a, b): over each node's subtree, itself included, the sums of a and b of (id, par, a, b); a root's par is null."""
    live = nodes.select("id", "par", "a", "b", F.lit(0).cast("bigint").alias("ea"), F.lit(0).cast("bigint").alias("eb"))
    raked, chains = [], []
    live = packed(live)
    while not live.isEmpty():
        kids = live.filter("par is not null").groupBy(F.col("par").alias("id")).agg(
            F.count(F.lit(1)).alias("c"), F.max("id").alias("child"), F.sum("ea").alias("ca"), F.sum("eb").alias("cb"))
        state = packed(live.join(kids, "id", "left").fillna(0, ["c"]))
        rest = state.filter("c != 1").select("id", "par", "a", "b", "ea", "eb", "c")
        if not state.filter("c = 1").isEmpty():
            chain, ends = _compress(state)
            chains.append(chain)
            ends = ends.select("id", F.col("par").alias("p"), F.col("ea").alias("xa"), F.col("eb").alias("xb"), F.lit(True).alias("hung"))
            new = lambda c, x: F.when(F.col("hung"), F.col(x)).otherwise(F.col(c)).alias(c)
            rest = packed(rest.join(ends, "id", "left").select("id", new("par", "p"), "a", "b", new("ea", "xa"), new("eb", "xb"), "c"))
        else:
            chains.append(None)
        leaves = rest.filter("c = 0")
        raked.append(leaves.select("id", "a", "b"))
        sums = leaves.filter("par is not null").groupBy(F.col("par").alias("id")).agg(
            F.sum(F.col("a") + F.col("ea")).alias("ra"), F.sum(F.col("b") + F.col("eb")).alias("rb"))
        live = rest.filter("c > 1").join(sums, "id", "left").select(
            "id", "par", (F.col("a") + F.coalesce("ra", F.lit(0))).alias("a"), (F.col("b") + F.coalesce("rb", F.lit(0))).alias("b"), "ea", "eb")
        live = packed(live)
    told = nodes.select("id", "a", "b").filter("false")
    for leaves, chain in zip(reversed(raked), reversed(chains)):
        told = told.unionByName(leaves)
        if chain is not None:
            ends = told.select(F.col("id").alias("end"), F.col("a").alias("a2"), F.col("b").alias("b2"))
            told = packed(told.unionByName(chain.join(ends, "end").select("id", (F.col("a") + F.col("a2")).alias("a"),
                                                                           (F.col("b") + F.col("b2")).alias("b"))))
    return told


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node.

    ``turns`` is (conv, pos, k1, k2, chars) with pos from 1 without gaps; ``members`` holds every conversation's conv once, those
    without turns too. saved_tokens sums, over the node's subtree, a node's members but one times the chars of its last turn."""
    ready(turns.sparkSession)
    zero = lambda c: F.lit(0).cast("bigint").alias(c)
    root = members.select("conv", *[zero(c) for c in ("d", "p1", "p2", "h1", "h2", "chars")])
    rows = _running_keys(turns).unionByName(root).checkpoint()
    nodes = rows.groupBy("d", "p1", "p2").agg(F.min("conv").alias("v"), F.count(F.lit(1)).alias("n_convs"), F.min("h1").alias("h1"),
                                              F.min("h2").alias("h2"), F.min("chars").alias("chars"))
    nodes = nodes.withColumn("id", F.monotonically_increasing_id()).checkpoint()
    parents = nodes.select((F.col("d") + 1).alias("d"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("id").alias("par"), F.col("v").alias("pv"))
    up = nodes.select("*", F.col("p1").bitwiseXOR(F.col("h1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("h2")).alias("q2"))
    tree = packed(up.join(parents, ["d", "q1", "q2"], "left").select("id", "par", "v", "pv", "d", "p1", "p2", "n_convs", "chars"))
    kids = tree.filter("par is not null").groupBy(F.col("par").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    tree = packed(tree.join(kids, "id", "left").fillna(0, ["n_children"]))
    weighed = tree.select("id", "par", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("a"),
                          ((F.col("n_convs") - 1) * F.col("chars")).alias("b"))
    ends = rows.groupBy("conv").agg(F.max(F.struct("d", "p1", "p2")).alias("e")).select("conv", "e.*")
    out = tree.join(subtree_totals(weighed), "id").join(_sha256_of_ends(ends), ["d", "p1", "p2"], "left")
    return out.select(F.col("v").alias("conv_id"), F.col("d").alias("depth"), F.col("pv").alias("parent_conv_id"), "n_convs", "n_children",
                      F.col("a").alias("n_leaves"), F.col("b").alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
