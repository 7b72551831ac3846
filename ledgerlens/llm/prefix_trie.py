"""Conversation prefix trie by ROLLUP over positional turn columns.

A conversation is a row of turn ids, ``WIDTH`` of them side by side; a longer one goes on
in further rows, its next blocks.  Each block is keyed by the node that the block before
ended at, so one ``GROUP BY block, key, ROLLUP (turn1, …)`` over all blocks makes every
prefix of every conversation at once, and ``grouping_id`` tells its depth.  No step goes
from depth to depth, so the number of jobs does not grow with the longest conversation.

A turn's id is two 64-bit hashes of its role, text and place, and a node's key is the
exclusive or of the ids on the way to it: two different prefixes get one key with a
probability of 2^-128.

Sums over subtrees need no walk either.  Every node is charged to its smallest member; a
conversation is charged with the end of its own path, from the first node where it is the
smallest.  A second ROLLUP adds up what the members of every node are charged with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import count_words, lean, narrow_batches
from ledgerlens.operators.ordered import attach, hash_salt
from ledgerlens.settings import settle

WIDTH = 8
BUCKET_TURNS = 4096
BUCKET_BLOCKS = 512
BUCKET_IDS = 4096
TURNS = [f"t{k}" for k in range(1, WIDTH + 1)]
KEY = ["depth", "a", "b"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, u, v, words`` of every turn: its place from 0, two hashes, its words.

    Turns are ordered by ``turn`` (null first), ties by role and text; null roles and texts
    are empty.  Rows without ``conv_id`` belong to no conversation and are left out.  Places
    are counted inside buckets of turn numbers, so a long conversation is many small groups.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint"), F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / BUCKET_TURNS).cast("bigint"), F.lit(-(1 << 62))).alias("bucket"),
    )
    group = ["conv_id", "bucket"]
    inside = Window.partitionBy(*group).orderBy("turn", "role", "text")
    ranked = rows.select(
        *group, F.row_number().over(inside).alias("rank"), F.xxhash64(F.lit(1), "role", "text").alias("u"),
        F.xxhash64(F.lit(2), "text", "role").alias("v"), count_words("text").alias("words"),
    )
    before = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).select(
        *group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    pos = (F.col("offset") + F.col("rank") - 1).cast("bigint").alias("pos")
    return ranked.join(offsets, group).select("conv_id", pos, "u", "v", "words")


def shared_openings(turns: DataFrame, every: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on shared openings: their turns, and all their ids.

    Conversation ``c`` opens with the first ``h`` turns of ``c - c % every`` (as many as it
    has, none if it is not there) and goes on with its own turns after its first ``h``, where
    ``h`` is the CRC-32 of its decimal id modulo ``most + 1``.
    """
    openings = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    heads = turns.where((F.col("pos") < most) & (F.col("conv_id") % every == 0)).groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "u", "v", "words"))).alias("heads")
    )
    ids = turns.select("conv_id").distinct().withColumns({"h": openings.cast("int"), "base": F.col("conv_id") - F.col("conv_id") % every})
    convs = ids.join(heads, "base", "left").select(
        "conv_id", F.coalesce(F.slice("heads", F.lit(1), F.col("h")), F.array().cast(heads.schema["heads"].dataType)).alias("opening")
    )
    opened = convs.select("conv_id", F.explode("opening").alias("o")).select("conv_id", "o.pos", "o.u", "o.v", "o.words")
    own = turns.withColumn("h", openings).where(F.col("pos") >= F.col("h"))
    shifts = convs.select("conv_id", F.size("opening").alias("shift"))
    moved = attach(own, shifts, ["conv_id"], hash_salt("pos"), "inner").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("shift")).alias("pos"), "u", "v", "words"
    )
    return opened.unionByName(moved), ids.select("conv_id")


def blocks(turns: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``WIDTH`` turn columns with the key of the node before them, and one row per conversation.

    Running keys and word counts are taken inside buckets of blocks and carried across
    them.  A conversation without turns has one block without turns.
    """
    slot = F.col("pos") % WIDTH
    placed = turns.select(
        "conv_id", "pos", F.xxhash64(F.lit(3), "pos", "u", "v").alias("a"), F.xxhash64(F.lit(4), "v", "u", "pos").alias("b"), "words"
    ).unionByName(ids.select("conv_id", F.lit(0).cast("bigint").alias("pos")), allowMissingColumns=True)
    parts = {f"{c}{k}": F.max(F.when(slot == k - 1, F.col(c))) for k in range(1, WIDTH + 1) for c in ("a", "b", "words")}
    sums = {"a": F.bit_xor("a"), "b": F.bit_xor("b"), "words": F.sum("words"), "turns": F.count("a")}
    rows = placed.groupBy("conv_id", F.floor(F.col("pos") / WIDTH).cast("bigint").alias("block")).agg(
        *[F.coalesce(agg, F.lit(0)).alias(c) for c, agg in sums.items()], *[agg.alias(c) for c, agg in parts.items()]
    )
    rows = settle(rows.withColumn("bucket", F.floor(F.col("block") / BUCKET_BLOCKS)), "trie-blocks")

    def running(c: str, over: Window) -> Column:
        return F.coalesce((F.sum if c == "words" else F.bit_xor)(c).over(over), F.lit(0))

    carried = ("a", "b", "words")
    bucket_sums = rows.groupBy("conv_id", "bucket").agg(*[(F.sum if c == "words" else F.bit_xor)(c).alias(c) for c in carried])
    across = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = bucket_sums.select("conv_id", "bucket", *[running(c, across).alias(f"base_{c}") for c in carried])
    inside = Window.partitionBy("conv_id", "bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({f"in_{c}": running(c, inside) for c in carried}).join(bases, ["conv_id", "bucket"])
    turn_ids = [
        F.when(F.col(f"a{k}").isNotNull(), F.struct(F.col(f"a{k}").alias("a"), F.col(f"b{k}").alias("b"), F.col(f"words{k}").alias("words")))
        .alias(f"t{k}") for k in range(1, WIDTH + 1)
    ]
    keyed = local.select(
        "conv_id", "block", F.col("in_a").bitwiseXOR(F.col("base_a")).alias("ka"), F.col("in_b").bitwiseXOR(F.col("base_b")).alias("kb"),
        (F.col("in_words") + F.col("base_words")).alias("words_before"), *turn_ids,
    )
    convs = settle(rows.groupBy("conv_id").agg(
        F.sum("turns").alias("turns"), F.sum("words").alias("all_words"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")
    ), "trie-conversations")
    sizes = convs.select("conv_id", "turns", "all_words")
    full = attach(keyed, sizes, ["conv_id"], hash_salt("block"), "inner").select(
        "conv_id", "block", "ka", "kb", "turns", (F.col("all_words") - F.col("words_before")).alias("rest"), *TURNS
    )
    return settle(full, "trie-keyed"), convs


def rolled(rows: DataFrame, measures: str) -> DataFrame:
    """One row per node: its key and its parent's, its last turn's words, those before in its block, and the measures."""
    grouped = rows.sparkSession.sql(
        f"SELECT block, ka, kb, {', '.join(TURNS)}, {WIDTH} - bit_count(grouping_id()) AS held, {measures} "
        f"FROM {{rows}} GROUP BY block, ka, kb, ROLLUP ({', '.join(TURNS)})",
        rows=rows,
    )
    # The last turn of the group: null where conversations of the group ended before it.
    last = F.coalesce(*[F.when(F.col("held") == k, F.col(f"t{k}")) for k in range(1, WIDTH + 1)])
    nodes = grouped.withColumn("last", last).where(
        F.col("last").isNotNull() | ((F.col("held") == 0) & (F.col("block") == 0))
    )

    def key(c: str) -> Column:
        return reduce(lambda x, y: x.bitwiseXOR(y), [F.coalesce(F.col(f"{t}.{c}"), F.lit(0)) for t in TURNS], F.col(f"k{c}"))

    held_words = reduce(Column.__add__, [F.coalesce(F.col(f"{t}.words"), F.lit(0)) for t in TURNS])
    words = F.coalesce("last.words", F.lit(0))
    kept = [c for c in grouped.columns if c not in ("block", "ka", "kb", "held", *TURNS)]
    return nodes.select(
        (F.col("block") * WIDTH + F.col("held")).alias("depth"), key("a").alias("a"), key("b").alias("b"),
        key("a").bitwiseXOR(F.coalesce("last.a", F.lit(0))).alias("parent_a"),
        key("b").bitwiseXOR(F.coalesce("last.b", F.lit(0))).alias("parent_b"),
        words.alias("words"), (held_words - words).alias("inner"), *kept,
    )


def ends(convs: DataFrame) -> DataFrame:
    """``depth, a, b, ends_sha256``: hash of the ids of the conversations that end at a node.

    Ids are sorted and written out in ranges of ``BUCKET_IDS``; the ranges of a node stream
    through its hash in order.
    """
    narrow_batches(convs.sparkSession)
    node = [F.col("turns").alias("depth"), F.col("a"), F.col("b")]
    parts = convs.groupBy(*node, F.floor(F.col("conv_id") / BUCKET_IDS).alias("part")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, told = None, hashlib.sha256()
        for batch in batches:
            done = []
            for *at, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
                if at != key:
                    if key:
                        done.append((*key, told.hexdigest()))
                    key, told = at, hashlib.sha256(ids.encode())
                else:
                    told.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip([*KEY, "ends_sha256"], r)) for r in done])
        if key:
            yield pa.RecordBatch.from_pylist([dict(zip([*KEY, "ends_sha256"], (*key, told.hexdigest())))])

    ordered = parts.repartition(*KEY).sortWithinPartitions(*KEY, "part").select(*KEY, "ids")
    return ordered.mapInArrow(lean(hashed), "depth bigint, a bigint, b bigint, ends_sha256 string")


def trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Every node of the trie over conversations given as ``numbered_turns`` and all their ids.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` (words that sharing the nodes of the subtree
    saves) and ``ends_sha256``.  Members without turns stand at the root; without any
    conversation there is no node.  The node's last turn is that of ``conv_id`` at ``depth``.
    """
    rows, convs = blocks(turns, ids)
    first = rolled(rows, "min(conv_id) AS conv_id, max(turns) AS deepest")
    charged = first.groupBy("conv_id").agg(
        F.sum("words").alias("own"), F.max((F.col("deepest") == F.col("depth")).cast("bigint")).alias("leaf")
    )
    charged = attach(rows, settle(charged, "trie-charged"), ["conv_id"], hash_salt("block")).withColumns(
        {"own": F.coalesce("own", F.lit(0)), "leaf": F.coalesce("leaf", F.lit(0))}
    )
    nodes = settle(rolled(
        charged,
        "min(conv_id) AS conv_id, count(*) AS n_convs, sum(leaf) AS n_leaves, sum(rest) AS rest, sum(own) AS own, "
        "min_by(rest - own, conv_id) AS smallest",
    ), "trie-nodes")
    # Words of all members from this node on, less those of every node of the subtree once.
    saved = F.col("rest") - F.col("n_convs") * F.col("inner") - (F.col("own") + F.col("smallest") - F.col("inner"))
    nodes = nodes.withColumn("saved_tokens", saved)
    up = [(F.col("depth") - 1).alias("depth"), F.col("parent_a").alias("a"), F.col("parent_b").alias("b")]
    children = nodes.where(F.col("depth") > 0).groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("a").alias("parent_a"), F.col("b").alias("parent_b"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    whole = nodes.join(children, KEY, "left").join(ends(convs), KEY, "left")
    linked = attach(whole, parents, ["depth", "parent_a", "parent_b"], hash_salt("a", "b"))
    nothing = hashlib.sha256(b"").hexdigest()
    return linked.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are; columns other than the four of a turn are ignored."""
    turns = settle(numbered_turns(conversations), "trie-turns")
    return trie(turns, turns.select("conv_id").distinct())


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations rebuilt on shared openings."""
    return trie(*shared_openings(settle(numbered_turns(conversations), "trie-turns")))
