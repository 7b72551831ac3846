"""Near-duplicates by chosen-path set similarity join.

Documents are sets of word shingles.  In each of several independent trees a document
goes down the branches named by a few of its minwise tokens, the positions being chosen
by the path so far; documents of similarity ``s`` share each branch with probability
``s``.  A node that holds one document ends, a small node is compared exhaustively, a
large one branches again.  Pairs of a leaf whose tokens agree often enough are candidates,
which are then confirmed on full shingle sets, and confirmed links are closed to groups.

With two branches a level and similarity 0.8, a pair is missed by one tree of three
levels with probability under 0.06 (0.04 at the root, where small nodes already end).
No two branches of a tree and no two trees read the same token, so eight trees miss about
1.5 pairs in ten thousand million.  A pair at the threshold has too few agreeing tokens
with a probability of at most ``FILTER_MISS``; ``miss_probability`` adds both.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import LOWER, as_bytes, cluster, lean, narrow_batches, runs
from ledgerlens.operators.components import connected_components
from ledgerlens.settings import settle

SHINGLE = 5
TREES = 8
BRANCHES = 2
LEVELS = 3
#: Every branch of every tree has a minwise token of its own.
TREE_TOKENS = sum(BRANCHES**k for k in range(1, LEVELS + 1))
POSITIONS = TREES * TREE_TOKENS
SMALL_NODE = 256
BLOCK = 1024
#: Highest chance that a pair at the threshold agrees in too few tokens to be a candidate.
FILTER_MISS = 1e-10
BROADCAST_IDS = 2_000_000
MEMO = 250_000

_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(1, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 2**64) for k in range(SHINGLE - 1, -1, -1)], dtype=np.uint64)


def filter_miss(similarity: float, need: int) -> float:
    """Chance that a pair agrees in fewer than ``need`` of its tokens."""
    return sum(comb(POSITIONS, k) * similarity**k * (1 - similarity) ** (POSITIONS - k) for k in range(need))


def needed(threshold: float) -> int:
    """Tokens in which candidates agree: as many as lose a pair at the threshold with ``FILTER_MISS`` at most."""
    need = 0
    while need < POSITIONS and filter_miss(threshold, need + 1) <= FILTER_MISS:
        need += 1
    return need


def miss_probability(
    similarity: float, trees: int = TREES, branches: int = BRANCHES, levels: int = LEVELS, threshold: float | None = None,
) -> float:
    """Upper bound of the chance that a pair is lost: no tree keeps it together down to its
    leaves, or it agrees in too few tokens for ``threshold`` (the similarity itself if not given)."""
    lost = 0.0
    for _ in range(levels):
        lost = (1 - similarity + similarity * lost) ** branches
    return lost**trees + filter_miss(similarity, needed(similarity if threshold is None else threshold))


class Shingles:
    """Texts to sorted arrays of 64-bit shingle hashes; words are hashed once per worker."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        import xxhash

        words = text.translate(LOWER).split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > MEMO:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        k = min(SHINGLE, len(words))
        n = len(words) - k + 1
        out = np.full(n, 0 if k == SHINGLE else k, dtype=np.uint64)
        for j in range(k):
            out += h[j:j + n] * _POWERS[j]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minwise tokens of a set, one for each position."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(shingles), 512):
        part = shingles[start:start + 512, None] * _FACTORS[None, :]
        np.minimum(least, part.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sets_of(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, print, tokens`` of every row: set size, a 128-bit fingerprint
    of the set and its minwise tokens (both null for an empty set)."""
    narrow_batches(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingles = Shingles()
        for batch in batches:
            sizes, prints, tokens = [], [], []
            for text in as_bytes(batch.column(1)):
                s = shingles(text)
                sizes.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s) if len(s) else None)
                tokens.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(tokens, pa.list_(pa.int32()))],
                ["doc_id", "n_shingles", "print", "tokens"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(lean(make), "doc_id bigint, n_shingles bigint, print binary, tokens array<int>")


def _shared_nodes(rows: DataFrame) -> DataFrame:
    """Rows of nodes with two members or more, with the node's size ``members``."""
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return rows.join(sizes, "node")


def leaves(representatives: DataFrame) -> DataFrame:
    """``node, members, id, tokens`` of every node that is to be compared.

    ``representatives`` has ``id, tokens``.  Nodes are narrow rows (node, id) until they
    are known to hold two documents.  The tokens of a tree are laid out as a heap: a branch
    that read token ``k`` of its tree is followed by ``BRANCHES * (k + 1)`` and the next ones.
    """
    tree, k = F.floor(F.col("at") / F.lit(TREE_TOKENS)), F.col("at") % F.lit(TREE_TOKENS)
    starts = [t * TREE_TOKENS + b for t in range(TREES) for b in range(BRANCHES)]
    roots = representatives.select("id", "tokens", F.explode(F.array(*map(F.lit, starts))).alias("at")).select(
        "id", "at", F.element_at("tokens", F.col("at") + 1).alias("token")
    )
    first = settle(
        _shared_nodes(roots.select(F.xxhash64("at", "token").alias("node"), "id", "at")), "paths-1"
    ).join(representatives, "id")
    live = first
    out = None
    for level in range(1, LEVELS + 1):
        done = live if level == LEVELS else live.where(F.col("members") <= SMALL_NODE)
        done = done.select("node", "members", "id", "tokens")
        out = done if out is None else out.unionByName(done)
        if level == LEVELS:
            break
        large = live.where(F.col("members") > SMALL_NODE)
        branch = F.explode(F.sequence(F.lit(0), F.lit(BRANCHES - 1)))
        down = large.select("id", "tokens", "node", "at", branch.alias("b")).withColumn(
            "at", (tree * TREE_TOKENS + BRANCHES * (k + 1) + F.col("b")).cast("int")
        ).select("id", "tokens", "at", F.xxhash64("node", "at", F.element_at("tokens", F.col("at") + 1)).alias("node"))
        live = settle(_shared_nodes(down), f"paths-{level + 1}")
        if live.isEmpty():
            break
    return out


def in_blocks(rows: DataFrame, key: str, size: str, member: str) -> DataFrame:
    """Add ``a, b``: groups above ``BLOCK`` rows become pairs of blocks, so that every two
    members meet in some pair and no task holds more than two blocks."""
    blocks = F.ceil(F.col(size) / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64(member, F.lit(9)), blocks).cast("int")
    pairs = F.when(
        blocks > 1,
        F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(own, o).alias("a"), F.greatest(own, o).alias("b"))),
    ).otherwise(F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))))
    return rows.withColumn("_pair", F.explode(pairs)).select(*rows.columns, "_pair.a", "_pair.b")


def _grouped(rows: DataFrame, keys: list[str], links, schema: str) -> DataFrame:
    """Stream sorted groups through ``links(table)``, which yields ``(id, root)`` pairs."""
    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in runs(batches, keys):
            out += links(group)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(close), schema)


def _star(ids: np.ndarray, roots: list[int]) -> list[tuple[int, int]]:
    """Links of every member to the smallest id of its cluster."""
    least: dict[int, int] = {}
    for i, r in zip(ids.tolist(), roots):
        least[r] = min(least.get(r, i), i)
    return [(i, least[r]) for i, r in zip(ids.tolist(), roots) if i != least[r]]


def candidate_links(nodes: DataFrame, threshold: float) -> DataFrame:
    """Compare the members of every node by their minwise tokens; stars instead of pairs."""
    need = needed(threshold)

    def links(group: pa.Table) -> list[tuple[int, int]]:
        ids = group.column("id").combine_chunks().to_numpy()
        tokens = group.column("tokens").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        if len(ids) == 2:
            return _star(ids, [0, 0]) if (tokens[0] == tokens[1]).sum() >= need else []
        return _star(ids, cluster(len(ids), lambda i: np.flatnonzero((tokens == tokens[i]).sum(axis=1) >= need)))

    rows = in_blocks(nodes, "node", "members", "id").select("node", "a", "b", "id", "tokens")
    return _grouped(rows, ["node", "a", "b"], links, "a bigint, b bigint").distinct()


def exact_links(sets: list[np.ndarray], percent: int):
    """``linked(i)``: the sets whose Jaccard similarity with set ``i`` is at least ``percent`` of 100."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(token, kind="stable")
    starts = np.searchsorted(token[order], np.arange(token.max() + 2))
    holders = owner[order]
    ends = np.concatenate([[0], np.cumsum(sizes)])

    def linked(i: int) -> np.ndarray:
        own = token[ends[i]:ends[i + 1]]
        lists = [holders[starts[t]:starts[t + 1]] for t in own]
        shared = np.bincount(np.concatenate(lists), minlength=len(sets))
        return np.flatnonzero(100 * shared >= percent * (sizes + sizes[i] - shared))

    return linked


def confirmed_links(docs: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """Links that hold on full shingle sets, inside the candidate clusters ``id, cluster, members``.

    Each clustered document's set moves once.  The ids are broadcast where there are few
    of them and joined by shuffle where there are many.
    """
    ids = clusters.withColumnsRenamed({"id": "doc_id"})
    if clusters.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = docs.select(F.col("doc_id").cast("bigint"), "text").join(ids, "doc_id")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            names = batch.schema.names
            sets = [shingles(t).view(np.int64) for t in as_bytes(batch.column(names.index("text")))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index(c)) for c in ("doc_id", "cluster", "members")] + [pa.array(sets, pa.list_(pa.int64()))],
                ["id", "cluster", "members", "shingles"],
            )

    def links(group: pa.Table) -> list[tuple[int, int]]:
        ids = group.column("id").combine_chunks().to_numpy()
        lists = group.column("shingles").combine_chunks()
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        sets = [values[a:b] for a, b in zip(offsets, offsets[1:])]
        return _star(ids, cluster(len(ids), exact_links(sets, percent)))

    made = rows.mapInArrow(lean(make), "id bigint, cluster bigint, members bigint, shingles array<bigint>")
    return _grouped(
        in_blocks(made, "cluster", "members", "id").select("cluster", "a", "b", "id", "shingles"),
        ["cluster", "a", "b"], links, "a bigint, b bigint",
    )


def components(edges: DataFrame) -> DataFrame:
    """``id, label`` of every linked id, label the smallest id it reaches."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return connected_components(nodes, edges).withColumnRenamed("node", "id")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Documents with ``100 * shared >= percent * union`` are linked.  Equal sets are one
    node from the start.  A text without words, or null, has no shingles and is a group
    of its own; fewer than five words are one shingle.  Rows with a null id are returned
    with null group and decision and link nothing; repeated rows are one node and each is
    answered; an empty table gives no rows; other columns are ignored.
    """
    sets = settle(sets_of(docs), "near-sets")
    named = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = settle(
        named.groupBy("print").agg(F.min("doc_id").alias("id"), F.first("tokens").alias("tokens")), "near-nodes"
    )
    edges = settle(candidate_links(leaves(nodes.select("id", "tokens")), percent / 100), "near-candidates")
    labels = components(edges)
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    clusters = settle(
        labels.join(sizes, "label").select("id", F.col("label").alias("cluster"), "members"), "near-clusters"
    )
    confirmed = settle(confirmed_links(docs, clusters, percent), "near-links")
    if clusters.where(F.col("members") > BLOCK).isEmpty():
        # One group saw each cluster whole, so its stars already end at the smallest id.
        final = confirmed.select(F.col("a").alias("id"), F.col("b").alias("label")).groupBy("id").agg(F.min("label").alias("label"))
    else:
        final = components(confirmed)
    of_print = nodes.select("print", "id").join(final, "id", "left").select(
        "print", F.coalesce("label", "id").alias("component")
    )
    out = sets.drop("tokens").join(of_print, "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that another document of their group stands for.

    Of rows that repeat a kept id and its text one stays.  Rows with null ids stay.
    """
    found = settle(near_duplicates(docs, percent), "near-found")
    gone = found.where("NOT kept").select("doc_id").distinct()
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    left = docs.join(gone, "doc_id", "left_anti")
    again = settle(found.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id"), "near-again")
    if again.isEmpty():
        return left
    once = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, "doc_id", "left_anti").unionByName(once)
