"""Consolidating pairwise matches: connected components by alternating large-star and small-star.

Edges run from the larger node to the smaller. Large-star links every larger neighbour of a node to the least node
around it; since that is the node's own least smaller neighbour, or itself, an edge (u, v) becomes (u, least of v).
Small-star links a node and its smaller neighbours to the least of them, which moves edges only of nodes that have
several. The two alternate, and what hangs on a single node and carries none is set aside after each round, until no
edge is left to rewrite; then every node has its component's least identifier through the node that it was set aside
with. Later rounds only touch components that are no stars yet; the last few edges are rewritten in one task.

Scale: minima are combined before their shuffle, so a node with a third of all edges costs one row per task. They
are written to the shared folder before they are joined back: both sides then enter the join through an exchange of
their own, and adaptive execution splits such a node's edges over tasks. The tables of a round are deleted once the
next one stands. Nothing is collected but a count a round, taken while the round is written. Identifiers are 64-bit
hashes of the records, checked to be unique, so that records meet by longs alone; the least record of each group in the
wanted order is found at the end, by one minimum per group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from claimscope.session import discard, written, written_at

#: The number of rounds grows with the logarithm of the largest component; more are an error.
MAX_ROUNDS = 100
#: So few edges (counted) are settled in one task; more of them take further rounds.
FEW_EDGES = 50_000


class _Stars:
    """The edges still at work, between rounds. Nodes that hang on one node only, and on which none hangs, are set aside
    with it: whatever becomes of that node, they share its component, and as they are larger they never name it."""

    def __init__(self, pairs: DataFrame):
        self.spark, self.paths = pairs.sparkSession, []
        edges = pairs.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        self.edges = self._keep(edges, "edges")
        self.aside: list[DataFrame] = []

    def _keep(self, df: DataFrame, label: str) -> DataFrame:
        table, path = written_at(df, label)
        self.paths.append(path)
        return table

    def set_aside(self) -> int:
        """Move finished leaves out of the edges; how many edges remain. One table has for every node its least and
        greatest smaller neighbour, and whether a larger one hangs on it."""
        up = self.edges.select(F.col("u").alias("n"), F.col("v").alias("p"), F.lit(False).alias("carries"))
        down = self.edges.select(F.col("v").alias("n"), F.lit(None).cast("long").alias("p"), F.lit(True).alias("carries"))
        around = written(up.unionByName(down).groupBy("n").agg(F.min("p").alias("m"), F.max("p").alias("most"), F.max("carries").alias("carries")), "around").filter("m IS NOT NULL")
        one = around.filter("m = most").select(F.col("n").alias("u"), F.col("m").alias("v"), "carries")
        self.aside.append(one.filter("NOT carries").select("u", "v"))
        self.least = around.select(F.col("n").alias("u"), "m")
        seen = Observation()
        rest = one.filter("carries").select("u", "v").unionByName(self.edges.join(around.filter("m < most").select(F.col("n").alias("u")), "u", "left_semi"))
        self.edges = self._keep(rest.observe(seen, F.count(F.lit(1)).alias("n")), "edges")
        return seen.get.get("n", 0)

    def large_star(self) -> DataFrame:
        """The edges moved to the least node around their smaller end."""
        least = self.least.select(F.col("u").alias("v"), "m")
        return self._keep(self.edges.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v")), "large")

    def small_star(self, edges: DataFrame) -> DataFrame:
        """Edges of each node and its smaller neighbours to the least of them."""
        least = self._keep(edges.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most")), "least")
        moved = edges.join(least.filter("m < most").select("u", "m"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return least.select("u", F.col("m").alias("v")).unionByName(moved).distinct()

    def round(self) -> None:
        old, self.paths = self.paths, []
        self.edges = self._keep(self.small_star(self.large_star()), "edges")
        for path in old:
            discard(self.spark, path)

    def roots(self, found: DataFrame) -> DataFrame:
        """(id, root) of all nodes, from those that were never set aside and from the last round back: a node's root is
        that of the node it hangs on."""
        for nodes in reversed(self.aside):
            own = nodes.select(F.col("u").alias("id"), "v").join(found.select(F.col("id").alias("v"), "root"), "v", "left")
            found = written(own.select("id", F.coalesce("root", "v").alias("root")).unionByName(found), "roots")
        return found


def settled(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, their roots) of a few edges, by the same two rewrites in arrays."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    while True:
        least = np.arange(len(nodes))
        np.minimum.at(least, a, b)
        large = least[b]
        least = np.arange(len(nodes))
        np.minimum.at(least, a, large)
        m = least[a]
        moved = large != m
        pairs = np.unique(np.stack((np.concatenate((a, large[moved])), np.concatenate((m, m[moved])))), axis=1)
        if pairs.shape[1] == len(a) and (pairs[0] == a).all() and (pairs[1] == b).all():
            return nodes, nodes[least]
        a, b = pairs


def _settle(batches):
    own = [(x.column("u").to_numpy(), x.column("v").to_numpy()) for x in batches]
    if own and sum(len(u) for u, _ in own):
        nodes, roots = settled(np.concatenate([u for u, _ in own]), np.concatenate([v for _, v in own]))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["id", "root"])


def components(pairs: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(u, v) of long -> (id, root): every node that occurs in a pair of two different nodes, with the least node of
    its component. Nulls and self pairs tie nothing, repeated pairs count once, no pairs give no rows."""
    stars = _Stars(pairs.dropna())
    for _ in range(MAX_ROUNDS):
        if stars.set_aside() <= few:
            break
        stars.round()
    else:
        raise RuntimeError("components did not settle")
    last = written(stars.edges.repartition(1).mapInArrow(_settle, "id long, root long"), "settled")
    found = stars.roots(last)
    # a root that was never in the last edges has no row of its own yet
    return found.unionByName(found.filter("id <> root").select(F.col("root").alias("id"), "root").distinct().join(last.select("id"), "id", "left_anti"))


MENTION = ["submission_id", "doc_id", "span_lo", "span_hi"]
#: Hash seeds tried until no two records share an identifier.
SEEDS = range(8)


def identified(rows: DataFrame, key: list[str]) -> tuple[DataFrame, int]:
    """(id, key...: each key once, the seed of the ids). An id is a 64-bit hash, so that records meet by longs alone; that
    no two keys share one is checked, and another seed is taken where two do."""
    for seed in SEEDS:
        table, path = written_at(rows.select(hashed(seed, *key).alias("id"), *key).distinct(), "nodes")
        if table.groupBy("id").count().filter("count > 1").isEmpty():
            return table, seed
        discard(rows.sparkSession, path)
    raise RuntimeError("no seed sets all records apart")


def hashed(seed: int, *columns) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def mention_pairs(mentions: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with id, pairs (u, v)). Mentions are tied to the mention at their canonical span, and to the one of least id
    of their submission with the same link_name. Nulls, empty names, wiki:NULL in any case, and canonical spans or
    links without a mention tie nothing; extra columns and re-uploads of a key change nothing."""
    span = lambda df, *more: df.select("submission_id", "doc_id", F.col("span.lo").alias("span_lo"), F.col("span.hi").alias("span_hi"), *more).dropna(subset=MENTION)
    m = span(mentions, F.col("canonical_span.lo").alias("c_lo"), F.col("canonical_span.hi").alias("c_hi"))
    nodes, seed = identified(m, MENTION)
    elsewhere = F.col("c_lo").isNotNull() & F.col("c_hi").isNotNull() & ((F.col("c_lo") != F.col("span_lo")) | (F.col("c_hi") != F.col("span_hi")))
    claims = m.filter(elsewhere).select(hashed(seed, *MENTION).alias("u"), hashed(seed, "submission_id", "doc_id", "c_lo", "c_hi").alias("v"))
    canonical = claims.join(nodes.select(F.col("id").alias("v")), "v", "left_semi").select("u", "v")
    some = (F.col("link_name") != "") & (F.upper("link_name") != "WIKI:NULL")
    named = span(links, "link_name").filter(some).select(hashed(seed, *MENTION).alias("id"), "submission_id", "link_name").distinct()
    named = written(named.join(nodes.select("id"), "id", "left_semi"), "named")
    # written, so that a name with very many links is split when its least mention is joined
    least = written(named.groupBy("submission_id", "link_name").agg(F.min("id").alias("v")), "least")
    linked = named.join(least, ["submission_id", "link_name"]).select(F.col("id").alias("u"), "v")
    return nodes, canonical.unionByName(linked)


def mention_groups(mentions: DataFrame, links: DataFrame) -> DataFrame:
    """Every mention in a group of two or more with the group's least mention by (doc_id, lo, hi)."""
    nodes, pairs = mention_pairs(mentions, links)
    members = written(components(pairs).join(nodes, "id"), "members")
    # written, so that a group with very many mentions is split when its least one is joined
    least = written(members.groupBy("root").agg(F.min(F.struct("doc_id", "span_lo", "span_hi")).alias("k")), "least")
    least = least.select("root", F.col("k.doc_id").alias("group_doc_id"), F.col("k.span_lo").alias("group_span_lo"), F.col("k.span_hi").alias("group_span_hi"))
    return members.join(least, "root").select(*MENTION, "group_doc_id", "group_span_lo", "group_span_hi")
