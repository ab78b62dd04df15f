"""Splits that keep related records together.

Cases named by one file are one entity. Hash-to-min finds the connected
components of the cases, then weighted rendezvous hashing gives each component one
split. That split depends on the component's name and the weights alone: it doesn't
change when others come or go. Only a component that a new link joins to one with a
lower name takes over that one's split.

The weights are the given proportions. A few large components would make the shares
miss these whatever the hash says, so ``plan_splits`` chooses their splits once, and
the weights for all others from the room that they leave. It is a table that the
caller stores and gives to every later call: neither the large ones nor the others
move then, and what grows large later keeps the split that it has.

Defined results: a null path has no component and no split; a path whose name
can't be read has a null group and is split by its own path; repeated rows each
count; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxledger.llm.paths import chunk_key
from voxledger.session import cut, written

#: A component that holds at least this share of the records is large.
HEAVY_SHARE = 0.005
#: A node with this many members, and this share of all, is joined apart, so that no task gets all of its rows.
HOT_ROWS, HOT_SHARE = 100_000, 0.001


def hash_to_min(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node on an edge; component is the lowest node reached.

    Every node starts with the cluster of itself and its neighbours. In a round a
    node sends its cluster to the cluster's minimum and the minimum to every
    member; it ends when no cluster changes. Clusters are rows (node, member),
    never arrays, and the rows of a giant cluster's node stay where they are: its
    minimum is sent to them. Rounds grow with the logarithm of the diameter; each is
    cut through the shared folder.
    """
    pairs = edges.select(F.col(a).alias("node"), F.col(b).alias("member")).where("node is not null and member is not null")
    own = pairs.select("node", F.col("node").alias("member")).union(pairs.select(F.col("member").alias("node"), "member"))
    now = cut(pairs.union(pairs.select(F.col("member").alias("node"), F.col("node").alias("member"))).union(own).distinct())
    mark = None
    while True:
        with_least = joined_least(now)
        sent = with_least.select(F.col("least").alias("node"), "member").union(with_least.select(F.col("member").alias("node"), F.col("least").alias("member")))
        after = cut(sent.distinct())
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("node", "member").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark, now = tuple(seen), after
    return now.groupBy("node").agg(F.min("member").alias("component"))


def joined_least(clusters: DataFrame) -> DataFrame:
    """clusters (node, member) with least, the node's lowest member; nodes of very many members, at most 1 / HOT_SHARE, are broadcast, the others joined."""
    least = clusters.groupBy("node").agg(F.min("member").alias("least"), F.count("*").alias("n"))
    many = max(HOT_ROWS, HOT_SHARE * clusters.count())
    hot = least.where(F.col("n") >= many).select("node", "least").collect()
    if not hot:
        return clusters.join(least.drop("n"), "node")
    apart = F.broadcast(clusters.sparkSession.createDataFrame(hot, least.select("node", "least").schema))
    return clusters.join(apart, "node").union(clusters.join(apart, "node", "left_anti").join(least.drop("n"), "node"))


def name_nodes(records: DataFrame, path: str = "audio_path", key: str = "row_id") -> DataFrame:
    """(key, path, cases, node) of the records with a path: the cases that it names, and the first of them."""
    named = records.where(F.col(path).isNotNull()).select(F.col(key), F.col(path), chunk_key(F.col(path))["cases"].alias("cases"))
    return named.withColumn("node", F.try_element_at("cases", F.lit(1)))


def group_records(records: DataFrame, path: str = "audio_path", key: str = "row_id") -> DataFrame:
    """(key, path, component bigint): the component of every record with a path."""
    named = name_nodes(records, path, key)
    edges = named.where(F.size("cases") > 1).select(F.col("cases")[0].alias("a"), F.explode(F.slice("cases", 2, F.size("cases"))).alias("b")).distinct()
    linked = hash_to_min(edges)
    return named.select(key, path, "node").join(linked, "node", "left").select(key, path, F.coalesce("component", "node").alias("component"))


def rendezvous(key: Column, weights: dict[str, float]) -> Column:
    """The split with the highest -weight / ln(u), u a hash of key and split between 0 and 1."""
    def score(name: str, weight: float) -> Column:
        u = (F.xxhash64(key, F.lit(name)).bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float(1 << 52))
        return F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(name).alias("split"))

    live = [(n, w) for n, w in weights.items() if w > 0]
    if len(live) == 1:
        return F.lit(live[0][0])
    return F.greatest(*[score(n, w) for n, w in live])["split"]


def entity_of(path: str) -> Column:
    return F.coalesce(F.col("component").cast("string"), F.concat(F.lit("path:"), F.col(path)))


def plan_splits(groups: DataFrame, proportions: dict[str, float], path: str = "audio_path") -> DataFrame:
    """(entity string, split, weight): the splits of large components of ``group_records``, and in rows without entity the weights for all others. To be stored by the caller.

    Large are those that hold at least HEAVY_SHARE of the records, at most
    1 / HEAVY_SHARE; largest first, each goes to the split with most room left.
    """
    spark = groups.sparkSession
    sizes = written(groups.groupBy(entity_of(path).alias("entity")).agg(F.count("*").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    large = sizes.where(F.col("n") >= max(1, math.ceil(total * HEAVY_SHARE))).orderBy(F.desc("n"), "entity").collect() if total else []
    whole = sum(proportions.values())
    room = {s: (total or 1) * p / whole for s, p in proportions.items() if p > 0}
    placed = []
    for r in large:
        best = max(room, key=lambda s: (room[s], s))
        placed.append((r["entity"], best, None))
        room[best] -= r["n"]
    weights = {s: max(0.0, x) for s, x in room.items()}
    if not any(weights.values()):
        weights = {s: float(proportions[s]) for s in room}
    return spark.createDataFrame(placed + [(None, s, float(w)) for s, w in weights.items()], "entity string, split string, weight double")


def assign_splits(groups: DataFrame, proportions: dict[str, float], plan: DataFrame | None = None, key: str = "row_id", path: str = "audio_path") -> DataFrame:
    """(key, component, split) for the rows of ``group_records``: as planned for the large components, else hashed by the plan's weights, without plan by the proportions.

    plan: a table of ``plan_splits``, which has at most 1 / HEAVY_SHARE rows and one per split.
    """
    rows = groups.select(key, path, "component", entity_of(path).alias("_entity"))
    if plan is None:
        return rows.select(key, "component", rendezvous(F.col("_entity"), proportions).alias("split"))
    weights = {r["split"]: r["weight"] for r in plan.where("entity is null").collect()}
    held = F.broadcast(plan.where("entity is not null").select(F.col("entity").alias("_entity"), F.col("split").alias("_planned")))
    return rows.join(held, "_entity", "left").select(key, "component", F.coalesce("_planned", rendezvous(F.col("_entity"), weights)).alias("split"))
