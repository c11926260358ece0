"""Weighted community detection with a resolution: Leiden's three phases as rounds of joins and aggregates.

Nodes move to the neighbouring community with the highest gain of the resolution modularity (all at once, where that
raises the quality, else those that do not touch each other), until no move gains. Every community is refined
into connected parts, the parts become the nodes of the next level, and levels follow until none merges. The
whole is repeated from the found partition until a pass changes nothing. Quality rises strictly with
each step that changes the partition, so the passes come to an end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spill
from .communities import connected_parts
from .concepts import both_ways

EPSILON = 1e-9
# Share of the nodes below which all moves are tried at once, else a seeded half of them.
FEW = 0.02


def _keep(df: DataFrame) -> DataFrame:
    """Write a step to shared storage; the scan's size lets Spark choose its joins."""
    return spill(df, "leiden")


def _moves(links: DataFrame, state: DataFrame, total: float, resolution: float, turn: int, active: DataFrame | None) -> DataFrame:
    """(``node``, ``degree``, ``community``, ``to``, ``gain``): the best move of every node that gains by one.

    ``state`` is (node, community, degree). A node may also leave for a community of its own. With ``active`` only
    those nodes are looked at, and only their links are read.
    """
    sizes = state.groupBy("community").agg(F.sum("degree").alias("volume"), F.count("*").alias("members"))
    own = links.filter(F.col("u") != F.col("v"))
    asked = state
    if active is not None:
        own = own.join(active.withColumnRenamed("node", "u"), "u", "left_semi")
        asked = state.join(active, "node", "left_semi")
    here = state.select(F.col("node").alias("v"), F.col("community").alias("to"))
    toward = own.join(here, "v").groupBy("u", "to").agg(F.sum("weight").alias("shared"))
    goals = sizes.select(F.col("community").alias("to"), F.col("volume").alias("to_volume"), F.col("members").alias("to_members"))
    homes = asked.join(sizes, "community").withColumnRenamed("node", "u")
    pull = resolution * F.col("degree") / total
    inside = F.col("to") == F.col("community")
    value = F.round(F.col("shared") - pull * F.col("to_volume"), 9)
    # Two single nodes may only join toward the smaller label, so they cannot swap.
    allowed = ~inside & ((F.col("members") > 1) | (F.col("to_members") > 1) | (F.col("to") < F.col("community")))
    best = toward.join(homes, "u").join(goals, "to").groupBy("u").agg(
        F.min(F.when(allowed, F.struct((-value).alias("neg"), "to"))).alias("best"),
        F.max(F.when(inside, F.col("shared"))).alias("own"),
    )
    stay = F.coalesce("own", F.lit(0.0)) - pull * (F.col("volume") - F.col("degree"))
    alone = F.when(F.col("members") > 1, F.struct(F.lit(0.0).alias("neg"), F.concat(F.lit(f"~{turn}:"), F.col("u").cast("string")).alias("to")))
    found = homes.join(best, "u", "left").withColumn("goal", F.least("best", alone)).withColumn("gain", -F.col("goal.neg") - stay)
    return found.filter(F.col("gain") > EPSILON).select(
        F.col("u").alias("node"), "degree", "community", F.col("goal.to").alias("to"), "gain"
    )


def _apart(moves: DataFrame) -> DataFrame:
    """Moves that are the best one for both communities they touch: their gains add up exactly."""
    rank = F.struct((-F.col("gain")).alias("neg"), "node")
    ends = moves.select("node", "gain", F.explode(F.array("community", "to")).alias("c"))
    first = ends.groupBy("c").agg(F.min(rank).alias("first"))
    won = ends.join(first, "c").filter(F.col("first.node") == F.col("node")).groupBy("node").agg(F.count("*").alias("n"))
    return moves.join(won.filter("n = 2").select("node"), "node", "left_semi")


def _rise(links: DataFrame, state: DataFrame, moves: DataFrame, total: float, resolution: float) -> float:
    """How much the quality (times half the total weight) changes if all ``moves`` are made."""
    new = moves.select("node", "to", F.col("community").alias("from"))
    touched = links.filter(F.col("u") != F.col("v"))
    at = state.select("node", "community").join(new.select("node", "to"), "node", "left").select(
        "node", "community", F.coalesce("to", "community").alias("now"), F.col("to").isNotNull().alias("moved")
    )
    left = at.filter("moved").select(F.col("node").alias("u"), F.col("community").alias("u0"), F.col("now").alias("u1"))
    right = at.select(F.col("node").alias("v"), F.col("community").alias("v0"), F.col("now").alias("v1"), F.col("moved").alias("v_moved"))
    same = F.when(F.col("u1") == F.col("v1"), F.col("weight")).otherwise(0.0) - F.when(F.col("u0") == F.col("v0"), F.col("weight")).otherwise(0.0)
    # A link between two moving nodes is met from both ends, any other one from its moving end alone.
    inner = touched.join(left, "u").join(right, "v").agg(F.sum(same * F.when(F.col("v_moved"), 0.5).otherwise(1.0)).alias("s"))
    shifts = moves.select(F.col("to").alias("c"), F.col("degree").alias("d")).union(moves.select("community", -F.col("degree")))
    volumes = state.groupBy(F.col("community").alias("c")).agg(F.sum("degree").alias("volume"))
    square = shifts.groupBy("c").agg(F.sum("d").alias("d")).join(volumes, "c", "left").agg(
        (F.sum(F.col("d") * (2 * F.coalesce("volume", F.lit(0.0)) + F.col("d"))) * (-resolution / (2 * total))).alias("s")
    )
    return inner.union(square).agg(F.sum("s").alias("s")).first()["s"] or 0.0


def _local_moving(links: DataFrame, state: DataFrame, total: float, resolution: float, seed: int) -> tuple[DataFrame, int]:
    """Moves nodes until no single move gains; the state and the number of steps that changed it.

    After a step only neighbours of moved nodes are looked at; when these have come to rest, all nodes
    are looked at again, as volumes have changed too, and the phase ends when none of them gains.
    """
    nodes, active, turn, steps = state.count(), None, 0, 0
    while True:
        turn += 1
        moves = _keep(_moves(links, state, total, resolution, seed * 1000 + turn, active))
        n = moves.count()
        if not n:
            if active is None:
                return state, steps
            active = None
            continue
        half = F.pmod(F.xxhash64("node", F.lit(seed), F.lit(turn)), F.lit(2)) == 0
        chosen = moves.filter(half) if n > FEW * nodes and n > 1 else moves
        if _rise(links, state, chosen, total, resolution) <= EPSILON:
            chosen = _keep(_apart(moves))
        changed = chosen.select("node", "to")
        state = _keep(
            state.join(changed, "node", "left").select("node", F.coalesce("to", "community").alias("community"), "degree")
        )
        steps += 1
        near = links.join(changed.select(F.col("node").alias("u")), "u", "left_semi").select(F.col("v").alias("node"))
        rest = moves.select("node").join(changed.select("node"), "node", "left_anti")
        active = near.union(rest).distinct()


def _refined(links: DataFrame, state: DataFrame, total: float, resolution: float) -> DataFrame:
    """(``node``, ``part``): connected parts of every community, grown from single nodes.

    A single node joins the neighbouring part of its community with the highest gain, if it gains and both are well
    connected to the rest of the community. Only single nodes move, and only to parts that stay, so parts are connected.
    """
    inside = state.select("node", "community", "degree")
    inner = _keep(
        links.filter(F.col("u") != F.col("v"))
        .join(inside.select(F.col("node").alias("u"), F.col("community").alias("cu")), "u")
        .join(inside.select(F.col("node").alias("v"), F.col("community").alias("cv")), "v")
        .filter("cu = cv").select("u", "v", "weight")
    )
    volumes = state.groupBy("community").agg(F.sum("degree").alias("all"))
    tied = inner.groupBy(F.col("u").alias("node")).agg(F.sum("weight").alias("ties"))
    enough = lambda ties, own: ties >= resolution * own * (F.col("all") - own) / total - EPSILON
    nodes = _keep(
        inside.join(volumes, "community").join(tied, "node", "left")
        .withColumn("good", enough(F.coalesce("ties", F.lit(0.0)), F.col("degree")))
    )
    parts = _keep(nodes.select("node", F.col("node").cast("string").alias("part")))
    while True:
        known = nodes.join(parts, "node")
        sizes = known.groupBy("part").agg(F.sum("degree").alias("volume"), F.count("*").alias("members"), F.max("all").alias("all"))
        of = parts.select(F.col("node").alias("v"), F.col("part").alias("to"))
        cross = inner.join(of, "v").join(parts.select(F.col("node").alias("u"), "part"), "u").filter("part <> to")
        outward = cross.groupBy("part").agg(F.sum("weight").alias("out"))
        goals = sizes.join(outward, "part").filter(enough(F.col("out"), F.col("volume"))).select(
            F.col("part").alias("to"), F.col("volume").alias("to_volume"), F.col("members").alias("to_members")
        )
        single = known.join(sizes.filter("members = 1").select("part"), "part", "left_semi").filter("good").select(
            F.col("node").alias("u"), "part", "degree"
        )
        value = F.col("shared") - resolution * F.col("degree") * F.col("to_volume") / total
        best = (
            cross.groupBy("u", "to").agg(F.sum("weight").alias("shared")).join(single, "u").join(goals, "to")
            .filter((F.col("to_members") > 1) | (F.col("to") < F.col("part")))
            .withColumn("value", F.round(value, 9)).filter(F.col("value") > EPSILON)
            .groupBy("u", "part").agg(F.min(F.struct((-F.col("value")).alias("neg"), "to")).alias("best"))
        )
        wanted = _keep(best.select(F.col("u").alias("node"), "part", F.col("best.to").alias("to")))
        moved = _keep(wanted.join(wanted.select(F.col("part").alias("to")), "to", "left_anti").select("node", "to"))
        if moved.isEmpty():
            return parts
        parts = _keep(parts.join(moved, "node", "left").select("node", F.coalesce("to", "part").alias("part")))


def _contract(links: DataFrame, parts: DataFrame) -> DataFrame:
    left = parts.select(F.col("node").alias("u"), F.col("part").alias("cu"))
    right = parts.select(F.col("node").alias("v"), F.col("part").alias("cv"))
    return (
        links.join(left, "u").join(right, "v")
        .groupBy(F.col("cu").alias("u"), F.col("cv").alias("v"))
        .agg(F.sum("weight").alias("weight"))
    )


def _pass(links: DataFrame, state: DataFrame, total: float, resolution: float, seed: int) -> tuple[DataFrame, bool]:
    """One pass over all levels from ``state``: (node, community) and whether anything changed."""
    changed, base = False, None
    while True:
        state, steps = _local_moving(links, state, total, resolution, seed)
        changed |= steps > 0
        named = state.select("node", "community")
        labels = named if base is None else base.join(named.withColumnRenamed("node", "part"), "part").select("node", "community")
        if state.select("community").distinct().count() == state.count():
            return _keep(labels), changed
        parts = _refined(links, state, total, resolution)
        merged = parts.filter(F.col("node").cast("string") != F.col("part")).isEmpty()
        if merged:
            return _keep(labels), changed
        upper = state.join(parts, "node").groupBy("part").agg(F.min("community").alias("community"), F.sum("degree").alias("degree"))
        base = _keep(parts if base is None else base.join(parts.select(F.col("node").alias("part"), F.col("part").alias("up")), "part").select("node", F.col("up").alias("part")))
        links = _keep(_contract(links, parts))
        state = _keep(upper.withColumnRenamed("part", "node"))
        seed += 1


def leiden_communities(edges: DataFrame, resolution: float = 1.0, seed: int = 42) -> DataFrame:
    """``(concept, community)``: the community is named by its smallest member.

    ``edges`` holds ``(a, b, weight)``. The same seed gives the same partition. At the end every community is connected and no
    node gains by moving to a neighbouring community or by leaving for one of its own. Edges without
    weight give no rows.
    """
    links = _keep(both_ways(edges))
    total = links.agg(F.sum("weight").alias("s")).first()["s"]
    if not total:
        return edges.select(F.col("a").alias("concept"), F.col("a").alias("community")).limit(0)
    degrees = links.groupBy(F.col("u").alias("node")).agg(F.sum("weight").cast("double").alias("degree"))
    state = _keep(degrees.select("node", F.col("node").cast("string").alias("community"), "degree"))
    while True:
        found, changed = _pass(links, state, float(total), resolution, seed)
        parts = connected_parts(edges, found)
        split = parts.select("community").distinct().count() > found.select("community").distinct().count()
        if not changed and not split:
            return parts.withColumnRenamed("node", "concept")
        state = _keep(parts.select("node", F.col("community").cast("string").alias("community")).join(degrees, "node"))
        seed += 101


def partition_report(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """What a partition ``labels`` (concept, community) is worth, per community.

    ``members``; ``inside``, the weight of its own edges; ``volume``, the sum of its members' degrees; ``quality``, its share of
    the resolution modularity; ``parts``, connected parts; ``gaining``, members that would gain by moving to a neighbouring
    community or by leaving for one of their own.
    """
    links = _keep(both_ways(edges))
    total = float(links.agg(F.sum("weight").alias("s")).first()["s"] or 1.0)
    degrees = links.groupBy(F.col("u").alias("node")).agg(F.sum("weight").cast("double").alias("degree"))
    named = labels.select(F.col("concept").alias("node"), "community")
    state = _keep(
        named.join(degrees, "node", "left")
        .select("node", F.col("community").cast("string").alias("community"), F.coalesce("degree", F.lit(0.0)).alias("degree"))
    )
    gaining = _moves(links, state, total, resolution, 0, None).groupBy("community").agg(F.count("*").alias("gaining"))
    ends = state.select("node", "community")
    inner = (
        links.join(ends.select(F.col("node").alias("u"), F.col("community").alias("cu")), "u")
        .join(ends.select(F.col("node").alias("v"), F.col("community").alias("cv")), "v")
        .filter("cu = cv").groupBy(F.col("cu").alias("community")).agg((F.sum("weight") / 2).alias("inside"))
    )
    whole = connected_parts(edges, ends).withColumnRenamed("community", "part").join(ends, "node")
    parts = whole.groupBy("community").agg(F.count_distinct("part").alias("parts"))
    sums = state.groupBy("community").agg(F.count("*").alias("members"), F.sum("degree").alias("volume"))
    none = {"inside": 0.0, "gaining": 0}
    both = sums.join(inner, "community", "left").join(parts, "community").join(gaining, "community", "left").fillna(none)
    share = 2 * F.col("inside") / total - resolution * F.pow(F.col("volume") / total, F.lit(2.0))
    return both.select("community", "members", "inside", "volume", share.alias("quality"), "parts", "gaining")
