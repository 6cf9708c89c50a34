"""Links between the members of buckets, without all pairs inside a group, and connected groups of links."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import dropped, staged

#: Keys of at most this many rows of a few numbers (some MB) are sent to all tasks.
SENT_KEYS = 200_000
#: Members of an open bucket that meet in one task; a larger bucket is dealt out to several.
PER_TASK = 512
#: Rounds of further hubs at most, and pairs for each open member from which one is worth it.
HUB_ROUNDS, WORTH = 4, 16


class Finer(NamedTuple):
    """Keys that decide more sharply than buckets which ids can be a link.

    ``keys``, given a staged table (id), returns a staged table (id, key, cols) in which any two of these ids that are a
    link share a key, and ``near``, given the prefixes of the two sides' cols, holds for a link in one of its shared keys.
    """

    keys: Callable[[DataFrame], DataFrame]
    near: Callable[[str, str], Column]
    cols: list[str]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with u > v that connect the same ids as (a, b), without a join: each id keeps the edge to its smallest
    partner, and its other partners become edges between partners, of which equal ones are one row."""
    turned = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    least = turned.groupBy("u").agg(F.min("v").alias("m"), F.collect_set("v").alias("vs"))
    kept = least.select("u", F.col("m").alias("v"))
    more = least.select(F.explode("vs").alias("u"), F.col("m").alias("v")).where("u <> v")
    return kept.union(more).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id each node of the edges (a, b) can reach, by large-star and small-star rounds.

    The edges and labels stay in tables; only two numbers a round come to the driver. Nulls and loops are left out.
    """
    stars = staged(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    before = None
    while True:
        state = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = stars.union(stars.select("v", "u"))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = staged(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        dropped(stars)
        stars = following
    # the smallest id of a group is in no row as u
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component"))


def looked_up(table: DataFrame, keys: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """table joined with keys, a staged table; keys go to all tasks where they are few, else both sides are dealt out."""
    return table.join(F.broadcast(keys) if keys.count() <= SENT_KEYS else keys, on, how)


def relabelled(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The groups (id, component) after further links (a, b). Only the links' ends are moved, as edges between groups."""
    ends = links
    for end in ("a", "b"):
        ends = ends.join(groups.toDF(end, f"{end}_c"), end, "left").withColumn(end, F.coalesce(f"{end}_c", end)).drop(f"{end}_c")
    merged = components(ends.distinct())
    moved = groups.join(merged.toDF("component", "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    # ids that had no group, or were the smallest of theirs, and now have one
    fresh = merged.join(groups.select("id"), "id", "left_anti")
    return moved.unionByName(fresh)


def main_groups(sizes: DataFrame) -> DataFrame:
    """(key, n, n_main, main) of each key that has several groups: its size, and its largest group. sizes: (key, component, n)."""
    return (
        sizes.groupBy("key")
        .agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("m"), F.count("*").alias("groups"))
        .where("groups > 1")
        .select("key", "n", F.col("m.n").alias("n_main"), F.col("m.component").alias("main"))
    )


def across(left: DataFrame, allowed: Column, cols: list[str]) -> DataFrame:
    """Distinct pairs (a, b) of ids of one key and several groups that are allowed, a staged table.

    left: (key, id, component, n, main, cols), the members of the key. Those outside of its largest group meet all others,
    in as many tasks as the key has members.
    """
    parts = F.ceil(F.col("n") / PER_TASK)
    names = ["id", "component", *cols]
    x = left.where("component <> main").select(
        "key", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), *(F.col(c).alias(f"x_{c}") for c in names)
    )
    y = left.select(F.col("key").alias("y_key"), F.pmod(F.xxhash64("id"), parts).alias("y_part"), *(F.col(c).alias(f"y_{c}") for c in names))
    met = x.join(y, F.expr("key = y_key AND part = y_part AND x_component <> y_component") & allowed)
    return staged(met.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct(), "pairs")


def linked(
    heads: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    near: Callable[[str, str], Column],
    near_cols: list[str],
    finer: Finer | None = None,
) -> DataFrame:
    """(id, component) of all ids that links connect. heads: a staged table (id, keys, near_cols); ids may link that share a key.

    ``near``, given the prefixes of the two sides' near_cols, tells cheaply which pairs can't be links. ``verify`` takes
    a staged table of pairs (a, b) that are near and returns a staged table of those that are links. Every pair that
    shares a key is either near and verified, or lies inside one connected group already, so no link that would join two
    groups is missed:

    1. In each bucket the smallest id is a hub; each member is verified against it. A bucket of n gives n - 1 pairs.
       Buckets of two, most of all, are known from their smallest and largest id alone.
    2. A larger bucket whose members are then in several groups is open. Where its pairs across groups are many, the
       members outside of its largest group are verified against further hubs, picked by a hash from that group, round
       after round as long as that finds links: a group of drifting copies soon is one.
    3. All pairs left across groups have an end outside the bucket's largest group, so just these ends meet the members
       of other groups, dealt out to as many tasks as the bucket is large, and the join itself only lets near pairs out.
       With ``finer``, members of open buckets meet by its keys in place of the buckets': a group whose members are near
       each other without being links has few such pairs.
    """
    members = heads.select(F.explode("keys").alias("key"), "id")
    buckets = staged(
        members.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top"), F.count("*").alias("n")).where("hub < top"),
        "buckets",
    )

    def closest(pairs: DataFrame) -> DataFrame:
        """Distinct pairs (a, b) that are near."""
        both = pairs.select("a", "b").distinct()
        for end in ("a", "b"):
            both = both.join(heads.select(F.col("id").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in near_cols)), end)
        return staged(both.where(near("a_", "b_")).select("a", "b"), "pairs")

    def links_of(pairs: DataFrame) -> DataFrame:
        found = verify(pairs)
        dropped(pairs)
        return found

    two = buckets.where("n = 2").select(F.col("hub").alias("a"), F.col("top").alias("b"))
    keys = staged(buckets.where("n > 2").select("key", "hub"), "keys")
    larger = staged(looked_up(members, keys, "key"), "larger")

    def merged(groups: DataFrame | None, pairs: DataFrame) -> DataFrame:
        """The groups after the links among pairs. Each id meets one partner first; pairs that then lie in one group are done."""
        one = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        links = links_of(staged(one, "pairs"))
        found = components(links) if groups is None else staged(relabelled(groups, links), "groups")
        dropped(links)
        apart = pairs.join(one, ["a", "b"], "left_anti")
        for end in ("a", "b"):
            apart = looked_up(apart, found.toDF(end, f"{end}_c"), end, "left").withColumn(f"{end}_c", F.coalesce(f"{end}_c", end))
        apart = staged(apart.where("a_c <> b_c").select("a", "b"), "pairs")
        dropped(pairs)
        if apart.isEmpty():
            return found
        links = links_of(apart)
        following = staged(relabelled(found, staged(contracted(links).toDF("a", "b"), "links")), "groups")
        dropped(links, found)
        return following

    first = closest(two.union(larger.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))))
    groups = merged(None, first)
    dropped(buckets, keys)
    fruitful = True
    for done in range(HUB_ROUNDS + 1):
        labelled = looked_up(larger, groups, "id", "left").select("key", "id", "hub", F.coalesce("component", "id").alias("component"))
        sizes = staged(labelled.groupBy("key", "component").agg(F.count("*").alias("n")), "sizes")
        main = staged(main_groups(sizes), "main")
        dropped(sizes)
        crosses, n_open = main.agg(F.sum(F.col("n") * (F.col("n") - F.col("n_main"))), F.sum("n")).first()
        if not n_open:
            dropped(larger, main)
            return groups
        left = labelled.join(main, "key")
        outside = left.where("component <> main")
        if done == HUB_ROUNDS or crosses <= WORTH * n_open or not fruitful:
            break
        hubs = (
            left.where("component = main")
            .groupBy("key")
            .agg(F.min_by("id", F.xxhash64("id", F.lit(done))).alias("a"))
        )
        tried = closest(outside.where("id <> hub").join(hubs, "key").select("a", F.col("id").alias("b")))
        more = links_of(tried)
        fruitful = more.count() > n_open // 64
        following = staged(larger.join(main.select("key"), "key", "left_semi"), "larger"), staged(relabelled(groups, more), "groups")
        dropped(larger, groups, main, more)
        larger, groups = following

    if finer is None:
        extras = heads.select("id", "keys", *near_cols)
        # a hub has been verified against its whole bucket; a pair counts in one of the buckets that it shares
        allowed = F.expr("x_id <> x_hub AND y_id <> x_hub AND array_min(array_intersect(x_keys, y_keys)) = key") & near("x_", "y_")
        rest = across(left.join(extras, "id"), allowed, ["hub", "keys", *near_cols])
    else:
        ends = staged(left.select("id", "component").distinct(), "ends")
        fine = finer.keys(staged(ends.select("id"), "ids"))
        labelled = staged(fine.join(ends, "id"), "labelled")
        sizes = labelled.groupBy("key", "component").agg(F.count("*").alias("n"))
        finer_main = staged(main_groups(sizes), "main")
        rest = across(looked_up(labelled, finer_main, "key"), finer.near("x_", "y_"), finer.cols)
        dropped(fine, ends, labelled, finer_main)
        if not rest.isEmpty():
            rest = closest(rest)
    following = merged(groups, rest)
    dropped(larger, main, groups)
    return following
