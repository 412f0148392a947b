"""Links and connected components at any group size, with DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import key_prefilter, materialize, scratch, without

#: Rows of a bucket on either side of one cell of its comparisons: a crowded bucket is dealt to many tasks, cell by cell.
CELL = 512
#: Rows of a bucket up to which all its pairs are compared at once, where ``sketches`` are given.
CROWDED = 128
#: Parts of a crowded bucket, told by a further key each, that a row is in before it is compared with the whole bucket.
PARTS = 2


def blocks_of(bits: int) -> tuple[tuple[int, int], ...]:
    """(first bit, width) of twice as many blocks of 64 bits as may differ: half of them agree, with 32 bits in all."""
    n = 2 * bits
    edges = [64 * k // n for k in range(n + 1)]
    return tuple((a, b - a) for a, b in zip(edges, edges[1:]))


def masks(bits: int) -> list[int]:
    """A mask per choice of half of the blocks: two fingerprints that differ in at most ``bits`` bits agree under one."""
    return [sum(((1 << width) - 1) << low for low, width in kept) for kept in combinations(blocks_of(bits), bits)]


def block_keys(items: DataFrame, bits: int) -> DataFrame:
    """``items`` once per choice of blocks, with the choice and its bits hashed into ``key``.

    Equal blocks give equal keys; other rows that get the same key are dropped when distances are verified.
    """
    listed = F.array(*(F.lit(m - (1 << 64) * (m >> 63)).cast("long") for m in masks(bits)))
    each = items.select("*", F.explode(listed).alias("mask"))
    return each.withColumn("key", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask")))).drop("mask")


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Connected components of ``edges(a, b)``: rows (id, root), one for each id that has an edge.

    Each round maps every node to its least neighbour (itself included) and contracts the edges. Ids should be in
    random order (hashes), so that a round shrinks any graph by a constant factor in expectation. A hub is
    combined before the shuffle, its edge rows are split by the adaptive skew join, and each round is
    written to the shared folder; nothing is collected.
    """
    with scratch(edges.sparkSession):
        todo = materialize(
            edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(),
            f"{label}-edges",
        )
        maps = []
        while not todo.isEmpty():
            both = todo.unionByName(todo.select(F.col("b").alias("a"), F.col("a").alias("b")))
            step = materialize(
                both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("to")), f"{label}-map"
            )
            maps.append(step)
            s, t = step.select(F.col("a"), F.col("to").alias("x")), step.select(F.col("a").alias("b"), F.col("to").alias("y"))
            todo = materialize(
                todo.join(s, "a").join(t, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
                f"{label}-edges",
            )

        def follow(found: DataFrame, step: DataFrame) -> DataFrame:
            step = step.select(F.col("a").alias("root"), "to")
            return found.join(step, "root", "left").select("id", F.coalesce("to", "root").alias("root"))

        first = (maps[0] if maps else todo.withColumnRenamed("b", "to")).select(F.col("a").alias("id"), F.col("to").alias("root"))
        return materialize(reduce(follow, maps[1:], first), f"{label}-roots", keep=True)


Side = Callable[[str], Column]


def _beside(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs (a, b) with the columns of a, and those of b in the struct ``other``."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    few = key_prefilter(items, "id", ids)
    other = few.select(F.col("id").alias("b"), F.struct(*items.columns).alias("other"))
    return pairs.join(few.withColumnRenamed("id", "a"), "a").join(other, "b")


def _across(crossed: DataFrame, payload: list[str], close: Column) -> DataFrame:
    """Rows with those of the same key that lie in another component, one of them not in the key's largest, and are close: as ``other``.

    ``crossed``: id, key, comp, largest, size, away (rows, and rows outside the largest component, of the key) and the payload. The
    comparisons of a key form a grid of cells of CELL x CELL rows at most, each a join key of its own, so a crowded key is spread over tasks.
    """
    cells = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "id"), F.ceil(F.col(n) / CELL))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / CELL) - 1))
    outside = crossed.where("comp <> largest").select("key", cells("away", 1).alias("i"), F.struct("id", "comp", *payload).alias("other"), "size")
    outside = outside.select("key", "i", every("size").alias("j"), "other")
    inside = crossed.select("id", "key", "comp", *payload, cells("size", 2).alias("j"), every("away").alias("i"))
    return outside.join(inside, ["key", "i", "j"]).where((F.col("other.comp") != F.col("comp")) & close)


def near_components(
    keyed: DataFrame,
    near: Callable[[Side, Side], Column],
    verify: Callable[[DataFrame, DataFrame | None], DataFrame] | None = None,
    items: DataFrame | None = None,
    label: str = "near",
    sketches: DataFrame | None = None,
    confirm: tuple[Callable[[Side, Side], Column], Callable[[Column, Column], Column]] | None = None,
    once: Callable[[Side, Side], Column] | None = None,
) -> DataFrame:
    """Components of the rows (id, key, ...) that link: they share a key, and ``near`` and ``verify`` hold.

    A row per item and key; ``id`` must be unique to an item and hash-like. ``near`` makes a condition on the other columns
    of two rows (it gets two functions from a name to a column); columns too wide to travel with every key are in ``items`` instead,
    by id. ``verify`` takes candidates (a, b), and rows whose ``id`` may be among later candidates, and returns the candidates that hold. Returns
    (id, root) for the ids that have a link.

    Exact, yet without all pairs of a crowded bucket: first every row of a bucket is compared with the bucket's
    least row only (of those, ``verify`` gets the closest one of an item, where ``confirm`` tells distances, else all: at most one a key), and components are formed; a link that this misses joins two
    different components, so at least one of its ends is outside the bucket's largest component. Those rows, and only those,
    are then compared with all rows of their bucket that belong to another component, in cells of bounded size. ``near`` is part of
    that join's condition, so pairs that fail it are never made.

    ``sketches`` (id, keys): all keys of an item. With them, all pairs of a bucket of up to CROWDED rows are compared at once, and the larger ones as above,
    but that rows are compared with one row each of some parts of the bucket too, before the rest is: what groups there are in it are hardly split by then.
    ``confirm`` (with a column ``weight`` in the rows): a distance of two rows, and
    a condition on a pair's weights summed over the keys that it shares, and its distance; in the larger buckets the weight is the number of keys
    shared, whether crowded or not, so that no pair is held to less than it shares. ``once``: holds under one of the keys that a pair
    shares only, so that the pair isn't made under each.
    """
    spark = keyed.sparkSession
    check = verify or (lambda pairs, later: pairs)
    payload = [c for c in (keyed if items is None else items).columns if c not in ("id", "key")]
    other = lambda c: F.col("other")[c]
    close, whole = near(F.col, other), False

    def pairs_of(beside: DataFrame, *ids: Column) -> DataFrame:
        """Distinct pairs (a, b, d) of the rows beside each other that are confirmed."""
        if not confirm:
            return beside.select(*ids, F.lit(0).alias("d")).distinct()
        distance, sound = confirm
        if whole:
            return beside.select(*ids, distance(F.col, other).alias("d")).distinct()
        each = beside.select(*ids, F.least("weight", "other.weight").alias("w"), distance(F.col, other).alias("d"))
        return each.groupBy("a", "b").agg(F.sum("w").alias("w"), F.min("d").alias("d")).where(sound(F.col("w"), F.col("d"))).drop("w")

    def shared(rows: DataFrame) -> DataFrame:
        """The rows of keys that several items have, each once."""
        keys = rows.groupBy("key").agg(F.min("id").alias("one"), F.max("id").alias("two")).where("one <> two").select("key")
        keys = materialize(keys, f"{label}-keys")
        return materialize(key_prefilter(rows, "key", keys).join(keys, "key", "left_semi").dropDuplicates(["key", "id"]), f"{label}-rows")

    def checked(pairs: DataFrame, name: str, later: DataFrame | None = None) -> DataFrame:
        return materialize(check(materialize(pairs, f"{label}-{name}"), later).select("a", "b"), f"{label}-{name}-links")

    def star_links(rows: DataFrame) -> DataFrame:
        """Links to the least row of a bucket."""
        if items is None:
            least = rows.groupBy("key").agg(F.min(F.struct("id", *payload)).alias("other"))
            stars = rows.join(least, "key").where((F.col("id") != F.col("other.id")) & close)
            stars = pairs_of(stars, F.col("id").alias("a"), F.col("other.id").alias("b"))
        else:
            least = rows.groupBy("key").agg(F.min("id").alias("b"))
            stars = materialize(rows.join(least, "key").where("id <> b").select(F.col("id").alias("a"), "b").distinct(), f"{label}-candidates")
            stars = _beside(stars, items).where(close).select("a", "b", F.lit(0).alias("d"))
        # where distances tell how likely a link is, one star an item is enough to begin with
        return checked(stars.groupBy("a").agg(F.min_by("b", F.struct("d", "b")).alias("b")) if confirm else stars, "stars")

    def among(rows: DataFrame, roots: DataFrame) -> DataFrame:
        """The rows with their component, ``comp``."""
        rows = rows.join(roots.withColumnRenamed("root", "comp"), "id", "left")
        return materialize(rows.withColumn("comp", F.coalesce("comp", "id")), f"{label}-placed")

    def part_links(rows: DataFrame) -> DataFrame:
        """Links across components to one row, another for each, of the parts of buckets that rows with one more key in common make up."""
        further = F.array_except("keys", F.array("key"))
        least = lambda salt: F.array_min(F.transform(further, lambda k: F.xxhash64(F.lit(salt), k)))
        slim = ["id", "comp", *(c for c in payload if c not in ("keys", "crowd"))]
        rows = rows.where(F.size("keys") > 1)
        each = reduce(DataFrame.unionByName, (rows.select(*slim, F.xxhash64("key", least(salt)).alias("part")) for salt in range(PARTS)))
        first = each.groupBy("part").agg(F.min_by(F.struct(*slim), F.xxhash64("part", "id")).alias("other"))
        # two rows of a part share two keys
        stars = each.join(first, "part").where((F.col("comp") != F.col("other.comp")) & near(F.col, other))
        return checked(pairs_of(stars, F.col("id").alias("a"), F.col("other.id").alias("b")), "parts")

    def rest_links(rows: DataFrame) -> DataFrame:
        """Links across the components that are known."""
        sizes = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
        mixed = sizes.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"), F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("size"), F.max("n").alias("most"))
        mixed = mixed.where("kinds > 1").select("key", "largest", "size", (F.col("size") - F.col("most")).alias("away"))
        mixed = materialize(mixed, f"{label}-mixed")
        crossed = key_prefilter(rows, "key", mixed).join(mixed, "key")
        if items is not None:
            crossed = materialize(crossed, f"{label}-crossed")
            crossed = crossed.join(key_prefilter(items, "id", crossed.select("id").distinct()), "id")
        across, carried = close & once(F.col, other) if once else close, payload
        if whole:
            # under the least of the crowded keys that it shares, and where both are outside the largest component from one side, a pair is made once
            crossed, carried = crossed.withColumn("out", F.col("comp") != F.col("largest")), [*payload, "out"]
            across = (~F.col("out") | (F.col("other.id") < F.col("id"))) & across & (F.col("key") == F.array_min(F.array_intersect("crowd", "other.crowd")))
        beside = _across(crossed, carried, across)
        return checked(pairs_of(beside, F.least("id", "other.id").alias("a"), F.greatest("id", "other.id").alias("b")), "rest")

    with scratch(spark):
        rows, links = shared(keyed), []
        if sketches is not None:
            crowds = materialize(rows.groupBy("key").count().where(F.col("count") > CROWDED).select("key"), f"{label}-crowds")
            every = without(rows, "key", crowds)
            rows = None if crowds.isEmpty() else key_prefilter(rows, "key", crowds).join(crowds, "key", "left_semi")
            if rows is not None:
                ids = materialize(rows.select("id").distinct(), f"{label}-crowded-ids")
                known = key_prefilter(sketches, "id", ids).join(ids, "id", "left_semi").dropDuplicates(["id"])
                crowd = rows.groupBy("id").agg(*(F.max(c).alias(c) for c in payload), F.collect_set("key").alias("crowd"))
                rows = materialize(crowd.join(known, "id").withColumn("key", F.explode("crowd")), f"{label}-crowded")
            beside = every.join(every.select("key", F.struct("id", *payload).alias("other")), "key").where((F.col("id") < F.col("other.id")) & close)
            links.append(checked(pairs_of(beside, F.col("id").alias("a"), F.col("other.id").alias("b")), "pairs", rows))
            if rows is not None and confirm:
                # what else the two share is known here, and part of the joins' condition
                payload += ["keys", "crowd"]
                distance, sound = confirm
                close = close & sound(F.size(F.array_intersect("keys", "other.keys")), distance(F.col, other))
                whole = True
        if rows is not None:
            links.append(star_links(rows))
            roots = components(reduce(DataFrame.unionByName, links), f"{label}-1")
            placed = among(rows, roots)
            if whole and not (found := part_links(placed)).isEmpty():
                links = [roots.select(F.col("id").alias("a"), F.col("root").alias("b")), found]
                roots = components(reduce(DataFrame.unionByName, links), f"{label}-parts")
                placed = among(rows, roots)
            links = [roots.select(F.col("id").alias("a"), F.col("root").alias("b")), rest_links(placed)]
            if links[-1].isEmpty():
                return materialize(roots, label, keep=True)
        return materialize(components(reduce(DataFrame.unionByName, links), f"{label}-2"), label, keep=True)


def within(bits: int) -> Callable[[Side, Side], Column]:
    return lambda a, b: F.bit_count(a("fp").bitwiseXOR(b("fp"))) <= bits
