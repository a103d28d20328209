"""Near-duplicate groups by pivot distance tables over sets of five-word shingles.

Two texts are near duplicates if their sets of shingles have a Jaccard similarity of at least 0.8, which for sets of
n and m shingles is to differ in at most (n + m) / 9. The number in which two sets differ is a metric, so its distances to pivots bound it:
it is at least the difference of two coordinates and at most their sum. The first pivot is the empty set (the coordinate is the size);
the others are sets of the table itself, as distances between unrelated texts all say the same. A set has coordinates for those pivots
alone that it may be like: of the sets that have a key in common the most central one, whose keys the most others have, is their pivot. Keys are
some of a set's shingles, such that no two similar sets are without a common one. Sets of n and m shingles, similar, have at least 4/5 of either in common. So of the shingles
in order of their hashes, up to n/5 more than those that one set may lack, at least n/5 (or m/5) are in the beginnings of both; what has fewer that are in any other
beginning has no like, and of the others the rarest are keys, as many as it takes to have one of the common ones among them.

Texts with equal sets are one from the start. The table decides what a set has to do with its pivots. Two sets of one pivot are compared
only if no coordinate that they share differs by more than the limit (windows), are linked without that if the sum of two coordinates allows it, and else by the sets themselves;
sets that are both linked to their pivot need neither. Pivots of up to 8 sets have their pairs looked up in the table at once. Those of more, if
their sets are then still of several components, are settled by what the sets differ from the pivot
in. If x is not similar to the pivot, a similar y
has about half of its difference in common with that of x, and any y all but m / 4 of it. Sets meet by the rarest shingles of their differences, as many as
that leaves; those that meet, are of different components and within the windows are compared, unless the place of the common one tells that too
few can follow. Own changes of a copy and the own parts of unlike texts
are the rarest, so hardly any set meets another in vain; within a component nothing is left to find. No link between sets
of one pivot is left out, however many it has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PLACE, Batches, as_bytes, checkpoint, stored, texts, without_rows
from .components import components

#: Words in a shingle, similarity in percent, sets of a pivot that are paired.
WORDS, SIMILAR, PAIRED = 5, 80, 8
#: Names of rows that are broadcast (of 24 bytes each).
SETS = 500_000


def shingle_hashes(text: bytes) -> np.ndarray:
    """Hashes of the different shingles in order. Words are as in ``simhash.fingerprints``; fewer than five make one shingle, none no shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(WORDS)), strict=False)) if len(words) >= WORDS else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, shingles), np.uint64, max(1, len(words) - WORDS + 1)))


def beginning(n: int) -> tuple[int, int]:
    """Of a set of ``n`` shingles: how many from the least hash on are its beginning, and how many at least of those are in the beginning of any similar set as well."""
    both = -(-SIMILAR * n // 100)  # in common with a similar set, whose size is at least that
    more = lambda k: max(1, k // 5)
    return n - both + more(n), more(both)


def _sketches(docs: DataFrame, row: Column) -> DataFrame:
    """doc_id, row, same (128 bits that stand for the set)."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            same = [xxhash.xxh3_128_digest(shingle_hashes(x).tobytes()) for x in as_bytes(batch.column("text"))]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "row": batch.column("row"), "same": pa.array(same, pa.binary())})

    return texts(docs, row.alias("row")).mapInArrow(run, f"doc_id long, row {PLACE}, same binary")


def _keys(docs: DataFrame, row: Column, alike: DataFrame) -> DataFrame:
    """key, id: of each set in ``alike`` (id, row) the shingles of which it has one in common with any similar set.

    The shingles that no other set has in its beginning come first and are only counted, then the rarest.
    """

    def run(batches: Batches) -> Batches:
        for batch in batches:
            sets = [*map(shingle_hashes, as_bytes(batch.column("text")))]
            sizes = [beginning(len(x)) for x in sets]
            begun = [x[:k].view(np.int64) for x, (k, _) in zip(sets, sizes, strict=True)]
            yield pa.record_batch({"row": batch.column("row"), "least": pa.array([least for _, least in sizes], pa.int32()), "begun": pa.array(begun, pa.list_(pa.int64()))})

    begun = texts(docs, row.alias("row")).mapInArrow(run, f"row {PLACE}, least int, begun array<long>")
    listed = F.broadcast(alike) if alike.count() <= SETS else alike
    rows = begun.join(listed.select("row", "id"), "row").select("id", "least", F.explode("begun").alias("key"))
    shared = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("n > 1")
    own = Window.partitionBy("id")
    ranked = shared.withColumn("rank", F.row_number().over(own.orderBy("n", "key"))).withColumn("many", F.count(F.lit(1)).over(own))
    return ranked.filter("rank <= many - least + 1").select("key", "id")


def _sets(docs: DataFrame, row: Column, wanted: DataFrame) -> DataFrame:
    """id, hashes: the shingle sets of the texts in ``wanted`` (id, row). Up to SETS names of rows are broadcast; more meet the texts by a shuffle."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            sets = [shingle_hashes(x).view(np.int64) for x in as_bytes(batch.column("text"))]
            yield pa.record_batch({"id": batch.column("id"), "hashes": pa.array(sets, pa.list_(pa.int64()))})

    wanted = checkpoint(wanted)
    listed = F.broadcast(wanted) if wanted.count() <= SETS else wanted
    return texts(docs, row.alias("row")).join(listed, "row").select("id", "text").mapInArrow(run, "id long, hashes array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose ``sets`` (id, hashes) are similar."""
    left = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    rows = pairs.join(left, "a").join(right, "b").withColumn("both", both)
    return rows.filter(100 * F.col("both") >= SIMILAR * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b")


def _within(distance: str | Column, n: str | Column, m: str | Column) -> Column:
    """Whether sets of ``n`` and ``m`` shingles that differ in so many are similar."""
    col = lambda x: (F.col(x) if isinstance(x, str) else x).cast("long")
    return (100 + SIMILAR) * col(distance) <= (100 - SIMILAR) * (col(n) + col(m))


def _window(of: str, n: str = "n", m: str = "m") -> Column:
    """Whether coordinates ``{of}_x`` and ``{of}_y`` of one pivot, and those of the empty set (sizes ``{n}``, ``{m}``), allow the similarity."""
    return _within(F.abs(F.col(f"{of}_x") - F.col(f"{of}_y")), n, m) & _within(F.abs(F.col(n) - F.col(m)), n, m)


def _entries(members: DataFrame) -> DataFrame:
    """pivot, id: which sets have a coordinate for which pivot, itself among them.

    ``members``: key, id. The pivot of all with one key is the one whose keys have the most members, of equals the smallest id.
    """
    counts = members.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    found = checkpoint(members.join(counts, "key"))
    weight = found.groupBy("id").agg(F.sum("members").alias("weight"))
    central = found.join(weight, "id").groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("top"))
    return found.join(central.select("key", (-F.col("top.minus")).alias("pivot")), "key").select("pivot", "id").distinct()


def _pivot_table(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """pivot, c (its shingles), id, n (shingles of the set: its distance to the empty set), d (distance to the pivot) for each of ``entries``."""
    of = lambda name, as_: sets.select(F.col("id").alias(name), F.col("hashes").alias(as_))
    rows = entries.join(of("pivot", "p"), "pivot").join(of("id", "x"), "id")
    rows = rows.select("pivot", F.size("p").alias("c"), "id", F.size("x").alias("n"), F.size(F.array_intersect("x", "p")).alias("both"))
    return rows.select("pivot", "c", "id", "n", (F.col("n") + F.col("c") - 2 * F.col("both")).alias("d"))


def _paired(table: DataFrame, paired: int) -> tuple[DataFrame, DataFrame]:
    """a, b: pairs of sets of one pivot that the window on it lets through and that are not both linked to it, of pivots with up to ``paired`` sets; and pivot, id of the other pivots."""
    sizes = table.groupBy("pivot").agg(F.count(F.lit(1)).alias("members"))
    rows = checkpoint(table.join(sizes, "pivot").withColumn("linked", _within("d", "n", "c")))
    few = rows.filter((F.col("members") > 2) & (F.col("members") <= paired) & (F.col("id") != F.col("pivot")))
    side = lambda of, id_, size: few.select("pivot", F.col("id").alias(id_), F.col("n").alias(size), F.col("d").alias(f"d_{of}"), F.col("linked").alias(f"linked_{of}"))
    pairs = side("x", "a", "n").join(side("y", "b", "m"), "pivot").filter((F.col("a") < F.col("b")) & ~(F.col("linked_x") & F.col("linked_y")) & _window("d"))
    return pairs.select("a", "b").distinct(), rows.filter(F.col("members") > paired).select("pivot", "id")


def _told(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that no pivot discards: a, b, linked (whether one links them). ``table`` is that of ``_pivot_table``."""
    involved = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    rows = table.join(involved, "id").groupBy("id").agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("pivot", "d"))).alias("row"))  # at most a pivot for each key
    side = lambda name, size, row: rows.select(F.col("id").alias(name), F.col("n").alias(size), F.col("row").alias(row))
    both = pairs.join(side("a", "n", "p"), "a").join(side("b", "m", "q"), "b")
    at = lambda pivot: (F.try_element_at("p", pivot), F.try_element_at("q", pivot))
    lower = lambda pivot: F.abs(at(pivot)[0] - at(pivot)[1])
    upper = lambda pivot: at(pivot)[0] + at(pivot)[1]
    any_ = lambda bound, default: lambda pivot: F.coalesce(_within(bound(pivot), "n", "m"), F.lit(default))
    both = both.filter(_within(F.abs(F.col("n") - F.col("m")), "n", "m") & F.forall(F.map_keys("p"), any_(lower, True)))
    return both.select("a", "b", F.exists(F.map_keys("p"), any_(upper, False)).alias("linked"))


def _linked(pairs: DataFrame, table: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that are similar: told by the pivots of ``table`` where these can, else by ``sets``."""
    told = checkpoint(_told(pairs, table))
    return told.filter("linked").select("a", "b").union(_verified(told.filter("not linked").select("a", "b"), sets))


def _unsettled(crowded: DataFrame, found: DataFrame) -> DataFrame:
    """center, id, component of the sets of pivots (``crowded``: pivot, id) that have several components (``found``)."""
    own = crowded.withColumnRenamed("pivot", "center").join(found.withColumnRenamed("vertex", "id"), "id", "left").select("center", "id", F.coalesce("component", "id").alias("component"))
    several = own.groupBy("center").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most").select("center")
    return own.join(several, "center")


def _across(members: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: all pairs of ``members`` (center, id, component) of one center (pivot) and different components that can be similar by what they differ from it in.

    With d shingles in the difference of a set of m from a center of c, a similar set that is not similar to the center has more than (9 d + c - m) / 18
    of these in its own difference, and any similar set at least d - m / 4. So one of the others must be common, and these are taken from the rarest on: those
    that no other member has come first and are only counted.
    """
    of = lambda name, as_: sets.select(F.col("id").alias(name), F.col("hashes").alias(as_))
    rows = members.join(of("center", "c"), "center").join(of("id", "x"), "id")
    differs = F.concat(F.array_except("x", "c"), F.array_except("c", "x"))
    rows = rows.select("center", "id", "component", F.size("x").alias("m"), F.size("c").alias("c"), differs.alias("differs")).withColumn("d", F.size("differs"))
    rows = rows.withColumn("outer", F.expr("9 * d > m + c"))  # not similar to the center; this and what follows are for a similarity of 0.8
    least = "greatest(1, d - m div 4)"  # in common with any similar set
    rows = rows.withColumn("as_x", F.expr(f"if(outer, d - {least} + 1, 0)")).withColumn("as_y", F.expr(f"d - greatest({least}, cast(floor((9 * d + c - m) / 18) as int) + 1) + 1"))
    shingles = rows.select("center", "id", "component", "m", "d", "as_x", "as_y", F.explode("differs").alias("shingle"))
    counts = shingles.groupBy("center", "shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    own = Window.partitionBy("center", "id")
    rare = shingles.join(counts, ["center", "shingle"]).withColumn("rank", F.row_number().over(own.orderBy("n", "shingle")) + F.col("d") - F.count(F.lit(1)).over(own))
    names = ["center", "shingle", "id", "component", "m", "d", "rank", "as_x", "as_y"]
    rare = checkpoint(rare.filter("rank <= greatest(as_x, as_y)").select(names))
    is_x, is_y = F.col("rank") <= F.col("as_x"), F.col("rank") <= F.col("as_y")
    by_component = rare.groupBy("center", "shingle", "component").agg(F.count(F.lit(1)).alias("n"), F.bool_or(is_x).alias("xs"), F.bool_or(is_y).alias("ys"))
    top = by_component.groupBy("center", "shingle").agg(F.max(F.struct("n", "component"))["component"].alias("top"), F.count(F.lit(1)).alias("several"), F.bool_or("xs").alias("xs"), F.bool_or("ys").alias("ys"))
    met = rare.join(top.filter("several > 1 and xs and ys").drop("several", "xs", "ys"), ["center", "shingle"])
    side = lambda rows, of: rows.select("center", "shingle", *(F.col(c).alias(f"{c}_{of}") for c in ("id", "component", "m", "d", "rank", "as_x")))
    apart = F.col("component") != F.col("top")  # those of the component that is there most often do not meet each other
    xs, ys = met.filter(is_x), met.filter(is_y)
    both = [(xs.filter(apart), ys), (xs.filter(~apart), ys.filter(apart))]
    # as many as are common follow the first common one at most; no later one has more after it, so this holds of none if not of the first
    can = F.expr("18 * (least(d_x - rank_x, d_y - rank_y) + 1) >= 9 * (d_x + d_y) - m_x - m_y")
    once = F.expr("as_x_y = 0 or d_x < d_y or (d_x = d_y and id_x < id_y)")  # of two that are both not similar to the center
    wanted = (F.col("component_x") != F.col("component_y")) & _window("d", "m_x", "m_y") & can & once
    rows = [side(x, "x").join(side(y, "y"), ["center", "shingle"]).filter(wanted) for x, y in both]
    return rows[0].union(rows[1]).select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def _grouped(docs: DataFrame, row: Column, paired: int) -> DataFrame:
    """doc_id, row, component of every document; component: a number of the group."""
    rows = checkpoint(_sketches(docs, row))
    # ids of sets are numbers of a written table, and so do not change
    alike = checkpoint(rows.groupBy("same").agg(F.min("row").alias("row")).withColumn("id", F.monotonically_increasing_id()))
    entries = checkpoint(_entries(checkpoint(_keys(docs, row, alike))))
    sets = checkpoint(_sets(docs, row, entries.select("id").distinct().join(alike.select("id", "row"), "id")))
    table = checkpoint(_pivot_table(entries, sets))
    pairs, crowded = _paired(table, paired)
    stars = table.filter((F.col("id") != F.col("pivot")) & _within("d", "n", "c")).select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
    links = checkpoint(stars.union(_linked(pairs, table, sets)))
    found = components(links)
    open_ = checkpoint(_unsettled(crowded, found))
    if not open_.isEmpty():
        more = checkpoint(_linked(_across(open_, sets), table, sets))
        found = components(links.union(more))
    groups = alike.join(found, alike["id"] == found["vertex"], "left").select("same", F.coalesce("component", "id").alias("component"))
    return rows.select("doc_id", "row", "same").join(checkpoint(groups), "same").select("doc_id", "row", "component")


def drop_near_duplicates(docs: DataFrame, paired: int = PAIRED) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, the one with the smallest doc_id; columns as before.

    Groups are what is reachable over pairs of similarity 0.8. Null ids come last; texts without words are one
    group. What is shuffled are row numbers, the beginnings of sets, distances, and the shingle sets of texts that share a pivot; whole texts only where the rows that
    go are too many to broadcast.
    """
    docs, row = stored(docs)
    rows = checkpoint(_grouped(docs, row, paired))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "row"))
    kept = rows.groupBy("component").agg(first.alias("first")).select(F.col("first.row").alias("row"))
    return without_rows(docs, row, rows.join(kept, "row", "left_anti"))
