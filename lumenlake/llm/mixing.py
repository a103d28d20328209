"""Sources mixed to target weights by a low-discrepancy schedule of equal-token blocks.

Every source's documents are shuffled (by a hash of seed and doc_id) into one stream of words, which goes on from its
beginning where it ends, and is cut into blocks of BLOCK words. A schedule has a slot per block. Slot k stands at the
golden-ratio point frac(k * phi), which falls into one of the intervals that the sources' shares make of the unit
interval: so any stretch of the schedule holds the sources in proportion, to within the logarithm of its length.
A source's slots are ranked, and slot number r takes its block r.

Points are exact: phi is the ratio of two neighbouring Fibonacci numbers, so that k * phi is whole-number arithmetic. After
a full period the points begin anew. Counts of slots differ from the wanted ones by that logarithm; slots of a source that has no block
left stay empty, blocks without a slot follow at the end. So each source gives exactly its target, rounded to words.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PLACE, Batches, as_bytes, checkpoint, stored, texts
from .sharding import prefix_sums

#: Weights of the sources in order, repeating; all targets by all sizes; a source's target by its size at most.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Words in a block, seed of the shuffle, slots that are ranked together.
BLOCK, SEED, CHUNK = 4096, 11, 4096
#: Sources that are broadcast; more are joined by a shuffle. Cells into which the unit interval is cut at least.
BROADCAST, CELLS = 20_000, 1024
#: Two neighbouring Fibonacci numbers whose product is a long.
_PHI, _WHOLE = 1_836_311_903, 2_971_215_073

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sizes`` (source, source_size) with source_id (by code point from 0, null last), weight and target (words, a double).

    The targets are ``share`` of all sizes by weight. None is above ``most`` times its source's size; what is
    cut off goes to the others by weight, and again, until none is above. That is one water level: sources in order of the level
    at which they are full stay below it until the rest of the sum fits the rest of the weights. Windows are over a row per source.
    """
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_id") % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("source_id", (F.row_number().over(in_order) - 1).cast("long")).withColumn("weight", weight)
    rows = rows.withColumn("cap", F.col("source_size") * most).withColumn("full_at", F.col("cap") / F.col("weight"))
    by_level, all_rows = Window.orderBy("full_at", "source_id"), Window.partitionBy()
    full = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.lit(share) * F.sum("source_size").over(all_rows) - full) / left)
    open_ = F.col("full_at") > F.col("level")
    rows = rows.withColumn("level", F.min_by(F.when(open_, F.col("level")), F.when(open_, F.col("full_at"))).over(all_rows))
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")))
    return rows.select("source", "source_id", "weight", "source_size", target.alias("target"))


def schedule(blocks: DataFrame) -> DataFrame:
    """slot, source_id, rank: which source each slot of the mix takes a block of, and its number there, from ``blocks`` (source_id, blocks).

    Each rank from 0 below ``blocks`` has exactly one slot.
    """
    spark = blocks.sparkSession
    upto = Window.orderBy("source_id").rowsBetween(Window.unboundedPreceding, -1)  # a row per source
    bounds = checkpoint(blocks.filter("blocks > 0").withColumn("low", F.coalesce(F.sum("blocks").over(upto), F.lit(0))))
    whole, sources = bounds.agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.count(F.lit(1))).first()  # one row
    if not whole:
        return spark.createDataFrame([], "slot long, source_id long, rank long")
    # the unit interval in cells: on average a slot meets one or two sources, however many and small they are
    cell = lambda v: F.floor(v * F.lit((sources + CELLS) / whole))
    cells = bounds.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("low") + F.col("blocks") - 1))))
    at = (F.col("id") % F.lit(_WHOLE)) * F.lit(_PHI) % F.lit(_WHOLE)
    slots = spark.range(0, whole).select(F.col("id").alias("slot"), F.least(F.floor(at * F.lit(whole / _WHOLE)), F.lit(whole - 1)).alias("v"))
    met = slots.withColumn("cell", cell(F.col("v"))).join(cells, "cell").filter("v >= low and v < low + blocks")
    met = checkpoint(met.select("slot", "source_id", "blocks", F.expr(f"slot div {CHUNK}L").alias("chunk")))
    counts = met.groupBy("source_id", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("source_id", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source_id", "chunk").orderBy("slot")
    ranked = met.join(before, ["source_id", "chunk"]).withColumn("rank", F.col("before") + F.row_number().over(inside) - 1)
    got = counts.groupBy("source_id").agg(F.sum("n").alias("got"))
    short = bounds.join(got, "source_id", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < blocks")
    last = short.select("source_id", "low", F.explode(F.sequence(F.col("got"), F.col("blocks") - 1)).alias("rank"))
    last = last.select((F.lit(whole) + F.col("low") + F.col("rank")).alias("slot"), "source_id", "rank")
    return ranked.filter("rank < blocks").select("slot", "source_id", "rank").unionByName(last)


def sized(docs: DataFrame, row: Column, seed: int = SEED) -> DataFrame:
    """doc_id, source, row, size (words of the whole text) with ``before`` and ``position`` in the order of the shuffled streams."""
    key = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 16)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    rows = texts(docs, F.col("source").cast("string").alias("source"), row.alias("row")).select("doc_id", "source", "row", size, key.alias("key"))
    return checkpoint(prefix_sums(rows, ["source", "key", "doc_id", "size", "row"], "size").drop("key"))


def _by_source(rows: DataFrame, sources: DataFrame, count: int) -> DataFrame:
    return rows.join(F.broadcast(sources) if count <= BROADCAST else sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])


def mix(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mix as pieces of documents, and the documents.

    Pieces: slot, offset (words before it in its slot), doc_id, row (which document, as in ``stored``), first (its first word there), words. In
    order of slot and offset they are the mix. Documents: doc_id, source, row, size, source_size, target. Null and empty texts have no
    words and are in no piece; null is a source like any other, the last one. Rows of equal doc_id are shuffled by size and place. No rows, or
    none with words, give no pieces. The same table gives the same mix, whatever its partitions.
    """
    docs, row = stored(docs)
    rows = sized(docs, row, seed)
    streams = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("before").alias("begins"))  # a row per source
    targets = source_targets(streams.select("source", "source_size")).join(streams.select(F.col("source").alias("named"), "begins"), F.col("source").eqNullSafe(F.col("named"))).drop("named")
    sources = checkpoint(targets.withColumn("stop", F.round("target").cast("long")))
    count = sources.count()
    slots = schedule(sources.select("source_id", F.ceil(F.col("stop") / block).alias("blocks")))
    placed = _by_source(rows, sources, count)
    turns = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("stop") / F.col("source_size")).cast("int") - 1)))
    start = F.col("before") - F.col("begins") + F.col("turn") * F.col("source_size")
    spans = placed.filter("size > 0 and stop > 0").withColumn("turn", turns).withColumn("start", start)
    spans = spans.withColumn("end", F.least(F.col("start") + F.col("size"), F.col("stop"))).filter("end > start")
    pieces = spans.withColumn("rank", F.explode(F.expr(f"sequence(start div {block}L, (end - 1) div {block}L)")))
    low, high = F.greatest("start", F.col("rank") * block), F.least("end", (F.col("rank") + 1) * block)
    pieces = pieces.select("source_id", "rank", "doc_id", "row", (low - F.col("rank") * block).alias("offset"), (low - F.col("start")).alias("first"), (high - low).alias("words"))
    mixed = pieces.join(slots, ["source_id", "rank"]).select("slot", "offset", "doc_id", "row", "first", "words")
    return mixed, placed.select("doc_id", "source", "row", "size", "source_size", "target")


def mixed_texts(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """slot, offset, doc_id, text: the words of ``pieces`` (from ``mix`` of the same stored ``docs``), joined by one space.

    A document's pieces, at most in proportion to its length, are cut from it at once.
    """
    docs, row = stored(docs)
    listed = pieces.groupBy("row").agg(F.collect_list(F.struct("slot", "offset", "first", "words")).alias("pieces"))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            out = defaultdict(list)
            for doc, text, own in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), batch.column("pieces").to_pylist(), strict=True):
                words = text.split()
                for p in own:
                    for name, value in (("slot", p["slot"]), ("offset", p["offset"]), ("doc_id", doc), ("text", b" ".join(words[p["first"] : p["first"] + p["words"]]))):
                        out[name].append(value)
            kinds = {"slot": pa.int64(), "offset": pa.int64(), "doc_id": pa.int64(), "text": pa.binary()}
            made = {name: pa.array(out[name], kind) for name, kind in kinds.items()}
            yield pa.record_batch(made | {"text": made["text"].cast(pa.string(), safe=False)})

    return texts(docs, row.alias("row")).join(listed, "row").select("doc_id", "text", "pieces").mapInArrow(run, "slot long, offset long, doc_id long, text string")


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words the mix takes of each document, repeats counted; none for texts without words."""
    pieces, rows = mix(docs)
    words = pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    return rows.join(words, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


__all__ = ["PLACE", "mix", "mixed_texts", "schedule", "source_targets", "taken"]
