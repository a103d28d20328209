"""Near-duplicate groups by SimHash fingerprints and pivot distance tables.

A fingerprint's row of the pivot table holds its Hamming distances to reference fingerprints. A
distance to any reference changes by at most as much as two fingerprints differ, so a pair is discarded
as soon as one coordinate differs by more than the limit; pairs left are verified by their own distance.

The references come in two kinds. Those of a band (16 of the 64 bits) differ from the zero reference in that
band alone, so their coordinates, taken less the distance to zero, depend on that band alone: fingerprints at
most two bits apart agree in all coordinates of at least two of the four bands. Candidates come from the
table by windows of width zero on the coordinates of two bands. References spread over all bits then serve to
discard, by windows of width two.

A pair can also be accepted by the table alone: if two distances to one reference sum to two at most, so does
their own distance at most. In a bucket of many members this takes the place of pairs. The references are then the
members and the values one bit from a member, and of the table only the entries of at most one are written: two fingerprints are
at most two bits apart exactly if they share such a reference, and at most 65 can share one. So no group costs
more than in proportion to its size, and no link is lost.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, as_bytes, checkpoint, stored, texts_by_row, without_rows
from .components import components

#: Words in a shingle, seed of its hash, differing bits that still link, members of a bucket that are paired.
WORDS, SEED, BITS, PAIRED = 3, 42, 2, 32
BANDS, BAND_BITS = 4, 16
#: Band references: within each band, the lowest 1, 2, ..., 16 bits.
BAND_REFERENCES = [[((1 << j) - 1) << (BAND_BITS * b) for j in range(1, BAND_BITS + 1)] for b in range(BANDS)]
#: References over all bits: alternating runs of 1, 2, 4, ... bits, and products of two of these.
_WAVES = [sum(1 << i for i in range(64) if i >> k & 1) for k in range(6)]
SPREAD_REFERENCES = [*_WAVES, _WAVES[0] ^ _WAVES[3], _WAVES[1] ^ _WAVES[4]]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """doc_id, row (as in ``texts_by_row``), fingerprint (64 bits as a long) of every whole text.

    Words are what lies between ASCII white space, with A-Z in lower case; shingles are three words in a row,
    repeats counted; fewer words make one shingle, none (also null text) the fingerprint 0. A bit is set
    if it is set in over half the shingles' hashes.
    """

    def run(batches: Batches) -> Batches:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out = []
            for text in as_bytes(batch.column("text")):
                words = text.lower().split()
                if not words:
                    out.append(0)
                    continue
                shingles = map(b" ".join, zip(*(words[k:] for k in range(WORDS)), strict=False)) if len(words) >= WORDS else [b" ".join(words)]
                hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, max(1, len(words) - WORDS + 1))
                set_bits = np.zeros(64, np.int64)
                for k in range(0, len(hashes), 65_536):
                    part = hashes[k : k + 65_536]
                    set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                out.append(int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view("<i8")[0]))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "row": batch.column("row"), "fingerprint": pa.array(out, pa.int64())})

    rows, kind = texts_by_row(docs, row)
    return rows.mapInArrow(run, f"doc_id long, row {kind}, fingerprint long")


def _distance(x: Column, reference: int) -> Column:
    return F.bit_count(x.bitwiseXOR(F.lit(_signed(reference)).cast("long")))


def pivot_table(prints: DataFrame) -> DataFrame:
    """Adds ``bands`` (for each band a hash of its coordinates) and ``spread`` (eight distances, a byte each)."""
    x, zero = F.col("fingerprint"), F.bit_count(F.col("fingerprint"))
    bands = [F.xxhash64(F.lit(b), *(_distance(x, r) - zero for r in refs)) for b, refs in enumerate(BAND_REFERENCES)]
    spread = F.lit(0).cast("long")
    for k, r in enumerate(SPREAD_REFERENCES):
        spread = spread.bitwiseOR(F.shiftleft(_distance(x, r).cast("long"), 8 * k))
    return prints.withColumn("bands", F.array(*bands)).withColumn("spread", spread)


def _largest_difference(a: Column, b: Column) -> Column:
    byte = lambda x, k: F.shiftrightunsigned(x, 8 * k).bitwiseAND(F.lit(255))
    return F.greatest(*(F.abs(byte(a, k) - byte(b, k)) for k in range(len(SPREAD_REFERENCES))))


def links(prints: DataFrame, paired: int = PAIRED) -> DataFrame:
    """a, b: ids whose fingerprints are at most two bits apart, enough of them to join all that are.

    ``prints`` has an id (long) and a fingerprint, each fingerprint once.
    """
    two = [*combinations(range(BANDS), BANDS - BITS)]
    keys = F.array(*(F.xxhash64(F.lit(n), *(F.col("bands")[b] for b in pair)) for n, pair in enumerate(two)))
    rows = pivot_table(prints).select("id", "fingerprint", "spread", F.explode(keys).alias("key"))
    counts = checkpoint(rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"))
    rows = checkpoint(rows.join(counts, "key"))
    few = rows.filter(F.col("members") <= paired)
    left = few.select("key", F.col("id").alias("a"), F.col("fingerprint").alias("x"), F.col("spread").alias("p"))
    right = few.select("key", F.col("id").alias("b"), F.col("fingerprint").alias("y"), F.col("spread").alias("q"))
    near = (left["key"] == right["key"]) & (F.col("a") < F.col("b"))
    near &= _largest_difference(F.col("p"), F.col("q")) <= BITS
    near &= F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= BITS
    pairs = left.join(right, near).select("a", "b")
    many = rows.filter(F.col("members") > paired).select("id", "fingerprint").distinct()
    around = F.array(F.col("fingerprint"), *(F.col("fingerprint").bitwiseXOR(F.lit(_signed(1 << k)).cast("long")) for k in range(64)))
    hubs = many.select("id", F.explode(around).alias("hub")).groupBy("hub").agg(F.collect_list("id").alias("ids")).filter(F.size("ids") > 1)  # at most 65 ids
    stars = hubs.select(F.explode("ids").alias("a"), F.array_min("ids").alias("b")).filter("a <> b")
    return pairs.union(stars).distinct()


def _grouped(docs: DataFrame, paired: int, row: Column | None = None) -> DataFrame:
    """doc_id, row, fingerprint, component_id of every document."""
    rows = checkpoint(fingerprints(docs, row))
    prints = checkpoint(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("id")))
    found = components(links(prints.filter(F.col("id").isNotNull()), paired))
    named = prints.join(found, prints["id"] == found["vertex"], "left").select("fingerprint", F.coalesce("component", "id").alias("component_id"))
    return rows.join(checkpoint(named), "fingerprint")


def near_duplicates(docs: DataFrame, paired: int = PAIRED) -> DataFrame:
    """A row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links).

    Rows with a null doc_id link through the ids of equal fingerprints and name no component; where all ids of a
    fingerprint are null, so is the component. Repeated rows and equal texts share a fingerprint and so a
    component. No rows give none.
    """
    return _grouped(docs, paired).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, paired: int = PAIRED) -> DataFrame:
    """``docs`` with one row of each component, the first with the id that names it; columns as before.

    Rows without any id in their component are grouped by fingerprint. Only names of rows are shuffled, no texts.
    """
    docs, row = stored(docs)
    rows = checkpoint(_grouped(docs, paired, row))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "row"))
    group = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("alone")]
    kept = rows.groupBy(*group).agg(first.alias("first")).select(F.col("first.row").alias("row"))
    return without_rows(docs, row, rows.join(kept, "row", "left_anti"))
