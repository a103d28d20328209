"""License scans in SQL functions alone: MinHash bands over text windows retrieve templates, containment verifies.

Words are runs of letters and digits in lower case; shingles are five words in a row. Windows of 8 shingles that
begin at every fourth word of a text are compared with all windows of 8 shingles of the templates, by six MinHash bands
of one row each: the least and the greatest of three orders of the shingles' hashes. A window and a template's window
whose sets agree in a share s of their union have no band in common with probability (1-s)^6. A text that holds a
fifth-fold changed copy (0.8 of the shingles) has windows with s >= 2/3 however the changes lie, so that a template of 17
shingles (two such windows) is missed with probability below 2e-6 and one of 33 (six) below 3e-18; a stretch of 11 unchanged
shingles is never missed. For notices of up to 16 shingles the windows are single shingles, so that none is
missed; a notice of fewer than five words is one shingle of all of them and is sought as it is.

A retrieved template is a match if at least 0.8 of its shingles are, as strings, in the text. In a family of
templates (versions of a license, say) a match gives way to one that holds most of its shingles and has more of its own in the
text, unless half of the shingles that no other of the family has are there as well.

Everything about a document is in its own row: nothing is joined or shuffled. The work follows the length of the text.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name
from .license_texts import TEMPLATES

#: Words in a shingle, shingles in a window, its step in texts, shingles up to which a template is a notice.
WORDS, WINDOW, STEP, NOTICE = 5, 8, 4, 16
#: What the hashes are combined with for each order; the least and the greatest of each order are a band.
ORDERS = (0, 0x5555555555555555, 0x3C3C3C3C3C3C3C3C)
#: The containment that is a match, the share of own shingles that a match needs, and the share of a template that another one holds for it.
CONTAINED, OWN, HELD = 0.8, 0.5, 0.8

Templates = dict[str, dict[str, str]]


def read_templates(spark: SparkSession, folder: str) -> Templates:
    """Whole license texts from the text files of a folder, each a family of its own, named after its file. Texts come to the driver: a folder of licenses."""
    files = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1).alias("name"), "value")
    return {r["name"]: {r["name"]: r["value"]} for r in files.orderBy("name").collect()}


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """All shingles in order; a text of fewer words has one of all of them, one without words none."""
    whole = F.transform(F.sequence(F.lit(1), F.size(words) - WORDS + 1), lambda at: F.array_join(F.slice(words, at, WORDS), " "))
    none = F.array().cast("array<string>")
    return F.when(F.size(words) >= WORDS, whole).when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(none)


def in_order(hashes: Column, order: int) -> Column:
    return F.transform(hashes, lambda h: h.bitwiseXOR(F.lit(order)))


def bands_of(orders: list[Column], step: int) -> Column:
    """The bands of the windows that begin at every ``step``-th hash, from the columns of the hashes in each order. There are none in fewer than a window's hashes."""
    starts = F.sequence(F.lit(1), F.size(orders[0]) - WINDOW + 1, F.lit(step))
    ends = lambda w: F.array(F.array_min(w), F.array_max(w))
    window = lambda hashes: F.transform(starts, lambda at: F.slice(hashes, at, WINDOW))
    parts = [F.flatten(F.transform(window(hashes), ends)) for hashes in orders]
    return F.when(F.size(orders[0]) >= WINDOW, F.concat(*parts)).otherwise(F.array().cast("array<bigint>"))


def _template_table(spark: SparkSession, templates: Templates) -> list:
    """family, name, shingles, hashes and bands of each template that has words, by the same functions as for texts."""
    rows = [(family, name, text) for family, own in templates.items() for name, text in own.items()]
    df = spark.createDataFrame(rows, "family string, name string, text string").withColumn("words", words_of(F.col("text")))
    df = df.filter(F.size("words") > 0).withColumn("all", shingles_of(F.col("words"))).withColumn("ordered", F.transform("all", lambda s: F.xxhash64(s)))
    df = df.withColumn("shingles", F.array_distinct("all")).withColumn("hashes", F.array_distinct("ordered"))
    df = df.withColumns({f"order{k}": in_order(F.col("ordered"), order) for k, order in enumerate(ORDERS)})
    bands = F.array_distinct(bands_of([F.col(f"order{k}") for k in range(len(ORDERS))], 1))
    df = df.withColumn("bands", F.when(F.size("shingles") <= NOTICE, F.col("hashes")).otherwise(bands))
    return df.select("family", "name", "shingles", "hashes", "bands", F.size("words").alias("words")).orderBy("name").collect()  # the fixed list


_LISTED = "array<struct<name:string,bands:array<bigint>,shingles:array<string>,own:array<string>,held:array<string>>>"


def _literal(table: list) -> Column:
    """The templates as one literal: name, bands, shingles, own shingles, and the names of those of the family that hold most of it."""
    sets = {r["name"]: set(r["shingles"]) for r in table}
    family = {r["name"]: r["family"] for r in table}
    listed = []
    for r in table:
        others = [n for n in sets if n != r["name"] and family[n] == r["family"]]
        own = sets[r["name"]].difference(*(sets[n] for n in others))
        held = [n for n in others if len(sets[n] & sets[r["name"]]) >= HELD * len(r["shingles"])]
        listed.append({"name": r["name"], "bands": r["bands"], "shingles": r["shingles"], "own": sorted(own), "held": held})
    return F.from_json(F.lit(json.dumps(listed)), _LISTED)  # folded to a constant


_MATCHES = "array<struct<name:string,containment:double,at:int>>"


def scan(docs: DataFrame, templates: Templates | None = None) -> DataFrame:
    """``docs`` with ``licenses``: array<struct<name, containment, at>> by name; at: the word at which the first of the template's shingles that is there begins first.

    Null and empty texts, and texts without a notice, have an empty array. Equal matches of a family are all reported. Rows are
    independent; other columns stay, also those named like this operator's own.
    """
    table = _template_table(docs.sparkSession, templates or TEMPLATES)
    tiny = [r for r in table if r["words"] < WORDS]
    names = {n: free_name(docs, n) for n in ("words", "shingles", "hashes", "found", "known", "hits", *(f"order{k}" for k in range(len(ORDERS))))}
    words, shingles, hashes, found, known, hits, *orders = map(F.col, names.values())
    bands = sorted({b for r in table if r["words"] >= WORDS for b in r["bands"]})
    every = sorted({h for r in table for h in r["hashes"]})
    rows = docs.withColumn(names["words"], words_of(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    rows = rows.withColumn(names["shingles"], shingles_of(words)).withColumn(names["hashes"], F.transform(shingles, lambda s: F.xxhash64(s)))
    rows = rows.withColumns({names[f"order{k}"]: in_order(hashes, order) for k, order in enumerate(ORDERS)})
    whole = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    there = [F.when(F.contains(whole, F.lit(f" {r['shingles'][0]} ")), F.lit(r["hashes"][0])) for r in tiny]
    retrieved = F.concat(F.filter(hashes, lambda h: h.isin(bands)), F.filter(bands_of(orders, STEP), lambda b: b.isin(bands)), F.array_compact(F.array(*there)).cast("array<bigint>"))
    rows = rows.withColumn(names["found"], F.array_distinct(retrieved))
    of_template = F.filter(F.transform(shingles, lambda s: F.when(F.xxhash64(s).isin(every), s)), lambda s: s.isNotNull())
    present = [F.when(F.array_contains(found, r["hashes"][0]), F.lit(r["shingles"][0])) for r in tiny]
    texts = F.array_distinct(F.concat(of_template, F.array_compact(F.array(*present)).cast("array<string>")))
    rows = rows.withColumn(names["known"], F.when(F.size(found) > 0, texts))

    def hit(t: Column) -> Column:
        mine = F.array_intersect(t["shingles"], known)
        told = (F.size(t["own"]) > 0) & (F.size(F.array_intersect(t["own"], known)) >= OWN * F.size(t["own"]))
        first = F.array_position(shingles, F.get(mine, 0))
        at = F.when(first > 0, first - 1).otherwise(_first_word(words, F.get(mine, 0))).cast("int")
        share = F.when(F.arrays_overlap(t["bands"], found), F.size(mine) / F.size(t["shingles"])).otherwise(0.0)
        return F.struct(t["name"].alias("name"), share.alias("containment"), at.alias("at"), F.size(mine).alias("matched"), told.alias("told"), t["held"].alias("held"))

    listed = F.transform(_literal(table), hit)
    rows = rows.withColumn(names["hits"], F.when(F.size(found) > 0, F.filter(listed, lambda m: m["containment"] >= CONTAINED)))
    better = lambda u, m: (u["matched"] > m["matched"]) | ((u["matched"] == m["matched"]) & (u["containment"] > m["containment"]))
    kept = F.filter(hits, lambda m: m["told"] | ~F.exists(hits, lambda u: F.array_contains(m["held"], u["name"]) & better(u, m)))
    plain = F.transform(kept, lambda m: F.struct(m["name"].alias("name"), m["containment"].alias("containment"), m["at"].alias("at")))
    return rows.withColumn("licenses", F.coalesce(F.array_sort(plain), F.array().cast(_MATCHES))).drop(*names.values())


def _first_word(words: Column, shingle: Column) -> Column:
    """Where the words of a short ``shingle`` first follow each other, from 0."""
    before = F.call_function("substring_index", F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.concat(F.lit(" "), shingle, F.lit(" ")), F.lit(1))
    return F.length(F.regexp_replace(before, "[^ ]", ""))


def findings(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_licenses, licenses (names by comma), matches (name:containment:word by comma)."""
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).drop("text")
    told = F.transform("licenses", lambda m: F.concat_ws(":", m["name"], F.format_number(m["containment"], 3), m["at"].cast("string")))
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses.name", ",").alias("licenses"), F.array_join(told, ",").alias("matches")
    )


def template_names(templates: Templates | None = None) -> list[str]:
    return sorted(itertools.chain.from_iterable((templates or TEMPLATES).values()))
