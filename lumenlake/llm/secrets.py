"""Secret scans in SQL functions alone: three base patterns, and sliding-window entropy of candidate strings.

A match's place is not asked of the pattern engine: splitting a text at the matches of a pattern gives the
text between them, and the lengths of both in turn give every start and end, in code points.

A candidate is an unbroken run of token characters with a letter and a digit. Over each window of it the
Shannon entropy is kept by incremental counts: one character enters, one leaves, and only their terms of
the sum of n*log2(n) change. Each class of characters (hex digits alone, or all of them) has a threshold of its own.
Candidates on the allow-list (placeholders, UUIDs, plain counting) are suppressed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Kinds in the order in which ties at one start are listed. Fixed values.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_mixed")
HEX = r"[0-9a-f]{32,}+"
#: Characters that the secret of an assignment and an access key have at least.
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
#: Runs in which entropy is measured, characters in a window, and bits that a window must reach by class.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
WINDOW = 20
ENTROPY = {"entropy_hex": 3.0, "entropy_mixed": 3.8}
#: The characters that are counted, by class, and candidates that are no secrets.
ALPHABET = {"entropy_hex": "0123456789abcdef", "entropy_mixed": "+-/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"}
ALLOWED = (
    r"(?i)example|sample|placeholder|changeme|dummy|your[_-]|xxxx|"
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|01234567|abcdefgh"
)

_SPAN = "array<struct<start:int,order:int,end:int,kind:string,found:string>>"


def _span(start: Column, end: Column, kind: str, found: Column) -> Column:
    """A span; spans sort by start, then by kind as listed."""
    return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("order"), end.alias("end"), F.lit(kind).alias("kind"), found.alias("found"))


#: Matches whose places are summed up at a time; the sums over these blocks are summed up once more.
BLOCK = 64


def _found(text: Column, kind: str, pattern: str) -> Column:
    """All leftmost non-overlapping matches of ``pattern`` with their places, in one pass over its pieces.

    Places are running sums of lengths. They are taken within blocks and over blocks, so that no array grows by more than a block's
    matches or the count of blocks at a time, and the work follows the length of a text of matches alone.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    turns = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(matches)), matches, lambda gap, found: F.struct(F.length(gap).alias("gap"), found.alias("found")))
    none = F.array().cast(_SPAN)

    def in_blocks(turns: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(turns), F.lit(BLOCK)), lambda first: F.slice(turns, first, BLOCK))

    def step(so_far: Column, turn: Column) -> Column:
        start = so_far["at"] + turn["gap"]
        end = start + F.length(turn["found"])
        return F.struct(end.alias("at"), F.concat(so_far["spans"], F.array(_span(start, end, kind, turn["found"]))).alias("spans"))

    def walked(blocks: Column) -> Column:
        size = lambda block: F.aggregate(block, F.lit(0), lambda n, turn: n + turn["gap"] + F.length(turn["found"]))
        begins = lambda so_far, block: F.struct((so_far["at"] + size(block)).alias("at"), F.concat(so_far["begins"], F.array(so_far["at"])).alias("begins"))
        starts = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins")), begins, lambda so_far: so_far["begins"])
        spans = lambda block, at: F.aggregate(block, F.struct(at.alias("at"), none.alias("spans")), step, lambda so_far: so_far["spans"])
        return F.flatten(F.zip_with(blocks, starts, spans))

    once = lambda made, of: F.element_at(F.transform(F.array(made), of), 1)  # noqa: E731  (what is used twice is computed once)
    return F.when(text.rlike(pattern), once(turns, lambda t: once(in_blocks(t), walked))).otherwise(none)


def largest_entropy(text: Column, kind: str) -> Column:
    """The largest entropy in bits over the windows of ``text`` (of the whole, if shorter), of the class's characters."""
    letters = ALPHABET[kind]
    characters = F.split(text, "")
    width = F.least(F.length(text), F.lit(WINDOW))
    term = lambda n: F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(0.0)
    zero = ord("A")  # counts are kept as a string, a character each from A on: one is read and replaced by its place

    def slide(state: Column, character: Column) -> Column:
        at = state["at"] + 1
        came = F.instr(F.lit(letters), character)
        went = F.when(at > width, F.get(state["places"], at - width - 1)).otherwise(0)
        count = lambda place: F.ascii(F.substring(state["counts"], place, F.lit(1))) - zero
        changed = lambda counts, place, by: F.overlay(counts, F.char(count(place) + zero + by), place, F.lit(1))
        entered = F.when(came > 0, term(count(came) + 1) - term(count(came))).otherwise(0.0)
        left = F.when(went > 0, term(count(went)) - term(count(went) - 1)).otherwise(0.0)
        same = came == went
        total = F.when(same, state["total"]).otherwise(state["total"] + entered - left)
        added = F.when(came > 0, changed(state["counts"], came, 1)).otherwise(state["counts"])
        moved = F.when(went > 0, changed(added, went, -1)).otherwise(added)
        entropy = F.log2(width.cast("double")) - total / width
        return F.struct(
            at.alias("at"),
            state["places"].alias("places"),
            F.when(same, state["counts"]).otherwise(moved).alias("counts"),
            total.alias("total"),
            F.when(at >= width, F.greatest(state["best"], entropy)).otherwise(state["best"]).alias("best"),
        )

    places = F.transform(characters, lambda c: F.instr(F.lit(letters), c))
    start = F.struct(
        F.lit(0).alias("at"), places.alias("places"), F.lit("A" * len(letters)).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best")
    )
    return F.aggregate(characters, start, slide, lambda state: state["best"])


def _random(run: Column) -> Column:
    """A candidate run as an array of one span, or of none if it is allowed or not random enough."""
    found = run["found"]
    hexes = found.rlike("^[0-9A-Fa-f]+$")
    plausible = found.rlike("[0-9]") & found.rlike("[A-Za-z]") & ~found.rlike(ALLOWED)
    is_random = lambda kind, text: largest_entropy(text, kind) >= ENTROPY[kind]
    as_kind = lambda kind: F.array(_span(run["start"], run["end"], kind, found))
    return (
        F.when(~plausible, F.array().cast(_SPAN))
        .when(hexes & is_random("entropy_hex", F.lower(found)), as_kind("entropy_hex"))
        .when(~hexes & is_random("entropy_mixed", found), as_kind("entropy_mixed"))
        .otherwise(F.array().cast(_SPAN))
    )


def scan(docs: DataFrame, text: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """``docs`` with ``base`` and ``spans`` (or columns named otherwise): arrays of (start, order, end, kind, found), by start, then kind as listed.

    ``base`` has the matches of the three patterns, ``spans`` those and the random strings. Null and empty
    texts have none. Rows are independent; nothing is shuffled, and other columns stay as they were.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    assigned = F.filter(_found(whole, "assign", ASSIGN), lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= ASSIGN_LEAST)
    access = F.filter(_found(whole, "access", ACCESS), lambda s: s["end"] - s["start"] >= ACCESS_LEAST)
    random = F.flatten(F.transform(_found(whole, "entropy_hex", CANDIDATE), _random))
    extra = free_name(docs, "random")
    return (
        docs.withColumn(base, F.array_sort(F.concat(assigned, access, _found(whole, "hex", HEX))))
        .withColumn(extra, random)
        .withColumn(spans, F.array_sort(F.concat(base, extra)))
        .drop(extra)
    )


def listed(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def findings(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans (listed)."""
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).drop("text")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, KINDS[:3]), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``[kind]``; columns as before, ``n_chars`` (if there) made to fit.

    Overlapping spans become one, named after the first. Texts without secrets, null ones included, stay as they are.
    """
    text = F.col("text")

    def step(so_far: Column, s: Column) -> Column:
        apart = s["start"] >= so_far["at"]
        gap = F.substring(text, so_far["at"] + 1, s["start"] - so_far["at"])
        kept = F.when(apart, F.concat(so_far["kept"], F.array(gap, F.concat(F.lit("["), s["kind"], F.lit("]"))))).otherwise(so_far["kept"])
        return F.struct(F.greatest(so_far["at"], s["end"]).alias("at"), kept.alias("kept"))

    rest = lambda so_far: F.concat(F.array_join(so_far["kept"], ""), F.substring(text, so_far["at"] + 1, F.length(text)))
    base, spans = free_name(docs, "base"), free_name(docs, "spans")
    found = F.size(spans) > 0
    clean = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("kept")), step, rest)
    out = scan(docs, base=base, spans=spans).withColumn("text", F.when(found, clean).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(found, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
