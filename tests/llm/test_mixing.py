"""Mixing: targets against the rule done step by step, the schedule's proportions, the pieces against the streams themselves."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenlake.llm import mixing
from lumenlake.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, source string, size long, target double, row string, slot long"


def step_by_step(sizes, weights=(5, 2, 1)):
    """Shares by weight; what is above twice the size is cut and dealt out again among the others."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    whole, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = whole - sum(2 * sizes[s] for s in full)
        among = sum(weight[s] for s in names if s not in full)
        target = {s: 2 * sizes[s] if s in full else left * weight[s] / among for s in names}
        above = {s for s in names if target[s] > 2 * sizes[s]}
        if not above:
            return target
        full |= above


def plain_mix(docs, targets):
    """Words taken of each document (by place in ``docs``): a source's shuffled stream, twice over, up to its target."""
    out = [0] * len(docs)
    for source, target in targets.items():
        own = [(hashlib.sha256(f"11:{'' if d is None else d}".encode()).hexdigest()[:16], (d is not None, d), len((t or "").encode().split()), n) for n, (d, t, s) in enumerate(docs) if s == source]
        left = round(target)
        for *_, size, n in sorted(own, key=lambda x: x[:3]) * 2:
            out[n] += min(size, left)
            left -= min(size, left)
    return out


DOCS = [(n, " ".join(f"w{k}" for k in range(n * 37 % 90)), f"s{n * n % 7}") for n in range(140)]
DOCS += [(500 + n, "a b\tc", None) for n in range(20)] + [(600, "only one", "tiny"), (601, None, "empty"), (602, " \n", "s1"), (603, "x " * 3000, "s1")]
ODD = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "no id here", "s"), (None, None, None), (4, "", ""), (5, "é ½\x0bß", ""), (6, "w " * 40_000, "long")]


@pytest.mark.parametrize("docs", [DOCS, ODD, [(1, None, "s"), (2, "", None)], []])
@pytest.mark.parametrize("block", [7, 4096])
def test_mix_equals_the_streams(spark, docs, block):
    df = spark.createDataFrame([(d, t, s, 1, 0.5, "r", 3) for d, t, s in docs], SCHEMA).repartition(3)
    pieces, rows = mixing.mix(df, block)
    taken = rows.join(pieces.groupBy("row").agg(F.sum("words").alias("taken")), "row", "left").fillna(0, ["taken"]).collect()
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len((t or "").encode().split())
    targets = step_by_step(sizes) if docs else {}
    wanted = [(d, len((t or "").encode().split()), sizes[s], n) for (d, t, s), n in zip(docs, plain_mix(docs, targets), strict=True)]
    assert sorted([(r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in taken], key=repr) == sorted(wanted, key=repr)
    for r in taken:
        assert r["target"] == pytest.approx(targets[r["source"]]) and r["taken"] <= 2 * r["size"]


@pytest.mark.parametrize("block", [11, 512])
def test_slots_are_whole_blocks_of_the_texts(spark, tmp_path, block):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, source string").repartition(2)
    df.write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    pieces, _ = mixing.mix(df, block)
    slots, text_of = defaultdict(list), {d: (t or "").encode().split() for d, t, _ in DOCS}
    for p in pieces.collect():
        slots[p["slot"]].append(p)
    source_of = {d: s for d, _, s in DOCS}
    written = {(r["slot"], r["offset"]): (r["doc_id"], r["text"]) for r in mixing.mixed_texts(df, pieces).collect()}
    full = Counter()
    for slot in slots.values():
        at = 0
        for p in sorted(slot, key=lambda p: p["offset"]):
            assert p["offset"] == at and source_of[p["doc_id"]] == source_of[slot[0]["doc_id"]]
            assert written.pop((p["slot"], at)) == (p["doc_id"], b" ".join(text_of[p["doc_id"]][p["first"] : p["first"] + p["words"]]).decode())
            at += p["words"]
        full[at == block] += 1
    assert not written and full[False] <= len(set(source_of.values()))  # only a source's last block is short


@pytest.mark.parametrize("blocks", [{0: 500, 1: 200, 2: 100}, {0: 1, 1: 9000, 2: 3, 3: 0, 4: 1}, {n: 1 + n % 5 for n in range(700)}])
def test_schedule(spark, blocks):
    slots = mixing.schedule(spark.createDataFrame([*blocks.items()], "source_id long, blocks long")).orderBy("slot").collect()
    ranks = defaultdict(list)
    for s in slots:
        ranks[s["source_id"]].append(s["rank"])
    assert {s: sorted(r) for s, r in ranks.items()} == {s: [*range(n)] for s, n in blocks.items() if n}
    assert len({s["slot"] for s in slots}) == len(slots)
    whole, seen = sum(blocks.values()), Counter()
    for k, s in enumerate(slots, 1):  # every beginning of the mix is in proportion
        seen[s["source_id"]] += 1
        if len(blocks) < 10 and k % 50 == 0:
            assert all(abs(seen[i] - k * n / whole) < 8 for i, n in blocks.items())


def test_points_are_those_of_the_golden_ratio():
    for k in (1, 2, 1000, 12345):
        assert k * mixing._PHI % mixing._WHOLE / mixing._WHOLE == pytest.approx(k * (5**0.5 - 1) / 2 % 1, abs=1e-9)


def test_no_regex_surprises(spark):
    text = "a\x1cb \x85c d\n\ne\x0bf\x0cg"
    df = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    assert mixing.taken(df).collect()[0]["size"] == len(re.findall("[^\\x20\\x09-\\x0D]+", text))


def test_op11_equals_sql(spark, sf_dir):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = sorted(map(tuple, QUERIES["op11_mixing"](spark, sf_dir).collect()))
    assert got == sorted(duckdb.sql(ORACLES["op11_mixing"]).fetchall())
