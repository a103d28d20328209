"""The license scan against plain containment of every template in every text."""

import re
import time

import numpy as np

from lumenlake.llm import licenses
from lumenlake.llm.license_texts import TEMPLATES

FAMILY = {name: family for family, own in TEMPLATES.items() for name in own}


def shingles(text):
    words = [w for w in re.split(r"[^\w]+|_", text.lower()) if w]
    return [" ".join(words[k : k + 5]) for k in range(len(words) - 4)] or ([" ".join(words)] if words else [])


SETS = {name: set(shingles(text)) for own in TEMPLATES.values() for name, text in own.items()}


def wanted(text):
    """Names of the templates that ``text`` holds, by the definition of a match."""
    words = " ".join(w for w in re.split(r"[^\w]+|_", text.lower()) if w)
    there = set(shingles(text)) | {s for t in SETS.values() for s in t if len(s.split()) < 5 and f" {s} " in f" {words} "}
    fits, told = {}, set()
    for name, own in SETS.items():
        if len(own & there) >= 0.8 * len(own):
            fits[name] = len(own & there), len(own & there) / len(own)
            alone = own.difference(*(SETS[n] for n in SETS if n != name and FAMILY[n] == FAMILY[name]))
            told |= {name} if alone and 2 * len(alone & there) >= len(alone) else set()
    holds = lambda u, t: u != t and FAMILY[u] == FAMILY[t] and len(SETS[u] & SETS[t]) >= 0.8 * len(SETS[t])
    return {t for t in fits if t in told or not any(holds(u, t) and fits[u] > fits[t] for u in fits)}


def scanned(spark, texts):
    rows = licenses.scan(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()
    return {r["doc_id"]: {m["name"] for m in r["licenses"]} for r in rows}


def test_every_template_and_changed_copies(spark):
    """Copies whole and with words changed, added and left out, between other words: the same matches as by looking at every template."""
    random = np.random.default_rng(1)
    texts = {}
    for text in (t for own in TEMPLATES.values() for t in own.values()):
        for share in (0.0, 0.01, 0.03):
            words = []
            for w in text.split():
                chance = random.random()
                words += [] if chance < share / 3 else [f"w{random.integers(10**6)}"] if chance < share * 2 / 3 else [w, "added"] if chance < share else [w]
            texts[len(texts)] = " ".join([*(f"b{k}" for k in range(random.integers(0, 9))), *words, *(f"a{k}" for k in range(random.integers(0, 9)))])
    texts[len(texts)] = " ... ".join(t for own in TEMPLATES.values() for t in own.values())
    expected = {i: wanted(t) for i, t in texts.items()}
    assert scanned(spark, texts) == expected
    assert sum(map(len, expected.values())) > 2 * len(SETS)


def test_versions_are_told_apart(spark):
    found = scanned(spark, {
        1: TEMPLATES["gnu"]["gpl-3.0-or-later"], 2: TEMPLATES["gnu"]["lgpl-2.1-or-later"], 3: TEMPLATES["gnu"]["agpl-3.0-or-later"], 4: TEMPLATES["bsd"]["bsd-3-clause"], 5: TEMPLATES["bsd"]["bsd-2-clause"],
        6: TEMPLATES["gnu"]["gpl-2.0-grant"], 7: TEMPLATES["epl"]["epl-2.0"], 8: "GNU GENERAL PUBLIC LICENSE", 9: "all rights\nRESERVED", 10: None, 11: "", 12: "-- \n", 13: "overall rights reserved",
    })
    assert found == {
        1: {"gpl-3.0-or-later"}, 2: {"lgpl-2.1-or-later"}, 3: {"agpl-3.0-or-later"}, 4: {"bsd-3-clause"}, 5: {"bsd-2-clause"}, 6: {"gpl-2.0-grant"}, 7: {"epl-2.0"}, 8: set(),
        9: {"all-rights-reserved"}, 10: set(), 11: set(), 12: set(), 13: set(),
    }


def test_places_and_other_columns(spark):
    df = spark.createDataFrame([(1, "one two Released under the MIT License. and All rights reserved!", "x", 2)], "doc_id long, text string, words string, hits int")
    row = licenses.scan(df).first()
    assert [(m["name"], m["containment"], m["at"]) for m in row["licenses"]] == [("all-rights-reserved", 1.0, 8), ("mit", 1.0, 2)]
    assert (row["words"], row["hits"]) == ("x", 2)


def test_a_long_text_full_of_notices(spark):
    """The work follows the length of the text: a megabyte of notices takes seconds."""
    whole = " and ".join(t for own in TEMPLATES.values() for t in own.values())
    took = {}
    for size in (100_000, 1_000_000):
        df = spark.createDataFrame([(1, (whole * (size // len(whole) + 1))[:size])], "doc_id long, text string")
        found = licenses.findings(df)
        began = time.perf_counter()
        assert found.first()["n_licenses"] > 40
        took[size] = time.perf_counter() - began
    assert took[1_000_000] < 20 * max(took[100_000], 0.5)


def test_templates_from_files(spark, tmp_path):
    """Whole license texts of a folder; none of their shingles is lost in a copy."""
    body = " ".join(f"term{k % 997} of{k % 13} this{k % 7}" for k in range(3000))
    (tmp_path / "LONG").write_text(body)
    (tmp_path / "OTHER").write_text("quite another license of a few words more than any notice has so that windows hold it " * 3)
    templates = licenses.read_templates(spark, str(tmp_path))
    assert sorted(templates) == ["LONG", "OTHER"]
    df = spark.createDataFrame([(1, f"x {body} y"), (2, body[: len(body) // 2])], "doc_id long, text string")
    assert {r["doc_id"]: [m["name"] for m in r["licenses"]] for r in licenses.scan(df, templates).collect()} == {1: ["LONG"], 2: []}
