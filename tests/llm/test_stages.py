"""Every pipeline stage on empty, null, repeated and clashing inputs."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, row string, shard int, hits string, words string, base string, spans string"
ROWS = [
    (1, "Hello world, this is a text about nothing at all.", "en"), (2, None, None), (3, "", "en"), (4, " \t\n", None), (5, "Hello  world, this is a text\nabout nothing at all.", "en"),
    (5, "Hello  world, this is a text\nabout nothing at all.", "en"), (None, "no id", "en"), (None, None, None), (6, "x" * 50_000, "en"), (7, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "en"),
]


@pytest.fixture(scope="module")
def stages():
    return pytest.importorskip("corpus_pipeline").STAGES


@pytest.fixture(scope="module")
def inputs(spark):
    odd = spark.createDataFrame([(i, t, lang, "s", len(t or ""), "r", 1, "h", "w", "b", "p") for i, t, lang in ROWS], SCHEMA)
    return {"odd": odd, "none": odd.limit(0)}


KEPT = {
    "toxicity": len(ROWS),  # nothing toxic
    "exact_dedup": 6,  # 1, 2 (with 3 and the null text), 4, no id, 6, 7
    "near_dedup": 5,  # 1 (with 5), 2 (texts without words), no id, 6, 7
    "secrets": len(ROWS),
}


@pytest.mark.parametrize("number", range(4))
def test_filtering_stages(spark, sf_dir, stages, inputs, number):
    name, stage = stages[number]
    for kind, docs in inputs.items():
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        rows = out.collect()
        assert len(rows) == (KEPT[name] if kind == "odd" else 0)
        assert {(r["row"], r["shard"], r["hits"], r["words"], r["base"], r["spans"]) for r in rows} <= {("r", 1, "h", "w", "b", "p")}


def test_packing_stage(spark, sf_dir, stages, inputs):
    name, stage = stages[4]
    assert name == "packing" and stage(spark, inputs["none"], sf_dir).count() == 0
    found = stage(spark, inputs["odd"], sf_dir).collect()
    assert {r["doc_id"] for r in found} == {i for i, *_ in ROWS} and all(len(r["ids"]) == r["length"] for r in found)
