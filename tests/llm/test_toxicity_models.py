"""Models of different tables in one session do not mix."""

import numpy as np

from lumenlake.llm import toxicity


def test_models_are_told_apart_by_all_counts_and_features():
    first, second = np.arange(27**3), np.arange(27**3)
    second[[0, 1]] = second[[1, 0]]
    assert first.sum() == second.sum()
    keys = {toxicity._digest(c, f) for c in (first, second) for f in (None, [], ["a", "b"], ["b", "a"], ["ab"])}
    assert len(keys) == 10


def test_two_tables_in_one_session(spark):
    """Texts with the letters of each word turned around have as many trigrams; each table is scored by its own model."""
    clean = [f"the {a} {b} walks home along the river bank" for a in ("old", "young", "tired", "happy") for b in ("man", "woman", "child", "farmer", "baker")]
    bad = [f"you are a {a} stupid idiot and a {b}" for a in ("very", "truly", "really", "so", "quite") for b in ("moron", "fool", "loser", "jerk")]
    turned = lambda ts: [" ".join(w[::-1] for w in t.split()) for t in ts]

    def scores(good, toxic):
        texts = good + toxic
        docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1)
        labels = spark.createDataFrame([(i, int(i >= len(good))) for i in range(len(texts))], "doc_id long, toxic int")
        return [r["score"] for r in toxicity.toxicity(docs, labels).orderBy("doc_id").collect()]

    one, other = scores(clean, bad), scores(turned(clean), turned(bad))
    again = scores(clean, bad)
    assert np.allclose(one, again, atol=1e-6)
    for found in (one, other):
        assert max(found[: len(clean)]) < 0.5 <= min(found[len(clean) :])
