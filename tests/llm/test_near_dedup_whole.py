"""No similar pair is without a common key, whatever the texts are."""

import numpy as np

from lumenlake.llm import near_dedup


def without_bands(words, seed=11, bands=32, in_band=4):
    """``words`` with one changed in each band of seeded MinHash values of their shingles, so that no band is that of ``words``."""
    random = np.random.default_rng(5)
    seeds = np.random.default_rng(seed).integers(0, 2**64, (2, bands * in_band), dtype=np.uint64)

    def least(words):
        hashes = near_dedup.shingle_hashes(" ".join(words).encode())
        x = (hashes[:, None] ^ seeds[0]) * (seeds[1] | np.uint64(1))
        x ^= x >> np.uint64(32)
        return x.min(0).reshape(bands, in_band), hashes[x.argmin(0)].reshape(bands, in_band)

    old, shingle = least(words)
    at = {int(near_dedup.shingle_hashes(" ".join(words[k : k + 5]).encode())[0]): k for k in range(len(words) - 4)}
    own = list(words)
    for band in range(bands):
        if (least(own)[0][band] == old[band]).all():
            own[at[int(shingle[band][0])] + 2] = f"n{random.integers(0, 10**9)}"
    assert not (least(own)[0] == old).all(1).any()
    return own


def test_copies_whose_changes_hit_every_band(spark):
    """Long texts of similarity 0.8 and more that have none of 32 MinHash bands in common."""
    random = np.random.default_rng(4)
    texts = {}
    for k in range(0, 6, 2):
        words = [f"w{x}" for x in random.integers(0, 10**9, 2000)]
        own = without_bands(words)
        a, b = (set(near_dedup.shingle_hashes(" ".join(x).encode()).tolist()) for x in (words, own))
        assert 5 * len(a & b) >= 4 * len(a | b)
        texts |= {k: " ".join(words), k + 1: " ".join(own)}
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in near_dedup.drop_near_duplicates(df).collect()) == [0, 2, 4]


def test_similar_sets_have_a_key_in_common(spark):
    """Short and long texts of a few words each, so that many pairs are just at the limit and share most of what they share with others."""
    random = np.random.default_rng(7)
    texts = []
    for size in [*range(1, 40), *[60] * 20]:
        base = [f"w{x}" for x in random.integers(0, 60, size)]
        for _ in range(9):
            own = list(base)
            for k in random.integers(0, size, random.integers(0, 3)):
                own[k : k + 1] = [f"w{x}" for x in random.integers(0, 60, random.integers(0, 3))]
            texts.append(" ".join(own + base[: random.integers(0, 3)]))
    made = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    docs, row = near_dedup.stored(made)
    alike = docs.select("doc_id", row.alias("row")).withColumnRenamed("doc_id", "id")
    keys = {i: set() for i in range(len(texts))}
    for r in near_dedup._keys(docs, row, alike).collect():
        keys[r["id"]].add(r["key"])
    sets = [set(near_dedup.shingle_hashes(t.encode()).view(np.int64).tolist()) for t in texts]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert len(pairs) > 200 and all(keys[a] & keys[b] for a, b in pairs)
    assert sum(map(len, keys.values())) < sum(map(len, sets)) / 2
