"""The near_dedup stage against all pairs."""

import numpy as np
import pytest

from lumenlake.llm import near_dedup


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[k : k + 5]) for k in range(len(words) - 4)} or {" ".join(words)}


def wanted(texts):
    """Smallest id of each group reachable over pairs of similarity 0.8; ``texts`` by id."""
    sets, least = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                least[high] = low
    return sorted(i for i in texts if root(i) == i)


@pytest.mark.parametrize("paired", [1, 32])
def test_near_copies_go(spark, paired):
    random = np.random.default_rng(2)
    texts = {}
    for size in (40, 12, *[3] * 20):  # groups of near copies and of copies of these, similar to 0.8 and less
        words = [f"w{n}" for n in random.integers(0, 5000, 200)]
        for _ in range(size):
            own = list(words)
            for k in random.integers(0, 200, random.integers(0, 7)):
                own[k] = f"x{random.integers(0, 10**6)}"
            if random.random() < 0.2:
                words = own
            texts[len(texts)] = " ".join(own)
    ids = random.permutation(len(texts)).tolist()
    texts = {i: texts[n] for n, i in enumerate(ids)}
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(3)
    kept = sorted(r["doc_id"] for r in near_dedup.drop_near_duplicates(df, paired).collect())
    assert kept == wanted(texts) and len(kept) < len(texts) - 40


def test_near_dedup_of_odd_rows(spark):
    rows = [(4, None), (3, ""), (None, " "), (5, "one two"), (6, "ONE  two"), (None, "three"), (None, "three"), (7, "one two three")]
    kept = near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert kept.columns == ["doc_id", "text"]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(3, ""), (5, "one two"), (None, "three"), (7, "one two three")], key=repr)
    assert near_dedup.drop_near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_groups_lose_no_link(spark):
    """Copies of a text with ever more changes, copies of some of these, copies of copies, and texts that share a passage alone."""
    random = np.random.default_rng(3)
    fresh = lambda n: [f"w{x}" for x in random.integers(0, 10**9, n)]

    def changed(words, most):
        own = list(words)
        for k in random.integers(0, len(own), random.integers(0, most + 1)):
            own[k] = fresh(1)[0]
        return own

    base, passage = fresh(150), fresh(60)
    made = [changed(base, 9) for _ in range(220)]
    made += [changed(made[k], 2) for k in range(60)]  # copies of copies
    other = changed(base, 0)
    other[20:50] = fresh(30)  # another base within the same buckets
    made += [changed(other, 5) for _ in range(60)] + [[*fresh(int(random.integers(60, 120))), *passage] for _ in range(90)]
    texts = {int(i): " ".join(made[n]) for n, i in enumerate(random.permutation(len(made)))}
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(3)
    expected = wanted(texts)
    kept = sorted(r["doc_id"] for r in near_dedup.drop_near_duplicates(df).collect())
    assert kept == expected and len(expected) > 100


def at_the_limit(seed, texts, length, replaced):
    """Texts of one base in which a stretch of words at a random place is new: in the texts of many, similarity is just above or below the limit."""
    random = np.random.default_rng(seed)
    base, out = [f"w{x}" for x in random.integers(0, 10**9, length)], {}
    for n in range(texts):
        at = int(random.integers(0, length - replaced + 1))
        out[n] = " ".join([*base[:at], *(f"n{x}" for x in random.integers(0, 10**9, replaced)), *base[at + replaced :]])
    return out


@pytest.mark.parametrize(("texts", "length", "replaced"), [(300, 300, 26), (200, 200, 17), (250, 120, 9), (250, 120, 10), (250, 120, 11)])
def test_families_at_the_limit(spark, texts, length, replaced):
    made, wanted_ids = {}, []
    for seed in range(4):  # four families of different words in one table
        family = at_the_limit(seed + 10 * texts, texts, length, replaced)
        wanted_ids += [i + 10_000 * seed for i in wanted(family)]
        made |= {i + 10_000 * seed: t for i, t in family.items()}
    df = spark.createDataFrame([*made.items()], "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in near_dedup.drop_near_duplicates(df).collect()) == wanted_ids


def test_what_meets_in_large_buckets(spark):
    """Unlike texts with a passage in common, and copies with changes of their own, hardly meet; a text meets what is similar to it in what it differs."""
    random = np.random.default_rng(5)
    fresh = lambda n: [f"w{x}" for x in random.integers(0, 10**9, n)]
    hashed = lambda words: near_dedup.shingle_hashes(" ".join(words).encode()).view(np.int64).tolist()

    def across(sets, components):
        known = spark.createDataFrame([*enumerate(sets)], "id long, hashes array<long>")
        members = spark.createDataFrame([(0, n, c) for n, c in enumerate(components)], "center long, id long, component long")
        return near_dedup._across(members, known)

    passage, base = fresh(100), fresh(150)
    assert across([hashed([*fresh(int(random.integers(50, 120))), *passage]) for _ in range(200)], range(200)).count() == 0

    def changed(words, places):
        return [fresh(1)[0] if k in places else w for k, w in enumerate(words)]

    far = [changed(base, set(random.integers(0, 150, 6).tolist())) for _ in range(150)]
    near = [changed(base, set(random.integers(0, 150, 1).tolist())) for _ in range(150)]
    twin = changed(far[0], {3})
    sets = [hashed(x) for x in [base, *near, *far, twin]]
    found = {tuple(r) for r in across(sets, [0] * 151 + [*range(1, 152)]).collect()}
    assert (151, 301) in found and len(found) < 1500  # of 34,000


def test_pivots_tell_what_needs_no_comparison(spark, monkeypatch):
    """In groups of up to eight copies of a text the distances to pivots link all, and no two other sets are compared; a copy too far off is found through its likes."""
    random = np.random.default_rng(8)
    texts, compared = {}, []
    for _ in range(10):
        base = [f"w{x}" for x in random.integers(0, 10**9, 200)]
        for k in range(6):
            own = list(base)
            own[30 * k + 10] = f"n{random.integers(0, 10**9)}"  # any two copies have all but ten of 196 shingles in common
            texts[len(texts)] = " ".join(own)
    verified = near_dedup._verified

    def counted(pairs, sets):
        compared.append(pairs.count())
        return verified(pairs, sets)

    monkeypatch.setattr(near_dedup, "_verified", counted)
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in near_dedup.drop_near_duplicates(df).collect()) == wanted(texts) == [*range(0, 60, 6)]
    assert sum(compared) == 0  # 150 where all pairs of a bucket are compared


def test_pivot_table_against_sets(spark):
    """Coordinates are the numbers of shingles in which sets differ; pivots discard no similar pair and link no other."""
    random = np.random.default_rng(9)
    sets, ids = {}, range(60)
    for i in ids:
        if i % 12 == 0:
            base = set(random.integers(0, 2**62, int(random.integers(20, 60))).tolist())
        gone = int(random.integers(0, len(base) // 3))
        sets[i] = sorted([*base][gone:] + random.integers(0, 2**62, int(random.integers(0, 5))).tolist())
    known = spark.createDataFrame([*sets.items()], "id long, hashes array<long>")
    entries = spark.createDataFrame([(p, i) for p in ids for i in ids if p // 12 == i // 12 and p % 4 == 0 and p % 12 <= i % 12 + 4], "pivot long, id long")
    table = near_dedup._pivot_table(entries, known)
    differ = lambda a, b: len(set(sets[a]) ^ set(sets[b]))
    rows = table.collect()
    assert len(rows) == entries.count() and all((r["c"], r["n"], r["d"]) == (len(sets[r["pivot"]]), len(sets[r["id"]]), differ(r["pivot"], r["id"])) for r in rows)
    pairs = [(a, b) for a in ids for b in ids if a < b and a // 12 == b // 12]
    similar = {(a, b) for a, b in pairs if 9 * differ(a, b) <= len(sets[a]) + len(sets[b])}
    asked = spark.createDataFrame(pairs, "a long, b long")
    told = {(r["a"], r["b"]): r["linked"] for r in near_dedup._told(asked, table).collect()}
    assert {p for p, linked in told.items() if linked} < similar < set(told) and len(told) < len(pairs)
    assert {tuple(r) for r in near_dedup._linked(asked, table, known).collect()} == similar
