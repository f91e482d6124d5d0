import random
import re

import numpy as np

from tessera.llm import knn, neardup


def col(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def shingles(text, n):
    w = re.findall("[a-z0-9_]+", text.lower())
    return set(zip(*(w[i:] for i in range(n)))) if len(w) >= n else {tuple(w)}


def brute(rows, n, threshold, least):
    rows = sorted({(i, t) for i, t in rows if i is not None and t is not None and len(re.findall("[a-z0-9_]+", t.lower())) >= least})
    out = set()
    for a, (i, x) in enumerate(rows):
        for j, y in rows[a + 1 :]:
            s, t = shingles(x, n), shingles(y, n)
            if i != j and len(s & t) >= threshold * len(s | t) - 1e-12:
                out.add((min(i, j), max(i, j)))
    return out


def corpus(seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        base = [r.choice(words) for _ in range(r.randint(20, 60))]
        rows.append((f"a{i:03d}", " ".join(base)))
        for j in range(r.randint(0, 4)):
            t = list(base)
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((f"b{i:03d}{j}", " ".join(t)))
    head = " ".join(words[:45])
    rows += [(f"c{i:03d}", head + " " + " ".join(r.choice(words) for _ in range(25))) for i in range(30)]
    return rows


EXTRA = [("n1", None), ("n2", ""), (None, "a b c"), ("n3", "one two"), ("n4", "One, TWO!"), ("a000", "another text of the same item " * 8), ("u1", "Ünï cödé " * 30), ("u2", "ünï cödé " * 30), ("long", "x" * 20000 + " y" * 30)]


def test_pairs_equal_brute_force(spark):
    """Pairs under a leader and pairs of a bucket, in one block or many, give all pairs."""
    rows = corpus() + EXTRA + corpus()[:5]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "chunk_id string, text string, bucket int")
    for size, threshold, least in ((3, 0.7, 20), (5, 0.8, 1)):
        want = brute(rows, size, threshold, least)
        found = neardup.find(df, shingle=size, threshold=threshold, min_words=least, word=neardup.CHUNK_WORD)
        for block_rows in (1024, 2):
            got = col(neardup.similar_pairs(found, block_rows), "chunk_id_a", "chunk_id_b")
            assert set(got) == want and len(got) == len(want)


def test_groups_are_components(spark):
    rows = corpus(2) + EXTRA
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    got = {}
    for r in neardup.groups(neardup.find(df, shingle=3, threshold=0.7, min_words=20, word=neardup.CHUNK_WORD)).collect():
        got.setdefault(r["group_id"], set()).add(r["item"])
    parent = {i: i for i, _ in rows if i}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in brute(rows, 3, 0.7, 20):
        parent[root(a)] = root(b)
    taking = {i for i, t in rows if i and t and len(re.findall("[a-z0-9_]+", t.lower())) >= 20}
    want = {}
    for i in taking - {"a000"}:  # that item has two texts and stands in two groups
        want.setdefault(root(i), set()).add(i)
    assert sorted(sorted(s - {"a000"}) for s in got.values() if s - {"a000"}) == sorted(map(sorted, want.values()))


def test_copies_at_any_size(spark):
    """All pairs of 65 and more copies, every near text linked with each; one row an item in the groups."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(f"h{i:03d}", text) for i in range(65)] + [("x", text + " more")] + [(f"o{i}", f"other {i} " * 20) for i in range(10)]
    found = neardup.find(spark.createDataFrame(rows, "chunk_id string, text string"), shingle=3, threshold=0.7, min_words=20)
    assert neardup.similar_pairs(found, 16).count() == 65 * 64 // 2 + 65
    g = neardup.groups(found)
    assert g.count() == 76 and g.select("group_id").distinct().count() == 11


def test_texts_of_one_template(spark):
    """Nearly equal texts stay in proportion: few pairs beside those with a leader are verified, and none is lost."""
    r = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    rows = [(f"t{i:04d}", " ".join(base[:60] + [f"n{i}"] + base[60:])) for i in range(400)] + [(f"s{i}", " ".join(r.choices(base, k=80))) for i in range(5)]
    found = neardup.find(spark.createDataFrame(rows, "chunk_id string, text string"), shingle=3, threshold=0.7, min_words=20)
    assert neardup.similar_pairs(found).count() == 400 * 399 // 2
    groups = sorted(r["count"] for r in neardup.groups(found).groupBy("group_id").count().collect())
    assert groups == [1] * 5 + [400]
    assert found.stars.count() < 400 * 12


def test_other_scripts(spark):
    """In general words are of any script."""
    a = "съешь ещё этих мягких французских булок да выпей же чаю"
    found = neardup.find(spark.createDataFrame([("a", a), ("b", a.upper()), ("c", "другой текст")], "chunk_id string, text string"))
    assert col(neardup.similar_pairs(found), "chunk_id_a", "chunk_id_b") == [("a", "b")]


def test_empty_pairs(spark):
    found = neardup.find(spark.createDataFrame([], "chunk_id string, text string"))
    assert neardup.similar_pairs(found).count() == 0 and neardup.groups(found).count() == 0


def test_super_minhash_estimates():
    """Signatures agree in about the similarity's share of slots; an element fills every slot by itself; equal sets agree."""
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = [a[:200], a[50:250], a[:200], a[:1]]
    e, o = np.concatenate(sets), np.repeat(np.arange(4), [len(s) for s in sets])
    s = neardup.super_minhash(e, o, 4, 160)
    assert (s[0] == s[2]).all() and (s < np.iinfo(np.uint64).max).all()
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.12
    # one element alone: its ranks are a permutation of the slots
    assert sorted((s[3] >> np.uint64(53)).tolist()) == list(range(160))


def exact(items, k):
    ids = sorted(items)
    x = np.array([items[i] for i in ids], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    out = {}
    for a, i in enumerate(ids):
        out[i] = [ids[b] for b in sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-s[a, b], ids[b]))[:k]]
    return out


def test_nearest_equals_brute_force_on_small_data(spark):
    """With few vectors every cell is seen: results are exact, ties by smaller id, copies and scaled vectors included."""
    rng = np.random.default_rng(1)
    good = {f"v{i:03d}": rng.normal(size=64).astype(np.float32).tolist() for i in range(120)}
    for i in range(12):
        good[f"w{i:03d}"] = good["v000"]
    good["s"] = (np.array(good["v001"], np.float32) * 4).tolist()
    bad = [("n1", None), ("n2", [0.0] * 64), ("n3", [1.0] * 63), ("n4", [float("nan")] * 64), (None, good["v003"]), ("n5", [None] * 64)]
    rows = list(good.items()) + bad + list(good.items())[:9]
    df = spark.createDataFrame([(i, v, "m", 1) for i, v in rows], "chunk_id string, vec array<float>, model string, rank int")
    got = {}
    for r in knn.nearest(df, k=5).orderBy("item", "rank").collect():
        got.setdefault(r["item"], []).append(r["neighbour"])
    assert got == exact(good, 5)
    pairs = set(col(knn.neighbour_pairs(knn.nearest(df)), "chunk_id_a", "chunk_id_b"))
    assert pairs == {tuple(sorted((i, j))) for i, js in got.items() for j in js}
    # small blocks, so that every cell is cut and queries cross blocks
    small = {}
    for r in knn.nearest(df, k=5, block_rows=7).orderBy("item", "rank").collect():
        small.setdefault(r["item"], []).append(r["neighbour"])
    assert small == got


def test_nearest_many_ties(spark):
    """More directions that tie than candidates: copies of other lengths, rounded in single precision, and ids in no order."""
    rng = np.random.default_rng(4)
    hot = rng.normal(size=64)
    ids = rng.permutation(300)
    good = {f"v{i:03d}": (hot * (0.5 + 0.013 * n) if n < 100 else hot + rng.normal(size=64) * (0.01 if n < 150 else 1)).astype(np.float32).tolist() for n, i in enumerate(ids)}
    df = spark.createDataFrame(list(good.items()), "chunk_id string, vec array<float>")
    for block_rows in (7, 4096):
        got = {}
        for r in knn.nearest(df, k=5, block_rows=block_rows).orderBy("item", "rank").collect():
            got.setdefault(r["item"], []).append(r["neighbour"])
        assert got == exact(good, 5)


def test_nearest_recall(spark):
    """Recall of at least 0.9 on uneven clusters when only part of the collection is seen."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 64))
    sizes = np.r_[[700], rng.integers(5, 60, 29)]
    x = np.concatenate([c + rng.normal(size=(n, 64)) * 0.4 for c, n in zip(centres, sizes)]).astype(np.float32)
    items = {f"i{i:05d}": v.tolist() for i, v in enumerate(x)}
    df = spark.createDataFrame(list(items.items()), "chunk_id string, vec array<float>")
    want = exact(items, 5)
    got = {}
    for r in knn.nearest(df, k=5, reach=16).collect():
        got.setdefault(r["item"], set()).add(r["neighbour"])
    hits = sum(len(got[i] & set(w)) for i, w in want.items())
    assert hits >= 0.9 * 5 * len(want)


def test_nearest_few(spark):
    schema = "chunk_id string, vec array<float>"
    assert knn.nearest(spark.createDataFrame([], schema)).count() == 0
    one = spark.createDataFrame([("a", [1.0] * 64)], schema)
    assert knn.nearest(one).count() == 0
    two = spark.createDataFrame([("a", [1.0] * 64), ("b", [1.0] * 64)], schema)
    assert col(knn.nearest(two), "item", "neighbour", "cosine") == [("a", "b", 1.0), ("b", "a", 1.0)]


def test_walk_is_sorted():
    """The heap passes cells in the order of summed distance, without empty ones, until enough entries are held."""
    rng = np.random.default_rng(3)
    a, b = rng.random(7), rng.random(9)
    counts = rng.integers(0, 3, 63)
    cells = knn.walk(a, b, counts, 10**9)
    sums = [a[c // 9] + b[c % 9] for c in cells]
    assert sums == sorted(sums) and sorted(cells) == np.nonzero(counts)[0].tolist()
    few = knn.walk(a, b, counts, 5)
    assert few == cells[: len(few)] and counts[few].sum() >= 5 > counts[few[:-1]].sum()
