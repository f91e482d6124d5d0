"""Near-duplicate texts: SuperMinHash signatures, banding, exact verification, union-find groups.

A text is its set of shingles (runs of consecutive words). SuperMinHash gives every shingle one random
permutation of the signature's slots and one random fraction a slot; a slot keeps the least
rank + fraction over the shingles. Ranks are dealt level by level for all shingles of a batch at
once, and a text is left as soon as each of its slots is filled: no later level can be smaller.
Slots are then used in disjoint bands; texts that agree on a band share a bucket and are candidates.

Texts with the same words are one class, kept once. In each bucket the least class leads: first every member is
verified against its leaders, work in proportion to the members. Two things follow without comparing the rest.
Groups: members that these links join are joined for good, so only pairs of a bucket that are still in different groups are
verified. Pairs: the Jaccard distance is a metric, so two members whose distances to one leader add up to no
more than the threshold allows are a link; the others of a bucket are verified. Neither loses a
link that a bucket shows, at any size, and there is no limit on a bucket.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import materialize, release
from .arrow import int_lists

#: Fixed value: what words of chunks are made of, in lower case; in general letters, marks and digits of any script.
CHUNK_WORD, WORD = "a-z0-9_", r"\p{L}\p{M}\p{N}_"
#: Rows of a band, and the chance that a pair at the threshold shares no band, which gives the number of bands: 40 at 0.7, 21 at 0.8.
BAND_ROWS, MISSED = 4, 2e-5
#: Texts whose words take part, and the similarity of a link: the general rule of five words and 0.8.
SHINGLE, THRESHOLD, MIN_WORDS = 5, 0.8, 1
#: Rows of one side of a group that meet the whole group in one task.
BLOCK_ROWS = 1024

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _times(n: int, m: np.uint64) -> np.uint64:
    return np.uint64(n * int(m) % 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def super_minhash(elements: np.ndarray, owner: np.ndarray, n_sets: int, slots: int) -> np.ndarray:
    """Signatures (n_sets x slots, uint64) of sets given by their elements' 64-bit hashes and the set of each.

    At level j the j-th slot of each element's permutation (Fisher-Yates, dealt lazily) gets the value
    j + fraction. The value is held as level * 2^53 + 53 random bits, so equality is exact. Sets whose
    slots are all filled after a level take no further part. Empty sets keep the greatest value.
    """
    greatest = np.iinfo(np.uint64).max
    signature = np.full(n_sets * slots, greatest, dtype=np.uint64)
    order = np.arange(len(elements))
    deal = np.tile(np.arange(slots, dtype=np.uint8), (len(elements), 1))
    empty = np.full(n_sets, slots)
    for level in range(slots):
        if not len(order):
            break
        random = mix(elements[order] ^ (_times(level + 1, _M2)))
        swap = level + ((random >> np.uint64(40)) % np.uint64(slots - level)).astype(np.int64)
        slot = deal[order, swap]
        deal[order, swap] = deal[order, level]
        deal[order, level] = slot
        value = (np.uint64(level) << np.uint64(53)) | (mix(random) >> np.uint64(11))
        np.minimum.at(signature, owner[order] * slots + slot, value)
        empty = (signature.reshape(n_sets, slots) == greatest).sum(1)
        order = order[empty[owner[order]] > 0]
    return signature.reshape(n_sets, slots)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket a band (n_sets x bands); the band's number is part of it."""
    out = np.empty((len(signature), bands), dtype=np.uint64)
    for b in range(bands):
        h = np.full(len(signature), _times(b + 1, _M3), dtype=np.uint64)
        for r in range(rows):
            h = mix(h ^ signature[:, b * rows + r])
        out[:, b] = h
    return out.view(np.int64)


def n_bands(threshold: float, rows: int) -> int:
    return max(1, math.ceil(math.log(MISSED) / math.log(1 - min(threshold, 1 - 1e-9) ** rows)))


def shingle_sets(word_lists: list[list[str]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each word list and their owners. A list shorter than ``size`` is one shingle of all its words."""
    import xxhash

    known: dict[str, int] = {}
    digest = xxhash.xxh64_intdigest
    for ws in word_lists:
        for w in ws:
            if w not in known:
                known[w] = digest(w)
    flat = np.fromiter((known[w] for ws in word_lists for w in ws), dtype=np.uint64)
    lengths = np.fromiter(map(len, word_lists), dtype=np.int64, count=len(word_lists))
    ends = np.cumsum(lengths)
    hashes, owners = [], []
    long = lengths >= size
    n = np.where(long, lengths - size + 1, 0)
    if n.sum():
        owner = np.repeat(np.arange(len(lengths)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends - lengths, n)
        h = np.zeros(len(at), dtype=np.uint64)
        for i in range(size):
            h = mix(h ^ flat[at + i])
        hashes.append(h)
        owners.append(owner)
    for i in np.nonzero(~long & (lengths > 0))[0]:
        h = np.zeros(1, dtype=np.uint64)
        for x in flat[ends[i] - lengths[i] : ends[i]]:
            h = mix(h ^ x)
        hashes.append(h)
        owners.append(np.array([i]))
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h, o = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[first], o[first]


@dataclass
class Found:
    """What is known after every member of a bucket met its leaders; ``vid`` numbers the classes.

    members: item, vid. signatures: vid, class_id, shingles, buckets. shared: bucket, vid, leader, n (members), of buckets of two
    and more. stars: a (leader), b, similarity: the verified links of leaders.
    """

    members: DataFrame
    signatures: DataFrame
    shared: DataFrame
    stars: DataFrame
    threshold: float


def classes(items: DataFrame, item: str, text: str, min_words: int, word: str = WORD) -> tuple[DataFrame, DataFrame]:
    """(item, class_id) of every row that takes part, and (class_id, words) of every class.

    A class is one sequence of words, named by 128 bits of its hash; null items and texts and texts of
    fewer than ``min_words`` words take no part. Repeated rows count once.
    """
    source = items.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("item IS NOT NULL AND text <> ''")

    def run(batches):
        import xxhash

        if "\\p" in word:
            import regex as engine
        else:
            import re as engine
        find, digest = engine.compile(f"[{word}]+").findall, xxhash.xxh3_128_hexdigest
        for batch in batches:
            keep, named, texts = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                found = find(t.lower())
                if len(found) >= max(1, min_words):
                    keep.append(i)
                    texts.append(" ".join(found))
                    named.append(digest(texts[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(named, pa.string()), pa.array(texts, pa.string())], names=["item", "class_id", "words"])

    named = materialize(source.mapInArrow(run, "item string, class_id string, words string"), "words")
    return named.select("item", "class_id").distinct(), named.groupBy("class_id").agg(F.first("words").alias("words"))


def signed(texts: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """class_id, shingles (array<long>, sorted), buckets (array<long>, one a band)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                lists = [t.split(" ") for t in part.column(1).to_pylist()]
                h, o = shingle_sets(lists, shingle)
                signature = _in_pieces(h, o, len(lists), bands * rows)
                counts = np.bincount(o, minlength=len(lists))
                buckets = pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * bands), pa.array(band_hashes(signature, bands, rows).reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), int_lists(h.view(np.int64), counts, pa.int64()), buckets], names=["class_id", "shingles", "buckets"])

    return texts.select("class_id", "words").mapInArrow(run, "class_id string, shingles array<long>, buckets array<long>")


def _in_pieces(h: np.ndarray, o: np.ndarray, n: int, slots: int, most: int = 200_000) -> np.ndarray:
    """Signatures with at most about ``most`` elements dealt at a time; a set larger than that is dealt in parts and the least values taken."""
    out = np.full((n, slots), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(h), most):
        part, owner = h[at : at + most], o[at : at + most]
        low, high = int(owner[0]), int(owner[-1]) + 1
        out[low:high] = np.minimum(out[low:high], super_minhash(part, owner - low, high - low, slots))
    return out


def blocked_pairs(rows: DataFrame, key: str, vid: str, keep: list[str], size: str = "n", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs a < b (of ``vid``) of rows with the same ``key``, and their ``keep`` columns as a_..., b_...; ``size`` is the key's number of rows.

    A large group is cut into blocks, each of which meets the whole group in a task of its own.
    """
    n_blocks = F.ceil(F.col(size) / block_rows).cast("int")
    a = rows.select(F.col(key).alias("_key"), F.pmod(F.xxhash64(vid, F.lit(3)), n_blocks).cast("int").alias("_block"), F.col(vid).alias("a"), *[F.col(c).alias(f"a_{c}") for c in keep])
    b = rows.select(F.col(key).alias("_key"), F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("_block"), F.col(vid).alias("b"), *[F.col(c).alias(f"b_{c}") for c in keep])
    return a.join(b, ["_key", "_block"]).where("a < b")


def verified(pairs: DataFrame, signatures: DataFrame, threshold: float) -> DataFrame:
    """a, b, similarity of the pairs of classes whose shingle sets reach ``threshold``."""
    sets = signatures.select("vid", "shingles")
    both = pairs.select("a", "b").join(sets.select(F.col("vid").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("vid").alias("b"), F.col("shingles").alias("sb")), "b")
    both = both.where(F.least(F.size("sa"), F.size("sb")) >= F.greatest(F.size("sa"), F.size("sb")) * F.lit(threshold) - F.lit(1e-9))
    common = F.size(F.array_intersect("sa", "sb"))
    similar = both.select("a", "b", common.alias("c"), (F.size("sa") + F.size("sb")).alias("s")).withColumn("similarity", F.col("c") / (F.col("s") - F.col("c")))
    return similar.where(F.col("similarity") >= F.lit(threshold) - F.lit(1e-12)).select("a", "b", "similarity")


def find(items: DataFrame, item: str = "chunk_id", text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, word: str = WORD, band_rows: int = BAND_ROWS) -> Found:
    """Classes, buckets and the links of their leaders, from which ``groups`` and ``similar_pairs`` go on.

    Null items and texts and texts below ``min_words`` take no part. An item with several texts is a
    member of several classes. Empty tables give empty results; further columns are ignored.
    """
    members, texts = classes(items, item, text, min_words, word)
    signatures = materialize(signed(texts, shingle, n_bands(threshold, band_rows), band_rows).withColumn("vid", F.monotonically_increasing_id()), "signatures")
    placed = signatures.select("vid", F.explode("buckets").alias("bucket"))
    leaders = placed.groupBy("bucket").agg(F.min("vid").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(placed.join(leaders, "bucket").select("bucket", "vid", "leader", "n"), "shared")
    led = shared.where("vid <> leader").select(F.col("leader").alias("a"), F.col("vid").alias("b")).distinct()
    stars = materialize(verified(led, signatures, threshold), "stars")
    numbered = materialize(members.join(signatures.select("class_id", "vid"), "class_id").select("item", "vid"), "members")
    return Found(numbered, signatures, shared, stars, threshold)


def class_links(found: Found, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """a, b: all pairs of classes at the threshold.

    Each class belongs to one leader that it has a link with, to a near one if it can. Pairs under one leader whose distances add up to at
    most 1 - threshold are links by the triangle inequality; all other pairs of a bucket are verified.
    """
    most = 1 - found.threshold - 1e-9
    far = F.col("similarity") < (1 + found.threshold) / 2
    best = found.stars.groupBy(F.col("b").alias("vid")).agg(F.min(F.struct(far.alias("far"), F.when(far, -F.col("similarity")).otherwise(0.0).alias("last"), F.col("a").alias("head"), (1 - F.col("similarity")).alias("distance"))).alias("s"))
    led = best.select("vid", "s.head", "s.distance")
    # a leader that has none itself is its own
    own = led.select(F.col("head").alias("vid")).distinct().join(led.select("vid"), "vid", "left_anti").select("vid", F.col("vid").alias("head"), F.lit(0.0).alias("distance"))
    homes = materialize(led.unionByName(own), "homes")
    near = (F.col("a_distance") + F.col("b_distance")) <= most
    sizes = homes.groupBy("head").agg(F.count(F.lit(1)).alias("n"))
    implied = blocked_pairs(homes.join(sizes, "head"), "head", "vid", ["distance"], block_rows=block_rows).where(near).select("a", "b")
    rows = found.shared.join(homes, "vid", "left").select("bucket", "vid", "n", F.coalesce("head", "vid").alias("head"), F.coalesce("distance", F.lit(0.0)).alias("distance"))
    # which leaders are no home says the leaders' own distances; a class without a home shares none
    asked = blocked_pairs(rows, "bucket", "vid", ["head", "distance"], block_rows=block_rows).where(~((F.col("a_head") == F.col("b_head")) & near)).select("a", "b").distinct()
    return implied.unionByName(verified(asked, found.signatures, found.threshold).select("a", "b"))


def similar_pairs(found: Found, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """chunk_id_a, chunk_id_b, smaller first, once each: every pair of items, copies among them, at any size of a class.

    The result has as many rows as there are pairs, which a class of n copies alone makes n (n - 1) / 2; ``groups`` gives the
    same in proportion to the items.
    """
    sizes = found.members.groupBy("vid").agg(F.count(F.lit(1)).alias("n"))
    inside = blocked_pairs(found.members.join(sizes.where("n > 1"), "vid"), "vid", "item", [], block_rows=block_rows).select("a", "b")
    links = class_links(found, block_rows)
    across = links.join(found.members.select(F.col("vid").alias("a"), F.col("item").alias("x")), "a").join(found.members.select(F.col("vid").alias("b"), F.col("item").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    rows = inside.unionByName(across).where("a <> b")
    return rows.select(F.least("a", "b").alias("chunk_id_a"), F.greatest("a", "b").alias("chunk_id_b")).distinct()


def forest(edges: DataFrame) -> DataFrame:
    """Union-find within each partition: its edges become (node, root), one row a node other than the root."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches):
        parent: dict = {}
        arrow = None

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            arrow = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        rows = [(x, root(x)) for x in list(parent)]
        rows = [(x, r) for x, r in rows if x != r]
        for at in range(0, len(rows), 50_000):
            part = rows[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], arrow), pa.array([r for _, r in part], arrow)], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """vid, root (the smallest of its component) of every node with a link.

    Union-find runs inside partitions, then large-star and small-star steps join the partial trees
    until nothing changes; each step is written and the one before deleted, and only a count is collected.
    """
    edges = materialize(forest(links.where("a <> b")), "forest")
    while True:
        # large star: of each node the larger neighbours go to its smallest neighbour or itself
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours go to the smallest
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = materialize(small, "trees")
        changed = new.join(edges, ["a", "b"], "left_anti").limit(1).count() + edges.join(new, ["a", "b"], "left_anti").limit(1).count()
        release(edges)
        edges = new
        if not changed:
            break
    return edges.select(F.col("a").alias("vid"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("vid"), F.col("b").alias("root")).distinct())


def groups(found: Found, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """item, class_id, group_id (the smallest class_id of the group): one row an item and class; a class without links is its own group.

    The leaders' links give a first grouping; of each bucket only pairs still in different groups are verified, which
    joins what the leaders left apart. In proportion to the items, however many texts are nearly alike.
    """
    first = materialize(components(found.stars), "first")
    tagged = materialize(found.shared.join(first, "vid", "left").select("bucket", "vid", F.coalesce("root", "vid").alias("root")), "tagged")
    mixed = tagged.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y").select("bucket", "n")
    open_pairs = blocked_pairs(tagged.join(mixed, "bucket"), "bucket", "vid", ["root"], block_rows=block_rows).where("a_root <> b_root").select("a", "b").distinct()
    tried = found.shared.select(F.col("leader").alias("a"), F.col("vid").alias("b")).distinct()
    more = materialize(verified(open_pairs.join(tried, ["a", "b"], "left_anti"), found.signatures, found.threshold), "more")
    # links between first groups, by their roots, and the groups that they join
    named = lambda c: first.select(F.col("vid").alias(c), F.col("root").alias(f"r{c}"))
    lifted = more.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).distinct()
    second = materialize(components(lifted).select(F.col("vid").alias("root"), F.col("root").alias("top")), "second")
    tops = found.signatures.select("vid", "class_id").join(first, "vid", "left").withColumn("root", F.coalesce("root", "vid")).join(second, "root", "left").select("vid", "class_id", F.coalesce("top", "root").alias("top"))
    names = tops.groupBy("top").agg(F.min("class_id").alias("group_id"))
    return found.members.join(tops.join(names, "top"), "vid").select("item", "class_id", "group_id")
