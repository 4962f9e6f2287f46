import random

import numpy as np
import xxhash

from tradewell.llm import queries, simhash
from tradewell.llm.simhash import BKTree, fingerprint, keep_one, link_fingerprints, near_duplicates


def plain_fingerprint(text):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_classes(prints):
    """Least id reachable, over all pairs."""
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 4:
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    least = {}
    for i, (doc_id, _) in enumerate(prints):
        least.setdefault(root(i), []).append(doc_id)
    return [(doc_id, min((x for x in least[root(i)] if x is not None), default=None)) for i, (doc_id, _) in enumerate(prints)]


def test_query_equals_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = [(i, plain_fingerprint(t)) for i, t in docs]
    want = {i: (f"{fp:016x}", c) for (i, fp), (_, c) in zip(prints, plain_classes(prints), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op5_simhash(spark, sf).collect()} == want


def test_spark_hashes_shingles_alike(spark):
    text = "one two three four"
    h = spark.sql(f"select xxhash64('{text}') as h").first().h & (2**64 - 1)
    assert fingerprint("ONE  two\tthree\x0bfour ") == h


def test_tree_finds_all_within(spark):
    rng = random.Random(1)
    values = [rng.getrandbits(16) for _ in range(600)]
    tree = BKTree()
    for v in values:
        tree.add(v)
    for q in values[:80]:
        for radius in (0, 2, 4):
            want = {i for i, v in enumerate(values) if (v ^ q).bit_count() <= radius}
            assert set(tree.within(q, radius)) == want


def test_links_over_trees_of_bounded_size(spark):
    """Chains of clusters of near fingerprints, in more trees than one for each shard."""
    rng = random.Random(2)
    values = set()
    for _ in range(6):
        v = rng.getrandbits(64)
        for _ in range(60):
            values.add(v)
            for _ in range(rng.randint(1, 4)):
                v ^= 1 << rng.randrange(64)
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in link_fingerprints(df, 4, tree_rows=8).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    number = {v: i for i, v in enumerate(values)}
    up = list(range(len(values)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = root(number[a]), root(number[b])
        up[max(x, y)] = min(x, y)
    want = [c for _, c in plain_classes(list(enumerate(values)))]
    assert [root(i) for i in range(len(values))] == want


def test_odd_rows(odd, empty, clash):
    got = near_duplicates(odd).collect()
    rows = odd.collect()
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in rows]
    want = sorted(map(str, plain_classes(prints)))
    assert sorted(str((r.doc_id, r.component_id)) for r in got) == want
    assert sorted(map(str, near_duplicates(clash).collect())) == sorted(map(str, got))
    assert near_duplicates(empty).collect() == []


def test_one_row_of_each_group_stays(spark, odd, empty, clash):
    kept = keep_one(odd).collect()
    ids = [r.doc_id for r in kept]
    assert sorted(ids, key=str) == [1, 3, 6, 7, 8, 9, None]  # 2 is a copy of 1; 4 and 5 have no words, like 3
    assert keep_one(odd).columns == odd.columns
    assert keep_one(clash).columns == clash.columns and keep_one(clash).count() == 7
    assert keep_one(empty).collect() == []
    twice = spark.createDataFrame([(1, "a b c d e"), (1, "v w x y z"), (1, "v w x y z")], "doc_id long, text string")
    assert sorted(r.text for r in keep_one(twice).collect()) == ["a b c d e", "v w x y z"]
