import random

import pytest
import xxhash
from pyspark.sql import functions as F

from posttide.llm import components, simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps):
    """Smallest position reachable, by comparing all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def near_texts(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}É" for i in range(400)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 40, 400, 900]))]
        texts.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append("\n".join(copy))
    return texts + [None, "", "  ", "one", "ONE", "one two", "x" * 3000, "a b c " * 900]


def test_equals_brute_force(documents):
    texts = near_texts()
    fps = [plain_fingerprint(t) for t in texts]
    expected = sorted((i, f"{fp:016x}", g) for i, (fp, g) in enumerate(zip(fps, plain_groups(fps))))
    got = simhash.near_duplicates(documents(list(enumerate(texts))))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect())) == expected


def test_spark_hash_agrees(documents):
    row = documents([(1, "a b c")]).select(F.xxhash64(F.lit("a b c"))).first()
    assert row[0] % (1 << 64) == int(next(simhash.shingle_hashes(b"A B c"))[0])


def test_every_small_difference_shares_a_key():
    for i in range(8):
        for j in range(i):
            for k in range(j):
                assert any(not {i, j, k} & set(s) for s in simhash.SETS)
    assert len(simhash.SETS) == 14


@pytest.mark.parametrize("long_list", [4096, 5])
def test_links_of_dense_groups(spark, long_list):
    rng = random.Random(long_list)
    fps = {0}
    for _ in range(6):
        center = rng.getrandbits(64)
        for _ in range(60):
            fp = center
            for _ in range(rng.randrange(6)):
                fp ^= 1 << rng.randrange(64)
            fps.add(fp)
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), long_list)
    found = {r.node: r.root for r in components.components(links).collect()}
    groups = plain_groups(fps)
    for i, (f,) in enumerate(signed):
        for j, (g,) in enumerate(signed[:i]):
            assert (found.get(f, f) == found.get(g, g)) == (groups[i] == groups[j])


def test_components_of_chain_star_and_ring(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 40)]
    links += [(200, 201), (201, 202), (202, 200), (300, 300), (400, None)]
    found = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    expected = {i: 100 for i in range(100, 161)} | {i: 5 for i in range(5, 40)} | {i: 200 for i in (200, 201, 202)}
    assert found == expected


def test_null_ids_repeated_rows_and_empty_table(documents):
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "only without an id"), (9, "else it is")]
    docs = documents(rows)
    got = sorted(simhash.near_duplicates(docs).select("doc_id", "component_id").collect(), key=str)
    assert got == sorted([(None, 4), (4, 4), (4, 4), (None, None), (9, 9)], key=str)
    kept = simhash.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.select("doc_id", "text").collect(), key=str) == sorted(
        [(4, "a b c d"), (None, "only without an id"), (9, "else it is")], key=str)
    empty = docs.where("doc_id < 0")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one_per_group(empty).count() == 0


def test_clashing_columns(documents):
    docs = documents([(1, "a b c"), (2, "A b c")]).withColumns({c: F.lit(7) for c in ("row", "id", "root", "c0", "key")})
    assert simhash.keep_one_per_group(docs).where("row = 7 and root = 7 and doc_id = 1").count() == 1
    with pytest.raises(ValueError):
        simhash.with_fingerprint(docs.withColumn("fp", F.lit(1)))


def test_millions_of_links_have_a_signature(spark):
    links = spark.range(3_000_000).select(F.col("id").alias("b"), (F.col("id") + 1).alias("a"))
    before = components._signature(links)
    assert before[0] == 3_000_000 and before == components._signature(links.repartition(3))
    assert before[1:] != components._signature(links.where("a <> 77").unionByName(links.limit(1)))[1:]
