"""SimHash and its links against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from finsearch.llm import components, queries, simhash


def plain_simhash(text, shingle=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    parts = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    votes = [0] * 64
    for part in parts:
        h = xxhash.xxh64_intdigest(part.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(parts))


def plain_components(prints, distance):
    """{print: smallest print reachable}."""
    every = np.array(sorted(set(prints)), dtype=np.uint64)
    label = list(range(len(every)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(every)):
        for j in np.nonzero(np.bitwise_count(every[i + 1 :] ^ every[i]) <= distance)[0]:
            a, b = root(i), root(i + 1 + int(j))
            label[max(a, b)] = min(a, b)
    return {int(every[i]): int(every[root(i)]) for i in range(len(every))}


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def near_prints(seed, centres=12, near=40):
    """Fingerprints with correlated bits, chains and dense groups around some centres."""
    rng = random.Random(seed)
    prints = [0, (1 << 64) - 1]
    for _ in range(centres):
        at = rng.getrandbits(64)
        if rng.random() < 0.5:
            at &= 0xFFFF0000FFFF0000
        for _ in range(near):
            prints.append(at)
            for _ in range(rng.randint(0, 5)):
                at ^= 1 << rng.randrange(64)
    return prints + [rng.getrandbits(64) for _ in range(300)]


@pytest.mark.parametrize("text", ["", " \n", "one", "One two", "A b c d e f", "É Ü é ü ß x", "a\x0bb\x0cc\td\r\ne", "a\x1fb c", "w " * 70_000, "x" * 100_000])
def test_fingerprint(text):
    assert simhash.simhash(text.encode(), 4) == signed(plain_simhash(text))


@pytest.mark.parametrize("distance,bucket", [(4, 16_384), (4, 3), (3, 16_384), (3, 4), (0, 16_384), (1, 2), (6, 8)])
def test_links_connect_what_all_pairs_connect(spark, distance, bucket):
    prints = near_prints(distance)
    frame = spark.createDataFrame([(signed(p),) for p in set(prints)], "fingerprint long").repartition(4)
    labels = {r["node"]: r["label"] for r in components.connected(simhash.links(frame, distance, bucket)).collect()}
    expected = plain_components(prints, distance)
    groups = {}
    for p, root in expected.items():
        groups.setdefault(root, set()).add(signed(p))
    for members in groups.values():
        assert {labels.get(m, m) for m in members} == {min(members)}


def test_thresholds_follow_the_principle():
    rng = np.random.default_rng(0)
    bits = (rng.random((5000, 64)) < 0.5).astype(float)
    bits[:, 1] = bits[:, 0]
    bits[:, 40] = bits[:, 0]
    both = bits.T @ bits
    order = simhash.grouped_bits(5000, both)
    assert sorted(order) == list(range(64))
    assert max(order.index(b) for b in (0, 1, 40)) - min(order.index(b) for b in (0, 1, 40)) == 2
    for rows in (10, 10**6, 10**10):
        scaled = both * (rows / 5000)
        for distance in range(7):
            parts = simhash.plan_probes(rows, scaled, distance)
            left_out = {i for i in range(64)} - {b for bits, _ in parts for b in bits}
            assert sum(t + 1 for _, t in parts) == distance + 1
            assert not left_out or len(parts) < distance + 1
    few, many = simhash.plan_probes(10**4, both * 2, 4), simhash.plan_probes(10**10, both * 2e6, 4)
    assert len(many) < len(few)  # larger tables want longer parts, probed with more masks


def test_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(400)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    rng = random.Random(1)
    rng.shuffle(chain)
    labels = {r["node"]: r["label"] for r in components.connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert labels == {i: 0 for i in range(401)} | {1000 + i: 1000 for i in range(50)}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def documents(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    base = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(20)]
    rows = [(i, text) for i, text in enumerate(base)]
    for i, text in enumerate(base):
        for c in range(3):
            copy = text.split()
            copy[rng.randrange(200)] = "changed"
            rows.append((100 + 10 * i + c, " ".join(copy)))
    rows += [(500, None), (501, ""), (None, base[3]), (None, "nobody knows this text"), (502, "twice the same"), (502, "twice the same")]
    rows += [(600 + i, "a hot text that many documents have in full") for i in range(300)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("mine"))


def test_components_and_representatives(spark):
    rows, docs = documents(spark)
    docs = docs.repartition(6)
    prints = [plain_simhash(t or "") for _, t in rows]
    root = plain_components(prints, 4)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    got = simhash.components(docs, 4, 4).collect()
    expected = sorted(((i if i is not None else -1, signed(p), least.get(root[p], -1)) for (i, _), p in zip(rows, prints)))
    assert sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in got) == expected
    kept = simhash.representatives(docs, 4, 4)
    assert kept.columns == docs.columns
    found = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect())
    assert found == sorted(least.get(r, -1) for r in set(root[p] for p in prints))
    assert simhash.components(docs.limit(0), 4, 4).count() == 0 and simhash.representatives(docs.limit(0), 4, 4).count() == 0


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    prints = {i: plain_simhash(t) for i, t in docs.items()}
    root = plain_components(prints.values(), 4)
    least = {}
    for i in sorted(docs, reverse=True):
        least[root[prints[i]]] = i
    rows = queries.QUERIES["op4_simhash_near_dedup"](spark, folder).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows} == {(i, f"{p:016x}", least[root[p]]) for i, p in prints.items()}
    assert len(rows) == len(docs)
