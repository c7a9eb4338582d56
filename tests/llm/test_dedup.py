"""Exact and near de-duplication, components and mixing against plain Python."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from data import documents, empty, lower_az, split_words, texts
from riskloom.llm import exact_dedup as exact
from riskloom.llm.components import components
from riskloom.llm.mixing import emit_copies, mix_sources
from riskloom.llm.simhash import Plan, bit_groups, cheapest, fingerprint_links, near_duplicates


@pytest.mark.parametrize("words", [1 << 20, 1])
def test_exact(spark, monkeypatch, words):
    monkeypatch.setattr(exact, "MOST_WORDS", words)  # one word: the filter is full, every row meets
    docs = documents(spark)
    got = exact.exact_dedup(docs).collect()
    groups = defaultdict(list)
    for r in docs.collect():
        groups[hashlib.sha256(lower_az(r.text).encode()).hexdigest()].append(r.doc_id)
    assert len(got) == docs.count() and sum(r.kept for r in got) == len(groups)
    for r in got:
        own = groups[r.text_sha256]
        best = max((k for k in own if k is not None), default=None)
        assert (r.keep_id, r.group_size) == (best, len(own)) and (not r.kept or r.doc_id == best) and r.size == (-1 if r.doc_id is None else r.doc_id)
    assert exact.exact_dedup(empty(spark)).collect() == []


def test_only_possible_repeats_meet(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.least("id", F.lit(3900)).cast("string")).alias("text"))
    out = exact.exact_dedup(docs)
    assert out.filter("kept").count() == 3901 and out.filter("group_size = 100").count() == 100


def fingerprint(text, shingle=4):
    words = split_words(lower_az(text))
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, distance):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_near(spark):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 500)}" for _ in range(400)]
    rows = texts() + [" ".join(base)] + [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in range(0, 400, 20)]
    docs = documents(spark, rows)
    got = sorted(near_duplicates(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    prints = [fingerprint(r.text) for r in got]
    assert [r.fingerprint for r in got] == [f"{p:016x}" for p in prints]
    root = roots(prints, 4)
    smallest, kept = {}, defaultdict(int)
    for r, k in zip(got, root):
        if r.doc_id is not None:
            smallest[k] = min(smallest.get(k, r.doc_id), r.doc_id)
        kept[k] += r.kept
    assert [r.component_id for r in got] == [smallest.get(k) for k in root]
    assert set(kept.values()) == {1} and max(root.count(k) for k in set(root)) > 5
    assert all(r.size == (-1 if r.doc_id is None else r.doc_id) for r in got)
    assert near_duplicates(empty(spark)).collect() == []


@pytest.mark.parametrize("cell_rows", [4096, 8])
def test_links_of_dense_and_sparse_values(spark, cell_rows):
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    values = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(300)}
    values |= {rng.getrandbits(64) for _ in range(700)} | {0, 1, (1 << 64) - 1, (1 << 64) - 3}
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    links = fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), 4, cell_rows)
    assert links.count() < 12_000  # a forest of each block, not all pairs
    got = {r.node: r.root for r in components(links).collect()}
    parts = defaultdict(set)
    for v in signed:
        parts[got.get(v, v)].add(v)
    want = defaultdict(set)
    for v, k in zip(signed, roots(values, 4)):
        want[k].add(v)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, want.values()))


def test_thresholds_lose_no_pair():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    bits = np.unpackbits(values.view(np.uint8), bitorder="little").reshape(-1, 64).astype(np.int64)
    for groups in (2, 3, 4, 5):
        parts = bit_groups(bits.T @ bits, len(values), groups)
        assert sorted(b for p in parts for b in p) == list(range(64))
        plan = Plan(parts, 4)
        plan.learn([np.bincount(rng.integers(0, 1 << len(b), 400), minlength=1 << len(b)) for b in plan.flat], 400)
        allowed = plan.thresholds(values)
        assert (allowed.sum(axis=1) == 4 - groups + 1).all() and allowed.min() >= -1


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path + star, "u long, v long")).collect()}
    assert len({got[i] for i in range(301)}) == 1 and len({got[1000 + i] for i in range(200)}) == 1 and len(set(got.values())) == 2
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def waterfill(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        level = (total - sum(2 * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in names if s not in capped))
        above = {s for s in names if s not in capped and weight[s] * level > 2 * sizes[s]}
        if not above:
            return {s: float(2 * sizes[s]) if s in capped else weight[s] * level for s in names}
        capped |= above


def test_mixing(spark):
    docs = documents(spark)
    got = mix_sources(docs).collect()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(split_words(r.text))
    target = waterfill(sizes)
    assert len(got) == docs.count()
    for r in got:
        rate = target[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert r.size == len(split_words(r.text)) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source]) and r.copies in (int(rate), int(rate) + 1) and r.taken == r.size * r.copies <= 2 * r.size
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(docs.repartition(3)).collect()))
    assert emit_copies(mix_sources(docs)).count() == sum(r.copies for r in got)
    assert mix_sources(empty(spark)).collect() == []


def test_mixing_meets_its_targets(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 7 % 4).cast("string")).alias("source"), F.lit("one two three").alias("text")
    )
    for r in mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect():
        assert r.taken == pytest.approx(r.target, rel=0.03)


def spread_plans(distance, rows, numbers):
    """Plans over ``rows`` evenly spread fingerprints."""
    plans = [Plan([list(map(int, p)) for p in np.array_split(np.arange(64), n)], distance) for n in numbers]
    for plan in plans:
        plan.learn([np.full(1 << len(bits), rows / (1 << len(bits))) for bits in plan.flat], rows)
    return plans


def test_parts_by_cost():
    sample = np.random.default_rng(5).integers(0, 1 << 63, 50).astype(np.uint64)
    probes = lambda plan: sum(len(cells) for cells, _ in plan.probes(sample)) / len(sample)
    two, three = spread_plans(4, 1 << 22, (2, 3))
    assert len(cheapest(spread_plans(4, 1 << 22, range(2, 6)), sample).parts) == 3
    assert probes(two) == 562 and 44 <= probes(three) <= 47
    with pytest.raises(ValueError):
        spread_plans(10, 1 << 22, (2,))[0].thresholds(sample)
    with pytest.raises(ValueError):
        cheapest(spread_plans(10, 1 << 22, (2,)), sample)
    assert (cheapest(spread_plans(10, 1 << 22, range(2, 12)), sample).thresholds(sample) >= 0).any()
