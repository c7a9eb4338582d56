"""Collocations against a brute-force count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from data import empty, lower_az, texts
from riskloom.llm import collocations as module
from riskloom.llm.collocations import collocations


def brute(rows, least, covered=80, top=2000):
    counts = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower_az(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        inside = defaultdict(int)
        for p, c in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], c)
        rows_of = []
        for p, a in candidates.items():
            if inside[p] and 100 * inside[p] >= covered * a:
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows_of.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows_of)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def sample(seed=5, n=400):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["Être", "日本", "x,", "end.", "A\tb", "q!!"]
    rows = [(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25))), rng.choice(["en", "fr", None])) for _ in range(n)]
    rows += [("new york city hall is here", "en")] * 40 + [("the same pair", "en")] * 300
    return rows + [(t, ["en", None, "de"][i % 3]) for i, t in enumerate(texts())]


def run(spark, rows, **options):
    docs = spark.createDataFrame([(t, lang, 1, "own") for t, lang in rows], "text string, lang string, n int, score string")
    return sorted(tuple(r) for r in collocations(docs, **options).collect())


def test_against_brute_force(spark):
    rows = sample()
    assert run(spark, rows, least=5) == brute(rows, 5)
    assert run(spark, rows, least=5, covered=40, top=7) == brute(rows, 5, 40, 7)


def test_small_buckets_dealt_again_and_frequent_pairs_spread(spark):
    """Many buckets in several rounds; a pair that holds more than a thousandth of the words is split by its third word."""
    rows = sample(6)
    assert run(spark, rows, least=5, group_words=700, round_buckets=4) == brute(rows, 5)


def test_no_rows(spark):
    assert collocations(empty(spark).withColumn("lang", module.F.lit("en"))).collect() == []
    assert run(spark, [(None, "en"), ("", None), (" .,\n", "en")]) == []


def test_stretches_of_long_texts(monkeypatch):
    """The phrases of a text do not depend on where its stretches are cut, also with words longer than a stretch."""
    rng = random.Random(2)
    text = " ".join(rng.choice(["a", "bb", "ccc.", "d" * 70, "e\n", "f  "]) for _ in range(900))
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "en", "fr"], "text": [text, None, text[:300]]})

    def found():
        hot = {"en": np.zeros(1, np.uint64)}
        blocks = sorted((r for b in module._send({"en": 3}, hot, 2)(iter([batch])) for r in b.to_pylist()), key=lambda r: (r["lang"], r["bucket"], r["part"]))
        return sorted((lang, tuple(w), a, r) for b in module._frequent(2)(iter([pa.RecordBatch.from_pylist(blocks, module._BLOCK)])) for lang, w, a, r in zip(*(c.to_pylist() for c in b.columns)))

    whole = found()
    monkeypatch.setattr(module, "CHUNK_BYTES", 50)
    assert found() == whole and len(whole) > 50
