"""The interpolated model against a plain dictionary version."""

import math
import re
import zlib
from collections import Counter

import pytest

from riskloom.llm.interpolated_lm import score_texts

TEXTS = [
    "the cat sat on the mat", "The dog\tsat on  the mat", None, "", "a b a b a b c", "ÉTÉ été the cat", "the cat sat on the mat",
    " lead and trail \n", "x" * 3_000_000 + " the end", "one",
]


def split(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + [None]


def plain(rows, rounds):
    fold = [zlib.crc32(("" if k is None else str(k)).encode()) % 10 for k, _ in rows]

    def counts(folds):
        words, pairs, before = Counter(), Counter(), Counter()
        for (_, text), f in zip(rows, fold):
            if f in folds:
                last = "begin"
                for w in split(text):
                    words[w] += 1
                    pairs[last, w] += 1
                    before[last] += 1
                    last = w
        return words, pairs, before

    words, pairs, before = counts(set(range(1, 10)))
    n, v = sum(words.values()), len(words)
    less = counts(set(range(2, 10)))
    n_less = sum(less[0].values())
    weights = {b: [1 / 3] * 3 for b in range(65)}
    weights[0] = [0.5, 0.5, 0]

    def parts(model, total, last, w):
        c = model[2][last]
        return c.bit_length(), [1 / (v + 1), model[0][w] / max(total, 1), model[1][last, w] / max(c, 1)]

    for _ in range(rounds):
        sums = {b: [1, 1, 1 if b else 0] for b in range(65)}
        for (_, text), f in zip(rows, fold):
            if f == 1:
                last = "begin"
                for w in split(text):
                    b, p = parts(less, n_less, last, w)
                    mixed = [x * y for x, y in zip(weights[b], p)]
                    for i in range(3):
                        sums[b][i] += mixed[i] / sum(mixed)
                    last = w
        new = {b: [x / sum(s) for x in s] for b, s in sums.items()}
        done = max(abs(x - y) for b in new for x, y in zip(new[b], weights[b])) < 1e-4
        weights = new
        if done:
            break
    out = []
    for (k, text), f in zip(rows, fold):
        base = score = 0.0
        known, last = 0, "begin"
        for w in split(text):
            base += math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1)))
            b, p = parts((words, pairs, before), n, last, w)
            score += math.log10(sum(x * y for x, y in zip(weights[b], p)))
            known += words[w] > 0
            last = w
        out.append((k, f == 0, len(split(text)), known, n, base, score))
    return out


@pytest.mark.parametrize("chunk", [1 << 23, 2_000_000])
def test_same_as_dictionaries(spark, chunk):
    rows = [(i, TEXTS[i % len(TEXTS)] if i % 3 else f"{TEXTS[i % 8]} w{i % 5}") for i in range(60)] + [(None, "the cat"), (3, "tie"), (3, "tie")]
    docs = spark.createDataFrame([(k, t, 1, b"x") for k, t in rows], "doc_id long, text string, key int, chunk binary")
    got = score_texts(docs, rounds=6, chunk_bytes=chunk).collect()
    want = plain(rows, 6)
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(want, key=order)):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_probabilities_sum_to_one(spark):
    rows = [(i, t) for i, t in enumerate(["a b c", "b c a", "c c a b", "a a"] * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # one-word texts: P(w) P(end | w) over all words and an unknown one, P(end) for the empty text
    probe = [(1000 + 10 * i, t) for i, t in enumerate(["a", "b", "c", "unseen", ""])]
    scored = score_texts(docs.unionByName(spark.createDataFrame(probe, docs.schema))).filter("doc_id >= 1000").collect()
    assert all(r["score"] < 0 for r in scored)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert score_texts(docs).collect() == []
