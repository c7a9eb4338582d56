"""Token alignment against a brute-force pairing of byte ranges, from the libraries' own tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from data import documents, empty, texts
from riskloom.llm import alignment, pieces
from riskloom.llm.alignment import align_tokens, byte_level_entries, covering, piece_entries
from riskloom.llm.bytescan import flat_bytes

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    return a, byte_level_entries(a), b, piece_entries(b)


def tokens(plain, text):
    """Ids and byte ranges of both sides; none for texts that do not come back."""
    a, bytes_a, b, bytes_b = plain
    if not text:
        return [], []
    sides = []
    for ids, table in ((a.encode(" " + text, add_special_tokens=False).ids, bytes_a), (b.encode(text), bytes_b)):
        if b"".join(table[i] for i in ids) != (" " + text).encode():
            return [], []
        ends = np.cumsum([len(table[i]) for i in ids]).tolist()
        sides.append(list(zip(ids, [0, *ends], ends)))
    return sides


def brute(plain, rows):
    found, counts = [], Counter()
    for text in rows:
        a, b = tokens(plain, text)
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        counts.update(links)
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = []
        for low, high in zip([0, *ends], ends):
            groups.append("|".join(",".join(str(t[0]) for t in side if low < t[2] <= high) for side in (a, b)))
        found.append((len(a), len(b), len(ends), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(n_a, n_b, n, len(k), sum(counts[p] == best[p[1]] for p in k), sum(counts[p] for p in k), sha) for n_a, n_b, n, k, sha in found]


def sample(seed=3, n=150):
    rng = random.Random(seed)
    parts = ["a", "the ", "Être", "日本", " ", "  ", "\n", "\n ", "\t", "\r\n", "▁", "\x00", "<s>", "</s>", "<0x0A>", "<|endoftext|>", "😀", "é", " ", "　", " ", "1234", "it's", "...", "Être ", "in", "ing ", "﻿", "​", "ﬁ"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_against_brute_force(spark, plain):
    rows = [t for t in sample() + texts(n=20) if not t or len(t) < 3000]
    df = spark.createDataFrame([(i, t, 7, "own") for i, t in enumerate(rows)], "doc_id long, text string, n_a int, chunk string")
    for chunk in (alignment.CHUNK_BYTES, 500):
        got = sorted(align_tokens(df, A, B, chunk_bytes=chunk).collect())
        assert [tuple(r)[1:5] + (r.n_best, r.count_sum, r.groups_sha256) for r in got] == brute(plain, rows)


def test_stretches_of_a_long_text(plain, monkeypatch):
    """A text in stretches has the tokens, groups and links of the whole."""
    text = " ".join(sample(8, 60)).replace("▁", "x")
    want = brute(plain, [text])[0]
    data, offsets = alignment._with_space(*flat_bytes(pa.array([text])))
    monkeypatch.setattr(pieces, "RUN_BYTES", 200)
    sides, one, low, cuts = alignment._both(A, B), alignment._Aligned(), 0, 0
    for high in sides[0].stretches(data, 0, len(data)):
        alignment.align_batch(sides, data[low:high], np.array([0, high - low]), [one])
        low, cuts = high, cuts + 1
    counts, sha, pairs, times = one.row()
    assert cuts > 3 and (*counts, sha) == (*want[:4], want[6]) and times.sum() == want[3]


def test_covering():
    doc = np.array([0, 0, 0, 1])
    a, b = covering(doc, np.array([0, 3, 5, 9]), np.array([0, 0, 1]), np.array([0, 4, 9]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(0, 0), (1, 0), (1, 1), (2, 1), (3, 2)]


def test_awkward_rows(spark, plain):
    docs = documents(spark)
    got = align_tokens(docs.withColumn("n_links", docs.size), A, B).collect()
    want = Counter(brute_key for brute_key in ((r.doc_id, len(tokens(plain, r.text)[0]), len(tokens(plain, r.text)[1])) for r in docs.collect()))
    assert Counter((r.doc_id, r.n_a, r.n_b) for r in got) == want
    assert all(r.groups_sha256 == "" and not r.count_sum for r in got if not r.n_a)
    assert align_tokens(empty(spark), A, B).collect() == []
