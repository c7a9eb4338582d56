"""Minimum-bin-slack packing against the tokenizers library, and its choice of lengths against all choices."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from data import documents, empty
from riskloom.llm.slack_packing import Windows, fullest, pack_windows

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_fullest_against_all_choices():
    rng = random.Random(1)
    for _ in range(300):
        capacity = rng.randint(1, 40)
        items = [rng.randint(1, 45) for _ in range(rng.randint(1, 9))]
        counts = Counter(items)
        window = fullest(dict(counts), capacity)
        fits = [n for n in items if n <= capacity]
        if not fits:
            assert window == []
            continue
        longest = max(fits)
        rest = list(fits)
        rest.remove(longest)
        sums = (longest + sum(c) for k in range(len(rest) + 1) for c in itertools.combinations(rest, k))
        assert sum(n * c for n, c in window) == max(s for s in sums if s <= capacity)
        assert all(0 < c <= counts[n] for n, c in window) and dict(window)[longest] >= 1


def test_windows_wait_within_bounds():
    rng, windows, seen = random.Random(2), Windows(100, 4), []
    for i in range(3000):
        n = rng.randint(1, 99)
        windows.add(i, n)
        for window, total in windows.ready():
            assert total == sum(n for _, n in window) <= 100
            seen += [p for p, _ in window]
        assert windows.tokens <= 400
    left = [p for own in windows.waiting.values() for p in own]
    assert sorted(seen + left) == list(range(3000))


@pytest.mark.parametrize("capacity", [512, 2048])
def test_packing(spark, capacity):
    library = Tokenizer.from_file(PATH)
    docs = documents(spark)
    got = pack_windows(docs, PATH, capacity=capacity).collect()
    sequences, pieces = defaultdict(list), Counter()
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
    padding = 0
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding == 0
    total = 0
    for r in docs.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        total, at = total + len(ids), 0
        while at < len(ids):  # follow one document's pieces from its first id to its last
            found = [k for k in pieces if pieces[k] and k[0] == r.doc_id and k[1] == at and k[4] == len(ids) and zlib.crc32(ids[at : at + k[2]].tobytes()) == k[3]]
            assert found
            pieces[found[0]] -= 1
            at += found[0][2]
    assert not +pieces and total == sum(r.length for r in got)
    assert len(sequences) <= total / capacity + 16
    assert pack_windows(empty(spark), PATH).collect() == []
