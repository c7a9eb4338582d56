"""Toxicity, license scan and nearest neighbours against brute force and held-out accuracy."""

import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from data import LICENSE, documents, empty, lower_az
from riskloom.llm import licenses, multi_index, toxicity
from riskloom.llm.bytescan import flat_bytes
from riskloom.llm.multi_index import nearest, traverse

INSULTS = ["idiot", "moron", "worthless", "scumbag"]


def labelled(n=600, seed=4):
    """Made-up syllable prose; toxic texts hold two insults, some with a character put in."""
    rng = random.Random(seed)
    syllables = ["ta", "ren", "mo", "lis", "ker", "dan", "ou", "thi", "sel", "bra"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(10, 120))]
        toxic = int(rng.random() < 0.25)
        for _ in range(2 * toxic):
            word = rng.choice(INSULTS)
            if rng.random() < 0.3:
                at = rng.randint(1, len(word) - 1)
                word = word[:at] + rng.choice("-*.x") + word[at:]
            words.insert(rng.randint(0, len(words)), word)
        rows.append((i, ". ".join(" ".join(words[k : k + 12]) for k in range(0, len(words), 12)), toxic))
    return rows


def plain_kernel(a, b):
    """Normalised gap-weighted kernel over three-symbol subsequences within a span of six."""

    def features(word):
        symbols = "^" + word + "$"
        out = {}
        for i in range(len(symbols)):
            for j in range(i + 1, len(symbols)):
                for k in range(j + 1, min(len(symbols), i + 6)):
                    key = symbols[i] + symbols[j] + symbols[k]
                    out.setdefault(key, []).append(0.6 ** (k - i - 2))
        return out

    fa, fb = features(a), features(b)
    norm = lambda f, own: np.sqrt(sum(sum(v) ** 2 for v in f.values()) if own else sum(x * x for v in f.values() for x in v))
    return min(1.0, sum(sum(v) * sum(fb.get(k, [0])) for k, v in fa.items()) / (norm(fa, False) * norm(fb, True))) ** 3


def test_kernel_against_plain_loops():
    landmarks = ["idiot", "worthless", "ta", "abcabc"]
    words = ["idiot", "idxiot", "worthlessly", "t", "zzz", "abcabcabc", "tata"]
    data, offsets = flat_bytes(pa.array(words))
    got = toxicity.Kernel([x.encode() for x in landmarks])(data, offsets[:-1], offsets[1:])
    assert got == pytest.approx(np.array([[plain_kernel(w, m) for m in landmarks] for w in words]), abs=1e-5)
    assert got[1, 0] > 5 * got[6, 0]  # an inserted character costs little


def test_units():
    text = "i d i o t said a b.  Well\nnext " + "x" * 50
    data, offsets = flat_bytes(pa.array([text, "", "one"]))
    starts, ends, stop, of = toxicity.units(data, offsets)
    found = [data[s:e].tobytes().decode() for s, e in zip(starts, ends)]
    assert found[:6] == ["i d i o t", "said", "a", "b.", "Well", "next"] and found[-1] == "one" and all(len(f) <= 24 for f in found)
    assert stop[[3, 4]].all() and not stop[[0, 1, 2]].any() and of[-1] == 2


def test_long_units_fall_into_windows():
    """What is spelled out over many letters, and long words: windows that overlap, each letter in one of them."""
    for text, longest, shared in (("a b c d e f g h i j " * 40, 48, 24), ("abcdefghij" * 40, 24, 12)):
        data, offsets = flat_bytes(pa.array([text.strip()]))
        starts, ends, _, _ = toxicity.units(data, offsets)
        assert starts[0] == 0 and ends[-1] == len(data) and (ends - starts <= longest).all()
        assert (ends[:-1] - starts[1:] == shared).all()


def test_spelled_out_text_in_bounded_memory():
    code = """
import resource, numpy as np
from riskloom.llm import toxicity
kernel = toxicity.Kernel([b"idiot", b"house"])
scorer = toxicity.Scorer(kernel, np.ones(2), 0.0)
texts = [b"a b c d " * 2_500_000, b"x" * 20_000_000, b"the house\\n" * 2_000_000]
data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
short = np.frombuffer(b"the house\\n" * 50, np.uint8)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
found = scorer.margins(data, offsets)
assert abs(found[2] - scorer.margins(short, np.array([0, len(short)]))[0]) < 1e-6
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=str(Path(__file__).resolve().parents[2]))
    assert out.returncode == 0, out.stderr[-800:]
    assert int(out.stdout) < 300


def test_held_out_accuracy(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(None, None, 0.1), (10_000, "", 0.1), (10_001, "b " * 100_000, 0.1), (0, rows[0][1], 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y, "en") for i, _, y in rows] + [(None, 1, "en"), (5, None, "en")], "doc_id long, toxic int, lang string")
    scored = toxicity.score_toxicity(docs, labels).collect()
    assert len(scored) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored)
    truth = {i: y for i, _, y in rows}
    held = [(r.predicted, truth[r.doc_id]) for r in scored if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) for r in scored)
    assert len(held) > 100 and sum(p == y for p, y in held) / len(held) > 0.95
    # a held-out row's label changes nothing
    flipped = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, flipped).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score) for r in scored if r.doc_id)


def test_no_labels(spark):
    docs = documents(spark, extra=False)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.predicted in (0, 1) and r.score < 0.5 for r in toxicity.score_toxicity(docs, labels).collect())
    assert toxicity.score_toxicity(empty(spark), labels).collect() == []


def plain_scan(text, weight):
    words = re.sub(licenses.NOT_WORD, " ", lower_az(text)).split()
    at_base, base = [], set()
    for label, phrase in licenses.PHRASES.items():
        parts = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        at_base += here
        base |= {label} if here else set()
    labels, score = set(base), 0.0
    for name, (notice, names) in licenses.TEMPLATES.items():
        own, step = licenses.template_words(notice), licenses.step_of(notice)
        whole = sum(weight[w] for w in own)
        for at in range(0, len(words), step):
            block = words[at : at + 2 * step]
            common = sum(weight[w] for w in own if w in set(block))
            line = " " + " ".join(block) + " "
            if 10 * common >= 8 * whole and all(f" {n} " in line for n in names):
                labels.add(name)
                score = max(score, common / whole)
    return len(words), at_base, base, labels, 1.0 if at_base else score


def weights_of(rows):
    counts = Counter(w for t in rows for w in re.sub(licenses.NOT_WORD, " ", lower_az(t)).split())
    total = sum(counts.values())
    return defaultdict(lambda: licenses.word_weight(0, total), {w: licenses.word_weight(n, total) for w, n in counts.items()})


NEAR_MISSES = [
    "Released under the Apache License", "Licensed under the Mozilla License, Version 2.0", "CC BY in the title, licensed to drive under 4.0 rules",
    "the work is released under contract; see the driving license office", "released under the license of the MIT press, say others",
    "free of charge is this copy for any person with software files", "the GNU foundation and the general public have a license, version 3",
]


def test_near_misses_get_no_label_and_long_templates_work(spark):
    """Sentences of license words that name no license; whole license texts, also with words changed, far inside long texts."""
    filler = " ".join(f"word{i % 97}" for i in range(700))
    texts = NEAR_MISSES + ["Licensed under CC BY 4.0", "GNU Lesser General Public License, version 2.1 is the license this work is licensed under"]
    whole = {"mit-text": licenses._MIT, "bsd-2-clause-text": licenses._BSD}
    texts += [f"{filler} {t.replace('PURPOSE', 'AIM')} {filler}" for t in whole.values()] + [filler] * 30
    got = licenses.scan_licenses(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    by_text = {r.text: r for r in got}
    for t in NEAR_MISSES:
        assert set(by_text[t].labels.split(",")) <= {"", "cc-by"} and by_text[t].labels == by_text[t].base_labels
    assert by_text["Licensed under CC BY 4.0"].labels == "cc-by,cc-by-4.0-short"
    assert by_text[texts[len(NEAR_MISSES) + 1]].labels == "gpl,lgpl-2.1"
    for t, name in zip(texts[len(NEAR_MISSES) + 2 :], whole):
        assert name in by_text[t].labels.split(",")


def test_licenses_of_templates_without_naming_phrases(spark):
    """Naming phrases may be missing or be written as in the notice; every verbatim notice is found, whatever the others need."""
    templates = {
        "fox's own": ("The quick brown fox jumps over the lazy dog", []),
        "corp": ("Permission granted by Acme Corporation to everyone", ["Acme Corporation"]),
        "long": ("one two three four five six seven eight nine ten eleven", ["Seven, Eight"]),
    }
    texts = [notice for notice, _ in templates.values()] + ["quick over the lazy", "Acme and Corporation", ""]
    got = licenses.scan_licenses(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), templates).collect()
    assert [r.labels for r in sorted(got, key=lambda r: r.i)] == ["fox's own", "corp", "long", "", "", ""]


def test_licenses_against_plain_loops(spark):
    rng = random.Random(6)
    rows = ["cc by cc by", "CC-BY", "word " * 40 + LICENSE + " word" * 80, None, "", "...", "é É all rights reserved", "x " * 50_000]
    for notice, _ in licenses.TEMPLATES.values():
        words = notice.split()
        for drop in range(4):
            kept = [w for w in words if rng.random() > 0.07 * drop]
            rows.append("filler text " * rng.randint(0, 40) + "\n".join(kept) + " tail" * rng.randint(0, 90))
    docs = documents(spark, rows)
    got = licenses.scan_licenses(docs).collect()
    assert len(got) == docs.count()
    weight = weights_of([r.text for r in docs.collect()])
    for r in got:
        n_words, at, base, labels, score = plain_scan(r.text, weight)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n_words, len(at), min(at, default=None), max(at, default=None))
        assert (r.base_labels, r.labels) == (",".join(sorted(base)), ",".join(sorted(labels))) and r.score == pytest.approx(score)
    assert sum(bool(r.labels) for r in got) > 40
    assert licenses.scan_licenses(empty(spark)).collect() == []


def vectors(spark, x, bad=True):
    rows = [(i, [float(v) for v in row], 1) for i, row in enumerate(x)]
    if bad:
        rows += [(10_000, None, 1), (10_050, [0.0] * x.shape[1], 1), (10_100, [float("nan")] * x.shape[1], 1), (10_150, [1.0, None] * (x.shape[1] // 2), 1),
                 (10_200, [float("inf")] * x.shape[1], 1), (10_250, [1.0], 1), (None, [1.0] * x.shape[1], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")


def brute(x, every=50, k=5):
    x = x.astype(np.float32).astype(np.float64)
    length = np.sqrt((x * x).sum(axis=1))
    out = {}
    for q in range(0, len(x), every):
        score = (x * x[q]).sum(axis=1) / (length * length[q])
        order = [i for i in np.lexsort((np.arange(len(x)), -score)) if i != q][:k]
        out[q] = [(int(i), score[i]) for i in order]
    return out


def test_traverse_takes_cells_in_order():
    rng = np.random.default_rng(3)
    for _ in range(20):
        left, right, counts = rng.random(7), rng.random(5), rng.integers(0, 3, (7, 5))
        cells = traverse(left, right, counts, 10**9)
        sums = [left[i] + right[j] for i, j in cells]
        assert sums == sorted(sums) and sorted(cells) == sorted(zip(*(x.tolist() for x in np.nonzero(counts))))
        some = traverse(left, right, counts, 5)
        assert some == cells[: len(some)] and sum(counts[c] for c in some[:-1]) < 5


def test_all_entries_give_the_exact_result(spark):
    x = np.random.default_rng(1).normal(size=(400, 16))
    x[100:220] = x[7]  # a vector with many copies: ties go to the smaller id
    got = {}
    for r in nearest(vectors(spark, x), share=1.0, centroids=8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(x)
    assert got.keys() == want.keys()
    for q, rows in want.items():
        assert [v for v, _ in got[q]] == [v for v, _ in rows] and [s for _, s in got[q]] == pytest.approx([s for _, s in rows], abs=1e-12)


def test_recall(spark):
    x = np.random.default_rng(2).normal(size=(4000, 32))
    got = {(r.query_id, r.vec_id) for r in nearest(vectors(spark, x, False)).collect()}
    want = {(q, v) for q, rows in brute(x).items() for v, _ in rows}
    assert len(got & want) / len(want) >= 0.9


def test_few_vectors(spark):
    assert nearest(vectors(spark, np.eye(2, 4), False)).select("query_id", "vec_id", "rank").collect() == [(0, 1, 1)]
    assert nearest(vectors(spark, np.zeros((0, 4)))).collect() == []
    one = vectors(spark, np.ones((1, 4)), False)
    same = one.unionByName(one)
    assert sorted(nearest(same).select("query_id", "vec_id").collect()) == [(0, 0), (0, 0)]
