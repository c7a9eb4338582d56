"""Pieces, token counts, token files and packing against the tokenizers library itself."""

import json
import random
import subprocess
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from tokenizers import Tokenizer

from data import documents, empty, texts
from riskloom.llm import mixed_coder, pieces
from riskloom.llm.bytescan import flat_bytes
from riskloom.llm.packing import OpenBins, pack
from riskloom.llm.token_counts import count_tokens
from riskloom.llm.token_files import read_token_files, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def new_encoder(path, cuts=pieces.safe_cuts, special=True):
    pieces._encoders.clear()
    return pieces.file_encoder(path, cuts, special)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_librarys_ids(library, monkeypatch):
    monkeypatch.setattr(pieces, "RUN_BYTES", 4000)
    rng = random.Random(3)
    parts = ["a", "b", "'s", "'", "'re", " ", "  ", "\n", "\n\n", "\t", "\r\n", ".", ",", "!!", "é", "ß", "×", "÷", "漢字", " ", "　",
             "1", "23", "<|endoftext|>", "<|end", "I'm", "\x1c", "\x00", "😀", "the", "The", "\x85", "²", "_", "-", "́"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(5000)] + texts()
    encoder = new_encoder(PATH)
    data, offsets = flat_bytes(pa.array(some, pa.string()))
    got = []
    for ids, sizes in encoder.texts(data, offsets):
        got += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    want = [ids_of(library, t) for t in some]
    assert got == want
    assert encoder.lengths(data, offsets).tolist() == [len(x) for x in want]


ALPHABETS = {"Chinese": "漢字語彙日本中文學", "Cyrillic": "абвгдеёжзийк", "Greek": "αβγδεςσ", "Devanagari": "कखगघङा", "Arabic": "ابتثج"}


@pytest.mark.parametrize("script", ALPHABETS)
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cuts_in_every_script(script, name, monkeypatch):
    """Texts fall into pieces at spaces and line ends whatever the script, also next to the white space of Unicode."""
    monkeypatch.setattr(pieces, "RUN_BYTES", 300)
    path, rng = public_tokenizers.path(name), random.Random(4)
    parts = [*ALPHABETS[script], *ALPHABETS[script], " ", "\n", "\u00a0", "\u2003", "\u3000", "\u2028", "\u180e", "。", "«", "'s", "e\u0301", "<|endoftext|>"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 400))) for _ in range(150)]
    library = Tokenizer.from_file(path)
    want = [library.encode(t, add_special_tokens=False).ids for t in some]
    cuts = pieces.safe_cuts if name.startswith("byte") else pieces.word_cuts
    got = [x.tolist() for ids, sizes in new_encoder(path, cuts).texts(*flat_bytes(pa.array(some))) for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == want


@pytest.mark.parametrize("script", ["Chinese", "Cyrillic"])
def test_long_texts_in_bounded_memory(script):
    """20 MB with a line end every 40 characters, in a process of its own: ids of the stretches are those of its lines, memory stays low."""
    code = f"""
import resource, numpy as np, random
from tokenizers import Tokenizer
from riskloom.llm import pieces
rng, letters = random.Random(1), {ALPHABETS[script]!r}
lines = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(2000)]
raw = ("\\n".join(lines) + "\\n").encode()
data = np.frombuffer(raw * -(-20_000_000 // len(raw)), np.uint8)
one = pieces.file_encoder({PATH!r}, pieces.safe_cuts)
few = one.lengths(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
got = one.lengths(data, np.array([0, len(data)]))[0]
library = Tokenizer.from_file({PATH!r})
assert few == len(library.encode(raw.decode(), add_special_tokens=False).ids)
assert abs(got - few * (len(data) // len(raw))) <= 1, (got, few)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=str(Path(__file__).resolve().parents[2]))
    assert out.returncode == 0, out.stderr[-800:]
    assert int(out.stdout) < 250


def test_kept_pieces_make_room(library, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_PIECES", 50)
    encoder = new_encoder(PATH)
    some = [" ".join(f"word{i * 7 + k}" for k in range(30)) for i in range(20)]
    for text in some:
        assert encoder.lengths(*flat_bytes(pa.array([text]))).tolist() == [len(ids_of(library, text))]


def test_counts(spark, library):
    docs = documents(spark)
    got = count_tokens(docs.withColumn("n_tokens", docs.size), PATH).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_bytes, r.n_tokens) == (len((r.text or "").encode()), len(ids_of(library, r.text))) and r.kept == "own"
    assert count_tokens(empty(spark), PATH).collect() == []


def test_coder_round_trip():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0), np.array([5]), np.zeros(3000), rng.integers(0, 50_257, 5000), rng.zipf(1.3, 9000) % 50_000, rng.integers(0, 1 << 24, 700)):
        assert (mixed_coder.decode(mixed_coder.encode(ids)) == ids).all()
    again = np.tile(rng.integers(0, 50_000, 50), 100)
    assert len(mixed_coder.encode(again)) < 0.7 * len(again)  # 2 bytes an id plain
    with pytest.raises(ValueError):
        mixed_coder.encode(np.array([1 << 24]))


def test_coder_learns_at_every_id():
    """Short blocks of skewed ids: with weights or places learned at every second id or rarer, the frame is longer."""
    rng = np.random.default_rng(3)
    share = 1 / np.arange(1, 301) ** 1.1
    ids = rng.permutation(40_000)[:300][rng.choice(300, 60_000, p=share / share.sum())]
    frame = mixed_coder.encode(ids)
    assert (mixed_coder.decode(frame) == ids).all()
    assert 8 * len(frame) / len(ids) < 10.85


def test_blocks_are_independent_and_checked():
    ids = np.arange(5000) % 700
    frame = bytearray(mixed_coder.encode(ids))
    at = mixed_coder.FRAME.size
    n, size, _ = mixed_coder.HEAD.unpack_from(frame, at)
    one = mixed_coder.FRAME.pack(mixed_coder.MAGIC, 1, 1) + bytes(frame[at : at + mixed_coder.HEAD.size + size])
    assert (mixed_coder.decode(one) == ids[:n]).all()
    frame[at + mixed_coder.HEAD.size + 8] ^= 1
    with pytest.raises(ValueError):
        mixed_coder.decode(bytes(frame))


def test_token_files(spark, library, tmp_path):
    docs = documents(spark)
    write_token_files(docs, str(tmp_path / "ids"), PATH, part_bytes=200_000, frame_ids=4000)
    assert spark.read.parquet(str(tmp_path / "ids")).select("part").distinct().count() > 1
    got = read_token_files(spark, str(tmp_path / "ids")).orderBy("start").collect()
    want = defaultdict(list)
    for r in docs.collect():
        ids = np.array([*ids_of(library, r.text), 0], "<u4")
        want[r.doc_id].append((len(ids), zlib.crc32(ids.tobytes())))
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in docs.collect()), key=lambda k: (k is not None, k))
    start = 0
    for r in got:
        assert r.start == start
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        start += r.n_tokens
    assert not any(want.values())
    write_token_files(empty(spark), str(tmp_path / "none"), PATH)
    assert read_token_files(spark, str(tmp_path / "none")).collect() == []


def test_a_broken_file_raises(spark, tmp_path):
    write_token_files(documents(spark, texts(n=5)), str(tmp_path / "ids"), PATH)
    frames = spark.read.parquet(str(tmp_path / "ids"))
    broken = frames.withColumn("body", frames.body.substr(1, 40))
    broken.write.parquet(str(tmp_path / "broken"))
    with pytest.raises(PythonException):
        read_token_files(spark, str(tmp_path / "broken")).collect()


def test_open_bins():
    bins = OpenBins(10, 2)
    assert bins.put("a", 6) == [] and bins.put("b", 7) == []
    assert [p for p, _ in bins.put("c", 3)[0]] == ["b", "c"]  # the least space that still takes it, and full: closed
    assert bins.put("d", 5) == []
    assert [p for p, _ in bins.put("e", 8)[0]] == ["e"]  # three open: the fullest closes
    assert sorted(p for b in bins.rest() for p, _ in b) == ["a", "d"]


@pytest.mark.parametrize("open_bins", [1, 1024])
def test_packing(spark, library, open_bins):
    docs = documents(spark)
    got = pack(docs, PATH, capacity=512, open_bins=open_bins).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    texts_of = defaultdict(list)
    for r in docs.collect():
        texts_of[r.doc_id].append(np.array([*ids_of(library, r.text), 0], "<u4"))
    for key, own in texts_of.items():
        want = []
        for ids in own:
            first = len(ids) % 512 or min(512, len(ids))
            cuts = [0, *range(first, len(ids) + 1, 512)] if len(ids) > 512 else [0, len(ids)]
            want += [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[key]) == sorted(want)
    if open_bins > 1:
        assert len(by_sequence) <= 1.05 * -(-sum(r.length for r in got) // 512) + 1
    assert pack(empty(spark), PATH).collect() == []


def test_quotients_of_the_coder_are_whole():
    """Quotients by doubles are those of whole numbers, also next to a multiple; places are found by the ends of their shares."""
    rng = np.random.default_rng(5)
    b = np.concatenate([np.arange(1, 4097), rng.integers(1, 4097, 20000)])
    most = ((1 << 36) - 1) // b
    for n in (most, rng.integers(0, most + 1)):
        for off in (0, 1, b - 1, -1):
            a = np.clip(n * b + off, 0, (1 << 36) - 1)
            assert (mixed_coder._quotient(a, b) == a // b).all()
    rows = np.sort(rng.choice(4095, (500, 15)) + 1, axis=1)
    ends = np.hstack([rows, np.full((500, 1), 4096)]).astype(np.int16)
    value, first = rng.integers(0, 4096, 500), np.arange(500) * 16
    half = mixed_coder._search(ends, first, value)
    assert (half == (ends <= value[:, None]).sum(axis=1)).all()
    start, share = mixed_coder._span(ends, first, half)
    assert ((start <= value) & (value < start + share)).all() and (start[half == 0] == 0).all()


def test_coder_tells_ids_by_their_share_of_the_frame():
    """Ids without order, most of them rare, take little more than their entropy (9.1 bits and the table); blocks stay apart."""
    rng = np.random.default_rng(7)
    share = 1 / np.arange(1, 4001)
    share /= share.sum()
    ids = rng.permutation(50_000)[:4000][rng.choice(4000, 400_000, p=share)]
    frame = mixed_coder.encode(ids)
    assert (mixed_coder.decode(frame) == ids).all()
    assert 8 * len(frame) / len(ids) < -(share * np.log2(share)).sum() + 1.2
    few = rng.integers(0, 50_000, 100)
    assert len(mixed_coder.encode(few)) < 2 * len(few) + 60  # no table where it does not pay
    parts, at = [], mixed_coder.FRAME.size
    while at < len(frame):
        n, size, _ = mixed_coder.HEAD.unpack_from(frame, at)
        at += mixed_coder.HEAD.size + size
        parts.append((n, frame[at - mixed_coder.HEAD.size - size : at]))
    two = mixed_coder.FRAME.pack(mixed_coder.MAGIC, 1, 2) + parts[0][1] + parts[-2][1]
    begin = len(ids) - parts[-1][0] - parts[-2][0]
    assert (mixed_coder.decode(two) == np.concatenate([ids[: parts[0][0]], ids[begin : begin + parts[-2][0]]])).all()


@pytest.mark.parametrize("kind", ["even", "steep", "one", "many", "rare among many", "all ids"])
def test_shares_of_a_frame_do_not_overlap(kind):
    rng = np.random.default_rng(8)
    ids = {
        "even": np.arange(50_000), "steep": np.repeat(np.arange(20), 1 << np.arange(20)), "one": np.full(9, 7), "many": rng.integers(0, 1 << 24, 300_000),
        "rare among many": np.concatenate([np.repeat(np.arange(60_000), 40), np.arange(60_000, 260_000)]), "all ids": np.arange(1 << 16),
    }[kind].astype(np.uint32)
    shares, table = mixed_coder._Shares.of(ids)
    again = mixed_coder._Shares.read(table)
    assert (again.starts == shares.starts).all() and (again.sizes == shares.sizes).all() and (again.ids == shares.ids).all()
    order = np.argsort(shares.starts)
    ends = (shares.starts + shares.sizes)[order]
    assert (shares.sizes > 0).all() and (shares.starts[order][1:] >= ends[:-1]).all() and ends[-1] <= 1 << 24
    rank = np.arange(len(shares.ids))
    assert (shares.find(shares.starts) == rank).all() and (shares.find(shares.starts + shares.sizes - 1) == rank).all()
    assert (shares.ids[shares.ranks()[ids]] == ids).all()


def test_words_by_the_model_are_the_librarys(library, tmp_path):
    """Words of letters skip the stages before the model only where these leave them alone; an added token of letters forbids it."""
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZÀÉÖØÞßàéöøþÿ"
    some = [rng.choice(["", " "]) + "".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    some += [" ", "  a", "a b", "×", "÷a", "ab1", "don't", "é́", "<|endoftext|>", " the", "a" * 200, "a" * 201, " " + "é" * 300, ""]
    parts = json.loads(Path(PATH).read_text())
    assert pieces._takes_words_whole(parts)
    asked = []

    class Library:
        model = library.model

        def encode_batch_fast(self, texts, add_special_tokens):
            asked.extend(texts)
            return library.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    assert pieces._library_ids(Library(), parts)(some) == [ids_of(library, t) for t in some]
    assert 0 < len(asked) < 20
    own = Tokenizer.from_file(PATH)
    own.add_tokens(["foo"])
    own.save(str(tmp_path / "own.json"))
    words = ["foo", " food", " afoo", "of foo food"]
    got = [x.tolist() for ids, sizes in new_encoder(str(tmp_path / "own.json")).texts(*flat_bytes(pa.array(words))) for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [own.encode(w, add_special_tokens=False).ids for w in words]
    assert not pieces._takes_words_whole(parts | {"added_tokens": [{"content": " "}]})
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}):
        assert not pieces._takes_words_whole(parts | change)


def test_groups_of_blocks_are_even():
    """A frame that its last document or batch makes a little longer is no second, narrow group of as many steps."""
    assert mixed_coder._groups(0) == []
    for count in (1, 4095, 4096, 4097, 4600, 5120, 5121, 12_000):
        groups = mixed_coder._groups(count)
        assert groups[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(groups, groups[1:])) and sum(n for _, n in groups) == count
        sizes = [n for _, n in groups]
        assert max(sizes) <= mixed_coder.LANES * 5 // 4 and max(sizes) - min(sizes) <= 1
    assert len(mixed_coder._groups(4600)) == 1
