"""BPE of whole Arrow batches, each distinct piece encoded once by the tokenizer's library.

A text falls into pieces at places where the pre-tokenizer surely ends a token, so the ids of a
text are the ids of its pieces one after another. Natural text repeats its pieces, so a worker keeps the
ids of the pieces it has met, up to a bound, and gives only new ones to the library.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

from .bytescan import IS_SPACE, runs_of_bytes, span_hash

RUN_BYTES = 2 << 20
KEPT_PIECES = 2_000_000
LIBRARY_BATCH = 20_000

_LETTER, _DIGIT, _SPACE, _LINE, _QUOTE, _MARK, _HIGH = 1, 2, 3, 4, 5, 6, 7
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = _MARK
_CLASS[32], _CLASS[10], _CLASS[39] = _SPACE, _LINE, _QUOTE
_CLASS[128:] = _HIGH


def _solid(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """True where the byte ends a character that is surely no white space.

    Of the characters beyond ASCII these are all but U+0085, U+00A0, U+1680, U+180E, U+2000 to U+200A, U+2028, U+2029, U+202F,
    U+205F and U+3000.
    """
    high = kind == _HIGH
    solid = high | ((kind >= _LETTER) & (kind != _SPACE) & (kind != _LINE))
    if high.any():
        one, two = np.append(np.uint8(0), data[:-1]), np.append(np.zeros(2, np.uint8), data[:-2])[: len(data)]
        solid &= ~((one == 0xC2) & ((data == 0x85) | (data == 0xA0)))
        solid &= ~((two == 0xE2) & (one == 0x80) & ((data <= 0x8A) | (data == 0xA8) | (data == 0xA9) | (data == 0xAF)))
        for a, b, c in ((0xE1, 0x9A, 0x80), (0xE1, 0xA0, 0x8E), (0xE2, 0x81, 0x9F), (0xE3, 0x80, 0x80)):
            solid &= ~((two == a) & (one == b) & (data == c))
    return solid


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """True where a text may be cut before the byte without a change of its tokens.

    The pre-tokenizer's tokens are contractions, runs of letters, digits or other marks with one space
    before them, and runs of white space, whose last character stays back if it is followed by more. So a
    token ends (a) before a space or line end that follows any character of any script but white space, (b) between letter and
    mark, either way round, but for apostrophes, (c) after a single line end that is followed by a letter,
    digit or mark. In (b) and (c) other characters than ASCII count only if they are two-byte letters under lead 0xC3.
    """
    n = len(data)
    cut = np.zeros(n, bool)
    if n < 2:
        return cut
    kind = _CLASS[data]
    ends_letter = kind == _LETTER
    ends_letter[1:] |= (kind[1:] == _HIGH) & (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    solid = _solid(data, kind)
    here, mark = kind[1:], kind[1:] == _MARK
    cut[1:] = (solid[:-1] & ((here == _SPACE) | (here == _LINE))) | (ends_letter[:-1] & mark)
    cut[1:] |= (kind[:-1] == _MARK) & (here == _LETTER)
    cut[2:] |= solid[:-2] & (kind[1:-1] == _LINE) & ((kind[2:] == _LETTER) | (kind[2:] == _DIGIT) | (kind[2:] == _MARK))
    return cut


def gap_cuts(data: np.ndarray) -> np.ndarray:
    """True before a space or line end that follows any character of any script but white space."""
    cut = np.zeros(len(data), bool)
    kind = _CLASS[data]
    cut[1:] = _solid(data, kind)[:-1] & ((kind[1:] == _SPACE) | (kind[1:] == _LINE))
    return cut


def word_cuts(data: np.ndarray) -> np.ndarray:
    """True before each run of ASCII white space: for tokenizers that drop white space and take no token across it."""
    gap = IS_SPACE[data]
    cut = gap.copy()
    cut[1:] &= ~gap[:-1]
    return cut


class _Slots:
    """Open addressing over numpy arrays: 64-bit key to a row number."""

    def __init__(self, bits: int):
        self.bits, self.used = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.rows = np.zeros(1 << bits, np.int32)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key; -1 if absent."""
        at = self._first(keys)
        found = self.keys.take(at)
        out = np.where(found == keys, self.rows.take(at), -1)
        open_ = np.flatnonzero((found != keys) & (found != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found, want = self.keys[at[open_]], keys[open_]
            hit = found == want
            out[open_[hit]] = self.rows[at[open_[hit]]]
            open_ = open_[~hit & (found != 0)]
        return out

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Add distinct keys that are absent."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            full = self.keys != 0
            old_keys, old_rows = self.keys[full], self.rows[full]
            self.__init__(max(self.bits + 1, int(4 * (len(old_keys) + len(keys))).bit_length()))
            self.add(old_keys, old_rows)
        self.used += len(keys)
        at = self._first(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] == 0
            mine = todo[free]
            self.keys[at[mine]] = keys[mine]
            won = np.zeros(len(keys), bool)
            won[mine] = self.keys[at[mine]] == keys[mine]
            placed = todo[won[todo]]
            self.rows[at[placed]] = rows[placed]
            todo = todo[~won[todo]]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)


class PieceEncoder:
    """Ids of texts under one tokenizer, without begin, end or other added tokens.

    ``encode`` gives the ids of each of a list of texts, ``cuts`` the places where a text may be cut, ``whole`` strings that must not be.
    Two pieces count as the same if their 64-bit hashes are the same; among 10 million pieces the chance of any
    wrong match is under one in a hundred thousand.

    Memory: about 2 MB of text at a time, longer texts in stretches between cuts. A stretch without any cut (one
    endless run of characters that are no white space) goes to the library whole, as it may be one token sequence.
    """

    def __init__(self, encode, cuts=safe_cuts, whole: list[bytes] = (), kept: int | None = None):
        self.encode, self.cuts, self.whole, self.kept = encode, cuts, whole, kept
        self._clear()

    def _clear(self) -> None:
        self.slots = _Slots(16)
        self.ids = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1 << 14, np.int64)
        self.rows = 0

    def _learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        if self.rows + len(keys) > (self.kept or KEPT_PIECES):
            self._clear()
        raw = memoryview(np.ascontiguousarray(data))
        for first in range(0, len(keys), LIBRARY_BATCH):
            some = slice(first, first + LIBRARY_BATCH)
            texts = [str(raw[s:e], "utf-8", "replace") for s, e in zip(starts[some].tolist(), ends[some].tolist())]
            found = self.encode(texts)
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            at = int(self.ends[self.rows - 1]) if self.rows else 0
            total = at + int(lengths.sum())
            if total > len(self.ids):
                self.ids = np.resize(self.ids, max(total, 2 * len(self.ids)))
            if self.rows + len(found) > len(self.ends):
                self.ends = np.resize(self.ends, max(self.rows + len(found), 2 * len(self.ends)))
            self.ids[at:total] = np.fromiter(chain.from_iterable(found), np.int32, total - at)
            self.ends[self.rows : self.rows + len(found)] = at + np.cumsum(lengths)
            self.slots.add(keys[some], np.arange(self.rows, self.rows + len(found), dtype=np.int32))
            self.rows += len(found)

    def _rows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        keys = span_hash(data, starts, ends) | np.uint64(1)
        rows = self.slots.find(keys)
        new = np.flatnonzero(rows < 0)
        if len(new):
            before = self.rows
            distinct, where, which = np.unique(keys[new], return_index=True, return_inverse=True)
            self._learn(data, distinct, starts[new[where]], ends[new[where]])
            if self.rows == before + len(distinct):
                rows[new] = before + which
            else:  # what was kept before made room
                distinct, where, rows = np.unique(keys, return_index=True, return_inverse=True)
                self._clear()
                self._learn(data, distinct, starts[where], ends[where])
        return rows

    def _spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.cuts(data)
        raw = data.tobytes() if self.whole else b""
        for token in self.whole:
            at = raw.find(token)
            while at >= 0:
                cut[at + 1 : at + len(token)] = False
                at = raw.find(token, at + 1)
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        return starts, np.append(starts[1:], len(data))

    def stretches(self, data: np.ndarray, low: int, high: int, run: int | None = None):
        """Ends of the stretches of about ``run`` (RUN_BYTES) bytes that a text falls into, each at a safe cut."""
        span = run = run or RUN_BYTES
        while high - low > span:
            starts = self._spans(data[low : low + span], np.zeros(1, np.int64))[0]
            end = int(starts[starts < span - 64].max(initial=0))
            if end == 0:
                span *= 2
                continue
            yield low + end
            low, span = low + end, run
        yield high

    def _runs(self, data: np.ndarray, offsets: np.ndarray):
        """(first text, end, ids of each piece: start and number, pieces of each text), at most RUN_BYTES at a time.

        A longer text comes in several runs of the same number.
        """
        for first, last in runs_of_bytes(offsets, RUN_BYTES):
            low, at = int(offsets[first]), offsets[first : last + 1]
            for high in self.stretches(data, low, int(offsets[last])) if last - first == 1 else (int(offsets[last]),):
                if high > low:
                    where = np.clip(at - low, 0, high - low)
                    starts, ends = self._spans(data[low:high], where)
                    rows = self._rows(data[low:high], starts, ends)
                    begin = np.where(rows > 0, self.ends[rows - 1], 0)
                    yield first, last, begin, self.ends[rows] - begin, np.diff(np.searchsorted(starts, where))
                low = high

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of ids of each text."""
        out = np.zeros(len(offsets) - 1, np.int64)
        for first, last, _, size, pieces in self._runs(data, offsets):
            total = np.append(0, np.cumsum(size))
            at = np.append(0, np.cumsum(pieces))
            out[first:last] += total[at[1:]] - total[at[:-1]]
        return out

    def texts(self, data: np.ndarray, offsets: np.ndarray):
        """(ids of some texts end to end, number of ids of each), for all texts in order, about RUN_BYTES at a time."""
        done, held, n = 0, [], len(offsets) - 1
        for first, last, begin, size, pieces in self._runs(data, offsets):
            if held and first != held[0]:
                yield np.concatenate(held[1:]), np.array([sum(map(len, held[1:]))])
                done, held = done + 1, []
            if first > done:
                yield np.zeros(0, np.int32), np.zeros(first - done, np.int64)
                done = first
            total = np.append(0, np.cumsum(size))
            ids = self.ids[np.arange(total[-1]) + np.repeat(begin - total[:-1], size)]
            if last - first == 1:
                held = (held or [first]) + [ids]
            else:
                at = np.append(0, np.cumsum(pieces))
                yield ids, total[at[1:]] - total[at[:-1]]
                done = last
        if held:
            yield np.concatenate(held[1:]), np.array([sum(map(len, held[1:]))])
            done += 1
        if done < n:
            yield np.zeros(0, np.int32), np.zeros(n - done, np.int64)


#: A word of letters that byte-level BPE takes as one, with the space before it, and the characters that stand for its bytes there.
_WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]{1,200}")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def _takes_words_whole(parts: dict) -> bool:
    """Whether the file's tokenizer gives every such word to its model as it is: byte-level BPE without added tokens of letters or space."""
    before = parts.get("pre_tokenizer") or {}
    return (
        (before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True)) == ("ByteLevel", False, True)
        and (parts.get("post_processor") or {}).get("type", "ByteLevel") == "ByteLevel"
        and not any(parts.get(k) for k in ("normalizer", "truncation", "padding"))
        and not any(re.fullmatch("[ A-Za-zÀ-ÖØ-öø-ÿ]*", t["content"]) for t in parts.get("added_tokens", []))
    )


def _library_ids(library, parts: dict):
    """Ids of each of a list of texts. Words of letters go to the library's model, past the stages that leave them as they are."""

    def whole(texts: list[str]) -> list[list[int]]:
        return [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)]

    def by_words(texts: list[str]) -> list[list[int]]:
        out, rest = [], []
        for k, text in enumerate(texts):
            if is_word(text):
                out.append([t.id for t in tokenize(text.encode().decode("latin-1").translate(_BYTE_CHARS))])
            else:
                out.append(None)
                rest.append(k)
        for k, ids in zip(rest, whole([texts[k] for k in rest])):
            out[k] = ids
        return out

    if not _takes_words_whole(parts):
        return whole
    tokenize, is_word = library.model.tokenize, _WORD.fullmatch
    return by_words


_encoders: dict[tuple, PieceEncoder] = {}


def file_encoder(path: str, cuts, special: bool = True, kept: int | None = None) -> PieceEncoder:
    """The worker's encoder of a tokenizers file, kept between tasks; with ``special`` unset, special strings in texts are plain text."""
    if (path, special) not in _encoders:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        library = Tokenizer.from_file(path)
        library.encode_special_tokens = not special
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        whole = [t["content"].encode() for t in parts.get("added_tokens", []) if special and len(t["content"]) > 1]
        _encoders[path, special] = PieceEncoder(_library_ids(library, parts), cuts, whole, kept)
    return _encoders[path, special]


def encoder(path: str) -> PieceEncoder:
    """Byte-level BPE that keeps white space."""
    return file_encoder(path, safe_cuts)


def word_encoder(path: str) -> PieceEncoder:
    """BPE of words that drops white space."""
    return file_encoder(path, word_cuts)
