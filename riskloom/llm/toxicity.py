"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import IS_SPACE, LOWER_AZ, flat_bytes, runs_of_bytes, span_hash, words
from .common import crc32_of, fresh, without
from .pieces import _Slots

TOXIC_ROWS = 1200
OTHER_ROWS = 2400
SAMPLE_BYTES = 16_384
TOXIC_LANDMARKS = 80
OTHER_LANDMARKS = 60
POWER = 3
GAP = 0.6
SPAN = 6
SENTENCE_WORDS = 48
LONG_WORD = 24
OVERLAP = 12
RUN_BYTES = 1 << 20
WORDS_AT_ONCE = 1000
SENTENCES_AT_ONCE = 1_000
TEXTS_AT_ONCE = 200
ROWS_AT_ONCE = 10_000
KEPT_WORDS = 1_500_000
THRESHOLD = 0.3
RESULT = ["held_out", "score", "predicted"]

_START, _STOP = 37, 38
_SYMBOL = np.zeros(256, np.uint32)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[48:58] = np.arange(27, 37)
_SYMBOL[128:] = 39 + np.arange(128) % 25
_STEPS = [(a, b) for a in range(1, SPAN - 1) for b in range(1, SPAN - a)]
_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[[10, 33, 46, 63]] = True


# ---- words and sentences ------------------------------------------------------------------------

def stretches(data: np.ndarray, low: int, high: int):
    """Ends of the stretches of at most RUN_BYTES of a long text: behind a line end, else before a space, else anywhere."""
    while high - low > RUN_BYTES:
        window = data[low : low + RUN_BYTES]
        found = np.flatnonzero(window == 10) + 1
        if not len(found):
            found = np.flatnonzero(IS_SPACE[window[1:]]) + 1
        low += int(found[-1]) if len(found) else RUN_BYTES
        yield low
    yield high


def units(data: np.ndarray, offsets: np.ndarray):
    """Start and end of each unit, whether a sentence ends with it, and the units of each text (data in lower case).

    A unit is a word; three or more words of one byte in a row are one unit (an insult spelled out); a word of more
    than 24 bytes is windows of 24 bytes that overlap by 12, and what is spelled out in more than 48 bytes is windows of 48 that overlap
    by 24, so memory does not grow with a unit. A sentence ends with a unit that closes with . ! ? or
    before a line end, and after 48 units.
    """
    starts, ends, counts = words(data, offsets)
    n = len(starts)
    text = np.repeat(np.arange(len(counts)), counts)
    if not n:
        return starts, ends, np.zeros(0, bool), text
    single = ends - starts == 1
    chained = np.zeros(n, bool)
    chained[1:] = single[1:] & single[:-1] & (text[1:] == text[:-1])
    first = np.flatnonzero(~chained)
    last = np.append(first[1:], n) - 1
    few = last - first == 1
    if few.any():  # two in a row stay apart
        first = np.sort(np.concatenate([first, first[few] + 1]))
        chained[first] = False
        last = np.append(first[1:], n) - 1
    starts, ends, text = starts[first], ends[last], text[first]
    size = ends - starts
    long = np.where(last == first, LONG_WORD, 2 * LONG_WORD)  # spelled out: a letter and a space
    shared = np.where(last == first, OVERLAP, 2 * OVERLAP)
    windows = np.where(size > long, -(-(size - shared) // (long - shared)), 1)
    if (windows > 1).any():
        step = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        starts = np.repeat(starts, windows) + np.repeat(long - shared, windows) * step
        ends = np.where(np.repeat(windows, windows) > 1, np.minimum(starts + np.repeat(long, windows), np.repeat(ends, windows)), np.repeat(ends, windows))
        text = np.repeat(text, windows)
    after = np.minimum(ends, len(data) - 1)
    stop = _SENTENCE_END[data[ends - 1]] | (data[after] == 10)
    stop[:-1] |= text[1:] != text[:-1]
    stop[-1] = True
    begin = np.append(0, np.flatnonzero(stop)[:-1] + 1)
    place = np.arange(len(starts)) - np.repeat(begin, np.diff(np.append(begin, len(starts))))
    return starts, ends, stop | (place % SENTENCE_WORDS == SENTENCE_WORDS - 1), text


def repeats(keys: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """True where a unit repeats the one before it in its sentence; such a run counts once."""
    out = np.zeros(len(keys), bool)
    out[1:] = (keys[1:] == keys[:-1]) & ~stop[:-1]
    return out


def subsequences(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(unit, code, weight) of all three-symbol subsequences within a span of six, in order of unit.

    Marks of the unit's start and end count as symbols. Bytes other than letters, digits and those above 127 are
    gaps. A subsequence weighs 0.6 for each place it skips. Spaces inside a unit are left out.
    """
    sizes = ends - starts
    total = np.append(0, np.cumsum(sizes))
    raw = data[np.arange(total[-1]) + np.repeat(starts - total[:-1], sizes)]
    unit = np.repeat(np.arange(len(starts)), sizes)
    solid = raw != 32
    raw, unit = raw[solid], unit[solid]
    sizes = np.bincount(unit, minlength=len(starts))
    total = np.append(0, np.cumsum(sizes + 2))
    symbols = np.zeros(int(total[-1]) + SPAN, np.uint32)
    symbols[total[:-1]], symbols[total[1:] - 1] = _START, _STOP
    symbols[np.arange(len(raw)) + 2 * unit + 1] = _SYMBOL[raw]
    owner = np.append(np.repeat(np.arange(len(starts)), sizes + 2), np.full(SPAN, -1))
    n = int(total[-1])
    codes = np.zeros((n, len(_STEPS)), np.uint32)
    for k, (a, b) in enumerate(_STEPS):
        x, y, z = symbols[:n], symbols[a : n + a], symbols[a + b : n + a + b]
        real = (x > 0) & (y > 0) & (z > 0) & (owner[:n] == owner[a + b : n + a + b])
        codes[:, k] = np.where(real, (x << 12) | (y << 6) | z, 0)
    weights = np.array([GAP ** (a + b - 2) for a, b in _STEPS], np.float32)
    at, k = np.nonzero(codes)
    return owner[at], codes[at, k], weights[k]


# ---- the model ----------------------------------------------------------------------------------

class Kernel:
    """Powers of the normalised kernel between units and landmarks."""

    def __init__(self, landmarks: list[bytes]):
        self.landmarks = landmarks
        raw = np.frombuffer(b"".join(landmarks), np.uint8)
        ends = np.cumsum([len(x) for x in landmarks])
        unit, code, weight = subsequences(raw, ends - [len(x) for x in landmarks], ends)
        distinct, where = np.unique(code, return_inverse=True)
        self.row = np.zeros(1 << 18, np.int32)
        self.row[distinct] = np.arange(1, len(distinct) + 1)
        self.table = np.zeros((len(distinct) + 1, len(landmarks)), np.float32)
        np.add.at(self.table, (where + 1, unit), weight)
        self.table /= np.maximum(np.sqrt((self.table**2).sum(axis=0)), 1e-6)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros((len(starts), len(self.landmarks)), np.float32)
        for low in range(0, len(starts), WORDS_AT_ONCE):
            some = slice(low, low + WORDS_AT_ONCE)
            unit, code, weight = subsequences(data, starts[some], ends[some])
            n = len(out[some])
            norm = np.sqrt(np.bincount(unit, weights=weight**2, minlength=n))
            row = self.row[code]
            known = row > 0
            unit, row, weight = unit[known], row[known], weight[known]
            if len(unit):
                here, first = np.unique(unit, return_index=True)
                cosine = np.add.reduceat(self.table[row] * weight[:, None], first, axis=0) / norm[here, None]
                out[low + here] = np.minimum(cosine, 1) ** POWER
        return out


class Scorer:
    """A fitted model: a unit's share of a margin, a sentence's margin, a text's margin and score."""

    def __init__(self, kernel: Kernel, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.kernel, self.weights, self.bias, self.slope, self.shift = kernel, weights.astype(np.float32), bias, slope, shift
        self.slots = None

    def __getstate__(self):
        return self.__dict__ | {"slots": None, "shares": None}

    def _shares(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """A worker keeps the shares of the units it has met, up to a bound."""
        keys = span_hash(data, starts, ends) | np.uint64(1)
        if self.slots is None or self.slots.used > KEPT_WORDS:
            self.slots, self.shares = _Slots(16), np.zeros(0, np.float32)
        rows = self.slots.find(keys)
        new = np.flatnonzero(rows < 0)
        if len(new):
            distinct, where = np.unique(keys[new], return_index=True)
            found = self.kernel(data, starts[new[where]], ends[new[where]]) @ self.weights
            self.slots.add(distinct, np.arange(len(self.shares), len(self.shares) + len(found), dtype=np.int32))
            self.shares = np.append(self.shares, found)
            rows = self.slots.find(keys)
        return np.where(repeats(keys, stop), 0.0, self.shares[rows])

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each text: the largest margin of its sentences; without units the bias."""
        out = np.full(len(offsets) - 1, -np.inf)
        for a, b in runs_of_bytes(offsets, RUN_BYTES):
            low, high = int(offsets[a]), int(offsets[b])
            for cut in stretches(data, low, high) if b - a == 1 else (high,):
                lowered = LOWER_AZ[data[low:cut]]
                starts, ends, stop, text = units(lowered, np.array([0, cut - low]) if b - a == 1 else offsets[a : b + 1] - low)
                low = cut
                if len(starts):
                    begin = np.append(0, np.flatnonzero(stop)[:-1] + 1)
                    sums = np.add.reduceat(self._shares(lowered, starts, ends, stop), begin) + self.bias
                    here, first = np.unique(text[begin], return_index=True)
                    out[a + here] = np.maximum(out[a + here], np.maximum.reduceat(sums, first))
        return np.where(out == -np.inf, self.bias, out)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(data, offsets) + self.shift, -500, 500)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray | None = None, cost: float = 1.0, steps: int = 12) -> np.ndarray:
    """Linear machine with squared hinge loss, by Newton steps on the rows inside the margin; the last column is 1 (bias)."""
    w = np.zeros(x.shape[1]) if w is None else w
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        left, right = ridge.copy(), np.zeros(x.shape[1])
        for low in range(0, len(x), ROWS_AT_ONCE):
            near, sign, share = x[low : low + ROWS_AT_ONCE], y[low : low + ROWS_AT_ONCE], weight[low : low + ROWS_AT_ONCE]
            inside = (sign * (near @ w.astype(x.dtype)) < 1) & (share > 0)
            near = near[inside]
            part = near * (cost * share[inside])[:, None].astype(x.dtype)
            left += part.T @ near
            right += part.T @ sign[inside].astype(x.dtype)
        new = np.linalg.solve(left, right)
        if np.abs(new - w).max() < 1e-4:
            break
        w = new
    return w


def _platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the margins."""
    ab = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    target = np.where(y > 0, (y > 0).sum() + 1, 1) / np.where(y > 0, (y > 0).sum() + 2, (y <= 0).sum() + 2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + 1e-3 * (ab - (1, 0))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), gradient)
        ab = ab - step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(ab[0], 1e-6)), float(ab[1])


class _Sentences:
    """Units of sample texts: distinct ones, and which sentence and text each stands in."""

    def __init__(self, texts: list[str | None]):
        parts = []
        at = 0
        for first in range(0, len(texts), TEXTS_AT_ONCE):
            data, offsets = flat_bytes(pa.array(texts[first : first + TEXTS_AT_ONCE], pa.string()))
            data = LOWER_AZ[data]
            starts, ends, stop, text = units(data, offsets)
            parts.append((data, starts + at, ends + at, stop, (text + first).astype(np.int32), span_hash(data, starts, ends)))
            at += len(data)
        self.data, starts, ends, stop, self.text, keys = (
            np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind)
            for k, kind in enumerate((np.uint8, np.int64, np.int64, bool, np.int32, np.uint64))
        )
        del parts
        _, first, where = np.unique(keys, return_index=True, return_inverse=True)
        self.unit = where.astype(np.int32)
        self.starts, self.ends = starts[first], ends[first]
        self.unit[repeats(keys, stop)] = len(first)  # stands for nothing
        self.begin = np.append(0, np.flatnonzero(stop)[:-1] + 1) if len(starts) else np.zeros(0, np.int64)
        self.of_text = self.text[self.begin]

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()

    def rows(self, kernel: Kernel) -> np.ndarray:
        """Kernel rows of the distinct units, as half floats, and a row of zeros for repeats."""
        out = np.zeros((len(self.starts) + 1, len(kernel.landmarks)), np.float16)
        for low in range(0, len(self.starts), WORDS_AT_ONCE):
            some = slice(low, min(low + WORDS_AT_ONCE, len(self.starts)))
            out[some] = kernel(self.data, self.starts[some], self.ends[some])
        return out

    def sums(self, per_unit: np.ndarray):
        """(first sentence, end, their sums of rows), some at a time."""
        bounds = np.append(self.begin, len(self.unit))
        for low in range(0, len(self.begin), SENTENCES_AT_ONCE):
            high = min(low + SENTENCES_AT_ONCE, len(self.begin))
            some = per_unit[self.unit[bounds[low] : bounds[high]]]
            yield low, high, np.add.reduceat(some, bounds[low:high] - bounds[low], axis=0, dtype=np.float32)


def fit(texts: list[str | None], labels: list[int], toxic_weight: float = 1.0, other_weight: float = 1.0) -> Scorer:
    """Fit on labelled texts. A text's label goes to its sentences; which sentences of a toxic text carry it is learned.

    Landmarks are units that many more toxic than other texts hold, then those that a first model wrongly takes for
    such. Every fourth text is left for the curve that turns margins into scores.
    """
    y = np.where(np.array(labels) > 0, 1.0, -1.0)
    sample = _Sentences(texts)
    pairs = np.stack(np.divmod(np.unique(sample.unit * np.int64(max(1, len(texts))) + sample.text), max(1, len(texts))), axis=1)
    pairs = pairs[pairs[:, 0] < len(sample.starts)]
    curve = np.arange(len(texts)) % 4 == 3
    learns = ~curve[pairs[:, 1]]
    toxic = np.bincount(pairs[learns & (y[pairs[:, 1]] > 0), 0], minlength=len(sample.starts))
    other = np.bincount(pairs[learns & (y[pairs[:, 1]] < 0), 0], minlength=len(sample.starts))
    n_toxic, n_other = max(1, (y[~curve] > 0).sum()), max(1, (y[~curve] < 0).sum())
    evidence = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((other + 0.5) / (n_other + 1))
    gain = np.where(toxic >= 3, toxic * evidence, -1)
    order = np.lexsort((sample.starts, -gain))
    chosen = [k for k in order[:TOXIC_LANDMARKS] if gain[k] > 0]
    common = [k for k in np.lexsort((sample.starts, -other)) if k not in set(chosen)][: OTHER_LANDMARKS // 2]
    for turn in range(2):
        landmarks = list(dict.fromkeys(sample.word(k) for k in [*chosen, *common])) or [b"a"]
        kernel = Kernel(landmarks)
        raw = np.frombuffer(b"".join(landmarks), np.uint8)
        ends = np.cumsum([len(x) for x in landmarks])
        value, vector = np.linalg.eigh((lambda k: (k + k.T) / 2)(kernel(raw, ends - [len(x) for x in landmarks], ends).astype(np.float64)))
        root = vector / np.sqrt(np.maximum(value, 1e-3)) @ vector.T
        x = np.ones((len(sample.begin), len(landmarks) + 1), np.float32)
        per_unit = sample.rows(kernel)
        for low, high, sums in sample.sums(per_unit):
            x[low:high, :-1] = sums @ root.astype(np.float32)
        of = sample.of_text
        held = np.append(0, np.cumsum(np.append(np.maximum(evidence, 0) * (toxic >= 3), 0)[sample.unit]))
        witness = held[np.append(sample.begin[1:], len(sample.unit))] - held[sample.begin] if len(of) else np.zeros(0)
        w = None
        for _ in range(3):
            if w is not None:
                witness = x @ w.astype(np.float32)
            best = np.full(len(texts), -np.inf)
            np.maximum.at(best, of, witness)
            carries = (y[of] > 0) & (witness >= np.minimum(best[of], 1.0))
            use = (carries | (y[of] < 0)) & ~curve[of]
            target = np.where(carries, 1.0, -1.0)
            some, rest = (use & carries).sum(), (use & ~carries).sum()
            if not some or not rest:
                break
            balance = np.where(use, np.where(carries, 1.0, max(0.02, min(1.0, 10 * some / rest))), 0.0)
            w = _svm(x, target, balance, w)
        if w is None:
            return Scorer(kernel, np.zeros(len(landmarks)), -1.0)
        scorer = Scorer(kernel, root @ w[:-1], float(w[-1]))
        del x
        if turn:
            break
        shares = np.concatenate([per_unit[i : i + 50_000].astype(np.float32) @ scorer.weights for i in range(0, len(per_unit), 50_000)])[:-1]
        del per_unit
        wrong = np.lexsort((sample.starts, -np.where((evidence < 0.5) & (other >= 1), shares, -np.inf)))[: OTHER_LANDMARKS // 2]
        common = list(dict.fromkeys([*common[: OTHER_LANDMARKS // 2], *wrong]))
    data, offsets = flat_bytes(pa.array(texts, pa.string()))
    margin = scorer.margins(data, offsets)[curve]
    scorer.slope, scorer.shift = _platt(margin, y[curve], np.where(y[curve] > 0, toxic_weight, other_weight))
    return scorer


# ---- Spark --------------------------------------------------------------------------------------

def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS, longest: int = SAMPLE_BYTES) -> Scorer:
    """Fit on a bounded sample: at most ``toxic_rows`` and ``other_rows`` labelled texts of ``longest`` bytes or less.

    Rows are drawn by a hash of the key among those whose CRC-32 is not 2 modulo 4. Several labels of a key: the
    largest. The rest of the table only counts, so that scores fit the share of toxic rows.
    """
    marked = (
        labels.select(F.col(key).alias("key"), F.col(label).alias("y")).filter("key is not null and y is not null")
        .filter(F.pmod(crc32_of(F.col("key")), F.lit(4)) != 2).groupBy("key").agg(F.max("y").alias("y"))
    )
    counts = {int(r["t"]): r["n"] for r in marked.groupBy((F.col("y") > 0).cast("int").alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.xxhash64("key")
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.octet_length("text") <= longest)
    found = []
    for toxic, most in ((1, toxic_rows), (0, other_rows)):
        drawn = marked.filter((F.col("y") > 0) == F.lit(bool(toxic))).orderBy(draw, "key").limit(most).select("key")
        rows = texts.join(F.broadcast(drawn), "key").orderBy(draw, "key", "text").limit(most).collect()
        found += [(toxic, r["text"], r["key"]) for r in rows]
    found.sort(key=lambda r: (str(r[2]), r[1]))
    sizes = Counter(r[0] for r in found)
    weight = {t: counts.get(t, 0) / max(sizes[t], 1) / max(1, sum(counts.values())) * max(1, len(found)) for t in (0, 1)}
    return fit([r[1] for r in found], [r[0] for r in found], weight[1], weight[0])


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
                   threshold: float = THRESHOLD) -> DataFrame:
    """Every row with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold).

    The kernel of two units counts their common three-letter subsequences, those with gaps less; normalised and
    raised to the third power, and summed over the units of a sentence (a repeated unit counts once). Landmark units span the space in which the
    machine is trained (Nyström). Of a text the sentence with the largest margin counts, wherever it stands.

    Scoring is one narrow pass: a text's bytes go to Arrow functions and a number comes back. A text of more than 1 MB is scored in
    stretches cut at line ends, or at spaces where there are none. Null and empty texts get the score of a text without units; equal
    rows score alike, and an empty table gives an empty one. ``held_out``: CRC-32 of the key as text is 2 modulo 4; never learned from.
    Without labels of both kinds every score is below one half. An input column with the name of a result is replaced.
    """
    scorer = learn(docs, labels, key, text, label)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array(scorer.scores(*flat_bytes(column)))

    carried = without(docs, RESULT)
    own, held = fresh(docs, "_score"), F.pmod(crc32_of(F.col(key)), F.lit(4)) == 2
    return docs.select(*carried, held.alias("held_out"), score(F.col(text)).alias(own)).select(
        *carried, "held_out", F.col(own).alias("score"), (F.col(own) >= threshold).cast("int").alias("predicted")
    )
