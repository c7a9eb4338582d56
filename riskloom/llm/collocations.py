"""Phrase collocations from stripes: each prefix keys an associative counter of the words that follow it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from ..session import write_table
from .bytescan import LOWER_AZ, flat_bytes, mix, runs_of_bytes, span_hash
from .common import give_back

CHUNK_BYTES = 8 << 20
GROUP_WORDS = 2_000_000
BUCKETS_A_ROUND = 128
HOT_SHARE = 1024
LONGEST = 4
SCALE = 2_000_000

#: Bytes that end a piece, and those that end a word.
_MARK, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP[list(b" \t")] = True
_GAP |= _MARK

_BLOCK = pa.schema([
    ("lang", pa.string()), ("bucket", pa.int64()), ("part", pa.int32()), ("rows", pa.int64()), ("words", pa.binary()),
    ("shared", pa.binary()), ("next", pa.binary()), ("counts", pa.binary()),
])
_BLOCK_DDL = "lang string, bucket long, part int, rows long, words binary, shared binary, next binary, counts binary"
_PHRASE = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.int64())), ("a", pa.int64()), ("right", pa.int64())])


def _stretches(data: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, read to) of a text's stretches of about CHUNK_BYTES; a stretch also reads the words that follow its last one."""
    while high - low > CHUNK_BYTES:
        span = CHUNK_BYTES
        while not len(gaps := np.flatnonzero(_GAP[data[low + 1 : min(low + span, high)]])) and low + span < high:
            span *= 2
        if not len(gaps):
            break
        cut, look = low + 1 + int(gaps[-1]), 1 << 12
        while True:
            gap = _GAP[data[cut : min(cut + look, high)]]
            ends = np.flatnonzero(gap[1:] & ~gap[:-1])
            if len(ends) >= LONGEST - 1 or cut + look >= high:
                break
            look *= 2
        yield low, cut, cut + 1 + int(ends[LONGEST - 2]) if len(ends) >= LONGEST - 1 else high
        low = cut
    yield low, high, high


def _chunks(batches: Iterator[pa.RecordBatch]):
    """(bytes in lower-case A-Z, start and end of each word, whether the next word is in the same piece, number of words that count,
    language of each word, languages) of about CHUNK_BYTES of text at a time."""
    for batch in batches:
        data, offsets = flat_bytes(batch.column("text"))
        langs = batch.column("lang").dictionary_encode()
        lang_of, names = langs.indices.to_numpy(), langs.dictionary.to_pylist()
        for first, last in runs_of_bytes(offsets, CHUNK_BYTES):
            at = offsets[first : last + 1]
            many = last - first > 1
            for low, cut, high in [(int(at[0]), int(at[-1]), int(at[-1]))] if many else _stretches(data, int(at[0]), int(at[-1])):
                part = LOWER_AZ[data[low:high]]
                if not len(part):
                    continue
                solid = ~_GAP[part]
                begin, end = solid.copy(), solid.copy()
                begin[1:] &= ~solid[:-1]
                end[:-1] &= ~solid[1:]
                inner = at[1:-1] - low if many else np.zeros(0, np.int64)
                inner = inner[(inner > 0) & (inner < len(part))]
                begin[inner] = solid[inner]
                end[inner - 1] = solid[inner - 1]
                starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
                if not len(starts):
                    continue
                marks = np.cumsum(_MARK[part], dtype=np.int32)[starts]
                text = np.searchsorted(inner, starts, "right").astype(np.int32)
                same = np.append((marks[1:] == marks[:-1]) & (text[1:] == text[:-1]), False)
                yield part, starts, ends, same, int(np.searchsorted(starts, cut - low)), lang_of[first + np.searchsorted(at[1:-1] - low, starts, "right")] if many else np.full(len(starts), lang_of[first]), names


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, never 0."""
    return np.maximum(span_hash(data, starts, ends), np.uint64(1))


def _take_spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    at = np.append(0, np.cumsum(sizes))
    raw = data[np.arange(at[-1]) + np.repeat(starts - at[:-1], sizes)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, w, word, follows, n): counts of words by chunk, and pairs that make up a large share of a chunk (no ``word``)."""
    for data, starts, ends, same, own, lang, names in _chunks(batches):
        h = _hashes(data, starts, ends)
        key = h + mix(lang.astype(np.uint64), 5)
        _, at, n = np.unique(key[:own], return_index=True, return_counts=True)
        text = _take_spans(data, starts[at], ends[at] - starts[at]).cast(pa.binary())
        pairs = np.flatnonzero(same[:own])
        twice, pair_at, pair_n = np.unique(mix(key[pairs], 6) + h[np.minimum(pairs + 1, len(h) - 1)], return_index=True, return_counts=True)
        hot = pair_n * HOT_SHARE > 2 * max(own, 1)
        p, none = pairs[pair_at[hot]], pa.nulls(int(hot.sum()), pa.binary())
        label = pa.array(names, pa.string())
        yield pa.RecordBatch.from_arrays(
            [label.take(pa.array(np.append(lang[at], lang[p]))), pa.array(np.append(h[at], h[p]).view(np.int64)),
             pa.concat_arrays([text, none]), pa.array(np.append(np.zeros(len(at), np.int64), h[p + 1].view(np.int64) if len(p) else h[:0].view(np.int64))),
             pa.array(np.append(n, pair_n[hot]))],
            ["lang", "w", "word", "follows", "n"],
        )
        del h, key, at, n, text, twice, pair_at, pair_n
        give_back()


def _packed(values: np.ndarray) -> bytes:
    size = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    if n:
        for k, plane in enumerate(np.frombuffer(raw, np.uint8).reshape(-1, n)):
            out |= plane.astype(np.int64) << (8 * k)
    return out


def _bucket(w: list[np.ndarray], buckets) -> np.ndarray:
    pair = mix(mix(w[0], 7) + w[1], 8)
    return (((pair >> np.uint64(32)) * np.asarray(buckets, np.uint64)) >> np.uint64(32)).astype(np.int64)


def _ordered(group: np.ndarray, rows: list[np.ndarray], width: int, counts: np.ndarray | None):
    """Distinct (group, four ranks) in order with summed counts, and how many leading words each shares with the one before."""
    lead, mid = group * width + rows[0], rows[1].astype(np.int64) * width + rows[2]
    order = np.lexsort((rows[3], mid, lead))
    rows, group = [r[order] for r in rows], group[order]
    shared = np.zeros(len(order), np.uint8)
    same = np.append(False, group[1:] == group[:-1]) if len(group) else np.zeros(0, bool)
    for r in rows:
        same[1:] &= r[1:] == r[:-1]
        shared += same
    first = np.flatnonzero(shared < LONGEST)
    counts = np.diff(np.append(first, len(order))) if counts is None else np.add.reduceat(counts[order], first) if len(first) else counts[:0]
    return group[first], [r[first] for r in rows], shared[first], counts


def _blocks(group: np.ndarray, label, hashes: np.ndarray, rows: list[np.ndarray], counts: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """One row per group: its own sorted words, and its counters front-coded (a prefix is told once for all words that follow it).

    ``rows`` are places in ``hashes``, 0 for no word; ``label`` gives (lang, bucket, part) of a group.
    """
    group, rows, shared, counts = _ordered(group, rows, len(hashes), counts)
    bounds = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
    out = {f.name: [] for f in _BLOCK}
    for a, b in zip(bounds[:-1], bounds[1:]):
        new = [r[a:b][shared[a:b] <= d] for d, r in enumerate(rows)]
        flat = np.concatenate(new)
        own, where = np.unique(flat, return_inverse=True)
        lang, bucket, part = label(int(group[a]))
        for name, value in zip(out, (lang, bucket, part, int(b - a), hashes[own].tobytes(), shared[a:b].tobytes(), _packed(where), _packed(counts[a:b]))):
            out[name].append(value)
        if len(out["lang"]) == 256:
            yield pa.RecordBatch.from_pydict(out, _BLOCK)
            out = {f.name: [] for f in _BLOCK}
    if out["lang"]:
        yield pa.RecordBatch.from_pydict(out, _BLOCK)


def _parts(hot: dict, lang: str, w: list[np.ndarray], parts: int) -> np.ndarray:
    """Which part of its pair's counters a row belongs to: 0, or by the third word for the pairs that are known to be frequent."""
    known = hot.get(lang)
    if known is None:
        return np.zeros(len(w[0]), np.int64)
    key = mix(w[0], 7) + w[1]
    is_hot = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
    return np.where(is_hot, 1 + (mix(w[2], 9) >> np.uint64(33)).astype(np.int64) % parts, 0)


def _send(buckets: dict[str, int], hot: dict, parts: int):
    """Chunks of text to blocks of counters."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, starts, ends, same, own, lang, names in _chunks(batches):
            hashes, places = np.unique(_hashes(data, starts, ends), return_inverse=True)
            hashes = np.append(np.uint64(0), hashes)
            rows, goes_on = [(places + 1).astype(np.int32)], np.ones(len(places), bool)
            for _ in range(LONGEST - 1):
                goes_on = goes_on & np.append(same[len(rows) - 1 :], np.zeros(len(rows) - 1, bool))[: len(places)]
                rows.append(np.where(goes_on, np.append(rows[0][len(rows) :], np.zeros(len(rows), np.int32))[: len(places)], 0).astype(np.int32))
            own = np.flatnonzero((rows[1] > 0) & (np.arange(len(places)) < own))
            rows, lang = [r[own] for r in rows], lang[own]
            w = [hashes[r] for r in rows[:3]]
            part = np.zeros(len(own), np.int64)
            for number in np.unique(lang):
                mine = lang == number
                part[mine] = _parts(hot, names[number], [x[mine] for x in w], parts)
            many = np.array([buckets.get(name, 1) for name in names], np.int64)
            offset = np.cumsum(many) - many
            dense, group = np.unique((offset[lang] + _bucket(w, many[lang])) * (parts + 1) + part, return_inverse=True)

            def label(g: int) -> tuple[str, int, int]:
                at, of_part = divmod(int(dense[g]), parts + 1)
                number = int(np.searchsorted(offset, at, "right")) - 1
                return names[number], at - int(offset[number]), of_part

            yield from _blocks(group, label, hashes, rows, None)
            del group, dense, part, w, rows, places, hashes, goes_on
            give_back()

    return send


def _met(blocks: list[dict]):
    """The blocks of one group as rows of ranks in their common words, with counts."""
    own = [np.frombuffer(b["words"], np.uint64) for b in blocks]
    hashes = np.unique(np.concatenate([np.zeros(1, np.uint64), *own]))
    rows, counts = [[] for _ in range(LONGEST)], []
    for b, words in zip(blocks, own):
        shared = np.frombuffer(b["shared"], np.uint8)
        new = [shared <= d for d in range(LONGEST)]
        sizes = [int(x.sum()) for x in new]
        ranks = np.searchsorted(hashes, words).astype(np.int32)[_unpacked(b["next"], sum(sizes))]
        at = 0
        for d in range(LONGEST):
            rows[d].append(ranks[at : at + sizes[d]][np.cumsum(new[d]) - 1])
            at += sizes[d]
        counts.append(_unpacked(b["counts"], b["rows"]))
    return hashes, [np.concatenate(r) for r in rows], np.concatenate(counts)


def _groups(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[tuple[tuple, list[dict]]]:
    """Blocks of the same (lang, bucket, part), which come one after another; at most about ``most`` rows at a time."""
    held, key, size = [], None, 0
    for batch in batches:
        for row in range(len(batch)):
            b = {name: column[row].as_py() for name, column in zip(batch.schema.names, batch.columns)}
            now = (b["lang"], b["bucket"], b["part"])
            if held and (now != key or (most and size >= most)):
                yield key, held
                held, size = [], 0
            held.append(b)
            key, size = now, size + b["rows"]
    if held:
        yield key, held


def _again(buckets: dict[str, int]):
    """Blocks merged and dealt to finer buckets, for inputs beyond one round."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lang, _, part), blocks in _groups(batches, GROUP_WORDS):
            hashes, rows, counts = _met(blocks)
            yield from _blocks(_bucket([hashes[r] for r in rows[:2]], buckets.get(lang, 1)), lambda g: (lang, g, part), hashes, rows, counts)

    return again


def _frequent(least: int):
    """Merged counters to phrases of two words and more that occur often enough, and the most frequent word after each.

    The pairs of a part that has siblings come whatever their count, as the siblings hold the rest of it.
    """

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lang, _, part), blocks in _groups(batches, None):
            hashes, rows, counts = _met(blocks)
            _, rows, shared, counts = _ordered(np.zeros(len(counts), np.int64), rows, len(hashes), counts)
            firsts = [np.flatnonzero(shared < d) for d in range(2, LONGEST + 1)]
            totals = [np.where(rows[d + 1][at] > 0, np.add.reduceat(counts, at), 0) for d, at in enumerate(firsts)]
            for d, (at, total) in enumerate(zip(firsts, totals)):
                after = np.maximum.reduceat(totals[d + 1], np.searchsorted(firsts[d + 1], at)) if d + 1 < len(totals) else np.zeros(len(at), np.int64)
                after[after < least] = 0
                keep = np.flatnonzero(total >= (1 if part and d == 0 else least))
                words = np.stack([hashes[r[at[keep]]] for r in rows[: d + 2]], axis=1).reshape(-1).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * (d + 2)), pa.array(words))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keep), pa.string()), lists, pa.array(total[keep]), pa.array(after[keep])], schema=_PHRASE)
            del blocks, rows, shared, counts, firsts, totals
            give_back()

    return frequent


def _exact(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = 30, covered: int = 80, top: int = 2000, text: str = "text", lang: str = "lang",
                 group_words: int = GROUP_WORDS, round_buckets: int = BUCKETS_A_ROUND) -> DataFrame:
    """The best phrases of two to four words in each language: (lang, rank, phrase, a, l, r, n, score).

    A text in lower-case A-Z falls into pieces at ``.,;:!?`` and line ends, and those into words at spaces and tabs. A phrase that
    occurs ``least`` times or more (a) is scored at its weakest cut, floor(2000000 a / (l + r)) with l and r the counts of
    both sides; of equal cuts the first counts. It is dropped if one more word before or after it keeps ``covered`` percent of
    its occurrences (a longer phrase around it implies one that is one word longer). n: words of the language.

    Stripes: a pair of words keys the nested counters of the words that follow it. Each chunk of about 8 MB of text sends its counters
    packed, in blocks by a hash of the pair; merged elementwise, one structure gives the phrases, their prefixes' totals and the largest
    extension. The pairs that hold a thousandth of all words or more (at most 1,024) are spread by their third word. The first round
    deals to 128 buckets, shared by the languages in proportion, so what an entry costs does not depend on the size of the input; where a
    bucket would hold more than two million words, merged blocks are dealt again to up to 128 times as many. All else
    works on frequent words and phrases only. A word stands for itself by 64 bits inside the counters; its text comes
    from the table of words.

    Null and empty texts have no words; a null language is ``und``; equal rows count each; ties in score and count
    go by the UTF-8 bytes of the phrase. Other columns are not read. An empty table gives no rows.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    counted = rows.mapInArrow(_count_words, "lang string, w long, word binary, follows long, n long")
    counted = write_table(counted.groupBy("lang", "w", "word", "follows").agg(F.sum("n").alias("n")), "words")
    words = counted.filter("word is not null").drop("follows")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    parts = max(2, min(4096, -(-total // group_words)))
    hot: dict = {}
    for r in counted.filter(F.col("word").isNull() & (F.col("n") * HOT_SHARE >= total)).collect():  # at most HOT_SHARE rows
        pair = np.array([r.w, r.follows]).view(np.uint64)
        hot.setdefault(r.lang, []).append(mix(pair[:1], 7) + pair[1:])
    hot = {k: np.sort(np.concatenate(v)) for k, v in hot.items()}

    # languages that get more than one bucket: at most one for each ``group_words`` of the input, and ``round_buckets``
    some = sizes.filter((F.col("n") > group_words) | (F.col("n") * round_buckets > total)).collect()
    wanted = {r.lang: -(-r.n // group_words) for r in some}
    now = {r.lang: -(-r.n * round_buckets // total) for r in some}
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(sum(wanted.values()), 20_000))
    blocks = rows.mapInArrow(_send(now, hot, parts), _BLOCK_DDL)
    while True:
        dealt = blocks.repartition(tasks, "lang", "bucket", "part").sortWithinPartitions("lang", "bucket", "part")
        if all(wanted[k] <= now[k] for k in now):
            break
        now = {k: max(now[k], min(wanted[k], now[k] * round_buckets)) for k in now}
        blocks = dealt.mapInArrow(_again(now), _BLOCK_DDL)
    found = dealt.mapInArrow(_frequent(least), "lang string, words array<long>, a long, right long")
    phrases = write_table(found.groupBy("lang", "words").agg(F.sum("a").alias("a"), F.max("right").alias("right")).filter(F.col("a") >= least), "phrases")
    scored = _scored(phrases, words.filter(F.col("n") >= least), least, covered)

    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = write_table(scored.withColumn("_rank", F.rank().over(best)).filter(F.col("_rank") <= top).drop("_rank"), "near")
    spelled = near.select("lang", "words", F.posexplode("words").alias("at", "w"))
    spelled = spelled.join(words.select("lang", "w", F.col("word").cast("string").alias("word")), ["lang", "w"])
    spelled = spelled.groupBy("lang", "words").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("_words"))
    named = near.join(spelled, ["lang", "words"]).withColumn("phrase", F.array_join(F.transform("_words", lambda x: x["word"]), " "))
    ranked = named.join(sizes, "lang").withColumn("rank", F.row_number().over(best.orderBy(F.desc("score"), F.desc("a"), "phrase")))
    return ranked.filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _scored(phrases: DataFrame, words: DataFrame, least: int, covered: int) -> DataFrame:
    """(lang, words, a, l, r, score) of the phrases that no longer one covers.

    Every phrase asks for the counts of its first words and of its rest at each cut, and for the largest count with one more
    word before it; all answers come from one table of frequent words and phrases in one join.
    """
    size = F.size("words")
    own = phrases.select("lang", "words", F.col("a").alias("f"), F.lit(0).cast("long").alias("left"))
    single = words.select("lang", F.array("w").alias("words"), F.col("n").alias("f"), F.lit(0).cast("long").alias("left"))
    longer = phrases.filter(size > 2).select("lang", F.slice("words", F.lit(2), size - 1).alias("words"), F.lit(0).cast("long").alias("f"), F.col("a").alias("left"))
    table = own.unionByName(single).unionByName(longer).groupBy(F.struct("lang", "words").alias("key")).agg(F.max("f").alias("f"), F.max("left").alias("left"))
    asked = [F.struct(F.lit("self").alias("role"), F.col("words").alias("part"))]
    for k in range(1, LONGEST):
        for role, part in ((f"l{k}", F.slice("words", 1, k)), (f"r{k}", F.slice("words", F.lit(k + 1), size - k))):
            asked.append(F.when(size > k, F.struct(F.lit(role).alias("role"), part.alias("part"))))
    requests = phrases.select("lang", "words", "a", "right", F.xxhash64("lang", "words").alias("nr"), F.explode(F.array_compact(F.array(*asked))).alias("ask"))
    requests = requests.select("lang", "words", "a", "right", "nr", "ask.role", F.struct("lang", F.col("ask.part").alias("words")).alias("key"))
    met = lookup_join(requests, write_table(table, "lookup"), "key")
    roles = [f"{side}{k}" for k in range(1, LONGEST) for side in "lr"]
    back = met.groupBy("lang", "words").agg(
        F.max("a").alias("a"), F.max("right").alias("right"), F.max(F.when(F.col("role") == "self", F.col("left"))).alias("left"),
        *[F.max(F.when(F.col("role") == role, F.col("f"))).alias(role) for role in roles],
    )
    around = F.greatest("left", "right")
    kept = back.filter((around < least) | (_exact(around) * 100 < _exact("a") * covered))
    cuts = [
        F.when(size > k, F.struct(
            F.expr(f"(cast({SCALE} as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l{k} as decimal(19,0)) + cast(r{k} as decimal(19,0)))").alias("score"),
            F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"),
        ))
        for k in range(1, LONGEST)
    ]
    return kept.withColumn("cut", F.array_min(F.array(*cuts))).select("lang", "words", "a", "cut.l", "cut.r", "cut.score")
