"""The queries of the training-data operators, each over its whole table, and their SQL where SQL can tell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .alignment import align_tokens
from .collocations import collocations
from .common import table
from .exact_dedup import exact_dedup
from .interpolated_lm import score_texts
from .licenses import PHRASES, TEMPLATES, scan_licenses, step_of, template_words
from .mixing import mix_sources
from .multi_index import nearest
from .packing import pack
from .simhash import near_duplicates
from .slack_packing import pack_windows
from .token_counts import count_tokens
from .token_files import read_token_files, write_token_files
from .toxicity import score_toxicity

TOKENIZER_FILE = "byte_bpe_50k.json"
TOKEN_LIMIT = 512


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_interpolated_lm(spark: SparkSession, folder: str) -> DataFrame:
    return score_texts(table(spark, folder, "documents"))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = score_toxicity(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"))
    return scored.drop("text")


def op3_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), carry=["doc_id"]).drop("kept")


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, folder, "documents"), path, tokenizer_path())
    return read_token_files(spark, path)


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents"), carry=["doc_id"])


def op6_inverted_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"))


def op7_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), tokenizer_path())


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(table(spark, folder, "documents"), carry=["doc_id"])


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = count_tokens(table(spark, folder, "documents"), tokenizer_path(), keep=["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


def op12_slack_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_windows(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align_tokens(table(spark, folder, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_interpolated_lm, op2_toxicity, op3_simhash_near_dedup, op4_token_files, op5_exact_dedup, op6_inverted_multi_index, op7_source_mixing,
        op8_best_fit_packing, op9_license_scan, op10_token_counts, op11_phrase_collocations, op12_slack_packing, op13_token_alignment,
    )
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _license_sql() -> str:
    """Every block against every template, without index or filters."""
    places = []
    for phrase in PHRASES.values():
        tests = " AND ".join(f"words[i + {k + 1}] = '{p}'" for k, p in enumerate(phrase.split()))
        places.append(f"list_filter(range(0, len(words)), lambda i: coalesce({tests}, false))")
    rows = ", ".join(f"('{name}', {template_words(notice)!r}, {step_of(notice)}, {names!r})" for name, (notice, names) in sorted(TEMPLATES.items()))
    known = ", ".join(sorted({repr(w) for notice, _ in TEMPLATES.values() for w in template_words(notice)}))
    base = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(PHRASES))
    return rf"""
        WITH d AS (
            SELECT row_number() OVER () AS nr, doc_id,
                   trim(regexp_replace({_LOWERED}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS plain FROM documents
        ), w AS (
            SELECT nr, doc_id, CASE WHEN plain = '' THEN [] ELSE string_split(plain, ' ') END AS words FROM d
        ), p AS (
            SELECT nr, doc_id, words, {", ".join(f"{x} AS p{k}" for k, x in enumerate(places))} FROM w
        ), t(label, tokens, step, names) AS (VALUES {rows}),
        total AS (SELECT coalesce(sum(len(words)), 0)::BIGINT AS total FROM w),
        seen AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM w) GROUP BY word),
        weights AS (
            SELECT map_from_entries(list((word, greatest(1, length(ltrim(bin(total // greatest(coalesce(n, 1), 1)), '0'))))))  AS weight
            FROM (SELECT unnest([{known}]) AS word) LEFT JOIN seen USING (word), total
        ), b AS (
            SELECT nr, step, unnest(list_transform(range(0, len(words), step), lambda s: words[s + 1 : s + 2 * step])) AS block
            FROM w, (SELECT DISTINCT step FROM t)
        ), f AS (
            SELECT nr, list(DISTINCT label) AS found, max(common / whole::DOUBLE) AS score
            FROM (
                SELECT nr, label, names, block, list_sum(list_transform(list_intersect(tokens, block), lambda x: weight[x]))::BIGINT AS common,
                       list_sum(list_transform(tokens, lambda x: weight[x]))::BIGINT AS whole
                FROM b JOIN t USING (step), weights
            )
            WHERE 10 * common >= 8 * whole
              AND len(list_filter(names, lambda n: NOT contains(' ' || array_to_string(block, ' ') || ' ', ' ' || n || ' '))) = 0
            GROUP BY nr
        ), j AS (
            SELECT p.*, coalesce(found, []) AS found, f.score, p0 || p1 || p2 AS places,
                   list_filter([{base}], lambda x: x IS NOT NULL) AS base FROM p LEFT JOIN f USING (nr)
        )
        SELECT doc_id, len(words)::BIGINT AS n_words, len(places)::BIGINT AS n_base,
               list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
               coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
               coalesce(array_to_string(list_sort(list_distinct(base || found)), ','), '') AS labels,
               CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0::DOUBLE) END AS score
        FROM j"""


SQL = {
    "op11_phrase_collocations": rf"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ), w AS (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p
        ), s AS (
            SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w
        ), f AS (
            SELECT lang, k AS m, array_to_string(words[i : i + k - 1], ' ') AS phrase, count(*) AS f
            FROM s, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(words) GROUP BY ALL
        ), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
        c AS (SELECT *, string_split(phrase, ' ') AS words FROM f WHERE m > 1 AND f >= 30),
        inside AS (
            SELECT DISTINCT c.lang, c.f, array_to_string(words[i : i + k - 1], ' ') AS phrase
            FROM c, (SELECT unnest([1, 2, 3, 4]) AS i), (SELECT unnest([2, 3]) AS k) WHERE k < m AND i + k - 1 <= m
        ), dropped AS (
            SELECT DISTINCT c.lang, c.phrase FROM c JOIN inside USING (lang, phrase) WHERE 100::HUGEINT * inside.f >= 80::HUGEINT * c.f
        ), cuts AS (
            SELECT c.lang, c.phrase, c.f AS a, k, array_to_string(words[1:k], ' ') AS first_part, array_to_string(words[k + 1 :], ' ') AS rest
            FROM c ANTI JOIN dropped USING (lang, phrase), (SELECT unnest([1, 2, 3]) AS k) WHERE k < m
        ), scored AS (
            SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f::HUGEINT + y.f))::BIGINT AS score
            FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first_part JOIN f y ON y.lang = cuts.lang AND y.phrase = rest
        ), weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM weakest JOIN n USING (lang) QUALIFY rank <= 2000""",
    "op9_license_scan": _license_sql(),
    "op5_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWERED}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
        FROM d""",
    "op7_source_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
            FROM d GROUP BY source
        ), levels AS (
            SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER earlier, 0))
                      / sum(weight) OVER later AS level, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source) AS nth
            FROM s
            WINDOW earlier AS (ORDER BY 2.0::DOUBLE * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                   later AS (ORDER BY 2.0::DOUBLE * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
        ), one AS (
            SELECT coalesce(min_by(level, nth) FILTER (level * weight <= 2 * source_size), 0) AS level FROM levels
        ), t AS (
            SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * one.level) AS target FROM s, one
        ), r AS (
            SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                   (('0x' || substr(md5('7:mix:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target,
               (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM r""",
}
