"""Queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.byte_bpe import round_trip_digests
from skein.llm.common import table
from skein.llm.decontaminate import contaminated
from skein.llm.exact_dedup import exact_dedup
from skein.llm.jaccard_join import near_duplicates
from skein.llm.lexical import ranked
from skein.llm.line_dedup import line_report
from skein.llm.lm_score import lm_scores
from skein.llm.packing import pack
from skein.llm.pii import find_pii, pii_digest
from skein.llm.whitening import whitened_components
from skein.llm import html_text, quality, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=85)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(find_pii(table(spark, sf_dir, "documents")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def public_tokenizer(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizer("word_bpe_49k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op4_pii that SQL can state: counts and digest of the base spans."""
    return op4_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op10_lm_score that SQL can state: tokens, training counts and the base score."""
    found = op10_lm_score(spark, sf_dir)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


def bpe_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op11_byte_bpe that SQL can state: what the ids decode to."""
    return op11_byte_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def whitening_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op12_whitening that SQL can state: the fit list's size and the exact deviations, for each component."""
    return op12_whitening(spark, sf_dir).select("vec_id", "component", "n", "deviation")


def queries() -> dict[str, Query]:
    """Name to query, each over its whole table."""
    found = (op1_ngram_jaccard, op2_exact_dedup, op3_decontamination, op4_pii, op5_quality, op6_line_dedup, op7_html_text, op8_packing, op9_toxicity, op10_lm_score)
    found += (op11_byte_bpe, op12_whitening, op13_lexical_search, pii_base_spans, lm_base_scores, bpe_round_trips, whitening_deviations)
    return {f.__name__: f for f in found}


#: A-Z alone change case; DuckDB's lower() would also change other letters.
FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": f"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({FOLDED}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
              ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS sh FROM w),
        e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x)
        SELECT s.doc_id, len(s.sh) AS n_shingles, min(r.y) AS component_id FROM s JOIN r ON r.x = s.doc_id GROUP BY s.doc_id, s.sh
    """,
    "op2_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({FOLDED}) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
        FROM d JOIN g USING (text_sha256)
    """,
}


ORACLES["op6_line_dedup"] = """
    WITH w AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS no FROM w),
    d AS (SELECT line, length(line) AS n, min(doc_id * 10000000 + no) AS ord FROM l WHERE line <> '' GROUP BY line),
    h AS (SELECT line, n, ord, unnest([n, n - 1, n, n - 1]) AS m, unnest([0, 0, 1, 1]) AS side FROM d),
    k AS (SELECT line, n, ord, m, side, CASE WHEN side = 0 THEN left(line, m // 2) ELSE right(line, m // 2) END AS half FROM h),
    p AS (SELECT DISTINCT a.line AS x, b.line AS y, a.n AS n, b.n AS m FROM k a JOIN k b ON a.m = b.m AND a.side = b.side AND a.half = b.half AND b.ord < a.ord),
    g AS (SELECT DISTINCT x FROM p WHERE CASE
        WHEN n = m THEN list_sum(list_transform(range(1, n + 1), lambda i: (substr(x, i, 1) <> substr(y, i, 1))::INT)) <= 1
        WHEN n = m + 1 THEN list_bool_or(list_transform(range(0, n), lambda i: left(x, i) || substr(x, i + 2) = y))
        WHEN m = n + 1 THEN list_bool_or(list_transform(range(0, m), lambda i: left(y, i) || substr(y, i + 2) = x))
        ELSE false END),
    r AS (SELECT l.doc_id, l.no, l.line = '' OR (d.ord = l.doc_id * 10000000 + l.no AND g.x IS NULL) AS kept
          FROM l LEFT JOIN d ON l.line = d.line LEFT JOIN g ON l.line = g.x)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE kept) AS n_kept,
           coalesce(string_agg(CASE WHEN NOT kept THEN no::VARCHAR END, ',' ORDER BY no), '') AS dropped_lines
    FROM r GROUP BY doc_id
"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
ORACLES["pii_base_spans"] = f"""
    WITH k(ord, kind, pat) AS (VALUES (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+'), (2, 'ip', '[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)'),
        (3, 'card', '[0-9](?:[\\x20-]?[0-9])+'), (4, 'phone', '\\+[0-9][\\x20().0-9-]+[0-9]')),
    m AS (SELECT doc_id, ord, kind, regexp_extract_all(text, pat) AS ms, string_split_regex(text, pat) AS ps FROM documents, k WHERE regexp_matches(text, pat)),
    s AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m),
    p AS (SELECT doc_id, ord, kind, ms[i] AS v, (list_sum(list_transform(ps[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda z: length(z))), 0))::BIGINT AS st FROM s),
    d AS (SELECT *, {_DIGITS} AS ds FROM p),
    ok AS (SELECT doc_id, ord, kind, st, st + length(v) AS en FROM d WHERE CASE kind WHEN 'ip' THEN list_bool_and(list_transform(string_split(v, '.'), lambda z: length(ltrim(z, '0')) <= 3 AND coalesce(try_cast(ltrim(z, '0') AS INT), 0) <= 255))
        WHEN 'card' THEN length(ds) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(ds) + 1), lambda j: CASE WHEN (length(ds) - j) % 2 = 0 THEN ds[j]::INT WHEN ds[j]::INT > 4 THEN ds[j]::INT * 2 - 9 ELSE ds[j]::INT * 2 END)) % 10 = 0
        WHEN 'phone' THEN length(ds) BETWEEN 9 AND 15 ELSE true END),
    g AS (SELECT doc_id, count(*) FILTER (WHERE ord = 1) AS e, count(*) FILTER (WHERE ord = 2) AS i, count(*) FILTER (WHERE ord = 3) AS c, count(*) FILTER (WHERE ord = 4) AS p, string_agg(kind || ':' || st || ':' || en, ',' ORDER BY ord, st) AS j FROM ok GROUP BY doc_id)
    SELECT doc_id, coalesce(e, 0) AS n_email, coalesce(i, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(p, 0) AS n_phone, sha256(coalesce(j, '')) AS base_sha256 FROM documents LEFT JOIN g USING (doc_id)
"""

#: crc32 of doc_id as text, byte by byte and bit by bit.
CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"""
ORACLES["lm_base_scores"] = f"""
    WITH w AS (SELECT doc_id, {CRC32} % 7 = 2 AS held_out, list_append(list_filter(string_split_regex({FOLDED}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), chr(10)) AS ws FROM documents),
    t AS (SELECT doc_id, held_out, unnest(ws) AS word FROM w),
    c AS (SELECT word, count(*) AS c FROM t WHERE NOT held_out GROUP BY word),
    n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c)
    SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (WHERE c.c > 0) AS n_known, any_value(n.n) AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 1) / (n.n + v + 1))), 3) AS base_score
    FROM t LEFT JOIN c USING (word), n GROUP BY doc_id, held_out
"""


ORACLES["bpe_round_trips"] = "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents"

ORACLES["whitening_deviations"] = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)::BIGINT + 1000000) AS x FROM embeddings
               WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda c: coalesce(isfinite(c), false)))),
    f AS (SELECT DISTINCT x FROM v), n AS (SELECT count(*) AS n FROM f),
    e AS (SELECT unnest(x) AS e, unnest(range(len(x))) AS k FROM f), s AS (SELECT k, sum(e)::BIGINT AS s FROM e GROUP BY k),
    l AS (SELECT list(s ORDER BY k) AS ls FROM s),
    d AS (SELECT vec_id, n, list_sum(list_transform(list_zip(x, ls), lambda p: (n * p[1] - p[2]) * (n * p[1] - p[2])))::BIGINT AS deviation, len(x) AS dim FROM v, n, l)
    SELECT vec_id, unnest(range(1, least(16, dim) + 1))::INT AS component, n, deviation FROM d
"""

#: Terms are cut by a pattern; all but the weight is whole numbers.
ORACLES["op13_lexical_search"] = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex({FOLDED}, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ts FROM documents),
    a AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS n, sum(len(ts))::BIGINT AS l FROM d),
    t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term),
    q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(list_filter(string_split_regex({FOLDED}, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM benchmark) GROUP BY item_id, term),
    w AS (SELECT term, floor(1000 * ln((2 * n + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM t WHERE term IN (SELECT term FROM q) GROUP BY term), a),
    m AS (SELECT r, doc_id, 75 + (25 * len(ts) * n) // l AS m FROM d, a),
    s AS (SELECT item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
          FROM q JOIN w USING (term) JOIN t USING (term) JOIN m USING (r) GROUP BY item_id, doc_id, r),
    k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
    SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express."""
    return dict(ORACLES)
