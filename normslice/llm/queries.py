"""The registered queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normslice.llm import bayes_minhash, bpe, decontaminate, divergence, language, matroska, quality, secrets, simhash, spelling, substring_dedup, toxicity, warc
from normslice.llm.common import table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_media_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_columns(table(spark, sf_dir, "documents"))


def op3_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_and_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "position", "previous_page")


def op4_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bayes_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_toxicity, op2_media_matroska, op3_warc_index_merge, op4_byte_level_bpe, op5_secret_scans,
        op6_suffix_array_dedup, op7_language_id, op8_quality_classifier, op9_simhash_near_dedup, op10_benchmark_decontamination,
        op11_minhash_near_dedup, op12_spelling_variants, op13_source_divergence,
    )
    return {f.__name__: f for f in every} | {"media_payloads": media_payloads, "tokens_round_trip": tokens_round_trip, "quality_sites": quality_sites, "substring_paths": substring_paths}


def substring_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many removed windows each step of the substring removal decides."""
    return substring_dedup.windows_by_path(table(spark, sf_dir, "documents"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of the media columns: sizes and digests of the payloads read back."""
    return op2_media_matroska(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def tokens_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of the tokens: the bytes that they decode to."""
    return op4_byte_level_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def quality_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priors and posteriors of sites over a stand-in belief, by moments."""
    belief = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("host"), F.coalesce("lang", F.lit("")).alias("path"), ((F.col("doc_id") * 7 + F.coalesce("n_chars", F.lit(0))) % 101 / 100.0).alias("belief"))
    sites, priors = quality.site_sums(belief)
    rounded = [F.round(F.col(c), 6).alias(c) for c in ("host_posterior", "path_posterior")]
    return quality.posteriors(sites, priors).select("host", "path", F.col("n_path"), F.col("n_host"), *rounded)


_OP5 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
rules(kind, rank, pattern, grp, least) AS (VALUES
  ('assign', 1, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  ('access', 2, 'AKIA[A-Z0-9]+', 0, 20),
  ('hex', 3, '[0-9a-f]+', 0, 24),
  ('pem', 4, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----', 0, 1),
  ('jwt', 5, 'eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}', 0, 1)),
m AS (
  SELECT doc_id, 'assign' AS kind, 1 AS rank, regexp_extract_all(t, (SELECT pattern FROM rules WHERE rank = 1)) AS h, regexp_extract_all(t, (SELECT pattern FROM rules WHERE rank = 1), 2) AS g, string_split_regex(t, (SELECT pattern FROM rules WHERE rank = 1)) AS p FROM d
  UNION ALL SELECT doc_id, 'access', 2, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT doc_id, 'hex', 3, regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), string_split_regex(t, '[0-9a-f]+') FROM d
  UNION ALL SELECT doc_id, 'pem', 4, regexp_extract_all(t, (SELECT pattern FROM rules WHERE rank = 4)), regexp_extract_all(t, (SELECT pattern FROM rules WHERE rank = 4)), string_split_regex(t, (SELECT pattern FROM rules WHERE rank = 4)) FROM d
  UNION ALL SELECT doc_id, 'jwt', 5, regexp_extract_all(t, (SELECT pattern FROM rules WHERE rank = 5)), regexp_extract_all(t, (SELECT pattern FROM rules WHERE rank = 5)), string_split_regex(t, (SELECT pattern FROM rules WHERE rank = 5)) FROM d),
e AS (SELECT doc_id, kind, rank, unnest(range(1, len(h) + 1)) AS i, unnest(h) AS h, unnest(g) AS g, unnest(p[1:len(h)]) AS p FROM m),
s AS (SELECT *, sum(length(p) + length(h)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM e),
f AS (SELECT doc_id, kind, s.rank, CAST(stop - length(h) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM s JOIN rules USING (kind) WHERE length(g) >= least),
j AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank <= 3), '') AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (doc_id)
"""


_OP3 = r"""
WITH p AS (SELECT page_id, coalesce(lower(url), 'about:blank') AS u, coalesce(html, '') AS h FROM pages),
x AS (SELECT *, sha1(h) AS hex, min(page_id) OVER (PARTITION BY h) AS first, regexp_replace(regexp_extract(u, '^[a-z]+://([^/?#:]+)', 1), '^www\.', '') AS host, regexp_extract(u, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(u, '^[^?#]*(\?[^#]+)', 1) AS query FROM p),
b AS (SELECT *, CASE WHEN host = '' THEN u ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END || query END AS key,
  array_to_string(list_transform(range(0, 8), lambda i: to_base(CAST('0x' || substr(hex, CAST(1 + 5 * i AS INTEGER), 5) AS BIGINT), 32, 4)), '') AS d FROM x)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, translate(d, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to,
  row_number() OVER (ORDER BY key, page_id) - 1 AS position, lag(page_id) OVER (PARTITION BY key ORDER BY page_id) AS previous_page
FROM b
"""


_MEDIA = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n, greatest(64, CAST(ceil(octet_length(b) / 64.0) AS BIGINT) * 64) AS m, b FROM d)
SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(b || unhex(repeat('00', CAST(m - n AS INTEGER)))) AS payload_sha256 FROM p
"""
_TOKENS = "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents"


def _strength_sql(n: str, s: str, sq: str, centre: str) -> str:
    k, rows, within = "count(*)", f"sum({n})", f"sum({sq} - {n} * ({s} / {n}) * ({s} / {n}))"
    between, squares = f"sum({n} * ({s} / {n} - {centre}) * ({s} / {n} - {centre}))", f"sum({n} * {n})"
    sigma = f"(greatest({within}, 0.0) / nullif({rows} - {k}, 0))"
    tau = f"(({between} - ({k} - 1) * {sigma}) / greatest({rows} - {squares} / {rows}, 1e-9))"
    return f"CASE WHEN {k} < 2 OR {rows} <= {k} THEN 10.0 WHEN {tau} > 0 AND {sigma} > 0 THEN least(greatest({sigma} / {tau}, 1.0), 1e6) WHEN {sigma} > 0 THEN 1e6 ELSE 10.0 END"


_SITES = f"""
WITH e AS (SELECT coalesce(source, '') AS host, coalesce(lang, '') AS path, (doc_id * 7 + coalesce(n_chars, 0)) % 101 / 100.0 AS b FROM documents),
p AS (SELECT host, path, count(*) AS n, sum(b) AS s, sum(b * b) AS q FROM e GROUP BY ALL), h AS (SELECT host, sum(n) AS hn, sum(s) AS hs, sum(q) AS hq FROM p GROUP BY host),
m AS (SELECT least(greatest(sum(s) / sum(n), 1e-6), 1 - 1e-6) AS mean FROM p), b AS (SELECT * FROM p JOIN h USING (host)),
kh AS (SELECT {_strength_sql('hn', 'hs', 'hq', '(SELECT mean FROM m)')} AS k FROM h), kp AS (SELECT {_strength_sql('n', 's', 'q', '(hs / hn)')} AS k FROM b),
o AS (SELECT b.*, (hs + kh.k * mean) / (hn + kh.k) AS hp FROM b, m, kh)
SELECT host, path, n AS n_path, CAST(hn AS BIGINT) AS n_host, round(hp, 6) AS host_posterior, round((s + kp.k * hp) / (n + kp.k), 6) AS path_posterior FROM o, kp
"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP11 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
same AS (SELECT r, hash(list_sort(list(s))) AS h FROM s GROUP BY r), f AS (SELECT r, min(r) OVER (PARTITION BY h) AS one FROM same),
k AS (SELECT s.* FROM s JOIN f USING (r) WHERE r = one),
i AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM k a JOIN k b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * common >= 85 * (x.n + y.n - common) UNION SELECT one, r FROM f WHERE one < r),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, u.b FROM reach JOIN u ON u.a = reach.b),
c AS (SELECT reach.a AS r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY ALL)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN c USING (r) LEFT JOIN n USING (r)
"""


_OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
o AS (SELECT r, lang, source, {_LOWER.format("unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'))")} AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
full_ AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
l AS (SELECT lang, term, sum(n) AS n FROM full_ GROUP BY ALL),
p AS (SELECT lang, source, term, n, CAST(1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS BIGINT) AS p FROM full_ JOIN v USING (lang)),
q AS (SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS BIGINT) AS q FROM l JOIN v USING (lang)),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_index_merge": _OP3, "op5_secret_scans": _OP5, "op11_minhash_near_dedup": _OP11, "op13_source_divergence": _OP13, "media_payloads": _MEDIA, "tokens_round_trip": _TOKENS, "quality_sites": _SITES}
