"""One registered query per operator, over the whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_bpe, collocations, decontaminate, jaccard_join, language_id, neighbours, pii, quality, sharding, token_counts,
    token_files, url_filters, whitening,
)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SHARD_BYTES = 1 << 20
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
BPE_RANKS, COUNT_RANKS, TOKENIZER = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"


def query(sql: str | None = None):
    def keep(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return keep


@query()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents (declared language, source as host) and all pages (markup, address)."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    none = F.lit(None)
    declared = F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([A-Za-z-]+)", 1)
    rows = docs.select(
        F.lit("document").alias("kind"), "doc_id", none.cast("long").alias("page_id"), "text",
        F.col("lang").alias("declared"), none.cast("string").alias("url"), F.col("source").alias("host"),
    ).unionByName(pages.select(
        F.lit("page").alias("kind"), none.cast("long").alias("doc_id"), "page_id", F.col("html").alias("text"),
        declared.alias("declared"), "url", none.cast("string").alias("host")))
    return language_id.identify(rows, language_id.fit(docs), markup=True)


@query(f"""
WITH rows AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
levels AS (SELECT r.*, d::BIGINT AS depth, h >> (60 - d)::INT AS prefix FROM rows r, range(0, 41) t(d)),
sizes AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM levels GROUP BY ALL),
best AS (
  SELECT l.*, s.shard_bytes, s.shard_docs FROM levels l JOIN sizes s USING (depth, prefix)
  WHERE s.shard_bytes <= {SHARD_BYTES}
  QUALIFY row_number() OVER (PARTITION BY l.doc_id, l.h ORDER BY depth) = 1)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth::INT, '0') END AS shard,
       depth::INT AS depth, shard_bytes, shard_docs, true AS fits FROM best
""")
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), SHARD_BYTES)


@query()
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.token_lengths(
        table(spark, sf_dir, "documents"), public_tokenizers.path(COUNT_RANKS), public_tokenizers.PATTERN)
    return token_counts.context_totals(token_counts.stored_histogram(lengths))


@query()
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"))


@query("""
WITH split AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
graded AS (SELECT doc_id, max((quality = 0)::INT) AS bad FROM labels GROUP BY doc_id),
pages2 AS (
  SELECT s.*, g.bad FROM split s LEFT JOIN graded g
    ON g.doc_id = TRY_CAST(regexp_extract(s.path, '/([0-9]{1,18})[^/]*/?$', 1) AS BIGINT)),
hosts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad,
    coalesce(nullif(regexp_extract(host, '([^.]+\\.[^.]+)$', 1), ''), host) AS domain,
    regexp_extract(host, '([^.]*)$', 1) AS suffix
  FROM pages2 GROUP BY host),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
units AS (
  SELECT 'h' AS kind, n::DOUBLE AS n, bad::DOUBLE AS bad FROM hosts
  UNION ALL SELECT 'd', n, bad FROM domains UNION ALL SELECT 's', n, bad FROM suffixes),
sums AS (
  SELECT kind, count(*)::DOUBLE AS units, sum(n) AS total, sum(bad) AS bad, sum(n * n) AS sq, sum(bad * bad / n) AS btw,
    sum(bad) / sum(n) AS p FROM units WHERE n > 0 GROUP BY kind),
rhos AS (
  SELECT *, total - sq / total - (units - 1) AS size,
    CASE WHEN units >= 2 AND bad > 0 AND bad < total AND total - sq / total - (units - 1) > 0
      THEN ((btw - bad * p) / (p * (1 - p)) - (units - 1)) / (total - sq / total - (units - 1)) END AS rho FROM sums),
strengths AS (
  SELECT kind, CASE WHEN rho IS NULL OR rho <= 1 / 1001.0 THEN 1000.0 WHEN rho >= 1 / 3.0 THEN 2.0
    ELSE (1 - rho) / rho END AS m FROM rhos),
m AS (
  SELECT coalesce(max(m) FILTER (kind = 'h'), 1000.0) AS mh, coalesce(max(m) FILTER (kind = 'd'), 1000.0) AS md,
    coalesce(max(m) FILTER (kind = 's'), 1000.0) AS ms FROM strengths),
top AS (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0.0)::DOUBLE AS above FROM suffixes),
ps AS (SELECT suffix, (bad + ms * above) / (n + ms) AS rate FROM suffixes, m, top),
pd AS (SELECT domain, (bad + md * ps.rate) / (n + md) AS rate FROM domains JOIN ps USING (suffix), m),
ph AS (SELECT host, (hosts.bad + mh * pd.rate) / (n + mh) AS rate, n + mh AS w FROM hosts JOIN pd USING (domain), m),
learned AS (SELECT host, CASE WHEN rate - 1.64 * sqrt(rate * (1 - rate) / (w + 1)) >= 0.25 THEN 'block' ELSE 'allow' END AS v FROM ph),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM split)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' ELSE v END AS verdict
FROM ruled JOIN learned USING (host)
""")
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of a page is the quality of the document that its address numbers."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    graded = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max((F.col("quality") == 0).cast("int")).alias("bad"))
    number = F.regexp_extract(url_filters.path_of(F.col("url")), r"/([0-9]{1,18})[^/]*/?$", 1).try_cast("long")
    return url_filters.judge(pages.withColumn("doc_id", number).join(graded, "doc_id", "left"), URL_RULES)


@query()
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


@query()
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query()
def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


DECONTAMINATION = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
items AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM items),
places AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
hits AS (
  SELECT p.doc_id, p.i, p.n, item FROM places p
  JOIN items t ON t.n = p.n AND t.win = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (
  SELECT doc_id, unnest(range(i, i + n)) AS x FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names
  FROM hits GROUP BY doc_id)
"""


@query(DECONTAMINATION + """
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
""")
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path(BPE_RANKS))
    return byte_bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^ \x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, w[i:i + k - 1] AS ws, count(*)::BIGINT AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 5) t(k) WHERE len(w) >= k) GROUP BY ALL),
often AS (SELECT *, array_to_string(ws, ' ') AS phrase FROM grams WHERE f >= 30),
cuts AS (
  SELECT c.lang, c.k, c.ws, c.phrase, c.f AS a, j, a.f AS l, b.f AS r, (2000000::HUGEINT * c.f) // (a.f + b.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM often WHERE k > 1) c
  JOIN often a ON a.lang = c.lang AND a.ws = c.ws[1:j] JOIN often b ON b.lang = c.lang AND b.ws = c.ws[j + 1:]),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
free AS (
  SELECT * FROM lowest s WHERE NOT EXISTS (
    SELECT 1 FROM often o WHERE o.lang = s.lang AND o.k > s.k AND 100::HUGEINT * o.f >= 80::HUGEINT * s.a
      AND contains(' ' || o.phrase || ' ', ' ' || s.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query(COLLOCATIONS)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def _luhn_sql(digits: str) -> str:
    digit = f"substr(reverse({digits}), i::INT, 1)::INT"
    return (f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: "
            f"CASE WHEN i % 2 = 1 THEN {digit} ELSE 2 * {digit} - CASE WHEN {digit} > 4 THEN 9 ELSE 0 END END)) % 10 = 0")


def _account_sql() -> str:
    """The length of a bank account number at the start of the match, if it is one."""
    cases = " ".join(f"WHEN '{c}' THEN regexp_extract(m, '^([A-Z0-9] ?){{{n - 1}}}[A-Z0-9]')" for c, n in pii.ACCOUNT_LENGTHS.items())
    span = f"CASE substr(m, 1, 2) {cases} ELSE '' END"
    number = f"replace({span}, ' ', '')"
    turned = f"(substr({number}, 5) || substr({number}, 1, 4))"
    value = "CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END"
    rest = (f"list_reduce(list_prepend(0, list_transform(string_split({turned}, ''), lambda c: {value})), "
            "lambda r, v: (r * CASE WHEN v >= 10 THEN 100 ELSE 10 END + v) % 97)")
    after = f"substr(m, length({span}) + 1, 1)"
    return (f"CASE WHEN {span} <> '' AND NOT regexp_matches(b, '[A-Za-z0-9]$') AND "
            f"CASE WHEN {after} = '' THEN NOT regexp_matches(a, '^[A-Za-z0-9]') ELSE {after} = ' ' END "
            f"THEN CASE WHEN {rest} = 1 THEN length({span}) END END")


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
#: The expression of each kind as it is named, and the length of the span in a match m between texts b and a.
_PII_SQL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "length(m)"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "CASE WHEN list_bool_and(list_transform(string_split(m, '.'), lambda p: "
           "length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(ltrim(p, '0') AS INT), 0) <= 255)) THEN length(m) END"),
    "card": (r"[0-9]([\x20-]?[0-9])+", f"CASE WHEN length({_DIGITS}) BETWEEN 14 AND 19 AND {_luhn_sql(_DIGITS)} THEN length(m) END"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"CASE WHEN length({_DIGITS}) BETWEEN 10 AND 15 THEN length(m) END"),
    "iban": (r"[A-Z]{2}[0-9]{2}( ?[A-Z0-9]){11,30}", _account_sql()),
    "ssn": (r"[0-9][0-9-]{9,}", "CASE WHEN regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND "
            "NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$') THEN length(m) END"),
    "tel": (r"0[0-9 ()./-]{7,}[0-9]", f"CASE WHEN length({_DIGITS}) BETWEEN 9 AND 12 AND NOT regexp_matches(b, '[A-Za-z0-9+./-]$') "
            "AND NOT regexp_matches(a, '^[A-Za-z0-9]') THEN length(m) END"),
}


def _pii_oracle() -> str:
    parts, names = [], []
    for number, kind in enumerate(pii.KINDS):
        pattern, length = _PII_SQL[kind.name]
        words = lambda w: f"CASE WHEN regexp_matches(near, '(^|[^a-z])({w})') THEN {pii.WORD_WEIGHT} ELSE 0.0 END"
        parts.append(f"""
k{number} AS (SELECT r, unnest(range(1, len(m) + 1)) AS i, m, g FROM (
  SELECT r, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM t WHERE regexp_matches(text, '{pattern}'))),
p{number} AS (SELECT r, m[i] AS m, g[i] AS b, g[i + 1] AS a, list_sum(list_transform(g[1:i], lambda x: length(x)))
  + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS first FROM k{number}),
s{number} AS (SELECT r, first::BIGINT AS first, {number} AS number, '{kind.name}' AS kind, {kind.base} AS base, {length} AS size,
  round(greatest(0.0, least(1.0, {kind.prior} + {words(kind.good)} - {words(kind.bad)})), 2)::DOUBLE AS score
  FROM (SELECT *, lower(right(b, {pii.CONTEXT}) || ' ' || left(a, {pii.CONTEXT})) AS near FROM p{number}))""")
        names.append(f"SELECT * FROM s{number}")
    listed = "kind || ':' || first || ':' || (first + size), ',' ORDER BY first, number"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE)
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),{",".join(parts)},
spans AS (SELECT * FROM ({" UNION ALL ".join(names)}) WHERE size IS NOT NULL AND (base OR score >= {pii.KEPT_SCORE})),
listed AS (SELECT r, {counts}, string_agg({listed}) FILTER (base) AS base, string_agg({listed}) AS spans,
  string_agg(score::VARCHAR, ',' ORDER BY first, number) AS scores FROM spans GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.BASE)}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM t LEFT JOIN listed USING (r)
"""


@query(_pii_oracle())
def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


@query()
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
