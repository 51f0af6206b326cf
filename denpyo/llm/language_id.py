"""Language identification by fusing the evidence on a text.

Method: for each language the log-likelihood of the text (hashed byte trigrams, naive Bayes), the
declared markup language, the address (country suffix or a language folder of the path) and
the prior of the host are added up; the largest posterior wins. The prior of a host is the
share of languages among its texts, judged by text alone, smoothed towards its registered
domain, the domain towards the suffix, the suffix towards all hosts: grouped counts, combined
before the shuffle.

One more hypothesis stands for everything else. All trigrams are equally likely under it: by `FOREIGN` nats
less than the trigrams of the sample are on average in the language that fits them least. So a text
that none of the languages explains is rejected, the more surely the longer it is; a priori a text is foreign with a
probability of `FOREIGN_SHARE`.

The text model is fitted on documents with a declared language: some `SAMPLE` of each
language, those of the smallest hashes. All texts are scored whole, and host counts cover all.
Trigrams of one text depend on each other, so its likelihood counts by `TEMPER`, and as if it had
`MOST` trigrams at most.

Results by case: null texts and texts without letters have no text evidence and are rejected;
null declarations, addresses and hosts give no evidence (rows without a host share a prior);
rows are judged independently, so repeated rows agree; ties go to the language that comes first;
an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MIX, bounded, hash_sample, lean, stored, strings
from .url_filters import domain_of, host_of, path_of, suffix_of

LANGUAGES = ["de", "en", "es", "fr"]
SAMPLE = 1_000
BUCKETS_LOG = 15
TEMPER, MOST = 0.2, 400
#: Probability that a declaration or an address agrees with the text.
DECLARED_RIGHT, ADDRESS_RIGHT = 0.9, 0.8
#: Pull of the level above, in texts.
PULL = 20.0
#: Least posterior of an accepted text.
ACCEPT = 0.5
#: How much less likely the trigrams of foreign texts are, and how many texts are foreign a priori.
FOREIGN, FOREIGN_SHARE = 3.0, 1e-6
#: Country suffixes and what they speak (fixed values).
SUFFIXES = {"de": "de", "at": "de", "uk": "en", "us": "en", "au": "en", "ie": "en", "es": "es", "mx": "es",
            "ar": "es", "fr": "fr"}
#: Elements whose content is no text, and how they end.
_CLOSED = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style")}
_OPENS = re.compile(r"(?i)<(script|style)\b")
#: Letters to lower case, everything else in ASCII to a blank.
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def without_markup(html: str) -> str:
    """The text outside of tags, comments, scripts and styles, with a blank for each of these. One pass: an end
    that has not been found once is not looked for again."""
    out, at, never = [], 0, set()

    def end_of(kind: str, start: int) -> int:
        if kind in never:
            return -1
        if kind in _CLOSED:
            found = _CLOSED[kind].search(html, start)
            stop = found.end() if found else -1
        else:
            stop = html.find(kind, start)
            stop += len(kind) if stop >= 0 else 0
        if stop < 0:
            never.add(kind)
        return stop

    while (start := html.find("<", at)) >= 0:
        opens = _OPENS.match(html, start)
        stop = end_of(opens[1].lower(), opens.end()) if opens and opens[1].lower() in _CLOSED else -1
        if stop < 0 and html.startswith("<!--", start):
            stop = end_of("-->", start + 4)
        if stop < 0:
            stop = end_of(">", start + 1)
        if stop < 0:
            break
        out.append(html[at:start])
        at = stop
    return " ".join([*out, html[at:]])


def trigrams(text: str | None) -> np.ndarray:
    """Bucket of each byte trigram that has a letter; runs of blanks are one."""
    raw = b" ".join((text or "").encode().translate(_FOLD).split())
    if not raw:
        return np.empty(0, np.int64)
    b = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint64)
    code = b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]
    return (code * MIX[0] >> np.uint64(64 - BUCKETS_LOG)).astype(np.int64)


def fit(docs: DataFrame, languages: list[str] = LANGUAGES) -> np.ndarray:
    """Log probabilities (language, bucket) from documents (doc_id, text, lang); the last row is that of foreign
    texts."""
    known = docs.filter(F.col("lang").isin(languages) & F.col("doc_id").isNotNull()).select("doc_id", "lang")
    chosen = None
    for lang in languages:
        one = hash_sample(known.filter(F.col("lang") == lang), SAMPLE)
        chosen = one if chosen is None else chosen.union(one)
    # The bound makes the id list small: texts are counted where they lie.
    texts = docs.drop("lang").join(F.broadcast(chosen.distinct()), "doc_id").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), strings(batch.column(1))):
                of = np.bincount(trigrams(text), minlength=1 << BUCKETS_LOG)
                sums[lang] = sums.get(lang, 0) + of
        for lang, of in sums.items():
            at = np.flatnonzero(of)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(of[at].astype(np.int64))],
                ["lang", "bucket", "n"])

    counts = bounded(texts).mapInArrow(count, "lang STRING, bucket INT, n LONG").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = np.full((len(languages), 1 << BUCKETS_LOG), 0.5)
    for lang, bucket, n in counts.collect():  # languages x buckets at most
        table[languages.index(lang), bucket] += n
    logs = np.log(table / table.sum(axis=1, keepdims=True))
    seen = table - 0.5
    known = seen.sum(axis=1) > 0
    least = ((seen * logs).sum(axis=1)[known] / seen.sum(axis=1)[known]).min() - FOREIGN if known.any() else -1e9
    return np.vstack([logs, np.full(table.shape[1], least)])


def text_evidence(rows: DataFrame, model: np.ndarray, markup: bool = False) -> DataFrame:
    """`rows` with their `text` replaced by `evidence` (a number per language and one for foreign texts, or null)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [c for c in rows.columns if c != "text"]
    at = rows.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        table = np.ascontiguousarray(shared.value.T)
        for batch in batches:
            cells = []
            for text in strings(batch.column(at)):
                of = trigrams(without_markup(text) if markup and text else text)
                if not len(of):
                    cells.append(None)
                    continue
                mean = table[of].sum(axis=0) / len(of)
                cells.append((TEMPER * min(MOST, len(of)) * (mean - mean.max())).tolist())
            kept = [batch.column(i) for i, c in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(cells, pa.list_(pa.float64()))], names + ["evidence"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return bounded(rows).mapInArrow(judge, f"{schema}, evidence ARRAY<DOUBLE>")


def _says(code: Column, right: float, languages: list[str]) -> Column:
    """Log-likelihoods of a declared language code, the last one for foreign texts; zeros for codes that say
    nothing."""
    wrong = (1 - right) / max(1, len(languages) - 1)
    any_of = F.lit(float(-np.log(len(languages))))
    return F.when(
        code.isin(languages),
        F.array(*[F.when(code == lang, F.lit(float(np.log(right)))).otherwise(F.lit(float(np.log(wrong)))) for lang in languages], any_of),
    ).otherwise(F.array(*[F.lit(0.0) for _ in range(len(languages) + 1)]))


def _host_priors(rows: DataFrame, languages: list[str]) -> DataFrame:
    """(host, prior ARRAY<DOUBLE>) from rows (host, text_lang)."""
    counted = [F.count(F.when(F.col("text_lang") == lang, 1)).cast("double").alias(f"n{i}") for i, lang in enumerate(languages)]
    counts = [F.sum(f"n{i}").alias(f"n{i}") for i in range(len(languages))]
    size = sum((F.col(f"n{i}") for i in range(1, len(languages))), F.col("n0"))
    hosts = rows.groupBy("host").agg(*counted).withColumn("domain", domain_of(F.col("host"))).withColumn(
        "suffix", suffix_of(F.col("host")))
    hosts = stored(hosts, "host-languages")  # read by every level
    domains = hosts.groupBy("domain", "suffix").agg(*counts)
    suffixes = domains.groupBy("suffix").agg(*counts)
    total = suffixes.agg(*counts).first()
    all_n = sum(x or 0.0 for x in total)
    overall = F.array(*[F.lit(((x or 0.0) + 1.0) / (all_n + len(languages))) for x in total])

    def shrunk(level: DataFrame, key: str, above: Column) -> DataFrame:
        return level.withColumn("prior", F.array(*[
            (F.col(f"n{i}") + PULL * above[i]) / (size + PULL) for i in range(len(languages))]))

    s = shrunk(suffixes, "suffix", overall).select("suffix", F.col("prior").alias("above"))
    d = shrunk(domains.join(s, "suffix"), "domain", F.col("above")).select("domain", F.col("prior").alias("above"))
    return shrunk(hosts.join(d, "domain"), "host", F.col("above")).select("host", "prior")


def identify(rows: DataFrame, model: np.ndarray, languages: list[str] = LANGUAGES, markup: bool = False) -> DataFrame:
    """`rows` (text, declared, url, and any others) with lang, posterior, text_lang and accepted
    in place of these three and of columns that have the same names.

    Rows whose `url` is null may name their source in a column `host`.
    """
    replaced = ("text", "declared", "url", "host", "lang", "posterior", "text_lang", "accepted", "evidence")
    others = [c for c in rows.columns if c not in replaced]
    named = F.col("host") if "host" in rows.columns else F.lit(None).cast("string")
    host = F.coalesce(F.nullif(host_of(F.col("url")), F.lit("")), named, F.lit(""))
    folder = F.lower(F.regexp_extract(path_of(F.col("url")), r"^/([A-Za-z]{2})(?:/|$)", 1))
    country = suffix_of(host)
    address = F.when(folder.isin(languages), folder)
    for suffix, lang in SUFFIXES.items():
        address = address.when(country == suffix, F.lit(lang))
    ready = rows.select(*others, "text", F.lower(F.substring("declared", 1, 2)).alias("_declared"),
                        address.alias("_address"), host.alias("_host"))
    judged = text_evidence(ready, model, markup)
    own = lambda scores: F.slice(scores, 1, len(languages))  # noqa: E731  without that of foreign texts
    best = lambda scores: F.get(
        F.array(*[F.lit(x) for x in languages]), F.array_position(own(scores), F.array_max(own(scores))).cast("int") - 1)
    judged = stored(judged.withColumn("text_lang", best(F.col("evidence"))), "language-evidence")
    priors = _host_priors(judged.select(F.col("_host").alias("host"), "text_lang"), languages).select(
        F.col("host").alias("_host"), F.col("prior").alias("_prior"))
    none = F.array(*[F.lit(0.0) for _ in range(len(languages) + 1)])
    said = _says(F.col("_declared"), DECLARED_RIGHT, languages)
    addressed = _says(F.col("_address"), ADDRESS_RIGHT, languages)
    heard = F.coalesce("evidence", none)
    prior = [F.log(F.col("_prior")[i]) for i in range(len(languages))] + [F.lit(float(np.log(FOREIGN_SHARE)))]
    logs = F.array(*[heard[i] + said[i] + addressed[i] + prior[i] for i in range(len(languages) + 1)])
    fused = judged.join(priors, "_host").withColumn("_logs", logs)
    top = F.array_max(own(F.col("_logs")))
    posterior = 1 / F.aggregate("_logs", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return fused.select(*others, best(F.col("_logs")).alias("lang"), posterior.alias("posterior"), "text_lang",
                        (F.col("evidence").isNotNull() & (posterior >= ACCEPT)).alias("accepted"))
