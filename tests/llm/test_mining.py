"""Collocations, personal data and whitening on small tables with awkward rows, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import sys
import time
from collections import Counter
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from denpyo.llm import collocations, common, pii, whitening  # noqa: E402

# Collocations ---------------------------------------------------------------------------------


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def brute_collocations(rows, least, first=2000, longest=4):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i:i + k])] += 1
    out = {}
    for (lang, ws), a in counts.items():
        if len(ws) < 2 or a < least:
            continue
        cuts = []
        for k in range(1, len(ws)):
            left, right = counts[lang, ws[:k]], counts[lang, ws[k:]]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        inside = any(m == lang and len(longer) > len(ws) and 100 * b >= 80 * a
                     and any(longer[i:i + len(ws)] == ws for i in range(len(longer) - len(ws) + 1))
                     for (m, longer), b in counts.items() if b >= least)
        if not inside:
            out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -score)
                  for lang, found in out.items() for i, (score, a, p, left, right) in enumerate(sorted(found)[:first]))


def phrase_rows():
    rng = random.Random(4)
    words = ["New", "york", "São", "PAULO", "the", "of", " x", "日本", "a", "é", "b\x0bc", "x\x00y", "w" * 40, "w" * 39 + "v"]
    rows = [(None, None), ("en", ""), ("en", " \t "), ("en", ".,;:!?\n\x0b\x0c\r"), (None, "one two. one two"), ("und", "one two")]
    for i in range(150):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\r\n", "!"]) for _ in range(rng.randint(1, 40)))
        rows.append((rng.choice(["en", "de", None, "und"]), text))
    rows += [("de", "the same text again and again, the same text")] * 40
    rows += [("en", "new york " * 3000), ("en", "ÉA éa; " * 50)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_collocations(spark, monkeypatch, small):
    """In one and in many shards, with ranges that are cut by their suffixes."""
    if small:
        monkeypatch.setattr(collocations, "SHARD", 500)
        monkeypatch.setattr(collocations, "MOST", 40)
        monkeypatch.setattr(common, "IDS_SENT", 0)
    rows = phrase_rows()
    frame = spark.createDataFrame([(7, t, lang, 1, "p", 2, 0.5) for lang, t in rows],
                                  "doc_id LONG, text STRING, lang STRING, n LONG, phrase STRING, rank INT, score DOUBLE").repartition(3)
    got = collocations.collocations(frame, least=3)
    assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *[(c, "bigint") for c in ("a", "l", "r", "n", "score")]]
    assert sorted(tuple(r) for r in got.collect()) == brute_collocations(rows, 3)
    few = collocations.collocations(frame, least=3, first=5)
    assert sorted(tuple(r) for r in few.collect()) == brute_collocations(rows, 3, 5)
    assert collocations.collocations(frame.limit(0)).collect() == []


def test_words_of_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(collocations, "_same", lambda *a: False)
    rows = phrase_rows()[:60]
    frame = spark.createDataFrame([(t, lang) for lang, t in rows], "text STRING, lang STRING").coalesce(1)
    assert sorted(tuple(r) for r in collocations.collocations(frame, least=2).collect()) == brute_collocations(rows, 2)


def test_same_words():
    raw = np.frombuffer(b"abcdefghi abcdefghj abcdefghi abc", np.uint8)
    starts, stops = np.array([0, 10, 20, 30]), np.array([9, 19, 29, 33])
    assert collocations._same(raw, starts, stops, np.array([0, 1, 0, 3]))
    assert not collocations._same(raw, starts, stops, np.array([0, 0, 0, 3]))
    assert not collocations._same(raw, starts, stops, np.array([0, 1, 0, 0]))


def test_part_counts(spark):
    frame = spark.createDataFrame([("a b c", None)] * 3 + [("b c", None)] * 2 + [("a", None)], "text STRING, lang STRING")
    levels = collocations.Levels(frame, least=2)
    asked = spark.createDataFrame([("und", "a b c"), ("und", "b c"), ("und", "c b")], "lang STRING, phrase STRING")
    got = {r.phrase: (r.f, r.heads, r.tails) for r in collocations.part_counts(levels, asked).collect()}
    assert got == {"a b c": (3, [4, 3, 3], [3, 5, 5]), "b c": (5, [5, 5], [5, 5]), "c b": (None, None, None)}


def test_scores_of_large_counts(spark):
    big = [(9 * 10**18, [9 * 10**18 + 5, 9 * 10**18 + 3, 9 * 10**18], [9 * 10**18, 9 * 10**18 + 100, 9 * 10**18 + 4]),
           (10**18, [2 * 10**18, 10**18, 10**18], [10**18, 2 * 10**18, 3 * 10**18])]
    rows = spark.createDataFrame(big, "f LONG, heads ARRAY<LONG>, tails ARRAY<LONG>")
    got = [tuple(r.cut) for r in rows.select(collocations._cut(3, collocations.SCALE).alias("cut")).collect()]
    assert got == [min((2_000_000 * f // (h[k - 1] + t[k]), k, h[k - 1], t[k]) for k in (1, 2)) for f, h, t in big]


# Personal data --------------------------------------------------------------------------------

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, digits[::-1]))) % 10 == 0


def base_spans(text):
    out = []
    for number, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                    "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), number, kind, m.end()))
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


def personal_texts():
    rng = random.Random(11)
    texts = [
        None, "", "a@b.c", "🙂 naïve.é a@b.c, x@y.z.w..", "a@b.c+d@e.f_g@h.i.@j.k", "@a.b a@ a@b a@b. a@.b", "1.2.3.4.5.6.7.8 256.1.1.1 0255.0.00.1",
        "1..2.3.4 .1.2.3.4.", "4111 1111 1111 1111 4111-1111-1111-1112", "4111111111111111" * 2, "+1 (456) 555-2186 +1456 +12345678901234567",
        "+1 2", "+1 (((((", "++49 30 123456-78 90.", "4111111111111111" + " 1" * 30, "mail: DE89 3704 0044 0532 0130 00 and", "x@y.z" * 3,
        "1 " * 400, "pay GB82WEST12345698765432", "123-45-6789 ssn 123-45-6789", "tel 030 123 456 78 or 030 123 456 78",
    ]
    for alphabet in ("a@.-_+%Z9", "0123456789. -", "+0123456789() .-", "a@.b 1.4+-\né🙂"):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120))) for _ in range(150)]
    return texts + ["first.last@mail.example.com, 10.0.0.1\n" * 1500]


def test_personal_data(spark):
    texts = personal_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a@b.c"), (2, "a@b.c")]
    frame = spark.createDataFrame([(i, t, "s", 1, "b") for i, t in rows], "doc_id LONG, text STRING, spans STRING, n_ip INT, base STRING").repartition(3)
    got = pii.digests(frame).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t in rows:
        spans = base_spans(t)
        of = Counter(s.split(":")[0] for s in spans)
        want[i, *(of[k] for k, _ in BASE), hashlib.sha256(",".join(spans).encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:6] for r in got) == want
    for r in got:  # other kinds come on top
        kept = [s for s in r.spans.split(",") if s.split(":")[0] in dict(BASE)]
        assert r.base_sha256 == hashlib.sha256(",".join(kept).encode()).hexdigest()
    assert pii.digests(frame.limit(0)).collect() == []


def test_confirmed_and_scored_spans(spark):
    cases = {
        "IBAN DE89 3704 0044 0532 0130 00 of": [("iban", "DE89 3704 0044 0532 0130 00", 1.0)],
        "DE88 3704 0044 0532 0130 00": [],  # wrong check digits
        "GB82WEST12345698765432 OK": [("iban", "GB82WEST12345698765432", 0.9)],
        "xGB82WEST12345698765432, GB82WEST123456987654321": [],
        "serial ZZ82WEST12345698765432": [],
        "my ssn is 123-45-6789": [("ssn", "123-45-6789", 0.6)],
        "order 123-45-6789, 000-12-3456 ssn": [],
        "Tel. 030 123 456 78!": [("tel", "030 123 456 78", 0.6)],
        "sum 030 123 456 78": [],
        "card 4111 1111 1111 1111": [("card", "4111 1111 1111 1111", 1.0)],
        "order 4111111111111111": [("card", "4111111111111111", 0.4)],
        "version 1.2.3.4 of host": [("ip", "1.2.3.4", 0.5)],
    }
    rows = pii.find(spark.createDataFrame(list(cases.items()), "text STRING, doc_id ARRAY<STRUCT<a: STRING, b: STRING, c: DOUBLE>>"))
    for r in rows.collect():
        found = [(s.kind, s.value, s.score) for s in r.spans]
        assert [(k, v, round(x, 6)) for k, v, x in found] == cases[r.text], r.text
        assert all(r.text[s.start:s.end] == s.value for s in r.spans)


def test_redacted_texts(spark):
    rows = [(1, "write to é.x@y.zz or 10.0.0.1"), (2, None), (3, "nothing"), (4, "+12 a@b.c.10.0.0.1"), (5, "a@b.c" + "\n" + "1.2.3.4")]
    got = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id LONG, text STRING")).collect()}
    assert got == {1: "write to é[EMAIL] or [IP]", 2: "", 3: "nothing", 4: "+12 [EMAIL]", 5: "[EMAIL]\n[IP]"}


def test_runs_of_one_character_take_linear_time(spark):
    texts = ["a" * 1_000_000, "1" * 1_000_000, "a." * 500_000, "1." * 500_000, "+1" * 500_000, "+1" + " " * 1_000_000, "a@" * 500_000,
             "A1" * 500_000, "AB12" + "C3" * 500_000, "0 " * 500_000, "a@b" + ".c" * 500_000, "1-" * 500_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").repartition(4)
    start = time.time()
    assert len(pii.digests(frame).collect()) == len(texts)
    assert time.time() - start < 60


# Whitening ------------------------------------------------------------------------------------


def usable(rows):
    good = [v for v in (r[1] for r in rows) if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    size = Counter(len(v) for v in good).most_common(1)[0][0]
    return [(i, [math.floor(Fraction(64) * Fraction(c)) + 1_000_000 for c in v]) for i, v in rows
            if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]


def check_whitened(got, rows, components=32):
    kept = usable(rows)
    n, x = len(kept), [v for _, v in kept]
    sums = [sum(c) for c in zip(*x)]
    size = len(sums)
    y = np.array([[n * c - s for c, s in zip(v, sums)] for v in x], object)
    cov = np.array([[float(Fraction(int((y[:, i] * y[:, j]).sum()), n**3)) for j in range(size)] for i in range(size)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    deviation = sorted(int((r * r).sum()) for r in y)
    given = min(size, components)
    assert len(got) == n * given and {r.n for r in got} == {n}
    assert sorted((r.deviation for r in got if r.component == 1), key=str) == sorted((d if d < 1 << 63 else None for d in deviation), key=str)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-4
    centred = (y / n).astype(np.float64)
    ids = [i for i, _ in kept]
    for c in range(1, given + 1):
        own = [r for r in got if r.component == c]
        assert abs(own[0].explained - values[c - 1] / np.trace(cov)) <= 1e-4 * abs(values[c - 1] / np.trace(cov)) + 1e-12
        if values[c - 1] <= size * np.finfo(float).eps * values[0]:
            assert all(r.whitened is None for r in own)
            continue
        gaps = np.abs(np.delete(values, c - 1) - values[c - 1])
        if len(gaps) and gaps.min() < 1e-6 * values[0]:
            continue  # a shared eigenvalue has no direction of its own
        want = centred @ vectors[:, c - 1] / math.sqrt(values[c - 1])
        mine = sorted((r.vec_id is None, r.vec_id or 0, r.whitened) for r in own)
        both = [sorted((i is None, i or 0, s * w) for i, w in zip(ids, want)) for s in (1, -1)]
        assert any(np.allclose([m[2] for m in mine], [b[2] for b in side], atol=1e-6) for side in both)


def vectors_of(spark, rows, kind="DOUBLE"):
    return spark.createDataFrame([(i, v, 0.1, 3) for i, v in rows], f"vec_id LONG, embedding ARRAY<{kind}>, whitened DOUBLE, n INT").repartition(3)


def test_whitening(spark):
    rng = np.random.default_rng(2)
    mix = rng.standard_normal((40, 40)) * np.geomspace(1, 30, 40)
    rows = [(i, (rng.standard_normal(40) @ mix + 7).tolist()) for i in range(300)]
    rows += [(5, rows[9][1]), (None, rows[3][1]), (400, None), (401, []), (402, [1.0] * 3), (403, [float("nan")] + [1.0] * 39),
             (404, [None] + [1.0] * 39), (405, [float("inf")] * 40)] + [(500, rows[1][1])] * 100
    frame = vectors_of(spark, rows)
    got = whitening.whiten(frame)
    assert ", ".join(f"{n} {t}" for n, t in got.dtypes).replace("bigint", "LONG").upper() == whitening.SCHEMA.upper()
    check_whitened(got.collect(), rows)
    assert whitening.whiten(frame.limit(0)).collect() == []
    assert whitening.whiten(frame.filter("vec_id IN (400, 401, 403)")).collect() == []


def test_whitening_of_few_dimensions_and_none_of_variance(spark):
    rows = [(i, [float(i % 7), 3.5, float(i * i % 11), float(i % 7)]) for i in range(60)]
    got = whitening.whiten(vectors_of(spark, rows, "FLOAT")).collect()
    check_whitened(got, rows)
    assert {r.component for r in got if r.whitened is None} == {3, 4}
    same = whitening.whiten(vectors_of(spark, [(i, [1.0, 2.0]) for i in range(5)])).collect()
    assert len(same) == 10 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 for r in same)
    check_whitened(whitening.whiten(vectors_of(spark, [(1, [2.0]), (2, [3.0]), (3, [5.0])])).collect(), [(1, [2.0]), (2, [3.0]), (3, [5.0])])


def test_sums_beyond_64_bits(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(4) * 1e13 + 5e14]) for i in range(200)]
    assert any(abs(c) > 1e14 for c in rows[0][1])
    check_whitened(whitening.whiten(vectors_of(spark, rows)).collect(), rows)


def test_covariance_is_that_of_products():
    rng = np.random.default_rng(4)
    z = rng.integers(-1000, 1000, (50, 6))
    squares = whitening._squares(np.zeros(6, np.int64))(z)
    got = whitening.covariance(50, [int(s) for s in z.sum(axis=0)], squares)
    assert np.allclose(got, np.cov(z.T, bias=True), rtol=1e-12)


def test_sums_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(5)
    frame = vectors_of(spark, [(i, rng.standard_normal(8).tolist()) for i in range(500)])
    one, many = whitening.fit(frame.coalesce(1)), whitening.fit(frame.repartition(7))
    assert one.sums == many.sums and (one.values == many.values).all()
