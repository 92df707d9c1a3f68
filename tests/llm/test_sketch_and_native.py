"""Operators in DataFrame functions: fingerprints (1), personal data (5), licenses (6)."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from riskflow.llm import common, iblt, licenses, pii


def _pandas(df):
    return df.toPandas()


# ------------------------------------------------------------------ fingerprints
def _paragraphs(t):
    out = set()
    for p in re.split(r"\n+|(?<=[.!?])[ \t\n\x0b\f\r]+|(?<=[。！？])", t):
        if len(p) > iblt.LONG:
            marked = [w + "\n" * (xxhash.xxh64(w.encode(), seed=42).intdigest() % iblt.SPREAD == 0)
                      for w in re.split(r"[ \t\n\x0b\f\r]+", p)]
            out |= {x.strip(" ") for x in " ".join(marked).split("\n")}
        else:
            out.add(p.strip(" "))
    return out - {""}


def _jaccard(a, b):
    a, b = _paragraphs(a), _paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_equal_brute_force(spark, messy, messy_rows):
    got = _pandas(iblt.compare(messy))
    rows = sorted(((d, t or "") for d, t in messy_rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for (d, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        e = t[:len(t) - half] + n[:half]
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), round(_jaccard(t, e), 9), round(_jaccard(t, n), 9)))
    have = [(None if np.isnan(d) else int(d), n, s, round(x, 9), round(y, 9)) for d, n, s, x, y in
            got[["doc_id", "n_chars", "edited_sha256", "near_edited", "near_next"]].itertuples(index=False)]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    by_sha = {}
    for d, fp in got[["doc_id", "fingerprint"]].itertuples(index=False):
        by_sha.setdefault(d, set()).add(fp)
    assert len(by_sha[30.0]) == 1 and by_sha[5.0] == by_sha[31.0] != by_sha[32.0]


def test_texts_without_sentence_ends_keep_their_likeness(spark, words):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([900, 700, 2500, 300])]
    rows += [(10, "これは文です。" * 3 + "次の文です！" + "最後の文？")]
    got = {r.doc_id: r for r in iblt.compare(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].near_edited > 0.15 and got[i].n_paragraphs > 5 for i in range(4))
    assert got[10].n_paragraphs == 3


def test_blocks_of_a_large_range_and_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(iblt, "BLOCK", 3)
    rows = [(i // 20, f"one {i % 7}. two {i}. three {i % 3}.") for i in range(120)]
    got = [(r.doc_id, round(r.near_next, 9)) for r in iblt.compare(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    rows.sort()
    want = [(d, round(_jaccard(t, n), 9)) for (d, t), (_, n) in zip(rows, rows[1:] + rows[:1])]
    assert sorted(got) == sorted(want)


def test_fingerprints_of_one_and_no_document(spark, nothing):
    one = spark.createDataFrame([(5, "abc. def")], "doc_id long, text string")
    r = iblt.compare(one).first()
    assert (r.near_next, r.n_chars) == (1.0, 8)
    assert iblt.compare(nothing).count() == 0


def test_peeling_retries_until_all_differences_are_recovered(spark):
    rng = random.Random(1)
    rows = [(i, 1, [rng.getrandbits(62) for _ in range(a)], [rng.getrandbits(62) for _ in range(b)], [])
            for i, (a, b) in enumerate([(0, 0), (1, 0), (3, 4), (60, 50), (900, 2), (4000, 4000)])]
    shared = list(range(1, 3000))
    rows.append((6, 1, shared + [-5], shared + [-6, -7], shared))
    t = spark.createDataFrame(rows, "range int, row int, digests array<long>, edited_digests array<long>, next_digests array<long>")
    got = {(r.range, r.pair): r.differing for r in iblt.differences(t).collect()}
    assert [got[i, 1] for i in range(7)] == [0, 1, 7, 110, 902, 8000, 3]
    assert got[6, 2] == 1 and got[5, 2] == 4000


# ----------------------------------------------------------------- personal data
PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def _luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def _base(t):
    out = []
    for kind, p in PATTERNS:
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (16 <= len(d) <= 19 and _luhn(d))
                    or kind == "phone" and not 8 <= len(d) <= 15):
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(0, 60)))
             for a in ("0123456789 -", "0123.. ", "+012 ()-.5", "ab@.c-_%+ ", "4111 1111-0.@+a😀") for _ in range(120)]
    texts += ["4111 1111 1111 1111 😀 a@b.c_d@e.f +1 (444) 555-4984 é 10.0.0.255 1.2.3.4.5", "1" * 20_000, "1 " * 12_000,
              "a" * 20_000 + "@", "a.b@c" + ".d" * 6000, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = dict(df.select("doc_id", pii.listed(pii.base_spans(F.col("text")))).collect())
    assert all(got[i] == ",".join(f"{k}:{a}:{b}" for k, a, b in _base(t)) for i, t in enumerate(texts))


def test_trees_learn_and_their_sql_form_agrees(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 20, (2000, len(pii.FEATURES))).astype(float)
    x[:, 0] = rng.integers(0, 4, 2000)
    y = ((x[:, 2] > 9) & (x[:, 12] > 5)).astype(float)
    model = pii.fit(x, y, np.arange(2000) % 4 == 0)
    p = model.predict(x)
    assert ((p > .5) == y).mean() > .98 and set(model.thresholds) == {0, 1, 2, 3}
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x[:50])], "i int, x array<double>")
    sql = dict(df.select("i", model.column(F.col("x"))).collect())
    assert np.allclose([sql[i] for i in range(50)], p[:50])
    assert pii.fit(x, np.zeros(2000), np.arange(2000) % 4 == 0).thresholds == {}


def test_added_spans_keep_clear_of_base_and_of_each_other(spark):
    model = pii.Trees(0.0, [(1, 10.0, -3.0, (1, 15.0, 2.0, 3.0))], {0: 0.5})
    cands = [(0, 0, 20, 20.0), (0, 5, 18, 13.0), (0, 30, 42, 12.0), (0, 50, 55, 5.0), (0, 60, 72, 12.0), (1, 80, 99, 19.0)]
    base = [(0, 41, 44)]
    df = spark.createDataFrame([(base, [(k, a, b, [float(k), n]) for k, a, b, n in cands])],
                               "b array<struct<kind:int,start:int,end:int>>, c array<struct<kind:int,start:int,end:int,x:array<double>>>")
    got = df.select(pii.added_spans(model, F.col("b"), F.col("c"))).first()[0]
    assert sorted((s["kind"], s["start"], s["end"]) for s in got) == [(0, 0, 20), (0, 60, 72)]


def test_find_and_redact(spark, messy, messy_rows):
    docs = common.id_and_text(messy)
    found = pii.find(docs, pii.train(docs)).select("doc_id", "text", "pii_base", pii.redacted(
        F.col("text"), F.concat("pii_base", "pii_added")).alias("clean")).collect()
    assert len(found) == len(messy_rows)
    for r in found:
        assert [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in r.pii_base] == _base(r.text)
    assert next(r.clean for r in found if r.doc_id == 12) == "[CARD] é😀 [EMAIL] ŰÑ"


def test_other_forms_are_added_and_plain_numbers_left(spark):
    rng = random.Random(12)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    prose = lambda: " ".join(word() for _ in range(8))
    fill = [lambda: f"write to {word()}.{word()}@{word()}.com now", lambda: f"call +49 {num(3)} {num(7)} today",
            lambda: f"in 20{num(2)} there were {num(5)} of them", lambda: f"part {num(3)}-{num(3)} {word()}", prose]
    rows = [(i, ". ".join(f"{prose()} {rng.choice(fill)()} {prose()}" for _ in range(4))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model = pii.train(common.id_and_text(docs))
    assert 0 in model.thresholds
    probe = [(1, "reach me at jane.doe [at] example [dot] org please"), (2, "or at jane.doe(at)example.org please"),
             (3, "in 2019 there were 31415 of them"), (4, "part 123-456 of it, at (at) the end [dot]"), (5, "a@b.co")]
    got = {r.doc_id: [(pii.KINDS[s["kind"]], r.text[s["start"]:s["end"]]) for s in r.pii_added]
           for r in pii.find(spark.createDataFrame(probe, "doc_id long, text string"), model).collect()}
    assert got == {1: [("email", "jane.doe [at] example [dot] org")], 2: [("email", "jane.doe(at)example.org")], 3: [], 4: [], 5: []}


def test_every_candidate_is_learned_from_held_or_spread(spark):
    texts = F.expr("""concat('write to u', id % 977, '.x@host', id % 31, '.com or call +49 ', 100 + id % 800, ' ', 1000000 + id * 7,
                      ', room ', id % 90, '-', 1000 + id % 9000)""")
    docs = spark.range(0, 45_000, 1, 4).select(F.col("id").alias("doc_id"), texts.alias("text"))
    counts = pii.labelled(docs).agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")).first()
    proposed = docs.select(F.explode(pii.candidates(F.col("text")))).count()
    other = pii.rewritten_candidates(docs.select(F.col("doc_id").alias("spot"), "text", pii.base_spans(F.col("text")).alias("base"))).count()
    assert proposed > 45_000 * 2 and counts.no + counts.yes > proposed + 45_000 and other > 45_000
    one, many = pii.train(docs), pii.train(docs, most_held=0)
    assert len(one.trees) == pii.TREES and one.thresholds and one.thresholds.keys() == many.thresholds.keys()
    x = np.array([r[0] for r in pii.labelled(docs.limit(300)).select("x").collect()])
    assert np.allclose(one.predict(x), many.predict(x), atol=1e-3)


def test_quantiles_of_counted_candidates_are_exact(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 60, (900, len(pii.FEATURES))).astype(float)
    rows = spark.createDataFrame([(r.tolist(), 1, 2) for r in x], "x array<double>, no long, yes long")
    got = pii.quantile_cuts(rows, 2700)
    for f in range(x.shape[1]):
        assert got[f].tolist() == np.unique(np.quantile(np.repeat(x[:, f], 3), pii.SHARES, method="lower")).tolist()


def test_rewritten_spans_are_no_base_spans_but_candidates(spark):
    texts = ["x ann@host.co.uk, y", "pay 4111 1111 1111 1111 x", "tel +44 20 7946 0958 x", "10.0.0.1"]
    picked = spark.createDataFrame(list(enumerate(texts)), "spot long, text string").withColumn("base", pii.base_spans(F.col("text")))
    got = pii.rewritten_candidates(picked).collect()
    assert {r.spot for r in got} == {0, 1, 2} and all(r.y == 1 for r in got)
    forms = [F.lit(0), F.lit(1)]
    made = picked.select(F.explode("base").alias("b"), "text").select(*[pii.rewritten(F.substring(
        F.col("text"), F.col("b.start") + 1, F.col("b.end") - F.col("b.start")), F.col("b.kind"), f).alias(f"f{i}") for i, f in enumerate(forms)])
    shown = [x for r in made.collect() for x in r if x is not None]
    assert len(shown) == 6 and all(_base(x) == [] for x in shown)


# ---------------------------------------------------------------------- licenses
def _license_words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def test_phrases_equal_brute_force(spark, messy, nothing):
    rng = random.Random(4)
    parts = [w for p in licenses.PHRASES for w in p.split()] + ["License", "MIT", "CC", "BY,", "É", "K", "İ", "by-", "\n"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(300)] + [(300, None), (None, "MIT license")]
    rows += [(5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = []
    for d, t in rows:
        w, at, labels = _license_words(t), [], set()
        for p, label in licenses.PHRASES.items():
            q = p.split()
            for k in range(len(w) - len(q) + 1):
                if w[k:k + len(q)] == q:
                    at.append(k)
                    labels.add(label)
        want.append((d, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    got = [tuple(r)[:6] for r in licenses.label_documents(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert licenses.label_documents(nothing).count() == 0
    assert licenses.label_documents(messy).count() == messy.count()


@pytest.mark.parametrize("notice", sorted(licenses.NOTICES))
def test_notices_survive_small_edits(spark, notice):
    w = notice.split()
    edited = w[:len(w) // 2] + ["inserted"] + w[len(w) // 2:]
    half = w[:len(w) // 3]
    df = spark.createDataFrame([("whole", "xx " + notice.upper()), ("edited", "yy yy " + " ".join(edited)), ("part", " ".join(half))],
                               "key string, text string")
    found = {(r.key, r.label) for r in licenses.scan(df, {}, {notice: licenses.NOTICES[notice]}).collect()}
    label = licenses.NOTICES[notice]
    assert ("whole", label) in found and ("part", label) not in found
    if len(w) >= 16:
        assert ("edited", label) in found


def test_license_paragraphs_are_found_without_a_notice(spark):
    rng = random.Random(6)
    filler = ["zeta", "omicron", "said", "river", "walks", "the", "of"]
    prose = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    rows, want = [], {}
    for i, (body, label) in enumerate(sorted(licenses.BODIES.items())):
        w = body.split()
        cut = w[:len(w) // 2] + ["really"] + w[len(w) // 2:]          # a word put in
        gone = w[:len(w) // 2] + w[len(w) // 2 + 1:]                  # a word left out
        rows += [(3 * i, f"{prose(30)}\n{body}\n{prose(9)}"), (3 * i + 1, f"{prose(5)} {' '.join(cut)}"), (3 * i + 2, " ".join(w[:len(w) // 4]))]
        want[3 * i] = want[3 * i + 1] = label
        if len(w) > 30:
            rows.append((1000 + i, " ".join(gone)))
            want[1000 + i] = label
    rows += [(5000, prose(4000)), (5001, "software " * 3000), (5002, "the software is provided to the authors of any kind " * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in licenses.label_documents(docs, {}, licenses.BODIES).collect()}    # no phrase and no notice helps
    for i, label in want.items():
        assert label in got[i].labels.split(","), (i, label)
    for i in [r[0] for r in rows if r[0] not in want]:
        assert got[i].labels == "" and got[i].score == 0.0


def test_spans_of_long_templates_equal_brute_force(spark):
    rng = random.Random(8)
    template = " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(400))
    w = template.split()
    rows = [(str(i), " ".join(["zz"] * i + w[:a] + ["yy"] * gap + w[b:])) for i, (a, b, gap) in enumerate(
        [(400, 400, 0), (200, 200, 2), (100, 103, 0), (40, 300, 0), (300, 300, 9)])]
    df = spark.createDataFrame(rows, "key string, text string")
    grams = {tuple(w[q:q + 4]) for q in range(397)}
    assert len(grams) == 397                                          # a position is told by its words
    got = {r.key: (r.first, r.last, round(r.score * 397)) for r in licenses.scan(df, {}, {template: "x"}).collect()}
    assert got == {"0": (0, 399, 397), "1": (1, 402, 394), "2": (2, 398, 391), "4": (4, 303, 297)}
