"""Ranked search against plain scoring: shards in memory, whole tables, passes, odd inputs."""

import math
import random
import re
from collections import Counter
from types import SimpleNamespace

import pytest

from riskflow.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FIELDS = [x.split()[0] for x in lexical.INDEX.split(", ")]


def _terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _plain(docs, items, k=10):
    held = [(d, Counter(_terms(t))) for d, t in docs if _terms(t)]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scores = []
        for d, c in held:
            m, s = 100 - 75 + (75 * sum(c.values()) * n_docs) // total, 0
            for t, q in Counter(_terms(text)).items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    s += q * w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def test_terms():
    for text in ["Ab-c 12x_É ÄÖß", "", " \n", "a b c\x7fd\x00e", "😀 K İ"]:
        assert [t.decode() for t in lexical.terms(text)] == _terms(text)


def _corpus(rng, n):
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    return [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 80)) + ["w7"] * (300 if i % 97 == 0 else 0))) for i in range(n)]


def test_a_shard_gives_the_best_and_leaves_blocks_closed():
    rng = random.Random(4)
    docs = _corpus(rng, 3000)
    items = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(1, 12)))) for i in range(60)] + [(90, "w250 w0 w1 w2 w0")]
    vocabulary = {t.encode(): i for i, t in enumerate(sorted({t for _, x in items for t in _terms(x)}))}
    writer = lexical.ShardWriter(vocabulary)
    for d, t in docs:
        writer.add(d, t)
    rows = [SimpleNamespace(**dict(zip(FIELDS, r))) for r in writer.rows(5)]
    n_docs, total = rows[0].df, rows[0].occurrences
    df = {r.term: r.df for r in rows[1:]}
    found = []
    for item, text in items:
        shard = lexical.Shard(rows, n_docs, total)
        query = [(vocabulary[t.encode()], q * lexical.weight(n_docs, df[vocabulary[t.encode()]]))
                 for t, q in Counter(_terms(text)).items() if vocabulary[t.encode()] in df]
        found += [(item, r, d, s) for r, (d, s) in enumerate(shard.search(query, 10), 1)]
        if item == 90:
            opened = [(len(x.open), len(x.blocks)) for x in shard.lists.values() if x.open]
            assert any(a < b for a, b in opened)               # of a common term's list only some blocks
    assert sorted(found, key=str) == _plain(docs, items)


@pytest.mark.parametrize("pass_terms", [10_000, 40])
def test_tables_equal_plain_scoring(spark, messy_rows, pass_terms):
    rng = random.Random(6)
    docs = _corpus(rng, 400) + messy_rows + [(5, "w3 w4")] * 3
    items = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(8))) for i in range(20)]
    items += [(3, None), (4, ""), (5, "nothing known"), (6, "no id here"), (7, "ONE Two é😀"), (7, "ONE Two é😀"), (None, "w1 w2")]
    table = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, score string").repartition(6)
    got = lexical.ranking(table, spark.createDataFrame(items, "item_id long, text string"), pass_terms=pass_terms).collect()
    want = _plain(docs, [(i, t) for i, t in items if t is not None])
    assert sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in got], key=str) == want


def test_empty_tables(spark, nothing, messy):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert lexical.ranking(nothing, items).count() == 0
    assert lexical.ranking(messy, items.limit(0)).count() == 0
