"""The manifest against plain trees: repeated and null ids, null groups, several blocks and passes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from riskflow.llm import common, merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row, more=0):
    row = list(row)
    row[3] = None if row[3] is None else row[3] + more
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h("".join(levels[-1][i:i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def _path(levels, i):
    out = []
    for nodes in levels[:-1]:
        out.append((i % 2, nodes[i ^ 1]) if i ^ 1 < len(nodes) else None)
        i //= 2
    return out


def _plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r[2] is not None, (r[2] or "").encode()), []).append(r)
    names = sorted(groups)
    trees = []
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        trees.append(_tree([_leaf(r) for r in groups[name]]))
    top, out = _tree([t[-1][0] for t in trees]), []
    for g, name in enumerate(names):
        for i, r in enumerate(groups[name]):
            path = _path(trees[g], i) + _path(top, g)
            node = _leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)
            for step in path:
                node = _h(node) if step is None else _h(step[1] + node) if step[0] else _h(node + step[1])
            out.append((str(r[0]), _leaf(r), trees[g][-1][0], top[-1][0], _h("".join(s[1] for s in path if s)), node, node == top[-1][0]))
    return sorted(out)


def _built(docs):
    tampered = F.when(common.crc_mod(F.col("doc_id"), 7) == 0, merkle.leaf(n_chars=F.expr("try_add(n_chars, 1)")))
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)
                  for r in merkle.manifest(docs, tampered).collect())


def test_repeated_null_negative_and_sparse_ids_over_several_blocks(spark):
    rng = random.Random(2)
    rows = [(i, "s", "en", i, f"text {i}") for i in range(2100)]
    rows += [(7, "s", "en", 7, "text 7")] * 1500 + [(8, "s", "en", k, "other") for k in range(40)]
    rows += [(None, None, "en", k % 5, "no id") for k in range(30)]
    rows += [(rng.randrange(-2 ** 63, 2 ** 63), "é", "für", None, None) for _ in range(50)]
    rows += [(-1, None, None, 3, ""), (None, None, None, None, None), (5, "a", "", 1, "ü")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit("clash")).withColumn("g", F.lit(1)).repartition(7)
    assert _built(docs) == _plain(rows)


@pytest.mark.parametrize("rows", [[], [(1, "s", "en", 1, "t")], [(1, "s", "en", 1, "t")] * 3, [(1, "s", "en", 1, "t"), (2, "s", "de", 1, "t")]])
def test_few_rows(spark, rows):
    assert _built(spark.createDataFrame(rows, SCHEMA)) == _plain(rows)


def test_messy_documents(messy, messy_rows):
    assert _built(messy) == _plain([(d, None, None, None if t is None else len(t), t) for d, t in messy_rows])
