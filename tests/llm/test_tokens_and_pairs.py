"""Token files (4), packing (7), piece scan (9), embedding (2) and document near-duplicates (10)."""

import itertools
import os
import random
import tempfile
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from riskflow.llm import common, components, cross_polytope, minhash, packing, piece_scan, record_files, tokens

BYTE, WORD, PIECE = (common.tokenizer_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = ["", " ", "a", " a", "a ", "a  b", "  ", "x \n y", "a  b", "don't stop", "it 's  '", "<|endoftext|> a", "é ́x", "A\tB C",
       "Σας ΣΑΣ", "a \x01 b", "１２ 3", "\x1c a", "a \x85 b", "İ I", "é. ,a ..", "\n a", "word, \n\nx", "ſ K", "w" * 300 + " x"]


def _direct(path, texts):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path,leading", [(BYTE, True), (WORD, False)])
def test_memoised_encoding_is_exact(path, leading, messy_rows, monkeypatch):
    rng = random.Random(1)
    texts = ODD + [t or "" for _, t in messy_rows]
    texts += ["".join(rng.choice(" .,\n'aBé1😀") for _ in range(rng.randint(0, 50))) for _ in range(400)]
    monkeypatch.setattr(tokens, "MEMO_ENTRIES", 50)
    encode, want = tokens.Encoder(path, leading), _direct(path, texts)
    for _ in range(2):
        got = [x for a, b in tokens.in_blocks(texts, 2000) for x in encode(texts[a:b])]
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


@pytest.mark.parametrize("path,leading", [(BYTE, True), (WORD, False)])
def test_line_ends_and_latin_letters_are_cut_exactly(path, leading):
    rng = random.Random(8)
    parts = ["\n", "\n\n", "\n\n\n", " ", " ", "  ", "one", "Two,", "Été", "3×4", "12.50", "naïve÷", "ÿÀ", "don't", "—", "\t", "漢字", "\u00a0", "\r\n"]
    texts = ["", "\n", "\n\n", "a\n\n", "\n\na", "a\n", "\na b\n", "a\n\nb c\n\n\nd", "a \nb", "a\n b", "é\né", "×", "c\n", "\nd"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    got = tokens.Encoder(path, leading)(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == _direct(path, texts)


@pytest.mark.parametrize("path,leading", [(BYTE, True), (WORD, False)])
def test_the_library_meets_each_pre_token_once(path, leading):
    class Counting:
        def __init__(self, tok):
            self.tok, self.model, self.chars = tok, self, 0

        def tokenize(self, text):
            self.chars += len(text)
            return self.tok.model.tokenize(text)

        def encode_batch_fast(self, texts, **options):
            self.chars += sum(map(len, texts))
            return self.tok.encode_batch_fast(texts, **options)

        def encode(self, words, **options):
            self.chars += sum(map(len, words))
            return self.tok.encode(words, **options)

    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(150)]
    texts = [rng.choice(words) + "".join(rng.choice((" ", " ", "\n", "\n\n", ", ")) + rng.choice(words) for _ in range(40)) for _ in range(600)]
    encode = tokens.Encoder(path, leading)
    encode.tok = counting = Counting(encode.tok)
    got = [x for a, b in tokens.in_blocks(texts, 30_000) for x in encode(texts[a:b])]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == _direct(path, texts)
    assert counting.chars <= sum(2 * len(w) + 1 for w in words) + 10     # each with and without its space, and the marks


@pytest.mark.parametrize("path,leading", [(BYTE, True), (WORD, False)])
def test_operators_encode_special_tokens_as_the_plain_call(path, leading, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(tokens, "_ENCODERS", {})
    texts = ODD + ["end <|endoftext|> start", "<|endoftext|>", "x<|endoftext|><|startoftext|>y", " <|endoftext|>  z ", "<|ENDOFTEXT|> <|endoftext"]
    texts += [" ".join(rng.choice(("one", "two,", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "endoftext", "", "é.")) for _ in range(9))
              for _ in range(200)]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in tokens.encoder(path, leading)(texts)] == want


def test_special_tokens_in_files_and_sequences(spark):
    rows = [(1, "one two"), (2, "end <|endoftext|> start"), (3, "three")]
    docs, plain = spark.createDataFrame(rows, "doc_id long, text string"), {
        p: [e.ids for e in Tokenizer.from_file(p).encode_batch([t for _, t in rows], add_special_tokens=False)] for p in (BYTE, WORD)}
    got = sorted(record_files.read(_written(spark, docs)[1]).collect(), key=lambda r: r.start)
    ids = [i + [2] for i in plain[BYTE]]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == ids
    assert [r.start for r in got] == [0, *itertools.accumulate(map(len, ids))][:3]
    pieces = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pack(docs, WORD, end_id=0, capacity=64).collect()}
    assert pieces == {d: (len(i) + 1, zlib.crc32(np.array(i + [0], "<u4").tobytes())) for (d, _), i in zip(rows, plain[WORD])}


# ------------------------------------------------------------------- token files
def _written(spark, docs):
    folder = tempfile.mkdtemp(prefix="rf-records-")
    return folder, record_files.write(docs, folder, BYTE, end_id=2, partitions=4)


def test_records_round_trip_in_order_and_shuffled(spark, messy, messy_rows):
    folder, manifest = _written(spark, messy)
    rows = sorted(((d, t or "") for d, t in messy_rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    ids = [i + [2] for i in _direct(BYTE, [t for _, t in rows])]
    starts = [0, *itertools.accumulate(map(len, ids))]
    want = [(d, s, len(i), i) for (d, _), s, i in zip(rows, starts, ids)]
    for seed in (None, 3):
        got = record_files.read(manifest, shuffle_seed=seed, block=3).collect()
        got.sort(key=lambda r: r.start)
        assert [(r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in got] == want
    assert sorted(f for f in os.listdir(folder) if not f.startswith(".")) == sorted(
        f"part-{r.shard:05d}.{x}" for r in manifest.collect() for x in ("rec", "idx"))


def test_damage_is_noticed(spark, messy):
    folder, manifest = _written(spark, messy)
    path = os.path.join(folder, next(f for f in os.listdir(folder) if f.endswith(".rec") and not f.startswith(".")))
    with open(path, "r+b") as f:
        f.seek(20)
        f.write(b"\xff\xff")
    with pytest.raises(Exception, match="damaged"):
        record_files.read(manifest).collect()
    data = record_files.frame(b"payload") + record_files.frame(b"")
    first, at = record_files.unframe(data)
    assert first == b"payload" and record_files.unframe(data, at) == (b"", len(data))


def test_no_document_no_shard(spark, nothing):
    _, manifest = _written(spark, nothing)
    assert manifest.count() == 0 and record_files.read(manifest).count() == 0


# ----------------------------------------------------------------------- packing
@pytest.mark.parametrize("seed", range(4))
def test_sweeps_place_everything_in_few_sequences(seed):
    rng = np.random.default_rng(seed)
    sizes = np.clip(rng.exponential([40, 300, 700, 1500][seed], 5000).astype(int) + 1, 1, 2048)
    counts = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True))))
    runs, opened, _ = packing.sweep_rounds(counts, 2048)
    fill, placed = {}, {k: 0 for k in counts}
    for i, r in enumerate(runs):
        last = i + 1 == len(runs) or runs[i + 1]["length"] != r["length"]
        n = (counts[int(r["length"])] if last else int(runs[i + 1]["rank"])) - int(r["rank"])
        for k in range(n):
            b, slot = divmod(k, int(r["per_gap"]))
            fill.setdefault(int(r["sequence"]) + b, []).append((int(r["offset"]) + slot * int(r["length"]), int(r["length"])))
        placed[int(r["length"])] += n
    assert placed == counts and len(fill) == opened
    for items in fill.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    bound = -(-int(sizes.sum()) // 2048)
    first_fit = []                                   # first-fit decreasing, for comparison
    for s in sorted(sizes, reverse=True):
        for k, room in enumerate(first_fit):
            if room >= s:
                first_fit[k] -= s
                break
        else:
            first_fit.append(2048 - s)
    assert bound <= opened <= len(first_fit) * 1.01 + 1


def test_pack_documents(spark, messy, messy_rows, nothing):
    got = packing.pack(messy, WORD, end_id=0, capacity=64).toPandas()
    want = []
    for (d, _), ids in zip(messy_rows, _direct(WORD, [t or "" for _, t in messy_rows])):
        ids = ids + [0]
        want += [(d, p, a, len(ids[a:a + 64]), zlib.crc32(np.array(ids[a:a + 64], "<u4").tobytes()))
                 for p, a in enumerate(range(0, len(ids), 64))]
    have = [(None if np.isnan(d) else int(d), *map(int, r)) for d, *r in
            got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    got = got.sort_values(["sequence_id", "offset"])
    assert (got["offset"] == got.groupby("sequence_id")["length"].cumsum() - got["length"]).all()
    assert got.groupby("sequence_id")["length"].sum().max() <= 64
    assert packing.pack(nothing, WORD).count() == 0


# -------------------------------------------------------------------- piece scan
def _chunked(p, text, size):
    s, m = piece_scan.normalised(text), p.longest
    rows = [(s[max(0, a - m):a + size + m], min(a, m), min(size, len(s) - a)) for a in range(0, len(s), size)]
    ms = [p.matrix(x, a, a + n, k == 0) for k, (x, a, n) in enumerate(rows)]
    left = piece_scan.combine(piece_scan.combine(ms[0], ms[1]), ms[2]) if len(ms) > 2 else None
    if left is not None:
        assert left == piece_scan.combine(ms[0], piece_scan.combine(ms[1], ms[2]))     # associative
    whole = ms[0]
    for x in ms[1:]:
        whole = piece_scan.combine(whole, x)
    (end,) = whole[piece_scan.START]
    states = piece_scan.best_path(ms, piece_scan.START, end)
    return b"".join(p.between(x, a, a + n, states[k], states[k + 1]) for k, (x, a, n) in enumerate(rows))


def test_words_searched_together_equal_the_library(words, monkeypatch):
    monkeypatch.setattr(piece_scan, "SEARCHED", 50)
    monkeypatch.setattr(piece_scan, "MEMO_ENTRIES", 100)
    library, rng = sentencepiece.SentencePieceProcessor(model_file=PIECE), random.Random(8)
    p = piece_scan.Pieces(PIECE)
    texts = [t for t in ODD if t] + [" ".join(rng.choice(words) + rng.choice(("", ",", "ing", "1972", "é", "日本", "\x01")) for _ in range(40))
                                     for _ in range(40)] + ["z" * 200 + " x" * 40, "ab" * 33]
    for first in range(0, len(texts), 7):
        block = texts[first:first + 7]
        p.learn(list(map(piece_scan.normalised, block)))
        assert [np.frombuffer(p.encode(piece_scan.normalised(t)), "<u4").tolist() for t in block] == list(map(library.encode, block))
    alone = piece_scan.Pieces(PIECE)
    plain = [w for w in words if all(c in alone.ids for c in w)]
    assert p.search(plain) == [alone.core(w) for w in plain]
    p.learn([])


def test_a_block_of_pieces_looks_up_each_stretch_once(words, monkeypatch):
    library, rng = sentencepiece.SentencePieceProcessor(model_file=PIECE), random.Random(9)
    p, asked = piece_scan.Pieces(PIECE), []
    look_up = p._ids
    monkeypatch.setattr(p, "_ids", lambda stretches: asked.append(stretches) or look_up(stretches))
    texts = [*ODD, "", " ".join(rng.choice(words) for _ in range(3000)), "▁▁ a▁b", "xy" * 90, *ODD[::-1]]
    texts = [t or "" for t in texts]
    for _ in range(2):
        got = p.encode_all(list(map(piece_scan.normalised, texts)))
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == list(map(library.encode, texts))
        assert [x[1:] for x in p.decode_all(got)] == [t.replace("▁", " ").encode() for t in texts]
    assert len(asked) == 2 and all(len(x) == len(set(x)) < 1500 for x in asked)
    assert p.encode_all([]) == p.decode_all([]) == [] and p.encode_all([""]) == p.decode_all([b""]) == [b""]


def test_pieces_equal_the_library_at_any_chunk_size():
    p, library, rng = piece_scan.pieces(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE), random.Random(3)
    texts = [t for t in ODD if t] + ["".join(rng.choice(a) for _ in range(rng.randint(1, 60)))
                                     for a in ("aab", " a b", " .\n\tab", "日本語 é😀ab", "▁ a", "ther in", " 0123,.") for _ in range(60)]
    for t in texts:
        want = library.encode(t)
        assert np.frombuffer(p.encode(piece_scan.normalised(t)), "<u4").tolist() == want
        for size in (1, 2, 7, 33):
            ids = _chunked(p, t, size)
            assert np.frombuffer(ids, "<u4").tolist() == want, (t, size)
        assert p.decode(ids) == t.replace("▁", " ").encode()


def test_scan_over_blocks_of_blocks(spark, messy, messy_rows, nothing, monkeypatch):
    monkeypatch.setattr(piece_scan, "FAN_IN", 4)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = piece_scan.encode(messy, PIECE, size=500).collect()
    want = []
    for d, t in messy_rows:
        ids = library.encode(t or "")
        want.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), zlib.crc32((t or "").encode())))
    assert sorted(((r.doc_id, r.n_pieces, r.ids_crc32, r.decoded_crc32) for r in got), key=repr) == sorted(want, key=repr)
    assert max(r.n_chunks for r in got) > 64
    assert piece_scan.encode(nothing, PIECE).count() == 0


def test_crc_shift_joins_checksums():
    a, b = b"some bytes", b"and others" * 7
    assert zlib.crc32(a + b) == piece_scan.crc_shift(zlib.crc32(a), len(b)) ^ zlib.crc32(b)
    assert piece_scan.crc_shift(zlib.crc32(a), 0) == zlib.crc32(a)


# -------------------------------------------------------------------- components
def _roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(140)] + [(k, k + 1) for k in range(400, 460)]
    edges += [(500, k) for k in range(501, 540)] + [(7, 7)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == _roots(nodes, [e for e in edges if e[0] != e[1]])


# -------------------------------------------------------------------- embeddings
def test_embedding_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cross_polytope, "BLOCK", 40)          # several blocks to a hot bucket
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 24))
    x = np.concatenate([base + rng.normal(scale=s, size=base.shape) for s in (0.02, 0.05, 0.12, 0.2)]
                       + [base[:1] + rng.normal(scale=0.04, size=(150, 24))])
    rows = [(i, str(i % 3) if i < 240 else "1", v.tolist()) for i, v in enumerate(x)]
    rows += [(400, "1", rows[1][2]), (401, "1", rows[1][2]), (402, None, rows[1][2]), (403, "1", None), (404, "1", [0.0] * 24),
             (405, "1", [float("nan")] * 24), (406, "1", [float("inf")] * 24), (407, "1", [None] * 24), (408, "1", rows[1][2][:12]),
             (409, "1", []), (410, "1", (np.array(rows[1][2]) * 1e-200).tolist()), (410, "1", rows[1][2])]
    df = spark.createDataFrame(rows, "id long, label string, vector array<double>").repartition(4)
    units = cross_polytope.unit([None if v is None else [np.nan if c is None else c for c in v] for _, _, v in rows])
    want, edges = [], []
    for (i, li, _), u in zip(rows, units):
        n = -1
        for (j, lj, _), w in zip(rows, units):
            if u is not None and w is not None and li is not None and li == lj and len(u) == len(w) and float(u @ w) >= .98:
                n += 1
                edges.append((i, j))
        want.append((i, max(n, 0)))
    roots = _roots({r[0] for r in rows}, edges)
    got = cross_polytope.near_duplicates(df).collect()
    total, found = sum(n for _, n in want), sum(r.n_links for r in got)
    assert found == total > 1000                                 # recall 1 on this fixture
    assert sorted((r.id, r.n_links) for r in got) == sorted(want)
    assert all(r.component_id == roots[r.id] for r in got)
    empty = df.limit(0)
    assert cross_polytope.near_duplicates(empty).count() == 0


# ------------------------------------------------------------ document near-copies
def _sets(rows):
    out = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        out[d] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return out


def test_near_copies_equal_brute_force(spark, words, messy_rows, nothing, messy):
    rng = random.Random(8)
    rows = [(d, t) for d, t in messy_rows if d is not None]
    rows = list(dict(rows).items())
    passage = " ".join(rng.choice(words) for _ in range(40))
    for group in range(3):                              # groups of near copies, edited more and more
        text = [rng.choice(words) for _ in range(120)]
        for k in range(60):
            w = list(text)
            for _ in range(rng.choice((0, 1, 1, 2, 2, 3, 4, 6, 9))):
                w[rng.randrange(len(w))] = rng.choice(words) + "x"
            rows.append((1000 * (group + 1) + k, " ".join(w) + ("" if k % 9 else " " + passage)))
    rows += [(5000 + k, " ".join(rng.choice(words) for _ in range(60)) + " " + passage) for k in range(80)]
    sets = _sets(rows)
    edges = [(a, b) for a, b in itertools.combinations(sets, 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    roots = _roots(sets, edges)
    assert len(set(roots.values())) < len(rows) - 60 and len(edges) > 300      # the fixture has chains and strangers
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert {r.doc_id: r.component_id for r in got} == roots
    assert all(r.n_shingles == len(sets[r.doc_id]) for r in got) and len(got) == len(rows)
    again = minhash.near_duplicates(messy).collect()      # repeated and null ids
    assert len(again) == messy.count()
    assert {r.component_id for r in again if r.doc_id is None} == {None}
    assert {r.component_id for r in again if r.doc_id in (5, 31, 32)} == {5} and {r.component_id for r in again if r.doc_id == 8} == {7}
    assert minhash.near_duplicates(nothing).count() == 0


def test_different_texts_of_one_id_all_link(spark, words):
    rng = random.Random(12)
    a, b, c, d, e, f = (" ".join(rng.choice(words) for _ in range(80)) for _ in range(6))
    rows = [(5, a), (5, b), (5, c), (5, ""), (6, a + " x"), (7, b + " y"), (8, c + " z"), (9, b), (3, d), (10, d + " x"), (10, f),
            (11, e), (11, f + " y"), (12, e + " x"), (2, f + " z"), (20, "alone " * 9), (21, ""), (20, "")]
    want = {5: 5, 6: 5, 7: 5, 8: 5, 9: 5, 3: 2, 10: 2, 11: 2, 12: 2, 2: 2, 20: 20, 21: 21}
    for order in (rows, rows[::-1]):
        got = minhash.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").repartition(3)).collect()
        assert len(got) == len(rows)
        assert [(r.doc_id, r.component_id) for r in got if r.component_id != want[r.doc_id]] == []


def test_a_worker_lets_go_of_the_encoders():
    a = tokens.encoder(WORD, False)
    assert tokens.encoder(WORD, False) is a
    common.forget()
    b = tokens.encoder(WORD, False)
    assert b is not a and b(["some words"]) == a(["some words"])
