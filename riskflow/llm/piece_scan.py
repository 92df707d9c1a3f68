"""SentencePiece encoding and decoding of whole texts by a max-plus parallel scan.

The public model at hand is a BPE model with byte fallback. Its encoding of a text is the
one segmentation into reachable pieces in which every two neighbours t, u are compatible:
BPE of their concatenation is t, u. (Merging inside a stretch does not depend on what lies
beyond pieces that never merge with it.) So encoding is a path search, and path search
composes: over the max-plus semiring with weight 0 for an allowed step and minus infinity
for any other, a chunk of text is a matrix from boundary states to boundary states.

A boundary state is the piece that reaches up to or across a chunk's border: (characters
of it behind the border, its length). Giant texts are cut into chunks of ``CHUNK``
characters at any place; a chunk carries ``margin`` characters of its neighbours.

1. Every chunk yields its matrix, independently; only states with a way through are kept.
2. The matrices are combined associatively, in blocks of ``FAN_IN`` and blocks of blocks;
   going down again, every chunk gets the states at its two borders on the best path of the whole text.
3. Every chunk backtraces between its own two states, independently, into ids.

Texts within one chunk skip 1 and 2. Inside a chunk, a place that no piece of the vocabulary
crosses has a single state: one between two characters that stand side by side in no piece (of the
model at hand: between a letter and a space mark or a comma, or two digits). A block of texts is cut at
all such places (numpy over its code points); Arrow counts each distinct stretch between them once
and deals its ids back to the places, and those not remembered are searched together
(``MEMO_ENTRIES`` stretches in each of two generations; speed only). Arrow decodes the ids of a block, too.

Normalisation is the model's own: a space mark put first, spaces written as marks, nothing
else changed; a mark in the text itself decodes to a space, as in the library.

Defined results: null and empty texts have no pieces; repeated rows are rows of their own;
characters outside the vocabulary become their UTF-8 bytes' pieces.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from riskflow.llm import common
from riskflow.llm.tokens import in_blocks
from riskflow.operators.materialize import materialize

CHUNK = 16_384
FAN_IN = 64
MEMO_ENTRIES = 300_000
SEARCHED = 8192                 # words in one path search
BLOCK = 2_000_000               # characters of whole texts encoded together
MARK = "▁"
START = (0, 0)
_MODELS: dict[str, "Pieces"] = {}
State = tuple[int, int]
Matrix = dict[State, list[State]]


class Pieces:
    """The vocabulary of a model file, and the path search over it."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.ids, self.scores = {}, {}
        self.bytes_of: list[bytes] = [b""] * size
        self.byte_ids = [0] * 256
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(piece[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.ids[piece], self.scores[piece] = i, model.get_score(i)
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
        self.longest = max(map(len, self.ids))
        self.prefixes = {p[:n] for p in self.ids for n in range(1, len(p) + 1)}
        self.joined = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        # characters of joined pairs by number (0: in none), and which numbers are joined
        paired = sorted({c for x in self.joined for c in x})
        number = {c: i for i, c in enumerate(paired, 1)}
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in paired]] = np.arange(1, len(paired) + 1)
        self.side = np.zeros((len(paired) + 1, len(paired) + 1), bool)
        for a, b in self.joined:
            self.side[number[a], number[b]] = True
        self.texts_of = pa.array(self.bytes_of, pa.large_binary())
        self.follows: dict[int, bool] = {}
        # the prefixes as a tree: (node, character) -> node, and the piece that ends there
        nodes = {x: i for i, x in enumerate(["", *sorted(self.prefixes)])}
        steps = sorted((nodes[x[:-1]] << 21 | ord(x[-1]), i) for x, i in nodes.items() if x)
        self.steps, self.child = (np.array(c, dtype=np.int64) for c in zip(*steps))
        self.piece_at = np.array([self.ids.get(x, -1) for x in nodes], dtype=np.int64)
        self.piece_of = {i: x for x, i in self.ids.items()} | {size: ""}

    def merged(self, text: str) -> list[str]:
        """BPE of a short text by its definition: best score first, then leftmost."""
        parts, score, none = list(text), self.scores.get, -float("inf")
        scores = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > none:
            i = scores.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = score(parts[i - 1] + parts[i], none)
            if i < len(scores):
                scores[i] = score(parts[i] + parts[i + 1], none)
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """May piece b follow piece a (a empty: may b stand first)?"""
        key = (a, b)
        if key not in self.pairs:
            if len(self.pairs) > 4 * MEMO_ENTRIES:
                self.pairs.clear()
            self.pairs[key] = self.merged(a + b) == ([a, b] if a else [b])
        return self.pairs[key]

    def forward(self, text: str, begin: int, before: str, end: int) -> dict[int, int]:
        """For positions reachable from ``begin`` (with piece ``before`` ending there): the
        length of the last piece on the one allowed path to it."""
        ids, pairs, prefixes, longest = self.ids, self.pairs, self.prefixes, self.longest
        last, ending = {begin: 0}, {begin: before}
        for q in range(begin, end):
            previous = ending.get(q)
            if previous is None:
                continue
            for p in range(q + 1, min(end, q + longest) + 1):
                piece = text[q:p]
                # one path leads to a place, so a place once reached needs no further piece
                if p not in last and (piece in ids or p == q + 1):
                    allowed = pairs.get((previous, piece))
                    if allowed or allowed is None and self.compatible(previous, piece):
                        last[p], ending[p] = p - q, piece
                if piece not in prefixes:
                    break
        return last

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible`` of many (piece id, piece id); the id behind the last stands for none."""
        known, size = self.follows, len(self.bytes_of)
        if len(known) > 2 * MEMO_ENTRIES:
            known.clear()
        keys = (a << 32 | b).tolist()
        for key in {k for k in keys if k not in known}:
            x, y = self.piece_of[key >> 32], self.piece_of[key & 0xFFFFFFFF]
            known[key] = self.merged(x + y) == ([x, y] if key >> 32 != size else [y])
        return np.fromiter(map(known.__getitem__, keys), dtype=bool, count=len(keys))

    def search(self, words: list[str]) -> list[bytes]:
        """Ids of words whose every character is a piece: the path search of ``forward``, one place
        at a time for all words together."""
        n, lengths = len(words), np.array([len(w) for w in words])
        width = int(lengths.max())
        text = np.zeros((n, width), dtype=np.int64)
        text[np.arange(width) < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        reached = np.full((n, width + 1), -1, dtype=np.int64)    # the piece that ends at a place
        back = np.zeros((n, width + 1), dtype=np.int64)          # and its length
        reached[:, 0] = len(self.bytes_of)
        for q in range(width):
            w = np.flatnonzero((reached[:, q] >= 0) & (lengths > q))
            node = np.zeros(len(w), dtype=np.int64)
            for k in range(1, self.longest + 1):
                inside = lengths[w] >= q + k
                w, node = w[inside], node[inside]
                key = node << 21 | text[w, q + k - 1] if len(w) else node
                at = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
                hit = self.steps[at] == key
                w, node = w[hit], self.child[at[hit]]
                if not len(w):
                    break
                piece = self.piece_at[node]
                new = (piece >= 0) & (reached[w, q + k] < 0)
                here, piece = w[new], piece[new]
                allowed = self.may_follow(reached[here, q], piece)
                here, piece = here[allowed], piece[allowed]
                reached[here, q + k], back[here, q + k] = piece, k
        ids, at = np.full((n, width), -1, dtype=np.int64), lengths.copy()
        for column in range(width - 1, -1, -1):
            w = np.flatnonzero(at)
            ids[w, column] = reached[w, at[w]]
            at[w] -= back[w, at[w]]
        data = ids[ids >= 0].astype("<u4").tobytes()
        ends = (4 * np.cumsum((ids >= 0).sum(axis=1))).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def _ids(self, stretches: list[bytes]) -> list[bytes]:
        """Ids of distinct stretches, from the memo or new."""
        young, most = self.young, 4 * self.longest
        out = list(map(young.get, stretches))
        plain: list[tuple[str, int]] = []
        for i, ids in enumerate(out):
            if ids is None:
                ids = self.old.get(stretches[i])
                if ids is None:
                    text = stretches[i].decode("utf-8", "surrogatepass")
                    if len(text) <= most and all(map(self.ids.__contains__, text)):
                        plain.append((text, i))
                        continue
                    ids = self.core(text)
                    if len(text) > most:
                        out[i] = ids
                        continue
                out[i] = young[stretches[i]] = ids
        plain.sort(key=lambda x: len(x[0]))
        for a in range(0, len(plain), SEARCHED):
            block = plain[a:a + SEARCHED]
            for (_, i), ids in zip(block, self.search([x for x, _ in block])):
                out[i] = young[stretches[i]] = ids
        if len(young) > MEMO_ENTRIES:
            self.old, self.young = young, {}
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each of some normalised texts, cut wherever no piece crosses."""
        text = "".join(texts)
        if not text:
            return [b""] * len(texts)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        bounds = np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))
        begin, number = np.ones(len(points), bool), self.number[points]
        np.logical_not(self.side[number[:-1], number[1:]], out=begin[1:])
        begin[bounds[:-1][np.diff(bounds) > 0]] = True
        begins = np.flatnonzero(begin)
        width = np.ones(len(points), np.int64)
        for least in (0x80, 0x800, 0x10000):
            width += points >= least
        data = text.encode("utf-8", "surrogatepass")
        offsets = np.append(np.add.reduceat(width, begins).cumsum() - np.add.reduceat(width, begins), len(data))
        found = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        known = self._ids(found.dictionary.to_numpy(zero_copy_only=False).tolist())
        return _dealt(pa.array(known, pa.large_binary()).take(found.indices), np.searchsorted(begins, bounds))

    def learn(self, texts: list[str]) -> None:
        """Remember the stretches of some normalised texts."""
        self.encode_all(texts)

    def trace(self, text: str, last: dict[int, int], begin: int, end: int) -> list[str]:
        out = []
        while end > begin:
            out.append(text[end - last[end]:end])
            end -= last[end]
        return out[::-1]

    def to_ids(self, pieces: list[str]) -> bytes:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            out += [i] if i is not None else [self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")]
        return np.array(out, dtype="<u4").tobytes()

    def core(self, text: str) -> bytes:
        """Ids of one stretch, by the path search of ``forward``."""
        return self.to_ids(self.trace(text, self.forward(text, 0, "", len(text)), 0, len(text)))

    def encode(self, text: str) -> bytes:
        """Ids of a whole normalised text."""
        return self.encode_all([text])[0]

    def cuts(self, text: str, begin: int, end: int) -> list[int]:
        """Places in (begin, end) that no piece crosses, counted from ``begin``."""
        joined = self.joined
        return [p - begin for p in range(begin + 1, end) if text[p - 1:p + 1] not in joined]

    def entries(self, text: str, a: int) -> Iterator[State]:
        """Boundary states at place ``a`` that the text allows."""
        for o in range(self.longest):
            for n in range(max(o, 1), self.longest + 1):
                if n > o - 0 and a + o - n >= 0 and a + o - n < a and a + o <= len(text):
                    piece = text[a + o - n:a + o]
                    if len(piece) == n and (n == 1 or piece in self.ids):
                        yield o, n

    def exits(self, text: str, last: dict[int, int], begin: int, before: str, b: int) -> list[State]:
        """States at ``b`` of pieces that start before it and follow an allowed path."""
        out = []
        for o in range(self.longest):
            end = b + o
            if end > len(text):
                break
            for n in range(o + 1, self.longest + 1):
                q = end - n
                if q < begin:
                    break
                k = last.get(q)
                if k is None:
                    continue
                piece = text[q:end]
                if (n == 1 or piece in self.ids) and self.compatible(text[q - k:q] if k else before, piece):
                    out.append((o, n))
        return out

    def matrix(self, text: str, a: int, b: int, first: bool) -> Matrix:
        """The transfer matrix of text[a:b] (``text`` has the margins): allowed entry -> exits."""
        near = [a + c for c in self.cuts(text, a, min(b, a + 8 * self.longest))]
        meeting = next((c for c in near if c >= a + self.longest), None)
        tail: list[State] | None = None
        found: Matrix = {}
        for o, n in [START] if first else self.entries(text, a):
            begin, before = a + o, text[a + o - n:a + o] if n else ""
            if meeting is None:
                if begin >= b:                     # a piece that covers the whole chunk
                    found[o, n] = [(o - (b - a), n)]
                    continue
                last = self.forward(text, begin, before, b)
                ways = self.exits(text, last, begin, before, b)
            # every path from a place that no piece crosses goes on to the next such place
            elif (place := next(c for c in near if c >= begin)) == begin or place in self.forward(text, begin, before, place):
                if tail is None:                   # from a place that no piece crosses, all go on alike
                    far = self.cuts(text, max(meeting, b - 8 * self.longest), b)
                    start = max(meeting, b - 8 * self.longest) + far[-1] if far else meeting
                    tail = self.exits(text, self.forward(text, start, "", b), start, "", b)
                ways = tail
            else:
                ways = []
            if ways:
                found[o, n] = ways
        return found

    def middle(self, text: str, a: int, b: int, entry: State, exit_: State) -> tuple[bytes, str, bytes]:
        """The pieces that start in text[a:b] on the path between two states: the ids up to the first
        place that no piece crosses, the text from there to the last such place, the ids behind it."""
        begin, end = a + entry[0], b + exit_[0]
        if begin >= b:
            return b"", "", b""
        before = text[begin - entry[1]:begin] if entry[1] else ""
        stop = end - exit_[1]
        near = next((c for c in range(begin + 1, stop) if text[c - 1:c + 1] not in self.joined), stop)
        head = self.to_ids(self.trace(text, self.forward(text, begin, before, near), begin, near)) if begin < near else b""
        far, tail = near, b""
        if near < stop:
            far = next((c for c in range(stop, near, -1) if text[c - 1:c + 1] not in self.joined), near)
            tail = self.to_ids(self.trace(text, self.forward(text, far, "", stop), far, stop))
        return head, text[near:far], tail + self.to_ids([text[stop:end]])

    def between(self, text: str, a: int, b: int, entry: State, exit_: State) -> bytes:
        """Ids of the pieces that start in text[a:b] on the path between two states."""
        head, inner, tail = self.middle(text, a, b, entry, exit_)
        return head + self.encode(inner) + tail

    def decode_all(self, found: list[bytes]) -> list[bytes]:
        """UTF-8 of the texts, the mark put first still there."""
        ids = np.frombuffer(b"".join(found), "<u4")
        if not len(ids):
            return [b""] * len(found)
        return _dealt(self.texts_of.take(pa.array(ids)), np.append(0, np.cumsum([len(x) // 4 for x in found])))

    def decode(self, ids: bytes, first: bool = True) -> bytes:
        """UTF-8 of the text; the mark put first is taken off again."""
        (data,) = self.decode_all([ids])
        return data[1:] if first and data[:1] == b" " else data


def _dealt(values: pa.Array, bounds: np.ndarray) -> list[bytes]:
    """The bytes of each run of values between two bounds."""
    places = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1)[bounds].tolist()
    view = memoryview(values.buffers()[2] or b"")
    return [bytes(view[a:b]) for a, b in zip(places, places[1:])]


def pieces(path: str) -> Pieces:
    common.forget(but=__name__)
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def _forget() -> bool:
    held = bool(_MODELS)
    _MODELS.clear()
    return held


common.remembers(__name__, _forget)


def normalised(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def combine(first: Matrix, second: Matrix) -> Matrix:
    """Max-plus product over weights 0 and minus infinity (absent)."""
    out = {}
    for entry, mids in first.items():
        ways = {x for m in mids for x in second.get(m, ())}
        if ways:
            out[entry] = sorted(ways)
    return out


def best_path(matrices: list[Matrix], entry: State, exit_: State) -> list[State]:
    """The states at all borders of consecutive chunks, between a given entry and exit."""
    reach = [{entry}]
    for m in matrices:
        reach.append({x for e in reach[-1] for x in m.get(e, ())})
    states = [exit_]
    for m, before in zip(reversed(matrices), reversed(reach[:-1])):
        states.append(min(e for e in before if states[-1] in m.get(e, ())))
    return states[::-1]


def _dump(m: Matrix) -> str:
    return json.dumps([[e, x] for e, x in m.items()])


def _load(s: str) -> Matrix:
    return {tuple(e): [tuple(y) for y in x] for e, x in json.loads(s)}


def solve(matrices: DataFrame) -> DataFrame:
    """(key, k, e0, e1, x0, x1): the states at both borders of every chunk, from (key, k, matrix)."""
    def up(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total: Matrix | None = None
        for m in group.sort_values("k")["matrix"]:
            total = _load(m) if total is None else combine(total, _load(m))
        return pd.DataFrame({"key": [key[0]], "k": [key[1]], "matrix": [_dump(total)]})

    def down(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        ms = [_load(m) for m in group["matrix"]]
        if "e0" in group.columns:
            entry, exit_ = (int(group["e0"].iloc[0]), int(group["e1"].iloc[0])), (int(group["x0"].iloc[0]), int(group["x1"].iloc[0]))
        else:
            entry = START
            whole = ms[0]
            for m in ms[1:]:
                whole = combine(whole, m)
            (exit_,) = whole[START]                # one way through a whole text
        states = best_path(ms, entry, exit_)
        return pd.DataFrame({"key": group["key"], "k": group["k"],
                             "e0": [s[0] for s in states[:-1]], "e1": [s[1] for s in states[:-1]],
                             "x0": [s[0] for s in states[1:]], "x1": [s[1] for s in states[1:]]})

    schema = "key string, k long, e0 long, e1 long, x0 long, x1 long"
    many = common.shuffle_partitions(matrices.sparkSession)      # a few bytes a chunk, but work: not to be coalesced
    most = matrices.agg(F.max("k")).first()[0] or 0
    if most < FAN_IN:
        return matrices.repartition(many, "key").groupBy("key").applyInPandas(down, schema)
    block = F.expr(f"k div {FAN_IN}")
    above = materialize(matrices.groupBy("key", block.alias("block")).applyInPandas(up, "key string, k long, matrix string"), "blocks")
    states = solve(above).withColumnRenamed("k", "block")
    return (matrices.withColumn("block", block).join(states, ["key", "block"])
            .groupBy("key", "block").applyInPandas(down, schema))


def chunks(texts: DataFrame, model: str, size: int) -> DataFrame:
    """(key, k, slice, a, first): chunks of the normalised (key, text), spread over the cluster."""
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        margin = pieces(model).longest
        for batch in batches:
            for key, text in zip(batch["key"], batch["text"]):
                s = normalised(text)
                rows = [(key, k, s[max(0, a - margin):a + size + margin], min(a, margin), min(size, len(s) - a))
                        for k, a in enumerate(range(0, len(s), size))]
                for i in range(0, len(rows), 256):
                    yield pd.DataFrame(rows[i:i + 256], columns=["key", "k", "slice", "a", "n"])

    rows = texts.select("key", "text").mapInPandas(split, "key string, k long, slice string, a long, n long")
    return rows.repartition(common.shuffle_partitions(texts.sparkSession), "key", "k")


def _times(rows: list[int], x: int) -> int:
    out, i = 0, 0
    while x:
        if x & 1:
            out ^= rows[i]
        x >>= 1
        i += 1
    return out


@lru_cache(maxsize=None)
def _zero_bytes(power: int) -> list[int]:
    """The bit matrix that moves a crc32 past 2 ** power zero bytes."""
    if power:
        step = _zero_bytes(power - 1)
        return [_times(step, r) for r in step]
    step = [0xEDB88320] + [1 << i for i in range(31)]             # one zero bit
    for _ in range(3):
        step = [_times(step, r) for r in step]
    return step


def crc_shift(crc: int, n_bytes: int) -> int:
    """The crc32 of data, moved ahead of ``n_bytes`` further bytes: crc(A+B) = shift(crc(A), len B) ^ crc(B)."""
    power = 0
    while n_bytes:
        if n_bytes & 1:
            crc = _times(_zero_bytes(power), crc)
        power += 1
        n_bytes >>= 1
    return crc


CODED = "n_pieces long, ids_crc32 long, ids_bytes long, decoded_crc32 long, decoded_bytes long, ids binary"


def _coded(found: list[tuple[bytes, bytes]], keep_ids: bool) -> dict:
    return {"n_pieces": [len(i) // 4 for i, _ in found], "ids_crc32": [common.crc32(i) for i, _ in found],
            "ids_bytes": [len(i) for i, _ in found], "decoded_crc32": [common.crc32(d) for _, d in found],
            "decoded_bytes": [len(d) for _, d in found], "ids": [i if keep_ids else None for i, _ in found]}


def encode_chunks(texts: DataFrame, model: str, size: int = CHUNK, keep_ids: bool = True) -> DataFrame:
    """Every chunk of every giant text of (key, text), encoded and decoded on its own: key, k and CODED."""
    def transfer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(model)
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "k": b["k"],
                                "matrix": [_dump(p.matrix(s, a, a + n, k == 0))
                                           for s, a, n, k in zip(b["slice"], b["a"], b["n"], b["k"])]})

    def backtrace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(model)
        for b in batches:
            found, rows = [], list(b.itertuples(index=False))
            for i in range(0, len(rows), 64):
                block = rows[i:i + 64]
                parts = [p.middle(r.slice, r.a, r.a + r.n, (r.e0, r.e1), (r.x0, r.x1)) for r in block]
                ids = [head + inner + tail for (head, _, tail), inner in zip(parts, p.encode_all([x for _, x, _ in parts]))]
                found += [(x, d[1:] if r.k == 0 and d[:1] == b" " else d) for r, x, d in zip(block, ids, p.decode_all(ids))]
            yield pd.DataFrame({"key": b["key"], "k": b["k"], **_coded(found, keep_ids)})

    cut = materialize(chunks(texts, model, size), "chunks")
    matrices = materialize(cut.mapInPandas(transfer, "key string, k long, matrix string"), "matrices")
    return cut.join(solve(matrices), ["key", "k"]).mapInPandas(backtrace, "key string, k long, " + CODED)


def encode(docs: DataFrame, model: str, size: int = CHUNK) -> DataFrame:
    """One row per (doc_id, text): pieces, crc32 of the ids and of the text decoded from them, chunks."""
    docs = common.id_and_text(docs)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(model)
        for b in batches:
            keys, texts = b["doc_id"].astype("Int64"), b["text"].tolist()
            for first, last in in_blocks(texts, BLOCK):
                ids = p.encode_all(list(map(normalised, texts[first:last])))
                found = [(x, d[1:] if d[:1] == b" " else d) for x, d in zip(ids, p.decode_all(ids))]
                yield pd.DataFrame({"doc_id": keys.iloc[first:last].to_numpy(object, na_value=None),
                                    "n_chunks": [1 if t else 0 for t in texts[first:last]],
                                    **_coded(found, False)}).drop(columns=["ids_bytes", "decoded_bytes", "ids"])

    @F.pandas_udf("long")
    def shifted(crc: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([crc_shift(int(c), int(k)) for c, k in zip(crc, n)])

    result = "doc_id long, n_chunks long, n_pieces long, ids_crc32 long, decoded_crc32 long"
    long_ = F.length("text") >= size
    small = docs.filter(~long_).mapInPandas(whole, result)
    giants = docs.filter(long_).withColumn("key", F.sha2("text", 256))
    parts = encode_chunks(giants.groupBy("key").agg(F.min("text").alias("text")), model, size, keep_ids=False)
    after = Window.partitionBy("key").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumns({f"after_{c}": F.coalesce(F.sum(f"{c}_bytes").over(after), F.lit(0)) for c in ("ids", "decoded")})
    whole_text = (placed.withColumns({f"{c}_crc32": shifted(f"{c}_crc32", f"after_{c}") for c in ("ids", "decoded")})
                  .groupBy("key").agg(F.count("*").alias("n_chunks"), F.sum("n_pieces").alias("n_pieces"),
                                      F.expr("bit_xor(ids_crc32)").alias("ids_crc32"),
                                      F.expr("bit_xor(decoded_crc32)").alias("decoded_crc32")))
    joined = giants.select("doc_id", "key").join(whole_text, "key").drop("key")
    return small.unionByName(joined)


def op9_piece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` encoded and decoded again; one row per document."""
    docs = common.id_and_text(common.table(spark, sf_dir, "documents"))
    return encode(docs, common.tokenizer_path("piece_bpe_32k.model"))
