"""Whole-text encoding with the ``tokenizers`` library, memoised between spaces.

Encoding every occurrence of a word anew dominates a corpus job. A block of texts is cut into units
(numpy over its UTF-8 bytes), Arrow counts each distinct unit once, only those the worker has not kept go
through the library, and Arrow deals their ids back to the places.

The cut is exact where no pre-token reaches across it. Stretches between spaces come first:

* ``leading`` (byte-level pattern: a space belongs to the word behind it): a space with a
  non-blank character on both sides always begins a new pre-token. A text that has any
  other space (beside another blank, or at an end) is encoded whole instead.
* otherwise (the pattern drops white space): every U+0020 separates.

A text that holds the string of an added token (as ``<|endoftext|>``) is encoded whole, too: the
library cuts it out before any pre-token and gives it its own id.

A stretch of Latin letters, ASCII digits, marks (no apostrophe) and line ends is cut further into
its pre-tokens -- both patterns end one where the class changes; of a run of line ends the byte-level one
takes the last apart unless the text ends there -- and the library's model encodes each once, the
space before it included. Any other stretch is one unit, encoded by the library, many to a call.

The memo holds two generations of about ``MEMO_ENTRIES`` units of at most
``MEMO_BYTES`` bytes; longer ones are encoded and forgotten. It changes speed only.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from riskflow.llm import common

MEMO_ENTRIES = 300_000
MEMO_BYTES = 48

_SPACE, _LETTER, _DIGIT, _MARK, _LINE, _OTHER = range(6)
_KINDS = bytes(_SPACE if c == " " else _LINE if c == "\n" else _OTHER if not c.isascii() or c == "'" or not c.isprintable()
               else _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _MARK for c in map(chr, range(256)))
_PLAIN = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[!-&(-/:-@\[-`{-~]+|[0-9]+|\n+)?")
# what stands for a byte in a byte-level vocabulary: itself if it is a visible Latin-1 character, else the next free one from 256
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
_AS_BYTES = {c: "".join(_BYTES[b] for b in chr(c).encode()) for c in (10, 32, *range(0xC0, 0x100))}
_UNCUT = b"?"                                      # instead of ids: the text around this unit must be encoded whole
_ENCODERS: dict[tuple[str, bool], "Encoder"] = {}


class Encoder:
    """``special_as_text``: strings of special tokens in a text are ordinary text, as by the library's
    switch of that meaning. ``encoder``, and so every operator, leaves the library's default."""

    def __init__(self, path: str, leading: bool, special_as_text: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        self.leading = leading
        starts = np.zeros(self.tok.get_vocab_size(), bool)
        if leading:                                # ids that begin with the mark of a space
            starts[[i for t, i in self.tok.get_vocab().items() if t.startswith(_BYTES[32])]] = True
        self.starts = starts
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes()
                for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _pre_token(self, unit: bytes) -> bytes:
        """Ids of one pre-token and the space before it; none where the pattern drops it."""
        text = unit.decode()
        if not self.leading:
            text = text.lstrip(" \n").lower()
            if not text:
                return b""
        found = [t.id for t in self.tok.model.tokenize(text.translate(_AS_BYTES))]
        return struct.pack(f"<{len(found)}I", *found)

    def _stretches(self, units: list[bytes]) -> list[bytes]:
        """Ids of stretches that are not cut further, each with the space before it if it has one."""
        out = [_UNCUT] * len(units)
        texts = [u.decode() for u in units]
        if self.leading:
            cuttable = [i for i, t in enumerate(texts) if not (t[-1].isspace() or t[0] == " " and t[1].isspace())]
            heads = [i for i in cuttable if texts[i][0] != " "]
            for i, ids in zip(heads, self._whole([texts[i] for i in heads])):
                out[i] = ids
            rest = [i for i in cuttable if texts[i][0] == " "]
        else:
            rest = range(len(units))
        for k in range(0, len(rest), 1000):
            part = rest[k:k + 1000]
            if self.leading:                       # every stretch begins with its space's mark
                (e,) = self.tok.encode_batch_fast(["".join(texts[i] for i in part)], add_special_tokens=False)
                ids = np.asarray(e.ids, dtype="<u4")
                bounds = np.append(np.flatnonzero(self.starts[ids]), len(ids))
            else:
                e = self.tok.encode([texts[i].removeprefix(" ") for i in part], is_pretokenized=True, add_special_tokens=False)
                ids = np.asarray(e.ids, dtype="<u4")
                bounds = np.searchsorted(np.asarray(e.word_ids, dtype=np.int64), np.arange(len(part) + 1))
            data, bounds = ids.tobytes(), (bounds * 4).tolist()
            assert len(bounds) == len(part) + 1
            for i, a, b in zip(part, bounds, bounds[1:]):
                out[i] = data[a:b]
        return out

    def _ids(self, units: list[bytes]) -> list[bytes]:
        """Ids of distinct units, from the memo or new."""
        young, old = self.young, self.old
        out = list(map(young.get, units))
        mixed = []
        for i, ids in enumerate(out):
            if ids is None:
                unit = units[i]
                ids = old.get(unit)
                if ids is None:
                    if not _PLAIN.fullmatch(unit):
                        mixed.append(i)
                        continue
                    ids = self._pre_token(unit)
                out[i] = ids
                if len(unit) <= MEMO_BYTES:
                    young[unit] = ids
        for i, ids in zip(mixed, self._stretches([units[i] for i in mixed])):
            out[i] = ids
            if len(units[i]) <= MEMO_BYTES:
                young[units[i]] = ids
        if len(young) > MEMO_ENTRIES:
            self.old, self.young = young, {}
        return out

    def _units(self, kind: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where units begin, of texts that need not be encoded whole."""
        space, line = kind == _SPACE, kind == _LINE
        begin = np.empty(len(kind), bool)
        begin[0] = True
        np.not_equal(kind[1:], kind[:-1], out=begin[1:])
        if self.leading:
            begin[:-1] |= line[:-1] & ~line[1:]    # of a run of line ends the last is apart, but not at a text's end
            ends = bounds[1:][np.diff(bounds) > 0] - 1
            ends = ends[line[ends]]
            begin[ends] = ~line[ends - 1]
        else:
            begin |= kind == _DIGIT
        begin[1:] &= ~space[:-1]
        begin |= space
        heads = bounds[:-1][np.diff(bounds) > 0]
        begin[heads] = True
        others = np.flatnonzero(kind == _OTHER)
        if len(others):                            # their stretches are not cut
            space[heads] = True
            stretches = np.flatnonzero(space)
            cut = np.ones(len(stretches), bool)
            cut[np.searchsorted(stretches, others, side="right") - 1] = False
            begin &= np.repeat(cut, np.diff(stretches, append=len(kind)))
            begin[stretches] = True
        return np.flatnonzero(begin)

    def _to_be_whole(self, column: pa.Array, kind: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which texts hold an added token, or a space whose pre-token the cut would not find."""
        out = np.zeros(len(column), bool)
        for token in self.added:
            out |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        if self.leading:
            space = kind == _SPACE
            blank = space | (kind == _LINE)
            beside = np.flatnonzero(space[:-1] & blank[1:] | blank[:-1] & space[1:])
            out[np.searchsorted(bounds, beside, side="right") - 1] = True
            some = np.flatnonzero(np.diff(bounds))
            out[some] |= space[bounds[some]] | space[bounds[some + 1] - 1]
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        column = pa.array(texts, pa.large_string())
        bounds = np.frombuffer(column.buffers()[1], np.int64, len(texts) + 1) if len(texts) else np.zeros(1, np.int64)
        if not bounds[-1]:
            return [b""] * len(texts)
        data = np.frombuffer(column.buffers()[2], np.uint8, bounds[-1])
        kind = np.frombuffer(bytearray(data).translate(_KINDS), np.uint8)
        two = np.flatnonzero(data == 0xC3)
        two = two[(data[two + 1] != 0x97) & (data[two + 1] != 0xB7)]
        kind[two] = kind[two + 1] = _LETTER
        whole = self._to_be_whole(column, kind, bounds)
        if whole.any():
            sizes = np.diff(bounds)
            kept = np.repeat(~whole, sizes)
            data, kind = data[kept], kind[kept]
            bounds = np.append(0, np.cumsum(np.where(whole, 0, sizes)))
        out = [b""] * len(texts)
        if len(data):
            begins = self._units(kind, bounds)
            found = pa.Array.from_buffers(pa.large_binary(), len(begins), [
                None, pa.py_buffer(np.append(begins, len(data))), pa.py_buffer(data)]).dictionary_encode()
            known = self._ids(found.dictionary.to_numpy(zero_copy_only=False).tolist())
            uncut = [i for i, ids in enumerate(known) if ids is _UNCUT]
            if uncut:
                at = begins[np.isin(found.indices.to_numpy(), uncut)]
                whole[np.searchsorted(bounds, at, side="right") - 1] = True
            ids = pa.array(known, pa.large_binary()).take(found.indices)
            places = np.frombuffer(ids.buffers()[1], np.int64, len(begins) + 1)[np.searchsorted(begins, bounds)].tolist()
            view = memoryview(ids.buffers()[2] or b"")
            out = [bytes(view[a:b]) for a, b in zip(places, places[1:])]
        again = np.flatnonzero(whole).tolist()
        for i, ids in zip(again, self._whole([texts[i] for i in again])):
            out[i] = ids
        return out


def encoder(path: str, leading: bool) -> Encoder:
    """One encoder for each worker process."""
    common.forget(but=__name__)
    key = (path, leading)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, leading, special_as_text=False)
    return _ENCODERS[key]


def _forget() -> bool:
    held = bool(_ENCODERS)
    _ENCODERS.clear()
    return held


common.remembers(__name__, _forget)


def in_blocks(texts, max_chars: int = 2_000_000):
    """(first, last) ranges of texts of about ``max_chars`` characters, to bound memory."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > max_chars:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
