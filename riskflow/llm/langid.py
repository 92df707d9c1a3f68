"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of ``WINDOW``; in each window one recurrent
network reads forwards and one backwards, and every byte position gets a probability for
each language from both states. A document's probabilities are the mean over all its
positions: the whole text is read, in batches of windows, so memory does not grow with it.

The unit has a reset and an update gate; gates are piecewise linear sigmoids, the candidate
is clipped to [-1, 1]. It is trained in numpy by back-propagation through time, on the
loss of every position, with Adam.

Training is bounded: at most ``SAMPLE`` documents of each language (the first in a hash
order) and ``WINDOWS_PER_TEXT`` windows of each, cut where the texts are, at seeded places; the
fit is one task's work, and the driver gets the network alone. Prediction is one pass, no shuffle.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is
every text if there is nothing to learn from; equal texts get equal results and an empty table no rows; ties go to the first language in order;
rows without a language, or over ``TRAIN_CHARS`` characters, are not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskflow.llm import common

WINDOW = 64
BATCH = 2048
HIDDEN = 12
SAMPLE = 400
WINDOWS_PER_TEXT = 6
TRAIN_CHARS = 200_000
EPOCHS = 6
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Network:
    """Weights of both directions (forward, backward) and of the output layer."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        self.weights = {}
        for d in "fb":
            self.weights |= {f"x{d}": rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32),
                             f"u{d}": rng.normal(0, 0.3, (2 * hidden, hidden)).astype(np.float32),
                             f"c{d}": rng.normal(0, 0.3, (hidden, hidden)).astype(np.float32)}
            self.weights[f"x{d}"][hidden:2 * hidden] += 1.0        # keep more of the state at first
        self.weights["out"] = rng.normal(0, 0.3, (len(languages), 2 * hidden)).astype(np.float32)
        self.weights["bias"] = np.zeros((len(languages), 1), np.float32)

    def _direction(self, d: str, ids: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """States [T, H, B] of one direction over bytes ids [T, B]; zero where ``mask`` is 0, so that
        the backward network starts at a window's last byte, not in its padding."""
        x, u, c, n = (*(self.weights[k + d] for k in "xuc"), self.hidden)
        steps = range(len(ids)) if d == "f" else range(len(ids) - 1, -1, -1)
        states = np.empty((len(ids), n, ids.shape[1]), np.float32)
        h = np.zeros((n, ids.shape[1]), np.float32)
        for t in steps:
            here = np.take(x, ids[t], axis=1)
            gates = u @ h
            gates += here[:2 * n]
            gates *= 0.25
            gates += 0.5
            np.clip(gates, 0, 1, out=gates)
            gated = gates[:n] * h
            cand = c @ gated
            cand += here[2 * n:]
            np.clip(cand, -1, 1, out=cand)
            new = states[t]
            np.subtract(h, cand, out=new)
            new *= gates[n:]
            new += cand
            if mask is not None:
                new *= mask[t]
            if keep is not None:
                keep.append((t, h, gates, gated, cand))
            h = new
        return states

    def positions(self, ids: np.ndarray, mask: np.ndarray | None = None, keep: dict | None = None) -> np.ndarray:
        """Probabilities [languages, T, B] of every position of the windows ids [T, B] (``mask``: 0 at padding)."""
        traces = {d: [] if keep is not None else None for d in "fb"}
        states = [self._direction(d, ids, mask, traces[d]) for d in "fb"]
        n, out = self.hidden, self.weights["out"]
        logits = np.matmul(out[:, :n], states[0])
        logits += np.matmul(out[:, n:], states[1])
        logits += self.weights["bias"]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        if keep is not None:
            keep |= {"states": states, "traces": traces}
        return logits.transpose(1, 0, 2)

    def gradients(self, ids: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss per valid position and its gradients, by back-propagation through time."""
        keep: dict = {}
        p = self.positions(ids, mask, keep).transpose(1, 0, 2).copy()        # [T, L, B]
        total = max(1.0, float(mask.sum()))
        b = np.arange(ids.shape[1])
        loss = -float((np.log(p[:, label, b] + 1e-9) * mask).sum()) / total
        p[:, label, b] -= 1
        p *= mask[:, None, :] / total
        n, out = self.hidden, self.weights["out"]
        grads = {"bias": p.sum(axis=(0, 2))[:, None],
                 "out": np.concatenate([np.einsum("tlb,thb->lh", p, s, optimize=True) for s in keep["states"]], axis=1)}
        flat = ids.astype(np.int64)
        for k, d in enumerate("fb"):
            u, c = self.weights["u" + d], self.weights["c" + d]
            above = np.matmul(out[:, k * n:(k + 1) * n].T, p)          # [T, H, B]
            gu, gc = np.zeros_like(u), np.zeros_like(c)
            gx = np.empty((len(ids), 3 * n, ids.shape[1]), np.float32)
            dh = np.zeros_like(above[0])
            for t, h, gates, gated, cand in reversed(keep["traces"][d]):
                dh = (dh + above[t]) * mask[t]
                r, z = gates[:n], gates[n:]
                dcand = dh * (1 - z) * (np.abs(cand) < 1)
                dgated = c.T @ dcand
                dgates = np.concatenate([dgated * h, dh * (h - cand)])
                dgates *= 0.25 * ((gates > 0) & (gates < 1))
                gx[t, :2 * n], gx[t, 2 * n:] = dgates, dcand
                gu += dgates @ h.T
                gc += dcand @ gated.T
                dh = dh * z + dgated * r + u.T @ dgates
            gx = gx.transpose(1, 0, 2).reshape(3 * n, -1)
            grads |= {"u" + d: gu, "c" + d: gc,
                      "x" + d: np.stack([np.bincount(flat.ravel(), row, minlength=256) for row in gx])}
        return loss, grads

    def fit(self, ids: np.ndarray, mask: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, batch: int = 256,
            rate: float = 0.01, seed: int = 11) -> list[float]:
        """Train on windows ids [T, N] with masks and labels; returns the loss by epoch."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(w) for k, w in self.weights.items()}
        second = {k: np.zeros_like(w) for k, w in self.weights.items()}
        step, losses = 0, []
        for epoch in range(epochs):
            order, sums = rng.permutation(ids.shape[1]), []
            for a in range(0, len(order), batch):
                pick = order[a:a + batch]
                loss, grads = self.gradients(ids[:, pick], mask[:, pick], label[pick])
                sums.append(loss)
                step += 1
                scale = min(1.0, 1.0 / (1e-9 + np.sqrt(sum(float((g ** 2).sum()) for g in grads.values()))))
                now = rate * (1 - 0.8 * epoch / max(1, epochs))
                for k, g in grads.items():
                    g = (g * scale).astype(np.float32)
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    self.weights[k] -= now * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-6)
            losses.append(float(np.mean(sums)))
        return losses

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all byte positions, [documents, languages]."""
        sums = np.zeros((len(texts), len(self.languages)))
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        n_windows = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(texts)), n_windows)
        padded = b"".join(t + b"\0" * (-len(t) % WINDOW) for t in texts)
        windows = np.frombuffer(padded, np.uint8).reshape(-1, WINDOW)
        valid = np.full(len(windows), WINDOW)
        ends = np.cumsum(n_windows)[n_windows > 0] - 1
        valid[ends] = (sizes[n_windows > 0] - 1) % WINDOW + 1
        for a in range(0, len(windows), BATCH):
            ids = np.ascontiguousarray(windows[a:a + BATCH].T)
            here = valid[a:a + BATCH]
            mask = (np.arange(WINDOW)[:, None] < here).astype(np.float32) if (here < WINDOW).any() else None
            p = self.positions(ids, mask)
            if mask is not None:
                p = p * mask
            np.add.at(sums, owner[a:a + BATCH], p.sum(axis=1).T)
        return sums / np.maximum(sizes, 1)[:, None]

    def predict(self, texts: list[str | None], max_bytes: int = 8_000_000) -> list[tuple[str, float]]:
        """(language, probability) of each whole text."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.languages:
            return out
        held, size = [], 0
        for i, t in enumerate(texts):
            if has_letter(t):
                data = t.encode("utf-8", "replace")
                held.append((i, data))
                size += len(data)
            if held and (size >= max_bytes or i == len(texts) - 1):
                for (k, _), p in zip(held, self.pooled([d for _, d in held])):
                    best = int(p.argmax())
                    out[k] = (self.languages[best], float(min(1.0, max(0.0, p[best]))))
                held, size = [], 0
        if held:
            for (k, _), p in zip(held, self.pooled([d for _, d in held])):
                best = int(p.argmax())
                out[k] = (self.languages[best], float(min(1.0, max(0.0, p[best]))))
        return out

    def label_positions(self, text: str) -> list[str]:
        """The likeliest language at each byte of a text."""
        data = text.encode("utf-8", "replace")
        out: list[str] = []
        for a in range(0, len(data), WINDOW):
            ids = np.frombuffer(data[a:a + WINDOW], np.uint8)[:, None]
            out += [self.languages[k] for k in self.positions(ids)[:, :, 0].argmax(axis=0)]
        return out


def train(docs: DataFrame, sample: int = SAMPLE, hidden: int = HIDDEN) -> Network:
    """Fit on a bounded sample of (doc_id, text, lang) rows whose lang and text are not null."""
    usable = (docs.filter("lang is not null and text is not null and doc_id is not null")
              .select("doc_id", "text", "lang").filter(F.length("text").between(1, TRAIN_CHARS)))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return Network([])
    # A hash-chosen share of each language that holds about twice the sample, cut on arrival.
    languages = sorted(counts)
    grain = 1 << 20
    share = F.create_map(*[F.lit(x) for k in languages
                           for x in (k, max(1, min(grain, 2 * sample * grain // counts[k])))])
    spot = F.xxhash64("doc_id", "text")
    picked = usable.filter(F.pmod(spot, F.lit(grain)) < share[F.col("lang")]).withColumn("spot", spot)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.forget()
        for batch in batches:
            yield pd.DataFrame([(lang, at, *_windows(text, at)) for text, lang, at in zip(batch["text"], batch["lang"], batch["spot"])],
                               columns=["lang", "spot", "windows", "valid"])

    def fit_windows(rows: pd.DataFrame) -> Network:
        rows = rows.sort_values(["lang", "spot", "windows"]).groupby("lang").head(sample)
        ids = np.frombuffer(b"".join(rows["windows"]), np.uint8).reshape(-1, WINDOW).T
        valid = np.frombuffer(b"".join(rows["valid"]), np.uint8)
        label = np.repeat([languages.index(x) for x in rows["lang"]], [len(v) for v in rows["valid"]])
        network = Network(languages, hidden)
        network.fit(np.ascontiguousarray(ids), (np.arange(WINDOW)[:, None] < valid).astype(np.float32), label)
        return network

    return common.fitted(picked.mapInPandas(cut, "lang string, spot long, windows binary, valid binary"), fit_windows)


def _windows(text: str, seed: int) -> tuple[bytes, bytes]:
    """``WINDOWS_PER_TEXT`` padded windows of a text at places drawn from the seed, and their sizes."""
    data = text.encode("utf-8", "replace")
    places = np.random.default_rng(seed & 0xFFFFFFFF).integers(0, max(1, len(data) - WINDOW + 1), WINDOWS_PER_TEXT)
    parts = [data[a:a + WINDOW] for a in places]
    return b"".join(p.ljust(WINDOW, b"\0") for p in parts), bytes(len(p) for p in parts)


def predict_column(network: Network):
    """A column function: whole text -> struct(lang_pred, score)."""
    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        common.forget()
        for texts in batches:
            found = network.predict([None if t is None else t for t in texts])
            common.give_back()
            yield pd.DataFrame(found, columns=["lang_pred", "score"])
    return predicted


def learnable(docs: DataFrame) -> DataFrame:
    """The documents that the contract lets a model learn from."""
    return docs.filter(common.crc_mod(F.col("doc_id"), 3) != 1).select("doc_id", "text", "lang")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``; one row per document with its language."""
    docs = common.table(spark, sf_dir, "documents")
    network = train(learnable(docs))
    return (docs.select("doc_id", predict_column(network)("text").alias("p"))
            .select("doc_id", (common.crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "p.lang_pred", "p.score"))
