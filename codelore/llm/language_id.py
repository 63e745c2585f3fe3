"""Language identification by a bidirectional gated recurrent network over bytes (operator 8).

The network reads a text's UTF-8 bytes in both directions, gives every byte position a probability
for each language, and a document's probabilities are the mean over all its positions.  It is
trained here, in numpy, by backpropagation through time on windows of labelled documents.

A text is read in windows that overlap: a position is labelled from states that have read at
least ``CONTEXT`` bytes of the text on either side of its window (or the text's end), so a window's
border is no border for the network.  Windows are run side by side, and memory does not grow with a
text.  Gates are clipped lines instead of sigmoids: the same gradients by backpropagation, at a
fraction of the cost of an exponential for each gate, unit and byte.

Training takes at most ``MAX_PER_LANGUAGE`` documents of each language (those of the smallest
hashes) of at most ``MAX_LANGUAGES`` languages (the most frequent; ties by name), and
``WINDOWS_PER_DOCUMENT`` windows of each; prediction reads every byte of every text.

Defined results: a text that is null or has no letter (Unicode category L) is ``und`` with score 0;
without labelled documents every text is; documents whose crc32 of the id mod 5 is 0 (a null id
counts as the text ``null``) are held out of training; repeated rows get equal results; ties go to
the language that sorts first; very long texts are read whole, a bounded piece at a time; an empty
table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from codelore.llm.common import batch, fresh, in_batches, table

FOLDS = 5
MAX_PER_LANGUAGE, MAX_LANGUAGES, WINDOWS_PER_DOCUMENT = 400, 256, 8
#: Bytes that a window labels, bytes that it reads before and after them, hidden units in a
#: direction, windows run side by side.
SPAN, CONTEXT, HIDDEN, SIDE_BY_SIDE = 96, 16, 8, 2048
STEPS, TRAIN_BATCH, RATE = 300, 96, 0.02
UNKNOWN = "und"
#: Letters, and marks, number forms and superscripts that ``\\w`` takes in besides.
_WORDLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character of the text is of Unicode category L."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


class Network:
    """Weights of both directions: input table, recurrent weights, and the output layer."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        self.table = rng.normal(0, 0.3, (2, 3 * hidden, 256)).astype(np.float32)
        self.recurrent = rng.normal(0, 0.3, (2, 3 * hidden, hidden)).astype(np.float32)
        self.out = rng.normal(0, 0.3, (2, len(languages), hidden)).astype(np.float32)
        self.bias = np.zeros((len(languages), 1), dtype=np.float32)

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.table, self.recurrent, self.out, self.bias]

    def _step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """Gates, candidate and next state for inputs x (2, 3H, B) and states h (2, H, B)."""
        n = self.hidden
        g = self.recurrent @ h
        gates = np.clip(0.25 * (x[:, : 2 * n] + g[:, : 2 * n]) + 0.5, 0, 1)
        keep, reset = gates[:, :n], gates[:, n:]
        candidate = np.clip(x[:, 2 * n :] + reset * g[:, 2 * n :], -1, 1)
        return keep, reset, g[:, 2 * n :], candidate, candidate + keep * (h - candidate)

    def states(self, windows: np.ndarray) -> np.ndarray:
        """States (T, 2, H, B) of windows (B, T); the second direction is in text order too."""
        b, t = windows.shape
        n = self.hidden
        # Scale and shift of the gates are folded into the weights.
        scale = np.repeat(np.array([0.25, 1.0], np.float32), [2 * n, n])[None, :, None]
        shift = np.repeat(np.array([0.5, 0.0], np.float32), [2 * n, n])[None, :, None]
        inputs, recurrent = self.table * scale + shift, self.recurrent * scale
        ahead, back = np.ascontiguousarray(windows.T), np.ascontiguousarray(windows.T[::-1])
        out = np.empty((t, 2, n, b), dtype=np.float32)
        h = np.zeros((2, n, b), dtype=np.float32)
        x, g, c = np.empty((2, 3 * n, b), np.float32), np.empty((2, 3 * n, b), np.float32), np.empty((2, n, b), np.float32)
        for i in range(t):
            np.take(inputs[0], ahead[i], axis=1, out=x[0], mode="clip")
            np.take(inputs[1], back[i], axis=1, out=x[1], mode="clip")
            np.matmul(recurrent, h, out=g)
            gates = x[:, : 2 * n]
            gates += g[:, : 2 * n]
            np.clip(gates, 0, 1, out=gates)
            np.multiply(gates[:, n:], g[:, 2 * n :], out=c)
            c += x[:, 2 * n :]
            np.clip(c, -1, 1, out=c)
            h = h - c
            h *= gates[:, :n]
            h += c
            out[i, 0], out[t - 1 - i, 1] = h[0], h[1]
        return out

    def position_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(T, L, B): the probability of each language at every byte of every window."""
        h = self.states(windows)
        logits = self.out[0] @ h[:, 0]
        logits += self.out[1] @ h[:, 1]
        logits += self.bias
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over positions and its gradients, by backpropagation through time."""
        b, t = windows.shape
        n = self.hidden
        order = np.stack([windows.T, windows.T[::-1]])
        h = np.zeros((2, n, b), dtype=np.float32)
        tape, states = [], np.empty((t, 2, n, b), dtype=np.float32)
        for i in range(t):
            x = np.stack([self.table[0][:, order[0, i]], self.table[1][:, order[1, i]]])
            keep, reset, inner, candidate, new = self._step(x, h)
            tape.append((h, keep, reset, inner, candidate))
            states[i] = h = new
        logits = self.out[0] @ states[:, 0] + (self.out[1] @ states[:, 1])[::-1] + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        loss = -float(np.log(p[:, labels, np.arange(b)] + 1e-9).mean())
        p[:, labels, np.arange(b)] -= 1
        d = p / (b * t)
        d_out = np.stack([np.einsum("tlb,thb->lh", d, states[:, 0]), np.einsum("tlb,thb->lh", d[::-1], states[:, 1])])
        d_bias = d.sum(axis=(0, 2))[:, None]
        from_above = np.stack([self.out[0].T @ d, (self.out[1].T @ d)[::-1]], axis=1)
        d_table, d_recurrent = np.zeros_like(self.table), np.zeros_like(self.recurrent)
        dh = np.zeros((2, n, b), dtype=np.float32)
        for i in range(t - 1, -1, -1):
            before, keep, reset, inner, candidate = tape[i]
            dh = dh + from_above[i]
            d_candidate = dh * (1 - keep) * (np.abs(candidate) < 1)
            d_keep = dh * (before - candidate) * ((keep > 0) & (keep < 1)) * 0.25
            d_reset = d_candidate * inner * ((reset > 0) & (reset < 1)) * 0.25
            dx = np.concatenate([d_keep, d_reset, d_candidate], axis=1)
            dg = np.concatenate([d_keep, d_reset, d_candidate * reset], axis=1)
            d_recurrent += dg @ before.transpose(0, 2, 1)
            for k in (0, 1):
                np.add.at(d_table[k].T, order[k, i], dx[k].T)
            dh = dh * keep + self.recurrent.transpose(0, 2, 1) @ dg
        return loss, [d_table, d_recurrent, d_out, d_bias]


def windows_of(data: bytes, before: bytes = b"", after: bytes = b"", span: int = SPAN, context: int = CONTEXT) -> np.ndarray:
    """(windows, context + span + context) bytes of a piece of a text.

    ``before`` and ``after`` are the bytes of the text beside the piece; zeros stand beyond its ends.
    """
    count = -(-len(data) // span)
    out = np.zeros(count * span + 2 * context, dtype=np.uint8)
    whole = np.frombuffer(before[-context:] + data + after[:context], dtype=np.uint8)
    start = context - len(before[-context:])
    out[start : start + len(whole)] = whole[: len(out) - start]
    return np.lib.stride_tricks.sliding_window_view(out, span + 2 * context)[::span]


def train(texts: list[str], languages: list[str], steps: int = STEPS, seed: int = 7) -> Network | None:
    """A network for the languages among the labels; None without any."""
    names = sorted(set(languages))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    net = Network(names, seed=seed)
    held, labels = [], []
    for text, language in zip(texts, languages, strict=True):
        data = text.encode("utf-8", "surrogatepass")
        if not data:
            continue
        every = windows_of(data)
        some = every if len(every) <= WINDOWS_PER_DOCUMENT else every[rng.choice(len(every), WINDOWS_PER_DOCUMENT, replace=False)]
        held.append(some)
        labels += [names.index(language)] * len(some)
    if not held:
        return None
    windows, target = np.concatenate(held), np.array(labels)
    members = [m for k in range(len(names)) if len(m := np.flatnonzero(target == k))]
    first = [np.zeros_like(w) for w in net.weights]
    second = [np.zeros_like(w) for w in net.weights]
    for step in range(1, steps + 1):
        # Every language is drawn equally often.
        chosen = np.array([rng.choice(members[k]) for k in rng.integers(0, len(members), TRAIN_BATCH)])
        _, grads = net.gradients(windows[chosen], target[chosen])
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * (1 - step / (steps + 1))
        for w, g, m, v in zip(net.weights, grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / max(size, 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def predict(net: Network, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, mean probability over all byte positions) of each text."""
    total = np.zeros((len(texts), len(net.languages)))
    sizes = np.zeros(len(texts))
    queue: list[tuple[int, np.ndarray]] = []
    waiting = 0

    def flush() -> None:
        nonlocal queue, waiting
        owner = np.repeat([i for i, _ in queue], [len(w) for _, w in queue])
        windows = np.concatenate([w for _, w in queue])
        for s in range(0, len(windows), SIDE_BY_SIDE):
            part = windows[s : s + SIDE_BY_SIDE]
            p = net.position_probabilities(part)[CONTEXT : CONTEXT + SPAN]
            own = part[:, CONTEXT : CONTEXT + SPAN]
            if (own[:, -1] == 0).any():  # positions past the end of a text do not count
                p *= (own != 0).T[:, None, :]
            np.add.at(total, owner[s : s + SIDE_BY_SIDE], p.sum(axis=0).T)
        queue, waiting = [], 0

    for i, text in enumerate(texts):
        if not text or not has_letter(text):
            continue
        data = text.encode("utf-8", "surrogatepass").replace(b"\x00", b" ")
        sizes[i] = len(data)
        for s in range(0, len(data), SPAN * SIDE_BY_SIDE):
            end = s + SPAN * SIDE_BY_SIDE
            piece = windows_of(data[s:end], data[max(0, s - CONTEXT) : s], data[end : end + CONTEXT])
            queue.append((i, piece))
            waiting += len(piece)
            if waiting >= 2 * SIDE_BY_SIDE:
                flush()
    if queue:
        flush()
    best = total.argmax(axis=1)
    return [(net.languages[k], min(1.0, float(row[k] / n))) if n else (UNKNOWN, 0.0) for k, row, n in zip(best.tolist(), total, sizes, strict=True)]


def held_out(id_col: str, folds: int = FOLDS):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), F.lit(folds)) == 0


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = MAX_PER_LANGUAGE,
    languages: int = MAX_LANGUAGES,
) -> Network | None:
    """Train on a bounded sample of the labelled documents outside the held-out fold."""
    labelled = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    slim = labelled.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"))
    known = slim.groupBy("_lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_lang").limit(languages).collect()
    # A hash below a language's bound puts a document in the pool: about twice as many as wanted,
    # all of a language with fewer.  Bounds are taken before the shuffle, so no task gets a whole language.
    span = 1 << 40
    bound = F.lit(None).cast("long")
    for lang, n in known:
        bound = F.when(F.col("_lang") == lang, F.lit(round(min(1.0, 2 * per_language / n) * span))).otherwise(bound)
    pool = slim.where(F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(span)) < bound)
    rank = F.row_number().over(W.partitionBy("_lang").orderBy(F.xxhash64("_id", F.lit("sample")), "_id"))
    chosen = pool.withColumn("_rank", rank).where(F.col("_rank") <= per_language).select("_id", "_lang").distinct()
    rows = labelled.join(F.broadcast(chosen), (F.col(id_col).eqNullSafe(F.col("_id"))) & (F.col(lang_col) == F.col("_lang")), "left_semi")
    texts, names = [], []
    # At most per_language texts of each of the languages come to the driver, a partition at a time.
    for text, language in rows.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")).orderBy(F.xxhash64(id_col), F.xxhash64(text_col)).toLocalIterator():
        if has_letter(text):
            texts.append(text)
            names.append(language)
    return train(texts, names)


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id with ``held_out``, ``lang_pred`` and ``score`` of every row."""
    body = fresh(docs.select(id_col), "_text")
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias(body))
    if net is None:
        return rows.select(id_col, "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = predict(sent.value, b.column(2).to_pylist())
            out = pa.schema([b.schema.field(0), b.schema.field(1), ("lang_pred", pa.string()), ("score", pa.float64())])
            yield batch(out, [b.column(0), b.column(1), [x for x, _ in found], [s for _, s in found]])

    return in_batches(rows, run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


QUERIES = {"op8_language_id": op8_language_id}
ORACLES: dict[str, str] = {}
