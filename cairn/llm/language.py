"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into segments of SEGMENT bytes at most. A network reads each segment from both ends and gives every byte
position probabilities of the languages; their mean over all positions of a document is the document's. The network is
trained in numpy by backpropagation through time, on crops of segments of a bounded sample of each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .folds import fold
from .scratch import fresh
from .wordvec import split_batches, text_bytes

#: Bytes that the network reads in a row, and segments read side by side.
SEGMENT, BATCH = 128, 1024
HIDDEN = 16
#: Languages that a model knows at most (the most frequent), documents of each that it is trained on, and segments of
#: each of these, evenly spaced. They bound the model and its sample; every text is labelled whole.
LANGUAGES, SAMPLE, SEGMENTS = 200, 500, 8
STEPS, CROPS, CROP, RATE = 400, 256, (8, 64), 0.02
UNKNOWN = "und"


@dataclass
class Network:
    """Weights of a reading direction come in three blocks of HIDDEN rows: update gate, reset gate, candidate."""

    labels: list[str]
    #: for each direction: the inputs' part of the blocks, a column for each byte, and the state's part
    table: list[np.ndarray] = field(default_factory=list)
    state: list[np.ndarray] = field(default_factory=list)
    #: for each direction: from its state to the languages; and their bias
    out: list[np.ndarray] = field(default_factory=list)
    bias: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.float32))

    @property
    def weights(self) -> list[np.ndarray]:
        return [*self.table, *self.state, *self.out, self.bias]


def initial(labels: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return Network(
        labels, [draw(3 * hidden, 256, scale=0.5) for _ in "lr"], [draw(3 * hidden, hidden, scale=hidden**-0.5) for _ in "lr"],
        [draw(len(labels), hidden, scale=hidden**-0.5) for _ in "lr"], np.zeros((len(labels), 1), np.float32),
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _read(table: np.ndarray, state: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """States after each of the bytes data[t], and what backpropagation needs."""
    n = state.shape[1]
    h = np.zeros((n, data.shape[1]), table.dtype)
    states, kept = [], []
    for row in data:
        x, u = table[:, row], state @ h
        z, r = _sigmoid(x[:n] + u[:n]), _sigmoid(x[n : 2 * n] + u[n : 2 * n])
        c = np.tanh(x[2 * n :] + r * u[2 * n :])
        kept.append((h, z, r, c, u[2 * n :]))
        h = h + z * (c - h)
        states.append(h)
    return np.stack(states), kept


def _through_time(table: np.ndarray, state: np.ndarray, data: np.ndarray, kept: list[tuple], dstates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of table and state from those of the states."""
    n = state.shape[1]
    dh = np.zeros_like(dstates[0])
    dx = np.empty((len(data), data.shape[1], 3 * n), table.dtype)
    dstate = np.zeros_like(state)
    for t in range(len(data) - 1, -1, -1):
        h, z, r, c, u = kept[t]
        dh = dh + dstates[t]
        dc = dh * z * (1 - c * c)
        dz = dh * (c - h) * z * (1 - z)
        dr = dc * u * r * (1 - r)
        du = np.concatenate([dz, dr, dc * r])
        dstate += du @ h.T
        dx[t] = np.concatenate([dz, dr, dc]).T
        dh = dh * (1 - z) + state.T @ du
    # sum by byte
    flat, rows = data.ravel(), dx.reshape(-1, 3 * n)
    order = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.diff(flat[order], prepend=-1))
    dtable = np.zeros_like(table)
    dtable[:, flat[order][first]] = np.add.reduceat(rows[order], first, axis=0).T
    return dtable, dstate


def gradients(net: Network, data: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions of data (length, rows) of languages target (rows), and its gradients."""
    flipped = data[::-1]
    left, kept_left = _read(net.table[0], net.state[0], data)
    right, kept_right = _read(net.table[1], net.state[1], flipped)
    logits = net.out[0] @ left + net.out[1] @ right[::-1] + net.bias
    logits -= logits.max(1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(1, keepdims=True)
    rows = np.arange(data.shape[1])
    loss = float(-np.log(np.maximum(p[:, target, rows], 1e-30)).mean())
    p[:, target, rows] -= 1
    p /= data.size
    dout = [np.einsum("tkb,thb->kh", p, left), np.einsum("tkb,thb->kh", p, right[::-1])]
    dleft, dright = net.out[0].T @ p, (net.out[1].T @ p)[::-1]
    dtl, dsl = _through_time(net.table[0], net.state[0], data, kept_left, dleft)
    dtr, dsr = _through_time(net.table[1], net.state[1], flipped, kept_right, dright)
    return loss, [dtl, dtr, dsl, dsr, *dout, p.sum((0, 2))[:, None]]


def train(labels: list[str], segments: list[bytes], target: np.ndarray, steps: int = STEPS, seed: int = 7) -> Network:
    """Adam over crops of the segments, as many of each language."""
    net = initial(labels, seed=seed)
    rng = np.random.default_rng(seed)
    of = [np.flatnonzero(target == k) for k in range(len(labels))]
    size = np.array([len(s) for s in segments])
    data = np.frombuffer(b"".join(segments), np.uint8)
    begin = np.cumsum(size) - size
    m, v = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    for step in range(1, steps + 1):
        length = int(rng.integers(*CROP, endpoint=True))
        which = np.concatenate([rng.choice(rows, -(-CROPS // len(of))) for rows in of])
        at = begin[which] + (rng.random(len(which)) * (np.maximum(size[which] - length, 0) + 1)).astype(np.int64)
        # a shorter segment is read round and round
        place = begin[which] + (at - begin[which] + np.arange(length)[:, None]) % size[which]
        _, grads = gradients(net, data[place].astype(np.intp), target[which])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1))) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        for w, g, a, b in zip(net.weights, grads, m, v):
            g = g * min(1.0, 1 / max(norm, 1e-12))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= (rate * a / (np.sqrt(b) + 1e-8)).astype(w.dtype)
    return net


class Reader:
    """Labels the positions of many segments side by side.

    Gates are computed as (1 + tanh) / 2, whose halves are in the weights.
    """

    def __init__(self, net: Network):
        n = net.state[0].shape[1]
        half = np.repeat(np.float32([0.5, 0.5, 1]), n)[:, None]
        self.table = [np.ascontiguousarray(t * half) for t in net.table]
        self.state = [np.ascontiguousarray(s * np.float32(0.5)) for s in net.state]
        self.out, self.bias, self.n = net.out, net.bias, n

    def _states(self, way: int, data: np.ndarray, live: np.ndarray, order: range) -> Iterator[tuple[int, np.ndarray]]:
        """(place, states of the first live[place] segments) along order; later segments begin with a state of zeros."""
        n, table, state = self.n, self.table[way], self.state[way]
        whole = np.zeros((n, data.shape[1]), np.float32)
        x = np.empty((3 * n, data.shape[1]), np.float32)
        for t in order:
            k = live[t]
            h, xs = (whole, x) if k == data.shape[1] else (whole[:, :k], np.empty((3 * n, k), np.float32))
            np.take(table, data[t, :k], axis=1, out=xs, mode="clip")
            u = state @ h
            gates = u[: 2 * n]
            gates += xs[: 2 * n]
            np.tanh(gates, out=gates)
            gates += 1
            c = gates[n:] * u[2 * n :]
            c += xs[2 * n :]
            np.tanh(c, out=c)
            c -= h
            c *= gates[:n]
            c *= np.float32(0.5)
            h += c
            yield t, h

    def label(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
        """Sums of the positions' probabilities, a row for each segment; labels gets the label of each position of data."""
        sums = np.zeros((len(starts), len(self.bias)))
        order = np.argsort(-sizes, kind="stable")
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            length = int(sizes[part[0]])
            places = starts[part] + np.arange(length)[:, None]
            read = data[np.minimum(places, len(data) - 1)].astype(np.intp)
            live = np.searchsorted(-sizes[part], -np.arange(length), side="left")
            seen = np.empty((length, len(self.bias), len(part)), np.float32)
            for t, h in self._states(0, read, live, range(length)):
                seen[t, :, : h.shape[1]] = self.out[0] @ h
            total = np.zeros((len(self.bias), len(part)), np.float32)
            for t, h in self._states(1, read, live, range(length - 1, -1, -1)):
                k = h.shape[1]
                p = self.out[1] @ h
                p += seen[t, :, :k]
                p += self.bias
                if labels is not None:
                    labels[places[t, :k]] = p.argmax(0)
                p -= p.max(0)
                np.exp(p, out=p)
                p /= p.sum(0)
                total[:, :k] += p
            sums[part] = total.T
        return sums


def segments_of(off: np.ndarray, size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, starts and sizes of their segments: as few as can be, of nearly equal size."""
    length = np.diff(off)
    parts = -(-length // size)
    doc = np.repeat(np.arange(len(length)), parts)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin, end = k * length[doc] // parts[doc], (k + 1) * length[doc] // parts[doc]
    return doc, off[doc] + begin, end - begin


def read_texts(reader: Reader, texts: pa.Array) -> np.ndarray:
    """Mean probabilities of each text's positions; zeros for one without any."""
    data, off = text_bytes(texts)
    doc, starts, sizes = segments_of(off)
    sums = reader.label(data, starts, sizes)
    pooled = np.zeros((len(off) - 1, sums.shape[1]))
    np.add.at(pooled, doc, sums)
    return pooled / np.maximum(1, np.diff(off))[:, None]


def fit(docs: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> Network:
    """Train on rows of docs (doc_id, text, lang) with text and language: at most ``sample`` documents of each of the
    LANGUAGES most frequent languages, the first by hash of the id, and SEGMENTS segments of each of them.

    Rows without a language or with a null or empty text teach nothing; without any row the network knows no language.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("lang is not null and text is not null and text != ''")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    span = 1 << 40
    rows = rows.join(F.broadcast(counts), "lang").withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(span)))
    # about twice as many as are taken go on to be ranked, however frequent the language
    rows = rows.where(F.col("h") < F.lit(2.0 * span * sample) / F.col("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= sample).select("lang", "text")

    def run(batches):
        for b in split_batches(batches, 1):
            data, off = text_bytes(b.column(1))
            doc, starts, sizes = segments_of(off)
            k = np.arange(len(doc)) - np.searchsorted(doc, doc)
            n = np.bincount(doc, minlength=b.num_rows)[doc]
            taken = np.flatnonzero((k * SEGMENTS // np.maximum(n, 1) != (k - 1) * SEGMENTS // np.maximum(n, 1)) | (n <= SEGMENTS))
            cut = [data[s : s + z].tobytes() for s, z in zip(starts[taken], sizes[taken])]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc[taken])), pa.array(cut, pa.binary())], names=["lang", "segment"])

    got = rows.mapInArrow(run, "lang string, segment binary").toPandas().sort_values(["lang", "segment"])
    labels = sorted(got.lang.unique())
    if not labels:
        return initial([])
    return train(labels, list(got.segment), np.searchsorted(labels, got.lang), steps)


def _letters_only(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns kept and the text, last; a text without any letter is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    text = F.when(text.rlike(r"\p{L}"), text).otherwise("").alias(fresh("text", keep))
    return docs.select(*[F.col(f"`{c}`") for c in keep], text)


def predict(docs: DataFrame, net: Network, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add language and its probability, by these names, to the columns ``keep`` (default doc_id).

    All bytes of a text are labelled, however long it is. A text that is null or has no letter, and every one if the
    network knows no language, is 'und' with score 0. Of equal probabilities the first language in order wins. Rows are
    labelled each by itself, so repeated rows get equal results. An empty table gives no rows.
    """
    keep = keep or ["doc_id"]
    rows = _letters_only(docs, keep)
    n, labels = len(keep), np.array([*net.labels, UNKNOWN])
    schema = rows.select(rows.columns[:n]).schema.add(names[0], "string").add(names[1], "double")
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        reader = Reader(shared.value)
        for b in split_batches(batches, n):
            p = np.zeros((b.num_rows, len(labels)))
            if len(labels) > 1:
                p[:, :-1] = read_texts(reader, b.column(n))
            best = np.where(p.any(1), p.argmax(1), len(labels) - 1)
            score = np.minimum(1.0, p.max(1))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(labels[best].tolist(), pa.string()), pa.array(score)], names=[*keep, *names])

    return rows.mapInArrow(run, schema)


def label_runs(docs: DataFrame, net: Network, id_col: str = "doc_id") -> DataFrame:
    """The labels of the positions: (id, start, end, lang) for each run of bytes with the same language, in order of places.

    end is past the run. Texts without a position to label, and all if no language is known, give no rows. Repeated ids
    give the runs of each of their rows.
    """
    rows = _letters_only(docs, [id_col])
    schema = rows.select(id_col).schema.add("start", "long").add("end", "long").add("lang", "string")
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net = shared.value
        reader = Reader(net)
        for b in split_batches(batches, 1):
            data, off = text_bytes(b.column(1))
            if not len(data) or not net.labels:
                continue
            _, starts, sizes = segments_of(off)
            found = np.zeros(len(data), np.int32)
            reader.label(data, starts, sizes, found)
            turn = np.ones(len(data), bool)
            turn[1:] = found[1:] != found[:-1]
            turn[off[:-1][np.diff(off) > 0]] = True
            begin = np.flatnonzero(turn)
            end = np.append(begin[1:], len(data))
            doc = np.searchsorted(off, begin, side="right") - 1
            lang = pa.array(net.labels, pa.string()).take(pa.array(found[begin]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(doc)), pa.array(begin - off[doc]), pa.array(end - off[doc]), lang], names=[id_col, "start", "end", "lang"]
            )

    return rows.mapInArrow(run, schema)


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; learns from those outside fold 2 of 4."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit(docs.where(fold("doc_id", 4) != 2))
    return predict(docs, net).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
