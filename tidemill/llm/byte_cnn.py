"""Quality classifier: a byte-level convolutional network in numpy, over the whole document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, slices

#: Bytes of a block; a chunk is two neighbouring blocks, so chunks overlap by half.
BLOCK = 256
WIDTH, STRIDE, FILTERS = 12, 4, 24
#: What a false alarm of label 1 costs in training: scores from 0.3 on are then those whose label 1 is likelier than not.
FALSE_ALARM = 7 / 3
#: Bounds of the training sample: rows, and bytes of a text in it. Scoring has no such bounds.
TRAIN_ROWS, TRAIN_BYTES = 1500, 40_000
#: Bytes whose windows are multiplied at once.
SLICE = 1 << 16


def _byte_channels() -> np.ndarray:
    """Fixed input channels of the 256 byte values: classes of characters and two mixing channels; 0 is padding."""
    groups = [b"aeiou", b"bcdfghjklmnpqrstvwxyz", bytes(range(65, 91)), b"0123456789", b" \t", b"\n\r", b".,;:!?'\"-()", b"#*$%&|<>@^~=+_/\\{}[]`", bytes(range(0x80, 0xC0)), bytes(range(0xC0, 0x100))]
    e = np.zeros((256, len(groups) + 2), np.float32)
    for k, g in enumerate(groups):
        e[list(g), k] = 1
    x = np.arange(256, dtype=np.float32)
    e[:, -2], e[:, -1] = np.sin(x * 2.4), np.cos(x * 1.7)
    e[0] = 0
    return e


CHANNELS = _byte_channels()


@dataclass
class Model:
    """Filters (window bytes x channels, FILTERS), their offsets, and the output layer."""

    filters: np.ndarray
    offsets: np.ndarray
    out: np.ndarray
    bias: float = 0.0
    size: int = field(default=FILTERS)


def _pack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer in which every text starts WIDTH zero bytes into a block, so that no window sees two texts; the first block of each."""
    blocks = [(len(t) + WIDTH) // BLOCK + 1 for t in texts]
    first = np.concatenate([[0], np.cumsum(blocks)])
    buf = np.zeros(int(first[-1]) * BLOCK + WIDTH, np.uint8)
    for t, b in zip(texts, first.tolist(), strict=False):
        buf[b * BLOCK + WIDTH : b * BLOCK + WIDTH + len(t)] = np.frombuffer(t, np.uint8)
    return buf, first


def _convolve(buf: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter in each block, and where it is."""
    n = (len(buf) - WIDTH) // BLOCK
    top, where = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int32)
    per = SLICE // BLOCK
    for at in range(0, n, per):
        end = min(at + per, n)
        x = CHANNELS[buf[at * BLOCK : end * BLOCK + WIDTH]]
        w = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=0)[: (end - at) * BLOCK : STRIDE]
        y = (np.ascontiguousarray(w).reshape(len(w), -1) @ m.filters + m.offsets).reshape(end - at, BLOCK // STRIDE, FILTERS)
        where[at:end] = y.argmax(1)
        top[at:end] = y.max(1)
    return np.maximum(top, 0), where


def _forward(buf: np.ndarray, first: np.ndarray, m: Model) -> dict:
    """Pool blocks to chunks, chunks to documents, and combine into a logit for each document."""
    top, where = _convolve(buf, m)
    last = np.zeros(len(top), bool)
    last[first[1:] - 1] = True
    nxt = np.where(last, np.arange(len(top)), np.arange(len(top)) + 1)
    take_next = top[nxt] > top
    chunk = np.where(take_next, top[nxt], top)
    at, count = first[:-1], np.diff(first)
    mean = np.add.reduceat(chunk, at) / count[:, None]
    most = np.maximum.reduceat(chunk, at)
    feats = np.column_stack([mean, most])
    return {"feats": feats, "logit": feats @ m.out + m.bias, "where": where, "chunk": chunk, "take_next": take_next, "nxt": nxt, "count": count, "most": most}


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 20, rate: float = 0.01, batch: int = 64, seed: int = 3) -> Model:
    """Train filters and output layer together by Adam on the log loss, label 0 weighted by FALSE_ALARM."""
    rng = np.random.default_rng(seed)
    c = CHANNELS.shape[1]
    m = Model(rng.normal(0, 0.25, (c * WIDTH, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS))
    if not texts:
        return m
    m.bias = float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    params = ["filters", "offsets", "out", "bias"]
    first_m = {p: 0.0 for p in params}
    second_m = {p: 0.0 for p in params}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            buf, first = _pack([texts[i] for i in pick])
            f = _forward(buf, first, m)
            g = (1 / (1 + np.exp(-f["logit"])) - labels[pick]) * np.where(labels[pick] > 0.5, 1.0, FALSE_ALARM) / len(pick)
            owner = np.repeat(np.arange(len(pick)), f["count"])
            # Back through mean and max over chunks, then to the block and window that held the maximum.
            dchunk = g[owner, None] * m.out[None, :FILTERS] / f["count"][owner, None]
            dchunk = dchunk + np.where(f["chunk"] == f["most"][owner], g[owner, None] * m.out[None, FILTERS : 2 * FILTERS], 0)
            block = np.where(f["take_next"], f["nxt"][:, None], np.arange(len(dchunk))[:, None])
            dchunk = np.where(f["chunk"] > 0, dchunk, 0)
            pos = block * BLOCK + np.take_along_axis(f["where"], block, 0) * STRIDE
            grads = {"out": f["feats"].T @ g + 1e-4 * m.out, "bias": g.sum(), "offsets": dchunk.sum(0)}
            df = np.empty_like(m.filters)
            for k in range(FILTERS):
                live = np.flatnonzero(dchunk[:, k])
                wins = CHANNELS[buf[pos[live, k][:, None] + np.arange(WIDTH)]].transpose(0, 2, 1).reshape(len(live), len(m.filters))
                df[:, k] = dchunk[live, k] @ wins
            grads["filters"] = df + 1e-4 * m.filters
            step += 1
            for p in params:
                first_m[p] = 0.9 * first_m[p] + 0.1 * grads[p]
                second_m[p] = 0.999 * second_m[p] + 0.001 * np.square(grads[p])
                move = rate * (first_m[p] / (1 - 0.9**step)) / (np.sqrt(second_m[p] / (1 - 0.999**step)) + 1e-8)
                new = getattr(m, p) - (5 * move if p in ("out", "bias") else move)
                setattr(m, p, new.astype(np.float32) if p in ("filters", "offsets") else new)
    return m


def score_texts(texts: list[bytes], m: Model) -> np.ndarray:
    """Probability of label 1 for each text; texts are packed until a buffer is full, long ones alone."""
    out, group, size = [], [], 0
    for t in [*texts, None]:
        if group and (t is None or size + len(t) > 1 << 20):
            buf, first = _pack(group)
            out.append(1 / (1 + np.exp(-np.clip(_forward(buf, first, m)["logit"], -40, 40))))
            group, size = [], 0
        if t is not None:
            group.append(t)
            size += len(t)
    return np.concatenate(out) if out else np.zeros(0)


def train(docs: DataFrame, labelled: DataFrame, rows: int = TRAIN_ROWS, longest: int = TRAIN_BYTES) -> Model:
    """Fit on at most ``rows`` labelled documents (doc_id, label 0 or 1) of at most ``longest`` bytes, whole texts.

    The sample is the same for the same labels: rows in the order of a hash of doc_id. Null labels and ids are left out.
    """
    ids = labelled.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    body = F.coalesce(F.col("text"), F.lit(""))
    picked = docs.select("doc_id", body.alias("text")).filter(F.octet_length("text") <= longest).join(F.broadcast(ids), "doc_id")
    got = picked.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).orderBy("doc_id").collect()
    return fit([r.text.encode() for r in got], np.array([float(r.label) for r in got]))


def classify(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if the score reaches the threshold) of every row's whole text.

    Null texts are empty; an empty text gets the score of an empty document. Other columns are ignored and repeated
    rows stay. Only the text enters a score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select("doc_id").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = score_texts(list(byte_texts(batch, "text")), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
