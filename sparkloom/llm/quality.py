"""A quality classifier: a convolutional network over bytes, in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover the whole of it. Filters over a
few neighbouring byte vectors run along each chunk and are max-pooled there; a small layer reads
each chunk, and the chunks' mean gives one probability. Training sees a bounded sample of labelled
rows on the driver; scoring is a map over all rows without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, slices, stored, texts_of, to_bytes, worker_cache

CHUNK, OVERLAP, WIDTH, STRIDE, PAD = 256, 32, 6, 1, 256
VECTOR, FILTERS, HIDDEN = 8, 32, 16
#: Bounds of the sample that the model is fitted on, for each label: rows, and bytes of their texts,
#: which are taken whole or not at all.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 8 << 20
#: Chunks whose windows are laid out at a time.
BLOCK = 64
THRESHOLD = 0.7


def chunks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of all texts, (n, CHUNK) int16 padded with PAD, and each text's number of chunks; an
    empty text is a chunk of padding."""
    starts = [np.arange(0, max(1, len(t) - OVERLAP), CHUNK - OVERLAP) for t in texts]
    numbers = np.array([len(at) for at in starts], np.int64)
    out = np.full((int(numbers.sum()), CHUNK), PAD, np.int16)
    row = 0
    for t, at in zip(texts, starts):
        raw = np.frombuffer(t, np.uint8)
        for a in at:
            part = raw[a : a + CHUNK]
            out[row, : len(part)] = part
            row += 1
    return out, numbers


def filled(chunks: np.ndarray) -> np.ndarray:
    """The share of each chunk that is text, as a column."""
    return (chunks != PAD).mean(1, dtype=np.float32)[:, None]


def shortened(chunks: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """One short piece of a text, so that training sees short texts of either label."""
    out = np.full((1, CHUNK), PAD, np.int16)
    part = chunks[random.integers(len(chunks))]
    size = max(1, int((part != PAD).sum()))
    n = min(size, int(random.integers(6, 180)))
    at = int(random.integers(0, size - n + 1))
    out[0, :n] = part[at : at + n]
    return out


@dataclass
class ByteNet:
    """Parameters: byte vectors, filters with bias, the chunk layer, the last layer, its bias."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int = 7) -> ByteNet:
        r = np.random.default_rng(seed)

        def init(*shape: int) -> np.ndarray:
            return (r.standard_normal(shape) * (2 / shape[0]) ** 0.5).astype(np.float32)

        p = {"vectors": r.standard_normal((PAD + 1, VECTOR)).astype(np.float32) * 0.5, "filters": init(WIDTH * VECTOR, FILTERS), "fbias": np.zeros(FILTERS, np.float32), "layer": init(FILTERS + 1, HIDDEN), "lbias": np.zeros(HIDDEN, np.float32), "last": init(HIDDEN, 1)[:, 0], "bias": np.zeros(1, np.float32)}
        p["vectors"][PAD] = 0
        return ByteNet(p)

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """(n, places, WIDTH * VECTOR) view of the byte vectors under each place of a filter."""
        x = np.ascontiguousarray(self.p["vectors"][chunks])
        n, places = len(chunks), (CHUNK - WIDTH) // STRIDE + 1
        a, b, c = x.strides
        return np.lib.stride_tricks.as_strided(x, (n, places, WIDTH * VECTOR), (a, STRIDE * b, c))

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        """Largest answer of each filter in each chunk, in blocks of bounded size, and how much of
        the chunk is text."""
        out = np.empty((len(chunks), FILTERS), np.float32)
        for at in range(0, len(chunks), 128):
            w = self.windows(chunks[at : at + 128])
            out[at : at + 128] = (w.reshape(-1, WIDTH * VECTOR) @ self.p["filters"]).reshape(*w.shape[:2], FILTERS).max(1)
        return np.concatenate([np.maximum(out + self.p["fbias"], 0), filled(chunks)], 1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """A score of each whole text; many texts or a long one are read in blocks of chunks."""
        chunks, numbers = chunks_of(texts)
        h = np.maximum(self.pooled(chunks) @ self.p["layer"] + self.p["lbias"], 0)
        mean = np.add.reduceat(h, np.cumsum(numbers) - numbers, axis=0) / numbers[:, None]
        return 1 / (1 + np.exp(-np.clip(mean @ self.p["last"] + self.p["bias"][0], -40, 40).astype(np.float64)))

    def gradients(self, chunks: np.ndarray, numbers: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted logistic loss; each max sends its gradient to the place it came from."""
        p, first = self.p, np.cumsum(numbers) - numbers
        place, top = np.empty((len(chunks), FILTERS), np.int64), np.empty((len(chunks), FILTERS), p["filters"].dtype)
        blocks = [slice(at, at + BLOCK) for at in range(0, len(chunks), BLOCK)]
        for k in blocks:
            w = self.windows(chunks[k])
            conv = (w.reshape(-1, WIDTH * VECTOR) @ p["filters"]).reshape(*w.shape[:2], FILTERS)
            place[k] = conv.argmax(1)
            top[k] = np.take_along_axis(conv, place[k][:, None], 1)[:, 0]
        feat = np.concatenate([np.maximum(top + p["fbias"], 0), filled(chunks)], 1)
        hid = np.maximum(feat @ p["layer"] + p["lbias"], 0)
        mean = np.add.reduceat(hid, first, axis=0) / numbers[:, None]
        prob = 1 / (1 + np.exp(-np.clip(mean @ p["last"] + p["bias"][0], -30, 30)))
        d = ((prob - target) * weight / weight.sum()).astype(np.float32)
        g = {"last": mean.T @ d, "bias": np.array([d.sum()], np.float32)}
        dh = np.repeat(d[:, None] * p["last"] / numbers[:, None].astype(np.float32), numbers, axis=0) * (hid > 0)
        g["layer"], g["lbias"] = feat.T @ dh, dh.sum(0)
        df = ((dh @ p["layer"].T) * (feat > 0))[:, :FILTERS]
        g["fbias"] = df.sum(0)
        g["filters"], g["vectors"] = np.zeros_like(p["filters"]), np.zeros((PAD + 1, VECTOR))
        for k in blocks:
            rows = np.arange(len(chunks[k]))[:, None]
            g["filters"] += np.einsum("cf,cfk->kf", df[k], self.windows(chunks[k])[rows, place[k]], optimize=True)
            back = (df[k][:, :, None] * p["filters"].T).reshape(-1, VECTOR)
            seen = chunks[k][rows[:, :, None], (place[k] * STRIDE)[:, :, None] + np.arange(WIDTH)].reshape(-1)
            g["vectors"] += np.stack([np.bincount(seen, back[:, j], PAD + 1) for j in range(VECTOR)], 1)
        g["vectors"] = g["vectors"].astype(np.float32)
        g["vectors"][PAD] = 0
        return g

    def fit(self, chunks: np.ndarray, numbers: np.ndarray, target: np.ndarray, weight: np.ndarray, epochs: int | None = None, batch: int = 32, rate: float = 0.004, seed: int = 11) -> ByteNet:
        """Adam over small batches of documents, its rate falling to a tenth; 8 rounds over the
        sample, more of a small one."""
        epochs = epochs or min(60, max(8, 48_000 // len(numbers)))
        r, first = np.random.default_rng(seed), np.cumsum(numbers) - numbers
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        steps = max(1, epochs * -(-len(numbers) // batch))
        t = 0
        for _ in range(epochs):
            order = r.permutation(len(numbers))
            for at in range(0, len(order), batch):
                docs = order[at : at + batch]
                own = np.concatenate([np.arange(first[i], first[i] + numbers[i]) for i in docs])
                g = self.gradients(chunks[own], numbers[docs], target[docs], weight[docs])
                t += 1
                now = rate * (1 - 0.9 * t / steps)
                for k, x in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.99 * v[k] + 0.01 * x * x
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learnt: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> ByteNet | float:
    """Fits a net on the whole texts of at most `rows` rows of each label, taken in the order of the
    hash of their id, each if it still fits into `most_bytes` of text. Weights restore the labels' own
    proportion. Where fewer than two labels are known, the share of label 1 (0.5 if there is none)
    stands in for a net.

    Labels that are null or neither 0 nor 1, and those of held-out rows, are left out; of several
    for one id the least counts, and of several texts the greatest.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    known = known.filter(~held_out()).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.min("y").alias("y"))
    share = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(share) < 2:
        return float(next(iter(share), 0.5))
    parts = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    sample = F.broadcast(parts[0].union(parts[1]))  # 2 * rows ids at most

    one = texts_of(docs).join(sample, "doc_id").groupBy("doc_id", "y").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    one = stored(one, "quality-sample")  # a text for each id, of 2 * rows ids at most
    sizes = one.select("doc_id", "y", F.octet_length("text").alias("n"), F.xxhash64("doc_id").alias("h")).collect()
    room, chosen = {0: most_bytes, 1: most_bytes}, []
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        if r["n"] <= room[r["y"]]:  # a text that does not fit makes way for those after it
            room[r["y"]] -= r["n"]
            chosen.append(r["doc_id"])
    taken = one.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long")), "doc_id", "left_semi")
    got = taken.select("doc_id", "y", F.encode("text", "UTF-8").alias("text")).orderBy("doc_id").collect()
    y = np.array([r["y"] for r in got], np.float32)
    if len(set(y.tolist())) < 2:
        return share.get(1, 0) / sum(share.values())
    every = [chunks_of([bytes(r["text"])])[0] for r in got]
    seen = [max(1, int((y == k).sum())) for k in (0, 1)]
    weight = np.where(y == 1, share[1] / seen[1], share[0] / seen[0]).astype(np.float32)
    try:
        return fitted(every, y, weight)
    finally:
        del got, every
        give_back()  # the driver lives on


def fitted(every: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> ByteNet:
    """A net from each text's chunks, its label and weight; a short piece of each joins them."""
    random = np.random.default_rng(5)
    every += [shortened(c, random) for c in every[: len(y)]]
    y, weight = np.concatenate([y, y]), np.concatenate([weight, weight / 2])
    numbers, chunks = np.array([len(c) for c in every]), np.concatenate(every)
    every.clear()
    return ByteNet.fresh().fit(chunks, numbers, y, weight / weight.mean())


def score(docs: DataFrame, net: ByteNet | float, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score of every whole text, and the columns named in `keep`."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches) -> Iterator[pa.RecordBatch]:
        worker_cache("")
        net = shared.value
        for part in slices(batches, 1 << 20):
            texts = to_bytes(part.column(1))
            got = net.scores(texts) if isinstance(net, ByteNet) else np.full(len(texts), net)
            cols = [part.column(0), pa.array(got), *part.columns[2:]]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "score", *part.schema.names[2:]])

    base = texts_of(docs) if not keep else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[2:])
    return base.mapInArrow(run, "doc_id long, score double" + (", " + kinds if kinds else ""))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row: scores of whole texts from 0 to 1,
    predicted 1 from the threshold up. A null text scores as an empty one; a null id is not
    held out; repeated rows score alike; an empty table gives an empty result."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
