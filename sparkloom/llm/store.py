"""A content-addressed store of token ids.

Rolling hashes cut each document's ids into chunks where the content says so; a chunk is stored
once, named by its digest; a document's recipe lists its chunks, and a Merkle root over their
digests lets a reader prove what it put together. Layout of a store:

    recipes/  one row per document in ascending doc_id: part, local_start, n_tokens, root, chunks
    chunks/   digest binary(16), n_tokens, data (little-endian ids of `width` bytes)
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gathered, new_folder, slices, stored, text_key, texts_of, to_bytes, worker_cache
from .tokens import encoder

#: Ids in a rolling window; between marks on average, and of a chunk at least and at most: about 380
#: ids a chunk, well below the median document (568 on sf0.1), so that near copies share chunks.
WINDOW, AVERAGE, LEAST, MOST = 8, 256, 128, 1024
CHUNK_REF = "array<struct<digest:binary,n:int>>"
END_ID = 1


def marks_of(ids: np.ndarray, average: int = AVERAGE, window: int = WINDOW) -> np.ndarray:
    """Places after which the rolling hash of a window of ids asks for a cut. Streams may follow
    one another in `ids`: a window that reaches into the stream before lies within the first
    `window` ids of its own, where `cut_points` takes no mark."""
    n = len(ids)
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        power = np.uint64(1)
        for j in range(min(window, n)):  # h[i] = sum of x[i-j] * base^j
            h[j:] += x[: n - j] * power
            power *= base
        h *= np.uint64(0xFF51AFD7ED558CCD)
    return np.nonzero((h >> np.uint64(40)) % np.uint64(average) == 0)[0] + 1


def cut_points(n: int, marks: list[int], least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of a stream of n ids: at marks, with chunks of at least `least` and at
    most `most` ids; the last may be shorter."""
    out, at, k = [], 0, 0
    while n - at > least:
        while k < len(marks) and marks[k] < at + least:
            k += 1
        at = min(marks[k] if k < len(marks) else n, at + most, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def merkle_root(digests: list[bytes]) -> bytes:
    """Pairs of digests are hashed upwards; an odd one rises as it is. No digests: of nothing."""
    level = digests or [hashlib.blake2b(b"", digest_size=16).digest()]
    while len(level) > 1:
        up = [hashlib.blake2b(level[i] + level[i + 1], digest_size=16).digest() for i in range(0, len(level) - 1, 2)]
        level = up + ([level[-1]] if len(level) % 2 else [])
    return level[0]


ENCODED = f"doc_id long, row_key long, n_tokens long, root binary, chunks {CHUNK_REF}, digest binary, n int, data binary"


def _encode(path: str, end_id: int):
    """Rows of two kinds: a document's recipe, or a chunk that the task has not met before."""

    kinds = {"doc_id": pa.int64(), "row_key": pa.int64(), "n_tokens": pa.int64(), "root": pa.binary(), "chunks": pa.list_(pa.struct([("digest", pa.binary()), ("n", pa.int32())])), "digest": pa.binary(), "n": pa.int32(), "data": pa.binary()}

    def batch(rows: int, **columns: pa.Array) -> pa.RecordBatch:
        """Columns that are not given are null."""
        return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(rows, t)) for k, t in kinds.items()], list(kinds))

    def run(batches) -> Iterator[pa.RecordBatch]:
        enc, met = encoder(path), set()
        for part in gathered(batches):
            every, ends = enc.encode_ended(to_bytes(part.column(1)), end_id)
            marks = marks_of(every)
            of_doc = np.split(marks, np.searchsorted(marks, ends[:-1], side="right"))
            names, sizes, roots, bounds = [], [], [], [0]
            new_names, new_sizes, bodies = [], [], []
            first = 0
            for end, own in zip(ends.tolist(), of_doc):
                ids, begin, first = every[first:end], first, end
                data = ids.astype("<u2") if ids.max() < 65536 else ids
                width, raw, at = data.itemsize, data.tobytes(), 0
                for stop in cut_points(len(ids), (own - begin).tolist()):
                    body = raw[at * width : stop * width]
                    name = hashlib.blake2b(body, digest_size=16, key=bytes([width])).digest()
                    names.append(name)
                    sizes.append(stop - at)
                    if name not in met:
                        if len(met) < 200_000:
                            met.add(name)
                        new_names.append(name)
                        new_sizes.append(stop - at)
                        bodies.append(body)
                    at = stop
                roots.append(merkle_root(names[bounds[-1] :]))
                bounds.append(len(names))
            refs = pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(sizes, pa.int32())], ["digest", "n"])
            chunks = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), refs)
            counts = pa.array(np.diff(ends, prepend=0))
            yield batch(part.num_rows, doc_id=part.column(0), row_key=part.column(2), n_tokens=counts, root=pa.array(roots, pa.binary()), chunks=chunks)
            if bodies:
                yield batch(len(bodies), digest=pa.array(new_names, pa.binary()), n=pa.array(new_sizes, pa.int32()), data=pa.array(bodies, pa.binary()))

    return run


def _unique(batches) -> Iterator[pa.RecordBatch]:
    """The first of each digest, of a partition sorted by digest that has all of each."""
    worker_cache("")  # frees the encoder's words
    last = None
    for batch in batches:
        names = batch.column(0).to_pylist()
        keep = [i for i, (a, b) in enumerate(zip([last, *names], names)) if a != b]
        last = names[-1] if names else last
        if keep:
            yield batch.take(pa.array(keep)) if len(keep) < len(names) else batch


def _starts(batches) -> Iterator[pa.RecordBatch]:
    """Adds the ids of a partition's earlier documents; the partition is sorted."""
    at = 0
    for b in batches:
        n = np.asarray(b.column(2))
        ends = np.cumsum(n) + at
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends - n)], [*b.schema.names, "local_start"])
        at = int(ends[-1]) if len(ends) else at


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> str:
    """Encodes every whole text, appends end_id and writes a store to `path`; returns it.

    A null text has the end id alone. Recipes lie in ascending doc_id (null first; rows of one
    doc_id by the hash of their text); repeated rows get a recipe each and share their chunks. A
    chunk met in thousands of copies leaves each task once before the shuffle by digest.
    """
    base = texts_of(docs).withColumn("row_key", text_key())
    both = stored(base.mapInArrow(_encode(tokenizer_path, end_id), ENCODED), "encoded")
    found = both.filter("digest is not null").select("digest", "n", "data").repartition("digest").sortWithinPartitions("digest")
    found.mapInArrow(_unique, "digest binary, n int, data binary").write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = both.filter("digest is null").select("doc_id", "row_key", "n_tokens", "root", "chunks")
    ordered = recipes.repartitionByRange("doc_id", "row_key").sortWithinPartitions("doc_id", "row_key").withColumn("part", F.spark_partition_id())
    ordered.mapInArrow(_starts, f"doc_id long, row_key long, n_tokens long, root binary, chunks {CHUNK_REF}, part int, local_start long").write.option("compression", "zstd").parquet(f"{path}/recipes")
    return path


def _proved(batches) -> Iterator[pa.RecordBatch]:
    """Reads chunks back: each must have the content that its name says."""
    worker_cache("")
    for b in batches:
        names, crcs = [], []
        for name, n, body in zip(*(c.to_pylist() for c in b.columns)):
            width = len(body) // n
            if hashlib.blake2b(body, digest_size=16, key=bytes([width])).digest() != name:
                raise ValueError(f"chunk {name.hex()} is damaged")
            names.append(name)
            crcs.append(zlib.crc32(body if width == 4 else np.frombuffer(body, "<u2").astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(crcs, pa.int64())], ["digest", "crc"])


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """The crc32 of concatenated parts from (crc32, bytes) of each: crc32 is affine in its start,
    and what it makes of zeros moves a start over a part."""
    crc = 0
    for own, size in parts:
        zeros = bytes(size)
        crc = zlib.crc32(zeros, crc) ^ zlib.crc32(zeros) ^ own
    return crc


def _documents(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for root, chunks in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
            chunks.sort(key=lambda c: c["k"])
            if merkle_root([c["digest"] for c in chunks]) != root:
                raise ValueError("a recipe does not match its Merkle root")
            out.append((sum(c["n"] for c in chunks), joined_crc([(c["crc"], 4 * c["n"]) for c in chunks])))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each recipe, from the files of a store.

    Every stored chunk is read once and held against its name, every document against its Merkle
    root; a document's crc32 is put together from those of its chunks, so no ids are shuffled.
    """
    recipes, chunks = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/chunks")
    crcs = chunks.select("digest", "n", "data").mapInArrow(_proved, "digest binary, crc long")
    refs = recipes.select("part", "local_start", F.posexplode("chunks").alias("k", "c")).select("part", "local_start", "k", "c.digest", "c.n")
    per = refs.join(crcs, "digest").groupBy("part", "local_start").agg(F.collect_list(F.struct("k", "digest", "n", "crc")).alias("chunks"))
    docs = recipes.select("doc_id", "part", "local_start", "root").join(per, ["part", "local_start"]).select("doc_id", "part", "local_start", "root", "chunks")
    found = docs.mapInArrow(_documents, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    # one row for each partition that wrote recipes: a number of files, not of documents
    sums = {r["part"]: r["n"] for r in recipes.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    at, bases = 0, []
    for p in sorted(sums):
        bases.append((p, at))
        at += sums[p]
    base = spark.createDataFrame(bases, "part int, base long")
    return found.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids array<int>) put together again from a store."""
    recipes, chunks = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/chunks")
    refs = recipes.select("doc_id", "part", "local_start", F.posexplode("chunks").alias("k", "c")).select("doc_id", "part", "local_start", "k", F.col("c.digest").alias("digest"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for parts in b.column(1).to_pylist():
                parts.sort(key=lambda c: c["k"])
                out.append(np.concatenate([np.frombuffer(c["data"], "<u2" if len(c["data"]) == 2 * c["n"] else "<u4") for c in parts]).astype(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])

    per = refs.join(chunks, "digest").groupBy("part", "local_start").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("k", "n", "data")).alias("chunks"))
    return per.select("doc_id", "chunks").mapInArrow(run, "doc_id long, ids array<int>")


def store_documents(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Writes a store into the shared folder and returns what its files say of each document."""
    spark = docs.sparkSession
    return read_digests(spark, write_store(docs, new_folder(spark, "ids"), tokenizer_path, end_id))
