"""The operators as stages of a pipeline: (spark, docs, sf_dir) to a table with docs' columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lines, neardup, packing, quality, substrings
from .common import bound_batches, split_by_keys, stored, text_key, worker_cache
from .tokens import vocabulary_path


def _with_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(row, text) to the columns of row with the new text, and n_chars as it is now. Columns of row
    are taken one by one, so that none of any name can clash with the text."""
    new = {"text": F.col("text")} | ({"n_chars": F.length("text").cast("long")} if "n_chars" in columns else {})
    return rows.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in columns])


def quality_scores(net: quality.ByteNet | float, text: Column) -> Column:
    def run(text: pd.Series) -> pd.Series:
        worker_cache("")
        if not isinstance(net, quality.ByteNet):
            return pd.Series(np.full(len(text), net))
        raw = [(t or "").encode() for t in text]
        return pd.Series(np.concatenate([net.scores(raw[i : i + 256]) for i in range(0, len(raw), 256)]) if raw else np.zeros(0))

    return F.pandas_udf(run, "double")(text)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality net, fitted on the labels, does not reject. A null text is scored
    as an empty one; repeated rows stay or go together; an empty table stays empty."""
    net = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(quality_scores(net, F.col("text").cast("string")) >= quality.THRESHOLD)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that come earlier in the corpus. One that loses lines and has
    no text left is a copy of what came before, and goes. A null text and one that was empty stay;
    rows alike in doc_id and text lose the same lines; an empty table stays empty."""
    left = lines.dedup_lines(docs)
    return _with_text(left.filter((F.col("n_removed") == 0) | (lines.normal_form(F.col("text")) != "")), docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8): the one of least doc_id,
    of rows that share it the one of least text hash, of rows alike in both any one. Documents
    without words, null ones too, stay; an empty table stays empty."""
    found, labels = neardup.link_sets(docs, 5, 80, 100)
    own = found.filter("sid is not null").groupBy("sid").agg(F.min(F.struct("doc_id", "row_key")).alias("head"), F.count("*").alias("n"))
    placed = own.join(labels, own["sid"] == labels["v"], "left").withColumn("comp", F.coalesce("comp", "sid"))
    heads = placed.groupBy("comp").agg(F.min("head").alias("h")).select("h.doc_id", "h.row_key")
    no_words = found.filter("sid is null").select("doc_id", "row_key").distinct()
    keys = stored(heads.union(no_words).withColumnsRenamed({"doc_id": "d", "row_key": "k"}), "heads")
    # the document as one column beside its id and key, whatever its columns are called
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    keyed = keyed.withColumn("key", F.xxhash64("id", F.col("row")["text"].cast("string")))
    kept = keyed.join(keys, (keyed["key"] == keys["k"]) & keyed["id"].eqNullSafe(keys["d"]), "left_semi")
    twice = found.filter("sid is not null").groupBy("doc_id", "row_key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("row_key").alias("key"))
    if twice.isEmpty():
        return kept.select("row.*")
    rows = stored(kept, "kept")
    again, once = rows.join(twice, "key", "left_semi"), rows.join(twice, "key", "left_anti")
    return once.union(again.dropDuplicates(["id", "key"])).select("row.*")


def without_spans(text: Column, spans: Column) -> Column:
    """The text without its byte ranges; bytes of a character that is cut in two go too."""

    def run(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, gone in zip(text, spans):
            raw, at, kept = (t or "").encode(), 0, []
            for s in sorted(gone, key=lambda s: s["start"]):
                if s["start"] > at:
                    kept.append(raw[at : s["start"]])
                at = max(at, s["stop"])
            out.append(b"".join([*kept, raw[at:]]).decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")(text, spans)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the bytes that strings of 400 bytes repeat anywhere. A null text stays
    null; repeated rows are copies of each other and
    lose the same bytes; an empty table stays empty."""
    bound_batches(spark)
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]  # the text itself moves once
    base = docs.select(F.struct(*others).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row_key", text_key())
    spans = substrings.repeated_spans(base.select("doc_id", "text", "row_key"), substrings.LENGTH)
    per = stored(spans.groupBy(F.col("doc_id").alias("d"), F.col("row_key").alias("k")).agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")
    touched, clean = split_by_keys(base, per.select(F.col("k").alias("row_key")).distinct())
    none = F.array().cast("array<struct<start:int,stop:int>>")
    joined = touched.join(per, (touched["row_key"] == per["k"]) & touched["doc_id"].eqNullSafe(per["d"]), "left").withColumn("spans", F.coalesce("spans", none))
    cut = joined.select("row", without_spans(F.col("text"), F.col("spans")).alias("text"))
    return _with_text(cut.union(clean.select("row", "text")), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, as `packing.pack_documents` returns them. Null and empty
    texts are an end id each, repeated rows are packed each, an empty table gives no sequences.
    Workers that other stages left behind may be idle beside those at work, so each remembers few
    words."""
    return packing.pack_documents(docs, vocabulary_path("word_bpe_49k.json"), most_words=150_000)
