"""One query for each operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, codes, lines, neardup, packing, private, quality, sharding, store, substrings, topk
from .common import documents
from .tokens import vocabulary_path


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of 400-byte strings that start anywhere else are removed; digests of what is left."""
    return substrings.remove_repeats(documents(spark, sf_dir), length=400)


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by the ranks of a tiktoken file and the public pattern, and the bytes decoded from them, as digests."""
    return bpe.roundtrip_digests(documents(spark, sf_dir), vocabulary_path("byte_bpe_multi_50k.tiktoken"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines equal to an earlier one, or within one edit of one, are removed; digests of what is left."""
    kept = lines.dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 shards of near equal bytes by a stored map of 4096 slots."""
    return sharding.shard_documents(documents(spark, sf_dir), n_shards=40)


def op5_chosen_path_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles share 85 % of their union."""
    return neardup.near_duplicates(documents(spark, sf_dir), width=3, numerator=85, denominator=100).drop("row_key")


def op6_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents in as few sequences of 2048 tokens as can be."""
    return packing.pack_documents(documents(spark, sf_dir), vocabulary_path("word_bpe_49k.json"), capacity=2048)


def op7_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files of a content-addressed store of token ids say of each document."""
    return store.store_documents(documents(spark, sf_dir), vocabulary_path("word_bpe_49k.json"))


def op8_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of whole texts by a byte-level net that is fitted on the labels not held out."""
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def op9_cross_polytope_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows that the index finds for every twentieth vector."""
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=20, k=20)


def op10_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows of highest integer inner product for every twentieth vector, exactly."""
    return topk.exact_top(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=20, k=20)


def op11_annular_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of 8 parts from codebooks of 16 whole-number entries after 6 rounds, and their errors."""
    coded, books = codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), parts=8, entries=16, rounds=6, scale=4096)
    return coded.select("vec_id", "code", "error", "label_error", F.lit(codes.books_digest(books)).alias("codebooks_sha256"))


def op12_weak_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of whole texts: strict forms, and looser ones that a weakly supervised classifier adds."""
    return private.digests(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup,
        op2_bpe_roundtrip,
        op3_line_dedup,
        op4_virtual_slot_sharding,
        op5_chosen_path_neardup,
        op6_pattern_packing,
        op7_content_store,
        op8_quality_net,
        op9_cross_polytope_ann,
        op10_ball_tree_topk,
        op11_annular_codes,
        op12_weak_private_spans,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_KEYS = ", ".join(f"'{side[0]}' || {h} || ':' || {side}(t, {h})" for side in ("left", "right") for h in ("(n // 2)", "((n + 1) // 2)"))



def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Each round as two tables: the nearest entries a0, a1, … of all parts x, and the books b1, b2, … they lead to."""
    near = "SELECT x.i, x.part, min(x.xx - 2 * list_dot_product(x.v, b.v)::BIGINT + b.bb) AS d, arg_min(b.e, (x.xx - 2 * list_dot_product(x.v, b.v)::BIGINT + b.bb) * 1000 + b.e) AS e FROM x JOIN {b} b ON x.part = b.part GROUP BY x.i, x.part"
    mean = "SELECT part, e, list(floor(t / n) ORDER BY place)::DOUBLE[] AS v FROM (SELECT part, e, place, sum(x.v[place]) AS t, count(*) AS n FROM x JOIN {a} a USING (i, part), w, range(1, 1025) r(place) WHERE place <= w.n GROUP BY ALL) GROUP BY part, e"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED ({near.format(b=f'b{k}')})")
        if k < rounds:
            steps.append(f"m{k} AS MATERIALIZED ({mean.format(a=f'a{k}')}), b{k + 1} AS MATERIALIZED (SELECT part, e, coalesce(m{k}.v, b{k}.v) AS v, list_dot_product(coalesce(m{k}.v, b{k}.v), coalesce(m{k}.v, b{k}.v))::BIGINT AS bb FROM b{k} LEFT JOIN m{k} USING (part, e))")
    return f"""WITH s AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, label, list_transform(embedding, lambda c: floor(4096 * c::DOUBLE))::DOUBLE[] AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    w AS (SELECT max(len(v)) // {parts} AS n FROM s),
    x0 AS (SELECT i, vec_id, part, v[part * w.n + 1:(part + 1) * w.n] AS v FROM s, w, range({parts}) r(part)), x AS MATERIALIZED (SELECT i, vec_id, part, v, list_dot_product(v, v)::BIGINT AS xx FROM x0),
    b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, v, xx AS bb FROM x WHERE vec_id IN (SELECT vec_id FROM s ORDER BY vec_id LIMIT {entries})),
    {", ".join(steps)},
    c AS (SELECT i, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY i),
    h AS (SELECT sha256(string_agg(array_to_string(v::BIGINT[], ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{rounds})
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM s JOIN c USING (i), h"""


ORACLES: dict[str, str] = {
    "op3_line_dedup": f"""WITH r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    l AS (SELECT doc_id, i, raw, lower(trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12))) AS t FROM r),
    f AS (SELECT t, len(t) AS n, min(doc_id * 1000000 + i) AS o FROM l WHERE len(t) >= 20 GROUP BY t),
    k AS (SELECT t, n, o, unnest(list_distinct([{_KEYS}])) AS h FROM f),
    c AS (SELECT DISTINCT b.t FROM k a JOIN k b ON a.h = b.h WHERE a.o < b.o AND abs(a.n - b.n) <= 1 AND levenshtein(a.t, b.t) <= 1),
    g AS (SELECT l.*, f.t IS NOT NULL AND (f.o <> l.doc_id * 1000000 + l.i OR c.t IS NOT NULL) AS gone FROM l LEFT JOIN f ON l.t = f.t LEFT JOIN c ON l.t = c.t),
    s AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM g GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN s USING (doc_id)""",
    "op5_chosen_path_neardup": f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT a AS v, a AS u FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a),
    m AS (SELECT v, min(u) AS c FROM r GROUP BY v)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id, coalesce(m.c, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.v = d.doc_id""",
    "op10_ball_tree_topk": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
    k AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
    SELECT * FROM k WHERE rank <= 20""",
    "op11_annular_codes": _codes_sql(),
}
