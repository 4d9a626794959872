"""Queries over the driver's tables, one per operator, with DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import tables as T
from .functions import text as X
from .operators import components, files, graph, history, scoring, similar, symbols
from .session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The same classes as in functions.text, as DuckDB writes them.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _sql_body(marks: tuple[str, ...] = X.COMMENT_STARTS) -> str:
    keep = "".join(f" AND NOT starts_with(x, '{m.replace(chr(39), chr(39) * 2)}')" for m in marks)
    return f"array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda y: regexp_replace(regexp_replace(y, '^{SPACE}+', ''), '{SPACE}+$', '')), lambda x: x <> ''{keep}), chr(10))"


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.body_hash(F.col("text")).alias("hash"))


_HASHES = f"h AS (SELECT doc_id, sha256({_sql_body()}) AS hash FROM documents WHERE text IS NOT NULL)"


@query(f"WITH {_HASHES} SELECT hash, count(*) AS n, min(doc_id) AS first_id FROM h GROUP BY hash HAVING count(*) >= 2")
def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = symbols.duplicate_groups(_hashes(spark, sf_dir), "hash", F.col("doc_id"), F.col("doc_id"))
    return got.select("hash", "n", F.col("first").alias("first_id"))


@query(f"WITH {_HASHES} SELECT hash, doc_id FROM h WHERE hash IN (SELECT hash FROM h GROUP BY hash HAVING count(*) >= 2)")
def dup_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.duplicate_members(cut_lineage(_hashes(spark, sf_dir)), "hash").select("hash", "doc_id")  # texts are hashed once


@query(f"SELECT doc_id, sha256({_sql_body(X.COMMENT_STARTS + X.DOCSTRING_MARKS)}) AS hash FROM documents WHERE text IS NOT NULL")
def body_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", X.body_hash(F.col("text"), strip_docstring_marks=True).alias("hash"))


@query(
    "SELECT count(*) AS total_files, coalesce(sum(len(string_split(text, chr(10)))), 0)::BIGINT AS total_lines, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages, coalesce(sum(n_chars), 0)::BIGINT AS total_chars FROM documents"
)
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = symbols.scan_summary(table(spark, sf_dir, "documents"), X.n_lines_scan(F.col("text")), F.col("lang"), {"total_chars": F.col("n_chars")})
    return got.select("total_files", "total_lines", F.array_join("languages_detected", ",").alias("languages"), "total_chars")


@query("SELECT doc_id, len(string_split(text, chr(10)))::INTEGER AS lines, n_chars FROM documents WHERE len(string_split(text, chr(10))) > 50 OR n_chars > 20000")
def god_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("lines", X.n_lines_scan(F.col("text")))
    return symbols.god_files(docs, F.col("lines"), F.col("n_chars"), 50, 20_000).select("doc_id", "lines", "n_chars")


_LINES = f"regexp_split_to_array(text, '{LINE_END}')"
_TEXT_LINES = f"CASE WHEN {_LINES}[-1] = '' THEN {_LINES}[:-2] ELSE {_LINES} END"


@query(f"SELECT doc_id, len(string_split(text, chr(10)))::INTEGER AS n_lines_scan, len({_TEXT_LINES})::INTEGER AS n_lines_text FROM documents")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.n_lines_scan(text).alias("n_lines_scan"), X.n_lines_text(text).alias("n_lines_text"))


@query(
    f"""WITH a AS (SELECT doc_id, {_TEXT_LINES} AS l, (doc_id % 9 - 1)::INTEGER AS s0, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE (doc_id % 9 + 2)::INTEGER END AS e0 FROM documents),
    b AS (SELECT *, len(l)::INTEGER AS total, greatest(1, least(s0, greatest(len(l), 1)))::INTEGER AS s FROM a),
    c AS (SELECT *, greatest(least(coalesce(e0, total), greatest(total, 1)), s)::INTEGER AS e FROM b)
    SELECT doc_id, array_to_string(l[s:e], chr(10)) AS source, s AS start_line, e AS end_line, total AS total_lines FROM c"""
)
def chunk_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 9
    end = F.when(F.col("doc_id") % 5 != 0, (k + 2).cast("int"))
    got = files.slice_lines(F.col("text"), (k - 1).cast("int"), end)
    return table(spark, sf_dir, "documents").select("doc_id", got.alias("s")).select("doc_id", "s.*")


_URL_PATH = "regexp_replace(url, '[?#].*$', '')"
_BASE = f"string_split({_URL_PATH}, '/')[-1]"
_SUFFIX = f"lower(regexp_extract({_BASE}, '(?s)^\\.*[^.].*?(\\.[^.]+)$', 1))"


def _url_path() -> F.Column:
    return F.regexp_replace("url", "[?#].*$", "")


@query(
    f"SELECT page_id, ({_BASE} IN ({', '.join(repr(x) for x in T.SKIPPED_NAMES)}) OR strlen(html) > 4000 OR "
    + " OR ".join(f"lower(regexp_extract({_BASE}, '(?s)^\\.*[^.]+(\\..*)$', 1)) LIKE '%{s}' OR {_SUFFIX} = '{s}'" for s in (*T.SKIPPED_SUFFIXES, ".html"))
    + ") AS skipped FROM pages"
)
def skip_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file guard on URL paths, with .html among the suffixes and a bound that pages reach."""
    path, size = _url_path(), F.octet_length("html")
    guarded = files.is_skipped(path, size) | (size > 4000) | (X.suffix(path) == ".html")
    return table(spark, sf_dir, "pages").select("page_id", guarded.alias("skipped"))


@query(
    f"SELECT page_id, {_SUFFIX} AS suffix, CASE {_SUFFIX} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.CHUNK_LANGUAGES.items()) + " ELSE 'text' END AS language FROM pages"
)
def language_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _url_path()
    return table(spark, sf_dir, "pages").select("page_id", X.suffix(path).alias("suffix"), files.language_of(path).alias("language"))


_CALLS = r"""SELECT page_id, unnest(regexp_extract_all(replace(line, '(', '( '), '(?:^|[^\w.])([a-zA-Z_]\w{2,})\s*\(', 1)) AS name FROM
    (SELECT page_id, unnest(string_split(html, chr(10))) AS line FROM pages)
    WHERE NOT regexp_matches(line, '^\s*(#|//)')"""


@query(f"SELECT name, count(*) AS n_calls, count(DISTINCT page_id) AS n_pages FROM ({_CALLS}) GROUP BY name")
def call_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("file"), F.col("html").alias("text"))
    calls = symbols.call_sites(pages, "compat")
    return calls.groupBy("name").agg(F.count("*").alias("n_calls"), F.count_distinct("file").alias("n_pages"))


_USED = "SELECT l_partkey FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R'"
_KEPT_TYPES = ("PROMO", "ECONOMY")


def _used_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter("l_quantity >= 49 AND l_returnflag = 'R'")


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    for p in _KEPT_TYPES:
        part = part.filter(~F.col("p_type").startswith(p))
    return symbols.unreferenced(part, _used_parts(spark, sf_dir), "p_partkey", "l_partkey")


_ORPHANS = f"SELECT * FROM part WHERE p_partkey NOT IN ({_USED})" + "".join(f" AND NOT starts_with(p_type, '{p}')" for p in _KEPT_TYPES)


@query(f"SELECT p_partkey, p_name FROM ({_ORPHANS})")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("p_partkey", "p_name")


@query(f"SELECT p_partkey, p_name FROM part WHERE p_partkey IN ({_USED})")
def referenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.referenced(table(spark, sf_dir, "part"), _used_parts(spark, sf_dir), "p_partkey", "l_partkey").select("p_partkey", "p_name")


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS r FROM orders) WHERE r = 1")
def first_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return files.first_match(orders, ["o_custkey"], F.col("o_orderpriority"), [F.col("o_orderkey")])


@query(
    """WITH c AS (SELECT p_partkey, 0 AS pr, p_partkey % 997 * 3 AS k FROM part UNION ALL SELECT p_partkey, 1, p_partkey % 50 FROM part UNION ALL SELECT p_partkey, 2, p_partkey % 20 + 1 FROM part),
    f AS (SELECT p_partkey, k, row_number() OVER (PARTITION BY p_partkey ORDER BY pr) AS r FROM c JOIN supplier ON k = s_suppkey WHERE s_acctbal > 0)
    SELECT p_partkey, k AS s_suppkey FROM f JOIN supplier ON k = s_suppkey WHERE r = 1 AND s_nationkey < 20"""
)
def resolve_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import resolution on tables: three candidate suppliers for each part, the first with money
    in hand counts, and is an edge if it is of a nation below 20."""
    p = F.col("p_partkey")
    each = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.array(p % 997 * 3, p % 50, p % 20 + 1)).alias("pr", "k"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_acctbal", "s_nationkey")
    hit = each.join(supplier.filter("s_acctbal > 0"), "k").groupBy("p_partkey").agg(F.min_by(F.struct("k", "s_nationkey"), "pr").alias("f"))
    return hit.filter("f.s_nationkey < 20").select("p_partkey", F.col("f.k").alias("s_suppkey"))


_EDGES = """flows AS (SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL),
    ranked AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY n DESC, n_name) AS r FROM flows JOIN nation ON b = n_nationkey),
    edges AS (SELECT a, b FROM ranked WHERE r = 1)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's customers to the nation that supplies most of their lines."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("to"), "n_name")
    buyer = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select("o_orderkey", F.col("c_nationkey").alias("from"))
    seller = line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"]).select("l_orderkey", F.col("s_nationkey").alias("to"))
    flows = seller.join(buyer, F.col("l_orderkey") == F.col("o_orderkey")).filter(F.col("from") != F.col("to")).groupBy("from", "to").agg(F.count("*").alias("n"))
    return files.first_match(flows.join(nation, "to").select("from", "to", "n", "n_name"), ["from"], -F.col("n"), [F.col("n_name")]).select("from", "to")


@query(f"WITH {_EDGES} SELECT a AS from_nation, b AS to_nation FROM edges")
def top_partner_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select(F.col("from").alias("from_nation"), F.col("to").alias("to_nation"))


_REACH = f"WITH RECURSIVE {_EDGES}, reach AS (SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)"


@query(f"{_REACH} SELECT a AS nation FROM reach WHERE a = b")
def cycle_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycle_members(_edges(spark, sf_dir)).select(F.col("file").alias("nation"))


@query(
    f"""WITH RECURSIVE {_EDGES}, walk AS (SELECT [a, b] AS p FROM edges WHERE a < b UNION ALL
    SELECT list_append(p, b) FROM walk JOIN edges ON p[-1] = a WHERE len(p) < 9 AND p[1] <> p[-1] AND (b = p[1] OR (b > p[1] AND NOT list_contains(p, b))))
    SELECT array_to_string(p, '>') AS cycle FROM walk WHERE p[1] = p[-1]"""
)
def cycle_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.list_cycles(_edges(spark, sf_dir), 8).select(F.array_join(F.col("cycle").cast("array<string>"), ">").alias("cycle"))


_LINKS = "links AS (SELECT DISTINCT l_partkey AS a, l_orderkey % (SELECT count(*) FROM part) + 1 AS b FROM lineitem WHERE l_quantity >= 49)"


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse graph on parts, with one large component, some small ones and long tails."""
    n = table(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("from"), (F.col("l_orderkey") % n.scalar() + 1).alias("to")).distinct()


@query(f"WITH RECURSIVE {_LINKS}, reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a) SELECT x.a AS part, min(y.a) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a")
def part_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongly connected components, each named by its least node."""
    return components.components(_links(spark, sf_dir)).withColumnRenamed("node", "part")


@query(f"WITH {_EDGES} SELECT b AS nation, count(DISTINCT a) AS inbound FROM edges WHERE a <> b GROUP BY b")
def in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.in_degree(_edges(spark, sf_dir)).select(F.col("file").alias("nation"), "inbound")


@query(
    f"""{_REACH}, {_HASHES}, d AS (SELECT coalesce(sum(n), 0) AS n FROM (SELECT count(*) AS n FROM h GROUP BY hash HAVING count(*) >= 2)),
    o AS (SELECT count(*) AS n FROM ({_ORPHANS})), t AS (SELECT count(*) AS n FROM part),
    g AS (SELECT count(*) AS n FROM documents WHERE len(string_split(text, chr(10))) > 100), c AS (SELECT count(*) AS n FROM reach WHERE a = b),
    r AS (SELECT o.n / greatest(t.n, 1) AS dead, d.n / greatest(t.n, 1) AS dup, g.n AS gods, c.n AS cycles FROM d, o, t, g, c)
    SELECT greatest(0.0, round(100.0 - (least(30.0, dup * 100) + least(30.0, dead * 100) + least(20.0, gods * 5.0) + least(20.0, cycles * 10.0)), 1))::DOUBLE AS score,
    round(dead, 3)::DOUBLE AS dead_code_ratio, round(dup, 3)::DOUBLE AS duplicate_ratio, gods AS god_file_count, cycles AS circular_count FROM r"""
)
def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = F.count("*").alias("n")
    docs = table(spark, sf_dir, "documents")
    dup = symbols.duplicate_groups(_hashes(spark, sf_dir), "hash", F.col("doc_id"), F.col("doc_id")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    gods = docs.filter(X.n_lines_scan(F.col("text")) > 100).agg(count)
    cycles = graph.cycle_members(_edges(spark, sf_dir)).agg(count)
    return scoring.health(table(spark, sf_dir, "part").agg(count), _orphans(spark, sf_dir).agg(count), dup, gods, cycles)


@query(
    """WITH u AS (SELECT l_partkey, count(*) AS n, max(l_quantity) AS q, bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY 1),
    a AS (SELECT p_partkey, least(30, coalesce(n, 0) * 1 * 6)::INTEGER AS inbound_refs, CASE WHEN r THEN 0 ELSE 20 END AS has_tests, CASE WHEN p_size * 10 <= 50 THEN 5 WHEN p_size * 10 <= 150 THEN 10 WHEN p_size * 10 <= 300 THEN 17 ELSE 25 END AS lines_changed, CASE WHEN q >= 50 THEN 25 ELSE 0 END AS is_circular FROM part LEFT JOIN u ON p_partkey = l_partkey),
    b AS (SELECT *, inbound_refs + has_tests + lines_changed + is_circular AS score FROM a)
    SELECT *, CASE WHEN score <= 30 THEN 'safe to fix' WHEN score <= 60 THEN 'fix with caution' ELSE 'manual review recommended' END AS recommendation FROM b"""
)
def risk_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"), F.max("l_quantity").alias("q"), F.bool_or(F.col("l_returnflag") == "R").alias("r"))
    rows = table(spark, sf_dir, "part").join(used, "p_partkey", "left")
    got = scoring.risk(rows, F.col("n"), F.coalesce("r", F.lit(False)), F.col("p_size") * 10, F.coalesce(F.col("q") >= 50, F.lit(False)))
    return got.select("p_partkey", "inbound_refs", "has_tests", "lines_changed", "is_circular", "score", "recommendation")


_CLASSES = (("steel", ("STEEL", "TIN")), ("brass", ("BRASS", "COPPER")), ("nickel", ("NICKEL",)), ("plated", ("PLATED", "POLISHED")))


@query(
    "WITH s AS (SELECT "
    + ", ".join("(coalesce(sum(CASE WHEN " + " OR ".join(f"contains(p_type, '{m}')" for m in ms) + f" THEN 1 ELSE 0 END), 0) / greatest(count(*), 1))::DOUBLE AS class_{k}" for k, (_, ms) in enumerate(_CLASSES))
    + " FROM part) SELECT *, CASE greatest(class_0, class_1, class_2, class_3) WHEN class_0 THEN 'steel' WHEN class_1 THEN 'brass' WHEN class_2 THEN 'nickel' ELSE 'plated' END AS winner FROM s"
)
def marker_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = scoring.marker_shares(table(spark, sf_dir, "part"), F.col("p_type"), _CLASSES)
    best = F.array_max(F.array(*[F.struct(F.col(f"class_{k}").alias("s"), F.lit(-k).alias("k"), F.lit(n).alias("n")) for k, (n, _) in enumerate(_CLASSES)]))
    return shares.withColumn("winner", best["n"])


@query("SELECT source AS module, min(doc_id) AS first_id FROM documents WHERE source NOT IN ('src1', 'src3') AND NOT starts_with(source, 'src2') GROUP BY source ORDER BY first_id LIMIT 20")
def top_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 distinct values by order: the limit is the feature."""
    docs = table(spark, sf_dir, "documents").filter(~F.col("source").isin("src1", "src3") & ~F.col("source").startswith("src2"))
    got = scoring.ordered_distinct(docs, F.col("source"), F.col("doc_id"))
    return got.select(F.col("value").alias("module"), F.col("first").alias("first_id")).orderBy("first_id").limit(20)


@query("SELECT event_id, user_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM events")
def history_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.deltas(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "value").select("event_id", "user_id", "value", "delta")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = history.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], F.struct("ts", "event_id"))
    return got.select("user_id", "event_type", "event_id", "value")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5")
def retain_last5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.retain(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id")


@query(
    """WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, value > 50 AS confirmed FROM events)
    SELECT user_id, event_id, n, CASE WHEN n >= 20 THEN 'blocked' WHEN NOT confirmed AND n > 0 AND n % 5 = 0 THEN 'checkpoint' ELSE 'allowed' END AS decision FROM a"""
)
def budget_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = history.gate_running(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.col("value") > 50)
    return got.select("user_id", "event_id", F.col("n").cast("long").alias("n"), "decision")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, value > 50 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    f AS (SELECT user_id, event_id, i, 0::BIGINT AS n, 'allowed' AS decision FROM e WHERE i = 1 UNION ALL
    SELECT e.user_id, e.event_id, e.i, f.n + (f.decision = 'allowed')::INT, CASE WHEN f.n + (f.decision = 'allowed')::INT >= 20 THEN 'blocked' WHEN NOT e.ok AND f.n + (f.decision = 'allowed')::INT > 0 AND (f.n + (f.decision = 'allowed')::INT) % 5 = 0 THEN 'checkpoint' ELSE 'allowed' END
    FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1) SELECT user_id, event_id, n, decision FROM f"""
)
def budget_gate_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("confirmed", F.col("value") > 50)
    return history.gate_exact(events, "user_id", "event_id", "confirmed")


@query(
    """WITH RECURSIVE e AS (SELECT user_id % 4 AS session, event_id, value > 50 AS ok, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS i FROM events),
    f AS (SELECT session, event_id, i, 0::BIGINT AS n, true AS went FROM e WHERE i = 1 UNION ALL
    SELECT e.session, e.event_id, e.i, f.n + f.went::INT, f.n + f.went::INT < 900 AND (e.ok OR f.n + f.went::INT = 0 OR (f.n + f.went::INT) % 7 <> 0) FROM f JOIN e ON e.session = f.session AND e.i = f.i + 1)
    SELECT session, event_id, n, CASE WHEN n >= 900 THEN 'blocked' WHEN went THEN 'allowed' ELSE 'checkpoint' END AS decision FROM f"""
)
def budget_gate_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact gate where four sessions hold all attempts, each of them in many tasks."""
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("session"), "event_id", (F.col("value") > 50).alias("confirmed"))
    return history.gate_exact(events, "session", "event_id", "confirmed", budget=900, confirm_every=7)


@query("SELECT event_id, (props->>'$.k')::INTEGER AS k FROM events")
def json_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))


@query(
    "SELECT item_id, (trim(text) <> '' AND "
    + " AND ".join(f"NOT contains(trim(text), '{c}')" for c in T.CHAINING)
    + " AND (starts_with(trim(text), 'The') OR starts_with(trim(text), 'In'))) AS allowed FROM benchmark"
)
def command_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", files.may_run(F.col("text"), ("The", "In")).alias("allowed"))


_WORDS = r"list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))"
#: Brute force: all pairs of classes of equal sets, and what they share.
_SIMILAR = f"""w AS (SELECT doc_id, list_sort({_WORDS}) AS s FROM documents WHERE text IS NOT NULL),
    m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS class_id, s FROM w WHERE len(s) > 0),
    e AS (SELECT class_id AS c, len(s) AS n, unnest(s) AS t FROM m WHERE doc_id = class_id),
    x AS (SELECT a.c AS first_id, b.c AS second_id, a.n AS na, b.n AS nb, count(*) AS shared FROM e a JOIN e b ON a.t = b.t AND a.c < b.c GROUP BY ALL),
    pairs AS (SELECT first_id, second_id, shared, shared / (na + nb - shared) AS score FROM x WHERE shared * 5 >= (na + nb - shared) * 4)"""


def _similar(spark: SparkSession, sf_dir: str) -> similar.Similar:
    plain = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return similar.similar_sets(table(spark, sf_dir, "documents"), F.col("doc_id"), F.regexp_extract_all(plain, F.lit(r"[^\x20\x09-\x0D]+"), 0))


@query(f"WITH {_SIMILAR} SELECT first_id, second_id, shared, score FROM pairs")
def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose sets of words share 0.8 of their union or more, by classes of equal sets."""
    return _similar(spark, sf_dir).pairs


@query(f"WITH {_SIMILAR}, ends AS (SELECT first_id AS c FROM pairs UNION ALL SELECT second_id FROM pairs) SELECT doc_id, class_id, (SELECT count(*) FROM ends WHERE c = class_id) AS links FROM m")
def similar_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that has words: its class, and how many other classes are similar to that."""
    return _similar(spark, sf_dir).counted().withColumnRenamed("id", "doc_id")
