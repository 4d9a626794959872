"""Similar but not identical bodies: an exact join of token sets by their Jaccard similarity.

Equal sets are one class before anything is compared. Tokens are numbered from the rarest up; two sets
that are similar enough share one of their rarest few, so only these prefixes are indexed, a shorter one
of the smaller set. Lengths and the place of the first shared token rule out most pairs where they meet,
so that few are moved, and so do sketches where a token is common. Short sets are verified there and then,
others as whole sets afterwards: a set is sent to a block of pairs, not to each of its pairs. Short sets that
differ in rare tokens alone are one kind: kinds are compared, and their pairs come of a plain join of blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_body
from ..session import stored
from .ranking import ranked

#: Identifiers, numbers and single marks of source text (fixed value).
TOKEN = r"[A-Za-z_][A-Za-z_0-9]*|[0-9]+|[^\sA-Za-z_0-9]"


#: Sets of up to so many tokens are indexed whole; index rows of a token beyond which they are dealt to blocks;
#: tokens before a shared one that tell whether it is the first.
SHORT, CROWD, BEFORE = 32, 2000, 4
#: Words of a sketch; rows of a token beyond which it is sent along; sets of a family that are one bin.
WORDS, COMMON, BIN = 8, 32, 512
#: Tokens beyond which a sketch of so many bits says little, and words of the one that is then looked at, too.
LARGE, WIDE = 96 * WORDS, 64


def body_tokens(body: Column) -> Column:
    """The distinct tokens of a body without its comments."""
    return F.array_distinct(F.regexp_extract_all(normal_body(body), F.lit(TOKEN), 0))


@dataclass
class Kinds:
    """Short sets by kind: members (class_id, kind, own, bits) with the rare tokens that are a set's own, and units (x, i, y,
    j, na, nb, shared): the members of block i of kind x and of block j of kind y that have no rare token in common are
    similar. Pairs that have one are met at it, and are not in here."""

    members: DataFrame
    units: DataFrame

    def pairs(self, named: DataFrame | None = None) -> DataFrame:
        """(a, b, na, nb, shared), with a_id and b_id by `named` (class_id, id)."""
        members = self.members if named is None else self.members.join(named, "class_id")
        kept = ["id"] if named is not None else []
        parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        keys = ["x", "i", "y", "j"]

        def side(end: str, kind: str, block: str, *told: str) -> DataFrame:
            own = members.select(F.col("kind").alias(kind), F.col("block").alias(block), F.col("class_id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("own", "bits", *kept)])
            return self.units.select(*keys, *told).join(own, [kind, block]).repartition(parts, *keys)

        both = side("a", "x", "i", "na", "nb", "shared").join(side("b", "y", "j").hint("merge"), keys)
        apart = (F.col("a_bits").bitwiseAND(F.col("b_bits")) == 0) | ~F.arrays_overlap("a_own", "b_own")
        both = both.filter(((F.col("x") != F.col("y")) | (F.col("i") != F.col("j")) | (F.col("a") < F.col("b"))) & apart)
        return both.select("a", "b", "na", "nb", "shared", *[f"{end}_{c}" for end in ("a", "b") for c in kept])


@dataclass
class Similar:
    """pairs (first_id, second_id, shared, score) between classes, and members (id, class_id); both are made
    of links (a, b, na, nb, shared) between numbers of classes, named (digest, number, class_id) and rows (id, digest).
    Links are those met one by one and those of whole kinds."""

    met: DataFrame
    kinds: Kinds
    named: DataFrame
    rows: DataFrame

    @property
    def links(self) -> DataFrame:
        return self.met.union(self.kinds.pairs())

    @property
    def pairs(self) -> DataFrame:
        a, b = (self.named.select(F.col("number").alias(k), F.col("class_id").alias(f"{k}_id")) for k in ("a", "b"))
        score = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
        told = self.met.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "shared", "a_id", "b_id")
        told = told.union(self.kinds.pairs(self.named.select(F.col("number").alias("class_id"), F.col("class_id").alias("id"))))
        return told.select(F.least("a_id", "b_id").alias("first_id"), F.greatest("a_id", "b_id").alias("second_id"), F.col("shared").cast("long").alias("shared"), score.alias("score"))

    @property
    def members(self) -> DataFrame:
        return self.rows.join(self.named, "digest").select("id", "class_id")

    def counted(self) -> DataFrame:
        """(id, class_id, links): each member's class, and how many other classes are similar to it. Links
        of classes of one name add up; the classes of an id follow each other in order."""
        ends = self.links.select(F.explode(F.array("a", "b")).alias("number")).groupBy("number").agg(F.count("*").alias("links"))
        by_class = self.named.join(ends, "number").groupBy("class_id").agg(F.sum("links").alias("links"))
        told = self.members.join(by_class, "class_id", "left").select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
        return told.repartition("id").sortWithinPartitions("id", "class_id")


def numbered(rows: DataFrame) -> DataFrame:
    """(row, tokens, n, sketch, once, rare) of (row, tokens): strings give way to whole numbers, ascending
    from the rarest token to the commonest; those up to `once` are in one row, those up to `rare` in
    COMMON at most. A sketch has the parity of how many tokens fall on each of its bits, so two sets
    differ in as many tokens as their sketches in bits, or more."""
    each = rows.select("row", F.explode("tokens").alias("token"))
    order = ranked(each.groupBy("token").agg(F.count("*").alias("n")), [], ["n", "token"], "number")
    order = stored(order.select("token", F.col("number").cast("int").alias("number"), F.col("n").alias("f")), "order")
    once, rare = order.agg(F.count_if(F.col("f") == 1), F.count_if(F.col("f") <= COMMON)).first()
    bit = F.pmod(F.xxhash64("number"), F.lit(64 * WORDS))
    words = [F.bit_xor(F.when(F.floor(bit / 64) == w, F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(number), {64 * WORDS}) % 64 AS INT))")).otherwise(F.lit(0))) for w in range(WORDS)]
    sets = each.join(order.drop("f"), "token").groupBy("row").agg(F.sort_array(F.collect_list("number")).alias("tokens"), F.array(*words).alias("sketch"))
    return sets.select("row", "tokens", F.size("tokens").alias("n"), "sketch", F.lit(once).alias("once"), F.lit(rare).alias("rare"))


def _meet(sets: DataFrame, smaller: Column, greater: Column, num: int, den: int, *carried: str, only: Column | None = None) -> DataFrame:
    """Pairs of index rows (class_id, n, at, token and what is `carried`, each _x or _y), x of the smaller
    sets and y of the greater, whose lengths and place of a first shared token do not rule them out. `only`
    tells at which tokens they meet; of a set of n, `tokens` may leave out some that come before all others.

    Similar sets of n <= m tokens share `need` = (n + m) * num / (num + den) or more. Before the first
    that they share, x leaves out at - 1 and may leave out n - need, and y likewise; need is 2 * n *
    num / (num + den) at least for x and m * num / den for y (as n is m * num / den at least). So of x
    and y only tokens up to these places are indexed, and of a pair, only up to its own need counts.
    """
    n, out = F.col("n"), F.col("n") - F.size("tokens")
    before = F.slice("tokens", F.greatest(F.col("at") - BEFORE, F.lit(1)), F.least(F.col("at") - 1, F.lit(BEFORE)))

    def index(which: Column, least: Column) -> DataFrame:
        prefix = F.slice("tokens", F.lit(1), F.greatest(n - F.ceil(least) + 1 - out, F.lit(0)).cast("int"))
        kept = [c for c in carried if c not in ("past", "tokens", "sketch")]
        rows = sets.filter(which).select("class_id", "n", "tokens", "sketch", "once", "rare", *kept, F.posexplode(prefix).alias("at", "token")).withColumn("at", F.col("at") + 1 + out)
        rows = rows.filter((F.col("token") > F.col("once")) & (F.lit(True) if only is None else only)).withColumn("sketch", F.when(F.col("token") > F.col("rare"), F.col("sketch")))
        return rows.withColumn("past", before).select("class_id", "n", "at", "token", *carried)

    x, y = index(smaller, 2 * n * num / (num + den)), index(greater, n * num / den)
    # of a token that many of the greater sets hold, these are dealt to blocks, and each block gets all smaller ones
    hot = F.broadcast(y.groupBy("token").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("blocks")).filter("blocks > 1"))
    blocks = F.coalesce("blocks", F.lit(1))
    x = x.join(hot, "token", "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")
    y = y.join(hot, "token", "left").withColumn("block", F.pmod(F.xxhash64("class_id"), blocks).cast("int")).drop("blocks")
    # a small index may make many pairs, so it is dealt out as it is: adaptive execution would put it together
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x, y = (i.repartition(parts, "token", "block").select("token", "block", *[F.col(c).alias(f"{c}_{k}") for c in ("class_id", "n", "at", *carried)]) for k, i in (("x", x), ("y", y)))
    both = x.join(y, ["token", "block"])
    both = both.filter((F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("class_id_x") < F.col("class_id_y"))))
    most = 1 + F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    return both.filter((F.col("n_x") * den >= F.col("n_y") * num) & (most * (num + den) >= (F.col("n_x") + F.col("n_y")) * num))


def _near(x: str, y: str, num: int, den: int) -> Column:
    """Whether sketches leave it open that sets are similar, as these differ in at most (n + m) * (den - num)
    / (num + den) tokens."""
    bits = sum((F.bit_count(F.col(f"sketch_{x}")[w].bitwiseXOR(F.col(f"sketch_{y}")[w])) for w in range(WORDS)), F.lit(0))
    return bits * (num + den) <= (F.col(f"n_{x}") + F.col(f"n_{y}")) * (den - num)


def _nearer(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of those pairs (a, b, n_a, n_b) of large sets that sketches of WIDE words leave open. On 512 bits any two
    sets differ in some 256, which rules out nothing where similar ones may differ in as many tokens."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).distinct()
    large = sets.filter(F.col("n") > LARGE).join(ends, "class_id", "left_semi")
    each = large.select("class_id", F.explode("tokens").alias("number")).select("class_id", F.pmod(F.xxhash64("number"), F.lit(64 * WIDE)).alias("bit"))
    each = each.select("class_id", F.floor(F.col("bit") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, CAST(bit % 64 AS INT))").alias("bits"))
    each = each.union(large.select("class_id", F.explode(F.sequence(F.lit(0), F.lit(WIDE - 1))), F.lit(0).cast("long")))  # so that none lacks a word
    words = each.groupBy("class_id", "word").agg(F.bit_xor("bits").alias("bits"))
    wide = stored(words.groupBy("class_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("wide")), "wide")
    a, b = (wide.select(F.col("class_id").alias(k), F.col("wide").alias(f"wide_{k}")) for k in ("a", "b"))
    bits = F.aggregate(F.zip_with("wide_a", "wide_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, n: t + n)
    return pairs.join(a, "a").join(b, "b").filter(bits * (num + den) <= (F.col("n_a") + F.col("n_b")) * (den - num)).select("a", "b")


def _verified(met: DataFrame, num: int, den: int, *carried: str) -> DataFrame:
    """(a, b, na, nb, shared, and what is `carried`) of pairs that met at their first shared token and share enough."""
    shared = F.array_intersect("tokens_x", "tokens_y")  # in the order of the first, so from the rarest on
    # a filter and the columns after it would each intersect again, so a list of one is filtered and taken apart
    enough = lambda b: (F.element_at(b, 1) == F.col("token")) & (F.size(b) * (num + den) >= (F.col("n_x") + F.col("n_y")) * num)
    rows = met.select(F.col("class_id_x").alias("a"), F.col("class_id_y").alias("b"), F.col("n_x").alias("na"), F.col("n_y").alias("nb"), *carried, F.explode(F.filter(F.array(shared), enough)).alias("both"))
    return rows.select("a", "b", "na", "nb", F.size("both").alias("shared"), *carried)


def _kinds(sets: DataFrame, num: int, den: int) -> tuple[DataFrame, Kinds]:
    """Links (a, b, na, nb, shared) of short sets that have no token of COMMON rows or fewer in common: those between
    kinds of one set each, and all others by kind. A kind is what has the same size and the same commoner tokens, so
    what two of its sets share, or two of a pair of kinds, is the same for all of them."""
    own = F.filter("tokens", lambda t: (t > F.col("once")) & (t <= F.col("rare")))
    parts = sets.filter(F.col("n") <= SHORT).select("class_id", "n", "once", "rare", own.alias("own"), F.filter("tokens", lambda t: t > F.col("rare")).alias("tokens"))
    parts = parts.filter((F.size("tokens") > 0) & (F.size("tokens") * den >= F.col("n") * num))  # others share too little by these alone
    kinds = stored(parts.groupBy("n", "once", "rare", "tokens").agg(F.min("class_id").alias("class_id"), F.count("*").alias("m"), F.min("own").alias("own")), "kinds")
    several = F.col("m") > 1
    of = kinds.filter(several).select("n", "tokens", F.col("class_id").alias("kind"), "m")
    members = parts.join(of, ["n", "tokens"]).select("class_id", "kind", "m", "own").union(kinds.filter(~several).select("class_id", "class_id", "m", "own"))
    bits = F.aggregate("own", F.lit(0).cast("long"), lambda b, t: b.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(t, F.lit(64)))))
    blocks = lambda m: F.ceil(F.col(m) / CROWD).cast("int")
    members = stored(members.select("class_id", "kind", "own", bits.alias("bits"), F.pmod(F.xxhash64("class_id"), blocks("m")).cast("int").alias("block")), "members")
    met = _meet(kinds.withColumn("sketch", F.lit(None).cast("array<long>")), F.lit(True), F.lit(True), num, den, "tokens", "m", "own")
    same = kinds.filter(several & (F.size("tokens") * (num + den) >= 2 * F.col("n") * num))
    same = same.select(F.col("class_id").alias("a"), F.col("class_id").alias("b"), F.col("n").alias("na"), F.col("n").alias("nb"), F.size("tokens").alias("shared"), F.col("m").alias("m_x"), F.col("m").alias("m_y"), F.col("own").alias("own_x"), F.col("own").alias("own_y"))
    both = stored(_verified(met, num, den, "m_x", "m_y", "own_x", "own_y").union(same), "kind-links")
    single = (F.col("m_x") == 1) & (F.col("m_y") == 1)
    units = both.filter(~single).select(F.col("a").alias("x"), F.col("b").alias("y"), "na", "nb", "shared", "m_y", F.explode(F.sequence(F.lit(0), blocks("m_x") - 1)).alias("i"))
    units = units.select("x", "i", "y", F.explode(F.sequence(F.lit(0), blocks("m_y") - 1)).alias("j"), "na", "nb", "shared").filter((F.col("x") != F.col("y")) | (F.col("i") <= F.col("j")))
    return both.filter(single & ~F.arrays_overlap("own_x", "own_y")).select("a", "b", "na", "nb", "shared"), Kinds(members, units)


def linked(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, na, nb, shared): similar sets of (class_id, tokens, n), the smaller first."""
    met, kinds = _linked(sets, num, den)
    return met.union(kinds.pairs())


def _linked(sets: DataFrame, num: int, den: int) -> tuple[DataFrame, Kinds]:
    """Links that are met one by one, and those of whole kinds."""
    n, least_n, enough = F.col("n"), F.least("n_a", "n_b"), lambda shared, x, y: shared * (num + den) >= (F.col(x) + F.col(y)) * num
    short = _verified(_meet(sets, n <= SHORT, n <= SHORT, num, den, "tokens", only=F.col("token") <= F.col("rare")), num, den)
    single, kinds = _kinds(sets, num, den)
    # a token just before on both sides was met itself, so this is not the first
    long = _meet(sets, n * den >= (SHORT + 1) * num, n > SHORT, num, den, "past", "sketch")
    long = long.filter(F.col("sketch_x").isNull() | _near("x", "y", num, den)).filter(~F.arrays_overlap("past_x", "past_y"))
    pairs = long.select(F.col("class_id_x").alias("a"), F.col("class_id_y").alias("b")).distinct()
    a, b = (sets.select(F.col("class_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}")) for k in ("a", "b"))
    near = stored(pairs.join(a, "a").join(b, "b").filter(_near("a", "b", num, den)).select("a", "b", "n_a", "n_b"), "near")  # those that met at a rare token
    pairs = near.filter(least_n <= LARGE).select("a", "b").union(_nearer(near.filter(least_n > LARGE), sets, num, den))
    return short.union(single).union(_whole(pairs, sets).filter(enough(F.col("shared"), "na", "nb"))), kinds


def _differences(x: Column, y: Column) -> Column:
    return F.concat(F.array_except(x, y), F.array_except(y, x))


def _whole(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, shared) of pairs (a, b), by whole sets. Near copies of one text are near each other, so
    sets are put together by the least partner's least partner, in bins of some BIN, and what two bins have to do
    with each other is one group: a set goes to its groups, however many pairs it has there. What goes there is
    how it differs from its family's set, as two sets differ in what one of these lists has and the other has
    not; between families, one side's lists are turned into differences from the other family's set."""
    pairs = stored(pairs, "pairs")
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("id"))
    least = stored(ends.groupBy("id").agg(F.min(F.least("a", "b")).alias("family")), "least")
    families = stored(least.join(least.select(F.col("id").alias("family"), F.col("family").alias("first")), "family").select("id", F.col("first").alias("family")), "families")
    sizes = families.groupBy("family").agg(F.ceil(F.count("*") / BIN).alias("bins"))
    bins = families.join(sizes, "family").select("id", "family", F.pmod(F.xxhash64("id"), "bins").alias("bin"))
    of = {k: bins.select(F.col("id").alias(k), F.col("family").alias(f"family_{k}"), F.col("bin").alias(f"bin_{k}")) for k in ("a", "b")}
    group = ["family_a", "bin_a", "family_b", "bin_b"]
    groups = stored(pairs.join(of["a"], "a").join(of["b"], "b").select("a", "b", *group), "groups")
    # the sets that pairs need, each moved to its family once
    whole = sets.select(F.col("class_id").alias("id"), "n", "tokens").join(families, "id")
    heads = sets.select(F.col("class_id").alias("family"), F.col("tokens").alias("head"))
    heads = stored(heads.join(families.select("family").distinct(), "family", "left_semi"), "heads")
    told = stored(whole.join(heads, "family").select("id", "n", _differences(F.col("tokens"), F.col("head")).alias("delta")), "differences")
    apart = stored(groups.filter("family_a <> family_b").select("family_a", "family_b").distinct(), "apart")
    between = apart.join(heads.select(F.col("family").alias("family_a"), F.col("head").alias("head_a")), "family_a").join(heads.select(F.col("family").alias("family_b"), F.col("head").alias("head_b")), "family_b")
    between = between.select("family_a", "family_b", F.lit(True).alias("turned"), _differences(F.col("head_a"), F.col("head_b")).alias("between"))
    turned = F.col("family_a") != F.col("family_b")
    needed = groups.select(*group, F.explode(F.array(F.struct(F.col("a").alias("id"), turned.alias("turned")), F.struct(F.col("b").alias("id"), F.lit(False).alias("turned")))).alias("end"))
    needed = needed.select(*group, "end.*").distinct().join(told, "id").join(stored(between, "between"), ["family_a", "family_b", "turned"], "left")
    delta = F.when(F.col("between").isNull(), F.col("delta")).otherwise(_differences(F.col("delta"), F.col("between")))
    held = needed.select(*group, "id", F.struct("n", delta.alias("delta")).alias("set"))
    held = held.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("id", "set"))).alias("held"))
    told = groups.groupBy(*group).agg(F.collect_list(F.struct("a", "b")).alias("pairs")).join(held, group)

    def shared(p: Column) -> Column:
        a, b = F.element_at("held", p["a"]), F.element_at("held", p["b"])
        differ = F.size(a["delta"]) + F.size(b["delta"]) - 2 * F.size(F.array_intersect(a["delta"], b["delta"]))
        return F.struct(p["a"].alias("a"), p["b"].alias("b"), a["n"].alias("na"), b["n"].alias("nb"), F.floor((a["n"] + b["n"] - differ) / 2).cast("int").alias("shared"))

    return told.select(F.inline(F.transform("pairs", shared)))


def similar_sets(rows: DataFrame, id: Column, tokens: Column, num: int = 4, den: int = 5) -> Similar:
    """Sets of tokens whose intersection is num/den of their union or more, without exception.

    Null and repeated tokens do not count; rows without tokens (or with a null id) are similar to
    nothing and in no class. Rows of equal sets are one class, named by its least id, so copies are
    never paired; an id of several rows may name several classes; sets of different tokens are paired however many there are of them.
    """
    distinct = F.sort_array(F.array_distinct(F.filter(tokens, lambda t: t.isNotNull())))
    base = rows.select(id.alias("id"), distinct.alias("tokens")).filter((F.size("tokens") > 0) & F.col("id").isNotNull())
    text = F.array_join(F.transform("tokens", lambda t: F.concat(F.char_length(t).cast("string"), F.lit(":"), t)), "")
    # classes are told apart by the number of their first row until the end, as ids may be wide
    base = stored(base.select("id", F.unhex(F.sha2(text, 256)).alias("digest"), F.monotonically_increasing_id().alias("row"), "tokens"), "sets")
    heads = base.groupBy("digest").agg(F.min(F.struct("id", "row")).alias("h"))
    named = stored(heads.select("digest", F.col("h.row").alias("number"), F.col("h.id").alias("class_id")), "classes")
    sets = numbered(base.select("row", "tokens")).join(named.select(F.col("number").alias("row")), "row", "left_semi")
    sets = stored(sets.withColumnRenamed("row", "class_id"), "numbered")
    return Similar(*_linked(sets, num, den), named, base.select("id", "digest"))


def similar_functions(parsed: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """(first, second, score) of parsed files: functions (file, name, line) with similar but different
    bodies, by their tokens; of functions with equal token sets the first stands for all."""
    rows = parsed.filter("error is null").select("file", F.explode("functions").alias("f"))
    where = F.struct("file", F.col("f.start_line").alias("line"), F.col("f.name").alias("name"))
    return similar_sets(rows, where, body_tokens(F.col("f.body")), num, den).pairs.select(F.col("first_id").alias("first"), F.col("second_id").alias("second"), "score")
