"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows fall into local partitions by a keyed hash. How many rows of each
partition go to each shard is drawn, exactly, from the multivariate
hypergeometric law: it is the law of these counts under a uniform random
permutation of all rows. Then each partition permutes its rows by a keyed hash
and deals them out by its row of the matrix, rows are exchanged, and each shard
permutes what it got. Only DataFrame functions are used.

No step ranks a whole shard in one task: the second permutation ranks rows
within slices of the key space and adds the sizes of earlier slices. The key is
salted with a row's place in the input, so that copies of a row are dealt out like
all others. No row holds all partitions: the matrix is drawn for groups of
partitions first, then within each group.

Defined results. Null text: size 1, checksum 0. Null doc_id: a key like others.
Repeated rows: each is dealt out on its own. Empty table: no rows. Columns that
clash with working names: only doc_id and text are read.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakline.llm.common import unit, written

def _bound(value, body):
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: ln of the error of Stirling's formula for 0 to 15; beyond, its series is exact to 1e-15.
_STIRLING = [0.0, *[math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) for n in range(1, 16)]]


def _log_binomial(x, n, p, q):
    """ln of the chance of x of n at rate p, q = 1 - p; by saddle points, so that it is exact however large n is."""
    deltas = F.array(*[F.lit(v) for v in _STIRLING])
    stirling = lambda m: F.when(m < 16, F.get(deltas, m.cast("int"))).otherwise((1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * m * m)) / (m * m)) / (m * m)) / m)

    def deviance(pair):
        """x ln(x / m) + m - x, by its series where x is near m."""
        x, m = pair["x"], pair["m"]
        v = (x - m) / (x + m)
        terms = sum((2 * x * F.pow(v, F.lit(2.0 * j + 1)) / (2 * j + 1) for j in range(1, 9)), (x - m) * v)
        return F.when(F.abs(x - m) < 0.1 * (x + m), terms).otherwise(x * F.log(x / m) + m - x)

    pair = lambda a, m: F.struct(a.alias("x"), m.alias("m"))
    off = F.transform(F.array(pair(x, n * p), pair(n - x, n * q)), deviance)
    errors = F.transform(F.array(n, x, n - x), stirling)
    inside = _bound(off, lambda o: _bound(errors, lambda e: e[0] - e[1] - e[2] - o[0] - o[1])) - 0.5 * F.log(2 * math.pi * x * (n - x) / n)
    return F.when(n == 0, 0.0).when(x == 0, n * F.log(q)).when(x == n, n * F.log(p)).otherwise(inside)


def hypergeometric(total, good, drawn, u):
    """Number of good ones among `drawn` of `total`, by inversion of u outward from the mode.

    Steps alternate up and down from the mode. The number of steps covers
    nine standard deviations on both sides or the whole support; mass beyond
    that is under the spacing of u.
    """

    def with_range(v):
        low, high = F.greatest(F.lit(0).cast("long"), v["d"] - (v["n"] - v["k"])), F.least(v["k"], v["d"])
        mode = F.floor((v["d"] + 1).cast("double") * (v["k"] + 1) / (v["n"] + 2)).cast("long")
        n, k, d = (v[x].cast("double") for x in "nkd")
        spread = F.sqrt(d * k / F.greatest(n, F.lit(1.0)) * (n - k) / F.greatest(n, F.lit(1.0)))
        return _bound(F.struct(low.alias("lo"), high.alias("hi"), mode.alias("m"), F.ceil(9 * spread + 30).cast("long").alias("s")), lambda w: with_mode(v, w))

    def with_mode(v, w):
        mode = F.least(w["hi"], F.greatest(w["lo"], w["m"]))
        n, k, d = (v[x].cast("double") for x in "nkd")
        one = lambda x, size: F.struct(x.cast("double").alias("x"), size.cast("double").alias("n"), (d / n).alias("p"), ((n - d) / n).alias("q"))
        logs = F.transform(F.array(one(mode, k), one(d - mode, n - k), one(d, n)), lambda b: _log_binomial(b["x"], b["n"], b["p"], b["q"]))
        chance = F.when(w["lo"] >= w["hi"], 1.0).otherwise(_bound(logs, lambda g: F.exp(g[0] + g[1] - g[2])))
        fixed = F.struct(*[v[x].alias(x) for x in "nkdu"], w["lo"].alias("lo"), w["hi"].alias("hi"), mode.alias("m"), chance.alias("p"), F.least(w["hi"] - w["lo"], w["s"]).alias("s"))
        return _bound(fixed, walk)

    def walk(v):
        n, k, d = (v[x].cast("double") for x in "nkd")
        begin = F.struct((v["u"] - v["p"]).alias("left"), v["m"].alias("up"), v["p"].alias("pu"), v["m"].alias("down"), v["p"].alias("pd"), F.when(v["u"] < v["p"], v["m"]).alias("got"))

        def step(a, _):
            x, y = a["up"].cast("double"), a["down"].cast("double")
            pu = F.when(a["up"] < v["hi"], a["pu"] * (k - x) * (d - x) / ((x + 1) * (n - k - d + x + 1))).otherwise(0.0)
            pd = F.when(a["down"] > v["lo"], a["pd"] * y * (n - k - d + y) / ((k - y + 1) * (d - y + 1))).otherwise(0.0)

            def moved(p):
                up, down = F.least(a["up"] + 1, v["hi"]), F.greatest(a["down"] - 1, v["lo"])
                got = F.when(a["got"].isNotNull(), a["got"]).when(a["left"] < p["u"], up).when(a["left"] < p["u"] + p["d"], down)
                return F.struct((a["left"] - p["u"] - p["d"]).alias("left"), up.alias("up"), p["u"].alias("pu"), down.alias("down"), p["d"].alias("pd"), got.alias("got"))

            return _bound(F.struct(pu.alias("u"), pd.alias("d")), moved)

        return F.aggregate(F.sequence(F.lit(0).cast("long"), v["s"]), begin, step, lambda a: F.coalesce(a["got"], v["m"]))

    return _bound(F.struct(total.alias("n"), good.alias("k"), drawn.alias("d"), u.alias("u")), with_range)


@functools.cache
def _shared(seed: int, _gateway) -> F.Column:
    """Of a node (pairs, want, rest, level): what its left half gets of each shard. Built once: it has many parts."""

    def share(acc, pair):
        x = hypergeometric(acc["n"], pair["g"], acc["d"], unit(seed, F.col("level"), pair["id"], pair["j"]))
        return F.struct((acc["n"] - pair["g"]).alias("n"), (acc["d"] - x).alias("d"), F.concat(acc["out"], F.array(x)).alias("out"))

    start = F.struct((F.col("want") + F.col("rest")).alias("n"), F.col("want").alias("d"), F.array().cast("array<long>").alias("out"))
    return F.aggregate("pairs", start, share, lambda a: a["out"])


_SIZE = "aggregate({0}, cast(0 as long), (a, x) -> a + x.n)"


def _halved(nodes: DataFrame, most: int, seed: int) -> DataFrame:
    """(part, n, gets) of nodes (parts, gets) of up to `most` parts: a node's two halves share what it gets by draws.

    Nodes of a level are rows, so that the draws of a level are independent of each other and run in parallel.
    """
    for level in range(max(0, (most - 1).bit_length())):
        nodes = nodes.selectExpr("gets", "slice(parts, 1, cast(ceil(size(parts) / 2) as int)) as left", "slice(parts, cast(ceil(size(parts) / 2) as int) + 1, size(parts)) as right")
        nodes = nodes.selectExpr("*", f"{_SIZE.format('left')} as want", f"{_SIZE.format('right')} as rest", f"{level} as level", "get(left, 0).part as id")
        nodes = nodes.selectExpr("*", "transform(gets, (g, j) -> struct(g, j, id)) as pairs").withColumn("mine", _shared(seed, id(nodes.sparkSession._jvm)))
        both = "inline(array(struct(left as parts, mine as gets), struct(right as parts, zip_with(gets, mine, (g, x) -> g - x) as gets)))"
        nodes = nodes.selectExpr(both).where("size(parts) > 0")
        if level % 3 == 2:  # keeps plans short and spreads the nodes of wide levels
            nodes = written(nodes.repartition(1 << min(level, 8)) if level > 2 else nodes, "matrix")
    return nodes.selectExpr("inline(parts)", "gets")


GROUP = 1024


def communication_matrix(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """(part, n) -> (part, gets: rows to each shard), with shard sizes at most one apart.

    The matrix is drawn by halving: a node holds a range of partitions and what each shard takes from it; its two
    halves share that by hypergeometric draws. Beyond GROUP partitions, groups of them are drawn first.
    """
    most = counts.agg(F.count("*").alias("n"), F.max("part").alias("last")).first()
    if not most["n"]:
        return counts.selectExpr("part", "array(n) as gets")
    grouped = most["last"] >= GROUP
    by = counts.selectExpr(f"part div {GROUP} as part", "n").groupBy("part").agg(F.sum("n").alias("n")) if grouped else counts
    nodes = by.groupBy().agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("parts"))
    total = F.expr(_SIZE.format("parts"))
    nodes = nodes.select("parts", total.alias("total")).selectExpr("parts", f"transform(sequence(0, {shards - 1}), j -> cast(floor((total + {shards - 1} - j) / {shards}) as long)) as gets")
    drawn = _halved(nodes, most["last"] // GROUP + 1 if grouped else most["n"], seed)
    if grouped:
        drawn = written(drawn, "groups").selectExpr("part as grp", "gets")
        members = counts.selectExpr(f"part div {GROUP} as grp", "part", "n").groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("parts"))
        drawn = _halved(members.join(drawn, "grp").select("parts", "gets"), GROUP, seed + 1)
    return drawn.select("part", "gets")


def shuffled_shards(docs: DataFrame, shards: int = 8, seed: int = 17, rows_per_part: int = 20_000, least_parts: int = 256) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of docs, in a uniform random order.

    Shard sizes differ by at most one row; slots count from 0 without gaps.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    slim = slim.withColumn("u", F.xxhash64(F.lit(seed), "doc_id", "size", "text_crc32", F.monotonically_increasing_id()))
    slim = written(slim, "rows")  # the places are fixed here
    n = slim.count()
    parts = max(least_parts, -(-n // rows_per_part))
    slim = slim.withColumn("part", F.pmod("u", F.lit(parts)).cast("int"))
    matrix = written(communication_matrix(written(slim.groupBy("part").agg(F.count("*").alias("n")), "counts"), shards, seed), "matrix")

    # local permutation, then the row of the matrix deals it out
    local = F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed + 1), "u"), "doc_id")) - 1
    dealt = slim.withColumn("local", local).join(matrix, "part")
    ends = F.aggregate("gets", F.array().cast("array<long>"), lambda a, g: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long")) + g)))
    dealt = dealt.withColumn("ends", F.when(F.size("gets") > 0, ends))
    dealt = dealt.withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("local"))).cast("int"))

    # second permutation: rank within slices of the key space, plus the sizes of the slices before
    slices = max(least_parts // 8, -(-n // (shards * rows_per_part)))
    dealt = dealt.withColumn("v", unit(seed + 2, "u", "local")).withColumn("slice", F.floor(F.col("v") * slices).cast("int"))
    dealt = written(dealt.select("doc_id", "size", "text_crc32", "shard", "slice", "v", "local", "part"), "dealt")
    before = dealt.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("shard", "slice", F.coalesce("before", F.lit(0)).cast("long").alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("v", "part", "local")) - 1
    ranked = dealt.withColumn("rank", rank.cast("long")).join(before, ["shard", "slice"])
    return ranked.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank")).alias("slot"))


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shuffled_shards(docs.select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
