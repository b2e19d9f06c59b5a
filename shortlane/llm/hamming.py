"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are 64 bits, bit i set where component i of the vector is positive.  A code is cut
into m segments (m by the number of codes), and each segment value points to the codes that have it.  At radius r
a query probes, in every segment, all values at Hamming distance exactly r from its own.
After radius r every code within distance m (r + 1) - 1 has been met (pigeonhole), so a query whose
k-th verified distance is at most that is settled; the others go on to r + 1, where codes
farther than the k-th found so far are not candidates.

Equal codes share one index row with their k smallest ids, which is exact because
ties go to the smaller id: thousands of copies of a vector cost one row.  A candidate is
verified only in the first of its closest segments, so rounds never repeat it.

Defined cases: null or empty vectors have no code: they are not found and as queries find
nothing; a null, NaN or non-positive component gives a 0 bit; vectors of more than 64 components
are an error, missing ones are 0; ids may repeat (each row counts); fewer than k rows give
fewer results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _spark

BITS = 64
K = 10


def segments_for(n: int) -> int:
    """Segments of about log2(n) bits, so that a value of one has few of n codes; at most 22, so that the flips of a probe stay few."""
    return 8 if n < 1 << 12 else 4 if n < 1 << 24 else 3


def cuts(segments: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment; the first ones are longer if they cannot be equal."""
    bits = [BITS // segments + (s < BITS % segments) for s in range(segments)]
    return [(sum(bits[:s]), n) for s, n in enumerate(bits)]


def code_of(vector: Column) -> Column:
    """The sign bits of up to 64 components, as a long."""
    bits = F.transform(F.slice(vector, 1, BITS), lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long")))
    long = F.size(vector) > BITS
    return F.when(long, F.raise_error(F.lit(f"a code has {BITS} bits, and a vector has more components")).cast("long")).when(F.size(vector) > 0, F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


def segment(code: Column, cut: tuple[int, int]) -> Column:
    first, bits = cut
    return F.shiftrightunsigned(code, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def values(code: Column, parts: list[tuple[int, int]]) -> Column:
    """(s, v, all): each segment's number, its value in the code, and the number of values that it can have."""
    return F.array(*(F.struct(F.lit(s).alias("s"), segment(code, c).alias("v"), F.lit(1 << c[1]).cast("long").alias("all")) for s, c in enumerate(parts)))


def exact_top_k(base: DataFrame, queries: DataFrame, k: int = K, segments: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, distance: the k nearest rows of base (id, code) for each row of queries (id, code), ties by id."""
    spark = base.sparkSession
    base = base.where("code IS NOT NULL")
    nearest = Window.partitionBy("code").orderBy("id")
    few = base.withColumn("_r", F.row_number().over(nearest)).where(F.col("_r") <= k)
    codes = _spark.cut(few.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "mih-codes")
    segments = segments or segments_for(codes.count())
    parts = cuts(segments)
    width = parts[0][1]
    index = _spark.cut(codes.select("code", "ids", F.explode(values(F.col("code"), parts)).alias("p")).select("p.s", "p.v", "code", "ids"), "mih-index")
    # equal query codes are searched once
    asked = queries.where("code IS NOT NULL").select(F.col("id").alias("query_id"), "code")
    open_ = _spark.cut(asked.select(F.col("code").alias("q")).distinct().withColumn("bound", F.lit(BITS)), "mih-open")
    found = None
    for r in range(width + 1):
        masks = [sum(1 << b for b in bits) for bits in combinations(range(width), r)]
        flips = spark.range(len(masks)).select(F.element_at(F.lit(masks), (F.col("id") + 1).cast("int")).cast("long").alias("flip"))
        places = open_.select("q", "bound", F.explode(values(F.col("q"), parts)).alias("p"))
        probes = places.crossJoin(F.broadcast(flips)).where(F.col("flip") < F.col("p.all")).select("q", "bound", F.col("p.s").alias("s"), F.col("p.v").bitwiseXOR(F.col("flip")).alias("v"))  # at most 2**width flips for each stated query
        met = probes.join(index, ["s", "v"])
        apart = [F.bit_count(segment(F.col("q").bitwiseXOR(F.col("code")), c)) for c in parts]
        first = F.coalesce(*(F.when(a == F.least(*apart), F.lit(s)) for s, a in enumerate(apart)))
        distance = F.bit_count(F.col("q").bitwiseXOR(F.col("code")))
        met = met.where((first == F.col("s")) & (distance <= F.col("bound"))).select("q", distance.alias("distance"), "code", F.explode("ids").alias("vec_id"))
        pool = met if found is None else met.unionByName(found)
        order = Window.partitionBy("q").orderBy("distance", "vec_id")
        found = _spark.cut(pool.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "distance", "code", "vec_id"), f"mih-found-{r}")
        state = found.groupBy("q").agg(F.count("*").alias("n"), F.max("distance").alias("kth"))
        full, covered = F.coalesce(F.col("n") >= k, F.lit(False)), F.col("kth") <= segments * (r + 1) - 1
        bound = F.when(full, F.col("kth")).otherwise(BITS)  # what is farther than k found codes cannot enter
        open_ = _spark.cut(open_.select("q").join(state, "q", "left").where(~(full & covered)).select("q", bound.alias("bound")), f"mih-open-{r}")
        if open_.isEmpty():
            break
    order = Window.partitionBy("q").orderBy("distance", "vec_id")
    best = found.withColumn("rank", F.row_number().over(order))
    return asked.join(best, asked["code"] == best["q"]).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("distance").cast("int").alias("distance"))


def op4_exact_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = _spark.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), code_of(F.col("embedding")).alias("code"))
    return exact_top_k(vectors, vectors.where("id % 100 = 0"))


OP4_SQL = """
WITH coded AS (
  SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN coalesce(embedding[i] > 0 AND NOT isnan(embedding[i]), false) THEN (1::HUGEINT << (i - 1)::HUGEINT) ELSE 0::HUGEINT END))::HUGEINT AS code
  FROM embeddings WHERE len(embedding) > 0
), ranked AS (
  SELECT q.vec_id AS query_id, b.vec_id AS vec_id, bit_count(xor(q.code, b.code))::INTEGER AS distance,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY bit_count(xor(q.code, b.code)), b.vec_id)::INTEGER AS rank
  FROM coded q, coded b WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""
