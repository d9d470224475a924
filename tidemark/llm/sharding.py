"""Shards along a Hilbert curve over several columns, with DataFrame functions only.

Each dimension is cut into bins that hold about equally many rows (from counts over all rows), a row's bins give its place
on the curve, and the rows in the order of the curve are cut into runs whose lengths differ by one at most. Neighbours on
the curve are neighbours in every dimension, so a file covers a small box and a filter on any of the columns skips most
files. Rows are range-partitioned on (curve, digest of the text, id, place in the input): no two rows have the same key, so
a value, cell or group of copies with a third of all rows is spread over many tasks, and equal texts with equal bins lie side
by side. A row's rank is its place in its partition plus the rows of the partitions before; only these counts meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, own_path, settled, table

#: Bits of each dimension on the curve.
BITS = 5
#: Distinct values of a dimension that are counted at most; text is shortened until it has no more.
VALUES = 1 << 16
#: Characters that text dimensions are shortened to, the longest first that leaves `VALUES` values at most.
LENGTHS = (64, 16, 8, 4, 2, 1)


def hilbert_states(n: int) -> tuple[list[int], list[int]]:
    """Digit and next state for each state and each corner of an n-cube (at state * 2**n + corner).

    A state is the entry corner and the direction of a sub-cube (Hamilton, 2006): the corner is turned into the sub-cube's
    own frame, its place in the Gray code is the digit, and the digit says how the next sub-cube lies.
    """
    full = (1 << n) - 1
    turn = lambda x, k: ((x << k % n) | (x >> (n - k % n))) & full

    def entry(w: int) -> int:
        k = 2 * ((w - 1) // 2) if w else 0
        return k ^ (k >> 1)

    def direction(w: int) -> int:
        k = w if w % 2 else w - 1
        return (~k & (k + 1)).bit_length() - 1 if w else 0

    digits, following = [], []
    for state in range(n << n):
        e, d = state % (1 << n), state >> n
        for corner in range(1 << n):
            own = turn(corner ^ e, n - (d + 1) % n)
            w = reduce(lambda x, k: x ^ (own >> k), range(1, n), own)
            digits.append(w)
            following.append((e ^ turn(entry(w), d + 1)) + ((d + direction(w) % n + 1) % n << n))
    return digits, following


def curve_index(bins: list[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of a point whose coordinates have `bits` bits each."""
    n = len(bins)
    digits, following = (F.array(*[F.lit(x) for x in xs]) for xs in hilbert_states(n))
    corner = lambda i: reduce(lambda a, b: a + b, [F.shiftleft(F.shiftright(b, i).bitwiseAND(F.lit(1)), j) for j, b in enumerate(bins)])
    corners = F.array(*[corner(i).cast("int") for i in reversed(range(bits))])
    start = F.struct(F.lit(0).cast("long").alias("place"), F.lit(0).alias("state"))

    def step(at: Column, c: Column) -> Column:
        k = at["state"] * (1 << n) + c
        return F.struct((at["place"] * (1 << n) + F.get(digits, k)).alias("place"), F.get(following, k).alias("state"))

    return F.aggregate(corners, start, step)["place"]


def size_class(size: Column) -> Column:
    """A number of at least 1 on a scale with 1,024 steps an octave, in integers."""
    octave = F.length(F.bin(size)) - 1
    return F.call_function("shiftright", F.shiftleft(size.cast("long"), 10), octave) + octave * 1024


def binned(rows: DataFrame, values: list[Column], bits: int = BITS) -> list[Column]:
    """For each value an expression of its bin: values keep their order, and bins hold about equally many rows of `rows`.

    All rows are counted; the counts of a dimension are `VALUES` rows or so at most, and only its cuts (2**bits at most)
    reach the driver. A null counts as the empty text or as 0.
    """
    kinds = rows.select(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    texts = [i for i, (_, kind) in enumerate(kinds.dtypes) if kind == "string"]
    values = [F.coalesce(v, F.lit("") if i in texts else F.lit(0)) for i, v in enumerate(values)]
    if texts:
        distinct = rows.agg(*[F.approx_count_distinct(F.substring(values[i], 1, k)).alias(f"n{i}_{k}") for i in texts for k in LENGTHS]).first()
        for i in texts:
            values[i] = F.substring(values[i], 1, next((k for k in LENGTHS if distinct[f"n{i}_{k}"] <= VALUES * 3 // 4), LENGTHS[-1]))
    return [_bin(rows, v, bits) for v in values]


def _bin(rows: DataFrame, value: Column, bits: int) -> Column:
    counts = rows.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)  # one row a counted value, bounded by VALUES
    middle = counts.select("v", (2 * F.sum("n").over(upto) - F.col("n")).alias("at"), F.sum("n").over(Window.partitionBy()).alias("all"))
    number = F.expr(f"(at * {1 << bits}) div (2 * all)")
    cuts = [tuple(r) for r in middle.groupBy(number.alias("bin")).agg(F.min("v").alias("v")).orderBy("bin").collect()]
    steps = [F.when(value >= F.lit(v), b - cuts[i][0]).otherwise(0) for i, (b, v) in enumerate(cuts[1:])]
    return reduce(lambda a, b: a + b, steps, F.lit(cuts[0][0] if cuts else 0)).cast("int")


def write_shards(docs: DataFrame, path: str, dimensions: list[Column], shards: int = 16, doc_id: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """Writes `docs` to Parquet files in `path`/shard=0 to shard=`shards`-1 and returns them: document (a struct of all
    columns of `docs`, whatever their names), curve, slot (place in the shard from 0) and shard. Numbers of rows differ by one
    at most; with fewer rows than shards some stay empty; without rows nothing is written and the result is empty.

    dimensions: text or whole numbers. Rows are ordered by curve, digest of the text, id (null first) and place in the
    input, so repeated rows are told apart; a null text counts as empty.
    """
    spark = docs.sparkSession
    parts = "document struct<" + ", ".join(f"`{f.name.replace('`', '``')}`:{f.dataType.simpleString()}" for f in docs.schema) + ">, curve long, slot long, shard int"
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[d.alias(f"_d{i}") for i, d in enumerate(dimensions)], "*")
    rows = rows.toDF(*[f"_d{i}" for i in range(len(dimensions))], *names)
    own, body = F.col(names[docs.columns.index(doc_id)]), F.coalesce(F.col(names[docs.columns.index(text)]).cast("string"), F.lit(""))
    curve = curve_index(binned(rows, [F.col(f"_d{i}") for i in range(len(dimensions))], bits), bits)
    placed = rows.select(curve.alias("_curve"), F.unhex(F.md5(body)).alias("_digest"), own.alias("_id"), F.monotonically_increasing_id().alias("_at"), *names)
    key = ["_curve", "_digest", "_id", "_at"]
    # The upper bits of the new number are the partition, the lower 33 the place in it.
    run = placed.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_place", F.monotonically_increasing_id()).drop("_digest", "_id", "_at")
    sorted_path = own_path(spark, "curve")
    run.write.option("compression", "zstd").parquet(sorted_path)
    ordered = spark.read.schema(run.schema).parquet(sorted_path).withColumn("_part", F.shiftright("_place", 33))
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    before = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"), F.sum("n").over(Window.partitionBy()).alias("_all"))
    ranked = ordered.join(F.broadcast(before), "_part").withColumn("_rank", F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
    shard = F.expr(f"(_rank * {shards}) div _all")
    first = F.expr(f"(shard * _all + {shards - 1}) div {shards}")
    document = F.struct(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
    out = ranked.withColumn("shard", shard.cast("int")).select(document.alias("document"), F.col("_curve").alias("curve"), (F.col("_rank") - first).cast("long").alias("slot"), "shard")
    out.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    discard(spark, sorted_path)
    return spark.read.schema(parts).parquet(path)


def op12_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard files over language, source and size, read back."""
    docs = table(spark, sf_dir, "documents")
    size = lambda text: (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")

    def built() -> DataFrame:
        files = write_shards(docs, own_path(spark, "shards"), [F.col("lang"), F.col("source"), size_class(size(F.col("text")))])
        body = F.col("document.text")
        crc = F.crc32(F.coalesce(body, F.lit("")))
        return files.select("document.doc_id", size(body).alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")

    return settled(spark, built, "sharded")
