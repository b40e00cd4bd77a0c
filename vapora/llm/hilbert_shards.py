"""Shards along a Hilbert curve, in DataFrame functions alone.

Each metadata dimension is quantised to a few bits: a number by its binary logarithm, a name by its MD5. A document's
cell is the index of its quantised point on the Hilbert curve. Sorted by cell, then by a hash of the id and the id
itself, the documents are cut into runs of equal row counts, so that a shard holds neighbouring values of every
dimension and a reader can skip files by any of them.

Law: rows. A document's global position is the number of rows in lower bins (cell and two hex digits of the id's hash)
plus its row number in its own bin, so no task sorts more than a bin, and a hot source is dealt over 256 bins a cell.

Cases: a null dimension quantises to 0; a null text has size 16 and the CRC of no bytes; a null doc_id takes part like
any other value; rows of one doc_id are ordered by their other columns, and repeated rows take neighbouring slots; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vapora.llm import common

BITS = 4
SHARDS = 40


def quantise_number(c: Column, bits: int = BITS) -> Column:
    """Binary logarithm of a number, below 2 ** bits."""
    top = (1 << bits) - 1
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(top), F.length(F.bin(c.cast("long"))) - 1)), F.lit(0)).cast("int")


def quantise_name(c: Column, bits: int = BITS) -> Column:
    """The first bits of a name's MD5."""
    return F.coalesce(F.shiftright(F.conv(F.substring(F.md5(c), 1, 2), 16, 10).cast("int"), 8 - bits), F.lit(0)).cast("int")


def hilbert_index(dims: Sequence[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of a point with coordinates below 2 ** bits, after Skilling's transform.

    A fold over the bit levels carries the rotated coordinates, so the expression's size doesn't depend on bits.
    """
    n = len(dims)
    point = lambda xs: F.struct(*(x.cast("int").alias(f"x{i}") for i, x in enumerate(xs)))

    def level(acc: Column, q: Column) -> Column:
        p, x = q - 1, [acc[f"x{i}"] for i in range(n)]
        for i in range(n):
            hit, swap = x[i].bitwiseAND(q) > 0, x[0].bitwiseXOR(x[i]).bitwiseAND(p)
            moved = F.when(hit, x[0].bitwiseXOR(p)).otherwise(x[0].bitwiseXOR(swap))
            if i:
                x[i] = F.when(hit, x[i]).otherwise(x[i].bitwiseXOR(swap))
            x[0] = moved
        return point(x)

    def gray(acc: Column) -> Column:
        x = [acc["x0"]]
        for i in range(1, n):
            x.append(acc[f"x{i}"].bitwiseXOR(x[-1]))
        return point(x)

    def index(acc: Column) -> Column:
        flips = F.lit(0)
        for b in range(bits - 1, 0, -1):
            flips = flips.bitwiseXOR(F.when(acc[f"x{n - 1}"].bitwiseAND(F.lit(1 << b)) > 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
        return common.bind(flips, lambda f: sum((F.when(acc[f"x{i}"].bitwiseXOR(f).bitwiseAND(F.lit(1 << b)) > 0, F.lit(1 << (b * n + n - 1 - i))).otherwise(F.lit(0)) for b in range(bits) for i in range(n)), F.lit(0)))

    turned = F.aggregate(F.array(*(F.lit(1 << b) for b in range(bits - 1, 0, -1))), point(dims), level)
    return common.bind(turned, lambda t: common.bind(gray(t), index))


def hilbert_shards(df: DataFrame, dims: Sequence[Column], shards: int, bits: int = BITS) -> DataFrame:
    """df (doc_id and other columns) with shard and slot."""
    spark = df.sparkSession
    binned = df.withColumn("h", hilbert_index(dims, bits)).withColumn("sub", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 2))
    counts = common.materialize(binned.groupBy("h", "sub").count(), "hilbert-bins")
    cells = counts.groupBy("h").agg(F.sum("count").alias("cell_rows"))
    # At most 2 ** (bits * dims) cells, a fixed number, whatever the input.
    cells = cells.select("h", (F.sum("cell_rows").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, 0)) - F.col("cell_rows")).alias("before_cell"))
    bins = counts.join(F.broadcast(cells), "h").select("h", "sub", (F.col("before_cell") + F.sum("count").over(Window.partitionBy("h").orderBy("sub").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("before"))
    total = counts.agg(F.sum("count")).first()[0] or 0
    # Rows of one id are ordered too, so that a task that runs again numbers them alike.
    rank = F.row_number().over(Window.partitionBy("h", "sub").orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))))
    # The window has dealt the rows by bin already, so this join shuffles the bins alone.
    placed = binned.withColumn("rank", rank - 1).join(bins, ["h", "sub"])
    position = F.col("before") + F.col("rank")
    placed = placed.withColumn("position", position.cast("long")).withColumn("shard", F.expr(f"cast(position * {shards} div {max(total, 1)} as int)"))
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return placed.withColumn("slot", (F.col("position") - first).cast("long")).drop("h", "sub", "before", "rank", "position")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in curve order."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.id_and_text(common.documents(spark, sf_dir), "lang", "source")
    sized = docs.select("doc_id", "lang", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"))
    placed = hilbert_shards(sized, [quantise_number(F.col("size")), quantise_name(F.col("lang")), quantise_name(F.col("source"))], SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _steps(dims: int, bits: int) -> list[tuple[str, str]]:
    """The transform unrolled as SQL steps (name, expression) over x0.., for the oracle."""
    steps: list[tuple[str, str]] = []
    now = [f"x{i}" for i in range(dims)]

    def put(i: int, sql: str) -> None:
        steps.append((f"v{len(steps)}", sql))
        now[i] = steps[-1][0]

    for b in range(bits - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        for i in range(dims):
            a, first = now[i], now[0]
            swap = f"(xor({first}, {a}) & {p})"
            put(0, f"CASE WHEN {a} & {q} > 0 THEN xor({first}, {p}) ELSE xor({first}, {swap}) END")
            if i:
                put(i, f"CASE WHEN {a} & {q} > 0 THEN {a} ELSE xor({a}, {swap}) END")
    for i in range(1, dims):
        put(i, f"xor({now[i]}, {now[i - 1]})")
    flips = "0"
    for b in range(bits - 1, 0, -1):
        flips = f"xor({flips}, CASE WHEN {now[-1]} & {1 << b} > 0 THEN {(1 << b) - 1} ELSE 0 END)"
    h = " + ".join(f"(CASE WHEN xor({now[i]}, flips) & {1 << b} > 0 THEN {1 << (b * dims + dims - 1 - i)} ELSE 0 END)" for b in range(bits) for i in range(dims))
    return [*steps, ("flips", flips), ("h", h)]


def oracle_sql() -> str:
    nest = "SELECT doc_id, size, text_crc32, least(15, length(bin(size)) - 1)::INT AS x0, {} AS x1, {} AS x2 FROM t".format(*(f"coalesce(('0x' || substr(md5({c}), 1, 1))::INT, 0)" for c in ("lang", "source")))
    for name, sql in _steps(3, BITS):
        nest = f"SELECT *, {sql} AS {name} FROM ({nest})"
    return f"""
WITH table_of AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS crc FROM range(256) r(n)),
t AS (
  SELECT doc_id, lang, source, coalesce(strlen(text), 0) + 16 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: ('0x' || b)::BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM documents, table_of),
c AS ({nest}),
p AS (SELECT *, row_number() OVER (ORDER BY h, substr(md5(doc_id::VARCHAR), 1, 2), doc_id) - 1 AS position, count(*) OVER () AS n FROM c),
s AS (SELECT *, (position * {SHARDS}) // n AS shard FROM p)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INT AS shard, (position - (shard * n + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard FROM s
"""


ORACLE_SQL = oracle_sql()
