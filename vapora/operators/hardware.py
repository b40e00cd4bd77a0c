"""Hardware gate: how many dimensions a rig carries, and how many a model needs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from vapora.functions import arrays as A
from vapora.plans import views


def effective_dims(n: Column) -> Column:
    """Dimensions of n channels of one family: half of n up to 2.5 at five and more, at least a half."""
    return F.when(n <= 1, 0.5).when(n >= 5, 2.5).otherwise(n / F.lit(2.0))


def implied_channels(n_features: Column) -> Column:
    """Channels c with 28 c + c (c - 1) / 2 + 4 features; NULL where no count fits."""
    n = n_features.cast("long")
    c = F.floor((F.sqrt((F.lit(3025) + 4 * (2 * n - 8)).cast("double")) - 55) / 2).cast("long")
    c = F.when(n >= 32, c)
    return F.when((c >= 1) & (28 * c + F.floor(c * (c - 1) / 2) + 4 == n), c)


def required_dims(stored: Column, n_features: Column, n_classes: Column) -> Column:
    """A model's stored need, else that of its training rig, else log2 of its classes between 1 and 4, else 1."""
    implied = implied_channels(n_features)
    return F.coalesce(stored, F.when(implied.isNotNull(), effective_dims(implied)), F.least(F.lit(4.0), F.greatest(F.lit(1.0), F.log2(n_classes))), F.lit(1.0))


def rig_gate(rigs: DataFrame) -> DataFrame:
    """rigs (n_channels, stored_dims, n_features, n_classes) with available and required dims and a warning; the gate warns and never blocks."""
    r = rigs.withColumns({"available": effective_dims(F.col("n_channels")), "required": required_dims(F.col("stored_dims"), F.col("n_features"), F.col("n_classes"))})
    return r.withColumn("sufficient", F.lit(True)).withColumn("warning", F.when(F.col("available") < F.col("required"), F.format_string("%d channel(s) carry about %.2f dimensions; the model needs about %.2f", F.col("n_channels").cast("int"), "available", "required")))


#: Rows of vectors that are factored at once, factors that a task of the tree joins, keys that a task holds before it sends their factors on.
BLOCK, FAN, HELD = 1024, 8, 16
_FACTOR = "part long, r array<array<double>>"


def _triangle(rows: np.ndarray) -> np.ndarray:
    """The R of a QR factorisation: as many rows as the vectors are long, at most."""
    return np.linalg.qr(rows, mode="r")


def singular_values(vectors: DataFrame, column: str = "vector", *keys: str) -> DataFrame:
    """keys, n and values: the singular values of each key's vectors about their mean, the largest first.

    A tall matrix is factored in a tree: each task turns its vectors into a triangle, tasks of the next level join FAN triangles to
    one, and the last task of a key takes the values of what is left. Nothing of the vectors' length squared reaches the driver, and
    no product of the matrix with itself, which squares its condition, is made. A missing component is its mean; shorter vectors
    miss their ends; NULL vectors don't count.
    """
    keys = list(keys)
    v = vectors.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("array<double>").alias("v"))
    places = v.select(*keys, F.posexplode("v").alias("i", "x")).groupBy(*keys, "i").agg(F.coalesce(F.avg("x"), F.lit(0.0)).alias("m"))
    means = places.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("s")).select(*keys, F.col("s.m").alias("mean"))
    both = v.join(means, keys) if keys else v.crossJoin(means)  # of one row
    centred = both.select(*keys, F.transform("mean", lambda m, i: F.coalesce(F.get("v", i) - m, F.lit(0.0))).alias("v"))
    kinds = dict(centred.dtypes)
    named = "".join(f"`{k}` {kinds[k]}, " for k in keys)

    def batch(found: list[tuple[tuple, int, np.ndarray]], schema: pa.Schema) -> pa.RecordBatch:
        columns = [*([f[0][k] for f in found] for k in range(len(keys))), [f[1] for f in found], [f[2].tolist() for f in found]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    schema = to_arrow_schema(vectors.sparkSession.createDataFrame([], named + _FACTOR).schema)
    tasks = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def first(batches):
        task = TaskContext.get().partitionId()
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            rows = b.to_pydict()
            by: dict[tuple, list] = {}
            for n, key in enumerate(zip(*(rows[k] for k in keys)) if keys else [()] * b.num_rows):
                by.setdefault(key, []).append(rows["v"][n])
            for key, some in by.items():
                for lo in range(0, len(some), BLOCK):
                    block = np.array(some[lo : lo + BLOCK], float)
                    held[key] = _triangle(np.vstack([held[key], block]) if key in held else block)
                if len(held) > HELD:
                    yield batch([(k, task, r) for k, r in held.items()], schema)
                    held = {}
        if held:
            yield batch([(k, task, r) for k, r in held.items()], schema)

    def join(table: pa.Table) -> pa.Table:
        r = None
        for some in table.column("r").to_pylist():
            rows = np.array(some, float)
            r = rows if r is None else _triangle(np.vstack([r, rows]))
        head = table.slice(0, 1)
        return head.select([*keys, "part"]).append_column("r", pa.array([_triangle(r).tolist()], schema.field("r").type))

    level = centred.mapInArrow(first, named + _FACTOR)
    parts = tasks * 64
    while parts > 1:
        parts = -(-parts // FAN)
        level = level.withColumn("part", F.pmod(F.col("part"), F.lit(parts))).groupBy(*keys, "part").applyInArrow(lambda t: join(t), named + _FACTOR)

    def values(batches):
        for b in batches:
            s = [np.linalg.svd(np.array(r, float), compute_uv=False).tolist() for r in b.column("r").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(s, pa.list_(pa.float64()))], names=[*keys, "values"])

    found = level.select(*keys, "r").mapInArrow(values, named + "values array<double>")
    counts = v.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.join(found, keys) if keys else counts.crossJoin(found)


def effective_ranks(vectors: DataFrame, column: str = "vector", *keys: str, share: float = 0.95) -> DataFrame:
    """keys, n and rank: the singular directions that hold the share of the energy; 1 for under two vectors and for equal ones."""
    s = singular_values(vectors, column, *keys)
    energy = F.transform("values", lambda x: x * x)
    total = F.aggregate(energy, F.lit(0.0), lambda a, x: a + x)
    running = F.aggregate(energy, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("k")), lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["k"] + F.when(a["sum"] < F.lit(share) * total, 1).otherwise(0)).alias("k")))
    return s.select(*keys, "n", F.when((F.col("n") < 2) | (total <= 0), 1.0).otherwise(running["k"].cast("double")).alias("rank"))


def effective_rank(vectors: DataFrame, column: str = "vector", share: float = 0.95) -> float:
    """effective_ranks() of all vectors as a number; 1 where there is none."""
    row = effective_ranks(vectors, column, share=share).first()
    return row["rank"] if row else 1.0


def _q_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings by label: their energy, and the rank of vectors made of label % 5 + 1 of their components, each three times."""
    e = views.table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    energy = singular_values(e, "v", "label").select("label", "n", F.aggregate("values", F.lit(0.0), lambda a, x: a + x * x).alias("energy"))
    few = e.select("label", F.expr("transform(sequence(0, 3 * (label % 5 + 1) - 1), i -> v[cast(i div 3 AS int)] * (i % 3 + 1))").alias("v"))
    ranks = effective_ranks(few, "v", "label", share=1 - 1e-12)
    return energy.join(ranks.select("label", "rank"), "label").selectExpr("label", "n", f"{A.snap('energy', 6)} AS energy", "rank")


def _q_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size % 8 AS n_channels", "cast(NULL AS double) AS stored_dims", "CASE WHEN p_partkey % 3 = 0 THEN cast(p_partkey % 420 AS int) END AS n_features", "cast(p_partkey % 40 + 1 AS int) AS n_classes")
    out = rig_gate(rows).withColumn("implied", implied_channels(F.col("n_features")))
    return out.selectExpr("p_partkey", "implied", "available", f"{A.snap('required', 6)} AS required", "warning IS NOT NULL AS warned")



QUERIES = {"hardware_gate": _q_gate, "effective_ranks": _q_ranks}

ORACLE_SQL = {
    "effective_ranks": f"""WITH e AS (SELECT label, vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), g AS (SELECT label, i, count(*) AS n, var_pop(x) * count(*) AS s FROM e GROUP BY label, i)
SELECT label, any_value(n) AS n, {A.snap('sum(s)', 6)} AS energy, (label % 5 + 1)::DOUBLE AS rank FROM g GROUP BY label""",
    "hardware_gate": f"""WITH p AS (SELECT p_partkey, p_size % 8 AS n, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 420 END AS nf, p_partkey % 40 + 1 AS nc FROM part),
c(c) AS (SELECT unnest(range(1, 30))), i AS (SELECT p.*, c.c AS implied FROM p LEFT JOIN c ON nf = 28 * c.c + c.c * (c.c - 1) // 2 + 4),
d AS (SELECT *, CASE WHEN n <= 1 THEN 0.5 WHEN n = 2 THEN 1 WHEN n = 3 THEN 1.5 WHEN n = 4 THEN 2 ELSE 2.5 END::DOUBLE AS available, CASE WHEN implied IS NULL THEN least(4, greatest(1, log2(nc))) WHEN implied <= 1 THEN 0.5 WHEN implied = 2 THEN 1 WHEN implied = 3 THEN 1.5 WHEN implied = 4 THEN 2 ELSE 2.5 END::DOUBLE AS required FROM i)
SELECT p_partkey, implied, available, {A.snap('required', 6)} AS required, available < required AS warned FROM d""",
}
