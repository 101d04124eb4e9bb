"""Exact top-k inner products by a three-phase uniform threshold.

A score is the sum of LISTS local scores: the inner products over so many runs of the dimensions, each run a list of its
own that is held by other tasks. For every distinct query vector:
1. each list gives its best local scores; the objects met so are scored whole, and the k-th best of them is a floor that
   the answer does not fall below;
2. the floor is shared out into a cutoff for each list, at the same number of standard deviations from each list's mean.
   The cutoffs sum to the floor at most, so an object below every cutoff cannot be in the answer. Each list sends the
   entries that reach its cutoff; the k-th best sum of objects that all lists have sent, or of phase 1, is a higher floor;
3. an object that some lists have not sent has less than their cutoffs there; those that still reach the floor get their
   missing local scores. Whole scores decide.

Objects are distinct vectors with their first ids, so a vector that very many rows share is scored once, and ranks of rows
follow from those of vectors. Lists and queries meet block by block: a task has one list of one slice of the objects and
QUERY_BLOCK queries, however many there are.

Nulls and ties: rows with a null id, a null vector or a null or non-finite component take no part; vectors of different
length are as if filled with zeros, and an empty one scores 0; equal scores go to the smaller id. Rows that agree in id and
vector are one row; rows that agree in id alone are different ones, as queries too. Components of 2**26 / sqrt(dimensions)
or more, whose products double precision would round, are an error. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakefold.session import written

K, LISTS, SCALE, EVERY = 10, 2, 1024.0, 100
QUERY_BLOCK = 4096
SLICE_ROWS, LEAST_SLICES = 1 << 16, 16
CHUNK = 1 << 21  # local scores held at once
BLOB = "array<bigint>"


CELL = ("list", "slice", "block")


def whole_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """vec_id, v: the rows that take part, each once, components floor(scale * x)."""
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    good = df.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).where(fine).select(F.col(vec_id).cast("bigint").alias("vec_id"), x.alias("x"))
    most = F.lit(float(1 << 26)) / F.sqrt(F.greatest(F.size("x"), F.lit(1)).cast("double")) - 1
    exact = F.forall("x", lambda c: F.abs(scale * c) < most)
    numbers = F.when(exact, F.transform("x", lambda c: F.floor(scale * c).cast("bigint"))).otherwise(F.raise_error(F.lit("a component is too large for exact scores")).cast("array<bigint>"))
    return good.select("vec_id", numbers.alias("v")).distinct()


def _of_list(v: Column, number: int) -> Column:
    """The components of a list: every LISTS-th dimension."""
    return F.filter(v, lambda _, i: i % LISTS == number)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda s, x: s + x)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    lists = column.combine_chunks()
    size = lists.value_lengths().to_numpy()
    out = np.zeros((len(lists), width))
    out[np.repeat(np.arange(len(lists)), size), np.concatenate([np.zeros(0, dtype=np.int64), *(np.arange(n) for n in size)])] = lists.flatten().to_numpy()
    return out


def _scores(objects: pa.Table, queries: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Local scores (whole numbers in doubles) of some queries at a time with all objects of a cell."""
    width = max(1, *(int(t["part"].combine_chunks().value_lengths().to_numpy().max(initial=0)) for t in (objects, queries)))
    x, y = _matrix(objects["part"], width), _matrix(queries["part"], width)
    step = max(1, CHUNK // max(1, len(x)))
    for a in range(0, len(y), step):
        yield a, y[a : a + step] @ x.T


def _lists_of(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *values])))


ENTRIES = pa.schema([("list", pa.int32()), ("q", pa.int64()), ("objs", pa.list_(pa.int64())), ("scores", pa.list_(pa.int64()))])
ENTRIES_DDL = "list int, q bigint, objs array<bigint>, scores array<bigint>"
MOMENTS = pa.schema([*ENTRIES, ("n", pa.int64()), ("total", pa.float64()), ("squares", pa.float64())])
MOMENTS_DDL = f"{ENTRIES_DDL}, n bigint, total double, squares double"


def _best(k: int):
    """Phase 1 in a cell: the k best local scores of each query, and the sums for their mean and deviation."""

    def run(objects: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if objects.num_rows and queries.num_rows:
            ids, of = objects["obj"].to_numpy(), queries["q"].to_numpy()
            for a, s in _scores(objects, queries):
                top = np.argpartition(-s, k - 1, axis=1)[:, :k] if s.shape[1] > k else np.broadcast_to(np.arange(s.shape[1]), s.shape)
                found = np.take_along_axis(s, top, axis=1).astype(np.int64)
                columns = [np.full(len(s), queries["list"][0].as_py(), dtype=np.int32), of[a : a + len(s)], _lists_of(list(ids[top])), _lists_of(list(found)), np.full(len(s), s.shape[1]), s.sum(axis=1), (s**2).sum(axis=1)]
                out.append(pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=MOMENTS))
        return pa.Table.from_batches(out, schema=MOMENTS)

    return run


def _reaching(objects: pa.Table, queries: pa.Table) -> pa.Table:
    """Phase 2 in a cell: the entries that reach their query's cutoff."""
    out = []
    if objects.num_rows and queries.num_rows:
        ids, of, cut = objects["obj"].to_numpy(), queries["q"].to_numpy(), queries["cut"].to_numpy()
        for a, s in _scores(objects, queries):
            row, place = np.nonzero(s >= cut[a : a + len(s), None])
            edges = np.searchsorted(row, np.arange(1, len(s)))
            columns = [np.full(len(s), queries["list"][0].as_py(), dtype=np.int32), of[a : a + len(s)], _lists_of(np.split(ids[place], edges)), _lists_of(np.split(s[row, place].astype(np.int64), edges))]
            out.append(pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=ENTRIES))
    return pa.Table.from_batches(out, schema=ENTRIES)


def _single(entries: DataFrame) -> DataFrame:
    """list, q, obj, score"""
    return entries.select("list", "q", F.explode(F.arrays_zip("objs", "scores")).alias("e")).select("list", "q", F.col("e.objs").alias("obj"), F.col("e.scores").alias("score"))


def _first(df: DataFrame, by: tuple[str, ...], order: list[Column], k: int, name: str = "place") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def top_k(vectors: DataFrame, asked: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of asked (vec_id, v) the k rows of vectors with the highest inner product,
    other than itself. Both as whole_vectors() gives them; asked is part of vectors."""
    spark, more = vectors.sparkSession, k + 1  # a query's own row may be among the best
    firsts = _first(vectors, ("v",), [F.col("vec_id")], more).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    objects = written(firsts.select(F.monotonically_increasing_id().alias("obj"), F.col("ids")[0].alias("first"), "ids", "v"), "topk-objects")
    asked = written(asked.join(objects.select("v", F.col("obj").alias("q")), "v").select(F.col("vec_id").alias("query_id"), "q"), "topk-asked")
    queries = objects.join(asked.select(F.col("q").alias("obj")), "obj", "left_semi").select(F.col("obj").alias("q"), F.col("v").alias("w"))
    slices = max(LEAST_SLICES, -(-objects.count() // SLICE_ROWS))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    lists = lambda v: F.explode(F.array(*(F.struct(F.lit(i).alias("list"), _of_list(F.col(v), i).alias("part")) for i in range(LISTS)))).alias("l")
    held = objects.select("obj", F.pmod(F.xxhash64("obj"), F.lit(slices)).cast("int").alias("slice"), lists("v")).select("obj", "slice", "l.*", numbers(blocks).alias("block"))
    sent = queries.select("q", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"), lists("w")).select("q", "block", "l.*", numbers(slices).alias("slice"))

    # 1: local lists, and whole scores of what they name
    local = written(held.groupBy(*CELL).cogroup(sent.groupBy(*CELL)).applyInArrow(_best(more), MOMENTS_DDL), "topk-local")
    named = _first(_single(local), ("list", "q"), [F.desc("score"), F.col("obj")], more).select("q", "obj").distinct()
    whole = named.join(objects.select("obj", "v"), "obj").join(queries, "q").select("q", "obj", _dot(F.col("v"), F.col("w")).alias("score"))
    whole = written(whole, "topk-named")
    floors = _first(whole, ("q",), [F.desc("score")], more).where(F.col("place") == more).select("q", F.col("score").alias("floor"))
    mean = F.sum("total") / F.sum("n")
    moments = local.groupBy("q", "list").agg(mean.alias("m"), F.sqrt(F.greatest(F.lit(0.0), F.sum("squares") / F.sum("n") - mean * mean)).alias("d"))
    each = moments.groupBy("q").agg(*(F.max(F.when(F.col("list") == i, F.col(c))).alias(f"{c}{i}") for i in range(LISTS) for c in "md"))
    total = lambda c: sum(F.col(f"{c}{i}") for i in range(LISTS))
    gap = F.col("floor") - total("m")
    shared = [F.floor(F.col(f"m{i}") + F.when(total("d") > 0, gap * F.col(f"d{i}") / total("d")).otherwise(gap / LISTS)).cast("bigint") for i in range(LISTS - 1)]
    cuts = F.array(*shared, F.col("floor") - sum(shared))  # their sum is the floor
    nothing = F.array_repeat(F.lit(-(1 << 62)).cast("bigint"), LISTS)  # no floor: fewer than k + 1 objects
    cutoffs = written(each.join(floors, "q", "left").select("q", F.coalesce(F.when(F.col("floor").isNotNull(), cuts), nothing).alias("cuts")), "topk-cutoffs")

    # 2: entries that reach the cutoff
    told = sent.join(cutoffs, "q").withColumn("cut", F.element_at("cuts", F.col("list") + 1)).drop("cuts")
    entries = held.groupBy(*CELL).cogroup(told.groupBy(*CELL)).applyInArrow(_reaching, ENTRIES_DDL)
    sums = _single(entries).groupBy("q", "obj").agg(F.sum("score").alias("seen"), F.bit_or(F.element_at(F.array(*(F.lit(1 << i) for i in range(LISTS))), F.col("list") + 1)).alias("lists"))
    sums = written(sums, "topk-sums")
    complete = F.col("lists") == (1 << LISTS) - 1
    known = sums.where(complete).select("q", "obj", F.col("seen").alias("score")).unionByName(whole).distinct()
    floors = _first(known, ("q",), [F.desc("score")], more).where(F.col("place") == more).select("q", F.col("score").alias("floor"))

    # 3: what may still reach the floor
    absent = [F.col("lists").bitwiseAND(F.lit(1 << i)) == 0 for i in range(LISTS)]
    bound = sum((F.when(a, F.col("cuts")[i] - 1).otherwise(0) for i, a in enumerate(absent)), F.col("seen"))
    open_ = sums.where(~complete).join(cutoffs, "q").join(floors, "q", "left").where(F.coalesce(bound >= F.col("floor"), F.lit(True))).select("q", "obj", "seen", "lists")
    rest = sum((F.when(a, _dot(_of_list(F.col("v"), i), _of_list(F.col("w"), i))).otherwise(F.lit(0).cast("bigint")) for i, a in enumerate(absent)), F.col("seen"))
    resolved = open_.join(objects.select("obj", "v"), "obj").join(queries, "q").select("q", "obj", rest.alias("score"))
    scored = known.unionByName(resolved).distinct().join(objects.select("obj", "first", "ids"), "obj")
    best = _first(scored, ("q",), [F.desc("score"), F.col("first")], more)
    rows = _first(best.select("q", "obj", "score", F.explode("ids").alias("vec_id")), ("q",), [F.desc("score"), F.col("vec_id")], more, "row")
    own = (F.col("vec_id") == F.col("query_id")) & (F.col("obj") == F.col("q"))
    answers = _first(asked.join(rows, "q").where(~own), ("query_id", "q"), [F.desc("score"), F.col("vec_id")], k, "rank")
    return answers.select("query_id", "rank", "vec_id", "score")


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
