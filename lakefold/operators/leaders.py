"""Leader clustering in an order, by rounds: the result of the sequential rule without a sequence.

A record joins the first earlier leader that it is like, else it leads. Whether a record leads is settled once all earlier
records that it is like are: so each round settles every record whose earlier neighbours are settled, over all the data.

Records are like one another through classes (an equal name, an equal picture) and links between classes, so records that
many share a class with are never paired: a class has one leader at most, and a round needs its leader and its first open
record only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakefold.functions import arrays as A
from lakefold.operators.names import similar_values
from lakefold.operators.similarity import blocked_pairs
from lakefold.session import written

BLOCK_VECTORS = 4096


def leaders(members: DataFrame, links: DataFrame) -> DataFrame:
    """row_id, leader. members: row_id, class (a record's classes; records of a class are like one another). links: class,
    other (a record of class is like the records of other). Ends when no record is open; each round settles the first one
    at least."""
    members = written(members.select("row_id", "class").distinct(), "leader-members")
    own = members.select("class", F.col("class").alias("other"))
    links = written(links.select("class", "other").unionByName(own).distinct(), "leader-links")
    state = written(members.select("row_id", F.lit(None).cast("boolean").alias("leads")).distinct(), "leader-state")
    while True:
        # of each class: its leader, and its first open record; then the least of these over linked classes
        within = members.join(state, "row_id").groupBy("class").agg(F.min(F.when(F.col("leads"), F.col("row_id"))).alias("led"), F.min(F.when(F.col("leads").isNull(), F.col("row_id"))).alias("open"))
        around = links.join(within.withColumnRenamed("class", "other"), "other").groupBy("class").agg(F.min("led").alias("led"), F.min("open").alias("open"))
        seen = members.join(around, "class").groupBy("row_id").agg(F.min("led").alias("led"), F.min("open").alias("open"))
        joins, first = F.col("led") < F.col("row_id"), F.coalesce(F.col("open") >= F.col("row_id"), F.lit(True))
        settled = F.when(F.col("leads").isNotNull(), F.col("leads")).when(joins, False).when(first, True)
        new = written(state.join(seen, "row_id").select("row_id", settled.alias("leads"), "led"), "leader-state")
        if not new.where("leads IS NULL").limit(1).count():
            break
        state = new.select("row_id", "leads")
    # a leader of the last round may come before the one seen then
    within = members.join(new.where("leads").select("row_id"), "row_id").groupBy(F.col("class").alias("other")).agg(F.min("row_id").alias("led"))
    least = members.join(links.join(within, "other").groupBy("class").agg(F.min("led").alias("led")), "class").groupBy("row_id").agg(F.min("led").alias("led"))
    return new.select("row_id", "leads").join(least, "row_id", "left").select("row_id", F.when(F.col("leads"), F.col("row_id")).otherwise(F.col("led")).alias("leader"))


def close_vectors(vectors: DataFrame, group: str, least: float, block: int = BLOCK_VECTORS) -> DataFrame:
    """a, b: of the vectors (first, group, v: unit vectors of one length) of equal group, those with an inner product of
    least or more, either way round."""

    def close(x: pa.Table, y: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left, right = (np.asarray(t["v"].combine_chunks().flatten(), dtype=np.float64).reshape(t.num_rows, -1) for t in (x, y))
        for at in range(0, len(left), 512):
            i, j = np.nonzero(left[at : at + 512] @ right.T >= least)
            yield i + at, j

    found = blocked_pairs(vectors.select(F.col("first").alias("id"), F.col(group).alias("group"), "v"), close, block)
    return found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))


def cluster(df: DataFrame, row_id: str, name: str, exact: str, least: float = 0.9, vector: str | None = None, least_cosine: float = 0.92) -> DataFrame:
    """row_id, cluster (its first record): in order of row_id a record joins the first leader of the same exact column
    with a name similarity of least or a cosine of least_cosine or more, else it leads. A null name is an empty one; null
    and zero vectors are like none; ids are distinct."""
    rows = df.select(F.col(row_id).alias("row_id"), F.coalesce(name, F.lit("")).alias("name"), F.col(exact).alias("exact"), *([A.unit(F.col(vector).cast("array<double>")).alias("v")] if vector else []))
    rows = written(rows, "leader-rows")
    named = lambda n: F.to_json(F.struct(F.lit("name").alias("k"), F.col("exact").alias("e"), F.col(n).alias("n")))
    members = rows.select("row_id", named("name").alias("class"))
    names = rows.select("name", "exact").distinct()
    pairs = similar_values(names.select("name").distinct(), names.select("name").distinct(), least).select("a", "b").where("a <> b")
    met = names.join(pairs.withColumnRenamed("a", "name"), "name")
    links = met.select(named("name").alias("class"), named("b").alias("other"))
    if vector:
        firsts = written(rows.where("v IS NOT NULL").groupBy("exact", "v").agg(F.min("row_id").alias("first")), "leader-vectors")
        pictured = lambda c: F.to_json(F.struct(F.lit("picture").alias("k"), F.col(c).alias("n")))
        same = rows.alias("r").join(firsts.alias("f"), (F.col("r.v") == F.col("f.v")) & F.col("r.exact").eqNullSafe(F.col("f.exact")))
        members = members.unionByName(same.select("r.row_id", pictured("f.first").alias("class")))
        links = links.unionByName(close_vectors(firsts, "exact", least_cosine).select(pictured("a").alias("class"), pictured("b").alias("other")))
    return leaders(members, links).select(F.col("row_id").alias(row_id), F.col("leader").alias("cluster"))
