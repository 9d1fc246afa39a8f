"""Mini-batch training of a parameter table in rounds.

The training rows are dealt into rounds of `ROUND_STEPS` steps, and each round into shards that take
the steps side by side, every shard its part of the batch; after a round the shards' copies of a
parameter are averaged. Rounds and shards follow from the batch size alone, so a fit is the same
procedure at any size: an epoch has rows / batch_size steps one after the other.

Which rounds touch a parameter is known beforehand. So a round's result is mailed, each parameter to
the round that touches it next: a folder a round, which that round reads and no other. A round reads
its own rows and its own parameters, and an epoch moves bytes in proportion to its rows. Untouched
parameters catch up when they are read (see `lazy`).
"""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import work_path
from .lazy import LazyAdam, as_lists, lists, train_shard

#: steps between two averages
ROUND_STEPS = 64
#: rows of a batch that one shard takes
SHARD_BATCH = 512
#: mail for rounds of another block of so many rounds is dealt out when the block begins
BLOCK = 16
#: rounds before the first
NEVER = -1


def shard_count(batch_size: int, shard_batch: int = SHARD_BATCH) -> int:
    return max(1, batch_size // shard_batch)


def steps_between(n: int, steps: int, rounds: int) -> tuple[int, int]:
    """The steps before and after round `n` of an epoch."""
    return n * steps // rounds, (n + 1) * steps // rounds


def _dealt(name: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(name), "row_id"), F.lit(parts)).cast("int")


class Rounds:
    """Training rows, the rounds that touch each parameter, and the parameters in the mail.

    `rows` have `row_id`, the columns of the loss and, in the columns `ids`, arrays of ids. Ids
    below 0 down to `-dense` are the dense parameters, which every round touches.
    """

    def __init__(
        self, rows: DataFrame, ids: list[str], batch_size: int, dense: int, width: int,
        round_steps: int = ROUND_STEPS, shard_batch: int = SHARD_BATCH,
    ):
        self.spark = rows.sparkSession
        self.rows_path, self.visits_path, self.mail = (
            work_path(self.spark, name) for name in ("round_rows", "round_visits", "mail")
        )
        rows = rows.withColumn("row_id", F.coalesce("row_id", F.lit(0)).cast("long"))
        self.width, self.dense = width, dense
        self.shards = shard_count(batch_size, shard_batch)
        count = rows.count()
        if not count:
            raise RuntimeError("there are no training rows to take steps on")
        self.steps = -(-count // batch_size)
        self.rounds = -(-self.steps // round_steps)
        self.block = max(BLOCK, math.isqrt(self.rounds))
        placed = rows.withColumns({"shard": _dealt("shard", self.shards), "round": _dealt("round", self.rounds)})
        placed.write.partitionBy("round").parquet(self.rows_path)
        self.rows = self.spark.read.parquet(self.rows_path)
        # one row a round; of very few rows, a round may get none
        self.used = {r["round"] for r in self.rows.select("round").distinct().collect()}
        self._write_visits(ids)

    def _write_visits(self, ids: list[str]) -> None:
        """(id, round, next round, its shards, whether that is in the next epoch)."""
        touched = reduce(
            DataFrame.unionByName,
            [self.rows.select("round", "shard", F.explode(c).alias("id")) for c in ids],
        ).withColumn("id", F.col("id").cast("long"))
        if self.dense:
            every = self.rows.select("round", "shard").distinct()
            below = F.sequence(F.lit(-1).cast("long"), F.lit(-self.dense).cast("long"), F.lit(-1).cast("long"))
            touched = touched.unionByName(every.select("round", "shard", F.explode(below).alias("id")))
        visits = touched.groupBy("id", "round").agg(F.array_sort(F.collect_set("shard")).alias("shards"))
        # at most one row a round for any id
        order = W.partitionBy("id").orderBy("round")
        whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        after = F.struct("round", "shards")
        linked = visits.select(
            "id", "round", F.lead(after).over(order).alias("later"), F.first(after).over(whole).alias("first"),
        )
        visit = F.coalesce("later", "first")
        linked.select(
            "id", "round", visit["round"].alias("due"), visit["shards"].alias("shards"),
            F.col("later").isNull().cast("int").alias("wraps"),
        ).write.partitionBy("round").parquet(self.visits_path)
        self.visits = self.spark.read.schema(
            "id long, due int, shards array<int>, wraps int, round int"
        ).parquet(self.visits_path)

    # --- mail ---

    def _box(self, due: Column, at: Column) -> Column:
        """The folder of mail: its round's own, or that of a block that has yet to begin."""
        blocks = -(-self.rounds // self.block)
        block = lambda r: F.floor(r / F.lit(self.block)).cast("int")
        near = F.lit(blocks == 1) | (block(due) == block(at))
        return F.when(near, F.concat(F.lit("r"), due)).otherwise(F.concat(F.lit("b"), block(due)))

    def _send(self, params: DataFrame, epoch: Column, at: Column) -> None:
        """Mails (id, at, s, due, shards) to the boxes of an epoch."""
        params.withColumn("epoch", epoch).withColumn("box", self._box(F.col("due"), at)).write.mode("append").partitionBy(
            "epoch", "box"
        ).parquet(self.mail)

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema("id long, at long, s array<double>, due int, shards array<int>").parquet(path)

    def begin(self, table: DataFrame) -> None:
        """Mails the parameters (id, at, s) to the first rounds that touch them; the rest is idle."""
        first = self.visits.where("wraps = 1").select("id", "due", "shards")
        both = table.join(first, "id", "left")
        self.idle_path = work_path(self.spark, "idle")
        both.where("due IS NULL").select("id", "at", "s").write.parquet(self.idle_path)
        touched = both.where("due IS NOT NULL").select("id", "at", "s", "due", "shards")
        # nothing is due in a round before the first
        self._send(touched, F.lit(0), F.lit(NEVER * self.block))
        self.taken, self.epochs = 0, 0

    def _open_block(self, epoch: int, number: int) -> None:
        """Deals the mail of a block out to its rounds."""
        held = range(number * self.block, (number + 1) * self.block)
        if self.rounds <= self.block or self.used.isdisjoint(held):
            return
        self._send(self._read(f"{self.mail}/epoch={epoch}/box=b{number}"), F.lit(epoch), F.col("due"))

    def epoch(self, loss, lr: float, l2: float, decay: float, seed: int, taken: int = 0) -> None:
        """One pass over all rounds; `taken` steps went before this plan's first."""
        e = self.epochs
        for n in range(self.rounds):
            if n % self.block == 0:
                self._open_block(e, n // self.block)
            if n not in self.used:
                continue
            before, after = steps_between(n, self.steps, self.rounds)
            first = taken + self.taken + before
            run = train_shard(loss, lr, l2, decay, first, after - before, seed)
            own = self.rows.where(F.col("round") == n).drop("round")
            box = self._read(f"{self.mail}/epoch={e}/box=r{n}")
            w = self.width
            cut = lambda name, i: F.slice("s", i * w + 1, w).alias(name)
            near = box.select(F.explode("shards").alias("shard"), "id", "at", cut("p", 0), cut("m", 1), cut("u", 2))
            # as many tasks as shards, however little they hold
            own, near = (d.repartition(self.shards, "shard") for d in (own, near))
            trained = own.groupBy("shard").cogroup(near.groupBy("shard")).applyInArrow(
                run, "id long, touched long, s array<double>"
            )
            # a parameter is the mean over its shards, by the rows that touched it
            seen = F.sum("touched")
            mean = [F.sum(F.col("s")[i] * F.col("touched")) / seen for i in range(3 * w)]
            merged = trained.groupBy("id").agg(F.array(*mean).alias("s"))
            to = self.visits.where(F.col("round") == n).select("id", "due", "shards", "wraps")
            out = merged.join(to, "id").withColumn("at", F.lit(taken + self.taken + after).cast("long"))
            at = F.when(F.col("wraps") == 1, F.lit(NEVER * self.block)).otherwise(F.lit(n))
            self._send(
                out.withColumn("at_round", at).select("id", "at", "s", "due", "shards", "wraps", "at_round"),
                F.lit(e) + F.col("wraps"), F.col("at_round"),
            )
        self.taken += self.steps
        self.epochs += 1

    def table(self) -> DataFrame:
        """(id, at, s) of all parameters as they are after the last epoch: all are in the mail to
        the next one, or idle. Later epochs don't change what this frame reads."""
        sent = self._read(f"{self.mail}/epoch={self.epochs}").select("id", "at", "s")
        return sent.unionByName(self.spark.read.parquet(self.idle_path).select("id", "at", "s"))


def start_rows(spark, dimension: int, width: int, seed: int, spread: float) -> DataFrame:
    """(id, at, s) at the start: weight 0 and normal factors drawn from a hash of the id."""

    def uniform(f, side):
        drawn = F.xxhash64(F.lit(seed), F.lit(f), F.lit(side), F.col("id"))
        return (F.pmod(drawn, F.lit(1 << 32)).cast("double") + 0.5) / float(1 << 32)

    normal = lambda f: F.sqrt(-2.0 * F.log(uniform(f, 0))) * F.cos(2.0 * math.pi * uniform(f, 1))
    values = [F.lit(0.0), *[spread * normal(f) for f in range(width - 1)]]
    moments = [F.lit(0.0)] * (2 * width)
    return spark.range(dimension).select("id", F.lit(0).cast("long").alias("at"), F.array(*values, *moments).alias("s"))


def dense_rows(spark, values, width: int) -> DataFrame:
    """(id, at, s) of the dense values, `width` in a row, from id -1 downwards."""
    rows = []
    for n in range(-(-len(values) // width)):
        own = [float(v) for v in values[n * width : (n + 1) * width]]
        rows.append((-1 - n, 0, own + [0.0] * (3 * width - len(own))))
    return spark.createDataFrame(rows, "id long, at long, s array<double>")


def current(table: DataFrame, now: int, lr: float, width: int) -> DataFrame:
    """(id, p): the values of parameters after step `now`, whenever they were last touched."""
    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            s = lists(batch.column("s")).reshape(batch.num_rows, 3, width)
            at = batch.column("at").to_numpy().copy()
            parts = [s[:, i].copy() for i in range(3)]
            adam = LazyAdam(*parts, at, lr)
            adam.catch_up(slice(0, batch.num_rows), now)
            yield pa.RecordBatch.from_arrays([batch.column("id"), as_lists(adam.values)], names=["id", "p"])

    return table.mapInArrow(work, "id long, p array<double>")
