"""Shards of equal size that keep linked documents together: balanced label propagation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulark.llm.tables import written


def _accepted(wanted: np.ndarray, held: np.ndarray, quota: np.ndarray) -> np.ndarray:
    """The share of the wanted moves from each shard to each other that keeps every shard within its quota."""
    flow = wanted.astype(float)
    for _ in range(200):
        over = held + flow.sum(axis=0) - flow.sum(axis=1) - quota
        into = flow.sum(axis=0)
        cut = np.where((over > 0) & (into > 0), np.clip(1 - over / np.maximum(into, 1), 0, 1), 1)
        if (cut == 1).all():
            break
        flow *= cut[None, :]
    return np.divide(flow, wanted, out=np.zeros_like(flow), where=wanted > 0)


def _propagated(members: DataFrame, shards: int, quota: np.ndarray, rounds: int, seed: int) -> DataFrame:
    """``key, link, shard`` after the rounds. A round is one join of the members with their links' votes."""
    start = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(shards)).cast("int")
    now = written(members.select("key", "link", start.alias("shard"), F.lit(None).cast("int").alias("target")), "labels")
    share, idle = np.zeros((shards, shards)), False
    for turn in range(rounds + 1):
        cell = F.element_at(F.array(*[F.lit(float(x)) for x in share.ravel()]), F.col("shard") * shards + F.col("target") + 1)
        chance = F.pmod(F.xxhash64("key", F.lit(seed), F.lit(turn)), F.lit(1 << 30)) / (1 << 30)
        moves = F.col("target").isNotNull() & (chance < cell)
        now = now.select("key", "link", F.when(moves, F.col("target")).otherwise(F.col("shard")).alias("shard"))
        if turn == rounds:
            break
        held = np.zeros(shards)
        for r in now.groupBy("shard").count().collect():
            held[r["shard"]] = r["count"]
        # Every other turn a full shard can be wished for too, for the places of those that leave it.
        open_to = [s for s in range(shards) if held[s] < quota[s] or turn % 2 == 0] or range(shards)
        votes = now.groupBy("link").agg(*[F.count_if(F.col("shard") == s).alias(f"v{s}") for s in range(shards)])
        # Each link's best shard among those; ties go to the lower number.
        best = F.array_max(F.array(*[F.struct(F.col(f"v{s}").alias("n"), F.lit(-s).alias("s")) for s in open_to]))
        votes = votes.select("link", F.array(*[f"v{s}" for s in range(shards)]).alias("votes"), best.alias("best"))
        # Written, so that the join below has an exchange of its own, which adaptive execution splits at a large link.
        votes = written(votes, "votes")
        gain = F.struct("best.n", "best.s") > F.struct(F.element_at("votes", F.col("shard") + 1).alias("n"), (-F.col("shard")).alias("s"))
        step = now.join(votes, "link").select("key", "link", "shard", F.when(gain, -F.col("best.s")).alias("target"))
        now = written(step, "labels")
        wanted = np.zeros((shards, shards))
        for r in now.filter("target is not null").groupBy("shard", "target").count().collect():
            wanted[r["shard"], r["target"]] = r["count"]
        share = _accepted(wanted, held, quota)
        moved = (share * wanted).sum()
        if moved < 1 and idle:
            break
        idle = moved < 1
    return now.select("key", "shard")


def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``n``, their number from 0 within ``place``: sorted ranges are numbered by themselves, then shifted."""
    fields = T.StructType([*df.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType())])
    at = df.columns.index("place")
    names = fields.names

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            place = batch.column(at).to_numpy()
            heads = np.flatnonzero(np.diff(place, prepend=place[0] - 1))
            local = np.arange(len(place)) - np.repeat(heads, np.diff(np.append(heads, len(place))))
            if place[0] == last:
                local[: heads[1] if len(heads) > 1 else len(place)] += seen
            last, seen = place[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(place), part, np.int32)), pa.array(local)], names)

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    done = written(ranged.mapInArrow(number, fields), "numbered")
    # One row for each range and shard in it: at most ranges + shards rows.
    sizes = done.groupBy("place", "part").agg(F.count("*").alias("rows")).orderBy("place", "part").collect()
    before, rows = {}, []
    for r in sizes:
        rows.append((r["place"], r["part"], before.get(r["place"], 0)))
        before[r["place"]] = before.get(r["place"], 0) + r["rows"]
    shift = df.sparkSession.createDataFrame(rows, "place int, part int, shift long")
    return done.join(F.broadcast(shift), ["place", "part"]).withColumn("n", F.col("shift") + F.col("local")).drop("part", "local", "shift")


def _pick(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), index + 1)


def balanced_shards(nodes: DataFrame, shards: int = 16, *, rounds: int = 12, seed: int = 3) -> DataFrame:
    """Every row with ``shard`` and ``slot``: row counts of shards differ by one at most, slots are gapless from 0.

    ``nodes`` has a unique ``key`` (long) and ``link`` (binary, null for a node without links); rows with the same
    link are linked with each other. Linked rows begin in a shard by the hash of their key. In each round they move
    to the shard that holds most of their link (every other round: of those with room), if it holds more than their own;
    where more want to come than the quota and those who leave allow, a share chosen by hash does. A link that is larger than a shard so fills one after the
    other. Rows without partners fill what is left. Other columns are kept; ``shard`` and ``slot`` are replaced.
    An empty table gives an empty result.
    """
    nodes = nodes.drop("shard", "slot")
    total = nodes.count()
    quota = np.array([total // shards + (s < total % shards) for s in range(shards)])
    shared = nodes.filter("link is not null").groupBy("link").agg(F.count("*").alias("n")).filter("n > 1").select("link")
    # Written for the same reason: the join has exchanges of its own, which can be split at a large link.
    members = nodes.select("key", "link").join(written(shared, "shared"), "link")
    placed = written(_propagated(members, shards, quota, rounds, seed), "placed")
    linked = np.zeros(shards, np.int64)
    for r in placed.groupBy("shard").count().collect():
        linked[r["shard"]] = r["count"]
    rows = nodes.join(placed, "key", "left").withColumn("place", F.coalesce("shard", F.lit(shards))).drop("shard")
    rows = _numbered(rows, ["place", "link", "key"])
    kept = np.minimum(linked, quota)
    surplus = np.cumsum([0, *(linked - kept)])
    room = np.cumsum([0, *(quota - kept)])
    # The rows over a quota and then the unlinked ones are one list, which fills the room shard by shard.
    home = F.col("place") < shards
    stays = home & (F.col("n") < _pick([*kept, 0], F.col("place")))
    index = F.col("n") + _pick([*(surplus[:-1] - kept), surplus[-1]], F.col("place"))
    into = F.lit(shards - 1)
    for s in range(shards - 2, -1, -1):
        into = F.when(index < int(room[s + 1]), s).otherwise(into)
    rows = rows.withColumn("shard", F.when(stays, F.col("place")).otherwise(into).cast("int"))
    moved = index - _pick(list(room[:-1] - kept), F.col("shard"))
    return rows.withColumn("slot", F.when(stays, F.col("n")).otherwise(moved).cast("long")).drop("place", "n")
