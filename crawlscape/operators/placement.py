"""Fleet placement: owners, moves, replicas, health and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import owner, rendezvous_weight, unsigned, weighted_rendezvous
from ..schema import Elasticity


def moving_hosts(hosts: DataFrame, key: str, self_id: int, partitions: int, pins: dict[int, int] | None = None) -> DataFrame:
    return hosts.withColumn("owner", owner(F.col(key), partitions, pins)).where(F.col("owner") != self_id)


def redistribute(urls: DataFrame, hosts: DataFrame, key: str, self_id: int, partitions: int) -> tuple[DataFrame, DataFrame]:
    """(ship with ``owner``, keep): hosts move whole."""
    moving = moving_hosts(hosts, key, self_id, partitions).select(key, "owner")
    return urls.join(moving, key), urls.join(moving, key, "left_anti")


def handoff(ship: DataFrame, acks: DataFrame, epoch: int, checksum: str = "checksum") -> DataFrame:
    """Rows that stay: their destination has no committed acknowledgement of this epoch and checksum."""
    good = acks.where(F.col("committed") & (F.col("epoch") == epoch)).select(F.col("dest").alias("owner"), F.col("checksum").alias(checksum))
    return ship.join(good, ["owner", checksum], "left_anti")


def slice_checksum(rows: DataFrame, owner_column: str) -> DataFrame:
    """(owner, checksum) that does not depend on the order of rows."""
    return rows.groupBy(owner_column).agg(F.sum(F.crc32(F.to_json(F.struct(*rows.columns)).cast("binary"))).alias("checksum"))


def preferences(partitions: DataFrame, machines: DataFrame, replicas: int, weighted: bool = False) -> DataFrame:
    """(partition_id, machine_id, rank): the machines with the highest hash weights, ties to the smaller id.

    Both tables describe the fleet, not the data: their product has partitions x machines rows."""
    both = partitions.select("partition_id").join(F.broadcast(machines.select("machine_id", "weight")))
    if weighted:
        scored = both.withColumn("__w", weighted_rendezvous(F.col("partition_id").cast("long"), F.col("machine_id").cast("long"), F.col("weight").cast("double")))
    else:
        scored = both.withColumn("__w", unsigned(rendezvous_weight(F.col("partition_id").cast("long"), F.col("machine_id").cast("long"))))
    rank = F.row_number().over(Window.partitionBy("partition_id").orderBy(F.col("__w").desc(), "machine_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= replicas + 1).select("partition_id", "machine_id", "rank")


def route(rows: DataFrame, key: Column, manifest: DataFrame, cells: int = 4096) -> DataFrame:
    """Adds ``partition_id`` of the file whose range holds the key, null in a gap.

    The span of all ranges is cut into cells of equal width and each range listed in the cells it touches: at
    most ``cells`` rows more than there are files. A key then meets the few ranges of its cell by an equi-join,
    which the optimizer may broadcast. Keys are halved in precision for the cells only, so that no difference
    of two 64-bit keys overflows."""
    low, high = manifest.agg(F.min("lo"), F.max("hi")).head()
    if low is None:
        return rows.withColumn("partition_id", F.lit(None).cast("long"))
    base, width = low >> 12, ((high >> 12) - (low >> 12)) // cells + 1
    cell = lambda k: F.expr(f"({k} - ({base})) div {width}")
    ends = manifest.select("lo", "hi", "partition_id", F.shiftright("lo", 12).alias("__l"), F.shiftright("hi", 12).alias("__h"))
    listed = ends.select(F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), F.col("partition_id").alias("__p"), F.explode(F.sequence(cell("__l"), cell("__h"))).alias("__c"))
    keyed = rows.withColumn("__k", key.cast("long")).withColumn("__s", F.shiftright("__k", 12)).withColumn("__kc", cell("__s"))
    hit = (F.col("__kc") == F.col("__c")) & (F.col("__lo") <= F.col("__k")) & (F.col("__k") <= F.col("__hi"))
    return keyed.join(listed, hit, "left").withColumn("partition_id", F.col("__p")).drop("__k", "__s", "__kc", "__c", "__p", "__lo", "__hi")


def coverage_breaks(manifest: DataFrame, lowest: int, highest: int) -> DataFrame:
    """(epoch, kind, at_lo, at_hi) of the first gap or overlap of each epoch over [lowest, highest]."""
    turn = Window.partitionBy("epoch").orderBy("lo", "hi")
    ends = manifest.select("epoch", "lo", "hi").unionByName(manifest.select("epoch").distinct().select("epoch", F.lit(highest + 1).cast("long").alias("lo"), F.lit(highest + 1).cast("long").alias("hi")))
    seen = ends.withColumn("next", F.coalesce(F.max("hi").over(turn.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(lowest).cast("long")))
    bad = seen.where("lo <> next").withColumn("kind", F.when(F.col("lo") > F.col("next"), "gap").otherwise("overlap"))
    low, high = F.least("lo", "next"), F.greatest("lo", "next") - 1
    first = bad.groupBy("epoch").agg(F.min_by(F.struct("kind", low.alias("at_lo"), high.alias("at_hi")), F.struct("lo", "hi")).alias("b"))
    return first.select("epoch", "b.kind", "b.at_lo", "b.at_hi")


def replica(snapshot: DataFrame, tail: DataFrame, key: str, applied: int = 0) -> DataFrame:
    """Last writer wins: rows of the snapshot under the tail's puts and deletes (lsn, op, key, ...), of which those
    at or below ``applied`` came too late, whatever their key."""
    columns = [c for c in snapshot.columns if c != key]
    base = snapshot.select(key, F.lit(-1).cast("long").alias("lsn"), F.lit("put").alias("op"), *columns)
    live = tail.where(F.col("lsn") > applied).select(key, "lsn", "op", *columns)
    latest = base.unionByName(live).groupBy(key).agg(F.max_by(F.struct("op", *columns), "lsn").alias("r"))
    return latest.where("r.op <> 'del'").select(key, *[F.col(f"r.{c}").alias(c) for c in columns])


def newest_epoch(signals: DataFrame, key: str, value: str, seen: int = -1) -> DataFrame:
    """Signals of bundles newer than ``seen``; per key the value of the newest bundle."""
    return signals.where(F.col("epoch") > seen).groupBy(key).agg(F.max_by(F.struct("epoch", value), "epoch").alias("s")).select(key, "s.epoch", f"s.{value}")


def split_signals(signals: DataFrame, key: Column, partitions: int, self_id: int) -> DataFrame:
    """Adds ``owner`` and ``local`` to imported scores, by the host they speak of."""
    return signals.withColumn("owner", owner(key, partitions)).withColumn("local", F.col("owner") == self_id)


def span_fraction(low: Column, high: Column) -> Column:
    """Share of the 64-bit key space that an inclusive range of sign-flipped keys spans."""
    return (high.cast("double") - low.cast("double") + 1) / F.lit(2.0**64)


def health(beats: DataFrame, partition: str = "partition_id", tick: str = "tick", failed_after: int = 3) -> DataFrame:
    """Adds ``misses``, ``state`` and ``epoch``: consecutive missed beats, the state they mean, and the number of
    state changes so far. ``beats`` has ``ok`` for every tick."""
    turn = Window.partitionBy(partition).orderBy(tick)
    island = beats.withColumn("__i", F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(turn))
    missed = island.withColumn("misses", F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(Window.partitionBy(partition, "__i").orderBy(tick)))
    state = missed.withColumn("state", F.when(F.col("misses") == 0, "healthy").when(F.col("misses") < failed_after, "degraded").otherwise("failed"))
    changed = F.when(F.coalesce(F.lag("state").over(turn), F.lit("healthy")) != F.col("state"), 1).otherwise(0)
    return state.withColumn("__c", changed).withColumn("epoch", F.sum("__c").over(turn)).drop("__i", "__c")


def scaling(ticks: Column, e: Elasticity = Elasticity(), start: int = 1) -> Column:
    """array of (tick, load, decision, partitions) for array<struct<tick, load>> in order: a water mark has to
    be breached for a run of ticks, then one partition comes or goes, then the loop rests."""
    zero = F.lit(0)
    row = "array<struct<tick:bigint,load:bigint,decision:string,partitions:int>>"
    first = F.struct(F.lit(start).alias("n"), zero.alias("high"), zero.alias("low"), zero.alias("rest"), F.array().cast(row).alias("out"))

    def step(a: Column, t: Column) -> Column:
        resting = a["rest"] > 0
        over = t["load"] > e.high_water
        under = (t["load"] < e.low_water) if e.low_water > 0 else F.lit(False)
        high = F.when(~resting & over, a["high"] + 1).otherwise(zero)
        low = F.when(~resting & ~over & under, a["low"] + 1).otherwise(zero)
        up = (high >= e.breaches) & (a["n"] < e.max_partitions)
        down = ~up & (low >= e.breaches) & (a["n"] > e.min_partitions)
        n = a["n"] + F.when(up, 1).when(down, -1).otherwise(0)
        acted = up | down
        said = F.struct(t["tick"].cast("long").alias("tick"), t["load"].cast("long").alias("load"), F.when(up, "up").when(down, "down").otherwise("hold").alias("decision"), n.cast("int").alias("partitions"))
        return F.struct(n.alias("n"), F.when(acted, zero).otherwise(high).alias("high"), F.when(acted, zero).otherwise(low).alias("low"), F.when(acted, F.lit(e.cooldown)).otherwise(F.greatest(a["rest"] - 1, zero)).alias("rest"), F.concat(a["out"], F.array(said)).alias("out"))

    return F.aggregate(ticks, first, step, lambda a: a["out"])


def mean_backlog(backlog: DataFrame, partitions: int) -> DataFrame:
    """Whole mean over all partitions; those that report nothing count as 0."""
    return backlog.agg((F.coalesce(F.sum("depth"), F.lit(0)) / F.lit(partitions)).cast("long").alias("mean"))
