"""Event streams: windows with watermarks, last-wins tables and a failure window as keyed state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.tables import shared_folder


def read_events(spark: SparkSession, sf_dir: str, files_a_batch: int = 16) -> DataFrame:
    """The events as a stream of their files; the schema is that of the table."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A pattern that only this path matches: a stream takes a single file by pattern only.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{sf_dir}/events.parque[t]")


def tumbling(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; rows later than `late` are left out, and state ends with its window."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    sums = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return sums.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of a user: they end after a gap without events."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def without_repeats(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_to_end(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Process all files that are there, and read back what the last batch wrote (complete) or all have (append)."""
    spark, folder = stream.sparkSession, f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/out")

    asked = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(keep)
    asked.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")


def failure_windows(events: DataFrame, failed: str, window_s: int = 30, buckets: int = 10, least: int = 20, rate: float = 0.5, open_s: int = 30, most_open_s: int = 240, probes: int = 3) -> DataFrame:
    """(key, at, state) at each change of a key's breaker, from rows (key, at in seconds, `failed`).

    Outcomes of the last window_s seconds are counted in a ring of buckets. At `least` calls and the failure rate, the
    breaker opens; after its open time it lets probes pass: `probes` good ones close it, a failed one opens it again for
    twice the time, up to most_open_s. Rows of a batch are taken in order of time.
    """
    width = window_s / buckets

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mode, since, wait, good, ring = ("closed", 0.0, float(open_s), 0, []) if not state.exists else (*state.get[:4], [tuple(x) for x in zip(*[iter(state.get[4])] * 3)])
        changes = []
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        for at, bad in zip(rows["at"].tolist(), rows[failed].tolist()):
            if mode == "open" and at >= since + wait:
                mode, good = "probing", 0
                changes.append((key[0], at, mode))
            if mode == "probing":
                good = 0 if bad else good + 1
                if bad or good >= probes:
                    wait = min(wait * 2, most_open_s) if bad else float(open_s)
                    mode, since, ring = ("open" if bad else "closed"), at, []
                    changes.append((key[0], at, mode))
            elif mode == "closed":
                number = at // width
                ring = [x for x in ring if x[0] > number - buckets]
                if ring and ring[-1][0] == number:
                    ring[-1] = (number, ring[-1][1] + 1, ring[-1][2] + bool(bad))
                else:
                    ring.append((number, 1, int(bool(bad))))
                calls, wrong = sum(x[1] for x in ring), sum(x[2] for x in ring)
                if calls >= least and wrong >= rate * calls:
                    mode, since, ring = "open", at, []
                    changes.append((key[0], at, mode))
        state.update((mode, since, wait, good, [float(v) for x in ring for v in x]))
        yield pd.DataFrame(changes, columns=["key", "at", "state"])

    return events.groupBy("key").applyInPandasWithState(
        step, "key long, at double, state string", "mode string, since double, wait double, good int, ring array<double>", "append", GroupStateTimeout.NoTimeout
    )
