"""Per-session state over streams; the batch forms are in operators.sessions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mnemospark.sources.scratch import folder

GAP, LATENESS = "45 minutes", "1 hour"


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table as a stream, event times as timestamps."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a pattern, so that the table may be a file or a folder
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/event[s].parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withColumnRenamed("user_id", "session")


def debounce(events: DataFrame, gap: str = GAP, lateness: str = LATENESS) -> DataFrame:
    """Bursts of events per session that end after a quiet gap."""
    return events.withWatermark("ts", lateness).groupBy("session", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("session", F.col("w.start").alias("started"), F.col("w.end").alias("fires"), "n")


GATE = "session long, ref long, at long, searched boolean, fired boolean"
_STATE = "turns array<struct<ref:bigint,at:bigint,searched:boolean,fired:boolean>>"


def gate(events: DataFrame, window_us: int = 24 * 3600 * 1_000_000, lateness: str = LATENESS) -> DataFrame:
    """The gate's turn of each (session, prompt), put out whenever it changes: a view is a stop, a click a search.

    State is the marks of a session's turns, so that Python is entered once a session and batch and not for each prompt; a
    turn goes when it is forgotten. Calls are folded in order of time within a batch.
    """

    # local, so that it reaches the executors whole: they need not have this package
    def calls(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # what the watermark has passed no call can find again
        turns = {ref: (at, searched, fired) for ref, at, searched, fired in (state.get[0] if state.exists else []) if at + window_us >= state.getCurrentWatermarkMs() * 1000}
        out = []
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"])  # the calls of one session in one batch
        for ref, us, searched in zip(rows["ref"].tolist(), rows["us"].tolist(), rows["searched"].tolist(), strict=True):
            turn = turns.get(ref)
            if turn is None or us - turn[0] > window_us:
                turn = (us, searched, not searched)
            else:
                searched = searched or turn[1]
                turn = (turn[0], searched, turn[2] or not searched)
            turns[ref] = turn
            out.append((*key, ref, *turn))
        state.update(([(ref, *turn) for ref, turn in turns.items()],))
        last = max(turn[0] for turn in turns.values())
        state.setTimeoutTimestamp(max((last + window_us) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["session", "ref", "at", "searched", "fired"])

    held = events.where("event_type in ('view', 'click')").withWatermark("ts", lateness)
    held = held.select("session", F.get_json_object("props", "$.k").cast("long").alias("ref"), "event_id", "ts", F.unix_micros("ts").alias("us"), (F.col("event_type") == "click").alias("searched"))
    return held.where("session is not null and ref is not null").groupBy("session").applyInPandasWithState(calls, GATE, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def _run(stream: DataFrame, mode: str, out: str) -> None:
    """Run a stream over all that is there now, into a table of the shared folder; a batch that is run again replaces its part."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream puts out over all that is there now."""
    out = f"{folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    _run(stream, mode, out)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/*")


def bursts(spark: SparkSession, sf_dir: str, gap: str = GAP, lateness: str = LATENESS) -> DataFrame:
    """All bursts, those open at the end included: a last event of no session moves the time on and closes them."""
    out = f"{folder(spark)}/bursts-{uuid.uuid4().hex}"
    events = event_stream(spark, sf_dir).select("session", "ts")
    last = spark.createDataFrame([], events.schema)
    last.write.parquet(f"{out}-last")

    def whole() -> DataFrame:
        return debounce(events.union(spark.readStream.schema(events.schema).parquet(f"{out}-last")), gap, lateness)

    _run(whole(), "append", out)
    end = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max(F.col("ts").cast("timestamp")).alias("ts"))
    end = end.select(F.lit(None).cast("long").alias("session"), (F.col("ts") + F.expr(f"INTERVAL {gap}") + F.expr(f"INTERVAL {lateness}") + F.expr("INTERVAL 1 second")).alias("ts"))
    end.coalesce(1).write.mode("append").parquet(f"{out}-last")
    _run(whole(), "append", out)
    return spark.read.schema(whole().schema).parquet(f"{out}/*").where("session is not null")
