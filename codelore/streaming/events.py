"""Structured Streaming: windowed counts, incremental index upkeep, conversation state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from codelore.sources import store


def windowed_counts(events: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts by window and type of a stream or table of events (ts, event_type).

    ``ts`` without a zone is read as UTC, as watermarks need an instant.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return timed.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def incremental_index(batch: DataFrame, stored: DataFrame | None, chunker: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The chunk table after a batch of files (repository, relative_path, file_hash, content).

    Chunks of changed and removed files go before the new ones of added and changed files come.
    """
    if stored is None:
        return chunker(batch)
    manifest = stored.groupBy(F.col("relative_path").alias("path")).agg(F.max("file_hash").alias("file_hash"))
    changes = store.difference(manifest, batch.select(F.col("relative_path").alias("path"), "file_hash"))
    kept = store.delete_paths(stored, changes.where("status in ('changed', 'removed')"))
    work = batch.join(changes.where("status in ('added', 'changed')").select(F.col("path").alias("relative_path")), "relative_path", "left_semi")
    return kept.unionByName(chunker(work).select(*stored.columns))


def stream_to(spark: SparkSession, source: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]):
    """Run ``handle`` on every micro-batch of what is available, then stop."""
    return source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_turns(turns: DataFrame, keep: int = 8) -> DataFrame:
    """(conv_id, turns) of a conversation table: the last ``keep`` turns in order.

    On a stream use complete or update mode; for unbounded conversations use
    :func:`conversation_state`, whose state per key is bounded.
    """
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.substring("text", 1, 400).alias("text")))).alias("all"))
    return listed.select("conv_id", F.slice("all", -F.least(F.size("all"), F.lit(keep)), F.lit(keep)).alias("turns"))


def conversation_state(turns: DataFrame, keep: int = 8, forget_after: str | None = None) -> DataFrame:
    """(conv_id, n_turns, last_turn, held, focus) of a stream of turns, one row per key and micro-batch.

    The state of a key is its last ``keep`` turns, a count, and the last focus that was not null, which
    so carries over turns that name nothing.  It stays bounded, and with ``forget_after`` (as in ``30
    minutes``, by the clock) a key that is silent so long is dropped.
    """
    import pandas as pd

    names = turns.columns
    focus = F.col("focus") if "focus" in names else F.lit(None).cast("string").alias("focus")
    silent = None if forget_after is None else pd.Timedelta(forget_after) // pd.Timedelta(milliseconds=1)

    def update(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        count, held, about = state.get if state.exists else (0, [], None)
        held = list(held)
        for frame in frames:
            count += len(frame)
            frame = frame.sort_values("turn")
            held = sorted([*held, *frame["turn"].tolist()])[-keep:]
            named = frame["focus"].dropna()
            about = named.iloc[-1] if len(named) else about
        state.update((count, held, about))
        if silent is not None:
            state.setTimeoutDuration(int(silent))
        yield pd.DataFrame({"conv_id": [key[0]], "n_turns": [count], "last_turn": [held[-1]], "held": [len(held)], "focus": pd.Series([about], dtype="object")})

    out = "conv_id long, n_turns long, last_turn long, held long, focus string"
    return turns.select("conv_id", "turn", focus).groupBy("conv_id").applyInPandasWithState(update, out, "count long, held array<long>, focus string", "update", "NoTimeout" if silent is None else "ProcessingTimeTimeout")


#: Node ids in one event.
MOST_NODES = 60


def broadcast(source: DataFrame, subscribers: Callable[[], list[tuple[str | None, Callable[[dict], None]]]], checkpoint: str):
    """Give each event (repository, node_ids, focus, note) of a stream to the subscribers of its
    repository; a subscriber of None gets all.  Nothing is kept.

    Events are for people who watch: a micro-batch of them is small, and is read by the driver.
    """

    def send(batch: DataFrame, _: int) -> None:
        few = batch.select("repository", F.slice(F.coalesce("node_ids", F.array().cast("array<string>")), 1, MOST_NODES).alias("node_ids"), "focus", F.coalesce("note", F.lit("")).alias("note"))
        for row in few.toLocalIterator():
            event = row.asDict()
            for repository, tell in subscribers():
                if repository in (None, event["repository"]):
                    tell(event)

    return source.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
