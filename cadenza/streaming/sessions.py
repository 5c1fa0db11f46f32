"""Streams with state by key: quiz sessions, debounced taps, pressed keys; and the stateless tick stream.

Rows of a micro-batch are taken in the order of the given columns; across batches, in the order of the batches. A key's rows
of one micro-batch are held together to be sorted, so bound a batch by the source (``maxFilesPerTrigger``). State never
expires: a session, player or tapper may come back at any time, and each keeps a few numbers or the keys that are down.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cadenza.operators.playback import events

SCORES = "session long, event_id long, correct long, total long, streak long, best_streak long"
QUIZ_STATE = "asked boolean, answered boolean, correct long, total long, streak long, best long"


def quiz_scores(actions: DataFrame) -> DataFrame:
    """Actions (session, ts, event_id, action, ok) to a row for each answer that counts."""

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        asked, answered, correct, total, streak, best = state.get if state.exists else (False, False, 0, 0, 0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for event_id, action, ok in rows[["event_id", "action", "ok"]].itertuples(index=False):
            if action == "question":
                asked, answered = True, False
            elif action == "answer":
                if asked and not answered:
                    answered, total = True, total + 1
                    correct, streak = correct + bool(ok), streak + 1 if ok else 0
                    best = max(best, streak)
                    out.append((key[0], event_id, correct, total, streak, best))
            else:
                correct = total = streak = best = 0
                if action != "resetScore":
                    asked = answered = False
        state.update((asked, answered, correct, total, streak, best))
        yield pd.DataFrame(out, columns=["session", "event_id", "correct", "total", "streak", "best_streak"])

    return actions.groupBy("session").applyInPandasWithState(step, SCORES, QUIZ_STATE, "append", GroupStateTimeout.NoTimeout)


def debounced(taps: DataFrame, gap_us: int) -> DataFrame:
    """Taps (key, at_us) that come at least ``gap_us`` after the last one that was accepted."""

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for at in pd.concat(list(frames))["at_us"].sort_values():
            if last is None or at - last >= gap_us:
                last = int(at)
                out.append((key[0], last))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["key", "at_us"])

    return taps.groupBy("key").applyInPandasWithState(step, "key long, at_us long", "last long", "append", GroupStateTimeout.NoTimeout)


def pressed(keys: DataFrame) -> DataFrame:
    """Presses (player, at_us, note, down) without repeats: a note that is down is pressed again only after it was up."""

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        down = set(state.get[0]) if state.exists else set()
        out = []
        for at, note, is_down in pd.concat(list(frames)).sort_values("at_us")[["at_us", "note", "down"]].itertuples(index=False):
            if is_down and note not in down:
                down.add(note)
                out.append((key[0], at, note))
            elif not is_down:
                down.discard(note)
        state.update((sorted(down),))
        yield pd.DataFrame(out, columns=["player", "at_us", "note"])

    return keys.groupBy("player").applyInPandasWithState(step, "player long, at_us long, note string", "down array<string>", "append", GroupStateTimeout.NoTimeout)


def tick_source(spark: SparkSession, bpm: int) -> DataFrame:
    """A tick a quarter note: n, tick (its eighth) and beat."""
    rate = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("advanceMillisPerBatch", 60_000 // bpm).load()
    return rate.select(F.col("value").alias("n"), (F.col("value") * 2).alias("tick"), (F.col("value") % 4).cast("int").alias("beat"))


def playback(steps: DataFrame, ticks: DataFrame) -> DataFrame:
    """Playback events of a stream of ticks: a static table of steps joined to it, without state. The steps' onsets are written
    once, and a batch of ticks only reads them."""
    return events(steps, ticks)


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all that is there now, into a table in ``folder``, and read that back."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
