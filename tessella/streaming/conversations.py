"""Conversations and corpora as streams: capped history per conversation, incremental refresh, streamed decoding."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.operators.bpe import Vocabulary
from tessella.operators.prompts import MOST_TURNS


def rolling_history(turns: DataFrame, key: str = "conv_id", most: int = MOST_TURNS) -> DataFrame:
    """(key, n_turns, history): after every batch the capped history of each conversation that had a turn.

    The state of a conversation is its newest turns, so it stays small however long the conversation lasts.
    Needs a streaming turns(key, turn, user, assistant).
    """
    fields = ["turn", "user", "assistant"]

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        for b in batches:
            held += list(b[fields].itertuples(index=False, name=None))
        held = sorted((int(t), u, a) for t, u, a in held)[-most:]
        state.update(tuple(list(c) for c in zip(*held)))
        yield pd.DataFrame({key: [k[0]], "n_turns": [len(held)], "history": ["\n".join(f"{u}\t{a}" for _, u, a in held)]})

    return turns.groupBy(key).applyInPandasWithState(update, f"{key} long, n_turns int, history string", "turn array<long>, user array<string>, assistant array<string>", "update", GroupStateTimeout.NoTimeout)


def refresh_stream(spark: SparkSession, folder: str, schema: str, transform, target: str, checkpoint: str):
    """Append `transform(batch)` of files that are new in a folder to a table; each file counts once."""

    def write(batch: DataFrame, _: int) -> None:
        transform(batch).write.mode("append").parquet(target)

    source = spark.readStream.schema(schema).parquet(folder)
    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(stream: DataFrame, target: str, mode: str = "append") -> None:
    """Read a streaming query to the end of its source; each batch's rows go to the table at `target`, with `_batch`.

    The rows stay in the shared folder; nothing of them comes to the driver.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(target)

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{target}-state").trigger(availableNow=True).start()
    q.awaitTermination()


def activity(events: DataFrame, late: str = "2 hours", window: str = "1 hour") -> DataFrame:
    """Counts and sums of events by type and tumbling window, closed once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def decode_stream(tokens: DataFrame, vocabulary: Vocabulary, key: str = "reply_id") -> DataFrame:
    """(key, text): text that has become whole with each batch of (key, pos, id); unfinished bytes wait in the state.

    Instead of single ids a row may hold a run of them, (key, pos, ids), pos being the place of the first.
    """
    merges, column = vocabulary.merges, "ids" if "ids" in tokens.columns else "id"
    made: dict = {}

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if "v" not in made:
            made["v"] = Vocabulary(merges)
        d = made["v"].decoder()
        d.held = bytes(state.get[0]) if state.exists else b""
        rows = sorted(((int(p), x) for b in batches for p, x in zip(b["pos"], b[column])), key=lambda r: r[0])
        text = d.push_all(int(i) for _, x in rows for i in x) if column == "ids" else d.push_all(int(i) for _, i in rows)
        state.update((d.held,))
        yield pd.DataFrame({key: [k[0]], "text": [text]})

    return tokens.groupBy(key).applyInPandasWithState(update, f"{key} long, text string", "held binary", "update", GroupStateTimeout.NoTimeout)
