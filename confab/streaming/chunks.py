"""Streams of message chunks (message_id, seq, type, text, finish_reason), folded into messages."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

#: Reasons for which a message ends. Fixed values.
FINISH = ("stop", "length", "error", "other", "content-filter", "tool-calls")


def _text() -> Column:
    parts = F.array_sort(F.collect_list(F.when(F.col("type") == "text", F.struct("seq", "text"))))
    return F.array_join(F.transform(parts, lambda x: F.coalesce(x["text"], F.lit(""))), "").alias("text")


def fold(chunks: DataFrame) -> DataFrame:
    """(message_id, text, finish_reason): texts in order of seq; the reason only where a finish chunk came. Works on a
    batch, and on a stream in complete or update mode. The chunks of a message meet by nature: its text is one value."""
    reason = F.max_by(F.when(F.col("type") == "finish", F.col("finish_reason")), F.when(F.col("type") == "finish", F.col("seq")))
    return chunks.groupBy("message_id").agg(_text(), reason.alias("finish_reason"))


def finish_metadata(chunks: DataFrame) -> DataFrame:
    """chunks with metadata, which only finish chunks carry."""
    return chunks.withColumn("metadata", F.when(F.col("type") == "finish", F.struct(F.col("finish_reason").alias("finishReason"))))


def latest_version(messages: DataFrame, key: str, version: str) -> DataFrame:
    """Of each key the row of the highest version: a regenerated answer replaces the one before."""
    rest = [c for c in messages.columns if c != key]
    top = messages.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("m"))
    return top.select(key, "m.*")


def finished(stream: DataFrame, wait_ms: int | None = None) -> DataFrame:
    """(message_id, text, finish_reason), once a message: when its finish chunk and all before it have come, or, as far as
    they have, when ``wait_ms`` pass without a new one, if given. State is held for open messages only, each chunk of
    them once, in any order of arrival. A query that waits always has another batch to run, so it needs a trigger by
    time."""

    def step(key, frames, state):
        held = dict(zip(*state.get[:2], strict=True)) if state.exists else {}
        end, reason = state.get[2:] if state.exists else (None, None)
        for frame in frames:
            for r in frame.itertuples(index=False):
                held[int(r.seq)] = (r.text or "") if r.type == "text" else ""
                if r.type == "finish" and (end is None or r.seq >= end):
                    end, reason = int(r.seq), r.finish_reason
        if state.hasTimedOut or end is not None and sum(k < end for k in held) == end:
            if state.exists:
                state.remove()
            text = "".join(held[k] for k in sorted(held))
            yield pd.DataFrame({"message_id": [key[0]], "text": [text], "finish_reason": pd.Series([reason], dtype=object)})
        else:
            state.update((list(held), list(held.values()), end, reason))
            if wait_ms is not None:
                state.setTimeoutDuration(wait_ms)

    rows = stream.select("message_id", "seq", "type", "text", "finish_reason").groupBy("message_id")
    state = "seqs array<int>, texts array<string>, end int, reason string"
    waits = GroupStateTimeout.NoTimeout if wait_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.applyInPandasWithState(step, "message_id string, text string, finish_reason string", state, "append", waits)


def write_finished(stream: DataFrame, path: str, checkpoint: str, on_batch=None):
    """Starts a query that keeps the finished messages of the stream, each written once, with the batch for a version.
    on_batch(frame, batch_id) runs once a batch, such as a cost report."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("version", F.lit(batch_id)).write.mode("append").parquet(path)
        if on_batch:
            on_batch(batch, batch_id)

    out = finished(stream).writeStream.outputMode("append").foreachBatch(store)
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
