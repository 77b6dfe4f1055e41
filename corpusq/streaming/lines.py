"""Streams: answer deltas to lines, their verification, and windowed counts of events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusq.operators.grounding import shown_lines


def split_lines(held: str, deltas: list[str]) -> tuple[list[str], str]:
    """(lines completed by the deltas, text still waiting for its line break)."""
    *lines, held = (held + "".join(deltas)).split("\n")
    return lines, held


def completed_lines(deltas: DataFrame, timeout_ms: int = 600_000) -> DataFrame:
    """answer_id, line_no, line of a stream (or table) of answer_id, seq, delta, last (boolean).

    The state of an answer is its unfinished line and its next line number. The unfinished line is emitted when
    ``last`` arrives, or when an answer has been silent for ``timeout_ms``; the state then goes.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, number, ended = "", 0, state.hasTimedOut
        if state.exists:
            held, number = state.get
        rows = pd.concat(list(parts)) if not ended else pd.DataFrame({"seq": [], "delta": [], "last": []})
        rows = rows.sort_values("seq")
        lines, held = split_lines(held, rows["delta"].tolist())
        ended = ended or bool(rows["last"].any())
        if ended:
            lines += [held] if held else []
            state.remove()
        else:
            state.update((held, number + len(lines)))
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({"answer_id": [key[0]] * len(lines), "line_no": range(number, number + len(lines)), "line": lines})

    return deltas.groupBy("answer_id").applyInPandasWithState(step, "answer_id string, line_no int, line string", "held string, number int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def batch_lines(deltas: DataFrame) -> DataFrame:
    """The same lines from a finished table of deltas: answer_id, line_no, line; answers are small groups."""
    whole = deltas.groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "delta"))), lambda x: x["delta"]), "").alias("text"))
    lines = whole.select("answer_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"), F.size(F.split("text", "\n")).alias("n"))
    return lines.where((F.col("line") != "") | (F.col("line_no") < F.col("n") - 1)).drop("n")


def verified_lines(deltas: DataFrame, sources: DataFrame, emit: Callable[[DataFrame], None], timeout_ms: int = 600_000) -> DataStreamWriter:
    """A writer of the stream's lines that gives ``emit`` each batch of completed lines after verification only.

    Sources (answer_id, number, text) are a table. Emitted: answer_id, line_no, text; lines nothing of which is
    supported do not appear. A line is checked on its own, so nothing waits for the rest of its answer.
    """

    def check(batch: DataFrame, _: int) -> None:
        known = sources.join(batch.select("answer_id").distinct(), "answer_id", "left_semi")
        emit(shown_lines(batch, known).where("text is not null").select("answer_id", "line_no", "text"))

    return completed_lines(deltas, timeout_ms).writeStream.outputMode("append").foreachBatch(check)


def windowed_counts(events: DataFrame, time_col: str, key: str, size: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Events per key and tumbling window; on a stream, rows later than ``late`` are dropped by the watermark."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, size).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
