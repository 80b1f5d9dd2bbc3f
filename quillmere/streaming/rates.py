"""Rates over event streams: accepted requests, sliding counts, sessions and tumbling windows, for batch and streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def accept(times: list[int], limit: int, span: int, held: list[int]) -> tuple[list[bool], list[int]]:
    """Which requests are accepted, in time order, and the accepted ones still held: an entry expires when t <= now - span."""
    out = []
    for now in times:
        held = [t for t in held if t > now - span]
        out.append(limit == 0 or len(held) < limit)
        if out[-1]:
            held.append(now)
    return out, held


def rate_limited(events: DataFrame, client: str, at_us: str, tie: str, limit: int, span_us: int) -> DataFrame:
    """Adds accepted: at most `limit` accepted requests of a client within any span.

    Clients' requests stream through in time order; only the accepted times still held (`limit` at most) are kept.
    Requests without a time come last and are accepted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            good = []
            for who, now in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if who != current:
                    current, held = who, []
                if now is None or limit == 0:
                    good.append(True)
                else:
                    one, held = accept([now], limit, span_us, held)
                    good += one
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(good, pa.bool_())], names=["client", "tie", "at", "accepted"])

    rows = events.select(F.col(client).cast("long").alias("client"), F.col(tie).cast("long").alias("tie"), F.col(at_us).cast("long").alias("at"))
    ordered = rows.repartition("client").sortWithinPartitions("client", F.asc_nulls_last("at"), F.asc_nulls_last("tie"))
    return ordered.mapInArrow(run, "client long, tie long, at long, accepted boolean").select(F.col("client").alias(client), F.col("tie").alias(tie), "accepted")


def rate_limited_stream(events: DataFrame, client: str, at_us: str, tie: str, limit: int, span_us: int) -> DataFrame:
    """The same over a stream: the state of a client is the times of its accepted requests, `limit` at most."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(["at", "tie"])
        good, held = accept(pdf["at"].tolist(), limit, span_us, held)
        state.update((held,))
        yield pdf.assign(accepted=good)[["client", "tie", "at", "accepted"]]

    rows = events.select(F.col(client).alias("client"), F.col(tie).alias("tie"), F.col(at_us).alias("at"))
    return rows.groupBy("client").applyInPandasWithState(run, "client long, tie long, at long, accepted boolean", "held array<bigint>", "append", GroupStateTimeout.NoTimeout)


def sliding_counts(events: DataFrame, client: str, at_us: str, span_us: int) -> DataFrame:
    """Adds n_recent: the client's requests in (at - span, at]."""
    return events.withColumn("n_recent", F.count("*").over(Window.partitionBy(client).orderBy(at_us).rangeBetween(-span_us + 1, 0)))


def sessions(events: DataFrame, client: str, at_us: str, gap_us: int) -> DataFrame:
    """(client, start_us, end_us, n): runs of requests with steps below the gap."""
    order = Window.partitionBy(client).orderBy(at_us)
    marked = events.withColumn("_new", F.when(F.col(at_us) - F.lag(at_us).over(order) < gap_us, 0).otherwise(1)).withColumn("_s", F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(client, "_s").agg(F.min(at_us).alias("start_us"), F.max(at_us).alias("end_us"), F.count("*").alias("n")).drop("_s")


def tumbling(events: DataFrame, ts: str, width: str, by: list[str], late: str | None = None) -> DataFrame:
    """(window_start, by, n, total): counts and sums by window; `late` sets a watermark for streams."""
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.window(ts, width).alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")
