"""Audio-chunk streams: validation, de-duplication, running time, silence and phrases."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from confab.operators.blocks import Scan, running

MAX_CHUNK_BYTES = 960_000
SAMPLES_PER_MS = 16
SPEECH_RMS = 0.012
SILENT_RMS = 0.0015
# Fixed values per latency profile: shortest, longest and closing silence in seconds.
LATENCY = {"ultra": (0.58, 1.05, 0.18), "balanced": (0.78, 1.45, 0.24), "stable": (1.1, 2.15, 0.32)}
IDLE_MS = 10 * 60 * 1000


def timer(chunks: DataFrame, idle_ms: int | None) -> tuple[DataFrame, str]:
    """With ``idle_ms`` a session's state ends once event time (column ts) has passed it by that much."""
    if idle_ms is None:
        return chunks, GroupStateTimeout.NoTimeout
    return chunks.withWatermark("ts", f"{idle_ms} milliseconds"), GroupStateTimeout.EventTimeTimeout


def arm(state: GroupState, g: pd.DataFrame, idle_ms: int | None) -> None:
    if idle_ms is not None:
        last = int(g["ts"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1) + idle_ms)


def chunk_status(chunk_id: Column, pcm_base64: Column) -> Column:
    """ok, or why a chunk is refused."""
    strict = pcm_base64.rlike("^[A-Za-z0-9+/]*={0,2}$") & (F.length(pcm_base64) % 4 == 0)
    size = F.length(F.try_to_binary(F.when(strict, pcm_base64), F.lit("base64")))
    return (F.when(chunk_id < 0, "bad_id").when(~F.coalesce(strict, F.lit(False)) | size.isNull(), "bad_base64")
            .when((size == 0) | (size % 2 == 1) | (size > MAX_CHUNK_BYTES), "bad_size").otherwise("ok"))


def validate_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("status", chunk_status(F.col("chunk_id"), F.col("pcm_base64")))


def ingest_chunks(chunks: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Recorded time per session (update mode): repeats of a chunk count once.

    ``chunks``: session_id, chunk_id, ts, samples.
    """
    once = chunks.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["session_id", "chunk_id"])
    total = F.sum("samples")
    return once.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("chunks"), total.alias("samples"),
        F.bround(total / SAMPLES_PER_MS).cast("long").alias("duration_ms"))


VERDICT = "session_id long, arrival long, chunk_id long, verdict string, duplicate boolean, duration_ms long"


class Ingest(StatefulProcessor):
    """One session: the chunks taken within ``late_ms`` of the newest, and the samples so far; forgotten by a timer after ``idle_ms`` without a chunk.

    All of it is one value, read and written once a micro-batch: an entry a chunk would be a call to the state store for each.
    """

    def __init__(self, late_ms: int, idle_ms: int | None):
        self.late_ms, self.idle_ms = late_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "samples long, newest long, chunks array<long>, times array<long>")

    def handleInputRows(self, key, rows, timerValues):
        samples, newest, held, held_at = self.open.get() or (0, -(1 << 62), [], [])
        taken = dict(zip(held, held_at))
        answers = []
        for r in sorted(rows, key=lambda r: r.arrival):
            chunk, ts, status = r.chunk_id, r.ts_ms, r.status
            if status == "ok":
                newest = max(newest, ts)
                status = "late" if ts < newest - self.late_ms else "duplicate" if chunk in taken else "ok"
                if status == "ok":
                    taken[chunk] = ts
                    samples += r.samples
            answers.append(Row(session_id=key[0], arrival=r.arrival, chunk_id=chunk, verdict=status, duplicate=status == "duplicate",
                               duration_ms=round(samples / SAMPLES_PER_MS)))
        kept = {c: t for c, t in taken.items() if t >= newest - self.late_ms}  # a repeat of any other chunk is late itself
        self.open.update((samples, newest, list(kept), list(kept.values())))
        if self.idle_ms is not None:
            for timer_ms in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer_ms)
            self.handle.registerTimer(max(newest, timerValues.getCurrentWatermarkInMs() + 1) + self.idle_ms)
        yield from answers

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.open.clear()
        yield from ()

    def close(self) -> None:
        pass


def chunk_verdicts(chunks: DataFrame, late_ms: int = IDLE_MS, idle_ms: int | None = 24 * 3600 * 1000) -> DataFrame:
    """Stream of one answer per chunk: its verdict (ok, duplicate, late or why it is refused) and the time recorded so far.

    ``chunks``: session_id, arrival (order), chunk_id, ts_ms (a repeat keeps its chunk's), samples, status (of :func:`chunk_status`).
    A chunk more than ``late_ms`` behind the newest one of its session is late, so no older ids have to be known. With ``idle_ms`` a
    session is forgotten once event time has passed its newest chunk by that much (chunks further behind the whole stream get no answer).
    """
    if idle_ms is not None:
        chunks = chunks.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", f"{idle_ms} milliseconds")
    return chunks.groupBy("session_id").transformWithState(
        Ingest(late_ms, idle_ms), VERDICT, "Append", "None" if idle_ms is None else "EventTime")


def chunk_verdicts_batch(chunks: DataFrame, late_ms: int = IDLE_MS) -> DataFrame:
    """The same over a stored table, from running values over blocks of arrivals."""
    key, block = ["session_id"], F.floor(F.col("arrival") / 65_536)
    fit = F.col("status") == "ok"
    c = running(chunks, key, block, ["arrival"], [Scan("newest", F.when(fit, F.col("ts_ms")), "max")])
    c = c.withColumn("verdict", F.when(~fit, F.col("status")).when(F.col("ts_ms") < F.col("newest") - late_ms, "late").otherwise("ok"))
    first = c.where(F.col("verdict") == "ok").groupBy("session_id", "chunk_id").agg(F.min("arrival").alias("first"))
    c = c.join(first, ["session_id", "chunk_id"], "left")
    again = (F.col("verdict") == "ok") & (F.col("arrival") > F.col("first"))
    c = c.withColumn("verdict", F.when(again, "duplicate").otherwise(F.col("verdict")))
    counted = F.when(F.col("verdict") == "ok", F.col("samples")).otherwise(0)
    c = running(c, key, block, ["arrival"], [Scan("total", counted, "sum")])
    return c.select("session_id", "arrival", "chunk_id", "verdict", (F.col("verdict") == "duplicate").alias("duplicate"),
                    F.bround(F.col("total") / SAMPLES_PER_MS).cast("long").alias("duration_ms"))


def _rows(pdfs: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A session's rows of one micro-batch in chunk order; the source's trigger limit bounds them."""
    return pd.concat(list(pdfs), ignore_index=True).sort_values("chunk_id", kind="stable")


def silence_gate(chunks: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Chunks that carry sound, with their offset; silent ones only move the time on."""
    chunks, timeout = timer(chunks, idle_ms)

    def step(key, pdfs, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        (written,) = state.get if state.exists else (0,)
        g = _rows(pdfs)
        ends = written + g["samples"].cumsum()
        state.update((int(ends.iloc[-1]),))
        arm(state, g, idle_ms)
        out = pd.DataFrame({"session_id": key[0], "chunk_id": g["chunk_id"], "offset": ends - g["samples"], "end": ends})
        yield out[(g["rms"] >= SILENT_RMS).to_numpy()]

    s = chunks.groupBy("session_id").applyInPandasWithState(
        step, "session_id long, chunk_id long, offset long, end long", "written long", "append",
        timeout)
    ms = lambda c: F.bround(F.col(c) / SAMPLES_PER_MS).cast("long")
    return s.select("session_id", "chunk_id", ms("offset").alias("offset_ms"), ms("end").alias("duration_ms"))


class Phrases:
    """State of one session's phrase cutting."""

    def __init__(self, latency: str, start: int = 0, samples: int = 0, silence: int = 0, heard: bool = False, n: int = 0):
        self.shortest, self.longest, self.closing = (round(s * 16_000) for s in LATENCY[latency])
        self.start, self.samples, self.silence, self.heard, self.n = start, samples, silence, heard, n

    def push(self, samples: int, rms: float):
        self.samples += samples
        if rms >= SPEECH_RMS:
            self.heard, self.silence = True, 0
        elif self.heard:
            self.silence += samples
        spoken = self.heard and self.samples >= self.shortest and self.silence >= self.closing
        return self.flush() if spoken or self.samples >= self.longest else None

    def flush(self):
        if not self.samples:
            return None
        out = (self.n, self.start, self.samples)
        self.start, self.samples, self.silence, self.heard, self.n = self.start + self.samples, 0, 0, False, self.n + 1
        return out

    def values(self):
        return self.start, self.samples, self.silence, self.heard, self.n


PHRASE = "session_id long, phrase long, start_sample long, samples long"


def _phrase_frame(session, found) -> pd.DataFrame:
    return pd.DataFrame([(session, *f) for f in found if f], columns=["session_id", "phrase", "start_sample", "samples"])


def phrase_segments(chunks: DataFrame, latency: str = "balanced", idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Phrases closed by silence or length; an idle session's last phrase comes out by timer."""
    chunks, timeout = timer(chunks, idle_ms)

    def step(key, pdfs, state: GroupState):
        p = Phrases(latency, *(state.get if state.exists else ()))
        if state.hasTimedOut:
            state.remove()
            yield _phrase_frame(key[0], [p.flush()])
            return
        g = _rows(pdfs)
        found = [p.push(s, r) for s, r in zip(g["samples"], g["rms"])]
        state.update(tuple(int(v) if not isinstance(v, bool) else v for v in p.values()))
        arm(state, g, idle_ms)
        yield _phrase_frame(key[0], found)

    return chunks.groupBy("session_id").applyInPandasWithState(
        step, PHRASE, "start long, samples long, silence long, heard boolean, n long", "append",
        timeout)


def phrase_segments_batch(chunks: DataFrame, latency: str = "balanced") -> DataFrame:
    """The same cut over a stored table: sessions are streamed through, open phrases stay out."""
    def walk(batches):
        here, p = None, None
        for pdf in batches:
            rows = []
            for session, samples, rms in zip(pdf["session_id"], pdf["samples"], pdf["rms"]):
                if session != here:
                    here, p = session, Phrases(latency)
                f = p.push(int(samples), float(rms))
                if f:
                    rows.append((session, *f))
            yield pd.DataFrame(rows, columns=["session_id", "phrase", "start_sample", "samples"])

    c = chunks.select("session_id", "chunk_id", "samples", "rms")
    return c.repartition("session_id").sortWithinPartitions("session_id", "chunk_id").mapInPandas(walk, PHRASE)


CLOSED = "session_id long, last_ms long, chunks long"


class Closing(StatefulProcessor):
    """One session: its newest moment and how much has come; a timer closes it ``idle_ms`` after that."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "last_ms long, chunks long")

    def handleInputRows(self, key, rows, timerValues):
        last, chunks = self.open.get() if self.open.exists() else (-(1 << 62), 0)
        for g in rows:
            last, chunks = max(last, int(g["ts_ms"].max())), chunks + len(g)
        self.open.update((last, chunks))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(max(last + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(columns=["session_id", "last_ms", "chunks"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last, chunks = self.open.get()
        self.open.clear()
        yield pd.DataFrame({"session_id": [key[0]], "last_ms": [last], "chunks": [chunks]})

    def close(self) -> None:
        pass


def closed_sessions(rows: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """Stream of sessions (session_id, last_ms, chunks) that event time has passed by ``idle_ms``; ``rows``: session_id, ts_ms.

    A session that speaks again after it was closed is a new one and closes again.
    """
    timed = rows.select("session_id", "ts_ms", F.timestamp_millis("ts_ms").alias("ts")).withWatermark("ts", "0 seconds")
    return timed.groupBy("session_id").transformWithStateInPandas(Closing(idle_ms), CLOSED, "Append", "EventTime")
