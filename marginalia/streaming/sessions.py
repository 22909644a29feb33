"""Session logs as streams: segments by user turn, resume offsets, windows over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

#: Sources of user messages that no user wrote.
SKIPPED_SOURCES = ("user-approval", "plugin:openviking-memory", "system")
SEGMENT = "session string, start_seq long, asked string, n_texts int, n_tools int"


def flat_events(events: DataFrame) -> DataFrame:
    """Raw events to (session, seq, kind, text): user, assistant, tool or end; injected user messages are left out."""
    join = lambda c: F.array_join(F.transform(F.filter(c, lambda x: x["text"].isNotNull()), lambda x: x["text"]), "\n")
    kind = F.when(F.col("type") == "user/message", "user").when(F.col("type") == "assistant/message", "assistant").when(F.col("type") == "tool/call", "tool").when(F.col("type") == "session/end-seed", "end")
    text = F.when(kind == "user", join(F.col("data.content"))).when(kind == "assistant", join(F.col("data.message.content"))).when(kind == "tool", F.col("data.name"))
    injected = F.coalesce(F.col("data.source.kind"), F.lit("")).isin(*SKIPPED_SOURCES) & (F.col("type") == "user/message")
    keep = events.where(~injected)
    return keep.select("session", "seq", kind.alias("kind"), F.trim(F.coalesce(text, F.lit(""))).alias("text")).where("kind = 'end' OR (kind IS NOT NULL AND text <> '')")


def segments(events: DataFrame, session: str = "session", seq: str = "seq", offsets: DataFrame | None = None) -> DataFrame:
    """(session, start_seq, asked, texts, n_tools): each user turn with what follows it.

    Events up to a session's saved offset are skipped, as is what follows an end mark after the first user turn. The running
    count of user turns is the group id, one window by session.
    """
    if offsets is not None:
        events = events.join(offsets.select(session, "offset"), session, "left").where(F.col(seq) > F.coalesce("offset", F.lit(0)))
    w = Window.partitionBy(session).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = events.withColumn("__turn", F.sum(F.when(F.col("kind") == "user", 1).otherwise(0)).over(w)).withColumn("__ended", F.max(F.when((F.col("kind") == "end") & (F.col("__turn") > 0), 1).otherwise(0)).over(w))
    live = turns.where("__turn > 0 AND __ended = 0")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "assistant", F.struct(F.col(seq).alias("s"), "text")))), lambda s: s["text"]), "\n\n")
    return live.groupBy(session, "__turn").agg(
        F.min(seq).alias("start_seq"), F.substring(F.min_by("text", seq), 1, 800).alias("asked"), said.alias("body"),
        F.sum(F.when(F.col("kind") == "assistant", 1).otherwise(0)).cast("int").alias("n_texts"), F.sum(F.when(F.col("kind") == "tool", 1).otherwise(0)).cast("int").alias("n_tools"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "tool", F.col("text")))).alias("tools"),
    ).drop("__turn")


def saved_offsets(segments_: DataFrame, session: str = "session") -> DataFrame:
    """The start of the last segment: what is read on the next scan begins after it."""
    return segments_.groupBy(session).agg(F.max("start_seq").alias("offset"))


#: Words of a text that reports results, and of one that works with documents.
SIGNALS = "有效 无效 失败 成功 收敛 发散 误差 精度 试了 试过 尝试 结果 对比 改进 问题 原因是 不work 不行 有用 没用 效果 提升 下降 effective ineffective failed worked improved worse better converge diverge error".split()
DOC_WORDS = "文献 论文 文章 这篇 那篇 作者 DOI 摘要 知识库 引用 参考文献 标注 高亮 笔记".split()


def looks_promising(text):
    """Whether a text has a word that reports results, in any case."""
    return F.lower(text).rlike("|".join(w.lower() for w in SIGNALS))


def is_doc_work(text, tools=None, tool_names: tuple[str, ...] = (), words: tuple[str, ...] = ()):
    """Whether a segment works with documents: by a tool called, or a word of its text. Both lists may be added to."""
    said = text.rlike("|".join([*DOC_WORDS, *words]))
    return said if tools is None or not tool_names else said | F.arrays_overlap(tools, F.array(*map(F.lit, tool_names)))


def head_tail(text, limit: int = 8000):
    """Both ends of a long text, half the limit each."""
    half = limit // 2
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, half), F.lit("\n\n…\n\n"), F.right(text, F.lit(half))))


def _advance(idle_ms: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """State: (last seq seen, start of the open segment, its question, texts and tools so far, whether the session has ended)."""
        last, start, asked, texts, tools, ended = state.get if state.exists else (-1, -1, "", 0, 0, False)
        done = []
        if state.hasTimedOut:
            done, start = ([(key[0], start, asked, texts, tools)] if start >= 0 else []), -1
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("seq")
            for seq, kind, text in zip(rows["seq"], rows["kind"], rows["text"]):
                if seq <= last or ended:
                    continue
                last = int(seq)
                if start >= 0 and kind in ("user", "end"):
                    done.append((key[0], start, asked, texts, tools))
                if kind == "user":
                    start, asked, texts, tools = int(seq), str(text)[:800], 0, 0
                elif kind == "end":
                    start, ended = -1, start >= 0
                elif start >= 0:
                    texts += kind == "assistant"
                    tools += kind == "tool"
            state.update((last, start, asked, texts, tools, ended))
            state.setTimeoutDuration(idle_ms)
        if done:
            yield pd.DataFrame(done, columns=["session", "start_seq", "asked", "n_texts", "n_tools"])

    return run


def stream_segments(events: DataFrame, idle_ms: int = 3_600_000) -> DataFrame:
    """Segments of a stream of (session, seq, kind, text), each emitted when the next user turn or the end mark comes,
    or when its session has been idle for ``idle_ms``, which also drops the session's state.

    The open segment is state, kept by the checkpoint; events at or before a session's last
    sequence number are dropped.
    """
    state = "last long, start long, asked string, texts int, tools int, ended boolean"
    return events.groupBy("session").applyInPandasWithState(_advance(idle_ms), SEGMENT, state, "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, ts: str = "ts", late: str = "10 minutes", size: str = "1 hour", slide: str | None = None, by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Tumbling or sliding event-time windows with a watermark."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(w, *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def session_windows(events: DataFrame, ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes", by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n"))
