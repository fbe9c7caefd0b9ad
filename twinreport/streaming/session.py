"""Sessions that edit a report: an ordered log of commands folded into a state, in batch or as a stream.

Commands: set_report_info (text), set_report_basic_info (text; keeps what was added), add_penalty, add_exclude, add_skip_term,
do_submit, do_cancel. Within a message (session, seq) all set-commands come before do-commands. A session ends with its
first do_submit or do_cancel; later commands are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings

ENDS = ("do_submit", "do_cancel")
ADDS = {"add_penalty": "penalty", "add_exclude": "exclude", "add_skip_term": "skip"}
SETS = ("set_report_info", "set_report_basic_info")
STATE = "session_id long, report string, penalty array<string>, exclude array<string>, skip array<string>, ended string, n_commands long"


def fold(commands: DataFrame) -> DataFrame:
    """The state of each session after all its commands (session_id, seq, command, argument), by aggregation alone."""
    is_do = F.col("command").startswith("do_")
    rows = commands.withColumn("__at", F.struct("seq", is_do.alias("late"), "command", "argument"))
    end = F.min(F.when(F.col("command").isin(*ENDS), F.col("__at"))).alias("__end")
    reset = F.max(F.when(F.col("command") == "set_report_info", F.col("__at")))
    ends = rows.groupBy("session_id").agg(end)
    alive = rows.join(ends, "session_id").filter(F.col("__end").isNull() | (F.col("__at") <= F.col("__end")))
    resets = alive.groupBy("session_id").agg(reset.alias("__reset"))
    alive = alive.join(resets, "session_id")
    kept = lambda c: F.array_sort(F.collect_set(F.when((F.col("command") == c) & (F.col("__reset").isNull() | (F.col("__at") > F.col("__reset"))), F.col("argument"))))
    return alive.groupBy("session_id").agg(
        F.max(F.when(F.col("command").isin(*SETS), F.col("__at")))["argument"].alias("report"),
        *[kept(c).alias(name) for c, name in ADDS.items()],
        F.max("__end.command").alias("ended"),
        F.count(F.lit(1)).alias("n_commands"),
    )


def step(state: dict, command: str, argument: str | None) -> dict:
    """The state after one command."""
    if state["ended"]:
        return state
    state = {**state, "n_commands": state["n_commands"] + 1}
    if command == "set_report_info":
        state |= {"report": argument, "penalty": [], "exclude": [], "skip": []}
    elif command == "set_report_basic_info":
        state |= {"report": argument}
    elif command in ADDS and argument is not None:
        state |= {ADDS[command]: sorted({*state[ADDS[command]], argument})}
    elif command in ENDS:
        state |= {"ended": command}
    return state


def stream(commands: DataFrame, timeout: str = "1 hour") -> DataFrame:
    """The state of each session after each batch of a stream of commands; a session without commands for so long is dropped."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    fields = ["report", "penalty", "exclude", "skip", "ended", "n_commands"]
    milliseconds = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def update(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state = dict(zip(fields, held.get, strict=True)) if held.exists else {"report": None, "penalty": [], "exclude": [], "skip": [], "ended": None, "n_commands": 0}
        state |= {k: list(state[k]) for k in ADDS.values()}
        rows = pd.concat(list(frames))
        rows["late"] = rows["command"].str.startswith("do_")
        for r in rows.sort_values(["seq", "late", "command", "argument"], na_position="first").itertuples():
            state = step(state, r.command, r.argument)
        held.update(tuple(state[f] for f in fields))
        held.setTimeoutDuration(milliseconds)
        yield pd.DataFrame([{"session_id": key[0], **state}])

    return commands.groupBy("session_id").applyInPandasWithState(update, STATE, STATE.replace("session_id long, ", ""), "update", GroupStateTimeout.ProcessingTimeTimeout)


#: The state store that timers and lists of `ordered` need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ordered(commands: DataFrame, delay: str = "10 minutes", idle: str = "1 day", time: str = "at") -> DataFrame:
    """The state of each session of a stream whenever commands of it are folded, in their order, however they arrived.

    commands: session_id, seq, command, argument and a time. A command is held until the watermark, `delay` behind the
    latest time seen, has passed its time: all commands of earlier times are there by then, and what has passed is folded
    by seq as `fold` does. So the last state of a session is that of `fold`, for any batches whose commands come no later
    than the delay. A session without commands for `idle` is let go; commands later than the delay are dropped.
    """
    from pyspark.sql.streaming import StatefulProcessor

    fields = ["report", "penalty", "exclude", "skip", "ended", "n_commands"]
    held_schema = "at long, seq long, command string, argument string"
    keep = int(pd.Timedelta(idle).total_seconds() * 1000)

    class Ordered(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.held = handle.getListState("held", held_schema)
            self.state = handle.getValueState("state", STATE.replace("session_id long, ", "") + ", last long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            times = set()
            for frame in rows:
                found = [(int(r.at), int(r.seq), r.command, r.argument) for r in frame[["at", "seq", "command", "argument"]].astype(object).where(frame.notna(), None).itertuples()]
                if found:
                    self.held.appendList(found)
                    times |= {f[0] for f in found}
            for t in times:
                self.handle.registerTimer(t)
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            passed = timerValues.getCurrentWatermarkInMs()
            held = list(self.held.get()) if self.held.exists() else []
            old = self.state.get() if self.state.exists() else None
            due = [h for h in held if h[0] <= passed]
            if not due:
                if old is not None and not held and old[-1] + keep <= passed:
                    self.state.clear()
                return
            rest = [tuple(h) for h in held if h[0] > passed]
            if rest:
                self.held.put(rest)
            else:
                self.held.clear()
            state = dict(zip(fields, old, strict=False)) if old is not None else {"report": None, "penalty": [], "exclude": [], "skip": [], "ended": None, "n_commands": 0}
            state |= {k: list(state[k]) for k in ADDS.values()}
            for _, _, command, argument in sorted(due, key=lambda h: (h[1], h[2].startswith("do_"), h[2], h[3] is not None, h[3] or "")):
                state = step(state, command, argument)
            last = max([h[0] for h in due] + [old[-1] if old is not None else 0])
            self.state.update((*[state[f] for f in fields], last))
            self.handle.registerTimer(last + keep)
            yield pd.DataFrame([{"session_id": key[0], **state}])

        def close(self) -> None:
            pass

    spark = commands.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STORE:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = commands.withWatermark(time, delay).select("session_id", "seq", "command", "argument", F.col(time).alias("__time"))
    rows = rows.withColumn("at", F.unix_millis("__time"))
    return rows.groupBy("session_id").transformWithStateInPandas(Ordered(), STATE, "Update", "EventTime")


def respond(states: DataFrame, text_limit: int = 512, settings: Settings | None = None, link: str = "") -> DataFrame:
    """What a session answers: its report, cut to the limit, and its lists; with settings also how many sentences and
    duplicates it shows at most, and the link under which reports are found."""
    from ..functions.text import truncated

    rows = states.select("session_id", truncated(F.col("report"), text_limit).alias("report"), "penalty", "exclude", "skip", "ended")
    if settings is None:
        return rows
    limits = {"max_sentences": F.lit(settings.bug_sentence_number), "max_duplicates": F.lit(settings.bug_duplicate_number), "link": F.lit(link)}
    return rows.withColumns(limits)
