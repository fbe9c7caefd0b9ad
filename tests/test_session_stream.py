"""Sessions as an event-time stream against the fold of all commands."""

import datetime as dt
import random

from pyspark.sql import functions as F

from twinreport.streaming import session


def test_stream_of_shuffled_batches_is_the_fold(spark, tmp_path):
    r = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    kinds = ["set_report_info", "set_report_basic_info", "add_penalty", "add_exclude", "add_skip_term", "add_penalty", "do_recommend"]
    rows = []
    for sid in range(12):
        at = start + dt.timedelta(minutes=r.randrange(30))
        for seq in range(r.randrange(1, 15)):
            at += dt.timedelta(seconds=r.randrange(1, 240))
            command = r.choice(["do_submit", "do_cancel"]) if r.random() < 0.08 else r.choice(kinds)
            rows.append((sid, seq, command, r.choice(["a", "b", "c", None]) if command != "do_submit" else None, at))
    # What comes is in disorder by less than the delay.
    rows.sort(key=lambda x: x[4] + dt.timedelta(seconds=r.randrange(0, 550)))
    cuts = sorted(r.sample(range(len(rows)), 3))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    later = start + dt.timedelta(days=9)
    batches += [[(-1, 0, "add_penalty", "x", later)], [(-1, 1, "add_penalty", "y", later + dt.timedelta(days=1))], [(-1, 2, "add_penalty", "z", later + dt.timedelta(days=2))]]
    schema = "session_id long, seq long, command string, argument string, at timestamp"
    folder, seen = str(tmp_path / "in"), {}
    fields = ["report", "penalty", "exclude", "skip", "ended", "n_commands"]

    def keep(df, _):
        for x in df.collect():
            seen[x["session_id"]] = tuple(tuple(x[f]) if isinstance(x[f], list) else x[f] for f in fields)

    spark.createDataFrame([], schema).write.parquet(folder)
    commands = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = session.ordered(commands, "10 minutes")
    assert out.columns == ["session_id", *fields]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
        query = out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        assert query.exception() is None
    want = session.fold(spark.createDataFrame(rows, schema).select("session_id", "seq", "command", "argument"))
    want = {x["session_id"]: tuple(tuple(x[f]) if isinstance(x[f], list) else x[f] for f in fields) for x in want.select("session_id", *[F.col(f) for f in fields]).collect()}
    seen.pop(-1, None)
    assert seen == want


def test_answer_holds_the_limits(spark):
    from twinreport.config import Settings

    states = spark.createDataFrame([(1, "x" * 600, ["a"], [], [], None, 1)], session.STATE)
    r = session.respond(states, 10, Settings(bug_sentence_number=4), "https://reports/%d").first()
    assert r["report"] == "x" * 10 + " ..." and (r["max_sentences"], r["max_duplicates"], r["link"]) == (4, 5, "https://reports/%d")
    assert session.respond(states).columns == ["session_id", "report", "penalty", "exclude", "skip", "ended"]
