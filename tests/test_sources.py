from pyspark.sql import functions as F

from twinreport.config import Settings
from twinreport.plans import build
from twinreport.sources import reports
from twinreport.sources.store import Store, lookup
from twinreport.streaming import session

LEVEL1 = [
    "x;Bug#=1;short_desc=Crash &ltSEMICOLONNOW&gtSEMICOLON;long:1:text=It broke.NEWLINEBadly;resolution=FIXED;product=App;creation_ts=50",
    "x;Bug#=2;short_desc=a;short_desc=Last;long:1:text=t;resolution=INCOMPLETE;product=App;creation_ts=51",
    "x;Bug#=3;short_desc=none;long:1:text=t;product=App",
    "x;Bug#=4;short_desc=s;long:1:text=#1 0x12345678 in f;resolution=FIXED;product=App;creation_ts=52",
]
LEVEL0 = """<bugzilla>
<bug>
  <bug_id>10</bug_id>
  <dup_id>11</dup_id>
</bug>
<bug>
  <bug_id>12</bug_id>
  <resolution>INCOMPLETE</resolution>
  <dup_id>11</dup_id>
</bug>
<bug>
  <bug_id>13</bug_id>
  <dup_id>12</dup_id>
  <resolution>INCOMPLETE</resolution>
</bug>
"""


def lines(spark, rows, name="value"):
    return spark.createDataFrame([(r,) for r in rows], f"{name} string")


def test_level1(spark):
    text, basic = reports.parse_level1(lines(spark, LEVEL1), Settings())
    assert [tuple(r) for r in text.collect()] == [(1, "crash <now>", "it broke.\nbadly", [])]
    assert [tuple(r) for r in basic.collect()] == [(1, 50, "app")]


def test_dumps(spark):
    assert [tuple(r) for r in reports.parse_dump(lines(spark, ["7|Sum|Desc", "bad"])).collect()] == [(7, "Sum", "Desc", []), (None, None, None, [])]
    assert [tuple(r) for r in reports.parse_dump_basic(lines(spark, ["7|app|99"])).collect()] == [(7, 99, "app")]
    assert [tuple(r) for r in reports.parse_dump_duplicates(lines(spark, ["1|2", "x|3"])).collect()] == [(1, 2)]


def test_level0(spark, tmp_path):
    path = tmp_path / "raw.xml"
    path.write_text(LEVEL0)
    links, bad = reports.read_level0(spark, str(path))
    assert {tuple(r) for r in links.collect()} == {(10, 11), (13, 12)}
    assert {r.bug_id for r in bad.collect()} == {12, 13}


def test_lines_round_trip(spark):
    schema = "create_ts long, product string, summ string, desc string, stacktrace array<array<string>>, penalty array<string>, dummy_bug_id long, exclude_ids array<long>, skip_terms array<string>"
    df = spark.createDataFrame([(12345, "core", "a;b", "words\nmore", [["f", "g"]], ["p", "q"], 9, [100100], ["s"]), (None, None, None, None, None, None, None, None, None)], schema)
    one, two = reports.from_line(reports.to_line(df)).collect()
    assert (one.create_ts, one.product, one.summ, one.desc.strip(), one.penalty, one.dummy_bug_id, one.exclude_ids, one.skip_terms) == (12345, "core", "a;b", "words\nmore", ["p", "q"], 9, [100100], ["s"])
    assert one.stacktrace == [["unknown", "f", "g"]]
    assert two.create_ts is None and two.penalty == [] and two.exclude_ids == []
    numbered = reports.to_line(df).withColumn("line_no", F.monotonically_increasing_id())
    assert reports.find_line(numbered, 9).count() == 1 and reports.find_line(numbered, 8).count() == 0
    short = reports.from_line(lines(spark, ["5;core;only"], "line")).first()
    assert short.summ == "only" and short.skip_terms == []


def test_store_and_build(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.status("t") == (None, None)
    df = spark.createDataFrame([(1, "a"), (2, "b")], "bug_id long, x string")
    store.write("t", df)
    assert store.status("t")[1] is True
    store.append("t", spark.createDataFrame([(3, "c")], "bug_id long, x string"))
    assert store.remove("t", F.col("bug_id") == 1).count() == 2
    assert store.remove_ids("t", df).count() == 1
    got = lookup(store.read("t"), spark.createDataFrame([(3,), (4,)], "bug_id long"), {"x": F.lit("")})
    assert {tuple(r) for r in got.collect()} == {(3, "c"), (4, "")}
    assert store.clean("t").count() == 0

    one, zero = tmp_path / "level1", tmp_path / "level0"
    one.write_text("\n".join(LEVEL1))
    zero.write_text(LEVEL0)
    made = build.artefacts(store, str(one), str(zero), Settings())
    assert made["tfidf"].refresh() and made["duplicate_group"].refresh()
    assert not made["tfidf"].refresh()
    assert store.read("tfidf").count() > 0 and store.read("duplicate_group").count() == 2
    tables = {"text": store.read("text"), "tfidf": store.read("tfidf"), "termcount": store.read("termcount")}
    left = build.remove_bad_reports(tables, Settings(drop_report_regexp="broke"))
    assert left["text"].count() == 0 and left["tfidf"].count() == 0 and left["termcount"].count() > 0


COMMANDS = [
    (1, 1, "set_report_info", "first"), (1, 2, "add_penalty", "p"), (1, 3, "set_report_basic_info", "second"), (1, 3, "add_exclude", "5"),
    (1, 4, "do_submit", None), (1, 5, "add_penalty", "late"), (2, 1, "add_skip_term", "s"), (2, 2, "set_report_info", "x"), (2, 3, "add_skip_term", "t"),
]
WANT = {(1, "second", ("p",), ("5",), (), "do_submit", 5), (2, "x", (), (), ("t",), None, 3)}
SCHEMA = "session_id long, seq long, command string, argument string"


def test_store_update_and_distinct(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.write("t", spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "bug_id long, product string"))
    got = store.update("t", spark.createDataFrame([(2, "c"), (4, "d")], "bug_id long, product string"))
    assert {tuple(r) for r in got.collect()} == {(1, "a"), (2, "c"), (3, "b"), (4, "d")}
    assert {r.product for r in store.distinct("t", "product").collect()} == {"a", "b", "c", "d"}


def test_pasted_stack_goes_under_the_header(spark):
    row = spark.createDataFrame([(5, "p", "s", "words", "#0  0x1 in f ()\n#1  0x2 in g ()", None, None, None, None)], "create_ts long, product string, summ string, desc string, raw_stack string, penalty array<string>, dummy_bug_id long, exclude_ids array<long>, skip_terms array<string>")
    back = reports.from_line(reports.build_line(row)).first()
    assert back["desc"].strip() == "words" and back.stacktrace == [["f", "g"]]
    bare = reports.from_line(reports.build_line(row.withColumn("raw_stack", F.lit(None).cast("string")))).first()
    assert bare.stacktrace == [] and bare.summ == "s"


def shown(rows):
    return {(r.session_id, r.report, tuple(r.penalty), tuple(r.exclude), tuple(r.skip), r.ended, r.n_commands) for r in rows}


def test_session_batch_and_step(spark):
    df = spark.createDataFrame(COMMANDS, SCHEMA)
    assert shown(session.fold(df).collect()) == WANT
    state = {"report": None, "penalty": [], "exclude": [], "skip": [], "ended": None, "n_commands": 0}
    for s, _, command, argument in COMMANDS:
        if s == 1:
            state = session.step(state, command, argument)
    assert state["report"] == "second" and state["ended"] == "do_submit"
    assert session.respond(session.fold(df), 3).filter("session_id = 1").first().report == "sec ..."


def test_session_stream(spark, tmp_path):
    for i in range(2):
        spark.createDataFrame(COMMANDS[i * 4 : i * 4 + 4 + i], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = session.stream(stream).writeStream.outputMode("update").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.sql("SELECT * FROM sessions").collect()
    last = {s: max((r for r in rows if r.session_id == s), key=lambda r: r.n_commands) for s in (1, 2)}
    assert shown(last.values()) == WANT
