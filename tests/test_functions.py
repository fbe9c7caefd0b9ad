from pyspark.sql import functions as F

from twinreport.config import Settings, parse_settings, settings
from twinreport.functions import stacktrace as S
from twinreport.functions import text as T
from twinreport.functions.stem import lancaster, porter, porter2, stem_table

TRACE = """the window went away
Package: viewer
Severity: normal
Version: 3.1
Synopsis: gone after a click
Debugging Information:

Thread 2 (LWP 77):
#0  0x0042 in poll () from libc
#1  0x0043 in g_loop_run ()

Thread 1 (LWP 76):
#0  0x0100 in waitpid ()
#1  0x0101 in crash_dialog ()
#2  <signal handler called>
#3 draw_icon at icon.c
#4  0x0102 in layout_row ()
#5  unread
"""


def one(spark, value, *columns):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_settings():
    found = parse_settings("# note\n\nscoring_strategy:=weighted\nbug_duplicate_number:=7\nbroken\nascii_boundary:=0\n")
    s = settings(found)
    assert (s.scoring_strategy, s.bug_duplicate_number, s.ascii_boundary) == ("weighted", 7, False)
    assert settings({}) == Settings()


def test_tokens(spark):
    r = one(spark, "mouse-down set_background_color() élan 4you a", T.tokens(F.col("x")), T.tokens(F.col("x"), "letters"), T.tokens(F.col("x"), "full", True))
    assert r.c0 == ["mouse-down", "set_background_color", "a"]
    assert r.c1 == ["mouse-down", "set", "a"]
    assert r.c2 == ["mouse-down", "set_background_color", "lan", "a"]


def test_decoding_and_templates(spark):
    r = one(spark, "aNEWLINEbSEMICOLONcEQUALd&lt;&amp;lt;", T.decode_entities(F.col("x")), T.decode_entities(F.col("x"), False))
    assert r.c0 == "a\nb;c;d<&lt;" and r.c1 == "a\nb;c=d<&lt;"
    r = one(spark, "Version: 2 Priority: high\nSteps to Reproduce\nx", T.strip_template(F.col("x")))
    assert r.c0.split() == ["2", "x"]
    r = one(spark, "a;b\nc", T.decode_special(T.encode_special(F.col("x"))), T.encode_special(F.col("x")))
    assert r.c0 == "a;b\nc" and r.c1 == "a[[SEMICOLON]]b[[NEWLINE]]c"


def test_sentences_and_messages(spark):
    r = one(spark, "One. Two.\n\nThree\nfour", T.sentences(F.col("x")), T.truncated(F.col("x"), 3), T.tip(F.lit(0), F.lit(1)), T.date_seconds(F.lit("1970-1-2")))
    assert r.c0 == ["One", "Two", "\nThree\nfour"] or r.c0 == ["One", "Two.", "Three\nfour"]
    assert r.c1 == "One ..." and r.c2.startswith("Could you") and r.c3 == 86400


def test_stack_traces(spark):
    before, trace = S.split_description(F.col("x"))
    r = one(spark, TRACE, before, trace)
    assert r.c0.endswith("Synopsis: gone after a click\n")
    assert r.c1 == [["poll", "g_loop_run"], ["waitpid", "crash_dialog", "unknown", "draw_icon", "layout_row", "unknown"]]
    body = TRACE[TRACE.index("#0  0x0100") :]
    r = one(spark, "x \n" + body, S.stack_info(F.lower(F.col("x")), "signal"))
    assert r.c0 == [["draw_icon", "layout_row"]]
    df = spark.createDataFrame([(r.c0,)], "t array<array<string>>")
    empty, hollow = F.array().cast(S.TRACE), F.array(F.array().cast("array<string>"))
    t = F.col("t")
    sims = df.select(*[S.stack_similarity(a, b, "signal") for a, b in ((t, t), (hollow, t), (empty, t), (t, empty))]).first()
    assert list(sims) == [1.0, 1.0, 1.0, 0.0]
    again = df.select(S.split_description(F.concat(F.lit("words "), S.stack_text(t)))[1].alias("t")).first().t
    assert again[0][0] == "unknown" and again[0][1:] == r.c0[0]
    plain = one(spark, "no trace here", *S.split_description(F.col("x")))
    assert plain.c0 == "no trace here" and plain.c1 == []


def test_python_traceback_starts_at_its_title(spark):
    head = "distribution: x gnome release: y bugbuddy z found in menu "
    text = head + "traceback (most recent call last) file a, in run\nfile b, in stop"
    assert one(spark, text, S.split_description(F.col("x"))[1]).c0 == [["run\nfile", "stop"]]
    assert one(spark, head + "traceback (most recent call last) in \n\ngo\n now", S.split_description(F.col("x"))[1]).c0 == [["go"]]


def test_added_penalty(spark):
    assert one(spark, "a,b", T.added_penalty(F.col("x"), F.lit("c")), T.added_penalty(F.lit(""), F.lit("c")), T.added_penalty(F.lit(None), F.lit("c"))).asDict() == {"c0": "a,b,c", "c1": "c", "c2": "c"}


def test_stack_similarity_of_threads(spark):
    df = spark.createDataFrame([([["a", "b"], ["c"]], [["a", "c"], ["??"]])], "p array<array<string>>, s array<array<string>>")
    r = df.select(S.stack_similarity(F.col("p"), F.col("s"), "weight").alias("w"), S.stack_similarity(F.col("p"), F.col("s"), "max").alias("m"), S.stack_similarity(F.col("p"), F.array(F.array(F.lit("??"))), "max").alias("z")).first()
    assert r.w == 1 / 4 and abs(r.m - 1 / 3) < 1e-12
    assert df.select(S.stack_similarity(F.array(F.array(F.lit("??"))), F.array(F.array(F.lit("unknown"))), "max")).first()[0] == 0.0


def test_stemmers(spark):
    assert [porter2(w) for w in ("calculation", "consistency", "knackeries", "dying", "because", "generously", "skies")] == ["calcul", "consist", "knackeri", "die", "becaus", "generous", "sky"]
    assert [porter(w) for w in ("caresses", "ponies", "relational", "hopping", "filing", "oscillators")] == ["caress", "poni", "relat", "hop", "file", "oscil"]
    assert [lancaster(w) for w in ("maximum", "presumably", "provision", "owed", "saying", "string")] == ["maxim", "presum", "provid", "ow", "say", "string"]
    words = spark.createDataFrame([("Tests",), ("Tests",), (None,)], "w string")
    assert {tuple(r) for r in stem_table(words, "porter2").collect()} == {("Tests", "test"), (None, None)}
