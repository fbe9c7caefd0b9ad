"""Texts and ids at their limits: long runs of digits, the least and largest ids, control characters, long chains of calls."""

import random
import re
import time

from pyspark.sql import functions as F

from twinreport.llm import pii, tool_calls


def test_ips_in_long_runs_of_digits():
    for text in ("7" * 1_000_000, "1." * 300_000, "12345.6789." * 60_000 + "x", "9" * 500_000 + ".1.2.3 4.5.6"):
        start = time.process_time()
        pii.base_spans(text)
        assert time.process_time() - start < 4
    plain = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    r = random.Random(1)
    for _ in range(4000):
        text = "".join(r.choices("01259.. x-", k=r.randrange(60)))
        want = [("ip", *m.span()) for m in plain.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [s for s in pii.base_spans(text) if s[0] == "ip"] == want, text


def test_extreme_ids_and_turns(spark):
    big, least = 2**62, -(2**63)
    rows = [(big, 0, "user", "a"), (big, 1, "assistant", "b"), (-big, 2**63 - 1, "user", "c"), (3, least, "user", "d"), (3, least, "assistant", "e"), (3, least + 1, "assistant", "f"), (2**63 - 1, 5, "system", None)]
    got = tool_calls.chat_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    found = {(r["conv_id"], r["call_id"]): r["status"] for r in got}
    assert found == {(big, "call_0"): found[big, "call_0"], (-big, f"call_{2**63 - 1}"): "no_result", (3, f"call_{least}"): "linked", (2**63 - 1, "call_5"): "no_result"}
    kind = {(big * 7 + 0) % 20: "linked"}
    assert found[big, "call_0"] == ("blocked" if next(iter(kind)) in (3, 4) else "linked")


def test_control_characters_are_not_json(spark):
    texts = [f'{{"a":"x{chr(c)}y"}}' for c in range(1, 32)] + ['{"a":\x01}', "\x02"]
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    assert [r[0] for r in df.select(tool_calls.canonical(F.col("j"))).collect()] == [None] * len(texts)
    good = spark.createDataFrame([(r'{"a":"x\u0001\\\"y","b":1.0}',), ("",), (None,)], "j string").select(tool_calls.canonical(F.col("j"))).collect()
    assert [r[0] for r in good] == [r'{"a":"x\u0001\\\"y","b":1}', None, None]


def test_places_over_blocks_of_levels(spark, monkeypatch):
    monkeypatch.setattr(tool_calls, "BUCKET", 3)
    r = random.Random(2)
    calls = [(1, f"c{i}", i, "t", "{}", [f"c{i - 1}"] if i else []) for i in range(25)] + [(1, f"d{i}", r.randrange(40), "t", "{}", [f"c{r.randrange(25)}"] if i % 2 else None) for i in range(30)]
    df = spark.createDataFrame(calls, "conv_id long, call_id string, position long, name string, arguments string, depends_on array<string>")
    none = spark.createDataFrame([], "conv_id long, call_id string, position long, content string")
    rows = tool_calls.link_tool_calls(df, none, {}).select("call_id", "level", "place").collect()
    at = {c[1]: c[2] for c in calls}
    order = sorted(rows, key=lambda x: (x["level"], at[x["call_id"]], x["call_id"]))
    assert [x["place"] for x in order] == list(range(len(calls)))
