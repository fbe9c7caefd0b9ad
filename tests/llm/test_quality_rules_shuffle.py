"""The quality rules shuffle one row for each bucket and task, and the tasks grow with the buckets, not with the texts."""

import random
import re

from twinreport.llm import quality_rules


def test_counts_do_not_grow_with_the_partitions(spark, monkeypatch):
    r = random.Random(5)
    rows = [(i if i % 7 else None, " ".join(r.choice("abcdefgh") + r.choice("klmn") for _ in range(80)), "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 200, 3)], "doc_id long, quality int")
    known = {i: q for i, q in labels.collect()}
    buckets = 1 << 14
    want = {}
    for i, text, _ in rows:
        w = text.split()
        for gram in [*w, *zip(w, w[1:], strict=False)]:
            x = want.setdefault(gram, [0, 0])
            x[0] += 1
            x[1] += known.get(i) == 1
    for bits in (quality_rules.BITS, 64):  # 64: nearly every row may have a label
        monkeypatch.setattr(quality_rules, "BITS", bits)
        many = docs.repartition(60)
        labelled, _ = quality_rules.labelled_counts(many, labels, buckets)
        counts = quality_rules.bucket_counts(many, labelled, buckets)
        plan = counts._jdf.queryExecution().executedPlan().toString()
        assert [int(x) for x in re.findall(r"Coalesce (\d+)", plan)] == [4, 4]  # the cores, as the buckets are few
        got = counts.collect()
        assert sum(x.r for x in got) == sum(x[0] for x in want.values()) and sum(x.g for x in got) == sum(x[1] for x in want.values())
        told = {x.doc_id: x for x in quality_rules.judged(labelled, quality_rules.Model(many, labelled, buckets)).collect()}
        assert {i: x["__label"] for i, x in told.items() if x["__label"] is not None} == {i: q for i, q in known.items() if i % 7}
