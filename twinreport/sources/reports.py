"""Readers and writers of report files: level-1 lines, pipe-separated dumps, raw records of duplicates, and report lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import stacktrace as S
from ..functions import text as T

TEXT = ["bug_id", "summ", "desc", "stacktrace"]


def _pairs(line: Column) -> Column:
    """The key-value pairs of a level-1 line; its first field is dropped, of a repeated key the last counts."""
    fields = F.slice(F.split(line, ";", -1), F.lit(2), F.greatest(F.size(F.split(line, ";", -1)) - 1, F.lit(0)))
    pairs = F.transform(fields, lambda f: F.struct(F.split(f, "=", -1)[0].alias("k"), F.get(F.split(f, "=", -1), 1).alias("v")))
    return F.filter(pairs, lambda p: p["v"].isNotNull())


def _last(pairs: Column, key: str) -> Column:
    return F.get(F.transform(F.slice(F.reverse(F.filter(pairs, lambda p: p["k"] == key)), 1, 1), lambda p: p["v"]), 0)


def level1_rows(lines: DataFrame) -> DataFrame:
    """bug_id, ts, product, summ, desc, resolution of lines (value): summary, description and product in lower case."""
    p = F.col("__p")
    rows = lines.select(_pairs(F.col("value")).alias("__p"))
    decoded = lambda k: F.lower(T.decode_entities(F.coalesce(_last(p, k), F.lit(""))))
    return rows.select(
        F.coalesce(F.try_to_number(_last(p, "Bug#"), F.lit("999999999999999999")).cast("long"), F.lit(-1)).alias("bug_id"),
        F.coalesce(_last(p, "creation_ts").try_cast("long"), F.lit(0)).alias("ts"),
        decoded("product").alias("product"),
        decoded("short_desc").alias("summ"),
        decoded("long:1:text").alias("desc"),
        _last(p, "resolution").alias("resolution"),
    )


def parse_level1(lines: DataFrame, settings: Settings, community: str = "gnome") -> tuple[DataFrame, DataFrame]:
    """The tables text and basic from level-1 lines."""
    return tables(level1_rows(lines), settings, community)


def tables(rows: DataFrame, settings: Settings, community: str = "gnome") -> tuple[DataFrame, DataFrame]:
    """text (bug_id, summ, desc, stacktrace) and basic (bug_id, ts, product) of resolved, complete reports that aren't dropped."""
    kept = rows.filter(F.col("resolution").isNotNull() & (F.col("resolution") != "INCOMPLETE"))
    before, trace = S.split_description(F.col("desc"), settings.stacktrace_algorithm) if community == "gnome" else (F.col("desc"), F.array().cast(S.TRACE))
    kept = kept.select("bug_id", "ts", "product", "summ", before.alias("desc"), trace.alias("stacktrace"))
    kept = kept.filter(~T.drops_report(F.col("desc"), settings.drop_report_regexp))
    return kept.select(*TEXT), kept.select("bug_id", "ts", "product")


def parse_dump(lines: DataFrame) -> DataFrame:
    """bug_id|summary|description lines as the table text; not lower-cased, without stack traces."""
    parts = F.split("value", r"\|", -1)
    return lines.select(parts[0].try_cast("long").alias("bug_id"), F.get(parts, 1).alias("summ"), F.get(parts, 2).alias("desc"), F.array().cast(S.TRACE).alias("stacktrace"))


def parse_dump_basic(lines: DataFrame) -> DataFrame:
    """bug_id|product|ts lines as the table basic."""
    parts = F.split("value", r"\|", -1)
    return lines.select(parts[0].try_cast("long").alias("bug_id"), F.get(parts, 2).try_cast("long").alias("ts"), F.get(parts, 1).alias("product"))


def parse_dump_duplicates(lines: DataFrame) -> DataFrame:
    """origin|target lines as links (src, dst)."""
    parts = F.split("value", r"\|", -1)
    rows = lines.select(parts[0].try_cast("long").alias("src"), F.get(parts, 1).try_cast("long").alias("dst"))
    return rows.filter("src IS NOT NULL AND dst IS NOT NULL")


def element_text(line: Column) -> Column:
    return F.regexp_extract(line, ">([^<]*)<", 1)


def parse_level0(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (src, dst) and incomplete reports (bug_id) from raw records: rows `value` that each hold the text after one <bug>.

    A link is left out if its record was marked incomplete before it.
    """
    lines = F.transform(F.split("value", "\n", -1), lambda x: F.ltrim(x))
    rows = records.withColumn("r", F.monotonically_increasing_id()).select("r", F.posexplode(lines).alias("pos", "line"))
    rows = rows.filter(F.col("line").startswith("<bug_id>") | F.col("line").startswith("<resolution>INCOMPLETE") | F.col("line").startswith("<dup_id>"))
    own = Window.partitionBy("r").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(
        "line",
        F.last(F.when(F.col("line").startswith("<bug_id>"), element_text(F.col("line")).try_cast("long")), ignorenulls=True).over(own).alias("bug_id"),
        F.max(F.col("line").startswith("<resolution>")).over(own).alias("incomplete"),
    )
    links = rows.filter(F.col("line").startswith("<dup_id>") & ~F.col("incomplete")).select(F.col("bug_id").alias("src"), element_text(F.col("line")).try_cast("long").alias("dst"))
    return links, rows.filter(F.col("line").startswith("<resolution>")).select("bug_id").distinct()


def read_level0(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """parse_level0 of a file that Spark splits at <bug>."""
    return parse_level0(spark.read.option("lineSep", "<bug>").text(path))


def to_line(r: DataFrame, *keep: str) -> DataFrame:
    """line: create_ts;product;summary;description and stack trace;penalty;dummy_bug_id;exclude_ids;skip_terms; and `keep`."""
    listed = lambda c: F.coalesce(F.array_join(F.col(c).cast("array<string>"), ","), F.lit(""))
    text = lambda c: T.encode_special(F.coalesce(c, F.lit("")))
    desc = F.concat_ws(" ", F.coalesce("desc", F.lit("")), S.stack_text(F.col("stacktrace")))
    parts = [F.coalesce(F.col("create_ts").cast("string"), F.lit("")), text(F.col("product")), text(F.col("summ")), text(desc), text(listed("penalty")), F.coalesce(F.col("dummy_bug_id").cast("string"), F.lit("")), listed("exclude_ids"), text(listed("skip_terms"))]
    return r.select(F.concat_ws(";", *parts).alias("line"), *keep)


def build_line(r: DataFrame) -> DataFrame:
    """line, as to_line, of a form's fields: raw_stack is the trace as it was pasted, put under the header that marks a trace."""
    raw = F.coalesce("raw_stack", F.lit(""))
    desc = F.when(raw == "", F.col("desc")).otherwise(F.concat_ws(" ", "desc", F.concat(F.lit(S.HEADER), raw)))
    return to_line(r.withColumn("desc", desc).withColumn("stacktrace", F.array().cast(S.TRACE)))


def write_lines(rows: DataFrame, path: str, by: list[str]) -> None:
    """Report lines of rows as text files, in folders by the columns `by`; other columns that a line has no field for are lost."""
    lines = rows.withColumn("__by", F.struct(*by))
    fields = ["create_ts", "product", "summ", "desc", "stacktrace", "penalty", "dummy_bug_id", "exclude_ids", "skip_terms"]
    to_line(lines.select(*fields, "__by"), "__by").select("line", "__by.*").write.partitionBy(*by).text(path)


def read_lines(spark: SparkSession, path: str, by: list[str], algorithm: str = "weight") -> DataFrame:
    """The reports that `write_lines` wrote, with the columns `by` as text."""
    lines = spark.read.schema("value string, " + ", ".join(f"{c} string" for c in by)).text(path)
    return from_line(lines.withColumnRenamed("value", "line"), algorithm, *by)


def from_line(lines: DataFrame, algorithm: str = "weight", *keep: str) -> DataFrame:
    """The report of each line, and the columns `keep`; fields at the end may be missing."""
    f = F.split("line", ";", -1)
    at = lambda i: F.coalesce(F.get(f, i), F.lit(""))
    listed = lambda i: F.when(at(i) == "", F.array().cast("array<string>")).otherwise(F.split(T.decode_special(at(i)), ",", -1))
    before, trace = S.split_description(T.decode_special(at(3)), algorithm)
    return lines.select(
        *keep,
        at(0).try_cast("long").alias("create_ts"),
        T.decode_special(at(1)).alias("product"),
        T.decode_special(at(2)).alias("summ"),
        before.alias("desc"),
        trace.alias("stacktrace"),
        listed(4).alias("penalty"),
        at(5).try_cast("long").alias("dummy_bug_id"),
        listed(6).cast("array<long>").alias("exclude_ids"),
        listed(7).alias("skip_terms"),
    )


def find_line(lines: DataFrame, bug_id: int) -> DataFrame:
    """The first line (line_no, line) whose report has the dummy id."""
    return lines.filter(F.get(F.split("line", ";", -1), 5).try_cast("long") == bug_id).orderBy("line_no").limit(1)
