"""The artefact pipeline: tables that are rebuilt when they failed, are missing, or are older than what they depend on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from ..operators import groups, terms
from ..sources import reports
from ..sources.store import Store


@dataclass
class Artefact:
    name: str
    build: Callable[[], None] | None
    needs: list[Artefact] = field(default_factory=list)
    modified: Callable[[], tuple[int | None, bool | None]] = lambda: (None, None)

    def refresh(self) -> bool:
        """Brings what it needs up to date, then itself; says whether it was rebuilt."""
        for n in self.needs:
            n.refresh()
        at, success = self.modified()
        stale = not success or at is None or any((n.modified()[0] or -1) > at for n in self.needs)
        if stale and self.build:
            self.build()
        return bool(stale and self.build)


def file_artefact(spark, path: str) -> Artefact:
    """An input that is never built; its time is that of the file, -1 if missing."""

    def modified() -> tuple[int, bool]:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        return (fs.getFileStatus(p).getModificationTime() // 1000 if fs.exists(p) else -1), True

    return Artefact(path, None, [], modified)


def artefacts(store: Store, level1: str, level0: str, settings: Settings) -> dict[str, Artefact]:
    """text and basic, termcount, documentcount, tfidf, duplicate_group and its index."""
    spark = store.spark
    made: dict[str, Artefact] = {}

    def add(name: str, build: Callable[[], None], needs: list[Artefact]) -> None:
        made[name] = Artefact(name, build, needs, lambda: store.status(name))

    def text() -> None:
        one, two = reports.parse_level1(spark.read.text(level1), settings)
        store.write("basic", two)
        store.write("text", one)

    def tfidf() -> None:
        counts = store.read("termcount")
        n = store.read("text").count()
        store.write("tfidf", terms.weights(counts, terms.field_counts(counts), n, settings.tfidf_algorithm))

    def grouped() -> None:
        members, sizes = groups.duplicate_groups(*reports.read_level0(spark, level0))
        store.write("duplicate_group_index", sizes)
        store.write("duplicate_group", members)

    add("text", text, [file_artefact(spark, level1)])
    add("termcount", lambda: store.write("termcount", terms.term_counts(store.read("text"), settings)) and None, [made["text"]])
    add("documentcount", lambda: store.write("documentcount", terms.document_counts(store.read("termcount"))) and None, [made["termcount"]])
    add("tfidf", tfidf, [made["termcount"], made["documentcount"]])
    add("duplicate_group", grouped, [file_artefact(spark, level0)])
    return made


def remove_bad_reports(tables: dict[str, DataFrame], settings: Settings, also: tuple[str, ...] = ("tfidf", "duplicate_group")) -> dict[str, DataFrame]:
    """Reports whose description matches the pattern leave text and the tables `also`; counts stay as they are."""
    bad = tables["text"].filter(T.drops_report(F.col("desc"), settings.drop_report_regexp)).select("bug_id").distinct()
    return {k: df.join(bad, "bug_id", "left_anti") if k == "text" or k in also else df for k, df in tables.items()}
