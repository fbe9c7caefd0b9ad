"""One query for each operator, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import stacktrace as S
from ..functions import stem
from ..functions import text as T
from ..operators import evaluate, groups, recommend, similarity, terms
from ..sources import reports
from ..streaming import session
from . import build
from ..lineage import checkpointed, finished, met, removed, shared_folder
from .domain import BIDF, TFIDF, best_of, compared, corpus, counted, edges, incoming, incomplete, scored, searched, table, trace, weighted

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Similar enough for the synthetic texts, whose best reports score lower than real duplicates.
LOOSE = Settings(bug_no_similar_threshold=0.2)
#: What drops a report of the synthetic texts.
DROPPED = r"\+1 \([0-9]{3}\)|token = "


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def tokenize(spark, d):
    return terms.token_rows(corpus(spark, d), BIDF, strip=False).select("bug_id", "field", F.col("pos").cast("long").alias("pos"), "term")


@query
def decode_entities(spark, d):
    return table(spark, d, "pages").select("page_id", T.decode_entities(F.col("html")).alias("decoded"))


@query
def strip_template(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_template(F.col("html")).alias("stripped"))


@query
def term_count(spark, d):
    return terms.bags(terms.token_rows(corpus(spark, d), BIDF), BIDF, stop_words=False, synonyms=False)


@query
def stopword_filter(spark, d):
    return terms.term_counts(corpus(spark, d), BIDF, synonyms=False)


@query
def synonym_expand(spark, d):
    # The corpus is of invented words, so the words of the synonym sets are added to its pages' words.
    pages = table(spark, d, "pages").select(F.col("page_id").alias("bug_id"), F.lower("url").alias("summ"), F.concat(F.lower("html"), F.lit(" email click folder "), F.lower("url")).alias("desc"))
    return terms.term_counts(pages, BIDF)


@query
def document_count(spark, d):
    return terms.document_counts(terms.term_counts(corpus(spark, d), BIDF, synonyms=False))


@query
def report_total(spark, d):
    return corpus(spark, d).agg(F.count(F.lit(1)).alias("n"))


def _dfs(spark, d):
    docs = corpus(spark, d)
    return terms.field_counts(terms.term_counts(docs, BIDF, synonyms=False)), F.lit(docs.count())


@query
def idf(spark, d):
    dfs, n = _dfs(spark, d)
    return dfs.select("field", "term", "df", F.round(terms.idf(n, F.col("df")), 6).alias("idf"))


@query
def unit_idf(spark, d):
    dfs, n = _dfs(spark, d)
    return dfs.select("field", "term", F.round(terms.unit_idf(n, F.col("df")), 6).alias("unit_idf"))


@query
def tfidf_norm(spark, d):
    return weighted(spark, d, TFIDF)[1].select("bug_id", "field", "term", F.round("w", 6).alias("w"))


@query
def bidf(spark, d):
    return weighted(spark, d, BIDF)[1].select("bug_id", "field", "term", F.round("w", 6).alias("w"))


@query
def squared_length(spark, d):
    return terms.squared_lengths(weighted(spark, d, BIDF)[1]).select("bug_id", "field", F.round("len2", 6).alias("len2"))


@query
def dot_similarity_topn(spark, d):
    return best_of(spark, d, 10, TFIDF)


@query
def asm_similarity_topn(spark, d):
    return best_of(spark, d, 10)


def _pruned(spark, d, settings):
    search = searched(spark, d, settings)
    rows = search.top(10)
    return finished(rows, search.paths)


@query
def asm_pruned_topn(spark, d):
    """The same by bounds of terms, without forming every pair that shares one."""
    return _pruned(spark, d, BIDF)


@query
def dot_pruned_topn(spark, d):
    return _pruned(spark, d, TFIDF)


@query
def asm_similarity_penalty(spark, d):
    q, c, *_ = weighted(spark, d, BIDF)
    unwanted = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array(F.lit("and"), F.lit("onth"), F.lit("that"), F.lit("thea"))).alias("term"))
    pairs = similarity.similarities(q, c, Settings(penalty_weight=1.0), unwanted)
    return similarity.top(pairs.select("query_id", "bug_id", F.round("rd", 6).alias("score")), 10)


def _asked(spark, d):
    return table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), F.concat(F.lit("src"), F.pmod("item_id", F.lit(20)).cast("string")).alias("product"), (F.col("item_id") * 86400 * 100).alias("ts"),
        F.array("item_id").alias("exclude"), (F.col("item_id") + 20).alias("dummy_bug_id"),
    )


@query
def candidate_prefilter(spark, d):
    return similarity.candidates(_asked(spark, d), corpus(spark, d), BIDF)


@query
def candidate_range_join(spark, d):
    """The same candidates by the range join over buckets of time."""
    return similarity.candidates(_asked(spark, d), corpus(spark, d), BIDF, sent=0)


def _strategy(name):
    def f(spark, d):
        s = Settings(scoring_strategy=name, bug_nl_threshold=0.2, bug_stacktrace_ratio=0.2)
        value = F.round(similarity.score(F.col("rs"), F.col("rd"), F.lit(1.0), s, F.lit(False)), 6)
        return similarity.top(compared(spark, d).select("query_id", "bug_id", value.alias("score")), 10)

    return f


for _name in ("weighted", "heuristic", "distweighted"):
    QUERIES[f"score_{_name}"] = _strategy(_name)


def _similar(spark, d):
    total = corpus(spark, d).count()
    all_of_them = incoming(spark, d).select("query_id", F.lit(total).cast("long").alias("n"))
    return similarity.similar(scored(spark, d), LOOSE, all_of_them)


@query
def similar_cut(spark, d):
    return _similar(spark, d)


def _similar_pruned(spark, d, made=None):
    own = made or counted(spark, d, LOOSE)
    search = searched(spark, d, LOOSE, own)
    rows = search.similar(own.n)
    return finished(rows, [*search.paths, *([] if made else own.paths)])


@query
def pruned_similar_cut(spark, d):
    return _similar_pruned(spark, d)


def _groups(spark, d):
    return groups.duplicate_groups(edges(spark, d), incomplete(spark, d))


@query
def duplicate_decision(spark, d):
    return similarity.duplicates(checkpointed(_similar(spark, d)), _groups(spark, d)[0], LOOSE).select("query_id", "bug_id", "score", "rank", "n_groups")


def _ranked(spark, d):
    return similarity.top(scored(spark, d), 1 << 31)


@query
def score_quantiles(spark, d):
    return similarity.distribution(_ranked(spark, d))


@query
def duplicate_positions(spark, d):
    ranked = _ranked(spark, d)
    members = _groups(spark, d)[0]
    best = ranked.filter("rank = 1").join(members, "bug_id").select("query_id", "group")
    return similarity.positions(ranked, best.join(members, "group"))


@query
def duplicate_components(spark, d):
    return _groups(spark, d)[0]


@query
def duplicate_group_size(spark, d):
    return _groups(spark, d)[1]


@query
def groups_by_batches(spark, d):
    """The groups after the links came in four batches, each joined to what was stored."""
    store = groups.GroupStore.empty(spark)
    links = edges(spark, d)
    for i in range(4):
        store = store.with_links(links.filter(F.pmod("src", F.lit(4)) == i), incomplete(spark, d) if i == 1 else None)
    members, sizes = store.groups()
    return members.join(sizes, "group").select("bug_id", "group", "size", "n_members")


@query
def star_groups(spark, d):
    e = edges(spark, d)
    return groups.star_groups(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))[0]


@query
def star_group_size(spark, d):
    e = edges(spark, d)
    return groups.star_groups(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))[1]


@query
def group_size_range(spark, d):
    return groups.groups_between(_groups(spark, d)[1], 1, 4)


@query
def group_strata(spark, d):
    return evaluate.strata(_groups(spark, d)[1], Settings(small_group=3, middle_group=5))


@query
def group_span(spark, d):
    return groups.group_spans(_groups(spark, d)[0], corpus(spark, d))


@query
def same_group_hits(spark, d):
    members = _groups(spark, d)[0]
    found = corpus(spark, d).select(F.col("bug_id").alias("query_id"), F.explode(F.array(F.col("bug_id"), F.col("bug_id") + 1, F.col("bug_id") - 1)).alias("bug_id"))
    return groups.hits(found.unionByName(edges(spark, d).select(F.col("src").alias("query_id"), F.col("dst").alias("bug_id"))), members)


@query
def product_counts(spark, d):
    return groups.product_counts(table(spark, d, "part").select(F.col("p_brand").alias("product")), 70)


def _differences(spark, d):
    made = counted(spark, d, BIDF)
    best = best_of(spark, d, 10, made=made)
    return recommend.report_difference(best, made.ours, made.counts, n=best.count()), best, made


@query
def report_difference(spark, d):
    rows, _, made = _differences(spark, d)
    return finished(rows, made.paths)


def _keywords(spark, d):
    rows, best, made = _differences(spark, d)
    return recommend.keyword_scores(rows, best, made.dfs, made.n), best, made


@query
def keyword_scores(spark, d):
    scores, _, made = _keywords(spark, d)
    return finished(scores, made.paths)


@query
def keyword_entropy(spark, d):
    scores, _, made = _keywords(spark, d)
    return finished(recommend.best_keyword(scores), made.paths)


@query
def sentence_split(spark, d):
    return recommend.sentence_rows(corpus(spark, d)).select("bug_id", F.col("pos").cast("long").alias("pos"), "sentence")


@query
def sentences_with_term(spark, d):
    scores, best, made = _keywords(spark, d)
    keyword = finished(recommend.best_keyword(scores).select("query_id", "term"), made.paths)
    found = met(corpus(spark, d), best.select("query_id", "bug_id"), ["bug_id"], best.count())
    rows = recommend.sentence_rows(found, more=["query_id"])
    return recommend.sentences_with(rows, keyword, BIDF, n=keyword.count()).withColumn("pos", F.col("pos").cast("long"))


def _pairs_of_best(best, ours, theirs, value):
    """Incoming reports beside their best report, by description terms."""
    a = best.join(ours.filter("field = 'desc'"), "query_id").select("query_id", "bug_id", "term", value)
    b = best.join(theirs.filter("field = 'desc'"), "bug_id").select("query_id", "bug_id", "term", value)
    return terms.compared(a, b, value, ["query_id", "bug_id"])


def _best_counts(spark, d):
    """Term counts of the incoming reports, their best reports, the counts of these, document counts of the terms of both,
    number of reports. All are small; the tables that they came from are deleted."""
    made = counted(spark, d, BIDF)
    best = best_of(spark, d, 1, made=made).select("query_id", "bug_id")
    theirs = checkpointed(met(made.counts, best.select("bug_id").distinct(), ["bug_id"], best.count()))
    both = made.ours.select("field", "term").unionByName(theirs.select("field", "term")).distinct()
    dfs = finished(met(made.dfs, both, ["field", "term"], made.ours.count() + theirs.count()), made.paths)
    return made.ours, best, theirs, dfs, made.n


@query
def compare_bow(spark, d):
    ours, best, theirs, *_ = _best_counts(spark, d)
    return _pairs_of_best(best, ours, theirs, "tf").withColumn("shared", F.least("a", "b"))


@query
def compare_tfidf(spark, d):
    ours, best, theirs, dfs, n = _best_counts(spark, d)
    q, c = terms.weights(ours, dfs, n, "tfidf", "query_id"), terms.weights(theirs, dfs, n, "tfidf")
    rows = _pairs_of_best(best, q, c, "w").join(dfs.filter("field = 'desc'").select("term", "df"), "term", "left")
    df = F.coalesce("df", F.lit(0))
    return rows.select("query_id", "bug_id", "term", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round(F.col("a") * F.col("b"), 6).alias("product"), df.cast("long").alias("df"), F.round(terms.idf(F.lit(n), df), 6).alias("idf"))


@query
def drop_report_filter(spark, d):
    return corpus(spark, d).filter(~T.drops_report(F.col("desc"), DROPPED)).select("bug_id", "product")


@query
def remove_bad_reports(spark, d):
    s = Settings(drop_report_regexp=DROPPED)
    kept = build.remove_bad_reports({"text": corpus(spark, d), "duplicate_group": _groups(spark, d)[0]}, s)
    return kept["duplicate_group"]


@query
def level1_tables(spark, d):
    """Documents as level-1 lines, read into text and basic."""
    coded = lambda c: F.replace(F.replace(c, F.lit("\n"), F.lit("NEWLINE")), F.lit(";"), F.lit("SEMICOLON"))
    docs = table(spark, d, "documents")
    field = lambda k, v: F.concat(F.lit(f"{k}="), v)
    resolution = F.when(F.col("doc_id") % 10 == 0, "resolution=INCOMPLETE").when(F.col("doc_id") % 10 != 1, "resolution=FIXED")
    lines = docs.select(F.concat_ws(";", F.lit("Bug#=7"), field("Bug#", F.col("doc_id").cast("string")), field("short_desc", coded(F.substring_index("text", "\n", 1))), field("long:1:text", coded(F.col("text"))), resolution, field("product", F.upper("source")), field("creation_ts", (F.col("doc_id") * 60).cast("string"))).alias("value"))
    text, basic = reports.parse_level1(lines, Settings(drop_report_regexp=DROPPED))
    return text.join(basic, "bug_id").select("bug_id", "summ", "desc", F.size("stacktrace").cast("long").alias("n_threads"), "ts", "product")


@query
def dump_tables(spark, d):
    """Documents as pipe-separated lines, read into text and basic."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "source", F.translate("text", "\n", " ").alias("text"))
    text = reports.parse_dump(docs.select(F.concat_ws("|", "id", F.substring("text", 1, 40), "text").alias("value")))
    basic = reports.parse_dump_basic(docs.select(F.concat_ws("|", "id", "source", F.concat("id", F.lit("00"))).alias("value")))
    return text.join(basic, "bug_id").select("bug_id", "summ", "desc", F.size("stacktrace").cast("long").alias("n_threads"), "ts", "product")


@query
def level0_groups(spark, d):
    """Duplicate links and incomplete reports as raw records; a link counts unless its record was marked before it. An
    incomplete report of an even id is marked after its link."""
    records = table(spark, d, "documents").select(F.col("doc_id").alias("bug_id")).join(edges(spark, d), F.col("bug_id") == F.col("src"), "left").join(incomplete(spark, d).distinct().withColumn("bad", F.lit(True)), "bug_id", "left")
    mark = F.when(F.col("bad"), "    <resolution>INCOMPLETE</resolution>")
    link = F.concat(F.lit("    <dup_id>"), F.col("dst").cast("string"), F.lit("</dup_id>"))
    even = F.col("bug_id") % 2 == 0
    lines = F.concat_ws("\n", F.lit(""), F.concat(F.lit("    <bug_id>"), F.col("bug_id").cast("string"), F.lit("</bug_id>")), F.when(even, link).otherwise(mark), F.lit("    <thetext>x &lt;dup_id&gt;</thetext>"), F.when(even, mark).otherwise(link), F.lit("  </bug>"))
    members, sizes = groups.duplicate_groups(*(checkpointed(x) for x in reports.parse_level0(records.select(lines.alias("value")))))
    return members.join(sizes, "group").select("bug_id", "group", "size", "n_members")


@query
def report_serde(spark, d):
    rows = corpus(spark, d).select(
        F.col("ts").alias("create_ts"), "product", "summ", "desc", F.array().cast(S.TRACE).alias("stacktrace"), F.array(F.lit("a;b"), F.lit("c")).alias("penalty"),
        F.col("bug_id").alias("dummy_bug_id"), F.array("bug_id", F.col("bug_id") + 1).alias("exclude_ids"), F.array(F.lit("skip")).alias("skip_terms"),
    )
    back = reports.from_line(reports.to_line(rows))
    return back.select("create_ts", "product", "summ", "desc", F.array_join("penalty", "|").alias("penalty"), "dummy_bug_id", F.array_join(F.transform("exclude_ids", lambda x: x.cast("string")), "|").alias("exclude_ids"), F.array_join("skip_terms", "|").alias("skip_terms"))


def _traces(spark, d):
    """Conversations as two traces: the tokens of the user's turns, and of the assistant's."""
    rows = table(spark, d, "conversations").filter(F.col("role").isin("user", "assistant")).select("conv_id", "role", F.struct("turn", T.tokens(F.lower("text")).alias("t")).alias("x"))
    side = lambda r: F.transform(F.array_sort(F.filter(F.collect_list(F.when(F.col("role") == r, F.col("x"))), lambda x: x.isNotNull())), lambda x: x["t"]).alias(r)
    return rows.groupBy("conv_id").agg(side("user"), side("assistant"))


def _stack(algorithm):
    def f(spark, d):
        return _traces(spark, d).select("conv_id", F.round(S.stack_similarity(F.col("user"), F.col("assistant"), algorithm), 6).alias("similarity"))

    return f


for _name in ("weight", "max", "signal"):
    QUERIES[f"stack_similarity_{_name}"] = _stack(_name)


@query
def stack_text(spark, d):
    return _traces(spark, d).select("conv_id", S.stack_text(F.col("user")).alias("stack"))


@query
def eval_macro(spark, d):
    members = _groups(spark, d)[0]
    true = members.withColumnRenamed("bug_id", "query_id").join(members.groupBy("group").agg(F.count(F.lit(1)).alias("m")), "group")
    cases = true.select("query_id", (F.col("m") - 1).alias("n_true"))
    found = corpus(spark, d).select(F.col("bug_id").alias("query_id"), F.explode(F.array(F.col("bug_id") + 1, F.col("bug_id") - 1)).alias("bug_id"))
    similar = found.unionByName(edges(spark, d).select(F.col("src").alias("query_id"), F.col("dst").alias("bug_id")))
    duplicate = edges(spark, d).select(F.col("src").alias("query_id"), F.col("dst").alias("bug_id"))
    return evaluate.macro(cases, groups.hits(similar, members), groups.hits(duplicate, members))


def session_commands(conversations):
    """Turns as commands: system sets a report, the user replaces its text, the assistant adds a penalty; turn 6 submits."""
    command = F.when(F.col("turn") == 6, "do_submit").when(F.col("role") == "system", "set_report_info").when(F.col("role") == "user", "set_report_basic_info").otherwise("add_penalty")
    return conversations.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), command.alias("command"), F.col("text").alias("argument"))


@query
def session_fold(spark, d):
    rows = session.fold(session_commands(table(spark, d, "conversations")))
    return rows.select("session_id", "report", F.size("penalty").cast("long").alias("n_penalty"), F.array_join("penalty", "|").alias("penalty"), "ended", "n_commands")


@query
def tip_case(spark, d):
    return table(spark, d, "part").select("p_partkey", T.tip(F.col("p_size") - 40, F.col("p_size") - 20).alias("tip"))


@query
def truncate_text(spark, d):
    return corpus(spark, d).select("bug_id", T.truncated(F.col("desc")).alias("shown"))


@query
def incomplete_words(spark, d):
    return corpus(spark, d).select("bug_id", evaluate.incomplete_text(F.col("desc"), F.col("bug_id"), 0.5, BIDF).alias("partial"))


@query
def date_seconds(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.date_seconds(F.date_format("o_orderdate", "yyyy-M-d")).alias("seconds"))


@query
def frame_names(spark, d):
    record = F.concat(F.lit("2  0xb5 in "), F.replace(F.col("event_type"), F.lit(" "), F.lit("_")), F.lit(" ()"))
    return table(spark, d, "events").select("event_id", S.frame_name(record).alias("frame"))


@query
def similarity_over_candidates(spark, d):
    """Every candidate of the incoming report's product, scored with stack traces by the heuristic strategy."""
    s = Settings(bug_nl_threshold=0.2, bug_stacktrace_threshold=0.05)
    ours, theirs, *_ = weighted(spark, d, BIDF)
    asked = _asked(spark, d).join(incoming(spark, d).select("query_id", trace("query_id", 2).alias("stacktrace")), "query_id")
    reports_ = corpus(spark, d).select("bug_id", "product", "ts", trace("bug_id", 3).alias("stacktrace"))
    rows = similarity.over_candidates(asked, reports_, ours, theirs, s)
    return rows.select("query_id", "bug_id", *[F.round(c, 6).alias(c) for c in ("rs", "rd", "rt", "score")])


@query
def keyword_top(spark, d):
    scores, _, made = _keywords(spark, d)
    return finished(recommend.top_keywords(scores, 10), made.paths)


@query
def text_query(spark, d):
    """Ids of the ten reports most like a summary and a description, as one text."""
    best = best_of(spark, d, 10)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "bug_id"))), lambda x: x["bug_id"].cast("string"))
    return best.groupBy("query_id").agg(F.array_join(ordered, ";").alias("ids"))


@dataclass
class Recommendation:
    """What is found out for incoming reports, each part a table: similar reports, keyword, sentences with it, duplicates."""

    similar: DataFrame
    keyword: DataFrame
    sentences: DataFrame
    duplicates: DataFrame
    dfs: DataFrame
    n: int


def _recommended(spark, d) -> Recommendation:
    """From the similar reports on: what they say and the incoming one doesn't, the keyword that splits them best, their
    sentences with it in order of rank until over a thousand are held, and those that it may repeat."""
    made = counted(spark, d, LOOSE)
    ours, counts, dfs, n, _ = made
    rows = _similar_pruned(spark, d, made)
    scores = recommend.keyword_scores(recommend.report_difference(rows, ours, counts, n=rows.count()), rows, dfs, n)
    keyword = checkpointed(recommend.best_keyword(scores).select("query_id", "term"))
    theirs = corpus(spark, d).join(rows.select("bug_id").distinct(), "bug_id", "left_semi")
    pieces = rows.select("query_id", "bug_id").join(recommend.sentence_rows(theirs), "bug_id")
    found = recommend.sentences_with(pieces, keyword, LOOSE).withColumn("pos", F.col("pos").cast("long"))
    sentences = checkpointed(recommend.first_reports(found, rows))
    again = recommend.duplicate_texts(similarity.duplicates(rows, _groups(spark, d)[0], LOOSE), theirs)
    return Recommendation(rows, keyword, sentences, checkpointed(again), dfs, n)


def _shown(r: Recommendation) -> DataFrame:
    """All sentences of a report that has few, or one for each cluster of them."""
    bags = r.sentences.select(F.struct("query_id", "bug_id", "pos").alias("key"), F.lit("").alias("summ"), F.col("sentence").alias("desc"))
    w = terms.weights(terms.term_counts(bags, TFIDF, "key", synonyms=False), r.dfs, r.n, "tfidf", "key").filter("w > 0").select("key.*", "term", "w")
    return recommend.representatives(r.sentences, w, BIDF.bug_sentence_number)


@query
def recommend_sentences(spark, d):
    return _recommended(spark, d).sentences.select("query_id", "bug_id", "pos", "sentence")


@query
def recommend_clusters(spark, d):
    """What is asked of each author: all sentences with the keyword, or one for each cluster of them."""
    return _shown(_recommended(spark, d))


@query
def recommend_answers(spark, d):
    """One row for each incoming report that has similar ones: keyword, sentences and duplicates found, what the author is told."""
    r = _recommended(spark, d)
    return recommend.answers(r.similar, r.keyword, r.sentences, r.duplicates).select("query_id", "n_similar", "keyword", "n_sentences", "duplicates", "tip")


@query
def recommend_packed(spark, d):
    """The same with the sentences that are shown and the texts of the duplicates."""
    r = _recommended(spark, d)
    return recommend.answers(r.similar, r.keyword, _shown(r), r.duplicates)


@query
def recommend_duplicates(spark, d):
    """Id and texts of the reports that an incoming one seems to repeat."""
    found = similarity.duplicates(checkpointed(_similar(spark, d)), _groups(spark, d)[0], LOOSE)
    return recommend.duplicate_texts(found, corpus(spark, d))


@query
def explain_pairs(spark, d):
    """Each incoming report beside its best one: summaries, similarities, score and number of shared terms."""
    counts = counted(spark, d, BIDF)
    made = weighted(spark, d, BIDF, counts)
    pairs = checkpointed(compared(spark, d, BIDF, counts))
    nl = F.round(F.col("rs") * BIDF.bug_summary_ratio + F.col("rd") * BIDF.bug_description_ratio, similarity.DIGITS)
    best = similarity.top(pairs.withColumn("score", nl), 1).drop("rank")
    shared = made[0].select("query_id", "field", "term").join(best.select("query_id", "bug_id"), "query_id").join(made[1].select("bug_id", "field", "term"), ["bug_id", "field", "term"])
    shared = shared.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_shared"))
    rows = best.join(shared, "query_id", "left").join(incoming(spark, d).select("query_id", F.col("summ").alias("ours")), "query_id").join(corpus(spark, d).select("bug_id", F.col("summ").alias("theirs")), "bug_id")
    return rows.select("query_id", "bug_id", "ours", "theirs", F.round("rs", 6).alias("rs"), F.round("rd", 6).alias("rd"), "score", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))


@query
def eval_rankings(spark, d):
    """Precision and recall of what the rankings return; a case's true group is that of its best report."""
    rows, members = checkpointed(_similar(spark, d)), checkpointed(_groups(spark, d)[0])
    own = rows.filter("rank = 1").join(members, "bug_id").select("query_id", F.col("group").alias("own"))
    cases = own.join(members.groupBy(F.col("group").alias("own")).agg(F.count(F.lit(1)).alias("n_true")), "own").select("query_id", "n_true")
    judge = lambda found: found.join(own, "query_id").join(members, "bug_id", "left").select("query_id", "bug_id", F.coalesce(F.col("group") == F.col("own"), F.lit(False)).alias("hit"))
    return evaluate.macro(cases, judge(rows), judge(similarity.duplicates(rows, members, LOOSE)))


RATES, THRESHOLDS = (0.0, 0.2, 0.4, 0.6, 0.8), (0.65, 0.7, 0.75)
STRATA, DRAWS = Settings(small_group=3, middle_group=5), {"small": 4, "middle": 3, "large": 3}


def _cases(spark, d) -> tuple[DataFrame, DataFrame]:
    """Test cases: reports drawn from the strata of groups, without some of their words, written as report lines and read
    again; and the groups' members."""
    members, sizes = _groups(spark, d)
    members = checkpointed(members)
    drawn = checkpointed(evaluate.draws(members, evaluate.strata(sizes, STRATA), DRAWS))
    path = f"{shared_folder(spark)}/cases-{uuid.uuid4().hex}"
    reports.write_lines(evaluate.cases(drawn, corpus(spark, d), RATES, BIDF), path, ["rate", "stratum"])
    back = checkpointed(reports.read_lines(spark, path, ["rate", "stratum"]).withColumn("query_id", F.monotonically_increasing_id()))
    removed(spark, path)
    return back, members


@query
def test_cases(spark, d):
    return _cases(spark, d)[0].select(F.col("rate").cast("double").alias("rate"), "stratum", "create_ts", "product", "summ", "desc", "dummy_bug_id")


@query
def eval_grid(spark, d):
    """Precision and recall of what is found for the test cases, at each threshold and rate: a case's true reports are those
    of the group it was drawn from, but for itself."""
    rows, members = _cases(spark, d)
    s = replace(BIDF, bug_no_similar_threshold=0.0)
    made = counted(spark, d, s, rows.select("query_id", "summ", "desc"))
    itself = rows.select("query_id", F.col("dummy_bug_id").alias("bug_id"))
    search = searched(spark, d, s, made, itself)
    rows_ = search.similar(made.n)
    found = finished(rows_, [*search.paths, *made.paths])
    high = found.groupBy("query_id").agg(F.max("score").alias("high"))
    own = itself.join(members, "bug_id").select("query_id", F.col("group").alias("own"))
    judged = lambda df: df.join(own, "query_id").join(high, "query_id").join(members, "bug_id", "left").select("query_id", "bug_id", "high", F.coalesce(F.col("group") == F.col("own"), F.lit(False)).alias("hit"))
    true = own.join(members.groupBy(F.col("group").alias("own")).agg((F.count(F.lit(1)) - 1).alias("n_true")), "own")
    cases = rows.select("query_id", F.col("rate").cast("double").alias("rate")).join(true, "query_id").select("query_id", "rate", "n_true")
    return evaluate.grid_metrics(cases, judged(found), judged(similarity.duplicates(found, members, s)), THRESHOLDS)


@query
def scores_at_least(spark, d):
    return table(spark, d, "part").select("p_partkey", similarity.at_least(F.array(*[F.lit(i) for i in range(10, 0, -1)]), F.col("p_size") - 20).cast("long").alias("n"))


@query
def penalty_added(spark, d):
    return table(spark, d, "part").select("p_partkey", T.added_penalty(F.when(F.col("p_size") > 25, F.col("p_brand")), F.col("p_type")).alias("penalty"))


@query
def distinct_products(spark, d):
    return corpus(spark, d).select("product").distinct()


@query
def cluster_sentences(spark, d):
    s = recommend.sentence_rows(incoming(spark, d).withColumnRenamed("query_id", "bug_id"))
    rows = s.select(F.struct("bug_id", "pos").alias("bug_id"), F.lit("").alias("summ"), F.col("sentence").alias("desc"))
    counts = terms.term_counts(rows, TFIDF, synonyms=False)
    n = corpus(spark, d).count()
    dfs = terms.field_counts(terms.term_counts(corpus(spark, d), BIDF, synonyms=False))
    w = terms.weights(counts, dfs, n, "tfidf").filter("w > 0").select(F.col("bug_id").alias("id"), "term", "w")
    return recommend.cluster_sentences(checkpointed(recommend.sentence_features(w)), 5)


def _stemmed(name):
    def f(spark, d):
        words = terms.token_rows(corpus(spark, d), BIDF, strip=False).select("term")
        return stem.stem_table(words, name)

    return f


for _name in ("porter2", "porter", "lancaster"):
    QUERIES[f"stem_{_name}"] = _stemmed(_name)
