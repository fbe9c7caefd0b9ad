"""The SQL that each query must agree with, for DuckDB."""

from __future__ import annotations

from ..functions.text import ENTITIES, TEMPLATES, TIPS
from ..functions.words import DOMAIN_STOP_WORDS, STOP_WORDS, SYNONYMS


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(items) -> str:
    return ", ".join(quoted(x) for x in items)


def strip(x: str) -> str:
    for p in TEMPLATES:
        x = f"regexp_replace({x}, {quoted(p)}, ' ', 'gi')"
    return x


def decode(x: str) -> str:
    for a, b in ENTITIES:
        x = f"replace({x}, {quoted(a)}, {'chr(10)' if a == 'NEWLINE' else quoted(b)})"
    return x


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '(?:^|[^\\pL\\pN_])([a-zA-Z](?:[-_]?[a-zA-Z0-9])*)', 1)"


FIRST_LINE = "split_part(text, chr(10), 1)"
REPORTS = f"reports AS (SELECT doc_id AS bug_id, source AS product, doc_id * 86400 AS ts, lower({FIRST_LINE}) AS summ, lower(text) AS descr FROM documents)"
INCOMING = f"incoming AS (SELECT item_id AS query_id, lower({FIRST_LINE}) AS summ, lower(text) AS descr FROM benchmark)"


def counts(name: str, source: str, key: str, stop: bool = True) -> str:
    """A CTE of key, field, term, tf."""
    kept = f" WHERE length(term) >= 3 AND term NOT IN ({listed(STOP_WORDS + DOMAIN_STOP_WORDS)})" if stop else ""
    return (
        f"{name} AS (SELECT {key}, field, term, count(*)::BIGINT AS tf FROM (SELECT {key}, 'summ' AS field, unnest({tokens('summ')}) AS term FROM {source}"
        f" UNION ALL SELECT {key}, 'desc', unnest({tokens(strip('descr'))}) FROM {source}) t{kept} GROUP BY {key}, field, term)"
    )


COUNTS = f"{REPORTS}, {INCOMING}, {counts('tc', 'reports', 'bug_id')}, {counts('qtc', 'incoming', 'query_id')}, total AS (SELECT count(*) AS n FROM documents), dfs AS (SELECT field, term, count(*) AS df FROM tc GROUP BY field, term)"
IDF = "ln(((SELECT n FROM total) + 1) / (1 + coalesce(d.df, 0)))"


def vectors(name: str, source: str, key: str, algorithm: str) -> str:
    if algorithm == "bidf":
        return f"{name} AS (SELECT x.{key}, x.field, x.term, {IDF} AS w FROM {source} x LEFT JOIN dfs d USING (field, term))"
    return (
        f"{name}_raw AS (SELECT x.{key}, x.field, x.term, x.tf * {IDF} AS w FROM {source} x LEFT JOIN dfs d USING (field, term)), "
        f"{name} AS (SELECT {key}, field, term, CASE WHEN sqrt(sum(w * w) OVER (PARTITION BY {key}, field)) > 1e-4 THEN w / sqrt(sum(w * w) OVER (PARTITION BY {key}, field)) ELSE w END AS w FROM {name}_raw)"
    )


def weighted(algorithm: str) -> str:
    return f"WITH {COUNTS}, {vectors('vec', 'tc', 'bug_id', algorithm)}, {vectors('qvec', 'qtc', 'query_id', algorithm)}"


DOTS = (
    "dots AS (SELECT q.query_id, v.bug_id, coalesce(sum(q.w * v.w) FILTER (q.field = 'summ'), 0) AS summ, coalesce(sum(q.w * v.w) FILTER (q.field = 'desc'), 0) AS descr"
    " FROM qvec q JOIN vec v USING (field, term) WHERE q.w != 0 AND v.w != 0 GROUP BY q.query_id, v.bug_id)"
)
LENGTHS = "lengths AS (SELECT query_id, coalesce(sum(w * w) FILTER (field = 'summ'), 0) AS s2, coalesce(sum(w * w) FILTER (field = 'desc'), 0) AS d2 FROM qvec GROUP BY query_id)"
ASM = "CASE WHEN {len2} < 1e-6 THEN 1.0 ELSE greatest(0, {top} / {len2}) END"
COMPARED = (
    f"{weighted('bidf')}, {DOTS}, {LENGTHS}, compared AS (SELECT query_id, bug_id, {ASM.format(len2='s2', top='summ')}::DOUBLE AS rs, {ASM.format(len2='d2', top='descr')}::DOUBLE AS rd FROM dots JOIN lengths USING (query_id))"
)
SCORED = f"{COMPARED}, scored AS (SELECT query_id, bug_id, round(rs * 0.5 + rd * 0.5, 6) AS score FROM compared), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bug_id) AS rank FROM scored)"
SIMILAR = (
    f"{SCORED}, spread AS (SELECT query_id, CASE WHEN (SELECT n FROM total) > count(*) THEN least(0.0, min(score)) ELSE min(score) END AS lo, max(score) AS hi FROM scored GROUP BY query_id),"
    " sim AS (SELECT query_id, bug_id, score, round(lo + (hi - lo) * 0.8::DOUBLE, 6) AS cut, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bug_id) AS rank"
    " FROM scored JOIN spread USING (query_id) WHERE hi >= 0.2 AND score >= round(lo + (hi - lo) * 0.8::DOUBLE, 6))"
)
EDGES = "edges AS (SELECT doc_id AS src, first AS dst FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents) WHERE doc_id != first)"
INCOMPLETE = "bad AS (SELECT DISTINCT doc_id AS bug_id FROM labels WHERE quality = 0)"
GROUPS = (
    f"{EDGES}, {INCOMPLETE}, both_ways AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges),"
    " reach AS (SELECT a AS node, a AS root FROM both_ways UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node),"
    ' rooted AS (SELECT node AS bug_id, min(root) AS "group" FROM reach GROUP BY node),'
    ' members AS (SELECT bug_id, "group" FROM rooted WHERE bug_id NOT IN (SELECT bug_id FROM bad)),'
    ' sizes AS (SELECT r."group", (SELECT count(*) FROM edges e JOIN rooted s ON s.bug_id = e.src WHERE s."group" = r."group") + 1 - count(b.bug_id) AS size, count(*) - count(b.bug_id) AS n_members'
    ' FROM rooted r LEFT JOIN bad b ON b.bug_id = r.bug_id GROUP BY r."group" HAVING count(*) > count(b.bug_id))'
)


def recursive(sql: str) -> str:
    return "WITH RECURSIVE " + sql.removeprefix("WITH ")


TEN = f"{SCORED}, best AS (SELECT * FROM ranked WHERE rank <= 10)"
DIFFERENCE = (
    ", known AS (SELECT query_id, field, term FROM qtc UNION SELECT query_id, 'desc', term FROM qtc WHERE field = 'summ'),"
    " diff AS (SELECT b.query_id, b.bug_id, t.field, t.term FROM best b JOIN tc t ON t.bug_id = b.bug_id ANTI JOIN known k ON k.query_id = b.query_id AND k.field = t.field AND k.term = t.term)"
)
DIFFERENCES = TEN + DIFFERENCE
KEYWORD = (
    ", sums AS (SELECT query_id, sum(score) AS total_score FROM best GROUP BY query_id),"
    " mass AS (SELECT d.query_id, d.term, sum(b.score) AS mass FROM diff d JOIN best b ON b.query_id = d.query_id AND b.bug_id = d.bug_id WHERE d.field = 'desc' GROUP BY d.query_id, d.term),"
    f" keys AS (SELECT m.query_id, m.term, round((1 - 2 * abs(m.mass / s.total_score - 0.5)) * ({IDF} / ln((SELECT n FROM total) + 1)), 6) AS score"
    " FROM mass m JOIN sums s ON s.query_id = m.query_id AND s.total_score > 0 LEFT JOIN dfs d ON d.field = 'desc' AND d.term = m.term),"
    " chosen AS (SELECT query_id, term, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, term) AS k FROM keys) WHERE k = 1)"
)
KEYWORDS = DIFFERENCES + KEYWORD
SENTENCES = "SELECT bug_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence FROM (SELECT bug_id, string_split_regex(descr, '\\.[ \\n]|\\n\\n') AS s FROM reports)"
DROPPED = r"\+1 \([0-9]{3}\)|token = "
TRACES = (
    f"turns AS (SELECT conv_id, role, turn, {tokens('lower(text)')} AS t FROM conversations WHERE role IN ('user', 'assistant')),"
    " convs AS (SELECT DISTINCT conv_id FROM turns),"
    " numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, t) AS k FROM turns),"
    " aligned AS (SELECT u.conv_id, u.k, u.t AS u, a.t AS a, list_distinct(u.t) AS ud, list_distinct(a.t) AS ad FROM numbered u JOIN numbered a ON u.conv_id = a.conv_id AND u.k = a.k AND u.role = 'user' AND a.role = 'assistant'),"
    " known AS (SELECT conv_id, k, list_filter(ud, lambda x: x NOT IN ('??', 'unknown')) AS u, list_filter(ad, lambda x: x NOT IN ('??', 'unknown')) AS a FROM aligned),"
    " shared AS (SELECT conv_id, k, len(list_intersect(u, a)) AS i, len(list_distinct(list_concat(u, a))) AS n FROM known)"
)
HITS = (
    "{name} AS (SELECT f.query_id, f.bug_id, coalesce(o.\"group\" = t.\"group\", false) AS hit FROM {found} f LEFT JOIN members o ON o.bug_id = f.query_id LEFT JOIN members t ON t.bug_id = f.bug_id WHERE f.query_id != f.bug_id)"
)


def macro(name: str, hits: str, join: str) -> str:
    return (
        f"all_{name} AS (SELECT count(*) AS {name}_cases, round(avg(CASE WHEN coalesce(n, 0) > 0 THEN h / n ELSE 0.0 END), 6) AS {name}_precision, round(avg(coalesce(h, 0) / n_true), 6) AS {name}_recall,"
        f" round(avg(CASE WHEN coalesce(h, 0) > 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS {name}_binary_recall, round(avg(coalesce(n, 0)), 6) AS {name}_size"
        f" FROM (SELECT * FROM cases WHERE n_true > 0) c {join} (SELECT query_id, count(*) AS n, count(*) FILTER (hit) AS h FROM {hits} GROUP BY query_id) x USING (query_id))"
    )


def score(strategy: str) -> str:
    nl = "(rs * 0.5 + rd * 0.5)"
    return {
        "weighted": f"{nl} + 1.0 * 0.2",
        "heuristic": f"CASE WHEN {nl} > 0.2 THEN 0.75 + 0.25 * ({nl} + 1.0) / 2 ELSE 0.25 + 0.25 * 1.0 END",
        "distweighted": f"0.7::DOUBLE * {nl} + (1 - 0.7::DOUBLE)",
    }[strategy]


PAIRS = [(a, b) for g in SYNONYMS for a in g for b in g if a != b]
QUERY_TEN = "SELECT query_id, bug_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bug_id) AS rank FROM s) WHERE rank <= 10"

ORACLE_SQL: dict[str, str] = {
    "tokenize": f"WITH {REPORTS}, lists AS (SELECT bug_id, 'summ' AS field, {tokens('summ')} AS t FROM reports UNION ALL SELECT bug_id, 'desc', {tokens('descr')} FROM reports) SELECT bug_id, field, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS term FROM lists",
    "decode_entities": f"SELECT page_id, {decode('html')} AS decoded FROM pages",
    "strip_template": f"SELECT page_id, {strip('html')} AS stripped FROM pages",
    "term_count": f"WITH {REPORTS}, {counts('tc', 'reports', 'bug_id', False)} SELECT * FROM tc",
    "stopword_filter": f"WITH {REPORTS}, {counts('tc', 'reports', 'bug_id')} SELECT * FROM tc",
    "synonym_expand": f"WITH p AS (SELECT page_id AS bug_id, lower(url) AS summ, lower(html) || ' email click folder ' || lower(url) AS descr FROM pages), {counts('tc', 'p', 'bug_id')}, syn(a, b) AS (VALUES "
    + ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in PAIRS)
    + "), added AS (SELECT bug_id, field, b AS term, max(tf) AS tf FROM tc JOIN syn ON a = term GROUP BY bug_id, field, b) SELECT * FROM tc UNION ALL SELECT * FROM added ANTI JOIN tc USING (bug_id, field, term)",
    "document_count": f"WITH {REPORTS}, {counts('tc', 'reports', 'bug_id')} SELECT term, count(*) FILTER (field = 'summ') AS summ, count(*) FILTER (field = 'desc') AS \"desc\" FROM tc GROUP BY term",
    "report_total": "SELECT count(*) AS n FROM documents",
    "idf": f"WITH {COUNTS} SELECT field, term, df, round({IDF}, 6) AS idf FROM dfs d",
    "unit_idf": f"WITH {COUNTS} SELECT field, term, round({IDF} / ln((SELECT n FROM total) + 1), 6) AS unit_idf FROM dfs d",
    "tfidf_norm": f"{weighted('tfidf')} SELECT bug_id, field, term, round(w, 6) AS w FROM vec",
    "bidf": f"{weighted('bidf')} SELECT bug_id, field, term, round(w, 6) AS w FROM vec",
    "squared_length": f"{weighted('bidf')} SELECT bug_id, field, round(sum(w * w), 6) AS len2 FROM vec GROUP BY bug_id, field",
    "dot_similarity_topn": f"{weighted('tfidf')}, {DOTS}, s AS (SELECT query_id, bug_id, round(summ * 0.5 + descr * 0.5, 6) AS score FROM dots) {QUERY_TEN}",
    "asm_similarity_topn": f"{SCORED} SELECT query_id, bug_id, score, rank FROM ranked WHERE rank <= 10",
    "asm_similarity_penalty": f"{weighted('bidf')}, {DOTS}, {LENGTHS}, pen AS (SELECT bug_id, sum(w) AS penalty FROM vec WHERE field = 'desc' AND term IN ('and', 'onth', 'that', 'thea') GROUP BY bug_id),"
    f" s AS (SELECT query_id, bug_id, round({ASM.format(len2='d2', top='(descr - coalesce(penalty, 0))')}, 6)::DOUBLE AS score FROM dots JOIN lengths USING (query_id) LEFT JOIN pen USING (bug_id)) {QUERY_TEN}",
    "candidate_prefilter": f"WITH {REPORTS} SELECT b.item_id AS query_id, r.bug_id FROM benchmark b JOIN reports r ON r.product = 'src' || (b.item_id % 20) WHERE r.ts > b.item_id * 8640000 - 63072000 AND r.bug_id != b.item_id AND r.bug_id != b.item_id + 20",
    **{f"score_{k}": f"{COMPARED}, s AS (SELECT query_id, bug_id, round({score(k)}, 6)::DOUBLE AS score FROM compared) {QUERY_TEN}" for k in ("weighted", "heuristic", "distweighted")},
    "similar_cut": f"{SIMILAR} SELECT query_id, bug_id, score, cut, rank FROM sim",
    "duplicate_decision": f"{recursive(SIMILAR)}, {GROUPS}, few AS (SELECT s.query_id, count(DISTINCT m.\"group\") AS n_groups FROM sim s LEFT JOIN members m USING (bug_id) GROUP BY s.query_id HAVING count(DISTINCT m.\"group\") <= 10)"
    " SELECT query_id, bug_id, score, rank, n_groups FROM sim JOIN few USING (query_id) WHERE rank <= 5",
    "score_quantiles": f"{SCORED}, spread AS (SELECT query_id, count(*) AS n, max(score) AS hi, min(score) AS lo FROM scored GROUP BY query_id)"
    " SELECT query_id, n, count(*) FILTER (score > round(hi - (hi - lo) * 0.1::DOUBLE, 6)) AS near_top, "
    + ", ".join(f"max(score) FILTER (rank = least(floor({q / 100}::DOUBLE * n), n - 1) + 1) AS q{q}" for q in (0, 20, 40, 60, 80, 100))
    + " FROM ranked JOIN spread USING (query_id) GROUP BY query_id, n",
    "duplicate_positions": f"{recursive(SCORED)}, {GROUPS}, truth AS (SELECT DISTINCT r.query_id, t.bug_id FROM ranked r JOIN members m ON m.bug_id = r.bug_id JOIN members t ON t.\"group\" = m.\"group\" WHERE r.rank = 1)"
    " SELECT query_id, bug_id, rank - 1 AS position, score FROM ranked JOIN truth USING (query_id, bug_id)",
    "duplicate_components": f'WITH RECURSIVE {GROUPS} SELECT bug_id, "group" FROM members',
    "duplicate_group_size": f'WITH RECURSIVE {GROUPS} SELECT "group", size, n_members FROM sizes',
    "star_groups": f'WITH {EDGES} SELECT bug_id, max(g) AS "group" FROM (SELECT dst AS g, src AS bug_id FROM edges UNION ALL SELECT dst, dst FROM edges) GROUP BY bug_id',
    "star_group_size": f'WITH {EDGES} SELECT dst AS "group", count(DISTINCT src) + 1 AS size FROM edges GROUP BY dst',
    "group_size_range": f'WITH RECURSIVE {GROUPS} SELECT "group", size, n_members FROM sizes WHERE size > 1 AND size < 4',
    "group_strata": f"WITH RECURSIVE {GROUPS} SELECT \"group\", CASE WHEN size < 3 THEN 'small' WHEN size < 5 THEN 'middle' ELSE 'large' END AS stratum FROM sizes WHERE size > 0 AND size NOT IN (3, 5) AND size < 99999",
    "group_span": f'WITH RECURSIVE {GROUPS}, {REPORTS} SELECT "group", coalesce(max(ts) - min(ts), -10000000999) AS span, count(DISTINCT product) AS n_products FROM members LEFT JOIN reports USING (bug_id) GROUP BY "group"',
    "same_group_hits": f"WITH RECURSIVE {GROUPS}, found AS (SELECT doc_id AS query_id, unnest([doc_id, doc_id + 1, doc_id - 1]) AS bug_id FROM documents UNION ALL SELECT src, dst FROM edges), {HITS.format(name='hits', found='found')} SELECT * FROM hits",
    "product_counts": "SELECT p_brand AS product, count(*) AS n, '<option>' || p_brand || '</option> <!--' || count(*) || '-->' AS line FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand HAVING count(*) >= 70",
    "report_difference": f"{DIFFERENCES} SELECT query_id, bug_id, field, term FROM diff",
    "keyword_scores": f"{KEYWORDS} SELECT query_id, term, score FROM keys",
    "keyword_entropy": f"{KEYWORDS} SELECT query_id, term, score FROM chosen",
    "sentence_split": f"WITH {REPORTS} {SENTENCES}",
    "sentences_with_term": f"{KEYWORDS}, sentences AS ({SENTENCES}) SELECT b.query_id, b.bug_id, s.pos, s.sentence FROM best b JOIN chosen c USING (query_id) JOIN sentences s ON s.bug_id = b.bug_id WHERE list_contains({tokens(strip('s.sentence'))}, c.term)",
    "compare_bow": f"{SCORED}, first AS (SELECT query_id, bug_id FROM ranked WHERE rank = 1), x AS (SELECT f.query_id, f.bug_id, t.term, t.tf FROM first f JOIN qtc t ON t.query_id = f.query_id AND t.field = 'desc'),"
    " y AS (SELECT f.query_id, f.bug_id, t.term, t.tf FROM first f JOIN tc t ON t.bug_id = f.bug_id AND t.field = 'desc')"
    " SELECT query_id, bug_id, term, coalesce(x.tf, 0) AS a, coalesce(y.tf, 0) AS b, least(coalesce(x.tf, 0), coalesce(y.tf, 0)) AS shared FROM x FULL JOIN y USING (query_id, bug_id, term)",
    "compare_tfidf": f"{SCORED}, {vectors('tv', 'tc', 'bug_id', 'tfidf')}, {vectors('tq', 'qtc', 'query_id', 'tfidf')}, first AS (SELECT query_id, bug_id FROM ranked WHERE rank = 1),"
    " x AS (SELECT f.query_id, f.bug_id, t.term, t.w FROM first f JOIN tq t ON t.query_id = f.query_id AND t.field = 'desc'), y AS (SELECT f.query_id, f.bug_id, t.term, t.w FROM first f JOIN tv t ON t.bug_id = f.bug_id AND t.field = 'desc')"
    f" SELECT query_id, bug_id, term, round(coalesce(x.w, 0), 6) AS a, round(coalesce(y.w, 0), 6) AS b, round(coalesce(x.w, 0) * coalesce(y.w, 0), 6) AS product, coalesce(d.df, 0)::BIGINT AS df, round({IDF}, 6) AS idf FROM x FULL JOIN y USING (query_id, bug_id, term) LEFT JOIN (SELECT term, df FROM dfs WHERE field = 'desc') d USING (term)",
    "drop_report_filter": f"WITH {REPORTS} SELECT bug_id, product FROM reports WHERE NOT regexp_matches(descr, {quoted(DROPPED)})",
    "remove_bad_reports": f'WITH RECURSIVE {GROUPS}, {REPORTS} SELECT bug_id, "group" FROM members WHERE bug_id NOT IN (SELECT bug_id FROM reports WHERE regexp_matches(descr, {quoted(DROPPED)}))',
    "report_serde": f"WITH {REPORTS} SELECT ts AS create_ts, product, summ, descr || ' ' AS \"desc\", 'a;b|c' AS penalty, bug_id AS dummy_bug_id, bug_id || '|' || (bug_id + 1) AS exclude_ids, 'skip' AS skip_terms FROM reports",
    "stack_similarity_weight": f"WITH {TRACES} SELECT conv_id, round(coalesce(sum(i) / nullif(sum(n), 0), 0.0), 6) AS similarity FROM convs LEFT JOIN shared USING (conv_id) GROUP BY conv_id",
    "stack_similarity_max": f"WITH {TRACES} SELECT conv_id, round(CASE WHEN count(k) = 0 OR min(n) = 0 THEN 0.0 ELSE max(i / nullif(n, 0)) END, 6)::DOUBLE AS similarity FROM convs LEFT JOIN shared USING (conv_id) GROUP BY conv_id",
    "stack_similarity_signal": f"WITH {TRACES}, u AS (SELECT conv_id, list_distinct(t) AS t FROM numbered WHERE role = 'user' AND k = 1), a AS (SELECT conv_id, list_distinct(t) AS t FROM numbered WHERE role = 'assistant' AND k = 1)"
    " SELECT conv_id, round(CASE WHEN u.t IS NULL OR len(u.t) = 0 THEN 1.0 WHEN a.t IS NULL THEN 0.0 ELSE len(list_intersect(u.t, a.t)) / len(u.t) END, 6)::DOUBLE AS similarity FROM convs LEFT JOIN u USING (conv_id) LEFT JOIN a USING (conv_id)",
    "stack_text": f"WITH {TRACES}, lines AS (SELECT conv_id, string_agg(CASE WHEN len(t) > 0 THEN chr(10) || array_to_string(list_transform(t, lambda f: '#2  0xb588f19f in ' || f || ' ()'), chr(10)) ELSE '' END, chr(10) ORDER BY k) AS s FROM numbered WHERE role = 'user' GROUP BY conv_id)"
    " SELECT conv_id, coalesce('Distribution: Ubuntu 6.10 (edgy)' || chr(10) || 'Gnome Release: 2.16.1 2006-10-02 (Ubuntu)' || chr(10) || 'BugBuddy Version: 2.16.0' || chr(10) || chr(10) || s, '') AS stack FROM convs LEFT JOIN lines USING (conv_id)",
    "eval_macro": f"WITH RECURSIVE {GROUPS}, cases AS (SELECT bug_id AS query_id, count(*) OVER (PARTITION BY \"group\") - 1 AS n_true FROM members), f1 AS (SELECT doc_id AS query_id, unnest([doc_id + 1, doc_id - 1]) AS bug_id FROM documents UNION ALL SELECT src, dst FROM edges),"
    f" f2 AS (SELECT src AS query_id, dst AS bug_id FROM edges), {HITS.format(name='h1', found='f1')}, {HITS.format(name='h2', found='f2')}, {macro('similar', 'h1', 'LEFT JOIN')}, {macro('duplicate', 'h2', 'JOIN')} SELECT * FROM all_similar, all_duplicate",
    "session_fold": "WITH c AS (SELECT conv_id AS session_id, turn AS seq, CASE WHEN turn = 6 THEN 'do_submit' WHEN role = 'system' THEN 'set_report_info' WHEN role = 'user' THEN 'set_report_basic_info' ELSE 'add_penalty' END AS command, text AS argument FROM conversations),"
    " alive AS (SELECT c.* FROM c LEFT JOIN (SELECT session_id, min(seq) AS e FROM c WHERE command = 'do_submit' GROUP BY session_id) x USING (session_id) WHERE e IS NULL OR seq <= e),"
    " resets AS (SELECT session_id, max(seq) FILTER (command = 'set_report_info') AS r FROM alive GROUP BY session_id)"
    " SELECT session_id, arg_max(argument, seq) FILTER (command IN ('set_report_info', 'set_report_basic_info')) AS report,"
    " count(DISTINCT argument) FILTER (command = 'add_penalty' AND (r IS NULL OR seq > r)) AS n_penalty,"
    " coalesce(array_to_string(list_sort(list(DISTINCT argument) FILTER (command = 'add_penalty' AND (r IS NULL OR seq > r))), '|'), '') AS penalty,"
    " max(command) FILTER (command = 'do_submit') AS ended, count(*) AS n_commands FROM alive JOIN resets USING (session_id) GROUP BY session_id",
    "tip_case": f"SELECT p_partkey, CASE WHEN p_size - 40 > 0 THEN {quoted(TIPS[0])} WHEN p_size - 20 > 0 THEN {quoted(TIPS[1])} ELSE {quoted(TIPS[2])} END AS tip FROM part",
    "truncate_text": f"WITH {REPORTS} SELECT bug_id, CASE WHEN length(descr) > 512 THEN substr(descr, 1, 512) || ' ...' ELSE descr END AS shown FROM reports",
    "incomplete_words": f"WITH {REPORTS}, t AS (SELECT bug_id, {tokens(strip('descr'))} AS t FROM reports), w AS (SELECT bug_id, generate_subscripts(t, 1) - 1 AS i, unnest(t) AS w FROM t),"
    " kept AS (SELECT bug_id, string_agg(w, ' ' ORDER BY i) AS partial FROM w WHERE ('0x' || substr(md5('drop:' || bug_id || ':' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE >= 0.5 GROUP BY bug_id)"
    " SELECT bug_id, coalesce(partial, '') AS partial FROM reports LEFT JOIN kept USING (bug_id)",
    "date_seconds": "SELECT o_orderkey, epoch(date_trunc('day', o_orderdate))::BIGINT AS seconds FROM orders",
    "frame_names": "SELECT event_id, replace(event_type, ' ', '_') AS frame FROM events",
    "similarity_over_candidates": f"{COMPARED}, asked AS (SELECT b.item_id AS query_id, 'src' || (b.item_id % 20) AS product, b.item_id * 8640000 AS ts, CASE WHEN b.item_id % 2 = 0 THEN list_slice({tokens('lower(b.text)')}, 1, 8) ELSE [] END AS t FROM benchmark b),"
    f" theirs AS (SELECT bug_id, product, ts, CASE WHEN bug_id % 3 = 0 THEN list_slice({tokens('descr')}, 1, 8) END AS t FROM reports),"
    " cand AS (SELECT a.query_id, r.bug_id, a.t AS u, r.t AS v FROM asked a JOIN theirs r USING (product) WHERE r.ts > a.ts - 63072000 AND r.bug_id != a.query_id AND r.bug_id != a.query_id + 20),"
    " three AS (SELECT c.query_id, c.bug_id, coalesce(p.rs, CASE WHEN coalesce(l.s2, 0) < 1e-6 THEN 1.0 ELSE 0.0 END)::DOUBLE AS rs, coalesce(p.rd, CASE WHEN coalesce(l.d2, 0) < 1e-6 THEN 1.0 ELSE 0.0 END)::DOUBLE AS rd,"
    " CASE WHEN len(u) = 0 THEN 1.0 WHEN v IS NULL THEN 0.0 ELSE coalesce(len(list_intersect(list_distinct(list_filter(u, lambda x: x NOT IN ('??', 'unknown'))), v)) / nullif(len(list_distinct(list_filter(list_concat(u, v), lambda x: x NOT IN ('??', 'unknown')))), 0), 0.0) END::DOUBLE AS rt"
    " FROM cand c LEFT JOIN compared p ON p.query_id = c.query_id AND p.bug_id = c.bug_id LEFT JOIN lengths l ON l.query_id = c.query_id), both_of AS (SELECT *, rs * 0.5 + rd * 0.5 AS nl FROM three)"
    " SELECT query_id, bug_id, round(rs, 6) AS rs, round(rd, 6) AS rd, round(rt, 6) AS rt, round(CASE WHEN nl > 0.2 AND rt > 0.05 THEN 0.75 + 0.25 * (nl + rt) / 2 WHEN nl > 0.2 THEN 0.5 + 0.25 * nl WHEN rt > 0.05 THEN 0.25 + 0.25 * rt ELSE 0.25 * (nl + rt) / 2 END, 6)::DOUBLE AS score FROM both_of",
    "keyword_top": f"{KEYWORDS} SELECT query_id, term, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, term) AS rank FROM keys) WHERE rank <= 10",
    "text_query": f"{SCORED} SELECT query_id, string_agg(bug_id::VARCHAR, ';' ORDER BY rank) AS ids FROM ranked WHERE rank <= 10 GROUP BY query_id",
    "recommend_duplicates": f"{recursive(SIMILAR)}, {GROUPS}, few AS (SELECT s.query_id FROM sim s LEFT JOIN members m USING (bug_id) GROUP BY s.query_id HAVING count(DISTINCT m.\"group\") <= 10)"
    " SELECT query_id, bug_id, rank, summ, descr AS \"desc\" FROM sim JOIN few USING (query_id) JOIN reports USING (bug_id) WHERE rank <= 5",
    "explain_pairs": f"{SCORED}, first AS (SELECT r.query_id, r.bug_id, r.score, c.rs, c.rd FROM ranked r JOIN compared c USING (query_id, bug_id) WHERE r.rank = 1),"
    " both_have AS (SELECT f.query_id, count(*) AS n FROM first f JOIN qtc q ON q.query_id = f.query_id JOIN tc t ON t.bug_id = f.bug_id AND t.field = q.field AND t.term = q.term GROUP BY f.query_id)"
    " SELECT f.query_id, f.bug_id, i.summ AS ours, r.summ AS theirs, round(rs, 6) AS rs, round(rd, 6) AS rd, score, coalesce(n, 0) AS n_shared FROM first f JOIN incoming i USING (query_id) JOIN reports r USING (bug_id) LEFT JOIN both_have USING (query_id)",
    "eval_rankings": f"{recursive(SIMILAR)}, {GROUPS}, own AS (SELECT s.query_id, m.\"group\" AS own FROM sim s JOIN members m USING (bug_id) WHERE s.rank = 1), cases AS (SELECT query_id, count(*) AS n_true FROM own JOIN members ON \"group\" = own GROUP BY query_id),"
    " h1 AS (SELECT s.query_id, s.bug_id, s.rank, coalesce(m.\"group\" = o.own, false) AS hit FROM sim s JOIN own o USING (query_id) LEFT JOIN members m ON m.bug_id = s.bug_id),"
    " few AS (SELECT s.query_id FROM sim s LEFT JOIN members m USING (bug_id) GROUP BY s.query_id HAVING count(DISTINCT m.\"group\") <= 10), h2 AS (SELECT * FROM h1 JOIN few USING (query_id) WHERE rank <= 5),"
    f" {macro('similar', 'h1', 'LEFT JOIN')}, {macro('duplicate', 'h2', 'JOIN')} SELECT * FROM all_similar, all_duplicate",
    "scores_at_least": "SELECT p_partkey, greatest(0, least(10, 11 - (p_size - 20)))::BIGINT AS n FROM part",
    "penalty_added": "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand || ',' || p_type ELSE p_type END AS penalty FROM part",
    "distinct_products": "SELECT DISTINCT source AS product FROM documents",
}

# From the similar reports on.
HELD = (
    f"{SIMILAR}, best AS (SELECT query_id, bug_id, score, rank FROM sim){DIFFERENCE}{KEYWORD}, sentences AS ({SENTENCES}),"
    f" held AS (SELECT b.query_id, b.bug_id, b.rank, s.pos, s.sentence FROM best b JOIN chosen c USING (query_id) JOIN sentences s ON s.bug_id = b.bug_id WHERE list_contains({tokens(strip('s.sentence'))}, c.term)),"
    " sized AS (SELECT query_id, bug_id, coalesce(sum(count(*)) OVER (PARTITION BY query_id ORDER BY min(rank) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM held GROUP BY query_id, bug_id),"
    " taken AS (SELECT query_id, bug_id, pos, sentence FROM held JOIN sized USING (query_id, bug_id) WHERE ahead <= 1000)"
)
ORACLE_SQL["recommend_sentences"] = f"{HELD} SELECT query_id, bug_id, pos, sentence FROM taken"
ORACLE_SQL["recommend_answers"] = (
    f"{recursive(HELD)}, {GROUPS}, few AS (SELECT s.query_id FROM sim s LEFT JOIN members m USING (bug_id) GROUP BY s.query_id HAVING count(DISTINCT m.\"group\") <= 10),"
    " again AS (SELECT query_id, count(*) AS n, string_agg(bug_id::VARCHAR, ',' ORDER BY rank) AS ids FROM sim JOIN few USING (query_id) WHERE rank <= 5 GROUP BY query_id),"
    " said AS (SELECT query_id, count(*) AS n FROM taken GROUP BY query_id), found AS (SELECT query_id, count(*) AS n_similar FROM sim GROUP BY query_id)"
    f" SELECT f.query_id, n_similar, c.term AS keyword, coalesce(s.n, 0) AS n_sentences, coalesce(a.ids, '') AS duplicates, CASE WHEN a.n > 0 THEN {quoted(TIPS[0])} WHEN s.n > 0 THEN {quoted(TIPS[1])} ELSE {quoted(TIPS[2])} END AS tip"
    " FROM found f LEFT JOIN chosen c USING (query_id) LEFT JOIN said s USING (query_id) LEFT JOIN again a USING (query_id)"
)

# Files that Spark wrote from the tables, read again.
CODED = "split_part(replace(replace({x}, chr(10), 'NEWLINE'), ';', 'SEMICOLON'), '=', 1)"
ORACLE_SQL |= {
    "level1_tables": f"WITH x AS (SELECT doc_id AS bug_id, lower({decode(CODED.format(x=FIRST_LINE))}) AS summ, lower({decode(CODED.format(x='text'))}) AS \"desc\", 0::BIGINT AS n_threads, doc_id * 60 AS ts, lower(source) AS product FROM documents WHERE doc_id % 10 > 1)"
    f' SELECT * FROM x WHERE NOT regexp_matches("desc", {quoted(DROPPED)})',
    "dump_tables": "WITH x AS (SELECT doc_id, source, replace(text, chr(10), ' ') AS t FROM documents) SELECT doc_id AS bug_id, split_part(doc_id || '|' || substr(t, 1, 40) || '|' || t, '|', 2) AS summ, split_part(doc_id || '|' || substr(t, 1, 40) || '|' || t, '|', 3) AS \"desc\","
    " 0::BIGINT AS n_threads, doc_id * 100 AS ts, source AS product FROM x",
    "level0_groups": "WITH RECURSIVE " + GROUPS.replace("WHERE doc_id != first)", "WHERE doc_id != first AND (doc_id % 2 = 0 OR doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)))") + ' SELECT bug_id, "group", size, n_members FROM members JOIN sizes USING ("group")',
}

# Reports drawn from groups, without some of their words, as incoming reports.
DRAWN = (
    "strata AS (SELECT \"group\", CASE WHEN size < 3 THEN 'small' WHEN size < 5 THEN 'middle' ELSE 'large' END AS stratum FROM sizes WHERE size > 0 AND size NOT IN (3, 5) AND size < 99999),"
    " turns AS (SELECT s.*, unnest(range(1, CASE stratum WHEN 'small' THEN 5 ELSE 4 END)) AS draw FROM strata s),"
    " chosen_groups AS (SELECT stratum, draw, arg_min(\"group\", md5('1:g:' || draw || ':' || \"group\")) AS \"group\" FROM turns GROUP BY stratum, draw),"
    " drawn AS (SELECT stratum, draw, arg_min(bug_id, md5('1:b:' || draw || ':' || bug_id)) AS bug_id FROM chosen_groups JOIN members USING (\"group\") GROUP BY stratum, draw),"
    " rated AS (SELECT d.*, unnest([0.0, 0.2, 0.4, 0.6, 0.8])::DOUBLE AS rate FROM drawn d),"
    " whole AS (SELECT row_number() OVER () AS query_id, x.rate, x.stratum, x.bug_id AS dummy_bug_id, r.ts AS create_ts, r.product, r.summ, r.descr FROM rated x JOIN reports r USING (bug_id)),"
    + " ".join(
        f"{c}_words AS (SELECT query_id, string_agg(w, ' ' ORDER BY i) AS left_over FROM (SELECT query_id, rate, dummy_bug_id, generate_subscripts(t, 1) - 1 AS i, unnest(t) AS w FROM (SELECT *, {tokens(strip(c))} AS t FROM whole))"
        " WHERE ('0x' || substr(md5('drop:' || dummy_bug_id || ':' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE >= rate GROUP BY query_id),"
        for c in ("summ", "descr")
    )
    + " asked AS (SELECT w.* EXCLUDE (summ, descr), CASE WHEN rate <= 0.001 THEN w.summ ELSE coalesce(s.left_over, '') END AS summ, CASE WHEN rate <= 0.001 THEN w.descr ELSE coalesce(d.left_over, '') END AS descr"
    " FROM whole w LEFT JOIN summ_words s USING (query_id) LEFT JOIN descr_words d USING (query_id))"
)
ORACLE_SQL["test_cases"] = f"WITH RECURSIVE {REPORTS}, {GROUPS}, {DRAWN} SELECT rate, stratum, create_ts, product, summ, descr || ' ' AS \"desc\", dummy_bug_id FROM asked"
JUDGED = (
    recursive(SIMILAR)
    .replace(INCOMING, f"{GROUPS}, {DRAWN}, incoming AS (SELECT query_id, summ, descr FROM asked)")
    .replace("FROM dots JOIN lengths USING (query_id))", "FROM dots JOIN lengths USING (query_id) JOIN (SELECT query_id, dummy_bug_id FROM asked) USING (query_id) WHERE bug_id != dummy_bug_id)")
    .replace("WHERE hi >= 0.2 AND", "WHERE")
    + ', own AS (SELECT query_id, rate, "group" AS own FROM asked JOIN members ON bug_id = dummy_bug_id), high AS (SELECT query_id, max(score) AS high FROM sim GROUP BY query_id),'
    ' true_of AS (SELECT o.query_id, o.rate, count(*) - 1 AS n_true FROM own o JOIN members m ON m."group" = o.own GROUP BY o.query_id, o.rate HAVING count(*) > 1),'
    " judged AS (SELECT s.query_id, s.bug_id, s.rank, high, coalesce(m.\"group\" = o.own, false) AS hit FROM sim s JOIN own o USING (query_id) JOIN high USING (query_id) LEFT JOIN members m ON m.bug_id = s.bug_id),"
    ' few AS (SELECT s.query_id FROM sim s LEFT JOIN members m USING (bug_id) GROUP BY s.query_id HAVING count(DISTINCT m."group") <= 10),'
    " again AS (SELECT * FROM judged JOIN few USING (query_id) WHERE rank <= 5), grid AS (SELECT query_id, rate, n_true, unnest([0.65, 0.7, 0.75])::DOUBLE AS threshold FROM true_of)"
)


def grid_means(name: str, hits: str, join: str) -> str:
    return (
        f"{name}_means AS (SELECT threshold, rate, count(*) AS {name}_cases, round(avg(CASE WHEN coalesce(n, 0) > 0 THEN h / n ELSE 0.0 END), 6) AS {name}_precision, round(avg(coalesce(h, 0) / n_true), 6) AS {name}_recall,"
        f" round(avg(CASE WHEN coalesce(h, 0) > 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS {name}_binary_recall, round(avg(coalesce(n, 0)), 6) AS {name}_size FROM grid g"
        f" {join} (SELECT threshold, query_id, count(*) AS n, count(*) FILTER (hit) AS h FROM {hits} JOIN (SELECT DISTINCT threshold FROM grid) ON high >= threshold GROUP BY threshold, query_id) x USING (threshold, query_id) GROUP BY threshold, rate)"
    )


ORACLE_SQL["eval_grid"] = (
    f"{JUDGED}, {grid_means('similar', 'judged', 'LEFT JOIN')}, {grid_means('duplicate', 'again', 'JOIN')}"
    " SELECT s.*, coalesce(duplicate_cases, 0) AS duplicate_cases, duplicate_precision, duplicate_recall, duplicate_binary_recall, duplicate_size FROM similar_means s LEFT JOIN duplicate_means d USING (threshold, rate)"
)

# Other ways to the same rows.
ORACLE_SQL |= {
    "candidate_range_join": ORACLE_SQL["candidate_prefilter"],
    "asm_pruned_topn": ORACLE_SQL["asm_similarity_topn"],
    "dot_pruned_topn": ORACLE_SQL["dot_similarity_topn"],
    "pruned_similar_cut": ORACLE_SQL["similar_cut"],
    "groups_by_batches": f'WITH RECURSIVE {GROUPS} SELECT bug_id, "group", size, n_members FROM members JOIN sizes USING ("group")',
}
