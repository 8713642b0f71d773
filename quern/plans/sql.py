"""The same rows as the registered queries, in SQL over the raw tables, written from the formulas.

Each statement is a chain of named subqueries; ``chain`` puts a query's own after those that it needs.
"""

from __future__ import annotations

from ..operators.evaluate import P_CUTS, RECALLS, iprec
from .catalogue import STOP, VOCABULARY_FREQ

STOP_SQL = ", ".join(f"'{w}'" for w in STOP)
FOLDED = "lower(strip_accents({}))"
WORDS = "string_split_regex(regexp_replace(" + FOLDED + ", '[0-9[:punct:]]+', ' ', 'g'), '[ \\t\\n\\f\\r]+')"

PARTS = {
    "d": "SELECT row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) AS docid, CAST(doc_id AS VARCHAR) AS name, coalesce(text, '') AS content FROM documents",
    "w": f"SELECT docid, name, {WORDS.format('content')} AS w FROM d",
    "tok": "SELECT docid, unnest(w) AS token, generate_subscripts(w, 1) AS place FROM w",
    "pc": "SELECT docid, token AS term, count(*) AS tf FROM tok WHERE token <> '' GROUP BY ALL",
    "dict": "SELECT row_number() OVER (ORDER BY term) AS termid, term, df FROM (SELECT term, count(*) AS df FROM pc GROUP BY term)",
    "post": "SELECT termid, docid, tf FROM pc JOIN dict USING (term)",
    "docs": "SELECT docid, name, CAST(coalesce(n, 0) AS BIGINT) AS len FROM d LEFT JOIN (SELECT docid, sum(tf) AS n FROM pc GROUP BY docid) USING (docid)",
    "stats": "SELECT (SELECT count(*) FROM docs) AS num_docs, (SELECT avg(len) FROM docs) AS avgdl, (SELECT CAST(sum(df) AS BIGINT) FROM dict) AS sumdf",
    "q": "SELECT item_id AS qid, text FROM benchmark",
    "qt": f"SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({WORDS.format('text')}) AS term FROM q) GROUP BY ALL",
    "qd": "SELECT qid, term, qtf, termid, df FROM qt JOIN dict USING (term)",
    "m": "SELECT qid, termid, docid, df, qtf, tf FROM qd JOIN post USING (termid)",
    "cost": "SELECT qid, count(*) AS postings_cost FROM m GROUP BY qid",
    "rel": "SELECT item_id AS qid, doc_id, CAST(1 + doc_id % 3 AS INTEGER) AS rel FROM documents d, benchmark b WHERE contains(d.text, b.text)",
}
BASE = ("d", "w", "tok", "pc", "dict", "post", "docs", "stats")
EVERY = "HAVING count(DISTINCT termid) = (SELECT count(*) FROM qt WHERE qt.qid = m.qid AND term <> '')"  # of the query's tokens, its full stop aside


def chain(final: str, *names: str, recursive: bool = False, **own: str) -> str:
    """A statement whose subqueries are PARTS by name, replaced or followed by ``own``."""
    own = dict(own)
    steps = [(n, own.pop(n, PARTS.get(n))) for n in names] + list(own.items())
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f"{n} AS ({s})" for n, s in steps) + f"\n{final}"


def ranking(part: str, whole: str, docs: str = "docs", having: str = "") -> dict[str, str]:
    """Subqueries ``sc`` (scores) and ``run`` (the best 100) of a scoring formula over m, docs and stats."""
    return {
        "sc": f"SELECT qid, docid, name, sum({part}) + max({whole}) AS score FROM m JOIN {docs} USING (docid), stats GROUP BY qid, docid, name {having}",
        "run": "SELECT qid, name AS docno, rank, round(score, 6) AS score, postings_cost FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, docid) - 1 AS rank FROM sc) JOIN cost USING (qid) WHERE rank < 100",
    }


RUN = "SELECT qid, docno, rank, score, postings_cost FROM run"
SEARCH = (*BASE, "q", "qt", "qd", "m", "cost")


def lm(length: str = "len", whole: str | None = None, tf: str = "tf", **kw) -> dict[str, str]:
    part = f"{'qtf * ' if tf == 'qtf' else ''}ln(1 + 0.3::DOUBLE * tf * sumdf / ((1 - 0.3::DOUBLE) * df * {length}))"
    return ranking(part, whole or f"ln({length})", **kw)


def bm25(length: str | None = "len", shift: int = 1, **kw) -> dict[str, str]:
    norm = f"(1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * {length} / avgdl))" if length else "1.2::DOUBLE"
    return ranking(f"log10((num_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + {shift}) * tf * 2.2::DOUBLE / (tf + {norm})", "0", **kw)


def search(own: dict[str, str], **replaced: str) -> str:
    return chain(RUN, *SEARCH, **(replaced | own))


# constant length: 400, b 0.75, at most 20 occurrences
def constant(keep: bool) -> str:
    value = "CASE WHEN n > 0.5 THEN n - 0.5 ELSE 0.1 END" if keep else "n - 0.5"
    return f"SELECT termid, docid, least(CAST(ceil({value}) AS BIGINT), 20) AS tf FROM (SELECT termid, docid, tf / (0.25::DOUBLE + 0.75::DOUBLE * len / 400.0::DOUBLE) AS n FROM post0 JOIN docs USING (docid)) WHERE ceil({value}) > 0"


def with_const(own: dict[str, str]) -> str:
    names = ("d", "w", "tok", "pc", "dict")
    steps = {"post0": PARTS["post"], "docs": PARTS["docs"], "stats": PARTS["stats"], "post": constant(False)}
    return chain(RUN, *names, **steps, **{n: PARTS[n] for n in ("q", "qt", "qd", "m", "cost")}, **own)


# ids by falling length; a line through ln(value) over ln(rank)
RENUMBERED = "SELECT row_number() OVER (ORDER BY len DESC, name) AS docid, docid AS old, name, len FROM docs0"
BY_VALUES = "SELECT ln(sum(n) OVER (ORDER BY v DESC ROWS UNBOUNDED PRECEDING)) AS x, ln(v) AS y FROM (SELECT len AS v, count(*) AS n FROM docs WHERE len > {} GROUP BY len)"
BINS = "SELECT CASE WHEN nr = 2 THEN 0 ELSE nr * s END AS lo, (CASE WHEN nr = 2 THEN 0 ELSE nr * s END + (nr + 1) * s) / 2 AS mid, (nr + 1) * s AS hi FROM (SELECT unnest(range(2, 22)) AS nr, ln((SELECT count(*) FROM docs) + 1.0::DOUBLE) / 22.0::DOUBLE AS s)"
BY_BINS = "SELECT mid AS x, ln(avg(len)) AS y FROM docs JOIN bins ON ln(docid + 1.0::DOUBLE) >= lo AND ln(docid + 1.0::DOUBLE) < hi WHERE len > 0 GROUP BY mid"
BY_QRELS = "SELECT mid AS x, ln(count(*) / (exp(hi) - exp(lo))) AS y FROM docs JOIN rel ON name = CAST(doc_id AS VARCHAR) JOIN bins ON ln(docid + 1.0::DOUBLE) >= lo AND ln(docid + 1.0::DOUBLE) < hi GROUP BY lo, mid, hi"
LINE = "SELECT least(regr_slope(y, x), 0) AS slope, regr_intercept(y, x) AS intercept FROM sample"


def with_fit(final: str, sample: str, own: dict[str, str] | None = None, searching: bool = True) -> str:
    steps = {"docs0": PARTS["docs"], "post0": PARTS["post"], "docs": RENUMBERED, "post": "SELECT termid, docs.docid, tf FROM post0 JOIN docs ON post0.docid = docs.old"}
    steps |= {"bins": BINS, "rel": PARTS["rel"], "sample": sample, "fit": LINE}
    steps |= {"stats": "SELECT (SELECT count(*) FROM docs) AS num_docs, (SELECT avg(len) FROM docs) AS avgdl, (SELECT CAST(sum(df) AS BIGINT) FROM dict) AS sumdf, slope, intercept FROM fit"}
    if searching:
        steps |= {n: PARTS[n] for n in ("q", "qt", "qd", "m", "cost")}
    return chain(final, "d", "w", "tok", "pc", "dict", **steps, **(own or {}))


FITTED = "exp(ln(docid) * slope + intercept)"

# evaluation: the run of the language model against passages' documents and the pool of its first 20
JUDGED = {
    "qrels": "SELECT qid, CAST(doc_id AS VARCHAR) AS docno, rel FROM rel UNION ALL SELECT qid, docno, 0 FROM run WHERE rank < 20 AND NOT EXISTS (FROM rel WHERE rel.qid = run.qid AND CAST(doc_id AS VARCHAR) = docno)",
    "tot": "SELECT qid, count(*) FILTER (rel > 0) AS num_rel, count(*) FILTER (rel = 0) AS bad FROM qrels GROUP BY qid",
}


def ranks(run: str) -> dict[str, str]:
    return {
        f"o{run}": f"SELECT qid, docno, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno DESC) AS rank FROM {run}",
        f"j{run}": f"SELECT o.qid, rank, coalesce(rel, -1) AS rel, CAST(coalesce(rel, 0) > 0 AS INTEGER) AS hit, num_rel, bad FROM o{run} o JOIN tot USING (qid) LEFT JOIN qrels USING (qid, docno)",
        f"e{run}": f"SELECT *, sum(hit) OVER w AS hits, count(*) FILTER (rel = 0) OVER w AS bads FROM j{run} WINDOW w AS (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING)",
    }


def judged(final: str) -> str:
    return chain(final, *SEARCH, "rel", **(lm() | JUDGED | ranks("run")))


def zero(expr: str, name: str, over: str = "greatest(max(num_rel), 1)") -> str:
    return f"round(CAST(coalesce({expr}, 0) AS DOUBLE){f' / {over}' if over else ''}, 6) AS {name}"


def per_query(*columns: str) -> str:
    return judged(f"SELECT qid, {', '.join(columns)} FROM erun GROUP BY qid")


AP = "sum(hit * hits / rank)"
BOTH = "CAST(n AS DOUBLE) AS n"
TAIL = "SELECT *, better + worse AS n, least(better, worse) AS k FROM s"
SIGN = (
    "SELECT n_pairs, better, worse, equal, CASE WHEN n = 0 THEN NULL ELSE round(least(1.0::DOUBLE, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0::DOUBLE))) FROM range(0, k + 1) r(i))), 6) END AS p_value FROM t"
)
COUNTS = "SELECT count(*) AS n_pairs, count(*) FILTER ({}) AS better, count(*) FILTER ({}) AS worse, count(*) FILTER (x = y) AS equal FROM p"


def other_run(ranked: dict[str, str], name: str) -> dict[str, str]:
    """A second ranking as ``sc_name`` and ``run_name``."""
    return {f"sc_{name}": ranked["sc"], f"run_{name}": ranked["run"].replace("FROM sc)", f"FROM sc_{name})")}


def two_runs() -> dict[str, str]:
    return lm() | other_run(bm25(), "b") | JUDGED | ranks("run") | ranks("run_b")


FREQ = "SELECT token, count(*) AS freq, count(DISTINCT docid) AS doc_freq FROM tok GROUP BY token"
PAIRS = "SELECT w1, w2, count(*) AS freq, count(DISTINCT docid) AS doc_freq FROM (SELECT docid, token AS w1, lead(token) OVER (PARTITION BY docid ORDER BY place) AS w2 FROM tok) WHERE w2 IS NOT NULL GROUP BY w1, w2 HAVING count(*) >= 10"
PMI = "SELECT w1 || ' ' || w2 AS phrase, ln(p.freq * (SELECT CAST(count(*) AS DOUBLE) FROM tok) / (CAST(a.freq AS DOUBLE) * b.freq)) / ln(2.0::DOUBLE) AS pmi, p.doc_freq AS df, w1, w2 FROM p JOIN f a ON a.token = w1 JOIN f b ON b.token = w2"
NGRAMS = "SELECT docid, array_to_string(w[i : i + {n} - 1], ' ') AS ngram FROM (SELECT docid, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM w WHERE len(w) >= {n})"
TOKENS = ("d", "w", "tok")
NOSTOP = {"pc": PARTS["pc"].replace("token <> ''", f"token <> '' AND token NOT IN ({STOP_SQL})")}

# longest matches: one alternation of all terms, longer ones first, so that the leftmost match is the longest
LONGEST = "regexp_extract_all({}, (SELECT string_agg(regexp_escape(term), '|' ORDER BY length(term) DESC, term) FROM {}))"
CLEAN = "regexp_replace(" + FOLDED.format("content") + ", '[0-9[:punct:]]+', ' ', 'g')"
MATCHED = "SELECT docid, term, count(*) AS tf FROM (SELECT docid, unnest(" + LONGEST.format(CLEAN, "v") + ") AS term FROM d) GROUP BY docid, term"
FREQUENT = f"SELECT token AS term FROM ({FREQ}) WHERE freq >= {VOCABULARY_FREQ} AND token <> ''"
PHRASES = f"SELECT phrase AS term FROM x WHERE pmi >= 4 AND w1 NOT IN ({STOP_SQL}) AND w2 NOT IN ({STOP_SQL}) UNION SELECT token FROM f WHERE freq >= 20 AND token <> '' AND token NOT IN ({STOP_SQL})"
PHRASE_INDEX = {"f": FREQ, "p": PAIRS.replace(">= 10", ">= 20"), "x": PMI, "v": PHRASES, "pc": MATCHED} | {n: PARTS[n] for n in ("dict", "post", "docs", "stats")}
REPORT = "SELECT (SELECT count(*) FROM dict) AS dict_terms, (SELECT count(*) FROM dict WHERE contains(term, ' ')) AS ngrams, (SELECT CAST(sum(tf) AS BIGINT) FROM post) AS term_rows, num_docs, round(avgdl, 6) AS avgdl, sumdf FROM stats"
LONGEST_QUERY = "SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(" + LONGEST.format(FOLDED.format("text"), "dict") + ") AS term FROM q) GROUP BY ALL"

SQL = {
    "tok_regex_counts": chain("SELECT docid, name, len(w) AS n_tokens, len(list_filter(w, lambda x: x = '')) AS n_empty FROM w", "d", "w"),
    "token_freq": chain(FREQ, *TOKENS),
    "index_docs_len": chain("SELECT docid, name, len FROM docs", *TOKENS, "pc", "docs"),
    "index_dict_df": chain("SELECT termid, term, df FROM dict", *TOKENS, "pc", "dict"),
    "index_dict_stopwords": chain("SELECT termid, term, df FROM dict", *TOKENS, "pc", "dict", **NOSTOP),
    "index_dict_limit": chain("SELECT * FROM (SELECT row_number() OVER (ORDER BY df DESC, term) AS termid, term, df FROM dict) WHERE termid <= 500", *TOKENS, "pc", "dict"),
    "index_postings": chain("SELECT termid, docid, CAST(0 AS BIGINT) AS fieldid, tf FROM post", *TOKENS, "pc", "dict", "post"),
    "index_stats": chain("SELECT num_docs, round(avgdl, 6) AS avgdl, sumdf, 'standard' AS index_type, 'none' AS stemmer FROM stats", *BASE),
    "index_report": chain(REPORT, *BASE),
    "terms_positions": chain("SELECT docid, row_number() OVER (PARTITION BY docid ORDER BY place) AS pos, termid FROM tok JOIN dict ON token = term", *TOKENS, "pc", "dict"),
    "ngram_generic_freq": chain("SELECT ngram, count(*) AS freq, count(DISTINCT docid) AS doc_freq FROM g GROUP BY ngram HAVING count(*) >= 5", "d", "w", g=NGRAMS.format(n=3)),
    "bigram_freq": chain(PAIRS, *TOKENS),
    "pmi_phrases": chain("SELECT phrase, round(pmi, 6) AS pmi, df FROM x WHERE pmi >= 3", *TOKENS, f=FREQ, p=PAIRS, x=PMI),
    "phrase_vocab": chain(
        f"SELECT phrase AS term, df FROM x WHERE pmi >= 5 AND w1 NOT IN ({STOP_SQL}) AND w2 NOT IN ({STOP_SQL}) UNION ALL SELECT token, doc_freq FROM f WHERE freq >= 10 AND token <> '' AND token NOT IN ({STOP_SQL})",
        *TOKENS, f=FREQ, p=PAIRS, x=PMI,
    ),
    "longest_match_query": chain(
        "SELECT qid, count(token) AS n_tokens, coalesce(string_agg(token, '|' ORDER BY place), '') AS tokens FROM walk GROUP BY qid",
        *TOKENS,
        recursive=True,
        v=FREQUENT,
        t=f"SELECT item_id AS qid, {FOLDED.format('text')} AS s FROM benchmark",
        c="SELECT qid, i, substr(s, i, n) AS term, n FROM (SELECT qid, s, unnest(range(1, length(s) + 1)) AS i FROM t), (SELECT DISTINCT length(term) AS n FROM v)",
        best="SELECT qid, i, max(n) AS n, arg_max(term, n) AS token FROM c SEMI JOIN v USING (term) GROUP BY qid, i",
        hop="SELECT qid, i, coalesce(n, 1) AS n, token FROM (SELECT qid, unnest(range(1, length(s) + 1)) AS i FROM t) LEFT JOIN best USING (qid, i)",
        walk="SELECT qid, CAST(0 AS BIGINT) AS place, CAST(1 AS BIGINT) AS next, CAST(NULL AS VARCHAR) AS token FROM t UNION ALL SELECT w.qid, h.i, h.i + h.n, h.token FROM walk w JOIN hop h ON h.qid = w.qid AND h.i = w.next",
    ),
    "longest_match_docs": chain("SELECT docid, term, tf FROM m", *TOKENS, v=FREQUENT, m=MATCHED),
    "phrase_index_report": chain(REPORT, *TOKENS, **PHRASE_INDEX),
    "search_phrases_lm": chain(RUN, *TOKENS, **PHRASE_INDEX, **{n: PARTS[n] for n in ("q", "qt", "qd", "m", "cost")} | {"qt": LONGEST_QUERY}, **lm()),
    "query_terms_stats": chain("SELECT qid, term, qtf, termid, df FROM qd", *TOKENS, "pc", "dict", "q", "qt", "qd"),
    "search_lm": search(lm()),
    "search_lm_stopwords": search(lm(), **NOSTOP),
    "search_lm_fields": search(lm()),
    "search_lm_conjunctive": search(lm(having=EVERY)),
    "search_lm_postings_cost": chain("SELECT qid, postings_cost FROM cost", *SEARCH),
    "search_bm25": search(bm25()),
    "search_bm25_const": with_const(bm25(None)),
    "search_lm_const": with_const(lm("400.0::DOUBLE", "0")),
    "search_lm_prior_len": search(lm(whole="ln(len)")),
    "search_lm_prior_uniform": search(lm(whole="0")),
    "search_lm_prior_file": search(
        {"pd": "SELECT docid, name, len, coalesce(quality + 1, 0.5::DOUBLE) AS prior FROM docs LEFT JOIN labels ON name = CAST(doc_id AS VARCHAR)"} | lm(whole="ln(prior)", docs="pd")
    ),
    "search_lm_fitted_len": with_fit(RUN, BY_VALUES.format(0), lm(FITTED)),
    "search_bm25_fitted": with_fit(RUN, BY_VALUES.format(0), bm25(FITTED, 0)),
    "search_lm_fitted_prior": with_fit(RUN, BY_BINS, lm(whole="ln(docid) * slope", tf="qtf")),
    "renumber_by_len": with_fit("SELECT docid, name, len FROM docs", BY_VALUES.format(0), searching=False),
    "sample_by_values": chain(f"SELECT round(x, 6) AS x, round(y, 6) AS y FROM ({BY_VALUES.format(10)})", *TOKENS, "pc", "docs"),
    "sample_fixed_points": with_fit("SELECT round(x, 6) AS x, round(y, 6) AS y FROM sample", BY_BINS, searching=False),
    "sample_fixed_points_qrels": with_fit("SELECT round(x, 6) AS x, round(y, 6) AS y FROM sample", BY_QRELS, searching=False),
    "fit_regression": chain("SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM fit", *TOKENS, "pc", "docs", sample=BY_VALUES.format(0), fit=LINE),
    "reindex_const_postings": chain("SELECT * FROM x", *TOKENS, "pc", "dict", post0=PARTS["post"], docs=PARTS["docs"], x=constant(False)),
    "reindex_const_keep_terms": chain("SELECT * FROM x", *TOKENS, "pc", "dict", post0=PARTS["post"], docs=PARTS["docs"], x=constant(True)),
    "reindex_group_prefix": chain(
        "SELECT dense_rank() OVER (ORDER BY s) AS termid, term, df FROM (SELECT term, left(term, 5) AS s FROM dict) JOIN (SELECT left(term, 5) AS s, count(DISTINCT docid) AS df FROM pc GROUP BY 1) USING (s)",
        *TOKENS, "pc", "dict",
    ),
    "ciff_header": chain(
        "SELECT 1 AS version, n AS num_postings_lists, num_docs, n AS total_postings_lists, num_docs AS total_docs, (SELECT CAST(sum(len) AS BIGINT) FROM docs) AS total_terms_in_collection, round(avgdl, 6) AS average_doclength, 'words' AS description FROM stats, (SELECT count(*) AS n FROM dict)",
        *BASE,
    ),
    "ciff_postings_gaps": chain("SELECT term, docid, docid - lag(docid, 1, 0) OVER (PARTITION BY term ORDER BY docid) AS gap, tf FROM pc", *TOKENS, "pc"),
    "ciff_roundtrip": chain("SELECT term, count(*) AS df, count(*) AS n_docs, CAST(sum(tf) AS BIGINT) AS cf, min(name) AS first_name, max(name) AS last_name FROM pc JOIN d USING (docid) GROUP BY term", *TOKENS, "pc"),
    "known_item_qrels": chain("SELECT qid, CAST(doc_id AS VARCHAR) AS docno, rel FROM rel", "rel"),
    "eval_map": per_query(zero("max(num_rel)", "num_rel", ""), zero("count(*)", "num_ret", ""), zero("sum(hit)", "num_rel_ret", ""), zero(AP, "map")),
    "eval_p_at_k": per_query(*(zero(f"sum(hit) FILTER (rank <= {k})", f"P_{k}", str(k)) for k in P_CUTS)),
    "eval_recip_rank": per_query(zero("1.0::DOUBLE / min(rank) FILTER (hit = 1)", "recip_rank", "")),
    "eval_rprec": per_query(zero("sum(hit) FILTER (rank <= num_rel)", "Rprec")),
    "eval_bpref": per_query(zero("sum(CASE WHEN bads = 0 THEN 1 ELSE 1 - least(bads, num_rel) / least(num_rel, bad) END) FILTER (hit = 1)", "bpref")),
    "eval_iprec": per_query(*(zero(f"max(hits / rank) FILTER (hits >= floor({r}::DOUBLE * num_rel + 0.9::DOUBLE))", iprec(r), "") for r in RECALLS)),
    "eval_ndcg": judged(
        "SELECT qid, "
        + ", ".join(f"round(coalesce(sum(greatest(rel, 0) / log2(rank + 1)) FILTER (rank <= {k}) / any_value(i{k}), 0), 6) AS ndcg_cut_{k}" for k in P_CUTS)
        + " FROM erun LEFT JOIN (SELECT qid, "
        + ", ".join(f"sum(rel / log2(r + 1)) FILTER (r <= {k}) AS i{k}" for k in P_CUTS)
        + " FROM (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC) AS r FROM qrels WHERE rel > 0) GROUP BY qid) USING (qid) GROUP BY qid"
    ),
    "eval_complete": chain(
        "SELECT measure, round(value, 6) AS value FROM (UNPIVOT (SELECT CAST(count(*) AS DOUBLE) AS num_q, CAST(sum(num_rel) AS DOUBLE) AS num_rel, CAST(coalesce(sum(n), 0) AS DOUBLE) AS num_ret, CAST(coalesce(sum(h), 0) AS DOUBLE) AS num_rel_ret, "
        "avg(coalesce(ap, 0)) AS map, avg(coalesce(rr, 0)) AS recip_rank, avg(coalesce(p, 0)) AS P_10 FROM tot LEFT JOIN (SELECT qid, count(*) AS n, sum(hit) AS h, "
        f"{AP} / greatest(max(num_rel), 1) AS ap, 1.0::DOUBLE / min(rank) FILTER (hit = 1) AS rr, sum(hit) FILTER (rank <= 10) / 10 AS p FROM erun_c GROUP BY qid) USING (qid)) ON COLUMNS(*) INTO NAME measure VALUE value)",
        *SEARCH, "rel", **(lm() | other_run(lm(having=EVERY), "c") | JUDGED | ranks("run_c")),
    ),
    "eval_cost_avg": chain("SELECT round(avg(postings_cost), 6) AS average_cost, CAST(sum(postings_cost) AS BIGINT) AS total_cost FROM (SELECT DISTINCT qid, postings_cost FROM run)", *SEARCH, **lm()),
    "sign_test_map": chain(
        SIGN, *SEARCH, "rel", **two_runs(),
        p=f"SELECT x, y FROM (SELECT qid, round({AP} / greatest(max(num_rel), 1), 6) AS x FROM erun GROUP BY qid) JOIN (SELECT qid, round({AP} / greatest(max(num_rel), 1), 6) AS y FROM erun_b GROUP BY qid) USING (qid)",
        s=COUNTS.format("x > y", "x < y"), t=TAIL,
    ),
    "sign_test_cip": chain(
        SIGN, *SEARCH,
        p=f"SELECT coalesce(a.c, 0) AS x, b.c AS y FROM (SELECT qid, count(*) AS c FROM m JOIN dict USING (termid) WHERE term NOT IN ({STOP_SQL}) GROUP BY qid) a JOIN (SELECT qid, postings_cost AS c FROM cost) b USING (qid)",
        s=COUNTS.format("x < y", "x > y"), t=TAIL,
    ),
    "queries_with_2_ngrams": chain(
        "SELECT item_id AS qid, count(*) AS n_ngrams FROM benchmark JOIN g ON contains(lower(text), ngram) GROUP BY item_id HAVING count(*) >= 2",
        "d", "w", g=f"SELECT ngram FROM ({NGRAMS.format(n=2)}) GROUP BY ngram HAVING count(*) >= 40 AND ngram NOT LIKE ' %' AND ngram NOT LIKE '% '",
    ),
    "cluster_terms_layout": chain("SELECT termid, docid, tf FROM post", *TOKENS, "pc", "dict", "post"),
}
