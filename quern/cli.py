"""Command line: python -m quern.cli COMMAND ...; every command is one Spark job over stored indexes."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .index import build_index, compact, load_index
from .operators import evaluate, experiments, rank, reindex
from .sources import ciff, readers, writers
from .storage import exists, staging


def _queries(spark: SparkSession, name: str) -> DataFrame:
    """A known collection's queries, else a file's."""
    return readers.collection(spark, name)[1] if name in readers.COLLECTIONS else readers.read_queries(spark, name)


def _qrels(spark: SparkSession, name: str) -> DataFrame:
    return readers.collection(spark, name)[2] if name in readers.COLLECTIONS else readers.read_qrels(spark, name)


def _fresh(spark: SparkSession, path: str) -> None:
    if exists(spark, path):
        raise FileExistsError(path)


def index(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.collection in readers.COLLECTIONS:
        corpus = readers.collection(spark, a.collection)[0]
    else:
        corpus = readers.read_corpus(spark, a.collection, a.format, a.id)
    build_index(corpus, a.mode, a.stemmer, a.stopwords, a.limit, a.min_freq, a.min_pmi).save(a.index)


def search(spark: SparkSession, a: argparse.Namespace) -> None:
    params = {"k": a.k, "b": a.b, "lambda_": a.lmbda, "conjunctive": a.conjunctive}
    run = rank.search(load_index(spark, a.index), _queries(spark, a.queries), a.matcher, a.number, a.fields, a.startq, a.endq, **params)
    if a.output:
        writers.write_run(run, a.output, a.tag or a.matcher)
        return
    for row in writers.run_lines(run, a.tag or a.matcher).orderBy("qid", "rank").toLocalIterator():
        print(row.value)


def eval_(spark: SparkSession, a: argparse.Namespace) -> None:
    run = readers.read_run(spark, a.run)
    for r in evaluate.evaluate(run, _qrels(spark, a.qrels), a.complete, a.ndcg, a.query_eval).orderBy("qid", "measure").toLocalIterator():
        print(f"{r.measure}\t{r.qid}\t{r.value:.4f}")
    cost = evaluate.cost(run).first()
    print(f"Average cost in postings: {cost.average_cost}\nTotal cost in postings: {cost.total_cost}")


def vacuum(spark: SparkSession, a: argparse.Namespace) -> None:
    compact(spark, a.index, a.cluster)


def index_import(spark: SparkSession, a: argparse.Namespace) -> None:
    _fresh(spark, a.index)
    ciff.import_ciff(spark, a.file, a.tokenizer, a.stemmer).save(a.index)


def index_export(spark: SparkSession, a: argparse.Namespace) -> None:
    ciff.export_ciff(load_index(spark, a.index), a.file, a.description)


def reindex_prior(spark: SparkSession, a: argparse.Namespace) -> None:
    _fresh(spark, a.out)
    priors = readers.read_priors(spark, a.priors) if a.priors else None
    reindex.with_priors(load_index(spark, a.index), priors, a.default, a.init).save(a.out)


def reindex_fitted(spark: SparkSession, a: argparse.Namespace) -> None:
    _fresh(spark, a.out)
    qrels = _qrels(spark, a.qrels) if a.qrels else None
    reindex.fitted(load_index(spark, a.index), a.column, a.total, a.threshold, qrels).save(a.out)


def reindex_const(spark: SparkSession, a: argparse.Namespace) -> None:
    _fresh(spark, a.out)
    reindex.constant_length(load_index(spark, a.index), a.length, a.b, a.keep_terms, a.maxp).save(a.out)


def reindex_group(spark: SparkSession, a: argparse.Namespace) -> None:
    _fresh(spark, a.out)
    reindex.grouped(load_index(spark, a.index), a.stemmer).save(a.out)


def report(spark: SparkSession, a: argparse.Namespace) -> None:
    load_index(spark, a.index).report().show(truncate=False)


def filter_queries(spark: SparkSession, a: argparse.Namespace) -> None:
    found = experiments.queries_with_ngrams(_queries(spark, a.queries), readers.read_ngrams(spark, a.ngrams), a.least)
    writers.write_table(found, a.out, "qid")


def sign_test(spark: SparkSession, a: argparse.Namespace) -> None:
    table = experiments.evaluation_table(experiments.parse_evaluations(readers.read_evaluations(spark, a.folder)))
    got = experiments.sign_tests(table, a.metric, a.lower, a.base_freq, a.base_pmi)
    writers.write_table(got, a.out, *experiments.CONFIG)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("quern")
    sub = p.add_subparsers(required=True)

    def command(name: str, run, *positional: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.set_defaults(execute=run)
        for x in positional:
            c.add_argument(x)
        return c

    c = command("index", index, "index", "collection")
    c.add_argument("--mode", choices=("standard", "words", "phrases"), default="standard")
    c.add_argument("--stemmer", choices=("none", "porter", "dutch"), default="none")
    c.add_argument("--stopwords", default="none", help="none, english, or a file of words")
    c.add_argument("--format", default="parquet")
    c.add_argument("--id", default="did")
    c.add_argument("--limit", type=int, default=-1)
    c.add_argument("--min-freq", type=int, default=10)
    c.add_argument("--min-pmi", type=float, default=5.0)
    c = command("search", search, "index", "queries")
    c.add_argument("-m", "--matcher", choices=sorted(rank.MODELS), default="lm")
    c.add_argument("-n", "--number", type=int, default=1000)
    c.add_argument("-o", "--output")
    c.add_argument("-t", "--tag")
    c.add_argument("-k", type=float, default=0.9)
    c.add_argument("-b", type=float, default=0.4)
    c.add_argument("-l", "--lmbda", type=float, default=0.3)
    c.add_argument("--fields", nargs="*")
    c.add_argument("--conjunctive", action="store_true")
    c.add_argument("--startq", type=int)
    c.add_argument("--endq", type=int)
    c = command("eval", eval_, "run", "qrels")
    c.add_argument("-c", "--complete", action="store_true")
    c.add_argument("-q", "--query-eval", action="store_true")
    c.add_argument("--ndcg", action="store_true")
    c = command("vacuum", vacuum, "index")
    c.add_argument("--cluster", action="store_true")
    c = command("index_import", index_import, "index", "file")
    c.add_argument("--tokenizer", choices=("regex", "longest"), default="regex")
    c.add_argument("--stemmer", default="none")
    c = command("index_export", index_export, "index", "file")
    c.add_argument("-d", "--description", default="")
    c = command("reindex_prior", reindex_prior, "index", "out")
    c.add_argument("--priors")
    c.add_argument("--default", type=float)
    c.add_argument("--init", choices=("len", "uniform"))
    c = command("reindex_fitted", reindex_fitted, "index", "out")
    c.add_argument("--column", choices=("len", "prior"), default="prior")
    c.add_argument("--total", type=int)
    c.add_argument("--threshold", type=float, default=0)
    c.add_argument("--qrels")
    c = command("reindex_const", reindex_const, "index", "out")
    c.add_argument("--length", type=int, default=400)
    c.add_argument("-b", type=float, default=1.0)
    c.add_argument("--keep-terms", action="store_true")
    c.add_argument("--maxp", type=float, default=1.0)
    c = command("reindex_group", reindex_group, "index", "out")
    c.add_argument("--stemmer", default="porter")
    command("report", report, "index")
    c = command("filter_queries", filter_queries, "queries", "ngrams", "out")
    c.add_argument("--least", type=int, default=2)
    c = command("sign_test", sign_test, "folder", "out")
    c.add_argument("--metric", default="map")
    c.add_argument("--lower", action="store_true", help="smaller values are better, as for costs")
    c.add_argument("--base-freq", default="1")
    c.add_argument("--base-pmi", default="24")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quern").getOrCreate()
    with staging(spark):  # every command writes or prints its result
        a.execute(spark, a)


if __name__ == "__main__":
    main()
