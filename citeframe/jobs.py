"""The three jobs from the command line, for ``spark-submit`` or ``python -m citeframe.jobs``.

    convert  reference text to id lists, checked against an explicit schema
    export   papers to example shards and their manifest
    train    search, fit and test over temporal folds; one metric file per fold, curves and models
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeframe.functions.timeline import rows_per_shard
from citeframe.functions.vectors import pack
from citeframe.operators.folds import make_folds
from citeframe.operators.training import MAX_TRIALS
from citeframe.plans.crossval import cross_validate
from citeframe.plans.export import export, sharded_parts
from citeframe.sources import datasets, shards

# Column names and settings of the paper table and of its yearly evaluation.
ID_COL = "id_OpenAlex"
REFS_COL = "referenced_works_OpenAlex"
DATE_COL = "publication_date_int"
LABELS = ("higher_than_median_year",)
FEATURE_PREFIX = "embedding_"
N_FEATURES = 384
TIMEPOINTS = 50
PAD_VALUE = 0.0
SHARD_BUDGET_BYTES = 4_718_592_000
SLICES = (1900, 2024, 1)
FOLDS = dict(start_year=1900, end_year=2020, start_train=100, val_size=5, test_size=1, delta=1)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="citeframe", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = parser.add_subparsers(dest="job", required=True)
    convert, build, train = (jobs.add_parser(name) for name in ("convert", "export", "train"))

    for job in (convert, build):
        job.add_argument("papers")
        job.add_argument("--id-col", default=ID_COL)
        job.add_argument("--refs-col", default=REFS_COL)
        job.add_argument("--date-col", default=DATE_COL)
        job.add_argument("--labels", nargs="*", default=list(LABELS))
        job.add_argument("--prefix", default=FEATURE_PREFIX)
    for job in (convert, build, train):
        job.add_argument("--n-features", type=int, default=N_FEATURES)
    for job in (build, train):
        job.add_argument("--timepoints", type=int, default=TIMEPOINTS)

    convert.add_argument("output")
    convert.add_argument("--mode", choices=("strict", "permissive"), default="strict")

    build.add_argument("examples")
    build.add_argument("manifest")
    build.add_argument("--years", type=int, nargs=3, metavar=("START", "END", "DELTA"), default=list(SLICES))
    build.add_argument("--pad", type=float, default=PAD_VALUE)
    build.add_argument("--shard-bytes", type=int, default=SHARD_BUDGET_BYTES)
    build.add_argument("--overwrite", action="store_true")

    train.add_argument("examples")
    train.add_argument("metrics")
    train.add_argument("curves")
    train.add_argument("models")
    for name, value in FOLDS.items():
        train.add_argument(f"--{name.replace('_', '-')}", type=int, default=value)
    train.add_argument("--trials", type=int, default=MAX_TRIALS)
    train.add_argument("--max-iter", type=int, default=100)
    train.add_argument("--boundary", choices=("exclusive", "overlap"), default="exclusive")
    return parser


def _papers_and_vectors(df: DataFrame, args: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """The thin paper columns under their usual names, and the packed vectors of the same table."""
    names = {args.id_col: "id", args.refs_col: "refs", args.date_col: "publication_date_int"}
    papers = df.select(*[F.col(c).alias(name) for c, name in names.items()], *args.labels)
    vectors = df.select(F.col(args.id_col).alias("id"), pack(args.n_features, args.prefix).alias("embedding"))
    return papers, vectors


def run(argv: Sequence[str], spark: SparkSession) -> None:
    args = _parser().parse_args(argv)
    if args.job == "convert":
        schema = datasets.papers_schema(args.n_features, args.id_col, args.refs_col, args.date_col, args.labels, args.prefix)
        raw = datasets.open_dataset(spark, args.papers)
        converted = datasets.convert_references(raw, args.refs_col, schema, args.refs_col, args.mode)
        datasets.write_papers(converted, args.output, args.refs_col)
    elif args.job == "export":
        df = datasets.open_dataset(spark, args.papers)
        papers, vectors = _papers_and_vectors(df, args)
        datasets.assert_unique(papers)
        rows = rows_per_shard(args.shard_bytes, args.timepoints, args.n_features)
        examples = sharded_parts(
            papers, vectors, *args.years, rows, args.timepoints, args.n_features, args.labels, args.pad
        )
        export(examples, args.examples, args.manifest, rows, args.overwrite, tuple(args.years[:2]))
    else:
        folds = make_folds(**{name: getattr(args, name) for name in FOLDS})
        metrics, curves = cross_validate(
            spark, args.examples, folds, args.timepoints, args.n_features, args.trials, args.max_iter, args.boundary,
            model_path=args.models,
        )
        shards.write_metrics(metrics, args.metrics, args.test_size)
        curves.write.mode("overwrite").partitionBy("fold").parquet(args.curves)


def main() -> None:
    import sys

    run(sys.argv[1:], SparkSession.builder.appName("citeframe").getOrCreate())


if __name__ == "__main__":
    main()
