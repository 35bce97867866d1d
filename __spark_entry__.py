
from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeframe.functions import references, timeline
from citeframe.functions import vectors as vec
from citeframe.operators import batches, citations, folds, history, metrics, sequences, slicing, training
from citeframe.plans import append, crossval, views
from citeframe.plans.export import export, sharded_examples, sharded_parts
from citeframe.plans.views import BATCH_SIZE, END_YEAR, N_FEATURES, ROWS_PER_SHARD, START_YEAR, TIMEPOINTS, Y_COLS
from citeframe.sources import datasets, published, scratch, shards
from citeframe.streaming import examples as lazy
from oracle import ORACLE_SQL

try:
    import corpus_pipeline
    from citeframe.llm import queries as llm
except ImportError:  # these parts can be taken out, and what they need; all that the core needs is imported above
    llm = corpus_pipeline = None

FOLDS = folds.make_folds(**views.FOLD_SETTINGS)
FIRST = FOLDS[0]
SHARD_BYTES = 15_000_000
# Time points and features of the examples that the model queries fit, and where the fits stop.
PRICE_SHAPE = (0, 1)
FIT_TOLERANCE = 1e-10


def _examples(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    papers, vectors = views.labelled_papers(spark, sf_dir), views.vectors(spark, sf_dir)
    return sequences.build_examples(papers, vectors, TIMEPOINTS, N_FEATURES, Y_COLS, **options)


def _sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    period = timeline.year_start_ns(START_YEAR), timeline.year_start_ns(END_YEAR)
    return slicing.time_slices(views.papers(spark, sf_dir, period), START_YEAR, END_YEAR)


def _sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.assign_shards(_sliced(spark, sf_dir), ROWS_PER_SHARD)


def _export(
    spark: SparkSession, sf_dir: str, start: int = START_YEAR, end: int = END_YEAR, paths: tuple[str, str] | None = None
) -> tuple[str, str]:
    """Writes the example shards and the manifest of some years, to unused paths of the shared folder
    or on top of an earlier export."""
    examples = sharded_parts(
        views.labelled_papers(spark, sf_dir), views.vectors(spark, sf_dir), start, end, 1, ROWS_PER_SHARD,
        TIMEPOINTS, N_FEATURES, Y_COLS, filter_vectors=(start, end) != (START_YEAR, END_YEAR),
    )
    out = paths or (scratch.new_path(spark, "examples"), scratch.new_path(spark, "manifest"))
    export(examples, *out, ROWS_PER_SHARD, overwrite=paths is None, years=(start, end))
    return out


def _with_text(examples: DataFrame, *cols: str) -> DataFrame:
    targets = [F.col("target")[i].cast("double").alias(f"target_{c}") for i, c in enumerate(Y_COLS)]
    return examples.select(*cols, views.vector_text(F.col("features")).alias("features"), *targets)


# Scans and conversion


def scan_projection(spark, sf_dir):
    return datasets.scan_all(views.table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderdate"])


def scan_range(spark, sf_dir):
    low, high = dt.datetime(1996, 1, 1), dt.datetime(1998, 7, 1)
    return datasets.scan_range(views.table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey"], low, high, "o_orderdate")


def scan_isin(spark, sf_dir):
    papers, keys = views.papers(spark, sf_dir), views.keys(spark, sf_dir)
    return datasets.scan_in(papers, ["id", "publication_date_int"], keys, "id")


def repeated_ids(spark, sf_dir):
    return datasets.repeated_ids(views.table(spark, sf_dir, "lineitem"), "l_orderkey")


def parse_references(spark, sf_dir):
    parsed = views.raw_papers(spark, sf_dir).select(
        "id", references.parse_reference_list(F.col("refs_text")).alias("refs")
    )
    return parsed.select("id", F.size("refs").alias("n_refs"), F.posexplode_outer("refs").alias("pos", "ref_id"))


def convert_schema(spark, sf_dir):
    wide = views.raw_papers(spark, sf_dir).join(views.vectors(spark, sf_dir), "id")
    wide = wide.select("id", "publication_date_int", "refs_text", *vec.unpack("embedding", N_FEATURES))
    converted = datasets.convert_references(wide, "refs_text", datasets.papers_schema(N_FEATURES))
    return converted.select(
        "id", "publication_date_int", F.array_join(F.col("refs").cast("array<string>"), ",").alias("refs"),
        views.vector_text(vec.pack(N_FEATURES)).alias("embedding"),
    )


def _written(spark: SparkSession, sf_dir: str, y_cols: tuple[str, ...]) -> DataFrame:
    """Converts papers with their vectors and labels to one of the two schemas, writes them and reads them back."""
    wide = views.raw_papers(spark, sf_dir).join(views.vectors(spark, sf_dir), "id")
    wide = wide.join(views.labelled_papers(spark, sf_dir).select("id", *Y_COLS), "id")
    wide = wide.select("id", "publication_date_int", "refs_text", *Y_COLS, *vec.unpack("embedding", N_FEATURES))
    path = scratch.new_path(spark, "papers")
    schema = datasets.papers_schema(N_FEATURES, y_cols=y_cols)
    datasets.write_papers(datasets.convert_references(wide, "refs_text", schema), path)
    return datasets.open_dataset(spark, path).select(
        "id", "publication_date_int", F.array_join(F.col("refs").cast("array<string>"), ",").alias("refs"),
        views.vector_text(vec.pack(N_FEATURES)).alias("embedding"), *y_cols,
    )


def written_papers(spark, sf_dir):
    return _written(spark, sf_dir, ())


def written_labelled_papers(spark, sf_dir):
    return _written(spark, sf_dir, Y_COLS)


def date_conversions(spark, sf_dir):
    ns = F.col("publication_date_int")
    return views.papers(spark, sf_dir).select(
        "id", "publication_date_int", timeline.from_epoch_ns(ns).alias("publication_date"),
        timeline.year_to_ns(timeline.year_of_ns(ns)).alias("year_ns"),
    )


# The citation graph


def explode_references(spark, sf_dir):
    return citations.explode_references(views.papers(spark, sf_dir))


def available_references(spark, sf_dir):
    papers = views.papers(spark, sf_dir)
    return citations.available_references(citations.explode_references(papers), papers)


def reference_dates(spark, sf_dir):
    papers = views.papers(spark, sf_dir)
    return citations.reference_dates(citations.explode_references(papers), papers)


def rank_references(spark, sf_dir):
    return citations.rank_references(reference_dates(spark, sf_dir), TIMEPOINTS)


def reference_features(spark, sf_dir):
    ranked = rank_references(spark, sf_dir)
    placed = citations.reference_features(ranked, views.vectors(spark, sf_dir))
    return placed.select("id", "ref_rank", "ref_id", views.vector_text(F.col("embedding")).alias("embedding"))


# Examples


def example_features(spark, sf_dir):
    steps = vec.unflatten(F.col("features"), TIMEPOINTS, N_FEATURES)
    rows = _examples(spark, sf_dir).select("id", F.posexplode(steps).alias("step", "v"))
    return rows.select("id", "step", views.vector_text(F.col("v")).alias("features"))


def examples_between(spark, sf_dir):
    rows = lazy.examples_between(
        views.labelled_papers(spark, sf_dir), views.vectors(spark, sf_dir), timeline.year_start_ns(1997),
        timeline.year_start_ns(1999), TIMEPOINTS, N_FEATURES, y_cols=Y_COLS,
    )
    return _with_text(rows, "id", "publication_date_int")


def wide_layout_totals(spark, sf_dir):
    wide = _examples(spark, sf_dir).select(*vec.wide_step_columns(F.col("features"), TIMEPOINTS, N_FEATURES))
    return wide.agg(*[F.sum(F.floor(F.col(c).cast("double") * 1000000)).alias(c) for c in wide.columns])


def example_width_check(spark, sf_dir):
    checked = vec.checked_width(F.col("features"), TIMEPOINTS, N_FEATURES)
    rows = _examples(spark, sf_dir).select(checked.alias("features")).select(
        F.size("features").alias("width"),
        F.size(vec.unflatten(F.col("features"), TIMEPOINTS, N_FEATURES)).alias("n_steps"),
    )
    return rows.groupBy("width", "n_steps").agg(F.count("*").alias("n_examples"))


def example_targets(spark, sf_dir):
    kept, filled = vec.target_vector(Y_COLS), vec.target_vector(Y_COLS, fill=0.0)
    return views.labelled_papers(spark, sf_dir).select(
        "id", *[kept[i].cast("double").alias(c) for i, c in enumerate(Y_COLS)],
        *[filled[i].cast("double").alias(f"{c}_filled") for i, c in enumerate(Y_COLS)],
    )


def _kept_totals(spark: SparkSession, sf_dir: str, on_disk: bool) -> DataFrame:
    kept = lazy.keep(_examples(spark, sf_dir), on_disk)
    millionths = F.transform("features", lambda x: F.floor(x.cast("double") * 1000000))
    total = F.aggregate(millionths, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return kept.agg(F.count("*").alias("n_examples"), F.sum(total).alias("checksum"))


def persisted_examples(spark, sf_dir):
    return _kept_totals(spark, sf_dir, on_disk=False)


def disk_examples(spark, sf_dir):
    return _kept_totals(spark, sf_dir, on_disk=True)


# Slices, shards and manifest


def time_slices(spark, sf_dir):
    return _sliced(spark, sf_dir).select("id", "slice_start", "slice_end")


def wide_time_slices(spark, sf_dir):
    papers = views.papers(spark, sf_dir)
    return slicing.time_slices(papers, 1996, 2001, 2).select("id", "slice_start", "slice_end")


def shard_plan(spark, sf_dir):
    return _sharded(spark, sf_dir).select("id", "slice_start", "shard")


def shard_manifest(spark, sf_dir):
    return slicing.shard_counts(_sharded(spark, sf_dir))


def budget_manifest(spark, sf_dir):
    rows = timeline.rows_per_shard(SHARD_BYTES, TIMEPOINTS, N_FEATURES)
    return slicing.shard_counts(slicing.assign_shards(_sliced(spark, sf_dir), rows))


def shard_names(spark, sf_dir):
    name = timeline.shard_name(F.col("slice_start"), F.col("slice_end"), F.col("shard"))
    named = shard_manifest(spark, sf_dir).select(name.alias("name"))
    t_min, t_max = timeline.interval_from_name(F.col("name"))
    return named.select("name", t_min.alias("t_min"), t_max.alias("t_max"))


def select_shards_overlap(spark, sf_dir):
    return slicing.select_shards(shard_manifest(spark, sf_dir), *FIRST.window("val"))


def train_example_count(spark, sf_dir):
    return slicing.example_count(shard_manifest(spark, sf_dir), *FIRST.window("train"), BATCH_SIZE)


def export_roundtrip(spark, sf_dir):
    examples_path, _ = _export(spark, sf_dir)
    back = shards.read_shards(spark, examples_path, TIMEPOINTS, N_FEATURES)
    return _with_text(back, "id", "publication_date_int", "slice_start", "slice_end", "shard")


def exported_manifest(spark, sf_dir):
    _, manifest_path = _export(spark, sf_dir)
    return shards.read_manifest(spark, manifest_path)


def exported_range(spark, sf_dir):
    examples_path, _ = _export(spark, sf_dir)
    low, high = FIRST.window("val")
    return _with_text(shards.read_shards(spark, examples_path, TIMEPOINTS, N_FEATURES, low, high), "id", "publication_date_int")


def manifest_upsert(spark, sf_dir):
    paths = _export(spark, sf_dir, START_YEAR, 1999)
    _, manifest_path = _export(spark, sf_dir, 1997, END_YEAR, paths)
    return shards.read_manifest(spark, manifest_path)


# Versions


def _versions(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """Publishes the papers whose number does not end in 3, then appends the others; returns the place and the new ids."""
    papers, vectors = views.labelled_papers(spark, sf_dir), views.vectors(spark, sf_dir)
    shape = append.Shape(START_YEAR, END_YEAR, ROWS_PER_SHARD, TIMEPOINTS, N_FEATURES, Y_COLS)
    is_new, root = F.col("id") % 10 == 3, scratch.new_path(spark, "published")
    append.first_export(papers.where(~is_new), vectors, root, shape)
    new_ids = papers.where(is_new).select("id")
    append.append_papers(papers, new_ids, vectors, root, shape)
    return root, new_ids


def appended_examples(spark, sf_dir):
    root, _ = _versions(spark, sf_dir)
    rows = published.read_published(spark, root, TIMEPOINTS, N_FEATURES)
    return _with_text(rows, "id", "publication_date_int", "slice_start", "slice_end", "shard")


def published_manifests(spark, sf_dir):
    root, _ = _versions(spark, sf_dir)
    versions = [published.published_manifest(spark, root, v).withColumn("version", F.lit(v)) for v in (1, 2)]
    return versions[0].unionByName(versions[1])


def dangling_references(spark, sf_dir):
    papers = views.papers(spark, sf_dir)
    return citations.dangling_references(papers, papers)


def stale_examples(spark, sf_dir):
    root, new_ids = _versions(spark, sf_dir)
    return append.stale_examples(spark, root, new_ids)


# Folds


def fold_table(spark, sf_dir):
    return folds.fold_table(views.papers(spark, sf_dir), FOLDS)


def fold_roles(spark, sf_dir):
    period = min(f.train_start for f in FOLDS), max(f.test_end for f in FOLDS)
    return folds.assign_roles(views.papers(spark, sf_dir, period), FOLDS)


def fold_roles_overlap(spark, sf_dir):
    return folds.assign_roles(_sliced(spark, sf_dir), FOLDS, "overlap")


def leakage_audit(spark, sf_dir):
    return folds.leakage_audit(views.papers(spark, sf_dir), FOLDS)


def leakage_audit_overlap(spark, sf_dir):
    return folds.leakage_audit(_sliced(spark, sf_dir), FOLDS, "overlap")


def reference_leakage(spark, sf_dir):
    return folds.reference_leakage(views.papers(spark, sf_dir), rank_references(spark, sf_dir), FOLDS)


# Batches


def batch_ids(spark, sf_dir):
    return batches.batch_ids(views.papers(spark, sf_dir).select("id"), BATCH_SIZE, drop_remainder=True)


def whole_batches(spark, sf_dir):
    return batches.batch_ids(views.papers(spark, sf_dir).select("id"), BATCH_SIZE, seed=batches.SEED)


def shuffled_batches(spark, sf_dir):
    return batches.batch_ids(views.papers(spark, sf_dir).select("id"), BATCH_SIZE, seed=batches.SEED, drop_remainder=True)


def role_batches(spark, sf_dir):
    rows = fold_roles(spark, sf_dir)
    return batches.batch_ids(rows, BATCH_SIZE, seed=batches.SEED, drop_remainder=True, keys=["fold", "role"])


# Metrics


def binary_metrics(spark, sf_dir):
    return _rounded(metrics.binary_metrics(views.scored(spark, sf_dir)))


def metrics_by_language(spark, sf_dir):
    langs = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    return _rounded(metrics.binary_metrics(views.scored(spark, sf_dir).join(langs, "id"), by=["lang"]))


def balanced_accuracy(spark, sf_dir):
    return _rounded(metrics.balanced_accuracy(views.scored(spark, sf_dir)))


def log_loss(spark, sf_dir):
    rows = metrics.labelled(views.scored(spark, sf_dir))
    return _rounded(rows.select("id", metrics.log_loss(F.col("y"), F.col("p")).alias("loss")))


def confusion(spark, sf_dir):
    return metrics.confusion(views.scored(spark, sf_dir))


def pr_curve(spark, sf_dir):
    return _rounded(metrics.pr_curve(views.scored(spark, sf_dir)))


def fold_metrics(spark, sf_dir):
    rows = metrics.binary_metrics(views.scored_folds(spark, sf_dir), by=["fold"])
    return _rounded(_through_metric_files(spark, rows))


def fold_pr_curves(spark, sf_dir):
    return _rounded(metrics.pr_curve(views.scored_folds(spark, sf_dir), by=["fold"]))


def _through_metric_files(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Writes one metric file per fold and reads all of them back."""
    out = scratch.new_path(spark, "metrics")
    shards.write_metrics(rows, out, views.FOLD_SETTINGS["test_size"])
    return spark.read.option("header", True).schema(f"{shards.METRIC_SCHEMA}, span string").csv(out)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Run history


def rolling_gap(spark, sf_dir):
    rows = history.rolling_gap(views.table(spark, sf_dir, "events"), "user_id", "ts", "event_id")
    return rows.select("event_id", "user_id", "gap_us", F.round("mean_gap_us", 3).alias("mean_gap_us"))


def trial_log(spark, sf_dir):
    return views.trials(spark, sf_dir)


def unpromising_trials(spark, sf_dir):
    return history.flag_unpromising(views.trials(spark, sf_dir))


def unpromising_trials_min(spark, sf_dir):
    return history.flag_unpromising(views.trials(spark, sf_dir), direction="min")


def early_stop_epoch(spark, sf_dir):
    return history.early_stop_epoch(views.trials(spark, sf_dir))


def early_stop_epoch_min(spark, sf_dir):
    return history.early_stop_epoch(views.trials(spark, sf_dir), patience=3, direction="min")


def best_trial(spark, sf_dir):
    return history.best_trial(views.trials(spark, sf_dir))


# Models


def _price_export(spark: SparkSession, sf_dir: str) -> str:
    """Writes examples of one price feature per paper, on which a fit can be solved to tolerance."""
    examples = sharded_examples(
        views.labelled_papers(spark, sf_dir), views.price_vectors(spark, sf_dir), START_YEAR, END_YEAR, 1,
        ROWS_PER_SHARD, *PRICE_SHAPE, Y_COLS,
    )
    out = scratch.new_path(spark, "examples")
    shards.write_shards(examples, out, ROWS_PER_SHARD, overwrite=True)
    return out


def lr_trials(spark, sf_dir):
    path = _price_export(spark, sf_dir)
    trials = crossval.search_first_fold(spark, path, FOLDS, *PRICE_SHAPE, training.MAX_TRIALS, tol=FIT_TOLERANCE)
    return trials.select("trial", F.round("l2", 9).alias("l2"), F.round("score", 6).alias("score"))


def lr_joint_trials(spark, sf_dir):
    path = _price_export(spark, sf_dir)
    trials = crossval.search_first_fold_jointly(spark, path, FOLDS, *PRICE_SHAPE, training.MAX_TRIALS, tol=FIT_TOLERANCE)
    return trials.select("trial", F.round("l2", 9).alias("l2"), F.round("score", 6).alias("score"))


def lr_search_best(spark, sf_dir):
    return _rounded(history.best_trial(lr_trials(spark, sf_dir)))


def lr_fold_metrics(spark, sf_dir):
    path, models = _price_export(spark, sf_dir), scratch.new_path(spark, "models")
    rows, _ = crossval.cross_validate(
        spark, path, FOLDS, *PRICE_SHAPE, training.MAX_TRIALS, model_path=models, tol=FIT_TOLERANCE
    )
    return _rounded(_through_metric_files(spark, rows), 4)


def lr_test_scores(spark, sf_dir):
    path, models = _price_export(spark, sf_dir), scratch.new_path(spark, "models")
    l2 = training.l2_candidates(1)[0]
    crossval.score_folds(spark, path, FOLDS, l2, *PRICE_SHAPE, model_path=models, tol=FIT_TOLERANCE)
    return _rounded(crossval.score_saved(spark, path, FOLDS, models, *PRICE_SHAPE), 4)


# The same on the full sequences: every time point and feature of the exported examples. Their fits have no SQL.


def lr_sequence_trials(spark, sf_dir):
    path, _ = _export(spark, sf_dir)
    return crossval.search_first_fold(spark, path, FOLDS, TIMEPOINTS, N_FEATURES, training.MAX_TRIALS)


def lr_sequence_joint_trials(spark, sf_dir):
    path, _ = _export(spark, sf_dir)
    return crossval.search_first_fold_jointly(spark, path, FOLDS, TIMEPOINTS, N_FEATURES, training.MAX_TRIALS)


def lr_sequence_search_best(spark, sf_dir):
    return history.best_trial(lr_sequence_trials(spark, sf_dir))


def lr_sequence_fold_metrics(spark, sf_dir):
    (path, _), models = _export(spark, sf_dir), scratch.new_path(spark, "models")
    rows, _ = crossval.cross_validate(spark, path, FOLDS, TIMEPOINTS, N_FEATURES, training.MAX_TRIALS, model_path=models)
    return _through_metric_files(spark, rows)


def lr_sequence_test_scores(spark, sf_dir):
    (path, _), models = _export(spark, sf_dir), scratch.new_path(spark, "models")
    crossval.score_folds(spark, path, FOLDS, training.l2_candidates(1)[0], TIMEPOINTS, N_FEATURES, model_path=models)
    return crossval.score_saved(spark, path, FOLDS, models, TIMEPOINTS, N_FEATURES)


_QUERIES = (
    scan_projection, scan_range, scan_isin, repeated_ids, parse_references, convert_schema, written_papers, written_labelled_papers, date_conversions,
    explode_references, available_references, reference_dates, rank_references, reference_features,
    example_features, examples_between, wide_layout_totals, example_width_check, example_targets, persisted_examples,
    disk_examples, time_slices, wide_time_slices, shard_plan, shard_manifest, budget_manifest, shard_names, select_shards_overlap, train_example_count,
    export_roundtrip, exported_manifest, exported_range, manifest_upsert,
    appended_examples, published_manifests, dangling_references, stale_examples,
    fold_table, fold_roles, fold_roles_overlap, leakage_audit, leakage_audit_overlap, reference_leakage,
    batch_ids, whole_batches, shuffled_batches, role_batches,
    binary_metrics, metrics_by_language, balanced_accuracy, log_loss, confusion, pr_curve,
    fold_metrics, fold_pr_curves,
    rolling_gap, trial_log, unpromising_trials, unpromising_trials_min, early_stop_epoch, early_stop_epoch_min,
    best_trial, lr_trials, lr_search_best, lr_fold_metrics, lr_test_scores,
)
_JOINT_FITS = (lr_joint_trials, lr_sequence_joint_trials)
_SEQUENCE_FITS = (lr_sequence_trials, lr_sequence_search_best, lr_sequence_fold_metrics, lr_sequence_test_scores)


def entry(spark: SparkSession) -> DataFrame:
    """Examples of every paper: id, date, flat feature vector and targets."""
    return _examples(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {q.__name__: q for q in _QUERIES + _JOINT_FITS + _SEQUENCE_FITS}
    if llm:
        named |= llm.QUERIES | {"pipeline": corpus_pipeline.run}
    return named


def oracle_sql() -> dict[str, str]:
    found = dict(ORACLE_SQL)
    if llm:
        found |= llm.ORACLE_SQL
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
