"""DuckDB SQL for the registered queries, over views named after the given tables."""

from __future__ import annotations

from citeframe.operators.training import l2_candidates

# Same settings as the registered queries.
K = 4
N = 64
ROWS_PER_SHARD = 500
BATCH = 512
SEED = 2025
L2 = l2_candidates()
NEWTON_STEPS = 20
YEAR_NS = "364 * 86400 * 1000000000::BIGINT"
PREFIX = "https://openalex.org/W"

_CTE = {
    "papers": (
        """SELECT o_orderkey AS id, epoch_ns(o_orderdate) AS publication_date_int, o_orderdate,
               CASE WHEN len(refs) = 0 AND o_orderstatus = 'P' THEN NULL ELSE refs END AS refs,
               CASE WHEN o_orderpriority <> '4-NOT SPECIFIED'
                    THEN (cents * sum(1) OVER y > sum(cents) OVER y)::INTEGER END AS above_mean,
               (o_orderstatus = 'F')::INTEGER AS fulfilled
        FROM (
            SELECT *, round(o_totalprice * 100)::BIGINT AS cents,
                   list_concat(
                       list_concat(CASE WHEN o_orderpriority = '1-URGENT' THEN [0::BIGINT] ELSE []::BIGINT[] END, near),
                       list_concat(CASE WHEN o_orderpriority = '2-HIGH' THEN near[1:1] ELSE []::BIGINT[] END,
                                   CASE WHEN o_orderpriority = '5-LOW' THEN [o_orderkey + 1000000000] ELSE []::BIGINT[] END)
                   ) AS refs
            FROM (
                SELECT *, list_transform(range(1, o_custkey % 9 + 1),
                                         lambda i: abs(o_orderkey - i * (o_custkey % 50 + 1))) AS near
                FROM orders
            )
        )
        WINDOW y AS (PARTITION BY year(o_orderdate))""",
        (),
    ),
    "vectors": (
        """SELECT o_orderkey AS id, e.embedding
        FROM orders LEFT JOIN embeddings e ON e.vec_id = o_orderkey % (SELECT max(vec_id) + 1 FROM embeddings)""",
        (),
    ),
    "edges": ("SELECT id, unnest(refs) AS ref_id FROM papers", ("papers",)),
    "dated": (
        """SELECT e.id, e.ref_id, p.publication_date_int AS ref_date
        FROM edges e JOIN papers p ON p.id = e.ref_id""",
        ("edges",),
    ),
    "ranked": (
        f"""SELECT * FROM (
            SELECT id, ref_id, ref_date,
                   (row_number() OVER (PARTITION BY id ORDER BY ref_date, ref_id) - 1)::INTEGER AS ref_rank
            FROM dated
        ) WHERE ref_rank < {K}""",
        ("dated",),
    ),
    # Step 0 holds rank K - 1, step K - 1 holds rank 0 and step K the paper itself.
    "steps": (
        f"""SELECT p.id, g.step,
               CASE WHEN v.embedding IS NULL THEN list_transform(range({N}), lambda i: 0::BIGINT)
                    ELSE list_transform(v.embedding, lambda x: floor(x::DOUBLE * 1000000)::BIGINT) END AS v
        FROM papers p
        CROSS JOIN (SELECT unnest(range({K + 1}))::INTEGER AS step) g
        LEFT JOIN ranked r ON r.id = p.id AND r.ref_rank = {K - 1} - g.step
        LEFT JOIN vectors v ON v.id = CASE WHEN g.step = {K} THEN p.id ELSE r.ref_id END""",
        ("ranked", "vectors"),
    ),
    "flat": (
        """SELECT id, flatten(list(v ORDER BY step))::VARCHAR AS features
        FROM steps GROUP BY id""",
        ("steps",),
    ),
    "sliced": (
        """SELECT *, epoch_ns(date_trunc('year', o_orderdate)) AS slice_start,
               epoch_ns(date_trunc('year', o_orderdate) + INTERVAL 1 YEAR) AS slice_end
        FROM papers WHERE year(o_orderdate) >= 1995 AND year(o_orderdate) < 2002""",
        ("papers",),
    ),
    "sharded": (
        f"""SELECT *, ((row_number() OVER (PARTITION BY slice_start ORDER BY id) - 1) // {ROWS_PER_SHARD})::INTEGER AS shard
        FROM sliced""",
        ("sliced",),
    ),
    "manifest": (
        """SELECT slice_start, slice_end, shard, count(*) AS n_examples
        FROM sharded GROUP BY slice_start, slice_end, shard""",
        ("sharded",),
    ),
    "folds": (
        f"""SELECT y::INTEGER AS fold, epoch_ns(make_timestamp(1995, 1, 1, 0, 0, 0)) AS train_start,
               epoch_ns(make_timestamp(y, 1, 1, 0, 0, 0)) - 2 * {YEAR_NS} AS val_start,
               epoch_ns(make_timestamp(y, 1, 1, 0, 0, 0)) - {YEAR_NS} AS test_start,
               epoch_ns(make_timestamp(y, 1, 1, 0, 0, 0)) AS test_end
        FROM (SELECT unnest(range(1995 + 2 + 1 + 1, 2002, 1)) AS y)""",
        (),
    ),
    "windows": (
        """SELECT fold, 'train' AS role, train_start AS low, val_start AS high FROM folds
        UNION ALL SELECT fold, 'val', val_start, test_start FROM folds
        UNION ALL SELECT fold, 'test', test_start, test_end FROM folds""",
        ("folds",),
    ),
    "roles": (
        """SELECT p.id, w.fold, w.role FROM papers p
        JOIN windows w ON p.publication_date_int >= w.low AND p.publication_date_int < w.high""",
        ("papers", "windows"),
    ),
    "roles_overlap": (
        "SELECT p.id, w.fold, w.role FROM sliced p JOIN windows w ON p.slice_end >= w.low AND p.slice_start <= w.high",
        ("sliced", "windows"),
    ),
    "scored": (
        """SELECT l.doc_id AS id, l.quality AS y, (d.n_chars % 101)::DOUBLE / 100 AS p, d.lang
        FROM labels l JOIN documents d USING (doc_id)""",
        (),
    ),
    "scored_folds": (
        """SELECT r.fold, r.id, p.above_mean AS y, (o.o_custkey % 101)::DOUBLE / 100 AS p
        FROM roles r JOIN papers p USING (id) JOIN orders o ON o.o_orderkey = r.id
        WHERE r.role = 'test' AND p.above_mean IS NOT NULL""",
        ("roles",),
    ),
    "losses": (
        """SELECT *, -(y * ln(least(greatest(p, 1e-7), 1 - 1e-7))
                       + (1 - y) * ln(1.0::DOUBLE - least(greatest(p, 1e-7), 1 - 1e-7))) AS loss,
               (p > 0.5)::INTEGER AS y_pred
        FROM scored""",
        ("scored",),
    ),
    "fold_losses": (
        """SELECT *, -(y * ln(least(greatest(p, 1e-7), 1 - 1e-7))
                       + (1 - y) * ln(1.0::DOUBLE - least(greatest(p, 1e-7), 1 - 1e-7))) AS loss,
               (p > 0.5)::INTEGER AS y_pred
        FROM scored_folds""",
        ("scored_folds",),
    ),
    "trials": (
        """SELECT user_id AS trial, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch,
               value AS score
        FROM events""",
        (),
    ),
    "fit_rows": (
        """SELECT r.fold, r.role, r.id, p.above_mean AS y, (floor(o.o_totalprice / 20000) + o.o_custkey % 13) / 8.0::DOUBLE AS x
        FROM roles r JOIN papers p USING (id) JOIN orders o ON o.o_orderkey = r.id WHERE p.above_mean IS NOT NULL""",
        ("roles",),
    ),
    "fit_cells": (
        "SELECT fold, x, count(*) AS n, sum(y) AS pos FROM fit_rows WHERE role = 'train' GROUP BY fold, x",
        ("fit_rows",),
    ),
    # Newton steps for an intercept a and a penalised slope b, for every fold and penalty.
    "newton(fold, trial, l2, step, a, b)": (
        f"""SELECT f.fold, t.trial, t.l2, 0, 0::DOUBLE, 0::DOUBLE
        FROM folds f CROSS JOIN (SELECT unnest({L2}) AS l2, unnest(range({len(L2)}))::INTEGER AS trial) t
        UNION ALL
        SELECT fold, trial, l2, step + 1, a - (bb * ga - ab * gb) / (aa * bb - ab * ab), b - (aa * gb - ab * ga) / (aa * bb - ab * ab)
        FROM (
            SELECT fold, trial, l2, step, a, b, sum(n * p - pos) / sum(n) AS ga, sum(x * (n * p - pos)) / sum(n) + l2 * b AS gb,
                   sum(n * p * (1 - p)) / sum(n) AS aa, sum(n * x * p * (1 - p)) / sum(n) AS ab,
                   sum(n * x * x * p * (1 - p)) / sum(n) + l2 AS bb
            FROM (
                SELECT s.*, c.x, c.n, c.pos, 1 / (1 + exp(-(s.a + s.b * c.x))) AS p
                FROM newton s JOIN fit_cells c ON c.fold = s.fold WHERE s.step < {NEWTON_STEPS}
            ) GROUP BY fold, trial, l2, step, a, b
        )""",
        ("folds", "fit_cells"),
    ),
    "fit_scores": (
        f"""SELECT r.fold, r.role, r.id, r.y, w.trial, w.l2, 1 / (1 + exp(-(w.a + w.b * r.x))) AS p
        FROM fit_rows r JOIN newton w ON w.fold = r.fold AND w.step = {NEWTON_STEPS}""",
        ("newton(fold, trial, l2, step, a, b)",),
    ),
    "fit_trials": (
        """SELECT trial, l2, coalesce(count(*) FILTER (p > 0.5 AND y = 1)::DOUBLE / nullif(count(*) FILTER (p > 0.5), 0), 0) AS score
        FROM fit_scores WHERE role = 'val' AND fold = (SELECT min(fold) FROM folds) GROUP BY trial, l2""",
        ("fit_scores",),
    ),
    "shuffled": (
        f"""SELECT o_orderkey AS id,
               ('0x' || substr(md5('{SEED}-' || o_orderkey::VARCHAR), 1, 13))::BIGINT AS key
        FROM orders""",
        (),
    ),
}


def _with(query: str, *names: str) -> str:
    """The query behind its common table expressions, each after the ones it reads."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _CTE[name][1]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    ctes = ",\n".join(f"{name} AS ({_CTE[name][0]})" for name in ordered)
    return f"WITH {ctes}\n{query}" if ctes else query


def _recursive(query: str, *names: str) -> str:
    return _with(query, *names).replace("WITH", "WITH RECURSIVE", 1)


_BEST = "ORDER BY score DESC, trial LIMIT 1"
_TARGETS = "p.above_mean::FLOAT::DOUBLE AS target_above_mean, p.fulfilled::FLOAT::DOUBLE AS target_fulfilled"
_METRICS = """count(*) AS n, round(avg(loss), 6) AS loss, round(avg((y = y_pred)::INTEGER), 6) AS accuracy,
    round((coalesce(avg(CASE WHEN y = 1 THEN y_pred END), 0) + coalesce(avg(CASE WHEN y = 0 THEN 1 - y_pred END), 0))
          / count(DISTINCT y), 6) AS balanced_accuracy,
    round(coalesce(sum(y * y_pred)::DOUBLE / nullif(sum(y_pred), 0), 0), 6) AS precision,
    round(coalesce(sum(y * y_pred)::DOUBLE / nullif(sum(y), 0), 0), 6) AS recall"""
_LEAKAGE = """SELECT f.fold, coalesce(sum(a AND b), 0)::BIGINT AS train_val, coalesce(sum(b AND c), 0)::BIGINT AS val_test,
    coalesce(sum(a AND c), 0)::BIGINT AS train_test, coalesce(sum(a::INT + b::INT + c::INT > 1), 0)::BIGINT AS n_leaked
FROM folds f LEFT JOIN (
    SELECT fold, id, bool_or(role = 'train') AS a, bool_or(role = 'val') AS b, bool_or(role = 'test') AS c
    FROM {roles} GROUP BY fold, id
) r USING (fold) GROUP BY f.fold"""


def _unpromising(best: str, running: str, test: str) -> str:
    return f"""SELECT t.trial, any_value(b.best_before) AS best_before,
        min(CASE WHEN t.epoch >= 7 AND {test} THEN t.epoch END) AS stop_epoch
    FROM trials t JOIN (
        SELECT trial, {running}(best) OVER (ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before
        FROM (SELECT trial, {best}(score) AS best FROM trials GROUP BY trial)
    ) b USING (trial) GROUP BY t.trial"""


def _early_stop(better: str, patience: int) -> str:
    """Earliest epoch at least ``patience`` epochs after the last one that beat all before it."""
    return f"""WITH trials AS ({_CTE["trials"][0]}),
    marked AS (
        SELECT *, {better}(score) OVER (PARTITION BY trial ORDER BY epoch
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM trials
    ),
    gains AS (
        SELECT *, max(CASE WHEN best_before IS NULL OR {"score > best_before" if better == "max" else "score < best_before"}
                      THEN epoch END) OVER (PARTITION BY trial ORDER BY epoch) AS last_gain FROM marked
    )
    SELECT trial, min(CASE WHEN epoch - last_gain >= {patience} THEN epoch END) AS stop_epoch FROM gains GROUP BY trial"""


def _wide_totals() -> str:
    cols = []
    for rank in reversed(range(K)):
        cols += [f"sum(v[{f + 1}]) FILTER (step = {K - 1 - rank})::BIGINT AS embedding_{f}_{rank}" for f in range(N)]
    cols += [f"sum(v[{f + 1}]) FILTER (step = {K})::BIGINT AS embedding_{f}" for f in range(N)]
    return "SELECT " + ", ".join(cols) + " FROM steps"


ORACLE_SQL = {
    "scan_projection": "SELECT o_orderkey, o_orderdate FROM orders",
    "scan_range": """SELECT o_orderkey, o_custkey FROM orders
        WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-07-01'""",
    "scan_isin": """SELECT o_orderkey AS id, epoch_ns(o_orderdate) AS publication_date_int FROM orders
        WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH')""",
    "repeated_ids": "SELECT l_orderkey, count(*) AS n_rows FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1",
    "parse_references": _with(
        f"""SELECT id, len(nums)::INTEGER AS n_refs, CASE WHEN n IS NULL THEN NULL ELSE n - 1 END::INTEGER AS pos,
               nums[n]::BIGINT AS ref_id
        FROM (
            SELECT id, coalesce(regexp_extract_all(txt, '{PREFIX}([0-9]+)', 1), []::VARCHAR[]) AS nums
            FROM (
                SELECT id, '[' || array_to_string(list_transform(refs, lambda x: '''{PREFIX}' || x::VARCHAR || ''''), ', ')
                           || ']' AS txt FROM papers
            )
        ) LEFT JOIN LATERAL (SELECT unnest(range(1, len(nums) + 1)) AS n) ON true""",
        "papers",
    ),
    "convert_schema": _with(
        """SELECT p.id, p.publication_date_int, coalesce(array_to_string(p.refs, ','), '') AS refs,
               list_transform(v.embedding, lambda x: floor(x::DOUBLE * 1000000)::BIGINT)::VARCHAR AS embedding
        FROM papers p JOIN vectors v USING (id)""",
        "papers", "vectors",
    ),
    "date_conversions": """SELECT o_orderkey AS id, epoch_ns(o_orderdate) AS publication_date_int,
        o_orderdate AS publication_date, epoch_ns(date_trunc('year', o_orderdate)) AS year_ns FROM orders""",
    "explode_references": _with("SELECT id, ref_id FROM edges", "edges"),
    "available_references": _with("SELECT id, ref_id FROM edges WHERE ref_id IN (SELECT id FROM papers)", "edges"),
    "reference_dates": _with("SELECT id, ref_id, ref_date FROM dated", "dated"),
    "rank_references": _with("SELECT id, ref_id, ref_date, ref_rank FROM ranked", "ranked"),
    "reference_features": _with(
        """SELECT r.id, r.ref_rank, r.ref_id,
               list_transform(v.embedding, lambda x: floor(x::DOUBLE * 1000000)::BIGINT)::VARCHAR AS embedding
        FROM ranked r JOIN vectors v ON v.id = r.ref_id""",
        "ranked", "vectors",
    ),
    "example_features": _with("SELECT id, step, v::VARCHAR AS features FROM steps", "steps"),
    "examples_between": _with(
        f"""SELECT p.id, p.publication_date_int, f.features, {_TARGETS} FROM flat f JOIN papers p USING (id)
        WHERE p.o_orderdate >= TIMESTAMP '1997-01-01' AND p.o_orderdate < TIMESTAMP '1999-01-01'""",
        "flat",
    ),
    "wide_layout_totals": _with(_wide_totals(), "steps"),
    "example_width_check": f"SELECT {(K + 1) * N} AS width, {K + 1} AS n_steps, count(*) AS n_examples FROM orders",
    "example_targets": _with(
        """SELECT id, above_mean::DOUBLE AS above_mean, fulfilled::DOUBLE AS fulfilled,
               coalesce(above_mean, 0)::DOUBLE AS above_mean_filled, coalesce(fulfilled, 0)::DOUBLE AS fulfilled_filled
        FROM papers""",
        "papers",
    ),
    "persisted_examples": _with(
        "SELECT count(DISTINCT id) AS n_examples, sum(list_sum(v))::BIGINT AS checksum FROM steps", "steps"
    ),
    "time_slices": _with("SELECT id, slice_start, slice_end FROM sliced", "sliced"),
    "wide_time_slices": """SELECT o_orderkey AS id, epoch_ns(make_timestamp(y, 1, 1, 0, 0, 0)) AS slice_start,
            epoch_ns(make_timestamp(y + 2, 1, 1, 0, 0, 0)) AS slice_end
        FROM (SELECT o_orderkey, 1996 + (year(o_orderdate) - 1996) // 2 * 2 AS y FROM orders
              WHERE year(o_orderdate) >= 1996 AND year(o_orderdate) < 2002)""",
    "shard_plan": _with("SELECT id, slice_start, shard FROM sharded", "sharded"),
    "shard_manifest": _with("SELECT * FROM manifest", "manifest"),
    "shard_names": _with(
        """SELECT slice_start::VARCHAR || '_' || slice_end::VARCHAR || '_shard_' || shard::VARCHAR AS name,
            slice_start AS t_min, slice_end AS t_max FROM manifest""",
        "manifest",
    ),
    "select_shards_overlap": _with(
        """SELECT * FROM manifest WHERE slice_end >= (SELECT val_start FROM folds WHERE fold = 1999)
            AND slice_start <= (SELECT test_start FROM folds WHERE fold = 1999)""",
        "manifest", "folds",
    ),
    "train_example_count": _with(
        f"""SELECT sum(n_examples)::BIGINT AS n_examples, ceil(sum(n_examples) / {BATCH})::BIGINT AS n_batches
        FROM manifest WHERE slice_end >= (SELECT train_start FROM folds WHERE fold = 1999)
            AND slice_start <= (SELECT val_start FROM folds WHERE fold = 1999)""",
        "manifest", "folds",
    ),
    "export_roundtrip": _with(
        f"""SELECT p.id, p.publication_date_int, p.slice_start, p.slice_end, p.shard, f.features, {_TARGETS}
        FROM flat f JOIN sharded p USING (id)""",
        "flat", "sharded",
    ),
    "exported_manifest": _with("SELECT * FROM manifest", "manifest"),
    "manifest_upsert": _with("SELECT * FROM manifest", "manifest"),
    "exported_range": _with(
        f"""SELECT p.id, p.publication_date_int, f.features, {_TARGETS} FROM flat f JOIN papers p USING (id)
        WHERE p.publication_date_int >= (SELECT val_start FROM folds WHERE fold = 1999)
            AND p.publication_date_int < (SELECT test_start FROM folds WHERE fold = 1999)""",
        "flat", "folds",
    ),
    "appended_examples": _with(
        f"""SELECT p.id, p.publication_date_int, p.slice_start, p.slice_end, p.shard, f.features, {_TARGETS}
        FROM flat f JOIN sharded p USING (id)""",
        "flat", "sharded",
    ),
    "published_manifests": _with(
        f"""SELECT slice_start, slice_end, shard, n_examples, 2 AS version FROM manifest
        UNION ALL
        SELECT slice_start, slice_end, shard, count(*) AS n_examples, 1 AS version FROM (
            SELECT slice_start, slice_end,
                   ((row_number() OVER (PARTITION BY slice_start ORDER BY id) - 1) // {ROWS_PER_SHARD})::INTEGER AS shard
            FROM sharded WHERE id % 10 <> 3
        ) GROUP BY ALL""",
        "manifest", "sharded",
    ),
    "dangling_references": _with("SELECT DISTINCT ref_id, id FROM edges WHERE ref_id NOT IN (SELECT id FROM papers)", "edges"),
    "stale_examples": _with(
        "SELECT DISTINCT id FROM edges WHERE id % 10 <> 3 AND ref_id % 10 = 3 AND ref_id IN (SELECT id FROM papers)", "edges"
    ),
    "fold_table": _with(
        """SELECT f.*, count(*) FILTER (r.role = 'train') AS n_train, count(*) FILTER (r.role = 'val') AS n_val,
            count(*) FILTER (r.role = 'test') AS n_test
        FROM folds f LEFT JOIN roles r USING (fold) GROUP BY ALL""",
        "folds", "roles",
    ),
    "fold_roles": _with("SELECT id, fold, role FROM roles", "roles"),
    "fold_roles_overlap": _with("SELECT id, fold, role FROM roles_overlap", "roles_overlap"),
    "leakage_audit": _with(_LEAKAGE.format(roles="roles"), "folds", "roles"),
    "leakage_audit_overlap": _with(_LEAKAGE.format(roles="roles_overlap"), "folds", "roles_overlap"),
    "reference_leakage": _with(
        """SELECT f.fold, count(*) FILTER (r.ref_date >= f.val_start AND r.ref_date < f.test_start) AS val_references,
            count(*) FILTER (r.ref_date >= f.test_start AND r.ref_date < f.test_end) AS test_references,
            count(DISTINCT r.id) FILTER (r.ref_date >= f.val_start AND r.ref_date < f.test_end) AS n_papers
        FROM folds f LEFT JOIN (SELECT r.*, p.publication_date_int FROM ranked r JOIN papers p USING (id)) r
            ON r.publication_date_int >= f.train_start AND r.publication_date_int < f.val_start
        GROUP BY f.fold""",
        "folds", "ranked",
    ),
    "batch_ids": f"""SELECT id, batch_id FROM (
            SELECT o_orderkey AS id, (row_number() OVER (ORDER BY o_orderkey) - 1) // {BATCH} AS batch_id FROM orders
        ) WHERE batch_id < (SELECT count(*) // {BATCH} FROM orders)""",
    "whole_batches": _with(
        f"""SELECT id, (row_number() OVER (ORDER BY key, id) - 1) // {BATCH} AS batch_id FROM shuffled""",
        "shuffled",
    ),
    "shuffled_batches": _with(
        f"""SELECT id, batch_id FROM (
            SELECT id, (row_number() OVER (ORDER BY key, id) - 1) // {BATCH} AS batch_id FROM shuffled
        ) WHERE batch_id < (SELECT count(*) // {BATCH} FROM orders)""",
        "shuffled",
    ),
    "role_batches": _with(
        f"""SELECT id, fold, role, batch_id FROM (
            SELECT r.id, r.fold, r.role, (row_number() OVER (w ORDER BY s.key, s.id) - 1) // {BATCH} AS batch_id,
                   count(*) OVER w // {BATCH} AS n_full
            FROM roles r JOIN shuffled s USING (id) WINDOW w AS (PARTITION BY r.fold, r.role)
        ) WHERE batch_id < n_full""",
        "roles", "shuffled",
    ),
    "binary_metrics": _with(f"SELECT {_METRICS} FROM losses", "losses"),
    "metrics_by_language": _with(f"SELECT lang, {_METRICS} FROM losses GROUP BY lang", "losses"),
    "balanced_accuracy": _with(
        """SELECT round(avg(recall), 6) AS balanced_accuracy, count(*) AS n_classes
        FROM (SELECT y, avg((y = y_pred)::INTEGER) AS recall FROM losses GROUP BY y)""",
        "losses",
    ),
    "log_loss": _with("SELECT id, round(loss, 6) AS loss FROM losses", "losses"),
    "confusion": _with("SELECT y, y_pred, count(*) AS n FROM losses GROUP BY y, y_pred", "losses"),
    "pr_curve": _with(
        """SELECT threshold, round(tp / predicted, 6) AS precision, round(tp / (SELECT sum(y) FROM scored), 6) AS recall
        FROM (
            SELECT p AS threshold, sum(sum(y)) OVER (ORDER BY p DESC)::DOUBLE AS tp, sum(count(*)) OVER (ORDER BY p DESC) AS predicted
            FROM scored GROUP BY p
        ) UNION ALL SELECT NULL, 1.0, 0.0""",
        "scored",
    ),
    "fold_metrics": _with(
        f"""SELECT fold, (fold - 1)::VARCHAR || '-' || fold::VARCHAR AS span, {_METRICS} FROM fold_losses GROUP BY fold""",
        "fold_losses",
    ),
    "fold_pr_curves": _with(
        """SELECT fold, threshold, round(tp / predicted, 6) AS precision, round(tp / positives, 6) AS recall
        FROM (
            SELECT fold, p AS threshold, sum(sum(y)) OVER w::DOUBLE AS tp, sum(count(*)) OVER w AS predicted,
                   sum(sum(y)) OVER (PARTITION BY fold) AS positives
            FROM scored_folds GROUP BY fold, p WINDOW w AS (PARTITION BY fold ORDER BY p DESC)
        ) UNION ALL SELECT DISTINCT fold, NULL, 1.0, 0.0 FROM scored_folds""",
        "scored_folds",
    ),
    "rolling_gap": """SELECT event_id, user_id, gap_us,
            round(avg(gap_us) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 3) AS mean_gap_us
        FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_us FROM events)""",
    "trial_log": _with("SELECT * FROM trials", "trials"),
    "unpromising_trials": _with(_unpromising("max", "max", "t.score < b.best_before * 0.97"), "trials"),
    "unpromising_trials_min": _with(_unpromising("min", "min", "t.score > b.best_before * (1 / 0.97::DOUBLE)"), "trials"),
    "early_stop_epoch": _early_stop("max", 1),
    "early_stop_epoch_min": _early_stop("min", 3),
    "best_trial": _with(
        "SELECT trial, max(score) AS score FROM trials GROUP BY trial ORDER BY score DESC, trial LIMIT 1", "trials"
    ),
    "lr_trials": _recursive("SELECT trial, round(l2, 9) AS l2, round(score, 6) AS score FROM fit_trials", "fit_trials"),
    "lr_joint_trials": _recursive("SELECT trial, round(l2, 9) AS l2, round(score, 6) AS score FROM fit_trials", "fit_trials"),
    "lr_search_best": _recursive(f"SELECT trial, round(score, 6) AS score FROM fit_trials {_BEST}", "fit_trials"),
    "lr_fold_metrics": _recursive(
        f"""SELECT fold, (fold - 1)::VARCHAR || '-' || fold::VARCHAR AS span, {_METRICS.replace(", 6)", ", 4)")}
        FROM (
            SELECT fold, y, (p > 0.5)::INTEGER AS y_pred,
                   -(y * ln(least(greatest(p, 1e-7), 1 - 1e-7)) + (1 - y) * ln(1.0::DOUBLE - least(greatest(p, 1e-7), 1 - 1e-7))) AS loss
            FROM fit_scores WHERE role = 'test' AND trial = (SELECT trial FROM fit_trials {_BEST})
        ) GROUP BY fold""",
        "fit_trials",
    ),
    "lr_test_scores": _recursive(
        "SELECT fold, id, y::DOUBLE AS y, round(p, 4) AS p FROM fit_scores WHERE role = 'test' AND trial = 0", "fit_scores"
    ),
}

# Writing and keeping rows does not change them.
ORACLE_SQL["written_papers"] = ORACLE_SQL["convert_schema"]
ORACLE_SQL["disk_examples"] = ORACLE_SQL["persisted_examples"]
ORACLE_SQL["written_labelled_papers"] = ORACLE_SQL["convert_schema"].replace(
    "SELECT p.id, p.publication_date_int,", "SELECT p.id, p.publication_date_int, p.above_mean, p.fulfilled,"
)
ORACLE_SQL["budget_manifest"] = _with(
    f"""SELECT slice_start, slice_end, shard, count(*) AS n_examples
    FROM (
        SELECT slice_start, slice_end,
               ((row_number() OVER (PARTITION BY slice_start ORDER BY id) - 1) // (15000000 // ({K + 1} * {N} * 4 * 32)))::INTEGER AS shard
        FROM sliced
    ) GROUP BY slice_start, slice_end, shard""",
    "sliced",
)
