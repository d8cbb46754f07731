"""Feature assembly, model fits and their metrics over the processed turns.

SQL computes ridge models as well: covariances of the rows, standardised, and their
system of equations solved step by step. Of models of trees it computes scores and what
rows say at every node, and what the sums at the leaves of a fitted model have to be.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from catalog import inputs as I
from catalog.inputs import sql_fraction
from catalog.registry import query
from turnledger import constants as K
from turnledger.functions import text as tx
from turnledger.operators import ml, scoring
from turnledger.operators.sampling import in_first_part
from turnledger.operators.tree_table import Node, Trees, node_statistics, node_table
from turnledger.operators.turns import training_rows
from turnledger.plans.train import model_rows, train_and_test


def _vector(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """One column per vector element."""
    return df.select(
        "record_id",
        "turn_index",
        *[vector_to_array(column)[i].alias(f"f_{n}") for i, n in enumerate(names)],
    )


def _sql_features(expr: str) -> str:
    return ", ".join(f"{expr.format(f)} AS f_{f}" for f in K.FEATURE_COLUMNS)


@query("ml_assemble", f"WITH {I.FEATURES} SELECT record_id, turn_index, {_sql_features(I.rnd('CAST({} AS DOUBLE)'))} FROM features")
def ml_assemble(spark, sf):
    assembled = ml.assembler().transform(training_rows(I.features(spark, sf)))
    return I.rounded(_vector(assembled, "raw_features", K.FEATURE_COLUMNS))


@query("ml_scale", f"""WITH {I.FEATURES}
SELECT record_id, turn_index, {_sql_features(I.rnd('({0} - avg({0}) OVER ()) / stddev_samp({0}) OVER ()'))} FROM features""")
def ml_scale(spark, sf):
    assembled = ml.assembler().transform(training_rows(I.features(spark, sf)))
    scaled = ml.scaler().fit(assembled).transform(assembled)
    return I.rounded(_vector(scaled, "features", K.FEATURE_COLUMNS))


PREDICTED = "(char_count / 6.0::DOUBLE + 2)"


def _sql_metrics(y: str, p: str) -> str:
    return f"""{I.rnd(f'sqrt(avg(({y} - {p}) * ({y} - {p})))')} AS rmse, {I.rnd(f'avg(abs({y} - {p}))')} AS mae,
  {I.rnd(f'1 - sum(({y} - {p}) * ({y} - {p})) / (var_pop({y}) * count(*))')} AS r2,
  {I.rnd(f'avg(abs(({y} - {p}) / {y})) * 100')} AS mape, count(*) AS rows"""


@query("ml_regression_metrics", f"WITH {I.FEATURES} SELECT {_sql_metrics('token_count', PREDICTED)} FROM features")
def ml_regression_metrics(spark, sf):
    predicted = I.features(spark, sf).withColumn("prediction", F.col("char_count") / 6.0 + 2)
    return I.rounded(ml.regression_metrics(predicted, "token_count"))


@query("ml_segment_metrics", f"""WITH {I.FEATURES}, segmented AS (SELECT *, {I.sql_segment('raw_text')} AS segment FROM features)
SELECT segment, {_sql_metrics('token_count', PREDICTED)} FROM segmented GROUP BY segment""")
def ml_segment_metrics(spark, sf):
    predicted = I.features(spark, sf).select(
        tx.segment("raw_text").alias("segment"),
        "token_count",
        (F.col("char_count") / 6.0 + 2).alias("prediction"),
    )
    return I.rounded(ml.regression_metrics(predicted, "token_count", keys=["segment"]))


def _fitted(spark, sf, job) -> DataFrame:
    """Metrics of the models that `job(train, test)` fits; wall times left out."""
    with ml.kept(model_rows(I.features(spark, sf))) as rows:
        fitted = job(*train_and_test(rows))
    return I.rounded(ml.metrics_frame(spark, fitted).drop("training_time_seconds"))


def _sql_solved(name: str, rows: str, systems: str, features: list[str], label: str) -> str:
    """CTEs that end in `{name}_fit(system, i, mean, slope)`, the label's mean at the last i.

    `systems` selects (system, penalty, left_out): a ridge model of the training rows
    whose fold is not left out. The elimination of Gauss and Jordan, one CTE per feature.
    """
    n = len(features)
    columns = ", ".join(f"CAST({c} AS DOUBLE)" for c in [*features, label])
    steps = "".join(f"""
{name}_{k} AS MATERIALIZED (
  SELECT a.system, a.i, a.j,
    CASE WHEN a.i = {k} THEN a.v / p.v ELSE a.v - r.v * c.v / p.v END AS v
  FROM {name}_{k - 1} a
  JOIN {name}_{k - 1} p ON p.system = a.system AND p.i = {k} AND p.j = {k}
  JOIN {name}_{k - 1} r ON r.system = a.system AND r.i = a.i AND r.j = {k}
  JOIN {name}_{k - 1} c ON c.system = a.system AND c.i = {k} AND c.j = a.j),""" for k in range(1, n + 1))
    return f"""
{name}_systems AS ({systems}),
{name}_long AS MATERIALIZED (
  SELECT row, fold, generate_subscripts([{columns}], 1) AS i, unnest([{columns}]) AS x
  FROM {rows} WHERE in_train),
{name}_moments AS MATERIALIZED (
  SELECT system, penalty, a.i, b.i AS j, covar_pop(a.x, b.x) AS c, avg(a.x) AS mean
  FROM {name}_long a JOIN {name}_long b USING (row) JOIN {name}_systems ON a.fold IS DISTINCT FROM left_out
  GROUP BY ALL),
{name}_0 AS MATERIALIZED (
  SELECT m.system, m.i, m.j, coalesce(m.c / nullif(sqrt(s.c * t.c), 0), 0)
    + CASE WHEN m.i = m.j THEN m.penalty / sqrt(y.c) ELSE 0 END AS v
  FROM {name}_moments m
  JOIN {name}_moments s ON s.system = m.system AND s.i = m.i AND s.j = m.i
  JOIN {name}_moments t ON t.system = m.system AND t.i = m.j AND t.j = m.j
  JOIN {name}_moments y ON y.system = m.system AND y.i = {n + 1} AND y.j = {n + 1}
  WHERE m.i <= {n}),{steps}
{name}_fit AS MATERIALIZED (
  SELECT m.system, m.i, m.mean, CASE WHEN m.i <= {n} THEN coalesce(z.v * sqrt(y.c / nullif(m.c, 0)), 0) END AS slope
  FROM {name}_moments m
  JOIN {name}_moments y ON y.system = m.system AND y.i = {n + 1} AND y.j = {n + 1}
  LEFT JOIN {name}_{n} z ON z.system = m.system AND z.i = m.i AND z.j = {n + 1}
  WHERE m.i = m.j)"""


def _sql_predicted(name: str, rows: str, features: list[str], label: str, condition: str) -> str:
    """(system, row, y, p): rows with what the models of `_sql_solved` predict."""
    columns = ", ".join(f"CAST({c} AS DOUBLE)" for c in features)
    return f"""SELECT f.system, r.row, any_value(r.y) AS y,
    sum(CASE WHEN f.slope IS NULL THEN f.mean ELSE (r.x[f.i] - f.mean) * f.slope END) AS p
  FROM (SELECT row, fold, in_train, CAST({label} AS DOUBLE) AS y, [{columns}] AS x FROM {rows}) r
  JOIN {name}_fit f ON true JOIN {name}_systems s ON s.system = f.system
  WHERE {condition} GROUP BY f.system, r.row"""


_FOLD = f"CAST(floor({sql_fraction('record_id', 'turn_index', seed=K.SPLIT_SEED + 1)} * 3) AS INTEGER)"
_SPLIT = f"""split AS MATERIALIZED (
  SELECT *, row_number() OVER () AS row, {_FOLD} AS fold,
    {sql_fraction('record_id', 'turn_index')} < 0.8 AS in_train FROM features)"""


def _sql_fit_row(predicted: str, name: str, kind: str, label: str, chosen: str) -> str:
    return f"""SELECT '{name}' AS model_name, '{kind}' AS model_type, '{label}' AS target,
  {I.rnd('sqrt(avg((y - p) * (y - p)))')} AS rmse, {I.rnd('avg(abs(y - p))')} AS mae,
  {I.rnd('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))')} AS r2,
  count(*) AS test_rows, {chosen} AS best_reg_param FROM ({predicted})"""


def _sql_ridge(name: str, label: str) -> str:
    """Metrics on the test rows of the model with penalty 0.1."""
    system = "SELECT 0 AS system, 0.1::DOUBLE AS penalty, NULL::INTEGER AS left_out"
    predicted = _sql_predicted("ridge", "split", K.FEATURE_COLUMNS, label, "NOT in_train")
    return (
        f"WITH {I.FEATURES}, {_SPLIT}, {_sql_solved('ridge', 'split', system, K.FEATURE_COLUMNS, label)} "
        + _sql_fit_row(predicted, name, "LinearRegression", label, "NULL::DOUBLE")
    )


def _sql_cross_validated() -> str:
    label, features = K.LABEL_COLUMN, K.FEATURE_COLUMNS
    grid = """SELECT row_number() OVER (ORDER BY penalty, left_out) AS system, penalty, left_out
  FROM (SELECT unnest([0.01, 0.1, 1.0])::DOUBLE AS penalty), (SELECT unnest([0, 1, 2]) AS left_out)"""
    held = _sql_predicted("grid", "split", features, label, "r.in_train AND r.fold = s.left_out")
    best = """SELECT 0 AS system, penalty, NULL::INTEGER AS left_out FROM (
    SELECT system, sqrt(avg((y - p) * (y - p))) AS rmse FROM held GROUP BY system
  ) JOIN grid_systems USING (system) GROUP BY penalty ORDER BY avg(rmse), penalty LIMIT 1"""
    predicted = _sql_predicted("best", "split", features, label, "NOT in_train")
    return (
        f"WITH {I.FEATURES}, {_SPLIT}, {_sql_solved('grid', 'split', grid, features, label)}, "
        f"held AS MATERIALIZED ({held}), {_sql_solved('best', 'split', best, features, label)} "
        + _sql_fit_row(predicted, "cv_ridge_token_count", "CrossValidatedRidge", label,
                       "(SELECT penalty FROM best_systems)")
    )


@query("ml_ridge_metrics", _sql_ridge("ridge_token_count", K.LABEL_COLUMN))
def ml_ridge_metrics(spark, sf):
    return _fitted(
        spark, sf, lambda tr, te: [ml.fit("ridge_token_count", ml.ridge(), tr, te)]
    )


@query("ml_ridge_opt_metrics", _sql_ridge("ridge_opt_token_count", K.OPT_LABEL_COLUMN))
def ml_ridge_opt_metrics(spark, sf):
    return _fitted(
        spark, sf,
        lambda tr, te: [ml.fit("ridge_opt_token_count", ml.ridge(), tr, te, K.OPT_LABEL_COLUMN)],
    )


@query("ml_cv_metrics", _sql_cross_validated())
def ml_cv_metrics(spark, sf):
    return _fitted(spark, sf, lambda tr, te: [ml.cross_validate(tr, te)])


@query("ml_select_model")
def ml_select_model(spark, sf):
    """A threshold no model can reach, so that boosted trees are tried as well."""
    return _fitted(
        spark, sf,
        lambda tr, te: ml.select_model(tr, te, K.NO_LEAK_COLUMNS, threshold=1.1)[1],
    )


def _prompt_rows(spark, sf) -> DataFrame:
    """Request features of the prompts with token labels. The labels come from other
    measures of the text, because the tables hold no token counts of a service."""
    # Nulls are dropped by the text: a test of the features would compute them twice.
    prompts = I.prompts(spark, sf).filter(F.col("prompt").isNotNull())
    featured = scoring.add_request_features(prompts)
    return featured.select(
        "doc_id",
        tx.segment("prompt").alias("segment"),
        *K.REQUEST_FEATURE_COLUMNS,
        tx.estimate_tokens("prompt").cast("double").alias("input_tokens"),
        (tx.sentence_pieces("prompt") * 20 + tx.code_keywords("prompt")).cast("double").alias("output_tokens"),
        in_first_part(["doc_id"]).alias("in_train"),
    )


@query("ml_segment_models")
def ml_segment_models(spark, sf):
    with ml.kept(_prompt_rows(spark, sf)) as rows:
        train, test = train_and_test(rows)
        models = ml.fit_segments(train, "output_tokens", K.REQUEST_FEATURE_COLUMNS)
        scored = ml.score_segments(test, models)
        metrics = ml.regression_metrics(scored, "output_tokens", keys=["segment"]).collect()
    return I.rounded(spark.createDataFrame(
        metrics, "segment string, rmse double, mae double, r2 double, mape double, rows long"
    ))


@query("ml_forest_importance")
def ml_forest_importance(spark, sf):
    with ml.kept(_prompt_rows(spark, sf)) as rows:
        fitted = ml.pipeline(ml.forest(), "output_tokens", K.REQUEST_FEATURE_COLUMNS).fit(rows)
    return I.rounded(ml.feature_importances(spark, fitted, K.REQUEST_FEATURE_COLUMNS))


TREES = Trees(
    features=("char_count", "sentence_count", "avg_word_length", "has_code_block_int"),
    mean=(120.0, 2.0, 5.0, 0.0),
    factor=(0.015625, 0.5, 1.0, 1.0),
    weights=(1.0, 0.1, 0.1),
    trees=(
        (Node(1, 0, 0.25), Node(2, 1, -0.5), Node(4, prediction=9.0), Node(5, prediction=17.5),
         Node(3, 0, 2.0), Node(6, prediction=41.0), Node(7, prediction=160.25)),
        (Node(1, 2, 0.5), Node(2, prediction=6.0), Node(3, 1, 1.0), Node(6, prediction=-4.5), Node(7, prediction=-11.0)),
        (Node(1, 3, 0.5), Node(2, 0, -1.0), Node(4, prediction=-3.0), Node(5, prediction=0.5), Node(3, prediction=8.0)),
    ),
    boosted=True,
)


def _sql_went(n: Node, right: int) -> str:
    at = f"({TREES.features[n.feature]}::DOUBLE - {TREES.mean[n.feature]!r}::DOUBLE) * {TREES.factor[n.feature]!r}::DOUBLE"
    return f"{at} {'>' if right else '<='} {n.threshold!r}::DOUBLE"


def _sql_passed(tree: tuple[Node, ...], node: int) -> str:
    """Whether a row passes a node: all splits above it led there."""
    by_number = {n.node: n for n in tree}
    above = [(by_number[node >> k], node >> (k - 1) & 1) for k in range(1, node.bit_length())]
    return " AND ".join([_sql_went(n, right) for n, right in above]) or "true"


def _sql_tree(t: int) -> str:
    leaves = [n for n in TREES.trees[t] if n.feature is None]
    cases = " ".join(f"WHEN {_sql_passed(TREES.trees[t], n.node)} THEN {n.prediction!r}::DOUBLE" for n in leaves)
    return f"{TREES.weights[t]!r}::DOUBLE * CASE {cases} END"


def _sql_score(trees: int) -> str:
    return " + ".join(["0.0::DOUBLE", *[_sql_tree(t) for t in range(trees)]])


def _sql_node_rows() -> str:
    return " UNION ALL ".join(
        f"""SELECT {t} AS tree, {n.node} AS node, {'token_count::DOUBLE' if t == 0 else f'2 * (token_count - ({_sql_score(t)}))'} AS y
  FROM features WHERE {_sql_passed(tree, n.node)}"""
        for t, tree in enumerate(TREES.trees) for n in tree
    )


@query("ml_tree_scores", f"WITH {I.FEATURES} SELECT record_id, turn_index, {I.rnd(_sql_score(len(TREES.trees)))} AS prediction FROM features")
def ml_tree_scores(spark, sf):
    """Given trees as one expression over the turns."""
    rows = training_rows(I.features(spark, sf))
    return I.rounded(rows.select("record_id", "turn_index", TREES.predict().alias("prediction")))


@query("ml_tree_statistics", f"""WITH {I.FEATURES}, at_nodes AS ({_sql_node_rows()}),
s AS (SELECT tree, node, count(*) AS rows, avg(y) AS mean, var_pop(y) AS variance FROM at_nodes GROUP BY 1, 2),
c AS (SELECT tree, node // 2 AS node, sum(rows * variance) AS left_over FROM s WHERE node > 1 GROUP BY 1, 2)
SELECT CAST(s.tree AS INTEGER) AS tree, CAST(s.node AS BIGINT) AS node, s.rows, {I.rnd('s.mean')} AS mean, {I.rnd('s.variance')} AS variance,
  {I.rnd('s.variance - c.left_over / s.rows')} AS gain FROM s LEFT JOIN c USING (tree, node)""")
def ml_tree_statistics(spark, sf):
    """Rows, mean and variance at every node of given trees, and the gain of every split."""
    return I.rounded(node_statistics(training_rows(I.features(spark, sf)), TREES, "token_count"))


# Trees a segment in `ml_boosted_leaves`, whose fits are those of `ml_segment_models`.
LEAF_TREES = 10

_SQL_OUTPUT_TOKENS = (
    "greatest(1, len(regexp_split_to_array(prompt, '[.!?]+'))) * 20.0::DOUBLE"
    f" + len(regexp_extract_all(prompt, '\\b(?:{'|'.join(K.CODE_KEYWORDS)})\\b'))"
)


@query("ml_boosted_leaves", f"""WITH {I.PROMPTS}, rows AS (
  SELECT {I.sql_segment('prompt')} AS segment, {_SQL_OUTPUT_TOKENS} AS y FROM prompts
  WHERE prompt IS NOT NULL AND {sql_fraction('doc_id')} < 0.8)
SELECT segment, CAST(t AS INTEGER) AS tree, count(*) AS rows, {I.rnd('CASE WHEN t = 0 THEN avg(y) ELSE 0 END')} AS mean,
  0.0::DOUBLE AS leaf_error FROM rows, generate_series(0, {LEAF_TREES - 1}) g(t) GROUP BY segment, t""")
def ml_boosted_leaves(spark, sf):
    """What has to hold for boosted trees, whatever their splits: every row comes to one
    leaf of every tree, the first tree predicts the label's mean over all rows, later ones
    nothing over all rows, and each leaf predicts the mean of what its rows leave over."""
    result = []
    with ml.kept(_prompt_rows(spark, sf)) as rows:
        train, _ = train_and_test(rows)
        models = ml.fit_segments(train, "output_tokens", K.REQUEST_FEATURE_COLUMNS, max_iter=LEAF_TREES)
        for name, model in models.items():
            trees = Trees.of(model)
            own = node_statistics(train.filter(F.col("segment") == name), trees, "output_tokens")
            leaves = node_table(spark, trees).filter("feature IS NULL").join(own, ["tree", "node"])
            result += leaves.groupBy("tree").agg(
                F.lit(name).alias("segment"),
                F.sum("rows").alias("rows"),
                (F.sum(F.col("rows") * F.col("prediction")) / F.sum("rows")).alias("mean"),
                F.max(F.abs(F.col("mean") - F.col("prediction"))).alias("leaf_error"),
            ).select("segment", "tree", "rows", "mean", "leaf_error").collect()
    return I.rounded(spark.createDataFrame(result, "segment string, tree int, rows long, mean double, leaf_error double"))
