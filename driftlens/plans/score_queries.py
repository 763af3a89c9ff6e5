"""Queries over model outputs: scoring expressions, detectors, metrics, records and whole evaluations."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from driftlens.functions import vectors as X
from driftlens.functions.text import words
from driftlens.operators import adapters as A
from driftlens.operators import aggregates, metrics
from driftlens.operators import detectors as D
from driftlens.operators.detectors.base import label
from driftlens.operators.detectors.projection import nearest
from driftlens.operators.detectors.softmax import OUTPUT_ALPHAS, OUTPUT_TEMPERATURES
from driftlens.operators.rejection import perf_vs_rejection
from driftlens.plans import evaluation
from driftlens.plans import views as V
from driftlens.plans.experiments import experiment_matrix, tag_scores
from driftlens.plans.registry import query, rounded, six, six_off_ties
from driftlens.plans.sqlviews import log_softmax, using
from driftlens.plans.sqlviews import six as six_sql
from driftlens.plans.sqlviews import six_off_ties as six_off_ties_sql
from driftlens.session import scratch_path
from driftlens.sources.bucketed import BucketedRecords
from driftlens.streaming import upsert_stream

# --- scoring expressions -------------------------------------------------------------------------


def _elements(df, column, *keys):
    """One row per array element, so that values compare one by one."""
    return df.select(*keys, F.posexplode(column).alias("i", "value"))


@query(
    "fn_log_softmax",
    using("fx_logits", body=f"""SELECT sample_id, (i - 1)::INT AS i, {six_sql('v')} AS value FROM
    (SELECT sample_id, unnest({log_softmax('logits')}) AS v, generate_subscripts(logits, 1) AS i FROM fx_logits)"""),
)
def fn_log_softmax(spark, sf_dir):
    rows = V.logits(spark, sf_dir).withColumn("lp", X.log_softmax(F.col("logits")))
    return rounded(_elements(rows, "lp", "sample_id"), "value")


@query("fn_argmax", using("fx_logits", body="SELECT sample_id, (list_position(logits, list_max(logits)) - 1)::INT AS pred_label FROM fx_logits"))
def fn_argmax(spark, sf_dir):
    return V.logits(spark, sf_dir).select("sample_id", X.argmax(F.col("logits")).alias("pred_label"))


@query(
    "fn_pad_matrix",
    using("fx_token_scores", m="SELECT max(len(token_scores)) AS m FROM fx_token_scores",
    body="""SELECT sample_id, seq_id, len(token_scores)::INT AS length, m::INT AS padded,
    round(list_sum(token_scores), 6) + 0.0 AS total FROM fx_token_scores, m"""),
)
def fn_pad_matrix(spark, sf_dir):
    padded = A.pad_matrix(V.token_scores(spark, sf_dir), "token_scores")
    return padded.select(
        "sample_id", "seq_id", "length", F.size("token_scores").alias("padded"), six(X.total(F.col("token_scores"))).alias("total")
    )


@query("fn_flatten_struct", 'SELECT doc_id, quality AS "msp+quality", toxic AS "msp+deep+toxic" FROM labels')
def fn_flatten_struct(spark, sf_dir):
    nested = V.table(spark, sf_dir, "labels").select(
        "doc_id", F.struct("quality", F.struct("toxic").alias("deep")).alias("msp")
    )
    return A.flatten_structs(nested)


@query(
    "fn_likelihood",
    using("fx_token_scores", body="""SELECT sample_id, seq_id, round(CASE WHEN seq_id = 0 THEN len(token_scores)::DOUBLE
    ELSE list_sum(token_scores) END, 6) + 0.0 AS likelihood FROM fx_token_scores"""),
)
def fn_likelihood(spark, sf_dir):
    rows = V.token_scores(spark, sf_dir)
    beam = F.when(F.col("seq_id") == 0, F.size("token_scores").cast("double"))
    return rows.select("sample_id", "seq_id", six(X.likelihood(beam, F.col("token_scores"))).alias("likelihood"))


@query(
    "fn_seq_reshape",
    using("fx_dialog_array", body="""SELECT row_id, (i - 1) // 2 AS sample_id, ((i - 1) % 2)::INT AS seq_id, value FROM
    (SELECT row_id, unnest(dialog) AS value, generate_subscripts(dialog, 1) AS i FROM fx_dialog_array)"""),
)
def fn_seq_reshape(spark, sf_dir):
    return A.reshape_sequences(V.dialog_arrays(spark, sf_dir), "dialog", 2)


# --- detectors on token distributions ------------------------------------------------------------


@query(
    "det_msp",
    using("fx_logits", body=f"SELECT sample_id, 0 AS seq_id, '{label('msp', temperature=1.0, mode='output')}' AS detector, {six_sql(f'1 - exp(list_max({log_softmax('logits')}))')} AS score FROM fx_logits"),
)
def det_msp(spark, sf_dir):
    return rounded(D.MSP().transform(V.logits(spark, sf_dir)), "score")


@query(
    "det_energy",
    using("fx_logits", body=f"""SELECT sample_id, 0 AS seq_id, '{label('energy', temperature=2.0, mode='output')}' AS detector,
    {six_sql('-2.0 * (list_max(logits) / 2.0 + ln(list_sum(list_transform(logits, lambda y: exp((y - list_max(logits)) / 2.0)))))')} AS score FROM fx_logits"""),
)
def det_energy(spark, sf_dir):
    return rounded(D.Energy(temperature=2.0).transform(V.logits(spark, sf_dir)), "score")


def _grid(name, temperatures, alphas, **more):
    """VALUES rows (temperature, alpha, detector key)."""
    return ", ".join(
        f"({t!r}::DOUBLE, {a!r}::DOUBLE, '{label(name, temperature=t, alpha=a, **more)}')" for t, a in product(temperatures, alphas)
    )


SOFT_SQL = f"SELECT sample_id, temperature, {log_softmax('logits', 'temperature')} AS lp FROM fx_logits, (SELECT DISTINCT temperature FROM grid)"


@query(
    "det_renyi",
    using(
        "fx_logits",
        grid=f"SELECT * FROM (VALUES {_grid('renyi', OUTPUT_TEMPERATURES, (*OUTPUT_ALPHAS, 1.0), mode='output')}) g(temperature, alpha, detector)",
        soft=SOFT_SQL,
        body=f"""SELECT sample_id, 0 AS seq_id, detector, {six_sql('''CASE WHEN alpha = 1
        THEN ln(len(lp)) + list_sum(list_transform(lp, lambda x: exp(x) * x))
        ELSE ln(len(lp)) + (alpha * list_max(lp) + ln(list_sum(list_transform(lp, lambda x: exp(alpha * (x - list_max(lp))))))) / (alpha - 1) END''')} AS score
        FROM soft JOIN grid USING (temperature)""",
    ),
)
def det_renyi(spark, sf_dir):
    scorer = D.RenyiNeg(OUTPUT_TEMPERATURES, (*OUTPUT_ALPHAS, 1.0))
    return rounded(scorer.transform(V.logits(spark, sf_dir)), "score")


@query(
    "det_renyi_token",
    using("fx_logits", body=f"""SELECT sample_id // 4 AS sample_id, 0 AS seq_id, '{label('renyi', temperature=1.0, alpha=0.5, mode='token')}' AS detector,
    (row_number() OVER (PARTITION BY sample_id // 4 ORDER BY sample_id) - 1)::INT AS i,
    {six_sql(f'ln(len(logits)) - 2 * ln(list_sum(list_transform({log_softmax("logits")}, lambda z: exp(z / 2))))')} AS value FROM fx_logits"""),
)
def det_renyi_token(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct("seq_id", "logits")))
    tokens = V.beams(spark, sf_dir).groupBy("sample_id").agg(F.transform(ordered, lambda s: s["logits"]).alias("token_logits"))
    curves = D.RenyiNeg((1.0,), (0.5,), mode="token").transform_tokens(tokens)
    return rounded(_elements(curves, "token_scores", "sample_id", "seq_id", "detector"), "value")


# Sequences of two to four tokens: the mean over several tokens, from generated and from input tokens.
TOKEN_MEANS = {
    "msp": ("1 - exp(list_max(lp))", lambda mode: D.MSP(mode=mode), {"temperature": 1.0}),
    "energy": ("-(list_max(logits) + ln(list_sum(list_transform(logits, lambda y: exp(y - list_max(logits))))))", lambda mode: D.Energy(temperature=1.0, mode=mode), {"temperature": 1.0}),
    "renyi": ("ln(len(lp)) - 2 * ln(list_sum(list_transform(lp, lambda z: exp(z / 2))))", lambda mode: D.RenyiNeg((1.0,), (0.5,), mode=mode), {"temperature": 1.0, "alpha": 0.5}),
    "fisher_rao": ("2 / pi() * acos(least(1.0, list_sum(list_transform(lp, lambda x: exp(x / 2))) / sqrt(len(lp))))", lambda mode: D.FisherRao((1.0,), mode=mode), {"temperature": 1.0}),
}


def _token_means(name: str, mode: str) -> None:
    value, scorer, params = TOKEN_MEANS[name]
    sql = using(
        "fx_logits",
        soft=f"""SELECT sample_id // 4 AS sample_id, logits, {log_softmax('logits')} AS lp FROM fx_logits
        WHERE sample_id % 4 < 4 - (sample_id // 4) % 3""",
        body=f"""SELECT sample_id, 0 AS seq_id, '{label(name, **params, mode=mode)}' AS detector, {six_sql(f'avg({value})')} AS score
        FROM soft GROUP BY sample_id""",
    )

    @query(f"det_{name}_{mode}_mean", sql)
    def build(spark, sf_dir):
        ordered = F.array_sort(F.collect_list(F.struct("seq_id", "logits")))
        column = "input_token_logits" if mode == "input" else "token_logits"
        rows = V.beams(spark, sf_dir).groupBy("sample_id").agg(ordered.alias("_all"))
        kept = F.slice("_all", F.lit(1), (4 - F.col("sample_id") % 3).cast("int"))
        rows = rows.select("sample_id", F.transform(kept, lambda s: s["logits"]).alias(column))
        return rounded(scorer(mode).transform(rows), "score")


for _name in TOKEN_MEANS:
    for _mode in ("output", "input"):
        _token_means(_name, _mode)


@query(
    "det_fisher_rao",
    using(
        "fx_logits",
        grid=f"""SELECT * FROM (VALUES {', '.join(f"({t!r}::DOUBLE, '{label('fisher_rao', temperature=t, mode='output')}')" for t in OUTPUT_TEMPERATURES)}) g(temperature, detector)""",
        soft=SOFT_SQL,
        body=f"""SELECT sample_id, 0 AS seq_id, detector,
        {six_sql('2 / pi() * acos(least(1.0, list_sum(list_transform(lp, lambda x: exp(x / 2))) / sqrt(len(lp))))')} AS score
        FROM soft JOIN grid USING (temperature)""",
    ),
)
def det_fisher_rao(spark, sf_dir):
    return rounded(D.FisherRao(OUTPUT_TEMPERATURES).transform(V.logits(spark, sf_dir)), "score")


@query(
    "det_renyi_fitted",
    using(
        "fx_logits",
        soft=f"SELECT sample_id, is_ref, {log_softmax('logits')} AS lp FROM fx_logits",
        q="""SELECT list(m ORDER BY i) AS q FROM (SELECT i, avg(p) AS m FROM
        (SELECT unnest(list_transform(lp, lambda x: exp(x))) AS p, generate_subscripts(lp, 1) AS i FROM soft WHERE is_ref) GROUP BY i)""",
        body=f"""SELECT sample_id, 0 AS seq_id, '{label('renyi_fitted', temperature=1.0, alpha=0.5, mode='output')}' AS detector,
        {six_sql('-2 * ln(list_sum(list_transform(lp, lambda x, i: sqrt(exp(x) * q[i]))))')} AS score FROM soft, q""",
    ),
)
def det_renyi_fitted(spark, sf_dir):
    rows = V.logits(spark, sf_dir)
    return rounded(D.RenyiDataFitted().fit(rows.where("is_ref")).transform(rows), "score")


# --- detectors against reference rows ------------------------------------------------------------

COSINES_SQL = """SELECT a.sample_id, b.sample_id AS partner, list_cosine_similarity(a.features, b.features) AS c
    FROM fx_features a, fx_features b WHERE b.is_ref"""


@query("det_cosine", using("fx_features", body=f"SELECT sample_id, 0 AS seq_id, 'cosine' AS detector, {six_sql('max(c)')} AS score FROM ({COSINES_SQL}) GROUP BY sample_id"))
def det_cosine(spark, sf_dir):
    rows = V.features(spark, sf_dir)
    return rounded(D.CosineProjection().fit(rows.where("is_ref")).transform(rows), "score")


@query(
    "jn_nearest_ref",
    using("fx_features", body=f"""SELECT sample_id, place::INT AS place, partner, {six_sql('c')} AS score FROM
    (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY c DESC, partner) - 1 AS place FROM ({COSINES_SQL})) WHERE place < 3"""),
)
def jn_nearest_ref(spark, sf_dir):
    rows = V.features(spark, sf_dir)
    found = nearest(rows, rows.where("is_ref"), k=3)
    pairs = found.select("sample_id", F.posexplode(F.arrays_zip("partners", "scores")).alias("place", "_p"))
    return pairs.select("sample_id", "place", F.col("_p.partners").alias("partner"), six(F.col("_p.scores")).alias("score"))


DEPTH_DIRECTIONS = 32


def _uniform_sql(kind: str) -> str:
    return f"((('0x' || substr(md5(concat_ws(':', 42, k, i, '{kind}')), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


@query(
    "det_depth",
    using(
        "fx_features", "fx_elems",
        raw=f"""SELECT k, i, sqrt(-2 * ln({_uniform_sql('r')})) * cos(2 * pi() * {_uniform_sql('t')}) AS z
        FROM (SELECT unnest(range({DEPTH_DIRECTIONS})) AS k) a, (SELECT DISTINCT i FROM fx_elems) b""",
        unit="SELECT k, i, z / sqrt(sum(z * z) OVER (PARTITION BY k)) AS u FROM raw",
        proj="SELECT sample_id, is_ref, k, round(sum(v * u), 9) AS p FROM fx_elems JOIN unit USING (i) GROUP BY sample_id, is_ref, k",
        cdf="""SELECT sample_id, k, sum(is_ref::INT) OVER (PARTITION BY k ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        / (SELECT count(*) FROM fx_features WHERE is_ref) AS f FROM proj""",
        body=f"SELECT sample_id, 0 AS seq_id, 'depth' AS detector, {six_off_ties_sql('avg(least(f, 1 - f))')} AS score FROM cdf GROUP BY sample_id",
    ),
)
def det_depth(spark, sf_dir):
    rows = V.features(spark, sf_dir)
    depths = D.DataDepth(DEPTH_DIRECTIONS).fit(rows.where("is_ref")).transform(rows)
    return depths.withColumn("score", six_off_ties("score"))


# The inverse of the covariance by elimination, one column per step, on rows with the unit matrix beside them.
MAHALANOBIS_SQL = using(
    "fx_features", "fx_elems",
    ref="SELECT sample_id, label, i, v FROM fx_elems WHERE is_ref",
    m="SELECT label, i, avg(v) AS m FROM ref GROUP BY label, i",
    centred="SELECT sample_id, i, v - m AS d FROM ref JOIN m USING (label, i)",
    cov="SELECT a.i, b.i AS j, avg(a.d * b.d) AS c FROM centred a JOIN centred b USING (sample_id) GROUP BY a.i, b.i",
    beside="SELECT i, list_concat(list(c ORDER BY j), list(CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0 END ORDER BY j)) AS row FROM cov GROUP BY i",
    inv="""SELECT list(row ORDER BY i) AS a, 0 AS k FROM beside UNION ALL
    SELECT list_transform(a, lambda row, p: list_transform(row, lambda x, q: CASE WHEN p = k + 1 THEN x / row[k + 1]
      ELSE x - row[k + 1] * a[k + 1][q] / a[k + 1][k + 1] END)), k + 1 FROM inv WHERE k < len(a)""",
    precision_rows="SELECT list_transform(a, lambda row: row[len(a) + 1:]) AS p FROM inv WHERE k = len(a)",
    means="SELECT list(m ORDER BY i) AS mu FROM m GROUP BY label",
    off="SELECT sample_id, list_transform(features, lambda x, i: x - mu[i]) AS d FROM fx_features, means",
    body=f"""SELECT sample_id, 0 AS seq_id, 'mahalanobis' AS detector,
    {six_sql('min(list_dot_product(d, list_transform(p, lambda row: list_dot_product(row, d))))')} AS score
    FROM off, precision_rows GROUP BY sample_id""",
).replace("WITH ", "WITH RECURSIVE ", 1)


@query("det_mahalanobis", MAHALANOBIS_SQL)
def det_mahalanobis(spark, sf_dir):
    rows = V.features(spark, sf_dir)
    return rounded(D.Mahalanobis().fit(rows.where("is_ref")).transform(rows), "score")


FIT_GAUSSIAN_SQL = using(
    "fx_features", "fx_elems",
    ref="SELECT sample_id, label, i, v FROM fx_elems WHERE is_ref",
    m="SELECT label, i, avg(v) AS m FROM ref GROUP BY label, i",
    centred="SELECT sample_id, i, v - m AS d FROM ref JOIN m USING (label, i)",
    body=f"""SELECT 'mean' AS kind, label::VARCHAR AS label, i::BIGINT AS i, -1::BIGINT AS j, {six_sql('m')} AS value FROM m
    UNION ALL SELECT 'cov', 'all', a.i, b.i, {six_sql('avg(a.d * b.d)')} FROM centred a JOIN centred b USING (sample_id) GROUP BY a.i, b.i""",
)


def _fit_rows(spark, fit):
    means = [("mean", fit.labels[c], i, -1, float(v)) for c, row in enumerate(fit.means) for i, v in enumerate(row)]
    covariances = [("cov", "all", i, j, float(v)) for i, row in enumerate(fit.covariance) for j, v in enumerate(row)]
    return rounded(spark.createDataFrame(means + covariances, "kind string, label string, i long, j long, value double"), "value")


@query("agg_fit_class_gaussian", FIT_GAUSSIAN_SQL)
def agg_fit_class_gaussian(spark, sf_dir):
    return _fit_rows(spark, D.fit_gaussian(V.features(spark, sf_dir).where("is_ref")))


@query("agg_fit_accumulated", FIT_GAUSSIAN_SQL)
def agg_fit_accumulated(spark, sf_dir):
    """The same fit from statistics of five batches, one of which is given twice."""
    path = scratch_path(spark, "accumulated")
    rows = V.features(spark, sf_dir).where("is_ref")
    for batch in (0, 1, 2, 3, 4, 2):
        D.accumulate_gaussian(rows.where(F.pmod(F.col("sample_id"), F.lit(10)) == 2 * batch), path, batch)
    return _fit_rows(spark, D.merge_gaussian(spark, path))


@query("det_saved", MAHALANOBIS_SQL)
def det_saved(spark, sf_dir):
    """A detector fitted, saved, and loaded by another job for scoring."""
    rows, path = V.features(spark, sf_dir), scratch_path(spark, "detector")
    D.save_scorer(spark, D.Mahalanobis().fit(rows.where("is_ref")), path)
    return rounded(D.load_scorer(spark, path).transform(rows), "score")


@query("stream_upsert_scores", MAHALANOBIS_SQL)
def stream_upsert_scores(spark, sf_dir):
    """Scores of a stream of output files, upserted by sample: a file of wrong outputs comes first, and what it wrote is replaced."""
    rows, root = V.features(spark, sf_dir), scratch_path(spark, "stream")
    wrong = rows.where("sample_id % 5 = 0").withColumn("features", F.transform("features", lambda x: 2 * x))
    for part in (wrong, *(rows.where(F.pmod(F.col("sample_id"), F.lit(3)) == p) for p in range(3))):
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
    scorer = D.Mahalanobis().fit(rows.where("is_ref"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    upsert_stream(scorer.transform(stream), f"{root}/records", ["sample_id", "seq_id", "detector"], f"{root}/checkpoint").awaitTermination()
    return rounded(BucketedRecords(spark, f"{root}/records").read(), "score")


PROJECTION_SQL = "ln(list_dot_product(list_transform(a.lp, lambda x: exp(alpha * x)), list_transform(b.lp, lambda x: exp((1 - alpha) * x)))) / (alpha - 1)"
BEAM_GRID = ((0.5, 1.0), (0.5, 2.0), (2, 3))


@query(
    "det_beam_projection",
    using(
        "fx_beams",
        grid=f"SELECT * FROM (VALUES {', '.join(f'({t!r}::DOUBLE, {a!r}::DOUBLE)' for t, a in product(*BEAM_GRID[:2]))}) g(temperature, alpha)",
        soft=f"SELECT sample_id, seq_id, temperature, {log_softmax('logits', 'temperature')} AS lp FROM fx_beams, (SELECT DISTINCT temperature FROM grid)",
        pairs=f"""SELECT a.sample_id, a.seq_id, a.temperature, alpha, {PROJECTION_SQL} AS d,
        FROM soft a JOIN soft b ON a.sample_id = b.sample_id AND a.seq_id <> b.seq_id AND a.temperature = b.temperature
        JOIN grid g ON g.temperature = a.temperature""",
        ranked="SELECT *, row_number() OVER (PARTITION BY sample_id, seq_id, temperature, alpha ORDER BY d) AS rn FROM pairs",
        body=f"""SELECT sample_id, seq_id, 'beam_projection(temperature=' || temperature || ',alpha=' || alpha || ',n_neighbors=' || n || ')' AS detector,
        {six_sql('avg(d)')} AS score FROM ranked, (VALUES (2), (3)) k(n) WHERE rn <= n GROUP BY sample_id, seq_id, temperature, alpha, n""",
    ),
)
def det_beam_projection(spark, sf_dir):
    return rounded(D.BeamRenyiProjection(*BEAM_GRID).transform(V.beams(spark, sf_dir)), "score")


@query(
    "det_info_projection",
    using(
        "fx_logits",
        soft=f"SELECT sample_id, is_ref, {log_softmax('logits')} AS lp, 0.5 AS alpha FROM fx_logits",
        pairs=f"SELECT a.sample_id, {PROJECTION_SQL.replace('alpha', 'a.alpha')} AS d FROM soft a, soft b WHERE b.is_ref",
        ranked="SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY d) AS rn FROM pairs",
        body=f"""SELECT sample_id, 0 AS seq_id, '{label('info_projection', temperature=1.0, alpha=0.5, n_neighbors=8)}' AS detector,
        {six_sql('avg(d)')} AS score FROM ranked WHERE rn <= 8 GROUP BY sample_id""",
    ),
)
def det_info_projection(spark, sf_dir):
    rows = V.logits(spark, sf_dir)
    return rounded(D.InformationProjection().fit(rows.where("is_ref")).transform(rows), "score")


@query(
    "det_best_beam",
    using("fx_beams", body=f"""SELECT sample_id, arg_max(seq_id, likelihood) AS seq_id, 'best_beam+{label('msp', temperature=1.0, mode='output')}' AS detector,
    {six_sql(f"1 - exp(list_max({log_softmax('arg_max(logits, likelihood)')}))")} AS score FROM fx_beams GROUP BY sample_id"""),
)
def det_best_beam(spark, sf_dir):
    return rounded(D.BestBeam(D.MSP()).transform(V.beams(spark, sf_dir)), "score")


@query("det_fif")
def det_fif(spark, sf_dir):
    rows = V.token_scores(spark, sf_dir)
    forest = D.FunctionalIsolationForest().fit(rows.where("lang = 'en'"))
    return rounded(forest.transform(rows), "score")


# --- aggregates over scores ----------------------------------------------------------------------


@query(
    "agg_token_stats",
    using("fx_token_scores", body=f"""SELECT sample_id, seq_id, lang, {six_off_ties_sql('list_avg(token_scores)')} AS token_scores_mean,
    {six_off_ties_sql('list_stddev_pop(token_scores)')} AS token_scores_std FROM fx_token_scores"""),
)
def agg_token_stats(spark, sf_dir):
    stats = aggregates.token_stats(V.token_scores(spark, sf_dir))
    return stats.withColumns({c: six_off_ties(c) for c in ("token_scores_mean", "token_scores_std")})


PREDICTED_SQL = "SELECT *, (list_position(logits, list_max(logits)) - 1)::INT AS pred_label FROM fx_logits"


@query(
    "agg_accuracy",
    using("fx_logits", p=PREDICTED_SQL, body=f"""SELECT 'all' AS kind, -1 AS true_label, -1 AS pred_label, count(*) AS n, {six_sql('avg((pred_label = label)::INT)')} AS accuracy FROM p
    UNION ALL SELECT 'class', label, -1, count(*), {six_sql('avg((pred_label = label)::INT)')} FROM p GROUP BY label
    UNION ALL SELECT 'confusion', label, pred_label, count(*), (label = pred_label)::INT::DOUBLE FROM p GROUP BY label, pred_label"""),
)
def agg_accuracy(spark, sf_dir):
    rows = evaluation.predictions(V.logits(spark, sf_dir))
    every = F.lit(-1)
    overall = aggregates.accuracy(rows).select(
        F.lit("all").alias("kind"), every.alias("true_label"), every.alias("pred_label"), "n", six("accuracy").alias("accuracy")
    )
    classes = aggregates.accuracy(rows, by=("true_label",)).select(
        F.lit("class").alias("kind"), "true_label", every.alias("pred_label"), "n", six("accuracy").alias("accuracy")
    )
    pairs = aggregates.confusion(rows).select(
        F.lit("confusion").alias("kind"), "true_label", "pred_label", "n", (F.col("true_label") == F.col("pred_label")).cast("double").alias("accuracy")
    )
    return overall.unionByName(classes).unionByName(pairs)


def _rejection_sql(score: str) -> str:
    return using(
        "fx_logits", p=PREDICTED_SQL,
        s=f"SELECT (pred_label = label)::INT AS correct, {score} AS score FROM p",
        t="SELECT i / 100.0::DOUBLE AS rejection, q[i + 1] AS threshold FROM (SELECT quantile_cont(score, ["
        + ", ".join(f"{i / 100}" for i in range(100))
        + "]) AS q FROM s), (SELECT unnest(range(100)) AS i)",
        body=f"""SELECT round(rejection, 2) AS rejection, {six_sql('threshold')} AS threshold, count(score) AS n, {six_sql('avg(correct)')} AS perf
        FROM t LEFT JOIN s ON s.score > t.threshold GROUP BY rejection, threshold""",
    )


def _scored(spark, sf_dir, sign: float):
    """Accuracy of rows in and out of distribution; the score is the (signed) likelihood."""
    rows = evaluation.predictions(V.logits(spark, sf_dir))
    return rows.select(F.col("correct").cast("int").alias("correct"), (sign * F.col("likelihood")).alias("score"))


@query("agg_perf_vs_rejection", _rejection_sql(f"list_max({log_softmax('logits')})"))
def agg_perf_vs_rejection(spark, sf_dir):
    return rounded(perf_vs_rejection(_scored(spark, sf_dir, 1.0), "correct", "score"), "threshold", "perf")


@query("agg_perf_vs_rejection_negative", _rejection_sql(f"list_max({log_softmax('logits')})"))
def agg_perf_vs_rejection_negative(spark, sf_dir):
    return rounded(perf_vs_rejection(_scored(spark, sf_dir, -1.0), "correct", "score", sign=-1), "threshold", "perf")


@query(
    "jn_align",
    using("fx_beams", body=f"""SELECT sample_id, seq_id, '{label('msp', temperature=1.0, mode='output')}' AS detector, label, is_ood,
    {six_sql('likelihood')} AS likelihood, {six_sql(f"1 - exp(list_max({log_softmax('logits')}))")} AS score FROM fx_beams"""),
)
def jn_align(spark, sf_dir):
    rows = V.beams(spark, sf_dir)
    aligned = aggregates.align(D.MSP().transform(rows), rows.select("sample_id", "seq_id", "label", "is_ood", "likelihood"))
    return rounded(aligned, "score", "likelihood")


@query(
    "jn_experiments",
    """WITH s AS (SELECT lang, CASE WHEN quality = 1 THEN 'validation' ELSE 'test' END AS phase, d.n_chars FROM documents d JOIN labels USING (doc_id)),
    m AS (SELECT DISTINCT p.phase, a.lang AS dataset_in, b.lang AS dataset_out FROM (SELECT DISTINCT lang FROM documents) a,
      (SELECT DISTINCT lang FROM documents) b, (VALUES ('validation'), ('test')) p(phase) WHERE a.lang = b.lang OR p.phase = 'test')
    SELECT m.phase, dataset_in, dataset_out, count(*) AS n, sum(n_chars)::BIGINT AS total FROM m
    JOIN s ON s.phase = m.phase AND s.lang = m.dataset_out GROUP BY m.phase, dataset_in, dataset_out""",
)
def jn_experiments(spark, sf_dir):
    docs, labels = V.table(spark, sf_dir, "documents"), V.table(spark, sf_dir, "labels")
    names = docs.select(F.col("lang").alias("name"))
    phase = F.when(F.col("quality") == 1, "validation").otherwise("test")
    scores = docs.join(labels, "doc_id").select(phase.alias("phase"), F.col("lang").alias("dataset_out"), "n_chars")
    runs = tag_scores(scores, experiment_matrix(names, names))
    return runs.groupBy("phase", "dataset_in", "dataset_out").agg(F.count("*").alias("n"), F.sum("n_chars").alias("total"))


# --- task metrics --------------------------------------------------------------------------------

WORDS_SQL = r"list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')"
ROUGE_SQL = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"


def _mteval_sql(text: str) -> str:
    padded = f"' ' || {text} || ' '"
    for old, new in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        padded = f"replace({padded}, '{old}', '{new}')"
    for pattern, new in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
        (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ):
        padded = f"regexp_replace({padded}, '{pattern}', '{new}', 'g')"
    return WORDS_SQL.format(padded)


def _overlap_ctes(tokens, max_n: int) -> dict[str, str]:
    """tok, gram counts and m(sample_id, seq_id, hl, rl, m1 ... mn) over fx_hyps."""
    grams = (
        "SELECT sample_id, seq_id, n, array_to_string({0}[i:i + n - 1], ' ') AS gram, count(*) AS c FROM (SELECT *, unnest(range(1, len({0}) - n + 2)) AS i "
        f"FROM tok, (SELECT unnest(range(1, {max_n + 1})) AS n)) GROUP BY ALL"
    )
    sums = ", ".join(f"coalesce(sum(least(h.c, r.c)) FILTER (h.n = {n}), 0)::BIGINT AS m{n}" for n in range(1, max_n + 1))
    return {
        "tok": f"SELECT sample_id, seq_id, {tokens('hyp')} AS h, {tokens('ref')} AS r FROM fx_hyps",
        "hg": grams.format("h"),
        "rg": grams.format("r"),
        "hit": f"SELECT h.sample_id, h.seq_id, {sums} FROM hg h JOIN rg r USING (sample_id, seq_id, n, gram) GROUP BY h.sample_id, h.seq_id",
        "m": "SELECT t.sample_id, t.seq_id, len(h) AS hl, len(r) AS rl, " + ", ".join(f"coalesce(m{n}, 0) AS m{n}" for n in range(1, max_n + 1))
        + " FROM tok t LEFT JOIN hit USING (sample_id, seq_id)",
    }


def _bleu_terms(room, match) -> str:
    """Sum of log precisions over the orders that fit, missed orders smoothed by powers of two."""
    terms = []
    for n in range(1, 5):
        misses = " + ".join(f"({room(k)} > 0 AND {match(k)} = 0)::INT" for k in range(1, n + 1))
        terms.append(
            f"CASE WHEN {room(n)} <= 0 THEN 0 WHEN {match(n)} = 0 THEN ln(100.0 / (pow(2.0, {misses}) * {room(n)})) ELSE ln(100.0 * {match(n)} / {room(n)}) END"
        )
    return " + ".join(terms)


BREVITY_SQL = "CASE WHEN hl >= rl THEN 1.0 ELSE exp(1.0 - rl / hl) END"
SENTENCE_BLEU_SQL = f"""SELECT sample_id, seq_id, {six_sql(f'''CASE WHEN hl = 0 OR m1 + m2 + m3 + m4 = 0 THEN 0.0 ELSE
    {BREVITY_SQL} * exp(({_bleu_terms(lambda n: f'(hl - {n - 1})', lambda n: f'm{n}')}) / least(hl, 4)) END''')} AS bleu FROM m"""


@query("met_sentence_bleu", using("fx_hyps", **_overlap_ctes(WORDS_SQL.format, 4), body=SENTENCE_BLEU_SQL))
def met_sentence_bleu(spark, sf_dir):
    return rounded(metrics.sentence_bleu(V.hypotheses(spark, sf_dir), tokenizer=words), "bleu")


@query("met_sentence_bleu_13a", using("fx_hyps", **_overlap_ctes(_mteval_sql, 4), body=SENTENCE_BLEU_SQL))
def met_sentence_bleu_13a(spark, sf_dir):
    return rounded(metrics.sentence_bleu(V.hypotheses(spark, sf_dir)), "bleu")


@query(
    "met_corpus_bleu",
    using(
        "fx_hyps", **_overlap_ctes(_mteval_sql, 4),
        s="SELECT sum(hl)::BIGINT AS hl, sum(rl)::BIGINT AS rl, " + ", ".join(f"sum(m{n})::BIGINT AS m{n}, sum(greatest(hl - {n - 1}, 0))::BIGINT AS t{n}" for n in range(1, 5)) + " FROM m",
        body=f"""SELECT {six_sql(f"{BREVITY_SQL} * exp(({_bleu_terms(lambda n: f't{n}', lambda n: f'm{n}')}) / 4)")} AS bleu, hl AS hyp_len, rl AS ref_len FROM s""",
    ),
)
def met_corpus_bleu(spark, sf_dir):
    return rounded(metrics.corpus_bleu(V.hypotheses(spark, sf_dir)), "bleu")


def _rouge_columns(n: int) -> str:
    p, r = (f"CASE WHEN {s} >= {n} THEN m{n} / ({s} - {n - 1}) ELSE 0 END" for s in ("hl", "rl"))
    return f"""{six_sql(p)} AS rouge{n}_precision, {six_sql(r)} AS rouge{n}_recall,
    {six_sql(f'CASE WHEN m{n} > 0 THEN 2.0 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0 END')} AS rouge{n}_fmeasure"""


@query("met_rouge_n", using("fx_hyps", **_overlap_ctes(ROUGE_SQL.format, 2), body=f"SELECT sample_id, seq_id, {_rouge_columns(1)}, {_rouge_columns(2)} FROM m"))
def met_rouge_n(spark, sf_dir):
    scores = metrics.rouge_n(V.hypotheses(spark, sf_dir))
    return rounded(scores, *[c for c in scores.columns if c.startswith("rouge")])


STEM_SQL = "list_transform({}, lambda w: substr(w, 1, 4))"


@query(
    "met_rouge_n_stemmed",
    using("fx_hyps", **_overlap_ctes(lambda text: STEM_SQL.format(ROUGE_SQL.format(text)), 2), body=f"SELECT sample_id, seq_id, {_rouge_columns(1)}, {_rouge_columns(2)} FROM m"),
)
def met_rouge_n_stemmed(spark, sf_dir):
    """Stems are the first four letters, given as a table of all tokens."""
    pairs = V.hypotheses(spark, sf_dir)
    tokens = pairs.select(F.explode(F.array_union(metrics.rouge_words(F.col("hyp")), metrics.rouge_words(F.col("ref")))).alias("token")).distinct()
    stems = tokens.withColumn("stem", F.substring("token", 1, 4))
    scores = metrics.rouge_n(metrics.stemmed(metrics.rouge_words, pairs, stems, ["hyp", "ref"]))
    return rounded(scores, *[c for c in scores.columns if c.startswith("rouge")])


# Longest common subsequence: ends[k] is the least place of the hypothesis where a common subsequence of k tokens can end.
LCS_SQL = {
    "lcs": """SELECT sample_id, seq_id, h, r, 0 AS i, []::BIGINT[] AS ends FROM tok
    UNION ALL
    SELECT sample_id, seq_id, h, r, i + 1, list_filter(list_transform(range(1, len(ends) + 2), lambda k: least(coalesce(ends[k], 1000000000),
      coalesce(list_min(list_filter(places, lambda p: p > coalesce(ends[k - 1], 0))), 1000000000))), lambda e: e < 1000000000)
    FROM (SELECT *, list_filter(range(1, len(h) + 1), lambda p: h[p] = r[i + 1]) AS places FROM lcs WHERE i < len(r))""",
    "m": "SELECT sample_id, seq_id, len(h) AS hl, len(r) AS rl, len(ends) AS m1 FROM lcs WHERE i = len(r)",
}


def _lcs_sql(body: str) -> str:
    sql = using("fx_hyps", tok=_overlap_ctes(ROUGE_SQL.format, 1)["tok"], **LCS_SQL, body=body)
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("met_rouge_l", _lcs_sql("SELECT sample_id, seq_id, " + _rouge_columns(1).replace("rouge1", "rougeL") + " FROM m"))
def met_rouge_l(spark, sf_dir):
    scores = metrics.rouge_l(V.hypotheses(spark, sf_dir))
    return rounded(scores, *[c for c in scores.columns if c.startswith("rouge")])


@query("met_rouge_lsum")
def met_rouge_lsum(spark, sf_dir):
    scores = metrics.rouge_lsum(V.hypotheses(spark, sf_dir))
    return rounded(scores, *[c for c in scores.columns if c.startswith("rouge")])


@query("met_corpus_rouge")
def met_corpus_rouge(spark, sf_dir):
    return rounded(metrics.corpus_rouge(V.hypotheses(spark, sf_dir)), "rouge1", "rouge2", "rougeL", "rougeLsum")


BASELINE = 0.05


@query(
    "met_bert_greedy",
    using(
        "fx_features",
        t="SELECT sample_id // 10 AS pair_id, sample_id % 2 = 0 AS is_hyp, sample_id, features FROM fx_features",
        c="""SELECT h.pair_id, h.sample_id AS hyp_id, r.sample_id AS ref_id, list_cosine_similarity(h.features, r.features) AS c
        FROM t h JOIN t r ON h.pair_id = r.pair_id AND h.is_hyp AND NOT r.is_hyp""",
        p="SELECT pair_id, avg(b) AS p FROM (SELECT pair_id, hyp_id, max(c) AS b FROM c GROUP BY pair_id, hyp_id) GROUP BY pair_id",
        r="SELECT pair_id, avg(b) AS r FROM (SELECT pair_id, ref_id, max(c) AS b FROM c GROUP BY pair_id, ref_id) GROUP BY pair_id",
        body=f"""SELECT pair_id, {six_sql(f'(p - {BASELINE}) / (1 - {BASELINE})')} AS precision, {six_sql(f'(r - {BASELINE}) / (1 - {BASELINE})')} AS recall,
        {six_sql(f'(2 * p * r / (p + r) - {BASELINE}) / (1 - {BASELINE})')} AS f1 FROM p JOIN r USING (pair_id)""",
    ),
)
def met_bert_greedy(spark, sf_dir):
    return rounded(metrics.bert_greedy(V.token_vectors(spark, sf_dir), BASELINE), "precision", "recall", "f1")


@query(
    "met_per_generation",
    using("fx_hyps", **_overlap_ctes(ROUGE_SQL.format, 1), body="""SELECT sample_id, string_agg(hl, ',' ORDER BY seq_id) AS hyp_len,
    string_agg(m1, ',' ORDER BY seq_id) AS match_1 FROM m GROUP BY sample_id"""),
)
def met_per_generation(spark, sf_dir):
    scores = metrics.ngram_overlap(V.hypotheses(spark, sf_dir), metrics.rouge_words, 1)
    lists = aggregates.per_generation(scores, ("hyp_len", "match_1"))
    return lists.select("sample_id", F.array_join("hyp_len", ",").alias("hyp_len"), F.array_join("match_1", ",").alias("match_1"))


# --- whole evaluations ---------------------------------------------------------------------------


def _tagged(rows):
    """Reference rows are the validation run, the others the test runs in and out of distribution."""
    return rows.withColumns(
        {
            "phase": F.when(F.col("is_ref"), "validation").otherwise("test"),
            "dataset_out": F.when(F.col("is_ood"), "out").otherwise("in"),
        }
    )


def _flat(records, scorers, *numbers):
    """One column per detector instead of the map."""
    names = [n for s in scorers for n in s.score_names]
    wide = records.select(*[c for c in records.columns if c != "scores"], *[six(F.col("scores")[n]).alias(n) for n in names])
    return rounded(wide, *numbers)


@query("flow_classification")
def flow_classification(spark, sf_dir):
    features, logits = V.features(spark, sf_dir), V.logits(spark, sf_dir).select("sample_id", "logits")
    outputs = _tagged(features.join(logits, "sample_id"))
    scorers = [D.Mahalanobis(), D.CosineProjection(), D.DataDepth(DEPTH_DIRECTIONS), D.MSP(), D.Energy()]
    return _flat(evaluation.evaluate_classification(outputs, scorers, "in", "org/model", seed=42), scorers, "likelihood")


FLOW_DRAWN_SQL = """SELECT h.sample_id, h.seq_id, l.label, l.is_ood, l.is_ref, l.logits, list_max(l.logits) AS likelihood
    FROM fx_hyps h JOIN fx_logits l ON l.sample_id = (h.sample_id * 4 + h.seq_id) % (SELECT count(*) FROM fx_logits)"""


@query(
    "flow_generation",
    using(
        "fx_hyps", "fx_logits", **_overlap_ctes(_mteval_sql, 4),
        bleu=SENTENCE_BLEU_SQL,
        drawn=FLOW_DRAWN_SQL,
        soft=f"SELECT *, {log_softmax('logits')} AS lp, 0.5 AS alpha FROM drawn",
        pairs=f"""SELECT a.sample_id, a.seq_id, {PROJECTION_SQL.replace('alpha', 'a.alpha')} AS d,
        FROM soft a JOIN soft b ON a.sample_id = b.sample_id AND a.seq_id <> b.seq_id""",
        ranked="SELECT *, row_number() OVER (PARTITION BY sample_id, seq_id ORDER BY d) AS rn FROM pairs",
        beam="SELECT sample_id, seq_id, avg(d) AS d FROM ranked WHERE rn <= 2 GROUP BY sample_id, seq_id",
        body=f"""SELECT sample_id, seq_id, CASE WHEN is_ref THEN 'validation' ELSE 'test' END AS phase,
        CASE WHEN is_ood THEN 'out' ELSE 'in' END AS dataset_out, {six_sql('likelihood')} AS likelihood, bleu,
        'org/model' AS model, 'in' AS dataset_in, 42 AS seed,
        {six_sql('ln(len(lp)) - 2 * ln(list_sum(list_transform(lp, lambda x: exp(x / 2))))')} AS "{label('renyi', temperature=1.0, alpha=0.5, mode='output')}",
        {six_sql('ln(len(lp)) + ln(list_sum(list_transform(lp, lambda x: exp(2 * x))))')} AS "{label('renyi', temperature=1.0, alpha=2.0, mode='output')}",
        {six_sql('1 - exp(list_max(lp))')} AS "{label('msp', temperature=1.0, mode='output')}",
        {six_sql('lp[1] - logits[1]')} AS "{label('energy', temperature=1.0, mode='output')}",
        {six_sql('d')} AS "{label('beam_projection', temperature=1.0, alpha=0.5, n_neighbors=2)}"
        FROM soft JOIN bleu USING (sample_id, seq_id) JOIN beam USING (sample_id, seq_id)""",
    ),
)
def flow_generation(spark, sf_dir):
    turns = V.hypotheses(spark, sf_dir)
    # Sequences of a turn get the logits of the embedding with the turn's number.
    logits = V.logits(spark, sf_dir)
    n = logits.agg(F.count("*")).scalar()
    keyed = turns.withColumn("_row", (F.col("sample_id") * 4 + F.col("seq_id")) % n)
    drawn = keyed.join(logits.withColumnRenamed("sample_id", "_row"), "_row").withColumn("likelihood", F.array_max("logits"))
    outputs = _tagged(drawn)
    scorers = [D.RenyiNeg((1.0,), (0.5, 2.0)), D.MSP(), D.Energy(), D.BeamRenyiProjection((1.0,), (0.5,), (2,))]
    records = evaluation.evaluate_generation(outputs, scorers, [metrics.sentence_bleu], "in", "org/model", seed=42)
    return _flat(records.drop("hyp", "ref"), scorers, "likelihood", "bleu")


@query("flow_aggregate_keys")
def flow_aggregate_keys(spark, sf_dir):
    """Three token scorers in one table, told apart by their keys, and one that is not asked for."""
    rows = V.token_scores(spark, sf_dir)
    # Keys and factors only are copied per scorer; scores are made for the rows that are asked for.
    scaled = F.explode(F.array(*[
        F.struct(F.lit(f"{name}(mode={mode})").alias("detector"), F.lit(factor).alias("factor"))
        for name, mode, factor in (("one", "token", 1.0), ("two", "token", -2.0), ("three", "token", 0.5), ("four", "output", 1.0))
    ]))
    scores = F.transform("token_scores", lambda x: x * F.col("_d.factor"))
    long = rows.select("*", scaled.alias("_d")).select(*[c for c in rows.columns if c != "token_scores"], "_d.detector", scores.alias("token_scores"))
    result = evaluation.aggregate_token_records(long.where("lang = 'en'"), long)
    return rounded(result, "token_scores_mean", "token_scores_std", "fif_token_scores")


@query("flow_aggregate")
def flow_aggregate(spark, sf_dir):
    rows = V.token_scores(spark, sf_dir)
    result = evaluation.aggregate_records(rows.where("lang = 'en'"), rows)
    return rounded(result, "token_scores_mean", "token_scores_std", "fif_token_scores")
