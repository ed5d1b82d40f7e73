"""Registered queries for learning, scoring and reports."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens.catalog.encode import capture_blobs
from trafficlens.catalog.feature_oracles import on_packets
from trafficlens.catalog.fixture import numbered_packets, packets, table
from trafficlens.catalog.shape import rounded
from trafficlens.learning import evaluate, models, prepare
from trafficlens.operators import assemble, counted, lengths
from trafficlens.plans import reports, scoring, training
from trafficlens.session import fresh_path, store
from trafficlens.settings import ModelSettings
from trafficlens.sources import captures, sinks

E = ["capture_file"]
W = ["capture_file", "window_id"]
TIE = ["packet_id"]
LIVE = 50
SEED = 42

FOREST = ModelSettings()
BOOSTED = ModelSettings(model_type="boosted_trees")
NETWORK = ModelSettings(model_type="neural_network")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled feature rows of 50-packet windows, stored: models read them many times."""
    return store(assemble.window_features(numbered_packets(spark, sf_dir), LIVE), "windows")


def flow_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small labelled table per window for checks that need no model."""
    numbered = numbered_packets(spark, sf_dir).withColumn("window_id", F.floor(F.col("packet_no") / LIVE))
    return numbered.groupBy(*W, "label").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("packet_length").alias("len_mean"),
        F.avg("ttl").alias("ttl_mean"),
        F.avg(F.when(F.col("tcp_flags") == "S", 1.0).when(F.col("tcp_flags").isNotNull(), 0.0)).alias("syn_share"),
        F.avg((F.col("protocol") == 6).cast("double")).alias("tcp_share"),
        F.max(F.lit(7.0)).alias("constant"),
    )


MEASURES = ("len_mean", "ttl_mean", "syn_share", "tcp_share", "constant")


def with_verdict(df: DataFrame) -> DataFrame:
    """Rule-based verdict: mostly bare SYN packets."""
    return df.withColumn("prediction", F.when(F.col("syn_share") > 0.5, "ddos").otherwise("normal"))


# Without a model.


def align_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training order, missing features 0, extra ones dropped, names from value maps."""
    p = packets(spark, sf_dir)
    ttl = counted.ttl_stats(p, E)
    from trafficlens.operators.statistical import ratio_maps

    rows = ttl.join(ratio_maps(p, E), E)
    names = ["ttl_max", "syn_ratio", "ttl_mean", "protocol_6_ratio", "protocol_99_ratio", "http_method_GET_ratio"]
    return rounded(prepare.align(rows, names, E))


def scaled(method: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = flow_windows(spark, sf_dir)
        vectors = VectorAssembler(inputCols=list(MEASURES), outputCol="raw").transform(rows)
        out = prepare.make_scaler(method, "raw", "scaled").fit(vectors).transform(vectors)
        values = vector_to_array("scaled")
        return rounded(out.select(*W, *[values[i].alias(m) for i, m in enumerate(MEASURES)]))

    return query


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(prepare.class_weights(packets(spark, sf_dir)))


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir).select("packet_id", "label")
    return prepare.with_split(p, F.col("packet_id"), test_size=0.2, seed=SEED)


def cv_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir).select("packet_id", "label")
    return prepare.with_folds(p, F.col("packet_id"), folds=5, seed=SEED)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels")


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion_matrix(_labels(spark, sf_dir), "quality", "toxic")


def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.class_report(evaluate.confusion_matrix(with_verdict(flow_windows(spark, sf_dir)))))


def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.class_metrics(evaluate.confusion_matrix(with_verdict(flow_windows(spark, sf_dir)))))


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class 1 is ``normal``; the score is rounded so that many rows tie."""
    rows = flow_windows(spark, sf_dir)
    score = F.round(1 - F.col("len_mean") / 1000, 2) - F.round(F.col("syn_share"), 1)
    area = evaluate.roc_auc(rows, F.col("label") == "normal", score)
    return rounded(spark.range(1).select(F.lit(area).alias("roc_auc")))


def variance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the columns whose variance exceeds 0.01."""
    rows = flow_windows(spark, sf_dir)
    kept = prepare.variance_filter(rows, MEASURES, 0.01)
    return spark.createDataFrame([(c,) for c in kept], T.StructType([T.StructField("feature", T.StringType())]))


def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.distribution(with_verdict(flow_windows(spark, sf_dir)))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule-based result rows per capture; captures of every seventh day failed."""
    day = F.substring("capture_file", 5, 2).cast("int")
    rows = packets(spark, sf_dir).groupBy(*E).agg(
        F.avg(F.when(F.col("tcp_flags") == "S", 1.0).when(F.col("tcp_flags").isNotNull(), 0.0)).alias("syn_share"),
        F.avg("packet_length").alias("mean"),
    )
    failed = day % 7 == 0
    return with_verdict(rows).select(
        F.col("capture_file").alias("file_name"),
        F.when(~failed, F.col("prediction")).alias("prediction"),
        F.when(~failed, F.col("mean") / 1000).alias("probability"),
        F.when(failed, "broken").alias("error"),
    )


def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.report_summary(results(spark, sf_dir)))


def broken_files(numbered: DataFrame) -> DataFrame:
    """Capture files of the packets; some are no captures and some end in the middle of a packet."""
    day = F.regexp_extract("path", r"cap_(\d+)", 1).cast("int")
    body = F.col("content")
    few = F.substring(body, F.lit(1), F.lit(24 + 16))  # the header and a record without its bytes
    text = F.encode(F.lit("no capture"), "utf-8")
    content = F.when(day % 5 == 0, text).when(day % 7 == 0, few).otherwise(body)
    return capture_blobs(numbered).withColumn("content", content)


def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every capture of a batch: decoded, cut short, or no capture at all."""
    files = broken_files(numbered_packets(spark, sf_dir))
    status = captures.status_of_pieces(captures.pieces_of_contents(files))
    counts = lengths.basic_counts(captures.packets_of_contents(files), E)
    return status.join(counts, E, "left").select(
        *E, "status", F.coalesce(F.col("total_packets"), F.lit(0)).alias("total_packets"), "error"
    )


def prob_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.histogram(flow_windows(spark, sf_dir), "len_mean"))


def prob_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.density(flow_windows(spark, sf_dir), "len_mean"))


def window_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_verdict(flow_windows(spark, sf_dir)).withColumnRenamed("n", "packet_count")
    return rounded(reports.window_summary(rows, LIVE))


# With a model.


def predictions(settings: ModelSettings):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        features = windows(spark, sf_dir)
        model = models.train(features, settings, W, stored=True)
        # A fifth of the windows was held out of the training.
        return model.predict(features, [*W, "label", "status"]).select(*W, "label", "status", "prediction")

    return query


def metric_rows(spark: SparkSession, found: dict[str, dict[str, float]]) -> DataFrame:
    rows = [(part, m, float(v)) for part, values in found.items() for m, v in values.items()]
    return spark.createDataFrame(rows, "part string, metric string, value double")


def train_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_rows(spark, models.train(windows(spark, sf_dir), FOREST, W, stored=True).metrics)


def evaluate_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Save, load, evaluate: the loaded model gives the metrics and the scores of the one that was saved."""
    features = windows(spark, sf_dir)
    model = models.train(features, FOREST, W, stored=True)
    loaded = models.TrafficModel.load(model.save(fresh_path(spark, "model")))
    before, after = (m.predict(features, W).select(*W, F.col("p_ddos").alias(name)) for m, name in ((model, "a"), (loaded, "b")))
    apart = before.join(after, W).agg(F.coalesce(F.max(F.abs(F.col("a") - F.col("b"))), F.lit(0.0)).alias("x")).first()["x"]
    found = {"saved": model.evaluate(features), "loaded": loaded.evaluate(features), "apart": {"p_ddos": apart}}
    return metric_rows(spark, found)


def importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = models.train(windows(spark, sf_dir), FOREST, W, stored=True)
    return model.importances(spark, 20)


def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.cv_summary(models.cross_validate(windows(spark, sf_dir), FOREST, W))


def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = {"n_estimators": [5, 10], "max_depth": [4, 8]}
    settings = replace(FOREST, cv_folds=3)
    return models.grid_search(windows(spark, sf_dir), grid, settings, W)[3]


def train_from_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two labelled feature tables stacked and trained on; the verdicts of the model that comes of it."""
    features = windows(spark, sf_dir)
    parts = [(features.where(F.col("label") == c).drop("label"), c) for c in ("normal", "ddos")]
    result = training.train_from_features(parts, FOREST, W)
    return result.model.predict(features, [*W, "label", "status"]).select(*W, "label", "status", "prediction")


def training_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw folders to metrics: landed packets of normal and of attack captures, features, model, saved."""
    p = numbered_packets(spark, sf_dir)
    folders = [
        {"folder": sinks.write_packets(p.where(F.col("label") == c).drop("label"), fresh_path(spark, c)), "label": c}
        for c in ("normal", "ddos")
    ]
    return metric_rows(spark, training.run_training(spark, folders, fresh_path(spark, "model"), None, FOREST).metrics)


def _capture_model(spark: SparkSession, sf_dir: str) -> models.TrafficModel:
    return models.train(windows(spark, sf_dir), FOREST, W, stored=True)


def score_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every capture, and of two of them scored on their own."""
    model = _capture_model(spark, sf_dir)
    p = store(packets(spark, sf_dir), "packets")
    scored = scoring.score_captures(model, p, tie=TIE)
    alone = [scoring.score_capture(model, p, f"cap_{day}.pcap", tie=TIE) for day in ("03", "04")]
    alone = alone[0].union(alone[1]).select("file_name", F.col("prediction").alias("alone"))
    return scored.join(alone, "file_name", "left").select("file_name", "status", "prediction", "alone")


def score_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture files to verdicts; files that are cut short or no captures keep an error row."""
    features = windows(spark, sf_dir)
    files = store(broken_files(numbered_packets(spark, sf_dir)), "files")
    status = captures.status_of_pieces(captures.pieces_of_contents(files))
    if features.where(F.col("status") == assemble.STATUS_OK).isEmpty():
        # Files begin with a window, so none has enough packets either: there is no model, and no verdict that needs one.
        few = F.when(F.col("status") == "error", "error").otherwise(assemble.STATUS_FEW).alias("status")
        return status.select(F.col("capture_file").alias("file_name"), few, F.lit(None).cast("string").alias("prediction"), "error")
    model = models.train(features, FOREST, W, stored=True)
    decoded = store(captures.packets_of_contents(files), "packets")
    # A file of too few packets is whole: its status says why it has no verdict, and it has no error.
    error = F.when(F.col("status") == "error", F.col("error")).alias("error")
    return scoring.score_captures(model, decoded, status).select("file_name", "status", "prediction", error)


def window_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _capture_model(spark, sf_dir)
    return scoring.score_windows(model, numbered_packets(spark, sf_dir), LIVE).drop("probability")


def window_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _capture_model(spark, sf_dir)
    return rounded(scoring.analyze_windows(model, numbered_packets(spark, sf_dir), LIVE)[1])


QUERIES = {
    "align_features": align_features,
    "scale_standard": scaled("standard_scaler"),
    "scale_minmax": scaled("minmax_scaler"),
    "class_weights": class_weights,
    "stratified_split": stratified_split,
    "cv_folds": cv_folds,
    "confusion_matrix": confusion_matrix,
    "class_report": class_report,
    "class_metrics": class_metrics,
    "roc_auc": roc_auc,
    "variance_filter": variance_filter,
    "class_distribution": class_distribution,
    "report_summary": report_summary,
    "batch_status": batch_status,
    "prob_histogram": prob_histogram,
    "prob_density": prob_density,
    "window_summary": window_summary,
    "rf_predictions": predictions(FOREST),
    "gbt_predictions": predictions(BOOSTED),
    "mlp_predictions": predictions(NETWORK),
    "train_metrics": train_metrics,
    "evaluate_saved": evaluate_saved,
    "feature_importances": importances,
    "cross_validation": cross_validation,
    "grid_search": grid_search,
    "train_from_features": train_from_features,
    "training_run": training_run,
    "score_capture": score_capture,
    "score_batch": score_batch,
    "window_verdicts": window_verdicts,
    "window_analysis": window_analysis,
}

SYN = "avg(case when tcp_flags = 'S' then 1e0 when tcp_flags is not null then 0e0 end)"
WINDOWS = f"""win as (
  select capture_file, packet_no // 50 as window_id, min(label) as label, count(*) as n,
    avg(packet_length) as len_mean, avg(ttl) as ttl_mean, {SYN} as syn_share,
    avg(case when protocol = 6 then 1e0 else 0e0 end) as tcp_share, 7e0 as constant
  from numbered group by capture_file, packet_no // 50),
judged as (select *, case when syn_share > 0.5 then 'ddos' else 'normal' end as prediction from win)"""
REPORT = """sums as (
  select class, sum(support) as support, sum(predicted) as predicted, sum(hits) as hits from (
    select label as class, count(*) as support, 0 as predicted,
      count(*) filter (where label = prediction) as hits from judged group by 1
    union all select prediction, 0, count(*), 0 from judged group by 1) group by class),
report as (
  select class, hits / predicted as precision, hits / support as recall, 2 * hits / (support + predicted) as f1,
    cast(support as bigint) as support from sums)"""
HASHED = """hashed as (select packet_id, label, md5(concat('42:', packet_id)) as h from packets)"""

ORACLES = {
    "align_features": on_packets(
        """select capture_file, cast(max(ttl) as double) as ttl_max, 0e0 as syn_ratio, round(avg(ttl), 6) as ttl_mean,
             round(avg(case when protocol = 6 then 1e0 else 0e0 end), 6) as protocol_6_ratio, 0e0 as protocol_99_ratio,
             round(coalesce(avg(case when http_method = 'GET' then 1e0 when http_method is not null then 0e0 end), 0), 6) as http_method_GET_ratio
           from packets group by capture_file"""
    ),
    "scale_standard": on_packets(
        "select capture_file, window_id, "
        + ", ".join(
            f"round(case when stddev_pop({m}) over () > 0 then ({m} - avg({m}) over ()) / stddev_pop({m}) over () else 0 end, 6) as {m}"
            for m in MEASURES
        )
        + " from win",
        WINDOWS,
    ),
    "scale_minmax": on_packets(
        "select capture_file, window_id, "
        + ", ".join(
            f"round(case when max({m}) over () > min({m}) over () then ({m} - min({m}) over ()) / (max({m}) over () - min({m}) over ()) else 0 end, 6) as {m}"
            for m in MEASURES
        )
        + " from win",
        WINDOWS,
    ),
    "class_weights": on_packets(
        """select label, count(*) as count, round((select count(*) from packets) /
             ((select count(distinct label) from packets) * count(*)), 6) as weight from packets group by label"""
    ),
    "stratified_split": on_packets(
        """select packet_id, label, case when percent_rank() over (partition by label order by h) < 0.8
             then 'train' else 'eval' end as part from hashed""",
        HASHED,
    ),
    "cv_folds": on_packets(
        """select packet_id, label, cast((row_number() over (partition by label order by h) - 1) % 5 as int) as fold
           from hashed""",
        HASHED,
    ),
    "confusion_matrix": "select quality as truth, toxic as prediction, count(*) as count from labels group by all",
    "class_report": on_packets(
        """select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support
           from report""",
        WINDOWS,
        REPORT,
    ),
    "class_metrics": on_packets(
        """select (select round(avg(case when label = prediction then 1e0 else 0e0 end), 6) from judged) as accuracy,
             round(sum(precision * support) / sum(support), 6) as precision,
             round(sum(recall * support) / sum(support), 6) as recall,
             round(sum(f1 * support) / sum(support), 6) as f1 from report""",
        WINDOWS,
        REPORT,
    ),
    "roc_auc": on_packets(
        """select round((sum(case when label = 'normal' then r end) - max(np) * (max(np) + 1) / 2) / (max(np) * max(nn)), 6)
             as roc_auc from (
             select label, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0e0 as r,
               count(*) filter (where label = 'normal') over () as np, count(*) filter (where label <> 'normal') over () as nn
             from scores)""",
        WINDOWS,
        "scores as (select label, round(1 - len_mean / 1000, 2) - round(syn_share, 1) as s from win)",
    ),
    "variance_filter": on_packets(
        "select feature from ("
        + " union all ".join(f"select '{m}' as feature, var_samp({m}) as v from win" for m in MEASURES)
        + ") where v > 0.01",
        WINDOWS,
    ),
    "train_from_features": on_packets("select label, count(*) as count from win group by label", WINDOWS),
    "class_distribution": on_packets(
        "select prediction, count(*) as count from judged group by prediction", WINDOWS
    ),
    "report_summary": on_packets(
        """select count(*) as total_files, count(*) filter (where p = 'normal') as normal_count,
             count(*) filter (where p = 'ddos') as ddos_count, count(*) filter (where p is null) as error_count,
             round(count(*) filter (where p = 'normal') / count(*) * 100, 6) as normal_percentage,
             round(count(*) filter (where p = 'ddos') / count(*) * 100, 6) as ddos_percentage,
             round(count(*) filter (where p is null) / count(*) * 100, 6) as error_percentage from verdicts""",
        f"""verdicts as (select capture_file, case when cast(substr(capture_file, 5, 2) as int) % 7 <> 0
              then case when {SYN} > 0.5 then 'ddos' else 'normal' end end as p from packets group by capture_file)""",
    ),
    "batch_status": on_packets(
        """select lpad(cast(packet_no // 1000 as varchar), 9, '0') || '_' || capture_file as capture_file,
             case when d % 5 = 0 or d % 7 = 0 then 'error' else 'ok' end as status,
             case when d % 5 = 0 or d % 7 = 0 then 0 else count(*) end as total_packets,
             case when d % 5 = 0 then 'not a capture file: unknown magic number'
               when d % 7 = 0 then 'the capture is cut short in the middle of a packet' end as error
           from (select *, cast(substr(capture_file, 5, 2) as int) as d from numbered)
           group by capture_file, packet_no // 1000, d"""
    ),
    "prob_histogram": on_packets(
        """select cast(b as int) as bin, round(mn + (b - 1) * (mx - mn) / 10, 6) as low,
             round(mn + b * (mx - mn) / 10, 6) as high, coalesce(c, 0) as count
           from lim, range(1, 11) t(b) left join (
             select case when len_mean >= mx then 10 else 1 + floor((len_mean - mn) / ((mx - mn) / 10)) end as bin,
               count(*) as c from win, lim group by 1) h on h.bin = b""",
        WINDOWS,
        "lim as (select min(len_mean) as mn, max(len_mean) as mx from win)",
    ),
    "prob_density": on_packets(
        """select cast(i as int) as point, round(any_value(mn + i * (mx - mn) / 199), 6) as x,
             round(sum(exp(-0.5 * pow((len_mean - (mn + i * (mx - mn) / 199)) / h, 2))) / (any_value(m) * any_value(h) * sqrt(2 * pi())), 6) as density
           from win, lim, range(200) t(i) group by i""",
        WINDOWS,
        """lim as (select min(len_mean) as mn, max(len_mean) as mx, count(*) as m,
             stddev_samp(len_mean) * pow(count(*), -0.2) as h from win)""",
    ),
    "window_summary": on_packets(
        """select capture_file as file_name, cast(sum(n) as bigint) as total_packets, 50 as window_size,
             count(*) as window_count, count(*) filter (where prediction = 'normal') as normal_windows,
             count(*) filter (where prediction = 'ddos') as ddos_windows,
             round(count(*) filter (where prediction = 'normal') / count(*) * 100, 6) as normal_percentage,
             round(count(*) filter (where prediction = 'ddos') / count(*) * 100, 6) as ddos_percentage
           from judged group by capture_file""",
        WINDOWS,
    ),
}

# The attack windows differ in several features, so a learner that works tells them apart without an error.
VERDICTS = """select capture_file, packet_no // 50 as window_id, min(label) as label,
  case when count(*) >= 10 then 'ok' else 'too_few_packets' end as status,
  case when count(*) >= 10 then min(label) end as prediction from numbered group by all"""
VERDICT_ROWS = """select capture_file, packet_no // 50 as window_id, min(packet_no) // 50 * 50 as window_start,
  min(packet_no) // 50 * 50 + count(*) as window_end, count(*) as packet_count,
  case when count(*) >= 10 then 'ok' else 'too_few_packets' end as status,
  case when count(*) >= 10 then min(label) end as prediction from numbered group by capture_file, packet_no // 50"""
METRICS = "(values ('accuracy'), ('precision'), ('recall'), ('f1'), ('roc_auc')) m(metric)"
PERFECT = f"select part, metric, 1e0 as value from (values ('train'), ('eval')) p(part), {METRICS}"

ORACLES |= {
    **{name: on_packets(VERDICTS) for name in ("rf_predictions", "gbt_predictions", "mlp_predictions", "train_from_features")},
    "train_metrics": PERFECT,
    "training_run": PERFECT,
    "evaluate_saved": PERFECT.replace("('train'), ('eval')", "('saved'), ('loaded')") + " union all select 'apart', 'p_ddos', 0e0",
    "cross_validation": f"select metric, 1e0 as mean, 0e0 as std, cast(5 as bigint) as folds from {METRICS}",
    "score_capture": on_packets(
        """select capture_file as file_name, case when count(*) >= 10 then 'ok' else 'too_few_packets' end as status,
             case when count(*) >= 10 then min(label) end as prediction,
             case when capture_file in ('cap_03.pcap', 'cap_04.pcap') and count(*) >= 10 then min(label) end as alone
           from packets group by capture_file"""
    ),
    "score_batch": on_packets(
        """select lpad(cast(packet_no // 1000 as varchar), 9, '0') || '_' || capture_file as file_name,
             case when d % 5 = 0 or d % 7 = 0 then 'error' when count(*) >= 10 then 'ok' else 'too_few_packets' end as status,
             case when d % 5 <> 0 and d % 7 <> 0 and count(*) >= 10 then min(label) end as prediction,
             case when d % 5 = 0 then 'not a capture file: unknown magic number'
               when d % 7 = 0 then 'the capture is cut short in the middle of a packet' end as error
           from (select *, cast(substr(capture_file, 5, 2) as int) as d from numbered)
           group by capture_file, packet_no // 1000, d"""
    ),
    "window_verdicts": on_packets(VERDICT_ROWS),
    "window_analysis": on_packets(
        """select capture_file as file_name, cast(sum(packet_count) as bigint) as total_packets, 50 as window_size,
             count(*) as window_count, count(*) filter (where prediction = 'normal') as normal_windows,
             count(*) filter (where prediction = 'ddos') as ddos_windows,
             round(count(*) filter (where prediction = 'normal') / count(*) * 100, 6) as normal_percentage,
             round(count(*) filter (where prediction = 'ddos') / count(*) * 100, 6) as ddos_percentage
           from verdicts group by capture_file""",
        f"verdicts as ({VERDICT_ROWS})",
    ),
}
