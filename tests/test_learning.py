from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F
from test_features import START, frame, packet

from trafficlens.learning import evaluate, models, prepare
from trafficlens.operators.assemble import extract_features
from trafficlens.plans import reports, scoring, training
from trafficlens.settings import ModelSettings
from trafficlens.sources import sinks, tables

FOREST = models.with_params(ModelSettings(), n_estimators=5, max_depth=4)


def traffic(captures=24, seed=1):
    """Normal captures mix flags and hosts; attack captures send bare SYNs to one host."""
    r = random.Random(seed)
    out = []
    for c in range(captures):
        attack, name = c % 3 == 0, f"cap_{c:02d}.pcap"
        ts = 0
        for no in range(30):
            ts += r.randint(1, 200) if attack else r.randint(1000, 90_000)
            out.append(packet(
                name, no, ts, ip_src=f"10.0.{r.randint(0, 9)}.{r.randint(0, 9)}" if attack else f"10.0.0.{r.randint(1, 3)}",
                tcp_flags="S" if attack else r.choice(["S", "SA", "A", "PA", "FA"]),
                packet_length=r.randint(40, 60) if attack else r.randint(60, 1500), dst_port=r.choice([80, 443]),
            ) | {"label": "ddos" if attack else "normal"})
    return out


@pytest.fixture(scope="module")
def packets(spark):
    rows = traffic()
    labels = spark.createDataFrame(
        sorted({(p["capture_file"], p["label"]) for p in rows}), "capture_file string, label string"
    )
    return frame(spark, rows).join(F.broadcast(labels), "capture_file").cache()


@pytest.fixture(scope="module")
def features(spark, packets):
    return extract_features(packets).cache()


@pytest.fixture(scope="module")
def model(features):
    return models.train(features, FOREST)


@pytest.mark.parametrize(
    "settings",
    [
        FOREST,
        models.with_params(ModelSettings(model_type="boosted_trees"), n_estimators=3, max_depth=3),
        models.with_params(ModelSettings(model_type="neural_network", scaling="minmax_scaler"), max_iter=20),
    ],
    ids=lambda s: s.model_type,
)
def test_models_learn_and_score(features, settings):
    model = models.train(features, settings)
    assert model.labels == ["ddos", "normal"]
    assert set(model.metrics["eval"]) == {"accuracy", "precision", "recall", "f1", "roc_auc"}
    assert model.metrics["train"]["accuracy"] > 0.9
    for r in model.predict(features).collect():
        assert r["p_ddos"] + r["p_normal"] == pytest.approx(1)
        assert r["probability"] == pytest.approx(max(r["p_ddos"], r["p_normal"]))
        assert r["prediction"] == ("ddos" if r["p_ddos"] > r["p_normal"] else "normal") or r["p_ddos"] == r["p_normal"]


def test_unknown_model_type():
    with pytest.raises(ValueError):
        models.make_classifier(ModelSettings(model_type="oracle"), 3)


def test_save_and_load(spark, features, model, tmp_path):
    loaded = models.TrafficModel.load(model.save(str(tmp_path / "model")))
    assert loaded.feature_names == model.feature_names and loaded.labels == model.labels
    a, b = (m.predict(features).orderBy("capture_file").collect() for m in (model, loaded))
    assert a == b
    assert loaded.evaluate(features)["accuracy"] > 0.9


def test_prediction_aligns_columns(features, model):
    """Missing columns count as 0, extra ones and their order do not matter."""
    zeroed = features.withColumn("ttl_mean", F.lit(0.0)).drop("ttl_mean").withColumn("extra", F.lit(1))
    shuffled = zeroed.select(*sorted(zeroed.columns, reverse=True))
    want = model.predict(features.withColumn("ttl_mean", F.lit(0.0))).orderBy("capture_file").select("p_ddos").collect()
    assert model.predict(shuffled).orderBy("capture_file").select("p_ddos").collect() == want


def test_vocabulary_names(features):
    names = prepare.vocabulary(features)
    assert "protocol_6_ratio" in names and "tcp_flags_S_ratio" in names
    row = prepare.align(features, ["tcp_flags_S_ratio", "tcp_flags_none_ratio"]).agg(F.max("tcp_flags_S_ratio")).first()
    assert row[0] == 1.0


def test_importances(spark, model):
    rows = model.importances(spark, 5).collect()
    assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5]
    assert [r["importance"] for r in rows] == sorted((r["importance"] for r in rows), reverse=True)


def test_info(spark, model):
    info = model.info(spark)
    assert info["num_features"] == len(info["features"]) and len(info["top_features"]) == 5
    assert info["numTrees"] == 5 and info["maxDepth"] == 4


def test_too_many_classes(spark):
    with pytest.raises(ValueError):
        prepare.class_weights(spark.range(2000).withColumnRenamed("id", "label"))


def test_cross_validation_and_grid(features):
    scores = models.cross_validate(features, FOREST, folds=3)
    assert scores.count() == 15
    summary = {r["metric"]: r for r in models.cv_summary(scores).collect()}
    assert summary["accuracy"]["folds"] == 3 and summary["accuracy"]["mean"] > 0.8
    best, params, score, table = models.grid_search(features, {"max_depth": [1, 3], "n_estimators": [2]}, FOREST, folds=2)
    assert params["n_estimators"] == 2 and params["max_depth"] in (1, 3)
    assert table.count() == 2 and score == max(r["mean_f1"] for r in table.collect())
    assert best.predict(features).count() == 24


def test_split_keeps_classes(features):
    parts = prepare.with_split(features.select("capture_file", "label"), F.col("capture_file"))
    counts = {(r["label"], r["part"]): r["count"] for r in parts.groupBy("label", "part").count().collect()}
    assert counts == {("ddos", "train"): 6, ("ddos", "eval"): 2, ("normal", "train"): 12, ("normal", "eval"): 4}


def test_scalers(spark):
    from pyspark.ml.linalg import Vectors

    rows = spark.createDataFrame([(Vectors.dense(x, 5.0),) for x in (1.0, 2.0, 6.0)], ["v"])
    z = [list(r["s"]) for r in prepare.make_scaler("standard_scaler", "v", "s").fit(rows).transform(rows).collect()]
    deviation = (14 / 3) ** 0.5
    assert [x for x, _ in z] == pytest.approx([-2 / deviation, -1 / deviation, 3 / deviation])
    assert [y for _, y in z] == [0.0, 0.0, 0.0]
    m = [list(r["s"]) for r in prepare.make_scaler("minmax_scaler", "v", "s").fit(rows).transform(rows).collect()]
    assert m == [[0.0, 0.0], [0.2, 0.0], [1.0, 0.0]]


def test_metrics_of_never_predicted_class(spark):
    rows = spark.createDataFrame([("a", "a")] * 3 + [("b", "a")], "label string, prediction string")
    matrix = evaluate.confusion_matrix(rows)
    report = {r["class"]: r for r in evaluate.class_report(matrix).collect()}
    assert (report["b"]["precision"], report["b"]["recall"], report["b"]["f1"], report["b"]["support"]) == (0, 0, 0, 1)
    one = evaluate.class_metrics(matrix).first()
    assert one["accuracy"] == 0.75 and one["precision"] == pytest.approx(0.5625)


def test_auc_with_ties_and_one_class(spark):
    rows = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, s double")
    assert evaluate.roc_auc(rows, F.col("y") == 1, F.col("s")) == pytest.approx(0.875)
    assert evaluate.roc_auc(rows.where("y = 1"), F.col("y") == 1, F.col("s")) is None


def test_scores_keep_failed_and_small_captures(spark, packets, model, tmp_path):
    tiny = frame(spark, [packet("tiny.pcap", i, i) for i in range(3)]).withColumn("label", F.lit("normal"))
    status = spark.createDataFrame(
        [("cap_00.pcap", "error", 30, "cut short"), ("gone.pcap", "error", 0, "no capture"), ("cap_01.pcap", "ok", 30, None),
         ("empty.pcap", "ok", 0, None)],
        "capture_file string, status string, packets bigint, error string",
    )
    scored = scoring.score_captures(model, packets.unionByName(tiny), status)
    rows = {r["file_name"]: r for r in scored.collect()}
    assert len(rows) == 24 + 3
    assert (rows["cap_00.pcap"]["status"], rows["cap_00.pcap"]["prediction"]) == ("error", None)
    assert rows["gone.pcap"]["error"] == "no capture" and rows["gone.pcap"]["features"] is None
    assert rows["tiny.pcap"]["prediction"] is None and rows["tiny.pcap"]["error"] == "too_few_packets"
    assert rows["empty.pcap"]["error"] == "no_packets"
    assert rows["cap_03.pcap"]["prediction"] == "ddos" and rows["cap_04.pcap"]["prediction"] == "normal"
    assert rows["cap_03.pcap"]["features"]["total_packets"] == 30
    summary = reports.report_summary(scored).first()
    assert (summary["total_files"], summary["error_count"]) == (27, 4)
    timed = scoring.timed(scored)
    assert timed.where("processing_time > 0").count() == 27
    path = scoring.save_report(timed, str(tmp_path / "report"))
    assert spark.read.json(f"{path}/results").count() == 27
    assert spark.read.json(f"{path}/summary").first()["total_files"] == 27


def test_one_capture(packets, model):
    rows = scoring.score_capture(model, packets, "cap_03.pcap").collect()
    assert [(r["file_name"], r["prediction"]) for r in rows] == [("cap_03.pcap", "ddos")]


def test_window_verdicts(packets, model):
    windows, summary = scoring.analyze_windows(model, packets, 13)
    rows = [r for r in windows.orderBy("window_id").collect() if r["capture_file"] == "cap_04.pcap"]
    assert [(r["window_start"], r["window_end"], r["packet_count"]) for r in rows] == [(0, 13, 13), (13, 26, 13), (26, 30, 4)]
    assert rows[2]["prediction"] is None
    one = summary.where("file_name = 'cap_04.pcap'").first()
    assert (one["total_packets"], one["window_count"], one["normal_windows"] + one["ddos_windows"]) == (30, 3, 2)


def test_empty_reports(spark):
    empty = spark.createDataFrame([], "prediction string, probability double, error string")
    row = reports.report_summary(empty).first()
    assert row["total_files"] == 0 and row["ddos_percentage"] == 0.0
    assert reports.histogram(empty).count() == 0 and reports.density(empty).count() == 0


def test_training_run_from_folders(spark, packets, tmp_path):
    fields = [c for c in packets.columns if c not in ("label", "ts_us")]
    timed = packets.withColumn("timestamp", F.timestamp_micros("ts_us"))
    folders = []
    for label, kind in (("normal", "parquet"), ("ddos", "csv")):
        path = tmp_path / kind
        path.mkdir()
        for name in [r[0] for r in packets.where(F.col("label") == label).select("capture_file").distinct().collect()]:
            one = timed.where(F.col("capture_file") == name).orderBy("packet_no").select("timestamp", *fields)
            one = one.drop("capture_file", "packet_no")
            if kind == "parquet":
                one.toPandas().to_parquet(path / f"{name}.parquet", coerce_timestamps="us")
            else:
                shape = [f.name for f in tables.packet_csv_schema().fields[:-1]]
                pdf = one.toPandas().assign(timestamp=lambda d: d["timestamp"].astype("int64") / 1e9)
                for c in ("src_port", "dst_port", "protocol", "packet_length", "ttl"):
                    pdf[c] = pdf[c].astype("Int64")
                pdf.reindex(columns=shape).to_csv(path / f"{name}.csv", index=False)
        folders.append({"folder": path.as_uri(), "label": label, "kind": kind})
    result = training.run_training(spark, folders, str(tmp_path / "model"), None, FOREST, folds=2)
    assert {r["label"]: r["count"] for r in result.classes.collect()} == {"normal": 16, "ddos": 8}
    assert result.metrics["train"]["accuracy"] > 0.9 and result.cv.count() == 5
    assert models.TrafficModel.load(result.model_path).feature_names == result.model.feature_names
    status = result.inputs.collect()
    assert len(status) == 24 and {(r["label"], r["status"]) for r in status} == {("normal", "ok"), ("ddos", "ok")}
    assert sum(r["rows"] for r in status) == packets.count()
    assert START > 0


def test_labels_from_names(spark, packets, tmp_path):
    day = packets.limit(40).withColumn("timestamp", F.timestamp_micros("ts_us")).drop("capture_file", "packet_no", "label")
    for name in ("Benign-Monday", "DDoS-Friday", "unknown"):
        day.toPandas().to_parquet(tmp_path / f"{name}.parquet", coerce_timestamps="us")
    rows = training.features_of_folder(spark, tmp_path.as_uri()).collect()
    assert {r["capture_file"]: r["label"] for r in rows} == {"Benign-Monday.parquet": "normal", "DDoS-Friday.parquet": "ddos"}


def test_sinks(spark, features, packets, tmp_path):
    rows = sinks.write_csv(features, str(tmp_path / "features"))
    back = tables.read_csv(spark, rows)
    assert back.count() == 24 and json.loads(back.first()["protocol_ratio"]) == {"6": 1.0}
    out = sinks.write_json(features.select("capture_file", "http_method_ratio"), str(tmp_path / "json"))
    assert spark.read.text(out).first()[0].count("http_method_ratio") == 1
    landed = sinks.write_packets(packets, str(tmp_path / "landed"))
    assert spark.read.parquet(landed).where("day = '2023-11-14'").count() == packets.count()


def test_broken_files_are_an_error_or_have_a_status(spark, packets, tmp_path):
    packets.select("packet_no", "ttl").limit(7).toPandas().to_parquet(tmp_path / "good.parquet")
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 this is not parquet PAR1")
    schema = packets.select("packet_no", "ttl").schema
    with pytest.raises(Exception):
        tables.read_parquet_dir(spark, tmp_path.as_uri(), schema=schema).count()
    assert tables.read_parquet_dir(spark, tmp_path.as_uri(), True, schema).count() == 7
    status = {r["capture_file"]: (r["status"], r["rows"], r["error"]) for r in tables.table_status(spark, tmp_path.as_uri()).collect()}
    assert status == {"good.parquet": ("ok", 7, None), "bad.parquet": ("error", 0, "no readable rows")}


def test_csv_with_bad_lines_and_short_schema(spark, tmp_path):
    head = "timestamp,ip_src,ip_dst,src_port,dst_port,protocol,packet_length,ttl,tcp_flags,tcp_window_size,udp_length,icmp_type"
    (tmp_path / "a.csv").write_text(f"{head}\n1.5,10.0.0.1,10.0.0.2,1,2,6,60,64,0x0002,100,,\nx,y,z,port,2,6,60,64,S,1,,\n")
    raw = tables.read_packets_csv(spark, tmp_path.as_uri(), head.split(","))
    assert raw.count() == 2
    rows = tables.good_rows(raw).collect()
    assert len(rows) == 1 and rows[0]["capture_file"] == "a.csv" and rows[0]["dns_query"] is None
    assert rows[0]["timestamp"].timestamp() == 1.5 and rows[0]["udp_length"] is None
    status = tables.table_status(spark, tmp_path.as_uri(), "csv", head.split(",")).collect()
    assert [tuple(r) for r in status] == [("a.csv", "error", 1, "1 lines do not fit")]


def test_lines_are_numbered_in_file_order(spark, tmp_path):
    lines = "\n".join(f"{1000 - i},10.0.0.1,10.0.0.2,{i},2,6,60,64,S,1,,,," for i in range(500))
    head = ",".join(f.name for f in tables.packet_csv_schema().fields[:-1])
    (tmp_path / "a.csv").write_text(f"{head}\n{lines}\n")
    numbered = tables.number_lines(tables.good_rows(tables.read_packets_csv(spark, tmp_path.as_uri())))
    assert numbered.where("packet_no = src_port").count() == 500


def test_score_batch_keeps_a_row_for_each_broken_capture(spark, small):
    from trafficlens.catalog import learning_queries

    rows = learning_queries.score_batch(spark, small).collect()
    assert {r["status"] for r in rows} >= {"ok", "error"}
    for r in rows:
        assert (r["status"] == "ok") == (r["prediction"] is not None) == (r["error"] is None)


def test_score_batch_with_files_of_too_few_packets_equals_sql(spark, small, tmp_path):
    from oracle import connect, differences

    from trafficlens.catalog import learning_queries

    sql = learning_queries.ORACLES["score_batch"]
    connect(small).execute(
        f"""copy (select * from events qualify day(ts) not in (4, 7, 9)
              or row_number() over (partition by day(ts) order by event_id) <= case day(ts) when 9 then 9 else 5 end)
            to '{tmp_path}/events.parquet' (format parquet)"""
    )
    con = connect(str(tmp_path))
    found = con.execute(f"select file_name, status from ({sql}) where status = 'too_few_packets' order by 1").fetchall()
    assert [name for name, _ in found] == ["000000000_cap_04.pcap", "000000000_cap_09.pcap"]
    assert differences(learning_queries.score_batch(spark, str(tmp_path)), con, sql) == []


@pytest.mark.parametrize(
    "events",
    [
        # No user on day 8, no value on day 2 and on some of the few packets of day 4, no props on day 1.
        """select event_id, ts, if(day(ts) = 8, null, user_id) as user_id, event_type,
             if(day(ts) = 2 or day(ts) = 4 and event_id % 2 = 0, null, value) as value, if(day(ts) = 1, null, props) as props
           from events qualify day(ts) <> 4 or row_number() over (partition by day(ts) order by event_id) <= 12""",
        # Lengths whose range times nine is no 32-bit integer.
        "select * replace (if(event_id % 50 = 0, 5e8, value) as value) from events",
        # No window has enough packets to learn from.
        "select * from events qualify row_number() over (partition by day(ts) order by event_id) <= 5",
        "select * from events where false",
    ],
    ids=["nulls", "lengths", "few", "empty"],
)
def test_score_batch_of_odd_events_equals_sql(spark, small, tmp_path, events):
    from oracle import connect, differences

    from trafficlens.catalog import learning_queries

    connect(small).execute(f"copy ({events}) to '{tmp_path}/events.parquet' (format parquet)")
    found = learning_queries.score_batch(spark, str(tmp_path))
    assert differences(found, connect(str(tmp_path)), learning_queries.ORACLES["score_batch"]) == []
