from __future__ import annotations

import pytest
from test_captures import BYTES, classic
from test_learning import FOREST

from trafficlens.__main__ import main, parser
from trafficlens.learning import models
from trafficlens.operators.assemble import extract_features
from trafficlens.sources.captures import read_captures
from trafficlens.sources.tables import stack, with_label


@pytest.fixture(scope="module")
def captures(tmp_path_factory):
    folder = tmp_path_factory.mktemp("captures")
    for i in range(4):
        (folder / f"normal_{i}.pcap").write_bytes(classic(BYTES * (2 + i)))
        (folder / f"ddos_{i}.pcap").write_bytes(classic([BYTES[1]] * (30 + i)))
    (folder / "broken.pcap").write_bytes(b"nothing")
    return folder


def test_score_and_windows(spark, captures, tmp_path):
    packets = read_captures(spark, captures.as_uri())
    parts = [with_label(packets.where(f"capture_file like '{c}%'"), c) for c in ("normal", "ddos")]
    model = models.train(extract_features(stack(parts)), FOREST).save(str(tmp_path / "model"))
    common = ["--captures", captures.as_uri(), "--model", model]
    main(["score", *common, "--output", str(tmp_path / "report")], spark)
    rows = {r["file_name"]: r for r in spark.read.json(str(tmp_path / "report" / "results")).collect()}
    assert len(rows) == 9 and rows["broken.pcap"]["error"].startswith("not a capture file")
    assert rows["ddos_1.pcap"]["prediction"] == "ddos" and rows["normal_1.pcap"]["prediction"] == "normal"
    summary = spark.read.json(str(tmp_path / "report" / "summary")).first()
    assert (summary["total_files"], summary["error_count"]) == (9, 1)
    main(["windows", *common, "--output", str(tmp_path / "live"), "--window-size", "15"], spark)
    windows = spark.read.json(str(tmp_path / "live" / "windows"))
    assert windows.where("capture_file = 'ddos_0.pcap'").count() == 2
    assert spark.read.json(str(tmp_path / "live" / "summary")).count() == 8


def test_train_arguments():
    args = parser().parse_args(["train", "--normal", "a", "--normal", "b", "--ddos", "c", "--model", "m", "--cv", "5"])
    assert args.normal == ["a", "b"] and args.cv == 5 and args.eval_split == 0.2
