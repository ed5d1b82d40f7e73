"""Command line: train a model from folders, score a folder, analyse windows.

    python -m trafficlens train --normal DIR --ddos DIR --model DIR [--kind parquet] [--cv 5]
    python -m trafficlens score --captures DIR --model DIR --output DIR
    python -m trafficlens windows --captures DIR --model DIR --output DIR [--window-size 1000]
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession

from trafficlens.learning.models import TrafficModel
from trafficlens.plans import scoring, training
from trafficlens.session import store
from trafficlens.settings import DEFAULT_LIVE_WINDOW, ModelSettings
from trafficlens.sources import sinks
from trafficlens.sources.captures import CaptureFolder


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="trafficlens")
    commands = top.add_subparsers(dest="command", required=True)
    train = commands.add_parser("train")
    train.add_argument("--normal", action="append", default=[], help="folder of normal traffic (repeatable)")
    train.add_argument("--ddos", action="append", default=[], help="folder of attack traffic (repeatable)")
    train.add_argument("--kind", choices=("parquet", "csv", "capture"), default="parquet")
    train.add_argument("--model", required=True)
    train.add_argument("--model-type", default="random_forest")
    train.add_argument("--eval-split", type=float, default=0.2)
    train.add_argument("--cv", type=int, default=0, help="folds; 0 to leave out")
    for name in ("score", "windows"):
        command = commands.add_parser(name)
        command.add_argument("--captures", required=True)
        command.add_argument("--model", required=True)
        command.add_argument("--output", required=True)
        if name == "windows":
            command.add_argument("--window-size", type=int, default=DEFAULT_LIVE_WINDOW)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("trafficlens").getOrCreate()
    if args.command == "train":
        folders = [
            {"folder": f, "label": label, "kind": args.kind}
            for label in ("normal", "ddos")
            for f in getattr(args, label)
        ]
        settings = replace(ModelSettings(), model_type=args.model_type, eval_split=args.eval_split)
        result = training.run_training(spark, folders, args.model, None, settings, args.cv)
        for part, values in result.metrics.items():
            print(part, " ".join(f"{k}={v:.4f}" for k, v in values.items()))
        print(f"model saved to {result.model_path}, {result.training_time:.1f} s")
        if result.cv is not None:
            result.cv.show(truncate=False)
        return
    model = TrafficModel.load(args.model)
    captures = CaptureFolder(spark, args.captures)
    # Decoded once and landed; every part of the features then reads only its columns.
    packets = store(captures.packets(), "packets")
    if args.command == "score":
        scoring.save_report(scoring.timed(scoring.score_captures(model, packets, captures.status())), args.output)
        return
    windows, summary = scoring.analyze_windows(model, packets, args.window_size)
    sinks.write_json(windows, f"{args.output.rstrip('/')}/windows")
    sinks.write_json(summary, f"{args.output.rstrip('/')}/summary")


if __name__ == "__main__":
    main()
