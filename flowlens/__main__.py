"""Jobs for spark-submit: ``python -m flowlens extract|benchmark|fit|detect ...``."""

from __future__ import annotations

import argparse

from flowlens import fixed_values as fv, get_session
from flowlens.operators.model_store import Detector, fit_detector
from flowlens.plans.benchmark import run_benchmark
from flowlens.plans.extract import build_features
from flowlens.sources.feature_store import FeatureStore
from flowlens.sources.sinks import write_report_csv


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="flowlens", description=__doc__)
    jobs = out.add_subparsers(dest="job", required=True)
    job = jobs.add_parser("extract", help="CSV days to a feature store")
    job.add_argument("--csv", required=True)
    job.add_argument("--store", required=True)
    job.add_argument("--step", type=int, default=1, help="take every n-th row of a day")
    job.add_argument("--length", type=int, default=fv.WINDOW_LENGTH)
    job.add_argument("--force", action="store_true")
    job = jobs.add_parser("benchmark", help="train, calibrate and compare the candidates")
    job.add_argument("--store", required=True)
    job.add_argument("--out", required=True)
    job.add_argument("--rounds", type=int)
    job.add_argument("--tabular", nargs="*")
    job.add_argument("--sequence", nargs="*")
    job = jobs.add_parser("fit", help="fit one candidate for serving and keep it")
    job.add_argument("--store", required=True)
    job.add_argument("--model", required=True)
    job.add_argument("--name", default="XGBoost")
    job.add_argument("--rounds", type=int)
    job.add_argument("--fit-on", choices=("store", "balanced"), default="store")
    job = jobs.add_parser("detect", help="score a store with a kept detector")
    job.add_argument("--store", required=True)
    job.add_argument("--model", required=True)
    job.add_argument("--out", required=True)
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = get_session()
    if args.job == "extract":
        done = build_features(spark, args.csv, args.store, args.length, args.step, args.force)
        print("store is there already" if done is None else f"stored in {args.store}")
        return
    store = FeatureStore(spark, args.store)
    windows, features = store.load(), store.feature_names()
    if args.job == "benchmark":
        chosen = {k: tuple(v) for k in ("tabular", "sequence") if (v := getattr(args, k)) is not None}
        run = run_benchmark(windows, features, rounds=args.rounds, **chosen)
        write_report_csv(run.matrix, f"{args.out}/matrix")
        write_report_csv(run.gaps, f"{args.out}/gaps")
    elif args.job == "fit":
        fit_detector(windows, features, args.name, fit_on=args.fit_on, rounds=args.rounds).save(args.model)
    else:
        detector = Detector.load(spark, args.model)
        detector.score(windows).write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    main()
