"""Command line: `spark-submit` or `python -m posttide <job> ...`."""

from __future__ import annotations

import argparse
import importlib
import re
from datetime import date

from pyspark.ml import PipelineModel

from posttide import schemas
from posttide.operators import classify, places, posts
from posttide.plans import preprocess, reports
from posttide.session import build_session, job_scratch
from posttide.sources import readers, writers


def _save(tables: dict, out: str) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{out}/{name}")


def gazetteer(spark, a) -> None:
    parents = [readers.read_csv_by_header(spark, path, schemas.GAZETTEER_TYPES, glob="*", only_present=True)
               .drop("file", "pos") for path in (a.places, a.states)]
    writers.write_gazetteer(places.project_gazetteer(places.merge_gazetteer(*parents)), a.out)


def preprocess_posts(spark, a) -> None:
    lexicon = spark.read.parquet(a.lexicon) if a.lexicon else None
    preprocess.run(spark, a.posts, a.gazetteer, a.out, a.mode, lexicon, a.format,
                   job=a.once, case_insensitive=a.case_insensitive)


def train(spark, a) -> None:
    rows = posts.training_rows(readers.read_training(spark, a.training), ["textID"])
    classify.train_classifier(rows).write().overwrite().save(a.out)


def label(spark, a) -> None:
    """The model is a folder that `train` wrote, or `module:function`, a function that makes a Python model."""
    if re.fullmatch(r"[\w.]+:\w+", a.model):
        module, name = a.model.split(":")
        model = getattr(importlib.import_module(module), name)
    else:
        model = PipelineModel.load(a.model)
    failed = reports.run_labelling(spark, a.posts, a.out, model, a.format, n=a.rows)
    print(f"texts without a label because the model failed: {failed}")


def sentiment_report(spark, a) -> None:
    labelled = readers.read_labelled(spark, a.labelled, a.format)
    _save(reports.sentiment_reports(labelled, start=a.start, end=a.end), a.out)


def topic_report(spark, a) -> None:
    month = readers.read_month(spark, a.posts, a.month, a.format)
    _save(reports.topic_report(month.select("id", "text")), a.out)


def accuracy_report(spark, a) -> None:
    _save(reports.accuracy_report(readers.read_training(spark, a.training)), a.out)


JOBS = {
    "gazetteer": (gazetteer, ["places", "states", "out"]),
    "preprocess": (preprocess_posts, ["posts", "gazetteer", "out"]),
    "train": (train, ["training", "out"]),
    "label": (label, ["posts", "model", "out"]),
    "sentiment": (sentiment_report, ["labelled", "out"]),
    "topics": (topic_report, ["posts", "month", "out"]),
    "accuracy": (accuracy_report, ["training", "out"]),
}


def main() -> None:
    parser = argparse.ArgumentParser(prog="posttide")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name, (_, needed) in JOBS.items():
        sub = jobs.add_parser(name)
        for option in needed:
            sub.add_argument(f"--{option}", required=True)
        if name in ("preprocess", "label", "sentiment", "topics"):
            sub.add_argument("--format", choices=["parquet", "csv"], default="parquet")
        if name == "preprocess":
            sub.add_argument("--mode", choices=[preprocess.LIGHT, preprocess.HEAVY], default=preprocess.LIGHT)
            sub.add_argument("--lexicon")
            sub.add_argument("--case-insensitive", action="store_true")
            sub.add_argument("--once", metavar="NAME", help="append as the job NAME; run again, it adds nothing")
        if name == "label":
            sub.add_argument("--rows", type=int, default=reports.SAMPLE_ROWS, help="posts labelled per month")
        if name == "sentiment":
            sub.add_argument("--start", type=date.fromisoformat, default=posts.PERIOD_START)
            sub.add_argument("--end", type=date.fromisoformat, default=posts.PERIOD_END)
    args = parser.parse_args()
    spark = build_session(f"posttide-{args.job}")
    with job_scratch(spark):
        JOBS[args.job][0](spark, args)


if __name__ == "__main__":
    main()
