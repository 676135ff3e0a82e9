"""Command line: python -m tessera analyze INPUT OUTPUT | calibrate LABELS OUTPUT | evaluate LABELS OUTPUT | export LABELS OUTPUT."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.functions import listing as L
from tessera.operators import calibrate, decisions
from tessera.plans import listings as P
from tessera.sources import snapshots

OPTIONS = {"disposition": ("human_disposition", None)}


def _labelled(spark: SparkSession, path: str, question: str):
    table = snapshots.read_parquet(spark, path) if snapshots.supported(path) == ".parquet" else snapshots.read_csv(spark, path)
    answers = decisions.from_json(table, ["listing_id"], "decision_raw_json", question)
    labels = table.select("listing_id", L.label_choice(F.col(OPTIONS[question][0])).alias("target"))
    return table, calibrate.labelled(answers, labels, "listing_id")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    parser.add_argument("command", choices=["analyze", "calibrate", "evaluate", "export"])
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--question", default="disposition", choices=sorted(OPTIONS))
    parser.add_argument("--min-samples", type=int, default=30)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "analyze":
        scored = P.scored(snapshots.load_snapshot(spark, args.input)).persist()
        snapshots.write_parquet(scored, os.path.join(args.output, "scored.parquet"))
        snapshots.write_csv(P.review_queue(scored), os.path.join(args.output, "review_queue"))
        snapshots.html_report(scored, os.path.join(args.output, "report.html"))
        result, target = snapshots.run_summary(scored), os.path.join(args.output, "run.json")
    else:
        table, rows = _labelled(spark, args.input, args.question)
        target = args.output
        if args.command == "calibrate":
            samples = calibrate.samples(rows, "listing_id")
            n = samples.count()
            result = {"question": args.question, "samples": n, "temperature": calibrate.fit_temperature(samples)[0] if n >= args.min_samples else None}
        elif args.command == "evaluate":
            result = calibrate.summary(calibrate.case_metrics(rows, "listing_id"), table.select("listing_id", F.col("decision_abstain").alias("abstain"))).first().asDict()
        else:
            options = [r.option for r in rows.select("option_idx", "option").distinct().orderBy("option_idx").collect()]  # a question's options
            gold = calibrate.soft_targets(table.withColumn("label", L.label_choice(F.col(OPTIONS[args.question][0]))), options, "label", "human_label_confidence").where("gold is not null")
            snapshots.write_jsonl(gold.select("listing_id", "label", "gold"), args.output)
            return
    with open(target, "w", encoding="utf-8") as f:
        json.dump(result, f, ensure_ascii=False, indent=1)


if __name__ == "__main__":
    main()
