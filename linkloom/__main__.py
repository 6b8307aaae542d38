"""Command line: ``python -m linkloom run-a|run-b|validate ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="linkloom")
    sub = ap.add_subparsers(dest="command", required=True)
    for name in ("run-a", "run-b"):
        p = sub.add_parser(name, help="link the sources of a folder and write both list files")
        p.add_argument("--data", required=True)
        p.add_argument("--split", default="train")
        p.add_argument("--out", required=True)
        p.add_argument("--rounds", type=int, default=20)
    p = sub.add_parser("validate", help="check a list file")
    p.add_argument("--lists", required=True)
    p.add_argument("--entities", required=True)
    p.add_argument("--items", default="matched_entity_ids")
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName("linkloom").getOrCreate()
    from linkloom.operators import validate
    from linkloom.plans import linkage
    from linkloom.sources import tables

    if args.command == "validate":
        need = tables.read_raw(spark, args.entities).select("entity_id")
        validate.file_findings(spark, args.lists, need, ("source1_entity_id", args.items)).show(truncate=False)
        return
    sources = {str(k): tables.read_table(spark, args.data, args.split, f"source{k}") for k in (1, 2, 3)}
    gt = tables.read_table(spark, args.data, args.split, "ground_truth", "source1_entity_id string, matched_entity_ids string")
    truth = tables.explode_lists(gt)
    run = linkage.run_line_a if args.command == "run-a" else linkage.run_line_b
    result = run(sources, truth, rounds=args.rounds)
    matches, candidates = linkage.lists(result)
    tables.write_list_file(matches.withColumnRenamed("s1", "source1_entity_id"), f"{args.out}/matching_results")
    tables.write_list_file(candidates.withColumnRenamed("s1", "source1_entity_id"), f"{args.out}/candidate_pairs")
    tables.write_json(spark, f"{args.out}/metrics.json", linkage.evaluate(result, truth).first().asDict())


if __name__ == "__main__":
    main()
