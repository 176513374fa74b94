"""python -m rivulet.plans.cli run|convert|quality|schema|describe|audit-splits|checkpoint|prepare-search|search|report ..."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace
from pathlib import Path

from rivulet import config, session
from rivulet.operators import audit, quality, search, splits
from rivulet.plans import pipeline, searching
from rivulet.sources import convert, readers, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Flow analytics on Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("run", help="an experiment up to a stage")
    r.add_argument("--config", required=True)
    r.add_argument("--output-dir", required=True)
    r.add_argument("--stage", choices=pipeline.STAGES, default="all")
    r.add_argument("--data-path")
    c = sub.add_parser("convert", help="CSV to Parquet")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--compression", default="zstd")
    c.add_argument("--overwrite", action="store_true")
    for name, text in (("quality", "violations after quarantine; exit code 1 if there are any"), ("schema", "counts by file and column")):
        a = sub.add_parser(name, help=text)
        a.add_argument("source")
        a.add_argument("--output-dir", required=True)
        a.add_argument("--partitions", type=int)
    d = sub.add_parser("describe", help="class shares of a frozen split")
    d.add_argument("--config", required=True)
    d.add_argument("--output-dir", required=True)
    d.add_argument("--data-path")
    s = sub.add_parser("audit-splits", help="every protocol's manifest on the same rows; exit code 1 if one isn't valid")
    s.add_argument("--config", required=True)
    s.add_argument("--output-dir", required=True)
    s.add_argument("--data-path")
    s.add_argument("--protocols", nargs="+", default=list(splits.VERSIONS), choices=list(splits.VERSIONS))
    k = sub.add_parser("checkpoint", help="named checks of a manifest against a frozen one; exit code 1 if one fails")
    k.add_argument("manifest")
    k.add_argument("expected")
    k.add_argument("--review", help="write a review page here")
    g = sub.add_parser("prepare-search", help="development samples of a parent experiment in every representation")
    g.add_argument("--config", required=True)
    g.add_argument("--parent", required=True)
    g.add_argument("--output-dir", required=True)
    g.add_argument("--data-path")
    g.add_argument("--sample", type=int, default=20_000)
    g.add_argument("--components", type=int, nargs="*", default=[5, 10, 20])
    x = sub.add_parser("search", help="the grid on a prepared folder; runs that are there are not run again")
    x.add_argument("--output-dir", required=True)
    x.add_argument("--k", type=int, nargs="+", required=True)
    x.add_argument("--seeds", type=int, nargs="+", default=[42, 43, 44])
    x.add_argument("--retry-invalid", action="store_true")
    y = sub.add_parser("report", help="a table of several experiments' results")
    y.add_argument("roots", nargs="+")
    y.add_argument("--output", required=True)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session.build()
    if args.command == "run":
        done = pipeline.run(spark, config.load(args.config), args.output_dir, args.data_path, args.stage)
        print(json.dumps(sinks.plain(done["profile"])))
        return 0
    if args.command == "convert":
        convert.convert(spark, args.source, args.target, args.compression, args.overwrite)
        return 0
    if args.command == "describe":
        table, _ = pipeline.load(spark, cfg := config.load(args.config), args.data_path)
        print(json.dumps(pipeline.describe(spark, table, args.output_dir, [cfg.label_col, cfg.type_col])))
        return 0
    if args.command == "audit-splits":
        cfg = config.load(args.config)
        table, _ = pipeline.load(spark, cfg, args.data_path)
        found = pipeline.audit_protocols(table, {p: replace(cfg, split_strategy=p) for p in args.protocols})
        for name, record in found.items():
            sinks.write_json(Path(args.output_dir) / f"split_audit_{name}.json", record)
        return int(not all(x["validation_ok"] for x in found.values()))
    if args.command == "checkpoint":
        manifest = sinks.read_json(args.manifest)
        checks = pipeline.checkpoint(manifest, sinks.read_json(args.expected))
        if args.review:
            Path(args.review).write_text(pipeline.checkpoint_markdown(manifest), encoding="utf-8")
        print(json.dumps(checks))
        return int(not all(checks.values()))
    if args.command == "prepare-search":
        searching.prepare(spark, config.load(args.config), args.parent, args.output_dir, args.data_path, args.sample, args.components)
        return 0
    if args.command == "search":
        print(search.markdown(searching.run_grid(spark, args.output_dir, args.k, args.seeds, retry_invalid=args.retry_invalid)))
        return 0
    if args.command == "report":
        sinks.write_csv(pipeline.collect_summaries(spark, args.roots), args.output)
        return 0
    if args.partitions and not (found := quality.partitions([n for _, n in readers.resolve(spark, args.source)], args.partitions))["ok"]:
        print(json.dumps(found))
        return 1
    raw, out = readers.with_position(readers.load_raw(spark, args.source)), Path(args.output_dir)
    if args.command == "quality":
        table, report = audit.quality(raw, readers.SOURCE_ID, "orig_pos")
        sinks.write_csv(table, str(out / "quality_by_file_column.csv"))
        sinks.write_json(out / "quality_report.json", report)
        return report["exit_code"]
    columns = [c for c in raw.columns if not c.startswith("_") and c != "orig_pos"]
    sinks.write_csv(audit.by_column(raw, columns), str(out / "schema_by_column.csv"))
    sinks.write_csv(audit.with_total(raw, columns, readers.SOURCE_ID), str(out / "schema_by_file_column.csv"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
