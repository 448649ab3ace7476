"""Commands: ``fit`` a cohort of long text tables, ``simulate`` one."""

from __future__ import annotations

import argparse


FIT_NUMBERS = {"major-prior": float, "dosage-penalty": float, "partition-tolerance": float, "code-weight": float, "kkt-tolerance": float, "explore": int, "refine": int}


def _score(value: str) -> str:
    from tessera.plans.config import score_name

    try:
        return score_name(value)
    except ValueError as e:
        raise argparse.ArgumentTypeError(str(e)) from None


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tessera", description=__doc__)
    sub = out.add_subparsers(dest="command", required=True)
    fit = sub.add_parser("fit", help="estimate fractions, clusters and multiplicities")
    fit.add_argument("input", help="path or pattern of long tables")
    fit.add_argument("outdir")
    fit.add_argument("--profile", default="balanced")
    for name, kind in FIT_NUMBERS.items():
        fit.add_argument(f"--{name}", type=kind)
    fit.add_argument("--selection-score", type=_score)
    fit.add_argument("--skip-outputs", action="store_true", help="fit and show the summary, but write no tables")
    fit.add_argument("--unsupported", choices=("mask", "error"))
    sim = sub.add_parser("simulate", help="write long tables with known truth")
    sim.add_argument("outdir")
    sim.add_argument("--tumors", type=int, default=1)
    for name, kind in (("mutations", int), ("regions", int), ("clones", int), ("segments", int), ("depth", float), ("purity", float), ("seed", int)):
        sim.add_argument(f"--{name}", type=kind)
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from tessera.operators import fingerprints
    from tessera.plans import config, fit, report, simulate
    from tessera.sources import long_text

    spark = SparkSession.builder.appName("tessera").getOrCreate()
    if args.command == "fit":
        given = {name.replace("-", "_"): getattr(args, name.replace("-", "_")) for name in FIT_NUMBERS}
        settings = config.resolve(args.profile, selection_score=args.selection_score, unsupported=args.unsupported, **given)
        results = fit.fit_cohort(long_text.load(spark, args.input), settings)
        if args.skip_outputs:
            results["summary"].show(truncate=False)
        else:
            report.write_tables(results, args.outdir)
    else:
        given = {k: getattr(args, k) for k in ("mutations", "regions", "clones", "segments", "depth", "purity", "seed") if getattr(args, k) is not None}
        settings = simulate.SimulationConfig(**given)
        tables = simulate.simulate(spark, args.tumors, settings)
        for name, table in (tables | simulate.truth_tables(tables, settings)).items():
            if name == "long":
                long_text.write(table, f"{args.outdir}/long")
            else:
                table.write.mode("overwrite").json(f"{args.outdir}/{name}")
        files = fingerprints.file_digests(spark, f"{args.outdir}/long")
        fingerprints.manifest(files, tumors=args.tumors, **given).write.mode("overwrite").text(f"{args.outdir}/manifest")


if __name__ == "__main__":
    main()
