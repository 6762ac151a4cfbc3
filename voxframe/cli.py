"""Command line: python -m voxframe.cli COMMAND. Volumes are NIfTI or TIFF files, runs are folders."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import functions as F

from voxframe.engines.features import extractor
from voxframe.functions.scalar import AXES
from voxframe.operators.tiling import Grid, depth
from voxframe.plans import config, costs, groupwise, reports
from voxframe.session import session
from voxframe.sources import volumes as V
from voxframe.sources.formats import open_volume


def _arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="voxframe")
    sub = top.add_subparsers(dest="command", required=True)
    plan = sub.add_parser("plan", help="what a run will cost, level by level")
    plan.add_argument("shape", type=int, nargs=3)
    plan.add_argument("--spacing", type=float, default=0.05)
    plan.add_argument("--subjects", type=int, default=1)
    plan.add_argument("--caps", type=int, nargs="+", default=[6, 4, 3, 2, 1])
    run = sub.add_parser("run", help="estimate a template from volume files")
    run.add_argument("settings")
    run.add_argument("root")
    run.add_argument("files", nargs="+")
    pair = sub.add_parser("pair", help="bring one volume onto another")
    pair.add_argument("settings")
    pair.add_argument("root")
    pair.add_argument("fixed")
    pair.add_argument("moving")
    for name, text in (("status", "finished passes of a run"), ("clean", "remove chunk results of finished passes")):
        one = sub.add_parser(name, help=text)
        one.add_argument("settings")
        one.add_argument("root")
        one.add_argument("shape", type=int, nargs=3)
        if name == "clean":
            one.add_argument("--keep", type=int, default=1)
    apply = sub.add_parser("apply", help="warp a volume by a run's field and write it")
    apply.add_argument("root")
    apply.add_argument("volume")
    apply.add_argument("out")
    apply.add_argument("--subject", type=int, default=1)
    apply.add_argument("--level", type=int, default=0)
    apply.add_argument("--spacing", type=float, default=0.05)
    export = sub.add_parser("export", help="write a table of a run as NIfTI or TIFF")
    export.add_argument("root")
    export.add_argument("table")
    export.add_argument("out")
    sub.add_parser("check", help="read settings and print them").add_argument("settings")
    sub.add_parser("selftest", help="check conventions on small arrays")
    features = sub.add_parser("features", help="metrics of a volume's feature channels")
    features.add_argument("volume")
    features.add_argument("--spec", default="mind")
    return top


def _shape(voxels) -> tuple[int, int, int]:
    return tuple(int(n) + 1 for n in voxels.agg(*[F.max(a) for a in AXES]).first())


def main(args: list[str] | None = None) -> int:
    """Runs a command; 0 if it went well."""
    a = _arguments().parse_args(args)
    settings = config.load(Path(a.settings).read_text()) if hasattr(a, "settings") else None
    if a.command == "check":
        print(config.dump(settings))
        return 0
    if a.command == "selftest":
        found = reports.selftest()
        print(json.dumps(found, indent=2))
        return int(not all(found.values()))
    if a.command == "features":
        print(json.dumps(reports.feature_metrics(extractor(a.spec), open_volume(a.volume, Path(a.volume).read_bytes()).data.astype(float))))
        return 0
    spark = session()
    if a.command == "plan":
        costs.plan(spark, Grid(tuple(a.shape), a.spacing), costs.Profile(), a.subjects, tuple(a.caps)).orderBy("level").show(truncate=False)
        return 0
    if a.command == "run":
        rows = [V.read_volumes(spark, f).select(F.lit(i).alias("subject"), *AXES, "v") for i, f in enumerate(a.files)]
        both = rows[0]
        for r in rows[1:]:
            both = both.unionByName(r)
        groupwise.build_template(both, _shape(both), settings, a.root, print)
        return 0
    if a.command == "pair":
        fixed, moving = (V.read_volumes(spark, f).select(*AXES, "v") for f in (a.fixed, a.moving))
        groupwise.register_pair(fixed, moving, _shape(fixed), settings, a.root, print)
        return 0
    store = groupwise.Store(spark, a.root)
    if a.command in ("status", "clean"):
        top = depth(tuple(a.shape), settings.tiling.core)
        done = groupwise.status(store, top, lambda level: settings.cap(level, top))
        if a.command == "status":
            print(json.dumps([{"level": level, "passes": n} for level, n in done]))
        else:
            for level, n in done:
                groupwise.clean(store, level, a.keep, n)
        return 0
    if a.command == "apply":
        image = V.read_volumes(spark, a.volume).select(*AXES, "v")
        n = max(i for i in range(1000) if i == 0 or store.has(f"level={a.level}/pass={i}/fields"))
        field = store.read(f"level={a.level}/pass={n}/fields").where(F.col("subject") == a.subject).drop("subject")
        voxels, shape = groupwise.apply_field(image, field, Grid(_shape(image), a.spacing)), _shape(image)
    else:
        voxels = store.read(a.table)
        shape = _shape(voxels)
    V.write_volume(a.out, voxels, shape)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
