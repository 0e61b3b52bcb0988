"""python -m tidemark STAGE: ingest, silver, gold, dq, ml, load or all."""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Callable
from datetime import UTC, datetime
from typing import Any

from ..session import session
from ..sources import files, rest
from . import config as settings
from . import stages

ALL = ("ingest", "silver", "dq:silver", "gold", "dq:gold", "ml", "load")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    p.add_argument("stage", choices=("ingest", "silver", "gold", "dq", "ml", "load", "all"))
    p.add_argument("--run-id", default=datetime.now(UTC).strftime("run_%Y%m%dT%H%M%SZ"))
    p.add_argument("--layer", choices=("silver", "gold"), default="gold", help="of dq")
    p.add_argument("--full-refresh", action="store_true")
    p.add_argument("--snapshot-at", help="UTC timestamp that ages are taken at")
    return p


def main(argv: list[str] | None = None, spark=None, transport: rest.Transport | None = None) -> dict[str, Any]:
    args = parser().parse_args(argv)
    config = settings.load()
    spark = spark or session()
    steps: dict[str, Callable[[], Any]] = {
        "ingest": lambda: rest.ingest(spark, config, args.run_id, datetime.now(UTC), transport),
        "silver": lambda: stages.silver(spark, config, args.run_id, args.full_refresh),
        "gold": lambda: stages.gold(spark, config, args.run_id, args.snapshot_at, args.full_refresh),
        "dq:silver": lambda: [vars(r) for r in stages.check(spark, config, "silver")],
        "dq:gold": lambda: [vars(r) for r in stages.check(spark, config, "gold")],
        "ml": lambda: stages.scores(spark, config, args.run_id),
        "load": lambda: stages.load(spark, config),
    }
    names = ALL if args.stage == "all" else (f"dq:{args.layer}",) if args.stage == "dq" else (args.stage,)
    summary: dict[str, Any] = {"run_id": args.run_id, "stages": {}}
    for name in names:
        began = time.monotonic()
        summary["stages"][name] = {"result": steps[name](), "seconds": round(time.monotonic() - began, 2)}
    files.write_json(spark, f"{config['state_root']}/runs/{args.run_id}.json", summary)
    print(json.dumps(summary, default=str))
    return summary
