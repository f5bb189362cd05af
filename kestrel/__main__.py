"""``python -m kestrel --configuration_filename run.json`` (or ``spark-submit``): one configured run.

The session comes from the environment (spark-submit / cluster defaults); nothing is set here
except what the session lacks.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from kestrel.config import RunConfig
from kestrel.plans.run import record_json, run
from kestrel.session import ship_package


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="kestrel", description="Spark classification pipeline run")
    ap.add_argument("--configuration_filename", required=True, help="JSON run configuration")
    args = ap.parse_args(argv)
    cfg = RunConfig.from_json(args.configuration_filename)
    spark = SparkSession.builder.appName(f"kestrel-{cfg.dataset_name}").getOrCreate()
    ship_package(spark)
    res = run(spark, cfg)
    print(record_json(res))
    print(json.dumps({"run": res.run_name, "C": res.C, "gamma": res.gamma, **res.performance}))


if __name__ == "__main__":
    main()
