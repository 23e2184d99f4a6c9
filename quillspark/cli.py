"""python -m quillspark.cli VERB ...: scan, run, status, explain, bundle, verify, merge. JSON on stdout.

Exit codes: 0 done, 1 could not complete, 2 usage, 3 refused.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from quillspark.plans import bundle, formats, run
from quillspark.sources.shard import ShardError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspark")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb, names in {
        "scan": ["root"], "run": ["root", "mirror", "manifest", "division"], "status": ["manifest"], "explain": ["manifest", "source"],
        "bundle": ["mirror", "manifest", "division", "out"], "verify": ["bundle"], "merge": ["out"],
    }.items():
        v = verbs.add_parser(verb)
        for n in names:
            v.add_argument(n)
        if verb == "merge":
            v.add_argument("inputs", nargs="+")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    spark = spark or SparkSession.builder.appName("quillspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    verbs = {
        "scan": lambda: run.scan(spark, a.root),
        "run": lambda: run.run(spark, a.root, a.mirror, a.manifest, a.division),
        "status": lambda: run.status(spark, a.manifest),
        "explain": lambda: run.explain(spark, a.manifest, a.source),
        "bundle": lambda: bundle.bundle(spark, a.mirror, a.manifest, a.division, a.out),
        "verify": lambda: bundle.verify(spark, a.bundle),
        "merge": lambda: bundle.merge(spark, a.inputs, a.out),
    }
    try:
        print(json.dumps(verbs[a.verb](), indent=1, ensure_ascii=False))
        return 0
    except (bundle.Refused, run.Refused, formats.RulesError) as e:
        print(json.dumps({"refused": str(e)}, ensure_ascii=False), file=sys.stderr)
        return 3
    except (OSError, ShardError, ValueError) as e:
        print(json.dumps({"failed": str(e)}, ensure_ascii=False), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
