"""python tests/check_queries.py [sf_dir] [names...]: compare all registered queries with their SQL."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry
from oracle import connect, differences

from trafficlens.session import local_session


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = local_session(8), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, query in queries.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in oracles:
                problems = differences(query(spark, sf_dir), con, oracles[name])
                kind = "sql"
            else:
                kind, problems = f"{len(query(spark, sf_dir).collect())} rows", []
        except Exception as error:  # report and go on with the next query
            kind, problems = "error", [f"{type(error).__name__}: {str(error)[:1500]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} [{kind}] {time.time() - start:.1f}s", flush=True)
        for p in problems:
            print("     ", p[:1200])
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(min(main(), 1))
