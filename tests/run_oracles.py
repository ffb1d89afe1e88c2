"""python -m tests.run_oracles [sf_dir] [prefix ...]: compares queries with their oracles and prints times."""

from __future__ import annotations

import sys
import time
import traceback

from pathwise import catalog
from pathwise.session import local_session
from tests.compare import differences, second_engine


def main(sf_dir: str = "/root/testdata/sf0.01", *prefixes: str) -> int:
    spark, con, bad = local_session(cpus=4, memory="4g"), second_engine(sf_dir), 0
    for name, query in catalog.QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        began = time.time()
        try:
            df = query(spark, sf_dir)
            said = differences(df, con, catalog.ORACLES[name]) if name in catalog.ORACLES else f"({df.count()} rows, no oracle)"
        except Exception:
            said = "ERROR " + traceback.format_exc()[-700:]
        bad += bool(said) and not said.startswith("(")
        print(f"{name} {time.time() - began:.1f}s {said or 'ok'}", flush=True)
    print("differences:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(*sys.argv[1:])))
