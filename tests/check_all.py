"""Runs registered queries against their SQL: python tests/check_all.py [sf] [prefix …]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry  # noqa: E402
from oracle import connect, differences  # noqa: E402
from wardline.session import build_session  # noqa: E402

if __name__ == "__main__":
    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    wanted = sys.argv[2:]
    spark = build_session(cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles = connect(sf_dir), entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                result = differences(query(spark, sf_dir), con, oracles[name]) or "ok"
            else:
                result = f"rows={len(query(spark, sf_dir).collect())} (no SQL)"
        except Exception as error:  # noqa: BLE001
            result = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        if result != "ok" and not str(result).startswith("rows="):
            bad += 1
        print(f"{name:28s} {time.time() - start:6.2f}s  {result}", flush=True)
    print("bad:", bad)
    spark.stop()
