"""Run registered queries against their oracle SQL: ``python tests/check_oracles.py [sf] [names...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle import connect, difference  # noqa: E402

from marketlens.plans import load  # noqa: E402
from marketlens.session import local_session  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    queries, oracles = load()
    names = sys.argv[2:] or list(queries)
    names = [q for q in queries if any(q == n or (n.endswith("*") and q.startswith(n[:-1])) for n in names)]
    spark, con, bad = local_session(), connect(sf_dir), 0
    for name in names:
        t0 = time.time()
        try:
            ours = queries[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:1500]}", flush=True)
            continue
        t1 = time.time()
        if name not in oracles:
            print(f"rows {name}: {len(ours)} rows {t1 - t0:.1f}s", flush=True)
            continue
        try:
            diff = difference(ours, con.execute(oracles[name]).df())
        except Exception as e:  # noqa: BLE001
            diff = f"oracle: {e}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {name}: {len(ours)} rows spark {t1 - t0:.1f}s duckdb {time.time() - t1:.1f}s {diff or ''}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
