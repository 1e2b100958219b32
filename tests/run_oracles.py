"""Developer tool: run queries against their oracles. Usage: run_oracles.py SF_DIR [name or prefix ...]"""

import sys
import time
import traceback

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")

from oracle_compare import compare, duck  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from tablecloak.session import build_session  # noqa: E402

sf, wanted = sys.argv[1], sys.argv[2:]
spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                            "spark.ui.showConsoleProgress": "false"})
spark.sparkContext.setLogLevel("ERROR")
qs, os_ = E.queries(), E.oracle_sql()
con = duck(sf)
bad = 0
for name, fn in qs.items():
    if wanted and not any(name.startswith(w) for w in wanted):
        continue
    t0 = time.time()
    try:
        df = fn(spark, sf)
        note = compare(df, con, os_[name]) if name in os_ else f"rows-only: {df.count()}"
        ok = name not in os_ or note is None
    except Exception as e:  # noqa: BLE001
        ok, note = False, "".join(traceback.format_exception_only(type(e), e))[:900]
    bad += not ok
    print(f"{'ok ' if ok else 'BAD'} {time.time() - t0:6.2f}s {name} {note or ''}", flush=True)
print("bad:", bad, "of", len(qs))
