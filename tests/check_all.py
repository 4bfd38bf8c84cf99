"""Run queries against their SQL from the command line: check_all.py SF [name…]."""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry  # noqa: E402
from oracle import connect, spark_rows, sql_rows, type_differences  # noqa: E402
from parlova.runtime import build_session  # noqa: E402


def main() -> int:
    sf = sys.argv[1]
    sf_dir = f"/root/testdata/sf{sf}"
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    spark = build_session(master="local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    failed = []
    for name in names:
        started = time.time()
        try:
            df = queries[name](spark, sf_dir)
            columns, rows = spark_rows(df)
            took = time.time() - started
            if name not in oracle:
                print(f"{name:34s} rows={len(rows):6d} {took:6.1f}s  rows only", flush=True)
                continue
            started = time.time()
            want_columns, want = sql_rows(con, oracle[name])
            sql_took = time.time() - started
            ok = columns == want_columns and rows == want
            print(f"{name:34s} rows={len(rows):6d} {took:6.1f}s sql {sql_took:5.1f}s  {'ok' if ok else 'DIFFERENT'}", flush=True)
            odd = type_differences(con, df, oracle[name])
            if odd:
                print("   types", odd)
            if not ok:
                failed.append(name)
                print("   columns", columns, want_columns, "n", len(rows), len(want))
                only_spark = [r for r in rows if r not in set(want)][:4] if columns == want_columns else []
                only_sql = [r for r in want if r not in set(rows)][:4] if columns == want_columns else []
                print("   spark only", str(only_spark)[:900])
                print("   sql only  ", str(only_sql)[:900])
        except Exception:
            failed.append(name)
            print(f"{name:34s} ERROR", traceback.format_exc().strip().replace("^","")[-1200:], flush=True)
    print("failed:", failed)
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())
