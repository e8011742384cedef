"""Run registered queries beside their SQL: python tests/check.py [sf] [name ...]"""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import TESTDATA, duck, duck_rows, spark_rows, type_names

import __spark_entry__ as contract
from loomtext.session import local_session

MATCHING = {
    "bigint": {"BIGINT"},
    "string": {"VARCHAR"},
    "double": {"DOUBLE"},
    "boolean": {"BOOLEAN"},
    "int": {"INTEGER"},
}

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"{TESTDATA}/sf{sf}"
    connection = duck(folder)
    queries, oracles = contract.queries(), contract.oracle_sql()
    names = [n for n in queries if not sys.argv[2:] or any(n.startswith(a) for a in sys.argv[2:])]
    failed = []
    for name in names:
        started = time.time()
        try:
            df = queries[name](spark, folder)
            columns, rows = spark_rows(df)
            took = time.time() - started
            if name not in oracles:
                print(f"{name}: {len(rows)} rows, no SQL, {took:.1f}s", flush=True)
                continue
            want_columns, want = duck_rows(connection, oracles[name])
            verdict = "ok" if (columns, rows) == (want_columns, want) else "DIFFERENT"
            spark_types, duck_types = type_names(df, connection, oracles[name])
            odd = [
                (c, spark_types[c], duck_types.get(c))
                for c in spark_types
                if duck_types.get(c) not in MATCHING.get(spark_types[c], {duck_types.get(c)})
            ]
            print(f"{name}: {verdict} {len(rows)}/{len(want)} rows {took:.1f}s {odd or ''}", flush=True)
            if verdict != "ok":
                failed.append(name)
                print("  ", columns, want_columns)
                left = [r for r in rows if r not in set(want)][:2] if len(rows) < 20000 else rows[:2]
                right = [r for r in want if r not in set(rows)][:2] if len(want) < 20000 else want[:2]
                print("   spark", str(left)[:600])
                print("   duck ", str(right)[:600])
        except Exception as error:
            failed.append(name)
            print(f"{name}: ERROR {str(error)[:1200]}", flush=True)
            traceback.print_exc(limit=3)
    print(f"{len(names)} queries, {len(failed)} failed: {failed}")
