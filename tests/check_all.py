"""Compare catalogue queries with their SQL: python tests/check_all.py SF_DIR [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
sys.path.insert(0, os.path.dirname(__file__))

from compare import compare, duck

from stforecast.plans.catalog import ORACLES, QUERIES
from stforecast.session import local_session


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf_dir)
    failed = 0
    for name, job in QUERIES.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            df = job(spark, sf_dir)
            if name in ORACLES:
                problem = compare(df, con, ORACLES[name])
            else:
                problem = None if df.count() > 0 else "no rows"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
