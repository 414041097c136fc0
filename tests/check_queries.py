"""python tests/check_queries.py [name-prefix ...]: compare queries with their SQL at sf0.01."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import compare  # noqa: E402

from sondage.plans.catalog import CHECKS, QUERIES  # noqa: E402
from sondage.session import local_session  # noqa: E402


def main():
    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = local_session()
    failed = []
    for name, fn in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in CHECKS:
                n, problems = compare(spark, sf_dir, fn, CHECKS[name])
            else:
                n, problems = fn(spark, sf_dir).count(), []
        except Exception as exc:  # report and go on with the next query
            n, problems = -1, [f"{type(exc).__name__}: {str(exc)[:700]}"]
        if problems:
            failed.append(name)
        print(f"{'FAIL' if problems else 'ok  '} {name:28s} rows={n} {time.time() - start:.2f}s", *problems, flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
