"""python tests/llm/check_llm.py [name-prefix ...]: compare the text queries with their SQL at sf0.01."""

import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from compare import compare  # noqa: E402

from sondage.llm.queries import CHECKS, QUERIES  # noqa: E402
from sondage.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    for name, fn in QUERIES.items():
        if sys.argv[1:] and not any(name.startswith(w) for w in sys.argv[1:]):
            continue
        start = time.time()
        n, problems = compare(spark, sf_dir, fn, CHECKS[name]) if name in CHECKS else (fn(spark, sf_dir).count(), [])
        print("FAIL" if problems else "ok", name, n, f"{time.time() - start:.1f}s", *[str(p)[:600] for p in problems], flush=True)
