"""Compare the Spark mapping of the test data (``sources/fixture.py``) with
its independent DuckDB version (``sqloracle/fixture.py``), table by table.

usage: python scripts/check_fixture.py [sf_dir]
"""

from __future__ import annotations

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from clinicledger.session import get_spark  # noqa: E402
from clinicledger.sources.fixture import fixture_tables  # noqa: E402
from clinicledger.sources.tables import Tables  # noqa: E402
from scripts.compare import compare, duck_connect  # noqa: E402
from sqloracle.fixture import FIXTURE_CTE  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", 8)
    t = fixture_tables(spark, sf_dir)
    con = duck_connect(sf_dir)
    failed = 0
    for name in Tables.names():
        res = compare(t.table(name), con, FIXTURE_CTE + f" SELECT * FROM {name}")
        ok = res["columns_match"] and res["rows_match"] and res["values_match"]
        failed += not ok
        print(json.dumps({"table": name, "ok": ok, **res}, default=str))
    print(json.dumps({"failed": failed, "total": len(Tables.names())}))
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
