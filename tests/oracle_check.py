"""Compare queries with their SQL: ``python tests/oracle_check.py SF_DIR [query ...]``."""

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from dispatchmart.catalog.inputs import TABLES  # noqa: E402
from dispatchmart.catalog.oracles import ORACLES  # noqa: E402
from dispatchmart.catalog.queries import QUERIES  # noqa: E402


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _rows(frame):
    """Rows as tuples of texts, columns by name, numbers alike whatever their width."""

    def plain(value):
        if value is None or (isinstance(value, float) and math.isnan(value)):
            return None
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            return str(value)
        return format(float(value), ".10g")

    names = sorted(frame[0])
    order = [frame[0].index(name) for name in names]
    return names, Counter(tuple(plain(row[i]) for i in order) for row in frame[1])


def compare(spark, con, name, sf_dir):
    """An error text, or an empty one when rows and columns agree."""
    df = QUERIES[name](spark, sf_dir)
    got = _rows((df.columns, [tuple(row) for row in df.collect()]))
    result = con.execute(ORACLES[name])
    want = _rows(([d[0] for d in result.description], result.fetchall()))
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        extra, missing = got[1] - want[1], want[1] - got[1]
        return (
            f"{sum(got[1].values())} rows, {sum(want[1].values())} expected; "
            f"extra {list(extra)[:3]}, missing {list(missing)[:3]}"
        )
    return "" if got[1] else "no rows"


if __name__ == "__main__":
    from dispatchmart.session import build_session

    session = build_session("check", "local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8"})
    session.sparkContext.setLogLevel("ERROR")
    con = connect(sys.argv[1])
    for name in sys.argv[2:] or QUERIES:
        began = time.time()
        try:
            problem = compare(session, con, name, sys.argv[1])
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name}: {problem or 'ok'} ({time.time() - began:.1f} s)", flush=True)
