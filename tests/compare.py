"""python tests/compare.py [SF_DIR] [NAME...]: every query beside its SQL on DuckDB, by sorted rows."""

from __future__ import annotations

import math
import sys
import tempfile
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def main(sf_dir: str, names: list[str]) -> int:
    import duckdb

    import __spark_entry__
    from lodestream.session import build

    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = build("compare", "local[8]", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g", "spark.sql.warehouse.dir": f"{scratch}/w", "spark.checkpoint.dir": f"{scratch}/s"})
    spark.sparkContext.setLogLevel("OFF")
    db = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    queries, oracles, bad = __spark_entry__.queries(), __spark_entry__.oracle_sql(), 0
    for name in names or queries:
        began = time.time()
        try:
            df = queries[name](spark, sf_dir)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            if name in oracles:
                found = db.execute(oracles[name])
                columns = [c[0] for c in found.description]
                want = rows_of(columns, found.fetchall())
                state = "same" if sorted(columns) == sorted(df.columns) and got == want else f"DIFFERENT {len(want)} rows, {next(((g, w) for g, w in zip(got, want) if g != w), (sorted(df.columns), sorted(columns)))}"
            else:
                state = "no SQL"
        except Exception as e:
            state, got = f"FAILED {str(e)[:400]}", []
        bad += state[0] in "DF"
        print(f"{name}: {len(got)} rows, {time.time() - began:.1f} s, {state}", flush=True)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:] or ["/root/testdata/sf0.01"]
    sys.exit(main(args[0], args[1:]) > 0)
