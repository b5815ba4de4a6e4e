"""Run registered queries and compare them with their SQL on DuckDB.

    python tests/oracle.py [sf_dir] [name or prefix ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FOLDER = "/root/testdata/sf0.01"


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return repr(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(str(norm(r[i])) for i in order) for r in data])


def spark_rows(df):
    return df.columns, [tuple(r) for r in df.collect()]


def duck_rows(con, text):
    cur = con.execute(text)
    return [d[0] for d in cur.description], cur.fetchall()


def compare(df, con, text) -> tuple[bool, str]:
    mine, got = spark_rows(df)
    theirs, want = duck_rows(con, text)
    if sorted(mine) != sorted(theirs):
        return False, f"columns {sorted(mine)} vs {sorted(theirs)}"
    a, b = rows(mine, got), rows(theirs, want)
    if len(a) != len(b):
        return False, f"{len(a)} rows vs {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return False, f"{x} vs {y}"[:600]
    return True, f"{len(a)} rows"


def main() -> int:
    import __spark_entry__ as entry
    from postloom.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else FOLDER
    wanted = sys.argv[2:]
    spark = build_session(
        "oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    texts, bad = entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = build(spark, folder)
            if name in texts:
                ok, note = compare(df, con, texts[name])
            else:
                ok, note = True, f"{len(df.collect())} rows, no oracle"
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
