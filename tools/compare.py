"""Run queries next to their SQL twins and compare columns, types and values.

usage: python tools/compare.py SF_DIR [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from nomenlink.bindings import TABLES  # noqa: E402
from nomenlink.checks import ORACLES, QUERIES  # noqa: E402

KINDS = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
    "float": "FLOAT", "timestamp": "TIMESTAMP",
}


def twin(sf_dir: str, sql: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    result = con.execute(sql)
    columns = [(d[0], str(d[1])) for d in result.description]
    return columns, result.fetchall()


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return "\0" if value is None else str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, sf_dir: str, name: str) -> tuple[bool, str]:
    df = QUERIES[name](spark, sf_dir)
    columns = [f.name for f in df.schema.fields]
    got = [tuple(row) for row in df.collect()]
    if name not in ORACLES:
        return True, f"{len(got)} rows, no twin"
    expected_columns, expected = twin(sf_dir, ORACLES[name])
    kinds = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    if kinds != dict(expected_columns):
        return False, f"columns {sorted(kinds.items())} against {sorted(expected_columns)}"
    mine, theirs = _rows(columns, got), _rows([c for c, _ in expected_columns], expected)
    if mine != theirs:
        only_mine, only_theirs = sorted(set(mine) - set(theirs)), sorted(set(theirs) - set(mine))
        return False, (
            f"{len(mine)} rows against {len(theirs)}; only here {len(only_mine)} {only_mine[:3]}; "
            f"only there {len(only_theirs)} {only_theirs[:3]}"
        )
    return True, f"{len(mine)} rows"


def main() -> int:
    from nomenlink.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:] or sorted(QUERIES)
    spark = build_session(
        "compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="12g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    failed = []
    for name in names:
        start = time.time()
        try:
            good, note = compare(spark, sf_dir, name)
        except Exception as error:  # keep going: one report for all queries
            good, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        print(f"{'ok  ' if good else 'FAIL'} {name} {time.time() - start:.1f}s {note[:1800]}", flush=True)
        if not good:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} agree; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
