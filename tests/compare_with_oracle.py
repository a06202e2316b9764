"""Compare registered queries with their oracle SQL.

python tests/compare_with_oracle.py [sf] [name-prefix ...]
"""

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from __spark_entry__ import oracle_sql, queries  # noqa: E402
from marquee.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 5)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def main():
    folder = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    prefixes = tuple(sys.argv[2:])
    spark = local_session(8, **{'spark__ui__showConsoleProgress': 'false'})
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    sqls, bad = oracle_sql(), []
    for name, build in queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        t0 = time.time()
        try:
            df = build(spark, folder)
            got = [tuple(r) for r in df.collect()]
        except Exception as e:
            print(f"ERROR {name}: {str(e)[:700]}")
            if len(prefixes):
                print(''.join(traceback.format_tb(e.__traceback__)[-3:])[:900])
            bad.append(name)
            continue
        took = time.time() - t0
        if name not in sqls:
            print(f"rows  {name}: {len(got)} rows {took:.1f}s")
            if not got:
                bad.append(name)
            continue
        try:
            cur = con.execute(sqls[name])
            names = [d[0] for d in cur.description]
            kinds = {d[0]: str(d[1]) for d in cur.description}
            want = cur.fetchall()
        except Exception as e:
            print(f"SQLERR {name}: {str(e)[:900]}")
            bad.append(name)
            continue
        if sorted(names) != sorted(df.columns):
            print(f"COLS  {name}: {sorted(df.columns)} vs {sorted(names)}")
            bad.append(name)
            continue
        loose = [c for c, k in kinds.items() if k in ("HUGEINT", "INTEGER", "DECIMAL")
                 or k.startswith("DECIMAL") or "INT128" in k]
        mine = [c for c, k in df.dtypes if k not in ("string", "bigint", "double", "boolean")]
        a, b = rows_of(df.columns, got), rows_of(names, want)
        if a != b:
            bad.append(name)
            print(f"DIFF  {name}: {len(a)} vs {len(b)} rows")
            sa, sb = set(a), set(b)
            print("   only spark ", [x for x in a if x not in sb][:3])
            print("   only oracle", [x for x in b if x not in sa][:3])
        else:
            flag = "" if a else " EMPTY"
            if loose or mine:
                flag += f" types oracle={loose} spark={mine}"
            print(f"ok    {name}: {len(a)} rows {took:.1f}s{flag}")
    print("BAD", bad)


if __name__ == "__main__":
    main()
