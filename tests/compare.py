"""Compare every registered query with its SQL in DuckDB: python tests/compare.py [names...]"""

import decimal
import math
import os
import sys
import time

import duckdb
import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, np.generic):
        v = v.item()
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return float(v)
    return v


def sort_key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted([tuple(plain(row[c]) for c in cols) for row in df.collect()], key=sort_key)


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(plain(row[i]) for i in order) for row in cur.fetchall()]
    return sorted(names), sorted(rows, key=sort_key)


def verdict(left, right):
    (ca, ra), (cb, rb) = left, right
    if ca != cb:
        return f"COLUMNS {ca} vs {cb}"
    if len(ra) != len(rb):
        return f"ROWS {len(ra)} vs {len(rb)}"
    bad = [(a, b) for a, b in zip(ra, rb) if a != b]
    if not bad:
        return "ok"
    return f"VALUES {len(bad)}/{len(ra)} e.g. {bad[0][0]} vs {bad[0][1]}"


def main(names, sf_dir):
    from foretally.plans.catalogue import load_all
    from foretally.session import get_spark
    spark = get_spark("local[8]")
    spark.sparkContext.setLogLevel("OFF")
    entries = load_all()
    wrong = 0
    for name in [n for n in names if n in entries] or entries:
        e = entries[name]
        start = time.time()
        try:
            got = spark_rows(e.run(spark, sf_dir))
            took = time.time() - start
            word = verdict(got, duck_rows(e.sql, sf_dir)) if e.sql else f"rows-only {len(got[1])}"
            if not got[1]:
                word += " EMPTY"
        except Exception as err:
            took, word = time.time() - start, "ERROR " + str(err).strip()[:700]
        flag = "" if word == "ok" or (word.startswith("rows-only") and "EMPTY" not in word) else "  <<<<"
        wrong += bool(flag)
        print(f"{took:6.2f}s {name}: {word}{flag}", flush=True)
    print(f"{wrong} problem(s)")


if __name__ == "__main__":
    args = [a for a in sys.argv[1:] if not a.startswith("/")]
    dirs = [a for a in sys.argv[1:] if a.startswith("/")]
    main(args, dirs[0] if dirs else "/root/testdata/sf0.01")
