"""Compare every registered query with DuckDB on one data folder.

    python tests/oracle_check.py [folder] [query ...]
"""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _canonical(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, values as text, rows in order."""
    out = pd.DataFrame({
        c: [
            "\0" if v is None or v is pd.NA or v != v else repr(float(v)) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
            for v in frame[c].tolist()
        ]
        for c in sorted(frame.columns)
    })
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def compare(spark, con, name, folder):
    """None when equal, else a short description of the first difference."""
    df = entry.queries()[name](spark, folder)
    columns = df.columns
    left = _canonical(pd.DataFrame(df.toArrow().to_pylist(), columns=columns))
    sql = entry.oracle_sql()[name]
    rows = con.execute(sql).to_arrow_table().to_pylist()
    names = [d[0] for d in con.description]
    right = _canonical(pd.DataFrame(rows, columns=names))
    if list(left.columns) != list(right.columns):
        return f"columns {set(left.columns) ^ set(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    if len(left) == 0:
        return "no rows"
    for c in left.columns:
        different = left[c] != right[c]
        if different.any():
            i = different.idxmax()
            return f"{c}: {different.sum()} differ, {dict(left.loc[i])} != {dict(right.loc[i])}"[:900]
    return None


def main():
    from reelshelf.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    names = sys.argv[2:] or list(entry.queries())
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, name, folder)
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")
    sys.exit(bad > 0)


if __name__ == "__main__":
    main()
