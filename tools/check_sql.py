"""Run registered queries on Spark and their SQL on DuckDB and compare the results.

usage: python tools/check_sql.py [--sf DIR] [--only NAME,NAME] [--match TEXT]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from panelforge.plans.catalog import QUERIES  # noqa: E402
from panelforge.plans.market import TABLES  # noqa: E402
from panelforge.session import local_session  # noqa: E402


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].dt.strftime("%Y-%m-%d")
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT or v != v else str(v)[:10] if hasattr(v, "year") else v)
    return df.sort_values(list(df.columns), na_position="first", key=lambda s: s.astype(str)).reset_index(drop=True)


def compare(a: pd.DataFrame, b: pd.DataFrame) -> str:
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} vs {sorted(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    a, b = canonical(a), canonical(b)
    for c in a.columns:
        ka, kb = a[c].dtype.kind, b[c].dtype.kind
        if ka != kb and {ka, kb} & {"f", "i", "b", "O"} and not (a[c].isna().any() or b[c].isna().any()):
            return f"type of {c}: {a[c].dtype} vs {b[c].dtype}"
        if a[c].dtype != b[c].dtype and ka == kb == "i":
            return f"width of {c}: {a[c].dtype} vs {b[c].dtype}"
        na, nb = a[c].isna(), b[c].isna()
        if (na != nb).any():
            i = (na != nb).idxmax()
            return f"null in {c}: {a.loc[i].to_dict()} vs {b.loc[i].to_dict()}"
        bad = (a[c] != b[c]) & ~na
        if bad.any():
            i = bad.idxmax()
            return f"{int(bad.sum())} values of {c}: {a.loc[i].to_dict()} vs {b.loc[i].to_dict()}"
    return ""


def main() -> int:
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="/root/testdata/sf0.01")
    p.add_argument("--only", default="")
    p.add_argument("--match", default="")
    args = p.parse_args()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    spark = local_session()
    names = args.only.split(",") if args.only else [n for n in QUERIES if args.match in n]
    failed = []
    for name in names:
        q = QUERIES[name]
        t0 = time.time()
        try:
            got = q.run(spark, args.sf).toPandas()
            t1 = time.time()
            sql = q.full_sql()
            verdict = compare(got, con.execute(sql).df()) if sql else "no sql"
            if not len(got):
                verdict += " EMPTY"
        except Exception as e:  # report and go on with the next query
            t1, verdict, got = time.time(), f"{type(e).__name__}: {str(e)[:700]}", ()
        spark.catalog.clearCache()
        if verdict not in ("", "no sql"):
            failed.append(name)
        print(f"{'ok ' if not verdict else verdict if verdict == 'no sql' else 'BAD'} {name} rows={len(got)} spark={t1 - t0:.1f}s sql={time.time() - t1:.1f}s {verdict if verdict != 'no sql' else ''}", flush=True)
    print(f"{len(names)} queries, {len(failed)} bad: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
