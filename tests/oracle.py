"""Side-by-side comparison of a registered query with its SQL statement in DuckDB."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, values as text, rows sorted."""
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        s = df[c]
        if pd.api.types.is_datetime64_any_dtype(s):
            df[c] = s.dt.strftime("%Y-%m-%d %H:%M:%S.%f").fillna("NULL")
        elif pd.api.types.is_numeric_dtype(s) and not pd.api.types.is_bool_dtype(s):
            df[c] = s.astype("float64").map(lambda v: "NULL" if pd.isna(v) else repr(round(v, 9) + 0.0))
        else:
            df[c] = s.map(lambda v: "NULL" if v is None or (isinstance(v, float) and pd.isna(v)) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def kinds(df: pd.DataFrame) -> dict[str, str]:
    return {c: df[c].dtype.kind for c in sorted(df.columns)}


def differences(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str:
    """Empty text when both are the same."""
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} vs {len(sql_df)}"
    if len(spark_df) and kinds(spark_df) != kinds(sql_df):
        diff = {c: (k, kinds(sql_df)[c], str(spark_df[c].dtype), str(sql_df[c].dtype))
                for c, k in kinds(spark_df).items() if k != kinds(sql_df)[c]}
        return f"types {diff}"
    a, b = normal(spark_df), normal(sql_df)
    if a.equals(b):
        return ""
    bad = [c for c in a.columns if not a[c].equals(b[c])]
    row = next(i for i in range(len(a)) if tuple(a.iloc[i]) != tuple(b.iloc[i]))
    return f"values in {bad}; row {row}: {a.iloc[row].to_dict()} vs {b.iloc[row].to_dict()}"
