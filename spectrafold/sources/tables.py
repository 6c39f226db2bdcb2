"""Result tables: chosen columns, caps, decimals and matrix slices, to a DataFrame or a file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def output_table(df: DataFrame, columns: list[str] | None = None, max_rows: int | None = None,
                 max_cols: int | None = None, decimals: int | None = None, order: str = "ix") -> DataFrame:
    """Array columns become one column per place (name_1, name_2, …).

    The caps are the report's own setting; without them the whole table comes out.
    """
    columns = columns or df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    widths = {c: None for c in columns if isinstance(types.get(c), T.ArrayType)}
    if widths:
        first = df.agg(*[F.max(F.size(c)).alias(c) for c in widths]).first()
        widths = {c: first[c] or 0 for c in widths}
    out = []
    for c in columns:
        if c in widths:
            out += [(F.get(c, F.lit(i)), f"{c}_{i + 1}", types[c].elementType) for i in range(widths[c])]
        elif c in types:
            out.append((F.col(c), c, types[c]))
        else:  # a path into a struct, or a place of an array: a.b, a.0
            out.append((nested(df, c), c.replace(".", "_"), None))
    if max_cols is not None:
        out = out[:max_cols]
    if max_rows is not None and order in df.columns:
        df = df.orderBy(order).limit(max_rows)
    fine = (T.DoubleType, T.FloatType)
    return df.select(*[(F.round(e, decimals) if decimals is not None and isinstance(t, fine) else e).alias(n)
                       for e, n, t in out])


def nested(df: DataFrame, path: str):
    """Column expression of a dotted path; a number is a 0-based place in an array."""
    first, *rest = path.split(".")
    out = F.col(first)
    for part in rest:
        out = F.get(out, F.lit(int(part))) if part.isdigit() else out[part]
    return out


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Parquet keeps all types; csv takes flat columns."""
    if kind == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").parquet(path)
