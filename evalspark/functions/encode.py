"""Rows of any schema as one comparable, sortable column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from evalspark.functions.compare import close, is_tolerant, nan_to_null

NUMBER, DECIMAL = "number", "decimal"


def _kind(dtype: T.DataType) -> str:
    if is_tolerant(dtype):
        return NUMBER
    return DECIMAL if isinstance(dtype, T.DecimalType) else dtype.simpleString()


def encode_cell(value: Column, dtype: T.DataType) -> Column:
    """(missing, num, txt, kind): sorts by value, missing last.

    Integers beyond 2**53 fall back on their text to break ties in the order,
    which both sides do alike.
    """
    present, kind = nan_to_null(value, dtype), _kind(dtype)
    if kind in (NUMBER, DECIMAL):
        number, text = present.cast("double"), present.cast("string")
        if kind == DECIMAL:
            text = F.regexp_replace(text, r"\.?0*\z", "") if dtype.scale else text
    else:
        nested = isinstance(dtype, (T.ArrayType, T.StructType, T.MapType))
        number, text = F.lit(None).cast("double"), (F.to_json(present) if nested else present.cast("string"))
    return F.struct(
        present.isNull().cast("int").alias("missing"),
        number.alias("num"),
        text.alias("txt"),
        F.lit(kind).alias("kind"),
    )


def encode_rows(frame: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns plus ``cells``: all other columns in order, encoded."""
    keep = keep or []
    fields = [f for f in frame.schema.fields if f.name not in keep]
    cells = [encode_cell(F.col(f"`{f.name}`"), f.dataType) for f in fields]
    return frame.select(*keep, F.array(*cells).alias("cells"))


def encoded_match(a: Column, b: Column) -> Column:
    """Cell-wise tolerant, null-safe equality of two encoded rows."""

    def cell(x: Column, y: Column) -> Column:
        numeric = x["kind"].isin(NUMBER, DECIMAL) & y["kind"].isin(NUMBER, DECIMAL)
        same = (
            F.when((x["kind"] == NUMBER) & (y["kind"] == NUMBER), close(x["num"], y["num"]))
            .when((x["kind"] == DECIMAL) & (y["kind"] == DECIMAL), x["txt"] == y["txt"])
            .when(numeric, x["num"] == y["num"])
            .otherwise((x["kind"] == y["kind"]) & (x["txt"] == y["txt"]))
        )
        return F.coalesce(same, (x["missing"] == 1) & (y["missing"] == 1))

    return F.forall(F.zip_with(a, b, cell), lambda ok: ok)


def encoded_identical(a: Column, b: Column) -> Column:
    """Exact equality of two encoded rows; a missing cell differs from everything."""

    def cell(x: Column, y: Column) -> Column:
        numeric = x["kind"].isin(NUMBER, DECIMAL) & y["kind"].isin(NUMBER, DECIMAL)
        return F.coalesce(
            F.when(numeric & (x["kind"] != y["kind"]), x["num"] == y["num"])
            .when(x["txt"] == y["txt"], F.lit(True))
            .otherwise(numeric & (x["kind"] == NUMBER) & (x["num"] == y["num"])),
            F.lit(False),
        )

    return F.forall(F.zip_with(a, b, cell), lambda ok: ok)
