"""Short name lists built without lambdas, so that the projection stays in whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def listed(*pairs: tuple[Column, str]) -> Column:
    """Names whose condition holds, in order, as an array. Names hold no comma."""
    if odd := [name for _, name in pairs if "," in name or name == ""]:
        raise ValueError(f"names that are empty or hold a comma: {odd}")
    if not pairs:
        return F.array().cast("array<string>")
    text = F.concat_ws(",", *[F.when(hit, F.lit(name)) for hit, name in pairs])
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ","))
