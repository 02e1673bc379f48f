"""Alert documents -> checked -> stored once per id."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threatlake.contracts import ALERT_SCHEMA
from threatlake.operators.alerts import validate_bodies
from threatlake.session import Scratch, materialise


def accept(bodies: DataFrame, body: str = "body", work: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted alerts as columns with arrival_seq, rejected bodies with their error codes).

    The checked documents are written once, so each is parsed once however often the parts are read;
    the table belongs to ``work`` if given.
    """
    fields = [f for f in ALERT_SCHEMA.fieldNames() if f != "arrival_seq"]
    checked = validate_bodies(bodies, body).withColumn("alert", F.from_json(body, ALERT_SCHEMA))
    chosen = checked.select("arrival_seq", body, "errors", "alert")
    stored = work.table(chosen, "checked") if work else materialise(chosen, "checked")
    good = stored.where(F.size("errors") == 0)
    accepted = good.select(*[F.col(f"alert.{f}") for f in fields], "arrival_seq")
    return accepted, stored.where(F.size("errors") > 0).drop("alert")
