"""Hand-made input rows."""

from __future__ import annotations

from datetime import date, datetime

from footfall.params import DateWindow
from footfall.sources import schemas

WINDOW = DateWindow(date(2025, 1, 1), date(2026, 2, 1))


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def frame(spark, name, rows):
    """A table of the contract ``name`` from dicts; columns left out are NULL."""
    schema = schemas.contract(name)
    known = set(schema.names)
    for row in rows:
        assert set(row) <= known, set(row) - known
    return spark.createDataFrame([tuple(row.get(c) for c in schema.names) for row in rows], schema)


def interactions(spark, rows):
    """Interactions; times are ISO text, person follows visitor, and the visitor flag is set unless given."""
    full = []
    for row in rows:
        row = {"visitor_flag": 1, **row}
        row["interaction_date"] = at(row["interaction_date"]) if row.get("interaction_date") else None
        if "person" not in row and row.get("visitor_id") is not None:
            row["person"] = str(row["visitor_id"])
        full.append(row)
    return frame(spark, "interactions", full)


def hit(key, time, visit=None, **more):
    return {"visitor_id": key, "interaction_date": time, "visit_id": visit, **more}


def keyed(df, key):
    """Rows as dicts by key, which must be unique."""
    rows = [r.asDict() for r in df.collect()]
    out = {r[key]: r for r in rows}
    assert len(out) == len(rows)
    return out
