"""All registered queries of the signal part, with their SQL."""

from __future__ import annotations

from sigflow.plans import linear, models, scalars, signal

QUERIES = {**scalars.QUERIES, **linear.QUERIES, **signal.QUERIES, **models.QUERIES}
SQL = {**scalars.SQL, **linear.SQL, **signal.SQL, **models.SQL}
