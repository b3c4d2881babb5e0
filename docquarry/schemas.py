"""Zones of a document, and the names of the stored tables."""

from __future__ import annotations

#: Zones in their order, with the weight of each in the score.
ZONES = {"Title": 0.5, "Abstract": 0.25, "Claims": 0.15, "Description": 0.1}
#: Zone name to column.
ZONE_COLUMNS = {z: z.lower() for z in ZONES}
