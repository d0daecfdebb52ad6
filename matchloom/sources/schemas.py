"""Declared schemas of the tables at the edges of a job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

EVENTS = "event_id long, user_id long, event_type string, value double"
BALL_FRAMES = "match_id long, frame_idx long, ball_source string, ball_pitch_x double, ball_pitch_y double, carrier_track_id long, carrier_team long, possession_team long"
PLAYER_FRAMES = "match_id long, frame_idx long, track_id long, role string, team long, pitch_x double, pitch_y double, is_carrier boolean, attack_direction int"


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema`` in its order; a missing column or one of another type is an error, more are left out."""
    want = StructType.fromDDL(schema)
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f"{f.name}: {have[f.name].simpleString() if f.name in have else 'missing'}, not {f.dataType.simpleString()}" for f in want.fields if have.get(f.name) != f.dataType]
    if wrong:
        raise TypeError("; ".join(wrong))
    return df.select(*(f.name for f in want.fields))
