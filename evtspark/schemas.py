"""Schemas of the catalogue tables. Everything in the catalogue is text; typed views are made by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

#: Column names of the session table, fixed by its file format.
SESSION_COLUMNS = (
    "expDate expNum expDef expDuration rigName existBlock existTimeline existFrontCam existSideCam existEyeCam existTopCam existMic existEphys "
    "alignBlock alignFrontCam alignSideCam alignEyeCam alignTopCam alignMic alignEphys fMapFrontCam fMapSideCam fMapEyeCam fMapTopCam "
    "issortedPyKS extractSpikes extractEvents expFolder ephysPathProbe0 ephysPathProbe1"
).split()
MAIN_COLUMNS = "Subject IsActive P0_type P0_serial P0_implantDate P0_explantDate P0_AP P0_ML P1_type P1_serial P1_implantDate P1_explantDate P1_AP P1_ML".split()


def strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


SESSIONS, MAIN = strings(SESSION_COLUMNS), strings(MAIN_COLUMNS)
EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
    ]
)
