"""Hand-made packets."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from authsignal.schemas import PACKET

ORIGIN = datetime(2026, 1, 1, tzinfo=timezone.utc)


def packet(capture, frame_no, seconds, nas=(), ngap=(), sctp=(), scheme=None, rand=None, src="10.10.0.30", dst="10.10.0.12", info="", subscriber=None):
    us = round(seconds * 1_000_000)
    return (
        capture,
        frame_no,
        ORIGIN + timedelta(microseconds=us),
        us,
        src,
        dst,
        "NGAP/NAS-5GS",
        list(nas),
        list(ngap),
        list(sctp),
        scheme,
        rand,
        100,
        info,
        subscriber,
    )


def table(spark, rows):
    return spark.createDataFrame(rows, PACKET)
