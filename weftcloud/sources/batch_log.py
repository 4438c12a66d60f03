"""Framed batch logs and mixed message streams.

A frame is magic, header length, payload length and CRC-32 of header and payload (four little-endian u32), a JSON header, the payload.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

MAGIC = 0x4C564350
HEAD_BYTES = 16
BLOCK = 8 << 20
RECORDS = "path string, log_offset long, end_offset long, header string, payload binary, truncated_bytes long"
HEADER = "struct<session_id:string,sequence:bigint,pose_sequence:bigint,timestamp:string,point_count:int,point_format:string,pose:struct<translation_m:array<double>,rotation_xyzw:array<double>>>"


def frame(header: dict, payload: bytes) -> bytes:
    text = json.dumps(header, separators=(",", ":")).encode()
    return struct.pack("<4I", MAGIC, len(text), len(payload), zlib.crc32(payload, zlib.crc32(text))) + text + payload


def records(data: bytes, start: int = 0) -> Iterator[tuple[int, int, str, bytes]]:
    """(offset, end, header, payload) up to the first torn or damaged frame."""
    at = start
    while at + HEAD_BYTES <= len(data):
        magic, head, body, crc = struct.unpack_from("<4I", data, at)
        end = at + HEAD_BYTES + head + body
        if magic != MAGIC or end > len(data) or zlib.crc32(memoryview(data)[at + HEAD_BYTES : end]) != crc:
            return
        cut = at + HEAD_BYTES + head
        yield at, end, data[at + HEAD_BYTES : cut].decode("utf-8", "replace"), data[cut:end]
        at = end


def scan_log(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """Records of log files (one file is read in order by one task) from an offset; a last row without header tells how many bytes are cut."""
    return split_frames(spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(path), start)


def split_frames(files: DataFrame, start: int = 0) -> DataFrame:
    """files: (path, content). Records of many short files go on together, 1,024 or BLOCK bytes of payload at a time."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for part in parts:
            for path, content in zip(part.column(0), part.column(1), strict=True):
                path, data = path.as_py(), content.as_py()
                end = min(start, len(data))
                for at, end, head, body in records(data, start):  # noqa: B007
                    rows.append((path, at, end, head, body, None))
                    size += len(body)
                    if len(rows) == 1024 or size >= BLOCK:
                        yield _batch(rows)
                        rows, size = [], 0
                if end < len(data):
                    rows.append((path, end, end, None, None, len(data) - end))
        if rows:
            yield _batch(rows)

    return files.select("path", "content").mapInArrow(run, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in RECORDS.split(", ")])


def bronze(found: DataFrame) -> DataFrame:
    """Typed batches of the intact records; a header without format means the first one."""
    h = F.from_json("header", HEADER)
    t, q = h["pose"]["translation_m"], h["pose"]["rotation_xyzw"]
    pose = F.struct(*[F.get(t, F.lit(k)).alias(n) for k, n in enumerate(("tx", "ty", "tz"))], *[F.get(q, F.lit(k)).alias(n) for k, n in enumerate(("qx", "qy", "qz", "qw"))])
    return found.where("header is not null").select(
        h["session_id"].alias("session_id"), h["sequence"].alias("sequence"), h["pose_sequence"].alias("pose_sequence"), h["timestamp"].alias("ts"), h["point_count"].alias("point_count"),
        F.coalesce(h["point_format"], F.lit("xyz_rgb_i_v1")).alias("point_format"), pose.alias("pose"), "payload", "log_offset", "end_offset", "path",
    )


def lookup(batches: DataFrame, session_id: str, sequence: int) -> DataFrame:
    """One record by its key; min/max statistics of the bronze files prune the rest."""
    return batches.where((F.col("session_id") == session_id) & (F.col("sequence") == sequence))


@pandas_udf(BinaryType())
def frame_of(header: pd.Series, payload: pd.Series) -> pd.Series:
    """Encodes records."""
    return pd.Series([struct.pack("<4I", MAGIC, len(h.encode()), len(p), zlib.crc32(p, zlib.crc32(h.encode()))) + h.encode() + p for h, p in zip(header, payload, strict=True)])


def u32(data: Column, at: int) -> Column:
    """Little-endian unsigned integer at a byte position."""
    return F.conv(F.concat(*[F.hex(F.substring(data, at + k, 1)) for k in (4, 3, 2, 1)]), 16, 10).cast("bigint")


def message_kind(message: Column) -> Column:
    """batch for an intact frame whose header is JSON, the type (a string) of a JSON control message, else invalid."""
    size = F.octet_length(message)
    value = F.try_parse_json(message.cast("string"))
    kind = F.when(F.schema_of_variant(F.try_variant_get(value, "$.type", "variant")) == "STRING", F.try_variant_get(value, "$.type", "string"))
    body = F.substring(message, HEAD_BYTES + 1, 2**31 - 1)
    header = F.substring(body, F.lit(1), u32(message, 4).cast("int"))
    is_frame = (size >= HEAD_BYTES) & (u32(message, 0) == MAGIC)
    whole = (u32(message, 4) + u32(message, 8) + HEAD_BYTES == size) & (F.crc32(body) == u32(message, 12))
    frame = F.when(whole, F.when(F.try_parse_json(header.cast("string")).isNotNull(), "batch")).otherwise(F.lit(None))
    return F.coalesce(F.when(is_frame, frame).otherwise(kind), F.lit("invalid"))


CONTROL = {
    "create_session": "protocol_version int, session_id string, publisher_id string, started_at string, frame_id string, units string, metadata map<string,string>",
    "resume_session": "protocol_version int, session_id string, publisher_id string, last_client_sequence bigint",
    "pose_update": "session_id string, publisher_id string, sequence bigint, timestamp string, pose struct<translation_m:array<double>,rotation_xyzw:array<double>>",
    "point_batch_header": "session_id string, publisher_id string, sequence bigint, timestamp string, pose_sequence bigint, point_count int, point_format string, encoding string, compression string, stride_bytes int",
    "close_session": "session_id string, publisher_id string, sequence bigint",
    "viewer_view": "position array<double>, forward array<double>, up array<double>, fov_y_rad double, viewport_px array<double>, near_m double, far_m double, overlay boolean, overlay_max_points int",
}


def control(messages: DataFrame, kind: str, column: str = "message") -> DataFrame:
    """The fields of control messages of one kind."""
    text = F.col(column).cast("string")
    return messages.where(message_kind(F.col(column).cast("binary")) == kind).select("*", F.from_json(text, CONTROL[kind]).alias("m")).select(*messages.columns, "m.*")
