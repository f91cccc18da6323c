"""Decoders as table functions, for SQL."""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, FloatType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from pulsegrid.session import ship_package

from . import wire


class DecodeBatches:
    """Rows (batch_id, body) as events (batch_id, place, timestamp, duration_ms, status_code, is_error); malformed batches have
    none. A row is a batch of a bounded number of events."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or not {"batch_id", "body"} <= set(table.dataType.names):
            raise ValueError("decode_batches takes a TABLE with batch_id and body")
        out = StructType().add("batch_id", StringType()).add("place", LongType()).add("timestamp", LongType())
        return AnalyzeResult(out.add("duration_ms", FloatType()).add("status_code", IntegerType()).add("is_error", BooleanType()))

    def eval(self, row: Row):
        events = wire.decode_batch(bytes(row["body"]) if row["body"] is not None else None)
        for place, (at, took, code) in enumerate(zip(events["timestamp"].tolist(), events["duration_ms"].tolist(), events["status_code"].tolist())):
            yield str(row["batch_id"]), place, at, took, code, code >= 400


class DecodeTraces:
    """Rows (body) of OTLP protobuf requests as spans (service, trace_id, span_id, parent_span_id, name, ts_ms, is_error)."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or "body" not in table.dataType.names:
            raise ValueError("decode_traces takes a TABLE with body")
        out = StructType()
        for name in ("service", "trace_id", "span_id", "parent_span_id", "name"):
            out = out.add(name, StringType())
        return AnalyzeResult(out.add("ts_ms", LongType()).add("is_error", BooleanType()))

    def eval(self, row: Row):
        for s in wire.decode_trace_request(bytes(row["body"])) if row["body"] is not None else ():
            yield s["service"], s["trace_id"], s["span_id"], s["parent_span_id"], s["name"], s["start_ns"] // 1_000_000, s["status"] == 2


def register(spark: SparkSession) -> None:
    """Make decode_batches and decode_traces known to SQL."""
    ship_package(spark)
    spark.udtf.register("decode_batches", udtf(DecodeBatches))
    spark.udtf.register("decode_traces", udtf(DecodeTraces))
