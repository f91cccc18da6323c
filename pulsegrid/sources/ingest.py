"""Ingest: JSON batches, envelopes, OTLP requests (JSON and protobuf), binary batches, pod lists, tags."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import map_of_last
from pulsegrid.session import materialize, ship_package

from . import wire

EVENT_SCHEMA = "traceId string, service string, durationMs double, isError boolean, timestamp long, spanId string, parentSpanId string, path string, method string, statusCode int"
REQUIRED = ("traceId", "service", "durationMs", "isError", "timestamp")
ENVELOPE_SCHEMA = "id string, timestamp long, kind string, service string, host string, tags map<string,string>, metric struct<name:string,value:double,unit:string>, trace string, log string"
_VALUE = "struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double>"
_ATTRS = f"array<struct<key:string,value:{_VALUE}>>"
OTLP_SCHEMA = (
    f"resourceSpans array<struct<resource:struct<attributes:{_ATTRS}>,scopeSpans:array<struct<scope:struct<name:string,version:string>,"
    f"spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_ATTRS},status:struct<code:int,message:string>>>>>>>"
)


def from_json(lines: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of a batch's JSON events; a missing required field rejects a row.

    A missing span id is a hash of the event, so the same input gives the same ids.
    """
    # A generated column is computed once for a row; a projected one would be parsed again for each of its uses.
    parsed = lines.select("*", F.explode(F.array(F.from_json(body, EVENT_SCHEMA))).alias("e"))
    whole = F.col("e").isNotNull()
    for c in REQUIRED:
        whole = whole & F.col(f"e.{c}").isNotNull()
    ok = parsed.where(whole).select(
        F.col("e.traceId").alias("trace_id"),
        F.coalesce("e.spanId", F.lpad(F.lower(F.hex(F.xxhash64(body))), 16, "0")).alias("span_id"),
        F.col("e.parentSpanId").alias("parent_span_id"),
        F.col("e.service").alias("service"),
        F.col("e.durationMs").alias("duration_ms"),
        F.col("e.isError").alias("is_error"),
        (F.col("e.timestamp") * 1000).alias("ts_us"),
        F.col("e.path").alias("path"),
        F.col("e.method").alias("method"),
        F.col("e.statusCode").alias("status_code"),
    )
    return ok, parsed.where(~F.coalesce(whole, F.lit(False))).select(body)


#: The declared fields of an event, by name and type.
DECLARED = [tuple(x.split(" ")) for x in EVENT_SCHEMA.split(", ")]


def from_json_variant(lines: DataFrame, body: str = "body") -> DataFrame:
    """Events of JSON bodies, parsed once into a VARIANT: the declared fields by type (null where a value doesn't fit), and the
    whole event as ``event``, in which unknown fields live on with their types. Bodies that aren't JSON objects give no row."""
    v = lines.select(F.explode(F.array(F.try_parse_json(body))).alias("event")).where("event is not null and startswith(schema_of_variant(event), 'OBJECT')")
    fields = [F.try_variant_get("event", f"$.{n}", t).alias(n) for n, t in DECLARED]
    return v.select(*fields, "event")


def unknown_fields(events: DataFrame) -> DataFrame:
    """The top-level fields of the events (spanId, event) that aren't declared: spanId, key, value (JSON text)."""
    fields = F.expr("variant_get(event, '$', 'map<string, variant>')")
    rows = events.select("spanId", F.explode(fields).alias("key", "v")).where(~F.col("key").isin([n for n, _ in DECLARED]))
    return rows.select("spanId", "key", F.to_json("v").alias("value"))


def accounting(total: DataFrame, accepted: DataFrame) -> DataFrame:
    """total, accepted and rejected rows."""
    n = total.agg(F.count(F.lit(1)).alias("total")).crossJoin(F.broadcast(accepted.agg(F.count(F.lit(1)).alias("accepted"))))
    return n.withColumn("rejected", F.col("total") - F.col("accepted"))


def from_envelopes(lines: DataFrame, body: str = "body") -> DataFrame:
    """Envelopes as events: the metric's value is the duration, nothing is an error; tags and host are kept."""
    e = lines.select(F.from_json(body, ENVELOPE_SCHEMA).alias("e")).where("e.service is not null")
    return e.select(F.col("e.id").alias("trace_id"), F.col("e.service").alias("service"), F.coalesce("e.metric.value", F.lit(0.0)).alias("duration_ms"), F.lit(False).alias("is_error"), F.col("e.timestamp").alias("ts_ns"), F.col("e.host").alias("host"), F.col("e.tags").alias("tags"), F.col("e.kind").alias("kind"))


def service_name(attributes) -> F.Column:
    """The first non-empty service.name, else ``unknown``."""
    named = F.filter(attributes, lambda a: (a["key"] == "service.name") & (F.coalesce(a["value"]["stringValue"], F.lit("")) != ""))
    return F.coalesce(F.get(named, F.lit(0))["value"]["stringValue"], F.lit("unknown"))


def from_otlp(requests: DataFrame, body: str = "body") -> DataFrame:
    """OTLP JSON requests as spans; ids, parents, names and attributes are kept."""
    r = requests.select(F.explode(F.from_json(body, OTLP_SCHEMA)["resourceSpans"]).alias("r"))
    s = r.select(service_name(F.col("r.resource.attributes")).alias("service"), F.explode("r.scopeSpans").alias("ss")).select("service", F.explode("ss.spans").alias("s"))
    start, end = F.col("s.startTimeUnixNano").cast("long"), F.col("s.endTimeUnixNano").cast("long")
    attrs = map_of_last(F.transform(F.coalesce("s.attributes", F.array().cast(_ATTRS)), lambda a: F.struct(a["key"].alias("k"), F.coalesce(a["value"]["stringValue"], a["value"]["intValue"], a["value"]["doubleValue"].cast("string"), a["value"]["boolValue"].cast("string")).alias("v"))))
    return s.select(
        "service",
        F.col("s.traceId").alias("trace_id"),
        F.col("s.spanId").alias("span_id"),
        F.nullif(F.col("s.parentSpanId"), F.lit("")).alias("parent_span_id"),
        F.col("s.name").alias("name"),
        F.expr("cast(s.startTimeUnixNano as long) div 1000000").alias("ts_ms"),
        ((end - start) / 1_000_000).alias("duration_ms"),
        F.coalesce(F.col("s.status.code") == 2, F.lit(False)).alias("is_error"),
        attrs.alias("attrs"),
    )


def _otlp_binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [s for body in batch.column(0).to_pylist() for s in wire.decode_trace_request(body)]
        out = {k: [r[k] for r in rows] for k in ("service", "trace_id", "span_id", "parent_span_id", "name")}
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, pa.string()) for v in out.values()]
            + [pa.array([r["start_ns"] // 1_000_000 for r in rows], pa.int64()), pa.array([(r["end_ns"] - r["start_ns"]) / 1e6 for r in rows], pa.float64()), pa.array([r["status"] == 2 for r in rows], pa.bool_()), pa.array([list(r["attrs"].items()) for r in rows], pa.map_(pa.string(), pa.string()))],
            names=[*out, "ts_ms", "duration_ms", "is_error", "attrs"],
        )


def from_otlp_binary(requests: DataFrame, body: str = "body") -> DataFrame:
    """OTLP protobuf requests as spans, with the columns of from_otlp."""
    ship_package(requests.sparkSession)
    return requests.select(F.col(body).cast("binary").alias("body")).mapInArrow(_otlp_binary, "service string, trace_id string, span_id string, parent_span_id string, name string, ts_ms long, duration_ms double, is_error boolean, attrs map<string,string>")


def to_otlp_binary(spans: DataFrame) -> DataFrame:
    """Spans (service, trace_id, span_id, parent_span_id, name, start_ns, end_ns, status, attr_*) as OTLP protobuf requests,
    one for each span; ids are hex."""
    ship_package(spans.sparkSession)
    attrs = [c for c in spans.columns if c.startswith("attr_")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            bodies = [wire.encode_trace_request(r["service"], [r | {"attrs": {a[5:]: r[a] for a in attrs if r[a] is not None}}]) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(bodies, pa.binary())], names=["body"])

    return spans.mapInArrow(encode, "body binary")


def _binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [wire.decode_batch(b) for b in batch.column("body").to_pylist()]
        sizes = [len(f) for f in found]
        rows = np.concatenate(found) if found else np.zeros(0, wire.EVENT)
        first = np.repeat(np.arange(len(found)), sizes)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes) if found else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("batch_id").take(pa.array(first)), pa.array(place.astype(np.int64)), pa.array(rows["timestamp"].astype(np.int64)), pa.array(rows["duration_ms"]), pa.array(rows["status_code"].astype(np.int32)), pa.array(rows["status_code"] >= 400)],
            names=["batch_id", "place", "timestamp", "duration_ms", "status_code", "is_error"],
        )


def from_binary(batches: DataFrame) -> DataFrame:
    """Events of binary batches (batch_id, body); an error is a status of 400 or more; malformed batches have none."""
    ship_package(batches.sparkSession)
    return batches.select(F.col("batch_id").cast("string").alias("batch_id"), F.col("body").cast("binary").alias("body")).mapInArrow(_binary, "batch_id string, place long, timestamp long, duration_ms float, status_code int, is_error boolean")


#: Write indexes of a key's rows in one binary batch.
BATCH_SPAN = 100_000


def to_binary(events: DataFrame, by: str = "trace_id") -> DataFrame:
    """Events (seq, ts_us, duration_ms, status_code) as binary batches, one for each key and block of ``BATCH_SPAN`` write
    indexes, so no batch has more rows than that."""
    ship_package(events.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("rows")
            rows = lists.flatten()
            own = np.zeros(len(rows), wire.EVENT)
            for name, field in (("timestamp", "ts_us"), ("duration_ms", "duration_ms"), ("status_code", "status_code")):
                own[name] = rows.field(field).fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).tolist()
            out = [wire.encode_batch(key, own[a:b]) for key, a, b in zip(batch.column("batch_id").to_pylist(), ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("batch_id"), pa.array(out, pa.binary())], names=["batch_id", "body"])

    grouped = events.groupBy(F.col(by).alias("batch_id"), F.expr(f"seq div {BATCH_SPAN}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("seq", "ts_us", "duration_ms", "status_code"))).alias("rows"))
    return grouped.mapInArrow(encode, "batch_id string, body binary")


POD_SCHEMA = "items array<struct<metadata:struct<name:string,namespace:string,labels:map<string,string>,ownerReferences:array<struct<kind:string,name:string>>>,status:struct<podIP:string>>>"


def from_pods(lists: DataFrame, body: str = "body") -> DataFrame:
    """Pods with an address: seq, pod_ip, name, namespace, labels, app, deployment (last owner, else a label)."""
    p = lists.select(F.posexplode(F.from_json(body, POD_SCHEMA)["items"]).alias("seq", "p")).where("coalesce(p.status.podIP, '') != ''")
    meta = "p.metadata"
    owners = F.filter(F.coalesce(f"{meta}.ownerReferences", F.array().cast("array<struct<kind:string,name:string>>")), lambda o: o["kind"].isin("ReplicaSet", "DaemonSet", "StatefulSet"))
    last = F.element_at(owners, -1)
    owner = F.when(F.size(owners) > 0, F.when(last["kind"] == "ReplicaSet", F.regexp_replace(last["name"], "-[a-z0-9]+$", "")).otherwise(last["name"]))
    label = lambda k: F.try_element_at(F.col(f"{meta}.labels"), F.lit(k))
    return p.select("seq", F.col("p.status.podIP").alias("pod_ip"), F.col(f"{meta}.name").alias("name"), F.col(f"{meta}.namespace").alias("namespace"), F.col(f"{meta}.labels").alias("labels"), F.coalesce(label("app"), label("app.kubernetes.io/name")).alias("app"), F.coalesce(owner, label("app.kubernetes.io/name"), label("app"), label("k8s-app")).alias("deployment"))


MOST_TAGS = 65_535


def tag_dictionary(events: DataFrame, column: str = "service") -> DataFrame:
    """Dense ids from 1 in order of first appearance, 0 beyond 65,535. Only the first so many distinct values are numbered."""
    first = materialize(events.groupBy(F.col(column).alias("tag")).agg(F.min("seq").alias("first_seq")), "tags")
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first_seq"))
    early = first.orderBy("first_seq").limit(MOST_TAGS).select(F.col("first_seq").alias("at"), number.alias("number"))
    return first.join(early, F.col("first_seq") == F.col("at"), "left").select("tag", "first_seq", F.coalesce("number", F.lit(0)).alias("tag_id"))
