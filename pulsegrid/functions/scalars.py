"""Scalar functions of the telemetry model, as Column expressions (no Python UDFs)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Port names, HTTP method codes.
PORT_NAMES = {80: "frontend (nginx)", 3000: "api (node)", 5432: "db (postgres)", 3001: "sidecar", 4318: "otlp-collector"}
METHODS = {0: "UNKNOWN", 1: "GET", 2: "POST", 3: "PUT", 4: "DELETE", 5: "PATCH", 6: "HEAD"}


def lookup(values: dict, key: Column) -> Column:
    """The value of a small fixed table, null for unknown keys."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), key)


def is_error_status(status: Column) -> Column:
    return status >= 400


def span_is_error(status: Column, http_status: Column) -> Column:
    """A failed connection is an error, an HTTP exchange is one by its status code."""
    return F.when(status == 3, F.lit(True)).when(status.isin(5, 6), F.coalesce(http_status, F.lit(0)) >= 400).otherwise(F.lit(False))


def http_status(packed: Column) -> Column:
    """Status code from bits 16 to 31; 0 is unknown."""
    return F.nullif(F.shiftright(packed, 16).bitwiseAND(F.lit(0xFFFF)), F.lit(0))


def http_method(packed: Column) -> Column:
    """Method name from bits 8 to 15."""
    return F.coalesce(lookup(METHODS, F.shiftright(packed, 8).bitwiseAND(F.lit(0xFF)).cast("int")), F.lit(METHODS[0]))


def hex_id(number: Column, digits: int = 16) -> Column:
    """Lower-case hex of a long, padded; zero is no id."""
    return F.when(number != 0, F.lpad(F.lower(F.hex(number)), digits, "0"))


def base64_hex(text: Column) -> Column:
    return F.nullif(F.lower(F.hex(F.unbase64(text))), F.lit(""))


def dotted_quad(address: Column) -> Column:
    """Four bytes, lowest first, as text."""
    return F.concat_ws(".", *[F.shiftright(address, s).bitwiseAND(F.lit(255)).cast("string") for s in (0, 8, 16, 24)])


def swap_port(port: Column) -> Column:
    return F.shiftleft(port.bitwiseAND(F.lit(255)), 8).bitwiseOR(F.shiftright(port, 8).bitwiseAND(F.lit(255)))


def target_name(ip: Column, port: Column) -> Column:
    """A known port's name, else ip:port."""
    return F.coalesce(lookup(PORT_NAMES, port), F.concat_ws(":", ip, port.cast("string")))


def epoch_ns(value: Column) -> Column:
    """Nanoseconds of a value in ms or ns: beyond 1e15 it is ns."""
    return F.when(value > 1_000_000_000_000_000, value).otherwise(value * 1_000_000)


def ns_to_ms(ns: Column) -> Column:
    """Whole milliseconds; the division of doubles is off by less than a half, so it is rounded."""
    return F.round((ns - F.pmod(ns, F.lit(1_000_000))) / 1_000_000).cast("long")


def half_up(x: Column, digits: int = 2) -> Column:
    """Rounding as floor(x * 10^digits + 0.5)."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def latency_text(ms: Column) -> Column:
    return F.when(ms < 1, F.concat(F.floor(ms * 1000 + 0.5).cast("string"), F.lit(" μs"))).when(ms < 1000, F.concat(F.format_string("%.1f", ms.cast("double")), F.lit(" ms"))).otherwise(F.concat(F.format_string("%.2f", ms.cast("double") / 1000), F.lit(" s")))


def uptime_text(seconds: Column) -> Column:
    part = lambda unit, of: F.floor(F.pmod(seconds, F.lit(of)) / unit).cast("string")
    return F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h "), part(60, 3600), F.lit("m "), part(1, 60), F.lit("s"))


def error_band(pct: Column) -> Column:
    return F.when(pct == 0, "green").when(pct < 5, "yellow").otherwise("red")


def latency_band(ms: Column) -> Column:
    return F.when(ms < 50, "green").when(ms < 200, "yellow").otherwise("red")


def burn_label(rate: Column) -> Column:
    return F.when(rate > 10, "CRITICAL").when(rate > 2, "HIGH").when(rate > 1, "ELEVATED").otherwise("NORMAL")


def budget_band(remaining: Column) -> Column:
    """Colour of an error budget's remaining share: above a half, above a fifth, and less."""
    return F.when(remaining > 0.5, "green").when(remaining > 0.2, "yellow").otherwise("red")


def multiplier_hash(text: Column) -> Column:
    """The 31-multiplier hash over code points, kept in 32 bits, as an unsigned long."""
    mask = F.lit(0xFFFFFFFF).cast("long")
    codes = F.transform(F.split(text, ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.ascii(c)).cast("long"))
    return F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(mask))


def stable_trace_id(text: Column) -> Column:
    """The hash as 16 hex digits, twice."""
    return F.repeat(F.lpad(F.lower(F.hex(multiplier_hash(text))), 16, "0"), 2)


def service_hue(text: Column) -> Column:
    h = multiplier_hash(text)
    signed = F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)
    return F.abs(signed) % 360


def parse_headers(text: Column) -> Column:
    """A map from ``k=v,k=v``; '+' is a blank; malformed pairs are skipped."""
    pairs = F.filter(F.split(text, ","), lambda p: (F.instr(p, "=") > 1))
    entry = lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.replace(F.trim(F.regexp_replace(p, "^[^=]*=", "")), F.lit("+"), F.lit(" ")).alias("v"))
    return map_of_last(F.transform(pairs, entry))


def map_of_last(entries: Column) -> Column:
    """A map of entries (k, v); of several with one key the last counts, and those without a key don't."""
    named = F.filter(entries, lambda e: e["k"].isNotNull())
    later = lambda e, i: F.exists(F.slice(named, i + 2, F.greatest(F.size(named), F.lit(1))), lambda x: x["k"] == e["k"])
    return F.map_from_entries(F.filter(named, lambda e, i: ~later(e, i)))


def replica_set_owner(name: Column) -> Column:
    """A ReplicaSet's name without its generated suffix."""
    found = F.regexp_extract(name, "^(.*)-[a-z0-9]+$", 1)
    return F.when(found != "", found).otherwise(name)


def request_method(payload: Column) -> Column:
    return F.nullif(F.regexp_extract(payload, r"^(GET|POST|PUT|DELETE|PATCH|HEAD) ", 1), F.lit(""))


def request_path(payload: Column) -> Column:
    return F.nullif(F.regexp_extract(payload, r"^[A-Z]+ (\S+)", 1), F.lit(""))


def response_status(payload: Column) -> Column:
    return F.nullif(F.regexp_extract(payload, r"^HTTP/1\.[01] (\d{3})", 1), F.lit("")).cast("int")


def traceparent(header: Column) -> Column:
    """trace_id and span_id of a W3C trace context header; nulls if malformed."""
    pattern = r"^00-([0-9a-f]{32})-([0-9a-f]{16})-"
    part = lambda k: F.nullif(F.regexp_extract(header, pattern, k), F.lit(""))
    return F.struct(part(1).alias("trace_id"), part(2).alias("span_id"))


def protocol(payload: Column) -> Column:
    low = F.lower(payload)
    return F.when(low.contains("application/grpc"), "grpc").when(payload.startswith("PRI * HTTP/2.0"), "http2").when(payload.rlike(r"^(HTTP/1\.|(GET|POST|PUT|DELETE|PATCH|HEAD) )"), "http1").otherwise("tcp")


def grpc_service(path: Column) -> Column:
    """``/pkg.Svc/Method`` as ``pkg.Svc:Method``."""
    return F.regexp_replace(path, "^/([^/]+)/(.+)$", "$1:$2")


def xor_span_id(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def container_id(cgroup: Column) -> Column:
    """The last part of a cgroup line's path up to a dot or the line's end, if it has 12 characters at least."""
    last = F.regexp_extract(cgroup, r"(?s)([^/.\r\n]*)[^/]*$", 1)
    return F.when(F.length(last) >= 12, last)


def display_name(name: Column) -> Column:
    return F.replace(name, F.lit("-"), F.lit(" "))


def runbook_link(template: str, rule: Column, service: Column) -> Column:
    out = F.replace(F.lit(template), F.lit("{rule}"), F.url_encode(rule))
    return F.replace(out, F.lit("{service}"), F.url_encode(F.coalesce(service, F.lit(""))))


def label_text(labels: Column) -> Column:
    """Prometheus labels, sorted by name: {a="x",b="y"}; empty for no labels."""
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    return F.when(F.size(labels) > 0, F.concat(F.lit("{"), shown, F.lit("}"))).otherwise("")


def edge_weight(hits: Column) -> Column:
    return F.log2(hits + 1)


def edge_alpha(hits: Column) -> Column:
    return F.least(F.lit(1.0), hits / 100)


#: What stands for itself in a service pattern: signs of regular expressions, and a bracket that isn't closed.
_PLAIN = r"[\\^$|(){}+]|\[(?![^\]]+\])"


def checked_pattern(pattern: str) -> str:
    """A service pattern that glob_matches can take, else a ValueError that names it."""
    try:
        re.compile(re.sub(_PLAIN, r"\\\g<0>", pattern).replace("?", ".").replace("*", ".*"))
    except re.error as e:
        raise ValueError(f"not a pattern: {pattern!r} ({e})") from e
    return pattern


def glob_matches(value: Column, pattern: Column) -> Column:
    """A pattern with * and ? and classes in brackets, anchored, of any letter case. A dot stands for any character; other
    signs of regular expressions stand for themselves."""
    plain = F.regexp_replace(pattern, _PLAIN, r"\\$0")
    return F.rlike(value, F.concat(F.lit("(?i)^"), F.replace(F.replace(plain, F.lit("?"), F.lit(".")), F.lit("*"), F.lit(".*")), F.lit("$")))


def number_text(x: Column) -> Column:
    """A number as text, whole ones without a point."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def pod_container_id(lines: Column) -> Column:
    """The container id of a process from the lines of its cgroup file: that of the first line that names a pod, else of the
    last line that has one."""
    found = F.filter(F.transform(lines, lambda x: F.struct(x.contains("pod").alias("pod"), container_id(x).alias("id"))), lambda f: f["id"].isNotNull())
    pods = F.filter(found, lambda f: f["pod"])
    return F.coalesce(F.get(pods, F.lit(0))["id"], F.get(found, F.size(found) - 1)["id"])


def trace_link(base_url: str, service: Column) -> Column:
    """A link to a service's status page."""
    base = base_url.rstrip("/")
    return F.when(F.coalesce(service, F.lit("")) != "", F.concat(F.lit(f"{base}/status?service="), F.url_encode(service))).otherwise(F.lit(f"{base}/status"))
