"""Network events to topology edges and services; address, pod and name joins; nodes; cross-node merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as S
from pulsegrid.session import materialize

NO_ADDRESS = "0.0.0.0"


def written(small: DataFrame, label: str = "dimension") -> DataFrame:
    """An aggregate as a written table: computed once, and of a size that the planner knows, so that a join broadcasts it
    only below spark.sql.autoBroadcastJoinThreshold and shuffles beyond."""
    return materialize(small, label)


EDGE_KEY = ["dest_ip", "dest_port", "source_ip", "container_id", "comm"]


def edge_rows(net: DataFrame) -> DataFrame:
    """The rows of net that edges are made of, with container_id and comm as they take part in the key."""
    rows = net.where((F.col("dest_ip") != NO_ADDRESS) & F.col("status").between(1, 6))
    container = F.coalesce("container_id", F.lit(""))
    return rows.withColumns({"container_id": container, "comm": F.when(container == "", F.coalesce(F.substring("comm", 1, 15), F.lit(""))).otherwise("")})


def edges(net: DataFrame) -> DataFrame:
    """One edge for each key from the first successful connection on: hits, latency, bytes, errors, retransmits, label.

    Status 1 connects, 2 sends, 3 fails, 4 retransmits, 5 and 6 carry a path. The comm takes part in the key only where
    there is no container, cut to 15 characters. First connections are aggregated before they meet the rows again, so an
    edge with most of the traffic is never gathered.
    """
    rows = edge_rows(net)
    created = rows.where("status = 1").groupBy(*EDGE_KEY).agg(F.min("seq").alias("created"))
    alive = rows.join(written(created), EDGE_KEY).where("seq >= created")
    agg = alive.groupBy(*EDGE_KEY).agg(
        F.count_if(F.col("status") == 1).alias("hit_count"),
        F.coalesce(F.sum(F.when(F.col("status") == 1, F.col("latency_ns"))), F.lit(0)).alias("total_latency_ns"),
        F.coalesce(F.sum(F.when(F.col("status") == 2, F.col("bytes"))), F.lit(0)).alias("total_bytes"),
        F.count_if(F.col("status") == 3).alias("error_count"),
        F.count_if(F.col("status") == 4).alias("retransmit_count"),
        F.max(F.when(F.col("status") == 1, F.col("ts_us"))).alias("last_seen_us"),
        F.max_by(F.when(F.col("path").isNotNull(), S.grpc_service(F.col("path"))), F.when(F.col("path").isNotNull(), F.col("seq"))).alias("grpc_service"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        F.min_by("comm", "seq").alias("source"),
    )
    hits = F.col("hit_count")
    average = F.when(hits > 0, F.floor(F.col("total_latency_ns") / hits / 1000 + 0.5)).otherwise(0).cast("long")
    return agg.withColumns({"avg_latency_us": average, "target": S.target_name(F.col("dest_ip"), F.col("dest_port"))})


def resolve_targets(own: DataFrame) -> DataFrame:
    """Targets by the service that was last seen at their address; other targets keep their label."""
    own = written(own, "edges")
    names = own.where(F.col("source_ip") != NO_ADDRESS).groupBy(F.col("source_ip").alias("dest_ip")).agg(F.max_by("source", "first_seq").alias("resolved"))
    return own.join(names, "dest_ip", "left").withColumn("target", F.coalesce("resolved", "target")).drop("resolved")


def enrich(own: DataFrame, pods: DataFrame) -> DataFrame:
    """Source and target pod, namespace and deployment; of pods with one address the last counts."""
    latest = written(pods.groupBy("pod_ip").agg(F.max_by(F.struct("name", "namespace", "deployment"), "seq").alias("pod")))
    side = lambda ip, p: latest.select(F.col("pod_ip").alias(ip), *[F.col(f"pod.{c}").alias(f"{p}_{n}") for c, n in (("name", "pod"), ("namespace", "namespace"), ("deployment", "deployment"))])
    return own.join(side("source_ip", "source"), "source_ip", "left").join(side("dest_ip", "target"), "dest_ip", "left")


def match_names(services: DataFrame, pods: DataFrame) -> DataFrame:
    """A pod for each service name: the first with that deployment, else the last whose name starts with it or has it as app label.

    Each pod offers its deployment, its label and every prefix of its name once, so the match is an equi-join.
    """
    low = lambda c: F.lower(F.col(c))
    own = F.struct("seq", "name", "namespace", "deployment")
    exact = pods.where("deployment is not null").groupBy(low("deployment").alias("k")).agg(F.min_by(own, "seq").alias("pod"), F.lit(1).alias("rank"))
    prefixes = F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.lower(F.col("name").substr(F.lit(1), i)))
    labels = F.array(F.lower(F.col("app"))) if "app" in pods.columns else F.array().cast("array<string>")
    loose = pods.select(F.explode(F.array_distinct(F.concat(prefixes, labels))).alias("k"), own.alias("own")).where("k is not null")
    loose = loose.groupBy("k").agg(F.max_by("own", "own.seq").alias("pod"), F.lit(2).alias("rank"))
    offers = exact.unionByName(loose).groupBy("k").agg(F.min_by("pod", "rank").alias("pod"), F.min("rank").alias("rank"))
    return services.join(offers, F.lower("comm") == F.col("k"), "left").select(*services.columns, F.col("pod.name").alias("pod"), F.col("pod.namespace").alias("namespace"), F.col("pod.deployment").alias("deployment"), F.col("rank").alias("match_rank"))


def services(net: DataFrame) -> DataFrame:
    """Accepts by process: count, mean latency in ms, last name and port, last seen."""
    agg = net.where("status in (0, 1)").groupBy("pid").agg(
        F.count(F.lit(1)).alias("accept_count"), F.sum("latency_ns").alias("total_ns"), F.max_by("comm", "seq").alias("comm"), F.max_by("dest_port", "seq").alias("port"), F.max("ts_us").alias("last_seen_us")
    )
    return agg.select("pid", "port", "comm", "accept_count", (F.col("total_ns") / F.col("accept_count") / 1_000_000).alias("avg_latency_ms"), "last_seen_us")


def nodes(own: DataFrame) -> DataFrame:
    return own.select(F.col("source").alias("node")).union(own.select("target")).distinct()


def retransmit_rate(own: DataFrame) -> DataFrame:
    """Retransmits by hits in per cent, one decimal."""
    rate = S.half_up(F.sum("retransmit_count") / F.sum("hit_count") * 100, 1)
    return own.agg(F.sum("retransmit_count").alias("retransmits"), F.sum("hit_count").alias("hits"), F.when(F.sum("hit_count") > 0, rate).otherwise(0.0).alias("retransmit_pct"))


def latest_snapshots(snapshots: DataFrame, now_us: int | None = None, ttl_us: int = 60_000_000) -> DataFrame:
    """Rows of each node's latest push, of pushes at most ttl old."""
    last = snapshots.groupBy("node_id").agg(F.max("pushed_at").alias("pushed_at"))
    if now_us is not None:
        last = last.where(F.col("pushed_at") >= now_us - ttl_us)
    return snapshots.join(written(last), ["node_id", "pushed_at"], "left_semi")


def merge_edges(own: DataFrame) -> DataFrame:
    """Edges of all nodes by source, target and port: sums, latency weighted by hits."""
    hits = F.sum("hit_count")
    weighted = F.floor(F.sum(F.col("avg_latency_us") * F.col("hit_count")) / hits + 0.5)
    return own.groupBy("source", "target", "dest_port").agg(
        hits.alias("hit_count"), F.sum("total_bytes").alias("total_bytes"), F.sum("error_count").alias("error_count"), F.when(hits > 0, weighted).otherwise(F.min("avg_latency_us")).cast("long").alias("avg_latency_us")
    )


def merge_signals(signals: DataFrame) -> DataFrame:
    """Signals of all nodes by service: summed rates, the worst error share and tails, the first node's median."""
    return signals.groupBy("service").agg(
        F.sum("rate_rps").alias("rate_rps"), F.sum("throughput_kbps").alias("throughput_kbps"), F.max("error_pct").alias("error_pct"), F.max("p95_ms").alias("p95_ms"), F.max("p99_ms").alias("p99_ms"), F.min_by("p50_ms", "node_id").alias("p50_ms"), F.count_distinct("node_id").alias("nodes")
    )


def drop_totals(drops: DataFrame) -> DataFrame:
    """Per-CPU drop counters by severity."""
    return drops.groupBy("severity").agg(F.sum("dropped").alias("dropped"))


def admitted(own: DataFrame, most: int = 512) -> DataFrame:
    """The first edges to appear, as a table of fixed size would hold."""
    return own.orderBy("first_seq").limit(most)


def admitted_services(accepts: DataFrame, most: int = 256) -> DataFrame:
    """The first processes to accept a connection, as a table of fixed size would hold: pid and first_seq."""
    return accepts.where("status in (0, 1)").groupBy("pid").agg(F.min("seq").alias("first_seq")).orderBy("first_seq").limit(most)


def all_services(by_node: DataFrame) -> DataFrame:
    """Services of all nodes, each with its node; one of several nodes is listed for each of them."""
    return by_node.select("node_id", F.col("source").alias("service")).union(by_node.select("node_id", "target")).distinct()


def with_containers(net: DataFrame, cgroups: DataFrame) -> DataFrame:
    """Network events with the container of their process, from lines (pid, seq, line) of cgroup files, a few for each
    process. A container id that an event has already stays."""
    files = cgroups.groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("seq", "line"))).alias("rows"))
    known = files.select("pid", S.pod_container_id(F.transform("rows", lambda r: r["line"])).alias("found"))
    out = net.join(written(known, "containers"), "pid", "left")
    return out.withColumn("container_id", F.coalesce(F.nullif("container_id", F.lit("")), "found", F.lit(""))).drop("found")


def last_edges(own: DataFrame, most: int = 20) -> DataFrame:
    """The edges last seen, the newest last."""
    return own.where("last_seen_us is not null").orderBy(F.desc("last_seen_us"), F.desc("first_seq")).limit(most).orderBy("last_seen_us", "first_seq")


def of_service(own: DataFrame, name: str) -> DataFrame:
    """Edges from or to a service, of any letter case."""
    wanted = name.lower()
    return own.where((F.lower("source") == wanted) | (F.lower("target") == wanted))


def containing(services: DataFrame, text: str, column: str = "service") -> DataFrame:
    """Rows whose service name contains a text, of any letter case."""
    return services.where(F.lower(column).contains(text.lower()))


def labelled(own: DataFrame) -> DataFrame:
    """Edges with protocol: grpc where a gRPC service is known, else tcp; and drawing weights."""
    hits = F.col("hit_count")
    return own.select("source", "target", "dest_port", F.when(F.col("grpc_service").isNotNull(), "grpc").otherwise("tcp").alias("protocol"), S.edge_weight(hits).alias("weight"), S.edge_alpha(hits).alias("alpha"))


def connects(calls: DataFrame) -> DataFrame:
    """Entries (phase 0) and exits (phase 1) of connect calls by thread: an exit takes the latest entry since the exit before."""
    by_thread = Window.partitionBy("thread").orderBy("seq")
    before = F.lag(F.struct("phase", "ts_us")).over(by_thread)
    return calls.withColumn("before", before).where("phase = 1 and before.phase = 0").select("thread", "seq", (F.col("ts_us") - F.col("before.ts_us")).alias("latency_us"))


def net_spans(net: DataFrame) -> DataFrame:
    """Spans of the network events that carry a trace id, each once."""
    rows = net.where("trace_id is not null").withColumn("packed", F.col("http_meta"))
    first = rows.groupBy("trace_id", "span_id").agg(F.min_by(F.struct("seq", "ts_us", "status", "packed", "path"), "seq").alias("s"))
    http = S.http_status(F.col("s.packed"))
    return first.select("trace_id", "span_id", "s.seq", "s.ts_us", http.alias("status_code"), S.http_method(F.col("s.packed")).alias("method"), S.span_is_error(F.col("s.status"), http).alias("is_error"))
