"""Messaging topology (M1-M10): one long ``mq_facts`` table, then the
integration graph as unions and aggregations over it.

C# (MassTransit) and Node (amqplib) facts are JVM-side regex extractions,
infra configs are VARIANT expressions; only the ReceiveEndpoint blocks (need
offsets) and YAML texts go through small Python helpers in ``mapInPandas``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.body import scan_receive_endpoints
from ..functions.config import yaml_as_json
from ..functions.rules import java_re

# FIXED VALUES: extraction patterns of the messaging rules
PUBLISH = r"\.Publish<\s*([\w\.]+)\s*>|\bPublish\(\s*new\s+([\w\.]+)"
SEND = r"\.Send<\s*([\w\.]+)\s*>|\bSend\(\s*new\s+([\w\.]+)"
SEND_ENDPOINT = r"GetSendEndpoint\(\s*new\s+Uri\(\s*['\"]([^'\"]+)['\"]"
CONSUMER_CLASS = r"class\s+(\w+)\s*:\s*[^{\n]*IConsumer<\s*([\w\.]+)\s*>"
AMQP = {
    "exchange": (r"assertExchange\(\s*['\"]([^'\"]+)['\"]\s*,\s*['\"]([^'\"]+)['\"]", ["name", "type"]),
    "queue": (r"assertQueue\(\s*['\"]([^'\"]+)['\"]", ["queue"]),
    "binding": (r"bindQueue\(\s*['\"]([^'\"]+)['\"]\s*,\s*['\"]([^'\"]+)['\"]\s*(?:,\s*['\"]([^'\"]+)['\"])?",
                ["queue", "exchange", "routing_key"]),
    "publish": (r"publish\(\s*['\"]([^'\"]+)['\"]\s*,\s*['\"]([^'\"]*)['\"]", ["exchange", "routing_key"]),
    "send_to_queue": (r"sendToQueue\(\s*['\"]([^'\"]+)['\"]", ["queue"]),
    "consume": (r"consume\(\s*['\"]([^'\"]+)['\"]", ["queue"]),
}
FACT_COLUMNS = ["name", "type", "queue", "exchange", "routing_key", "message", "party"]


def _all(pattern: str, group: int) -> Column:
    return F.regexp_extract_all(F.col("content"), F.lit(java_re(pattern)), group)


def _key():
    return ["repo", F.col("relative_path").alias("file"), "language"]


# ------------------------------------------------------------------ M1
def messaging_candidates(files: DataFrame) -> DataFrame:
    """Files worth scanning, with their source type (cheap filter that runs
    before any regex work)."""
    c = F.col("content")
    st = (F.when((F.col("language") == "csharp") & (c.contains("MassTransit") | c.contains("ReceiveEndpoint")),
                 F.lit("masstransit"))
          .when(F.col("language").isin("javascript", "typescript")
                & (c.contains("amqplib") | c.contains(".publish(") | c.contains(".sendToQueue(")),
                F.lit("amqplib"))
          .when(F.col("language") == "config", F.lit("infra_config")))
    return files.withColumn("source_type", st).where(F.col("source_type").isNotNull())


# ------------------------------------------------------------------ M2
def _receive_batches(batches):
    for b in batches:
        rows = []
        for repo, file, content in zip(b["repo"], b["file"], b["content"]):
            for ordinal, queue, consumers, sagas in scan_receive_endpoints(content or ""):
                rows.append((repo, file, ordinal, queue, consumers, sagas))
        yield pd.DataFrame(rows, columns=["repo", "file", "ord", "queue", "consumers", "sagas"])


def receive_endpoints(cands: DataFrame) -> DataFrame:
    """(repo, file, ord, queue, consumers[], sagas[]) per ReceiveEndpoint."""
    src = (cands.where(F.col("source_type") == "masstransit")
           .where(F.col("content").contains("ReceiveEndpoint"))
           .select("repo", F.col("relative_path").alias("file"), "content"))
    return src.mapInPandas(_receive_batches, "repo string, file string, ord long, queue string, "
                                             "consumers array<string>, sagas array<string>")


# ------------------------------------------------------------------ M3-M5
def _either(pattern: str) -> Column:
    g1, g2 = _all(pattern, 1), _all(pattern, 2)
    return F.array_sort(F.array_distinct(F.filter(
        F.transform(g1, lambda x, i: F.when(x != "", x).otherwise(F.element_at(g2, i + 1))),
        lambda x: x != "")))


def message_ops(cands: DataFrame) -> DataFrame:
    """(repo, file, op, message): distinct published / sent types per file."""
    cs = cands.where(F.col("source_type") == "masstransit")
    ops = F.concat(F.transform(_either(PUBLISH), lambda m: F.struct(F.lit("publish").alias("op"), m.alias("message"))),
                   F.transform(_either(SEND), lambda m: F.struct(F.lit("send").alias("op"), m.alias("message"))))
    return cs.select(*_key(), F.explode(ops).alias("x")).select("repo", "file", "x.op", "x.message")


def normalize_queue_uri(uri: Column) -> Column:
    """``queue:x`` kept; text after an inner ``queue:``; ``rabbitmq://.../q``
    -> ``queue:q``; anything else as is."""
    return (F.when(uri.startswith("queue:"), uri)
            .when(uri.contains("queue:"), F.concat(F.lit("queue:"), F.regexp_extract(uri, r"queue:(.*)$", 1)))
            .when(uri.contains("rabbitmq://"), F.concat(F.lit("queue:"), F.element_at(F.split(uri, "/"), -1)))
            .otherwise(uri))


def send_endpoints(cands: DataFrame) -> DataFrame:
    """(repo, file, endpoint): normalised, distinct per file."""
    cs = cands.where(F.col("source_type") == "masstransit")
    eps = F.array_distinct(F.transform(_all(SEND_ENDPOINT, 1), normalize_queue_uri))
    return cs.select(*_key(), F.explode(eps).alias("endpoint")).select("repo", "file", "endpoint")


def consumer_messages(files: DataFrame) -> DataFrame:
    """(repo, file, ord, consumer, message): ``class X : ... IConsumer<T>``
    on one line; duplicates kept."""
    pairs = F.arrays_zip(_all(CONSUMER_CLASS, 1).alias("consumer"), _all(CONSUMER_CLASS, 2).alias("message"))
    return (files.select(*_key(), F.posexplode(pairs).alias("ord", "x"))
            .select("repo", "file", F.col("ord").cast("long").alias("ord"), "x.consumer", "x.message"))


# ------------------------------------------------------------------ M6
def amqp_facts(cands: DataFrame) -> DataFrame:
    """(repo, file, kind, ord, name, type, queue, exchange, routing_key):
    string-literal arguments only."""
    js = cands.where(F.col("source_type") == "amqplib")
    parts = []
    for kind, (pattern, cols) in AMQP.items():
        arrays = {c: _all(pattern, i + 1) for i, c in enumerate(cols)}
        first = arrays[cols[0]]
        st = F.transform(first, lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.cast("long").alias("ord"),
            *[(F.element_at(arrays[c], i + 1) if c in arrays else F.lit(None).cast("string")).alias(c)
              for c in ["name", "type", "queue", "exchange", "routing_key"]]))
        parts.append(st)
    return (js.select(*_key(), F.explode(F.concat(*parts)).alias("x"))
            .select("repo", "file", "x.*"))


# ------------------------------------------------------------------ M7
# FIXED VALUES: JSON of what counts as not given
ABSENT = ["null", '""', "0", "0.0", "-0.0", "false", "[]", "{}"]


def _yaml_batches(batches):
    for b in batches:
        b["json"] = [yaml_as_json(t or "") for t in b["content"]]
        yield b[["repo", "file", "json"]]


def _given(v: Column) -> Column:
    return F.coalesce(~F.to_json(v).isin(ABSENT), F.lit(False))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _entries(v: Column, key: str) -> Column:
    """The objects of the list at ``key``; anything else that stands there holds none."""
    none = F.variant_get(F.parse_json(F.lit("[]")), "$", "array<variant>")
    return F.filter(F.coalesce(F.try_variant_get(v, f"$.{key}", "array<variant>"), none), _is_object)


def _text_at(v: Column, path: str, default: str | None = "") -> Column:
    t = F.try_variant_get(v, f"$.{path}", "string")
    return t if default is None else F.coalesce(t, F.lit(default))


def config_variants(files: DataFrame) -> DataFrame:
    """(repo, file, v): each config file as a VARIANT. JSON is parsed on the JVM and never enters Python; what is no JSON is read
    as YAML by a Python helper that writes JSON. Files that are neither give null."""
    parsed = files.select("repo", F.col("relative_path").alias("file"), "content", F.try_parse_json("content").alias("v"))
    rest = (parsed.where(F.col("v").isNull()).select("repo", "file", "content")
            .mapInPandas(_yaml_batches, "repo string, file string, json string"))
    return (parsed.where(F.col("v").isNotNull()).select("repo", "file", "v")
            .unionByName(rest.select("repo", "file", F.try_parse_json("json").alias("v"))))


def infra_mq_facts(cands: DataFrame) -> DataFrame:
    """(repo, file, kind, ord, name, type, durable, queue, exchange, routing_key), numbered by kind inside a file.

    The broker's section is the object at ``rabbitmq``, else ``amqp``; exchanges come from its ``exchanges`` (type '' if not given),
    its ``topics`` and the file's own ``topics`` (type ``topic``). A section that is no object leaves the whole file without rows, a
    list that is none holds no entries, entries without a name are skipped; null counts as not given, names that are no text are
    taken as their JSON. Row-local array expressions over VARIANT, one explode, no shuffle."""
    root = F.col("v")
    section = lambda key: F.try_variant_get(root, f"$.{key}", "variant")
    broker = F.when(_given(section("rabbitmq")), section("rabbitmq")).when(_given(section("amqp")), section("amqp"))
    src = (config_variants(cands.where(F.col("source_type") == "infra_config")).where(_is_object(root))
           .withColumn("broker", broker).where(F.col("broker").isNull() | _is_object(F.col("broker"))))
    broker = F.col("broker")

    def named(v, key, default):
        return F.transform(F.filter(_entries(v, key), lambda x: _given(F.try_variant_get(x, "$.name", "variant"))),
                           lambda x: F.struct(x.alias("x"), F.lit(default).alias("type")))

    def facts(kind, entries, **columns):
        absent = {c: F.lit(None).cast("string") for c in FACT_COLUMNS[:5]} | {"durable": F.lit(None).cast("boolean")}
        order = ["name", "type", "durable", "queue", "exchange", "routing_key"]
        return F.transform(entries, lambda e, i: F.struct(
            F.lit(kind).alias("kind"), i.cast("long").alias("ord"),
            *[(columns[c](e) if c in columns else absent[c]).alias(c) for c in order]))
    exchanges = F.concat(named(broker, "exchanges", ""), named(broker, "topics", "topic"), named(root, "topics", "topic"))
    bound = F.filter(_entries(broker, "queues"), lambda x: _is_object(F.try_variant_get(x, "$.binding", "variant")))
    rows = F.concat(
        facts("exchange", exchanges, name=lambda e: _text_at(e["x"], "name", None),
              type=lambda e: F.coalesce(_text_at(e["x"], "type", None), e["type"])),
        facts("queue", named(broker, "queues", ""), name=lambda e: _text_at(e["x"], "name", None),
              durable=lambda e: _given(F.try_variant_get(e["x"], "$.durable", "variant"))),
        facts("binding", bound, queue=lambda x: _text_at(x, "name"), exchange=lambda x: _text_at(x, "binding.exchange"),
              routing_key=lambda x: _text_at(x, "binding.routing_key")))
    return src.select("repo", "file", F.explode(rows).alias("r")).select("repo", "file", "r.*")


# ------------------------------------------------------------------ M8/M9
def messaging_flows(endpoints: DataFrame) -> DataFrame:
    """(repo, queue, consumers, sagas, file) with lists joined by ', '."""
    return endpoints.select("repo", "queue", F.array_join("consumers", ", ").alias("consumers"),
                            F.array_join("sagas", ", ").alias("sagas"), "file")


def message_parties(ops: DataFrame, consumers: DataFrame) -> DataFrame:
    """(repo, message, role, party): services publishing / sending a message
    and consumers consuming it."""
    return (ops.select("repo", "message", F.lit("service").alias("role"), F.col("file").alias("party"))
            .unionByName(consumers.select("repo", "message", F.lit("consumer").alias("role"),
                                          F.col("consumer").alias("party"))))


# ------------------------------------------------------------------ M10
def safe_id(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", "_")


def safe_label(c: Column) -> Column:
    t = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\[\]\"`<>|]", "")
    t = F.translate(t, "\\\n\r", "   ")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.when(t == "", F.lit("label")).otherwise(t)


def integration_graph(infra: DataFrame, amqp: DataFrame, endpoints: DataFrame, ops: DataFrame,
                      consumers: DataFrame, sends: DataFrame):
    """Returns (nodes(repo, id, kind, label), edges(repo, src, dst, kind, n)).

    Exchanges keep the type of the last file declaring them (file order);
    edges are not deduplicated in the source diagram, so ``n`` counts them.
    Different names never share a node: ids that would be equal (``a/b.cs``,
    ``a_b.cs``) end in a hash of the name, but for the first of them."""
    ex = (infra.where("kind = 'exchange'").select("repo", "file", "ord", "name", "type")
          .unionByName(amqp.where("kind = 'exchange'").select("repo", "file", "ord", "name", "type")))
    ex = ex.groupBy("repo", "name").agg(F.max_by("type", F.struct("file", "ord")).alias("type"))
    q = (infra.where("kind = 'queue'").select("repo", "name")
         .unionByName(amqp.where("kind = 'queue'").select("repo", F.col("queue").alias("name")))
         .unionByName(endpoints.select("repo", F.col("queue").alias("name"))).distinct())
    ex_id = lambda c: F.concat(F.lit("EX_"), safe_id(c))
    q_id = lambda c: F.concat(F.lit("Q_"), safe_id(c))
    s_id = lambda c: F.concat(F.lit("S_"), safe_id(c))
    msg_id = lambda c: F.concat(F.lit("MSG_"), safe_id(F.concat(F.lit("MSG_"), c)))
    c_id = lambda c: F.concat(F.lit("C_"), safe_id(c))

    bindings = (infra.where("kind = 'binding'").select("repo", "exchange", "queue")
                .unionByName(amqp.where("kind = 'binding'").select("repo", "exchange", "queue"))
                .where((F.coalesce("exchange", F.lit("")) != "") & (F.coalesce("queue", F.lit("")) != "")))
    pubs = (amqp.where("kind = 'publish'").select("repo", F.col("file").alias("service"), "exchange",
                                                  F.lit(None).cast("string").alias("queue"))
            .unionByName(amqp.where("kind = 'send_to_queue'").select(
                "repo", F.col("file").alias("service"), F.lit(None).cast("string").alias("exchange"), "queue"))
            .unionByName(sends.where(F.col("endpoint").startswith("queue:")).select(
                "repo", F.col("file").alias("service"), F.lit(None).cast("string").alias("exchange"),
                F.substring_index("endpoint", "queue:", -1).alias("queue"))))
    # queue consumers; a MassTransit endpoint's service is its consumer list
    cons = (amqp.where("kind = 'consume'").select("repo", "queue", F.col("file").alias("service"))
            .unionByName(endpoints.select("repo", "queue", F.when(F.size("consumers") > 0,
                                                                  F.array_join("consumers", ", "))
                                          .otherwise(F.col("file")).alias("service"))))
    msg_pubs = ops.select("repo", "message", F.col("file").alias("service"))
    msg_cons = consumers.where(F.coalesce("message", F.lit("")) != "").select(
        "repo", "message", F.coalesce(F.nullif("consumer", F.lit("")), F.col("file")).alias("consumer"))

    # an end is told by its name; its id is what a diagram shows
    end = lambda to_id, c: F.struct(to_id(F.col(c)).alias("id"), F.col(c).alias("name"))
    nodes = (ex.select("repo", end(ex_id, "name").alias("at"), F.lit("exchange").alias("kind"),
                       F.concat(F.lit("Exchange "), safe_label(F.col("name")),
                                F.when(F.coalesce("type", F.lit("")) != "",
                                       F.concat(F.lit(" ("), safe_label(F.col("type")), F.lit(")")))
                                .otherwise(F.lit(""))).alias("label"))
             .unionByName(q.select("repo", end(q_id, "name").alias("at"), F.lit("queue").alias("kind"),
                                   F.concat(F.lit("Queue "), safe_label(F.col("name"))).alias("label")))
             .unionByName(pubs.select("repo", "service").unionByName(cons.select("repo", "service"))
                          .unionByName(msg_pubs.select("repo", "service"))
                          .select("repo", end(s_id, "service").alias("at"), F.lit("service").alias("kind"),
                                  F.concat(F.lit("Service "), safe_label(F.col("service"))).alias("label")))
             .unionByName(msg_pubs.select("repo", "message").unionByName(msg_cons.select("repo", "message"))
                          .select("repo", end(msg_id, "message").alias("at"), F.lit("message").alias("kind"),
                                  F.concat(F.lit("Message "), safe_label(F.col("message"))).alias("label")))
             .unionByName(msg_cons.select("repo", end(c_id, "consumer").alias("at"),
                                          F.lit("consumer").alias("kind"),
                                          F.concat(F.lit("Consumer "), safe_label(F.col("consumer"))).alias("label")))
             .distinct())
    edges = (bindings.select("repo", end(ex_id, "exchange").alias("src"), end(q_id, "queue").alias("dst"),
                             F.lit("binding").alias("kind"))
             .unionByName(pubs.where(F.coalesce("exchange", F.lit("")) != "").select(
                 "repo", end(s_id, "service").alias("src"), end(ex_id, "exchange").alias("dst"),
                 F.lit("publish").alias("kind")))
             .unionByName(pubs.where(F.coalesce("queue", F.lit("")) != "").select(
                 "repo", end(s_id, "service").alias("src"), end(q_id, "queue").alias("dst"),
                 F.lit("send").alias("kind")))
             .unionByName(cons.where(F.coalesce("queue", F.lit("")) != "").select(
                 "repo", end(q_id, "queue").alias("src"), end(s_id, "service").alias("dst"),
                 F.lit("consume").alias("kind")))
             .unionByName(msg_pubs.select("repo", end(s_id, "service").alias("src"),
                                          end(msg_id, "message").alias("dst"), F.lit("message_publish").alias("kind")))
             .unionByName(msg_cons.select("repo", end(msg_id, "message").alias("src"),
                                          end(c_id, "consumer").alias("dst"), F.lit("message_consume").alias("kind")))
             .groupBy("repo", "src", "dst", "kind").agg(F.count("*").alias("n")))
    ends = (nodes.select("repo", "at").unionByName(edges.select("repo", F.col("src").alias("at")))
            .unionByName(edges.select("repo", F.col("dst").alias("at"))))
    first = ends.groupBy("repo", F.col("at.id").alias("_id")).agg(F.min("at.name").alias("_first"))

    def shown(df, c):
        # names that come to one id: the first keeps it, the others end in a hash
        own = F.when(F.col(f"{c}.name") == F.col("_first"), F.col("_id")).otherwise(
            F.concat("_id", F.lit("_"), F.substring(F.md5(F.col(f"{c}.name").cast("binary")), 1, 8)))
        return df.withColumn("_id", F.col(f"{c}.id")).join(first, ["repo", "_id"]).withColumn(c, own).drop("_id", "_first")
    nodes = shown(nodes, "at").select("repo", F.col("at").alias("id"), "kind", "label")
    edges = shown(shown(edges, "src"), "dst").select("repo", "src", "dst", "kind", "n")
    return nodes, edges
