"""Service and endpoint catalog of C# code.

One ``mapInPandas`` pass finds classes with their attribute blocks and the
methods (attributes + balanced body) inside them (V1); everything else --
controllers, routes, verbs, endpoint steps, message resolution, consumer
joins, dependencies, specs and sequences -- is JVM-side DataFrame work.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.body import scan_cs_services
from ..functions.rules import java_re

# FIXED VALUES: patterns of the catalog rules
HTTP_VERB = r"(?i)\[(HttpGet|HttpPost|HttpPut|HttpDelete|HttpPatch|HttpHead|HttpOptions)\b"
ROUTE = r'(?i)\[Route\(\s*"([^"]+)"\s*\)\]'
HTTP_ROUTE = r'(?i)\[Http(?:Get|Post|Put|Delete|Patch|Head|Options)\(\s*"([^"]*)"\s*\)\]'
VAR_NEW = r"\bvar\s+(\w+)\s*=\s*new\s+([\w\.]+)\s*\("
TYPED_NEW = r"\b([\w\.]+)\s+(\w+)\s*=\s*new\s+([\w\.]+)\s*\("
PUBLISH = r"\.Publish<\s*([\w\.]+)\s*>|\bPublish\(\s*new\s+([\w\.]+)"
SEND = r"\.Send<\s*([\w\.]+)\s*>|\bSend\(\s*new\s+([\w\.]+)"
VAR_SENT = r"\bPublish\(\s*(\w+)\s*\)|\bSend\(\s*(\w+)\s*\)"
CONSUMER_CLASS = r"class\s+(\w+)\s*:\s*[^{\n]*IConsumer<\s*([\w\.]+)\s*>"
DEP_CLASS = r"(Service|Repository|Consumer|Handler)$"

SCAN_SCHEMA = ("repo string, file string, class string, class_ord long, class_attrs string, has_body boolean, "
               "method string, method_ord long, method_attrs string, body string")
SCAN_ROWS = 2000  # rows that a scan sends on at once


def _all(col: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(col, F.lit(java_re(pattern)), group)


def _scan_batches(batches):
    cols = ["repo", "file", "class", "class_ord", "class_attrs", "has_body", "method", "method_ord",
            "method_attrs", "body"]
    for b in batches:
        rows = []
        for repo, file, content in zip(b["repo"], b["file"], b["content"]):
            for r in scan_cs_services(content or ""):
                rows.append((repo, file) + tuple(r))
            if len(rows) >= SCAN_ROWS:  # what a worker holds does not grow with the rows of a batch
                yield pd.DataFrame(rows, columns=cols)
                rows = []
        yield pd.DataFrame(rows, columns=cols)


# ------------------------------------------------------------------ V1
def parse_csharp_services(files: DataFrame) -> DataFrame:
    """One row per (class, method) of every C# file; classes without
    methods appear once with NULL method columns."""
    src = (files.where(F.col("language") == "csharp")
           .select("repo", F.col("relative_path").alias("file"), "content"))
    return src.mapInPandas(_scan_batches, SCAN_SCHEMA)


def cs_classes(scan: DataFrame) -> DataFrame:
    return scan.select("repo", "file", "class", "class_ord", "class_attrs", "has_body").distinct()


def _route(attrs: Column) -> Column:
    r = F.regexp_extract(attrs, java_re(ROUTE), 1)
    h = F.regexp_extract(attrs, java_re(HTTP_ROUTE), 1)
    return F.when(r != "", r).otherwise(h)


def _resolve_controller_token(route: Column, cls: Column) -> Column:
    base = F.when(F.lower(cls).endswith("controller"), F.expr("substring(class, 1, length(class) - 10)")) \
        .otherwise(cls)
    token = F.lower(F.when(base != "", base).otherwise(cls))
    return F.when(F.lower(route).contains("[controller]"),
                  F.regexp_replace(route, r"(?i)\[controller\]", token)).otherwise(route)


def join_routes(base: Column, sub: Column) -> Column:
    return (F.when(base == "", sub).when(sub == "", base)
            .otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(sub, "^/+", ""))))


# ------------------------------------------------------------------ V2/V3
def controllers(scan: DataFrame) -> DataFrame:
    """(repo, file, controller, route)."""
    c = cs_classes(scan).where("has_body")
    route = _resolve_controller_token(_route(F.col("class_attrs")), F.col("class"))
    return (c.where(F.col("class").endswith("Controller") | F.col("class_attrs").contains("ApiController"))
            .select("repo", "file", F.col("class").alias("controller"), route.alias("route")))


def services_and_interfaces(scan: DataFrame) -> DataFrame:
    """(repo, kind, name): distinct service / repository class names and
    class names starting with ``I``."""
    name = F.col("class")  # both kinds in one pass over the scan
    kinds = F.array_compact(F.array(F.when(name.rlike("(Service|Repository)$"), F.lit("service")),
                                    F.when(name.startswith("I") & (F.length(name) > 1), F.lit("interface"))))
    return scan.select("repo", F.explode(kinds).alias("kind"), name.alias("name")).distinct()


# ------------------------------------------------------------------ V4
def endpoints(scan: DataFrame) -> DataFrame:
    """(repo, file, controller, method, class_ord, method_ord, verbs[], route):
    methods with at least one HttpX attribute, of any class with a body."""
    m = scan.where(F.col("method").isNotNull())
    verbs = F.array_sort(F.array_distinct(F.transform(
        _all(F.col("method_attrs"), HTTP_VERB, 1),
        lambda v: F.upper(F.regexp_replace(v, "(?i)^Http", "")))))
    class_route = _resolve_controller_token(_route(F.col("class_attrs")), F.col("class"))
    return (m.select("repo", "file", F.col("class").alias("controller"), "method", "class_ord", "method_ord",
                     verbs.alias("verbs"), join_routes(class_route, _route(F.col("method_attrs"))).alias("route"),
                     "body")
            .where(F.size("verbs") > 0))


# ------------------------------------------------------------------ V5
def _either(body: Column, pattern: str) -> Column:
    g1, g2 = _all(body, pattern, 1), _all(body, pattern, 2)
    return F.filter(F.transform(g1, lambda x, i: F.when(x != "", x).otherwise(F.element_at(g2, i + 1))),
                    lambda x: x != "")


def infer_steps(body: Column):
    """(steps array, messages array) of an endpoint body, as column
    expressions: id generation, DB writes, each published / sent type, the
    types of sent variables not yet listed, a send-endpoint lookup."""
    direct = F.concat(_either(body, PUBLISH), _either(body, SEND))
    # variable -> type; later declarations win, typed ones after var ones
    v1k, v1v = _all(body, VAR_NEW, 1), _all(body, VAR_NEW, 2)
    t1, t2, t3 = _all(body, TYPED_NEW, 1), _all(body, TYPED_NEW, 2), _all(body, TYPED_NEW, 3)
    t_res = F.transform(t1, lambda x, i: F.when(F.lower(x) == "var", F.element_at(t3, i + 1)).otherwise(x))
    keys = F.reverse(F.concat(v1k, t2))
    vals = F.reverse(F.concat(v1v, t_res))
    sent_vars = _either(body, VAR_SENT)
    resolved = F.transform(sent_vars, lambda v: F.when(F.array_position(keys, v) > 0,
                                                       F.element_at(vals, F.array_position(keys, v).cast("int"))))
    messages = F.aggregate(resolved, direct,
                           lambda acc, m: F.when(m.isNotNull() & ~F.array_contains(acc, m),
                                                 F.concat(acc, F.array(m))).otherwise(acc))
    steps = F.concat(
        F.array_compact(F.array(
            F.when(body.rlike(java_re(r"Guid\.NewGuid\(|new\s+Guid\(")), F.lit("Generate OrderId")),
            F.when(body.rlike(java_re(r"\bSaveChanges(?:Async)?\(")) | body.rlike(java_re(r"\b(Add|AddAsync|Insert|Update)\b")),
                   F.lit("Insert/Update DB")))),
        F.transform(messages, lambda m: F.concat(F.lit("Publish/Send "), m, F.lit(" to queue"))),
        F.array_compact(F.array(F.when(body.rlike(java_re(r"GetSendEndpoint\(")), F.lit("Send to queue endpoint")))))
    empty = F.coalesce(body, F.lit("")) == ""
    none = F.array().cast("array<string>")
    return F.when(empty, none).otherwise(steps), F.when(empty, none).otherwise(messages)


def endpoint_bodies(eps: DataFrame) -> DataFrame:
    """Body per ``Controller.Method`` key: overloads collapse, the last one
    (file, class, method order) wins."""
    return (eps.groupBy("repo", "controller", "method")
            .agg(F.max_by("body", F.struct("file", "class_ord", "method_ord")).alias("body")))


def endpoint_steps(eps: DataFrame) -> DataFrame:
    """(repo, controller, method, steps[], messages[])."""
    b = endpoint_bodies(eps)
    steps, messages = infer_steps(F.col("body"))
    return b.select("repo", "controller", "method", steps.alias("steps"), messages.alias("messages"))


# ------------------------------------------------------------------ V6
def consumer_map(files: DataFrame) -> DataFrame:
    """(repo, message, consumer, reads_db, file, ord) over all C# files."""
    cs = files.where(F.col("language") == "csharp")
    c = F.col("content")
    pairs = F.arrays_zip(_all(c, CONSUMER_CLASS, 1).alias("consumer"), _all(c, CONSUMER_CLASS, 2).alias("message"))
    reads_db = c.contains("DbContext") | c.contains("DbSet") | c.contains("SaveChanges")
    return (cs.select("repo", F.col("relative_path").alias("file"), reads_db.alias("reads_db"),
                      F.posexplode(pairs).alias("ord", "x"))
            .select("repo", "x.message", "x.consumer", "reads_db", "file", F.col("ord").cast("long").alias("ord")))


# ------------------------------------------------------------------ V7
def endpoint_flows(steps: DataFrame, consumers: DataFrame) -> DataFrame:
    """(repo, controller, method, step_ord, step): the body steps, then per
    message and per consumer of it "reads queue" (and "reads DB")."""
    own = steps.select("repo", "controller", "method", F.posexplode("steps").alias("step_ord", "step"),
                       F.size("steps").alias("n_own"))
    msgs = steps.select("repo", "controller", "method", F.size("steps").alias("n_own"),
                        F.posexplode("messages").alias("mpos", "message"))
    cons = consumers.select("repo", "message", "consumer", "reads_db", "file", "ord")
    hits = msgs.join(cons, ["repo", "message"])
    extra = hits.select("repo", "controller", "method", "n_own", "mpos", "file", "ord",
                        F.explode(F.array_compact(F.array(
                            F.struct(F.lit(0).alias("k"), F.concat(F.lit("Consumer "), F.col("consumer"),
                                                                   F.lit(" reads queue")).alias("s")),
                            F.when(F.col("reads_db"), F.struct(F.lit(1).alias("k"), F.concat(
                                F.lit("Consumer "), F.col("consumer"), F.lit(" reads DB")).alias("s")))))).alias("x"))
    w = Window.partitionBy("repo", "controller", "method").orderBy("mpos", "file", "ord", "x.k")
    extra = extra.select("repo", "controller", "method",
                         (F.col("n_own") + F.row_number().over(w) - 1).alias("step_ord"), F.col("x.s").alias("step"))
    return (own.select("repo", "controller", "method", F.col("step_ord").cast("long").alias("step_ord"), "step")
            .unionByName(extra.withColumn("step_ord", F.col("step_ord").cast("long"))))


# ------------------------------------------------------------------ V8
def controller_dependencies(scan: DataFrame, ctrls: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, controller, dep_class): classes in files the controller's file
    depends on, named like services, repositories, consumers, handlers or
    interfaces. A controller name maps to its last file."""
    classes = cs_classes(scan).select("repo", "file", "class")
    ctrl_file = (classes.where(F.col("class").endswith("Controller"))
                 .groupBy("repo", "class").agg(F.max("file").alias("file"))
                 .withColumnRenamed("class", "controller"))
    named = ctrls.select("repo", "controller").distinct().join(ctrl_file, ["repo", "controller"])
    e = edges.select("repo", F.col("source").alias("file"), F.col("target").alias("dep_file"))
    deps = (named.join(e, ["repo", "file"])
            .join(classes.withColumnRenamed("file", "dep_file").withColumnRenamed("class", "dep_class"),
                  ["repo", "dep_file"])
            .where(F.col("dep_class").rlike(DEP_CLASS) | F.col("dep_class").startswith("I")))
    return deps.select("repo", "controller", "dep_class").distinct()


# ------------------------------------------------------------------ V9
def api_spec(eps: DataFrame, ctrl_deps: DataFrame, flows: DataFrame) -> DataFrame:
    """(repo, controller, method, verbs, route, components, steps); lists
    joined with ', ' (steps with ' | ')."""
    deps = (ctrl_deps.groupBy("repo", "controller")
            .agg(F.array_sort(F.collect_list("dep_class")).alias("deps")))
    st = (flows.groupBy("repo", "controller", "method")
          .agg(F.array_sort(F.collect_list(F.struct("step_ord", "step"))).alias("s"))
          .select("repo", "controller", "method", F.array_join("s.step", " | ").alias("steps")))
    out = (eps.join(deps, ["repo", "controller"], "left").join(st, ["repo", "controller", "method"], "left"))
    return out.select("repo", "controller", "method", F.array_join("verbs", ", ").alias("verbs"), "route",
                      F.array_join(F.concat(F.array("controller"), F.coalesce("deps", F.array().cast("array<string>"))),
                                   ", ").alias("components"),
                      F.coalesce("steps", F.lit("")).alias("steps"))


# ------------------------------------------------------------------ V10
def _safe(c: Column) -> Column:
    s = F.regexp_replace(c, r"(?U)[^\w]", "_")
    return F.when(s == "", F.lit("node")).otherwise(s)


def endpoint_sequences(eps: DataFrame, ctrl_deps: DataFrame, flows: DataFrame) -> DataFrame:
    """(repo, controller, method, seq, src, dst, label): request from the
    client, a call and a result per dependency, a note with the steps, the
    response."""
    deps = (ctrl_deps.groupBy("repo", "controller")
            .agg(F.array_sort(F.collect_list("dep_class")).alias("deps")))
    st = (flows.groupBy("repo", "controller", "method")
          .agg(F.array_sort(F.collect_list(F.struct("step_ord", "step"))).alias("s"))
          .select("repo", "controller", "method",
                  F.array_join(F.filter("s.step", lambda x: x != ""), " | ").alias("note")))
    base = (eps.select("repo", "controller", "method", "verbs", "route").distinct()
            .join(deps, ["repo", "controller"], "left").join(st, ["repo", "controller", "method"], "left")
            .withColumn("deps", F.coalesce("deps", F.array().cast("array<string>"))))
    ctl = _safe(F.col("controller"))
    label = F.trim(F.concat(F.array_join("verbs", ", "), F.lit(" "), F.col("route")))
    rows = F.concat(
        F.array(F.struct(F.lit("Client").alias("src"), ctl.alias("dst"),
                         F.when(label == "", F.lit("Request")).otherwise(label).alias("label"))),
        F.flatten(F.transform("deps", lambda d: F.array(
            F.struct(ctl.alias("src"), _safe(d).alias("dst"), F.lit("Call").alias("label")),
            F.struct(_safe(d).alias("src"), ctl.alias("dst"), F.lit("Result").alias("label"))))),
        F.array_compact(F.array(F.when(F.coalesce("note", F.lit("")) != "", F.struct(
            F.lit("Note").alias("src"), ctl.alias("dst"), F.col("note").alias("label"))))),
        F.array(F.struct(ctl.alias("src"), F.lit("Client").alias("dst"), F.lit("Response").alias("label"))))
    return (base.select("repo", "controller", "method", F.posexplode(rows).alias("seq", "x"))
            .select("repo", "controller", "method", F.col("seq").cast("long").alias("seq"), "x.src", "x.dst",
                    "x.label"))


# ------------------------------------------------------------------ V11
STEP_MESSAGE = r"Publish/Send\s+([^\s]+)"
STEP_CONSUMER = r"Consumer\s+([^\s]+)\s+reads queue"


def _seq_id(c: Column) -> Column:
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[^\w]", "_")
    return F.when(s == "", F.lit("node")).when(s.rlike(r"^\d"), F.concat(F.lit("node_"), s)).otherwise(s)


def _seq_msg(c: Column) -> Column:
    s = F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))
    s = F.regexp_replace(s, r"[\[\]\"<>`|:]", "")
    s = F.translate(s, "/\\", "  ")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.when(s == "", F.lit("Message")).otherwise(s)


def app_sequence(ctrls: DataFrame, scan: DataFrame, eps: DataFrame, ctrl_deps: DataFrame, flows: DataFrame,
                 mq_flows: DataFrame | None = None, max_endpoints: int | None = None) -> DataFrame:
    """V11 (repo, file, class_ord, method_ord, pos, src, dst, label): the
    application sequence of each repo, in the order of the sort columns
    file, class_ord, method_ord, pos: per endpoint request, service hand-off, published messages and their
    consumers, response. With ``max_endpoints`` only the first endpoints of a repo (a
    rank filter) are shown."""
    svc = services_and_interfaces(scan).groupBy("repo").agg(
        F.min(F.when(F.col("kind") == "service", F.col("name"))).alias("s"),
        F.min(F.when(F.col("kind") == "interface", F.col("name"))).alias("i"))
    # one row per repo: sent to the endpoints, which a join by the repo alone would bring into one task
    svc = F.broadcast(svc.select("repo", F.coalesce("s", "i").alias("service")))
    steps = flows.select("repo", "controller", "method", "step_ord", "step",
                         F.regexp_extract("step", STEP_MESSAGE, 1).alias("msg"),
                         F.regexp_extract("step", STEP_CONSUMER, 1).alias("cons"))
    any_cons = F.broadcast(steps.where(F.col("cons") != "").select("repo").distinct().withColumn("has_cons", F.lit(True)))
    queue = None
    if mq_flows is not None:
        queue = F.broadcast(mq_flows.where(F.coalesce("queue", F.lit("")) != "")
                            .groupBy("repo").agg(F.min_by("queue", F.struct("file", "ord")).alias("mq_queue")))
    first = eps
    if max_endpoints is not None:
        w = Window.partitionBy("repo").orderBy("file", "class_ord", "method_ord")
        first = eps.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_endpoints)
    deps = (ctrl_deps.groupBy("repo", "controller")
            .agg(F.array_sort(F.collect_list("dep_class")).alias("deps")))
    per_ep_steps = (steps.groupBy("repo", "controller", "method")
                    .agg(F.array_sort(F.collect_list(F.struct("step_ord", "msg", "cons"))).alias("st")))
    e = (first.join(deps, ["repo", "controller"], "left").join(per_ep_steps, ["repo", "controller", "method"], "left")
         .join(svc, "repo", "left").join(any_cons, "repo", "left"))
    if queue is not None:
        e = e.join(queue, "repo", "left")
    else:
        e = e.withColumn("mq_queue", F.lit(None).cast("string"))
    e = e.withColumn("queue", F.coalesce(F.col("mq_queue"),
                                         F.when(F.col("has_cons"), F.lit("RabbitMQ"))))
    deps_c = F.coalesce("deps", F.array().cast("array<string>"))
    service_dep = F.try_element_at(F.filter(deps_c, lambda x: x.rlike("(Service|Handler)$")), F.lit(1))
    repo_dep = F.try_element_at(F.filter(deps_c, lambda x: x.rlike("(Repository|DbContext)$")), F.lit(1))
    st = F.coalesce("st", F.array().cast("array<struct<step_ord:long,msg:string,cons:string>>"))
    msgs = F.transform(F.filter(st, lambda x: x["msg"] != ""), lambda x: x["msg"])
    cons = F.transform(F.filter(st, lambda x: x["cons"] != ""), lambda x: x["cons"])
    label = F.trim(F.concat(F.array_join("verbs", ", "), F.lit(" "), F.col("route")))

    def row(src, dst, lab):
        return F.struct(src.alias("src"), dst.alias("dst"), lab.alias("label"))
    # names are made once an endpoint, not in every line that shows them
    e = e.withColumns({"_sd": service_dep, "_rd": repo_dep, "_msgs": msgs, "_cons": cons})
    e = e.withColumns({"_t": _seq_id(F.col("controller")), "_sdn": _seq_id(F.col("_sd")), "_rdn": _seq_id(F.col("_rd")),
                       "_sv": _seq_id(F.col("service")), "_q": _seq_id(F.col("queue")),
                       "_cn": F.transform("_cons", _seq_id)})
    t, sd, rd, sv, q, msgs, cons = (F.col(c) for c in ("_t", "_sdn", "_rdn", "_sv", "_q", "_msgs", "_cn"))
    handle = F.when(F.col("_sd").isNotNull(), F.concat(
        F.array(row(t, sd, F.lit("Handle"))),
        F.when(F.col("_rd").isNotNull(), F.array(row(sd, rd, F.lit("Query Save")), row(rd, sd, F.lit("Result"))))
        .otherwise(F.array().cast("array<struct<src:string,dst:string,label:string>>")),
        F.array(row(sd, t, F.lit("Result"))))).when(
        F.col("service").isNotNull() & (F.col("controller") != F.col("service")),
        F.array(row(t, sv, F.lit("Handle")), row(sv, t, F.lit("Result")))).otherwise(
        F.array().cast("array<struct<src:string,dst:string,label:string>>"))
    publish = F.when(F.col("queue").isNotNull(), F.flatten(F.transform(msgs, lambda m: F.concat(
        F.array(row(t, q, _seq_msg(F.concat(F.lit("Publish Send "), m)))),
        F.transform(cons, lambda c: row(q, c, _seq_msg(F.concat(F.lit("Consume "), m)))))))).otherwise(
        F.flatten(F.transform(msgs, lambda m: F.transform(
            cons, lambda c: row(t, c, _seq_msg(F.concat(F.lit("Publish Send "), m)))))))
    rows = F.concat(F.array(row(F.lit("Client"), t, _seq_msg(F.when(label == "", F.lit("Request")).otherwise(label)))),
                    handle, publish, F.array(row(t, F.lit("Client"), F.lit("Response"))))
    out = e.select("repo", "file", "class_ord", "method_ord", F.posexplode(rows).alias("pos", "x"))
    return out.select("repo", "file", F.col("class_ord").cast("long").alias("class_ord"), F.col("method_ord").cast("long").alias("method_ord"),
                      F.col("pos").cast("long").alias("pos"), "x.src", "x.dst", "x.label")
