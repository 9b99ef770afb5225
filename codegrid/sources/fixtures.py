"""Derived fixtures: source-code corpora written from the driver tables.

Each builder turns relational rows into file rows whose *text* encodes the
relations (FIXTURES.md §2). The extraction jobs then parse the text back,
and the SQL oracles compute the expected rows from the relational columns,
so the two sides share no logic. Every builder is a plain DataFrame job,
so the corpus grows with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import files_from, table


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _lines_for(n: Column, line) -> Column:
    """Concatenate ``line(i)`` for i = 0 .. n-1 ('' when n <= 0)."""
    return F.when(n > 0, F.array_join(
        F.transform(F.sequence(F.lit(0), n - 1), line), "")).otherwise(F.lit(""))


# ---------------------------------------------------------------- fx_java
def java_targets(spark: SparkSession, sf_dir: str, n_parts: int) -> DataFrame:
    """(p, q): distinct part -> part references from the line items."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").alias("p"),
        ((F.col("l_suppkey") * 7 + F.col("l_orderkey")) % F.lit(n_parts)).alias("q"))


def fx_java(spark: SparkSession, sf_dir: str, rule_imports: bool = False) -> DataFrame:
    """One Java file per ``part`` row (optionally with the rule-2/3/4 imports)."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"),
                                               F.col("p_size").alias("z"))
    n = part.count()
    # collect_set is combined map-side; a part has a bounded number of
    # line items, so the per-file list stays small at any scale
    imports = (java_targets(spark, sf_dir, n).groupBy("p")
               .agg(F.array_sort(F.collect_set("q")).alias("qs"))
               .select("p", F.array_join(F.transform("qs", lambda q: F.concat(
                   F.lit("import com.brand"), _s(q % 25), F.lit(".Part"), _s(q), F.lit(";\n"))),
                   "").alias("imports")))
    p, z = F.col("p"), F.col("z")
    b = p % 25
    extra = F.lit("")
    if rule_imports:
        extra = F.when(p % 100 == 0, F.concat(
            F.lit("import legacy.Part"), _s((p + 1) % F.lit(n)), F.lit(";\n"),
            F.lit("import com.brand"), _s((b + 1) % 25), F.lit(".*;\n"),
            F.lit("import d"), _s(b), F.lit(".Part;\n"))).otherwise(F.lit(""))
    content = F.concat(
        F.lit("package com.brand"), _s(b), F.lit(";\n"),
        F.coalesce(F.col("imports"), F.lit("")),
        extra,
        F.when(p % 3 == 0, F.lit("import java.util.List;\n")).otherwise(F.lit("")),
        F.lit("public class Part"), _s(p), F.lit(" extends Base"), _s(b),
        F.lit(" implements Sized, Item"), _s(z), F.lit(" {\n"),
        F.lit("private int size = "), _s(z), F.lit(";\n"),
        _lines_for(p % 4, lambda i: F.concat(F.lit("public int m"), _s(i), F.lit("() { }\n"))),
        F.lit("}\n"),
        F.when(p % 11 == 0, F.concat(F.lit("public interface IPart"), _s(p), F.lit(" {\n}\n")))
        .otherwise(F.lit("")),
        F.when(p % 5 == 0, F.concat(F.lit("enum Kind"), _s(p), F.lit(" {A"), _s(z), F.lit(",B,C}\n")))
        .otherwise(F.lit("")),
    )
    rows = part.join(imports, "p", "left")
    return files_from(rows, F.lit("parts"),
                      F.concat(F.lit("src/brand"), _s(b), F.lit("/Part"), _s(p), F.lit(".java")),
                      content)


# ---------------------------------------------------------------- fx_docs
# FIXED VALUES: suffix by doc_id % 12 (upper-case .YAML and .min.js on purpose)
DOC_EXTENSIONS = [".java", ".cs", ".vb", ".fs", ".php", ".js", ".ts", ".html", ".json", ".YAML",
                  ".txt", ".min.js"]


def fx_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per ``documents`` row: repo = source, text = content."""
    docs = table(spark, sf_dir, "documents")
    d = F.col("doc_id")
    ext = F.element_at(F.array(*[F.lit(e) for e in DOC_EXTENSIONS]), (d % 12 + 1).cast("int"))
    folder = (F.when(d % 17 == 0, F.lit("node_modules/")).when(d % 19 == 0, F.lit("cabin/"))
              .when(d % 23 == 0, F.lit("rebuild/")).otherwise(F.lit("")))
    rel = F.concat(folder, F.col("lang"), F.lit("/doc_"), _s(d), ext)
    return files_from(docs, F.col("source"), rel, F.col("text"))


# ---------------------------------------------------------------- fx_node
def fx_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One TypeScript / Angular component file per supplier."""
    s = F.col("s_suppkey")
    content = F.concat(
        F.lit('import { Component } from "@angular/core";\n@Component({})\nexport class Supplier'), _s(s),
        F.lit("Component {\n}\nfunction load"), _s(s), F.lit("(a) {\n}\nconst pick"), _s(s),
        F.lit(" = (x) => x;\n"))
    rel = F.concat(F.lit("web/src/app/s"), _s(s), F.lit(".component.ts"))
    return files_from(table(spark, sf_dir, "supplier"), F.lit("web"), rel, content)


# ---------------------------------------------------------------- fx_mq
def fx_mq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messaging corpus: infra config per region (JSON for even, YAML for
    odd regions), a Node publisher per customer, a MassTransit consumer per
    supplier."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"),
                                                   F.col("n_regionkey").alias("r"))
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r"))
    # per region: its nations' queues (a region has a bounded nation list)
    qs = (nation.groupBy("r").agg(F.array_sort(F.collect_list("n")).alias("ns")))
    reg = region.join(qs, "r", "left").withColumn("ns", F.coalesce("ns", F.array().cast("array<int>")))
    r = F.col("r")
    json_text = F.concat(
        F.lit('{"rabbitmq": {"exchanges": [{"name": "region'), _s(r), F.lit('", "type": "topic"}], "queues": ['),
        F.array_join(F.transform("ns", lambda n: F.concat(
            F.lit('{"name": "q-nation'), _s(n), F.lit('", "durable": true, "binding": {"exchange": "region'),
            _s(r), F.lit('", "routing_key": "nation'), _s(n), F.lit('"}}'))), ", "),
        F.lit(']}, "topics": [{"name": "topic'), _s(r), F.lit('"}]}'))
    yaml_text = F.concat(
        F.lit("rabbitmq:\n  exchanges:\n  - name: region"), _s(r), F.lit("\n    type: topic\n  queues:"),
        F.when(F.size("ns") == 0, F.lit(" []")).otherwise(F.lit("")), F.lit("\n"),
        F.array_join(F.transform("ns", lambda n: F.concat(
            F.lit("  - name: q-nation"), _s(n), F.lit("\n    durable: true\n    binding:\n      exchange: region"),
            _s(r), F.lit("\n      routing_key: nation"), _s(n), F.lit("\n"))), ""),
        F.lit("topics:\n- name: topic"), _s(r), F.lit("\n"))
    infra = files_from(reg, F.lit("mq"),
                       F.concat(F.lit("infra/region"), _s(r), F.when(r % 2 == 0, F.lit(".json")).otherwise(F.lit(".yaml"))),
                       F.when(r % 2 == 0, json_text).otherwise(yaml_text))

    cust = (table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
            .join(F.broadcast(nation), "n"))
    k, n = F.col("k"), F.col("n")
    node_text = F.concat(
        F.lit('import amqplib from "amqplib";\nchannel.publish("region'), _s(r), F.lit('", "nation'), _s(n),
        F.lit('", x);\n'),
        F.when(k % 10 == 0, F.concat(F.lit('channel.sendToQueue("q-nation'), _s(n), F.lit('", x);\n')))
        .otherwise(F.lit("")),
        F.when(k % 25 == 0, F.concat(F.lit('channel.assertQueue("q-nation'), _s(n), F.lit('");\nchannel.consume("q-nation'),
                                     _s(n), F.lit('", f);\n'))).otherwise(F.lit("")))
    node = files_from(cust, F.lit("mq"), F.concat(F.lit("node/customer"), _s(k), F.lit(".ts")), node_text)

    supp = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("n"))
    s = F.col("s")
    cs_text = F.concat(
        F.lit("using MassTransit;\nclass Supplier"), _s(s), F.lit("Consumer : IConsumer<Nation"), _s(n),
        F.lit("Changed> { }\ncfg.ReceiveEndpoint(\"q-nation"), _s(n), F.lit("\", e => { e.Consumer<Supplier"), _s(s),
        F.lit("Consumer>(ctx); });\nbus.Publish(new Nation"), _s(n),
        F.lit("Audited());\nGetSendEndpoint(new Uri(\"rabbitmq://host/q-nation"), _s(n), F.lit("\"));\n"))
    cs = files_from(supp, F.lit("mq"), F.concat(F.lit("cs/Supplier"), _s(s), F.lit(".cs")), cs_text)
    return infra.unionByName(node).unionByName(cs)


# ---------------------------------------------------------------- fx_pages
def fx_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One HTML file per page; every fifth page gets a custom element."""
    p = F.col("page_id")
    content = F.concat(F.col("html"), F.when(p % 5 == 0, F.lit("<x-card>")).otherwise(F.lit("")))
    return files_from(table(spark, sf_dir, "pages"), F.lit("pages"),
                      F.concat(F.lit("pages/page_"), _s(p), F.lit(".html")), content)


# ---------------------------------------------------------------- fx_config
def fx_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One config file per event, its text chosen by event_id % 10."""
    ev = table(spark, sf_dir, "events")
    e = F.col("event_id")
    v = F.regexp_extract("props", r"(-?\d+)", 1)
    content = (F.when(e % 10 == 0, F.concat(F.lit("k: "), v))
               .when(e % 10 == 1, F.concat(F.lit('{"k": '), v))
               .when(e % 10 == 2, F.col("event_type"))
               .when(e % 10 == 3, F.concat(F.lit("["), v, F.lit("]")))
               .otherwise(F.col("props")))
    return files_from(ev, F.lit("conf"), F.concat(F.lit("conf/"), _s(e), F.lit(".json")), content)


# ---------------------------------------------------------------- fx_csharp
SEGMENTS_SORTED = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def fx_csharp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASP.NET-style corpus: a controller per customer with one endpoint per
    order, a service and a consumer per supplier. Namespaces and messages are
    shared by 150 customers and 10 suppliers, so that the fan-out of a
    controller or a message is the same at every scale."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r"))
    cust = (table(spark, sf_dir, "customer")
            .select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"),
                    F.initcap("c_mktsegment").alias("seg"))
            .join(F.broadcast(nation), "n"))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("k"),
        F.col("o_orderstatus").alias("st"), F.substring("o_orderpriority", 1, 1).alias("pr"))
    o, seg, zone = F.col("o"), F.col("seg"), _s(F.expr("k div 150"))
    verb = F.when(F.col("st") == "F", F.lit("Get")).when(F.col("st") == "O", F.lit("Post")).otherwise(F.lit("Put"))
    body = (F.when(F.col("pr") == "1", F.concat(F.lit("Publish(new "), seg, zone, F.lit("Placed(1));")))
            .when(F.col("pr") == "2", F.lit("SaveChanges();"))
            .when(F.col("pr") == "3", F.lit("var id = Guid.NewGuid();"))
            .when(F.col("pr") == "4", F.concat(F.lit("var m = new "), seg, zone, F.lit("Placed(1);\nSend(m);")))
            .otherwise(F.lit("")))
    method = F.concat(F.lit("[Http"), verb, F.lit('("order/'), _s(o), F.lit('")]\npublic IActionResult Order'), _s(o),
                      F.lit("()\n{\n"), body, F.lit("\n}\n"))
    # a customer has a bounded number of orders; the methods are one file
    methods = (orders.join(cust.select("k", "seg"), "k")
               .groupBy("k").agg(F.array_sort(F.collect_list(F.struct(o, method.alias("m")))).alias("ms"))
               .select("k", F.array_join("ms.m", "").alias("methods")))
    k, r = F.col("k"), F.col("r")
    ctrl_text = F.concat(
        F.lit("using Region"), _s(r), F.lit(".Zone"), zone, F.lit(".Services;\nnamespace Region"), _s(r),
        F.lit('.Controllers\n{\n[ApiController]\n[Route("api/[controller]")]\npublic class Customer'), _s(k),
        F.lit("Controller : ControllerBase\n{\n"), F.coalesce("methods", F.lit("")), F.lit("}\n}"))
    ctrl = files_from(cust.join(methods, "k", "left"), F.lit("shop"),
                      F.concat(F.lit("Api/Controllers/Customer"), _s(k), F.lit("Controller.cs")), ctrl_text)

    supp = (table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("n"))
            .join(F.broadcast(nation), "n"))
    s, zone = F.col("s"), _s(F.expr("s div 10"))
    svc = files_from(supp, F.lit("shop"),
                     F.concat(F.lit("Api/Services/Supplier"), _s(s), F.lit("Service.cs")),
                     F.concat(F.lit("namespace Region"), _s(r), F.lit(".Zone"), zone, F.lit(".Services\n{\npublic class Supplier"), _s(s),
                              F.lit("Service\n{\n}\n}")))
    seg_of = F.element_at(F.array(*[F.lit(x.capitalize()) for x in SEGMENTS_SORTED]), (s % 5 + 1).cast("int"))
    cons = files_from(supp, F.lit("shop"),
                      F.concat(F.lit("Worker/Supplier"), _s(s), F.lit("Consumer.cs")),
                      F.concat(F.lit("namespace Worker\n{\npublic class Supplier"), _s(s),
                               F.lit("Consumer : IConsumer<"), seg_of, zone, F.lit("Placed>\n{\n}\n}"),
                               F.when(s % 2 == 0, F.lit("\n// uses ShopDbContext")).otherwise(F.lit(""))))
    return ctrl.unionByName(svc).unionByName(cons)


# ---------------------------------------------------------------- fx_calls
def event_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, t, n): distinct event-type transitions per user in (ts, event_id)
    order. The window is partitioned by user, so no partition grows with
    the table."""
    from pyspark.sql.window import Window
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return (ev.withColumn("nxt", F.lead("event_type").over(w)).where(F.col("nxt").isNotNull())
            .select(F.col("user_id").alias("u"), F.col("event_type").alias("t"), F.col("nxt").alias("n"))
            .distinct())


def fx_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: a C# class whose methods call their successor event types,
    and a Java file with one class per event type plus call lines."""
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("u"), F.col("event_type").alias("t")).distinct()
    tr = event_transitions(spark, sf_dir)
    per_type = (ev.join(tr.groupBy("u", "t").agg(F.array_sort(F.collect_set("n")).alias("ns")), ["u", "t"], "left")
                .withColumn("ns", F.coalesce("ns", F.array().cast("array<string>"))))
    line = F.concat(F.lit("public void "), F.col("t"), F.lit("() { "),
                    F.array_join(F.transform("ns", lambda x: F.concat(x, F.lit("(); "))), ""), F.lit("}\n"))
    jline = F.concat(F.lit("class "), F.initcap("t"), F.lit(" { public void "), F.col("t"), F.lit("() { } }\n"))
    per_user = (per_type.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("t", line.alias("cs"),
                                                                                jline.alias("jv")))).alias("x")))
    calls = (tr.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("t", "n"))).alias("tn"))
             .select("u", F.array_join(F.transform("tn", lambda x: F.concat(F.lit("// x."), x["n"], F.lit("();\n"))),
                                       "").alias("calls")))
    rows = per_user.join(calls, "u", "left")
    u = F.col("u")
    cs = files_from(rows, F.lit("calls"), F.concat(F.lit("calls/User"), _s(u), F.lit(".cs")),
                    F.concat(F.lit("class User"), _s(u), F.lit(" {\n"), F.array_join("x.cs", ""), F.lit("}")))
    jv = files_from(rows, F.lit("calls"), F.concat(F.lit("calls/Flow"), _s(u), F.lit(".java")),
                    F.concat(F.array_join("x.jv", ""), F.coalesce("calls", F.lit(""))))
    return cs.unionByName(jv)


# ---------------------------------------------------------------- fx_links
def fx_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One class file per customer in four languages, a repo per region. A
    file imports the customers that its orders point to; those of other
    regions resolve to nothing, so the graphs are sparse: files without any
    edge, acyclic parts, cycles of several lengths. PHP imports resolve by
    the last rule only (the index key has a leading separator)."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r"))
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    total = cust.count()
    target = (F.col("o_orderkey") * 13 + 5) % F.lit(total)
    # a customer has a bounded number of orders, so the per-file list stays small
    refs = (table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), target.alias("q")).distinct()
            .join(cust.select(F.col("k").alias("q"), F.col("n").alias("m")), "q")
            .groupBy("k").agg(F.array_sort(F.collect_list(F.struct("q", "m"))).alias("qs")))
    rows = cust.join(nation, "n").join(refs, "k", "left").withColumn("qs", F.coalesce("qs", F.array().cast("array<struct<q:bigint,m:bigint>>")))
    k, n, lang = F.col("k"), F.col("n"), F.col("k") % 4

    def uses(word: str, sep: str, end: str):
        return F.array_join(F.transform("qs", lambda x: F.concat(
            F.lit(f"{word} com{sep}n"), _s(x["m"]), F.lit(f"{sep}C"), _s(x["q"]), F.lit(f"{end}\n"))), "")
    java = F.concat(F.lit("package com.n"), _s(n), F.lit(";\n"), uses("import", ".", ";"), F.lit("public class C"), _s(k),
                    F.lit(" extends Base"), _s(n), F.lit(" implements Sized {\npublic void run() { }\n}\n"))
    csharp = F.concat(uses("using", ".", ";"), F.lit("namespace com.n"), _s(n), F.lit("\n{\npublic class C"), _s(k),
                      F.lit(" : Base"), _s(n), F.lit(", Sized\n{\n}\n}\n"))
    php = F.concat(F.lit("<?php\nnamespace com\\n"), _s(n), F.lit(";\n"), uses("use", "\\", ";"), F.lit("final class C"), _s(k),
                   F.lit(" extends Base"), _s(n), F.lit(" {\n}\n"))
    vbnet = F.concat(uses("Imports", ".", ""), F.lit("Namespace com.n"), _s(n), F.lit("\nPublic Class C"), _s(k), F.lit("\nEnd Class"))
    content = F.when(lang == 0, java).when(lang == 1, csharp).when(lang == 2, php).otherwise(vbnet)
    ext = F.element_at(F.array(*[F.lit(e) for e in LINK_EXTENSIONS]), (lang + 1).cast("int"))
    return files_from(rows, F.concat(F.lit("region"), _s("r")), F.concat(F.lit("src/n"), _s(n), F.lit("/C"), _s(k), ext), content)


# FIXED VALUES: suffix by customer % 4
LINK_EXTENSIONS = [".java", ".cs", ".php", ".vb"]
