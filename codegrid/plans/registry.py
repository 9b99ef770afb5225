"""Registered queries: one callable (spark, sf_dir) -> DataFrame per key.

Every query derives its corpus from the driver tables (fixtures.py), so its
work grows with the scale factor, and returns flat rows whose column names
match the SQL oracle of the same key (plans/oracles.py).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calls, catalog, correlation, cycles, deps, documents, extract, members, messaging, packing, reports, textprep
import uuid

from ..sources import filters, fixtures, tree
from ..sources.tables import files_from, table
from ..functions import plugins
from ..streaming import files as streaming
from ..session import ensure_checkpoint_dir
from .materialize import checkpoint, reuse

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- shared graph
class Graph:
    """Dependency graph of one corpus. Each table is computed when a query first asks for it, and then checkpointed if later
    plans start from it; building a query that needs none computes none."""

    def __init__(self, files: DataFrame):
        self.files = deps.analyzable(files)

    @cached_property
    def symbols(self) -> DataFrame:
        # content is scanned once; the symbol tables are projections of it
        return checkpoint(extract.symbol_table(self.files))

    @cached_property
    def units(self) -> DataFrame:
        return extract.units_of(self.symbols)

    @cached_property
    def imports(self) -> DataFrame:
        return extract.imports_of(self.symbols)

    @cached_property
    def entries(self) -> DataFrame:
        return deps.type_entries(extract.types_of(self.symbols))

    @cached_property
    def index(self) -> DataFrame:
        return checkpoint(deps.build_type_index(self.entries))

    @cached_property
    def packages(self) -> DataFrame:
        return deps.build_package_index(self.units)

    @cached_property
    def rules(self) -> DataFrame:
        # one row per distinct import, found once for all rules; what the files make of it is a join that only runs where its rows are asked for
        wanted = checkpoint(deps.wanted_imports(self.imports).select("repo", "imp", "pkg_rule").distinct()).hint("merge")
        return checkpoint(deps.import_rules(wanted, self.index, self.packages))

    @cached_property
    def resolved(self) -> DataFrame:
        return deps.resolved_by(self.imports, self.rules, self.packages)

    @cached_property
    def edges(self) -> DataFrame:
        return checkpoint(deps.dependency_edges(self.resolved))

    def nodes(self) -> DataFrame:
        return deps.graph_nodes(self.units, self.edges, self.entries)

    def external(self) -> DataFrame:
        return deps.unresolved(self.imports, self.rules)


def java_graph(spark: SparkSession, sf_dir: str, rule_imports: bool = False) -> Graph:
    return Graph(fixtures.fx_java(spark, sf_dir, rule_imports))


# ---------------------------------------------------------------- S: sources
DOMAIN_PROFILES = [
    {"name": "java-only", "include_patterns": ["**/*.java"]},
    {"name": "web", "include_patterns": ["**/*.js", "**/*.ts", "**/*.html"],
     "exclude_patterns": ["**/node_modules/**"]},
]
_CORPUS_ROOTS: dict[tuple, str] = {}


def docs_corpus_root(spark: SparkSession, sf_dir: str) -> str:
    """fx_docs written once per session as real files under the shared
    checkpoint folder: ``<root>/<source>/main/<relative_path>``."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CORPUS_ROOTS:
        base = ensure_checkpoint_dir(spark).rstrip("/")
        root = f"{base}/corpus-{uuid.uuid4().hex}-d"
        docs = fixtures.fx_docs(spark, sf_dir)
        tree.write_corpus(docs.withColumn("repo", F.concat("repo", F.lit("/main"))), root)
        _CORPUS_ROOTS[key] = root
    return _CORPUS_ROOTS[key]


def _md5(df: DataFrame) -> DataFrame:
    return df.withColumn("content_md5", F.md5("content"))


@register("src_filter_paths")
def q_src_filter_paths(spark, d):
    return filters.filter_paths(fixtures.fx_docs(spark, d)).select("repo", "relative_path")


@register("src_filter_size")
def q_src_filter_size(spark, d):
    return filters.filter_size(fixtures.fx_docs(spark, d), 0.01).select("repo", "relative_path", "size_bytes")


@register("src_detect_language")
def q_src_detect_language(spark, d):
    return filters.detect_language(fixtures.fx_docs(spark, d)).select("repo", "relative_path", "ext", "language")


@register("src_domains")
def q_src_domains(spark, d):
    return (filters.apply_domain_profiles(fixtures.fx_docs(spark, d), DOMAIN_PROFILES)
            .select("domain", "repo", "relative_path"))


@register("src_drop_unsupported")
def q_src_drop_unsupported(spark, d):
    return filters.drop_unsupported(fixtures.fx_docs(spark, d)).select("repo", "relative_path", "language")


@register("src_read_tree")
def q_src_read_tree(spark, d):
    root = docs_corpus_root(spark, d)
    return _md5(tree.read_source_tree(spark, root, repo="corpus")).select(
        "repo", "relative_path", "language", "size_bytes", "content_md5")


@register("src_read_rejected")
def q_src_read_rejected(spark, d):
    root = docs_corpus_root(spark, d)
    return tree.rejected_files(spark, root, repo="corpus", max_mb=0.01).select("repo", "relative_path", "size_bytes", "reason")


@register("src_read_one")
def q_src_read_one(spark, d):
    root = docs_corpus_root(spark, d)
    return _md5(tree.read_single_file(spark, root + "/*/main/*/*")).select(
        "name", "language", "size_bytes", "content_md5")


@register("src_repo_snapshots")
def q_src_repo_snapshots(spark, d):
    root = docs_corpus_root(spark, d)
    return _md5(tree.read_repo_snapshots(spark, root)).select(
        "repo", "branch", "relative_path", "language", "size_bytes", "content_md5")


# ---------------------------------------------------------------- P: symbols
@register("sym_units")
def q_sym_units(spark, d):
    return extract.extract_units(fixtures.fx_java(spark, d))


@register("sym_imports")
def q_sym_imports(spark, d):
    return extract.extract_imports(fixtures.fx_java(spark, d))


@register("sym_types")
def q_sym_types(spark, d):
    return extract.extract_types(fixtures.fx_java(spark, d))


@register("sym_heritage")
def q_sym_heritage(spark, d):
    return extract.extract_heritage(fixtures.fx_java(spark, d))


@register("sym_members")
def q_sym_members(spark, d):
    return members.members(members.scan(fixtures.fx_java(spark, d)))


@register("sym_modifiers")
def q_sym_modifiers(spark, d):
    return members.member_modifiers(members.scan(fixtures.fx_java(spark, d)))


@register("sym_constants")
def q_sym_constants(spark, d):
    return members.constants(members.scan(fixtures.fx_java(spark, d)))


@register("sym_functions")
def q_sym_functions(spark, d):
    return extract.extract_functions(fixtures.fx_node(spark, d))


@register("sym_decorators")
def q_sym_decorators(spark, d):
    return members.decorators(members.scan(fixtures.fx_node(spark, d)))


@register("sym_comments")
def q_sym_comments(spark, d):
    return extract.extract_comments(fixtures.fx_pages(spark, d))


@register("sym_markup_tags")
def q_sym_markup_tags(spark, d):
    return extract.extract_markup_tags(fixtures.fx_pages(spark, d))


@register("sym_config_keys")
def q_sym_config_keys(spark, d):
    return extract.extract_config_keys(fixtures.fx_config(spark, d))


# ---------------------------------------------------------------- D: graph
@register("dep_type_index")
def q_dep_type_index(spark, d):
    g = java_graph(spark, d)
    return g.index.select("repo", "key", "file")


@register("dep_package_index")
def q_dep_package_index(spark, d):
    return deps.build_package_index(extract.extract_units(fixtures.fx_java(spark, d)))


@register("dep_resolve")
def q_dep_resolve(spark, d):
    return java_graph(spark, d, rule_imports=True).resolved.select(
        "repo", "file", "import", "rule", "target")


@register("dep_edges")
def q_dep_edges(spark, d):
    return java_graph(spark, d).edges


@register("dep_external")
def q_dep_external(spark, d):
    return java_graph(spark, d).external()


@register("dep_nodes")
def q_dep_nodes(spark, d):
    return java_graph(spark, d).nodes()


@register("dep_metrics")
def q_dep_metrics(spark, d):
    g = java_graph(spark, d)
    return deps.graph_metrics(g.nodes(), g.edges, g.index, g.entries, g.external())


@register("dep_in_cycle")
def q_dep_in_cycle(spark, d):
    return cycles.files_in_cycles(java_graph(spark, d).edges, checkpoint)


@register("dep_cycles")
def q_dep_cycles(spark, d):
    return cycles.simple_cycles(java_graph(spark, d).edges, 3, checkpoint)


@register("dep_orphans")
def q_dep_orphans(spark, d):
    return deps.orphaned_files(java_graph(spark, d).nodes())


@register("dep_coupled")
def q_dep_coupled(spark, d):
    return deps.highly_coupled_files(java_graph(spark, d).nodes())


@register("dep_sample")
def q_dep_sample(spark, d):
    return deps.sample_graph(java_graph(spark, d).edges)


@register("dep_display_edges")
def q_dep_display_edges(spark, d):
    return deps.display_edges(java_graph(spark, d).edges)


@register("dep_export_lines")
def q_dep_export_lines(spark, d):
    g = java_graph(spark, d)
    nodes = g.nodes()
    return deps.export_lines(nodes, g.edges, "mermaid").unionByName(
        deps.export_lines(nodes, g.edges, "dot"))


# ---------------------------------------------------------------- four languages, five repos
def links_graph(spark, d) -> Graph:
    return Graph(fixtures.fx_links(spark, d))


@register("sym_links_types")
def q_sym_links_types(spark, d):
    return extract.extract_types(fixtures.fx_links(spark, d))


@register("sym_links_heritage")
def q_sym_links_heritage(spark, d):
    return extract.extract_heritage(fixtures.fx_links(spark, d))


@register("dep_links_resolve")
def q_dep_links_resolve(spark, d):
    return links_graph(spark, d).resolved.select("repo", "file", "import", "rule", "target")


@register("dep_links_orphans")
def q_dep_links_orphans(spark, d):
    return deps.orphaned_files(links_graph(spark, d).nodes())


@register("dep_links_in_cycle")
def q_dep_links_in_cycle(spark, d):
    return cycles.files_in_cycles(links_graph(spark, d).edges, checkpoint)


@register("dep_links_components")
def q_dep_links_components(spark, d):
    return cycles.strongly_connected(links_graph(spark, d).edges, checkpoint)


@register("dep_links_cycles")
def q_dep_links_cycles(spark, d):
    return cycles.simple_cycles(links_graph(spark, d).edges, 5, checkpoint)


@register("dep_links_report")
def q_dep_links_report(spark, d):
    g = links_graph(spark, d)
    nodes = g.nodes()
    return documents.dependency_report(
        deps.graph_metrics(nodes, g.edges, g.index, g.entries, g.external()), cycles.simple_cycles(g.edges, 3, checkpoint),
        deps.orphaned_files(nodes), deps.highly_coupled_files(nodes, k=10), g.edges)


@register("dep_links_json")
def q_dep_links_json(spark, d):
    g = links_graph(spark, d)
    nodes = g.nodes()
    return documents.json_lines(nodes=nodes.select("repo", "file", "dependency_count", "dependent_count"), edges=g.edges,
                                external=g.external(), orphans=deps.orphaned_files(nodes))


# ---------------------------------------------------------------- M: messaging
class Messaging:
    """Messaging facts of one corpus (candidates gate first, facts once)."""

    def __init__(self, files: DataFrame):
        # the gate keeps only messaging-relevant files (a small share of a
        # corpus); they are materialised once and every fact table reads them
        self.cands = checkpoint(messaging.messaging_candidates(deps.analyzable(files)))
        self.endpoints = reuse(messaging.receive_endpoints(self.cands))
        self.ops = messaging.message_ops(self.cands)
        self.sends = messaging.send_endpoints(self.cands)
        self.consumers = messaging.consumer_messages(self.cands.where(F.col("source_type") == "masstransit"))
        self.amqp = messaging.amqp_facts(self.cands)
        self.infra = reuse(messaging.infra_mq_facts(self.cands))

    def graph(self):
        return messaging.integration_graph(self.infra, self.amqp, self.endpoints, self.ops,
                                           self.consumers, self.sends)


def mq(spark, d) -> Messaging:
    return Messaging(fixtures.fx_mq(spark, d))


@register("mq_candidates")
def q_mq_candidates(spark, d):
    return messaging.messaging_candidates(fixtures.fx_mq(spark, d)).select(
        "repo", F.col("relative_path").alias("file"), "language", "source_type")


@register("mq_receive_endpoints")
def q_mq_receive_endpoints(spark, d):
    e = mq(spark, d).endpoints
    return (e.select("repo", "file", "queue", F.lit("consumer").alias("role"), F.explode("consumers").alias("party"))
            .unionByName(e.select("repo", "file", "queue", F.lit("saga").alias("role"),
                                  F.explode("sagas").alias("party"))))


@register("mq_messages")
def q_mq_messages(spark, d):
    return mq(spark, d).ops


@register("mq_send_endpoints")
def q_mq_send_endpoints(spark, d):
    return mq(spark, d).sends


@register("mq_consumers")
def q_mq_consumers(spark, d):
    return mq(spark, d).consumers


@register("mq_amqp")
def q_mq_amqp(spark, d):
    return mq(spark, d).amqp


@register("mq_infra")
def q_mq_infra(spark, d):
    return mq(spark, d).infra


@register("mq_flows")
def q_mq_flows(spark, d):
    return messaging.messaging_flows(mq(spark, d).endpoints)


@register("mq_parties")
def q_mq_parties(spark, d):
    m = mq(spark, d)
    return messaging.message_parties(m.ops, m.consumers)


@register("mq_graph_nodes")
def q_mq_graph_nodes(spark, d):
    return mq(spark, d).graph()[0]


@register("mq_graph_edges")
def q_mq_graph_edges(spark, d):
    return mq(spark, d).graph()[1]


# ---------------------------------------------------------------- C: correlation
def cross_stack(spark, d):
    files = fixtures.fx_mq(spark, d).unionByName(fixtures.fx_node(spark, d))
    g = Graph(files)
    external = g.external()
    signals = correlation.messaging_signals(g.files, external)
    angular = correlation.angular_files(g.files, external)
    return signals, angular


@register("cor_signals")
def q_cor_signals(spark, d):
    return cross_stack(spark, d)[0]


@register("cor_angular")
def q_cor_angular(spark, d):
    return cross_stack(spark, d)[1]


@register("cor_summary")
def q_cor_summary(spark, d):
    return correlation.cross_stack_summary(*cross_stack(spark, d))


# ---------------------------------------------------------------- V: catalog
class Catalog:
    """Service catalog of one C# corpus: the V1 scan is done once; the
    dependency graph is only built when a view needs it (V8-V11)."""

    def __init__(self, files: DataFrame):
        self.files = deps.analyzable(files)
        self.scan = checkpoint(catalog.parse_csharp_services(self.files))
        self.controllers = catalog.controllers(self.scan)
        self.endpoints = catalog.endpoints(self.scan)
        self.consumers = catalog.consumer_map(self.files)

    @cached_property
    def graph(self) -> Graph:
        return Graph(self.files)

    @cached_property
    def steps(self) -> DataFrame:
        # bodies are searched once; own steps and messages are views of it
        return checkpoint(catalog.endpoint_steps(self.endpoints))

    @cached_property
    def flows(self) -> DataFrame:
        return catalog.endpoint_flows(self.steps, self.consumers)

    @cached_property
    def ctrl_deps(self) -> DataFrame:
        return catalog.controller_dependencies(self.scan, self.controllers, self.graph.edges)


def shop(spark, d) -> Catalog:
    return Catalog(fixtures.fx_csharp(spark, d))


@register("cat_classes")
def q_cat_classes(spark, d):
    scan = catalog.parse_csharp_services(fixtures.fx_csharp(spark, d))
    return catalog.cs_classes(scan).select("repo", "file", "class")


@register("cat_controllers")
def q_cat_controllers(spark, d):
    return catalog.controllers(catalog.parse_csharp_services(fixtures.fx_csharp(spark, d)))


@register("cat_services")
def q_cat_services(spark, d):
    return catalog.services_and_interfaces(catalog.parse_csharp_services(fixtures.fx_csharp(spark, d)))


@register("cat_endpoints")
def q_cat_endpoints(spark, d):
    e = catalog.endpoints(catalog.parse_csharp_services(fixtures.fx_csharp(spark, d)))
    return e.select("repo", "controller", "method", F.explode("verbs").alias("verb"), "route")


@register("cat_steps")
def q_cat_steps(spark, d):
    e = catalog.endpoints(catalog.parse_csharp_services(fixtures.fx_csharp(spark, d)))
    st = catalog.endpoint_steps(e)
    return (st.select("repo", "controller", "method", F.posexplode("steps").alias("step_ord", "step"))
            .withColumn("step_ord", F.col("step_ord").cast("long")))


@register("cat_consumers")
def q_cat_consumers(spark, d):
    return catalog.consumer_map(fixtures.fx_csharp(spark, d)).select("repo", "message", "consumer", "reads_db")


@register("cat_flows")
def q_cat_flows(spark, d):
    return shop(spark, d).flows


@register("cat_ctrl_deps")
def q_cat_ctrl_deps(spark, d):
    return shop(spark, d).ctrl_deps


@register("cat_api_spec")
def q_cat_api_spec(spark, d):
    c = shop(spark, d)
    return catalog.api_spec(c.endpoints, c.ctrl_deps, c.flows)


@register("cat_sequences")
def q_cat_sequences(spark, d):
    c = shop(spark, d)
    return catalog.endpoint_sequences(c.endpoints, c.ctrl_deps, c.flows)


@register("cat_app_sequence")
def q_cat_app_sequence(spark, d):
    c = shop(spark, d)
    return catalog.app_sequence(c.controllers, c.scan, c.endpoints, c.ctrl_deps, checkpoint(c.flows))


# ---------------------------------------------------------------- G: calls
@register("call_edges")
def q_call_edges(spark, d):
    return calls.call_edges(calls.cs_methods(fixtures.fx_calls(spark, d)))


@register("call_interactions")
def q_call_interactions(spark, d):
    files = fixtures.fx_calls(spark, d).where(F.col("language") == "java")
    return calls.class_interactions(files, reuse(members.scan(files)))


@register("call_class_chain")
def q_call_class_chain(spark, d):
    files = fixtures.fx_calls(spark, d).where(F.col("language") == "java")
    return calls.class_chain(members.scan(files))


# ---------------------------------------------------------------- T: text preparation
@register("txt_chunks")
def q_txt_chunks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return textprep.chunk_text(docs, "text", 1000, 100).select(
        "doc_id", "chunk_index", "chunk_total", "start", "chunk")


@register("txt_projects")
def q_txt_projects(spark, d):
    return textprep.group_by_project(fixtures.fx_docs(spark, d))


@register("txt_summary")
def q_txt_summary(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", textprep.summary_of(F.col("text")).alias("summary"))


@register("txt_metrics")
def q_txt_metrics(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("source", "repo")
    return textprep.doc_metrics(docs, ["repo"])


@register("txt_prompts")
def q_txt_prompts(spark, d):
    # the corpus is built once, and its patterns are searched once
    files = checkpoint(deps.analyzable(fixtures.fx_java(spark, d)))
    symbols = checkpoint(extract.symbol_table(files))
    return textprep.doc_prompts(files, extract.units_of(symbols), extract.import_lists(symbols),
                                extract.types_of(symbols), extract.heritage_of(symbols), members.scan(files),
                                extract.extract_comments(files))


@register("txt_context")
def q_txt_context(spark, d):
    return textprep.corpus_context(fixtures.fx_docs(spark, d))


# a small built-in document structure (configuration, not data)
ARCHITECTURE_STRUCTURE = {
    "name": "architecture",
    "sections": [
        {"id": "overview", "title": "System Overview", "subsections": [
            {"id": "purpose", "title": "Purpose", "prompt": "Describe what the code base does and for whom."},
            {"id": "components", "title": "Components", "prompt": "Describe the main components and their roles."},
        ]},
        {"id": "flows", "title": "Key Flows", "prompt": "Describe the main request and message flows."},
    ],
}


@register("txt_section_prompts")
def q_txt_section_prompts(spark, d):
    files = fixtures.fx_docs(spark, d)
    budget = textprep.context_budget(textprep.corpus_context(files))
    return (textprep.section_prompts(files.select("repo").distinct(), ARCHITECTURE_STRUCTURE)
            .join(budget.select("repo", "context_chars"), "repo", "left"))


@register("txt_section_requests")
def q_txt_section_requests(spark, d):
    """T4 / T6 on fx_docs: every section's prompt with each part of the repo's context."""
    parts = packing.context_parts(textprep.corpus_context(fixtures.fx_docs(spark, d)), checkpoint)
    return packing.section_requests(parts, ARCHITECTURE_STRUCTURE)


@register("txt_context_catalog")
def q_txt_context_catalog(spark, d):
    """The catalog sections of the context of fx_csharp and the messaging section of that of fx_mq."""
    scan = checkpoint(catalog.parse_csharp_services(deps.analyzable(fixtures.fx_csharp(spark, d))))
    endpoints = messaging.receive_endpoints(messaging.messaging_candidates(fixtures.fx_mq(spark, d)))
    return documents.context_sections(catalog.controllers(scan), catalog.endpoints(scan), catalog.services_and_interfaces(scan),
                                      messaging.messaging_flows(endpoints))


@register("txt_attach")
def q_txt_attach(spark, d):
    conv = table(spark, d, "conversations")
    prompts = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    responses = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return textprep.attach_generations(prompts, responses, ["conv_id"], "turn")


@register("txt_documents")
def q_txt_documents(spark, d):
    return textprep.assemble_documents(filters.drop_unsupported(fixtures.fx_docs(spark, d)))


@register("txt_catalog_document")
def q_txt_catalog_document(spark, d):
    c = shop(spark, d)
    flows = checkpoint(c.flows)  # read by the API table and by the steps
    return documents.catalog_document(c.controllers, catalog.services_and_interfaces(c.scan),
                                      checkpoint(catalog.api_spec(c.endpoints, c.ctrl_deps, flows)), flows)


@register("txt_file_document")
def q_txt_file_document(spark, d):
    """T8 on fx_java and fx_mq: counts and messaging of every file; texts by the stub generator, config files have none."""
    m = mq(spark, d)
    files = fixtures.fx_java(spark, d).unionByName(fixtures.fx_mq(spark, d))
    counts = reports.structure_counts(files, extract.extract_types(files), extract.extract_imports(files),
                                      extract.extract_functions(files), extract.extract_comments(files))
    prompts = files.where("language <> 'config'").select(
        "repo", F.col("relative_path").alias("file"), F.concat(F.lit("Document the file "), F.col("relative_path")).alias("prompt"))
    texts = plugins.generate(prompts, plugins.stub_generator(["repo", "file"]), ["repo", "file"])
    return documents.file_document(counts, texts, messaging.messaging_flows(m.endpoints), m.ops, m.sends, m.consumers)


@register("txt_merge")
def q_txt_merge(spark, d):
    """T2 on fx_java cut into 120-character chunks with 40 characters of
    overlap: per-chunk imports and type headers, merged per file."""
    files = deps.analyzable(fixtures.fx_java(spark, d))
    chunks = (textprep.chunk_text(files, "content", 120, 40)
              .drop("content").withColumnRenamed("chunk", "content"))
    keys = ["repo", "file", "chunk_index"]
    as_file = chunks.withColumn("relative_path", F.concat_ws("#", "relative_path", F.col("chunk_index").cast("string")))

    def split_key(df):
        parts = F.split("file", "#")
        return df.withColumn("chunk_index", F.element_at(parts, -1).cast("long")).withColumn(
            "file", F.element_at(parts, 1))
    named = split_key(extract.extract_types(as_file)).select(*keys, "kind", "ord", "name")
    plain = split_key(extract.extract_imports(as_file)).select(
        *keys, F.lit("import").alias("kind"), "ord", F.col("import").alias("value"))
    keep, dedup = textprep.merge_chunk_symbols(named, plain)
    return (keep.select(*keys, "kind", "ord", F.col("name").alias("value"))
            .unionByName(dedup.select(*keys, "kind", "ord", "value")))


# ---------------------------------------------------------------- R: reports
@register("rep_languages")
def q_rep_languages(spark, d):
    return reports.files_by_language(fixtures.fx_docs(spark, d))


@register("rep_structure")
def q_rep_structure(spark, d):
    files = fixtures.fx_java(spark, d)
    return reports.structure_counts(files, extract.extract_types(files), extract.extract_imports(files),
                                    extract.extract_functions(files), extract.extract_comments(files),
                                    extract.extract_config_keys(files), extract.custom_elements(files))


@register("rep_errors")
def q_rep_errors(spark, d):
    files = filters.drop_unsupported(fixtures.fx_docs(spark, d))
    return reports.processing_errors(members.errors(members.scan(files)))


# ---------------------------------------------------------------- X: streaming
_FIXTURE_ROOTS: dict[tuple, str] = {}


def fixture_root(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A fixture written once per session as real files under the shared
    checkpoint folder (``<root>/<repo>/<relative_path>``)."""
    if name == "docs":
        return docs_corpus_root(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _FIXTURE_ROOTS:
        base = ensure_checkpoint_dir(spark).rstrip("/")
        root = f"{base}/corpus-{name}-{uuid.uuid4().hex}-d"
        files = {"mq": fixtures.fx_mq}[name](spark, sf_dir)
        # narrow tables make many files: the few partitions of their scan would write them one after another
        tree.write_corpus(files.repartition(4 * spark.sparkContext.defaultParallelism), root)
        _FIXTURE_ROOTS[key] = root
    return _FIXTURE_ROOTS[key]


@register("str_files")
def q_str_files(spark, d):
    root = fixture_root(spark, d, "docs")
    s = streaming.stream_files(spark, root, repo="corpus")
    out = streaming.run_available_now(
        s.select("repo", "relative_path", "language", "size_bytes", F.md5("content").alias("content_md5")),
        "files", settings=streaming.FILE_SETTINGS)
    return spark.read.parquet(out)


@register("str_symbols")
def q_str_symbols(spark, d):
    root = fixture_root(spark, d, "mq") + "/mq"
    s = streaming.stream_files(spark, root, repo="mq")
    sym = streaming.stream_symbols(s, lambda f: messaging.consumer_messages(
        messaging.messaging_candidates(f).where(F.col("source_type") == "masstransit")))
    return spark.read.parquet(streaming.run_available_now(sym, "symbols", settings=streaming.FILE_SETTINGS))


@register("str_totals")
def q_str_totals(spark, d):
    root = fixture_root(spark, d, "docs")
    totals = streaming.running_totals(streaming.stream_files(spark, root, repo="corpus"))
    out = streaming.run_available_now(totals, "totals", "complete", streaming.write_complete, settings=streaming.FILE_SETTINGS)
    return spark.read.parquet(out)


@register("str_latest")
def q_str_latest(spark, d):
    # a table is one file or a folder of them, each a micro-batch; a stream takes a single file only by a pattern
    stream = (spark.readStream.schema(table(spark, d, "events").schema).option("maxFilesPerTrigger", 1)
              .parquet(f"{d.rstrip('/')}/event[s].parquet"))
    latest = streaming.latest_version(stream, "user_id", "event_id", "ts", ["event_type"])
    out = streaming.run_available_now(latest, "latest", "update", streaming.write_epoch, settings=streaming.LATEST_SETTINGS)
    return streaming.latest_view(spark, out, "user_id", "event_id", "ts", ["event_type"])


MQ_TABLES = {
    "files": lambda b: b.select("language"),
    "infra": messaging.infra_mq_facts,
    "amqp": messaging.amqp_facts,
    "endpoints": messaging.receive_endpoints,
    "ops": messaging.message_ops,
    "sends": messaging.send_endpoints,
    "consumers": lambda b: messaging.consumer_messages(b.where(F.col("source_type") == "masstransit")),
}


def streamed_mq(spark, d) -> dict[str, DataFrame]:
    s = messaging.messaging_candidates(streaming.stream_files(spark, fixture_root(spark, d, "mq") + "/mq", repo="mq"))
    out = streaming.run_available_now(s, "finalize", "append", streaming.write_tables(MQ_TABLES), settings=streaming.FILE_SETTINGS)
    return streaming.read_tables(spark, out, MQ_TABLES)


@register("str_finalize")
def q_str_finalize(spark, d):
    t = streamed_mq(spark, d)
    return messaging.integration_graph(t["infra"], t["amqp"], t["endpoints"], t["ops"], t["consumers"], t["sends"])[1]


@register("str_summary")
def q_str_summary(spark, d):
    return streaming.summary(streamed_mq(spark, d)["files"])


# ---------------------------------------------------------------- U: extension points
@register("udf_language")
def q_udf_language(spark, d):
    exts, rules = plugins.extended_tables("prose", [".txt"], {"namespace": r"^(\S+)"})
    files = plugins.with_language(fixtures.fx_docs(spark, d), exts).where(F.col("language") == "prose")
    return extract.extract_units(files, rules)


@register("udf_generate")
def q_udf_generate(spark, d):
    files = fixtures.fx_docs(spark, d)
    prompts = files.select("repo", F.col("relative_path").alias("file"),
                           F.concat(F.lit("Document the file "), F.col("relative_path"), F.lit(":\n"),
                                    F.col("content")).alias("prompt"))
    return plugins.generate(prompts, plugins.stub_generator(["repo", "file"]), ["repo", "file"])


@register("udf_source")
def q_udf_source(spark, d):
    docs = table(spark, d, "documents")
    mine = files_from(docs, F.col("source"), F.concat(F.lit("notes/"), F.col("doc_id").cast("string"),
                                                      F.lit(".md")), F.col("text"))
    src = plugins.user_source(mine)
    return src.groupBy("repo", "language").agg(F.count("*").alias("files"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most coupled source files (top 10 per repo)."""
    return deps.highly_coupled_files(java_graph(spark, sf_dir).nodes(), k=10)


__all__ = ["REGISTRY", "flagship", "F"]
