"""codegrid: source-code corpora as Spark tables.

Files of many repositories are rows of one DataFrame; symbols, dependency
graphs, messaging topologies, endpoint catalogs, call graphs and prompt-ready
text are derived from it with DataFrame / SQL operations.
"""

__version__ = "0.1.0"
