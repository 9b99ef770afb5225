"""Body-scoped symbols (P5, P7, P8 for PHP, P12, P13) and extraction
errors (R3), from one ``mapInPandas`` pass over the files whose language
has a body scanner. Each file is scanned once; the pass emits one long
table that the registered views filter and explode.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.body import LANGUAGES, scan_members

MEMBER_COLUMNS = ["repo", "file", "language", "type_kind", "type", "type_ord", "member_kind", "ord",
                  "name", "signature", "data_type", "modifiers", "error"]
MEMBER_SCHEMA = ("repo string, file string, language string, type_kind string, type string, "
                 "type_ord long, member_kind string, ord long, name string, signature string, "
                 "data_type string, modifiers array<string>, error string")


def _scan_batches(batches):
    for b in batches:
        rows = []
        for repo, file, lang, content in zip(b["repo"], b["file"], b["language"], b["content"]):
            try:
                for r in scan_members(lang, content or ""):
                    rows.append((repo, file, lang) + tuple(r) + (None,))
            except Exception as e:  # noqa: BLE001 - one bad file must not fail the job
                rows.append((repo, file, lang, None, None, None, "error", None, None, None, None, [],
                             f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=MEMBER_COLUMNS)


def scan(files: DataFrame) -> DataFrame:
    """The long member table of every scannable file."""
    src = (files.where(F.col("language").isin(*LANGUAGES))
           .select("repo", F.col("relative_path").alias("file"), "language", "content"))
    return src.mapInPandas(_scan_batches, MEMBER_SCHEMA)


def members(scanned: DataFrame) -> DataFrame:
    """P5: methods, properties, fields, and the functions and subs of modules, inside each type's body."""
    return (scanned.where(F.col("member_kind").isin("method", "property", "field", "sub") | (F.col("member_kind") == "function") & (F.col("type_kind") == "module"))
            .select("repo", "file", "language", "type_kind", "type", "member_kind", "ord", "name",
                    "signature", "data_type"))


def member_modifiers(scanned: DataFrame) -> DataFrame:
    """(owner kind, owner, modifier) for types and members."""
    return (scanned.where(F.col("member_kind").isin("type", "method", "property", "field", "function", "sub"))
            .select("repo", "file", "type", "member_kind", "name",
                    F.explode("modifiers").alias("modifier")))


def constants(scanned: DataFrame) -> DataFrame:
    """Enum constants, PHP define / const."""
    return (scanned.where(F.col("member_kind").isin("enum_constant", "define", "const", "union_case"))
            .select("repo", "file", "type", F.col("member_kind").alias("kind"), "ord", "name"))


def decorators(scanned: DataFrame) -> DataFrame:
    """Decorators of TypeScript classes (taken from the header match)."""
    return (scanned.where(F.col("member_kind") == "decorator")
            .select("repo", "file", "type", F.col("name").alias("decorator")))


def php_functions(scanned: DataFrame) -> DataFrame:
    """P8 for PHP and F#: functions of a file (not methods)."""
    return (scanned.where((F.col("member_kind") == "function") & (F.col("type_kind") == "file"))
            .select("repo", "file", "language", "ord", "name"))


def errors(scanned: DataFrame) -> DataFrame:
    """Files whose extraction failed, with the error text."""
    return (scanned.where(F.col("error").isNotNull())
            .select("repo", "file", F.lit("extract").alias("stage"), "error"))
