"""User extension points.

U1 adds a language as data: extra suffixes and a rule entry; the same
extraction jobs read the extended tables. U2 is a user generation
function run with ``mapInPandas`` over prompt rows. U3 is any DataFrame
with the ``files`` columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import require_files
from ..sources.tables import language_of, suffix_of
from .rules import EXTENSIONS, LANG_RULES


def extended_tables(name: str, extensions: list[str], rule: dict):
    """(extension map, rule table) with one more language, without
    touching the module-level defaults."""
    exts = dict(EXTENSIONS)
    exts[name] = list(extensions)
    rules = dict(LANG_RULES)
    base = {"namespace": None, "imports": [], "types": [], "modifiers": [], "comments": "c"}
    base.update(rule)
    rules[name] = base
    return exts, rules


def with_language(files: DataFrame, extensions: dict[str, list[str]]) -> DataFrame:
    """Re-detect ``language`` with an extended extension map."""
    return files.withColumn("language", language_of(suffix_of(F.col("relative_path")), extensions))


GenerateFn = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def generate(prompts: DataFrame, fn: GenerateFn, key_cols: list[str], prompt_col: str = "prompt") -> DataFrame:
    """Run the user's generation function over (keys..., prompt) rows in
    Arrow batches; it must yield (keys..., response)."""
    schema = ", ".join(f"{c} string" for c in key_cols) + ", response string"
    return prompts.select(*[F.col(c).cast("string") for c in key_cols], F.col(prompt_col).alias("prompt")) \
        .mapInPandas(fn, schema)


def stub_generator(key_cols: list[str]) -> GenerateFn:
    """Deterministic stand-in for a model: the md5 of the prompt."""
    def fn(batches):
        for b in batches:
            out = b[key_cols].copy()
            out["response"] = [hashlib.md5((p or "").encode("utf-8")).hexdigest() for p in b["prompt"]]
            yield out
    return fn


def user_source(df: DataFrame) -> DataFrame:
    """Accept any DataFrame with the ``files`` columns."""
    return require_files(df)
