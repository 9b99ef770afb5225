"""Path and size filters (S4-S6, S8, S9) as Catalyst predicates.

Glob patterns are translated once on the driver (they are configuration,
not data) into anchored Java regexes; each pattern list becomes a single
OR-tree inside one Filter, evaluated in whole-stage codegen.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import DEFAULT_EXCLUDES, DEFAULT_MAX_FILE_MB, EXTENSIONS
from .tables import language_of, suffix_of


def glob_regex(pattern: str) -> str:
    """fnmatch glob -> Java regex matching the whole string (``*`` crosses
    ``/``, as with fnmatch)."""
    rx = fnmatch.translate(pattern.replace("\\", "/"))
    if rx.endswith(r"\Z"):
        rx = rx[:-2] + r"\z"
    return r"\A" + rx


def glob_substring(pattern: str) -> str:
    """The legacy fallback: the pattern without ``**/`` and ``**`` is looked
    up as a plain substring (``**/bin/**`` -> ``bin/``, so ``cabin/x`` hits)."""
    return pattern.replace("\\", "/").replace("**/", "").replace("**", "")


def glob_match(path: Column, patterns: Sequence[str]) -> Column:
    """True when any pattern matches (glob on the normalised path, or the
    substring fallback on the path as given)."""
    normalized = F.replace(path, F.lit("\\"), F.lit("/"))
    cond = F.lit(False)
    for p in patterns:
        cond = cond | normalized.rlike(glob_regex(p)) | path.contains(glob_substring(p))
    return cond


def not_included(path: Column, include: Sequence[str] | None = None) -> Column:
    """No include list = everything included."""
    return ~glob_match(path, include) if include else F.lit(False)


def excluded_by(path: Column, exclude: Sequence[str] | None = None) -> Column:
    """None = the default list, an empty list excludes nothing."""
    return glob_match(path, DEFAULT_EXCLUDES if exclude is None else exclude)


def known_extension(path: Column, extensions: dict[str, list[str]] | None = None) -> Column:
    """The lower-cased suffix is one of the configured ones."""
    return suffix_of(path).isin(*[e for v in (extensions or EXTENSIONS).values() for e in v])


def filter_paths(df: DataFrame, include: Sequence[str] | None = None,
                 exclude: Sequence[str] | None = None, path_col: str = "path") -> DataFrame:
    """No include list = everything included; exclude wins."""
    return df.where(~not_included(F.col(path_col), include) & ~excluded_by(F.col(path_col), exclude))


def filter_size(df: DataFrame, max_mb: float = DEFAULT_MAX_FILE_MB, size_col: str = "size_bytes") -> DataFrame:
    """Keep files of at most ``max_mb`` MiB."""
    return df.where(F.col(size_col) <= F.lit(int(max_mb * 1024 * 1024)))


def filter_extensions(df: DataFrame, extensions: dict[str, list[str]] | None = None,
                      path_col: str = "path") -> DataFrame:
    """Suffix test of the folder reader: lower-cased suffix in the union of
    configured extensions."""
    return df.where(known_extension(F.col(path_col), extensions))


def detect_language(df: DataFrame, path_col: str = "relative_path") -> DataFrame:
    """(re)compute ``ext`` and ``language`` from the path."""
    ext = suffix_of(F.col(path_col))
    return df.withColumn("ext", ext).withColumn("language", language_of(F.col("ext")))


def drop_unsupported(df: DataFrame) -> DataFrame:
    """Rows every analysis ignores (language ``unknown``)."""
    return df.where(F.col("language").isin(*EXTENSIONS.keys()))


# ------------------------------------------------------------------ S8
def apply_domain_profiles(files: DataFrame, profiles: Sequence[dict], global_exclude: Sequence[str] | None = None,
                          overlays: bool = False) -> DataFrame:
    """(domain, file row) for every profile a file belongs to, in one scan: each profile is one predicate, a file carries the array of
    the profiles that take it and is exploded over it; files that no profile takes go before that.

    A profile's include / exclude lists replace the global ones when given. ``extensions`` (language -> suffixes) limits the files to its
    suffixes. With ``overlays`` the language is taken from a profile's extensions, and its ``chunk_size_chars`` / ``chunk_overlap_chars``
    are columns (null = the global setting)."""
    global_exclude = DEFAULT_EXCLUDES if global_exclude is None else global_exclude
    path, suffix = F.col("path"), suffix_of(F.col("path"))
    taken = []
    for p in profiles:
        exclude = p.get("exclude_patterns")
        fits = ~not_included(path, p.get("include_patterns")) & ~excluded_by(path, global_exclude if exclude is None else exclude)
        own = p.get("extensions") or {}
        language = F.lit(None).cast("string")
        if own:
            fits = fits & known_extension(path, own)
            language = F.coalesce(*[F.when(suffix.isin(*v), F.lit(k)) for k, v in own.items()])
        taken.append(F.when(fits, F.struct(F.lit(p["name"]).alias("domain"), language.alias("language"),
                                           F.lit(p.get("chunk_size_chars")).cast("long").alias("chunk_size_chars"),
                                           F.lit(p.get("chunk_overlap_chars")).cast("long").alias("chunk_overlap_chars"))))
    # the generator drops files with an empty array
    out = files.select("*", F.explode(F.array_compact(F.array(*taken))).alias("_profile"))
    if not overlays:
        return out.select("_profile.domain", *files.columns)
    cols = [F.coalesce("_profile.language", "language").alias("language") if c == "language" else F.col(c) for c in files.columns]
    return out.select("_profile.domain", *cols, "_profile.chunk_size_chars", "_profile.chunk_overlap_chars")
