"""Source divergence audit: how far each source's word distribution is from the other sources of its language, in exact integers.

A language keeps the terms that stand in at least ``min_docs`` of its documents (V of them). For a group (language, source), and for a
language as a whole, a kept term with count c of N weighs p = 1 + floor(1e9 (c + 1) / (N + V)); the divergence of p from q is
floor((p - q)^2 / q), summed over all kept terms.

The sums run over a three-dimensional cube. Groups of a language are dealt into blocks of about ``GROUPS``, kept terms into blocks of
about ``TERMS``; the task of cell (group block, group block, term block) gets the two groups' slices of the term block (each slice is replicated
once per opposite group block), fills them up with the weight of absent terms and computes the partial divergences of all its pairs,
both ways; partial sums are then added along the term axis. A cell holds 2 * GROUPS * TERMS weights whatever the data. Terms that neither
block has are not sent: every pair starts from V times the divergence of two absent terms (the cell of term block -1), and each cell
adds its terms' difference to that.

Counting is one pass over whole texts, with counts per task that are flushed at ``FLUSH`` entries and merged by an aggregation, so a hot
source or word is a row per task. Null text, lang and source count as empty strings. Repeated rows are documents of their own. Groups without terms
have only absent ones; with V = 0 all divergences are 0. Ties are ranked by item in UTF-8 order. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from codegrid.llm.common import staged

GROUPS, TERMS = 32, 4096
FLUSH = 200_000  # entries that a counting task holds
SLICE = 1 << 20  # bytes of a text that are cut into words at a time
# fixed values: terms are runs of letters A-Z, a-z and of bytes from 0x80 on; A-Z are lower-cased, the rest parts terms
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _words(text: bytes):
    text = text.translate(_FOLD)
    a = 0
    while a < len(text):
        b = text.find(b" ", a + SLICE)
        b = len(text) if b < 0 else b
        yield text[a:b].split()
        a = b


def _counts(batches):
    """Rows (lang, source, term, n, docs) of a task; a null term counts the group's documents."""
    held: dict[tuple, tuple[Counter, Counter]] = {}
    kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]

    def flushed():
        for (lang, source), (n, docs) in held.items():
            size = len(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * size, kinds[0]), pa.array([source] * size, kinds[1]), pa.array(list(n), kinds[2]),
                                              pa.array(list(n.values()), kinds[3]), pa.array([docs[t] for t in n], kinds[4])], ["lang", "source", "term", "n", "docs"])
        held.clear()
    entries = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text"))):
            n, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            before, seen = len(n), {None}
            for words in _words(text.as_py()):
                n.update(words)
                seen.update(words)
            n[None] += 1
            docs.update(seen)
            entries += len(n) - before
            if entries > FLUSH:
                yield from flushed()
                entries = 0
    yield from flushed()


def _cell(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Partial divergences of one cell, for all ordered pairs of different groups. Rows with term -1 tell of the groups: the weight of
    an absent term, and the number of the language's terms for the cell that starts the sums."""
    _, a, b, t = key
    heads, body = rows[rows["tid"] < 0], rows[rows["tid"] >= 0]
    terms, column = np.unique(body["tid"].to_numpy(), return_inverse=True)
    side, sources, absent = [], [], []
    for s in (0, 1) if a < b else (0,):
        head = heads[heads["side"] == s]
        zero = head["p"].to_numpy(np.int64)
        weights = np.repeat(zero[:, None], len(terms), axis=1)
        place = pd.Index(head["source"])
        mine = (body["side"] == s).to_numpy()
        weights[place.get_indexer(body["source"][mine]), column[mine]] = body["p"].to_numpy(np.int64)[mine]
        side.append(weights), sources.append(place.to_numpy()), absent.append(zero)
    lang_terms = int(heads["terms"].iloc[0]) if len(heads) else 0
    out = []
    for s, o in ((0, 1), (1, 0)) if a < b else ((0, 0),):
        for i, source in enumerate(sources[s]):
            other = sources[o] != source
            base = (absent[s][i] - absent[o][other]) ** 2 // absent[o][other]
            if t < 0:
                value = lang_terms * base
            else:
                q = side[o][other]
                value = ((side[s][i] - q) ** 2 // q).sum(axis=1) - len(terms) * base
            out.append(pd.DataFrame({"lang": key[0], "source": source, "item": sources[o][other], "value": value}))
    return pd.concat(out) if out else pd.DataFrame({"lang": [], "source": [], "item": [], "value": []})


def _weight(count, n, v):
    """1 + floor(1e9 (count + 1) / (n + v)) in decimals; 1 where there is nothing to divide by."""
    top = F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    whole = F.call_function("div", top, F.greatest((n + v).cast("decimal(20,0)"), F.lit(1).cast("decimal(20,0)")))
    return F.lit(1).cast("long") + whole


def audit(docs: DataFrame, *, min_docs: int = 3, top_terms: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (lang, source, text). Part ``pair``: the divergence of each group from each other
    source of its language, all ranks; part ``term``: the group's terms that weigh more than in the language, to rank ``top_terms``."""
    src = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c) for c in ("lang", "source", "text")])
    told = src.mapInArrow(_counts, "lang binary, source binary, term binary, n long, docs long")
    told = staged(told.groupBy(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")]).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "div-counts")
    counts = told.where("term IS NOT NULL")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = staged(kept.select("lang", "term", "lang_n").withColumn("tid", F.monotonically_increasing_id()), "div-kept")
    found = staged(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "div-found")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    blocks = told.where("term IS NULL").groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / GROUPS).alias("blocks"))
    groups = (told.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").join(blocks, "lang")
              .na.fill(0, ["total", "v", "lang_total"]))
    # one row per group: its block, the weight of its absent terms, and what its language's weights need
    groups = staged(groups.select("lang", "source", "total", "v", "lang_total", "blocks", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block"),
                                  F.greatest(F.ceil(F.col("v") / TERMS), F.lit(1)).cast("int").alias("slices"), _weight(F.lit(0), F.col("total"), F.col("v")).alias("zero")), "div-groups")
    weighed = staged(found.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "tid", "block", "blocks", F.pmod(F.xxhash64("tid"), F.col("slices")).cast("int").alias("t"),
        _weight(F.col("n"), F.col("total"), F.col("v")).alias("p"), _weight(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q")), "div-weights")

    def dealt(df: DataFrame) -> DataFrame:
        """Each row once for every cell that needs it: its block against all blocks of the language, the smaller one first."""
        other = F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("other")
        return df.select("*", other).select("lang", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "t",
                                            F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "source", "tid", "p", "terms")

    heads = groups.select("lang", "source", "block", "blocks", F.explode(F.sequence(F.lit(-1), F.col("slices") - 1)).alias("t"),
                          F.lit(-1).cast("long").alias("tid"), F.col("zero").alias("p"), F.col("v").alias("terms"))
    body = weighed.select("lang", "source", "block", "blocks", "t", "tid", "p", F.lit(0).cast("long").alias("terms"))
    cells = dealt(heads).unionByName(dealt(body)).groupBy("lang", "a", "b", "t").applyInPandas(_cell, "lang string, source string, item string, value long")
    pairs = cells.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    gap = F.col("p") - F.col("q")
    terms = weighed.where("p > q").select("lang", "source", F.col("term").alias("item"), F.call_function("div", gap * gap, F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("rank", place).withColumn("part", F.lit("pair")).select(columns).unionByName(
        terms.withColumn("rank", place).where(F.col("rank") <= top_terms).withColumn("part", F.lit("term")).select(columns))
