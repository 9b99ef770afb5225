"""SentencePiece encoding and decoding as weighted finite-state transduction.

Three machines are compiled once from the model file and composed with each input:

* the normaliser N: optional space in front, optional removal of extra spaces, spaces to U+2581, else the identity;
* the lexicon L: an arc for every piece that matches at a place; a character without any piece of its own takes the
  byte-fallback arc to its UTF-8 byte pieces (or the unknown piece, where the model has no bytes);
* the grammar G over neighbouring pieces. For a unigram model it accepts every pair and the arc weights are the negated
  scores. For a BPE model the merges decide, not the sum of scores: there G gives a pair weight 0 if merging the pair's
  text yields just these two pieces and infinity otherwise. A sequence whose neighbours all agree is the BPE result, and
  the only one (merges inside a piece happen in the same order whatever stands around it), so the shortest path in the
  tropical semiring is exactly what the merge loop gives. ``tests/llm`` holds both against the sentencepiece library.

N after L after G is run as one forward pass of (min, +) over positions. No piece holds a space after another character
(checked when the model is compiled), so no arc crosses the front of a run of spaces; the machine factors there, each factor
is composed on its own, and caches of ``CACHE`` and ``PAIRS`` bytes a worker keep the paths of frequent factors and the weights of frequent pairs. Texts are encoded whole.

Nulls give null ids; the empty text gives an empty list, as the library does. Models with a compiled character map, with user-defined or unused pieces
or with spaces behind the words are refused. Other columns stay; one named like a result column gives way to it.
"""

from __future__ import annotations

import os
import re
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from codegrid.llm.common import lean

SPACE = "▁"
INF = float("inf")
#: bytes, about, that the paths of factors take in a Python worker, and bytes of the table of pair weights
CACHE, PAIRS = 48 << 20, 8 << 20


class Recent(dict):
    """A bounded cache: what has been asked for since the last but one time it was half full."""

    def __init__(self, compute, limit: int) -> None:
        self.compute, self.limit, self.size, self.old = compute, limit, 0, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        cost = 160 + 2 * len(key) + len(value)  # two objects and a slot
        if cost < 1000:
            if self.size + cost > self.limit // 2:
                self.old, self.size = dict(self), 0
                self.clear()
            self[key] = value
            self.size += cost
        return value


def _fields(b: bytes):
    """(field number, value) of a protocol-buffers message."""
    i = 0

    def varint():
        nonlocal i
        n = shift = 0
        while True:
            c = b[i]
            i += 1
            n |= (c & 127) << shift
            shift += 7
            if c < 128:
                return n
    while i < len(b):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, b[i:i + n]
            i += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, struct.unpack("<f" if n == 4 else "<d", b[i:i + n])[0]
            i += n


class Model:
    # fixed values of the model format: piece types, model types
    NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
    UNIGRAM, BPE = 1, 2

    def __init__(self, raw: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        trainer, norm = {}, {}
        for no, v in _fields(raw):
            if no == 1:
                f = dict(_fields(v))
                self.pieces.append((f.get(1, b"").decode(), f.get(2, 0.0), f.get(3, self.NORMAL)))
            elif no == 2:
                trainer = dict(_fields(v))
            elif no == 3:
                norm = dict(_fields(v))
        self.kind = trainer.get(3, self.UNIGRAM)
        if self.kind not in (self.UNIGRAM, self.BPE):
            raise ValueError("only unigram and BPE models are supported")
        if norm.get(2):
            raise ValueError("models with a compiled character map are not supported")
        if trainer.get(24, 0) or any(t in (self.USER_DEFINED, self.UNUSED) for _, _, t in self.pieces):
            raise ValueError("models with trailing spaces, user-defined or unused pieces are not supported")
        self.dummy_prefix, self.squeeze, self.escape = norm.get(3, 1), norm.get(4, 1), norm.get(5, 1)
        self.ids = {p: i for i, (p, _, t) in enumerate(self.pieces) if t == self.NORMAL}
        self.score = [s for _, s, _ in self.pieces]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == self.BYTE}
        self.plain = {i: p for p, i in self.ids.items()} | {i: chr(b) for b, i in self.bytes.items() if b < 128}
        self.unknown = next((i for i, (_, _, t) in enumerate(self.pieces) if t == self.UNKNOWN), 0)
        self.longest = max(map(len, self.ids), default=1)
        # the lowest unigram score less ten, as unknown characters weigh in unigram models
        self.unknown_cost = 10 - min((self.score[i] for i in self.ids.values()), default=0.0)
        self.factors = (re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+") if not any(SPACE in p.lstrip(SPACE) for p in self.ids)
                        else re.compile(r"(?s).+"))
        self.cost = {p: -self.score[i] for p, i in self.ids.items()}
        self.tree = self._tree() if self.kind == self.BPE else {}
        # pair weights, each at the one place its ids give: (pair, 0 or 1 for infinity) in 64 bits
        self.pairs = array("q", bytes(PAIRS))
        # the longest piece that starts with four characters; others have three at most
        self.reach: dict[str, int] = {}
        for piece in self.ids:
            if len(piece) > 3:
                self.reach[piece[:4]] = max(len(piece), self.reach.get(piece[:4], 4))
        self.paths = Recent(lambda factor: array("i", self.path(factor)).tobytes(), CACHE // 8)
        # the paths of words with one space in front, by the word
        self.words = Recent(lambda word: array("i", self.path(SPACE + word)).tobytes(), CACHE // 8 * 7)
        self.texts = np.array([self.plain.get(i) for i in range(len(self.pieces))], object)
        self.by_words = bool(self.dummy_prefix and self.escape) and self.factors.pattern[0] != "("

    # ---- N
    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if self.dummy_prefix and text:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    # ---- G
    def merged(self, text: str) -> list[str]:
        """The merge loop: the neighbours whose union scores best are joined, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = -INF, -1
            for i in range(len(parts) - 1):
                j = self.ids.get(parts[i] + parts[i + 1])
                if j is not None and self.score[j] > best:
                    best, at = self.score[j], i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _tree(self) -> dict[str, tuple]:
        """For each piece: its place in the order of merging, and the two pieces that are joined last to make it.
        Characters are there from the start. Pieces whose parts are not made before them are left out."""
        cost = {p: -self.score[i] for p, i in self.ids.items()}
        tree: dict[str, tuple] = {p: (-INF, p, p) for p in cost if len(p) == 1}
        for p in sorted((p for p in cost if len(p) > 1), key=cost.get):
            parts = list(p)
            while len(parts) > 2:
                c, at = min(((cost.get(parts[i] + parts[i + 1], INF), i) for i in range(len(parts) - 1)))
                if c == INF:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2 and all(q in tree and tree[q][0] < cost[p] for q in parts):
                tree[p] = (cost[p], parts[0], parts[1])
        return tree

    def pair_weight(self, left: str, right: str) -> float:
        """0 if merging the text of two pieces gives back just these two, else infinity. Going back in time, the later
        made of the two is taken apart; nowhere on the way may the neighbours at the border have been due to join."""
        tree, cost = self.tree, self.cost
        x, y = tree.get(left), tree.get(right)
        if x is None or y is None:
            if len(left) == 1 and left not in self.ids or len(right) == 1 and right not in self.ids:
                return 0.0  # a character that is no piece joins nothing
            return 0.0 if self.merged(left + right) == [left, right] else INF
        x_next = y_next = INF
        while True:
            c = cost.get(left + right)
            if c is not None and c < x_next and c <= y_next:
                return INF
            if x[0] > y[0]:
                x_next, left = x[0], x[2]
                x = tree[left]
            elif y[0] > -INF:
                y_next, right = y[0], y[1]
                y = tree[right]
            else:
                return 0.0

    # ---- the composition, and its shortest path
    def path(self, factor: str) -> list[int]:
        return self._merge_path(factor) if self.kind == self.BPE else self._best_path(factor)

    def _arc(self, c: str) -> list[int]:
        """The ids of a character that is no piece."""
        return [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def _merge_path(self, factor: str) -> list[int]:
        """All finite paths have weight 0 and there is just one, so the first to arrive is the shortest. Arcs are tried
        longest first; a place from which no path goes on is not entered again (it has one last piece only)."""
        n, get, reach, pairs = len(factor), self.ids.get, self.reach.get, self.pairs
        size, places, dead, done = len(self.pieces), len(self.pairs) - 1, set(), []
        i, last, e = 0, -1, min(n, reach(factor[:4], 3))
        while i < n:
            while e > i:
                j = get(factor[i:e], -1)
                if (j >= 0 or e == i + 1) and e not in dead:
                    if last < 0 or j < 0:  # the start, or a character that is no piece and joins nothing
                        break
                    pair = last * size + j
                    held = pairs[(last * 40503 + j) & places]
                    if held >> 1 != pair + 1:
                        held = 2 * (pair + 1) + (self.pair_weight(self.pieces[last][0], self.pieces[j][0]) != 0)
                        pairs[(last * 40503 + j) & places] = held
                    if not held & 1:
                        break
                e -= 1
            if e > i:
                done.append((i, last))
                i, last = e, j
                e = min(n, i + reach(factor[i:i + 4], 3))
            else:
                dead.add(i)
                e = i - 1
                i, last = done.pop()
        done.append((n, last))
        out = []
        for (at, _), (end, j) in zip(done, done[1:]):
            out.extend(self._arc(factor[at:end]) if j < 0 else (j,))
        return out

    def _best_path(self, factor: str) -> list[int]:
        n, ids, score = len(factor), self.ids, self.score
        cost, arc, back = [0.0] + [INF] * n, [None] * (n + 1), [0] * (n + 1)
        for i in range(n):
            for e in range(i + 1, min(n, i + self.longest) + 1):
                j = ids.get(factor[i:e])
                if j is not None and cost[i] - score[j] < cost[e]:
                    cost[e], arc[e], back[e] = cost[i] - score[j], [j], i
            if factor[i] not in ids and cost[i] + self.unknown_cost < cost[i + 1]:
                cost[i + 1], arc[i + 1], back[i + 1] = cost[i] + self.unknown_cost, self._arc(factor[i]), i
        out, e = [], n
        while e:
            out[:0] = arc[e]
            e = back[e]
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), np.int32)

    def packed(self, text: str) -> bytes:
        """The ids of a text, as bytes of 32-bit integers."""
        if self.by_words and text and SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return b"".join(map(self.words.__getitem__, text.split(" ")))
        return b"".join(map(self.paths.__getitem__, self.factors.findall(self.normalise(text))))

    def decode(self, ids) -> str:
        """The inverse transduction: pieces end to end, bytes joined to characters, spaces back, the front space gone."""
        ids = np.asarray(ids, np.int64)
        try:
            # no bytes but those that are characters by themselves
            return self._restored("".join(self.texts[ids]))
        except TypeError:
            pass
        out, raw = [], bytearray()
        for i in ids.tolist():
            p, _, t = self.pieces[i]
            if t == self.BYTE:
                raw.append(int(p[3:5], 16))
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if t == self.NORMAL:
                out.append(p)
            elif t == self.UNKNOWN:
                out.append(" ⁇ ")
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return self._restored("".join(out))

    def _restored(self, text: str) -> str:
        text = text.replace(SPACE, " ")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


_MODELS: dict[str, Model] = {}


def _model(name: str) -> Model:
    if name not in _MODELS:
        with open(SparkFiles.get(name), "rb") as f:
            _MODELS[name] = Model(f.read())
    return _MODELS[name]


def shipped(spark, model_path: str) -> str:
    """Send the model file (some 100 KB to a few MB, whatever the data) to every executor; returns its name there."""
    spark.sparkContext.addFile(model_path)
    return os.path.basename(model_path)


_SLICE = 256  # texts whose ids are held at a time


def _rows(df: DataFrame, source: str, results: list[str]) -> tuple[DataFrame, str]:
    """(row, source) with all other columns in ``row``, and the type of ``row``; names of result columns are left out."""
    others = [c for c in df.columns if c != source and c not in results]
    rows = df.select(F.struct(*others).alias("row") if others else F.struct(F.lit(None).cast("int").alias("_none")).alias("row"), F.col(source))
    return rows, rows.schema["row"].dataType.simpleString()


def _kept(df: DataFrame, *results: str) -> DataFrame:
    return df.select("row.*", *results).drop("_none") if "_none" in df.schema["row"].dataType.names else df.select("row.*", *results)


def _ids(found: list) -> pa.ListArray:
    ends = np.cumsum([0, *(0 if i is None else len(i) // 4 for i in found)])
    values = pa.array(np.frombuffer(b"".join(i for i in found if i is not None), np.int32))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([i is None for i in found]))


def _encode(name: str, check: bool):
    @lean
    def run(batches):
        m = _model(name)
        for whole in batches:
            for a in range(0, whole.num_rows, _SLICE):
                b = whole.slice(a, _SLICE)
                texts = b.column("text").to_pylist()
                ids = [None if t is None else m.packed(t) for t in texts]
                out = [b.column("row"), _ids(ids)]
                if check:
                    same = [None if t is None else m.decode(np.frombuffer(i, np.int32)) == t.replace(SPACE, " ") for t, i in zip(texts, ids)]
                    out += [pa.array([0 if i is None else len(i) // 4 for i in ids], pa.int64()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(out, ["row", "ids", "n_ids", "restored"][:len(out)])
    return run


def encode(docs: DataFrame, model_path: str, *, ids: str = "ids") -> DataFrame:
    """``docs`` without ``text``, with the piece ids of the text as ``ids``."""
    rows, kind = _rows(docs.withColumn("text", F.col("text").cast("string")), "text", [ids])
    name = shipped(docs.sparkSession, model_path)
    return _kept(rows.mapInArrow(_encode(name, False), f"row {kind}, ids array<int>").withColumnRenamed("ids", ids), ids)


def _decode(name: str):
    @lean
    def run(batches):
        m = _model(name)
        for whole in batches:
            for a in range(0, whole.num_rows, _SLICE):
                b = whole.slice(a, _SLICE)
                texts = [None if i is None else m.decode(i) for i in b.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string())], ["row", "text"])
    return run


def decode(encoded: DataFrame, model_path: str, *, ids: str = "ids") -> DataFrame:
    """``encoded`` without its ids, with the decoded text as ``text``."""
    rows, kind = _rows(encoded, ids, ["text"])
    name = shipped(encoded.sparkSession, model_path)
    return _kept(rows.withColumnRenamed(ids, "ids").mapInArrow(_decode(name), f"row {kind}, text string"), "text")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """Both directions in one pass: ``docs`` without ``text``, with ids, n_ids and whether the decoded text is the text
    (U+2581, which stands for a space, decodes to one)."""
    rows, kind = _rows(docs.withColumn("text", F.col("text").cast("string")), "text", ["ids", "n_ids", "restored"])
    name = shipped(docs.sparkSession, model_path)
    return _kept(rows.mapInArrow(_encode(name, True), f"row {kind}, ids array<int>, n_ids long, restored boolean"), "ids", "n_ids", "restored")


def default_model() -> str:
    """The vocabulary's path: a parameter of the operators, with the public tokenizers' folder as its default."""
    return os.environ.get("CODEGRID_SENTENCEPIECE", "/opt/tokenizers/piece_bpe_32k.model")
