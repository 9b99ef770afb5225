"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element and every run of text in one is a variable, content or not. Potentials: how a child's state follows its
parent's (by the child's kind), what kind of element each state shows, and what its text looks like (words, share of them in links, the
block it stands in). Sum-product messages, leaves to root and back, give each text's exact marginal of being content; texts at
``THRESHOLD`` and more are kept.

The potentials are counts over labelled pages plus stated prior counts. A page is labelled by the documents: the one that shares most lines with the
page's blocks is its article, and blocks that are lines of it are content. At most about ``SAMPLE`` pages are used for that (a documented
bound, drawn by a hash of the page id), held against the lines of all documents.

Scripts, styles, templates, titles and other elements that show no text never become variables. Character references are decoded, white
space inside a block (line breaks too) is one space, blocks are joined by \\n in page order. Nulls, empty pages and pages without content
give the empty string. Broken markup is read as far as it goes: unclosed elements end with their parents, stray end tags
are passed over. Extra columns are ignored; repeated pages are extracted row by row.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from codegrid.llm.common import staged

SAMPLE = 2_000
THRESHOLD = 0.5

# fixed values: element names of HTML
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = set("script style template noscript title head svg math iframe object canvas audio video select datalist textarea".split())
_RAW = set("script style title textarea iframe noscript".split())
_BLOCK = set("address article aside blockquote body button dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
             "header hgroup hr html label legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead "
             "tr ul caption center".split())
_CLOSES_P = _BLOCK - set("body html button label option optgroup legend td th tr tbody thead tfoot caption summary".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
         "option": {"option"}, "p": {"p"}}
_SCOPE = set("table ul ol dl div article section body html td th main aside nav footer header form blockquote".split())
#: names that tell an element's kind
_AROUND = set("nav header footer aside form menu button fieldset label legend dialog search".split())
_MAIN = set("article main".split())
_AROUND_NAMES = re.compile(r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|side-?bar|footer|header|masthead|breadcrumbs?|"
                           r"comments?\w*|replies|disqus|cookies?\w*|consent|notices?|alert|popup|modal|newsletter|subscri\w*|sign-?up|login|share\w*|social\w*|"
                           r"related|recommend\w*|widget\w*|toolbar|pagination|pager|copyright|legal|skip\w*|search\w*|tags?)(?=$|[\s_-])")
_AROUND_ROLES = set("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_MAIN_NAMES = re.compile(r"(?i)(?:^|[\s_-])(?:article\w*|content|main|post|entry|story|text|body)(?=$|[\s_-])")

_MARKUP = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"(?i)\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

PLAIN, AROUND, MAIN, KINDS = 0, 1, 2, 3
N_WORDS, N_LINKS, N_PLACES = 6, 3, 5
_PLACES = {**dict.fromkeys("p blockquote pre dd".split(), 0), **dict.fromkeys("h1 h2 h3 h4 h5 h6".split(), 1),
           **dict.fromkeys("li dt option".split(), 2), **dict.fromkeys("td th caption".split(), 3)}


def _kind(tag: str, attributes: str) -> tuple[int, bool]:
    """Kind of an element, and whether it is hidden."""
    kind, hidden = (AROUND if tag in _AROUND else MAIN if tag in _MAIN else PLAIN), False
    if attributes.strip():
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id") and kind != AROUND:
                if _AROUND_NAMES.search(value):
                    kind = AROUND
                elif kind == PLAIN and _MAIN_NAMES.search(value):
                    kind = MAIN
            elif name == "role" and value.lower() in _AROUND_ROLES:
                kind = AROUND
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                hidden = True
    return kind, hidden


class Page:
    """The variables of a page in document order: parent, kind, and for texts their looks and text."""

    def __init__(self, source: str | None) -> None:
        self.parent, self.kind, self.looks, self.text = [-1], [PLAIN], [None], [None]
        stack = [("#root", 0, False)]  # element, its variable, whether it hides what it holds
        links = hidden = 0
        run: list[str] = []
        linked = 0

        def end_block() -> None:
            nonlocal linked
            if run:
                words = " ".join(html.unescape("".join(run)).split())
                if words:
                    n = words.count(" ") + 1
                    place = next((_PLACES.get(t, 4) for t, _, _ in reversed(stack) if t in _BLOCK), 4)
                    share = linked / max(1, sum(map(len, run)))
                    self._add(stack[-1][1], PLAIN, (min(n.bit_length(), N_WORDS) - 1, 0 if share < 0.05 else 1 if share < 0.6 else 2, place), words)
                run.clear()
                linked = 0

        def pop() -> None:
            nonlocal links, hidden
            tag, _, hides = stack.pop()
            links -= tag == "a"
            hidden -= hides

        at, source = 0, source or ""
        size = len(source)
        while at < size:
            m = _MARKUP.search(source, at)
            upto = m.start() if m else size
            if upto > at and not hidden:
                run.append(source[at:upto])
                linked += (upto - at) * (links > 0)
            if not m:
                break
            at = m.end()
            tag = m.group(2)
            if not tag:
                continue
            tag = tag.lower()
            if m.group(1):
                if tag in _BLOCK:
                    end_block()
                if any(t == tag for t, _, _ in stack):
                    while True:
                        last = stack[-1][0]
                        if last in _BLOCK:
                            end_block()
                        pop()
                        if last == tag:
                            break
                continue
            if tag == "br":
                run.append(" ")
                continue
            if tag in _BLOCK:
                end_block()
                closes = _SAME.get(tag, set()) | ({"p"} if tag in _CLOSES_P else set())
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in closes:
                        while len(stack) > i:
                            pop()
                        break
                    if stack[i][0] in _SCOPE:
                        break
            if tag in _VOID or m.group(3).endswith("/") and tag not in _BLOCK and tag not in _RAW:
                continue
            if tag in _RAW:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else size
                continue
            kind, hides = _kind(tag, m.group(3))
            hides = hides or tag in _HIDDEN
            here = stack[-1][1]
            if tag in _BLOCK:
                here = self._add(here, kind, None, None)
            links += tag == "a"
            hidden += hides
            stack.append((tag, here, hides))
        end_block()

    def _add(self, parent: int, kind: int, looks, text) -> int:
        self.parent.append(parent)
        self.kind.append(kind)
        self.looks.append(looks)
        self.text.append(text)
        return len(self.parent) - 1


class Model:
    """Potentials, as counts that start from the prior ones. States: 0 not content, 1 content."""

    def __init__(self) -> None:
        # follow[kind, parent, child]
        self.follow = np.tile(np.array([[40.0, 0.4], [3.0, 12.0]]), (KINDS + 1, 1, 1))
        self.follow[AROUND] = [[40.0, 0.2], [40.0, 0.4]]
        self.follow[MAIN] = [[4.0, 4.0], [0.5, 20.0]]
        self.follow[KINDS] = [[40.0, 0.2], [1.0, 40.0]]  # texts
        self.words = np.array([[6.0, 4, 3, 2, 1, 1], [1.0, 2, 3, 4, 4, 4]])
        self.links = np.array([[5.0, 2, 6], [9.0, 1, 0.3]])
        self.places = np.array([[1.0, 1, 4, 1, 4], [6.0, 2, 1, 1, 2]])

    def learn(self, counts: dict[str, np.ndarray]) -> "Model":
        for name, v in counts.items():
            setattr(self, name, getattr(self, name) + v.reshape(getattr(self, name).shape))
        return self

    def ready(self) -> "Model":
        def share(m):
            return (m / m.sum(axis=-1, keepdims=True)).tolist()
        self.p = [share(self.follow), share(self.words), share(self.links), share(self.places)]
        return self

    def marginals(self, page: Page) -> list[float]:
        """P(content) of every variable, by one pass of messages up the tree and one down."""
        follow, words, links, places = self.p
        n, parent = len(page.parent), page.parent
        up, sent = [[1.0, 1.0] for _ in range(n)], [None] * n
        for i in range(n - 1, 0, -1):
            u0, u1 = up[i]
            looks = page.looks[i]
            if looks is not None:
                w, k, q = looks
                u0 *= words[0][w] * links[0][k] * places[0][q]
                u1 *= words[1][w] * links[1][k] * places[1][q]
                f = follow[KINDS]
            else:
                f = follow[page.kind[i]]
            z = u0 + u1
            u0, u1 = u0 / z, u1 / z
            up[i] = [u0, u1]
            m0, m1 = f[0][0] * u0 + f[0][1] * u1, f[1][0] * u0 + f[1][1] * u1
            sent[i] = (m0, m1)
            t = up[parent[i]]
            t[0] *= m0
            t[1] *= m1
            if t[0] + t[1] < 1e-100:
                t[0] *= 1e100
                t[1] *= 1e100
        belief = [None] * n
        z = up[0][0] + up[0][1]
        belief[0] = (up[0][0] / z, up[0][1] / z)
        for i in range(1, n):
            b, (m0, m1), (u0, u1) = belief[parent[i]], sent[i], up[i]
            f = follow[KINDS] if page.looks[i] is not None else follow[page.kind[i]]
            d0, d1 = b[0] / max(m0, 1e-300), b[1] / max(m1, 1e-300)
            x0, x1 = u0 * (d0 * f[0][0] + d1 * f[1][0]), u1 * (d0 * f[0][1] + d1 * f[1][1])
            z = x0 + x1
            belief[i] = (x0 / z, x1 / z) if z > 0 else (0.5, 0.5)
        return [b[1] for b in belief]

    def extract(self, source: str | None) -> str:
        page = Page(source)
        return "\n".join(t for t, p in zip(page.text, self.marginals(page)) if t is not None and p >= THRESHOLD)


def _page_lines(frames):
    """The texts of each labelled page's blocks."""
    for pdf in frames:
        got = [(i, t) for i, h in zip(pdf["page_id"], pdf["html"]) for t in dict.fromkeys(x for x in Page(h).text if x)]
        yield pd.DataFrame(got, columns=["page_id", "line"])


def _counts(frames):
    """Counts of the model's events over labelled pages: an element is content if a text in it is."""
    total = {k: np.zeros_like(getattr(Model(), k)) for k in ("follow", "words", "links", "places")}
    for pdf in frames:
        for source, lines in zip(pdf["html"], pdf["lines"]):
            page, good = Page(source), set(lines)
            state = [0] * len(page.parent)
            for i in range(len(state) - 1, 0, -1):
                if page.text[i] in good:
                    state[i] = 1
                if state[i]:
                    state[page.parent[i]] = 1
            for i in range(1, len(state)):
                kind = KINDS if page.looks[i] is not None else page.kind[i]
                total["follow"][kind, state[page.parent[i]], state[i]] += 1
                if page.looks[i] is not None:
                    for name, v in zip(("words", "links", "places"), page.looks[i]):
                        total[name][state[i], v] += 1
    for name, v in total.items():
        yield pd.DataFrame({"name": name, "at": np.arange(v.size), "n": v.ravel()})


def labelled_pages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(html, lines) of at most about SAMPLE pages: the blocks that are lines of the document the page shares most with."""
    share = min(1.0, SAMPLE / max(1, pages.count()))
    some = staged(pages.where("html IS NOT NULL AND page_id IS NOT NULL").where(
        F.pmod(F.xxhash64("page_id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("page_id", "html").dropDuplicates(["page_id"]), "html-some")
    lines = staged(some.mapInPandas(_page_lines, "page_id long, line string").withColumn("h", F.xxhash64("line")), "html-lines")
    # a line of all documents is only kept if one of the sampled pages has it; the hashes are those of a bounded sample
    wanted = F.broadcast(lines.select("h").distinct())
    told = (docs.where("doc_id IS NOT NULL").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
            .select("doc_id", F.xxhash64(F.trim(F.regexp_replace("line", r"\s+", " "))).alias("h")).join(wanted, "h").distinct())
    # common lines say little: a line counts by one over the documents that have it
    weight = told.groupBy("h").agg((1.0 / F.count(F.lit(1))).alias("w"))
    best = (told.join(weight, "h").join(lines, "h").groupBy("page_id", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
            .groupBy("page_id").agg(F.max(F.struct("n", "w", -F.col("doc_id"))).alias("m")).select("page_id", (-F.col("m.col3")).alias("doc_id")))
    good = best.join(told, "doc_id").join(lines, ["page_id", "h"]).groupBy("page_id").agg(F.collect_list("line").alias("lines"))
    return some.join(good, "page_id").select("html", "lines")


def train(pages: DataFrame, docs: DataFrame) -> Model:
    sums = (labelled_pages(pages, docs).mapInPandas(_counts, "name string, at int, n double").groupBy("name", "at").agg(F.sum("n").alias("n")))
    model, got = Model(), {}
    for r in sums.collect():  # some 40 numbers
        got.setdefault(r.name, np.zeros(getattr(model, r.name).size))[r.at] = r.n
    return model.learn(got).ready()


def _extract(model: Model):
    def run(frames):
        for pdf in frames:
            for a in range(0, len(pdf), 500):
                part = pdf.iloc[a:a + 500]
                text = [model.extract(h) for h in part["html"]]
                yield pd.DataFrame({"row": part["row"], "text": text, "n_chars": [len(t) for t in text]})
    return run


def extract_pages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    model = train(pages.select(F.col("page_id").cast("long").alias("page_id"), "html"), docs.select("doc_id", "text"))
    rows = pages.select(F.struct(F.col("page_id").cast("long").alias("page_id"), "url").alias("row"), F.col("html").cast("string").alias("html"))
    return rows.mapInPandas(_extract(model), "row struct<page_id: bigint, url: string>, text string, n_chars long").select("row.*", "text", "n_chars")
