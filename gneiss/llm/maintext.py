"""Main text of web pages by maximum-scoring subsequence.

A page is read as a sequence of words and tags.  Words score positive and tags negative; how much is learned from labelled pages
(``labelled_pages``): log odds of a kind of token in main text against elsewhere, and of an element's features (tag, class, id, role)
on elements of main text against others.  Words in an element that is learned to hold menus, notices, comments and the like score below
zero, words in one that holds articles higher.  One linear scan finds the contiguous region of highest sum; blocks of the same parent
next to its ends join it, so short first and last paragraphs are kept; what scores below zero inside it (an advert between two
paragraphs) is left out.

Character references are decoded, white space within a block becomes one blank, blocks are joined by one blank.  Elements that inline
markup opens do not part words; any other element does.

Defined cases: null or empty html, and pages in which nothing scores above zero, give an empty text; unclosed elements end with their
parent, an unclosed comment, script or style with the page; repeated rows are pages of their own; an empty table gives an empty result.
The work and memory for a page are linear in its length.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from gneiss.llm.common import lean
from gneiss.llm.labelled_pages import PAGES

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ITEMS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
#: tags that tell how text looks or is laid out, not what it is: they get no weight of their own
LAYOUT = frozenset("html body div section p pre blockquote ul ol li dl dt dd table thead tbody tr td th figure figcaption hr center h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLES = frozenset(["article", "main"])
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z) | <(?P<raw>script|style|template|noscript|iframe|svg|math|object|textarea|title)\b [^>]*+ (?:>|\Z) .*? (?:</(?P=raw)\s*+>|\Z)
    | <(?P<end>/?)(?P<tag>[a-z][^\s/>]*+) (?P<attrs>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+) > | <[!?/][^>]*+(?:>|\Z) | (?P<text>[^<]++|<)""",
    re.I | re.S | re.X,
)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop|style|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
MOSTLY = 0.6
LEAST_WEIGHT, MOST_WEIGHT = 1.5, -2.5  # features between tell nothing: those of elements without main text must be met on two pages
KINDS = ("word", "link word", "block", "inline", "item")


def features(tag: str, attrs: str) -> list[str]:
    """What is known of an element: its tag; words of its class, id, role and itemprop; whether it is hidden."""
    found = [] if tag in LAYOUT else [f"<{tag}>"]
    if attrs:
        for name, a, b, c in ATTRIBUTE.findall(attrs):
            name, value = name.lower(), a or b or c
            if name in ("class", "id", "role", "itemprop"):
                found += [w.lower() for w in WORD.findall(value)]
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and UNSEEN.search(value):
                found.append("hidden")
    return list(dict.fromkeys(found))


def kind_of(tag: str) -> int:
    return 3 if tag in INLINE else 4 if tag in ("li", "ul", "ol", "td", "th", "tr", "option", "dd", "dt", "label", "input", "button", "select") else 2


def learn(pages=PAGES) -> tuple[list[float], dict[str, float]]:
    """Weights of kinds of tokens, and of features of elements, from labelled pages.

    An element with mostly main text is main, one without any is not; others count for neither.
    """
    tokens, inside = {True: Counter(), False: Counter()}, {True: Counter(), False: Counter()}
    for page in pages:
        stack: list[list] = []  # tag, features, words of main and of other text
        link = False
        every: list[list] = []
        for main, part in page:
            for m in TOKEN.finditer(part):
                tag = (m["tag"] or "").lower()
                if m["text"] is not None:
                    n = len(references.unescape(m["text"]).split())
                    tokens[main]["link word" if link else "word"] += n
                    for e in stack:
                        e[2][main] += n
                elif tag:
                    tokens[main][KINDS[kind_of(tag)]] += 1
                    link = tag == "a" and not m["end"] if tag == "a" else link
                    if m["end"]:
                        while any(e[0] == tag for e in stack) and stack.pop()[0] != tag:
                            pass
                    elif tag not in VOID and tag not in INLINE:
                        stack.append([tag, features(tag, m["attrs"]), {True: 0, False: 0}])
                        every.append(stack[-1])
        held = {True: set(), False: set()}
        for tag, fs, words in every:
            whole = words[True] + words[False]
            if whole and tag not in ("html", "body") and (words[True] >= MOSTLY * whole or not words[True]):
                held[words[True] > 0].update(fs)
        for main, fs in held.items():
            inside[main].update(fs)
    odds = lambda yes, no, all_yes, all_no: math.log((yes + 1) / (all_yes + 2)) - math.log((no + 1) / (all_no + 2))
    total = {k: sum(tokens[k].values()) for k in tokens}
    kinds = [odds(tokens[True][k], tokens[False][k], total[True], total[False]) for k in KINDS]
    # counted by pages: how long a page's text is says nothing of its elements
    weights = {f: 2 * math.log((inside[True][f] + 0.5) / (inside[False][f] + 0.5)) for f in {*inside[True], *inside[False]}}
    weights["hidden"] = min(weights.values())
    return kinds, {f: w for f, w in weights.items() if w >= LEAST_WEIGHT or w <= MOST_WEIGHT}


class Reader:
    """Finds the main text of pages with given weights."""

    def __init__(self, kinds: list[float], weights: dict[str, float]):
        self.word, self.link_word = kinds[:2]
        self.tags = [min(k, -0.1) for k in kinds]
        self.weights = weights
        self.weight = lru_cache(4096)(self.weigh)

    def weigh(self, tag: str, attrs: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(tag, attrs))

    def runs(self, page: str) -> list[tuple]:
        """(score, text or None, state, parent, leaf) of each tag and each text between tags; a block's end is a text of one blank."""
        out: list[tuple] = []
        # tag, state, number, state outside it, whether it is in an element that holds main text
        stack, opened, numbers = [("", 0.0, 0, 0.0, False)], Counter(), 0
        link = 0
        for m in TOKEN.finditer(page):
            top = stack[-1]
            state = top[1]
            text = m["text"]
            if text is not None:
                if "&" in text:
                    text = references.unescape(text)
                n = len(text.split())
                leaf = top[0] in LEAVES
                score = -0.01 if state < 0 and top[4] else n * ((self.link_word if link else self.word) + state)
                out.append((score, text, state, stack[-2][2] if leaf else top[2], leaf))
                continue
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            inline = tag in INLINE
            score = self.tags[kind_of(tag)]
            # a tag costs less where words are worth more, but always something; what stands within an article can be passed over
            score = min(score + state, -0.01) if state >= 0 else -0.01 if top[4] else score
            out.append((score, None if inline else " ", state, -1, False))
            if inline:
                if tag == "a":
                    link = 0 if m["end"] else len(stack)
                continue
            if m["end"]:
                if opened[tag]:
                    while True:
                        gone = stack.pop()[0]
                        opened[gone] -= 1
                        if gone == tag:
                            break
                    if link > len(stack):
                        link = 0
                continue
            if tag in VOID:
                continue
            while len(stack) > 1 and (stack[-1][0] == "p" or stack[-1][0] in ITEMS.get(tag, ())):
                opened[stack.pop()[0]] -= 1
            outside = stack[-1]
            state, w = outside[1], self.weight(tag, m["attrs"])
            if w < 0:
                state = min(state, 0.0) + w
            elif w > 0 and (state >= 0 or tag in ARTICLES):
                state = max(state, w)
            elif tag in HEADINGS and outside[0] == "header" and outside[3] > 0:
                state = outside[3]  # an article's own headline
            numbers += 1
            stack.append((tag, state, numbers, outside[1], outside[4] or outside[1] > 0))
            opened[tag] += 1
        return out

    def text(self, page: str | None) -> str:
        runs = self.runs(page) if page else []
        best, first, last, total, start = 0.0, 0, -1, 0.0, 0
        for i, r in enumerate(runs):
            if total <= 0:
                total, start = 0.0, i
            total += r[0]
            if total > best:
                best, first, last = total, start, i
        if last < 0:
            return ""
        first, last = self.extend(runs, first, -1), self.extend(runs, last, 1)
        return " ".join("".join(r[1] for r in runs[first : last + 1] if r[1] is not None and (r[2] >= 0 or r[1] == " ")).split())

    @staticmethod
    def extend(runs: list[tuple], at: int, step: int) -> int:
        """The last run from `at` on that leaves of the same parent reach without a break."""
        i, edge = at, at
        while 0 <= i < len(runs) and runs[i][3] < 0:
            i -= step
        parent, i = runs[i][3], at + step
        while 0 <= i < len(runs):
            _, text, state, mine, leaf = runs[i]
            if mine >= 0 and text.strip():
                if mine != parent or not leaf or state < 0:
                    break
                edge = i
            i += step
        return edge


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def main_texts(pages: DataFrame, labelled=PAGES) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html)."""
    learned = learn(labelled)

    def read(batches):
        reader = Reader(*learned)
        for b in batches:
            texts = [reader.text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema=SCHEMA)

    cols = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html")
    return cols.mapInArrow(lean(read), "page_id long, url string, text string, n_chars long")


def op12_maintext(spark, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
