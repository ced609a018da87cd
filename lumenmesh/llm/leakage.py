"""Evaluation texts that leaked into documents.

The test items are indexed by an inverted index with BM25 weights in blocks; every passage of every
document is a query against it, answered by block-max WAND. An item's threshold is the least score that any
of its runs of `run` words reaches as a query, so every passage that holds such a run is retrieved: the
search loses nothing. What it retrieves is verified word by word.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from . import lookalike

#: Consecutive words that make a leak (a fixed value of the task).
RUN = 13
#: Words of a passage; passages overlap by RUN - 1 words, so that each run lies in one.
PASSAGE = 3 * RUN
K1, B = 1.2, 0.75
#: Passages whose search results a task keeps for the next text that holds the same words.
RECENT = 10_000
#: Postings of a block.
BLOCK = 16
#: Items of an index; more items are searched index by index.
MAX_ITEMS = 20_000

#: Names of markup elements and of bracket codes, and attributes that stand without a value (fixed values).
ELEMENTS = """a abbr acronym address article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code
col colgroup data dd del details dfn dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5
h6 head header hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav nobr object ol optgroup option
output p param picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup
svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr""".split()
CODES = """b i u s url img quote code size color colour font list li ul ol table tr td th spoiler left right center centre justify indent
email user youtube video media audio attach attachment hr sub sup pre php html mention hide highlight align align-left h1 h2 h3 h4 post
topic thread icode inline nobbc noparse plain strike bold italic underline float anchor flash gallery poll snapback member""".split()
BARE = "async autofocus checked controls default defer disabled hidden ismap loop multiple muted nohref nowrap open readonly required reversed selected".split()

_VALUE = r"""\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=`]+)"""
_ATTRIBUTES = rf"(?:[\s/]+(?:[\w:.-]+{_VALUE}|(?:{'|'.join(BARE)})\b))"
_TAG = re.compile(
    rf"<!--.*?-->|<!doctype\b[^<>]*>|<\?xml\b[^<>]*\?>|</?(?:{'|'.join(ELEMENTS)}){_ATTRIBUTES}*[\s/]*>|<[a-z][\w:.-]*{_ATTRIBUTES}+[\s/]*>"
    + rf"|\[/?(?:{'|'.join(CODES)})(?:=[^\[\]]*|(?:\s+[\w:.-]+{_VALUE.replace('<>', '<>' + chr(92) + '[' + chr(92) + ']')})+)?\s*/?\]|\[\*\]",
    re.S | re.I,
)
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None, rules: tuple) -> list[str]:
    """The words of a text: runs of letters and digits of its consistent form, without markup and case.

    Markup are comments, elements of a known name or with an attribute that has a value, bracket codes of a
    known name, and entities. Other text between angle or square brackets is text.
    """
    if not isinstance(text, str):
        return []
    t = lookalike.canonical(text, rules)
    if "<" in t or "[" in t:
        t = _TAG.sub(" ", t)
    if "&" in t:
        t = lookalike.canonical(html.unescape(t), rules)
        t = _TAG.sub(" ", t)
    t = t.casefold()
    return _WORD.findall(t if t.isascii() else unicodedata.normalize("NFC", t))


class Index:
    """An inverted index of items: postings by item, in blocks that know their largest weight.

    Weights are divided by the item's threshold, so that a score of 1 is the threshold of every item.
    """

    def __init__(self, items: list[tuple[int, list[str]]], run: int = RUN):
        self.run = run
        items = [(i, w) for i, w in items if len(w) >= run]
        self.ids = [i for i, _ in items]
        runs = [{tuple(w[k : k + run]) for k in range(len(w) - run + 1)} for _, w in items]
        self.numbers = {r: k for k, r in enumerate(dict.fromkeys(r for rs in runs for r in rs))}
        self.runs = [{self.numbers[r] for r in rs} for rs in runs]
        self.recent: dict[frozenset[int], list[int]] = {}
        df = Counter(t for _, w in items for t in set(w))
        mean = sum(len(w) for _, w in items) / max(1, len(items))
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for n, (_, w) in enumerate(items):
            tf = Counter(w)
            norm = K1 * (1 - B + B * len(w) / mean)
            score = {t: math.log(1 + (len(items) - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in tf.items()}
            least = min(sum(score[t] for t in set(r)) for r in runs[n]) * (1 - 1e-9)
            for t, s in score.items():
                postings[t].append((n, s / least))
        self.vocabulary = {t: k for k, t in enumerate(postings)}
        self.docs = [[n for n, _ in p] for p in postings.values()]
        self.weights = [[s for _, s in p] for p in postings.values()]
        self.most = [max(w) for w in self.weights]
        self.blocks = [[max(w[k : k + BLOCK]) for k in range(0, len(w), BLOCK)] for w in self.weights]
        get = self.vocabulary.get
        self.neighbours = {(get(a) << 32) + get(b) for _, w in items for a, b in zip(w, w[1:])}

    def search(self, terms: Iterable[int]) -> list[int]:
        """Items whose score for the terms reaches 1, by block-max WAND."""
        found = []
        docs, weights, blocks, most = self.docs, self.weights, self.blocks, self.most
        cursors = sorted([docs[t][0], t, 0] for t in terms)  # next item, term, position; kept in order
        while True:
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += most[c[1]]
                if bound >= 1:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            pivot += 1
            while pivot < len(cursors) and cursors[pivot][0] == item:
                pivot += 1
            ahead = cursors[:pivot]
            del cursors[:pivot]
            # the blocks that would hold the pivot item bound its score more tightly
            bound = score = 0.0
            for c in ahead:
                t, of = c[1], docs[c[1]]
                c[2] = s = c[2] if c[0] >= item else bisect_left(of, item, c[2])
                if s < len(of):
                    bound += blocks[t][s // BLOCK]
                    if of[s] == item:
                        score += weights[t][s]
            after = item + 1
            if score >= 1:
                found.append(item)
            elif bound < 1:  # no item before the first of these blocks ends, or before the next cursor, can do
                ends = [docs[t][min(len(docs[t]), (s // BLOCK + 1) * BLOCK) - 1] + 1 for _, t, s in ahead if s < len(docs[t])]
                after = max(after, min([*ends, *(c[0] for c in cursors[:1])], default=after))
            # only the cursors that moved are put back in their places
            for c in ahead:
                of, s = docs[c[1]], c[2]
                if s < len(of) and of[s] < after:
                    s = s + 1 if of[s] + 1 == after else bisect_left(of, after, s)
                if s < len(of):
                    c[0], c[2] = of[s], s
                    insort(cursors, c)

    def stretches(self, words: list[str]) -> Iterator[tuple[int, int, list[int]]]:
        """Longest stretches of words each of which follows the one before it in some item too, with their terms.

        No run of an item lies outside of one, so only their passages have to be searched. A stretch as long
        as a run holds one of any words that are a run apart: only these are looked at until one is known.
        """
        get, follows, n = self.vocabulary.get, self.neighbours, len(words)
        at, free = self.run - 1, 0
        while at < n:
            t = get(words[at])
            if t is None:
                at += self.run
                continue
            before, after = [], []
            k, x = at, t
            while k > free and (y := get(words[k - 1])) is not None and (y << 32) + x in follows:
                before.append(y)
                k, x = k - 1, y
            end, x = at + 1, t
            while end < n and (y := get(words[end])) is not None and (x << 32) + y in follows:
                after.append(y)
                end, x = end + 1, y
            if end - k >= self.run:
                yield k, end, [*before[::-1], t, *after]
            free, at = end, end + self.run - 1

    def leaks(self, words: list[str]) -> dict[int, int]:
        """Items of which the words hold a run, and in how many places."""
        places: Counter[int] = Counter()
        step = PASSAGE - self.run + 1
        for start, end, terms in self.stretches(words):
            for a in range(start, end - self.run + 1, step):
                passage = frozenset(terms[a - start : a - start + PASSAGE])
                if (hits := self.recent.get(passage)) is None:
                    if len(self.recent) >= RECENT:
                        self.recent.clear()
                    hits = self.recent[passage] = self.search(passage)
                if hits:
                    numbers = [self.numbers.get(tuple(words[k : k + self.run])) for k in range(a, min(a + step, end - self.run + 1))]
                    for n in hits:
                        of = self.runs[n]
                        if k := sum(r in of for r in numbers):
                            places[n] += k
        return {self.ids[n]: k for n, k in places.items()}


def leaked(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", run: int = RUN, max_items: int = MAX_ITEMS) -> DataFrame:
    """Distinct (doc_id, item_id, n_runs): documents that hold at least `run` consecutive words of an item.

    n_runs counts the places in the document where a run of the item starts. Null ids and texts, empty
    texts and texts shorter than a run match nothing; repeated rows count once. Documents are read whole and
    once, and no shuffle but that of the result is needed: the index of at most `max_items` items goes to
    every task. More items are split by their id into several indexes: the words of the documents are written
    once, and searched in one index after the other, of which only one is held at a time.
    """
    rules = lookalike.rules_of()
    spark = docs.sparkSession
    some = items.select(F.col(item).cast("bigint").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").distinct()
    found = docs.select(F.col(doc).cast("bigint").alias("d"), F.col(text).alias("t")).where("d is not null and t is not null")
    shards = max(1, -(-some.count() // max_items))

    def index_of(k: int) -> Broadcast:
        rows = some.where(F.pmod(F.xxhash64("i"), F.lit(shards)) == k).toLocalIterator()
        return spark.sparkContext.broadcast(Index([(r["i"], words_of(r["t"], rules)) for r in rows], run))

    def search(index: Broadcast, words: Callable[[pd.DataFrame], Iterable[list[str]]]) -> Callable:
        def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ix = index.value
            for b in batches:
                out = [(d, i, k) for d, w in zip(b["d"], words(b)) for i, k in ix.leaks(w).items()]
                yield pd.DataFrame(out, columns=["d", "i", "k"])

        return of

    pairs = "d bigint, i bigint, k bigint"
    if shards == 1:
        met = found.mapInPandas(search(index_of(0), lambda b: (words_of(t, rules) for t in b["t"])), pairs)
    else:

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"d": b["d"], "w": [words_of(t, rules) for t in b["t"]]})

        tmp = Scratch(spark, "leaks")
        words, path = tmp.cut(found.mapInPandas(read, "d bigint, w array<string>").where(F.size("w") >= run))
        parts = []
        for k in range(shards):
            index = index_of(k)
            parts.append(tmp.cut(words.mapInPandas(search(index, lambda b: (w.tolist() for w in b["w"])), pairs))[0])
            index.destroy()
        tmp.drop(path)
        met = reduce(DataFrame.unionAll, parts)
    return met.groupBy(F.col("d").alias(doc), F.col("i").alias(item)).agg(F.max("k").alias("n_runs"))
