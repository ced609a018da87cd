"""One consistent form for texts that look the same.

Look-alike classes are the transitive closure, by union-find over strings and code points, of: width forms,
same-shaped letters of other scripts, letter-like number signs, kinds of space, and invisible characters
(which look like the empty string). Accents are compared decomposed, so composed and combining spellings
meet by themselves. Each class is represented by the member that the corpus uses most; texts are rewritten
greedily, the longest leftmost member first, by a multi-pattern automaton.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Same-shaped letters of other scripts (fixed values): a Latin letter and the Cyrillic, Greek, Armenian, Coptic,
#: Cherokee and Lisu letters drawn like it.
SAME_SHAPE = {
    "A": "АΑᎪꓮ", "B": "ВΒⲂᏴꓐ", "C": "СϹⲤᏟꓚ", "D": "Ꭰꓓ", "E": "ЕΕᎬꓰ", "F": "Ϝꓝ", "G": "ԌᏀꓖ", "H": "НΗⲎᎻꓧ", "I": "ІΙӀⲒꓲ", "J": "ЈͿᎫꓙ",
    "K": "КΚⲔᏦꓗ", "L": "Ꮮꓡ", "M": "МΜϺⲘᎷꓟ", "N": "ΝⲚꓠ", "O": "ОΟՕⲞꓳ", "P": "РΡⲢᏢꓑ", "Q": "Ԛ", "R": "Ꭱꓣ", "S": "ЅՏᏚꓢ", "T": "ТΤⲦᎢꓔ",
    "U": "Սꓴ", "V": "ѴᏙꓦ", "W": "ԜᎳꓪ", "X": "ХΧⲬꓫ", "Y": "ҮΥⲨꓬ", "Z": "ΖᏃꓜ", "a": "аα", "c": "сϲⲥ", "d": "ԁ", "e": "е", "g": "ց", "h": "һհ",
    "i": "і", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօⲟ", "p": "рρⲣ", "q": "ԛզ", "s": "ѕ", "u": "սυ", "v": "ѵν", "w": "ԝ", "x": "х",
    "y": "у", "æ": "ӕ", "Æ": "Ӕ", "ə": "ә", "Ə": "Ә", "-": "‐‑",
}
#: Look-alikes across Cyrillic, Greek and signs that have no Latin letter (fixed values).
SAME_SHAPE_OTHER = [("Г", "Γ"), ("П", "Π"), ("Л", "Ʌ"), ("Ф", "Φ"), ("к", "κ"), ("ø", "ѳ"), ("У", "Ү"), ("Ω", "Ω"), ("µ", "μ"), ("Å", "Å")]
#: Letters with a stroke and their spelling with a combining overlay (fixed values).
STROKES = [("ø", "o̸"), ("Ø", "O̸"), ("đ", "d̵"), ("Đ", "D̵"), ("ħ", "h̵"), ("ł", "l̵")]
#: Invisible characters beside those of category Cf (fixed values): variation selectors, joiners, fillers.
INVISIBLE = [(0xFE00, 0xFE0F), (0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0xE0100, 0xE01EF)]


def _pairs() -> Iterator[tuple[str, str]]:
    for a, others in SAME_SHAPE.items():
        for b in others:
            yield a, b
    yield from SAME_SHAPE_OTHER
    yield from STROKES
    for first, last in INVISIBLE:
        for c in range(first, last + 1):
            yield chr(c), ""
    for c in range(0x80, 0x20000):
        ch = chr(c)
        kind = unicodedata.category(ch)
        tag, _, rest = unicodedata.decomposition(ch).partition(" ")
        if kind == "Cf":
            yield ch, ""
        elif kind == "Zs":
            yield ch, " "
        elif tag in ("<wide>", "<narrow>") or 0x2160 <= c <= 0x217F or (tag == "<font>" and kind in ("Lu", "Ll", "Nd")) or (tag == "<compat>" and _spelled_out(ch, kind)):
            # width and font forms, Roman numerals, digraphs, ligatures and rows of dots are drawn like what they stand for
            yield ch, unicodedata.normalize("NFKC", ch)
    yield "\r\n", "\n"


def _spelled_out(ch: str, kind: str) -> bool:
    """Whether a sign is drawn as the string of letters, or of full stops and marks, that it stands for."""
    whole = unicodedata.normalize("NFKC", ch)
    kinds = {unicodedata.category(x) for x in whole}
    return len(whole) > 1 and ((kind in ("Lu", "Ll", "Lt") and kinds <= {"Lu", "Ll"}) or (kind == "Po" and set(whole) <= set(".!?")))


@lru_cache(maxsize=1)
def classes() -> dict[str, list[str]]:
    """Every look-alike string, decomposed, with the members of its class in order."""
    up: dict[str, str] = {}

    def find(x: str) -> str:
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in _pairs():
        a, b = (unicodedata.normalize("NFD", v) for v in (a, b))
        x, y = find(a), find(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    members: dict[str, list[str]] = {}
    for x in sorted(up):
        members.setdefault(find(x), []).append(x)
    return {x: members[find(x)] for x in up}


def representatives(counts: dict[str, int]) -> dict[str, str]:
    """What each look-alike string is rewritten to: the most frequent member of its class; at a tie the smallest.

    The class of invisible characters is always rewritten to nothing.
    """
    out = {}
    for x, members in classes().items():
        best = "" if "" in members else min(members, key=lambda m: (-counts.get(m, 0), m))
        if x != best:
            out[x] = best
    return out


class _Rewriter:
    """A set of rules: code points by table, strings by the automaton; and the characters without which nothing is rewritten."""

    def __init__(self, rules: Rules):
        self.table = {x: y for x, y in rules if len(x) == 1}
        self.points = frozenset(self.table)
        strings = [(x, y) for x, y in rules if len(x) > 1]
        self.signs = frozenset(max(x) for x, _ in strings)  # one character of each string
        self.automaton = ahocorasick.Automaton()
        for x, y in strings:
            self.automaton.add_word(x, (len(x), y))
        self.automaton.make_automaton()


@lru_cache(maxsize=8)
def _rewriter(rules: Rules) -> _Rewriter:
    return _Rewriter(rules)


class Rules(tuple):
    """Pairs of a look-alike string and what it is rewritten to; the hash is worked out once, not for every text."""

    def __hash__(self) -> int:
        if "hash" not in self.__dict__:
            self.__dict__["hash"] = super().__hash__()
        return self.__dict__["hash"]


def rules_of(counts: dict[str, int] | None = None) -> Rules:
    return Rules(sorted(representatives(counts or {}).items()))


def canonical(text: str, rules: Rules) -> str:
    """The consistent form of a text; a second application changes nothing.

    Code points come first, so that strings are found however their letters were spelled; then strings, the
    longest leftmost one first, until there are none.
    """
    r = _rewriter(rules)
    t = text if text.isascii() else unicodedata.normalize("NFD", text)
    while True:
        there = set(t)
        if hit := r.points & there:
            for c in hit:  # what a point is rewritten to is never rewritten itself
                t = t.replace(c, r.table[c])
            whole = unicodedata.normalize("NFD", t)
            if whole != t:
                t = whole
                continue
            there = (there - hit).union(*(r.table[c] for c in hit))
        if r.signs.isdisjoint(there):
            return t if t.isascii() else unicodedata.normalize("NFC", t)
        out, at = [], 0
        for end, (n, y) in r.automaton.iter_long(t):
            out += (t[at : end + 1 - n], y)
            at = end + 1
        if not out:
            return t if t.isascii() else unicodedata.normalize("NFC", t)
        out.append(t[at:])
        t = unicodedata.normalize("NFD", "".join(out))


def member_counts(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """How often each look-alike string occurs in all texts; its size is bounded by that of the class table."""
    singles = {ord(x): x for x in classes() if len(x) == 1}
    points = np.array(sorted(singles), np.int64)
    longer = [(x, max(x)) for x in classes() if len(x) > 1]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(points[-1] + 1, np.int64)
        strings: Counter[str] = Counter()
        for b in batches:
            # a separator that is no member keeps strings from reaching over the end of a text
            whole = "\0".join(t if t.isascii() else unicodedata.normalize("NFD", t) for t in b["t"])
            codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
            total += np.bincount(codes[codes < len(total)], minlength=len(total))
            there = set(whole)
            strings.update({x: n for x, sign in longer if sign in there and (n := whole.count(x))})
        found = {singles[p]: int(total[p]) for p in points if total[p]} | strings
        yield pd.DataFrame({"member": list(found), "n": list(found.values())})

    found = docs.select(F.col(text).alias("t")).where("t is not null").mapInPandas(run, "member string, n bigint")
    return {r["member"]: r["n"] for r in found.groupBy("member").agg(F.sum("n").alias("n")).collect()}


def canonical_column(text: F.Column, rules: Rules) -> F.Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: canonical(t, rules) if isinstance(t, str) else None)

    return F.pandas_udf(run, "string")(text)


def consistent(docs: DataFrame, text: str = "text", counts: dict[str, int] | None = None) -> DataFrame:
    """docs with a column `canonical`: texts that look the same have the same one.

    A null text stays null; empty texts, and texts of invisible characters only, become empty. Without
    counts they are taken from all texts. Documents are rewritten whole, without a shuffle.
    """
    return docs.withColumn("canonical", canonical_column(F.col(text), rules_of(member_counts(docs, text) if counts is None else counts)))


def _keys(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(id, c, r): fingerprints of the consistent form and of the text itself; null ids and texts drop out."""
    d = consistent(docs.select(F.col(doc).alias("id"), F.col(text).alias("t")).where("id is not null and t is not null"), "t")
    keys = d.select("id", F.unhex(F.md5("canonical")).alias("c"), F.unhex(F.md5("t")).alias("r"))
    return Scratch(docs.sparkSession, "looks").cut(keys)[0]


def look_alike_pairs(docs: DataFrame, doc: str = "doc_id", text: str = "text", block: int = 2_000) -> DataFrame:
    """Distinct (doc_id_1, doc_id_2), doc_id_1 < doc_id_2, of texts that differ but look the same.

    Pairs are made between different spellings of one look first, then spelled out to their documents,
    so copies of one text never meet each other, however many there are. Spellings of a look, and copies
    of a spelling, take part in blocks, so no key has more than `block` rows on one of its sides. The
    result is as long as there are such pairs; `look_classes` says the same in one row per document.
    """
    keys = _keys(docs, doc, text)
    spellings = keys.groupBy("c", "r").agg(F.count(F.lit(1)).alias("n"))
    several = spellings.groupBy("c").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    some = spellings.join(several, "c").select("c", "r", blocks("n").alias("parts"), blocks("k").alias("salts"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = some.select("c", F.pmod(F.xxhash64("r"), "salts").cast("int").alias("salt"), F.col("r").alias("r1"), F.col("parts").alias("m1"))
    two = some.select("c", every("salts").alias("salt"), F.col("r").alias("r2"), F.col("parts").alias("m2"))
    pairs = one.join(two, ["c", "salt"]).where("r1 < r2").select("r1", "r2", every("m1").alias("p1"), "m2").select("r1", "r2", "p1", every("m2").alias("p2"))
    own = keys.join(some.select("c", "r", "parts"), ["c", "r"]).select("r", "id", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("p"))
    met = pairs.join(own.withColumnsRenamed({"r": "r1", "p": "p1", "id": "a"}), ["r1", "p1"]).join(own.withColumnsRenamed({"r": "r2", "p": "p2", "id": "b"}), ["r2", "p2"]).where("a <> b")
    return met.select(F.least("a", "b").alias("doc_id_1"), F.greatest("a", "b").alias("doc_id_2")).distinct()


def look_classes(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, n_docs, n_spellings, n_links): one row per document with a text.

    class_id is the smallest doc_id of its look; n_links is the number of documents that look the same but
    are spelled otherwise. Repeated rows of a document are counted once.
    """
    keys = _keys(docs, doc, text).distinct()
    by_spelling = keys.groupBy("c", "r").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    by_look = by_spelling.groupBy("c").agg(F.min("first").alias("class_id"), F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_spellings"))
    spelled = by_spelling.join(by_look, "c").select("c", "r", "class_id", "n_docs", "n_spellings", (F.col("n_docs") - F.col("n")).alias("n_links"))
    return keys.join(spelled, ["c", "r"]).select(F.col("id").alias(doc), "class_id", "n_docs", "n_spellings", "n_links")
