"""SQL of the text problems: the same look-alike table and markup rules as expressions over strings."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from .leakage import _TAG, RUN
from .lookalike import INVISIBLE, canonical, rules_of


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@lru_cache(maxsize=1)
def _rewritten() -> tuple[str, str, str, list[tuple[str, str]]]:
    """(code points, what each becomes, code points that vanish, strings and what they become)."""
    rules = rules_of()
    points = [chr(c) for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000] + [chr(c) for a, b in INVISIBLE for c in range(a, b + 1) if c >= 0x20000]
    became = {p: k for p in points if (k := canonical(p, rules)) != unicodedata.normalize("NFC", p)}
    single = {p: k for p, k in became.items() if len(k) == 1}
    strings = [(p, k) for p, k in became.items() if len(k) > 1] + [(x, y) for x, y in rules if len(x) > 1]
    return "".join(single), "".join(single.values()), "".join(p for p, k in became.items() if not k), strings


def canonical_sql(text: str) -> str:
    """The consistent form of a text; composed after single points are rewritten, as accents may stand apart."""
    before, after, gone, strings = _rewritten()
    out = f"translate({text}, {_quoted(before + gone)}, {_quoted(after)})"
    for x, y in strings:
        out = f"replace({out}, {_quoted(x)}, {_quoted(y)})"
    return f"nfc_normalize({out})"


def _unescaped(text: str) -> str:
    """Entities by number up to 255 and the named ones of everyday markup; the ampersand's own comes last."""
    named = {"&nbsp;": " ", "&nbsp": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&eacute;": "é", "&amp;": "&", "&amp": "&"}
    for entity, sign in [(f"&#{c};", chr(c)) for c in range(32, 256)] + list(named.items()):
        text = f"replace({text}, {_quoted(entity)}, {_quoted(sign)})"
    return text


def _words(table: str, key: str) -> str:
    """Tables {table}_w (key, words) and {table}_g (key, place, run of words as one string)."""
    bare = lambda t: f"regexp_replace({t}, {_quoted(_TAG.pattern)}, ' ', 'gis')"
    t = table
    return f"""{t}_a as (select distinct {key}, {canonical_sql("text")} t from {t} where text is not null and {key} is not null),
{t}_b as (select {key}, {bare("t")} t from {t}_a), {t}_c as (select {key}, case when contains(t, '&') then {_unescaped("t")} else t end t, contains(t, '&') more from {t}_b),
{t}_d as (select {key}, case when more then {canonical_sql("t")} else t end t, more from {t}_c), {t}_e as (select {key}, case when more then {bare("t")} else t end t from {t}_d),
{t}_w as (select {key}, regexp_extract_all(nfc_normalize(replace(replace(lower(t), 'ß', 'ss'), 'ς', 'σ')), '[\\p{{L}}\\p{{N}}]+') w from {t}_e),
{t}_g as (select {key}, k, array_to_string(w[k : k + {RUN - 1}], ' ') g from (select *, unnest(range(1, len(w) - {RUN - 2})) k from {t}_w where len(w) >= {RUN}))"""


def oracle_sql() -> dict[str, str]:
    looks = f"with look as (select distinct doc_id, text, {canonical_sql('text')} c from documents where text is not null and doc_id is not null)"
    leaks = f"with {_words('documents', 'doc_id')}, {_words('eval_items', 'item_id')}, run as (select distinct item_id, g from eval_items_g), hit as (select doc_id, item_id, count(*) n from documents_g join run using (g) group by 1, 2)"
    return {
        "p8_found": leaks + " select doc_id, item_id from hit",
        "p8_items": leaks + " select item_id, count(*) n_docs, max(n) most_places from hit group by 1",
        "p9_found": looks + " select distinct a.doc_id doc_id_1, b.doc_id doc_id_2 from look a join look b on a.c = b.c and a.text <> b.text and a.doc_id < b.doc_id",
        "p9_classes": looks + """, own as (select c, text, count(*) n from look group by 1, 2), whole as (select c, min(doc_id) class_id, count(*) n_docs, count(distinct text) n_spellings from look group by 1)
            select doc_id, class_id, n_docs, n_spellings, n_docs - n n_links from look join own using (c, text) join whole using (c)""",
    }
