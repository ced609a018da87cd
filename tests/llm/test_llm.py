"""The text and grouping operators against brute force, exact round trips and awkward input."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenmesh.llm import components, leakage, lookalike, packing
from pyspark.sql import functions as F

RULES = lookalike.rules_of()


def _groups(edges, more=()):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    for n in more:
        find(n)
    return {n: find(n) for n in up}


@pytest.mark.parametrize("seed", range(3))
def test_groups_against_union_find(spark, seed):
    r = random.Random(seed)
    ids = list(range(400))
    r.shuffle(ids)
    chain = list(zip(ids[:120], ids[1:120]))
    hub = [(ids[130], x) for x in ids[131:200]]
    loose = [(r.choice(ids), r.choice(ids)) for _ in range(90)]
    edges = chain + [(b, a) for a, b in hub] + loose + chain[:5] + [(7, 7), (None, 3), (5, None), (9001, 9001)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint").withColumn("group_id", F.lit(0))
    v = spark.createDataFrame([(9002,), (9002,), (None,), (3,)], "node_id bigint")
    got = components.connected_groups(df, "src", "dst", v).collect()
    assert len(got) == len({x[0] for x in got})
    assert dict(map(tuple, got)) == _groups(edges, [9002, 3])


def test_hub_told_many_minima(spark):
    """One vertex between 10^6 others, each of which has a smaller neighbour of its own: a million different minima meet at it."""
    n = 1_000_000
    hub = 10 * n
    i = F.col("id")
    edges = spark.range(n).select(i.alias("src"), (i + n).alias("dst")).union(spark.range(n).select((i + n).alias("src"), F.lit(hub).alias("dst")))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    got = components.connected_groups(edges, "src", "dst").agg(F.count("*"), F.max("group_id"), F.min("group_id"), F.count_distinct("node_id")).first()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert tuple(got) == (2 * n + 1, 0, 0, 2 * n + 1)


def test_groups_of_nothing(spark):
    none = spark.createDataFrame([], "src bigint, dst bigint")
    assert components.connected_groups(none, "src", "dst").count() == 0
    assert components.connected_groups(none, "src", "dst", spark.range(2).withColumnRenamed("id", "node_id")).count() == 2
    one = components.connected_groups(spark.createDataFrame([(4, 2)], "src bigint, dst bigint"), "src", "dst")
    assert {tuple(x) for x in components.group_sizes(one).collect()} == {(2, 2)}


SAME = [
    ("café", "café"), ("Ｗｅ met", "We met"), ("to​gether", "together"), ("soft­hyphen", "softhyphen"), ("no break", "no break"),
    ("　", " "), ("раураl", "paypal"), ("ΑΒΕ", "ABE"), ("ⅿaⅰⅼ", "mail"), ("ⅻ", "xii"), ("ё", "ë"), ("е́", "é"), ("ｶﾞ", "ガ"), ("﻿x", "x"), ("𠀀a⁠", "𠀀a"),
    ("a‍́", "á"), ("ﬁne", "fine"), ("ø", "o​̸"), ("", "‎"),
]
SAME += [("ραυl", "paul"), ("ᎪᏢ ꓐꓳ Ⲟ", "AP BO O"), ("𝐀𝑏𝟗", "Ab9"), ("ℓ", "l"), ("ǆ", "dž"), ("ĳ", "ij"), ("wait…", "wait..."), ("‼", "!!"), ("co‑op", "co-op"), ("іij", "iĳ"), ("ⅰii", "ⅲ")]
OTHER = [("résumé", "resume"), ("Node", "node"), ("patterns", "pattems"), ("1", "①"), ("m2", "m²"), ("l", "1"), ("O", "0"), ("a b", "a  b"), ("a。", "a."), ("ß", "β"), ("a\nb", "a b"), ("й", "и"), ("ä", "a")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_looks(a, b):
    assert lookalike.canonical(a, RULES) == lookalike.canonical(b, RULES)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other_looks(a, b):
    assert lookalike.canonical(a, RULES) != lookalike.canonical(b, RULES)


@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("аеoοｅ́‍̸ⅰⅱ")), max_size=40))
@settings(max_examples=300, deadline=None)
def test_canonical_is_stable(t):
    once = lookalike.canonical(t, RULES)
    assert lookalike.canonical(once, RULES) == once


def test_representatives_follow_the_corpus():
    assert lookalike.representatives({"а": 5, "a": 3})["a"] == "а"
    assert lookalike.representatives({"а": 3, "a": 5})["а"] == "a"
    assert lookalike.representatives({"​": 10**9})["​"] == ""


def test_pairs_and_classes(spark):
    texts = ["café au lait", "café au lait", "сafé au lait", "café au lait", "cafe au lait", None, "", "​", "x" * 200_000, "x" * 199_999 + "х", "lone"]
    df = spark.createDataFrame([*enumerate(texts), (None, "café au lait"), (0, texts[0])], "doc_id bigint, text string").withColumn("canonical", F.lit(1))
    looks = {i: lookalike.canonical(t, RULES) for i, t in enumerate(texts) if t is not None}
    want = {(i, j) for i in looks for j in looks if i < j and looks[i] == looks[j] and texts[i] != texts[j]}
    got = [tuple(x) for x in lookalike.look_alike_pairs(df).collect()]
    assert len(got) == len(want) and set(got) == want
    assert (0, 3) not in want and (6, 7) in want and (8, 9) in want
    cls = {r["doc_id"]: (r["class_id"], r["n_spellings"]) for r in lookalike.look_classes(df).collect()}
    assert cls[3] == (0, 3) and cls[10] == (10, 1) and 5 not in cls
    links = {r["doc_id"]: r["n_links"] for r in lookalike.look_classes(df).collect()}
    assert links == {i: sum(i in p for p in want) for i in looks}
    for block in (1, 2):
        assert {tuple(x) for x in lookalike.look_alike_pairs(df, block=block).collect()} == want
    assert lookalike.look_alike_pairs(df.limit(0)).count() == 0


def _item(r, vocabulary, n):
    return " ".join(r.choice(vocabulary) for _ in range(n))


def test_words_of_dressed_text():
    plain = leakage.words_of("The quiet baker's café sells 12 rolls", RULES)
    assert plain == ["the", "quiet", "baker", "s", "café", "sells", "12", "rolls"]
    for t in ("<p>THE quiet<br/>baker&#39;s caf&eacute;</p> [b]sells[/b] 12&nbsp;rolls", "> Ｔhe qu­iet\n> baker’s café [quote=x y]sells “12” rolls", "&lt;i&gt;the&lt;/i&gt; quiet bаker's café sells, 12 rolls!"):
        assert leakage.words_of(t, RULES) == plain
    assert leakage.words_of(None, RULES) == [] and leakage.words_of("", RULES) == []
    assert leakage.words_of("STRASSE", RULES) == leakage.words_of("Straße", RULES)


def test_brackets_that_are_no_markup():
    for t in ("if a <b and then many words follow here until c > d", "[figure] if a <b and then many words follow here until c > d [see above]", "1 <2 or 3> 2", "a<b>c</b>"):
        got = leakage.words_of(t, RULES)
        assert got == [w for w in "".join(c if c.isalnum() else " " for c in t.replace("<b>", " ").replace("</b>", " ")).split()]
    for t in ("<B CLASS='x'>a", "<x-note data-k=1 />a", "[URL=http://x.example/a?b=c]a[/URL]", "[quote author=x date=12]a[/quote]", "<!-- b > c -->a", "<br/>a<hr>", "<input disabled>a", "[*]a", "<td nowrap colspan=2>a"):
        assert leakage.words_of(t, RULES) == ["a"], t


@pytest.mark.parametrize("seed", range(4))
def test_search_loses_no_run(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["the", "a"] * 20
    items = [(i, leakage.words_of(_item(r, vocabulary, r.randrange(5, 60)), RULES)) for i in range(120)]
    index = leakage.Index(items)
    runs = {}
    for i, w in items:
        for k in range(len(w) - 12):
            runs.setdefault(tuple(w[k : k + 13]), set()).add(i)
    for _ in range(60):
        w = [r.choice(vocabulary) for _ in range(r.randrange(0, 150))]
        _, src = r.choice(items)
        at = r.randrange(len(src))
        w[len(w) // 2 : len(w) // 2] = src[at : at + r.choice([12, 13, 20])]
        want = {i for k in range(len(w) - 12) for i in runs.get(tuple(w[k : k + 13]), ())}
        assert set(index.leaks(w)) == want
        # the block-max search finds every item whose whole score reaches the threshold
        terms = {index.vocabulary[x] for x in w if x in index.vocabulary}
        score = {}
        for t in terms:
            for n, s in zip(index.docs[t], index.weights[t]):
                score[n] = score.get(n, 0) + s
        assert {n for n, s in score.items() if s >= 1 + 1e-9} <= set(index.search(terms)) <= {n for n, s in score.items() if s >= 1 - 1e-9}


def test_leaked_table(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = [(1, f"x {item} y"), (2, "<p>TWO three four, five six seven eight nine ten eleven twelve thirteen fourteen</p>"), (3, "two three four five six seven eight nine ten eleven twelve thirteen"), (4, None), (5, ""), (1, f"x {item} y"), (None, item), (6, "pad " * 50_000 + item)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(0))
    i = spark.createDataFrame([(7, item), (7, item), (8, "too short"), (9, None), (None, item)], "item_id bigint, text string")
    want = {(1, 7), (2, 7), (6, 7)}
    for most in (20_000, 1):
        got = [tuple(x)[:2] for x in leakage.leaked(d, i, max_items=most).collect()]
        assert len(got) == 3 and set(got) == want
    assert leakage.leaked(d.limit(0), i).count() == 0 and leakage.leaked(d, i.limit(0)).count() == 0


def test_many_items_read_the_documents_once(spark):
    """60,000 items in three indexes: the texts are read into words once, and nothing is lost."""
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = [_item(r, vocabulary, 16) for _ in range(60_000)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(len(b))
            yield b

    want = {(n, 997 * n) for n in range(1, 60)}
    docs = [(n, f"{_item(r, vocabulary, 30)} <i>{' '.join(texts[i].split()[1:15])}</i> {_item(r, vocabulary, 30)}") for n, i in sorted(want)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").mapInPandas(counted, "doc_id bigint, text string")
    got = leakage.leaked(df, items)
    assert {tuple(x)[:2] for x in got.collect()} == want and reads.value == len(docs)


@given(st.dictionaries(st.integers(1, 64), st.integers(0, 40), max_size=30))
@settings(max_examples=200, deadline=None)
def test_plan_places_everything_once(counts):
    segments, bins = packing.plan(counts, 64)
    load, larges, ranks = {}, {}, {}
    for size, rank, n, start in segments:
        assert n > 0
        for k in range(n):
            load[start + k] = load.get(start + k, 0) + size
            larges[start + k] = larges.get(start + k, 0) + (3 * size > 64)
        ranks.setdefault(size, []).append((rank, n))
    assert set(load) == set(range(bins)) and all(v <= 64 for v in load.values()) and all(v <= 2 for v in larges.values())
    for size, n in counts.items():
        at = 0
        for rank, k in sorted(ranks.get(size, [])):
            assert rank == at
            at += k
        assert at == n
    total = sum(s * n for s, n in counts.items())
    assert bins <= max(1, 2 * -(-total // 64))


def test_pack_table(spark):
    r = random.Random(1)
    rows = [(i, r.choice([5, 7, 11, 100, 40, 34, 0])) for i in range(400)] + [(1000, None), (1001, 250), (1001, 250), (1002, 200)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint").withColumn("bin_id", F.lit(1))
    out = packing.pack(df, 100).collect()
    by_doc = {}
    load = {}
    for x in out:
        by_doc.setdefault(x["doc_id"], []).append((x["piece_no"], x["token_start"], x["n_tokens"]))
        assert (x["bin_id"] is None) == (x["n_tokens"] == 0)
        if x["bin_id"] is not None:
            load[x["bin_id"]] = load.get(x["bin_id"], 0) + x["n_tokens"]
    assert sorted(by_doc[1001]) == sorted([(1, 0, 100), (2, 100, 100), (3, 200, 50)] * 2) and sorted(by_doc[1002]) == [(1, 0, 100), (2, 100, 100)]
    assert all(len(v) == 1 for k, v in by_doc.items() if k < 1001) and len(by_doc) == 403
    assert max(load.values()) <= 100 and set(load) == set(range(1, len(load) + 1))
    assert sum(load.values()) == sum(n or 0 for _, n in rows) and len(load) <= sum(load.values()) / 100 * 1.03 + 1
    assert packing.pack(df.limit(0), 100).count() == 0


def test_pack_into_large_containers(spark):
    """Capacities beyond 2^19 are as good as small ones."""
    capacity = 1 << 30
    rows = [(i, (i * 7_919_317 * 131) % capacity + 1) for i in range(500)] + [(1000, 3 * capacity + 5)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint"), capacity).collect()
    load = {}
    for x in out:
        load[x["bin_id"]] = load.get(x["bin_id"], 0) + x["n_tokens"]
    assert max(load.values()) <= capacity and set(load) == set(range(1, len(load) + 1)) and sum(load.values()) == sum(n for _, n in rows)
    assert len(load) <= sum(load.values()) / capacity * 1.05 + 1


def test_tokens_of_whole_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello world"), (4, "測定 node " * 5000)], "doc_id bigint, text string")
    got = dict(map(tuple, packing.token_counts(df).collect()))
    enc = packing._encoding(packing.TOKENIZER)
    for i, t in ((3, "hello world"), (4, "測定 node " * 5000)):
        ids = enc.encode_ordinary(t)
        assert enc.decode(ids) == t and got[i] == len(ids)
    assert got[1] == got[2] == 0
