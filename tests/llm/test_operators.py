"""Operators against plain-Python versions, with nulls, empty and long texts,
ties, repeated rows, empty tables and clashing column names."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.llm import decontaminate as D
from evidentia.llm import exact_dedup as X
from evidentia.llm import jaccard_join as J
from evidentia.llm import language_model as LM
from evidentia.llm import line_dedup as L
from evidentia.llm import mixing as M
from evidentia.llm import quality as Q
from evidentia.llm import substring_dedup as S
from evidentia.llm import token_rollup as T
from evidentia.llm import url_filter as U
from evidentia.llm.bloom import bloom
from evidentia.llm.components import components
from tests.llm import brute as B

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, hash string, copy string"


def frame(spark, rows):
    """(doc_id, text) or (doc_id, text, source) rows with extra columns whose
    names operators use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, "x", None, "y") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def corpus(seed=3, n=120):
    """Texts with copies, edits, shared passages, runs, long and empty texts."""
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)] + ["the", "of", "The", "É", "Straße", "k\u212a"] * 20
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage = text(60)
    rows = []
    for i in range(n):
        kind = i % 8
        if kind in (0, 1) or i < 12:
            t = text(rng.randint(1, 80))
        elif kind == 2:
            t = rows[rng.randrange(len(rows))][1]
        elif kind in (3, 4):
            w = rows[rng.randrange(len(rows))][1].split(" ")
            for _ in range(max(1, len(w) // 40)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            t = " ".join(w)
        elif kind == 5:
            t = text(rng.randint(0, 30)) + "\n" + passage + "\t" + text(rng.randint(0, 30))
        elif kind == 6:
            t = " ".join([rng.choice(vocab)] * rng.randint(1, 40)) + "\n\n" + text(20)
        else:
            t = rows[rng.randrange(len(rows))][1] + " " + text(3)
        rows.append((i, t))
    return rows + [(n, ""), (n + 1, None), (n + 2, " \n\t "), (n + 3, "one two"), (n + 4, "One  TWO"),
                   (n + 5, "a b c d e f g h i j k l m " * 3000)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_similar_classes(spark, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.similar_classes(frame(spark, rows), slots=1 << 16).collect()}
    assert got == B.similar(rows)
    kept = {r.doc_id for r in J.near_dedup(frame(spark, rows[:60]), slots=1 << 16).select("doc_id").collect()}
    assert kept == {c for _, c in B.similar(rows[:60]).values()}


def test_similar_classes_many_rounds(spark):
    """Chains and one crowded region: more members than pivots, several rounds."""
    rng = random.Random(5)
    base = ["b%d" % i for i in range(100)]
    rows = []
    for i in range(60):
        w = list(base)
        for j in rng.sample(range(100), rng.randint(0, 6)):
            w[j] = "x%d" % rng.randrange(10 ** 6)
        rows.append((i, " ".join(w)))
    chain = ["c%d" % i for i in range(200)]
    rows += [(100 + i, " ".join(chain[i * 3:i * 3 + 100])) for i in range(30)]
    got = {r.doc_id: r.component_id for r in J.similar_classes(frame(spark, rows), pivots=2, leaf=8, slots=1 << 16).collect()}
    assert got == {i: c for i, (_, c) in B.similar(rows).items()}


def test_near_copies_of_too_many_own_shingles_never_meet(spark, monkeypatch):
    """More than a fifth of each text's shingles is its own, of words that are
    common: no two are similar, so hardly any are compared."""
    rng = random.Random(7)
    rows = []
    for i in range(40):
        w = ["b%d" % j for j in range(200)]
        for j in range(10):
            at = 20 * j + rng.randrange(5, 14)
            w[at:at + 2] = ["y%d" % rng.randrange(20), "y%d" % rng.randrange(20)]
        rows.append((i, " ".join(w)))
    met, compare = [], J._compare

    def counted(pairs, *rest):
        met.append(pairs.count())
        return compare(pairs, *rest)
    monkeypatch.setattr(J, "_compare", counted)
    got = {r.doc_id: r.component_id for r in J.similar_classes(frame(spark, rows), slots=1 << 16).collect()}
    assert got == {i: c for i, (_, c) in B.similar(rows).items()}
    assert sum(met) < 40


def test_own_counts(spark):
    """Also a set that came twice, and one of another text in part."""
    sets = spark.createDataFrame([(1, [5, 6, 7]), (1, [5, 6, 7]), (2, [7, 8]), (3, [9 << 20])], "node long, keys array<long>")
    assert {r.node: r.own for r in J._own_counts(sets, 9).collect()} == {1: 2, 2: 1, 3: 1}


def test_parity_marks_never_differ_more_than_the_sets():
    import numpy as np
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 3000, n).astype(np.uint64) * np.uint64(0x9E3779B1)) for n in (0, 5, 300, 1500, 1500, 40)]
    ptr = np.cumsum([0] + [len(s) for s in sets])
    marks = J._parity(np.concatenate(sets), ptr).reshape(len(sets), J.MARKS)
    for a, x in zip(sets, marks):
        for b, y in zip(sets, marks):
            assert sum(bin(int(v) & (1 << 64) - 1).count("1") for v in x ^ y) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_similar_classes_null_id_repeated_rows_and_empty_table(spark):
    t = "q w e r t y u i o p"
    got = sorted(J.similar_classes(frame(spark, [(5, t), (5, t), (None, t), (2, t + " a"), (None, "other words")]),
                                   slots=1 << 16).select("doc_id", "component_id").collect(), key=str)
    assert [tuple(r) for r in got] == [(2, 2), (5, 2), (5, 2), (None, 2), (None, None)]
    assert J.similar_classes(frame(spark, []), slots=1 << 16).collect() == []


@pytest.fixture(scope="module")
def colliding():
    """Two words whose shingles in one context agree in 40 bits of their hash."""
    import numpy as np
    import pyarrow as pa
    from evidentia.llm.words import byte_tables, fold, words
    w = words(pa.array(["a b c d " + " ".join(f"w{i}" for i in range(8_000_000))]), byte_tables(True, True)).hash
    h = fold([np.full(len(w) - 4, x) for x in w[:4]] + [w[4:]], 5) >> np.uint64(8) & np.uint64((1 << 40) - 1)
    order = np.argsort(h)
    i = int(np.flatnonzero(h[order][1:] == h[order][:-1])[0])
    return f"w{order[i]}", f"w{order[i + 1]}"


def test_shingles_that_agree_in_40_bits_are_different(spark, colliding):
    """True similarity 4/6: neither linked by the join nor removed as a line."""
    x, y = colliding
    rows = [(1, f"p q r s a b c d {x}"), (2, f"p q r s a b c d {y}")]
    assert {r.component_id for r in J.similar_classes(frame(spark, rows), slots=1 << 16).collect()} == {1, 2}
    assert all(r.n_removed == 0 for r in L.line_dedup(frame(spark, rows), slots=1 << 16).collect())


def test_near_dedup_keeps_an_unrelated_text_of_a_dropped_id(spark):
    a = " ".join(f"w{i}" for i in range(60))
    rows = [(1, a), (2, a + " more"), (2, "something else altogether that is near to nothing here"), (3, a), (4, None), (2, None)]
    got = sorted(((r.doc_id, r.text) for r in J.near_dedup(frame(spark, rows), slots=1 << 16).collect()), key=repr)
    assert got == sorted([(1, a), (2, rows[2][1]), (4, None), (2, None)], key=repr)


def test_join_drops_its_tables(spark, tmp_path):
    import os
    from evidentia.session import checkpoint_dir
    held = checkpoint_dir(spark).replace("file:", "")
    before = set(os.listdir(held))
    a = " ".join(f"w{i}" for i in range(60))
    rows = [(i, a + f" {i}") for i in range(30)] + [(50, "other words that are not near anything at all")]
    assert J.similar_classes(frame(spark, rows), slots=1 << 16, pivots=4).filter("component_id = 0").count() == 30
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(held)) - before if len(n) != 36}      # not Spark's own folder
    assert left == {"similar-classes"}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(7, 7), (100, 101), (101, 100)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


@pytest.mark.parametrize("hot", [S.HOT, 1, 3])
def test_repeated_spans(spark, rows, hot):
    """Also where all or some picks count as had by very many texts."""
    extra = rows + [(None, rows[0][1]), (3, rows[3][1]), (3, rows[5][1]), (None, None), ((1 << 63) - 1, "the last id")]
    got = sorted(map(tuple, S.repeated_spans(frame(spark, extra), slots=1 << 16, hot=hot).collect()), key=str)
    assert got == sorted(B.repeated(extra), key=str)
    assert S.repeated_spans(frame(spark, []), slots=1 << 16).collect() == []


def test_line_dedup(spark, rows):
    got = sorted(map(tuple, L.line_dedup(frame(spark, rows), slots=1 << 16).collect()))
    assert got == sorted(B.later_lines(rows))
    assert L.line_dedup(frame(spark, []), slots=1 << 16).collect() == []
    twice = L.line_dedup(frame(spark, [(1, "a b\nc"), (1, "a b\nc"), (None, "c"), (None, None)]), slots=1 << 16, keep_text=True)
    assert sorted(((r.doc_id, r.n_lines, r.n_removed) for r in twice.collect()), key=str) == [
        (1, 2, 0), (1, 2, 0), (None, 0, 0), (None, 1, 1)]


def test_benchmark_hits(spark, rows):
    p = next(t for _, t in rows if t and "\n" in t and len(t.split()) > 70)
    items = [("i1", " ".join(p.split()[5:40])), ("i2", "One two"), ("i3", None), ("i4", ""), ("i5", "zzz nowhere"),
             (None, "three"), ("i2", "of The")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    some = rows[:60] + rows[-6:-1] + [(None, "one two."), (4, "one two"), (4, "ONE two, one")]
    got = D.benchmark_hits(frame(spark, some), bench).collect()
    want = B.hits(some, [x for x in items if x[0] is not None or x[1] != "three"])
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.hit_items or []) for r in got), key=str) == sorted(want, key=str)
    assert D.benchmark_hits(frame(spark, some[:3]), bench.limit(0)).filter("n_hit > 0").count() == 0
    assert D.benchmark_hits(frame(spark, []), bench).collect() == []
    kept = D.decontaminate(frame(spark, [(1, "one two"), (2, "clean text"), (None, "one two"), (3, None)]), bench)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 3] and kept.columns == SCHEMA_COLUMNS


def test_benchmark_hits_capital_sigma(spark):
    """A letter whose full lower case depends on what follows the word (final sigma)."""
    bench = spark.createDataFrame([("i1", "ΟΔΟΣ Next One"), ("i2", "ΟΔΟΣ")], "item_id string, text string")
    some = [(1, "a ΟΔΟΣ.Next one b"), (2, "ΟΔΟΣ's"), (3, "οδος.next one")]
    got = {r.doc_id: (r.n_hit, r.hit_items) for r in D.benchmark_hits(frame(spark, some), bench).collect()}
    assert got == {1: (3, ["i1", "i2"]), 2: (1, ["i2"]), 3: (0, None)}


SCHEMA_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def test_exact_groups(spark):
    rows = [(3, "a  b"), (1, "a\tb"), (2, "A b"), (None, "a b"), (4, None), (5, ""), (6, " "), (2, "A b")]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in X.exact_groups(frame(spark, rows)).collect()), key=str)
    assert got == [(1, 1, 3, True), (2, 2, 2, True), (2, 2, 2, True), (3, 1, 3, False), (4, 4, 2, True), (5, 4, 2, False),
                   (6, 6, 1, True), (None, 1, 3, False)]
    assert X.exact_groups(frame(spark, [])).collect() == []
    kept = X.exact_dedup(frame(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 2, 4, 6] and kept.columns == SCHEMA_COLUMNS


def test_url_filter(spark):
    urls = [(1, "http://a.example.org/es/x"), (2, "HTTPS://EXAMPLE.org/en/12?q"), (3, "http://b.org"), (4, "x://y.net/p/#f"),
            (5, None), (6, "no scheme"), (7, "http://com/fr/"), (8, "http://notcom.net/de/"), (9, "http://y.net/p?a"), (9, "ftp://z.com/de/q")]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("key", F.lit("clash")).withColumn("word", F.lit(1))
    listed = spark.createDataFrame([("y.net/p",), (None,), ("y.net/p",), ("other",)], "key string")
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "com", "/de/"), ("allow", "com", "/fr/")]
    got = sorted(tuple(r) for r in U.url_filter(pages, listed, rules).collect())
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in got] == [
        (1, "a.example.org", "/es/x", "example.org/es/", "block"), (2, "example.org", "/en/12", "org/", "allow"),
        (3, "b.org", "", None, "allow"), (4, "y.net", "/p/", None, "block"), (5, "", "", None, "allow"),
        (6, "", "", None, "allow"), (7, "com", "/fr/", "com/fr/", "allow"), (8, "notcom.net", "/de/", None, "allow"),
        (9, "y.net", "/p", None, "block"), (9, "z.com", "/de/q", "com/de/", "block")]
    assert U.url_filter(pages, listed.limit(0), rules).filter("listed").count() == 0
    assert U.url_filter(pages.limit(0), listed, rules).collect() == []


def test_bloom_has_no_false_negatives_and_stays_bounded(spark):
    keys = spark.range(5000).select(F.concat(F.lit("host/"), F.col("id").cast("string")).alias("key"))
    pages = keys.select(F.monotonically_increasing_id().alias("page_id"), F.concat(F.lit("http://"), "key").alias("url"))
    assert U.url_filter(pages, keys, [], expected=100).filter("not listed").count() == 0
    assert bloom(keys, 16).count() <= 16


def test_mix_targets_follow_the_contract(spark):
    sizes = {"b": 10, "a": 500, "é": 40, "Z": 3, None: 7, "c": 0}
    t = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, source_rows long")
    got = {r.source: r.target for r in M.source_targets(t).collect()}
    assert got == pytest.approx(B.targets(sizes))


def test_mix_sources(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["x"] * rng.randint(0, 30)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(900)]
    rows += [(5, "p q", "a"), (5, "p q", "a"), (None, None, "b"), (None, "one", "zero"), (7, "", "empty")]
    df = frame(spark, rows)
    got = M.mix_sources(df, group_rows=32).collect()
    again = M.mix_sources(df.repartition(7), group_rows=32).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(B.SPACE_WORD.findall(t or ""))
    target = B.targets(sizes)
    for s in sizes:
        part = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(target[s]) for r in part)
        assert all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in part)
        assert abs(sum(r.taken for r in part) - target[s]) <= max(3, 0.02 * target[s])
        rate = target[s] / sizes[s] if sizes[s] else 0
        assert abs(sum(r.copies for r in part) - rate * len(part)) <= 3
    m = M.mixed(df, group_rows=32)
    assert m.columns == ["copy"] + [c for c in SCHEMA_COLUMNS if c != "copy"]
    assert m.count() == sum(r.copies for r in got)
    assert M.mix_sources(frame(spark, [])).collect() == [] and M.mixed(frame(spark, [])).collect() == []


def test_cube_flight_keeps_totals():
    rng = random.Random(1)
    sizes = [float(rng.randint(1, 500)) for _ in range(300)]
    probs = [0.37] * 300
    p = M.flight(sizes, probs, [rng.random() for _ in sizes])
    assert sum(0 < x < 1 for x in p) <= 2
    assert sum(p) == pytest.approx(111) and sum(a * b for a, b in zip(p, sizes)) == pytest.approx(0.37 * sum(sizes))
    q = M.land(sizes, p, [rng.random() for _ in sizes])
    assert set(q) <= {0.0, 1.0} and abs(sum(a * b for a, b in zip(q, sizes)) - 0.37 * sum(sizes)) < 5


def test_token_rollup(spark, tmp_path):
    docs = frame(spark, [(1, "a b", "s"), (2, "a b c", None), (3, None, "s"), (4, "x-y", "s")])
    counts = T.counted(docs)
    roll = T.TokenRollup(spark, str(tmp_path / "roll"))
    assert roll.totals().collect() == []
    assert roll.commit("1", T.inserts(counts)) and not roll.commit("1", T.inserts(counts))
    one = counts.filter("doc_id = 1")
    assert roll.commit("2", T.deletes(one))
    assert roll.commit("3", T.revisions(counts.filter("doc_id = 2"), T.counted(frame(spark, [(2, "a", "t")]))))
    assert roll.commit("4", T.inserts(counts.limit(0))) and not roll.commit("2", T.deletes(one))
    got = {(r.source, r.tokenizer): (r.docs, r.tokens) for r in roll.totals().collect()}
    assert got == {("s", "space-1"): (2, 1), ("s", "alnum-1"): (2, 2), ("t", "space-1"): (1, 1), ("t", "alnum-1"): (1, 1)}


def test_quality(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of"]) for _ in range(rng.randint(5, 60)))
    bad = lambda: " ".join([rng.choice(["SPAM!!", "BUY!!"])] * rng.randint(5, 60))
    rows = [(i, good() if i % 3 else bad()) for i in range(300)] + [(900, None), (901, ""), (None, "alpha"), (5, "alpha beta")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(150)] + [(None, 1), (777, 0), (3, None)],
                                   "doc_id long, quality int")
    docs = frame(spark, rows)
    got = Q.score(docs, Q.train(docs, labels, sample=120)).collect()
    assert len(got) == len(rows) and all(0.0 <= r.score <= 1.0 for r in got)
    fresh = [r for r in got if r.doc_id is not None and 150 <= r.doc_id < 300]
    assert all((r.score >= 0.7) == (r.doc_id % 3 > 0) for r in fresh)
    kept = Q.reject(docs, Q.train(docs, labels), 0.5)
    assert kept.columns == SCHEMA_COLUMNS and kept.filter("doc_id between 150 and 299 and doc_id % 3 = 0").count() == 0
    none = Q.train(docs, labels.limit(0))
    assert {r.score for r in Q.score(docs, none).collect()} == {0.5}
    assert Q.score(docs.limit(0), none).collect() == []


def test_language_model(spark):
    import collections
    import math
    import zlib

    rng = random.Random(6)
    rows = []
    for i in range(200):
        w = ["the"]
        for _ in range(rng.randint(0, 30)):
            w.append({"the": "cat%d" % rng.randrange(40)}.get(w[-1], "the" if rng.random() < 0.8 else "Sat%d" % rng.randrange(500)))
        rows.append((i, " ".join(w)))
    rows += [(300, None), (301, ""), (None, "the cat1"), (5, "the the"), (302, "never seen words")]
    got = LM.model_scores(frame(spark, rows), frequent=20).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    toks = [(i, [x.translate(B.LOWER) for x in B.SPACE_WORD.findall(t or "")] + ["\n"]) for i, t in rows]
    c = collections.Counter(x for i, w in toks if not held(i) for x in w)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(w), sum(c[x] > 0 for x in w), n,
                   round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for i, w in toks)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    fresh = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 200]
    assert sum(r.score for r in fresh) > sum(r.base_score for r in fresh)
    assert LM.model_scores(frame(spark, [])).collect() == []
    # pairs and words that are joined instead of sent change nothing
    key = lambda r: (str(r.doc_id), r.n_tokens, round(r.score, 6))
    few = LM.model_scores(frame(spark, rows), frequent=20, vocabulary=5, pairs_sent=0).collect()
    some = LM.model_scores(frame(spark, rows), vocabulary=5, pairs_sent=30).collect()
    assert sorted(map(key, few)) == sorted(map(key, some)) == sorted(map(
        key, LM.model_scores(frame(spark, rows), vocabulary=5).collect()))
    # nothing to learn from: uniform over the symbols, then over the words of a group
    alone = LM.model_scores(frame(spark, [(None, ""), (None, None)])).collect()
    assert [round(r.score, 9) for r in alone] == [round(-math.log10(1 + LM.GROUPS), 9)] * 2


def one_by_one(texts, asked, size, rounds, burn_in, seed):
    """Two levels of restaurants, every customer taken out and seated again
    alone in each round; log10 probability of each asked text, averaged in
    probability per token over the rounds after ``burn_in``."""
    import collections
    import math
    rng = random.Random(seed)
    customers = [(a, b) for t in texts for a, b in zip(["\n"] + t, t + ["\n"])]
    n = collections.Counter(customers)
    d = LM.discount(sum(c == 1 for c in n.values()), sum(c == 2 for c in n.values()))
    seats, rooms = collections.defaultdict(list), collections.Counter()
    total, top, top_tables = collections.Counter(a for a, _ in customers), collections.defaultdict(list), 0

    def top_discount():
        c = [sum(x) for x in top.values()]
        return LM.discount(c.count(1), c.count(2))

    def parent(b, d1):
        c, t = sum(top[b]), len(top[b])
        return (max(c - d1 * t, 0) + (1 + d1 * top_tables) / size) / (1 + sum(rooms.values()))

    def pick(tables, new, dd):
        x = rng.random() * (sum(tables) - dd * len(tables) + new)
        for k, c in enumerate(tables):
            x -= c - dd
            if x < 0:
                tables[k] += 1
                return False
        tables.append(1)
        return True

    def drop(tables):
        x = rng.random() * sum(tables)
        k = 0
        while x >= tables[k]:
            x -= tables[k]
            k += 1
        tables[k] -= 1
        if not tables[k]:
            del tables[k]
            return True
        return False

    sums = [[0.0] * (len(t) + 1) for t in asked]
    for turn in range(rounds):
        d1 = top_discount() if turn else 0.5
        for a, b in customers:
            if turn and drop(seats[a, b]):
                rooms[a] -= 1
                top_tables -= drop(top[b])
            if pick(seats[a, b], (1 + d * rooms[a]) * parent(b, d1), d):
                top_tables += pick(top[b], (1 + d1 * top_tables) / size, d1)
                rooms[a] += 1
        if turn >= burn_in:
            d1 = top_discount()
            for s, t in zip(sums, asked):
                for i, (a, b) in enumerate(zip(["\n"] + t, t + ["\n"])):
                    own = sum(seats[a, b]) - d * len(seats[a, b])
                    s[i] += (own + (1 + d * rooms[a]) * parent(b, d1)) / (1 + total[a])
    return [sum(math.log10(x / (rounds - burn_in)) for x in s) for s in sums]


def test_language_model_matches_seating_one_by_one(spark):
    import zlib
    rng = random.Random(4)
    rows, after = [], {k: [rng.randrange(30) for _ in range(4)] for k in range(30)}
    for i in range(150):
        at, t = rng.randrange(30), []
        for _ in range(rng.randint(1, 25)):
            t.append("w%d" % at)
            at = rng.choice(after[at]) if rng.random() < 0.8 else rng.randrange(30)
        rows.append((i, " ".join(t)))
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0}
    learn = [t.split() for i, t in rows if i not in held]
    asked = [(i, t.split()) for i, t in rows]
    size = len({w for t in learn for w in t}) + 1 + LM.GROUPS
    want = dict(zip((i for i, _ in asked), one_by_one(learn, [t for _, t in asked], size, 25, 5, 3)))
    got = {r.doc_id: r.score for r in LM.model_scores(frame(spark, rows), sweeps=12, burn_in=3).collect()}
    for part in (held, set(want) - held):
        a, b = sum(got[i] for i in part), sum(want[i] for i in part)
        assert abs(a - b) < 0.02 * abs(b), (a, b)
    assert all(abs(got[i] - want[i]) < 0.1 * abs(want[i]) + 0.3 for i in want)


def test_reseat_matches_one_by_one():
    """The drawn waits give as many tables as seating every customer."""
    import numpy as np
    rng = np.random.default_rng(0)
    c = np.full(400, 3000.0)
    a = np.full(400, 4.0)
    fast = LM.reseat(c, a, 0.3, rng).mean()
    t = np.ones(400)
    for i in range(1, 3000):
        t += rng.random(400) * (a + i - 0.3 * t) < a
    assert abs(fast - t.mean()) < 1.0
