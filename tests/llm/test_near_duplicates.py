"""MinHash near-dedup and edit-distance fingerprints against brute force."""

import random
import re
import time

import numpy as np
import pyarrow as pa

from diskloom.llm import fingerprints, graph, minhash

SCHEMA = "doc_id long, text string, `row` int, digest string, `ROW_` int, root string, sketch int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "d", 2, "r", 3) for i, t in rows], SCHEMA)


def words(r, n):
    return [("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9)))) for _ in range(n)]


def corpus(r):
    """Groups of edited copies, documents that share passages, and unrelated ones."""
    rows, shared = [], words(r, 60)
    for _ in range(25):
        base = words(r, r.randrange(40, 300))
        rows.append(base)
        for _ in range(r.randrange(0, 6)):
            copy = list(base)
            for _ in range(max(1, int(len(copy) * r.choice([0.005, 0.02, 0.05])))):
                copy[r.randrange(len(copy))] = words(r, 1)[0]
            rows.append(copy)
    rows += [words(r, 80) + shared + words(r, 80) for _ in range(20)] + [words(r, 100) for _ in range(20)]
    r.shuffle(rows)
    return [(k, " ".join(w)) for k, w in enumerate(rows)]


def groups(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return {x: find(x) for x in root}


def shingles(text):
    w = re.findall(r"\w+", text.lower())
    return {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))}


def test_minhash_recall_and_precision(spark):
    rows = corpus(random.Random(7))
    sets = {i: shingles(t) for i, t in rows}
    jaccard = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    want = [p for p, j in jaccard.items() if j >= minhash.THRESHOLD]
    got = {r.doc_id: r.duplicate_of for r in minhash.near_duplicates(table(spark, rows)).collect()}
    found = lambda x: got.get(x, x)
    assert sum(found(a) == found(b) for a, b in want) / len(want) >= 0.9
    near = groups([p for p, j in jaccard.items() if j >= minhash.THRESHOLD - 0.15])
    assert all(near.get(a) == near.get(b) for a, b in got.items())
    assert all(b < a for a, b in got.items())


def test_a_region_cut_between_partitions_is_one(spark):
    """With one order and a region over many partitions, links cross every cut."""
    import numpy as np

    n = 400
    sketch = bytes(range(128))
    reps = spark.createDataFrame([(k, [1], [k], bytearray(sketch)) for k in range(n)], "row long, region array<long>, rest array<long>, sketch binary")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for parts in (1, 7, 40):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            pairs = [(r.a, r.b) for r in minhash.forest_edges(reps).collect()]
            assert len(set(groups(pairs).values())) == 1 and len(groups(pairs)) == n
            # two halves that differ stay apart, wherever the cuts are
            other = np.frombuffer(sketch, np.uint8)[::-1].tobytes()
            two = spark.createDataFrame([(k, [1], [k], bytearray(sketch if k < n // 2 else other)) for k in range(n)], reps.schema)
            found = groups([(r.a, r.b) for r in minhash.forest_edges(two).collect()])
            assert len(set(found.values())) == 2 and len(found) == n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])


def test_minhash_edges(spark):
    long = " ".join(words(random.Random(1), 40000))
    rows = [(5, "a b c d e f g"), (3, "A b, c d e F g!"), (None, "a b c d e f g"), (9, None), (10, None), (11, ""), (12, "  "), (13, "###"), (14, "###"), (14, "###"), (15, long), (16, long + " z"), (17, "x"), (18, "x y")]
    docs = table(spark, rows)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.duplicate_of) for r in minhash.near_duplicates(docs).collect())
    assert got == [(False, 5, 3), (False, 14, 13), (False, 14, 13), (False, 16, 15), (True, 0, 3)]
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [3, 9, 10, 11, 12, 13, 15, 17, 18]))
    assert minhash.near_duplicates(docs.limit(0)).count() == 0 and minhash.deduplicated(docs.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    r = random.Random(2)
    a = words(r, 400)
    b = a[:300] + words(r, 100)
    x, y = " ".join(a), " ".join(b)
    values = minhash.signatures(pa.array([x, y]))[1]
    true = len(shingles(x) & shingles(y)) / len(shingles(x) | shingles(y))
    assert abs((values[0] == values[1]).mean() - true) < 0.15


def test_a_large_region_is_linked_in_leaves():
    n, r = 3000, np.random.default_rng(0)
    base = r.integers(0, 256, 128).astype(np.uint8)
    sketches = np.where(r.random((n, 128)) < 0.05, r.integers(0, 256, (n, 128)), base).astype(np.uint8)
    keys = [np.sort(r.integers(0, 40, n)), np.zeros(n, np.int64)]
    a, b = graph.link(keys, sketches, np.arange(n), np.array([0]), 80)
    assert len(set(groups(zip(a.tolist(), b.tolist())).values())) == 1 and len(a) < 3 * n


def test_components(spark):
    r = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 160)] + [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(5, 5)]
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups([e for e in edges if e[0] != e[1]])
    for root in set(want.values()):
        own = [x for x in want if want[x] == root]
        assert {got[x] for x in own} == {min(own)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def naive(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(r, t, n):
    out = list(t)
    for _ in range(n):
        out = out or ["a"]
        k, c = r.randrange(len(out)), r.choice("abcdefgh ")
        way = r.random()
        if way < 0.33:
            out.insert(k, c)
        elif way < 0.66:
            out[k] = c
        else:
            del out[k]
    return "".join(out)


def test_edit_distance():
    r = random.Random(2)
    for _ in range(800):
        a = "".join(r.choice("abc") for _ in range(r.randrange(30)))
        b = edited(r, a or "a", r.randrange(6)) if r.random() < 0.7 else "".join(r.choice("abc") for _ in range(r.randrange(30)))
        most = r.randrange(8)
        assert fingerprints.counted(a, b, most) == min(naive(a, b), most + 1)


def test_fingerprint_recall_and_precision(spark):
    r = random.Random(9)
    rows = []
    for _ in range(40):
        base = " ".join(words(r, r.randrange(20, 150)))
        rows.append(base)
        rows += [edited(r, base, r.randrange(1, 1 + len(base) // fingerprints.PART)) for _ in range(r.randrange(3))]
    rows += [" ".join(words(r, 60)) for _ in range(20)]
    rows = list(enumerate(rows))
    got = {x.doc_id: x.group_id for x in fingerprints.fingerprints(table(spark, rows)).collect()}
    pairs = [(a, b) for a, x in rows for b, y in rows if a < b and fingerprints.near(x, y)]
    hits = sum(got[a] is not None and got[a] == got[b] for a, b in pairs)
    assert pairs and hits / len(pairs) >= 0.9
    want = groups(pairs)
    assert all(g is None or d == g or want.get(d) == want.get(g) for d, g in got.items())


def test_fingerprint_edges(spark):
    long = "lorem ipsum dolor " * 8000
    rows = [(1, "short"), (2, "short"), (None, "short"), (3, None), (4, ""), (5, ""), (6, "shorx"), (7, long), (8, long[:50000] + "x" + long[50001:]), (7, long), (9, "alone in the world, this text has no partner")]
    docs = table(spark, rows)
    got = [(x.doc_id, x.group_id, x.fingerprint) for x in fingerprints.fingerprints(docs).collect()]
    assert len(got) == len(rows)
    by = {d: g for d, g, _ in got}
    assert by == {1: 1, 2: 1, None: 1, 3: None, 4: 4, 5: 4, 6: None, 7: 7, 8: 7, 9: None}
    assert {d for d, _, f in got if f is None} == {1, 2, None, 3, 4, 5, 6}
    assert fingerprints.fingerprints(docs.limit(0)).count() == 0


def test_long_texts_are_near_by_their_length(spark):
    r = random.Random(21)
    rows = []
    for _ in range(12):
        base = " ".join(words(r, r.randrange(400, 1500)))
        rows += [base, edited(r, base, int(len(base) * r.choice([0.015, 0.025, 0.035])))]
    got = {x.doc_id: x.group_id for x in fingerprints.fingerprints(table(spark, list(enumerate(rows)))).collect()}
    assert all(fingerprints.near(rows[k], rows[k + 1]) for k in range(0, 24, 2))
    assert sum(got[k] == got[k + 1] == k for k in range(0, 24, 2)) >= 11
    assert all(got[k] in (None, k - k % 2) for k in got)


def test_bounds_and_bands_of_the_edit_distance():
    r = random.Random(5)
    cases = []
    for k in range(600):
        size = 700 if k % 20 == 0 else 90
        a = "".join(r.choice("abc" if k % 3 else "abcdefghijkl ") for _ in range(r.randrange(1, size)))
        b = edited(r, a, r.randrange(60)) if k % 2 else "".join(r.choice("abcd") for _ in range(r.randrange(size)))
        most, true = r.randrange(80), naive(a, b)
        assert fingerprints.counted(a, b, most) == min(true, most + 1)
        x, y = fingerprints.profiles(pa.array([a, b])).astype(int)
        assert abs(x - y).sum() <= 6 * true
        assert fingerprints.near(a, b) == (true <= max(len(a), len(b)) // fingerprints.PART)
        cases.append((*sorted((a, b), key=len), true))
    for wide in (1, 2, 3, 4):  # all pairs at once give the same
        own = [(a, b, t) for a, b, t in cases if len(b) - len(a) < 32 * wide]
        most = np.array([r.choice([t - 1, t, r.randrange(32 * wide)]) if 0 < t < 32 * wide else r.randrange(32 * wide) for _, _, t in own])
        texts = [fingerprints._points(t) for a, b, _ in own for t in (a, b)]
        got = fingerprints._batch(texts, np.arange(len(own)) * 2, np.arange(len(own)) * 2 + 1, most, wide)
        assert got.tolist() == [t <= m for (_, _, t), m in zip(own, most.tolist())]
    base = "".join(r.choice("abcdef ") for _ in range(400))
    texts = [edited(r, base, r.randrange(20)) for _ in range(30)]
    a, b = np.triu_indices(30, 1)
    assert fingerprints.near_pairs(texts, b, a).tolist() == [naive(texts[x], texts[y]) <= max(len(texts[x]), len(texts[y])) // 25 for x, y in zip(a, b)]


def test_all_pairs_of_a_templated_bucket_are_verified(spark):
    r = random.Random(31)
    head = " ".join(words(r, 400))[:1850]
    rows = []
    for _ in range(70):
        base = head + " ".join(words(r, 60))[:250]  # the walks' samples end before the passage
        rows += [base, base[:1900] + edited(r, base[1900:], 5)]
    order = list(range(len(rows)))
    r.shuffle(order)
    got = {x.doc_id: x.group_id for x in fingerprints.fingerprints(table(spark, [(k, rows[k]) for k in order])).collect()}
    assert not fingerprints.near(rows[0], rows[2])
    assert all(got[k] == got[k + 1] == k for k in range(0, len(rows), 2))


def test_far_pairs_leave_before_their_end(monkeypatch):
    r = random.Random(41)
    draw = lambda n: "".join(r.choice("etaoin shrdlu") for _ in range(n))
    took = []
    a = draw(5000)
    for texts in ([edited(r, a, 90) for _ in range(25)], [draw(5000) for _ in range(25)]):
        x, y = np.triu_indices(25, 1)
        began = time.process_time()
        assert fingerprints.near_pairs(texts, x, y).all() == (not took)
        took.append(time.process_time() - began)
    assert took[1] < 0.5 * took[0]
    base = draw(1500)
    texts = [edited(r, base, r.randrange(10, 70)) for _ in range(40)] + [draw(1500) for _ in range(5)]
    x, y = (k for k in np.triu_indices(45, 1))
    want = [fingerprints.counted(texts[i], texts[j], 400) <= max(len(texts[i]), len(texts[j])) // 25 for i, j in zip(x, y)]
    assert 20 < sum(want) < len(want) - 20
    for look in (8, 96, 1 << 30):
        monkeypatch.setattr(fingerprints, "LOOK", look)
        assert fingerprints.near_pairs(texts, x, y).tolist() == want


def test_followed_never_takes_more_than_the_distance_allows():
    r = random.Random(43)
    hits = 0
    for k in range(300):
        a = "".join(r.choice("abc" if k % 2 else "etaoin shrdlu") for _ in range(r.randrange(1, 500)))
        b = edited(r, a, r.randrange(20)) if k % 5 else "".join(r.choice("abc") for _ in range(r.randrange(500)))
        true, most = naive(a, b), r.randrange(40)
        shown = fingerprints.followed(a, b, most)
        assert not shown or true <= most
        hits += shown
    assert hits > 60


def test_keys_and_sketches_are_gone_before_texts_are_moved(spark, monkeypatch):
    live, seen = {}, []
    store, drop, check = fingerprints.written, fingerprints.forget, fingerprints.verified

    def written(df):
        out = store(df)
        live[id(out)] = out
        return out

    def forget(*tables):
        for t in tables:
            live.pop(id(t), None)
        drop(*tables)

    def verified(*args):
        seen.extend(set(t.columns) for t in live.values())
        return check(*args)

    for name, f in (("written", written), ("forget", forget), ("verified", verified)):
        monkeypatch.setattr(fingerprints, name, f)
    base = " ".join(words(random.Random(3), 60))
    got = fingerprints.fingerprints(table(spark, [(1, base), (2, base[:50] + "x" + base[51:]), (3, base), (4, "else")])).collect()
    assert {x.doc_id: x.group_id for x in got} == {1: 1, 2: 1, 3: 1, 4: None}
    assert seen and not any(c & {"keys", "sketches"} for c in seen)
