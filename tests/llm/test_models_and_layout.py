"""Brown model, packing, sharding, SentencePiece and the pipeline."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from diskloom.llm import brown, packing, pieces, sharding


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, n int, `K` string")


TEXTS = ["The cat sat on the mat", "the dog sat on the log", "a cat saw a dog", "the cat saw the log", None, "", "?!", "the the the", "zebra"]


def random_pairs(r, words, selves, most=30):
    pairs = np.zeros((words + 2, words + 2))
    pairs[:words, :words] = r.integers(0, most, (words, words)) * (r.random((words, words)) < 0.4)
    pairs[:words, words], pairs[words, :words], pairs[words + 1, : words + 1] = r.integers(0, 9, words), r.integers(0, 9, words), r.integers(0, 9, words + 1)
    pairs[words, words] = 5
    pairs[np.arange(words), np.arange(words)] *= selves
    return pairs


def whole(pairs, classes):
    return brown.likelihood(brown.between(pairs, np.asarray(classes)))


@pytest.mark.parametrize("selves", [0, 1, 20])
def test_exchange_takes_the_best_class_of_each_word(selves):
    r = np.random.default_rng(selves)
    for _ in range(60):
        pairs = random_pairs(r, 12, selves)
        classes = np.append(np.append(np.arange(4), r.integers(0, 4, 8)), [4, 5])
        now = classes
        for _ in range(4):
            step = list(now)
            for w in range(12):
                value = [whole(pairs, [*step[:w], d, *step[w + 1 :]]) for d in range(4)]
                best = int(np.argmax(value))
                if value[best] > value[step[w]] + 1e-5:
                    step[w] = best
            nxt = brown.exchange(pairs, now, 12, 4)
            assert whole(pairs, nxt) >= whole(pairs, now) - 1e-6
            assert abs(whole(pairs, nxt) - whole(pairs, step)) < 1e-3
            now = nxt


@pytest.mark.parametrize("selves", [0, 1, 5])
def test_rest_words_take_their_best_class(selves):
    r = np.random.default_rng(selves)
    code = brown.Contexts(3)
    for _ in range(60):
        pairs = random_pairs(r, 9, selves, 6)
        pairs[9] = pairs[:, 9] = 0  # words 6, 7 and 8 are the rest
        classes = np.array([0, 1, 2, 0, 1, 2, 3, 3, 3, 3, 4])
        n = brown.between(pairs, classes)
        for w in (6, 7, 8):
            # contexts from single occurrences: any pairing of the left ones with the right ones will do
            left = [c for v in range(11) if v != w for c in [int(classes[v])] * int(pairs[v, w])] + [code.self_] * int(pairs[w, w])
            right = [c for v in range(9) if v != w for c in [int(classes[v])] * int(pairs[w, v])] + [code.self_] * int(pairs[w, w])
            size = max(len(left), len(right), 1)
            left += [code.end] * (size - len(left))
            right += [code.end] * (size - len(right))
            keys, count = np.unique([a << 8 | b for a, b in zip(left, right)], return_counts=True)
            got = int(brown.best_classes(np.zeros(len(keys), np.int64), keys, count.astype(float), n, 3)[0])
            value = [whole(pairs, [*classes[:w], d, *classes[w + 1 :]]) for d in range(3)]
            assert value[got] >= max(value) - 1e-6


def test_brown_scores_by_brute_force(spark):
    r = random.Random(8)
    vocabulary = ["w" + "abcdefghij"[k % 10] * (1 + k // 10) for k in range(60)]
    texts = TEXTS + [" ".join(r.choice(vocabulary[: r.choice([3, 10, 60])]) for _ in range(r.randrange(1, 40))) for _ in range(60)]
    docs = docs_of(spark, texts)
    tokens = {k: re.findall(r"\w+", (t or "").lower()) for k, t in enumerate(texts)}
    for seeds, most in ((4, 12), (100, 100), (4, 4)):
        full, n, kinds, many = brown.classified(docs.select("doc_id", "text"), seeds, most, 3, 5)
        rows = {x.doc_id: [b & 127 for b in x.codes] for x in full.collect()}
        classes, count, pairs = {}, {}, {}
        for k, ws in tokens.items():
            assert len(ws) == len(rows[k])
            for at, w in enumerate(ws):
                assert classes.setdefault(w, rows[k][at]) == rows[k][at] < many  # one class for each word, and one for every word
                count[w] = count.get(w, 0) + 1
                before = rows[k][at - 1] if at else "start"
                pairs[before, rows[k][at]] = pairs.get((before, rows[k][at]), 0) + 1
        of = lambda c: [w for w in classes if classes[w] == c]
        assert kinds.tolist() == [len(of(c)) for c in range(many)]
        total = sum(pairs.values())

        def p(a, b, w):
            row = {k[1]: v for k, v in pairs.items() if k[0] == a}
            base = (sum(v for k, v in pairs.items() if k[1] == b) + 1) / (total + many)
            return (row.get(b, 0) + len(row) * base) / (sum(row.values()) + len(row)) * count[w] / (sum(count[x] for x in of(b)) + len(of(b)))

        got = {x.doc_id: x for x in brown.perplexities(docs, seeds=seeds, most=most, classes=3, rounds=5).collect()}
        for k, ws in tokens.items():
            log = sum(math.log(p(classes[ws[at - 1]] if at else "start", classes[w], w)) for at, w in enumerate(ws))
            assert got[k].n_words == len(ws) and math.isclose(got[k].log_prob, log, abs_tol=1e-7)
            assert got[k].perplexity is None if not ws else math.isclose(got[k].perplexity, math.exp(-log / len(ws)))
        assert np.allclose(np.exp(brown.transitions(n, many)).sum(axis=1), 1.0)


def test_brown_classes_part_words_of_two_kinds(spark):
    r = random.Random(1)
    kinds = [["ab" + "x" * k for k in range(20)], ["cd" + "y" * k for k in range(20)]]  # words of two kinds take turns
    docs = docs_of(spark, [" ".join(r.choice(kinds[k % 2]) for k in range(200)) for _ in range(40)])
    for seeds, most in ((40, 40), (10, 20), (10, 10)):
        full = brown.classified(docs.select("doc_id", "text"), seeds, most, 2, 9)[0]
        for x in full.collect():
            own = [b & 127 for b in x.codes]
            assert len(set(own[::2])) == len(set(own[1::2])) == 1 and own[0] != own[1]


def test_brown_edges(spark):
    docs = docs_of(spark, [None, "", "x" * 50000, "one two " * 20000])
    rows = brown.perplexities(docs).collect()
    assert sorted(r.n_words for r in rows) == [0, 0, 1, 40000]
    assert brown.perplexities(docs.limit(0)).count() == 0
    twice = docs_of(spark, ["same words here"] * 3)
    assert len({round(r.log_prob, 9) for r in brown.perplexities(twice).collect()}) == 1
    clash = spark.createDataFrame([(None, "a b", 1, 2, b"x"), (3, "a b", 1, 2, b"y")], "doc_id long, text string, n_words int, `row` int, codes binary")
    assert [(r.doc_id, r.n_words) for r in brown.perplexities(clash).orderBy("doc_id").collect()] == [(None, 2), (3, 2)]
    # equal frequencies are ordered by hash: the order of rows and partitions changes nothing
    tied = docs_of(spark, [f"w{k} v{k} u{k % 7}" for k in range(40)])
    one, two = ({r.doc_id: round(r.log_prob, 9) for r in brown.perplexities(d, seeds=5, most=9, classes=3).collect()} for d in (tied, tied.orderBy(F.desc("doc_id")).repartition(3)))
    assert one == two


def plain_fill(demands, limits):
    """The heuristic written out: every choice looks at every example."""
    pack, slot, number = {}, {}, 0
    rows = []
    for k, d in enumerate(demands):
        if any(x > m for x, m in zip(d, limits)):
            pack[k], slot[k], number = number, 0, number + 1
        else:
            rows.append(k)
    weight = [sum(demands[k][j] / limits[j] for k in rows) / max(1, len(rows)) for j in range(3)]
    rows.sort(key=lambda k: (*(-x for x in demands[k]), k))
    while rows:
        free, place = list(limits), 0
        while True:
            fit = [k for k in rows if all(x <= f for x, f in zip(demands[k], free))]
            if not fit:
                break
            best = max(fit, key=lambda k: (round(sum(weight[j] * demands[k][j] / limits[j] * free[j] / limits[j] for j in range(3)), 12), -rows.index(k)))
            pack[best], slot[best] = number, place
            free = [f - x for f, x in zip(free, demands[best])]
            rows.remove(best)
            place += 1
        number += 1
    return [pack[k] for k in range(len(demands))], [slot[k] for k in range(len(demands))]


def test_packing_by_brute_force():
    r = random.Random(3)
    limits = (100, 8, 70)
    for _ in range(30):
        demands = [(t := r.randrange(0, 120), r.randrange(1, 10), r.randrange(0, t + 1)) for _ in range(r.randrange(0, 40))]
        demands += demands[: r.randrange(5)]
        pack, slot, over = packing.fill(np.array(demands, dtype=np.int64).reshape(-1, 3), limits)
        assert (pack.tolist(), slot.tolist()) == plain_fill(demands, limits)
        for p in set(pack.tolist()):
            total = np.array(demands)[pack == p].sum(axis=0)
            assert (total <= limits).all() or (pack == p).sum() == 1 and over[pack == p].all()


def test_packing_conversations(spark):
    rows = [(1, 0, "user", "hello there", 5), (1, 1, "assistant", "general words " * 10, 5), (2, 0, None, None, 5), (None, 0, "user", "a", 5), (None, 0, "user", "b", 5), (3, 0, "assistant", "long text " * 9000, 5), (1, 1, "assistant", "general words " * 10, 5)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, `group` int")
    got = packing.pack_conversations(turns).collect()
    by = {}
    for r in got:
        by.setdefault(r.conv_id, []).append((r.segments, r.loss_tokens, r.oversize))
    assert by[1][0][0] == 3 and by[1][0][1] == 2 * len(packing.encoder().encode_ordinary("general words " * 10)) and by[2] == [(1, 0, False)] and len(by[None]) == 2 and by[3][0][2]
    assert packing.pack_conversations(turns.limit(0)).count() == 0
    docs = docs_of(spark, ["word " * k for k in range(60)] + [None, ""])
    packs = packing.pack_documents(docs, limits=(200, 4, 200)).collect()
    assert len(packs) == 62
    for p in {r.pack_id for r in packs}:
        own = [r for r in packs if r.pack_id == p]
        assert sum(r.tokens for r in own) <= 200 and len(own) <= 4 and sorted(r.slot for r in own) == list(range(len(own)))


def test_packs_do_not_depend_on_the_order_of_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 120)
    monkeypatch.setattr(packing, "SHARE", 16)
    r = random.Random(6)
    rows = [(None if k % 3 == 0 else k % 200, 7 if k % 3 == 0 else r.randrange(1, 60), 1 + k % 2, 3) for k in range(360)]
    examples = spark.createDataFrame(rows, "k long, tokens long, segments long, loss_tokens long")
    mixed = list(rows)
    r.shuffle(mixed)
    found = [sorted(map(str, packing.pack(df, "k", (200, 8, 200)).collect())) for df in (examples, examples.repartition(5), spark.createDataFrame(mixed, examples.schema).coalesce(1))]
    assert found[0] == found[1] == found[2] and len(found[0]) == 360
    packs = {}
    for x in packing.pack(examples, "k", (200, 8, 200)).collect():
        packs.setdefault(x.pack_id, []).append(x)
    assert len({p >> 32 for p in packs}) == 3  # several groups
    groups = {}
    for p, own in packs.items():
        assert sum(x.tokens for x in own) <= 200 and sum(x.segments for x in own) <= 8 and sorted(x.slot for x in own) == list(range(len(own)))
        groups.setdefault(p >> 32, []).extend(own)
    assert all(80 < len(own) < 170 for own in groups.values())  # a third of the rows are alike, and are spread
    for own in groups.values():  # each group is filled as the written-out heuristic fills it, but for who of equal demands goes where
        demands = [(x.tokens, x.segments, x.loss_tokens) for x in own]
        number, _ = plain_fill(demands, (200, 8, 200))
        want = sorted(sorted(d for d, m in zip(demands, number) if m == k) for k in set(number))
        got = sorted(sorted((x.tokens, x.segments, x.loss_tokens) for x in own if x.pack_id == p) for p in {x.pack_id for x in own})
        assert got == want


def test_sharding(spark):
    keys = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("shard"))
    rows = sharding.assign(keys).collect()
    share = sum(sharding.WEIGHTS.values())
    counts = {}
    for r in rows:
        counts[r.shard] = counts.get(r.shard, 0) + 1
        assert r.moved == (r.shard != r.shard_after) and (not r.moved or r.shard_after == 16)
    assert all(abs(counts[k] / 20000 - w / share) < 0.012 for k, w in sharding.WEIGHTS.items())
    moved = sum(r.moved for r in rows) / 20000
    assert abs(moved - 2 / (share + 2)) < 0.012
    odd = spark.createDataFrame([(None,), (None,), ("a",), ("a",), ("",)], "doc_id string")
    found = [(r.doc_id, r.shard) for r in sharding.assign(odd).collect()]
    assert len(set(found)) == 3 and sharding.assign(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("doc_id"), {0: 0.0})


def test_pieces_match_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    r = random.Random(1)
    texts = ["", " ", "  a", "a ", "▁a", "Hello  world\n\tæ“é 日本 🙂x  ", "a" * 5000, " " * 37 + "x" + " " * 16, "\x00b", "<s>x</s><0x41>", "ﬁ Å"]
    texts += ["".join(r.choice("ab tehon  éü\n日🙂_.,'") for _ in range(r.randrange(60))) for _ in range(1500)]
    texts += [open(pieces.__file__).read()]
    ids = pieces.encode(pa.array([*texts, None]))
    got = ids.to_pylist()
    assert got[-1] == [] and got[:-1] == [sp.encode(t) for t in texts]
    back = pieces.decode(ids).to_pylist()
    assert back[:-1] == [sp.decode(x) for x in got[:-1]]
    odd = [[1, 3 + 0xFF, 2], [3 + 0x41], None, []]
    assert pieces.decode(pa.array(odd, pa.list_(pa.int32()))).to_pylist() == ["�", "A", None, ""]


def test_suffixes_are_in_order_as_far_as_pieces_reach():
    r = np.random.default_rng(3)
    for depth in (3, 5, 16, 20, 37, 64):
        codes = r.integers(0, 3, 400)
        codes[100:200] = codes[:100]
        codes[300:] = 1
        order, packed = pieces.suffix_order(codes, depth)
        own = [tuple(codes[k : k + depth]) + (0,) * (depth - len(codes[k : k + depth])) for k in order.tolist()]
        assert sorted(order.tolist()) == list(range(400)) and own == sorted(own)
        assert len(packed) >= 400 + depth


def test_pieces_and_shards_of_long_null_and_clashing_rows(spark):
    long = "some words and no end " * 40_000
    rows = [(None, long, 1, "x"), (4, long, 2, "y"), (4, None, 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_pieces int, ids string")
    got = sorted(((r.doc_id is None, r.n_pieces, r.round_trip, r.ids) for r in pieces.tokenize(docs).collect()), key=lambda x: (x[0], x[1] or 0))
    want = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).encode(long)
    assert [x[:3] for x in got] == [(False, None, None), (False, len(want), True), (True, len(want), True)] and got[1][3] == got[2][3] == want
    keys = spark.createDataFrame([("k" * 1_000_000, 1, True), (None, 2, False)], "doc_id string, shard int, moved boolean")
    assert len(sharding.assign(keys).collect()) == 2
    # equal scores: shards whose numbers come from one digest
    one = sharding.shard_of(F.lit("a"), {3: 1.0, 1: 1.0})
    assert spark.range(1).select(one).first()[0] in (1, 3)


def plain_shard(key, weights):
    best = None
    for k, w in sorted(weights.items()):
        u = (int(hashlib.md5(f"{key}#{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52
        s = -w / math.log(u)
        best = (s, k) if best is None or s > best[0] else best  # of equal scores the lowest number
    return best[1]


def test_shards_by_brute_force(spark):
    for weights in (sharding.WEIGHTS, {7: 0.5, 2: 3.0}):
        rows = spark.range(500).select("id", sharding.shard_of(F.col("id"), weights).alias("s")).collect()
        assert all(r.s == plain_shard(r.id, weights) for r in rows)


def test_pieces_table(spark):
    docs = docs_of(spark, ["the end", None, "", "the end"])
    rows = sorted((r.doc_id, r.n_pieces, r.round_trip) for r in pieces.tokenize(docs).collect())
    assert rows == [(0, 2, True), (1, None, None), (2, 0, True), (3, 2, True)]
    assert pieces.tokenize(docs.limit(0)).count() == 0


def plain_pipeline(rows):
    """The stages one document at a time: profiles and distances by dictionaries, all pairs, a loop over findings."""
    from collections import Counter

    from diskloom.llm import language_id, minhash, secrets

    def ranked(count):
        return {g: k + 1 for k, (g, _) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0]))[: language_id.PROFILE])}

    def grams(text):
        t = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        return Counter(t[k : k + n] for n in (1, 2, 3) for k in range(len(t) - n + 1) if t[k : k + n].strip() and " " not in t[k + 1 : k + n - 1])

    profile = {}
    for d, text, lang in rows:
        if None not in (d, text, lang):
            profile.setdefault(lang, Counter()).update(grams(text))
    profile = {k: ranked(v) for k, v in sorted(profile.items())}
    kept = []
    for d, text, lang in rows:
        own = ranked(grams(text or ""))
        if own and min(sum(abs(p[g] - r) if g in p else language_id.PROFILE for g, r in own.items()) for p in profile.values()) * 100 <= len(own) * language_id.PROFILE * language_id.ACCEPT:
            kept.append((d, text))
    sets = []
    for _, text in kept:
        w = re.findall(r"\w+", text.lower())
        sets.append({tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))})
    stays = [k for k in range(len(kept)) if not any(len(sets[k] & sets[j]) / len(sets[k] | sets[j]) >= minhash.THRESHOLD and (kept[j][0] is None, kept[j][0] or 0, j) < (kept[k][0] is None, kept[k][0] or 0, k) for j in range(len(kept)))]
    return {kept[k][0]: secrets.redact(kept[k][1], secrets.findings(kept[k][1])) for k in stays}


def test_pipeline_by_brute_force(spark, tmp_path):
    r = random.Random(9)
    english = "the cat and dog went to house of king with all men that was not here for you and me".split()
    german = "der hund und die katze gingen zu dem haus des mannes das war nicht gut für kinder im garten".split()
    rows = []
    for k in range(60):
        words_ = r.choice([english, german])
        base = [r.choice(words_) + r.choice(["", "", "er", "ing"]) for _ in range(r.randrange(60, 200))]
        rows.append((len(rows), " ".join(base), "en" if words_ is english else "de"))
        for _ in range(r.choice([0, 0, 1, 2])):  # copies with a word changed
            copy = list(base)
            copy[r.randrange(len(copy))] = "zzz"
            rows.append((len(rows), " ".join(copy), None))
        if k % 9 == 0:
            rows.append((len(rows), f'password: "{"".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGH23456789") for _ in range(30))}" ' + " ".join(r.choice(words_) for _ in range(90)), None))
            rows.append((len(rows), "".join(r.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(900)), None))
    rows += [(len(rows), None, "en"), (len(rows) + 1, "", None), (len(rows) + 2, "123 456", "de"), (None, " ".join(r.choice(english) for _ in range(120)), "en"), rows[3]]
    r.shuffle(rows)
    docs = spark.createDataFrame([(d, t, lang, "s", len(t or ""), 1, "x", 2) for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, `row` int, tokens string, `group` int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
    want = plain_pipeline(rows)
    assert {x.doc_id: x.text for x in now.collect()} == want and None in want and any("[secret]" in t for t in want.values())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(x.doc_id) for x in packed) == sorted(map(str, want))
    count = packing.encoder().encode_ordinary
    demands = {x.doc_id: len(count(want[x.doc_id])) for x in packed}
    assert all(x.tokens == demands[x.doc_id] for x in packed)
    number, _ = plain_fill([(n, 1, n) for n in demands.values()], (8192, 64, 8192))
    got = {}
    for x in packed:
        got.setdefault(x.pack_id, []).append(x.tokens)
    wanted = {}
    for n, p in zip(demands.values(), number):
        wanted.setdefault(p, []).append(n)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, wanted.values()))


def test_pipeline(spark, tmp_path):
    words = "the cat and dog went to house of king with all men that was not here for you and me".split()
    r = random.Random(5)
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = make(120)
    key = "q9Xv7LmZ2pRt5KsW8bNc4HdY"
    texts = [base, base, base + " end", make(100), f'see api_key = "{key}" ' + make(60), make(50), None, "", "12345 67890", make(9000)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = sorted(x.doc_id for x in got)
    assert ids == [0, 3, 4, 5, 9] and {x.doc_id: x.oversize for x in got}[9]
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
    rows = {x.doc_id: x for x in now.collect()}
    assert key not in rows[4].text and "[secret]" in rows[4].text and rows[3].text == texts[3]
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(str(empty / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
