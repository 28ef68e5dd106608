"""Operators over the whole corpus, against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as tokenizers
import pytest
from pyspark.sql import functions as F

from strandflow.llm import components, language, near_dedup, packing, pitman_yor, sharding

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(10_000, None, "en", None, 0), (10_001, "", None, "src0", 0), (10_002, " \n", "en", "src0", 2), (10_003, "one two", "en", "src0", 7), (10_004, "ONE  two", None, None, 8), (10_005, "z" * 60_000, "en", "src0", 60_000), (10_003, "one two", "en", "src0", 7)]
    return base.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(extra, SCHEMA)).withColumn("slot", F.lit("clash")).withColumn("n", F.lit(1)).cache()


def test_first_fit_decreasing():
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = -np.sort(-rng.integers(1, 100, int(rng.integers(0, 60))))
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        room: list[int] = []
        for n, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
            first = next((k for k, r in enumerate(room) if r >= n), len(room))
            if first == len(room):
                room.append(100)
            assert (b, o) == (first, 100 - room[first])
            room[first] -= n


def test_packing_words_are_the_tokenizers():
    encoder = packing.Encoder(tokenizers.path("byte_bpe_50k.json"))
    assert encoder.single
    rng = random.Random(1)
    signs = [*"ab1,.!?;:'s\u00e9\u00d7\u00f7\u0436\u03b1\u4f60\0-", "don't", "word", "<|endoftext|>", "\U0001f600", "\u0301"]
    for between in ([*" \n\t\xa0\x85\x1c", "  ", "\n\n", " \n"], ["", "", " ", " ", "\n"]):  # any white space, single white space
        for _ in range(5000):
            text = "".join(rng.choice(signs) + rng.choice(between) * rng.randint(0, 1) for _ in range(rng.randint(0, 14)))
            assert encoder.text(text) == encoder.whole(text), repr(text)


def test_packing(docs):
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, group_docs=64).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for r in docs.collect():
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        own = pieces[r.doc_id]
        assert sum(p.length for p in own) == len(ids) * (2 if r.doc_id == 10_003 else 1) and own[0].doc_tokens == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in own)
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(docs.limit(0), path).count() == 0


def words_of(text):
    return (text or "").encode().lower().split()


def test_near_duplicates(docs):
    rows = near_dedup.near_duplicates(docs).collect()
    sets = {}
    for r in docs.collect():
        w = words_of(r.text)
        sets[r.doc_id] = frozenset(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_chains_of_near_duplicates_are_one_component(spark):
    """Neighbours are alike, the ends are not; and one large group of different near copies."""
    words = [f"w{k}" for k in range(400)]
    chain = [" ".join(words[k * 12 : k * 12 + 200]) for k in range(10)]
    copies = [" ".join([f"v{k}" if k != 7 * c % 150 else f"x{c}" for k in range(150)]) for c in range(60)]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(chain + copies)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame).collect()}
    assert {found[k] for k in range(10)} == {0} and {found[k] for k in range(10, 70)} == {10}


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 9), (9, 8), (1, 2), (7, 7)] + [(20, k) for k in range(21, 60)] + [(k, k + 1) for k in range(100, 140)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {4: 3, 5: 3, 8: 3, 9: 3, 2: 1} | dict.fromkeys(range(21, 60), 20) | dict.fromkeys(range(101, 141), 100)


def test_sharding(docs):
    rows = sharding.interleave(docs, 8, buckets=16).collect()
    total = docs.count()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == total and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    one = sharding.interleave(docs, 8, buckets=1).collect()
    assert sorted(map(str, one)) == sorted(map(str, rows))  # buckets change the plan, not the result
    by_source = Counter((r.source, r.shard) for r in rows)
    for source, n in Counter(r.source for r in rows).items():
        assert all(abs(by_source[source, s] - n / 8) <= 1.5 for s in range(8))
    assert sharding.interleave(docs.limit(0), 8).count() == 0


def test_language(spark, docs):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = language.fit(language.sample_labelled(docs, ~held))
    rows = language.predict(docs, model, ["doc_id", "lang", "slot"]).collect()
    assert len(rows) == docs.count()
    known = [r for r in rows if r.doc_id < 10_000]
    assert sum(r.lang == r.lang_pred for r in known) > 0.95 * len(known)
    assert {(r.lang_pred, r.score) for r in rows if r.doc_id in (10_000, 10_001, 10_002)} == {("und", 0.0)}
    none = language.predict(docs, language.fit([]), ["doc_id"]).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_long_runs_are_read_whole():
    ends = "ab" * 20
    model = language.fit([(ends + "cd" * 60 + ends, "x"), (ends + "ef" * 60 + ends, "y")] * 20)
    for middle, label in (("cd", "x"), ("ef", "y")):
        words = language.words_of(ends + middle * 500 + ends)
        after = language.forward_backward(language.emissions(words, model), np.array([len(words)]), model.transitions)
        assert model.labels[after.sum(0).argmax()] == label and after.mean(0).max() > 0.8
    for n in (1, 39, 40, 41, 42, 78, 79, 500):
        run = "".join(chr(0x4E00 + k) for k in range(n))
        pieces = language.words_of(run)
        assert {run[k : k + 3] for k in range(max(1, n - 2))} <= {w[k : k + 3] for w in pieces for k in range(len(w))} and max(map(len, pieces)) <= 40


def test_every_label_is_learned(spark):
    texts = [" ".join(chr(0x4E00 + 40 * k + (7 * j + i) % 40) for i in range(30)) for k in range(70) for j in range(1 + (k < 66))]
    labels = [f"l{k:02d}" for k in range(70) for j in range(1 + (k < 66))]
    frame = spark.createDataFrame(list(zip(range(len(texts)), texts, labels, strict=True)), "doc_id long, text string, lang string")
    samples = language.sample_labelled(frame, F.lit(True))
    assert {label for _, label in samples} == set(labels)
    model = language.fit(samples, epochs=1)
    words = language.words_of(texts[-1])
    after = language.forward_backward(language.emissions(words, model), np.array([len(words)]), model.transitions)
    assert model.labels[after.sum(0).argmax()] == "l69"


def test_code_switched_words():
    model = language.fit([("the house is on the hill and the river", "en"), ("das haus ist auf dem berg und der fluss", "de")] * 20)
    words = "the house is on the hill das haus ist auf dem berg".split()
    after = language.forward_backward(language.emissions(words, model), np.array([12]), model.transitions)
    assert [model.labels[k] for k in after.argmax(1)] == ["en"] * 6 + ["de"] * 6


def test_forward_backward():
    import itertools

    rng = np.random.default_rng(0)
    lengths, scores, moves = np.array([5, 1, 3]), rng.normal(size=(9, 3)), rng.normal(size=(3, 3))
    after, start = language.forward_backward(scores.copy(), lengths, moves, chunk=2), 0
    for n in lengths:
        p = np.zeros((n, 3))
        for y in itertools.product(range(3), repeat=int(n)):
            w = np.exp(sum(scores[start + i, y[i]] for i in range(n)) + sum(moves[y[i], y[i + 1]] for i in range(n - 1))) * np.exp(moves)[:, y[0]].mean()
            for i in range(n):
                p[i, y[i]] += w
        assert np.allclose(p / p.sum(1, keepdims=True), after[start : start + n])
        start += n


def test_language_model(docs):
    rows = {r.doc_id: r for r in pitman_yor.score_documents(docs).collect()}
    counts, tokens = Counter(), {}
    for r in docs.collect():
        tokens[r.doc_id] = [*words_of(r.text), b"\n"]
        if zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            counts.update(tokens[r.doc_id])
    n, v = sum(counts.values()), len(counts)
    for i, words in tokens.items():
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
        assert r.score < 0
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert pitman_yor.score_documents(docs.limit(0)).count() == 0


def small_shard():
    rng = np.random.default_rng(1)
    word, at = np.repeat(np.arange(30), 5), np.tile(np.arange(5), 30)
    return pitman_yor.Shard(0, np.arange(1, 31) * 7919, word, np.array([3, 10, 64, 70, 4095]), at, rng.integers(0, 9, 150))


def test_the_model_is_a_distribution():
    """Probabilities of all known words and the unknown one sum to 1 in each restaurant."""
    shard = small_shard()
    for step in range(1, 4):
        shard.sweep(*shard.totals(), step)
    customers, tables, v = shard.totals()
    p0, p1 = shard.predictive(customers, tables, v)
    x = pitman_yor.Totals(v)
    unknown = x.base / (pitman_yor.THETA + x.customers)
    assert p0[shard.customers > 0].sum() + unknown == pytest.approx(1)
    for c in range(5):
        rest = (pitman_yor.THETA + x.d[0] * tables[c]) * unknown / (pitman_yor.THETA + customers[c])
        assert p1[shard.at == c].sum() + rest == pytest.approx(1)


def gibbs_scores(train, texts, sweeps, seed):
    """Token by token: each customer is taken out of its table and seated anew, on both levels; log10 scores averaged over the later sweeps' probabilities."""
    import random

    draw = random.Random(seed)
    base = 1 / (len({w for t in train for w in t}) + 1)
    pairs = [(u, w) for t in train for u, w in zip([b"\n", *t[:-1]], t, strict=True)]
    seats, root = defaultdict(list), defaultdict(list)  # tables' sizes of each dish
    customers, tables = Counter(), Counter()
    place = [0] * len(pairs)
    d = [0.5, 0.5]

    def drawn(weights):
        x = draw.random() * sum(weights)
        for k, w in enumerate(weights):
            x -= w
            if x <= 0:
                return k
        return len(weights) - 1

    def p0(w):
        n, t = root_count[0], root_tables[0]
        return (max(0, sum(root[w]) - d[1] * len(root[w])) + (1 + d[1] * t) * base) / (1 + n)

    root_count, root_tables = [0], [0]

    def root_add(w):
        k = drawn([x - d[1] for x in root[w]] + [(1 + d[1] * root_tables[0]) * base])
        if k == len(root[w]):
            root[w].append(0)
            root_tables[0] += 1
        root[w][k] += 1
        root_count[0] += 1

    def root_drop(w):
        k = drawn(root[w])
        root[w][k] -= 1
        root_count[0] -= 1
        if not root[w][k]:
            root[w].pop(k)
            root_tables[0] -= 1

    def add(u, w):
        own = seats[u, w]
        k = drawn([max(x - d[0], 0) if x else 0 for x in own] + [(1 + d[0] * tables[u]) * p0(w)])
        if k == len(own):
            own.append(0)
            tables[u] += 1
            root_add(w)
        own[k] += 1
        customers[u] += 1

    def drop(u, w):
        own = seats[u, w]
        k = drawn(own)
        own[k] -= 1
        customers[u] -= 1
        if not own[k]:
            own.pop(k)
            tables[u] -= 1
            root_drop(w)

    for u, w in pairs:
        add(u, w)
    means = [[0.0] * len(t) for t in texts]
    kept = 0
    for sweep in range(sweeps):
        for u, w in pairs:
            drop(u, w)
            add(u, w)
        for level, counts in ((0, [sum(x) for x in seats.values()]), (1, [sum(x) for x in root.values()])):
            one, two = counts.count(1), counts.count(2)
            d[level] = min(0.95, max(0.05, one / max(1, one + 2 * two)))
        if sweep >= sweeps // 2:
            kept += 1
            for mean, t in zip(means, texts, strict=True):
                for i, (u, w) in enumerate(zip([b"\n", *t[:-1]], t, strict=True)):
                    own = seats.get((u, w), [])
                    mean[i] += (sum(own) - d[0] * len(own) + (1 + d[0] * tables[u]) * p0(w)) / (1 + customers[u])
    return [sum(math.log10(x / kept) for x in mean) for mean in means]


def test_scores_are_those_of_a_token_by_token_sampler(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{min(int(x), 59)}" for x in np.cumsum(rng.integers(0, 4, int(rng.integers(5, 60)))) % 60 * (rng.random() < 0.9)) for _ in range(120)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pitman_yor.score_documents(frame).collect()}
    tokens = [[*words_of(t), b"\n"] for t in texts]
    train = [t for i, t in enumerate(tokens) if not rows[i].held_out]
    expected = gibbs_scores(train, tokens, 10, 0)
    for held in (True, False):
        ours, theirs = (sum(x[i] for i in rows if rows[i].held_out == held) for x in ({i: r.score for i, r in rows.items()}, expected))
        assert ours == pytest.approx(theirs, rel=0.02)
    # another layout gives the same scores
    monkeypatch.setattr(pitman_yor, "SHARD_BYTES", 700)
    monkeypatch.setattr(pitman_yor, "BLOCK_BYTES", 500)
    again = {r.doc_id: r.score for r in pitman_yor.score_documents(frame.repartition(3, F.col("text"))).collect()}
    assert all(again[i] == pytest.approx(r.score, rel=1e-9) for i, r in rows.items())


def test_each_word_has_its_own_restaurant(spark):
    """3000 words of one ending, each before one word of its own: the model knows which."""
    rows = [(i, f"w{i % 3000}ab s{i % 3000}") for i in range(18_000)]
    found = pitman_yor.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out and n_known = 3").agg(F.avg("score")).first()[0]
    assert found > math.log10(1 / 3000) - 1


def test_tables_follow_their_law():
    """Three customers given fixed odds, against the enumerated law; many customers, the exact law against its normal form."""
    rng = np.random.default_rng(0)
    n, w, d = 200_000, 0.8, 0.5
    odds = pitman_yor.Odds(d, np.zeros(n), lambda rows, j: w / (pitman_yor.THETA + d * j))
    tables = pitman_yor.sample_tables(np.full(n, 3), odds, d, rng.random(n), np.ones(n))
    law = np.array([(1 - d) * (2 - d) * w, 3 * (1 - d) * w**2, w**3])
    assert np.bincount(tables.astype(int), minlength=4)[1:] / n == pytest.approx(law / law.sum(), abs=0.005)
    for w, d in ((0.5, 0.3), (5.0, 0.5), (60.0, 0.8), (300.0, 0.6)):
        odds = pitman_yor.Odds(d, np.zeros(n), lambda rows, j, w=w, d=d: w / (pitman_yor.THETA + d * j))
        c, now = np.full(20_000, pitman_yor.EXACT), np.ones(20_000)
        exact = pitman_yor.sample_tables(c, odds, d, rng.random(20_000), now)
        normal = pitman_yor._many_tables(c, odds, np.arange(20_000), d, rng.random(20_000), now)
        assert normal.mean() == pytest.approx(exact.mean(), rel=0.03, abs=0.6) and normal.std() == pytest.approx(exact.std(), rel=0.15, abs=0.3)
    some = pitman_yor.sample_tables(np.array([0, 1, 5000]), pitman_yor.Odds(0.3, np.zeros(3), lambda rows, j: 0.5), 0.3, rng.random(3), np.ones(3))
    assert some[0] == 0 and some[1] == 1 and 1 <= some[2] <= 5000


def test_pipeline(spark):
    import corpus_pipeline

    source = spark.read.parquet(f"{SF}/documents.parquet")
    docs, rows = source, {r.doc_id: r for r in source.collect()}
    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.columns == source.columns and kept.count() >= 0.98 * len(rows)
    single = corpus_pipeline.near_dedup(spark, kept, SF)
    assert single.columns == source.columns
    ids = {r.doc_id for r in single.collect()}
    safe = corpus_pipeline.personal_data(spark, single, SF)
    assert {r.doc_id for r in safe.collect()} == ids and safe.columns == source.columns
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == ids


def test_a_worker_keeps_one_operators_words():
    from strandflow.llm.common import process_cache

    process_cache("a")["x"] = 1
    assert process_cache("a")["x"] == 1 and "x" not in process_cache("b") and "x" not in process_cache("a")


def test_expected_transitions_are_the_gradient():
    """Pair marginals and words' marginals against enumeration."""
    import itertools

    rng = np.random.default_rng(3)
    lengths, scores, moves = np.array([4, 2]), rng.normal(size=(6, 3)), rng.normal(size=(3, 3))
    _, forward, betas = language.forward_backward(scores.copy(), lengths, moves, chunk=2, messages=True)
    at = np.array([0, 1, 2, 4])
    found = language.pair_marginals(scores, forward, betas, moves, at)
    for start, n, rows in ((0, 4, found[:3]), (4, 2, found[3:])):
        expected = np.zeros((n - 1, 3, 3))
        for y in itertools.product(range(3), repeat=n):
            w = np.exp(sum(scores[start + i, y[i]] for i in range(n)) + sum(moves[y[i], y[i + 1]] for i in range(n - 1))) * np.exp(moves)[:, y[0]].mean()
            for i in range(n - 1):
                expected[i, y[i], y[i + 1]] += w
        assert np.allclose(expected / expected.sum((1, 2), keepdims=True), rows)


def test_letters_only(spark):
    model = language.fit([("the house and the river", "en"), ("das haus und der fluss", "de")] * 20)
    assert language.words_of("½ ² Ⅻ 7 _ ab½cd é") == ["ab", "cd", "é"]
    frame = spark.createDataFrame([(1, "½ ²", 2.0, "x"), (2, "the river", 3.0, "y")], "doc_id long, text string, score double, lang_pred string")
    rows = {r.doc_id: r for r in language.predict(frame, model, ["doc_id", "score", "text"], names=("found", "share")).collect()}
    assert (rows[1].found, rows[1].share, rows[1].score) == ("und", 0.0, 2.0) and (rows[2].found, rows[2].text) == ("en", "the river")
    with pytest.raises(ValueError):
        language.predict(frame, model, ["doc_id", "score"])
    assert language.predict(frame.limit(0), model, ["doc_id"]).count() == 0
    assert language.predict(frame, model, []).count() == 2


def test_pipeline_against_brute_force(spark):
    """Each stage on its own input: what the language stage rejects, one document of each group, identifiers gone, every id in one piece."""
    import corpus_pipeline
    from strandflow.llm.pseudonyms import Pseudonymizer

    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").withColumn("score", F.lit(1.5)).withColumn("pii_spans", F.lit("clash"))
    extra = [(90_001, None, "en", "s", 0, 0.0, ""), (90_002, "½ 12 34", "en", "s", 7, 0.0, ""), (90_003, "the same words are here for all of us to see", "en", "s", 1, 0.0, ""), (90_003, "the same words are here for all of us to see", "en", "s", 1, 0.0, "")]
    docs = base.unionByName(spark.createDataFrame(extra, base.schema))
    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert not {90_001, 90_002} & set(ids)
    single = corpus_pipeline.near_dedup(spark, kept, SF).collect()
    sets = {}
    for r in kept.collect():
        w = words_of(r.text)
        sets[r.doc_id] = frozenset(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    least = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and (both := len(sets[a] & sets[b])) and 100 * both >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        before = dict(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    expected = {i for i in sets if least[i] == i}
    found = [r.doc_id for r in single]
    assert len(found) == len(set(found))  # one row of a group, even if it repeats an id
    assert expected <= set(found) and len(found) <= 1.005 * len(expected)  # no document too few; recall of links at 80 percent
    frame = spark.createDataFrame(single, kept.schema)
    change = Pseudonymizer(corpus_pipeline.KEY)
    safe = {r.doc_id: r for r in corpus_pipeline.personal_data(spark, frame, SF).collect()}
    assert all(safe[r.doc_id].text == change(r.text)[0] and safe[r.doc_id].n_chars == len(safe[r.doc_id].text) and safe[r.doc_id].pii_spans == r.pii_spans for r in single)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
