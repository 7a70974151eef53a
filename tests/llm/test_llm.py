"""The training-data operators against brute force, round trips, held-out accuracy, and odd input."""

import collections
import hashlib
import math
import random
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from strandline.llm import language_id, lm_scoring, packing, preference, quality_rules, sentencepieces, sharding, simhash, similar, substrings, topk

SCHEMA = "doc_id bigint, text string, lang string, source string, row string, id int, at double, spans string, block string"
EXTRA = ("x", 1, 2.0, "s", "b")


def prose(rng, n, words=400, lang="w"):
    return " ".join(f"{lang}{rng.randrange(words)}" for _ in range(n))


def odd_rows():
    rng = random.Random(5)
    long = prose(rng, 3000)
    texts = [None, "", " \n\t", "one", "two words", prose(rng, 80), prose(rng, 80).upper(), long, long, long + " end", "é ß 漢字 🎉\x00 z", "a\x0bb\x0cc d"]
    rows = [(i, t, "en" if i % 2 else None, "hot") for i, t in enumerate(texts)]
    shared = prose(rng, 70)
    rows += [(20 + i, f"{prose(rng, 30)} {shared} {prose(rng, 20)}", "en", None) for i in range(4)]
    rows += [(50 + n, prose(rng, n), "en", "hot") for n in (5, 20, 31, 32, 33, 49, 50, 51)]
    rows += [(None, shared, None, "hot"), (40, shared, "de", "hot"), (40, shared, "de", "hot"), (41, "x " * 200, "xx", "")]
    return [(*r, *EXTRA) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


# 1: top-k


def brute_top(vectors, k):
    out = []
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for i, q in {(i, tuple(q)) for i, q in good if i % 100 == 0}:
        scores = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in good if j != i)
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def test_topk_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.round(rng.normal(size=(901, 24)), 1))]
    rows += [(5000, None), (5001, [1.0, None]), (5100, [float("nan")] * 24), (5200, [1.0] * 24), (5300, [0.5] * 7), (5400, []), (7, rows[7][1]), (None, [1.0] * 24)]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "vec_id bigint, embedding array<double>, label int, query string").repartition(4)
    got = sorted(tuple(r) for r in topk.top_k(df).select("query_id", "rank", "id", "score").collect())
    assert got == brute_top(rows, 10)
    assert topk.top_k(df.limit(0)).count() == 0


def test_topk_of_few_rows_and_large_numbers(spark):
    df = spark.createDataFrame([(0, [1e15, 1.0]), (1, [1e15, 2.0]), (2, [-1e15, 0.0])], "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df).orderBy("rank").collect()]
    big = (1 << 63) - 1
    assert got == [(0, 1, 1, big), (0, 2, 2, -big - 1)]


def test_topk_of_the_largest_numbers(spark):
    rows = [(0, [1e308, 1.0]), (1, [1e-3, 5.0]), (2, [-1e308, 0.0]), (3, [0.0, 7.0])]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).orderBy("rank").collect()]
    big = (1 << 63) - 1
    assert got == [(0, 1, 1, big), (0, 2, 3, 1024 * 7 * 1024), (0, 3, 2, -big - 1)]


def test_topk_over_many_tiles_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE", 3)
    monkeypatch.setattr(topk, "CHUNK", 50)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 20)) * 5
    rows = [(i, [float(x) for x in np.round(centres[i % 6] + rng.normal(size=20), 2)]) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(df, k=5).select("query_id", "rank", "id", "score").collect())
    assert got == brute_top(rows, 5)


def test_pairs_that_survive_are_scored_alone():
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(40, 32)) * 3, 50, axis=0) + rng.normal(size=(2000, 32)) * 0.1
    best, x = topk.Best(x[::50], np.arange(-40, 0), 10), rng.permutation(x)
    best.add(x[:1000], np.arange(1000))
    scored = []
    exact = topk.exact_pairs
    topk.exact_pairs = lambda q, r: scored.append(len(q)) or exact(q, r)
    try:
        best.add(x[1000:], np.arange(1000, 2000))
    finally:
        topk.exact_pairs = exact
    assert 0 < sum(scored) < topk.SPARSE * 40 * 1000


def test_bounds_never_fall_short():
    rng = np.random.default_rng(0)
    q, x = rng.integers(-3000, 3000, (20, 33)).astype(float), rng.integers(-3000, 3000, (50, 33)).astype(float)
    for r in topk.RESOLUTIONS:
        assert (topk.statistics(q, r) @ topk.statistics(x, r).T + 1e-3 >= q @ x.T).all()


# 2: quality classifier


def test_preference_ranks_held_out_rows(spark, odd):
    rng = random.Random(1)
    rows = [(i, prose(rng, 60) if i % 3 else prose(rng, 60).replace(" ", "!! ").upper(), i % 3 > 0) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(q), 0) for i, _, q in rows] + [(1, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    out = {r.id: r for r in preference.classify(docs, labels).collect()}
    held = [i for i, _, _ in rows if out[i].held_out]
    assert held == [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].predicted == int(rows[i][2]) for i in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())
    assert preference.classify(odd, labels).count() == odd.count()
    only = preference.classify(docs, labels.limit(0)).first()
    assert only.score == 0.5


def test_ranker_is_the_plain_fit_over_all_pairs():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, preference.WIDTH))
    y = (x[:, :4] @ [1.5, -1.0, 0.7, 0.4] + rng.normal(size=120) > 0).astype(np.int64)
    r = preference.Ranker(x, y, 0.3)
    z = np.clip((x - x.mean(0)) / np.maximum(x.std(0), 1e-4), -8, 8)
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, x.shape[1])
    w = np.zeros(x.shape[1])
    for _ in range(600):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        w -= 0.05 * (-(p @ d) / len(d) + preference.DECAY * w)
    assert np.corrcoef(z @ w, z @ r.w)[0, 1] > 0.97
    assert abs((r.scores(x) >= 0.3).sum() - y.sum()) <= 1  # the cut is the quantile at the share of label 0


def test_preference_learns_the_same_from_any_partitions(spark):
    rng = random.Random(2)
    rows = [(i % 300, prose(rng, 40) if i % 3 else prose(rng, 40).upper()) for i in range(400)]
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], "doc_id bigint, quality int, toxic int")
    one, many = (preference.fit(docs.repartition(n), labels) for n in (1, 7))
    assert np.array_equal(one.w, many.w)


# 3: sentence pieces

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_equal_the_library_and_round_trip(odd):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = sentencepieces.decode(sentencepieces.encode(odd, PIECES), PIECES).collect()
    texts = sorted((r[1] or "") for r in odd_rows())
    assert sorted(r.decoded for r in out) == texts
    by_ids = {tuple(sp.encode(t)) for t in texts}
    assert {tuple(r.ids) for r in out} == by_ids


def test_unigram_viterbi_is_the_best_of_all_ways():
    p = sentencepieces.Pieces(PIECES)
    p.kind = sentencepieces.UNIGRAM
    p.score = [-((i * 7919) % 97) - 1.0 for i in range(len(p.score))]
    floor = min(p.score) - 10

    def best(s):
        if not s:
            return 0.0
        ways = [p.score[p.id[s[:n]]] + best(s[n:]) for n in range(1, len(s) + 1) if s[:n] in p.id]
        return max(ways, default=floor + best(s[1:]))

    for s in ("▁hello", "▁the", "there", "▁漢字x"):
        assert sum(p.score[i] if i in p.text else 0.0 for i in p._viterbi(s)) >= best(s) - 1e-9


def unigram_file(path, scores):
    """A model file of pieces with scores, an unknown piece and all bytes, as the library reads it."""
    field = lambda n, value: bytes([n << 3 | 2]) + number(len(value)) + value

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    piece = lambda text, score, kind: field(1, field(1, text.encode()) + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind]))
    rows = piece("<unk>", 0, 2) + b"".join(piece(f"<0x{b:02X}>", 0, 6) for b in range(256)) + b"".join(piece(p, s, 1) for p, s in scores.items())
    path.write_bytes(rows + field(2, b"\x18\x01\x98\x02\x01") + field(3, b"\x18\x01\x20\x00\x28\x01"))
    return str(path)


def test_unigram_file_equals_the_library(spark, tmp_path):
    rng = random.Random(11)
    scores = {c: -8.0 - k * 0.37 for k, c in enumerate("▁abcdé漢")}
    while len(scores) < 300:
        scores.setdefault("".join(rng.choice("▁abcdé") if not k else rng.choice("abcdé") for k in range(rng.randrange(2, 6))), -rng.random() * 20 - 1)
    path = unigram_file(tmp_path / "unigram.model", scores)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["", "a", " ", "abc abcd éa", "漢x字 ab", "z", "cafe  b\na"] + ["".join(rng.choice("abcdé  z") for _ in range(200)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in sentencepieces.decode(sentencepieces.encode(df, path), path).collect():
        assert r.ids == sp.encode(texts[r.id])
        assert r.decoded == texts[r.id]


def test_pieces_and_ranks_of_empty_tables(spark, empty):
    assert sentencepieces.decode(sentencepieces.encode(empty, PIECES), PIECES).count() == 0
    assert preference.classify(empty, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0


# 4: SimHash


def brute_simhash(rows):
    fps = [(i, simhash.fingerprint((t or "").encode())) for i, t in rows]
    near = lambda a, b: (a ^ b & (2**64 - 1)).bit_count() <= 3 if a >= 0 and b >= 0 else ((a ^ b) & (2**64 - 1)).bit_count() <= 3
    root = list(range(len(fps)))
    for _ in fps:
        for i in range(len(fps)):
            for j in range(i):
                if near(fps[i][1], fps[j][1]) and root[i] != root[j]:
                    low = min(root[i], root[j])
                    root = [low if r in (root[i], root[j]) else r for r in root]
        break
    groups = collections.defaultdict(list)
    for k, (i, _) in enumerate(fps):
        groups[root[k]].append(i)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((i, f, least[root[k]]) for k, (i, f) in enumerate(fps)), key=repr)


def test_simhash_matches_all_pairs(odd, empty):
    got = sorted(((r.id, r.fp, r.component_id) for r in simhash.near_duplicates(odd).collect()), key=repr)
    assert got == brute_simhash([r[:2] for r in odd_rows()])
    assert simhash.near_duplicates(empty).count() == 0


def test_fingerprint_counts_repeats():
    h = [xxhash.xxh64_intdigest(s, 42) for s in (b"a b a", b"b a b", b"a b a")]
    want = sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > 3)
    assert simhash.fingerprint(b"A b a b a") & (2**64 - 1) == want


@pytest.mark.parametrize("heavy", [simhash.HEAVY, 2])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, heavy):
    """Crowded segment values take the way through points between fingerprints."""
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    rng = np.random.default_rng(heavy)
    base = rng.integers(-(2**63), 2**63 - 1, 3)
    fps = set(base.tolist())
    for b in base.tolist():
        for _ in range(120):
            x = b & (2**64 - 1)
            for bit in rng.choice(64, rng.integers(1, 7), replace=False).tolist():
                x ^= 1 << bit
            fps.add(x - 2**64 if x >= 2**63 else x)
    fps = sorted(fps)
    got = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint"))).collect()}
    a = np.array(fps).view(np.uint64)
    root = np.arange(len(a))
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3):
            root[root == max(root[i], root[j])] = min(root[i], root[j])
    assert [got.get(f, f) for f in fps] == [fps[r] for r in root]


def changed(words, at, tag):
    out = list(words)
    for k in at:
        out[k] = f"{tag}c{k}"
    return out


def groups_in(spark, texts, slices):
    df = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(map(" ".join, texts))), slices), "row bigint, text string")
    return {r.row: r.group for r in similar.groups(df, "row", "text").collect()}


def test_similar_variants_of_one_text_keep_their_own_links(spark):
    base = [f"b{i}" for i in range(200)]
    spread = lambda i: [(i * 3 + 40 * k + 7) % 190 for k in range(4)]
    variants = [changed(base, spread(i), f"v{i}") for i in range(30)]  # 0.81 similar to base
    further = [changed(variants[20 + i], [x + 20 for x in spread(20 + i)[:3]], f"f{i}") for i in range(10)]  # 0.86 to one variant, 0.70 to base
    others = [[f"o{k}x{i}" for i in range(60)] for k in range(41)]
    got = groups_in(spark, [base, *variants, *further, *others], 2)
    assert got == dict.fromkeys(range(41), 0)


def test_similar_pairs_at_the_limit_are_all_found(spark):
    rng = random.Random(4)
    texts = []
    for i in range(1500):
        words = [f"p{i}w{k}" for k in range(49)]  # 45 shingles, of which a change takes five: 0.8
        texts += [words, changed(words, [rng.randrange(4, 45)], "n")]
    got = groups_in(spark, texts, 4)
    assert got == {i: i - i % 2 for i in range(3000)}


def test_similar_copies_in_a_crowd_of_one_template(spark):
    template = [f"t{i}" for i in range(204)]
    texts = []
    for i in range(2000):
        own = changed(template, range(4, 200, 20), f"d{i}")  # 0.6 similar to the others
        texts += [own, changed(own, [190, 30], "n")] if i < 60 else [own]
    got = groups_in(spark, texts[::-1], 4)
    assert got == {i: i - i % 2 for i in range(len(texts) - 120, len(texts))}


def test_similar_sets_are_equal_whatever_repeats(spark):
    once, often = [], []
    for i in range(200):
        words, line = [f"e{i}w{k}" for k in range(230)], [f"e{i}r{k}" for k in range(14)]
        # A line repeated; the shingles across its ends are there in both.
        once.append([*words, *line, *line])
        often.append([*words, *(line * 9)])
    got = groups_in(spark, once + often, 2)
    assert got == {i: i % 200 for i in range(400)}


def test_similar_groups_match_exact_jaccard(spark):
    rng = random.Random(9)
    base = [prose(rng, 120).split() for _ in range(20)]
    texts = []
    for b in base:
        texts.append(" ".join(b))
        for changes in (1, 2, 3, 8, 25):
            w = list(b)
            for _ in range(changes):
                w[rng.randrange(len(w))] = f"new{rng.random()}"
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "row bigint, text string").repartition(4)
    sets = [set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if r == max(root[i], root[j]) else r for r in root]
    got = {r.row: r.group for r in similar.groups(df, "row", "text").collect()}
    assert [got.get(i, i) for i in range(len(texts))] == root


# 5: sharding


def test_shards_are_near_equal_and_slots_gapless(spark, odd, empty):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randrange(200), "en", "hot" if i % 3 else f"s{i}") for i in range(3000)] + [(7, "copy", "en", "hot")] * 1000
    out = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(5)).collect()
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in out:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 201
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len(slots) == 8
    assert sorted((r.id, r.size, r.text_crc32) for r in out) == sorted((i, len(t) + 1, zlib.crc32(t.encode())) for i, t, _, _ in rows)
    assert sharding.shard(odd).count() == odd.count()
    assert sharding.shard(empty).count() == 0
    assert {r.shard for r in sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), target_bytes=100_000).collect()} == set(range(math.ceil(sum(sizes.values()) / 100_000)))


def test_a_thousand_leaves_reach_their_bytes(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randrange(100, 300), "en", f"s{i % 5}") for i in range(20_000)]
    began = time.time()
    out = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), shards=1000).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert time.time() - began < 120
    mean = sum(r.n for r in out) / 1000
    assert len(out) == 1000
    assert all(abs(r.n - mean) < 10 * 301 for r in out)


# 6: language


def test_language_fuses_evidence(spark):
    rng = random.Random(4)
    vocab = {"en": "the of and house water light under", "fr": "le de et maison eau sous lumière être", "de": "der und das wasser über licht straße"}
    say = lambda lang, n: " ".join(rng.choice(vocab[lang].split()) for _ in range(n))
    docs = spark.createDataFrame([(say(lang, 60), lang) for lang in vocab for _ in range(30)] + [(None, "en"), ("x", None)], "text string, lang string")
    model = language_id.fit(docs)
    page = lambda lang, decl, body: f'<html lang="{decl}"><head><title>t</title></head><body><nav>{say("de", 20)}</nav><p>{body}</p></body></html>' if decl else f"<html><p>{body}</p>"
    rows = [(i, f"https://h{i % 3}.example.{('com', 'fr', 'de')[i % 3]}/x", page(("en", "fr", "de")[i % 3], ("en", "fr", "de")[i % 3], say(("en", "fr", "de")[i % 3], 40)), 1) for i in range(60)]
    rows += [(100, "https://h1.example.fr/a", "<p></p>", 1), (101, None, None, 1), (102, "https://h0.example.com", page("en", "de", say("en", 60)), 1), (102, "https://h0.example.com", page("en", "de", say("en", 60)), 1), (103, "not an address", "<html lang='fr'>", 1), (104, None, "".join(chr(0x4E00 + 37 * k) for k in range(90)), 1), (None, "", say("de", 40), 1)]
    out = language_id.identify_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string, host int").repartition(3), model).collect()
    assert len(out) == len(rows)
    got = {r.id: r for r in out}
    assert all(got[i].lang == ("en", "fr", "de")[i % 3] and got[i].accepted for i in range(60))
    assert (got[100].lang, got[102].lang, got[103].lang, got[None].lang) == ("fr", "en", "fr", "de")
    assert not got[101].accepted
    assert not got[104].accepted
    assert language_id.identify_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string, host int").limit(0), model).count() == 0
    assert not language_id.identify_pages(spark.createDataFrame(rows[:1], "page_id bigint, url string, html string, host int"), language_id.fit(docs.limit(0))).first().accepted


def test_posteriors_match_a_plain_recomputation(spark):
    rng = random.Random(9)
    vocab = {"en": "the of and house water light under", "fr": "le de et maison eau sous soir", "de": "der und das wasser haus licht abend"}
    docs = spark.createDataFrame([(" ".join(rng.choice(vocab[lang].split()) for _ in range(60)), lang) for lang in vocab for _ in range(20)], "text string, lang string")
    model = language_id.fit(docs)
    rows = []
    for i in range(50):
        lang = rng.choice(list(vocab))
        text = " ".join(rng.choice(vocab[rng.choice(list(vocab)) if rng.random() < 0.4 else lang].split()) for _ in range(rng.choice([0, 1, 6, 30])))
        rows.append((i, f"https://{rng.choice('abc')}.{rng.choice('xy')}.{rng.choice(['com', 'fr'])}/" if rng.random() < 0.8 else None, text, rng.choice(["en", "fr", "xx", None])))
    df = spark.createDataFrame(rows, "id int, url string, text string, decl string")
    got = {r.id: r for r in language_id.identify(df, model, "id", "text", F.col("decl"), F.col("url")).collect()}
    n, L = len(model.languages), language_id
    prior = model.share / model.share.sum()
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    facts = {}
    for i, url, text, decl in rows:
        host = url.split("/")[2] if url else None
        log, t = model.likelihood(text.encode())
        facts[i] = {"log": log, "t": t, "post": soft(log + np.log(prior)), "declared": decl if decl in (*model.languages, None) else "other", "host": host, "domain": host and ".".join(host.split(".")[-2:]), "suffix": host and host.split(".")[-1]}
    judged = {i for i, f in facts.items() if f["t"] >= L.LEAST_TRIGRAMS}
    whole = sum((facts[j]["post"] for j in judged), np.zeros(n))
    for i, f in facts.items():
        rest = judged - {i}
        sums = lambda key: sum((facts[j]["post"] for j in rest if facts[j][key] == f[key]), np.zeros(n)) if f[key] is not None else np.zeros(n)  # noqa: E731, B023
        log = f["log"].copy()
        every = sum((facts[j]["post"] for j in rest), np.zeros(n))
        for key in ("declared", "suffix"):
            if f[key] is not None:
                log += np.log((sums(key) + L.EVEN / (n + 2)) / (every + L.EVEN))
        above = (whole + prior) / (whole.sum() + 1)
        for key in ("domain", "host"):
            above = (sums(key) + L.SMOOTH * above) / (sums(key).sum() + L.SMOOTH)
        post = soft(log + np.log(above))
        assert got[i].posterior == pytest.approx(post.max(), rel=1e-6)
        assert got[i].lang == model.languages[int(post.argmax())]


def test_markup_that_is_never_closed_takes_linear_time():
    for part in (b"<script ", b"<!--", b"<", b"</script  ", b"<nav></nav ", b"<html "):
        began = time.time()
        language_id.visible_text(part * 200_000)
        assert time.time() - began < 3
    assert language_id.visible_text(b"a<b>c<!-- <p> --><SCRIPT x>d</script >e<style>f&amp;<g") == b"a c  e f&<g"


# 7: repeated passages


def brute_substrings(rows, window=50):
    first = {}
    for i, t in rows:
        w = words(t)
        for a in range(len(w) - window + 1) if i is not None else ():
            k = tuple(w[a : a + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[a : a + window])] < i:
                gone[a : a + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_substrings_match_brute_force(odd, empty):
    got = sorted(((r.id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removals(odd).collect()), key=repr)
    assert got == brute_substrings([r[:2] for r in odd_rows()])
    assert substrings.removals(empty).count() == 0


def test_a_full_sketch_loses_nothing(odd, monkeypatch):
    monkeypatch.setattr(substrings, "MIN_CELLS", 8)
    monkeypatch.setattr(substrings, "MAX_CELLS", 8)
    monkeypatch.setattr(substrings, "BLOCK", 8)
    got = sorted(((r.id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removals(odd).collect()), key=repr)
    assert got == brute_substrings([r[:2] for r in odd_rows()])


# 8: quality rules


def brute_base(t):
    t = t or ""
    w = [x.decode() for x in words(t)]
    spans = collections.Counter(tuple(w[a : a + 5]) for a in range(len(w) - 4))
    hit = [False] * len(w)
    for a in range(len(w) - 4):
        if spans[tuple(w[a : a + 5])] > 1:
            hit[a : a + 5] = [True] * 5
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    n, rep = len(w), sum(hit)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, rep, n < 10 or 100 * rep > 20 * n)


def test_quality_counts_match_brute_force(spark, odd, empty):
    more = spark.createDataFrame([(60, "a b c d e f\na b c d e f\n\n x # $\r\na b c d e f", "en"), (61, "x y " * 40, "en"), (62, "same line\n" * 5, "fr")], "doc_id bigint, text string, lang string")
    for df, rows in ((odd, [r[:2] for r in odd_rows()]), (more, [(r.doc_id, r.text) for r in more.collect()])):
        got = sorted(((r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judge(df).collect()), key=repr)
        assert got == sorted(((i, *brute_base(t)) for i, t in rows), key=repr)
    assert quality_rules.judge(empty).count() == 0


def test_divergence_rejects_junk_and_keeps_clean(spark):
    rng = random.Random(8)
    clean = lambda: " ".join(rng.choice("the of and to in house river stone walked bright morning".split()) + rng.choice(["", "", "", "", ",", "."]) for _ in range(300))
    rows = [(i, clean(), "en", "s") for i in range(90)] + [(100 + i, clean().upper().replace(" ", "### "), "en", "s") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, at string")
    assert sorted(r.id for r in quality_rules.judge(df).collect() if not r.kept) == [100, 101, 102]
    assert sorted(r.doc_id for r in quality_rules.kept_rows(df).collect()) == list(range(90))
    assert quality_rules.kept_rows(df).columns == df.columns


def test_languages_come_from_the_data(spark):
    """Texts of a fifth language are kept, be they few (base rules alone) or many (a reference of their own)."""
    rng = random.Random(12)
    say = lambda vocab, n: " ".join(rng.choice(vocab.split()) for _ in range(n))
    rows = [(i, say("the of and to in house river stone walked bright morning", 200), "en") for i in range(60)]
    rows += [(1000 + i, say("ja on ei se että hän talo joki kivi aamu valo vesi", 200), "fi") for i in range(19)]
    rows += [(2000 + i, say("ve bir bu da için ev nehir taş sabah ışık su gün", 200), "tr") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = {r.id: r for r in quality_rules.judge(df).collect()}
    assert all(r.kept for r in out.values())
    assert out[1000].distance is None
    assert out[2000].lang_found == "tr"


def test_languages_beyond_the_plan_count_alike(spark, monkeypatch):
    """Languages that are joined give the results that they give within the plan, and junk in one is told by its own reference."""
    rng = random.Random(14)
    say = lambda tag, n: " ".join(f"{tag}{min(rng.randrange(40), rng.randrange(40))}" for _ in range(n))
    rows = [(1000 * k + i, say(chr(97 + k) * 2, 120), f"l{k}") for k, n in enumerate((60, 50, 40, 30, 19)) for i in range(n)]
    rows += [(9000, say("dd", 120).upper().replace(" ", "### "), "l3"), (9001, say("cc", 120), None), (9002, None, "l2"), (9003, "dd1 dd2", "l3")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3).cache()
    every, kept = [], []
    for most in (64, 2):
        monkeypatch.setattr(quality_rules, "MAX_LANGUAGES", most)
        every.append({r.id: r for r in quality_rules.judge(df).collect()})
        kept.append({r.doc_id for r in quality_rules.kept_rows(df).collect()})
    whole, joined = every
    assert len(joined) == len(rows)
    for i, r in joined.items():
        assert r.asDict() | {"distance": 0} == whole[i].asDict() | {"distance": 0}
        assert (r.distance or 0) == pytest.approx(whole[i].distance or 0, rel=1e-9)
    assert kept[0] == kept[1] == {i for i, r in joined.items() if r.kept}
    assert (joined[9000].kept, joined[9001].lang_found, joined[3000].lang_found, joined[4000].distance) == (False, "l2", "l3", None)


# 9: packing

TOKENS = public_tokenizers.path("word_bpe_49k.json")


def test_packing_holds_every_id_once(odd, empty):
    whole = packing.tokenizer(TOKENS)
    out = packing.pack(odd, TOKENS).collect()
    ids = lambda t: [*whole.encode(t or "", add_special_tokens=False).ids, 1]
    want = collections.Counter()
    for i, t, *_ in odd_rows():
        x = ids(t)
        cuts = sorted({(r.start, r.length) for r in out if r.id == i and r.doc_tokens == len(x)})
        assert cuts[0][0] == 0
        assert all(a + n == b for (a, n), (b, _) in zip(cuts, cuts[1:], strict=False))
        assert sum(cuts[-1]) == len(x)
        want.update((i, a, n, zlib.crc32(np.array(x[a : a + n], "<u4").tobytes())) for a, n in cuts)
    assert want == collections.Counter((r.id, r.start, r.length, r.ids_crc32) for r in out)
    loads = collections.defaultdict(list)
    for r in out:
        loads[r.sequence_id].append((r.offset, r.length))
    for v in loads.values():
        v.sort()
        assert v[0][0] == 0
        assert all(a + n == b for (a, n), (b, _) in zip(v, v[1:], strict=False))
        assert sum(v[-1]) <= 2048
    assert packing.pack(empty, TOKENS).count() == 0


def test_karmarkar_karp_levels_windows():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 300, 1200):
        sizes = rng.integers(1, 2048, n).tolist()
        where = packing.windows(sizes, 2048)
        loads = np.bincount(where, weights=sizes)
        assert len(where) == n
        assert loads.max() <= 2048
    sizes = rng.integers(1, 400, 2000).tolist()
    loads = np.bincount(packing.karmarkar_karp(sizes, 200), weights=sizes)
    assert loads.max() - loads.min() <= 8


# 10: language-model scores


def test_scores_base_and_gain(spark, odd, empty):
    rng = random.Random(6)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{rng.randrange(60)}" for _ in range(80)), "x") for i in range(400)] + [(1000, None, "x"), (1001, "Unseen WORDS", "x"), (None, "a1", "x")]
    out = {r.id: r for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id bigint, text string, h string").repartition(3)).collect()}
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = {i: [*(x.lower() for x in words(t)), None] for i, t, _ in rows}
    c = collections.Counter(x for i, t in tokens.items() if not held(i) for x in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(t), sum(c[x] > 0 for x in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t))
    late = [r for i, r in out.items() if r.held_out and i is not None and i < 1000]
    assert sum(r.score for r in late) > sum(r.base_score for r in late) + 0.03 * sum(r.n_tokens for r in late)
    assert lm_scoring.score(odd).count() == odd.count()
    assert lm_scoring.score(empty).count() == 0


def test_rare_words_meet_their_counts_in_a_join(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "LOOKUP", 5)
    rows = [(i, f"the the w{i} w{i % 7}") for i in range(60)]
    for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        tokens = {i: [*words(t), None] for i, t in rows}
        c = collections.Counter(x for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 10 for x in t)
        n, v = sum(c.values()), len(c)
        assert r.n_known == sum(c[x] > 0 for x in tokens[r.id])
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens[r.id]))
