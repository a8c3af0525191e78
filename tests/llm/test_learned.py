"""Operators 1, 2, 4, 6, 7 and 10 against plain versions, on odd input and held-out rows."""
import hashlib
import itertools
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
import zstandard
from pyspark.sql import functions as F

from moldwatch.llm import attention, langid, lm, near_dup, packing, tokens, toxicity
from moldwatch.llm.queries import QUERIES
from moldwatch.llm.shingles import shingle_counts
from moldwatch.llm.store import shared_path
from tests.conftest import SF_MID, SF_SMALL
from tests.llm import helpers
from tests.llm.conftest import PROSE

P = pytest.importorskip("public_tokenizers")


def docs_of(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# --- packing

def test_boundaries_are_optimal():
    random.seed(1)
    for _ in range(30):
        lengths = random.sample(range(1, 60), random.randint(1, 9))
        counts = [random.randint(1, 9) for _ in lengths]
        k = random.randint(1, 5)
        pad = lambda bounds: sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))
        top = max(lengths)
        best = min(pad((*b, top)) for m in range(min(k, len(lengths))) for b in itertools.combinations([n for n in lengths if n < top], m))
        got = packing.optimal_boundaries(lengths, counts, k)
        assert len(got) <= k and pad(got) == best
    assert packing.optimal_boundaries([], [], 4) == []


def test_packing(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, 10, "x"), (2, 0, "x"), (3, None, "x"), (4, 25, "x"), (5, -3, "x"), (5, 7, "x"), (5, 7, "x"), (None, 3, "x")],
                                  "doc_id bigint, n_tokens bigint, bucket string")
    got = packing.pack(items, max_len=10, n_buckets=2, batch_tokens=20).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["n_tokens"]) for r in got) == Counter(
        [(1, 0, 0, 10), (2, 0, 0, 0), (3, 0, 0, 0), (4, 0, 0, 10), (4, 1, 10, 10), (4, 2, 20, 5), (5, 0, 0, 0), (5, 0, 0, 7),
         (5, 0, 0, 7), (None, 0, 0, 3)])
    for r in got:
        assert (r["bucket_len"] is None) == (r["n_tokens"] == 0)
    full = [r for r in got if r["bucket_len"]]
    slots = [(r["bucket_len"], r["batch"], r["slot"]) for r in full]
    assert len(set(slots)) == len(slots)
    for (b, _), n in Counter((r["bucket_len"], r["batch"]) for r in full).items():
        assert n * b <= 20
    for b, own in itertools.groupby(sorted(full, key=lambda r: r["bucket_len"]), key=lambda r: r["bucket_len"]):
        own = list(own)
        assert len({r["batch"] for r in own}) == math.ceil(len(own) / (20 // b))
    assert packing.pack(packing.word_lengths(no_docs)).count() == 0
    total = sum(len((r[0] or "").split()) for r in odd_docs.select("text").collect())
    assert abs(packing.pack(packing.word_lengths(odd_docs)).agg(F.sum("n_tokens")).first()[0] - total) <= 2  # split() also cuts at \x1c


def test_packing_ranks_copies_as_one(spark, monkeypatch):
    monkeypatch.setattr(packing, "RUN", 70)
    rows = [(None, 5)] * 500 + [(7, 5)] * 300 + [(7, 6)] * 70 + [(i, 1 + i % 9) for i in range(100, 200)]
    items = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    packed = packing.pack(items, max_len=10, n_buckets=2, batch_tokens=20)
    got = packed.collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter(rows)
    for b, own in itertools.groupby(sorted(got, key=lambda r: r["bucket_len"]), key=lambda r: r["bucket_len"]):
        ranks = sorted(r["batch"] * (20 // b) + r["slot"] for r in own)
        assert ranks == list(range(len(ranks)))
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [sum(copies" in plan and "row_number" not in plan  # the window sees a row per distinct piece


def _packed_whole(packed, texts, tokens_of, max_len, batch_tokens):
    """The pieces of every text, copies included, stand once in the batches and put together give its tokens."""
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): t for t in texts}
    expected = Counter()
    for t in texts:
        own = tokens_of(t)
        expected.update((t, i // max_len, tuple(own[i:i + max_len])) for i in range(0, len(own), max_len))
    rows = packing.batches(packed).collect()
    got = Counter((by_digest[r["digest"]], r["piece"], tuple(r["tokens"])) for b in rows for r in b["rows"])
    assert got == expected
    for b in rows:
        lengths = [len(r["tokens"]) for r in b["rows"]]
        assert [r["slot"] for r in b["rows"]] == list(range(b["n_rows"])) and max(lengths) <= b["bucket_len"]
        assert b["n_rows"] * b["bucket_len"] <= max(batch_tokens, b["bucket_len"])
        assert b["n_tokens"] == sum(lengths) and b["n_padding"] == sum(b["bucket_len"] - n for n in lengths)


def test_packed_content_is_the_texts(spark, odd_docs, odd_rows, no_docs):
    texts = [r[1] or "" for r in odd_rows] + ["hot copy of a text"] * 200
    docs = odd_docs.select("text", "id", "piece", "batch").unionByName(
        spark.createDataFrame([("hot copy of a text",)] * 200, "text string"), allowMissingColumns=True)
    packed = packing.pack_texts(docs, max_len=50, n_buckets=3, batch_tokens=120)
    _packed_whole(packed, texts, lambda t: regex.findall(r"[^\x20\x09-\x0D]+", t), 50, 120)
    assert packing.batches(packing.pack_texts(no_docs)).count() == 0


def test_packed_subwords_are_the_library_s(spark, odd_docs, odd_rows):
    import sentencepiece
    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    packed = packing.pack_texts(odd_docs, tokens=packing.subword_ids(path), max_len=64, n_buckets=4, batch_tokens=256)
    _packed_whole(packed, [r[1] or "" for r in odd_rows], model.encode, 64, 256)


# --- token counts

def test_token_counts_and_cache(spark, odd_docs, odd_rows, no_docs):
    import sentencepiece
    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    cache = shared_path(spark, "cache")
    want = sorted(((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t, _ in odd_rows), key=str)
    first = sorted((tuple(r) for r in tokens.count_tokens(odd_docs.filter("doc_id < 9"), cache, path).collect()), key=str)
    assert first == [w for w in want if w[0] is not None and w[0] < 9]
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for i, t, _ in odd_rows if i is not None and i < 9})
    assert sorted((tuple(r) for r in tokens.count_tokens(odd_docs, cache, path).collect()), key=str) == want
    assert spark.read.parquet(cache).count() == len({t or "" for _, t, _ in odd_rows})  # only misses were added
    assert tokens.count_tokens(no_docs, shared_path(spark, "cache"), path).count() == 0
    other = P.path("byte_bpe_50k.json")  # another version: nothing of the cache fits
    n = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(odd_docs.filter("doc_id IN (1, 9)"), cache, other).collect()}
    assert n[9] == tokens.load_tokenizer(other)("one") and tokens.tokenizer_digest(other) != tokens.tokenizer_digest(path)


def test_special_strings_are_text(spark):
    import sentencepiece
    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["<s> a </s>", "<unk>", "▁▁", "  two  blanks ", "\x00", "日本語\n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(docs, shared_path(spark, "cache"), path).collect()}
    assert got == {i: len(model.encode(t)) for i, t in enumerate(texts)}


# --- language ID

def test_language_held_out(spark):
    got = QUERIES["op4_language"](spark, SF_MID).join(docs_of(spark, SF_MID), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    own = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in own) / len(own) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["rejected"] for r in got) / len(got) < 0.03


def test_language_odd_input(spark, odd_docs, no_docs):
    learned = langid.fit_dictionaries(odd_docs)
    got = langid.predict(odd_docs, learned).collect()
    assert len(got) == odd_docs.count()
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    for r in got:
        if r["doc_id"] in (2, 3, 4, 5):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True), texts[r["doc_id"]]
        elif r["doc_id"] is not None:
            assert r["lang_pred"] in learned
    assert langid.predict(no_docs, learned).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd_docs, langid.fit_dictionaries(no_docs)).collect()} == {"und"}
    assert all(len(v.decode()) <= langid.SHARDS * (langid.PIECE + 1) for v in learned.values())


def test_training_pieces_start_anywhere(spark):
    words = [f"{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{chr(97 + i // 676)}" for i in range(3000)]
    texts = [" ".join(random.Random(k).sample(words, 3000)) for k in range(40)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id int, text string, lang string")
    pieces = langid.fit_dictionaries(docs, piece=100)["x"].decode().split("\n")
    starts = [[t.find(p) for t in texts if p in t] for p in pieces]
    assert all(len(p) == 100 and len(found) == 1 for p, found in zip(pieces, starts))
    assert sum(found[0] > 6000 for found in starts) > len(starts) / 8 and sum(found[0] < 6000 for found in starts) > len(starts) / 8


def test_languages_against_plain_compression(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    learned = langid.fit_dictionaries(docs.filter(langid.fold(F.col("doc_id"), 4) != 2))
    tools = {}
    for lang, content in learned.items():
        raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        settings = zstandard.ZstdCompressionParameters.from_level(
            6, dict_size=len(content), source_size=2048, write_content_size=False, write_checksum=False, write_dict_id=False)
        tools[lang] = zstandard.ZstdCompressor(compression_params=settings, dict_data=raw)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in langid.predict(docs, learned).collect():
        text = texts[r["doc_id"]]
        if not regex.search(r"\p{L}", text or ""):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        data = regex.sub(r"[^\p{L}]+", " ", text.lower()).encode()
        sizes = {lang: sum(len(tool.compress(data[i:i + 2048])) for i in range(0, len(data), 2048)) for lang, tool in tools.items()}
        first, second = sorted((n, lang) for lang, n in sizes.items())[:2]
        assert r["lang_pred"] == first[1]
        assert r["rejected"] == ((second[0] - first[0]) / first[0] < langid.MARGIN)


def test_compression_prefers_its_language():
    tools = langid.Compressors({"a": b"ababab cabacab " * 50, "b": b"xyxyxy zxyzzxy " * 50})
    assert tools.decide("cabacab ababab")[0] == "a" and tools.decide("zxyzzxy " * 3000)[0] == "b"


# --- near duplicates

def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    for _ in range(3):
        a = {int(h): int(c) for h, c in zip(rng.integers(1, 1 << 62, 60), rng.integers(1, 9, 60))}
        b = {h: max(1, c + int(rng.integers(-3, 4))) for h, c in a.items() if rng.random() < 0.8}
        b |= {int(h): 2 for h in rng.integers(1, 1 << 62, 10)}
        true = helpers.similarity(a, b)
        rows = [(i, h, c) for i, s in enumerate((a, b)) for h, c in sorted(s.items())]
        doc, h, c = (np.array(x) for x in zip(*rows))
        m = 4000
        sig = near_dup.bag_minhash(doc.astype(np.int64), h.astype(np.uint64), c.astype(np.int64), 2, m)
        assert abs((sig[0] == sig[1]).mean() - true) < 4 * (true * (1 - true) / m) ** 0.5


def test_shingles_match_plain_ones():
    texts = [PROSE, "", "a", "a b c d", "A,b;C d-e f", "é É ß x y z é É ß x y", PROSE + " " + PROSE, "one two three four five"]
    doc, h, count = shingle_counts([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert sorted(count[doc == i].tolist()) == sorted((helpers.shingles(t) or Counter()).values())
    names = {}
    for i, t in enumerate(texts):
        alone = shingle_counts([t.encode()])
        assert np.array_equal(alone[1], h[doc == i])  # neighbours don't matter
        for s in helpers.shingles(t) or ():
            names.setdefault(s, set()).add(i)
    for x in names.values():  # a shingle of several texts has one hash
        assert len(set.intersection(*(set(h[doc == i].tolist()) for i in x))) > 0


def edited(words, places, rng):
    w = list(words)
    for p in places:
        w[p] = f"new{rng.random()}"
    return " ".join(w)


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = rng.choices(vocabulary, k=150)
    texts = [" ".join(base)] * 3 + [edited(base, rng.sample(range(150), rng.randint(1, 7)), rng) for _ in range(120)]
    texts += [" ".join(rng.choices(vocabulary, k=rng.randint(1, 200))) for _ in range(60)]
    texts += [t.upper() + "!" for t in texts[-5:]] + ["tiny", "Tiny!", "two words", "x x x x x x x x", "x x x x x x x x x"]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs).collect()}
    assert got == dict(enumerate(helpers.classes(texts)))


def test_near_duplicates_odd_input(spark, odd_docs, no_docs):
    got = near_dup.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    of = Counter((r["doc_id"], r["class_id"]) for r in got)
    assert of[(1, 1)] == of[(12, 1)] == 1 and of[(7, 1)] == 2 and of[(None, 1)] == 2  # PROSE, its copies, PROSE + " more"
    assert of[(2, 2)] == of[(3, 3)] == of[(None, None)] == 1  # wordless: alone
    assert near_dup.near_duplicates(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500)]
    df = spark.createDataFrame([(bytes([a // 256, a % 256]), bytes([b // 256, b % 256])) for a, b in links], "a binary, b binary")
    got = {int.from_bytes(r["node"]): int.from_bytes(r["root"]) for r in near_dup.components(df).collect()}
    root = {x: x for p in links for x in p}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert {x: got.get(x, x) for x in root} == root


# --- LM scoring

def test_gradient():
    rng = np.random.default_rng(1)
    flat = attention.initial(rng.integers(1, 100, attention.VOCAB)).astype(np.float64)
    flat += rng.normal(0, 0.2, len(flat))
    ids, targets = rng.integers(0, attention.VOCAB, (3, attention.WINDOW)), rng.integers(0, attention.VOCAB, (3, attention.WINDOW))
    targets[2, 20:] = -1
    g = np.zeros(attention.SIZE)
    loss = lambda f: attention.gradient(attention.views(f), ids, targets, attention.views(np.zeros(attention.SIZE)))
    attention.gradient(attention.views(flat), ids, targets, attention.views(g))
    for i in [*np.argsort(-np.abs(g))[:10], *rng.integers(0, attention.SIZE, 20)]:
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - g[i]) < 1e-6 + 1e-4 * abs(g[i])


@pytest.mark.parametrize("size", [1, 300])  # 300: only with maxima taken off before exp
def test_gradient_with_and_without_maxima(size):
    rng = np.random.default_rng(6)
    flat = attention.initial(np.ones(attention.VOCAB)).astype(np.float64) * size
    ids, targets = rng.integers(0, attention.VOCAB, (2, 40, attention.WINDOW))
    targets[::3, 5:] = -1
    quick, careful = np.zeros(attention.SIZE), np.zeros(attention.SIZE)
    a = attention.gradient(attention.views(flat), ids, targets, attention.views(quick))
    b = attention._gradient(attention.views(flat), ids, targets, attention.views(careful), 1)
    assert np.isfinite(a) and abs(a - b) < 1e-9 * abs(b) and np.allclose(quick, careful, rtol=1e-9, atol=1e-12)


def test_scoring_makes_no_large_arrays_anew():
    rng = np.random.default_rng(7)
    model = attention.Scoring(attention.initial(np.ones(attention.VOCAB)))
    ids, targets = rng.integers(0, attention.VOCAB, (2, 96, attention.WINDOW))
    first = model.log_probs(ids, targets, 4)
    tracemalloc.start()
    again = model.log_probs(ids, targets, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(first, again) and peak < 300_000  # one array of attention weights has 344,064 bytes


def test_training_makes_no_large_arrays_anew():
    rng = np.random.default_rng(8)
    flat = attention.initial(np.ones(attention.VOCAB))
    w, step, grads = attention.views(flat), attention.Training(flat.dtype), np.zeros((2, attention.SIZE), flat.dtype)
    (x, plan), = attention.plans(*rng.integers(0, attention.VOCAB, (2, 32, attention.WINDOW)), 32, flat.dtype)
    step.gradient(w, x, plan, attention.views(grads[0]))
    tracemalloc.start()
    step.gradient(w, x, plan, attention.views(grads[1]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(*grads) and peak < 131_072  # one array of attention weights


def test_training_is_plain_adam_and_leaves_unused_classes():
    rng = np.random.default_rng(9)
    flat = attention.initial(rng.integers(1, 100, attention.VOCAB)).astype(np.float64)
    ids, targets = rng.integers(0, 300, (2, 75, attention.WINDOW))  # two whole batches and a part of one
    targets[::4, 9:] = -1
    got, want, first, second = attention.train(flat, ids, targets, 0.01), flat.copy(), np.zeros(len(flat)), np.zeros(len(flat))
    for s in range(3):
        g, own = np.zeros(len(flat)), slice(32 * s, 32 * s + 32)
        attention.gradient(attention.views(want), ids[own], targets[own], attention.views(g))
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        now = 0.01 * (1 - 0.9 * s / 3) * (1 - 0.99 ** (s + 1)) ** 0.5 / (1 - 0.9 ** (s + 1))
        want -= now * first / (np.sqrt(second) + 1e-8)
    assert np.allclose(got, want, rtol=1e-9, atol=1e-11) and not np.array_equal(got, flat)
    assert np.array_equal(attention.views(got)["emb"][320:], attention.views(flat)["emb"][320:])
    assert np.array_equal(attention.train(flat, ids[:0], targets[:0], 0.01), flat)


def test_scoring_is_the_model_that_was_trained():
    rng = np.random.default_rng(11)
    flat = attention.initial(rng.integers(1, 100, attention.VOCAB)).astype(np.float64)
    flat += rng.normal(0, 0.3, len(flat))
    ids, targets = rng.integers(0, attention.VOCAB, (2, 20, attention.WINDOW))
    targets[::3, 7:] = -1
    loss = attention.gradient(attention.views(flat), ids, targets, attention.views(np.zeros(len(flat))))
    found = [attention.log_probs(flat, ids, np.maximum(targets, 0), skip) for skip in (0, 4)]
    assert abs(loss + found[0][targets >= 0].mean()) < 1e-9 and np.allclose(found[0][:, 4:], found[1], rtol=1e-9)
    assert np.allclose(attention.Scoring(flat).ids[:, 2 * attention.DIM:-1],  # the output's projection is in the values
                       attention.views(flat)["emb"] @ attention.views(flat)["qkv"][:, 2 * attention.DIM:] @ attention.views(flat)["out"])


def test_words_are_split_as_bytes():
    rng = random.Random(10)
    pool = [bytes([i]) for i in range(256)] + [b" ", b"\n", b"\x0b", b"\x1c", b"\x85", b"A", b"\x00"] * 30
    for _ in range(300):
        texts = [b"".join(rng.choices(pool, k=rng.choice([0, 1, 2, 40]))) for _ in range(rng.choice([0, 1, 5]))]
        distinct, which, own = lm.split(texts)
        words = [t.lower().split() for t in texts]
        assert [distinct[i] for i in which] == [w for ws in words for w in ws] and own.tolist() == [len(ws) for ws in words]
        assert len(set(distinct)) == len(distinct)


def test_word_counts_survive_forgetting(spark, monkeypatch):
    monkeypatch.setattr(lm, "CACHE", 5)
    monkeypatch.setattr(lm, "CHUNK", 40)
    texts = [PROSE, "", "the THE the", PROSE, "one"]
    docs = spark.createDataFrame([(t.encode(),) for t in texts], "text binary").coalesce(1)
    rows = lm.gather(docs, (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)).filter("n is not null").collect()
    got, want = Counter(), Counter(w for t in texts for w in t.encode().lower().split())
    for r in rows:
        got[None if r["word"] is None else bytes(r["word"])] += r["n"]
    assert got == want + Counter({None: len(texts)})


def test_subwords_do_not_depend_on_neighbours():
    encode = lm.subword_encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for words in (["the", "end.", "it's", "a1b2", "日本", "...", "é"], ["a\u00a0", "\u00a0b", "\u2003"], ["x"]):
        words = [x.encode() for x in words]
        ids, sizes = encode(words)
        assert sizes.sum() == len(ids)
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        assert [p.tolist() for p in parts] == [encode([x])[0].tolist() for x in words]


def test_extreme_weights_stay_finite():
    flat = attention.initial(np.ones(attention.VOCAB)) * 300
    ids = np.random.default_rng(5).integers(0, attention.VOCAB, (4, attention.WINDOW))
    assert np.isfinite(attention.log_probs(flat, ids, ids, 0)).all()


def test_probabilities_are_causal_and_sum_to_one():
    rng = np.random.default_rng(2)
    w = attention.views(attention.initial(np.ones(attention.VOCAB)) + rng.normal(0, 0.3, attention.SIZE).astype(np.float32))
    ids = rng.integers(0, attention.VOCAB, (1, attention.WINDOW))
    every = np.tile(ids, (attention.VOCAB, 1))
    targets = np.tile(np.arange(attention.VOCAB)[:, None], (1, attention.WINDOW))
    assert np.allclose(np.exp(attention.log_probs(w, every, targets, 0)).sum(0), 1, atol=1e-4)
    later = ids.copy()
    later[0, 20:] = 0
    a, b = (attention.log_probs(w, x, ids, 0)[0] for x in (ids, later))
    assert np.array_equal(a[:20], b[:20]) and not np.array_equal(a[20:], b[20:])


def test_context_reaches_back_a_whole_window():
    assert (attention.WINDOW, attention.STRIDE) == (32, 28)  # not to be cut for a budget
    rng = np.random.default_rng(4)
    w = attention.views(attention.initial(np.ones(attention.VOCAB)) + rng.normal(0, 0.3, attention.SIZE).astype(np.float32))
    ids = rng.integers(0, attention.VOCAB, (1, attention.WINDOW))
    other = ids.copy()
    other[0, 0] = (ids[0, 0] + 1) % attention.VOCAB
    a, b = (attention.log_probs(w, x, ids, 0)[0] for x in (ids, other))
    assert attention.WINDOW >= 32 and a[31] != b[31]  # the 32nd prediction sees the first id


def test_every_subword_is_scored_once():
    encoder = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = np.random.default_rng(3)
    flat = attention.initial(np.ones(attention.VOCAB)) + rng.normal(0, 0.3, attention.SIZE).astype(np.float32)
    s = lm.Scorer(encoder, np.arange(attention.VOCAB), flat, {b"the": 5})
    w = attention.views(flat)
    texts = [PROSE.encode() * k for k in (1, 3)] + [b"", b" \n", "日本語 É the THE".encode()]
    own, known, base, got, rare = s.score(texts)
    encode = lm.subword_encoder(*encoder)
    for i, t in enumerate(texts):
        words = t.lower().split()
        ids = [x for word in words for x in encode([word])[0]]
        seq, total = np.array([lm.END, *ids, lm.END]), 0.0
        for at in range(len(seq) - 1):  # each target alone, in the first window that holds it
            start = max(0, -(-(at - attention.WINDOW + 1) // attention.STRIDE)) * attention.STRIDE
            row = np.zeros((1, attention.WINDOW), np.int64)
            row[0, :at - start + 1] = seq[start:at + 1]
            total += attention.log_probs(w, row, np.full((1, attention.WINDOW), seq[at + 1]), 0)[0, at - start]
        assert abs(got[i] - total / math.log(10)) < 1e-3 * max(1, abs(total))
        assert own[i] == len(words) and known[i] == words.count(b"the") and sorted(rare[i]) == sorted(x for x in words if x != b"the")
    assert np.allclose(s.score(texts[::-1])[3][::-1], got, rtol=1e-5)  # neighbours don't matter


def test_training_windows_cover_every_text(spark, monkeypatch):
    monkeypatch.setattr(lm, "PACK", 7)
    encoder = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    texts = ["", "one", " ".join(f"w{i}" for i in range(150)), " ".join(f"long{i} x" for i in range(9000)), "one", PROSE]
    docs = spark.createDataFrame([(t.encode(),) for t in texts], "text binary")
    packs = lm.gather(docs.coalesce(1), encoder).filter("win is not null").select("win", "at").toArrow()
    wins = [r for p in packs.column("win") for r in lm._matrix([p]).tolist()]
    encode, want = lm.subword_encoder(*encoder), Counter()
    for t in texts:
        seq = [lm.END, *(encode(t.lower().encode().split())[0].tolist() if t else []), lm.END]
        for i in range(0, len(seq) - 1, attention.WINDOW):
            w = seq[i:i + attention.WINDOW + 1]
            want[(*w, *[-1] * (attention.WINDOW + 1 - len(w)))] += 1
    assert Counter(map(tuple, wins)) == want  # the rounds together: all ids of all texts, each a target once
    per_round = Counter()
    for p, k in zip(packs.column("win"), packs.column("at").to_pylist()):
        per_round[k] += len(lm._matrix([p]))
    assert len(per_round) == len(lm.RATES) and max(per_round.values()) - min(per_round.values()) <= 1


@pytest.mark.parametrize("heavy", [1_000_000, 50])
def test_lm_scores(spark, heavy, monkeypatch):
    monkeypatch.setattr(lm, "HEAVY", heavy)
    docs = docs_of(spark, SF_SMALL)
    rows, got = docs.select("doc_id", "text").collect(), QUERIES["op7_lm_score"](spark, SF_SMALL).collect()
    got = {r["doc_id"]: r for r in got}
    c, ends = Counter(), 0
    out = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 for r in rows}
    for r in rows:
        if not out[r["doc_id"]]:
            c.update(r["text"].encode().lower().split())
            c[None] += 1
    n, v = sum(c.values()), len(c)
    for r in rows:
        t, g = [*r["text"].encode().lower().split(), None], got[r["doc_id"]]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (out[r["doc_id"]], len(t), sum(c[w] > 0 for w in t), n)
        assert abs(g["base_score"] - sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) < 1e-6 * len(t)
        assert g["score"] < 0


def test_lm_learns(spark):
    windows = lm.gather(docs_of(spark, SF_MID).select(F.xxhash64("doc_id").alias("deal"), F.col("text").cast("binary").alias("text")),
                        (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)).filter("win is not null").select("win", "at")
    rank, flat = lm.fit_attention(windows)
    ids = lm._matrix(windows.toArrow().column("win"))
    ids = np.where(ids >= 0, rank[ids], -1)
    x, y = np.maximum(ids[:, :-1], 0), ids[:, 1:]
    start = attention.initial(np.bincount(y[y >= 0], minlength=attention.VOCAB).astype(float))
    loss = lambda f: -attention.log_probs(attention.views(f), x, np.maximum(y, 0), 0)[y >= 0].mean()
    assert loss(flat) < 0.9 * loss(start)


def test_lm_odd_input(spark, odd_docs, no_docs):
    args = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = lm.score_texts(odd_docs, odd_docs, *args).collect()
    assert len(got) == odd_docs.count() and all(np.isfinite([r["base_score"], r["score"]]).all() for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 4)} == {1}
    same = [(r["n_known"], round(r["base_score"], 9), round(r["score"], 3)) for r in got if r["doc_id"] == 7 and r["n_tokens"] > 10]
    assert len(same) == 2 and same[0] == same[1]
    untrained = lm.score_texts(odd_docs, no_docs, *args).collect()
    assert {(r["train_tokens"], r["n_known"], r["base_score"]) for r in untrained} == {(0, 0, 0.0)}
    assert lm.score_texts(no_docs, odd_docs, *args).count() == 0


# --- toxicity

def test_toxicity_held_out(spark):
    docs = docs_of(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.1").join(labels, "doc_id").collect()
    own = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got) and docs.count() == 10_000
    caught = [r["predicted"] for r in own if r["toxic"] == 1]
    blamed = [r["predicted"] for r in own if r["toxic"] == 0]
    assert sum(caught) / len(caught) > 0.75 and sum(blamed) / len(blamed) < 0.03  # a fifth of these labels is noise


def test_toxicity_learns_words(spark):
    rng = random.Random(6)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "re", "tu") for b in ("n", "s", "t", "ra", "po")]
    rows, labels = [], []
    for i in range(400):
        t, bad = rng.choices(vocabulary, k=rng.randint(5, 60)), i % 8 == 0
        if bad:
            t[rng.randrange(len(t))] = rng.choice(["Vilegrub", "wretchling"])
        rows.append((i, " ".join(t), "x"))
        labels.append((i, int(bad), "x"))
    docs, lab = spark.createDataFrame(rows, "doc_id bigint, text string, y string"), spark.createDataFrame(labels, "doc_id bigint, toxic int, text string")
    model = toxicity.fit(docs.filter("doc_id < 300"), lab)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.3) == bool(y) for i, y, _ in labels if i >= 300)


def test_toxicity_odd_input(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (7, None), (6, 0), (None, 1), (99, 1), (9, 0)], "doc_id bigint, toxic int")
    model = toxicity.fit(odd_docs, labels)
    got = toxicity.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(no_docs, model).count() == 0
    for y, want in ((0, 0.0), (1, 1.0)):
        one = toxicity.fit(odd_docs, labels.filter(F.col("toxic") == y))
        assert {r["score"] for r in toxicity.score(odd_docs, one).collect()} == {want}
    assert {r["score"] for r in toxicity.score(odd_docs, toxicity.fit(odd_docs, labels.limit(0))).collect()} == {0.0}


def test_grams_of_parts(monkeypatch):
    text = ("Abc dé " * 40).encode()
    whole = np.sort(np.concatenate(list(toxicity.grams(text))))
    assert len(whole) == sum(len(text.decode()) - n + 1 for n in toxicity.GRAMS)
    monkeypatch.setattr(toxicity, "CHUNK", 37)
    assert np.array_equal(np.sort(np.concatenate(list(toxicity.grams(text)))), whole)


def plain_toxicity(rows, texts):
    """Scores of ``texts`` after learning from (text, y) rows: counts, choice, ratios and regression in plain steps."""
    def held(t):
        t = t.translate(helpers.UPPER)
        out = set()
        for n in toxicity.GRAMS:
            for i in range(len(t) - n + 1):
                h = 0
                for c in t[i:i + n]:
                    h = (h * 0x9E3779B97F4A7C15 + mixed((ord(c) + 1) * 0x9E3779B97F4A7C15)) % 2 ** 64
                out.add(mixed((h + n - 1) % 2 ** 64) >> (64 - toxicity.HASH_BITS))
        return out

    def mixed(x):
        x %= 2 ** 64
        x ^= x >> 33
        x = x * 0xFF51AFD7ED558CCD % 2 ** 64
        x ^= x >> 33
        x = x * 0xC4CEB9FE1A85EC53 % 2 ** 64
        return x ^ (x >> 33)

    sets = [(held(t), y) for t, y in rows]
    n1, n0 = sum(y for _, y in sets), sum(1 - y for _, y in sets)
    p, q = (Counter(g for s, y in sets if y == k for g in s) for k in (1, 0))
    ranked = []
    for g in {*p, *q}:
        if p[g] + q[g] >= toxicity.MIN_DOCS:
            share = (p[g] + q[g]) / (n1 + n0)
            z = abs(p[g] / n1 - q[g] / n0) / math.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
            ranked.append((-z, g, math.log((p[g] + 1) / (n1 + 2)) - math.log((q[g] + 1) / (n0 + 2))))
    best = sorted(ranked)[:toxicity.N_FEATURES]
    x = np.array([[r * (g in s) for _, g, r in best] + [1.0] for s, _ in sets])
    y = np.array([float(k) for _, k in sets])
    penalty = np.array([toxicity.L2 * len(y) / 100] * len(best) + [1e-6])
    w = np.zeros(len(best) + 1)
    for _ in range(60):  # plain Newton steps, halved while the loss grows
        loss = lambda v: np.logaddexp(0, x @ v).sum() - y @ (x @ v) + (penalty * v * v).sum() / 2
        prob = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (prob * (1 - prob))[:, None]).T @ x + np.diag(penalty), x.T @ (prob - y) + penalty * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return [1 / (1 + math.exp(-(sum(v * r for v, (_, g, r) in zip(w, best) if g in held(t)) + w[-1]))) for t in texts]


def test_toxicity_against_a_plain_version(spark):
    rng = random.Random(5)
    soft, hard = ["garden", "früh", "river", "stone", "quiet"], ["vile", "schlimm", "HATE", "brute", "quiet"]
    rows = [(i, " ".join(rng.choice(hard if i % 3 == 0 and rng.random() < .6 else soft) for _ in range(rng.randint(0, 6)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    want = plain_toxicity([(t, int(i % 3 == 0)) for i, t in rows[:200]], [t for _, t in rows])
    assert [got[i] for i in range(300)] == pytest.approx(want, abs=2e-3)


def test_toxicity_labelled_texts_without_grams(spark):
    texts = ["bad words here", "", "good words here", None, "a", "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (3, 1), (4, 0), (5, 1)], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert len(got) == 6 and got[1] == got[3] == got[4] == got[5]
    assert all(0 <= s <= 1 for s in got.values())


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    docs = spark.range(10_000).select(F.lit(1).cast("bigint").alias("doc_id"), F.concat(F.lit("some text "), (F.col("id") % 5_000).cast("string")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(2, "other text")] * 3_000, "doc_id bigint, text string"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id bigint, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "written", lambda df, name: seen.append(df.cache()) or seen[-1])
    toxicity.fit(docs, labels, max_train=3)
    assert seen[0].count() <= 3
    toxicity.fit(docs, labels)
    assert sorted(r["count"] for r in seen[1].groupBy("id").count().collect()) == [1, 5_000]  # copies once
