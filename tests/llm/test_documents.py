"""Operators on texts against brute force: over the smallest documents table, and over nulls, empty and long texts,
ties, repeated rows, empty tables and extra columns with clashing names."""

import hashlib
import random
import re
import textwrap
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridspark.llm import byte_bpe, crf_pii, debruijn, exact_dedup, license_scan, masked_lm, packing, prob_minhash, quality, store, token_ids
from gridspark.llm.store import Scratch
from gridspark.llm.words import PRIME, Words, prefix, times

SF = entry.SMOKE_DIR
PATTERN = public_tokenizers.PATTERN
MULTI, SINGLE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.tiktoken")
SPACE = re.compile(r"[\x20\x09-\x0D]+")

_random = random.Random(5)
SENTENCE = " ".join(_random.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(_random.randint(0, 99)) for _ in range(60))
LONG = " ".join(f"w{_random.randint(0, 10**6)}" for _ in range(40_000))
TEXTS = [
    (1, SENTENCE), (2, SENTENCE.replace(" ", "\n ", 3)), (3, None), (4, ""), (5, " \t\n"), (6, LONG), (7, "short"), (8, "short"), (7, "short"),
    (None, SENTENCE), (None, None), (9, "x" * 5000), (10, "Füße – naïve 日本語 🙂 mail a.b@x.org, +1 (555) 123-4567, 10.0.0.1"), (11, SENTENCE + " tail " + SENTENCE), (12, "a\x1cb\xa0c d"),
]


@pytest.fixture(scope="module")
def edge(spark):
    """Extra columns that the operators use names like inside."""
    rows = [(i, t, "en", "s", n, "x", 1.0, 2, "y") for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, score double, id int, found string").repartition(3)


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return entry.queries()[name](spark, SF).collect()


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


# exact dedup


def brute_exact(texts):
    groups = defaultdict(list)
    for i, t in texts:
        groups[sha(SPACE.sub(" ", t or ""))].append(i)
    keep = {h: min((i for i in g if i is not None), default=None) for h, g in groups.items()}
    return sorted(((i, keep[h], len(groups[h]), i == keep[h], h) for i, t in texts for h in [sha(SPACE.sub(" ", t or ""))]), key=repr)


@pytest.mark.parametrize("counters", [1, 2, 2048])
def test_exact_dedup(edge, counters):
    got = exact_dedup.exact_dedup(edge, counters)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_exact(TEXTS)


def test_exact_keep_first(edge, empty):
    kept = exact_dedup.keep_first(edge)
    assert kept.columns == edge.columns
    want = {(i, h) for i, k, _, stays, h in brute_exact(TEXTS) if stays}
    assert sorted(((r["doc_id"], sha(SPACE.sub(" ", r["text"] or ""))) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert exact_dedup.keep_first(empty).count() == exact_dedup.exact_dedup(empty).count() == 0


def test_misra_gries_keeps_every_frequent_key():
    keys = [0] * 400 + [1] * 300 + list(range(2, 302))
    random.Random(1).shuffle(keys)
    kept = {}
    for i in range(0, 1000, 50):
        for k in keys[i:i + 50]:
            kept[k] = kept.get(k, 0) + 1
        kept = exact_dedup.reduce_counts(kept, 4)
    assert {0, 1} <= set(kept) and len(kept) <= 4


# byte-level BPE


def tiktoken_encoding(path):
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_query(spark, docs):
    encoding = tiktoken_encoding(MULTI)
    for r in run(spark, "op2_byte_bpe"):
        ids = encoding.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(docs[r["doc_id"]]))


def test_bpe_edge(edge, empty):
    encoding = tiktoken_encoding(MULTI)
    tokens = byte_bpe.encode(edge, MULTI, PATTERN)
    got = byte_bpe.decode(tokens, MULTI, PATTERN).collect()
    want = sorted((repr(i), encoding.encode_ordinary(t or "")) for i, t in TEXTS)
    assert sorted((repr(r["doc_id"]), r["ids"]) for r in got) == want
    assert sorted(bytes(r["decoded"]) for r in got) == sorted((t or "").encode() for _, t in TEXTS)
    assert byte_bpe.decode(byte_bpe.encode(empty, MULTI, PATTERN), MULTI, PATTERN).count() == 0


def test_bpe_long_words_merge_alike():
    words, encoding = byte_bpe.vocabulary(MULTI, PATTERN), tiktoken_encoding(MULTI)
    for n in range(2, 200, 7):
        word = "".join(_random.choice("abehtionsr") for _ in range(n))
        assert np.frombuffer(words.merge_long(word.encode()), "<i4").tolist() == encoding.encode_ordinary(word)
        assert words.merge([word.encode()])[0] == words.merge_long(word.encode())


def test_bpe_decodes_without_queries(monkeypatch):
    """Nulls, ids outside the vocabulary, sliced lists and long lists."""
    import pyarrow as pa

    words = byte_bpe.vocabulary(MULTI, PATTERN)
    monkeypatch.setattr(words, "db", None)
    monkeypatch.setattr(byte_bpe, "TOKENS", 3)
    piece = {rank: token for token, rank in words.ranks.items()}
    lists = [[1, 2], [], [300, None, -1, 10**6, 301], [7] * 9, [], [8]]
    want = [b"".join(piece.get(i, b"") for i in x) for x in lists]
    array = pa.array(lists, pa.list_(pa.int32()))
    assert words.decode(array) == want and words.decode(array.slice(2, 3)) == want[2:5] and words.decode(array.slice(0, 0)) == []


def test_bpe_queries_are_bounded():
    """One text of 4 million tokens, and a batch of many words of nearly the greatest length."""
    import pyarrow as pa

    words, encoding, rng = byte_bpe.vocabulary(MULTI, PATTERN), tiktoken_encoding(MULTI), np.random.default_rng(6)
    values = np.array(list(words.ranks.values()), np.int32)
    ids = rng.choice(values, 4_000_000)
    got = words.decode(pa.ListArray.from_arrays(pa.array([0, 3, 3, len(ids)], pa.int32()), pa.array(ids)))
    assert got == [encoding.decode_bytes(ids[:3].tolist()), b"", encoding.decode_bytes(ids[3:].tolist())]
    long = {"".join(map(chr, rng.integers(97, 123, 250))) for _ in range(4_500)}
    known = words.known(long)
    for word in list(long)[::1000]:
        assert np.frombuffer(known[word], "<i4").tolist() == encoding.encode_ordinary(word)


# near duplicates


def shingle_sets(texts, k=5):
    out = {}
    for i, t in texts:
        w = (t or "").encode().split()
        out[i] = {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    return out


def brute_classes(texts, threshold=0.8):
    sets = shingle_sets(texts)
    at, parent = defaultdict(list), {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    common = Counter((a, b) for ids in at.values() for n, a in enumerate(ids) for b in ids[n + 1:])
    for (a, b), n in common.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def test_near_dedup_query(spark, docs):
    got = {r["doc_id"]: r["class_id"] for r in run(spark, "op3_near_dedup")}
    assert got == brute_classes(docs.items())


def test_near_dedup_continuum(spark):
    """A large group of copies with more and more edits: links between any of its texts count."""
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    texts = []
    for i in range(300):
        words = list(base)
        for at in rng.sample(range(120), i % 7):
            words[at] = f"e{rng.randint(0, 10**6)}"
        texts.append((i, " ".join(words)))
    got = {r["doc_id"]: r["class_id"] for r in prob_minhash.near_dedup(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_classes(texts)


def crowd(n, seed):
    """Copies of one text with up to six edits each, families that share edits, and shorter and longer versions."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    families = [[(at, f"f{family}-{at}") for at in rng.sample(range(150), 7)] for family in range(4)]
    texts = []
    for i in range(n):
        words = list(base)
        for at, word in families[i % 4] if i % 9 == 0 else []:
            words[at] = word
        for at in rng.sample(range(150), rng.choice([1, 2, 2, 3, 3, 4, 5, 6]) if i % 9 else rng.choice([0, 1, 2])):
            words[at] = f"e{rng.randint(0, 10**6)}"
        if i % 11 == 0:
            words = words[:rng.randint(100, 149)]
        if i % 13 == 0:
            words += [f"l{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 40))]
        texts.append((i, " ".join(words)))
    return texts


def test_near_dedup_compares_a_crowd_in_proportion(spark, monkeypatch):
    """What a large group of near copies has in common makes no pairs; links beside its pivots count."""
    texts, compared = crowd(500, 6), []
    plain = prob_minhash.similarities
    monkeypatch.setattr(prob_minhash, "similarities", lambda pairs, *rest: compared.append(pairs.select("a", "b").distinct().count()) or plain(pairs, *rest))
    got = {r["doc_id"]: r["class_id"] for r in prob_minhash.near_dedup(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_classes(texts)
    assert compared[-1] < 4 * len(texts)


def test_near_dedup_with_many_pivots(spark, monkeypatch):
    monkeypatch.setattr(prob_minhash, "CROWD", 1, raising=False)
    texts = crowd(120, 7) + [(1000 + i, t) for i, t in crowd(120, 8)]
    got = {r["doc_id"]: r["class_id"] for r in prob_minhash.near_dedup(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), threshold=0.6).collect()}
    assert got == brute_classes(texts, 0.6)


def test_near_dedup_repeated_junk(spark):
    """Pairs at Jaccard 0.8 to 0.9 whose own shingles occur 20 to 100 times."""
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    texts = []
    for pair in range(40):
        shared, n = fresh(800), rng.choice([20, 50, 100])
        texts += [(2 * pair + side, " ".join(shared + fresh(rng.randint(45, 90)) * n)) for side in (0, 1)]
    want = brute_classes(texts)
    assert sum(i == c for i, c in want.items()) == 40
    got = {r["doc_id"]: r["class_id"] for r in prob_minhash.near_dedup(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()}
    assert got == want


def test_near_dedup_edge(edge, empty):
    got = Counter((r["doc_id"], r["class_id"], r["kept"]) for r in prob_minhash.near_dedup(edge).collect())
    assert got == Counter({(1, 1, True): 1, (2, 1, False): 1, (3, 3, True): 1, (4, 4, True): 1, (5, 5, True): 1, (6, 6, True): 1, (7, 7, True): 2, (8, 7, False): 1,
                           (None, 1, False): 1, (None, None, True): 1, (9, 9, True): 1, (10, 10, True): 1, (12, 12, True): 1, (11, 1, False): 1})
    assert prob_minhash.keep_one(edge).columns == edge.columns
    assert prob_minhash.near_dedup(empty).count() == 0


def test_near_dedup_texts_of_one_id(spark):
    """Different texts of a doc_id have links of their own, and one of each class stays."""
    x, y = ([f"{c}{n}" for n in range(60)] for c in "xy")
    rows = [(1, " ".join(x)), (7, " ".join(x + ["z"])), (7, " ".join(y)), (9, " ".join(y + ["q"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter((r["doc_id"], r["class_id"], r["kept"]) for r in prob_minhash.near_dedup(df).collect()) == Counter([(1, 1, True), (7, 1, False), (7, 7, True), (9, 7, False)])
    assert sorted((r["doc_id"], r["text"]) for r in prob_minhash.keep_one(df).collect()) == sorted([rows[0], rows[2]])
    assert {r["text"] for r in prob_minhash.keep_one(df.filter(F.col("doc_id") < 8).filter(~F.col("text").endswith("z") | (F.col("doc_id") == 7))).collect()} == {rows[0][1], rows[2][1]}


def thue_morse(n):
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_and_runs_that_differ_have_different_hashes(spark):
    """Words, and runs of words, that polynomials modulo a power of two cannot tell apart."""
    a, b = thue_morse(10)
    near = spark.createDataFrame([(1, " ".join([a] * 5)), (2, " ".join([b] * 5))], "doc_id long, text string")
    assert {r["class_id"] for r in prob_minhash.near_dedup(near).collect()} == {1, 2}
    texts = {1: " ".join([a] + [f"w{n}" for n in range(40)]), 2: " ".join([f"w{n}" for n in range(40)][:20] + [b] + [f"w{n}" for n in range(20, 40)])}
    texts |= {3: " ".join([a, *a[:40]]), 4: " ".join([b, *a[:40]]), 5: " ".join(["p", *a, *"xyz"]), 6: " ".join(["p", *b, *"xyz"])}
    got = debruijn.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).withColumn("h", F.sha2(F.col("kept_text").cast("binary"), 256))
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "h").collect()), key=repr) == brute_repeats(texts.items())


def test_polynomials_are_modulo_a_prime():
    rng = np.random.default_rng(4)
    a, b = (np.concatenate([rng.integers(0, PRIME, 500, dtype=np.uint64), np.array([0, 1, PRIME - 1], np.uint64)]) for _ in range(2))
    assert times(a, b).tolist() == [int(x) * int(y) % PRIME for x, y in zip(a, b)]
    sums, base, total, want = prefix(a, 12345), 12345, 0, [0]
    for k, x in enumerate(a.tolist()):
        total = (total + x * pow(base, k, PRIME)) % PRIME
        want.append(total)
    assert sums.tolist() == want


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(2)
    value = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.exponential(1, 300), rng.exponential(1, 300)
    text = np.repeat([0, 1], 300)
    found = prob_minhash.registers(text, np.tile(value, 2), np.concatenate([a, b]), 2, 4000)
    p, q = a / a.sum(), b / b.sum()
    exact = sum(1 / np.maximum(p / p[i], q / q[i]).sum() for i in range(300))
    assert abs((found[0] == found[1]).mean() - exact) < 0.04


# substring dedup


def brute_repeats(texts, k=35):
    words = [(i, (t or "").encode().split()) for i, t in texts]
    seen = Counter(tuple(w[j:j + k]) for _, w in words for j in range(len(w) - k + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if seen[tuple(w[j:j + k])] > 1:
                gone[j:j + k] = [True] * k
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out, key=repr)


def test_substring_query(spark, docs):
    assert sorted(map(tuple, run(spark, "op5_substring_dedup")), key=repr) == brute_repeats(docs.items())


@pytest.mark.parametrize("k", [1, 2, 3, 35])
def test_substring_edge(edge, empty, k):
    got = debruijn.remove_repeats(edge, k).withColumn("h", F.sha2(F.col("kept_text").cast("binary"), 256)).select("doc_id", "n_words", "n_removed", "h")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_repeats(TEXTS, k)
    assert debruijn.remove_repeats(empty, k).count() == 0


def test_substring_shifted_passages(spark):
    """Passages of all lengths around the window, at any place, overlapping and self-repeating."""
    rng = random.Random(9)
    passages = [[f"p{n}x{j}" for j in range(n)] for n in (33, 34, 35, 36, 50, 90)]
    texts = []
    for i in range(60):
        words = []
        for _ in range(4):
            words += [f"u{rng.randint(0, 10**9)}" for _ in range(rng.randint(0, 20))]
            p = rng.choice(passages)
            a = rng.randint(0, 5)
            words += p[a:len(p) - rng.randint(0, 5)]
        texts.append((i, " ".join(words)))
    texts.append((100, "same " * 200))
    got = debruijn.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string").repartition(5)).withColumn("h", F.sha2(F.col("kept_text").cast("binary"), 256))
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "h").collect()), key=repr) == brute_repeats(texts)


def test_substring_texts_without_id_of_equal_hash(spark):
    """Two texts with a null doc_id and the same 32-bit hash, one of them with a repeated passage."""
    passage = " ".join(f"p{j}" for j in range(40))
    a = spark.range(300_000).select(F.concat(F.lit(passage + " a"), "id").alias("a")).withColumn("h", F.hash("a"))
    b = spark.range(300_000).select(F.concat(F.lit(" ".join(f"u{j}" for j in range(50)) + " b"), "id").alias("b")).withColumn("h", F.hash("b"))
    pairs = a.join(b, "h").limit(3).collect()
    assert pairs
    texts = [(1, passage)] + [(None, r[c]) for r in pairs[:1] for c in "ab"]
    got = debruijn.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string")).withColumn("h", F.sha2(F.col("kept_text").cast("binary"), 256))
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "h").collect()), key=repr) == brute_repeats(texts)


# PII

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_base(text):
    def luhn(d):
        total = 0
        for n, c in enumerate(reversed(d)):
            x = int(c) * (1 + n % 2)
            total += x - 9 if x > 9 else x
        return total % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


def test_base_spans():
    rng = random.Random(4)
    pieces = ["a@b.c", "x.y+z@h-1.org.", "@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0010.0.0.1", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 123-4567", "+1+2 34 567 890 12", "..", " ", "a", "7", "-", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 8)))
        assert crf_pii.base_spans(text) == brute_base(text), text
    assert crf_pii.base_spans("7" * 200_000) == []
    assert crf_pii.base_spans("a" * 200_000) == []


def test_pii_query(spark, docs):
    for r in run(spark, "op6_pii"):
        base = brute_base(docs[r["doc_id"]])
        line = ",".join(f"{crf_pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r["base_sha256"] == sha(line)
        assert [r[f"n_{k}"] for k in crf_pii.KINDS] == [sum(x[1] == n for x in base) for n in range(4)]
        assert set(filter(None, line.split(","))) <= set(r["spans"].split(","))


def test_field_learns_and_decodes():
    words = ["+1", "(555)", "123-4567", "10.1.1.1", "a@b.org", "12345", "3.5"]
    labels = {"+1": 4, "(555)": 4, "123-4567": 4, "10.1.1.1": 2, "a@b.org": 1, "12345": 0, "3.5": 0}
    table = [([f for w in s for f in crf_pii.word_features(w)], [labels[w] for w in s], 10) for s in (words[:3], words[3:4], words[4:5], words[5:6], words[6:7], words[3:6])]
    field = crf_pii.fit(table)
    for s in (["+2", "(777)", "999-1234"], ["(555)", "123-4567"]):
        features = np.array([crf_pii.word_features(w) for w in s])[None]
        assert (field.decode(features)[0] == 4).all()
    # Viterbi against all paths
    rng = np.random.default_rng(0)
    field = crf_pii.Field(rng.normal(size=(crf_pii.FEATURES, 5)), rng.normal(size=(5, 5)))
    features = rng.integers(0, crf_pii.FEATURES, (1, 4, crf_pii.N_FEATURES))
    scores = field.emit[features].sum(axis=2)[0]
    paths = np.stack(np.meshgrid(*[range(5)] * 4, indexing="ij"), -1).reshape(-1, 4)
    value = scores[np.arange(4), paths].sum(1) + field.step[paths[:, :-1], paths[:, 1:]].sum(1)
    assert (field.decode(features, 0.0)[0] == paths[value.argmax()]).all()


ADDED = {
    "call (555) 123-4567 or 030 1234567": ["(555) 123-4567", "030 1234567"], "ring 555-867-5309 please": ["555-867-5309"], "john at example.org": ["john at example.org"],
    "rr, 4465758382889437 4465758382889437 ab": ["4465758382889437", "4465758382889437"], 'x y token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"### z': ["f33e61083db5dbdf4bd2369d2f80176e57f7fda2"],
    "my password: hunter22 is": ["hunter22"], "a@b": [], "10.0.0.300": [], "version 1.2.3": [], "in 1999 and 2003 we had 300 units": [], "look at example.org": [], "order 1234567890": [],
    "ISBN 978-3-16-148410-0": [], "2024-05-06 10:30:00": [], "pi is 3.14159265358979": [], "12345678901234567890 things": [], "x" * 3000 + "7" * 3000: [], "": [],
}


def test_field_adds_what_patterns_miss_and_leaves_numbers_alone():
    field, texts = crf_pii.train(), list(ADDED)
    for text, (base, added) in zip(texts, crf_pii.spans_of(pa.array(texts), field)):
        assert [text[a:b] for a, _, b in added] == ADDED[text], text
        assert base == brute_base(text)


def test_labelled_phrases():
    phrases = crf_pii.labelled_phrases(["call [phone|0## ###] and [card|####] at {o}"], versions=3)
    assert len({text for text, _ in phrases}) == 3
    for text, ((a, k, b), (c, m, d)) in phrases:
        assert re.fullmatch("0[0-9]{2} [0-9]{3}", text[a:b]) and re.fullmatch("[0-9]{4}", text[c:d]) and (k, m) == (3, 2)
    assert all(0 <= a < b <= len(text) for text, spans in crf_pii.labelled_phrases() for a, _, b in spans)
    assert crf_pii.labelled_phrases() == crf_pii.labelled_phrases()


def test_segments_are_read_alike_alone_and_remembered():
    """Features from the memory of words equal those of the words themselves; long words are told by both ends."""
    words = ["token", "=", '"ab12"', "call", "me", "at", "5551234"]
    two, one = "", ""
    for w in words:
        assert crf_pii._features_of(w, one, two) == crf_pii.word_features(w, one, two)
        two, one = one, w
    middle = "5" * 200
    assert crf_pii.word_features("a" + middle + "b") != crf_pii.word_features("a" + middle + "@b.c")


def test_pii_edge(edge, empty):
    field = crf_pii.train()
    got = crf_pii.find_pii(edge, field).collect()
    assert len(got) == len(TEXTS)
    spans = next(r["spans"] for r in got if r["doc_id"] == 10)
    text = dict(TEXTS)[10]
    assert [text[s["start"]:s["end"]] for s in spans if s["base"]] == ["a.b@x.org", "+1 (555) 123-4567", "10.0.0.1"]
    hidden = crf_pii.redact(edge, field)
    assert hidden.columns == edge.columns
    row = next(r for r in hidden.collect() if r["doc_id"] == 10)
    assert row["text"] == "Füße – naïve 日本語 🙂 mail [EMAIL], [PHONE], [IP]" and row["n_chars"] == len(row["text"])
    assert crf_pii.find_pii(empty, field).count() == crf_pii.redact(empty, field).count() == 0


# licences


def test_licence_inheritance(spark):
    notice = "Released under the MIT License."
    files = [("a/LICENSE", notice), ("a/b/x", "code"), ("a/b/y", "text " * 40 + "\nLicensed under the Apache License, Version 2.0."), ("a/b/c/z", None), ("c/x", ""), (None, "q"), ("top", "r"), ("a/b/x", "code")]
    df = spark.createDataFrame([(*f, "n", 1) for f in files], "path string, text string, license string, row int")
    got = Counter((r["path"], r["license"], r["origin"]) for r in license_scan.scan(df).collect())
    assert got == Counter({("a/LICENSE", "MIT", "own"): 1, ("a/b/x", "MIT", "a"): 2, ("a/b/y", "Apache-2.0", "own"): 1, ("a/b/c/z", "MIT", "a"): 1,
                           ("c/x", None, None): 1, (None, None, None): 1, ("top", None, None): 1})
    assert license_scan.scan(df.limit(0)).count() == 0


def wrapped(text, width=70, sign=""):
    return "\n".join(f"{sign}{line}" for line in textwrap.wrap(text, width))


def test_whole_licences_and_headers(spark):
    """Licence files as they lie in directories, the same on one line, wrapped headers in comments, and ties."""
    texts = dict(reversed(license_scan.TEXTS))  # the first text of each licence
    mit = "MIT License\n\nCopyright (c) 2019 Some Person\n\n" + wrapped(texts["MIT"])
    gnu = {name: "# Copyright (C) 2020 Someone\n#\n" + wrapped(texts[name], sign="# ") + "\n\nimport os\n" + "code = data + more " * 200 for name in ("GPL-3.0", "GPL-2.0", "LGPL-3.0", "AGPL-3.0")}
    files = [("a/LICENSE", mit), ("a/x.py", "code"), ("b/notes", " ".join(mit.split())), ("b/y", "code"), ("c/COPYING", texts["Apache-2.0"] + " more words " * 3000), ("c/z", None),
             ("d/1.py", gnu["GPL-3.0"]), ("d/2.py", gnu["GPL-2.0"]), ("d/3.py", gnu["LGPL-3.0"]), ("d/4.py", gnu["AGPL-3.0"]), ("d/5.py", "word " * 40_000 + wrapped(texts["ISC"]) + " end" * 40_000),
             ("e/LICENSE", wrapped(texts["BSD-3-Clause"])), ("f/LICENSE", wrapped(texts["BSD-2-Clause"])), ("g/q", "the software license permission of nobody in particular"),
             ("h/two", "Released under the MIT License. Licensed under the Apache License, Version 2.0."), ("h/x", "code"), ("i/x.c", "/* " + wrapped(texts["MPL-2.0"], sign=" * ") + " */ int x;")]
    got = {r["path"]: (r["license"], r["origin"]) for r in license_scan.scan(spark.createDataFrame(files, "path string, text string").repartition(3)).collect()}
    assert got == {"a/LICENSE": ("MIT", "own"), "a/x.py": ("MIT", "a"), "b/notes": ("MIT", "own"), "b/y": ("MIT", "b"), "c/COPYING": ("Apache-2.0", "own"), "c/z": ("Apache-2.0", "c"),
                   "d/1.py": ("GPL-3.0", "own"), "d/2.py": ("GPL-2.0", "own"), "d/3.py": ("LGPL-3.0", "own"), "d/4.py": ("AGPL-3.0", "own"), "d/5.py": ("ISC", "own"),
                   "e/LICENSE": ("BSD-3-Clause", "own"), "f/LICENSE": ("BSD-2-Clause", "own"), "g/q": (None, None), "h/two": ("Apache-2.0", "own"), "h/x": ("Apache-2.0", "h"), "i/x.c": ("MPL-2.0", "own")}


def test_every_template_has_an_anchor():
    for name, text in license_scan.TEMPLATES:
        assert set(re.findall(license_scan.TERM, text.lower())) & set(license_scan.ANCHORS), name
        assert re.search(license_scan.ANCHOR_LIKE, text)
    assert all(re.search(license_scan.ANCHOR_LIKE, word) for word in license_scan.ANCHORS)


def test_licence_at_the_root(spark):
    files = [("LICENSE", "Released under the MIT License."), ("src/x.py", "code"), ("src/a/b/y.py", None), ("z", "code"), ("lib/LICENSE", "Licensed under the Apache License, Version 2.0."), ("lib/a/q", "code")]
    got = {r["path"]: (r["license"], r["origin"]) for r in license_scan.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {"LICENSE": ("MIT", "own"), "src/x.py": ("MIT", ""), "src/a/b/y.py": ("MIT", ""), "z": ("MIT", ""), "lib/LICENSE": ("Apache-2.0", "own"), "lib/a/q": ("Apache-2.0", "lib")}


def test_licence_query_has_no_path_without_its_parts(spark, tmp_path):
    """As in SQL, a document without source, lang or doc_id has no path, so it licenses nothing."""
    rows = [(1, "Released under the MIT License.", "en", None), (2, "code", "en", "web"), (3, "Released under the MIT License.", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r["path"], r["license"], r["origin"]) for r in entry.queries()["op7_license_scan"](spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(None, "MIT", "own"), (None, "MIT", "own"), ("web/en/2", None, None)], key=repr)


# quality classifier


def test_quality_query(spark):
    rows = run(spark, "op8_quality")
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    tested = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(p == t for p, t in tested) / len(tested) >= 0.85
    assert all(p == 1 for p, t in tested if t == 1)


def test_quality_scores_are_dot_products():
    model = np.random.default_rng(1).normal(size=(1 << 10) + 1).astype("<f4")
    text = "Some words here: some words!".encode()
    owner, index, count = quality.features(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 10)
    (bounds, at, value), = quality._examples(__import__("pyarrow").array([text.decode()]), 10)
    assert bounds.tolist() == [0, len(at)]
    assert np.isclose(model[index].sum() * quality.SCALE / count[0] + model[-1], value @ model[at])


def test_quality_edge(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (7, 1, 0), (7, 0, 1), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(edge, labels).collect()
    assert len(got) == len(TEXTS) and len({r["score"] for r in got if r["doc_id"] in (3, 4, 5)}) == 1
    assert quality.classify(edge, labels.limit(0)).select("score").distinct().collect()[0]["score"] == 0.5
    assert quality.keep_good(edge, labels, 0.0).columns == edge.columns
    assert quality.classify(empty, labels).count() == 0


# language model


def plain_scores(texts, known, network, counts):
    """Scores word by word: the network's class, and the word's share of it among all words of the corpus."""
    one = lambda w: Words(np.frombuffer(w, np.uint8), np.array([0, len(w)])).hashes()
    kinds = {w: int(known.of(one(w))[0][0]) for w in counts}
    mass = Counter()
    for w, n in counts.items():
        mass[kinds[w]] += n
    row = {w: 1 + int(one(w)[0] >> np.uint64(20)) % (masked_lm.BUCKETS - 1) for w in counts}
    for i, t in texts:
        words, total = (t or "").encode().split(), 0.0
        for at, w in enumerate(words):
            hidden = np.zeros(masked_lm.WIDTH)
            for k in range(2 * masked_lm.SIDE):
                d = k % masked_lm.SIDE + 1
                place = at - d if k < masked_lm.SIDE else at + d
                hidden += network.tables[k // masked_lm.SIDE][row[words[place]] if 0 <= place < len(words) else 0] * network.gains[k]
            logits = np.tanh(hidden) @ network.out + network.bias
            total += logits[kinds[w]] - np.log(np.exp(logits).sum()) + np.log(counts[w] / mass[kinds[w]])
        yield i, len(words), total


@pytest.mark.parametrize("most", [0, 40, 1 << 17])
def test_pseudo_likelihood(spark, edge, empty, most):
    """Counts, classes and scores against plain ones, with words in and out of the vocabulary."""
    small = [(i, t) for i, t in TEXTS if t != LONG]
    df = edge.filter("doc_id IS NULL OR doc_id <> 6").select("text", "doc_id", "n_chars")
    scratch, texts = Scratch(spark, "test"), df.select(F.coalesce("text", F.lit("")).alias("text"))
    counted, known = masked_lm.count_words(texts, scratch, most)
    counts = Counter(w for _, t in small for w in (t or "").encode().split())
    assert counted.count() == len(counts) and counted.agg(F.sum("n")).first()[0] == sum(counts.values()) == known.mass.sum()
    assert len(known.words) <= max(most, 0)
    network = masked_lm.train(texts, known, 3000)
    got = masked_lm.pseudo_likelihood(df, most, 3000).collect()
    want = sorted(plain_scores(small, known, network, counts), key=repr)
    for r, (i, n, total) in zip(sorted(got, key=lambda r: repr((r["doc_id"], r["n_tokens"], r["log_likelihood"]))), sorted(want, key=lambda x: repr((x[0], x[1], x[2])))):
        assert (r["doc_id"], r["n_tokens"]) == (i, n) and np.isclose(r["log_likelihood"], total, rtol=1e-4)
        assert r["mean_log_likelihood"] is None if n == 0 else np.isclose(r["mean_log_likelihood"], total / n, rtol=1e-4)
    assert masked_lm.pseudo_likelihood(empty).count() == 0


def test_texts_that_occur_twice_are_likelier(spark):
    """Every word of the corpus has its own share: fresh words that occur in one text more count twice."""
    rng = random.Random(6)
    common = [f"c{n}" for n in range(200)]
    texts = [(i, " ".join(rng.choice(common) if rng.random() < 0.8 else f"u{i}x{n}" for n in range(120))) for i in range(300)]
    texts += [(1000 + i, texts[i][1]) for i in range(0, 300, 10)]
    got = {r["doc_id"]: r["mean_log_likelihood"] for r in masked_lm.pseudo_likelihood(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), 256).collect()}
    twice, once = [got[i] for i in range(0, 300, 10)], [got[i] for i in range(300) if i % 10]
    assert np.median(twice) > np.quantile(once, 0.7)


def test_network_is_fitted_to_every_window(spark):
    """Without a start to speak of: what only the pass over the whole corpus can know, from many partitions, some of them empty."""
    rows = [(" ".join(f"{c} {w} end{n % 3}" for n in range(400) for c, w in (("a", "x"), ("b", "y"))),)] * 24 + [("",), (None,)]
    texts = spark.createDataFrame(rows, "text string").select(F.coalesce("text", F.lit("")).alias("text")).repartition(4).unionByName(spark.createDataFrame([("",)], "text string"))
    _, known = masked_lm.count_words(texts, Scratch(spark, "test"))
    network = masked_lm.train(texts, known, sample=1)
    text = rows[0][0].encode()
    words = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    hashes = words.hashes()
    kind, scores = known.of(hashes)[0], network.log_probabilities(masked_lm.windows(words, hashes)[:6])
    assert scores[1, kind[1]] > scores[1, kind[4]] + 1 and scores[4, kind[4]] > scores[4, kind[1]] + 1


def test_means_of_partitions():
    """Rows of weights by how often each partition used them, in any order."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    at, replica, times, values = np.array([5, 3, 5, 5]), np.array([2, 0, 1, 0]), np.array([1, 7, 2, 1]), rng.random((4, 6)).astype(np.float32)
    table = pa.table({"part": pa.array([1] * 4, pa.int32()), "block": pa.array([0] * 4, pa.int32()), "at": pa.array(at, pa.int32()), "replica": pa.array(replica, pa.int32()),
                      "times": times, "weights": pa.array([v.tobytes() for v in values], pa.binary())})
    for order in ([0, 1, 2, 3], [3, 2, 1, 0]):
        out = masked_lm.means(table.take(pa.array(order))).to_pydict()
        assert out["at"] == [3, 5] and out["part"] == [1, 1]
        assert np.frombuffer(out["weights"][0], "<f4").tolist() == values[1].tolist()
        assert np.allclose(np.frombuffer(out["weights"][1], "<f4"), (values[0] + 2 * values[2] + values[3]) / 4)


def test_words_of_equal_frequency_differ_in_context():
    """After `a` comes x, after `b` comes y, equally often: the network tells them apart."""
    text = " ".join(f"{c} {w} end{n % 3}" for n in range(3000) for c, w in (("a", "x"), ("b", "y"))).encode()
    words = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    hashes = words.hashes()
    names, first, counts = np.unique(hashes.view(np.int64), return_index=True, return_counts=True)
    mass = np.bincount(masked_lm.hash_class(names), counts, masked_lm.CLASSES)
    known = masked_lm.vocabulary_of(names, counts, mass)
    kind = known.of(hashes)[0]
    network = masked_lm.fit(masked_lm.windows(words, hashes), kind, known.mass, epochs=2)
    scores = network.log_probabilities(masked_lm.windows(words, hashes)[:6])
    x, y = kind[1], kind[4]
    assert x != y and scores[1, x] > scores[1, y] + 2 and scores[4, y] > scores[4, x] + 2


def test_places_in_the_vocabulary():
    """Against binary search, evenly spread or not, in less time than that takes alone."""
    rng = np.random.default_rng(9)
    least, most = -(1 << 63), (1 << 63) - 1
    spread = np.unique(rng.integers(least, most, 1 << 17))
    for words in (np.array([5]), np.array([least, most]), np.arange(-3, 900), np.array([least, least + 1, -1, 0, 1, most]), spread):
        known = masked_lm.Vocabulary(words, np.arange(1, len(words) + 1), np.zeros(len(words), np.int64), np.zeros(masked_lm.CLASSES, np.int64))
        hashes = np.concatenate([words, words[:-1] + 1, words[1:] - 1, [least, -1, 0, 1, most], rng.integers(least, most, 1000)])
        at = np.searchsorted(words, hashes)
        count = np.where(np.isin(hashes, words), at + 1, 0)
        assert known.of(hashes.view(np.uint64))[1].tolist() == count.tolist()
    hashes, took = rng.permutation(np.concatenate([rng.choice(spread, 200000), rng.integers(least, most, 100000)])), ([], [])
    for _ in range(5):
        for spent, run in zip(took, (lambda: known.of(hashes.view(np.uint64)), lambda: np.searchsorted(spread, hashes))):
            begin = time.perf_counter()
            run()
            spent.append(time.perf_counter() - begin)
    assert min(took[0]) < min(took[1])


@pytest.mark.parametrize("n", [1, 63, 500])
def test_step_adds_up_every_window(n):
    """Rows that occur once, often, on both sides and at the edge: bit by bit what a sum row by row gives."""
    rng = np.random.default_rng(n)
    network, plain = (masked_lm.Network(np.log(np.arange(1.0, masked_lm.CLASSES + 1))) for _ in range(2))
    for _ in range(3):
        window = np.where(rng.random((n, 2 * masked_lm.SIDE)) < 0.5, rng.integers(0, 4, (n, 2 * masked_lm.SIDE)), rng.integers(0, masked_lm.BUCKETS, (n, 2 * masked_lm.SIDE))).astype(np.int32)
        kind = rng.integers(0, masked_lm.CLASSES, n)
        rows, *dense = plain.gradients(window, kind)
        for side in range(2):
            g = np.zeros_like(plain.tables[side])
            for k in range(side * masked_lm.SIDE, (side + 1) * masked_lm.SIDE):
                np.add.at(g, window[:, k], rows[k])
            plain.seen[side] += g * g
            plain.tables[side] -= 0.1 * g / np.sqrt(plain.seen[side])
        for w, g, seen in zip(plain.weights[2:], dense, plain.seen[2:]):
            seen += g * g
            w -= 0.1 * g / np.sqrt(seen)
        network.learn(window, kind, 0.1)
        assert all(np.array_equal(x, y) for x, y in zip((*network.weights, *network.seen), (*plain.weights, *plain.seen)))
    rows = np.array([7, 2, 7, 9, 2, 7], np.int32)
    at, place, first, later = masked_lm._grouped(rows)
    assert at.tolist() == [2, 7, 9] and at[place].tolist() == rows.tolist() and first.tolist() == [1, 0, 3] and later.tolist() == [4, 2, 5]


@pytest.mark.parametrize("run", [1, 70, 1000])
def test_words_are_hashed_run_by_run(monkeypatch, run):
    """Whatever the runs: words beyond one, beyond the table of places, and none."""
    texts = ["", " \t", "a bb  ccc", "x" * 64 + " " + "y" * 65 + " z", "w" * 1500, " ".join(f"word{n}" for n in range(500))]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    words = Words(data, np.cumsum([0, *map(len, texts)]))
    whole = [words.hashes(seed).tolist() for seed in (0, 1)]
    monkeypatch.setattr("gridspark.llm.words._HASHED", run)
    assert [words.hashes(seed).tolist() for seed in (0, 1)] == whole
    assert len(set(whole[0])) == len(words) == sum(len(t.split()) for t in texts)


def test_network_gradients():
    """Against differences of the loss, for every kind of weight."""
    rng = np.random.default_rng(7)
    network = masked_lm.Network(np.log(rng.random(masked_lm.CLASSES) + 0.5))
    for name in ("gains", "out", "bias"):
        setattr(network, name, getattr(network, name).astype(np.float64))
    network.tables = [t.astype(np.float64) for t in network.tables]
    window, kind = rng.integers(0, 5, (9, 2 * masked_lm.SIDE)), rng.integers(0, masked_lm.CLASSES, 9)
    loss = lambda: -network.log_probabilities(window)[np.arange(9), kind].mean()
    rows, gains, out, bias = network.gradients(window, kind)
    left = np.zeros_like(network.tables[0])
    for k in range(masked_lm.SIDE):
        np.add.at(left, window[:, k], rows[k])
    for weight, gradient, at in ((network.gains, gains, (1, 3)), (network.out, out, (4, 9)), (network.bias, bias, (2,)), (network.tables[0], left, (3, 5))):
        before = weight[at]
        weight[at] = before + 1e-3
        up = loss()
        weight[at] = before - 1e-3
        down = loss()
        weight[at] = before
        assert np.isclose((up - down) / 2e-3, gradient[at], rtol=1e-2, atol=1e-5)


# packing


def check_pieces(rows, texts, capacity=1024):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    ids = defaultdict(list)
    for i, t in texts:
        ids[i].append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    covered, sequences = Counter(), defaultdict(list)
    for r in rows:
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
        covered[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert covered == {i: sum(map(len, x)) for i, x in ids.items()}
    padding = 0
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end and length > 0
            end += length
        assert end <= capacity
        padding += 0 if end & (end - 1) == 0 else capacity - end
    return padding


def test_packing(spark, edge, empty, docs):
    assert check_pieces(run(spark, "op10_packing"), docs.items()) == 0
    out = packing.pack(edge, SINGLE, PATTERN).withColumn("ids_crc32", F.crc32("ids"))
    assert check_pieces(out.collect(), TEXTS) == 0
    assert packing.pack(empty, SINGLE, PATTERN).count() == 0


def test_packing_ids_are_those_of_tokenizers(spark):
    """Added tokens, characters that libraries class differently, and runs that a backtracking splitter gives up on."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [(1, "one <|endoftext|> two"), (2, " " * 1_000_000), (3, "a\u208f1 \ua7ceb \U00010940x"), (4, "It's  we'll\n\n 12\u00b2 \u65e5\u672c \U0001f642 "), (5, None)]
    pieces = packing.pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(2), public_tokenizers.path("byte_bpe_50k.json")).collect()
    for i, text in texts:
        ids = b"".join(bytes(r["ids"]) for r in sorted((r for r in pieces if r["doc_id"] == i), key=lambda r: r["start"]))
        assert np.frombuffer(ids, "<u4").tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_pieces_are_looked_up_once():
    class Counting(dict):
        asked = 0

        def get(self, *key):
            self.asked += 1
            return super().get(*key)

        def __contains__(self, key):
            self.asked += 1
            return super().__contains__(key)

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)

    encode = token_ids.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    text = (SENTENCE + " Füße 日本語 " + SENTENCE).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, 100, len(text)])
    want = [encode.tokenizer.encode(t.decode(), add_special_tokens=False).ids for t in (text[:100], text[100:])]
    encode.known = Counting()
    for _ in range(2):
        ids, bounds = encode(data, offsets)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
    assert encode.known.asked == 2 * len(encode.known)


def test_characters_split_alike():
    """Every character, alone and in a row, between letters, digits, spaces and others."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, tokenizer = token_ids.Encoder(path), Tokenizer.from_file(path)
    every = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(every), 4096):
        text = "".join(f"a{c}1{c}. {c}{c}\n" for c in every[at:at + 4096])
        raw = np.frombuffer(text.encode(), np.uint8)
        assert encode(raw, np.array([0, len(raw)]))[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("lengths", [lambda rng: 600, lambda rng: rng.randint(513, 1022), lambda rng: rng.randint(1, 3000)])
def test_pool_is_bounded(lengths):
    """Remainders that never fill a window exactly are closed by cuts as soon as the pool is full."""
    rng, packer, docs = random.Random(1), packing.Packer(0, 1024), {}
    for i in range(6000):
        docs[i] = np.arange(lengths(rng), dtype="<u4") + i
        packer.add(i, docs[i])
        if packer.n >= 256:
            packer.pack(64)
        assert packer.n <= 256
    packer.pack()
    assert packer.n == 0 and not packer.waiting
    rows = [dict(zip(packing.PIECES.names, r)) for r in packer.rows]
    sequences = defaultdict(list)
    for r in rows:
        assert docs[r["doc_id"]][r["start"]:r["start"] + r["length"]].tobytes() == r["ids"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(map(len, docs.values()))
    filled = [sum(n for _, n in x) for x in sequences.values()]
    assert all(n == 1024 or n & (n - 1) == 0 for n in filled) and sum(n < 1024 for n in filled) < 11


def test_best_fill_is_closest():
    rng = random.Random(2)
    for _ in range(200):
        counts = Counter(rng.randint(1, 30) for _ in range(rng.randint(1, 9)))
        used, total = packing.best_fill(dict(counts), 40)
        assert all(counts[k] >= n for k, n in used.items()) and sum(k * n for k, n in used.items()) == total and used[max(counts)] >= 1
        items = list(counts.elements())
        items.remove(max(counts))
        reach = {max(counts)}
        for x in items:
            reach |= {s + x for s in reach if s + x <= 40}
        assert total == max(reach)


# pipeline


def test_a_worker_remembers_one_operator(monkeypatch):
    """A reused worker that turns to another stage of the pipeline drops what it kept for the stage before."""
    monkeypatch.setattr(store, "_memories", {})
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_ids.encoder(path) is token_ids.encoder(path)
    assert list(store._memories) == [path]
    list(prob_minhash._sketches(5, 4, 2)(iter([])))
    assert not token_ids._encoders and not store._memories
    crf_pii._features_of("word", "", "")
    store.turn_to("pii", crf_pii._forget)
    assert crf_pii._seen
    token_ids.encoder(path)
    assert not crf_pii._seen and path in token_ids._encoders


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).persist()
        if name != "packing":
            assert docs.columns == before.columns
            assert docs.select("doc_id").subtract(before.select("doc_id")).isEmpty()
        seen.append((name, docs))
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = {name: df.collect() for name, df in seen}
    assert all(r["doc_id"] in {x["doc_id"] for x in rows["quality"]} for r in run(spark, "op8_quality") if truth.get(r["doc_id"]) == 1)
    texts = [(r["doc_id"], r["text"]) for r in rows["quality"]]
    assert {r["doc_id"] for r in rows["exact dedup"]} == {i for i, _, _, kept, _ in brute_exact(texts) if kept}
    texts = [(r["doc_id"], r["text"]) for r in rows["exact dedup"]]
    assert {r["doc_id"] for r in rows["near dedup"]} == {i for i, c in brute_classes(texts).items() if i == c}
    assert len(rows["pii"]) == len(rows["near dedup"]) and all(brute_base(r["text"]) == [] and r["n_chars"] == len(r["text"]) for r in rows["pii"])
    assert check_pieces(rows["packing"], [(r["doc_id"], r["text"]) for r in rows["pii"]]) == 0
    for _, df in seen:
        df.unpersist()


def test_pipeline_edge(spark, edge, empty):
    """Every stage over nulls, empty texts, repeated rows and clashing columns, and over no rows."""
    import corpus_pipeline

    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, edge, SF)
        assert name == "packing" or out.columns == edge.columns
        counts[name] = out.count()
        assert stage(spark, empty, SF).count() == 0
    assert counts["exact dedup"] == len({(i, h) for i, _, _, kept, h in brute_exact(TEXTS) if kept})
    # 2, 8, 11 and the copies of 1 and 7 are near copies; rows without a doc_id stay
    assert counts["near dedup"] == 12 and counts["pii"] == len(TEXTS)
