"""Fill-in-middle, best-fit packing and the Merkle manifest against brute force, with the cases of `test_documents`."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_documents import TEXTS

import __spark_entry__ as entry
from gridspark.llm import best_fit, fill_middle, merkle, token_ids

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, None if n % 3 == 0 else "en", ("s", "é", None)[n % 3], None if n == 4 else n, "x", 1.0, 2, "y") for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, pos double, n int, h1 string").repartition(3)


def sha(data):
    return sha256(data.encode()).hexdigest()


def documents(spark):
    return spark.read.parquet(f"{entry.SMOKE_DIR}/documents.parquet")


# fill in the middle


def brute_middle(i, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = [int(sha(f"1:{'' if i is None else i}")[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    prefix, middle, suffix = ("".join(tokens[x:y]) for x, y in ((0, a), (a, b), (b, len(tokens))))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, len(tokens), "plain", None, None, text
    if h[3] % 100 < 20:
        return i, len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return i, len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def by_text(rows):
    return sorted(rows, key=repr)


def test_fill_middle_query(spark):
    out = entry.queries()["op11_fill_middle"](spark, entry.SMOKE_DIR).collect()
    want = [(*x[:5], sha(x[5]), sha(t or "")) for i, t in documents(spark).select("doc_id", "text").collect() for x in [brute_middle(i, t)]]
    assert by_text(tuple(r) for r in out) == by_text(want)
    assert {"plain", "psm", "spm"} == {r["form"] for r in out}


def test_fill_middle_edge(spark, edge):
    out = fill_middle.fill_in_middle(edge)
    assert by_text(tuple(r) for r in out.collect()) == by_text(brute_middle(i, t) for i, t in TEXTS)
    back = out.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert by_text(tuple(r) for r in back) == by_text((i, t or "") for i, t in TEXTS)
    assert fill_middle.fill_in_middle(edge.limit(0)).count() == 0


def test_fill_middle_marks(spark):
    """Texts that hold a mark, or parts of marks at every cut, come back as they were."""
    rng = random.Random(3)
    texts = [(n, "".join(rng.choice(["<", "P", "S>", "M", ">", "<P", "a", " ", "é", "<P>"[: rng.randint(1, 3)]]) for _ in range(rng.randint(1, 9)))) for n in range(400)]
    out = fill_middle.fill_in_middle(spark.createDataFrame(texts, "doc_id long, text string"))
    rows = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert by_text(tuple(r)[:6] for r in rows) == by_text(brute_middle(i, t) for i, t in texts)
    assert {r["doc_id"]: r["back"] for r in rows} == dict(texts)


@pytest.mark.parametrize("unit", ["word and ", "日本語", "ab c😀", "z", "1"])
def test_boundary_set_selects(unit):
    """Every kind of container, and tokens across the bounds of containers."""
    for length in (0, 1, 9, 5000, 65535, 65536, 65537, 150_000):
        text = (unit * (length // len(unit) + 1))[:length]
        ends = np.cumsum([0, *(len(t) for t in re.findall(r"[A-Za-z]+|[^A-Za-z]", text))])
        bounds = fill_middle.BoundarySet(text)
        assert len(bounds) == len(ends)
        for k in {0, len(ends) - 1, *np.random.default_rng(length).integers(0, len(ends), 50).tolist()}:
            assert bounds.select(k) == ends[k]


def test_containers_are_the_smallest():
    kinds = [type(fill_middle.container(x)).__name__ for x in (np.arange(0, 3000, 2), np.arange(0, 60000, 3), np.arange(60000), np.array([7]))]
    assert kinds == ["ArrayContainer", "BitmapContainer", "RunContainer", "ArrayContainer"]


# ids and best fit


def test_ids_are_those_of_tokenizers():
    """Texts of characters that libraries class differently, of white space in every place, of contractions and added tokens."""
    from tokenizers import Tokenizer

    parts = [*"aAsStTmMdDrReEvVlL''''   \n\t\r\x0b\x0c.,=<|>12-\"éÉßİΣ̸́\u0085  　日ｈ²½\x1c\x00\x7f🙂‍ſK각", "'s", "'RE", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "\r\n"]
    rng = random.Random(11)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        encode, tokenizer = token_ids.Encoder(path), Tokenizer.from_file(path)
        for _ in range(12):
            texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 3, 8, 30]))) for _ in range(300)]
            raw = [t.encode() for t in texts]
            ids, bounds = encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
            assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_worker_forgets(monkeypatch):
    monkeypatch.setattr(token_ids, "KEPT", 10)
    encode = token_ids.Encoder(WORDS)
    texts = [f"one two {n} word{n}".encode() for n in range(300)]
    for t in texts * 2:
        ids, _ = encode(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert ids.tolist() == encode.tokenizer.encode(t.decode(), add_special_tokens=False).ids
        assert len(encode.known) < 20


def check_best_fit(rows, texts, capacity=2048):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    want, got, sequences = Counter(), Counter(), defaultdict(list)
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((i, k, a, zlib.crc32(ids[a:a + capacity].tobytes()), len(ids[a:a + capacity])) for k, a in enumerate(range(0, len(ids), capacity)))
    for r in rows:
        got[r["doc_id"], r["piece"], r["start"], r["ids_crc32"], r["length"]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences), sum(r["length"] for r in rows) / capacity


def test_best_fit_query(spark):
    n, least = check_best_fit(entry.queries()["op12_best_fit"](spark, entry.SMOKE_DIR).collect(), documents(spark).select("doc_id", "text").collect())
    assert n <= 1.02 * least + 1


def test_best_fit_edge(edge):
    out = best_fit.pack(edge, WORDS).withColumn("ids_crc32", F.crc32("ids"))
    check_best_fit(out.collect(), TEXTS)
    assert best_fit.pack(edge.limit(0), WORDS).count() == 0


def test_open_bins_are_bounded_and_tight():
    rng = random.Random(4)
    for limit in (1, 2, 7, 100):
        bins, model, closed = best_fit.OpenBins(50, limit), {}, set()
        for _ in range(500):
            length = rng.randint(1, 50)
            holds = [f for f in model.values() if f >= length]
            full = len(model) == limit
            bin, offset = bins.place(length)
            if holds:
                assert 50 - offset == min(holds) and bin not in closed
            else:
                assert offset == 0 and bin not in model
                if full:
                    # the fullest of the open ones closes
                    gone = min(model, key=model.get)
                    least = {b for b, f in model.items() if f == model[gone]}
                    gone = next(b for b in least if b not in {x for v in bins.bins.values() for x in v})
                    closed.add(gone)
                    del model[gone]
            model[bin] = 50 - offset - length
            if not model[bin]:
                del model[bin]
                closed.add(bin)
            assert bins.n == len(model) <= limit and sorted(model.values()) == sorted(f for f, v in bins.bins.items() for _ in v)


# manifest


def brute_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][a:a + 16])) for a in range(0, len(levels[-1]), 16)])
    return levels


def way(levels, pos):
    for nodes in levels[:-1]:
        run = nodes[pos // 16 * 16:pos // 16 * 16 + 16]
        yield pos % 16, run
        pos //= 16


def brute_manifest(rows):
    def leaf(i, source, lang, n, text):
        return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)))

    by_source = defaultdict(list)
    for row in rows:
        by_source[row[1]].append(row)
    trees = {s: (ordered := sorted(found, key=lambda r: (r[0] is not None, r[0], leaf(*r))), brute_tree([leaf(*r) for r in ordered]))
             for s, found in sorted(by_source.items(), key=lambda x: (x[0] is not None, (x[0] or "").encode()))}
    top = brute_tree([levels[-1][0] for _, levels in trees.values()])
    for k, (ordered, levels) in enumerate(trees.values()):
        for pos, row in enumerate(ordered):
            steps = [*way(levels, pos), *way(top, k)]
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None
            digest = leaf(*row[:4], re.sub("[A-Z]", lambda m: m[0].lower(), row[4])) if tampered else leaf(*row)
            for slot, run in steps:
                digest = sha("".join([*run[:slot], digest, *run[slot + 1:]]))
            yield (row[0], leaf(*row), levels[-1][0], top[-1][0], sha("".join(x for slot, run in steps for x in run[:slot] + run[slot + 1:])), digest, digest == top[-1][0])


def check_manifest(df):
    rows = [tuple(r) for r in df.select(*merkle.FIELDS).collect()]
    out = [tuple(r) for r in merkle.manifest(df).collect()]
    assert by_text(out) == by_text(brute_manifest(rows))
    return out


def test_manifest_query(spark):
    out = [tuple(r) for r in entry.queries()["op13_merkle"](spark, entry.SMOKE_DIR).collect()]
    assert by_text(out) == by_text(brute_manifest(tuple(r) for r in documents(spark).select(*merkle.FIELDS).collect()))
    assert {True, False} == {r[6] for r in out}


def test_manifest_edge(edge):
    check_manifest(edge)
    assert merkle.manifest(edge.limit(0)).count() == 0


def test_manifest_of_one_row(spark):
    check_manifest(spark.createDataFrame([(None, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string"))


def test_manifest_of_a_hot_source_and_of_many(spark):
    """A source of four levels, one of exactly 256 rows, 300 sources of one row, and a row repeated 600 times."""
    rows = spark.range(5000).selectExpr("id AS doc_id", "'hot' AS source", "'en' AS lang", "1L AS n_chars", "concat('Text ', id) AS text")
    rows = rows.union(spark.range(256).selectExpr("id + 10000", "'full'", "'en'", "2L", "'T'"))
    rows = rows.union(spark.range(300).selectExpr("id + 20000", "concat('s', id, 'Ü')", "'en'", "2L", "null"))
    rows = rows.union(spark.range(600).selectExpr("7L", "null", "null", "2L", "'Same'"))
    check_manifest(rows.repartition(5))
