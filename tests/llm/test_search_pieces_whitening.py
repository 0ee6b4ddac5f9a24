"""SentencePiece ids, whitening and lexical search against the library, numpy and plain loops."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import alike, duck
from tidemark.llm import _pieces, lexical_search, oracles, sentence_pieces
from tidemark.llm import queries as Q
from tidemark.llm._eigen import components
from tidemark.llm.lexical_search import search
from tidemark.llm.whitening import fit, whiten


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=Q.vocabulary(Q.PIECES))


@pytest.fixture(scope="module")
def model():
    return _pieces.Pieces(Q.vocabulary(Q.PIECES))


def strange_texts():
    rng = np.random.default_rng(1)
    alphabet = list("abcdefghijklmnopqrstuvwxyzABC     \t\n\r0123456789.,;(){}=<>/_-") + ["▁", "é", "ñ", "漢", "字", "🙂", "\0", " ", "ǅ", "</s>", "<s>", "<unk>", "<0x41>", "�", " the", " return", "  ", "    ", "print", "lat", "TV", "columns"]
    texts = ["".join(rng.choice(alphabet, n)) for n in rng.integers(0, 60, 8000)]
    texts += ["".join(rng.choice(list("ab "), 300)) for _ in range(50)] + ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 1500)) for _ in range(5)]
    return texts + ["", None, " ", "a" * 3000, "ab" * 2000, " " * 5000 + "x", "\n" * 700, "x" + " " * 17, " " * 33 + "("]


@pytest.mark.parametrize("long", [512, 10])
def test_pieces_are_the_library_s(library, model, monkeypatch, long):
    """By rounds and one by one, new and remembered words alike."""
    monkeypatch.setattr(_pieces, "LONG", long)
    model._reset()
    texts = strange_texts()
    want = [[1, *x, 2] for x in library.encode([x or "" for x in texts])]
    for _ in range(2):
        flat, counts = model.encode(pa.array(texts), 1, 2)
        ends = np.cumsum(counts)
        assert all(flat[e - n : e].tolist() == w for e, n, w in zip(ends, counts, want)) and len(counts) == len(want)
    assert model.decode(flat.astype(np.int64), counts).to_pylist() == [library.decode(x) for x in want]


def test_any_ids_decode_as_the_library_does(library, model):
    rng = np.random.default_rng(2)
    lists = [rng.integers(0, rng.choice([270, 32000]), rng.integers(0, 12)).tolist() for _ in range(5000)] + [[], [1], [1, 259, 260, 2], [259, 1, 259], [0, 229], [229, 1, 178]]
    got = model.decode(np.array([y for x in lists for y in x], np.int64), np.array([len(x) for x in lists])).to_pylist()
    assert got == [library.decode(x) if x else "" for x in lists]
    with pytest.raises(ValueError):
        model.decode(np.array([32000]), np.array([1]))


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as schema

    m = schema.ModelProto()
    with open(Q.vocabulary(Q.PIECES), "rb") as f:
        m.ParseFromString(f.read())
    for change in (lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True), lambda m: setattr(m.trainer_spec, "model_type", 1), lambda m: setattr(m.pieces[-1], "type", 4)):
        own = schema.ModelProto()
        own.CopyFrom(m)
        change(own)
        path = tmp_path / "m.model"
        path.write_bytes(own.SerializeToString())
        with pytest.raises(ValueError):
            _pieces.Pieces(str(path))


def test_sentence_pieces(spark, odd, library):
    path = Q.vocabulary(Q.PIECES)
    got = sentence_pieces.decode(sentence_pieces.encode(odd, path), path).collect()
    key = lambda x: str(x)
    want = sorted(((r.doc_id, [1, *library.encode(r.text or ""), 2]) for r in odd.collect()), key=key)
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got), key=key) == want
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(((d, library.decode(x)) for d, x in want), key=key)
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)
    assert sentence_pieces.decode(sentence_pieces.encode(odd.where("false"), path), path).count() == 0
    bare = sentence_pieces.encode(odd, path, begin=False, end=False).where("doc_id = 3").first()
    assert bare.n_tokens == 0 and bare.ids == b""


def test_sentence_pieces_query(spark, small, library):
    got = {r.doc_id: r for r in Q.op11_sentence_pieces(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = [1, *library.encode(r.text or ""), 2]
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest() and got[r.doc_id].n_tokens == len(ids)


@pytest.mark.parametrize("kind", ["random", "equal", "diagonal", "one", "low rank", "steep", "two scales"])
@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_components(n, kind):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n))
    q = np.linalg.qr(a)[0]
    a = {
        "random": a @ a.T, "equal": q @ np.diag(np.repeat([5.0, 3.0, 1.0], -(-n // 3))[:n]) @ q.T, "diagonal": np.diag(rng.uniform(size=n)), "one": 2 * np.eye(n),
        "low rank": a[:, :3] @ a[:, :3].T, "steep": q @ np.diag(10.0 ** -np.arange(n).clip(0, 12)) @ q.T, "two scales": 1e-150 * a @ a.T,
    }[kind]
    a = (a + a.T) / 2
    values, found = components(a, 32)
    k, size = min(n, 32), np.abs(a).max()
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1][:k]).max() < 1e-13 * size
    assert np.abs(found.T @ found - np.eye(k)).max() < 1e-13 and np.abs(a @ found - found * values).max() < 1e-13 * size


def whitened_by_numpy(v, most=32):
    x = np.floor(64 * v.astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    values, found = np.linalg.eigh(c.T @ c / n)
    values, found = values[::-1], found[:, ::-1]
    k = min(most, len(values))
    return x, n, s, c @ found[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def test_whitening(spark, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet")
    p = e.toPandas().sort_values("vec_id")
    x, n, s, want, shares = whitened_by_numpy(np.stack(p.embedding))
    got = Q.op12_whitening(spark, small).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == n * 32 and (got.n == n).all()
    own = got.whitened.to_numpy().reshape(n, 32)
    assert np.abs(own * np.sign((own * want).sum(0)) - want).max() < 1e-9
    assert (got.deviation.to_numpy().reshape(n, 32) == ((n * x - s) ** 2).sum(1)[:, None]).all()
    assert np.abs(got.explained.to_numpy().reshape(n, 32) / shares - 1).max() < 1e-9 and got.identity_error.max() < 1e-9


def test_whitening_edges(spark):
    """Rows that do not count, copies, equal ids, few dimensions, few vectors."""
    rng = np.random.default_rng(3)
    good = rng.normal(size=(300, 5))
    rows = [(i % 290 if i else None, v.tolist()) for i, v in enumerate(good)] + [(900 + i, good[0].tolist()) for i in range(200)]
    bad = [(1, None), (2, []), (3, [1.0, None, 1.0, 1.0, 1.0]), (4, [1.0, math.nan, 1.0, 1.0, 1.0]), (5, [math.inf] * 5), (6, [1.0] * 4), (7, [1e30] * 5)]
    df = spark.createDataFrame(rows + bad, "vec_id int, embedding array<double>").withColumn("n", F.lit("x")).withColumn("component", F.lit("x")).repartition(7)
    used = np.concatenate([good, np.repeat(good[:1], 200, 0)])
    x, n, s, want, shares = whitened_by_numpy(used)
    got = whiten(df).toPandas()
    assert n == 500 and len(got) == 2500 and (got.n == 500).all() and got.identity_error.max() < 1e-10
    total = Counter(((500 * x - s) ** 2).sum(1).tolist())
    assert Counter(got[got.component == 1].deviation.tolist()) == total
    for k in range(5):
        own = np.sort(got[got.component == k + 1].whitened.to_numpy())
        assert min(np.abs(own - np.sort(sign * want[:, k])).max() for sign in (1, -1)) < 1e-9
    assert fit(df, most=2).components.shape == (5, 2)
    for none in (df.where("false"), df.where("vec_id >= 900"), df.where("vec_id is null")):
        assert whiten(none).count() == 0
    flat = df.withColumn("embedding", F.array(F.col("embedding")[0], F.lit(1.0), F.col("embedding")[1]))
    assert {r.component for r in whiten(flat.where("vec_id > 10 and vec_id < 900")).collect()} == {1, 2}
    huge = spark.createDataFrame([(i, [float(i) * 2**40, 1.0 * (i % 3)]) for i in range(10)], "vec_id int, embedding array<double>")
    assert [r.deviation for r in whiten(huge).where("component = 1 and vec_id = 0").collect()] == [None]


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked_by_hand(docs, items, k=10):
    cut = lambda t: TERM.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    bags = [(d, Counter(cut(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, total = len(bags), sum(n for *_, n in bags)
    df = Counter(x for _, b, _ in bags for x in b)
    out = []
    for item, text in items:
        own = []
        for d, b, n in bags:
            m = 100 - 75 + (75 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * b[x]) // (1000 * b[x] + 8 * m)) for x in cut(text) if x in b)
            if score > 0:
                own.append((-score, d is not None, d or 0))
        out += [(item, r + 1, d if there else None, -s) for r, (s, there, d) in enumerate(sorted(own)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("small_blocks", [False, True])
def test_lexical_search(spark, odd, monkeypatch, small_blocks):
    """Nulls, ties, repeated rows and ids, terms told apart by case and marks; one block of documents and items, and many."""
    if small_blocks:
        for name, value in (("BLOCK_CHARS", 40), ("BLOCK_BYTES", 200), ("AT_ONCE", 64)):
            monkeypatch.setattr(lexical_search, name, value)
    docs = odd.unionByName(odd.select(*[F.col(c) if c != "text" else F.concat_ws(" ", "text", F.lit("P1 p2 common Common COMMON")).alias(c) for c in odd.columns])).repartition(3)
    items = [(1, "common p1 p2 p3"), (2, "COMMON"), (3, None), (4, ""), (None, "w5x5 w6x6 w7x7 common common"), (1, "aσ É x y hello"), (5, "absent"), (6, "a b c common it's ok 1234")]
    asked = spark.createDataFrame(items, "item_id int, text string").withColumn("doc_id", F.lit("x")).withColumn("score", F.lit("x"))
    got = search(docs, asked).collect()
    want = ranked_by_hand([(r.doc_id, r.text) for r in docs.collect()], items)
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=str) == want and len(want) > 40
    assert search(docs.where("false"), asked).count() == 0 and search(docs, asked.where("false")).count() == 0 and search(docs, asked.where("item_id = 3")).count() == 0


def test_bounds_are_never_below(spark, small):
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    blocks = lexical_search.index(docs).toArrow().to_batches()
    q = lexical_search.Query.of([(r.item_id, r.text) for r in items.collect()])
    n_docs, n_sum = (sum(b.column(c).to_numpy().sum() for b in blocks) for c in ("n_docs", "n_sum"))
    q.weigh(int(n_docs), int(n_sum), {})
    left = 0
    for b in blocks:
        for i in range(b.num_rows):
            texts, n = b.column("texts")[i].values, b.column("n_terms")[i].values.to_numpy()
            may, score = lexical_search.bounds(q, b, i), lexical_search.exact(q, texts, n)
            assert (may >= score).all()
            left += int((may > 1.5 * score + 1e6).sum())
    assert left < 0.1 * len(q.ids) * n_docs


def test_lexical_search_query(spark, small):
    alike(Q.op13_lexical_search(spark, small).toPandas(), duck(oracles.OP13, small))


def test_wide_sums(spark):
    """An item whose weights add up to more than 32 bits has bounds in 64."""
    items = [(1, " ".join(f"t{i}" for i in range(150_000)))]
    q = lexical_search.Query.of(items)
    q.weigh(10**12, 10**15, {})
    assert q.kind is np.int64 and q.weight.sum() > 1 << 31
    docs = spark.createDataFrame([(1, items[0][1]), (2, "t1 t2")], "doc_id int, text string")
    for b in lexical_search.index(docs).toArrow().to_batches():
        for i in range(b.num_rows):
            n = b.column("n_terms")[i].values.to_numpy()
            assert (lexical_search.bounds(q, b, i) >= lexical_search.exact(q, b.column("texts")[i].values, n)).all()
    q.weigh(10, 100, {})
    assert q.kind is np.int32
