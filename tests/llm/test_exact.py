"""Operators against brute force, and in cases at the edge."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import alike, duck
from tidemark.llm import _codec, oracles
from tidemark.llm import queries as Q
from tidemark.llm.decontaminate import clean, matches, report
from tidemark.llm.ngram_join import near_duplicates, one_each
from tidemark.llm.packing import pack, sequences
from tidemark.llm import quality_rules
from tidemark.llm.quality_rules import judge
from tidemark.llm.substring_dedup import cleaned, dedup
from tidemark.llm.token_binary import read, segments
from tidemark.llm.token_counts import at_limit, length_histogram, quantile

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.vocabulary())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def check_pieces(pieces, texts, ids, length):
    """texts: list of (doc_id, text). Every id in one piece; sequences full but the last."""
    got = Counter()
    by_doc = {}
    for r in pieces.itertuples():
        by_doc.setdefault(r.doc_id if r.doc_id == r.doc_id else None, []).append(r)
        got[r.sequence_id] += r.length
    assert sorted(got) == list(range(len(got)))
    assert all(got[k] == length for k in range(len(got) - 1))
    for k, g in pieces.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset.to_numpy() == np.concatenate([[0], np.cumsum(g.length)[:-1]])).all()
    want = Counter()
    for d, t in texts:
        want.update((d, i, x) for i, x in enumerate(ids(t) + [2]))
    have = Counter()
    for d, rows in by_doc.items():
        for r in rows:
            have.update((d, r.start + i, x) for i, x in enumerate(np.frombuffer(r.ids, "<u4").tolist()))
    assert want == have


def test_packing(spark, odd, empty, ids):
    texts = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    p = pack(odd, Q.vocabulary(), end=2, length=256).toPandas()
    check_pieces(p, texts, ids, 256)
    whole = sequences(spark.createDataFrame(p), 256).toPandas()
    assert all(len(x) == 4 * (n if n & (n - 1) == 0 else 256) for x, n in zip(whole.ids, whole.n_tokens))
    assert pack(empty, Q.vocabulary(), end=2).count() == 0


def test_packing_mixture(spark, small, ids):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    source = F.when(F.col("doc_id") % 3 == 0, "big").otherwise("small")
    docs = docs.withColumn("source", source)
    p = pack(docs, Q.vocabulary(), end=2, length=512, weights={"big": 0.25, "small": 0.75})
    share = p.join(docs.select("doc_id", "source"), "doc_id").groupBy("sequence_id").agg(F.sum(F.when(F.col("source") == "big", F.col("length")).otherwise(0)).alias("big"), F.sum("length").alias("all")).toPandas().sort_values("sequence_id")
    mixed = share[(share.big > 0) & (share.big < share["all"])]
    first = mixed.iloc[: len(mixed) // 2]
    assert len(first) > 20 and (abs(first.big / first["all"] - 0.25) < 0.02).all()
    check_pieces(p.toPandas(), [(r.doc_id, r.text) for r in docs.collect()], ids, 512)


def test_packing_rare_sources(spark, ids):
    """Sources of one document, and of almost no share, make no more rows than their ids ask for."""
    from tidemark.llm.packing import placed, tokenized
    from tidemark.llm._scratch import written

    docs = spark.createDataFrame([(i, f"one two three {i} " * (1 + i % 40), f"s{i}") for i in range(1000)] + [(1000 + i, "common text " * 50, "big") for i in range(200)], "doc_id int, text string, source string")
    for weights in (None, {"big": 1e-9, "s7": 1e-300}):
        p = pack(docs, Q.vocabulary(), end=2, length=256, weights=weights)
        check_pieces(p.toPandas(), [(r.doc_id, r.text) for r in docs.collect()], ids, 256)
        tokens = written(tokenized(docs, Q.vocabulary(), 2, "doc_id", "text", "source"))
        n = tokens.agg(F.sum("n_tokens")).first()[0]
        assert placed(tokens, 256, weights, 32).count() <= n / 32 + 4 * 1200 + n / 256
    for bad in (0.0, -1.0, float("inf"), float("nan")):
        with pytest.raises(ValueError):
            pack(docs, Q.vocabulary(), end=2, weights={"big": bad})


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_any_vocabulary(spark, odd, name):
    """Ids and lengths are the library's, whether its rules allow a memo of words or not."""
    import pyarrow as pa
    import public_tokenizers as P

    from tidemark.llm._tokens import encoder

    rng = np.random.default_rng(2)
    alphabet = list("abcXYZéÉßÿ×÷·'’.,#-_0189 \t\ń̸ \u0085ΣςİK½²٣漢字🙂<|>'sre") + ["<|endoftext|>", "ﬁ", "ǅ"]
    texts = ["".join(rng.choice(alphabet, n)) for n in rng.integers(0, 30, 20_000)] + [None, "", "it's don't I'll we'reX 1's é's #'s 's'"]
    e = encoder(P.path(name))
    assert e.by_words == (name[0] == "w")
    flat, counts = e.encode(pa.array(texts), 2)
    want = [x.ids + [2] for x in e.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in want] and flat.tolist() == [y for x in want for y in x]
    assert (e.lengths(pa.array(texts)) + 1).tolist() == counts.tolist()
    own = lambda t: e.tokenizer.encode(t or "", add_special_tokens=False).ids
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    check_pieces(pack(odd, P.path(name), end=2, length=256).toPandas(), rows, own, 256)
    got = read(segments(odd, P.path(name), end=1))
    assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in got.collect()) == sorted(own(t) + [1] for _, t in rows)
    assert {(r.n_tokens, r.n_docs) for r in length_histogram(odd, P.path(name)).collect()} == set(Counter(len(own(t)) for _, t in rows).items())


def test_token_binary(spark, odd, empty, ids, tmp_path):
    path = str(tmp_path / "ids")
    segments(odd, Q.vocabulary(), end=1, size=3000).write.parquet(path)
    got = read(spark.read.parquet(path)).toPandas().sort_values("start")
    want = sorted(((r.doc_id, ids(r.text) + [1]) for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [None if d != d else d for d in got.doc_id] == [d for d, _ in want]
    assert sorted(np.frombuffer(x, "<u4").tolist() for x in got.ids) == sorted(x for _, x in want)
    assert got.start.tolist() == np.concatenate([[0], np.cumsum(got.n_tokens)[:-1]]).tolist()
    assert read(segments(empty, Q.vocabulary(), end=1)).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 65535), max_size=300), st.integers(1, 40), st.booleans())
def test_codec_round_trip(base, times, wide):
    x = np.array(base * times, np.uint32)
    assert (_codec.decode(_codec.encode(x, wide)) == x).all()


def test_codec_checks_blocks():
    rng = np.random.default_rng(0)
    x = (rng.zipf(1.2, 3 * _codec.BLOCK + 17) % 50_000).astype(np.uint32)
    coded = bytearray(_codec.encode(x))
    assert (_codec.decode(bytes(coded)) == x).all() and len(coded) < 2 * len(x)
    wide = x.astype(np.uint32) * 70_000
    assert (_codec.decode(_codec.encode(wide, True)) == wide).all()
    coded[-40] ^= 1
    with pytest.raises(ValueError):
        _codec.decode(bytes(coded))


def test_codec_groups(monkeypatch):
    """More blocks than are coded side by side, all ids of a block distinct, one id alone; each block is coded by itself."""
    monkeypatch.setattr(_codec, "LANES", 3)
    rng = np.random.default_rng(1)
    n = _codec.BLOCK
    x = np.concatenate([rng.permutation(n) + 7, np.full(n, 65535), rng.integers(0, 9, 2 * n), rng.permutation(65536)[: n + 5], [3]])
    assert (_codec.decode(_codec.encode(x)) == x).all()
    for k in (1, 7, 8, 9, 300, 4000):  # a short last block beside blocks of few ids
        for x_ in (np.concatenate([np.full(2 * n, 5), np.full(k, 7)]), np.concatenate([np.full(n, 5), rng.integers(0, 4000, k)]), rng.integers(0, 3, n + k)):
            assert (_codec.decode(_codec.encode(x_)) == x_).all()
    first = np.frombuffer(_codec.encode(x[:n]), "<u4")[5:8]
    assert (np.frombuffer(_codec.encode(x), "<u4")[5:8] == first).all()


def test_codec_carries(monkeypatch):
    """Blocks beside each other that are counted in several strips, of 16 and 32 bits; a carry goes through words that are full."""
    monkeypatch.setattr(_codec, "_STRIP", 2)
    rng = np.random.default_rng(2)
    n = _codec.BLOCK
    x = np.concatenate([np.repeat(rng.integers(0, 65536, n), 3), rng.zipf(1.1, 8 * n + 5) % 65536, np.full(n, 65535), rng.integers(65500, 65536, n)])
    assert (_codec.decode(_codec.encode(x)) == x).all()
    wide = x * 65537
    assert (_codec.decode(_codec.encode(wide, True)) == wide).all()
    own = np.array([1, 0xFFFFFFFF, 0x1FFFFFFFF, 7, 0xFFFFFFFF, 0x100000000, 3], np.uint64)
    assert _codec._carried(own).tolist() == [2, 0, 0xFFFFFFFF, 8, 0, 0, 3]


def test_codec_takes_fewer_passes_than_ids(monkeypatch):
    """The encoder looks up shares of many steps at once, and the ids come back whatever that number."""
    rng = np.random.default_rng(3)
    n = _codec.BLOCK
    x = np.concatenate([rng.zipf(1.2, 2 * n + 77) % 50_000, np.tile(rng.integers(0, 99, 60), 50)])
    coded = _codec.encode(x)
    for k in (1, 7, 64):
        monkeypatch.setattr(_codec, "_AHEAD", k)
        assert _codec.encode(x) == coded
    assert (_codec.decode(coded) == x).all()


def test_new_pieces_are_learned_once():
    """Pieces met before, new ones, and slices of arrays have the library's ids."""
    from tidemark.llm._tokens import Encoder, _bytes

    a = pa.array([b"", b"ab", b"\xc3\xa9", b"c"])
    assert _bytes(a) == a.to_pylist() and _bytes(a[1:3]) == [b"ab", b"\xc3\xa9"]
    e = Encoder(Q.vocabulary())
    for texts in (["one two", "two three"], ["three four one", None, ""], ["one"]):
        flat, counts = e.encode(pa.array(texts, pa.string()))
        want = [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert flat.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]


def test_codec_is_below_order_0():
    """Fewer bits an id than zlib takes for the whole, and than the ids' own entropy without context, on real texts."""
    import pyarrow.parquet as pq

    from tidemark.llm._tokens import encoder

    x, _ = encoder(Q.vocabulary()).encode(pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text"), 1)
    p = np.bincount(x) / len(x)
    p = p[p > 0]
    coded = len(_codec.encode(x))
    assert coded < len(zlib.compress(x.astype("<u2").tobytes(), 9)) and 8 * coded / len(x) < -(p * np.log2(p)).sum()


def test_token_counts(spark, odd, empty, ids):
    n = np.array([len(ids(r.text)) for r in odd.collect()])
    h = length_histogram(odd, Q.vocabulary())
    rows = h.toPandas()
    assert sorted(zip(rows.n_tokens, rows.n_docs)) == sorted(Counter(n.tolist()).items())
    for r in rows.itertuples():
        assert (r.docs_longer, r.tokens_longer, r.tokens_truncated, r.docs_total, r.tokens_total) == ((n > r.n_tokens).sum(), n[n > r.n_tokens].sum(), np.minimum(n, r.n_tokens).sum(), len(n), n.sum())
        assert abs(r.quantile - (n <= r.n_tokens).mean()) < 1e-12
    for limit in (0, 5, 100, 10**6):
        assert tuple(at_limit(h, limit).first()) == ((n <= limit).sum(), np.minimum(n, limit).sum(), n.sum() - np.minimum(n, limit).sum())
    assert quantile(h, 0.5).first()[0] == np.sort(n)[-(-len(n) // 2) - 1]
    assert length_histogram(empty, Q.vocabulary()).count() == 0


@pytest.mark.parametrize("name", ["op2_decontaminate", "op6_quality_rules", "op8_substring_dedup"])
def test_against_sql(spark, small, name):
    alike(Q.QUERIES[name](spark, small).toPandas(), duck(Q.ORACLE_SQL[name], small))


def test_decontaminate_edges(spark, odd, empty):
    items = spark.createDataFrame([(1, "P1 p2, p3 p4 p5 p6 p7 p8 p9 p10 p11"), (2, "a B"), (3, None), (4, "?!"), (None, "hello world"), (2, "a b"), (30, "p10 p11 p12 p13 p14 p15 p16 p17 p18 p19")], "item_id long, text string")
    docs = odd.where("doc_id is not null and doc_id <> 7")
    got = report(matches(docs, items)).toPandas()
    want = duck(oracles.OP2, "/root/testdata/sf0.001", documents=docs.select("doc_id", "text").toPandas(), benchmark=items.where("item_id is not null").toPandas())
    alike(got, want)
    assert matches(odd, items).count() == odd.count()
    assert matches(odd, items.where("false")).where(F.size("items") > 0).count() == 0
    assert matches(empty, items).count() == 0
    kept = clean(odd, items)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 5, 9}


def test_decontaminate_blocks_and_proximity(spark, monkeypatch):
    from tidemark.llm import decontaminate as D

    docs = spark.createDataFrame([(i, f"x{i} " * 20 + "one two three four " + f"y{i} " * 5 + "five") for i in range(30)], "doc_id int, text string")
    items = spark.createDataFrame([(f"i{k}", f"x{k} x{k} x{k}") for k in range(12)] + [("near", "four five")], "item_id string, text string")
    whole = matches(docs, items, n=4).toPandas()
    monkeypatch.setattr(D, "BLOCK_CHARS", 40)
    monkeypatch.setattr(D, "SHARD_WORDS", 60)
    parts = matches(docs, items, n=4).toPandas()
    for f in (whole, parts):
        f["items"] = f["items"].map(sorted)
        f["spans"] = f["spans"].map(lambda x: [tuple(y) for y in x])
    alike(whole, parts)
    assert matches(docs, items.where("item_id = 'near'"), n=4, slop=6).where(F.size("items") > 0).count() == 30
    assert matches(docs, items.where("item_id = 'near'"), n=4, slop=5).where(F.size("items") > 0).count() == 0


def brute_dedup(rows, length):
    """rows: (doc_id, text); null ids come before all."""
    key = lambda d: (d is not None, d or 0)
    first = {}
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - length + 1):
            x = tuple(w[i : i + length])
            first[x] = min(first.get(x, key(d)), key(d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < key(d):
                gone.update(range(i, i + length))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("length", [1, 3, 20, 50, 130])
def test_substring_dedup(spark, odd, empty, length):
    rng = np.random.default_rng(length)
    pool = [" ".join(rng.choice(list("abcdefgh"), 90)) for _ in range(6)]
    extra = spark.createDataFrame([(100 + i, " ".join(rng.choice(pool, 2)) + f" z{i} " + " ".join(pool[i % 6].split()[i:])) for i in range(40)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(extra)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [(None if d != d else d, n, g, k) for d, n, g, k in dedup(docs, length).toPandas().itertuples(index=False)]
    assert sorted(got, key=str) == sorted(brute_dedup(rows, length), key=str)
    assert dedup(empty, length).count() == 0


def test_substring_dedup_keeps_columns(odd):
    got = cleaned(odd, 50)
    assert got.columns == odd.columns
    texts = {(r.doc_id, r.source): r.text for r in got.collect()}
    assert texts[(4, "b")] == " \n\t " and texts[(7, "c")] == "other" and (8, "a") not in texts and texts[(6, "b")] == "start end"


def brute_links(rows, t=(4, 5)):
    sets = []
    for _, x in rows:
        w = WORD.findall(x or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    n = len(rows)
    links, group = [0] * n, list(range(n))
    for i in range(n):
        for j in range(n):
            if i != j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if both * t[1] >= t[0] * (len(sets[i]) + len(sets[j]) - both):
                    links[i] += 1
                    a, b = group[i], group[j]
                    group = [min(a, b) if g in (a, b) else g for g in group]
    return links, group


def test_ngram_join(spark, odd, empty, small, monkeypatch):
    from tidemark.llm import ngram_join as N

    rng = np.random.default_rng(4)
    vocabulary = [f"v{i}" for i in range(400)]
    base = [list(rng.choice(vocabulary, 80)) for _ in range(3)]
    rows = []
    for i in range(90):
        w = list(base[i % 3])
        for j in rng.integers(0, 80, rng.integers(0, 4)):
            w[j] = f"e{i}"
        rows.append((1000 + i, " ".join(w)))
    docs = odd.select("doc_id", "text").where("doc_id is not null").unionByName(spark.createDataFrame(rows, "doc_id long, text string")).unionByName(spark.read.parquet(f"{small}/documents.parquet").select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: r[0])
    links, group = brute_links(rows)
    monkeypatch.setattr(N, "SPLIT", 8)
    monkeypatch.setattr(N, "BLOCK", 6)
    got = sorted((r.doc_id, r.n_links, r.class_id) for r in near_duplicates(docs).collect())
    want = sorted((rows[i][0], links[i], rows[group[i]][0]) for i in range(len(rows)))
    assert got == want
    kept = one_each(odd.where("doc_id is not null"))
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 6, 9, 10]
    assert near_duplicates(odd).count() == odd.count() and near_duplicates(empty).count() == 0


def test_quality_rules_edges(spark, odd, empty):
    got = judge(odd).toPandas()
    assert len(got) == odd.count() and judge(empty).count() == 0
    docs = odd.where("doc_id is not null and doc_id <> 7 and text is not null and source is not null and instr(text, char(0)) = 0")
    alike(judge(docs).toPandas(), duck(oracles.OP6, "/root/testdata/sf0.001", documents=docs.select("doc_id", "text", "source").toPandas()))
    line = "this line is on every page of the host"
    rows = [(i, f"{line}\n" * 3 + ("" if i < 5 else " ".join(f"own{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j % 26)}" for j in range(60))), "h") for i in range(40)] + [(99, f"{line} again {i}", "other") for i in range(1)]
    rows = [(d, t if d != 3 else t + "and a few more words", s) for d, t, s in rows]
    kept = {r.doc_id: r.kept for r in judge(spark.createDataFrame(rows, "doc_id int, text string, source string"), base_failed=F.lit(False)).collect()}
    assert kept == {d: d >= 5 for d, _, _ in rows}


def test_quality_rules_give_the_remaining_texts(spark, odd, empty):
    """Kept rows with all columns; the text by a plain loop, byte by byte."""
    line, digits = "This line\tis on EVERY page", "seen {} times"
    own = lambda i: " ".join(f"o{chr(97 + i)}{chr(97 + j)}" for j in range(12))
    shapes = [lambda i: f"{line}\n{own(i)}\n\n{digits.format(i)}", lambda i: f"\n{own(i)}\r\n  {line.lower()} \n", lambda i: f"{own(i)}é\n{own(i + 1)}\n", lambda i: line]
    rows = [(i, shapes[i % 4](i % 24), "h", f"t{i}") for i in range(96)] + [(200 + i, None, "h", "none") for i in range(2)]
    rows += [(300, f"{line}\n{own(3)}", "other", "stays"), (300, f"{line}\n{own(3)}", "other", "stays")]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string, `a.b` string").withColumn("k", F.lit("x")).withColumn("gone", F.array(F.lit(1)))
    norm = lambda x: " ".join(re.sub("[0-9]", "0", "".join(c.lower() if "A" <= c <= "Z" else c for c in w)) for w in WORD.findall(x))
    host = {(t, s) for _, t, s, _ in rows}
    n = Counter((s, x) for t, s in host for x in {norm(x) for x in (t or "").split("\n")} - {""})
    often = {k for k, c in n.items() if c > 8 and c > 0.05 * sum(s == k[0] for _, s in host)}
    assert ("h", norm(line)) in often and ("other", norm(line)) not in often
    want = []
    for d, t, s, z in rows:
        rest = t and "\n".join(x for x in t.split("\n") if (s, norm(x)) not in often)
        if len(WORD.findall(rest or "")) >= 0.3 * len(WORD.findall(t or "")):
            want.append((d, rest, s, z, "x", [1]))
    got = quality_rules.cleaned(df, most=8, base_failed=F.lit(False))
    assert got.dtypes == df.dtypes
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    kept = {r.doc_id: r.n_words - r.removed_words for r in judge(df, most=8, base_failed=F.lit(False)).where("kept").collect()}
    assert kept == {w[0]: len(WORD.findall(w[1] or "")) for w in want}
    assert quality_rules.cleaned(empty).count() == 0 and quality_rules.cleaned(odd).columns == odd.columns
    assert quality_rules.cleaned(odd).count() == judge(odd).where("kept").count() > 0


def test_lines_of_a_section_of_a_large_host(spark):
    """A line in 1 % of a hot host's documents goes by its count, in equal texts or not."""
    line = "this notice stands in one section of the host"
    own = lambda i: " ".join(f"w{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{chr(97 + j)}" for j in range(12))
    rows = [(i, f"{line}\n{line}" if 24 <= i < 30 else f"{line}\n" * 3 + own(i)[:10] if i < 24 else own(i), "hot") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    gone = lambda **a: {r.doc_id for r in judge(df, base_failed=F.lit(False), **a).where("removed_words > 0 and not kept").collect()}
    assert gone() == set() and gone(many=24) == set(range(30))  # 24 texts and one that six documents share
    assert gone(many=25) == set() and gone(many=25, copies=True) == set(range(30)) and gone(many=30, copies=True) == set()


def test_digests_of_queries(spark, small, ids):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")
    got = Q.op3_token_binary(spark, small).toPandas().sort_values("doc_id")
    start = 0
    for r, t in zip(got.itertuples(), docs.text):
        x = ids(t) + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(x), crc(x))
        start += len(x)
    p = Q.op1_packing(spark, small).toPandas()
    text = dict(zip(docs.doc_id, docs.text))
    for r in p.sample(300, random_state=0).itertuples():
        x = ids(text[r.doc_id]) + [2]
        assert r.ids_crc32 == crc(x[r.start : r.start + r.length]) and r.doc_tokens == len(x)
    kept = Q.op8_substring_dedup(spark, small).toPandas()
    want = {d: (n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in brute_dedup(list(text.items()), 50)}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in kept.itertuples()} == want
    assert pd.notna(p).all().all()
