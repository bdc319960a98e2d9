"""Manifest, tokenizer alignment and SimHash against SQL and brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from compare import connect, difference

from tablehaul.llm import alignment, merkle, simhash

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# 11


def manifest_differs(df):
    con = duckdb.connect()
    con.register("documents", df.select(*merkle.LEAF_FIELDS).toArrow())

    class There:
        read = type("R", (), {"parquet": staticmethod(lambda path: df)})

    return difference(merkle.op11_nested_merkle_manifest(There, "x"), con, merkle.ORACLE)


def test_manifest_over_several_tiers(spark):
    rows = spark.range(9000).selectExpr("id AS doc_id", "CASE WHEN id % 3 > 0 THEN 'hot' WHEN id % 9 = 0 THEN concat('s', id % 270) END AS source", "'En' AS lang", "id AS n_chars", "concat('Text ', id) AS text")
    assert manifest_differs(rows.repartition(7)) is None


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 4096, 4097])
def test_manifest_of_edge_sizes(spark, n):
    assert manifest_differs(spark.range(n).selectExpr("id AS doc_id", "'s' AS source", "CAST(NULL AS string) AS lang", "1L AS n_chars", "'A' AS text")) is None


def test_manifest_of_odd_rows(spark, docs, texts):
    odd = texts.selectExpr("doc_id", "CASE WHEN doc_id > 3 THEN 'é' WHEN doc_id > 1 THEN '' END AS source", "CAST(NULL AS string) AS lang", "CAST(NULL AS long) AS n_chars", "text", "score", "node")
    more = odd.unionByName(odd).unionByName(docs.limit(40), allowMissingColumns=True)
    assert manifest_differs(more.withColumnRenamed("score", "leaf").withColumnRenamed("node", "rank")) is None
    assert merkle.manifest(odd.limit(0)).count() == 0


def test_a_changed_text_is_not_verified(spark, docs):
    rows = merkle.op11_nested_merkle_manifest(spark, SF).collect()
    upper = {r.doc_id for r in docs.collect() if r.text and re.search("[A-Z]", r.text)}
    import zlib

    assert {r.doc_id for r in rows if not r.verified} == {i for i in upper if zlib.crc32(str(i).encode()) % 5 == 0}


# 12


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    paths = alignment.default_paths()
    a_side = Tokenizer.from_file(paths[0])
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    letters = alignment._byte_letters()
    a_bytes = lambda i: bytes(letters[c] for c in a_side.id_to_token(i))
    b_bytes = lambda i: alignment._piece_bytes(b_side.id_to_piece(i), b_side.is_byte(i))
    found, holds = [], Counter()
    for i, text in rows:
        groups, links = [], Counter()
        raw = (" " + (text or "")).encode()
        a = a_side.encode(raw.decode(), add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        if not text or b"".join(map(a_bytes, a)) != raw or b"".join(map(b_bytes, b)) != raw:
            a = b = []
        ends = [np.cumsum([len(of(t)) for t in side]).tolist() if side else [] for side, of in ((a, a_bytes), (b, b_bytes))]
        x = y = 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append((a[x:p], b[y:q]))
            links.update((s, t) for s in a[x:p] for t in b[y:q])
            x, y = p, q
        written = ";".join(",".join(map(str, s)) + "|" + ",".join(map(str, t)) for s, t in groups)
        found.append((i, len(a), len(b), len(groups), links, hashlib.sha256(written.encode()).hexdigest() if groups else ""))
        holds.update(links.keys())
    best = defaultdict(int)
    for (s, _), n in holds.items():
        best[s] = max(best[s], n)
    return Counter(
        (i, n, m, g, sum(links.values()), sum(k for (s, t), k in links.items() if holds[s, t] == best[s]), sum(k * holds[p] for p, k in links.items()), d)
        for i, n, m, g, links, d in found
    )


ODD = ["foo\n \nbar  baz\n\n qux \t x\x1c y \x85 z  ", " lead  two", "a \u3000b c\u00a0 d", "x\r\n y 's 't  's", "e\u0301 \u0301 a", "a▁b", "<|endoftext|> <unk> </s> <0x41>", "x" * 3000, "中文字符 ☃\x00 z", "  two  spaces  ", "\n\n\t", "ﬁ ½ Å", "é😀 ü\u200b", "a" * 5 + "\r\n" * 40]


def test_alignment_against_brute_force(spark, docs, texts):
    rows = [(r.doc_id, r.text) for r in docs.limit(60).collect()] + [(r.doc_id, r.text) for r in texts.collect()] + [(5000, t) for t in ODD for _ in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "pair")
    got = alignment.aligned(df, alignment.default_paths(), id_col="pair")
    assert Counter(map(tuple, got.collect())) == brute_alignment(rows)
    assert alignment.aligned(df.limit(0), alignment.default_paths(), id_col="pair").count() == 0


def test_several_segments_and_rounds_give_the_same(spark, docs, texts, monkeypatch):
    df = docs.select("doc_id", "text").unionByName(texts.select("doc_id", "text")).repartition(20)
    whole = Counter(map(tuple, alignment.aligned(df, alignment.default_paths()).collect()))
    monkeypatch.setattr(alignment, "SEGMENT", 500)
    assert Counter(map(tuple, alignment.aligned(df, alignment.default_paths(), round_bytes=50_000).collect())) == whole


def test_perfect_hash_is_minimal_and_tells_strangers():
    draw = np.random.default_rng(3)
    for n in (1, 2, 1000, 50_000):
        keys = np.unique(draw.integers(0, 1 << 40, n))
        of = alignment.PerfectHash.build(keys)
        again = alignment.PerfectHash.unpacked(*of.packed())
        assert sorted(again.number(keys).tolist()) == list(range(len(keys)))
        assert again.number(draw.integers(1 << 41, 1 << 42, 100)).max() < len(keys)


def test_a_group_of_many_tokens_is_paired_in_pieces(monkeypatch):
    monkeypatch.setattr(alignment, "PAIRS", 50)
    none = np.zeros(1, np.int64)
    a, b = np.arange(40) % 7, np.arange(30) % 11
    found = alignment.Aligned(none, none, none, none, none, a, np.zeros(40, np.int64), b, np.zeros(30, np.int64))
    _, pair, links = alignment.by_row(found.pairs(100), 10_000)
    assert Counter(dict(zip(pair.tolist(), links.tolist()))) == Counter(int(x) * 100 + int(y) for x in a for y in b)


def test_chunks_and_pieces_give_what_whole_texts_give(docs, monkeypatch):
    random.seed(6)
    tokens = alignment.Tokens.of(*alignment.default_paths())
    bits = ["the", " ", " ", "  ", "\n", "\t", "'s", "é", "中", "▁", "12", "\x1c", "\x85", "\u00a0", "x" * 9, "\u0301", "\x00", "."]
    texts = ["".join(random.choices(bits, k=random.randint(0, 30))) for _ in range(3000)] + [r.text for r in docs.collect()] + [None, ""]
    whole = alignment.align(tokens, texts)
    rows = alignment.by_row(whole.pairs(tokens.b_size), tokens.a_size * tokens.b_size)
    for piece, remembered in ((1 << 20, 1 << 18), (7, 50), (1, 1)):
        monkeypatch.setattr(alignment, "PIECE", piece)
        monkeypatch.setattr(alignment, "REMEMBERED", remembered)
        found = alignment.align_rows(alignment.Chunks(tokens), texts)
        assert found.sums.T.tolist() == [whole.n_a.tolist(), whole.n_b.tolist(), whole.n_groups.tolist(), whole.n_links.tolist()]
        assert found.digests == [hashlib.sha256(w).hexdigest() if w else "" for w in whole.written(tokens)]
        assert all((a == b).all() for a, b in zip(rows, (found.row, found.pair, found.links)))
        texts, tokens = texts[:400], tokens
        whole = alignment.align(tokens, texts)
        rows = alignment.by_row(whole.pairs(tokens.b_size), tokens.a_size * tokens.b_size)


def test_both_byte_level_libraries_agree():
    from tokenizers import Tokenizer

    path = alignment.default_paths()[0]
    other, ours = Tokenizer.from_file(path), alignment.Tokens.of(*alignment.default_paths())
    other.encode_special_tokens = True
    random.seed(5)
    for _ in range(300):
        text = "".join(chr(random.choice([*range(1, 0x600), *range(0x2000, 0x2100), *range(0x4E00, 0x4E20), 0x1F600])) for _ in range(80))
        assert ours.encode([text])[0][0].tolist() == other.encode(" " + text, add_special_tokens=False).ids


# 13


def fingerprint(text):
    w = WORD.findall(text.translate({i: i + 32 for i in range(65, 91)}) if text else "")
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    ones = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def components_of(prints, ids):
    distinct = np.array(sorted(set(prints)), np.uint64)
    close = np.bitwise_count(distinct[:, None] ^ distinct[None, :]) <= simhash.BITS
    label = np.arange(len(distinct))
    while True:
        new = np.array([label[c].min() for c in close])
        if (new == label).all():
            break
        label = new
    of = dict(zip(distinct.tolist(), label.tolist()))
    least = defaultdict(list)
    for p, i in zip(prints, ids):
        least[of[p]].append(i)
    return Counter((i, f"{p:016x}", min((x for x in least[of[p]] if x is not None), default=None)) for p, i in zip(prints, ids))


def result(df, **names):
    return Counter((r[0], f"{r.f % (1 << 64):016x}", r.component_id) for r in simhash.near_duplicates(df, **names).collect())


def test_simhash_against_brute_force(docs, texts):
    df = docs.select("doc_id", "text").unionByName(texts.select("doc_id", "text")).selectExpr("doc_id", "text", "1 AS f", "2 AS component_id", "3 AS hot")
    rows = df.collect()
    assert result(df) == components_of([fingerprint(r.text) for r in rows], [r.doc_id for r in rows])
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def planted():
    draw = np.random.default_rng(9)
    f = draw.integers(0, 1 << 64, 600, np.uint64)
    near = f[:300].copy()
    for i in range(300):
        for bit in draw.choice(64, draw.integers(0, 7), replace=False):
            near[i] ^= np.uint64(1) << np.uint64(bit)
    dense = f[0] ^ np.array([sum(1 << int(b) for b in draw.choice(64, 3, replace=False)) for _ in range(300)], np.uint64)
    return np.unique(np.concatenate([f, near, dense, np.arange(40, dtype=np.uint64), ~np.arange(40, dtype=np.uint64)]))


@pytest.mark.parametrize("cell", [simhash.CELL, 8])
def test_links_connect_all_that_are_near(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    f = planted()
    df = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "f long")
    close = np.bitwise_count(f[:, None] ^ f[None, :]) <= simhash.BITS
    at = {int(x): i for i, x in enumerate(f.view(np.int64))}
    pairs = [(at[r.a], at[r.b]) for r in simhash.links(df).collect()]
    assert all(close[p] for p in pairs)

    def classes(edges):
        label = np.arange(len(f))
        while True:
            new = label.copy()
            for a, b in edges:
                new[a] = new[b] = min(new[a], new[b])
            if (new == label).all():
                return label.tolist()
            label = new

    assert classes(pairs) == classes(np.argwhere(close).tolist())


def test_a_group_of_copies_with_the_lookup_apart(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 10)
    rows = [(i, "one text that many rows hold, word for word") for i in range(5, 60)] + [(None, "another text of one row without an id"), (90, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df) == components_of([fingerprint(t) for _, t in rows], [i for i, _ in rows])


def test_a_very_long_text_is_hashed_in_pieces(monkeypatch):
    random.seed(1)
    text = " ".join(random.choice(["Aa", "b\tc", "dd", "é" * 9, "x" * 300]) for _ in range(3000))
    whole = fingerprint(text)
    for piece in (1, 7, 1000):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert simhash.fingerprint_of([b"", text.encode(), b"One"]).tolist() == [0, whole, fingerprint("One")]
