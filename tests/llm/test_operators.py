"""The operators against brute force, libraries and SQL, on small fixtures."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, difference

from tablehaul.llm import (
    components, decontamination, language, ngram_join, pii, pu_quality, quality_rules, sentencepiece_scan, sharding, substring_dedup, warc,
)
from tablehaul.llm.words import Words

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(5)


def both(docs, texts):
    return docs.unionByName(texts.select("doc_id", "text"))


def test_words_and_runs():
    given = ["a b  c\n", "", None, "\x0b\x1cq é z", "a b c", "abc"]
    w = Words(pa.array(given))
    assert w.count.tolist() == [len((t or "").encode().split()) for t in given]
    assert (w.hashes[:3] == w.hashes[-4:-1]).all() and w.digests()[0][0] == w.digests()[0][4]
    p = w.prefix()
    assert p.run(np.array([0]), np.array([3])) == p.run(np.array([len(w.hashes) - 4]), np.array([len(w.hashes) - 1]))


def test_word_hashes_do_not_depend_on_the_pieces(monkeypatch):
    from tablehaul.llm import words

    random.seed(8)
    given = [" ".join("y" * random.choice([1, 2, 30, 500]) + str(i % 9) for i in range(random.randint(0, 40))) for _ in range(30)]
    whole = Words(pa.array(given)).hashes
    for piece in (1, 16, 600):
        monkeypatch.setattr(words, "PIECE", piece)
        assert (Words(pa.array(given)).hashes == whole).all()


def test_a_long_text_needs_a_bounded_multiple_of_its_size():
    import tracemalloc

    text = pa.array(["some words of ordinary length " * 600_000])  # 18 MB
    tracemalloc.start()
    Words(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 14 * len(text[0].as_buffer())


# 1

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def strict(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        odd = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(odd) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def spans(text):
    found = [(m.start(), i, m.end()) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if strict(k, m.group())]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_pii_base_spans_and_redaction(spark, texts):
    random.seed(1)
    bits = ["a@b.c", "a@b", "@", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (988) 555-2485", "+1", "é😀", "x_y@z.q_r@s.t"]
    bits += [" ", ".", "-", "(", ")", "12", "0", "00001.2.3.255", "\n", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "+", "%"]
    made = [(1000 + i, "".join(random.choices(bits, k=random.randint(0, 14)))) for i in range(400)]
    made += [(5000, "1.2.3.4 " * 900), (5001, "a" * 50000), (5002, "a@b" + ".c" * 20000), (5003, "1 " * 20000)]
    df = spark.createDataFrame(made, "doc_id long, text string").unionByName(texts.select("doc_id", "text"))
    model = pii.Model()
    got = Counter((r.doc_id, r.b) for r in pii.find(df, model).select("doc_id", pii._written("base").alias("b")).collect())
    assert got == Counter((r.doc_id, spans(r.text)) for r in df.collect())
    one = spark.createDataFrame([(1, "me@x.org, 1.2.3.4!"), (2, None), (3, "none")], "doc_id long, text string")
    assert [r.text for r in pii.redact(one, model).orderBy("doc_id").collect()] == ["<EMAIL>, <IP>!", None, "none"]
    assert pii.find(df.limit(0), model).count() == 0


def test_pii_model_learns_and_adds_only_above_its_threshold(spark):
    rows = [(i, f"call +1 (555) 010-{i:04d} or note {i:05d} {i:04d} {i:03d}") for i in range(600)]
    rows += [(1000 + i, f"nothing here {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(df)
    assert len(model.trees) == pii.ROUNDS
    out = pii.find(df, model).collect()
    assert all(set(r.base) <= set(r.spans) for r in out) and not any(r.spans for r in out if r.doc_id >= 1000)


# 2


def jaccard_classes(rows, n=5, threshold=0.8):
    sets, where = [], defaultdict(list)
    for i, r in enumerate(rows):
        w = WORD.findall(r.text or "")
        sets.append({tuple(w[j : j + n]) for j in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
        for g in sets[i]:
            where[g].append(i)
    root, links = list(range(len(rows))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j, shared in Counter(j for g in sets[i] for j in where[g] if j > i).items():
            if shared >= threshold * (len(sets[i]) + len(sets[j]) - shared):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r.doc_id)
    smallest = {k: min((v for v in ids if v is not None), default=None) for k, ids in least.items()}
    return Counter((r.doc_id, smallest[find(i)], links[i]) for i, r in enumerate(rows))


def test_ngram_join_against_brute_force(docs, texts):
    df = both(docs, texts)
    got = ngram_join.link(df).collect()
    want = jaccard_classes(df.collect())
    assert Counter((r.doc_id, r.class_id, r.n_links + r.n_copies) for r in got) == want


def test_a_group_whose_copies_differ_from_each_other(spark):
    random.seed(4)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(120):
        w = list(base)
        for j in random.sample(range(300), 5):
            w[j] = f"e{i}_{j}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.link(df).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == jaccard_classes(df.collect())


def test_keep_one_keeps_columns_and_one_of_each(texts):
    kept = ngram_join.keep_one(texts)
    assert kept.columns == texts.columns
    assert Counter(r.text for r in kept.collect() if r.text and r.text.startswith("same")) == {"same words here now and then": 1}
    assert kept.where("trim(text) = '' OR text IS NULL").count() == texts.where("trim(text) = '' OR text IS NULL").count()
    assert ngram_join.keep_one(texts.limit(0)).count() == 0


def test_keep_one_takes_classes_apart_that_share_an_id(spark):
    given = ["red fox runs over a hill", "blue whale swims in the sea", "ten men sat at one table", "rain fell all night on roofs", "nine old keys fit no lock"]
    ids = [None, None, 5, 5, None]
    rows = [*zip(ids, given), *zip(ids, given), (8, given[0])]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, kept)) == Counter([(8, given[0]), (None, given[1]), (5, given[2]), (5, given[3]), (None, given[4])])


def test_keep_one_leaves_columns_with_any_name_alone(spark, texts):
    names = ("_key", "_rows", "_doc", "_node", "row", "id", "key", "kept_id", "copies", "component", "doc id")
    odd = texts.selectExpr("*", *(f"concat('own ', text) AS `{name}`" for name in names))
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns
    given = {tuple(r) for r in odd.collect()}
    rows = [tuple(r) for r in kept.collect()]
    assert rows and all(r in given for r in rows)
    assert Counter(r[1] for r in rows) == Counter(r.text for r in ngram_join.keep_one(texts).collect())


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# 3


def test_decontamination_finds_copies_and_rewordings_only(spark, docs, texts):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    item = max(bench.collect(), key=lambda r: len(r.text))
    words = item.text.split()
    reworded = " ".join(w for i, w in enumerate(words) if i % 7)
    planted = spark.createDataFrame([(10**6, "Before it. " + item.text.upper() + " And after."), (10**6 + 1, reworded)], "doc_id long, text string")
    df = both(docs, texts).unionByName(planted)
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, bench).collect()}
    plain = lambda s: " " + " ".join(re.sub(r"[^0-9a-z\x80-\U0010ffff]", " ", s.lower()).split()) + " "
    exact = {(r.doc_id, b.item_id) for r in df.collect() for b in bench.collect() if plain(b.text) in plain(r.text or "")}
    assert exact | {(10**6 + 1, item.item_id)} == got
    clean = decontamination.decontaminate(texts, bench)
    assert clean.columns == texts.columns and clean.count() == texts.count()
    assert decontamination.contaminated(df, bench.limit(0)).count() == 0


def test_common_subsequence():
    assert decontamination.common_subsequence([1, 2, 3, 4], [9, 1, 3, 9, 4]) == 3
    assert decontamination.common_subsequence([], [1]) == 0 and decontamination.common_subsequence([1, 1], [1, 1, 1]) == 2


# 4


def test_language_on_held_out_documents(spark):
    got = language.op4_hierarchical_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.where("held_out").join(truth, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_language_of_odd_texts(texts):
    from pyspark.sql import functions as F

    model = language.fit(texts.withColumn("lang", F.lit("en")))
    got = {(r.doc_id, r.lang_pred) for r in language.predict(texts, model).collect()}
    assert {(0, "und"), (2, "und"), (3, "en"), (None, "en")} <= got
    nothing = language.fit(texts.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.predict(texts, nothing).collect()} == {"und"}


# 5


def test_shards_against_sql(spark):
    con = connect("/root/testdata/sf0.01")
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert difference(sharding.shard_documents(df, 100_000), con, sharding.oracle(100_000)) is None


def test_one_id_over_the_limit_and_odd_rows(spark, texts):
    from pyspark.sql import functions as F

    df = spark.range(500).select(F.lit(7).alias("doc_id"), F.repeat(F.lit("x"), 100).alias("text"))
    sizes = sharding.shard_documents(df, 1000).groupBy("shard", "part").agg(F.sum("n_bytes").alias("b"))
    assert sizes.agg(F.max("b"), F.sum("b")).first()[:] == (sizes.agg(F.max("b")).first()[0], 50_000) and sizes.agg(F.max("b")).first()[0] <= 1000
    assert sharding.shard_documents(texts, 100).count() == texts.count()
    assert sharding.shard_documents(texts.limit(0)).count() == 0


def test_shards_are_written_with_every_row_once(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [(None, f"nobody's {i}", i) for i in range(40)] + [(7, "x" * 100, i) for i in range(60)] + [(i, f"text {i}", 0) for i in range(100, 150)]
    df = spark.createDataFrame([*rows, (8, None, 1), (7, "x" * 100, 0)], "doc_id long, text string, n long")
    sharding.write_shards(df, str(tmp_path / "out"), 1000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(map(tuple, back.select(*df.columns).collect())) == Counter(map(tuple, df.collect()))
    assert back.groupBy("_shard").agg(F.sum(F.length("text")).alias("n")).agg(F.max("n")).first()[0] <= 1000
    clash = df.withColumn("_shard", F.lit("own")).withColumn("row", F.lit(1))
    sharding.write_shards(clash, str(tmp_path / "clash"), 1000)
    back = spark.read.parquet(str(tmp_path / "clash"))
    assert Counter(map(tuple, back.select(*clash.columns).collect())) == Counter(map(tuple, clash.collect()))


# 6


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = pu_quality.op6_positive_unlabelled_quality(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert sum(r.quality == r.predicted for r in got) >= 0.95 * len(got)


def test_quality_of_odd_texts(spark, texts):
    labels = spark.createDataFrame([(3, 1), (4, 0), (7, 1), (7, 0), (None, 1), (12345, 1)], "doc_id long, quality int")
    rows = pu_quality.score_documents(texts, labels).collect()
    assert len(rows) == texts.count() and all(0 <= r.score <= 1 for r in rows)
    assert pu_quality.score_documents(texts.limit(0), labels).count() == 0
    assert pu_quality.score_documents(texts, labels.limit(0)).count() == texts.count()


# 7


def test_warc_against_sql_and_odd_pages(spark):
    assert difference(warc.op7_normalised_warc(spark, SF), connect(SF), warc.ORACLE) is None
    rows = [(1, None, None), (None, "u", "x" * 200), (3, "é\n", "x" * 200), (5, None, "x" * 200), (5, None, "x" * 200), (7, "", "é" * 49), (8, "", "é" * 49)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(spark, df).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter(
        [(1, "response", None), (None, "revisit", 3), (3, "response", None), (5, "revisit", 3), (5, "revisit", 3), (7, "response", None), (8, "response", None)]
    )
    assert {bytes(r.payload).decode() for r in got if r.payload is not None} == {"", "x" * 200, "é" * 49}
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_inflate_takes_members_and_refuses_cut_streams():
    import gzip
    import io

    raw = gzip.compress(b"a" * 100_000) + gzip.compress(b"b" * 10)
    assert b"".join(warc.inflate(io.BytesIO(raw).read, 1000)) == b"a" * 100_000 + b"b" * 10
    with pytest.raises(ValueError, match="ends early"):
        list(warc.inflate(io.BytesIO(raw[:-9]).read))


# 8


def test_substrings_against_brute_force(spark, docs, texts):
    random.seed(3)
    base = [f"w{i}" for i in range(400)]
    made = [(None, "a b " * 60), (7, "x " * 34), (8, "x " * 34), (9, "y " * 36), (9, "q " + "y " * 35)]
    for i in range(120):
        w = []
        for _ in range(random.randint(1, 6)):
            a = random.randint(0, 360)
            w += base[a : a + random.randint(20, 60)] if random.random() < 0.6 else random.choices("abc", k=random.randint(1, 40))
        made.append((2000 + i, " ".join(w)))
    df = both(docs, texts).unionByName(spark.createDataFrame(made + made[-5:], "doc_id long, text string").repartition(4))
    rows = [(r.doc_id, WORD.findall(r.text or "")) for r in df.collect()]
    seen = Counter(tuple(w[s : s + 35]) for _, w in rows for s in range(len(w) - 34))
    want = Counter()
    for i, w in rows:
        gone = [False] * len(w)
        for s in range(len(w) - 34):
            if seen[tuple(w[s : s + 35])] > 1:
                gone[s : s + 35] = [True] * 35
        want[i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()] += 1
    assert Counter(map(tuple, substring_dedup.remove_repeats(df).collect())) == want
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_substrings_against_sql_on_odd_rows(spark, texts):
    import duckdb

    shared = " ".join(f"w{i}" for i in range(50))
    made = [(1, "x " * 36), (2, "y " * 35), (3, f"a {shared} b"), (3, f"é {shared}\tc\n\nd"), (None, shared[:-1]), (4, "\u00a0".join("abc") + " " + shared)]
    df = texts.select("doc_id", "text").unionByName(spark.createDataFrame([*made, (5, "q " * 34), (2, "y " * 35)], "doc_id long, text string"))
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    expected = con.execute(substring_dedup.ORACLE).fetchall()
    got = substring_dedup.remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(expected)
    assert any(r.n_removed for r in got)


# 9


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece_scan.load(sentencepiece_scan.default_model())


def test_encoding_is_the_librarys(spark, docs, texts, pieces, monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_scan.default_model())
    df = both(docs, texts)
    text = {(r.doc_id, i): r.text or "" for i, r in enumerate(df.collect())}
    monkeypatch.setattr(sentencepiece_scan, "FAN", 4)
    got = Counter((r.doc_id, tuple(r.ids)) for r in sentencepiece_scan.encode(df, pieces, chunk=400).collect())
    assert got == Counter((k[0], tuple(sp.encode(t))) for k, t in text.items())
    assert all(r.exact for r in sentencepiece_scan.round_trip(df, pieces, chunk=400).collect())
    assert sentencepiece_scan.round_trip(df.limit(0), pieces).count() == 0


def test_chunks_cut_anywhere_agree_with_the_whole(pieces):
    random.seed(2)
    bits = list("abc  \n\té😀theing") + ["the ", "   ", "tion", "中"]
    for _ in range(150):
        text = sentencepiece_scan.escaped("".join(random.choices(bits, k=random.randint(60, 200))))
        whole = pieces.encode(text).tolist()
        size = random.randint(2 * pieces.longest, 60)
        parts = [(text[max(0, s - 2 * pieces.longest) : s], text[s : s + size]) for s in range(0, len(text), size)]
        matrices = [sentencepiece_scan.transfer(pieces, a, b, k == 0) for k, (a, b) in enumerate(parts)]
        states = sentencepiece_scan.fold(matrices)
        some = sentencepiece_scan.product
        assert all(some(matrices) == sentencepiece_scan.combine(some(matrices[:i]), some(matrices[i:])) for i in range(1, len(matrices)))
        got = [i for (a, b), (s, e) in zip(parts, states) for i in sentencepiece_scan.between(pieces, a, b, s, e).tolist()]
        assert got == whole


# 10


def test_rule_counts_against_brute_force(docs, texts):
    def brute(t):
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen = Counter(grams)
        covered = {j for i, g in enumerate(grams) if seen[g] > 1 for j in (i, i + 1, i + 2)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)

    df = both(docs, texts)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = Counter(tuple(r) for r in quality_rules.measure(df).select(columns).collect())
    assert got == Counter((r.doc_id, *brute(r.text)) for r in df.collect())


def test_cutoffs_hold_their_guarantee(spark):
    assert quality_rules.binomial_tail(0, 100, 0.05) == pytest.approx(0.95**100)
    assert quality_rules.binomial_tail(2, 3, 0.5) == pytest.approx(0.875)
    good = " ".join(f"word{i}" for i in range(100))
    rows = [(i, good) for i in range(3000)] + [(9000, good.replace("word", "#$#$"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.range(3000).selectExpr("id AS doc_id", "1 AS quality")
    measured = quality_rules.measure(df)
    out = quality_rules.judge(measured, quality_rules.certified(measured, labels)).collect()
    assert {r.doc_id for r in out if not r.kept} == {9000}
    none = quality_rules.certified(measured, labels.limit(0))
    assert none == {} and quality_rules.judge(measured, none).where("NOT kept").count() == 0


# the pipeline


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"  # the smaller tables have too few labels to learn from

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), before.schema)
        assert docs.columns == before.columns and 0 < docs.count() <= before.count(), name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(last) == docs.count() and all(r.exact for r in last)
    assert sum(labels.get(r.doc_id) == 0 for r in last) <= 2


def test_blocks_of_a_bucket_give_the_classes_of_all_pairs():
    draw = random.Random(5)
    base = [[f"w{draw.randrange(400)}" for _ in range(80)] for _ in range(3)]
    texts = []
    for i in range(60):
        words = list(base[i % 3])
        for _ in range(draw.randrange(3)):
            words[draw.randrange(80)] = f"x{draw.randrange(10**6)}"
        texts.append(" ".join(words))
    component = [7 if i in (0, 3) else 100 + i for i in range(60)]
    linked = {
        (i, j) for i, j in combinations(range(60), 2)
        if ngram_join.jaccard(pa.array([texts[i]]), pa.array([texts[j]]), 5)[0] >= 0.8
    }

    def classes(pairs):
        label = list(range(60))
        for _ in range(60):
            for i, j in pairs:
                label[i] = label[j] = min(label[i], label[j])
        return label

    known = [(0, 3)]
    for same in (True, False):
        own = [same or i % 2 == 0 for i in range(60)]
        group = pa.table({"node": list(range(60)), "component": component, "own": own, "same": [same] * 60, "text": texts})
        out = ngram_join._block_classes(5, 0.8)(group)
        found = list(zip(out["a"].to_pylist(), out["b"].to_pylist()))
        assert len(found) <= 60
        wanted = [p for p in linked if same or own[p[0]] != own[p[1]]]
        assert classes(found + known) == classes(wanted + known)

    apart = pa.table({"node": [1, 2], "component": [1, 2], "own": [True, True], "same": [False, False], "text": ["a b", "a b"]})
    assert ngram_join._block_classes(5, 0.8)(apart).num_rows == 0
    counted = ngram_join._block_counts(5, 0.8)(apart.append_column("copies", pa.array(np.ones(2, np.int64))))
    assert counted["links"].to_pylist() == [0, 0]
