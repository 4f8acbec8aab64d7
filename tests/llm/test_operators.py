"""Each operator against brute force or its library, and on odd tables."""

import io
import random
import time
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import pixelweave.llm.queries as Q
from pixelweave.llm import ann, bpe, counts, idfile, mixing, near, quality, substring, toxicity, warc

SF = "/root/testdata/sf0.001"
TOKENS = {n: Q.tokenizer(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model")}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, h string, doc string, ref int, key string, words string, score string, copy int, band int, side string"


def odd_docs(spark, rows=None):
    """Nulls, empty and long texts, ties and repeated rows, and columns whose names the operators use themselves."""
    if rows is None:
        long = " ".join(f"w{i % 700}" for i in range(30_000))
        base = " ".join(f"word{i}" for i in range(120))
        texts = ["", None, " \n\t", "one", "one two", "one two", base, base, base.replace("word60", "other"), long, "<|endoftext|> x  y\n\n z", "é 日本 😀", "a" * 5000]
        rows = [(i, t, "en", "s" if i % 3 else None, None) for i, t in enumerate(texts)]
        rows += [rows[6], (None, base, None, None, 3), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, 1, "h", "d", 2, "k", "w", "s", 3, 4, "x") for r in rows], SCHEMA)


def odd_labels(spark):
    return spark.createDataFrame([(0, 1, 0), (6, 1, 0), (7, 0, 1), (None, 1, 1), (3, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")


ON_DOCS = {
    "substring": lambda d, spark: substring.passages(d),
    "strip": lambda d, spark: substring.strip(d),
    "toxicity": lambda d, spark: toxicity.score(d, toxicity.learn(d, odd_labels(spark))),
    "quality": lambda d, spark: quality.judge(d),
    "mixing": lambda d, spark: mixing.mix(d),
    "bpe": lambda d, spark: bpe.digest(bpe.encode(d, TOKENS["byte_bpe_50k.json"])),
    "idfile": lambda d, spark: idfile.roundtrip(d.where("doc_id IS NOT NULL"), TOKENS["word_bpe_49k.json"]),
    "near": lambda d, spark: near.components(d, 2, 80),
    "keep_one": lambda d, spark: near.keep_one(d),
    "counts": lambda d, spark: counts.count_tokens(d, TOKENS["piece_bpe_32k.model"]),
}
EVERY_ROW = {"toxicity": 16, "quality": 16, "bpe": 16, "idfile": 14, "near": 16, "counts": 16}


@pytest.mark.parametrize("name", ON_DOCS)
def test_odd_and_empty_tables(spark, name):
    got = ON_DOCS[name](odd_docs(spark), spark).collect()
    if name in EVERY_ROW:
        assert len(got) == EVERY_ROW[name]
    assert ON_DOCS[name](odd_docs(spark, []), spark).collect() == []


def test_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    odd_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    odd_labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = corpus_pipeline.cut(stage(spark, docs, str(tmp_path)), f"t{k}")
        assert out.columns == docs.columns
        docs = out
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_passages(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    exact, fuzzy, short = text(60), text(80), text(25)
    edited = [*fuzzy[:30], word(), *fuzzy[31:50], *fuzzy[51:]]
    docs = [text(100) + exact + text(40), text(30) + exact + text(90), text(50) + fuzzy, edited + text(50), text(80) + short, short + text(70), text(200)]
    got = {r["doc_id"]: r for r in substring.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")).collect()}
    assert set(got) == {1, 3}
    assert (got[1]["start_word"], got[1]["end_word"], got[1]["ref_ids"]) == (30, 90, [0])
    assert got[3]["start_word"] == 0 and got[3]["end_word"] == len(edited) and got[3]["ref_ids"] == [2]
    kept = {r["doc_id"]: r["text"].split() for r in substring.strip(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")).collect()}
    assert kept[1] == docs[1][:30] + docs[1][90:] and kept[0] == docs[0] and len(kept) == 7


def test_chains_of_equal_places_are_all_kept():
    """Two documents hold the same places; either may go on beyond them."""
    ref, at, sure = np.array([4, 4, 4, 6, 6]), np.array([3, 8, 12, 3, 8], np.int32), np.zeros(5, bool)
    assert sorted(substring.chained_pairs(ref, at, at + 2, sure)) == [(4, [3, 8, 12], [5, 10, 14]), (6, [3, 8], [5, 10])]


def test_chain_is_best():
    rnd = random.Random(5)
    for _ in range(40):
        p = sorted(rnd.sample(range(120), 9))
        q = [rnd.randrange(120) for _ in p]
        best = max((substring.ANCHOR * len(s) - sum(substring.GAP * (p[b] - p[a] + q[b] - q[a]) for a, b in zip(s, s[1:], strict=False))) for m in range(1, 512) for s in [[i for i in range(9) if m >> i & 1]] if all(q[a] < q[b] for a, b in zip(s, s[1:], strict=False)))
        found = substring.chain(p, q)
        score = max((substring.ANCHOR * len(s) - sum(substring.GAP * (p[b] - p[a] + q[b] - q[a]) for a, b in zip(s, s[1:], strict=False))) for s in found) if found else substring.ANCHOR
        assert abs(best - score) < 1e-9


def test_folding_and_held_out_accuracy(spark):
    assert toxicity.fold("Іd1ot, m0r0n! ＣＬＯＷＮ") == " idiot moron clown "
    m = toxicity.Model({" bad ": 3.0, " aw": 2.0}, [" not bad "], -1.0, (1.0, 1.0))
    assert m.features("not bad at all") == (0.0, 0.0) and m.features("B4D awful")[0] == pytest.approx(np.log1p(5.0))
    got = Q.op2_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.95 * len(got)


def test_toxicity_by_brute_force(spark):
    """The query's scores are those of its model by plain search for each entry; a rare word with clear evidence is learned; labels of held-out rows are not."""
    docs = [(i, " ".join(["fine", "words", f"w{i}", "zorgish" if i % 40 == 1 else "plain", "not zorgish" if i == 5 else ""])) for i in range(600)]
    docs += [(600, "Z0RGISH"), (601, "zorgishly so"), (602, None), (603, "")]
    labels = [(i, 1, int(i % 40 == 1)) for i in range(0, 600)]
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    learned = [toxicity.learn(d, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped)]
    assert learned[0] == learned[1] and " zorgish " in learned[0].weights
    model = toxicity.Model({" bad ": 3.0, " badl": 2.0, " aw": 1.5, " b": 0.5}, [" not bad "], -2.0, (1.5, 0.2))

    def plain(text):
        folded = toxicity.fold(text or "")
        at = {}
        for entry, w in model.weights.items():
            for i in range(len(folded)):
                if folded.startswith(entry, i):
                    at[i] = max(at.get(i, 0.0), w)
        for phrase in model.exceptions:
            for i in range(len(folded)):
                if folded.startswith(phrase, i):
                    at = {a: w for a, w in at.items() if not i <= a < i + len(phrase) - 1}
        total = sum(at.values())
        return 1 / (1 + np.exp(2.0 - 1.5 * np.log1p(total) - 0.2 * 100 * total / (20 + folded.count(" "))))

    texts = [None, "", "bad", "not bad", "not bad but bad", "badly awful bad bad", "B4D аwful", "so not b4d at all, awe"]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(100).collect()]
    got = toxicity.score(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), model).collect()
    assert all(r["score"] == pytest.approx(plain(r["text"]), abs=1e-12) for r in got) and len(got) == len(texts)


def test_warc(spark):
    rows = [(1, "http://a", "x"), (2, None, "x"), (3, "http://c\r\n", ""), (4, "u", None), (5, "u", "é" * 9000)]
    got = {r["page_id"]: r for r in warc.roundtrip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i]["refers_to"] for i in range(1, 6)] == [2, None, 4, None, None] and got[5]["payload_bytes"] == 18000
    assert got[1]["payload_digest"] == warc.digest(b"x") and got[3]["record_type"] == "revisit"
    assert warc.roundtrip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    out = io.BytesIO()
    w = warc.ArchiveWriter(out, warc.train([]))
    for i in range(3):
        w.add(warc.record(i, "http://x", b"payload" * i))
    data = out.getvalue()
    assert [warc.row(*warc.parse(r))[0] for r in warc.read_records(io.BytesIO(data), 7)] == [0, 1, 2]
    for bad in (data[:-3], data[8:], b"", data[:4]):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(bad)))
    good = warc.record(1, "u", b"abc")
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"WARC-Date", b"WARC-Dose"), good.replace(b"abc", b"abd")):
        with pytest.raises(warc.WarcError):
            warc.row(*warc.parse(bad))


def test_warc_of_odd_rows(spark):
    """Rows that repeat a page_id, ties for the largest one, null page_ids and columns with the operator's own names."""
    cols = "page_id long, url string, html string, payload string, digest int, last long, refers_to string"
    rows = [(1, "u", "x"), (1, "u", "x"), (7, "u", "x"), (7, None, "x"), (3, "u", "other"), (3, "u", "x" * 100_000)]
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.roundtrip(spark.createDataFrame([(*r, "p", 1, 2, "r") for r in rows], cols)).collect())
    assert got == sorted([(1, 1, "revisit", 7)] * 2 + [(7, 1, "response", None)] * 2 + [(3, 5, "response", None), (3, 100_000, "response", None)], key=lambda r: r[:3])
    with pytest.raises(Exception, match="page_id"):
        warc.roundtrip(spark.createDataFrame([(None, "u", "x")], "page_id long, url string, html string")).collect()


@pytest.mark.parametrize("name", ["op3_warc", "op4_quality_rules", "op5_source_mixing", "op8_nearest_vectors"])
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = Q.queries()[name](spark, SF).toPandas(), con.execute(Q.oracle_sql()[name]).df()
    cols = sorted(ours.columns)
    rows = lambda f: sorted(str([None if v is None or v != v else v for v in r]) for r in f[cols].astype(object).itertuples(index=False, name=None))
    if name == "op3_warc":
        ours["refers_to"], theirs["refers_to"] = ours["refers_to"].astype("Int64"), theirs["refers_to"].astype("Int64")
        ours, theirs = (f.assign(refers_to=f["refers_to"].fillna(-1).astype(int)) for f in (ours, theirs))
    assert cols == sorted(theirs.columns) and rows(ours) == rows(theirs)


def test_repeated_windows_whose_hashes_are_equal(spark, monkeypatch):
    """With three bits of each hash left, unequal windows stand between equal ones."""
    rnd = random.Random(8)
    texts = ["a b c d e x a b c d e y a b c d e", "p " * 40, "q r s", *(" ".join(rnd.choice("abc") for _ in range(rnd.randint(5, 400))) for _ in range(30)), *(" ".join(rnd.choice("abcdefgh") for _ in range(300)) for _ in range(5))]

    def brute(t):
        w = t.split()
        at = defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i : i + 5])].append(i)
        return len({i + k for x in at.values() if len(x) > 1 for i in x for k in range(5)})

    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    for loss in (0, 30):
        monkeypatch.setattr(quality, "HASH_LOSS", loss)
        assert {r["doc_id"]: r["n_repeat_words"] for r in quality.judge(docs).collect()} == {i: brute(t) for i, t in enumerate(texts)}


def test_poisson_counts(spark):
    for rate in (0.0, 0.3, 2.5, 40.0, 3000.0):
        n = spark.range(20_000).select(mixing.copies(F.lit(rate), mixing.uniform(1, F.col("id"))).alias("n")).agg(F.avg("n"), F.variance("n")).first()
        assert abs(n[0] - rate) <= 5 * (rate / 20_000) ** 0.5 + 1e-9 and abs(n[1] - rate) <= 0.1 * rate + 1e-9


def test_mixing_to_weights(spark):
    docs = spark.createDataFrame([(i, "x" * 10, "ab"[i % 10 == 0]) for i in range(20_000)], "doc_id long, text string, source string")
    n = {r["source"]: r["count"] for r in mixing.mix(docs, {"a": 1.0, "b": 1.0}).groupBy("source").count().collect()}
    assert abs(n["a"] - 10_000) < 500 and abs(n["b"] - 10_000) < 500
    assert {r["source"] for r in mixing.mix(docs, {"b": 1.0}).select("source").distinct().collect()} == {"b"}


def test_weights_that_name_no_source_and_sources_without_text(spark):
    docs = spark.createDataFrame([(1, "x" * 100, "a"), (2, "", "b"), (3, None, "c"), (4, "y" * 100, None)], "doc_id long, text string, source string")
    assert mixing.mix(docs, {}).count() == mixing.mix(docs, {"z": 1.0}).count() == 0
    rate = lambda w: {r["source"]: r["rate"] for r in mixing.rates(docs, w).collect()}
    assert rate({"a": 3.0, "b": 2.0, None: 1.0}) == {"a": 1.5, "b": 1.0, "c": 0.0, None: 0.5}
    assert rate({"b": 1.0}) == {"a": 0.0, "b": 1.0, "c": 0.0, None: 0.0}
    assert rate(None) == {"a": 1.0, "b": 1.0, "c": 1.0, None: 1.0}
    with pytest.raises(ValueError):
        mixing.rates(docs, {"a": -1.0})


def odd_texts():
    rnd = random.Random(1)
    texts = ["", "  a   b \n c  \n\n  d", "<|endoftext|>x <|startoftext|> y", " lead  x", "tail  ", "à é 日本語 😀 it's we'll", "▁ x▁y  z", "a" * 700, "\x1c\x1dx \x85y\x00z", "İß ΣΑΣ"]
    return texts + ["".join(rnd.choice("ab \n\t'sé!1 ▁日<|endoftext|>") for _ in range(rnd.randint(1, 30))) for _ in range(2000)]


def test_bpe_is_the_tokenizers_librarys():
    from tokenizers import Tokenizer

    ref, texts = Tokenizer.from_file(TOKENS["byte_bpe_50k.json"]), odd_texts()
    own = bpe.PairIndexBPE(open(TOKENS["byte_bpe_50k.json"], "rb").read())
    want = [e.ids for e in ref.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in own.encode_batch(texts)] == want
    assert [own.decode(x) for x in want] == [ref.decode(x, skip_special_tokens=False) for x in want]


def test_id_files(spark):
    from tokenizers import Tokenizer

    ref, texts = Tokenizer.from_file(TOKENS["word_bpe_49k.json"]), odd_texts()
    want = [[*e.ids, 1] for e in ref.encode_batch(texts, add_special_tokens=False)]
    for bits, most in ((False, 1 << 26), (True, 300)):
        got = idfile.roundtrip(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), TOKENS["word_bpe_49k.json"], block=128, bits=bits, most_ids=most).orderBy("doc_id").collect()
        start = 0
        for r, ids in zip(got, want, strict=True):
            assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)


def test_id_files_of_odd_rows(spark):
    """Rows that share a doc_id come in the order of their texts; a null doc_id and a damaged plane raise."""
    docs = spark.createDataFrame([(2, "b c"), (1, "z"), (2, "a"), (2, None)], "doc_id long, text string")
    got = [tuple(r) for r in idfile.roundtrip(docs, TOKENS["word_bpe_49k.json"]).orderBy("start").collect()]
    assert [r[:3] for r in got] == [(1, 0, 2), (2, 2, 1), (2, 3, 2), (2, 5, 3)]
    with pytest.raises(Exception, match="without doc_id"):
        idfile.roundtrip(docs.union(spark.createDataFrame([(None, "x")], docs.schema)), TOKENS["word_bpe_49k.json"]).collect()
    out = io.BytesIO()
    w = idfile.IdFileWriter(out, 4)
    w.add(1, np.arange(6, dtype="<u4"))
    w.close()
    assert [(i, x.tolist()) for i, x in idfile.IdFileReader(io.BytesIO(out.getvalue()))] == [(1, [*range(6)])]
    for bad in (out.getvalue()[:20] + b"\x00" + out.getvalue()[21:], out.getvalue()[:-9] + b"\x00" * 9):
        with pytest.raises(Exception):
            [*idfile.IdFileReader(io.BytesIO(bad))]
    with pytest.raises(ValueError, match="another way"):
        idfile.check_form(open(TOKENS["byte_bpe_50k.json"], "rb").read())
    with pytest.raises(ValueError, match="plain byte-level"):
        bpe.PairIndexBPE(open(TOKENS["word_bpe_49k.json"], "rb").read())


def test_token_counts_are_the_tokenizers_librarys():
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = counts.vocabulary(TOKENS["piece_bpe_32k.model"])
    rnd = random.Random(2)
    tied = [("<unk>", 0.0), *((p, -float(rnd.randrange(3))) for p in sorted({"".join(rnd.choice("▁ab") for _ in range(rnd.randint(1, 4))) for _ in range(60)}))]
    for v, fallback in ((vocab, True), (tied, False)):
        ref = Tokenizer(models.Unigram(v, unk_id=0, byte_fallback=fallback))
        ref.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
        own = counts.CountingViterbi(v)
        assert [own.count_text(t)[0] for t in odd_texts()] == [len(e.ids) for e in ref.encode_batch(odd_texts(), add_special_tokens=False)]


def test_vantage_point_trees_are_exact_at_factor_one():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 4)) * rng.uniform(0.8, 1, (3000, 1))
    x /= np.sqrt((x**2).sum(1, keepdims=True)) * rng.uniform(1, 1.1, (3000, 1))
    x[50:90] = x[50]
    tree = ann.VpTree(x, leaf=32)
    exact = np.sort(x[:200] @ x.T, axis=1)[:, ::-1][:, :20]
    made = {}
    for factor, least in ((1.0, 1.0), (1.5, 0.9)):
        rows, _, scores, made[factor] = tree.search(x[:200], 20, factor)
        assert (rows == np.repeat(np.arange(200), 20)).all() and (scores.reshape(200, 20) >= exact[:, -1:] - 1e-9).mean() >= least
    assert made[1.5] < made[1.0] < 0.9 * 200 * 3000


def test_recall_and_pruning_on_the_embeddings():
    """These are all but isotropic in 64 dimensions: nothing can be skipped exactly; factor 6.5 skips a twentieth of all products."""
    import pyarrow.parquet as pq

    x = np.array(pq.read_table("/root/testdata/sf0.1/embeddings.parquet").column("embedding").to_pylist(), float)
    own = np.arange(0, len(x), 20)
    s = x[own] @ x.T
    s[np.arange(len(own)), own] = -np.inf
    top = np.argsort(-s, axis=1, kind="stable")[:, :20]
    for factor, recall, share in ((1.0, 1.0, 1.05), (6.5, 0.9, 0.95)):
        rows, places, _, made = ann.VpTree(x).search(x[own], 20, factor, own)
        hit = np.zeros(s.shape, bool)
        hit[rows, places] = True
        assert hit[np.arange(len(own))[:, None], top].mean() >= recall and made < share * s.size


def test_ties_go_to_the_smallest_ids(spark, monkeypatch):
    """599 different vectors that all score 0, with few candidates held at a time; and rows that repeat an id."""
    rows = [(0, [1.0, *[0.0] * 9])] + [(i, [0.0, *(float(i * k % 601) for k in range(1, 10))]) for i in range(1, 600)]
    monkeypatch.setattr(ann, "HELD", 100)
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, shard_rows=200, leaf=16).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, 0.0) for i in range(1, 21)]
    twice = spark.createDataFrame([(20, [1.0, 0.0]), (20, [2.0, 0.0]), (21, [0.5, 0.0]), (21, [0.5, 0.0])], "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(twice, F.col("vec_id") == 20).collect())
    assert got == [(20, 1, 20, 2.0), (20, 1, 20, 2.0), (20, 2, 21, 0.5), (20, 2, 21, 1.0), (20, 3, 21, 0.5), (20, 3, 21, 1.0)]


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [1.0]), (None, [1.0, 1.0]), *((i, [2.0, 1.0]) for i in range(20, 80)), (7, [3.0, float("inf")])]
    got = ann.nearest(spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, vector string, block int"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    by = defaultdict(list)
    for r in got:
        by[r["query_id"]].append(r["vec_id"])
    assert by[0] == [*range(20, 40)] and by[20] == [*range(21, 41)] and by[40] == [*range(20, 40)]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect() == []


def test_near_duplicates_by_brute_force(spark):
    rnd = random.Random(6)
    texts = []
    for _ in range(12):
        base = [f"w{rnd.randrange(4000)}" for _ in range(rnd.randint(3, 120))]
        texts.append(base)
        for _ in range(rnd.choice([0, 2, 25])):
            texts.append([w if rnd.random() > rnd.choice([0, 0.02, 0.08]) else f"x{rnd.randrange(99)}" for w in base])
    rnd.shuffle(texts)
    texts += [[], ["solo"], ["solo"]]
    sets = [{*zip(t, t[1:], strict=False)} or ({tuple(t)} if t else set()) for t in texts]
    top = [*range(len(texts))]

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    got = near.components(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), 2, 80).collect()
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in got} == {i: (find(i), len(s)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("hot", [2, 64])
def test_near_duplicates_that_no_pivot_links(spark, monkeypatch, hot):
    """A family without an original, whose pivots are withheld: 20 pairs of near copies, all pairs of which are alike at about 0.67."""
    rnd = random.Random(11)
    base, texts = [f"w{i}" for i in range(120)], []
    for group in range(20):
        first = list(base)
        for at in rnd.sample(range(120), 6):
            first[at] = f"g{group}x{at}"
        texts += [first, [*first[:-1], f"y{group}"]]
    sets = [{*zip(t, t[1:], strict=False)} for t in texts]
    assert all((100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])) == (i // 2 == j // 2) for i in range(40) for j in range(i))
    pivots = near.candidates
    monkeypatch.setattr(near, "candidates", lambda keyed, seed: pivots(keyed, seed).where("false"))
    monkeypatch.setattr(near, "HOT", hot)
    monkeypatch.setattr(near, "BLOCK", 8)
    got = near.components(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), 2, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i // 2 * 2 for i in range(40)}


def test_near_pairs_are_confirmed_once(spark, monkeypatch):
    """In a family whose pairs lie mostly below the similarity, sketches are joined to pairs once, and no pair's full sets are compared twice."""
    rnd = random.Random(21)
    base, texts = [f"w{i}" for i in range(120)], []
    for group in range(60):
        first = list(base)
        for at in rnd.sample(range(120), rnd.randint(7, 10)):
            first[at] = f"g{rnd.randrange(3000)}"
        texts += [first, [w if rnd.random() > 0.02 else f"y{group}" for w in first]]
    seen, calls, confirm, likely = [], [], near.confirm, near.likely
    monkeypatch.setattr(near, "confirm", lambda pairs, *rest: (seen.append({(r["id"], r["pivot"]) for r in pairs.collect()}), confirm(pairs, *rest))[1])
    monkeypatch.setattr(near, "likely", lambda *args: (calls.append(1), likely(*args))[1])
    near.components(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), 2, 80).count()
    assert len(seen) == 2 and seen[0] and seen[1] and not seen[0] & seen[1] and len(calls) == 1


def test_passages_whose_seeds_older_documents_hold(spark):
    """An exact repeat of 60 words each of whose 5-word windows stands alone in an older document."""
    words = [f"w{i}" for i in range(60)]
    docs = [words[i : i + 5] for i in range(56)] + [[f"a{i}" for i in range(40)] + words + [f"b{i}" for i in range(40)], [f"c{i}" for i in range(40)] + words + [f"d{i}" for i in range(40)]]
    got = substring.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["start_word"], r["end_word"], r["ref_ids"]) for r in got] == [(57, 40, 100, [56])]


def test_ends_of_passages_whose_middles_many_hold(spark):
    """Exact repeats of 60 words of which twenty older documents hold all but the ends: these are found whole, as are those that two older documents hold."""
    docs, want = [], {}
    for k in range(1, 13):
        for holders in (20, 2):
            passage = [f"p{k}x{holders}x{i}" for i in range(60)]
            docs += [[f"h{len(docs)}x{n}x{i}" for i in range(10)] + passage[k : 60 - k] + [f"t{len(docs)}x{n}x{i}" for i in range(10)] for n in range(holders)]
            docs.append([f"a{len(docs)}x{i}" for i in range(10)] + passage + [f"b{len(docs)}x{i}" for i in range(10)])
            want[len(docs)] = len(docs) - 1
            docs.append([f"c{len(docs)}x{i}" for i in range(10)] + passage + [f"d{len(docs)}x{i}" for i in range(10)])
    got = {r["doc_id"]: r for r in substring.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")).collect() if r["doc_id"] in want}
    assert {d: (r["start_word"], r["end_word"]) for d, r in got.items()} == dict.fromkeys(want, (10, 70))
    assert all(want[d] in r["ref_ids"] for d, r in got.items())


def test_near_duplicates_under_one_template(spark):
    """Pairs of near copies in one family, whose other pairs lie mostly below the similarity, by brute force over all pairs."""
    rnd = random.Random(21)
    base, texts = [f"w{i}" for i in range(120)], []
    for group in range(500):
        first = list(base)
        for at in rnd.sample(range(120), rnd.randint(7, 10)):
            first[at] = f"g{rnd.randrange(3000)}"
        texts += [first, [w if rnd.random() > 0.02 else f"y{group}" for w in first]]
    sets = [np.array([hash(x) for x in {*zip(t, t[1:], strict=False)}]) for t in texts]
    both = near.overlaps([np.unique(s).view(np.uint64) for s in sets], [np.unique(s).view(np.uint64) for s in sets])
    size = np.array([len(s) for s in sets])
    linked = 100 * both >= 80 * (size[:, None] + size[None] - both)
    top = np.arange(len(texts))
    while (new := np.where(linked, top[None], len(texts)).min(1)).tolist() != top.tolist():
        top = new
    got = near.components(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), 2, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(top.tolist()))


def test_overlaps_by_brute_force(monkeypatch):
    rng = np.random.default_rng(3)
    a, b = ([np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(n)] for n in (7, 5))
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert near.overlaps(a, b).tolist() == want
    monkeypatch.setattr(near, "COLUMNS", 7)
    assert near.overlaps(a, b).tolist() == want


def test_rows_that_share_an_id(spark):
    """Texts that share a doc_id are documents each: near_dedup keeps both, strip cuts a repeat out of the row that holds it."""
    w = [f"w{i}" for i in range(60)]
    texts = [w, [*w, *(f"a{i}" for i in range(50))], [f"b{i}" for i in range(30)], [f"c{i}" for i in range(30)]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in zip((0, 1, 1, 2), texts, strict=True)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"].split()) for r in substring.strip(docs).collect()) == [(0, w), (1, texts[1][60:]), (1, texts[2]), (2, texts[3])]
    assert [(r["doc_id"], r["start_word"], r["end_word"], r["ref_ids"]) for r in substring.passages(docs).collect()] == [(1, 0, 60, [0])]
    again = docs.union(docs.where("doc_id = 1"))
    assert sorted((r["doc_id"], r["text"].split()) for r in near.keep_one(again).collect()) == sorted(zip((0, 1, 1, 2), texts, strict=True))


@pytest.mark.parametrize("identity", [1.0, 0.95, 0.9])
def test_fuzzy_passages_by_brute_force(spark, identity):
    """Passages of 60 to 100 words among common windows that older documents hold: all are found, nothing else is."""
    rnd = random.Random(7)
    word = lambda: f"v{rnd.randrange(10**6)}"
    common = [[word() for _ in range(8)] for _ in range(30)]
    fill = lambda n: [w for _ in range(n) for w in (rnd.choice(common) + [word() for _ in range(9)])]
    docs, want = [fill(4) for _ in range(60)], {}
    for _ in range(40):
        passage = [word() if rnd.random() < 0.5 else w for w in fill(6)][: rnd.randint(60, 100)]
        docs.append(fill(2) + passage + fill(2))
        before = fill(2)
        edited = [w if rnd.random() < identity else word() for w in passage]
        want[len(docs)] = (len(before), len(before) + len(edited))
        docs.append(before + edited + fill(2))
    got = defaultdict(list)
    for r in substring.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")).collect():
        got[r["doc_id"]].append((r["start_word"], r["end_word"]))
    assert set(got) <= set(want)
    found = sum(any(a <= start + 8 and b >= end - 8 for a, b in got[d]) for d, (start, end) in want.items())
    assert found >= (40 if identity == 1 else 38)


def test_token_queries_are_the_libraries(spark):
    """The queries' digests and counts over a whole table, by the libraries themselves."""
    import hashlib

    from tokenizers import Tokenizer, models, pre_tokenizers

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    own = Tokenizer.from_file(TOKENS["byte_bpe_50k.json"])
    own.no_truncation()
    own.no_padding()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = Q.op6_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = own.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(own.decode(ids, skip_special_tokens=False)))
    unigram = Tokenizer(models.Unigram(counts.vocabulary(TOKENS["piece_bpe_32k.model"]), unk_id=0, byte_fallback=True))
    unigram.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    got = {r["doc_id"]: r["n_tokens"] for r in Q.op10_token_counts(spark, SF).collect()}
    assert got == {i: len(unigram.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}


def test_pipeline_by_brute_force(spark, tmp_path):
    """Each stage on its predecessor's rows: the model's verdicts, components of all pairs, exact repeats, counts by inverted sums, the library's ids."""
    import hashlib
    import math

    import corpus_pipeline as P
    from tokenizers import Tokenizer

    rnd = random.Random(13)
    text = lambda n: " ".join(f"v{rnd.randrange(900)}" for _ in range(n))
    shared, rows = text(70), []
    for i in range(150):
        rows.append((i, text(rnd.randint(30, 120)), "en", f"s{i % 3}"))
    for i in range(150, 175):
        words = rows[i - 150][1].split()
        words[rnd.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words) if i % 2 else rows[i - 150][1], "en", "s0"))
    rows += [(i, f"{text(40)} {shared} {text(40)}", "en", "s1") for i in range(175, 185)]
    rows += [(i, f"{text(40)} vilest filth {text(10)}", "de", "s2") for i in range(185, 225)]
    rows += [(225, None, None, None), (226, "", "en", "s1"), (None, text(30), "en", "s2")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int("vilest" in (r[1] or ""))) for r in rows if r[0] is not None and r[0] % 3], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out, now = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES:
        now = P.cut(stage(spark, now, str(tmp_path)), f"test-{name}")
        out[name] = now.collect()
    ids = lambda name: sorted((r["doc_id"] for r in out[name]), key=str)
    assert ids("toxicity") == sorted((r[0] for r in rows if "vilest" not in (r[1] or "")), key=str)

    def alike(a, b):
        x, y = ({*zip(*(t.split()[k:] for k in range(5)), strict=False)} for t in (a, b))
        return x and 100 * len(x & y) >= 80 * len(x | y)

    kept = [r for r in out["toxicity"] if r["doc_id"] is None or not any(q["doc_id"] is not None and q["doc_id"] < r["doc_id"] and alike(q["text"] or "", r["text"] or "") for q in out["toxicity"])]
    assert ids("near_dedup") == sorted((r["doc_id"] for r in kept), key=str)
    was = {r["doc_id"]: r["text"] for r in out["near_dedup"]}
    for r in out["substring_dedup"]:
        repeat = r["doc_id"] is not None and 175 < r["doc_id"] < 185
        assert r["text"] == (was[r["doc_id"]].replace(shared + " ", "") if repeat else was[r["doc_id"]]) and r["n_chars"] == (r["text"] if r["text"] is None else len(r["text"]))  or r["text"] is None
    assert len(out["substring_dedup"]) == len(was)
    chars = defaultdict(int)
    for r in out["substring_dedup"]:
        chars[r["source"]] += len(r["text"] or "")
    total, spent = sum(math.sqrt(c) for c in chars.values()), sum(chars.values())
    want = defaultdict(int)
    for r in out["substring_dedup"]:
        rate = math.sqrt(chars[r["source"]]) / total * spent / chars[r["source"]] if chars[r["source"]] else 1.0
        u = (int(hashlib.md5(f"17:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        k, p = 0, math.exp(-rate)
        c = p
        while c < u:
            k, p = k + 1, p * rate / (k + 1)
            c += p
        want[r["doc_id"]] += k
    got = defaultdict(int)
    for r in out["source_mixing"]:
        got[r["doc_id"]] += 1
    assert dict(got) == {i: n for i, n in want.items() if n}
    own = Tokenizer.from_file(TOKENS["byte_bpe_50k.json"])
    encoded = sorted((str(r["doc_id"]), hashlib.sha256(",".join(map(str, own.encode(r["text"] or "", add_special_tokens=False).ids)).encode()).hexdigest()) for r in out["source_mixing"])
    assert sorted((str(r["doc_id"]), r["ids_sha256"]) for r in out["bpe"]) == encoded


def test_rows_of_texts_are_hashed_as_each_alone():
    """Words, windows and minimizers of texts in a row, by brute force over each text."""
    rnd = random.Random(1)
    some = ["a", "b", "cc", "Ünder", "longerthaneight", "longerthaneight" * 40, "x\0"]
    texts = [" ".join(rnd.choice(some) for _ in range(rnd.choice([0, 1, 4, 5, 6, 9, 13, 14, 30, 100]))) + rnd.choice(["", " ", "\n"]) for _ in range(300)]
    row = substring.Row(pa.array(texts))
    split = [t.encode().lower().split() for t in texts]
    assert np.diff(row.ends).tolist() == [*map(len, split)]
    flat = [w for ws in split for w in ws]
    assert len({*zip(flat, row.w.tolist(), strict=True)}) == len({*flat}) == len({*row.w.tolist()})
    h = row.windows()
    for span in (substring.SPAN, substring.SPARSE):
        want = []
        for a, ws in zip(row.ends.tolist(), split, strict=False):
            o = substring.mix(h[a : a + max(0, len(ws) - substring.SIZE + 1)]).tolist()
            at = sorted({i for s in range(max(1, len(o) - span + 1)) if o for i in range(s, min(s + span, len(o))) if o[i] == min(o[s : s + span])})
            want += [a + i for k, i in enumerate(at) if not k or o[i] != o[at[k - 1]]]
        assert row.minimizers(h, span).tolist() == want


def test_released_frames_leave_no_shuffle_files(spark):
    from pixelweave.llm import _shared

    _shared.release(spark)
    time.sleep(2)
    shuffles = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    before = shuffles.size()
    _shared.cut(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 9).alias("k")).count(), "released")
    _shared.release(spark)
    time.sleep(2)
    assert shuffles.size() <= before


def test_words_are_encoded_when_they_are_first_met():
    """A word is made once, on its first look-up, and pieces that words share once."""
    with open(TOKENS["word_bpe_49k.json"], "rb") as f:
        known = idfile.WordIds(f.read())
    first = known[b"piece1"]
    assert first == known[b"piece"] + known[b"1"] and {*known} == {b"piece1", b"piece", b"1"} and {*known.pieces} == {"piece", "1"}
