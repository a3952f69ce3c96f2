"""Operators 6 and 7, and the corpus pipeline."""

import base64
import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from geolith.llm import common, decontaminate, language_id, mixing, near_dedup, queries


def test_language_id_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = queries.op7_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert len(held) > 20 and np.mean([r.lang == r.lang_pred for r in held]) >= 0.97
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)


def test_language_id_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(docs, language_id.learnable(F.col("doc_id")), most=60)
    texts = [None, "", " 12 + 3 ½", "漢字仮名交じり文" * 30, "a", "the of and " * 50_000, "The of and"]
    df = spark.createDataFrame([(i, t, None, "clash") for i, t in enumerate(texts)] + [(None, "the of and", None, None), (6, "The of and", None, None)], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and all(got[i].rejected and got[i].score == 0 for i in (0, 1, 2))
    assert got[3].rejected and got[3].lang_pred in model.langs and not got[6].rejected and got[None].held_out is False
    kept = language_id.known_language(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {None, 5, 6} and not {0, 1, 2, 3} & {r.doc_id for r in kept.collect()}
    none = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(df, none).collect()} == {"und"}
    assert language_id.identify(df.limit(0), model).count() == 0


UNLEARNED = {
    "fi": "Hallitus kertoi eilen, että uusi laki tulee voimaan ensi kuussa, mutta monet kansalaiset eivät ole tyytyväisiä siihen. Talvella sataa paljon lunta ja järvet jäätyvät, kesällä aurinko paistaa yötä päivää pohjoisessa. Maan pääkaupunki kasvaa joka vuosi. ",
    "pl": "Wczoraj wieczorem rząd ogłosił, że nowa ustawa wejdzie w życie w przyszłym miesiącu, choć wielu obywateli nie jest z niej zadowolonych. Stolica kraju rozwija się bardzo szybko, a liczba mieszkańców rośnie każdego roku. Zimą pada dużo śniegu i jeziora zamarzają. ",
    "tr": "Hükümet dün akşam yeni yasanın gelecek ay yürürlüğe gireceğini açıkladı, ancak birçok vatandaş bundan memnun değil. Ülkenin başkenti çok hızlı gelişiyor ve nüfusu her yıl artıyor. Kışın çok kar yağar ve göller donar. ",
    "sw": "Serikali ilitangaza jana jioni kwamba sheria mpya itaanza kutumika mwezi ujao, lakini wananchi wengi hawajaridhika nayo. Mji mkuu wa nchi unakua kwa kasi sana na idadi ya watu inaongezeka kila mwaka. ",
}


def test_language_id_rejects_unlearned_languages_and_junk_of_any_length(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = np.random.default_rng(3)
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    texts = [x * n for x in UNLEARNED.values() for n in (1, 4, 800)]
    texts += [base64.b64encode(rng.bytes(n)).decode() for n in (375, 15_000)] + [letters(n) for n in (500, 20_000)] + ["".join(map(chr, rng.integers(0x4E00, 0x9FFF, n))) for n in (300, 20_000)]
    model = language_id.fit(docs, language_id.learnable(F.col("doc_id")))
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert [i for i in got if not got[i].rejected] == []
    long = docs.where("lang is not null").groupBy("lang").agg(F.concat_ws(" ", F.collect_list("text")).alias("text")).withColumn("doc_id", F.lit(1))
    assert not language_id.identify(long, model).where("rejected").count()


def brute_model(rows, langs):
    """The method in plain words over labelled (id, lang, text) rows: idf and levels of all of them, centroids of at most a sample's clusters."""
    tf = np.concatenate([language_id.counts(pa.array([x])) for *_, x in rows])
    lang = np.array([x for _, x, _ in rows])
    df = (tf > 0).sum(axis=0)
    idf = (np.log((1 + len(rows)) / (1 + df)) + 1).astype(np.float32)
    own, names = [], []
    for x in sorted(langs):
        v = language_id.vectors(np.array(sorted((r for r in tf[lang == x]), key=lambda r: r.tobytes())), idf)
        c = language_id.cluster(v, language_id.CLUSTERS)
        own.append(c)
        names += [x] * len(c)
    return tf, lang, idf, names, np.concatenate(own)


def test_language_id_equals_brute_force(spark, sf_dir):
    """Every row's language, score and rejection, from dense vectors, one text at a time; the sample holds all rows here."""
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text").collect()]
    rows = [r for r in docs if zlib.crc32(str(r[0]).encode()) % 4 != 2 and r[1] and r[2] and language_id.has_letter(r[2])]
    tf, lang, idf, names, centroids = brute_model(rows, {x for _, x, _ in rows})
    unit = lambda v: v / max(1e-9, float(np.linalg.norm(v)))
    cos = lambda t: [float(unit(np.log1p(t) * idf) @ c) for c in centroids]
    size = lambda t: int(math.log2(max(1, (t > 0).sum())))
    seen = {}
    for t, x in zip(tf, lang):
        sims = cos(t)
        if names[int(np.argmax(sims))] == x:
            seen.setdefault((x, size(t)), []).append(min(language_id.BINS - 1, int(min(1, max(sims)) * language_id.BINS)))

    def level(of):
        full = {s: sorted(b) for s, b in of.items() if len(b) >= language_id.ENOUGH}
        at = {s: b[int(language_id.LOW * len(b))] / language_id.BINS for s, b in full.items()}
        first = min(at, default=None)
        return None if first is None else [at[max(k for k in at if k <= s)] if s >= first else at[first] * language_id.SHORTER ** (first - s) for s in range(language_id.CLASSES)]

    every = {}
    for (_, s), b in seen.items():
        every.setdefault(s, []).extend(b)
    levels = {x: level({s: b for (y, s), b in seen.items() if y == x}) or level(every) for x in set(names)}
    got = {r.doc_id: r for r in queries.op7_language_id(spark, sf_dir).collect()}
    assert len(got) == len(docs) and len(rows) < language_id.SAMPLE
    for doc, _, text in docs:
        r, t = got[doc], language_id.counts(pa.array([text]))[0]
        if not language_id.has_letter(text or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        sims = cos(t)
        best = int(np.argmax(sims))
        assert r.lang_pred == names[best] and abs(r.score - max(sims)) < 1e-5
        least = language_id.MARGIN * levels[names[best]][size(t)]
        assert r.rejected == (max(sims) < least) or abs(max(sims) - least) < 1e-5


def test_language_id_rejects_each_language_that_it_did_not_learn():
    """Fitted without one of the four languages of the test data: at least 0.8 of that one's texts go, at most 0.01 of the held-out others."""
    import duckdb

    rows = duckdb.sql("SELECT doc_id, lang, text FROM '/root/testdata/sf0.1/documents.parquet' WHERE lang IS NOT NULL AND text IS NOT NULL AND doc_id % 4 < 2 ORDER BY doc_id").fetchall()
    rows = [r for r in rows if language_id.has_letter(r[2])]
    tf = np.concatenate([language_id.counts(p) for _, p in language_id.pieces(pa.array([x for *_, x in rows]))])
    lang, held = np.array([r[1] for r in rows]), np.array([zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows])
    for out in sorted(set(lang)):
        train = ~held & (lang != out)
        df = (tf[train] > 0).sum(axis=0)
        idf = (np.log((1 + train.sum()) / (1 + df)) + 1).astype(np.float32)
        own = {x: language_id.cluster(language_id.vectors(tf[train & (lang == x)][: language_id.SAMPLE], idf), language_id.CLUSTERS) for x in sorted(set(lang[train]))}
        names = [x for x, c in own.items() for _ in c]
        model = language_id.Model(idf, names, np.concatenate(list(own.values())), np.zeros((len(names), language_id.CLASSES)))
        best, score = model.nearest(tf[train])
        right, size, uniq = np.array(names)[best] == lang[train], language_id.length_class(tf[train]), sorted(own)
        seen = np.zeros((len(uniq), language_id.CLASSES, language_id.BINS), int)
        np.add.at(seen, (np.array([uniq.index(x) for x in lang[train]])[right], size[right], np.minimum((score[right] * language_id.BINS).astype(int), language_id.BINS - 1)), 1)
        model.least = language_id.levels(seen)[[uniq.index(x) for x in names]]
        best, score = model.nearest(tf)
        gone = score < model.least[best, language_id.length_class(tf)]
        assert gone[lang == out].mean() >= 0.8 and gone[held & (lang != out)].mean() <= 0.01, (out, gone[lang == out].mean(), gone[held & (lang != out)].mean())


def test_language_frequencies_come_from_all_rows(spark):
    rows = [(i, "plain words of text" + (" zqx" if i == 7 else ""), "en") for i in range(200)] + [(None, "never zzz", "en"), (300, "none zzz", None), (301, "12", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, language_id.learnable(F.col("doc_id")), most=5)
    own = [x for i, x, _ in rows[:200] if zlib.crc32(str(i).encode()) % 4 != 2]
    df = (language_id.counts(pa.array(own)) > 0).sum(axis=0)
    assert np.allclose(model.idf, np.log((1 + len(own)) / (1 + df)) + 1, atol=1e-5)


def test_language_levels_are_those_of_each_length():
    seen = np.zeros((3, language_id.CLASSES, language_id.BINS), int)
    seen[0, 9, 160], seen[0, 9, 5], seen[0, 4, 20], seen[1, 8, 100] = 1000, 2, 50, 19
    got = language_id.levels(seen) / language_id.MARGIN
    assert np.allclose(got[0], [0.1 * 0.6**4, 0.1 * 0.6**3, 0.1 * 0.6**2, 0.1 * 0.6, *[0.1] * 5, *[0.8] * 4])  # neither short texts nor two outliers lower it
    assert np.allclose(got[1], got[2]) and np.allclose(got[1], got[0])  # too few of their own


def test_language_vectors_see_whole_texts_and_nothing_else():
    one = language_id.counts(pa.array(["ab"]))
    assert one.sum() == 3 + 2  # " a", "ab", "b ", " ab", "ab "
    two = language_id.counts(pa.array(["ab", "cd", None, "x" * 1000]))
    assert (two[0] == one[0]).all() and two[2].sum() == 0 and two[3].sum() == 1001 + 1000
    assert (language_id.counts(pa.array(["a1!b"])) == language_id.counts(pa.array(["A  b"]))).all()


def brute_copies(doc_id, rate, seed=17):
    parts = max(1, math.ceil(rate / mixing.PART))
    mean, total = rate / parts, 0
    for j in range(1, parts + 1):
        u = int(hashlib.md5(f"{seed}|{doc_id}|{j}".encode()).hexdigest()[:13], 16) / 2**52
        p = cdf = math.exp(-mean)
        k = 0
        while cdf <= u and k < mixing.TABLE:
            k += 1
            p *= mean / k
            cdf += p
        total += k
    return total


def test_mixing(spark):
    rows = [(i, "t", "big" if i % 4 else None if i % 8 else "rare" if i % 64 else "tiny", "clash", 3) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_key string, n_chars long")
    got = mixing.mix(df, {"big": 1.0, "tiny": 3.0, "rare": 0.0}, default=2.0).collect()
    n = {}
    for r in rows:
        n[r[2]] = n.get(r[2], 0) + 1
    weight = {"big": 1.0, "tiny": 3.0, "rare": 0.0, None: 2.0}
    rate = {s: 4000 * w / 6 / n[s] for s, w in weight.items()}
    assert rate["tiny"] > mixing.PART
    want = {r[0]: brute_copies(r[0], rate[r[2]]) for r in rows}
    copies = {}
    for r in got:
        copies.setdefault(r.doc_id, []).append(r.mix_copy)
        assert r.mix_copies == want[r.doc_id] and abs(r.mix_rate - rate[r.source]) < 1e-9
        assert r.mix_key == hashlib.md5(f"order 17|{r.doc_id}|{r.mix_copy}".encode()).hexdigest()
    assert {d: sorted(c) for d, c in copies.items()} == {d: list(range(1, k + 1)) for d, k in want.items() if k}
    for s in ("big", "tiny", None):
        assert abs(sum(r.source == s for r in got) / (4000 * weight[s] / 6) - 1) < 0.12
    few, many = (sorted(map(tuple, mixing.mix(df, max_sources=k).collect()), key=str) for k in (10_000, 1))
    assert few == many and len(few) > 3000
    odd = spark.createDataFrame([(None, None, None), (None, None, None), (1, "", "s")], "doc_id long, text string, source string")
    assert mixing.mix(odd).count() == 2 * brute_copies("null", 0.75) + brute_copies(1, 1.5)
    assert mixing.mix(odd.limit(0)).count() == 0
    clash = spark.createDataFrame([(1, "s", 7.0, 8, 9, "x", "y")], "doc_id long, source string, mix_u double, mix_parts int, mix__u int, MIX___U string, mix_cdf string")
    assert [tuple(r)[:7] for r in mixing.mix(clash, total=3).collect()] == [(1, "s", 7.0, 8, 9, "x", "y")] * brute_copies(1, 3.0)
    plan = mixing.mix(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_poisson_shape(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    counts = [r["count"] for r in mixing.mix(df, total=50_000).groupBy("doc_id").count().collect()]
    assert abs(sum(counts) / 50_000 - 1) < 0.03
    assert abs((20_000 - len(counts)) / (20_000 * math.exp(-2.5)) - 1) < 0.1


def test_pipeline_stage_by_stage(spark, sf_dir, tmp_path):
    assert [s[0] for s in corpus_pipeline.STAGES] == ["language ID", "near-dedup", "decontamination", "mixing", "token files"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(10_001, "漢字仮名交じり文" * 30, None, "s", 1), (10_002, None, "en", "s", 1), (10_003, "", None, None, None)], docs.schema)
    docs = docs.unionByName(extra)
    columns, texts = docs.columns, {r.doc_id: r for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        ids, old = sorted(r.doc_id for r in docs.collect()), sorted(r.doc_id for r in before.collect())
        assert docs.columns == columns or k == 4
        if k == 0:
            assert not {10_001, 10_002, 10_003} & set(ids) and len(ids) >= 0.99 * (len(old) - 3)
        elif k == 1:
            kept = {r.doc_id for r in near_dedup.near_duplicates(before, 5).where("kept").collect()}
            assert set(ids) == kept and len(ids) < len(old)
        elif k == 2:
            dirty = {r.doc_id for r in decontaminate.contamination(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").collect()}
            assert dirty and set(ids) == set(old) - dirty
        elif k == 3:
            assert set(ids) <= set(old) and abs(len(ids) / len(old) - 1) < 0.25
            assert all(tuple(r) == tuple(texts[r.doc_id]) for r in docs.collect())
        else:
            assert ids == old
            rows = sorted((r.start, r.n_tokens) for r in docs.collect())
            assert all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:])) and rows[0][0] == 0


def test_pipeline_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "start", "n_tokens", "ids_crc32"}


def test_scratch_folders_are_kept_until_discarded(spark, sf_dir):
    before = common.made()
    other = common.stored(spark.range(5), "other")
    rows = corpus_pipeline.run(spark, sf_dir)
    assert other.count() == 5 and rows.count() > 0 and len(common.made()) == len(before) + 2
    common.discard(spark, keep=before)
    assert common.made() == before
