import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogkit.llm import langid, quality, toxicity

SF = "/root/testdata/sf0.01"
EDGES = [(1, None, "en"), (2, "", "en"), (3, "12 34 !!", None), (4, "x" * 50_000, "fr"), (5, "the word " * 20_000, "de"), (5, "the word", "de"), (None, "le mot", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def edge_docs(spark):
    return spark.createDataFrame([(*r, 0.0, 1) for r in EDGES], "doc_id long, text string, lang string, score double, y int")


def test_language_of_held_out_documents(docs):
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = langid.identify(docs).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert np.mean([r.rejected for r in got]) < 0.02


def test_language_edges_and_rejection(spark, docs):
    model = langid.fit(docs)
    got = {(r.doc_id, n): r for n, r in enumerate(langid.predict(edge_docs(spark), model).collect())}
    assert len(got) == len(EDGES)
    assert [got[k].lang_pred for k in sorted(got, key=lambda k: k[1])[:3]] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = spark.createDataFrame([(1, "ξψω θυρ ζηβ " * 30, "en", 0.0, 1)], "doc_id long, text string, lang string, score double, y int")
    assert langid.predict(odd, model).first().rejected
    assert langid.keep_spoken(odd, model).collect() == []
    nothing = docs.limit(0)
    assert langid.identify(nothing).collect() == []
    assert langid.predict(edge_docs(spark), langid.fit(nothing)).first().lang_pred == "und"


def test_quality_of_held_out_documents(docs, labels):
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = quality.classify(docs, labels).collect()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == docs.count() and len(held) > 40
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)


def toxic_words(texts, labels):
    """Words of at least three toxic texts and, text for text, ten times rarer in clean ones."""
    met = {0: Counter(), 1: Counter()}
    for t, y in zip(texts, labels):
        met[y].update(set(toxicity.words_of(t)))
    n = Counter(labels)
    return {w for w, k in met[1].items() if k >= 3 and met[0][w] / n[0] <= k / n[1] / 10}


def test_toxicity_of_held_out_documents_by_class(spark):
    """Some labelled texts hold no word that tells: they can't be learned, so recall is taken over the others."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    text = {r.doc_id: r.text for r in docs.collect() if r.doc_id in truth}
    learned = [i for i in text if zlib.crc32(str(i).encode()) % 5]
    known = toxic_words([text[i] for i in learned], [truth[i] for i in learned])
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert len(got) == docs.count() and all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    held = [i for i in text if got[i].held_out]
    toxic = [i for i in held if truth[i] == 1]
    plain = [i for i in toxic if known & set(toxicity.words_of(text[i]))]
    assert len(toxic) > 80 and len(plain) >= 0.9 * len(toxic)
    assert np.mean([got[i].predicted == 1 for i in plain]) >= 0.95
    assert np.mean([got[i].predicted == 1 for i in toxic]) >= 0.88
    assert np.mean([got[i].predicted == 0 for i in held if truth[i] == 0]) >= 0.985


def test_planted_words_are_told_in_every_language(spark):
    """Clear cases: words that only toxic texts hold, few to each language."""
    rng = np.random.default_rng(4)
    common = {lang: [f"{lang}{a}{b}" for a in "aeiou" for b in "bcdfghklmn"] for lang in ("en", "fr", "de")}
    rows = []
    for i in range(900):
        lang = ("en", "fr", "de")[i % 3]
        words = list(rng.choice(common[lang], 60))
        if i % 5 == 0:
            for at in rng.integers(0, 60, 3):
                words[at] = f"{lang}vile{'xyz'[int(at) % 3]}"
        rows.append((i, " ".join(words), lang, int(i % 5 == 0)))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    got = toxicity.classify(docs, labels).collect()
    for label in (0, 1):
        assert np.mean([r.predicted == label for r in got if r.held_out and rows[r.doc_id][3] == label]) >= 0.99


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_classifier_edges(spark, docs, labels, operator):
    got = operator.classify(edge_docs(spark), labels).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
    assert operator.classify(docs.limit(0), labels).collect() == []
    assert len(operator.classify(docs.limit(5), labels.limit(0)).collect()) == 5


def test_trees_follow_a_known_rule():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] > 0)).astype(float)
    forest = quality.grow(x[:400], y[:400], depth=3)
    assert ((forest.score(x[400:]) > 0.5) == y[400:]).mean() > 0.93


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(500, 4)), (rng.random(500) < 0.4).astype(float)
    forest = quality.grow(x, y, trees=12)

    def walk(row):
        total = forest.base
        for node in forest.roots.tolist():
            while forest.left[node] != node:
                node = forest.left[node] if row[forest.feature[node]] <= forest.cut[node] else forest.right[node]
            total += forest.value[node]
        return 1 / (1 + np.exp(-total))

    assert forest.score(x) == pytest.approx([walk(r) for r in x])


def test_a_rare_class_is_sampled_and_keeps_its_share(spark):
    rows = [(i, ("good words here and there " if i % 50 else "# $ % ") * (3 + i % 5)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 50 == 0)) for i, _ in rows], "doc_id long, quality int")
    got = quality.classify(docs, labels, sample_rows=60).collect()
    assert np.mean([r.predicted == (r.doc_id % 50 == 0) for r in got]) > 0.99
    blind = spark.createDataFrame([(i, "the same text") for i in range(3000)], "doc_id long, text string")
    assert quality.classify(blind, labels, sample_rows=60).first().score == pytest.approx(0.02, abs=0.005)


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_repeated_ids_teach_once(spark, docs, labels, operator):
    few, seen = docs.where("doc_id < 200"), labels.where("doc_id < 200")
    again = few.where("doc_id = 3").crossJoin(spark.range(300)).drop("id")
    more = few.unionByName(again.withColumn("text", F.lit("~")) if few.where("doc_id = 3").isEmpty() else again)
    one, two = operator.fit(few, seen), operator.fit(more.repartition(3), seen)
    texts = [r.text for r in few.limit(40).collect()]
    if operator is quality:
        x = np.array([quality.statistics(t) for t in texts])
        assert one.score(x) == pytest.approx(two.score(x))
    else:
        assert one.score(texts) == pytest.approx(two.score(texts))


def small_network(**shape):
    net = toxicity.Network(buckets=97, dims=5, filters=3, **shape)
    net.start(1)
    net.bias += 0.1
    lexicon = toxicity.Lexicon(97)
    return net, lexicon


def test_convolution_equals_a_loop():
    net, lexicon = small_network()
    texts = ["", "one", "one two", "b a c a b d e f g a", None, "x y z " * 30]
    got = net.score(texts, lexicon)
    for text, score in zip(texts, got):
        words = toxicity.words_of(text)
        x = [sum(net.table[r] for r in toxicity.rows_of(w, 97)) for w in words] + [np.zeros(5)] * (2 if words else 3)
        pooled, column = [], 0
        for w in toxicity.WIDTHS:
            for f in range(3):
                pooled.append(max(sum(x[i + k] @ net.kernel[:, column + 3 * k + f] for k in range(w)) for i in range(max(1, len(words)))))
            column += 3 * w
        raw = np.maximum(np.array(pooled) + net.bias, 0) @ net.weight + net.offset
        assert score == pytest.approx(1 / (1 + np.exp(-raw)), abs=1e-5)


def test_long_texts_are_scored_in_pieces(monkeypatch):
    net, lexicon = small_network()
    texts = [" ".join(f"w{i * i % 61}" for i in range(n)) for n in (0, 1, 5, 6, 7, 8, 50, 3, 200)]
    whole = net.score(texts, lexicon)
    for piece in (1, 2, 3, 7, 64):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        assert net.score(texts, lexicon) == pytest.approx(whole, abs=1e-6)


def test_gradients_equal_differences():
    net, lexicon = small_network()
    for name in ("table", "kernel", "bias", "weight"):
        setattr(net, name, getattr(net, name).astype(float) * 5)
    numbers = [lexicon.numbers(t) for t in ("a b c d", "c a", "e e f g h", "")]
    rows, y, weights = np.array(lexicon.rows), np.array([1.0, 0.0, 1.0, 0.0]), np.array([1.0, 2.0, 0.5, 1.0])
    _, grads = net.gradients(numbers, rows, y, weights)
    at, values = grads.pop("table")
    grads["table"] = np.zeros(net.table.shape)
    grads["table"][at] = values
    rng = np.random.default_rng(2)
    for name in ("kernel", "bias", "weight", "table"):
        own = getattr(net, name)
        places = [tuple(rng.integers(0, n) for n in own.shape) for _ in range(15)] if name != "table" else [(int(r), int(rng.integers(0, 5))) for r in at[at > 0][:20]]
        for place in places:
            kept, found = own[place], []
            for step in (1e-4, -1e-4):
                own[place] = kept + step
                found.append(net.gradients(numbers, rows, y, weights)[0])
            own[place] = kept
            assert grads[name][place] == pytest.approx((found[0] - found[1]) / 2e-4, abs=2e-3, rel=2e-2)


def test_words_that_part_the_classes_are_learned():
    words = [f"w{i}" for i in range(300)]
    rng = np.random.default_rng(4)
    texts = [" ".join([*rng.choice(words, 40), *(["you vile creature"] if i % 4 == 0 else [])]) for i in range(400)]
    y = np.array([float(i % 4 == 0) for i in range(400)])
    net = toxicity.train(texts, y, ["en", "de"] * 200)
    filler = " ".join(rng.choice(words, 3000))
    near, far = net.score([filler + " you vile creature " + filler, filler])
    assert near > 0.5 > far
    assert set(net.thresholds) == {"en", "de"} and all(0 < t < 1 for t in net.thresholds.values())


def test_thresholds_follow_their_language():
    rng = np.random.default_rng(5)
    y = np.tile([0.0, 1.0], 200)
    langs = ["en"] * 200 + ["de"] * 200
    scores = np.where(y == 1, 0.9, 0.1) + rng.normal(0, 0.02, 400)
    scores[200:] = np.where(y[200:] == 1, 0.4, 0.1) + rng.normal(0, 0.02, 200)
    found = toxicity.thresholds(scores, y, langs)
    assert 0.35 < found["en"] < 0.65 and 0.15 < found["de"] < 0.35
    assert all(((scores[i] >= found[langs[i]]) == y[i]) for i in range(400))
    assert toxicity.thresholds(scores, np.ones(400), langs) == {}


def test_most_documents_have_embeddings(docs, labels):
    net = toxicity.fit(docs, labels)
    lexicon = toxicity.Lexicon(net.buckets)
    texts = [r.text for r in docs.where("text IS NOT NULL").collect()]
    known = [lexicon.numbers(t) for t in texts]
    length = np.abs(net.table[np.array(lexicon.rows)].sum(axis=1)).sum(axis=1)
    assert np.mean([length[n].any() for n in known]) > 0.95
    assert len({round(s, 9) for s in net.score(texts).tolist()}) > 0.5 * len(texts)


def test_long_texts_are_counted_in_blocks():
    text = "Ein Wort, zwei Wörter und noch ein paar mehr. " * 40
    whole = langid.ngram_counts(text, 4096)
    assert all((langid.ngram_counts(text, 4096, block) == whole).all() for block in (1, 7, 100, len(text.encode()) - 1))


def rare_language(docs, rows):
    """Rows of all languages, of which ``rows`` in Spanish."""
    own = docs.where("lang = 'es' AND length(text) > 1500").orderBy("doc_id")
    return docs.where("lang <> 'es'").unionByName(own.limit(rows)), own


def test_a_rare_language_is_learned(docs):
    few, own = rare_language(docs, 6)
    model = langid.fit(few, sample_rows=40)
    assert set(model.langs) == {r.lang for r in docs.select("lang").distinct().collect()}
    assert len(langid.sample(few, 40, 20_000).where("lang = 'es'").collect()) == 6
    assert np.mean([r.lang_pred == "es" for r in langid.predict(own, model).collect()]) > 0.9


@pytest.mark.parametrize("rows", [1, 4])
def test_a_language_with_few_rows_rejects_few_texts(docs, rows):
    few, _ = rare_language(docs, rows)
    assert np.mean([r.rejected for r in langid.predict(docs, langid.fit(few)).collect()]) < 0.02


def test_long_texts_teach_a_language_without_others(spark, docs):
    long = spark.createDataFrame([(10**6 + i, "ξψω θυρ ζηβ " * 2000, "el") for i in range(3)], "doc_id long, text string, lang string")
    model = langid.fit(docs.select("doc_id", "text", "lang").unionByName(long))
    assert langid.predict(long, model).first().lang_pred == "el"


def test_a_repeated_row_is_sampled_once(spark, docs):
    rows = docs.select("doc_id", "text", "lang")
    again = rows.where("lang = 'en'").limit(1).crossJoin(spark.range(400)).drop("id")
    key = lambda found: sorted((r.doc_id, r.lang) for r in found.collect())
    assert key(langid.sample(rows.unionByName(again), 100, 20_000)) == key(langid.sample(rows, 100, 20_000))


def test_latin_gibberish_and_unlearned_languages_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    noise = [" ".join("".join(rng.choice(letters, rng.integers(2, 11))) for _ in range(n)) for n in (20, 50, 200, 1000)]
    noise += ["\n".join(rng.bytes(32).hex() for _ in range(n)) for n in (2, 20, 100)]
    noise += ["La cucina della nonna era sempre piena di profumi e di voci, e la domenica tutta la famiglia si riuniva intorno al grande tavolo per mangiare insieme."]
    noise += ["W niedzielę cała rodzina spotykała się przy dużym stole, żeby wspólnie zjeść obiad i opowiedzieć sobie, co wydarzyło się w ciągu tygodnia."]
    odd = spark.createDataFrame(list(enumerate(noise)), "doc_id long, text string")
    assert [r.doc_id for r in langid.predict(odd, langid.fit(docs)).where("NOT rejected").collect()] == []
    left_out = langid.predict(docs.where("lang = 'fr' AND length(text) > 200"), langid.fit(docs.where("lang <> 'fr'"))).collect()
    assert np.mean([r.rejected for r in left_out]) > 0.9


def test_registered_toxicity_query_equals_loops(spark):
    """Every row of the query against the fitted network, read word by word and window by window."""
    from catalogkit.llm import queries

    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    net, got = toxicity.fit(docs, labels), {r.doc_id: r for r in queries.op2_convolutional_toxicity(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts) and net.table is not None
    for doc in sorted(texts)[:60]:
        rows = [net.table[toxicity.rows_of(w, net.buckets)].sum(axis=0) for w in toxicity.words_of(texts[doc])] or [np.zeros(net.dims)]
        rows += [np.zeros(net.dims)] * toxicity.PAD
        raw, column, unit = net.offset, 0, 0
        for width in toxicity.WIDTHS:
            for f in range(net.filters):
                best = max(sum(float(rows[at + k] @ net.kernel[:, column + k * net.filters + f]) for k in range(width)) for at in range(len(rows) - toxicity.PAD))
                raw += max(best + float(net.bias[unit]), 0) * float(net.weight[unit])
                unit += 1
            column += width * net.filters
        assert got[doc].score == pytest.approx(1 / (1 + np.exp(-raw)), abs=2e-3)
        assert got[doc].held_out == (zlib.crc32(str(doc).encode()) % 5 == 0)


def test_language_query_equals_loops(spark):
    """TF-IDF, cosine and rejection of the registered query, with grams counted one by one in a dictionary."""
    from catalogkit.llm import queries
    from catalogkit.llm.common import fold

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs.where(fold("doc_id", 4) != 2))
    shift = 64 - model.buckets.bit_length() + 1

    def grams(text):
        low = "".join(c if c.isascii() is False or c.isalpha() else " " for c in text.lower())
        raw = (" " + " ".join(x for x in low.split(" ") if x) + " ").encode()
        out = Counter()
        for n in range(1, 5):
            for at in range(len(raw) - n + 1):
                code = int.from_bytes(raw[at : at + n], "big")
                out[((code + (n << 40)) * 0x9E3779B97F4A7C15 % 2**64) >> shift] += 1
        return out

    learned = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None and any(map(str.isalpha, r.text or ""))]
    met = Counter(g for r in learned for g in grams(r.text))
    for g in list(met)[:300]:
        assert model.idf[g] == pytest.approx(np.log((1 + len(learned)) / (1 + met[g])) + 1)
    got = {r.doc_id: r for r in queries.op9_centroid_language(spark, sf).collect()}
    for r in docs.collect()[:80]:
        counts = grams(r.text or "")
        weights = {g: np.log1p(k) * model.idf[g] for g, k in counts.items()}
        norm = np.sqrt(sum(w * w for w in weights.values()))
        cosines = [sum(w * float(row[g]) for g, w in weights.items()) / norm for row in model.matrix]
        best = int(np.argmax(cosines))
        assert got[r.doc_id].lang_pred == model.langs[best] and got[r.doc_id].score == pytest.approx(cosines[best], abs=1e-4)


def test_a_column_of_many_languages_is_bounded(spark):
    rows = [(i, f"text of some words {i % 7} letters", "common" if i % 2 else f"l{i}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    chosen = langid.sample(docs, 30, 20_000, least=5, most_langs=10).collect()
    langs = Counter(r.lang for r in chosen)
    assert len(langs) == 10 and langs["common"] == 12 and max(langs.values()) <= 30
    plain = langid.sample(docs.where("lang = 'common'"), 30, 20_000).collect()
    hashed = [r.doc_id for r in docs.where("lang = 'common'").orderBy(F.xxhash64("doc_id")).limit(30).collect()]
    assert {r.doc_id for r in plain} == set(hashed)
