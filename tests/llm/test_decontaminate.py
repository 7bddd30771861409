import hashlib
import re

from pyspark.sql import functions as F

from catalogkit.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text, items, window):
    words = WORD.findall(low(text))
    hit, met = set(), set()
    for item, own in items:
        w = WORD.findall(low(own))
        for at in range(max(1, len(w) - window + 1) if w else 0):
            key = w[at : at + window]
            for i in range(len(words) - len(key) + 1):
                if words[i : i + len(key)] == key:
                    hit |= set(range(i, i + len(key)))
                    if item is not None:
                        met.add(str(item))
    return len(words), hit, sorted(met)


ITEMS = [
    (3, "One two three four five six seven eight nine ten eleven twelve"), (20, "six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"), (100, "short one"),
    (100, "short two"), (4, "... !"), (5, None), (None, "no id here"), (6, "a a a a a a a a a a a"), (7, "Ünïcode wörds, größer"), (7, "Ünïcode wörds, größer"), (8, "ten eleven"),
]
LONG = "one two three four five six seven eight nine ten eleven twelve"
TEXTS = [
    None, "", "  ...", LONG.upper(), LONG.replace(" ", " -- \n"), f"x {LONG} thirteen fourteen fifteen sixteen y", "four five six seven eight nine ten eleven", "Short, ONE! short two shortone", "a " * 25, "a " * 9,
    "no id here", "ünïcode wörds größer", "Ünïcode wörds größer!", "é" * 50 + " short one " + "日本" + " short one", "no id here", "short one" * 3, "short\x00one \x7f ten\televen",
]


def frames(spark, texts, items):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, Items string")
    return docs, spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, TEXTS string")


def test_equals_brute_force(spark):
    for window in (2, 3, 10):
        docs, benchmark = frames(spark, TEXTS, ITEMS)
        got = {r.doc_id: r for r in decontaminate.scan(docs, benchmark, window=window).collect()}
        assert len(got) == len(TEXTS)
        for i, text in enumerate(TEXTS):
            n, hit, met = brute(text, ITEMS, window)
            assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (n, len(hit), met), (window, text)
            inside = [w for s in got[i].spans for w in WORD.findall(low(text[s.start : s.end]))]
            words = WORD.findall(low(text))
            assert inside == [words[k] for k in sorted(hit)]


def test_pieces_and_parts_change_nothing(spark, monkeypatch):
    texts = TEXTS + [" ".join([LONG, "filler"] * 400)]
    docs, benchmark = frames(spark, texts, ITEMS)
    whole = sorted(map(str, decontaminate.scan(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "PART_BYTES", 60)
    assert sorted(map(str, decontaminate.scan(docs, benchmark).collect())) == whole
    windows = decontaminate.Windows([(str(i), t.encode()) for i, t in ITEMS if t], 10)
    folded = texts[-1].encode().translate(decontaminate.FOLDED)
    once = windows.scan(folded)
    monkeypatch.setattr(decontaminate, "PIECE", 7)
    assert windows.scan(folded) == once and once[1]


def test_empty_tables_and_repeated_rows(spark):
    docs, benchmark = frames(spark, TEXTS, ITEMS)
    assert decontaminate.scan(docs.limit(0), benchmark).collect() == []
    none = decontaminate.digests(docs, benchmark.limit(0)).collect()
    assert [r.n_words for r in none] == [len(WORD.findall(low(t))) for t in TEXTS]
    assert {(r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in none} == {(0, 0, hashlib.sha256(b"").hexdigest(), False)}
    assert decontaminate.scan(docs.unionByName(docs), benchmark).count() == 2 * len(TEXTS)
    assert decontaminate.digests(docs.where("text IS NULL"), benchmark.where("text IS NULL")).first().n_words == 0


def test_questions_and_answers_have_windows_of_their_own(spark):
    benchmark = spark.createDataFrame([(1, "what is it", "a thing"), (2, "who", None)], "item_id long, question string, answer string")
    docs = spark.createDataFrame([(1, "It is a thing."), (2, "What is it?"), (3, "it a"), (4, "Who?")], "doc_id long, text string")
    got = {r.doc_id: r["items"] for r in decontaminate.scan(docs, benchmark, text_columns=("question", "answer")).collect()}
    assert got == {1: ["1"], 2: ["1"], 3: [], 4: ["2"]}


def test_a_planted_passage_is_found_wherever_it_lies(spark):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()
    passage = " ".join(items[0].text.split()[2:14])
    texts = [passage + " z" * 50_000, "z " * 50_000 + passage.upper(), "z " * 100 + passage.replace(" ", ",\n") + " z" * 100, " ".join(passage.split()[:9])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontaminate.digests(docs, spark.createDataFrame(items).withColumn("DOC_ID", F.lit(1))).sort("doc_id").collect()
    assert [r.contaminated for r in got] == [True, True, True, False]
