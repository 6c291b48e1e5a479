import zlib

from pyspark.sql import functions as F

from sparkloom.llm import langid

TEXTS = {"aa": "the cat and the dog ran home and then the cat slept", "bb": "der hund und die katze liefen nach hause und dann", "cc": "el perro y la casa son de los que corren hacia el mar"}


def train_on():
    return F.crc32(F.col("doc_id").cast("string")) % 3 != 1


def test_known_and_unseen_words(documents):
    rows = [(k, " ".join(sorted(TEXTS[lang].split(), key=lambda w: hash((w, k)))), lang) for k in range(60) for lang in [sorted(TEXTS)[k % 3]]]
    rows += [(1000, None, "aa"), (1001, "123 !!", "aa"), (1002, "", None), (1003, "hundekatze", None), (1004, "THE CAT", None), (1005, "the cat", "zz"), (None, "the cat", "aa")]
    found = {r.doc_id: r for r in langid.language_id(documents(rows), train_on()).collect()}
    assert len(found) == len(rows)
    assert all(found[k].lang_pred == lang for k, _, lang in rows[:60])
    assert [found[k].lang_pred for k in (1000, 1001, 1002, 1003, 1004)] == ["und", "und", "und", "bb", "aa"]
    assert all(0 <= r.score <= 1 for r in found.values()) and found[None].held_out
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in found.items() if k is not None)


def test_other_columns_are_no_inputs(documents):
    rows = [(k, TEXTS[lang], lang) for k in range(30) for lang in [sorted(TEXTS)[k % 3]]]
    a = {r.doc_id: (r.lang_pred, r.score) for r in langid.language_id(documents(rows), train_on()).collect()}
    changed = [(k, t, lang if k % 2 == 0 or zlib.crc32(str(k).encode()) % 3 != 1 else "aa") for k, t, lang in rows]
    assert a == {r.doc_id: (r.lang_pred, r.score) for r in langid.language_id(documents(changed), train_on()).collect()}


def test_nothing_to_learn_from(documents):
    assert langid.language_id(documents([]), train_on()).count() == 0
    assert {r.lang_pred for r in langid.language_id(documents([(1, "abc", None), (2, "x", None)]), train_on()).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = langid.language_id(docs, train_on()).join(docs, "doc_id").filter("held_out and length(text) > 30")
    assert found.filter("lang_pred = lang").count() >= 0.95 * found.count()


def test_the_model_holds_every_counted_word(documents):
    """More words than the 100,000 that the model once held: none may be treated as unseen."""
    word = lambda k: "".join(chr(97 + k // 26**j % 26) for j in range(5))
    docs = documents([(k, " ".join(map(word, range(500 * k, 500 * k + 500))), "aa" if k % 2 else "bb") for k in range(220)])
    langs, known, logs, hashes, _, _ = langid.train(docs.selectExpr("lang AS _lang", "text AS _text"))
    assert langs == ["aa", "bb"] and len(known) == 110_000 == len(logs)
    assert set(langid.word_hashes([word(0), word(109_999)]).tolist()) <= set(known.tolist())
    assert len(hashes) > 100_000


def test_numbers_are_no_letters(documents):
    rows = [(k, TEXTS[lang], lang) for k in range(30) for lang in [sorted(TEXTS)[k % 3]]] + [(k, text, None) for k, text in ((100, "²"), (101, "Ⅷ ½ 12"), (102, "cat² dog½"), (103, "the " * 300_000), (104, "der hund"), (104, "der hund"))]
    found = langid.language_id(documents(rows), train_on()).collect()
    assert len(found) == 36
    one = {r.doc_id: r for r in found}
    assert [one[k].lang_pred for k in (100, 101, 102, 103, 104)] == ["und", "und", "aa", "aa", "bb"]
    assert langid.words_of("x²y Ⅷ a½") == ["x", "y", "a"]


def test_against_brute_force(documents):
    """The whole scoring in plain Python: counts, smoothed log frequencies less their mean, back-off, posterior; ties go to the first name."""
    import math
    import random

    rng = random.Random(7)
    vocabulary = {lang: ["".join(rng.choice("abcde" if lang == "aa" else "cdefg") for _ in range(rng.randint(1, 7))) for _ in range(60)] for lang in ("aa", "bb")}
    rows = [(k, " ".join(rng.choice(vocabulary[lang]) for _ in range(rng.randint(1, 15))), lang) for k in range(120) for lang in [rng.choice(["aa", "bb"])]]
    rows += [(500, "zzz", None), (501, "zzz zzz", None), (502, "abcz gfed", None), (503, "e", None)]
    train = [(t, lang) for k, t, lang in rows if lang and zlib.crc32(str(k).encode()) % 3 != 1]
    langs = sorted({x for _, x in train})
    words, grams = {x: {} for x in langs}, {x: {} for x in langs}
    for t, lang in train:
        for w in t.split():
            words[lang][w] = words[lang].get(w, 0) + 1
            own = f" {w} "
            for size in range(1, 6):
                for at in range(len(own) - size + 1):
                    g = own[at : at + size]
                    grams[lang][g] = grams[lang].get(g, 0) + 1
    total = {x: max(1, sum(words[x].values())) for x in langs}

    def logs(table, key):
        kinds = len({k for x in langs for k in table[x]})
        if not any(key in table[x] for x in langs):
            return None
        own = [math.log(table[x].get(key, 0) + 0.5) - math.log(total[x] + 0.5 * kinds) for x in langs]
        return [v - sum(own) / len(own) for v in own]

    def score(text):
        sums = [math.log(sum(lang == x for _, lang in train) / len(train)) for x in langs]
        for w in text.split():
            own = logs(words, w)
            for size in range(5, 0, -1):
                if own is None:
                    hits = [x for at in range(len(w) + 3 - size) if (x := logs(grams, f" {w} "[at : at + size]))]
                    own = [langid.UNSEEN_WEIGHT * sum(c) / len(hits) for c in zip(*hits, strict=True)] if hits else None
            sums = [a + b for a, b in zip(sums, own or [0.0] * len(langs), strict=True)]
        top = max(sums)
        whole = sum(math.exp(x - top) for x in sums)
        return langs[sums.index(top)], 1 / whole

    found = {r.doc_id: r for r in langid.language_id(documents(rows), train_on()).collect()}
    for k, text, _ in rows:
        name, p = score(text)
        assert abs(found[k].score - p) < 1e-3, (text, found[k], name, p)
        assert found[k].lang_pred == name or abs(p - 1 / len(langs)) < 0.2
