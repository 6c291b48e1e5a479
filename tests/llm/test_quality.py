import re
from collections import Counter

import numpy as np

from sparkloom.llm import perplexity as p


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    hit = {i for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for i in range(k, k + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_counts(documents, prose):
    rows = [(k, prose(prose.rng.randint(0, 80))) for k in range(40)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "a b c d e f g h " * 4), (104, "x\nx\n\n x\nx"), (105, "#*$%&|<> é\u00a0ü"), (106, "w " * 9), (107, "a\x0bb\x0cc\rd"), (108, prose(12) + "\n" + prose(40)), (None, "null id")]
    found = {r.doc_id: r for r in p.quality(documents(rows)).collect()}
    for k, text in rows:
        own = base(text)
        r = found[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == own
        assert r.base_failed == (own[0] < 20 or 100 * own[4] > 30 * own[0])
        assert not (r.base_failed and r.kept)


def test_odd_texts_of_a_language_go_and_the_others_stay(documents, prose):
    rows = [(k, prose(120)) for k in range(150)] + [(1000, " ".join("".join(chr(prose.rng.randint(0x400, 0x4FF)) for _ in range(6)) for _ in range(120))), (1001, prose(120), None), (1002, " ".join(["aa"] * 9 + prose(111).split()), "xx")]
    kept = {r.doc_id: r.kept for r in p.quality(documents(rows)).collect()}
    assert not kept[1000] and kept[1001] and kept[1002] and all(kept[k] for k in range(150))


def test_empty_table(documents):
    assert p.quality(documents([])).count() == 0


def test_the_model_is_kneser_ney(documents, prose):
    """Against the textbook formula, computed in Python from the same running texts."""
    docs = documents([(k, "\n".join([prose(30), prose(3)])) for k in range(20)] + [(50, "x"), (51, "")])
    counts = {p.ORDER: Counter()}
    short = Counter()
    for r in docs.collect():
        own = p.START + " ".join(r.text.split()) + p.END
        for k in range(len(own) - p.ORDER + 1):
            counts[p.ORDER][own[k : k + p.ORDER]] += 1
        for k in range(2, min(p.ORDER, len(own) + 1)):
            short[own[:k]] += 1
    for k in range(p.ORDER - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1]) + Counter({g: n for g, n in short.items() if len(g) == k and g.startswith(p.START)})
    d = {}
    for k, own in counts.items():
        c = Counter(own.values())
        y = c[1] / max(c[1] + 2 * c[2], 1)
        d[k] = [0] + [min(max(m - (m + 1) * y * c[m + 1] / max(c[m], 1), 0.05), m - 0.05) for m in (1, 2, 3)]

    def probability(context, char):
        if len(context) >= p.ORDER:
            context = context[-(p.ORDER - 1) :]
        k = len(context) + 1
        lower = 1 / 1024 if k == 1 else probability(context[1:], char)
        row = {g: n for g, n in counts[k].items() if g[:-1] == context}
        if not row:
            return lower
        total = sum(row.values())
        alpha = {g: (n - d[k][min(n, 3)]) / total for g, n in row.items()}
        return alpha.get(context + char, 0) + max(1 - sum(alpha.values()), 1e-4) * lower

    model = p.train(docs.selectExpr("'en' AS _lang", "text AS _text"))
    tried = [prose(12), "zzz " + prose(2), "a", "", prose(12)]
    for again in range(2):  # the second time from the table of scored n-grams
        logs, sizes = model.scores(["en"] * len(tried), [p.running(p.words_of(x)) for x in tried])
        for text, found, size in zip(tried, logs, sizes, strict=True):
            own = p.START + text + p.END
            assert size == len(text) + 1
            assert abs(found - sum(np.log(probability(own[max(0, k - p.ORDER + 1) : k], own[k])) for k in range(1, len(own)))) < 1e-3, (again, text)


def test_counts_of_grams_are_whole_where_slots_are_taken(documents, prose, monkeypatch):
    monkeypatch.setattr(p, "SLOTS", 64)
    docs = documents([(k, prose(40), "en" if k % 3 else "de") for k in range(30)])
    want = Counter()
    for r in docs.collect():
        own = p.START + " ".join(r.text.split()) + p.END
        want.update((r.lang, own[max(0, e - p.ORDER) : e]) for e in range(2, len(own) + 1))
    got = {(r.lang, r.gram): r.n for r in p.gram_counts(docs.selectExpr("lang AS _lang", "text AS _text")).collect()}
    assert got == want


def test_the_order_of_words_counts(documents, prose):
    """Sentences of a fixed grammar: the same words in another order score worse."""
    rng = prose.rng
    parts = [["the", "a"], ["old", "red", "big"], ["cat", "dog", "man"], ["sees", "eats"], ["one", "two"], ["figs", "nuts"]]
    text = lambda: " ".join(rng.choice(x) for _ in range(12) for x in parts)
    rows = [(k, text()) for k in range(200)]
    own = text().split()
    shuffled = own[:]
    rng.shuffle(shuffled)
    found = {r.doc_id: r for r in p.quality(documents([*rows, (900, " ".join(own)), (901, " ".join(shuffled))])).collect()}
    assert found[901].log_perplexity > found[900].log_perplexity + 0.1
    assert found[900].kept and not found[901].kept


def test_long_texts_ties_and_repeated_rows(documents, prose):
    long, same = prose(120_000), prose(100)
    found = p.quality(documents([*[(k, prose(100)) for k in range(40)], (100, long), (101, same), (102, same), (102, same), (103, "é" * 400_000)])).collect()
    assert len(found) == 45
    one = {r.doc_id: r for r in found}
    assert one[100].n_words == 120_000 and one[100].word_chars == len(long) - 119_999 and one[103].word_chars == 400_000
    assert len({(r.kept, r.log_perplexity) for r in found if r.doc_id in (101, 102)}) == 1


def test_a_small_language_keeps_its_words(documents, prose):
    """Beside a far larger language the small one is scored by its own n-grams."""
    rows = [(k, prose(200)) for k in range(300)] + [(1000 + k, " ".join(prose.rng.choice(["qux", "zyx", "wvu"]) for _ in range(30)), "xx") for k in range(3)]
    found = {r.doc_id: r for r in p.quality(documents(rows)).collect()}
    assert all(found[1000 + k].kept and found[1000 + k].log_perplexity < 1 for k in range(3))


def test_the_model_keeps_every_counted_gram(documents, prose):
    """More n-grams than the 524,288 that the model once kept: none may be missing."""
    alphabet = "abcdefghijklmnopqrstuvwxyz0123456789"
    text = lambda: " ".join("".join(prose.rng.choices(alphabet, k=8)) for _ in range(900))
    docs = documents([(k, text()) for k in range(120)]).selectExpr("'en' AS _lang", "text AS _text")
    texts = [p.running(p.words_of(r["_text"])) for r in docs.collect()]
    whole = {x[k : k + p.ORDER] for x in texts for k in range(len(x) - p.ORDER + 1)}
    model = p.train(docs)
    assert len(whole) > 1 << 19 and len(model.a) > len(whole)
    assert not set(p.sorted_arrays(docs.sparkSession.createDataFrame([("en", g) for g in sorted(whole)[:1000]], "lang string, gram string").selectExpr("*", "1.0 AS alpha"), "alpha")[0].tolist()) - set(model.a.tolist())
