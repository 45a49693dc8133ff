import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tastegrid.llm import language, lattice, toxicity


def remainder(i, n):
    return zlib.crc32(str(i).encode()) % n


# Subword lattice -----------------------------------------------------------------------------------------------------


def brute_log(word, logs, longest):
    word = b" " + word
    ways = [0.0] + [-math.inf] * len(word)
    for i in range(1, len(word) + 1):
        found = [ways[j] + logs[word[j:i]] for j in range(max(0, i - longest), i) if word[j:i] in logs]
        high = max(found)
        ways[i] = high + math.log(sum(math.exp(x - high) for x in found))
    return ways[-1]


@pytest.fixture(scope="module")
def pieces():
    return lattice.read_pieces()


def test_forward_recursion_sums_all_segmentations(pieces):
    logs = dict(zip(pieces.names, pieces.logs))
    words = [b"hello", b"a", b"unthinkable", "été".encode(), b"x" * 90, b"\xff\x00", b"ingthe"]
    got = lattice.Lattice(words, pieces).forward()[1]
    assert np.allclose(got, [brute_log(w, logs, pieces.longest) for w in words])
    long = [b"abcdefghij" * 40, b"hello"]
    assert np.allclose(lattice.word_logs(long, pieces), [brute_log(w, logs, pieces.longest) for w in long])
    assert np.allclose(lattice.expected_uses(long, np.ones(2), pieces), lattice.Lattice(long, pieces).expected(np.ones(2)))
    assert abs(np.exp(pieces.logs).sum() + math.exp(pieces.end) - 1) < 1e-9


def test_expected_uses_are_the_slope_of_the_log_probability(pieces):
    words, counts = [b"hello", b"there", b"xyz"], np.array([1.0, 2.0, 5.0])
    used = lattice.Lattice(words, pieces).expected(counts)
    for k in np.argsort(-used)[:5]:
        logs = pieces.logs.copy()
        logs[k] += 1e-5
        moved = lattice.Pieces(pieces.names, logs, pieces.end)
        slope = (lattice.Lattice(words, moved).forward()[1] - lattice.Lattice(words, pieces).forward()[1]) @ counts / 1e-5
        assert abs(slope - used[k]) < 1e-3
    # Each use covers its letters: lengths times uses add up to all letters.
    assert abs(sum(len(n) * u for n, u in zip(pieces.names, used)) - sum((len(w) + 1) * c for w, c in zip(words, counts))) < 1e-6


def test_no_piece_is_too_long(pieces):
    model = {len(n) for n in pieces.names}
    assert max(model) > 16
    whole = [n[1:] for n in pieces.names if len(n) > 16 and n[:1] == b" "]
    logs = dict(zip(pieces.names, pieces.logs))
    got = lattice.Lattice(whole, pieces).forward()[1]
    assert np.allclose(got, [brute_log(w, logs, pieces.longest) for w in whole])
    assert all(g > brute_log(w, logs, 16) for g, w in zip(got, whole))


def test_scores_of_documents(docs):
    rng = random.Random(2)
    texts = {i: " ".join(rng.choice(["The", "the", "cat", "sat", f"odd{i}"]) for _ in range(rng.randrange(30))) for i in range(60)}
    texts[60] = None
    rows = {r.doc_id: r for r in lattice.score(docs(*texts.items()), lattice.LatticeConfig(block_bytes=600)).collect()}
    tokens = {i: [*(t or "").lower().split(), "</end>"] for i, t in texts.items()}
    counts = Counter(w for i, ws in tokens.items() if remainder(i, 7) != 2 for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    assert set(rows) == set(texts)
    for i, ws in tokens.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (remainder(i, 7) == 2, len(ws), total)
        assert r.n_known == sum(w in counts for w in ws)
        assert abs(r.base_score - sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in ws)) < 1e-6
    # The model is one of independent words: texts of the same words score the same, and words add up.
    assert abs(rows[60].score - min(r.score / r.n_tokens for r in rows.values() if r.n_tokens == 1)) < 1e-9
    assert all(r.score < 0 for r in rows.values())


def test_lattice_odd_rows_and_none(oddities, docs):
    assert lattice.score(oddities).count() == oddities.count()
    assert lattice.score(docs().limit(0)).count() == 0


# Language ------------------------------------------------------------------------------------------------------------


def test_held_out_accuracy_of_languages(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in language.language_digest(table).collect()}
    truth = [(r.doc_id, r.lang) for r in table.collect() if r.lang and (r.text or "").strip()]
    held = [(got[i].lang_pred, lang) for i, lang in truth if got[i].held_out]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.held_out == (remainder(r.doc_id, 4) == 2) for r in got.values())


def test_languages_of_odd_rows_and_none(oddities, docs):
    model = language.fit(oddities)
    rows = language.identify(oddities, model).collect()
    assert len(rows) == oddities.count() and {r.lang_pred for r in rows if not (r.text or "").strip()} == {"und"}
    nothing = language.fit(docs().limit(0))
    assert [r.lang_pred for r in language.identify(docs((1, "words"), (2, "12 !?")), nothing).collect()] == ["und", "und"]
    assert [r.lang_pred for r in language.identify(docs((1, "12 !?")), model).collect()] == ["und"]
    assert language.language_digest(docs().limit(0)).count() == 0


def test_families_come_first(docs):
    words = {"en": "the of and house water", "de": "der und das haus wasser", "fr": "le et les maison eau", "xx": "qzq zqq qqz zzq qzz"}
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(words[lang].split()) for _ in range(30)), lang) for i, lang in enumerate(list(words) * 40)]
    table = docs(*rows)
    model = language.fit(table)
    assert model.families == {"germanic": ["de", "en"], "romance": ["fr"], "xx": ["xx"]} and set(model.pairs) == {("de", "en")}
    assert all(r.lang_pred == r.lang for r in language.identify(table, model).collect())


# Toxicity ------------------------------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_edit_distances():
    terms = ["moron", "worthless", "scum", "idiot", "moon"]
    automaton = toxicity.LexiconAutomaton({t: toxicity.edits_allowed(t) for t in terms}, {"achl"})
    rng = random.Random(6)
    words = [*terms, "achl", "achlich", "ach", ""]
    for t in terms * 300:
        letters = list(t)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(letters) + 1)
            letters[k : k + rng.randrange(2)] = [rng.choice("abmoronstwl")] if rng.random() < 0.6 else []
        words.append("".join(letters))
    for word in words:
        best = min(((edits(word, t), t) for t in terms if edits(word, t) <= toxicity.edits_allowed(t)), default=None)
        stem = word.startswith("achl")
        want = "word" if best and best[0] == 0 else "stem" if stem else "misspelled" if best else None
        got = automaton.match(word)
        assert (got and got[0]) == want, word
        if want in ("word", "misspelled"):
            assert edits(word, got[1]) == best[0]


def test_held_out_toxicity(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = {r.doc_id: r for r in toxicity.toxicity_digest(table, labels).collect()}
    truth = [(got[r.doc_id], r.toxic) for r in labels.collect() if r.toxic is not None and r.doc_id in got]
    held = [(r.predicted, t) for r, t in truth if r.held_out]
    assert np.mean([p for p, t in held if t]) > 0.85 and np.mean([p for p, t in held if not t]) < 0.01
    assert all(r.held_out == (remainder(r.doc_id, 3) == 1) and r.predicted == (r.score >= 0.7) for r in got.values())


def test_rare_toxic_terms_are_learned(spark, docs):
    rng = random.Random(3)
    plain = [f"{a}{b}" for a in ("bal", "tor", "min", "sul", "ker") for b in ("do", "ra", "ti", "nu", "pe", "lo")]
    ids = iter(i for i in range(100_000) if remainder(i, 3) != 1)
    rows, labels = [], []
    for n, toxic, term in ((600, 1, "grobian"), (4, 1, "zwrglbt"), (4_000, 0, "")):
        for _ in range(n):
            i = next(ids)
            rows.append((i, " ".join([*rng.choices(plain, k=6), term])))
            labels.append((i, toxic))
    learned = toxicity.fit(docs(*rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {"grobian", "zwrglbt"} <= set(learned.terms)


def test_other_forms_of_a_chosen_word_stay():
    texts = [[("moron", 1), ("mor*", 1)]] * 50 + [[("moronic", 1), ("moron*", 1), ("mor*", 1)]] * 10
    texts += [[("idiotic", 1), ("idiot*", 1)]] * 20 + [[("idiot", 1)]] * 6 + [[("achlich*", 1), ("achlicher", 1)]] * 9 + [[("achlich*", 1)]] * 9
    counts = Counter()
    for text in texts:
        counts.update(dict(text))
    counts = {t: (n, 60 if t == "mor*" else 0) for t, n in counts.items()}
    chosen = toxicity._cover(texts, counts, (len(texts), 1000), toxicity.ToxicityConfig())
    # Every form is chosen itself or stands under a chosen stem; what the words leave of mor* is not enough.
    assert {"moron", "moronic", "idiotic", "idiot", "achlich*"} == set(chosen)


def test_short_terms_have_misspellings(docs):
    weights = {"base": toxicity.BASE, **toxicity.KINDS, "length": 0.0}
    matcher = toxicity.Matcher(toxicity.ToxicityModel({"scum": 6.0, "ass": 6.0}, {"scam"}, weights), 8)
    assert [h[0] for h in matcher.hits("scumm scvm scum scam sccvm as")] == ["misspelled", "misspelled", "word"]


@pytest.fixture
def model():
    weights = {"base": toxicity.BASE, **toxicity.KINDS, "length": 0.0}
    return toxicity.ToxicityModel({"idiot": 6.0, "worthless": 6.0}, {"idiom"}, weights)


def test_misspelling_and_quotation(docs, model):
    table = docs(
        (1, "you are an idiot today"),
        (2, "you are an idioot and W0RTHLESS, worthles"),
        (3, 'he was called "an idiot" by someone'),
        (4, "a nice idiom for a nice day"),
        (5, None),
        (6, "you wor-thless thing"),
    )
    rows = {r.doc_id: r for r in toxicity.score(table, model).collect()}
    assert [rows[k].predicted for k in range(1, 7)] == [1, 1, 0, 0, 0, 1]
    assert rows[4].score == rows[5].score < rows[3].score < rows[1].score


def test_toxicity_of_odd_rows_and_none(spark, oddities, docs, model):
    rows = toxicity.score(oddities, model).collect()
    assert len(rows) == oddities.count() and len({r.score for r in rows}) == 1
    labels = spark.createDataFrame([(1, None), (1, 1), (1, 0), (None, 1), (77, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.toxicity_digest(oddities, labels).count() == oddities.count()
    assert toxicity.toxicity_digest(docs().limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("id_", [None, 4, 9])
def test_languages_are_learned_whatever_the_ids(docs, id_):
    # With one id for all, or none, every row is on the same side of any hash of the id.
    rng = random.Random(4)
    english, german = "the and with that from this have".split(), "und der nicht mit dass eine für".split()
    texts = [(" ".join(rng.choices(words, k=12)) + f" {k}", lang) for k in range(150) for words, lang in ((english, "en"), (german, "de"))]
    copies = [("the and the and the and the", "en")] * 300
    df = docs(*[(id_, text, lang, "a") for text, lang in texts + copies])
    model = language.fit(df, language.LanguageConfig(fit_rows=60, steps=200))
    got = language.identify(docs((1, "that with the from have and"), (2, "nicht dass der für eine und")), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["en", "de"]


def test_samples_have_a_hard_bound(spark, docs):
    # One labelled id with most of the rows, copies of one text among them.
    rows = [(7, f"text {k} of one document") for k in range(400)] + [(7, "copy")] * 400 + [(k, f"other {k}") for k in range(8, 90)]
    df = docs(*rows)
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(90)] + [(7, 0, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    few = toxicity.training_rows(df, labels, toxicity.ToxicityConfig(fit_rows=50)).collect()
    assert len(few) == 50 and len({r.text for r in few}) == 50
    every = toxicity.training_rows(df, labels, toxicity.ToxicityConfig()).collect()
    assert sum(r.text == "copy" for r in every) == 1 and len(every) == len({r.text for r in every})
