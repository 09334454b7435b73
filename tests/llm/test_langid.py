import random

import pytest
from pyspark.sql import functions as F

from lexiweave.llm import langid

TEMPLATES = {
    "en": ["The old {} stands beside the river and nobody knows why.", "We have found no other form of {} in these books.", "She wrote that the {} was painted every year before winter."],
    "de": ["Der alte {} steht neben dem Fluss und niemand weiß warum.", "Wir haben keine andere Form von {} in diesen Büchern gefunden.", "Sie schrieb, dass der {} jedes Jahr vor dem Winter gestrichen wurde."],
    "es": ["El viejo {} está junto al río y nadie sabe por qué.", "No hemos encontrado otra forma de {} en estos libros.", "Ella escribió que el {} se pintaba cada año antes del invierno."],
    "ru": ["Старый {} стоит у реки, и никто не знает почему.", "Мы не нашли другой формы {} в этих книгах.", "Она писала, что {} красили каждый год перед зимой."],
    "ja": ["古い{}は川のそばにあるが、その理由は誰も知らない。", "この本には{}の他の形は見つからなかった。"],
}
LANGUAGES = [("de", "Latn"), ("en", "Latn"), ("es", "Latn"), ("ja", "Jpan"), ("ko", "Kore"), ("ru", "Cyrl")]


def word(r):
    return "".join(r.choice(["ka", "lo", "mi", "tre", "shu", "бро", "πλα"]) for _ in range(3))


def sentence(r, lang):
    return r.choice(TEMPLATES[lang]).format(word(r))


def document(r, lang, n=4):
    return ("" if lang == "ja" else " ").join(sentence(r, lang) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    r = random.Random(1)
    labelled = [(document(r, k), k if r.random() > 0.1 else r.choice(list(TEMPLATES))) for k in TEMPLATES for _ in range(60)]
    labelled += [(document(r, "en"), "ko") for _ in range(10)]
    return langid.fit(labelled, LANGUAGES)


def test_held_out_documents(model):
    r = random.Random(2)
    right = 0
    for k in TEMPLATES:
        for change in (str, str.upper, langid.plain):
            for _ in range(20):
                seg = model.segments(change(document(r, k)))
                right += [model.languages[s[2]] for s in seg] == [k]
    assert right / (len(TEMPLATES) * 60) >= 0.97


def test_mixed_documents(model):
    r, right = random.Random(3), 0
    for _ in range(100):
        parts = r.sample(list(TEMPLATES), r.randint(2, 3))
        text = r.choice([" ", "\n\n", " / ", " — "]).join(document(r, k, 2) for k in parts)
        seg = model.segments(text)
        right += [model.languages[s[2]] for s in seg] == parts
        for a, b in zip(seg, seg[1:], strict=False):
            assert a[1] <= b[0]
    assert right >= 95


def test_without_languages_or_texts():
    assert langid.fit([], []).segment(["some text", None]) == [[], []]
    assert [m[2] for m in langid.fit([], [("en", "Latn"), ("ru", "Cyrl")]).segments("Слово и дело.")] == [1]


def test_forward_sums_all_segmentations():
    import numpy as np

    pieces = {"a": 0, "b": 1, "ab": 2, "ba": 3, "\x000": 4}
    prob = np.array([[0.3, 0.1], [0.2, 0.4], [0.1, 0.2], [0.05, 0.1], [0.0, 0.0], [0.0, 0.0]])

    def brute(w, k):
        return 1.0 if not w else sum(prob[pieces[w[:n]], k] * brute(w[n:], k) for n in (1, 2) if w[:n] in pieces and len(w) >= n)

    words = ["abab", "bbaa"]
    got = langid._forward(langid.Pieces(pieces).lattice(words), prob)[0][:, -1]
    assert np.allclose(got, [[brute(w, k) for k in (0, 1)] for w in words])


def test_long_runs_do_not_vanish():
    import numpy as np

    pieces = {"a": 0, "b": 1, "ab": 2, "\x000": 3}
    prob = np.array([[0.03, 0.001], [0.002, 0.004], [0.0001, 0.0002], [1e-6, 1e-6], [0.0, 0.0]])
    grid = langid.Pieces(pieces).lattice(["ab" * 700])
    alpha, raised = langid._forward(grid, prob)
    got = np.log(alpha[0, -1]) + raised[0, -1] * np.log(langid.TINY)
    assert np.allclose(got, 700 * np.log(prob[0] * prob[1] + prob[2]))
    expected = np.zeros_like(prob)
    langid._expect(grid, prob, np.ones((1, 2)), expected)
    share = prob[2] / (prob[0] * prob[1] + prob[2])
    assert np.allclose(expected[2], 700 * share) and np.allclose(expected[0], 700 * (1 - share))


def test_long_vocabulary_pieces_are_used():
    pieces = langid._vocabulary(langid.vocabulary_path(langid.VOCABULARY))
    longest = max((p for p in pieces.number if p[0] != "\0"), key=len)
    assert len(longest) > 10
    assert pieces.lattice([longest])[0, 0, len(longest) - 1] == pieces.number[longest]
    r, words = random.Random(4), [" information", " wiederholtes", "古い形はこれ", "\U0001f642zq\ud83dx"]
    for w in words:
        grid = pieces.lattice([w, "".join(r.sample(w, len(w)))])[0]
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                want = pieces.number.get(w[i:j], pieces.number[f"\0{ord(w[i]) >> 7}"] if j == i + 1 else -1)
                assert (grid[i, j - i - 1] if j - i <= grid.shape[1] else -1) == want


def test_a_sentence_without_spaces_is_a_segment(model):
    r, right = random.Random(8), 0
    for _ in range(40):
        en, ja = document(r, "en", 2), sentence(r, "ja").replace("、", "")
        right += [model.languages[s[2]] for s in model.segments(f"{en} {ja} {document(r, 'en', 2)}")] == ["en", "ja", "en"]
    assert right >= 36


def test_a_quoted_word_is_no_segment(model):
    r = random.Random(9)
    for _ in range(40):
        other = r.choice(["Πλανητάριον", "колокольчик", "古本屋"])
        assert len(model.segments(f"{document(r, 'en', 1)} Compare {other}. {document(r, 'en', 1)}")) == 1


def test_segments_of_rows(spark, model):
    en, de = "We have found no other form of loka in these books.", "Der alte Turm steht neben dem Fluss und niemand weiß warum."
    texts = [None, "", " \n", "123 !!", en, f"<p>{en}</p>", f"{en}\n\n{de}", en * 3000, de + " 🙂 [1]", en]
    df = spark.createDataFrame([(i, t, "xx", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, confidence double")
    rows = langid.segment_languages(df, ["doc_id"], "text", model).orderBy("doc_id", "seg_no").collect()
    assert [(r.doc_id, r.seg_no, r.lang) for r in rows] == [(4, 1, "en"), (5, 1, "en"), (6, 1, "en"), (6, 2, "de"), (7, 1, "en"), (8, 1, "de"), (9, 1, "en")]
    assert all(0 < r.confidence <= 1 for r in rows)
    docs = {r.doc_id: (r.lang, r.n_segments) for r in langid.document_languages(langid.segment_languages(df, ["doc_id"], "text", model), "doc_id").collect()}
    assert docs[6] == ("de", 2) and docs[4] == ("en", 1)
    assert langid.segment_languages(df.limit(0), ["doc_id"], "text", model).count() == 0


def test_labels(spark):
    labels = ["en", " EN ", "en-XA", "en_001", "English", "german", None, "", "-", "und", "xx", "eng-", "deutsch", "de-AT-1901"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, lang string")
    got = [r[0] for r in df.orderBy("i").select(langid.label_codes(F.col("lang"), [("en", "English"), ("de", "German"), ("q", None)])).collect()]
    assert got == ["en", "en", "en", "en", "en", "de", None, None, None, None, None, None, None, "de"]


def test_sample_is_bounded(spark):
    df = spark.createDataFrame([(i, f"some text of no weight {i}", "en" if i % 3 else "de") for i in range(300)] + [(999, "x" * 30_000, "de"), (1000, None, "en")], "doc_id long, text string, lang string")
    got = langid.labelled_sample(df, "doc_id", "text", F.col("lang"), 2, per_language=25)
    assert len(got) == 50 and max(len(t) for t, _ in got) < 100
    few = langid.labelled_sample(df, "doc_id", "text", F.col("lang"), 2, per_language=25, total_chars=300)
    assert 0 < len(few) < 15 and sum(len(t) for t, _ in few) <= 300
    assert got == langid.labelled_sample(df.repartition(5), "doc_id", "text", F.col("lang"), 2, per_language=25)
