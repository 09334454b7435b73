import math

import pytest

from lexiweave.plans.neighbours import knn_rerank

GOOD = "bright shining steady flame"


@pytest.fixture(scope="module")
def searched(spark, tmp_path_factory):
    """Two queries, each with words ever farther from it; nearly all have no definition, which costs them 0.08."""
    told = {
        "en": {1: ("alphas", GOOD), 2: ("omega", GOOD), 3: ("plain", GOOD), 300: ("liftaa", GOOD), 490: ("liftbb", GOOD), 560: ("liftcc", GOOD)},
        "de": {1: ("alphas", GOOD), 2: ("omega", GOOD), 150: ("liftaa", GOOD), 250: ("liftbb", GOOD)},
    }
    words = []  # (id, language, word, definition, place)
    for first, g, n in ((100_000, "en", 600), (200_000, "de", 300)):
        words.append((first, g, "alpha", GOOD, 0))
        words += [(first + i, g, *told[g].get(i, (f"{i:04}x", "")), i) for i in range(1, n + 1)]
    raw = {100_000: '{"antonyms":[{"word":" Omega"}]}'}
    tables = {
        "languages": ([(1, "en"), (2, "de")], "id long, code string"),
        "lexemes": ([(i, 1 if g == "en" else 2, w, w) for i, g, w, _, _ in words], "id long, language_id long, lemma string, normalized_lemma string"),
        "senses": ([(i, i, t, "visible", raw.get(i)) for i, _, _, t, _ in words], "id long, lexeme_id long, definition string, visibility_status string, raw_sense string"),
        "embeddings": ([(i, [math.cos(p * 0.0005), math.sin(p * 0.0005)]) for i, _, _, _, p in words], "vec_id long, embedding array<float>"),
        "sense_options": ([], "sense_id long, selection_count long"),
    }
    out = tmp_path_factory.mktemp("searched")
    for name, (rows, shape) in tables.items():
        spark.createDataFrame(rows, shape).write.parquet(f"{out}/{name}.parquet")
    found = {100_000: [], 200_000: []}
    for r in knn_rerank(spark, str(out)).orderBy("place").collect():
        found.get(r.query_id, []).append(r.word)
    return found


def test_rerank_fetches_by_language(searched):
    assert {"liftaa", "liftbb"} <= set(searched[100_000]) and "liftcc" not in searched[100_000]
    assert "liftaa" in searched[200_000] and "liftbb" not in searched[200_000]


def test_rerank_drops_forms_and_antonyms(searched):
    assert searched[100_000][:3] == ["plain", "liftaa", "liftbb"]
    assert searched[200_000][:2] == ["omega", "liftaa"]
    assert "alphas" not in searched[100_000] + searched[200_000]
