"""Texts without letters have no language; moves between languages are learned."""

import pytest

from lodestone.llm import langid


@pytest.fixture(scope="module")
def chain():
    en, es = "the cat and the dog went away from here today with them all again", "el gato y los perros salen mañana de aquí con todos ellos otra vez"
    return langid.fit([(en, "en"), (es, "es")] * 4)


def test_numerals_without_letters(chain):
    texts = ["½ ²", "Ⅷ", "①②", "½ ² Ⅷ ①②", "१२", "_ 12 !", "²a", "the ½ cat"]
    langs, scores = chain.predict(texts)
    for text, lang, score in zip(texts, langs, scores):
        assert (lang == "und") == (not any(map(str.isalpha, text))), text
        assert (score == 0) == (lang == "und")


def test_moves_between_languages_are_seen(chain):
    t = chain.transitions
    assert (t[0, 0] > t[0, 1]) and (t[1, 1] > t[1, 0])
    got = [max(m, key=m.get) for _, m in chain.word_marginals("the cat and the dog went los perros salen mañana de aquí")]
    assert got[:5] == ["en"] * 5 and got[-5:] == ["es"] * 5


def test_sample_is_bounded(spark):
    rows = [(i, f"word{chr(97 + i % 26)} text", f"l{i % 50:02d}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.labelled_sample(df, "doc_id", "text", "lang", 300, 64, 100)
    assert len(got) == 100 and len({x for _, x in got}) == 50
