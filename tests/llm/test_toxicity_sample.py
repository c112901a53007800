"""No labelled row within the bound is kept from the fit."""

import numpy as np

from wayfold.llm import toxicity


def test_every_labelled_row_is_fitted_on():
    assert toxicity.SAMPLE_PER_LABEL == 2000 and toxicity.EPOCHS == 12
    word = lambda k: [k, *[-1] * len(toxicity.STEMS)]
    # bucket 7 is only in every fourth text
    texts = [np.array([word(3), word(7 if k % 4 == 3 else 5)], np.int32) for k in range(400)]
    model = toxicity.train(texts, np.array([k % 4 == 3 for k in range(400)], np.int32), ["en"] * 400)
    assert model.rows[7] > 0 and model.embedding[model.rows[7], 0] > 0


def test_a_text_beyond_the_bound_is_passed_over_alone(spark, monkeypatch):
    assert toxicity.fitting([(1, 5), (2, 100), (3, 4), (4, 2), (5, 1)], 10) == [1, 3, 5]
    monkeypatch.setattr(toxicity, "SAMPLE_WORDS", 2000)
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, langs: seen.append(sorted(len(t) for t in texts)))
    rows = [(i, "some words here and there to learn " + ("foul" if i % 2 else "fair"), "en") for i in range(60)]
    docs = lambda some: spark.createDataFrame(some, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(61)], "doc_id long, toxic int")
    toxicity.fit(docs(rows), labels)
    toxicity.fit(docs([*rows, (60, "long " * 3000, "en")]), labels)
    assert seen[0] == seen[1] and len(seen[0]) == 60
