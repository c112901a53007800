"""Languages with few or no toxic labels still tell toxic documents."""

import numpy as np

from wayfold.llm import toxicity


def test_language_with_clean_labels_only(spark, docs):
    rows = [(k, f"good day number {k} to all of you" + (" vile" if k % 3 == 0 else ""), "en") for k in range(240)]
    rows += [(k, f"bonjour le monde entier et merci {k}", "fr") for k in range(240, 270)]
    rows += [(1000, "bonjour le monde entier vile", "fr"), (1001, "bonjour le monde entier", "fr")]
    labels = spark.createDataFrame([(k, 1, int(k < 240 and k % 3 == 0)) for k in range(270)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r.predicted for r in toxicity.classify(docs(rows), labels).collect()}
    assert found[1000] == 1 and found[1001] == 0
    assert all(found[k] == 0 for k in range(240, 270))


def test_few_toxic_rows_take_the_shared_threshold():
    logits = np.array([5.0, 4, 4, 4, 4, 4, 4, -1, -2, -3, 9, 1])
    y = np.array([1.0, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 1])
    spoken = np.array([0] * 10 + [1] * 2)
    own, other, none = toxicity._thresholds(logits, y, spoken, 3)
    assert own == 1.5 and other == none == 0.0
