import random

from pyspark.sql import functions as F

from quarterdeck.llm.toxicity import fit_chain, label_categories, score_chain, without_category
from tests.llm.helpers import SHAPE, documents, prose, with_clashes

LABELS = "doc_id long, quality int, toxic int"


def corpus(seed, n=900):
    draw = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = prose(draw, draw.randint(5, 300)).split()
        toxic = i % 6 == 0
        for _ in range(draw.randint(1, 3) if toxic else 0):
            words.insert(draw.randrange(len(words)), draw.choice(["vileword", "grimelot" + draw.choice(["a", "os", "ette"]), "Nastyish"]))
        low = i % 7 == 0
        if low:
            words = [w + "qq" for w in words]
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 0 if low else 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(3)
    docs = documents(spark, rows)
    model = fit_chain(docs, with_clashes(spark.createDataFrame(labels[:600], LABELS)), label_categories())
    scored = {r["doc_id"]: r for r in score_chain(docs, model).collect()}
    unseen = [(scored[d], q, t) for d, q, t in labels[600:]]
    right = sum((r["p_toxic"] >= model.threshold("toxic")) == (t == 1) for r, _, t in unseen)
    assert right >= 0.97 * len(unseen)
    right = sum((r["p_low_quality"] >= model.threshold("low_quality")) == (q == 0) for r, q, _ in unseen)
    assert right >= 0.97 * len(unseen)
    kept = without_category(docs, model, "toxic")
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {d for d, r in scored.items() if r["p_toxic"] < model.threshold("toxic")}


def test_awkward_rows_and_labels(spark):
    rows, labels = corpus(4, 300)
    rows += [(900, None, "s"), (901, "", None), (None, "vileword", "s"), (902, " \n", "s"), (0, rows[0][1], "s")]
    labels += [(900, 1, 0), (None, 1, 1), (5, None, 1), (6, 1, None), (7777, 0, 1), labels[1]]
    docs = documents(spark, rows)
    model = fit_chain(docs, spark.createDataFrame(labels, LABELS), label_categories())
    found = score_chain(docs, model).collect()
    assert len(found) == len(rows)
    empty = [r["p_toxic"] for r in found if r["doc_id"] in (900, 901, 902)]
    assert len(set(empty)) == 1 and empty[0] < model.threshold("toxic")
    assert [r["p_toxic"] >= model.threshold("toxic") for r in found if r["doc_id"] is None] == [True]


def test_no_labels_and_one_class(spark):
    rows, labels = corpus(5, 60)
    docs = documents(spark, rows)
    for own in ([], [(d, 1, 0) for d, *_ in labels]):
        model = fit_chain(docs, spark.createDataFrame(own, LABELS), label_categories())
        assert score_chain(docs, model).where(F.col("p_toxic") > 0.01).count() == 0
        assert without_category(docs, model, "toxic").count() == 60
    assert score_chain(spark.createDataFrame([], SHAPE), model).count() == 0
