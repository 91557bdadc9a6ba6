import itertools
import random
import re
import zlib

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from quarterdeck.llm.sharding import byte_shards
from quarterdeck.llm.toxicity import fit_chain, label_categories, score_chain
from quarterdeck.session import cut_lineage
from tests.llm.helpers import lowered, prose
from tests.llm.test_decontaminate import plain as plain_contamination
from tests.llm.test_near_duplicates import plain as plain_components
from tests.llm.test_toxicity import corpus


def tables(spark, folder):
    draw = random.Random(9)
    rows, labels = corpus(21, 500)
    items = [(i, prose(draw, draw.randint(12, 30), 50)) for i in range(12)] + [(50, None), (None, prose(draw, 12))]
    docs = [(d, t, "en", f"src{d % 5}", len(t)) for d, t, _ in rows]
    docs += [(1000 + i, t, "en", "src0", 1) for i, (_, t, *_) in enumerate(docs[:60])]  # exact copies
    for i in range(60):  # near copies
        words = docs[i * 3 + 1][1].split()
        words[len(words) // 2] = "changed"
        docs.append((2000 + i, " ".join(words), "en", "src1", 1))
    docs += [(3000 + i, f"{prose(draw, 40)} {items[i % 12][1].upper()} {prose(draw, 20)}", "en", "src2", 1) for i in range(30)]
    docs += [(4000, None, None, None, None), (4001, "", "en", "src9", 0), (4002, "a b", "en", None, 3), (None, prose(draw, 30), "en", "src3", 1)]
    docs += [(4003, prose(draw, 25), "en", "src4", 1)] * 3
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs, items = tables(spark, folder)
    frame, out = spark.read.parquet(f"{folder}/documents.parquet"), [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns = frame.columns
        stage(spark, frame, folder).write.parquet(f"{folder}/out{i}")
        frame = spark.read.parquet(f"{folder}/out{i}")
        if i < 4:
            assert frame.columns == columns
        out.append([tuple(r) for r in frame.collect()])
    model = fit_chain(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"), label_categories())
    scores = score_chain(spark.read.parquet(f"{folder}/documents.parquet"), model).collect()
    toxic = {r["doc_id"] for r in scores if r["p_toxic"] >= model.threshold("toxic")}
    final = [r.asDict() for r in spark.read.parquet(f"{folder}/out4").collect()]
    whole = [r.asDict() for r in corpus_pipeline.run(spark, folder).collect()]
    return out, items, toxic, final, whole


def ordered(rows):
    return sorted(rows, key=str)


def test_toxicity_drops_toxic_documents_only(outputs):
    out, _, toxic, *_ = outputs
    assert ordered(out[1]) == ordered([r for r in out[0] if r[0] not in toxic])
    planted = {d for d, t, *_ in out[0] if t and re.search("vileword|grimelot|nastyish", lowered(t))}
    assert len(planted & toxic) >= 0.95 * len(planted) and len(toxic - planted) <= 3


def test_one_document_of_each_group_stays(outputs):
    out = outputs[0]
    component = plain_components(out[1], 80)
    kept = [r for r in out[1] if r[0] is None or component[r[0]] == r[0]]
    assert ordered(out[2]) == ordered(set(kept))
    assert not {d for d, *_ in out[2] if d and 1000 <= d < 1060}


def test_contaminated_documents_go(outputs):
    out, items, *_ = outputs
    bad = {r[0] for r in plain_contamination(out[2], items) if r[5]}
    assert ordered(out[3]) == ordered([r for r in out[2] if r[0] not in bad])
    assert len([d for d in bad if 3000 <= d < 3030]) >= 1


def test_mix_repeats_rows_near_the_targets(outputs):
    out = outputs[0]
    before, after = out[3], out[4]
    assert set(after) <= set(before)
    assert max(len(list(g)) for _, g in itertools.groupby(ordered(after))) <= 3
    words = lambda rows: sum(len((r[1] or "").split()) for r in rows)
    assert abs(words(after) - words(before)) <= 0.1 * words(before) + 600


def test_shards(outputs):
    out, *_, final, whole = outputs
    assert len(final) == len(out[4])
    assert ordered((r["doc_id"], r["size"], r["text_crc32"]) for r in final) == ordered(
        (d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in out[4]
    )
    for shard in {r["shard"] for r in final}:
        slots = sorted(r["slot"] for r in final if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    key = lambda r: str((r["doc_id"], r["size"], r["shard"], r["slot"]))
    assert sorted(map(key, whole)) == sorted(map(key, final))


def test_stages_take_any_column_names_and_empty_tables(spark, tmp_path):
    draw = random.Random(4)
    items = [(i, prose(draw, 20, 60)) for i in range(4)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, prose(draw, 40), "en", f"s{i % 3}", 1) for i in range(20)]
    rows += [(20, rows[0][1], "en", "s0", 1), (21, items[1][1] + " tail", "en", "s1", 1), (None, None, None, None, None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = "_place _place_ _copy _source _times _cut _own _doc _hash _tie _range _row shard_ slot_ component node digest bands".split()
    named = plain.select("*", *[F.lit(i).alias(c) for i, c in enumerate(extra)])
    for frame in (named, named.limit(0)):
        docs = frame
        for _, stage in corpus_pipeline.STAGES[1:4]:
            docs = cut_lineage(stage(spark, docs, str(tmp_path)))
            assert docs.columns == named.columns
        assert docs.where(" OR ".join(f"{c} <> {i}" for i, c in enumerate(extra))).isEmpty()
        assert not docs.where("doc_id IN (20, 21)").count()
        final = dict(corpus_pipeline.STAGES)["sharding"](spark, docs, str(tmp_path))
        assert final.count() == docs.count()
    kept = byte_shards(named.where("doc_id < 5").withColumn("size", F.lit(10).cast("long")), 3)
    assert kept.columns[: len(named.columns)] == named.columns and kept.where("_tie = 9").count() == 5
