import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarterdeck.llm.token_files import displaced, document_keys, encoder, locate, probed, token_digests, write_token_files
from quarterdeck.session import scratch_path
from tests.llm.helpers import SHAPE, awkward_documents, documents

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)


def test_reads_back_what_the_library_gives(spark):
    rows = awkward_documents()
    found = token_digests(documents(spark, rows), PATH, 1).collect()
    assert len(found) == len(rows)
    ids = [(-1 if d is None else d, WHOLE.encode(t or "", add_special_tokens=False).ids + [1]) for d, t, _ in rows]
    whole = [(d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in ids]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == sorted(whole)
    ordered = sorted(found, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == [sum(o["n_tokens"] for o in ordered[:i]) for i in range(len(ordered))]
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert keys == sorted(keys)


def test_unknown_keys_are_not_found(spark):
    path = scratch_path(spark, "tokens")
    write_token_files(documents(spark, [(i, f"text {i}", "s") for i in range(300)]), path, PATH, 1, segment_ids=100, bucket_keys=64)
    wanted = spark.createDataFrame([(i, 0) for i in range(0, 3000, 10)], "doc_id long, occurrence long")
    found = {r["doc_id"] for r in locate(spark, path, wanted).collect()}
    assert found == set(range(0, 300, 10))
    assert spark.read.parquet(f"{path}/payload").count() > 8


def test_empty_table(spark):
    assert token_digests(spark.createDataFrame([], SHAPE), PATH, 1).count() == 0
    assert document_keys(spark.createDataFrame([], SHAPE)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aZé'.,<|>x 1\n\t ́日’st"), st.characters(blacklist_categories=["Cs"])), max_size=40), max_size=5))
def test_chunks_give_the_ids_of_whole_texts(texts):
    texts = texts + ["it's <|endoftext|> A<|ENDOFTEXT|>, don't. I'LL"]
    got = [x.tolist() for x in encoder(PATH).encode(pa.array(texts))]
    assert got == [WHOLE.encode(t, add_special_tokens=False).ids for t in texts]


def test_minimal_perfect_hash():
    draw = np.random.default_rng(0)
    for n in (1, 2, 7, 5000):
        first, second = (draw.integers(0, 2**63, n).astype(np.uint64) for _ in range(2))
        shifts, slots = displaced(first, second)
        assert sorted(slots.tolist()) == list(range(n))
        assert (probed(first, second, shifts, n) == slots).all()
