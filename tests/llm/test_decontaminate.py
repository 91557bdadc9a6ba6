import hashlib
import random
import re

from quarterdeck.llm.decontaminate import contamination
from tests.llm.helpers import SHAPE, awkward_documents, documents, lowered, prose, with_clashes


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def plain(rows, items):
    windows = {}
    for item, text in items:
        words = words_of(text)
        if item is not None and words:
            size = min(10, len(words))
            for i in range(len(words) - size + 1):
                windows.setdefault(tuple(words[i : i + size]), set()).add(str(item))
    out = []
    for doc, text, *_ in rows:
        words, hit, found = words_of(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if own := windows.get(tuple(words[i : i + size])):
                    found |= own
                    hit.update(range(i, i + size))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((-1 if doc is None else doc, len(words), len(hit), len(found), digest, bool(hit)))
    return sorted(out)


def check(spark, rows, items):
    benchmark = with_clashes(spark.createDataFrame(items, "item_id long, text string"))
    found = contamination(documents(spark, rows), benchmark).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], *r[1:]) for r in found) == plain(rows, items)


def test_matches_brute_force(spark):
    draw = random.Random(6)
    items = [(i, prose(draw, draw.randint(8, 40), 30)) for i in range(25)]
    items += [(30, "Short one!"), (31, "w3"), (32, ""), (33, None), (None, prose(draw, 20)), (9, items[9][1]), (34, "w1 w1 w1 w1")]
    rows = list(awkward_documents())
    for i in range(200, 240):  # spans of items, whole and cut, in other punctuation and case
        text = items[i % 25][1].split()
        low = draw.randrange(5)
        span = ", ".join(text[low : low + draw.randint(5, 25)]).upper()
        rows.append((i, f"{prose(draw, 30, 30)}. {span}; {prose(draw, 20, 30)}", "s0"))
    check(spark, rows, items)


def test_repeated_words(spark):
    """Equal grams everywhere: ties between hashes must not lose a window."""
    items = [(1, "a " * 12), (2, "a b " * 8), (3, "b a " * 5)]
    rows = [(i, "a " * i, "s") for i in range(8, 14)] + [(20, "a b " * 7, "s"), (21, "b " + "a b " * 4 + "c", "s"), (22, "x " + "a " * 30, "s")]
    check(spark, rows, items)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(spark.createDataFrame([], SHAPE), none).count() == 0
    check(spark, awkward_documents(), [(1, "")])
