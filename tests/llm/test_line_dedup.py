import itertools
import random

from quarterdeck.llm.line_dedup import fuzzy_lines, without_lines
from tests.llm.helpers import SHAPE, awkward_documents, components, documents, lowered, prose


def shingles(line, size=7):
    return {line[i : i + size] for i in range(len(line) - size + 1)} or {line}


def plain(rows, percent=80):
    """doc_id and place of the first line of each line's component."""
    lines = [(d, i, lowered(x)) for d, t, _ in rows for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\v\f\r")]
    names = {}
    for d, i, x in sorted(lines, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        names.setdefault(x, len(names))
    sets = {n: shingles(x) for x, n in names.items()}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root, first = components(sets, links), {}
    for d, i, x in sorted(lines, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        first.setdefault(root[names[x]], (d, i))
    return sorted(((d, i, *first[root[names[x]]]) for d, i, x in lines), key=str)


def fuzzy_rows(seed):
    draw = random.Random(seed)
    rows, base = [], [prose(draw, draw.randint(10, 40)) for _ in range(30)]
    for i in range(120):
        own = []
        for _ in range(draw.randint(0, 6)):
            line = draw.choice(base) if draw.random() < 0.6 else prose(draw, draw.randint(1, 30))
            if draw.random() < 0.5:
                at = draw.randrange(len(line))
                line = line[:at] + draw.choice("éxyz日") + line[at + 1 :]
            own.append(line.upper() if draw.random() < 0.1 else line)
        rows.append((i, "\n".join(own) + draw.choice(["", "\n", "\n\n"]), "s"))
    return rows


def test_matches_brute_force(spark):
    for rows in (fuzzy_rows(1), [r for r in awkward_documents() if r[0] != 106]):
        found = fuzzy_lines(documents(spark, rows)).collect()
        got = sorted(((r["doc_id"], r["line_no"], r["component_doc"], r["component_line"]) for r in found), key=str)
        assert got == plain(rows)
        assert all(r["kept"] == ((r["doc_id"], r["line_no"]) == (r["component_doc"], r["component_line"])) for r in found if r["doc_id"] is not None)


def test_rest_of_texts(spark):
    rows = [(1, "one line of text here\n\nanother line of text", "s"), (2, "ONE line of text here\nunique words in this one", "s"), (3, None, "s"), (4, "", "s")]
    docs = documents(spark, rows)
    rest = {r["doc_id"]: r["text"] for r in without_lines(docs, fuzzy_lines(docs)).collect()}
    assert rest == {1: rows[0][1], 2: "unique words in this one", 3: None, 4: ""}


def test_repeated_rows_and_no_rows(spark):
    rows = [(106, "é ñ 日本 語 ß", "s")] * 3 + [(None, "é ñ 日本 語 ß", "s")]
    assert sorted(r["kept"] for r in fuzzy_lines(documents(spark, rows)).collect()) == [False, False, False, True]
    assert fuzzy_lines(spark.createDataFrame([], SHAPE)).count() == 0


def test_a_hidden_pair_among_mid_similar_lines(spark):
    """Two lines that are alike share their buckets with hundreds of lines that are like neither."""
    draw = random.Random(9)
    template = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(200))

    def changed(doc, places):
        line = list(template)
        for at in places:
            line[at] = chr(0x4E00 + doc)
        return doc, "".join(line), "s"

    places = draw.sample(list(itertools.combinations(range(10, 130, 8), 3)), 400)
    rows = [changed(i, own) for i, own in enumerate(places)] + [changed(900, [150]), changed(901, [180])]
    found = fuzzy_lines(documents(spark, rows)).collect()
    got = sorted(((r["doc_id"], r["line_no"], r["component_doc"], r["component_line"]) for r in found), key=str)
    assert got == plain(rows)
    assert [r for r in got if r[:2] != r[2:]] == [(901, 0, 900, 0)]
