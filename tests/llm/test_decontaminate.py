"""Windows of benchmark items in documents, against brute force."""

from __future__ import annotations

import hashlib
import re

import pytest

from skytally.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    wins = []
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        wins += [(item, w[i : i + n]) for i in range(max(len(w) - 12, 1))] if w else []
    out = {}
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, win in wins:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found.add(item)
        ids = ",".join(sorted(map(str, found)))
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


ITEM = "The quick brown fox jumps over the lazy dog while seventeen green parrots watch from the old tree"
ITEMS = [(1, ITEM), (2, ITEM), (10, "short item here"), (3, None), (4, "!!!"), (5, "a a a a a a a a a a a a a a a"), (6, "one")]
FILL = " ".join(f"w{i}" for i in range(400))
DOCS = [
    (0, None), (1, ""), (2, ITEM), (3, FILL + " " + ITEM.upper() + " end"), (4, "SHORT, item-here!"), (5, "a " * 40), (6, " ".join(ITEM.split()[:12])), (7, " ".join(ITEM.split()[3:17])),
    (8, FILL), (9, "short item"), (10, FILL + " short item here " + FILL), (11, "one"), (12, (FILL + " ") * 50 + ITEM), (13, ITEM + " " + ITEM),
]


@pytest.mark.parametrize("options", [{}, {"block_shingles": 5}])
def test_equals_brute_force(spark, options):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in DOCS], "doc_id long, text string, window string, n int")
    items = spark.createDataFrame([(i, t, "y") for i, t in ITEMS], "item_id long, text string, token string")
    got = decontaminate.contamination(spark, docs, items, **options).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in got} == brute(DOCS, ITEMS)
    assert len(got) == len(DOCS)


def test_stage_drops_only_contaminated_rows(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    out = decontaminate.decontaminated(spark, docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert {r.doc_id for r in out.collect()} == {d for d, v in brute(DOCS, ITEMS).items() if not v[4]}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert decontaminate.contamination(spark, docs, none).where("n_hit > 0 OR contaminated").count() == 0
    assert decontaminate.contamination(spark, docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_rows_without_an_id_are_judged_by_their_text(spark):
    docs = spark.createDataFrame([(None, ITEM, "a"), (None, ITEM + " end", "b"), (None, FILL, "c"), (None, FILL, "d"), (None, None, "e"), (1, ITEM, "f"), (2, FILL, "g")], "doc_id long, text string, source string")
    out = decontaminate.decontaminated(spark, docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert out.columns == docs.columns
    assert sorted(r.source for r in out.collect()) == ["c", "d", "e", "g"]
