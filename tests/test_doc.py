"""Files with a piece table are read back; broken ones give an error row."""

import random

import pytest

from quern.sources import files
from quern.sources.doc import MAGIC, document_text, made_doc


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("n", [1, 40, 3000])
def test_paragraphs_are_read_back(wide, n):
    """In small and large streams, with narrow, wide and mixed pieces."""
    rng = random.Random(n)
    paragraphs = [" ".join(rng.choice(["a", "contract", "größe", "日本", "€", "“x”", "ł"]) for _ in range(rng.randint(1, 9))) for _ in range(n)]
    for pieces in (1, 3, 400):
        assert document_text(made_doc(paragraphs, wide, pieces)) == "\n".join(paragraphs)


def test_fields_cells_and_marks():
    paragraphs = ["see \x13 HYPERLINK \"http://x\" \x14the page\x15 now", "a\x07b\x07", "  ", "soft\x1fhyphen and non\x1ebreaking", "\x13 A \x13 B \x14 inner \x15 \x14outer\x15", "one\x0btwo\x0cthree", "\x13 PAGE \x15"]
    assert document_text(made_doc(paragraphs)) == "see the page now\na\tb\nsofthyphen and non-breaking\nouter\none\ntwo\nthree"


def test_broken_files_give_an_error(spark):
    good = made_doc(["fine text"] * 200)
    locked = bytearray(good)
    locked[512 + 10 : 512 + 12] = (0x300).to_bytes(2, "little")
    looped = bytearray(good)
    table = 512 + 512 * int.from_bytes(good[76:80], "little")
    looped[table + 4 : table + 8] = (0).to_bytes(4, "little")
    made = {"a.doc": good, "b.doc": b"", "c.doc": b"plain text", "d.doc": MAGIC, "e.doc": good[:3000], "f.doc": bytes(locked), "g.doc": bytes(looped), "h.doc": made_doc(["   "])}
    rows = spark.createDataFrame([(p, bytearray(c)) for p, c in made.items()], "path string, content binary")
    found = {r.path: r for r in files.parse(rows).collect()}
    assert found["a.doc"].content == "\n".join(["fine text"] * 200) and found["a.doc"].parser == "doc" and "h.doc" not in found
    assert all(found[f"{p}.doc"].content is None and found[f"{p}.doc"].error for p in "bcdefg") and "encrypted" in found["f.doc"].error


def test_random_damage_is_an_error_or_a_text():
    good, rng = made_doc(["some words here"] * 60), random.Random(5)
    for _ in range(300):
        bad = bytearray(good)
        for _ in range(rng.randint(1, 6)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        rows = files.parse_one("x.doc", bytes(bad), files.PARSERS)
        assert len(rows) <= 1 and all(bool(r.get("error")) != bool(r.get("content")) for r in rows)


def test_files_that_are_no_pdf_are_gone_through_once(spark, tmp_path):
    from quern.plans import pdfs

    texts = ["one\ntwo", "", " \n", None, "größe 日本\r\n\n x\xa0y \x0bz", "a" * 3_000_000 + "\nlast"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = pdfs.doc_texts(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and plan.count("MapInArrow") == 2 and "Union" not in plan
    assert {r.doc_id: r.content for r in found.collect()} == {0: "one\ntwo", 4: "größe 日本\nx y\nz", 5: texts[5]}
    rows = spark.createDataFrame([("a.pdf", bytearray(b"%PDF-1.4")), ("a.doc", bytearray(made_doc(["x"])))], "path string, content binary")
    assert [r.path for r in files.parse(rows, pdfs=False).collect()] == ["a.doc"]
    assert {r.path for r in files.parse(rows).collect()} == {"a.pdf", "a.doc"}
