"""PDF files made here are read back: words, columns, tables, facts, images; broken ones give an error row."""

import base64
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.sources import files, pdf
from quern.sources.made_pdf import grid_page, made_pdf, text_page

WORDS = "retrieval of private documents needs an index that holds each word and its place in every page".split()


def parsed(spark, contents):
    rows = spark.createDataFrame([(p, bytearray(c)) for p, c in contents.items()], "path string, content binary")
    out = {}
    for r in files.parse(rows).collect():
        out.setdefault(r.path, []).append(r)
    return {p: sorted(rs, key=lambda r: r.ordinal) for p, rs in out.items()}


def some_lines(n, seed=1, width=7):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(width)) for _ in range(n)]


def test_pages_and_facts(spark):
    pages = [some_lines(30, 1), ["Page 2", "it's (a) \\ test: é ü ß €", "a hyphen-", "ated word", "17"], []]
    facts = {"Title": "On Words", "Author": "(anonymous)", "Keywords": "a, b"}
    made = {f"{k}.pdf": made_pdf([text_page(p) for p in pages], facts, packed=k != "plain", broken_table=k == "broken") for k in ("plain", "packed", "broken")}
    for rows in parsed(spark, made).values():
        assert [(r.page, r.total_pages, r.layout, r.chunk_role, r.parser) for r in rows] == [(0, None, None, "pdf_metadata", "pdf"), (1, 3, "single-column", None, "pdf"), (2, 3, "single-column", None, "pdf")]
        assert rows[0].content == "PDF Metadata:\nTitle: On Words\nAuthor(s): (anonymous)\nKeywords: a, b".replace("Author(s): (anonymous)\n", "")
        assert rows[1].content == "\n".join(pages[0])
        assert rows[2].content == "it's (a) \\ test: é ü ß €\na hyphenated word"


def test_two_columns(spark):
    left, right = some_lines(20, 2, 4), some_lines(20, 3, 4)
    page = text_page(["A title that spans both of the columns"], top=760) + text_page(left, left=50, top=600) + text_page(right, left=330, top=600)
    (row,) = parsed(spark, {"a.pdf": made_pdf([page])})["a.pdf"]
    assert row.layout == "two-column" and row.content == "\n".join(["A title that spans both of the columns", *left, *right])


def test_tables(spark):
    cells = [["metric", "2023", "2024"], ["hits at 5", "0.81", ""], ["recall", "0.7", "0.75"]]
    second = [["a", "b"], ["c", "d"]]
    page = text_page(["Results of the year"]) + grid_page(cells) + grid_page(second, top=500)
    boxes = b"".join(b"%d %d 90 20 re S\n" % (60 + 90 * c, 640 + 20 * r) for r in range(3) for c in range(2))
    rows = parsed(spark, {"t.pdf": made_pdf([page, boxes + text_page(["in a box"], left=64, top=646)])})["t.pdf"]
    want = ["[Tables]", "| metric | 2023 | 2024 |", "| --- | --- | --- |", "| hits at 5 | 0.81 |  |", "| recall | 0.7 | 0.75 |", "| a | b |", "| --- | --- |", "| c | d |"]
    assert rows[0].content.split("\n")[0] == "Results of the year" and rows[0].content.split("\n")[-8:] == want
    assert rows[1].content.split("\n") == ["in a box", "[Tables]", "|  |  |", "| --- | --- |", "|  |  |", "| in a box |  |"]


def test_broken_files_give_an_error(spark):
    good = made_pdf([text_page(["fine"])])
    locked = good.replace(b"/Root 1 0 R", b"/Encrypt 9 0 R /Root 1 0 R")
    damaged = made_pdf([text_page(some_lines(5))], packed=True)
    at = damaged.index(b"stream\n") + 12
    found = parsed(spark, {"a.pdf": b"%PDF", "b.pdf": b"", "c.pdf": b"no pdf at all", "d.pdf": locked, "e.pdf": damaged[:at] + b"\xff\xff\xff\xff\xff\xff" + damaged[at + 6 :], "f.PDF": good, "g.pdf": good[: len(good) // 2]})
    for p in "abcde":
        (row,) = found[f"{p}.pdf"]
        assert row.content is None and row.error, p
    assert "encrypted" in found["d.pdf"][0].error and found["f.PDF"][0].content == "fine"


def test_registered_parsers_come_first(spark):
    def picky(raw):
        if b"fine" in raw:
            return [{"content": "mine"}]
        raise ValueError("not for me")

    files.register_parser("pdf", picky)
    try:
        found = parsed(spark, {"a.pdf": made_pdf([text_page(["fine"])]), "b.pdf": made_pdf([text_page(["other"])])})
        assert [(r.content, r.parser) for p in "ab" for r in found[f"{p}.pdf"]] == [("mine", "picky"), ("other", "pdf")]
    finally:
        files.PARSERS["pdf"].remove(picky)


def font_file():
    """Two-byte codes with a character map in an object stream, referenced from a cross-reference stream, filters in a row."""
    cmap = b"1 beginbfchar <0003> <0020> endbfchar 2 beginbfrange <0010> <0029> <0061> <0030> <0031> [<00DF> <D83DDE00>] endbfrange"
    packed = base64.a85encode(zlib.compress(cmap)) + b"~>"
    codes = lambda text: b"".join((3 if c == " " else 0x30 + "ß😀".index(c) if c in "ß😀" else 0x10 + ord(c) - 97).to_bytes(2) for c in text).hex().encode()
    content = b"BT /F1 12 Tf 1 0 0 1 72 700 Tm [<" + codes("wide ") + b"> -200 <" + codes("codes") + b">] TJ 0 -20 Td <" + codes("ß😀") + b"> Tj ET"
    inner = [b"<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /Identity-H /DescendantFonts [6 0 R] /ToUnicode 7 0 R >>", b"<< /Type /Font /Subtype /CIDFontType2 /DW 500 /W [3 [250] 16 41 600] >>"]
    head = b"5 0 6 %d " % (len(inner[0]) + 1)
    body = zlib.compress(head + b" ".join(inner))
    out = b"%PDF-1.5\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj\n"
    out += b"3 0 obj << /Type /Page /Parent 2 0 R /MediaBox [0 0 600 800] /Contents [4 0 R] /Resources << /Font << /F1 5 0 R >> >> >> endobj\n"
    out += b"4 0 obj << /Length %d >> stream\n" % len(content) + content + b"\nendstream endobj\n"
    out += b"7 0 obj << /Length 9 0 R /Filter [/ASCII85Decode /FlateDecode] >> stream\n" + packed + b"\nendstream endobj 9 0 obj %d endobj\n" % len(packed)
    out += b"8 0 obj << /Type /ObjStm /N 2 /First %d /Filter /FlateDecode /Length %d >> stream\n" % (len(head), len(body)) + body + b"\nendstream endobj\n"
    return out + b"10 0 obj << /Type /XRef /Root 1 0 R /Size 11 /Length 0 >> stream\n\nendstream endobj"


def test_wide_fonts_and_object_streams():
    rows = [r for r in pdf.word_rows("x.pdf", font_file()) if r.get("text")]
    assert [r["text"] for r in rows] == ["wide", "codes", "ß😀"] and rows[0]["x0"] == 72 and abs(rows[0]["x1"] - 72 - 4 * 7.2) < 1e-6
    assert rows[2]["top"] - rows[0]["top"] == pytest.approx(20)


def test_filters():
    rng = random.Random(3)
    data = bytes(rng.choice(b"abcab  ") for _ in range(5000))
    assert pdf._run_lengths(b"\x02abc\xfed\x80zz") == b"abcddd"
    codes, table, width, bits, out = [256], {bytes([i]): i for i in range(256)}, 9, "", b""
    seen, n = 258, b""
    for b in data:  # an encoder as the format describes it
        if n + bytes([b]) in table:
            n += bytes([b])
            continue
        codes.append(table[n])
        table[n + bytes([b])] = seen
        seen += 1
        n = bytes([b])
    codes += [table[n], 257]
    size = 258
    for k, c in enumerate(codes):
        bits += format(c, f"0{width}b")
        if k:
            size += 1
        width = min(12, max(9, (size + 1 - (k == 0)).bit_length())) if k else 9
    out = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
    assert pdf._lzw(out[:600], 1)[:300] == data[:300]
    lines = np.random.default_rng(1).integers(0, 256, (5, 12), np.uint8)
    up = np.vstack([lines[:1], np.diff(lines.astype(int), axis=0) % 256]).astype(np.uint8)
    raw = b"".join(b"\x02" + r.tobytes() for r in up)
    assert pdf._unpredict(raw, {"Predictor": 12, "Columns": 12}) == lines.tobytes()
    sub = lines.copy().astype(int)
    sub[:, 3:] = (lines[:, 3:].astype(int) - lines[:, :-3]) % 256
    assert pdf._unpredict(b"".join(b"\x01" + bytes(r.tolist()) for r in sub), {"Predictor": 11, "Columns": 4, "Colors": 3}) == lines.tobytes()
    assert pdf._unpredict(b"".join(bytes(r.tolist()) for r in sub), {"Predictor": 2, "Columns": 4, "Colors": 3}) == lines.tobytes()


def test_images(spark):
    def image(width, height, space, data, bits=8):
        return b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /BitsPerComponent %d /ColorSpace %s /Filter /FlateDecode /Length %d >>\nstream\n" % (width, height, bits, space, len(zlib.compress(data))) + zlib.compress(data) + b"\nendstream"

    made = {
        "Rgb": image(120, 110, b"/DeviceRGB", bytes([200, 10, 30]) * (120 * 110)), "Ink": image(100, 100, b"/DeviceCMYK", bytes([255, 0, 0, 0]) * 10_000), "Small": image(20, 200, b"/DeviceGray", b"\x07" * 4000),
        "Bit": image(104, 101, b"/DeviceGray", b"\xf0" * 13 * 101, 1), "Palette": image(100, 100, b"[/Indexed /DeviceRGB 1 <010203040506>]", b"\x01" * 10_000),
    }
    page = b"".join(b"q 50 0 0 50 0 0 cm /%s Do Q\n" % n.encode() for n in made)
    rows = spark.createDataFrame([("i.pdf", bytearray(made_pdf([page, b"/Rgb Do"], objects=made))), ("no.pdf", bytearray(b"%PDF"))], "path string, content binary")
    found = files.images(rows).orderBy("ordinal").collect()
    assert [(r.page, r.width, r.height) for r in found] == [(1, 120, 110), (1, 100, 100), (1, 20, 200), (1, 104, 101), (1, 100, 100), (2, 120, 110)]
    pixels = []
    for r in found:
        assert files.image_size(r.image) == (r.width, r.height)
        data = zlib.decompress(r.image[r.image.index(b"IDAT") + 4 : -16])
        pixels.append(tuple(data[1 : 1 + 3]))
    assert pixels == [(200, 10, 30), (0, 255, 255), (7, 7, 7), (255, 255, 255), (4, 5, 6), (200, 10, 30)]
    said = files.image_captions(files.images(rows), F.concat(F.lit("image "), F.col("ordinal")), most=3).orderBy("page", "content").collect()
    assert [(r.source, r.page) for r in said] == [("i.pdf", 1)] * 3 and said[2].content.endswith("image 3")


def test_strings_that_stand_among_each_other_are_read_by_their_characters():
    """A string is read as a whole only where no other one begins among its characters; else all go by their places."""
    over = b"BT /F1 10 Tf 50 700 Td (mmmm end) Tj ET BT /F1 10 Tf 54 700 Td (i) Tj ET"
    after = b"BT /F1 10 Tf 50 700 Td (one tw) Tj (o three ) Tj (four) Tj ET"
    said = [[r["text"] for r in pdf.word_rows("x.pdf", made_pdf([content])) if r.get("text")] for content in (over, after)]
    assert said == [["mimmm", "end"], ["one", "two", "three", "four"]]
    page = next(iter(pdf.read_pages(pdf.Document(made_pdf([text_page(some_lines(40))])))))
    assert len(page.glyphs) == 40  # one for each string, not for each character


def test_files_of_documents_are_made_and_read_by_all_tasks(spark, tmp_path):
    from quern.plans import pdfs

    rows = spark.range(64).selectExpr("id as doc_id", "concat('word ', id) as text", "'en' as lang")
    rows.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    made = pdfs._document_files(spark, str(tmp_path))
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert pdfs.doc_texts(spark, str(tmp_path)).count() == pdfs.pdf_words(spark, str(tmp_path)).count() == 64


def test_pages_are_made_in_one_pass_without_a_shuffle(spark):
    """Files are gone through once, no row is a word, and no page moves."""
    rows = spark.createDataFrame([(f"{k}.pdf", bytearray(made_pdf([text_page(some_lines(30, k))], {"Title": str(k)}))) for k in range(3)], "path string, content binary")
    found = files.parse(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1
    assert sorted((r.path, r.page) for r in found.collect()) == [(f"{k}.pdf", p) for k in range(3) for p in (0, 1)]


def test_words_of_a_page_are_one_row(spark):
    pages = [some_lines(50, 1, 4), [], [r"a (b) \ c", "d"]]
    rows = spark.createDataFrame([("a.pdf", bytearray(made_pdf([text_page(p) for p in pages]))), ("b.pdf", bytearray(b"%PDF")), ("c.txt", bytearray(b"no"))], "path string, content binary")
    found = {(r.path, r.page): r for r in pdf.words(rows).collect()}
    assert sorted(found) == [("a.pdf", 1), ("a.pdf", 2), ("a.pdf", 3), ("b.pdf", 0)]
    assert [found["a.pdf", k].text for k in (1, 2, 3)] == [" ".join(p).split() for p in pages] and found["a.pdf", 1].error is None
    assert found["b.pdf", 0].error and found["b.pdf", 0].text == [] and found["b.pdf", 0].total_pages is None
    first = found["a.pdf", 1]
    assert first.total_pages == 3 and first.x0[::4] == [50.0] * 50 and first.grid == [-1] * 200 and len(first.x1) == len(first.top) == 200


def test_strings_below_each_other_are_read_as_each_alone(monkeypatch):
    """Whatever the leading, spacing, font and matrices, reading many strings at once gives the words of reading each."""
    lines = [*some_lines(12, 4), "", " two  blanks ", "(in) \\ brackets)", "é ü €", "mm"]
    shown = text_page(lines, size=7)
    states = [b"", b"0.5 Tc 2 Tw ", b"150 Tz ", b"3 Ts ", b"-1 Tc ", b"2 0 0.3 2 40 60 cm ", b"0 1 -1 0 300 20 cm ", b"/F2 9 Tf "]
    contents = [s + shown for s in states] + [shown.replace(b"14 TL", leading) for leading in (b"2 TL", b"3 TL", b"-9 TL", b"0 TL")]
    contents += [shown + text_page(["beside"] * 6, left=300, size=8), text_page(lines, top=200) + shown.replace(b"ET", b"(open) Tj (end) Tj T* ET"), b"q " + shown + b"Q (lost) Tj", b"/F1 9 Tf BT 20 500 Td (alone) Tj ET " + shown]
    raw = made_pdf(contents, packed=True)
    at_once = pdf.word_rows("x.pdf", raw)
    assert any(isinstance(x, pdf.Below) for p in pdf.read_pages(pdf.Document(raw)) for x in p.shown)
    monkeypatch.setattr(pdf, "FEWEST_BELOW", 1 << 30)
    alone = pdf.word_rows("x.pdf", raw)
    assert [(r["page"], r["n"], r["text"]) for r in at_once] == [(r["page"], r["n"], r["text"]) for r in alone] and len(alone) > 1000
    for c in pdf.PLACES:
        assert [r[c] for r in at_once] == pytest.approx([r[c] for r in alone], abs=1e-6)


def test_bands_and_lines_are_those_of_the_operators_on_words(spark):
    """Columns, bands and lines of pages as the operators on tables of words and a plain ordering give them."""
    rng = random.Random(9)
    pages = []
    for k in range(60):
        n, spread = rng.choice([3, 29, 30, 60, 120]), rng.choice([1, 40, 700])
        places = np.array([(x := rng.choice([rng.uniform(0, 600), rng.choice([50, 270, 286, 296, 306, 330])]), x + 5, t := rng.choice([rng.uniform(0, 790), 40 + spread * rng.random()]), t + 9) for _ in range(n)]).T
        pages.append(pdf.Words(k, 60, 612.0, 792.0, places, [rng.choice("abc") for _ in range(n)], None, []))
    rows = [(p.page, n, p.width, p.height, float(p.places[0][n]), float(p.places[2][n]), p.texts[n]) for p in pages for n in range(len(p.texts))]
    table = spark.createDataFrame(rows, "page int, n int, page_width double, page_height double, x0 double, top double, text string")
    two = {r.page: r.two_column for r in files.two_column_pages(table).collect()}
    banded: dict = {}
    for r in files.reading_order(table).collect():
        banded.setdefault((r.page, r.band if two[r.page] else 0), []).append((r.top, r.x0, r.text))

    def in_lines(words):
        lines, before = [], None
        for top, x0, text in sorted(words):
            if before is None or top - before > pdf.Y_GAP:
                lines.append([])
            lines[-1].append((x0, top, text))
            before = top
        return "\n".join(" ".join(t for _, _, t in sorted(line)) for line in lines)

    for page, (two_column, texts) in zip(pages, pdf.page_texts(pages), strict=True):
        assert two_column == two[page.page] and texts == [in_lines(banded[page.page, b]) for b in range(3) if (page.page, b) in banded]
    assert set(two.values()) == {True, False}


def test_a_file_at_fault_leaves_those_read_with_it(monkeypatch):
    made = [(f"{k}.pdf", made_pdf([text_page(some_lines(9, k))], {"Title": "t"})) for k in range(3)]
    merged = pdf.words_below

    def faulty(runs):
        if any(b"fault" in x for r in runs for x in r.strings):
            raise ValueError("at fault")
        return merged(runs)

    monkeypatch.setattr(pdf, "words_below", faulty)
    found = pdf.page_rows([*made, ("f.pdf", made_pdf([text_page(["fault"] * 9)]))])
    assert [[(r["page"], r["error"]) for r in rows] for rows in found] == [[(0, None), (1, None)]] * 3 + [[(0, "ValueError: at fault")]]
    assert [rows[1]["texts"] for rows in found[:3]] == [["\n".join(some_lines(9, k))] for k in range(3)]


def test_words_give_on_the_columns_that_are_named_alone(spark):
    page = text_page(some_lines(6), top=600) + grid_page([["a", "b"], ["c", ""]], top=300)
    rows = spark.createDataFrame([("a.pdf", bytearray(made_pdf([page]))), ("b.pdf", bytearray(b"%PDF"))], "path string, content binary")
    some = pdf.words(rows, "text", "page", "grid_row")
    whole = pdf.words(rows)
    assert some.columns == ["page", "text", "grid_row"] and [c.split()[0] for c in pdf.WORD_SCHEMA.split(", ")] == whole.columns
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, whole.select("page", "text", "grid_row").collect()))
    assert [r.grid_row[-3:] for r in some.collect() if r.page] == [[0, 0, 1]]


def test_pdf_words_of_odd_documents(spark, tmp_path):
    """No text, no language, brackets and backslashes, a word over lines, many pages: the words and their hash come back."""
    import hashlib

    from quern.plans import pdfs

    texts = {0: None, 1: "", 2: " \n\t ", 3: r"a (b) \ c) (", 4: " ".join(f"w{k}" for k in range(4 * 45 * 2 + 1)), 5: "x" * 5000, 6: "one", 7: "été 1 / 2\n3"}
    spark.createDataFrame([(k, t, None) for k, t in texts.items()], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    found = pdfs.pdf_words(spark, str(tmp_path))
    words = {k: (t or "").split() for k, t in texts.items()}
    assert {r.doc_id: (r.n_words, r.words_sha256) for r in found.collect()} == {k: (len(w), hashlib.sha256(" ".join(w).encode()).hexdigest()) for k, w in words.items()}
    pages = {(r.doc_id, r.page) for r in pdfs.pdf_pages(spark, str(tmp_path)).collect()}
    assert pages == {(k, 0) for k in texts} | {(3, 1), (4, 1), (4, 2), (4, 3), (5, 1), (6, 1), (7, 1)}
