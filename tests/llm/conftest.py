import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
HEADS = {"en": "the of and to in that is was for with on as".split(), "fr": "le la les des une que pour dans avec est sur pas".split(), "de": "der die das und ist nicht mit von ein zu auf für".split()}
TAILS = {"en": "th ing er st ou ea nd".split(), "fr": "eau oi ée qu ai eux è".split(), "de": "sch ei ung ch tz ü pf".split()}


def prose(rng, lang, n):
    """Invented words of a language, frequent ones among them."""
    words = [rng.choice(HEADS[lang]) if rng.random() < 0.5 else "".join(rng.choice(TAILS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(words)


def make_documents(seed=5, n=60):
    """Documents with copies, near copies, shared passages, benchmark passages, licenses, nulls, empty and long texts."""
    rng = random.Random(seed)
    rows = []
    passage = prose(rng, "en", 70)
    for i in range(n):
        lang = rng.choice(sorted(HEADS))
        text = prose(rng, lang, rng.randint(3, 160))
        if i % 7 == 3:
            text = prose(rng, lang, 12) + "\n" + passage + " " + prose(rng, lang, 9)
        if i % 11 == 5:
            text += "\nReleased under the MIT License. " + ("This work is licensed under the GNU General Public License, version 3." if i % 2 else "")
        rows.append((i, text, lang, f"src{i % 3}", len(text)))
    for k in (4, 9, 9, 9, 20):  # exact copies, and near ones
        rows.append((len(rows), rows[k][1], rows[k][2], "src0", rows[k][4]))
        words = rows[k][1].split()
        words[len(words) // 2] = "changed"
        rows.append((len(rows), " ".join(words), rows[k][2], "src0", 0))
    repeat = prose(rng, "de", 25)
    extra = [None, "", "   \n\t ", "!!! ??? 123", "The", "a b", " ".join([repeat] * 40), prose(rng, "fr", 6000), "İstanbul　ΑΣ é ́x <|endoftext|> it's", "the the the the the the"]
    return rows + [(len(rows) + i, t, None if i % 2 else "en", "src1", None) for i, t in enumerate(extra)]


def make_items(rows):
    """Benchmark items, some of which stand in the documents."""
    words = rows[3][1].split()
    return [(0, " ".join(words[14:50])), (1, " ".join(words[5:13])), (2, "no document has this sentence at all in any place of it"), (3, None), (10, rows[1][1]), (4, "!!"), (4, "der die das und ist nicht")]


@pytest.fixture(scope="session")
def rows():
    return make_documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def items(rows):
    return make_items(rows)


@pytest.fixture(scope="session")
def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Repeated rows, a shared id with another text, no id, and extra columns with names that operators use too."""
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone twentytwo"
    given = [(1, text), (1, text), (2, text), (2, "another text of the same id"), (None, text), (None, None), (7, "")]
    schema = SCHEMA + ", score double, fp long, component_id long, n_words long, key long, tie long, lang_pred string, kept_text string, _key string, doc_key long, row_key long, factors string"
    return spark.createDataFrame([(i, t, "en" if k % 2 else "fr", "s", 1, 0.5, 1, 1, 1, 1, 1, "x", "y", "z", 1, 1, "f") for k, (i, t) in enumerate(given)], schema)
