"""Language identification by compression.

For every language a raw-content zstandard dictionary is filled with labelled texts.  A text, in lower case, belongs to the
language whose dictionary lets it compress to the fewest bytes.  Where the runner-up is almost as small, the text is rejected.
A longer text is compressed in blocks, each from the dictionary afresh: a text soon becomes its own best source, and then
the dictionaries' differences would vanish in its size.  A block is so short that nearly all of what it can refer to stands in
the dictionary, however small that is, so the margin of a long text is that of a kilobyte of it.

Learning is bounded: at most ``rows_per_language`` labelled rows of each language, with whole texts, as many as fit into
``dictionary_bytes`` (one at least).  The rows are those with the smallest hash of doc_id, found in two steps: a count of
rows by language, then only rows below a hash limit that keeps about four times the wanted number are ranked.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K

UNDECIDED = "und"
SHORT_BYTES = 300  # up to here a text has too few matches to compress alone, and is compressed behind leads instead
LETTER = r"\p{L}"
_OTHER = re.compile(r"[\W\d_]+")
BLOCK_BYTES = 1 << 10
LEADS, LEAD_BYTES = 3, 1024
NATS_PER_SHARE = 150.0  # what a share of the size tells of the odds: half a percent is 0.75, two are 3


def letters_only(text: str) -> str:
    """The words of a text in lower case, a space between them."""
    return _OTHER.sub(" ", text.lower()).strip()


def sample_by_label(rows: DataFrame, label: str, key: Column, limit: int) -> DataFrame:
    """About the ``limit`` rows of each label with the smallest hash of ``key``; a row per label is counted, never one task's sort."""
    hashed = rows.withColumn("_hash", F.xxhash64(key))
    counts = hashed.groupBy(label).count()
    share = F.lit(4.0 * limit) / F.col("count")
    near = hashed.join(F.broadcast(counts), label).where(F.col("_hash").cast("double") < (share * 2.0 - 1.0) * F.lit(2.0**63))
    ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy(label).orderBy("_hash")))
    return ranked.where(F.col("_rank") <= limit).drop("count", "_hash", "_rank")


def fit_dictionaries(docs: DataFrame, training: Column | None = None, rows_per_language: int = 64, dictionary_bytes: int = 1 << 16) -> dict[str, bytes]:
    """A raw-content dictionary for each language of the labelled rows; only ``text`` and ``lang`` are learned from.

    Rows without text, letters or language teach nothing.  No labelled row: no language.
    """
    rows = docs if training is None else docs.where(training)
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(LETTER)).select("doc_id", "lang", "text")
    picked = sample_by_label(rows, "lang", F.col("doc_id"), rows_per_language).withColumn("_size", F.octet_length("text"))
    before = F.sum("_size").over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "_size", "text")) - F.col("_size")
    picked = picked.withColumn("_before", before).where((F.col("_before") == 0) | (F.col("_before") + F.col("_size") <= dictionary_bytes))
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in picked.select("lang", "doc_id", "text").collect():
        texts.setdefault(r["lang"], []).append((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]))
    return {lang: " ".join(letters_only(t) for _, t in sorted(found)).encode() for lang, found in sorted(texts.items())}


class Compressors:
    """Compressed sizes of a text under the dictionary of every language.

    Only letters speak for a language, so texts and dictionaries are lower-case words with single spaces.  A few words
    are too short to compress alone: a short text is compressed behind a lead of the language's own text that is not in
    the dictionary, which has set up the codes of letters, and the size of the lead is taken off.  Several leads smooth
    the whole bytes in which sizes come.
    """

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        self.languages = sorted(dictionaries)
        window = max(18, max(map(len, dictionaries.values()), default=0).bit_length() + 1)
        fast = {"window_log": window, "hash_log": 16, "chain_log": 16, "search_log": 2, "min_match": 4, "target_length": 4, "strategy": z.STRATEGY_GREEDY}
        fine = {"window_log": window, "hash_log": 16, "chain_log": 17, "search_log": 4, "min_match": 3, "target_length": 32, "strategy": z.STRATEGY_BTOPT}
        self.fast, self.fine, self.leads = [], [], []
        for lang in self.languages:
            raw = dictionaries[lang]
            size = min(LEAD_BYTES, len(raw) // (2 * LEADS))
            cut = size * LEADS
            for out, settings in ((self.fast, fast), (self.fine, fine)):
                params = z.ZstdCompressionParameters(**settings, write_content_size=0, write_checksum=0, write_dict_id=0)
                held = z.ZstdCompressionDict(raw[cut:], dict_type=z.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(compression_params=params)
                out.append(z.ZstdCompressor(dict_data=held, compression_params=params))
            leads = [raw[i * size : (i + 1) * size] for i in range(LEADS)]
            self.leads.append([(lead, len(self.fine[-1].compress(lead))) for lead in leads])

    def sizes(self, text: bytes) -> list[float]:
        if len(text) > SHORT_BYTES:
            n = -(-len(text) // BLOCK_BYTES)
            cuts = [len(text) * i // n for i in range(n + 1)]
            blocks = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            return [sum(len(c.compress(b)) for b in blocks) for c in self.fast]
        return [max(0.5, sum(len(c.compress(lead + b" " + text)) - n for lead, n in leads) / LEADS) for c, leads in zip(self.fine, self.leads, strict=True)]

    def judge(self, raw: bytes) -> tuple[str, float, float]:
        """Language, score and margin of a text."""
        return self._decide(self.sizes(letters_only(raw.decode()).encode()))

    def _decide(self, sizes: list[float]) -> tuple[str, float, float]:
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = sizes[:best] + sizes[best + 1 :]
        odds = sum(math.exp(-min(700.0, (s / sizes[best] - 1.0) * NATS_PER_SHARE)) for s in rest)
        return self.languages[best], 1.0 / (1.0 + odds), (min(rest) - sizes[best]) / min(rest) if rest else 1.0


_ready: dict[int, Compressors] = {}


def _compressors(dictionaries: dict[str, bytes]) -> Compressors:
    key = hash(tuple(sorted(dictionaries.items())))
    if key not in _ready:
        _ready.clear()
        _ready[key] = Compressors(dictionaries)
    return _ready[key]


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = 0.005, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default doc_id) and, for each row, lang_pred, score, margin and accepted.

    lang_pred is ``und`` if the text is null or has no letter, or if no language was learned; then score is 0 and the
    row is not accepted.  Equal sizes go to the first language by name.  margin is the share of bytes by which the best
    size is below the next, 1 where there is one language.  A row is accepted if its margin reaches ``min_margin``.  A text
    of any length is compressed whole, in blocks.  score grows with the margins to the other languages, as shares of the
    size, and not with the length.  Rows that are repeated or share a doc_id are judged each on their own.  No
    rows: no result.
    """
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    flag, text = K.free_name("_letters", docs.columns), K.free_name("_text", docs.columns)
    names = [K.free_name(n, keep) for n in ("lang_pred", "score", "margin", "accepted")]
    rows = docs.select(*K.columns(keep), F.col("text").cast("string").alias(text), F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias(flag))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*K.columns(keep)).schema), f"`{names[0]}` string", f"`{names[1]}` double", f"`{names[2]}` double", f"`{names[3]}` boolean"])

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        model = _compressors(shared.value)
        out: list[tuple[str, float, float, bool]] = []
        data, offsets = K.text_bytes(part.column(text))
        for a, b, letters in zip(offsets[:-1].tolist(), offsets[1:].tolist(), part.column(flag).to_pylist(), strict=True):
            if not letters or not model.languages:
                out.append((UNDECIDED, 0.0, 0.0, False))
                continue
            lang, score, margin = model.judge(data[a:b].tobytes())
            out.append((lang, score, margin, margin >= min_margin))
        pred, score, margins, accepted = zip(*out, strict=True) if out else ((), (), (), ())
        held = [part.column(n) for n in keep]
        return pa.RecordBatch.from_arrays([*held, pa.array(pred, pa.string()), pa.array(np.array(score, float)), pa.array(np.array(margins, float)), pa.array(accepted, pa.bool_())], names=[*keep, *names])

    return K.map_texts(rows, work, schema, text=text)
