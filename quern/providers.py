"""Models as plug-ins, with deterministic defaults that need no download.

An embedder adds ``embedding`` to texts, a reranker ``pair_score`` to candidates, a model ``reply`` to prompts.  Each is
registered under a name; configuration chooses by name.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import search_tokens

Transform = Callable[[DataFrame], DataFrame]
EMBEDDERS: dict[str, Callable[[int], Callable[[Column], Column]]] = {}


@dataclass(frozen=True)
class Reranker:
    """``prepare`` is worked out once for each distinct text, ``score`` for each pair of prepared texts."""

    prepare: Callable[[Column], Column]
    score: Callable[[Column, Column], Column]

    def __call__(self, question: Column, content: Column) -> Column:
        return self.score(self.prepare(question), self.prepare(content))


RERANKERS: dict[str, Reranker] = {}
MODELS: dict[str, Callable[[Column], Column]] = {}


def hashing_embedder(dim: int) -> Callable[[Column], Column]:
    """Signed counts of hashed tokens, scaled to length 1: native functions only."""

    def embed(text: Column) -> Column:
        hashed = F.transform(search_tokens(text), lambda t: F.xxhash64(t))
        start = F.array_repeat(F.lit(0.0), dim)
        slots = F.transform(hashed, lambda h: F.struct(F.pmod(h, F.lit(dim)).alias("i"), F.when(F.shiftrightunsigned(h, 63) == 1, -1.0).otherwise(1.0).alias("s")))
        counted = F.transform(start, lambda x, i: F.aggregate(slots, F.lit(0.0), lambda total, p: total + F.when(p.i == i, p.s).otherwise(0.0)))
        norm = F.sqrt(F.aggregate(counted, F.lit(0.0), lambda total, x: total + x * x))
        return F.transform(counted, lambda x: F.when(norm > 0, x / norm).otherwise(0.0).cast("float"))

    return embed


def _jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


#: Jaccard similarity of the two texts' distinct tokens, in [0, 1].
overlap_reranker = Reranker(lambda text: F.array_distinct(search_tokens(text)), _jaccard)


def score_pairs(pairs: DataFrame, questions: DataFrame, texts: DataFrame, reranker: Reranker, id_col: str = "doc_id") -> DataFrame:
    """``pairs`` (query_id, id) with pair_score, from ``questions`` (query_id, question) and ``texts`` (id, content).

    Only texts that occur in a pair are prepared, and each of them once.
    """
    met = texts.join(pairs.select(id_col).distinct(), id_col, "left_semi")
    ready = met.select(id_col, reranker.prepare(F.col("content")).alias("_content"))
    asked = questions.select("query_id", reranker.prepare(F.col("question")).alias("_question"))
    both = pairs.join(ready, id_col).join(asked, "query_id")
    return both.withColumn("pair_score", reranker.score(F.col("_question"), F.col("_content"))).drop("_question", "_content")


def no_model(prompt: Column) -> Column:
    """No reply to any prompt."""
    return F.lit(None).cast("string")


def http_model(url: str, key: str, model: str, temperature: float = 0.1, timeout: float = 60.0) -> Callable[[Column], Column]:
    """Replies of a chat service; called from executors, an Arrow batch of prompts at a time.  A failed call is null."""

    @F.pandas_udf("string")
    def reply(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def ask(prompt: str | None) -> str | None:
            if prompt is None:
                return None
            body = {"model": model, "temperature": temperature, "messages": [{"role": "user", "content": prompt}]}
            request = urllib.request.Request(f"{url.rstrip('/')}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
            try:
                with urllib.request.urlopen(request, timeout=timeout) as answer:
                    return json.load(answer)["choices"][0]["message"]["content"]
            except (OSError, ValueError, KeyError, IndexError):
                return None

        for part in prompts:
            yield part.map(ask)

    return reply


EMBEDDERS["hashing"] = hashing_embedder
RERANKERS["overlap"] = overlap_reranker
MODELS["none"] = no_model


def chosen(registry: dict, name: str):
    """A registered plug-in; an unknown name is an error, never another plug-in."""
    if name not in registry:
        raise KeyError(f"no plug-in is registered as {name!r}")
    return registry[name]


def notify(url: str | None, event: str, data: dict, source: str = "quern", timeout: float = 10.0) -> bool:
    """POST an event as JSON; True if it was taken.  Without an address, or if the call fails, False."""
    if not url:
        return False
    try:
        body = json.dumps({"event": event, "data": data, "source": source}, ensure_ascii=False, default=str).encode()
        with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as answer:
            return 200 <= answer.status < 300
    except (OSError, ValueError):
        return False
