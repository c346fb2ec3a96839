"""Boundaries to models: embedding, recognition of pages and speech, generation; with deterministic stand-ins that need no network.

A backend is a plain object with one method; it is made once in each worker from a picklable factory. An embedding that fails
gives its error and whether it may be tried again, so a batch is never lost.
"""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BATCH = 32
#: What a recogniser of pages takes: endings, and the most bytes.
PAGE_ENDINGS, PAGE_BYTES = (".pdf", ".png", ".jpg", ".jpeg", ".webp"), 20 * 1024 * 1024
RECOGNISED = "struct<text:string,error:string,transient:boolean>"
EMBEDDED = "struct<embedding:array<float>,error:string,transient:boolean>"


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class Recogniser(Protocol):
    def extract(self, path: str, data: bytes) -> str: ...


class Generator(Protocol):
    def generate(self, prompt: str) -> str: ...


class Transient(RuntimeError):
    """May be tried again."""


class HashedWords:
    """Stand-in: words hashed into a vector of unit length; where they cancel each other out, or there is no word, the whole text is hashed.
    An empty text has no direction."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimension
            self.add(v, text.lower().split())
            if text and not any(v):
                self.add(v, [text])
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        return out

    def add(self, v: list[float], words: Sequence[str]) -> None:
        for word in words:
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
            v[h % self.dimension] += 1.0 if h >> 63 else -1.0


class PlainText:
    """Stand-in: the bytes as text."""

    def extract(self, path: str, data: bytes) -> str:
        return data.decode("utf-8", "replace")


class Echo:
    """Stand-in: the last line of the prompt."""

    def generate(self, prompt: str) -> str:
        return prompt.strip().rsplit("\n", 1)[-1]


def backoff(attempt: int, first_s: float = 0.25, most_s: float = 30.0) -> float:
    return min(most_s, first_s * 2**attempt)


def with_retries(call: Callable[[], object], attempts: int = 3, sleep: Callable[[float], None] = time.sleep):
    for attempt in range(attempts):
        try:
            return call()
        except Transient:
            if attempt + 1 == attempts:
                raise
            sleep(backoff(attempt) * (1 + random.random() / 4))


def embedding(factory: Callable[[], Embedder], attempts: int = 3) -> Callable[[Column], Column]:
    """A column function text -> EMBEDDED, in batches of BATCH texts."""

    @F.pandas_udf(EMBEDDED)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = factory()
        for part in parts:
            rows: list[tuple] = []
            texts = part.tolist()
            for i in range(0, len(texts), BATCH):
                batch = texts[i : i + BATCH]
                try:
                    made = with_retries(lambda b=batch: model.embed(b), attempts)
                    if len(made) != len(batch):
                        raise ValueError(f"{len(made)} vectors for {len(batch)} texts")
                    rows += [(v, None, False) for v in made]
                except Transient as e:
                    rows += [(None, str(e), True)] * len(batch)
                except Exception as e:  # noqa: BLE001  the row carries it
                    rows += [(None, str(e), False)] * len(batch)
            yield pd.DataFrame(rows, columns=["embedding", "error", "transient"])

    return run


def recognised(model: Recogniser, path: str, data: bytes, endings: tuple[str, ...] = (), most_bytes: int = 0, attempts: int = 3) -> tuple[str | None, str | None, bool]:
    """(text, error, whether it may be tried again); lines end in newlines. What isn't taken is an error like any other."""
    try:
        if endings and not path.lower().endswith(endings):
            raise ValueError(f"not recognised: {path.rsplit('/', 1)[-1]}")
        if most_bytes and len(data) > most_bytes:
            raise ValueError(f"{len(data)} bytes are more than {most_bytes}")
        text = with_retries(lambda: model.extract(path, data), attempts)
        return text.replace("\r\n", "\n").replace("\r", "\n"), None, False
    except Transient as e:
        return None, str(e), True
    except Exception as e:  # noqa: BLE001  the row carries it
        return None, str(e) or type(e).__name__, False


def recognition(factory: Callable[[], Recogniser], endings: tuple[str, ...] = (), most_bytes: int = 0, attempts: int = 3) -> Callable[[Column, Column], Column]:
    """A column function (path, content) -> RECOGNISED."""

    @F.pandas_udf(RECOGNISED)
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = factory()
        for paths, contents in parts:
            rows = [recognised(model, p, bytes(c), endings, most_bytes, attempts) for p, c in zip(paths, contents)]
            yield pd.DataFrame(rows, columns=["text", "error", "transient"])

    return run


class ModelError(RuntimeError):
    """A model failed; whether the call may be made again."""

    def __init__(self, message: str, retryable: bool = False):
        super().__init__(message)
        self.retryable = retryable


def generated(factory: Callable[[], Generator], prompt: str) -> str:
    """The answer to one prompt; ModelError says why there is none."""
    try:
        return with_retries(lambda: factory().generate(prompt))
    except Exception as e:  # noqa: BLE001
        raise ModelError(str(e) or type(e).__name__, isinstance(e, Transient)) from e
