"""Token counts and ids of a byte-level byte-pair vocabulary, by rank-synchronous merging of ragged arrays.

The texts of a batch are cut into pre-tokens by the pattern of the vocabulary; pre-tokens that the worker hasn't met are laid
out as one flat array of symbols with the bounds of each sequence. In every round each sequence applies its own lowest-ranked
pair at all its places at once, so a round is a handful of array operations for thousands of sequences; a sequence without a
ranked pair leaves. The count of a sequence is the number of symbols that survive.

That all places of the lowest pair may merge together needs a pair's result to be ranked later than the pair itself, which
holds for merge lists learned by frequency; ``Vocabulary`` checks it when it loads.

Defined cases: a null or empty text has 0 tokens. Strings of special tokens inside a text count as that one token, as the
library does by default. No text is cut or padded.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: How this vocabulary parts a text, for any text and for one within U+0000 to U+00FF, where the
#: letters, numbers and spaces of Unicode are spelled out. ASCII and Latin-1 texts are most of many corpora and are far faster so.
SPACE = "\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ANY_TEXT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
L1, N1, S1 = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
LATIN_TEXT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{L1}]+| ?[{N1}]+| ?[^{S1}{L1}{N1}]+|[{S1}]+(?![^{S1}])|[{S1}]+")

NONE = np.int32(2**31 - 1)
#: Pre-tokens that a worker keeps with their result, and the longest one it keeps: together they bound its memory.
CACHE, CACHED_CHARS = 400_000, 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merge ranks as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right, made = (np.array([ids[x] for x in side], np.int64) for side in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        born = np.full(max(ids.values()) + 1, -1, np.int64)
        born[made[::-1]] = np.arange(len(made))[::-1]
        if (np.maximum(born[left], born[right]) >= np.arange(len(made))).any() or len(set(made.tolist())) < len(made):
            raise ValueError("a merge comes before the merges that make its parts, or two merges make one symbol")
        order = np.argsort(left << 32 | right)
        self.keys, self.ranks, self.made = (left << 32 | right)[order], order.astype(np.int32), made[order].astype(np.int32)
        self.of_byte = np.zeros(256, np.int32)
        for c, b in byte_alphabet().items():
            self.of_byte[b] = ids[c]
        single = np.full(len(ids) + len(spec.get("added_tokens") or ()) + 1, -1, np.int64)
        single[self.of_byte] = np.arange(256)
        self.byte_ranks, self.byte_made = np.full(65536, NONE, np.int32), np.zeros(65536, np.int32)
        a, b = single[self.keys >> 32], single[self.keys & 0xFFFFFFFF]
        both = (a >= 0) & (b >= 0)
        self.byte_ranks[a[both] << 8 | b[both]], self.byte_made[a[both] << 8 | b[both]] = self.ranks[both], self.made[both]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or () if t.get("special")}
        self.special_text = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair, NONE if it has none, and the symbol that it makes."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), self.made[at]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that survive of each word: all of them in order, and how many each word has.

        Ranks are looked up once for each pair: at first from a table of pairs of bytes, later where a merge made a new neighbour.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ids, owner = self.of_byte[raw], np.repeat(np.arange(len(words)), lengths)
        pair = raw.astype(np.int64) << 8
        pair[:-1] |= raw[1:]
        rank, made = self.byte_ranks[pair], self.byte_made[pair]
        rank[np.cumsum(lengths[lengths > 0]) - 1] = NONE
        survived, ended = np.zeros(len(words), np.int64), []
        while len(ids):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            size = np.diff(np.r_[first, len(ids)])
            least = np.minimum.reduceat(rank, first)
            if (least == NONE).any():
                over = np.repeat(least == NONE, size)
                ended.append((owner[over], ids[over]))
                survived[owner[first[least == NONE]]] = size[least == NONE]
                ids, owner, rank, made = ids[~over], owner[~over], rank[~over], made[~over]
                size, least = size[least != NONE], least[least != NONE]
                if not len(ids):
                    break
            places = np.flatnonzero(rank == np.repeat(least, size))
            beside = np.flatnonzero(places[1:] == places[:-1] + 1)
            if len(beside):  # a pair of equal symbols in a run of them: every second place, from the left
                nth = np.arange(len(places))
                run = np.maximum.accumulate(np.where(np.r_[True, places[1:] != places[:-1] + 1], nth, 0))
                places = places[(nth - run) % 2 == 0]
            ids[places] = made[places]
            stay = np.ones(len(ids), bool)
            stay[places + 1] = False
            now = places - np.arange(len(places))  # where they are when the right halves have gone
            ids, owner, rank, made = ids[stay], owner[stay], rank[stay], made[stay]
            near = np.zeros(len(ids), bool)  # of the pairs there are now, those with a new symbol
            near[now], near[now[now > 0] - 1] = True, True
            anew = np.flatnonzero(near)
            rank[anew] = NONE
            anew = anew[anew < len(ids) - 1]
            anew = anew[owner[anew] == owner[anew + 1]]
            rank[anew], made[anew] = self.look_up(ids[anew], ids[anew + 1])
        if not ended:
            return np.empty(0, np.int32), survived
        own, flat = np.concatenate([o for o, _ in ended]), np.concatenate([f for _, f in ended])
        return flat[np.argsort(own, kind="stable")], survived


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def pre_tokens(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return ANY_TEXT.findall(text)
    return LATIN_TEXT.findall(text)


class Tokens:
    """Counts or ids of whole texts; keeps the results of pre-tokens that it has met, up to CACHE of them.

    ids: whether results are little-endian unsigned 32-bit ids instead of counts.
    """

    def __init__(self, path: str, ids: bool = False):
        self.vocabulary, self.ids = vocabulary(path), ids
        self.kept: dict = {}

    def learn(self, new: set[str]) -> dict:
        words = list(new)
        flat, n = self.vocabulary.merge([w.encode("utf-8") for w in words])
        if not self.ids:
            return dict(zip(words, n.tolist()))
        raw, ends = flat.astype("<u4").tobytes(), (np.cumsum(n) * 4).tolist()
        return {w: raw[a:b] for w, a, b in zip(words, [0, *ends], ends)}

    def parts(self, text: str) -> list[str]:
        special = self.vocabulary.special_text
        if special is None or not special.search(text):
            return pre_tokens(text)
        found: list[str] = []
        for i, piece in enumerate(special.split(text)):
            found += [f"\0special {piece}"] if i % 2 else pre_tokens(piece)
        return found

    def batch(self, texts: list[str | None]) -> list:
        """An int, or bytes of ids, for each text."""
        parts = [self.parts(t) if t else [] for t in texts]
        if len(self.kept) > CACHE:
            self.kept = {}
        if not self.kept:
            self.kept = {f"\0special {s}": (np.uint32(i).tobytes() if self.ids else 1) for s, i in self.vocabulary.special.items()}
        new = set().union(*parts).difference(self.kept)
        learned = self.learn(new) if new else {}
        long = {w for w in new if len(w) > CACHED_CHARS}
        self.kept.update(learned)
        get = self.kept.__getitem__
        out = [b"".join(map(get, p)) for p in parts] if self.ids else [sum(map(get, p)) for p in parts]
        for w in long:
            del self.kept[w]
        return out


@lru_cache(maxsize=4)
def counter_of(path: str, ids: bool = False) -> Tokens:
    """The worker's own; what it has met serves its later tasks too."""
    return Tokens(path, ids)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; one pass over the texts, no shuffle."""
    small_batches(docs.sparkSession)
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for batch in batches:
            n = pa.array(counter.batch(batch.column(2).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, pa.array([x > limit for x in n.to_pylist()], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    id_type = docs.schema[id_col].dataType.simpleString()
    texts = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.octet_length(texts).cast("long").alias("n_bytes"), texts.alias("text")).mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
