"""Operator 9: BPE encoding and decoding with a contiguous rank array.

A text is cut at the tokenizer's special tokens, then by its pre-tokenizer's pattern into short words. A word's parts
are held as a contiguous array of boundaries beside the rank of each adjacent pair: the array is scanned for the least
rank, that boundary is deleted, and the ranks of the two neighbouring pairs are refreshed, until no pair has a rank.
Scanning is cheap for short words; a word over LONG bytes takes the same merges from a heap, so that its time does not
grow with the square of its length. Words repeat, so each task keeps a bounded memo of them.

Defined results: a null text is the empty text, which has no ids and decodes to itself; a row for each row, so repeated
rows repeat and a null doc_id stays null; a very long text is encoded whole, its ids held in one list; encode and
decode add __ids and __decoded and let all other columns through; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the pattern of byte-level BPE pre-tokenizers; \s as Unicode's White_Space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
LONG, MEMO = 256, 500_000
_NONE = 1 << 60


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: printable Latin-1 bytes by themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE tokenizer read from the text of a tokenizer.json."""

    def __init__(self, spec: str, memo: int = MEMO):
        d = json.loads(spec)
        letters = {c: b for b, c in _byte_letters().items()}
        self.id_of = {bytes(letters[c] for c in t): i for t, i in d["model"]["vocab"].items()}
        self.rank = {}
        for r, m in enumerate(d["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank.setdefault((bytes(letters[c] for c in a), bytes(letters[c] for c in b)), r)
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.bytes_of = {i: t for t, i in self.id_of.items()} | {i: c.encode() for c, i in self.special.items()}
        self.words = regex.compile(PATTERN)
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.memo: dict[str, tuple[int, ...]] = {}
        self.memo_size = memo

    def merge(self, data: bytes) -> list[bytes]:
        """The parts of one word."""
        if len(data) > LONG:
            return self._merge_long(data)
        rank = self.rank.get
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [rank((a, b), _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            at = ranks.index(least)
            parts[at] += parts.pop(at + 1)
            ranks.pop(at)
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), _NONE)
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), _NONE)
        return parts

    def _merge_long(self, data: bytes) -> list[bytes]:
        n = len(data)
        parts: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, ahead = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i, 2) for i in range(n - 1) if (r := self.rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, size = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or len(parts[i]) + len(parts[j]) != size or self.rank.get((parts[i], parts[j])) != r:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[j] < n:
                ahead[after[j]] = i
            for a in (ahead[i], i):
                if a >= 0 and (b := after[a]) < n and (r := self.rank.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
        return [p for p in parts if p is not None]

    def _word(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.id_of[p] for p in self.merge(word.encode()))
        if len(word) <= LONG:
            if len(self.memo) >= self.memo_size:
                self.memo.clear()
            self.memo[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        memo = self.memo.get
        for piece in self.cuts.split(text) if self.cuts else (text,):
            if (special := self.special.get(piece)) is not None:
                out.append(special)
                continue
            for w in self.words.findall(piece):
                out += memo(w) or self._word(w)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of these ids, special tokens included; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[int, ByteBpe] = {}


def _tokenizer(spec) -> ByteBpe:
    """One tokenizer per Python worker, which outlives its tasks."""
    if spec.id not in _loaded:
        _loaded.clear()
        _loaded[spec.id] = ByteBpe(spec.value)
    return _loaded[spec.id]


class _Spec:
    """A vocabulary file's text, sent to each executor once."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as f:
            self._sent = spark.sparkContext.broadcast(f.read())
        self.id = path

    @property
    def value(self) -> str:
        return self._sent.value


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs plus __ids: array<int>, the ids of the whole text. path: a byte-level tokenizer.json."""
    spec = _Spec(docs.sparkSession, path)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = _tokenizer(spec)
        for b in batches:
            yield b.map(lambda x: t.encode(x or ""))

    return docs.withColumn("__ids", ids(F.coalesce(F.col("text"), F.lit(""))))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded plus __decoded, the text of __ids."""
    spec = _Spec(encoded.sparkSession, path)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = _tokenizer(spec)
        for b in batches:
            yield b.map(lambda x: t.decode(list(x) if x is not None else []))

    return encoded.withColumn("__decoded", text("__ids"))


def digest(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding in one pass, ids never leaving the task."""
    spec = _Spec(docs.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = _tokenizer(spec)
        for b in batches:
            rows = []
            for x in b["text"]:
                ids = t.encode(x or "")
                rows.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids).encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", b["doc_id"].astype("Int64").array)
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
