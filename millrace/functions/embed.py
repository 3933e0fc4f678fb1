"""Embedders: an interface, feature hashing, and vector functions."""

import json
import time
from collections.abc import Callable, Iterator, Sequence
from itertools import islice
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: 64-bit FNV-1a.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


class Embedder(Protocol):
    """Turns texts into vectors of one length."""

    name: str
    dim: int

    def embed(self, texts: Sequence[str], query: bool = False) -> list[list[float]]: ...


def fnv1a(text: str) -> int:
    h = FNV_OFFSET
    for b in text.encode():
        h = (h ^ b) * FNV_PRIME & (1 << 64) - 1
    return h


def words(text: str) -> list[str]:
    """Lower-cased runs of letters and decimal digits."""
    import regex

    return regex.findall(r"[\p{L}\p{Nd}]+", text.lower())


def fnv1a_many(features: list[bytes], longest: int = 64) -> np.ndarray:
    """The hashes of many features, a byte place at a time; those over ``longest`` bytes one by one."""
    sizes = np.array([len(f) for f in features], np.int64)
    out = np.full(len(features), FNV_OFFSET, np.uint64)
    short = np.flatnonzero(sizes <= longest)
    short = short[np.argsort(-sizes[short], kind="stable")]
    width = int(sizes[short[0]]) if len(short) else 0
    table = np.frombuffer(b"".join(features[i].ljust(width, b"\0") for i in short), np.uint8).reshape(len(short), width)
    h, prime = out[short], np.uint64(FNV_PRIME)
    for j in range(width):
        n = int(np.searchsorted(-sizes[short], -j, side="left"))  # those longer than j come first
        h[:n] = (h[:n] ^ table[:n, j]) * prime
    out[short] = h
    for i in np.flatnonzero(sizes > longest):
        out[i] = fnv1a(features[i].decode())
    return out


#: Features whose hashes an embedder remembers.
REMEMBERED = 500_000


class HashEmbedder:
    """Feature hashing of words (weight 1) and word pairs (0.5), signed by the hash's top bit, of unit length.

    A text without words is the first unit vector. Hashes of features are remembered, up to ``REMEMBERED``.
    """

    def __init__(self, dim: int):
        self.dim, self.name = dim, f"hash-{dim}"
        self.numbers: dict[str, int] = {}
        self.hashes = np.zeros(0, np.uint64)

    def _numbered(self, features: list[str]) -> list[int]:
        return [self.numbers.setdefault(f, len(self.numbers)) for f in features]

    def embed(self, texts: Sequence[str], query: bool = False) -> list[list[float]]:
        each, weights = [], []
        if len(self.numbers) > REMEMBERED:
            self.numbers, self.hashes = {}, self.hashes[:0]
        for t in texts:
            found = words(t or "")
            pairs = list(map(" ".join, zip(found, found[1:])))
            each.append(np.array(self._numbered(found) + self._numbered(pairs), np.int64))
            weights.append(np.repeat([1.0, 0.5], [len(found), len(pairs)]))
        fresh = list(islice(self.numbers, len(self.hashes), None))
        hashes = self.hashes = np.concatenate((self.hashes, fnv1a_many([f.encode() for f in fresh])))
        slots = (hashes % np.uint64(self.dim)).astype(np.int64)
        signs = np.where(hashes >> np.uint64(63), -1.0, 1.0)
        out = []
        for at, weight in zip(each, weights, strict=True):
            v = np.bincount(slots[at], weight * signs[at], self.dim)
            if not (size := np.linalg.norm(v)):
                v[0] = size = 1.0
            out.append((v / size).astype(np.float32).tolist())
        return out

    def one(self, text: str) -> np.ndarray:
        return np.array(self.embed([text])[0], np.float32)


class HostedEmbedder:
    """Asks a service for vectors, ``chunk`` texts at a time.

    ``transport`` posts a JSON body and gives status and body of the answer, or raises OSError; the service answers with
    ``data``, a list of ``index`` and ``embedding``. Busy and failing services (429, 5xx, no connection) are asked again, up to
    ``attempts`` times in all, each time half a second later; other errors and vectors of another length raise.
    """

    def __init__(self, model: str, dim: int, transport: Callable[[bytes], tuple[int, bytes]], extra: Callable[[bool], dict] = lambda query: {}, chunk: int = 64, attempts: int = 3, sleep: Callable[[float], None] = time.sleep):
        self.model, self.dim, self.name = model, dim, model
        self.transport, self.extra, self.chunk, self.attempts, self.sleep = transport, extra, chunk, attempts, sleep

    def embed(self, texts: Sequence[str], query: bool = False) -> list[list[float]]:
        texts = list(texts)
        return [v for at in range(0, len(texts), self.chunk) for v in self._asked(texts[at : at + self.chunk], query)]

    def _asked(self, texts: list[str], query: bool) -> list[list[float]]:
        body = json.dumps({"model": self.model, "input": texts} | self.extra(query)).encode()
        why = ""
        for attempt in range(self.attempts):
            if attempt:
                self.sleep(0.5 * attempt)
            try:
                status, answer = self.transport(body)
            except OSError as e:
                why = str(e)
                continue
            if status == 200:
                return self._placed(json.loads(answer)["data"], len(texts))
            why = f"status {status}: {cut_bytes(answer)}"
            if status != 429 and status < 500:
                break
        raise RuntimeError(f"{self.name}: {why}")

    def _placed(self, data: list[dict], n: int) -> list[list[float]]:
        if len(data) != n:
            raise RuntimeError(f"{self.name}: asked for {n} embeddings, got {len(data)}")
        out: list[list[float] | None] = [None] * n
        for d in data:
            if not 0 <= d["index"] < n:
                raise RuntimeError(f"{self.name}: index {d['index']} is out of range")
            if len(d["embedding"]) != self.dim:
                raise RuntimeError(f"{self.name}: {len(d['embedding'])} dimensions instead of {self.dim}")
            out[d["index"]] = [float(x) for x in d["embedding"]]
        if None in out:
            raise RuntimeError(f"{self.name}: an index is given twice")
        return out


def cut_bytes(raw: bytes, most: int = 300) -> str:
    """The beginning of an answer, for messages."""
    return raw[:most].decode(errors="replace") + ("..." if len(raw) > most else "")


def http_post(url: str, key: str, timeout: float = 30.0) -> Callable[[bytes], tuple[int, bytes]]:
    """A transport over HTTP with a bearer key."""
    def post(body: bytes) -> tuple[int, bytes]:
        from urllib import error, request

        asked = request.Request(url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
        try:
            with request.urlopen(asked, timeout=timeout) as r:
                return r.status, r.read()
        except error.HTTPError as e:
            return e.code, e.read()

    return post


def make_embedder(provider: str, dim: int, model: str = "", url: str = "", key: str = "", transport=None) -> Embedder | None:
    """``none``: no vectors; ``hash``; ``hosted``: a service at ``url``, which needs a key."""
    if provider in ("", "none"):
        return None
    if provider == "hash":
        return HashEmbedder(dim)
    if provider != "hosted":
        raise ValueError(f"unknown embedder {provider!r}: none, hash or hosted")
    if not key:
        raise ValueError("a hosted embedder needs a key")
    return HostedEmbedder(model, dim, transport or http_post(url, key), lambda query: {"dimensions": dim})


#: Texts embedded at a time.
CHUNK = 512


def embedder_udf(make: Callable[[], Embedder]):
    """A vectorized UDF from text to array<float>; ``make`` runs once a task."""

    @pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = make()
        for texts in batches:
            held = texts.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(held), CHUNK) for v in embedder.embed(held[i : i + CHUNK])], index=texts.index, dtype=object)

    return run


def hash_embed(text: Column, dim: int) -> Column:
    return embedder_udf(lambda: HashEmbedder(dim))(text)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = norm(a) * norm(b)
    return F.when(size > 0, dot / size)


def unit(v: Column) -> Column:
    """Scaled to length one; a zero vector becomes the first unit vector."""
    n = norm(v)
    first = F.transform(v, lambda x, i: F.when(i == 0, 1.0).otherwise(0.0))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(first)


def literal(vector: Sequence[float]) -> str:
    """``[0.5,-1,0.25]``: shortest text that gives the 32-bit value back."""
    def short(x: float) -> str:
        s = np.format_float_positional(np.float32(x), unique=True, trim="-")
        return "0" if s in ("-0", "0") else s

    return "[" + ",".join(map(short, vector)) + "]"


def check_dim(stored: int, embedder: Embedder) -> None:
    if stored != embedder.dim:
        raise ValueError(f"stored vectors have {stored} dimensions, {embedder.name} has {embedder.dim}")
