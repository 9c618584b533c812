"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word the encoding ends in one uniquely determined token. It is found among
the vocabulary tokens that are a suffix of the prefix (an automaton over the vocabulary lists them
in one pass): token ``t`` is right if it is the whole prefix, or if the last token of the prefix
without ``t`` and ``t`` are compatible, that is, no merge across their border would have happened
before the merges inside them. Following the stored last tokens back from the end gives the ids.

Edge cases: a null text counts as empty; an empty text gives an empty list and an empty string;
words of any length take time in proportion to their length; repeated rows are encoded alike; an
empty table gives an empty table; input columns named like an output column are replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from minpair.llm.texts import chunks, fresh, with_columns

#: Entries of the per-worker caches; a full cache is emptied.
CACHED_WORDS, CACHED_PAIRS, CACHED_LENGTH = 250_000, 500_000, 48
NO_LIMIT = 1 << 60
#: Separators that ``str.split`` takes for white space, though the tokenizers' pattern does not.
ODD_SPACE = re.compile("[\x1c-\x1f]")
WHITE_SPACE = re.compile(r"[^\S\x1c-\x1f]+")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in character of each byte, by the public rule of byte-level BPE: printable
    Latin-1 characters stand for themselves, the other bytes for U+0100 onward in order."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_names(spec: str) -> dict[int, str]:
    j = json.loads(spec)
    return {i: t for t, i in j["model"]["vocab"].items()} | {a["id"]: a["content"] for a in j["added_tokens"]}


def join_tokens(ids: list[int], names: dict[int, str]) -> str:
    """Token strings joined by a space: the file names no decoder; special tokens stay."""
    return " ".join(map(names.__getitem__, ids))


class PrefixEncoder:
    """Encoder of one tokenizer file with word ends (``</w>``), for one Python worker.

    Symbols are the 256 bytes and, as 256 + byte, the last byte of a word.
    """

    def __init__(self, spec: str):
        j = json.loads(spec)
        model = j["model"]
        self.added = {a["content"]: a["id"] for a in j["added_tokens"]}
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in j["added_tokens"]):
            raise ValueError("added tokens must be plain strings")
        self.split_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.pieces = regex.compile(j["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        suffix, alphabet = model["end_of_word_suffix"], byte_alphabet()
        vocab = model["vocab"]

        def symbols(token: str) -> str:
            body = token.removesuffix(suffix)
            s = "".join(chr(alphabet[c]) for c in body)
            return s[:-1] + chr(256 + ord(s[-1])) if body != token else s

        size = max(vocab.values()) + 1
        self.rank, self.left, self.right = [-1] * size, [0] * size, [0] * size
        self.length = [0] * size
        self.pair_rank: dict[int, int] = {}
        for r, (a, b) in enumerate(model["merges"]):
            t, x, y = vocab[a + b], vocab[a], vocab[b]
            self.pair_rank[x << 20 | y] = r
            if self.rank[t] < 0:
                self.rank[t], self.left[t], self.right[t] = r, x, y
        self.automaton = ahocorasick.Automaton()
        reachable: dict[int, bool] = {}
        for token, t in sorted(vocab.items(), key=lambda x: self.rank[x[1]]):
            # A token takes part only if its own string is encoded as itself.
            x, y, r = self.left[t], self.right[t], self.rank[t]
            reachable[t] = r < 0 or (reachable[x] and reachable[y] and self.compatible(x, y, r))
            if reachable[t]:
                s = symbols(token)
                self.length[t] = len(s)
                self.automaton.add_word(s, (t, len(s)))
        self.automaton.make_automaton()
        self.checked: dict[int, bool] = {}
        self.known = _Cache(self.word)
        self.spaced = _Cache(lambda run: b"".join(map(self.known.__getitem__, self.pieces(self.normal(run)))))

    def compatible(self, a: int, b: int, limit: int = NO_LIMIT) -> bool:
        """Whether tokens ``a`` and ``b`` can stand side by side: going back in time along the
        border, no merge of the two border symbols came before the merge that ended either."""
        rank = self.rank
        while True:
            r = self.pair_rank.get(a << 20 | b)
            if r is not None and r < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra > rb:  # the left token was finished last
                limit, a = ra, self.right[a]
            elif rb >= 0:  # equal merges go from left to right, so the right one was last
                limit, b = rb + 1, self.left[b]
            else:
                return True

    def word(self, piece: str) -> bytes:
        """Ids of one pre-token, packed as little-endian 32-bit integers."""
        s = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        s = s[:-1] + chr(256 + ord(s[-1]))
        last = [-1] * (len(s) + 1)
        checked = self.checked
        for end, (t, n) in self.automaton.iter(s):
            end += 1
            if last[end] >= 0:
                continue
            if n == end:
                last[end] = t
                continue
            before = last[end - n]
            key = before << 20 | t
            ok = checked.get(key)
            if ok is None:
                ok = checked[key] = before >= 0 and self.compatible(before, t)
            if ok:
                last[end] = t
        if len(checked) > CACHED_PAIRS:
            checked.clear()
        out, at = [], len(s)
        while at:
            out.append(last[at])
            at -= self.length[last[at]]
        out.reverse()
        return array("I", out).tobytes()

    def normal(self, text: str) -> str:
        """NFC, then lower case letter by letter (no word-final form of sigma)."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers; strings of added tokens give their ids.

        Neither normalisation nor pre-tokens reach across white space, so runs between white space
        are encoded one by one and kept."""
        if self.split_added is None or not any(a in text for a in self.added):
            return self.plain(text)
        return b"".join(self.added[part].to_bytes(4, "little") if part in self.added
                        else self.plain(part) for part in self.split_added.split(text))

    def plain(self, text: str) -> bytes:
        runs = WHITE_SPACE.split(text) if ODD_SPACE.search(text) else text.split()
        return b"".join(map(self.spaced.__getitem__, runs))

    def forget(self) -> None:
        """Empty the caches, so that a worker between tasks holds the tables alone."""
        for cache in (self.known, self.spaced, self.checked):
            cache.clear()


class _Cache(dict):
    """String -> packed ids, filled on demand; long strings are not kept, a full cache is emptied."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        packed = self.make(key)
        if len(key) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[key] = packed
        return packed


_MADE: dict[tuple, object] = {}


def _made(make, spec: str):
    """``make(spec)``, kept for the life of the worker; another spec takes its place."""
    key = (make.__name__, hash(spec))
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = make(spec)
    return _MADE[key]


def read_spec(path: str, most_bytes: int = 16_000_000) -> str:
    """The tokenizer file as text, read once on the driver; its size is checked because every
    worker gets it."""
    with open(path, encoding="utf-8") as f:
        spec = f.read(most_bytes + 1)
    if len(spec) > most_bytes:
        raise ValueError(f"tokenizer file over {most_bytes} bytes")
    return spec


def _id_array(packed: list[bytes]) -> pa.Array:
    """Packed ids of each text as lists."""
    offsets = [0]
    for p in packed:
        offsets.append(offsets[-1] + len(p) // 4)
    values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(packed))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All input columns and ``ids`` (array of int). ``tokenizer``: path of the file on the driver."""
    spec = df.sparkSession.sparkContext.broadcast(read_spec(tokenizer))
    df = fresh(df, ids)
    keep = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _made(PrefixEncoder, spec.value)
        for batch, texts in chunks(batches, text):
            packed = [enc.encode(t) for t in texts]
            yield with_columns(batch, keep, **{ids: _id_array(packed)})
        enc.forget()

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def _lists(batches: Iterator[pa.RecordBatch], ids: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of the batches with their id lists; null lists come as empty."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield part, [x.values.to_numpy() if x.is_valid else np.empty(0, np.int32) for x in part.column(ids)]


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All input columns and ``decoded`` (string); null ids give an empty string."""
    spec = df.sparkSession.sparkContext.broadcast(read_spec(tokenizer))
    df = fresh(df, decoded)
    keep = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _made(token_names, spec.value)
        for part, lists in _lists(batches, ids):
            texts = [join_tokens(x.tolist(), names) for x in lists]
            yield with_columns(part, keep, **{decoded: pa.array(texts, pa.string())})

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(decoded, T.StringType())]))


def _coder(spec: str) -> tuple[PrefixEncoder, dict[int, str]]:
    return PrefixEncoder(spec), token_names(spec)


def digests(df: DataFrame, tokenizer: str, keep: list[str], text: str = "text", ids: str | None = None) -> DataFrame:
    """``keep`` columns, the ids under the name ``ids`` if one is given, the number of ids, and the
    SHA-256 of the ids (little-endian unsigned 32-bit) and of the text that these ids are decoded to.
    Texts are encoded, decoded and hashed in one pass, so ids travel only if they are asked for."""
    spec = df.sparkSession.sparkContext.broadcast(read_spec(tokenizer))
    id_type = [T.StructField(ids, T.ArrayType(T.IntegerType()))] if ids else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, names = _made(_coder, spec.value)
        for batch, texts in chunks(batches, text):
            packed = [enc.encode(t) for t in texts]
            lists = [np.frombuffer(p, "<u4") for p in packed]
            own = {ids: _id_array(packed)} if ids else {}
            yield with_columns(
                batch, keep, **own, n_tokens=pa.array([len(x) for x in lists], pa.int64()),
                ids_sha256=pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                decoded_sha256=pa.array([hashlib.sha256(join_tokens(x.tolist(), names).encode()).hexdigest() for x in lists], pa.string()))
        enc.forget()

    return df.mapInArrow(run, T.StructType([
        *(df.schema[c] for c in keep), *id_type, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType())]))
