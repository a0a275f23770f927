"""BPE encoding and decoding: speculate and verify.

For each word (a piece of the vocabulary's own pre-tokenizer): a greedy longest match
proposes tokens; all adjacent pairs of a batch of words are tested at once, where a pair
(a, b) is compatible if merging their joined bytes gives a, b again; a word of which every
pair is compatible is encoded as proposed (a sequence of tokens is the canonical encoding
if and only if each adjacent pair is), and only the others are merged exactly, in rank order.

Scale: one narrow pass, no shuffle; each distinct unit of a slice is encoded once, and a
worker remembers a bounded number of units and pairs. A long word is merged in n log n.

Defined cases: null is the empty text (no ids, digests of nothing); repeated rows are
encoded row by row; an empty table gives an empty result; other columns are ignored.
Long texts are encoded whole, cut into slices of bounded bytes between units; a unit is never
cut, so one word of any length is held at once.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import units
from .common import Workspace, name

#: The pre-tokenizer of byte-level BPE; below U+0250 the regex library and the tokenizers library agree on it (tested).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PLAIN = regex.compile(r"[\x00-ɏ]*+")
PAIRS = 2_000_000
SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself if printable, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.vocab = {raw(t): i for t, i in made["model"]["vocab"].items()}
        self.raw = {i: t for t, i in self.vocab.items()}
        self.letters = letters
        self.specials = {x["content"].encode(): x["id"] for x in made["added_tokens"]}
        self.raw |= {i: t for t, i in self.specials.items()}
        ids = made["model"]["vocab"]
        merges = (m.split(" ") if isinstance(m, str) else m for m in made["model"]["merges"])
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(merges)}
        self.reach: dict[bytes, int] = {}  # the longest token that begins with two bytes
        for t in self.vocab:
            self.reach[t[:2]] = max(self.reach.get(t[:2], 1), len(t))
        self.known = units.Memory()
        self.special = regex.compile(b"|".join(map(regex.escape, self.specials))) if self.specials else None
        self.pairs: dict[int, bool] = {}
        # Tables of each token's bytes and decimal digits, for gathering.
        n = max(self.raw) + 1
        self.bytes = self._table([self.raw.get(i, b"") for i in range(n)])
        self.digits = self._table([b"%d," % i for i in range(n)])

    @staticmethod
    def _table(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lens = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lens) - lens, lens

    def greedy(self, word: bytes) -> list[int]:
        found, at, n, vocab, reach = [], 0, len(word), self.vocab, self.reach
        while at < n:
            for to in range(min(n, at + reach.get(word[at : at + 2], 1)), at, -1):
                if (i := vocab.get(word[at:to])) is not None:
                    found.append(i)
                    at = to
                    break
        return found

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: the pair of lowest rank first, the leftmost of equal ranks."""
        ids = [self.vocab[word[i : i + 1]] for i in range(len(word))]
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := merges.get((made, ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, made, ids[after[i]], m[1]))
            if (k := before[i]) >= 0 and (m := merges.get((ids[k], made))):
                heapq.heappush(heap, (m[0], k, ids[k], made, m[1]))
        return [i for i in ids if i >= 0]

    def verified(self, keys: np.ndarray) -> np.ndarray:
        """Which keys (first << 32 | second, or a token alone | 2^32 - 1) are compatible."""
        own, back = np.unique(keys, return_inverse=True)
        known = self.pairs
        if len(known) > PAIRS:
            known.clear()
        said = np.empty(len(own), bool)
        for i, key in enumerate(own.tolist()):
            if (ok := known.get(key)) is None:
                tokens = [t for t in (key >> 32, key & 0xFFFFFFFF) if t != 0xFFFFFFFF]
                known[key] = ok = self.merged(b"".join(self.raw[t] for t in tokens)) == tokens
            said[i] = ok
        return said[back]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        found = [self.greedy(w) for w in words]
        lens = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for x in found for i in x), np.int64, int(lens.sum()))
        if not len(flat):
            return found
        word = np.repeat(np.arange(len(found)), lens)
        inner = np.flatnonzero(word[1:] == word[:-1])
        alone = np.cumsum(lens)[lens == 1] - 1
        keys = np.concatenate((flat[inner] << 32 | flat[inner + 1], flat[alone] << 32 | 0xFFFFFFFF))
        wrong = np.concatenate((word[inner], word[alone]))[~self.verified(keys)]
        for i in np.unique(wrong).tolist():
            found[i] = self.merged(words[i])
        return found

    def words(self, unit: bytes) -> list[bytes]:
        text = unit.decode()
        if PLAIN.fullmatch(text):
            return [w.encode() for w in WORDS.findall(text)]
        return [bytes(self.letters[c] for c in w) for w, _ in self.split(text)]

    def encode_units(self, new: list[bytes]) -> list[list[int]]:
        """A unit holds no part of a special token but whole ones; those are ids of their own."""
        self.known.turn()
        plan: list[list[bytes | int]] = []  # of each unit: words, and ids of special tokens
        for unit in new:
            if self.special is None or b"<|" not in unit:
                plan.append(self.words(unit))
                continue
            parts, at = [], 0
            for m in self.special.finditer(unit):
                parts += [*self.words(unit[at : m.start()]), self.specials[m[0]]]
                at = m.end()
            plan.append(parts + self.words(unit[at:]))
        words = list({w for parts in plan for w in parts if not isinstance(w, int)})
        ids = dict(zip(words, self.known.look(words), strict=True))
        fresh = [w for w, x in ids.items() if x is None]
        for w, x in zip(fresh, self.encode_words(fresh), strict=True):
            ids[w] = x
            self.known.keep(w, x)
        ids |= {i: [i] for i in self.specials.values()}
        return [ids[p[0]] if len(p) == 1 else [i for w in p for i in ids[w]] for p in plan]

    def text(self, ids: np.ndarray) -> np.ndarray:
        return units.ragged(*self.bytes, ids)


_models: dict[str, tuple[Bpe, units.Codec]] = {}


def model(path: str) -> tuple[Bpe, units.Codec]:
    if path not in _models:
        made = Bpe(path)
        _models[path] = made, units.Codec(made.encode_units, attach=True)
    return _models[path]


#: White space beyond that of ASCII, in UTF-8.
ODD = rb"(?:[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)"
WHITE_NEAR_ODD = regex.compile(rb"[\t-\r ]" + ODD + rb"|" + ODD + rb"[\t-\r ]")


def encode_slice(path: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts and their offsets. A text where other white space meets that of ASCII, or that holds a special token, isn't cut into units."""
    made, codec = model(path)
    ids, cuts = codec.ids(data, offsets)
    whole = data.tobytes()
    odd = {int(np.searchsorted(offsets, m.start(), "right")) - 1 for m in WHITE_NEAR_ODD.finditer(whole)}
    if made.special:
        odd |= {int(np.searchsorted(offsets, m.start(), "right")) - 1 for m in made.special.finditer(whole)}
    if odd:
        parts = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for k in odd:
            parts[k] = np.array(made.encode_units([whole[offsets[k] : offsets[k + 1]]])[0], np.uint32)
        ids, cuts = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
    return ids, cuts


def encode(df: DataFrame, path: str, text: str = "text", id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """The id column, then SCHEMA: ids as decimals joined by commas, and the text decoded from them, both as SHA-256; with_ids adds the ids."""
    Workspace(df.sparkSession)
    given = df.select(name(id).alias("id"), name(text).cast("binary").alias("data"))

    def run(batches):
        made, _ = model(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for at, data, offsets in units.slices(batch.column("data")):
                ids, cuts = encode_slice(path, data, offsets)
                written, decoded = units.ragged(*made.digits, ids), made.text(ids)
                a, b = (np.concatenate(([0], np.cumsum(t[2][ids])))[cuts].tolist() for t in (made.digits, made.bytes))
                n = len(offsets) - 1
                lossy = lambda x: bytes(x).decode(errors="replace").encode()
                columns = [batch.column("id").slice(at, n), pa.array(np.diff(cuts), pa.int64())]
                columns.append(pa.array([sha(written[a[k] : max(a[k], a[k + 1] - 1)]) for k in range(n)], pa.string()))
                columns.append(pa.array([sha(lossy(decoded[b[k] : b[k + 1]])) for k in range(n)], pa.string()))
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(run, f"id {kind}, {SCHEMA}" + ", ids array<int>" * with_ids)


def decode(df: DataFrame, path: str, ids: str = "ids", id: str = "doc_id") -> DataFrame:
    """The id column and `text`, decoded from a column of ids (null: empty). Bytes that are no UTF-8 become U+FFFD."""
    given = df.select(name(id).alias("id"), name(ids).cast("array<int>").alias("ids"))

    def run(batches):
        made, _ = model(path)
        for batch in batches:
            texts = [made.text(np.array(x.as_py() or [], np.int64)).tobytes().decode(errors="replace") for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    return given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, text string")
