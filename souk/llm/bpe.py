"""Byte-pair encoding by forced-boundary splitting, and decoding.

A byte pair that occurs inside no token of the vocabulary can never be joined by a merge:
between its bytes a cut is certain. Such cuts split a text into short fragments that are
encoded independently of each other and concatenated; equal fragments are encoded once and
kept in a bounded cache.

Texts are first cut at special tokens, then before every space whose left neighbour forces
the cut. This also holds for the pattern that splits a text before merging: it never joins a
space to what stands before it, except in a run of white space, where it parts the last
character from the rest; the parts of such a run give the same ids, as no token joins them
over a forced cut. A fragment is then split by the pattern, its parts at all forced
boundaries inside, and each piece merged by rank.

Works for byte-level vocabularies with the usual pattern and no normalizer, and says so
for others. Cases: null text = empty text = no ids; texts of any length, as pieces are
short and long ones are merged with a heap; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from souk.llm.common import Memo, map_texts

# Fixed value: the pattern that splits a text before the merges of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: printable bytes are
    themselves, the others take the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder of one vocabulary file of the tokenizers library."""

    def __init__(self, spec: bytes):
        file = json.loads(spec)
        before, model = file["pre_tokenizer"] or {}, file["model"]
        usual = (before.get("type") == "ByteLevel" and before.get("use_regex", True)
                 and not before.get("add_prefix_space") and file["normalizer"] is None
                 and model["type"] == "BPE" and not model.get("ignore_merges") and not model.get("dropout"))
        if not usual:
            raise ValueError("a byte-level BPE vocabulary without normalizer is needed")
        letters = byte_letters()
        to_bytes = lambda token: bytes(letters[c] for c in token)
        ids = {to_bytes(t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        for t in file["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError(f"added token {t['content']!r} with a side condition")
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}  # ids -> (rank, id of the two)
        for rank, pair in enumerate(model["merges"]):
            a, b = (to_bytes(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges[ids[a], ids[b]] = rank, ids[a + b]
        self.single = [ids[bytes([b])] for b in range(256)]
        self.tokens = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        # Pairs inside a token; all others force a boundary.
        inside = {t[i:i + 2] for t in ids for i in range(len(t) - 1)}
        left_of_space = {p[:1] for p in inside if p[1:] == b" "}
        self.glued = [x + b" " for x in left_of_space]
        held = b"".join(re.escape(x) for x in sorted(left_of_space))
        self.cut_space = re.compile(b"(?<![" + held + b"]) ") if held else re.compile(b" ")
        self.inside = inside
        self.cut_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.special_bytes = [s.encode() for s in self.special]
        self.split = regex.compile(PATTERN).findall
        self.ids = ids
        # The two parts that merge into a token; a token that no merge of its own bytes
        # gives back never stands in an encoding.
        self.parts = {whole: pair for pair, (_, whole) in self.merges.items()}
        self.rank = {whole: rank for _, (rank, whole) in self.merges.items()}
        # What tokens begin with, from four bytes on.
        self.begins = {t[:k] for t in ids for k in range(4, len(t) + 1)}
        self.fits = Memo(self._fits, lambda key: True)
        self.pieces = Memo(self._piece, lambda key: len(key) <= 40)
        self.after_space = Memo(lambda w: self._fragment(b" " + w), lambda key: len(key) <= 40)

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether two tokens may stand side by side: no merge over their border comes
        before the merges that made them. Both are taken apart from the last merge on, and
        the two that touch the border are looked up at every step."""
        a, b = pair
        rank, parts, merges = self.rank, self.parts, self.merges
        none = 1 << 60
        # (rank from which on a merge over the border comes too late, whether a tie is too)
        limit = none
        while True:
            found = merges.get((a, b))
            if found is not None and found[0] < limit:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # Undo the later merge; among equal ranks the left one came first.
            if ra > rb:
                limit, a = ra, parts[a][1]
            else:
                limit, b = rb + 1, parts[b][0]

    def _piece(self, piece: bytes) -> bytes:
        """Ids (little-endian, 32 bits) of a piece: the one row of tokens of which all
        neighbours fit. Longest tokens are tried first; of a prefix that is reached there
        is one encoding only, so a place that fails once is not tried again."""
        n, get, fits, begins = len(piece), self.ids.get, self.fits, self.begins
        if n > 64:
            return array("I", self._merge_long([self.single[b] for b in piece])).tobytes()
        out: list[int] = []
        ends: list[int] = []
        dead: set[int] = set()
        at, size = 0, -1
        while at < n:
            if size < 0:  # a new place: no token here is longer
                size = min(3, n - at)
                while at + size < n and piece[at:at + size + 1] in begins:
                    size += 1
            while size:
                t = get(piece[at:at + size])
                if t is not None and (not out or fits[out[-1], t]) and at + size not in dead:
                    break
                size -= 1
            if size:
                out.append(t)
                at += size
                ends.append(size)
                size = -1
            else:
                dead.add(at)
                out.pop()
                size = ends.pop()
                at -= size
                size -= 1
        return array("I", out).tobytes()

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges, lowest rank first and leftmost among equals, with a heap."""
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        get = self.merges.get
        heap = [(f[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (f := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        gone = -1
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = get((a, b))[1], gone
            k = after[i] = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
                if f := get((ids[i], ids[k])):
                    heapq.heappush(heap, (f[0], i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (f := get((ids[h], ids[i]))):
                heapq.heappush(heap, (f[0], h, ids[h], ids[i]))
        return [x for x in ids if x != gone]

    def _fragment(self, fragment: bytes) -> bytes:
        spaced = fragment[:1] == b" "
        body = fragment[1:] if spaced else fragment
        text = body.decode()
        if text.isalpha():  # letters: one part for the pattern
            return self._part(fragment)
        if spaced and text[-1:] in (".", ",") and text[:-1].isalpha():  # as the pattern does
            return self.after_space[body[:-1]] + self.pieces[body[-1:]]
        return b"".join(self._part(p.encode()) for p in self.split(fragment.decode()))

    def _part(self, part: bytes) -> bytes:
        """A part of the pattern, cut at the forced boundaries inside it. Parts of up to 16
        bytes are merged faster than searched for cuts."""
        if len(part) <= 16:
            return self._piece(part)
        out, inside, start = [], self.inside, 0
        for i in range(1, len(part)):
            if part[i - 1:i + 1] not in inside:
                out.append(self.pieces[part[start:i]])
                start = i
        out.append(self.pieces[part[start:]])
        return b"".join(out)

    def _plain(self, text: bytes) -> bytes:
        """Ids of a text without special tokens."""
        if not text:
            return b""
        if any(g in text for g in self.glued):
            first, *rest = self.cut_space.split(text)
        else:
            first, *rest = text.split(b" ")
        return self._fragment(first) + b"".join(map(self.after_space.__getitem__, rest))

    def encode(self, text: bytes) -> bytes:
        """Ids of a text in UTF-8, as unsigned little-endian 32-bit integers."""
        if not any(s in text for s in self.special_bytes):
            return self._plain(text)
        return b"".join(array("I", [self.special[p]]).tobytes() if p in self.special else self._plain(p.encode())
                        for p in self.cut_special.split(text.decode()))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I"))).decode(errors="replace")


class Whole(Bpe):
    """Encodes a text as a whole with the tiktoken library, which takes less time than splitting
    it where spellings are mostly new. Gives the same ids where ``whole_fits`` says so."""

    def __init__(self, spec: bytes):
        super().__init__(spec)
        ranks = {self.tokens[i]: i for i in self.ids.values()}
        self.coder = tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: bytes) -> bytes:
        return array("I", self.coder.encode_ordinary(text.decode())).tobytes()


@lru_cache(4)
def whole_fits(spec: bytes) -> bool:
    """Whether ids rise with the ranks of the merges, and each token is what its own bytes merge
    to. Then a row of tokens inside the bytes of a token is a state of these merges, so two
    neighbours that make up a token are the ones that its merge names, and merging by the
    ids of joined bytes is merging by rank."""
    bpe = Bpe(spec)
    made = [whole for _, whole in sorted(bpe.merges.values())]
    rising = all(a < b for a, b in zip(made, made[1:])) and (not made or max(bpe.single) < made[0])
    return rising and all(bpe._merge_long([bpe.single[b] for b in t]) == [i] for t, i in bpe.ids.items())


@lru_cache(2)
def loaded_whole(spec: bytes) -> Whole:
    return Whole(spec)


@lru_cache(2)
def loaded(spec: bytes) -> Bpe:
    """One encoder for each worker process and vocabulary; its cache lives as long."""
    return Bpe(spec)


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary file (a few MB, whatever the input) as a broadcast variable: the
    driver reads it, executors need no such file."""
    with open(path, "rb") as f:
        spec = f.read()
    if len(spec) > 64 << 20:
        raise ValueError("a vocabulary file of over 64 MB")
    return spark.sparkContext.broadcast(spec)


def encode_documents(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary, decoded string): the ids of every text as little-endian unsigned
    32-bit integers, and the text decoded from them. A map over the rows, without a shuffle."""
    return _mapped(docs, vocab, id_col, text_col, "ids binary, decoded string", _ids_and_text)


def _ids_and_text(bpe: Bpe, texts: list[bytes]) -> list[pa.Array]:
    ids = [bpe.encode(t) for t in texts]
    return [pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())]


def digest_documents(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_documents, with digests of ids and decoded text instead of these."""
    return _mapped(docs, vocab, id_col, text_col,
                   "n_tokens bigint, ids_sha256 string, decoded_sha256 string", _digests)


def _digests(bpe: Bpe, texts: list[bytes]) -> list[pa.Array]:
    ids = [bpe.encode(t) for t in texts]
    return [pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([sha256(x).hexdigest() for x in ids], pa.string()),
            pa.array([sha256(bpe.decode(x).encode()).hexdigest() for x in ids], pa.string())]


def _mapped(docs: DataFrame, vocab: str, id_col: str, text_col: str, added: str, make) -> DataFrame:
    spec = vocabulary(docs.sparkSession, vocab)
    return map_texts(docs, text_col, {id_col: "doc_id"}, added, lambda texts: make(loaded(spec.value), texts))
