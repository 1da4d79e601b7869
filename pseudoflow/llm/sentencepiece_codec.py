"""SentencePiece encoding and decoding with a streaming dynamic programme over piece boundaries.

The given model is of the BPE kind, for which the path of the best sum of scores is not the right
segmentation.  So the survivor at each boundary is chosen by the model's own rule: the last piece of a
prefix is the one piece whose pair with the survivor before it is left as it is by the merges (an encoding
is valid if and only if each adjacent pair is).  Everything else is a streaming Viterbi search: a survivor
looks back by the longest piece at most, and ids are committed as soon as all survivors of that window go
back to one boundary, so memory doesn't grow with the text.  All survivors meet before each space, because
no piece holds a space after another character; the ids of such units are kept in a bounded cache.

Defined cases: null and empty texts have no ids; U+2581 counts as a space, as in the library; characters
without a piece become byte pieces; repeated rows encode alike; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from array import array
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from pseudoflow.llm.common import text_or_empty

SPACE = "▁"
CACHE, LONG_UNIT = 300_000, 64


class Cache(dict):
    """The younger generation is the dict itself; when it is full it becomes the older one, from which what is asked for again comes back."""

    def __init__(self) -> None:
        self.old: dict = {}

    def again(self, key):
        """What ``get`` didn't find, if the older generation has it."""
        got = self.old.get(key)
        if got is not None:
            self.keep(key, got)
        return got

    def keep(self, key, value) -> None:
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[key] = value


class Codec:
    def __init__(self, path: str | None = None):
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        n = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        of_byte = {i: b for b, i in self.byte.items()}
        self.raw = [bytes([of_byte[i]]) if i in of_byte else p.replace(SPACE, " ").encode() for i, p in enumerate(self.piece)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {self.piece[i]: i for i in plain}
        self.score = {self.piece[i]: sp.get_score(i) for i in plain}
        self.longest = max(map(len, self.id))
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece holds a space after another character")
        self.runs = max((len(p) for p in self.id if not p.strip(SPACE)), default=1)  # longest run of spaces
        # characters side by side in a piece, and the lengths of the pieces that end in two characters (longest first)
        self.bonds = {p[k : k + 2] for p in self.id for k in range(len(p) - 1) if p[k] in self.id and p[k + 1] in self.id}
        ends: dict[str, set[int]] = {}
        for p in self.id:
            if len(p) > 1:
                ends.setdefault(p[-2:], set()).add(len(p))
        self.lengths = {e: (*sorted(n, reverse=True), 1) for e, n in ends.items()}
        self.units, self.parts, self.pairs = Cache(), Cache(), Cache()
        self.whole: dict[int, bool] = {}

    def merged(self, s: str) -> list[str]:
        """The model's merges on a short string: best score first, then leftmost."""
        parts = list(s)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def pair_stays(self, a: int, b: int) -> bool:
        key = a << 32 | b
        got = self.pairs.get(key)
        if got is None:
            got = self.pairs.again(key)
        if got is None:
            p, q = self.piece[a], self.piece[b]
            got = self.merged(p + q) == [p, q]
            self.pairs.keep(key, got)
        return got

    def stays(self, a: int) -> bool:
        if a not in self.whole:
            self.whole[a] = self.merged(self.piece[a]) == [self.piece[a]]
        return self.whole[a]

    def search(self, s: str) -> Iterator[int]:
        """Ids of a string whose characters all have pieces; holds a window of boundaries."""
        base, last = 0, [-1]  # last[k]: the piece that ends at boundary base + k
        get, lengths, one = self.id.get, self.lengths.get, (1,)
        for i in range(1, len(s) + 1):
            for n in lengths(s[i - 2 : i], one) if i > 1 else one:
                piece = get(s[i - n : i]) if i - n >= base else None
                if piece is None:
                    continue
                before = last[i - n - base]
                if self.pair_stays(before, piece) if before >= 0 else self.stays(piece):
                    last.append(piece)
                    break
            else:
                last.append(-2)  # no valid encoding ends here
            if len(last) > 4 * self.longest:
                # back from every boundary that a later piece can start at, until one is left
                alive = {k for k in range(len(last) - self.longest, len(last)) if last[k] >= 0}
                while len(alive) > 1:
                    k = max(alive)
                    alive.discard(k)
                    alive.add(k - len(self.piece[last[k]]))
                meet = alive.pop()
                if meet > 0:
                    yield from self.path(last, meet)
                    base, last = base + meet, last[meet:]
        yield from self.path(last, len(last) - 1)

    def path(self, last: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(last[at])
            at -= len(self.piece[last[at]])
        return out[::-1]

    def part(self, s: str) -> bytes:
        """Characters that are side by side in pieces, each with the next."""
        got = self.parts.get(s)
        if got is None:
            got = self.parts.again(s)
        if got is None:
            if len(s) == 1 and s not in self.id:  # nothing merges with it
                got = array("I", [self.byte[b] for b in s.encode()]).tobytes()
            else:
                got = array("I", self.search(s)).tobytes()
            if len(s) <= LONG_UNIT:
                self.parts.keep(s, got)
        return got

    def unit(self, word: str) -> bytes:
        """A space and what follows up to the next one."""
        got = self.units.again(word)
        if got is None:
            s, start, out, bonds = SPACE + word, 0, [], self.bonds
            for k in range(1, len(s)):
                if s[k - 1 : k + 1] not in bonds:
                    out.append(self.part(s[start:k]))
                    start = k
            out.append(self.part(s[start:]))
            got = b"".join(out)
            if len(word) <= LONG_UNIT:
                self.units.keep(word, got)
        return got

    def spaces(self, n: int) -> bytes:
        """A run of spaces: its merges come last, and grow from the left."""
        full, rest = divmod(n, self.runs)
        sizes = [self.runs] * full + [rest] * (rest > 0)
        return array("I", [self.id[SPACE * k] for k in sizes]).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as native unsigned 32-bit integers."""
        if not text:
            return b""
        words = text.replace(SPACE, " ").split(" ")
        found = list(map(self.units.get, words))
        if "" not in words:
            return b"".join([self.unit(w) if ids is None else ids for w, ids in zip(words, found)])
        out, run, alone = [], 0, array("I", [self.id[SPACE]]).tobytes()
        for w, ids in zip(words, found):
            if not w:
                run += 1
                continue
            ids = self.unit(w) if ids is None else ids
            if run and ids[:4] == alone:
                run, ids = run + 1, ids[4:]
            if run:
                out.append(self.spaces(run))
                run = 0
            out.append(ids)
        if run:
            out.append(self.spaces(run))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.raw.__getitem__, array("I", packed))).decode("utf-8", "replace")[1:]


@functools.lru_cache(maxsize=1)
def worker_codec(path: str | None) -> Codec:
    """One for all tasks of a worker process."""
    return Codec(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_crc32 (little-endian 32-bit ids), decoded_sha256, round_trip, and
    ids (array, null unless ``with_ids``)."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs, text_col).alias("text"))
    schema = "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean, ids array<int>"
    names = ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(model)
        for batch in batches:
            n, crc, sha, same, ids = [], [], [], [], []
            for x in batch.column(1):
                text = x.as_py()
                packed = codec.encode(text)
                back = codec.decode(packed)
                n.append(len(packed) // 4)
                crc.append(zlib.crc32(packed))
                sha.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == text.replace(SPACE, " "))
                ids.append(array("I", packed).tolist() if with_ids else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha), pa.array(same, pa.bool_()),
                 pa.array(ids, pa.list_(pa.int32()))], names=names)

    return rows.mapInArrow(run, schema)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """(doc_id, text) from arrays of ids; a null array gives an empty text."""
    rows = tokens.select(tokens[id_col].cast("long").alias("doc_id"), tokens[ids_col].cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(model)
        for batch in batches:
            texts = [codec.decode(array("I", x.as_py() or []).tobytes()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, "doc_id long, text string")
