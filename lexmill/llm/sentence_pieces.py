"""Operator 13, SentencePiece encoding and decoding: the merge-type prefix table.

The encoding of every prefix of a word by merges ends in exactly one token, and that token together with
the encoding of what stands before it is the whole encoding. So a table with the last token of each prefix
holds all of them: an automaton over the vocabulary gives the tokens that end at each place, and the one
that belongs there is the one that is *compatible* with the last token of the prefix before it, which means
that the two, merged from their characters, stay these two. Ids are then read backwards from the table. Time is linear in
the word for a vocabulary of bounded width, whatever the word's length, and the library is not asked for any text.

Two tokens are compatible if no merge that crosses their border comes earlier than the merges that made
both sides. This is tested by undoing, from the two tokens, the latest merge again and again and looking the
pair at the border up. Tokens that no merge gives are left out of the automaton. Tokens of equal score are runs of
one character (spaces), which merge last and always the leftmost pair first; their pairs are tested by doing so.

Characters outside the vocabulary become bytes and stop all merges. Texts are cut before each run of spaces,
around line feeds, and between a letter and a mark, where the model (checked when it is read) lets nothing merge. Ids of words met last are kept up
to CACHED_BYTES a worker process; other words are encoded again.

A null text counts as empty (begin and end id alone) and a null list of ids as none (an empty text). Repeated rows give
repeated results; an empty table gives none; other columns are ignored. A very long text is held whole, as one row.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "▁"
#: Words are cut before these, behind a letter, if the model allows.
MARKS = ".,;:!?"
#: Bytes that a worker process keeps of words and their ids, about; pairs whose compatibility is kept; rows at once.
CACHED_BYTES, CACHED_PAIRS, ROWS = 96 << 20, 1 << 20, 256
#: Bytes of two small objects of Python and their entry in a dictionary, besides their contents.
_OBJECTS = 190


class Pieces:
    """The vocabulary of a merge-type model with byte fallback, its automaton and its pairs."""

    def __init__(self, path: str):
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = library.get_piece_size()
        self.bos, self.eos, self.unknown = library.bos_id(), library.eos_id(), library.unk_id()
        self.byte = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = {*self.byte, *(k for k in range(n) if library.is_control(k) or library.is_unknown(k) or library.is_unused(k))}
        self.text = [library.id_to_piece(k) for k in range(n)]
        self.ids = {t: k for k, t in enumerate(self.text) if k not in special}
        self._check(library)
        self.size_of = list(map(len, self.text))
        # the order of merges: higher scores first, then the runs by their length; characters are there from the start
        longer = [k for k in self.ids.values() if len(self.text[k]) > 1]
        longer.sort(key=lambda k: (-library.get_score(k), len(self.text[k])))
        self.born = [0] * n
        for place, k in enumerate(longer):
            self.born[k] = place + 1
        self.halves: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        self.known_pairs: dict[int, bool] = {}
        for k in self.ids.values():
            if len(self.text[k]) == 1:
                self.automaton.add_word(self.text[k], (k, 1))
        for k in longer:
            if halves := self._halves(k):
                self.halves[k] = halves
                self.automaton.add_word(self.text[k], (k, len(self.text[k])))
        self.automaton.make_automaton()
        # what an id stands for: bytes of text; a byte's id gives that byte, a control id nothing
        self.raw = [t.replace(SPACE, " ").encode() for t in self.text]
        for b, k in enumerate(self.byte):
            self.raw[k] = bytes([b])
        for k in range(n):
            if library.is_control(k):
                self.raw[k] = b""
        self.raw[self.unknown] = " ⁇ ".encode()
        self.bytes_of = {k: b for b, k in enumerate(self.byte)}
        self.controls = {k for k in range(n) if library.is_control(k)}

    def _check(self, library: sentencepiece.SentencePieceProcessor) -> None:
        """Refuses models for which cuts or the order of merges would differ from what is built here."""
        tied: dict[float, list[str]] = {}
        for t, k in self.ids.items():
            if SPACE in t.lstrip(SPACE) or "\n" in t:
                raise ValueError(f"piece {t!r} crosses a cut")
            if any(c not in self.ids for c in t):
                raise ValueError(f"piece {t!r} has a character that is no piece")
            if len(t) > 1:
                tied.setdefault(library.get_score(k), []).append(t)
        # marks that no piece holds behind a letter are cut off there
        marks = "".join(m for m in MARKS if not any(re.search(rf"[^\W\d_]{re.escape(m)}", t) for t in self.ids))
        before_mark = rf"{SPACE}*[^\W\d_]+(?=[{re.escape(marks)}])|" if marks else ""
        self.cuts = re.compile(rf"{before_mark}{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.runs: dict[str, set[int]] = {}
        for score, same in tied.items():
            if len(same) > 1:
                if len({c for t in same for c in t}) > 1 or score > min(tied):
                    raise ValueError("pieces of equal score that are not runs of one character, or that do not merge last")
                self.runs[same[0][0]] = set(map(len, same))
        if min(self.byte) < 0 or not library.encode(" a", add_bos=True) or library.encode("", add_bos=True, add_eos=True) != [self.bos, self.eos]:
            raise ValueError("not a model with byte fallback, begin and end ids")

    def _halves(self, k: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives k, or none if its characters merge otherwise."""
        text, born = self.text[k], self.born[k]
        if text[0] in self.runs and set(text) == {text[0]}:
            left, *others = self._run(text[0], len(text), len(text))
            return (self.ids[text[:left]], self.ids[text[left:]]) if len(others) == 1 else None
        for cut in range(1, len(text)):
            left, right = self.ids.get(text[:cut]), self.ids.get(text[cut:])
            if left is not None and right is not None and all(self.born[x] < born and (x in self.halves or len(self.text[x]) == 1) for x in (left, right)) and self._stay(left, right, born):
                return left, right
        return None

    def _run(self, c: str, n: int, below: int) -> list[int]:
        """The lengths that n equal characters merge into, always the leftmost pair that gives a piece, of less than ``below`` characters."""
        out = [1] * n
        while at := next((k + 1 for k in range(len(out) - 1) if out[k] + out[k + 1] in self.runs[c] and out[k] + out[k + 1] < below), 0):
            out[at - 1 : at + 1] = [out[at - 1] + out[at]]
        return out

    def _stay(self, left: int, right: int, before: int) -> bool:
        """Whether no merge across the border of the two comes earlier than ``before`` and than what made the sides there."""
        born, halves, ids, text = self.born, self.halves, self.ids, self.text
        while True:
            joined = ids.get(text[left] + text[right])
            if joined is not None and born[joined] < before and joined in halves:
                return False
            a, b = born[left], born[right]
            if not a and not b:
                return True
            if a > b:  # undo the later merge; of equal ones the left one came first, so the right one is undone
                before, left = a, halves[left][1]
            else:  # a merge across the border of the same rank would have come first, as it is further left
                before, right = b + 1, halves[right][0]

    def compatible(self, left: int, right: int) -> bool:
        a, b = self.text[left], self.text[right]
        if a[0] in self.runs and set(a) == {a[0]} == set(b):
            fits = self._run(a[0], len(a) + len(b), 1 << 60) == [len(a), len(b)]
        else:
            fits = self._stay(left, right, 1 << 60)
        if len(self.known_pairs) >= CACHED_PAIRS:
            self.known_pairs.clear()
        self.known_pairs[left << 20 | right] = fits
        return fits

    def word(self, word: str) -> list[int]:
        """The ids of a stretch between cuts (spaces as SPACE)."""
        last, known, size_of = [0] * (len(word) + 1), self.known_pairs.get, self.size_of
        for end, (k, size) in self.automaton.iter(word):
            end += 1
            if not last[end]:
                before = last[end - size]  # 0: the start, or a character outside the vocabulary
                if before:
                    fits = known(before << 20 | k)
                    if fits is None:
                        fits = self.compatible(before, k)
                    if not fits:
                        continue
                last[end] = k
        out, at = [], len(word)
        while at:
            k = last[at]
            if k:
                out.append(k)
                at -= size_of[k]
            else:
                at -= 1
                out += [self.byte[b] for b in reversed(word[at].encode("utf-8", "surrogatepass"))]
        out.reverse()
        return out

    def joined(self, ids: list[int]) -> bytes:
        """What the ids decode to, as UTF-8; bytes that are no UTF-8 become U+FFFD one by one."""
        raw = self.raw
        whole = b"".join([raw[k] for k in ids])
        try:
            whole.decode()
            mixed = not self.controls.isdisjoint(ids[1:-1])  # such an id between two bytes keeps them apart
        except UnicodeDecodeError:
            mixed = True
        if mixed:
            whole = self._mended(ids)
        for k in ids:  # the space that encoding put before the text; a control id is passed over
            if k not in self.controls:
                return whole[1:] if self.text[k].startswith(SPACE) else whole
        return whole

    def _mended(self, ids: list[int]) -> bytes:
        out, held = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(held):
                for width in (1, 2, 3, 4):
                    try:
                        out.append(bytes(held[at : at + width]).decode().encode())
                    except UnicodeDecodeError:
                        continue
                    at += width
                    break
                else:
                    out.append("�".encode())
                    at += 1
            held.clear()

        for k in ids:
            if k in self.bytes_of:
                held.append(self.bytes_of[k])
            else:
                flush()
                out.append(self.raw[k])
        flush()
        return b"".join(out)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Ids of texts, with those of the words met last."""

    def __init__(self, path: str, most: int):
        self.pieces, self.most = pieces(path), most
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.begin, self.end = (_packed([k]) for k in (self.pieces.bos, self.pieces.eos))

    def of(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, with begin and end."""
        cut = self.pieces.cuts.findall
        split = [cut(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if 2 * self.held > self.most:  # words met since the last time stay
            self.known, self.older, self.held = {}, self.known, 0
        for w in set().union(*split).difference(self.known):
            ids = self.older.get(w)
            if ids is None:
                ids = _packed(self.pieces.word(w))
            self.known[w] = ids
            self.held += _OBJECTS + 4 * len(w) + len(ids)
        get = self.known.__getitem__
        return [b"".join([self.begin, *map(get, s), self.end]) for s in split]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(maxsize=1)
def _encoder(path: str, most: int) -> Encoder:
    return Encoder(path, most)


def encode(docs: DataFrame, path: str, cached: int = CACHED_BYTES) -> DataFrame:
    """(doc_id, text) -> doc_id, ids (little-endian unsigned 32-bit integers, with begin and end); one row per row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, cached)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                ids = encoder.of([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> doc_id, ids, text: the text that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = pieces(path).joined
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                texts = [joined(np.frombuffer(x or b"", "<u4").tolist()).decode() for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def digest(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again; the digest columns of the contract."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return digest(decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path))
