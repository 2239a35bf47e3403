"""Operator 8, secret scans with a recursive decoding worklist.

The base patterns (assignments, access keys, hex runs) scan the text. Then a
worklist takes layers: percent escapes and Unicode or numeric escapes of a layer decode the whole
layer; base64 runs decode on their own, and are decompressed (gzip, zlib, bz2, xz)
where their bytes say so; so are compressed bytes that stand in the text escaped. No layer is dropped for what it looks like: bytes that are no
UTF-8 are replaced and the rest counts. Every new layer is scanned with the same patterns and its hits are
mapped back to code points of the original text: exactly through escapes, to
the whole run for base64 and compressed layers. A layer seen before with the
same place (a cycle, such as an archive that holds itself) is not taken again, so
the worklist ends at a fixpoint.

A compressed layer is expanded to its end, member after member, and scanned in windows of
about WINDOW characters, so its size does not bound what is found and hardly what is held. A window
ends where no match and no run can go on. A base64 run longer than a window is decoded
piece by piece; only a longer stretch that mixes base64 characters and escapes, without any other
character, is held as a whole.

Where a layer came from is kept as one flat list of places in the original text, so layers may be nested to any depth. Base64 may be wrapped in
lines of 16 characters or more (indented, or with written-out line ends), stand behind a slash, and hold UTF-16, as may compressed layers that begin
with it. Unicode escapes may have their backslash repeated. Very long texts are scanned whole.

A null text counts as empty. Hits with equal places and kinds are one; ties in start go by kind, then by end. Repeated rows give repeated results; an empty table
gives none; other columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The kinds in their order, and the base patterns with the least length of a hit.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: A hex run of the least length: the search that HEX and the length amount to, without short matches.
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\+u\{([0-9A-Fa-f]{1,6})\}|\\+u([0-9A-Fa-f]{4})|\\+U([0-9A-Fa-f]{8})|\\+x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: Lines of 16 characters or more and a last one, as encoders wrap long runs: the whole lines (1), and the last one (2). Line ends may be written out.
_WRAPPED = re.compile(r"(?:(?<![A-Za-z0-9+/])(?!(?<=\\)[nr])|(?<=\\n))([A-Za-z0-9+/]{16,}+(?:(?:\r?\n[ \t]*|(?:\\r)?\\n)[A-Za-z0-9+/]{16,}+)*)(?:\r?\n[ \t]*|(?:\\r)?\\n)([A-Za-z0-9+/]{2,}={0,2})")
_LINE_END = re.compile(r"\s+|(?:\\r)?\\n")
#: Bytes written as escapes among plain characters, as in URLs and in literals, and how compressed ones begin there.
_URL_BYTES = re.compile(r"%[0-9A-Fa-f]{2}|[^%\s\"'<>\x80-\U0010ffff]")
_LITERAL_BYTES = re.compile(r"\\(?:x|u00)[0-9A-Fa-f]{2}|\\[abfnrtv'\"\\]|[^\\\r\n\x80-\U0010ffff]")
_URL_HEAD = re.compile(r"%1[Ff]%8[Bb]|(?:%78|x)%(?:01|5[Ee]|9[Cc]|[Dd][Aa])|(?:%42|B)(?:%5[Aa]|Z)(?:%68|h)(?:%3)?[1-9]|%[Ff][Dd](?:%37|7)(?:%7[Aa]|z)")
_LITERAL_HEAD = re.compile(r"@1[Ff]@8[Bb]|(?:@78|x)(?:\^|@(?:01|5[Ee]|9[Cc]|[Dd][Aa]))|(?:@42|B)(?:@5[Aa]|Z)(?:@68|h)(?:@3)?[1-9]|@[Ff][Dd](?:@37|7)(?:@7[Aa]|z)".replace("@", r"\\(?:x|u00)"))
_LITERAL = {"a": 7, "b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11, "'": 39, '"': 34, "\\": 92}
#: A percent sign that was escaped twice or more, before two hexadecimal digits.
_SIGNS = re.compile(r"%(?:25)+(?=25[0-9A-Fa-f]{2})")
#: Characters (or bytes) of an expanded layer that are taken at once, bytes given to a decompressor at once, and characters
#: before a window's end that the next one sees again where only an assignment or an escaped match can go on.
WINDOW, FEED, AGAIN = 1 << 22, 1 << 16, 1 << 16
_RUN = re.compile(r"[A-Za-z0-9+/_-]*")
_JOINT = re.compile(rf"%([0-9A-Fa-f]{{2}})|{_ESCAPE.pattern}")
_SPACES = re.compile(r"\x20{2,}")
#: Up to the last character that stands in no match; up to the last one that stands in no base64 run and no escape.
_TO_BREAK = re.compile(r"""(?s:.*)[^A-Za-z0-9+/_.=\-"'\x20:%\\{}&#;]""")
_TO_PAUSE = re.compile(r"""(?s:.*)[^A-Za-z0-9+/_\-%\\{}&#;]""")
Span = tuple[int, int, int]
REDACTED = "[secret]"


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of base hits, in order."""
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(found)


class _Layer:
    """A decoded text, and where in the original text each of its parts came from (flat, however deep the layer is)."""

    def __init__(self, parts: list[str], at: list[int], source: list[tuple[int, int, bool]]):
        self.text = "".join(parts)
        self.at = at  # where each part begins, here
        self.source = source  # its place in the original; True: character by character

    def place(self, start: int, end: int) -> tuple[int, int]:
        return self._of(start)[0], self._of(end - 1)[1]

    def _of(self, k: int) -> tuple[int, int]:
        n = bisect_left(self.at, k + 1) - 1
        a, b, plain = self.source[n]
        return (a + k - self.at[n], a + k - self.at[n] + 1) if plain else (a, b)


class _Made:
    """Builds a layer from parts of the one above it."""

    def __init__(self, above: _Layer):
        self.above, self.part = above, 0
        self.parts: list[str] = []
        self.at: list[int] = []
        self.source: list[tuple[int, int, bool]] = []
        self.size = 0

    def _add(self, part: str, source: tuple[int, int, bool]) -> None:
        self.parts.append(part)
        self.at.append(self.size)
        self.source.append(source)
        self.size += len(part)

    def keep(self, start: int, end: int) -> None:
        """Characters of the layer above as they are: its parts, cut to the range."""
        at, source = self.above.at, self.above.source
        while start < end:
            while self.part + 1 < len(at) and at[self.part + 1] <= start:
                self.part += 1
            stop = min(end, at[self.part + 1] if self.part + 1 < len(at) else len(self.above.text))
            a, b, plain = source[self.part]
            shift = start - at[self.part]
            self._add(self.above.text[start:stop], (a + shift, a + shift + stop - start, True) if plain else (a, b, False))
            start = stop

    def put(self, part: str, start: int, end: int) -> None:
        """A decoded part in the place of a range of the layer above."""
        a, b = self.above.place(start, end)
        self._add(part, (a, b, False))

    def done(self) -> _Layer:
        return _Layer(self.parts, self.at, self.source)


def _percent_decoded(layer: _Layer) -> _Layer | None:
    """Percent escapes decoded; of an escaped percent sign (``%25``, ``%2525`` and so on) all levels at once, as the layers between hold
    nothing but the sign of the next."""
    text = layer.text
    if "%" not in text:
        return None
    out, last = _Made(layer), 0
    for m in _SIGNS.finditer(text):
        out.keep(last, m.start())
        out.put("%", m.start(), m.end())
        last = m.end()
    if last:
        out.keep(last, len(text))
        return out.done()
    for m in _PERCENT.finditer(text):
        out.keep(last, m.start())
        raw, at = bytes.fromhex(m[0].replace("%", "")), m.start()
        for c in raw.decode("utf-8", "surrogateescape"):  # bytes that are no UTF-8 stay one character each
            n = len(c.encode("utf-8", "surrogateescape"))
            out.put(c if not "\ud800" <= c <= "\udfff" else "�", at, at + 3 * n)
            at += 3 * n
        last = m.end()
    if not last:
        return None
    out.keep(last, len(text))
    return out.done()


def _escapes_decoded(layer: _Layer) -> _Layer | None:
    text = layer.text
    if "\\" not in text and "&#" not in text:
        return None
    out, last = _Made(layer), 0
    for m in _ESCAPE.finditer(text):
        code = int(m[6]) if m[6] else int(next(x for x in m.groups() if x), 16)
        if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF:
            continue
        out.keep(last, m.start())
        out.put(chr(code), m.start(), m.end())
        last = m.end()
    if not last:
        return None
    out.keep(last, len(text))
    return out.done()


def _decompressor(head: bytes):
    """A decompressor for bytes that begin like this, or None."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 2 and (head[0] << 8 | head[1]) % 31 == 0:
        return zlib.decompressobj()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _first(raw: Iterator[bytes], held: bytes, least: int) -> bytes:
    """held, with as many pieces more as it takes to have ``least`` bytes."""
    parts, size = [held], len(held)
    while size < least and (more := next(raw, b"")):
        parts.append(more)
        size += len(more)
    return b"".join(parts)


def _members(raw: Iterator[bytes]) -> Iterator[bytes]:
    """What compressed bytes hold, member after member; bytes that are no member, or a broken one, as they are."""
    held = _first(raw, b"", 6)
    while held:
        box = _decompressor(held)
        try:
            while box is not None and not box.eof:
                piece = box.decompress(held, FEED)
                if piece:
                    yield piece
                if not box.eof:
                    held = getattr(box, "unconsumed_tail", b"")
                    if not held and len(piece) < FEED and not (held := next(raw, b"")):
                        return  # the input ends within a member
        except (zlib.error, OSError, lzma.LZMAError, EOFError):
            box = None
        if box is None:
            yield b"\n"
            yield held
            yield from raw
            return
        held = box.unused_data.lstrip(b"\0")
        while len(held) < 6 and (more := next(raw, b"")):
            held = (held + more).lstrip(b"\0")


def _pieces(raw: bytes) -> Iterator[bytes]:
    return (raw[k : k + FEED] for k in range(0, len(raw), FEED))


def _expanded(raw: Iterator[bytes], above: frozenset[bytes]) -> tuple[Iterator[bytes], frozenset[bytes]]:
    """The bytes, decompressed as often as they say, and the digests of the layers opened; one of them is not opened again."""
    head = _first(raw, b"", 6)
    while _decompressor(head) is not None:
        head = _first(raw, head, WINDOW)
        name = hashlib.sha256(head).digest()
        if name in above:
            break
        above |= {name}
        raw = _members(chain(_pieces(head), raw))
        head = _first(raw, b"", 6)
    return chain((head,), raw), above


def _wide(raw: bytes) -> list[str]:
    """The UTF-16 forms that bytes look like: every second one is mostly zero."""
    return [code for code, zeros in (("utf-16-le", raw[1::2]), ("utf-16-be", raw[::2])) if len(zeros) > 8 and 2 * zeros.count(0) > len(zeros)]


def _texts(raw: Iterator[bytes]) -> Iterator[str]:
    head = _first(raw, b"", 1024)
    decoder = codecs.getincrementaldecoder((_wide(head) or ["utf-8"])[0])("replace")
    for piece in chain((head,), raw):
        yield decoder.decode(piece)
    yield decoder.decode(b"", True)


def _kinds(raw: Iterator[bytes], above: frozenset[bytes]) -> set[int]:
    """Kinds of the hits in a layer that is not held as a whole, and in its layers."""
    raw, above = _expanded(raw, above)
    texts = _texts(raw)
    found: set[int] = set()
    parts, size, ended = [], 0, False
    while not ended and len(found) < len(KINDS):
        text = next(texts, None)
        ended = text is None
        parts.append(text or "")
        size += len(parts[-1])
        if size < WINDOW and not ended:
            continue
        held = "".join(parts)
        if not ended:
            held = _SPACES.sub(" ", held)  # where a pattern has a space, it has any number
        cut = len(held) if ended else m.end() if (m := _TO_BREAK.match(held)) else 0
        found |= {k for _, k, _ in all_spans(held[:cut], above)[1]}
        held = held[cut:]
        if len(held) >= WINDOW // 2:
            cut = m.end() if (m := _TO_PAUSE.match(held)) else 0
            if _RUN.fullmatch(held, cut):
                if cut:
                    found |= {k for _, k, _ in all_spans(held[: cut + 64], above)[1]}
                held = _long_run(held[cut:], texts, found, above)
            elif cut > 2 * AGAIN:
                found |= {k for _, k, _ in all_spans(held[:cut], above)[1]}
                held = held[cut - AGAIN :]
        # what is left is looked at again when as much has come on top
        parts, size = [held], 0 if len(held) >= WINDOW // 2 else len(held)
    return found


def _joint(text: str) -> tuple[str, int] | None:
    """The base64 character that the text begins with as an escape, and the length of the escape."""
    m = _JOINT.match(text)
    if not m:
        return None
    code = int(m[7]) if m[7] else int(next(x for x in m.groups() if x), 16)
    char = chr(code) if code < 128 else ""
    return (char, m.end()) if char and _RUN.fullmatch(char) else None


def _long_run(text: str, texts: Iterator[str], found: set[int], above: frozenset[bytes]) -> str:
    """Adds the kinds in a base64 run that begins with the text, and in what it holds; the run's end and what was taken after it."""
    rest, last, ended, size = text, "", False, 0

    def parts() -> Iterator[bytes]:
        nonlocal rest, last, ended, size
        left, more = "", text
        while not ended and more is not None:
            run = _RUN.match(more)[0]
            found.update(k for _, k, _ in base_spans(last + run))
            last = (last + run)[-64:]
            size += len(run)
            ended, rest = len(run) < len(more), more[len(run) :]
            if ended:
                while len(rest) < 16 and (text_after := next(texts, None)) is not None:
                    rest += text_after
                if joint := _joint(rest):  # an escaped character of the run: the run goes on behind it
                    run += joint[0]
                    last = (last + joint[0])[-64:]
                    size += 1
                    ended, rest = False, rest[joint[1] :]
            left += run.replace("-", "+").replace("_", "/")
            whole = len(left) // 4 * 4
            yield from _pieces(base64.b64decode(left[:whole]))
            left = left[whole:]
            more = None if ended else rest or next(texts, None)
        if len(left) > 1:
            yield base64.b64decode(left + "=" * (-len(left) % 4))

    decoded = parts()
    inner = _kinds(decoded, above)
    for _ in decoded:  # to the run's end, if all kinds were found before
        pass
    if size % 4 != 1:
        found |= inner
    return last + rest


def _readings(raw: bytes) -> list[str]:
    """The bytes as text: UTF-8, and UTF-16 where every second byte is mostly zero."""
    return [raw.decode(code, "replace") for code in ("utf-8", *_wide(raw))]


def _byte(token: str) -> int:
    if len(token) == 1:
        return ord(token)
    return _LITERAL[token[1]] if len(token) == 2 else int(token[-2:], 16)


def _packed(text: str, at: int, token: re.Pattern, plus: int) -> tuple[bytes, int]:
    """The compressed members whose escaped bytes begin at a place, and where they end; to the last byte that is one where a member does not end."""
    raw, ends, done, fed, size, box = bytearray(), [], 0, 0, 64, None
    while True:
        while len(raw) < fed + size and (t := token.match(text, at)):
            at = t.end()
            raw.append(plus if t[0] == "+" else _byte(t[0]))
            ends.append(at)
        if box is None and (box := _decompressor(bytes(raw[done : done + 6]))) is None:
            return bytes(raw[:done]), ends[done - 1] if done else 0
        data, ended = bytes(raw[fed:]), len(raw) < fed + size
        fed, size = len(raw), min(4 * size, FEED)
        try:
            while not box.eof and (data or ended):
                out = box.decompress(data, FEED)
                data = getattr(box, "unconsumed_tail", b"")
                if not data and len(out) < FEED:
                    break
        except (zlib.error, OSError, lzma.LZMAError, EOFError):
            return bytes(raw[:done]), ends[done - 1] if done else 0
        if box.eof:
            done = fed = len(raw) - len(box.unused_data)
            box = None
        elif ended:
            return bytes(raw), ends[-1]


def _escaped_packed(text: str) -> Iterator[tuple[bytes, int, int]]:
    """Compressed bytes that stand in the text as escapes, with their place."""
    for mark, head, token, plus in (("%", _URL_HEAD, _URL_BYTES, 32), ("\\", _LITERAL_HEAD, _LITERAL_BYTES, 43)):
        m = head.search(text) if mark in text else None
        while m:
            raw, end = _packed(text, m.start(), token, plus)
            if raw:
                yield raw, m.start(), end
            m = head.search(text, max(end, m.end()))


def _base64_decoded(text: str) -> Iterator[tuple[bytes, int, int]]:
    for m in _BASE64.finditer(text):
        run = m[0]
        yield from _base64_run(run, m.start(), m.end())
        # a path or a word may be glued in front of the run: behind the last slash it is a run of its own
        if (cut := run.rfind("/")) > 0 and len(run) - cut > 20:
            yield from _base64_run(run[cut + 1 :], m.start() + cut + 1, m.end())
        if "/" in run and (cut := run.find("/") + 1) < len(run) - 20:
            yield from _base64_run(run[cut:], m.start() + cut, m.end())
    for m in _WRAPPED.finditer(text):
        lines, end = _LINE_END.sub("", m[1]), m.end()
        # a last line that does not fill the fours is a word after the run
        run = lines + m[2]
        if len(run) % 4 and len(lines) % 4 == 0 and len(lines) >= 20:
            run, end = lines, m.end(1)
        yield from _base64_run(run, m.start(), end)


def _base64_run(run: str, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(run) % 4 == 1:
        return
    try:
        yield base64.b64decode(run + "=" * (-len(run) % 4)), start, end
    except binascii.Error:
        return


def all_spans(text: str, above: frozenset[bytes] = frozenset()) -> tuple[list[Span], list[Span]]:
    """(base hits, base hits and those of decoded layers); above: digests of the compressed layers that hold the text."""
    base = base_spans(text)
    found = set(base)
    work = [_Layer([text], [0], [(0, len(text), True)])] if text else []
    seen: set[tuple[str | bytes, int, int]] = {(text, 0, len(text))}
    while work:
        layer = work.pop()
        inner = [out for out in (_percent_decoded(layer), _escapes_decoded(layer)) if out is not None]
        for raw, a, b in chain(_base64_decoded(layer.text), _escaped_packed(layer.text)):
            whole = layer.place(a, b)
            if _decompressor(raw) is None:
                inner += [_Layer([t], [0], [(*whole, False)]) for t in _readings(raw)]
            elif (raw, *whole) not in seen:
                seen.add((raw, *whole))
                found |= {(whole[0], k, whole[1]) for k in _kinds(_pieces(raw), above)}
        for decoded in inner:
            if decoded.text and (key := (decoded.text, *decoded.place(0, len(decoded.text)))) not in seen:
                seen.add(key)
                for start, kind, end in base_spans(decoded.text):
                    a, b = decoded.place(start, end)
                    found.add((a, kind, b))
                work.append(decoded)
    return base, sorted(found)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SCHEMA = "doc_id long, base array<struct<kind:string,start:long,end:long>>, spans array<struct<kind:string,start:long,end:long>>"


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, base hits, all hits; in order of start, then kind."""

    def rows(spans: list[Span]) -> list[dict]:
        return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = [all_spans(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([rows(b) for b, _ in found], _SPANS), pa.array([rows(s) for _, s in found], _SPANS)], ["doc_id", "base", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def redacted_text(text: str) -> str:
    out, last = [], 0
    for start, _, end in all_spans(text)[1]:
        if start >= last:
            out += [text[last:start], REDACTED]
        last = max(last, end)
    return "".join([*out, text[last:]])


def redact(docs: DataFrame) -> DataFrame:
    """All columns, with each hit of ``text`` replaced by REDACTED; rows and other texts stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            at = batch.schema.get_field_index("text")
            texts = [t if t is None else redacted_text(t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))
