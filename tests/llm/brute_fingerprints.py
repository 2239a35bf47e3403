"""A plain Python Order MinHash, to test the Spark one against."""

import re

import xxhash

from lexmill.llm import fingerprints as P


def _chain(parts, seed=42):
    for p in parts:
        raw = p.encode() if isinstance(p, str) else (p & (1 << 64) - 1).to_bytes(8, "little") if p is not None and not isinstance(p, tuple) else p[0].to_bytes(4, "little")
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


def fingerprint(text: str) -> str:
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    kmers = [_chain(words[i : i + P.K]) for i in range(max(1, len(words) - P.K + 1))] if words else []
    seen, numbered = {}, []
    for i, h in enumerate(kmers):
        o = seen[h] = seen.get(h, -1) + 1
        numbered.append((h if o == 0 else _chain([h, (o,)]), i))
    slots = {}
    for v, i in sorted(numbered, key=lambda x: (x[0] - (1 << 64) if x[0] >> 63 else x[0], x[1])):
        slots.setdefault(v >> 64 - P.SLOT_BITS, []).append((i, v))
    out = []
    for b in range(P.SLOTS):
        group = sorted(slots.get(b, [])[: P.TUPLE])
        code = 42
        for _, v in group:
            code = _chain([code, v])
        out.append(f"{code >> 48:04x}" if group else P.EMPTY)
    return "".join(out)


def likeness(a: str, b: str) -> float:
    used = [(a[k : k + 4], b[k : k + 4]) for k in range(0, len(a), 4) if not a[k : k + 4] == b[k : k + 4] == P.EMPTY]
    return sum(x == y for x, y in used) / len(used) if used else 1.0
