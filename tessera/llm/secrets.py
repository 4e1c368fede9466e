"""Secret scans with structural confirmation.

Three base patterns report what looks like a secret.  On top, candidates in base64 or hex are decoded and reported only if
what they hold has the structure of a key or a signed token: DER whose nested lengths add up and whose leading elements
are those of a key, length-prefixed SSH key fields, PEM blocks around either, or a token whose header names its algorithm.

Rows: a null text counts as empty; an empty one has no span; spans are in code points of the whole text, ends exclusive;
repeated rows and null doc_ids are carried; an empty table gives no row.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

# Fixed patterns of the base scan, with the least lengths of what counts.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}KEY)-----(\s[A-Za-z0-9+/=\s]{15,}+)-----END \1-----")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
ANY_HEX = re.compile(r"[0-9A-Fa-f]{64,}")
SIGNED = re.compile(r"eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
KINDS = ("assign", "access", "hex", "key", "signed")
CONTAINER = b"openssh-key-v1\0"


def der(data: bytes, a: int, b: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the elements that fill data[a:b] exactly, constructed ones checked inside; None if they don't."""
    out = []
    while a < b:
        if b - a < 2:
            return None
        tag, n, at = data[a], data[a + 1], a + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > b or data[at] == 0:
                return None
            n = int.from_bytes(data[at : at + k], "big")
            at += k
            if n < 0x80:
                return None  # a shorter form exists, so this is not DER
        if at + n > b or (tag & 0x20 and (depth > 12 or der(data, at, at + n, depth + 1) is None)):
            return None
        out.append((tag, at, at + n))
        a = at + n
    return out


def der_key(data: bytes) -> bool:
    """One sequence that starts like a private key (version first) or a public one (algorithm, then its bits)."""
    whole = der(data, 0, len(data)) if data[:1] == b"\x30" else None
    if not whole or len(whole) != 1:
        return False
    inner = der(data, *whole[0][1:])
    tags = [t for t, *_ in inner or ()]
    if tags[:1] == [0x02] and inner[0][2] - inner[0][1] == 1 and data[inner[0][1]] in (0, 1):
        return tags[1:3] == [0x30, 0x04] or tags[1:2] == [0x04] or tags.count(0x02) >= 5  # PKCS#8; EC; RSA and DSA
    if tags == [0x30, 0x03]:
        first = der(data, *inner[0][1:])
        return bool(first) and first[0][0] == 0x06
    return tags == [0x02, 0x02] and inner[0][2] - inner[0][1] >= 64 and inner[1][2] - inner[1][1] <= 8


def fields_of(data: bytes, at: int, most: int | None = None) -> tuple[list[bytes], int] | None:
    """(length-prefixed fields from ``at`` on, ``most`` of them or as many as there are, where they end); None if one is cut short."""
    out = []
    while at < len(data) if most is None else len(out) < most:
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out, at


def ssh_key(data: bytes) -> bool:
    """Length-prefixed fields, the first a key type; or a container: cipher, key derivation, count, public keys, private part."""
    if data.startswith(CONTAINER):
        head = fields_of(data, len(CONTAINER), 3)
        if head is None or len(data) < head[1] + 4:
            return False
        keys = int.from_bytes(data[head[1] : head[1] + 4], "big")
        rest = fields_of(data, head[1] + 4, min(keys, len(data)) + 1)
        return rest is not None and keys >= 1 and rest[1] == len(data) and all(not k.startswith(CONTAINER) and ssh_key(k) for k in rest[0][:-1])
    found = fields_of(data, 0)
    return found is not None and len(found[0]) >= 2 and re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]{3,60}", found[0][0]) is not None


def unbase64(text: str) -> bytes | None:
    body = text.rstrip("=").translate({45: 43, 95: 47})
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def signed_token(text: str) -> bool:
    """Header and payload are JSON objects, the header names an algorithm; a signature unless that is none."""
    head, body, sign = text.split(".")
    try:
        h, p = (json.loads(unbase64(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):  # not JSON, or nested deeper than any header is
        return False
    return isinstance(h, dict) and isinstance(p, dict) and isinstance(h.get("alg"), str) and (bool(sign) or h["alg"].lower() == "none")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if LONG_HEX.search(text):
        out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return out


def confirmed_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of candidates whose structure confirms them; a PEM block hides the candidates inside it."""
    out, hidden = [], []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            data = unbase64(re.sub(r"\s+", "", m[2]))
            if data and (der_key(data) or ssh_key(data)):
                out.append((m.start(), "key", m.end()))
                hidden.append((m.start(), m.end()))
    if "eyJ" in text:
        for m in SIGNED.finditer(text):
            if signed_token(m[0]):
                out.append((m.start(), "signed", m.end()))
                hidden.append((m.start(), m.end()))
    for pattern, decode in ((BASE64, unbase64), (ANY_HEX, lambda x: bytes.fromhex(x) if len(x) % 2 == 0 else None)):
        hidden.sort()
        starts = [a for a, _ in hidden]
        for m in pattern.finditer(text):
            k = bisect_right(starts, m.start())  # what is hidden does not overlap
            if k and m.start() < hidden[k - 1][1]:
                continue
            data = decode(m[0])
            if data and (der_key(data) or ssh_key(data)):
                out.append((m.start(), "key", m.end()))
                hidden.append((m.start(), m.end()))
    return out


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]))))


def scan(docs: DataFrame) -> DataFrame:
    """A row per document: counts of the base kinds, a digest of the base spans, all spans, and the counts of the others."""

    def make():
        def read(c: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_key", "n_signed")}
            for t in c["text"]:
                base = base_spans(t or "")
                more = confirmed_spans(t or "")
                kinds = [k for _, k, _ in base + more]
                for k in KINDS:
                    out[f"n_{k}"].append(kinds.count(k))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(base + more))
            return out | {"doc_id": c["doc_id"]}

        return read

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_key long, n_signed long")
