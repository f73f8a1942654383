"""Secrets in texts: patterns, and candidates confirmed by decoding them.

Patterns find assignments, access keys and hexadecimal runs. Runs of base64 or hexadecimal letters, armoured blocks and
dotted triples are candidates only: they are reported if they decode to a private key whose nested lengths add
up exactly (DER or the OpenSSH form), or to a token whose header names a signature method that fits its signature.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, texts_of

#: In the order in which spans that start at one place are listed.
KINDS = ("assign", "access", "hex", "der", "ssh", "jwt")
BASE = KINDS[:3]

_ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_ANY_HEX = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}(?![0-9A-Za-z])")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}")
_ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?!-----)[\x20-\x7E\s])++)-----END \1-----")
#: Ends of lines, also written as escapes, and what stands around them where lines are quoted or commented out.
_BREAK = re.compile(r"(?:\\+r)?\\+n|\r?\n")
_JOINT = re.compile(r"""["']?[,+]?[\x20\t]*(?:(?:\\+r)?\\+n|\r?\n)[\x20\t>#*|"']{0,40}""")
_MARGIN = "\x20\t\r>#*|\"',\\"
_HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*:")
_CIPHER = re.compile(r"DEK-Info:\s*[A-Z0-9-]+,\s*([0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})(?![0-9A-Fa-f])")
#: The first line of a key in base64: a DER sequence, or the mark of the OpenSSH form.
_FIRST = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\n))(?:M[A-P]|b3BlbnNzaC1r)[A-Za-z0-9+/_-]{14,}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")

#: Bytes of a signature by method; the RSA methods have the length of their key, 128 bytes at least.
SIGNATURES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}
RSA_METHODS = ("RS256", "RS384", "RS512", "PS256", "PS384", "PS512")
MAGIC = b"openssh-key-v1\0"
#: Where the identifiers of password-based encryption begin (PKCS 5 and PKCS 12).
ENCRYPTIONS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def decoded(candidate: str) -> bytes | None:
    """Base64 in either alphabet, padded or not; None if it is neither."""
    plain = candidate.rstrip("=").replace("-", "+").replace("_", "/")
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the items that make up ``data`` exactly; None if their lengths don't add up."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length = data[at], data[at + 1]
        at += 2
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
                return None
            length = int.from_bytes(data[at : at + n], "big")
            at += n
            if length < 0x80:
                return None  # a short length must be written short
        if at + length > len(data):
            return None
        items.append((tag, data[at : at + length]))
        at += length
    return items


def is_der_key(data: bytes) -> bool:
    """A private key: RSA or DSA numbers, an elliptic curve key, or a wrapped or encrypted key, nested lengths checked."""
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    items = der_items(outer[0][1])
    if items and [tag for tag, _ in items] == [0x30, 0x04]:
        method = der_items(items[0][1])
        named = bool(method) and [tag for tag, _ in method] == [0x06, 0x30] and method[0][1].startswith(ENCRYPTIONS)
        return named and bool(der_items(method[1][1])) and len(items[1][1]) >= 16
    if not items or items[0][0] != 0x02 or len(items[0][1]) != 1:
        return False
    version, tags = items[0][1][0], [tag for tag, _ in items]
    if version == 0 and tags == [0x02] * len(tags) and len(tags) in (6, 9):
        return all(content for _, content in items)
    if version == 1 and len(tags) >= 2 and tags[1] == 0x04 and all(tag in (0xA0, 0xA1) for tag in tags[2:]):
        return len(items[1][1]) >= 16 and all(der_items(content) for _, content in items[2:])
    if version in (0, 1) and len(tags) >= 3 and tags[1:3] == [0x30, 0x04] and all(tag in (0xA0, 0xA1, 0x81) for tag in tags[3:]):
        algorithm = der_items(items[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06 and len(algorithm[0][1]) >= 3 and bool(der_items(items[2][1]))
    return False


def is_ssh_key(data: bytes) -> bool:
    """The OpenSSH form of private keys: length-prefixed strings that fill it exactly."""
    if not data.startswith(MAGIC):
        return False
    at = len(MAGIC)

    def number() -> int:
        nonlocal at
        at += 4
        return int.from_bytes(data[at - 4 : at], "big") if at <= len(data) else len(data) + 1

    def string() -> bool:
        nonlocal at
        length = number()
        at += length
        return at <= len(data)

    if not (string() and string() and string()):
        return False
    keys = number()
    return 1 <= keys <= 16 and all(string() for _ in range(keys)) and string() and at == len(data)


def is_signed_token(candidate: str) -> bool:
    """Three parts: a header that names a signature method, claims, and a signature of the method's length."""
    head, claims, signature = (decoded(part) for part in candidate.split("."))
    try:
        header, body = json.loads(head or b""), json.loads(claims or b"")
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(body, dict) or signature is None:
        return False
    method = header.get("alg")
    return method in RSA_METHODS and len(signature) >= 128 or isinstance(method, str) and SIGNATURES.get(method) == len(signature)


def key_kind(data: bytes | None) -> int | None:
    return None if not data else 3 if is_der_key(data) else 4 if is_ssh_key(data) else None


def armoured_kind(body: str) -> int | None:
    """The kind of key in an armoured block, whose lines may end in escapes, be quoted, and follow headers.

    If headers say that it is encrypted, its bytes are whole blocks of the cipher whose first block they give.
    """
    lines = [line.strip(_MARGIN) for line in _BREAK.split(body)]
    headers = 0
    while headers < len(lines) and (not lines[headers] or _HEADER.match(lines[headers])):
        headers += 1
    if headers and any(lines[:headers]) and "" in lines[headers:-1]:
        headers += lines[headers:].index("")  # what is left of the last header
    data = decoded("".join("".join(lines[headers:]).split()))
    head = "\n".join(lines[:headers])
    cipher = _CIPHER.search(head) if "ENCRYPTED" in head else None
    if cipher and data and len(data) % (len(cipher[1]) // 2) == 0:
        return 3
    return key_kind(data)


class _Lines:
    """Lines of base64 that follow one another, read once from the first; any of them may begin a key."""

    def __init__(self, text: str, start: int, end: int):
        self.text = text
        self.rows = [(start, end, end - start, True)]  # start, end, letters, whether it ends without padding
        while self.rows[-1][3] and (joint := _JOINT.match(text, end)) and (run := _RUN.match(text, joint.end())):
            letters = len(run[0].rstrip("="))
            end = run.end()
            self.rows.append((run.start(), end, letters, letters == len(run[0])))
        self.index = {row[0]: i for i, row in enumerate(self.rows)}
        # up to which line the lines from each one on are as long as it
        self.to = [0] * len(self.rows)
        for i in range(len(self.rows) - 1, -1, -1):
            alike = i + 1 < len(self.rows) and self.rows[i][3] and self.rows[i + 1][3] and self.rows[i + 1][2] == self.rows[i][2]
            self.to[i] = self.to[i + 1] if alike else i + 1


class _Candidate:
    """A key that begins with line ``i``: its lines are of one length, the last one may be shorter or padded."""

    def __init__(self, lines: _Lines, i: int):
        self.lines, self.i, self.width = lines, i, lines.rows[i][2]
        self.full = lines.to[i] - i
        after = lines.rows[lines.to[i]] if lines.to[i] < len(lines.rows) and lines.rows[i][3] else None
        self.last = after[2] if after and after[2] <= self.width else 0
        self.count = self.full + (1 if self.last else 0)

    def letters(self, n: int) -> int:
        return n * self.width if n <= self.full else self.full * self.width + self.last

    def needed(self, most: int) -> int:
        """The lines that hold ``most`` letters, or all there are."""
        n = max(2, -(-most // self.width))
        return n if n <= self.full else self.count

    def text(self, start: int, end: int) -> str:
        rows, w = self.lines.rows, self.width
        pieces = []
        for line in range(start // w, -(-end // w)):
            if line >= self.count:
                break
            at, _, letters, _ = rows[self.i + line]
            pieces.append(self.lines.text[at + max(start - line * w, 0) : at + min(end - line * w, letters)])
        return "".join(pieces)

    def bytes(self, at: int, n: int) -> bytes:
        """``n`` bytes from ``at`` on, or fewer; only their letters are decoded."""
        part = self.text(at // 3 * 4, -(-(at + n) // 3) * 4)
        return (decoded(part) or b"")[at % 3 : at % 3 + n]

    def number(self, at: int, n: int) -> int:
        found = self.bytes(at, n)
        return int.from_bytes(found, "big") if len(found) == n else 1 << 40

    def is_ssh(self, size: int) -> bool:
        """Whether the lengths of an OpenSSH key add up to ``size``, from the lengths alone."""
        at, strings = len(MAGIC), 3
        while strings:
            at += 4 + self.number(at, 4)
            strings -= 1
            if at > size:
                return False
        keys = self.number(at, 4)
        at += 4
        if not 1 <= keys <= 16:
            return False
        for _ in range(keys + 1):
            at += 4 + self.number(at, 4)
            if at > size:
                return False
        return at == size

    def is_der(self, head: int, size: int) -> bool:
        """Whether the items of a sequence of ``size`` bytes, the first ``head`` being its own length, fill it."""
        at, items = head, 0
        while at < size and items < 64:
            length, more = self.number(at + 1, 1), 0
            if length & 0x80:
                more = length & 0x7F
                if not 1 <= more <= 4:
                    return False
                length = self.number(at + 2, more)
            at += 2 + more + length
            items += 1
        return at == size


def wrapped_keys(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of keys in lines of base64 of one length, the last of which may be shorter, without armour.

    Lines that follow one another are read once, however many of them look like the beginning of a key, and a key is
    decoded only if the lengths that it states, read at their places, add up.
    """
    at, lines = 0, None
    while m := _FIRST.search(text, at):
        at, width = m.end(), len(m[0])
        head = decoded(m[0][:16]) or b""
        ssh = head.startswith(MAGIC[:9])
        n = size = 0
        if not ssh:
            n = head[1] & 0x7F if head[1] & 0x80 else 0
            # a sequence begins with a number or another sequence
            if n > 4 or head[2 + n] not in (0x02, 0x30):
                continue
            size = 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])
            if size <= width * 3 // 4:
                continue  # it would end on its first line
        if lines is None or m.start() not in lines.index:
            lines = _Lines(text, m.start(), m.end())
        i = lines.index[m.start()]
        if lines.rows[i][1] != m.end():
            continue  # padded
        key = _Candidate(lines, i)
        most = key.count if ssh else key.needed((size * 4 + 2) // 3)
        # what follows the last line may look like a shorter one
        for count in (most, most - 1):
            letters = key.letters(count)
            if count < 2 or letters % 4 == 1:
                continue
            total = letters * 3 // 4
            if not (key.is_ssh(total) if ssh else total == size and key.is_der(2 + n, size)):
                continue
            if kind := key_kind(decoded(key.text(0, letters))):
                end = lines.rows[i + count - 1][1]
                yield m.start(), kind, end
                at = end
                break


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index in KINDS, end) of all secrets, in order; places are code points."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    armoured = []
    if "-----BEGIN" in text:
        for m in _ARMOUR.finditer(text):
            if kind := armoured_kind(m[2]):
                armoured.append((m.start(), m.end()))
                found.append((m.start(), kind, m.end()))
    for start, kind, end in wrapped_keys(text):
        if not any(a <= start < b for a, b in armoured):
            armoured.append((start, end))
            found.append((start, kind, end))
    for m in _BASE64.finditer(text):
        kind = key_kind(decoded(m[0]))
        if kind and not any(a <= m.start() < b for a, b in armoured):
            found.append((m.start(), kind, m.end()))
    for m in _ANY_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and (kind := key_kind(bytes.fromhex(m[0]))):
            found.append((m.start(), kind, m.end()))
    if "." in text:
        found += [(m.start(), 5, m.end()) for m in _TOKEN.finditer(text) if is_signed_token(m[0])]
    return sorted(found)


def secrets(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id`` and ``found``, an array of (kind, start, end) by start and order of kinds.

    Whole texts are scanned where they lie, without a shuffle. Null text is empty: nothing found. Null ids and repeated
    rows are rows like others, other columns are ignored, an empty table gives none. Spans that start together stand in
    the order of ``KINDS``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches):
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(t)] for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(rows, kind)], ["doc_id", "found"])

    rows = small_batches(docs).select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, found array<struct<kind: string, start: long, end: long>>")


def summary(found: DataFrame) -> DataFrame:
    """``doc_id``, a count per base kind, the digest of the base spans, and all spans as text."""

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(*kinds):
        return F.filter("found", lambda s: s["kind"].isin(*kinds))

    base = of(*BASE)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
