"""Secret scan with structural confirmation.

Plain patterns find assignments, access keys and long hex runs.  What only
looks like a key is then confirmed by its structure: base64 and hex
candidates, on one line or wrapped over several, are decoded and must parse as a private key -- ASN.1 DER whose
nested lengths add up exactly and whose fields are those of a PKCS#1, PKCS#8
or EC private key, or an OpenSSH key container with its counted fields -- and
a dotted token must begin with a base64url JSON header naming a signature or
encryption algorithm, with a JSON payload.

Kinds, in order: ``assign, access, hex`` (patterns), then the confirmed
``jwt, pem, key64, keyhex``.  Spans are code points, end exclusive, leftmost
and non-overlapping per kind.

Defined cases: a null or empty text has no spans; whole texts are scanned,
however long; other columns are not read; repeated rows repeat; an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lakeaudit.llm.common import documents, text_runs
from lakeaudit.session import ship_package

KINDS = ("assign", "access", "hex", "jwt", "pem", "key64", "keyhex")
ORDER = {k: i for i, k in enumerate(KINDS)}
BASE_KINDS = KINDS[:3]


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = re.compile(rf"""(?:{NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)(?:\.[A-Za-z0-9_-]*){1,3}")
_EOL = r"(?:\r?\n|\\r\\n|\\n)"
# header lines (a name, a colon, a value that may go on in indented lines) may
# stand before the body
PEM = re.compile(rf"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:\s|\\[nr])*(?:[A-Za-z][A-Za-z0-9-]*:[^\r\n\\]*(?:{_EOL}[ \t]+[^\r\n\\]+)*{_EOL})*)"
                 r"([A-Za-z0-9+/=\s\\]+?)-----END \1-----")
ENCRYPTED = re.compile(r"Proc-Type: *4, *ENCRYPTED")
CIPHER = re.compile(r"DEK-Info: *[A-Z0-9-]+, *[0-9A-Fa-f]{16,}")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}")
HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{80,}")

# the next line of a key that is wrapped over several
BASE64_LINE = re.compile(r"\r?\n[ \t]*([A-Za-z0-9+/]+)(={0,2})")
HEX_START = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{30,}")
HEX_LINE = re.compile(r"\r?\n[ \t]*([0-9A-Fa-f]+)()")
OPENSSH = base64.b64encode(b"openssh-key-v1").decode()[:18]

SEQUENCE, INTEGER, BIT_STRING, OCTET_STRING, OBJECT_ID = 0x30, 0x02, 0x03, 0x04, 0x06


def _fields(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The DER fields (tag, start, end) filling ``data[start:end]`` exactly."""
    out, at = [], start
    while at < end:
        if at + 2 > end:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            count = size & 0x7F
            if not 1 <= count <= 4 or at + count > end:
                return None
            size, at = int.from_bytes(data[at:at + count], "big"), at + count
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def der_private_key(data: bytes) -> bool:
    """Whether the bytes are one DER private key, nested lengths included."""
    top = _fields(data, 0, len(data)) if data[:1] == b"\x30" else None
    if not top or len(top) != 1:
        return False
    inner = _fields(data, *top[0][1:])
    if not inner or inner[0][0] != INTEGER or inner[0][2] - inner[0][1] != 1:
        return False
    tags, version = [f[0] for f in inner], data[inner[0][1]]
    if version in (0, 1) and tags[1:3] == [SEQUENCE, OCTET_STRING]:  # PKCS#8
        algorithm = _fields(data, *inner[1][1:])
        return bool(algorithm) and algorithm[0][0] == OBJECT_ID and inner[2][2] > inner[2][1]
    if version in (0, 1) and len(tags) in (6, 9, 10) and set(tags[:9]) == {INTEGER}:  # DSA, RSA
        return inner[1][2] - inner[1][1] >= 32
    return version == 1 and tags[1:2] == [OCTET_STRING] and inner[1][2] - inner[1][1] >= 16  # EC


def openssh_private_key(data: bytes) -> bool:
    """Whether the bytes are an OpenSSH key container: counted fields for
    cipher, key derivation and options, then the keys."""
    magic, at = b"openssh-key-v1\x00", 15
    if not data.startswith(magic):
        return False
    for _ in range(3):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at:at + 4], "big")
    return at + 4 <= len(data) and 1 <= int.from_bytes(data[at:at + 4], "big") <= 16


def _private_key(data: bytes) -> bool:
    return der_private_key(data) or openssh_private_key(data)


def _unbase64(text: str, url: bool = False) -> bytes | None:
    body = text.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def _json_object(segment: str) -> dict | None:
    data = _unbase64(segment, url=True)
    try:
        value = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def signed_token(match: re.Match) -> bool:
    """Whether the first segment is a JSON header that names an algorithm
    and, unless encrypted, the second a JSON payload."""
    header = _json_object(match[1])
    if not header or not isinstance(header.get("alg"), str):
        return False
    return "enc" in header or _json_object(match[2]) is not None


def _declared(data: bytes) -> int | None:
    """How many bytes the DER sequence that begins here has."""
    if len(data) < 2 or data[0] != SEQUENCE:
        return None
    if data[1] < 0x80:
        return data[1] + 2
    count = data[1] & 0x7F
    if not 1 <= count <= 4 or len(data) < 2 + count:
        return None
    return int.from_bytes(data[2:2 + count], "big") + 2 + count


def _wrapped(text: str, start: int, end: int, line: re.Pattern, need: int | None) -> Iterator[tuple[str, int]]:
    """What begins at ``start`` and goes on in the lines after ``end``: (all
    characters, where they end).  Lines are as long as the second one, but the
    last may be shorter; with ``need`` characters they end."""
    parts, size, width = [text[start:end]], end - start, None
    while need is None or size < need:
        m = line.match(text, end)
        if not m or width and len(m[1]) > width:
            break
        width = width or len(m[1])
        parts.append(m[1])
        size, end = size + len(m[1]), m.end()
        if m[2] or len(m[1]) < width:
            if need is None and not m[2]:  # or a word of the next line
                yield "".join(parts[:-1]), m.start()
            break
    if len(parts) > 1 and (need is None or size == need):
        yield "".join(parts), end


def _wrapped_keys(text: str) -> Iterator[tuple[str, int, int]]:
    """Keys in base64 or hex that are wrapped over lines."""
    upto = 0
    for m in BASE64.finditer(text):
        if m.start() < upto or "=" in m[0] or not (m[0][0] == "M" or m[0].startswith(OPENSSH)):
            continue
        total = _declared(_unbase64(m[0][:8]) or b"")
        if total is None and not m[0].startswith(OPENSSH):
            continue
        need = None if total is None else -(-4 * total // 3)
        for chars, end in _wrapped(text, m.start(), m.end(), BASE64_LINE, need):
            data = _unbase64(chars)
            if data and _private_key(data):
                yield "key64", m.start(), end
                upto = end
                break
    upto = 0
    for m in HEX_START.finditer(text):
        total = _declared(bytes.fromhex(m[0][:12]))
        if m.start() < upto or total is None or len(m[0]) >= 2 * total:
            continue
        for chars, end in _wrapped(text, m.start(), m.end(), HEX_LINE, 2 * total):
            if _private_key(bytes.fromhex(chars)):
                yield "keyhex", m.start(), end
                upto = end


def spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Every reported span of a text: (kind, start, end), by kind."""
    for m in ASSIGN.finditer(text):
        if len(m[1]) >= 6:
            yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()
    if "eyJ" in text:
        for m in TOKEN.finditer(text):
            if signed_token(m):
                yield "jwt", m.start(), m.end()
    if "-----BEGIN" in text:
        for m in PEM.finditer(text):
            data = _unbase64(re.sub(r"\\[nr]|[\s\\]", "", m[3]))
            if ENCRYPTED.search(m[2]):  # whole cipher blocks, and which cipher
                real = data and len(data) % 8 == 0 and CIPHER.search(m[2])
            else:
                real = data and ("ENCRYPTED" in m[1] or _private_key(data))
            if real:
                yield "pem", m.start(), m.end()
    for m in BASE64.finditer(text):
        data = _unbase64(m[0])
        if data and _private_key(data):
            yield "key64", m.start(), m.end()
    for m in HEX_ANY.finditer(text):
        if len(m[0]) % 2 == 0 and _private_key(bytes.fromhex(m[0])):
            yield "keyhex", m.start(), m.end()
    yield from _wrapped_keys(text)


def scan(text: str) -> list[tuple[str, int, int]]:
    """The spans by start, then by kind as listed."""
    return sorted(spans(text), key=lambda s: (s[1], ORDER[s[0]]))


def _joined(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def scan_frame(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All spans of every text: ``doc_id, spans array<struct<kind, start, end>>``."""
    ship_package(df.sparkSession)
    found = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def work(batches):
        for b in (run for whole in batches for run in text_runs(whole)):
            rows = [[dict(zip(("kind", "start", "end"), s)) for s in scan(t.as_py() or "")] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, found)], ["doc_id", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(
        work, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's span counts, digest of the base spans, all spans."""
    ship_package(spark)

    def work(batches):
        for b in (run for whole in batches for run in text_runs(whole)):
            rows = []
            for t in b.column(1):
                found = scan(t.as_py() or "")
                base = [s for s in found if s[0] in BASE_KINDS]
                counts = [sum(s[0] == k for s in base) for k in BASE_KINDS]
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found)))
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                                             ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return docs.mapInArrow(work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
