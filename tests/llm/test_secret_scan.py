"""Secret scan against a plain reading of the base rules, and built keys."""

import base64
import json
import re

from hypothesis import given, settings, strategies as st

from lakeaudit.llm import secret_scan as S

from .conftest import EDGE


def plain_base(text):
    """Leftmost matches per kind, as the rules say, without shortcuts."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append(("assign", m.start(), m.end()))
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], S.ORDER[s[0]]))


PARTS = ["password", "PassWD", "secret", "toKen", "api_key", "APIKEY", "ſecret", "to\u212aen", "=", ":", " ", "'", '"', "\n",
         "abcdef", "abc", "AKIA", "0123456789ABCDEF", "0123456789abcdef", "deadbeef", "é", "x.y/z+", "-", "AKI"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_base_spans(text):
    assert [s for s in S.scan(text) if s[0] in S.BASE_KINDS] == plain_base(text)


def tlv(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")
    return bytes([tag]) + size + body


def integer(n, size):
    return tlv(2, bytes([n]) * size)


RSA = tlv(0x30, integer(0, 1) + b"".join(integer(7, k) for k in (128, 3, 128, 64, 64, 64, 64, 64)))
PKCS8 = tlv(0x30, integer(0, 1) + tlv(0x30, tlv(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01") + b"\x05\x00") + tlv(4, RSA))
EC = tlv(0x30, integer(1, 1) + tlv(4, b"k" * 32) + tlv(0xA0, tlv(6, b"\x2a\x86\x48\xce\x3d\x03\x01\x07")))
SSH = b"openssh-key-v1\x00" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big") + b"rest"
PUBLIC = tlv(0x30, tlv(0x30, tlv(6, b"\x2a\x86\x48") + b"\x05\x00") + tlv(3, b"\x00" + b"z" * 70))


def kinds(text):
    return [s for s in S.scan(text) if s[0] not in S.BASE_KINDS]


def test_keys_are_confirmed_by_structure():
    for key in (RSA, PKCS8, EC, SSH):
        b64 = base64.b64encode(key).decode()
        assert kinds(f"see {b64} there") == [("key64", 4, 4 + len(b64))]
        pem = "-----BEGIN PRIVATE KEY-----\n" + "\n".join(b64[i:i + 64] for i in range(0, len(b64), 64)) + "\n-----END PRIVATE KEY-----"
        assert ("pem", 1, 1 + len(pem)) in kinds(" " + pem)
        if len(key.hex()) >= 80:
            assert kinds(f"k={key.hex().upper()}.") == [("keyhex", 2, 2 + len(key.hex()))]


def test_what_does_not_parse_is_left():
    for key in (PUBLIC, RSA[:-1], RSA + b"x", b"\x30\x82\xff\xff" + RSA, PKCS8[:40], b"q" * 90, SSH[:20], b"\x30\x80" + b"0" * 50):
        assert kinds(base64.b64encode(key).decode()) == []
        assert kinds(key.hex()) == []


def segment(x):
    return base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")


def test_signed_tokens():
    ok = f"{segment({'alg': 'HS256', 'typ': 'JWT'})}.{segment({'sub': 'u'})}.c2lnbmF0dXJl"
    assert kinds(f"id {ok},") == [("jwt", 3, 3 + len(ok))]
    assert kinds(f"{segment({'typ': 'JWT'})}.{segment({'sub': 'u'})}.x") == []
    assert kinds(f"{segment({'alg': 5})}.{segment({'sub': 'u'})}.x") == []
    assert kinds(f"{segment({'alg': 'HS256'})}.bm90IGpzb24.x") == []
    assert kinds("eyJhbGciOi.eyJ.x eyJ.. eyJ") == []


def test_frame_and_edge_rows(spark, edge_docs, no_docs):
    rows = sorted((r.doc_id, [tuple(s) for s in r.spans]) for r in S.scan_frame(edge_docs).collect())
    assert rows == sorted((i, S.scan(t or "")) for i, t, _ in EDGE)
    assert S.scan_frame(no_docs).count() == 0


def test_query_against_plain_reading(spark):
    import hashlib

    from .conftest import SF001

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = S.op10_secrets(spark, SF001).collect()
    assert len(got) == len(docs)
    for r in got:
        base = plain_base(docs[r.doc_id] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in base) for k in S.BASE_KINDS)
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def wrap(text, width, sep="\n"):
    return sep.join(text[i:i + width] for i in range(0, len(text), width))


def test_keys_wrapped_over_lines():
    for key in (RSA, PKCS8, EC, SSH):
        for coded, kind, widths in ((base64.b64encode(key).decode(), "key64", (40, 64, 76)), (key.hex(), "keyhex", (32, 64))):
            if kind == "keyhex" and key is SSH:
                continue
            for width in widths:
                if len(coded) <= width:
                    continue
                for sep in ("\n", "\r\n", "\n    "):
                    body = wrap(coded, width, sep)
                    for after in ("", "\nand then prose", "\nword", " x"):
                        text = f"key: {body}{after}"
                        assert (kind, 5, 5 + len(body)) in kinds(text), (kind, width, sep, after)
    b64 = base64.b64encode(RSA).decode()
    assert kinds(wrap(b64[:-8] + "AAAA", 64)) == []  # a length that does not add up
    assert kinds(wrap(base64.b64encode(PUBLIC).decode(), 48)) == []
    assert kinds(wrap(b64, 64).replace("\n", "\n-- ")) == []
    two = wrap(b64, 64) + "\n\n" + wrap(b64, 64)
    assert [k for k, _, _ in kinds(two)] == ["key64", "key64"]


def test_pem_with_header_lines():
    plain, cipher = wrap(base64.b64encode(RSA).decode(), 64), wrap(base64.b64encode(b"\x91" * 608).decode(), 64)

    def pem(head, body):
        return f"-----BEGIN RSA PRIVATE KEY-----\n{head}{body}\n-----END RSA PRIVATE KEY-----"

    dek = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF\n\n"
    for head, body in ((dek, cipher), ("Comment: two\n  lines\n", plain), (dek.replace("\n", "\r\n"), cipher.replace("\n", "\r\n"))):
        text = pem(head, body)
        assert ("pem", 2, 2 + len(text)) in kinds("x " + text)
        assert ("pem", 0, len(text.replace("\n", "\\n"))) in kinds(text.replace("\r", "").replace("\n", "\\n")) or "\r" in text
    for head, body in (("Proc-Type: 4,ENCRYPTED\n\n", cipher), (dek, cipher + "AAAA"), ("Comment: x\n", cipher), ("no header\n", plain)):
        assert not [k for k in kinds(pem(head, body)) if k[0] == "pem"]
