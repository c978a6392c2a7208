"""Operator 5: key blocks of OpenSSH, with header lines, and encrypted ones."""

import base64

from sparkloom.llm import secrets


def test_key_blocks():
    block = lambda name, raw, headers="": f"-----BEGIN {name}-----\n{headers}{base64.encodebytes(raw).decode()}-----END {name}-----"
    encrypted = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF\n\n"
    found = lambda t: [(a, b) for k, a, b in secrets.find_secrets(t) if k == "block"]
    for t in (block("OPENSSH PRIVATE KEY", b"openssh-key-v1\0" + bytes(90)), block("RSA PRIVATE KEY", bytes(range(64, 144)), encrypted), block("RSA PRIVATE KEY", b"\x30\x82" + bytes(80), "Comment: x\n"), block("PRIVATE KEY", b"\x30\x82" + bytes(80))):
        assert found("x " + t) == [(2, 2 + len(t))]
    for t in (block("OPENSSH PRIVATE KEY", bytes(90)), block("RSA PRIVATE KEY", bytes(80)), block("RSA PRIVATE KEY", bytes(81), encrypted), block("PRIVATE KEY", b"openssh-key-v1\0" + bytes(90))):
        assert found(t) == []
