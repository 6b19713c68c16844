"""Encryption of files: AES and RC4, office packages with agile encryption, PDF security handlers."""

from __future__ import annotations

import base64
import hashlib
import hmac
import os
import re
import struct
from xml.etree import ElementTree as ET

from . import cfb


def _tables() -> tuple[bytes, bytes]:
    """The substitution box by its definition: inverses in the field, then an affine map."""
    exp, log, x = [0] * 256, [0] * 256, 1
    for i in range(255):
        exp[i], log[x] = x, i
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
        x &= 0xFF
    box = bytearray(256)
    for i in range(256):
        b = exp[(255 - log[i]) % 255] if i else 0
        s = b
        for k in range(1, 5):
            s ^= ((b << k) | (b >> (8 - k))) & 0xFF
        box[i] = s ^ 0x63
    back = bytearray(256)
    for i, v in enumerate(box):
        back[v] = i
    return bytes(box), bytes(back)


_BOX, _BACK = _tables()


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out & 0xFF


_MUL = {k: bytes(_times(i, k) for i in range(256)) for k in (2, 3, 9, 11, 13, 14)}
# Where a byte comes from when rows are shifted, for encryption and back.
_SHIFT = [(4 * ((i // 4 + i % 4) % 4) + i % 4) for i in range(16)]
_UNSHIFT = [(4 * ((i // 4 - i % 4) % 4) + i % 4) for i in range(16)]


class AES:
    def __init__(self, key: bytes):
        n = len(key) // 4
        words = [key[4 * i : 4 * i + 4] for i in range(n)]
        self.rounds = n + 6
        rcon = 1
        for i in range(n, 4 * (self.rounds + 1)):
            t = words[-1]
            if i % n == 0:
                t = bytes((_BOX[t[1]] ^ rcon, _BOX[t[2]], _BOX[t[3]], _BOX[t[0]]))
                rcon = _times(rcon, 2)
            elif n > 6 and i % n == 4:
                t = bytes(_BOX[b] for b in t)
            words.append(bytes(a ^ b for a, b in zip(words[-n], t, strict=True)))
        self.keys = [b"".join(words[4 * r : 4 * r + 4]) for r in range(self.rounds + 1)]

    def block(self, data: bytes) -> bytes:
        two, three = _MUL[2], _MUL[3]
        s = [a ^ b for a, b in zip(data, self.keys[0], strict=True)]
        for r in range(1, self.rounds + 1):
            s = [_BOX[s[i]] for i in _SHIFT]
            if r < self.rounds:
                mixed = []
                for c in range(0, 16, 4):
                    a, b, d, e = s[c : c + 4]
                    mixed += [two[a] ^ three[b] ^ d ^ e, a ^ two[b] ^ three[d] ^ e, a ^ b ^ two[d] ^ three[e], three[a] ^ b ^ d ^ two[e]]
                s = mixed
            s = [a ^ b for a, b in zip(s, self.keys[r], strict=True)]
        return bytes(s)

    def unblock(self, data: bytes) -> bytes:
        m9, m11, m13, m14 = (_MUL[k] for k in (9, 11, 13, 14))
        s = [a ^ b for a, b in zip(data, self.keys[-1], strict=True)]
        for r in range(self.rounds - 1, -1, -1):
            s = [_BACK[s[i]] for i in _UNSHIFT]
            s = [a ^ b for a, b in zip(s, self.keys[r], strict=True)]
            if r:
                mixed = []
                for c in range(0, 16, 4):
                    a, b, d, e = s[c : c + 4]
                    mixed += [m14[a] ^ m11[b] ^ m13[d] ^ m9[e], m9[a] ^ m14[b] ^ m11[d] ^ m13[e], m13[a] ^ m9[b] ^ m14[d] ^ m11[e], m11[a] ^ m13[b] ^ m9[d] ^ m14[e]]
                s = mixed
        return bytes(s)

    def cbc(self, data: bytes, iv: bytes) -> bytes:
        out = bytearray()
        for i in range(0, len(data), 16):
            iv = self.block(bytes(a ^ b for a, b in zip(data[i : i + 16], iv, strict=True)))
            out += iv
        return bytes(out)

    def uncbc(self, data: bytes, iv: bytes) -> bytes:
        out = bytearray()
        for i in range(0, len(data) - 15, 16):
            part = data[i : i + 16]
            out += bytes(a ^ b for a, b in zip(self.unblock(part), iv, strict=True))
            iv = part
        return bytes(out)


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(), 0, 0
    for b in data:
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out.append(b ^ s[(s[i] + s[j]) & 255])
    return bytes(out)


# Office packages ---------------------------------------------------------------------------------------------

# Fixed values of the file format: what a derived key is for.
INPUT, VALUE, KEY = bytes.fromhex("fea7d2763b4b9e79"), bytes.fromhex("d7aa0f6d3061344e"), bytes.fromhex("146e0be7abacd0d6")
HMAC_KEY, HMAC_VALUE = bytes.fromhex("5fb2ad010cb9e1f6"), bytes.fromhex("a0677f02b22c8433")
SEGMENT = 4096
_NS = "http://schemas.microsoft.com/office/2006/encryption"
_PASSWORD_NS = "http://schemas.microsoft.com/office/2006/keyEncryptor/password"


class WrongPassword(ValueError):
    pass


def _sized(data: bytes, n: int) -> bytes:
    return data[:n] + b"\x36" * (n - len(data))


def _derived(password: str, salt: bytes, spins: int, name: str) -> bytes:
    h = hashlib.new(name, salt + password.encode("utf-16-le")).digest()
    for i in range(spins):
        h = hashlib.new(name, struct.pack("<I", i) + h).digest()
    return h


def _segments(aes: AES, data: bytes, salt: bytes, name: str, decrypt: bool) -> bytes:
    out = b""
    for k, i in enumerate(range(0, len(data), SEGMENT)):
        iv = _sized(hashlib.new(name, salt + struct.pack("<I", k)).digest(), 16)
        part = data[i : i + SEGMENT]
        out += aes.uncbc(part, iv) if decrypt else aes.cbc(part + bytes(-len(part) % 16), iv)
    return out


def encrypt_package(data: bytes, password: str, spins: int = 100_000, random=os.urandom) -> bytes:
    """A package as a compound file with agile encryption: AES-128 in CBC mode, SHA-512."""
    name, size = "sha512", 16
    key_salt, own_salt, key, verifier, mac_key = random(16), random(16), random(size), random(16), random(64)
    base = _derived(password, own_salt, spins, name)
    locked = lambda block, value: AES(_sized(hashlib.new(name, base + block).digest(), size)).cbc(value + bytes(-len(value) % 16), own_salt)
    aes = AES(key)
    body = struct.pack("<Q", len(data)) + _segments(aes, data, key_salt, name, False)
    iv = lambda block: _sized(hashlib.new(name, key_salt + block).digest(), 16)
    mac = hmac.new(mac_key, body, name).digest()
    b64 = lambda b: base64.b64encode(b).decode()
    common = 'saltSize="16" blockSize="16" keyBits="128" hashSize="64" cipherAlgorithm="AES" cipherChaining="ChainingModeCBC" hashAlgorithm="SHA512"'
    info = (
        f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\r\n<encryption xmlns="{_NS}" xmlns:p="{_PASSWORD_NS}"><keyData {common} saltValue="{b64(key_salt)}"/>'
        f'<dataIntegrity encryptedHmacKey="{b64(aes.cbc(mac_key, iv(HMAC_KEY)))}" encryptedHmacValue="{b64(aes.cbc(mac, iv(HMAC_VALUE)))}"/>'
        f'<keyEncryptors><keyEncryptor uri="{_PASSWORD_NS}"><p:encryptedKey spinCount="{spins}" {common} saltValue="{b64(own_salt)}" encryptedVerifierHashInput="{b64(locked(INPUT, verifier))}" '
        f'encryptedVerifierHashValue="{b64(locked(VALUE, hashlib.new(name, verifier).digest()))}" encryptedKeyValue="{b64(locked(KEY, key))}"/></keyEncryptor></keyEncryptors></encryption>'
    )
    root = cfb.Storage("Root Entry")
    root.put("EncryptionInfo", struct.pack("<HHI", 4, 4, 0x40) + info.encode())
    root.put("EncryptedPackage", body)
    return cfb.build(root)


def is_encrypted(data: bytes) -> bool:
    return data[:8] == cfb.SIGNATURE and cfb.parse(data).stream("EncryptedPackage") is not None


def decrypt_package(data: bytes, password: str) -> bytes:
    """The package of a file with agile encryption; a wrong password raises."""
    root = cfb.parse(data)
    head, body = root.stream("EncryptionInfo") or b"", root.stream("EncryptedPackage") or b""
    if struct.unpack_from("<HH", head) != (4, 4):
        raise ValueError("only agile encryption is read")
    info = ET.fromstring(head[8:])
    key_data = info.find(f"{{{_NS}}}keyData")
    own = next(e for e in info.iter() if e.tag.endswith("}encryptedKey"))
    raw = lambda e, n: base64.b64decode(e.get(n))
    name, size, salt = own.get("hashAlgorithm", "SHA1").lower().replace("-", ""), int(own.get("keyBits")) // 8, raw(own, "saltValue")
    base = _derived(password, salt, min(10_000_000, int(own.get("spinCount"))), name)
    opened = lambda block, n: AES(_sized(hashlib.new(name, base + block).digest(), size)).uncbc(raw(own, n), _sized(salt, 16))
    verifier = opened(INPUT, "encryptedVerifierHashInput")[: int(own.get("saltSize"))]
    want = hashlib.new(name, verifier).digest()
    if opened(VALUE, "encryptedVerifierHashValue")[: len(want)] != want:
        raise WrongPassword("wrong password")
    key = opened(KEY, "encryptedKeyValue")[:size]
    length = struct.unpack_from("<Q", body)[0]
    return _segments(AES(key), body[8:], raw(key_data, "saltValue"), key_data.get("hashAlgorithm", "SHA1").lower().replace("-", ""), True)[:length]


# PDF ---------------------------------------------------------------------------------------------------------

# The fixed padding of passwords.
PAD = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")


def _padded(password: str) -> bytes:
    return (password.encode("latin-1", "replace") + PAD)[:32]


def _owner(owner: str, user: str, revision: int) -> bytes:
    h = hashlib.md5(_padded(owner or user)).digest()
    for _ in range(50):
        h = hashlib.md5(h).digest()
    out = _padded(user)
    for i in range(20):
        out = rc4(bytes(b ^ i for b in h), out)
    return out


def _file_key(user: str, owner_entry: bytes, permissions: int, file_id: bytes) -> bytes:
    h = hashlib.md5(_padded(user) + owner_entry + struct.pack("<i", permissions) + file_id).digest()
    for _ in range(50):
        h = hashlib.md5(h).digest()
    return h


def _user(key: bytes, file_id: bytes) -> bytes:
    out = hashlib.md5(PAD + file_id).digest()
    for i in range(20):
        out = rc4(bytes(b ^ i for b in key), out)
    return out + bytes(16)


def _hash_r6(password: bytes, salt: bytes, more: bytes = b"") -> bytes:
    """The hardened hash of revision 6."""
    k, i = hashlib.sha256(password + salt + more).digest(), 0
    while True:
        e = AES(k[:16]).cbc((password + k + more) * 64, k[16:32])
        k = hashlib.new(("sha256", "sha384", "sha512")[sum(e[:16]) % 3], e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


class Handler:
    """A security handler: what it adds to the file, and how it changes strings and streams of an object."""

    def __init__(self, method: str, user: str, owner: str = "", permissions: int = -44, random=os.urandom):
        self.method, self.random = method, random
        self.file_id = random(16)
        if method == "aes256":
            self.key = random(32)
            self.entries = self._r6(user, owner, permissions)
            return
        o = _owner(owner, user, 3)
        self.key = _file_key(user, o, permissions, self.file_id)
        u = _user(self.key, self.file_id)
        if method == "rc4":
            self.entries = f"/Filter /Standard /V 2 /R 3 /Length 128 /P {permissions} /O <{o.hex()}> /U <{u.hex()}>"
        else:
            self.entries = f"/Filter /Standard /V 4 /R 4 /Length 128 /P {permissions} /O <{o.hex()}> /U <{u.hex()}> /CF << /StdCF << /CFM /AESV2 /AuthEvent /DocOpen /Length 16 >> >> /StmF /StdCF /StrF /StdCF"

    def _r6(self, user: str, owner: str, permissions: int) -> str:
        pw, opw = user.encode()[:127], (owner or user).encode()[:127]
        a, b, c, d = (self.random(8) for _ in range(4))
        u = _hash_r6(pw, a) + a + b
        ue = AES(_hash_r6(pw, b)).cbc(self.key, bytes(16))
        o = _hash_r6(opw, c, u) + c + d
        oe = AES(_hash_r6(opw, d, u)).cbc(self.key, bytes(16))
        perms = AES(self.key).block(struct.pack("<i", permissions) + b"\xff\xff\xff\xffTadb" + self.random(4))
        return f"/Filter /Standard /V 5 /R 6 /Length 256 /P {permissions} /O <{o.hex()}> /U <{u.hex()}> /OE <{oe.hex()}> /UE <{ue.hex()}> /Perms <{perms.hex()}> /CF << /StdCF << /CFM /AESV3 /AuthEvent /DocOpen /Length 32 >> >> /StmF /StdCF /StrF /StdCF"

    def _object_key(self, number: int, generation: int) -> bytes:
        return object_key(self.key, self.method, number, generation)

    def encrypt(self, data: bytes, number: int, generation: int = 0) -> bytes:
        key = self._object_key(number, generation)
        if self.method == "rc4":
            return rc4(key, data)
        iv, pad = self.random(16), 16 - len(data) % 16
        return iv + AES(key).cbc(data + bytes([pad]) * pad, iv)


def object_key(key: bytes, method: str, number: int, generation: int) -> bytes:
    if method == "aes256":
        return key
    return hashlib.md5(key + struct.pack("<I", number)[:3] + struct.pack("<I", generation)[:2] + (b"sAlT" if method == "aes128" else b"")).digest()[:16]


def encrypt_pdf(data: bytes, user: str, owner: str = "", method: str = "aes128", random=os.urandom) -> bytes:
    """A file of pdf.Writer with every string and stream encrypted: rc4, aes128 or aes256."""
    h = Handler(method, user, owner, random=random)
    objects = [(int(m[1]), m[2]) for m in re.finditer(rb"(?:^|\n)([0-9]+) 0 obj\n(.*?)\nendobj(?=\n)", data, re.DOTALL)]
    trailer = re.search(rb"/Root ([0-9]+) 0 R /Info ([0-9]+) 0 R", data)
    out, places = bytearray(data[: data.index(b"1 0 obj")]), {}
    for number, body in objects:
        m = re.search(rb"\nstream\n(.*)\nendstream$", body, re.DOTALL)
        head, raw = (body[: m.start()], m[1]) if m else (body, None)
        head = re.sub(rb"(?<!<)<([0-9a-f]*)>(?!>)", lambda s, n=number: b"<" + h.encrypt(bytes.fromhex(s[1].decode()), n).hex().encode() + b">", head)
        if raw is not None:
            raw = h.encrypt(raw, number)
            head = re.sub(rb"/Length [0-9]+", b"/Length %d" % len(raw), head, count=1)
            body = head + b"\nstream\n" + raw + b"\nendstream"
        else:
            body = head
        places[number] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    lock = max(places) + 1
    places[lock] = len(out)
    out += b"%d 0 obj\n<< %s >>\nendobj\n" % (lock, h.entries.encode())
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (lock + 1) + b"".join(b"%010d 00000 n \n" % places[k] for k in range(1, lock + 1))
    ident = h.file_id.hex().encode()
    out += b"trailer\n<< /Size %d /Root %s 0 R /Info %s 0 R /Encrypt %d 0 R /ID [<%s> <%s>] >>\nstartxref\n%d\n%%%%EOF\n" % (lock + 1, trailer[1], trailer[2], lock, ident, ident, start)
    return bytes(out)


class Opened:
    """How a file's strings and streams are decrypted, from its encryption dictionary and a password."""

    def __init__(self, entries: dict, file_id: bytes, password: str):
        revision = entries.get("R", 0)
        o, u = entries.get("O", b""), entries.get("U", b"")
        if revision >= 5:
            self.method = "aes256"
            self.key = self._r6(entries, password.encode()[:127], o, u)
            return
        name = (entries.get("CF") or {}).get(entries.get("StmF", ""), {}).get("CFM", "V2")
        self.method = "aes128" if name == "AESV2" else "rc4"
        for pw in (password, self._user_password(password, o)):
            self.key = _file_key(pw, o[:32], entries.get("P", 0), file_id)
            if _user(self.key, file_id)[:16] == u[:16]:
                return
        raise WrongPassword("wrong password")

    @staticmethod
    def _user_password(owner: str, entry: bytes) -> str:
        h = hashlib.md5(_padded(owner)).digest()
        for _ in range(50):
            h = hashlib.md5(h).digest()
        out = entry[:32]
        for i in range(19, -1, -1):
            out = rc4(bytes(b ^ i for b in h), out)
        return out.decode("latin-1")

    @staticmethod
    def _r6(entries: dict, pw: bytes, o: bytes, u: bytes) -> bytes:
        if _hash_r6(pw, u[32:40]) == u[:32]:
            return AES(_hash_r6(pw, u[40:48])).uncbc(entries["UE"], bytes(16))
        if _hash_r6(pw, o[32:40], u[:48]) == o[:32]:
            return AES(_hash_r6(pw, o[40:48], u[:48])).uncbc(entries["OE"], bytes(16))
        raise WrongPassword("wrong password")

    def decrypt(self, data: bytes, number: int, generation: int) -> bytes:
        key = object_key(self.key, self.method, number, generation)
        if self.method == "rc4":
            return rc4(key, data)
        if len(data) < 32:
            return b""
        plain = AES(key).uncbc(data[16:], data[:16])
        return plain[: -plain[-1]] if 1 <= plain[-1] <= 16 else plain
