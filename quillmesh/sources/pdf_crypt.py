"""The standard security handler of PDF files, for reading: RC4 and AES, revisions 2 to 6, with a user password (mostly empty)."""

from __future__ import annotations

import hashlib
import struct

import numpy as np

#: Fixed value: what passwords are padded with.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def _boxes() -> tuple[list[int], list[int]]:
    """The substitution of AES and its inverse, from inverses in the field of 256 elements."""
    box, p, q = [0] * 256, 1, 1
    while True:
        p ^= (p << 1 & 255) ^ (0x1B if p & 128 else 0)  # times 3
        for shift in (1, 2, 4):  # divided by 3
            q ^= q << shift & 255
        q ^= 9 if q & 128 else 0
        turns = [(q << k | q >> 8 - k) & 255 for k in range(5)]
        box[p] = turns[0] ^ turns[1] ^ turns[2] ^ turns[3] ^ turns[4] ^ 0x63
        if p == 1:
            break
    box[0] = 0x63
    back = [0] * 256
    for i, v in enumerate(box):
        back[v] = i
    return box, back


def times(a: int, b: int) -> int:
    """The product of two elements of the field."""
    out = 0
    while b:
        out, a, b = out ^ (a if b & 1 else 0), (a << 1 & 255) ^ (0x1B if a & 128 else 0), b >> 1
    return out


BOX, BACK = _boxes()
PRODUCTS = {k: np.array([times(k, x) for x in range(256)], np.uint8) for k in (9, 11, 13, 14)}
TWICE = [times(2, x) for x in range(256)]
#: Where each byte of a block (columns of four) comes from when rows turn left, and right.
LEFT = [(i + 4 * (i % 4)) % 16 for i in range(16)]
RIGHT = [(i - 4 * (i % 4)) % 16 for i in range(16)]


def round_keys(key: bytes) -> list[bytes]:
    n, words = len(key) // 4, [key[i : i + 4] for i in range(0, len(key), 4)]
    power = 1
    for i in range(n, 4 * (n + 7)):
        w = words[-1]
        if i % n == 0:
            w = bytes(BOX[b] for b in w[1:] + w[:1])
            w, power = bytes([w[0] ^ power]) + w[1:], times(power, 2)
        elif n > 6 and i % n == 4:
            w = bytes(BOX[b] for b in w)
        words.append(bytes(a ^ b for a, b in zip(words[i - n], w)))
    return [b"".join(words[i : i + 4]) for i in range(0, len(words), 4)]


def cbc_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """Whole blocks; one after the other, as chaining needs."""
    keys, out, last = round_keys(key), [], iv
    for at in range(0, len(data), 16):
        s = [a ^ b ^ c for a, b, c in zip(data[at : at + 16], last, keys[0])]
        for k in keys[1:-1]:
            s = [BOX[s[i]] for i in LEFT]
            mixed = []
            for c in range(0, 16, 4):
                col = s[c : c + 4]
                whole = col[0] ^ col[1] ^ col[2] ^ col[3]
                mixed += [col[i] ^ whole ^ TWICE[col[i] ^ col[(i + 1) % 4]] for i in range(4)]
            s = [a ^ b for a, b in zip(mixed, k)]
        last = bytes(BOX[s[i]] ^ b for i, b in zip(LEFT, keys[-1]))
        out.append(last)
    return b"".join(out)


def cbc_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """Whole blocks, all at once: only the last exclusive-or needs a block's predecessor."""
    if not data:
        return b""
    keys, back = [np.frombuffer(k, np.uint8) for k in round_keys(key)], np.array(BACK, np.uint8)
    blocks = np.frombuffer(data, np.uint8).reshape(-1, 16)
    s = blocks ^ keys[-1]
    for k in keys[-2:0:-1]:
        s = (back[s[:, RIGHT]] ^ k).reshape(-1, 4, 4)
        s = np.stack([PRODUCTS[14][s[..., i]] ^ PRODUCTS[11][s[..., (i + 1) % 4]] ^ PRODUCTS[13][s[..., (i + 2) % 4]] ^ PRODUCTS[9][s[..., (i + 3) % 4]] for i in range(4)], -1).reshape(-1, 16)
    s = back[s[:, RIGHT]] ^ keys[0]
    before = np.vstack([np.frombuffer(iv, np.uint8)[None], blocks[:-1]])
    return (s ^ before).tobytes()


def unwrap(key: bytes, data: bytes) -> bytes:
    """A string or stream: the first block is the initial vector, the last byte tells the padding. Torn blocks at the end are left out."""
    whole = len(data) // 16 * 16
    plain = cbc_decrypt(key, data[:16], data[16:whole]) if whole > 16 else b""
    return plain[: -plain[-1]] if plain and 1 <= plain[-1] <= 16 else plain


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for at, byte in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[at] = byte ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def hardened(password: bytes, salt: bytes, revision: int) -> bytes:
    """The digest of revisions 5 (plain) and 6 (at least 64 rounds of encryption and a digest that it picks)."""
    k = hashlib.sha256(password + salt).digest()
    n = 0
    while revision >= 6:
        e = cbc_encrypt(k[:16], k[16:32], (password + k) * 64)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        n += 1
        if n >= 64 and e[-1] <= n - 32:
            break
    return k[:32]


class Handler:
    """Decrypts the strings and streams of one file. entries: its encryption dictionary; ident: the first part of its id."""

    def __init__(self, entries: dict, ident: bytes, password: bytes = b""):
        get = lambda name, default: entries[name] if isinstance(entries.get(name), type(default)) else default
        self.version, self.revision = get("V", 0), get("R", 2)
        if entries.get("Filter") != "Standard" or self.version not in (1, 2, 4, 5):
            raise ValueError("encryption not supported")
        self.metadata = get("EncryptMetadata", True)
        filters = get("CF", {})
        method = lambda name: (filters.get(entries.get(name)) or {}).get("CFM", "None") if self.version >= 4 else "V2"
        self.methods = {"string": method("StrF"), "stream": method("StmF")}
        owner, user = get("O", b""), get("U", b"")
        if self.version == 5:
            if hardened(password, user[32:40], self.revision) != user[:32]:
                raise ValueError("password needed")
            self.key = cbc_decrypt(hardened(password, user[40:48], self.revision), bytes(16), get("UE", b"")[:32])
            return
        n = 5 if self.revision == 2 else 16 if self.version == 4 else max(5, min(16, get("Length", 40) // 8))
        flags = struct.pack("<I", get("P", 0) & 0xFFFFFFFF)
        k = hashlib.md5((password + PAD)[:32] + owner[:32] + flags + ident + (b"\xff" * 4 if self.revision >= 4 and not self.metadata else b"")).digest()
        for _ in range(50 if self.revision >= 3 else 0):
            k = hashlib.md5(k[:n]).digest()
        self.key = k[:n]
        if self.revision == 2:
            proof, kept = rc4(self.key, PAD), user[:32]
        else:
            proof, kept = hashlib.md5(PAD + ident).digest(), user[:16]
            for i in range(20):
                proof = rc4(bytes(b ^ i for b in self.key), proof)
        if proof != kept:
            raise ValueError("password needed")

    def open(self, data: bytes, oid: int, generation: int, what: str) -> bytes:
        """what: string or stream."""
        method = self.methods[what]
        if method == "AESV3":
            return unwrap(self.key, data)
        if method not in ("V2", "AESV2"):
            return data
        aes = method == "AESV2"
        own = hashlib.md5(self.key + struct.pack("<I", oid)[:3] + struct.pack("<I", generation)[:2] + (b"sAlT" if aes else b"")).digest()[: min(len(self.key) + 5, 16)]
        return unwrap(own, data) if aes else rc4(own, data)

    def strings(self, value, oid: int, generation: int):
        """A value with its strings decrypted; containers change in place."""
        if isinstance(value, bytes):
            return self.open(value, oid, generation, "string")
        stack = [value]
        while stack:
            v = stack.pop()
            for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
                if isinstance(x, bytes):
                    v[k] = self.open(x, oid, generation, "string")
                else:
                    stack.append(x)
        return value
