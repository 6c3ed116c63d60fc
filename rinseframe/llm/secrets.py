"""Secret scan: a keyword automaton finds where a secret may start, anchored patterns look only there.

An Aho-Corasick automaton passes once over the lowered bytes of a text. At each keyword an anchored pattern decides;
tokens with an embedded checksum are recomputed, so that look-alikes are not reported. Long runs of hexadecimal
digits have no keyword: a run of that length is itself the trigger.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib

from pyspark.sql import DataFrame

from rinseframe.llm.common import map_texts

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "private_key")

# The words that announce an assignment, the prefixes of tokens, and what may follow them.
_ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_GITHUB = re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_NPM = re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_JWT = re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+")
_PRIVATE = re.compile(rb"-----BEGIN ([A-Z ]*)PRIVATE KEY-----\s*([A-Za-z0-9+/=\s]+?)\s*-----END \1PRIVATE KEY-----")
_TRIGGERS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",), "jwt": ("eyj",), "private_key": ("-----begin ",),
}
_BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Fewest characters of an assigned value, of an access key, of a hexadecimal run.
ASSIGNED, ACCESS, HEX = 6, 20, 24


def checksum(body: bytes) -> bytes:
    """crc32 in six base-62 digits, as it ends a token."""
    n, out = zlib.crc32(body), []
    for _ in range(6):
        n, digit = divmod(n, 62)
        out.append(_BASE62[digit])
    return bytes(reversed(out))


def _checked(m: re.Match) -> bool:
    return checksum(m[1]) == m[2]


def _json_object(part: bytes) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4))), dict)
    except (ValueError, binascii.Error, RecursionError):
        return False


def _base64_body(body: bytes) -> bool:
    try:
        return len(base64.b64decode(b"".join(body.split()), validate=True)) > 0
    except (ValueError, binascii.Error):
        return False


_RULES = {
    "assign": (_ASSIGN, lambda m: len(m[1]) >= ASSIGNED), "access": (_ACCESS, lambda m: len(m[0]) >= ACCESS),
    "github": (_GITHUB, _checked), "npm": (_NPM, _checked),
    "jwt": (_JWT, lambda m: _json_object(m[1]) and _json_object(m[2])),
    "private_key": (_PRIVATE, lambda m: _base64_body(m[2])),
}


class Scanner:
    def __init__(self):
        import ahocorasick

        self.keywords = ahocorasick.Automaton()
        for kind, words in _TRIGGERS.items():
            for word in words:
                self.keywords.add_word(word, (kind, len(word)))
        self.keywords.make_automaton()

    def find(self, text: bytes) -> list[tuple[int, int, str]]:
        """(start, end, kind) in code points, by start, then by the order of KINDS.

        Of each kind the matches are the leftmost ones that do not overlap; one that fails its test still uses
        up its text.
        """
        spans, past = [], dict.fromkeys(_TRIGGERS, 0)
        # One letter a byte, so that places in the automaton's text are places in the bytes.
        for last, (kind, n) in self.keywords.iter(text.lower().decode("latin-1")):
            start = last + 1 - n
            if start < past[kind]:
                continue
            pattern, valid = _RULES[kind]
            if m := pattern.match(text, start):
                past[kind] = m.end()
                if valid(m):
                    spans.append((start, m.end(), kind))
        spans += [(*m.span(), "hex") for m in _HEX.finditer(text)]
        if spans and not text.isascii():
            spans = _code_points(text, spans)
        return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _code_points(text: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    marks, places, at, count = sorted({x for s in spans for x in s[:2]}), {}, 0, 0
    for mark in marks:
        count += len(text[at:mark].decode())
        places[mark] = count
        at = mark
    return [(places[a], places[b], kind) for a, b, kind in spans]


def scan(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document: ``keep`` columns and ``starts``, ``ends``, ``kinds`` (arrays in the order of starts).

    Places are code points, ends exclusive. Null and empty texts have no spans; rows are independent of each other.
    Tokens whose checksum fails are left out (kinds github, npm, jwt, private_key).
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep

    def make():
        scanner = Scanner()

        def work(texts):
            found = [scanner.find(value or b"") for value in texts]
            return {"starts": [[s[0] for s in x] for x in found], "ends": [[s[1] for s in x] for x in found], "kinds": [[s[2] for s in x] for x in found]}

        return work

    return map_texts(docs, make, {"starts": "longs", "ends": "longs", "kinds": "strings"}, keep, text)
