"""Secret scans: an Aho-Corasick pass finds keywords, anchored regular expressions look only where a keyword was found, and
checksums that a secret carries in itself decide where it has them."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Callable
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import fresh

_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: str) -> str:
    """CRC-32 of the body in six base-62 digits, as code-hosting tokens end with."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = _B62[d] + out
    return out.rjust(6, "0")


def _crc_ok(m: re.Match) -> bool:
    body = m["secret"].rpartition("_")[2]
    return base62_crc(body[:-6]) == body[-6:]


def _jwt_ok(m: re.Match) -> bool:
    try:
        head, body = (json.loads(base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))) for x in m["secret"].split(".")[:2])
    except (ValueError, binascii.Error):
        return False
    return isinstance(head, dict) and "alg" in head and isinstance(body, dict)


def _pem_ok(m: re.Match) -> bool:
    """The DER sequence says how long it is."""
    try:
        der = base64.b64decode(re.sub(r"\s", "", m["body"]), validate=True)
    except (ValueError, binascii.Error):
        return False
    if der.startswith(b"openssh-key-v1\0"):
        return True
    if len(der) < 2 or der[0] != 0x30:
        return False
    n = der[1] & 0x7F if der[1] & 0x80 else 0
    size = int.from_bytes(der[2 : 2 + n], "big") if n else der[1]
    return n <= 4 and 2 + n + size == len(der)


def _varied(m: re.Match) -> bool:
    """Not a placeholder: letters or digits of at least 7 kinds, with a digit. All that tells an assigned value, quoted or up to white space."""
    s = m["secret"]
    return len(set(s.lower())) >= 7 and any(c.isdigit() for c in s)


class Rule(NamedTuple):
    kind: str
    keywords: tuple[str, ...]  # in lower case; the regular expression is anchored where one of them starts
    pattern: re.Pattern
    check: Callable[[re.Match], bool] | None


_C = re.compile
RULES = (
    Rule("access_key_id", ("akia", "asia"), _C(r"(?<![A-Z0-9])(?P<secret>A[KS]IA[A-Z2-7]{16})(?![A-Z0-9])"), None),
    Rule("code_host_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), _C(r"(?<![A-Za-z0-9])(?P<secret>gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])"), _crc_ok),
    Rule("package_token", ("npm_",), _C(r"(?<![A-Za-z0-9])(?P<secret>npm_[A-Za-z0-9]{36})(?![A-Za-z0-9])"), _crc_ok),
    Rule("chat_token", ("xoxb-", "xoxp-", "xoxa-", "xoxr-"), _C(r"(?P<secret>xox[abpr]-[0-9]{8,14}-[0-9A-Za-z-]{16,})"), None),
    Rule("payment_key", ("sk_live_", "rk_live_"), _C(r"(?P<secret>[sr]k_live_[0-9A-Za-z]{20,})"), None),
    Rule("maps_key", ("aiza",), _C(r"(?P<secret>AIza[0-9A-Za-z_-]{35})(?![0-9A-Za-z_-])"), None),
    Rule("web_token", ("eyj",), _C(r"(?<![A-Za-z0-9_-])(?P<secret>eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*)"), _jwt_ok),
    Rule("private_key", ("-----begin",), _C(r"(?P<secret>-----BEGIN (?P<label>[A-Z ]*PRIVATE KEY)-----(?P<body>[A-Za-z0-9+/=\s]+)-----END (?P=label)-----)"), _pem_ok),
    Rule("assigned", ("token", "secret", "passwd", "password", "api_key", "apikey", "api-key", "access_key"), _C(r"""(?i:token|secret|passwd|password|api[_-]?key|access_key)[A-Za-z0-9_-]{0,40}["']?[ \t]{0,4}(?:=|:|:=|=>)[ \t]{0,4}(?P<q>["'])?(?P<secret>[A-Za-z0-9+/_.=-]{16,})(?(q)(?P=q)|(?=[\s,;]|\Z))"""), _varied),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules, self.automaton = rules, ahocorasick.Automaton()
        by: dict[str, list[int]] = {}
        for k, rule in enumerate(rules):
            for word in rule.keywords:
                by.setdefault(word, []).append(k)
        for word, ks in by.items():
            self.automaton.add_word(word, (len(word), tuple(ks)))
        self.automaton.make_automaton()

    @staticmethod
    def lower(text: str) -> str:
        """Lower case that keeps every place; the few letters whose lower case is longer stay as they are."""
        low = text.lower()
        return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) of the secrets, by start, none within an earlier one; where two start alike the longer counts."""
        found = []
        for end, (size, ks) in self.automaton.iter(self.lower(text)):
            for k in ks:
                m = self.rules[k].pattern.match(text, end + 1 - size)
                if m and (self.rules[k].check is None or self.rules[k].check(m)):
                    found.append((m.start("secret"), -m.end("secret"), self.rules[k].kind))
        out, last = [], 0
        for start, end, kind in sorted(set(found)):
            if start >= last:
                out.append((kind, start, -end))
                last = -end
        return out


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, digest): every secret by character offsets; the SHA-256 stands for it, so that the result
    doesn't leak it. Null and empty texts have none; a null doc_id is kept; a repeated row gives its secrets again. Only
    doc_id and text are read."""

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            ids, out = batch.column(0), []
            for r, text in enumerate(batch.column(1)):
                text = text.as_py()
                if text:
                    out += [(ids[r].as_py(), kind, a, b, hashlib.sha256(text[a:b].encode()).hexdigest()) for kind, a, b in scanner.scan(text)]
            cols = list(zip(*out)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "kind", "start", "end", "digest"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id bigint, kind string, start bigint, end bigint, digest string")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret replaced by ``[kind]`` and n_chars, where that column exists and the text changed, counted anew;
    every row stays, and null texts stay null."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        """The redacted text, or null where nothing is to change."""
        scanner, out = Scanner(), []
        for text in texts:
            text = text.as_py()
            found = scanner.scan(text) if text else []
            if not found:
                out.append(None)
                continue
            parts, last = [], 0
            for kind, a, b in found:
                parts += [text[last:a], f"[{kind}]"]
                last = b
            out.append("".join(parts) + text[last:])
        return pa.array(out, pa.string())

    new = fresh(docs, "_redacted")
    changed = docs.withColumn(new, clean(docs["text"]))
    replaced = {"text": F.coalesce(F.col(new), F.col("text"))}
    if "n_chars" in docs.columns:
        replaced["n_chars"] = F.when(F.col(new).isNull(), F.col("n_chars")).otherwise(F.length(new).cast(docs.schema["n_chars"].dataType))
    return changed.select(*[replaced[c].alias(c) if c in replaced else F.col(f"`{c}`") for c in docs.columns])
