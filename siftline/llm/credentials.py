"""Literal credentials in source and configuration text: find and mask.

Each chunk is scanned once by a keyword automaton.  Only lines with a keyword are tried
against the rules: issuer formats, private-key blocks, passwords inside addresses,
authorization headers, and values bound to a name that ends in a secret word.  Structure
checks (JWT segments, base64 body of a key block, strength of the value) and a list of
placeholder forms decide; ``checked`` says that an issuer's checksum (CRC-32 in base 62) or the structure
was verified.  A value is masked by characters of its own alphabet, so length and
alphabet stay and the code around it is unchanged; a mask is no credential when scanned again.

Defined results: null or empty content gives no finding and is returned as it is; a repeated
chunk gives repeated findings from ``find`` and one row from ``found``; a null path is an
unknown file type; extra columns do not matter; very long lines are scanned whole.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.files import assemble
from siftline.session import spread

# Formats of public and private issuers: (keyword in lower case, kind, pattern).
ISSUERS = [
    ("akia", "aws", r"AKIA[0-9A-Z]{16}"),
    ("asia", "aws", r"ASIA[0-9A-Z]{16}"),
    ("ghp_", "github", r"ghp_[A-Za-z0-9]{36}"),
    ("gho_", "github", r"gho_[A-Za-z0-9]{36}"),
    ("ghs_", "github", r"ghs_[A-Za-z0-9]{36}"),
    ("github_pat_", "github", r"github_pat_[A-Za-z0-9_]{50,}"),
    ("glpat-", "gitlab", r"glpat-[A-Za-z0-9_\-]{20,}"),
    ("xox", "slack", r"xox[abprs]-[A-Za-z0-9\-]{20,}"),
    ("aiza", "google", r"AIza[A-Za-z0-9_\-]{35}"),
    ("npm_", "npm", r"npm_[A-Za-z0-9]{36}"),
    ("_live_", "live", r"[a-z]{2,5}_live_[A-Za-z0-9]{20,}"),
    ("_sk_", "sk", r"[a-z]{2,5}_sk_[A-Za-z0-9]{20,}"),
    ("_pat_", "pat", r"[a-z]{2,5}_pat_[A-Za-z0-9]{20,}"),
    ("qrt-", "qrt", r"qrt-[A-Za-z0-9]{24,}"),
    ("-prod-", "prod", r"[a-z]{2,5}-prod-[A-Za-z0-9]{20,}"),
    ("-live-", "live", r"[a-z]{2,5}-live-[A-Za-z0-9]{20,}"),
    ("eyj", "jwt", r"eyJ[A-Za-z0-9_\-]{10,}\.eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{20,}"),
]
# Words that make a line worth testing: every rule needs one of them on the line it begins in, or a split issuer format (SPLIT).
KEYWORDS = [k for k, _, _ in ISSUERS] + [
    "pass", "pwd", "secret", "token", "credential", "key", "bearer ", "basic ", "login", "auth", "://",
    "signin(", "sign_in(", "connect(", "--user", "-u ",
]

_LITERAL = r"(?:\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)"
_JOINED = rf"{_LITERAL}(?:\s*[+.\\]?\s*{_LITERAL})*"
# How the literals of one value go on behind the lines looked at: by an operator, side by side in brackets, as arguments.
ADDED, ADJOINED, LISTED = (re.compile(rf"(?:{joint}{_LITERAL})*") for joint in (r"\s*(?:[+.]|\\\n)\s*", r"\s*[+.\\]?\s*", r"\s*[+,.\\]?\s*"))
SPLIT = re.compile(r"[\"'`]\s*[+,.\\]?\s*[\"'`]")
_ISSUED = re.compile("|".join(re.escape(k) for k, _, _ in ISSUERS))
ISSUER = re.compile(r"(?<![A-Za-z0-9+/=_\-.])(?:" + "|".join(p for _, _, p in ISSUERS) + r")(?![A-Za-z0-9])")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----")
PEM_BODY = re.compile(r"(?:\\[rn]|\s|\"|'|\+|,)*(?:[A-Za-z\-]+: [^\n\\]*(?:\\n|\s)+)*([A-Za-z0-9+/=]{16,})")
PEM_MORE = re.compile(r"(?:(?:\\[rn]|\s|\"|'|\+|,)*(?:[A-Za-z0-9+/=]{40,}|[A-Za-z0-9+/]+={1,2}(?![A-Za-z0-9+/=])))*")
PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----")
URL = re.compile(r"(?<![A-Za-z0-9+.\-])[A-Za-z][A-Za-z0-9+.\-]*+://[^\s/:@\"'`<>{}$]*:([^\s/@\"'`]+)@[A-Za-z0-9\[]")
SCHEME = re.compile(r"(?<![A-Za-z])(?:Bearer|Basic|Token|bearer|basic) ([A-Za-z0-9+/=_\-.~]{12,})")
CALL_AUTH = re.compile(rf"(?i)(?:bearer|token|basic)_?auth\w*\(\s*({_LITERAL})")
PAIR = re.compile(rf"[\"'`]([A-Za-z][\w .\-]*+)[\"'`]\s*,\s*({_JOINED})")
USER = re.compile(r"(?:^|\s)(?:--user[= ]|-u )\s*[\"']?[\w.@\-]+:([^\s\"'`]+)")
LOGIN = re.compile(rf"(?i)\b(?:login|authenticate|sign_?in|connect)\(\s*{_LITERAL}\s*,\s*({_LITERAL})")
SETTER = re.compile(rf"\b[sS]et_?([A-Za-z_]{{1,80}})\(\s*({_JOINED})")
QUOTED = re.compile(
    rf"(?<![\w\-])([A-Za-z][\w\-]*+)[\"'`]?\]?\s*(?::\s*&?(?:'static\s+)?[\w.<>|]+\s*=(?![=>])|=>|:=|=(?![=>])|:)\s*"
    rf"(?:\(\s*|concat!\(\s*|String::from\(\s*|Some\(\s*|[rbu](?=[\"']))*({_JOINED})"
)
BARE = re.compile(r"^\s*(?:[#;/*\-]+\s*)?(?:was:|old:|formerly:)?\s*(?:export\s+|ENV\s+)?([A-Za-z][\w.\-]*)\s*[=:]\s*([^\s\"'`]\S*)\s*(?:#.*)?$")
PROSE = re.compile(r"(?i)\b(?:password|passphrase|passwd|secret|token|api key|credential)\b[^\"'`=:\n]{0,60}?\b(?:is|was)\s+[\"'`]?(\S+)")
PROSE_LOGIN = re.compile(r"(?i)\blogin:?\s+[\w.@\-]+\s*/\s*(\S+)")
REMARK = re.compile(r"(?<![\w.\-])([A-Za-z][\w.\-]*+)\s*[:=]\s*([^\s\"'`]+)")
FORMER = re.compile(r"^\W*(?:was|old|formerly):")
COMMENT = re.compile(r"^\s*(?:#|//|/\*|\*|--|;)")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

SECRET_LAST = {"password", "passwd", "pwd", "pass", "passphrase", "secret", "token", "credential", "credentials", "apikey", "passcode"}
SECRET_KEY = {"api", "access", "secret", "private", "signing", "encryption", "license", "auth", "master", "account", "shared", "service", "session", "storage", "deploy", "client", "admin"}
CONFIG = {"yaml", "yml", "toml", "env", "properties", "ini", "cfg", "conf", "sh", "bash", "tfvars", "production", "local", "staging", "development", "netrc", "pem", "key"}
PLACEHOLDER = re.compile(
    r"(?i)^(?:x{4,}|\*+|\.{3,}|-+|_+)$|[<>]|\$\{|\{\{|\$\(|^\$\w+$|^%\w+%$|%\(|your[_\-]|[_\-]here$|replace[_\-]?me|change[_\-]?me|insert[_\-]|fill[_\-]in|"
    r"placeholder|redacted|dummy|^todo|^none$|^null$|example$|^env:|^vault:|^arn:|^file:|^/(?:run|etc|var|home|usr|opt)/|os\.environ|process\.env|getenv"
)


FILL = frozenset("xXaA02")  # what masks are made of


def secret_name(name: str) -> bool:
    """Whether an identifier names a secret itself, not a setting about one."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words:
        return False
    return words[-1] in SECRET_LAST or (words[-1] == "key" and len(words) > 1 and words[-2] in SECRET_KEY)


def strong(value: str, least: int = 8) -> bool:
    """A value that can be a secret: no blank, a letter, and a digit or a sign that names don't have."""
    if len(value) < least or re.search(r"\s", value) or PLACEHOLDER.search(value) or len(set(value)) < 4 or len(set(value) - FILL) < 2:
        return False
    return bool(re.search(r"[A-Za-z]", value)) and bool(re.search(r"[\d!@#$%^&*?~+=]", value))


def _pieces(text: str, start: int, end: int) -> tuple[str, list[tuple[int, int]]]:
    """The joined value of adjacent literals in text[start:end], and where its pieces are."""
    spans = [(m.start() + 1, m.end() - 1) for m in re.compile(_LITERAL).finditer(text, start, end)]
    return "".join(text[a:b] for a, b in spans), [s for s in spans if s[0] < s[1]]


def _jwt(value: str) -> bool:
    try:
        head = value.split(".")[0]
        return isinstance(json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))), dict)
    except ValueError:
        return False


_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum(token: str) -> bool:
    """Whether the last six characters are the CRC-32 of those behind the prefix, in base 62, as some issuers make them."""
    body, n, digits = token[token.index("_") + 1 : -6], 0, ""
    n = zlib.crc32(body.encode())
    for _ in range(6):
        n, d = divmod(n, 62)
        digits = _BASE62[d] + digits
    return token.endswith(digits)


def verified(token: str) -> bool:
    """What can be checked of an issuer's token without its issuer: a checksum, or the structure of a JWT."""
    if token.startswith("eyJ"):
        return _jwt(token)
    return token[:4] in ("ghp_", "gho_", "ghs_", "npm_") and checksum(token)


def _rules(text: str, a: int, b: int, bare: bool):
    """(kind, checked, spans) of the credentials that begin in the line text[a:b]."""
    line = text[a:b]
    tail = line.rstrip()
    end = b
    for _ in range(3):  # a value that goes on, or begins, on the next line
        if not tail.endswith(("+", "(", "=", "\\", ",")) or end >= len(text):
            break
        end = text.find("\n", end + 1)
        end = len(text) if end < 0 else end
        tail = text[a:end].rstrip()
    window = (a, end) if tail else (a, b)

    for m in PEM.finditer(text, a, b):
        body = PEM_BODY.match(text, m.end())
        if body:
            stop, other = PEM_END.search(text, m.end()), PEM.search(text, m.end())
            if stop and other and other.start() < stop.start():  # the end of another block
                stop = None
            yield "private_key", True, [(m.start(), stop.end() if stop else PEM_MORE.match(text, body.end()).end())]
    for m in ISSUER.finditer(text, a, b):
        if not PLACEHOLDER.search(m.group()) and len(set(m.group()[4:])) > 5:
            yield "issuer", verified(m.group()), [m.span()]
    if "://" in line:
        for m in URL.finditer(text, a, b):
            v = m.group(1)
            if len(v) >= 6 and len(set(v) - FILL) > 1 and not PLACEHOLDER.search(v) and not v.startswith("$") and v.lower() not in SECRET_LAST and "{" not in v and re.search(r"[^a-z]", v):
                yield "address", False, [m.span(1)]
    for m in SCHEME.finditer(text, a, b):
        if strong(m.group(1), 12):
            yield "authorization", False, [m.span(1)]
    for m in USER.finditer(text, a, b):
        if strong(m.group(1), 6):
            yield "login", False, [m.span(1)]
    for m in LOGIN.finditer(text, *window):
        v, spans = _pieces(text, *m.span(1))
        if strong(v):
            yield "login", False, spans
    for m in CALL_AUTH.finditer(text, *window):
        v, spans = _pieces(text, *m.span(1))
        if strong(v):
            yield "authorization", False, spans
    former = FORMER.match(line)
    begin = a + (former.end() if former else 0)
    for rule in (QUOTED, PAIR, SETTER):
        for m in rule.finditer(text, begin, window[1]):
            head = text[m.start() : m.start(2)]
            more = (LISTED if "concat!(" in head else ADJOINED if "(" in head else ADDED).match(text, m.end(2))
            (v, spans), (whole, joined) = _pieces(text, *m.span(2)), _pieces(text, m.start(2), more.end())
            if secret_name(m.group(1)):
                if "BEGIN" not in v and (strong(v) or strong(whole)):
                    yield "named", False, joined
                continue
            for v, spans in ((v, spans), (whole, joined)):
                if len(spans) > 1 and ISSUER.fullmatch(v) and not PLACEHOLDER.search(v):
                    yield "issuer", verified(v), spans
                    break
    comment = COMMENT.match(line)
    if bare and (m := BARE.match(line)):
        if secret_name(m.group(1)) and strong(m.group(2).rstrip(",;")):
            yield "named", False, [(a + m.start(2), a + m.start(2) + len(m.group(2).rstrip(",;")))]
    if comment:
        for m in REMARK.finditer(text, begin, b):
            v = m.group(2).rstrip(",;")
            if secret_name(m.group(1)) and strong(v):
                yield "named", False, [(m.start(2), m.start(2) + len(v))]
        for rule in (PROSE, PROSE_LOGIN):
            for m in rule.finditer(text, a, b):
                v = m.group(1).rstrip(",.;\"'`)")
                if strong(v):
                    yield "prose", False, [(m.start(1), m.start(1) + len(v))]


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for k in KEYWORDS:
        auto.add_word(k, len(k))
    auto.make_automaton()
    return auto


def _split(text: str, low: str):
    """Starts of the lines where the statements begin whose adjacent literals together hold the keyword of an issuer format."""
    for m in SPLIT.finditer(low):
        if _ISSUED.search(SPLIT.sub("", low[max(0, m.start() - 80) : m.end() + 80])):
            a = text.rfind("\n", 0, m.start()) + 1
            yield a
            for _ in range(3):  # as far as a line looks ahead
                tail = text[:a].rstrip() if a < 200 else text[a - 200 : a].rstrip()
                if not tail.endswith(("+", "(", "=", "\\", ",")):
                    break
                a = text.rfind("\n", 0, a - 1) + 1
                yield a


def scan(text: str | None, path: str | None, auto: ahocorasick.Automaton | None = None) -> list[tuple[int, str, bool, list[tuple[int, int]]]]:
    """(line within the text from 0, kind, checked, spans) of each credential, in order."""
    if not text:
        return []
    auto = auto or _automaton()
    name = (path or "").rsplit("/", 1)[-1].lower()
    bare = name.rsplit(".", 1)[-1] in CONFIG or "." not in name
    low = text.lower()
    if len(low) != len(text):  # a few letters grow in lower case
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    out, taken, done, line, at = [], [], 0, 0, 0
    hits = [pos for pos, _ in auto.iter(low)]
    if (split := set(_split(text, low))):
        hits = sorted(split.union(hits))
    for pos in hits:
        if pos < done:
            continue
        a = text.rfind("\n", 0, pos + 1) + 1 if text[pos] != "\n" else text.rfind("\n", 0, pos) + 1
        b = text.find("\n", pos)
        b = len(text) if b < 0 else b
        done = b
        line += text.count("\n", at, a)
        at = a
        for kind, checked, spans in _rules(text, a, b, bare):
            if any(s < y and x < e for s, e in spans for x, y in taken):
                continue
            taken += spans
            out.append((line + text.count("\n", a, spans[0][0]), kind, checked, spans))
    return out


_ESCAPE = re.compile(r"\\(?:[rnt\"'`\\$/0]|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4})")
_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
_SIGNS = "-_.~!*@^?+=%&#$"  # signs that can stand for each other; brackets, quotes, blanks and separators stay
_HEX, _BASE32, _BASE64 = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)"), re.compile(r"[A-Z2-7]+=*"), re.compile(r"[A-Za-z0-9+/_\-]+=*")


def placeholder(value: str) -> str:
    """As long as the value and of its alphabet: hexadecimal, base32 or base64, else its own classes of characters; escapes stay."""
    coded = "%" in value and "%" not in _PERCENT.sub("", value)
    escape = _PERCENT if coded else _ESCAPE
    bare = escape.sub("", value)
    lower, upper, digit = "x", "X", "0"
    signs = next((c for c in _SIGNS if c in bare), "")
    if _HEX.fullmatch(bare):
        lower, upper = "a", "A"
    elif _BASE32.fullmatch(bare):
        upper, digit, signs = "A", "2", ""
    elif bare.count(".") == 2 and bare.startswith("eyJ"):
        signs = ""  # the parts of a JWT stay apart
    elif _BASE64.fullmatch(bare):
        signs = "".join(c for c in "-_+/" if c in bare)[:1]

    def fill(c: str) -> str:
        if c.isalpha():
            return (upper if c.isupper() else lower) if c.isascii() else "x"
        if c.isdigit():
            return digit
        return signs if signs and (c in _SIGNS or c == signs == "/") and c != "=" else c

    out, at = [], 0
    for m in escape.finditer(value):
        out += [fill(c) for c in value[at : m.start()]]
        out.append("%20" if coded else m.group())
        at = m.end()
    return "".join(out + [fill(c) for c in value[at:]])


def hidden(text: str, path: str | None) -> list[tuple[int, int]]:
    """The spans to mask; the frame of a key block is left out."""
    out = []
    for _, kind, _, spans in scan(text, path):
        for a, b in spans:
            if kind == "private_key":
                a = text.index("KEY-----", a) + 8
                stop = text.find("-----END", a, b)
                b = stop if stop >= 0 else b
            out.append((a, b))
    return out


def masked(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in sorted(spans):
        if b > at:
            a = max(a, at)
            out += [text[at:a], placeholder(text[a:b])]
            at = b
    return "".join([*out, text[at:]])


def mask(text: str | None, path: str | None) -> str | None:
    """The text with each credential replaced in place by as many characters of its alphabet; a key block keeps its frame."""
    return masked(text, hidden(text, path)) if text else text


def mask_parts(starts: list[int], parts: list[str], path: str | None) -> list[str]:
    """The parts of one file version, masked by what the whole version shows.

    Lines that differ from the assembled text (parts that contradict each other), and parts
    of an unknown file, are masked by what the part shows itself.
    """
    if path is None or len(parts) == 1:
        return [mask(p, path) for p in parts]
    whole = assemble(starts, parts)
    spans = hidden(whole, path)
    begins = [0]
    for line in whole.split("\n"):
        begins.append(begins[-1] + len(line) + 1)
    out = []
    for s, part in zip(starts, parts, strict=True):
        at = begins[s - starts[0]]
        if whole.startswith(part, at) and whole[at + len(part) : at + len(part) + 1] in ("", "\n"):
            out.append(masked(part, [(max(a - at, 0), min(b - at, len(part))) for a, b in spans if a < at + len(part) and b > at]))
            continue
        own, here = hidden(part, path), 0
        for line, there in zip(part.split("\n"), begins[s - starts[0] :], strict=False):
            if whole.startswith(line, there):
                own += [(max(a - there, 0) + here, min(b - there, len(line)) + here) for a, b in spans if a < there + len(line) and b > there]
            here += len(line) + 1
        out.append(masked(part, own))
    return out


FINDINGS = "codebase_id string, file_path string, modified_at long, line_no long, kind string, checked boolean, column_no int, length int"


def find(chunks: DataFrame) -> DataFrame:
    """One row per credential and chunk that holds it; line_no counts from 1 within the file."""

    def run(batches):
        auto = _automaton()
        for b in batches:
            rows = {k: [] for k in ("codebase_id", "file_path", "modified_at", "line_no", "kind", "checked", "column_no", "length")}
            cols = b.to_pydict()
            for i, text in enumerate(cols["content"]):
                path = cols["file_path"][i]
                for line, kind, checked, spans in scan(text, path, auto):
                    a = spans[0][0]
                    values = (cols["codebase_id"][i], path, cols["modified_at"][i], (cols["start_line"][i] or 1) + line, kind, checked, a - text.rfind("\n", 0, a), sum(y - x for x, y in spans))
                    for k, v in zip(rows, values, strict=True):
                        rows[k].append(v)
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], names=list(rows))

    cols = [F.col(c) for c in ("codebase_id", "file_path", "content")] + [F.col(c).cast("long").alias(c) for c in ("start_line", "modified_at")]
    return spread(chunks.select(*cols)).mapInArrow(run, FINDINGS)


def newest_only(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows (codebase_id, file_path, modified_at, ...) of the newest version of their file; null times only count if a file has no other."""
    newest = chunks.groupBy(F.col("codebase_id").alias("_c"), F.col("file_path").alias("_f")).agg(F.max(F.col("modified_at").cast("long")).alias("_newest"))
    same = rows["codebase_id"].eqNullSafe(newest["_c"]) & rows["file_path"].eqNullSafe(newest["_f"]) & rows["modified_at"].eqNullSafe(newest["_newest"])
    return rows.join(newest, same, "left_semi")


def found(chunks: DataFrame) -> DataFrame:
    """Distinct (codebase_id, file_path, line_no) of credentials in newest versions."""
    hits = find(chunks).select("codebase_id", "file_path", "modified_at", "line_no").distinct()
    return newest_only(hits, chunks).select("codebase_id", "file_path", "line_no").distinct()


def redact(chunks: DataFrame) -> DataFrame:
    """The chunks with content masked; all other columns, of any name, as they are.

    Each version of a file is assembled and scanned as a whole, so a credential that goes over
    the edge of a chunk is masked on both sides.
    """

    def run(batches):
        for b in batches:
            c = b.to_pydict()
            rows = []
            for cb, path, at, starts, parts in zip(c["_c"], c["_f"], c["_m"], c["_starts"], c["_parts"], strict=True):
                rows += [(cb, path, at, s, old, new) for s, old, new in zip(starts, parts, mask_parts(starts, parts, path), strict=True) if old != new]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=["_c", "_f", "_m", "_s", "_old", "_new"])

    key = {"_c": F.col("codebase_id"), "_f": F.col("file_path"), "_m": F.col("modified_at").cast("long"), "_s": F.coalesce(F.col("start_line").cast("int"), F.lit(1))}
    parts = chunks.filter("content <> ''").select(*(v.alias(k) for k, v in key.items()), F.col("content").alias("_t")).groupBy("_c", "_f", "_m").agg(F.array_sort(F.collect_set(F.struct("_s", "_t"))).alias("_p"))
    new = parts.select("_c", "_f", "_m", F.col("_p._s").alias("_starts"), F.col("_p._t").alias("_parts")).mapInArrow(run, "_c string, _f string, _m long, _s int, _old string, _new string")
    same = F.xxhash64(*key.values(), "content") == F.xxhash64("_c", "_f", "_m", "_s", "_old")
    for k, v in (key | {"_old": F.col("content")}).items():
        same = same & v.eqNullSafe(F.col(k))
    names = [F.coalesce("_new", "content").alias(c) if c == "content" else F.col(f"`{c}`") for c in chunks.columns]
    return chunks.join(new, same, "left").select(*names)
