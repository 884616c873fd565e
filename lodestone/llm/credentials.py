"""Credentials in source code, configuration and documentation: where they stand, and the content with only them masked.

1. A keyword automaton runs over each content once. Contents without any keyword are done; in the others only the lines
   with a keyword, and the line after, are looked at further.
2. On these lines come the formats that issuers publish (prefix, alphabet, length), key blocks, connection strings, and values
   bound to a name that says password, key, token or secret.
3. A value stays if its structure holds: a JWT's header must decode to JSON, an issuer's token must be of full length (in one
   piece or put together over lines) and not too uniform, a named value must look random or like a chosen password, by digits or,
   without any, by its case and pairs of letters. Where an issuer puts a checksum into its tokens (CRC-32 in base 62), one that
   holds settles it; one that doesn't is no proof of the opposite, as revoked and made-up tokens are to be masked too.
   Placeholders, references, public keys, certificates, digests and identifiers go.
4. Each value is masked by characters of its own alphabet (decimal, hexadecimal, base 32, base 64 or plain letters and digits, each in its case;
   everything else stays), so neither lengths nor quoting nor line breaks change and what decoded before still decodes.
   Masked values are not found again.

Defined results
- lines count from 1 and end with \\n, so \\r belongs to its line; a value over several lines begins on its first
- null and blank contents, and those without a keyword: no credential, the content unchanged
- several values on a line: one row in `credentials`, all of them masked
- a chunk_id counts once, with its newest content; rows without chunk_id are dropped; further columns are never read
- contents of any length are read whole, in time in proportion to their length
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What the automaton looks for, lower case.
KEYWORDS = (
    "pass", "pw", "secret", "token", "apikey", "api_key", "api-key", "access_key", "access-key", "accesskey",
    "signing", "encryption", "private key", "private_key", "privatekey", "credential", "bearer", "basic ", "login", "log in", "session", "connect", "_svc", "://", "-----begin", "auth", "account",
    "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "sk_live_", "sk_test_", "rk_live_", "xoxb-", "xoxp-", "xoxa-", "xoxr-", "aiza", "eyj", "npm_", "pypi-", "sg.", "hf_", "dop_v1_",
)

#: Published formats of issuers' tokens. A shorter one is a token cut in two by a line break in the code.
ISSUERS = re.compile(
    r"(?<![A-Za-z0-9_+/-])(?:"
    r"(?:AKIA|ASIA)[A-Z0-9]{6,16}"
    r"|gh[opusr]_[A-Za-z0-9]{12,}"
    r"|github_pat_[A-Za-z0-9_]{20,}"
    r"|glpat-[A-Za-z0-9_-]{8,}"
    r"|(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{6,}"
    r"|xox[abprs]-[A-Za-z0-9-]{10,}"
    r"|AIza[A-Za-z0-9_-]{13,}"
    r"|eyJ[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+){0,2}"
    r"|npm_[A-Za-z0-9]{16,}|pypi-[A-Za-z0-9_-]{16,}|SG\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|hf_[A-Za-z0-9]{16,}|dop_v1_[a-f0-9]{32,}"
    r")"
)
#: The formats at the length at which they are issued.
_FULL = re.compile(
    r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[opusr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9]{22}_[A-Za-z0-9]{59}|glpat-[A-Za-z0-9_-]{20,}|(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{24,}"
    r"|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_-]{50,}|SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}|hf_[A-Za-z0-9]{34,}|dop_v1_[a-f0-9]{64}"
)
_STAND_IN = re.compile(r"(?i)example|your|token|here|placeholder|secret|dummy|fake|sample|insert|replace|redacted|changeme|abcdef")
_BEGIN = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----")
_URL = re.compile(r"(?<=[A-Za-z0-9+.-])://[^\s:/@\"'`<>]*:([^\s@/\"'`]+)@(?=[\w\[])")
_WORD = r"(?:pass|passwd|password|passphrase|pwd|secret|token|api[_.-]?key|access[_.-]?key|secret[_.-]?key|private[_.-]?key|signing[_.-]?key|encryption[_.-]?key|credentials?|dbpass|pw)"
_BOUND = re.compile(
    rf"(?P<name>{_WORD})"
    r"(?P<close>\*\*|__|[\"'`\])]{1,2})?"
    r"(?P<type>\s*:\s*(?:&'?\w*\s*)?(?:str|String|string|text|bytes|auto))?"
    r"(?P<op>\s*(?::=|=>|->|==?|:|,|\||>)\s*|(?=\(\s*[\"'`])|\s+(?:is|was|are|of|to)\s+(?:now\s+|set\s+to\s+|currently\s+)?|\s+)"
    r"(?P<open>(?:\(\s*)?(?:[rbuf]{0,2}(?:\"\"\"|'''|[\"'`])|<)?)",
    re.IGNORECASE,
)
_HEADER = re.compile(r"\b(?:Bearer|Basic|Token)\s+(?P<value>[A-Za-z0-9._~+/=-]{12,})")
_LOGIN = re.compile(r"(?:\b(?:log ?in|sign ?in|logon|connect)|login|account|auth|authenticate|connect|session|credentials?)\b", re.IGNORECASE)
_BETWEEN = re.compile(r"\s*(?:,|/|:|and|with)\s*[A-Za-z ]*", re.IGNORECASE)
_ANY_QUOTE = re.compile("[\"'`]")
_PAIR = re.compile(rf"(?i)\bname[\"']?\s*[:=]\s*[\"']?[A-Za-z0-9_.-]*{_WORD}[\"']?\s*,?\s*$")
_VALUE_LINE = re.compile(r"(?i)^\s*[\"']?value[\"']?\s*[:=]\s*[\"']?(?P<value>[^\s\"']+)")
_USER_FLAG = re.compile(r"(?i)(?:^|\s)(?:-u|--user)[ =]?[\"']?[\w.-]+:(?P<value>[^\s\"'@]{6,})")
_PUBLIC = re.compile(r"(?i)ssh-(?:rsa|ed25519|dss)|ecdsa-sha2|-----BEGIN (?:CERTIFICATE|[A-Z ]*PUBLIC KEY)|sha(?:1|224|256|384|512)[-:=]|\bmd5[-:=]")
#: What a public value's mark announces: a certificate or key up to its END, else one run of its characters.
_CERTIFICATE_BODY = re.compile(r"(?:(?!-----).)*-----(?:(?!-----).)*-----END [A-Z ]*-----|(?:(?!-----).)*-----(?:\\+[nrt]|[A-Za-z0-9+/= ])*")
_SSH_BODY = re.compile(r"[\w@.-]{0,40}[\s\"'`]{0,3}[A-Za-z0-9+/=]*")
_DIGEST_BODY = re.compile(r"[\s\"'`]{0,3}[A-Za-z0-9+/=_-]*")
_NOT_A_SECRET = re.compile(r"(?i)^(?:change[_-]?me|placeholder|redacted|none|null|undefined|todo|tbd|secret|password|token|dummy|example|sample|test|n/?a|empty|true|false|\.{3,}|\*+|x+|-+|_+)$|your[-_ ]|[-_ ]here$|example|changeme|placeholder|redacted|^\W*$|^<.*>$|^\[.*\]$")
_REFERENCE = re.compile(r"^\$|\$\{|\$\(|\{\{|^%\(|^%[A-Za-z_]+%$|^@|^#\{|^<|process\.env|os\.(?:environ|getenv)|getenv|^vault:|^secretsmanager|^ssm:|^env[.:(]|^arn:|^file:|^/(?:[a-z]+/)+|^\.{1,2}/|^~/|^https?://|://")
_UUID = re.compile(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
_BLANKS, _SOLID = re.compile(r"\s*"), re.compile(r"[^\s\"'`<]*")
_DOTTED, _HUMPED = re.compile(r"[a-z]+(?:[._-][a-z0-9]+)*|[A-Z]+(?:_[A-Z0-9]+)*"), re.compile(r"[A-Za-z]+\d{0,2}(?:[A-Z][a-z]+\d{0,2})*")
_MASKED = re.compile(r"^[Xx0\W_]*$")
_QUOTES = ('"""', "'''", '"', "'", "`")
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_PLAIN = str.maketrans(_UPPER + _LOWER + _DIGITS, "X" * 26 + "x" * 26 + "0" * 10)
_HEXADECIMAL = str.maketrans("ABCDEFabcdef" + _DIGITS, "A" * 6 + "a" * 6 + "0" * 10)
_BASE32 = str.maketrans(_UPPER + _LOWER + "234567", "X" * 26 + "x" * 26 + "2" * 6)
_IS_HEXADECIMAL = re.compile(r"(?:0[xX])?[0-9a-fA-F]+(?:[:\s-]+[0-9a-fA-F]+)*")
_IS_BASE32 = re.compile(r"(?:[A-Z2-7]+|[a-z2-7]+)=*")

_AUTOMATON = None


def _automaton():
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        _AUTOMATON = ahocorasick.Automaton()
        for word in KEYWORDS:
            _AUTOMATON.add_word(word, len(word))
        _AUTOMATON.make_automaton()
    return _AUTOMATON


def _uniform(value: str) -> bool:
    """Too few different characters to be a credential, as in masks."""
    return len(set(value)) < max(4, min(8, len(value) // 3))


def _issued(value: str) -> bool:
    if value.startswith("eyJ"):
        head = value.split(".")[0]
        try:
            decoded = base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))
        except ValueError:
            return False
        try:
            return "alg" in json.loads(decoded)
        except ValueError:
            return "." not in value and decoded.startswith(b'{"alg"')
    body = value.split("_")[-1] if "_" in value[:12] else value[4:]
    if checksum_holds(value):
        return True
    if _uniform(body) or "EXAMPLE" in value or not (_FULL.fullmatch(value) or value.startswith("xox")):
        return False
    return any(c.isdigit() for c in value) or not _STAND_IN.search(body) and (value.isupper() or not (body.islower() or body.isupper()))


_BASE62 = _DIGITS + _UPPER + _LOWER


def checksum_holds(value: str) -> bool:
    """Whether the last six characters are the CRC-32 of the thirty before, in base 62, as GitHub's and npm's tokens have it."""
    m = re.fullmatch(r"(?:gh[opusr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})", value)
    if not m:
        return False
    crc, digits = zlib.crc32(m.group(1).encode()), ""
    for _ in range(6):
        crc, at = divmod(crc, 62)
        digits = _BASE62[at] + digits
    return digits == m.group(2)


_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ODD_PAIR = re.compile(r"(?=[jqxzv][bcdfghjkmnpqrtvwxz]|[bcdfghjkmpqtvwxz][jqxzvk](?<!ck)|[fghjkpq][bcdfgjkmpqvwxz](?<!ff)(?<!gg)(?<!pp))")


def _random_letters(value: str) -> bool:
    """Without any digit: case that changes more often than words begin, or pairs of letters that words don't have."""
    letters = re.sub(r"[^A-Za-z]", "", value)
    if len(letters) < 12 or _STAND_IN.search(value):
        return False
    if not (letters.islower() or letters.isupper()):
        return len(letters) < 3 * len(_PIECE.findall(letters)) and len(re.findall("[A-Z]", letters)) > len(letters) / 5
    return len(letters) >= 16 and len(_ODD_PAIR.findall(letters.lower())) >= max(3, len(letters) / 8)


def _chosen_letters(value: str) -> bool:
    """Without any digit: a password of both cases with a symbol inside."""
    return len(value) >= 8 and re.search(r"[A-Za-z][!#$%^&*~?+][A-Za-z]", value) is not None and re.fullmatch(r"[A-Za-z!#$%^&*~?+_.-]+", value) is not None and not (value.islower() or value.isupper()) and not _STAND_IN.search(value)


def _looks_secret(value: str, quoted: bool) -> bool:
    """A value bound to a telling name: random, or a chosen password of several kinds of characters."""
    if len(value) < 6 or _MASKED.match(value) or _NOT_A_SECRET.search(value) or _REFERENCE.search(value) or _UUID.match(value) or _uniform(value):
        return False
    if any(c.isspace() for c in value) or any(c in value for c in "(){}[]<>;,") or not value.isascii():
        return False
    digits, upper, lower = (any(f(c) for c in value) for f in (str.isdigit, str.isupper, str.islower))
    if not (upper or lower):
        return False
    if not digits:
        return _random_letters(value) or quoted and _chosen_letters(value)
    if _DOTTED.fullmatch(value) and not (re.fullmatch(r"[0-9a-f]{24,}", value) or re.fullmatch(r"[a-z0-9]{10,}", value) and re.search(r"\d[a-z]+\d", value)):
        return False
    if not quoted and len(value) < 60 and re.fullmatch(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+", value) and not re.search(r"\d{3}", value):
        return False
    if not quoted and len(value) < 24 and _HUMPED.fullmatch(value):
        return False
    return True


def _value_at(text: str, at: int, opened: str, high: int) -> tuple[int, int, bool]:
    """(start, end, quoted) of the value at `at`, which follows the opening characters."""
    quote = next((q for q in _QUOTES if opened.endswith(q)), "")
    if quote:
        end = text.find(quote, at, high)
        if end < 0 and (quote == "`" or len(quote) == 3) and not text[at:high].strip():  # the value begins on the next line
            body = _BLANKS.match(text, high).end()
            return body, _SOLID.match(text, body).end(), True
        return at, high if end < 0 else end, True
    end = _SOLID.match(text, at).end()
    while end > at and text[end - 1] in ",;.)]":
        end -= 1
    return at, end, False


_KEY_GAP = re.compile(r"(?:\\+[nrt]|[\s\"'`\\,;.&()|#>*]|\+(?=\s)|//(?=\s))*")
_KEY_HEAD = re.compile(r"(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID)[ \t]*:(?:(?!\\+[nr])[^\n\"'`])*")
_KEY_RUN = re.compile(r"=?[A-Za-z0-9+/]+={0,2}")
_KEY_LEAST = 20


def _key_block(text: str, start: int, kind: str) -> int:
    """Where the key after a BEGIN ends: at its END, else with the last piece that can be key body; -1 without any body."""
    nxt = text.find("-----BEGIN ", start)
    nxt = len(text) if nxt < 0 else nxt
    end = text.find(f"-----END {kind}-----", start, nxt)
    if end >= 0:
        return end if re.search(r"[A-Za-z0-9+/=]{16}|\$\{|\*{4}", re.sub(r"\\+[nrt]", "\n", text[start:end])) else -1
    at, last, longest = start, -1, 0
    while True:
        at = _KEY_GAP.match(text, at, nxt).end()
        if m := _KEY_HEAD.match(text, at, nxt):
            at = m.end()
            continue
        m = _KEY_RUN.match(text, at, nxt)
        if not m:
            return last
        run = m.group()
        mixed = re.search(r"[0-9+/=]", run) or _random_letters(run)
        if len(run) < _KEY_LEAST and not (longest and len(run) < longest) or not mixed:
            return last
        at = last = m.end()
        if len(run) < longest and not run.endswith("=") and len(run) < _KEY_LEAST:
            return last  # the last line of a key is its only short one
        longest = max(longest, len(run))


_GOES_ON = re.compile(r"[\"'`]\s*[+.\\\\]?\s*\n\s*[+.]?\s*[\"'`](?P<value>[A-Za-z0-9+/=_.!#$?@-]+)(?=[\"'`])")


def _continued(text: str, at: int) -> Iterator[re.Match]:
    """The strings that continue the one that ends at `at`."""
    while m := _GOES_ON.match(text, at):
        at = m.end("value")
        yield m


def find(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each credential value in text, in order, none inside another."""
    return [s for s in find_parts(text) if s[2]]


def find_parts(text: str | None) -> list[tuple[int, int, bool]]:
    """(start, end, whether a value begins here): values, and the strings that continue them on the next lines."""
    if not text:
        return []
    lowered = text.lower()
    if len(lowered) != len(text):  # some letters are longer in lower case
        lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    spans: list[tuple[int, int]] = []
    done = -1
    for at, _ in _automaton().iter(lowered):
        if at < done:
            continue
        low = text.rfind("\n", 0, at + 1) + 1
        high = text.find("\n", at)
        high = len(text) if high < 0 else high
        done = high
        spans += _on_line(text, low, high)
    spans.sort(key=lambda s: (s[0], -s[1]))
    kept: list[tuple[int, int]] = []
    for s in spans:
        if not kept or s[0] >= kept[-1][1]:
            kept.append(s)
        elif s[1] > kept[-1][1] and s[0] == kept[-1][0]:
            kept[-1] = s
    parts = []
    for (a, b), (following, _) in zip(kept, [*kept[1:], (len(text) + 1, 0)]):
        parts.append((a, b, True))
        for m in _continued(text, b):
            if m.end("value") > following:
                break
            parts.append((*m.span("value"), False))
    return parts


def lines_of(text: str, parts: list[tuple[int, int, bool]]) -> list[int]:
    """The lines, from 1, on which values begin."""
    lines, line, at = [], 1, 0
    for a, _, begins in parts:
        line += text.count("\n", at, a)
        at = a
        if begins and (not lines or lines[-1] != line):
            lines.append(line)
    return lines


def _public(line: str) -> list[tuple[int, int]]:
    """Where digests, certificates and public keys stand on a line, with the values that follow their marks."""
    spans, at = [], 0
    while m := _PUBLIC.search(line, at):
        kind = m.group().lower()
        body = _CERTIFICATE_BODY if kind.startswith("-") else _SSH_BODY if kind.startswith(("ssh", "ecdsa")) else _DIGEST_BODY
        found = body.match(line, m.end())
        at = max(found.end() if found else m.end(), m.end())
        spans.append((m.start(), at))
    return spans


def _on_line(text: str, low: int, high: int) -> Iterator[tuple[int, int]]:
    line = text[low:high]
    for m in _BEGIN.finditer(line):
        end = _key_block(text, low + m.end(), m.group(1))
        if end < 0:
            continue
        body = re.sub(r"\\[nrt]|\s", "", text[low + m.end() : end])
        if not (_MASKED.match(body) or _REFERENCE.search(body[:20]) or _NOT_A_SECRET.search(body[:40])) or not body:
            yield low + m.start(), end
    for m in ISSUERS.finditer(line):
        whole = m.group()
        if not _FULL.fullmatch(whole):  # cut over lines, only the whole shows its length
            whole += "".join(more.group("value") for more in _continued(text, low + m.end()))
        if line[m.end() : m.end() + 1].isalnum() and not any(c.isdigit() for c in whole):
            continue
        if _issued(whole):
            yield low + m.start(), low + m.end()
    public = _public(line)
    is_public = lambda start, end: any(start < low + b and low + a < end for a, b in public)
    for m in _URL.finditer(line):
        value = m.group(1)
        if not (_MASKED.match(value) or _REFERENCE.search(value) or _NOT_A_SECRET.search(value) or _uniform(value)) and len(value) >= 4:
            yield low + m.start(1), low + m.end(1)
    for m in _HEADER.finditer(line):
        if _looks_secret(m.group("value"), True) and not is_public(low + m.start("value"), low + m.end("value")):
            yield low + m.start("value"), low + m.end("value")
    for m in _USER_FLAG.finditer(line):
        if _looks_secret(m.group("value"), True) and not is_public(low + m.start("value"), low + m.end("value")):
            yield low + m.start("value"), low + m.end("value")
    for start, end in _after_login(line):
        if _looks_secret(line[start:end], True) and not is_public(low + start, low + end):
            yield low + start, low + end
    if _PAIR.search(line.rstrip()):
        nxt = text[high + 1 : (text.find("\n", high + 1) + 1 or len(text) + 1) - 1]
        m = _VALUE_LINE.match(nxt)
        if m and _looks_secret(m.group("value"), True):
            yield high + 1 + m.start("value"), high + 1 + m.end("value")
    at = 0
    while m := _BOUND.search(line, at):
        begin = m.start("name")
        while begin > at and (line[begin - 1].isalnum() or line[begin - 1] in "_.-"):
            begin -= 1
        at = m.end("name")
        flag = line.startswith("-", begin) and (begin == 0 or line[begin - 1].isspace())
        plain_word = line[m.end("name") : m.end("name") + 1]
        if plain_word.isalnum() or plain_word == "_":
            continue
        start, end, quoted = _value_at(text, low + m.end(), m.group("open"), high)
        value = text[start:end]
        if m.group("op").strip() and value and start <= high:
            at = max(at, min(end, high) - low)  # a placeholder's own words bind nothing
        whole = value + "".join(more.group("value") for more in _continued(text, end)) if quoted else value  # strings put together over lines
        if start < end and not is_public(start, end) and _looks_secret(whole, quoted) and (quoted or flag or _strong(value)):
            yield start, end


def _strong(value: str) -> bool:
    """Enough by itself outside of quotes: no plain name, call or path."""
    if not re.search(r"\d", value):
        return _random_letters(value)
    return not re.fullmatch(r"[a-z]+(?:[A-Z]\w*)?\d*|[A-Za-z_]\w*\.\w+(?:\.\w+)*", value)


def _after_login(line: str) -> Iterator[tuple[int, int]]:
    """The second of two strings that stand together after a word for logging in, as in login("name", "value")."""
    at = [m.start() for m in _ANY_QUOTE.finditer(line)] if _LOGIN.search(line) else []
    for i in range(len(at) - 3):
        a, b, c, d = at[i : i + 4]
        if b - a > 1 and d - c > 6 and _BETWEEN.fullmatch(line, b + 1, c) and _LOGIN.search(line, at[i - 1] + 1 if i else 0, a):
            yield c + 1, d


def _alphabet(value: str) -> dict[int, int]:
    """The replacements that keep a value in its alphabet."""
    solid = value.strip()
    if len(solid) >= 8 and _IS_HEXADECIMAL.fullmatch(solid):
        return _HEXADECIMAL
    if len(solid) >= 16 and _IS_BASE32.fullmatch(solid):
        return _BASE32
    return _PLAIN


def mask_value(value: str) -> str:
    """value in characters of its alphabet; the last one before the padding of base 64 stands for zero, so that the bits beyond the end are zero."""
    head = value[:2] if value[:2] in ("0x", "0X") and _IS_HEXADECIMAL.fullmatch(value) else ""
    out = head + value[len(head) :].translate(_alphabet(value))
    bare = out.rstrip("=")
    if bare and len(bare) < len(out) and len(out) % 4 == 0 and re.fullmatch(r"[A-Za-z0-9+/_-]+", bare):
        out = bare[:-1] + "A" + out[len(bare) :]
    return out


def mask(text: str | None, spans: list[tuple[int, int, bool]]) -> str | None:
    """text with every value replaced; what delimits key blocks stays."""
    if not spans:
        return text
    out, at = [], 0
    for a, b, _ in spans:
        out.append(text[at:a])
        value = text[a:b]
        m = _BEGIN.match(value)
        if m:
            body = value[m.end() :]
            out.append(m.group() + re.sub(r"(\\[nrt])|([A-Za-z0-9]+)", lambda x: x.group(1) or x.group(2).translate(_PLAIN), body))
        else:
            out.append(mask_value(value))
        at = b
    return "".join(out) + text[at:]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, texts, lines = [], [], []
        for i, text in enumerate(batch.column(2).to_pylist()):
            spans = find_parts(text)
            if spans:
                at.append(i)
                texts.append(mask(text, spans))
                lines.append(lines_of(text, spans))
        rows = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(lines, pa.list_(pa.int32())), pa.array(texts, pa.string())], names=["chunk_id", "h", "lines", "redacted"])


def redacted_chunks(chunks: DataFrame) -> DataFrame:
    """(chunk_id, lines array<int>, redacted) of every chunk with a credential.

    Contents don't move: each row is looked at where it is read, and only what was found is reduced to one row a chunk.
    """
    rows = chunks.where("chunk_id is not null and content is not null").select(F.col("chunk_id").cast("string").alias("chunk_id"), F.xxhash64("content").alias("h"), "content", "created_at")
    newest = rows.groupBy("chunk_id").agg(F.max(F.struct("created_at", "h")).alias("newest"))
    found = rows.select("chunk_id", "h", "content").mapInArrow(_run, "chunk_id string, h long, lines array<int>, redacted string").dropDuplicates(["chunk_id", "h"])
    return found.join(newest.select("chunk_id", F.col("newest.h").alias("h")), ["chunk_id", "h"], "left_semi").select("chunk_id", "lines", "redacted")


def credentials(chunks: DataFrame) -> DataFrame:
    """(chunk_id, line_no) of every line on which a credential begins."""
    return redacted_chunks(chunks).select("chunk_id", F.explode("lines").alias("line_no"))
