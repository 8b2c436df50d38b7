"""Credentials embedded in source code and configuration.

Words that can name or begin a credential are found in one pass; the lines
around them are cut into lexical tokens. A literal counts if it isn't a
placeholder and is assigned or passed to a credential-named identifier, or if
its own form tells (addresses with a password, tokens of known form, key
blocks, authorization headers). Only the contents of literals are replaced:
quotes, escapes, line ends and all else stay, and so does the text's length.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.runtime import spread

# What names a secret, as the end of a name in lower case without separators.
SECRET_ENDS = (
    "password", "passwd", "passwort", "kennwort", "passphrase", "passcode", "pwd", "secret", "token", "credential", "credentials", "cred", "creds",
    "apikey", "accesskey", "secretkey", "privatekey", "signingkey", "masterkey", "deploykey", "licensekey", "licencekey", "aeskey", "hmackey", "encryptionkey",
    "sharedkey", "storagekey", "accountkey", "servicekey", "sshkey", "authkey", "sessionkey", "cryptokey", "signingseed", "pincode", "accesskeyid", "authorization",
    "cipherkey", "encryptkey", "decryptkey", "decryptionkey", "symmetrickey", "cryptkey", "fernetkey", "jwtkey", "tokenkey", "cookiekey", "mackey", "rootkey", "vaultkey", "wrapkey", "wrappingkey",
    "signkey", "seckey", "deskey", "rsakey", "pskkey", "presharedkey", "webhookkey", "adminkey", "serverkey", "clientkey", "subscriptionkey", "integrationkey", "gatewaykey", "merchantkey",
    "contrasena", "contraseña", "clave", "senha", "motdepasse", "mdp", "haslo", "hasło", "wachtwoord", "parola", "пароль", "пароля", "密码", "密碼", "パスワード", "비밀번호",
)
SHORT_NAMES = {"pass", "pw", "auth", "pin", "jwt", "bearer", "psk"}  # as the last word of a name
PASS_WORDS = {"bypass", "compass", "trespass", "encompass", "surpass", "overpass", "underpass"}
TRAILERS = {"b64", "base64", "hex", "raw", "value", "val", "plain", "encoded", "enc", "bytes", "str", "text", "string", "1", "2", "old", "new", "prod", "live", "dev", "default"}
# What makes of it the name of something about a secret.
ABOUT = {"env", "hint", "label", "help", "question", "type", "name", "path", "file", "field", "policy", "length", "len", "url", "uri", "id", "ref", "placeholder", "prompt", "title", "message", "pattern", "regex", "rule", "count", "size", "expiry", "ttl", "header", "param", "var", "key", "store", "provider", "service", "hash", "digest", "checksum", "algorithm", "issuer", "public", "cert"}
PLACEHOLDERS = {"changeme", "replaceme", "yourkeyhere", "exampleonly", "dummy", "todo", "tbd", "fixme", "none", "null", "nil", "undefined", "true", "false", "secret", "password", "passwort", "kennwort", "token", "placeholder", "redacted", "hidden", "masked", "bearer", "basic", "sample", "example", "test", "testing", "empty", "unset", "notset", "default", "insecure", "string", "xxx", "abc123", "password1", "passw0rd", "123456", "12345678"}
PLACEHOLDER_PARTS = ("example", "changeme", "change-me", "change_me", "placeholder", "replace-me", "replace_me", "replaceme", "dummy", "your-", "your_", "redacted", "insert-", "goes-here", "goeshere", "not-a-real", "notreal")
LOGINS = {"connect", "login", "logon", "signin", "authenticate", "session", "bind", "auth", "credentials"}  # words of functions that take a user and a secret
PAIRS = {"bind", "login", "logon", "signin", "account", "creds", "credentials", "userpass"}  # names of values like user/secret
ANCHORS = ["pass", "pwd", "pw_", "_pw", "pw=", "secret", "token", "cred", " pw ", "pw:", "pw is", "kennwort", "contras", "clave", "senha", "парол", "haslo", "hasło", "wachtwoord", "parola", "密码", "密碼", "パスワード", "비밀번호", "mdp", "apikey", "api_key", "api-key", "accesskey", "access_key", "access-key", "privatekey", "private_key", "private key", "signing", "masterkey", "master_key", "master-key", "deploykey", "deploy_key", "deploy-key", "licensekey", "license_key", "licence", "aeskey", "aes_key", "aes-key", "hmac", "encryption", "sharedkey", "shared_key", "storagekey", "storage_key", "accountkey", "account_key", "service_key", "servicekey", "ssh_key", "sshkey", "auth", "pin_code", "pincode", "_pin", "bearer", "basic ", "jwt", "akia", "asia", "aiza", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "sk_live", "sk_test", "rk_live", "sk-", "xox", "npm_", "sg.", "eyj", "/services/", "identified by", "curl ", "connect", "login", "logon", "signin", "sign_in", "session", "bind", "account", "zugang", "then type", "prompt", "mysql", "mariadb", "redis-cli", "ldapsearch", "sqlplus", "mongodump", "://"]
# Short names are looked for as words of their own; the other names as they read without separators, whatever stands between their words.
BARE_NAMES = sorted(w for w in SHORT_NAMES if not any(a in w for a in ANCHORS))
_SEPARATORS = {c: None for c in range(0xFFFF) if not chr(c).isalnum()}
_KEPT = np.array([c not in _SEPARATORS for c in range(0x10000)])
# Tokens whose form alone tells.
KNOWN = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|AIza[\w-]{35}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{22,}|glpat-[\w-]{20,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|sk-(?:proj-|ant-)?[A-Za-z0-9_-]{20,}"
    r"|xox[abposr]-(?:\d+-)+[A-Za-z0-9-]{16,}|npm_[A-Za-z0-9]{36}|SG\.[\w-]{16,}\.[\w-]{20,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{16,})(?![A-Za-z0-9])"
)
HOOK = re.compile(r"https?://[^\s\"'<>]*?/services/T[A-Z0-9]{6,}/B[A-Z0-9]{6,}/([A-Za-z0-9]{16,})")
URL_USER = re.compile(r"(?<=[\w+.-])://([^\s:/@\"'<>`]*):([^\s/@\"'<>`]+)@[\w\[]")
PARAM = re.compile(r"(?:[?&;]|(?<=[\"'\s]))([A-Za-z_][\w .-]{0,30}?)\s?=\s?([^;&\"'\s<>`]+)")
SCHEME = re.compile(r"(?i)\b(bearer|basic|token)\s+([A-Za-z0-9+/_.~-]{12,}={0,2})(?![\w<{$])")
BLOCK = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----(.{40,}?)-----END \1-----", re.S)
PROSE = [
    re.compile(r"(?i)\bidentified\s+by\s+(?:password\s+)?(['\"])(?P<v>[^'\"\n]+)\1"),
    re.compile(r"(?i)\bpassword\s+(['\"])(?P<v>[^'\"\n]+)\1"),
    re.compile(r"(?i)\bsshpass\s+-p\s*(?P<q>['\"]?)(?P<v>[^'\"\s]+)(?P=q)"),
    re.compile(r"(?i)\bsqlplus\s+[\w.-]+/(?P<v>[^\s@'\"]+)@"),
    re.compile(r"(?i)\b(?:type|enter|paste|tippe|tape[rz]?|escriba)\s+(?P<v>\S+)\s+(?:at|into|as|on|in|when)\b"),
    re.compile(r"(?i)\b(?:login|log-in|access|acceso|accès|zugang|acesso|dostęp|доступ|credentials?|account)\b[^\n]{0,80}?[:,]\s*[\w.@-]+\s*[/|]\s*(?P<v>\S+)"),
    re.compile(r"(?i)(?:passwor[dt]|kennwort|пароль|contraseña|senha|mot de passe|hasło|密码|パスワード)\s+(?:(?:is|ist|для|for|für|de|pour|para|do|von|of|at|on|to|na)\s+)?(?:[^\s:=]+\s*[:=]\s*)?(?P<v>[^\s'\"=:]+)\s*(?:\*/|-->)?\s*$"),
    re.compile(r"(?i)(?<!\w)(?:passwor[dt]|passwd|pwd|pw|pass|passphrase|secret|token|api key|kennwort|пароль|contraseña|clave|senha|mot de passe|hasło)\s+(?:is|was|ist|lautet|est|es|é|to|jest|это|=|:|->|→)\s*(?P<v>[^\s'\"]+)"),
    re.compile(r"(?i)(?:passwor[dt]|kennwort|пароль|contraseña|senha|mot de passe|hasło|密码|パスワード)[^\n:=]{0,60}[:=：]\s*(?P<v>[^\s'\"]+)\s*(?:\*/|-->)?\s*$"),
]
# Commands and what follows them on the line; apart, so that a long line with many of them is gone through once.
COMMANDS = [
    (re.compile(r"(?i)\b(?:curl|wget|http)\b"), re.compile(r"(?i)\s(?:-u|--user)[ =](?P<q>['\"]?)[^\s:'\"]+:(?P<v>[^\s'\"]+)(?P=q)")),
    (re.compile(r"(?i)\b(?:mysql\w*|mariadb\w*|mongo\w*)\b"), re.compile(r"(?i)\s(?:-p|--password[= ])(?P<v>[^\s'\"]+)")),
    (re.compile(r"(?i)\b(?:redis-cli|ldapsearch|ldapadd|smbclient)\b"), re.compile(r"(?i)\s-(?:a|w|U)\s*(?:[\w.-]+%)?(?P<v>[^\s'\"]+)")),
]
TOKEN = re.compile(
    r"(?P<str>(?:[bBrRuUfFL@$]{1,2}(?=[\"']))?(?:\"\"\".*?\"\"\"|'''.*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`))"
    r"|(?P<num>0[xX][0-9a-fA-F]+|\d+)|(?P<id>\$?[^\W\d][\w$]*(?:(?:\.|->|::|-(?=[^\W\d]))[^\W\d][\w$]*)*)|(?P<op>:=|=>|==|!=|[=:,()\[\]{}+.;<>?&|])|(?P<ws>\s+)|(?P<any>.)",
    re.S,
)
RAW = re.compile(r"^[ \t]*(?:export[ \t]+|set[ \t]+|-[ \t]+)?([^\W\d][\w.$-]*)[ \t]*(?:=|:[ \t])[ \t]*([^\s\"'{\[(][^\r\n]*?)[ \t]*$")
CALL = re.compile(r"[^\W\d][\w.]*\s*[(\[{]")  # no bare value, but code
MARKUP = re.compile(r"<([A-Za-z_][\w.-]*)>([^<>\s]+)</\1>")
XML_ADD = re.compile(r"(?:key|name|id)\s*=\s*\"([^\"]+)\"\s+value\s*=\s*\"([^\"]*)\"")
_WORDS = re.compile(r"[A-ZÀ-Þ]+(?![a-zß-ÿ])|[A-ZÀ-Þ]?[^\W\d_A-ZÀ-Þ]+|\d+")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
KEPT_TEXTS = 300_000  # whose secrets a task remembers
FAR, NEAR = 600, 300  # a line of more than twice FAR characters is also read anew this near to every word, in case a stray quote misleads the reading from its start


@lru_cache(maxsize=50_000)
def names_secret(name: str) -> bool:
    """Whether an identifier is called after a credential itself."""
    last = re.split(r"\.|->|::|/", name.strip("$\"'`:"))[-1]
    parts = [w.lower() for w in _WORDS.findall(re.sub(r"(?i)(?<=\w)[_-]?(?:base64|b64)$", "", last))]
    while parts and parts[-1] in TRAILERS and len(parts) > 1:
        parts.pop()
    if not parts:
        return False
    joined = "".join(parts)
    if joined.endswith(SECRET_ENDS):
        return parts[0] not in ("example", "sample", "placeholder", "public", "no", "has", "is")
    if parts[-1] in SHORT_NAMES:
        return True
    if joined.endswith("pass"):
        return joined not in PASS_WORDS and (parts[-1] == "pass" or name.isupper())
    return False


@lru_cache(maxsize=50_000)
def names_pair(name: str) -> bool:
    """Whether an identifier may hold a user and a secret in one."""
    parts = _WORDS.findall(re.split(r"\.|->|::", name.strip("$\"'`:"))[-1])
    return bool(parts) and parts[-1].lower() in PAIRS


def pair_at(v: str) -> int:
    """Where the secret of user/secret or user:secret begins; -1 if a value is none."""
    m = re.fullmatch(r"[A-Za-z][\w.@-]*[/:](\S{8,})", v)
    return m.start(1) if m and "/" not in m[1] and usable(m[1]) else -1


@lru_cache(maxsize=50_000)
def placeholder(v: str) -> bool:
    """Whether a literal stands for a secret that is elsewhere, or for none."""
    low = v.lower()
    if len(v) < 6 or re.search(r"\s", v) or "\u00ab" in v or "\u00bb" in v:
        return True
    if re.search(r"\$\{|\$\(|\{\{|\}\}|<%|#\{|^\$[A-Z_]+$|^%[^%]+%$|^<.*>$|^@[\w.]+@$|^\[.*\]$|^\{.*\}$|^&[a-z]+;$", v):
        return True
    bare = re.sub(r"[^a-z0-9]", "", low)
    if bare in PLACEHOLDERS or any(p in low for p in PLACEHOLDER_PARTS) or len(set(low)) <= 2:
        return True
    if re.match(r"(?:kv|vault|secret|secrets|ssm|arn|op|env|file|aws|gcp|azure)(?:[:/]|$)", low) or _UUID.fullmatch(v):
        return True
    return bool(re.fullmatch(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+", v) or re.match(r"https?://|/|\./", low))


@lru_cache(maxsize=50_000)
def usable(v: str) -> bool:
    """Whether a literal looks like a secret that works."""
    if placeholder(v):
        return False
    if re.fullmatch(r"[^\W\d_]+[?!.\u2026]+", v):  # the last word of a sentence
        v = v.rstrip("?!.\u2026")
    digit, low, up, sign = (re.search(p, v) is not None for p in (r"\d", r"[^\W\d_A-Z]", r"[A-Z]", r"[^\w.-]"))
    if re.fullmatch(r"[^\W\d]+(?:[._-][^\W\d]+)*", v):  # words or a name
        if all(p.islower() or p.isupper() or p.istitle() for p in re.split(r"[._-]", v)):
            return False
        return len(v) >= 12 and len(v) < 3.5 * (1 + len(re.findall(r"(?<=[a-z])[A-Z]", v)))  # names change case less often
    return (digit and (low or up or len(v) >= 10)) or (sign and (low or up))


def _begins_word(text: str, a: int, b: int) -> bool:
    """Whether a short name in a text can be a word of an identifier."""
    return not text[b : b + 1].islower() and (text[a].isupper() or not text[a - 1 : a].isalpha() or not a)


def _inside(tok: re.Match) -> tuple[int, int]:
    """The place of a string literal's contents."""
    a, b = tok.span("str")
    s = tok["str"]
    a += len(s) - len(s.lstrip("bBrRuUfFL@$"))
    n = 3 if s[a - tok.start("str") :].startswith(('"""', "'''")) else 1
    return a + n, b - n


class Tokens:
    """The tokens of a text from a place on, without blanks, read as they are
    asked for; at the end of a line, b, a quote that is open there is none."""

    def __init__(self, text: str, a: int, b: int):
        self.rest, self.read, self.first = chain(TOKEN.finditer(text, a, b), TOKEN.finditer(text, b)), [], 0

    def has(self, i: int) -> bool:
        while i - self.first >= len(self.read):
            t = next(self.rest, None)
            if t is None:
                return False
            if t.lastgroup != "ws":
                self.read.append(t)
        return True

    def __getitem__(self, i: int) -> re.Match:
        return self.read[i - self.first]

    def drop(self, i: int) -> None:
        """Forget what stands before token i."""
        if i - self.first > 10_000:
            del self.read[: i - self.first]
            self.first = i


class Finder:
    def __init__(self):
        self.words, self.names = ahocorasick.Automaton(), ahocorasick.Automaton()
        for w in (*ANCHORS, *BARE_NAMES):
            self.words.add_word(w, (len(w), w in BARE_NAMES))
        for w in (*SECRET_ENDS, "pass"):
            self.names.add_word(w, len(w))
        self.words.make_automaton()
        self.names.make_automaton()

    def anchors(self, text: str) -> list[int]:
        """Where a word begins that can name or begin a credential, in order."""
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        at = {end + 1 - size for end, (size, bare) in self.words.iter(low) if not bare or _begins_word(text, end + 1 - size, end + 1)}
        if named := [end + 1 - size for end, size in self.names.iter(low.translate(_SEPARATORS))]:
            chars = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
            at.update(np.flatnonzero(_KEPT[np.minimum(chars, 0xFFFF)])[named].tolist())
        return sorted(at)

    def find(self, text: str | None) -> list[tuple[int, int]]:
        """Start and end of every secret, in order, without overlaps."""
        if not text:
            return []
        out: list[tuple[int, int]] = []
        done, block = -1, False
        words = self.anchors(text)
        for at in words:
            if at < done:
                continue
            a, b = text.rfind("\n", 0, at) + 1, text.find("\n", at)
            b = len(text) if b < 0 else b
            far = b - a > 2 * FAR
            if not far:
                more = 0
                while more < 4 and b < len(text) and text[a:b].rstrip().endswith(("+", "\\", "(", ",", "{", "[", ".", "=", ":")):
                    nxt = text.find("\n", b + 1)
                    b, more = (len(text) if nxt < 0 else nxt), more + 1
            done = text.find("\n", at)
            done = len(text) if done < 0 else done
            if "-----" in text[a:b] and not block:
                block = True
                for m in BLOCK.finditer(text):
                    body = re.sub(r"\\[nrt]|[^A-Za-z0-9+/=]", "", m[2])
                    if len(body) >= 40 and len(set(body)) > 8:
                        out.append(m.span(2))
            out += self._line(text, a, b, far)
            if far:
                seen = -1
                for near in words[bisect_left(words, at) : bisect_left(words, done)]:
                    if near >= seen:
                        out += self._tokens(text, max(a, near - NEAR), b, near + FAR)
                        seen = near + FAR - NEAR
        merged: list[tuple[int, int]] = []
        for a, b in sorted(set(out)):
            if merged and a < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            elif a < b:
                merged.append((a, b))
        return merged

    def _line(self, text: str, a: int, b: int, far: bool) -> Iterator[tuple[int, int]]:
        line = text[a:b]
        for m in KNOWN.finditer(line):
            if "EXAMPLE" not in m[0]:
                yield a + m.start(), a + m.end()
        for m in HOOK.finditer(line):
            yield a + m.start(1), a + m.end(1)
        for m in URL_USER.finditer(line):
            if not placeholder(m[2]):
                yield a + m.start(2), a + m.end(2)
        for m in PARAM.finditer(line):
            v = m[2].rstrip(",)")
            if not CALL.match(v) and names_secret(m[1].replace(" ", "_")) and (usable(v) or (not placeholder(v) and v != v.lower() and not names_secret(v))):
                yield a + m.start(2), a + m.end(2)
        for m in SCHEME.finditer(line):
            v = m[2]
            if m[1].lower() == "basic":
                try:
                    if ":" not in base64.b64decode(v + "=" * (-len(v) % 4)).decode("utf-8"):
                        continue
                except ValueError:
                    continue
                yield a + m.start(2), a + m.end(2)
            elif usable(v) and len(v) >= 16:
                yield a + m.start(2), a + m.end(2)
        first = line.split("\n", 1)[0]
        for p in PROSE:
            for m in p.finditer(first):
                if usable(m["v"].rstrip(".,;:)")):
                    yield a + m.start("v"), a + m.start("v") + len(m["v"].rstrip(",;"))
        for command, option in COMMANDS:
            m = command.search(first)
            while m and (m := option.search(first, m.end())):
                if usable(m["v"].rstrip(".,;:)")):
                    yield a + m.start("v"), a + m.end("v")
                m = command.search(first, m.end())
        m = RAW.match(first.rstrip("\r"))
        if m and (far and not re.fullmatch(r"[\w+/=.~-]+", m[2]) or CALL.match(m[2])):
            m = None  # code
        if m and names_secret(m[1]):
            v = re.sub(r"\s+#.*$", "", m[2]).rstrip(",;")
            if usable(v):
                yield a + m.start(2), a + m.start(2) + len(v)
        if m and names_pair(m[1]) and (at := pair_at(m[2])) >= 0:
            yield a + m.start(2) + at, a + m.end(2)
        for m in (*MARKUP.finditer(line), *XML_ADD.finditer(line)):
            if names_secret(m[1]) and usable(m[2]):
                yield a + m.start(2), a + m.end(2)
            elif names_pair(m[1]) and (at := pair_at(m[2])) >= 0:
                yield a + m.start(2) + at, a + m.end(2)
        yield from self._tokens(text, a, b)

    def _tokens(self, text: str, a: int, b: int, upto: int | None = None) -> Iterator[tuple[int, int]]:
        """Of the names from a to b, or `upto`; what they are given is followed as far as it goes."""
        toks, i, upto = Tokens(text, a, b), -1, b if upto is None else min(upto, b)
        while toks.has(i := i + 1) and (t := toks[i]).start() < upto:
            toks.drop(i)
            if t.lastgroup == "id":
                name, key = t["id"], False
            elif t.lastgroup == "str":
                x, y = _inside(t)
                name, key = text[x:y], True
                if len(name) > 60:
                    continue
            else:
                continue
            j = i + 1
            if not key and toks.has(j) and toks[j][0] == "(":
                tail = re.split(r"\.|->|::", name)[-1]
                if LOGINS & {w.lower() for w in _WORDS.findall(tail)} or tail.lower() in ("signin", "logon", "sign_in"):
                    found = self._arguments(text, toks, j)
                    if len(found) >= 2 and len(found[-1]) == 1 and usable(found_text := text[slice(*found[-1][0])]) and len(found_text) >= 8:
                        yield from found[-1]
                    continue
                if names_secret(name):
                    for arg in self._arguments(text, toks, j)[-1:]:
                        if usable("".join(text[x:y] for x, y in arg)):
                            yield from arg
                    continue
            if not names_secret(name) and not names_pair(name):
                continue
            while toks.has(j) and toks[j][0] in ("]", ")", "?", "!"):
                j += 1
            if toks.has(j) and toks[j][0] == ":" and toks.has(j + 2) and toks[j + 1].lastgroup == "id" and toks[j + 2][0] == "=":
                j += 2  # a type
            if not toks.has(j) or toks[j][0] not in ("=", ":=", ":", "=>") and not (key and toks[j][0] == ","):
                continue
            if names_secret(name):
                yield from self._value(text, toks, j + 1)
            elif toks.has(j + 1) and toks[j + 1].lastgroup == "str":
                x, y = _inside(toks[j + 1])
                if (at := pair_at(text[x:y])) >= 0:
                    yield x + at, y

    def _value(self, text: str, toks: Tokens, j: int) -> Iterator[tuple[int, int]]:
        """The literal that begins at token j, joined from parts or made of bytes."""
        stop, held = j + 12, False
        while j < stop and toks.has(j) and (toks[j].lastgroup == "id" or toks[j][0] in ("(", "[", "]", "{", "<", ">")):
            held = held or toks[j][0] in ("(", "[", "{")
            j += 1  # constructors and casts
        if toks.has(j) and toks[j].lastgroup == "str" and text[slice(*_inside(toks[j]))] in ("C*", "c*", "H*") and toks.has(j + 1):
            j += 2
        if toks.has(j) and toks[j].lastgroup == "str":
            parts = []
            while toks.has(j) and toks[j].lastgroup == "str":
                parts.append(_inside(toks[j]))
                j += 1
                if toks.has(j + 1) and toks[j][0] in ("+", ".", "..", "&", "\\") and toks[j + 1].lastgroup == "str":
                    j += 1
                elif not (toks.has(j) and toks[j].lastgroup == "str" and (held or self._goes_on(text, toks, j))):
                    break
            whole = "".join(text[x:y] for x, y in parts)
            if "-----BEGIN" not in whole and usable(re.sub(r"(?i)^(?:bearer|basic|token) +(?=\S{12})", "", whole)):
                for x, y in parts:
                    m = re.match(r"(?i)(?:bearer|basic|token) +", text[x:y])
                    yield x + (m.end() if m else 0), y
        elif toks.has(j) and toks[j].lastgroup == "num":
            nums = []
            while toks.has(j) and toks[j].lastgroup == "num":
                nums.append(toks[j])
                comma = toks.has(j + 1) and toks[j + 1][0] == ","
                j += 2 if comma else 1
                if not comma and not held and toks.has(j) and "\n" in text[nums[-1].end() : toks[j].start()]:
                    break
            values = [int(n[0], 0) if n[0][:1] != "0" or n[0][1:2] in "xX" else int(n[0]) for n in nums]
            if len(nums) >= 8 and max(values) < 256 and len(set(values)) > 2:
                for n in nums:
                    yield n.start() + (2 if n[0][:2] in ("0x", "0X") else 0), n.end()

    def _goes_on(self, text: str, toks: Tokens, j: int) -> bool:
        """Whether literal j belongs to the one before it: on the same line, or if both are of a statement that ends so."""
        if "\n" not in text[toks[j - 1].end() : toks[j].start()]:
            return True
        quote = toks[j - 1][0][-1]
        while toks.has(j) and toks[j].lastgroup == "str" and toks[j][0][-1] == quote:
            j += 1
        return toks.has(j) and toks[j][0] == ";"

    def _arguments(self, text: str, toks: Tokens, j: int) -> list[list[tuple[int, int]]]:
        """The literal arguments of the call whose bracket is token j."""
        out, arg, open_ = [], [], []
        while toks.has(j):
            t = toks[j]
            if t[0] in ("(", "[", "{"):
                open_.append(t[0])
            elif t[0] in (")", "]", "}"):
                if open_.pop() + t[0] not in ("()", "[]", "{}") or not open_:
                    break  # of the call, or of what stands around one that isn't closed
            elif t[0] == ";" and "{" not in open_:
                break
            elif t[0] == "," and open_.count("(") == 1:
                out.append(arg)
                arg = []
            elif t.lastgroup == "str" and open_.count("(") == 1:
                arg.append(_inside(t))
            j += 1
        out.append(arg)
        return [x for x in out if x]


_ESCAPE = re.compile(r"\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|\\.|\s|-----[A-Z ]+-----", re.S)


def redact(text: str | None, spans: list[tuple[int, int]], mark: str = "*") -> str | None:
    """The text with every character of the spans replaced, but escapes, blanks
    and line ends; of equal length. Null gives null."""
    if not text or not spans:
        return text
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        p = a
        for m in _ESCAPE.finditer(text, a, b):
            out += [mark * (m.start() - p), m[0]]
            p = m.end()
        out.append(mark * (b - p))
        at = b
    return "".join(out) + text[at:]


_FINDER: list[Finder] = []


def scan(df: DataFrame, keys: list[str], text: str, with_text: bool = False) -> DataFrame:
    """`keys`, `spans` (array of start and end in code points) and, on request,
    `redacted` of the rows that hold a secret.

    Null, empty and clean texts give no row; repeated rows come out as often
    as they come in. Other columns are not read. Nothing is shuffled.
    """
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _FINDER:
            _FINDER.append(Finder())
        find = _FINDER[0].find
        kept: dict[bytes, list[tuple[int, int]]] = {}  # copies of a text are read once
        for b in batches:
            hit, found = [], []
            for i, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if not t:
                    continue
                mark = xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass"))
                spans = kept.get(mark)
                if spans is None:
                    spans = kept[mark] = find(t)
                if spans:
                    hit.append(i)
                    found.append(spans)
            if len(kept) > KEPT_TEXTS:
                kept.clear()
            part = b.take(pa.array(hit, pa.int64()))
            out = [*part.columns[:-1], pa.array([[{"start": x, "end": y} for x, y in s] for s in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            names = [*keys, "spans"]
            if with_text:
                out.append(pa.array([redact(t, s) for t, s in zip(part.column(part.num_columns - 1).to_pylist(), found)], pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return spread(df.select(*keys, F.col(text).alias("_text"))).mapInArrow(run, f"{kinds}, spans array<struct<start:int,end:int>>" + (", redacted string" if with_text else ""))


def scan_records(nodes: DataFrame, chunks: DataFrame, with_text: bool = False) -> DataFrame:
    """scan() of all nodes and chunks, by `rec_kind` and `rec_id`, once per record."""
    n = nodes.select(F.lit("node").alias("rec_kind"), F.col("id").alias("rec_id"), F.col("source_code").alias("text"))
    c = chunks.select(F.lit("chunk").alias("rec_kind"), F.col("chunk_id").alias("rec_id"), F.col("chunk_text").alias("text"))
    return scan(n.unionByName(c), ["rec_kind", "rec_id"], "text", with_text).dropDuplicates(["rec_kind", "rec_id"])
