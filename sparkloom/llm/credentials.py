"""Credentials in source code: a linear-chain conditional random field over lexical tokens.

A chunk is read in logical lines (a line and those it is continued on). They are cut into tokens: a string literal is one token if it
holds signs or is a phrase, words and signs are tokens of their own elsewhere. Shape and context features feed the field, and the Viterbi labels
(B begins a credential, I continues it, O is anything else) say exactly which characters are redacted.

Lines that hold neither a secret's name, nor a known key format, nor an address with a login, nor a key block are passed over, as
nothing in them tells a credential from any other literal (``gate=False`` reads them too; the README has what that changes).

The weights come from ``credential_training.py`` (generated, labelled lines; no data of the corpus) and lie beside this file.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import widen

LABELS = "OBI"
WEIGHTS = Path(__file__).with_name("credential_weights.json")

_RUN = r"[A-Za-z0-9_+/.!#%*~^$\-]+"
TOKEN = re.compile(r"-----(?:BEGIN|END) [A-Z0-9 ]+-----|[A-Za-z][A-Za-z0-9+.\-]*://|" + _RUN + r"|[^\s]")
_PIECE = re.compile(r"(?P<q>[\"'`])(?P<lit>(?:\\.|(?!(?P=q))[^\n\\])*)(?P=q)|" + TOKEN.pattern)
#: A literal that is one token: no white space, quotes or braces, at least one sign that would cut it, no address, scheme, wrapper or name=value.
_ONE = re.compile(r"(?=[^\s]*[&(),;@|?\[\]:])(?![A-Za-z][\w.\-]*[:\[])(?![^\s]*\w=[^=])(?!\$\()[^\s\"'`\\<>{}]{6,80}")
#: A name right before a literal that it is given; a phrase is one token only where the name is a password's.
_GIVEN = re.compile(r"([A-Za-z_$][\w$-]*)[\"'`\])]*\s*(?::=|=>|[:=,])\s*$")
_PHRASE = re.compile(r"[a-z]{2,}(?: [a-z]{2,}){2,7}")
#: Words of sentences; a phrase that holds one speaks to a reader.
_FUNCTION_WORDS = set("the a an of to in on for with your you is are be must should please enter invalid required not no and or this that from by at as it reset forgot wrong missing empty expired".split())


def tokens_of(text: str) -> list[tuple[int, int]]:
    """Places of the tokens of a text."""
    out = []
    for m in _PIECE.finditer(text):
        a, b = m.span()
        if m.group("q") is None:
            out.append((a, b))
            continue
        lit = m.group("lit")
        out.append((a, a + 1))
        name = _GIVEN.search(text, text.rfind("\n", 0, a) + 1, a) if " " in lit and _PHRASE.fullmatch(lit) else None
        if _ONE.fullmatch(lit) or name and name_class(name.group(1)) == "pw":
            out.append((a + 1, b - 1))
        else:
            out += [(a + 1 + x.start(), a + 1 + x.end()) for x in TOKEN.finditer(lit)]
        out.append((b - 1, b))
    return out


_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

#: Prefixes and forms of published key formats.
KNOWN = re.compile(
    r"(?:AKIA|ASIA)[A-Z0-9]{8,}|gh[pousr]_\w{16,}|github_pat_\w{20,}|glpat-[\w-]{12,}|xox[abeoprs]-[\w-]{8,}|[sr]k_(?:live|test)_\w{8,}|whsec_\w{12,}|SG\.[\w-]{8,}(?:\.[\w-]+)?"
    r"|AIza[\w-]{16,}|ya29\.[\w-]{12,}|hv[sb]\.[\w-]{12,}|s\.[A-Za-z0-9]{24}|npm_\w{16,}|pypi-[\w-]{16,}|dop_v1_\w{16,}|shp(?:at|ca|pa|ss)_\w{16,}|EAAC\w{16,}|sq0[a-z]{3}-[\w-]{12,}|key-[0-9a-f]{24,}|eyJ[\w-]{8,}(?:\.[\w-]*){0,2}"
)
_KNOWN_START = re.compile(r"AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abeoprs]-|[sr]k_live_|[sr]k_test_|whsec_|SG\.|AIza|ya29\.|hv[sb]\.|npm_|pypi-|dop_v1_|shp(?:at|ca|pa|ss)_|EAAC|sq0|eyJ|key-[0-9a-f]{24}")
SECRET_NAME = re.compile(
    r"(?i)pass(?:word|wd|phrase|wort|code)|pass(?![a-z])|pwd|secret|token|api.?key|access.?key|private.?key|signing.?key|encryption.?key|master.?key|client.?key|auth.?key|credential|kennwort|contrase[nñ]a|clave|mot.?de.?passe|senha|parola|bearer|basic\s|auth|(?<![a-z])key\s*[:=]|-u\s"
)
_GATE = re.compile(SECRET_NAME.pattern + "|" + _KNOWN_START.pattern.replace("AKIA", "(?-i:AKIA)", 1) + r"|://[^\s/:@\"']*:[^\s/@\"']+@|-----BEGIN|^\s*[\w.\"-]*value\b")
_VALUE = re.compile(r"[A-Za-z0-9_+/.!#%*~^$\-]{6,}|-----BEGIN")
_PLACEHOLDER = re.compile(
    r"(?i)^(?:x{3,}|\*{3,}|\.{3,}|0+|1234\w*|<.*>|changeme\d*|change[-_.]?(?:me|it|this)\w*|replace[-_.]?\w*|your[-_.]?\w[\w-]*|my[-_.]?(?:password|secret|token|key)|example\w*|sample\w*|dummy\w*|placeholder\w*|fake\w*|redacted|removed|hidden|masked|none|null|nil|undefined|todo|tbd|fixme|unset|empty|secret|password|passwd|token|set[-_.]?me|insert[-_.]?\w*|enter[-_.]?\w*|test|foo\w*|bar)$|(.)\1{5,}|(?i:x{6,})|EXAMPLE(?:KEY)?$"
)
_WORDY = re.compile(r"[A-Za-z]?[a-z]+(?:[-_./][a-z0-9]+)*|[A-Za-z]+(?:[A-Z][a-z]+)*")
_PASSWORD_WORD = re.compile(r"(?:[A-Z][a-z]{2,}|[a-z]{3,})(?:[-_.]?[A-Z][a-z]{2,})*[-_.]?\d{1,5}[!?#%&*$@+=.\-_]{0,2}")

PW = {"password", "passwd", "passphrase", "passwort", "passcode", "pass", "pwd", "kennwort", "contrasena", "clave", "senha", "parola", "motdepasse", "pw"}
SECRET = {"secret", "apikey", "credential", "credentials", "creds", "accesskey", "secretkey", "privatekey", "masterkey", "signingkey", "encryptionkey", "authkey", "apitoken", "authtoken", "accesstoken", "refreshtoken", "bearer", "pat", "privatetoken"}
KEY_HEAD = {"api", "access", "private", "master", "signing", "encryption", "secret", "auth", "client", "service", "account", "storage", "license", "webhook", "app", "hmac", "crypt", "cipher", "session", "shared", "prod"}
TOKEN_HEAD = {"auth", "access", "refresh", "private", "api", "bearer", "id", "deploy", "bot", "personal", "service", "session", "csrf", "oauth", "app", "user", "admin", "registry", "npm", "git"}
PUBLIC = {"hash", "checksum", "digest", "sha", "sha1", "sha256", "sha512", "md5", "etag", "integrity", "fingerprint", "commit", "revision", "uuid", "guid", "version", "public", "cert", "certificate", "stored", "salt", "nonce", "crc", "signature", "sum"}


@lru_cache(maxsize=200_000)
def name_class(name: str) -> str:
    """What an identifier says about the value it names."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    if not parts:
        return "-"
    joined = {a + b for a, b in zip(parts, parts[1:], strict=False)} | {"".join(parts[i : i + 3]) for i in range(len(parts) - 2)}
    have = set(parts) | joined
    if have & PUBLIC and not have & PW and (not have & SECRET or have & {"public", "hash", "hashed", "stored"}):
        return "public"
    if have & PW:
        return "pw"
    if have & SECRET:
        return "secret"
    last = parts[-1]
    before = parts[-2] if len(parts) > 1 else ""
    if last in ("key", "keys"):
        return "secret" if before in KEY_HEAD else "key"
    if last in ("token", "tokens"):
        return "secret" if before in TOKEN_HEAD else ("token" if len(parts) == 1 else "tokenish")
    if last in ("authorization", "auth"):
        return "auth"
    if last in ("basic",):
        return "basic"
    if last in ("value", "default", "data"):
        return "value"
    if last in ("env", "getenv", "environ") or (parts[0] in ("os", "process") and "env" in have):
        return "env"
    return "name"


@lru_cache(maxsize=200_000)
def shape(w: str) -> str:
    """A coarse class of a token's form."""
    if w.startswith("-----"):
        return "pem_private" if "BEGIN" in w and "PRIVATE KEY" in w and "ENCRYPTED" not in w else "pem_other"
    if w.endswith("://"):
        return "scheme"
    if len(w) == 1 and not w.isalnum():
        return "p" + w
    if _PLACEHOLDER.search(w):
        return "placeholder"
    if " " in w:
        return "sentence" if _FUNCTION_WORDS & set(w.split()) else "phrase"
    if re.fullmatch(r"[A-Za-z_$][\w.$]*\([^()]*\);?", w):
        return "call"
    if KNOWN.match(w):
        return "known"
    if w[0] == "$" and re.match(r"\$(?:2[aby]?|1|5|6|argon2\w*|pbkdf2\w*|scrypt|apr1|y)\$", w):
        return "hashed"
    if re.match(r"\$\w*$|\$\w+\.|%\w+%$|%[sd]?$|%\(", w):
        return "variable"
    n = len(w)
    if re.fullmatch(r"-?[\d.]+(?:[eE][+-]?\d+)?[a-z]{0,2}", w):
        return "number" if n < 12 else "digits"
    if re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", w, re.IGNORECASE):
        return "uuid"
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", w) and re.search(r"\d", w) and re.search(r"[A-Fa-f]", w):
        return "hex8" if n < 16 else "hex16" if n < 32 else "hex32" if n < 64 else "hex64"
    if re.fullmatch(r"(?:[\w-]+\.)+(?:com|org|net|io|dev|local|internal|example|lan|corp|prod|test|localhost)(?:/[\w./-]*)?", w) or w.startswith(("./", "../", "@")):
        return "host"
    if _WORDY.fullmatch(w):
        return "word"
    if re.fullmatch(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|[A-Z]+", w):
        return "upper"
    if _PASSWORD_WORD.fullmatch(w):
        return "wordnum" if n >= 6 else "short"
    if re.fullmatch(r"/?(?:[a-z0-9_.-]+/)+[a-z0-9_.-]*", w) and not re.search(r"\d[a-z]+\d", w):
        return "path"
    if re.fullmatch(r"[A-Za-z_]+(?:\.[A-Za-z_]+)+", w):
        return "member"
    kinds = bool(re.search(r"[a-z]", w)) + bool(re.search(r"[A-Z]", w)) + bool(re.search(r"\d", w)) + bool(re.search(r"[^A-Za-z0-9]", w))
    if n >= 16 and kinds >= 2 and len(set(w)) >= 9:
        return "random" if n < 60 else "blob"
    if n >= 6 and kinds >= 3:
        return "mixed"
    if n >= 6 and kinds == 2 and re.search(r"\d", w):
        return "alnum"
    return "other" if n >= 6 else "short"


def features(tokens: list[str], gaps: list[bool], before: str, config: bool, body: bool) -> list[list[str]]:
    """Feature names of every token. ``gaps``: white space before it; ``before``: name class of the line above."""
    n = len(tokens)
    shapes = [shape(t) for t in tokens]
    runs = [i for i in range(n) if shapes[i][0] != "p" or shapes[i] in ("placeholder", "path", "pem_private", "pem_other")]
    order = {i: k for k, i in enumerate(runs)}
    classes = {i: name_class(tokens[i]) for i in runs}
    seen_secret, seen_auth, comment = "-", "-", tokens[0][:1] in "#/*;" and not tokens[0].startswith("//" ) if n else False
    out = []
    for i, t in enumerate(tokens):
        s = shapes[i]
        if i not in order:
            prev = shapes[i - 1] if i else "^"
            nxt = shapes[i + 1] if i + 1 < n else "$"
            out.append(["b", "s=" + s, f"s={s}|{prev}", f"s={s}|{prev}|{nxt}", f"glue={prev}|{gaps[i]}|{nxt}"])
            continue
        k = order[i]
        p1 = runs[k - 1] if k else -1
        p2 = runs[k - 2] if k > 1 else -1
        left = "".join(tokens[p1 + 1 : i])[-4:]
        right = "".join(tokens[i + 1 : (runs[k + 1] if k + 1 < len(runs) else n)])[:3]
        c1 = classes[p1] if p1 >= 0 else "^"
        c2 = classes[p2] if p2 >= 0 else "^"
        login = p1 >= 0 and p2 >= 0 and shapes[p2] == "scheme" and left == ":" and right.startswith("@")
        userless = p1 >= 0 and shapes[p1] == "scheme" and right.startswith("@")
        query = left == "=" and p1 > 0 and tokens[p1 - 1] in "?&"
        joined = left in ('"+"', "'+'", '"."', "'.'", '""', "''", '"\\"', '("+"')
        nl = "n" if len(t) < 6 else "s" if len(t) < 12 else "m" if len(t) < 24 else "l" if len(t) < 64 else "x"
        key = c1 if c1 not in ("name", "value", "env", "-") else c2 if c2 in ("pw", "secret", "key", "auth", "public") else c1
        if key in ("value", "^", "name", "env") and before not in ("-", "name"):
            key = "up_" + before if c1 in ("value", "^") else key
        f = [
            "b", "s=" + s, "n=" + nl, f"sn={s}|{nl}", f"key={key}", f"c1={c1}", f"c2={c2}", f"s|key={s}|{key}", f"s|c1={s}|{c1}", f"s|c2={s}|{c2}", f"l={left}", f"r={right}", f"s|l={s}|{left}", f"s|r={s}|{right}",
            f"key|l={key}|{left[:2]}", f"line={seen_secret}|{s}", f"auth={seen_auth}|{s}", f"w1={tokens[p1].lower() if p1 >= 0 and len(tokens[p1]) < 12 else '-'}|{s}", f"cfg={config}|{key}|{s}",
        ]
        if login:
            f += ["login", f"login|{s}"]
        if userless:
            f.append(f"userless|{s}")
        if query:
            f += [f"query|{s}|{c1}"]
        if joined:
            f += ["joined", f"joined|{s}", f"joined|{s}|{shapes[p1] if p1 >= 0 else '^'}"]
        if s == "pem_private":
            f.append(f"pem|{body}")
        if comment:
            f.append(f"comment|{s}|{key}")
        out.append(f)
        if classes[i] in ("pw", "secret", "key", "public"):
            seen_secret = classes[i]
        if classes[i] in ("auth", "basic") or t.lower() in ("bearer", "authorization"):
            seen_auth = "yes"
    return out


class Field:
    """A linear-chain conditional random field: emission weights by feature name, label transitions."""

    def __init__(self, weights: dict[str, tuple[float, ...]], trans: list[list[float]], start: list[float]) -> None:
        self.weights, self.trans, self.start = weights, trans, start

    @classmethod
    @lru_cache(maxsize=1)
    def load(cls) -> Field:
        raw = json.loads(WEIGHTS.read_text())
        return cls({k: tuple(v) for k, v in raw["weights"].items()}, raw["trans"], raw["start"])

    def viterbi(self, feats: list[list[str]]) -> str:
        get, emit = self.weights.get, []
        for f in feats:
            o = b = i = 0.0
            for x in f:
                v = get(x)
                if v is not None:
                    o += v[0]
                    b += v[1]
                    i += v[2]
            emit.append((o, b, i))
        if not emit or all(e[0] >= e[1] + 6 for e in emit):
            return "O" * len(emit)  # no transition outweighs this
        score, back = [e + s for e, s in zip(emit[0], self.start, strict=True)], []
        for e in emit[1:]:
            best, arg = [], []
            for j in range(len(LABELS)):
                c = [score[k] + self.trans[k][j] for k in range(len(LABELS))]
                m = max(c)
                best.append(m + e[j])
                arg.append(c.index(m))
            score = best
            back.append(arg)
        y = [score.index(max(score))]
        for arg in reversed(back):
            y.append(arg[y[-1]])
        return "".join(LABELS[k] for k in reversed(y))


_CONTINUED = re.compile(r"""(?:["'`]\s*[+.\\]|[=(]|:\s*[|>][-+]?|=>)\s*$""")
_LITERAL = re.compile(r"""^\s+[bfru]?["'`]|^\s+-----BEGIN|^\s*[+.]\s*["'`]""")
_ADJACENT = re.compile(r"""["']\s*$""")
_STRING = re.compile(r"""^\s+[bfru]?["'](?!["'])""")
_BETWEEN = re.compile(r"""["'`](?:[+.\\(]*)[bfru]?["'`]""")
_NEXT_JOINS = re.compile(r"""^\s*[+.]\s*["'`]""")


def _joined(line: str, following: str) -> bool:
    """Whether a literal is continued from one line to the next."""
    return bool(_NEXT_JOINS.match(following) or (_CONTINUED.search(line) and _LITERAL.match(following)) or (_ADJACENT.search(line) and _STRING.match(following) and not line.rstrip().endswith(('"""', "'''"))))

_B64 = re.compile(r"^[\s#/*\"'+;\\-]*[A-Za-z0-9+/=]{16,}")
_BODY = re.compile(r"[\s#/*\"']*[A-Za-z0-9+/]*={0,2}(?:\\[rn])*[\s\"'+;,\\]*")


#: Literals of which a line must hold one (in lower case) to be read closely; the pattern above decides.
_NAMES = "pass pwd secret token key cred kennwort contrase clave senha parola mot bearer basic auth value -----begin akia asia ghp_ gho_ ghu_ ghs_ ghr_ github_pat glpat xox k_live_ k_test_ whsec_ sg. aiza ya29. hvs. hvb. npm_ pypi- dop_v1 shp eaac sq0 eyj".split() + ["-u "]


def _candidates(text: str, lines: list[str]) -> list[int]:
    """Indexes of the lines that hold a name, a key format or an address with a login."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    starts = np.cumsum([0, *(len(x) + 1 for x in lines)])
    at = set()
    for name in _NAMES:
        k = low.find(name)
        while k >= 0:
            i = int(starts.searchsorted(k, side="right")) - 1
            at.add(i)
            k = low.find(name, int(starts[i + 1]))
    k = low.find("://")
    while k >= 0:
        i = int(starts.searchsorted(k, side="right")) - 1
        if "@" in lines[i]:
            at.add(i)
        k = low.find("://", int(starts[i + 1]))
    return sorted(at)


def group_at(lines: list[str], i: int) -> tuple[int, int]:
    """First and last line of the logical line that line i belongs to, however many lines are joined."""
    a = b = i
    while a and _joined(lines[a - 1], lines[a]):
        a -= 1
    while b + 1 < len(lines) and _joined(lines[b], lines[b + 1]):
        b += 1
    return a, b


def key_body(lines: list[str], begin: int) -> range:
    """Indexes of the body lines of the key block that begins on line ``begin``.

    They reach up to the END line, whatever the lines between look like; where the text ends or another block begins before
    that, as far as the lines have the form of a body.
    """
    if "-----END" in lines[begin]:
        return range(0)
    shaped = True
    to = begin + 1
    for j in range(begin + 1, len(lines)):
        if "-----END" in lines[j]:
            return range(begin + 1, j)
        if "-----BEGIN" in lines[j]:
            break
        shaped = shaped and (_B64.match(lines[j]) or _BODY.fullmatch(lines[j])) is not None
        to = j + 1 if shaped else to
    return range(begin + 1, to)


def logical_lines(lines: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(index of the first line, lines) of each line together with those that continue it."""
    i = 0
    while i < len(lines):
        j = group_at(lines, i)[1]
        yield i, lines[i : j + 1]
        i = j + 1


def _carried(tokens: list[str], labels: str) -> str:
    """The labels with I on every literal that is joined to a part of a credential: no part of a value is open text."""
    out, last = list(labels), -1
    for i, y in enumerate(labels):
        if y != "O" or len(tokens[i]) > 1 or tokens[i].isalnum():
            if y == "O" and last >= 0 and i - last < 8 and _BETWEEN.fullmatch("".join(tokens[last + 1 : i])):
                out[i] = "I"
            last = i if out[i] != "O" else -1
    return "".join(out)


CONFIG_FILE = re.compile(r"(?i)\.(?:env|ini|cfg|conf|config|properties|toml|ya?ml|json|xml|tf|tfvars|npmrc|pypirc|netrc|pem|key|txt|sql|sh)(?:\.|$)|/\.env|dockerfile|secrets?\b|appsettings|/\.\w+rc$")


def credential_spans(text: str, path: str | None = None, field: Field | None = None, gate: bool = True) -> list[tuple[int, int, int, bool]]:
    """(line from 1, start and end within the line, begins) of every literal part to redact.

    A private key's body lines follow its BEGIN line up to the END line. Without ``gate`` the field reads every line.
    """
    field = field or Field.load()
    config = bool(path and CONFIG_FILE.search(path))
    lines = text.split("\n")
    out: list[tuple[int, int, int, bool]] = []
    done = -1
    for near in _candidates(text, lines) if gate else range(len(lines)):
        if near <= done or not _VALUE.search(lines[near]) and not _CONTINUED.search(lines[near]):
            continue
        at, done = group_at(lines, near)
        group = lines[at : done + 1]
        joint = "\n".join(group)
        if not _VALUE.search(joint) or gate and not _GATE.search(joint):
            continue
        toks, gaps, place = [], [], []
        end = 0
        for a, b in tokens_of(joint):
            toks.append(joint[a:b])
            gaps.append(a > end)
            place.append((a, b))
            end = b
        above = "-"
        if at:
            up = [t for t in TOKEN.findall(lines[at - 1]) if t[0].isalnum() or t[0] == "_"]  # of the whole line
            above = name_class(up[-1]) if up else "-"
        body = at + len(group) < len(lines) and bool(_B64.match(lines[at + len(group)])) or len(group) > 1 and bool(_B64.match(group[-1])) or "\\n" in joint
        labels = field.viterbi(features(toks, gaps, above, config, body))
        if "B" not in labels:
            continue
        labels = _carried(toks, labels)
        starts = [0]
        for x in group:
            starts.append(starts[-1] + len(x) + 1)
        begun = False
        for (a, b), y, t in zip(place, labels, toks, strict=True):
            if y == "O" or (y == "I" and not begun):
                continue
            begun = True
            k = int(np.searchsorted(starts, a, side="right")) - 1
            out.append((at + k + 1, a - starts[k], b - starts[k], y == "B"))
            if t.startswith("-----BEGIN"):
                for j in key_body(lines, at + k):
                    x = lines[j]
                    plain = re.fullmatch(r"\s*[A-Za-z0-9+/=]+\s*", x) is not None  # a leading + or / belongs to the key
                    first, last = len(x) - len(x.lstrip(None if plain else " \t#/*\"'+")), len(x.rstrip(None if plain else " \t\r\"'+;\\"))
                    if first < last:
                        out.append((j + 1, first, last, False))
    return out


def redact(text: str, spans: list[tuple[int, int, int, bool]], mask: str = "*") -> str:
    """``text`` with the characters of the spans masked one for one: lines, quotes and code around them stay."""
    lines = text.split("\n")
    for no, a, b, _ in spans:
        x = lines[no - 1]
        lines[no - 1] = x[:a] + mask * (b - a) + x[b:]
    return "\n".join(lines)


FOUND = "chunk_id bigint, line_no int, char_start int, char_end int, begins boolean"


def _inputs(chunks: DataFrame, chunk_id: str, text: str, path: str) -> DataFrame:
    return chunks.select(F.col(chunk_id).cast("bigint").alias("i"), F.col(path).alias("p"), F.col(text).alias("t"))


def find_credentials(chunks: DataFrame, chunk_id: str = "id", text: str = "chunk_content", path: str = "file_path") -> DataFrame:
    """``(chunk_id, line_no, char_start, char_end, begins)``: one row for each literal part of a credential.

    Lines count from 1 and end at ``\\n``, offsets count characters within the line. Null ids and null or empty texts give
    nothing, a null path counts as unknown, repeated rows are searched each. The parse is one pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *s) for i, p, t in zip(*(c.to_pylist() for c in b.columns), strict=True) if t for s in credential_spans(t, p)]
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0], pa.int64()), *(pa.array(x, pa.int32()) for x in c[1:4]), pa.array(c[4], pa.bool_())], names=[x.split()[0] for x in FOUND.split(", ")]
                )

    return widen(_inputs(chunks, chunk_id, text, path).where("i is not null and t is not null")).mapInArrow(run, FOUND)


def redact_credentials(chunks: DataFrame, chunk_id: str = "id", text: str = "chunk_content", path: str = "file_path") -> DataFrame:
    """``(chunk_id, n_credentials, redacted)`` for every row; a text without a credential comes back unchanged, null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, out = [], []
            for p, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                spans = credential_spans(t, p) if t else []
                n.append(sum(s[3] for s in spans))
                out.append(redact(t, spans) if spans else t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(out, pa.string())], names=["chunk_id", "n_credentials", "redacted"])

    return widen(_inputs(chunks, chunk_id, text, path)).mapInArrow(run, "chunk_id bigint, n_credentials int, redacted string")


def credential_lines(found: DataFrame) -> DataFrame:
    return found.where("begins").select("chunk_id", "line_no").distinct()
