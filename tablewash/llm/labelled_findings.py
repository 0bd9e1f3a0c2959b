"""Labelled findings: texts with one marked string each, and whether that is a secret."""

from __future__ import annotations

import random

_HEX, _LOWER = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
_MIXED = _LOWER + _LOWER.upper() + "0123456789"
_SYLLABLES = "an re tion la is ou ei ver sch en que ar mo li ta ker str qui do sen pa ing ed th er ung keit heit lich ble".split()
_PARTS = "get set user account file data list index handler service config default value name time page view table item".split()


def _text(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(n))


def _secret(r: random.Random) -> tuple[str, str]:
    """A secret, and the words before it that a writer would use."""
    pick = lambda letters, n: "".join(r.choices(letters, k=n))
    kind = r.random()
    if kind < 0.4:
        value = pick(_HEX, r.choice((32, 40, 40, 48, 64)))
    elif kind < 0.75:
        value = pick(_MIXED, r.randint(20, 48))
    elif kind < 0.85:
        value = pick(_MIXED + "+/", r.randint(30, 44)) + "="
    elif kind < 0.9:
        return "AKIA" + pick(_MIXED.upper(), 16), r.choice(("", "aws_access_key_id = ", "key: "))
    elif kind < 0.95:
        return "ghp_" + pick(_MIXED, 36), r.choice(("", "token: ", "git clone https://"))
    else:
        return "sk_live_" + pick(_MIXED, 24), r.choice(("", "stripe = ", "key="))
    name = r.choice(("token", "api_key", "apikey", "secret", "password", "auth_token", "access_key", "client_secret", "private_key"))
    name = r.choice((name, name.upper(), f"my_{name}"))
    return value, r.choice((f'{name} = "', f"{name}: ", f"{name}=", f"{name} = '", f'"{name}": "', "Authorization: Bearer ", f"{name} is "))


def _harmless(r: random.Random) -> tuple[str, str]:
    pick = lambda letters, n: "".join(r.choices(letters, k=n))
    kind = r.randrange(13)
    if kind < 4:
        word = ""
        while len(word) < 16:
            word += r.choice(_SYLLABLES)
        return r.choice((word, word.capitalize(), word.upper())), r.choice(("", "", "the ", "token ", "the key of ", "secret "))
    if kind == 4:
        return "_".join(r.choices(_PARTS, k=4)) + r.choice(("", "_2", "_max")), r.choice(("", "token = ", "def "))
    if kind == 5:
        return "".join(p.capitalize() for p in r.choices(_PARTS, k=4)), r.choice(("", "key = ", "new "))
    if kind == 6:
        return "usr/local/" + "/".join(r.choices(_PARTS, k=3)), r.choice(("/", "path: /", "token = /"))
    if kind == 7:
        return pick(_HEX, r.choice((32, 40, 64))), r.choice(("commit ", "sha256:", "md5 ", "checksum: ", "sha1 = ", "hash ", "digest: ", "etag: ", "revision "))
    if kind == 8:
        return "-".join(pick(_HEX, n) for n in (8, 4, 4, 4, 12)), r.choice(("uuid ", "id: ", "request ", "id = "))
    if kind == 9:
        return pick("0123456789", r.randint(16, 20)), r.choice(("", "number ", "card ", "call ", "id = "))
    if kind == 10:
        return pick(_MIXED + "+/", r.randint(40, 60)), r.choice(("data:image/png;base64,", "src=data:font/woff;base64,", "integrity=sha384-"))
    if kind == 11:
        return r.choice("=-_x") * r.randint(16, 40), r.choice(("", "password = ", "token = "))
    return r.choice(("your_api_key_here", "insert_token_here", "example_password_1234", "changeme_changeme", "my-secret-password")), r.choice(("api_key = ", "token: ", "password="))


def labelled_findings(n: int, seed: int = 0) -> list[tuple[str, str, int]]:
    """``n`` (text, marked string, 1 if it is a secret). The same for the same ``n`` and ``seed``."""
    out = []
    for i in range(n):
        r = random.Random(seed * 1_000_003 + i)
        value, before = _secret(r) if i % 2 else _harmless(r)
        quote = before[-1] if before[-1:] in ("'", '"') else ""
        out.append((f"{_text(r, r.randint(0, 8))} {before}{value}{quote}{r.choice((' ', '. ', chr(10), ', '))}{_text(r, r.randint(0, 6))}", value, i % 2))
    return out


_PEOPLE = "hunter dragon monkey summer winter orange tiger purple coffee silver magic shadow flower anna peter berlin qwerty admin welcome".split()
_NAMES = ("password", "passwd", "pwd", "db_password", "secret", "client_secret", "my_client_secret", "AWS_SECRET_ACCESS_KEY", "api_key",
          "token", "auth_token", "DATABASE_PASSWORD", "passphrase", "access_key")


def _short_secret(r: random.Random) -> str:
    pick = lambda letters, n: "".join(r.choices(letters, k=n))
    kind = r.random()
    if kind < 0.35:
        word = r.choice(_PEOPLE)
        word = r.choice((word, word.capitalize(), word.replace("a", "@").replace("o", "0").replace("e", "3").replace("s", "$")))
        return word + r.choice(("", "-", "_", "!", "@", "#")) + pick("0123456789", r.randint(1, 4)) + r.choice(("", "", "!", "abc", "xY", "$", "?"))
    if kind < 0.7:
        return pick(_MIXED, 1) + pick(_MIXED + "!@$&.:#%*+-_^~?/=", r.randint(4, 24)) + pick(_MIXED + "!$&#", 1)
    if kind < 0.9:
        return pick(_MIXED, r.randint(5, 40))
    return pick("0123456789", r.randint(4, 10))


def _no_secret(r: random.Random) -> str:
    name, word = r.choice(_PARTS), r.choice(("token", "password", "secret", "key"))
    return r.choice((
        "None", "null", "true", "false", "str", "string", "required", "optional", "undefined", "text", "bytes", "changeme", "*" * r.randint(3, 12),
        "x" * r.randint(3, 12), f"${{{word.upper()}}}", f"os.environ['{word.upper()}']", "getpass()", f"<{word}>", f"<your-{word}>", f"your_{word}",
        f"self.{word}", f"config.{name}", f"process.env.{word.upper()}", f"{{{{ {word} }}}}", f"${word.upper()}", f"{name}_{word}", f"get_{word}(user)",
        f"args.{word}", name, f"{name} {r.choice(_PARTS)}", "".join(r.choices(_SYLLABLES, k=r.randint(1, 4))), "the", "a", "and"))


def labelled_values(n: int, seed: int = 0) -> list[tuple[str, str, int]]:
    """``n`` (text, marked string, 1 if it is a secret) of values assigned to names that tell of secrets,
    in any alphabet and down to a few characters, of private-key blocks and of tokens with dots."""
    out = []
    for i in range(n):
        r = random.Random((seed + 1) * 1_000_033 + i)
        pick = lambda letters, k: "".join(r.choices(letters, k=k))  # noqa: B023, E731
        kind, quote = r.random(), r.choice(('"', '"', "'", ""))
        name, sign = r.choice(_NAMES), r.choice((" = ", "=", ": ", ":"))
        if i % 2 and kind < 0.1:
            label = r.choice(("RSA ", "EC ", "OPENSSH ", ""))
            lines = chr(10).join(pick(_MIXED + "+/", 64) for _ in range(r.randint(2, 6)))
            value, before, quote = f"-----BEGIN {label}PRIVATE KEY-----\n{lines}\n-----END {label}PRIVATE KEY-----", "", ""
        elif i % 2 and kind < 0.2:
            value = ".".join(("eyJ" + pick(_MIXED, r.randint(15, 33)), "eyJ" + pick(_MIXED, r.randint(30, 90)), pick(_MIXED + "-_", 42) + "A"))
            before, quote = r.choice(("Authorization: Bearer ", "", "jwt ", "see ")), ""
        elif not i % 2 and kind < 0.2:
            value = r.choice(("www.", "docs.", "com.example.")) + "".join(r.choices(_PARTS, k=4)) + r.choice((".com", ".html", ""))
            before, quote = r.choice(("", "see ", "import ")), ""
        else:
            value, before = _short_secret(r) if i % 2 else _no_secret(r), f"{name}{sign}{quote}"
            if quote and quote in value or not quote and (" " in value or "'" in value):
                value = name.lower() if not i % 2 else value.replace(quote or " ", "")
        out.append((f"{_text(r, r.randint(0, 8))} {before}{value}{quote}{r.choice((' ', chr(10), ', '))}{_text(r, r.randint(0, 6))}", value, i % 2))
    return out
