"""Screening of names and texts for secrets: the first reason found, or null."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from filewright.functions.text import nfkc

# Names, extensions and words that mark a secret, and patterns of its contents.
NAMES = (".env", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "credentials", "secring.gpg", "shadow")
EXTENSIONS = (
    ".key", ".pem", ".pfx", ".p12", ".p8", ".jks", ".keystore", ".kdbx", ".kdb", ".agilekeychain",
    ".keychain", ".ovpn", ".asc", ".gpg", ".pgp", ".ppk", ".crt", ".cer", ".der", ".pub",
    ".wallet", ".jwk", ".p7b", ".pkcs12",
)
WORDS = (
    "password", "passwd", "passphrase", "secret", "credential", "token", "apikey", "api_key", "api-key",
    "privatekey", "private_key", "private-key", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519",
    "ssh_key", "sshkey", "keystore", "keyring", "keychain", "htpasswd", "netrc", "npmrc", "pypirc",
    "git-credentials", "authorized_keys", "known_hosts", "service-account", "serviceaccount",
    "client_secret", "clientsecret", "recovery-code", "recovery_code", "mnemonic", "seed-phrase",
    "seed_phrase", "seedphrase", "bitwarden", "1password", "lastpass", "keepass", "dotenv",
    "wallet", "authinfo", "kubeconfig", "shadow", "logins", "passwords", "chrome-passwords",
    "vault_export", "密碼", "金鑰", "私鑰", "憑證", "錢包", "助記詞", "復原碼", "備份金鑰", "機密", "帳密",
)
#: Words that documents may carry in their names, and the extensions of documents.
WEAK_WORDS = ("token", "password", "passwd", "secret", "credential", "credentials", "auth", "密碼", "金鑰", "憑證", "機密", "帳密")
DOCUMENTS = (".pdf", ".docx", ".pptx", ".doc", ".ppt")
PATTERNS = (
    ("a private key header", r"-----BEGIN[A-Z0-9 ]{0,40}PRIVATE KEY-----"),
    ("a PGP private key header", r"-----BEGIN PGP PRIVATE KEY BLOCK-----"),
    ("an OpenSSH private key header", r"-----BEGIN OPENSSH PRIVATE KEY-----"),
    ("a certificate header", r"-----BEGIN CERTIFICATE-----"),
    ("an AWS key id", r"(?<![A-Z0-9])(?:AKIA|ASIA|ABIA|ACCA)[0-9A-Z]{16}(?![0-9A-Z])"),
    ("an AWS secret key field", r"(?i)aws_secret_access_key\s*[:=]"),
    ("GitHub token", r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{16,}"),
    ("GitHub token", r"(?<![A-Za-z0-9_])github_pat_[A-Za-z0-9_]{20,}"),
    ("a key starting with sk-", r"(?<![A-Za-z0-9_-])sk-[A-Za-z0-9_-]{16,}"),
    ("Slack token", r"(?<![A-Za-z0-9_-])xox[abprs]-[A-Za-z0-9-]{8,}"),
    ("a Google API key", r"(?<![A-Za-z0-9_-])AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"),
    ("a Bearer authorization header", r"""(?i)authorization\s*[:=]\s*["']?bearer\s+[A-Za-z0-9._~+/=-]{16,}"""),
    ("a national ID number", r"(?<![A-Za-z0-9])[A-Za-z][12][0-9]{8}(?![0-9A-Za-z])"),
    ("a Stripe key", r"(?<![A-Za-z0-9_-])(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{10,}"),
    ("a connection string with a password", r"(?i)(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp|ftp|ssh)://[^\s:@/]+:[^\s@/]{3,}@"),
    ("JWT", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    ("Kubernetes Secret", r"kind:\s*Secret\b"),
    ("a .pgpass line", r"(?m)^[^\s:]+:\d{1,5}:[^\s:]*:[^\s:]+:\S+$"),
    ("a private key field", r"""(?i)(?:^|[\s,{"'])(?:private_key|privatekey|client_secret|api[_-]?secret)["']?\s*[:=]"""),
)
#: What a text must contain for a pattern to match, by its place above; (?i) patterns are lower-cased.
GUARDS = {
    **dict.fromkeys(range(4), ("-----BEGIN",)),
    4: ("AKIA", "ASIA", "ABIA", "ACCA"), 5: ("aws_secret",), 6: ("gh",), 7: ("github_pat_",), 8: ("sk-",), 9: ("xox",), 10: ("AIza",), 11: ("bearer",),
    13: ("k_live_", "k_test_"), 14: ("://",), 15: ("eyJ",), 16: ("kind:",), 17: (":",), 18: ("private", "secret"),
}
#: Looked ahead for, so that a group that a longer number has taken may begin another one.
CARD = r"(?<![0-9])(?=((?:[0-9][ -]?){12,18}[0-9])(?![0-9]))"
USER_WORDS = r"(?i)\b(?:username|user_name|user|account|login|email)\b|帳號|使用者|電子郵件|信箱"
PASS_WORDS = r"(?i)\b(?:password|passwd|pwd|secret|passphrase)\b|密碼|通行碼|口令"
TABLE_HEAD, TABLE_LINES, TABLE_LINE_CHARS = 4000, 40, 400


def by_name(name: Column) -> Column:
    """Why a file's name alone marks a secret; null if it does not."""
    text = F.lower(nfkc(name))
    document = reduce(or_, (text.endswith(x) for x in DOCUMENTS))
    reason = F.when(text.isin(*NAMES), F.concat(F.lit("the file is named "), text))
    reason = reason.when(text.startswith(".env.") | text.endswith(".env"), "the file is an environment file (.env)")
    for x in EXTENSIONS:
        reason = reason.when(text.endswith(x), f"the extension is {x}")
    for w in WORDS:
        reason = reason.when(text.contains(w) & ~document if w in WEAK_WORDS else text.contains(w), f"the name contains “{w}”")
    return reason


def has_card_number(text: Column) -> Column:
    """The longest run of 13 to 19 digits from any group on, grouped by blanks or dashes, that passes the Luhn check."""
    bare = lambda x: F.regexp_replace(x, "[ -]", "")
    return F.coalesce(F.exists(F.regexp_extract_all(text, F.lit(CARD), F.lit(1)), lambda x: F.call_function("luhn_check", bare(x))), F.lit(False))


def looks_like_credential_table(text: Column) -> Column:
    """A short line near the start that names a user and a password and is separated like a table."""
    lines = F.slice(F.split(F.substring(text, 1, TABLE_HEAD), r"\r?\n"), 1, TABLE_LINES)
    return F.coalesce(F.exists(lines, lambda x: (F.length(x) <= TABLE_LINE_CHARS) & x.rlike(USER_WORDS) & x.rlike(PASS_WORDS) & x.rlike(r"[,;\t|:]")), F.lit(False))


def by_content(text: Column) -> Column:
    """Why a text holds a secret; null if it does not. The order of the patterns decides."""
    reason = F.when(text == "", None)
    low = F.lower(text)
    for n, (label, pattern) in enumerate(PATTERNS):
        told = text.rlike(pattern)
        if n in GUARDS:
            told = reduce(or_, ((low if pattern.startswith("(?i)") else text).contains(x) for x in GUARDS[n])) & told
        reason = reason.when(told, f"the contents hold {label}")
    reason = reason.when(has_card_number(text), "the contents hold a credit card number")
    return reason.when(looks_like_credential_table(text), "the contents look like a table of usernames and passwords")


def screen(name: Column, text: Column, own_key: str | None = None) -> Column:
    """The name decides first, then the caller's own key in the text, then the contents."""
    own = F.when(text.contains(own_key), "the contents hold the key in use") if own_key else F.lit(None).cast("string")
    return F.coalesce(by_name(name), own, by_content(text))
