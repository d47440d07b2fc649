"""Patterns for personal data, redaction, question markers, and text helpers, as column expressions.

Java's \\w, \\d, \\s and \\b read ASCII only; here they are spelled out for all scripts, so that a number
inside Chinese text is part of a word, as a reader of that text would see it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_W = r"[\p{L}\p{N}_]"
_D = r"\p{Nd}"
_SPACES = r"\s\x1c-\x1f\x85   -     　"
_S = f"[{_SPACES}]"
_START, _END = rf"(?:(?<!{_W})(?={_W})|(?<={_W})(?!{_W}))", rf"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"

# What counts as each kind of personal data.
URL = rf"(?i)(?:https?://|www\.)[^<>{_SPACES}]+"
EMAIL = rf"(?i)(?<![\p{{L}}\p{{N}}_.+-])[\p{{L}}\p{{N}}_.+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+"
LOOSE_EMAIL = rf"(?i)[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_.-]+\.[a-z]{{2,}}"
IP = rf"(?<![{_D}.])(?:{_D}{{1,3}}\.){{3}}{_D}{{1,3}}(?![{_D}.])"
UUID = rf"(?i){_START}[0-9a-f]{{8}}-(?:[0-9a-f]{{4}}-){{3}}[0-9a-f]{{12}}{_END}"
PHONE = rf"(?<![\p{{L}}\p{{N}}_.])\+?{_D}[{_D} ()-]{{6,}}{_D}(?![\p{{L}}\p{{N}}_.])"
SHORT_PHONE = rf"(?<![\p{{L}}\p{{N}}_.])\+?{_D}[{_D} ()-]{{5,}}{_D}(?![\p{{L}}\p{{N}}_.])"
ANY_PHONE = rf"(?<!{_W})\+?{_D}[{_D} ()-]{{6,}}{_D}(?!{_W})"
DATE = rf"{_START}{_D}{{4}}[-/]{_D}{{1,2}}[-/]{_D}{{1,2}}{_END}"
_LABELS = "token|hash|password|passwd|secret|api[_ -]?key"
_MORE_LABELS = _LABELS + "|account|username|user[_ -]?id|login"
_FEWER_LABELS = "token|hash|password|secret|api[_ -]?key|account|username|user[_ -]?id"


def _labelled(labels: str) -> str:
    return rf"(?i)({_START}(?:{labels}){_END}{_S}*[:=：]{_S}*)[^&<>{_SPACES}]+"


SECRET = _labelled(_LABELS)
ACCOUNT = rf"((?:帳號|账号|用戶名|用户名|會員編號|会员编号|密碼|密码){_S}*[:=：]?{_S}*)[A-Za-z0-9_.@+-]+"
FEWER_ACCOUNT = rf"((?:帳號|账号|密碼|密码){_S}*[:=：]?{_S}*)[A-Za-z0-9_.@+-]+"
IDENTIFIER = rf"{_START}(?=[A-Za-z0-9_.-]{{4,}}{_END})(?=[A-Za-z0-9_.-]*[A-Za-z])(?=[A-Za-z0-9_.-]*{_D})[A-Za-z0-9_.-]+"
#: Marks of a question (fixed values).
QUESTION_MARKERS = ["?", "？", "請問", "是否", "哪個", "哪一個", "什麼", "多少", "可以提供", "麻煩提供", "能否提供", "方便提供", "有沒有", "是否可以"]


def long_hex(n: int) -> str:
    return rf"(?i){_START}[0-9a-f]{{{n},}}{_END}"


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, rf"^{_S}+|{_S}+$", "")


def blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(strip(c), F.lit("")) == ""


def _digits(c: Column) -> Column:
    return F.length(F.regexp_replace(c, rf"[^{_D}]", ""))


def phone_candidates(text: Column) -> Column:
    """array<string>: numbers of 8 to 15 digits that are no part of a URL, address, IP, UUID or date."""
    clean = text
    for pattern in (URL, EMAIL, IP, UUID, DATE):
        clean = F.regexp_replace(clean, pattern, " ")
    found = F.filter(F.regexp_extract_all(clean, F.lit(PHONE), F.lit(0)), lambda m: _digits(m).between(8, 15))
    return F.when(_digits(text) >= 8, found).otherwise(F.array().cast("array<string>"))


def pii_flags(text: Column) -> dict[str, Column]:
    return {
        "url": text.rlike(URL),
        "email": text.rlike(EMAIL),
        "phone_candidate": F.size(phone_candidates(text)) > 0,
        "ip_candidate": text.rlike(IP),
        "credential_candidate": text.rlike(SECRET),
    }


def _replace_phones(text: Column, pattern: str, label: str, least: int) -> Column:
    """Each match of least to 15 digits that is no date becomes the label; the texts between matches stay.

    Matches and the pieces between them come from one pattern, so they alternate.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    shown = F.transform(found, lambda m: F.when(~m.rlike(rf"^{_D}{{4}}-{_D}{{1,2}}-{_D}{{1,2}}$") & _digits(m).between(least, 15), F.lit(label)).otherwise(m))
    joined = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(shown, i), F.lit("")))), "")
    return F.when(F.size(found) > 0, joined).otherwise(text)


def redact(text: Column, profile: str, names: dict[str, str] | None = None) -> Column:
    """text with personal data masked by the rules of a profile: profile, segmentation, singles, roles or reconstruction.

    names (display name to alias) are replaced last, the longest first. A null text stays null.
    """
    swap = lambda t, pattern, label: F.regexp_replace(t, pattern, label)
    t = swap(text, URL, "[URL]")
    t = swap(t, EMAIL if profile in ("profile", "segmentation") else LOOSE_EMAIL, "[EMAIL]")
    t = swap(swap(t, IP, "[IP]"), UUID, "[ID]")
    if profile in ("profile", "segmentation", "singles"):
        t = swap(swap(t, SECRET, "$1[REDACTED]"), long_hex(24), "[ID]")
        if profile == "profile":
            found = F.array_sort(phone_candidates(t), lambda a, b: F.length(b) - F.length(a))
            t = F.aggregate(found, t, lambda acc, v: F.replace(acc, v, F.lit("[PHONE_CANDIDATE]")))
        else:
            t = _replace_phones(t, PHONE, "[PHONE_CANDIDATE]", 8)
    elif profile == "roles":
        t = swap(t, _labelled(_MORE_LABELS), "$1[REDACTED]")
        t = swap(t, ACCOUNT, "$1[ACCOUNT]")
        t = swap(swap(t, r"`[^`\n]+`", "[QUOTED_VALUE]"), long_hex(16), "[ID]")
        t = swap(t, rf"(?<!{_W})@[A-Za-z0-9_]+", "[HANDLE]")
        t = swap(_replace_phones(t, SHORT_PHONE, "[PHONE_OR_ID]", 7), IDENTIFIER, "[IDENTIFIER]")
    elif profile == "reconstruction":
        t = swap(t, _labelled(_FEWER_LABELS), "$1[REDACTED]")
        t = swap(swap(t, FEWER_ACCOUNT, "$1[ACCOUNT]"), long_hex(16), "[ID]")
        t = swap(t, ANY_PHONE, "[PHONE_OR_ID]")
    else:
        raise ValueError(f"no such profile: {profile}")
    for name in sorted(names or {}, key=len, reverse=True):
        t = F.replace(t, F.lit(name), F.lit(names[name]))
    return t


def template(text: Column) -> Column:
    """A message's shape: masked as in roles, then commands, numbers and white space."""
    t = F.regexp_replace(redact(text, "roles"), "/[A-Za-z][A-Za-z0-9_]*", "[COMMAND]")
    t = F.regexp_replace(t, rf"{_D}+", "[NUMBER]")
    return strip(F.regexp_replace(t, rf"{_S}+", " "))


def without_urls(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?i)(?:https?://|www\.)[^{_SPACES}]+", "")


def question_mark(text: Column) -> Column:
    """A question mark outside URLs, or a full-width one anywhere."""
    return without_urls(text).contains("?") | text.contains("？")


def question_hits(text: Column) -> Column:
    """array<string>: the markers that a text has outside URLs."""
    clean = without_urls(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*[F.lit(m) for m in QUESTION_MARKERS]), lambda m: F.contains(clean, m))


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot; empty if the last part of the path has none."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"^.+(\.[^.]+)$", 1))


def aliases(senders: Column, width: int = 2) -> Column:
    """array<struct<sender, alias>> of an array of names, numbered in their order."""
    return F.transform(F.array_sort(F.array_distinct(senders)), lambda s, i: F.struct(s.alias("sender"), F.concat(F.lit("Sender "), F.when(F.length((i + 1).cast("string")) >= width, (i + 1).cast("string")).otherwise(F.lpad((i + 1).cast("string"), width, "0"))).alias("alias")))
