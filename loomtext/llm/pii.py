"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors (at-signs, plus signs, digits, schemes and
identifier cues); a small deterministic parser then expands each anchor to the
boundaries of an email, address or account and validates it.  Nothing else of the
text is looked at.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomtext.llm.common import map_arrow, table, tidy

#: In the order of the result; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SCHEME_END = re.compile(r"[^\s<>\"'`{}|\\^]+")
_HANDLE = re.compile(r"@[A-Za-z0-9_](?:[A-Za-z0-9_.]{0,28}[A-Za-z0-9_])?(?![\w@-])")
_LEAD = r"\s*+(?:(?i:number|no\.?|id|#)\s*+)?[:=#]?\s*+"
_ACCOUNT = re.compile(_LEAD + r"([A-Za-z]{0,4}[0-9][A-Za-z0-9-]{4,33})(?![A-Za-z0-9])")
#: An IBAN as printed: single blanks or hyphens between its groups, letters of one case.
_PRINTED = re.compile(_LEAD + r"([A-Z]{2}[0-9]{2}(?:[ \xa0-]?[A-Z0-9]){11,30}|[a-z]{2}[0-9]{2}(?:[ \xa0-]?[a-z0-9]){11,30})")
_SECRETS = {
    "AKIA": re.compile(r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"),
    "ASIA": re.compile(r"ASIA[A-Z0-9]{16}(?![A-Za-z0-9])"),
    "ghp_": re.compile(r"ghp_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "sk-": re.compile(r"sk-[A-Za-z0-9_-]{20,}(?![A-Za-z0-9])"),
    "sk_live_": re.compile(r"sk_live_[A-Za-z0-9]{16,}(?![A-Za-z0-9])"),
    "xoxb-": re.compile(r"xoxb-[A-Za-z0-9-]{20,}(?![A-Za-z0-9])"),
    "AIza": re.compile(r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9])"),
    "eyJ": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    # as far as its END line, if that comes before another key's BEGIN; else the lines that look like a key
    "-----BEGIN ": re.compile(
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]++|-(?!----BEGIN [A-Z ]*PRIVATE KEY-----))*?-----END [A-Z ]*PRIVATE KEY-----|(?:\s*\n[A-Za-z-]+:[^\n]*+)*+(?:\s+[A-Za-z0-9+/=]{20,}+)*+)"
    ),
}
#: What follows a word for a secret: an assignment, perhaps quoted, of a value of eight characters or more with a digit.
_ASSIGNED = re.compile(r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?")
_VALUE = re.compile(r"[^\s,;\"'<>]*")
_TOKEN_RUN = re.compile(r"[A-Za-z0-9_-]*")
#: Places in an address that start the name of a person's folder or page, and credentials at its start.
_HOME = re.compile(r"(?=/(?:~|users?/|profiles?/|u/)[\w.-])")
_CREDENTIALS = re.compile(r"[^/?#@]+@[^/]")
#: Looked for in any case.
_KEYS = ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "access_key")
_CUES = ("account", "acct", "iban", "passport", "ssn", "social security", "customer", "member")
_SCHEMES = frozenset(("http", "https", "ftp", "sftp", "ssh", "git", "postgres", "postgresql", "mysql", "mongodb", "redis", "amqp", "smb"))


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for d in "0123456789":
        found.add_word(d, (1, "digit"))
    for c in "@+":
        found.add_word(c, (1, c))
    found.add_word("://", (3, "scheme"))
    for c in _SECRETS:
        found.add_word(c.lower(), (len(c), c))
    for c in _CUES:
        found.add_word(c, (len(c), "cue"))
    for c in _KEYS:
        found.add_word(c, (len(c), "key"))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def iban(code: str) -> bool:
    code = re.sub(r"[ \xa0-]", "", code).upper()
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _printed(text: str, at: int) -> tuple[int, int] | None:
    """The longest IBAN in groups that follows a cue ending at ``at``."""
    if m := _PRINTED.match(text, at):
        start, stop = m.span(1)
        while stop - start >= 15:
            if not text[stop : stop + 1].isalnum() and iban(text[start:stop]):
                return start, stop
            stop -= 1
            while text[stop - 1] in " \xa0-":
                stop -= 1
    return None


def _ip_ok(match: str) -> bool:
    return all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in match.split("."))


def _luhn_card(match: str) -> bool:
    digits = match.replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and luhn(digits)


def _phone_ok(match: str) -> bool:
    return 9 <= sum(c.isdigit() for c in match) <= 15


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in code points, end exclusive.

    For the base kinds these are the leftmost non-overlapping matches of their
    patterns, less those that fail validation: an anchor left of the last match of
    its kind is skipped, and a failing match is not tried again from inside.  A run of
    characters that an anchor has looked through is remembered, so that many anchors in one
    run cost no more than one; the whole takes time linear in the text.
    """
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    end = dict.fromkeys(KINDS, 0)
    last_digit = -2
    dry = dead = 0  # ends of runs known to hold no digit, and no signed token
    address = (0, 0, 0)  # of the last address run: end, end without closing marks, last place of a person's folder
    size = len(text)
    for last, (length, kind) in _automaton().iter(text.replace("\u0130", "i").lower()):  # of equal length
        at = last - length + 1
        if kind == "digit":
            run, last_digit = last_digit != at - 1, at
            for name, pattern, ok in (("ip", _IP, _ip_ok), ("card", _CARD, _luhn_card)):
                # a run of digits is tried once: at its start, or where the last match ended inside it
                if at >= end[name] and (run or at == end[name]):
                    if m := pattern.match(text, at):
                        end[name] = m.end()
                        if ok(m.group()):
                            out[name].append(m.span())
        elif kind == "+":
            if at >= end["phone"] and (m := _PHONE.match(text, at)):
                end["phone"] = m.end()
                if _phone_ok(m.group()):
                    out["phone"].append(m.span())
        elif kind == "@":
            start = at
            while start > end["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                end["email"] = m.end()
                out["email"].append((start, m.end()))
            elif start == at and at >= end["account"] and not (at and (text[at - 1].isalnum() or text[at - 1] in "@/")):
                if (m := _HANDLE.match(text, at)) and m.end() - at > 3:
                    end["account"] = m.end()
                    out["account"].append(m.span())
        elif kind == "scheme":
            start = at
            while start > end["url"] and at - start < 16 and text[start - 1].isascii() and text[start - 1].isalpha():
                start -= 1
            if text[start:at].lower() in _SCHEMES:
                if last + 1 >= address[0]:
                    m = _SCHEME_END.match(text, last + 1)
                    stop = whole = m.end() if m else last + 1
                    while stop > last + 1 and text[stop - 1] in ".,;:!?)]":
                        stop -= 1
                    home = -1
                    for m in _HOME.finditer(text, last + 1, stop):
                        home = m.start()
                    address = (whole, stop, home)
                stop = address[1]
                # only addresses that name a person: credentials, a home folder or a user page
                if stop > last + 1 and (address[2] > last or _CREDENTIALS.match(text, last + 1, stop)):
                    end["url"] = stop
                    out["url"].append((start, stop))
        elif kind == "cue":
            if at >= end["account"] and (at == 0 or not text[at - 1].isalnum()) and not (last + 1 < size and text[last + 1].isalpha()):
                cue = text[at : last + 1].lower()
                if cue in ("iban", "account", "acct") and (span := _printed(text, last + 1)):
                    end["account"] = span[1]
                    out["account"].append(span)
                elif m := _ACCOUNT.match(text, last + 1):
                    code = m.group(1)
                    digits = sum(c.isdigit() for c in code)
                    if iban(code) if cue == "iban" else digits == 9 if cue in ("ssn", "social security") else digits >= 5:
                        end["account"] = m.end(1)
                        out["account"].append(m.span(1))
        elif kind == "key":
            m = _ASSIGNED.match(text, last + 1) if last + 1 >= end["secret"] else None
            if m and m.end() >= dry:
                value = _VALUE.match(text, m.end())
                if value.end() - m.end() >= 8:
                    if any(map(str.isdigit, value.group())):
                        end["secret"] = value.end()
                        out["secret"].append(value.span())
                    else:
                        dry = value.end()
        elif at >= end["secret"] and (at == 0 or not text[at - 1].isalnum()) and (kind != "eyJ" or at >= dead):
            if m := _SECRETS[kind].match(text, at):
                end["secret"] = m.end()
                out["secret"].append(m.span())
            elif kind == "eyJ":
                run_end = _TOKEN_RUN.match(text, at).end()
                if run_end - at >= 11:  # not too short: what follows the run is wrong, for all of the run
                    dead = run_end
    return out


def listed(found: dict[str, list[tuple[int, int]]], kinds=KINDS) -> str:
    return ",".join([f"{k}:{a}:{b}" for k in kinds for a, b in found[k]])


def redact(text: str, found: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each span, or run of overlapping spans, as ``[KIND]`` of the first."""
    spans = sorted((a, -b, k) for k, each in found.items() for a, b in each)
    if not spans:
        return text
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, -b)
    return "".join([*out, text[at:]])


def find_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, counts of the base kinds, digest of the base spans, all spans.

    A null or empty text has none (the digest is that of '').  Whole texts are read;
    repeated rows give repeated results; other columns are not read.
    """
    key_type = docs.schema[key].dataType.simpleString()

    def run(_, keys, texts):
        found = [find(t or "") for t in texts]
        out = {"__key": keys} | {f"n_{k}": [len(f[k]) for f in found] for k in BASE}
        out["base_sha256"] = [hashlib.sha256(listed(f, BASE).encode()).hexdigest() for f in found]
        yield out | {"spans": [listed(f) for f in found]}

    counts = ", ".join(f"n_{k} bigint" for k in BASE)
    return map_arrow(docs, [key, text], run, f"__key {key_type}, {counts}, base_sha256 string, spans string").withColumnRenamed("__key", key)


def redact_documents(docs: DataFrame, *, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """All columns, with spans replaced in the text; ``n_chars`` follows where the table has it.  A null text stays null."""
    names = docs.columns
    schema = docs.schema

    def run(batches):
        for batch in batches:
            old = batch.column(names.index(text)).to_pylist()
            new = [t and redact(t, find(t)) for t in old]
            columns = list(batch.columns)
            columns[names.index(text)] = pa.array(new, batch.schema.field(text).type)
            if n_chars in names:
                kept = columns[names.index(n_chars)].to_pylist()
                columns[names.index(n_chars)] = pa.array([c if a == b else len(b) for a, b, c in zip(old, new, kept)], batch.schema.field(n_chars).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(tidy(run), schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_documents(table(spark, sf_dir, "documents"))
