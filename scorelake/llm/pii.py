"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors (at-signs, schemes, plus signs, digit pairs, identifier cues).
At each anchor a deterministic local parser expands left and right to the longest well-formed
value, then validates it: domain labels, octets, Luhn and mod-97 checks. Nothing is found by
scanning with regular expressions, so the cost is one automaton pass plus the anchors' own work.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.llm._common import mapped, require

_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_DIGIT = frozenset("0123456789")
_LOCAL = _ALNUM | frozenset("._%+-'")
_DOMAIN = _ALNUM | frozenset(".-")
_UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _ALNUM - _DIGIT
_HEX = frozenset("0123456789abcdefABCDEF")
#: Words between a cue and its value, and the ends of cues such as 'telephone'.
_FILL = frozenset(("no", "number", "nr", "num", "is", "s", "ephone", "e", "ph"))
CUES = ("ssn", "iban", "passport", "tel", "phone", "mobile", "fax", "account", "acct")
#: Overlapping findings: the kind that comes first here wins, then a card in its usual groups, the longer, the earlier one.
KINDS = ("url_login", "email", "iban", "card", "ssn", "ip", "phone", "account")


def _edge(text: str, start: int, end: int) -> bool:
    """No letter or digit touches the span, so it isn't cut out of a longer token."""
    return not (start > 0 and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _host(host: str) -> bool:
    labels = host.split(".")
    if len(labels) < 2 or len(host) > 253:
        return False
    if not all(x and len(x) <= 63 and x[0] != "-" and x[-1] != "-" for x in labels):
        return False
    return len(labels[-1]) >= 2 and labels[-1].isascii() and labels[-1].isalpha()


def email_at(text: str, at: int) -> tuple[int, int] | None:
    """The address around the at-sign at ``at``."""
    lo = at
    while lo > 0 and at - lo < 64 and text[lo - 1] in _LOCAL:
        lo -= 1
    dots = text.rfind("..", lo, at)
    lo = dots + 2 if dots >= 0 else lo
    while lo < at and text[lo] in ".-'%+":
        lo += 1
    local = text[lo:at]
    hi = at + 1
    while hi < len(text) and hi - at < 255 and text[hi] in _DOMAIN:
        hi += 1
    if not local or local[-1] == ".":
        return None
    # prose that goes on without a space ("a@b.com.2 of them") ends at the longest host that is valid
    while hi > at + 1 and not _host(text[at + 1 : hi]):
        hi = max(text.rfind(".", at + 1, hi), text.rfind("-", at + 1, hi))
    return (lo, hi) if hi > at + 1 else None


def url_login_at(text: str, at: int) -> tuple[int, int] | None:
    """user:password of a URL whose '://' begins at ``at``; the scheme, the at-sign and the host stay."""
    lo = at + 3
    hi = lo
    while hi < len(text) and hi - lo < 256 and not text[hi].isspace() and text[hi] not in "/?#@\"'<>":
        hi += 1
    if hi < len(text) and text[hi] == "@" and ":" in text[lo:hi] and at > 0 and text[at - 1] in _ALNUM:
        return lo, hi
    return None


def ip_at(text: str, at: int) -> tuple[int, int] | None:
    """The IPv4 address around the digit at ``at``."""
    lo, hi = at, at
    while lo > 0 and at - lo < 20 and (text[lo - 1] in _DIGIT or text[lo - 1] == "."):
        lo -= 1
    while hi < len(text) and hi - at < 20 and (text[hi] in _DIGIT or text[hi] == "."):
        hi += 1
    while lo < hi and text[lo] == ".":
        lo += 1
    while hi > lo and text[hi - 1] == ".":
        hi -= 1
    parts = text[lo:hi].split(".")
    if len(parts) != 4 or not all(p and len(p) <= 3 and int(p) <= 255 and (p == "0" or p[0] != "0") for p in parts):
        return None
    return (lo, hi) if _edge(text, lo, hi) else None


def ip6_at(text: str, at: int) -> tuple[int, int] | None:
    """The IPv6 address around the colon at ``at``: eight groups, or fewer around one '::', the last two perhaps as an IPv4 address.

    It holds a digit, so that names parted by '::' are none.
    """
    lo, hi = at, at
    while lo > 0 and at - lo < 42 and (text[lo - 1] in _HEX or text[lo - 1] == ":"):
        lo -= 1
    while hi < len(text) and hi - at < 42 and (text[hi] in _HEX or text[hi] == ":"):
        hi += 1
    groups, tail = 8, None
    if hi < len(text) and text[hi] == "." and text[hi - 1] in _DIGIT:
        tail = ip_at(text, hi - 1)
        if tail is None or tail[0] <= at or text[tail[0] - 1] != ":":
            return None
        groups, hi = 6, tail[0] - (text[tail[0] - 2] != ":")
    # prose may go on with a colon, or begin with one
    while hi > lo and text[hi - 1] == ":" and text[hi - 2 : hi] != "::":
        hi -= 1
    while lo < hi and text[lo] == ":" and text[lo : lo + 2] != "::":
        lo += 1
    v = text[lo:hi]
    halves = v.split("::")
    parts = [h.split(":") if h else [] for h in halves]
    if len(halves) > 2 or not all(0 < len(g) <= 4 for h in parts for g in h):
        return None
    n = sum(map(len, parts))
    if n != groups if len(halves) == 1 else not 0 < n + (tail is not None) < groups:
        return None
    end = tail[1] if tail else hi
    return (lo, end) if any(c in _DIGIT for c in text[lo:end]) and _edge(text, lo, end) else None


def local_phone_at(text: str, at: int) -> tuple[int, int] | None:
    """ddd-ddd-dddd, with dots too, or (ddd) ddd-dddd at the digit ``at``, where a group begins: area and exchange from 2 on."""
    v = text[at : at + 14]
    opened = at > 0 and text[at - 1] == "("
    gap = 2 if opened and v[3:5] == ") " else 1
    if v[3:4] not in ((")",) if opened else ("-", ".")):
        return None
    rest = v[3 + gap :]
    mark = rest[3:4]
    if mark not in ("-", ".") or not opened and mark != v[3]:
        return None
    digits, lo, end = v[:3] + rest[:3] + rest[4:8], at - opened, at + 3 + gap + 8
    if len(digits) != 10 or not all(c in _DIGIT for c in digits) or digits[0] in "01" or digits[3] in "01":
        return None
    return (lo, end) if _edge(text, lo, end) and not (lo > 0 and text[lo - 1] in "-.") and text[end : end + 1] != "-" else None


def _digits(text: str, at: int, most: int) -> tuple[int, int, str]:
    """The run of digits around ``at``, in groups that one space or hyphen parts."""
    lo = at
    while lo > 0 and at - lo < 2 * most and (text[lo - 1] in _DIGIT or (text[lo - 1] in " -" and lo > 1 and text[lo - 2] in _DIGIT)):
        lo -= 1
    hi = at
    while hi < len(text) and hi - at < 2 * most and (text[hi] in _DIGIT or (text[hi] in " -" and hi + 1 < len(text) and text[hi + 1] in _DIGIT)):
        hi += 1
    return lo, hi, "".join(c for c in text[lo:hi] if c in _DIGIT)


def _card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and digits[0] in "23456" and luhn(digits)


def cards_at(text: str, at: int) -> list[tuple[int, int]]:
    """Card numbers around the digit at ``at``, where a group begins: 13 to 19 digits, known first digit, valid check digit.

    The whole run of groups is tried, and every span of whole groups that begins with this one, since an
    expiry date, a check number or another card may stand next to a card. Groups inside such a span
    have 3 digits at least, and the first 4: columns of small numbers make no card.
    """
    lo, hi, digits = _digits(text, at, 19)
    found = [(lo, hi)] if _card(digits) and _edge(text, lo, hi) else []
    hi, digits = at, ""
    while len(digits) <= 19:
        size = 0
        while size < 20 and hi + size < len(text) and text[hi + size] in _DIGIT:
            size += 1
        digits += text[hi : hi + size]
        hi += size
        if _card(digits) and _edge(text, at, hi):
            found.append((at, hi))
        if size < (3 if len(digits) > size else 4) or not (hi + 1 < len(text) and text[hi] in " -" and text[hi + 1] in _DIGIT):
            break
        hi += 1
    return found


def _printed(value: str) -> bool:
    """Whether a card's groups are as issuers print them."""
    return [len(g) for g in value.replace("-", " ").split()] in ([4, 4, 4, 4], [4, 6, 5], [4, 6, 4], [len(value)])


def _ssn(digits: str) -> bool:
    """Nine digits that aren't among the numbers that are never given out."""
    return not (digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000")


def ssn_at(text: str, at: int, cued: bool = False) -> tuple[int, int] | None:
    """ddd-dd-dddd around a digit, without numbers that are never given out; behind a cue the number begins at ``at``, and its groups may be parted by a space, hyphen or dot or not at all."""
    lo = at
    if cued:
        hi, digits = at, ""
        while hi < len(text) and len(digits) < 9:
            if text[hi] in _DIGIT:
                digits += text[hi]
            elif not (len(digits) in (3, 5) and text[hi] in " -." and text[hi - 1] in _DIGIT):
                return None
            hi += 1
        if len(digits) < 9:
            return None
    else:
        while lo > 0 and at - lo < 11 and (text[lo - 1] in _DIGIT or text[lo - 1] == "-"):
            lo -= 1
        v = text[lo : lo + 11]
        if len(v) < 11 or v[3] != "-" or v[6] != "-" or not (v[:3] + v[4:6] + v[7:]).isdecimal() or not v.isascii():
            return None
        hi, digits = lo + 11, v[:3] + v[4:6] + v[7:]
    return (lo, hi) if _ssn(digits) and _edge(text, lo, hi) and not (hi < len(text) and text[hi] == "-") else None


def phone_at(text: str, at: int) -> tuple[int, int] | None:
    """The number that begins at the plus sign or digit at ``at``: groups parted by one or two of ' -.()'."""
    hi, end, digits, gap = at + (text[at] == "+"), at, 0, 0
    most = 11 if text[at : at + 2] == "+1" else 15
    while hi < len(text) and digits < most and gap <= 2:
        if text[hi] in _DIGIT:
            digits, gap, end = digits + 1, 0, hi + 1
        elif text[hi] in " -.()/":
            gap += 1
        else:
            break
        hi += 1
    least = 8 if text[at] == "+" else 7
    return (at, end) if digits >= least and _edge(text, at, end) else None


def iban_at(text: str, at: int, cued: bool = False) -> tuple[int, int] | None:
    """The IBAN whose two check digits begin at ``at``; behind a cue also in small letters and with hyphens."""
    letters, signs, gaps = (_LETTER, _ALNUM, " -") if cued else (_UPPER, _UPPER | _DIGIT, " ")
    lo = at - 2
    if lo < 0 or text[lo] not in letters or text[lo + 1] not in letters or (lo > 0 and text[lo - 1].isalnum()):
        return None
    hi, chars, best = at + 2, text[lo : at + 2], None
    if cued and not (len(chars) == 4 and chars[2] in _DIGIT and chars[3] in _DIGIT):
        return None
    while hi < len(text) and len(chars) < 34:
        if text[hi] in signs:
            chars += text[hi]
        elif not (text[hi] in gaps and hi + 1 < len(text) and text[hi + 1] in signs):
            break
        hi += 1
        if len(chars) >= 15 and text[hi - 1] in signs and _edge(text, lo, hi):
            if int("".join(str(int(c, 36)) for c in chars[4:] + chars[:4])) % 97 == 1:
                best = (lo, hi)
    return best


def passport_at(text: str, at: int) -> tuple[int, int] | None:
    """The number of 6 to 12 letters and digits that begins at ``at``, up to 3 leading letters parted from it or not.

    It has 2 digits at least; small letters, as words have them, are taken for up to 3 letters beside 4 digits.
    """
    hi = at
    while hi < len(text) and hi - at < 13 and text[hi] in _ALNUM:
        hi += 1
    if 1 <= hi - at <= 3 and text[at:hi].isalpha() and hi + 1 < len(text) and text[hi] in " -" and text[hi + 1] in _DIGIT:
        hi += 1
        while hi < len(text) and hi - at < 14 and text[hi] in _DIGIT:
            hi += 1
    v = text[at:hi].replace(" ", "").replace("-", "")
    digits = sum(c in _DIGIT for c in v)
    fits = 6 <= len(v) <= 12 and (digits >= 2 and v == v.upper() or digits >= 4 and len(v) - digits <= 3)
    return (at, hi) if fits and _edge(text, at, hi) else None


def cue_at(text: str, start: int, end: int, cue: str) -> tuple[str, int, int] | None:
    """The value that a cue announces: after it come up to 14 characters of ' .:#=-' and words such as 'no', then the value."""
    if start > 0 and text[start - 1].isalpha():
        return None
    i = end
    while i < len(text) and i - end < 14:
        j = i
        while j < len(text) and j - i < 14 and text[j] in _LETTER:
            j += 1
        if text[i] in " .:#=-":
            i += 1
        elif text[i:j].lower() in _FILL:
            i = j
        else:
            break
    if i >= len(text):
        return None
    kind, found = "account", None
    if cue in ("tel", "phone", "mobile", "fax"):
        opens = text[i] == "(" and i + 1 < len(text) and text[i + 1] in _DIGIT
        kind, found = "phone", phone_at(text, i) if opens or text[i] == "+" or text[i] in _DIGIT else None
    elif cue == "ssn":
        kind, found = "ssn", ssn_at(text, i, True)
    elif cue == "iban":
        kind, found = "iban", iban_at(text, i + 2, True)
    elif text[i] in _DIGIT:
        lo, hi, digits = _digits(text, i, 18)
        found = (lo, hi) if lo == i and 6 <= len(digits) <= 18 and _edge(text, lo, hi) else None
    if cue == "passport" and not found:
        found = passport_at(text, i)
    return (kind, *found) if found else None


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for one in ("@", "://", "+", ":"):
        a.add_word(one, one)
    for i in range(100):
        a.add_word(f"{i:02d}", "dd")
    for i in range(10):
        a.add_word(f"{i}.", "d.")
    for cue in CUES:
        for form in (cue, cue.upper(), cue.capitalize()):
            a.add_word(form, cue)
    a.make_automaton()
    return a


_built: list = []


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in text order, without overlaps. A null or empty text has none.

    Not looked for are names, postal addresses, dates of birth, and numbers of accounts and telephones
    without a cue, a plus sign or the form that ``local_phone_at`` knows.
    """
    if not text:
        return []
    if not _built:
        _built.append(_automaton())
    out: set[tuple[str, int, int]] = set()

    def add(kind: str, found: tuple[int, int] | None) -> None:
        if found:
            out.add((kind, *found))

    colon = -1  # end of the last address with colons
    solid = -1  # end of the last digit run whose pairs were tried
    for last, what in _built[0].iter(text):
        if what == "@":
            add("email", email_at(text, last))
        elif what == "dd":
            if last <= solid:
                continue
            lo = last - 1
            solid = last
            while solid + 1 < len(text) and text[solid + 1] in _DIGIT:
                solid += 1
            for found in cards_at(text, lo):
                add("card", found)
            add("ssn", ssn_at(text, lo))
            add("iban", iban_at(text, lo))
            add("phone", local_phone_at(text, lo))
        elif what == "d.":
            add("ip", ip_at(text, last - 1))
        elif what == "+":
            add("phone", phone_at(text, last))
        elif what == ":":
            if last > colon and (last + 1 < len(text) and (text[last + 1] in _HEX or text[last + 1] == ":")):
                found = ip6_at(text, last)
                add("ip", found)
                colon = found[1] if found else last
        elif what == "://":
            add("url_login", url_login_at(text, last - 2))
        else:
            found = cue_at(text, last + 1 - len(what), last + 1, what)
            if found:
                out.add(found)
    taken: list[tuple[str, int, int]] = []
    if len(out) < 2:
        return list(out)
    # few findings a text; a long text with many goes through the sorted list with a binary search
    from bisect import bisect_left, insort

    by_start: list[tuple[int, int]] = []
    for kind, s, e in sorted(out, key=lambda x: (KINDS.index(x[0]), x[0] == "card" and not _printed(text[x[1] : x[2]]), x[1] - x[2], x[1])):
        i = bisect_left(by_start, (s, e))
        if (i and by_start[i - 1][1] > s) or (i < len(by_start) and by_start[i][0] < e):
            continue
        insort(by_start, (s, e))
        taken.append((kind, s, e))
    return sorted(taken, key=lambda x: x[1])


def redacted(text: str | None) -> str | None:
    found = find(text)
    if not found:
        return text
    parts, at = [], 0
    for kind, s, e in found:
        parts += [text[at:s], f"<{kind.upper()}>"]
        at = e
    return "".join([*parts, text[at:]])


def findings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind, start, end, value): one row a finding; offsets are in code points, end exclusive.

    Rows repeated in ``docs`` give their findings each time; a null id is kept as null.
    """
    require(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, s, e, t[s:e]) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, s, e in find(t)]
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "kind", "start", "end", "value"])

    return mapped(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, kind string, start long, end long, value string")


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with each finding replaced by its kind in angle brackets; ``length``, where there is such a column, follows."""
    require(docs, text)
    at = docs.columns.index(text)
    measure = docs.columns.index(length) if length in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(batch.columns)
            old = cols[at].to_pylist()
            new = [redacted(t) for t in old]
            if any(a is not b for a, b in zip(old, new)):
                cols[at] = pa.array(new, cols[at].type)
                if measure is not None:
                    sizes = cols[measure].to_pylist()
                    cols[measure] = pa.array([n if a is b else len(b) for n, a, b in zip(sizes, old, new)], cols[measure].type)
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

    return mapped(docs, run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields]))
