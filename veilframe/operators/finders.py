"""Recognizers that read a text instead of matching one pattern: mobile numbers, names after titles, postal addresses.

Each takes a text and gives (start, end, score) of what it finds. They work on words and digit groups of a line, so what they cost is
proportional to the text, and each rule stands by itself. Registered like patterns, they run in the Arrow backend.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import pairwise

Found = tuple[int, int, float]
Finder = Callable[[str], list[Found]]

DIGITS = re.compile(r"[0-9]+")
BLANKS = " \t"

# Titles, words that end a name, words around postal addresses, and scores.
TITLES = frozenset("mr mrs miss shri sri smt kum kumari".split())
DOTTED_TITLES = frozenset(["dr", "ms"])  # DR is also debit, MS is also a company: only with a period
ENDS_NAME = frozenset("account savings current bank branch customer address date number no pan mobile phone email id dob and the of for to from on at in is was has with by dear sir madam".split())
NAME_SCORE, MOBILE_SCORE, ADDRESS_SCORE, PLACE_SCORE = 0.85, 0.6, 0.6, 0.5
NOT_POSTAL = frozenset("email e-mail mail ip mac web website url wallet memory server ethernet network bitcoin crypto contract hardware broadcast gateway host return".split())
NOT_A_PLACE = frozenset("neft imps rtgs upi atm pos chq cheque ref txn inv invoice order id no emi otp".split())
LEADS_IN = frozenset(
    "i we you he she they it me us him her them my our your his their its this that the a an is was are am were be been has have had will would can could should must "
    "to at in on from for of via into and or but so then now also please kindly send sent ship shipped deliver delivered courier couriered mail mailed come visit reach "
    "stay stays stayed staying live lives lived living reside resides resided residing located situated moved shifted "
    "current present permanent residential postal mailing delivery shipping billing correspondence communication registered office home".split()
)
ABBREVIATIONS = frozenset("dist bldg blvd sect apts extn taluk tehsil".split())
LABEL_WORDS = frozenset(["address", "addresses"])
MOST_WORDS, MOST_SEGMENTS, MOST_PLACE, MOST_REGION, MOST_LINES, LONGEST_LINE, LEAST_VALUE, LABEL_REACH = 6, 6, 4, 3, 5, 80, 10, 80


def _at(text: str, k: int) -> str:
    return text[k] if 0 <= k < len(text) else ""


def _wordlike(c: str) -> bool:
    return c == "_" or c.isalnum()


def _past(text: str, k: int, chars: str = BLANKS) -> int:
    """The first place from k whose character is not one of chars."""
    while k < len(text) and text[k] in chars:
        k += 1
    return k


# Mobile numbers


def mobiles(text: str) -> list[Found]:
    """Ten digits that start with 6 to 9, in one group or two of five, with +91, 91 or 0 in front; not part of a word, a reference or an amount."""
    groups = [m.span() for m in DIGITS.finditer(text)]
    out: list[Found] = []

    def joined(a: int, b: int) -> bool:
        return b - a == 1 and text[a] in " -" or a == b

    def accept(s: int, e: int) -> bool:
        if out and s < out[-1][1]:
            return False
        before, after = _at(text, s - 1), _at(text, e)
        if _wordlike(before) or before in ("+", "/") and before or _wordlike(after):
            return False
        if before in (".", ",") and _at(text, s - 2).isdigit() or after == "." and _at(text, e + 1).isdigit():
            return False
        out.append((s, e, MOBILE_SCORE))
        return True

    for k, (s, e) in enumerate(groups):
        # The number ends with this group: whole, or its second half.
        for first in (k, k - 1):
            if first < 0 or first < k and not (e - s == 5 and joined(groups[first][1], s)):
                continue
            start, stop = groups[first]
            own = text[start:stop] + (text[s:e] if first < k else "")
            rest = own[-10:]
            if len(own) < 10 or rest[0] not in "6789" or first < k and stop - start < 5:
                continue
            prefix = own[:-10]
            if prefix not in ("", "0", "91"):
                continue
            options = [start]
            if prefix == "91" and _at(text, start - 1) == "+":
                options = [start - 1]
            elif not prefix and first > 0:
                # A country code in a group of its own.
                a, b = groups[first - 1]
                if text[a:b] == "91" and joined(b, start) and b < start:
                    options = [a - 1 if _at(text, a - 1) == "+" else a, start]
            if any(accept(o, e) for o in options):
                break
    return out


# Names after titles


def _word_end(text: str, k: int) -> int:
    """End of a name word at k: a capital and letters, dashes or apostrophes, not a word that ends names; k if there is none."""
    if not ("A" <= _at(text, k) <= "Z"):
        return k
    e = k + 1
    while e < len(text) and (text[e].isascii() and text[e].isalpha() or text[e] in "'-"):
        e += 1
    head = re.split(r"['\-]", text[k:e], maxsplit=1)[0].lower()
    return k if e - k < 2 or head in ENDS_NAME else e


def _initial_end(text: str, k: int) -> int:
    """End of an initial at k, a capital by itself with or without a period; k if there is none."""
    if not ("A" <= _at(text, k) <= "Z"):
        return k
    after = _at(text, k + 1)
    return k + 2 if after == "." else k if _wordlike(after) or after in ("'", "-", "/") and after else k + 1


def titled_names(text: str) -> list[Found]:
    """What stands behind a title: up to three initials, a word, up to two more with or without an initial between, a last initial."""
    out: list[Found] = []
    for m in re.finditer(r"[A-Za-z]+", text):
        title, k = m[0].lower(), m.end()
        if _wordlike(_at(text, m.start() - 1)) or out and m.start() < out[-1][1]:
            continue
        dotted = _at(text, k) == "."
        if not (title in TITLES or title in DOTTED_TITLES and dotted):
            continue
        start = _past(text, k + dotted)
        if start == k + dotted:
            continue
        k = start
        for _ in range(3):
            e = _initial_end(text, k)
            if e == k:
                break
            k = _past(text, e)
        end = _word_end(text, k)
        if end == k:
            continue
        for _ in range(2):
            k = _past(text, end)
            middle = _past(text, _initial_end(text, k))
            e = _word_end(text, k)
            if e == k and middle > k:
                e = _word_end(text, middle)
                e = k if e == middle else e
            if k == end or e == k:
                break
            end = e
        k = _past(text, end)
        last = _initial_end(text, k)
        if k > end and last > k and not _wordlike(_at(text, last)):
            end = last
        out.append((start, end, NAME_SCORE))
    return out


# Postal addresses


def _pins(text: str) -> Iterator[tuple[int, int]]:
    """Six digits that do not start with 0, in one group or two of three, that are no part of a longer number or an amount."""
    groups = [m.span() for m in DIGITS.finditer(text)]
    for k, (s, e) in enumerate(groups):
        if e - s == 3 and k + 1 < len(groups) and groups[k + 1][0] == e + 1 and text[e] in BLANKS and groups[k + 1][1] - groups[k + 1][0] == 3:
            e = groups[k + 1][1]
        elif e - s != 6:
            continue
        amount = _at(text, s - 1) in (".", ",") and _at(text, s - 2).isdigit() or _at(text, e) == "," and _at(text, e + 1).isdigit()
        if text[s] != "0" and not amount:
            yield s, e


def _part(c: str) -> bool:
    """Whether a character can stand in a word of an address."""
    return _wordlike(c) or bool(c) and c in "#/.'&()-"


def _words_before(text: str, end: int) -> list[tuple[int, int]]:
    """The words that end at or before a place, nothing but blanks between them, nearest first; up to one more than a segment holds."""
    out: list[tuple[int, int]] = []
    while len(out) <= MOST_WORDS:
        e = end
        while e > 0 and text[e - 1] in BLANKS:
            e -= 1
        s = e
        while s > 0 and _part(text[s - 1]):
            s -= 1
        if s == e or out and e == end:
            break
        out.append((s, e))
        end = s
    return out


def _after_lead_in(text: str, start: int, end: int) -> int:
    """Start of an address without the words that lead into it and without its label."""
    while True:
        m = re.compile(r"([A-Za-z]+)(?:[ \t]*-)?[ \t]+").match(text, start, end)
        word = m[1].lower() if m else ""
        if not m or not (word in LEADS_IN or word in LABEL_WORDS and not _email_like(text, start)):
            return start
        start = m.end()


def _with_segments(text: str, pin: int) -> int | None:
    """Start of an address that ends in a PIN at ``pin``: a place of up to four words behind segments that commas end; None if it has none."""
    e = pin
    while e > 0 and text[e - 1] in BLANKS:
        e -= 1
    if e and text[e - 1] in "-,":
        e -= 1
    place = _words_before(text, e)
    if not 0 < len(place) <= MOST_PLACE or not ("A" <= text[place[-1][0]] <= "Z"):
        return None
    start, segments = place[-1][0], 0
    while segments < MOST_SEGMENTS:
        comma = start - 1
        while comma >= 0 and text[comma] in BLANKS:
            comma -= 1
        words = _words_before(text, comma) if _at(text, comma) == "," and comma >= 0 else []
        if not words:
            break
        start, segments = words[: MOST_WORDS][-1][0], segments + 1
        if len(words) > MOST_WORDS:
            break
    return start if segments else None


def _region(text: str, end: int) -> int:
    """End of an address with a state or country of up to three capitalised words behind a comma."""
    k = _past(text, end)
    if _at(text, k) != ",":
        return end
    k, last = _past(text, k + 1), end
    for _ in range(MOST_REGION):
        m = re.compile(r"[A-Z][A-Za-z]+").match(text, k)
        if not m:
            break
        last, k = m.end(), _past(text, m.end())
        if k == last:
            break
    return last


def _place_and_dash(text: str, pin: int) -> int | None:
    """Start of up to three words of letters before a dash and a PIN, where they are no prefix of a payment."""
    e = pin
    while e > 0 and text[e - 1] in BLANKS:
        e -= 1
    if _at(text, e - 1) != "-" or e < 1:
        return None
    words = [w for w in _words_before(text, e - 1)]
    good = []
    for s, w in words[:3]:
        if not re.fullmatch(r"[A-Za-z]{3,}", text[s:w]):
            break
        good.append(s)
    while good and re.match(r"[A-Za-z]+", text[good[-1] :])[0].lower() in NOT_A_PLACE:
        good.pop()
    return good[-1] if good else None


def _keyword_before(text: str, pin: int) -> bool:
    """Whether 'pin' or 'pincode' stands before a number, with 'is', 'no' or 'number' and a mark between or without."""
    words = re.findall(r"[A-Za-z]+|[^\sA-Za-z]", text[max(0, pin - 40) : pin])
    if words and words[-1] in (":", ".", "-"):
        mark = words.pop()
        if mark == "." and words and words[-1].lower() == "no":
            words.pop()
    if words and words[-1].lower() in ("is", "no", "number"):
        words.pop()
    if words and words[-1].lower() == "code":
        words.pop()
        return bool(words) and words[-1].lower() == "pin"
    return bool(words) and words[-1].lower() in ("pin", "pincode")


def pin_addresses(text: str) -> list[Found]:
    """Addresses that end in a PIN: segments and a place, a place and a dash, or the number alone behind its keyword."""
    out: list[Found] = []
    taken = 0
    for s, e in _pins(text):
        line = text.rfind("\n", 0, s) + 1
        start, score, end = _with_segments(text, s), ADDRESS_SCORE, e
        if start is not None:
            end = _region(text, e)
        else:
            start, score = _place_and_dash(text, s), PLACE_SCORE
        if start is not None:
            start = max(start, line, taken)
            while start < s and not _part(text[start]):
                start += 1
            out.append((_after_lead_in(text, start, end), end, score))
            taken = end
        if _keyword_before(text, s):
            out.append((s, e, PLACE_SCORE))
    return out


def _email_like(text: str, label: int) -> bool:
    """Whether the label at a place is that of another kind of address: e-mail, IP, web."""
    end = label - 1 if _at(text, label - 1) in (" ", "\t", "_", "-") and label else label
    s = end
    while s > 0 and (text[s - 1].isalpha() or text[s - 1] == "-" and s < end):
        s -= 1
    word = text[s:end].lower().strip("-")
    return word in NOT_POSTAL or any(word.endswith(f"-{x}") for x in NOT_POSTAL)


def _labels(text: str) -> Iterator[tuple[int, int]]:
    for m in re.finditer(r"(?i)addresses|address", text):
        before, after = _at(text, m.start() - 1), _at(text, m.end())
        if _wordlike(after) or after in ("@", "-") and after and _wordlike(_at(text, m.end() + 1)):
            continue
        if _wordlike(before) or before in ("@", ".", "-") and before or _email_like(text, m.start()):
            continue
        yield m.span()


def _value_start(text: str, label: int) -> tuple[int, bool] | None:
    """Where the value begins behind a label that ends at a place, and whether a pipe stands between; None without a separator."""
    k = _past(text, label)
    c = _at(text, k)
    if c in (":", "–", "—", "|") and c:
        return _past(text, k + 1), c == "|"
    if c == "-":
        after = _past(text, k + 1)
        return (after, False) if k > label or after > k + 1 else None
    m = re.compile(r"[A-Za-z]+").match(text, k)
    word = m[0].lower() if m and k > label else ""
    if word in ("is", "was"):
        k = _past(text, m.end())
        at = re.compile(r"at\b[ \t]+", re.I).match(text, k)
        return (at.end() if at else k, False) if k > m.end() else None
    if word == "of":
        # 'of' somebody, up to a mark or a verb on the same line.
        for k in range(m.end() + 1, min(len(text), m.end() + 43)):
            if text[k] in ":–—|":
                return _past(text, k + 1), text[k] == "|"
            if text[k] == "\n":
                break
            verb = re.compile(r"[ \t](?:is|was)[ \t]+", re.I).match(text, k)
            if verb and k > m.end() + 1:
                return verb.end(), False
    return None


def _holds(c: str) -> bool:
    return _part(c) or c in BLANKS + ","


def _run_end(text: str, k: int, most: int | None = None) -> int:
    stop = len(text) if most is None else min(len(text), k + most)
    while k < stop and _holds(text[k]):
        k += 1
    return k


def _trimmed(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """A value up to the end of its sentence, without marks at its end; none if it does not look like an address."""
    for (s, e), (after, _) in pairwise([m.span() for m in re.finditer(r"\S+", text[start:end])]):
        word = text[start + s : start + e]
        body = word.rstrip(".").rpartition("/")[2]
        tail = re.search(r"[A-Za-z]*\Z", body)[0]
        starts = re.match(r"[A-Z][a-z]", text[start + after : start + after + 2])
        if word.endswith(".") and len(tail) > 3 and tail.lower() not in ABBREVIATIONS and starts:
            end = start + e - 1
            break
    while end > start and text[end - 1] in " \t,./-(&'\r\n":
        end -= 1
    value = text[start:end]
    return [(start, end)] if len(value) >= LEAST_VALUE and any(c.isdigit() or c == "," for c in value) else []


def _inline(text: str, start: int) -> list[tuple[int, int]]:
    """The value on the label's line; it goes on behind a comma at the end of a line."""
    if not (_wordlike(_at(text, start)) or _at(text, start) == "#"):
        return []
    end = _run_end(text, start)
    while text[start:end].rstrip(BLANKS).endswith(","):
        k = end + 1 if _at(text, end) == "\n" else end + 2 if text[end : end + 2] == "\r\n" else end
        k = _past(text, k)
        if k <= end or k >= len(text) or not (_wordlike(text[k]) or text[k] == "#"):
            break
        end = _run_end(text, k)
    return _trimmed(text, start, end)


def _below(text: str, k: int) -> list[tuple[int, int]]:
    """The value on up to five short lines below a label that has a line to itself."""
    start = end = None
    for _ in range(MOST_LINES):
        stop = text.find("\n", k)
        stop = len(text) if stop < 0 else stop
        s = _past(text, k, BLANKS + ">*-")
        e = s + len(text[s:stop].rstrip())
        if s >= e or e - s > LONGEST_LINE or not (_wordlike(text[s]) or text[s] == "#") or _run_end(text, s, e - s) < e:
            break
        start, end, k = s if start is None else start, e, stop + 1
    return [] if start is None else _trimmed(text, start, end)


def labelled_addresses(text: str) -> list[Found]:
    """Values behind 'address' as a label, on its line or below it."""
    out: set[tuple[int, int]] = set()
    for s, e in _labels(text):
        line = text.rfind("\n", 0, s) + 1
        ahead = re.fullmatch(r"[ \t#*>\-]*((?:[A-Za-z]+[ \t]+){0,2})", text[line:s])
        stop = _past(text, e)
        stop = _past(text, stop + 1) if _at(text, stop) == ":" else stop
        if ahead and (_at(text, stop) == "\n" or text[stop : stop + 2] == "\r\n"):
            out.update(_below(text, text.index("\n", stop) + 1))
            continue
        value = _value_start(text, e)
        if value is None:
            continue
        out.update(_inline(text, value[0]))
        # A label and its value in blocks of their own may have another block between them.
        after = text.find("|", value[0], value[0] + LABEL_REACH) if value[1] else -1
        if after >= 0:
            out.update(_inline(text, _past(text, after + 1)))
    return [(s, e, ADDRESS_SCORE) for s, e in sorted(out)]
