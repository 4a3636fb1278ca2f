"""The Arrow backend of detection: the same recognizers, in batches of texts, for when many run at once.

Compiling tens of recognizers into one plan costs the planner more than small inputs cost to scan, and each scans the text again in
interpreted expressions; past a handful this backend is faster. Tests hold both backends to the same findings.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions import checks
from veilframe.functions.spans import FINDINGS
from veilframe.operators.patterns import ANY_CASE, PatternSpec

Finding = tuple[str, int, int, float]
DIGIT_RUNS = regex.compile(r"\d+")
DIGITS_GUARD = re.compile(r"\\(?:d|p\{Nd\})(?:\{(\d+)\})?")


def verhoeff(text: str) -> bool:
    digits = "".join(text.split())
    if not digits.isascii() or not digits.isdigit():
        return False
    rest = 0
    for i, d in enumerate(reversed(digits)):
        rest = int(checks.DIHEDRAL[rest * 10 + int(checks.PERMUTED[i % 8 * 10 + int(d)])])
    return rest == 0


def luhn(text: str) -> bool:
    digits = text.replace(" ", "").replace("-", "")
    if not digits.isascii() or not digits.isdigit():
        return False
    doubled = [sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def download_stamp(text: str) -> bool:
    try:
        return 2000 <= datetime.datetime.strptime(text[-12:], "%Y%m%d%H%M").year <= 2099
    except ValueError:
        return False


CHECKS: dict[Callable, Callable[[str], bool]] = {checks.verhoeff: verhoeff, checks.luhn: luhn, checks.download_stamp: download_stamp}


def overlaps(a: Finding, b: Finding) -> bool:
    return a[1] < b[2] and b[1] < a[2]


def resolve(found: list[Finding]) -> list[Finding]:
    """Unions within a type, then the stronger whole and of the weaker what is outside it."""
    unions: list[Finding] = []
    for x in sorted(set(found), key=lambda f: (f[1], f[2], f[0], f[3])):
        hit = [y for y in unions if y[0] == x[0] and overlaps(x, y)]
        for y in hit:
            unions.remove(y)
        same = [x, *hit]
        unions.append((x[0], min(y[1] for y in same), max(y[2] for y in same), max(y[3] for y in same)))
    placed: list[Finding] = []
    for x in sorted(unions, key=lambda f: (-f[3], f[1] - f[2], f[0], f[1])):
        parts = [x]
        for y in placed:
            parts = [(p[0], s, e, p[3]) for p in parts for s, e in ((p[1], min(p[2], y[1])), (max(p[1], y[2]), p[2])) if e > s]
        placed += parts
    return sorted(placed, key=lambda f: (f[1], f[0], f[2]))


def compiled(specs: tuple[PatternSpec, ...]) -> list[tuple]:
    """Recognizers ready to run: a guard is a length of digits that the text must hold, a text it must hold, or an expression."""
    out = []
    for s in specs:
        flags = regex.MULTILINE | (regex.DOTALL | regex.IGNORECASE if s.flags == ANY_CASE else 0)
        lead = regex.compile(s.lead) if s.lead else None
        words = regex.compile("|".join(map(regex.escape, s.context))) if s.context else None
        accepts = s.accepts or (CHECKS[s.check] if s.check is not None else None)
        pattern = None if s.find else regex.compile(s.pattern, flags)
        digits = DIGITS_GUARD.fullmatch(s.guard or "")
        literal = s.guard if s.guard and not digits and re.escape(s.guard) == s.guard else None
        guard = regex.compile(s.guard, regex.MULTILINE) if s.guard and not digits and not literal else None
        # Without one of its words in the text, what needs them cannot reach a threshold above its score. Words of ASCII letters are the same in a part of a text as in the whole.
        wanted = s.context if pattern and accepts is None and all(w.isascii() and w.isalnum() for w in s.context) else ()
        out.append((s, pattern, int(digits[1] or 1) if digits else 0, literal, guard, wanted, lead, words, accepts))
    return out


def words_before(text: str, place: int, n: int) -> list[str]:
    """The last ``n`` words before a place, the latest first."""
    out: list[str] = []
    while len(out) < n and place > 0:
        while place > 0 and text[place - 1].isspace():
            place -= 1
        end = place
        while place > 0 and not text[place - 1].isspace():
            place -= 1
        if end > place:
            out.append(text[place:end])
    return out


def findings_of(text: str, label: str | None, specs: list[tuple], threshold: float, boosted: Callable[[float], float], near_words: int) -> list[Finding]:
    """All findings at or above the threshold, unresolved."""
    found: list[Finding] = []
    longest = max(map(len, DIGIT_RUNS.findall(text)), default=0)
    lowered = f"{label or ''} {text}".lower()
    near: dict[int, str] = {}
    for spec, pattern, digits, literal, guard, wanted, lead, context, accepts in specs:
        if longest < digits or literal is not None and literal not in text:
            continue
        if wanted and spec.score < threshold and not any(w in lowered for w in wanted):
            continue
        if guard is not None and not guard.search(text):
            continue
        for start, end, score in spec.find(text) if spec.find else ((*m.span(), spec.score) for m in pattern.finditer(text)):
            if lead is not None and (skip := lead.match(text, start, end)):
                start = skip.end()
            if end <= start:
                continue
            if accepts is not None:
                score = 1.0 if accepts(text[start:end]) else 0.0
            elif context is not None:
                if start not in near:
                    near[start] = " ".join([label or "", *reversed(words_before(text, start, near_words))])
                if context.search(f"{near[start]} {text[start:end]}".lower()):
                    score = boosted(score)
            if score >= threshold:
                found.append((spec.reported_as or spec.entity_type, start, end, score))
    return found


def findings_column(text: Column, label: Column | None, specs: tuple[PatternSpec, ...], threshold: float, boosted, near_words: int, resolved: bool) -> Column:
    """The findings of a text column, computed in Arrow batches."""

    @F.pandas_udf(FINDINGS)
    def run(texts: pd.Series, labels: pd.Series) -> pd.Series:
        ready = compiled(specs)

        def one(text: str, label: str | None) -> list[dict]:
            found = findings_of(text, label, ready, threshold, boosted, near_words) if text else []
            found = resolve(found) if resolved else sorted(set(found), key=lambda f: (f[1], f[0], f[2]))
            return [{"entity_type": t, "s": s, "e": e, "score": score} for t, s, e, score in found]

        return pd.Series([one(t, x) for t, x in zip(texts, labels)])

    # An explode of findings has the planner infer a filter on them, which it would push below any shuffle with a second copy of this
    # function; it leaves one that counts as not deterministic where it is, and runs it once.
    return run.asNondeterministic()(text, label if label is not None else F.lit(None).cast("string"))
