"""Similarity of two short texts, 0 to 100: the weighted ratio of the fuzzy-matching libraries.

Built from the published definition: the insert/delete ratio 200 * LCS / (len a + len b)
on whole texts, sorted tokens and token sets, and on the best-matching part of the longer
text when the lengths differ by 1.5 times or more.
"""

from __future__ import annotations

import re

# Fixed values of the published weighted ratio.
TOKEN_WEIGHT = 0.95
PARTIAL_FROM = 1.5
PARTIAL_WEIGHT = 0.9
LONG_FROM = 8.0
LONG_WEIGHT = 0.6


def comparable(value: str) -> str:
    """Lower case, everything but letters, digits and ``_`` blanked, trimmed."""
    return re.sub(r"\W", " ", value).strip().lower()


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one machine-word style bit row."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * common_length(a, b) / total


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with any stretch of the longer one of at most its length."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    m, n = len(a), len(b)
    letters = set(a)
    best = 0.0
    starts = [(0, e) for e in range(1, m)] + [(s, min(s + m, n)) for s in range(n)]
    for start, end in starts:
        part = b[start:end]
        # a stretch can only beat the best one if its rim letter occurs in the shorter text
        if (start == 0 and part[-1] not in letters) or (start > 0 and part[0] not in letters and end == n):
            continue
        best = max(best, ratio(a, part))
        if best == 100.0:
            break
    if m == n and best < 100.0:
        for start, end in starts:
            best = max(best, ratio(b, a[start:end]))
    return best


def _token_parts(a: str, b: str) -> tuple[list[str], list[str], list[str]]:
    left, right = set(a.split()), set(b.split())
    return sorted(left & right), sorted(left - right), sorted(right - left)


def token_ratio(a: str, b: str) -> float:
    """The better of sorted-token and token-set ratio."""
    best = ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    shared, only_a, only_b = _token_parts(a, b)
    if shared and (not only_a or not only_b):
        return 100.0
    rest_a, rest_b, base = " ".join(only_a), " ".join(only_b), len(" ".join(shared))
    gap = 1 if base else 0
    len_a, len_b = base + gap + len(rest_a), base + gap + len(rest_b)
    # shared tokens match in full, so only the rests differ
    apart = len(rest_a) + len(rest_b) - 2 * common_length(rest_a, rest_b)
    best = max(best, 100.0 - 100.0 * apart / (len_a + len_b) if len_a + len_b else 100.0)
    if base:
        for rest, length in ((rest_a, len_a), (rest_b, len_b)):
            best = max(best, 100.0 - 100.0 * (gap + len(rest)) / (base + length))
    return best


def partial_token_ratio(a: str, b: str) -> float:
    shared, only_a, only_b = _token_parts(a, b)
    if shared:
        return 100.0
    tokens_a, tokens_b = sorted(a.split()), sorted(b.split())
    best = partial_ratio(" ".join(tokens_a), " ".join(tokens_b))
    if len(only_a) == len(tokens_a) and len(only_b) == len(tokens_b):
        return best
    return max(best, partial_ratio(" ".join(only_a), " ".join(only_b)))


def weighted_ratio(a: str, b: str) -> float:
    """``a`` and ``b`` must already be ``comparable``."""
    if not a or not b:
        return 0.0
    best = ratio(a, b)
    longer = max(len(a), len(b)) / min(len(a), len(b))
    if longer < PARTIAL_FROM:
        return max(best, TOKEN_WEIGHT * token_ratio(a, b))
    weight = PARTIAL_WEIGHT if longer <= LONG_FROM else LONG_WEIGHT
    best = max(best, weight * partial_ratio(a, b))
    return max(best, TOKEN_WEIGHT * weight * partial_token_ratio(a, b))
