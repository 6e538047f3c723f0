"""Spans packed into overlapping runs."""

from __future__ import annotations

from collections.abc import Iterator


def pack(spans: list[tuple[int, int]], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of spans no longer than `size` (one span at least), each beginning up to `overlap` characters back.

    The last span of a run begins the next one even if it is longer than the overlap, unless the run is it alone.
    """
    i, n = 0, len(spans)
    while i < n:
        j = next((k for k in range(i + 1, n) if spans[k][1] - spans[i][0] > size), n)
        yield i, j
        if j == n:
            return
        k, back = j - 1, spans[j - 1][1] - spans[j - 1][0]
        while k > i and back < overlap and back + spans[k - 1][1] - spans[k - 1][0] <= overlap:
            k -= 1
            back += spans[k][1] - spans[k][0]
        i = max(i + 1, k)
