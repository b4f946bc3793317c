"""Long texts in windows, so that memory follows the window and not the text."""

from __future__ import annotations

import re
from collections.abc import Iterator

WINDOW_BYTES = 1 << 20


def windows(data: bytes, apart: re.Pattern[bytes], size: int = WINDOW_BYTES) -> Iterator[bytes]:
    """``data`` cut at bytes that ``apart`` matches, the first ones behind every ``size`` bytes.

    No run of other bytes is cut. The matched bytes between windows are left out.
    """
    at = 0
    while len(data) - at > size:
        gap = apart.search(data, at + size)
        if not gap:
            break
        yield data[at : gap.start()]
        at = gap.end()
    yield data[at:]
