"""Separator and quote of CSV text, from the field counts of all its lines."""

from __future__ import annotations

import csv
from collections import Counter
from dataclasses import dataclass

# The delimiters and quotes that are tried, in order of preference
DELIMITERS = (",", "|", ";", "\t")
QUOTES = ('"', "'")


@dataclass(frozen=True)
class Dialect:
    sep: str = ","
    quote: str = '"'
    multiline: bool = False


def records_of(lines: list[str], sep: str, quote: str) -> list[list[str]]:
    return [r for r in csv.reader([l + "\n" for l in lines], delimiter=sep, quotechar=quote) if r]


def choose(widths: dict[tuple[str, str], Counter], header: str) -> Dialect:
    """The dialect under which most lines have as many fields as the header, and more than one.

    `widths` counts, for each (quote, separator), the lines by their number of fields. Of separators that fit
    equally many lines the one with more fields counts, and `"` before `'`.
    """
    best, best_score = Dialect(), None
    for quote in QUOTES:
        for sep in DELIMITERS:
            own = widths.get((quote, sep))
            if not own:
                continue
            first = records_of([header], sep, quote)
            width = len(first[0]) if first else 1
            if width < 2:
                # no field is parted in the header: the commonest number of fields speaks, but weakly
                width, rows = max(own.items(), key=lambda item: (item[1], item[0]))
                score = (0, rows, width)
            else:
                score = (1, own[width], width)
            if width >= 2 and (best_score is None or score > best_score):
                best, best_score = Dialect(sep, quote), score
    return best


def sniff(lines: list[str]) -> Dialect:
    """The dialect under which a few lines at hand split most evenly into most fields."""
    lines = [l for l in lines if l.strip()]
    best, best_score = Dialect(), None
    for quote in QUOTES:
        if quote == "'" and not _wraps_fields(lines, quote):
            continue
        for sep in DELIMITERS:
            records = records_of(lines, sep, quote)
            width, rows = Counter(map(len, records)).most_common(1)[0] if records else (1, 0)
            if width < 2:
                continue
            score = (rows / len(records), width)
            if best_score is None or score > best_score:
                best_score = score
                best = Dialect(sep, quote, multiline=len(records) < len(lines))
    return best


def _wraps_fields(lines: list[str], quote: str) -> bool:
    """True where the quote opens and closes fields and no double quote is used."""
    return not any('"' in l for l in lines) and any(
        l.startswith(quote) or l.rstrip().endswith(quote) for l in lines
    )


def column_names(header: list[str]) -> list[str]:
    """Header texts as unique column names.

    A blank becomes `column<position>`; a name that was seen before, in whatever
    case, gets `_1`, `_2`, ... added.
    """
    taken: set[str] = set()
    names = []
    for position, text in enumerate(header):
        base = text.strip() or f"column{position}"
        name, n = base, 0
        while name.lower() in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name.lower())
        names.append(name)
    return names


def header_of(lines: list[str], dialect: Dialect) -> list[str]:
    records = records_of(lines, dialect.sep, dialect.quote)
    return column_names(records[0] if records else [])
