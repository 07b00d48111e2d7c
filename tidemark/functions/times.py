"""Phrases that tell a time, read by a small grammar over tokens.

A text is cut into numbers, words and single signs.  At each token that can begin a phrase the
productions below are tried, each of which returns where it ends, and the longest phrase wins.
A phrase touches no letter or digit on either side.

    date      2024-03-11 [T 10:20:30 Z] | 3/11/24 | 11.3.2024 | 20240311 | March 11[,] 2024 | 11 of March 2024
    period    Q1 [FY] ['24] | 1Q24 | H1 2024 | first [fiscal] half [of 2024] | fiscal [year] [ended] 2024 | FY24
    relative  last [fiscal] year | year over year | year to date | two quarters ago | today
    clock     10:20 [p.m.]
    year      2024, unless what stands before or after says that it is an amount
    month     March
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

#: Names of months and their short forms.
MONTHS = "january february march april may june july august september october november december".split()
SHORT = "jan feb mar apr jun jul aug sep sept oct nov dec".split()
#: Words of periods and relations.
UNITS = frozenset("year quarter month".split())
MORE_UNITS = UNITS | frozenset("week day period".split())
ORDINALS = frozenset("first second third fourth".split())
RELATIONS = frozenset("last next prior previous preceding following coming current this past same comparable corresponding trailing".split())
COUNTS = frozenset("a one two three four five six seven eight nine ten eleven twelve".split())
DAYS = frozenset("today yesterday tomorrow".split())
LEDGER_YEARS = frozenset("fiscal financial calendar".split())
#: Words after a number, and signs before it, that say it is no year.
NOT_YEARS = frozenset("acres act barrels basis bps customers employees feet holders hours locations megawatts members miles patients restricted share shares sq square stores subscribers tons unit units votes".split())
NOT_BEFORE_YEARS = ".,$€£¥#"

TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\s]")
#: Of two phrases of one length the earlier kind wins.
KINDS = ("DATE", "PERIOD", "RELATIVE", "TIME", "YEAR", "MONTH")


class Reader:
    """Productions take the number of a token and return the number after the phrase, or None."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.spans = [m.span() for m in TOKEN.finditer(text)]
        self.words = [text[a:b] for a, b in self.spans]
        self.lower = [w.lower() for w in self.words]

    def phrases(self) -> Iterator[tuple[int, int, str]]:
        for i, w in enumerate(self.lower):
            if not (w[0].isdigit() or w in STARTS):
                continue
            a = self.spans[i][0]
            if a and self.text[a - 1].isalnum():
                continue
            found = []
            for kind, productions in GRAMMAR:
                for production in productions:
                    j = production(self, i)
                    if j is not None and self.free(j):
                        found.append((-self.spans[j - 1][1], kind))
            if found:
                end, kind = min(found, key=lambda x: (x[0], KINDS.index(x[1])))
                yield a, -end, kind

    def free(self, j: int) -> bool:
        end = self.spans[j - 1][1]
        return end == len(self.text) or not self.text[end].isalnum()

    def is_(self, i: int, *words: str) -> bool:
        return i < len(self.lower) and self.lower[i] in words

    def among(self, i: int, words: frozenset[str]) -> bool:
        """The word, or its plural."""
        return i < len(self.lower) and (self.lower[i] in words or self.lower[i].endswith("s") and self.lower[i][:-1] in words)

    def glued(self, i: int) -> bool:
        """No space before token i."""
        return 0 < i < len(self.spans) and self.spans[i - 1][1] == self.spans[i][0]

    def number(self, i: int, low: int, high: int) -> bool:
        """A number of `low` to `high` digits."""
        return i < len(self.words) and self.words[i].isascii() and self.words[i].isdigit() and low <= len(self.words[i]) <= high

    def sign(self, i: int, signs: str) -> bool:
        return i < len(self.words) and self.words[i] in signs and self.glued(i) and self.glued(i + 1)

    def year(self, i: int) -> int | None:
        """['] and two or four digits, or three as some write."""
        i += self.is_(i, "'", "’")
        return i + 1 if self.number(i, 2, 4) else None

    # date

    def written(self, i: int) -> int | None:
        """Three numbers with one sign between them, year first or last."""
        if not (self.number(i, 1, 4) and self.sign(i + 1, "-/.") and self.is_(i + 3, self.words[i + 1]) and self.sign(i + 3, "-/.") and self.number(i + 4, 1, 4)):
            return None
        sign, sizes = self.words[i + 1], [len(self.words[i + k]) for k in (0, 2, 4)]
        if not self.number(i + 2, 1, 2):
            return None
        if sizes[0] == 4 and sizes[2] <= 2 and sign != ".":
            j = i + 5
            after = j + 1 if self.is_(j, "t") and self.glued(j) else j
            clock = self.clock(after) if self.number(after, 2, 2) else None
            return self.zone(clock) if clock and (after > j or not self.glued(after)) else j
        if sizes[0] > 2 or sizes[2] < 2 or sign != "." and sizes[2] > 4:
            return None
        if sign == "." and not (sizes[2] == 4 and 1 <= int(self.words[i]) <= 31 and 1 <= int(self.words[i + 2]) <= 12):
            return None
        return i + 5

    def zone(self, i: int) -> int:
        if self.is_(i, ".") and self.glued(i) and self.number(i + 1, 1, 9):
            i += 2
        if self.is_(i, "z") and self.glued(i):
            return i + 1
        if i < len(self.words) and self.words[i] in "+-" and self.glued(i):
            if self.number(i + 1, 4, 4):
                return i + 2
            if self.number(i + 1, 2, 2) and self.sign(i + 2, ":") and self.number(i + 3, 2, 2):
                return i + 4
        return i

    def compact(self, i: int) -> int | None:
        """Eight digits that are a date, or fourteen that are one with a time."""
        for form, size in (("%Y%m%d", 8), ("%Y%m%d%H%M%S", 14)):
            if self.number(i, size, size) and self.words[i][:2] in ("19", "20"):
                try:
                    dt.datetime.strptime(self.words[i], form)
                except ValueError:
                    return None
                return i + 1
        return None

    def month(self, i: int) -> int | None:
        if not self.is_(i, *MONTHS, *SHORT):
            return None
        return i + 2 if self.is_(i + 1, ".") and self.glued(i + 1) else i + 1

    def day(self, i: int) -> int | None:
        if not self.number(i, 1, 2):
            return None
        return i + 2 if self.is_(i + 1, "st", "nd", "rd", "th") and self.glued(i + 1) else i + 1

    def after_comma(self, i: int) -> int | None:
        i += self.is_(i, ",")
        return i + 1 if self.number(i, 4, 4) else None

    def month_first(self, i: int) -> int | None:
        j = self.month(i)
        if j is None or self.glued(j) and self.number(j, 1, 4):
            return None
        if self.number(j, 4, 4):
            return j + 1
        k = self.day(j)
        return k and (self.after_comma(k) if self.after_comma(k) and self.free(self.after_comma(k)) else k)

    def day_first(self, i: int) -> int | None:
        j = self.day(i)
        if j is None or (j := self.month(j + self.is_(j, "of"))) is None:
            return None
        return self.after_comma(j)

    # period

    def marked(self, i: int) -> int | None:
        """[FY | CY] and a year."""
        return self.year(i + self.is_(i, "fy", "cy"))

    def quarter(self, i: int) -> int | None:
        """Q1, with a year or without; a year alone must follow 1Q, H1 and 1H."""
        letter, figure = (i, i + 1) if self.is_(i, "q", "h") else (i + 1, i)
        if not (self.is_(letter, "q", "h") and self.number(figure, 1, 1) and self.glued(i + 1)):
            return None
        q = self.is_(letter, "q")
        if self.words[figure] not in ("1234" if q else "12"):
            return None
        full = self.marked(i + 2)
        return full if full and self.free(full) else i + 2 if q and letter == i else None

    def ordinal(self, i: int) -> int | None:
        if not self.is_(i, *ORDINALS):
            return None
        i += 1
        i += self.is_(i, "fiscal")
        if not self.is_(i, "quarter", "half"):
            return None
        i += 1
        if self.is_(i, "of"):
            j = i + 1 + self.is_(i + 1, "fiscal")
            j += self.is_(j, "year")
            if (self.number(j, 2, 2) or self.number(j, 4, 4)) and self.free(j + 1):
                return j + 1
        return i

    def ledger_year(self, i: int) -> int | None:
        if self.is_(i, "fy", "cy"):
            return self.year(i + 1)
        if not self.is_(i, *LEDGER_YEARS):
            return None
        i += 1
        i += self.is_(i, "year")
        i += self.is_(i, "ended", "ending")
        return i + 1 if self.number(i, 2, 2) or self.number(i, 4, 4) else None

    # relative

    def related(self, i: int) -> int | None:
        if not self.is_(i, *RELATIONS):
            return None
        i += 1
        i += self.is_(i, "-")
        if self.is_(i, "fiscal"):
            i += 1
        elif self.is_(i, "twelve", "12") and self.among(i + 1, UNITS):
            i += 1
        return i + 1 if self.among(i, MORE_UNITS) else None

    def compared(self, i: int) -> int | None:
        """A unit over or on a unit, or a unit to date, with spaces or dashes."""
        if not self.is_(i, *UNITS):
            return None
        i += 1
        i += self.is_(i, "-")
        if self.is_(i, "over", "on"):
            i += 1
            i += self.is_(i, "-")
            return i + 1 if self.is_(i, *UNITS) else None
        if self.is_(i, "to"):
            i += 1
            i += self.is_(i, "-")
            return i + 1 if self.is_(i, "date") else None
        return None

    def ago(self, i: int) -> int | None:
        i += self.is_(i, *COUNTS) or self.number(i, 1, 2)
        return i + 2 if self.among(i, UNITS) and self.is_(i + 1, "ago") else None

    def named_day(self, i: int) -> int | None:
        return i + 1 if self.is_(i, *DAYS) else None

    # clock, year, month

    def clock(self, i: int) -> int | None:
        if not (self.number(i, 1, 2) and int(self.words[i]) < 24 and self.sign(i + 1, ":") and self.number(i + 2, 2, 2) and int(self.words[i + 2]) < 60):
            return None
        i += 3
        if self.is_(i, ":") and self.sign(i, ":") and self.number(i + 1, 2, 2) and int(self.words[i + 1]) < 60:
            i += 2
        if self.is_(i, "am", "pm"):
            return i + 1
        if self.is_(i, "a", "p") and self.is_(i + 1, ".") and self.is_(i + 2, "m"):
            return i + 4 if self.is_(i + 3, ".") else i + 3
        return i

    def bare_year(self, i: int) -> int | None:
        if not (self.number(i, 4, 4) and self.words[i][:2] in ("19", "20")):
            return None
        a = self.spans[i][0]
        if a and self.text[a - 1] in NOT_BEFORE_YEARS or i + 1 < len(self.lower) and self.lower[i + 1] in NOT_YEARS and self.spans[i + 1][0] - self.spans[i][1] <= 3:
            return None
        return i + 1

    def bare_month(self, i: int) -> int | None:
        """A month in full; May is also a verb, and small letters may be verbs or names."""
        return i + 1 if self.is_(i, *MONTHS) and self.words[i].istitle() and self.words[i] != "May" else None


GRAMMAR = (
    ("DATE", (Reader.written, Reader.compact, Reader.month_first, Reader.day_first)),
    ("PERIOD", (Reader.quarter, Reader.ordinal, Reader.ledger_year)),
    ("RELATIVE", (Reader.related, Reader.compared, Reader.ago, Reader.named_day)),
    ("TIME", (Reader.clock,)),
    ("YEAR", (Reader.bare_year,)),
    ("MONTH", (Reader.bare_month,)),
)
#: Words that can begin a phrase.
STARTS = frozenset([*MONTHS, *SHORT, *UNITS, *(u + "s" for u in UNITS), *ORDINALS, *RELATIONS, *COUNTS, *DAYS, *LEDGER_YEARS, "q", "h", "fy", "cy"])


def times(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the phrases, the longest at each place where one begins; they may overlap."""
    return Reader(text).phrases()
