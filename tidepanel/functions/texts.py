"""Text scalars: whitespace, hashes, event flags, macro names."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepanel.functions.scalar import col

#: Fixed patterns of event flags, on lower-cased text.
EVENT_PATTERNS = {
    "event_earnings": r"earnings|quarterly results|revenue|eps|guidance|fiscal quarter",
    "event_analyst": r"analyst|price target|upgrade|downgrade|rating|consensus estimate",
    "event_mna": r"acqui(?:re|red|sition)|merger|takeover|divest|stake in|definitive agreement",
    "event_legal": r"lawsuit|court|regulat|investigat|settlement|antitrust|department of justice",
    "event_product": r"launch|introduc|product|partnership|contract|approval|clinical trial|fda",
    "event_financing": r"dividend|buyback|repurchase|offering|debt|bond|capital return",
    "event_price_recap": r"stock (?:rose|fell|jumped|dropped|gained|declined)|shares (?:rose|fell|jumped|dropped|gained|declined|up|down)|pre-market|52.week",
}
#: Fixed patterns of macro releases, in any case.
MACRO_PATTERNS = (
    r"\bCPI\b",
    r"\bPCE Price Index\b",
    r"\bNon[\s-]?farm Payrolls\b",
    r"\bUnemployment Rate\b",
    r"\bAverage Hourly Earnings\b",
    r"\bRetail Sales\b",
    r"\bISM (?:Manufacturing|Services|Non-Manufacturing).*PMI\b",
    r"\bFed Interest Rate Decision\b",
)


def collapsed(text) -> Column:
    return F.trim(F.regexp_replace(col(text), r"(?U)\s+", " "))


def compact(parts: list, max_chars: int) -> Column:
    """Parts with white space collapsed, empty and repeated ones left out, a line each, cut to max_chars."""
    kept = F.filter(F.array(*(F.coalesce(collapsed(p), F.lit("")) for p in parts)), lambda p: p != "")
    return F.substring(F.array_join(F.array_distinct(kept), "\n"), 1, max_chars)


def normalized(text) -> Column:
    return collapsed(F.lower(col(text)))


def _alternatives(pattern: str) -> list[str]:
    """The parts of a pattern between its outermost bars."""
    parts, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def holds(text: Column, pattern: str) -> Column:
    """Whether a pattern matches somewhere: plain alternatives by substring search, others only where their plain start stands."""

    def one(part: str) -> Column:
        start = re.match(r"[A-Za-z0-9 -]*", part)[0]
        if start == part:
            return F.contains(text, F.lit(part))
        start = start[:-1] if part[len(start)] in "?*+{" else start
        return F.contains(text, F.lit(start)) & text.rlike(part)

    return reduce(or_, map(one, _alternatives(pattern)))


def event_flags(text, patterns: dict[str, str] = EVENT_PATTERNS) -> list[Column]:
    low = F.lower(col(text))
    return [holds(low, p).cast("int").alias(name) for name, p in patterns.items()]


def is_macro(event) -> Column:
    """GDP unless a nowcast, or one of the named releases."""
    e = col(event)
    low = F.lower(e)
    gdp = F.contains(low, F.lit("gdp")) & ~F.contains(low, F.lit("gdpnow")) & ~F.contains(low, F.lit("nowcast"))
    return reduce(or_, (e.rlike(f"(?i){p}") for p in MACRO_PATTERNS), gdp)
