"""Patterns for personal data, and how to blank them out of text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (before, core, after). The outer groups keep digits next to a match out;
# they are put back when the core is replaced. No look-around, so the same text works in
# any regular-expression engine.
PATTERNS = {
    "credit_card": ("(?:^|[^0-9])", "[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", "(?:[^0-9]|$)"),
    "ip_address": ("(?:^|[^0-9.])", r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", "(?:[^0-9.]|$)"),
    "ssn": ("(?:^|[^0-9-])", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "(?:[^0-9-]|$)"),
    "date_of_birth": ("", "(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])", ""),
    "phone": ("", r"\+?[0-9]{1,3}[ .-]\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-]?[0-9]{2,4}", ""),
    "email": ("", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", ""),
}


def pattern(kind: str) -> str:
    return "".join(PATTERNS[kind])


def possible(text: Column, kind: str) -> Column:
    """A cheap test that every match passes: most texts hold no digit and no at-sign."""
    return text.contains("@") if kind == "email" else text.rlike("[0-9]")


def occurrences(text: Column, kind: str) -> Column:
    found = F.regexp_count(text, F.lit(pattern(kind)))
    return F.when(possible(text, kind), found).otherwise(0)


def holds(text: Column, kind: str) -> Column:
    """True where the text has a match; false for null."""
    return F.when(possible(text, kind), text.rlike(pattern(kind))).otherwise(False)


def kinds_in(text: Column) -> Column:
    """Comma list of the kinds found in the text, in name order; empty when clean."""
    return F.concat_ws(",", *[F.when(holds(text, k), F.lit(k)) for k in sorted(PATTERNS)])


def blank_out(text: Column, strategies: Mapping[str, str]) -> Column:
    """Text with each kind replaced: ``mask`` by stars, ``redact`` by its name.

    Cards go first, since a phone pattern also fits part of a card number. Two matches
    that share their boundary character need a second pass.
    """
    clean = text
    for kind, (before, core, after) in PATTERNS.items():
        strategy = strategies.get(kind)
        if strategy is None or strategy == "allow":
            continue
        token = {"mask": "****", "redact": f"[{kind}]"}[strategy]
        if before:
            regex = f"({before[3:-1]}){core}({after[3:-1]})"
            for _ in range(2):
                clean = F.regexp_replace(clean, regex, f"$1{token}$2")
        else:
            clean = F.regexp_replace(clean, core, token)
    return F.when(possible(text, "email") | text.rlike("[0-9]"), clean).otherwise(text)


def span_regex(kind: str) -> str:
    """A kind's core with its neighbours only looked at, so matches side by side are all found (Java)."""
    before, core, after = PATTERNS[kind]
    ahead = f"(?={after[3:-1]})" if after else ""
    return (f"(?<={before[3:-1]})" if before else "") + core + ahead


def text_token(value: Column, kind: str, strategy: str, secret: str) -> Column:
    """``[kind:letters]``: the same for the same value and secret, and without a digit that another kind could match."""
    digest = F.sha2(F.concat(F.lit(f"{secret}{kind}:"), value), 256)
    letters = F.translate(digest, "0123456789", "ghijklmnop")
    if strategy == "pseudonymize":
        letters = F.substring(letters, 1, 16)
    return F.concat(F.lit(f"[{kind}:"), letters, F.lit("]"))


def protect_field(value: Column, strategy: str, secret: str = "") -> Column:
    """A whole field under a strategy; nulls stay null.

    ``pseudonymize`` gives the same short token for the same value and secret, so joins
    and counts still work; ``hash`` gives the full digest.
    """
    if strategy == "mask":
        return F.when(value.isNotNull(), F.concat(F.lit("****"), F.right(value, F.lit(4))))
    if strategy == "redact":
        return F.when(value.isNotNull(), F.lit("[redacted]"))
    digest = F.sha2(F.concat(F.lit(secret), value), 256)
    if strategy == "hash":
        return digest
    if strategy == "pseudonymize":
        return F.concat(F.lit("p_"), F.substring(digest, 1, 16))
    raise ValueError(f"unknown strategy {strategy!r}")
