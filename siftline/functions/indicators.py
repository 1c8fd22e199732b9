"""Scam language: which families of words a text has, and whether that is suspicious."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions import once

# Patterns of scam language by family, and the families that suffice alone.
INDICATORS = {
    "urgency": r"(?iU)\b(urgent(ly)?|immediately|asap|right now|within \d+\s*(hours?|hrs?|minutes?|mins?)|today only|last chance|expir(e|es|ed|ing)|deadline)\b",
    "account_threat": r"(?iU)\b(blocked|suspended|deactivated|frozen|locked|disconnected|penalty|legal action|arrest|police|fir)\b",
    "credential_request": r"(?iU)\b(otp|one time password|pin|password|cvv|card number|kyc|aadhaar|pan card|login details|verification code|screen ?share|anydesk|teamviewer)\b",
    "payment_request": r"(?iU)\b(send|pay|transfer|deposit|scan (the )?qr|processing fee|registration fee|advance)\b.{0,40}?(₹|rs\.?|inr|rupees|\d{3,}|money|amount|fee)",
    "reward_bait": r"(?iU)\b(won|winner|lottery|prize|cashback|reward|bonus|gift|lucky draw|refund|free|jackpot|selected)\b",
    "job_or_investment_bait": r"(?iU)\b(work from home|part[- ]time job|earn \S+ (per|a) day|daily income|guaranteed returns?|double your money|crypto|trading tips?|investment plan|task based)\b",
}
STRONG = ["credential_request", "payment_request", "account_threat", "job_or_investment_bait"]
_IDENTIFIER = r"(?U)(?<!\S)\S+@\S+|\b(?:https?://|www\.)\S+|(?<![\w-]|[\w-]\.)[\w-]++(?:\.[\w-]++)++/\S*"


def find_indicators(text: Column) -> Column:
    """Families found, in their fixed order; words inside links and addresses don't count."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), _IDENTIFIER, " ")
    return once(plain, lambda t: F.filter(F.array(*[F.when(t.rlike(p), F.lit(n)) for n, p in INDICATORS.items()]), lambda x: x.isNotNull()))


def is_suspicious(indicators: Column, bad_url: Column) -> Column:
    return bad_url | F.arrays_overlap(indicators, F.array(*map(F.lit, STRONG))) | (F.size(indicators) >= 2)
