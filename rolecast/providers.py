"""Per-provider reading rules.

A posting names the board it came from; a few parsers read the same text
differently per board. Callers register their own boards here.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Provider:
    name: str
    #: ``25/09/2026`` is read day first (otherwise slash dates are not read at all)
    day_first_dates: bool = False
    #: ``yr`` and ``yrs`` count as years
    short_years: bool = False
    #: pay without a currency is in rupees
    rupee_pay: bool = False
    #: a ``Key Skills`` / ``Job details`` site of its own
    official_hosts: tuple[str, ...] = ()


#: Two neutral boards that differ in every rule; pass your own to override.
DEFAULT_PROVIDERS: tuple[Provider, ...] = (
    Provider("board_in", True, True, True, ("board-in.example",)),
    Provider("board_global", False, False, False, ("board-global.example", "board-global.co.example")),
)


def has_trait(provider: Column, trait: str, providers: Sequence[Provider]) -> Column:
    names = [p.name for p in providers if getattr(p, trait)]
    return F.coalesce(provider.isin(names), F.lit(False)) if names else F.lit(False)


def official_hosts(provider: Column, providers: Sequence[Provider]) -> Column:
    hosts = F.array().cast("array<string>")
    for p in providers:
        if p.official_hosts:
            hosts = F.when(provider == p.name, F.array(*[F.lit(h.lower()) for h in p.official_hosts])).otherwise(hosts)
    return hosts
