"""Sessions: a sign-in begins a family of refresh tokens, of which each generation is presented once and replaced.

The same rules run over a stream, with a family's generations as keyed state, and over a table, where families are dealt out
and read in order. A family that sees a token again outside the grace is revoked as a whole: whoever holds a later token of it
is refused from then on.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ordered import MOST_ROWS, log, scan


class Policy(NamedTuple):
    """Seconds that a refresh token lives, and that one which has just been replaced is still taken for a lost answer."""

    lifetime: int
    grace: int


# Policies by kind of client.
POLICIES = {"web": Policy(12 * 3600, 30), "ios": Policy(30 * 86400, 60), "android": Policy(30 * 86400, 60)}
MICROS = 1_000_000


class Family:
    """Generations of one family by the time they were issued; one is replaced when the next is issued. Generations past their
    lifetime are forgotten but for their number: they are refused as expired whatever else is known."""

    def __init__(self, policy: Policy, issued: list[int] | None = None, first: int = 0, revoked: bool = False):
        self.policy, self.issued, self.first, self.revoked = policy, issued or [], first, revoked

    @property
    def current(self) -> int:
        return self.first + len(self.issued) - 1

    def forget(self, now: int) -> int:
        """Drops expired generations but the last two; returns how many."""
        n = 0
        while len(self.issued) - n > 2 and now >= self.issued[n] + self.policy.lifetime * MICROS:
            n += 1
        self.issued, self.first = self.issued[n:], self.first + n
        return n

    def present(self, generation: int, now: int) -> str:
        """What a refresh with this generation's token gives, ``now`` in microseconds."""
        if self.revoked:
            return "revoked"
        at = generation - self.first
        if at < 0 or at < len(self.issued) and now >= self.issued[at] + self.policy.lifetime * MICROS:
            return "expired"
        if generation == self.current:
            out = "rotate"
        elif generation == self.current - 1 and now < self.issued[at + 1] + self.policy.grace * MICROS:
            out = "replay"
        else:
            # an older token, or one that was never issued
            self.revoked = True
            return "reuse"
        self.issued.append(now)
        return out


def numbered(events: DataFrame, key: str, order: list[str], sign_in: Column, most: int = MOST_ROWS) -> DataFrame:
    """``events`` with family: the number of sign-ins of the key up to and with each; 0 before the first."""
    begins = F.coalesce(sign_in, F.lit(False)).cast("bigint")
    return scan(log(events, [key], order, most), family=("sum", begins)).done()


def refreshed(requests: DataFrame, key: str, tie: str) -> DataFrame:
    """Every request with its outcome: ``requests`` has the key, family, client, ts, ``tie``, sign_in and generation.

    Outcomes: issued (the sign-in), rotate, replay (a new generation all the same), reuse (the family is revoked), revoked,
    expired, unknown (no family, no client of POLICIES, or no generation). Families are dealt out by key and number and read in order, so a
    key with many of them is spread; a family's own requests follow one another by nature, and only its generations that
    live are in memory. Only the named columns are returned: key, family, ts, tie, outcome, current.
    """
    columns = [key, "family", "client", "ts", tie, "sign_in", "generation"]
    rows = requests.select(*columns).repartition(key, "family").sortWithinPartitions(key, "family", "ts", tie)
    kinds = dict(rows.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, family = None, None
        for part in parts:
            outcomes, current = [], []
            micros = part["ts"].astype("datetime64[us]").astype("int64")
            for k, f, client, now, sign_in, g in zip(part[key], part["family"], part["client"], micros, part["sign_in"], part["generation"]):
                if (k, f) != at:
                    at, family = (k, f), None
                out, family = _step(family, client, int(now), sign_in, None if pd.isna(g) else int(g))
                outcomes.append(out)
                current.append(family.current if family else None)
            yield part[[key, "family", "ts", tie]].assign(outcome=outcomes, current=pd.array(current, "Int64"))

    return rows.mapInPandas(run, f"{key} {kinds[key]}, family bigint, ts {kinds['ts']}, {tie} {kinds[tie]}, outcome string, current bigint")


def _step(family: Family | None, client: str, now: int, sign_in: bool, generation: int | None) -> tuple[str, Family | None]:
    if sign_in and client in POLICIES:
        return "issued", Family(POLICIES[client], [now])
    if family is None or generation is None:
        return "unknown", family
    family.forget(now)
    return family.present(generation, now), family


class _Families(StatefulProcessor):
    """The open family of each key: its generations as a list, what else is known of it by name; a timer ends it with its tokens."""

    def __init__(self, key: str, tie: str):
        self.key, self.tie = key, tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.issued = handle.getListState("issued", "at long")
        self.known = handle.getMapState("known", "name string", "value string")

    def _read(self) -> tuple[int, Family | None]:
        if not self.known.exists():
            return 0, None
        known = {k[0]: v[0] for k, v in self.known.iterator()}
        family = None
        if "client" in known:
            family = Family(POLICIES[known["client"]], [x[0] for x in self.issued.get()], int(known["first"]), known["revoked"] == "1")
        return int(known["number"]), family

    def _write(self, number: int, client: str | None, family: Family | None) -> None:
        self.known.updateValue(("number",), (str(number),))
        if family is None:
            return
        if client is not None:
            self.known.updateValue(("client",), (client,))
        self.known.updateValue(("first",), (str(family.first),))
        self.known.updateValue(("revoked",), ("1" if family.revoked else "0",))
        self.issued.put([(x,) for x in family.issued])
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        # when the last token has expired, its generations are no longer needed
        self.handle.registerTimer((family.issued[-1] + family.policy.lifetime * MICROS) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", self.tie])
        number, family = self._read()
        client_now, out = None, []
        micros = batch["ts"].astype("datetime64[us]").astype("int64")
        for ts, now, tie, client, sign_in, g in zip(batch["ts"], micros, batch[self.tie], batch["client"], batch["sign_in"], batch["generation"]):
            if sign_in:
                number += 1
                family, client_now = None, client
            outcome, family = _step(family, client, int(now), sign_in, None if pd.isna(g) else int(g))
            out.append((key[0], number, ts, tie, outcome, family.current if family else None))
        if client_now is not None and family is None:
            self.known.clear()
        self._write(number, client_now if client_now in POLICIES else None, family)
        frame = pd.DataFrame(out, columns=[self.key, "family", "ts", self.tie, "outcome", "current"])
        frame["current"] = frame["current"].astype("Int64")
        yield frame

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        number, family = self._read()
        if family is not None:
            family.forget(1 << 62)
            self.issued.put([(x,) for x in family.issued])
        return iter(())

    def close(self) -> None:
        pass


def follow(requests: DataFrame, key: str, tie: str, late: str = "1 hour") -> DataFrame:
    """The stream twin of ``numbered`` and ``refreshed``: requests (key, client, ts, ``tie``, sign_in, generation) that come in order of
    time, batch by batch, to their outcomes. Needs the RocksDB state store."""
    rows = requests.select(key, "client", F.col("ts").cast("timestamp").alias("ts"), tie, "sign_in", "generation").withWatermark("ts", late)
    kinds = dict(rows.dtypes)
    schema = f"{key} {kinds[key]}, family bigint, ts timestamp, {tie} {kinds[tie]}, outcome string, current bigint"
    return rows.groupBy(key).transformWithStateInPandas(_Families(key, tie), schema, "append", "eventtime")
