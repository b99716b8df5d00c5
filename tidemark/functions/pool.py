"""Orders filled against recorded reserves of a constant-product pool, in whole units."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass
class Reserves:
    tokens: int
    money: int

    def sell(self, amount: int) -> int:
        """What the pool pays for tokens, rounded down, and moves by."""
        paid = self.money * amount // (self.tokens + amount)
        self.tokens, self.money = self.tokens + amount, self.money - paid
        return paid

    def cost(self, amount: int) -> int | None:
        """What tokens cost, rounded up; None where the pool has no more than that."""
        return None if amount >= self.tokens else -(-self.money * amount // (self.tokens - amount))

    def buy(self, amount: int, cost: int) -> None:
        self.tokens, self.money = self.tokens - amount, self.money + cost

    def price(self) -> int:
        """Money for a million tokens, rounded down."""
        return self.money * 1_000_000 // self.tokens


@dataclass
class DipPolicy:
    """Buys the wanted amount when the price fell by `dip` percent since the slot before, sells all at a gain of `rise` percent or after `hold` slots."""

    dip: int = 3
    rise: int = 3
    hold: int = 5

    def order(self, price: int, before: int | None, held: int, entry: int, age: int, wanted: int) -> tuple[str, int] | None:
        if not held:
            return ("buy", wanted) if before is not None and wanted > 0 and price * 100 <= before * (100 - self.dip) else None
        return ("sell", held) if price * 100 >= entry * (100 + self.rise) or age >= self.hold else None


class Replay:
    """One mint's slots in order. A slot's reading replaces the reserves, then the policy is asked once and its order filled against them; without any reading nothing can be filled.

    An order above `participation` (in 1/10,000 of the tokens) is refused as one that the
    tape cannot price; one that money or holdings do not cover is refused too.
    """

    def __init__(self, key: int, money: int, participation: int, policy: DipPolicy):
        self._key, self.cash, self._most, self._policy = key, money, participation, policy
        self.pool: Reserves | None = None
        self.held = self.entry = self.since = self.slots = 0
        self.before: int | None = None
        self.fills = self.spent = self.received = self.refused = self.too_large = 0

    def slot(self, reading: tuple[int, int] | None, wanted: int) -> None:
        if reading is not None:
            self.pool = Reserves(*reading)
        self.slots += 1
        if self.pool is None:
            return
        price = self.pool.price()
        order = self._policy.order(price, self.before, self.held, self.entry, self.slots - self.since, wanted)
        self.before = price
        if order is None:
            return
        side, amount = order
        if amount > self.pool.tokens * self._most // 10_000:
            self.too_large += 1
        elif side == "sell":
            paid = self.pool.sell(amount)
            self.held, self.cash, self.received, self.fills = 0, self.cash + paid, self.received + paid, self.fills + 1
        else:
            cost = self.pool.cost(amount)
            if cost is None or cost > self.cash:
                self.refused += 1
                return
            self.pool.buy(amount, cost)
            self.held, self.cash, self.spent, self.fills = amount, self.cash - cost, self.spent + cost, self.fills + 1
            self.entry, self.since = price, self.slots

    def feed(self, rows) -> list[tuple]:
        for tokens, money, wanted in zip(rows["tokens"].tolist(), rows["money"].tolist(), rows["wanted"].tolist(), strict=True):
            self.slot(None if tokens is None or tokens != tokens else (int(tokens), int(money)), int(wanted))
        return []

    def end(self) -> list[tuple]:
        return [(self._key, self.slots, self.fills, self.spent, self.received, self.cash, self.held, self.refused, self.too_large)]
