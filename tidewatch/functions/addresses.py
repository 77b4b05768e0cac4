"""Hosts of URLs as addresses: which of them lead to the public network."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranges that aren't public (fixed values): first address, length of the prefix.
V4 = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15),
    ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
]
#: Addresses within them that are.
V4_OPEN = [("192.0.0.9", 32), ("192.0.0.10", 32)]
#: Public addresses of the longer form start with the bits 001; these ranges among them aren't public (first four groups, length of the prefix).
V6 = [((0x2001, 0, 0, 0), 23), ((0x2001, 0xDB8, 0, 0), 32), ((0x2002, 0, 0, 0), 16), ((0x3FFF, 0, 0, 0), 20)]
V6_OPEN = [((0x2001, 3, 0, 0), 32), ((0x2001, 4, 0x112, 0), 48), ((0x2001, 0x20, 0, 0), 28), ((0x2001, 0x30, 0, 0), 28)]
#: Two single addresses that are public.
V6_SINGLE = [((0x2001, 1, 0, 0), 1), ((0x2001, 1, 0, 0), 2)]


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), in which the value is a variable: however often it is used, it stands in the expression once and is computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def host(url: Column) -> Column:
    """The host of an http or https URL in lower case, without brackets; '' if there is none."""
    found = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?i:https?)://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]*)", 1))
    return F.regexp_replace(found, r"^\[|\]$", "")


def _part(p: Column) -> Column:
    """A number as hosts may write it: decimal, octal after 0, or hexadecimal after 0x. Null if it isn't one."""
    of = lambda digits, base: F.conv(digits, base, 10).cast("long")
    return (
        F.when(p.rlike("^0x[0-9a-f]{1,8}$"), of(F.substr(p, F.lit(3)), 16)).when(p.rlike("^0[0-7]{0,11}$"), of(p, 8)).when(p.rlike("^[1-9][0-9]{0,9}$"), p.cast("long"))
    )


def v4(h: Column) -> Column:
    """The number of an address of one to four parts, the last of which fills what the others leave; null if h isn't one."""

    def number(values: Column) -> Column:
        n = F.size(values)
        lead, last = F.slice(values, F.lit(1), F.greatest(n - 1, F.lit(0))), F.element_at(values, -1)
        room = F.when(n == 1, F.lit(256**4)).when(n == 2, F.lit(256**3)).when(n == 3, F.lit(256**2)).otherwise(F.lit(256))
        fits = (n <= 4) & ~F.exists(values, lambda v: v.isNull()) & ~F.exists(lead, lambda v: v > 255) & (last < room)
        return F.when(fits, F.aggregate(lead, F.lit(0).cast("long"), lambda x, v: x * 256 + v) * room + last)

    return _let(F.transform(F.split(h, r"\.", -1), _part), number)


def _number(dotted: str) -> int:
    return reduce(lambda a, x: a * 256 + int(x), dotted.split("."), 0)


def v4_public(n: Column) -> Column:
    inside = lambda ranges: reduce(Column.__or__, (n.between(_number(a), _number(a) + 2 ** (32 - k) - 1) for a, k in ranges))
    return ~inside(V4) | inside(V4_OPEN)


def v6(h: Column) -> Column:
    """The eight groups of an address of the longer form as numbers; null if h isn't one. A zone after % is left out."""

    def with_groups(bare: Column) -> Column:
        """An address of the shorter form at the end written as two groups."""
        tail = F.regexp_extract(bare, r"(?:^|:)([0-9]{1,3}(?:\.[0-9]{1,3}){3})$", 1)
        two = lambda n: F.concat(F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(F.lit(65535).cast("long"))))
        return _let(tail, lambda t: F.when(t == "", bare).when(~t.rlike(r"(^|\.)0[0-9]"), F.concat(F.left(bare, F.length(bare) - F.length(t)), F.lower(_let(v4(t), two)))))

    def numbers(halves: Column) -> Column:
        short = F.size(halves) == 2
        missing = 8 - F.size(halves[0]) - F.when(short, F.size(F.get(halves, 1))).otherwise(0)
        every = F.when(short, F.concat(halves[0], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), F.get(halves, 1))).otherwise(halves[0])
        fits = (F.size(halves) <= 2) & F.when(short, missing >= 1).otherwise(missing == 0)
        return _let(F.when(fits, every), lambda e: F.when(F.forall(e, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.transform(e, lambda g: F.conv(g, 16, 10).cast("int"))))

    groups = lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ":", -1))
    return _let(with_groups(F.regexp_replace(h, "%.*$", "")), lambda plain: _let(F.transform(F.split(plain, "::", -1), groups), numbers))


def v6_public(g: Column) -> Column:
    """Mapped addresses are as public as the shorter form they map."""

    def inside(groups: tuple[int, ...], bits: int) -> Column:
        tests = []
        for i, x in enumerate(groups):
            take = min(16, max(0, bits - 16 * i))
            if take:
                tests.append(F.shiftright(g[i], 16 - take) == x >> (16 - take))
        return reduce(Column.__and__, tests)

    single = lambda groups, last: inside(groups, 64) & (g[4] == 0) & (g[5] == 0) & (g[6] == 0) & (g[7] == last)
    closed = reduce(Column.__or__, (inside(*r) for r in V6))
    open_ = reduce(Column.__or__, [*(inside(*r) for r in V6_OPEN), *(single(*s) for s in V6_SINGLE)])
    mapped = inside((0, 0, 0, 0), 64) & (g[4] == 0) & (g[5] == 65535)
    return F.when(mapped, v4_public(g[6].cast("long") * 65536 + g[7])).otherwise((F.shiftright(g[0], 13) == 1) & (~closed | open_))


def safe_public_url(url: Column) -> Column:
    """http or https with a host that is neither local nor an address that isn't public, in any of the forms that addresses take. Names aren't looked up."""

    def safe(h: Column) -> Column:
        local = h.isin("", "localhost", "localhost.") | h.endswith(".localhost")
        long_ = F.coalesce(_let(v6(h), v6_public), F.lit(False))
        return F.when(local, False).when(F.contains(h, F.lit(":")), long_).otherwise(F.coalesce(_let(v4(F.regexp_replace(h, r"\.$", "")), v4_public), F.lit(True)))

    return _let(host(url), safe)
