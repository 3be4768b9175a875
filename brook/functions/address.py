"""Private and loopback addresses of either family, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The networks that are no part of the public internet.
NETS4 = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4")
#: Addresses of those networks that are public.
PUBLIC4 = ("192.0.0.9/32", "192.0.0.10/32")
#: The same of the longer addresses, as their first hexadecimal digits.
NETS6 = ("0" * 31 + "1", "0" * 32, "0064ff9b0001", "0100" + "0" * 12, "200100", "200101", "20010db8", "2002", "fc", "fd", "fe8", "fe9", "fea", "feb")
PUBLIC6 = ("20010001" + "0" * 23 + "1", "20010001" + "0" * 23 + "2", "20010003", "200100040112", "2001002", "2001003")

#: Fixed value: the head of an address that stands for one of the other family, in its last digits.
MAPPED = "0" * 20 + "ffff"

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}"


def number4(ip: Column) -> Column:
    """The number of a dotted address; null if it is none."""
    part = lambda i: F.get(F.split(ip, r"\."), F.lit(i)).try_cast("long")
    return F.when(ip.rlike(rf"\A{_V4}\z"), part(0) * 2**24 + part(1) * 2**16 + part(2) * 2**8 + part(3))


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), where x is taken once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def digits6(ip: Column) -> Column:
    """The 32 hexadecimal digits of an address with colons; null if it is none."""
    none = F.expr("cast(array() as array<string>)")
    four = lambda gs: F.array_join(F.transform(gs, lambda g: F.lpad(g, 4, "0")), "")
    groups = lambda x: _let(x, lambda v: F.when(v.isNull() | (v == ""), none).otherwise(F.split(v, ":")))

    def plain(low: Column) -> Column:
        """A dotted tail as two groups."""
        two = lambda n: F.concat(F.regexp_replace(low, r"[0-9.]+\z", ""), F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(65535))))
        return _let(number4(F.regexp_extract(low, rf":({_V4})\z", 1)), lambda n: F.coalesce(two(n), low))

    def whole(p: Column) -> Column:
        n = F.size(p["l"]) + F.size(p["r"])
        fits = F.when(p["n"] == 2, n <= 7).otherwise((p["n"] == 1) & (n == 8))
        valid = F.forall(F.concat(p["l"], p["r"]), lambda g: g.rlike(r"\A[0-9a-f]{1,4}\z"))
        return F.when(fits & valid, F.concat(four(p["l"]), F.repeat(F.lit("0000"), 8 - n), four(p["r"])))

    halves = lambda x: F.struct(F.size(x).alias("n"), groups(F.get(x, F.lit(0))).alias("l"), groups(F.get(x, F.lit(1))).alias("r"))
    low = F.regexp_replace(F.lower(ip), r"%[^%/]+\z", "")
    return _let(_let(_let(low, plain), lambda x: _let(F.split(x, "::"), halves)), whole)


def is_local(ip: Column) -> Column:
    """`localhost`, or a valid address that is private or loopback; false for null and anything else."""

    def within4(number: Column, nets: tuple) -> Column:
        out = F.lit(False)
        for net in nets:
            base, bits = net.split("/")
            low = sum(int(x) << s for x, s in zip(base.split("."), (24, 16, 8, 0), strict=True))
            out = out | number.between(low, low + 2 ** (32 - int(bits)) - 1)
        return out

    def within6(digits: Column, heads: tuple) -> Column:
        out = F.lit(False)
        for head in heads:
            out = out | digits.startswith(head)
        return out

    own4 = lambda n: within4(n, NETS4) & ~within4(n, PUBLIC4)
    mapped = lambda d: _let(F.conv(F.substring(d, 25, 8), 16, 10).cast("long"), own4)
    four = _let(number4(ip), own4)
    six = _let(digits6(ip), lambda d: F.when(d.startswith(MAPPED), mapped(d)).otherwise(within6(d, NETS6) & ~within6(d, PUBLIC6)))
    return F.coalesce((ip == "localhost") | F.coalesce(four, six), ip == "localhost", F.lit(False))
