"""Addresses and host names as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First and last address of the reserved IPv4 ranges, as numbers; documentation wins over private.
DOCUMENTATION = [(3221225984, 3221226239), (3325256704, 3325256959), (3405803776, 3405804031)]
PRIVATE = [(167772160, 184549375), (2886729728, 2887778303), (3232235520, 3232301055)]
LOOPBACK, LINK_LOCAL, CGNAT = (2130706432, 2147483647), (2851995648, 2852061183), (1681915904, 1686110207)

# Patterns of host names and of providers with the notes they stand for, and notes on kinds of addresses.
HOSTNAMES = [
    (r"(?i)\b(?:tor[-._]?(?:exit|relay|node))\b", "reverse DNS names this host as a Tor node"),
    (r"(?i)\bexit[-._]?node\b", "reverse DNS suggests an anonymising exit node"),
    (r"(?i)\b(?:vpn|proxy|socks)\b", "reverse DNS suggests VPN or proxy infrastructure"),
    (r"(?i)\bopen[-._]?(?:smtp|relay|mail)\b", "reverse DNS suggests an open mail relay"),
    (r"(?i)\b(?:dynamic|dyn|dsl|pppoe|broadband|cable|dhcp)\b", "reverse DNS pattern of a dynamic residential address, which is unusual for a legitimate mail server and consistent with a compromised host"),
    (r"(?i)\b(?:vps|server|hosting|cloud|compute|instance|droplet|linode|ovh|colo)\b", "reverse DNS suggests hosting or cloud infrastructure rather than a corporate MTA"),
    (r"(?i)\b(?:bullet|offshore|anon)\w*host", "reverse DNS suggests bulletproof hosting"),
]
PROVIDERS = [
    (r"(?i)(?:digitalocean|linode|vultr|hetzner|ovh|contabo|scaleway|choopa)", "budget VPS provider commonly abused for bulk sending"),
    (r"(?i)(?:amazon|aws|google cloud|microsoft azure|azure|oracle cloud|alibaba)", "large cloud provider: sending IP is not owned by the purported sender"),
    (r"(?i)(?:tor project|nym|mullvad|nordvpn|expressvpn|private internet)", "anonymisation provider"),
]
PRIVATE_NOTE = "non-routable address: this hop is inside a private network"
DOCUMENTATION_NOTE = "address is from a reserved documentation range (RFC 5737/3849), so it is either synthetic test traffic or a forged header"
CGNAT_NOTE = "carrier-grade NAT range: the address maps to many subscribers"
CLOUD_NOTE = "address belongs to a large cloud provider (%s)"
NO_NAME_NOTE = "no reverse DNS name presented for this hop"


def octets(ip: Column) -> Column:
    """IPv4 text as an array of four numbers, cut once; an array with nulls or of another size if it isn't one."""
    return F.transform(F.split(ip, "\\."), lambda x: F.when(F.length(x) <= 3, x.try_cast("int")))


def ip_number(ip: Column) -> Column:
    """IPv4 text as a number; null if it isn't one (an address is split once)."""
    step = lambda n, x: F.when((x >= 0) & (x <= 255), n * 256 + x)
    return F.when(ip.rlike("^[0-9]{1,3}(?:\\.[0-9]{1,3}){3}$"), F.aggregate(octets(ip), F.lit(0).cast("bigint"), step))


def _in(n: Column, ranges: list[tuple[int, int]]) -> Column:
    test = F.lit(False)
    for a, b in ranges:
        test = test | n.between(a, b)
    return test


def ip_class(ip: Column) -> Column:
    n = ip_number(ip)
    six = F.when(ip == "::1", "loopback").when(F.lower(ip).startswith("fe80:"), "link-local").when(F.lower(ip).rlike("^f[cd]"), "private").when(F.lower(ip).startswith("2001:db8:"), "documentation").otherwise("global")
    four = (
        F.when(_in(n, DOCUMENTATION), "documentation").when(_in(n, [LOOPBACK]), "loopback").when(_in(n, [LINK_LOCAL]), "link-local").when(_in(n, [CGNAT]), "cgnat").when(_in(n, PRIVATE), "private").otherwise("global")
    )
    return F.when(n.isNotNull(), four).when(ip.contains(":"), six).otherwise("invalid")


def infra_indicators(host: Column, ip: Column, isp: Column, cloud: Column) -> Column:
    """Sorted notes on a hop: its address (``cloud``: whether it lies in a cloud provider's range), its host name and its provider."""
    kind, name, owner = ip_class(ip), F.coalesce(host, F.lit("")), F.coalesce(isp, F.lit(""))
    inside = kind.isin("private", "loopback", "link-local")
    notes = [F.when(kind == k, F.lit(t)) for k, t in (("documentation", DOCUMENTATION_NOTE), ("cgnat", CGNAT_NOTE))]
    notes += [F.when(inside, F.lit(PRIVATE_NOTE)), F.when(cloud, F.format_string(CLOUD_NOTE, owner)), F.when((F.coalesce(ip, F.lit("")) != "") & (name == "") & ~inside, F.lit(NO_NAME_NOTE))]
    notes += [F.when(text.rlike(p), F.lit(t)) for text, table in ((name, HOSTNAMES), (owner, PROVIDERS)) for p, t in table]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*notes))))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _bits(hexadecimal: Column, digits: int) -> Column:
    """Hexadecimal digits as a text of zeros and ones (``conv`` holds 64 bits at most)."""
    step = 8
    return F.concat(*[F.lpad(F.conv(F.substring(hexadecimal, 1 + i, step), 16, 2), 4 * step, "0") for i in range(0, digits, step)])


def _six(text: Column) -> Column:
    """The bits of an IPv6 text; null if it isn't one."""
    cut = lambda x: F.filter(F.split(x, ":", -1), lambda g: g != "")
    dotted = lambda n: F.concat(F.regexp_replace(text, r"[^:]*$", ""), F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(0xFFFF))))
    groups = F.when(F.contains(text, F.lit(".")), _let(ip_number(F.regexp_extract(text, r":([0-9.]+)$", 1)), dotted)).otherwise(text)

    def filled(half: Column) -> Column:
        left, right = cut(half[0]), cut(half[1])
        missing = 8 - F.size(left) - F.size(right)
        return F.when(missing > 0, F.concat(left, F.array_repeat(F.lit("0"), missing), right))

    whole = lambda g: F.when(F.contains(g, F.lit("::")), _let(F.split(g, "::", 2), filled)).otherwise(F.split(g, ":", -1))
    valid = lambda w: (F.size(w) == 8) & F.forall(w, lambda x: x.rlike("^[0-9a-f]{1,4}$"))
    bits = lambda w: F.when(valid(w), _bits(F.array_join(F.transform(w, lambda x: F.lpad(x, 4, "0")), ""), 32))
    return _let(_let(groups, lambda g: F.when(~g.rlike("^:[^:]|[^:]:$|:::|::.*::"), whole(g))), bits)


def ip_bits(ip: Column) -> Column:
    """An IPv4 or IPv6 address as 32 or 128 zeros and ones; null if it is neither.  Zone ids are ignored; a dotted tail is read."""
    four = lambda n: F.lpad(F.conv(n.cast("string"), 10, 2), 32, "0")
    text = F.lower(F.trim(F.regexp_replace(ip, "%.*$", "")))
    return _let(text, lambda t: F.when(F.contains(t, F.lit(":")), _six(t)).otherwise(_let(ip_number(t), four)))


def network_prefix(cidr: Column) -> Column:
    """``address/length`` as the zeros and ones that all its addresses begin with, led by 4 or 6; null if it isn't one.  Bits after the length are ignored."""
    parts = F.split(cidr, "/", 2)

    def begun(bits: Column) -> Column:
        length = F.when(F.size(parts) == 2, parts[1].try_cast("int")).otherwise(F.length(bits))
        return F.when(length.between(0, F.length(bits)), F.concat(family(bits), F.substring(bits, F.lit(1), length)))

    return _let(ip_bits(parts[0]), begun)


def family(bits: Column) -> Column:
    return F.when(F.length(bits) == 32, "4").otherwise("6")
