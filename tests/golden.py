"""The hand-checked mini-log: 54 lines in both layouts, one planted resolver."""

VIEW = "198.18.1.0/24\t64511\n198.18.2.0/24\t64512\n198.18.3.0/24\t64513\n203.0.113.0/24\t64666\n"

REPORT = [
    ("10.0.0.1", "10", "16", "2", "-", "-", "-"),
    ("10.0.0.9", "3", "9", "1", "64666", "a.com:b.com:c.com", "203.0.113.9"),
    ("10.0.0.4", "3", "9", "1", "-", "-", "-"),
    ("10.0.0.3", "3", "9", "1", "-", "-", "-"),
    ("10.0.0.2", "3", "9", "1", "-", "-", "-"),
]
ANOMALIES = [("10.0.0.9", name, "ttl:clen:asn") for name in ("a.com", "b.com", "c.com")]
CONFIRMED = [
    ("10.0.0.9", name, "64666", "203.0.113.9", "ttl:cname:nip") for name in ("a.com", "b.com", "c.com")
]
MIN_RESOLUTIONS = 10


def line(number, resolver, client, name, answers, ttls, rcode="NOERROR"):
    """Even lines in the short layout, odd ones in the long layout."""
    if number % 2 == 0:
        cells = ["0"] * 45
        at = dict(resolver=4, client=5, name=11, rcode=15, rd=18, ra=19, answers=24, ttls=25)
    else:
        cells = ["0"] * 49
        at = dict(resolver=6, client=5, name=14, rcode=18, rd=21, ra=22, answers=27, ttls=28)
    cells[at["resolver"]], cells[at["client"]] = resolver, client
    cells[at["name"]], cells[at["rcode"]] = name, rcode
    cells[at["rd"]] = cells[at["ra"]] = "1"
    cells[at["answers"]], cells[at["ttls"]] = answers, f'"{ttls}"'
    return ",".join(cells)


def lines():
    names = ("a.com", "b.com", "c.com")
    content = [
        (f"10.0.0.{r}", "192.168.0.1", name, f"cdn.{name}|-><-|198.18.{i + 1}.1", "3600,60")
        for r in (1, 2, 3, 4)
        for i, name in enumerate(names)
        for _ in range(3)
    ]
    content += [
        ("10.0.0.9", "192.168.0.2", name, "203.0.113.9", "9999") for name in names for _ in range(3)
    ]
    content += [
        ("10.0.0.1", "192.168.0.3", f"t{k}.net", f"20.{k}.0.1", "60") for k in range(1, 8)
    ]
    content.append(("10.0.0.1", "192.168.0.3", "a.com", "", "", "NXDOMAIN"))
    return [line(i, *row) for i, row in enumerate(content)] + [",".join(["0"] * 44)]
