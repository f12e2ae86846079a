"""Geo files against a linear scan over nested prefixes, in files written here from the format's description."""

import ipaddress
import random
import struct

import pytest

from logloom import api
from logloom.sources import mmdb

MARK = b"\xab\xcd\xefMaxMind.com"


def head(kind, size):
    extra, n = b"", size
    if size >= 29:
        for k, low in ((1, 29), (2, 285), (3, 65821)):
            if size - low < 256**k:
                n, extra = 28 + k, (size - low).to_bytes(k, "big")
                break
    return (bytes([n, kind - 7]) if kind > 7 else bytes([kind << 5 | n])) + extra


def value(v):
    if isinstance(v, bool):
        return head(14, int(v))
    if isinstance(v, dict):
        return head(7, len(v)) + b"".join(value(k) + value(x) for k, x in v.items())
    if isinstance(v, list):
        return head(11, len(v)) + b"".join(map(value, v))
    if isinstance(v, float):
        return head(3, 8) + struct.pack(">d", v)
    if isinstance(v, int):
        raw = v.to_bytes((v.bit_length() + 7) // 8, "big")
        return head(6, len(raw)) + raw
    raw = v.encode()
    return head(2, len(raw)) + raw


def pointer(at):
    if at < 2048:
        return bytes([1 << 5 | at >> 8, at & 255])
    if at < 526336:
        return bytes([1 << 5 | 1 << 3 | (at - 2048) >> 16]) + ((at - 2048) & 0xFFFF).to_bytes(2, "big")
    return bytes([1 << 5 | 3 << 3]) + at.to_bytes(4, "big")


def write(path, prefixes, bits, version):
    """A trie of (network, record); longer prefixes win."""
    root = [None, None]
    for net, record in sorted(prefixes, key=lambda p: p[0].prefixlen):
        number, length = int(net.network_address), net.prefixlen
        if version == 6 and net.version == 4:
            length += 96
        width = 128 if version == 6 else 32
        node = root
        for d in range(length):
            b = number >> (width - 1 - d) & 1
            if d == length - 1:
                node[b] = record if not isinstance(node[b], list) else node[b]
            else:
                if not isinstance(node[b], list):
                    node[b] = [node[b], node[b]]
                node = node[b]
    data, places = bytearray(value("filler" * 400)), {}
    shared = len(data)
    data += value("Shared Name")

    def place(record):
        key = repr(record)
        if key not in places:
            places[key] = len(data)
            data.extend(head(7, len(record) + 1) + b"".join(value(k) + value(x) for k, x in record.items()) + value("shared") + pointer(shared))
        return places[key]

    order = []

    def number_nodes(node):
        order.append(node)
        for x in node:
            if isinstance(x, list):
                number_nodes(x)

    number_nodes(root)
    index = {id(n): i for i, n in enumerate(order)}
    tree = bytearray()
    for node in order:
        a, b = [index[id(x)] if isinstance(x, list) else len(order) if x is None else len(order) + 16 + place(x) for x in node]
        if bits == 28:
            tree += (a & 0xFFFFFF).to_bytes(3, "big") + bytes([a >> 24 << 4 | b >> 24]) + (b & 0xFFFFFF).to_bytes(3, "big")
        else:
            tree += a.to_bytes(bits // 8, "big") + b.to_bytes(bits // 8, "big")
    about = {"node_count": len(order), "record_size": bits, "ip_version": version, "database_type": "test", "languages": ["en"], "binary_format_major_version": 2}
    path.write_bytes(bytes(tree) + bytes(16) + bytes(data) + MARK + value(about))


def nested(rng, kinds, n):
    out = {}
    while len(out) < n:
        k = rng.choice(kinds)
        width = 32 if k == 4 else 128
        base = rng.choice([p for p in out if p.version == k] or [None])
        length = rng.randrange(1, width + 1) if k == 4 else rng.randrange(20, 129)
        number = rng.getrandbits(width)
        if k == 6:
            number |= 1 << 125  # apart from the IPv4 part
        if base is not None and base.prefixlen < length and rng.random() < 0.7:
            number = int(base.network_address) | number & (1 << (width - base.prefixlen)) - 1
        net = (ipaddress.IPv4Network if k == 4 else ipaddress.IPv6Network)((number, length), strict=False)
        out[net] = {"country": {"iso_code": f"C{len(out)}", "n": len(out)}, "flag": len(out) % 2 == 0, "share": len(out) / 7, "list": [1, "x" * (len(out) % 40)]}
    return list(out.items())


@pytest.mark.parametrize("bits,version", [(24, 6), (28, 6), (32, 6), (24, 4), (28, 4), (32, 4)])
def test_against_a_linear_scan(tmp_path, bits, version):
    rng = random.Random(bits * version)
    prefixes = nested(rng, [4, 6] if version == 6 else [4], 150)
    path = tmp_path / "t.mmdb"
    write(path, prefixes, bits, version)
    trie = mmdb.Trie(str(path))
    asked = []
    for net, _ in prefixes:
        asked += [net.network_address, net.broadcast_address, net.network_address + rng.randrange(net.num_addresses)]
    asked += [ipaddress.ip_address(rng.getrandbits(32)) for _ in range(100)] + [ipaddress.ip_address(rng.getrandbits(128) | 1 << 125) for _ in range(50)]
    got = trie.find([mmdb.packed(str(a)) for a in asked])
    for a, at in zip(asked, got):
        fits = [(n.prefixlen, r) for n, r in prefixes if n.version == a.version and a in n]
        want = max(fits, key=lambda x: x[0])[1] if fits else None
        assert (trie.record(int(at)) if at else None) == (want and want | {"shared": "Shared Name"}), a


def test_enrichment_by_file(spark, tmp_path):
    nets = [(ipaddress.ip_network("203.0.113.0/24"), {"country": {"iso_code": "US"}}), (ipaddress.ip_network("203.0.113.8/29"), {"country": {"iso_code": "CN"}}), (ipaddress.ip_network("2001:db8::/32"), {"country": {"iso_code": "VN"}}), (ipaddress.ip_network("10.0.0.0/8"), {"city": "none"})]
    write(tmp_path / "country.mmdb", nets, 24, 6)
    write(tmp_path / "network.mmdb", [(nets[0][0], {"autonomous_system_organization": "Example Net"})], 28, 4)
    ips = ["203.0.113.9", "203.0.113.77", "2001:db8::5", "10.1.1.1", "8.8.8.8", "junk", "", None, "203.0.113.9"]
    logs = spark.createDataFrame([(i, ip, "m") for i, ip in enumerate(ips)], "row_id long, source_ip string, message string").repartition(3)
    out = api.enrich(logs, country_file=str(tmp_path / "country.mmdb"), network_file=str(tmp_path / "network.mmdb")).orderBy("row_id").collect()
    assert [r.geoip_country for r in out] == ["CN", "US", "VN", None, None, None, None, None, "CN"]
    assert [r.asn_org for r in out] == ["Example Net", "Example Net", None, None, None, None, None, None, "Example Net"]


def test_what_is_no_such_file_raises(tmp_path):
    (tmp_path / "x").write_bytes(b"0" * 500)
    with pytest.raises(ValueError):
        mmdb.Trie(str(tmp_path / "x"))
