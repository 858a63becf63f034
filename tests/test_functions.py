"""Column functions against worked examples."""

import pytest
from pyspark.sql import functions as F

from evigrid.functions import classify, extract, kernels, normalize


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


NORMAL = [
    ("domain", "https://example.com/path", "example.com"), ("domain", "café.com", "xn--caf-dma.com"), ("domain", "WWW.Example.com.", "example.com"), ("phone", "+1 415-555-2671", "+14155552671"), ("phone", "(415) 555-2671", "+14155552671"), ("phone", "0044 20 79460958", "+442079460958"),
    ("hash", "sha256:abcdef1234", "ABCDEF1234"), ("md5", "  AB-CD-EF  ", "ABCDEF"), ("ip", "2001:0db8:0000:0000:0000:0000:0000:0001", "2001:db8::1"), ("ip", "1.2.3.4:80", "1.2.3.4"), ("ip", "[::1]:80", "::1"), ("ip", "not-an-ip", "not-an-ip"),
    ("url", "https://example.com:443/path", "https://example.com/path"), ("url", "HTTPS://Example.com/path/", "https://example.com/path"), ("url", "example.com", "https://example.com/"), ("url", "http://u:p@h.com:8080/a?q=1#f", "http://h.com:8080/a?q=1"), ("cve", "CVE2021-1234", "CVE-2021-1234"), ("asn", "AS012345", "AS12345"), ("mac", "aa-bb-cc-dd-ee-ff", "AA:BB:CC:DD:EE:FF"), ("mac", "aaaa.bbbb.cccc", "AAAA:BBBB:CCCC"),
    ("email", " mailto:A B@X.org ", "ab@x.org"), ("username", "@@Some.One ", "some.one"), ("vat", "eu de123", "DE123"), ("iban", "de89 3704", "DE893704"), ("user_agent", " a \t b ", "a b"), ("wallet", " 1AbC ", "1AbC"), ("other", " x ", "x"), ("email", None, ""),
]


def test_normalize(spark):
    df = spark.createDataFrame([(i, k, v) for i, (k, v, _) in enumerate(NORMAL)], "i int, k string, v string")
    got = {r.i: r.n for r in df.select("i", normalize.normalize(F.col("k"), F.col("v")).alias("n")).collect()}
    assert [got[i] for i in range(len(NORMAL))] == [w for *_, w in NORMAL]


KINDS = {
    "+44 20 7946 0958": "phone", "14155552671": "phone", "https://i.imgur.com/abc123.png": "image", "https://imgur.com/x": "image", "https://a.b/c?x=.png": "url", "John Smith": "person", "a": "unknown", "1.2.3.4": "ip", "a@b.co": "email", "0x" + "a" * 40: "crypto", "aa:bb:cc:dd:ee:ff": "mac", "@handle": "username", "vitalik.eth": "ens",
    "npub1" + "q" * 10: "npub", "DE123456789": "vat", "GB29NWBK60161331926819": "iban", "1HGCM82633A004352": "vin", "d" * 32: "hash", "flight:BA123": "flight", "example.com": "domain", "some_user": "username", "": "unknown",
}


def test_classify(spark):
    df = spark.createDataFrame(list(KINDS.items()), "t string, want string")
    assert df.withColumn("got", classify.classify(F.col("t"))).where("got <> want").collect() == []


def test_extract(spark):
    text = "See 8.8.8.8 and http://a.example.net/x?y=1, mail x@y.org or X@Y.org; CVE-2021-1234 cve-2021-1234, AS123, port 8080, 10.0.0.0/8, example.com"
    found = extract.entities(spark.createDataFrame([(1, text), (2, None)], "id long, t string"), "t", ["id"])
    by = {}
    for r in found.collect():
        by.setdefault(r.type, []).append(r.value)
        assert r.value in r.context
    assert by["ipv4"] == ["8.8.8.8", "10.0.0.0"] and by["cve"] == ["CVE-2021-1234", "cve-2021-1234"] and by["asn"] == ["AS123"]
    assert "example.com" not in by["domain"] and by["cidr"] == ["10.0.0.0/8"] and by["port"] == ["port 8080"]
    assert extract.first_by_value(found, ["id"]).where("type = 'cve'").count() == 1


@pytest.mark.parametrize(("url", "safe"), [("http://169.254.169.254/", False), ("http://127.0.0.1", False), ("http://10.1.2.3", False), ("http://172.16.0.1", False), ("http://192.168.1.1", False), ("file:///x", False), ("ftp://a.b", False), ("", False), ("https://8.8.8.8/", True), ("http://localhost/", False), ("https://a.org", True)])
def test_url_safety(spark, url, safe):
    assert one(spark, url, kernels.is_public_url) is safe


def test_kernels(spark):
    assert one(spark, "GB82 WEST 1234 5698 7654 32", kernels.iban_valid) is True
    assert one(spark, "GB82 WEST 1234 5698 7654 33", kernels.iban_valid) is False
    assert one(spark, "abc", kernels.checksum8) == (97 + 98 + 99) % 256
    got = one(spark, "ab.com", kernels.typosquats)
    assert [x["variant"] for x in got][:2] == ["b.com", "a.com"] and len(got) == 50 and len({x["variant"] for x in got}) == 50
    assert one(spark, "First.Last9", kernels.username_variants)[:3] == ["first.last9", "firstlast9", "first_last9"]
    assert one(spark, ["Emails", "Password hash"], kernels.severity_of, "array<string>") == "critical"
    assert one(spark, "0xde0b6b3a7640000", kernels.wei_to_eth) == 1.0
    assert one(spark, "bc1qxyz", kernels.crypto_currency) == "BTC"
    assert one(spark, "02:00:5e:00:00:01", lambda c: F.struct(*kernels.mac_flags(c))) == ("02:00:5e", True, False)


def test_plugin_kernels(spark):
    from evigrid.functions import plugins

    r = one(spark, "User-agent: *\nDisallow: /a\nallow: /b\nDisallow: /c\nSitemap: https://x/s.xml", plugins.robots)
    assert (r.disallow, r.allow, r.sitemaps, r.n_disallow) == (["/a", "/c"], ["/b"], ["https://x/s.xml"], 2)
    assert one(spark, "*.b.com\na.com\n\nB.com", plugins.certificates) == ["a.com", "b.com"]
    r = one(spark, "2024-01-20", lambda c: plugins.tls(c.cast("date"), F.lit("2024-01-01").cast("date")))
    assert (r.days_remaining, r.expired, r.expires_soon) == (19, False, True)
    assert plugins.levels({"dns": set(), "bgp": {"dns"}, "geo": {"bgp", "dns"}}) == {"dns": 0, "bgp": 1, "geo": 2}


@pytest.mark.parametrize("wei", [0, 7, 10**18, 900_000 * 10**14, 2**64 + 5, 123456789 * 10**24, 2**256 - 1])
def test_wei_of_256_bits(spark, wei):
    assert one(spark, hex(wei), kernels.wei_to_eth) == pytest.approx(wei / 1e18, rel=1e-15)


@pytest.mark.parametrize("text", [None, "", "0x", "0xg", "0x" + 65 * "1"])
def test_wei_of_no_number(spark, text):
    assert one(spark, text, kernels.wei_to_eth) is None
