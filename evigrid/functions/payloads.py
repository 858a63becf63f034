"""What evidence sources compute from the fields of a payload, as column expressions.

Arguments are columns; arrays and maps may be null and then count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _array(items: Column) -> Column:
    return F.coalesce(items, F.array())


def _flag(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def _ladder(text: Column, table: tuple[tuple[tuple[str, ...], str], ...], other: str) -> Column:
    """Name of the first row of ``table`` one of whose words stands in the text."""
    out = F.lit(other)
    for words, name in reversed(table):
        out = F.when(_any_of(text, words), name).otherwise(out)
    return out


# --- networks and names


def bgp(peers: Column, upstreams: Column, exchanges: Column, asn_abuse: Column, found_abuse: Column) -> Column:
    """First peers, upstreams and exchanges of a network, the number of peers, and whom to write to:
    the contacts of its registration, or else those found for the address."""
    own = F.slice(_array(asn_abuse), 1, 3)
    return F.struct(
        F.slice(_array(peers), 1, 5).alias("peers"),
        F.size(_array(peers)).alias("peer_count"),
        F.slice(_array(upstreams), 1, 5).alias("upstreams"),
        F.slice(_array(exchanges), 1, 5).alias("exchanges"),
        F.when(F.size(own) > 0, own).otherwise(F.slice(_array(found_abuse), 1, 5)).alias("abuse_contacts"),
    )


#: Record types that are asked for (fixed values).
RECORD_TYPES = ("A", "AAAA", "MX", "NS", "TXT", "CNAME")


def dns_records(rows: DataFrame, key: str) -> DataFrame:
    """``(key, records, primary_ip)`` of ``(key, rtype, value, pos)``: values of each type in their
    order; names without any record are left out."""
    of_type = rows.where(F.col("rtype").isin(*RECORD_TYPES) & F.col("value").isNotNull()).groupBy(key, "rtype").agg(
        F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("v")
    )
    pairs = of_type.select(key, "rtype", F.transform("v", lambda x: x["value"]).alias("v"))
    found = pairs.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rtype", "v")))).alias("records"))
    return found.withColumn("primary_ip", F.get(F.try_element_at("records", F.lit("A")), 0))


def dnssec(keys: Column, ds: Column, signatures: Column, validated: Column) -> Column:
    has = lambda c: F.size(_array(c)) > 0
    return F.struct(
        (has(keys) | has(signatures)).alias("enabled"), has(keys).alias("has_dnskey"), has(ds).alias("has_ds"), has(signatures).alias("has_rrsig"),
        _flag(validated).alias("validated"), F.size(_array(keys)).alias("dnskey_count"), F.size(_array(ds)).alias("ds_count"),
    )


def whois(registrars: Column, created: Column, expires: Column, servers: Column, emails: Column) -> Column:
    """Of fields that a registry may give several times: the first; servers in lower case; each address once."""
    first = lambda c: F.get(_array(c), 0)
    return F.struct(
        first(registrars).alias("registrar"), first(created).alias("created"), first(expires).alias("expires"),
        F.transform(_array(servers), F.lower).alias("name_servers"), F.array_distinct(_array(emails)).alias("emails"),
    )


#: Field of an address lookup -> column here.
# Fixed values.
IP_FIELDS = {
    "query": "ip", "country": "country", "countryCode": "country_code", "regionName": "region", "city": "city", "lat": "latitude", "lon": "longitude", "timezone": "timezone", "isp": "isp",
    "org": "org", "as": "asn", "asname": "asn_name", "reverse": "reverse_dns", "mobile": "is_mobile", "proxy": "is_proxy", "hosting": "is_hosting", "continent": "continent",
}


def ip_location(data: Column) -> list[Column]:
    """Columns of an address lookup (VARIANT); all are null where it failed."""
    ok = F.coalesce(F.try_variant_get(data, "$.status", "string") != "fail", F.lit(True))
    kinds = {"latitude": "double", "longitude": "double", "is_mobile": "boolean", "is_proxy": "boolean", "is_hosting": "boolean"}
    return [F.when(ok, F.try_variant_get(data, f"$.{k}", kinds.get(v, "string"))).alias(v) for k, v in IP_FIELDS.items()]


def lines(text: Column, most: int = 50) -> Column:
    """``(lines, n)`` of a plain-text answer: trimmed, without empty ones, the first ``most``; none of an error."""
    each = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    kept = F.when(F.contains(F.lower(text), F.lit("error")), F.slice(each, 1, 0)).otherwise(each)
    return F.struct(F.slice(kept, 1, most).alias("lines"), F.size(kept).alias("n"))


def address_history(html: Column, most: int = 10) -> Column:
    """``(ip, location, date)`` of the rows of a history table, the first ``most``."""
    row = r"(?s)<td>(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})</td>.*?<td>([^<]+)</td>.*?<td>([^<]+)</td>"
    part = lambda k: F.slice(F.transform(F.regexp_extract_all(html, F.lit(row), k), lambda x: F.trim(x)), 1, most)
    return F.arrays_zip(part(1).alias("ip"), part(2).alias("location"), part(3).alias("date"))


def onion(host: Column, status: Column, answers: Column) -> Column:
    """The hidden-service name of a host, whether a proxy reaches it (``status``: proxy -> code) and
    whether a search engine's answer names it."""
    name = F.split_part(host, F.lit("."), F.lit(1))
    reached = F.exists(F.map_values(F.coalesce(status, F.create_map().cast("map<string,int>"))), lambda s: s.between(200, 399))
    named = F.exists(F.map_values(F.coalesce(answers, F.create_map().cast("map<string,string>"))), lambda t: F.contains(F.lower(t), F.lower(name)))
    return F.struct(F.concat(name, F.lit(".onion")).alias("onion_domain"), _flag(reached).alias("onion_exists"), _flag(named).alias("is_indexed"))


# --- pages

#: Technology -> what of it stands in the lower-cased page.
# Fixed values.
PAGE_MARKS = {
    "WordPress": "wp-content",
    "Drupal": "drupal.settings",
    "Joomla": "/components/com_",
    "React": "react",
    "Next.js": "__next_data__",
    "Vue.js": "vue",
    "Angular": "ng-version",
    "Bootstrap": "bootstrap",
    "jQuery": "jquery",
    "Cloudflare": "cloudflare",
}
SECURITY_HEADERS = ("Strict-Transport-Security", "Content-Security-Policy", "X-Frame-Options", "X-Content-Type-Options")


def http_facts(body: Column, headers: Column) -> Column:
    """Title, description, technologies (servers first, then page marks, ten at most) and the security
    headers of a page. Header names are met as written or in lower case."""
    head, low = F.substring(body, 1, 5000), F.lower(F.substring(body, 1, 20000))
    header = lambda h: F.coalesce(
        F.nullif(F.try_element_at(headers, F.lit(h)), F.lit("")),
        F.nullif(F.try_element_at(headers, F.lit(h.lower())), F.lit("")),
    )
    strip = lambda c: F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))
    marks = [F.when(F.contains(low, F.lit(mark)), name) for name, mark in PAGE_MARKS.items()]
    techs = F.array_distinct(F.array_compact(F.array(header("Server"), header("X-Powered-By"), *marks)))
    found = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(h).alias("k"), header(h).alias("v")) for h in SECURITY_HEADERS)), lambda e: e["v"].isNotNull()))
    return F.struct(
        strip(F.regexp_extract(head, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        strip(F.regexp_extract(head, r"""(?i)<meta[^>]+name=["']description["'][^>]+content=["']([^"']+)["']""", 1)).alias("description"),
        F.slice(techs, 1, 10).alias("technologies"),
        found.alias("security_headers"),
    )


def without_tags(html: Column) -> Column:
    """Text of a fragment: tags off, white space run together."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", ""), r"\s+", " "))


def feed_items(text: Column, most: int = 10) -> Column:
    """``(title, url, date)`` of the items of an RSS answer, the first ``most``."""
    item = r"(?s)<item>.*?<title>(.*?)</title>.*?<link>(.*?)</link>.*?<pubDate>(.*?)</pubDate>.*?</item>"
    part = lambda k: F.slice(F.regexp_extract_all(text, F.lit(item), k), 1, most)
    title = F.transform(part(1), lambda x: F.substring(F.trim(F.regexp_replace(x, "<[^>]+>", "")), 1, 150))
    return F.arrays_zip(
        title.alias("title"), F.transform(part(2), lambda x: F.trim(x)).alias("url"),
        F.transform(part(3), lambda x: F.substring(F.trim(x), 1, 32)).alias("date"),
    )


def profile_slugs(text: Column, site: str = r"linkedin\.com/in/", most: int = 5) -> Column:
    """Names in profile links among the first ``most`` links, each once."""
    return F.array_distinct(F.slice(F.regexp_extract_all(text, F.lit(site + r"([a-zA-Z0-9\-]+)"), 1), 1, most))


def result_links(html: Column, domain: Column, most: int = 10) -> Column:
    """Links of a search answer: those of its results, else all that name the domain."""
    results = F.regexp_extract_all(html, F.lit(r'class="result__a"[^>]*href="([^"]+)"'), 1)
    rest = F.filter(F.regexp_extract_all(html, F.lit(r"""https?://[^\s"'<>]+"""), 0), lambda u: F.contains(u, domain))
    return F.slice(F.when(F.size(results) > 0, results).otherwise(rest), 1, most)


def searched_name(target: Column) -> Column:
    """The host or mail domain that searches are made for."""
    host = F.split_part(F.regexp_replace(target, "https?://", ""), F.lit("/"), F.lit(1))
    return F.split_part(host, F.lit("@"), F.lit(-1))


# Searches for exposed files, and for secrets in code.
WEB_SEARCHES = ("site:%s filetype:pdf", "site:%s filetype:xlsx", "site:%s filetype:doc", "site:%s inurl:admin", "site:%s inurl:login", "site:%s intitle:index.of")
CODE_SEARCHES = ('"%s" password', '"%s" api_key', '"%s" secret', '"%s" .env', '"%s" database_url')


def searches(target: Column, templates: tuple[str, ...]) -> Column:
    return F.array(*(F.format_string(t, searched_name(target)) for t in templates))


def sum_of(*counts: Column) -> Column:
    """A total in which what is missing counts as nothing."""
    total = F.lit(0).cast("long")
    for c in counts:
        total = total + F.coalesce(c.cast("long"), F.lit(0))
    return total


# --- mail

# Words in the names of mail servers and whose they are, in order; free mail providers.
MAIL_SERVERS = (
    (("google", "gmail"), "Google Workspace"),
    (("outlook", "microsoft", "exchange", "office365", "onmicrosoft"), "Microsoft 365"),
    (("amazon", "ses", "aws"), "Amazon SES"),
    (("sendgrid",), "SendGrid"),
    (("mailchimp", "mandrill"), "Mailchimp"),
    (("zoho",), "Zoho Mail"),
    (("protonmail",), "ProtonMail"),
    (("icloud", "apple"), "iCloud"),
    (("yandex",), "Yandex Mail"),
    (("mail.ru",), "Mail.ru"),
    (("qq.com", "tencent"), "Tencent/QQ Mail"),
)
FREE_PROVIDERS = {
    "gmail.com": "Google (Gmail)", "googlemail.com": "Google (Gmail)", "yahoo.com": "Yahoo Mail", "hotmail.com": "Microsoft (Hotmail)", "outlook.com": "Microsoft (Outlook)", "live.com": "Microsoft (Live)",
    "protonmail.com": "ProtonMail", "proton.me": "ProtonMail", "icloud.com": "Apple (iCloud)", "aol.com": "AOL Mail", "zoho.com": "Zoho Mail", "mail.com": "Mail.com", "gmx.com": "GMX",
    "yandex.com": "Yandex Mail", "tutanota.com": "Tutanota", "tuta.io": "Tutanota", "fastmail.com": "Fastmail", "hushmail.com": "Hushmail", "mail.ru": "Mail.ru", "qq.com": "QQ Mail",
}


def mail_profile(domain: Column, servers: Column) -> Column:
    """Mail servers by priority (``servers``: array of ``exchange``, ``priority``), whose they are, and
    whether the domain is a free provider."""
    by_priority = F.array_sort(F.transform(_array(servers), lambda s: F.struct(s["priority"].alias("priority"), F.rtrim(s["exchange"], F.lit(".")).alias("exchange"))))
    names = F.lower(F.array_join(F.transform(by_priority, lambda s: s["exchange"]), " "))
    free = F.try_element_at(F.create_map(*(F.lit(x) for kv in FREE_PROVIDERS.items() for x in kv)), F.lower(domain))
    provider = F.when(F.size(by_priority) == 0, "None").otherwise(_ladder(names, MAIL_SERVERS, "Self-hosted / Unknown"))
    return F.struct(by_priority.alias("records"), free.isNotNull().alias("is_free_provider"), F.coalesce(free, provider).alias("provider"))


def disposable(listed: Column, no_mx: Column, age_days: Column) -> Column:
    """Whether an address is thrown away after use: its domain is listed, or has no mail server and is
    under 30 days old (then with medium confidence). A listed domain's age is not looked at."""
    young = ~_flag(listed) & F.coalesce(age_days < 30, F.lit(False))
    both = _flag(no_mx) & young
    return F.struct(
        (_flag(listed) | both).alias("disposable"),
        F.when(both, "medium").otherwise("high").alias("confidence"),
        F.array_compact(
            F.array(F.when(_flag(listed), "domain_in_disposable_list"), F.when(_flag(no_mx), "no_mx_records"), F.when(young, "domain_age_under_30_days"))
        ).alias("signals"),
    )


def username_patterns(local: Column) -> Column:
    """``(username, type, confidence)`` that a mailbox name suggests."""
    guess = lambda name, kind, sure: F.struct(name.alias("username"), F.lit(kind).alias("type"), F.lit(sure).alias("confidence"))
    parts = F.split(local, r"\.")
    a, b = F.get(parts, 0), F.get(parts, 1)
    two = F.size(parts) == 2
    return F.array_compact(
        F.array(
            F.when(local.rlike("^[a-zA-Z0-9_]+$"), guess(local, "direct", "high")),
            F.when(two, guess(F.concat(a, b), "concatenated", "medium")),
            F.when(two, guess(F.concat(b, a), "reversed", "low")),
            F.when(two, guess(F.replace(local, F.lit("."), F.lit("_")), "underscore_variant", "medium")),
            F.when(F.contains(local, F.lit("+")), guess(F.split_part(local, F.lit("+"), F.lit(1)), "plus_addressing_base", "high")),
            F.when(local.rlike("[0-9]$"), guess(F.regexp_replace(local, "[0-9]+$", ""), "base_without_numbers", "medium")),
        )
    )


def addresses_at(text: Column, domain: Column) -> Column:
    """Mail addresses of a domain that a text names, each spelling once, in order of the alphabet."""
    found = F.regexp_extract_all(text, F.lit(r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"), 0)
    return F.array_sort(F.array_distinct(F.filter(found, lambda e: F.lower(e).endswith(F.concat(F.lit("@"), F.lower(domain))))))


def mail_risks(blacklisted: Column, leaked: Column, breached: Column, malicious: Column, spam: Column, throwaway: Column) -> Column:
    table = (
        (blacklisted, "blacklisted"), (_flag(leaked) | _flag(breached), "credentials leaked"),
        (malicious, "malicious activity"), (spam, "spam sender"), (throwaway, "disposable email"),
    )
    return F.array_compact(F.array(*(F.when(_flag(c), name) for c, name in table)))


def mail_digests(address: Column) -> Column:
    low = F.lower(F.trim(address))
    return F.struct(F.md5(low).alias("md5"), F.sha1(low).alias("sha1"))


def breach_risk(listed: Column, breached: Column, leaked: Column, suspicious: Column) -> Column:
    """``(breach_found, risk_level)`` from what several sources say of an address."""
    found = _flag(listed) | _flag(breached) | _flag(leaked)
    return F.struct(
        found.alias("breach_found"),
        F.when(_flag(leaked), "Critical").when(found, "High").when(_flag(suspicious), "Medium").otherwise("Low").alias("risk_level"),
    )


def exposure_band(n: Column) -> Column:
    return F.when(n >= 10, "high").when(n >= 5, "moderate").when(n >= 1, "low")


def spf_mechanisms(record: Column) -> Column:
    """``(mechanism, qualifier, value)`` of an SPF record; no qualifier means ``+``."""
    word = lambda p: F.regexp_replace(p, "^[-+~?]", "")
    qualifier = lambda p: F.coalesce(F.nullif(F.regexp_extract(p, "^([-+~?])", 1), F.lit("")), F.lit("+"))
    parts = F.filter(F.slice(F.split(F.trim(record), r"\s+"), 2, 1 << 20), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            F.split_part(word(p), F.lit(":"), F.lit(1)).alias("mechanism"), qualifier(p).alias("qualifier"), F.when(
                F.contains(p, F.lit(":")), F.regexp_replace(p, "^[^:]*:", ""),
            ).alias("value")
        ),
    )


def dmarc_tag(record: Column, tag: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(record, rf"(?:^|;)\s*{tag}=([^;]*)", 1)), F.lit(""))


def mail_security(spf: Column, dmarc: Column, selectors: Column, has_mx: Column, listings: Column) -> Column:
    """``(score, grade)`` of a mail domain: 100 less what is missing or loose, 0 to 100.

    ``spf`` and ``dmarc`` are arrays of TXT records, ``selectors`` those with a key, ``listings``
    the number of block lists that name the domain's address.
    """
    records = F.filter(_array(spf), lambda r: r.startswith("v=spf1"))
    first = F.get(records, 0)
    loose = F.when(F.contains(first, F.lit("+all")), 40).when(F.contains(first, F.lit("?all")) | F.contains(first, F.lit("~all")), 10).otherwise(0)
    of_spf = F.when(F.size(records) == 0, 30).otherwise(loose + F.when(F.size(records) > 1, 10).otherwise(0))
    policy = dmarc_tag(F.get(F.filter(_array(dmarc), lambda r: r.startswith("v=DMARC1")), 0), "p")
    none = F.size(F.filter(_array(dmarc), lambda r: r.startswith("v=DMARC1"))) == 0
    of_dmarc = F.when(none, 25).when(policy == "none", 10).when(policy.isin("quarantine", "reject"), -5).otherwise(0)
    off = of_spf + of_dmarc + F.when(F.size(_array(selectors)) == 0, 15).otherwise(0) + F.when(_flag(has_mx), 0).otherwise(20) + 20 * F.coalesce(listings, F.lit(0))
    score = F.greatest(F.lit(0), F.least(F.lit(100), 100 - off))
    return F.struct(score.alias("score"), F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F").alias("grade"))


def mailbox_verdict(code: Column) -> Column:
    """``(exists, status)`` from a mail server's answer to a recipient."""
    return F.struct(
        F.when(code.startswith("2"), True).when(code.startswith("5"), False).alias("exists"),
        F.when(code.startswith("2"), "mailbox_exists").when(code.startswith("5"), "mailbox_not_found").otherwise("indeterminate").alias("status"),
    )


def phone_risks(line_type: Column, valid: Column) -> Column:
    table = ((line_type == "VoIP", "voip"), (line_type == "Premium Rate", "premium rate"), (line_type == "Toll Free", "toll-free"), (~_flag(valid), "may not be valid"))
    return F.array_compact(F.array(*(F.when(_flag(c), name) for c, name in table)))


# --- accounts


def federated_handle(target: Column, instance: str = "mastodon.social") -> Column:
    """``(user, instance)`` of a handle; null where it is none."""
    t = F.trim(target)
    whole = r"^@?([A-Za-z0-9_]+)@([A-Za-z0-9.\-]+)$"
    bare = F.ltrim(t, F.lit("@"))
    plain = F.struct(bare.alias("user"), F.lit(instance).alias("instance"))
    found = F.struct(F.regexp_extract(t, whole, 1).alias("user"), F.regexp_extract(t, whole, 2).alias("instance"))
    return F.when(t.rlike(whole), found).when((bare != "") & ~bare.rlike("[/ ]"), plain)


def is_nostr_key(target: Column) -> Column:
    return F.trim(target).startswith("npub1") & (F.length(F.trim(target)) > 10)


# Categories of platforms; of these, all others are "Other".
PLATFORM_CATEGORIES = {
    "Tech & Dev": ("GitHub", "GitLab", "HackerNews", "StackOverflow", "ProductHunt", "Keybase", "Dev.to", "Replit", "CodePen"),
    "Creative": ("DeviantArt", "Behance", "Dribbble", "ArtStation", "Flickr", "SoundCloud", "Spotify", "Bandcamp", "Mixcloud"),
    "Gaming": ("Steam", "Xbox", "PSN", "Roblox"),
    "Commerce": ("Etsy", "Patreon", "Fiverr", "Upwork"),
    "Social Media": (
        "Twitter/X", "Instagram", "Reddit", "TikTok", "YouTube", "Twitch", "Pinterest", "Tumblr", "Medium",
        "Quora", "LinkedIn", "Snapchat", "Telegram", "VK", "Ask.fm", "Wattpad",
    ),
}


def platform_category(platform: Column) -> Column:
    out = F.lit("Other")
    for name, members in PLATFORM_CATEGORIES.items():
        out = F.when(platform.isin(*members), name).otherwise(out)
    return out


def account_found(method: Column, status: Column, body: Column, absent: Column) -> Column:
    """Whether a platform has the account: by its answer's status, unless the page says that there is none."""
    says_none = F.coalesce(F.contains(body, absent), F.lit(False))
    ok = F.when(method == "status_not_404", ~status.isin(404, 410)).otherwise(status == 200)
    return F.coalesce(ok, F.lit(False)) & ~says_none


def accounts_by_category(found: DataFrame, key: str) -> DataFrame:
    """``(key, category, platforms)`` of the ``(key, platform)`` that were found."""
    return found.groupBy(key, platform_category(F.col("platform")).alias("category")).agg(F.array_sort(F.collect_set("platform")).alias("platforms"))


def cross_platform(profiles: DataFrame, key: str) -> DataFrame:
    """``(key, emails, locations, names, platforms)``: what all profiles of a user say, each value once, sorted."""
    some = lambda c: F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit(""))))
    return profiles.groupBy(key).agg(some("email").alias("emails"), some("location").alias("locations"), some("name").alias("names"), some("platform").alias("platforms"))


def posts(reddit: Column, github: Column, hackernews: Column) -> Column:
    """Total of posts and the platforms that know the user; each argument has ``found`` and ``n``."""
    each = (("reddit", reddit), ("github", github), ("hackernews", hackernews))
    return F.struct(
        sum_of(*(c["n"] for _, c in each)).alias("total_posts"),
        F.array_compact(F.array(*(F.when(_flag(c["found"]), name) for name, c in each))).alias("platforms_found"),
    )


def registered(sites: Column) -> Column:
    """``(registered_on, registered_count, sites_checked)`` of an array of ``site``, ``found``."""
    on = F.transform(F.filter(_array(sites), lambda s: _flag(s["found"])), lambda s: s["site"])
    return F.struct(on.alias("registered_on"), F.size(on).alias("registered_count"), F.size(_array(sites)).alias("sites_checked"))


# --- threat and reference sources


def threats(urlhaus: Column, online: Column, phishing: Column, tor: Column, spamhaus: Column, dbl: Column, abuse: Column) -> Column:
    """Threats that reputation sources name: ``urlhaus`` is a listed threat or null, ``online`` the number of
    bad urls on the host, ``spamhaus`` the lists that name it, ``abuse`` a confidence in percent."""
    return F.array_compact(
        F.array(
            F.when(urlhaus.isNotNull(), F.concat(F.lit("urlhaus: "), urlhaus)),
            F.when(online > 0, F.concat(F.lit("urlhaus host: "), online, F.lit(" online"))),
            F.when(_flag(phishing), "phishtank: confirmed"),
            F.when(_flag(tor), "tor exit node"),
            F.when(F.size(_array(spamhaus)) > 0, F.concat(F.lit("spamhaus: "), F.upper(F.array_join(spamhaus, ", ")))),
            F.when(_flag(dbl), "spamhaus dbl"),
            F.when(abuse > 25, F.concat(F.lit("abuseipdb: "), abuse, F.lit("%"))),
        )
    )


def engine_summary(malicious: Column, harmless: Column, suspicious: Column, undetected: Column) -> Column:
    """``(total, summary)`` of scan engines' verdicts."""
    total = sum_of(malicious, harmless, suspicious, undetected)
    bad = F.coalesce(malicious, F.lit(0))
    return F.struct(
        total.alias("total"),
        F.when(total == 0, "no analysis available").when(
            bad > 0, F.format_string("%d/%d flagged malicious", bad, total),
        ).otherwise(F.format_string("0/%d malicious", total)).alias("summary"),
    )


def scans(rows: DataFrame, key: str) -> DataFrame:
    """``(key, total, malicious)`` of ``(key, malicious)`` verdicts."""
    return rows.groupBy(key).agg(F.count("*").alias("total"), F.count_if(_flag(F.col("malicious"))).alias("malicious"))


def sanctions(datasets: Column) -> Column:
    """``(found, matches, sources)`` of the datasets of each match."""
    names = F.filter(F.flatten(_array(datasets)), lambda d: F.coalesce(d != "", F.lit(False)))
    return F.struct((F.size(_array(datasets)) > 0).alias("found"), F.size(_array(datasets)).alias("matches"), F.array_sort(F.array_distinct(names)).alias("sources"))


def pulse_references(references: Column, pulses: int = 5, most: int = 10) -> Column:
    """References of the first pulses, each once in their order, ``most`` in all."""
    all_ = F.flatten(F.transform(F.slice(_array(references), 1, pulses), lambda r: F.coalesce(r, F.array().cast("array<string>"))))
    return F.slice(F.array_distinct(F.filter(all_, lambda r: F.coalesce(r != "", F.lit(False)))), 1, most)


def news_rollup(articles: DataFrame, key: str, most: int = 5) -> DataFrame:
    """``(key, total, languages, top_domains)`` of ``(key, domain, language, pos)``: articles by language, and the
    domains with most articles, of equal ones that met first."""
    a = articles.withColumn("language", F.lower(F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit("unknown"))))
    by_language = a.groupBy(key, "language").agg(F.count("*").alias("n")).groupBy(key).agg(
        F.sum("n").alias("total"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("languages"),
    )
    by_domain = a.where("domain <> ''").groupBy(key, "domain").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    ranked = by_domain.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "first", "domain", "n"))), 1, most).alias("r"))
    tops = ranked.select(key, F.transform("r", lambda x: F.struct(x["domain"].alias("domain"), x["n"].alias("count"))).alias("top_domains"))
    return by_language.join(tops, key, "left").withColumn("top_domains", F.coalesce("top_domains", F.array().cast("array<struct<domain:string,count:bigint>>")))


# --- ledgers


def address_totals(chain: Column, pending: Column) -> Column:
    """Satoshis received, sent and left, and transactions; both arguments have ``funded``, ``spent``, ``txs``."""
    total = lambda f: sum_of(chain[f], pending[f])
    left = total("funded") - total("spent")
    return F.struct(
        total("funded").alias("received"), total("spent").alias("sent"), left.alias("balance"),
        (left / 1e8).alias("balance_btc"), total("txs").alias("tx_count"),
    )


def net_values(address: Column, txs: Column, most: int = 5) -> Column:
    """What each of the first transactions (``ins`` and ``outs`` of ``address``, ``value``) brought the address."""
    of = lambda side: F.aggregate(
        F.filter(_array(side), lambda x: x["address"] == address), F.lit(0).cast("long"), lambda s,
        x: s + x["value"].cast("long"),
    )
    return F.transform(F.slice(_array(txs), 1, most), lambda t: of(t["outs"]) - of(t["ins"]))


# --- flights

#: Place of each field in a state vector (fixed values).
STATE_FIELDS = {"icao24": 0, "callsign": 1, "origin_country": 2, "last_contact": 4, "longitude": 5, "latitude": 6, "baro_altitude": 7, "on_ground": 8, "velocity": 9, "geo_altitude": 13}


def callsign(target: Column) -> Column:
    """The call sign that a target names, with or without a prefix; null if it is none."""
    code = F.regexp_replace(F.upper(F.replace(F.trim(target), F.lit(" "), F.lit(""))), "^(FLIGHT|CALLSIGN):", "")
    return F.when(code.rlike(r"^[A-Z]{2}\d{1,5}$"), code)


def flight_states(targets: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """``(key, callsign, icao24, origin_country, longitude, latitude, altitude, velocity, on_ground, last_seen)``
    of the targets that fly: the first state vector with the call sign.

    ``targets`` has the key and ``target``; ``states`` ``(pos, vector array<string>)``. Altitude is the
    barometric one, or else the geometric one. Vectors are reduced to one a call sign before the join.
    """
    at = lambda name, kind="string": F.get("v", F.lit(STATE_FIELDS[name])).try_cast(kind)
    named = states.select("pos", F.col("vector").alias("v"), F.upper(F.trim(F.get("vector", F.lit(1)))).alias("callsign")).where("callsign <> ''")
    first = named.groupBy("callsign").agg(F.min_by("v", "pos").alias("v"))
    found = targets.select(key, callsign(F.col("target")).alias("callsign")).join(first, "callsign")
    return found.select(
        key, "callsign", at("icao24").alias("icao24"), at("origin_country").alias("origin_country"), at("longitude", "double").alias("longitude"), at("latitude", "double").alias("latitude"),
        F.coalesce(at("baro_altitude", "double"), at("geo_altitude", "double")).alias("altitude"), at("velocity", "double").alias("velocity"),
        F.coalesce(at("on_ground", "boolean"), F.lit(False)).alias("on_ground"), at("last_contact", "long").alias("last_seen"),
    )
