"""Payload kernels over fields made from the input tables; the SQL states each rule anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.functions import kernels, payloads, plugins
from evigrid.queries.registry import query
from evigrid.session import table
from evigrid.sources.canonical import EV, evidence


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name", F.col("c_custkey").cast("int").alias("k"))


_C = "c AS (SELECT c_custkey, c_nationkey, c_name, c_custkey::INT AS k FROM customer)"


@query("""
WITH p AS (SELECT s_nationkey AS n, list_sort(list(s_suppkey)) AS peers FROM supplier GROUP BY 1),
u AS (SELECT a.n_nationkey AS n, list_sort(list(b.n_nationkey)) AS ups FROM nation a JOIN nation b USING (n_regionkey) GROUP BY 1)
SELECT n_nationkey, coalesce(peers, [])[1:5] AS peers, len(coalesce(peers, []))::INT AS peer_count, ups[1:5] AS upstreams,
  CASE WHEN n_nationkey % 2 = 0 THEN ['a', 'b', 'c'] ELSE ['p', 'q', 'r', 's', 't'] END AS abuse_contacts
FROM nation LEFT JOIN p ON p.n = n_nationkey JOIN u ON u.n = n_nationkey""")
def network_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as networks, suppliers as peers, nations of the region as upstreams."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    peers = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list("s_suppkey")).alias("p"))
    ups = n.join(n.select("n_regionkey", F.col("n_nationkey").alias("u")), "n_regionkey").groupBy("n_nationkey").agg(F.array_sort(F.collect_list("u")).alias("u"))
    own = F.when(F.col("n_nationkey") % 2 == 0, F.array(*map(F.lit, "abcd")))
    found = payloads.bgp(F.col("p"), F.col("u"), F.lit(None).cast("array<string>"), own, F.array(*map(F.lit, "pqrstuv")))
    df = n.select("n_nationkey").join(peers, "n_nationkey", "left").join(ups, "n_nationkey").select("n_nationkey", found.alias("f"))
    return df.select("n_nationkey", "f.peers", "f.peer_count", "f.upstreams", "f.abuse_contacts")


@query(f"""
WITH {EV}, r AS (SELECT user_id, event_id, k, CASE event_type WHEN 'purchase' THEN 'A' WHEN 'signup' THEN 'MX' WHEN 'click' THEN 'NS' WHEN 'view' THEN 'TXT' ELSE 'SOA' END AS t FROM ev)
SELECT user_id, len(list(DISTINCT t) FILTER (t <> 'SOA'))::INT AS n_types, list(k::VARCHAR ORDER BY event_id) FILTER (t = 'A') AS a_records, arg_min(k::VARCHAR,
  event_id) FILTER (t = 'A') AS primary_ip
FROM r GROUP BY user_id HAVING bool_or(t <> 'SOA')""")
def dns_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of a name; one type is not asked for."""
    kind = F.expr("CASE event_type WHEN 'purchase' THEN 'A' WHEN 'signup' THEN 'MX' WHEN 'click' THEN 'NS' WHEN 'view' THEN 'TXT' ELSE 'SOA' END")
    rows = evidence(spark, sf_dir).select("user_id", kind.alias("rtype"), F.col("k").cast("string").alias("value"), F.col("event_id").alias("pos"))
    return payloads.dns_records(rows, "user_id").select(
        "user_id", F.size("records").alias("n_types"),
        F.try_element_at("records", F.lit("A")).alias("a_records"), "primary_ip",
    )


@query(f"""WITH {_C} SELECT c_custkey, k % 3 > 0 OR k % 4 > 0 AS enabled, k % 3 > 0 AS has_dnskey, k % 2 > 0 AS has_ds, k % 4 > 0 AS has_rrsig, coalesce(k % 5 = 0, false) AS validated,
  k % 3 AS dnskey_count, k % 2 AS ds_count FROM c""")
def dnssec_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10."""
    some = lambda m: F.array_repeat(F.lit("r"), F.col("k") % m)
    return _customers(spark, sf_dir).select("c_custkey", payloads.dnssec(some(3), some(2), some(4), F.col("k") % 5 == 0).alias("f")).select("c_custkey", "f.*")


@query(f"""WITH {_C} SELECT c_custkey, CASE WHEN k % 4 > 0 THEN 'reg' || (k % 4) END AS registrar, ['ns1.' || lower(c_name), 'ns2.' || lower(c_name)] AS name_servers,
  CASE WHEN k % 2 = 0 THEN ['a@x.org'] ELSE ['a@x.org', 'b' || k || '@x.org'] END AS emails FROM c""")
def registry_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry that repeats itself."""
    names = F.array(F.concat(F.lit("NS1."), "c_name"), F.concat(F.lit("ns2."), "c_name"))
    mails = F.expr("CASE WHEN k % 2 = 0 THEN array('a@x.org', 'a@x.org') ELSE array('a@x.org', concat('b', k, '@x.org'), 'a@x.org') END")
    regs = F.expr("CASE WHEN k % 4 > 0 THEN array(concat('reg', k % 4), 'other') END")
    none = F.lit(None).cast("array<string>")
    return _customers(spark, sf_dir).select(
        "c_custkey", payloads.whois(regs, none, none, names, mails).alias("f"),
    ).select("c_custkey", "f.registrar", "f.name_servers", "f.emails")


@query(f"""WITH {_C} SELECT c_custkey, CASE WHEN k % 7 > 0 THEN 'Country ' || c_nationkey END AS country, CASE WHEN k % 7 > 0 THEN k / 4.0::DOUBLE END AS latitude,
  CASE WHEN k % 7 > 0 THEN 'AS' || k END AS asn, CASE WHEN k % 7 > 0 THEN k % 2 = 0 END AS is_proxy FROM c""")
def ip_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups as JSON, of which one in seven failed."""
    text = F.to_json(
        F.struct(
            F.expr("IF(k % 7 = 0, 'fail', 'success')").alias("status"), F.concat(F.lit("Country "), "c_nationkey").alias("country"), (F.col("k") / 4.0).alias("lat"),
            F.concat(F.lit("AS"), "k").alias("as"), (F.col("k") % 2 == 0).alias("proxy"),
        )
    )
    df = _customers(spark, sf_dir).select("c_custkey", F.parse_json(text).alias("data"))
    return df.select("c_custkey", *payloads.ip_location(F.col("data"))).select("c_custkey", "country", "latitude", "asn", "is_proxy")


@query(r"""
WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\r\n|[\n\r]'), lambda x: regexp_replace(x,
  '^[ \t\n\f\r\v]+|[ \t\n\f\r\v]+$', '', 'g')), lambda x: x <> '') AS v FROM documents),
k AS (SELECT doc_id, CASE WHEN contains(lower(coalesce(text, '')), 'error') THEN [] ELSE v END AS v FROM l)
SELECT doc_id, len(v)::INT AS n_lines, md5(array_to_string(v[1:50], '|')) AS digest FROM k""")
def answer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as plain-text answers."""
    f = payloads.lines(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", f["n"].alias("n_lines"), F.md5(F.array_join(f["lines"], "|")).alias("digest"))


@query(f"WITH {_C} SELECT c_custkey, 'host' || k || '.onion' AS onion_domain, k % 3 = 0 AS onion_exists, k % 4 = 0 AS is_indexed FROM c")
def onion_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P41."""
    status = F.create_map(F.lit("a"), F.lit(404), F.lit("b"), F.expr("IF(k % 3 = 0, 302, 500)"))
    answers = F.create_map(F.lit("x"), F.lit("nothing"), F.lit("y"), F.expr("IF(k % 4 = 0, concat('see HOST', k, ' here'), 'no')"))
    return _customers(spark, sf_dir).select(
        "c_custkey",
        payloads.onion(F.concat(F.lit("host"), "k", F.lit(".example.org")), status, answers).alias("f"),
    ).select("c_custkey", "f.*")


_MARKS = (
    ("WordPress", "wp-content"), ("Drupal", "drupal.settings"), ("Joomla", "/components/com_"), ("React", "react"), ("Next.js", "__next_data__"),
    ("Vue.js", "vue"), ("Angular", "ng-version"), ("Bootstrap", "bootstrap"), ("jQuery", "jquery"), ("Cloudflare", "cloudflare"),
)


@query(rf"""
WITH p AS (SELECT page_id, substr(html, 1, 5000) AS head, lower(substr(html, 1, 20000)) AS low, CASE page_id % 3 WHEN 0 THEN 'nginx' WHEN 1 THEN 'React' END AS server FROM pages),
t AS (SELECT *, list_filter([server, {", ".join(f"CASE WHEN contains(low, '{m}') AND NOT coalesce(server = '{n}', false) THEN '{n}' END" for n, m in _MARKS)}],
  lambda x: x IS NOT NULL)[1:10] AS technologies FROM p)
SELECT page_id, nullif(trim(regexp_extract(head, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, technologies, CASE WHEN page_id % 2 = 0 THEN 'DENY' END AS frame_options FROM t""")
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, technologies and security headers; headers come from the page's number."""
    pairs = F.array(
        F.struct(F.lit("Server").alias("k"), F.expr("CASE page_id % 3 WHEN 0 THEN 'nginx' WHEN 1 THEN 'React' ELSE '' END").alias("v")),
        F.struct(F.lit("x-frame-options").alias("k"), F.expr("IF(page_id % 2 = 0, 'DENY', '')").alias("v")),
    )
    f = payloads.http_facts(F.col("html"), F.map_from_entries(pairs))
    df = table(spark, sf_dir, "pages").select("page_id", f.alias("f"))
    return df.select("page_id", "f.title", "f.technologies", F.try_element_at("f.security_headers", F.lit("X-Frame-Options")).alias("frame_options"))


@query(rf"""WITH {_C} SELECT c_custkey, 'T' || k AS title, 'http://n.example/' || k AS url, 'Mon, 01 Jan 2024 00:00:0' || (k % 10) AS date FROM c
UNION ALL SELECT c_custkey, 'Second', 'u', 'd' FROM c WHERE k % 2 = 0""")
def news_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of RSS answers."""
    one = "concat('<item><x/><title> <b>T', k, '</b></title>\n<link> http://n.example/', k, ' </link><pubDate>Mon, 01 Jan 2024 00:00:0', k % 10, '</pubDate></item>')"
    text = F.expr(f"concat('<rss>', {one}, IF(k % 2 = 0, '<item><title>Second</title><link>u</link><pubDate>d</pubDate></item>', ''), '</rss>')")
    return _customers(spark, sf_dir).select("c_custkey", F.inline(payloads.feed_items(text)))


@query(f"""WITH {_C}, n AS (SELECT c_custkey, CASE WHEN k % 2 = 0 THEN 'mail' || k || '.example.org' ELSE 'host' || k || '.example.com' END AS d FROM c)
SELECT c_custkey, unnest(['site:' || d || ' filetype:pdf', 'site:' || d || ' filetype:xlsx', 'site:' || d || ' filetype:doc', 'site:' || d || ' inurl:admin',
  'site:' || d || ' inurl:login', 'site:' || d || ' intitle:index.of',
  '"' || d || '" password', '"' || d || '" api_key', '"' || d || '" secret', '"' || d || '" .env', '"' || d || '" database_url']) AS search FROM n""")
def exposure_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches for hosts and mail domains."""
    target = F.expr("IF(k % 2 = 0, concat('u@mail', k, '.example.org'), concat('https://host', k, '.example.com/x/y'))")
    both = F.concat(payloads.searches(target, payloads.WEB_SEARCHES), payloads.searches(target, payloads.CODE_SEARCHES))
    return _customers(spark, sf_dir).select("c_custkey", F.explode(both).alias("search"))


@query(f"""WITH {_C} SELECT c_custkey, k % 5 + CASE WHEN k % 3 > 0 THEN k % 7 ELSE 0 END AS exposure,
  CASE WHEN k % 5 + CASE WHEN k % 3 > 0 THEN k % 7 ELSE 0 END >= 10 THEN 'high' WHEN k % 5 + CASE WHEN k % 3 > 0 THEN k % 7 ELSE 0 END >= 5 THEN 'moderate' WHEN k % 5 + CASE WHEN k % 3 > 0 THEN k % 7 ELSE 0 END >= 1 THEN 'low' END AS band FROM c""")
def exposure_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over sources of which some are missing."""
    total = payloads.sum_of(F.col("k") % 5, F.expr("IF(k % 3 > 0, k % 7, NULL)"), F.lit(None).cast("int"))
    return _customers(spark, sf_dir).select("c_custkey", total.cast("int").alias("exposure"), payloads.exposure_band(total).alias("band"))


@query(f"""WITH {_C} SELECT c_custkey, CASE k % 4 WHEN 0 THEN 'Google (Gmail)' WHEN 1 THEN 'Microsoft 365' WHEN 2 THEN 'None' ELSE 'Self-hosted / Unknown' END
  AS provider, k % 4 = 0 AS is_free_provider,
  CASE WHEN k % 4 <> 2 THEN CASE k % 4 WHEN 1 THEN 'x.mail.protection.outlook.com' ELSE 'mx.example.org' END END AS first_server FROM c""")
def mail_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Servers by priority and whose they are."""
    domain = F.expr("IF(k % 4 = 0, 'GMail.com', concat('d', k, '.org'))")
    name = F.expr("IF(k % 4 = 1, 'x.mail.protection.outlook.com.', 'mx.example.org.')")
    servers = F.when(
        F.col("k") % 4 != 2,
        F.array(F.struct(F.lit("zz.example.org.").alias("exchange"), F.lit(20).alias("priority")), F.struct(name.alias("exchange"), F.lit(10).alias("priority"))),
    )
    df = _customers(spark, sf_dir).select("c_custkey", payloads.mail_profile(domain, servers).alias("f"))
    return df.select("c_custkey", "f.provider", "f.is_free_provider", F.get("f.records", 0)["exchange"].alias("first_server"))


@query(f"""WITH {_C}, m AS (SELECT c_custkey, k % 5 = 0 AS listed, k % 3 = 0 AS no_mx, k % 5 <> 0 AND k % 60 < 30 AS young FROM c)
SELECT c_custkey, listed OR (no_mx AND young) AS disposable, CASE WHEN no_mx AND young THEN 'medium' ELSE 'high' END AS confidence,
  (listed::INT + no_mx::INT + young::INT) AS n_signals FROM m""")
def disposable_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of domains is a table that is met by a join."""
    c = _customers(spark, sf_dir).withColumn("domain", F.expr("concat('d', k % 5, '.org')"))
    bad = c.select("domain").where("domain = 'd0.org'").distinct().withColumn("listed", F.lit(True))
    df = c.join(F.broadcast(bad), "domain", "left").select("c_custkey", payloads.disposable(F.col("listed"), F.col("k") % 3 == 0, F.col("k") % 60).alias("f"))
    return df.select("c_custkey", "f.disposable", "f.confidence", F.size("f.signals").alias("n_signals"))


@query(f"""WITH {_C} SELECT c_custkey, unnest(['cust' || k, k || 'cust', 'cust_' || k, 'cust.']) AS username, unnest(['concatenated', 'reversed', 'underscore_variant',
  'base_without_numbers']) AS type,
  unnest(['medium', 'low', 'medium', 'medium']) AS confidence FROM c WHERE k % 2 = 0
UNION ALL SELECT c_custkey, unnest(['me' || k, 'me' || k || '+x']), unnest(['plus_addressing_base', 'base_without_numbers']), unnest(['high', 'medium']) FROM c WHERE k % 2 = 1""")
def mailbox_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15."""
    local = F.expr("IF(k % 2 = 0, concat('cust.', k), concat('me', k, '+x', k))")
    return _customers(spark, sf_dir).select("c_custkey", F.inline(payloads.username_patterns(local)))


@query(r"""
WITH a AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}')) AS e FROM documents)
SELECT doc_id, list_sort(list(DISTINCT e)) AS addresses FROM a WHERE suffix(lower(e), '@example.org') OR suffix(lower(e), '@example.com') GROUP BY doc_id""")
def addresses_of_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of two domains in every document."""
    both = F.array_sort(F.concat(*(payloads.addresses_at(F.col("text"), F.lit(d)) for d in ("example.org", "example.com"))))
    return table(spark, sf_dir, "documents").select("doc_id", both.alias("addresses")).where("size(addresses) > 0")


@query(f"""WITH {_C} SELECT c_custkey, md5('u' || k || '@x.org') AS md5, k % 6 = 0 OR k % 4 = 0 AS breach_found, CASE WHEN k % 4 = 0 THEN 'Critical'
  WHEN k % 6 = 0 THEN 'High' WHEN k % 5 = 0 THEN 'Medium' ELSE 'Low' END AS risk_level,
  list_filter([CASE WHEN k % 9 = 0 THEN 'blacklisted' END, CASE WHEN k % 4 = 0 OR k % 6 = 0 THEN 'credentials leaked' END, CASE WHEN k % 7 = 0 THEN 'spam sender' END],
  lambda x: x IS NOT NULL) AS risk_flags,
  CASE k % 3 WHEN 0 THEN 'mailbox_exists' WHEN 1 THEN 'mailbox_not_found' ELSE 'indeterminate' END AS mailbox FROM c""")
def mail_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4, P17, P21."""
    on = lambda m: F.col("k") % m == 0
    none = F.lit(None).cast("boolean")
    risk = payloads.breach_risk(on(6), none, on(4), on(5))
    flags = payloads.mail_risks(on(9), on(4), on(6), none, on(7), none)
    code = F.expr("CASE k % 3 WHEN 0 THEN '250' WHEN 1 THEN '550' ELSE '421' END")
    digest = payloads.mail_digests(F.expr("concat(' U', k, '@X.org')"))
    df = _customers(spark, sf_dir).select(
        "c_custkey", digest["md5"].alias("md5"), risk.alias("r"), flags.alias("risk_flags"),
        payloads.mailbox_verdict(code)["status"].alias("mailbox"),
    )
    return df.select("c_custkey", "md5", "r.breach_found", "r.risk_level", "risk_flags", "mailbox")


@query(f"""
WITH {_C}, s AS (SELECT c_custkey, greatest(0, least(100, 100 - CASE k % 5 WHEN 0 THEN 30 WHEN 1 THEN 40 WHEN 2 THEN 10 WHEN 3 THEN 20 ELSE 0 END - CASE k % 4
  WHEN 0 THEN 25 WHEN 1 THEN 10 WHEN 2 THEN -5 ELSE 0 END
  - CASE WHEN k % 3 = 0 THEN 15 ELSE 0 END - CASE WHEN k % 7 = 0 THEN 20 ELSE 0 END - 20 * (k % 2)))::INT AS score FROM c)
SELECT c_custkey, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM s""")
def mail_security(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P19."""
    spf = F.expr(
        "CASE k % 5 WHEN 0 THEN array('other') WHEN 1 THEN array('v=spf1 +all') WHEN 2 THEN array('v=spf1 mx ~all') WHEN 3 THEN array('v=spf1 mx ?all',"
        " 'v=spf1 -all') ELSE array('v=spf1 mx -all') END"
    )
    dmarc = F.expr(
        "CASE k % 4 WHEN 0 THEN array() WHEN 1 THEN array('v=DMARC1; p=none; rua=mailto:a@b.c') WHEN 2 THEN array('v=DMARC1;p=reject') ELSE array('v=DMARC1; sp=none') END"
    )
    keys = F.expr("IF(k % 3 = 0, array(), array('google'))")
    found = payloads.mail_security(spf, dmarc, keys, F.col("k") % 7 != 0, F.col("k") % 2)
    return _customers(spark, sf_dir).select("c_custkey", found.alias("f")).select("c_custkey", "f.*")


@query(f"""WITH {_C} SELECT c_custkey, unnest(['include', 'ip4', 'mx', 'all']) AS mechanism, unnest(['+', '-', '?', '~']) AS qualifier, unnest(['_spf.x' || k || '.org',
  '10.0.0.' || (k % 256) || '/32', NULL, NULL]) AS value FROM c""")
def spf_mechanisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SPF records taken apart."""
    record = F.expr("concat('v=spf1 include:_spf.x', k, '.org  -ip4:10.0.0.', k % 256, '/32 ?mx ~all')")
    return _customers(spark, sf_dir).select("c_custkey", F.inline(payloads.spf_mechanisms(record)))


@query(f"""WITH {_C} SELECT c_custkey, CASE k % 4 WHEN 0 THEN 'user' || k WHEN 1 THEN 'bare' || k END AS account, CASE k % 4 WHEN 0 THEN 'm.example.org'
  WHEN 1 THEN 'mastodon.social' END AS instance, k % 4 = 3 AS nostr FROM c""")
def handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P39, P40."""
    t = F.expr(
        "CASE k % 4 WHEN 0 THEN concat(' @user', k, '@m.example.org') WHEN 1 THEN concat('@bare', k) WHEN 2 THEN concat('two words ', k) ELSE concat('npub1/', 1000000 + k) END"
    )
    df = _customers(spark, sf_dir).select("c_custkey", payloads.federated_handle(t).alias("h"), payloads.is_nostr_key(t).alias("nostr"))
    return df.select("c_custkey", F.col("h.user").alias("account"), "h.instance", "nostr")


_PLATFORMS = {"purchase": "GitHub", "signup": "Steam", "click": "Reddit", "view": "Flickr", "error": "Imgur"}


@query(f"""WITH {EV}, p AS (SELECT user_id, k, CASE event_type WHEN 'purchase' THEN 'GitHub' WHEN 'signup' THEN 'Steam' WHEN 'click' THEN 'Reddit'
  WHEN 'view' THEN 'Flickr' ELSE 'Imgur' END AS platform,
  CASE k % 4 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 403 ELSE 200 END AS status FROM ev),
f AS (SELECT * FROM p WHERE CASE WHEN platform = 'Flickr' THEN status <> 404 ELSE status = 200 END AND NOT (platform = 'Steam' AND k % 8 = 0))
SELECT user_id, CASE platform WHEN 'GitHub' THEN 'Tech & Dev' WHEN 'Steam' THEN 'Gaming' WHEN 'Reddit' THEN 'Social Media' WHEN 'Flickr' THEN 'Creative' ELSE 'Other' END
  AS category, list_sort(list(DISTINCT platform)) AS platforms FROM f GROUP BY ALL""")
def account_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platforms that have a user, by category."""
    platform = F.lit("Imgur")
    for kind, name in _PLATFORMS.items():
        platform = F.when(F.col("event_type") == kind, name).otherwise(platform)
    df = evidence(spark, sf_dir).select("user_id", "k", platform.alias("platform"))
    status = F.expr("CASE k % 4 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 403 ELSE 200 END")
    method = F.expr("IF(platform = 'Flickr', 'status_not_404', 'status_200')")
    body = F.expr("IF(k % 8 = 0, 'The profile could not be found', 'hello')")
    absent = F.expr("IF(platform = 'Steam', 'could not be found', NULL)")
    return payloads.accounts_by_category(df.where(payloads.account_found(method, status, body, absent)), "user_id")


@query(f"""WITH {EV} SELECT user_id, coalesce(list_sort(list(DISTINCT 'm' || (k % 6)) FILTER (k % 6 > 0)), []) AS emails,
  coalesce(list_sort(list(DISTINCT 'city' || (k % 4)) FILTER (k % 4 > 0)), []) AS locations,
  list_sort(list(DISTINCT event_type)) AS platforms FROM ev GROUP BY user_id""")
def cross_platform_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P51."""
    rows = evidence(spark, sf_dir).selectExpr(
        "user_id", "event_type AS platform", "IF(k % 6 > 0, concat('m', k % 6), '') AS email",
        "IF(k % 4 > 0, concat('city', k % 4), NULL) AS location", "'' AS name",
    )
    return payloads.cross_platform(rows, "user_id").drop("names")


@query(f"""WITH {EV} SELECT user_id, count(*) AS total_posts, list_filter([CASE WHEN count(*) FILTER (event_type = 'click') > 0 THEN 'reddit' END, CASE
  WHEN count(*) FILTER (event_type = 'view') > 0 THEN 'github' END,
  CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'hackernews' END], lambda x: x IS NOT NULL) AS platforms_found FROM ev WHERE event_type IN ('click', 'view', 'error') GROUP BY user_id""")
def social_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P59."""
    n = lambda t: F.count_if(F.col("event_type") == t).alias(t)
    df = evidence(spark, sf_dir).where("event_type IN ('click', 'view', 'error')").groupBy("user_id").agg(n("click"), n("view"), n("error"))
    each = [F.struct((F.col(t) > 0).alias("found"), F.nullif(F.col(t), F.lit(0)).alias("n")) for t in ("click", "view", "error")]
    return df.select("user_id", payloads.posts(*each).alias("f")).select("user_id", "f.*")


@query(f"""WITH {_C} SELECT c_custkey, list_filter([CASE WHEN k % 2 = 0 THEN 'github' END, CASE WHEN k % 3 = 0 THEN 'spotify' END], lambda x: x IS NOT NULL)
  AS registered_on, (k % 2 = 0)::INT + (k % 3 = 0)::INT AS registered_count, 3 AS sites_checked FROM c""")
def registered_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P58."""
    site = lambda name, found: F.struct(F.lit(name).alias("site"), found.alias("found"))
    sites = F.array(site("github", F.col("k") % 2 == 0), site("spotify", F.col("k") % 3 == 0), site("adobe", F.lit(None).cast("boolean")))
    return _customers(spark, sf_dir).select("c_custkey", payloads.registered(sites).alias("f")).select("c_custkey", "f.*")


@query(f"""WITH {_C} SELECT c_custkey, list_filter([CASE WHEN k % 5 = 0 THEN 'urlhaus: malware' END, CASE
  WHEN k % 7 > 3 THEN 'urlhaus host: ' || (k % 7 - 3) || ' online' END, CASE WHEN k % 11 = 0 THEN 'tor exit node' END,
  CASE WHEN k % 4 = 0 THEN 'spamhaus: SBL, XBL' END, CASE WHEN k % 100 > 25 THEN 'abuseipdb: ' || (k % 100) || '%' END], lambda x: x IS NOT NULL) AS threats FROM c""")
def threat_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P53."""
    none = F.lit(None).cast("boolean")
    lists = F.expr("IF(k % 4 = 0, array('sbl', 'xbl'), array())")
    found = payloads.threats(F.expr("IF(k % 5 = 0, 'malware', NULL)"), F.col("k") % 7 - 3, none, F.col("k") % 11 == 0, lists, none, F.col("k") % 100)
    return _customers(spark, sf_dir).select("c_custkey", found.alias("threats"))


@query(f"""WITH {EV}, e AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS m, count(*) FILTER (event_type = 'view') AS h,
  count(*) FILTER (event_type = 'click') AS u, count(*) AS n, count(*) FILTER (k % 10 = 0) AS bad FROM ev GROUP BY user_id)
SELECT user_id, m + h + u AS total, CASE WHEN m + h + u = 0 THEN 'no analysis available' WHEN m > 0 THEN m || '/' || (m + h + u) || ' flagged malicious'
  ELSE '0/' || (m + h + u) || ' malicious' END AS summary, n AS scans, bad AS malicious_scans FROM e""")
def engine_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P67, P71."""
    ev = evidence(spark, sf_dir)
    n = lambda t: F.count_if(F.col("event_type") == t).alias(t)
    counts = ev.groupBy("user_id").agg(n("error"), n("view"), n("click"))
    f = payloads.engine_summary(F.col("error"), F.col("view"), F.lit(None).cast("long"), F.col("click"))
    scans = payloads.scans(ev.select("user_id", F.when(F.col("k") > 0, F.col("k") % 10 == 0).otherwise(True).alias("malicious")), "user_id")
    return counts.select("user_id", f.alias("f")).join(
        scans.withColumnsRenamed({"total": "scans", "malicious": "malicious_scans"}), "user_id",
    ).select("user_id", "f.*", "scans", "malicious_scans")


@query(f"""WITH {_C} SELECT c_custkey, k % 3 > 0 AS found, CASE WHEN k % 3 > 0 THEN 2 ELSE 0 END AS matches, CASE WHEN k % 3 > 0 THEN list_sort(list_distinct(['us_ofac',
  'd' || (k % 5), 'eu_fsf'])) ELSE [] END AS sources,
  CASE WHEN k % 2 = 0 THEN ['r1', 'r' || (k + 10), 'r5'] ELSE ['r1'] END AS pulse_references FROM c""")
def watch_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data sets of matches, references of pulses (a sixth pulse is not read)."""
    sets = F.expr("IF(k % 3 > 0, array(array('us_ofac', concat('d', k % 5)), array('eu_fsf', '', 'us_ofac')), NULL)")
    refs = F.expr("IF(k % 2 = 0, array(array('r1'), NULL, array(concat('r', k + 10), 'r1'), array(''), array('r5'), array('late')), array(array('r1', 'r1')))")
    return _customers(spark, sf_dir).select(
        "c_custkey", payloads.sanctions(sets).alias("f"),
        payloads.pulse_references(refs).alias("pulse_references"),
    ).select("c_custkey", "f.*", "pulse_references")


@query(f"""
WITH {EV}, a AS (SELECT user_id, 'd' || (k % 20) AS domain, CASE WHEN k % 3 = 0 THEN 'unknown' ELSE event_type END AS language, event_id FROM ev),
d AS (SELECT user_id, domain, count(*) AS n, min(event_id) AS first FROM a GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS p FROM d),
t AS (SELECT user_id, string_agg(domain || ':' || n, ',' ORDER BY p) AS top FROM r WHERE p <= 5 GROUP BY user_id),
l AS (SELECT user_id, language, count(*) AS n FROM a GROUP BY ALL)
SELECT user_id, sum(n)::BIGINT AS total, string_agg(language || ':' || n, ',' ORDER BY language) AS languages, any_value(top) AS top_domains FROM l JOIN t USING (user_id)
  GROUP BY user_id""")
def news_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P26."""
    rows = evidence(spark, sf_dir).selectExpr("user_id", "concat('d', k % 20) AS domain", "IF(k % 3 = 0, '', upper(event_type)) AS language", "event_id AS pos")
    pair = lambda a, b: F.concat(a, F.lit(":"), b)
    joined = F.array_join(F.transform(F.map_entries("languages"), lambda e: pair(e["key"], e["value"])), ",")
    return payloads.news_rollup(rows, "user_id").select(
        "user_id", "total", joined.alias("languages"),
        F.array_join(F.transform("top_domains", lambda d: pair(d["domain"], d["count"])), ",").alias("top_domains"),
    )


@query(f"""WITH {_C} SELECT c_custkey, 1000::BIGINT * k + 7 AS received, 400::BIGINT * k AS sent, 600::BIGINT * k + 7 AS balance, (600::BIGINT * k + 7) / 1e8::DOUBLE
  AS balance_btc, k % 9 + 1::BIGINT AS tx_count,
  [50 - (k % 40), k % 40]::BIGINT[] AS net_values, CASE k % 3 WHEN 0 THEN 'ETH' WHEN 1 THEN 'BTC' ELSE 'unknown' END AS currency, k / 10000.0::DOUBLE AS eth FROM c""")
def ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2, P8, P24."""
    stats = lambda a, b, n: F.struct(a.cast("long").alias("funded"), b.cast("long").alias("spent"), n.cast("long").alias("txs"))
    k, io = F.col("k").cast("long"), lambda a, v: F.struct(a.alias("address"), v.alias("value"))
    me, you = F.lit("me"), F.lit("you")
    txs = F.array(
        F.struct(F.array(io(me, k % 40)).alias("ins"), F.array(io(me, F.lit(50)), io(you, F.lit(9))).alias("outs")),
        F.struct(F.array(io(you, F.lit(1))).alias("ins"), F.array(io(me, k % 40)).alias("outs")),
    )
    address = F.expr("CASE k % 3 WHEN 0 THEN concat('0x', k) WHEN 1 THEN concat('bc1', k) ELSE 'x' END")
    # 10^14 k in hexadecimal: 4 * 5^14 k, a number of 64 bits, and three digits more.
    wei = F.concat(F.lit("0x"), F.hex(k * F.lit(4 * 5**14)), F.lit("000"))
    totals = payloads.address_totals(stats(1000 * k, 400 * k, k % 9 + 1), stats(F.lit(7), F.lit(None), F.lit(None)))
    df = _customers(spark, sf_dir).select(
        "c_custkey", totals.alias("f"), payloads.net_values(me, txs).alias("net_values"),
        kernels.crypto_currency(address).alias("currency"), F.round(kernels.wei_to_eth(wei), 6).alias("eth"),
    )
    return df.select("c_custkey", "f.*", "net_values", "currency", "eth")


@query(f"""WITH {_C} SELECT c_custkey, list_sort(list_distinct(['a' || (k % 50) || '.example.org', 'b.example.org', 'example.org'])) AS names, (k % 90)::INT - 40
  AS days_remaining, (k % 90) < 40 AS expired, (k % 90) BETWEEN 40 AND 70 AS expires_soon,
  sha256('TLSv1.3|AES|' || k)[1:62] AS fingerprint FROM c""")
def certificate_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5, P36, P61."""
    names = F.expr("concat('*.A', k % 50, '.example.org\n', 'b.example.org\n*.b.example.org\nexample.org\n')")
    now = F.lit("2024-06-01").cast("date")
    df = _customers(spark, sf_dir).select(
        "c_custkey", plugins.certificates(names).alias("names"), plugins.tls(F.date_add(now, F.col("k") % 90 - 40), now).alias("t"), kernels.jarm_like(F.lit("TLSv1.3"), F.lit("AES"), F.col("k").cast("string")).alias("fingerprint")
    )
    return df.select("c_custkey", "names", "t.*", "fingerprint")


@query(f"""WITH {_C} SELECT c_custkey, 2 + (k % 2) AS n_disallow, 1 AS n_allow, ['https://x.example/s' || k || '.xml'] AS sitemaps FROM c""")
def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P54."""
    body = F.expr(
        "concat('User-agent: *\nDisallow: /a\ndisallow: /b', k, IF(k % 2 = 1, '\nDisallow: /c', ''), '\nAllow: /d\nSitemap: https://x.example/s', k, '.xml\n# Disallow: no')"
    )
    return _customers(spark, sf_dir).select("c_custkey", plugins.robots(body).alias("r")).select("c_custkey", "r.n_disallow", "r.n_allow", "r.sitemaps")


@query(f"""WITH {_C}, m AS (SELECT c_custkey, k, upper(lpad(to_hex(k % 256), 2, '0')) || ':00:5E:00:00:01' AS mac FROM c)
SELECT c_custkey, mac[1:8] AS oui, (k % 4) >= 2 AS local, k % 2 = 1 AS multicast, CASE k % 4 WHEN 0 THEN ['voip'] WHEN 1 THEN ['toll-free']
  WHEN 2 THEN ['may not be valid'] ELSE [] END AS phone_flags FROM m""")
def hardware_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address bits of interfaces, risk flags of phone lines."""
    mac = F.concat(F.lpad(F.hex(F.col("k") % 256), 2, "0"), F.lit(":00:5E:00:00:01"))
    oui, local, multicast = kernels.mac_flags(mac)
    kind = F.expr("CASE k % 4 WHEN 0 THEN 'VoIP' WHEN 1 THEN 'Toll Free' WHEN 2 THEN 'Mobile' ELSE 'Fixed' END")
    return _customers(spark, sf_dir).select(
        "c_custkey", oui.alias("oui"), local.alias("local"), multicast.alias("multicast"),
        payloads.phone_risks(kind, F.col("k") % 4 != 2).alias("phone_flags"),
    )


@query(f"""WITH {EV}, st AS (SELECT event_id AS pos, 'CA' || k AS cs, user_id::VARCHAR AS icao, event_type AS country, floor(epoch(ts))::BIGINT AS seen, k * 1.5 AS lon, k * 0.5 AS lat, CASE WHEN event_id % 3 > 0 THEN value END AS baro,
  event_id % 4 = 0 AS ground, value / 2 AS speed, value + 1 AS geo FROM ev),
f AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY cs ORDER BY pos) = 1),
t AS (SELECT c_custkey, 'CA' || c_custkey % 150 AS cs FROM customer WHERE c_custkey % 4 < 3)
SELECT c_custkey, cs AS callsign, icao AS icao24, country AS origin_country, lon::DOUBLE AS longitude, lat::DOUBLE AS latitude, round(coalesce(baro, geo), 6) AS altitude, round(speed, 6) AS velocity, ground AS on_ground, seen AS last_seen FROM t JOIN f USING (cs)""")
def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25: customers as flights, events as state vectors."""
    text = lambda c: c.cast("string")
    none = F.lit(None).cast("string")
    v, k = F.col("value"), F.col("k")
    vector = F.array(
        text(F.col("user_id")), F.concat(F.lit(" ca"), k, F.lit(" ")), F.col("event_type"), none, text(F.col("ts").cast("timestamp").cast("long")), text(k * 1.5), text(k * 0.5),
        text(F.when(F.col("event_id") % 3 > 0, v)), text(F.col("event_id") % 4 == 0), text(v / 2), none, none, none, text(v + 1),
    )
    states = evidence(spark, sf_dir).select(F.col("event_id").alias("pos"), vector.alias("vector"))
    target = F.expr("concat(element_at(array('flight: ca', ' CALLSIGN:Ca', 'ca ', 'boat'), CAST(c_custkey % 4 + 1 AS INT)), c_custkey % 150)")
    found = payloads.flight_states(table(spark, sf_dir, "customer").select("c_custkey", target.alias("target")), states, "c_custkey")
    return found.withColumns({c: F.round(c, 6) for c in ("altitude", "velocity")})
