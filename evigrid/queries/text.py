"""Text kernels over documents, pages and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.functions import classify, extract, kernels, normalize
from evigrid.queries.registry import query
from evigrid.session import table
from evigrid.sources import files


def _sql_extract(kind: str) -> str:
    return f"SELECT doc_id, '{kind}' AS type, v AS value FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{extract.PATTERNS[kind].replace(chr(39), chr(39) * 2)}'))) AS v FROM documents)"


_KINDS = tuple(k for k in extract.PATTERNS if k != "domain")


@query(" UNION ALL ".join(map(_sql_extract, _KINDS)))
def extract_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pattern types but domains, over every document."""
    return extract.entities(table(spark, sf_dir, "documents"), "text", ["doc_id"], _KINDS, context=False).select("doc_id", "type", "value")


@query(f"SELECT * FROM ({_sql_extract('domain')}) WHERE lower(value) NOT IN ('example.com', 'example.org', 'yourdomain.com', 'domain.com')")
def extract_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.entities(table(spark, sf_dir, "documents"), "text", ["doc_id"], ("domain",), context=False).select("doc_id", "type", "value")


@query(
    "SELECT type, count(*) AS n_entities, count(DISTINCT value) AS n_values, count(DISTINCT doc_id) AS n_docs FROM (" + " UNION ALL ".join(
        map(_sql_extract, _KINDS)
    ) + ") GROUP BY type"
)
def extract_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-wins entities per document, counted by type."""
    found = extract.entities(table(spark, sf_dir, "documents"), "text", ["doc_id"], _KINDS, context=False)
    return found.groupBy("type").agg(F.count("*").alias("n_entities"), F.countDistinct("value").alias("n_values"), F.countDistinct("doc_id").alias("n_docs"))


@query("""WITH c AS (SELECT c_custkey, c_custkey::VARCHAR AS k FROM customer)
SELECT c_custkey, 'email' AS type, 'u' || k || '@x.org' AS value, 'regex' AS source, 75 AS confidence FROM c UNION ALL SELECT c_custkey, 'domain', 'x.org', 'regex', 75 FROM c
UNION ALL SELECT c_custkey, 'domain', CASE WHEN c_custkey % 2 = 0 THEN 'H' ELSE 'h' END || k || '.example.net', CASE WHEN c_custkey % 2 = 0 THEN 'target' ELSE 'regex' END, CASE WHEN c_custkey % 2 = 0 THEN 100 ELSE 75 END FROM c
UNION ALL SELECT c_custkey, 'username', 'name' || k, 'target', 100 FROM c WHERE c_custkey % 2 = 1""")
def extracted_with_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of a text, each once whatever its case, and the target, which wins over an equal one."""
    c = table(spark, sf_dir, "customer")
    text = F.expr("concat('mail u', c_custkey, '@x.org, U', c_custkey, '@X.ORG; host h', c_custkey, '.example.net')")
    found = extract.entities(c.select("c_custkey", text.alias("t")), "t", ["c_custkey"], ("domain", "email"), context=False)
    targets = c.selectExpr("c_custkey", "IF(c_custkey % 2 = 0, concat('H', c_custkey, '.example.net'), concat('name', c_custkey)) AS target", "IF(c_custkey % 2 = 0, 'domain', 'username') AS target_type")
    return extract.with_target(found, targets, ["c_custkey"])


@query(r"""
WITH p AS (SELECT page_id, lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s, lower(regexp_extract(trim(url),
  '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS h,
 regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(trim(url), '^[^?#]*(\?[^#]*)', 1) AS q FROM pages)
SELECT page_id, s || '://' || h || CASE WHEN path IN ('', '/') THEN '/' ELSE rtrim(path, '/') END || q AS url_normal, regexp_replace(h, '^www\.', '') AS domain_normal FROM p""")
def normalize_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N2, N7 over page urls."""
    return table(spark, sf_dir, "pages").select("page_id", normalize.url(F.col("url")).alias("url_normal"), normalize.ascii_domain(F.col("url")).alias("domain_normal"))


_NAMES = "concat(' @', c_name, ' ')"


@query(
    "SELECT c_custkey, lower(replace(c_name, ' ', '')) AS username, lower(c_name) || '@mail.example.com' AS email, upper(regexp_replace(lower(sha256(c_name)),"
    " '[^a-f0-9]', '', 'g')) AS hash_value, 'AS' || c_custkey AS asn, 'CVE-2024-' || lpad(c_custkey::VARCHAR, 5, '0') AS cve FROM customer"
)
def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N1, N4, N5, N9, N10 over values derived from customers."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        "c_custkey", normalize.username(F.expr(_NAMES)).alias("username"),
        normalize.email(F.expr("concat(' MAILTO:', c_name, '@Mail.Example.com')")).alias("email"),
        normalize.hash_value(F.expr("concat('sha256:', sha2(c_name, 256))")).alias("hash_value"),
        normalize.asn(F.expr("concat('as00', c_custkey)")).alias("asn"),
        normalize.cve(F.expr("concat('cve2024-', lpad(c_custkey, 5, '0'))")).alias("cve"),
    )


_TARGETS = "SELECT url AS t FROM pages UNION ALL SELECT regexp_replace(url, '^https?://([^/?#]*).*$', '\\1') FROM pages UNION ALL SELECT c_name FROM customer UNION ALL SELECT '10.0.' || (c_custkey % 256) || '.' || c_nationkey FROM customer UNION ALL SELECT 'u' || c_custkey || '@x.org' FROM customer UNION ALL SELECT '+49 30 ' || (1000000 + c_custkey) FROM customer UNION ALL SELECT upper(md5(c_name)) FROM customer UNION ALL SELECT p_name FROM part UNION ALL SELECT '@' || replace(c_mktsegment, ' ', '_') FROM customer"


def _sql_classify() -> str:
    return rf"""WITH x AS (SELECT trim(t) AS t FROM ({_TARGETS})),
k AS (SELECT t, CASE WHEN regexp_matches(t, '^https?://') THEN
   CASE WHEN regexp_matches(split_part(lower(t), '?', 1), '\.(jpg|jpeg|png|gif|webp|bmp|tiff|tif)$') THEN 'image' ELSE 'url' END
 WHEN regexp_full_match(t, '[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}') THEN 'ip'
 WHEN regexp_full_match(t, '[^@\s]+@[^@\s]+\.[^@\s]+') THEN 'email'
 WHEN regexp_full_match(t, '[13][a-km-zA-HJ-NP-Z1-9]{{25,34}}') THEN 'crypto'
 WHEN starts_with(t, '+') AND regexp_full_match(t, '\+[0-9 ()\-]{{7,20}}') THEN 'phone'
 WHEN regexp_full_match(translate(t, ' ()-', ''), '[0-9]{{7,15}}') THEN 'phone'
 WHEN starts_with(t, '@') AND regexp_full_match(t, '@[a-zA-Z0-9_.]{{2,40}}') THEN 'username'
 WHEN regexp_full_match(t, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{10,30}}') THEN 'iban'
 WHEN regexp_full_match(t, '[0-9a-fA-F]+') AND length(t) IN (32, 40, 64) THEN 'hash'
 WHEN regexp_full_match(t, '([a-zA-Z0-9]([a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?\.)+[a-zA-Z]{{2,}}') THEN 'domain'
 WHEN regexp_full_match(t, '[a-zA-Z0-9_]{{2,40}}') THEN 'username'
 WHEN regexp_full_match(t, '[A-Z][a-zA-Z''-]+( [A-Z][a-zA-Z''-]+){{1,3}}') THEN 'person' ELSE 'unknown' END AS kind FROM x)
SELECT kind, count(*) AS n, count(DISTINCT t) AS n_values, min(t) AS least FROM k GROUP BY kind"""


@query(_sql_classify())
def classify_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1 over urls, hosts, names, addresses, numbers and digests."""
    p, c, part = (table(spark, sf_dir, n) for n in ("pages", "customer", "part"))
    ts = [p.selectExpr("url AS t"), p.select(F.regexp_replace("url", r"^https?://([^/?#]*).*$", "$1").alias("t"))]
    ts += [c.selectExpr(f"{e} AS t") for e in ("c_name", "concat('10.0.', c_custkey % 256, '.', c_nationkey)", "concat('u', c_custkey, '@x.org')", "concat('+49 30 ', 1000000 + c_custkey)", "upper(md5(c_name))", "concat('@', replace(c_mktsegment, ' ', '_'))")] + [part.selectExpr("p_name AS t")]
    both = ts[0]
    for t in ts[1:]:
        both = both.union(t)
    return both.select(classify.classify(F.col("t")).alias("kind"), normalize.strip(F.col("t")).alias("t")).groupBy("kind").agg(
        F.count("*").alias("n"), F.countDistinct("t").alias("n_values"), F.min("t").alias("least"),
    )


_BODY = (
    ("WordPress", "wp-content|wp-includes"), ("Joomla", "/media/jui/"), ("Drupal", "drupal.settings"), ("Laravel", "laravel_session|laravel_token"), ("Django", "csrfmiddlewaretoken|django"),
    ("React", r"react\.js|react-dom|__next_data__|_reactroot"), ("Vue.js", r"vue\.js|v-cloak|v-bind|__vue"), ("Angular", "[ngclas]"), ("jQuery", "jquery"), ("Bootstrap", r"bootstrap[.-]min\.css|bootstrap\.js"),
    ("Tailwind CSS", r"tailwind\.css|tailwindcss"), ("Next.js", "__next_data__|_next/static"), ("Nuxt.js", "__nuxt__|_nuxt/"), ("Gatsby", "gatsby"), ("Hugo", "hugo"), ("Ghost", r'ghost\.org|content="ghost'),
    ("Shopify", r"shopify\.com|shopify\.theme"), ("WooCommerce", "woocommerce"), ("phpMyAdmin", "phpmyadmin|pma_"), ("cPanel", "cpanel"), ("Google Analytics", r"google-analytics\.com|gtag\(|ga_"),
    ("Google Tag Manager", r"googletagmanager\.com|gtm-"), ("Matomo", r"matomo\.|piwik\."), ("Nginx", "<center>nginx</center>|nginx/"), ("Apache", "apache/[0-9]|mod_"), ("OpenResty", "openresty"),
    ("CloudFront", r"cloudfront\.net"), ("Varnish", "varnish"), ("Chart.js", r"chart\.js"), ("Three.js", r"three\.js|three\.webgl"), ("Font Awesome", "font-awesome|fontawesome"), ("React Router", "react-router|reactrouter"),
)
_FRONT = "'jQuery', 'Bootstrap', 'Tailwind CSS', 'Chart.js', 'Three.js', 'Font Awesome', 'React Router'"
_FRAME = "'Laravel', 'Django', 'React', 'Vue.js', 'Angular', 'Next.js', 'Nuxt.js', 'Gatsby', 'Hugo', 'Express'"


@query(
    "WITH h AS (SELECT page_id, lower(html) AS low, page_id % 4 AS m FROM pages), t AS (SELECT page_id, 'nginx' AS technology FROM h WHERE m = 1 UNION"
    " SELECT page_id, 'Nginx' FROM h WHERE m = 1 "
    "UNION SELECT page_id, 'Express' FROM h WHERE m = 2 UNION SELECT page_id, 'Cloudflare' FROM h WHERE m = 3 OR regexp_matches(low, 'cloudflare|cf-browser-verification') "
    + "".join(f"UNION SELECT page_id, '{n}' FROM h WHERE regexp_matches(low, '{p}') " for n, p in _BODY)
    + f") SELECT page_id, technology, CASE WHEN technology IN ('WordPress', 'Joomla', 'Drupal', 'Ghost', 'Shopify', 'WooCommerce') THEN 'cms' WHEN technology IN ({_FRAME}) THEN 'framework' WHEN technology IN ({_FRONT}) THEN 'frontend' "
    "WHEN technology IN ('Google Analytics', 'Google Tag Manager', 'Matomo') THEN 'analytics' WHEN technology = 'Cloudflare' THEN 'hosting'"
    " WHEN technology IN ('Nginx', 'Apache', 'OpenResty', 'Varnish', 'cPanel', 'phpMyAdmin', 'CloudFront') THEN 'server' ELSE 'other' END AS category FROM t"
)
def technology_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header and body signatures, all in one pass of each page; headers come from the page's number."""
    headers = F.expr(
        "CASE page_id % 4 WHEN 1 THEN map('Server', 'nginx/1.25') WHEN 2 THEN map('X-Powered-By', 'Express') WHEN 3 THEN map('CF-Ray', '8a1') ELSE map('Server', '') END"
    )
    found = table(spark, sf_dir, "pages").select("page_id", F.inline(kernels.technologies(F.col("html"), headers)))
    return found.select("page_id", "technology", kernels.technology_category(F.col("technology")).alias("category"))


@query("SELECT page_id, sha256(html) AS sha256, strlen(html) AS size_bytes, to_base64(encode(html)) AS html_base64 FROM pages")
def html_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S12 (no test page exceeds the cap of 1 MiB)."""
    got = files.snapshots(table(spark, sf_dir, "pages"))
    return got.withColumn("html_base64", F.regexp_replace("html_base64", r"\s", ""))


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text) AS size_bytes, length(sha256(text)) = 64 AS sane FROM documents")
def custody_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7, M9: digest and size of the stored payload, and the record's sanity check."""
    sha = F.sha2("text", 256)
    return table(spark, sf_dir, "documents").select(
        "doc_id", sha.alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"),
        (F.length(sha) == 64).alias("sane"),
    )


_IBAN = "'DE' || lpad(((c_custkey * 7) % 97)::VARCHAR, 2, '0') || lpad(c_custkey::VARCHAR, 18, '0')"


@query(
    f"SELECT c_custkey, iban, (CAST(substr(iban, 5) || '1314' || substr(iban, 3, 2) AS HUGEINT) % 97) = 1 AS valid FROM (SELECT c_custkey, {_IBAN} AS iban FROM customer)"
)
def iban_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mod-97 over generated numbers, of which some are valid."""
    iban = F.expr("concat('DE', lpad((c_custkey * 7) % 97, 2, '0'), lpad(c_custkey, 18, '0'))")
    return table(spark, sf_dir, "customer").select("c_custkey", iban.alias("iban"), kernels.iban_valid(iban).alias("valid"))


@query(
    "SELECT page_id, list_sum(list_transform(string_split(regexp_replace(url, '^https?://[^/]*', ''), ''), lambda c: ascii(c)))::BIGINT % 256 AS checksum,"
    " list_sum(list_transform(string_split(regexp_replace(url, '^https?://[^/]*', ''), ''), lambda c: ascii(c)))::BIGINT % 256 = 92 AS is_beacon FROM pages"
)
def beacon_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """checksum8 of the path and query of page urls."""
    s = kernels.checksum8(F.regexp_replace("url", "^https?://[^/]*", "")).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", s.alias("checksum"), (s == 92).alias("is_beacon"))


_NEAR = "a:qwsz b:vghn c:xdfv d:serfcx e:wsdr f:drtgvc g:ftyhbv h:gyujnb i:ujklo j:huikmn k:jijolm l:kop m:njk n:bhjm o:iklp p:ol q:wa r:edft s:awedxz t:rfgy u:yhji v:cfgb w:qase x:zsdc y:tghu z:asx"


@query(f"""
WITH d AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]*)', 1) AS d FROM pages), p AS (SELECT d, regexp_extract(d, '^(.*)\\.[^.]*$', 1) AS n, regexp_extract(d,
  '\\.([^.]*)$', 1) AS t FROM d),
x AS (SELECT d, n, t, unnest(range(0, length(n)))::INT AS i FROM p), near AS (SELECT split_part(e, ':', 1) AS c, split_part(e, ':', 2) AS keys
  FROM (SELECT unnest(string_split('{_NEAR}', ' ')) AS e)),
alike AS (SELECT * FROM (VALUES ('o', '0'), ('l', '1'), ('e', '3'), ('i', '1'), ('a', '@'), ('s', '5'), ('g', '9'), ('t', '7'), ('b', '8')) v(c, r)),
v AS (SELECT d, 1 AS cls, i::BIGINT AS place, substr(n, 1, i) || substr(n, i + 2) || '.' || t AS variant FROM x
UNION ALL SELECT d, 2, a * 1000 + i, substr(n, 1, i) || chr(97 + a) || substr(n, i + 1) || '.' || t FROM (SELECT d, n, t, unnest(range(0, length(n) + 1))::INT AS i
  FROM p), (SELECT unnest(range(0, 26))::INT AS a)
UNION ALL SELECT d, 3, i * 1000 + j, substr(n, 1, i) || substr(keys, j, 1) || substr(n, i + 2) || '.' || t FROM (SELECT d, n, t, i, keys, unnest(range(1,
  length(keys) + 1))::INT AS j FROM x JOIN near ON c = substr(n, i + 1, 1))
UNION ALL SELECT d, 4, i, substr(n, 1, i) || r || substr(n, i + 2) || '.' || t FROM x JOIN alike ON c = substr(n, i + 1, 1)
UNION ALL SELECT d, 5, i * 10 + j, substr(n, 1, i) || substr('aeiou', j, 1) || substr(n, i + 2) || '.' || t FROM x, (SELECT unnest([1, 2, 3, 4, 5]) AS j)
  WHERE contains('aeiou', substr(n, i + 1, 1)) AND substr('aeiou', j, 1) <> substr(n, i + 1, 1)
UNION ALL SELECT d, 6, j, n || '.' || e FROM p, (SELECT unnest(range(1, 10))::INT AS j, unnest(['com', 'co', 'net', 'org', 'io', 'app', 'xyz', 'info', 'biz']) AS e)),
f AS (SELECT d, variant, min(cls * 1000000 + place) AS spot FROM v WHERE variant <> d GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY spot) AS k FROM f)
SELECT d AS domain, ['missing_char', 'extra_char', 'adjacent_key', 'homoglyph', 'vowel_swap', 'tld_swap'][spot // 1000000] AS class, variant FROM r WHERE k <= 50""")
def typosquats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 look-alikes of each host, in order of their classes."""
    hosts = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("domain")).distinct()
    return hosts.select("domain", F.inline(kernels.typosquats(F.col("domain"))))


@query("""WITH d AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]*)', 1) AS d FROM pages), p AS (SELECT d, regexp_extract(d, '^(.*)\\.[^.]*$', 1) AS n,
  regexp_extract(d, '\\.([^.]*)$', 1) AS t FROM d),
m AS (SELECT DISTINCT d, substr(n, 1, i) || substr(n, i + 2) || '.' || t AS variant FROM (SELECT *, unnest(range(0, length(n))) AS i FROM p)) SELECT d AS domain, count(*)
  AS n_missing FROM m WHERE variant <> d GROUP BY d""")
def typosquat_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many look-alikes of each host lack a letter."""
    hosts = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("domain")).distinct()
    found = hosts.select("domain", F.inline(kernels.typosquats(F.col("domain"))))
    return found.where("class = 'missing_char'").groupBy("domain").agg(F.count("*").alias("n_missing"))


@query(
    "SELECT c_custkey, variant FROM (SELECT c_custkey, unnest(list_distinct([n || '.' || k, n || k, n || '_' || k, k || n, k || '_' || n, n || '.', n])) AS variant"
    " FROM (SELECT c_custkey, 'cust' AS n, c_custkey::VARCHAR AS k FROM customer)) WHERE length(variant) BETWEEN 2 AND 39"
)
def username_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20 over mailbox names ``cust.<key>``."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(kernels.username_variants(F.expr("concat('Cust.', c_custkey)"))).alias("variant"))


@query("""SELECT s_suppkey, score, CASE WHEN score >= 7.2 THEN 'A' WHEN score >= 6 THEN 'B' WHEN score >= 4 THEN 'C' WHEN score >= 2 THEN 'D' ELSE 'F' END AS grade
FROM (SELECT s_suppkey, (CASE s_suppkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END + CASE s_nationkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1
  ELSE 0 END + CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 0 END)::INT AS score FROM supplier)""")
def spf_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P60 over records made from supplier keys."""
    spf = F.expr("CASE s_suppkey % 5 WHEN 0 THEN 'v=spf1 mx -all' WHEN 1 THEN 'v=spf1 mx ~all' WHEN 2 THEN 'v=spf1 ?all' WHEN 3 THEN 'v=spf1 mx' END")
    dmarc = F.expr("CASE s_nationkey % 4 WHEN 0 THEN 'v=DMARC1; p=reject' WHEN 1 THEN 'v=DMARC1; p=quarantine; rua=mailto:a@b.c' WHEN 2 THEN 'v=DMARC1; p=none' END")
    score, grade = kernels.spf_grade(spf, dmarc, F.col("s_suppkey") % 2 == 0)
    return table(spark, sf_dir, "supplier").select("s_suppkey", score.cast("int").alias("score"), grade.alias("grade"))


_HOSTS = (
    "[::1]", "[fd00::1]", "[fe80::1]", "[2606:4700::1111]", "[2001:db8::1]", "[::ffff:8.8.8.8]",
    "metadata.google.internal", "8.8.8.8", "169.254.169.254", "example.com",
)


@query(f"""WITH u AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS h FROM pages), a AS (SELECT c_custkey, (c_custkey * 37) % 256 AS a,
  (c_custkey * 11) % 256 AS b FROM customer)
SELECT 'page' AS kind, page_id AS id, h <> '' AS public FROM u
UNION ALL SELECT 'ip', c_custkey, NOT (a IN (0, 10, 127) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192
  AND b = 168) OR (a = 198 AND b IN (18, 19)) OR a >= 224) FROM a
UNION ALL SELECT 'host', c_custkey, c_custkey % 10 IN (3, 5, 7, 9) FROM customer""")
def url_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public urls; IPv4 addresses against reserved blocks as ranges, IPv6 ones and local names."""
    p = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), kernels.is_public_url(F.col("url")).alias("public"))
    ip = F.expr("concat('http://', (c_custkey * 37) % 256, '.', (c_custkey * 11) % 256, '.7.7/x')")
    host = F.concat(F.lit("https://u@"), F.element_at(F.array(*map(F.lit, _HOSTS)), (F.col("c_custkey") % 10 + 1).cast("int")), F.lit(":8443/x?y@z"))
    c = table(spark, sf_dir, "customer")
    return p.union(c.select(F.lit("ip"), F.col("c_custkey"), kernels.is_public_url(ip))).union(c.select(F.lit("host"), F.col("c_custkey"), kernels.is_public_url(host)))
