"""URL canonicalisation and reputation, on arrays of URLs so that one or many per row work alike.

Each stage is a transform over structs of the stage before it: an expression is computed once and used by name.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions.text import clean_text, nfkc, refang, strip

# Hosts, parameters, domains, words and weights of the reputation rules.
SHORTENERS = ["bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly", "cutt.ly", "rb.gy", "shorturl.at", "tiny.cc", "rebrand.ly", "t.ly", "s.id"]
TRACKING = ["utm_", "fbclid", "gclid", "mc_eid", "igshid"]
BRANDS = {
    "sbi": ["onlinesbi.sbi", "sbi.co.in", "sbicard.com"],
    "hdfc": ["hdfc.com", "hdfcbank.com"],
    "icici": ["icici.com", "icicibank.com"],
    "axis": ["axisbank.com"],
    "kotak": ["kotak.com"],
    "paytm": ["paytm.com", "paytmbank.com"],
    "phonepe": ["phonepe.com"],
    "gpay": ["google.com", "pay.google.com"],
    "googlepay": ["google.com"],
    "amazon": ["amazon.com", "amazon.in"],
    "flipkart": ["flipkart.com"],
    "paypal": ["paypal.com"],
    "npci": ["npci.org.in"],
    "incometax": ["incometax.gov.in"],
    "uidai": ["uidai.gov.in"],
    "aadhaar": ["uidai.gov.in"],
    "indiapost": ["indiapost.gov.in"],
    "irctc": ["irctc.co.in"],
    "whatsapp": ["whatsapp.com"],
    "netflix": ["netflix.com"],
}
MULTI_SUFFIXES = ["co.in", "gov.in", "org.in", "net.in", "ac.in", "co.uk", "com.au"]
SUSPICIOUS_TLDS = ["xyz", "top", "online", "site", "club", "icu", "live", "shop", "buzz", "click", "link", "rest", "fit", "cam", "monster", "sbs", "cfd", "tk", "ml", "ga", "cf", "gq"]
PHISHING_WORDS = ["login", "signin", "verify", "verification", "update", "kyc", "secure", "account", "bank", "wallet", "refund", "reward", "prize", "lottery", "claim", "otp", "bonus", "unlock", "suspend", "blocked", "confirm", "payment", "free", "gift"]
MALICIOUS, SUSPICIOUS = 60, 25

_SPLIT = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
_IPV4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"


def _literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _fields(x: Column, names: list[str]) -> list[Column]:
    return [x[n].alias(n) for n in names]


def _is_ipv6(host: Column) -> Column:
    groups = F.split(host, ":")
    hexes = F.forall(groups, lambda g: g.rlike(r"^[0-9a-f]{0,4}$"))
    n, empty = F.size(groups), F.size(F.filter(groups, lambda g: g == ""))
    full = (n == 8) & (empty == 0)
    short = host.contains("::") & (n <= 9) & (F.size(F.split(host, "::")) == 2) & ~host.contains(":::") & ~host.rlike(r"^:[^:]|[^:]:$")
    return host.contains(":") & hexes & (full | short)


def _unquote(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))


def _quote(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalize_urls(urls: Column, with_nfkc: bool = False) -> Column:
    """array<string> as array<url info>: canonical form, host features, query parameters. display_host is the host."""
    base = lambda u: F.regexp_replace(refang(clean_text(u)), r"^[<>\"' ]+|[<>\"' ]+$", "")
    one = F.transform(urls, lambda u: F.struct(strip(u).alias("original"), base(u).alias("t")))
    two = F.transform(one, lambda x: F.struct(x["original"], F.when(x["t"].contains("://"), x["t"]).otherwise(F.concat(F.lit("http://"), x["t"])).alias("t")))

    def split(x):
        netloc = F.regexp_extract(x["t"], _SPLIT, 2)
        user = F.regexp_extract(netloc, r"^([^:]*).*@[^@]*$", 1)
        return F.struct(x["original"], F.lower(F.regexp_extract(x["t"], _SPLIT, 1)).alias("scheme"), F.regexp_extract(netloc, r"([^@]*)$", 1).alias("hostport"), (netloc.contains("@") & (user != "")).alias("has_credentials"), F.regexp_extract(x["t"], _SPLIT, 3).alias("path"), F.regexp_extract(x["t"], _SPLIT, 4).alias("query"))

    three = F.transform(two, split)

    def host_of(x):
        bracketed = x["hostport"].startswith("[")
        host = F.when(bracketed, F.regexp_extract(x["hostport"], r"^\[([^\]]*)", 1)).otherwise(F.regexp_extract(x["hostport"], r"^([^:]*)", 1))
        port = F.when(bracketed, F.regexp_extract(x["hostport"], r"\]:(.*)$", 1)).otherwise(F.regexp_extract(x["hostport"], r"^[^:]*:(.*)$", 1))
        number = F.when(port.rlike(r"^[0-9]+$"), port.try_cast("int"))
        pairs = F.filter(F.split(x["query"], "&"), lambda p: p != "")
        decoded = F.transform(pairs, lambda p: F.struct(_unquote(F.substring_index(p, "=", 1)).alias("k"), _unquote(F.when(p.contains("="), F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).otherwise("")).alias("v")))
        kept = F.filter(decoded, lambda p: ~F.exists(_literals(TRACKING), lambda t: F.lower(p["k"]).startswith(t)))
        return F.struct(*_fields(x, ["original", "scheme", "has_credentials"]), F.when(x["path"] == "", "/").otherwise(x["path"]).alias("path"), F.regexp_replace(F.lower(host), r"\.+$", "").alias("host"), F.when(number.between(0, 65535), number).alias("port"), kept.alias("pairs"))

    four = F.transform(three, host_of)

    def features(x):
        host, scheme = x["host"], x["scheme"]
        ip = host.rlike(_IPV4) | _is_ipv6(host)
        default = ((scheme == "http") & (x["port"] == 80)) | ((scheme == "https") & (x["port"] == 443))
        netloc = F.when((x["port"] > 0) & ~default, F.concat_ws(":", host, x["port"].cast("string"))).otherwise(host)
        query = F.array_join(F.transform(x["pairs"], lambda p: F.concat(_quote(p["k"]), F.lit("="), _quote(p["v"]))), "&")
        slash = F.when(x["path"].startswith("/"), x["path"]).otherwise(F.concat(F.lit("/"), x["path"]))
        canonical = F.concat(scheme, F.lit("://"), netloc, slash, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
        labels = F.when((host != "") & ~ip, F.split(host, r"\.")).otherwise(F.array().cast("array<string>"))
        return F.struct(*_fields(x, ["original", "scheme", "host", "port", "path", "has_credentials", "pairs"]), canonical.alias("canonical"), ip.alias("is_ip_host"), labels.alias("labels"))

    five = F.transform(four, features)

    def finish(x):
        n = F.size(x["labels"])
        # of equal names the last value counts
        last = F.filter(x["pairs"], lambda p, i: ~F.exists(F.slice(x["pairs"], i + 2, F.size(x["pairs"])), lambda q: q["k"] == p["k"]))
        return F.struct(
            x["original"], x["canonical"], x["scheme"], x["host"], x["host"].alias("display_host"),
            F.when(n >= 2, F.array_join(F.slice(x["labels"], -2, 2), ".")).otherwise(x["host"]).alias("registered_domain"),
            F.when(n > 0, F.get(x["labels"], n - 1)).otherwise("").alias("tld"),
            F.greatest(n - 2, F.lit(0)).alias("subdomain_depth"), x["port"], x["path"],
            F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"].alias("key"), p["v"].alias("value")))).alias("query_params"),
            x["is_ip_host"], x["host"].contains("xn--").alias("is_punycode"),
            F.regexp_replace(x["host"], r"^www\.", "").isin(SHORTENERS).alias("is_shortener"),
            x["has_credentials"], (x["scheme"] == "https").alias("uses_https"),
        )

    return F.transform(five, finish)


def normalize_url(url: Column) -> Column:
    """One URL; texts beyond ASCII are brought to NFKC first."""
    return F.get(normalize_urls(F.array(nfkc(url))), F.lit(0))


URL_INFO = "struct<original:string,canonical:string,scheme:string,host:string,display_host:string,registered_domain:string,tld:string,subdomain_depth:int,port:int,path:string,query_params:map<string,string>,is_ip_host:boolean,is_punycode:boolean,is_shortener:boolean,has_credentials:boolean,uses_https:boolean>"


@F.pandas_udf(T.ArrayType(T.StringType()))
def _idna(hosts: pd.Series) -> pd.Series:
    def show(h):
        try:
            return h.encode("ascii").decode("idna")
        except UnicodeError:
            return h

    return hosts.map(lambda a: None if a is None else [show(h) if "xn--" in h else h for h in a])


#: Not collapsed into later expressions: a Python function can't be inside a lambda.
_idna = _idna.asNondeterministic()


def with_display_hosts(df: DataFrame, infos_col: str) -> DataFrame:
    """df with the punycode hosts of an array of URL infos decoded for display; rows without one never reach Python."""
    hosts = F.transform(infos_col, lambda x: x["host"])
    shown = _idna(F.when(F.exists(hosts, lambda h: h.contains("xn--")), hosts))
    df = df.withColumn("shown_hosts", shown)
    shown = F.coalesce("shown_hosts", F.transform(infos_col, lambda x: x["host"]))
    return df.withColumn(infos_col, F.zip_with(infos_col, shown, lambda x, h: x.withField("display_host", h))).drop("shown_hosts")


def scored_domain(host: Column) -> Column:
    """The domain a reputation is of: three labels where the last two are a public suffix."""
    labels = F.split(host, r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)), ".")
    three = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 2), F.lit(3)), ".")
    return F.when((F.size(labels) >= 3) & two.isin(MULTI_SUFFIXES), three).otherwise(two)


def _signal(test: Column, name: str, weight, detail) -> Column:
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(test, F.struct(F.lit(name).alias("name"), value(weight).cast("int").alias("weight"), value(detail).cast("string").alias("detail")))


def _first_brand(host: Column) -> Column:
    """Of the brands whose name is in the host while the host isn't theirs, the first: its number, else null."""
    compact = F.regexp_replace(host, r"[^a-z0-9]", "")
    tests = []
    for i, (name, official) in enumerate(BRANDS.items()):
        own = F.lit(False)
        for d in official:
            own = own | (host == d) | host.endswith(f".{d}")
        tests.append(F.when(compact.contains(name) & ~own, F.lit(i)))
    return F.coalesce(*tests)


def reputations(infos: Column, block: list[str] = (), allow: list[str] = ()) -> Column:
    """array<url info> as array<reputation>. block and allow are short lists of hosts or domains; longer ones: with_lists()."""
    one = F.transform(infos, lambda f: F.struct(f.alias("f"), F.when(f["is_ip_host"], f["host"]).otherwise(scored_domain(f["host"])).alias("domain"), F.array_sort(F.filter(_literals(PHISHING_WORDS), lambda w: F.lower(F.concat(f["host"], f["path"])).contains(w))).alias("words"), _first_brand(f["host"]).alias("brand")))
    one = F.transform(one, lambda x: F.struct(x["f"], x["domain"], x["words"], x["brand"], F.substring_index(x["domain"], ".", 1).alias("name")))
    official = sorted({d for ds in BRANDS.values() for d in ds})
    brand_detail = _literals([f"mentions '{b}' but is not {ds[0]}" for b, ds in BRANDS.items()])
    block, allow = [d.lower() for d in block], [d.lower() for d in allow]

    def judge(x):
        f, name = x["f"], x["name"]
        hosts = F.array(f["host"], scored_domain(f["host"]))
        no_host = f["host"] == ""
        rules = F.array(
            _signal(f["is_ip_host"], "ip_address_host", 35, f["host"]),
            _signal(f["is_punycode"], "punycode_domain", 30, F.concat(F.lit("displays as "), f["display_host"])),
            _signal(f["has_credentials"], "credentials_in_url", 30, "user@host trick hides the real destination"),
            _signal(f["is_shortener"], "url_shortener", 20, "real destination is hidden"),
            _signal(~f["uses_https"], "no_https", 10, ""),
            _signal((f["port"] > 0) & ~f["port"].isin(80, 443), "non_standard_port", 10, f["port"].cast("string")),
            _signal(f["tld"].isin(SUSPICIOUS_TLDS), "suspicious_tld", 20, F.concat(F.lit("."), f["tld"])),
            _signal(F.length(F.regexp_replace(name, "[^-]", "")) >= 2, "many_hyphens", 10, name),
            _signal(F.length(F.regexp_replace(name, "[^0-9]", "")) >= 4, "digit_heavy_domain", 10, name),
            _signal(f["subdomain_depth"] >= 3, "deep_subdomains", 15, f["host"]),
            _signal(F.length(f["canonical"]) > 100, "very_long_url", 5, F.concat(F.length(f["canonical"]).cast("string"), F.lit(" chars"))),
            _signal(x["brand"].isNotNull(), "brand_impersonation", 45, F.get(brand_detail, x["brand"])),
            _signal(F.size(x["words"]) > 0, "phishing_keywords", F.least(F.size(x["words"]) * 8, F.lit(24)), F.array_join(x["words"], ", ")),
            _signal(x["domain"].isin(official), "known_legitimate_domain", -40, x["domain"]),
        )
        listed = F.lit(False) if not block else F.arrays_overlap(hosts, _literals(block))
        allowed = F.lit(False) if not allow else F.arrays_overlap(hosts, _literals(allow))
        lists = F.array(_signal(listed, "blocklisted", 100, "domain is on the blocklist"), _signal(~listed & allowed, "allowlisted", -100, "domain is on the allowlist"))
        own = F.when(no_host, F.array(_signal(F.lit(True), "no_host", 40, "URL has no resolvable host"))).otherwise(rules)
        return F.struct(f["canonical"].alias("url"), x["domain"].alias("domain"), F.filter(F.concat(own, lists), lambda s: s.isNotNull()).alias("signals"), F.when(listed | allowed, _literals(["heuristics", "lists"])).otherwise(_literals(["heuristics"])).alias("sources"))

    return _with_score(F.transform(one, judge))


def _with_score(judged: Column) -> Column:
    def score(x):
        total = F.aggregate(x["signals"], F.lit(0), lambda a, s: a + s["weight"])
        return F.when(F.exists(x["signals"], lambda s: s["name"] == "allowlisted"), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), total)))

    scored = F.transform(judged, lambda x: F.struct(x.alias("x"), score(x).alias("score")))
    verdict = lambda s: F.when(s >= MALICIOUS, "malicious").when(s >= SUSPICIOUS, "suspicious").otherwise("benign")
    return F.transform(scored, lambda y: F.struct(y["x"]["url"].alias("url"), y["x"]["domain"].alias("domain"), y["score"].alias("score"), verdict(y["score"]).alias("verdict"), y["x"]["signals"].alias("signals"), y["x"]["sources"].alias("sources")))


REPUTATION = "struct<url:string,domain:string,score:int,verdict:string,signals:array<struct<name:string,weight:int,detail:string>>,sources:array<string>>"


def with_lists(df: DataFrame, reputation_col: str, host_col: str, lists: DataFrame, most: int = 200_000) -> DataFrame:
    """One reputation a row joined with a list (domain, kind: block or allow) on host or domain; block wins.

    The list is broadcast only if it has `most` rows at most; hits are found with two equi-joins either way.
    """
    best = lists.groupBy(F.lower("domain").alias("list_domain")).agg(F.max("kind").alias("list_kind"))  # "block" > "allow"
    if best.limit(most + 1).count() <= most:
        best = F.broadcast(best)
    by_host = best.select(F.col("list_domain").alias("h"), F.col("list_kind").alias("by_host"))
    by_domain = best.select(F.col("list_domain").alias("d"), F.col("list_kind").alias("by_domain"))
    rows = df.withColumn("scored_domain", scored_domain(F.col(host_col)))
    rows = rows.join(by_host, rows[host_col] == F.col("h"), "left").join(by_domain, rows["scored_domain"] == F.col("d"), "left").drop("h", "d", "scored_domain")
    kind = F.greatest("by_host", "by_domain")
    hit = F.when(kind == "block", _signal(F.lit(True), "blocklisted", 100, "domain is on the blocklist")).when(kind == "allow", _signal(F.lit(True), "allowlisted", -100, "domain is on the allowlist"))
    r = F.col(reputation_col)
    joined = F.struct(r["url"].alias("url"), r["domain"].alias("domain"), F.when(hit.isNull(), r["signals"]).otherwise(F.concat(r["signals"], F.array(hit))).alias("signals"), F.when(hit.isNull(), r["sources"]).otherwise(F.concat(r["sources"], _literals(["lists"]))).alias("sources"))
    return rows.withColumn(reputation_col, F.get(_with_score(F.array(joined)), F.lit(0))).drop("by_host", "by_domain")
