"""Mail headers: transport, authentication history, ARC, sender identity, verdict, anomalies.

A message's headers are one array, so every layer is an expression on the message's
own row: no join, no shuffle, whatever the number of messages. Input rows have
``msg_id`` and ``headers`` (array of name and value, in the order of the mail), as
``sources.decoders.messages`` gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, contains_any, ends_with_any, let, pinned, present, strings, text_or_empty

#: What headers look like of which hosts, addresses, times and results are read.
MAIL_DOMAIN = r"@([\w.\-]+)"
NAMED = r'"?([^"<]+)"?\s*<([^>]+)>'
BARE_ADDRESS = r"[\w.\-+]+@[\w.\-]+"
FROM_HOST = r"(?i)from\s+([\w.\-]+)"
BY_HOST = r"(?i)by\s+([\w.\-]+)"
FROM_IP = r"(?i)from\s+[\w.\-]+\s*\([^)]*?\[?([0-9a-fA-F.:]{3,})\]?\)"
STAMP = r"(?is);\s*(.+)$"
INSTANCE = r"(?i)^\s*i\s*=\s*\d+\s*;?\s*"
METHOD = r"^(?i)(spf|dkim|dmarc|compauth)\s*="
MAILFROM = r"(?i)smtp\.mailfrom\s*=\s*([\w.\-@]+)"
ENVELOPE = r"(?i)envelope-from\s*=\s*<?[\w.\-]*@([\w.\-]+)>?"
EVALUATED_IP = r"(?i)(?:sender\s+IP\s+is|client-ip\s*=|designates)\s+((?:\d{1,3}\.){3}\d{1,3}|[0-9a-fA-F:]{3,})"
SIGNED_BY = r"(?i)header\.d\s*=\s*([\w.\-]+)"
SHOWN_FROM = r"(?i)header\.from\s*=\s*([\w.\-]+)"

#: Fixed values, in priority order: gateway, its name, and parts of its hosts' names.
GATEWAYS = (
    ("proofpoint", "Proofpoint", ("pphosted.com", "proofpoint.com", "proofpointessentials.com", "pps.filterd", "ppops.net")),
    ("mimecast", "Mimecast", ("mimecast.com", "mimecastprotect.com")),
    ("barracuda", "Barracuda", ("barracudanetworks.com", "barracuda.com", "cudamail.com")),
    ("cisco", "Cisco ESA", ("esa.cisco.com", "ironport.com", "cisco.com", "iphmx.com", "ciscoemail.com")),
    ("microsoft", "Microsoft 365", ("protection.outlook.com", "microsoft.com", "outlook.com", "hotmail.com", "exchangelabs.com", "prod.exchangelabs.com", "eo.outlook.com", "mail.protection.outlook.com")),
    ("google", "Google Workspace", ("google.com", "gmail.com", "googlemail.com", "smtp.google.com", "googlegroups.com")),
    ("symantec", "Symantec / MessageLabs", ("messagelabs.com", "symanteccloud.com", "brightmail.com")),
    ("fortimail", "FortiMail", ("fortinet.com", "fortimail.com", "fortigate.com")),
    ("trendmicro", "Trend Micro", ("trendmicro.com", "imhs.trendmicro.com", "imsva.trendmicro.com", "interscan.trendmicro.com")),
    ("sophos", "Sophos Email", ("sophos.com", "reflexion.net", "hiddenreflex.com")),
    ("spambrella", "Spambrella", ("spambrella.com",)),
    ("hornetsecurity", "Hornet Security", ("hornetsecurity.com", "antispameurope.com")),
    ("zoho", "Zoho Mail", ("zoho.com", "zohocorp.com")),
    ("amazon_ses", "Amazon SES", ("amazonses.com", "amazonaws.com", "aws.amazon.com")),
    ("sendgrid", "SendGrid", ("sendgrid.net", "sendgrid.com")),
    ("mailgun", "Mailgun", ("mailgun.org", "mailgun.net")),
    ("postfix", "Postfix MTA", ("postfix", "postfix.org")),
)
#: Marks of a gateway's policy decision, private prefixes, and bulk senders (in order).
POLICY_MARKERS = ("ppops.net", "pphosted.com", "pps.filterd")
PRIVATE_PREFIXES = ("10.", "192.168.", "127.", "::1", "0.0.0.0", *(f"172.{k}." for k in range(16, 32)))
BULK_SENDERS = (
    ("amazonses.com", "Amazon SES"), ("amazonaws.com", "Amazon SES"), ("sendgrid.net", "SendGrid"), ("sendgrid.com", "SendGrid"),
    ("mailgun.org", "Mailgun"), ("mailgun.net", "Mailgun"), ("mandrillapp.com", "Mandrill"), ("mandrill.com", "Mandrill"),
    ("mailchimp.com", "Mailchimp"), ("list-manage.com", "Mailchimp"), ("hubspotemail.net", "HubSpot"), ("hubspot.com", "HubSpot"),
    ("salesforce.com", "Salesforce Marketing"), ("exacttarget.com", "Salesforce Marketing"), ("sparkpostmail.com", "SparkPost"), ("sparkpost.com", "SparkPost"),
    ("postmarkapp.com", "Postmark"), ("bounces.google.com", "Google Workspace"), ("mail.klaviyo.com", "Klaviyo"), ("klaviyo.com", "Klaviyo"),
    ("constantcontact.com", "Constant Contact"), ("campaign-monitor.com", "Campaign Monitor"), ("mcsignup.com", "Mailchimp"), ("omnisend.com", "Omnisend"),
    ("sendinblue.com", "Brevo (Sendinblue)"), ("brevo.com", "Brevo"),
    ("outbound.sparkpostmail.com", "SparkPost"), ("us-west-2.amazonses.com", "Amazon SES"), ("eu-west-1.amazonses.com", "Amazon SES"), ("us-east-1.amazonses.com", "Amazon SES"),
)


def gateway_of(host: Column) -> Column:
    """The first gateway a part of whose names is in the text; null for none."""
    every = [p for _, _, parts in GATEWAYS for p in parts]
    first = lambda h: F.coalesce(*[F.when(contains_any(h, parts), key) for key, _, parts in GATEWAYS])
    return let(F.lower(F.trim(text_or_empty(host))), lambda h: F.when(contains_any(h, every), first(h)))


def gateway_name(key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, name, _ in GATEWAYS for x in (k, name)]), key)


def gateway_key(name: Column) -> Column:
    """A gateway's key from any spelling: the key within the name or the other way round, then its display name alike."""
    n = F.lower(F.trim(name))
    by_key = [F.when(F.contains(n, F.lit(k)) | F.contains(F.lit(k), n), k) for k, *_ in GATEWAYS]
    by_name = [F.when(F.contains(F.lit(d.lower()), n) | F.contains(n, F.lit(d.lower())), k) for k, d, _ in GATEWAYS]
    return F.coalesce(*by_key, *by_name, n)


def is_private(ip: Column) -> Column:
    return any_of([F.startswith(ip, F.lit(p)) for p in PRIVATE_PREFIXES])


def bulk_sender(domain: Column) -> Column:
    """The mail service a domain belongs to; exact names come before endings."""
    exact = lambda d: [F.when(d == s, n) for s, n in BULK_SENDERS]
    ending = lambda d: [F.when(F.endswith(d, F.lit("." + s)), n) for s, n in BULK_SENDERS]
    known = lambda d: ends_with_any(d, [s for s, _ in BULK_SENDERS])
    return let(F.regexp_replace(F.lower(text_or_empty(domain)), r"^\.+|\.+$", ""), lambda d: F.when(known(d), F.coalesce(*exact(d), *ending(d))))


def values(headers: Column, name: str) -> Column:
    """All values of a header, in order."""
    return F.transform(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), lambda h: h["value"])


def first_value(headers: Column, name: str) -> Column:
    return F.coalesce(F.get(values(headers, name), F.lit(0)), F.lit(""))


def mail_domain(value: Column) -> Column:
    d = F.lower(F.regexp_extract(text_or_empty(value), MAIL_DOMAIN, 1))
    return F.when(d != "", d)


def name_and_address(value: Column) -> Column:
    """Struct of display name and lower-case address."""

    def read(v: Column) -> Column:
        both = v.rlike(NAMED)
        bare = F.regexp_extract(v, BARE_ADDRESS, 0)
        name = F.when(both, F.trim(F.regexp_extract(v, NAMED, 1))).otherwise("")
        address = F.when(both, F.trim(F.regexp_extract(v, NAMED, 2))).when(bare != "", bare).otherwise(F.trim(v))
        return F.struct(name.alias("display_name"), F.lower(address).alias("address"))

    return let(text_or_empty(value), read)


def address_domain(address: Column) -> Column:
    return F.when(F.contains(address, F.lit("@")), F.get(F.split(address, "@"), F.lit(1))).otherwise("")


def received_hop(raw: Column) -> Column:
    """One Received header as a hop."""
    stamp = F.trim(F.regexp_extract(F.trim(raw), STAMP, 1))
    stamp = F.substring(F.trim(F.regexp_replace(F.substring_index(stamp, "\n", 1), r"\s+", " ")), 1, 60)
    read = F.struct(F.lower(F.regexp_extract(raw, FROM_HOST, 1)).alias("sending"), F.lower(F.regexp_extract(raw, BY_HOST, 1)).alias("receiving"), F.regexp_extract(raw, FROM_IP, 1).alias("ip"))

    def hop(x: Column, gateway: Column) -> Column:
        return F.struct(
            x["sending"].alias("sending_host"), x["receiving"].alias("receiving_host"), x["ip"].alias("ip"), stamp.alias("timestamp"), gateway.alias("gateway"),
            F.coalesce(gateway_name(gateway), F.lit("")).alias("gateway_name"), ((x["ip"] != "") & is_private(x["ip"])).alias("is_internal"), F.substring(raw, 1, 300).alias("raw"),
        )

    # each part is read once: an expression is computed wherever it stands in another
    return let(read, lambda x: let(F.coalesce(gateway_of(x["sending"]), gateway_of(x["receiving"])), lambda g: hop(x, g)))


def with_transport(df: DataFrame) -> DataFrame:
    """Adds hops (oldest first, without a gateway's internal repeats), origin and final_hop."""
    df = pinned(df.withColumn("_hops", F.transform(F.reverse(values(F.col("headers"), "received")), received_hop)))
    # an internal hop goes if its gateway came before; kept hops always include a gateway's first
    keys = F.transform("_hops", lambda h: h["gateway"])
    df = df.withColumn("hops", F.filter("_hops", lambda h, i: ~(h["is_internal"] & h["gateway"].isNotNull() & F.exists(F.slice(keys, 1, i), lambda k: F.coalesce(k == h["gateway"], F.lit(False))))))
    real = lambda h: ~h["sending_host"].isin("localhost", "127.0.0.1", "")
    start = F.get(F.filter("hops", lambda h: real(h) & ((h["ip"] == "") | ~is_private(h["ip"]))), F.lit(0))
    origin = let(start, lambda x: F.when(x.isNotNull(), F.struct(x["sending_host"].alias("hostname"), x["ip"].alias("ip"), x["gateway"].alias("gateway"), x["gateway_name"].alias("gateway_name"))))
    df = pinned(df)
    return df.withColumns({"origin": origin, "final_hop": F.get("hops", F.size("hops") - 1)}).drop("_hops")


def _result(text: Column, protocol: str) -> Column:
    # looks back only where the name stands
    return let(F.lower(F.regexp_extract(text, rf"(?i){protocol}(?<!\w{protocol})=(\w+)", 1)), lambda found: F.when(found != "", found).otherwise("none"))


def _or_null(value: Column) -> Column:
    return let(value, lambda x: F.when(x != "", x))


def auth_fields(raw: Column) -> Column:
    """Struct of what one authentication header says."""
    body = F.regexp_replace(F.trim(raw), INSTANCE, "")
    server = F.regexp_replace(F.trim(F.substring_index(body, ";", 1)), "^[<>\"']+|[<>\"']+$", "")
    server = F.trim(F.regexp_replace(server, r"\s+\d+$", ""))
    server = let(server, lambda x: F.when(x.rlike(METHOD), "").otherwise(x))
    envelope = F.regexp_extract(raw, ENVELOPE, 1)
    mail_from = let(F.regexp_extract(raw, MAILFROM, 1), lambda m: F.when(m != "", F.when(F.contains(m, F.lit("@")), F.regexp_replace(m, "^[^@]*@", "")).otherwise(m)).otherwise(envelope))
    return F.struct(
        server.alias("server"), _result(raw, "spf").alias("spf"), _result(raw, "dkim").alias("dkim"), _result(raw, "dmarc").alias("dmarc"),
        _or_null(F.regexp_extract(raw, EVALUATED_IP, 1)).alias("eval_ip"),
        _or_null(F.lower(mail_from)).alias("mailfrom_domain"),
        _or_null(F.lower(F.regexp_extract(raw, SIGNED_BY, 1))).alias("signing_domain"),
        _or_null(F.lower(F.regexp_extract(raw, SHOWN_FROM, 1))).alias("header_from"),
    )


def with_auth_timeline(df: DataFrame, *, relay: bool = True) -> DataFrame:
    """Adds timeline: one record for each authentication header, each from that header alone, in order of trust.

    A header that names no evaluator belongs to the host that received from the
    address it tells, else to a gateway its text mentions. ``relay`` adds each record's ``relay_context``.
    """
    h = F.col("headers")

    def kind(name: str, label: str) -> Column:
        return F.transform(values(h, name), lambda v: F.struct(F.lit(label).alias("header_type"), v.alias("raw"), auth_fields(v).alias("f")))

    every = F.concat(kind("Authentication-Results", "AR"), kind("Authentication-Results-Original", "AR-Original"), kind("ARC-Authentication-Results", "ARC"))
    df = pinned(df.withColumn("_r", every))

    def placed(r: Column, i: Column) -> Column:
        own = F.when(r["f"]["server"] != "", gateway_of(r["f"]["server"]))

        def by(receiving: Column) -> Column:
            evaluator = F.when(r["f"]["server"] != "", r["f"]["server"]).otherwise(F.coalesce(_or_null(receiving), F.lit("")))
            return F.struct(r["header_type"].alias("header_type"), r["raw"].alias("raw"), r["f"].alias("f"), i.alias("pos"), evaluator.alias("evaluator"), F.coalesce(own, gateway_of(receiving), gateway_of(r["raw"])).alias("gateway"))

        return let(F.get(F.filter("hops", lambda x: x["ip"] == r["f"]["eval_ip"]), F.lit(0))["receiving_host"], by)

    df = pinned(df.withColumn("_r", F.transform("_r", placed)))
    keys = F.transform("hops", lambda x: x["gateway"])
    last = lambda g: F.size(keys) - F.array_position(F.reverse(keys), g).cast("int")

    def record(r: Column) -> Column:
        instance = F.when(r["header_type"] == "ARC", F.regexp_extract(F.trim(r["raw"]), r"^(?i)i\s*=\s*(\d+)", 1).try_cast("int"))
        policy = contains_any(F.lower(F.concat(r["evaluator"], F.lit(" "), r["raw"])), POLICY_MARKERS)
        read = F.struct(gateway_name(r["gateway"]).alias("name"), instance.alias("instance"), policy.alias("policy"))
        return let(read, lambda x: told(r, x["name"], x["instance"], x["policy"]))

    def told(r: Column, name: Column, instance: Column, policy: Column) -> Column:
        at = F.coalesce(F.when(F.array_contains(keys, r["gateway"]), last(r["gateway"])), F.lit(50))
        rank = F.when(r["header_type"] == "AR-Original", 0).when(r["header_type"] == "AR", 1).otherwise(2)
        order = F.when(rank == 0, 0).when(rank == 1, at).otherwise(F.when(instance != 0, instance).otherwise(99))
        who = F.coalesce(name, _or_null(r["evaluator"]), F.lit("Unknown"))
        label = (
            F.when(rank == 0, "Upstream Preserved Verdict (Authentication-Results-Original)")
            .when(rank == 2, F.concat(F.lit("ARC-Preserved Evaluation — Instance "), F.coalesce(instance.cast("string"), F.lit("None"))))
            .when(policy, F.concat(F.lit("Trusted Gateway Policy Decision ("), who, F.lit(")")))
            .otherwise(F.concat(who, F.lit(" — Local Evaluation")))
        )
        f = r["f"]
        return F.struct(
            rank.alias("rank"), order.alias("sub"), r["pos"].alias("pos"), r["header_type"].alias("header_type"),
            F.coalesce(_or_null(r["evaluator"]), name, F.lit("Unknown")).alias("evaluator"), r["gateway"].alias("gateway"), name.alias("gateway_name"),
            instance.alias("arc_instance"), policy.alias("is_policy_decision"), label.alias("context_label"), f["spf"].alias("spf"), f["dkim"].alias("dkim"), f["dmarc"].alias("dmarc"),
            f["eval_ip"].alias("eval_ip"), f["mailfrom_domain"].alias("mailfrom_domain"), f["signing_domain"].alias("signing_domain"), f["header_from"].alias("header_from"),
        )

    df = pinned(df.withColumn("timeline", F.array_sort(F.transform("_r", record))).drop("_r"))
    return df.withColumn("timeline", F.transform("timeline", lambda r: r.withField("relay", relay_context(r)))) if relay else df


def relay_context(record: Column) -> Column:
    """Struct of has_mismatch, eval_gateway, relay_chain and explanation: why an evaluator saw another address than the origin's."""
    origin, eval_ip = F.col("origin"), record["eval_ip"]
    differs = F.coalesce((eval_ip != origin["ip"]) & (origin["ip"] != ""), F.lit(False))
    seen = F.filter("hops", lambda h: h["gateway"].isNotNull() & ~h["is_internal"])
    is_origin = lambda h: (h["ip"] == origin["ip"]) | (h["ip"] == "") & (origin["gateway_name"] != "") & (h["gateway_name"] == origin["gateway_name"])
    label = lambda who, ip: F.when(who != "", F.concat(who, F.lit(" ("), ip, F.lit(")"))).otherwise(ip)

    def chain(seen: Column) -> Column:
        first = F.array_position(F.transform(seen, is_origin), F.lit(True)).cast("int")
        rest = let(first, lambda k: F.filter(F.when(k > 0, F.slice(seen, k + 1, F.size(seen))).otherwise(F.slice(seen, 1, 0)), lambda h: ~is_origin(h)))

        def until(rest: Column) -> Column:
            stop = F.array_position(F.transform(rest, lambda h: h["ip"] == eval_ip), F.lit(True)).cast("int")
            return let(stop, lambda k: F.when(k > 0, F.slice(rest, 1, F.greatest(k - 1, F.lit(0)))).otherwise(rest))

        return F.array_distinct(F.filter(F.transform(let(rest, until), lambda h: h["gateway_name"]), lambda x: x != ""))

    def why(name: Column) -> Column:
        eval_label, origin_label = label(name, eval_ip), F.concat(F.when(origin["gateway_name"] != "", origin["gateway_name"]).otherwise(origin["hostname"]), F.lit(" ("), origin["ip"], F.lit(")"))
        return (
            F.when(record["spf"] == "fail", F.concat(F.lit("SPF was evaluated against the relay "), eval_label, F.lit(" instead of the original sender "), origin_label, F.lit(", and failed: expected when a gateway relays a message.")))
            .when(record["spf"] == "pass", F.concat(F.lit("SPF was evaluated against "), eval_label, F.lit(" and passed; the original sender was "), origin_label, F.lit(".")))
            .otherwise(F.concat(F.lit("Authentication was evaluated against "), eval_label, F.lit("; the original sender was "), origin_label, F.lit(".")))
        )

    def context(seen: Column) -> Column:
        at_eval = F.get(F.filter(seen, lambda h: h["ip"] == eval_ip), F.lit(0))
        name = F.coalesce(_or_null(at_eval["gateway_name"]), record["gateway_name"], F.lit(""))
        return let(name, lambda x: F.struct(F.lit(True).alias("has_mismatch"), x.alias("eval_gateway"), chain(seen).alias("relay_chain"), why(x).alias("explanation")))

    same = F.struct(F.lit(False).alias("has_mismatch"), F.coalesce(record["gateway_name"], F.lit("")).alias("eval_gateway"), strings([]).alias("relay_chain"), F.lit("").alias("explanation"))
    return F.when(differs, let(seen, context)).otherwise(same)


def with_arc(df: DataFrame) -> DataFrame:
    """Adds arc: instances of seals and ARC results joined on their number, and the one that is trusted.

    The chain is valid if there are as many seals as the highest number; the trusted
    instance is the highest whose seal says pass or none.
    """
    h = F.col("headers")

    def seal(v: Column) -> Column:
        get = lambda p: F.regexp_extract(v, p, 1)
        told = lambda x, other: F.lower(F.coalesce(_or_null(x), F.lit(other)))
        domain, cv = F.rtrim(get(r"(?i)\bd=([^\s;,]+)"), F.lit(";, ")), get(r"(?i)\bcv=(\w+)")
        return F.struct(get(r"(?i)\bi=(\d+)").try_cast("int").alias("i"), told(domain, "unknown").alias("domain"), get(r"(?i)\bs=([^\s;,]+)").alias("selector"), told(cv, "none").alias("cv"))

    df = df.withColumn("_seals", F.transform(values(h, "ARC-Seal"), seal))
    df = df.withColumn("_aar", F.filter("timeline", lambda r: (r["header_type"] == "ARC") & r["arc_instance"].isNotNull()))
    numbers = F.array_sort(F.array_distinct(F.concat(F.filter(F.transform("_seals", lambda s: s["i"]), lambda i: i.isNotNull()), F.transform("_aar", lambda r: r["arc_instance"]))))

    def last_of(array: str, key: str, i: Column) -> Column:
        return let(F.filter(array, lambda x: x[key] == i), lambda found: F.get(found, F.size(found) - 1))

    def entry(gateway: Column) -> Column:
        first = F.get(F.filter("hops", lambda x: (gateway_of(x["receiving_host"]) == gateway) & ~F.coalesce(x["gateway"] == gateway, F.lit(False))), F.lit(0))["receiving_host"]
        other = F.get(F.filter("hops", lambda x: (x["gateway"] == gateway) & (x["sending_host"] != "")), F.lit(0))["sending_host"]
        return F.coalesce(first, other)

    def instance(i: Column) -> Column:
        both = F.struct(last_of("_seals", "i", i).alias("s"), last_of("_aar", "arc_instance", i).alias("a"))
        domain = lambda x: F.coalesce(x["s"]["domain"], x["a"]["evaluator"], F.lit("unknown"))
        return let(both, lambda x: let(domain(x), lambda d: let(gateway_of(d), lambda g: sealed(i, x["s"], x["a"], d, g))))

    def sealed(i: Column, s: Column, a: Column, domain: Column, gateway: Column) -> Column:
        return F.struct(
            i.alias("instance"), domain.alias("domain"), F.coalesce(s["selector"], F.lit("")).alias("selector"), F.coalesce(s["cv"], F.lit("none")).alias("cv"),
            a["spf"].alias("spf"), a["dkim"].alias("dkim"), a["dmarc"].alias("dmarc"), F.coalesce(a["evaluator"], domain).alias("evaluator"),
            gateway.alias("gateway"), gateway_name(gateway).alias("gateway_name"), F.coalesce(_or_null(entry(gateway)), _or_null(a["evaluator"]), domain).alias("sealing_host"),
        )

    df = pinned(df)
    df = pinned(df.withColumn("_inst", F.transform(numbers, instance)))
    df = df.withColumn("_good", let(F.filter("_inst", lambda x: x["cv"].isin("pass", "none")), lambda good: F.get(good, F.size(good) - 1)))
    df, trusted = pinned(df), F.col("_good")
    highest = F.coalesce(F.get("_inst", F.size("_inst") - 1)["instance"], F.lit(0))
    arc = F.struct(
        ((F.size("_seals") > 0) | (F.size("_aar") > 0)).alias("present"), ((F.size("_seals") == highest) & (highest > 0)).alias("chain_valid"), highest.alias("instance_count"), F.col("_inst").alias("instances"),
        trusted["instance"].alias("trusted_instance"), trusted["domain"].alias("trusted_domain"), F.coalesce(trusted["gateway_name"], trusted["domain"]).alias("trusted_gateway_name"), trusted["sealing_host"].alias("trusted_sealing_host"),
    )
    return df.withColumn("arc", arc).drop("_seals", "_aar", "_inst", "_good")


def with_sender(df: DataFrame) -> DataFrame:
    """Adds sender: the identity fields, alignment, and mismatches (array of field, value, severity; severity info is no anomaly)."""
    h, t = F.col("headers"), F.col("timeline")
    head = lambda a: F.get(a, F.lit(0))
    who, back, reply = (name_and_address(first_value(h, n)) for n in ("From", "Return-Path", "Reply-To"))
    df = df.withColumn("_s", F.struct(
        who["display_name"].alias("display_name"), who["address"].alias("from_address"), address_domain(who["address"]).alias("from_domain"),
        F.when(F.contains(back["address"], F.lit("@")), address_domain(back["address"])).otherwise(F.coalesce(mail_domain(first_value(h, "Return-Path")), F.lit(""))).alias("return_domain"),
        address_domain(reply["address"]).alias("reply_domain"),
        F.coalesce(head(F.filter(F.transform(t, lambda r: r["mailfrom_domain"]), lambda x: x.isNotNull())), F.lit("")).alias("envelope_domain"),
        F.coalesce(head(F.transform(F.filter(t, lambda r: (r["dkim"] == "pass") & r["signing_domain"].isNotNull()), lambda r: r["signing_domain"])), head(F.filter(F.transform(t, lambda r: r["signing_domain"]), lambda x: x.isNotNull())), F.lit("")).alias("dkim_domain"),
        F.exists(t, lambda r: r["dkim"] == "pass").alias("dkim_passed"), F.exists(t, lambda r: r["dmarc"] == "pass").alias("dmarc_passed"),
    ))
    df = pinned(df)
    s = F.col("_s")
    own, env, ret, rep, dk = (s[k] for k in ("from_domain", "envelope_domain", "return_domain", "reply_domain", "dkim_domain"))
    differ = lambda x: (own != "") & (x != "") & (F.lower(own) != F.lower(x))
    item = lambda when, field, value, level: F.when(when, F.struct(F.lit(field).alias("field"), value.alias("value"), level.alias("severity")))
    usual = lambda x: F.when(F.coalesce(bulk_sender(x), bulk_sender(own)).isNotNull() | s["dkim_passed"] & s["dmarc_passed"], "info").otherwise("high")
    signed = F.when(bulk_sender(dk).isNotNull(), "info").when(~s["dmarc_passed"], "medium")
    mismatches = present(F.array(
        item(differ(env), "smtp.mailfrom", env, usual(env)), item(differ(ret), "Return-Path", ret, usual(ret)), item(differ(rep), "Reply-To", rep, F.lit("high")),
        item(differ(dk) & signed.isNotNull(), "DKIM signing domain", dk, signed),
    ))
    sender = F.struct(
        *[s[k].alias(k) for k in ("display_name", "from_address", "from_domain", "return_domain", "reply_domain", "envelope_domain", "dkim_domain", "dkim_passed", "dmarc_passed")],
        F.coalesce(bulk_sender(env), bulk_sender(ret), bulk_sender(own), F.lit("")).alias("bulk_sender"),
        F.when(env != "", F.lower(env) == F.lower(own)).alias("spf_to_from"), F.when(dk != "", F.lower(dk) == F.lower(own)).alias("dkim_to_from"), mismatches.alias("mismatches"),
    )
    return df.withColumn("sender", sender).drop("_s")


def _best(records: Column, protocol: str) -> Column:
    """A pass if any record has one, else the first that says anything."""
    results = F.transform(records, lambda r: r[protocol])
    return F.when(F.array_contains(results, "pass"), "pass").otherwise(F.coalesce(F.get(F.filter(results, lambda x: x != "none"), F.lit(0)), F.lit("none")))


def with_verdict(df: DataFrame) -> DataFrame:
    """Adds verdict: spf, dkim, dmarc and where they come from.

    The order is preserved results, a valid ARC chain, gateways' results, any results,
    none. A plain Received-SPF header stands in for a missing SPF result.
    """
    t, arc = F.col("timeline"), F.col("arc")
    of = lambda k: F.filter(t, lambda r: r["header_type"] == k)
    original, plain = of("AR-Original"), of("AR")
    gateways = F.filter(plain, lambda r: r["gateway"].isNotNull())
    trusted = F.get(F.filter(arc["instances"], lambda x: x["instance"] == arc["trusted_instance"]), F.lit(0))
    by_arc = arc["present"] & arc["chain_valid"] & trusted["spf"].isNotNull()
    kind = F.when(F.size(original) > 0, "original").when(F.coalesce(by_arc, F.lit(False)), "arc").when(F.size(gateways) > 0, "gateway").when(F.size(plain) > 0, "fallback").otherwise("none")
    df = pinned(df.withColumn("_kind", kind))
    k = F.col("_kind")
    names = lambda a, f: F.array_join(F.array_distinct(F.transform(a, f)), ", ")
    pick = lambda p: F.when(k == "original", _best(original, p)).when(k == "arc", trusted[p]).when(k == "gateway", _best(gateways, p)).when(k == "fallback", _best(plain, p)).otherwise("none")
    spf_header = F.lower(F.regexp_extract(F.trim(first_value(F.col("headers"), "Received-SPF")), r"^(\w+)", 1))
    spf = F.when((pick("spf") == "none") & (spf_header != ""), spf_header).otherwise(pick("spf"))
    source = (
        F.when(k == "original", F.concat(F.lit("Authentication-Results-Original ("), names(original, lambda r: r["evaluator"]), F.lit(")")))
        .when(k == "arc", F.concat(F.lit("ARC chain — trusted instance i="), arc["trusted_instance"].cast("string"), F.lit(" sealed by "), arc["trusted_gateway_name"]))
        .when(k == "gateway", F.concat(F.lit("Gateway evaluation: "), F.replace(names(gateways, lambda r: F.coalesce(r["gateway_name"], r["evaluator"])), F.lit(", "), F.lit(" → "))))
        .when(k == "fallback", F.concat(F.lit("Authentication-Results fallback ("), names(plain, lambda r: r["evaluator"]), F.lit(")")))
        .otherwise("No authentication headers found")
    )
    verdict = F.struct(spf.alias("spf"), pick("dkim").alias("dkim"), pick("dmarc").alias("dmarc"), k.alias("source_type"), source.alias("source"), (k == "arc").alias("arc_influenced"), ((k == "gateway") & F.exists(gateways, lambda r: r["is_policy_decision"])).alias("policy_override"), pick("spf").alias("spf_recorded"))
    return df.withColumn("verdict", verdict).drop("_kind")


def with_anomalies(df: DataFrame) -> DataFrame:
    v, s = F.col("verdict"), F.col("sender")
    spf = v["spf_recorded"]
    identity = F.transform(F.filter(s["mismatches"], lambda m: m["severity"] == "high"), lambda m: F.concat(F.lit("Identity mismatch: RFC5322.From ("), s["from_domain"], F.lit(") ≠ "), m["field"], F.lit(" ("), m["value"], F.lit(")")))
    first = present(F.array(
        F.when(spf.isin("fail", "softfail"), F.concat(F.lit("SPF check failed: "), spf)), F.when(v["dkim"] == "fail", "DKIM signature failed verification"), F.when(v["dmarc"] == "fail", "DMARC policy check failed"),
    ))
    nothing = present(F.array(F.when((spf == "none") & (v["dkim"] == "none") & (v["dmarc"] == "none"), "No authentication results found — message has no SPF/DKIM/DMARC evaluation")))
    return df.withColumn("anomalies", F.concat(first, identity, nothing))


def analyse(messages: DataFrame) -> DataFrame:
    """All layers of each message's headers."""
    return with_anomalies(pinned(with_verdict(pinned(with_sender(pinned(with_arc(pinned(with_auth_timeline(with_transport(messages))))))))))


def mail_flow(analysed: DataFrame) -> DataFrame:
    """(msg_id, pos, label, gateway, hostname): the hops, between the Internet and the mailbox."""
    end = lambda label: F.array(F.struct(F.lit(label).alias("label"), F.lit(None).cast("string").alias("gateway"), F.lit("").alias("hostname")))
    middle = F.transform("hops", lambda h: F.struct(F.when(h["gateway_name"] != "", h["gateway_name"]).otherwise(h["sending_host"]).alias("label"), h["gateway"].alias("gateway"), h["sending_host"].alias("hostname")))
    return analysed.select("msg_id", F.posexplode(F.concat(end("Internet"), middle, end("Mailbox"))).alias("pos", "x")).select("msg_id", "pos", "x.*")


def auth_records(analysed: DataFrame) -> DataFrame:
    """(msg_id, pos, ...): the timeline, one row for each record."""
    return analysed.select("msg_id", F.posexplode("timeline").alias("ix", "r")).select("msg_id", "ix", F.coalesce("r.gateway_name", "r.evaluator").alias("gateway"), F.col("r.header_type").alias("type"), F.col("r.evaluator").alias("server"), "r.spf", "r.dkim", "r.dmarc", "r.eval_ip", "r.mailfrom_domain", "r.signing_domain", "r.header_from", "r.is_policy_decision", "r.context_label", "r.arc_instance")


def received_ips(headers: Column, cap: int = 10) -> Column:
    """Distinct addresses of the Received headers in order, but for loopback ones."""
    found = F.flatten(F.transform(values(headers, "received"), lambda v: F.regexp_extract_all(v, F.lit(r"\b(?:\d{1,3}\.){3}\d{1,3}\b|\[[0-9a-fA-F:]+\]"), F.lit(0))))
    plain = F.transform(found, lambda x: F.translate(x, "[]", ""))
    return F.slice(F.array_distinct(F.filter(plain, lambda x: ~F.startswith(x, F.lit("127.")) & (x != "::1"))), 1, cap)


def sender_domains(messages: DataFrame) -> DataFrame:
    """(msg_id, domain, fields, mismatch): distinct domains of From, Reply-To and Return-Path, with the fields that have them."""
    fields = F.array(*[F.struct(F.lit(k).alias("field"), mail_domain(first_value(F.col("headers"), n)).alias("domain")) for k, n in (("from", "From"), ("reply_to", "Reply-To"), ("return_path", "Return-Path"))])
    known = F.filter(fields, lambda x: x["domain"].isNotNull())
    distinct = F.array_distinct(F.transform(known, lambda x: x["domain"]))
    rows = messages.select("msg_id", known.alias("_k"), (F.size(distinct) > 1).alias("mismatch"), F.explode(distinct).alias("domain"))
    return rows.select("msg_id", "domain", F.transform(F.filter("_k", lambda x: x["domain"] == F.col("domain")), lambda x: x["field"]).alias("fields"), "mismatch")


def message_scores(scored: DataFrame) -> DataFrame:
    """(msg_id, overall_score, severity, worst, n_high, n_medium): the highest score of a message's indicators (ties: the first)."""
    return scored.groupBy("msg_id").agg(F.max("score").alias("overall_score"), F.max_by("severity", F.struct("score", -F.col("pos"))).alias("severity"), F.max_by("ioc", F.struct("score", -F.col("pos"))).alias("worst"), F.count_if(F.col("severity") == "HIGH").alias("n_high"), F.count_if(F.col("severity") == "MEDIUM").alias("n_medium"))
