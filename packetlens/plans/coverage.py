"""More registered queries: sources, lists, protocols, sinks and views, each with its SQL over the driver's tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens.config import ScanConfig
from packetlens.functions import columns as c
from packetlens.operators import aggregate, decode, detect, logs, match, views
from packetlens.plans import adapter, catalogue
from packetlens.plans.catalogue import _KINDS, ALERT_NAMES, COUNTER_NAMES, DOC, FLOW, HTML, NAMES, PKT, REDACT, SUMMARY, WORDS, _listed, query
from packetlens.plans.scan import Scan
from packetlens.sources import pcap, results

SRC, DST, HOST = adapter.SRC, adapter.DST, adapter.HOST
_hex = adapter._hex


def _folder(spark: SparkSession) -> str:
    """A new folder that executors can write to: below the session's checkpoint folder; a local master's may be temporary."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="results-")
    if base.startswith("file:"):
        base = base.removeprefix("file://").removeprefix("file:")
    return f"{base}/{uuid.uuid4().hex}"


# --- captures


def _capture(spark: SparkSession, sf_dir: str) -> str:
    """The frames of all events as capture files."""
    return pcap.save(catalogue._frames(spark, sf_dir), _folder(spark))


_BODY = "'event ' || packet_id"


@query(f"""{PKT} select {_BODY} body, ts, src_ip, dst_ip, case when l4 = 1 then 0 else src_port end::int src_port, (length({_BODY}) + 34 + case when packet_id % 3 = 0 then 4 else 0 end +
  case l4 when 6 then 20 when 17 then 8 else 2 end)::int raw_len from pkt""")
def capture_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures written from the events, cut into stretches of 64 KiB, and decoded."""
    found = adapter.with_names(decode.decoded(pcap.load(spark, _capture(spark, sf_dir), ids="offset", splitBytes=str(1 << 16))), "src_ip")
    body = F.when(F.col("l4") == c.ICMP, F.expr("substring(payload, 3)")).otherwise(F.col("payload"))
    return found.select(c.latin1(body).alias("body"), "ts", "src_ip", "dst_ip", "src_port", "raw_len")


@query(f"{PKT} select {_BODY} body, src_ip, l4, case when l4 = 1 then 0 else dst_port end::int dst_port from pkt")
def capture_scan_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = adapter.with_names(decode.legacy(pcap.load(spark, _capture(spark, sf_dir), splitBytes=str(1 << 17))), "src_ip")
    body = F.when(F.col("l4") == c.ICMP, F.expr("substring(payload, 3)")).otherwise(F.col("payload"))
    return found.select(c.latin1(body).alias("body"), "src_ip", "l4", "dst_port")


@query("select count(*)::bigint packets from events")
def counted_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of captures by their record headers."""
    return spark.createDataFrame([(pcap.count_packets(spark, _capture(spark, sf_dir), 1 << 16),)], "packets long")


# --- lists


def _line(kind: int, value: Column) -> Column:
    return F.when(F.col("event_id") % 4 == kind, value)


@query(f"select distinct * from (select 32 prefix, ({SRC} + user_id)::bigint network from events where event_id % 4 = 0 union all select 24, ((10 << 16) + user_id)::bigint from events where event_id % 4 = 1)")
def listed_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An address list with blanks and comments."""
    u = F.col("user_id")
    host, net = c.ip4_text(F.lit(SRC) + u), c.ip4_text(((10 << 16) + u) * 256 + 7)
    lines = F.coalesce(_line(0, F.concat(F.lit("  "), host)), _line(1, F.concat(net, F.lit("/24 \t"))), _line(2, F.lit("# 10.0.0.1")), F.lit("  "))
    return match.networks(match.entries(adapter.table(spark, sf_dir, "events").select(lines.alias("value"))))


@query(f"select distinct lower({HOST}) domain from pages where page_id % 3 <> 2 and {HOST} <> ''")
def listed_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = adapter.host(F.col("url"))
    lines = F.when(F.col("page_id") % 3 == 0, F.concat(F.upper(host), F.lit("."))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("\t"), host, F.lit(" "))).otherwise(F.concat(F.lit("#"), host))
    return match.domains(match.entries(adapter.table(spark, sf_dir, "pages").select(lines.alias("value"))))


@query("select n_name word from nation where n_nationkey % 2 = 0")
def listed_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(" "), "n_name", F.lit("  "))).otherwise("#")
    found = match.keywords(match.entries(adapter.table(spark, sf_dir, "nation").select(lines.alias("value"))))
    return spark.createDataFrame([(w,) for w in found], "word string")


_HITS = ", ".join(f"len(list_filter(range(1, length(b)::bigint + 1), lambda i: substr(b, i, {len(w)}) = '{w}'))" for w in WORDS)


@query(f"with {DOC}, cut as (select packet_id, substr(body, 1, 512) b from doc) select packet_id, list_sum([{_HITS}])::int hits from cut")
def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often any keyword stands in the first bytes of a payload, overlaps counted."""
    found = match.keyword_matches(F.col("payload"), WORDS, 512)
    return adapter.documents(spark, sf_dir).select("packet_id", F.size(found).alias("hits"))


# --- sketches


@query(f"select {HOST} as key, count(*)::bigint count, 0::bigint error from pages where {HOST} <> '' group by 1 order by 2 desc, 1 limit 20")
def approx_top_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heavy hitters of mergeable sketches; with more counters than names they are exact."""
    return aggregate.approx_top(adapter.pages(spark, sf_dir), "http_host", 20)


@query(f"{PKT} select src_ip as key, sum(raw_len)::bigint count, 0::bigint error from pkt group by 1 order by 2 desc, 1 limit 30")
def sketched_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes by source from sketches, cut to the largest."""
    parts = aggregate.sketched(adapter.events(spark, sf_dir), "src_ip", F.col("raw_len"), 1000)
    return aggregate.pruned(aggregate.merged_sketches(parts), 30)


# --- protocols


def _rows(spark: SparkSession, sf_dir: str, l4: int, src_port: int, dst_port: int) -> DataFrame:
    """A packet for every page, with its host and the row's columns."""
    return adapter.table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("packet_id"), (F.col("page_id") * 1000000).alias("ts_us"), F.col("page_id").cast("double").alias("ts"),
        (F.lit(SRC) + F.col("page_id") % 250).cast("long").alias("src_ip4"), F.lit(DST).cast("long").alias("dst_ip4"),
        F.lit(l4).alias("l4"), F.lit(src_port).alias("src_port"), F.lit(dst_port).alias("dst_port"), adapter.host(F.col("url")).alias("host"),
    )


_ENDS = "page_id::double ts, '10.0.0.' || (page_id % 250) || ':40000' src, '93.184.216.0:{}' dst"
_METHODS = list(decode.METHODS)


@query(f"""select page_id packet_id, {_ENDS.format(8080)}, {_METHODS}[(page_id % 6 + 1)::int] as method, '/p' || page_id || '?q=a b' uri, {HOST} host, null::int status, 'text/x' content_type from pages""")
def http_request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.element_at(F.array(*map(F.lit, _METHODS)), (F.col("packet_id") % 6 + 1).cast("int"))
    i = F.col("packet_id").cast("string")
    text = F.concat(method, F.lit(" /p"), i, F.lit("?q=a b HTTP/1.1\r\nhost: other\r\nHOST:\t"), "host", F.lit("  \r\nContent-Type: text/x\r\n\r\n"))
    return logs.http(decode.decoded(adapter.framed(_rows(spark, sf_dir, c.TCP, 40000, 8080), text)))


def _question(host: Column) -> Column:
    labels = F.array_join(F.transform(F.split(host, "\\."), lambda x: F.concat(F.lpad(F.hex(F.length(x)), 2, "0"), F.hex(x.cast("binary")))), "")
    return F.concat(labels, F.lit("0000010001"))


@query(f"""select page_id packet_id, {_ENDS.format(53)}, lower({HOST}) queries,
  '1.2.' || (page_id // 256) % 256 || '.' || page_id % 256 || case when page_id % 2 = 0 then '|2001:db8::' || lower(to_hex(page_id % 60000 + 1)) else '' end answers from pages""")
def dns_answer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses with an A answer behind a name pointer, another kind, and AAAA answers for even pages."""
    rows = _rows(spark, sf_dir, c.UDP, 40000, 53)
    i, even = F.col("packet_id"), F.col("packet_id") % 2 == 0
    a = F.concat(F.lit("C00C00010001000000040004" + "0102"), _hex(i % 65536, 4))
    other = F.lit("C00C000500010000000400021111")
    six = F.when(even, F.concat(F.lit("C00C001C0001000000040010" + "20010DB8" + "00" * 10), _hex(i % 60000 + 1, 4))).otherwise("")
    body = F.concat(F.lit("000181800001"), F.when(even, "0003").otherwise("0002"), F.lit("00000000"), _question(F.upper("host")), a, other, six)
    found = logs.dns(decode.decoded(adapter.framed(rows, F.unhex(body))))
    return found.withColumns({x: F.array_join(x, "|") for x in ("queries", "answers")})


@query(f"select page_id packet_id, lower({HOST}) dns_qname_lower, 53 dst_port from pages")
def legacy_dns_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first question, over TCP with its length before it for odd pages."""
    tcp = F.col("packet_id") % 2 == 1
    rows = _rows(spark, sf_dir, c.UDP, 40000, 53).withColumn("l4", F.when(tcp, c.TCP).otherwise(c.UDP))
    body = F.concat(F.lit("000101000001000000000000"), _question(F.upper("host")))
    body = F.when(tcp, F.concat(_hex(F.length(body) / 2, 4), body)).otherwise(body)
    return decode.legacy(adapter.framed(rows, F.unhex(body))).select("packet_id", "dns_qname_lower", "dst_port")


@query(f"""select page_id packet_id, true is_dhcp, 1 dhcp_op, {HOST} dhcp_hostname, '10.1.' || (page_id // 256) % 256 || '.' || page_id % 256 dhcp_client_ip, '10.2.3.4' dhcp_your_ip,
  'aa:bb:cc:dd:' || lpad(lower(to_hex((page_id // 256) % 256)), 2, '0') || ':' || lpad(lower(to_hex(page_id % 256)), 2, '0') dhcp_client_mac from pages""")
def dhcp_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _hex(F.col("packet_id") % 65536, 4)
    head = F.concat(F.lit("01010600" + "00" * 8 + "0A01"), i, F.lit("0A020304" + "00" * 8 + "AABBCCDD"), i, F.lit("00" * 202 + "63825363"))
    body = F.concat(head, F.lit("0000350101" + "0C"), _hex(F.length("host"), 2), F.hex(F.col("host").cast("binary")), F.lit("FF"))
    found = decode.decoded(adapter.framed(_rows(spark, sf_dir, c.UDP, 68, 67), F.unhex(body)))
    return found.select("packet_id", "is_dhcp", "dhcp_op", "dhcp_hostname", "dhcp_client_ip", "dhcp_your_ip", "dhcp_client_mac")


@query("""select page_id packet_id, case when page_id % 3 = 1 then 'u' || page_id else '' end cred_username, case page_id % 3 when 1 then 'pw' when 2 then 'AGJvYg==' else '' end cred_password,
  case page_id % 3 when 0 then 'smtp_auth_login' when 1 then 'smtp' else 'smtp_auth_plain' end cred_protocol from pages""")
def smtp_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("packet_id") % 3
    user = F.concat(F.lit("EHLO x\r\nuser  u"), F.col("packet_id").cast("string"), F.lit(" \r\nPASS pw\r\n"))
    text = F.when(kind == 0, F.lit("EHLO x\r\nauth LOGIN\r\n")).when(kind == 1, user).otherwise("AUTH PLAIN AGJvYg==\r\n")
    found = decode.decoded(adapter.framed(_rows(spark, sf_dir, c.TCP, 40000, 587), text), auth_plain=True)
    return found.select("packet_id", "cred_username", "cred_password", "cred_protocol")


@query(f"""select page_id packet_id, 'Matched domain blocklist: ' || lower({HOST}) detail from pages where exists (select 1 from (select unnest({list(NAMES)}) d) where lower({HOST}) = d or suffix(lower({HOST}), '.' || d))""")
def blocklisted_server_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TLS server names in upper case against the domain list."""
    hello = catalogue._tls(spark, sf_dir).withColumn("tls_sni", F.upper("tls_sni"))
    return detect.blocklisted_domain(hello, match.of_lists(spark, (), NAMES).domains).select("packet_id", "detail")


@query(f"""{PKT}, c as (select *, substr('event ' || packet_id, 1, 512) b from pkt), hit as (select *, case when contains(b, 'event 7') then 'event 7' when contains(b, 'event') then 'event' end w from c)
  select packet_id, 'keyword_match' as type, 'Matched keyword: event' detail from hit""")
def keyword_match_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword and domain checks of the legacy profile over decoded frames."""
    packets = decode.legacy(catalogue._frames(spark, sf_dir))
    found = detect.alerts(packets, match.of_lists(spark, (), NAMES, ("event 7", "event")), ScanConfig.of(profile="legacy", portscan_threshold=2048))
    return found.where("type = 'keyword_match'").select("packet_id", "type", "detail")


@query(f"select page_id packet_id, 'blocklisted_domain' as type, 'Matched domain blocklist: ' || lower({HOST}) detail from pages where exists (select 1 from (select unnest({list(NAMES)}) d) where lower({HOST}) = d or suffix(lower({HOST}), '.' || d))")
def blocklisted_domain_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, c.UDP, 40000, 53)
    packets = decode.legacy(adapter.framed(rows, F.unhex(F.concat(F.lit("000101000001000000000000"), _question(F.upper("host"))))))
    found = detect.alerts(packets, match.of_lists(spark, (), NAMES), ScanConfig.of(profile="legacy", portscan_threshold=2048))
    return found.select("packet_id", "type", "detail")


# --- text functions


@query("""select page_id, trim(x, E' \\t\\r\\n') trimmed, starts_with(url, 'https://b') secure, substr(to_json(x)::varchar, 2, length(to_json(x)::varchar) - 2) escaped
  from (select page_id, url, chr(9) || ' ' || url || '"' || chr(92) || chr(10) || ' ' x from pages)""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.concat(F.lit("\t "), "url", F.lit('"\\\n '))
    return adapter.table(spark, sf_dir, "pages").select("page_id", c.trim_blank(x).alias("trimmed"), c.starts_with("url", "https://b").alias("secure"), c.json_escape(x).alias("escaped"))


# --- results as files, and back


def _written(spark: SparkSession, sf_dir: str, empty: bool = False) -> str:
    scan = catalogue._scan(spark, sf_dir, enable_carving=True)
    folder = _folder(spark)
    results.write(Scan(scan.packets.where(F.lit(False)), scan.ioc, scan.cfg) if empty else scan, folder)
    return folder


@query(f"{_KINDS} select type, pkt.src_ip, detail, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%SZ') as time, ts, pkt.src_port, pkt.dst_port from a join pkt using (packet_id)")
def alerts_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = results.read_alerts(spark, f"{_written(spark, sf_dir)}/alerts.ndjson")
    return found.select("type", "src_ip", "detail", "time", "ts", "src_port", "dst_port")


@query(f"{PKT}, {FLOW} select * from flow")
def flows_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    results.write(Scan(adapter.events(spark, sf_dir), match.of_lists(spark), ScanConfig()), folder)
    return results.read_flows(spark, f"{folder}/flows.csv")


_COUNTED = ("world_size", *COUNTER_NAMES, *ALERT_NAMES, "files_carved", "credentials_found")


@query(f"select {', '.join(_COUNTED)}, top_http_hosts from ({SUMMARY})")
def summary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = results.read_summary(f"{_written(spark, sf_dir)}/summary.json")
    hosts = ",".join(f"{x['key']}={x['count']}" for x in row["top_http_hosts"])
    return spark.createDataFrame([(*(row[k] for k in _COUNTED), hosts)], f"world_size int, {', '.join(f'{k} long' for k in _COUNTED[1:])}, top_http_hosts string")


@query("select 1::int world_size, 0::bigint packets, 0::bigint alerts_total, 0::bigint flows, 0::bigint files")
def empty_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of no packets: a summary of zeros, no alerts, flows of a header only, no logs."""
    folder = _written(spark, sf_dir, empty=True)
    row = results.read_summary(f"{folder}/summary.json")
    flows, alerts = results.read_flows(spark, f"{folder}/flows.csv").count(), results.read_alerts(spark, f"{folder}/alerts.ndjson").count()
    return spark.createDataFrame([(row["world_size"], row["packets"], row["alerts_total"] + alerts, flows, row["files_carved"])], "world_size int, packets long, alerts_total long, flows long, files long")


@query(f"""{PKT} select 'event ' || packet_id strings, {catalogue.PROTO} proto from pkt union all select 'event ' || packet_id, {catalogue.PROTO} from pkt where packet_id % 2 = 0""")
def merged_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload logs of two scans read together, a line that is no JSON left out."""
    log = logs.payload(decode.decoded(catalogue._frames(spark, sf_dir))).withColumn("strings", F.array_join("strings", "|"))
    folder = _folder(spark)
    for k, part in enumerate((log, log.where("packet_id % 2 = 0"))):
        part.select(results.ndjson(part, "ts", "strings", "proto")).write.text(f"{folder}/scan{k}/payload.jsonl")
    spark.createDataFrame([("{broken",)], "value string").coalesce(1).write.text(f"{folder}/scan2/payload.jsonl")
    return results.read_log(spark, f"{folder}/*/payload.jsonl").select("strings", "proto")


# --- views


_CARDS = {k: _listed(*x).replace("limit 50", "limit 10") for k, x in {
    "top_src_bytes": ("src_ip", "sum(raw_len)", "pkt", "src"), "top_http_hosts": ("host", "count(*)", "pkt", "host", "host <> ''"),
}.items()}


@query(f"with recursive {adapter.EVERYTHING} select (select count(*) from pkt)::bigint ipv4, {', '.join(f'{v} {k}' for k, v in _CARDS.items())}")
def summary_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary with its lists cut to ten, ties among those that the summary has."""
    cards = views.summary_cards(catalogue._scan(spark, sf_dir).summary)
    return catalogue._texts(cards).select("ipv4", *_CARDS)


@query(f"""select substr(sha256(substr({HTML}, 1, 65536)), 1, 16) || '.html' filename, 'text/html' content_type, length({HTML})::int size, '93.184.216.' || (page_id % 7) src_ip from pages where length({HTML}) >= 16""")
def files_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.files(logs.carved(catalogue._http(spark, sf_dir))).select("filename", "content_type", "size", "src_ip")


@query(f"with {adapter.EVENTS} select packet_id, src_ip, 'ftp' protocol, {REDACT.format('u')} || ':' || {REDACT.format('p')} credential from (select *, 'name' || packet_id u, substr('abcdefghijkl', 1, (packet_id % 12)::int) p from pkt where src_port <> 8080)")
def credentials_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.credentials(detect.credentials(catalogue._ftp(spark, sf_dir))).select("packet_id", "src_ip", "protocol", "credential")


@query(f"select page_id packet_id, lower({HOST}) queries from pages order by page_id limit 100")
def dns_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.log_head(logs.dns(catalogue._dns(spark, sf_dir))).select("packet_id", F.array_join("queries", "|").alias("queries"))
