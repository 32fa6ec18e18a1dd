"""The SQL that checks each query, for DuckDB on the same tables.

Each statement is put together from named common table expressions. They are
written from the rules, row by row: longest-prefix match is a range join, counts
are taken from exploded rows, nothing is merged beforehand.
"""

from __future__ import annotations

from verification.tables import ASN_VIEW_SQL, DNS_LINES_SQL, DNS_LOG_SQL, ODD_NAME, VIEW_LINES_SQL

OCTET = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IPV4 = rf"{OCTET}(\.{OCTET}){{3}}"
SUFFIXES = (
    "co.hu co.id co.il co.in co.jp co.kr co.nz co.th co.uk co.ve co.za "
    "com.ar com.au com.bd com.br com.co com.com com.do com.ec com.eg com.hk com.kw "
    "com.ly com.mx com.my com.ng com.pe com.ph com.pk com.sa com.sg com.tr com.tw "
    "com.ua com.vn net.gr org.uk"
).split()


def sld(name: str) -> str:
    bare = f"regexp_replace({name}, '\\.$', '')"
    labels = f"string_split({bare}, '.')"
    two = f"array_to_string({labels}[-2:], '.')"
    listed = ", ".join(f"'{suffix}'" for suffix in SUFFIXES)
    return (
        f"CASE WHEN {name} = '' THEN NULL WHEN {two} IN ({listed}) "
        f"THEN array_to_string({labels}[-3:], '.') ELSE {two} END"
    )


def ip_number(ip: str) -> str:
    parts = [f"CAST(string_split({ip}, '.')[{i}] AS bigint)" for i in (1, 2, 3, 4)]
    return f"(({parts[0]} * 256 + {parts[1]}) * 256 + {parts[2]}) * 256 + {parts[3]}"


def counters(keys: str, entries: list[tuple[str, str, str, str]]) -> str:
    """Union of (feature, value expression, weight, source) counted per keys."""
    parts = [
        f"SELECT {keys}, '{feature}' AS feature, CAST({value} AS varchar) AS value, {n} AS w FROM {source}"
        for feature, value, n, source in entries
    ]
    return (
        f"SELECT {keys}, feature, value, CAST(sum(w) AS bigint) AS n "
        f"FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"
    )


PERCENTILES = "(VALUES (0), (5), (25), (50), (75), (95), (100))"


def percentiles(source: str, column: str) -> str:
    points = ", ".join(
        f"({p}, (SELECT quantile_cont({column}, {p / 100}) FROM {source}))"
        for p in (0, 5, 25, 50, 75, 95, 100)
    )
    return f"SELECT pct, round(CAST(value AS double), 9) AS value FROM (VALUES {points}) AS t(pct, value)"


def cutoffs(source: str) -> str:
    """Cut-off rule on ``domain, feature, value, n`` rows, by windows."""
    return f"""
    SELECT t.domain, t.feature, coalesce(max(r.n) FILTER (r.rank = t.k), 0) AS cutoff
    FROM (
      SELECT domain, feature, CAST(floor(q3 + 1.5 * (q3 - q1)) AS bigint) AS k FROM (
        SELECT domain, feature,
               min_by(rank - 1 + (0.25 - before) / share, rank) FILTER (upto >= 0.25) AS q1,
               min_by(rank - 1 + (0.75 - before) / share, rank) FILTER (upto >= 0.75) AS q3
        FROM (
          SELECT *, coalesce(sum(share) OVER (PARTITION BY domain, feature ORDER BY rank
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                 sum(share) OVER (PARTITION BY domain, feature ORDER BY rank
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
          FROM (
            SELECT domain, feature, n,
                   row_number() OVER (PARTITION BY domain, feature ORDER BY n DESC, value) - 1 AS rank,
                   CAST(n AS double) / CAST(sum(n) OVER (PARTITION BY domain, feature) AS double) AS share
            FROM {source}))
        GROUP BY ALL)) t
    JOIN (SELECT domain, feature, n,
                 row_number() OVER (PARTITION BY domain, feature ORDER BY n DESC, value) - 1 AS rank
          FROM {source}) r ON r.domain = t.domain AND r.feature = t.feature
    GROUP BY ALL"""


def json_map(feature: str) -> str:
    body = (
        "string_agg('\"' || value || '\":' || n, ',' ORDER BY value) "
        f"FILTER (feature = '{feature}')"
    )
    return escaped(f"'{{' || {body} || '}}'")


def json_list(feature: str) -> str:
    body = f"string_agg('\"' || value || '\"', ',' ORDER BY value) FILTER (feature = '{feature}')"
    return escaped(f"'[' || coalesce({body}, '') || ']'")


def escaped(document: str) -> str:
    return f"""'"' || replace(replace({document}, '"', '""'), ',', ';') || '"'"""


RESPONSES_OF_PAIR = "CAST(sum(n) FILTER (feature = 'clen') AS bigint)"

# name -> (body, names it reads)
TABLES: dict[str, tuple[str, list[str]]] = {
    "dns_log": (DNS_LOG_SQL.format(lineitem="lineitem", orders="orders"), []),
    "asn_text": (ASN_VIEW_SQL, []),
    "asn_view": (
        f"""SELECT {ip_number('network')} AS low,
            {ip_number('network')} + CAST(pow(2, 32 - prefix_len) AS bigint) - 1 AS high,
            prefix_len, asn FROM asn_text""",
        ["asn_text"],
    ),
    "dns_lines": (DNS_LINES_SQL.format(dns_log="dns_log"), ["dns_log"]),
    "line_fields": (
        """SELECT id, list_transform(string_split(array_to_string(list_transform(
             string_split(line, '"'),
             lambda piece, i: CASE WHEN i % 2 = 0 THEN replace(piece, ',', chr(2)) ELSE piece END), ''), ','),
             lambda field: replace(field, chr(2), ',')) AS f FROM dns_lines""",
        ["dns_lines"],
    ),
    "parsed_lines": (
        """SELECT id, len(f) AS n_fields, CASE WHEN len(f) = 45 THEN
             {'resolver': f[5], 'client': f[6], 'qname': f[12], 'rcode': f[16], 'rd': f[19], 'ra': f[20],
              'dans': f[25], 'danttls': f[26]}
           WHEN len(f) = 49 THEN
             {'resolver': f[7], 'client': f[6], 'qname': f[15], 'rcode': f[19], 'rd': f[22], 'ra': f[23],
              'dans': f[28], 'danttls': f[29]} END AS r FROM line_fields""",
        ["line_fields"],
    ),
    # Successful recursive responses with their answer taken apart.
    "profile": (
        rf"""SELECT *, row_number() OVER () AS rid,
             list_filter(records, lambda r: regexp_full_match(r, '{IPV4}')) AS ips,
             list_distinct(list_filter(records, lambda r: regexp_full_match(r, '{IPV4}'))) AS sips
           FROM (SELECT *, lower(qname) AS domain, string_split(dans, '|-><-|') AS records,
                   TRY_CAST(string_split(danttls, ',')[-1] AS bigint) AS ttl_last,
                   list_transform(string_split(danttls, ','), lambda t: TRY_CAST(t AS bigint)) AS ttls
                 FROM dns_log WHERE rcode = 'NOERROR' AND rd = '1' AND ra = '1')""",
        ["dns_log"],
    ),
    "ips": ("SELECT DISTINCT unnest(sips) AS ip FROM profile", ["profile"]),
    "routes": (
        f"""SELECT ip, max_by(asn, prefix_len) AS route
            FROM (SELECT ip, {ip_number('ip')} AS number FROM ips) i
            LEFT JOIN asn_view v ON i.number BETWEEN v.low AND v.high GROUP BY ip""",
        ["ips", "asn_view"],
    ),
    "labels": (
        """SELECT ip, CASE WHEN starts_with(ip, '127.0.') THEN ip
             ELSE coalesce(route, split_part(ip, '.', 1) || '.' || split_part(ip, '.', 2) || '.0.0') END AS asn,
             coalesce(route, 'None') AS asn_raw FROM routes""",
        ["routes"],
    ),
    "answers": (
        """SELECT p.*, l.asn, l.asn_raw FROM (SELECT *, unnest(sips) AS ip FROM profile) p
           JOIN labels l ON p.ip = l.ip""",
        ["profile", "labels"],
    ),
    # (resolver, domain) level.
    "judged": (
        "SELECT * FROM profile WHERE len(ips) > 0 AND ttl_last IS NOT NULL",
        ["profile"],
    ),
    "judged_answers": ("SELECT * FROM answers WHERE ttl_last IS NOT NULL", ["answers"]),
    "pair_counts": (
        "SELECT resolver, domain, count(*) AS n FROM judged GROUP BY ALL",
        ["judged"],
    ),
    "pair_features": (
        counters(
            "resolver, domain",
            [
                ("ttl", "ttl_last", "1", "judged"),
                ("clen", "len(records) - len(ips)", "1", "judged"),
                ("nip", "len(ips)", "1", "judged"),
                ("asn", "asn", "1", "judged_answers"),
                ("sip", "ip", "1", "judged_answers"),
            ],
        ),
        ["judged", "judged_answers"],
    ),
    "domain_counters": (
        """SELECT domain, feature, value, CAST(sum(n) AS bigint) AS n
           FROM pair_features GROUP BY ALL""",
        ["pair_features"],
    ),
    "ranked_values": (
        """SELECT *, row_number() OVER (PARTITION BY domain, feature ORDER BY n DESC, value) - 1 AS rank
           FROM categorical""",
        ["categorical"],
    ),
    "considered": (
        """SELECT domain, CAST(sum(n) AS bigint) AS n FROM pair_counts
           GROUP BY domain HAVING sum(n) > 100""",
        ["pair_counts"],
    ),
    "max_ttls": (
        """SELECT resolver, domain, CAST(ceil(max(ttl_last) / 5) * 5 AS bigint) AS max_ttl
           FROM judged GROUP BY ALL""",
        ["judged"],
    ),
    "fences": (
        """SELECT domain, round(quantile_cont(max_ttl, 0.75)
             + 1.5 * (quantile_cont(max_ttl, 0.75) - quantile_cont(max_ttl, 0.15)), 9) AS fence
           FROM max_ttls GROUP BY domain""",
        ["max_ttls"],
    ),
    "categorical": (
        "SELECT * FROM domain_counters WHERE feature IN ('clen', 'nip', 'asn')",
        ["domain_counters"],
    ),
    "cutoffs": (cutoffs("categorical"), ["categorical"]),
    "ttl_flags": (
        """SELECT j.resolver, j.domain, 'ttl' AS feature FROM judged j
           JOIN fences f ON f.domain = j.domain JOIN considered c ON c.domain = j.domain
           GROUP BY ALL HAVING count(*) FILTER (j.ttl_last <= f.fence) = 0""",
        ["judged", "fences", "considered"],
    ),
    "feature_flags": (
        """SELECT p.resolver, p.domain, p.feature FROM pair_features p
           JOIN considered c ON c.domain = p.domain
           JOIN cutoffs k ON k.domain = p.domain AND k.feature = p.feature
           JOIN domain_counters g ON g.domain = p.domain AND g.feature = p.feature AND g.value = p.value
           GROUP BY ALL HAVING count(*) FILTER (g.n >= k.cutoff) = 0""",
        ["pair_features", "considered", "cutoffs", "domain_counters"],
    ),
    "pair_anomalies": (
        """SELECT resolver, domain, string_agg(feature, ':' ORDER BY
             CASE feature WHEN 'ttl' THEN 1 WHEN 'clen' THEN 2 WHEN 'nip' THEN 3 ELSE 4 END) AS types
           FROM (SELECT * FROM ttl_flags UNION ALL SELECT * FROM feature_flags) GROUP BY ALL""",
        ["ttl_flags", "feature_flags"],
    ),
    # Learned thresholds.
    "normal": (
        f"""SELECT a.*, {sld('a.domain')} AS sld FROM answers a
            ANTI JOIN pair_anomalies x ON a.resolver = x.resolver AND a.domain = x.domain""",
        ["answers", "pair_anomalies"],
    ),
    "asn_slds": (
        "SELECT asn, count(DISTINCT sld) AS n_sld FROM normal WHERE sld IS NOT NULL GROUP BY asn",
        ["normal"],
    ),
    "asn_sld_counts": (
        "SELECT asn_raw, sld, count(*) AS n FROM normal WHERE sld IS NOT NULL GROUP BY ALL",
        ["normal"],
    ),
    # (resolver, network) level.
    "linked_answers": (
        "SELECT * FROM answers WHERE len(list_filter(ttls, lambda t: t IS NULL)) = 0",
        ["answers"],
    ),
    "links": (
        """SELECT DISTINCT ON (rid, asn) * FROM linked_answers""",
        ["linked_answers"],
    ),
    "link_counts": ("SELECT resolver, asn, count(*) AS n FROM links GROUP BY ALL", ["links"]),
    "link_ttls": ("SELECT resolver, asn, unnest(ttls) AS ttl FROM links", ["links"]),
    "link_features": (
        counters(
            "resolver, asn",
            [
                ("queries", "qname", "1", "links"),
                ("clen", "len(records) - len(ips)", "1", "links"),
                ("nip", "len(sips)", "1", "links"),
                ("ttl", "ttl", "1", "link_ttls"),
                ("servers", "ip", "1", "linked_answers"),
            ],
        ),
        ["links", "link_ttls", "linked_answers"],
    ),
    "link_slds": (
        f"""SELECT resolver, asn, count(DISTINCT qname) AS n_queries, count(DISTINCT {sld('qname')}) AS n_sld
            FROM links GROUP BY ALL""",
        ["links"],
    ),
    "link_servers": (
        """SELECT resolver, asn, string_agg(DISTINCT ip, ':' ORDER BY ip) AS servers
           FROM linked_answers GROUP BY ALL""",
        ["linked_answers"],
    ),
    "link_fixed": (
        """SELECT c.resolver, c.asn, c.n, coalesce(f.fixed, '') AS fixed, coalesce(f.n_fixed, 0) AS n_fixed
           FROM link_counts c LEFT JOIN (
             SELECT resolver, asn, count(*) AS n_fixed, string_agg(name, ':' ORDER BY
               CASE name WHEN 'ttl' THEN 1 WHEN 'cname' THEN 2 ELSE 3 END) AS fixed
             FROM (SELECT resolver, asn, CASE feature WHEN 'clen' THEN 'cname' ELSE feature END AS name
                   FROM link_features WHERE feature IN ('ttl', 'clen', 'nip')
                   GROUP BY ALL HAVING count(DISTINCT value) = 1) GROUP BY ALL) f
           ON f.resolver = c.resolver AND f.asn = c.asn""",
        ["link_counts", "link_features"],
    ),
    "suspicious": (
        """SELECT x.resolver, x.asn, x.n, s.n_sld, x.fixed FROM link_fixed x
           JOIN link_slds s ON s.resolver = x.resolver AND s.asn = x.asn
           WHERE x.n_fixed > 1
             AND round(x.n / nullif(s.n_sld, 0), 9) > (SELECT round(quantile_cont(n, 0.5), 9) FROM asn_sld_counts)
             AND s.n_sld > (SELECT round(quantile_cont(n_sld, 0.5), 9) FROM asn_slds)""",
        ["link_fixed", "link_slds", "asn_sld_counts", "asn_slds"],
    ),
    "confirmed": (
        """SELECT DISTINCT l.resolver, l.qname AS domain, l.asn, v.servers, s.fixed AS fixed_features
           FROM links l
           JOIN suspicious s ON s.resolver = l.resolver AND s.asn = l.asn
           JOIN link_servers v ON v.resolver = l.resolver AND v.asn = l.asn
           SEMI JOIN pair_anomalies a ON a.resolver = l.resolver AND a.domain = l.qname""",
        ["links", "suspicious", "link_servers", "pair_anomalies"],
    ),
    # Resolvers.
    "resolver_values": (
        counters(
            "resolver",
            [
                ("queries", "qname", "1", "profile"),
                ("clients", "client", "1", "profile"),
                ("servers", "ip", "1", "answers"),
                ("asns", "asn", "1", "answers"),
            ],
        ),
        ["profile", "answers"],
    ),
    "stats": (
        """SELECT resolver, CAST(sum(n) FILTER (feature = 'queries') AS bigint) AS count,
             count(*) FILTER (feature = 'clients') AS clients,
             count(*) FILTER (feature = 'queries') AS queried_domains,
             count(*) FILTER (feature = 'servers') AS returned_servers,
             count(*) FILTER (feature = 'asns') AS returned_asns
           FROM resolver_values GROUP BY resolver""",
        ["resolver_values"],
    ),
    # Wide cases straight from lineitem.
    "skewed_values": (
        """SELECT l_suppkey % 20 AS domain, 'wide' AS feature,
             CAST(floor(l_quantity * l_quantity * l_linenumber / 600) AS bigint) AS value, count(*) AS n
           FROM lineitem GROUP BY ALL""",
        [],
    ),
    "uniform_values": (
        """SELECT l_suppkey % 20 AS domain, 'wide' AS feature, CAST(l_quantity AS bigint) AS value,
             count(*) AS n FROM lineitem GROUP BY ALL""",
        [],
    ),
}


def statement(final: str, *reads: str) -> str:
    """``final`` preceded by the table expressions it needs, in order of use."""
    needed: list[str] = []

    def visit(name: str) -> None:
        for inner in TABLES[name][1]:
            visit(inner)
        if name not in needed:
            needed.append(name)

    for name in reads:
        visit(name)
    if not needed:
        return final
    heads = ",\n".join(f"{name} AS MATERIALIZED ({TABLES[name][0]})" for name in needed)
    return f"WITH {heads}\n{final}"


def all_of(name: str) -> str:
    return statement(f"SELECT * FROM {name}", name)


ORACLES: dict[str, str] = {
    "split_fields": statement(
        "SELECT id, len(f) AS n_fields, array_to_string(f, chr(9)) AS fields FROM line_fields",
        "line_fields",
    ),
    "dns_responses": statement(
        """SELECT id, r.resolver, r.client, r.qname, r.rcode, r.rd, r.ra, r.dans, r.danttls,
             lower(r.qname) AS domain FROM parsed_lines
           WHERE r IS NOT NULL AND r.rcode = 'NOERROR' AND r.rd = '1' AND r.ra = '1'""",
        "parsed_lines",
    ),
    "rejected_rows": statement(
        rf"""SELECT reason, CAST(coalesce(sum(CAST(hit AS int)), 0) AS bigint) AS n FROM (
               SELECT unnest([
                 {{'reason': 'field_count', 'hit': r IS NULL}},
                 {{'reason': 'last_ttl',
                   'hit': judged AND TRY_CAST(string_split(r.danttls, ',')[-1] AS bigint) IS NULL}},
                 {{'reason': 'any_ttl', 'hit': judged AND len(list_filter(string_split(r.danttls, ','),
                   lambda t: TRY_CAST(t AS bigint) IS NULL)) > 0}},
                 {{'reason': 'empty_name', 'hit': judged AND r.qname = ''}}], recursive := true)
               FROM (SELECT *, r.rcode = 'NOERROR' AND r.rd = '1' AND r.ra = '1' AND
                       len(list_filter(string_split(r.dans, '|-><-|'),
                                       lambda x: regexp_full_match(x, '{IPV4}'))) > 0 AS judged
                     FROM parsed_lines))
             GROUP BY reason""",
        "parsed_lines",
    ),
    "answer_records": statement(
        rf"""SELECT id, pos, record, CAST(regexp_full_match(record, '{IPV4}') AS int) AS is_ipv4
             FROM (SELECT id, unnest(range(len(records))) AS pos, unnest(records) AS record FROM profile)""",
        "profile",
    ),
    "answer_profile": statement(
        """SELECT id, len(records) - len(ips) AS clen, len(ips) AS nip,
             array_to_string(list_sort(sips), ':') AS sips FROM profile WHERE len(ips) > 0""",
        "profile",
    ),
    "answer_profile_asn": statement(
        """SELECT id, len(records) - len(ips) AS cnames, len(sips) AS n_servers,
             array_to_string(list_sort(sips), ':') AS sips FROM profile""",
        "profile",
    ),
    "ttl_last": statement(
        "SELECT id, TRY_CAST(string_split(danttls, ',')[-1] AS bigint) AS ttl_last FROM dns_log",
        "dns_log",
    ),
    "ttl_all": statement(
        """SELECT id, array_to_string(list_transform(t, lambda x: coalesce(CAST(x AS varchar), '?')), ',') AS ttls,
             CAST(len(list_filter(t, lambda x: x IS NULL)) = 0 AS int) AS ttls_ok
           FROM (SELECT id, list_transform(string_split(danttls, ','),
                   lambda x: TRY_CAST(x AS bigint)) AS t FROM dns_log)""",
        "dns_log",
    ),
    "sld": statement(
        f"SELECT DISTINCT qname AS name, {sld('qname')} AS sld FROM dns_log", "dns_log"
    ),
    "sld_pages": f"""
        SELECT {sld('host')} AS sld, count(*) AS n
        FROM (SELECT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages) GROUP BY ALL""",
    "ip_asn": statement("SELECT ip, asn FROM labels", "labels"),
    "ip_asn_raw": statement("SELECT ip, asn_raw FROM labels", "labels"),
    "res_dom_counts": all_of("pair_counts"),
    "res_dom_features": all_of("pair_features"),
    "domain_features": all_of("domain_counters"),
    "value_global_freq": statement(
        """SELECT p.*, g.n AS global_n FROM pair_features p JOIN domain_counters g
           ON g.domain = p.domain AND g.feature = p.feature AND g.value = p.value""",
        "pair_features",
        "domain_counters",
    ),
    "value_rank": all_of("ranked_values"),
    "value_cum_share": statement(
        """SELECT domain, feature, value, n, rank, round(n / total, 9) AS share,
             round(upto / total, 9) AS cum_share, round((upto - n) / total, 9) AS prev_cum
           FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY domain, feature) AS bigint) AS total,
                   CAST(sum(n) OVER (PARTITION BY domain, feature ORDER BY rank
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bigint) AS upto
                 FROM ranked_values)""",
        "ranked_values",
    ),
    "considered_domains": all_of("considered"),
    "res_dom_max_ttl": all_of("max_ttls"),
    "ttl_fence": all_of("fences"),
    "ttl_fence_wide": """
        SELECT domain, round(quantile_cont(max_ttl, 0.75)
          + 1.5 * (quantile_cont(max_ttl, 0.75) - quantile_cont(max_ttl, 0.15)), 9) AS fence
        FROM (SELECT l_orderkey % 997 AS resolver, l_partkey % 20 AS domain,
                CAST(ceil(max(l_quantity) / 5) * 5 AS bigint) AS max_ttl FROM lineitem GROUP BY ALL)
        GROUP BY domain""",
    "freq_cutoff": all_of("cutoffs"),
    "freq_cutoff_skewed": statement(cutoffs("skewed_values"), "skewed_values"),
    "freq_cutoff_uniform": statement(cutoffs("uniform_values"), "uniform_values"),
    "ttl_anomalies": all_of("ttl_flags"),
    "feature_anomalies": all_of("feature_flags"),
    "anomalies_res_dom": all_of("pair_anomalies"),
    "sld_per_asn": all_of("asn_slds"),
    "count_per_asn_sld": all_of("asn_sld_counts"),
    "params_sld_asn": statement(
        f"SELECT pct, round(value, 6) AS value FROM ({percentiles('asn_slds', 'n_sld')})", "asn_slds"
    ),
    "params_sld_count": statement(
        f"SELECT pct, round(value, 6) AS value FROM ({percentiles('asn_sld_counts', 'n')})",
        "asn_sld_counts",
    ),
    "params_json": statement(
        f"""SELECT '{{"SLD_ASN":[' || (SELECT string_agg('[' || CAST(CAST(pct AS double) AS varchar) || ','
               || CAST(value AS varchar) || ']', ',' ORDER BY pct) FROM ({percentiles('asn_slds', 'n_sld')}))
             || '],"SLD_COUNT":[' || (SELECT string_agg('[' || CAST(CAST(pct AS double) AS varchar) || ','
               || CAST(value AS varchar) || ']', ',' ORDER BY pct) FROM ({percentiles('asn_sld_counts', 'n')}))
             || ']}}' AS value""",
        "asn_slds",
        "asn_sld_counts",
    ),
    "res_asn_counts": all_of("link_counts"),
    "res_asn_features": all_of("link_features"),
    "res_asn_slds": all_of("link_slds"),
    "res_asn_servers": all_of("link_servers"),
    "fixed_features": statement("SELECT resolver, asn, n, fixed FROM link_fixed", "link_fixed"),
    "suspicious_res_asn": statement(
        """SELECT s.*, v.servers FROM suspicious s JOIN link_servers v
           ON v.resolver = s.resolver AND v.asn = s.asn""",
        "suspicious",
        "link_servers",
    ),
    "anomalies_res_asn": all_of("confirmed"),
    "res_profile": statement(
        """SELECT resolver, CAST(sum(n) FILTER (feature = 'queries') AS bigint) AS n,
             coalesce(string_agg(value, ':' ORDER BY value) FILTER (feature = 'clients'), '') AS clients,
             coalesce(string_agg(value, ':' ORDER BY value) FILTER (feature = 'queries'), '') AS queries,
             coalesce(string_agg(value, ':' ORDER BY value) FILTER (feature = 'servers'), '') AS servers,
             coalesce(string_agg(value, ':' ORDER BY value) FILTER (feature = 'asns'), '') AS asns
           FROM resolver_values GROUP BY resolver""",
        "resolver_values",
    ),
    "resolver_stats": all_of("stats"),
    "final_report": statement(
        """SELECT s.resolver, s.queried_domains, s.count, s.clients, coalesce(m.asn, '-') AS asn,
             coalesce(m.domains, '-') AS domains, coalesce(m.servers, '-') AS servers
           FROM stats s LEFT JOIN (
             SELECT resolver, asn, string_agg(DISTINCT domain, ':' ORDER BY domain) AS domains,
               string_agg(DISTINCT servers, ':' ORDER BY servers) AS servers
             FROM confirmed GROUP BY ALL) m ON m.resolver = s.resolver
           ORDER BY s.queried_domains DESC, s.resolver DESC, s.count DESC, s.clients DESC, 5 DESC""",
        "stats",
        "confirmed",
    ),
    "export_res_dom": statement(
        f"""SELECT domain || ',' || resolver || ',' || {RESPONSES_OF_PAIR} || ',' ||
              {" || ',' || ".join(json_map(f) for f in ("clen", "nip", "asn", "ttl", "sip"))} AS value
            FROM pair_features GROUP BY resolver, domain""",
        "pair_features",
    ),
    "export_res_asn": statement(
        f"""SELECT resolver || ',' || asn || ',' || {RESPONSES_OF_PAIR} || ',' ||
              {" || ',' || ".join(json_map(f) for f in ("queries", "clen", "ttl", "nip", "servers"))} AS value
            FROM link_features GROUP BY resolver, asn""",
        "link_features",
    ),
    "export_res": statement(
        f"""SELECT resolver || ',' || CAST(sum(n) FILTER (feature = 'queries') AS bigint) || ',' ||
              {" || ',' || ".join(json_list(f) for f in ("clients", "queries", "servers", "asns"))} AS value
            FROM resolver_values GROUP BY resolver""",
        "resolver_values",
    ),
    "import_counters": all_of("pair_features"),
    "file_log": statement(
        """SELECT r.resolver, r.client, r.qname, r.rcode, r.rd, r.ra, r.dans, r.danttls,
             lower(r.qname) AS domain FROM parsed_lines
           WHERE r IS NOT NULL AND r.rcode = 'NOERROR' AND r.rd = '1' AND r.ra = '1'""",
        "parsed_lines",
    ),
    "file_asn_view": f"""
        SELECT {ip_number("string_split(prefix, '/')[1]")} AS network,
          CAST(string_split(prefix, '/')[2] AS int) AS prefix_len, asn
        FROM (SELECT string_split(value, chr(9))[1] AS prefix, string_split(value, chr(9))[2] AS asn
              FROM ({VIEW_LINES_SQL.format(supplier='supplier')}) WHERE value NOT LIKE ';%')
        WHERE regexp_full_match(string_split(prefix, '/')[1], '{IPV4}')
          AND CAST(string_split(prefix, '/')[2] AS int) BETWEEN 0 AND 32""",
    "file_anomalies_res_dom": statement(
        f"SELECT resolver, {ODD_NAME.format(name='domain')} AS domain, types FROM pair_anomalies", "pair_anomalies"
    ),
    "file_anomalies_res_asn": statement(
        f"""SELECT resolver, {ODD_NAME.format(name='domain')} AS domain, asn, servers, fixed_features
            FROM confirmed""",
        "confirmed",
    ),
}

ORACLES["file_report"] = f"""
SELECT resolver, CAST(queried_domains AS varchar) AS queried_domains, CAST(count AS varchar) AS count,
  CAST(clients AS varchar) AS clients, asn, {ODD_NAME.format(name='domains')} AS domains, servers
FROM ({ORACLES["final_report"]})"""
