"""The audit as one graph of operators over a log that is read once."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resolver_audit.operators import (
    detection,
    observations,
    profiles,
    report,
    responses,
    thresholds,
)
from resolver_audit.operators.routing import Routes
from resolver_audit.operators.skew import split_hot
from resolver_audit.plans.staging import Staging
from resolver_audit.settings import AuditSettings
from resolver_audit.sources import interchange

RESPONSE_COLUMNS = ["client", *observations.RESPONSE_KEY]

# Columns of the stored network rows; everything after the log scan needs only these.
NETWORK_COLUMNS = [
    "resolver",
    "qname",
    "domain",
    "dans",
    "asn",
    "asn_raw",
    "n",
    "n_ips",
    "lead",
    "clen",
    "nip",
    "n_servers",
    *observations.TTL_STATE,
]


class Audit:
    """All results of an audit of ``parsed`` responses against an ASN ``view``.

    Results are properties, built on first use. With ``staging``, the tables that
    several results share are written once; without, everything stays lazy.
    ``from_text`` says that ``parsed`` holds all lines of a text log, with ``n_fields``:
    the log is then condensed into one stored table, so that the text is read once.
    ``keep_ttls`` keeps in it what exported TTL counters need. ``once`` names tables that
    only one of the results asked for reads; these are not stored.
    """

    def __init__(
        self,
        parsed: DataFrame,
        view: DataFrame,
        settings: AuditSettings = AuditSettings(),
        staging: Staging | None = None,
        from_text: bool = False,
        keep_ttls: bool = False,
        once: tuple[str, ...] = (),
    ):
        self.parsed = parsed
        self.view = view
        self.settings = settings
        self.staging = staging
        self.from_text = from_text
        self.keep_ttls = keep_ttls
        self.once = once

    def _keep(self, name: str, frame: DataFrame) -> DataFrame:
        return self.staging.keep(name, frame) if self.staging and name not in self.once else frame

    @cached_property
    def routes(self) -> Routes:
        return Routes.of(self.view)

    @cached_property
    def condensed(self) -> DataFrame:
        """The text log in one table, each kind of rows in files of its own."""
        found = observations.condensed(self.parsed, self.keep_ttls)
        return self.staging.keep("condensed", found, "kind") if self.staging else found

    @cached_property
    def responses(self) -> DataFrame:
        return responses.recursive_success(self.parsed).select(*RESPONSE_COLUMNS)

    @cached_property
    def messages(self) -> DataFrame:
        """Distinct messages with their number; TTLs are merged."""
        if self.from_text:
            return observations.merged_messages(self.condensed)
        return observations.messages(self.responses)

    @cached_property
    def message_addresses(self) -> DataFrame:
        """One row per message and address."""
        return observations.addresses(self.messages, self.routes)

    @cached_property
    def distinct_responses(self) -> DataFrame:
        """Messages, with lists of TTLs kept apart, and their number."""
        if self.from_text and self.keep_ttls:
            return observations.kept_responses(self.condensed)
        return observations.merged_responses(self.responses)

    def _addresses_of(self, found: DataFrame) -> DataFrame:
        return observations.addresses(observations.with_state(found), self.routes)

    @cached_property
    def address_rows(self) -> DataFrame:
        """One row per message, list of TTLs and address, for exported TTL counters."""
        return self._addresses_of(self.distinct_responses)

    @cached_property
    def network_rows(self) -> DataFrame:
        """One row per message and network: the table behind all detection."""
        rows = observations.networks(self.messages, self.routes).select(*NETWORK_COLUMNS)
        return self._keep("network_rows", rows)

    @cached_property
    def clients(self) -> DataFrame:
        if self.from_text:
            return self.condensed.filter("kind = 'client'").select("resolver", F.col("name").alias("client"))
        return profiles.client_pairs(self.responses)

    @cached_property
    def rejected_rows(self) -> DataFrame:
        """Number of lines of a text log that were left out, by reason."""
        return responses.rejected_of(self.condensed.filter("kind = 'malformed'"), self.network_rows)

    # Unusual (resolver, domain) pairs.

    @cached_property
    def pair_profile(self) -> DataFrame:
        pairs = profiles.judged_pairs(self.network_rows)
        return self._keep("pair_profile", profiles.pair_profile(pairs))

    @cached_property
    def considered(self) -> DataFrame:
        domains = thresholds.considered_domains(self.pair_profile, self.settings.min_resolutions)
        return self._keep("considered", domains)

    @cached_property
    def considered_profile(self) -> DataFrame:
        return detection.of_considered(self.pair_profile, self.considered)

    @cached_property
    def ttl_ranges(self) -> DataFrame:
        return thresholds.ttl_ranges(self.considered_profile)

    @cached_property
    def pair_counters(self) -> DataFrame:
        return profiles.pair_counters(self.considered_profile)

    @cached_property
    def anomalies_res_dom(self) -> DataFrame:
        found = detection.find_anomalies_res_dom(
            self.pair_counters, self.ttl_ranges, self.settings
        )
        return self._keep("anomalies_res_dom", found)

    # Thresholds learned from the remaining traffic.

    @cached_property
    def network_slds(self) -> DataFrame:
        normal = detection.unflagged(self.network_rows, self.anomalies_res_dom)
        return self._keep("network_slds", detection.network_slds(normal))

    @cached_property
    def params(self) -> DataFrame:
        return self._keep("params", detection.learn_params(self.network_slds))

    # Confirmed manipulations.

    @cached_property
    def suspicious_res_asn(self) -> DataFrame:
        links = profiles.link_profile(self.network_rows, self.settings.fold_case)
        found = detection.suspicious_res_asn(links, self.params, self.settings.percentile_pick)
        return self._keep("suspicious_res_asn", found)

    @cached_property
    def suspicious_servers(self) -> DataFrame:
        """Address lists of the suspicious (resolver, network) only, looked up again for these."""
        rows = profiles.judged_links(self.network_rows).join(
            self.suspicious_res_asn.select(*profiles.LINK), profiles.LINK, "left_semi"
        )
        return profiles.address_lists(observations.addresses_in(rows, self.routes))

    @cached_property
    def evidence(self) -> DataFrame:
        """Address list and fixed features of each suspicious (resolver, network), once."""
        found = detection.evidence(self.suspicious_res_asn, self.suspicious_servers)
        return self._keep("evidence", found)

    @cached_property
    def confirmed(self) -> DataFrame:
        """Confirmed pairs, which refer to their evidence by (resolver, network)."""
        found = detection.confirmed_pairs(
            profiles.link_names(self.network_rows, self.settings.fold_case),
            self.suspicious_res_asn,
            detection.without_tags(self.anomalies_res_dom, self.settings.ignored_tags),
        )
        return self._keep("confirmed", found)

    @cached_property
    def anomalies_res_asn(self) -> DataFrame:
        """Confirmed pairs with their evidence in every row, as the file has it."""
        return detection.anomalies_res_asn(self.confirmed, self.evidence)

    # Counter tables in export form.

    @cached_property
    def pair_features(self) -> DataFrame:
        """Counters of every feature per (resolver, domain). Each result reads them once, so that they are not stored."""
        return profiles.res_dom_features(profiles.judged_pairs(self.address_rows))

    @cached_property
    def pair_features_by_domain(self) -> tuple[DataFrame, DataFrame]:
        """The same for names that are known: of ordinary domains, placed by domain, and of hot ones, placed by pair."""
        # Without missing names above all parts, so that these share one merged table of responses.
        named = self.distinct_responses.filter(F.lower("qname").isNotNull())
        ordinary, hot = map(self._addresses_of, split_hot(named, F.lower("qname")))
        of_ordinary = profiles.res_dom_features(profiles.judged_pairs(ordinary), by=("domain",))
        return of_ordinary, profiles.res_dom_features(profiles.judged_pairs(hot))

    @cached_property
    def res_dom_table(self) -> DataFrame:
        return interchange.res_dom_table(self.pair_features)

    @cached_property
    def _link_parts(self) -> list[DataFrame]:
        """Counters per (resolver, network): those of ordinary resolvers, placed by it, and those of hot ones."""
        ordinary, hot = map(self._addresses_of, split_hot(self.distinct_responses, F.col("resolver")))
        return [profiles.link_features(ordinary), profiles.link_features(hot, hot=True)]

    @cached_property
    def link_features(self) -> DataFrame:
        """Counters of every feature per (resolver, network)."""
        return reduce(DataFrame.unionByName, self._link_parts)

    @cached_property
    def resolver_values(self) -> DataFrame:
        """Everything each resolver was seen with. Its export reads it once, so that it is not stored."""
        return profiles.resolver_values(self.message_addresses, self.clients)

    @cached_property
    def res_asn_table(self) -> DataFrame:
        return reduce(DataFrame.unionByName, map(interchange.res_asn_table, self._link_parts))

    @cached_property
    def res_table(self) -> DataFrame:
        return profiles.res_profile(self.resolver_values)

    # Resolvers.

    @cached_property
    def resolver_stats(self) -> DataFrame:
        """Responses, clients, names, servers and networks of every resolver."""
        return profiles.resolver_stats(profiles.resolver_values(self.message_addresses, self.clients))

    @cached_property
    def report_stats(self) -> DataFrame:
        """The statistics shown in the report: responses, clients and names."""
        values = profiles.resolver_values(self.network_rows, self.clients, ("queries",))
        return profiles.resolver_stats(values, ("clients", "queries"))

    @cached_property
    def final_report(self) -> DataFrame:
        found = report.manipulations_of(self.confirmed, self.evidence)
        return report.final_report(self.report_stats, found)
