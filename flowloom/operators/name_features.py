"""Features of DNS names, response codes and answer times, and rules on flows.

All sums and counts combine map-side: the characters of names are counted in
fixed columns, names of a flow are made distinct before they are counted, and
sketches of flows are merged to those of clients without going back to names.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.columns import or_zero
from flowloom.operators.packets import FLOW_KEY, dns_packets, valid_packets

#: Fields of ``dns`` that the packets of a flow must carry (``assign_flows(extra=...)``).
NAME_FIELDS = ("rcode", "answer_ttls", "qnames")
# Characters of host names; all others count as one more.
CHARACTERS = string.ascii_lowercase + string.digits + "-_."
RCODE_NAME_ERROR = 3
# Bounds of the documented attack rules.
AMPLIFICATION, MANY_ANSWERS, FLOOD_PER_SECOND = 10.0, 10.0, 100.0
NAME_ERROR_SHARE, MANY_NAMES = 0.9, 1000


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def name_features(assigned: DataFrame, by: Sequence[str] = (*FLOW_KEY, "flow_no")) -> DataFrame:
    """Per flow: name lengths and entropy of queries, response codes, answer times to live.

    ``name_entropy`` is the Shannon entropy (bits) of all characters of the names
    asked for, ``nxdomain_rate`` the share of responses that say the name does not
    exist. Flows without DNS have zeros.
    """
    query, response = ~F.col("is_response"), F.col("is_response")
    name = F.when(query, F.array_join("qnames", ""))
    counts = {f"c{i}": F.length(name) - F.length(F.translate(name, c, "")) for i, c in enumerate(CHARACTERS)}
    lengths = F.when(query, F.transform("qnames", F.length))
    sums = assigned.groupBy(*by).agg(
        F.min("seq").alias("first_seq"),
        or_zero(F.sum(F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x))).alias("name_chars"),
        or_zero(F.sum(F.size(lengths))).alias("names"),
        or_zero(F.max(F.array_max(lengths))).cast("int").alias("name_length_max"),
        F.count_if(response).alias("responses"),
        F.count_if(response & (F.col("rcode") == RCODE_NAME_ERROR)).alias("name_errors"),
        F.count_if(response & (F.col("rcode") > 0)).alias("errors"),
        or_zero(F.sum(F.when(response, F.aggregate("answer_ttls", F.lit(0).cast("bigint"), lambda a, x: a + x)))).alias("ttl_total"),
        or_zero(F.sum(F.when(response, F.size("answer_ttls")))).alias("ttls"),
        *[or_zero(F.sum(count)).alias(alias) for alias, count in counts.items()],
    )
    total = F.col("name_chars").cast("double")
    known = sum((F.col(alias) for alias in counts), F.lit(0))
    each = [F.col(alias) for alias in counts] + [total - known]
    entropy = F.lit(0.0)
    for count in each:
        share = count / total
        entropy = entropy - F.when((total > 0) & (count > 0), share * F.log2(share)).otherwise(F.lit(0.0))
    return sums.select(
        *by,
        "first_seq",
        _ratio(F.col("name_chars"), F.col("names")).alias("name_length_mean"),
        "name_length_max",
        entropy.alias("name_entropy"),
        _ratio(F.col("name_errors"), F.col("responses")).alias("nxdomain_rate"),
        _ratio(F.col("errors"), F.col("responses")).alias("error_rate"),
        _ratio(F.col("ttl_total"), F.col("ttls")).alias("answer_ttl_mean"),
    )


def unique_names(rows: DataFrame, by: Sequence[str], name: str = "name") -> DataFrame:
    """Distinct names per key; pairs first, so that a hot key is spread over its names."""
    return rows.select(*by, name).distinct().groupBy(*by).agg(F.count(name).alias("unique_domains"))


def names_asked(assigned: DataFrame) -> DataFrame:
    """A row per name that a query of a flow asks for, with the client that asks."""
    client = F.when(F.col("rev"), F.col("ep_hi.ip")).otherwise(F.col("ep_lo.ip"))
    asked = assigned.filter(~F.col("is_response"))
    return asked.select(*FLOW_KEY, "flow_no", client.alias("client"), F.explode("qnames").alias("name"))


def name_sketches(asked: DataFrame, size: int = 12) -> DataFrame:
    """A mergeable sketch (2^``size`` registers) of the names of each flow and client."""
    return asked.groupBy(*FLOW_KEY, "flow_no", "client").agg(F.hll_sketch_agg("name", F.lit(size)).alias("sketch"))


def clients_of_sketches(sketches: DataFrame) -> DataFrame:
    """Estimated distinct names per client, from the sketches of its flows."""
    merged = sketches.groupBy("client").agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select("client", F.hll_sketch_estimate("sketch").alias("estimated_domains"))


def names_of_clients(packets: DataFrame) -> DataFrame:
    """Exact distinct names per client over all its queries."""
    queries = dns_packets(valid_packets(packets)).filter(~F.col("dns.qr"))
    rows = queries.select(F.col("src_ip").alias("client"), F.explode("dns.qnames").alias("name"))
    return unique_names(rows, ["client"])


def attack_type(
    amplification: float = AMPLIFICATION,
    answers: float = MANY_ANSWERS,
    per_second: float = FLOOD_PER_SECOND,
    name_errors: float = NAME_ERROR_SHARE,
    many_names: int = MANY_NAMES,
) -> Column:
    """The first rule that a flow with name features meets, else NULL.

    Flood: more queries a second than the bound and fewer responses than half of
    them. Spoofing: responses nobody asked for, whose amplification has no meaning. Handshake flood: packets to TCP port
    53 above the bound that are never answered; flags are not decoded.
    """
    per_query = F.col("dns_mean_answers_per_query")
    queries, responses = F.col("dns_total_queries"), F.col("dns_total_responses")
    to_tcp = (F.col("protocol") == "TCP") & (F.col("dst_port") == 53)
    return (
        F.when(to_tcp & (F.col("total_bwd_packets") == 0) & (F.col("flow_packets_per_sec") > per_second), "handshake flood")
        .when((F.col("nxdomain_rate") >= name_errors) & (F.col("unique_domains") >= many_names), "water torture")
        .when((queries == 0) & (responses > 0), "spoofing")
        .when(F.col("dns_amplification_factor") > amplification, "amplification")
        .when((per_query > answers) & (F.col("error_rate") == 0), "reflection")
        .when((F.col("dns_queries_per_second") > per_second) & (responses * 2 < queries), "query flood")
    )


def with_attack_type(flows: DataFrame, features: DataFrame, names: DataFrame, key: Sequence[str], **bounds) -> DataFrame:
    """Flows with their name features, distinct names and ``attack_type``; all three tables have ``key``."""
    joined = flows.join(features, list(key), "left").join(names, list(key), "left")
    filled = joined.na.fill(0, ["nxdomain_rate", "error_rate", "unique_domains"])
    return filled.withColumn("attack_type", attack_type(**bounds))


def floods(flows: DataFrame, per_second: float = FLOOD_PER_SECOND, amplification: float = AMPLIFICATION) -> DataFrame:
    """Flows above the documented bounds for queries a second or amplification."""
    return flows.filter((F.col("dns_queries_per_second") > per_second) | (F.col("dns_amplification_factor") > amplification))
