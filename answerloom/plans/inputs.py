"""Inputs of the registered queries, derived row by row from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.operators.knowledge import SLICES

# Sentences that give the rules something to find; one is added to every assistant turn.
REMARKS = [
    "Use three-tier for 50000 endpoints; BGP peers over TCP 179 with next-hop-self on iBGP.",
    "A collapsed core fits 2000 users. HSRP preemption is disabled by default.",
    "Spine-leaf in the data center carries east-west traffic; VXLAN with EVPN adds 50 byte overhead.",
    "Voice is marked EF (DSCP 46) and the LLQ gets 33 percent; classify at the edge for QoS.",
    "VRRP preempt is enabled. GLBP uses AVG and AVF roles with N+1 redundancy.",
    "```cisco\nrouter bgp 65001\n neighbor 10.0.0.2 remote-as 65002\n```",
    "```ios\nrouter ospf 1\n passive-interface default\n```\nEvery LSA refresh takes 30 minutes.",
    "```\nip access-list (open\n```\neBGP sets TTL to one hop; ebgp-multihop raises it.",
    "Inter-AS option A is the most secure, option C the most scalable for MPLS VPN; the RD must be unique.",
    "SD-WAN uses vBond, vManage and vSmart with BFD for latency; according to the cisco software-defined wide area guide.",
    "HIPAA 2013 Security Rule asks for audit log, encryption and role-based access control; SOX Section 404 applies.",
    "EIGRP with Juniper peers at 192.168.1.1 and 203.0.113.9; 1.1.1.1 is wrong. [CCNP Enterprise Design Guide] from Campus Network HA chapter.",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_text() -> F.Column:
    """The text of an assistant turn, wrapped as a model response."""
    steps = F.expr(
        "array_join(transform(sequence(1, CAST(conv_id % 10 AS INT)), i -> concat('Step ', i, "
        "': check item\\n- Source: RFC ', 2000 + i, '\\n')), '')"
    )
    think = F.when(F.col("conv_id") % 10 == 0, "").otherwise(
        F.concat(F.lit("<think>\n"), steps, F.lit("</think>\n\n"))
    )
    tail = (
        F.when(F.col("turn") % 4 == 1, " Use TLS 1.3 and PCI-DSS 4.0.1 at 8.8.8.8.")
        .when(F.col("turn") % 4 == 3, " CAPEX: $1.5M, annual OPEX: $250K on 10.0.0.1.")
        .otherwise("")
    )
    remark = F.array(*[F.lit(r) for r in REMARKS])[
        ((F.col("conv_id") * 7 + F.col("turn")) % len(REMARKS)).cast("int")
    ]
    return F.concat(think, F.col("text"), tail, F.lit("\n"), remark)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per assistant turn: conv_id, turn, raw, category, latency_ms."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    category = F.element_at(
        F.array(F.lit(""), F.lit("bgp"), F.lit("qos"), F.lit("topology"), F.lit("ha")),
        (F.col("conv_id") % 5 + 1).cast("int"),
    )
    return turns.select("conv_id", "turn", raw_text().alias("raw"), category.alias("category")).withColumn(
        "latency_ms", F.length("raw") * F.lit(2.5)
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with assistant turns wrapped as responses, still one row per message."""
    text = F.when(F.col("role") == "assistant", raw_text()).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.alias("text"))


def with_metadata(digest: DataFrame) -> DataFrame:
    """Sample metadata computed from the sample id."""
    k = F.col("sample_id")
    standards = F.array(F.lit("PCI-DSS"), F.lit("HIPAA"))
    return digest.select(
        "*",
        F.when(k % 3 == 0, "troubleshooting").when(k % 3 == 1, "design").alias("type"),
        F.when((k % 3 == 2) & (k % 2 == 0), "mixed").alias("category"),
        (50 + k * 7919 % 60000).alias("user_count"),
        F.when(k % 4 == 0, F.array().cast("array<string>"))
        .when(k % 4 == 1, F.slice(standards, 1, 1))
        .when(k % 4 == 2, F.slice(standards, 2, 1))
        .otherwise(standards).alias("compliance"),
        F.array_repeat(F.lit("guide"), (k % 4).cast("int")).alias("sources_used"),
        (k % 10).alias("reasoning_steps"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One service request per order."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    segment = F.col("c_mktsegment")
    standards = (
        F.when(segment == "BUILDING", F.array(F.lit("PCI-DSS")))
        .when(segment == "MACHINERY", F.array(F.lit("HIPAA")))
        .when(segment == "AUTOMOBILE", F.array(F.lit("PCI-DSS"), F.lit("HIPAA")))
        .otherwise(F.array().cast("array<string>"))
    )
    priority = F.col("o_orderpriority")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("req_id"),
        (50 + F.col("o_orderkey") * 7919 % 60000).cast("int").alias("users"),
        (1 + F.col("o_custkey") % 25).cast("int").alias("sites"),
        standards.alias("compliance"),
        F.when(F.startswith(priority, F.lit("1")), 99.99)
        .when(F.startswith(priority, F.lit("2")), 99.999)
        .when(F.startswith(priority, F.lit("5")), 89.5)
        .otherwise(99.9).alias("uptime"),
        F.lower(F.substring(priority, 1, 1)).alias("priority_code"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderdate").alias("ts"),
    )


def service_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as served requests."""
    return as_served(table(spark, sf_dir, "events"))


def utc(ts: str) -> F.Column:
    """A time without zone read as UTC, whatever zone the session has."""
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})"))


def as_served(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id"),
        utc("ts").alias("ts"),
        F.col("user_id"),
        F.col("event_type").alias("task_type"),
        (F.col("value") * 100).alias("latency_ms"),
        F.least(F.lit(1.0), F.lit(0.5) + F.col("value") / 300).alias("confidence"),
        (F.col("event_id") % 5 != 0).alias("has_think"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
    )


def test_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One test case per benchmark item: keywords are its distinct longer words."""
    keywords = F.array_distinct(
        F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) > 4)
    )
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("case_id"),
        F.array(F.lit("topology"), F.lit("bgp"), F.lit("qos"), F.lit("ha"))[
            (F.col("item_id") % 4).cast("int")
        ].alias("case_category"),
        F.concat(keywords, F.array(F.lit("TLS 1.3"), F.lit("Step 3"), F.lit("BGP"))).alias("expected_key_facts"),
        F.array(F.lit("Source list"), F.concat(F.lit("RFC "), F.col("item_id") + 2000),
                F.concat(F.lit("Campus "), F.try_element_at(keywords, F.lit(1)))).alias("sources_required"),
    )


def knowledge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested documents: one per region, one per event, one per text document."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    nations = F.array_join(
        F.sort_array(
            F.collect_list(
                F.concat(F.lit('{"key":"'), F.col("n_nationkey").cast("string"),
                         F.lit('","name":"'), F.col("n_name"), F.lit('"}'))
            )
        ),
        ",",
    )
    # At most 25 nations: the list under a region has a fixed size.
    by_region = (
        region.join(nation, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name")
        .agg(nations.alias("n"))
        .select(
            F.col("r_name").alias("category"), F.lit(None).cast("bigint").alias("doc_no"),
            F.concat(F.lit('{"name":"'), F.col("r_name"), F.lit('","empty":[],"nations":['), F.col("n"), F.lit("]}")).alias("doc"),
        )
    )
    by_event = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("category"), F.col("event_id").alias("doc_no"),
        F.concat(
            F.lit('{"props":'), F.col("props"), F.lit(',"who":["user", '), F.col("user_id").cast("string"), F.lit("]}")
        ).alias("doc"),
    )
    by_text = table(spark, sf_dir, "documents").select(
        F.col("source").alias("category"), F.col("doc_id").alias("doc_no"),
        F.to_json(F.struct(F.struct("text", "lang").alias("body"))).alias("doc"),
    )
    return by_region.unionByName(by_event).unionByName(by_text)


def nested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per part, as many lists in objects deep as its size says, 40 levels at most."""
    part = table(spark, sf_dir, "part")
    deep = (F.col("p_size") % 39 + 2).cast("int")
    doc = F.concat(F.repeat(F.lit('{"a":'), deep), F.lit('["'), F.col("p_name"), F.lit('",'), F.col("p_size").cast("string"), F.lit("]"), F.repeat(F.lit("}"), deep))
    return part.select(F.col("p_brand").alias("category"), F.col("p_partkey").alias("part"), doc.alias("doc"))


def section_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge documents: one per part under the sections of the knowledge base's slices, every sixth under another one."""
    part, n = table(spark, sf_dir, "part"), F.col("p_partkey") % len(SLICES)
    at = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(s).alias("s")) for _, c, s in SLICES])[n.cast("int")]
    section = F.when(F.col("p_partkey") % 6 == 0, F.lit("other")).otherwise(at["s"])
    doc = F.concat(F.lit('{"'), section, F.lit('":{"name":"'), F.col("p_name"), F.lit('","sizes":['), F.col("p_size").cast("string"), F.lit(",1]}}"))
    return part.select(at["c"].alias("category"), F.col("p_partkey").alias("part"), doc.alias("doc"))


def task_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One queue message per service request, in five forms."""
    r, form = requests(spark, sf_dir), F.col("req_id") % 5
    users, sites = F.col("users").cast("string"), F.col("sites").cast("string")
    listed = F.when(F.size("compliance") > 0, F.concat(F.lit('["'), F.array_join("compliance", '","'), F.lit('"]'))).otherwise("[]")
    body = (
        F.when(form == 0, F.concat(
            F.lit('{"task_type":"design","context":{"requirements":{"users":'), users, F.lit(',"sites":'), sites,
            F.lit(',"compliance":'), listed, F.lit(',"uptime":'), F.col("uptime").cast("string"),
            F.lit(',"region":"emea"}},"priority":"high"}')))
        .when(form == 1, F.concat(
            F.lit('{"type":"troubleshoot","context":{"device":"r'), sites, F.lit('","symptom":"link '), users, F.lit(' down"}}')))
        .when(form == 2, F.concat(
            F.lit('{"task_type":"estimate","context":{"users":'), users, F.lit(',"compliance":'), listed, F.lit('},"priority":"low"}')))
        .when(form == 3, F.concat(F.lit('{"users":'), users, F.lit(',"budget":"tight"}')))
        .otherwise(F.concat(F.lit('{"task_type":"review","context":{"note":"'), sites, F.lit('"}}')))
    )
    task = F.when(form == 3, "").otherwise(F.concat(F.lit('"task_id":"t'), F.col("req_id").cast("string"), F.lit('",')))
    value = F.concat(
        F.lit('{"message_id":"m'), F.col("req_id").cast("string"), F.lit('",'), task,
        F.when(form == 1, '"from_agent":"planner",').otherwise(""), F.lit('"payload":'), body, F.lit("}"),
    )
    return r.select("req_id", value.alias("value"))


def raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as they arrive, with gaps and values out of range."""
    r, k = requests(spark, sf_dir), F.col("req_id")
    return r.select(
        "req_id", "users", F.when(k % 4 != 0, F.col("sites")).alias("sites"),
        F.when(k % 5 != 0, F.col("compliance")).alias("compliance"), F.when(k % 6 != 0, F.col("uptime")).alias("uptime"),
        F.when(k % 3 != 0, 128 + k % 5000).alias("max_tokens"), ((k % 13) / 10).alias("temperature"),
        F.when(k % 7 != 0, F.substring(F.concat(F.lit("status "), F.col("status"), F.lit(" seen")), 1, (5 + k % 10).cast("int"))).alias("symptom"),
        F.when(k % 2 == 0, "USD").when(k % 9 == 0, "eur").alias("currency"),
    )


def base_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge entries: one per nation under one of six categories."""
    return table(spark, sf_dir, "nation").select(
        _category(F.col("n_regionkey")).alias("category"), F.lit("base").alias("section"), F.col("n_name").alias("key"),
        F.col("n_name").alias("entry"), F.lit("file").alias("source"), F.lit(0).cast("bigint").alias("added"),
        F.col("n_nationkey").cast("bigint").alias("seq"),
    )


def _category(number: F.Column) -> F.Column:
    names = ["design_patterns", "troubleshooting_trees", "compliance_requirements", "vendor_specifics", "cost_benchmarks", "unlisted"]
    return F.array(*[F.lit(n) for n in names])[(number % 6).cast("int")]


def new_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates: one per customer, to the key of its nation; every sixth category does not exist."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        _category(F.col("n_regionkey") + F.col("c_custkey") % 6).alias("category"), F.lit("base").alias("section"),
        F.col("n_name").alias("key"), F.col("c_name").alias("entry"), F.lit("update").alias("source"),
        (F.col("c_custkey") % 100).cast("bigint").alias("added"), F.col("c_custkey").alias("seq"),
    )
