"""What generated scenarios are drawn from."""

# A repeated entry is a weight.
SCALES = [("small", 50, 500), ("medium", 500, 5000), ("large", 5000, 50000),
          ("enterprise", 50000, 200000)]
SITE_COUNTS = [1, 1, 2, 3, 5, 10, 25, 50, 100]
INDUSTRIES = [
    "financial_services", "healthcare", "retail", "manufacturing", "education", "government",
    "technology", "hospitality", "transportation", "energy_utilities",
]
COMPLIANCE_SETS = [
    [], ["PCI-DSS"], ["HIPAA"], ["SOX"], ["PCI-DSS", "SOX"], ["HIPAA", "SOX"],
    ["PCI-DSS", "HIPAA", "SOX"], ["NIST-CSF"], ["ISO-27001"], ["FedRAMP"],
]
UPTIMES = ["99.9%", "99.9%", "99.99%", "99.999%"]
BUDGETS = ["constrained", "moderate", "flexible", "unlimited"]
BUDGET_PHRASES = {
    "constrained": "limited budget", "moderate": "moderate budget",
    "flexible": "flexible budget", "unlimited": "budget is not a primary concern",
}
DATACENTER_SHARE = 0.15
CLOUD_SHARE = 0.3

# Fixed values: (protocol, issue, symptoms).
FAULTS = [
    ("bgp", "neighbor_down", ["BGP neighbor in Active state", "Routes missing from table"]),
    ("bgp", "route_missing", ["Expected prefix not in BGP table", "Traffic blackholing"]),
    ("bgp", "convergence_slow", ["BGP takes 45+ seconds to converge", "Traffic disruption during failover"]),
    ("ospf", "neighbor_exstart", ["OSPF neighbor stuck in EXSTART state", "DBD exchange failing"]),
    ("ospf", "lsa_flooding", ["High CPU on routers", "Frequent LSA retransmissions"]),
    ("ospf", "neighbor_down", ["OSPF adjacency dropped", "Dead timer expired"]),
    ("interface", "packet_loss", ["Intermittent packet loss", "High error counters"]),
    ("interface", "flapping", ["Interface cycling up/down", "Syslog flood of link state changes"]),
    ("interface", "crc_errors", ["CRC errors incrementing", "Degraded throughput"]),
    ("qos", "buffer_drops", ["Voice quality degraded", "Queue drops on WAN interface"]),
    ("qos", "misclassification", ["Business apps not getting priority bandwidth", "Wrong DSCP markings"]),
    ("connectivity", "layer3", ["Cannot reach destination", "Traceroute loops detected"]),
]

# Metadata lists of assembled samples.
DESIGN_SOURCES = [
    "Enterprise Network Design - Topology Selection Criteria",
    "PCI-DSS v4.0.1 Network Requirements",
    "Enterprise Network TCO Model",
    "Vendor Comparison Guide",
]
FAULT_SOURCES = ["OSI Model Troubleshooting Methodology", "Network Diagnostic Command Reference"]

# Typical hardware cost per user, USD text as the benchmark document has it.
CAPEX_PER_USER = {"small": "$350", "medium": "$600", "large": "$1000", "enterprise": "$600"}
CAPEX_DEFAULT = "$600"

# User range of a topology.
TOPOLOGY_USERS = {
    "collapsed_core": "50-2000", "three_tier": "2000-100000",
    "spine_leaf": "Data center workloads", "hub_and_spoke": "Varies by hub size",
}
