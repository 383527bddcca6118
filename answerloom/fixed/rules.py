"""Keyword rules for design text."""

# Words that give spine-leaf text its data-center context (sample rules).
SPINE_LEAF_CONTEXT = ["data center", "datacenter", "server", "rack", "pod"]

# The same for the accuracy rules.
SPINE_LEAF_REQUIRED = ["data center", "server", "east-west", "dc"]

# Overlay words and the context they need.
OVERLAY_WORDS = ["vxlan", "vtep", "vni", "evpn"]
OVERLAY_CONTEXT = ["data center", "spine-leaf", "overlay networks"]

# Single-vendor protocol words and the other vendors.
EIGRP_WORDS = ["eigrp", "diffusing update algorithm", "dual algorithm"]
OTHER_VENDORS = ["juniper", "arista", "hp ", "extreme"]

# User counts where the two campus topologies meet.
THREE_TIER_MIN_USERS = 2000
COLLAPSED_CORE_MAX_USERS = 2000

# Fixed values: (standard, control, words that show the control is covered).
CONTROLS = [
    ("PCI-DSS", "cde_segmentation", ["cde", "cardholder", "segmentation", "isolated vlan"]),
    ("PCI-DSS", "encryption_tls", ["tls 1.", "tls1.", "encryption"]),
    ("PCI-DSS", "firewall_rules", ["firewall", "acl", "access control"]),
    ("PCI-DSS", "logging", ["log", "audit", "siem", "monitoring"]),
    ("HIPAA", "phi_isolation", ["phi", "ehr", "emr", "hipaa vlan", "health data"]),
    ("HIPAA", "encryption", ["encrypt", "tls", "aes"]),
    ("HIPAA", "access_control", ["access control", "role-based", "least privilege", "mfa"]),
]
CONTROL_PREFIX = {"PCI-DSS": "pci", "HIPAA": "hipaa"}

# Address blocks that are not reported as public (first address, prefix length),
# and the two addresses inside them that are public all the same.
NON_PUBLIC_BLOCKS = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16),
    ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16),
    ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4),
]
PUBLIC_EXCEPTIONS = ["192.0.0.9", "192.0.0.10"]

# Evaluation gates. A gate whose metric was not computed passes as skipped.
GATE_TARGETS = {
    "technical_accuracy": 0.95,
    "reasoning_quality": 4.5,
    "knowledge_alignment": 0.95,
    "config_syntax_valid": 1.0,
    "think_block_present": 0.98,
    "min_reasoning_steps": 5.0,
}

# Dataset gates.
DATASET_GATES = {
    "min_citations_per_sample": 5,
    "min_reasoning_steps": 5,
    "max_reasoning_steps": 15,
    "max_duplicate_ratio": 0.02,
}

# Planned samples per topic.
TOPIC_TARGETS = [
    ("design", "enterprise_campus", 2000), ("design", "data_center", 1500),
    ("design", "sd_wan", 1000), ("design", "cloud_connectivity", 1000),
    ("design", "security_architecture", 1500), ("troubleshooting", "routing_bgp_ospf", 1000),
    ("troubleshooting", "switching_vlan", 500), ("troubleshooting", "performance_qos", 500),
    ("troubleshooting", "security_firewall", 500), ("troubleshooting", "ha_redundancy", 500),
]
